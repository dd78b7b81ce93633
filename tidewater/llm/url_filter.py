"""URL filters: host and path rules, and a character language-model ratio; DataFrame functions only.

URLs that an allow rule fits are examples of accepted ones, those that a block rule
fits of rejected ones. For both a Markov model of variable order counts characters in
contexts of two, one and no characters, each smoothed by the shorter one in
proportion to how many different characters the context has had (Witten-Bell). A
URL's log-likelihood difference divided by its length is held against a threshold.
The models count every different example, none is sampled. The threshold is calibrated
on all of them too: each is measured by models that count the half, by hash, that it is
not in, so they have not seen it.

What is modelled is the host without its last label, and all that follows the host:
rules name last labels, so examples would teach these and little else.

Defined results
---------------
* null URLs and URLs without :// have an empty host and path; no rule fits them;
  what is modelled of them is nothing;
* URLs of any length count whole;
* a URL without characters has ratio 0 and is held against the threshold as others are;
* if either kind has no example, every URL without a rule is allowed;
* repeated rows get equal results; of rules of one length the first wins;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm._shared import lower_ascii, staged

#: Symbols of the models; any other character is symbol 0, which also pads the start.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789./:-_?=&%#~+@"

Rule = tuple[str, str]


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(after_scheme(url), "^[^/?#]*", ""), "^[^?#]*", 0)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does.

    rules: (verdict, host/path). A rule fits its host and the host's subdomains, if
    the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        top, _, rest = text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def modelled(url: Column) -> Column:
    """What of a URL the models read."""
    own = F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), F.lit(""))
    rest = F.coalesce(F.regexp_replace(after_scheme(url), "^[^/?#]*", ""), F.lit(""))
    return F.concat(F.regexp_replace(own, r"\.?[^.]*$", ""), rest)


def symbols(url: Column) -> Column:
    """A URL's symbols, with two pads in front."""
    text = F.lower(F.coalesce(url, F.lit("")))
    own = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    return F.concat(F.array(F.lit(0), F.lit(0)), F.when(F.length(text) > 0, own).otherwise(F.array().cast("array<int>")))


def contexts(codes: Column) -> Column:
    """For each symbol the number of it and the two before it."""
    c = len(SYMBOLS) + 1
    at = F.when(F.size(codes) > 2, F.sequence(F.lit(1), F.size(codes) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: (F.element_at(codes, i) * c + F.element_at(codes, i + 1)) * c + F.element_at(codes, i + 2))


def counted(examples: DataFrame) -> np.ndarray:
    """How often each context and symbol occurs in examples (half int, kind int, codes): an array by half, kind and the three symbols.

    It has 4 * (len(SYMBOLS) + 1) ** 3 entries, whatever the input.
    """
    c = len(SYMBOLS) + 1
    grams = examples.select("half", "kind", F.explode(contexts(F.col("codes"))).alias("g"))
    n = grams.groupBy("half", "kind", "g").agg(F.count(F.lit(1)).alias("n")).toArrow()
    out = np.zeros((2, 2, c**3))
    out[n["half"].to_numpy(), n["kind"].to_numpy(), n["g"].to_numpy()] = n["n"].to_numpy()
    return out.reshape(2, 2, c, c, c)


def fitted(n: np.ndarray) -> list[float]:
    """log P(accepted) - log P(rejected) of every context and symbol, in order of their number; n is by kind and the three symbols."""
    c = n.shape[-1]
    p = (n.sum((1, 2)) + 1) / (n.sum((1, 2, 3)) + c)[:, None]
    for m in (n.sum(1), n):
        p = np.broadcast_to(p[:, None], m.shape)
        total, kinds = m.sum(-1, keepdims=True), (m > 0).sum(-1, keepdims=True)
        p = np.where(total == 0, p, (m + kinds * p) / np.maximum(total + kinds, 1))
    return (np.log(p[1]) - np.log(p[0])).ravel().tolist()


def train(examples: DataFrame) -> list[float]:
    """The model of examples (kind int, codes): 1 accepted, 0 rejected."""
    return fitted(counted(examples.withColumn("half", F.lit(0))).sum(0))


def ratio(codes: Column, model: list[float]) -> Column:
    """The length-normalised log-likelihood difference of a URL's symbols."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    total = F.aggregate(contexts(codes), F.lit(0.0), lambda s, g: s + F.element_at(table, g + 1))
    return total / F.greatest(F.size(codes) - 2, F.lit(1))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, ratio double) of every row."""
    url = F.col(url_col)
    own = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), url.alias("url"))
    own = own.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = staged(own.withColumn("rule", rule).withColumn("verdict", verdict), "urls")
    known = own.where("verdict is not null").select((F.col("verdict") == "allow").cast("int").alias("kind"), modelled(F.col("url")).alias("url")).distinct()
    n_parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    examples = staged(known.repartition(n_parts, "url").withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "url"), F.lit(2)).cast("int")), "examples")
    halves = {(r.kind, r.half) for r in examples.select("kind", "half").distinct().collect()}
    if len({k for k, _ in halves}) < 2:
        return own.select("id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("ratio"))
    examples = examples.withColumn("codes", symbols(F.col("url")))
    counts = counted(examples)
    model = fitted(counts.sum(0))
    # of so few examples that a kind is missing in a half, all serve for both
    apart = [fitted(counts[1 - h]) for h in (0, 1)] if len(halves) == 4 else [model, model]
    unseen = [examples.where(F.col("half") == h).select("kind", ratio(F.col("codes"), apart[h]).alias("r")) for h in (0, 1)]
    fit = {r.kind: r for r in unseen[0].unionByName(unseen[1]).groupBy("kind").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("s")).collect()}
    spread = fit[1].s + fit[0].s
    # as many spreads from either mean
    limit = (fit[1].m * fit[0].s + fit[0].m * fit[1].s) / spread if spread > 0 else (fit[1].m + fit[0].m) / 2
    # the symbols are a column of their own: inside the sum they would be made anew for each of them
    scored = own.withColumn("codes", symbols(modelled(F.col("url")))).withColumn("ratio", ratio(F.col("codes"), model))
    return scored.select("id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("ratio") >= limit, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"), "ratio")
