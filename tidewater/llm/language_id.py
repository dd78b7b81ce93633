"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to `ORDER` bytes long is counted over
the training texts. A byte is coded in the longest context that has been seen: with
n of N occurrences of q different bytes its probability is n / (N + q); a byte that
this context has not seen costs the escape q / (N + q) and is then coded one context
shorter, down to a uniform code of all bytes. Statistics are frozen after training,
so each context's code lengths are tabulated once and a text's exact code length in
every language is a sum of table entries over all its bytes. The language of the
shortest code wins. The score is the chance that it is right, by a logistic curve of
the bits a byte by which the second language's code is longer; the curve is fitted on
short pieces of a quarter of the training texts, which no tree has counted.

Defined results
---------------
* null texts and texts without a letter are `und` with score 0;
* training leaves out rows without text or language; without any training row
  every text is `und`; with one language alone every score is 1;
* a language whose training texts are all above TRAIN_BYTES is learnt from the
  shortest of them; beyond GROUPS languages the less frequent are not learnt;
* A-Z are lower-cased before counting and scoring; nothing is cut off;
* repeated rows get equal results; ties go to the first language by code point;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm._shared import GROUPS, bounded_sample, logistic, small_batches

ORDER = 3
#: Bound of the training sample: rows of each language, none longer than TRAIN_BYTES.
TRAIN_ROWS, TRAIN_BYTES = 400, 20_000
#: Bytes that are scored at a time, and those of a piece that scores are calibrated on.
BLOCK, PIECE = 1 << 20, 8
UNKNOWN = "und"
_PAD = b"   "


@dataclass
class Model:
    """Frozen code lengths in bits.

    code: byte to symbol; short: [symbol, symbol, symbol, language] for contexts of
    two; row: context of three to its row of long, or -1; long: [row, symbol, language].
    """

    langs: list[str]
    code: bytes
    size: int
    short: np.ndarray
    row: np.ndarray
    long: np.ndarray
    slope: float = 0.0
    offset: float = 30.0


def _blend(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probabilities in contexts (rows) from counts and those of contexts one byte shorter."""
    total, kinds = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
    whole = np.maximum(total + kinds, 1)
    return np.where(total == 0, lower, np.where(counts > 0, counts / whole, kinds / whole * lower))


def train(texts: dict[str, list[bytes]]) -> Model:
    """The model of texts by language: trees of three quarters of each language's texts, scores by the rest.

    Languages of fewer than four texts have trees of all of them.
    """
    some = {k: [t for i, t in enumerate(v) if len(v) < 4 or i % 4] for k, v in texts.items()}
    model = _trees(some)
    if len(texts) > 1:
        rest = [(k, t) for k, v in texts.items() for t in (v if len(v) < 4 else v[::4])]
        pieces = [(k, t[i : i + PIECE]) for k, t in rest for i in range(0, len(t) - PIECE + 1, 5 * PIECE)] or rest
        bits = code_lengths(model, [p for _, p in pieces])
        right = np.array([k == model.langs[b] for (k, _), b in zip(pieces, bits.argmin(1), strict=True)])
        model.slope, model.offset = logistic(_margin(bits, [p for _, p in pieces]), right.astype(float))
    return model


def _margin(bits: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """By how many bits a byte the second shortest code is longer than the shortest."""
    least = np.partition(bits, 1, axis=1)
    return (least[:, 1] - least[:, 0]) / np.maximum([len(t) for t in texts], 1)


def _trees(texts: dict[str, list[bytes]]) -> Model:
    langs = sorted(texts, key=lambda x: x.encode())
    joined = {k: _PAD + _PAD.join(t.lower() for t in texts[k]) + _PAD for k in langs}
    seen = sorted(set().union(*map(set, joined.values())) | set(_PAD)) if langs else [32]
    code = bytearray(256)  # symbol 0: bytes that no training text has
    for i, b in enumerate(seen):
        code[b] = i + 1
    a = len(seen) + 1
    grams = {}
    for k in langs:
        c = np.frombuffer(joined[k].translate(bytes(code)), dtype=np.uint8).astype(np.int64)
        grams[k] = np.unique(((c[:-3] * a + c[1:-2]) * a + c[2:-1]) * a + c[3:], return_counts=True)
    contexts = np.unique(np.concatenate([g[0] // a for g in grams.values()])) if langs else np.zeros(0, np.int64)
    row = np.full(a**3, -1, dtype=np.int32)
    row[contexts] = np.arange(len(contexts), dtype=np.int32)
    short = np.zeros((a, a, a, len(langs)), dtype=np.float32)
    long = np.zeros((len(contexts), a, len(langs)), dtype=np.float32)
    for k, lang in enumerate(langs):
        gram, n = grams[lang]
        c4 = np.zeros((len(contexts), a))
        c4[row[gram // a], gram % a] = n
        c3 = np.zeros((a * a, a))
        np.add.at(c3, (gram // a % (a * a), gram % a), n)
        c2 = c3.reshape(a, a, a).sum(0)
        p0 = _blend(c2.sum(0)[None, :], np.full((1, a), 1 / 256))
        p1 = _blend(c2, p0)
        p2 = _blend(c3.reshape(a, a, a), p1[None, :, :])
        p3 = _blend(c4, p2.reshape(a * a, a)[contexts % (a * a)])
        short[..., k], long[..., k] = -np.log2(p2), -np.log2(p3)
    return Model(langs, bytes(code), a, short.reshape(a**3, len(langs)), row, long.reshape(len(contexts) * a, len(langs)))


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of each text in each language."""
    a = model.size
    data = b"".join(_PAD + t.lower() for t in texts)
    c = np.frombuffer(data.translate(model.code), dtype=np.uint8).astype(np.int32)
    before = (c[:-3] * a + c[1:-2]) * a + c[2:-1]
    row, now = model.row[before], c[3:]
    cost = model.long[np.maximum(row, 0) * a + now] if len(model.long) else np.zeros((len(now), len(model.langs)), np.float32)
    new = np.flatnonzero(row < 0)
    cost[new] = model.short[before[new] % (a * a) * a + now[new]]
    cost = np.concatenate([np.zeros((3, cost.shape[1]), np.float32), cost])
    lens = np.array([len(t) + 3 for t in texts])
    starts = np.r_[0, np.cumsum(lens)[:-1]]
    for i in range(3):  # the padding itself is not coded
        cost[starts + i] = 0
    return np.add.reduceat(cost, starts, axis=0, dtype=np.float64)


def has_letter(text: bytes) -> bool:
    return any(ch.isalpha() for ch in text.decode("utf-8", "replace"))


def predict(model: Model, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
    todo = [i for i, t in enumerate(texts) if t and model.langs and has_letter(t)]
    while todo:
        size, n = 0, 0
        while n < len(todo) and (n == 0 or size + len(texts[todo[n]]) <= BLOCK):
            size += len(texts[todo[n]])
            n += 1
        now, todo = todo[:n], todo[n:]
        bits = code_lengths(model, [texts[i] for i in now])
        likely = np.ones(len(now))
        if len(model.langs) > 1:
            likely = 1 / (1 + np.exp(-np.clip(model.slope * _margin(bits, [texts[i] for i in now]) + model.offset, -30, 30)))
        for i, k, p in zip(now, bits.argmin(1), likely, strict=True):
            pred[i], score[i] = model.langs[k], float(p)
    return pred, score


def training_texts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order_col: str = "doc_id", rows: int = TRAIN_ROWS) -> dict[str, list[bytes]]:
    """A bounded sample by hashed order: `rows` rows of each language, each at most TRAIN_BYTES long."""
    fit = docs.where(F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0))
    fit = fit.select(F.col(lang_col).alias("l"), F.col(text_col).cast("binary").alias("t"), F.xxhash64(order_col, text_col).alias("h"))
    lengths = fit.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.length("t"), "h")).alias("least"))
    known = lengths.orderBy(F.desc("n"), "l").limit(GROUPS).collect()
    fit = fit.where(F.col("l").isin([r.l for r in known]))
    out: dict[str, list[bytes]] = {}
    for r in bounded_sample(fit.where(F.length("t") <= TRAIN_BYTES), "l", ["h"], rows).orderBy("l", "h", "t").toLocalIterator():
        out.setdefault(r.l, []).append(bytes(r.t))
    for new in (r for r in known if r.l not in out):  # languages of long texts only
        first = fit.where((F.col("l") == new.l) & (F.col("h") == new.least[1])).first()
        out[new.l] = [bytes(first.t)]
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` of docs, and the language and its score under `names`, which none of `keep` may have, of each row."""
    if set(keep or ()) & set(names):
        raise ValueError(f"columns {sorted(set(keep) & set(names))} are both kept and made: give other names")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            pred, score = predict(m, b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, *names])

    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("binary").alias("_t"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{schema}{', ' * bool(keep)}`{names[0]}` string, `{names[1]}` double")


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 0 by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))
