"""The corpus pipeline: five stages from raw documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes a
stage's rows to the shared folder and reads them as the next one's documents.

Defined results of every stage
------------------------------
* all columns of documents go through unchanged, whatever their names; a stage's own
  columns meet none of them, since documents travel as one column `row`;
* a null id is an id like any other; rows are told apart by id and text, and where
  stages need it by all columns;
* texts of any length are read whole; nothing is cut off;
* an empty table gives an empty result; what a stage says of null and empty texts,
  repeated rows and ties stands at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, language_id, mixing, queries, simhash
from tidewater.llm._shared import staged

#: Documents whose language is less likely than this are rejected, and those without any letter.
LEAST_SCORE = 0.5


def _rows(docs: DataFrame) -> DataFrame:
    """docs as one column, so that no name of theirs meets one that a stage adds."""
    return docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; rejects those without a letter or a likely language.

    Null and empty texts, and texts without a letter, are rejected. Texts whose
    language is more likely wrong than right are rejected; of languages of equal code
    length the first by code point counts. Repeated rows are judged alike, each stays
    or goes. If no row has a language, all are rejected.
    """
    model = language_id.train(language_id.training_texts(docs.where(~language_id.held_out(F.col("doc_id")))))
    judged = language_id.identify(_rows(docs).select("row", F.col("row.text").alias("text")), model, keep=["row"])
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Candidates have SimHash fingerprints that differ in 8 bits or fewer, or share a MinHash
    band, which finds the similar texts that differ in more; all are checked on the texts.
    The document with the least id of a group stays; null only if no other id is there.
    All texts without a word are one group. Of rows with that id and the same shingles
    one stays, the first by all its columns; where rows with that id have different
    texts of the group, one of each of these sets of shingles stays.
    """
    out = staged(simhash.groups(docs), "groups")
    kept = out.where(F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "fp").distinct()
    here = F.col("row.doc_id").eqNullSafe(F.col("id"))
    if out.groupBy("id").count().where("count > 1").isEmpty():
        return _rows(docs).join(kept, here, "left_semi").select("row.*")
    # ids repeat: the row is told by its set of shingles too, and of equal ones one stays
    marked = _rows(docs).withColumn("p", simhash.print_of(F.col("row.text"), 5)).join(kept, here & (F.col("p") == F.col("fp")), "left_semi")
    first = F.row_number().over(Window.partitionBy("row.doc_id", "p").orderBy("row"))
    return marked.withColumn("r", first).where("r = 1").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item: fewer than 0.8 of each item's shingles.

    Documents without a word contain none and stay. Rows with one id are judged by
    their own texts; repeated rows alike. Without benchmark items all rows stay.
    """
    found = decontaminate.contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("id", "mark").distinct()
    return _rows(docs).join(found, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("mark")), "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Texts without a word are taken as often as others of the last level. Of rows that
    are equal in all columns one stands for all and is taken as often as they were
    together. A null source is a source, last in order.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = mixing.mix(docs, extra=others).groupBy("id", "mark").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("equal"))
    out = staged(out, "copies")
    marked = _rows(docs).withColumn("m", F.xxhash64("row.text", *[F.col("row")[c] for c in others]))
    if not out.where("equal > 1").isEmpty():  # equal rows: one of them stands for all
        marked = marked.withColumn("r", F.row_number().over(Window.partitionBy("row.doc_id", "m").orderBy("m"))).where("r = 1")
    taken = marked.join(out.where("n > 0"), F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("m") == F.col("mark")))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, read back: place, length and checksum of each document in them.

    A null or empty text is the end id alone; repeated rows are written each time.
    """
    return queries.tokens_of(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL can express neither the language model nor the fingerprints' components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
