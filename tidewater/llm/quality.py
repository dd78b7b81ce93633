"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

A dictionary is built from each class of a labelled sample. A text is cut into
pieces, all of which are compressed with either dictionary; the difference of the
two compressed sizes, divided by the text's size, tells which class it is like. A
logistic curve, fitted on labelled rows that the dictionaries have not seen, makes
that difference a probability.

Defined results
---------------
* null and empty texts have difference 0 and get its calibrated score;
* rows without a label are not learnt from; if a class has no labelled row, every
  score is the share of good labels (0.5 without labels);
* repeated rows get equal scores; nothing is cut off;
* an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm._shared import bounded_sample, logistic, small_batches

#: Bounds: labelled rows of each class that are learnt from, their longest, and a dictionary's bytes.
TRAIN_ROWS, TRAIN_BYTES, DICT_BYTES = 1200, 20_000, 112_640
#: Bytes of a piece: each is compressed by the dictionary alone.
PIECE = 256
LEVEL = 3
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)


def difference(text: bytes | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(bytes by the bad dictionary - bytes by the good one) / bytes of the text."""
    if not text:
        return 0.0
    pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
    return sum(len(bad.compress(p)) - len(good.compress(p)) for p in pieces) / len(text)


def train(good: list[bytes], bad: list[bytes], share_good: float) -> Model:
    """share_good: of all labelled rows, to which the curve is adjusted where the sample differs."""
    if not good or not bad:
        p = min(max(share_good, 1e-6), 1 - 1e-6)
        return Model(b"", b"", 0.0, float(np.log(p / (1 - p))))

    def content(texts: list[bytes]) -> bytes:
        pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
        try:
            return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
        except zstandard.ZstdError:  # too few texts to choose from: they are the dictionary
            return b"".join(pieces)[-DICT_BYTES:]

    half = lambda x, k: x[k::2] or x  # noqa: E731  dictionaries from one half, the curve from the other
    a, b = content(half(good, 0)), content(half(bad, 0))
    cg, cb = _compressor(a), _compressor(b)
    x = np.array([difference(t, cg, cb) for t in half(good, 1) + half(bad, 1)])
    y = np.r_[np.ones(len(half(good, 1))), np.zeros(len(half(bad, 1)))]
    slope, offset = logistic(x, y)
    n = y.mean()
    offset += np.log(share_good / (1 - share_good)) - np.log(n / (1 - n)) if 0 < share_good < 1 else 0.0
    return Model(a, b, slope, float(offset))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """A model of the rows of docs that have a label; docs are the rows that may be learnt from."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("y in (0, 1)")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    share = texts.select("id").join(known, F.col("id") == F.col("i")).agg(F.avg("y").alias("p")).first().p
    texts = texts.where((F.octet_length("t") > 0) & (F.octet_length("t") <= TRAIN_BYTES))
    labelled = texts.select("id").join(known, F.col("id") == F.col("i")).select("i", "y").distinct()
    ids = bounded_sample(labelled, "y", ["i"], TRAIN_ROWS)
    got: dict[int, list[bytes]] = {0: [], 1: []}
    for r in texts.join(F.broadcast(ids), F.col("id") == F.col("i")).orderBy("y", F.xxhash64("i"), "i", "t").select("y", "t").toLocalIterator():
        got[int(r.y)].append(bytes(r.t))
    return train(got[1], got[0], 0.5 if share is None else float(share))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, difference double, score double, predicted int) of every row."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cg, cb = (_compressor(m.good), _compressor(m.bad)) if m.good else (None, None)
        for b in batches:
            d = np.array([difference(t, cg, cb) if cg else 0.0 for t in b.column(1).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(m.slope * d + m.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(d), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["id", "difference", "score", "predicted"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, difference double, score double, predicted int")
