"""Quality classifier: zstandard with a dictionary of good text and one of bad text; the relative difference of the two
compressed sizes is calibrated into a score.

The fit uses a bounded sample of labelled rows: at most `per_class` of each label, first by a hash of the id, with texts
of at most `longest` characters. Two thirds build the dictionaries, one third calibrates. Scoring covers every whole
text, in independent pieces of `PIECE` bytes so that a long text can't learn from itself and forget the dictionaries.

Defined results: null and empty texts have no evidence (difference 0) and get the calibrated score of that; without
labelled rows of both kinds every score is the share of good labels (0.5 without labels). Repeated labels of an id count once,
with the smaller label; null labels don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget_tables

#: Bytes of text that are compressed at a time.
PIECE = 2048
LEVEL = 3
DICTIONARY_BYTES = 96 << 10


@dataclass(frozen=True)
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """(bad size - good size) / (bad size + good size) of each text; above 0: more like the good text."""
        if not self.good or not self.bad:
            return np.zeros(len(texts))
        sizes = []
        for content in (self.good, self.bad):
            learned = zstandard.ZstdCompressionDict(content)
            learned.precompute_compress(LEVEL)
            compress = zstandard.ZstdCompressor(dict_data=learned, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress
            sizes.append(np.array([sum(len(compress(t[i : i + PIECE])) for i in range(0, len(t), PIECE)) for t in texts], dtype=np.float64))
        good, bad = sizes
        return (bad - good) / np.maximum(bad + good, 1)

    def scores(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * differences + self.offset, -40, 40)))


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little text to train one, the text itself is used as the dictionary."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    raw = b"".join(pieces)
    if len(raw) >= 8 * DICTIONARY_BYTES:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return raw[-DICTIONARY_BYTES:]


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x with a light ridge, by Newton steps."""
    scale = max(float(np.abs(x).mean()), 1e-9)
    design, weights = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    ridge = np.diag([0.05, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + ridge, design.T @ (y - p) - ridge @ weights)
        weights += np.clip(step, -5, 5)
    return float(weights[0] / scale), float(weights[1])


def fit(docs: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2000, longest: int = 30_000) -> CompressionModel:
    """Learn from labelled rows for which `learns` (a condition on the column doc_id) holds."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL").where(learns)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    sample = [known.where(F.col("label") == k).orderBy("order", "doc_id").limit(per_class) for k in (0, 1)]
    sample = sample[0].unionByName(sample[1])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "doc_id").where(F.length("text") <= longest).select("doc_id", "order", "label", "text").collect()
    rows = sorted({r["doc_id"]: r for r in sorted(rows, key=lambda r: r["text"])}.values(), key=lambda r: (r["order"], r["doc_id"]))
    if len({r["label"] for r in rows}) < 2:
        share = (sum(r["label"] for r in rows) + 0.5) / (len(rows) + 1)
        return CompressionModel(b"", b"", 0.0, float(np.log(share / (1 - share))))
    split: dict[int, list[list[bytes]]] = {0: [[], []], 1: [[], []]}
    for k in (0, 1):
        for i, r in enumerate(r for r in rows if r["label"] == k):
            split[k][i % 3 == 2].append(r["text"].encode())
    model = CompressionModel(_dictionary(split[1][0]), _dictionary(split[0][0]), 1.0, 0.0)
    if not split[0][1] or not split[1][1]:
        split = {k: [v[0], v[0]] for k, v in split.items()}
    x = model.differences(split[0][1] + split[1][1])
    slope, offset = _calibrate(x, np.array([0.0] * len(split[0][1]) + [1.0] * len(split[1][1])))
    return CompressionModel(model.good, model.bad, slope, offset)


def score(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, difference, score."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            d = model.differences([x.as_py() for x in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d), pa.array(model.scores(d))], names=["doc_id", "difference", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, difference double, score double")


def good_documents(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose score reaches `least`, with all their columns, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary()).fill_null(b"")
            yield batch.filter(pa.array(model.scores(model.differences([x.as_py() for x in texts])) >= least))

    return docs.mapInArrow(run, docs.schema)
