"""Quality by compression: zstandard dictionaries from good and from bad labelled text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8

#: Labelled texts of each class that the model is fitted on at most, by least hash of doc_id,
#: and the bytes above which a text is not chosen (so the driver holds 2 * 1,500 * 16 kB at most).
MOST_TEXTS, MOST_BYTES = 1_500, 16_384
#: Bytes of each dictionary, the compression level, and the bytes of a block: a text is
#: compressed in blocks, so that the dictionary and not the text's own past is what a
#: block is like. Chosen on the two folds that are learned from (one against the other).
DICT_BYTES, LEVEL, BLOCK = 16_384, 3, 1024
#: Share of the fitted texts that calibrate the score and stay out of the dictionaries.
CALIBRATION = 3


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Two dictionaries, and the logistic line from size difference to score."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def differences(self) -> _Sizes:
        return _Sizes(self.good, self.bad)

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * difference + self.offset, -30, 30)))


class _Sizes:
    def __init__(self, good: bytes, bad: bytes):
        self.frames = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_prepared(d), write_content_size=False, write_dict_id=False, write_checksum=False) for d in (good, bad)]

    def __call__(self, text: bytes | None) -> float:
        """(bytes with the bad dictionary - bytes with the good one) / their sum; 0 without text."""
        if not text:
            return 0.0
        parts = blocks(text)
        good, bad = (sum(len(f.compress(part)) for part in parts) for f in self.frames)
        return (bad - good) / (bad + good)


def blocks(text: bytes) -> list[bytes]:
    """The whole text in pieces of BLOCK bytes."""
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def _prepared(data: bytes) -> zstandard.ZstdCompressionDict:
    out = zstandard.ZstdCompressionDict(data)
    out.precompute_compress(level=LEVEL)
    return out


def build_dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; texts too few to train on serve as they are."""
    try:
        return zstandard.train_dictionary(size, [part for t in texts for part in blocks(t)]).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:size] or b"\n" * 8


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one variable, by Newton steps; classes weigh alike."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge * np.array([1e-3, 1.0]) * beta
        curvature = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge * np.diag([1e-3, 1.0])
        step = np.linalg.solve(curvature, gradient)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, most_texts: int = MOST_TEXTS, most_bytes: int = MOST_BYTES) -> Model:
    """Fits on labelled documents outside the held-out fold, a bounded number of each class.

    Labels are quality 1 or 0; others and null are passed over, as are texts that are
    null, empty or over most_bytes. With labels of one class only, or none, all
    scores are one half.
    """
    known = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), "quality").distinct()
    known = known.withColumn("_draw", F.xxhash64(F.lit(9), "_id"))
    picked = [known.filter(F.col("quality") == q).orderBy("_draw", "_id").limit(most_texts) for q in (1, 0)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * most_texts rows at most
    usable = docs.select("doc_id", "text").filter(F.octet_length("text").between(1, most_bytes))
    rows = usable.join(picked, F.col("doc_id") == F.col("_id")).orderBy("_draw", "doc_id", F.xxhash64("text"), "quality").limit(2 * most_texts)
    chosen: dict[int, list[bytes]] = {0: [], 1: []}
    for quality, text in rows.select("quality", "text").collect():
        chosen[quality].append(text.encode())
    if not chosen[0] or not chosen[1]:
        return Model(b"\n" * 8, b"\n" * 8, 0.0, 0.0)
    parts = {q: ([t for i, t in enumerate(x) if i % CALIBRATION or len(x) == 1], x[::CALIBRATION]) for q, x in chosen.items()}
    model = Model(build_dictionary(parts[1][0]), build_dictionary(parts[0][0]), 0.0, 0.0)
    difference = model.differences()
    x = np.array([difference(t) for q in (1, 0) for t in parts[q][1]])
    y = np.array([q for q in (1, 0) for _ in parts[q][1]])
    model.slope, model.offset = logistic(x, y)
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (higher: quality 1 likelier) and predicted for every document.

    The score is a logistic function of the normalised difference of the whole
    text's sizes as compressed, block by block, with either dictionary. Null and empty texts have
    difference 0. The model (two dictionaries of DICT_BYTES at most) travels with
    the function. Repeated rows score alike; an empty table gives no rows; extra
    columns are ignored.
    """
    kind = dict(docs.dtypes)["doc_id"]
    fields = vars(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(**fields)
        difference = fitted.differences()
        for batch in batches:
            score = fitted.score(np.array([difference(t) for t in utf8(batch.column("text"))], dtype=float))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32)),
            })

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
