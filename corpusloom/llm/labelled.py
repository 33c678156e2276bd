"""Bounded samples of labelled rows to fit a classifier on, and the score query both classifiers share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, blocks, bounded_batches, frugal, held_out, texts

#: Characters of the longest text that may be in a sample; it bounds what the driver holds.
LONGEST_SAMPLE = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], longest: int = LONGEST_SAMPLE) -> pd.DataFrame:
    """text and y of at most most[y] rows of each label, those with the lowest hash of their id.

    Held-out rows, rows without a text or label, and texts over `longest` characters are not used.
    The hash makes the sample the same on every run and independent of the table's order. Ids are
    picked before texts are read, so only the sample's texts reach the driver.
    """
    known = labels.where(F.col(label).isin(*most) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sizes = docs.where(F.col("text").isNotNull() & (F.length("text") <= longest)).select(F.col("doc_id")).distinct()
    scratch = Scratch(docs.sparkSession, "labelled")
    ids = scratch.keep(known.join(sizes, "doc_id").select("doc_id", "y", F.xxhash64("doc_id").alias("h")), "ids")  # one pass over the texts, for both labels
    picked = [r for y, n in most.items() for r in ids.where(F.col("y") == y).orderBy("h", "doc_id").limit(n).collect()]
    if not picked:
        return pd.DataFrame({"text": pd.Series([], dtype=str), "y": pd.Series([], dtype=int)})
    # bounded by `most`: at most a few thousand ids
    few = docs.sparkSession.createDataFrame([(r.doc_id, r.y) for r in picked], "doc_id long, y int")
    rows = docs.where(F.length("text") <= longest).select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    sample = rows.toPandas().sort_values("doc_id")[["text", "y"]].reset_index(drop=True)
    scratch.drop()
    return sample


def scored(docs: DataFrame, scorer: Callable[[], Callable[[list[str]], np.ndarray]], threshold: float, block_bytes: int = 2_000_000) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; scorer() is made once a task."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for b in blocks(batches, "text", block_bytes):
            p = np.clip(np.asarray(score(texts(b)), float), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, scorer: Callable[[], Callable[[list[str]], np.ndarray]], threshold: float, keep: int, block_bytes: int = 2_000_000) -> DataFrame:
    """The rows of docs, all columns, whose prediction is `keep`; the texts move no further than this task."""
    names = docs.columns

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for b in blocks(batches, "text", block_bytes):
            yield b.filter(pa.array((np.asarray(score(texts(b))) >= threshold).astype(int) == keep))

    bounded_batches(docs.sparkSession)
    return docs.select(*names).mapInArrow(run, docs.schema)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and weights (the last is the constant) of a ridge logistic regression by Newton's steps."""
    mean, dev = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / dev, np.ones(len(x))]
    weight = np.ones(len(y)) if weight is None else weight
    w = np.zeros(z.shape[1])
    ridge = l2 * weight.sum() * np.eye(len(w))
    ridge[-1, -1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + ridge, z.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, dev, w
