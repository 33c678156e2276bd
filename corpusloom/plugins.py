"""Where models plug in, and deterministic stand-ins. A stand-in is no model; it makes the plans around it testable."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, question: str, passages: list[str]) -> list[float]: ...


class Provider(Protocol):
    def generate(self, messages: list[dict]) -> str: ...


class Parser(Protocol):
    def parse(self, content: str) -> str: ...


def parse(files: DataFrame, make: Callable[[], Parser], column: str = "content") -> DataFrame:
    """files with parsed, seconds and error of each; a file that can't be parsed gives its error, and the others go on."""

    @F.pandas_udf("parsed string, seconds double, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = make()
        for b in batches:
            rows = []
            for content in b.fillna(""):
                began = time.perf_counter()
                try:
                    made, error = parser.parse(content), None
                except Exception as e:
                    made, error = None, f"{type(e).__name__}: {e}"
                rows.append((made, time.perf_counter() - began, error))
            yield pd.DataFrame(rows, columns=["parsed", "seconds", "error"])

    return files.withColumn("_p", run(column)).select(*files.columns, "_p.*")


def embed(texts: DataFrame, make: Callable[[], Embedder], column: str = "text") -> DataFrame:
    """texts with `vector`; the model is made once a task and gets Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for b in batches:
            yield pd.Series(list(model.embed(list(b.fillna("")))))

    return texts.withColumn("vector", run(column))


def rerank_scores(pairs: DataFrame, make: Callable[[], Reranker]) -> DataFrame:
    """pairs(question, passage) with rerank_score; the model gets all passages of a question that an Arrow batch holds at once."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for questions, passages in batches:
            questions, passages = questions.fillna("").reset_index(drop=True), passages.fillna("").reset_index(drop=True)
            scores = np.empty(len(questions))
            for question, at in questions.groupby(questions, sort=False).indices.items():
                scores[at] = model.score(question, list(passages.iloc[at]))
            yield pd.Series(scores)

    return pairs.withColumn("rerank_score", run("question", "passage"))


def generate(prompts: DataFrame, make: Callable[[], Provider] | dict[str, Callable[[], Provider]]) -> DataFrame:
    """prompts(qid, system, user[, profile]) with reply; a call that fails gives a null reply and its error.

    make: what makes the model, or, for each profile that a prompt may name, what makes its own; a
    task makes each model that it needs once.
    """
    several = isinstance(make, dict)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Provider] = {}
        for b in batches:
            rows = []
            for q, s, u, name in zip(b["qid"], b["system"], b["user"], b["profile"] if several else [""] * len(b)):
                try:
                    if name not in made:
                        made[name] = (make[name] if several else make)()
                    rows.append((q, made[name].generate([{"role": "system", "content": s}, {"role": "user", "content": u}]), None))
                except Exception as e:  # the batch goes on
                    rows.append((q, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["qid", "reply", "error"])

    given = prompts.select("qid", "system", "user", *(["profile"] if several else []))
    return given.mapInPandas(run, f"qid {prompts.schema['qid'].dataType.simpleString()}, reply string, error string")


class HashEmbedder:
    """Stand-in: signed hashed words, to unit length."""

    def __init__(self, width: int = 64):
        self.width = width

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                out[i, h % self.width] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]


class WordReranker:
    """Stand-in: the share of the question's words that a passage holds."""

    def score(self, question: str, passages: list[str]) -> list[float]:
        asked = set(question.lower().split())
        return [len(asked & set(p.lower().split())) / max(1, len(asked)) for p in passages]


class EchoProvider:
    """Stand-in: the first source's first sentence, cited."""

    def generate(self, messages: list[dict]) -> str:
        return messages[-1]["content"].split(".")[0].strip() + " [1]."


def word_score(question: Column, passage: Column) -> Column:
    """WordReranker as a built-in expression."""
    asked = F.array_distinct(F.filter(F.split(F.lower(question), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(asked, F.split(F.lower(passage), r"\s+"))) / F.greatest(F.size(asked), F.lit(1))
