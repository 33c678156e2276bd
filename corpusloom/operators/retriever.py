"""Retrieval as one plan for a batch of requests, and the run of configurations over golden questions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import tables
from corpusloom.operators import context, evaluation, search


class Config(NamedTuple):
    """How to search, and how many of the best candidates the reranker sees (None: no reranker)."""

    name: str
    mode: str = "hybrid"
    rerank_top: int | None = None


class Index(NamedTuple):
    """points(chunk_id, vector, metadata) and postings(chunk_id, token, weight), or those of a point in one row as search.term_lists has them."""

    points: DataFrame
    postings: DataFrame


#: candidates(qid, chunk_id, score, rank) with rerank_score, and with header where front matter is to be told.
Scorer = Callable[[DataFrame], DataFrame]


def ranked(hits: DataFrame, scorer: Scorer | None, top: int = search.RERANK_TOP) -> DataFrame:
    """hits(qid, chunk_id, score, rank) with rerank_score and order_rank.

    Only the first `top` of a question reach the scorer; the others follow in the order of the search. With a
    `header` from the scorer, front matter is demoted. Without a scorer the search's order stays.
    """
    if scorer is None:
        return hits.withColumns({"rerank_score": F.lit(None).cast("double"), "order_rank": F.col("rank")})
    scored = scorer(hits.where(F.col("rank") <= top))
    rest = hits.where(F.col("rank") > top).withColumn("rerank_score", F.lit(None).cast("double"))
    both = scored.unionByName(rest, allowMissingColumns=True)
    if "header" in scored.columns:
        return search.demote_front_matter(both.fillna("", ["header"])).drop("header")
    return search.rerank(both, None).withColumnRenamed("new_rank", "order_rank")


def retrieve(requests: DataFrame, terms: DataFrame, index: Index, sections: DataFrame, chunks: DataFrame, config: Config = Config("hybrid"), scorer: Scorer | None = None, candidates: int = search.CANDIDATES, min_score: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The ordered candidates and the context units of each request: search, rerank, assemble, all lazy.

    chunks(chunk_id, section_id, doc_id, chunk_index, text, token_count, page_start, page_end). min_score holds for
    reranked candidates only: without a scorer there is nothing to compare it with.
    """
    reranks = scorer if config.rerank_top is not None else None
    hits = search.search(config.mode, index.points, index.postings, terms, requests, candidates)
    order = ranked(hits, reranks, config.rerank_top or 0)
    placed = order.join(chunks.select("chunk_id", "section_id", "doc_id", "chunk_index"), "chunk_id")
    kinds = placed.select(F.col("qid").cast("string").alias("qid"), "order_rank", *(F.col(c).cast("string").alias(c) for c in ("chunk_id", "section_id", "doc_id")), "chunk_index", "rerank_score")
    return order, context.assemble(kinds, sections, chunks, min_score=min_score if reranks is not None else None)


def run(configs: tuple[Config, ...], requests: DataFrame, terms: DataFrame, index: Index, scorer: Scorer | None = None, candidates: int = search.CANDIDATES) -> DataFrame:
    """config, qid, chunk_id, rank: each question's candidates under each configuration.

    Each search runs once for all configurations that need it, and its hits are written down: a shorter list is the beginning of a longer one.
    """
    depth = max(search.PREFETCH, candidates)
    need = {c.mode for c in configs}
    if not need <= set(search.MODES):
        raise ValueError(f"mode must be one of {', '.join(search.MODES)}")
    found = {}
    if need & {"dense", "hybrid"}:
        found["dense"] = tables.cut(search.dense(index.points, requests, depth))
    if need & {"sparse", "hybrid"}:
        found["sparse"] = tables.cut(search.sparse(index.postings, index.points, terms, requests, depth))
    if "hybrid" in need:
        found["hybrid"] = search.fuse(*(found[m].where(F.col("rank") <= search.PREFETCH) for m in ("dense", "sparse")), candidates)
    made = (ranked(found[c.mode].where(F.col("rank") <= candidates), scorer if c.rerank_top is not None else None, c.rerank_top or 0).select(F.lit(c.name).alias("config"), "qid", "chunk_id", F.col("order_rank").alias("rank")) for c in configs)
    return reduce(DataFrame.unionByName, made)


def run_eval(configs: tuple[Config, ...], found: DataFrame, questions: DataFrame, sources: DataFrame) -> DataFrame:
    """A row a configuration: n, recall@1/5/10 and MRR of found(config, qid, rank, doc_id, page_start, page_end).

    questions(qid, qtype) and sources(qid, doc_id, first, last) are set beside each name of the short list of configurations, so a
    question without a hit counts under each of them.
    """
    each = F.explode(F.array(*(F.lit(c.name) for c in configs)))
    both = lambda df: df.withColumn("config", each).withColumn("qid", F.struct("config", "qid")).drop("config")
    hits = evaluation.first_hits(found.withColumn("qid", F.struct("config", "qid")).drop("config"), both(sources), both(questions))
    return evaluation.retrieval_summary(hits.withColumn("config", F.col("qid.config")), ["config"])
