"""Filtered dense, sparse and fused search over batches of questions. The access filter is always below the ranking."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from corpusloom.functions import tables

# Fixed values.
MODES = ("hybrid", "dense", "sparse")
CANDIDATES, PREFETCH, RERANK_TOP = 30, 50, 20
FRONT_MATTER_FACTOR = 0.8
#: The constant of reciprocal rank fusion, as in the paper that introduced it.
RRF = 60
#: Points of a shard (dense, sparse), questions of a block (sparse, dense), questions of one matrix product, and bytes of a shard before its last batch.
SHARD, SPARSE_SHARD, BLOCK, DENSE_BLOCK, AT_ONCE, SHARD_BYTES = 50_000, 10_000, 4_096, 4_096, 32, 16_000_000
#: Sparse search: points of the first round, asked tokens that are numbered, bands of norms to a doubling, and what rounding may take from a bound.
FIRST, ASKED, BANDS, ROUNDING = 5_000, 1_000_000, 4, 1e-9
#: What access() reads of a point.
ACCESS = ["allowed_groups", "is_latest", "release_min", "release_max", "category"]


def may_see(allowed: Column, groups: Column) -> Column:
    """Whether a document's groups and a user's (with 'all') meet; no answer counts as no."""
    return F.coalesce(F.arrays_overlap(allowed, F.array_union(groups, F.array(F.lit("all")))), F.lit(False))


def access(p: str = "", r: str = "") -> Column:
    """The filter of a request's columns (groups, release, category) on a point's, prefixes p and r."""
    c = lambda pre, name: F.col(pre + name)
    return (
        c(p, "is_latest")
        & may_see(c(p, "allowed_groups"), c(r, "groups"))
        & (c(r, "release").isNull() | ((c(p, "release_min") <= c(r, "release")) & (c(p, "release_max") >= c(r, "release"))))
        & (c(r, "category").isNull() | (c(p, "category") == c(r, "category")))
    )


def top(scored: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """The `limit` best of each question, ties to the smaller chunk_id."""
    w = Window.partitionBy("qid").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _hit_schema(points: DataFrame, requests: DataFrame) -> tuple[str, dict]:
    """The schema of hits, for Spark and for Arrow."""
    kinds = {c: df.schema[c].dataType for c, df in (("qid", requests), ("chunk_id", points))}
    return ", ".join(f"{c} {t.simpleString()}" for c, t in kinds.items()) + ", score double", {c: to_arrow_type(t) for c, t in kinds.items()}


def _parts(rows: DataFrame, size: int) -> int:
    return max(1, -(-rows.count() // size))


def _shown(points: DataFrame, requests: DataFrame) -> DataFrame:
    """Points that the groups of at least one request open; the others need not be dealt. The groups of a batch are few."""
    everyone = requests.agg(F.flatten(F.collect_set("groups"))).scalar()
    return points.where(F.col("is_latest") & may_see(F.col("allowed_groups"), everyone))


def _sliced(rows: DataFrame, most: int) -> DataFrame:
    """rows as arrays `p` of at most `most` of them and about SHARD_BYTES, a row each, of one band where they have bands. They are cut where they lie, nothing is shuffled."""
    tables.bounded_batches(rows.sparkSession)
    banded = "band" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def shard() -> pa.RecordBatch:
            (all_of,) = pa.Table.from_batches(held).combine_chunks().to_batches()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(all_of)], pa.int32()), all_of.to_struct_array())], ["p"])

        for b in batches:
            bands = b["band"].to_numpy() if banded else np.zeros(len(b), int)
            i = 0
            while i < len(b):
                room = most - sum(map(len, held))
                if held and (bands[i] != last or room <= 0 or sum(x.nbytes for x in held) >= SHARD_BYTES):
                    yield shard()
                    room = most
                last = bands[i]
                other = np.flatnonzero(bands[i : i + room] != last)
                held.append(b.slice(i, other[0] if len(other) else room))
                i += len(held[-1])
        if held:
            yield shard()

    return rows.mapInArrow(run, f"p array<{rows.schema.simpleString()}>")


def _crossed(points: DataFrame, most: int, asks: DataFrame, size: int, best: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What best(points, asks) finds for each shard of at most `most` points and each block of about `size` asks.

    Every pair of a shard and a block is read where both lie: no point is shuffled, however many blocks there are, and each
    ask is shuffled once, into its block. Blocks are written down. Points lie in at most two parts for each core, as
    every part has its own best of a question to hand on.
    """
    width = 2 * points.sparkSession.sparkContext.defaultParallelism
    blocks = _parts(asks, size)
    dealt = asks.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)))
    packed = tables.cut(dealt.groupBy("block").agg(F.collect_list(F.struct(*asks.columns)).alias("r")).select("r")).coalesce(blocks)

    def rows(lists: pa.Array, i: int) -> pa.Table:
        return pa.Table.from_batches([pa.RecordBatch.from_struct_array(lists.slice(i, 1).flatten())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                yield from best(rows(b["p"], i), rows(b["r"], i)).combine_chunks().to_batches()

    return _sliced(points.coalesce(width), most).hint("shuffle_replicate_nl").crossJoin(packed).mapInArrow(run, schema)


def _seen_by(points: pd.DataFrame) -> Callable[..., np.ndarray]:
    """A function of a request's groups, release and category: which of these points access() lets it see."""
    latest, category = points["is_latest"].to_numpy(bool, na_value=False), points["category"].to_numpy()
    low, high = (points[c].to_numpy(float, na_value=np.nan) for c in ("release_min", "release_max"))

    @functools.cache
    def shared(who: frozenset) -> np.ndarray:
        return latest & np.fromiter((g is not None and not who.isdisjoint(g) for g in points["allowed_groups"]), bool, len(points))

    def seen(groups, release, wanted) -> np.ndarray:
        if groups is None:
            return np.zeros(len(points), bool)
        ok = shared(frozenset({*groups, "all"}))
        if not pd.isna(release):
            ok = ok & (low <= release) & (high >= release)
        return ok if pd.isna(wanted) else ok & (category == wanted)

    return seen


def _best(ids: np.ndarray, score: np.ndarray, ok: np.ndarray, limit: int) -> np.ndarray:
    """Places of the `limit` highest scores where ok, ties to the smaller id; only what reaches the last of them is sorted."""
    at = np.flatnonzero(ok)
    if len(at) > limit:
        at = at[score[at] >= np.partition(score[at], -limit)[-limit]]
    return at[np.lexsort((ids[at], -score[at]))][:limit]


def _hits(kinds: dict, rows: list[tuple]) -> pa.Table:
    """(qid, ids, scores) of each question as a table of hits."""
    some = [pa.table({"qid": pa.array([q] * len(ids), kinds["qid"]), "chunk_id": pa.array(ids, kinds["chunk_id"]), "score": pa.array(score, pa.float64())}) for q, ids, score in rows]
    return pa.concat_tables(some) if some else pa.schema([("qid", kinds["qid"]), ("chunk_id", kinds["chunk_id"]), ("score", pa.float64())]).empty_table()


def _packed(rows: DataFrame, by: str, weight: str) -> DataFrame:
    """by, tokens, weights and norm of rows(by, token, weight) or rows(by, tokens, weights), a row each.

    The norm bounds a score: no sum of products is above the product of two norms. It is the Euclidean
    one, or where a token is repeated the sum of the weights, which is never less than that of the merged tokens.
    """
    if "tokens" in rows.columns:
        made = rows.groupBy(by).agg(F.collect_list(F.struct("tokens", F.col("weights").cast("array<double>").alias("w"))).alias("t"))
        made = made.select(by, F.flatten("t.tokens").alias("tokens"), F.flatten("t.w").alias("weights"))
    else:
        made = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("token", F.col(weight).cast("double").alias("w")))).alias("t"))
        made = made.select(by, F.col("t.token").alias("tokens"), F.col("t.w").alias("weights"))
    add = lambda f: F.aggregate("weights", F.lit(0.0), lambda s, w: s + f(w))
    return made.withColumn("norm", F.when(F.size(F.array_distinct("tokens")) == F.size("tokens"), F.sqrt(add(lambda w: w * w))).otherwise(add(F.abs)))


def _numbered(rows: DataFrame, words: pa.Array) -> DataFrame:
    """rows(.., token, ..) or rows(.., tokens, weights) with each token's place in words instead; rows, or items of lists, of other tokens are left out."""
    if "token" in rows.columns:
        places = rows.sparkSession.createDataFrame(pa.table({"token": words, "_place": pa.array(np.arange(len(words)), pa.int32())}))
        return rows.join(F.broadcast(places), "token").withColumn("token", F.col("_place")).select(rows.columns)
    by = next(c for c in rows.columns if c not in ("tokens", "weights"))
    kind = rows.schema[by].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b["tokens"].flatten()
            place = pc.index_in(asked, value_set=words.cast(asked.type))
            known = pc.is_valid(place)
            of = np.repeat(np.arange(len(b)), pc.fill_null(b["tokens"].value_lengths(), 0).to_numpy())
            ends = pa.array(np.append(0, np.cumsum(np.bincount(of[known.to_numpy(zero_copy_only=False)], minlength=len(b)))), pa.int32())
            lists = (pa.ListArray.from_arrays(ends, x.filter(known)) for x in (place, b["weights"].flatten()))
            yield pa.RecordBatch.from_arrays([b[by], *lists], [by, "tokens", "weights"])

    tables.bounded_batches(rows.sparkSession)
    return rows.select(by, "tokens", F.col("weights").cast("array<double>")).mapInArrow(run, f"{by} {kind.simpleString()}, tokens array<int>, weights array<double>")


def _asking(asks: DataFrame, plan: list[tuple]) -> DataFrame:
    """asks once for every shard of the bands that may hold one of a question's best: those whose norms reach its `least`."""
    few = asks.sparkSession.createDataFrame(plan, "band int, most double, shards int, blocks int")
    made = asks.join(F.broadcast(few), F.col("least").isNull() | (F.col("norm") * F.col("most") * (1 + ROUNDING) >= F.col("least")))
    made = made.withColumn("block", F.pmod(F.xxhash64("qid"), "blocks").cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    return made.drop("most", "shards", "blocks", "norm", "least")


def sparse(postings: DataFrame, points: DataFrame, terms: DataFrame, requests: DataFrame, limit: int = PREFETCH) -> DataFrame:
    """qid, chunk_id, score, rank: sums of weight products over shared tokens, of points the request may see.

    postings(chunk_id, token, weight), or term_lists(chunk_id, tokens, weights), in which nothing is null; terms(qid, token,
    qweight); null tokens and weights count as absent. Tokens that are asked are numbered before anything is shuffled and the
    others left out; only if more than ASKED are, tokens stay as they are. Points lie
    in bands of like norms, bands in shards, questions in blocks, shards and blocks of bounded size. All
    questions first meet the bands of the highest norms; a question's `limit`-th score there is the least that one of
    its best can have, and it then meets only shards whose norms allow so much. A task adds up one question's postings
    at a time, leaves out forbidden points and hands on its `limit` best, if they reach that least, so (question, point) pairs are
    neither built nor shuffled. Packed postings, blocks of questions and the first round's hits are written down.
    """
    spark = points.sparkSession
    terms = tables.cut(terms.where("token is not null and qweight is not null"))
    held = postings.where("token is not null and weight is not null") if "token" in postings.columns else postings
    words = terms.select("token").distinct().limit(ASKED + 1).toArrow()["token"].combine_chunks()
    if len(words) <= ASKED:
        words = words.take(pc.sort_indices(words))
        held, terms = _numbered(held, words), _numbered(terms, words)
    at = tables.shared_folder(spark, "postings")
    # merged, as the postings lie by chunk_id already: a broadcast of either side would grow with the corpus
    packed = _packed(held, "chunk_id", "weight").join(points.select("chunk_id", *ACCESS).hint("merge"), "chunk_id")
    log = F.least(F.greatest(F.log2("norm"), F.lit(-2000.0)), F.lit(2000.0))
    packed = packed.withColumn("band", F.floor(BANDS * log).cast("int"))
    packed.write.partitionBy("band").parquet(at)
    held = _shown(spark.read.schema(packed.schema).parquet(at), requests)
    asks = _packed(terms, "qid", "qweight").join(requests.where("groups is not null").select("qid", "groups", "release", "category"), "qid")
    # a row a band, of which there are as many as the logarithm of the norms
    bands = held.groupBy("band").agg(F.max("norm"), F.count("*")).orderBy(F.desc("band")).collect()
    first = [b for (b, _, _), n in zip(bands, accumulate((r[2] for r in bands), initial=0)) if n < FIRST]
    schema, kinds = _hit_schema(points, requests)

    def best(p: pa.Table, r: pa.Table) -> pa.Table:
        if not len(p) or not len(r):
            return _hits(kinds, [])
        least, most = r["least"].to_numpy(), p["norm"].to_numpy().max()
        r = r.filter(pa.array(~(r["norm"].to_numpy() * most * (1 + ROUNDING) < least)))
        if not len(r):
            return _hits(kinds, [])
        ids, seen = p["chunk_id"].to_numpy(), _seen_by(p.select(ACCESS).to_pandas())
        lists = p["tokens"].combine_chunks()
        words = lists.flatten().dictionary_encode()
        of, code = np.repeat(np.arange(len(p)), lists.value_lengths().to_numpy()), words.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        of, weight = of[order], p["weights"].combine_chunks().flatten().to_numpy()[order]
        ends = np.append(0, np.cumsum(np.bincount(code, minlength=len(words.dictionary))))
        rows = []
        asked = r["tokens"].combine_chunks()  # of all questions at once: the shard's words are hashed for each lookup
        places = pc.fill_null(pc.index_in(asked.flatten(), value_set=words.dictionary), -1).to_numpy(zero_copy_only=False)
        given = r["weights"].combine_chunks().flatten().to_numpy()
        upto = np.cumsum(asked.value_lengths().to_numpy())
        for q, found, qweight in zip(r.select(["qid", "groups", "release", "category", "least"]).to_pylist(), np.split(places, upto[:-1]), np.split(given, upto[:-1])):
            known = found >= 0
            word = found[known].astype(int)
            n = ends[word + 1] - ends[word]
            at = np.repeat(ends[word] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum()) if len(word) else np.empty(0, int)
            score = np.bincount(of[at], weight[at] * np.repeat(qweight[known], n), len(p))
            ok = np.zeros(len(p), bool)
            ok[of[at]] = True
            if q["least"] is not None:
                ok &= ~(score < q["least"])
            pick = _best(ids, score, ok & seen(q["groups"], q["release"], q["category"]), limit)
            rows.append((q["qid"], ids[pick], score[pick]))
        return _hits(kinds, rows)

    def met(some: list[int], asks: DataFrame) -> DataFrame:
        near = held.where(F.array_contains(F.array(*map(F.lit, some)).cast("array<int>"), F.col("band")))
        return top(_crossed(near, SPARSE_SHARD, asks, BLOCK, best, schema), limit)

    hits = tables.cut(met(first, asks.withColumn("least", F.lit(None).cast("double"))))
    asks = asks.join(hits.where(F.col("rank") == limit).groupBy("qid").agg(F.max("score").alias("least")), "qid", "left")
    rest = [(b, most, 1, 1) for b, most, _ in bands[len(first) :]]
    reached = [r.band for r in _asking(asks.drop("tokens", "weights"), rest).select("band").distinct().collect()] if rest else []
    return top(hits.drop("rank").unionByName(met(reached, asks).drop("rank")), limit)


def dense(points: DataFrame, requests: DataFrame, limit: int = PREFETCH) -> DataFrame:
    """qid, chunk_id, score, rank: highest dot products of unit vectors, of points the request may see.

    points(chunk_id, vector, metadata), requests(qid, vector, groups, release, category). Points are
    cut into shards where they lie and questions dealt to blocks, both of bounded size; a shard meets a few questions of
    a block in one matrix product, and forbidden points are left out before the best are taken. Points without a
    vector are found by sparse search only.
    """
    points = points.where(F.col("vector").isNotNull())
    vector = F.col("vector").cast("array<double>").alias("vector")
    held, asks = _shown(points, requests).select("chunk_id", vector, *ACCESS), requests.select("qid", vector, "groups", "release", "category")
    schema, kinds = _hit_schema(points, requests)

    def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
        flat = vectors.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)

    def best(p: pa.Table, r: pa.Table) -> pa.Table:
        if not len(p) or not len(r):
            return _hits(kinds, [])
        ids, x, seen = p["chunk_id"].to_numpy(), matrix(p["vector"]), _seen_by(p.select(ACCESS).to_pandas())
        rows = []
        for i in range(0, len(r), AT_ONCE):
            some = r.slice(i, AT_ONCE)
            scores = np.round(matrix(some["vector"]) @ x.T, 12)
            for q, score in zip(some.select(["qid", "groups", "release", "category"]).to_pylist(), scores):
                pick = _best(ids, score, seen(q["groups"], q["release"], q["category"]), limit)
                rows.append((q["qid"], ids[pick], score[pick]))
        return _hits(kinds, rows)

    return top(_crossed(held, SHARD, asks, DENSE_BLOCK, best, schema), limit)


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, limit: int = CANDIDATES, k: int = RRF) -> DataFrame:
    """qid, chunk_id, score, rank: reciprocal rank fusion of two ranked lists."""
    part = lambda c: F.coalesce(1.0 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    both = dense_hits.select("qid", "chunk_id", F.col("rank").alias("_d")).join(sparse_hits.select("qid", "chunk_id", F.col("rank").alias("_s")), ["qid", "chunk_id"], "full_outer")
    return top(both.select("qid", "chunk_id", (part("_d") + part("_s")).alias("score")), limit)


def search(mode: str, points: DataFrame, postings: DataFrame, terms: DataFrame, requests: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode == "dense":
        return dense(points, requests, limit)
    if mode == "sparse":
        return sparse(postings, points, terms, requests, limit)
    return fuse(dense(points, requests, PREFETCH), sparse(postings, points, terms, requests, PREFETCH), limit)


def term_counts(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """id, token, weight: the stand-in sparse embedding, counts of lower-case alphanumeric tokens."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0)
    return docs.select(id, F.explode(found).alias("token")).groupBy(id, "token").agg(F.count("*").cast("double").alias("weight"))


def term_lists(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """id, tokens, weights: term_counts of each text as one row, counted where the text is read; nothing is shuffled."""
    kind = docs.schema[id].dataType
    tables.bounded_batches(docs.sparkSession)
    arrow = pa.schema([(id, to_arrow_type(kind)), ("tokens", pa.list_(pa.string())), ("weights", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = re.compile("[a-z0-9]+").findall
        for b in batches:
            counts = [Counter(found(x)) for x in b.column(1).to_pylist()]
            ends = pa.array(np.append(0, np.cumsum([len(c) for c in counts])), pa.int32())
            tokens, weights = pa.array(chain.from_iterable(counts), pa.string()), pa.array(chain.from_iterable(c.values() for c in counts), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, tokens), pa.ListArray.from_arrays(ends, weights)], schema=arrow)

    lower = docs.where("text is not null").select(id, F.lower("text").alias("text"))
    return lower.mapInArrow(run, f"{id} {kind.simpleString()}, tokens array<string>, weights array<double>")


def is_front_matter(header: Column) -> Column:
    return F.trim(F.element_at(F.split(header, " > "), -1)).rlike(r"(?i)^(?:0\s+)?executive\s+summary\b")


def rerank(candidates: DataFrame, limit: int | None = RERANK_TOP) -> DataFrame:
    """candidates(qid, rank, rerank_score) with new_rank: the first `limit` by score, ties and the rest by rank.

    Scores beyond the limit are not looked at and come back null.
    """
    scored = candidates.withColumn("rerank_score", F.when(F.lit(limit is None) | (F.col("rank") <= F.lit(limit or 0)), F.col("rerank_score")))
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last("rerank_score"), "rank")))


def demote_front_matter(ranked: DataFrame, factor: float = FRONT_MATTER_FACTOR) -> DataFrame:
    """ranked(qid, rank, header, rerank_score) with order_rank: executive summaries as if they scored less; unscored ones last."""
    key = F.col("rerank_score") * F.when(is_front_matter(F.col("header")), factor).otherwise(1.0)
    return ranked.withColumn("order_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc_nulls_last(key), "rank")))


def best_of_sides(candidates: DataFrame) -> DataFrame:
    """Each chunk's best row over a question's sides, reranked ones first, then by score, then as first seen."""
    c = candidates.withColumn("_best", F.coalesce("rerank_score", "score"))
    one = Window.partitionBy("qid", "chunk_id").orderBy(F.desc("_best"), "seen")
    order = Window.partitionBy("qid").orderBy(F.desc(F.col("rerank_score").isNotNull()), F.desc("_best"), "_seen")
    first = c.withColumn("_seen", F.min("seen").over(Window.partitionBy("qid", "chunk_id"))).withColumn("_i", F.row_number().over(one)).where("_i = 1")
    return first.withColumn("rank", F.row_number().over(order)).drop("_best", "_i", "_seen")
