"""Exact top-k by inner product: a KD-tree for each shard, searched best box first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, frugal
from .vectors import distinct, finite, matrix

K = 10
SCALE = 1024
QUERY_EVERY = 100
#: Vectors of a shard and of a leaf, queries of a block, blocks that one task holds at once (means; all are bounded).
SHARD, LEAF, BLOCK, BLOCKS = 8_192, 64, 256, 32
#: Space is cut into at most so many cells, at medians of at most so many vectors; every vector is dealt to its cell.
CELLS, SAMPLE = 1_024, 16_384
_TREE = "shard long, cell int, " + ", ".join(f"{c} binary" for c in ("ids", "x", "begin", "end", "left", "right", "low", "high"))
_HITS = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class Tree:
    """ids and x: rows, those of a node side by side from begin to end; left, right: its children, -1 in a leaf; low, high: its tight box.

    Node 0 is the root.
    """

    ids: np.ndarray
    x: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
    """Each node is split at the median of its widest side until it has at most `leaf` rows."""
    order = np.arange(len(ids))
    nodes, todo = [[0, len(ids), -1, -1]], [0]
    boxes = {}
    while todo:
        node = todo.pop()
        a, b = nodes[node][:2]
        part = x[order[a:b]]
        boxes[node] = part.min(0), part.max(0)
        wide = boxes[node][1] - boxes[node][0]
        side = int(np.argmax(wide))
        if b - a <= leaf or wide[side] == 0:
            continue
        mid = (b - a) // 2
        order[a:b] = order[a:b][np.argpartition(part[:, side], mid)]
        nodes[node][2:] = len(nodes), len(nodes) + 1
        todo += nodes[node][2:]
        nodes += [[a, a + mid, -1, -1], [a + mid, b, -1, -1]]
    begin, end, left, right = np.array(nodes, np.int64).T.copy()
    low, high = (np.array([boxes[i][j] for i in range(len(nodes))], np.int64) for j in (0, 1))
    return Tree(ids[order], x[order], begin, end, left, right, low, high)


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest inner product of each row of q with a point of the box beside it; rounded, and never in another order."""
    return (np.maximum(q, 0) * high + np.minimum(q, 0) * low).sum(1).astype(float)


def search(tree: Tree, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's position, vec_id, score) of each query's k best in one tree, ties to the smaller id.

    Best first: each query holds the nodes that are open for it, and in each round takes the one
    whose box has the highest bound on its inner product. An inner node is replaced by its children, a leaf
    is scored. A query ends when its best bound is below its kth score so far. floor: a kth score
    known from elsewhere. A row with the query's own id is left out. All queries go round by round.
    """
    x, low, high = tree.x, tree.low, tree.high
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1]
    if most < 2**53:  # exact in doubles
        q, x, low, high = (z.astype(np.float64) for z in (q, x, low, high))
    elif most >= 2**63:
        q, x, low, high = (z.astype(object) for z in (q, x, low, high))
    n = len(q)
    kth = np.full(n, -np.inf) if floor is None else floor.astype(float)
    open_ = np.full((n, len(tree.begin)), -np.inf)
    open_[:, 0] = _bounds(q, low[:1], high[:1])
    at, to, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, q.dtype)
    active = np.arange(n)
    while len(active):
        node = open_[active].argmax(1)
        bound = open_[active, node]
        goes_on = (bound >= kth[active]) & (bound > -np.inf)
        active, node = active[goes_on], node[goes_on]
        open_[active, node] = -np.inf
        inner = tree.left[node] >= 0
        for child in (tree.left, tree.right):
            c, who = child[node[inner]], active[inner]
            open_[who, c] = _bounds(q[who], low[c], high[c])
        found = [(at, to, score)]
        for leaf in np.unique(node[~inner]):
            mine = active[node == leaf]
            rows = slice(tree.begin[leaf], tree.end[leaf])
            s = q[mine] @ x[rows].T
            i, j = np.nonzero((s >= kth[mine][:, None]) & (tree.ids[rows][None, :] != ids[mine][:, None]))
            found.append((mine[i], tree.ids[rows][j], s[i, j]))
        if len(found) == 1:
            continue
        at, to, score = (np.concatenate(z) for z in zip(*found))
        keep = np.lexsort((to, -score, at))
        at, to, score = at[keep], to[keep], score[keep]
        rank = np.arange(len(at)) - np.searchsorted(at, np.arange(n))[at]
        last = rank == k - 1
        kth[at[last]] = np.maximum(kth[at[last]], score[last].astype(float))
        at, to, score = at[rank < k], to[rank < k], score[rank < k]
    return at, to, score


@dataclass(frozen=True)
class Space:
    """Median splits in heap order: node i (from 1) cuts `side[i]` at `border[i]`, its children are 2i and 2i + 1."""

    side: np.ndarray
    border: np.ndarray

    @staticmethod
    def of(sample: np.ndarray, cells: int) -> Space:
        """At most `cells` cells, a power of two, with about as many rows of the sample each."""
        side, border = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        parts = {1: sample}
        for node in range(1, cells):
            part = parts.pop(node)
            if len(part):
                side[node] = np.argmax(part.max(0) - part.min(0))
                border[node] = np.partition(part[:, side[node]], len(part) // 2)[len(part) // 2]
            right = part[:, side[node]] >= border[node]
            parts |= {2 * node: part[~right], 2 * node + 1: part[right]}
        return Space(side, border)

    def cell(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.ones(len(x), np.int64), np.arange(len(x))
        for _ in range(len(self.side).bit_length() - 1):
            node = 2 * node + (x[rows, self.side[node]] >= self.border[node])
        return node - len(self.side)


def _settle(shared, width: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = shared.value.cell(matrix(b.column("v"), width, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(cell, pa.int32())], ["vec_id", "v", "cell"])

    return run


def _plant(width: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        tree = build(table["vec_id"].to_numpy(), matrix(table["v"], width, np.int64))
        made = {f.name: pa.array([np.ascontiguousarray(z).tobytes()], pa.binary()) for f, z in zip(fields(Tree), astuple(tree))}
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "cell": pa.array([table["cell"][0].as_py()], pa.int32()), **made})

    return run


def _read(row: pa.Table, width: int) -> Tree:
    get = lambda c: np.frombuffer(row[c][0].as_py(), np.int64)
    return Tree(*(get(f.name).reshape(-1, width) if f.name in ("x", "low", "high") else get(f.name) for f in fields(Tree)))


def _enclose(width: int):
    """The box around all trees of a cell, from their roots."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        root = lambda c, best: best([np.frombuffer(z, np.int64, width) for z in table[c].to_pylist()], 0).tobytes()
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "low": pa.array([root("low", np.min)], pa.binary()), "high": pa.array([root("high", np.max)], pa.binary()), "shards": pa.array([table.num_rows], pa.int64())})

    return run


def _route(shared, width: int, best_only: bool):
    """The cells a query goes to: the one with the highest bound, or all others whose bound reaches its kth score."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, low, high = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK):
                b = whole.slice(a, BLOCK)
                q = matrix(b.column("v"), width, np.int64).astype(float)
                bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                if best_only:
                    goes = np.zeros(bound.shape, bool)
                    goes[np.arange(len(q)), bound.argmax(1)] = True
                else:  # doubles round these sums: what is as good as equal goes too
                    goes = bound + np.abs(bound) * 1e-12 >= b.column("kth").to_numpy(zero_copy_only=False)[:, None]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([cells[g].tolist() for g in goes], pa.list_(pa.int32()))], [*b.schema.names, "cells"])

    return run


def _visit(width: int, k: int):
    """One shard's tree against the queries dealt to it, a block at a time."""

    def run(trees: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if trees.num_rows and queries.num_rows:
            tree = _read(trees, width)
            for a in range(0, queries.num_rows, BLOCK):
                some = queries.slice(a, BLOCK)
                at, to, score = search(tree, some["vec_id"].to_numpy(), matrix(some["v"], width, np.int64), k, some["kth"].to_numpy(zero_copy_only=False))
                out.append((some["vec_id"].to_numpy()[at], to, score.astype(np.int64)))
        q, to, score = (np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(to, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


def topk(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = QUERY_EVERY, shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k highest integer inner products.

    A component x counts as floor(scale * x). Queries are the ids divisible by `every`; candidates
    are all other ids; ties go to the smaller id. Median splits of a sample cut space into cells, and a
    cell's vectors are dealt to its shards. Each query first searches a shard of the cell
    with the highest bound; its kth score there is what it starts from elsewhere, and it goes only to cells
    whose box can reach that score. A task holds one shard's tree and a bounded number of queries, however many there are.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
    without an id. Every row is a candidate: equal rows are searched once and come back as often as
    they are there, and different vectors of one id are candidates each, so an id can be in a list
    several times; a query id has one list, the best of all its different vectors. A shorter
    vector ends in zeros. Fewer candidates than k give fewer rows; an empty table gives none. Scores beyond a long are an error.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    rows = scratch.keep(distinct(vectors, finite(F.col("embedding"))).where("v is not null").select("vec_id", whole.alias("v")), "rows")
    total = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
    if not total.n or not total.q:
        return spark.createDataFrame([], schema)
    width = total.w
    groups = -(-total.q // (BLOCK * BLOCKS))
    dealt = lambda m, *c: F.pmod(F.xxhash64(*c), m)
    picked = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").select("v").limit(SAMPLE).toArrow()  # bounded by SAMPLE
    space = Space.of(matrix(picked["v"], width, np.int64), 1 << min(CELLS.bit_length() - 1, (-(-total.n // shard) - 1).bit_length()))
    placed = scratch.keep(rows.mapInArrow(_settle(spark.sparkContext.broadcast(space), width), "vec_id long, v array<long>, cell int"), "placed")  # at most CELLS splits
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / shard).alias("pieces"))
    pieces = F.broadcast(scratch.keep(sizes, "sizes"))  # at most CELLS rows
    named = placed.join(pieces, "cell").withColumn("shard", F.col("cell").cast("long") * (1 << 32) + dealt(F.col("pieces"), "vec_id", "v"))
    trees = scratch.keep(named.select("shard", "cell", "vec_id", "v").groupBy("shard").applyInArrow(_plant(width), _TREE), "trees")
    boxes = trees.select("cell", "low", "high").groupBy("cell").applyInArrow(_enclose(width), "cell int, low binary, high binary, shards long").toArrow()  # at most CELLS rows
    sides = (np.array([np.frombuffer(z, np.int64) for z in boxes[c].to_pylist()], float) for c in ("low", "high"))
    shared = spark.sparkContext.broadcast((boxes["cell"].to_numpy(), *sides))
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("part", dealt(F.lit(groups), "vec_id", "v", F.lit(1)))

    def searched(routed: DataFrame, piece) -> DataFrame:
        """Hits of queries(.., cells) in the shards of their cells that `piece` names; trees go where a query waits for them."""
        sent = routed.withColumn("cell", F.explode("cells")).drop("cells").join(pieces, "cell").withColumn("piece", piece)
        sent = scratch.keep(sent.select("vec_id", "v", "kth", "part", (F.col("cell").cast("long") * (1 << 32) + F.col("piece")).alias("shard")), "sent")
        asked = trees.join(sent.select("shard", "part").distinct(), "shard").toDF(*trees.columns, "asked")
        return asked.groupBy("shard", "asked").cogroup(sent.groupBy("shard", "part")).applyInArrow(_visit(width, k), _HITS)

    kinds = "vec_id long, v array<long>, part long, kth double, cells array<int>"
    none = queries.withColumn("kth", F.lit(float("-inf")))
    first = searched(none.mapInArrow(_route(shared, width, True), kinds), dealt(F.col("pieces"), "vec_id"))
    # of all vectors of a query id: k hits of theirs are as high, so none below can be among its k best
    known = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("kth"))
    started = queries.join(known.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", "part", F.coalesce("kth", F.lit(float("-inf"))).alias("kth"))
    hits = searched(started.mapInArrow(_route(shared, width, False), kinds), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
    hits = _repeated(hits, vectors, rows, whole)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _repeated(hits: DataFrame, vectors: DataFrame, rows: DataFrame, whole: Column) -> DataFrame:
    """hits with those of repeated rows as often as these are there. Ids without repeats, in most tables all, are not touched."""
    usable = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    several = usable.groupBy("vec_id", F.xxhash64("v").alias("h")).agg(F.count("*").alias("n")).where("n > 1")
    ids = Scratch(vectors.sparkSession, "repeats").keep(several.select("vec_id").distinct(), "ids")
    if ids.isEmpty():
        return hits
    counted = usable.join(ids, "vec_id", "left_semi").groupBy("vec_id", "v").agg(F.count("*").alias("n")).select("vec_id", whole.alias("v"), "n")
    asked = hits.join(ids, "vec_id", "left_semi").select("query_id", "vec_id").distinct()
    queries = rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    both = asked.join(counted, "vec_id").join(queries, "query_id")
    products = F.zip_with("q", "v", lambda a, b: F.coalesce(a, F.lit(0)) * F.coalesce(b, F.lit(0)))
    again = both.select("query_id", "vec_id", F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x).alias("score"), "n")
    again = again.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("_i")).drop("_i")
    return hits.join(ids, "vec_id", "left_anti").select("query_id", "vec_id", "score").unionByName(again)


#: The same rows by brute force.
ORACLE_SQL = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) v FROM embeddings
              WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
     scored AS (SELECT q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT score
                FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
     ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
