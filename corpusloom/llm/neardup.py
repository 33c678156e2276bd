"""Embedding near-duplicates by an inverted multi-index: two codebooks, and cells visited from the nearest on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, frugal, give_back
from .components import components, forest
from .vectors import distinct, finite, matrix

COSINE = 0.9
#: Share of pairs at exactly the threshold that the traversal shall meet; nearer pairs are met more often.
RECALL = 0.97
#: The codebooks and the length of the traversal are fitted on at most so many vectors; every vector is indexed.
SAMPLE, PROBES = 16_384, 1_500
PER_CELL, LEAST_WORDS, MOST_WORDS = 48, 4, 1_024
#: Candidates and visitors that a task compares at once, if a row takes at most ROW_BYTES; of longer rows fewer.
CHUNK, VISITORS, ROW_BYTES = 4_096, 20_000, 1_024
#: Cosines, and so pairs, that a task holds at once, however many there are in a crowd of near copies.
PAIRS = 1 << 19
#: Bytes that are dealt out at once, and shares of a chunk that lie in one partition: the candidates are repeated there, which compresses.
DEALT_BYTES, TOGETHER = 16 << 20, 4
#: Vectors travel as bytes of the kind their components came in: nothing is lost, and floats take half of what doubles do.
_PLACED = "rep long, m long, v binary, home int, cells binary"
_DEALT = "chunk int, shelf int, part int, side int, rep long, m long, v binary, home int, cells binary"


def codebook(x: np.ndarray, words: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centres of `words` clusters by Lloyd's steps from a seeded choice of rows."""
    draw = np.random.default_rng(seed)
    centre = x[draw.choice(len(x), words, replace=len(x) < words)].copy()
    for _ in range(rounds):
        near = np.argmin(_square(x, centre), axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=words)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
    return centre


def _square(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)[None, :]


class MultiIndex:
    """The product grid of two codebooks; cell = word of the first half * words + word of the second."""

    def __init__(self, sample: np.ndarray, words: int, seed: int = 5):
        self.half = sample.shape[1] // 2
        self.words = words
        self.books = codebook(sample[:, : self.half], words, seed), codebook(sample[:, self.half :], words, seed + 1)

    def sides(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _square(x[:, : self.half], self.books[0]), _square(x[:, self.half :], self.books[1])

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.sides(x)
        return a.argmin(1) * self.words + b.argmin(1)

    def visits(self, x: np.ndarray, reach: int) -> np.ndarray:
        """Each row's `reach` nearest cells, from the nearest on (ties to the earlier pair of ranks).

        The multi-sequence order: the pair of ranks (i, j) comes after (i+1)(j+1)-1 others at least,
        so only pairs with (i+1)(j+1) <= reach can be among the first `reach`.
        """
        a, b = self.sides(x)
        oa, ob = np.argsort(a, 1, kind="stable"), np.argsort(b, 1, kind="stable")
        i, j = np.array([(i, j) for i in range(min(reach, self.words)) for j in range(min(reach // (i + 1), self.words))]).T
        total = np.take_along_axis(a, oa, 1)[:, i] + np.take_along_axis(b, ob, 1)[:, j]
        pick = np.argsort(total, 1, kind="stable")[:, :reach]
        return (np.take_along_axis(oa, i[pick], 1) * self.words + np.take_along_axis(ob, j[pick], 1)).astype(np.int32)

    def rank(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells are nearer to each row than the given one."""
        a, b = self.sides(x)
        rows = np.arange(len(x))
        to = a[rows, cell // self.words] + b[rows, cell % self.words]
        b = np.sort(b, 1)
        return np.array([np.searchsorted(b[r], to[r] - a[r] - 1e-9, "left").sum() for r in rows])

    def reach(self, probes: np.ndarray, cosine: float, recall: float, seed: int = 9) -> int:
        """The number of cells to visit so that either of two vectors at this cosine meets the other with this frequency.

        The partners are made: each probe turned by the threshold's angle in a random direction.
        """
        turn = np.random.default_rng(seed).standard_normal(probes.shape)
        turn -= (turn * probes).sum(1)[:, None] * probes
        turn /= np.linalg.norm(turn, axis=1)[:, None] + 1e-12
        partner = cosine * probes + (1 - cosine**2) ** 0.5 * turn
        need = np.minimum(self.rank(probes, self.home(partner)), self.rank(partner, self.home(probes)))
        return int(min(self.words**2, np.quantile(need, recall, method="higher") + 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _place(shared, width: int, reach: int, kind: type):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        step = max(1, min(1_024, PAIRS // reach))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                x = matrix(b.column("v"), width)
                cells = index.visits(_unit(x), reach)
                raw = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("m"), raw, pa.array(cells[:, 0], pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary())], ["rep", "m", "v", "home", "cells"])

    return run


def _tally(cells: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        homes, visits = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
        for b in batches:
            homes += np.bincount(b.column("home").to_numpy(), minlength=cells)
            for c in b.column("cells").to_pylist():
                visits[np.frombuffer(c, np.int32)] += 1
        some = np.flatnonzero(homes + visits)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(homes[some]), pa.array(visits[some])], ["cell", "homes", "visits"])

    return run


class Chunks:
    """Cells dealt to chunks of at most about CHUNK candidates: neighbours share one, a larger cell has several.

    first[cell] and pieces[cell] name a cell's chunks; parts[chunk] is into how many shares its visitors go.
    row: a row's bytes; of rows over ROW_BYTES a chunk and a share have fewer.
    """

    def __init__(self, homes: np.ndarray, visits: np.ndarray, row: int = ROW_BYTES):
        most, visitors = (max(1, n * ROW_BYTES // max(row, ROW_BYTES)) for n in (CHUNK, VISITORS))
        self.first, self.pieces = np.zeros(len(homes), np.int64), np.ones(len(homes), np.int64)
        now, held, chunk_visits = 0, 0, [0]
        for cell, n in enumerate(homes.tolist()):
            if held and held + n > most:
                now, held = now + 1, 0
                chunk_visits.append(0)
            self.first[cell] = now
            if n > most:
                self.pieces[cell] = -(-n // most)
                chunk_visits[now] += int(visits[cell])
                chunk_visits += [int(visits[cell])] * (int(self.pieces[cell]) - 1) + [0]
                now, held = now + int(self.pieces[cell]), 0
            else:
                held += n
                chunk_visits[now] += int(visits[cell])
        self.parts = np.maximum(1, -(-np.array(chunk_visits) // visitors))


def _deal(shared, row_bytes: int, reach: int, together: int):
    """A row for each chunk and share a vector goes to: as a candidate (side 0) or as a visitor (side 1). Shelf: of so many shares."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = shared.value
        step = max(1, min(512, DEALT_BYTES // (row_bytes * (reach + int(chunks.parts.max())))))
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                reps, homes = b.column("rep").to_numpy(), b.column("home").to_numpy()
                spread = (reps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                out = []
                for i, (cells, home) in enumerate(zip(b.column("cells").to_pylist(), homes.tolist())):
                    s, mine = int(spread[i]), np.sort(np.frombuffer(cells, np.int32))
                    at_home = int(chunks.first[home] + s % chunks.pieces[home])
                    out += [(at_home, p, 0, i, cells) for p in range(int(chunks.parts[at_home]))]
                    first = chunks.first[mine]
                    for c in np.unique(first).tolist():
                        here = mine[first == c]
                        told = here.tobytes()
                        out += [(t, s % int(chunks.parts[t]), 1, i, told) for t in range(c, c + int(chunks.pieces[here].max()))]
                chunk, part, side, row, told = zip(*out)
                row = pa.array(row, pa.int64())
                take = lambda c: b.column(c).take(row)  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), pa.array(np.array(part, np.int32) // together), pa.array(part, pa.int32()), pa.array(side, pa.int32()), take("rep"), take("m"), take("v"), take("home"), pa.array(told, pa.binary())], ["chunk", "shelf", "part", "side", "rep", "m", "v", "home", "cells"])

    return run


def _joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column's rows, one after the other, and how many each has."""
    whole = column.combine_chunks().cast(pa.binary())
    ends = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _compare(width: int, cosine: float, kind: type):
    """What one chunk's candidates and one share of its visitors link: numbers of links, and a forest of them.

    A pair is met when either visits the other's cell. The visitor counts it for itself; for the
    candidate it counts it only if the candidate does not visit the visitor's cell, so each end gets it once.

    A crowd of near copies has pairs with the square of its size. They are counted and joined in blocks
    of at most PAIRS and forgotten, so memory follows the rows alone. Floats tell every cosine but those
    as near to the threshold as they may be off; these are taken in doubles.
    """
    slack = max(1e-4, (width + 4) * 2.0**-24)

    def run(table: pa.Table) -> pa.Table:
        side, rep, m, home = (table[c].to_numpy() for c in ("side", "rep", "m", "home"))
        x = _joined(table["v"])[0].view(kind).reshape(-1, width)
        small, norm = np.empty(x.shape, np.float32), np.empty(len(x))
        for at in range(0, len(x), 1_024):
            some = x[at : at + 1_024].astype(float)
            small[at : at + 1_024], norm[at : at + 1_024] = _unit(some), np.linalg.norm(some, axis=1)
        cells, size = _joined(table["cells"])
        cells, size = cells.view(np.int32), size // 4
        start = np.cumsum(size) - size
        nodes, node = np.unique(rep, return_inverse=True)
        links, root = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        visiting = np.repeat(side == 1, size)
        to, who = cells[visiting], np.repeat(np.arange(len(x), dtype=np.int32), size)[visiting]
        order = np.argsort(to, kind="stable")
        to, who = to[order], who[order]
        mine = np.flatnonzero(side == 0)
        mine = mine[np.argsort(home[mine], kind="stable")]
        here, at = np.unique(home[mine], return_index=True)
        for cell, u in zip(here.tolist(), np.split(mine, at[1:])):
            v = who[np.searchsorted(to, cell) : np.searchsorted(to, cell, "right")]
            goer = np.repeat(np.arange(len(u)), size[u])
            goes = cells[np.arange(len(goer)) + np.repeat(start[u] - (np.cumsum(size[u]) - size[u]), size[u])]
            step = max(1, PAIRS // len(u))
            for s in range(0, len(v), step):
                some = v[s : s + step]
                near = small[some] @ small[u].T
                i, j = np.nonzero(near >= cosine - slack)
                yes = node[some[i]] != node[u[j]]
                unsure = np.flatnonzero(yes & (near[i, j] < cosine + slack))
                for t in range(0, len(unsure), max(1, PAIRS // width)):
                    k = unsure[t : t + max(1, PAIRS // width)]
                    p, q = some[i[k]], u[j[k]]
                    yes[k] = np.einsum("ij,ij->i", x[p].astype(float), x[q].astype(float)) / (norm[p] * norm[q]) >= cosine
                i, j = i[yes], j[yes]
                if not len(i):
                    continue
                p, q = some[i], u[j]
                np.add.at(links, node[p], m[q])
                homes, h = np.unique(home[p], return_inverse=True)
                back = np.ones((len(u), len(homes)), bool)
                k = np.minimum(np.searchsorted(homes, goes), len(homes) - 1)
                met = homes[k] == goes
                back[goer[met], k[met]] = False
                back = back[j, h]
                np.add.at(links, node[q[back]], m[p[back]])
                a, b = root[node[p]], root[node[q]]
                if (a != b).any():
                    now = np.arange(len(nodes))
                    a, b = forest(a[a != b], b[a != b])
                    now[a] = b
                    root = now[root]
        some, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(nodes)))
        none = np.zeros(len(some) + len(moved), np.int64)
        out = pa.table({"a": np.concatenate([nodes[some], nodes[moved]]), "b": np.concatenate([none[: len(some)], nodes[root[moved]]]), "n": np.concatenate([links[some], none[len(some) :]])})
        give_back()
        return out

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id (smallest id reachable by links), kept (vec_id = component_id).

    Copies of one vector become one class first. Classes are placed in the product grid of two
    codebooks, visit their nearest cells, and what they meet there is compared in doubles: no link
    is below the threshold. Each comparison gives counts and a spanning forest, never all pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing
    and come back alone. Equal rows count once; different vectors of one id are rows of their own,
    and come back as such. A shorter vector ends in zeros; rows without an id are left out. An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neardup")
    zero = F.forall("embedding", lambda x: x == 0)
    rows = scratch.keep(distinct(vectors, finite(F.col("embedding")) & ~F.coalesce(zero, F.lit(True))), "rows")
    fine = rows.where("v is not null")
    # an id can be the smallest of several classes, so classes are told apart by a number
    classes = scratch.keep(fine.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("m")).select(F.monotonically_increasing_id().alias("rep"), "least", "m", "v"), "classes")
    n, width = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return alone
    width = max(2, width)
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    picked = classes.orderBy(F.xxhash64("least"), "least", "v").select("v").limit(SAMPLE).toArrow()  # bounded by SAMPLE
    sample = _unit(matrix(picked["v"], width))
    words = int(2 ** np.clip(np.round(np.log2(max(1.0, (n / PER_CELL) ** 0.5))), np.log2(LEAST_WORDS), np.log2(MOST_WORDS)))
    index = MultiIndex(sample, words)
    reach = index.reach(sample[:PROBES], cosine, recall)
    shared = spark.sparkContext.broadcast(index)  # two codebooks of at most MOST_WORDS rows
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // 20_000))
    placed = scratch.keep(classes.select("rep", "m", "v").repartition(tasks).mapInArrow(_place(shared, width, reach, kind), _PLACED), "placed")
    cells = words * words
    tally = placed.select("home", "cells").mapInArrow(_tally(cells), "cell int, homes long, visits long").groupBy("cell").agg(F.sum("homes"), F.sum("visits")).collect()  # at most MOST_WORDS squared rows
    homes, visits = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for cell, h, v in tally:
        homes[cell], visits[cell] = h, v
    row = width * np.dtype(kind).itemsize + 4 * reach
    chunks = Chunks(homes, visits, row)
    together = int(np.clip(chunks.parts.sum() // (4 * spark.sparkContext.defaultParallelism), 1, TOGETHER))
    shelves = int((-(-chunks.parts // together)).sum())
    dealt = placed.mapInArrow(_deal(spark.sparkContext.broadcast(chunks), row, reach, together), _DEALT).repartition(max(tasks, -(-shelves // 2)), "chunk", "shelf")
    found = scratch.keep(dealt.groupBy("chunk", "shelf", "part").applyInArrow(_compare(width, cosine, kind), "a long, b long, n long"), "found")
    links = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    labels = components(found.where("n = 0"), scratch).withColumnsRenamed({"node": "rep", "component": "c"})
    counted = classes.join(links, "rep", "left").join(labels, "rep", "left")
    counted = scratch.keep(counted.select("v", "least", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("c", "rep").alias("c")), "counted")
    ids = scratch.keep(counted.groupBy("c").agg(F.min("least").alias("component_id")), "ids")  # written down, so that a large component's join can be split
    named = scratch.keep(counted.join(ids, "c").select("v", "n_links", "component_id"), "named")
    return fine.join(named, "v").select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(alone)
