"""SimHash, embeddings, top-k, mixing and the pipeline against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import bpe, components, mixing, neardup, quality, queries, simhash, topk, toxicity
from corpusloom.llm.common import Scratch
from tests import oracle

VEC = "vec_id long, embedding array<float>, label int"


def groups(ids, linked):
    """Smallest id reachable, for each id, by brute force."""
    order = sorted(range(len(ids)), key=lambda i: ids[i])
    root = {ids[i]: ids[i] for i in order}
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            low = min(root[ids[j]] for j in np.flatnonzero(linked[i]))
            if low < root[ids[i]]:
                root[ids[i]], changed = low, True
    return root


class TestSimHash:
    def slow(self, text):
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    @pytest.mark.parametrize("text", ["", None, "one", "A b C", "a b c d", "É a B\tc\x0bd e f g h", "x " * 500, "w" * 9_999, "a b a b a b a b"])
    def test_fingerprint(self, text):
        assert simhash.fingerprint(text) == self.slow(text)

    def test_spark_hashes_shingles_alike(self, spark):
        assert spark.sql("SELECT xxhash64('a b c d') h").first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)

    def test_query_equals_brute_force(self, spark, small):
        text = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
        ids = sorted(text)
        fp = np.array([self.slow(text[i]) for i in ids], np.uint64)
        root = groups(ids, np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash_near_dedup(spark, small).collect()}
        assert got == {i: (f"{int(f):016x}", root[i]) for i, f in zip(ids, fp)}

    def test_links_at_exactly_four_bits_and_none_at_five(self):
        rng = np.random.default_rng(1)
        base = rng.integers(0, 2**63, 40, dtype=np.uint64)
        near = base ^ np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in base], np.uint64)
        far = base ^ np.array([sum(1 << int(b) for b in rng.choice(64, 5, replace=False)) for _ in base], np.uint64)
        import pyarrow as pa

        def met(fps):
            out = []
            for part in range(2):
                rows = list(simhash._emit(part, 2, 3, 4)(iter([pa.RecordBatch.from_arrays([pa.array(np.unique(fps).view(np.int64))], ["fp"])])))
                t = pa.Table.from_batches(rows)
                for g in range(3):
                    mine = t.filter(pa.compute.equal(t["g"], g))
                    if mine.num_rows:
                        c = simhash._collide(4)(mine)
                        out += zip(c["a"].to_pylist(), c["b"].to_pylist())
            return out

        assert len({x for pair in met(np.concatenate([base, near])) for x in pair}) == 80
        assert met(np.concatenate([base, far])) == []

    def test_each_variant_is_in_one_class_and_classes_are_alike(self):
        import pyarrow as pa

        fps = np.unique(np.random.default_rng(2).integers(0, 2**64, 50, dtype=np.uint64) & np.uint64(0xFFFF))  # near copies of each other
        batch = pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])
        got = [np.concatenate([np.frombuffer(x, "<u8") for b in simhash._emit(part, 8, 5, 4)(iter([batch])) for x in b.column("variant").to_pylist()]) for part in range(8)]
        assert (np.sort(np.concatenate(got)) == np.sort((fps[:, None] ^ simhash.ball(2)[None, :]).ravel())).all()
        assert max(map(len, got)) < 1.2 * min(map(len, got))

    def test_columns_of_any_name_stay(self, spark):
        d = spark.createDataFrame([(i, f"alpha beta gamma delta {i // 2}") for i in range(6)], "doc_id long, text string")
        for c in ("c", "id", "row", "fp", "lo", "mixed", "component_id", "_fp"):
            d = d.withColumn(c, F.concat(F.lit(c), "doc_id"))
        got = simhash.without_near_copies(d.withColumn("x.y", F.lit(1)))
        assert got.columns == [*d.columns, "x.y"] and sorted(r.doc_id for r in got.collect()) == [0, 2, 4]
        assert all(r.c == f"c{r.doc_id}" and r.id == f"id{r.doc_id}" for r in got.collect())

    def test_odd_tables(self, spark):
        rows = [(3, ""), (5, None), (2, " \n"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (None, "only here and nowhere else at all")]
        d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
        got = sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.simhash_groups(d).collect())
        assert got == [(-1, -1), (-1, 7), (2, 2), (3, 2), (5, 2), (7, 7), (7, 7)]
        kept = simhash.without_near_copies(d)
        assert kept.columns == d.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 7]
        assert simhash.simhash_groups(d.limit(0)).count() == 0 and simhash.without_near_copies(d.limit(0)).count() == 0
        for wrong in ({"radius": 3}, {"parts": 6}):
            with pytest.raises(ValueError):
                simhash.simhash_groups(d, **wrong)

    def test_one_id_with_texts_of_several_groups(self, spark):
        a, b, c = ("alpha one two three four five", "beta six seven eight nine ten", "gamma red green blue white black")
        rows = [(3, a), (7, a), (7, b), (9, b), (9, b), (8, a), (8, c), (None, c), (5, c), (4, a)]
        d = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, simhash.without_near_copies(d).collect())) == [(3, a), (5, c), (7, b)]
        alone = spark.createDataFrame([(7, a), (7, b), (7, b)], "doc_id long, text string")
        assert sorted(map(tuple, simhash.without_near_copies(alone).collect())) == [(7, a), (7, b)]

    def test_a_large_group_of_near_copies_is_one(self, spark):
        base = [f"w{i}" for i in range(400)]
        texts = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(300)] + [" ".join(base)] * 300
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        fp = np.array([self.slow(t) for t in texts], np.uint64)
        root = groups(list(range(600)), np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
        assert {r.doc_id: r.component_id for r in simhash.simhash_groups(d).collect()} == root


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1_000, 1_000 + i) for i in range(1, 200)] + [(5, 5), (None, 3), (2_000, 1_999)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    want = {i: 0 for i in range(61)} | {1_000 + i: 1_000 for i in range(200)} | {1_999: 1_999, 2_000: 1_999}
    assert {r.node: r.component for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


class TestNearDuplicates:
    def brute(self, x):
        u = x / np.linalg.norm(x, axis=1)[:, None]
        linked = u @ u.T >= 0.9
        return linked.sum(1) - 1, groups(list(range(len(x))), linked)

    def planted(self, seed=0):
        rng = np.random.default_rng(seed)
        centres = rng.standard_normal((60, 32))
        near = [c + s * rng.standard_normal(32) * np.linalg.norm(c) / 32**0.5 for c in centres for s in (0.02, 0.15, 0.3, 0.45, 0.5)]
        crowd = [centres[0] + 0.1 * rng.standard_normal(32) for _ in range(150)]
        return np.array([*rng.standard_normal((900, 32)), *centres, *near, *crowd, *[centres[1]] * 40]).astype(np.float32)

    def test_recall_and_no_link_below_the_threshold(self, spark):
        x = self.planted()
        n, root = self.brute(x.astype(float))
        rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], VEC)
        got = {r.vec_id: r for r in neardup.near_duplicates(rows).collect()}
        links = np.array([got[i].n_links for i in range(len(x))])
        assert (links <= n).all() and links.sum() >= 0.95 * n.sum()
        assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) > 0.95
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())

    def test_visiting_all_cells_is_exact(self, spark, monkeypatch):
        monkeypatch.setattr(neardup.MultiIndex, "reach", lambda self, *_: self.words**2)
        x = self.planted(1)
        n, root = self.brute(x.astype(float))
        rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)
        got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(rows).collect()}
        assert got == {i: (n[i], root[i]) for i in range(len(x))}

    def test_small_chunks_give_the_same(self, spark, monkeypatch):
        x = self.planted(2)
        rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)
        want = sorted(map(tuple, neardup.near_duplicates(rows).collect()))
        monkeypatch.setattr(neardup, "CHUNK", 40)
        monkeypatch.setattr(neardup, "VISITORS", 60)
        assert sorted(map(tuple, neardup.near_duplicates(rows).collect())) == want

    def crowd(self, n):
        """n near copies and 50 others; each visits its own cell and the next of three, so some pairs are met by one end, some by both."""
        rng = np.random.default_rng(6)
        x = np.concatenate([rng.standard_normal(64) + 0.25 * rng.standard_normal((n, 64)), rng.standard_normal((50, 64))]).astype(np.float32)
        home = np.arange(len(x)) % 3
        row = {"rep": np.arange(len(x)) * 5, "m": 1 + np.arange(len(x)) % 2, "home": home.astype(np.int32)}
        t = pa.table(row | {"v": [v.tobytes() for v in x], "cells": [np.array([h, (h + 1) % 3], np.int32).tobytes() for h in home]})
        both = pa.concat_tables([t.append_column("side", pa.array(np.full(len(x), s, np.int32))) for s in (0, 1)])
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
        linked = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
        return both, linked, linked @ row["m"]

    def linked_by(self, found, n):
        rows = found.to_pylist()
        counts = np.zeros(n, np.int64)
        for r in rows:
            counts[r["a"] // 5] += r["n"]
        edges = {(r["a"] // 5, r["b"] // 5) for r in rows if not r["n"]}
        return counts, groups(list(range(n)), np.array([[i == j or (i, j) in edges or (j, i) in edges for j in range(n)] for i in range(n)]))

    def test_pairs_of_a_crowd_are_not_held_at_once(self):
        both, linked, want = self.crowd(1_000)
        tracemalloc.start()
        found = neardup._compare(64, 0.9, np.float32)(both)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert linked.sum() > 900_000 and most < 150e6  # holding a cell's pairs took 250 MB, and four times as much for twice the crowd
        assert sum(r["n"] for r in found.to_pylist()) == want.sum()
        assert [x.as_py() for x in pa.compute.unique(found.filter(pa.compute.equal(found["n"], 0))["b"])] == [0]

    @pytest.mark.parametrize("pairs", [1, 70, 1 << 19])
    def test_blocks_of_pairs_give_what_brute_force_gives(self, monkeypatch, pairs):
        both, linked, want = self.crowd(90)
        monkeypatch.setattr(neardup, "PAIRS", pairs)
        counts, root = self.linked_by(neardup._compare(64, 0.9, np.float32)(both), len(want))
        assert (counts == want).all() and 0 < linked[:90, :90].sum() < 90 * 89 and root == groups(list(range(len(want))), linked | np.eye(len(want), dtype=bool))

    def test_long_rows_come_in_fewer(self):
        homes, visits = np.full(64, 1_000), np.full(64, 30_000)
        short, long = neardup.Chunks(homes, visits), neardup.Chunks(homes, visits, 8 * neardup.ROW_BYTES)
        for c, most, visitors in ((short, neardup.CHUNK, neardup.VISITORS), (long, neardup.CHUNK // 8, neardup.VISITORS // 8)):
            held, seen = np.zeros(len(c.parts)), np.zeros(len(c.parts))
            for first, pieces in zip(c.first, c.pieces):
                held[first : first + pieces] += 1_000 / pieces
                seen[first : first + pieces] += 30_000
            assert held.max() <= most and (seen / c.parts).max() <= visitors

    def test_multi_sequence_order(self):
        rng = np.random.default_rng(3)
        index = neardup.MultiIndex(rng.standard_normal((500, 16)), 8)
        x = rng.standard_normal((20, 16))
        a, b = index.sides(x)
        full = (a[:, :, None] + b[:, None, :]).reshape(20, -1)
        seen = index.visits(x, 17)
        assert np.allclose(np.take_along_axis(full, seen, 1), np.sort(full, 1)[:, :17])
        assert (index.rank(x, seen[:, 5]) == 5).all() and (seen[:, 0] == index.home(x)).all()

    def test_odd_vectors(self, spark):
        nan, inf = float("nan"), float("inf")
        rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [nan, 1.0], 0), (6, [inf, 1.0], 0), (7, [], 0), (8, [1.0, None], 0), (9, [1.0], 0), (9, [1.0], 0), (None, [1.0, 0.0], 0)]
        got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, VEC).withColumn("rep", F.lit("clash"))).collect()}
        assert got == {1: (2, 1), 2: (2, 1), 9: (2, 1), **{i: (0, i) for i in (3, 4, 5, 6, 7, 8)}}
        assert neardup.near_duplicates(spark.createDataFrame([], VEC)).count() == 0

    def test_one_id_with_different_vectors(self, spark):
        rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 3.0], 0), (3, [5.0, 0.0], 0), (3, [-1.0, -1.0], 0), (4, [-2.0, -2.0], 0), (4, None, 0)]
        got = sorted(tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, VEC), recall=1.0).collect())
        assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 3, True), (4, 0, 4, True), (4, 1, 3, False)]

    def test_doubles_that_no_float_holds_are_compared_as_doubles(self, spark):
        kind = "vec_id long, embedding array<double>, label int"
        just = [0.9, (1 - 0.81) ** 0.5 - 1e-12]  # a cosine above 0.9 by less than a float can tell
        below = [0.9, (1 - 0.81) ** 0.5 + 1e-12]
        rows = [(1, [1.0, 0.0], 0), (2, just, 0), (3, [-1.0, 0.0], 0), (4, [-below[0], below[1]], 0)]
        got = {r.vec_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, kind), recall=1.0).collect()}
        assert got == {1: 1, 2: 1, 3: 3, 4: 4}

    def test_query_equals_brute_force(self, spark, small):
        rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
        n, root = self.brute(np.array([r.embedding for r in rows], float))
        got = {r.vec_id: r for r in queries.op6_embedding_near_dedup(spark, small).collect()}
        assert set(got) == {r.vec_id for r in rows}
        assert sum(got[r.vec_id].n_links for r in rows) >= 0.95 * n.sum() and all(got[r.vec_id].n_links <= k for r, k in zip(rows, n))
        assert np.mean([got[r.vec_id].component_id == rows[root[i]].vec_id for i, r in enumerate(rows)]) > 0.98


class TestTopK:
    def test_query_equals_its_sql(self, spark, small):
        oracle.same(queries.op5_exact_topk(spark, small), oracle.connect(small), topk.ORACLE_SQL)

    @pytest.mark.parametrize("shard", [50, 8_192])
    def test_ties_copies_and_shards(self, spark, shard):
        rng = np.random.default_rng(5)
        x = rng.integers(-2, 3, (700, 5)) / 1024
        rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VEC)
        got = topk.topk(rows, shard=shard)
        v = np.floor(x.astype(np.float32).astype(float) * 1024).astype(int)
        want = set()
        for q in range(0, 700, 100):
            s = v @ v[q]
            best = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:10]
            want |= {(q, r + 1, int(i), int(s[i])) for r, i in enumerate(best)}
        assert {tuple(r) for r in got.collect()} == want

    def test_ids_with_different_vectors_equal_the_sql(self, spark):
        import duckdb

        x = np.random.default_rng(8).integers(-9, 10, (900, 5)) / 1024
        rows = spark.createDataFrame([(i % 350, v.tolist(), 0) for i, v in enumerate(x)], VEC).distinct()
        con = duckdb.connect()
        con.register("embeddings", rows.toArrow())
        for shard in (60, 8_192):
            oracle.same(topk.topk(rows, shard=shard), con, topk.ORACLE_SQL)

    def test_repeated_rows_equal_the_sql(self, spark):
        import duckdb

        x = np.random.default_rng(9).integers(-3, 4, (260, 4)) / 1024
        given = [(i, v.tolist(), 0) for i, v in enumerate(x)]
        given += [(i, v, 0) for i, v, _ in given if i % 100 and i % 3 == 0] * 2 + [(7, [0.1, 0.2, 0.3, 0.4], 1), (5, None, 0), (5, None, 0)]
        rows = spark.createDataFrame(given, VEC)
        con = duckdb.connect()
        con.register("embeddings", rows.toArrow())
        for shard in (40, 8_192):
            oracle.same(topk.topk(rows, shard=shard), con, topk.ORACLE_SQL)

    def test_boxes_are_tight_and_leaves_small(self):
        x = np.random.default_rng(6).integers(-99, 99, (1_000, 4))
        t = topk.build(np.arange(1_000), x, 64)
        assert sorted(t.ids) == list(range(1_000)) and (x[t.ids] == t.x).all()
        for i, (a, b) in enumerate(zip(t.begin, t.end)):
            assert (t.x[a:b].min(0) == t.low[i]).all() and (t.x[a:b].max(0) == t.high[i]).all()
            if t.left[i] < 0:
                assert 0 < b - a <= 64
            else:
                assert (t.begin[t.left[i]], t.end[t.left[i]], t.begin[t.right[i]], t.end[t.right[i]]) == (a, t.begin[t.right[i]], t.end[t.left[i]], b)

    def test_search_skips_boxes_below_the_kth_score(self, monkeypatch):
        draw = np.random.default_rng(7)
        centres = draw.integers(-900, 900, (40, 8))
        x = centres[draw.integers(0, 40, 4_000)] + draw.integers(-20, 20, (4_000, 8))
        t, q = topk.build(np.arange(4_000), x, 32), x[:60]
        seen = []
        bounds = topk._bounds
        monkeypatch.setattr(topk, "_bounds", lambda *z: seen.append(len(z[0])) or bounds(*z))
        at, to, score = topk.search(t, np.arange(60), q, 5)
        s = (q @ x.T).astype(float)
        s[np.arange(60), np.arange(60)] = -np.inf
        for i in range(60):
            assert to[at == i].tolist() == np.lexsort((np.arange(4_000), -s[i]))[:5].tolist()
        assert sum(seen) < 0.5 * 60 * len(t.begin)

    def test_cells_are_medians_of_the_sample(self):
        x = np.random.default_rng(8).integers(-99, 99, (4_096, 3))
        n = np.bincount(topk.Space.of(x, 16).cell(x), minlength=16)
        assert len(n) == 16 and n.min() > 200 and n.max() < 320
        assert set(topk.Space.of(x[:0], 4).cell(x)) <= set(range(4)) and (topk.Space.of(x, 1).cell(x) == 0).all()

    def test_odd_vectors(self, spark):
        rows = [(0, [1.0, 0.5], 0), (100, None, 0), (200, [float("nan"), 1.0], 0), (300, [], 0), (1, [1.0], 0), (2, [-1.0, 3.0], 0), (2, [-1.0, 3.0], 0), (None, [9.0, 9.0], 0)]
        got = [tuple(r) for r in topk.topk(spark.createDataFrame(rows, VEC).withColumn("rank", F.lit("clash"))).orderBy("query_id", "rank").collect()]
        assert got == [(0, 1, 1, 1024 * 1024), *((0, rank, 2, -1024 * 1024 + 512 * 3 * 1024) for rank in (2, 3))]  # every row is a candidate, repeated ones too
        assert topk.topk(spark.createDataFrame([], VEC)).count() == 0

    def test_large_numbers_stay_exact(self, spark):
        rows = [(0, [2.0**20, 1.0], 0), (1, [2.0**20, 3.0], 0), (2, [2.0**20, 2.0], 0)]
        assert [(r.vec_id, r.score) for r in topk.topk(spark.createDataFrame(rows, VEC)).orderBy("rank").collect()] == [(1, 2**60 + 3 * 2**20), (2, 2**60 + 2 * 2**20)]


class TestMixing:
    def test_query_equals_its_sql(self, spark, small):
        oracle.same(queries.op4_mixing(spark, small), oracle.connect(small), mixing.oracle_sql())

    def test_shortages_go_to_siblings_before_ancestors(self, spark):
        leaves = spark.createDataFrame([("d0", "en", "a", 100), ("d0", "en", "b", 1_000), ("d0", "de", "c", 1_000), ("d1", "en", "e", 2_000)], "domain string, lang string, source string, supply long")
        w = {"domain": {"d0": 1, "d1": 1}, "lang": {"en": 1, "de": 1}, "source": {"a": 1, "b": 1}}
        got = {r.source: r.share for r in mixing.budgets(leaves, w, budget=390, epochs=1).collect()}
        # 1,599 tokens: 799 for d0, of which 399 for en; a lacks 99 of its 199 and only b takes it
        assert got == {"a": 100, "b": 299, "c": 399, "e": 799}

    def test_epochs_repeat_and_totals_stay_within_the_budget(self, spark):
        rows = [(i, "w " * (1 + i % 7), "en", "src0" if i % 3 else "src1", 0) for i in range(600)]
        d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        got = mixing.mix(d, budget=1_500, epochs=2)
        total = sum(1 + i % 7 for i in range(600))
        used = got.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
        assert 1.5 * total - 40 <= used <= 1.5 * total and got.agg(F.max("copies")).first()[0] == 2
        assert sorted(map(repr, mixing.mix(d.repartition(5), budget=1_500, epochs=2).collect())) == sorted(map(repr, got.collect()))

    KIND = "doc_id long, text string, lang string, source string, n_chars long"

    def test_odd_tables(self, spark):
        rows = [(1, None, None, None, None), (2, "", "en", "x", 0), (None, "a b", "en", "src2", 3), (3, "a b", "xx", "src99999999999", 1), (3, "a b", "xx", "src99999999999", 1)]
        d = spark.createDataFrame(rows, self.KIND).withColumn("tokens", F.lit("clash"))
        assert mixing.mix(d, budget=1_000, epochs=1).count() == 5
        assert mixing.mix(d.limit(0)).count() == 0

    def test_columns_of_any_name_stay(self, spark):
        d = spark.createDataFrame([(i, "a b", "en", "src1", 0) for i in range(20)], self.KIND)
        for c in ("_lang", "_key", "domain", "tokens", "copies", "id", "mark", "row", "salt", "key", "whole", "rest", "stop", "base"):
            d = d.withColumn(c, F.concat(F.lit(c), "doc_id"))
        got = mixing.mix(d, budget=500, epochs=1).select("row.*")
        assert got.columns == d.columns and got.count() == 10 and all(r.tokens == f"tokens{r.doc_id}" and r["_key"] == f"_key{r.doc_id}" for r in got.collect())

    def test_repeated_rows_and_ids_equal_the_sql(self, spark):
        import duckdb

        draw = np.random.default_rng(4)
        rows = [(None if i % 11 == 0 else i % 60, None if i % 13 == 0 else "w " * int(draw.integers(0, 30)), ["en", "de", None][i % 3], f"src{i % 2}", 0) for i in range(400)]
        rows += rows[:70] + [(7, "w " * 2_000_000, "en", "src0", 0)]
        d = spark.createDataFrame(rows, self.KIND)
        con = duckdb.connect()
        con.register("documents", d.toArrow())
        for budget, epochs in ((300, 1), (900, 1), (1_700, 2)):
            got = mixing.decide(d, Scratch(spark, "test"), budget=budget, epochs=epochs, carry=("lang", "source")).select(F.col("id").alias("doc_id"), "carried.*", "domain", "tokens", "copies")
            oracle.same(got, con, mixing.oracle_sql(budget=budget, epochs=epochs))

    def test_a_tree_of_other_columns(self, spark):
        d = spark.createDataFrame([(i, "a b c", ["x", "y"][i % 2], "k") for i in range(40)], "doc_id long, text string, kind string, shelf string")
        tree = {"domain": F.col("shelf"), "lang": F.lit("-"), "source": F.col("kind")}
        got = mixing.mix(d, {"source": {"x": 3, "y": 1}}, budget=400, epochs=1, tree=tree)
        assert {r.source: r.n for r in got.groupBy("source").agg(F.sum("tokens").alias("n")).collect()} == {"x": 36, "y": 12}


class TestPipeline:
    def test_stages_equal_brute_force(self, spark, small):
        d = spark.read.parquet(f"{small}/documents.parquet")
        labels = spark.read.parquet(f"{small}/labels.parquet")
        rows = {r.doc_id: r for r in d.collect()}
        score = toxicity.train(d, labels).scorer()
        clean = {i: r for i, r in rows.items() if score([r.text])[0] < 0.5}
        score = quality.train(d.where(F.col("doc_id").isin(list(clean))), labels).scorer()
        good = {i: r for i, r in clean.items() if score([r.text])[0] >= 0.3}
        ids = sorted(good)
        fp = np.array([simhash.fingerprint(good[i].text) for i in ids], np.uint64)
        root = groups(ids, np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
        alone = {i: good[i] for i in ids if root[i] == i}
        con = oracle.connect(small)
        con.register("kept", spark.createDataFrame(list(alone.values()), d.schema).toArrow())
        mixed = con.execute(mixing.oracle_sql("kept", corpus_pipeline.MIX_BUDGET, corpus_pipeline.MIX_EPOCHS, columns="doc_id")).fetchall()
        merger = bpe.Merger(bpe.vocabulary())
        want = {}
        for (i,) in mixed:
            (words,) = merger.encode([rows[i].text or ""])
            want[i] = bpe._digests(words)
        got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, small).collect()}
        assert got == want and len(want) > 50

    def test_stages_keep_the_columns_of_documents(self, spark, small):
        docs = spark.read.parquet(f"{small}/documents.parquet")
        assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality classifier", "SimHash near-dedup", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, small).columns == docs.columns
            assert stage(spark, docs.limit(0), small).columns == docs.columns

    def test_stages_on_odd_tables(self, spark, small):
        """Nulls, empty and long texts, ties, repeated rows and columns with clashing names go through every stage and come out as they went in."""
        docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
        kind = docs.schema
        base = docs.collect()
        odd = [(None, None, None, None, None), (-1, "", "en", "src1", 0), (-2, None, None, "src1", 0), (-3, " \n", "en", None, 3), (None, base[0].text, "en", "src2", 9), (-4, "w" * 300_000, "en", "src1", 300_000), (-5, "long words here " * 300_000, "de", "src3", 4_800_000)]
        d = spark.createDataFrame([tuple(r) for r in base] + odd + odd, kind)
        clash = {c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0))) for c in ("_lang", "_key", "c", "domain", "tokens", "copies", "score", "predicted", "held_out", "id", "row", "mark", "fp", "ids", "h", "y")}
        d = d.withColumns(clash)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, d, small)
            assert got.columns == d.columns
            rows = got.collect()
            assert rows and all(r[c] == f"{c}{r.doc_id or 0}" for r in rows for c in clash)
            assert stage(spark, d.limit(0), small).count() == 0
        last = corpus_pipeline.STAGES[-1][1]
        assert last(spark, d, small).count() == d.count() and last(spark, d.limit(0), small).count() == 0

    def test_run_on_an_empty_table(self, spark, small, tmp_path):
        for t in ("documents", "labels"):
            spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
