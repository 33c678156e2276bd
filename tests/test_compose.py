"""What several operators do together: index writes, chains of models, parsed trees, scans, judged parts, places in large groups."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom import plugins
from corpusloom.functions import tables
from corpusloom.operators import answering, answers, context, dialog, index, manifest, parsing, structure
from corpusloom.plans.ingest import NAMESPACE


def element(ordinal, kind, text, page=1, depth=0, rows=None):
    return ("d", ordinal, kind, text, page, depth, rows)


ELEMENTS = "doc_id string, ordinal int, kind string, text string, page int, depth int, rows array<array<string>>"


def test_places_and_sums_in_one_large_group(spark):
    draw = random.Random(2)
    rows = [(draw.choice("aaab"), draw.randint(0, 40), i) for i in range(400)]
    got = tables.ranked(spark.createDataFrame(rows, "g string, v int, place int"), ["g"], [F.col("v"), F.col("place")], "k").collect()
    upto = tables.ranked(spark.createDataFrame(rows, "g string, v int, place int"), ["g"], [F.col("v"), F.col("place")], "s", F.col("v")).collect()
    for g in "ab":
        order = sorted((v, i) for x, v, i in rows if x == g)
        assert {r.place: r.k for r in got if r.g == g} == {i: n + 1 for n, (_, i) in enumerate(order)}
        assert {r.place: r.s for r in upto if r.g == g} == {i: sum(v for v, _ in order[: n + 1]) for n, (_, i) in enumerate(order)}
    assert tables.ranked(spark.createDataFrame([], "g string, v int"), ["g"], [F.col("v")]).collect() == []


class Failing:
    def embed(self, texts):
        raise RuntimeError("down")


class TestIndex:
    @property
    def how(self):
        return F.struct("title"), F.concat(F.lit("c1."), F.col("file_hash"))

    def docs(self, spark, *rows):
        return spark.createDataFrame([(d, "chunked", h, t) for d, h, t in rows], "doc_id string, status string, file_hash string, title string")

    def chunks(self, spark, *rows):
        return spark.createDataFrame([(d, f"{d}#{i}", f"text {i}") for d, n in rows for i in range(n)], "doc_id string, chunk_id string, text string")

    def actions(self, done):
        return {r.doc_id: (r.action, r.n_points) for r in done.collect()}

    def test_what_changes_is_written_and_nothing_else(self, spark, tmp_path):
        kept = index.Index(spark, f"file://{tmp_path}", plugins.HashEmbedder, NAMESPACE)
        assert kept.version() == 0 and kept.points() is None
        chunks = self.chunks(spark, ("a", 2), ("b", 3), ("c", 0))
        assert self.actions(kept.write(self.docs(spark, ("a", "1", "A"), ("b", "1", "B"), ("c", "1", "C")), chunks, *self.how)) == {"a": ("indexed", 2), "b": ("indexed", 3), "c": ("indexed", 0)}
        done = kept.write(self.docs(spark, ("a", "1", "New"), ("b", "2", "B"), ("e", "1", "E")), self.chunks(spark, ("a", 2), ("b", 1), ("e", 1)), *self.how)
        assert self.actions(done) == {"a": ("metadata", 2), "b": ("indexed", 1), "e": ("indexed", 1), "c": ("removed", 0)}
        assert {r.doc_id for r in kept.stored(2).select("doc_id").distinct().collect()} == {"b", "e"}
        shown = kept.points().collect()
        assert sorted((r.chunk_id, r.metadata.title) for r in shown) == [("a#0", "New"), ("a#1", "New"), ("b#0", "B"), ("e#0", "E")]
        assert {r.doc_id for r in kept.points(1).collect()} == {"a", "b"}
        kept.compact()
        assert sorted(r.chunk_id for r in kept.points().collect()) == ["a#0", "a#1", "b#0", "e#0"]
        assert self.actions(kept.write(self.docs(spark, ("a", "1", "New")), chunks, *self.how))["a"] == ("skipped", 2)

    def test_a_failed_write_leaves_the_last_one_readable(self, spark, tmp_path, monkeypatch):
        root = f"file://{tmp_path}"
        kept = index.Index(spark, root, plugins.HashEmbedder, NAMESPACE)
        kept.write(self.docs(spark, ("a", "1", "A")), self.chunks(spark, ("a", 2)), *self.how)
        with pytest.raises(Exception, match="down"):
            index.Index(spark, root, Failing, NAMESPACE).write(self.docs(spark, ("a", "2", "X")), self.chunks(spark, ("a", 1)), *self.how)
        monkeypatch.setattr(index.Index, "stored", lambda self, part: self.spark.read.parquet(f"{self.root}/parts/part={part}").limit(1))
        with pytest.raises(RuntimeError, match="a: 1 points, expected 3"):
            kept.write(self.docs(spark, ("a", "2", "X")), self.chunks(spark, ("a", 3)), *self.how)
        monkeypatch.undo()
        assert kept.version() == 1 and [(r.chunk_id, r.metadata.title) for r in kept.points().orderBy("chunk_id").collect()] == [("a#0", "A"), ("a#1", "A")]
        with pytest.raises(ValueError, match="twice"):
            kept.write(self.docs(spark, ("a", "1", "A"), ("a", "1", "A")), self.chunks(spark), *self.how)


class Upper:
    def parse(self, content):
        if content == "bad":
            raise ValueError("cannot")
        return content.upper()


def test_parses_are_kept_by_content_and_version(spark, tmp_path):
    kept = parsing.ParseCache(spark, f"file://{tmp_path}")
    files = lambda *rows: spark.createDataFrame(rows, "doc_id string, content_hash string, content string")
    run = lambda version, *rows: {r.doc_id: r.action for r in kept.parse(files(*rows), Upper, version).collect()}
    assert run(1, ("a", "1", "x"), ("b", "1", "bad"), ("c", "1", None)) == {"a": "parsed", "b": "failed", "c": "parsed"}
    assert run(1, ("a", "1", "not read"), ("b", "1", "bad"), ("c", "2", "z")) == {"a": "cached", "b": "failed", "c": "parsed"}
    assert {r.doc_id: r.parsed for r in kept.parses().collect()} == {"a": "X", "c": "Z"}
    assert run(2, ("a", "1", "y")) == {"a": "parsed"}
    assert [tuple(r) for r in kept.parses().select("doc_id", "parser_version", "parsed").collect()] == [("a", 2, "Y")]


def test_elements_of_a_tree(spark):
    items = [("r1", None, 2, "section_header", "body", None, " Title ", None), ("r2", "r1", 1, "list_item", "body", 3, "item", None), ("r3", "r2", 1, "list_item", None, None, "deep", None), ("r0", None, 1, "picture", "body", 7, "a picture", None),
             ("r4", "r1", 2, "table", "body", None, None, [["a"]]), ("r5", "gone", 9, None, "body", None, "stray", None), ("f", None, 0, "text", "furniture", 1, "Page 12", None), ("e", "r1", 3, "text", "body", 9, "  ", None)]
    df = spark.createDataFrame([("d", *x) for x in items], "doc_id string, ref string, parent string, position int, label string, layer string, page int, text string, rows array<array<string>>").withColumn("path", F.lit("clash"))
    elements, furniture = structure.extract(df.drop("path"))
    assert [(r.kind, r.text, r.page, r.depth, r.rows) for r in elements.orderBy("ordinal").collect()] == [("heading", "Title", 7, 0, None), ("list", "item", 3, 1, None), ("list", "deep", 3, 2, None), ("table", "", 3, 0, [["a"]]), ("text", "stray", 9, 0, None)]
    assert [r.key for r in furniture.collect()] == ["page #"]
    round_ = spark.createDataFrame([("d", "a", "b", 1), ("d", "b", "a", 1)], "doc_id string, ref string, parent string, position int")
    with pytest.raises(ValueError):
        structure.flattened(round_).collect()


def test_slides_with_blocks(spark):
    rows = [element(0, "heading", "Walk (1/2)"), element(1, "list", "one"), element(2, "list", "two", depth=1), element(3, "heading", "Walk (2/2)", 2), element(4, "list", "three", 2), element(5, "heading", "Part", 2), element(6, "table", "", 2, rows=[["a", "b"]]),
            element(7, "heading", "Agenda", 3), element(8, "text", "gone", 3), element(9, "text", "untitled", 4)]
    got = structure.slide_blocks(spark.createDataFrame(rows, ELEMENTS)).orderBy(F.col("number").cast("int"), "n").collect()
    assert [(r.number, r.title, r.n, r.kind, r.text, r.page_start, r.page_end, r.demoted) for r in got] == [
        ("1", "Walk", 1, "list", "- one\n  - two\n- three", 1, 2, False), ("1", "Walk", 2, "text", "Part", 2, 2, True), ("1", "Walk", 3, "table", "| a | b |\n| --- | --- |", 2, 2, False), ("4", "Slide 4", 1, "text", "untitled", 4, 4, False),
    ]


def test_what_numbering_leaves_over(spark):
    toc = [["1", "Install"], ["2", "Configure the server"], ["3", "Never there"]]
    rows = [element(0, "toc", "", 1, rows=toc), element(1, "heading", "1 Install", 2), element(2, "text", "Body.", 2), element(3, "heading", "Remark", 2), element(4, "heading", "2 Configure the server", 3), element(5, "text", "More.", 3)]
    sections, left, removed = structure.build_structure(spark.createDataFrame(rows, ELEMENTS), ("More",), spark.createDataFrame([], "doc_id string, key string"))
    assert {r.number for r in sections.collect()} >= {"1"}
    assert sorted((r.what, r.number, r.title) for r in left.collect()) == [("demoted", None, "Remark"), ("unmatched", "3", "Never there")]
    assert [(r.line, r.n) for r in removed.collect()] == [("More.", 1)]


class Named:
    def __init__(self, name):
        self.name = name

    def generate(self, messages):
        user = messages[-1]["content"]
        if f"no {self.name}" in user:
            raise RuntimeError("down")
        return f"{self.name} [1]." if "refuse" not in user or "Source 4" not in user else answers.NOT_FOUND


class TestChain:
    MODELS = [answering.Model("big", lambda: Named("big"), 40_000, 4_000), answering.Model("small", lambda: Named("small"))]

    def inputs(self, spark, questions):
        q = spark.createDataFrame([(i, x) for i, x in enumerate(questions)], "qid int, question string")
        units = q.select("qid", F.explode(F.expr("sequence(1, 4)")).alias("n")).select("qid", "n", F.lit(1_000).alias("tokens"), F.concat(F.lit("Source "), F.col("n").cast("string")).alias("text"), F.lit("T").alias("title"), F.lit("any").alias("release"), F.lit("1").alias("section"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
        chain = q.select("qid", F.posexplode(F.array(F.lit("big"), F.lit("unknown"), F.lit("small"))).alias("step", "model"))
        return q, units, chain

    def test_who_fails_gives_way(self, spark):
        q, units, chain = self.inputs(spark, ["fine", "no big", "no big no small"])
        got = {r.qid: r for r in answering.generate(q, units, chain, self.MODELS, "S").collect()}
        assert [(got[i].profile, got[i].n_units, got[i].n_full, got[i].reply, got[i].error) for i in range(3)] == [("big", 4, 4, "big [1].", None), ("small", 3, 4, "small [1].", None), ("small", 3, 4, None, "RuntimeError: down")]
        assert got[1].notices == ["big failed (RuntimeError: down); answered with small instead.", "small has a smaller context window: answered from the 3 best of 4 sources."]
        assert [x.profile for x in got[2].failed] == ["big"] and got[0].notices == []

    def test_refusals_are_tried_again_with_fewer_sources(self, spark):
        q, units, chain = self.inputs(spark, ["fine", "refuse this", "no big no small"])
        candidates = q.select("qid", F.lit(1).alias("rank"), F.lit(0.9).alias("rerank_score"))
        got = {r.qid: r for r in answering.answer(q, units, candidates, chain=chain, models=self.MODELS).collect()}
        assert [(got[i].status, got[i].refused_by, got[i].retried, got[i].profile) for i in range(3)] == [("answered", None, False, "big"), ("answered", None, True, "big"), ("refused", "llm", False, "small")]
        assert got[1].notices == ["Answered on a second attempt with the 3 best-matching sources; with all 4 the model found no answer."]

    def test_sides_have_their_own_limits(self, spark):
        units = spark.createDataFrame([([{"side": s, "tokens": t} for s, t in (("a", 10), ("a", 10), ("b", 90), ("b", 5), ("a", 1), (None, 1))],)], "u array<struct<side:string,tokens:int>>")
        got = units.select(F.transform(context.fit(F.col("u"), 0, 60, 2), lambda x: x["tokens"]).alias("x")).first().x
        assert got == [10, 10, 5, 1]


def test_copies_are_inherited_when_sides_merge(spark):
    rows = [("q", "A", 0, 1, "a1", "d1", 10, "one two", ["d9"]), ("q", "B", 1, 1, "b1", "d2", 10, "one two", ["d1", "d3", "d9"]), ("q", "B", 1, 2, "b2", "d4", 999, "long", None), ("q", "A", 0, 2, "a1", "d1", 10, "again", [])]
    df = spark.createDataFrame(rows, "qid string, side string, side_index int, n int, section_id string, doc_id string, tokens int, text string, copies array<string>")
    assert [(r.doc_id, r.copies) for r in context.merge_sides(df, tokens=100).collect()] == [("d1", ["d9", "d2", "d3"])]


def test_reads_skip_what_does_not_fit_and_go_on(spark):
    reads = spark.createDataFrame([("q", "A", "s1", 0), ("q", "A", "s2", 1), ("q", "B", "s3", 2), ("q", "B", "s4", 3)], "qid string, side string, section_id string, pos int")
    sections = spark.createDataFrame([("q", "s1", 900), ("q", "s2", 700), ("q", "s3", 600)], "qid string, section_id string, tokens int")
    assert [(r.n, r.section_id) for r in dialog.read_sections(reads, sections).orderBy("n").collect()] == [(1, "s1"), (2, "s3")]


class Scripted:
    def generate(self, messages):
        part = messages[-1]["content"].rpartition("\n\nAnswer:\n\n")[2]
        if "boom" in part:
            raise RuntimeError("boom")
        return "[]" if "list" in part else '{"claims": [{"claim": "C", "evidence": "port"}, {"claim": "So:", "evidence": "port"}]}'


def test_answers_are_judged_until_a_part_fails(spark):
    long = "x" * 700
    rows = [(1, f"ok {long}\n\nok {long}"), (2, f"ok {long}\n\nboom {long}\n\nok {long}"), (3, "list"), (4, None), (5, f"boom {long}\n\nlist {long}")]
    got = {r.qid: (r.parts, r.claims, r.supported, r.error) for r in answers.judge(spark.createDataFrame(rows, "qid int, answer string").withColumn("sources", F.lit("the port")), Scripted).collect()}
    assert got == {1: (2, 2, 2, None), 2: (1, 1, 1, "RuntimeError: boom"), 3: (0, 0, 0, "unreadable judge reply: []"), 4: (1, 1, 1, None), 5: (0, 0, 0, "RuntimeError: boom")}


def test_a_long_family_name_that_goes_on_is_noted(spark):
    long = "a" * 52
    files = spark.createDataFrame([(f"x/{long}bc.pdf", "h1", ""), ("x/other.pdf", "h1", ""), ("y/other.pdf", "h2", "")], "path string, content_hash string, cover string")
    listed = spark.createDataFrame([("l.pdf", long, long, "1.0", "h0"), ("m.pdf", "other", "other", "1.0", "h2")], "path string, doc_id string, family string, version string, content_hash string")
    rows, copies = manifest.scan(files, listed)
    assert {r.path: r.copy_of for r in copies.collect()} == {"x/other.pdf": f"new file 'x/{long}bc.pdf'", "y/other.pdf": "manifest doc_id 'other'"}
    (row,) = rows.collect()
    assert f"may be a revision of family '{long}'" in row.review and row.doc_id == f"{long}bc"


@pytest.mark.parametrize("text,want", [("A [1] [1] b.", "A [1] b."), ("So [1][2]. [2]\nNext [3].", "So [1][2].\nNext [3]."), ("It is [1]. [2] ok", "It is [1]. [2] ok"), ("No [1]\n[1] again", "No [1] again")])
def test_repeated_marks_go(spark, text, want):
    assert spark.range(1).select(answers.tidy(F.lit(text)).alias("x")).first().x == want


def test_generate_names_an_unknown_profile(spark):
    df = spark.createDataFrame(pd.DataFrame({"qid": [1], "system": ["s"], "user": ["u"], "profile": ["none"]}))
    assert "KeyError" in plugins.generate(df, {"big": lambda: Named("big")}).first().error


def test_context_carries_only_chunks_around_hits(spark):
    chunks = spark.createDataFrame([(f"s#{i}", "s", "d", i, f"t{i}", 10, 1, 1) for i in range(300)], "chunk_id string, section_id string, doc_id string, chunk_index int, text string, token_count int, page_start int, page_end int")
    sections = spark.createDataFrame([("s", "all of it", 3000, 1, 9)], "section_id string, text string, token_count int, page_start int, page_end int")
    hits = spark.createDataFrame([("q", 1, "s#50", "s", "d", 50, None), ("q", 2, "s#52", "s", "d", 52, None), ("r", 1, "s#0", "s", "d", 0, None)], "qid string, order_rank int, chunk_id string, section_id string, doc_id string, chunk_index int, rerank_score double")
    made = context.assemble(hits, sections, chunks)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "_lo" in plan and "_hi" in plan  # chunks are filtered before they are gathered
    assert {r.qid: (r.lo, r.hi, r.tokens, r.text) for r in made.collect()} == {"q": (49, 53, 50, "\n\n".join(f"t{i}" for i in range(49, 54))), "r": (-1, 1, 20, "t0\n\nt1")}


def test_sources_beside_or_apart_give_the_same_verdicts(spark):
    reply = '{"claims": [{"claim": "A", "supported": true, "evidence": "%s"}]}'
    rows = [(1, 0, reply % "the port", None), (1, 1, reply % "no such", None), (2, 0, reply % "the pump", None), (2, 1, None, "E: x"), (2, 2, reply % "the pump", None), (3, 0, "no", None)]
    parts = spark.createDataFrame(rows, "qid int, part int, reply string, error string")
    sources = spark.createDataFrame([(1, "open the port"), (2, "start the pump"), (3, "x"), (4, "y")], "qid int, sources string")
    apart = answers.merged_verdicts(parts, sources).collect()
    assert sorted(apart) == sorted(answers.merged_verdicts(parts.join(sources, "qid")).collect())
    assert {r.qid: (r.parts, r.claims, r.supported) for r in apart} == {1: (2, 2, 1), 2: (1, 1, 1), 3: (0, 0, 0)}


def test_sections_are_numbered_many_documents_a_batch(spark):
    """A data frame for each document cost more than its numbering; documents with unknown pages and without headings too."""
    kinds = "doc_id string, ordinal int, kind string, text string, page int, depth int, rows array<array<string>>"
    rows = [(f"d{i}", n, "heading" if n % 2 == 0 else "text", f"{1 + n // 2}. Part {n}" if n % 2 == 0 else f"words {i}", None if i == 3 else 1 + n // 4, 0, None) for i in range(40) for n in range(6) if i != 5 or n % 2]
    found = structure.build_sections(spark.createDataFrame(rows[::-1], kinds))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapCoGroups" not in plan
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, []).append((r.ordinal, r.number, r.page_start, r.page_end, len(r.blocks)))
    assert sorted(got["d0"]) == [(0, "1", 1, 1, 1), (1, "2", 1, 1, 1), (2, "3", 2, 2, 1)] and len(got) == 40
    assert [(x[2], x[3]) for x in sorted(got["d3"])] == [(None, None)] * 3 and [x[1] for x in got["d5"]] == ["0"]
