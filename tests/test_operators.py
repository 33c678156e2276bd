import random
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom import plugins
from corpusloom.functions import text as X
from corpusloom.operators import answering, answers, chunking, context, dialog, evaluation, manifest, search, structure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def element(kind, text, page=1, depth=0, rows=None):
    return {"kind": kind, "text": text, "page": page, "depth": depth, "rows": rows, "lines": None}


def sections(elements, entries=(), front=0):
    return structure.number_sections(elements, structure.Contents([(n, t, structure.key_of(t)) for n, t in entries]), front)


def numbers(made):
    return [s["number"] for s in made]


class TestNumbering:
    def test_without_contents_headings_count_up(self):
        made = sections([element("heading", "Overview"), element("text", "a"), element("heading", "Set-up"), element("text", "b")])
        assert numbers(made) == ["1", "2"] and made[1]["title"] == "Set-up"

    def test_numbered_headings_need_a_plausible_number(self):
        made = sections([element("heading", "1 Start"), element("text", "x"), element("heading", "1.1 More"), element("text", "y"), element("heading", "7 Step of a list"), element("text", "z")])
        assert numbers(made) == ["1", "1.1"]
        assert [b[1] for b in made[1]["blocks"]] == ["y", "7 Step of a list", "z"]

    @pytest.mark.parametrize("last,number,fits", [(None, (1,), True), (None, (3,), False), ((3, 1), (3, 2), True), ((3, 1), (3, 3), True), ((3, 1), (3, 4), False), ((3, 1), (4,), True), ((3, 1), (3, 1, 1), True), ((3, 1), (3, 1, 3), False), ((4, 4), (1,), False)])
    def test_plausible_next(self, last, number, fits):
        assert structure.plausible_next(last, number) is fits

    def test_contents_lend_numbers_and_front_matter_stays_section_0(self):
        made = sections(
            [element("heading", "Cover", 1), element("text", "front", 1), element("toc", "", 2), element("heading", "Introduction", 3), element("text", "a", 3), element("text", "Configuring the Server", 3), element("text", "b", 3)],
            [("1", "Introduction"), ("1.1", "Configuring the Server")], front=2,
        )
        assert numbers(made) == ["0", "1", "1.1"]

    def test_close_titles_match_and_document_history_goes(self):
        made = sections([element("heading", "1 Installing the Sarch Server"), element("text", "a"), element("heading", "Document History"), element("text", "gone"), element("heading", "2 Use"), element("text", "b")], [("1", "Installing the Search Server"), ("2", "Use")])
        assert numbers(made) == ["1", "2"] and all("gone" not in b[1] for s in made for b in s["blocks"])

    def test_heading_merged_into_its_paragraph(self):
        made = sections([element("heading", "1 Start"), element("text", "x"), element("text", "Sending a System Report to Support The system report is long.")], [("1", "Start"), ("2", "Sending a System Report to Support")])
        assert made[-1]["number"] == "2" and made[-1]["title"] == "Sending a System Report to Support"
        assert made[-1]["blocks"][0][1] == "The system report is long."

    def test_list_items_make_one_indented_block_and_numbers_stay_unique(self):
        made = sections([element("heading", "1 A"), element("list", "x", depth=1), element("list", "y", depth=2), element("heading", "1 A"), element("text", "t")], [("1", "A")])
        assert made[0]["blocks"][0][:2] == ("list", "- x\n  - y") and numbers(made) == ["1", "1-2"]


def test_section_tree_does_not_depend_on_row_order(spark):
    rows = [("a", i, k, t, 1 + i // 4, 0, None) for i, (k, t) in enumerate([("heading", "One"), ("text", "x"), ("list", "i"), ("list", "j"), ("heading", "Two"), ("table", ""), ("text", "y")])]
    schema = "doc_id string, ordinal int, kind string, text string, page int, depth int, rows array<array<string>>"
    rows[5] = ("a", 5, "table", "", 2, 0, [["h", "o"], ["v|w", "•"]])
    made = [structure.build_sections(spark.createDataFrame(r, schema)).orderBy("ordinal").collect() for r in (rows, rows[::-1])]
    assert made[0] == made[1]
    assert made[0][1].blocks[0].text == "| h |\n| --- |\n| v\\|w |" or made[0][1].blocks[0].kind == "table"


def test_pack_blocks_moves_lead_ins_and_joins_short_tails(spark):
    def blocks(*spec):
        return F.array(*(F.struct(F.lit("text").alias("kind"), F.lit(t).alias("text"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.lit(n).alias("tokens"), F.lit(lead).alias("lead")) for t, n, lead in spec))

    sizes = lambda g: [[b.text for b in x] for x in g]
    assert sizes(one(spark, chunking.pack_blocks(blocks(("a", 200, False), ("b:", 10, True), ("c", 100, False))))) == [["a"], ["b:", "c"]]
    assert sizes(one(spark, chunking.pack_blocks(blocks(("a", 250, False), ("b", 20, False))))) == [["a", "b"]]
    assert sizes(one(spark, chunking.pack_blocks(blocks(("a", 250, False), ("b", 70, False))))) == [["a"], ["b"]]


def test_large_tables_repeat_their_header(spark):
    text = "| h |\n| --- |\n" + "\n".join(f"| {'w ' * 100}|" for _ in range(8))
    pieces = one(spark, chunking.split_block(F.lit("table"), F.lit(text)))
    assert len(pieces) > 1 and all(p.startswith("| h |\n| --- |\n") for p in pieces)


class TestContext:
    SECTIONS = [("small#1", "small text one two", 120, 1, 2), ("twin#1", "small text one two", 120, 3, 4), ("big#1", "whole", 2000, 1, 9)]
    CHUNKS = [(f"big#1#{i}", "big#1", i, f"part {i} " + "w " * i, 250, i + 1, i + 1) for i in range(6)]

    def make(self, spark, hits, **k):
        s = spark.createDataFrame(self.SECTIONS, "section_id string, text string, token_count int, page_start int, page_end int")
        c = spark.createDataFrame(self.CHUNKS, "chunk_id string, section_id string, chunk_index int, text string, token_count int, page_start int, page_end int")
        rows = [("q", i + 1, f"{sec}#{ix}", sec, sec.split("#")[0], ix, 0.9 - i / 10) for i, (sec, ix) in enumerate(hits)]
        cand = spark.createDataFrame(rows, "qid string, order_rank int, chunk_id string, section_id string, doc_id string, chunk_index int, rerank_score double")
        return [r.asDict() for r in context.assemble(cand, s, c, **k).orderBy("n").collect()]

    def test_window_of_a_hit_and_how_it_widens(self, spark):
        (u,) = self.make(spark, [("big#1", 3)])
        assert (u["kind"], u["lo"], u["hi"], u["tokens"]) == ("window", 2, 4, 750)
        (u,) = self.make(spark, [("big#1", 1), ("big#1", 4)])
        assert (u["lo"], u["hi"], u["tokens"]) == (0, 5, 1500) and len(u["chunk_ids"]) == 2

    def test_a_copy_is_noted_beyond_the_limit(self, spark):
        (u,) = self.make(spark, [("small#1", 0), ("twin#1", 0)], units=1)
        assert u["section_id"] == "small#1" and u["same_text"] == ["twin#1"]

    def test_what_does_not_fit_is_passed_over(self, spark):
        assert [u["section_id"] for u in self.make(spark, [("big#1", 3), ("small#1", 0)], tokens=200)] == ["small#1"]

    def test_min_score_and_missing_sections(self, spark):
        assert [u["section_id"] for u in self.make(spark, [("none#1", 0), ("small#1", 0), ("big#1", 2)], min_score=0.75)] == ["small#1"]


def test_near_duplicate_counts_words_in_order():
    a = " ".join(f"w{i}" for i in range(100))
    assert context.near_duplicate(a, a.replace("w50", "x")) and not context.near_duplicate(a, " ".join(reversed(a.split()))) and not context.near_duplicate(a, a[:200])


def test_access_fails_closed(spark):
    rows = spark.createDataFrame([(None,), ([None],), (["all"],), (["x", None],), (["y"],)], "g array<string>")
    assert [r.s for r in rows.select(search.may_see(F.col("g"), F.array(F.lit("y"))).alias("s")).collect()] == [False, False, True, False, True]


def test_access_filter_is_below_the_ranking(spark):
    points = spark.createDataFrame([(i, ["all"] if i % 2 else ["secret"], True, 0, 9999, "c") for i in range(100)], "chunk_id long, allowed_groups array<string>, is_latest boolean, release_min int, release_max int, category string")
    post = spark.createDataFrame([(i, "t", float(200 - i)) for i in range(100)], "chunk_id long, token string, weight double")
    asked = spark.createDataFrame([(1, ["public"], None, None)], "qid long, groups array<string>, release int, category string")
    terms = spark.createDataFrame([(1, "t", 1.0)], "qid long, token string, qweight double")
    found = search.sparse(post, points, terms, asked, 30)
    assert [r.chunk_id for r in found.orderBy("rank").collect()] == [2 * i + 1 for i in range(30)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("Window") < plan.index("arrays_overlap")  # printed from the top: the filter is further down


def test_scalar_filters_reach_the_scan(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").where("lang = 'en'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "text" not in plan.split("ReadSchema")[1]


def test_mode_is_checked(spark):
    with pytest.raises(ValueError):
        search.search("other", None, None, None, None)


@pytest.mark.parametrize("query,labels,want", [("How do X differ between MSSQL and Oracle?", ["Oracle"], "How do X differ between MSSQL?"), ("R2019x and R2021x setup", ["R2019x"], "R2021x setup"), ("set up A", ["B"], "set up A")])
def test_without_labels(spark, query, labels, want):
    row = spark.createDataFrame([(query, labels)], "q string, l array<string>")
    assert row.select(dialog.without_labels(F.col("q"), F.col("l")).alias("x")).first().x == want


def ids_one_by_one(drafts, taken):
    """drafts (path, want, split) in turn: the wish, the folder and the wish, the first free number."""
    taken, out = set(taken), {}
    for path, want, _ in sorted(drafts, key=lambda x: (x[2], x[0].split("/"))):
        got = want
        if want in taken:
            folder = re.sub("[^a-z0-9]+", "-", path.rsplit("/", 2)[-2].lower()).strip("-") if "/" in path else ""
            got, n = (f"{folder}-{want}"[:60].rstrip("-") if folder else want), 2
            while got in taken:
                got, n = f"{want[:56]}-{n}", n + 1
        taken.add(got)
        out[path] = got
    return out


@pytest.mark.parametrize("seed", range(3))
def test_ids_are_those_that_one_after_the_other_would_get(spark, seed):
    draw = random.Random(seed)
    words = ["x", "g-x", "x-2", "x-3", "x-2-2", "g-x-2", "h-x", "y", "x" * 58, "x" * 56 + "-3", "x" * 56]
    drafts = [(f"{draw.choice(['g', 'h', 'a b'])}/{i}.pdf" if i % 5 else f"{i}.pdf", draw.choice(words), draw.random() < 0.3) for i in range(70)]
    taken = draw.sample([*words, *(f"x-{n}" for n in range(2, 40)), "x-07", "x-1", "x-5-x", "y-"], 18)
    df = spark.createDataFrame(drafts, "path string, doc_id string, split boolean").withColumn("id", F.lit("clash"))
    got = manifest.unique_ids(df, spark.createDataFrame([(t,) for t in [*taken, None, taken[0]]], "doc_id string"))
    assert {r.path: r.doc_id for r in got.collect()} == ids_one_by_one(drafts, taken)


def test_ids_with_ten_thousand_numbers_taken(spark):
    drafts = spark.range(1_000).select(F.format_string("g/%04d.pdf", "id").alias("path"), F.lit("x").alias("doc_id"))
    taken = spark.range(2, 10_002).where("id % 100 <> 0").select(F.concat(F.lit("x-"), F.col("id").cast("string")).alias("doc_id")).union(spark.sql("SELECT explode(array('x', 'g-x'))"))
    got = {r.path: r.doc_id for r in manifest.unique_ids(drafts, taken).collect()}
    assert [got[f"g/{i:04d}.pdf"] for i in (0, 98, 99, 100, 999)] == ["x-100", "x-9900", "x-10000", "x-10002", "x-10901"]
    assert manifest.unique_ids(drafts.limit(0), taken).count() == 0


def test_labels_are_no_patterns(spark):
    rows = [("set up C++ (x86) or the A.B", ["A.B"], "set up C++ (x86)"), ("set up C++ (x86) or AxB", ["A.B", "C++ (x86)"], "set up or AxB"), ("a \\\\E b versus \\\\Q", ["\\\\E"], "a b versus \\\\Q"), ("x and between or the, y vs. and?", [], "x, y.?")]
    got = spark.createDataFrame([r[:2] for r in rows], "q string, l array<string>").select(dialog.without_labels(F.col("q"), F.col("l")).alias("x")).collect()
    assert [r.x for r in got][0] == rows[0][2] and [r.x for r in got][3] == rows[3][2]


def test_sides_of_replies(spark):
    two = '{"sides": [{"label": "A", "query": "set up the A and B"}, {"label": "B", "query": "set up B"}]}'
    rows = [two, None, "", "[]", '{"sides": 3}', '{"sides": [{"label": "A"}, {"label": "B", "query": "x y"}]}', two.replace('"B"', '"a"'), '{"sides": [{"label": "A", "query": "same words"}, {"label": "B", "query": "Same Words"}]}']
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, reply string").select("i", dialog.parse_sides("reply").alias("s")).orderBy("i").collect()
    assert [(x.label, x.query) for x in got[0].s] == [("A", "set up the A"), ("B", "set up B")]
    assert [len(r.s) for r in got[1:]] == [0, 0, 0, 0, 0, 2, 0]


def test_split_answer_keeps_code_whole():
    code = "```\n" + "x\n\n" * 50 + "```"
    text = "p " * 300 + "\n\n" + code + "\n\n" + "q " * 500
    parts = answers.split_answer(text)
    assert len(parts) > 1 and any(code.strip() in p for p in parts)


def test_tidy_citations(spark):
    want = {"a [1][1] b": "a [1] b", "x [1].\n[1]": "x [1].", "x [1].\n[2]": "x [1].\n[2]", "x [1]. [1]\ny": "x [1].\ny", "x [1]\n[2]\n[1][2]\n": "x [1]\n[2]", "[1]": "[1]", "": ""}
    rows = spark.createDataFrame([(x,) for x in want], "t string").select("t", answers.tidy(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == want


def test_parts_of_an_answer_lose_nothing_and_stay_short():
    import random

    draw = random.Random(1)
    for _ in range(200):
        text = "\n\n".join("w" * draw.randint(1, 60) for _ in range(draw.randint(1, 30)))
        parts = answers.split_answer(text, 100)
        assert "\n\n".join(parts) == text and all(len(p) <= 102 for p in parts)
        assert all(len(a) + len(b.split("\n\n")[0]) > 100 for a, b in zip(parts, parts[1:]))


def test_threshold_counts_missing_scores_as_passed(spark):
    rows = spark.createDataFrame([("a", True, None, True, None, False, True), ("b", True, 0.2, True, None, False, True), ("c", False, 0.1, False, "gate", False, False)], "qid string, answerable boolean, top double, answered boolean, refused_by string, retried boolean, good boolean")
    r = {x.threshold: x for x in evaluation.replay(rows, 0.15, (0.05, 0.3)).collect()}
    assert r[0.3].answers_lost == 1 and r[0.3].llm_calls_saved == 2 and r[0.05].unmeasured == 1


def test_plug_ins_and_stand_ins(spark):
    rows = spark.createDataFrame([("a b", "b c"), (None, "x")], "text string, passage string")
    assert all(len(r.vector) == 64 for r in plugins.embed(rows, plugins.HashEmbedder).collect())
    pairs = rows.select(F.coalesce("text", F.lit("")).alias("question"), "passage")
    got = plugins.rerank_scores(pairs, plugins.WordReranker).withColumn("native", plugins.word_score(F.col("question"), F.col("passage"))).collect()
    assert [r.rerank_score for r in got] == [0.5, 0.0] == [r.native for r in got]
    asked = spark.createDataFrame([("q", "s", "First. Second.")], "qid string, system string, user string")
    assert plugins.generate(asked, plugins.EchoProvider).first().reply == "First [1]."


def test_point_id_is_a_uuid5(spark):
    import uuid

    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    for t in ("a#1#0", "é#2", ""):
        assert one(spark, X.point_id(F.lit(t), ns)) == str(uuid.uuid5(uuid.UUID(ns), t))


def test_empty_tables(spark):
    e = spark.createDataFrame([], "doc_id string, ordinal int, kind string, text string, page int, depth int, rows array<array<string>>")
    assert structure.build_sections(e).count() == 0 and structure.repeated_lines(e).count() == 0 and structure.slide_sections(e).count() == 0
    assert isinstance(structure.list_blocks(e).toPandas(), pd.DataFrame)


class Refuser:
    """Refuses unless there are at most three sources."""

    def generate(self, messages):
        n = messages[-1]["content"].count("\n\n[")
        return "It is so [1][9]." if n <= 3 else answers.NOT_FOUND


def test_answers_gate_retry_and_citations(spark):
    q = spark.createDataFrame([("a", "what?"), ("b", "compare x and y"), ("c", "none?"), ("d", "low?")], "qid string, question string")
    units = spark.createDataFrame([(i, n, "T", "any", "1", 1, 1, f"text {n}") for i, k in (("a", 2), ("b", 5), ("d", 1)) for n in range(1, k + 1)], "qid string, n int, title string, release string, section string, page_start int, page_end int, text string")
    cand = spark.createDataFrame([("a", 1, None), ("b", 1, 0.5), ("d", 1, 0.01)], "qid string, rank int, rerank_score double")
    got = {r.qid: r for r in answering.answer(q, units, cand, Refuser).collect()}
    assert (got["a"].status, got["a"].text, got["a"].cited, got["a"].retried) == ("answered", "It is so [1].", [1], False)
    assert got["b"].retried and got["b"].status == "answered" and got["b"].route.kind == "compare"
    assert got["c"].refused_by == "gate" and got["c"].reason == answering.NO_CONTEXT and "0.010" in got["d"].reason
    off = {r.qid: r for r in answering.answer(q, units, cand, Refuser, retry=False).collect()}
    assert off["b"].refused_by == "llm" and off["b"].text == answers.NOT_FOUND


def test_cache_lookup(spark):
    q = spark.createDataFrame([("a", "what?", "k1"), ("b", "else?", "k2")], "qid string, question string, key string")
    hit, miss = answering.from_cache(q, spark.createDataFrame([("k1", "so")], "key string, answer string"))
    assert [r.qid for r in hit.collect()] == ["a"] and [r.qid for r in miss.collect()] == ["b"]


def test_tracer_schema_and_owned_rows(spark):
    from corpusloom.operators import oplog

    t = oplog.Tracer("t1")
    with t.stage("search"):
        pass
    with pytest.raises(ValueError), t.stage("generate"):
        raise ValueError("no")
    rows = t.frame(spark).orderBy("seq").collect()
    assert [(r.stage, r.error) for r in rows] == [("search", None), ("generate", "ValueError: no")]
    assert oplog.schema_problems(t.frame(spark), "trace_id string, seq long, other int") == ["seq: int instead of bigint", "other: missing"]
    assert oplog.owned(spark.createDataFrame([("s", "a"), ("t", "b")], "session_id string, user_id string"), "a").count() == 1
    p = spark.createDataFrame([("a", "p1", 2), ("a", "p2", 2), ("a", "p3", 1)], "doc_id string, path string, parser_version int")
    assert [r.path for r in oplog.latest_parse(p, 2).collect()] == ["p2"]


def test_comparison_prompts_name_the_sides(spark):
    q = spark.createDataFrame([("a", "x or y?", ["x", "y"]), ("b", "z?", [])], "qid string, question string, sides array<string>")
    u = spark.createDataFrame([(i, 1, "T", "", "1 A", 2, 3, " text ", "x" if i == "a" else "") for i in "ab"], "qid string, n int, title string, release string, section string, page_start int, page_end int, text string, side string")
    got = {r.qid: r.user for r in answering.prompts(q, u, "s").collect()}
    assert "[1] T (applies to all releases) | Section 1 A | pp. 2-3 | found for: x\ntext" in got["a"] and "compares: (A) x; (B) y." in got["a"]
    assert "compares" not in got["b"] and answers.NOT_FOUND in got["b"]


def test_short_passages_equal_the_sql(spark, tmp_path):
    import duckdb

    from corpusloom.plans import evaluate
    from corpusloom.registry import ORACLES
    from tests import oracle

    facts = ["foo bar", "Foo", "oo", "...", "", " bar", "bar baz qux", "absent", "bazinga now", None]
    texts = ["foo barbaz", "a foo bar", "xfoo, bar baz quxx", "nothing ...", "BAZINGA now", "", None]
    spark.createDataFrame(list(enumerate(facts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for q in (evaluate.fact_documents, evaluate.coverage):
        oracle.same(q(spark, str(tmp_path)), con, ORACLES[q.__name__])


def test_a_chain_is_followed_to_its_local_end(spark):
    models = [(f"m{i}", f"m{i + 1}", True, True) for i in range(6)] + [("m6", None, False, True), ("alone", None, True, True), ("keyless", None, True, False)]
    asked = [("open", "m0"), ("closed", "m0"), ("alone", "alone"), ("shut", "alone"), ("keyless", "keyless")]
    m = spark.createDataFrame(models, "name string, fallback string, external boolean, ready boolean")
    r = spark.createDataFrame(asked, "qid string, model string")
    c = spark.createDataFrame([("open", True), ("closed", True), ("closed", False), ("shut", False)], "qid string, external_ok boolean")
    want = [("open", i, f"m{i}") for i in range(7)] + [("closed", 6, "m6"), ("alone", 0, "alone"), ("alone", 1, "m6"), ("shut", 1, "m6"), ("keyless", 1, "m6")]
    assert sorted(map(tuple, answers.fallback_chain(m, r, c).collect())) == sorted(want)
    named = spark.createDataFrame([*models, ("home", None, False, False)], m.schema)
    assert [tuple(x) for x in answers.fallback_chain(named, r.where("qid = 'shut'"), c, local="home").collect()] == [("shut", 1, "home")]


def test_runs_of_commands_in_a_section_are_merged_as_in_a_table(spark):
    import random

    rnd, texts = random.Random(3), ["Run this:", "cd /tmp", "export A=1", "Done.", "<config>", "ls", "SELECT 1"]
    rows = [(f"s{s}", i, rnd.choice(["text", "code", "list"]), rnd.choice(texts), i, i + 1) for s in range(12) for i in range(s)]
    blocks = spark.createDataFrame(rows, "section_id string, ordinal int, kind string, text string, page_start int, page_end int")
    want = {(r.section_id, r.kind, r.text, r.page_start, r.page_end) for r in chunking.merge_commands(blocks).collect()}
    whole = blocks.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "kind", "text", "page_start", "page_end"))).alias("b"))
    made = whole.select("section_id", F.explode(chunking.merge_runs(F.col("b"))).alias("x")).select("section_id", "x.*").collect()
    assert {tuple(r) for r in made} == want and len(made) == chunking.merge_commands(blocks).count()
    assert spark.range(1).select(chunking.merge_runs(F.array().cast("array<struct<kind:string,text:string,page_start:int,page_end:int>>")).alias("x")).first().x == []


def test_hashes_tell_parts_apart(spark):
    from corpusloom.operators import oplog

    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), ("a", ""), (None, "a"), ("", "a")], "x string, y string")
    assert rows.select(oplog.metadata_hash("x", "y").alias("h")).distinct().count() == 6


def test_search_equals_every_pair_scored(spark):
    """Ties, repeated weights, questions without terms or groups, several shards and blocks, against all pairs in Python."""
    import random

    rng = random.Random(5)
    groups = [["all"], ["a"], ["b", "a"], [None], None, ["c"]]
    meta = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(3)] if i % 7 else None, groups[i % 6], i % 5 != 0, 2018 + i % 4, 2020 + i % 3, "xy"[i % 2]) for i in range(120)]
    post = [(i, t, float(rng.randint(1, 3))) for i in range(120) for t in rng.sample("klmnopq", 3)] + [(1, None, 1.0), (2, "k", None)]
    asked = [(1, [1.0, 0.0, 0.5], ["a"], None, None), (2, [0.2, 0.2, 0.2], ["none"], 2021, None), (3, [0.0, 1.0, 0.0], [], None, "x"), (4, [1.0, 1.0, 1.0], None, None, None), (5, [0.5, 0.5, 0.0], ["b"], 2019, "y")]
    terms = [(1, "k", 2.0), (1, "l", 1.0), (2, "zzz", 1.0), (3, "m", 1.0), (3, None, 1.0), (4, "k", 1.0), (5, "q", 0.5), (5, "k", 0.25)]
    kinds = "allowed_groups array<string>, is_latest boolean, release_min int, release_max int, category string"
    points = spark.createDataFrame(meta, f"chunk_id long, vector array<double>, {kinds}")
    requests = spark.createDataFrame(asked, "qid long, vector array<double>, groups array<string>, release int, category string")

    def best(score):
        out = []
        for q, v, who, release, wanted in asked:
            seen = [m for m in meta if who is not None and m[3] and m[2] and {*who, "all"} & {g for g in m[2] if g} and (release is None or m[4] <= release <= m[5]) and wanted in (None, m[6])]
            ranked = sorted((-s, m[0]) for m in seen if (s := score(q, v, m)) is not None)[:6]
            out += [(q, i, round(-s, 9), n) for n, (s, i) in enumerate(ranked, 1)]
        return out

    def words(q, _, m):
        found = [w * x for p, a, w in post for qq, b, x in terms if qq == q and a is not None and a == b and p == m[0] and w is not None]
        return sum(found) if found else None

    def dot(_, v, m):
        return m[1] and round(sum(x * y for x, y in zip(v, m[1])), 12)

    old = search.SHARD, search.SPARSE_SHARD, search.BLOCK
    try:
        for search.SHARD, search.SPARSE_SHARD, search.BLOCK in ((50, 40, 2), old):
            rows = search.sparse(spark.createDataFrame(post, "chunk_id long, token string, weight double"), points.drop("vector"), spark.createDataFrame(terms, "qid long, token string, qweight double"), requests, 6)
            assert sorted((r.qid, r.chunk_id, round(r.score, 9), r["rank"]) for r in rows.collect()) == sorted(best(words))
            rows = search.dense(points, requests, 6)
            assert sorted((r.qid, r.chunk_id, round(r.score, 9), r["rank"]) for r in rows.collect()) == sorted(best(dot))
        assert search.dense(points.where("false"), requests, 6).count() == 0 == search.sparse(spark.createDataFrame([], "chunk_id long, token string, weight double"), points, spark.createDataFrame(terms, "qid long, token string, qweight double"), requests, 6).count()
    finally:
        search.SHARD, search.SPARSE_SHARD, search.BLOCK = old


def test_sparse_search_by_bands_equals_every_pair_scored(spark):
    """A first round of few points, then only bands that can hold a best: repeated tokens, negative and null weights, few hits, rows and lists."""
    rng = random.Random(9)
    post = [(i, t, w) for i in range(300) for t in rng.choices("klmnopqrst", k=4) for w in [rng.choice([1.0, 2.0, -3.0, 0.5, 0.0]) * 1.3 ** (i % 20)]]
    terms = [(q, t, rng.choice([1.0, -1.0, 2.5])) for q in range(12) for t in rng.choices("klmnopqrst", k=q % 5)] + [(20, "zz", 1.0), (21, "k", 1.0)]
    points = spark.createDataFrame([(i, ["all"] if i % 3 else ["a"], i % 7 != 0, 0, 9999, "c") for i in range(300)], "chunk_id long, allowed_groups array<string>, is_latest boolean, release_min int, release_max int, category string")
    asked = spark.createDataFrame([(q, ["a"] if q % 2 else ["b"], None, None) for q in range(21)] + [(21, None, None, None)], "qid long, groups array<string>, release int, category string")
    rows = spark.createDataFrame(post + [(1, None, 1.0), (2, "k", None)], "chunk_id long, token string, weight double")
    lists = spark.createDataFrame([(i, [t for p, t, _ in post if p == i], [w for p, _, w in post if p == i]) for i in range(300)], "chunk_id long, tokens array<string>, weights array<double>")
    wanted = []
    for q in range(21):
        scored = {}
        for i, t, w in post:
            if i % 7 and (i % 3 or q % 2):
                for _, _, x in (y for y in terms if y[:2] == (q, t)):
                    scored[i] = scored.get(i, 0.0) + w * x
        wanted += [(q, i) for i in sorted(scored, key=lambda i: (-round(scored[i], 6), i))[:5]]
    old = search.FIRST, search.SPARSE_SHARD, search.BLOCK
    try:
        for given, search.FIRST, search.SPARSE_SHARD, search.BLOCK in ((rows, 30, 20, 4), (lists, 1, 7, 3), (lists, *old)):
            found = search.sparse(given, points, spark.createDataFrame(terms, "qid long, token string, qweight double"), asked, 5).collect()
            assert sorted((r.qid, r["rank"], r.chunk_id) for r in found) == sorted((q, 1 + sum(x[0] == q for x in wanted[:n]), i) for n, (q, i) in enumerate(wanted))
    finally:
        search.FIRST, search.SPARSE_SHARD, search.BLOCK = old


def test_questions_meet_only_bands_that_may_hold_a_best(spark):
    asks = spark.createDataFrame([(1, 2.0, 8.0), (2, 2.0, None), (3, 2.0, -1.0), (4, 2.0, 20.0)], "qid long, norm double, least double")
    met = search._asking(asks, [(3, 9.0, 2, 1), (2, 4.0, 1, 1), (1, 3.9, 1, 1)]).groupBy("qid").agg(F.sort_array(F.collect_list("band")).alias("b"))
    assert {r.qid: r.b for r in met.collect()} == {1: [2, 3, 3], 2: [1, 2, 3, 3], 3: [1, 2, 3, 3]}


def shuffled(spark) -> int:
    """Bytes that all stages so far wrote for a shuffle."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("mode", ["sparse", "dense"])
def test_points_are_not_shuffled_again_for_each_block_of_questions(spark, monkeypatch, mode):
    rng = random.Random(3)
    meta = "allowed_groups array<string>, is_latest boolean, release_min int, release_max int, category string"
    points = spark.createDataFrame([(i, [rng.random() for _ in range(50)], ["all"], True, 0, 9999, "c") for i in range(400)], f"chunk_id long, vector array<double>, {meta}")
    lists = spark.createDataFrame([(i, [f"w{j}" for j in rng.sample(range(500), 60)], [float(rng.randint(1, 9)) for _ in range(60)]) for i in range(400)], "chunk_id long, tokens array<string>, weights array<double>")
    asked = spark.createDataFrame([(q, [rng.random() for _ in range(50)], ["a"], None, None) for q in range(24)], "qid long, vector array<double>, groups array<string>, release int, category string")
    terms = spark.createDataFrame([(q, f"w{j}", 1.0) for q in range(24) for j in range(q, 500, 24)], "qid long, token string, qweight double")
    monkeypatch.setattr(search, "FIRST", 40)
    moved, found = [], []
    for size in (1000, 1):
        monkeypatch.setattr(search, "BLOCK", size)
        monkeypatch.setattr(search, "DENSE_BLOCK", size)
        before = shuffled(spark)
        hits = search.sparse(lists, points, terms, asked, 5) if mode == "sparse" else search.dense(points, asked, 5)
        found.append(sorted(map(tuple, hits.select("qid", "rank", "chunk_id", "score").collect())))
        moved.append(shuffled(spark) - before)
    assert found[0] == found[1] and len(found[0]) == 24 * 5
    assert moved[1] < 2 * moved[0]


def test_parts_of_points_do_not_grow_with_the_points(spark):
    points = spark.range(0, 640, 1, 64).withColumnRenamed("id", "chunk_id")
    asks = spark.range(5).withColumnRenamed("id", "qid")
    pairs = search._crossed(points, 7, asks, 1000, lambda p, r: pa.table({"n": [len(p)], "asks": [len(r)]}), "n long, asks long")
    assert pairs.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert [tuple(r) for r in pairs.agg(F.sum("n"), F.max("n"), F.min("asks")).collect()] == [(640, 7, 5)]


def test_tokens_are_numbered_or_stay_with_the_same_hits(spark, monkeypatch):
    rng = random.Random(4)
    post = [(i, f"w{j}", rng.choice([1.0, 0.1, 3.7])) for i in range(90) for j in rng.sample(range(40), 9)]
    rows = spark.createDataFrame(post, "chunk_id long, token string, weight double")
    lists = rows.groupBy("chunk_id").agg(F.collect_list("token").alias("tokens"), F.collect_list("weight").alias("weights"))
    points = spark.createDataFrame([(i, ["all"], True, 0, 9999, "c") for i in range(90)], "chunk_id long, allowed_groups array<string>, is_latest boolean, release_min int, release_max int, category string")
    asked = spark.createDataFrame([(q, ["a"], None, None) for q in range(6)], "qid long, groups array<string>, release int, category string")
    terms = spark.createDataFrame([(q, f"w{j}", rng.choice([1.0, 0.3])) for q in range(6) for j in range(q, 20, 3)], "qid long, token string, qweight double")
    found = []
    for given in (rows, lists):
        for many in (0, 1000):
            monkeypatch.setattr(search, "ASKED", many)
            found.append(sorted((r.qid, r["rank"], r.chunk_id, round(r.score, 9)) for r in search.sparse(given, points, terms, asked, 7).collect()))
    assert len(found[0]) == 42 and all(x == found[0] for x in found)
    numbered = search._numbered(lists, pa.array(["w0", "w7"]))
    assert {(r.chunk_id, t, w) for r in numbered.collect() for t, w in zip(r.tokens, r.weights)} == {(i, t == "w7", w) for i, t, w in post if t in ("w0", "w7")}
    assert numbered.count() == 90 and search.sparse(lists, points, terms.where("false"), asked, 7).count() == 0


def test_rows_are_sliced_by_number_band_and_bytes(spark, monkeypatch):
    rows = spark.range(0, 100, 1, 1).select("id", (F.col("id") / 30).cast("int").alias("band"))
    sizes = lambda df, most: [len(r.p) for r in search._sliced(df, most).collect()]
    assert sizes(rows, 20) == [20, 10, 20, 10, 20, 10, 10] and sizes(rows.drop("band"), 40) == [40, 40, 20]
    assert sorted(x.id for r in search._sliced(rows, 7).collect() for x in r.p) == list(range(100))
    monkeypatch.setattr(search, "SHARD_BYTES", 1)
    monkeypatch.setattr(search.tables, "bounded_batches", lambda _: None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        assert sizes(rows, 100)[:4] == [8, 8, 8, 6]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_term_lists_are_term_counts(spark):
    docs = spark.createDataFrame([(1, "A b aK İx 7"), (2, None), (3, ""), (1, "b B")], "doc_id long, text string")
    lists = search.term_lists(docs).select("doc_id", F.explode(F.arrays_zip("tokens", "weights")).alias("x")).groupBy("doc_id", "x.tokens").agg(F.sum("x.weights").alias("n"))
    assert sorted(map(tuple, lists.collect())) == sorted(map(tuple, search.term_counts(docs).collect()))
