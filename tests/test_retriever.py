import pytest
from pyspark.sql import functions as F

from corpusloom.operators import payloads, retriever

META = "allowed_groups array<string>, is_latest boolean, release_min int, release_max int, category string"


@pytest.fixture(scope="module")
def corpus(spark):
    points = spark.createDataFrame([(f"d{i}#1#0", [1.0, i / 10], ["all"] if i != 2 else ["staff"], True, 0, 9999, "c") for i in range(6)], f"chunk_id string, vector array<double>, {META}")
    postings = spark.createDataFrame([(f"d{i}#1#0", "port", float(i + 1)) for i in range(6)], "chunk_id string, token string, weight double")
    requests = spark.createDataFrame([("q", [1.0, 1.0], ["public"], None, None), ("none", [0.0, 0.0], ["public"], 1, "other")], "qid string, vector array<double>, groups array<string>, release int, category string")
    terms = spark.createDataFrame([("q", "port", 1.0)], "qid string, token string, qweight double")
    sections = spark.createDataFrame([(f"d{i}#1", f"text {i} " * 5, 10, 1, 1) for i in range(6)], "section_id string, text string, token_count int, page_start int, page_end int")
    chunks = spark.createDataFrame([(f"d{i}#1#0", f"d{i}#1", f"d{i}", 0, f"text {i}", 10, 1, 1) for i in range(6)], "chunk_id string, section_id string, doc_id string, chunk_index int, text string, token_count int, page_start int, page_end int")
    return requests, terms, retriever.Index(points, postings), sections, chunks


def scorer(c):
    return c.withColumn("rerank_score", F.when(F.col("chunk_id") == "d0#1#0", 0.9).otherwise(0.2))


@pytest.mark.parametrize("mode", ["dense", "sparse", "hybrid"])
def test_forbidden_chunks_are_in_no_candidate_and_no_context(corpus, mode):
    order, units = retriever.retrieve(*corpus, config=retriever.Config("x", mode))
    assert {r.chunk_id for r in order.collect()} == {f"d{i}#1#0" for i in (0, 1, 3, 4, 5)}
    assert {(r.qid, r.section_id) for r in units.collect()} == {("q", f"d{i}#1") for i in (0, 1, 3, 4, 5)}


def test_the_least_score_holds_for_reranked_candidates_only(corpus):
    _, units = retriever.retrieve(*corpus, min_score=0.5)
    assert units.count() == 5
    order, units = retriever.retrieve(*corpus, config=retriever.Config("x", rerank_top=20), scorer=scorer, min_score=0.5)
    assert [r.section_id for r in units.collect()] == ["d0#1"] and order.where("order_rank = 1").first().chunk_id == "d0#1#0"


def test_beyond_the_first_candidates_nothing_is_scored(corpus):
    order, _ = retriever.retrieve(*corpus, config=retriever.Config("x", "dense", rerank_top=2), scorer=scorer)
    rows = order.orderBy("order_rank").collect()
    assert [r.chunk_id[:2] for r in rows] == ["d5", "d4", "d3", "d1", "d0"] and [r.rerank_score for r in rows] == [0.2, 0.2, None, None, None]


def test_front_matter_is_demoted_where_headers_are_known(corpus):
    def with_headers(c):
        return c.withColumns({"rerank_score": F.lit(0.5), "header": F.when(F.col("chunk_id") == "d5#1#0", "G > 0 Executive Summary").otherwise("G > 1")})

    order, _ = retriever.retrieve(*corpus, config=retriever.Config("x", "dense", rerank_top=9), scorer=with_headers)
    assert [r.chunk_id[:2] for r in order.orderBy("order_rank").collect()] == ["d4", "d3", "d1", "d0", "d5"]


def test_a_question_without_hits_counts_under_every_configuration(spark, corpus):
    requests, terms, index, *_ = corpus
    configs = (retriever.Config("dense", "dense"), retriever.Config("hybrid"))
    found = retriever.run(configs, requests, terms, index).withColumns({"doc_id": F.substring("chunk_id", 1, 2), "page_start": F.lit(1), "page_end": F.lit(1)})
    sources = spark.createDataFrame([("q", "d5", 1, 1), ("none", "d5", 1, 1)], "qid string, doc_id string, first int, last int")
    made = retriever.run_eval(configs, found, requests.select("qid", F.lit("lookup").alias("qtype")), sources)
    assert sorted((r.config, r.n, r.recall_1) for r in made.collect()) == [("dense", 2, 0.5), ("hybrid", 2, 0.5)]
    with pytest.raises(ValueError):
        retriever.run((retriever.Config("x", "other"),), requests, terms, index)


def test_stalled(spark):
    rows = spark.createDataFrame([(False, 200.0, 1.0), (True, 200.0, 1.0), (False, 200.0, 20.0), (False, 120.0, 0.0), (False, None, 0.0), (None, 200.0, 1.0)], "c boolean, s double, u double")
    assert [r.x for r in rows.select(payloads.stalled(F.col("c"), F.col("s"), F.col("u")).alias("x")).collect()] == [True, False, False, False, False, False]


def test_context_payload_lists_units_in_order(spark):
    units = spark.createDataFrame([("q", n, f"d{n}", "T", "1", "H", 1, n, "any", 0.123456, 5, "x") for n in (2, 1)], "qid string, n int, doc_id string, title string, section string, heading string, page_start int, page_end int, release string, score double, tokens int, text string")
    (row,) = payloads.context_payload(units).collect()
    assert [(s.n, s.doc_id, s.score) for s in row.sources] == [(1, "d1", 0.1235), (2, "d2", 0.1235)]


def test_every_statement_runs_over_its_tables(spark):
    ddl = {
        "documents": "doc_id string, status string, page_count int, chunk_count int, parse_seconds double, embed_seconds double",
        "sections": "doc_id string, section_id string, heading_path string, page_start int, page_end int, token_count int",
        "traces": "trace_id string, route string, query string, answer string, sources string, top_rerank_score double, gate_decision string, llm_model string, total_ms double, cache_hit int, created_at timestamp",
        "trace_stages": "trace_id string, seq int, stage string, duration_ms double, data string",
        "feedback": "trace_id string, rating int, reason string, comment string",
        "answer_cache": "query_norm string, user_groups string, release_filter string, hit_count int, created_at timestamp, last_hit_at timestamp",
    }
    tables = {name: spark.createDataFrame([], columns) for name, columns in ddl.items()}
    args = {"sections_of": {"doc_id": "it's"}, "stages_of": {"trace_id": "t"}, "recent_traces": {"n": 20}, "recent_answers": {"n": 5}, "cache_hits": {"n": 10}}
    for name in payloads.STATEMENTS:
        assert payloads.inspect(spark, name, tables, **args.get(name, {})).count() == 0


def test_a_reranker_gets_a_questions_passages_together(spark):
    class Counting:
        def score(self, question, passages):
            return [len(passages) + len(p) / 100 for p in passages]

    from corpusloom import plugins

    rows = spark.createDataFrame([("a", "x"), ("b", "yy"), ("a", "zzz"), (None, None)], "question string, passage string").coalesce(1)
    found = {(r.question, r.passage): r.rerank_score for r in plugins.rerank_scores(rows, Counting).collect()}
    assert found == {("a", "x"): 2.01, ("b", "yy"): 1.02, ("a", "zzz"): 2.03, (None, None): 1.0}


def test_a_run_searches_once_for_all_configurations(spark, monkeypatch):
    """Four configurations read hits that were written down: the plan holds no search any more."""
    hits = spark.range(40).selectExpr("id % 4 AS qid", "id AS chunk_id", "1.0D / (id + 1) AS score", "CAST(id DIV 4 + 1 AS INT) AS rank")
    made = hits.mapInPandas(lambda batches: batches, hits.schema)
    monkeypatch.setattr(retriever.search, "dense", lambda *_: made)
    monkeypatch.setattr(retriever.search, "sparse", lambda *_: made)
    configs = tuple(retriever.Config(m, m) for m in ("dense", "sparse", "hybrid")) + (retriever.Config("hybrid+rr", rerank_top=3),)
    found = retriever.run(configs, None, None, retriever.Index(None, None), lambda c: c.withColumn("rerank_score", F.col("score")))
    assert "MapInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.groupBy("config").count().where("count = 40").count() == 4
