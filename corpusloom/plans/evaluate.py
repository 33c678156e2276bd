"""Queries of evaluation and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import evaluation
from corpusloom.plans import derived as D
from corpusloom.registry import query, table


@query("""WITH c AS (SELECT doc_id // 30 qid, (doc_id % 30 + 1)::INT AS rank, source, doc_id % 10 a, doc_id % 10 + doc_id % 3 b FROM documents), s AS (SELECT DISTINCT doc_id // 30 qid, source, doc_id % 5 x, doc_id % 5 + 1 y FROM documents WHERE doc_id % 7 = 0),
  h AS (SELECT qid, min(rank) first_hit, count(DISTINCT CASE WHEN rank <= 5 THEN source END) found FROM c JOIN s USING (qid, source) WHERE a <= y AND b >= x GROUP BY qid), n AS (SELECT qid, count(DISTINCT source) cited FROM s GROUP BY qid)
SELECT qid, CASE WHEN qid % 2 = 0 THEN 'lookup' ELSE 'compare' END AS qtype, first_hit, coalesce(found, 0) = cited AS all_docs FROM n LEFT JOIN h USING (qid)""")
def first_hits(spark, d):
    """Thirty documents as a question's candidates, on pages by their numbers; every seventh is cited."""
    i = F.col("doc_id")
    c = table(spark, d, "documents").select(F.floor(i / 30).alias("qid"), (i % 30 + 1).cast("int").alias("rank"), F.col("source").alias("doc_id"), (i % 10).alias("page_start"), (i % 10 + i % 3).alias("page_end"), (i % 5).alias("first"), (i % 7).alias("seventh"))
    s = c.where("seventh = 0").select("qid", "doc_id", "first", (F.col("first") + 1).alias("last")).distinct()
    q = c.select("qid", F.when(F.col("qid") % 2 == 0, "lookup").otherwise("compare").alias("qtype")).distinct()
    return evaluation.first_hits(c.drop("first", "seventh"), s, q)


@query("SELECT doc_id % 3 AS config, count(*) n, avg(CASE WHEN h <= 1 THEN 1.0::DOUBLE ELSE 0 END) recall_1, avg(CASE WHEN h <= 5 THEN 1.0::DOUBLE ELSE 0 END) recall_5, avg(CASE WHEN h <= 10 THEN 1.0::DOUBLE ELSE 0 END) recall_10, avg(coalesce(1.0::DOUBLE / h, 0)) mrr FROM (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN 1 + doc_id % 12 END h FROM labels) GROUP BY ALL")
def retrieval_summary(spark, d):
    i = F.col("doc_id")
    return evaluation.retrieval_summary(table(spark, d, "labels").select((i % 3).alias("config"), F.when(i % 4 > 0, 1 + i % 12).alias("first_hit")), ["config"])


_FACTS = "SELECT b.item_id, (count(d.doc_id))::BIGINT found FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY b.item_id"


@query(f"WITH f AS ({_FACTS}) SELECT item_id AS qid, CASE WHEN found > 0 THEN []::VARCHAR[] ELSE ['#' || item_id] END AS missing FROM f")
def coverage(spark, d):
    """Each benchmark passage against the documents that share its first long word and hold it."""
    found = fact_documents(spark, d)
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("qid")).join(found.select(F.col("item_id").alias("qid")).distinct().withColumn("_f", F.lit(True)), "qid", "left")
    return b.select("qid", F.when(F.col("_f"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("#"), F.col("qid").cast("string")))).alias("missing"))


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def fact_documents(spark, d):
    """Which documents hold which benchmark passage, whole.

    A passage is looked up by its rarest inner word: documents that hold that word are few, and only
    they are searched for the passage. A passage of fewer than three words has no inner word, so all
    documents are searched for it.
    """
    cut = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    docs = table(spark, d, "documents").select("doc_id", "text")
    words = docs.select("doc_id", F.explode(F.array_distinct(cut(F.col("text")))).alias("word"))
    facts = table(spark, d, "benchmark").select("item_id", F.col("text").alias("fact"))
    inner = F.expr("slice(_w, 2, size(_w) - 2)")  # words at the ends may go on in a document
    facts = facts.withColumn("_w", cut(F.col("fact")))
    short = facts.where("size(_w) < 3").select("item_id", "fact")
    asked = facts.where("size(_w) >= 3").select("item_id", "fact", F.explode(F.array_distinct(inner)).alias("word"))
    known = asked.select("word").distinct()
    often = words.join(known, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "word", "left").groupBy("item_id", "fact").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), F.col("word"))).alias("word"))
    near = words.join(rarest, "word").select("item_id", "doc_id", "fact").distinct()
    holds = F.contains(F.lower("text"), F.lower("fact"))
    return near.join(docs, "doc_id").where(holds).select("item_id", "doc_id").unionByName(docs.join(short, holds).select("item_id", "doc_id")).distinct()


_SCORED = "scored AS (SELECT l.doc_id qid, CASE WHEN l.doc_id % 3 = 0 THEN 'lookup' WHEN l.doc_id % 3 = 1 THEN 'howto' ELSE 'compare' END qtype, quality = 1 answerable, toxic = 0 answered, d.text, l.doc_id % 5 n_cited, l.doc_id % 5 - l.doc_id % 2 * (l.doc_id % 5 > 0)::INT n_correct, (contains(lower(replace(replace(replace(d.text, '`', ''), '*', ''), '_', '')), 'the') )::INT + (contains(lower(d.text), 'zzz'))::INT found FROM labels l JOIN documents d USING (doc_id))"


@query(f"WITH {_SCORED} SELECT qtype, count(*) n, count(*) FILTER (WHERE answerable) answerable, avg(CASE WHEN answerable THEN answered::INT END)::DOUBLE answered, avg(CASE WHEN answerable AND answered THEN found::DOUBLE / 2 END) must_include, avg(CASE WHEN answerable AND answered THEN (found = 2)::INT END)::DOUBLE must_include_all, sum(CASE WHEN answerable AND answered THEN n_correct END)::DOUBLE / nullif(sum(CASE WHEN answerable AND answered THEN n_cited END), 0) citation_precision, avg(CASE WHEN answerable AND answered THEN (NOT regexp_matches(text, '\\[[0-9]+\\]'))::INT END)::DOUBLE no_markers, avg(CASE WHEN NOT answerable THEN (NOT answered)::INT END)::DOUBLE refused FROM scored GROUP BY qtype")
def metrics_by_type(spark, d):
    i = F.col("doc_id")
    a = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").select(
        i.alias("qid"), F.when(i % 3 == 0, "lookup").when(i % 3 == 1, "howto").otherwise("compare").alias("qtype"), (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 0).alias("answered"), "text",
        F.array(F.lit("The"), F.lit("zzz")).alias("must"), (i % 5).alias("n_cited"), (i % 5 - (i % 2) * (i % 5 > 0).cast("int")).alias("n_correct"),
    )
    return evaluation.answer_summary(evaluation.score_answers(a), ["qtype"])


_E = "SELECT event_type, list_sort(list(value)) v FROM events WHERE value IS NOT NULL GROUP BY event_type"


@query(f"WITH e AS ({_E}) SELECT event_type, v[least(len(v) - 1, round_even((len(v) - 1) * 0.5, 0)::BIGINT) + 1] AS p50, v[least(len(v) - 1, round_even((len(v) - 1) * 0.95, 0)::BIGINT) + 1] AS p95 FROM e")
def latency_percentiles(spark, d):
    return evaluation.nearest_rank_by(table(spark, d, "events"), ["event_type"], "value", {"p50": 50, "p95": 95})


@query(f"WITH {D.TURNS}, v AS (SELECT session_id, list_sort(list(length(content)::DOUBLE)) v FROM turns GROUP BY ALL) SELECT session_id, v[round_even((len(v) - 1) * 0.5, 0)::INT + 1] AS p50, v[round_even((len(v) - 1) * 0.95, 0)::INT + 1] AS p95, 0.0::DOUBLE AS none FROM v")
def nearest_ranks(spark, d):
    """Percentiles of the lengths of each conversation's messages."""
    rows = D.turns(spark, d).groupBy("session_id").agg(F.collect_list(F.length("content").cast("double")).alias("v"))
    return rows.select("session_id", evaluation.nearest_rank(F.col("v"), 50).alias("p50"), evaluation.nearest_rank(F.col("v"), 95).alias("p95"), evaluation.nearest_rank(F.array().cast("array<double>"), 50).alias("none"))


@query(f"WITH {D.OUTCOMES} SELECT qid, CASE WHEN qid % 10 = 0 THEN 'no_context' WHEN top < 0.1 THEN 'low_score' ELSE 'pass' END AS decision FROM outcomes")
def gate_decisions(spark, d):
    return D.outcomes(spark, d).select("qid", evaluation.gate(F.col("qid") % 10, F.col("top"), 0.1).alias("decision"))


_T = "t AS (SELECT unnest([0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) threshold)"
_R = "r AS (SELECT *, coalesce(top < threshold, false) cut, NOT coalesce(top < threshold, false) AND coalesce(refused_by, '') = 'gate' AND coalesce(top < 0.3, false) unknown FROM outcomes, t)"


@query(f"WITH {D.OUTCOMES}, {_T}, {_R} SELECT threshold, count(*) FILTER (WHERE cut AND answerable AND answered) answers_lost, count(*) FILTER (WHERE cut AND answerable AND good) good_lost, count(*) FILTER (WHERE (cut AND answerable) OR (NOT cut AND NOT unknown AND answerable AND NOT answered)) wrong_refusals, count(*) FILTER (WHERE cut AND NOT answerable) unanswerable_gate, count(*) FILTER (WHERE NOT cut AND NOT unknown AND NOT answerable AND NOT answered) unanswerable_llm, count(*) FILTER (WHERE NOT cut AND NOT unknown AND NOT answerable AND answered) let_through, count(*) FILTER (WHERE cut) llm_calls_saved, count(*) FILTER (WHERE NOT cut AND NOT unknown AND retried AND answered) retry_rescues, count(*) FILTER (WHERE unknown) unmeasured FROM r GROUP BY threshold")
def threshold_replay(spark, d):
    return evaluation.replay(D.outcomes(spark, d), 0.3)


@query(f"WITH {D.OUTCOMES}, l AS (SELECT min(top) lowest FROM outcomes WHERE answerable AND answered AND top > 0.2), h AS (SELECT max(top) highest FROM outcomes, l WHERE NOT answerable AND top < lowest) SELECT CASE WHEN highest IS NULL THEN least(0.1, round(lowest / 2, 2)) ELSE round_even((highest + lowest) / 2, 2) END AS threshold, lowest, highest FROM l, h")
def recommend_threshold(spark, d):
    return evaluation.recommend(D.outcomes(spark, d).where("not (answerable and coalesce(top, 0) <= 0.2)"), 0.1)


@query(f"WITH {D.OUTCOMES} SELECT qid, top FROM outcomes WHERE answerable AND refused_by = 'llm' AND coalesce(top, 0) >= 0.5")
def high_score_refusals(spark, d):
    return evaluation.high_score_refusals(D.outcomes(spark, d))


@query(f"WITH {D.OUTCOMES}, f AS (SELECT *, CASE WHEN qid % 3 = 0 THEN 'should_have_answered' WHEN qid % 3 = 1 THEN 'should_have_refused' END reason, CASE WHEN top < 0.3 THEN 'low_score' ELSE 'pass' END gate FROM outcomes WHERE qid % 2 = 0) SELECT coalesce(reason, 'no reason') AS reason, count(*) n, count(*) FILTER (WHERE reason = 'should_have_answered' AND gate = 'low_score') refused_by_gate, count(*) FILTER (WHERE reason = 'should_have_refused' AND answered AND top < 0.4) catchable, count(*) FILTER (WHERE reason = 'should_have_refused' AND answered AND top >= 0.4) above FROM f GROUP BY ALL")
def feedback_summary(spark, d):
    i = F.col("qid")
    r = D.outcomes(spark, d).select(F.when(i % 2 == 0, -1).otherwise(1).alias("rating"), F.when(i % 3 == 0, "should_have_answered").when(i % 3 == 1, "should_have_refused").alias("reason"), "top", F.when(F.col("top") < 0.3, "low_score").otherwise("pass").alias("gate"), "answered")
    return evaluation.feedback_summary(r, 0.4)


_GOLDEN = """golden AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'lookup' WHEN 1 THEN 'howto' WHEN 2 THEN 'compare' WHEN 3 THEN 'unanswerable' ELSE 'other' END kind, doc_id % 3 > 0 cites, doc_id % 2 = 0 held FROM documents)"""


@query(f"""WITH {_GOLDEN} SELECT doc_id AS qid, 'unknown type' AS problem FROM golden WHERE kind = 'other' UNION ALL SELECT doc_id, 'no sources' FROM golden WHERE kind IN ('lookup', 'howto', 'compare') AND NOT cites
UNION ALL SELECT doc_id, 'sources of an unanswerable question' FROM golden WHERE kind = 'unanswerable' AND cites UNION ALL SELECT doc_id, 'a fact is not in the expected answer' FROM golden WHERE NOT held""")
def golden_problems(spark, d):
    """Every document as a golden question that asks for its number; some are of no kind, without sources, or without the fact."""
    i = F.col("doc_id")
    kind = F.when(i % 5 == 0, "lookup").when(i % 5 == 1, "howto").when(i % 5 == 2, "compare").when(i % 5 == 3, "unanswerable").otherwise("other")
    fact = F.concat(F.lit("port "), i.cast("string"))
    rows = table(spark, d, "documents").select(
        i.alias("qid"), kind.alias("type"), F.array(fact).alias("must_include"), F.when(i % 2 == 0, F.concat(F.lit("It is **Port "), i.cast("string"), F.lit("**."))).otherwise("nothing").alias("expected_answer"),
        F.when(i % 3 > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("sources"),
    )
    return evaluation.golden_problems(rows)


@query(f"""WITH {D.LINES}, m AS (SELECT doc_id, unnest(['The', 'zzz', lang]) must FROM documents), f AS (SELECT m.doc_id, must, coalesce(bool_or(contains(lower(line), lower(must))), false) found, count(line) c FROM m LEFT JOIN lines l ON l.doc_id = m.doc_id AND page = 1 GROUP BY ALL)
SELECT doc_id AS qid, coalesce(list_sort(list(must) FILTER (NOT found)), []) AS missing, max(c)::INT n_chunks FROM f GROUP BY doc_id""")
def page_coverage(spark, d):
    """Whether the lines of each document's first page hold three words."""
    docs = table(spark, d, "documents")
    g = docs.select(F.col("doc_id").alias("qid"), F.array(F.lit("The"), F.lit("zzz"), F.col("lang")).alias("must_include"))
    s = docs.select(F.col("doc_id").alias("qid"), "doc_id", F.lit(1).alias("first"), F.lit(1).alias("last"))
    c = D.lines(spark, d).select("doc_id", F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.col("line").alias("text"))
    return evaluation.coverage(g, s, c).withColumn("n_chunks", F.col("n_chunks").cast("int"))


@query(f"WITH {D.OUTCOMES} SELECT CASE WHEN GROUPING(answerable) = 1 THEN 'all' WHEN answerable THEN 'answerable' ELSE 'unanswerable' END AS kind, count(*) n, avg(answered::INT)::DOUBLE answered FROM outcomes GROUP BY GROUPING SETS ((answerable), ())")
def overall_and_by_kind(spark, d):
    o = D.outcomes(spark, d)
    return o.rollup("answerable").agg(F.count("*").alias("n"), F.avg(F.col("answered").cast("double")).alias("answered"), F.grouping("answerable").alias("_g")).select(F.when(F.col("_g") == 1, "all").when(F.col("answerable"), "answerable").otherwise("unanswerable").alias("kind"), "n", "answered")


@query("SELECT qid % 3 AS config, avg(CASE WHEN quality = 1 THEN (toxic = 0)::INT END)::DOUBLE context_recall, avg(CASE WHEN quality = 1 AND qid % 2 = 0 THEN (qid % 5 > 0)::INT END)::DOUBLE all_docs_5, min(CASE WHEN quality = 1 AND qid % 4 = 0 THEN score END) right_min, median(CASE WHEN quality = 1 AND qid % 4 = 0 THEN score END) right_median, max(CASE WHEN quality = 0 THEN score END) unanswerable_max FROM (SELECT doc_id qid, quality, toxic, " + D.SCORE + " score FROM labels) GROUP BY ALL")
def retrieval_details(spark, d):
    i = F.col("doc_id")
    h = table(spark, d, "labels").select((i % 3).alias("config"), F.when(i % 2 == 0, "compare").otherwise("lookup").alias("qtype"), (F.col("quality") == 1).alias("answerable"), (1 + i % 4).alias("first_hit"), (F.col("toxic") == 0).alias("context_hit"), (i % 5 > 0).alias("all_docs"), ((i * 7919 % 1000).cast("double") / 1000).alias("top_score"))
    return evaluation.retrieval_details(h, ["config"])
