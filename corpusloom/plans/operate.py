"""Queries of sessions, traces, cache and events, and relational checks on the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import dialog, evaluation, oplog, payloads
from corpusloom.plans import derived as D
from corpusloom.registry import query, table


@query(f"WITH {D.TURNS}, s AS (SELECT session_id, arg_min(content, turn) FILTER (WHERE role = 'user') t, count(*) n_messages FROM turns GROUP BY session_id) SELECT session_id, CASE WHEN length(t) > 80 THEN rtrim(substr(t, 1, 80)) || '…' ELSE t END AS title, n_messages FROM s")
def session_list(spark, d):
    return oplog.sessions(D.turns(spark, d))


@query(f"WITH {D.TURNS} SELECT session_id, turn, role, l.quality rating, e.event_type AS stage FROM turns LEFT JOIN labels l ON l.doc_id = session_id AND role = 'assistant' LEFT JOIN events e ON e.event_id = session_id")
def message_join(spark, d):
    t = D.turns(spark, d)
    ratings = table(spark, d, "labels").select(F.col("doc_id").alias("session_id"), F.lit("assistant").alias("role"), F.col("quality").alias("rating"))
    stages = table(spark, d, "events").select(F.col("event_id").alias("session_id"), F.col("event_type").alias("stage"))
    return t.join(ratings, ["session_id", "role"], "left").join(stages, "session_id", "left").select("session_id", "turn", "role", "rating", "stage")


@query("SELECT user_id, event_type AS stage, round(sum(value::DECIMAL(24,6)), 1)::DOUBLE total_ms FROM events GROUP BY ALL")
def trace_stage_timings(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("stage"), F.col("value").alias("duration_ms"))
    return oplog.stage_timings(e, ["user_id", "stage"])


@query("SELECT value FROM events WHERE event_type IN ('click', 'purchase') AND coalesce(user_id, 0) <> 1")
def live_scores(spark, d):
    return table(spark, d, "events").where("event_type IN ('click', 'purchase') AND coalesce(user_id, 0) <> 1").select("value")


_ENTRIES = "entries AS (SELECT lower(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[?!. ]+$', '')) question, count(*) - 1 hits FROM conversations WHERE role = 'user' GROUP BY ALL)"


def _entries(spark, d):
    from corpusloom.functions import text as X

    return table(spark, d, "conversations").where("role = 'user'").groupBy(X.question_key(F.col("text")).alias("question")).agg((F.count("*") - 1).alias("hits"))


@query(f"WITH {_ENTRIES} SELECT count(*) entries, sum(hits)::BIGINT hits, count(*) FILTER (WHERE hits > 0) used, max(hits) most FROM entries")
def cache_stats(spark, d):
    return oplog.cache_stats(_entries(spark, d))


@query(f"WITH {_ENTRIES} SELECT question, hits FROM entries ORDER BY hits DESC, question LIMIT 10")
def cache_top(spark, d):
    return oplog.top_entries(_entries(spark, d))


@query("SELECT doc_id AS trace_id, lang AS answer FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)")
def cache_forgets(spark, d):
    entries = table(spark, d, "documents").select(F.col("doc_id").alias("trace_id"), F.col("lang").alias("answer"))
    return oplog.without_traces(entries, table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("trace_id")))


@query("WITH a AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) event_id FROM events GROUP BY ALL) SELECT user_id, event_type, value, event_id FROM a")
def feedback_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return oplog.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value", "event_id")


@query("SELECT doc_id, CASE WHEN l.toxic IS NOT NULL THEN 'new' ELSE 'old' END AS state FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 0 toxic FROM labels) l USING (doc_id)")
def replace_document_rows(spark, d):
    stored = table(spark, d, "documents").select("doc_id", F.lit("old").alias("state"))
    new = stored.join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit("new").alias("state"))
    return oplog.replace_rows(stored, new, "doc_id")


@query("SELECT lang AS status, count(*) n, sum(n_chars)::BIGINT chars FROM documents GROUP BY lang")
def status_counts(spark, d):
    return table(spark, d, "documents").groupBy(F.col("lang").alias("status")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT event_type, date_trunc('hour', ts) + INTERVAL (0) HOUR AS hour, count(*) n, round(sum(value), 4) total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END fresh FROM events), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) s FROM o) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) n FROM r GROUP BY user_id, s")
def events_sessions(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))
    return s.select("user_id", "started", "ended", "n")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2)::DOUBLE sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE revenue, count(*) n FROM lineitem GROUP BY ALL")
def lineitem_summary(spark, d):
    t = table(spark, d, "lineitem")
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).cast("double").alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, count(DISTINCT o_orderkey) orders, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark, d):
    c, o, l, n = (table(spark, d, x) for x in ("customer", "orders", "lineitem", "nation"))
    per = l.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))  # before the join: one row an order
    j = o.join(per, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("r"), 2).cast("double").alias("revenue"))


@query(f"WITH {D.MANIFEST} SELECT m.doc_id, item_id FROM manifest m JOIN benchmark b ON b.item_id = m.doc_id WHERE m.doc_id % 9 <> 0 AND list_has_any(allowed_groups, ['partners', 'all'])")
def visible_sections(spark, d):
    docs = D.manifest(spark, d).withColumn("is_latest", F.col("doc_id") % 9 != 0)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "item_id")
    return dialog.visible(items, docs, F.array(F.lit("partners")))


@query(f"WITH {D.MANIFEST} SELECT doc_id FROM manifest WHERE NOT list_has_any(allowed_groups, ['all']) OR 2024 NOT BETWEEN release_min AND release_max")
def leak_check(spark, d):
    m = D.manifest(spark, d)
    return evaluation.leaks(m.select("doc_id"), m, F.array(F.lit("public")), F.lit(2024)).select("doc_id")


@query("SELECT 0 AS leaked")
def leak_check_of_search(spark, d):
    """What hybrid search returns to the public holds nothing the public may not see."""
    from corpusloom.plans.retrieve import hybrid_search

    public = D.requests(spark, d).where(F.array_contains("groups", "public")).select("qid")
    found = hybrid_search(spark, d).join(public, "qid", "left_semi")
    return evaluation.leaks(found, D.manifest(spark, d), F.array(F.lit("public"))).agg(F.count("*").cast("int").alias("leaked"))


@query(f"WITH {D.MANIFEST} SELECT list_sort(list_distinct(list_append(flatten(list(allowed_groups)), 'all'))) AS groups FROM manifest")
def every_group(spark, d):
    return evaluation.every_group(D.manifest(spark, d))


@query(f"WITH {D.TURNS} SELECT session_id, turn, l.quality AS rating, d.lang AS route FROM turns LEFT JOIN documents d ON d.doc_id = session_id * 10 + turn LEFT JOIN labels l ON l.doc_id = session_id * 10 + turn AND l.toxic = 0")
def message_list(spark, d):
    t = D.turns(spark, d).withColumn("trace_id", F.col("session_id") * 10 + F.col("turn"))
    traces = table(spark, d, "documents").select(F.col("doc_id").alias("trace_id"), F.col("lang").alias("route"), F.col("source").alias("sources"))
    feedback = table(spark, d, "labels").select(F.col("doc_id").alias("trace_id"), F.when(F.col("toxic") == 0, "me").otherwise("you").alias("user_id"), F.col("quality").alias("rating"), F.lit(None).cast("string").alias("reason"))
    return oplog.messages(t, traces, feedback, "me").select("session_id", "turn", "rating", "route")


@query("SELECT event_id, round(value * 20, 6) AS seconds FROM events WHERE event_id % 5 <> 0 AND value * 20 > 120 AND value * 20 * ((event_id % 20)::DOUBLE / 100) < 0.1::DOUBLE * (value * 20)")
def stalled_parses(spark, d):
    """Events as parses: their values as wall time, a share of it as CPU time, every fifth from the cache."""
    i, wall = F.col("event_id"), F.col("value") * 20
    parses = table(spark, d, "events").where(payloads.stalled(i % 5 == 0, wall, wall * ((i % 20).cast("double") / 100)))
    return parses.select("event_id", F.round(wall, 6).alias("seconds"))


@query(f"WITH {D.MANIFEST}, {D.LINES} SELECT l.doc_id || '#0#' || pos AS chunk_id, '0' AS section_number, pos AS chunk_index, md5(line) AS text_md5, page AS page_start, 'c3.words.' || substr(md5(m.text), 1, 12) AS index_version, family, version, release_min, allowed_groups, external_ok, category FROM lines l JOIN manifest m USING (doc_id)")
def chunk_payloads(spark, d):
    """Every line of the documents as a chunk, with the payload its point would carry."""
    chunk = D.lines(spark, d).select("doc_id", F.concat_ws("#", "doc_id", F.lit("0"), "pos").alias("chunk_id"), F.concat_ws("#", "doc_id", F.lit("0")).alias("section_id"), F.col("pos").alias("chunk_index"), F.lit("").alias("header"), F.col("line").alias("text"), F.lit("text").alias("content_type"), F.col("page").alias("page_start"), F.col("page").alias("page_end"), F.lit(1).alias("token_count"))
    made = payloads.chunk_payload(chunk, D.manifest(spark, d), payloads.index_version(F.md5("text"), 3, "words"))
    names = ("section_number", "chunk_index", "page_start", "index_version", "family", "version", "release_min", "allowed_groups", "external_ok", "category")
    return made.select("chunk_id", F.md5("payload.text").alias("text_md5"), *(F.col(f"payload.{c}").alias(c) for c in names))


@query("SELECT l.quality rating, l.toxic reason, e.event_type AS query, e.value AS top_rerank_score FROM labels l JOIN events e ON e.event_id = l.doc_id")
def rated_traces(spark, d):
    """The documented join of ratings and traces, with labels as ratings of events."""
    e = table(spark, d, "events").select(F.col("event_id").alias("trace_id"), F.col("event_type").alias("query"), F.col("value").alias("top_rerank_score"), F.lit("pass").alias("gate_decision"))
    r = table(spark, d, "labels").select(F.col("doc_id").alias("trace_id"), F.col("quality").alias("rating"), F.col("toxic").alias("reason"), F.lit("").alias("comment"))
    return payloads.inspect(spark, "rated", {"traces": e, "feedback": r}).select("rating", "reason", "query", "top_rerank_score")
