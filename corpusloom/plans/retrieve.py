"""Queries of search, ranking, context and dialogue."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import tables
from corpusloom.functions import text as X
from corpusloom.operators import answering, answers, context, dialog, evaluation, oplog, retriever, search
from corpusloom.plans import derived as D
from corpusloom.plans.ingest import document_chunks, values
from corpusloom.registry import query, table

_SEES = "doc_id % 9 <> 0 AND list_has_any(allowed_groups, list_append(user_groups, 'all')) AND (wanted IS NULL OR (release_min <= wanted AND release_max >= wanted))"
_ASKED = "asked AS (SELECT r.qid, r.user_groups, r.wanted, p.token, p.weight qw FROM requests r JOIN postings p ON p.doc_id = r.qid)"
_SPARSE = f"sums AS (SELECT qid, p.doc_id, user_groups, wanted, sum(qw * p.weight) score FROM asked JOIN postings p USING (token) GROUP BY ALL), sparse AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM sums JOIN manifest USING (doc_id) WHERE {_SEES})"
_DENSE = f"pairs AS (SELECT r.qid, m.doc_id, round(list_sum(list_transform(list_zip(r.embedding, e.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 12) score FROM requests r JOIN embeddings e ON true JOIN manifest m ON m.doc_id = e.vec_id WHERE {_SEES}), dense AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM pairs)"


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """Words of the questions alone: their documents are picked before any text is cut into words."""
    asked = table(spark, d, "documents").join(D.requests(spark, d).select(F.col("qid").alias("doc_id")), "doc_id", "left_semi")
    return search.term_counts(asked).select(F.col("doc_id").alias("qid"), "token", F.col("weight").alias("qweight"))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return search.term_lists(table(spark, d, "documents")).withColumnRenamed("doc_id", "chunk_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return D.points(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vector")), "chunk_id", "left")


def _hits(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select("qid", F.col("chunk_id").alias("doc_id"), F.round("score", digits).alias("score"), F.col("rank").cast("int").alias("rank"))


def _sparse(spark: SparkSession, d: str, limit: int) -> DataFrame:
    return search.sparse(_postings(spark, d), D.points(spark, d), _terms(spark, d), D.requests(spark, d), limit)


@query(f"WITH {D.MANIFEST}, {D.TERMS}, {D.REQUESTS}, {_ASKED}, {_SPARSE}, {_DENSE}, f AS (SELECT qid, doc_id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) score FROM (SELECT * FROM dense WHERE rank <= 50) a FULL JOIN (SELECT * FROM sparse WHERE rank <= 50) b USING (qid, doc_id)), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f) SELECT qid, doc_id, round(score, 9) score, rank::INT AS rank FROM k WHERE rank <= 30")
def hybrid_search(spark, d):
    """Every hundredth vector's document as a question, over all documents it may see."""
    return _hits(search.search("hybrid", _vectors(spark, d), _postings(spark, d), _terms(spark, d), D.requests(spark, d)))


@query(f"WITH {D.MANIFEST}, {D.REQUESTS}, {_DENSE} SELECT qid, doc_id, round(score, 9) score, rank::INT AS rank FROM dense WHERE rank <= 30")
def dense_topk(spark, d):
    return _hits(search.dense(_vectors(spark, d), D.requests(spark, d), 30))


@query(f"WITH {D.MANIFEST}, {D.TERMS}, {D.REQUESTS}, {_ASKED}, {_SPARSE} SELECT qid, doc_id, round(score, 9) score, rank::INT AS rank FROM sparse WHERE rank <= 30")
def sparse_topk(spark, d):
    return _hits(_sparse(spark, d, 30))


@query(f"WITH {D.MANIFEST} SELECT id FROM manifest WHERE doc_id % 9 <> 0 AND list_has_any(allowed_groups, ['partners', 'all']) AND release_min <= 2024 AND release_max >= 2024 AND category = 'installation'")
def access_filtered_search(spark, d):
    request = F.array(F.lit("partners"))
    m = D.manifest(spark, d).withColumn("is_latest", F.col("doc_id") % 9 != 0).withColumns({"r_groups": request, "r_release": F.lit(2024), "r_category": F.lit("installation")})
    return m.where(search.access("", "r_")).select("id")


_CAND = f"cand AS (SELECT doc_id // 30 qid, doc_id % 30 + 1 AS rank, doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE {D.SCORE} END rr, CASE WHEN doc_id % 6 = 0 THEN 'Guide > 0 Executive Summary' ELSE 'Guide > 3 Ports' END AS header FROM documents)"


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "documents").select(F.floor(i / 30).alias("qid"), (i % 30 + 1).alias("rank"), "doc_id", F.when(i % 13 == 0, None).otherwise((i * 7919 % 1000).cast("double") / 1000).alias("rerank_score"), F.when(i % 6 == 0, "Guide > 0 Executive Summary").otherwise("Guide > 3 Ports").alias("header"))


@query(f"WITH {_CAND}, c AS (SELECT *, CASE WHEN rank <= 20 THEN rr END s FROM cand) SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC NULLS LAST, rank)::INT new_rank FROM c")
def rerank_order(spark, d):
    return search.rerank(_candidates(spark, d)).select("qid", "doc_id", F.col("new_rank").cast("int").alias("new_rank"))


@query(f"WITH {_CAND} SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY rr * CASE WHEN doc_id % 6 = 0 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END DESC NULLS LAST, rank)::INT order_rank FROM cand")
def front_matter_demotion(spark, d):
    return search.demote_front_matter(_candidates(spark, d)).select("qid", "doc_id", F.col("order_rank").cast("int").alias("order_rank"))


@query(f"WITH c AS (SELECT doc_id // 30 qid, doc_id % 17 chunk_id, doc_id seen, CASE WHEN doc_id % 2 = 0 THEN {D.SCORE} END rr, 0.5::DOUBLE score FROM documents), b AS (SELECT *, coalesce(rr, score) best, min(seen) OVER (PARTITION BY qid, chunk_id) fs, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY coalesce(rr, score) DESC, seen) i FROM c) SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY (rr IS NOT NULL) DESC, best DESC, fs)::INT AS rank FROM b WHERE i = 1")
def side_candidates(spark, d):
    i = F.col("doc_id")
    c = table(spark, d, "documents").select(F.floor(i / 30).alias("qid"), (i % 17).alias("chunk_id"), i.alias("seen"), F.when(i % 2 == 0, (i * 7919 % 1000).cast("double") / 1000).alias("rerank_score"), F.lit(0.5).alias("score"))
    return search.best_of_sides(c).select("qid", "chunk_id", F.col("rank").cast("int").alias("rank"))


_CHUNKS = f"{D.LINES}, chunks AS (SELECT doc_id section_id, pos chunk_index, line AS text, (len(string_split(trim(line), ' ')))::INT token_count, page FROM lines)"


def _line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return D.lines(spark, d).select(F.col("doc_id").alias("section_id"), F.concat_ws("#", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("chunk_id"), F.col("pos").alias("chunk_index"), F.col("line").alias("text"), F.size(F.split(F.trim("line"), " ")).alias("token_count"), F.col("page").alias("page_start"), F.col("page").alias("page_end"))


@query(f"WITH {_CHUNKS} SELECT section_id, chunk_index, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) OVER w) AS window_md5, (sum(token_count) OVER w)::BIGINT tokens, min(page) OVER w page_start, max(page) OVER w page_end FROM chunks WINDOW w AS (PARTITION BY section_id ORDER BY chunk_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def neighbour_windows(spark, d):
    return context.neighbours(_line_chunks(spark, d)).select("section_id", "chunk_index", F.md5("window_text").alias("window_md5"), "tokens", "page_start", "page_end")


@query(f"WITH {_CHUNKS}, r AS (SELECT *, sum(token_count) OVER (PARTITION BY section_id ORDER BY chunk_index) upto, row_number() OVER (PARTITION BY section_id ORDER BY chunk_index) i FROM chunks) SELECT section_id, chunk_index, upto::BIGINT upto FROM r WHERE i = 1 OR upto <= 100")
def section_prefix_budget(spark, d):
    return context.section_prefix(_line_chunks(spark, d), 100).select("section_id", "chunk_index", "upto")


@query("""SELECT doc_id, least(16, round_even(t::DOUBLE / 3000 * 6, 0))::INT max_units, t AS max_tokens, least(8, round_even(t::DOUBLE / 3000 * 3, 0))::INT per_side, round_even(t::DOUBLE / 3000 * 4000, 0)::INT compare_tokens
FROM (SELECT doc_id, least(12000, greatest(3000, (2000 + length(text) * 20 - (doc_id % 8) * 1000) // 4))::INT t FROM documents)""")
def context_budgets(spark, d):
    rows = table(spark, d, "documents").select("doc_id", context.budget(2000 + F.length("text") * 20, ((F.col("doc_id") % 8) * 1000).cast("int")).alias("b"))
    return rows.select("doc_id", "b.*")


@query()
def assemble_context(spark, d):
    """Context of each question: the candidates of hybrid search over all documents, their chunks and sections."""
    hits = tables.cut(hybrid_search(spark, d))
    docs = table(spark, d, "documents").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")  # picked before they are cut
    chunks = document_chunks(spark, d, docs).withColumn("doc_id", F.split("section_id", "#")[0])
    sections = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit("#0")).alias("section_id"), "text", X.count_words(F.col("text")).alias("token_count"), F.lit(1).alias("page_start"), (1 + F.floor((F.size(F.split("text", "\n")) - 1) / 20)).cast("int").alias("page_end"))
    found = hits.select(F.col("qid").cast("string").alias("qid"), F.col("rank").alias("order_rank"), F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("double").alias("rerank_score"))
    candidates = found.withColumns({"section_id": F.concat("doc_id", F.lit("#0")), "chunk_index": F.lit(0)}).withColumn("chunk_id", F.concat("section_id", F.lit("#0")))
    return context.assemble(candidates, sections, chunks).select("qid", "n", "section_id", "kind", "tokens", "lo", "hi", "chunk_ids", "same_text")


#: Documents in questions of twelve, three sides of four units each; copies of a text are near-identical, and some hold others' copies already.
_SIDES = """WITH RECURSIVE d AS (SELECT doc_id, doc_id // 12 qid, (doc_id % 12) % 3 side_index, 1 + (doc_id % 12) // 3 n, 'Section ' || (doc_id % 5) || ' of ' || (doc_id // 12) AS text, 100 * (1 + doc_id % 7) tokens,
   CASE WHEN doc_id % 4 = 0 THEN [doc_id + 1000000, doc_id // 12] ELSE []::BIGINT[] END copies, 's' || (doc_id % 9) section_id FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n, side_index) i FROM d),
f AS (SELECT qid, 0::BIGINT i, []::STRUCT(doc_id BIGINT, side BIGINT, section_id VARCHAR, tokens BIGINT, copies BIGINT[], "text" VARCHAR)[] made FROM (SELECT DISTINCT qid FROM d)
  UNION ALL
  SELECT qid, i, CASE WHEN len(list_filter(made, lambda m: m.side = side_index)) >= 3 OR list_contains(list_transform(made, lambda m: m.section_id), section_id) THEN made
    WHEN twin IS NOT NULL THEN list_transform(made, lambda m: CASE WHEN m.doc_id <> twin.doc_id THEN m ELSE struct_pack(doc_id := m.doc_id, side := m.side, section_id := m.section_id, tokens := m.tokens,
         copies := list_reduce(list_prepend(m.copies, list_transform(list_prepend(doc_id, copies), lambda c: [c])), lambda x, y: CASE WHEN y[1] = m.doc_id OR list_contains(x, y[1]) THEN x ELSE x || y END), "text" := m.text) END)
    WHEN coalesce(list_sum(list_transform(made, lambda m: m.tokens)), 0) + tokens <= 2500 THEN list_append(made, struct_pack(doc_id := doc_id, side := side_index, section_id := section_id, tokens := tokens, copies := copies, "text" := text)) ELSE made END
  FROM (SELECT f.qid, o.i, f.made, o.* EXCLUDE (qid, i), list_filter(f.made, lambda m: m.text = o.text)[1] twin FROM f JOIN o ON o.qid = f.qid AND o.i = f.i + 1)),
e AS (SELECT qid, arg_max(made, i) made FROM f GROUP BY qid)
SELECT qid, n::INT AS n, m.side::VARCHAR AS side, m.doc_id AS doc_id, m.tokens AS tokens, m.copies AS copies FROM (SELECT qid, unnest(made) m, unnest(range(1, len(made) + 1)) n FROM e)"""


@query(_SIDES)
def merge_sides(spark, d):
    i = F.col("doc_id")
    text = lambda c: c.cast("string")
    one = F.concat(F.lit("Section "), text(i % 5), F.lit(" of "), text(F.floor(i / 12)))
    units = table(spark, d, "documents").select(i.alias("doc_id"), F.floor(i / 12).alias("qid"), text(i % 12 % 3).alias("side"), (i % 12 % 3).alias("side_index"), (1 + F.floor(i % 12 / 3)).alias("n"), one.alias("text"), (100 * (1 + i % 7)).alias("tokens"),
        F.when(i % 4 == 0, F.array(i + 1_000_000, F.floor(i / 12))).otherwise(F.array().cast("array<bigint>")).alias("copies"), F.concat(F.lit("s"), text(i % 9)).alias("section_id"))
    return context.merge_sides(units, per_side=3, tokens=2_500).select("qid", "n", "side", "doc_id", "tokens", "copies")


_FIT = """WITH RECURSIVE units AS (SELECT session_id, turn, (len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')))::INT n, row_number() OVER (PARTITION BY session_id ORDER BY turn) i FROM turns),
  f AS (SELECT session_id, i, CASE WHEN n <= 60 THEN 1 ELSE 0 END k, CASE WHEN n <= 60 THEN n ELSE 0 END used, n <= 60 AS fits, turn FROM units WHERE i = 1
        UNION ALL SELECT u.session_id, u.i, f.k + (f.k < 3 AND f.used + u.n <= 60)::INT, f.used + CASE WHEN f.k < 3 AND f.used + u.n <= 60 THEN u.n ELSE 0 END, f.k < 3 AND f.used + u.n <= 60, u.turn FROM f JOIN units u ON u.session_id = f.session_id AND u.i = f.i + 1)
SELECT session_id, turn FROM f WHERE fits"""


@query(_FIT.replace("WITH RECURSIVE", f"WITH RECURSIVE {D.TURNS},", 1))
def fit_context(spark, d):
    """Of each conversation's messages, as context units, those that fit."""
    units = D.turns(spark, d).select("session_id", F.struct("turn", X.count_words(F.col("content")).alias("tokens")).alias("u"))
    whole = units.groupBy("session_id").agg(F.array_sort(F.collect_list("u")).alias("u"))
    return whole.select("session_id", F.explode(context.fit(F.col("u"), 3, 60)).alias("x")).select("session_id", "x.turn")


@query(f"WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) i FROM cand) SELECT qid, doc_id FROM r WHERE i <= 3")
def retry_units(spark, d):
    return context.retry_units(_candidates(spark, d).withColumnRenamed("rank", "n")).select("qid", "doc_id")


#: Each message with a remark by its place: one names releases, one compares, one chooses, one clears the filter.
_REMARKS = (" on R2025x", " R2024x or R2026x?", " for all releases", " Compare them.", " what about both of the guides?", "", "")
_SAID = f"said AS (SELECT session_id, turn, (session_id + turn) % 7 k, content || [{', '.join(repr(x) for x in _REMARKS)}][((session_id + turn) % 7 + 1)::INT] AS content FROM turns)"


def _said(spark, d):
    remark = F.get(F.array(*map(F.lit, _REMARKS)), ((F.col("session_id") + F.col("turn")) % 7).cast("int"))
    return D.turns(spark, d).withColumn("content", F.concat("content", remark))


@query(f"""WITH {D.TURNS}, {_SAID} SELECT session_id, turn, CASE WHEN k IN (1, 3, 4) THEN 'compare' ELSE 'answer' END AS kind,
  CASE k WHEN 1 THEN 'two releases: R2024x, R2026x' WHEN 3 THEN 'comparison wording: compare' WHEN 4 THEN 'two documents named' ELSE 'no comparison wording' END AS reason FROM said""")
def route_questions(spark, d):
    return _said(spark, d).select("session_id", "turn", dialog.route(F.col("content")).alias("r")).select("session_id", "turn", "r.kind", "r.reason")


@query(f"""WITH {D.TURNS}, {_SAID}, s AS (SELECT *, nullif(last_value(CASE k WHEN 0 THEN '2025' WHEN 2 THEN '' END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') y FROM said)
SELECT session_id, turn, CASE WHEN k NOT IN (1, 2) THEN y::INT END AS release, 'R' || y || 'x' AS sticky FROM s""")
def sticky_release(spark, d):
    return dialog.sticky_release(_said(spark, d)).select("session_id", "turn", "release", "sticky")


@query(f"WITH {D.TURNS}, h AS (SELECT *, count(*) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) before, len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) n FROM turns) SELECT session_id, turn, before > 0 AND (n <= 6 OR regexp_matches(content, '(?i)^\\s*(and|also|then|so|but|or|what about|how about|same for|what if|and what|and how|and on|and for|and in|is it|is that|does it|does that|can it|can i also)\\b') OR (n <= 15 AND regexp_matches(content, '(?i)\\b(it|its|this|that|these|those|they|them|there|the same|above|previous|earlier|former|latter|other|another|else|instead|alternatives?|different|again)\\b'))) AS follow_up FROM h")
def followups(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("session_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t = D.turns(spark, d).withColumn("_b", F.count("*").over(w) > 0)
    return t.select("session_id", "turn", dialog.needs_condensing(F.col("content"), F.col("_b")).alias("follow_up"))


@query(f"WITH {D.TURNS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) i FROM turns) SELECT session_id, turn, role FROM r WHERE i <= 6")
def recent_turns(spark, d):
    return dialog.recent_turns(D.turns(spark, d)).select("session_id", "turn", "role")


@query(f"WITH {D.TURNS} SELECT session_id, turn, (count(*) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))::INT n, md5(coalesce(string_agg(CASE WHEN role = 'user' THEN 'User: ' || content ELSE 'Assistant: ' || substr(trim(regexp_replace(regexp_replace(content, '\\[[0-9]+\\]', '', 'g'), '\\s+', ' ', 'g')), 1, 400) || CASE WHEN length(trim(regexp_replace(regexp_replace(content, '\\[[0-9]+\\]', '', 'g'), '\\s+', ' ', 'g'))) > 400 THEN '…' ELSE '' END END, chr(10) ORDER BY turn) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), '')) AS h FROM turns")
def history_windows(spark, d):
    return dialog.with_history(D.turns(spark, d)).select("session_id", "turn", F.size("history").alias("n"), F.md5(F.array_join("history", "\n")).alias("h"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n, CASE WHEN doc_id % 3 = 0 THEN 'How is A' || doc_id || ' set up?' END AS first_query FROM documents""")
def comparison_sides(spark, d):
    """A planner's reply for each document: two sides, one side only, or no JSON."""
    i = F.col("doc_id").cast("string")
    a = F.format_string('{"label": "A%s", "query": "How is A%s set up and B%s?"}', i, i, i)
    b = F.format_string('{"label": "B%s", "query": "How is B%s set up?"}', i, i)
    reply = F.when(F.col("doc_id") % 3 == 0, F.format_string('{"sides": [%s, %s]}', a, b)).when(F.col("doc_id") % 3 == 1, F.format_string('{"sides": [%s]}', a)).otherwise("no json")
    s = table(spark, d, "documents").select("doc_id", dialog.parse_sides(reply).alias("s"))
    return s.select("doc_id", F.size("s").alias("n"), F.get("s", F.lit(0))["query"].alias("first_query"))


@query(f"""WITH {D.TURNS}, {_SAID}, q AS (SELECT session_id, count_if(k = 0) > 0 a, count_if(k = 1) > 0 b FROM said GROUP BY ALL)
SELECT session_id, turn, CASE WHEN k = 0 AND b THEN 2025 ELSE 7 END AS release FROM said JOIN q USING (session_id)""")
def side_releases(spark, d):
    """Each message as a side of the question that its whole conversation asks."""
    said = _said(spark, d)
    asked = said.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list("content")), " ").alias("question"))
    return said.join(asked, "session_id").select("session_id", "turn", dialog.side_release(F.col("question"), F.col("content"), F.lit(7)).alias("release"))


@query(f"""WITH {D.TURNS} SELECT session_id, turn, CASE turn % 3 WHEN 0 THEN 'Step ' || session_id || ' of ' || role || '?' WHEN 2 THEN CASE WHEN session_id % 20 <= 10 THEN trim(repeat('word ', (30 + session_id % 20)::INT)) END END AS rewrite FROM turns""")
def clean_rewrites(spark, d):
    """A reply to each message: a labelled and quoted question, none, or many words."""
    t, i = F.col("turn") % 3, F.col("session_id")
    asked = F.format_string('\n Standalone question: "Step %s of %s?"\nmore', i.cast("string"), F.col("role"))
    reply = F.when(t == 0, asked).when(t == 1, F.concat(F.lit("I could not find "), "role")).otherwise(F.repeat(F.lit("word "), (30 + i % 20).cast("int")))
    return D.turns(spark, d).select("session_id", "turn", dialog.clean_rewrite(reply, F.lit("and it?")).alias("rewrite"))


@query(f"WITH {D.LINES}, s AS (SELECT doc_id, pos, 1 + pos % 5 AS level, count(*) OVER (PARTITION BY doc_id) n FROM lines), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) i FROM s WHERE n <= 60 OR level <= 3) SELECT doc_id, pos FROM k WHERE i <= 60")
def outlines(spark, d):
    return dialog.outline(D.lines(spark, d).select("doc_id", "pos", F.col("pos").alias("ordinal"), (1 + F.col("pos") % 5).alias("level"))).select("doc_id", "pos")


@query("SELECT doc_id AS qid, side, section_id, pos FROM documents, (VALUES ('A', 's1', 0), ('A', 's2', 2), ('A', 's3', 4), ('B', 's9', 3)) t(side, section_id, pos) WHERE CASE section_id WHEN 's1' THEN doc_id % 3 <> 0 WHEN 's3' THEN doc_id % 3 = 0 WHEN 's9' THEN doc_id % 2 = 1 ELSE true END")
def planned_reads(spark, d):
    """A reader's reply for each document, of which every third has the first section and every second the only one asked of the other side."""
    q = table(spark, d, "documents").select(F.col("doc_id").alias("qid"))
    picks = [("a", "1."), ("A", "7"), ("A", "2"), ("b", "%s"), ("A", "3"), ("A", "1")]
    reply = '{"read": [' + ", ".join(f'{{"item": "{a}", "section": "{b}"}}' for a, b in picks) + "]}"
    outline = F.explode(F.array(*(F.struct(F.lit(a).alias("letter"), F.lit(a).alias("side"), F.lit(n).alias("number"), F.lit(f"s{n}").alias("section_id")) for a, n in ("A1", "A2", "A3", "B8", "B9"))))
    have = q.where("qid % 3 = 0").select("qid", F.lit("s1").alias("section_id")).unionByName(q.where("qid % 2 = 0").select("qid", F.lit("s8").alias("section_id")))
    return dialog.parse_reads(q.select("qid", F.format_string(reply, (8 + F.col("qid") % 2).cast("string")).alias("reply")), q.select("qid", outline.alias("o")).select("qid", "o.*"), have)


@query(f"WITH {D.REQUESTS} SELECT qid, list_sort(list_distinct(list_append(user_groups, 'all'))) AS groups FROM requests")
def search_groups(spark, d):
    return D.requests(spark, d).select("qid", F.array_sort(F.array_union("groups", F.array(F.lit("all")))).alias("groups"))


#: Answers over each document's number of sources, and which of their markers are valid.
_ANSWERS = "answers AS (SELECT doc_id qid, (doc_id % 5)::INT n, 'Use ' || lang || ' [1, ' || (1 + doc_id % 7) || ']. Then [9; 2].[1]' || CASE WHEN doc_id % 3 = 0 THEN '[1]' ELSE '' END AS text FROM documents)"


def _answers(spark, d):
    i = F.col("doc_id")
    text = F.concat(F.lit("Use "), F.col("lang"), F.lit(" [1, "), (1 + i % 7).cast("string"), F.lit("]. Then [9; 2].[1]"), F.when(i % 3 == 0, "[1]").otherwise(""))
    return table(spark, d, "documents").select(i.alias("qid"), (i % 5).cast("int").alias("n"), text.alias("text"))


@query(f"WITH {_ANSWERS}, numbers AS (SELECT qid, n, list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: x::INT) m FROM answers) SELECT qid, list_filter(m, lambda x, i: x <= n AND list_position(m, x) = i) AS cited, list_filter(m, lambda x, i: x > n AND list_position(m, x) = i) AS invalid FROM numbers")
def citations_extract(spark, d):
    text, n = F.col("text"), F.col("n")
    return _answers(spark, d).select("qid", answers.cited(text, n).alias("cited"), answers.invalid(text, n).alias("invalid"))


@query(f"""WITH {_ANSWERS}, k AS (SELECT qid, n, 1 + qid % 7 x FROM answers), t AS (SELECT qid, n, (SELECT lang FROM documents WHERE doc_id = qid) lang, CASE WHEN n >= 1 THEN '[1]' ELSE '' END one, CASE WHEN x <= n AND x > 1 THEN '[' || x || ']' ELSE '' END other, CASE WHEN n >= 2 THEN '[2]' ELSE '' END two FROM k)
SELECT qid, rtrim('Use ' || lang || CASE WHEN one || other <> '' THEN ' ' ELSE '' END || one || other || '. Then' || CASE WHEN two <> '' THEN ' ' ELSE '' END || two || '.' || one) AS text, false AS refused, false AS dropped FROM t""")
def citations_checked(spark, d):
    return _answers(spark, d).select("qid", answers.check_citations("text", "n").alias("c")).select("qid", "c.text", "c.refused", "c.dropped")


@query("""WITH u AS (SELECT doc_id // 10 qid, doc_id % 10 + 1 n, unnest([0, 1]) i, unnest(['KB' || (100000 + doc_id % 40), 'https://x.example/' || (doc_id % 7)]) AS ref FROM documents),
  f AS (SELECT qid, ref, min(n * 10 + i) AS place FROM u WHERE ref <> 'KB' || (100000 + qid % 40) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place) AS pos FROM f)
SELECT qid, pos::INT AS pos, '- ' || ref || ' [' || (place // 10) || ']' AS line FROM k WHERE pos <= 12""")
def missing_references(spark, d):
    """Ten documents as the sources of an answer, which names one article."""
    i, q = F.col("doc_id"), F.floor(F.col("doc_id") / 10)
    units = table(spark, d, "documents").select(q.alias("qid"), (i % 10 + 1).alias("n"), F.format_string("See KB%s and https://x.example/%s.", (100000 + i % 40).cast("string"), (i % 7).cast("string")).alias("text"))
    told = units.select("qid").distinct().select("qid", F.format_string("as in KB%s", (100000 + F.col("qid") % 40).cast("string")).alias("text"))
    return answers.missing_references(told, units).select("qid", F.col("pos").cast("int").alias("pos"), "line")


def _quoting(i):
    """An answer that quotes commands by a number: in a block, inline, and some that are too short."""
    return F.format_string("Run `pump start %s` or:\n```\ndrain tank;\nls\nset B=%s\n```\nand `ab`", (i % 9).cast("string"), (i % 4).cast("string"))



@query("""SELECT doc_id, ['drain tank;', 'set B=' || (doc_id % 4), 'pump start ' || (doc_id % 9)] AS commands,
  list_filter(['set B=' || (doc_id % 4), 'pump start ' || (doc_id % 9)], lambda c: c NOT IN ('set B=2', 'pump start 5')) AS unverified FROM documents""")
def commands_unverified(spark, d):
    rows = table(spark, d, "documents").select("doc_id", _quoting(F.col("doc_id")).alias("text"))
    return rows.select("doc_id", answers.commands(F.col("text")).alias("commands"), answers.unverified(F.col("text"), F.lit("DRAIN  tank: set b = 2, pump start 5")).alias("unverified"))


@query("SELECT doc_id // 10 AS qid, doc_id % 10 + 1 AS n FROM documents WHERE doc_id % 9 = (doc_id // 10) % 9")
def inferred_sources(spark, d):
    """Ten documents as the sources of an answer that quotes a command, which some of them hold in another spelling."""
    i, q = F.col("doc_id"), F.floor(F.col("doc_id") / 10)
    units = table(spark, d, "documents").select(q.alias("qid"), (i % 10 + 1).alias("n"), F.format_string("Then PUMP  start %s, and wait", (i % 9).cast("string")).alias("text"))
    return answers.infer_sources(units.select("qid").distinct().select("qid", _quoting(F.col("qid")).alias("text")), units)


@query("""WITH w AS (SELECT doc_id qid FROM documents WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda w: regexp_full_match(w, '[A-Za-z]{4,}'))) >= 2)
SELECT qid, pos, supported, by_values FROM w, (VALUES (0, true, false), (1, false, false), (2, true, true)) t(pos, supported, by_values)""")
def judged_claims(spark, d):
    """Claims on each document: one quoted from it, one with neither quote nor value in it, one that names a word of it, and a lead-in."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w.rlike("^[A-Za-z]{4,}$"))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("sources"), words.alias("w")).where("size(w) >= 2")
    claim = lambda text, evidence: F.struct(text.alias("claim"), F.lit(False).alias("supported"), evidence.alias("evidence"))
    first, last = F.get("w", F.lit(0)), F.element_at("w", -1)
    claims = F.array(claim(F.lit("It says so."), F.concat_ws(" ... ", last, first)), claim(F.lit("Use `zq9x.conf` now"), F.lit("zq9x none")), claim(F.concat(F.lit("It is `"), first, F.lit("`")), F.lit("zq9x")), claim(F.lit("Do this:"), first))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(claims.alias("claims"))), F.lit("\n```"))
    return answers.verdicts(rows.select("qid", reply.alias("reply"), "sources")).select("qid", "pos", "supported", "by_values")


@query(f"WITH {_CAND}, f AS (SELECT qid, rank, '[' || rank || '] ' || 'Doc ' || doc_id || ' (applies to all releases) | Section ' || (doc_id % 4) || ' | ' || CASE WHEN doc_id % 3 = 0 THEN 'p. 1' ELSE 'pp. 1-' || (1 + doc_id % 3) END || chr(10) || doc_id AS t FROM cand) SELECT qid, string_agg(t, chr(10) || chr(10) ORDER BY rank) AS context FROM f GROUP BY qid")
def formatted_context(spark, d):
    i = F.col("doc_id")
    units = _candidates(spark, d).select("qid", F.col("rank").alias("n"), F.concat(F.lit("Doc "), i.cast("string")).alias("title"), F.lit("any").alias("release"), (i % 4).cast("string").alias("section"), F.lit(1).alias("page_start"), (1 + i % 3).cast("int").alias("page_end"), i.cast("string").alias("text"))
    return answers.format_context(units)


@query("SELECT DISTINCT doc_id AS qid, step, model FROM labels JOIN (VALUES (0, 0, 'big', true), (0, 1, 'mid', true), (0, 2, 'local', false), (1, 0, 'mid', true), (1, 1, 'local', false), (2, 0, 'local', false)) c(k, step, model, leaves) ON k = doc_id % 3 WHERE NOT leaves OR doc_id % 2 = 0")
def fallback_chain(spark, d):
    """Each labelled document as a question's source, which may leave or not; three models are asked."""
    models = values(spark, "('big', 'mid', true, true), ('mid', 'local', true, true), ('local', null, false, true), ('keyless', 'local', true, false)", "name, fallback, external, ready")
    q, i = table(spark, d, "labels"), F.col("doc_id")
    asked = F.get(F.array(F.lit("big"), F.lit("mid"), F.lit("local")), (i % 3).cast("int"))
    return answers.fallback_chain(models, q.select(i.alias("qid"), asked.alias("model")), q.select(i.alias("qid"), (i % 2 == 0).alias("external_ok")))


@query(f"WITH {_CAND}, {D.MANIFEST} SELECT qid, bool_and(external_ok) AS may_leave FROM cand JOIN manifest USING (doc_id) GROUP BY qid")
def privacy_filter(spark, d):
    c = _candidates(spark, d).join(D.manifest(spark, d).select("doc_id", "external_ok"), "doc_id")
    return c.groupBy("qid").agg(F.every("external_ok").alias("may_leave"))


#: Each conversation's first question over its messages as sources, sized so that budgets bind; models that fail by the question's length.
_CHAIN = """WITH RECURSIVE msgs AS (SELECT session_id qid, turn, role, coalesce(content, '') AS content FROM turns),
q AS (SELECT qid, arg_min(content, turn) question FROM msgs WHERE role = 'user' GROUP BY qid),
u AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY turn) i, 20 * len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) tokens, CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END side FROM msgs JOIN q USING (qid)),
m(name, pos, leaves, most, tokens_most, per_side, tokens_sides, fails) AS (VALUES ('large', 0, true, 16, 9000, 8, 12000, 2), ('middle', 1, true, 7, 3500, 4, 4667, 3), ('local', 2, false, 6, 3000, 3, 4000, 7)),
f AS (SELECT qid, name, 0::BIGINT i, 0 k, 0::BIGINT used, 0 a, 0 b FROM q, m
      UNION ALL
      SELECT qid, name, i, k + ok::INT, used + CASE WHEN ok THEN tokens ELSE 0 END, a + (ok AND side = 'a')::INT, b + (ok AND side = 'b')::INT
      FROM (SELECT f.qid, f.name, u.i, f.k, f.used, f.a, f.b, u.tokens, u.side, CASE WHEN f.qid % 4 = 0 THEN (CASE u.side WHEN 'a' THEN f.a ELSE f.b END) < m.per_side AND f.used + u.tokens <= m.tokens_sides ELSE f.k < m.most AND f.used + u.tokens <= m.tokens_most END ok
            FROM f JOIN u ON u.qid = f.qid AND u.i = f.i + 1 JOIN m ON m.name = f.name)),
n AS (SELECT qid, name, arg_max(k, i) n_units, max(i) n_full FROM f GROUP BY ALL),
c AS (SELECT qid, name, pos, length(question) % fails = 0 AS failed, row_number() OVER (PARTITION BY qid ORDER BY pos) r, count(*) OVER (PARTITION BY qid) s, lead(name) OVER (PARTITION BY qid ORDER BY pos) nxt FROM q, m WHERE pos >= qid % 3 AND (NOT leaves OR qid % 5 <> 0)),
e AS (SELECT qid, min(r) r FROM c WHERE NOT failed OR r = s GROUP BY qid),
lost AS (SELECT c.qid, list(c.name || ' failed (RuntimeError: busy); answered with ' || nxt || ' instead.' ORDER BY c.r) said FROM c JOIN e ON e.qid = c.qid AND c.r < e.r GROUP BY c.qid)
SELECT qid, name AS profile, n_units::INT AS n_units, n_full::INT AS n_full, CASE WHEN NOT failed THEN name || ' read ' || n_units || ' sources [1].' END AS reply, CASE WHEN failed THEN 'RuntimeError: busy' END AS error,
  coalesce(said, []) || CASE WHEN n_units < n_full THEN [name || ' has a smaller context window: answered from the ' || n_units || ' best of ' || n_full || ' sources.'] ELSE [] END AS notices
FROM e JOIN c USING (qid, r) JOIN n USING (qid, name) LEFT JOIN lost USING (qid)"""


class _Counts:
    """Stand-in: counts its sources, and fails on questions of certain lengths."""

    def __init__(self, name: str, fails: int):
        self.name, self.fails = name, fails

    def generate(self, messages: list[dict]) -> str:
        sources, _, asked = messages[-1]["content"].rpartition("\n\nQuestion: ")
        question = asked.rpartition("\n\nThe question compares: " if "\n\nThe question compares: " in asked else "\n\nAnswer from the sources above")[0]
        if len(question) % self.fails == 0:
            raise RuntimeError("busy")
        return f"{self.name} read {sources.count(' (applies to all releases) | Section ')} sources [1]."


_MODELS = (("large", 40_000, 4_000, 2), ("middle", 16_000, 2_000, 3), ("local", 8_192, 1_500, 7))


def _chain_inputs(spark, d):
    said = D.turns(spark, d).withColumn("content", F.coalesce("content", F.lit(""))).withColumnRenamed("session_id", "qid")
    q = said.where("role = 'user'").groupBy("qid").agg(F.min_by("content", "turn").alias("question"))
    q = q.withColumn("sides", F.when(F.col("qid") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("turn"))
    units = said.join(q.select("qid"), "qid", "left_semi").select("qid", place.alias("n"), (20 * X.count_words(F.col("content"))).alias("tokens"), F.col("content").alias("text"), F.when(F.col("turn") % 2 == 0, "a").otherwise("b").alias("side"), F.lit("Message").alias("title"), F.lit("any").alias("release"), F.col("turn").cast("string").alias("section"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    models = values(spark, "('large', 'middle', true, true), ('middle', 'local', true, true), ('local', null, false, true)", "name, fallback, external, ready")
    asked = F.get(F.array(*(F.lit(m[0]) for m in _MODELS)), (F.col("qid") % 3).cast("int"))
    chain = answers.fallback_chain(models, q.select("qid", asked.alias("model")), q.select("qid", (F.col("qid") % 5 != 0).alias("external_ok")))
    return q, units, chain, [answering.Model(name, functools.partial(_Counts, name, fails), most, out) for name, most, out, fails in _MODELS]


@query(_CHAIN.replace("WITH RECURSIVE", f"WITH RECURSIVE {D.TURNS},", 1))
def answer_chain(spark, d):
    """Each conversation's question through a chain of models, some of which fail, each with the context that it can take."""
    q, units, chain, models = _chain_inputs(spark, d)
    return answering.generate(q, units, chain, models, "Answer.").select("qid", "profile", "n_units", "n_full", "reply", "error", "notices")


@query(f"""WITH {D.MANIFEST}, s AS (SELECT doc_id // 4 qid, list(id ORDER BY id) FILTER (NOT external_ok OR doc_id % 7 = 0) b FROM manifest GROUP BY ALL)
SELECT qid, CASE WHEN b IS NULL THEN 'keyless has no key (KEY is not set).' WHEN qid % 2 = 0 THEN 'Answered with a local model: ' || array_to_string(b, ', ') || ' may not be sent to an external model such as big (external_ok = false). keyless has no key (KEY is not set).'
  ELSE 'keyless has no key (KEY is not set).' END AS notice FROM s WHERE b IS NOT NULL OR qid % 2 = 1""")
def chain_notices(spark, d):
    """Four documents as each question's sources; every other question asks an external model, the rest one whose key lacks."""
    models = values(spark, "('big', 'keyless', true, true, null), ('keyless', 'local', false, false, 'KEY'), ('local', null, false, true, null)", "name, fallback, external, ready, key")
    s = D.manifest(spark, d).select(F.floor(F.col("doc_id") / 4).alias("qid"), F.col("id").alias("doc_id"), (F.col("external_ok") & (F.col("doc_id") % 7 != 0)).alias("external_ok"))
    asked = F.when(F.col("qid") % 2 == 0, "big").otherwise("keyless")
    return answers.chain_notices(models, s.select("qid").distinct().select("qid", asked.alias("model")), s)


_BY_LABEL = f"WITH {D.MANIFEST}, {D.REQUESTS}, {_DENSE}, j AS (SELECT d.qid, d.rank, d.doc_id, e.label, q.label ql FROM dense d JOIN embeddings e ON e.vec_id = d.doc_id JOIN embeddings q ON q.vec_id = d.qid WHERE d.rank <= 10 AND d.doc_id <> d.qid), h AS (SELECT ql AS label, qid, min(CASE WHEN label = ql THEN rank END) fh FROM j GROUP BY ALL) SELECT label, count(*) n, avg(CASE WHEN fh <= 1 THEN 1.0::DOUBLE ELSE 0 END) recall_1, avg(CASE WHEN fh <= 5 THEN 1.0::DOUBLE ELSE 0 END) recall_5, avg(CASE WHEN fh <= 10 THEN 1.0::DOUBLE ELSE 0 END) recall_10, avg(coalesce(1.0::DOUBLE / fh, 0)) mrr FROM h GROUP BY label"


@query(_BY_LABEL)
def retrieval_metrics(spark, d):
    e = table(spark, d, "embeddings")
    hits = search.dense(_vectors(spark, d), D.requests(spark, d), 10).where("qid <> chunk_id")
    j = hits.join(e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("l")), "chunk_id").join(e.select(F.col("vec_id").alias("qid"), "label"), "qid")
    first = j.groupBy("qid", "label").agg(F.min(F.when(F.col("l") == F.col("label"), F.col("rank"))).alias("first_hit"))
    return evaluation.retrieval_summary(first, ["label"])


@query(f"WITH {D.TURNS} SELECT session_id, turn, lower(regexp_replace(trim(regexp_replace(content, '\\s+', ' ', 'g')), '[?!. ]+$', '')) AS key FROM turns")
def normalised_questions(spark, d):
    return D.turns(spark, d).select("session_id", "turn", X.question_key(F.col("content")).alias("key"))


_KEY = "lower(regexp_replace(trim(regexp_replace(content, '\\s+', ' ', 'g')), '[?!. ]+$', ''))"


@query(f"WITH {D.TURNS} SELECT session_id, turn, sha256({D.marked(_KEY)} || '12:all,partners' || '-' || '2:c1' || '2:m1' || '4:top5') AS k FROM turns WHERE role = 'user'")
def cache_keys(spark, d):
    groups = F.array(F.lit("partners"), F.lit("all"), F.lit("partners"))
    return D.turns(spark, d).where("role = 'user'").select("session_id", "turn", oplog.cache_key(F.col("content"), groups, F.lit(None).cast("string"), F.lit("c1"), F.lit("m1"), F.lit("top5")).alias("k"))


_FUSED = "f AS (SELECT qid, doc_id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) score FROM (SELECT * FROM dense WHERE rank <= 50) a FULL JOIN (SELECT * FROM sparse WHERE rank <= 50) b USING (qid, doc_id)), k AS (SELECT * FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 30)"
_RUN = f"""WITH {D.MANIFEST}, {D.TERMS}, {D.REQUESTS}, {_ASKED}, {_SPARSE}, {_DENSE}, {_FUSED},
cand AS (SELECT 'dense' config, qid, doc_id, rank FROM dense WHERE rank <= 30 UNION ALL SELECT 'sparse', qid, doc_id, rank FROM sparse WHERE rank <= 30 UNION ALL SELECT 'hybrid', qid, doc_id, rank FROM k
  UNION ALL SELECT 'hybrid+rr10', qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN rank <= 10 THEN {D.SCORE} END DESC NULLS LAST, rank) FROM k)"""
_CONFIGS = (retriever.Config("dense", "dense"), retriever.Config("sparse", "sparse"), retriever.Config("hybrid"), retriever.Config("hybrid+rr10", rerank_top=10))


def _scored(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("rerank_score", (F.col("chunk_id") * 7919 % 1000).cast("double") / 1000)


def _run(spark: SparkSession, d: str) -> DataFrame:
    index = retriever.Index(_vectors(spark, d), _postings(spark, d))
    return retriever.run(_CONFIGS, D.requests(spark, d), _terms(spark, d), index, _scored)


@query(f"{_RUN} SELECT config, qid, doc_id, rank::INT AS rank FROM cand")
def retrieval_run(spark, d):
    """The candidates of every question under four configurations."""
    return _run(spark, d).select("config", "qid", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("int").alias("rank"))


@query(f"""{_RUN}, hit AS (SELECT config, qid, min(rank) fh FROM cand WHERE doc_id IN (qid, qid + 1) GROUP BY ALL)
SELECT config, count(*) n, round(avg((coalesce(fh, 99) <= 1)::INT), 9) recall_1, round(avg((coalesce(fh, 99) <= 5)::INT), 9) recall_5, round(avg((coalesce(fh, 99) <= 10)::INT), 9) recall_10, round(avg(coalesce(1.0::DOUBLE / fh, 0)), 9) mrr
FROM (SELECT unnest(['dense', 'sparse', 'hybrid', 'hybrid+rr10']) config, qid FROM requests) LEFT JOIN hit USING (config, qid) GROUP BY config""")
def configuration_recall(spark, d):
    """Each configuration over golden questions whose sources are the question's own document and the next."""
    found = _run(spark, d).select("config", "qid", "rank", F.col("chunk_id").alias("doc_id"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    questions = D.requests(spark, d).select("qid", F.lit("lookup").alias("qtype"))
    sources = questions.select("qid", F.explode(F.array(F.col("qid"), F.col("qid") + 1)).alias("doc_id"), F.lit(1).alias("first"), F.lit(1).alias("last"))
    made = retriever.run_eval(_CONFIGS, found, questions, sources)
    return made.select("config", "n", *(F.round(c, 9).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mrr")))
