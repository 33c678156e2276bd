"""Queries of what several operators do together: extraction, index writing, reads within a budget, judging in parts."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom import plugins
from corpusloom.functions import tables
from corpusloom.functions import text as X
from corpusloom.operators import answers, dialog, evaluation, index, parsing, structure
from corpusloom.plans import derived as D
from corpusloom.plans.ingest import BOILERPLATE, NAMESPACE
from corpusloom.registry import query, table

#: Items of a page as a parser gives them: headings hold paragraphs, these what is marked up in them, in a mixed order.
_ITEMS = r"""raw AS (SELECT page_id::VARCHAR doc_id, unnest(string_split(html, '<')) raw, unnest(range(len(string_split(html, '<')))) ordinal FROM pages),
tags AS (SELECT doc_id, ordinal, regexp_extract(raw, '^(h1|p|a|b)\b[^>]*>', 1) tag, regexp_replace(raw, '^[^>]*>', '') txt FROM raw),
items AS (SELECT doc_id, ordinal, tag, txt, CASE WHEN ordinal % 4 = 0 THEN 1 + ordinal // 24 END page, (ordinal % 3) * 100000 + ordinal AS position, CASE WHEN ordinal % 11 = 0 THEN 'furniture' ELSE 'body' END layer,
  CASE WHEN ordinal % 13 = 0 THEN 'picture' WHEN ordinal % 34 = 0 THEN 'toc' WHEN ordinal % 17 = 0 THEN 'table' WHEN tag = 'h1' THEN 'heading' WHEN tag = 'a' THEN 'list' WHEN tag = 'b' THEN 'code' ELSE 'text' END kind,
  CASE tag WHEN 'h1' THEN NULL WHEN 'p' THEN last_value(CASE WHEN tag = 'h1' THEN ordinal END IGNORE NULLS) OVER w
    ELSE coalesce(last_value(CASE WHEN tag = 'p' THEN ordinal END IGNORE NULLS) OVER w, last_value(CASE WHEN tag = 'h1' THEN ordinal END IGNORE NULLS) OVER w) END parent
  FROM tags WHERE tag <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _items(spark, d):
    i = F.col("ordinal")
    rows = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.posexplode(F.split("html", "<")).alias("ordinal", "raw"))
    rows = rows.withColumn("tag", F.regexp_extract("raw", r"^(h1|p|a|b)\b[^>]*>", 1)).where("tag <> ''")
    before = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda tag: F.last(F.when(F.col("tag") == tag, i), ignorenulls=True).over(before)
    text = F.regexp_replace("raw", "^[^>]*>", "")
    label = F.when(i % 13 == 0, "picture").when(i % 34 == 0, "document_index").when(i % 17 == 0, "table").when(F.col("tag") == "h1", "section_header").when(F.col("tag") == "a", "list_item").when(F.col("tag") == "b", "code")
    return rows.select(
        "doc_id", i.alias("ref"), F.when(F.col("tag") == "p", last("h1")).when(F.col("tag") != "h1", F.coalesce(last("p"), last("h1"))).alias("parent"), (i % 3 * 100_000 + i).alias("position"), label.alias("label"),
        F.when(i % 11 == 0, "furniture").otherwise("body").alias("layer"), F.when(i % 4 == 0, 1 + F.floor(i / 24)).cast("int").alias("page"), text.alias("text"), F.array(F.array(text)).alias("rows"),
    )


@query(f"""WITH RECURSIVE {_ITEMS},
walk AS (SELECT doc_id, ordinal, [position] path, 0 depth FROM items WHERE parent IS NULL
  UNION ALL SELECT i.doc_id, i.ordinal, list_append(w.path, i.position), w.depth + 1 FROM walk w JOIN items i ON i.doc_id = w.doc_id AND i.parent = w.ordinal),
body AS (SELECT doc_id, row_number() OVER o AS ordinal, kind, trim(txt, ' ' || chr(9) || chr(10) || chr(13)) txt, coalesce(last_value(page IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) page, depth
  FROM items JOIN walk USING (doc_id, ordinal) WHERE layer = 'body' WINDOW o AS (PARTITION BY doc_id ORDER BY path))
SELECT doc_id, ordinal, kind, CASE WHEN kind IN ('table', 'toc') THEN '' ELSE txt END AS text, page, CASE WHEN kind = 'list' THEN depth ELSE 0 END AS depth, kind IN ('table', 'toc') AS has_rows
FROM body WHERE kind IN ('table', 'toc') OR (kind <> 'picture' AND txt <> '')""")
def extracted_elements(spark, d):
    elements, _ = structure.extract(_items(spark, d))
    return elements.select("doc_id", "ordinal", "kind", "text", "page", "depth", F.col("rows").isNotNull().alias("has_rows"))


@query(f"""WITH {_ITEMS} SELECT DISTINCT doc_id, lower(regexp_replace(regexp_replace(trim(txt, ' ' || chr(9) || chr(10) || chr(13)), '\\d+', '#', 'g'), '\\s+', ' ', 'g')) AS key FROM items WHERE layer = 'furniture' AND trim(txt, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def extracted_furniture(spark, d):
    return structure.extract(_items(spark, d))[1]


@query("""WITH d AS (SELECT doc_id, 1 + (len(string_split(text, chr(10))) - 1) // 20 AS pages, doc_id % 10 <> 9 AND doc_id % 8 <> 0 AS before FROM documents)
SELECT doc_id, action, CASE WHEN action IN ('removed', 'not_chunked') THEN 0 ELSE pages END AS n_points FROM (
  SELECT doc_id, pages, before, CASE WHEN doc_id % 11 = 5 THEN 'removed' WHEN doc_id % 8 = 0 AND doc_id % 16 <> 0 THEN 'not_chunked' WHEN NOT before OR doc_id % 6 = 0 THEN 'indexed' WHEN doc_id % 4 = 1 THEN 'metadata' ELSE 'skipped' END action FROM d)
WHERE action <> 'removed' OR before""")
def index_written(spark, d):
    """A second write after a first one: some documents are new, some gone, some have other files or other metadata."""
    i, docs = F.col("doc_id"), table(spark, d, "documents")
    title = lambda letter: F.concat(letter, i.cast("string"))
    pages = D.lines(spark, d).groupBy("doc_id", "page").agg(F.min_by("line", "pos").alias("text"))
    chunks = pages.select("doc_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("page").cast("string")).alias("chunk_id"), "text")
    kept = index.Index(spark, tables.shared_folder(spark, "index"), plugins.HashEmbedder, NAMESPACE)
    listed = docs.select("doc_id", F.md5("text").alias("file_hash"), F.col("lang").alias("category"), F.when(i % 8 == 0, "failed").otherwise("chunked").alias("status"), title(F.lit("T")).alias("title"))
    about, version = F.struct("title", "category"), F.concat(F.lit("c1."), F.substring("file_hash", 1, 12))
    kept.write(listed.where("doc_id % 10 <> 9"), chunks, about, version)
    changed = listed.withColumns({"file_hash": F.when(i % 6 == 0, F.reverse("file_hash")).otherwise(F.col("file_hash")), "title": title(F.when(i % 4 == 1, "U").otherwise("T")), "status": F.when(i % 16 == 0, "chunked").otherwise(F.col("status"))})
    return kept.write(changed.where("doc_id % 11 <> 5"), chunks, about, version)


@query("""WITH RECURSIVE s AS (SELECT doc_id, doc_id // 10 qid, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END side, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) tokens, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY n_chars % 97, doc_id) pos FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY qid, side ORDER BY pos) r FROM s WHERE doc_id % 10 <> 3),
o AS (SELECT qid, side, doc_id, tokens, row_number() OVER (PARTITION BY qid ORDER BY pos) i FROM k WHERE r <= 2 AND doc_id % 7 <> 0),
f AS (SELECT DISTINCT qid, 0::BIGINT i, 0::BIGINT used, 0 n, false ok, NULL::BIGINT doc_id, ''::VARCHAR side, 0::BIGINT tokens FROM o
  UNION ALL SELECT f.qid, o.i, f.used + CASE WHEN f.used + o.tokens <= 1500 THEN o.tokens ELSE 0 END, f.n + (f.used + o.tokens <= 1500)::INT, f.used + o.tokens <= 1500, o.doc_id, o.side, o.tokens FROM f JOIN o ON o.qid = f.qid AND o.i = f.i + 1)
SELECT qid, n::INT AS n, side, 's' || doc_id AS section_id, tokens FROM f WHERE ok""")
def reads_within_budget(spark, d):
    """Ten documents as each question's sections: a reply picks all of them, two a side are taken, and what fits 1,500 tokens is read."""
    i, text = F.col("doc_id"), lambda c: c.cast("string")
    s = table(spark, d, "documents").select(F.floor(i / 10).alias("qid"), F.when(i % 2 == 0, "A").otherwise("B").alias("side"), text(i % 10).alias("number"), F.concat(F.lit("s"), text(i)).alias("section_id"), X.count_words(F.col("text")).alias("tokens"), (F.col("n_chars") % 97).alias("o"), "doc_id")
    picks = F.array_sort(F.collect_list(F.struct("o", "doc_id", F.struct(F.col("side").alias("item"), F.col("number").alias("section")).alias("p"))))
    replies = s.groupBy("qid").agg(F.to_json(F.struct(F.transform(picks, lambda x: x["p"]).alias("read"))).alias("reply"))
    outlines = s.select("qid", F.col("side").alias("letter"), "side", "number", "section_id")
    reads = dialog.parse_reads(replies, outlines, s.where("doc_id % 10 = 3").select("qid", "section_id"))
    return dialog.read_sections(reads, s.where("doc_id % 7 <> 0"))


class _PartJudge:
    """Stand-in: one claim a part, backed by its first plain word or by nothing; fails on parts of certain lengths."""

    def generate(self, messages: list[dict]) -> str:
        part = messages[-1]["content"].rpartition("\n\nAnswer:\n\n")[2]
        if len(part) % 11 == 0:
            raise ValueError("over")
        if len(part) % 7 == 0:
            return "no json"
        word = next((w for w in part.split() if re.fullmatch("[A-Za-z]{4,}", w)), "")
        return json.dumps({"claims": [{"claim": "A part", "supported": True, "evidence": "" if len(part) % 2 else word}]})


@query(r"""WITH RECURSIVE a AS (SELECT doc_id qid, replace(text, chr(10), chr(10) || chr(10)) answer FROM documents WHERE text NOT LIKE '%`%'),
p0 AS (SELECT qid, unnest(string_split_regex(answer, '\n(?:[ \t]*\n)+')) p, unnest(range(len(string_split_regex(answer, '\n(?:[ \t]*\n)+')))) j FROM a WHERE length(answer) > 1200),
p AS (SELECT qid, p, row_number() OVER (PARTITION BY qid ORDER BY j) i FROM (SELECT qid, regexp_replace(p, '^\s+|\s+$', '', 'g') p, j FROM p0) WHERE p <> ''),
g AS (SELECT qid, i, 0::BIGINT part, length(p) + 2 AS size FROM p WHERE i = 1
  UNION ALL SELECT g.qid, p.i, g.part + (g.size + length(p.p) + 2 > 1204)::INT, CASE WHEN g.size + length(p.p) + 2 > 1204 THEN length(p.p) + 2 ELSE g.size + length(p.p) + 2 END FROM g JOIN p ON p.qid = g.qid AND p.i = g.i + 1),
parts AS (SELECT qid, part, string_agg(p, chr(10) || chr(10) ORDER BY i) t FROM g JOIN p USING (qid, i) GROUP BY ALL UNION ALL SELECT qid, 0, answer FROM a WHERE length(answer) <= 1200),
v AS (SELECT qid, part, CASE WHEN length(t) % 11 = 0 THEN 'ValueError: over' WHEN length(t) % 7 = 0 THEN 'unreadable judge reply: no json' END e, length(t) % 2 = 0 AND len(list_filter(string_split_regex(t, '\s+'), lambda w: regexp_full_match(w, '[A-Za-z]{4,}'))) > 0 AS s FROM parts),
first AS (SELECT qid, min(part) FILTER (WHERE e IS NOT NULL) f, arg_min(e, part) FILTER (WHERE e IS NOT NULL) e FROM v GROUP BY qid)
SELECT v.qid, count(*) FILTER (WHERE f IS NULL OR part < f) AS parts, count(*) FILTER (WHERE f IS NULL OR part < f) AS claims, count(*) FILTER (WHERE (f IS NULL OR part < f) AND s) AS supported, 0::BIGINT AS by_values, first.e AS error
FROM v JOIN first USING (qid) GROUP BY v.qid, first.e""")
def judged_in_parts(spark, d):
    """Each document as an answer, line by line, judged in parts against itself; parts of some lengths fail."""
    rows = table(spark, d, "documents").where("text not like '%`%'").select(F.col("doc_id").alias("qid"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("answer"), F.col("text").alias("sources"))
    return answers.judge(rows, _PartJudge)


_SLIDES = """heads AS (SELECT doc_id, page, min(ordinal) FILTER (WHERE kind = 'heading') head, arg_min(text, ordinal) FILTER (WHERE kind = 'heading') h FROM elements GROUP BY ALL),
titled AS (SELECT *, regexp_replace(coalesce(h, 'Slide ' || page), '\\s*\\(\\d+\\s*/\\s*\\d+\\)$', '') title FROM heads),
slides AS (SELECT *, head IS NOT NULL AND lag(title) OVER w = title AND lag(page) OVER w = page - 1 AS goes_on FROM titled WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
named AS (SELECT doc_id, page, head, last_value(CASE WHEN NOT coalesce(goes_on, false) THEN page END IGNORE NULLS) OVER w number, last_value(CASE WHEN NOT coalesce(goes_on, false) THEN title END IGNORE NULLS) OVER w title FROM slides
  WINDOW w AS (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
placed AS (SELECT e.*, n.number, n.title, sum((kind <> 'list')::INT) OVER (PARTITION BY e.doc_id, n.number ORDER BY e.page, ordinal) r FROM elements e JOIN named n ON n.doc_id = e.doc_id AND n.page = e.page AND (head IS NULL OR head <> ordinal)),
blocks AS (SELECT doc_id, number, title, CASE WHEN kind = 'list' THEN 'list' ELSE 'text' END AS k, r, min(page) page_start, max(page) page_end, min(ordinal) o, bool_or(kind = 'heading') demoted,
  CASE WHEN bool_or(kind = 'list') THEN string_agg('- ' || text, chr(10) ORDER BY page, ordinal) ELSE min(text) END AS text FROM placed GROUP BY ALL)"""


@query(f"WITH {D.ELEMENTS}, {_SLIDES} SELECT doc_id, number::VARCHAR AS number, title, row_number() OVER (PARTITION BY doc_id, number ORDER BY page_start, o) AS n, k AS kind, text, page_start, page_end, demoted FROM blocks")
def slide_blocks(spark, d):
    return structure.slide_blocks(D.elements(spark, d))


class _TagCounter:
    """Stand-in: a page's parse is the number of its tags; pages of some lengths can't be parsed."""

    def parse(self, content: str) -> str:
        if len(content) % 13 == 0:
            raise ValueError("broken")
        return str(content.count("<"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN html || ' ' ELSE html END html, page_id % 3 <> 0 AND page_id % 4 <> 0 AND length(html) % 13 <> 0 AS kept FROM pages)
SELECT page_id AS doc_id, CASE WHEN kept THEN 'cached' WHEN length(html) % 13 = 0 THEN 'failed' ELSE 'parsed' END AS action, CASE WHEN length(html) % 13 <> 0 THEN (length(html) - length(replace(html, '<', '')))::VARCHAR END AS parsed FROM p""")
def parses_kept(spark, d):
    """A second run over the pages: some are new to it, some have changed, the rest is taken from the first."""
    kept = parsing.ParseCache(spark, tables.shared_folder(spark, "parses"))
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.md5("html").alias("content_hash"), F.col("html").alias("content"))
    kept.parse(pages.where("doc_id % 3 <> 0"), _TagCounter, version=2)
    changed = F.col("doc_id") % 4 == 0
    now = pages.withColumns({"content_hash": F.when(changed, F.reverse("content_hash")).otherwise(F.col("content_hash")), "content": F.when(changed, F.concat("content", F.lit(" "))).otherwise(F.col("content"))})
    done = kept.parse(now, _TagCounter, version=2)
    return done.join(kept.parses().select("doc_id", "parsed"), "doc_id", "left").select("doc_id", "action", "parsed")


@query(f"""WITH {D.LINES}, keyed AS (SELECT doc_id, page, line, lower(regexp_replace(regexp_replace(trim(line), '\\d+', '#', 'g'), '\\s+', ' ', 'g')) k FROM lines),
n AS (SELECT doc_id, max(page) pages FROM lines GROUP BY doc_id), r AS (SELECT doc_id, k FROM keyed JOIN n USING (doc_id) WHERE length(line) <= 200 GROUP BY doc_id, k, pages HAVING count(DISTINCT page) >= greatest(3.0, 0.3 * pages)),
layer AS (SELECT DISTINCT doc_id, k FROM keyed WHERE page = 1 AND doc_id % 2 = 0 AND length(line) < 60)
SELECT doc_id, left(trim(line), 80) AS line, count(*) AS n FROM keyed e WHERE (regexp_matches(trim(line), '(?i)^(Released under|Licensed under) the ') OR (doc_id, k) IN (SELECT doc_id, k FROM r) OR ((doc_id, k) IN (SELECT doc_id, k FROM layer) AND length(line) <= 200)) GROUP BY ALL""")
def furniture_counts(spark, d):
    """Lines that are removed from each document, and how often: repeated ones, boilerplate, and the furniture layer of every second one."""
    lines = D.lines(spark, d).select("doc_id", F.col("pos").alias("ordinal"), F.lit("text").alias("kind"), "page", F.col("line").alias("text"))
    layer = lines.where("page = 1 and doc_id % 2 = 0 and length(text) < 60").select("doc_id", X.line_key(F.col("text")).alias("key"))
    return structure.furniture_counts(lines, BOILERPLATE, layer=layer)


#: Answers to questions on each labelled document, with what is cited, what was found and what a judge said of it.
_ANSWERED = r"""a AS (SELECT l.doc_id qid, CASE l.doc_id % 3 WHEN 0 THEN 'lookup' WHEN 1 THEN 'howto' ELSE 'compare' END qtype, quality = 1 ok, toxic = 0 said, CASE WHEN toxic = 0 THEN NULL WHEN l.doc_id % 2 = 0 THEN 'gate' ELSE 'llm' END refused_by,
  CASE WHEN toxic = 0 THEN regexp_replace(text, '\[\d+\]|`', '', 'g') || CASE WHEN l.doc_id % 5 <> 0 THEN ' [1]' ELSE '' END || CASE WHEN l.doc_id % 2 = 0 THEN ' KB0123456' ELSE ' see https://x.org/a' END || CASE WHEN l.doc_id % 4 = 0 THEN ' `run zqx now`' ELSE '' END ELSE '' END t,
  1 + l.doc_id % 3 p, l.doc_id % 2 + l.doc_id AS cites, l.doc_id % 6 = 0 copy, l.doc_id % 7 = 0 AS none, CASE l.doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END good, (l.doc_id * 37) % 1000 ms FROM labels l JOIN documents d USING (doc_id)),
s AS (SELECT qid, qtype, ok, said, refused_by, CASE WHEN ok THEN 2 ELSE 0 END must_total, CASE WHEN ok THEN contains(lower(regexp_replace(regexp_replace(t, '[`*_]', '', 'g'), '\s+', ' ', 'g')), 'the')::INT ELSE 0 END must_found,
  CASE WHEN ok THEN 1 ELSE 0 END ref_total, CASE WHEN ok AND contains(t, 'KB0123456') THEN 1 ELSE 0 END ref_found, CASE WHEN ok THEN 1 ELSE 0 END urls_total, CASE WHEN ok AND contains(t, 'https://x.org/a') THEN 1 ELSE 0 END urls_found,
  CASE WHEN none THEN 0 ELSE 1 END cited, CASE WHEN ok AND NOT none AND ((cites = qid AND p <= 2) OR copy) THEN 1 ELSE 0 END cited_correct, CASE WHEN ok THEN 1 ELSE 0 END golden_docs, CASE WHEN ok AND NOT none AND (cites = qid OR copy) THEN 1 ELSE 0 END golden_docs_cited,
  said AND NOT regexp_matches(t, '\[\d+\]') no_markers, qid % 9 = 0 AS dropped, qid % 3 AS invalid_citations, CASE WHEN said AND qid % 4 = 0 THEN 1 ELSE 0 END commands_total, CASE WHEN said AND qid % 4 = 0 AND qid % 8 <> 0 THEN 1 ELSE 0 END commands_unverified,
  CASE WHEN good > 0 THEN 1.0::DOUBLE / good END faithfulness, CASE WHEN good = 2 THEN 1 ELSE 0 END by_values, CASE WHEN qid % 10 = 0 THEN 'x' END judge_error, ms, qid % 11 = 0 AS retried FROM a)"""


def _answered(spark, d):
    i, toxic = F.col("doc_id"), F.col("toxic") == 0
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    page = (1 + i % 3).cast("int")
    place = lambda doc, a, b: F.struct(doc.alias("doc_id"), a.cast("int").alias("page_start"), b.cast("int").alias("page_end"))
    copies = F.when(i % 6 == 0, F.array(place(i, page, page)))
    source = F.struct((i + i % 2).alias("doc_id"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), copies.alias("copies"), F.when(i % 8 == 0, "Then RUN zqx  now.").otherwise("").alias("text"))
    sources = F.when(i % 7 != 0, F.array(source))
    claim = lambda good, by_values: F.struct(F.lit(good).alias("supported"), F.lit(by_values).alias("by_values"))
    claims = F.when(i % 4 == 1, F.array(claim(True, False))).when(i % 4 > 1, F.array(claim(True, True), claim(False, False)))
    marks = F.concat(F.when(i % 5 != 0, " [1]").otherwise(""), F.when(i % 2 == 0, " KB0123456").otherwise(" see https://x.org/a"), F.when(i % 4 == 0, " `run zqx now`").otherwise(""))
    ms = ((i * 37) % 1000).cast("double")
    questions = rows.select(i.alias("qid"), F.when(i % 3 == 0, "lookup").when(i % 3 == 1, "howto").otherwise("compare").alias("qtype"), F.array(F.lit("The"), F.lit("zzz")).alias("must"), F.lit("As KB0123456 (https://x.org/a.) says; KB0123456").alias("expected"), F.when(F.col("quality") == 1, F.array(F.struct(i.alias("doc_id"), page.alias("first"), page.alias("last")))).alias("golden"))
    given = rows.select(
        i.alias("qid"), toxic.alias("answered"), F.when(toxic, None).when(i % 2 == 0, "gate").otherwise("llm").alias("refused_by"), F.concat(F.regexp_replace("text", r"\[\d+\]|`", ""), marks).alias("text"), sources.alias("sources"), F.array(source).alias("context"), (i % 3).alias("n_invalid"), (i % 9 == 0).alias("dropped"),
        (i % 11 == 0).alias("retried"), F.lit("answer").alias("route"), F.lit(0.5).alias("top_score"), claims.alias("claims"), F.when(i % 10 == 0, "x").alias("judge_error"), ms.alias("retrieval_ms"), F.when(i % 2 == 0, ms).otherwise(0.0).alias("generation_ms"), F.when(i % 5 == 0, ms + 1).otherwise(0.0).alias("judge_ms"), (ms * 2).alias("total_ms"),
    )
    return evaluation.score_in_full(questions, given, answers.ARTICLE)


def _rank(what: str, percent: int, where: str = "true") -> str:
    v = f"list_sort(list(({what})::DOUBLE) FILTER (WHERE {where}))"
    return f"coalesce({v}[1 + least(len({v}) - 1, round_even((len({v}) - 1) * {percent / 100}, 0))::INT], 0)"


@query(f"""WITH {_ANSWERED} SELECT qtype, count(*) n, count(*) FILTER (WHERE ok) answerable, count(*) FILTER (WHERE NOT ok) unanswerable, avg(CASE WHEN ok THEN said::INT END) answered, avg(CASE WHEN ok AND said THEN must_found / 2.0::DOUBLE END) must_include, avg(CASE WHEN ok AND said THEN (must_found = must_total)::INT END) must_include_all,
  sum(ref_found) FILTER (WHERE ok AND said)::DOUBLE / sum(ref_total) FILTER (WHERE ok AND said) article_numbers, sum(urls_found) FILTER (WHERE ok AND said)::DOUBLE / sum(urls_total) FILTER (WHERE ok AND said) urls, sum(cited_correct) FILTER (WHERE ok AND said)::DOUBLE / sum(cited) FILTER (WHERE ok AND said) citation_precision,
  sum(golden_docs_cited) FILTER (WHERE ok AND said)::DOUBLE / sum(golden_docs) FILTER (WHERE ok AND said) citation_doc_recall, avg(CASE WHEN ok AND said THEN faithfulness END) faithfulness, avg(CASE WHEN ok AND said AND faithfulness IS NOT NULL THEN (faithfulness = 1)::INT END) fully_faithful, count(*) FILTER (WHERE ok AND said AND judge_error IS NOT NULL) judge_errors,
  avg(CASE WHEN ok AND said THEN no_markers::INT END) no_markers, avg(CASE WHEN ok AND said THEN dropped::INT END) dropped_not_found, sum(CASE WHEN ok AND said THEN invalid_citations ELSE 0 END)::BIGINT invalid_citations, sum(CASE WHEN ok AND said THEN commands_total - commands_unverified END)::DOUBLE / nullif(sum(CASE WHEN ok AND said THEN commands_total END), 0) commands_verified,
  sum(CASE WHEN ok AND said THEN commands_unverified ELSE 0 END)::BIGINT commands_unverified, sum(CASE WHEN ok AND said THEN by_values ELSE 0 END)::BIGINT claims_by_values, avg(CASE WHEN NOT ok THEN (NOT said)::INT END) refused, count(*) FILTER (WHERE NOT ok AND refused_by = 'gate') refused_by_gate, count(*) FILTER (WHERE NOT ok AND refused_by = 'llm') refused_by_llm,
  {_rank('ms * 2', 50)} total_ms_p50, {_rank('ms * 2', 95)} total_ms_p95, {_rank('ms', 50)} retrieval_ms_p50, {_rank('ms', 50, 'qid % 2 = 0 AND ms > 0')} generation_ms_p50, {_rank('ms + 1', 50, 'qid % 5 = 0')} judge_ms_p50 FROM s GROUP BY qtype""")
def answer_measures(spark, d):
    """All measures of answers by kind of question."""
    return evaluation.summary_in_full(_answered(spark, d), ["qtype"]).drop("context_hit", "meta_talk")


@query(f"WITH {_ANSWERED}, e AS (SELECT qid, unnest([CASE WHEN ok AND NOT said THEN 'wrong_refusal' END, CASE WHEN NOT ok AND said THEN 'wrong_answer' END, CASE WHEN retried THEN 'retried' END]) what FROM s) SELECT qid, what FROM e WHERE what IS NOT NULL")
def answer_exceptions(spark, d):
    return evaluation.exceptions(_answered(spark, d))
