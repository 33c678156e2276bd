"""The library's tables as projections of the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.registry import table

MANIFEST = """
manifest AS (SELECT doc_id, 'd' || doc_id::VARCHAR id, source family, (1 + (doc_id // 13) % 3)::VARCHAR || '.' || (doc_id % 13)::VARCHAR AS version,
  (2015 + doc_id % 12)::INT release_min, (CASE WHEN doc_id % 3 = 0 THEN 9999 ELSE 2018 + doc_id % 12 END)::INT release_max,
  CASE doc_id % 5 WHEN 0 THEN ['internal'] WHEN 1 THEN ['partners', 'internal'] ELSE ['all'] END allowed_groups, doc_id % 2 = 0 external_ok,
  CASE lang WHEN 'en' THEN 'installation' WHEN 'de' THEN 'upgrade' WHEN 'fr' THEN 'performance' ELSE 'functional' END category, text, lang FROM documents)"""
LINES = "lines AS (SELECT doc_id, pos::INT pos, 1 + pos::INT // 20 page, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) pos FROM documents))"
TERMS = "postings AS (SELECT doc_id, token, count(*)::DOUBLE weight FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) token FROM documents) GROUP BY ALL)"
REQUESTS = "requests AS (SELECT vec_id qid, embedding, CASE WHEN (vec_id // 100) % 2 = 0 THEN ['public'] ELSE ['internal'] END user_groups, CASE WHEN (vec_id // 100) % 3 = 0 THEN 2020 END wanted FROM embeddings WHERE vec_id % 100 = 0)"
TURNS = "turns AS (SELECT conv_id session_id, turn, role, text AS content FROM conversations)"
#: A score between 0 and 1 for each document, from its id.
SCORE = "((doc_id * 7919) % 1000)::DOUBLE / 1000"
OUTCOMES = f"outcomes AS (SELECT doc_id qid, quality = 1 answerable, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE {SCORE} END top, toxic = 0 AND doc_id % 4 <> 0 answered, CASE WHEN toxic = 0 AND doc_id % 4 <> 0 THEN NULL WHEN doc_id % 8 = 0 THEN 'gate' ELSE 'llm' END refused_by, doc_id % 7 = 0 retried, toxic = 0 AND doc_id % 4 <> 0 AND doc_id % 3 <> 0 good FROM labels)"


def marked(x: str) -> str:
    """SQL of a value as oplog.told_apart writes it."""
    return f"coalesce(length(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    groups = lambda *g: F.array(*map(F.lit, g))
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("d"), i.cast("string")).alias("id"), F.col("source").alias("family"), F.concat_ws(".", (1 + F.floor(i / 13) % 3).cast("string"), (i % 13).cast("string")).alias("version"),
        (2015 + i % 12).cast("int").alias("release_min"), F.when(i % 3 == 0, 9999).otherwise(2018 + i % 12).cast("int").alias("release_max"),
        F.when(i % 5 == 0, groups("internal")).when(i % 5 == 1, groups("partners", "internal")).otherwise(groups("all")).alias("allowed_groups"), (i % 2 == 0).alias("external_ok"),
        F.when(F.col("lang") == "en", "installation").when(F.col("lang") == "de", "upgrade").when(F.col("lang") == "fr", "performance").otherwise("functional").alias("category"), "text", "lang",
    )


def lines(spark: SparkSession, d: str, docs: DataFrame | None = None) -> DataFrame:
    return (table(spark, d, "documents") if docs is None else docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", (1 + F.floor(F.col("pos") / 20)).cast("int").alias("page"), "line")


def requests(spark: SparkSession, d: str) -> DataFrame:
    n = F.floor(F.col("vec_id") / 100)
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").cast("array<double>").alias("vector"), F.when(n % 2 == 0, F.array(F.lit("public"))).otherwise(F.array(F.lit("internal"))).alias("groups"), F.when(n % 3 == 0, 2020).cast("int").alias("release"), F.lit(None).cast("string").alias("category"))


def points(spark: SparkSession, d: str) -> DataFrame:
    """Metadata of every document as an index point, the newest of its family or not."""
    return manifest(spark, d).select(F.col("doc_id").alias("chunk_id"), "allowed_groups", (F.col("doc_id") % 9 != 0).alias("is_latest"), "release_min", "release_max", "category")


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    said = (F.col("toxic") == 0) & (i % 4 != 0)
    return table(spark, d, "labels").select(i.alias("qid"), (F.col("quality") == 1).alias("answerable"), F.when(i % 11 == 0, None).otherwise(((i * 7919) % 1000).cast("double") / 1000).alias("top"), said.alias("answered"), F.when(said, None).when(i % 8 == 0, "gate").otherwise("llm").alias("refused_by"), (i % 7 == 0).alias("retried"), (said & (i % 3 != 0)).alias("good"))


def elements(spark: SparkSession, d: str) -> DataFrame:
    """Layout elements of the web pages: headings, paragraphs and links (as list items) in order, two dozen to a page."""
    items = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.posexplode(F.split("html", "<")).alias("ordinal", "raw"))
    tag = F.regexp_extract("raw", r"^(h1|p|a|b)\b[^>]*>", 1)
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "^[^>]*>", ""), r"\s+", " "))
    made = items.where(tag != "").select("doc_id", "ordinal", F.when(tag == "h1", "heading").when(tag == "a", "list").otherwise("text").alias("kind"), text.alias("text"), (1 + F.floor(F.col("ordinal") / 24)).cast("int").alias("page"), F.lit(0).alias("depth"), F.lit(None).cast("array<array<string>>").alias("rows"))
    return made.where("text <> ''")


ELEMENTS = r"""
elements AS (SELECT doc_id, ordinal::INT ordinal, CASE WHEN tag = 'h1' THEN 'heading' WHEN tag = 'a' THEN 'list' ELSE 'text' END kind, txt AS text, 1 + ordinal::INT // 24 page
  FROM (SELECT *, regexp_extract(raw, '^(h1|p|a|b)\b[^>]*>', 1) tag, trim(regexp_replace(regexp_replace(raw, '^[^>]*>', ''), '\s+', ' ', 'g')) txt
        FROM (SELECT page_id::VARCHAR doc_id, unnest(string_split(html, '<')) raw, unnest(range(len(string_split(html, '<')))) ordinal FROM pages)) WHERE tag <> '' AND txt <> '')"""
