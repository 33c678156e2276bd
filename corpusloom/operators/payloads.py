"""Rows as the structs that an index stores and a page shows, and the statements with which a person looks into the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X

# Fixed values.
STALL_SECONDS, STALL_CPU_SHARE = 120, 0.1
METADATA = ("title", "doc_type", "family", "version", "release_min", "release_max", "release_label", "is_latest", "allowed_groups", "external_ok", "category")
LOCATION = ("doc_id", "chunk_id", "section_id", "section_number", "chunk_index", "header", "text", "content_type", "page_start", "page_end", "token_count")


def stalled(cached: Column, seconds: Column, cpu_seconds: Column) -> Column:
    """Whether a parse took long without working: not from the cache, over two minutes, under a tenth of them in CPU time. Unknown figures are no stall."""
    return F.coalesce(~cached & (seconds > STALL_SECONDS) & (cpu_seconds < STALL_CPU_SHARE * seconds), F.lit(False))


def doc_metadata(documents: DataFrame) -> Column:
    """The metadata of a document that each of its points carries; of columns that the table lacks, null."""
    return F.struct(*((F.col(c) if c in documents.columns else F.lit(None)).alias(c) for c in METADATA))


def index_version(file_hash: Column, chunker: Column | int, model: str) -> Column:
    """What a point was made by: chunker, embedding model and the beginning of the file's hash."""
    chunker = chunker if isinstance(chunker, Column) else F.lit(chunker)
    return F.concat(F.lit("c"), chunker.cast("string"), F.lit(f".{model}."), F.substring(file_hash, 1, 12))


def chunk_payload(chunks: DataFrame, documents: DataFrame, version: Column) -> DataFrame:
    """chunk_id, payload: each chunk's text and place, the version (an expression over documents) and its document's metadata."""
    meta = documents.select("doc_id", doc_metadata(documents).alias("_meta"), version.alias("index_version"))
    place = [F.substring_index("section_id", "#", -1).alias(c) if c == "section_number" else F.col(c) for c in LOCATION]
    return chunks.join(meta, "doc_id").select("chunk_id", F.struct(*place, "index_version", "_meta.*").alias("payload"))


def context_payload(units: DataFrame) -> DataFrame:
    """qid, sources: the numbered units as a page's panel lists them, pages as text and scores to four digits."""
    one = F.struct("n", "doc_id", "title", "section", "heading", X.page_text(F.col("page_start"), F.col("page_end")).alias("pages"), "release", F.round("score", 4).alias("score"), "tokens", "text")
    return units.groupBy("qid").agg(F.array_sort(F.collect_list(one)).alias("sources"))


#: Name -> a documented statement over the views documents, sections, traces, trace_stages, feedback, answer_cache.
STATEMENTS = {
    "documents": "SELECT doc_id, status, page_count, chunk_count, parse_seconds, embed_seconds FROM documents",
    "sections_of": "SELECT section_id, heading_path, page_start, page_end, token_count FROM sections WHERE doc_id = :doc_id",
    "recent_traces": "SELECT trace_id, route, query, top_rerank_score, gate_decision, llm_model, total_ms FROM traces ORDER BY created_at DESC, trace_id LIMIT :n",
    "recent_answers": "SELECT query, answer, sources FROM traces WHERE route = 'answer' ORDER BY created_at DESC, trace_id LIMIT :n",
    "stages_of": "SELECT stage, duration_ms, data FROM trace_stages WHERE trace_id = :trace_id ORDER BY seq",
    "rated": "SELECT f.rating, f.reason, f.comment, t.query, t.top_rerank_score, t.gate_decision FROM feedback f JOIN traces t USING (trace_id)",
    "cache": "SELECT query_norm, user_groups, release_filter, hit_count, created_at, last_hit_at FROM answer_cache ORDER BY hit_count DESC, query_norm",
    "cache_hits": "SELECT query, cache_hit, total_ms FROM traces WHERE cache_hit = 1 ORDER BY created_at DESC, trace_id LIMIT :n",
}


def inspect(spark: SparkSession, name: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """One of STATEMENTS over the given tables; args are bound, not pasted in."""
    for view, df in tables.items():
        df.createOrReplaceTempView(view)
    return spark.sql(STATEMENTS[name], args=args or None)
