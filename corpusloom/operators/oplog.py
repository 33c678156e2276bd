"""Snapshots and the operational log: upserts, index actions, sessions, traces, cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X


def record_documents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored(doc_id, status, file_hash, page_count, parse_seconds, error) with the parses `new` recorded.

    A missing figure keeps the old one; a document stays chunked or indexed only if its file is the same; an error is always overwritten.
    """
    o, n = stored.select(F.col("doc_id"), *(F.col(c).alias(f"o_{c}") for c in stored.columns if c != "doc_id"), F.lit(True).alias("_old")), new.select(F.col("doc_id"), *(F.col(c).alias(f"n_{c}") for c in new.columns if c != "doc_id"), F.lit(True).alias("_new"))
    both = o.join(n, "doc_id", "full_outer")
    same = F.col("o_file_hash").eqNullSafe(F.col("n_file_hash"))
    stays = same & (F.col("n_status") == "parsed") & F.col("o_status").isin("chunked", "indexed")
    keep = lambda c: F.coalesce(f"n_{c}", f"o_{c}")
    touched = F.col("_new").isNotNull()
    return both.select(
        "doc_id", F.when(~touched | stays, F.col("o_status")).otherwise(F.col("n_status")).alias("status"), F.when(~touched | (F.coalesce("n_file_hash", F.lit("")) == ""), F.col("o_file_hash")).otherwise(F.col("n_file_hash")).alias("file_hash"),
        keep("page_count").alias("page_count"), keep("parse_seconds").alias("parse_seconds"), F.when(touched, F.col("n_error")).otherwise(F.col("o_error")).alias("error"),
    )


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, the newest by `order`."""
    both = stored.unionByName(new)
    names = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*names), order).alias("_r")).select(*key, "_r.*")


def replace_rows(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """stored without the rows of new's keys, and new."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def prune(table: DataFrame, listed: DataFrame, key: str = "doc_id") -> DataFrame:
    return table.join(listed.select(key).distinct(), key, "left_semi")


def told_apart(*parts: Column) -> Column:
    """The parts as one string that no other parts give: each after its length, null as '-'."""
    return F.concat(*(F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts))


def metadata_hash(*columns: str) -> Column:
    return F.substring(F.sha2(told_apart(*map(F.col, columns)), 256), 1, 16)


def index_action(documents: DataFrame, force: bool = False) -> DataFrame:
    """doc_id, action: not_chunked, indexed (embed anew), metadata (only payloads) or skipped."""
    full = F.lit(force) | (F.col("status") == "chunked") | (F.coalesce("index_version", F.lit("")) != F.col("wanted_version"))
    return documents.select("doc_id", F.when(~F.col("status").isin("chunked", "indexed"), "not_chunked").when(full, "indexed").when(F.col("metadata_hash") != F.col("new_hash"), "metadata").otherwise("skipped").alias("action"))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """A short hash of a whole table, whatever its order: rows are hashed, a sum of the hashes is combined before it is shuffled, and hashed again."""
    line = F.sha2(told_apart(*map(F.col, columns)), 256)
    part = lambda i: F.sum(F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.agg(F.substring(F.sha2(F.concat_ws("-", F.count("*").cast("string"), *(part(i) for i in range(4))), 256), 1, 16).alias("fingerprint"), F.count("*").alias("n"))


def sessions(messages: DataFrame, title_chars: int = 80) -> DataFrame:
    """session_id, title (the first question, cut), n_messages."""
    first = F.min_by("content", F.when(F.col("role") == "user", F.col("turn")))
    s = messages.groupBy("session_id").agg(first.alias("_t"), F.count("*").alias("n_messages"))
    return s.select("session_id", F.when(F.length("_t") > title_chars, F.concat(F.rtrim(F.substring("_t", 1, title_chars)), F.lit("…"))).otherwise(F.col("_t")).alias("title"), "n_messages")


def stage_timings(stages: DataFrame, by: list[str]) -> DataFrame:
    """Total duration of each stage; added up as decimals, so the order of the rows does not show in the last digit."""
    return stages.groupBy(*by).agg(F.round(F.sum(F.col("duration_ms").cast("decimal(24,6)")), 1).cast("double").alias("total_ms"))


def cache_key(question: Column, groups: Column, release: Column, corpus: Column, model: Column, settings: Column | None = None) -> Column:
    """What a cached answer depends on. settings: retrieval options, profile and prompts as one string, so that no answer outlives a change of them."""
    who = F.array_join(F.array_sort(F.array_distinct(groups)), ",")
    return F.sha2(told_apart(X.question_key(question), who, release, corpus, model, F.lit(None).cast("string") if settings is None else settings), 256)


def cache_put(stored: DataFrame, answered: DataFrame, corpus: Column | str) -> DataFrame:
    """stored(key, question, corpus, trace_id, answer, hits, created_at, last_hit_at) with new answers (the same but hits and last_hit_at).

    An answer replaces an older one of its key and begins without hits; of several new ones the latest
    counts. Entries of another corpus than `corpus` go, new ones too.
    """
    now = F.lit(corpus) if isinstance(corpus, str) else corpus
    names = [c for c in stored.columns if c != "key"]
    fresh = answered.withColumns({"hits": F.lit(0).cast("long"), "last_hit_at": F.lit(None).cast(stored.schema["last_hit_at"].dataType)})
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1))).where(F.col("corpus") == now)
    return both.groupBy("key").agg(F.max_by(F.struct(*names), F.struct("_new", "created_at", "trace_id")).alias("_r")).select("key", "_r.*").select(*stored.columns)


def cache_hits(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """stored with the hits of asked(key, at) counted and the last one's time; keys without an entry are no hits."""
    counted = asked.groupBy("key").agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    both = stored.join(counted, "key", "left")
    return both.withColumns({"hits": F.col("hits") + F.coalesce("_n", F.lit(0)), "last_hit_at": F.greatest("last_hit_at", "_at")}).select(*stored.columns)


def cache_clear(stored: DataFrame, corpus: str | None = None) -> DataFrame:
    """No entries, or those of this corpus only."""
    return stored.where(F.lit(False) if corpus is None else F.col("corpus") == corpus)


def cache_stats(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("used"), F.max("hits").alias("most"))


def top_entries(entries: DataFrame, n: int = 10) -> DataFrame:
    return entries.orderBy(F.desc("hits"), "question").limit(n)


def without_traces(entries: DataFrame, traces: DataFrame) -> DataFrame:
    """The cache without answers of traces that got a thumbs down."""
    return entries.join(traces.select("trace_id"), "trace_id", "left_anti")


def last_per_key(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_i = 1").drop("_i")


def messages(turns: DataFrame, traces: DataFrame, feedback: DataFrame, user: str) -> DataFrame:
    """turns(session_id, turn, role, content, trace_id) with the trace's route and sources and this user's rating."""
    mine = feedback.where(F.col("user_id") == user).select("trace_id", "rating", "reason")
    return turns.join(traces.select("trace_id", "route", "sources"), "trace_id", "left").join(mine, "trace_id", "left")


def owned(sessions: DataFrame, user: str) -> DataFrame:
    return sessions.where(F.col("user_id") == user)


def schema_problems(table: DataFrame, wanted: str) -> list[str]:
    """What a table's columns lack of a DDL schema: missing ones and other types."""
    from pyspark.sql.types import _parse_datatype_string

    have = {f.name: f.dataType.simpleString() for f in table.schema}
    return [f"{f.name}: " + (f"{have[f.name]} instead of {f.dataType.simpleString()}" if f.name in have else "missing") for f in _parse_datatype_string(wanted).fields if have.get(f.name) != f.dataType.simpleString()]


def latest_parse(parsed: DataFrame, version: int) -> DataFrame:
    """Each document's last parse by the current version of the parser."""
    return parsed.where(F.col("parser_version") == version).groupBy("doc_id").agg(F.max("path").alias("path"))


class Tracer:
    """Stages of one run with their durations, also of one that raises, to be appended to the stage table."""

    def __init__(self, trace_id: str):
        self.trace_id = trace_id
        self.rows: list[tuple] = []

    def stage(self, name: str):
        from contextlib import contextmanager
        from time import perf_counter

        @contextmanager
        def timed():
            began, error = perf_counter(), None
            try:
                yield
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                raise
            finally:
                self.rows.append((self.trace_id, len(self.rows), name, (perf_counter() - began) * 1000, error))

        return timed()

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "trace_id string, seq int, stage string, duration_ms double, error string")
