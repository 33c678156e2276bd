"""Parses kept by what they depend on: a document's content and the parser's version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import plugins
from corpusloom.functions.tables import Log, cut


class ParseCache:
    """root/parts/part=<n>: the parses of write n; root/entries/<n>: which of them counts after it; root/log: finished writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = Log(spark, self.root)

    def entries(self) -> DataFrame | None:
        """doc_id, content_hash, parser_version, part of the documents whose parses are kept."""
        n = self.log.version()
        return self.spark.read.parquet(f"{self.root}/entries/{n}") if n else None

    def parses(self) -> DataFrame | None:
        """doc_id, content_hash, parser_version, parsed, seconds of the kept parses."""
        entries = self.entries()
        if entries is None:
            return None
        parts = [r.part for r in entries.select("part").distinct().collect()]  # as many as there were writes that something is left of
        stored = self.spark.read.option("basePath", f"{self.root}/parts").parquet(*(f"{self.root}/parts/part={p}" for p in parts)) if parts else None
        return None if stored is None else stored.join(entries, ["doc_id", "part"]).select("doc_id", "content_hash", "parser_version", "parsed", "seconds")

    def parse(self, files: DataFrame, make: Callable[[], plugins.Parser], version: int, force: bool = False) -> DataFrame:
        """Parses those of files(doc_id, content_hash, content) that are not kept; gives doc_id, action, seconds, error.

        Actions are cached, parsed and failed. A parse is kept for its content and version: with
        another content or by another version it is made anew and the old one dropped, and so are those
        of documents that are no longer among the files. A failed one is not kept, so it is tried
        again. Contents of kept parses are not read. Null contents parse as empty ones; a doc_id comes once.
        """
        n = self.log.version() + 1
        old = self.entries() if n > 1 else self.spark.createDataFrame([], f"doc_id {files.schema['doc_id'].dataType.simpleString()}, content_hash string, parser_version int, part long")
        same = old.where((F.col("parser_version") == version) & ~F.lit(force)).join(files.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_semi")
        todo = files.join(same.select("doc_id"), "doc_id", "left_anti")
        made = cut(plugins.parse(todo, make).drop("content"))
        made.where("error is null").select("doc_id", "parsed", "seconds").write.mode("overwrite").parquet(f"{self.root}/parts/part={n}")
        new = made.where("error is null").select("doc_id", "content_hash", F.lit(version).alias("parser_version"), F.lit(n).cast("long").alias("part"))
        same.select(*new.columns).unionByName(new).write.mode("overwrite").parquet(f"{self.root}/entries/{n}")
        self.log.add(n)
        done = made.select("doc_id", F.when(F.col("error").isNull(), "parsed").otherwise("failed").alias("action"), "seconds", "error")
        return done.unionByName(same.select("doc_id", F.lit("cached").alias("action"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("string").alias("error")))
