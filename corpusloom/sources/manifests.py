"""Manifest files and document folders as DataFrames, and the manifest written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X
from corpusloom.operators.manifest import COLUMNS, LEGACY_COLUMNS, PARSED_FORMATS, listing, validate, version_clashes, with_latest


class ManifestError(ValueError):
    """All problems of a manifest, a line each."""

    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """line and every column as text ('' where it is missing), dates as YYYY-MM-DD; the header must be the current or the older one."""
    header = spark.read.text(path).limit(1).first()
    names = tuple((header[0] if header else "").lstrip("﻿").split(","))
    if names not in (COLUMNS, LEGACY_COLUMNS):
        raise ManifestError([f"header must be exactly: {','.join(COLUMNS)} (got: {','.join(names)})"])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', enforceSchema=True)
    rows = raw.withColumn("_at", F.monotonically_increasing_id())
    if raw.rdd.getNumPartitions() > 1:  # a multi-line file is one partition, so ids are places in the file
        raise ManifestError(["a manifest is one file"])
    rows = rows.select((F.col("_at") + 2).cast("int").alias("line"), *(F.coalesce(F.col(c), F.lit("")).alias(c) if c in names else F.lit("").alias(c) for c in COLUMNS))
    return rows.withColumn("added", F.coalesce(X.iso_date(F.col("added")), F.col("added")))


def load(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """The validated documents with is_latest; raises with every problem of every line if there is one."""
    checked = validate(read_rows(spark, path), files).persist()  # read by several joins; its expressions are long
    listed, twice = listing(checked.where("size(errors) = 0").drop("errors"))
    clash = version_clashes(listed)
    problems = checked.select("line", F.explode("errors").alias("message")).unionByName(twice).unionByName(clash.select("line", F.concat(F.lit("family '"), "family", F.lit("' already has version "), "version", F.lit(" on line "), F.col("first_line").cast("string")).alias("message")))
    found = [f"line {r.line}: {r.message}" for r in problems.orderBy("line").collect()]  # a manifest's errors are for a person to read
    if found:
        raise ManifestError(found)
    return with_latest(listed)


def write_rows(rows: DataFrame, path: str) -> None:
    rows.select(*COLUMNS).coalesce(1).write.mode("overwrite").csv(path, header=True)


def append_rows(stored: DataFrame, new: DataFrame, path: str) -> None:
    """stored (either header) and new rows under the current header."""
    full = lambda df: df.select(*(F.col(c) if c in df.columns else F.lit("").alias(c) for c in COLUMNS))
    write_rows(full(stored).unionByName(full(new)), path)


def folder(spark: SparkSession, root: str, hashes: bool = False) -> DataFrame:
    """path (below root), length, modified, and content_hash if asked for, of every file of a type that is read."""
    endings = ",".join(sorted({e for x in PARSED_FORMATS for e in (x, x.upper())}))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{endings}}}").load(root)
    base = root.rstrip("/").removeprefix("file://")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), "^" + base.replace(".", "\\.") + "/", "")
    kept = files.select(below.alias("path"), "length", F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("content_hash")] if hashes else []))
    return kept


def to_parse(documents: DataFrame, parsed: DataFrame, version: int) -> DataFrame:
    """documents(doc_id, content_hash) without a parse of this content by this version of the parser: what is left to do."""
    done = parsed.where(F.col("parser_version") == version).select("doc_id", "content_hash")
    return documents.join(done, ["doc_id", "content_hash"], "left_anti")
