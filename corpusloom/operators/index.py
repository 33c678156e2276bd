"""An index in a shared folder: parts of points that are only added, a small table of documents, and a log whose last row counts.

root/parts/part=<n>   points that write n embedded (doc_id, chunk_id, point_id, vector, payload)
root/documents/<n>    a row a document after write n: the part its points are in, their number, its metadata and versions
root/log              a row a finished write

A reader takes the documents table of the last logged write and the points of the parts that it names.
A write that fails before its row is logged leaves all that an earlier one shows as it was. Metadata
that changes is a change of the documents table alone: points are neither read nor written. There is
one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import plugins
from corpusloom.functions import text as X
from corpusloom.functions.tables import Log
from corpusloom.operators import oplog

DOCUMENTS = "doc_id {id}, part long, n_points long, index_version string, metadata_hash string, metadata {meta}"
#: So many documents are named where a count is wrong.
NAMED = 10


class Index:
    """An index under one folder. embed: what makes the embedder in a task; namespace: of the points' ids, a UUID."""

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[], plugins.Embedder], namespace: str):
        self.spark, self.root, self.embed, self.namespace = spark, root.rstrip("/"), embed, namespace
        self.log = Log(spark, self.root)

    def version(self) -> int:
        return self.log.version()

    def documents(self, version: int | None = None) -> DataFrame | None:
        n = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.root}/documents/{n}") if n else None

    def points(self, version: int | None = None) -> DataFrame | None:
        """The points that a write shows, each with its document's metadata of that write."""
        docs = self.documents(version)
        if docs is None:
            return None
        parts = [r.part for r in docs.where("n_points > 0").select("part").distinct().collect()]  # as many as there were writes since compact()
        stored = self.spark.read.option("basePath", f"{self.root}/parts").parquet(*(f"{self.root}/parts/part={p}" for p in parts)) if parts else None
        return None if stored is None else stored.join(docs.select("doc_id", "part", "metadata"), ["doc_id", "part"]).drop("part")

    def write(self, documents: DataFrame, chunks: DataFrame, metadata: Column, version: Column, text: Column | None = None, force: bool = False) -> DataFrame:
        """Brings the index to `documents` and gives what was done: doc_id, action, n_points.

        documents(doc_id, status, file_hash, and what metadata and version are expressions of), the
        whole listing: those it lacks are removed. chunks(doc_id, chunk_id, text, ...). Actions are
        not_chunked, indexed (embedded anew), metadata, skipped and removed. What was indexed before
        is told by the index itself. Documents indexed anew are counted after their points are
        written, and a wrong count ends the write before anything of it can be seen. A document
        without chunks has no points and is indexed; a repeated doc_id is an error.
        """
        now = self.version()
        n = now + 1
        asked = documents.select("doc_id", "status", metadata.alias("metadata"), version.alias("wanted_version"))
        asked = asked.withColumn("new_hash", F.substring(F.sha2(F.to_json("metadata", {"ignoreNullFields": "false"}), 256), 1, 16))
        if asked.groupBy("doc_id").count().where("count > 1").limit(1).count():
            raise ValueError("a doc_id is listed twice")
        old = self.documents(now)
        if old is None:
            old = self.spark.createDataFrame([], DOCUMENTS.format(id=asked.schema["doc_id"].dataType.simpleString(), meta=asked.schema["metadata"].dataType.simpleString()))
        known = asked.join(old.select("doc_id", "part", "n_points", "index_version", "metadata_hash"), "doc_id", "left")
        # a document chunked anew has a new version; a status of chunked alone says nothing once the index knows that version
        known = known.withColumn("status", F.when(F.col("status").isin("chunked", "indexed"), "indexed").otherwise(F.col("status")))
        actions = oplog.index_action(known, force)
        planned = known.join(actions, "doc_id")
        todo = planned.where("action = 'indexed'").select("doc_id")
        body = F.col("text") if text is None else text
        mine = chunks.join(todo, "doc_id", "left_semi").withColumn("_text", body)
        made = plugins.embed(mine, self.embed, "_text").drop("_text").withColumn("point_id", X.point_id(F.col("chunk_id").cast("string"), self.namespace))
        made.write.mode("overwrite").parquet(f"{self.root}/parts/part={n}")
        wanted = chunks.join(todo, "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("wanted"))
        stored = self.stored(n).groupBy("doc_id").agg(F.count("*").alias("stored"))
        counts = todo.join(wanted, "doc_id", "left").join(stored, "doc_id", "left").na.fill(0, ["wanted", "stored"])
        wrong = [f"{r.doc_id}: {r.stored} points, expected {r.wanted}" for r in counts.where("wanted <> stored").orderBy("doc_id").limit(NAMED).collect()]
        if wrong:
            raise RuntimeError("; ".join(wrong))
        new = F.col("action") == "indexed"
        kept = planned.where("action <> 'not_chunked'").join(counts, "doc_id", "left").select(
            "doc_id", F.when(new, F.lit(n)).otherwise(F.col("part")).cast("long").alias("part"), F.when(new, F.col("stored")).otherwise(F.col("n_points")).alias("n_points"),
            F.when(new, F.col("wanted_version")).otherwise(F.col("index_version")).alias("index_version"), F.col("new_hash").alias("metadata_hash"), "metadata",
        )
        # what is listed and no longer chunked keeps the points that it has
        stays = old.join(planned.where("action = 'not_chunked'").select("doc_id"), "doc_id", "left_semi")
        kept.unionByName(stays).write.mode("overwrite").parquet(f"{self.root}/documents/{n}")
        self.log.add(n)
        gone = old.join(asked.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit("removed").alias("action"))
        after = self.documents(n).select("doc_id", "n_points")
        return actions.unionByName(gone).join(after, "doc_id", "left").select("doc_id", "action", F.coalesce("n_points", F.lit(0)).alias("n_points"))

    def stored(self, part: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/parts/part={part}")

    def compact(self) -> None:
        """All points that the last write shows in one part, as a write of its own; what older writes show stays readable."""
        now = self.version()
        docs, points = self.documents(now), self.points(now)
        if points is None:
            return
        points.drop("metadata").write.mode("overwrite").parquet(f"{self.root}/parts/part={now + 1}")
        docs.withColumn("part", F.lit(now + 1).cast("long")).write.mode("overwrite").parquet(f"{self.root}/documents/{now + 1}")
        self.log.add(now + 1)
