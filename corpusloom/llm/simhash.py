"""SimHash near-duplicates, found by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, frugal, give_back, release, texts
from .components import components, forest

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Classes of the variant space (a power of two), one after the other: each one's shuffle is a small multiple of the fingerprints.
PARTS = 8
#: Variants that one group sorts at once, in the mean.
GROUP_VARIANTS = 1_500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's word shingles; no words: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 8192):
        to = min(n, at + 8192)
        some = [digest(line[s:e], SEED) for s, e in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())]
        bits = np.unpackbits(np.array(some, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def ball(radius: int) -> np.ndarray:
    """Masks of at most radius bits, as uint64."""
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(64), k)], np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), a row for each row of docs."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _classes(masks: np.ndarray, parts: int) -> np.ndarray:
    """A class below `parts` (a power of two) for each value, such that the class of a ^ b is that of a ^ that of b.

    A bit of the class is the parity of about half the value's bits. So every fingerprint has about
    as many variants in each class, and its masks for a class are known without making the others.
    """
    draw = np.random.default_rng(SEED)
    made = np.zeros(len(masks), np.int64)
    for bit in range(parts.bit_length() - 1):
        made |= (np.bitwise_count(masks & draw.integers(0, 2**64, dtype=np.uint64)) & 1).astype(np.int64) << bit
    return made


def _emit(part: int, parts: int, groups: int, radius: int):
    """The variants of class `part` of each fingerprint, packed by group: a mask's class is the fingerprint's ^ part."""
    masks = ball(radius // 2)
    of = _classes(masks, parts)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            mine = _classes(fps, parts) ^ part
            for c in range(parts):
                which = np.flatnonzero(of == c).astype("<u2")
                some = fps[mine == c]
                for at in range(0, len(some), 4096):
                    values = (some[at : at + 4096, None] ^ masks[which][None, :]).ravel()
                    told = np.tile(which, len(values) // max(1, len(which)))
                    group = (((values * _MIX) >> np.uint64(32)) % np.uint64(groups)).astype(np.int32)
                    order = np.argsort(group, kind="stable")
                    values, told, group = values[order], told[order], group[order]
                    ends = np.flatnonzero(np.diff(group, append=-1)) + 1
                    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group[starts]), pa.array([values[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()), pa.array([told[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())],
                        ["g", "variant", "mask"],
                    )

    return run


def _collide(radius: int):
    masks = ball(radius // 2)

    def run(table: pa.Table) -> pa.Table:
        join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
        variant, which = join("variant", "<u8"), join("mask", "<u2")
        some = np.sort(variant)
        twice = np.unique(some[1:][some[1:] == some[:-1]])
        if not len(twice):
            del variant, which, some
            give_back()
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        slot = np.minimum(np.searchsorted(twice, variant), len(twice) - 1)
        hit = twice[slot] == variant
        slot, fp = slot[hit], variant[hit] ^ masks[which[hit]]
        order = np.lexsort((fp, slot))
        slot, fp = slot[order], fp[order]
        first = np.concatenate([[True], slot[1:] != slot[:-1]])
        head = fp[np.flatnonzero(first)][np.cumsum(first) - 1]
        pair = np.unique(np.stack([head, fp], 1)[head != fp], axis=0)
        pair = pair[np.bitwise_count(pair[:, 0] ^ pair[:, 1]) <= radius]  # two variants of one value are as near as this
        a, b = forest(pair[:, 0].view(np.int64), pair[:, 1].view(np.int64))
        del variant, which, some, hit, slot, fp, order
        give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _groups(docs: DataFrame, scratch: Scratch, shingle: int, radius: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """rows(doc_id, fp), and for each fingerprint its group and the group's smallest doc_id: fp, c, component_id."""
    if radius % 2 or parts & (parts - 1):
        raise ValueError("radius must be even and parts a power of two")
    spark = docs.sparkSession
    rows = scratch.keep(fingerprints(docs, shingle), "rows")
    distinct = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    n = distinct.count()
    groups = max(1, -(-n * len(ball(radius // 2)) // (parts * GROUP_VARIANTS)))
    tasks = max(1, min(-(-n // 2_000), max(n // 50_000, spark.sparkContext.defaultParallelism)))
    schema, found = "a long, b long", scratch.path("links")
    for part in range(parts):
        packed = distinct.select("fp").repartition(tasks, "fp").mapInArrow(_emit(part, parts, groups, radius), "g int, variant binary, mask binary")
        packed.groupBy("g").applyInArrow(_collide(radius), schema).write.mode("append").parquet(found)
        release(spark)
    links = spark.read.schema(schema).parquet(found)
    labels = components(links, scratch)
    of = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    of = scratch.keep(of, "of")
    least = scratch.keep(of.groupBy("c").agg(F.min("least").alias("component_id")), "least")  # written down, so that a large group's join can be split
    return rows, scratch.keep(of.join(least, "c").select("fp", "c", "component_id"), "named")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Every distinct fingerprint emits all values within radius // 2 bits (radius must be even); the
    values are shuffled packed, and two fingerprints that meet in one value differ in at most
    radius bits, which is checked. Two fingerprints within radius always meet in some value, so no
    link is missed. Each group gives a spanning forest of its links, not all pairs, so a large
    group of copies stays linear. The values are dealt in `parts` shares, one after the other, so
    that the shuffle on disk stays about as large as the texts.

    Null text counts as empty; empty texts have fingerprint zero and link like any other. Rows with
    one doc_id several times come back as often; a row without doc_id comes back too and names
    no component (null only if no other id is in it). An empty table gives no rows. Other columns
    of docs are not read.
    """
    rows, named = _groups(docs, Scratch(docs.sparkSession, "simhash"), shingle, radius, parts)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named.drop("c"), "fp").select("doc_id", digits, "component_id")


def without_near_copies(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """One row of docs, all columns, of each group that simhash_groups finds: the one with the smallest doc_id.

    Of a group's rows with that doc_id the least (by all columns that have an order) stays; a group
    without any doc_id keeps its least row. An id whose texts are in several groups can stay once in
    each. Texts move once, to where their id is decided; only those of ids in several groups, and of
    rows without an id, are fingerprinted again. Null, empty and very long texts are as in
    simhash_groups; columns of any name pass through as they are; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows, named = _groups(docs, scratch, shingle, radius, parts)
    ids = rows.where("doc_id is not null").join(named, "fp").groupBy("doc_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    ids = scratch.keep(ids.where("stays").select("doc_id", (F.col("lo") != F.col("hi")).alias("mixed")), "ids")
    mixed = scratch.keep(ids.where("mixed").select("doc_id"), "mixed")  # written down, so that its size is known and the texts need not move for it
    order = F.struct(*(F.col(f"row.`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()))
    # the caller's columns are one struct, so that none meets a name used here
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    some = whole.where("id is not null")
    clear = some.join(ids.where("not mixed").select(F.col("doc_id").alias("id")), "id", "left_semi").groupBy("id").agg(F.min_by("row", order).alias("row"))
    several = whole.where("id is null").unionByName(some.join(mixed.withColumnRenamed("doc_id", "id"), "id", "left_semi"))
    several = several.withColumn("fp", _fingerprint_of("row.text", shingle)).join(named, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    return clear.select("row.*").unionByName(several.groupBy("id", "c").agg(F.min_by("row", order).alias("row")).select("row.*"))


def _fingerprint_of(column: str, shingle: int) -> Column:
    @F.pandas_udf("long")
    def of(some: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x, shingle) for x in some], np.uint64).view(np.int64))

    return of(column)
