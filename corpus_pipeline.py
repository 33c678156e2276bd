"""Documents to token ids: toxic and poor texts go, near copies go, sources are mixed, the rest is encoded.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All stages but the last
return the columns of documents. No SQL can express the classifiers or the recursive encoding, so
ORACLE_SQL is None and tests compare run() with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import bpe, mixing, quality, simhash, toxicity
from corpusloom.llm.common import Scratch, read

#: The mix keeps this many thousandths of its input's tokens and takes no text twice.
MIX_BUDGET, MIX_EPOCHS = 800, 1
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier does not reject, learnt from the labels of these rows.

    A null text is scored as an empty one; long texts are scored whole; repeated rows stay or go
    together; a score of exactly the threshold goes; columns of any name stay; no rows give no rows.
    """
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier does not reject, learnt from the labels of these rows.

    A null text is scored as an empty one; long texts are scored whole; repeated rows stay or go
    together; a score of exactly the threshold stays; columns of any name stay; no rows give no rows.
    """
    return quality.without_poor(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near copies.

    Null and empty texts are copies of each other; of repeated rows one stays, of rows that share the
    doc_id the least; a group without any doc_id keeps one row; columns of any name stay; no rows give no rows.
    """
    return simhash.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, once each.

    A null lang or source is an empty name; a null text has no tokens; repeated rows are taken or
    left together; ties of the order go by id; columns of any name stay; no rows give no rows.
    """
    return mixing.mix(docs, budget=MIX_BUDGET, epochs=MIX_EPOCHS).select("row.*")


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the digests of ids and decoded bytes of each row.

    A null or empty text has no ids; long texts and long words are encoded whole; repeated rows and
    null ids come back as often; other columns are not read; no rows give no rows.
    """
    return bpe.encode_with_digests(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("quality classifier", reject_poor),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256 of the documents that every stage kept."""
    scratch, docs, last = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        at = scratch.path(name.split()[0].lower())
        docs = scratch.keep(stage(spark, docs, sf_dir), name, at)
        if last:
            scratch.drop(last)
        last = at
    return docs
