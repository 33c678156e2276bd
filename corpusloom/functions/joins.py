"""Joins in which one key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(rows: DataFrame, few: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with a table that has a row a key; the rows of a key meet it in `salts` places.

    A join with an aggregate on one side is not split at run time, so a large key would be one task.
    `few` is repeated `salts` times: it should be small, or cut down to the keys that matter.
    """
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns[:8]), F.lit(salts)).cast("int"))
    again = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(again, [*on, "_salt"], how).drop("_salt")
