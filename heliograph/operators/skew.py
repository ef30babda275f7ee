"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Salts that the rows of one key are dealt to where it isn't counted first.
SALTS = 32


def dealt_join(many: DataFrame, one: DataFrame, keys: list[str], spread: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join ``many`` with ``one`` (one row a key), the rows of each key being dealt to ``salts`` tasks by ``spread``.

    ``one`` is repeated for each salt: leave in it only the keys that need the join.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
