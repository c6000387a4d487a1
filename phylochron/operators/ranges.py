"""Minimum or maximum of any range of a numbered column: a table of n log n rows, from which each question is two lookups.

For every bit b the numbers are cut into halves of 2**b; a number of a right half has the minimum from the half's start to
itself, one of a left half that from itself to the half's end. The ends of a range differ first in one bit, where they lie in
two halves that meet, so the two entries at this bit cover the range. All levels come from one windowed pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans


def table(values: DataFrame, at: str, value: Column, largest: int, how: str = "min") -> DataFrame:
    """(level, at, best). at: distinct numbers from 0 to largest; level -1 holds the values themselves."""
    own = values.select(F.col(at).cast("long").alias("at"), value.alias("_v"))
    rows = own.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(max(1, int(largest).bit_length()))])))
    bit = F.expr("shiftleft(1L, level)")
    inside = F.expr("at & (shiftleft(1L, level) - 1)")
    right = F.expr("shiftright(at, level) & 1") == 1
    rows = rows.withColumn("_half", F.expr("shiftright(at, level)")).withColumn("_step", F.when(right, inside).otherwise(bit - 1 - inside))
    found = scans.running(rows, ["level", "_half"], "_step", {"best": F.col("_v")}, how, inclusive=True)
    return found.select("level", "at", "best").unionByName(own.select(F.lit(-1).alias("level"), "at", F.col("_v").alias("best")))


def answered(questions: DataFrame, low: str, high: str, table: DataFrame, name: str, how: str = "min") -> DataFrame:
    """questions with the best value of the range low..high (both ends in it, low <= high, both in the table) as `name`."""
    level = F.when(F.col(low) == F.col(high), F.lit(-1)).otherwise(F.length(F.bin(F.col(low).bitwiseXOR(F.col(high)))) - 1)
    out = questions.withColumn("_level", level)
    for end, column in (("_one", low), ("_two", high)):
        out = out.join(table.select(F.col("level").alias("_level"), F.col("at").alias(column), F.col("best").alias(end)), ["_level", column])
    return out.withColumn(name, (F.least if how == "min" else F.greatest)("_one", "_two")).drop("_level", "_one", "_two")
