"""Running sums and minima along a numbered column, ranks, and ranges of rows, without a task that holds a whole group.

A running value is made in blocks: within each block of the numbered column by a window, over the blocks by a window on
their totals, and both are put together. A group of n rows is n / BLOCK window partitions and one of n / BLOCK rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stored

#: Numbers of the running column that make a block.
BLOCK = 4096

_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}
_COMBINE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}


def running(rows: DataFrame, keys: list[str], at: str, columns: dict[str, Column], how: str = "sum", inclusive: bool = False, block: int = BLOCK) -> DataFrame:
    """rows with columns: of each, the sum (min, max) over the rows of the same keys with a smaller `at` (and the row's own, if
    inclusive). at: numbers from 0, unique within keys where rows are told apart; keys are not null. An empty sum is 0, an empty
    min or max is null."""
    aggregate, combine = _AGGREGATE[how], _COMBINE[how]
    rows = rows.withColumns({"_block": F.floor(F.col(at) / block).cast("long")} | {f"_in_{c}": e for c, e in columns.items()})
    within = Window.partitionBy(*keys, "_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    over = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(*[aggregate(f"_in_{c}").alias(f"_of_{c}") for c in columns])
    totals = totals.select(*keys, "_block", *[aggregate(f"_of_{c}").over(over).alias(f"_before_{c}") for c in columns])
    out = rows.withColumns({f"_near_{c}": aggregate(f"_in_{c}").over(within) for c in columns}).join(totals, [*keys, "_block"])
    return out.withColumns({c: combine(F.col(f"_near_{c}"), F.col(f"_before_{c}")) for c in columns}).drop("_block", *[f"{p}{c}" for c in columns for p in ("_in_", "_near_", "_before_")])


#: Rows of a side table that are broadcast at most.
FEW = 100_000


def beside(rows: DataFrame, small: DataFrame, *keys: str) -> DataFrame:
    """rows joined with the one row of `small` for their keys. Its rows are counted: few are broadcast, so that a key of very many
    rows stays where it is; with more, keys are many, and each is split further by a number of the row."""
    if small.count() <= FEW:
        return rows.join(F.broadcast(small), list(keys))
    split = small.withColumn("_split", F.explode(F.array(*[F.lit(k) for k in range(16)])))
    return rows.withColumn("_split", F.pmod(F.hash(*rows.columns), F.lit(16))).join(split, [*keys, "_split"]).drop("_split")


#: Tasks among which `spread` deals its blocks at most.
MOST_PARTS = 100_000
#: Rows that a task of `spread` makes, about.
SPREAD = 2_000_000


def spread(rows: DataFrame, start: Column, count: Column, name: str, block: int = BLOCK) -> DataFrame:
    """rows, each repeated for the numbers start, start + 1, ... of its range of `count`, which is column `name`; a range of 0 has
    none. Ranges are cut into blocks first, so a long one is no long array, and blocks are dealt out by how many rows they make, as
    few rows in one task may have very long ranges."""
    rows = rows.withColumn("_start", start.cast("long")).withColumn("_count", count.cast("long")).filter("_count > 0")
    rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_count") - 1) / block))))
    whole = rows.filter("_part = 0").agg(F.sum("_count")).first()[0] or 0
    if whole > SPREAD:
        rows = rows.repartition(min(MOST_PARTS, whole // SPREAD + 1))
    low = F.col("_start") + F.col("_part") * block
    high = F.least(F.col("_start") + F.col("_count"), low + block) - 1
    return rows.withColumn(name, F.explode(F.sequence(low, high))).drop("_start", "_count", "_part")


def ranked(rows: DataFrame, name: str, *order: str | Column, parts: int | None = None) -> DataFrame:
    """rows with their rank from 0 in column `name`, by a sort into ranges whose sizes are then added up: a full order of all
    rows without one task that sees them all. order: names or columns that decide every tie that matters."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    at = stored(at, "ranked")
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a partition
    return at.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_row") - F.col("_first")).cast("long")).drop("_part", "_row", "_first", "_before")


def inversions(rows: DataFrame, keys: list[str], at: str, rank: str, largest: int, weight: Column | None = None, asked: Column | None = None) -> DataFrame:
    """(keys, n): how many pairs of rows of the same keys have the smaller `at` at the larger `rank`, each counted `weight` of its
    first row times `asked` of its second (1 unless given). Ranks are from 0 to `largest`.

    Two ranks differ first in one digit. So for each digit, rows that share all higher digits are run through along `at`, and each
    counts the rows before it whose digit is larger: (rows) x (digits) rows, and no pair is ever made.
    """
    digits = max(1, -(-max(1, int(largest).bit_length()) // DIGIT_BITS))
    base = 1 << DIGIT_BITS
    rows = rows.select(*keys, F.col(at).cast("long").alias("_at"), F.col(rank).cast("long").alias("_rank"), (F.lit(1) if weight is None else weight).cast("long").alias("_w"), (F.lit(1) if asked is None else asked).cast("long").alias("_q"))
    rows = rows.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in range(digits)])))
    shifted = reduce(lambda rest, k: F.when(F.col("_level") == k, F.shiftright("_rank", DIGIT_BITS * k)).otherwise(rest), range(digits), F.col("_rank"))
    rows = rows.withColumn("_high", F.shiftright(shifted, DIGIT_BITS)).withColumn("_digit", shifted.bitwiseAND(F.lit(base - 1)).cast("int")).drop("_rank")
    counts = {f"_c{d}": F.when(F.col("_digit") > d, F.col("_w")).otherwise(F.lit(0)) for d in range(base - 1)}
    found = running(rows, [*keys, "_level", "_high"], "_at", counts)
    own = F.element_at(F.array(*[F.col(c) for c in counts], F.lit(0).cast("long")), F.col("_digit") + 1)
    return found.groupBy(*keys).agg(F.sum(own * F.col("_q")).cast("long").alias("n"))


#: Bits of a digit of a rank in `inversions`.
DIGIT_BITS = 4
