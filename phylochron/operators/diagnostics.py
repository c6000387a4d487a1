"""Statistics of chains and of benchmark samples. A chain is (chain_id, step, state, energy)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans


def run_stats(chain: DataFrame) -> DataFrame:
    """(chain_id, samples, distinct_states, duplicates, longest_run): repeats of neighbours and the longest run."""
    order = Window.partitionBy("chain_id").orderBy("step")
    same = F.coalesce((F.lag("state").over(order) == F.col("state")), F.lit(False))
    islands = chain.withColumn("same", same).withColumn("island", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(order))
    runs = islands.groupBy("chain_id", "island").agg(F.count("*").alias("length"), F.sum(F.col("same").cast("long")).alias("dup"))
    tail = runs.groupBy("chain_id").agg(F.sum("length").alias("samples"), F.sum("dup").alias("duplicates"), F.max("length").alias("longest_run"))
    distinct = chain.groupBy("chain_id").agg(F.count_distinct("state").alias("distinct_states"))
    return tail.join(distinct, "chain_id")


def energy_histogram(chain: DataFrame) -> DataFrame:
    return chain.groupBy("chain_id", "energy").agg(F.count("*").alias("n"))


def energy_summary(chain: DataFrame) -> DataFrame:
    """(chain_id, mean, low, high, sd): population statistics of the energy."""
    return chain.groupBy("chain_id").agg(F.round(F.avg("energy"), 6).alias("mean"), F.min("energy").alias("low"), F.max("energy").alias("high"), F.round(F.stddev_pop("energy"), 6).alias("sd"))


#: The most lags that an effective sample size sums over, and the steps of a block.
LAGS, BLOCK = 500, 4096


def autocorrelation(chain: DataFrame, lags: int = LAGS, block: int = BLOCK) -> DataFrame:
    """(chain_id, lag, rho): autocovariance at each lag over the variance. Steps are numbered by their rank, so gaps between them
    count for nothing.

    A chain is cut into blocks; a block also gets the first `lags` steps after it, sums the products of its own steps with those
    ahead, and the blocks' sums are added up. So a chain of any length is as many tasks' work, and a task holds one block.
    """
    block = max(block, lags)
    rows = chain.select(F.col("chain_id").cast("long").alias("chain_id"), F.col("step").cast("long").alias("step"), F.col("energy").cast("double").alias("energy"))
    rows = scans.ranked(rows, "_at", "chain_id", "step")
    each = rows.groupBy("chain_id").agg(F.min("_at").alias("_from"), F.count("*").alias("_n"), F.avg("energy").alias("_mean"), F.var_pop("energy").alias("_var")).filter("_var > 0")
    at = scans.beside(rows, each.select("chain_id", "_from", "_mean"), "chain_id").select("chain_id", (F.col("_at") - F.col("_from")).alias("at"), (F.col("energy") - F.col("_mean")).alias("x"))
    own = F.floor(F.col("at") / block).cast("long")
    places = F.when((F.col("at") % block < lags) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    blocks = at.withColumn("block", F.explode(places))

    def run(key, group):
        place, x = group.column("at").to_numpy(), group.column("x").to_numpy()
        x = x[np.argsort(place)]
        own = min(len(x), block)
        sums = [float(x[: min(own, len(x) - k)] @ x[k : k + own]) for k in range(1, min(lags, len(x) - 1) + 1)]
        return pa.table({"chain_id": pa.array([key[0].as_py()] * len(sums), pa.int64()), "lag": pa.array(range(1, len(sums) + 1), pa.int64()), "s": pa.array(sums, pa.float64())})

    sums = blocks.groupBy("chain_id", "block").applyInArrow(run, "chain_id long, lag long, s double").groupBy("chain_id", "lag").agg(F.sum("s").alias("s"))
    return scans.beside(sums, each, "chain_id").select("chain_id", "lag", (F.col("s") / F.col("_n") / F.col("_var")).alias("rho"))


def effective_samples(chain: DataFrame, lags: int = LAGS) -> DataFrame:
    """(chain_id, ess): n / (1 + 2 * sum of rho up to the first that is not positive)."""
    rho = autocorrelation(chain, lags)
    stop = rho.groupBy("chain_id").agg(F.min(F.when(F.col("rho") <= 1e-12, F.col("lag"))).alias("stop"), F.array_sort(F.collect_list(F.struct("lag", "rho"))).alias("all"))
    part = F.filter("all", lambda x: F.col("stop").isNull() | (x["lag"] < F.col("stop")))
    total = stop.select("chain_id", F.aggregate(part, F.lit(0.0), lambda a, x: a + x["rho"]).alias("s"))
    n = chain.groupBy("chain_id").agg(F.count("*").alias("n"))
    return n.join(total, "chain_id", "left").select("chain_id", F.round(F.col("n") / (1 + 2 * F.coalesce("s", F.lit(0.0))), 6).alias("ess"))


def batch_means(chain: DataFrame, batches: int = 10) -> DataFrame:
    """(chain_id, batch, mean) of equal batches; what does not fill the last is left out."""
    n = chain.groupBy("chain_id").agg(F.floor(F.count("*") / batches).alias("m"))
    order = Window.partitionBy("chain_id").orderBy("step")
    at = chain.withColumn("k", F.row_number().over(order) - 1).join(n, "chain_id")
    at = at.withColumn("batch", F.floor(F.col("k") / F.col("m")).cast("long")).filter(F.col("batch") < batches)
    return at.groupBy("chain_id", "batch").agg(F.round(F.avg("energy"), 6).alias("mean"))


def histogram(values: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """(bin, n): equal-width bins from the least to the largest value, the last one closed."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / width)))
    return values.join(ends).select(at.cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def median_iqr(values: DataFrame, column: str, *keys: str) -> DataFrame:
    """Median and interquartile range by linear interpolation."""
    q = values.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    return q.select(*keys, F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))
