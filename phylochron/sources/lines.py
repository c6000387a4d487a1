"""Evidence lines: `donor receptor [weight [distance]]` separated by blanks, or `family,donor,receptor,weight[,distance]`.

All expressions are built in, so parsing stays in the scan's stage whatever the number of files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scans


def without_comment(line: Column) -> Column:
    """The line without a comment: # at its start, or after a blank or a tab."""
    return F.when(line.contains("#"), F.regexp_replace(line, r"(^|[ \t])#.*$", "")).otherwise(line)


def is_data(line: Column) -> Column:
    """Lines that hold evidence: not blank, no comment, and not the FRQ header of frequency tables."""
    bare = F.trim(line)
    return (bare != "") & ~bare.startswith("#") & ~(bare.startswith("FRQ") & bare.rlike(r"^FRQ([\s,]|$)"))


def _held(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once a row: a list of one struct is unnested, and later filters are not moved below
    that, where they would repeat each expression for every use."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with donor, receptor, weight, distance, family and problem (null: fine). Comma lines keep their
    endpoints' blanks; an empty fifth field is an unknown distance."""
    text = without_comment(F.col(line))
    rows = _held(lines.filter(is_data(text)), _text=F.trim(text))
    comma, number = F.col("_comma"), lambda c: F.expr(f"try_cast(trim({c}) as double)")
    at = lambda k: F.get(F.col("_f"), F.lit(k))
    rows = _held(rows, _comma=F.col("_text").contains(","), _f=F.when(F.col("_text").contains(","), F.split("_text", ",")).otherwise(F.split("_text", r"\s+")))
    rows = _held(
        rows,
        family=F.when(comma, at(0)),
        donor=F.when(comma, at(1)).otherwise(at(0)),
        receptor=F.when(comma, at(2)).otherwise(at(1)),
        _w=F.when(comma, at(3)).otherwise(at(2)),
        _d=F.when(comma, F.nullif(F.trim(at(4)), F.lit(""))).otherwise(at(3)),
        _n=F.size("_f"),
    )
    rows = _held(rows, weight=F.when(F.col("_w").isNull() & ~comma, F.lit(1.0)).otherwise(number("_w")), distance=number("_d"))
    inf = F.lit(float("inf"))
    problem = (
        F.when(comma & (F.col("_n") < 4), "fewer than four fields")
        .when(~comma & (F.col("_n") < 2), "fewer than two fields")
        .when((F.trim("donor") == "") | (F.trim("receptor") == ""), "blank endpoint")
        .when(F.col("weight").isNull(), "weight is no number")
        .when(F.isnan("weight") | (F.abs("weight") == inf), "weight is not finite")
        .when(F.col("weight") < 0, "weight is negative")
        .when(F.col("_d").isNotNull() & F.col("distance").isNull(), "distance is no number")
        .when(F.isnan("distance") | (F.abs("distance") == inf), "distance is not finite")
    )
    return rows.withColumn("problem", problem).drop("_text", "_comma", "_f", "_n", "_w", "_d")


def numbered(spark: SparkSession, *paths: str) -> DataFrame:
    """(value, file, line, ingest_seq): the lines of text files (also .gz) with their file, their number in it from 1, and their
    number among all from 0, in the order of the paths, then of file names, then of lines. A file that several paths name
    is read for the first of them.

    Files are read in splits, each by one task. Spark numbers the rows of a task, so a line's place in its split is its number less the
    first one's; what comes before are the sizes of other splits, one row each.
    """
    at = None
    for k, p in enumerate(paths):
        read = spark.read.text(p).select("value", F.lit(k).alias("_k"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
        at = read if at is None else at.unionByName(read)
    sizes = at.groupBy("_k", "file", "_start").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    once = Window.partitionBy("file")
    sizes = sizes.withColumn("_least", F.min("_k").over(once)).filter("_k = _least").drop("_least")
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_in_file", before(Window.partitionBy("file").orderBy("_start"))).withColumn("_of_all", before(Window.orderBy("_k", "file", "_start")))
    place = F.col("_row") - F.col("_first")
    return scans.beside(at, sizes.drop("_n"), "_k", "file", "_start").select("value", "file", (F.col("_in_file") + place + 1).alias("line"), (F.col("_of_all") + place).alias("ingest_seq"))


def read(spark: SparkSession, *paths: str, strict: bool = True) -> DataFrame:
    """Evidence of text files (also .gz), in the order of the paths; ingest_seq follows path, file and line. strict: a bad line is an
    error that names its file and line."""
    rows = parse(numbered(spark, *paths))
    if strict:
        said = F.concat(F.lit("bad evidence line: "), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("problem"), F.lit(": "), F.col("value"))
        rows = rows.filter(F.when(F.col("problem").isNull(), True).otherwise(F.assert_true(F.lit(False), said).isNull()))
    return rows.select("donor", "receptor", "weight", "family", "distance", "problem", "ingest_seq", "file", "line")


def write(evidence: DataFrame, path: str) -> None:
    """The five-column comma layout in the files of a folder, sorted by family and endpoints within and across files; an unknown distance
    is an empty field. Every task writes its own rows; a folder that exists is replaced."""
    by = ["family", "donor", "receptor"]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = evidence.repartitionByRange(*by).sortWithinPartitions(*by).select(F.concat_ws(",", *[text(c) for c in [*by, "weight", "distance"]]).alias("value"))
    rows.write.mode("overwrite").option("lineSep", "\n").text(path)
