"""Readers, ingest and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.exprs import parse_any_date, parse_date

#: The factor files' columns.
FF5 = ("DATE", "Mkt_RF", "SMB", "HML", "RMW", "CMA", "RF")
MOM = ("DATE", "Mom")


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "the table") -> DataFrame:
    """The table, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def with_year(df: DataFrame, date: str, out: str = "year") -> DataFrame:
    """The table with its date parsed and a year column; rows without a date go."""
    return df.withColumn(date, parse_any_date(date)).where(F.col(date).isNotNull()).withColumn(out, F.year(date))


def ingest(df: DataFrame, date: str, path: str, mode: str = "overwrite", rows_per_file: int = 900_000, rows_per_group: int = 220_000) -> None:
    """Write a raw table as Parquet by year, one shuffle by year and a hash within it, so that no year is one task.

    Rows without a date go, repeated rows stay, an empty table writes no partition.
    """
    rows = with_year(df, date)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(64))
    rows.repartition("year", salt).write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("parquet.block.row.count.limit", rows_per_group).partitionBy("year").parquet(path)


def scan_years(spark: SparkSession, path: str, first: int, last: int, columns: Sequence[str] | None = None) -> DataFrame:
    """The partitions of these years; both filter and columns reach the scan."""
    df = spark.read.parquet(path).where(F.col("year").between(first, last))
    return df.select(*columns) if columns else df


def snapshots(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """All snapshots of a panel written by year, or those of some years; the years reach the scan as partitions."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("year") >= first)
    return df if last is None else df.where(F.col("year") <= last)


def tagged(df: DataFrame, out: str = "asof_date") -> DataFrame:
    """Rows of files whose name holds a yyyymmdd tag, with the tag as a date."""
    return df.withColumn(out, F.try_to_date(F.regexp_extract(F.input_file_name(), r"(\d{8})[^/]*$", 1), "yyyyMMdd"))


def tagged_snapshots(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, out: str = "asof_date") -> DataFrame:
    """The files of a folder that are named by a yyyymmdd tag, with the tag as a date; others are left out.

    The tag comes from the file's metadata, so that files of other years are pruned by their names and not opened.
    """
    tag = F.regexp_extract(F.col("_metadata.file_name"), r"(\d{8})[^/]*$", 1)
    df = spark.read.parquet(path).where(tag != "")
    if first is not None:
        df = df.where(tag >= f"{first}0000")
    if last is not None:
        df = df.where(tag < f"{last + 1}0000")
    return df.select("*", F.try_to_date(tag, "yyyyMMdd").alias(out)).where(F.col(out).isNotNull())


def write_tagged(df: DataFrame, path: str, prefix: str, date: str = "asof_date") -> None:
    """One file a date, named `prefix`_yyyymmdd.parquet (S11): written by date, then moved to their names (one move a date)."""
    spark = df.sparkSession
    df.withColumn("_tag", F.date_format(date, "yyyyMMdd")).drop(date).repartition("_tag").write.mode("overwrite").partitionBy("_tag").parquet(f"{path}/_parts")
    where = spark._jvm.org.apache.hadoop.fs.Path
    files = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.listStatus(where(f"{path}/_parts")):
        name = folder.getPath().getName()
        if name.startswith("_tag=") and not name.startswith("_tag=__"):
            for k, part in enumerate(sorted((f.getPath() for f in files.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")), key=str)):
                files.rename(part, where(f"{path}/{prefix}_{name[5:]}{f'.{k}' if k else ''}.parquet"))
    files.delete(where(f"{path}/_parts"), True)


def factor_lines(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The lines of a factor file (or a folder of them): the columns as decimals, and in `rejected` the lines that are no data.

    A line is data if it begins with eight digits and a comma and these are a date: banners, headers, monthly and annual
    tables and footers are rejected. Numbers that do not parse are null.
    """
    lines = spark.read.text(path)
    parts = F.split("value", ",")
    day = F.when(F.col("value").rlike(r"^\s*\d{8},"), F.try_to_date(F.trim(parts[0]), "yyyyMMdd"))
    numbers = [F.when(F.col("_day").isNotNull(), F.trim(F.get(parts, i)).try_cast("double") / 100).alias(c) for i, c in enumerate(columns) if i]
    return lines.withColumn("_day", day).select(F.col("_day").alias(columns[0]), *numbers, F.when(F.col("_day").isNull(), F.col("value")).alias("rejected"))


def factor_file(lines: DataFrame, columns: Sequence[str], value: str = "value") -> DataFrame:
    """Data lines (those that begin with eight digits and a comma) of a text file in percent, as decimals."""
    parts = F.split(value, ",")
    rows = lines.where(F.col(value).rlike(r"^\s*\d{8},")).select(F.try_to_date(F.trim(parts[0]), "yyyyMMdd").alias(columns[0]), *[(F.trim(F.get(parts, i)).try_cast("double") / 100).alias(c) for i, c in enumerate(columns) if i])
    return rows.where(F.col(columns[0]).isNotNull())


def factor_table(five: DataFrame, momentum: DataFrame) -> DataFrame:
    """Both factor tables on the dates they share (RG1)."""
    return five.join(momentum.select("DATE", "Mom"), "DATE")


def return_series(df: DataFrame, value: str | None = None, date: str = "DATE") -> DataFrame:
    """DATE and r; without a column of returns, the change of the first numeric column."""
    require_columns(df, [date])
    if value is None:
        numeric = next((f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name != date), None)
        if numeric is None:
            raise ValueError("the table has no numeric column")
        rows = df.select(parse_date(date).alias("DATE"), F.col(numeric).cast("double").alias("level")).where("DATE is not null")
        return long_series_return(rows)
    require_columns(df, [value])
    return df.select(parse_date(date).alias("DATE"), F.col(value).cast("string").try_cast("double").alias("r")).where("DATE is not null and r is not null")


def long_series_return(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """DATE and r, the change of `level` from row to row of one long series, without sorting it in one task.

    The series is cut at approximate quantiles of its dates; a window runs in each part, and the last level of each part is handed
    on to the first row of the next that has one: a row a part, so these are few. Of rows of one date the lower level comes first.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx(F.unix_date("DATE"), [k / parts for k in range(1, parts)] or [0.5], 10_000).alias("cuts"))
    dealt = rows.crossJoin(F.broadcast(cuts)).select("DATE", "level", F.aggregate("cuts", F.lit(0), lambda n, c: n + (F.unix_date("DATE") > c).cast("int")).alias("part"))  # one row
    inside = W.partitionBy("part").orderBy("DATE", "level")
    ends = dealt.groupBy("part").agg(F.max_by("level", F.struct("DATE", F.coalesce("level", F.lit(float("-inf"))))).alias("end"))
    handed = ends.select("part", F.lag("end").over(W.orderBy("part")).alias("handed"))  # a row a part
    before = F.when(F.row_number().over(inside) == 1, F.col("handed")).otherwise(F.lag("level").over(inside))
    out = dealt.join(F.broadcast(handed), "part").select("DATE", (F.try_divide(F.col("level"), before) - 1).alias("r"))
    return out.where("r is not null")


def write_panel(df: DataFrame, path: str, date: str = "asof_date", mode: str = "overwrite") -> None:
    """A whole panel, by year."""
    df.withColumn("year", F.year(date)).write.mode(mode).partitionBy("year").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """date, rows: the snapshots that a panel of `write_new` holds in full."""
    if not _exists(spark, f"{path}/_manifest"):
        return spark.createDataFrame([], "date date, rows bigint")
    return spark.read.schema("date date, rows bigint").parquet(f"{path}/_manifest").groupBy("date").agg(F.max("rows").alias("rows"))


def write_new(df: DataFrame, path: str, key: str = "asof_date") -> None:
    """Write the snapshots that are not finished yet, date by date, then list them in a manifest.

    The dates that a run writes replace what an earlier run left of them (dynamic partition overwrite), and only the manifest, written
    last, makes them count. So a run that died half-way is mended by the next one, and a finished date is never computed again:
    the manifest's few dates are anti-joined before `df` is worked out. Rows without a date are left out.
    """
    spark = df.sparkSession
    known = F.broadcast(finished(spark, path).select(F.col("date").alias(key)))  # a row a date
    fresh = df.where(F.col(key).isNotNull()).join(known, key, "left_anti").withColumn("_on", F.date_format(key, "yyyy-MM-dd"))
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_on").parquet(path)
    written = spark.read.parquet(path) if _any(spark, path) else None
    if written is not None:
        done = written.join(known, key, "left_anti").groupBy(F.col(key).alias("date")).agg(F.count("*").alias("rows"))
        done = done.join(F.broadcast(df.select(F.col(key).alias("date")).distinct()), "date", "left_semi")  # not what another run has left half-way
        done.coalesce(1).write.mode("append").parquet(f"{path}/_manifest")


def _any(spark: SparkSession, path: str) -> bool:
    """Whether a partitioned table has a partition."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(where) and any("=" in f.getPath().getName() for f in files.listStatus(where))


def read_new(spark: SparkSession, path: str, key: str = "asof_date") -> DataFrame:
    """The finished snapshots of `write_new`'s panel; dates that a run has left half-way do not show."""
    return spark.read.parquet(path).drop("_on").join(F.broadcast(finished(spark, path).select(F.col("date").alias(key))), key, "left_semi")


def write_series(series: DataFrame, path: str) -> None:
    """Daily series (model, series, DATE, r) as one table by model and leg."""
    series.withColumnRenamed("series", "leg").repartition("model", "leg").sortWithinPartitions("DATE").write.mode("overwrite").partitionBy("model", "leg").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
