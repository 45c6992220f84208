"""Shared storage and small helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Keys that hold more than this share of all rows are handled apart; there are fewer than this many.
HOT = 2000
#: Where the counts are known beforehand, so many rows of a key are too few to be handled apart.
LIGHT = 100


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, level: int = 3, row_group: int = 128 << 20) -> DataFrame:
    """Write `df` to the shared folder and read it back: this cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.block.size", row_group).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """`stored`, and aggregates of its rows that the write takes on its way: no further job, plan or threads on the driver."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), name)
    return out, seen.get or out.agg(*[c.alias(k) for k, c in measures.items()]).first().asDict()


def counted(groups: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """`groups` (a row a key, with n) stored, and how many they are, the sum of all n and the greatest, as `meet` takes them."""
    return measured(groups, name, rows=F.count(F.lit(1)), total=F.coalesce(F.sum("n"), F.lit(0)), most=F.coalesce(F.max("n"), F.lit(0)))


def meet(rows: DataFrame, groups: DataFrame, keys: list[str], apart: list[str], counts: dict | None = None) -> DataFrame:
    """`rows` with the columns of `groups` (a stored row a key, with n, how many rows have it), or nulls where there is none.

    Keys (whole numbers) that more than one HOT-th of all n have are fewer than HOT, and meet their rows by a broadcast;
    the other rows meet theirs by hash, so that no task gets more than a HOT-th of the rows for one key's sake. `apart`
    names columns that tell the rows of a key apart. With the `counts` of `counted`, keys of up to LIGHT rows are never
    handled apart, and where no key is, one join by hash is all.
    """
    values = [c for c in groups.columns if c not in keys]
    most = (groups.agg(F.sum("n")).first()[0] or 0) / HOT if counts is None else max(counts["total"] / HOT, LIGHT)
    if counts is not None and counts["most"] <= most:
        return rows.join(groups, keys, "left").select(*[c for c in rows.columns if c not in keys], *keys, *values)
    hot = groups.where(F.col("n") > most).select(*keys, F.struct(*values).alias("_hot"))  # fewer than HOT rows
    cold = groups.where(F.col("n") <= most).select(*keys, F.struct(*values).alias("_cold"))
    tagged = rows.join(F.broadcast(hot), keys, "left")
    spread = [F.when(F.col("_hot").isNull(), F.col(k)).otherwise(F.xxhash64(*apart)).alias(k) for k in keys]  # hot rows go anywhere
    own = [c for c in rows.columns if c not in keys]
    met = tagged.select(*own, *[F.col(k).alias(f"_{k}") for k in keys], "_hot", *spread).join(cold, keys, "left")
    found = F.coalesce("_hot", F.when(F.col("_hot").isNull(), F.col("_cold")))
    return met.select(*own, *[F.col(f"_{k}").alias(k) for k in keys], found.alias("_found")).select(*own, *keys, *[f"_found.{c}" for c in values])


def forget(df: DataFrame) -> None:
    """Delete the files of a table that `stored` wrote and that no later step reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

