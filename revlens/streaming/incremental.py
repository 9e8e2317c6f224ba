"""Incremental processing: new commits join what is stored, labels are given again to all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored(spark: SparkSession, at: str) -> bool:
    """Whether a table is there: a folder that holds anything but hidden files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(path) and any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(path))


def append_new(spark: SparkSession, at: str, key: str):
    """A function for foreachBatch that appends the rows of a batch whose key isn't stored, each once. Runs again without harm."""

    def batch(df: DataFrame, epoch: int) -> None:
        own = df.dropDuplicates([key])
        if stored(df.sparkSession, at):  # the first batch finds no table
            own = own.join(df.sparkSession.read.parquet(at).select(key), key, "left_anti").select(*df.columns)
        own.write.mode("append").parquet(at)

    return batch


def ingest(spark: SparkSession, source: str, schema, at: str, checkpoint: str, key: str) -> None:
    """Takes all files of a folder that the checkpoint doesn't know yet into the table at."""
    stream = spark.readStream.schema(schema).parquet(source)
    q = stream.writeStream.foreachBatch(append_new(spark, at, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def facts(spark: SparkSession, path: str, at: str, tables: dict[str, dict]) -> dict[str, DataFrame]:
    """The tables of a repository (their names and options), of which only commits that no run before has read are read from Git; the rest comes from the folder at.

    A run that finds new commits is a batch: its rows of each table, and at last the tips of all branches, which make it count. A batch that was cut short is written anew by the next run. Commits that no
    branch leads to any more stay stored; whoever reads the tables joins them with the commits that count.
    """
    from revlens.sources import git

    git.register(spark)
    read = lambda table, **kw: spark.read.format("revlens_git").options(path=path, table=table, **kw).load()
    tips = sorted({r["rev"] for r in read("refs").collect()})
    had = spark.read.parquet(f"{at}/tips").collect() if stored(spark, f"{at}/tips") else []
    batch = max((r["batch"] for r in had), default=-1) + 1
    last = sorted({r["rev"] for r in had if r["batch"] == batch - 1})
    if tips != last:
        for name, options in tables.items():
            read(name, known=" ".join({r["rev"] for r in had}), **options).write.mode("overwrite").parquet(f"{at}/{name}/batch={batch}")
        spark.createDataFrame([(t,) for t in tips], "rev string").coalesce(1).write.mode("overwrite").parquet(f"{at}/tips/batch={batch}")
    else:
        batch -= 1
    return {name: spark.read.parquet(f"{at}/{name}").where(F.col("batch") <= batch).drop("batch") for name in tables}


def relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """All rows, old ones too, with the labels of now."""
    from revlens.operators.labels import with_labels

    return with_labels(rows.drop("bug_ids"), labels)


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events by type and window, with a watermark; batch frames take it as well."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
