"""Writing: the chunk table, run logs and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.search import latest_loads

#: Fixed value: columns of one sample of a run log.
SAMPLE = (
    "incident_id string, reference string, generated string, retrieved array<string>, assistant array<string>, input string, line_exact array<string>, line_contained array<string>, "
    "usages array<struct<cost:double>>, run string"
)


def upsert_chunks(spark: SparkSession, folder: str, loaded: DataFrame, keys: tuple[str, ...] = ("source_path", "chunk_id")) -> int:
    """Merge loaded chunks into the table in ``folder``; of one key the last load counts.

    The new state is written beside the old one and its name then recorded,
    so a failed job leaves the table as it was.  Gives the number of the
    state.  An empty or missing table takes the loads alone.
    """
    state = current_state(spark, folder)
    rows = loaded
    if state is not None:
        rows = spark.read.parquet(f"{folder}/state={state}").unionByName(loaded, allowMissingColumns=True)
    number = 0 if state is None else state + 1
    latest_loads(rows, keys).write.mode("overwrite").parquet(f"{folder}/state={number}")
    return number


def current_state(spark: SparkSession, folder: str) -> int | None:
    """The number of the last complete state of a table, None if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return None
    done = []
    for status in system.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("state=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            done.append(int(name[6:]))
    return max(done, default=None)


def read_state(spark: SparkSession, folder: str) -> DataFrame | None:
    state = current_state(spark, folder)
    return None if state is None else spark.read.parquet(f"{folder}/state={state}")


def replace_incident(rows: DataFrame, folder: str, key: str = "incident_ts") -> None:
    """Replace the chunks of the incidents in ``rows``, leave those of others (truncate and load of one incident)."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


def append_samples(samples: DataFrame, folder: str) -> None:
    samples.write.mode("append").json(folder)


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of all runs with the number of retrieved rows and the cost summed up."""
    cost = F.aggregate(F.transform("usages", lambda u: F.coalesce(u["cost"], F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)
    samples = spark.read.schema(SAMPLE).option("recursiveFileLookup", True).json(folder)
    return samples.withColumns({"n_retrieved": F.size(F.coalesce("retrieved", F.array().cast("array<string>"))), "cost": F.coalesce(cost, F.lit(0.0))})


def cost_totals(samples: DataFrame) -> DataFrame:
    return samples.groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 9).alias("total"), F.round(F.avg("cost"), 9).alias("mean"))


def write_results(statistics: DataFrame, folder: str) -> None:
    """Metric statistics (metric, mean, median, variation) as one JSON object a line."""
    statistics.coalesce(1).write.mode("overwrite").json(folder)
