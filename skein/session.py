"""Session helpers: where code and intermediate tables live."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and benches."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skein")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="skein-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie in the shared folder."""
    return f"{shared_dir(spark)}/skein-{spark.sparkContext.applicationId}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reaches."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_tables(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once no result that reads them is needed."""
    drop_path(spark, tables_dir(spark))


def ship_code(spark: SparkSession) -> None:
    """Let Python workers that see this folder import the package from it. A cluster has it installed, or gets it by --py-files."""
    environment = spark.sparkContext.environment
    paths = [p for p in (environment.get("PYTHONPATH"), ROOT) if p]
    if ROOT not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(paths)


def drop_table(table: DataFrame) -> None:
    """Delete the files of an intermediate table that nothing reads any more."""
    for folder in {os.path.dirname(f) for f in table.inputFiles()}:
        drop_path(table.sparkSession, folder)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so once the driver's collectors have found them unused.

    Python's comes first: handles of JVM objects are cycles, and hold what they stand for until it has run. The threads of the last
    query hold it until they run another one, so that without the count its shuffles, often the largest, would stay.
    """
    gc.collect()
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()


#: Estimated bytes of what a task reads, from which on there are as many tasks as Spark makes; and the tasks a core below that.
TASK_BYTES, A_CORE = 8 << 20, 2


def estimated_bytes(df: DataFrame) -> int:
    """What Spark's optimizer takes a table's size for: that of the files read, multiplied by joins."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:  # a product of thousands of digits
        return 1 << 62


def tasks_for(df: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """So many tasks that each has about task_bytes, and a few a core for what is small: it grows with the data."""
    return max(A_CORE * df.sparkSession.sparkContext.defaultParallelism, min(estimated_bytes(df) // task_bytes + 1, 1 << 20))


def few_files(df: DataFrame) -> DataFrame:
    """A small table in few partitions, each of which costs a file's opening. One that isn't small is left as it is."""
    return df.coalesce(tasks_for(df))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_dir(df.sparkSession)
    return few_files(df).checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, and every executor sees the same rows. Unlike a
    checkpoint it is compressed, made once, and Spark knows its size."""
    path = f"{tables_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    few_files(df).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ordinal(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows from 0 in an order: sorted by ranges, then each partition's numbers start where the ones before it end.

    Only the partitions' row counts come to the driver.
    """
    place = f"_{name}"
    rows = checkpointed(df.orderBy(*order).withColumn(place, F.monotonically_increasing_id()))
    part = F.shiftright(place, 33)
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = {}, 0
    for k, n in counts:
        offsets[k], total = total, total + n
    first = F.create_map(*[F.lit(x).cast("long") for pair in offsets.items() for x in pair]) if offsets else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return rows.withColumn(name, F.element_at(first, part) + F.col(place).bitwiseAND((1 << 33) - 1)).drop(place)
