"""Session settings and lineage cutting shared by every operator."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings that results depend on. Safe to call repeatedly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def local_session(name: str = "riskflow", cores: str | int = "*", shuffle: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and drop its lineage.

    A checkpoint keeps the size that the plan was estimated to have and the constraints it implies. Joins multiply estimates, so over the rounds of an
    iteration they become numbers of millions of digits and planning takes longer than the work; the frame returned knows neither.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)._jdf
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)
    out._files = kept.queryExecution().logical().rdd().getCheckpointFile().get()
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this program has written and nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(*frames: DataFrame) -> None:
    """Delete the files of ``frames``, which ``cut`` returned and nothing reads any more."""
    for df in frames:
        remove(df.sparkSession, df._files)


def sweep(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark drops shuffle files once nothing refers to them, and else they add up over the rounds of an iteration."""
    gc.collect()
    spark._jvm.System.gc()
