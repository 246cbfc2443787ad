"""Session factory and the few session-level helpers every module shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "jestlake", cores: int | str = 8, **conf: str) -> SparkSession:
    """Local session with the settings the tests and the bench use; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory (a parquet file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a scan has fewer tasks than there are cores; else the scan as it is, without a shuffle.

    For work that takes far longer a row than moving it; results don't depend on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir of the session, or its checkpoint folder. ValueError where there is none.

    A local session without one gets a temporary folder, as driver and executors are one process there; a cluster never does.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    existing = spark.sparkContext._jsc.sc().getCheckpointDir()
    if existing.isDefined():
        return existing.get().rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or (master.startswith("local[") and "cluster" not in master):
        own = getattr(spark.sparkContext, "_jestlake_shared", None) or tempfile.mkdtemp(prefix="jestlake-shared-")
        spark.sparkContext._jestlake_shared = own
        return own
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once into the shared folder and go on from the files.

    Unlike a local checkpoint this outlives any executor. The files lie under a fresh name, so that two runs never meet.
    Shuffle files of the writing are deleted with it, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*cuts: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more: all that was made of them has been cut since."""
    for df in cuts:
        spark, path = df.sparkSession, getattr(df, "_cut_path", None)
        if path:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            df._cut_path = None


def ship(spark: SparkSession) -> None:
    """Make the package importable in the session's Python workers, wherever they run; once per application."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_jestlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="jestlake-")) / "jestlake.zip"  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    context.addPyFile(str(archive))
    context._jestlake_shipped = True
