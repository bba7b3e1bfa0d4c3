"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "factloom") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession) -> str:
    """The folder that every executor shares.

    A cluster names it in ``spark.checkpoint.dir``. A folder of this machine is taken only where that
    setting is absent, as in tests on ``local[*]``; on a real cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not set_to:
        if sc._jsc.sc().getCheckpointDir().isDefined():
            set_to = sc._jsc.sc().getCheckpointDir().get()
        elif sc.master.startswith("local[") or sc.master == "local":
            set_to = "file://" + tempfile.mkdtemp(prefix="factloom-")
            sc.setCheckpointDir(set_to)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return set_to.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: cuts the lineage and survives lost executors."""
    return write_work(df, name)[0]


def write_work(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{work_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_work(spark: SparkSession, path: str) -> None:
    """Removes a table that :func:`write_work` wrote and that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def parallel(spark: SparkSession, df: DataFrame, *by: str) -> DataFrame:
    """Spreads a table that sits in fewer files than there are cores over all of them, for steps heavy in CPU."""
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, *by) if df.rdd.getNumPartitions() < cores else df


def hash_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About ``rows`` rows (all, if there are fewer), chosen by a hash of ``keys``: repeatable, without a sort, and never more than a few standard
    deviations above ``rows`` whatever the size of the table."""
    from pyspark.sql import functions as F

    total = df.count()
    if total <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * rows / total))


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: sends it to the executors once, unless their path has it already."""
    import os
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    paths = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root.parent in paths or getattr(sc, "_factloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="factloom-")) / "factloom.zip"  # Spark serves the file to the executors
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._factloom_shipped = True
