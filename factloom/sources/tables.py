"""Stored tables: Parquet folders or files, read lazily so that filters and column lists reach the scan."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical_list(spark: SparkSession, path: str, names_key: str = "names") -> DataFrame:
    """A registry of canonical names from a JSON file on any file system that Spark reads: ``seq bigint, name string``.

    A missing or unreadable file gives an empty registry, as a first run has none. The file may hold a list
    of names or an object with the list under ``names_key``; registries are small, fixed lists by nature.
    """
    names: list = []
    try:
        held = json.loads(spark.read.option("wholetext", "true").text(path).first()[0])
        names = held if isinstance(held, list) else held.get(names_key, [])
    except (AnalysisException, ValueError, AttributeError, TypeError):
        names = []
    rows = [(i, str(n)) for i, n in enumerate(x for x in names if x is not None)]
    return spark.createDataFrame(rows, "seq bigint, name string")


def save_canonical_list(registry: DataFrame, path: str) -> None:
    """Writes the registry in order, beside the old file first. The list is bounded by the registry, not by the data."""
    names = [r["name"] for r in registry.select("seq", "name").orderBy("seq").toLocalIterator()]
    sc = registry.sparkSession.sparkContext
    target, part = (sc._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.part"))
    fs = sc._jvm.org.apache.hadoop.fs.FileSystem.newInstance(target.toUri(), sc._jsc.hadoopConfiguration())
    fs.setWriteChecksum(False)  # the file may be edited by hand
    out = fs.create(part, True)
    out.write(bytearray(json.dumps({"names": names}, ensure_ascii=False).encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)
    fs.close()
