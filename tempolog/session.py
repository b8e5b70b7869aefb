"""Spark session defaults and durable intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Anything else (memory, executors, shuffle service) belongs to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "tempolog", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediates, readable by every executor.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_runs: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that :func:`durable` stores inside the block go to a folder of their own, which is removed at its end.

    Write or collect results inside the block: they are read from these tables.
    """
    folder = f"{shared_folder(spark)}/tables/run-{uuid.uuid4().hex}"
    _runs.append(folder)
    try:
        yield folder
    finally:
        _runs.remove(folder)
        store, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there from now on.

    Used where a result is not reproducible from its inputs alone (the bounds of a range partitioning are
    sampled), where several passes would otherwise repeat a shuffle, and for the small tables of a model.
    Later passes read only the columns they need, and a lost executor costs nothing but its running tasks.
    """
    folder = _runs[-1] if _runs else f"{shared_folder(df.sparkSession)}/tables"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
