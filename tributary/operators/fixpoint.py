"""Bounded iteration: a frontier joined again and again, with lineage cut by tables in the cluster's checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only on a local master where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/tributary-rounds/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver's collector find shuffles whose results are cut off, so that executors delete those files now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def iterate(seed: DataFrame, step: Callable[[DataFrame, int], DataFrame], key: list[str], max_depth: int) -> DataFrame:
    """seed and all that `step` reaches from it, each key once, at the first round that reaches it.

    step(frontier, round) gives candidate rows with seed's columns and one row per key; keys seen before are dropped. Rounds
    end at max_depth or when nothing is new.
    """
    seen = frontier = cut(seed)
    for depth in range(1, max_depth + 1):
        fresh = step(frontier, depth).select(*seed.columns).dropDuplicates(key).join(seen.select(*key), key, "left_anti").select(*seed.columns)
        frontier = cut(fresh)
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen
