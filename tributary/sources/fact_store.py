"""Facts kept over scans: a text is parsed once, whatever files hold it, and each scan is a version of the tree."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators.fixpoint import cut
from tributary.sources import parse

FACTS = f"digest string, batch string, {parse.FACTS}"
TREE = "file_path string, language string, digest string"


def digest() -> Column:
    """What facts are known by: the language and the content. Null without content."""
    return F.when(F.col("content").isNotNull(), F.sha2(F.concat("language", F.lit("\n"), "content"), 256))


class FactStore:
    """Parquet under one folder: batches of facts by digest, and a manifest (file_path, language, digest) per version.

    A batch or manifest counts when its job has committed, the batch's digests after its facts; what a lost driver leaves behind
    isn't read. Two scans at once may parse the same text: its facts come from the least batch that holds it. Paths are unique
    within a scan.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _committed(self, kind: str) -> list[str]:
        """Names under a folder whose write has committed, sorted."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        system = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []
        return sorted(n for n in names if system.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _held(self) -> DataFrame:
        """(digest, batch): the least batch of each text."""
        return self.parsed().groupBy("digest").agg(F.min("batch").alias("batch"))

    def versions(self) -> list[int]:
        return [int(v) for v in self._committed("trees")]

    def update(self, files: DataFrame) -> int:
        """Parses the texts of files (file_path, language, content) that the store doesn't hold; returns the new version of the tree."""
        tree = cut(files.select("file_path", "language", digest().alias("digest")))
        fresh = tree.where("digest is not null").groupBy("digest").agg(F.min("file_path").alias("file_path")).join(self._held(), "digest", "left_anti")
        fresh = cut(fresh)
        if not fresh.isEmpty():
            batch = uuid.uuid4().hex
            found = parse.facts(files.select("file_path", "language", "content").join(fresh.select("file_path"), "file_path"))
            found.join(fresh, "file_path").withColumn("batch", F.lit(batch)).select(*(c.split()[0] for c in FACTS.split(", "))).write.parquet(f"{self.path}/facts/{batch}")
            fresh.select("digest", F.lit(batch).alias("batch")).write.parquet(f"{self.path}/digests/{batch}")
        version = max(self.versions(), default=0) + 1
        tree.write.parquet(f"{self.path}/trees/{version:09d}")
        return version

    def tree(self, version: int) -> DataFrame:
        """Its files; version 0 is the empty tree."""
        return self._read(TREE, [f"{self.path}/trees/{version:09d}"] if version else [])

    def facts(self, version: int) -> DataFrame:
        """FACTS of a version's files, as parse.facts gives them, without parsing."""
        wanted = cut(self.tree(version).select("file_path", "digest").join(self._held(), "digest"))
        # One name per scan that parsed something: only their folders are read.
        batches = [r.batch for r in wanted.select("batch").distinct().collect()]
        rows = self._read(FACTS, [f"{self.path}/facts/{b}" for b in sorted(batches)]).drop("file_path")
        return wanted.join(rows, ["digest", "batch"]).select(*(c.split()[0] for c in parse.FACTS.split(", ")))

    def parsed(self) -> DataFrame:
        """(digest, batch): every parse of a text so far."""
        return self._read("digest string, batch string", [f"{self.path}/digests/{b}" for b in self._committed("digests")])

    def changes(self, version: int) -> DataFrame:
        """(file_path, change): what was added, changed or removed since the version before."""
        old, new = (self.tree(v).select("file_path", F.coalesce("digest", F.lit("")).alias(name)) for v, name in ((version - 1, "old"), (version, "new")))
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
        return old.join(new, "file_path", "full").select("file_path", change.alias("change")).where("change is not null")
