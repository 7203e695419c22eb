"""Corpus pipeline: quality rules, near-duplicate removal, substring dedup, decontamination and packing of `documents`.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Every stage but the last returns the
columns of its input, so whatever else `documents` carries stays with its rows. Stages keep rows by doc_id and text; a null
doc_id is a value like others. Stage 3 drops documents that it leaves without a word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm.decontaminate import clean
from tributary.llm.near_dups import near_dups
from tributary.llm.packing import packed
from tributary.llm.quality_rules import good
from tributary.llm.shared import KEY, key_of, save, with_keys
from tributary.llm.substring_index import substring_dedup

#: The stages run native code beside DataFrame operations; SQL can't express them.
ORACLE_SQL = None

_ID = "__tributary_id"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose words are mostly content."""
    return good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the least id; of repeated rows with that id, one."""
    keyed, _ = with_keys(docs)
    ids = near_dups(keyed, KEY).where("kept").select(key_of("doc_id").alias(_ID))
    return keyed.join(ids, keyed[KEY] == ids[_ID], "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere too. A text that loses nothing stays as it is."""
    keyed, _ = with_keys(docs)
    found = substring_dedup(keyed, KEY).where("n_removed > 0").select(key_of("doc_id").alias(_ID), F.col("kept").alias("__tributary_kept")).dropDuplicates([_ID])
    joined = keyed.join(found, keyed[KEY] == found[_ID], "left")
    hit = F.col(_ID).isNotNull()
    text = F.when(hit, F.col("__tributary_kept")).otherwise(F.col("text"))
    changes = {"text": text}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(hit, F.length("__tributary_kept").cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumns(changes).where(~(hit & (F.col("text") == ""))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, as op3 returns them."""
    return packed(docs)


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
