"""Tables in the folder that all executors share, and small plumbing used by several operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Stands for a null id inside joins, so that such rows find their own results.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only on a local master where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tributary-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tributary/{uuid.uuid4().hex}/{name}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so a lost executor costs a re-read only."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def drop(table: DataFrame) -> None:
    """Delete a table made by save() that nothing reads any more."""
    remove(table.sparkSession, table.saved_at)


def release(spark: SparkSession) -> None:
    """Let the driver's collector find shuffles whose results are saved, so that executors delete those files now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _file(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; one that exists isn't overwritten."""
    fs, at = _file(spark, path)
    out = fs.create(at, False)
    out.write(text.encode())
    out.close()


def read_texts(spark: SparkSession, folder: str, prefix: str) -> list[tuple[str, str]]:
    """(name, text) of the small files of a folder whose names begin with prefix, by name; none where there is no folder."""
    fs, at = _file(spark, folder)
    out = []
    for status in fs.listStatus(at) if fs.exists(at) else []:
        name = status.getPath().getName()
        if name.startswith(prefix):
            stream = fs.open(status.getPath())
            out.append((name, spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return sorted(out)


def key_of(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("long"), F.lit(NULL_ID))


#: Rows of an Arrow batch between Spark and Python. Spark's 10,000 would hold tens of MB of texts on both sides at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, text) alone: other columns, whatever their names, never meet the operators' own."""
    small_batches(docs.sparkSession)
    return docs.select(key_of(id_col).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))


#: The column that with_keys adds.
KEY = "__tributary_key"


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """docs with KEY, one long for each (id, text), in that order (null ids first); and a table (id, key), or None where the
    keys are the ids themselves. That holds unless some id, or the null id, has several texts; only then the texts move.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    hashes = docs.select(key_of(id_col).alias("doc"), F.xxhash64(text).alias("h")).groupBy("doc").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    several = save(hashes.where("low <> high").select("doc"), "several")
    if several.isEmpty():
        return docs.withColumn(KEY, key_of(id_col)), None
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), key_of(id_col).alias("doc"), text.alias("tag"))
    marked = marked.join(several.withColumn("many", F.lit(True)), "doc", "left").select("row", "id", "doc", F.when(F.col("many"), F.col("tag")).otherwise("").alias("tag"))
    order = [F.col("id").asc_nulls_first(), F.col("tag")]
    keys = marked.select("id", "doc", "tag").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    keys = save(keys.select("id", "doc", "tag", F.monotonically_increasing_id().alias("key")), "keys")
    right = keys.select(F.col("id").alias("other"), "doc", "tag", "key")
    # The least long is a valid id too, so the null id is told apart by itself.
    joined = marked.join(right, ["doc", "tag"]).where(F.col("id").eqNullSafe(F.col("other")))
    return save(joined.select("row.*", F.col("key").alias(KEY)), "keyed"), keys.select("id", "key")


def keyed_text(keyed: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc, text) of with_keys' rows, doc being the key."""
    small_batches(keyed.sparkSession)
    return keyed.select(F.col(KEY).alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text"))


def named(out: DataFrame, keys: DataFrame | None, column: str = "doc", name: str = "doc_id") -> DataFrame:
    """out with its key column as ids again, under `name`."""
    if keys is None:
        return out.select(*(id_of(column, name) if c == column else c for c in out.columns))
    names = keys.select(F.col("key").alias(column), F.col("id").alias(name))
    return out.join(names, column).select(*(name if c == column else c for c in out.columns))


def rows_and_text(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text): each row whole, as a struct whose names can't clash, for operators that filter rows without a join."""
    small_batches(docs.sparkSession)
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))


def with_row(rows: DataFrame, ddl: str) -> StructType:
    """Schema of ddl with rows' `row` column before it."""
    return StructType([rows.schema["row"], *StructType.fromDDL(ddl).fields])


def id_of(column: str = "doc", name: str = "doc_id") -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias(name)


#: Bits of the id filter: 2048 rows of 4 KB, whatever the number of ids.
FILTER_BITS = 1 << 26


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose `doc` is in ids. A bitmap of the ids' hashes, of fixed size, keeps most others from the shuffle."""
    place = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS)) + 1
    maps = ids.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    rows = docs.withColumns({"place": F.bitmap_bit_position(place), "bucket": F.bitmap_bucket_number(place)}).join(F.broadcast(maps), "bucket")
    byte = F.conv(F.hex(F.expr("substring(bits, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    rows = rows.where(F.getbit(byte, (F.col("place") % 8).cast("int")) == 1)
    return rows.select(*docs.columns).join(ids, "doc", "left_semi")


#: Rows of a grouped table that one broadcast may hold, and the copies of its rows where it has more.
MAX_SMALL, COPIES = 100_000, 16


def join_small(rows: DataFrame, small: DataFrame, keys: list[str], spread: str, how: str = "inner") -> DataFrame:
    """rows joined with a saved table by keys (nulls are a key), so that no key's rows meet in one task; rows' columns, then small's.

    The table is counted. Up to MAX_SMALL rows are broadcast; with more, its rows are copied COPIES times and each of rows goes
    to the copy that the hash of its column `spread` names.
    """
    names = [c for c in small.columns if c not in keys]
    right = small.select(*(F.col(k).alias(f"__{k}") for k in keys), *names)
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(right[f"__{k}"])
    if small.count() <= MAX_SMALL:
        return rows.join(F.broadcast(right), on, how).select(*rows.columns, *names)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(COPIES)).cast("int"))
    many = right.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    return salted.join(many, on & (F.col("__salt") == F.col("__copy")), how).select(*rows.columns, *names)


def flat_rows(column: pa.Array, width: int) -> np.ndarray:
    """A list column whose lists all have `width` numbers and no null as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)
