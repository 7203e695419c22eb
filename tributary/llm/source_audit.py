"""Source divergence audit: how far each source's use of terms lies from its language's and from the other sources'.

Terms are maximal runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. Tasks count terms by language and source as
they read, so one row per distinct (lang, source, term) of a task is shuffled, whatever the size of a source. Smoothed shares are
integers: p = 1 + (10**9 * (count + 5)) div (N + 5 * V), in decimals of 38 digits.

Top terms are found by radix selection: the values' bits are counted DIGIT bits at a time, by group; each histogram says in which
bin a group's k-th largest value lies, and the next counts inside that bin only. After the last bits the threshold is exact. Ties
at the threshold are refined in the same way by the UTF-8 bytes of the items, from the first. No group is ever sorted whole: only the
k chosen rows are ranked.

Divergence of two sources is summed over the terms that one of them has. With z the share of a term that a source lacks,

    sum |p_a - p_b| = V * |z_a - z_b| + sum over a's terms (|p_a - z_b| - |z_a - z_b|) + the same for b's
                      + sum over common terms (|p_a - p_b| - |p_a - z_b| - |z_a - p_b| + |z_a - z_b|),

where a share depends on the count alone, so the two middle sums run over a source's histogram of counts. Common terms are joined by
(lang, term) and by blocks of PAIR_BLOCK sources, so a term that all sources have is spread over many keys.

Defined results: null text, lang and source are ''. A group without a kept term has z for all of them. A language with one source
has no rows. Repeated rows count as often as they occur; a repeated id is a document of its own. An empty table gives no rows.
Other columns are ignored. A group's rows of part `pair` are as many as its language has other sources; they are ranked by a
window, which streams them.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.shared import drop, join_small, release, save, small_batches

MIN_DOCS, PRIOR, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Bits of one histogram, and of a value: shares are at most UNIT + 1.
DIGIT, BITS = 10, 30
PAIR_BLOCK = 256
#: Bytes of an item that one round of ties reads: at most 2**24 bins of a group and those of ended items, streamed in order.
STEP = 3
#: Distinct (group, term) entries that a task holds before it sends them on.
HELD = 400_000

#: Bytes of a term stay, A-Z as a-z; all others separate. Bytes from 0x80 on are parts of characters beyond ASCII.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, from each task's own counts; term '' says how many documents a
    group has."""
    small_batches(docs.sparkSession)
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).cast("binary").alias("text"))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in seen.items():
                k = len(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * k), pa.array([source] * k), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], schema=schema)
            seen.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, d = seen[lang, source]
                before = len(n)
                words = terms(text.as_py())
                n.update(words)
                d.update(set(words))
                n[b""] += 1
                held += len(n) - before
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    found = rows.mapInArrow(emit, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, v: str) -> Column:
    """1 + (UNIT * (count + PRIOR)) div (total + PRIOR * v), exact; 0 where v is 0."""
    return F.expr(f"CASE WHEN {v} > 0 THEN 1 + ({UNIT}BD * CAST({count} + {PRIOR} AS DECIMAL(28,0))) div CAST({total} + {PRIOR} * {v} AS DECIMAL(28,0)) ELSE 0 END").cast("long")


def top_rows(rows: DataFrame, group: list[str], value: str, item: str, k: int) -> DataFrame:
    """rows with `rank`, for the k first rows of each group by value descending, then item's UTF-8 bytes ascending.

    rows is a saved table; values are from 0 to 2**BITS - 1, and a group's items distinct.
    """
    state = None
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        live = rows.select(*group, F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"), F.col(value).alias("x"))
        if state is not None:
            live = join_small(rows.select(*group, F.col(value).alias("x")), state, group, "x").where(F.shiftright("x", shift + DIGIT) == F.col("prefix"))
        bins = live.groupBy(*group, "prefix", "need", F.shiftright("x", shift).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        state = save(_bin_of_kth(bins, group, F.col("bin").desc()).select(*group, F.col("bin").alias("prefix"), "left"), "threshold").withColumnRenamed("left", "need")
    # A group of fewer than k rows ends at its least value, with all of that value's rows needed.
    rows = join_small(rows, state.select(*group, F.col("prefix").alias("__least"), "need"), group, item)
    ties = rows.where(F.col(value) == F.col("__least"))
    cut = _tie_cuts(ties, group, item)
    places = join_small(rows.drop("need"), cut, group, item, "left")
    text = F.encode(F.col(item), "UTF-8")
    within = F.col("__cut").isNull() | (F.substr(text, F.lit(1), F.col("__reach")) <= F.col("__cut"))
    chosen = places.where((F.col(value) > F.col("__least")) | ((F.col(value) == F.col("__least")) & within)).drop("__least", "__cut", "__reach")
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col(value).desc(), item)))


def _bin_of_kth(bins: DataFrame, group: list[str], order: Column) -> DataFrame:
    """The bin of each group in which its need-th row lies (the last where there are fewer), with `left`: how many of the bin's rows are needed, and n: how many it has."""
    by = Window.partitionBy(*group).orderBy(order)
    upto = bins.withColumns({"upto": F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "last": F.lead("n").over(by).isNull()})
    first = (F.col("upto") >= F.col("need")) | F.col("last")
    return upto.where(first & (F.col("upto") - F.col("n") < F.col("need"))).withColumn("left", F.least(F.col("need") - F.col("upto") + F.col("n"), F.col("n")))


def _tie_cuts(ties: DataFrame, group: list[str], item: str) -> DataFrame:
    """(group, __cut, __reach): a tied item is taken if its first __reach bytes aren't above the cut; for groups that take some of their ties only."""
    ties = save(ties.select(*group, "need", F.encode(F.col(item), "UTF-8").alias("text")), "ties")
    sizes = ties.groupBy(*group, "need").agg(F.count(F.lit(1)).alias("n")).where("n > need")
    found = save(sizes.select(*group, F.lit(b"").alias("prefix"), F.col("need").alias("left"), "n"), "cut")
    cuts = lambda reach: [*group, F.col("prefix").alias("__cut"), F.lit(reach).alias("__reach")]
    done = found.select(*cuts(0)).limit(0)
    at = 0
    while not (live := found.where("n > left")).isEmpty():
        # STEP bytes a round; the end of an item comes before all others.
        live = join_small(ties.select(*group, "text"), live.drop("n"), group, "text").where(F.substring("text", 1, at) == F.col("prefix"))
        bins = live.groupBy(*group, F.col("left").alias("need"), F.substring("text", 1, at + STEP).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        found = save(_bin_of_kth(bins, group, F.col("bin").asc()).select(*group, F.col("bin").alias("prefix"), "left", "n"), "cut")
        # All of the bin's rows are needed: the cut is its prefix. Items are distinct, so an ended item is alone.
        done = done.unionByName(found.where("n = left").select(*cuts(at + STEP)))
        at += STEP
    return done


def pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value), a < b: summed differences of two sources of a language.

    shares: lang, source, term, p of terms that occur; groups: lang, source, v, z of every group; both saved.
    """
    right = save(groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"), "v"), "others")
    gap = F.abs(F.col("z") - F.col("zb"))
    each = join_small(groups.select("lang", F.col("source").alias("a"), "z"), right, ["lang"], "a").where("a < b")
    base = each.select("lang", "a", "b", (F.col("v") * gap).alias("value"))
    levels = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    levels = join_small(levels, save(groups.select("lang", "source", "z"), "own"), ["lang", "source"], "p")
    levels = join_small(levels, right.drop("v"), ["lang"], "p").where("source <> b")
    alone = levels.select("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), (F.col("n") * (F.abs(F.col("p") - F.col("zb")) - gap)).alias("value"))
    # Sources of a language in blocks; a row meets each pair of blocks once.
    numbered = groups.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / PAIR_BLOCK).cast("int"))
    numbered = numbered.withColumn("last", F.max("block").over(Window.partitionBy("lang")))
    rows = join_small(shares.select("lang", "source", "term", "p"), save(numbered.select("lang", "source", "z", "block", "last"), "blocks"), ["lang", "source"], "term")
    left = rows.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"), F.col("block").alias("x"), F.explode(F.sequence("block", "last")).alias("y"))
    other = rows.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("x"), F.col("block").alias("y"))
    common = left.join(other, ["lang", "term", "x", "y"]).where("a < b")
    both = F.expr("abs(pa - pb) - abs(pa - zb) - abs(za - pb) + abs(za - zb)")
    common = common.groupBy("lang", "a", "b").agg(F.sum(both).alias("value"))
    return base.unionByName(alone).unionByName(common).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of every group."""
    found = save(counts(docs, text_col, lang_col, source_col), "counts")
    release(docs.sparkSession)
    words = found.where("term <> ''")
    kept = save(words.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= MIN_DOCS).select("lang", "term", "total"), "terms")
    held = save(words.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "held")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = found.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_n", "v", "lang_n"])
    groups = save(groups.withColumn("none", F.lit(0)).withColumn("z", share("none", "group_n", "v")).drop("none"), "groups")
    shares = join_small(held, groups, ["lang", "source"], "term").withColumns({"p": share("n", "group_n", "v"), "q": share("total", "lang_n", "v")})
    shares = save(shares.select("lang", "source", "term", "p", "q"), "shares")
    drop(found)
    drop(held)
    over = save(shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")), "over")
    first = top_rows(over, ["lang", "source"], "value", "item", TOP).withColumn("part", F.lit("term"))
    both = pairs(shares, groups)
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("side")
    each = both.select("lang", "value", sides).select("lang", "side.source", "side.item", "value", F.lit("pair").alias("part"))
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return first.select(*columns).unionByName(each.select(*columns))


def op12_source_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
