"""Graph operators over edges (src, dst) of any key type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.fixpoint import cut, iterate, release


def distances(nodes: DataFrame, edges: DataFrame, entries: DataFrame, max_depth: int = 10) -> DataFrame:
    """(node, distance) for every node: least number of edges from an entry, -1 if unreachable. Unknown nodes aren't followed."""
    # Every round joins the edges: they are made once.
    hops = cut(edges.select("src", "dst").distinct().join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"))
    seed = entries.select("node").distinct().join(nodes.select("node"), "node", "left_semi").withColumn("distance", F.lit(0))

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        return frontier.join(hops, frontier["node"] == hops["src"]).select(F.col("dst").alias("node"), F.lit(depth).alias("distance"))

    found = iterate(seed, step, ["node"], max_depth)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("distance", F.lit(-1)).alias("distance"))


def shortest_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_depth: int = 10) -> DataFrame:
    """(start, node, path): one least-edge path from each start to each target, ties by the least path of node names."""
    seed = starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path"))
    hops = cut(edges.select("src", "dst").distinct())

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        reached = frontier.join(hops, frontier["node"] == hops["src"])
        paths = reached.select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        return paths.groupBy("start", "node").agg(F.min("path").alias("path"))

    found = iterate(seed, step, ["start", "node"], max_depth)
    return found.join(targets.select("node"), "node", "left_semi")


#: Numbers of asked starts (a node and word each) that are searched at once: what a round shuffles depends on it, not on the table.
CELLS = 1 << 24


def pair_distances(pairs: DataFrame, edges: DataFrame, max_depth: int = 10) -> DataFrame:
    """(src, dst, distance) of each pair asked for: 0 for equal ends, -1 where no path of max_depth edges leads on.

    A search from many starts at once: 64 starts are the bits of one number, so a round has one row per node and word of starts
    instead of one per node and start. The pairs are bits, too, and become rows again at the end. Words are searched in turns, so
    that shuffles of one turn are gone before the next; what stays are places and answers, as bits.
    """
    spark = pairs.sparkSession
    asked = pairs.select("src", "dst")
    apart = asked.where("src <> dst")
    hops = cut(edges.select("src", "dst").where("src <> dst").distinct())
    numbered = apart.select("src").distinct().repartitionByRange("src").sortWithinPartitions("src").withColumn("id", F.monotonically_increasing_id())
    # The numbers of a partition follow each other and begin at a multiple of 64.
    starts = cut(numbered.selectExpr("src", "shiftright(id, 6) AS word", "shiftleft(1L, CAST(id & 63 AS INT)) AS bit"))
    wanted = cut(apart.join(starts, "src").groupBy(F.col("dst").alias("node"), "word").agg(F.bit_or("bit").alias("want")))
    release(spark)
    # An edge carries what its far end still needs to an end that is asked for (steps). A node knows what it needs by one edge
    # more at least (more), how many of its edges lead to such ends (fan), and the least `more` that an edge leads to (onward).
    ends = steps_to(hops, wanted.select("node"), max_depth - 1).withColumnRenamed("node", "dst")
    ways = cut(hops.join(ends, "dst").withColumnRenamed("src", "node"))
    release(spark)
    more = ways.groupBy(F.col("node").alias("dst")).agg((F.min("steps") + 1).alias("more"))
    about = F.min("more").alias("onward"), (F.min("steps") + 1).alias("more"), F.count_if(F.expr("steps = 0")).alias("fan")
    about = cut(ways.join(more, "dst", "left").groupBy("node").agg(*about))
    ways = cut(ways.join(about.withColumnRenamed("node", "dst"), "dst", "left"))
    release(spark)
    seed = cut(starts.withColumnRenamed("src", "node").join(about, "node")).withColumnRenamed("bit", "bits")
    into = ways.where("steps = 0").groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    turns = max(1, -(-wanted.count() // CELLS))
    # Rows that looking back from every asked end makes in one turn.
    back = (wanted.groupBy("node").agg(F.count(F.lit(1)).alias("cells")).join(into, "node").agg(F.sum(F.expr("n * cells"))).first()[0] or 0) // turns
    found = wanted.limit(0).select("node", "word", F.col("want").alias("hit"), F.lit(0).alias("distance"))
    for turn in range(turns):
        part = f"pmod(word, {turns}) = {turn}"
        for answers in _search(seed.where(part), wanted.where(part), ways, back, max_depth):
            found = found.unionByName(answers)
    out = _single(found, "hit").join(starts, ["word", "bit"]).select("src", F.col("node").alias("dst"), "distance")
    # Equal ends, and pairs without an end.
    other = asked.where("src = dst or src is null or dst is null").distinct().select("src", "dst", F.when(F.expr("src = dst"), 0).otherwise(-1).alias("distance"))
    return out.unionByName(other)


def _single(rows: DataFrame, mask: str) -> DataFrame:
    """Each row once per bit of its mask."""
    bits = F.broadcast(rows.sparkSession.range(64).selectExpr("shiftleft(1L, CAST(id AS INT)) AS bit"))
    return rows.join(bits, F.expr(f"({mask} & bit) <> 0"))


def _search(seed: DataFrame, wanted: DataFrame, ways: DataFrame, back: int, max_depth: int) -> list[DataFrame]:
    """Tables (node, word, hit, distance) that answer all of wanted (node, word, want), searched from the seed's bits.

    A round asks first: places beside an asked end give their bits to it, along their edges, or, where that makes fewer rows, the
    asked bits are brought back over the edges into their ends and met there, so an ask never makes more rows than the pairs have
    edges. Then places go on, but only to nodes from which an asked end is still near enough beyond them. A start leaves the search
    when all its pairs are settled.
    """
    waiting, answers, rest = None, [], None
    known = frontier = seed.where(F.col("more") <= max_depth)
    for depth in range(1, max_depth + 1):
        left = max_depth - depth
        going = F.col("onward") <= left
        last = frontier.where(going).isEmpty()
        asking = frontier.where("more = 1")
        ahead = asking.agg(F.sum("fan")).first()[0]
        if ahead:
            into = ways.where("steps = 0").select("node", "dst")
            # Looking back takes a shuffle more, and one of its rows.
            if 2 * back < ahead:
                brought = wanted.withColumnRenamed("node", "dst").join(into, "dst")
                got = brought.join(asking, ["node", "word"]).selectExpr("dst AS node", "word", "bits & want AS new").where("new <> 0")
            else:
                got = asking.join(into, "node").selectExpr("dst AS node", "word", "bits AS new")
            both = got.selectExpr("node", "word", "new", "0L AS want").unionByName(wanted.selectExpr("node", "word", "0L AS new", "want"))
            both = _unanswered(both, answers)
            hits = cut(both.selectExpr("node", "word", "new & want AS hit", f"{'want & ~new' if last else '0L'} AS rest").where("hit <> 0 or rest <> 0"))
            answers.append(hits.where("hit <> 0").select("node", "word", "hit", F.lit(depth).alias("distance")))
            rest = hits.where("rest <> 0").select("node", "word", "rest") if last else None
            release(wanted.sparkSession)
        if last:
            break
        if ahead:
            if waiting is None:
                waiting = _single(wanted, "want").groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n"))
            met = _single(answers[-1], "hit").groupBy("word", "bit").agg((-F.count(F.lit(1))).alias("n"))
            waiting = cut(waiting.unionByName(met).groupBy("word", "bit").agg(F.sum("n").alias("n")).where("n > 0"))
            awake = waiting.groupBy("word").agg(F.bit_or("bit").alias("awake"))
            frontier = frontier.join(awake, "word").withColumn("bits", F.expr("bits & awake")).where("bits <> 0").drop("awake")
        near, facts = F.col("more") <= left, ["onward", "more", "fan"]
        reached = frontier.where(going).drop(*facts).join(ways.where(near), "node").selectExpr("dst AS node", "word", "bits AS new", "0L AS old", *facts)
        old = known.where(near).selectExpr("node", "word", "0L AS new", "bits AS old", *facts)
        both = reached.unionByName(old).groupBy("node", "word").agg(*(F.bit_or(c).alias(c) for c in ("new", "old")), *(F.min(c).alias(c) for c in facts))
        frontier = cut(both.selectExpr("node", "word", "new & ~old AS bits", *facts).where("bits <> 0"))
        known = known.unionByName(frontier)
        release(wanted.sparkSession)
        if frontier.isEmpty():
            break
    if rest is None:
        none = wanted.selectExpr("node", "word", "0L AS new", "want")
        rest = cut(_unanswered(none, answers).selectExpr("node", "word", "want AS rest").where("rest <> 0")) if answers else wanted.withColumnRenamed("want", "rest")
    return [*answers, rest.selectExpr("node", "word", "rest AS hit", "-1 AS distance")]


def _unanswered(both: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Rows (node, word, new, want) made one per node and word, without the bits that are answered."""
    both = both.withColumn("old", F.lit(0).cast("long"))
    for rows in answers:
        both = both.unionByName(rows.selectExpr("node", "word", "0L AS new", "0L AS want", "hit AS old"))
    both = both.groupBy("node", "word").agg(*(F.bit_or(c).alias(c) for c in ("new", "want", "old")))
    return both.selectExpr("node", "word", "new & ~old AS new", "want & ~old AS want")


def steps_to(hops: DataFrame, ends: DataFrame, max_depth: int) -> DataFrame:
    """(node, steps): least number of edges of hops (src, dst) from each node to one of the ends, up to max_depth."""

    def step(frontier: DataFrame, depth: int) -> DataFrame:
        return frontier.join(hops, frontier["node"] == hops["dst"]).select(F.col("src").alias("node"), F.lit(depth).alias("steps"))

    return iterate(ends.select("node").distinct().withColumn("steps", F.lit(0)), step, ["node"], max_depth)


def simple_paths(edges: DataFrame, starts: DataFrame, max_depth: int = 10, target: str | int | None = None) -> DataFrame:
    """(path): every path without a repeated node from a start to a node without out-edges; longer ones are left out.

    With a target only paths that hold it. Distances to the nearest leaf, and by way of the target, are found first, backwards;
    each edge carries them, so a prefix goes on only where the edges that it has left can still end it. What is made beside the
    results are prefixes whose every ending would repeat a node.
    """
    hops = cut(edges.select("src", "dst").distinct())
    leaves = hops.select("dst").distinct().join(hops.select(F.col("src").alias("dst")), "dst", "left_anti").select(F.col("dst").alias("node"))
    met = F.lit(True) if target is None else F.col("node") == F.lit(target)
    seed = starts.select("node", F.array("node").alias("path"), met.alias("met"))
    out = seed.where("met").join(hops.select(F.col("src").alias("node")), "node", "left_anti").select("path")
    ends = steps_to(hops, leaves, max_depth)
    # An edge as a prefix that has met the target takes it: what its far end still needs.
    ways = hops.join(ends.withColumnRenamed("node", "dst"), "dst").select("src", F.lit(True).alias("met"), "dst", F.lit(True).alias("then"), "steps")
    if target is not None:
        goal = ends.where(F.col("node") == F.lit(target)).select(F.col("node").alias("goal"), F.col("steps").alias("rest"))
        before = steps_to(hops, goal.select(F.col("goal").alias("node")), max_depth)
        # One row at most: the target's own distance.
        before = before.withColumn("goal", F.lit(target)).join(F.broadcast(goal), "goal").select(F.col("node").alias("dst"), (F.col("steps") + F.col("rest")).alias("steps"))
        ways = ways.unionByName(hops.join(before, "dst").select("src", F.lit(False).alias("met"), "dst", (F.col("dst") == F.lit(target)).alias("then"), "steps"))
    ways, frontier = cut(ways.withColumnRenamed("src", "node")), seed
    for depth in range(1, max_depth + 1):
        reached = frontier.join(ways, ["node", "met"]).where(~F.array_contains("path", F.col("dst")) & (F.col("steps") <= max_depth - depth))
        found = cut(reached.select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.col("then").alias("met"), "steps"))
        out = out.unionByName(found.where("steps = 0").select("path"))
        frontier = found.where("steps > 0").drop("steps")
        if frontier.isEmpty():
            break
    return out


def paths_through(edges: DataFrame, starts: DataFrame, target: str | int, max_depth: int = 10) -> DataFrame:
    """Those of simple_paths that hold the target; only prefixes that can reach it in time are made."""
    return simple_paths(edges, starts, max_depth, target)


def neighbours(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(direction, node, other): callees and callers, each pair once, of known nodes only if nodes are given."""
    pairs = edges.select("src", "dst").distinct()
    if nodes is not None:
        pairs = pairs.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    out = pairs.select(F.lit("callee").alias("direction"), F.col("src").alias("node"), F.col("dst").alias("other"))
    return out.unionByName(pairs.select(F.lit("caller").alias("direction"), F.col("dst").alias("node"), F.col("src").alias("other")))


def flow_nodes(*parts: DataFrame) -> DataFrame:
    """Union of node tables, each id once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["node_id"])


def flow_edges(nodes: DataFrame, *parts: DataFrame) -> DataFrame:
    """Union of edge tables, each (src, dst, type) once, with both ends known."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    known = nodes.select("node_id")
    out = out.dropDuplicates(["src", "dst", "type"])
    return out.join(known.withColumnRenamed("node_id", "src"), "src", "left_semi").join(known.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def reversed_edges(edges: DataFrame) -> DataFrame:
    """(node, callers): each callee with the sorted list of its distinct callers."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("callers"))


def statistics(nodes: DataFrame, edges: DataFrame, entries: DataFrame, max_depth: int = 10) -> DataFrame:
    """(metric, value): nodes, edges, entry points and nodes that an entry point reaches."""
    near = distances(nodes, edges, entries, max_depth)
    rows = [("nodes", nodes.select("node").distinct()), ("edges", edges.select("src", "dst").distinct()), ("entry_points", entries.select("node").distinct()), ("reachable", near.where("distance >= 0"))]
    out = None
    for name, table in rows:
        part = table.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def capped(rows: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first `cap` rows in a fixed order (a top-k, merged on the driver side of a take-ordered plan)."""
    return rows.orderBy(*order).limit(cap)


def expanded_paths(calls: DataFrame, start: DataFrame, targets: DataFrame, max_depth: int = 10, max_paths: int = 1000, max_explored: int = 10_000, max_nodes: int = 50) -> DataFrame:
    """Paths of calls (caller, callee, line) from start functions to target functions: (path, lines, pruned).

    A path ends at a target; one that meets a function again, the depth limit or max_nodes functions is returned with its reason.
    The expansion stops after max_explored paths and returns max_paths at most, those with a target first, shorter ones first.
    """
    max_depth, explored = min(max_depth, max_nodes - 1), 0
    hops = calls.select(F.col("caller").alias("node"), "callee", "line").distinct()
    frontier = start.select("node", F.array("node").alias("path"), F.array().cast("array<int>").alias("lines"))
    out = None
    for depth in range(max_depth + 1):
        done = frontier.join(targets.select("node"), "node", "left_semi").withColumn("pruned", F.lit(""))
        rest = frontier.join(targets.select("node"), "node", "left_anti")
        if depth == max_depth:
            done = done.unionByName(rest.join(hops.select("node").distinct(), "node", "left_semi").withColumn("pruned", F.lit("max_depth_exceeded")))
        else:
            reached = rest.join(hops, "node").withColumn("again", F.array_contains("path", F.col("callee")))
            step = reached.select(F.col("callee").alias("node"), F.concat("path", F.array("callee")).alias("path"), F.concat("lines", F.array("line")).alias("lines"), "again")
            # The caps are the feature: the first paths in a fixed order go on.
            step = cut(step.orderBy("path", "lines").limit(max(0, max_explored - explored)))
            explored += step.count()
            done = done.unionByName(step.where("again").drop("again").withColumn("pruned", F.lit("cycle_detected")))
            frontier = step.where("not again").drop("again")
        out = done if out is None else out.unionByName(done)
        if depth < max_depth and not frontier.limit(1).count():
            break
    return out.select("path", "lines", "pruned").orderBy("pruned", F.size("path"), "path").limit(max_paths)
