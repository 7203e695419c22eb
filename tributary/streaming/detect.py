"""Source detection over a stream of texts: the same stateless plan as the batch scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.operators.detect import text_rules


def rule_counts(stream: DataFrame, key: str, text: str, rules: list[tuple[str, str]], time: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Matches of each rule per window of event time, with late rows admitted for `late`."""
    timed = stream.withWatermark(time, late).select(F.struct(key, time).alias("at"), text)
    hits = text_rules(timed, "at", text, rules)
    return hits.groupBy(F.window(F.col(f"at.{time}"), window), "rule").agg(F.count(F.lit(1)).alias("n"))
