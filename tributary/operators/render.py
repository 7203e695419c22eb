"""Renderers: flow graphs as DOT, Mermaid and JSON lines, with a style table. Lines are rows; joining them is the sink's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import escaped_label, safe_id, short_path
from tributary.operators.graph import capped

#: Node styles by type: fill and text colour, DOT shape, Mermaid brackets; edge styles: line, colour, Mermaid arrow. Fixed values.
FILLS = {"source": "#ff6b6b", "variable": "#4ecdc4", "function": "#45b7d1", "parameter": "#96ceb4", "carrier": "#4ecdc4", "property": "#f9f9f9", "return": "#f9f9f9"}
DEFAULT_FILL, STROKE = "#f9f9f9", "#333"
SHAPES = {"source": ("((", "))"), "function": ("[/", "/]")}
DEFAULT_SHAPE = ("[", "]")
EDGES = {"assignment": "solid", "call": "dashed", "return": "dotted", "taint": "bold", "parameter": "dashed", "property": "solid"}
COLOURS = {"assignment": "black", "call": "blue", "return": "green", "taint": "red", "parameter": "purple", "property": "gray"}
ARROWS = {"assignment": "-->", "call": "-.->|call|", "return": "==>|return|", "taint": "-->|taint|", "parameter": "-.->", "property": "-->"}
#: Rows of a graph that is put together on the driver. Fixed values.
MAX_NODES, MAX_EDGES = 10_000, 20_000


def _lookup(key: str, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(F.col(key) == k, v).otherwise(out)
    return out


def dot_nodes(nodes: DataFrame) -> DataFrame:
    """nodes: node_id, type, name, file_path, line."""
    label = F.concat(escaped_label(F.col("name")), F.lit("\\n"), short_path(F.col("file_path")), F.lit(":"), F.col("line").cast("string"))
    return nodes.select(F.format_string('  "%s" [label="%s", fillcolor="%s", style=filled];', safe_id(F.col("node_id")), label, _lookup("type", FILLS, DEFAULT_FILL)).alias("line"))


def dot_edges(edges: DataFrame) -> DataFrame:
    """edges: src, dst, type."""
    return edges.select(F.format_string('  "%s" -> "%s" [label="%s", style=%s];', safe_id(F.col("src")), safe_id(F.col("dst")), F.col("type"), _lookup("type", EDGES, "solid")).alias("line"))


def mermaid_nodes(nodes: DataFrame) -> DataFrame:
    opens, closes = ({k: v[i] for k, v in SHAPES.items()} for i in (0, 1))
    label = F.regexp_replace("name", r"[\"\[\]{}()|<>]", " ")
    return nodes.select(F.format_string('    %s%s"%s"%s', safe_id(F.col("node_id")), _lookup("type", opens, DEFAULT_SHAPE[0]), label, _lookup("type", closes, DEFAULT_SHAPE[1])).alias("line"))


def mermaid_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.format_string("    %s %s %s", safe_id(F.col("src")), _lookup("type", ARROWS, "-->"), safe_id(F.col("dst"))).alias("line"))


def styles(types: DataFrame) -> DataFrame:
    """types (type) with the style of a node and of an edge of that type."""
    opens, closes = ({k: v[i] for k, v in SHAPES.items()} for i in (0, 1))
    return types.select(
        "type", _lookup("type", FILLS, DEFAULT_FILL).alias("fill"), F.lit(STROKE).alias("stroke"), _lookup("type", opens, DEFAULT_SHAPE[0]).alias("opens"), _lookup("type", closes, DEFAULT_SHAPE[1]).alias("closes"),
        _lookup("type", EDGES, "solid").alias("line"), _lookup("type", COLOURS, "gray").alias("colour"), _lookup("type", ARROWS, "-->").alias("arrow"),
    )


def legend() -> list[str]:
    """DOT lines that explain the node colours."""
    return ["  subgraph cluster_legend {", '    label="Legend";', *(f'    "legend_{k}" [label="{k}", fillcolor="{v}", style=filled];' for k, v in FILLS.items()), "  }"]


def json_lines(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.to_json(F.struct(*(columns or rows.columns))).alias("json"))


def result_json(sources: DataFrame, nodes: DataFrame, edges: DataFrame, max_nodes: int = MAX_NODES, max_edges: int = MAX_EDGES) -> DataFrame:
    """(json): one row, a whole result: sources, nodes, edges and the number of sources by language, under the caps."""
    one = lambda rows, name: rows.agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(name))
    languages = sources.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    by = languages.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n")))).alias("by_language"))
    out = one(capped(sources, sorted(sources.columns), max_nodes), "sources")
    for rows in (one(capped(nodes, ["node_id"], max_nodes), "nodes"), one(capped(edges, ["src", "dst", "type"], max_edges), "edges"), by):
        out = out.crossJoin(rows)  # one row each
    return out.select(F.to_json(F.struct("sources", "nodes", "edges", "by_language")).alias("json"))


def flow_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, value): nodes and edges of a flow map, in all and by type."""
    per = lambda rows, name: rows.groupBy("type").agg(F.count(F.lit(1)).alias("value")).select(F.concat(F.lit(f"{name}."), "type").alias("metric"), "value")
    total = lambda rows, name: rows.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")
    return total(nodes, "nodes").unionByName(per(nodes, "nodes")).unionByName(total(edges, "edges")).unionByName(per(edges, "edges"))


def save_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines: carrier maps, classified batches, results."""
    rows.write.mode("overwrite").json(path)


def document(title: str, nodes: DataFrame, edges: DataFrame, kind: str = "dot") -> str:
    """A whole graph as one text on the driver; nodes and edges beyond the caps are left out."""
    nodes, edges = capped(nodes, ["node_id"], MAX_NODES), capped(edges, ["src", "dst", "type"], MAX_EDGES)
    lines_of = lambda rows: [r["line"] for r in rows.orderBy("line").toLocalIterator()]
    if kind == "dot":
        lines = [f"digraph {title} {{", "  rankdir=LR;", *lines_of(dot_nodes(nodes)), *lines_of(dot_edges(edges)), *legend(), "}"]
    else:
        classes = [f"    classDef {k} fill:{FILLS[k]},stroke:{STROKE}" for k in ("source", "variable", "function")]
        lines = ["flowchart LR", *lines_of(mermaid_nodes(nodes)), *lines_of(mermaid_edges(edges)), *classes]
    return "\n".join(lines)


def page(title: str, nodes: DataFrame, edges: DataFrame) -> str:
    """An HTML page with the graph as Mermaid and its rows as JSON, under the caps."""
    import html
    import json

    tables = (("nodes", capped(nodes, ["node_id"], MAX_NODES)), ("edges", capped(edges, ["src", "dst", "type"], MAX_EDGES)))
    data = {name: [r.asDict() for r in rows.toLocalIterator()] for name, rows in tables}
    chart, rows = html.escape(document(title, nodes, edges, "mermaid")), json.dumps(data).replace("</", "<\\/")
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><pre class="mermaid">{chart}</pre><script type="application/json" id="flow">{rows}</script></body></html>'


def summary_lines(statistics: DataFrame, title: str = "Summary") -> str:
    """A text report of (metric, value) rows."""
    return "\n".join([title, *(f"  {r['metric']}: {r['value']}" for r in statistics.orderBy("metric").toLocalIterator())])
