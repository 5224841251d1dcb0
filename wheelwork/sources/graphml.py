"""Graphs as GraphML: read with Spark's XML source by row tags, typed by the file's key table; written part by part.

Edges carry their number among parallel ones as ``id``. Attributes are typed as the key
table says, or as ``node_types`` and ``edge_types`` (name to SQL type) say; arrays stand as JSON,
lists like ``[1, 2]`` too. What cannot be cast is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DATA = "data array<struct<_key:string,_VALUE:string>>"
# fixed values of the format: its types by SQL type
TYPES = {"boolean": "boolean", "int": "int", "bigint": "long", "float": "float", "double": "double", "string": "string"}
# types whose text, or JSON, has nothing that XML asks to escape
_WHOLE = ("boolean", "tinyint", "smallint", "int", "bigint")
PLAIN = {*_WHOLE, *(f"array<{k}>" for k in _WHOLE), "float", "double", "date"}
#: Nodes or edges of a file, at most.
LINES = 250_000
HEAD = """<?xml version="1.0" encoding="UTF-8"?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:schemaLocation="http://graphml.graphdrawing.org/xmlns http://graphml.graphdrawing.org/xmlns/1.0/graphml.xsd">"""


def _tagged(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    # the parser by row tags splits files and takes parts of a document; the other wants each file whole
    return spark.read.format("xml").option("useLegacyXMLParser", True).option("rowTag", tag).option("ignoreNamespace", True).schema(schema).load(path)


def keys(spark: SparkSession, path: str) -> list[dict]:
    """id, of (node, edge, all), name, type, default of each attribute: some tens of rows."""
    table = _tagged(spark, path, "key", "_id string, _for string, `_attr.name` string, `_attr.type` string, default string")
    # a file without the row tag gives a row of nulls
    rows = table.where("_id IS NOT NULL").select(F.col("_id").alias("id"), F.coalesce("_for", F.lit("all")).alias("of"), F.col("`_attr.name`").alias("name"), F.col("`_attr.type`").alias("type"), "default")
    return [r.asDict() for r in rows.distinct().orderBy("id").collect()]


def _typed(value: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return F.from_json(value, kind)
    if kind == "boolean":
        return F.lower(F.trim(value)).try_cast("boolean")
    return value if kind == "string" else F.trim(value).try_cast(kind)


def _attributes(found: list[dict], of: str, types: dict[str, str]) -> list[Column]:
    known = {v: k for k, v in TYPES.items()}
    out, seen = [], set()
    for k in found:
        if k["of"] not in (of, "all") or k["name"] in seen:
            continue
        seen.add(k["name"])
        value = F.coalesce(F.element_at("_map", k["id"]), F.lit(k["default"]))
        out.append(_typed(value, types.get(k["name"], known.get(k["type"], "string"))).alias(k["name"]))
    return out


def read(spark: SparkSession, path: str, node_types: dict[str, str] | None = None, edge_types: dict[str, str] | None = None, id_type: str = "bigint") -> tuple[DataFrame, DataFrame]:
    """Nodes (node and attributes) and edges (u, v, key and attributes) of a file or folder."""
    found = keys(spark, path)
    by_key = F.map_from_entries(F.transform(F.coalesce("data", F.array().cast("array<struct<_key:string,_VALUE:string>>")), lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("_map")
    nodes = _tagged(spark, path, "node", f"_id string, {_DATA}").where("_id IS NOT NULL").select(F.col("_id").cast(id_type).alias("node"), by_key)
    edges = _tagged(spark, path, "edge", f"_id string, _source string, _target string, {_DATA}").where("_source IS NOT NULL").select(F.col("_source").cast(id_type).alias("u"), F.col("_target").cast(id_type).alias("v"), F.coalesce(F.col("_id").try_cast("bigint"), F.lit(0)).alias("key"), by_key)
    return nodes.select("node", *_attributes(found, "node", node_types or {})), edges.select("u", "v", "key", *_attributes(found, "edge", edge_types or {}))


def _escaped(text: Column) -> Column:
    """Text for XML; control characters that XML has no form for are left out."""
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def _text(df: DataFrame, name: str) -> Column:
    """A column as text for XML: arrays, structs and maps as JSON."""
    kind = dict(df.dtypes)[name]
    text = F.to_json(name) if kind.startswith(("array", "struct", "map")) else F.col(f"`{name}`").cast("string")
    return text if kind in PLAIN else _escaped(text)


def _data(df: DataFrame, names: list[str], numbers: dict[str, str]) -> Column:
    parts = []
    for name in names:
        text = _text(df, name)
        parts.append(F.when(text.isNotNull(), F.concat(F.lit(f'<data key="{numbers[name]}">'), text, F.lit("</data>"))))
    return F.concat_ws("", *parts) if parts else F.lit("")


def _document(nodes: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """The lines (at, value) of a document's four parts: head, nodes, edges and end."""
    spark = nodes.sparkSession
    own, other = [c for c in nodes.columns if c != "node"], [c for c in edges.columns if c not in ("u", "v", "key")]
    n_own, n_other = {c: f"d{i}" for i, c in enumerate(own)}, {c: f"d{i + len(own)}" for i, c in enumerate(other)}
    key = lambda df, c, number, of: f'<key id="{number}" for="{of}" attr.name="{c}" attr.type="{TYPES.get(dict(df.dtypes)[c], "string")}"/>'
    head = [HEAD, *(key(nodes, c, n, "node") for c, n in n_own.items()), *(key(edges, c, n, "edge") for c, n in n_other.items()), '<graph edgedefault="directed">']
    once = lambda text: spark.range(0, 1, 1, 1).select(F.lit("").alias("at"), F.lit(text).alias("value"))
    node = F.concat(F.lit('<node id="'), _text(nodes, "node"), F.lit('">'), _data(nodes, own, n_own), F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), _text(edges, "u"), F.lit('" target="'), _text(edges, "v"), F.lit('" id="'), _text(edges, "key"), F.lit('">'), _data(edges, other, n_other), F.lit("</edge>"))
    lines = nodes.select(F.col("node").cast("string").alias("at"), node.alias("value")), edges.select(F.col("u").cast("string").alias("at"), edge.alias("value"))
    return [once("\n".join(head)), *lines, once("</graph></graphml>")]


def write(nodes: DataFrame, edges: DataFrame, folder: str, files: int | None = None, compression: str = "none") -> None:
    """Nodes (node and attributes) and edges (u, v, key and attributes) as text files.

    Each partition of nodes and edges is written as it stands, nothing is shuffled; a file has ``LINES``
    nodes or edges at most, so that a reading task's part stays as it is when the graph grows. With ``files``,
    lines are ordered and dealt to so many. The files in the order of their names, one after the other, are one GraphML
    document (with ``compression="gzip"`` still one gzip file); ``read`` takes the folder. Nulls are left out.
    """
    parts = _document(nodes, edges)
    if files is None:
        # a union has its parts' partitions in this order, and files are named by them
        lines, most = reduce(DataFrame.unionAll, parts), LINES
    else:
        lines, most = reduce(DataFrame.unionAll, [p.select(F.lit(i).alias("part"), "at", "value") for i, p in enumerate(parts)]), 0
        lines = lines.repartitionByRange(files, "part", "at", F.xxhash64("value")).sortWithinPartitions("part", "at", "value")
    lines.select("value").write.mode("errorifexists").option("maxRecordsPerFile", most).option("compression", compression).text(folder)
