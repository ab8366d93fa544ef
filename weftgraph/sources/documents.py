"""Graphs of any size as one XML document: lines are made and ordered by Spark, head and foot are parts of their own.

A document is a folder whose parts, in the order of their names, are the document: `0-head`, `1-nodes`, `2-between`, `3-edges`,
`4-foot`. one_file() appends them to one file, block by block; no list of nodes or edges is held anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from weftgraph.sources.sinks import ROLE_COLOURS
from weftgraph.sources.store import Folder

PARTS = ("0-head", "1-nodes", "2-between", "3-edges", "4-foot")
# What an attribute without a value is written as.
DEFAULTS = {"boolean": "false", "long": "-1", "double": "-1", "string": ""}


def xml(text: Column) -> Column:
    """Text for XML elements and attributes; characters that XML has no place for are gone."""
    plain = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        plain = F.replace(plain, F.lit(char), F.lit(name))
    return plain


def attribute_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "long"
    return "double" if isinstance(kind, T.FractionalType) else "string"


def _value(field: T.StructField) -> Column:
    of = F.array_join(F.col(f"`{field.name}`").cast("array<string>"), ",") if isinstance(field.dataType, T.ArrayType) else F.col(f"`{field.name}`").cast("string")
    return F.coalesce(xml(of), F.lit(DEFAULTS[attribute_type(field.dataType)]))


def _text(spark: SparkSession, folder: Folder, part: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder.path}/{part}")


def _lines(df: DataFrame, folder: Folder, part: str, line: Column, *order: str) -> None:
    df.orderBy(*order).select(line.alias("value")).write.text(f"{folder.path}/{part}")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GraphML of nodes(id, ...) and edges(source, target, ...); other columns are attributes, typed as the columns are."""
    spark, folder, keys = nodes.sparkSession, Folder(nodes.sparkSession, path), []
    own = {"node": ("id",), "edge": ("source", "target")}
    data: dict[str, list[Column]] = {"node": [], "edge": []}
    for kind, df in (("node", nodes), ("edge", edges)):
        for field in df.schema:
            if field.name not in own[kind]:
                name = f"d{len(keys)}"
                label = field.name.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
                keys.append(f'<key id="{name}" for="{kind}" attr.name="{label}" attr.type="{attribute_type(field.dataType)}"/>')
                data[kind] += [F.lit(f'<data key="{name}">'), _value(field), F.lit("</data>")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *keys, '<graph edgedefault="directed">']
    _text(spark, folder, PARTS[0], "\n".join(head))
    _lines(nodes, folder, PARTS[1], F.concat(F.lit('<node id="'), xml(F.col("id")), F.lit('">'), *data["node"], F.lit("</node>")), "id")
    _lines(edges, folder, PARTS[3], F.concat(F.lit('<edge source="'), xml(F.col("source")), F.lit('" target="'), xml(F.col("target")), F.lit('">'), *data["edge"], F.lit("</edge>")), "source", "target")
    _text(spark, folder, PARTS[4], "</graph>\n</graphml>")


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """GEXF of nodes(id, label, role, size) and edges(source, target, weight); a node's colour tells its role."""
    spark, folder = nodes.sparkSession, Folder(nodes.sparkSession, path)
    colour = F.lit('<viz:color r="120" g="120" b="120"/>')
    for role, (r, g, b) in ROLE_COLOURS.items():
        colour = F.when(F.col("role") == role, F.lit(f'<viz:color r="{r}" g="{g}" b="{b}"/>')).otherwise(colour)
    label = F.coalesce(F.when(F.col("label") != "", F.col("label")), F.col("id"))
    node = F.concat(F.lit('<node id="'), xml(F.col("id")), F.lit('" label="'), xml(label), F.lit('"><viz:size value="'), F.coalesce("size", F.lit(1)).cast("string"), F.lit('"/>'), colour, F.lit("</node>"))
    edge = F.concat(F.lit('<edge source="'), xml(F.col("source")), F.lit('" target="'), xml(F.col("target")), F.lit('" weight="'), F.coalesce("weight", F.lit(1)).cast("string"), F.lit('"/>'))
    space = 'xmlns="http://gexf.net/1.3" xmlns:viz="http://gexf.net/1.3/viz"'
    _text(spark, folder, PARTS[0], f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf {space} version="1.3">\n<graph defaultedgetype="directed">\n<nodes>')
    _lines(nodes, folder, PARTS[1], node, "id")
    _text(spark, folder, PARTS[2], "</nodes>\n<edges>")
    _lines(edges, folder, PARTS[3], edge, "source", "target")
    _text(spark, folder, PARTS[4], "</edges>\n</graph>\n</gexf>")


def one_file(spark: SparkSession, path: str, target: str) -> None:
    """The parts of a document appended to one new file, which appears when it is whole."""
    folder = Folder(spark, path)
    parts = [f"{part}/{name}" for part in PARTS for name in folder.names(part) if name.startswith("part-")]
    folder.append_all(parts, target)
