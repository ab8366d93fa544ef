"""Files that reports are written to: CSV, JSON, GraphML, GEXF and Mermaid, made of small aggregates or graph exports."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Iterable
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str) -> None:
    """One folder of CSV files with a header; nulls are empty."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def csv_text(df: DataFrame) -> str:
    """A small table as one CSV text."""
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    for row in df.toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])
    return out.getvalue()


def json_text(document: dict) -> str:
    return json.dumps(document, ensure_ascii=False, indent=2, sort_keys=True)


def fingerprint(document: dict) -> str:
    return hashlib.sha256(json.dumps(document, sort_keys=True).encode()).hexdigest()[:12]


def _graphml_type(value: object) -> tuple[str, str]:
    if isinstance(value, bool):
        return "boolean", str(value).lower()
    if isinstance(value, int):
        return "long", str(value)
    if isinstance(value, float):
        return "double", repr(value)
    return "string", "" if value is None else str(value)


def graphml(nodes: Iterable[dict], edges: Iterable[dict]) -> Iterable[str]:
    """GraphML in pieces. nodes hold `id`, edges `source` and `target`; other keys become attributes."""
    nodes, edges = list(nodes), list(edges)
    keys: dict[tuple[str, str], tuple[str, str]] = {}
    for kind, rows, own in (("node", nodes, {"id"}), ("edge", edges, {"source", "target"})):
        for row in rows:
            for k, v in row.items():
                if k not in own and v is not None:
                    keys.setdefault((kind, k), (f"d{len(keys)}", _graphml_type(v)[0]))
    yield '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n'
    for (kind, k), (name, kind_of) in keys.items():
        yield f'<key id="{name}" for="{kind}" attr.name={quoteattr(k)} attr.type="{kind_of}"/>\n'
    yield '<graph edgedefault="directed">\n'

    def data(kind: str, row: dict) -> str:
        empty = {"string": "", "boolean": "false"}
        return "".join(
            f'<data key="{name}">{escape(_graphml_type(row[k])[1] if row.get(k) is not None else empty.get(kind_of, "-1"))}</data>'
            for (of, k), (name, kind_of) in keys.items()
            if of == kind
        )

    for row in nodes:
        yield f"<node id={quoteattr(row['id'])}>{data('node', row)}</node>\n"
    for row in edges:
        yield f"<edge source={quoteattr(row['source'])} target={quoteattr(row['target'])}>{data('edge', row)}</edge>\n"
    yield "</graph>\n</graphml>\n"


# Node colours by role.
ROLE_COLOURS = {"win": (46, 125, 50), "entry": (21, 101, 192), "dead end": (198, 40, 40), "trap loop": (106, 27, 154)}


def gexf(nodes: Iterable[dict], edges: Iterable[dict]) -> Iterable[str]:
    """GEXF in pieces, with a label, a size and a colour by role; places are left to the viewer."""
    yield '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" xmlns:viz="http://gexf.net/1.3/viz" version="1.3">\n<graph defaultedgetype="directed">\n<nodes>\n'
    for row in nodes:
        r, g, b = ROLE_COLOURS.get(row.get("role", ""), (120, 120, 120))
        yield f'<node id={quoteattr(row["id"])} label={quoteattr(row.get("label") or row["id"])}><viz:size value="{row.get("size", 1)}"/><viz:color r="{r}" g="{g}" b="{b}"/></node>\n'
    yield "</nodes>\n<edges>\n"
    for k, row in enumerate(edges):
        yield f'<edge id="{k}" source={quoteattr(row["source"])} target={quoteattr(row["target"])} weight="{row.get("weight", 1)}"/>\n'
    yield "</edges>\n</graph>\n</gexf>\n"


def mermaid(paths: dict[str, list[str]]) -> str:
    """A flow chart of named paths; nodes get short names in the order in which they occur."""
    names: dict[str, str] = {}
    lines = ["flowchart LR"]
    for label, path in paths.items():
        lines.append(f"  %% {label}")
        for url in path:
            if url not in names:
                names[url] = f"n{len(names)}"
                lines.append(f'  {names[url]}["{url.replace(chr(34), chr(39))}"]')
        lines += [f"  {names[a]} --> {names[b]}" for a, b in zip(path, path[1:], strict=False)]
    return "\n".join(lines) + "\n"
