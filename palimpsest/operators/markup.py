"""Shapes and drawings of package parts, read by an XML parser inside Arrow batches.

A pattern cannot follow elements that nest, nor tell markup from comments and character data, nor a prefix that is bound to another namespace.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The namespace of text shapes, and the local names of what is read.
SHAPES = "urn:schemas-microsoft-com:vml"
TEXT = ("shape", "textpath")
DRAWINGS, LABELLED = ("anchor", "inline"), ("docPr", "cNvPr")

FIELDS = ("kind string, idx int, type string, style string, strings array<string>, embed string, behind string, labels array<string>")


def read_part(xml: str | bytes | None) -> list[dict] | None:
    """Shapes and drawings of a part in document order, nested ones after what holds them; None if the part is not well-formed.

    A document type makes a part not well-formed, so that no entity is expanded. A shape counts if its prefix stands for the namespace of text
    shapes or for none; drawings are told by their local names.
    """
    found: dict[str, list[dict]] = {"shape": [], "drawing": []}
    scopes: list[dict[str, str]] = [{}]
    open_: list[tuple[str, dict] | None] = []

    def start(name: str, attributes: dict[str, str]) -> None:
        prefix, _, local = name.rpartition(":")
        scope = scopes[-1]
        for k in attributes:
            if k == "xmlns" or k.startswith("xmlns:"):
                scope = scope | {k.partition(":")[2]: attributes[k]}
        scopes.append(scope)
        item = None
        if local in TEXT and scope.get(prefix, SHAPES) == SHAPES:
            if local == "shape":
                item = ("shape", {"type": attributes.get("type"), "style": attributes.get("style"), "strings": None})
            else:
                for o in open_:
                    if o and o[0] == "shape":
                        o[1]["strings"] = [*(o[1]["strings"] or []), attributes.get("string", "")]
        elif local in DRAWINGS:
            item = ("drawing", {"type": local, "behind": attributes.get("behindDoc"), "embed": None, "labels": [], "_seen": False})
        elif local == "blip":
            for o in open_:
                if o and o[0] == "drawing" and not o[1]["_seen"]:
                    o[1]["embed"] = next((v for k, v in attributes.items() if k.rpartition(":")[2] == "embed"), None)
                    o[1]["_seen"] = True
        elif local in LABELLED:
            for o in open_:
                if o and o[0] == "drawing":
                    o[1]["labels"] += [attributes[k] for k in ("title", "descr", "name") if k in attributes]
        if item:
            found[item[0]].append(item[1])
        open_.append(item)

    def end(_: str) -> None:
        scopes.pop()
        open_.pop()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = start, end, _refuse
    try:
        parser.Parse(xml or "", True)
    except (expat.ExpatError, ValueError):
        return None
    for item in found["drawing"]:
        del item["_seen"]
    return [{"kind": kind, "idx": i, **item} for kind, items in found.items() for i, item in enumerate(items)]


def _refuse(*_: object) -> None:
    raise ValueError("document type")


def read_distinct(parts: pa.Array) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """(rows, place, row): what the different parts hold, and for each row of the result the part's place and the place among `rows`."""
    coded = parts.dictionary_encode("encode")
    rows, first = [], [0]
    for part in coded.dictionary.to_pylist():
        read = read_part(part)
        rows += [{"kind": "malformed"}] if read is None else read
        first.append(len(rows))
    bounds, which = np.array(first), coded.indices.to_numpy()
    sizes = np.diff(bounds)[which]
    place = np.repeat(np.arange(len(which)), sizes)
    return rows, place, np.arange(len(place)) + np.repeat(bounds[which] - np.cumsum(sizes) + sizes, sizes)


def read_parts(parts: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """(keys, kind, idx, type, style, strings, embed, behind, labels): a row for each shape and drawing, and one of kind malformed
    for a part that cannot be read. A null part is malformed; a part without shapes and drawings gives no row.

    `strings` is null for a shape without a text path. Keys of any type are passed through. Equal parts of a batch are read once.
    """
    kinds = ", ".join(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys)
    text, many = pa.string(), pa.list_(pa.string())
    types = {"kind": text, "idx": pa.int32(), "type": text, "style": text, "strings": many, "embed": text, "behind": text, "labels": many}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, place, row = read_distinct(batch.column(len(keys)))
            place, row = pa.array(place), pa.array(row)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(place) for i in range(len(keys))],
                                              *[pa.array([r.get(n) for r in rows], t).take(row) for n, t in types.items()]], [*keys, *types])

    return parts.select(*keys, xml).mapInArrow(run, f"{kinds}, {FIELDS}")
