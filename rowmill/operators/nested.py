"""Deeply nested records as related flat tables, linked by interval labels.

Every node of a record gets a pre-order number when a depth-first walk enters it
and a post-order number when the walk leaves it. Node ``c`` lies below node ``p``
of the same record exactly when ``p.pre < c.pre`` and ``c.post < p.post``; so one
tall node table holds the whole tree, and the parent of any node at any type is
found by containment, without a path comparison.

The walk is driven by a tree of :class:`Spec`; records that lost their exact
shape are read leniently (see :func:`walk`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """A place of the schema.

    kind: ``object``; ``list`` (its elements are nodes); ``pages`` (a map page_k to
    text, or a list of page/text objects); ``group`` (an object with a list under
    ``inner``, or that list itself). node: type of the emitted node, none if the
    place is only passed through. filled: the node counts only if some field in it,
    however deep, is non-null.
    """

    kind: str = "object"
    node: str | None = None
    children: dict[str, "Spec"] = field(default_factory=dict)
    inner: str = ""
    filled: bool = False


WRAPPERS = ("extracted_data", "payload", "result", "data", "metadata")

_doc = Spec(node="passport", filled=True)
_departure = Spec(node="departure", filled=True)
_person = Spec(kind="list", node="person", children={"passport": _doc, "departure": _departure})
_group = Spec(kind="group", inner="persons", children={"persons": _person})

#: The published schema of a parsed housing document.
EXTRACTED = Spec(children={
    "page_1": Spec(node="page_1", children={
        "owners": Spec(kind="list", node="owner"),
        "ownership_documents": Spec(kind="list", node="ownership_document"),
        "passport": _doc,
        "property_address": Spec(node="property_address", filled=True),
    }),
    "page_2": Spec(node="page_2", children={
        "registered_persons_constantly": _group,
        "registered_persons_temporary": _group,
    }),
})
METADATA = Spec(children={
    "page_images": Spec(kind="list", node="page_image"),
    "ocr_preview": Spec(kind="pages", node="ocr_preview"),
    "extraction_trace": Spec(children={"page_2": Spec(children={
        "registered_persons_constantly": Spec(kind="group", inner="persons", children={"persons": Spec(kind="list", node="trace_person")}),
    })}),
})

NODE_SCHEMA = "source string, node_type string, node_path string, place int, pre int, post int, depth int, fields string, problem string"


def _opened(value: object, wants: type | tuple) -> object:
    """A text that holds the wanted object or list is opened, however often it was encoded."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):  # each opening makes it shorter
        try:
            inner = json.loads(value)
        except ValueError:
            break
        if not isinstance(inner, (dict, list, str)):
            break
        value = inner
    return value if isinstance(value, wants) else None


def _filled(value: object) -> bool:
    if isinstance(value, dict):
        return any(_filled(v) for v in value.values())
    if isinstance(value, list):
        return any(_filled(v) for v in value)
    return value is not None


def _elements(value: object) -> list[tuple[int, object]]:
    """(place, element) of a list, of a lone value, or of an object whose keys are places."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        opened = _opened(value, (dict, list))
        value = value if opened is None else opened
    if value is None:
        return []
    if isinstance(value, dict) and value and all(k.isdecimal() for k in value):
        return [(int(k), value[k]) for k in sorted(value, key=int)]
    if not isinstance(value, list):
        value = [value]
    return list(enumerate(value))


class _Walk:
    def __init__(self, source: str, with_fields: bool):
        self.source, self.with_fields, self.clock, self.rows = source, with_fields, 0, []

    def enter(self) -> int:
        self.clock += 1
        return self.clock

    def leave(self, pre: int, spec: Spec, path: str, place: int | None, depth: int, value: object) -> None:
        self.clock += 1
        text = None
        if self.with_fields:
            keep = {k: v for k, v in value.items() if k not in spec.children} if isinstance(value, dict) else {"value": value}
            text = json.dumps(keep, ensure_ascii=False).encode("utf-8", "replace").decode()
        self.rows.append((self.source, spec.node, path, place, pre, self.clock, depth, text, None))

    def place(self, spec: Spec, value: object, path: str, depth: int) -> None:
        if value is None:
            return
        if spec.kind == "object":
            self.object(spec, _opened(value, dict), path, None, depth)
        elif spec.kind == "group":
            value = _opened(value, (dict, list))
            child = spec.children[spec.inner]
            at = f"{path}.{spec.inner}"
            if isinstance(value, dict) and not (value and all(k.isdecimal() for k in value)):
                if spec.inner in value:
                    self.place(child, value[spec.inner], at, depth)
                elif "full_name" in value:  # a lone element where the group is due
                    self.place(child, value, at, depth)
            elif value is not None:
                self.place(child, value, at, depth)
        elif spec.kind == "list":
            for i, element in _elements(value):
                if element is None:
                    continue
                at = f"{path}[{i}]"
                opened = _opened(element, dict) if spec.children else element
                if isinstance(opened, dict):
                    self.object(spec, opened, at, i, depth)
                else:
                    self.leave(self.enter(), spec, at, i, depth, element)
        elif spec.kind == "pages":
            self.pages(spec, _opened(value, (dict, list)) or value, path, depth)

    def pages(self, spec: Spec, value: object, path: str, depth: int) -> None:
        found: list[tuple[str, object]] = []
        if isinstance(value, dict) and "text" in value and "page" in value:
            value = [value]
        if isinstance(value, dict):
            found = [(k if k.startswith("page_") else f"page_{k}", v) for k, v in value.items()]
        elif isinstance(value, list):
            for i, v in enumerate(value):
                number = v.get("page", i + 1) if isinstance(v, dict) else i + 1
                found.append((f"page_{number}", v.get("text") if isinstance(v, dict) else v))
        elif isinstance(value, str):
            found = [("page_1", value)]
        for key, text in found:
            if text is not None:
                tail = key.rpartition("_")[2]
                self.leave(self.enter(), spec, f"{path}.{key}", int(tail) if tail.isdecimal() else None, depth, text)

    def object(self, spec: Spec, value: object, path: str, place: int | None, depth: int) -> None:
        if not isinstance(value, dict) or spec.filled and not _filled(value):
            return
        pre = self.enter() if spec.node else 0
        for key, child in spec.children.items():
            if value.get(key) is not None:
                self.place(child, value[key], f"{path}.{key}" if path else key, depth + bool(spec.node))
        if spec.node:
            self.leave(pre, spec, path, place, depth, value)


def walk(text: str | None, spec: Spec, source: str, with_fields: bool = True, clock: int = 0) -> list[tuple]:
    """Node rows of one JSON text, in post-order.

    Null or empty text: no rows. Text that is no JSON object: one row of type
    ``unreadable``. A wrapping object and repeated encoding are looked through; a null
    element keeps its place and is no node; a lone value where a list is due is
    element 0; an object whose keys are places counts as that list.
    """
    if text is None or not text.strip():
        return []
    try:
        value = json.loads(text)
        while isinstance(value, str):  # each opening makes it shorter
            value = json.loads(value)
    except (ValueError, RecursionError) as e:
        return [(source, "unreadable", source, None, clock + 1, clock + 2, 1, None, type(e).__name__)]
    while isinstance(value, dict) and not any(k in value for k in spec.children):
        inner = next((v for k in WRAPPERS if isinstance(v := _opened(value.get(k), dict), dict)), None)
        if inner is None:
            break
        value = inner
    if value is None:
        return []
    if not isinstance(value, dict):
        return [(source, "unreadable", source, None, clock + 1, clock + 2, 1, None, "not an object")]
    w = _Walk(source, with_fields)
    w.clock = clock
    w.object(spec, value, "", None, 1)
    return w.rows


def label_nodes(df: DataFrame, keys: list[str], sources: dict[str, Spec], with_fields: bool = True) -> DataFrame:
    """Interval-labelled nodes of all JSON columns of ``df``.

    df: one row per record; keys: its key columns; sources: JSON column to schema.
    The numbering runs on over the columns of a record, and the record itself is the
    root node of type ``record`` that spans them all. Returns ``keys`` and
    ``NODE_SCHEMA``; other columns of ``df`` are not read. Empty input: no rows.
    """
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + NODE_SCHEMA
    names = list(sources)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, owner = [], []
            for i, texts in enumerate(zip(*(pdf[f"_{n}"] for n in range(len(names))))):
                start = len(out)
                clock = 1
                for name, text in zip(names, texts):
                    rows = walk(text, sources[name], name, with_fields, clock)
                    clock = rows[-1][5] if rows else clock
                    for r in rows:
                        clock = max(clock, r[5])
                    out += rows
                out.append(("", "record", "", None, 1, clock + 1, 0, None, None))
                owner += [i] * (len(out) - start)
            cols = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
            made = pd.DataFrame(out, columns=cols)
            made["place"] = made["place"].astype("Int32")
            head = pdf[keys].iloc[owner].reset_index(drop=True)
            yield pd.concat([head, made], axis=1)

    picked = df.select(*keys, *[F.col(c).alias(f"_{n}") for n, c in enumerate(names)])
    return picked.mapInPandas(run, schema)


def link(nodes: DataFrame, keys: list[str], child: Column, parent: Column, carry: list[str]) -> DataFrame:
    """Nodes that satisfy ``child`` with the columns ``carry`` of the nearest
    ``parent`` node whose interval contains theirs, as ``parent_<name>``; nulls if none.

    Parents of one type don't nest here, so the last one entered before the child is
    the only one that can contain it: one sort within the record, no pair is formed.
    """
    w = Window.partitionBy(*keys).orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(parent, F.struct("post", *carry)), ignorenulls=True).over(w)
    inside = F.when(F.col("_p.post") > F.col("post"), F.col("_p"))
    return (
        nodes.filter(child | parent)
        .withColumn("_p", seen)
        .filter(child)
        .withColumn("_p", inside)
        .select(*nodes.columns, *[F.col(f"_p.{c}").alias(f"parent_{c}") for c in carry])
    )


def node_table(nodes: DataFrame, keys: list[str], node_type: str, fields: dict[str, str], *parent_types: str) -> DataFrame:
    """The flat table of one node type: keys, own and parent interval number, place
    and path, and ``fields`` (name to JSON path under the node) as text. parent_types: the
    types a parent may have (none given: the record)."""
    linked = link(nodes, keys, F.col("node_type") == node_type, F.col("node_type").isin(*(parent_types or ("record",))), ["pre"])
    return linked.select(
        *keys, "pre", "post", "parent_pre", "place", "node_path",
        *[F.get_json_object("fields", p).alias(n) for n, p in fields.items()],
    )
