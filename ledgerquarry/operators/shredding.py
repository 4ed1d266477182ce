"""Deeply nested records to related flat tables, by columnar shredding along a schema.

A schema is a tree of repeated nodes with leaves (``Node``), which says for each format where they lie. A record becomes
one column per leaf path. Each entry of a column holds the value with its repetition level (the depth at which a new
element begins; 0 for a new record) and its definition level (how much of the path exists: a node at depth j takes two
steps, 2j - 1 for a place in the list and 2j for an element that is not null; the leaf takes one more). Leaves of one node
differ in the last step only and share the rest. The table of a repeated node is rebuilt from its leaves' levels alone: an
element of depth j begins where the repetition is at most j and the definition at least 2j - 1, and its position is the
count of such entries since an outer element began. Only the nodes and leaves asked for are shredded.

Defined cases: null or broken payloads give no rows; absent, null and empty levels give no elements; a bare object
stands for an array of one; a value that is JSON text once more is read through; null elements of an array keep their
place but give no row; namespaces and prefixes of XML are ignored; an absent or empty leaf is null; objects in a leaf's
place are given as JSON text.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Path = tuple[str, ...]


@dataclass(frozen=True)
class Node:
    """A repeated node: where its elements lie in JSON and in XML (steps from the parent element, several ways allowed; no
    way means the format has none), and its leaves with theirs. A step '@x' is an attribute, '.' the element's own name."""

    name: str
    json: tuple[Path, ...] = ()
    xml: tuple[Path, ...] = ()
    leaves: dict[str, tuple[tuple[Path, ...], tuple[Path, ...]]] = field(default_factory=dict, hash=False)
    children: tuple[Node, ...] = ()

    def walk(self, above: tuple[Node, ...] = ()) -> Iterator[tuple[Node, ...]]:
        yield (*above, self)
        for c in self.children:
            yield from c.walk((*above, self))


def _at(*steps: str) -> tuple[Path, ...]:
    return (steps,)


_PARTY = ("Party", "PartyLegalEntity", "RegistrationName")
#: The schema of ``raw_record``: documents, their lines, deliveries and lots; sources, pages and checks of JSON readings.
PAPERWORK = Node(
    "document", (("documents",), ()), ((),),
    {
        "doc_type": (_at("doc_type"), _at(".")), "status": (_at("status"), ()), "doc_number": (_at("fields", "doc_number"), _at("ID")),
        "date": (_at("fields", "date"), _at("IssueDate")), "supplier_name": (_at("fields", "supplier_name"), (("AccountingSupplierParty", *_PARTY),)),
    },
    (
        Node(
            "line", _at("lines"), (("InvoiceLine",), ("CreditNoteLine",)),
            {
                "sku": (_at("sku"), _at("Item", "SellersItemIdentification", "ID")), "description": (_at("description"), _at("Item", "Name")),
                "quantity": (_at("quantity"), (("InvoicedQuantity",), ("CreditedQuantity",))), "unit": (_at("unit"), (("InvoicedQuantity", "@unitCode"), ("CreditedQuantity", "@unitCode"))),
                "unit_price": (_at("unit_price"), _at("Price", "PriceAmount")), "amount": (_at("amount"), _at("LineExtensionAmount")),
            },
            (
                Node(
                    "delivery", _at("deliveries"), _at("Delivery"), {"docket": (_at("docket"), _at("ID")), "date": (_at("date"), _at("ActualDeliveryDate"))},
                    (Node("lot", _at("lots"), _at("Shipment", "GoodsItem"), {"heat": (_at("heat"), _at("Item", "ItemInstance", "LotIdentification", "LotNumberID")), "qty": (_at("qty"), _at("Quantity"))}),),
                ),
            ),
        ),
        Node("source", _at("sources"), (), {"file": (_at("file"), ())}, (Node("page", _at("pages"), (), {"page": (((),), ())}),)),
        Node("check", _at("checks"), (), {"name": (_at("name"), ()), "kind": (_at("kind"), ()), "passed": (_at("passed"), ())}),
    ),
)


def opened(value):
    """Reads JSON text given as a value, any number of times; other text stays."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            value = json.loads(value)
        except ValueError:
            break
    return value


class JsonReader:
    """Elements and leaves of parsed JSON."""

    def __init__(self, payload: str):
        self.root = opened(json.loads(payload))

    @staticmethod
    def roots(node: Node, root) -> list:
        if isinstance(root, dict) and node.json and node.json[0] and node.json[0][0] in root:
            return JsonReader._listed(root[node.json[0][0]], False)
        return JsonReader._listed(root, False)

    @staticmethod
    def _listed(value, scalars: bool) -> list:
        value = opened(value)
        items = value if isinstance(value, list) else [] if value is None else [value]
        items = [opened(x) for x in items]
        items = [x if isinstance(x, dict) or (scalars and x is not None) else None for x in items]
        while items and items[-1] is None:
            items.pop()
        return items

    @staticmethod
    def elements(node: Node, element) -> list:
        for path in node.json:
            value = element
            for step in path:
                value = opened(value)
                value = value.get(step) if isinstance(value, dict) else None
            if value is not None:
                return JsonReader._listed(value, any(p == () for p in sum((js for js, _ in node.leaves.values()), ())))
        return []

    @staticmethod
    def leaf(paths: tuple[tuple[Path, ...], tuple[Path, ...]], element) -> str | None:
        for path in paths[0]:
            value = element
            for step in path:
                value = opened(value) if isinstance(value, str) else value
                value = value.get(step) if isinstance(value, dict) else None
            if value is not None and value != "":
                return value if isinstance(value, str) else json.dumps(value)
        return None


def _local(tag) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


class XmlReader:
    """Elements and leaves of parsed XML; the root is the one document."""

    ROOTS = ("Invoice", "CreditNote")

    def __init__(self, payload: str):
        self.root = ET.fromstring(payload)

    @staticmethod
    def roots(node: Node, root) -> list:
        return [root] if _local(root.tag) in XmlReader.ROOTS else []

    @staticmethod
    def _inside(element, path: Path) -> list:
        found = [element]
        for step in path:
            found = [c for x in found for c in x if _local(c.tag) == step]
        return found

    @staticmethod
    def elements(node: Node, element) -> list:
        return next((found for path in node.xml if (found := XmlReader._inside(element, path))), [])

    @staticmethod
    def leaf(paths: tuple[tuple[Path, ...], tuple[Path, ...]], element) -> str | None:
        for path in paths[1]:
            if path == (".",):
                return _local(element.tag)
            attribute = path[-1][1:] if path and path[-1].startswith("@") else None
            for x in XmlReader._inside(element, path[:-1] if attribute else path):
                text = x.get(attribute, "") if attribute else x.text or ""
                if text.strip():
                    return text.strip()
        return None


class Columns:
    """The columns of one node's wanted leaves: repetition, definition without the leaf's own step, and the values."""

    def __init__(self, chain: tuple[Node, ...], leaves: list[str]):
        self.chain, self.node, self.depth = chain, chain[-1], len(chain)
        self.paths = [self.node.leaves[x] for x in leaves]
        self.record: list[int] = []
        self.rep: list[int] = []
        self.dfn: list[int] = []
        self.values: list[list[str | None]] = [[] for _ in leaves]

    def put(self, n: int, r: int, d: int, reader=None, element=None) -> None:
        self.record.append(n)
        self.rep.append(r)
        self.dfn.append(d)
        for column, path in zip(self.values, self.paths):
            column.append(None if element is None else reader.leaf(path, element))


def _plan(root: Node, wanted: dict[str, list[str]]) -> tuple[dict[str, Columns], dict[str, list[Node]], dict[str, list[str]]]:
    """Columns of the wanted nodes; per node the children that lead to wanted ones, and the wanted nodes from it down."""
    columns = {chain[-1].name: Columns(chain, wanted[chain[-1].name]) for chain in root.walk() if chain[-1].name in wanted}
    below = {chain[-1].name: [c[-1].name for c in chain[-1].walk() if c[-1].name in wanted] for chain in root.walk()}
    return columns, {chain[-1].name: [c for c in chain[-1].children if below[c.name]] for chain in root.walk()}, below


def shred(root: Node, n: int, reader, plan) -> None:
    """Put record ``n`` into the columns: every wanted node gets an entry for the deepest part of its path that exists."""
    columns, children, below = plan

    def walk(node: Node, elements: list, depth: int, r: int, d: int) -> None:
        if not elements:
            for name in below[node.name]:
                columns[name].put(n, r, d)
            return
        for e in elements:
            if e is None:
                for name in below[node.name]:
                    columns[name].put(n, r, 2 * depth - 1)
            else:
                if node.name in columns:
                    columns[node.name].put(n, r, 2 * depth, reader, e)
                for child in children[node.name]:
                    walk(child, reader.elements(child, e), depth + 1, r, 2 * depth)
            r = depth

    walk(root, reader.roots(root, reader.root), 1, 0, 0)


def _running(starts: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """1-based count of ``starts`` since the last of ``resets``."""
    total = np.cumsum(starts)
    return total - np.maximum.accumulate(np.where(resets, total - starts, -1))


def rebuild(c: Columns) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Record, path and leaf values of every element, from the levels alone."""
    r, d, record = np.asarray(c.rep, dtype=np.int64), np.asarray(c.dfn, dtype=np.int64), np.asarray(c.record, dtype=np.int64)
    here = d >= 2 * c.depth
    path = None
    for level in range(1, c.depth + 1):
        starts = ((r <= level) & (d >= 2 * level - 1)).astype(np.int64)
        part = _running(starts, r < level)[here].astype(str).astype(object)
        path = part if path is None else path + "." + part
    return record[here], path, [np.asarray(v, dtype=object)[here] for v in c.values]


def shred_batches(root: Node, wanted: dict[str, dict[str, str]], id_col: str, out_columns: list[str]):
    leaves = {name: list(dict.fromkeys(columns.values())) for name, columns in wanted.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            plan, ids = _plan(root, leaves), pdf["__id"]
            for n, (fmt, payload) in enumerate(zip(pdf["fmt"], pdf["payload"])):
                if not isinstance(payload, str):
                    continue
                text = payload.lstrip("﻿ \t\r\n")
                try:
                    xml = fmt == "ubl_xml" if fmt in ("ubl_xml", "json") else text[:1] == "<"
                    reader = XmlReader(text) if xml else JsonReader(text)
                except (ValueError, ET.ParseError, RecursionError):
                    continue
                shred(root, n, reader, plan)
            for name, columns in plan[0].items():
                if not columns.rep:
                    continue
                record, path, values = rebuild(columns)
                if len(record):
                    found = dict(zip(leaves[name], values))
                    out = {id_col: ids.take(record).to_numpy(), "node_kind": name, "node_path": path}
                    yield pd.DataFrame(out | {c: found[wanted[name][c]] if c in wanted[name] else None for c in out_columns})

    return run


def shred_records(df: DataFrame, wanted: dict[str, dict[str, str]], id_col: str = "rec_id", schema: Node = PAPERWORK) -> DataFrame:
    """(id, node_kind, node_path, columns...): a row for every element of the ``wanted`` nodes, {node: {column: leaf}}.

    ``df`` needs ``fmt`` (ubl_xml or json; otherwise told from the first character) and ``payload``. A narrow map: no
    shuffle, one pass, whole payloads; the parent of ``1.2.3`` is ``1.2``.
    """
    columns = list(dict.fromkeys(c for cs in wanted.values() for c in cs))
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("__id"), "fmt", "payload").where(F.col("payload").isNotNull())
    out = ", ".join([f"`{id_col}` {kind}", "node_kind string", "node_path string", *[f"`{c}` string" for c in columns]])
    return rows.mapInPandas(shred_batches(schema, wanted, id_col, columns), out)


def node_table(df: DataFrame, node: str, id_col: str = "rec_id", schema: Node = PAPERWORK) -> DataFrame:
    """The flat table of one repeated node with all its leaves: id, node_path, parent_path and a column per leaf."""
    leaves = next(c[-1].leaves for c in schema.walk() if c[-1].name == node)
    rows = shred_records(df, {node: {x: x for x in leaves}}, id_col, schema).drop("node_kind")
    return rows.select(id_col, "node_path", F.when(F.contains("node_path", F.lit(".")), F.regexp_replace("node_path", r"\.[0-9]+$", "")).alias("parent_path"), *leaves)


def flatten_records(df: DataFrame, id_col: str = "rec_id") -> DataFrame:
    """One row per line, delivery and lot: the record's id, ``node_kind``, ``node_path``, ``node_key`` ('' if none)."""
    rows = shred_records(df, {"line": {"node_key": "sku"}, "delivery": {"node_key": "docket"}, "lot": {"node_key": "heat"}}, id_col)
    return rows.withColumn("node_key", F.coalesce("node_key", F.lit("")))


def parent_links(nodes: DataFrame, id_col: str = "rec_id", schema: Node = PAPERWORK) -> DataFrame:
    """Adds ``parent_kind`` and ``parent_path``: a line's parent is its document."""
    parent = F.lit(None).cast("string")
    for chain in schema.walk():
        if len(chain) > 1:
            parent = F.when(F.col("node_kind") == chain[-1].name, chain[-2].name).otherwise(parent)
    return nodes.withColumns({"parent_kind": parent, "parent_path": F.regexp_replace("node_path", r"\.[0-9]+$", "")})
