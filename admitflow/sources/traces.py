"""Call trees in JSON documents, read in one pass with a stack of our own: no limit on nodes or levels."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import JSONDecoder, scanstring

import pyarrow as pa

NAMES = ("node_type", "description", "observation")
ROWS = 10_000
_SPACE = re.compile(r"[ \t\n\r]*")
_DECODE = JSONDecoder().raw_decode


def nodes_of(text: str) -> list[list]:
    """[parent number, node_type, description, observation] of each node in pre-order. The root is $.tree.tree if that is an object, else the document.

    Only the objects on the way down are walked; all other values are decoded whole. ValueError for text that is not JSON.
    """
    skip = lambda i: _SPACE.match(text, i).end()
    found: list[list] = []
    inner = None  # number of the node at $.tree.tree, and of the first node after it
    stack: list[list] = []  # [what, number]; what: node, wrapper (the object at $.tree) or list (of children)

    def open_node(parent: int) -> list:
        found.append([parent, None, None, None])
        return ["node", len(found) - 1]

    i = skip(0)
    if text[i : i + 1] != "{":
        _, end = _DECODE(text, i)
        if skip(end) < len(text):
            raise ValueError("more than one JSON value")
        return []
    stack.append(open_node(-1))
    i += 1
    first = True
    while stack:
        what, number = stack[-1]
        i = skip(i)
        c = text[i : i + 1]
        if c == ("]" if what == "list" else "}"):
            stack.pop()
            if inner is not None and inner[1] is None and what == "node" and number == inner[0]:
                inner[1] = len(found)
            i, first = i + 1, False
            continue
        if not first:
            if c != ",":
                raise ValueError(f"a comma is missing at character {i}")
            i = skip(i + 1)
            c = text[i : i + 1]
        first = False
        if what == "list":
            if c == "{":
                stack.append(open_node(number))
                i, first = i + 1, True
            else:
                _, i = _DECODE(text, i)
            continue
        if c != '"':
            raise ValueError(f"a name is missing at character {i}")
        name, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"a colon is missing at character {i}")
        i = skip(i + 1)
        c = text[i : i + 1]
        if what == "node" and name == "children" and c == "[":
            stack.append(["list", number])
            i, first = i + 1, True
        elif what == "node" and number == 0 and len(stack) == 1 and name == "tree" and c == "{":
            stack.append(["wrapper", number])
            i, first = i + 1, True
        elif what == "wrapper" and name == "tree" and c == "{":
            stack.append(open_node(-1))
            inner = [stack[-1][1], None]
            i, first = i + 1, True
        else:
            value, i = _DECODE(text, i)
            if what == "node" and name in NAMES:
                text_of = value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
                found[number][1 + NAMES.index(name)] = text_of
    if skip(i) < len(text):
        raise ValueError("more than one JSON value")
    if inner is not None:
        a, z = inner
        return [[p - a if p >= a else -1, *rest] for p, *rest in found[a:z]]
    return found


def observations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, value (a document) -> path, at (from 0), action (nearest action at or above), observation: the nodes that observed something, in pre-order."""
    for b in batches:
        for path, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            try:
                nodes = nodes_of(value.as_py() or "")
            except ValueError as e:
                raise ValueError(f"{path}: {e}") from None
            actions: list[str] = []
            out: list[tuple] = []
            at = 0
            for parent, kind, description, seen in nodes:
                above = actions[parent] if parent >= 0 else "tool_api"
                actions.append((description or above) if kind == "Action" else above)
                if seen is not None and seen.strip(" "):
                    out.append((path, at, actions[-1], seen))
                    at += 1
                if len(out) == ROWS:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "at", "action", "observation"])
