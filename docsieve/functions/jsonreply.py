"""The one Python kernel: find and shred the JSON inside a free-form model reply.

Balanced braces are not a regular language, and the native JSON functions accept
texts a strict parser rejects (trailing text, single quotes), so this step runs as an
Arrow UDF.  It sees one string per reply and returns nested arrays; all meaning (fields,
rows, answers, schema rules) is assigned afterwards by native expressions.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from docsieve.functions import dims
from docsieve.functions.text import canonical_name, clean_text

LEAF = "struct<key:string,kind:string,value:string>"
INNER = f"struct<key:string,kind:string,value:string,items:array<{LEAF}>>"
NODE = f"struct<key:string,kind:string,value:string,items:array<{INNER}>>"
TREE = f"struct<error:string,kind:string,nodes:array<{NODE}>>"
ENTRY = "struct<pos:int,field:string,kind:string,value:string>"
NAMED_TREE = f"struct<error:string,kind:string,nodes:array<{NODE}>,entries:array<{ENTRY}>>"
FIRST = "struct<pos:int,candidate:string,kind:string,error:string>"

# ---- Fixed values: code fences, with or without a json tag --------------------------------
FENCE_MARK = "```"
FENCE_TAG = re.compile("json", re.IGNORECASE)

_MARKS = re.compile(r'[{}"\\]')


def _closing_braces(text: str) -> dict[int, int]:
    """For every ``{`` the position of the ``}`` that balances it, if any.

    One pass from the right.  ``plain`` and ``quoted`` hold, for a reader entering the
    current position outside or inside a string, the linked list of closing braces it
    would still meet unmatched.  A quote swaps the two; sharing the lists keeps the pass
    linear however many braces stay open.
    """
    closing: dict[int, int] = {}
    plain = quoted = after_next = None
    last = len(text) + 1
    for mark in reversed(list(_MARKS.finditer(text))):
        at, char = mark.start(), mark.group()
        before = quoted
        if char == '"':
            plain, quoted = quoted, plain
        elif char == "}":
            plain = (at, plain)
        elif char == "{":
            if plain is not None:
                closing[at], plain = plain
        elif last == at + 1:  # backslash: inside a string the next character is skipped
            quoted = after_next
        after_next, last = before, at
    return closing


def brace_objects(text: str) -> list[str]:
    """Balanced ``{...}`` substrings, leftmost first, never overlapping."""
    closing = _closing_braces(text)
    found, start = [], text.find("{")
    while start >= 0:
        end = closing.get(start)
        if end is not None:
            found.append(text[start:end + 1])
        start = text.find("{", start + 1 if end is None else end + 1)
    return found


def fence_bodies(text: str) -> list[str]:
    """Texts between pairs of fence marks, without a json tag and outer blanks; linear."""
    found, at = [], text.find(FENCE_MARK)
    while at >= 0:
        start = at + len(FENCE_MARK)
        tag = FENCE_TAG.match(text, start)
        start = tag.end() if tag else start
        end = text.find(FENCE_MARK, start)
        if end < 0:
            break
        found.append(text[start:end].strip())
        at = text.find(FENCE_MARK, end + len(FENCE_MARK))
    return found


def _candidates(reply: str) -> Iterator[str]:
    text = reply.strip()
    yield from fence_bodies(text)
    if text[:1] == "{" and text[-1:] == "}":
        yield text
    yield from brace_objects(text)  # only reached, and scanned, when the others fail


def candidate_texts(reply: str) -> list[str]:
    """Texts that may be JSON: fence bodies, the whole reply, brace objects; no repeats."""
    return list(dict.fromkeys(filter(None, _candidates(reply))))


def first_json(reply: str) -> tuple[int | None, str | None, object, str | None]:
    """(position, candidate, value, error) of the first candidate that parses."""
    tried, error = {}, None
    for candidate in filter(None, _candidates(reply)):
        if candidate in tried:
            continue
        try:
            return len(tried), candidate, json.loads(candidate), None
        except (ValueError, RecursionError) as exc:
            tried[candidate] = error = error or dims.MALFORMED_JSON + str(exc)
    return None, None, None, error or dims.NO_JSON_OBJECT


_KINDS = {
    str: "string", int: "number", float: "number", bool: "boolean", type(None): "null", dict: "object", list: "array",
}


def _kind(value) -> str:
    return _KINDS[type(value)]


def _utf8(text: str) -> str:
    """Lone surrogates cannot leave Python; they become '?'."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


#: Made once: ``json.dumps`` builds an encoder for every text that is not of its default form.
_json_text = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


class _Level:
    """Column builders for one nesting level; ``inner`` holds the children."""

    def __init__(self, depth: int):
        self.keys, self.kinds, self.values, self.offsets = [], [], [], [0]
        self.container_text = depth == 1
        self.inner = _Level(depth - 1) if depth > 1 else None

    def carry_text(self, wanted: bool) -> None:
        """Whether containers added next carry their JSON text; those of the last level always do."""
        if self.inner is not None:
            self.container_text = wanted
            self.inner.carry_text(wanted)

    def add_children(self, container, depth: int = 3) -> None:
        """Append the entries of one object or array (nothing for other values), and theirs down to ``depth`` levels."""
        if isinstance(container, dict):
            self.keys += map(_utf8, container)
            elements = container.values()
        else:
            elements = container if isinstance(container, list) else ()
            self.keys += [None] * len(elements)
        kinds, values = self.kinds, self.values
        for value in elements:
            kind = _KINDS[type(value)]
            kinds.append(kind)
            if kind == "string":
                values.append(value if value.isascii() else _utf8(value))
            elif kind in ("object", "array"):
                values.append(_utf8(_json_text(value)) if self.container_text else None)
            else:
                values.append(None if value is None else str(value))
        self.offsets.append(len(self.keys))
        inner = self.inner
        if inner is not None:
            offsets = inner.offsets
            for value in elements:
                if depth > 1 and value and isinstance(value, (dict, list)):
                    inner.add_children(value, depth - 1)
                else:
                    offsets.append(offsets[-1])

    def to_array(self) -> pa.ListArray:
        arrays = [pa.array(col, pa.string()) for col in (self.keys, self.kinds, self.values)]
        names = ["key", "kind", "value"]
        if self.inner is not None:
            arrays.append(self.inner.to_array())
            names.append("items")
        entries = pa.StructArray.from_arrays(arrays, names=names)
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), entries)


def _named_members(value) -> Iterator[tuple[str, object]]:
    """Members that may be fields: those of ``fields`` (an object or a list of objects), else of the payload."""
    if isinstance(value, dict) and isinstance(value.get("fields"), (dict, list)):
        value = value["fields"]
    for members in (value,) if isinstance(value, dict) else value if isinstance(value, list) else ():
        if isinstance(members, dict):
            yield from members.items()


class _Entries:
    """Column builders for the first entry of every canonical field name, in reply order."""

    def __init__(self) -> None:
        self.pos, self.fields, self.kinds, self.values, self.offsets = [], [], [], [], [0]

    def add(self, value) -> None:
        seen: set[str] = set()
        pos = 0
        for key, item in _named_members(value):
            kind = _KINDS[type(item)]
            name = "" if kind in ("object", "array") else canonical_name(_utf8(key))
            if not name:
                continue
            if name not in seen:
                seen.add(name)
                self.pos.append(pos)
                self.fields.append(name)
                self.kinds.append(kind)
                self.values.append(clean_text(_utf8(item)) if kind == "string" else None if item is None else str(item))
            pos += 1
        self.offsets.append(len(self.pos))

    def to_array(self) -> pa.ListArray:
        entries = pa.StructArray.from_arrays(
            [pa.array(self.pos, pa.int32()), *(pa.array(column, pa.string()) for column in (self.fields, self.kinds, self.values))],
            names=["pos", "field", "kind", "value"])
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), entries)


def _payload(reply: str | None) -> tuple[str | None, str | None, object]:
    """(error, kind, value) of a reply's first JSON value; a list counts where nothing else parses."""
    if reply is None:
        return None, None, None
    pos, _, value, error = first_json(reply)
    kind = None if pos is None else _kind(value)
    if pos is None and reply.strip()[:1] == "[":
        try:
            value = json.loads(reply.strip())
            kind = _kind(value)
        except (ValueError, RecursionError):
            pass
    return None if error is None else _utf8(error), kind, value


def _shredded(replies: pa.Array, container_text: pa.Array, named: pa.Array | None, depth: pa.Array | None) -> pa.Array:
    sys.set_int_max_str_digits(0)
    errors, kinds, level, entries = [], [], _Level(3), _Entries()
    wants_names = [False] * len(replies) if named is None else named.to_pylist()
    depths = [3] * len(replies) if depth is None else depth.to_pylist()
    for reply, wanted, by_name, levels in zip(replies.to_pylist(), container_text.to_pylist(), wants_names, depths):
        error, kind, value = _payload(reply)
        errors.append(error)
        kinds.append(kind)
        level.carry_text(bool(wanted))
        level.add_children(None if by_name else value, levels)
        entries.add(value if by_name else None)
    arrays = [pa.array(errors, pa.string()), pa.array(kinds, pa.string()), level.to_array()]
    names = ["error", "kind", "nodes"]
    if named is not None:
        arrays.append(entries.to_array())
        names.append("entries")
    return pa.StructArray.from_arrays(arrays, names=names, mask=replies.is_null())


def _tree_batch(replies: pa.Array, container_text: pa.Array) -> pa.Array:
    return _shredded(replies, container_text, None, None)


def _named_tree_batch(replies: pa.Array, container_text: pa.Array, named: pa.Array, depth: pa.Array) -> pa.Array:
    return _shredded(replies, container_text, named, depth)


def _candidates_batch(replies: pa.Array) -> pa.Array:
    return pa.array(
        [None if r is None else [_utf8(c) for c in candidate_texts(r)] for r in replies.to_pylist()],
        pa.list_(pa.string()),
    )


def _first_batch(replies: pa.Array) -> pa.Array:
    sys.set_int_max_str_digits(0)
    rows = []
    for reply in replies.to_pylist():
        if reply is None:
            rows.append(None)
            continue
        pos, candidate, value, error = first_json(reply)
        rows.append({
            "pos": pos,
            "candidate": None if candidate is None else _utf8(candidate),
            "kind": None if pos is None else _kind(value),
            "error": None if error is None else _utf8(error),
        })
    return pa.array(rows, pa.struct([
        ("pos", pa.int32()), ("candidate", pa.string()), ("kind", pa.string()), ("error", pa.string()),
    ]))


def _kernel(function, return_type: str):
    # Marked nondeterministic so the optimizer never evaluates it twice for one row
    # (a filter on the result would otherwise be pushed down with a second copy).
    return F.arrow_udf(function, return_type).asNondeterministic()


def _maybe_json(reply: Column, opening: str) -> Column:
    """The reply when it can hold JSON, else NULL: the others never travel to Python."""
    return F.when(reply.rlike(opening), reply)


def json_candidates(reply: Column) -> Column:
    """``array<string>`` of candidate JSON texts in trial order."""
    return F.coalesce(
        _kernel(_candidates_batch, "array<string>")(_maybe_json(reply, r"\{|```")),
        dims.string_array(()),
    )


def json_first_valid(reply: Column) -> Column:
    """First candidate that parses: ``struct<pos, candidate, kind, error>``."""
    return _kernel(_first_batch, FIRST)(_maybe_json(reply, r"\{|```"))


def json_tree(reply: Column, container_text: Column | bool = False, named: Column | bool | None = None, depth: Column | int = 3) -> Column:
    """First parseable JSON value of a reply, shredded three levels deep, entries in order.

    Scalars carry their text and kind.  Objects and arrays carry their JSON text at the
    third level, and at every level where ``container_text`` is true.  Rows where ``named`` is
    true have ``entries`` instead of nodes: the scalars of ``fields`` or of the payload under their
    canonical names, values normalised, of every name the first; the others are shredded ``depth``
    levels deep.  Without ``named`` there is no such column.
    """
    text = _maybe_json(reply, r"\{|```|^[\s\x1c-\x1f\x85\p{Z}]*\[")
    given = lambda value: value if isinstance(value, Column) else F.lit(value)
    if named is None:
        return _kernel(_tree_batch, TREE)(text, given(container_text))
    return _kernel(_named_tree_batch, NAMED_TREE)(text, given(container_text), given(named), given(depth))


def explode_rows(df, column: Column, pos: str, *names: str):
    """``posexplode`` of a computed array or map.

    The plain form makes the optimizer infer a non-empty filter, pushed down with a second
    copy of the computation; the outer form plus a filter on its position does not.
    """
    return df.select(*df.columns, F.posexplode_outer(column).alias(pos, *names)).filter(F.col(pos).isNotNull())


def node(nodes: Column, key: str) -> Column:
    """The entry with this key (keys are unique), NULL when absent."""
    return F.get(F.filter(nodes, lambda n: n["key"] == key), F.lit(0))


def leaves(items: Column) -> Column:
    """Entries reduced to ``array<struct<key, kind, value>>`` whatever their level."""
    return F.transform(
        items,
        lambda n: F.struct(n["key"].alias("key"), n["kind"].alias("kind"), n["value"].alias("value")),
    )
