"""JSON documents as rows: each document is parsed once, in one task, and all that follows are ordinary columns.

flatten() makes a row for each object that a set of rules names: its place in the document, its members as canonical JSON
texts in a map, the elements of some of its lists, and what the rules keep of the objects that it lies in. What lies
deeper needs no join or further parse for its ancestors, however deep it is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain
from json.encoder import encode_basestring_ascii
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from .canonical import PREFIXES, dumps, loads

_encode = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode


class Rule(NamedTuple):
    """What to tell of one kind of object."""

    #: Where other kinds lie below it ("schema/*": each element or member) and the names of their rules. In its own
    #: members such lists and objects stand empty.
    rows: dict[str, str] = {}
    #: Members that are told; None tells all.
    tell: tuple[str, ...] | None = None
    #: Objects in it whose members are told too, as "config/materialized".
    open: tuple[str, ...] = ()
    #: Lists whose elements are told.
    lists: tuple[str, ...] = ()
    #: Texts that are told again without white space around them and case-folded, as "tenant/folded".
    folded: tuple[str, ...] = ()
    #: Members that rows below see of it.
    keep: tuple[str, ...] = ()
    #: Whether it has no row, and is not seen by rows below.
    silent: bool = False
    #: Whether it is told as one text, under the empty name, even if it is an object.
    whole: bool = False
    #: A kind of content identity, and a member or None: the identity of the object without that member is told as
    #: "/digest".
    digest: tuple[str, str | None] | None = None


ROW_FIELDS = ("doc string", "rule string", "path array<string>", "m map<string,string>", "lists map<string,array<string>>", "up array<struct<path:array<string>,m:map<string,string>>>")
ROW = ", ".join(ROW_FIELDS)
#: The rule of documents that could not be read.
FAULT = "fault"
_MAP = pa.map_(pa.string(), pa.string())
_PATH = pa.list_(pa.string())
_ARROW = pa.schema([("doc", pa.string()), ("rule", pa.string()), ("path", _PATH), ("m", _MAP), ("lists", pa.map_(pa.string(), _PATH)), ("up", pa.list_(pa.struct([("path", _PATH), ("m", _MAP)])))])


def _at(value: object, tokens: tuple[str, ...], path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], object]]:
    """All places below a value that tokens lead to."""
    if not tokens:
        yield path, value
        return
    first, rest = tokens[0], tokens[1:]
    if first == "*":
        below = value.items() if isinstance(value, dict) else ((str(i), v) for i, v in enumerate(value)) if isinstance(value, list) else ()
    else:
        below = ((first, value[first]),) if isinstance(value, dict) and first in value else ()
    for k, v in below:
        yield from _at(v, rest, (*path, k))


def _text(value: object) -> str:
    """A value as canonical JSON text; what is no object or list needs no encoder of its own."""
    kind = type(value)
    if kind is str:
        return encode_basestring_ascii(value)
    if value is None:
        return "null"
    if kind is bool:
        return "true" if value else "false"
    return int.__repr__(value) if kind is int else _encode(value)


def _tell(value: object, rule: Rule, inside: set[str]) -> tuple[dict[str, str], dict[str, list[str]]]:
    if rule.whole or not isinstance(value, dict):
        return {"": _text(value)}, {"": [_text(x) for x in value]} if isinstance(value, list) else {}
    m = {}
    for k, v in value.items():
        if rule.tell is None or k in rule.tell:
            m[k] = ("{}" if isinstance(v, dict) else "[]" if isinstance(v, list) else _text(v)) if k in inside else _text(v)
    for k in rule.open:
        if isinstance(value.get(k), dict):
            m |= {f"{k}/{name}": _text(v) for name, v in value[k].items()}
    for k in rule.folded:
        if isinstance(value.get(k), str):
            m[f"{k}/folded"] = _text(value[k].strip().casefold())
    if rule.digest:
        kind, without = rule.digest
        payload = PREFIXES[kind] + _encode({k: v for k, v in value.items() if k != without})
        m["/digest"] = hashlib.sha256(payload.encode()).hexdigest()
    return m, {k: [_text(x) for x in value[k]] for k in rule.lists if isinstance(value.get(k), list)}


class _Plan(NamedTuple):
    """A rule with what is the same for all its objects: the members in which rows lie, and where they lie."""

    rule: Rule
    inside: set[str]
    places: list[tuple[tuple[str, ...], str]]


def _plans(rules: dict[str, Rule]) -> dict[str, _Plan]:
    return {name: _Plan(rule, {place.split("/")[0] for place in rule.rows}, [(tuple(place.split("/")), below) for place, below in rule.rows.items()]) for name, rule in rules.items()}


def _visit(doc: str, value: object, name: str, plans: dict[str, _Plan], path: tuple[str, ...], up: tuple[tuple, ...]) -> Iterator[tuple]:
    """Rows as doc, rule, path, m, lists, up; m and lists are dicts, up has pairs of a path and a dict."""
    rule, inside, places = plans[name]
    if not rule.silent:
        m, lists = _tell(value, rule, inside)
        yield doc, name, path, m, lists, up
        up = (*up, (path, {k: m[k] for k in rule.keep if k in m}))
    for tokens, below in places:
        if tokens[0] != "*" and not (isinstance(value, dict) and tokens[0] in value):
            continue
        for at, v in _at(value, tokens, path):
            yield from _visit(doc, v, below, plans, at, up)


def _lists(rows: list, values: Callable[[list], pa.Array]) -> tuple[pa.Array, pa.Array]:
    """Where each of the rows starts among the values of all, and those."""
    return pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values(list(chain.from_iterable(rows)))


def _strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())


def _paths(rows: list) -> pa.Array:
    return pa.ListArray.from_arrays(*_lists(rows, _strings))


def _maps(rows: list[dict], values: Callable[[list], pa.Array] = _strings) -> pa.Array:
    starts, keys = _lists(rows, _strings)
    return pa.MapArray.from_arrays(starts, keys, values([v for m in rows for v in m.values()]))


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    """Columns are made of flat lists, as nested values one by one are dear."""
    doc, rule, path, m, lists, up = (list(c) for c in zip(*rows, strict=True))
    above = lambda values: pa.StructArray.from_arrays([_paths([p for p, _ in values]), _maps([k for _, k in values])], ["path", "m"])
    columns = [_strings(doc), _strings(rule), _paths(path), _maps(m), _maps(lists, _paths), pa.ListArray.from_arrays(*_lists(up, above))]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def flat(it: Iterator[pa.RecordBatch], rules: dict[str, Rule], root: str, faults: bool) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    plans = _plans(rules)
    for batch in it:
        for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                value = loads(text)
            except (ValueError, RecursionError) as e:
                if not faults:
                    raise
                rows.append((doc, FAULT, (), {"": _text(str(e))}, {}, ()))
                continue
            for row in _visit(doc, value, root, plans, (), ()):
                rows.append(row)
                if len(rows) == 2000:
                    yield _columns(rows)
                    rows = []
    if rows:
        yield _columns(rows)


def flatten(documents: DataFrame, text: str, rules: dict[str, Rule], root: str, distinct: bool = False, faults: bool = False) -> DataFrame:
    """The objects of documents (column text; a null one has none) that the rules name, from the whole as root on; of
    equal documents one alone, if distinct.

    doc is a digest of the text. Documents are dealt out by it first: parsing is the dear step, and few splits may hold
    many or large documents. What is no object has its text, and the elements of a list, under the empty name. What is
    no JSON, repeats a key, or is nested too deep, is an error, or with faults a row of the rule FAULT that says why.
    Flat rows (of sources/formats.py) are given back, of equal documents one alone.
    """
    if documents.columns == [f.split()[0] for f in ROW_FIELDS]:
        return documents.dropDuplicates(["doc", "rule", "path"]) if distinct else documents
    source = documents.filter(F.col(text).isNotNull()).select(F.sha2(F.col(text).cast("binary"), 256).alias("doc"), F.col(text).alias("text"))
    source = source.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc")
    return (source.distinct() if distinct else source).mapInArrow(partial(flat, rules=rules, root=root, faults=faults), ROW)


def ancestor(i: int) -> Column:
    """What is kept of the i-th object (0: the document) that a row of flatten() lies in."""
    return F.col("up")[i]["m"]


def last_token() -> Column:
    return F.element_at("path", -1)


@F.pandas_udf(MapType(StringType(), StringType()))
def members(json: pd.Series) -> pd.Series:
    """The members of a JSON object, each as canonical JSON text; null for everything else."""

    def one(x: str | None) -> dict[str, str] | None:
        value = None if x is None else loads(x)
        return {k: dumps(v) for k, v in value.items()} if isinstance(value, dict) else None

    return json.map(one)


@F.pandas_udf(ArrayType(StringType()))
def documents_in(json: pd.Series) -> pd.Series:
    """The elements of a JSON array, else the one value itself, each as canonical JSON text."""

    def one(x: str | None) -> list[str] | None:
        value = None if x is None else loads(x)
        return None if x is None else [dumps(v) for v in (value if isinstance(value, list) else [value])]

    return json.map(one)


def get(map_column: Column, name: str) -> Column:
    return F.try_element_at(map_column, F.lit(name))


def text(json: Column) -> Column:
    """The string that a JSON text is; null for everything else."""
    inner = F.substring(json, F.lit(2), F.length(json) - 2)
    parsed = F.get(F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(json.startswith('"'), F.when(json.contains("\\"), parsed).otherwise(inner))


def filled(json: Column) -> Column:
    """The string that a JSON text is, if it is not blank."""
    value = text(json)
    return F.when(F.trim(F.regexp_replace(value, r"\s", " ")) != "", value)


def string_member(json: Column, name: str) -> Column:
    """The string that a member of a JSON object is; null for everything else."""
    part = F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(part, "$", "string"))


def pairs(**parts: Column) -> Column:
    """A map of members given as canonical JSON texts; null ones are left out."""
    every = F.create_map(*(x for k in sorted(parts) for x in (F.lit(k), parts[k])))
    return F.map_filter(every, lambda _, v: v.isNotNull())


def object_text(map_column: Column) -> Column:
    """A map of members (with plain names) as a canonical JSON object."""
    each = F.transform(F.array_sort(F.map_entries(map_column)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return F.concat(F.lit("{"), F.array_join(each, ","), F.lit("}"))


def list_text(elements: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(elements, ","), F.lit("]"))


def sorted_texts(elements: Column) -> Column:
    """The strings among elements, sorted and each once, as a JSON array; null if there are none."""
    kept = F.array_sort(F.array_distinct(F.filter(elements, lambda e: e.startswith('"'))))
    return F.when(F.size(kept) > 0, list_text(kept))


def sorted_array(elements: Column, distinct: bool = False) -> Column:
    """Elements sorted by their canonical text, as a JSON array; null if there is no list."""
    own = F.array_distinct(elements) if distinct else elements
    return F.when(own.isNotNull(), list_text(F.array_sort(own)))
