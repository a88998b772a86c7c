"""Canonical JSON, content identities, identity keys and JSON pointers.

Values are compared by their canonical JSON text (sorted keys, no blanks, ASCII escapes), so true is not 1, 1 is not
1.0, and a missing value is not null. The text is made once, where data come in; from then on it is an ordinary
string column that Catalyst compares, groups and sorts.
"""

from __future__ import annotations

import json
import math
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Nesting beyond which a document is refused.
MAX_DEPTH = 64

# The domain prefixes of content identities.
PREFIXES = {
    "config": "gov-config-v1\n",
    "config_v2": "gov-config-v2\n",
    "snapshot": "gov-snapshot-v1\n",
    "mapping": "gov-mapping-v1\n",
    "policy": "gov-policy-v1\n",
    "authority": "gov-authority-v1\n",
    "property_observations": "gov-property-observations-v1\n",
    "property_conflicts": "gov-property-conflicts-v1\n",
    "remote_state": "gov-remote-state-v1\n",
    "target_context": "gov-target-context-v1\n",
    "plan": "gov-plan-v1\n",
    "plan_v2": "gov-plan-v2\n",
    "graph": "gov-graph-v1\n",
    "impact_result": "gov-impact-result-v1\n",
    "reconciliation_assumptions": "gov-reconciliation-assumptions-v1\n",
    "explain_result": "gov-explain-result-v1\n",
    "snapshot_comparison": "gov-snapshot-comparison-v1\n",
    "drift_policy": "gov-drift-policy-v1\n",
    "drift_result": "gov-drift-result-v1\n",
    "history": "gov-history-v1\n",
    "history_entry_state": "gov-history-entry-state-v1\n",
    "history_evolution": "gov-history-evolution-v1\n",
    "ci_review": "gov-ci-review-v1\n",
}

#: What is looked into; other values can only be too deep.
_DEEP = (dict, list, float)


def _checked(value: object, depth: int = 0) -> object:
    if depth > MAX_DEPTH:
        raise ValueError(f"JSON nested deeper than {MAX_DEPTH}")
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("JSON numbers must be finite")
    for x in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        if depth == MAX_DEPTH or isinstance(x, _DEEP):
            _checked(x, depth + 1)
    return value


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a JSON object repeats a key")
    return found


_DECODER = json.JSONDecoder(object_pairs_hook=_no_repeats)


def dumps(value: object) -> str:
    """A Python value as canonical JSON text."""
    return json.dumps(_checked(value), sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def loads(text: str) -> object:
    """A JSON text, without repeated keys or numbers that are not finite."""
    plain = isinstance(text, str) and not text.startswith("\ufeff")  # json.loads says what is wrong with others
    return _checked(_DECODER.decode(text) if plain else json.loads(text, object_pairs_hook=_no_repeats))


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text in canonical form; null stays null; what is no JSON is an error."""
    return text.map(lambda x: None if x is None else dumps(loads(x)))


@F.pandas_udf(StringType())
def json_problem(text: pd.Series) -> pd.Series:
    """Why a text is no acceptable JSON; null if it is."""

    def why(x: str | None) -> str | None:
        try:
            loads(x or "")
        except (ValueError, RecursionError) as e:
            return str(e)
        return None

    return text.map(why)


def digest(name: str, payload: Column) -> Column:
    """The content identity of canonical text under the prefix of that name."""
    return F.sha2(F.concat(F.lit(PREFIXES[name]), payload).cast("binary"), 256)


# --- identity keys ---------------------------------------------------------------------------------------------


def json_string(c: Column) -> Column:
    """A string as JSON, for text of printable ASCII; other text must pass canonical_json."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def escaped(c: Column) -> Column:
    """Any string as canonical JSON. Printable ASCII takes two replacements; only other text is looked at by character."""
    short = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}

    def one(x: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", r"\\u$1")
        out = F.when(x.rlike(r"[\x20-\x7E]"), x).otherwise(units)
        for plain, with_slash in short.items():
            out = F.when(x == F.lit(plain), F.lit(with_slash)).otherwise(out)
        return out

    slow = F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), one), ""), F.lit('"'))
    return F.when(c.rlike(r"[^\x20-\x7E]"), slow).otherwise(json_string(c))


def node_key(namespace: Column, kind: Column, logical_id: Column, parent: Column | None = None) -> Column:
    """The key of a graph node: a canonical JSON list of namespace, kind, id and the parent's key (or null)."""
    own = F.concat_ws(",", json_string(namespace), json_string(kind), json_string(logical_id))
    return F.concat(F.lit("["), own, F.lit(","), F.coalesce(parent, F.lit("null")) if parent is not None else F.lit("null"), F.lit("]"))


# The prefixes of local ids.
LOCAL_PREFIX = {"data_source": "ds", "database": "db", "schema": "sch", "table": "tbl", "column": "col", "primary_key": "pk", "foreign_key": "fk", "relationship": "rel"}


def local_id(kind: str, *parts: Column) -> Column:
    """The local id of a catalog object: a prefix for its kind and its path."""
    return F.concat(F.lit(f"{LOCAL_PREFIX[kind]}:"), F.concat_ws("/", *parts))


@F.pandas_udf(StringType())
def name_uuid(namespace: pd.Series, name: pd.Series) -> pd.Series:
    """The UUID (version 5) of a name in a namespace."""
    return pd.Series([None if a is None or b is None else str(uuid.uuid5(uuid.UUID(a), b)) for a, b in zip(namespace, name, strict=True)], dtype=object)


# --- JSON pointers ---------------------------------------------------------------------------------------------


def escape_token(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def unescape_token(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))


def pointer(*tokens: Column) -> Column:
    """The pointer of these tokens; the root pointer is not allowed, so there is at least one."""
    return F.concat(*(x for t in tokens for x in (F.lit("/"), escape_token(t))))


def tokens(c: Column) -> Column:
    """The tokens of a pointer."""
    return F.transform(F.slice(F.split(c, "/"), 2, F.size(F.split(c, "/")) - 1), unescape_token)


def is_pointer(c: Column) -> Column:
    """Whether a text is a pointer other than the root, with no stray ~."""
    return c.isNotNull() & c.startswith("/") & ~c.rlike("~([^01]|$)")
