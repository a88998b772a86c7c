"""Small rule documents (policies, authority, drift policies, impact changes, mappings) as DataFrames.

A rule document is a configuration file of one operator's run: it is parsed on the driver, checked, and becomes a small
DataFrame. Files are read through Spark, so they can be in any store that it reads. YAML needs PyYAML; JSON does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import canonical
from ..operators import conflicts, drift, policy
from .base import whole_texts

POLICIES = "policy_id string, severity string, rule_type string, kind string, object_id string, id_prefix string"
AUTHORITY = "rule_id string, kind string, pointer string, namespace string, provider_type string, source_ref string, description string"
DRIFT = "rule_id string, change string, object_key string, pointer string, exp_base_has boolean, exp_base_json string, exp_cand_has boolean, exp_cand_json string"
MAPPING = "category string, name string, ref string"


class RuleError(ValueError):
    """A rule document that cannot be used."""


def parse(text: str) -> object:
    """A YAML or JSON document. Repeated keys, aliases to a node above and numbers that are not finite are errors."""
    try:
        import yaml
    except ImportError:
        return canonical.loads(text)

    class Loader(yaml.SafeLoader):
        def construct_mapping(self, node, deep=False):
            keys = [self.construct_object(k, deep=True) for k, _ in node.value]
            if len({*map(repr, keys)}) < len(keys):
                raise RuleError(f"a mapping repeats a key, line {node.start_mark.line + 1}")
            return super().construct_mapping(node, deep=deep)

    try:
        return yaml.load(text, Loader)
    except yaml.YAMLError as e:
        raise RuleError(f"no YAML: {e}") from e


def read(spark: SparkSession, path: str) -> list[dict]:
    """The documents of one or more files, each an object."""
    found = [parse(r["text"]) for r in whole_texts(spark, path, ".yaml", ".yml", ".json").orderBy("path").collect()]
    for x in found:
        if not isinstance(x, dict):
            raise RuleError("a rule document must be an object")
    return found


def _get(entry: dict, name: str, where: str, required: bool = True) -> str | None:
    value = entry.get(name)
    if value is None and not required:
        return None
    if not isinstance(value, str) or not value.strip():
        raise RuleError(f"{where}: {name} must be text")
    return value.strip()


def _entries(documents: list[dict], name: str) -> list[tuple[str, dict]]:
    out = []
    for d in documents:
        rows = d.get(name, [])
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            raise RuleError(f"{name} must be a list of objects")
        out += [(f"{name}/{i}", r) for i, r in enumerate(rows)]
    return out


def _part(entry: dict, name: str, where: str) -> dict:
    value = entry.get(name)
    if not isinstance(value, dict):
        raise RuleError(f"{where}: {name} must be an object")
    return value


def _unique(ids: list[str], what: str) -> None:
    if twice := sorted({x for x in ids if ids.count(x) > 1}):
        raise RuleError(f"{what} ids are repeated: {', '.join(twice)}")


def _none(problems: DataFrame) -> None:
    if rows := problems.take(5):
        raise RuleError("; ".join(" ".join(str(x) for x in r) for r in rows))


def policies(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """Policies: id, severity, rule {type, select {kind, id or id_prefix}}."""
    rows = []
    for where, e in _entries(documents, "policies"):
        rule = _part(e, "rule", where)
        select = _part(rule, "select", where)
        rows.append((_get(e, "id", where), _get(e, "severity", where), _get(rule, "type", where), _get(select, "kind", where), _get(select, "id", where, False), _get(select, "id_prefix", where, False)))
    _unique([r[0] for r in rows], "policy")
    made = spark.createDataFrame(rows, POLICIES)
    _none(policy.unfit(made))
    return made


def authority(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """Authority rules: id, select {kind, property, namespace}, authority {provider_type, source_ref}."""
    rows = []
    for where, e in _entries(documents, "rules"):
        select, target = _part(e, "select", where), _part(e, "authority", where)
        pointer = _get(select, "property", where)
        if not pointer.startswith("/"):
            raise RuleError(f"{where}: {pointer} is no pointer")
        rows.append((_get(e, "id", where), _get(select, "kind", where), pointer, _get(select, "namespace", where, False), _get(target, "provider_type", where), _get(target, "source_ref", where, False), e.get("description")))
    _unique([r[0] for r in rows], "authority rule")
    made = spark.createDataFrame(rows, AUTHORITY)
    _none(conflicts.ambiguous_selectors(made))
    return made


def _expected(side: object, where: str) -> tuple[bool | None, str | None]:
    """A side's expectation: nothing, that the property is missing, or its value."""
    if side is None:
        return None, None
    if not isinstance(side, dict) or set(side) - {"present", "value"}:
        raise RuleError(f"{where}: an expectation has present and value")
    present = side.get("present", True)
    if not isinstance(present, bool) or (not present and "value" in side):
        raise RuleError(f"{where}: present must be true or false, and a missing property has no value")
    return present, canonical.dumps(side.get("value")) if present else None


def object_key(kind: str, path: list[str]) -> str:
    """The key by which drift rules name an object of a snapshot: its local id."""
    return f"{canonical.LOCAL_PREFIX[kind]}:{'/'.join(path)}"


def drift_rules(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """Drift rules: id, match {change, object {kind, path}, property}, expected {baseline, candidate}."""
    rows = []
    for where, e in _entries(documents, "rules"):
        match = _part(e, "match", where)
        at = _part(match, "object", where)
        path = at.get("path")
        if at.get("kind") not in canonical.LOCAL_PREFIX or not isinstance(path, list) or not path or not all(isinstance(x, str) and x for x in path):
            raise RuleError(f"{where}: an object has a kind and a path of names")
        sides = e.get("expected") or {}
        rows.append((_get(e, "id", where), _get(match, "change", where), object_key(at["kind"], path), _get(match, "property", where, False), *_expected(sides.get("baseline"), where), *_expected(sides.get("candidate"), where)))
    _unique([r[0] for r in rows], "drift rule")
    made = spark.createDataFrame(rows, DRIFT)
    _none(drift.unfit_rules(made))
    _none(drift.ambiguous_rules(made).select("object_key", "pointer"))
    return made


def _identity(entry: object, namespace: str, where: str) -> str:
    if not isinstance(entry, dict) or set(entry) != {"namespace", "kind", "logical_id", "parent"}:
        raise RuleError(f"{where}: an identity has namespace, kind, logical_id and parent")
    if entry["namespace"] != namespace:
        raise RuleError(f"{where}: the namespace must be {namespace}")
    parent = entry["parent"]
    own = [canonical.dumps(_get(entry, c, where)) for c in ("namespace", "kind", "logical_id")]
    return f"[{','.join(own)},{'null' if parent is None else _identity(parent, namespace, where)}]"


def changed_roots(spark: SparkSession, document: dict, namespace: str) -> DataFrame:
    """The changed nodes of an impact request (root: node keys); all their ancestors are of the namespace too."""
    nodes = document.get("changed_nodes")
    if not isinstance(nodes, list) or not nodes:
        raise RuleError("changed_nodes must name a node")
    return spark.createDataFrame([(_identity(x, namespace, f"changed_nodes/{i}"),) for i, x in enumerate(nodes)], "root string").distinct()


def mapping(spark: SparkSession, document: dict) -> DataFrame:
    """References of a target mapping: category, name, ref."""
    rows = [("domain_ref", "domain", _get(document, "domain_ref", "mapping"))]
    for category in ("asset_type_refs", "relation_type_refs", "attribute_type_refs"):
        rows += [(category, name, _get(_part(document, category, "mapping"), name, category)) for name in sorted(_part(document, category, "mapping"))]
    return spark.createDataFrame(rows, MAPPING)
