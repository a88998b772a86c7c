"""The supplied tables as governance graphs, observations, snapshots and catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions contain nations, nations contain customers and suppliers; orders depend on customers and suppliers. Parts
    are contracts that govern a customer, a nation or a region."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda df, kind, prefix, key, name, parent: df.select(_key(prefix, key).alias("node_key"), F.lit(kind).alias("kind"), parent.alias("parent_key"), name.alias("name"))
    none = F.lit(None).cast("string")
    nodes = node(t("region"), "data_source", "r", "r_regionkey", F.col("r_name"), none)
    nodes = nodes.unionByName(node(t("nation"), "dataset", "n", "n_nationkey", F.col("n_name"), _key("r", "n_regionkey")))
    nodes = nodes.unionByName(node(t("customer"), "table", "c", "c_custkey", F.col("c_name"), _key("n", "c_nationkey")))
    nodes = nodes.unionByName(node(t("supplier"), "contract", "s", "s_suppkey", F.col("s_name"), _key("n", "s_nationkey")))
    nodes = nodes.unionByName(node(t("orders"), "transformation", "o", "o_orderkey", F.col("o_orderpriority"), none))
    nodes = nodes.unionByName(node(t("part"), "contract", "p", "p_partkey", F.col("p_name"), none))
    k = F.col("p_partkey")
    governed = F.when(k % 3 == 0, F.concat(F.lit("c:"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("n:"), (k % 25).cast("string"))).otherwise(F.concat(F.lit("r:"), (k % 5).cast("string")))
    governs = t("part").select(_key("p", "p_partkey").alias("src_key"), F.lit("governs").alias("kind"), governed.alias("dst_key"))
    governs = governs.join(nodes.filter(F.col("kind").isin("data_source", "dataset", "table")).select(F.col("node_key").alias("dst_key")), "dst_key", "left_semi").select("src_key", "kind", "dst_key")
    contains = nodes.filter("parent_key IS NOT NULL").select(F.col("parent_key").alias("src_key"), F.lit("contains").alias("kind"), F.col("node_key").alias("dst_key"))
    customers = t("orders").select(_key("o", "o_orderkey").alias("src_key"), F.lit("depends_on").alias("kind"), _key("c", "o_custkey").alias("dst_key"))
    suppliers = t("lineitem").select("l_orderkey", "l_suppkey").distinct().select(_key("o", "l_orderkey").alias("src_key"), F.lit("depends_on").alias("kind"), _key("s", "l_suppkey").alias("dst_key"))
    above = t("nation").select(_key("n", "n_nationkey").alias("nation"), _key("r", "n_regionkey").alias("region"))
    up = F.filter(F.array("parent_key", "region"), lambda x: x.isNotNull())
    nodes = nodes.join(above, F.col("parent_key") == F.col("nation"), "left").withColumn("ancestor_keys", up).drop("nation", "region")
    return Graph(nodes, contains.unionByName(customers).unionByName(suppliers).unionByName(governs))


def roots(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "root string")


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A depends_on edge for each line of an order, with its provenance: many lines give the same edge."""
    p = F.struct(F.lit("dbt").alias("provider_type"), F.concat(F.lit("m"), F.pmod("l_partkey", F.lit(3))).alias("source_ref"), F.col("l_returnflag").alias("source_version"), F.lit("declared").alias("observation_mode"))
    return table(spark, sf_dir, "lineitem").select(_key("o", "l_orderkey").alias("src_key"), F.lit("depends_on").alias("kind"), _key("s", "l_suppkey").alias("dst_key"), F.array(p).alias("provenance"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: a user's property /attributes/<type> has a value in steps of ten, seen by a provider."""
    e = table(spark, sf_dir, "events")
    p = F.struct(F.element_at(F.array(F.lit("odcs"), F.lit("dbt"), F.lit("openlineage")), (F.pmod("event_id", F.lit(3)) + 1).cast("int")).alias("provider_type"), F.concat(F.lit("s"), F.pmod("event_id", F.lit(5))).alias("source_ref"), F.lit(None).cast("string").alias("source_version"), F.lit("observed").alias("observation_mode"))
    value = F.floor(F.col("value") / 10).cast("bigint").cast("string")
    return e.select(F.concat(F.lit("u:"), F.col("user_id")).alias("object_key"), F.concat(F.lit("ns"), F.pmod("user_id", F.lit(2))).alias("namespace"), F.lit("table").alias("kind"), F.concat(F.lit("/attributes/"), F.col("event_type")).alias("pointer"), value.alias("value_json"), F.array(p).alias("provenance"), "ts")


def daily_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observations() with a user's day as the object, so that few sources meet on a property."""
    return observations(spark, sf_dir).withColumn("object_key", F.concat_ws("/", "object_key", F.col("ts").cast("date").cast("string")))


#: Authority by selector: one with a namespace, one for any source, and two that contradict each other.
AUTHORITY = [
    ("table", "/attributes/view", None, "odcs", None),
    ("table", "/attributes/view", "ns1", "dbt", None),
    ("table", "/attributes/click", None, "dbt", "s1"),
    ("table", "/attributes/purchase", None, "odcs", None),
    ("table", "/attributes/purchase", None, "openlineage", None),
    ("table", "/attributes/scroll", None, "openlineage", "s4"),
]


def authority(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AUTHORITY, "kind string, pointer string, namespace string, provider_type string, source_ref string")


def snapshot(spark: SparkSession, sf_dir: str, side: str) -> tuple[DataFrame, DataFrame]:
    """Orders as a snapshot: objects and properties. The baseline does not know low priorities yet, the
    candidate no longer has those not specified, and they differ in some values."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kept = o.filter(F.col("o_orderpriority") != ("5-LOW" if side == "baseline" else "4-NOT SPECIFIED"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    status = F.when(k % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")) if side == "candidate" else F.col("o_orderstatus")
    priority = F.when(k % 11 == 0, F.lit("null")).otherwise(quoted(F.col("o_orderpriority"))) if side == "candidate" else quoted(F.col("o_orderpriority"))
    has = (k % 13 != 0) if side == "candidate" else F.lit(True)
    rows = F.array(
        F.struct(F.lit("/status").alias("pointer"), F.lit(True).alias("has_value"), quoted(status).alias("value_json")),
        F.struct(F.lit("/priority").alias("pointer"), F.lit(True).alias("has_value"), priority.alias("value_json")),
        F.struct(F.lit("/customer").alias("pointer"), has.alias("has_value"), F.when(has, F.col("o_custkey").cast("string")).alias("value_json")),
    )
    keyed = kept.select(_key("o", "o_orderkey").alias("object_key"), F.lit("table").alias("kind"), _key("c", "o_custkey").alias("parent_key"), rows.alias("rows"))
    return keyed.drop("rows"), keyed.select("object_key", F.explode("rows").alias("r")).select("object_key", "r.*")


def drift_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules for the orders that are not pending: added ones are expected, status may become X, priority must have been 1-URGENT."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus != 'P'")
    key, none = _key("o", "o_orderkey"), F.lit(None)
    rule = lambda name, change, pointer, b_has, b, c_has, c: F.struct(F.concat(F.lit(f"{name}-"), F.col("o_orderkey")).alias("rule_id"), F.lit(change).alias("change"), key.alias("object_key"), F.lit(pointer).cast("string").alias("pointer"), b_has.cast("boolean").alias("exp_base_has"), b.cast("string").alias("exp_base_json"), c_has.cast("boolean").alias("exp_cand_has"), c.cast("string").alias("exp_cand_json"))
    rows = F.array(
        rule("add", "added", None, none, none, none, none),
        rule("status", "changed", "/status", none, none, F.lit(True), F.lit('"X"')),
        rule("priority", "changed", "/priority", F.lit(True), F.lit('"1-URGENT"'), none, none),
        rule("again", "changed", "/priority", F.lit(True), F.lit('"1-URGENT"'), none, none),
    )
    return o.select(F.explode(rows).alias("r")).select("r.*")


def catalog_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, suppliers and parts as tables of a catalog; some lack an owner or a description."""
    t = lambda name: table(spark, sf_dir, name)
    one = lambda df, level, key, name, owner, description: df.select(F.lit("table").alias("kind"), F.concat(F.lit(f"tbl:{level}/"), F.col(key)).alias("local_id"), F.col(name).alias("name"), owner.alias("owner"), description.alias("description"))
    c, s, p = F.col("c_custkey"), F.col("s_suppkey"), F.col("p_partkey")
    rows = one(t("customer"), "customer", "c_custkey", "c_name", F.when(c % 5 == 0, F.lit(None)).when(c % 7 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment")), F.when(c % 11 == 0, F.lit("")).otherwise(F.col("c_name")))
    rows = rows.unionByName(one(t("supplier"), "supplier", "s_suppkey", "s_name", F.when(s % 3 == 0, F.lit(None)).otherwise(F.col("s_name")), F.col("s_name")))
    return rows.unionByName(one(t("part"), "part_1", "p_partkey", "p_name", F.col("p_brand"), F.when(p % 4 == 0, F.lit(None)).otherwise(F.col("p_type"))))


POLICIES = [
    ("owner-all", "error", "require_owner", "table", None, None),
    ("owner-supplier", "warning", "require_owner", "table", None, "tbl:supplier/"),
    ("describe-parts", "info", "require_description", "table", None, "tbl:part_1/"),
    ("describe-wild", "error", "require_description", "table", None, "tbl:part%"),
    ("describe-one", "error", "require_description", "table", "tbl:customer/11", None),
    ("related", "warning", "require_relationship", "table", None, "tbl:customer/"),
]


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "policy_id string, severity string, rule_type string, kind string, object_id string, id_prefix string")


def catalog_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order relates its customer to the order."""
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("tbl:customer/"), F.col("o_custkey")).alias("from_id"), F.concat(F.lit("tbl:orders/"), F.col("o_orderkey")).alias("to_id"))


def timeline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events by day: the last value of each type that a user has on that day. Entries are the days."""
    e = table(spark, sf_dir, "events")
    start = F.lit("2024-01-01").cast("date")
    day = F.date_diff(F.col("ts").cast("date"), start)
    last = F.max_by(F.floor(F.col("value") / 10).cast("bigint"), F.struct("ts", "event_id"))
    rows = e.groupBy(day.alias("entry_index"), F.concat(F.lit("u:"), F.col("user_id")).alias("object_key"), F.concat(F.lit("/"), F.col("event_type")).alias("pointer")).agg(last.cast("string").alias("value_json"))
    return rows.select("entry_index").distinct(), rows.withColumn("has_value", F.lit(True))


def desired_and_remote(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as desired assets, and a remote catalog that lacks some, has others, and differs in fields."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    local = F.concat(F.lit("tbl:"), k).alias("local_id")
    entries = lambda segment: F.map_from_arrays(F.array(F.lit("segment"), F.lit("nation")), F.array(segment, F.col("c_nationkey").cast("string")))
    desired = c.filter("c_mktsegment != 'BUILDING'").select(local, F.col("c_name").alias("name"), F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("display_name"), entries(F.col("c_mktsegment")).alias("attributes"))
    remote = c.filter("c_mktsegment != 'MACHINERY'").select(
        F.when(k % 17 == 0, F.lit(" ")).otherwise(F.concat(F.lit("tbl:"), k)).alias("local_id"),
        F.when(k % 5 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.col("c_name")).alias("display_name"),
        entries(F.when(k % 6 == 0, F.lit("NONE")).otherwise(F.col("c_mktsegment"))).alias("attributes"),
        F.when(k % 19 == 0, F.lit("other")).otherwise(F.lit("main")).alias("domain_ref"),
        F.lit("table").alias("type_ref"),
    )
    return desired, remote
