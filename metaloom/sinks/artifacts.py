"""Artifacts: named tables in a folder, with an envelope that states their kind, version and content identity.

A content identity does not depend on the order or the partitioning of rows. Every row becomes canonical text and a
SHA-256; the eight words of all digests are summed column by column in one aggregation, and the identity is the digest
of the sums and the number of rows. No task and no driver ever holds more than its own rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StructType

from ..functions import canonical

#: Versions of the artifacts that are written, by the name under which their identity is made.
VERSIONS = {
    "snapshot": 1, "property_observations": 1, "property_conflicts": 1, "graph": 1, "impact_result": 1, "snapshot_comparison": 1, "drift_result": 1, "history": 1,
    "history_evolution": 1, "explain_result": 1, "plan": 1, "plan_v2": 2, "remote_state": 1, "ci_review": 1, "policy": 1, "authority": 1, "drift_policy": 1,
}
ENVELOPE = "kind string, version int, table string, n_rows bigint, digest string, names map<string,string>"


class ArtifactError(ValueError):
    """An artifact that is not what its envelope says."""


class Artifact(NamedTuple):
    kind: str
    version: int
    names: dict[str, str]
    tables: dict[str, DataFrame]


def row_text(df: DataFrame) -> Column:
    """A row as text: columns by name, nulls and empty values told apart, maps by key."""

    def shown(c: Column, kind) -> Column:
        if isinstance(kind, MapType):
            return F.to_json(F.array_sort(F.map_entries(c)))
        return F.to_json(c) if isinstance(kind, (ArrayType, StructType)) else c.cast("string")

    def escaped(c: Column, kind) -> Column:
        if isinstance(kind, NumericType):
            return c
        return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\x1f"), F.lit("\\\x1f"))

    parts = [F.coalesce(F.concat(F.lit("="), escaped(shown(F.col(f"`{f.name}`"), f.dataType), f.dataType)), F.lit("-")) for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return F.concat_ws("\x1f", *parts) if parts else F.lit("")


WORDS = [f"s{i}" for i in range(8)]


def row_sums(df: DataFrame, kind: str, *by: str) -> DataFrame:
    """For each value of by (without it: one row): n_rows and the sums of the eight words of all row digests (s0 to s7).

    by is no part of the rows. Sums can be added and subtracted: those of a table are the ones before, plus those of the
    rows that came, less those of the rows that went, so a change needs no look at the rows that stay.
    """
    digest = canonical.digest(kind, row_text(df.drop(*by)))
    rows = df.select(*by, digest.alias("__row"))
    # Two words at a time become a number. Halves of words are summed, so that whole numbers suffice for 2**47 rows.
    rows = rows.select(*by, *(F.conv(F.substring("__row", 16 * i + 1, 16), 16, -10).cast("bigint").alias(f"__two{i}") for i in range(4)))
    half = lambda i, k: F.shiftrightunsigned(f"__two{i // 2}", 48 - 32 * (i % 2) - 16 * k).bitwiseAND(F.lit(0xFFFF))
    total = lambda i, k: F.coalesce(F.sum(half(i, k)), F.lit(0)).cast("decimal(38,0)")
    sums = [F.coalesce((total(i, 0) * 65536 + total(i, 1)).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(name) for i, name in enumerate(WORDS)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *sums)


def changed_sums(before: DataFrame, came: DataFrame, went: DataFrame, *by: str) -> DataFrame:
    """The row_sums() of tables after rows came and went, from those of the tables, of the new rows and of the gone ones."""
    signed = lambda df, sign: df.select(*by, *((F.col(c) * sign).cast("decimal(38,0)").alias(c) for c in ("n_rows", *WORDS)))
    every = signed(before, 1).unionByName(signed(came, 1)).unionByName(signed(went, -1))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = every.groupBy(*by).agg(total("n_rows").cast("bigint").alias("n_rows"), *(total(c).cast("decimal(38,0)").alias(c) for c in WORDS))
    return out.filter("n_rows != 0") if by else out


def sums_digest(kind: str, columns: list[str]) -> Column:
    """The content identity of row_sums() of a table with these columns."""
    names = ",".join(sorted(columns)).lower()
    return canonical.digest(kind, F.concat_ws("|", F.lit(names), F.col("n_rows").cast("string"), *(F.col(c).cast("string") for c in WORDS)))


def identity(df: DataFrame, kind: str, *by: str) -> DataFrame:
    """n_rows and digest, for each value of by (without it: one row)."""
    columns = [c for c in df.columns if c not in by]
    return row_sums(df, kind, *by).select(*by, "n_rows", sums_digest(kind, columns).alias("digest"))


def write(folder: str, kind: str, tables: dict[str, DataFrame], names: dict[str, str] | None = None, *, partition_by: dict[str, list[str]] | None = None) -> None:
    """Writes tables below a new folder as Parquet; the envelope comes last, so a folder without one is no artifact."""
    if kind not in VERSIONS:
        raise ArtifactError(f"unknown kind of artifact: {kind}")
    if not tables:
        raise ArtifactError("an artifact needs a table")
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        path = f"{folder}/{name}"
        writer = df.write
        if partition_by and name in partition_by:
            writer = writer.partitionBy(*partition_by[name])
        writer.parquet(path)
        # What was written is what is identified: rows that are not deterministic are not made twice.
        own = identity(spark.read.schema(df.schema).parquet(path).select(*df.columns), kind).first()
        rows.append((kind, VERSIONS[kind], name, own["n_rows"], own["digest"], names or {}))
    spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.json(f"{folder}/envelope")


def read(spark: SparkSession, folder: str, kind: str, *, verify: bool = True) -> Artifact:
    """The tables of an artifact. Another kind or version, or rows that do not have the stated identity, is an error."""
    envelope = spark.read.schema(ENVELOPE).json(f"{folder}/envelope").collect()
    if not envelope:
        raise ArtifactError(f"{folder} has no envelope")
    first = envelope[0]
    if first["kind"] != kind or first["version"] != VERSIONS.get(kind):
        raise ArtifactError(f"{folder} is {first['kind']} version {first['version']}, not {kind} version {VERSIONS.get(kind)}")
    tables = {}
    for r in envelope:
        df = spark.read.parquet(f"{folder}/{r['table']}")
        if verify and tuple(identity(df, kind).first()) != (r["n_rows"], r["digest"]):
            raise ArtifactError(f"{folder}/{r['table']} does not have the content that its envelope states")
        tables[r["table"]] = df
    return Artifact(kind, first["version"], dict(first["names"] or {}), tables)


def to_json_lines(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON, with nulls written."""
    df.write.option("ignoreNullFields", "false").json(path)
