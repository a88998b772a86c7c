"""Providers of metadata by name and capability, and runs of several sources as one graph and one set of observations."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from importlib.metadata import EntryPoint, entry_points
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conflicts, graph
from . import dbt, odcs, openlineage
from .base import Mapped

# What a provider can do.
CAPABILITIES = ("metadata_discovery", "governance_graph", "property_observations", "lineage", "remote_state_read", "target_planning", "compatibility_preflight", "authorized_mutation")


class ProviderError(ValueError):
    """A provider or a choice of providers that cannot be used."""


class Provider(NamedTuple):
    """run(spark, path, namespace, **options) gives what a source holds."""

    name: str
    capabilities: frozenset[str]
    run: Callable[..., Mapped]


class Job(NamedTuple):
    provider: str
    path: str
    namespace: str
    options: dict[str, object] = {}


class Registry:
    def __init__(self, providers: Iterable[Provider] = ()):
        self.providers: dict[str, Provider] = {}
        for p in providers:
            self.add(p)

    def add(self, provider: Provider) -> None:
        if provider.name in self.providers:
            raise ProviderError(f"there are two providers named {provider.name}")
        if unknown := sorted(provider.capabilities - set(CAPABILITIES)):
            raise ProviderError(f"{provider.name} states unknown capabilities: {', '.join(unknown)}")
        self.providers[provider.name] = provider

    def get(self, name: str) -> Provider:
        if name not in self.providers:
            raise ProviderError(f"no provider is named {name}")
        return self.providers[name]

    def with_capability(self, capability: str) -> list[Provider]:
        return [p for _, p in sorted(self.providers.items()) if capability in p.capabilities]

    def only(self, capability: str) -> Provider:
        """The one provider that can do this; none or several are an error."""
        found = self.with_capability(capability)
        if len(found) != 1:
            raise ProviderError(f"{len(found)} providers have the capability {capability}")
        return found[0]


#: The group of entry points that installed packages name their providers in.
GROUP = "metaloom.providers"


def discover(registry: Registry, found: Iterable[EntryPoint] | None = None) -> Registry:
    """A registry with what installed packages provide too. An entry point gives a Provider, or a function that does;
    two of a name, one that names its provider otherwise, and one that cannot be loaded are errors."""
    out = Registry(registry.providers.values())
    for point in sorted(entry_points(group=GROUP) if found is None else found, key=lambda p: (p.name, p.value)):
        try:
            made = point.load()
        except Exception as e:
            raise ProviderError(f"the provider {point.name} cannot be loaded") from e
        provider = made() if callable(made) and not isinstance(made, Provider) else made
        if not isinstance(provider, Provider) or provider.name != point.name:
            raise ProviderError(f"{point.name} gives no provider of that name")
        out.add(provider)
    return out


_GRAPH = frozenset({"governance_graph", "property_observations"})


def builtin() -> Registry:
    return Registry(
        [
            Provider("dbt", _GRAPH, lambda spark, path, namespace, **o: dbt.map_manifests(dbt.read_manifests(spark, path), namespace, **o)),
            Provider("odcs", _GRAPH, lambda spark, path, namespace, **o: odcs.map_contracts(odcs.read_contracts(spark, path), namespace, **o)),
            Provider("openlineage", _GRAPH | {"lineage"}, lambda spark, path, namespace, **o: openlineage.map_events(openlineage.read_events(spark, path), namespace, **o)),
        ]
    )


def run(spark: SparkSession, jobs: Iterable[Job], registry: Registry | None = None) -> Mapped:
    """All jobs as one: merged nodes and edges, normalized observations, and problems with the job's provider and path.

    The order of jobs does not matter. Nodes that providers describe differently are problems of the merged graph.
    """
    known = registry or builtin()
    parts: list[tuple[Job, Mapped]] = [(job, known.get(job.provider).run(spark, job.path, job.namespace, **job.options)) for job in sorted(jobs, key=lambda j: (j.provider, j.path))]
    if not parts:
        raise ProviderError("there is no source to run")

    def every(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for df in frames[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out

    plain = lambda df: df.drop("n_payloads")
    merged = graph.union(*(graph.Graph(plain(m.nodes), plain(m.edges)) for _, m in parts))
    problems = every([m.problems.select(F.concat_ws(":", F.lit(j.provider), F.lit(j.path), "path").alias("path"), "message") for j, m in parts])
    conflicting = graph.problems(merged).select(F.col("key").alias("path"), F.col("code").alias("message"))
    return Mapped(merged.nodes, merged.edges, conflicts.merge(*(m.observations for _, m in parts)), problems.unionByName(conflicting))
