"""Document sources as formats of Spark: spark.read.format("metaloom_dbt" | "metaloom_odcs" | "metaloom_openlineage").

A folder's files are listed once and dealt to partitions by their size; each task reads its files and gives the flat rows
of functions/documents.py, so a document is parsed where it is read. The rows go to the mapping functions in place of
documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import documents
from ..functions.canonical import dumps, loads
from . import dbt, odcs, openlineage, review

#: Bytes of files in a partition; a larger file is a partition of its own.
PARTITION_BYTES = 32 << 20
#: Documents that are flattened at a time.
BATCH = 64


class Format(NamedTuple):
    suffixes: tuple[str, ...]
    rules: dict[str, documents.Rule]
    root: str
    #: Whether a file may hold an array of documents.
    many: bool = False


FORMATS = {
    "metaloom_dbt": Format((".json",), dbt.RULES, "manifest"),
    "metaloom_odcs": Format((".yaml", ".yml", ".json"), odcs.RULES, "contract"),
    "metaloom_openlineage": Format((".json",), openlineage.RULES, "event", True),
    "metaloom_review": Format((".json",), review.RULES, "review"),
}


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def _listed(uri: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The files of a folder and those below it (or the one file), without hidden ones."""
    files, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    one = files.get_file_info(path)
    if one.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    every = [one] if one.type == fs.FileType.File else files.get_file_info(fs.FileSelector(path, recursive=True))
    return files, sorted((f for f in every if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


class Reader(DataSourceReader):
    def __init__(self, name: str, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("a path is needed")
        self.name, self.uri, self.most = name, options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        # Options come with their names in any case.
        self.faults = options.get("faults", "false").lower() == "true"

    def partitions(self) -> list[Files]:
        _, found = _listed(self.uri)
        suffixes = FORMATS[self.name].suffixes
        if bad := [f.path for f in found if not f.path.lower().endswith(suffixes)]:
            raise ValueError(f"unsupported file: {bad[0]}")
        out, held = [], 0
        for f in found:
            if not out or held + f.size > self.most:
                out.append([])
                held = 0
            out[-1].append(f.path)
            held += f.size
        return [Files(paths) for paths in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kind = FORMATS[self.name]
        yield from documents.flat(self._batches(partition.paths, kind), kind.rules, kind.root, self.faults)

    def _batches(self, paths: list[str], kind: Format) -> Iterator[pa.RecordBatch]:
        files = fs.FileSystem.from_uri(self.uri)[0] if "://" in self.uri or self.uri.startswith("file:") else fs.LocalFileSystem()
        held: list[tuple[str, str]] = []
        for path in paths:
            with files.open_input_stream(path) as f:
                raw = f.read().decode()
            for text in self._documents(path, raw, kind):
                held.append((hashlib.sha256(text.encode()).hexdigest(), text))
                if len(held) == BATCH:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    def _documents(self, path: str, raw: str, kind: Format) -> Iterator[str]:
        if kind.many:
            value = loads(raw)
            yield from (dumps(v) for v in (value if isinstance(value, list) else [value]))
        elif path.lower().endswith((".yaml", ".yml")):
            import yaml

            yield dumps(yaml.safe_load(raw))
        elif kind.root == "contract":
            yield dumps(json.loads(raw))
        else:
            yield raw


def _batch(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["doc", "text"])


class _Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return cls.format_name

    def schema(self) -> str:
        return documents.ROW

    def reader(self, schema) -> Reader:
        return Reader(self.format_name, dict(self.options))


class Dbt(_Documents):
    format_name = "metaloom_dbt"


class Odcs(_Documents):
    format_name = "metaloom_odcs"


class OpenLineage(_Documents):
    format_name = "metaloom_openlineage"


class Review(_Documents):
    format_name = "metaloom_review"


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    for source in (Dbt, Odcs, OpenLineage, Review):
        spark.dataSource.register(source)
