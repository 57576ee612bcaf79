"""Spark formats of our own: `captures`, fetched responses by splits, and `cookies`, a jar's files with commit and abort.

    register(spark)
    spark.read.format("captures").schema("url string, status int").load("/shared/run-7/*.jsonl")
    jar.write.format("cookies").mode("append").option("now", 1700000000).save("/shared/jar")

Both read and write through the executors' file system, so paths must lie where driver and executors share them; inputs in
a store that only Spark reads come in by Spark's own formats instead.
"""

from __future__ import annotations

import base64
import glob
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CAPTURE = "url string, status int, headers map<string,string>, body binary, redirected_from array<string>"
COOKIE = "name string, value string, domain string, path string, secure boolean, http_only boolean, same_site string, expires bigint"
#: Bytes of a split, and rows of a batch.
SPLIT, BATCH = 64 << 20, 1024


@dataclass
class Split(InputPartition):
    """The lines of a file that start at or behind one place and before another."""

    path: str
    start: int
    stop: int

    def lines(self) -> Iterator[bytes]:
        with open(self.path, "rb") as f:
            if self.start:
                f.seek(self.start - 1)
                f.readline()  # the line that starts in the split before, or its line feed
            while f.tell() < self.stop:
                line = f.readline()
                if not line:
                    return
                if line.strip():
                    yield line


class _Lines(DataSourceReader):
    """Reads JSON lines; only the fields of the schema that the user chose are made."""

    def __init__(self, schema: StructType, paths: list[str], split: int, folder: str | None = None) -> None:
        self.schema, self.paths, self.split, self.folder = schema, paths, split, folder

    def partitions(self) -> list[Split]:
        sizes = [(p, os.path.getsize(p)) for p in self.paths]
        return [Split(p, a, min(a + self.split, n)) for p, n in sizes for a in range(0, n, self.split)] or [Split(os.devnull, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        make = {f.name: (base64.b64decode if pa.types.is_binary(f.type) else list if pa.types.is_map(f.type) else None) for f in schema}
        held: list[dict] = []

        def batch() -> pa.RecordBatch:
            columns = []
            for f in schema:
                values = [r.get(f.name) for r in held]
                if pa.types.is_map(f.type):
                    values = [None if v is None else list(v.items()) for v in values]
                elif make[f.name]:
                    values = [None if v is None else make[f.name](v) for v in values]
                columns.append(pa.array(values, f.type))
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for line in partition.lines():
            held.append(json.loads(line))
            if len(held) == BATCH:
                yield batch()
                held = []
        yield batch()


class Captures(DataSource):
    """Fetched responses as JSON lines, the body in base64. Options: path (a file, folder or pattern), split (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return CAPTURE

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options["path"]
        found = sorted(glob.glob(os.path.join(path, "*") if os.path.isdir(path) else path))
        if not found:
            raise FileNotFoundError(path)
        return _Lines(schema, [p for p in found if os.path.isfile(p)], int(self.options.get("split", SPLIT)))


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote: its file, none without rows, and how many cookies."""

    path: str | None
    count: int


class _JarWriter(DataSourceWriter):
    """Tasks write parts beside the jar; commit moves them in and names them in a manifest, in one rename; abort removes them."""

    def __init__(self, schema: StructType, folder: str, overwrite: bool, now: int | None) -> None:
        self.names, self.folder, self.overwrite, self.now = schema.names, folder, overwrite, now
        self.job = uuid.uuid4().hex
        self.staging = os.path.join(folder, f"_staging-{self.job}")
        os.makedirs(self.staging)  # by the driver alone: a task that outlives an abort finds no folder and leaves nothing

    def write(self, iterator: Iterator[Row]) -> Part:
        path, count = os.path.join(self.staging, f"{uuid.uuid4().hex}.jsonl"), 0
        out = None
        for row in iterator:
            cookie = dict(zip(self.names, row, strict=True))
            if self.now is not None and cookie.get("expires") is not None and cookie["expires"] <= self.now:
                continue
            if out is None:
                out = open(path, "w")  # noqa: SIM115
            out.write(json.dumps(cookie) + "\n")
            count += 1
        if out is not None:
            out.close()
        return Part(path if count else None, count)

    def commit(self, messages: list[Part | None]) -> None:
        os.makedirs(self.folder, exist_ok=True)
        held = {"parts": [], "count": 0} if self.overwrite else manifest(self.folder)
        old = [] if not self.overwrite else manifest(self.folder)["parts"]
        for m in messages:
            if m is not None and m.path:
                name = f"part-{os.path.basename(m.path)}"
                os.rename(m.path, os.path.join(self.folder, name))
                held["parts"].append(name)
                held["count"] += m.count
        fresh = os.path.join(self.folder, f"_manifest-{self.job}")
        with open(fresh, "w") as f:
            json.dump(held, f)
        os.replace(fresh, os.path.join(self.folder, "_manifest"))
        shutil.rmtree(self.staging, ignore_errors=True)
        for name in old:
            os.remove(os.path.join(self.folder, name))

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def manifest(folder: str) -> dict:
    """The files that a jar is made of, in order of writing, and how many cookies they hold."""
    try:
        with open(os.path.join(folder, "_manifest")) as f:
            return json.load(f)
    except FileNotFoundError:
        return {"parts": [], "count": 0}


class Cookies(DataSource):
    """A jar as JSON lines in parts named by a manifest. Options: path (a folder), now (expired cookies are not saved).

    Appended cookies stand behind earlier ones of the same name; cookies.bulk_load merges them when they are loaded."""

    @classmethod
    def name(cls) -> str:
        return "cookies"

    def schema(self) -> str:
        return COOKIE

    def reader(self, schema: StructType) -> DataSourceReader:
        folder = self.options["path"]
        return _Lines(schema, [os.path.join(folder, p) for p in manifest(folder)["parts"]], SPLIT, folder)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        now = self.options.get("now")
        return _JarWriter(schema, self.options["path"], overwrite, None if now is None else int(now))


def register(spark: SparkSession) -> None:
    for source in (Captures, Cookies):
        spark.dataSource.register(source)
