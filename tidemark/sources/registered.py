"""Sources by name: `spark.read.format("tidemark_listing")` and the like, after `register(spark)`.

Listings and Delta logs are read by executors: planning looks at one level of
folders, or at the names of a log's files, and each partition is a folder or a
commit. Filters on names, sizes, times and versions reach the sources called `_pruned`,
which do not open the folders and commits that these rule out.

As a stream, a listing's offset is a resume token: the newest time that was seen and the etags
at it, since times are coarse and more files of that time may follow. A batch is
what lies between two tokens, so a stream that is stopped anywhere and started again from its
checkpoint passes on each version of a file once. A file without a new time is not seen.

Folders are those that pyarrow's file systems reach (local, HDFS, object stores it is built with).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

LISTING = "path string, size bigint, modified timestamp, etag string, partition map<string,string>"
DELTA = "version bigint, action string, path string, values map<string,string>, change boolean"
SLACK = timedelta(milliseconds=1)
#: The filter of each kind, and whether a value meets it.
TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
    In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), IsNotNull: lambda x, _: x is not None,
}


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def _files(path: str, deep: bool) -> Iterator:
    from pyarrow import fs

    system, inner = _system(path)
    yield from system.get_file_info(fs.FileSelector(inner, recursive=deep, allow_not_found=True))


def _hidden(path: str, root: str) -> bool:
    return any(x.startswith((".", "_")) for x in path[len(root) :].split("/") if x)


def _value(f: Filter) -> object:
    return getattr(f, "value", None)


def _meets(row: dict, filters: Iterable[Filter]) -> bool:
    for f in filters:
        held = row
        for name in f.attribute:
            held = held.get(name) if isinstance(held, dict) else None
        if held is None or not TESTS[type(f)](held, _value(f)):
            return False
    return True


def _described(info, root: str) -> tuple[str, int, datetime, str, dict[str, str]]:
    """A file's row; its etag changes with its size and time."""
    at = info.mtime.astimezone(UTC) if info.mtime else None
    values = {k: unquote(v) for k, _, v in (x.partition("=") for x in info.path[len(root) :].split("/")[:-1]) if v}
    return info.path, info.size, at, f"{info.path}:{info.size}:{info.mtime_ns}", values


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


class ListingReader(DataSourceReader):
    """One partition for each folder under the root, and one for the root's own files."""

    def __init__(self, root: str, suffixes: tuple[str, ...]):
        self.root, self.suffixes, self.filters = root, suffixes, []

    def partitions(self) -> list[Folder]:
        base = _system(self.root)[1]
        prefixes = [_value(f) for f in self.filters if isinstance(f, StringStartsWith) and f.attribute == ("path",)]
        folders = [x.path for x in _files(self.root, False) if x.type.name == "Directory" and not _hidden(x.path, base)]
        kept = [p for p in sorted(folders) if all(p.startswith(x) or x.startswith(p + "/") for x in prefixes)]
        return [Folder(self.root, False), *(Folder(p, True) for p in kept)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        base = _system(self.root)[1]
        system = _system(self.root)[0]
        from pyarrow import fs

        for info in system.get_file_info(fs.FileSelector(_system(partition.path)[1], recursive=partition.deep, allow_not_found=True)):
            if info.type.name == "File" and info.path.endswith(self.suffixes) and not _hidden(info.path, base):
                row = _described(info, base)
                if _meets(dict(zip(("path", "size", "modified", "etag"), row, strict=False)), self.filters):
                    yield row


class PrunedListingReader(ListingReader):
    """Opens only folders that filters on paths leave, and gives only rows that meet them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute in (("path",), ("size",), ("etag",)):
                self.filters.append(f)
            else:
                yield f
                # Times lose their last digits on the way here: a looser test prunes, and Spark's own decides.
                if f.attribute == ("modified",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.filters.append(GreaterThanOrEqual(f.attribute, f.value - SLACK))
                elif f.attribute == ("modified",) and isinstance(f, LessThan | LessThanOrEqual):
                    self.filters.append(LessThanOrEqual(f.attribute, f.value + SLACK))


@dataclass
class Between(InputPartition):
    folder: Folder
    start: str
    end: str


class ListingStream(DataSourceStreamReader):
    """What came between two tokens; see the module's text."""

    def __init__(self, root: str, suffixes: tuple[str, ...]):
        self.reader = ListingReader(root, suffixes)

    def initialOffset(self) -> dict:
        return {"t": -1, "etags": []}

    def latestOffset(self) -> dict:
        newest, etags = -1, []
        for folder in self.reader.partitions():
            for row in self.reader.read(folder):
                t = _micros(row[2])
                if t > newest:
                    newest, etags = t, []
                if t == newest:
                    etags.append(row[3])
        return {"t": newest, "etags": sorted(etags)}

    def partitions(self, start: dict, end: dict) -> list[Between]:
        return [Between(f, json.dumps(start), json.dumps(end)) for f in self.reader.partitions()]

    def read(self, partition: Between) -> Iterator[tuple]:
        low, high = json.loads(partition.start), json.loads(partition.end)
        before, until = set(low["etags"]), set(high["etags"])
        for row in self.reader.read(partition.folder):
            t, etag = _micros(row[2]), row[3]
            after = t > low["t"] or (t == low["t"] and etag not in before)
            if after and (t < high["t"] or (t == high["t"] and etag in until)):
                yield row

    def commit(self, end: dict) -> None:
        pass


def _micros(at: datetime | None) -> int:
    return -1 if at is None else (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


class Listing(DataSource):
    """Data files below the folder in option `path`; option `suffixes` (comma-joined) says of what kind."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_listing"

    def schema(self) -> str:
        return LISTING

    def _suffixes(self) -> tuple[str, ...]:
        return tuple(self.options.get("suffixes", ".parquet,.pq").split(","))

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"].rstrip("/"), self._suffixes())

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(self.options["path"].rstrip("/"), self._suffixes())


@dataclass
class LogFile(InputPartition):
    path: str
    version: int


_COMMIT = re.compile(r"(\d{20})\.json")
_CHECKPOINT = re.compile(r"(\d{20})\.checkpoint(?:\.\d{10}\.(\d{10}))?\.parquet")


class DeltaReader(DataSourceReader):
    """One partition for each file of the newest whole checkpoint and each later commit; with a filter on versions past it, of those commits alone."""

    def __init__(self, table: str):
        self.table, self.filters = table, []

    def partitions(self) -> list[LogFile]:
        names = {x.path.rpartition("/")[2]: x.path for x in _files(f"{self.table}/_delta_log", False)}
        parts: dict[int, list[str]] = {}
        size: dict[int, int] = {}
        for name, path in names.items():
            if m := _CHECKPOINT.fullmatch(name):
                parts.setdefault(int(m[1]), []).append(path)
                size[int(m[1])] = int(m[2] or 1)
        whole = max((v for v, p in parts.items() if len(p) == size[v]), default=-1)
        commits = {int(m[1]): path for name, path in names.items() if (m := _COMMIT.fullmatch(name))}
        on = [f for f in self.filters if f.attribute == ("version",)]
        # Versions that are asked for are taken from their commits while these are all there.
        asked = {v for v in commits if _meets({"version": v}, on)}
        if on and asked and any(isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo | In) for f in on):
            return [LogFile(commits[v], v) for v in sorted(asked)]
        later = [LogFile(p, v) for v, p in sorted(commits.items()) if v > whole]
        return [*(LogFile(p, whole) for p in sorted(parts.get(whole, ()))), *later] or [LogFile("", -1)]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        if partition.path:
            for action, body in self._actions(partition.path):
                change = body.get("dataChange")
                row = {"version": partition.version, "action": action, "change": True if change is None else change}
                if _meets(row, self.filters):
                    values = body.get("partitionValues")
                    yield partition.version, action, body["path"], dict(values) if values is not None else None, row["change"]

    def _actions(self, path: str) -> Iterator[tuple[str, dict]]:
        import pyarrow.parquet as pq

        system = _system(self.table)[0]
        with system.open_input_file(path) as f:
            if path.endswith(".json"):
                for line in f.read().decode().splitlines():
                    held = json.loads(line)
                    yield from ((a, held[a]) for a in ("add", "remove") if held.get(a))
            else:
                log = pq.ParquetFile(f)
                names = [a for a in ("add", "remove") if a in log.schema_arrow.names]
                for batch in log.iter_batches(columns=names):
                    for row in batch.to_pylist(maps_as_pydicts="strict"):
                        yield from ((a, row[a]) for a in names if row[a] is not None)


class PrunedDeltaReader(DeltaReader):
    """Opens only commits that filters on versions leave."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute in (("version",), ("action",), ("change",)):
                self.filters.append(f)
            else:
                yield f


class DeltaLog(DataSource):
    """Add and remove actions of the Delta table in option `path`, as `delta.live_files` and its like take them."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_delta"

    def schema(self) -> str:
        return DELTA

    def reader(self, schema) -> DeltaReader:
        return DeltaReader(self.options["path"].rstrip("/"))


class PrunedListing(Listing):
    """The same, for one query: filters reach the source."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_listing_pruned"

    def reader(self, schema) -> ListingReader:
        return PrunedListingReader(self.options["path"].rstrip("/"), self._suffixes())


class PrunedDeltaLog(DeltaLog):
    """The same, for one query: filters reach the source."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_delta_pruned"

    def reader(self, schema) -> DeltaReader:
        return PrunedDeltaReader(self.options["path"].rstrip("/"))


SOURCES = (Listing, PrunedListing, DeltaLog, PrunedDeltaLog)


def register(spark: SparkSession) -> None:
    """Make the sources known by name.

    Spark keeps the filters that a query pushed with the table it was loaded as, so a DataFrame of a `_pruned`
    source serves one query and is loaded anew for another; those of the others may be used again.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in SOURCES:
        spark.dataSource.register(source)


def registered() -> list[str]:
    return sorted(s.name() for s in SOURCES)
