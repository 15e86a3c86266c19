"""Dataset names, partition specs and keys as text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.time import GRAINS

# Spellings of grains and of storage schemes.
GRAIN_NAMES = {"hour": "hour", "hourly": "hour", "h": "hour", "day": "day", "daily": "day", "date": "day", "d": "day", "month": "month", "monthly": "month", "m": "month", "year": "year", "yearly": "year", "annual": "year", "y": "year"}
SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfs": "abfss", "wasb": "abfss", "wasbs": "abfss"}
# How systems fold names that are not quoted (the others keep them), and an account's host.
FOLDED = {"snowflake": "upper", "databricks": "lower", "hive": "lower", "trino": "lower", "postgres": "lower", "redshift": "lower", "duckdb": "lower", "clickhouse": None, "bigquery": None}
AZURE_HOST = r"(?i)^([^.]+)\.(?:dfs|blob)\.core\.windows\.net$"
ANY = "*"


@dataclass(frozen=True)
class Field:
    name: str
    grain: str | None = None  # None: a value field

    @classmethod
    def parse(cls, text: str) -> Field:
        name, _, grain = (x.strip() for x in text.partition(":"))
        if not name:
            raise ValueError(f"a field without a name: {text!r}")
        if grain and grain.lower() not in GRAIN_NAMES:
            raise ValueError(f"no grain {grain!r}; there are {', '.join(GRAINS)}")
        return cls(name, GRAIN_NAMES[grain.lower()] if grain else None)

    def __str__(self) -> str:
        return f"{self.name}:{self.grain}" if self.grain else self.name


def parse_spec(text: str) -> tuple[Field, ...]:
    """`dt:day, region`; no fields mean one unit."""
    fields = tuple(Field.parse(x) for x in text.split(",") if x.strip())
    if len({f.name for f in fields}) != len(fields):
        raise ValueError(f"a field twice: {text!r}")
    return fields


def parse_key(text: str, spec: tuple[Field, ...]) -> dict[str, object]:
    """`dt=2026-03-14,region=eu`: times are cut to their grain, `*` and absent fields are any value."""
    by = {f.name: f for f in spec}
    out: dict[str, object] = {}
    for part in filter(None, (x.strip() for x in text.split(","))):
        name, eq, value = part.partition("=")
        if not eq or name not in by:
            raise ValueError(f"no field {name!r} in {', '.join(map(str, spec)) or 'an unpartitioned table'}")
        if value == ANY:
            continue
        if by[name].grain is None:
            out[name] = value
            continue
        t = datetime.fromisoformat(value)
        if t.tzinfo:
            t = (t - t.utcoffset()).replace(tzinfo=None)
        cut = {"month": 1, "day": 1, "hour": 0, "minute": 0, "second": 0, "microsecond": 0}
        finer = {"hour": ("minute", "second", "microsecond"), "day": ("hour", "minute", "second", "microsecond"), "month": ("day", "hour", "minute", "second", "microsecond"), "year": tuple(cut)}
        out[name] = t.replace(**{k: cut[k] for k in finer[by[name].grain]})
    return out


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "^/|/$", "")


def canonical_path(uri: Column, mounts: dict[str, str] | None = None) -> Column:
    """struct<namespace, name> of a storage location: scheme aliases and mounts resolved, hosts in lower case, doubled and outer slashes gone.

    Of nested mounts the longest counts. An account's two host names are one, and
    a location without a host is a local file.
    """
    given = F.trim(uri)
    inner = F.regexp_replace(given, "^(?:dbfs:|/dbfs(?=/))", "")
    raw = given
    if mounts:
        path = F.concat(F.lit("/"), _clean(inner))
        ends = sorted({"/" + m.strip("/"): t.rstrip("/") for m, t in mounts.items()}.items(), key=lambda x: -len(x[0]))
        held = F.array(*[F.struct(F.lit(m).alias("mount"), F.lit(t).alias("target")) for m, t in ends])
        # One pass over a constant, longest first; the expression is the same size for any number of mounts.
        hit = F.get(F.filter(held, lambda x: (path == x["mount"]) | F.startswith(path, F.concat(x["mount"], F.lit("/")))), 0)
        raw = F.when((inner != given) & hit.isNotNull(), F.concat(hit["target"], F.substr(path, F.length(hit["mount"]) + 1))).otherwise(given)
    part = lambda i: F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)", i)
    scheme, host, path = F.lower(part(1)), part(2), part(3)
    named = scheme
    for alias, name in SCHEMES.items():
        named = F.when(scheme == alias, F.lit(name)).otherwise(named)
    server = F.regexp_extract(host, "([^@]*)$", 1)
    account = F.when(server.rlike(AZURE_HOST), F.regexp_extract(server, AZURE_HOST, 1)).otherwise(server)
    azure = F.concat(F.regexp_extract(host, "^(.*@)?[^@]*$", 1), account)
    local = (scheme.isin("", "file")) | (host == "")
    bare = F.when(scheme == "", F.regexp_replace(raw, "^[A-Za-z][A-Za-z0-9+.-]*:", "")).otherwise(path)
    namespace = F.concat(F.when(named == "webhdfs", F.lit("hdfs")).otherwise(named), F.lit("://"), F.lower(F.when(named == "abfss", azure).otherwise(host)))
    return F.struct(F.when(local, F.lit("file")).otherwise(namespace).alias("namespace"), F.when(local, F.concat(F.lit("/"), _clean(bare))).otherwise(_clean(path)).alias("name"))


def canonical_table(name: Column, system: str, instance: str | None = None, database: str | None = None, schema: str | None = None) -> Column:
    """struct<namespace, name> of a catalog's table: quoted parts as they are, others folded as the system does, missing ones from the defaults."""
    fold = {"upper": F.upper, "lower": F.lower, None: lambda x: x}[FOLDED.get(system.lower())]
    quoted = lambda x: x.rlike('^["`\\[]')
    parts = F.transform(F.regexp_extract_all(F.trim(name), F.lit(r'"[^"]*"|`[^`]*`|\[[^\]]*\]|[^.]+'), F.lit(0)), lambda x: F.when(quoted(x), F.regexp_replace(x, '^["`\\[]|["`\\]]$', "")).otherwise(fold(x)))
    base = [fold(F.lit(x)) for x in (database, schema) if x]
    both = F.concat(F.array(*base), parts) if base else parts
    one = F.concat(F.array(fold(F.lit(database))), parts) if database else parts
    full = F.when(F.size(parts) == 1, both).when(F.size(parts) == 2, one).otherwise(parts)
    return F.struct(F.lit(f"{system.lower()}://{instance}" if instance else system.lower()).alias("namespace"), F.array_join(full, ".").alias("name"))


def canonical(uri: Column) -> Column:
    """A location's canonical name as one text."""
    x = canonical_path(uri)
    return F.when(x["namespace"] == "file", x["name"]).otherwise(F.concat_ws("/", x["namespace"], x["name"]))


def asset(kind: str, name: str, instance: str = "local") -> str:
    """The URI of a model, prompt, index or other asset."""
    if not re.fullmatch(r"[a-z][a-z_]*", kind):
        raise ValueError(f"not a kind: {kind!r}")
    return f"{kind.replace('_', '-')}://{instance.lower()}/{name}"


def parse_ref(text: str) -> tuple[str, str | None]:
    """(asset, version) of `model://r/name@v`."""
    head, at, version = text.rpartition("@")
    return (head, version) if at and "/" not in version else (text, None)
