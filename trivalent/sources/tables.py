"""Versioned tables: a commit writes what it changes into a new directory and then one pointer that names all files of a state.

Readers resolve the pointer once, so they see one state; a commit that fails leaves the pointer where it was.  A pointer is written
under another name first and then given its own in one step that never replaces a file, so nobody reads half of one and of two writers
of a version one is told.  Paths are Hadoop paths, so the store can be anything that Spark writes to.

Tables with a key (``KEYS``) lie in hash buckets of it, a directory each.  A *change* reads and rewrites the buckets of the keys that it
is given; an *append* adds a directory to a table.  So a commit costs what it touches.  A table has a power of two of buckets, up to
``MOST_BUCKETS``, of ``BUCKET_ROWS`` rows each; beyond ``EVEN`` buckets their rows grow as their number does, so that neither a table
is ever more directories of few rows nor a change of few keys rewrites most of it.  It is laid out anew when it has outgrown them
four times; a change that may do that is written as its rows come and then dealt to the new buckets, not to the old few ones first.

A commit names the version that it was made from.  If others came between, it is refused, unless it may be rebased and none of them
touched a bucket of what it wrote: then it lands on the newest.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Collection, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns by which tables of these names are laid out.
KEYS = {"videos": "video_id", "details": "video_id", "pages": "page_number"}
BUCKET_ROWS, EVEN, GROWTH, MOST_BUCKETS = 2000, 64, 4, 1 << 14
_BUCKET = "_bucket"

#: A change of a table: its keys (a column of the key's name), and the next rows of the touched buckets made from the old ones.
Change = tuple[DataFrame, Callable[[DataFrame], DataFrame]]


class Overtaken(RuntimeError):
    """Another writer changed what a commit was made from."""


def bucket(key: str, count: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(count)).cast("int")


def capacity(count: int) -> int:
    """Rows that so many buckets are made for."""
    return BUCKET_ROWS * count * max(1, count // EVEN)


def buckets_for(rows: int) -> int:
    count = 1
    while capacity(count) < rows and count < MOST_BUCKETS:
        count *= 2
    return count


class Store:
    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str] | None = None):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), KEYS if keys is None else keys
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    # pointers

    def _numbers(self, folder: str) -> list[int]:
        at = self._path(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        return max(self._numbers("versions"), default=0)

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, name: str, content: dict) -> bool:
        """Writes a small file whole, or not at all if there is one of that name."""
        target, draft = self._path(f"{self.path}/{name}"), self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":  # a rename would replace there; a second name for a file is refused if it is taken
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
                options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
                context.rename(draft, target, options)
            return True
        except FileExistsError:
            return False
        except Exception:
            if self._fs.exists(target):
                return False
            raise
        finally:
            self._fs.delete(draft, False)

    @contextmanager
    def draft(self) -> Iterator[str]:
        """A folder for rows that no version names; it goes at the end, or when the store is cleaned."""
        path = f"{self.path}/drafts/{uuid.uuid4().hex}"
        try:
            yield path
        finally:
            self._fs.delete(self._path(path), True)

    # reading

    def state(self, version: int | None = None) -> dict:
        """tables (name: schema, key, count of buckets, rows, directory of each bucket), meta, and what the version touched."""
        v = self.version() if version is None else version
        return self._read(f"versions/{v}") if v else {"tables": {}, "meta": {}, "touched": {}}

    def _frame(self, table: dict, only: Collection[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        paths = [p for b, p in table["at"].items() if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._frame(self.state(version)["tables"][name])

    def read_all(self, version: int | None = None) -> dict[str, DataFrame]:
        return {n: self._frame(t) for n, t in self.state(version)["tables"].items()}

    def lookup(self, name: str, value, version: int | None = None) -> DataFrame:
        """The rows of one key, from its bucket alone."""
        table = self.state(version)["tables"][name]
        kind = StructType.fromJson(table["schema"])[table["key"]].dataType
        key = self.spark.range(1).select(F.lit(value).cast(kind).alias(table["key"]))
        return self._frame(table, self._touched(table, key)).where(F.col(table["key"]) == F.lit(value).cast(kind))

    @classmethod
    def _touched(cls, table: dict, keys: DataFrame) -> list[str]:
        """The buckets of keys; at most as many as there are."""
        return list(cls._sizes(table, keys))

    @staticmethod
    def _sizes(table: dict, keys: DataFrame) -> dict[str, int]:
        """How many of some rows each bucket gets."""
        kind = StructType.fromJson(table["schema"])[table["key"]].dataType
        own = keys.select(F.col(table["key"]).cast(kind).alias(table["key"])).select(bucket(table["key"], table["count"]).alias("b"))
        return {str(r["b"]): r["n"] for r in own.groupBy("b").agg(F.count("*").alias("n")).collect()}

    # writing

    def _leaves(self, path: str) -> dict[str, str]:
        statuses = self._fs.listStatus(self._path(path))
        names = [s.getPath().getName() for s in statuses]
        return {n.split("=")[1]: f"{path}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}

    @staticmethod
    def _laid_out(df: DataFrame, key: str, count: int, path: str) -> None:
        rows = df.withColumn(_BUCKET, bucket(key, count))
        rows.repartition(_BUCKET).sortWithinPartitions(_BUCKET, key).write.partitionBy(_BUCKET).parquet(path)

    def _whole(self, name: str, df: DataFrame, path: str) -> dict:
        """The entry of a table that is written anew; one of few rows is one directory."""
        key = self.keys.get(name) if self.keys.get(name) in df.columns else None
        df.write.parquet(path)
        out = {"schema": json.loads(df.schema.json()), "key": key, "count": 1, "at": {"0": path}}
        if key is None:
            return out
        rows = self.spark.read.schema(df.schema).parquet(path)
        out["rows"] = rows.count()
        if (count := buckets_for(out["rows"])) > 1:
            self._laid_out(rows, key, count, f"{path}-buckets")
            out |= {"count": count, "at": self._leaves(f"{path}-buckets")}
        return out

    def _changed(self, table: dict, change: Change, path: str) -> tuple[dict, list[str] | None]:
        """The entry of a table with some buckets rewritten, and these buckets; none where all were, for it has outgrown them."""
        keys, make = change
        key, most = table["key"], GROWTH * capacity(table["count"])
        touched = self._sizes(table, keys)
        old = self._frame(table, touched)
        schema = StructType.fromJson(table["schema"])
        rows = make(old).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        stays = table.get("rows", 0) - old.count()
        if table.get("rows", 0) + sum(touched.values()) > most and table["count"] < MOST_BUCKETS:
            rows.write.parquet(f"{path}-rows")
            rows = self.spark.read.schema(schema).parquet(f"{path}-rows")
            made = self._sizes(table, rows)
            self._named(made, touched)
            if (n := stays + sum(made.values())) > most:
                rest = self._frame(table, table["at"].keys() - touched.keys())
                self._laid_out(rest.unionByName(rows), key, buckets_for(n), f"{path}-grown")
                return {**table, "count": buckets_for(n), "at": self._leaves(f"{path}-grown"), "rows": n}, None
        self._laid_out(rows, key, table["count"], path)
        leaves = self._leaves(path)
        self._named(leaves, touched)
        new = self.spark.read.schema(schema).parquet(*leaves.values()).count() if leaves else 0
        at = {b: p for b, p in table["at"].items() if b not in touched} | leaves
        return {**table, "at": at, "rows": stays + new}, list(touched)

    @staticmethod
    def _named(made: Collection[str], touched: Collection[str]) -> None:
        if set(made) - set(touched):
            raise ValueError("a change made rows of keys that it didn't name")

    def commit(self, tables: dict[str, DataFrame] | None = None, meta: dict | None = None, expected: int | None = None, changes: dict[str, Change] | None = None, appends: dict[str, DataFrame] | None = None, rebase: bool = False) -> int:
        """The new version.  tables are replaced, those of ``changes`` in the buckets of their keys only; what is not named stays.

        With ``expected``, a version that came between is refused; with ``rebase`` too, only one that touched the same buckets.
        """
        base = self.version()
        if expected is not None and base != expected and not rebase:
            raise Overtaken(f"version {base} was written since {expected}")
        made_from = base if expected is None else expected
        old = self.state(made_from)["tables"]
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        entries: dict[str, dict] = {}
        touched: dict[str, list[str] | None] = {}
        for name, df in (tables or {}).items():
            entries[name], touched[name] = self._whole(name, df, f"{data}/{name}"), None
        for name, change in (changes or {}).items():
            if old[name]["key"] is None:
                raise ValueError(f"{name} has no key")
            entries[name], touched[name] = self._changed(old[name], change, f"{data}/{name}")
            if touched[name] is not None and entries[name]["rows"] > GROWTH * capacity(old[name]["count"]) and old[name]["count"] < MOST_BUCKETS:
                entries[name], touched[name] = self._whole(name, self._frame(entries[name]), f"{data}/{name}-grown"), None
        for name, df in (appends or {}).items():
            df.write.parquet(f"{data}/{name}")
            entries[name], touched[name] = {"schema": json.loads(df.schema.json()), "key": None, "count": 1, "at": {uuid.uuid4().hex: f"{data}/{name}"}}, []
        while True:
            now = self.version()
            if now != made_from and (expected is not None or rebase or changes):
                self._unconflicted(touched, made_from, now)
            state = self.state(now)
            merged = {**state["tables"], **{n: self._onto(state["tables"].get(n), e, touched[n]) for n, e in entries.items()}}
            if self._publish(f"versions/{now + 1}", {"tables": merged, "meta": {**state["meta"], **(meta or {})}, "touched": touched}):
                return now + 1
            if expected is not None and not rebase:
                raise Overtaken(f"version {now + 1} was written since {expected}")

    @staticmethod
    def _onto(current: dict | None, entry: dict, touched: list[str] | None) -> dict:
        """The entry of a table over what the newest version has of it."""
        if touched is None or current is None:
            return entry
        if entry["key"] is None:  # an append
            return {**current, "at": {**current["at"], **entry["at"]}}
        at = {b: p for b, p in current["at"].items() if b not in touched}
        return {**entry, "at": at | {b: p for b, p in entry["at"].items() if b in touched}}

    def _unconflicted(self, touched: dict[str, list[str] | None], since: int, now: int) -> None:
        """Refuses what a version between has touched as well; appends conflict with whole tables only."""
        for v in range(since + 1, now + 1):
            for name, theirs in self.state(v)["touched"].items():
                if name in touched and (theirs is None or touched[name] is None or set(theirs) & set(touched[name])):
                    raise Overtaken(f"version {v} was written since {since}")

    def restore(self, version: int, expected: int | None = None) -> int:
        """A new version with the state of an old one; with ``expected``, a version that came between is refused."""
        state, now = self.state(version), self.version()
        if expected is not None and now != expected:
            raise Overtaken(f"version {now} was written since {expected}")
        touched = dict.fromkeys({*state["tables"], *self.state(now)["tables"]})
        if not self._publish(f"versions/{now + 1}", {**state, "touched": touched}):
            raise Overtaken(f"version {now + 1} was written since {now}")
        return now + 1

    # retention

    def pin(self, name: str, version: int) -> None:
        """Keeps a version, as a baseline, until the name is unpinned; a name is pinned once."""
        if version not in self._numbers("versions"):
            raise ValueError(f"there is no version {version}")
        if not self._publish(f"pins/{name}", {"version": version}):
            raise ValueError(f"{name} is pinned")

    def unpin(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.path}/pins/{name}"), False)

    def pins(self) -> dict[str, int]:
        at = self._path(f"{self.path}/pins")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return {n: self._read(f"pins/{n}")["version"] for n in names if not n.startswith(".")}

    def clean(self, keep: int = 10, grace_ms: int = 86_400_000, now_ms: int | None = None) -> tuple[list[int], int]:
        """(versions removed, directories removed): all but the newest versions and pinned ones go with their layouts, then data that none of these names.

        What is younger than ``grace_ms`` stays, since a commit may be writing it.
        """
        now_ms = int(time.time() * 1000) if now_ms is None else now_ms
        versions = self._numbers("versions")
        kept = set(versions[-max(1, keep) :]) | set(self.pins().values())
        gone = [v for v in versions if v not in kept]
        for v in gone:
            self._fs.delete(self._path(f"{self.path}/versions/{v}"), False)
        laid_out = self._numbers("layouts")
        for v in set(laid_out) - kept:
            self._fs.delete(self._path(f"{self.path}/layouts/{v}"), False)
        prefix = f"{self.path}/data/"
        named: set[str] = set()  # data that is named, and all directories above it
        paths = {p for v in kept for t in self.state(v)["tables"].values() for p in t["at"].values()}
        paths |= {p for v in kept & set(laid_out) for p in self._read(f"layouts/{v}")["at"].values()}
        for path in paths:
            parts = path.removeprefix(prefix).split("/")
            named |= {"/".join(parts[:k]) for k in range(1, len(parts) + 1)}
        leaves = named - {n.rsplit("/", 1)[0] for n in named if "/" in n}
        return gone, self._swept("data", "", named, leaves, now_ms - grace_ms) + self._swept("drafts", "", set(), set(), now_ms - grace_ms)

    def _swept(self, folder: str, inner: str, named: set[str], leaves: set[str], until_ms: int) -> int:
        """Removes what isn't named in a folder and in named directories that aren't data themselves; how many directories."""
        at, removed = self._path(f"{self.path}/{folder}/{inner}" if inner else f"{self.path}/{folder}"), 0
        for s in self._fs.listStatus(at) if self._fs.exists(at) else []:
            name = f"{inner}/{s.getPath().getName()}" if inner else s.getPath().getName()
            if name in leaves:
                continue
            if name in named:
                removed += self._swept(folder, name, named, leaves, until_ms)
            elif s.getModificationTime() <= until_ms:
                self._fs.delete(s.getPath(), True)
                removed += s.isDirectory()
        return removed
