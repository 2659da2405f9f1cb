"""A version of a store laid out for its join: listing and details in Spark's own buckets of the id, so that no query over both shuffles them.

A layout costs one exchange of each table and is worth it for a version that many queries read, such as a pinned one.  The buckets'
files lie in the store, beside a small file that says where and how many they are and that is written last and whole: a layout that
failed has none and is as if it had never been.  Tables of the session's catalogue are made from that file, so another session, or
one whose catalogue forgets, reads the same buckets.

A bucket is read by one task, which sorts it as it needs; so there is one for ``BUCKET_ROWS`` listing rows, a power of two up to
``MOST_BUCKETS``.  Rows without an id have no detail; an empty table is laid out as well.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .catalogue import joined
from .tables import Store

TABLES, KEY = ("videos", "details"), "video_id"
BUCKET_ROWS, MOST_BUCKETS = 250_000, 1 << 15


def _spec(store: Store, version: int) -> dict | None:
    return store._read(f"layouts/{version}") if version in store._numbers("layouts") else None


def lay_out(store: Store, version: int | None = None, bucket_rows: int = BUCKET_ROWS) -> int:
    """Writes the buckets of a version, unless it has some, and gives their number; of two writers the first counts."""
    version = store.version() if version is None else version
    if spec := _spec(store, version):
        return spec["buckets"]
    tables, count = store.read_all(version), 1
    rows = tables["videos"].count()
    while count * bucket_rows < rows and count < MOST_BUCKETS:
        count *= 2
    at, mark = {}, uuid.uuid4().hex
    for name in TABLES:
        at[name] = f"{store.path}/data/{mark}/{name}"
        written = f"layout_{mark}_{name}"
        # dealt as the buckets are, so each is one file
        tables[name].repartition(count, KEY).write.bucketBy(count, KEY).sortBy(KEY).option("path", at[name]).saveAsTable(written)
        store.spark.sql(f"DROP TABLE {written}")  # the files stay
    schemas = {name: json.loads(tables[name].schema.json()) for name in TABLES}
    if not store._publish(f"layouts/{version}", {"buckets": count, "at": at, "schemas": schemas}):
        return _spec(store, version)["buckets"]
    return count


def table(store: Store, name: str, version: int | None = None) -> DataFrame:
    """A laid out table; Spark knows that its rows are dealt by id."""
    version = store.version() if version is None else version
    spec = _spec(store, version)
    if spec is None:
        raise ValueError(f"version {version} isn't laid out")
    path = spec["at"][name]
    known = f"layout_{path.split('/')[-2]}_{name}"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(spec["schemas"][name]))
    store.spark.sql(f"CREATE TABLE IF NOT EXISTS {known} ({fields}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {spec['buckets']} BUCKETS LOCATION '{path}'")
    return store.spark.table(known)


def stored(store: Store, version: int | None = None) -> DataFrame:
    """The catalogue of a version that is laid out, joined bucket by bucket."""
    videos, details = (table(store, name, version) for name in TABLES)
    return joined(videos, details.hint("merge"))


def forget(store: Store, version: int) -> None:
    """Takes a layout away; its files go when the store is cleaned."""
    spec = _spec(store, version)
    for name in TABLES if spec else ():
        store.spark.sql(f"DROP TABLE IF EXISTS layout_{spec['at'][name].split('/')[-2]}_{name}")
    if spec:
        store._fs.delete(store._path(f"{store.path}/layouts/{version}"), False)
