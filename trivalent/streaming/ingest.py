"""Ingest of listing pages and details: page by page, from a stream, resumable.

Staged pages are rows of a session, each append a file of its own; a commit is a new version of the store, so a batch that is tried
again after a lost driver makes the same rows once more and no others.  Pages and details rewrite the buckets of their ids only.  Every
commit names the version that it was made from; one that another writer overtook is refused, or, if they touched other buckets, made
onto the newer version, so nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merging, ordering
from ..sources.scratch import written
from ..sources.tables import Store


def commit_pages(store: Store, rows: DataFrame, session_id: str, now: int, meta: dict | None = None) -> int:
    """Upserts the video rows of complete pages and their manifests; pages with a card that has no identity are marked failed.

    The rows are written first: they are read for four tables, and parsing is done once.  So are the manifests, which are read thrice.
    """
    version = store.version()
    state, rows = store.read_all(version), written(rows, "rows")
    bad = rows.where("reason is not null").select("native_page").distinct()
    good = rows.join(bad, "native_page", "left_anti")
    like = state["videos"].schema
    listed = good.select(*(F.col(f.name) if f.name in good.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in like))
    manifest = good.groupBy(F.col("native_page").alias("page_number")).agg(F.transform(F.sort_array(F.collect_list(F.struct("native_order", "video_id"))), lambda x: x["video_id"]).alias("video_ids")).withColumn("status", F.lit("complete"))
    failed = bad.select(F.col("native_page").alias("page_number"), F.array().cast("array<string>").alias("video_ids"), F.lit("failed").alias("status"))
    fresh = manifest.unionByName(failed).withColumn("scanned_at", F.lit(now).cast("long")).withColumn("session_id", F.lit(session_id))
    fresh = written(fresh.select(*((F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in state["pages"].schema)), "manifests")
    changes = {
        "videos": (listed.where("video_id is not null"), lambda old: merging.upsert_listing(old, listed, now, "native_page", "native_order")),
        "pages": (fresh, lambda old: old.join(fresh.select("page_number"), "page_number", "left_anti").select(old.columns).unionByName(fresh)),
    }
    return store.commit(meta={"session": session_id, **(meta or {})}, expected=version, changes=changes, rebase=True)


def stage(store: Store, rows: DataFrame, session_id: str) -> int:
    """Adds ordered ids of a session to the stage."""
    own = rows.where("reason is null").select(F.lit(session_id).alias("session_id"), F.col("native_page").alias("page_number"), F.col("native_order").alias("position"), "video_id")
    return store.commit(appends={"stage": own}, expected=store.version())


def staged(store: Store, session_id: str) -> DataFrame:
    """pos, id of a session's staged rows in their order, first occurrences."""
    rows = store.read("stage").where(F.col("session_id") == session_id)
    first = rows.groupBy(F.col("video_id").alias("id")).agg(F.min(F.struct("page_number", "position", "video_id")).alias("key"))
    return ordering.numbered(first, "key").select(F.col("ord").alias("pos"), "id")


def clear_stage(store: Store, session_id: str) -> int:
    version = store.version()
    return store.commit({"stage": store.read("stage", version).where(F.col("session_id") != session_id)}, expected=version)


def finalize_rescan(store: Store, session_id: str, pages: int) -> int:
    """Keeps what the session's pages list; refused unless all pages 1 to n are complete in the session."""
    version = store.version()
    state = store.read_all(version)
    own = state["pages"].where((F.col("session_id") == session_id) & (F.col("status") == "complete"))
    if ordering.contiguous_prefix(own).first()["n"] < pages:
        raise RuntimeError("pages are missing")
    keep = own.select(F.explode("video_ids").alias("video_id")).distinct()
    return store.commit({"videos": merging.prune(state["videos"], keep), "details": merging.prune(state["details"], keep), "pages": own}, expected=version)


def recent_update(store: Store, rows: DataFrame, live_pages: int | None, native_total: int | None, page_size: int, now: int) -> tuple[int, bool]:
    """(version, whether rows were removed): the newest pages before the old order; rows go only if the whole feed was scanned."""
    version = store.version()
    state, rows = store.read_all(version), written(rows, "rows")
    scanned = ordering.numbered(rows.where("reason is null").groupBy(F.col("video_id").alias("id")).agg(F.min(F.struct("native_page", "native_order")).alias("key")), "key").select(F.col("ord").alias("pos"), "id")
    old = ordering.native_order(state["pages"], state["videos"]).select(F.col("ord").alias("pos"), F.col("video_id").alias("id"))
    n = rows.agg(F.count_distinct("native_page")).first()[0]
    order, full = ordering.recent_order(scanned, old, live_pages, n, native_total)
    return _reordered(store, version, state, rows, order, page_size, now), full


def _reordered(store: Store, version: int, state: dict[str, DataFrame], rows: DataFrame, order: DataFrame, page_size: int, now: int) -> int:
    """Commits an order of ids: scanned rows replace theirs, pages and places are made anew, what the order doesn't have goes."""
    videos = state["videos"]
    fresh = merging.first_per_key(rows.where("reason is null"), "video_id", "native_page", "native_order")
    fresh = fresh.select(*((F.col(c) if c in fresh.columns else F.lit(None)).cast(videos.schema[c].dataType).alias(c) for c in videos.columns))
    out = merging.reconcile(order, videos, fresh.join(order.select(F.col("id").alias("video_id")), "video_id", "left_semi").select(videos.columns), page_size, now)
    if out["missing"].limit(1).count():
        raise RuntimeError("the order has ids of which there is no row")
    pages = out["pages"].select(*((F.col(c) if c in out["pages"].columns else F.lit(None)).cast(state["pages"].schema[c].dataType).alias(c) for c in state["pages"].columns))
    kept = order.select(F.col("id").alias("video_id"))  # each has a row now, and no others have
    return store.commit({"videos": out["videos"], "pages": pages, "details": merging.prune(state["details"], kept)}, expected=version)


def smart_update(store: Store, rows: DataFrame, native_total: int | None, page_size: int, now: int, threshold: int = 3, reached_end: bool = False) -> tuple[int | None, str]:
    """(version or none, reason): scanned pages before the stored order, if a run of ids that both have shows that the rest is unchanged.

    The run must be of three ids and of ``threshold`` pages at least, and the totals must agree; otherwise nothing is committed.
    """
    version = store.version()
    state, rows = store.read_all(version), written(rows, "rows")
    scanned = ordering.numbered(rows.where("reason is null").groupBy(F.col("video_id").alias("id")).agg(F.min(F.struct("native_page", "native_order")).alias("key")), "key").select(F.col("ord").alias("pos"), "id")
    old = ordering.native_order(state["pages"], state["videos"]).select(F.col("ord").alias("pos"), F.col("video_id").alias("id"))
    order, reason = ordering.smart_order(scanned, old, max(3, threshold * page_size), native_total, reached_end)
    return (None if order is None else _reordered(store, version, state, rows, written(order, "order"), page_size, now)), reason


def stream_pages(source: DataFrame, store: Store, layout, session_id: str, observed_at: int, checkpoint: str):
    """A stream of (page_number, html) committed batch by batch; a batch that was committed is not committed again."""
    from ..sources.html import listing

    def each(batch: DataFrame, number: int) -> None:
        if store.state()["meta"].get(f"batch-{session_id}", -1) >= number:
            return
        rows = listing(batch, layout, observed_at)
        commit_pages(store, rows, session_id, observed_at, {f"batch-{session_id}": number})

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def commit_details(store: Store, fetched: DataFrame, now: int) -> int:
    """Details that were read replace their rows; failures are noted on the others."""
    version, fetched = store.version(), written(fetched, "fetched")
    failures = fetched.where("reason is not null").select("video_id", F.struct(F.col("reason").alias("code"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("int").alias("http_status")).alias("error"))

    def merged(old: DataFrame) -> DataFrame:
        done = merging.record_success(old, fetched.where("reason is null").drop("reason", "favorite"))
        return merging.record_failure(done, failures, now)

    return store.commit(expected=version, changes={"details": (fetched.select("video_id"), merged)}, rebase=True)


def clear_details(store: Store) -> int:
    version = store.version()
    return store.commit({"details": store.read("details", version).limit(0)}, expected=version)


def clear_all(store: Store) -> int:
    version = store.version()
    return store.commit({n: df.limit(0) for n, df in store.read_all(version).items()}, expected=version)


def update_due(last: int | None, now: int, hours: int, claimed_at: int | None = None, lease: int = 15 * 60_000) -> bool:
    """Whether a scheduled update may start: its interval is over and nobody holds a fresh claim."""
    held = claimed_at is not None and now - claimed_at < lease
    return not held and (last is None or now - last >= hours * 3_600_000)
