"""Merging: upserts, reconciliation, keyed merges, details, id sets, whole states.

Tables are replaced by new versions (see ``sources.tables``), so every merge is a plan from old and new rows to the
next table.  NULL in an incoming row means that nothing is said, so the older value stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.details import CURRENT_SCHEMA
from .ordering import repaginate

TIMES = ("last_attempt_at", "attempted_at", "fetched_at")


def first_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key; null keys go."""
    return _picked(rows, key, order, F.min_by)


def last_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return _picked(rows, key, order, F.max_by)


def _picked(rows: DataFrame, key: str, order: tuple[str, ...], pick) -> DataFrame:
    row = F.struct(*rows.columns)
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(pick(row, F.struct(*order)).alias("_row")).select("_row.*")


def upsert_listing(videos: DataFrame, incoming: DataFrame, now: int, *order: str) -> DataFrame:
    """The next videos: the last incoming row of an id replaces it all but first_seen_at."""
    new = last_per_key(incoming, "video_id", *order) if order else incoming
    old = videos.select("video_id", F.col("first_seen_at").alias("_first")).withColumn("_old", F.lit(True))
    keep = videos.join(new.select("video_id"), "video_id", "left_anti")
    stamped = {"first_seen_at": F.coalesce("_first", F.lit(now)), "last_seen_at": F.lit(now), "listing_updated_at": F.lit(now)}
    fresh = new.join(old, "video_id", "left")
    cols = [(stamped[c] if c in stamped else F.col(c) if c in new.columns else F.lit(None)).cast(videos.schema[c].dataType).alias(c) for c in videos.columns]
    return keep.unionByName(fresh.select(*cols))


def reconcile(order: DataFrame, videos: DataFrame, staged: DataFrame, page_size: int, now: int) -> dict[str, DataFrame]:
    """videos, pages and ``missing`` after an ordered update; order: pos, id.

    Ids of the order take their staged row or their old one; rows that the order doesn't have go.  ``missing`` has the
    ids that have neither: the commit must be refused unless it is empty.
    """
    merged = upsert_listing(videos, staged, now)
    at = repaginate(order, page_size)
    placed = at.withColumnRenamed("id", "video_id")
    kept = merged.drop("native_page", "native_order").join(placed.select("video_id", F.col("page").cast("int").alias("native_page"), F.col("place").cast("int").alias("native_order")), "video_id")
    pages = at.groupBy(F.col("page").cast("int").alias("page_number")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("video_ids"))
    return {"videos": kept.select(videos.columns), "pages": pages.withColumn("status", F.lit("complete")).withColumn("scanned_at", F.lit(now)), "missing": placed.select("video_id").join(merged, "video_id", "left_anti")}


def merge_by_key(current: DataFrame, incoming: DataFrame, key: str, newest: tuple[str, ...]) -> DataFrame:
    """One row a key: of two, the one with the later time over the other, column by column; equal times: incoming."""
    a, b = (df.where(F.col(key).isNotNull()).alias(n) for df, n in ((current, "a"), (incoming, "b")))
    time = lambda n: F.greatest(*(F.coalesce(f"{n}.{c}", F.lit(0).cast("long")) for c in newest), F.lit(0).cast("long"))
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    newer = time("b") >= time("a")
    value = lambda c: F.when(newer, F.coalesce(f"b.{c}", f"a.{c}")).otherwise(F.coalesce(f"a.{c}", f"b.{c}"))
    return both.select(*(F.coalesce(f"a.{key}", f"b.{key}").alias(key) if c == key else value(c).alias(c) for c in current.columns))


def last_attempt(n: str) -> Column:
    return F.greatest(*(F.coalesce(f"{n}.{c}", F.lit(0).cast("long")) for c in TIMES))


def merge_details(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One detail an id.

    Complete beats what is not, but keeps newer news of an attempt; of two complete ones the later fetched lies over the
    other; of two that are not, the later attempted one does.  failure_count is the larger.
    """
    a, b = current.where("video_id is not null").alias("a"), incoming.where("video_id is not null").alias("b")
    both = a.join(b, F.col("a.video_id") == F.col("b.video_id"), "full_outer")
    done = lambda n: F.coalesce(F.col(f"{n}.status") == "complete", F.lit(False))
    none = lambda n: F.col(f"{n}.video_id").isNull()
    fetched = lambda n: F.coalesce(f"{n}.fetched_at", F.lit(0).cast("long"))
    b_first = F.when(none("a"), True).when(none("b"), False).when(done("a") != done("b"), done("b")).when(done("a"), fetched("b") >= fetched("a")).otherwise(last_attempt("b") >= last_attempt("a"))
    overlay = ~none("a") & ~none("b") & (done("a") == done("b"))
    attempt = ("last_attempt_at", "last_attempt_error")
    b_later = F.when(none("a"), True).when(none("b"), False).otherwise(last_attempt("b") >= last_attempt("a"))

    def value(c: str) -> Column:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
        if c == "failure_count":
            return F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0)))
        if c in attempt:
            return F.when(b_later, F.coalesce(y, x)).otherwise(F.coalesce(x, y))
        return F.when(b_first, F.when(overlay, F.coalesce(y, x)).otherwise(y)).otherwise(F.when(overlay, F.coalesce(x, y)).otherwise(x))

    return both.select(*(F.coalesce("a.video_id", "b.video_id").alias(c) if c == "video_id" else value(c).alias(c) for c in current.columns))


def record_success(details: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched details replace their rows; failure_count stays."""
    old = details.select("video_id", F.col("failure_count").alias("_n"))
    new = fetched.join(old, "video_id", "left").withColumn("failure_count", F.coalesce("_n", F.lit(0)))
    new = new.select(*((F.col(c) if c in new.columns else F.lit(None)).cast(details.schema[c].dataType).alias(c) for c in details.columns))
    return details.join(fetched.select("video_id"), "video_id", "left_anti").unionByName(new)


def record_failure(details: DataFrame, failures: DataFrame, now: int) -> DataFrame:
    """failures: video_id, error.  A complete detail stays complete, with the failed attempt noted; others are failed."""
    a, b = details.alias("a"), failures.alias("b")
    both = a.join(b, F.col("a.video_id") == F.col("b.video_id"), "full_outer")
    failed, done = F.col("b.video_id").isNotNull(), F.coalesce(F.col("a.status") == "complete", F.lit(False))
    changed = {
        "status": F.when(done, F.col("a.status")).otherwise("failed"),
        "failure_count": F.coalesce("a.failure_count", F.lit(0)) + 1,
        "last_error": F.when(done, F.col("a.last_error")).otherwise(F.col("b.error")),
        "last_attempt_error": F.col("b.error"),
        "last_attempt_at": F.lit(now),
        "attempted_at": F.when(done, F.col("a.attempted_at")).otherwise(F.lit(now)),
    }
    cols = [F.coalesce("a.video_id", "b.video_id").alias(c) if c == "video_id" else F.when(failed, changed[c].cast(details.schema[c].dataType)).otherwise(F.col(f"a.{c}")).alias(c) if c in changed else F.col(f"a.{c}") for c in details.columns]
    return both.select(*cols)


def lookup(rows: DataFrame, value: str, key: str = "video_id") -> DataFrame:
    """The row of one key: a filter that reaches the scan."""
    return rows.where(F.col(key) == value)


def prune(rows: DataFrame, keep: DataFrame, key: str = "video_id") -> DataFrame:
    return rows.join(keep.select(key).distinct(), key, "left_semi")


# id sets ----------------------------------------------------------------------------------------------------


def normalize_ids(ids: DataFrame) -> DataFrame:
    """Distinct ids of digits; others go."""
    c = F.trim(F.col(ids.columns[0]).cast("string"))
    return ids.select(c.alias("video_id")).where(F.col("video_id").rlike(r"\A[0-9]+\z")).distinct()


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return normalize_ids(a).unionByName(normalize_ids(b)).distinct()


def change_ids(ids: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: video_id, action ("add", "remove" or "toggle"), seq; the last change of an id that adds or removes starts from there.

    Aggregates only: the last add or remove of an id, and the parity of the toggles that come after it.
    """
    have = normalize_ids(ids).select("video_id", F.lit(True).alias("have"))
    at = F.struct("seq", "action")
    last = changes.where("action <> 'toggle'").groupBy("video_id").agg(F.max(at).alias("last"))
    toggles = changes.where("action = 'toggle'").join(last, "video_id", "left").where("last is null or seq >= last.seq")
    odd = toggles.groupBy("video_id").agg((F.count("*") % 2 == 1).alias("odd"))
    both = have.join(last, "video_id", "full_outer").join(odd, "video_id", "full_outer")
    start = F.when(F.col("last").isNotNull(), F.col("last.action") == "add").otherwise(F.coalesce("have", F.lit(False)))
    return both.where(start != F.coalesce("odd", F.lit(False))).select("video_id")


def next_stamp(now: int, *stamps: int | None) -> int:
    """A time later than all before."""
    return max(now, *(s + 1 for s in stamps if s is not None), 0)


def same_ids(a: DataFrame, b: DataFrame) -> bool:
    """Whether two sets have the same members: one aggregate of a full join."""
    x, y = normalize_ids(a).withColumn("_a", F.lit(1)), normalize_ids(b).withColumn("_b", F.lit(1))
    return x.join(y, "video_id", "full_outer").where("_a is null or _b is null").limit(1).count() == 0


# whole states --------------------------------------------------------------------------------------------------


def plan_merge(current: dict[str, DataFrame], incoming: dict[str, DataFrame], current_ready: bool, incoming_complete: bool) -> dict[str, DataFrame]:
    """videos, details, history of two states.

    A ready current catalogue keeps its members and takes newer rows of them; else a complete incoming one gives the
    members; else all of both are members.
    """
    videos = merge_by_key(current["videos"], incoming["videos"], "video_id", ("listing_updated_at", "last_seen_at"))
    if current_ready:
        videos = prune(videos, current["videos"])
    elif incoming_complete:
        videos = prune(videos, incoming["videos"])
    history = merge_by_key(current["history"], incoming["history"], "id", ("finished_at",))
    return {"videos": videos, "details": prune(merge_details(current["details"], incoming["details"]), videos), "history": recent_history(history, 12)}


def replacement(incoming: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The incoming state, a row a key, without details of unknown ids."""
    videos = last_per_key(incoming["videos"], "video_id", "listing_updated_at", "last_seen_at")
    details = last_per_key(incoming["details"].withColumn("_done", F.col("status") == "complete"), "video_id", "_done", "fetched_at", "last_attempt_at").drop("_done")
    return {"videos": videos, "details": prune(details, videos), "history": recent_history(incoming["history"], 12)}


def recent_history(history: DataFrame, n: int) -> DataFrame:
    return history.orderBy(F.desc_nulls_last("finished_at"), "id").limit(n)


def synchronized_counts(videos: DataFrame, details: DataFrame) -> DataFrame:
    """One row: videos, complete details of them, outdated ones, coverage."""
    d = prune(details, videos).agg(
        F.count_if(F.col("status") == "complete").alias("complete"),
        F.count_if((F.col("status") == "complete") & (F.coalesce("schema_version", F.lit(0)) < CURRENT_SCHEMA)).alias("outdated"),
        F.lit(1).alias("one"),
    )
    return videos.agg(F.count_distinct("video_id").alias("videos"), F.lit(1).alias("one")).join(d, "one").select("videos", "complete", "outdated", F.when(F.col("videos") > 0, F.col("complete") / F.col("videos")).alias("coverage"))
