"""Orders: sorting and paging, native order, sequences and how they overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..sources.scratch import written

FIELDS = ("uploadDate", "views", "rating", "ratingVotes", "duration", "title")
PAGE_SIZES = (24, 48, 72)


def normalize_sort(raw: dict | None = None) -> dict:
    raw = raw or {}
    field = raw.get("field") if raw.get("field") in FIELDS else "uploadDate"
    return {"field": field, "direction": raw["direction"] if raw.get("direction") in ("asc", "desc") else default_direction(field)}


def default_direction(field: str) -> str:
    return "asc" if field == "title" else "desc"


def toggle_sort(current: dict, field: str) -> dict:
    now = normalize_sort(current)
    flipped = "desc" if now["direction"] == "asc" else "asc"
    return {"field": field, "direction": flipped if now["field"] == field else default_direction(field)}


def sort_key(field: str) -> Column:
    """The column to sort by; null is unknown."""
    if field == "uploadDate":
        return dates.display_resolve(F.col("detail.status"), F.col("detail.exact_upload_date"), dates.listing_range(F.col))["sort"]
    if field == "title":
        return F.collate(F.nullif(F.col("title"), F.lit("")), "UNICODE_CI_AI")
    return F.col({"views": "views", "rating": "rating_percent", "ratingVotes": "rating_votes", "duration": "duration_sec"}[field])


def order_by(state: dict | None) -> list[Column]:
    """Unknown values last in both directions; ties in native order."""
    s = normalize_sort(state)
    key = sort_key(s["field"])
    return [key.asc_nulls_last() if s["direction"] == "asc" else key.desc_nulls_last(), F.col("ord").asc_nulls_last()]


def page_size(size: int) -> int:
    return size if size in PAGE_SIZES else PAGE_SIZES[0]


def clamp_page(page: int, total: int, size: int) -> int:
    return max(1, min(page, -(-total // page_size(size)) or 1))


def page(rows: DataFrame, number: int, size: int, state: dict | None = None) -> DataFrame:
    """One page of the sorted rows: a bounded top, no full sort."""
    size = page_size(size)
    return rows.orderBy(*order_by(state)).offset((max(1, number) - 1) * size).limit(size)


def paginator(number: int, pages: int, slots: int = 9) -> list[dict]:
    """The buttons of a paginator: ends, neighbours and gaps, in ``slots`` places at most."""
    number = max(1, min(number, pages))
    if pages <= slots:
        shown = list(range(1, pages + 1))
    else:
        inner = slots - 4
        first = max(3, min(number - inner // 2, pages - 1 - inner))
        window = list(range(first, first + inner))
        left = [1, 2] if window[0] == 3 else [1, None]
        right = [pages - 1, pages] if window[-1] == pages - 2 else [None, pages]
        shown = left + window + right
    ends = lambda kind, to, off: {"kind": kind, "page": to, "disabled": off}
    middle = [{"kind": "ellipsis"} if p is None else {"kind": "page", "page": p, "current": p == number} for p in shown]
    return [ends("first", 1, number == 1), ends("previous", max(1, number - 1), number == 1), *middle, ends("next", min(pages, number + 1), number == pages), ends("last", pages, number == pages)]


def parse_jump(text: str, pages: int) -> int | None:
    t = str(text).strip()
    return int(t) if t.isascii() and t.isdigit() and 1 <= int(t) <= pages else None


# sequences --------------------------------------------------------------------------------------------------


def native_order(pages: DataFrame, videos: DataFrame) -> DataFrame:
    """video_id, ord from 0: ids of complete pages where they come first, then the other rows of videos.

    No task sorts it all: see ``numbered``.
    """
    listed = pages.where("status = 'complete'").select("page_number", F.posexplode("video_ids").alias("pos", "video_id")).groupBy("video_id").agg(F.min(F.struct("page_number", "pos")).alias("at"))
    big = F.lit(2**31 - 1)
    key = F.struct(F.col("at").isNull().alias("orphan"), F.coalesce("at.page_number", "native_page", big).alias("a"), F.coalesce("at.pos", "native_order", big).alias("b"), "video_id")
    rows = videos.select("video_id", "native_page", "native_order").join(listed, "video_id", "left").select("video_id", key.alias("key"))
    return numbered(rows, "key").select("video_id", "ord")


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with ``ord``, their place from 0 in order of a key, which must be unique.

    One range exchange, written once: the ranges' sizes and the rows are read from the same files, so both see the same
    ranges.  A row's number is its place in its range and the sizes of the ranges before (as many as shuffle partitions).
    """
    ranged = rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())
    table = written(ranged, "ranges").withColumn("_range", F.shiftright("_at", 33))
    sizes = table.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit(2**33 - 1)) + F.col("_before")
    return table.join(F.broadcast(before), "_range").withColumn("ord", place).drop("_at", "_range", "_before")


def native_page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """One page of rows in native order: a filter on ``ord``, no sort of the table."""
    size = page_size(size)
    first = (max(1, number) - 1) * size
    return rows.where((F.col("ord") >= first) & (F.col("ord") < first + size))


def positions(ids: DataFrame) -> DataFrame:
    """First positions of distinct ids; ids: pos, id."""
    return ids.groupBy("id").agg(F.min("pos").alias("pos"))


def ordered_overlap(scanned: DataFrame, old: DataFrame, minimum: int) -> DataFrame:
    """scan_index, old_index, run: the longest run of ids that both have in the same order without a gap; the earliest of equal ones.

    Both: pos, id.  Matches are numbered by diagonal and place; a run's matches have the same distance from their numbers,
    so it is a group of an aggregate, and an unchanged tail, which is one diagonal, is no single task's work.
    """
    m = scanned.select(F.col("pos").cast("long").alias("i"), "id").join(old.select(F.col("pos").cast("long").alias("j"), "id"), "id")
    placed = numbered(m.select(F.struct((F.col("i") - F.col("j")).alias("diagonal"), "i").alias("at"), "j"), "at")
    runs = placed.groupBy("at.diagonal", (F.col("at.i") - F.col("ord")).alias("island")).agg(F.min("at.i").alias("scan_index"), F.min("j").alias("old_index"), F.count("*").alias("run"))
    return runs.where(F.col("run") >= minimum).orderBy(F.desc("run"), "scan_index", "old_index").limit(1).select("scan_index", "old_index", "run")


def merge_prefix(scanned: DataFrame, old: DataFrame) -> DataFrame:
    """pos, id: scanned, then old ids that were not scanned; each where it comes first."""
    both = scanned.select(F.lit(0).alias("source"), "pos", "id").unionByName(old.select(F.lit(1).alias("source"), "pos", "id"))
    first = both.groupBy("id").agg(F.min(F.struct("source", "pos", "id")).alias("key"))
    return numbered(first, "key").select(F.col("ord").alias("pos"), "id")


def recent_order(scanned: DataFrame, old: DataFrame, live_pages: int | None, pages_scanned: int, native_total: int | None) -> tuple[DataFrame, bool]:
    """(order, whether ids that are not in it may go): only a scan of the whole live depth with the right total is authoritative."""
    full = live_pages is not None and pages_scanned >= live_pages and native_total is not None
    if full and scanned.select("id").distinct().count() == native_total:
        return numbered(scanned.groupBy("id").agg(F.min(F.struct("pos", "id")).alias("key")), "key").select(F.col("ord").alias("pos"), "id"), True
    return merge_prefix(scanned, old), False


def smart_order(scanned: DataFrame, old: DataFrame, minimum: int, native_total: int | None, reached_end: bool) -> tuple[DataFrame | None, str]:
    """(order, reason): scanned if the end was reached and the total agrees; else scanned to the overlap, then old from there."""
    if reached_end:
        ok = native_total is None or scanned.select("id").distinct().count() == native_total
        return (merge_prefix(scanned, scanned.limit(0)), "reached-end") if ok else (None, "total-mismatch")
    hit = ordered_overlap(scanned, old, minimum).first()
    if hit is None:
        return None, "no-overlap"
    out = merge_prefix(scanned.where(F.col("pos") < hit["scan_index"]), old.where(F.col("pos") >= hit["old_index"]))
    if native_total is not None and out.count() != native_total:
        return None, "total-mismatch"
    return out, "overlap"


def anchor_order(scanned: DataFrame, old: DataFrame, native_total: int) -> tuple[DataFrame | None, str]:
    """(order, reason): what was scanned before the first old id, then all old ids, if the total agrees."""
    anchor = old.orderBy("pos").select("id").limit(1)
    at = scanned.join(anchor, "id", "left_semi").agg(F.min("pos").alias("at")).first()["at"]
    if at is None:
        return None, "no-anchor"
    out = merge_prefix(scanned.where(F.col("pos") < at), old)
    return (out, "anchor") if out.count() == native_total else (None, "total-mismatch")


def repaginate(order: DataFrame, size: int) -> DataFrame:
    """id, page and place on it from 1; order: pos, id."""
    return order.select("id", (F.floor(F.col("pos") / size) + 1).cast("long").alias("page"), (F.col("pos") % size + 1).cast("long").alias("place"))


def contiguous_prefix(pages: DataFrame) -> DataFrame:
    """One row: the largest n for which complete pages 1 to n are all there: one less than the first missing number."""
    done = pages.where("status = 'complete' and page_number > 0").select("page_number").distinct()
    follow = done.select((F.col("page_number") + 1).alias("page_number")).unionByName(done.sparkSession.createDataFrame([(1,)], "page_number int"))
    return follow.join(done, "page_number", "left_anti").agg((F.min("page_number") - 1).cast("long").alias("n"))


def resume_plan(pages: DataFrame, session_id: str) -> DataFrame:
    """One row: pages of a session that are complete, and the first that is not."""
    own = pages.where((F.col("session_id") == session_id) & (F.col("status") == "complete"))
    done = own.agg(F.count_distinct("page_number").alias("done"), F.lit(1).alias("one"))
    return contiguous_prefix(own).withColumn("one", F.lit(1)).join(done, "one").select("done", (F.col("n") + 1).alias("next_page"))
