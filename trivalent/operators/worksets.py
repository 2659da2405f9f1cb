"""Worksets of details to fetch, counters of a catalogue's state, and what failures say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.details import CURRENT_SCHEMA, TRUSTED_SCHEMA
from .merging import TIMES

MODES = ("missing", "failed", "refreshFailed", "refresh", "outdated")


def last_attempt_at() -> Column:
    return F.greatest(*(F.coalesce(c, F.lit(0).cast("long")) for c in TIMES), F.lit(0).cast("long"))


def select_targets(videos: DataFrame, details: DataFrame, mode: str, limit: int | None = None, cutoff: int | None = None) -> DataFrame:
    """video_id, ord of what to fetch, in native order; rows attempted since the cutoff are done already.

    The first ``limit`` are a bounded top; without a limit nothing is sorted.
    """
    if mode not in MODES:
        raise ValueError(f"no mode {mode!r}")
    rows = videos.where("video_id is not null").groupBy("video_id").agg(F.min("ord").alias("ord")).join(details.drop("ord"), "video_id", "left")
    done = F.coalesce(F.col("status") == "complete", F.lit(False))
    wanted = {
        "missing": ~done,
        "failed": F.coalesce(F.col("status") == "failed", F.lit(False)),
        "refreshFailed": done & F.col("last_attempt_error").isNotNull(),
        "refresh": done,
        "outdated": done & (F.coalesce("schema_version", F.lit(0)) < CURRENT_SCHEMA),
    }[mode]
    out = rows.where(wanted)
    if cutoff is not None:
        out = out.where(last_attempt_at() < cutoff)
    out = out.select("video_id", "ord")
    return out.orderBy("ord").limit(limit) if limit is not None else out


def status_counts(videos: DataFrame, details: DataFrame) -> DataFrame:
    """status, n of details whose id is in videos."""
    return details.join(videos.select("video_id").distinct(), "video_id", "left_semi").groupBy("status").agg(F.count("*").alias("n"))


def maintenance_counts(videos: DataFrame, details: DataFrame) -> DataFrame:
    """One row of failed, failed_refresh and outdated; here outdated is below the trusted version."""
    done = F.col("status") == "complete"
    return details.join(videos.select("video_id").distinct(), "video_id", "left_semi").agg(
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(done & F.col("last_attempt_error").isNotNull()).alias("failed_refresh"),
        F.count_if(done & (F.coalesce("schema_version", F.lit(0)) < TRUSTED_SCHEMA)).alias("outdated"),
    )


def outdated_count(details: DataFrame, below: int = CURRENT_SCHEMA) -> DataFrame:
    return details.agg(F.count_if((F.col("status") == "complete") & (F.coalesce("schema_version", F.lit(0)) < below)).alias("outdated"))


def histogram(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def majority(failures: DataFrame, classes: list[tuple[str, Column]]) -> DataFrame:
    """One row: the first class, in order, that at least half of the failures are of; else "mixed"."""
    agg = failures.agg(F.count("*").alias("n"), *(F.count_if(test).alias(f"c{k}") for k, (_, test) in enumerate(classes)))
    out = F.lit("mixed")
    for k, (name, _) in reversed(list(enumerate(classes))):
        out = F.when((F.col("n") > 0) & (F.col(f"c{k}") >= F.ceil(F.col("n") / 2)), name).otherwise(out)
    return agg.select("n", out.alias("class"))


def systemic_preflight(rows: DataFrame, invalid: Column) -> DataFrame:
    """One row: whether so many rows are invalid that it is no accident: 25, or 3 and 5 percent."""
    return rows.agg(F.count_if(invalid).alias("invalid"), F.count("*").alias("total")).withColumn("systemic", (F.col("invalid") >= 25) | ((F.col("invalid") >= 3) & (F.col("invalid") * 20 >= F.col("total"))))


def gone_only(failures: DataFrame, targets: int) -> DataFrame:
    """One row: whether all valid targets were tried and the few failures are all of pages that are gone."""
    return failures.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("http_status").isin(404, 410)), F.lit(False)).alias("gone")).select("n", ((F.col("n") > 0) & (F.col("n") < 3) & (F.col("n") == targets) & F.col("gone")).alias("isolated"))


def canary(outcomes: DataFrame, most: int = 10) -> DataFrame:
    """One row: whether the first targets show that the rest can be read; outcomes: pos, ok.

    Of ``most`` targets at most, three fifths must be read and three are enough; targets after these aren't tried.
    """
    first = outcomes.orderBy("pos").limit(most).agg(F.sort_array(F.collect_list(F.struct("pos", "ok"))).alias("x"))
    need = F.least(F.lit(3), F.greatest(F.lit(1), F.ceil(F.size("x") * 0.6).cast("int")))
    tried = F.filter("x", lambda _, i: F.size(F.filter(F.slice("x", F.lit(1), i), lambda y: y["ok"])) < F.col("required"))
    out = first.withColumn("required", need).withColumn("tried", tried)
    read = F.size(F.filter("tried", lambda y: y["ok"]))
    return out.select(F.size("tried").alias("attempted"), read.alias("verified"), "required", (read >= F.col("required")).alias("passed"))


def tripped(outcomes: DataFrame, run: int = 3) -> DataFrame:
    """One row: where ``run`` outcomes in a row were failures of one systemic kind for the first time, and the kind; nulls if nowhere.

    outcomes: pos, numbers without gaps, and kind, null for what was read or failed by itself.  Each failure is counted at its place and
    the ones after it, so there is no window over all of them.
    """
    reach = F.explode(F.sequence(F.col("pos"), F.col("pos") + run - 1)).alias("at")
    full = outcomes.where("kind is not null").select("kind", reach).groupBy("at", "kind").agg(F.count("*").alias("n")).where(F.col("n") == run)
    return full.agg(F.min(F.struct("at", "kind")).alias("x")).select(F.col("x.at").alias("stopped_at"), F.col("x.kind").alias("kind"))


def repeated_ids(rows: DataFrame) -> DataFrame:
    return rows.groupBy("video_id").agg(F.count("*").alias("n")).where("n > 1")


def catalogue_state(videos: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: ready, partial or empty, from what is there and not from stored flags."""
    listed = pages.where("status = 'complete'").select(F.explode("video_ids").alias("video_id")).distinct()
    have = videos.select("video_id").distinct()
    n = have.agg(F.count("*").alias("videos"), F.lit(1).alias("one"))
    p = pages.agg(F.count_if(F.col("status") == "complete").alias("complete_pages"), F.count("*").alias("pages"), F.lit(1).alias("one"))
    lost = listed.join(have, "video_id", "left_anti").agg(F.count("*").alias("lost"), F.lit(1).alias("one"))
    state = F.when(F.col("videos") == 0, "empty").when((F.col("complete_pages") > 0) & (F.col("complete_pages") == F.col("pages")) & (F.col("lost") == 0), "ready").otherwise("partial")
    return n.join(p, "one").join(lost, "one").select("videos", "pages", "complete_pages", "lost", state.alias("state"))


def timing(samples: DataFrame, remaining: int) -> DataFrame:
    """One row: mean milliseconds an item and the time that is left; null below two samples or a second. samples: ms."""
    s = samples.agg(F.count("ms").alias("n"), F.sum("ms").alias("total"))
    enough = (F.col("n") >= 2) & (F.col("total") >= 1000)
    return s.select("n", F.when(enough, F.col("total") / F.col("n")).alias("ms_each"), F.when(enough, F.col("total") / F.col("n") * remaining).alias("ms_left"))


def new_ids(scanned: DataFrame, old: DataFrame) -> DataFrame:
    """One row: how many distinct scanned ids are not in old."""
    return scanned.join(old.select("video_id"), "video_id", "left_anti").agg(F.count_distinct("video_id").alias("n"))


def interrupted(state: dict, reason: str = "interrupted") -> dict:
    """A one-row state after a restart: what was running is paused."""
    out = dict(state)
    for key in ("status", "details_status"):
        if out.get(key) == "running":
            out[key], out["paused_reason"] = "paused", reason
    return out


def plan_operation(total: int, done: int, cutoff: int | None, now: int) -> dict:
    """Counters with which an operation goes on; its cutoff is the time at which it first began."""
    return {"total": total, "done": min(done, total), "remaining": max(0, total - done), "cutoff": now if cutoff is None else cutoff, "resumed": done > 0}
