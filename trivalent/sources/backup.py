"""Backups: one JSON document of a state, and its validated import.

Records are JSON lines by table, so that a backup of any size is written and read in parallel; the envelope is a small
document beside them.  Import checks every line and record while it stages them, in one scan a table; a backup with a wrong
one is refused whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import dates
from ..functions.text import unique_ci
from ..operators.merging import last_per_key, prune

FORMAT, VERSION = "catalogue-backup", 1
SCHEMAS = {"videos": schema.VIDEOS, "details": schema.DETAILS, "pages": schema.PAGES, "history": schema.HISTORY}
STATUSES = ("missing", "queued", "complete", "failed", "stale")
#: Limits of one record.
MOST_TEXT, MOST_LIST, MOST_FORMATS = 1_000_000, 10_000, 128
#: Keys of settings that belong to one device.
LOCAL_KEYS = ("videosPerPage", "videoColumns", "thumbnailAspectRatio", "artistThumbnailLabels", "artistThumbnailLabelSize")
#: Statuses of a running operation that a state may have.
STATES = ("not-scanned", "idle", "running", "paused", "failed", "complete")


def export(state: dict[str, DataFrame], path: str, meta: dict, compressed: bool = True) -> None:
    options = {"compression": "gzip"} if compressed else {}
    for name, df in state.items():
        df.write.options(**options).json(f"{path}/{name}")
    spark = next(iter(state.values())).sparkSession
    envelope = [(FORMAT, VERSION, k, str(v)) for k, v in {**meta, "tables": ",".join(state)}.items()]
    spark.createDataFrame(envelope, "format string, version int, key string, value string").coalesce(1).write.json(f"{path}/envelope")


def document(state: dict[str, DataFrame]) -> DataFrame:
    """table, record: every row as one line of JSON."""
    out = None
    for name, df in state.items():
        rows = df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
        out = rows if out is None else out.unionByName(rows)
    return out


def envelope_of(spark: SparkSession, path: str) -> dict[str, str]:
    """What a backup says of itself; a document of another format or version raises."""
    rows = spark.read.schema("format string, version int, key string, value string").json(f"{path}/envelope").collect()
    if not rows or any(r["format"] != FORMAT or r["version"] != VERSION for r in rows):
        raise ValueError("this is no backup that can be read")
    return {r["key"]: r["value"] for r in rows}


def _named(envelope: dict[str, str]) -> list[str]:
    return [n for n in SCHEMAS if n in envelope["tables"].split(",")]


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(tables, envelope), with fixed schemas; a document of another format or version raises."""
    envelope = envelope_of(spark, path)
    return {n: spark.read.schema(SCHEMAS[n]).json(f"{path}/{n}") for n in _named(envelope)}, envelope


def _bounded(c: str) -> Column:
    return F.coalesce(F.length(c) <= MOST_TEXT, F.lit(True))


def _within(c: str, low: float, high: float | None = None) -> Column:
    return F.coalesce((F.col(c) >= low) & (F.lit(True) if high is None else F.col(c) <= high), F.lit(True))


def _http(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(r"(?i)\Ahttps?://[^\s]+\z"), F.lit(True))


def checks(name: str) -> dict[str, Column]:
    """What must be TRUE of every record of a table."""
    id_ok = F.coalesce(F.col("video_id").rlike(r"\A[0-9]+\z"), F.lit(False)) if name in ("videos", "details") else F.lit(True)
    if name == "videos":
        return {"id": id_ok, "title": _bounded("title"), "url": _http("url"), "thumbnail": _http("thumbnail_url"), "rating": _within("rating_percent", 0, 100), "counts": _within("views", 0) & _within("rating_votes", 0) & _within("duration_sec", 0)}
    if name == "details":
        lists = F.lit(True)
        for c in ("artists", "uploaders", "tags", "categories"):
            lists = lists & (F.coalesce(F.size(c), F.lit(0)) <= MOST_LIST)
        date = F.col("exact_upload_date").isNull() | dates.parse_date(F.col("exact_upload_date")).isNotNull() | dates.parse_instant(F.col("exact_upload_date")).isNotNull()
        return {"id": id_ok, "status": F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "lists": lists, "formats": F.coalesce(F.size("formats"), F.lit(0)) <= MOST_FORMATS, "date": date, "description": _bounded("description"), "failures": _within("failure_count", 0)}
    if name == "history":
        return {"id": F.coalesce(F.col("id") != "", F.lit(False)), "times": _within("started_at", 0) & _within("finished_at", 0)}
    return {"page": _within("page_number", 1) & F.col("page_number").isNotNull()}


def violations(tables: dict[str, DataFrame]) -> dict[str, int]:
    """How many records fail each check, of those that some do; one pass a table."""
    out = {}
    for name, df in tables.items():
        own = checks(name)
        row = df.agg(*(F.count_if(~test).alias(k) for k, test in own.items())).first()
        out |= {f"{name}.{k}": row[k] for k in own if row[k]}
    return out


def normalize(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A row a key, lists cleaned, queued details missing, details of unknown ids and unfinished history gone."""
    out = dict(tables)
    if "videos" in out:
        out["videos"] = last_per_key(out["videos"], "video_id", "listing_updated_at", "last_seen_at")
    if "details" in out:
        d = out["details"].withColumn("status", F.when(F.col("status") == "queued", "missing").otherwise(F.col("status")))
        for c in ("artists", "uploaders", "tags", "categories"):
            d = d.withColumn(c, unique_ci(F.col(c)))
        full = F.filter("formats", lambda f: F.coalesce(f["name"], f["format"], f["quality"], f["resolution"]).isNotNull())
        d = last_per_key(d.withColumn("formats", full).withColumn("_done", F.col("status") == "complete"), "video_id", "_done", "fetched_at", "last_attempt_at").drop("_done")
        out["details"] = prune(d, out["videos"]) if "videos" in out else d
    if "history" in out:
        out["history"] = out["history"].where(F.col("status").isin("completed", "failed", "cancelled"))
    return out


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: distinct videos, complete details of them, coverage, bytes of the records."""
    done = prune(tables["details"].where("status = 'complete'"), tables["videos"]).agg(F.count_distinct("video_id").alias("complete"), F.lit(1).alias("one"))
    size = document(tables).agg(F.sum(F.octet_length("record")).alias("bytes"), F.lit(1).alias("one"))
    n = tables["videos"].agg(F.count_distinct("video_id").alias("videos"), F.lit(1).alias("one"))
    return n.join(done, "one").join(size, "one").select("videos", "complete", F.when(F.col("videos") > 0, F.col("complete") / F.col("videos")).alias("coverage"), "bytes")


def checked_records(spark: SparkSession, path: str, name: str) -> tuple[DataFrame, Observation]:
    """The records of one table, and counts of broken lines and failed checks that are known once they were written.

    A line is read, judged and parsed in one scan.  The counts are those of a job of one stage, so tasks that ran twice count once.
    """
    lines = spark.read.text(f"{path}/{name}").select(line_problems(F.col("value")).alias("_problems"), F.from_json("value", SCHEMAS[name]).alias("_record"))
    broken = [F.count_if(F.array_contains("_problems", k)).alias(f"line_{k}") for k in PROBLEMS]
    failed = [F.count_if((F.size("_problems") == 0) & ~test).alias(f"record_{k}") for k, test in checks(name).items()]
    seen = Observation(f"import-{name}")
    return lines.select("_problems", "_record.*").observe(seen, *broken, *failed).drop("_problems"), seen


def stage_records(spark: SparkSession, path: str, at: str) -> tuple[dict[str, DataFrame], dict[str, int], dict[str, int]]:
    """(tables, broken lines, failed checks) of a backup: each table is scanned once, and written under ``at`` while it is checked."""
    tables, broken, failed = {}, {}, {}
    for name in _named(envelope_of(spark, path)):
        rows, seen = checked_records(spark, path, name)
        rows.write.parquet(f"{at}/{name}")
        for key, n in seen.get.items():
            kind, what = key.split("_", 1)
            if n:
                (broken if kind == "line" else failed)[f"{name}.{what}"] = n
        tables[name] = spark.read.schema(SCHEMAS[name]).parquet(f"{at}/{name}")
    return tables, broken, failed


def import_backup(store, path: str, mode: str = "merge", current_ready: bool = False, incoming_complete: bool = False) -> int:
    """The store's version after an import; a refused or failed one leaves the store as it was.

    Records are staged among the store's drafts, which go when the import ends; those of a driver that was lost go when the store is cleaned.
    """
    from ..operators.merging import plan_merge, replacement

    before = store.version()
    with store.draft() as at:
        tables, broken, failed = stage_records(store.spark, path, at)
        if broken:
            raise ValueError(f"the backup has lines that can't be taken: {broken}")
        if failed:
            raise ValueError(f"the backup has records that can't be taken: {failed}")
        clean = normalize(tables)
        next_ = replacement(clean) if mode == "replace" else plan_merge(store.read_all(before), clean, current_ready, incoming_complete)
        return store.commit(next_, {"imported": path}, expected=before)


def portable(settings: dict) -> dict:
    return {k: v for k, v in settings.items() if k not in LOCAL_KEYS}


def imported(settings: dict, own: dict) -> dict:
    """Imported settings with this device's own keys."""
    return {**portable(settings), **{k: own[k] for k in LOCAL_KEYS if k in own}}


def imported_state(state: dict) -> dict:
    """A one-row state of a backup: what was running is paused, with the reason; a status that is none raises."""
    out = dict(state)
    for key in ("scan_status", "smart_status", "status"):
        if key in out and out[key] not in STATES:
            raise ValueError(f"{key} can't be {out[key]!r}")
        if out.get(key) == "running":
            out |= {key: "paused", "current_page": None, "run_started_at": None, "last_error": {"code": "interrupted", "message": "this was running when the backup was made"}}
    if isinstance(out.get("details_state"), dict):
        out["details_state"] = imported_state(out["details_state"])
    return out


#: Limits of one line of JSON: nesting, and keys that no document may have.
MOST_DEPTH, BARRED_KEYS = 32, ("__proto__", "prototype", "constructor")


PROBLEMS = ("no-json", "depth", "key", "number", "text")


def _depth(bare: Column) -> Column:
    """The deepest nesting of a line without its strings, whether it is closed or not."""
    turns = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    step = lambda x: F.when(x.isin("[", "{"), 1).when(x.isin("]", "}"), -1).otherwise(0)
    at = lambda now, most: F.struct(now.alias("now"), most.alias("most"))
    return F.aggregate(turns, at(F.lit(0), F.lit(0)), lambda a, x: at(a["now"] + step(x), F.greatest(a["most"], a["now"] + step(x))), lambda a: a["most"])


def line_problems(c: Column) -> Column:
    """array<string> of what is wrong with a line of JSON: no JSON, too deep, a barred key, a number that is none, a text too long."""
    bare = F.regexp_replace(c, r'"(?:\\.|[^"\\])*+"', '""')
    # nesting is at most as deep as brackets are many, and a text at most as long as its line; few lines need a closer look
    many, long = F.length(F.regexp_replace(bare, r"[^\[{]", "")) > MOST_DEPTH, F.length(c) > MOST_TEXT
    tests = {
        "no-json": F.try_parse_json(c).isNull(), "depth": many & (_depth(bare) > MOST_DEPTH), "key": c.rlike(rf'"(?:{"|".join(BARRED_KEYS)})"\s*:'), "number": bare.rlike(r"\b(?:NaN|Infinity)\b"),
        "text": long & F.exists(F.regexp_extract_all(c, F.lit(r'"((?:\\.|[^"\\])*+)"'), F.lit(1)), lambda t: F.length(t) > MOST_TEXT),
    }
    return F.filter(F.array(*(F.when(tests[name], F.lit(name)) for name in PROBLEMS)), lambda x: x.isNotNull())


def broken_lines(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    """table, problem, n: lines of a backup that no table may have."""
    out = None
    for name in tables:
        rows = spark.read.text(f"{path}/{name}").select(F.lit(name).alias("table"), F.explode(line_problems(F.col("value"))).alias("problem"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("table", "problem").agg(F.count("*").alias("n"))


def complete_details(rows: DataFrame, now: int) -> DataFrame:
    """Fetched details in their stored form: texts collapsed, lists without repeats, references of distinct keys, numbers not negative."""
    collapse = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    listed = lambda c: unique_ci(F.transform(F.coalesce(c, F.array().cast("array<string>")), collapse))
    either = lambda many, one: F.when(F.coalesce(F.size(many), F.lit(0)) > 0, listed(F.col(many))).otherwise(listed(F.array(one)))
    refs = F.filter(F.transform("artist_refs", lambda r: F.struct(F.lower(collapse(r["key"])).alias("key"), collapse(r["name"]).alias("name"), collapse(r["url"]).alias("url"))), lambda r: (r["key"] != "") & (r["name"] != "") & r["url"].rlike(r"(?i)\Ahttps?://[^/]+/[^/]+/[^/]+/\z"))
    first = F.aggregate(F.coalesce(refs, F.array().cast("array<struct<key:string,name:string,url:string>>")), F.array().cast("array<struct<key:string,name:string,url:string>>"), lambda a, r: F.when(F.exists(a, lambda o: o["key"] == r["key"]), a).otherwise(F.concat(a, F.array(r))))
    out = rows.withColumns({"artists": either("artists", "artist"), "uploaders": either("uploaders", "uploader"), "tags": listed(F.col("tags")), "categories": listed(F.col("categories")), "artist_refs": first})
    return out.withColumns({
        "artist": F.get("artists", F.lit(0)), "uploader": F.get("uploaders", F.lit(0)), "description": F.trim(F.coalesce("description", F.lit(""))), "status": F.lit("complete"),
        "comments_count": F.greatest("comments_count", F.lit(0).cast("long")), "fetched_at": F.coalesce("fetched_at", F.lit(now).cast("long")), "last_attempt_at": F.coalesce("last_attempt_at", F.lit(now).cast("long")),
        "schema_version": F.coalesce("schema_version", F.lit(1)), "failure_count": F.greatest(F.coalesce("failure_count", F.lit(0)), F.lit(0)), "last_error": F.lit(None).cast(schema.ERROR), "last_attempt_error": F.lit(None).cast(schema.ERROR),
    })


def diagnostics(videos: DataFrame, details: DataFrame, samples: int = 10) -> DataFrame:
    """section, key, n: counts, histograms of failures and of kinds of URLs, and a few bounded samples of failures."""
    from ..functions.urls import shape

    current = prune(details, videos)
    failed = current.where("status <> 'complete'").withColumn("error", F.coalesce("last_error", "last_attempt_error"))
    part = lambda df, section, key: df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), F.col("key").cast("string").alias("key"), "n")
    out = part(current, "status", F.col("status")).unionByName(part(failed, "code", F.coalesce("error.code", F.lit("unknown"))))
    out = out.unionByName(part(failed.where("error.http_status is not null"), "http", F.col("error.http_status"))).unionByName(part(videos, "shape", shape(F.col("url"))))
    told = F.to_json(F.struct("video_id", F.substring("error.code", 1, 80).alias("code"), F.substring("error.message", 1, 240).alias("message"), F.col("error.http_status").alias("http_status")))
    return out.unionByName(failed.orderBy("video_id").limit(samples).select(F.lit("sample").alias("section"), told.alias("key"), F.lit(1).cast("long").alias("n")))
