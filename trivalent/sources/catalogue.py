"""The catalogue as it is stored: the listing's table and what is known in detail of some of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merging import lookup


def joined(videos: DataFrame, details: DataFrame) -> DataFrame:
    """Every row of videos with ``detail``, a struct that is null where there is none; details of other ids are not read on.

    Both have a row an id.  The join is by id; tables that are bucketed by it join without a shuffle.
    """
    fields = [f.name for f in details.schema if f.name != "video_id"]
    known = details.where("video_id is not null").select("video_id", F.struct(*fields).alias("detail"))
    return videos.join(known, "video_id", "left")


def stored(store, version: int | None = None) -> DataFrame:
    """The catalogue of one version of a store."""
    version = store.version() if version is None else version
    tables = store.read_all(version)
    return joined(tables["videos"], tables["details"])


def one(videos: DataFrame, details: DataFrame, video_id: str) -> DataFrame:
    """The row of one id with its detail, or none: both sides are filtered in their scans."""
    return joined(lookup(videos, video_id), lookup(details, video_id))


#: What a catalogue's state is before anything is known of it.
STATE = {"scan_status": "not-scanned", "scan_kind": None, "indexed_count": 0, "detailed_count": 0, "discovered_page_count": None, "details_state": {"status": "idle", "completed": 0, "total": 0, "last_error": None}}


def overlaid(stored_state: dict | None, changes: dict | None = None) -> dict:
    """The one-row state: what is stored over the beginning, changes over both; the details' part is laid over key by key."""
    out = {**STATE, **(stored_state or {}), **(changes or {})}
    out["details_state"] = {k: v for part in (STATE, stored_state, changes) for k, v in ((part or {}).get("details_state") or {}).items()}
    return out
