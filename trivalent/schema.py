"""Table schemas of the catalogue."""

from __future__ import annotations

VIDEOS = (
    "video_id string, url string, title string, duration_sec long, thumbnail_url string, thumbnail_preferred_url string, thumbnail_fallback_url string, "
    "preview_url string, hd_available boolean, relative_upload_text string, relative_upload_observed_at long, listing_upload_earliest_at long, "
    "listing_upload_latest_at long, listing_upload_unit string, listing_upload_amount long, rating_percent double, rating_votes long, views long, "
    "native_page int, native_order int, first_seen_at long, last_seen_at long, listing_updated_at long, thumbnail_repaired_at long"
)
ERROR = "struct<code:string,message:string,http_status:int>"
DETAIL_FIELDS = (
    "status string, schema_version int, entity_trust struct<artist:boolean,uploader:boolean,tags:boolean,categories:boolean>, artist string, uploader string, "
    "artists array<string>, uploaders array<string>, tags array<string>, categories array<string>, artist_refs array<struct<key:string,name:string,url:string>>, "
    "description string, exact_upload_date string, comments_count long, formats array<struct<name:string,format:string,quality:string,resolution:string>>, "
    f"fetched_at long, attempted_at long, last_attempt_at long, failure_count int, last_error {ERROR}, last_attempt_error {ERROR}"
)
DETAILS = f"video_id string, {DETAIL_FIELDS}"
PAGES = f"page_number int, video_ids array<string>, scanned_at long, source_fingerprint string, session_id string, status string, last_error {ERROR}"
STAGE = "session_id string, page_number int, position int, video_id string"
HISTORY = "id string, kind string, status string, started_at long, finished_at long, summary string"
