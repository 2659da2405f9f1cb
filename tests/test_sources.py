"""HTML sources, the versioned store, backups and ingest."""

import pytest
from pyspark.sql import functions as F

from trivalent import schema
from trivalent.operators import merging, ordering
from trivalent.sources import backup, html
from trivalent.sources.tables import Store
from trivalent.streaming import ingest

LAYOUT = html.Layout()
NOW = 1_700_000_000_000


def card(i, extra="", classes="item"):
    return f'<div class="{classes}"><a href="/video/{i}/x"><img data-src="/t/{i}.jpg" src="data:x"><b class="title">Item {i}</b></a><i class="time">1:0{i % 10}</i><i class="added">{i} days ago</i><i class="rating">90% (1.2K)</i><i class="views">{i}K</i>{extra}</div>'


def listing(*cards, last=3):
    return f'<html><body><h2>Items ({len(cards) * last})</h2><div class="items" data-per-page="{len(cards)}">{"".join(cards)}</div><div class="pagination"><a data-parameters="sort:x;from:0{last}">{last}</a></div></body></html>'


def pages(spark, *texts):
    return spark.createDataFrame([(k + 1, t) for k, t in enumerate(texts)], "page_number int, html string")


def test_listing(spark):
    p = pages(spark, listing(card(1), card(2, '<i class="hd"></i>'), card(3, classes="item ad"), '<div class="item"><p>no link</p></div>'), "<html><title>Sign in</title></html>", None)
    rows = {(r["native_page"], r["native_order"]): r for r in html.listing(p, LAYOUT, NOW).collect()}
    assert set(rows) == {(1, 1), (1, 2), (2, 0), (3, 0)}
    r = rows[1, 2]
    assert (r["video_id"], r["url"], r["title"], r["duration_sec"], r["rating_percent"], r["rating_votes"], r["views"], r["hd_available"]) == ("2", "https://example.com/video/2/x", "Item 2", 62, 90.0, 1200, 2000, True)
    assert (r["thumbnail_url"], r["listing_upload_latest_at"]) == ("https://example.com/t/2.jpg", NOW - 2 * 86_400_000)
    assert rows[2, 0]["reason"] == "sign-in" and rows[3, 0]["reason"] == "no-grid"
    assert {r["native_page"]: r["class"] for r in html.page_report(html.listing(p, LAYOUT, NOW)).collect()} == {1: "ok", 2: "missing-grid", 3: "missing-grid"}
    f = html.feed(p, LAYOUT).orderBy("page_number").first()
    assert (f["grid"], f["cards"], f["total"], f["page_count"]) == (True, 2, 12, 3)


def test_details(spark):
    chip = lambda kind, href, name: f'<span data-item-type="{kind}" data-video-id="7"><a href="{href}"><i class="name">{name}</i></a></span>'
    page = f"""<html><body><script type="application/ld+json">{{"@graph":[{{"@type":"VideoObject","uploadDate":"2024-02-29","commentCount":4}}]}}</script><script type="application/ld+json">broken</script>
    <div data-video-id="7"><span class="label">Artists:</span>{chip("model", "/models/jane/", "Jane")}</div><div data-video-id="7"><b class="label">Tags</b>{chip("tag", "/elsewhere", "x")}</div>
    <div class="row"><span class="label">Uploaded by</span><a href="/members/12/">Bob</a></div><a class="tag_item_download">MP4 1080p</a><a class="tag_item_download">MP4 1080p</a><p class="description">Some text</p><a class="remove-favourite"></a></body></html>"""
    p = spark.createDataFrame([("7", page), ("8", "<html><body><p>nothing</p></body></html>")], "video_id string, html string")
    a, b = html.details(p, LAYOUT, NOW).orderBy("video_id").collect()
    assert (a["status"], a["artists"], a["uploaders"], a["exact_upload_date"], a["comments_count"], a["favorite"]) == ("complete", ["Jane"], ["Bob"], "2024-02-29", 4, True)
    assert a["entity_trust"].asDict() == {"artist": True, "uploader": True, "tags": False, "categories": False}
    assert [f.asDict() for f in a["formats"]] == [{"name": None, "format": "mp4", "quality": None, "resolution": "1080p"}]
    assert a["artist_refs"][0]["key"] == "jane"
    assert (b["status"], b["reason"]) == ("failed", "unexpected-structure")


def test_membership(spark):
    page = lambda names, total: f'<div class="total_results">{total}</div><div class="members">{"".join(f"<a href=/models/{n}/>{n}</a>" for n in names)}</div>'
    rows = html.membership(pages(spark, page(["a", "b"], 3), page(["c", "a"], 3)), LAYOUT)
    members, reason = html.member_snapshot(rows, 2)
    assert reason == "complete" and [r["key"] for r in members.collect()] == ["a", "b", "c"]
    assert html.member_snapshot(rows, 3) == (None, "pages-missing")
    assert html.member_snapshot(html.membership(pages(spark, page(["a"], 3)), LAYOUT), 1) == (None, "total-mismatch")
    assert html.member_snapshot(html.membership(pages(spark, page(["a"], ""), page([], "")), LAYOUT), 2) == (None, "empty-page")


def empty(spark):
    return {"videos": spark.createDataFrame([], schema.VIDEOS), "details": spark.createDataFrame([], schema.DETAILS), "pages": spark.createDataFrame([], schema.PAGES), "history": spark.createDataFrame([], schema.HISTORY)}


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    assert s.version() == 0
    s.commit({"a": spark.range(3), "b": spark.range(1)}, {"k": 1})
    s.commit({"a": spark.range(5)})
    assert (s.read("a").count(), s.read("b").count(), s.read("a", 1).count(), s.state()["meta"]) == (5, 1, 3, {"k": 1})
    with pytest.raises(RuntimeError):
        s.commit({"a": spark.range(1)}, expected=1)
    s.restore(1)
    assert (s.version(), s.read("a").count()) == (3, 3)


def test_ingest(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.commit(empty(spark))
    rows = lambda p: html.listing(p, LAYOUT, NOW)
    ingest.commit_pages(s, rows(pages(spark, listing(card(1), card(2)), listing(card(3), card(4)), "<html></html>")), "s1", NOW)
    assert s.read("videos").count() == 4
    assert {r["page_number"]: r["status"] for r in s.read("pages").collect()} == {1: "complete", 2: "complete", 3: "failed"}
    order = [r["video_id"] for r in ordering.native_order(s.read("pages"), s.read("videos")).orderBy("ord").collect()]
    assert order == ["1", "2", "3", "4"]
    _, full = ingest.recent_update(s, rows(pages(spark, listing(card(9), card(1)))), 3, 6, 2, NOW + 1)
    assert not full
    order = [r["video_id"] for r in ordering.native_order(s.read("pages"), s.read("videos")).orderBy("ord").collect()]
    assert order == ["9", "1", "2", "3", "4"]
    _, full = ingest.recent_update(s, rows(pages(spark, listing(card(9), card(1)), listing(card(5)))), 2, 3, 2, NOW + 2)
    assert full and {r["video_id"] for r in s.read("videos").collect()} == {"9", "1", "5"}
    assert s.read("videos").where("video_id = '1'").first()["first_seen_at"] == NOW
    with pytest.raises(RuntimeError):
        ingest.finalize_rescan(s, "none", 2)
    ingest.stage(s, rows(pages(spark, listing(card(6), card(5)))), "s2")
    assert [r["id"] for r in ingest.staged(s, "s2").orderBy("pos").collect()] == ["6", "5"]
    ingest.clear_stage(s, "s2")
    assert s.read("stage").count() == 0
    ingest.clear_all(s)
    assert s.read("videos").count() == 0


def test_interleaved_commits_are_refused(spark, tmp_path):
    """A commit between reading and writing must not be overwritten."""
    s = Store(spark, f"file://{tmp_path}/s")
    s.commit(empty(spark))
    rows = lambda *c: html.listing(pages(spark, listing(*c)), LAYOUT, NOW)
    commit = s.commit

    def overtaken(*args, **more):
        s.commit = commit
        ingest.commit_pages(s, rows(card(7)), "other", NOW)
        return commit(*args, **more)

    for late in (lambda: ingest.commit_pages(s, rows(card(1)), "s1", NOW), lambda: ingest.recent_update(s, rows(card(1)), None, None, 2, NOW), lambda: ingest.stage(s, rows(card(1)), "s"), lambda: ingest.clear_all(s)):
        s.commit = overtaken
        with pytest.raises(RuntimeError, match="since"):
            late()
        assert [r["video_id"] for r in s.read("videos").collect()] == ["7"]


def test_smart_update(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.commit(empty(spark))
    feed = lambda *ids: html.listing(pages(spark, *(listing(*(card(i) for i in ids[k : k + 2])) for k in range(0, len(ids), 2))), LAYOUT, NOW)
    ingest.commit_pages(s, feed(*range(1, 9)), "s1", NOW)
    before = s.version()
    assert ingest.smart_update(s, feed(20, 21, 1, 2), 10, 2, NOW + 1, 1) == (None, "no-overlap") and s.version() == before
    assert ingest.smart_update(s, feed(20, 21, 1, 2, 3, 4), 11, 2, NOW + 1, 1) == (None, "total-mismatch")
    version, reason = ingest.smart_update(s, feed(20, 21, 1, 2, 3, 4), 10, 2, NOW + 1, 1)
    assert reason == "overlap" and version == s.version()
    order = [r["video_id"] for r in ordering.native_order(s.read("pages"), s.read("videos")).orderBy("ord").collect()]
    assert order == ["20", "21", *map(str, range(1, 9))]


def test_pictures(spark):
    """The second picture is taken from data-original, then src, then the list."""
    image = lambda **a: f'<div class="item"><a href="/video/1/x"><img {" ".join(f"{k.replace(chr(95), chr(45))}={chr(34)}{v}{chr(34)}" for k, v in a.items())}></a></div>'
    cases = [
        (dict(data_webp="/w", data_src="/d", src="/s"), ("/w", "/s")), (dict(data_src="/d", data_original="/o", src="/s"), ("/d", "/o")), (dict(src="/s"), (None, "/s")),
        (dict(srcset="/a 1x, /b 2x", data_thumb="/t"), ("/t", "/a")), (dict(data_src="/d", src="/d"), ("/d", None)),
    ]
    got = html.listing(pages(spark, listing(*(image(**a) for a, _ in cases))), LAYOUT, NOW).orderBy("native_order").collect()
    at = lambda x: x and f"https://example.com{x}"
    assert [(r["thumbnail_preferred_url"], r["thumbnail_fallback_url"]) for r in got] == [(at(a), at(b)) for _, (a, b) in cases]


def test_parts_of_detail_pages(spark):
    box = '<div data-video-id="7"><b class="label">Tags</b><span data-item-type="tag" data-video-id="7"><a href="/tags/x/">x</a></span></div>'
    up = lambda who, owner="": f'<div {owner}><span class="label">Uploaded by</span><a href="{who}">{who.split("/")[-2]}</a></div>'
    ld = '{"@type":"VideoObject","keywords":["a, b",{"name":"c"},"A"],"author":{"name":" Jo  Doe "},"interactionStatistic":[{"interactionType":{"@type":"LikeAction"},"userInteractionCount":5},{"interactionType":"https://x/CommentAction","userInteractionCount":7}]}'
    pages_ = [
        ("7", f'<body><section class="info">{box}{up("/members/12/")}{up("https://evil.com/members/13/")}{up("/members/14/", "data-video-id=8")}</section>{up("/members/15/")}<i class="remove-favourite" style="display: none"></i><i class="add-favourite"></i><a href="#tab_comments">Comments (1,204)</a></body>'),
        ("7", f'<body>{box}<script type="application/ld+json">{ld}</script><div hidden><i class="add-favourite"></i></div></body>'),
    ]
    a, b = html.details(spark.createDataFrame(pages_[:1], "video_id string, html string"), LAYOUT, NOW).first(), html.details(spark.createDataFrame(pages_[1:], "video_id string, html string"), LAYOUT, NOW).first()
    assert (a["uploaders"], a["favorite"], a["comments_count"], a["tags"]) == (["12"], False, 1204, ["x"])
    assert (b["favorite"], b["comments_count"], b["keywords"], b["author"]) == (None, 7, ["a", "b", "c"], "Jo Doe")
    assert [tuple(r) for r in html.favorite_changes(spark.createDataFrame([("1", True), ("2", False), ("3", None)], "video_id string, favorite boolean"), 4).collect()] == [("1", "add", 4), ("2", "remove", 4)]


def test_stream(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.commit(empty(spark))
    pages(spark, listing(card(1), card(2)), listing(card(3))).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("page_number int, html string").parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.stream_pages(source, s, LAYOUT, "s1", NOW, f"{tmp_path}/check").awaitTermination()
    assert s.read("videos").count() == 3


def test_details_commit(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.commit(empty(spark))
    row = "'complete' as status, 6 as schema_version, array('t') as tags"
    good = spark.sql(f"select '1' as video_id, {row}, cast(null as string) as reason, true as favorite union all select '2', {row}, null, true")
    ingest.commit_details(s, good, NOW)
    ingest.commit_details(s, good.where("video_id = '1'").withColumn("reason", F.lit("gone")).withColumn("status", F.lit("failed")), NOW + 1)
    got = {r["video_id"]: r for r in s.read("details").collect()}
    assert (got["1"]["status"], got["1"]["failure_count"], got["1"]["last_attempt_error"]["code"], got["2"]["failure_count"]) == ("complete", 1, "gone", 0)
    ingest.clear_details(s)
    assert s.read("details").count() == 0


def test_backup(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    state = empty(spark)
    videos = spark.createDataFrame([("1", "a", 5), ("2", "b", 6)], "video_id string, title string, listing_updated_at long")
    full = lambda df, like: df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(like.schema[c].dataType).alias(c) for c in like.columns))
    state["videos"] = full(videos, state["videos"])
    state["details"] = full(spark.sql("select '1' as video_id, 'queued' as status, array('A', 'a ') as tags union all select '9', 'complete', null"), state["details"])
    s.commit(state)
    backup.export(state, f"{tmp_path}/b", {"made": 1})
    r = backup.summary(state).first()
    assert (r["videos"], r["complete"]) == (2, 0) and r["bytes"] > 0
    backup.import_backup(s, f"{tmp_path}/b", "replace")
    d = s.read("details").collect()
    assert [(x["video_id"], x["status"], x["tags"]) for x in d] == [("1", "missing", ["A"])]
    backup.import_backup(s, f"{tmp_path}/b", "merge", current_ready=True)
    assert s.read("videos").count() == 2
    bad = {**state, "videos": state["videos"].withColumn("rating_percent", F.lit(120.0))}
    backup.export(bad, f"{tmp_path}/bad", {})
    before = s.version()
    with pytest.raises(ValueError, match="videos.rating"):
        backup.import_backup(s, f"{tmp_path}/bad")
    assert s.version() == before
    assert backup.imported({"a": 1, "videosPerPage": 24}, {"videosPerPage": 72}) == {"a": 1, "videosPerPage": 72}
    deep = "[" * 33 + "]" * 33
    lines = spark.createDataFrame([('{"a":1}',), ("{",), (f'{{"a":{deep}}}',), ('{"x":{"constructor":1}}',), ('{"t":"[[[{ \\" NaN"}',), ('{"a":' + "[" * 31 + "]" * 31 + "}",)], "c string")
    assert [r[0] for r in lines.select(backup.line_problems(F.col("c"))).collect()] == [[], ["no-json"], ["depth"], ["key"], [], []]
    state = backup.imported_state({"scan_status": "running", "current_page": 4, "details_state": {"status": "running"}})
    assert (state["scan_status"], state["current_page"], state["details_state"]["status"], state["last_error"]["code"]) == ("paused", None, "paused", "interrupted")
    with pytest.raises(ValueError):
        backup.imported_state({"scan_status": "flying"})


def test_import_scans_each_table_once(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    state = empty(spark)
    full = lambda df, like: df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(like.schema[c].dataType).alias(c) for c in like.columns))
    state["videos"] = full(spark.sql("select cast(id as string) as video_id, 'a' as title, 1L as listing_updated_at from range(50)"), state["videos"])
    s.commit(state)
    backup.export(state, f"{tmp_path}/b", {})
    rows, seen = backup.checked_records(spark, f"{tmp_path}/b", "videos")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "CollectMetrics" in plan and "Exchange" not in plan
    assert rows.count() == 50 and set(seen.get.values()) == {0}
    backup.import_backup(s, f"{tmp_path}/b", "merge", current_ready=True)
    assert s.read("videos").count() == 50
    drafts = tmp_path / "s" / "drafts"
    assert not drafts.exists() or not list(drafts.iterdir())


def test_import_counts_broken_lines_and_wrong_records_apart(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    s.commit(empty(spark))
    before = s.version()
    good = '{"video_id":"1","title":"a"}'
    for lines, said in (([good, "{"], "videos.no-json': 1"), ([good, ""], "videos.no-json': 1"), ([good, '{"video_id":"x"}', '{"video_id":null}'], "videos.id': 2"), ([good, '{"video_id":"2","constructor":1}'], "videos.key': 1")):
        at = str(tmp_path / f"b{abs(hash(said + str(lines)))}")
        spark.createDataFrame([(backup.FORMAT, backup.VERSION, "tables", "videos")], "format string, version int, key string, value string").coalesce(1).write.json(f"{at}/envelope")
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{at}/videos")
        with pytest.raises(ValueError, match=said):
            backup.import_backup(s, at, "replace")
        assert s.version() == before and not list((tmp_path / "s" / "drafts").iterdir())


def test_id_sets(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "video_id string")
    changes = spark.createDataFrame([("1", "toggle", 1), ("2", "add", 1), ("2", "toggle", 2), ("3", "remove", 1), ("4", "toggle", 9)], "video_id string, action string, seq int")
    assert {r[0] for r in merging.change_ids(ids("1", "3", "x", "5"), changes).collect()} == {"4", "5"}
    assert merging.same_ids(ids("1", "2"), ids("2", "1", "1")) and not merging.same_ids(ids("1"), ids("2"))
    assert merging.next_stamp(5, 9, None) == 10


def test_stored_details_and_diagnostics(spark):
    full = lambda df, like: df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(like.schema[c].dataType).alias(c) for c in like.columns))
    e = empty(spark)
    raw = spark.sql("select '1' as video_id, array(' A  b', 'a B', '') as artists, 'u' as uploader, array(named_struct('key', 'K', 'name', 'n', 'url', 'https://example.com/models/k/'), named_struct('key', 'k ', 'name', 'm', 'url', 'https://example.com/models/k/'), named_struct('key', 'x', 'name', 'm', 'url', 'bad')) as artist_refs, -3 as comments_count")
    r = backup.complete_details(full(raw, e["details"]), NOW).first()
    assert (r["artists"], r["uploaders"], r["artist"], r["comments_count"], r["fetched_at"], r["status"]) == (["A b"], ["u"], "A b", 0, NOW, "complete")
    assert [x["name"] for x in r["artist_refs"]] == ["n"]
    videos = full(spark.sql("select '1' as video_id, 'https://example.com/video/12/slug' as url union all select '2', null"), e["videos"])
    details = full(spark.sql("select '1' as video_id, 'failed' as status, named_struct('code', 'HTTP', 'message', 'm', 'http_status', 404) as last_error union all select '9', 'failed', null"), e["details"])
    got = {(x["section"], x["key"]): x["n"] for x in backup.diagnostics(videos, details).collect()}
    assert got["status", "failed"] == got["code", "HTTP"] == got["http", "404"] == got["shape", "example.com/video/#/*"] == 1
    assert sum(k[0] == "sample" for k in got) == 1


def test_settings(spark):
    from trivalent.plans import settings

    s = settings.normalize({"concurrentDetailRequests": 9, "recentUpdatePageLimit": "x", "videosPerPage": "48", "advanced": {"minimumRequestSpacingMs": 125}})
    assert (s["concurrentDetailRequests"], s["recentUpdatePageLimit"], s["videosPerPage"], s["requestPace"]) == (3, 3, 48, "faster")
    assert settings.with_pace(s, "conservative")["advanced"]["minimumRequestSpacingMs"] == 500
    assert settings.view_state({"localPage": "-4", "mode": "x"}) == {"mode": "native", "localPage": 1, "sort": {"field": "uploadDate", "direction": "desc"}}
    assert settings.membership_fresh(NOW, NOW + 1, "x", "x", 1, 1) and not settings.membership_fresh(NOW, NOW + settings.FRESH, "x", "x", 1, 1)
    assert settings.cache_key(1, {}, (), 59_999, True) == settings.cache_key(1, {}, (), 0, True) != settings.cache_key(2, {}, (), 0, True)
