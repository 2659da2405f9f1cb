"""The catalogue as a projection of the star-schema tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalogue import joined

#: 2001-12-01 UTC: the time that queries take for now.
NOW = 1_007_164_800_000
ARTISTS = 97

CATALOGUE = """
SELECT CAST(p.p_partkey AS STRING) AS video_id,
       p.p_partkey AS ord,
       p.p_name || CASE WHEN p.p_partkey % 4 = 0 THEN ' [' || p.p_brand || ']' ELSE '' END AS title,
       CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE CAST(p.p_size * 60 + p.p_partkey % 7 AS BIGINT) END AS duration_sec,
       CASE WHEN p.p_partkey % 13 = 0 THEN NULL ELSE (p.p_partkey * 7919) % 1000000 END AS views,
       CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE CAST(p.p_partkey % 101 AS DOUBLE) END AS rating_percent,
       CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE (p.p_partkey * 31) % 5000 END AS rating_votes,
       p.p_partkey % 3 = 0 AS hd_available,
       CASE p.p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'just now' WHEN 2 THEN CAST(p.p_partkey % 20 AS STRING) || ' days ago' WHEN 3 THEN 'a week ago'
            WHEN 4 THEN CAST(p.p_partkey % 30 AS STRING) || ' months ago' ELSE '2 years ago' END AS relative_upload_text,
       1007164800000 - (p.p_partkey % 90) * 86400000 AS relative_upload_observed_at,
       CASE WHEN p.p_partkey % 5 = 0 THEN 'missing' WHEN p.p_partkey % 5 = 1 THEN 'failed' ELSE 'complete' END AS status,
       CAST(CASE WHEN p.p_partkey % 7 = 0 THEN 4 WHEN p.p_partkey % 7 = 1 THEN 5 ELSE 6 END AS INT) AS schema_version,
       p.p_partkey % 9 <> 0 AS trust_artist,
       p.p_partkey % 10 <> 2 AS trust_tags,
       s1.s_name AS artist_1,
       CASE WHEN p.p_partkey % 3 = 0 THEN s2.s_name END AS artist_2,
       CASE WHEN p.p_partkey % 4 = 1 THEN CAST(s1.s_suppkey + 1 AS STRING) END AS artist_ref,
       'user ' || CAST(p.p_partkey % 50 AS STRING) AS uploader,
       p.p_type AS category,
       p.p_brand AS tag_1,
       CASE WHEN p.p_partkey % 2 = 0 THEN split_part(p.p_name, ' ', 1) ELSE split_part(p.p_name, ' ', 2) END AS tag_2,
       CASE p.p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 360 WHEN 2 THEN 480 WHEN 3 THEN 720 WHEN 4 THEN 1080 ELSE 2160 END AS max_height,
       p.p_type || ', ' || p.p_name AS description,
       CAST(l.first_ship AS STRING) AS exact_upload_date
FROM part p
LEFT JOIN supplier s1 ON s1.s_suppkey = p.p_partkey % 97
LEFT JOIN supplier s2 ON s2.s_suppkey = (p.p_partkey * 5) % 97
LEFT JOIN (SELECT l_partkey, CAST(MIN(l_shipdate) AS DATE) AS first_ship FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey
"""
#: The same with what is derived of it, for DuckDB.
ORACLE = f"""
WITH base AS ({CATALOGUE.replace("AS STRING", "AS VARCHAR")}),
c AS (SELECT *, status = 'complete' AS done, status = 'complete' AND schema_version >= 5 AND trust_artist AS ta, status = 'complete' AND schema_version >= 5 AND trust_tags AS tt,
      CASE WHEN status = 'complete' AND schema_version >= 5 AND trust_artist THEN list_distinct(list_filter([artist_1, artist_2], lambda x: x IS NOT NULL)) END AS artists,
      CASE WHEN status = 'complete' AND schema_version >= 5 AND trust_tags THEN list_distinct(list_filter([tag_1, tag_2], lambda x: x IS NOT NULL)) END AS tags,
      CASE WHEN status = 'complete' AND schema_version >= 5 AND trust_artist THEN CASE WHEN artist_ref IS NOT NULL THEN ['ref:' || artist_ref] ELSE list_distinct(list_transform(list_filter([artist_1, artist_2], lambda x: x IS NOT NULL), lambda x: 'name:' || lower(x))) END END AS tokens,
      CASE WHEN status = 'complete' THEN max_height END AS quality
      FROM base)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("part", "supplier", "lineitem")
    sql = CATALOGUE
    for n in names:
        sql = sql.replace(f"FROM {n} ", f"FROM {{{n}}} ").replace(f"JOIN {n} ", f"JOIN {{{n}}} ")
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing's table, with ord."""
    empty = [F.lit(None).cast("long").alias(c) for c in ("listing_upload_earliest_at", "listing_upload_latest_at", "listing_updated_at", "last_seen_at", "first_seen_at")]
    return flat(spark, sf_dir).select("video_id", "ord", "title", "duration_sec", "views", "rating_percent", "rating_votes", "hd_available", "relative_upload_text", "relative_upload_observed_at", *empty)


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The details' table: of every second row that is missing there is none."""
    b = flat(spark, sf_dir).where("ord % 10 <> 0")
    listed = lambda *cols: F.filter(F.array(*cols), lambda x: x.isNotNull())
    height = F.concat(F.col("max_height").cast("string"), F.lit("p"))
    formats = F.when(F.col("max_height").isNull(), F.array().cast("array<struct<name:string,format:string,quality:string,resolution:string>>")).otherwise(
        F.array(F.struct(F.concat(F.lit("mp4 "), height).alias("name"), F.lit("mp4").alias("format"), F.lit(None).cast("string").alias("quality"), height.alias("resolution")))
    )
    ref = F.struct(F.col("artist_ref").alias("key"), F.col("artist_1").alias("name"), F.concat(F.lit("https://example.com/models/"), "artist_ref", F.lit("/")).alias("url"))
    return b.select(
        "video_id", "status", "schema_version",
        F.struct(F.col("trust_artist").alias("artist"), F.col("trust_artist").alias("uploader"), F.col("trust_tags").alias("tags"), F.col("trust_tags").alias("categories")).alias("entity_trust"),
        F.col("artist_1").alias("artist"), "uploader", listed("artist_1", "artist_2").alias("artists"), F.array("uploader").alias("uploaders"),
        listed("tag_1", "tag_2").alias("tags"), F.array("category").alias("categories"),
        F.filter(F.array(ref), lambda r: r["key"].isNotNull()).alias("artist_refs"),
        "description", "exact_upload_date", formats.alias("formats"),
    )


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos with ord and ``detail``."""
    return joined(videos(spark, sf_dir), details(spark, sf_dir))


def event_ids(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select(F.col("user_id").cast("string").alias("video_id")).distinct()


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("name"))
