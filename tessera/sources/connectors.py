"""Search responses as candidates: JSON payloads of stated schemas, exploded on the executors. The requests themselves are made elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.labels import suspect_account
from tessera.functions.urls import account, base_domain, platform, snowflake_time

REDDIT = "data struct<children: array<struct<data: struct<author: string, permalink: string, title: string, created_utc: double, url: string>>>>"
POSTS = "data array<struct<id: string, text: string, author_id: string>>, includes struct<users: array<struct<id: string, username: string>>>"
VIDEOS = "items array<struct<id: struct<videoId: string>, snippet: struct<title: string, channelTitle: string, publishedAt: string>>>"
WEB = "results array<struct<title: string, href: string, body: string>>"
IMAGES = "hits array<struct<url: string, image: string, title: string, score: double>>"


def _rows(df: DataFrame, key: str, payload: str, schema: str, items) -> DataFrame:
    """(key, place, item) of every element of an array in the payload; malformed payloads give none."""
    parsed = df.select(key, F.from_json(payload, schema).alias("p"))
    return parsed.select(key, F.posexplode(items(F.col("p"))).alias("place", "item"))


def _candidate(key: str, platform_: Column, account_: Column, url: Column, title: Column, published: Column, kind: str, media: Column) -> list[Column]:
    return [
        F.col(key), F.col("place"), platform_.alias("platform"), account_.alias("account"), url.alias("post_url"), title.alias("title"), published.alias("published_at"),
        F.when(published.isNotNull(), kind).otherwise("unknown").alias("timestamp_type"), media.alias("media_url"),
    ]


def reddit_posts(df: DataFrame, key: str, payload: str) -> DataFrame:
    rows = _rows(df, key, payload, REDDIT, lambda p: p["data"]["children"])
    i = F.col("item")["data"]
    media = F.when(F.lower(i["url"]).rlike(r"\.(jpg|jpeg|png|webp|gif)$|i\.redd\.it|v\.redd\.it"), i["url"])
    return rows.select(*_candidate(key, F.lit("reddit"), F.concat(F.lit("u/"), i["author"]), F.concat(F.lit("https://www.reddit.com"), i["permalink"]), i["title"], F.timestamp_seconds(i["created_utc"]), "published", media))


def x_posts(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Posts with their authors' names; the time is the one in the post's id."""
    parsed = df.select(key, F.from_json(payload, POSTS).alias("p"))
    names = F.map_from_arrays(F.transform("p.includes.users", lambda u: u["id"]), F.transform("p.includes.users", lambda u: u["username"]))
    rows = parsed.select(key, F.coalesce(names, F.create_map().cast("map<string,string>")).alias("names"), F.posexplode("p.data").alias("place", "item"))
    i = F.col("item")
    name = F.coalesce(F.try_element_at("names", i["author_id"]), i["author_id"])
    return rows.select(*_candidate(key, F.lit("x"), F.concat(F.lit("@"), name), F.concat(F.lit("https://x.com/"), name, F.lit("/status/"), i["id"]), i["text"], snowflake_time(i["id"]), "platform_decoded", F.lit(None).cast("string")))


def youtube_videos(df: DataFrame, key: str, payload: str) -> DataFrame:
    rows = _rows(df, key, payload, VIDEOS, lambda p: p["items"]).where("item.id.videoId is not null")
    i, v = F.col("item")["snippet"], F.col("item")["id"]["videoId"]
    return rows.select(*_candidate(key, F.lit("youtube"), i["channelTitle"], F.concat(F.lit("https://www.youtube.com/watch?v="), v), i["title"], F.try_to_timestamp(i["publishedAt"]), "published", F.concat(F.lit("https://img.youtube.com/vi/"), v, F.lit("/hqdefault.jpg"))))


def web_pages(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Pages with platform and account by URL; an account that the text names as poster goes before the page's own."""
    rows = _rows(df, key, payload, WEB, lambda p: p["results"]).where("item.href is not null")
    i = F.col("item")
    named = suspect_account(F.concat_ws(" ", i["title"], i["body"]))
    own = F.coalesce(account(i["href"]), base_domain(i["href"]))
    who = F.when(named.isNotNull(), F.concat(named, F.lit(" (via "), base_domain(i["href"]), F.lit(")"))).otherwise(own)
    none = F.lit(None)
    return rows.select(*_candidate(key, platform(i["href"]), who, i["href"], i["title"], none.cast("timestamp"), "unknown", none.cast("string")))


def image_hits(df: DataFrame, key: str, payload: str, least: float = 0.0) -> DataFrame:
    """Hits of an image index with a score of `least` or more."""
    rows = _rows(df, key, payload, IMAGES, lambda p: p["hits"]).where(F.coalesce(F.col("item.score"), F.lit(0.0)) >= least)
    i = F.col("item")
    return rows.select(*_candidate(key, platform(i["url"]), base_domain(i["url"]), i["url"], i["title"], F.lit(None).cast("timestamp"), "unknown", i["image"]))
