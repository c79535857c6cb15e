"""Labels from names, folders, sizes and metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Fixed values: (visual, audio, final label, class) of each class folder.
CLASS_FOLDERS = {
    "RealVideo-RealAudio": (0, 0, 0, "REAL"), "FakeVideo-RealAudio": (1, 0, 1, "VISUAL_MANIPULATION"),
    "RealVideo-FakeAudio": (0, 1, 2, "AUDIO_MANIPULATION"), "FakeVideo-FakeAudio": (1, 1, 3, "AUDIO_VISUAL_MANIPULATION"),
}
#: Parts of file names that tell a method, in order.
METHODS = {"faceswap": "faceswap", "wav2lip": "wav2lip", "wavtolip": "wav2lip", "fsgan": "fsgan", "rtvc": "rtvc", "sv2tts": "sv2tts"}


def first_case(cases: Sequence[tuple[Column, Column | str]], default: Column | str | None = None) -> Column:
    out = F
    for c, v in cases:
        out = out.when(c, v)
    return out.otherwise(default) if default is not None else out


def class_labels(folder: Column) -> Column:
    """{visual_label, audio_label, final_label, semantic_class} of a class folder; null for another."""
    of = lambda v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("visual_label", "audio_label", "final_label", "semantic_class"))])
    return first_case([(folder == k, of(v)) for k, v in CLASS_FOLDERS.items()])


def filename_parts(name: Column) -> Column:
    """{content_id, linked, method}: what stands before the first underscore, all ids joined by ;, the method named."""
    # fixed values: the words left out, the event and the year where none is found
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(.)\.[^.]*$", "$1")
    low = F.lower(stem)
    method = first_case([(F.contains(low, F.lit(p)), m) for p, m in METHODS.items()], "unknown")
    return F.struct(F.split(stem, "_")[0].alias("content_id"), F.array_join(F.regexp_extract_all(stem, F.lit(r"id\d+"), 0), ";").alias("linked"), method.alias("method"))


def same_text(a: Column, b: str) -> Column:
    """Equal but for case and outer blanks; null is unequal."""
    return F.coalesce(F.lower(F.trim(a)) == b.strip().lower(), F.lit(False))


#: Handles of platforms, which are no suspects.
PLATFORM_HANDLES = ("@youtube", "@twitter", "@x", "@instagram", "@facebook", "@reddit", "@gmail")
#: Fixed value: how a text names the account that posted.
MENTION = r"(?i)(?:(?:post|tweet|screengrab|shared|uploaded|circulated|posted|claimed|by|handle|user)\s+(?:on\s+[\w\.]+\s+)?(?:by\s+)?|via\s+|from\s+)(@[a-zA-Z0-9_]{3,25})"


def suspect_account(text: Column) -> Column:
    """The first account that a text names as poster; null if it is a platform's own or there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), MENTION, 1)
    return F.when((found != "") & ~F.lower(found).isin(*PLATFORM_HANDLES), found)


#: Fixed value: where a video's eleven-character id stands in its URL.
VIDEO_ID = r"(?:v=|/v/|youtu\.be/|/embed/|/shorts/)([a-zA-Z0-9_-]{11})"


def media_url(url: Column, thumbnail: Column, image: Column) -> Column:
    """A medium's URL without a request: the thumbnail, the image, a video's still, or the URL itself if it is one of a medium."""
    video = F.regexp_extract(url, VIDEO_ID, 1)
    tube = (url.contains("youtube.com") | url.contains("youtu.be")) & (video != "")
    direct = F.lower(url).rlike(r"\.(jpg|jpeg|png|webp|mp4)$") | url.contains("i.redd.it") | url.contains("v.redd.it") | url.contains("i.imgur.com")
    return F.coalesce(F.nullif(thumbnail, F.lit("")), F.nullif(image, F.lit("")), F.when(tube, F.concat(F.lit("https://img.youtube.com/vi/"), video, F.lit("/hqdefault.jpg"))).when(direct, url))


#: Platform by a part of the source's label, then by a part of the URL, and the parts that tell news.
LABEL_PLATFORMS = {"instagram": "instagram", "facebook": "facebook", "twitter": "x", "x.com": "x", "reddit": "reddit", "youtube": "youtube"}
URL_PLATFORMS = {"instagram.com": "instagram", "facebook.com": "facebook", "twitter.com": "x", "x.com": "x", "reddit.com": "reddit", "youtube.com": "youtube", "youtu.be": "youtube"}
NEWS_PARTS = ("hindu", "times", "ndtv", "reuters", "express", "firstpost", "oneindia")
#: Domain by a part of the source's label, in order.
LABEL_DOMAINS = {
    "politico": "politico.com", "insider": "businessinsider.com", "bloomberg": "bloomberg.com", "reuters": "reuters.com", "associated press": "apnews.com", "ap news": "apnews.com",
    "getty": "gettyimages.com", "new york times": "nytimes.com", "nyt": "nytimes.com", "washington post": "washingtonpost.com", "wall street journal": "wsj.com", "wsj": "wsj.com",
    "abc news": "abcnews.go.com", "abcnews": "abcnews.go.com", "cnn": "cnn.com", "bbc": "bbc.com", "france 24": "france24.com", "yahoo": "yahoo.com", "sedaily": "sedaily.com",
    "reddit": "reddit.com", "facebook": "facebook.com", "instagram": "instagram.com", "twitter": "x.com", "x.com": "x.com", "youtube": "youtube.com",
}


def label_platform(url: Column, label: Column) -> Column:
    """Platform by the label, else by the URL, else news or web."""
    s, u = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    cases = [(F.contains(s, F.lit(k)), v) for k, v in LABEL_PLATFORMS.items()] + [(F.contains(u, F.lit(k)), v) for k, v in URL_PLATFORMS.items()]
    news = F.exists(F.array(*map(F.lit, NEWS_PARTS)), lambda w: F.contains(u, w))
    return first_case([*cases, (news, "news")], "web")


def label_domain(url: Column, label: Column) -> Column:
    """Domain by the label, else the URL's host unless it is a redirect of the search engine."""
    from tessera.functions.urls import base_domain

    s = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    own = base_domain(url)
    plain = own.isNotNull() & ~F.contains(own, F.lit("google."))
    cases = [(F.contains(s, F.lit(k)), v) for k, v in LABEL_DOMAINS.items()]
    return F.coalesce(first_case([*cases, (s == "x", "x.com"), (plain, own)]), F.lit("unknown"))


#: Platforms by folder name; the first that is equal, else the first that is contained, in this order.
FOLDER_PLATFORMS = {
    "original": "original", "originals": "original", "native": "original", "camera": "original", "reference": "original", "ref": "original", "original_reference": "original",
    "reference_original": "original", "original_test": "original", "test_original": "original", "whatsapp": "whatsapp", "wa": "whatsapp", "whatsapp_compressed": "whatsapp",
    "reddit": "reddit", "reddit_compressed": "reddit", "reddit_download": "reddit", "reddit_downloaded": "reddit", "telegram": "telegram", "tg": "telegram", "instagram": "instagram",
    "ig": "instagram", "instagram_compressed": "instagram", "instagram_download": "instagram", "instagram_downloaded": "instagram", "facebook": "facebook", "fb": "facebook",
    "facebook_compressed": "facebook", "facebook_download": "facebook", "facebook_downloaded": "facebook", "youtube": "youtube", "yt": "youtube",
}
#: Parts of folder names that tell the split.
REFERENCE_PARTS, TEST_PARTS = ("reference", "ref"), ("test", "query")


def folder_platform(name: Column) -> Column:
    k = F.translate(F.lower(F.trim(name)), "- ", "__")
    equal = F.try_element_at(F.create_map(*[F.lit(x) for kv in FOLDER_PLATFORMS.items() for x in kv]), k)
    inside = first_case([(F.contains(k, F.lit(a)), p) for a, p in FOLDER_PLATFORMS.items()])
    return F.coalesce(equal, inside, F.nullif(k, F.lit("")), F.lit("unknown"))


def folder_split(name: Column, platform: Column) -> Column:
    k = F.lower(F.trim(name))
    any_of = lambda parts: F.exists(F.array(*map(F.lit, parts)), lambda p: F.contains(k, p))
    own = platform == "original"
    return F.when(own & any_of(REFERENCE_PARTS), "reference").when(any_of(TEST_PARTS), "test").when(own, "train").otherwise("platform_sample")


def dimension_hints(width: Column, height: Column) -> Column:
    """Array of {label, score}: platforms whose usual sizes fit; null or non-positive sizes give none."""
    # fixed values: the sizes and scores of each platform
    long_, short = F.greatest(width, height), F.least(width, height)
    hint = lambda c, name, score: F.when((width > 0) & (height > 0) & c, F.struct(F.lit(name).alias("label"), F.lit(score).alias("score")))
    return F.array_compact(F.array(
        hint(long_.isin(1080, 1350, 1440) | (width == 1080) | (height == 1080), "instagram", 0.22),
        hint(long_.isin(720, 960, 1200, 2048), "facebook", 0.18), hint((long_ <= 1280) & (long_ < 2.2 * short), "reddit", 0.1),
    ))


#: Dates and times in file names, dashed or after the name of a source.
DASHED_TIME = r"(\d{4}-\d{2}-\d{2})[^\d]+(\d{1,2})[.\-_](\d{2})[.\-_](\d{2})"
SOURCE_DAY = r"(?:img|screenshot|photo|pxl|dsc|fb_img|mmexport|signal)[_-]?(\d{4})(\d{2})(\d{2})"


def date_hint(taken: Column, name: Column) -> Column:
    """A date and time as text: the camera's, else that in a file name, missing times as 00."""
    exif = F.nullif(F.trim(taken), F.lit(""))
    stem = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)^[a-f0-9]{32}[_-]", "")
    dashed, source = DASHED_TIME, SOURCE_DAY
    part = lambda p, k: F.regexp_extract(stem, p, k)
    whole, day = source + r"[_-]?(\d{2})(\d{2})(\d{2})", F.concat_ws("-", *[part(source, k) for k in (1, 2, 3)])
    at = lambda d, h, m, s: F.concat(d, F.lit(" "), F.lpad(h, 2, "0"), F.lit(":"), m, F.lit(":"), s)
    return F.coalesce(
        F.regexp_replace(exif, r"^([^:]*):([^:]*):", "$1-$2-"), F.when(part(dashed, 1) != "", at(*[part(dashed, k) for k in (1, 2, 3, 4)])),
        F.when(part(whole, 4) != "", at(day, *[part(whole, k) for k in (4, 5, 6)])), F.when(part(source, 1) != "", F.concat(day, F.lit(" 00:00:00"))),
    )


def device_label(make: Column, model: Column) -> Column:
    """Make and model, or the model alone where it names the make."""
    a, b = F.nullif(F.trim(make), F.lit("")), F.nullif(F.trim(model), F.lit(""))
    return F.when(~F.contains(F.lower(b), F.lower(a)), F.concat_ws(" ", a, b)).otherwise(F.coalesce(b, a))


def floor_date(text: Column, days: int = 30) -> Column:
    """The earliest date that a text's event allows: its day, else the first of its year, less `days`; null without either."""
    # fixed value: the pattern of a date
    d = r"(20[0-2][0-9])[/-](0[1-9]|1[0-2])[/-](0[1-9]|[12][0-9]|3[01])"
    whole = F.concat_ws("-", *[F.nullif(F.regexp_extract(text, d, k), F.lit("")) for k in (1, 2, 3)])
    year = F.nullif(F.regexp_extract(text, r"\b(20[0-2][0-9])\b", 1), F.lit(""))
    return F.date_sub(F.when(F.regexp_extract(text, d, 1) != "", F.try_to_date(whole)).otherwise(F.try_to_date(F.concat(year, F.lit("-01-01")))), days)


def match_role(crop: Column, distance: Column) -> Column:
    return F.when(crop == "target_is_crop_of_candidate", "uncropped_parent").when(crop == "candidate_is_crop_of_target", "derivative_crop").when((crop == "exact") | (distance <= 30), "exact_clone").otherwise("frontier")


def match_label(crop: Column, distance: Column) -> Column:
    return F.when(crop == "target_is_crop_of_candidate", "parent_master_original").when((crop == "exact") | (distance <= 30), "exact_clone").when(crop == "candidate_is_crop_of_target", "downscaled_crop").otherwise("visual_match")


def scene_tokens(name: Column) -> Column:
    """{tokens, event, year} of a file name: words of three characters or more that are no numbers; sizes and the like are no event."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(.)\.[^.]*$", "$1")
    tokens = F.filter(F.split(stem, r"[-_\s.]+"), lambda t: (F.length(t) > 2) & ~t.rlike(r"^\d+$"))
    event = F.filter(tokens, lambda t: ~F.lower(t).isin("superjumbo", "thumb", "image"))
    year = F.nullif(F.regexp_extract(stem, r"\b(20\d{2})\b", 1), F.lit(""))
    return F.struct(F.slice(tokens, 1, 5).alias("tokens"), F.coalesce(F.nullif(F.array_join(event, " "), F.lit("")), F.lit("Protest rally procession")).alias("event"), F.coalesce(year, F.lit("2021")).alias("year"))


#: Parts of a URL that tell a master copy, and a large one.
MASTER_PARTS, LARGE_PARTS = "-1x-1|master|original|highres|hires", "2200|2048|1920|1800|1600|1400|1200"


def image_rank(url: Column) -> Column:
    """0 for a master copy, 1 for a large one, 2 otherwise."""
    u = F.lower(url)
    return F.when(u.rlike(MASTER_PARTS), 0).when(u.rlike(LARGE_PARTS), 1).otherwise(2)


def page_priority(domain: Column, hop: Column, wires: Sequence[str]) -> Column:
    """0 for an agency, 1 for a page found by a visual match, 2 otherwise."""
    from tessera.functions.urls import authoritative

    return F.when(authoritative(domain, wires), 0).when(hop.rlike("exact|visual"), 1).otherwise(2)


def visual_verdict(cosine: Column, similarity: Column) -> Column:
    """{media_verification, similarity}: exact from 0.90, near_duplicate from 0.80, else failed; verified ones are lifted to 1.05 times the cosine, 0.96 at most."""
    kind = F.when(cosine >= 0.90, "exact").when(cosine >= 0.80, "near_duplicate").otherwise("failed")
    lifted = F.bround(F.least(F.lit(0.96), F.greatest(F.coalesce(similarity, F.lit(0.0)), cosine * 1.05)), 3)
    return F.struct(kind.alias("media_verification"), F.when(cosine >= 0.80, lifted).otherwise(similarity).alias("similarity"))
