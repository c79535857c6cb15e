"""Search and manifest records: coercions, normalised candidates, statuses and short summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: What the enumerated fields of a candidate may hold.
TIME_KINDS = ("published", "platform_decoded", "archive_observed", "retrieved_at", "unknown")
MEDIA_KINDS = ("exact", "near_duplicate", "unverified_text", "not_downloaded", "failed")
STATUSES = ("verified", "unverified", "fixture", "connector_error", "unavailable")


def filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c.cast("string"), F.lit(""))


def truthy(c: Column) -> Column:
    """Text or boolean as boolean: 1, true and yes in any case are true, all else and null false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def one_of(c: Column, allowed: Sequence[str], default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def iso_time(text: Column) -> Column:
    """The instant of an ISO-8601 text; without a zone it is UTC (the session's zone), anything else is null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$"), F.try_to_timestamp(t))


def normalized_candidates(df: DataFrame, connector: str, retrieved_at: str) -> DataFrame:
    """df with every provenance field of a candidate filled; other columns stay, missing ones count as null.

    Enumerations outside their lists fall to a default, a text that is no time
    makes the kind of time unknown, and a time that is only the retrieval's is none.
    """
    has = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    synthetic = truthy(has("is_synthetic"))
    own = F.coalesce(filled(has("evidence_status")), F.when(has("status").isin(*STATUSES), has("status")), F.when(synthetic, "fixture").otherwise("unverified"))
    published = filled(has("published_at"))
    kind = one_of(F.coalesce(filled(has("timestamp_type")), F.when(published.isNotNull(), "published").otherwise("unknown")), TIME_KINDS, "unknown")
    counts = published.isNotNull() & ~kind.isin("retrieved_at", "unknown")
    broken = counts & iso_time(published).isNull()
    media = F.coalesce(filled(has("media_verification")), F.when(truthy(has("has_media")), "not_downloaded").otherwise("unverified_text"))
    made = {
        "source_connector": F.coalesce(filled(has("source_connector")), F.lit(connector)),
        "retrieved_at": F.coalesce(filled(has("retrieved_at")), F.lit(retrieved_at)),
        "published_at": F.when(counts & ~broken, published),
        "timestamp_type": F.when(broken, "unknown").otherwise(kind),
        "media_verification": one_of(media, MEDIA_KINDS, "unverified_text"),
        "evidence_status": one_of(own, STATUSES, "unverified"),
        "is_synthetic": synthetic,
        "post_url": F.trim(F.coalesce(filled(has("post_url")), filled(has("url")), F.lit(""))),
        "failure_reason": has("failure_reason"),
    }
    rest = [F.col(c) for c in df.columns if c not in made]
    return df.select(*rest, *[c.alias(n) for n, c in made.items()])


def context_choice(*sources: tuple[str, Column]) -> Column:
    """{text, source} of the first source with a text, trimmed; an empty text without source if none has."""
    out = None
    for name, c in sources:
        t = F.nullif(F.trim(c), F.lit(""))
        s = F.struct(t.alias("text"), F.lit(name).alias("source"))
        out = F.when(t.isNotNull(), s) if out is None else out.when(t.isNotNull(), s)
    return out.otherwise(F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("source")))


def connector_status(status: Column, result_count: Column, retrieved_at: Column, default: str, now: str) -> Column:
    """{status, result_count, retrieved_at}: not_run and null become the default, missing numbers 0, missing times now."""
    s = F.when(status.isNull() | (status == "not_run"), F.lit(default)).otherwise(status)
    return F.struct(s.alias("status"), F.coalesce(result_count, F.lit(0)).alias("result_count"), F.coalesce(retrieved_at, F.lit(now)).alias("retrieved_at"))


#: The branches that a modality needs.
BRANCHES = {"audio_only": ("audio",), "audio_video": ("visual", "audio", "dense_av")}


def required_branches(modality: Column) -> Column:
    """The branches of a modality; null where it is not supported."""
    out = None
    for m, names in BRANCHES.items():
        a = F.array(*map(F.lit, names))
        out = F.when(modality == m, a) if out is None else out.when(modality == m, a)
    return out


def manifest_problem(required: Sequence[str], modality: str) -> Column:
    """What is wrong with a manifest row: its first missing field, or its modality; null if nothing is."""
    missing = [F.when(filled(F.trim(F.col(c).cast("string"))).isNull(), F.concat(F.lit("missing "), F.lit(c))) for c in required]
    return F.coalesce(*missing, F.when(~F.col(modality).isin(*BRANCHES), F.concat(F.lit("unsupported modality "), F.col(modality))))


def timeline_score(selected: Column, *maps: tuple[str, Column]) -> Column:
    """{value, label}: the selected class's finite score in the first map that has one."""
    found = []
    for label, m in maps:
        v = F.try_element_at(m, selected).cast("double")
        found.append(F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.struct(v.alias("value"), F.lit(label).alias("label"))))
    return F.coalesce(*found, F.struct(F.lit(None).cast("double").alias("value"), F.lit("unavailable").alias("label")))


def sensitivity_sentence(changed: Column, stable: Column) -> Column:
    """A sentence on which branches the selected class depends on, without causal words."""
    names = lambda a: F.array_join(F.transform(a, lambda x: F.replace(x, F.lit("_"), F.lit(" "))), ", ")
    c = F.when(F.size(changed) > 0, F.concat(F.lit("The selected class changed without "), names(changed), F.lit(".")))
    s = F.when(F.size(stable) > 0, F.concat(F.lit("It stayed the same without "), names(stable), F.lit(".")))
    return F.coalesce(F.nullif(F.concat_ws(" ", c, s), F.lit("")), F.lit("No branch could be left out."))


def safe_key(value: Column, default: str = "device") -> Column:
    """Letters, digits and underscores only, none at the ends; the default if nothing is left."""
    return F.coalesce(filled(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")), F.lit(default))


def humanized(value: Column) -> Column:
    """Words for a reader: separators as blanks, each word with a capital, known abbreviations in capitals."""
    words = F.split(F.trim(F.regexp_replace(value, r"[_\s-]+", " ")), " ")

    def one(w: Column) -> Column:
        low = F.lower(w)
        return F.when(low == "oneplus", "OnePlus").when(low.isin("prnu", "exif", "jpeg"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))

    return F.array_join(F.transform(words, one), " ")


def readiness(trained: Column, labels: Column) -> Column:
    """{status, usable, demo}: ready with a trained model that is not of synthetic devices."""
    demo = F.coalesce(F.exists(labels, lambda x: F.contains(F.lower(x), F.lit("synthetic"))), F.lit(False))
    usable = F.coalesce(trained, F.lit(False)) & ~demo
    return F.struct(F.when(usable, "ready").otherwise("degraded").alias("status"), usable.alias("usable"), demo.alias("demo"))


def valid_result(labels: Sequence[str], severities: Sequence[str]) -> Column:
    """What is wrong with a structured result (label, confidence, severity, signals): null if nothing is."""
    signal = lambda s: s["name"].isNull() | (F.trim(s["name"]) == "") | ~F.coalesce(s["severity"].isin(*severities), F.lit(False))
    p = F.col("confidence")
    return F.coalesce(
        F.when(~F.coalesce(F.col("label").isin(*labels), F.lit(False)), "label"),
        F.when(p.isNull() | F.isnan(p) | (p < 0) | (p > 1), "confidence"),
        F.when(F.col("signals").isNull(), "signals"), F.when(F.exists("signals", signal), "signal"),
    )


def _filled(*names: str) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names])


def lead_view() -> Column:
    """The typed fields of an unverified lead: its url (the post's, else the page's), names and texts without empty ones, defaults for what was not stated."""
    url = _filled("post_url", "url")
    return F.struct(
        url.alias("url"), url.alias("post_url"), "platform", "account", _filled("title").alias("title"), _filled("text", "snippet").alias("text"), F.coalesce("has_media", F.lit(False)).alias("has_media"), "source_connector", "retrieved_at",
        "published_at", F.coalesce("timestamp_type", F.lit("unknown")).alias("timestamp_type"), F.coalesce("media_verification", F.lit("unverified_text")).alias("media_verification"),
        F.coalesce("evidence_status", F.lit("unverified")).alias("evidence_status"), F.coalesce("is_synthetic", F.lit(False)).alias("is_synthetic"), "failure_reason",
    )


def external_match() -> Column:
    """A candidate as a match elsewhere: its url, where it was found (connector, else platform, else unknown), when, and its title if it has one."""
    return F.struct(_filled("post_url", "url").alias("url"), F.coalesce(_filled("source_connector", "platform"), F.lit("unknown")).alias("source"), F.col("published_at").alias("date_found"), _filled("title").alias("page_title"))


#: The columns that a compact cohort record keeps, in order.
COHORT_COLUMNS = (
    "cohort", "split", "source", "identity", "component_id", "anchor_id", "paired_anchor_id", "block_id", "role", "label", "offset_frames", "actual_offsets_sec", "logit", "score", "audio_start", "mouth_start", "run_start", "run_end",
    "audio_frame_indices", "mouth_frame_indices", "audio_timestamps_sec", "mouth_timestamps_sec", "audio_contexts", "audio_padding_samples", "run_start_delta_marker", "start_mod_stride", "run_position", "matched_anchor_ids", "matched_signed_offsets",
)


def compact_records(records: DataFrame) -> DataFrame:
    """Of the columns of a cohort's record those that are there, in their fixed order; others go."""
    return records.select(*[c for c in COHORT_COLUMNS if c in records.columns])
