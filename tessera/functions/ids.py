"""Stable identifiers, list columns and safe coercions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def sample_id(path: Column, prefix: str = "fac_", digits: int = 12) -> Column:
    """prefix and the first hex digits of the SHA-1 of a path."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(path.cast("binary")), 1, digits))


def short_md5(value: Column, digits: int = 12) -> Column:
    return F.substring(F.md5(value.cast("binary")), 1, digits)


def raw_id(path: Column) -> Column:
    return F.concat(F.lit("raw_"), F.substring(F.sha2(path, 256), 1, 16))


def path_identity(path: Column) -> Column:
    """The first path part that is all of id and digits."""
    return F.try_element_at(F.filter(F.split(path, "/"), lambda p: p.rlike(r"^id\d+$")), F.lit(1))


def linked_ids(value: Column) -> Column:
    """A ;-separated list: trimmed, empties dropped, null as empty."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def group_key(identity: Column, original_id: Column, sample: Column) -> Column:
    """(kind, value) by the first usable of identity and original id, else the sample itself."""

    def usable(c: Column) -> Column:
        t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
        return F.when(~F.lower(t).isin("", "unknown", "none", "null", "n/a"), t)

    i, o = usable(identity), usable(original_id)
    kind = F.when(i.isNotNull(), "identity").when(o.isNotNull(), "original_id").otherwise("sample_id_fallback")
    return F.struct(kind.alias("kind"), F.coalesce(i, o, sample.cast("string")).alias("value"))


def finite(value: Column, default: float | None = 0.0) -> Column:
    """A finite double, else the default (null for None)."""
    d = value.try_cast("double")
    return F.coalesce(F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d), F.lit(default).cast("double"))


def fraction(value: Column, default: float = 0.0) -> Column:
    """a/b or a plain number; anything else, and a zero denominator, is the default."""
    parts = F.split(F.trim(value), "/")
    a, b = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.when(F.size(parts) == 1, F.lit(1.0)))
    return F.coalesce(F.when(F.size(parts) <= 2, F.try_divide(a, b)), F.lit(default))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first condition that holds; null if none does."""
    return F.coalesce(*[F.when(c, F.lit(r)) for c, r in checks])


def safe_filename(name: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"[^A-Za-z0-9._-]+", "_")
    return F.substring(F.regexp_replace(cleaned, r"^[._]+|[._]+$", ""), 1, 180)


def media_type(content: Column, suffix: Column) -> Column:
    """Media type by leading bytes; null where the suffix names another type."""
    head = F.hex(F.substring(content, 1, 12))
    found = (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(F.substring(head, 9, 8) == "66747970", "video/mp4").when(head.startswith("1A45DFA3"), "video/webm")
    )
    named = {"image/jpeg": ("jpg", "jpeg"), "image/png": ("png",), "image/webp": ("webp",), "video/mp4": ("mp4", "m4v", "mov"), "video/webm": ("webm", "mkv")}
    agrees = None
    for kind, ends in named.items():
        c = (found == kind) & F.lower(suffix).isin(*ends)
        agrees = c if agrees is None else agrees | c
    return F.when(agrees, found)


def redact(text: Column, secrets: list[str], mark: str = "[REDACTED]") -> Column:
    """text with every non-empty secret replaced, longest first."""
    for s in sorted({x for x in secrets if x}, key=lambda x: (-len(x), x)):
        text = F.replace(text, F.lit(s), F.lit(mark))
    return text


def redact_paths(text: Column, mark: str = "[path]") -> Column:
    """text with absolute POSIX and drive paths replaced."""
    return F.regexp_replace(text, r"(?<![\w:/])(?:[A-Za-z]:\\|/)(?:[\w.-]+[/\\])+[\w.-]+", mark)
