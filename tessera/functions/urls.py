"""URL predicates and derivations; malformed URLs give null or false, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Hosts and endings that are never public.
RESERVED_HOSTS = ("localhost", "example.com", "example.org", "example.net")
RESERVED_ENDINGS = (".local", ".internal", ".invalid", ".test", ".example", ".localhost")

PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, k)


def host(url: Column) -> Column:
    """Host in lower case, without user, port and a final dot; null if there is none."""
    h = F.regexp_replace(F.regexp_replace(F.lower(_part(url, 2)), r"^.*@", ""), r":\d*$", "")
    h = F.regexp_replace(h, r"\.+$", "")
    return F.when(h != "", h)


def public_url(url: Column, reserved: Sequence[str] = RESERVED_HOSTS, endings: Sequence[str] = RESERVED_ENDINGS) -> Column:
    """An http(s) URL whose host is a dotted name outside the reserved lists."""
    h = host(url)
    listed = F.lit(False)
    for r in reserved:
        listed = listed | (h == r) | h.endswith("." + r)
    for e in endings:
        listed = listed | h.endswith(e)
    dotted = h.contains(".") & ~h.rlike(r"^\d+(\.\d+){3}$")
    return F.coalesce(F.lower(_part(url, 1)).isin("http", "https") & dotted & ~listed, F.lit(False))


def normalize_url(url: Column) -> Column:
    """Scheme, host and path in lower case, without query, fragment and final slashes."""
    out = F.concat(_part(url, 1), F.lit("://"), _part(url, 2), F.regexp_replace(_part(url, 3), "/+$", ""))
    return F.when(_part(url, 2) != "", F.lower(out)).otherwise(F.lower(F.regexp_replace(F.trim(url), "/+$", "")))


def base_domain(url: Column) -> Column:
    """The host without any "www."."""
    return F.replace(host(url), F.lit("www."), F.lit(""))


def authoritative(domain: Column, wires: Sequence[str]) -> Column:
    """Equal to a listed domain or below one."""
    return F.exists(F.array(*map(F.lit, wires)), lambda w: (domain == w) | F.endswith(domain, F.concat(F.lit("."), w)))


def slug_words(url: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.try_url_decode(_part(url, 3)), "-_/", "   "), " +", " "))


def strip_resize(url: Column) -> Column:
    """Without the query parameters by which image hosts scale."""
    bare = F.regexp_replace(url, r"(?i)([?&])(?:w|h|width|height|quality|q|fit|crop|resize|auto|dpr)=[^&#]*", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"&{2,}", "&"), r"\?&+", "?"), r"[?&]+(?=$|#)", "")


#: Platform by host, in order.
PLATFORM_HOSTS = {
    "x": ("twitter.com", "x.com"), "reddit": ("reddit.com", "redd.it"), "youtube": ("youtube.com", "youtu.be"),
    "instagram": ("instagram.com",), "facebook": ("facebook.com", "fb.com"), "tiktok": ("tiktok.com",), "telegram": ("t.me", "telegram.org"),
}
#: First path parts that are no account names.
SYSTEM_NAMES = ("home", "search", "explore", "watch", "hashtag", "i", "share", "login", "status", "p", "reel", "r")


def platform(url: Column, hosts: dict[str, Sequence[str]] = PLATFORM_HOSTS) -> Column:
    h, out = host(url), None
    for name, ends in hosts.items():
        c = F.lit(False)
        for e in ends:
            c = c | (h == e) | h.endswith("." + e)
        out = F.when(c, name) if out is None else out.when(c, name)
    return F.coalesce(out, F.lit("web"))


def account(url: Column, system: Sequence[str] = SYSTEM_NAMES) -> Column:
    """The first path part, without @, unless it is a system name."""
    name = F.regexp_extract(_part(url, 3), r"^/(?:@|user/|u/)?([A-Za-z0-9_.]{2,30})", 1)
    return F.when((name != "") & ~F.lower(name).isin(*system), name)


def snowflake_time(post_id: Column) -> Column:
    """The time in a snowflake id."""
    return F.timestamp_millis(F.shiftright(post_id.cast("long"), 22) + F.lit(1288834974657))


def url_date(url: Column, last_modified: Column | None = None) -> Column:
    """A date by precedence: ISO in the path, compact digits, the header, year and month."""
    iso = F.try_to_date(F.concat_ws("-", *[F.nullif(F.regexp_extract(url, r"/(20\d{2})[/-](\d{1,2})[/-](\d{1,2})(?:[/_.-]|$)", k), F.lit("")) for k in (1, 2, 3)]), "yyyy-M-d")
    compact = F.try_to_date(F.nullif(F.regexp_extract(url, r"(?:^|\D)(20\d{6})(?:\D|$)", 1), F.lit("")), "yyyyMMdd")
    month = F.try_to_date(F.concat_ws("-", *[F.nullif(F.regexp_extract(url, r"/(20\d{2})/(\d{2})/", k), F.lit("")) for k in (1, 2)], F.lit("01")), "yyyy-MM-dd")
    header = F.try_to_date(last_modified) if last_modified is not None else F.lit(None).cast("date")
    return F.coalesce(iso, compact, header, month)


def text_date(text: Column) -> Column:
    """The first date of a text: ISO, else "Mon D, YYYY", else "D Mon YYYY", as yyyy-MM-dd text; days are not validated."""
    months = F.create_map(*[F.lit(x) for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1) for x in (m, f"{i:02d}")])
    iso = F.regexp_extract(text, r"\b((?:19|20)\d{2}-\d{2}-\d{2})\b", 1)
    mon = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
    of = lambda p, k: F.regexp_extract(F.lower(text), p, k)
    mdy, dmy = rf"\b{mon}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+((?:19|20)\d{{2}})\b", rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{mon},?\s+((?:19|20)\d{{2}})\b"
    a = F.when(of(mdy, 3) != "", F.concat_ws("-", of(mdy, 3), months[of(mdy, 1)], F.lpad(of(mdy, 2), 2, "0")))
    b = F.when(of(dmy, 3) != "", F.concat_ws("-", of(dmy, 3), months[of(dmy, 2)], F.lpad(of(dmy, 1), 2, "0")))
    return F.coalesce(F.when(iso != "", iso), a, b)


def meaningful_filename(name: Column) -> Column:
    """Neither a uuid, nor a camera or messenger name, nor a placeholder."""
    stem = F.lower(F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]+$", ""))
    odd = (
        stem.rlike(r"^[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}$") | stem.rlike(r"^[0-9a-f]{16,}$") | stem.rlike(r"^(img|image|dsc|dscn|pxl|vid|video|screenshot|whatsapp|photo|upload|file|download|untitled|tmp|temp)[ _-]*[0-9_ -]*(at.*)?$") | stem.rlike(r"^[0-9_ -]*$")
    )
    return F.coalesce(~odd & (F.length(F.regexp_replace(stem, "[^a-z]", "")) >= 3), F.lit(False))


#: Days in URLs, as folders, in names, as bare digits, and months as folders; in the order in which they count.
DAY = r"(20\d{2})%s(0[1-9]|1[0-2])%s(0[1-9]|[12]\d|3[01])"
URL_DAYS = ("/" + DAY % ("[-/_]", "[-/_]"), DAY % ("[-_]", "[-_]"), DAY % ("", ""))
URL_MONTH = r"/(20\d{2})/(0[1-9]|1[0-2])/"


def http_time(text: Column) -> Column:
    """The instant of an HTTP date header; null if it is none."""
    return F.try_to_timestamp(F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))


def media_time(url: Column, last_modified: Column, date: Column) -> Column:
    """When a medium was published, by the day in its URL, the Last-Modified header, the month in its URL, or the Date header."""
    days = [F.try_to_timestamp(F.concat_ws("-", *[F.nullif(F.regexp_extract(url, p, k), F.lit("")) for k in (1, 2, 3)]), F.lit("yyyy-MM-dd")) for p in URL_DAYS]
    month = F.try_to_timestamp(F.concat_ws("-", *[F.nullif(F.regexp_extract(url, URL_MONTH, k), F.lit("")) for k in (1, 2)], F.lit("01")), F.lit("yyyy-MM-dd"))
    return F.coalesce(*days, http_time(last_modified), month, http_time(date))
