"""Fields of raw HTML by linear-time patterns: titles, meta tags, links, images, dates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def title(html: Column) -> Column:
    t = F.regexp_extract(html, r"(?is)<title[^>]*>([^<]*)</title>", 1)
    return F.when(t != "", F.trim(t))


def meta(html: Column, name: str) -> Column:
    """The content of <meta property|name="...">, in either order of attributes."""
    n = name.replace(".", r"\.")
    a = F.regexp_extract(html, rf"""(?is)<meta[^>]*(?:property|name)=["']{n}["'][^>]*content=["']([^"']*)""", 1)
    b = F.regexp_extract(html, rf"""(?is)<meta[^>]*content=["']([^"']*)["'][^>]*(?:property|name)=["']{n}["']""", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def links(html: Column) -> Column:
    """Distinct href values of <a>, in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?is)<a[^>]*href=["']([^"']+)"""), 1))


def image_urls(html: Column) -> Column:
    """Distinct image URLs of img, srcset, source and meta tags, in that order."""
    src = F.regexp_extract_all(html, F.lit(r"""(?is)<(?:img|source)[^>]*\ssrc=["']([^"']+)"""), 1)
    sets = F.regexp_extract_all(html, F.lit(r"""(?is)srcset=["']([^"']+)"""), 1)
    parts = F.transform(F.flatten(F.transform(sets, lambda s: F.split(s, ","))), lambda p: F.element_at(F.split(F.trim(p), r"\s+"), 1))
    og = F.array_compact(F.array(meta(html, "og:image"), meta(html, "twitter:image")))
    return F.array_distinct(F.filter(F.concat(src, parts, og), lambda u: u != ""))


def published(html: Column, url: Column) -> Column:
    """The first date there is: a meta tag, JSON-LD, the URL."""
    from tessera.functions.urls import url_date

    tag = F.coalesce(*[meta(html, n) for n in ("article:published_time", "og:published_time", "date", "pubdate")])
    ld = F.nullif(F.regexp_extract(html, r'"datePublished"\s*:\s*"([^"]+)"', 1), F.lit(""))
    return F.coalesce(F.try_to_date(F.substring(tag, 1, 10)), F.try_to_date(F.substring(ld, 1, 10)), url_date(url))


def visible_text(html: Column) -> Column:
    """Text outside scripts, styles, comments and tags, white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " "))


def exploded_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, position, href): one row a distinct link."""
    return pages.select(key, F.posexplode(links(F.col(html))).alias("position", "href"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once: inside functions over arrays Spark works a repeated expression out each time."""
    return F.transform(F.array(value), use)[0]


def _seen_from(base: Column) -> Column:
    """Scheme, host and folder of a page."""
    scheme, root, folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/[^?#]*)?/)", 1)
    down = F.when(folder.rlike("^[A-Za-z][A-Za-z0-9+.-]*://."), folder).otherwise(F.concat(root, F.lit("/")))
    return F.struct(scheme.alias("scheme"), root.alias("root"), down.alias("down"))


def _placed(url: Column, at: Column) -> Column:
    u = F.trim(url)
    return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(u.startswith("//"), F.concat(at["scheme"], u)).when(u.startswith("/"), F.concat(at["root"], u)).otherwise(F.concat(at["down"], u))


def resolved(url: Column, base: Column) -> Column:
    """url as seen from a page at base: absolute ones stay, others get the scheme, the host or the folder."""
    return _placed(url, _seen_from(base))


#: Attributes of an image tag that hold its URL, parts of class and id that tell an icon, and endings of images.
IMAGE_ATTRIBUTES = ("src", "data-src", "data-original", "data-lazy-src", "data-highres")
ICON_PARTS = "favicon|icon|logo|avatar|badge|emoji"
IMAGE_ENDING = r"(?i)\.(jpg|jpeg|png|webp)(\?|#|$)"


def attribute(tag: Column, name: str) -> Column:
    """The quoted value of a tag's attribute, or empty."""
    return F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def _set_urls(value: Column) -> Column:
    return F.transform(F.filter(F.transform(F.split(value, ","), lambda e: F.trim(e)), lambda e: e != ""), lambda e: F.split(e, r"\s+")[0])


def page_images(html: Column, base: Column) -> Column:
    """Distinct absolute image URLs of a page: image tags that are no icons, sets of sources, meta tags, links to images, and those without their resizing parameters.

    Embedded data and favicons are left out.
    """
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), 0)
    size = lambda t, n: F.coalesce(attribute(t, n).try_cast("int") < 150, F.lit(False))
    icon = lambda t: size(t, "width") | size(t, "height") | F.lower(F.concat_ws(" ", attribute(t, "class"), attribute(t, "id"))).rlike(ICON_PARTS)
    own = F.flatten(F.transform(F.filter(tags("img"), lambda t: ~icon(t)), lambda t: F.concat(F.array(*[attribute(t, a) for a in IMAGE_ATTRIBUTES]), _set_urls(attribute(t, "srcset")))))
    sets = F.flatten(F.transform(tags("source"), lambda t: _set_urls(attribute(t, "srcset"))))
    named = F.filter(tags("meta"), lambda t: F.lower(F.concat_ws(" ", attribute(t, "property"), attribute(t, "name"), attribute(t, "itemprop"))).rlike("image|contenturl|thumbnailurl"))
    metas = F.transform(named, lambda t: attribute(t, "content"))
    hrefs = F.filter(F.transform(tags("a"), lambda t: attribute(t, "href")), lambda u: u.rlike(IMAGE_ENDING))
    found = F.filter(F.concat(own, sets, metas, hrefs), lambda u: (F.trim(u) != "") & ~u.startswith("data:"))
    urls = bound(_seen_from(base), lambda at: F.array_distinct(F.filter(F.transform(found, lambda u: _placed(u, at)), lambda u: ~F.contains(F.lower(u), F.lit("favicon")))))
    bare = lambda us: F.filter(F.transform(us, lambda u: F.regexp_replace(F.regexp_replace(u, r"(?i)\?(crop|resize|width|w|quality|q)=[^#]*", ""), r"\?+$", "")), lambda u: u.rlike(IMAGE_ENDING))
    return bound(urls, lambda us: F.array_distinct(F.concat(us, bare(us))))


def embedded_post(html: Column) -> Column:
    """{url, account} of the first embedded post of a social network that a page quotes; null if there is none."""
    p = r"https?://(?:www\.)?(?:twitter|x)\.com/([A-Za-z0-9_]{1,25})/status/(\d+)"
    name, number = F.regexp_extract(html, p, 1), F.regexp_extract(html, p, 2)
    return F.when(number != "", F.struct(F.concat(F.lit("https://x.com/"), name, F.lit("/status/"), number).alias("url"), F.concat(F.lit("@"), name).alias("account")))


def lead_image(html: Column, base: Column) -> Column:
    """The page's own picture: og:image, else twitter:image, absolute."""
    found = F.coalesce(meta(html, "og:image"), meta(html, "twitter:image"))
    return F.when(found.isNotNull(), resolved(found, base))
