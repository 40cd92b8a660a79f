"""Links, images and crawl state from raw HTML, with built-in regular expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievecrest.functions.urls import resolve_url, safe_name

ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
IMAGE = r"(?is)<img\s[^>]*>"
TAG = r"(?s)<[^>]*>"


def plain_text(html: Column) -> Column:
    """Tags removed, the common entities decoded, white space collapsed."""
    text = F.regexp_replace(html, TAG, "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, text, href): every anchor with its absolute address."""
    found = pages.select(key, F.col(url).alias("_base"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(ANCHOR), F.lit(0))).alias("pos", "_a"))
    href = F.replace(F.regexp_extract("_a", ANCHOR, 1), F.lit("&amp;"), F.lit("&"))
    return found.select(key, "pos", plain_text(F.regexp_extract("_a", ANCHOR, 2)).alias("text"), resolve_url(F.col("_base"), href).alias("href"))


def _attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def page_images(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, pos, src, alt, width, height) of every image with a source; unknown sizes are 0."""
    tags = pages.select(key, F.col(url).alias("_base"), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(IMAGE), F.lit(0))).alias("pos", "_t"))
    src = _attribute(F.col("_t"), "src")
    out = tags.select(
        key, "pos", F.when(src != "", resolve_url(F.col("_base"), src)).alias("src"), _attribute(F.col("_t"), "alt").alias("alt"),
        *[F.coalesce(F.regexp_extract(_attribute(F.col("_t"), n), r"^(\d+)", 1).try_cast("int"), F.lit(0)).alias(n) for n in ("width", "height")],
    )
    return out.where(F.col("src").isNotNull())


def page_heads(pages: DataFrame, key: str = "page_id", html: str = "html", text_chars: int | None = None) -> DataFrame:
    """Title, first heading (h1, else h2) and the body text; ``text_chars`` shortens the stored text only."""
    h = F.col(html)
    title = plain_text(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))
    h1 = plain_text(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    h2 = plain_text(F.regexp_extract(h, r"(?is)<h2[^>]*>(.*?)</h2>", 1))
    body = F.regexp_replace(F.regexp_extract(h, r"(?is)<body[^>]*>(.*)</body>", 1), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", "")
    text = plain_text(body)
    if text_chars is not None:
        text = F.left(text, F.lit(text_chars))
    return pages.select(key, title.alias("title"), F.when(h1 != "", h1).otherwise(h2).alias("heading"), text.alias("text"))


def classify_links(links: DataFrame, rules: dict[str, str], key: str = "page_id") -> DataFrame:
    """First matching class of each link; links are distinct by (page, class, address)."""
    kind = None
    for name, pattern in rules.items():
        test = F.col("href").rlike(pattern)
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    tagged = links.withColumn("kind", kind).where(F.col("kind").isNotNull() & F.col("href").isNotNull())
    return tagged.groupBy(key, "kind", "href").agg(F.min_by("text", "pos").alias("text"))


def item_id(url: Column, heading: Column) -> Column:
    """Number of an ``id=`` argument, else a safe name of the heading."""
    number = F.regexp_extract(url, r"(?i)id=(\d+)", 1)
    return F.when(number != "", number).otherwise(safe_name(heading))


def frontier(discovered: DataFrame, visited: DataFrame, limit: int, href: str = "href") -> DataFrame:
    """Next addresses to visit: new ones in address order, at most ``limit`` (a distributed top-k)."""
    fresh = discovered.select(href).where(F.col(href).isNotNull()).distinct().join(visited.select(href).distinct(), href, "left_anti")
    return fresh.orderBy(href).limit(limit)


def crawl_summary(pages: DataFrame, items: DataFrame, images: DataFrame) -> DataFrame:
    """Counts of pages, items and distinct images, and the same as one JSON object."""
    n_pages = pages.agg(F.count(F.lit(1))).scalar()
    n_images = images.agg(F.count_distinct("src")).scalar()
    out = items.agg(F.count(F.lit(1)).alias("item_count")).withColumn("page_count", n_pages).withColumn("image_count", n_images)
    return out.withColumn("summary", F.to_json(F.struct("page_count", "item_count", "image_count")))
