"""Links of pages: those to careers pages, to posts and to official notices, and feeds that need a key.

Rows are links with key (the page), pos, url (absolute or as written) and text, as markup.anchors gives them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import normal_url

#: Words of links to official notices, in texts and in addresses.
NOTICE_TEXTS, NOTICE_URLS = ("notif", "advert", "advt", "recruit", "apply", "detail", "download", "pdf"), ("notif", "advert", "advt", "recruit", "pdf")


def absolute(url: Column, base: Column) -> Column:
    """A link as seen from the page at base; null for fragments, scripts, mail and phone numbers. Paths with .. stay as written."""
    site = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.concat(site, F.regexp_replace(F.regexp_replace(F.substr(base, F.length(site) + 1), "[?#].*$", ""), "[^/]*$", ""))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    u = F.btrim(url)
    return (
        F.when(u.rlike("(?i)^https?://"), u)
        .when(u.rlike("(?i)^(?:#|$|[a-z][a-z0-9+.-]*:)"), F.lit(None))
        .when(u.startswith("//"), F.concat(F.regexp_extract(site, "^(https?:)", 1), u))
        .when(u.startswith("/"), F.concat(site, u))
        .otherwise(F.concat(folder, u))
    )


def first_of_each(links: DataFrame, key: str, url: str, order: list[Column]) -> DataFrame:
    """Of a page's links to one normalised address the first in order. The window holds one page's links to one address, so no page gathers."""
    same = Window.partitionBy(key, "_url").orderBy(*order)
    return links.withColumn("_url", normal_url(F.col(url))).withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_url", "_n")


def careers(links: DataFrame, key: str, url: str, text: str, pos: str, named: str, primary: str, board: Column) -> DataFrame:
    """Links whose text or address is named like a careers page, without boards; primary marks texts that certainly are, which come first."""
    said = F.col(text).rlike(f"(?i){named}") | F.regexp_replace(url, "[-_/]", " ").rlike(f"(?i){named}")
    found = first_of_each(links.where(said & ~F.coalesce(board, F.lit(False))), key, url, [F.col(pos)])
    return found.withColumn("primary", F.coalesce(F.col(text).rlike(f"(?i){primary}"), F.lit(False)))


def posts(links: DataFrame, key: str, url: str, text: str, pos: str, path: str, hint: str, other: str, pages: str, board: Column) -> DataFrame:
    """Links to posts: an address like one, a text of 4 to 140 characters with a hint of the trade, no other trade, no part of the site's menu."""
    t = F.col(text)
    good = F.col(url).rlike(f"(?i){path}") & F.length(t).between(4, 140) & t.rlike(f"(?i){hint}") & ~t.rlike(f"(?i){other}") & ~t.rlike(f"(?i)^(?:{pages})$")
    return first_of_each(links.where(good & ~F.coalesce(board, F.lit(False))), key, url, [F.col(pos)])


def official(links: DataFrame, key: str, url: str, text: str, pos: str, is_official: Column, most: int | None = None) -> DataFrame:
    """Official links with score and place on their page: 2 for a notice's text, 2 for a PDF, 1 for a notice's address; ties as they stand."""
    said = lambda c, words: F.when(F.coalesce(c.rlike("(?i)" + "|".join(words)), F.lit(False)), 1).otherwise(0)
    pdf = F.when(F.col(url).rlike(r"(?i)\.pdf(?:$|[?#])"), 2).otherwise(0)
    scored = links.where(is_official).withColumn("score", 2 * said(F.col(text), NOTICE_TEXTS) + pdf + said(F.col(url), NOTICE_URLS))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy(key, url).orderBy(F.desc("score"), pos))).where("_n = 1").drop("_n")
    ranked = best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), pos)))
    return ranked if most is None else ranked.where(F.col("place") <= most)


def adapter(url: Column, hosts: dict[str, str], otherwise: str = "generic") -> Column:
    """The name of the first adapter whose host pattern matches; null where there is no host."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(host.isNotNull(), F.coalesce(*[F.when(host.rlike(p), F.lit(n)) for n, p in hosts.items()], F.lit(otherwise)))


def keyed(feeds: dict[str, tuple[str | None, Callable[[str], DataFrame]]], columns: list[str]) -> DataFrame | None:
    """The columns and _source of the feeds that have a key, each read with its key; the others are never asked. None where no feed has one."""
    read = [load(secret).select(*columns, F.lit(name).alias("_source")) for name, (secret, load) in feeds.items() if secret]
    return reduce(DataFrame.unionByName, read) if read else None
