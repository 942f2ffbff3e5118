"""Link graphs: breadth-first reach, scoped crawls, sitemaps, chains of next pages, blog candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions import urls as u
from tidewrack.session import staged


def reach(links: DataFrame, start: DataFrame, max_depth: int | None = 10) -> DataFrame:
    """node, depth: every node within ``max_depth`` links of ``start`` (column node), at its least depth; null is no bound.

    Each level joins the frontier with the links and takes away what was
    visited; edges and levels are written once, so lineage stays short.
    """
    edges = links.select(F.col("src").alias("node"), "dst").filter("node is not null and dst is not null and node <> dst").distinct()
    edges = staged(edges, "reach-edges")
    frontier = start.select("node").filter("node is not null").distinct().withColumn("depth", F.lit(0))
    visited = frontier = staged(frontier, "reach-0")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.select("node").join(edges, "node").select(F.col("dst").alias("node")).distinct()
        frontier = staged(found.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), f"reach-{depth}")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def in_scope(url: Column, prefix: Column) -> Column:
    """Whether an address lies under a crawl's prefix and is no binary file."""
    return url.startswith(prefix) & ~url.rlike(u.SKIPPED_FILES)


def site_crawl(links: DataFrame, start_url: str, scope: str = "prefix", max_depth: int | None = 10, max_pages: int | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """url, depth: the pages that a crawl from ``start_url`` finds, sorted by address.

    ``links`` are (src, dst) addresses; fragments, queries and closing slashes
    do not tell pages apart. Links out of scope (``prefix``: the folder of the
    start, ``domain``: its host, ``path``: the start itself), binary files and
    pages in ``blocked`` (column url) are not followed. With ``max_pages`` the
    pages nearest to the start stay, equally near ones by address.
    """
    start = links.sparkSession.createDataFrame([(start_url,)], "url string")
    prefix = u.clean_key(F.lit(start_url)) if scope == "path" else u.site_prefix(F.lit(start_url), scope)
    key = lambda c: u.clean_key(F.col(c))
    x = links.select(key("src").alias("src"), key("dst").alias("dst")).filter(in_scope(F.col("dst"), prefix))
    if blocked is not None:
        x = x.join(blocked.select(key("url").alias("dst")).distinct(), "dst", "left_anti")
    found = reach(x, start.select(key("url").alias("node")), max_depth).select(F.col("node").alias("url"), "depth")
    if max_pages is not None:
        found = found.orderBy("depth", "url").limit(max_pages)
    return found.orderBy("url")


def from_sitemaps(starts: DataFrame, sitemap: DataFrame, max_pages: int) -> DataFrame:
    """start, url: the first ``max_pages`` addresses, sorted, of the sitemap of each start's host that lie under the start.

    ``sitemap`` has site (scheme and host) and url.
    """
    under = F.regexp_replace(F.regexp_replace("start", r"[?#].*$", ""), r"/+$", "")
    x = starts.select("start", F.regexp_extract("start", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1).alias("site"), under.alias("prefix"))
    x = x.join(sitemap.select("site", "url").distinct(), "site").filter(F.col("url").startswith(F.col("prefix")))
    return x.withColumn("k", F.row_number().over(Window.partitionBy("start").orderBy("url"))).filter(F.col("k") <= max_pages).select("start", "url")


def next_chains(next_page: DataFrame, starts: DataFrame, most: int = 50) -> DataFrame:
    """start, step, url: the pages that following next links from each start gives, at most ``most``, up to the first that was seen.

    ``next_page`` has url and next. Jumps of 1, 2, 4, ... pages are joined, so
    a chain of n pages takes log n joins. A page with several next links has
    the first of them by name.
    """
    jump = next_page.filter("url is not null and next is not null").groupBy("url").agg(F.min("next").alias("next"))
    at = starts.select("start").filter("start is not null").distinct().select("start", F.lit(0).alias("step"), F.col("start").alias("url"))
    length = 1
    while length <= most:
        jump, at = staged(jump, "chain-jumps"), staged(at, "chain-pages")
        further = at.join(jump, "url").select("start", (F.col("step") + length).alias("step"), F.col("next").alias("url"))
        at = at.unionByName(further)
        jump = jump.alias("a").join(jump.alias("b"), F.col("a.next") == F.col("b.url")).select("a.url", "b.next")
        length *= 2
    # a page that comes again closes a cycle: only its first place counts
    return at.groupBy("start", "url").agg(F.min("step").alias("step")).filter((F.col("step") > 0) & (F.col("step") <= most)).select("start", "step", "url")


def blog_candidates(links: DataFrame, sitemap: DataFrame, posts: DataFrame, max_posts: int | None = None, least: float = -0.3) -> DataFrame:
    """start, url: addresses that may be posts, of the sitemap where a start has one, else of the links found on its pages.

    ``links`` and ``sitemap`` have start and url; an address is kept above the
    score ``least``. A start itself is one only if it is in ``posts`` (column
    start). With ``max_posts`` the first by address stay.
    """
    mapped = sitemap.select("start").distinct()
    x = sitemap.select("start", "url").unionByName(links.select("start", "url").join(mapped, "start", "left_anti"))
    x = x.filter(u.post_score(F.col("url")) > least).filter("url <> start").distinct()
    x = x.unionByName(posts.select("start").distinct().select("start", F.col("start").alias("url")))
    if max_posts is None:
        return x
    return x.withColumn("k", F.row_number().over(Window.partitionBy("start").orderBy("url"))).filter(F.col("k") <= max_posts).select("start", "url")
