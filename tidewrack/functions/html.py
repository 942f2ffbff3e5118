"""Pages: one lenient parse per page in an Arrow-batched function.

The standard parser reports tags as they come; ``Node`` repairs what pages get
wrong most (paragraphs and list items left open, stray end tags, void
elements), so that all projections share one small tree.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
HIDDEN = {"script", "style", "noscript", "template", "head"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "aside", "nav", "ul", "ol", "li", "table", "tr", "td", "th", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "form", "figure"}
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "dt": {"dd", "dt"}, "dd": {"dd", "dt"}}
CONTENT_ORDER = ["data-site-canvas", "main", "role=main", "article", ".content", "#content", ".wiki-content", ".page-content", ".document-content", "body"]
TITLE_CUTS = [" | ", " - ", " — ", " – ", " :: "]
DATE_PROPERTIES = ["article:published_time", "article:published", "og:article:published_time"]
DATE_NAMES = ["date", "DC.date", "pubdate", "publish_date"]
NEXT_PHRASES = {"next", "next page", "newer posts", "next →", "next »", "older posts", "older entries", "load more"}
ARTICLE_TYPES = ("BlogPosting", "Article", "NewsArticle")
AUDIO = (".mp3", ".m4a", ".wav", ".ogg", ".aac")
MIN_CONTENT = 50


class Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def text(self, sep: str = " ") -> str:
        """Visible text, white space joined; pieces are apart by ``sep``."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if s := " ".join(n.split()):
                    out.append(s)
            elif n.tag not in HIDDEN:
                stack.extend(reversed(n.kids))
        return sep.join(out)

    def raw(self) -> str:
        return "".join(k for k in self.kids if isinstance(k, str))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        shut = CLOSES.get(tag, {"p"} if tag in BLOCKS and tag not in ("td", "th", "br") else set())
        n = self.at
        while n.parent is not None and n.tag in shut | {"b", "i", "em", "strong", "span", "a"}:
            if n.tag in shut:
                self.at = n.parent
                break
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.kids.append(data)


def parse(page: str) -> Node:
    """Tree of a page; never fails, whatever the page."""
    t = _Tree()
    try:
        t.feed(page)
        t.close()
    except Exception:  # noqa: BLE001 - a page is data; what was read so far counts
        pass
    return t.root


def _meta(root: Node, key: str, names: list[str]) -> str | None:
    for name in names:
        for m in root.find_all("meta"):
            if m.attrs.get(key, "").lower() == name.lower() and m.attrs.get("content", "").strip():
                return m.attrs["content"].strip()
    return None


def linked_data(root: Node) -> list[dict]:
    """First object of each JSON-LD script; broken ones are skipped."""
    out = []
    for s in root.find_all("script"):
        if s.attrs.get("type", "").lower() == "application/ld+json":
            try:
                v = json.loads(s.raw() or "{}")
                v = v[0] if isinstance(v, list) and v else v
                if isinstance(v, dict):
                    out.append(v)
            except ValueError:
                continue
    return out


def title_of(root: Node) -> str:
    """og:title, a heading (in the article, the main part, anywhere), or the page's title up to its first separator."""
    if t := _meta(root, "property", ["og:title"]):
        return t
    for scope in (root.find("article"), root.find("main"), root):
        if scope and (h := scope.find("h1")) and (t := h.text()):
            return t
    if n := root.find("title"):
        t = " ".join(n.raw().split())
        for cut in TITLE_CUTS:
            if cut in t:
                return t.split(cut)[0].strip()
        if t:
            return t
    return "Untitled"


def written_date_of(root: Node) -> str | None:
    """Date as written: article properties, linked data, the first time element, date names."""
    if d := _meta(root, "property", DATE_PROPERTIES):
        return d
    for v in linked_data(root):
        if isinstance(v.get("datePublished"), str):
            return v["datePublished"]
    if (t := root.find("time")) and t.attrs.get("datetime"):
        return t.attrs["datetime"]
    return _meta(root, "name", DATE_NAMES)


def author_of(root: Node) -> str | None:
    if a := _meta(root, "name", ["author"]):
        return a
    for v in linked_data(root):
        a = v.get("author")
        a = a[0] if isinstance(a, list) and a else a
        a = a.get("name") if isinstance(a, dict) else a
        if isinstance(a, str) and a.strip():
            return a.strip()
    for n in root.walk():
        if re.search(r"author|byline", n.attrs.get("class", ""), re.I):
            a = re.sub(r"^by\s+", "", n.text(), flags=re.I).strip()
            if a and len(a) < 100:
                return a
    return None


def tags_of(root: Node) -> list[str]:
    """Keywords, tag links and linked data, lower-cased, sorted, distinct, below 50 characters."""
    found: list[str] = (_meta(root, "name", ["keywords"]) or "").split(",")
    for a in root.find_all("a"):
        up, near = a, a.attrs.get("class", "")
        for _ in range(2):
            up = up.parent or up
            near += " " + up.attrs.get("class", "")
        if "tag" in a.attrs.get("rel", "").split() or re.search(r"\b(?:tags?|categor(?:y|ies)|labels?)\b", near, re.I):
            found.append(a.text())
    for v in linked_data(root):
        k = v.get("keywords")
        found += k.split(",") if isinstance(k, str) else [x for x in k if isinstance(x, str)] if isinstance(k, list) else []
    return sorted({t for x in found if (t := x.strip().lower()) and len(t) < 50})


#: Blocks whose text counts for the block around them, and what names of blocks say about their content.
TEXT_BLOCKS = {"p", "pre", "blockquote", "li", "td"}
HOLDERS = {"article", "main", "section", "div", "td", "body", "blockquote"}
GOOD_NAMES = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I)
POOR_NAMES = re.compile(r"ad-|banner|comment|cookie|crumb|footer|foot|header|menu|meta|nav|promo|related|share|sidebar|social|sponsor|subscribe|widget", re.I)


def _fit(n: Node) -> float:
    """What the tag and the names of a block say for it."""
    names = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"
    return {"article": 10.0, "main": 10.0, "section": 3.0, "div": 2.0, "td": 1.0, "blockquote": 1.0}.get(n.tag, 0.0) + (8.0 if GOOD_NAMES.search(names) else 0.0) - (12.0 if POOR_NAMES.search(names) else 0.0)


def scored_main(root: Node) -> Node | None:
    """The block with most running text of its own and little of it in links; None where no block has a paragraph.

    A paragraph of some length gives its worth (a point, its commas, its length
    up to a bound) to the block around it, and half of it to the next.
    """
    worth: dict[int, float] = {}
    holder: dict[int, Node] = {}
    for n in root.walk():
        if n.tag not in TEXT_BLOCKS or n.tag in ("nav", "footer"):
            continue
        t = n.text()
        if len(t) < 25:
            continue
        linked = sum(len(a.text()) for a in n.find_all("a"))
        gain = (1 + t.count(",") + min(len(t) / 100, 3)) * (1 - min(1.0, linked / len(t)))
        at, share = n.parent, 1.0
        while at is not None and share >= 0.5:
            if at.tag in HOLDERS:
                holder[id(at)] = at
                worth[id(at)] = worth.get(id(at), 0.0) + gain * share
                share /= 2
            at = at.parent
    best = max(worth, key=lambda k: worth[k] + _fit(holder[k]), default=None)
    return None if best is None or worth[best] <= 0 else holder[best]


def main_of(root: Node) -> Node:
    """The block with the main text, else article, main part or body, else all."""
    return scored_main(root) or root.find("article") or root.find("main") or root.find("body") or root


def content_text(root: Node) -> str:
    """Text of the first of the usual content containers with more than a little text, else of the body."""
    for rule in CONTENT_ORDER:
        for n in root.walk():
            a = n.attrs
            if (
                (rule[0] == "." and rule[1:] in a.get("class", "").split()) or (rule[0] == "#" and a.get("id") == rule[1:]) or (rule == "role=main" and a.get("role") == "main") or rule in a and rule.startswith("data-") or n.tag == rule
            ):
                if len(t := n.text("\n")) > MIN_CONTENT:
                    return t
                break
    return (root.find("body") or root).text("\n")


def markdown(node: Node) -> str:
    """Headings, paragraphs, lists, links, emphasis, code and quotes as Markdown."""

    def inline(n: Node) -> str:
        out = []
        for k in n.kids:
            if isinstance(k, str):
                out.append(re.sub(r"\s+", " ", k))
            elif k.tag in HIDDEN:
                continue
            elif k.tag in ("b", "strong") and (t := inline(k).strip()):
                out.append(f"**{t}**")
            elif k.tag in ("i", "em") and (t := inline(k).strip()):
                out.append(f"*{t}*")
            elif k.tag == "code":
                out.append(f"`{inline(k).strip()}`")
            elif k.tag == "a" and k.attrs.get("href"):
                out.append(f"[{inline(k).strip()}]({k.attrs['href'].strip()})")
            elif k.tag == "img":
                out.append(f"![{k.attrs.get('alt', '')}]({k.attrs.get('src', '')})")
            elif k.tag == "br":
                out.append("\n")
            else:
                out.append(inline(k))
        return "".join(out)

    def block(n: Node, depth: int) -> list[str]:
        out: list[str] = []
        run: list = []

        def flush() -> None:
            if run:
                holder = Node("#run", {}, None)
                holder.kids = run[:]
                if t := inline(holder).strip():
                    out.append(t)
                run.clear()

        for k in n.kids:
            if isinstance(k, str) or k.tag not in BLOCKS or k.tag == "br":
                if isinstance(k, str) or k.tag not in HIDDEN:
                    run.append(k)
                continue
            flush()
            if re.fullmatch(r"h[1-6]", k.tag):
                if t := inline(k).strip():
                    out.append("#" * int(k.tag[1]) + " " + t)
            elif k.tag in ("ul", "ol"):
                rows = []
                for i, li in enumerate([x for x in k.kids if isinstance(x, Node) and x.tag == "li"], 1):
                    body = block(li, depth + 1)
                    mark = "- " if k.tag == "ul" else f"{i}. "
                    rows.append("  " * depth + mark + ("\n".join(body) if body else ""))
                if rows:
                    out.append("\n".join(rows))
            elif k.tag == "pre":
                out.append("```\n" + k.text("\n") + "\n```")
            elif k.tag == "blockquote":
                out.append("\n".join("> " + s for s in "\n\n".join(block(k, depth)).split("\n")))
            elif k.tag == "hr":
                out.append("---")
            else:
                out += block(k, depth)
        flush()
        return out

    return "\n\n".join(block(node, 0)).strip()


def absolute(href: str, base: str) -> str:
    """Absolute address without fragment and, but for the root, without a closing slash."""
    u = urldefrag(urljoin(base, href.strip()))[0]
    return u.rstrip("/") if urlsplit(u).path not in ("", "/") else u


def links_of(root: Node, base: str) -> list[str]:
    """Distinct links to the page's own domain, absolute and sorted."""
    home = urlsplit(base).netloc.lower().removeprefix("www.")
    out = set()
    for a in root.find_all("a"):
        h = a.attrs.get("href", "").strip()
        if h and not h.startswith(("#", "javascript:", "mailto:", "tel:")):
            try:
                u = absolute(h, base)
                if urlsplit(u).netloc.lower().removeprefix("www.") == home:
                    out.add(u)
            except ValueError:
                continue
    return sorted(out)


def next_page_of(root: Node, base: str) -> str | None:
    """Link with rel=next, else one that says so in its text, else in its label."""
    anchors = [a for a in root.find_all("a", "link") if a.attrs.get("href")]
    for a in anchors:
        if "next" in a.attrs.get("rel", "").lower().split():
            return absolute(a.attrs["href"], base)
    home = urlsplit(base).netloc
    for a in anchors:
        if a.text().strip().lower() in NEXT_PHRASES and urlsplit(absolute(a.attrs["href"], base)).netloc == home:
            return absolute(a.attrs["href"], base)
    return next((absolute(a.attrs["href"], base) for a in anchors if "next" in a.attrs.get("aria-label", "").lower()), None)


def media_of(root: Node, page: str) -> str | None:
    """Embedded video or audio: frame, link, audio element, audio source, audio link, then any video address."""
    video = re.compile(r"(?:youtube\.com/(?:embed/|watch\?v=|shorts/)|youtu\.be/)")
    sound = lambda u: urlsplit(u).path.lower().endswith(AUDIO)
    picks = (
        [n.attrs.get("src", "") for n in root.find_all("iframe") if video.search(n.attrs.get("src", ""))],
        [n.attrs.get("href", "") for n in root.find_all("a") if video.search(n.attrs.get("href", ""))],
        [n.attrs["src"] for n in root.find_all("audio") if n.attrs.get("src")],
        [n.attrs["src"] for n in root.find_all("source") if sound(n.attrs.get("src", ""))],
        [n.attrs["href"] for n in root.find_all("a") if sound(n.attrs.get("href", ""))],
        re.findall(r"https?://(?:www\.)?(?:youtube\.com/watch\?v=|youtu\.be/)[\w-]+", page),
    )
    return next((p[0] for p in picks if p), None)


def page_signals(root: Node) -> tuple[float, float, float, int, list[str]]:
    """Scores of structure, length and link density, words of the main part, and the reasons."""
    why: list[str] = []
    structure = 0.0
    kinds = " ".join(" ".join(t) if isinstance(t, list) else str(t) for t in (v.get("@type", "") for v in linked_data(root)))
    for name, hit, weight in (
        ("article", root.find("article"), 0.2),
        ("time", root.find("time") or any("datetime" in n.attrs for n in root.walk()), 0.15),
        ("linked data", any(t in kinds for t in ARTICLE_TYPES), 0.3),
        ("og:type", (_meta(root, "property", ["og:type"]) or "").lower() == "article", 0.15),
        ("author", _meta(root, "name", ["author"]) or any(re.search(r"author|byline", n.attrs.get("class", ""), re.I) or n.attrs.get("rel") == "author" for n in root.walk()), 0.1),
        ("one h1", len(root.find_all("h1")) == 1, 0.1),
    ):
        if hit:
            structure += weight
            why.append(name)
    main = root.find("article") or root.find("main") or next((n for n in root.walk() if n.attrs.get("role") == "main"), None)
    text = (main or root).text()
    n = len(text.split())
    length = 0.2 if n > 1000 else 0.15 if n > 500 else -0.15 if n < 200 else 0.0
    scope = main or root.find("body")
    density = 0.0
    if scope:
        ratio = len(" ".join(a.text() for a in scope.find_all("a"))) / (len(scope.text()) or 1)
        density = -0.2 if ratio > 0.5 else 0.1 if ratio < 0.1 else 0.0
    return round(structure, 6), length, density, n, why


EXTRACTED = "title string, written_date string, author string, tags array<string>, markdown string, content string, links array<string>, next_page string, media string, structure double, length double, density double, words int, reasons array<string>"


def extract(pages: DataFrame, html: str, url: str) -> DataFrame:
    """``pages`` with a struct ``page``: every projection of a page from one parse. A null page gives null, an empty one an untitled page."""

    @F.pandas_udf(EXTRACTED)
    def run(h: pd.Series, u: pd.Series) -> pd.DataFrame:
        names = [c.split()[0] for c in EXTRACTED.split(", ")]
        rows = []
        for page, base in zip(h, u):
            if not isinstance(page, str):
                rows.append([None] * len(names))
                continue
            base = base if isinstance(base, str) else ""
            root = parse(page)
            s, n, d, words, why = page_signals(root)
            rows.append([title_of(root), written_date_of(root), author_of(root), tags_of(root), markdown(main_of(root)), content_text(root), links_of(root, base), next_page_of(root, base), media_of(root, page), s, n, d, words, why])
        return pd.DataFrame(rows, columns=names)

    return pages.withColumn("page", run(F.col(html), F.col(url)))


def post_confidence(address_score: Column, page: Column) -> Column:
    """Confidence that a page is a post: the sum of all scores, kept between 0 and 1."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), address_score + page["structure"] + page["length"] + page["density"])), 6)
