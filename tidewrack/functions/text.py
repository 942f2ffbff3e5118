"""Text columns: counts, slugs, names, headers, marks and lines, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[ \t\n\r\f\x0B]+"
BATCH_MARK = "---CONTENT_ITEM---"
#: Line ends as text editors and str.splitlines() know them.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def word_count(text: Column) -> Column:
    """Number of words between white space; 0 for null and empty."""
    return F.coalesce(F.size(F.filter(F.split(text, WHITE), lambda w: w != "")), F.lit(0))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, WHITE), lambda w: w != ""), 1, n), " ")


def preview(text: Column, n: int = 200) -> Column:
    """The first ``n`` characters."""
    return F.substring(text, 1, n)


def slug(title: Column, max_length: int = 80) -> Column:
    """File-name-safe form: lower case, letters a-z, digits and single hyphens, at most ``max_length`` characters."""
    s = F.regexp_replace(F.lower(title), r"[^a-z0-9 \-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s_]+", "-"), r"-+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, max_length), r"-+$", "")


def page_slug(title: Column) -> Column:
    """Slug, or ``page-`` and eight digits of an MD5 where nothing is left."""
    s = slug(title)
    return F.when(s == "", F.concat(F.lit("page-"), F.substring(F.md5(title), 1, 8))).otherwise(s)


def strip_html(s: Column, n: int = 300) -> Column:
    """Text without tags, trimmed, cut to ``n`` characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(s, r"<[^>]+>", ""), r"^\s+|\s+$", ""), 1, n)


def extract_urls(text: Column) -> Column:
    """Distinct addresses in a text, in order; without closing punctuation, unsubscribe and mail links."""
    found = F.regexp_extract_all(text, F.lit(r"""(https?://[^\s<>"')\]]+)"""), 1)
    found = F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", ""))
    return F.array_distinct(F.filter(found, lambda u: ~F.lower(u).contains("unsubscribe") & ~F.lower(u).contains("mailto:")))


def sender_domain(sender: Column) -> Column:
    """Domain of an address with or without a name, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(sender, r"^.*<([^<>]*)>.*$", "$1"), r"@([^\s@<>]+)\s*$", 1))


def domain_suffixes(domain: Column) -> Column:
    """A domain and all domains above it: a.b.c gives a.b.c, b.c, c."""
    parts = F.split(domain, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def duration(seconds: Column) -> Column:
    """H:MM:SS, or M:SS below an hour."""
    s = seconds.cast("bigint")
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def timestamp_mark(seconds: Column) -> Column:
    """[HH:MM:SS], fractions dropped."""
    s = F.floor(seconds).cast("bigint")
    return F.format_string("[%02d:%02d:%02d]", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def speaker_label(s: Column) -> Column:
    """``SPEAKER_03`` to ``Speaker 4``; what has no number after the last underscore stays."""
    n = F.regexp_extract(s, r"_(\d+)$", 1)
    return F.when(n == "", s).otherwise(F.concat(F.lit("Speaker "), (n.try_cast("int") + 1).cast("string")))


def cue_mark(s: Column) -> Column:
    """Start of a subtitle time, HH:MM:SS.mmm or MM:SS, as [HH:MM:SS]."""
    h, m, sec = (F.regexp_extract(s, r"^\s*(?:(\d+):)?(\d{1,2}):(\d{2})", k) for k in (1, 2, 3))
    return F.concat(F.lit("["), F.lpad(F.when(h == "", "0").otherwise(h), 2, "0"), F.lit(":"), F.lpad(m, 2, "0"), F.lit(":"), sec, F.lit("]"))


def clean_title(title: Column) -> Column:
    """Page title without its site's name: the part after the right-most separator, if at most 40 characters long."""
    return F.regexp_replace(title, r"^(.+) [-|—–] (?:(?! [-|—–] ).){0,40}$", "$1")


def header(title: Column, source_url: Column, content_type: Column, day: Column, author: Column, tags: Column, length: Column, channel: Column, words: Column) -> Column:
    """Front matter of a record; what is null, empty or 0 is left out."""
    line = lambda k, v, quoted=False: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}: "), F.concat(F.lit('"'), v, F.lit('"')) if quoted else v))
    listed = F.when(F.size(tags) > 0, F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]")))
    count = F.when(words > 0, F.concat(F.lit("word_count: "), words.cast("string")))
    return F.concat_ws("\n", F.lit("---"), line("title", title, True), line("source_url", source_url), line("content_type", content_type), line("date", day), line("author", author, True), listed, line("duration", length, True), line("channel", channel, True), count, F.lit("---"))


def front_matter(text: Column) -> Column:
    """Text between the first two lines ``---``; empty where the text does not begin with one."""
    return F.regexp_extract(text, r"^---\n([\s\S]*?)\n---(?:\n|$)", 1)


def header_field(text: Column, key: str) -> Column:
    """Value of ``key`` in the front matter, without quotes; null where absent."""
    v = F.regexp_extract(F.concat(F.lit("\n"), front_matter(text), F.lit("\n")), rf"\n{key}:[ \t]*([^\n]*)\n", 1)
    return F.nullif(F.regexp_replace(F.trim(v), r'^"(.*)"$', "$1"), F.lit(""))


def body(text: Column) -> Column:
    """Text after the front matter."""
    return F.regexp_replace(text, r"^---\n[\s\S]*?\n---(?:\n|$)", "")


def clean_markdown(s: Column) -> Column:
    """Blank lines thinned to two, layout tags dropped, links joined, line ends and text ends trimmed."""
    s = F.regexp_replace(s, r"\n{4,}", "\n\n\n")
    s = F.regexp_replace(s, r"(?i)</?(?:div|span|section|header|footer|aside)[^>]*>", "")
    s = F.regexp_replace(s, r"\[([^\]]*)\]\(\s*([^)\s]*)\s*\)", "[$1]($2)")
    return F.regexp_replace(F.regexp_replace(s, r"(?m)[ \t]+$", ""), r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """Lines of a text; a final line end opens no further line."""
    return F.split(F.regexp_replace(text, rf"(?:{LINE_ENDS})\z", ""), LINE_ENDS, -1)


def strip_fence(s: Column) -> Column:
    """A reply without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"^```(?:\w+)?[ \t]*\n?", ""), r"\n?```\s*$", "")


def safe_path(p: Column) -> Column:
    """Whether a name stays inside its folder: no leading slash, no step upwards."""
    return ~(p.startswith("/") | p.contains(".."))


def repair_header(text: Column) -> Column:
    """Front matter whose title is quoted; the rest stays as it is."""
    return F.regexp_replace(text, r'(?m)\A(---\n(?:(?!---$)[^\n]*\n)*?title:[ \t]*)(?!["\s])([^\n]*?)[ \t]*$', '$1"$2"')
