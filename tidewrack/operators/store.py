"""Document store: page parsing, listing, index, line search, log tail."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions import text as t
from tidewrack.session import spread, staged

# Categories in the order of the index, and their headings.
CATEGORIES = ["concept", "entity", "summary", "comparison", "exploration", "reference"]
HEADINGS = {"concept": "Concepts", "entity": "Entities", "summary": "Summaries", "comparison": "Comparisons", "exploration": "Explorations", "reference": "References"}


def parse_pages(docs: DataFrame) -> DataFrame:
    """doc_id, title, category, tags, ingested, body of documents with a front matter that has a title, a category and a day."""
    x = docs.filter(F.col("text").startswith("---\n"))
    tags = F.regexp_replace(F.coalesce(t.header_field(F.col("text"), "tags"), F.lit("")), r"^\[|\]$", "")
    x = x.select(
        "doc_id",
        t.header_field(F.col("text"), "title").alias("title"),
        t.header_field(F.col("text"), "category").alias("category"),
        F.filter(F.transform(F.split(tags, ","), lambda s: F.trim(s)), lambda s: s != "").alias("tags"),
        F.try_to_date(t.header_field(F.col("text"), "ingested"), "yyyy-MM-dd").alias("ingested"),
        t.body(F.col("text")).alias("body"),
    )
    return x.filter("title is not null and category is not null and ingested is not null")


def list_pages(pages: DataFrame, category: str | None = None) -> DataFrame:
    """Pages in order of lower-cased title, then name."""
    x = pages if category is None else pages.filter(F.col("category") == category)
    return x.orderBy(F.lower("title"), "doc_id")


def heading(category: Column) -> Column:
    """Heading of a category; an unknown one is capitalised and gets an s."""
    out = F.concat(F.initcap(category), F.lit("s"))
    for c, h in HEADINGS.items():
        out = F.when(category == c, h).otherwise(out)
    return out


def index_lines(pages: DataFrame) -> DataFrame:
    """place, heading, entry: the index as sorted rows; configured categories come first, others by name.

    The index is a global sort, so no category is gathered in one task.
    """
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")), F.lit(0)), F.lit(len(CATEGORIES) + 1)).cast("int")
    entry = F.concat(F.lit("- ["), F.col("title"), F.lit("](pages/"), F.col("doc_id").cast("string"), F.lit(".md) ["), F.col("category"), F.lit("]"))
    x = pages.select(place.alias("place"), "category", heading(F.col("category")).alias("heading"), F.lower("title").alias("lt"), "doc_id", entry.alias("entry"))
    return x.orderBy("place", "category", "lt", "doc_id").select("place", "heading", "entry")


def search(docs: DataFrame, query: str, name: str = "doc_id", title: str = "title", tags: str = "tags", text: str = "text", per_file: int = 20, budget: int = 50, around: int = 2) -> DataFrame:
    """name, title, line_number, context of lines that contain ``query``, whatever its case.

    At most ``per_file`` matches a document; documents in order of name, and
    none is begun once ``budget`` matches are reached. A document without a
    matching line counts with its title, then its tags, as line 0. The filter
    on whole texts comes first, matches are found within the row, and every
    document kept has a match, so the first ``budget`` documents suffice for
    the running total.
    """
    q = query.lower()
    has = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    shown, tagged = F.coalesce(F.col(title), F.col(name).cast("string")), F.coalesce(F.col(tags), F.lit(""))
    in_text = has(F.col(text)) if not re.search(t.LINE_ENDS, q) else F.lit(False)  # no line contains a line end
    # every document kept has a match, so the first ones by name suffice: only they are split into lines
    x = docs.filter(in_text | has(shown) | has(tagged)).select(F.col(name).alias("name"), shown.alias("title"), tagged.alias("tags"), F.coalesce(F.col(text), F.lit("")).alias("t")).orderBy("name").limit(budget)
    # a generator binds the lines, so that no rule splits the text again at each of their uses
    x = x.select("name", "title", "tags", F.explode(F.array(t.lines(F.col("t")))).alias("l"))
    n = F.size("l")
    hits = F.filter(F.sequence(F.lit(1), n), lambda i: F.lower(F.col("l")[i - 1]).contains(q))
    context = lambda i: F.array_join(F.slice("l", F.greatest(i - around, F.lit(1)), F.least(i + around, n) - F.greatest(i - around, F.lit(1)) + 1), "\n")
    found = F.transform(F.slice(hits, 1, per_file), lambda i: F.struct(i.alias("line_number"), context(i).alias("context")))
    zero = lambda label, c: F.array(F.struct(F.lit(0).alias("line_number"), F.concat(F.lit(label), c).alias("context")))
    matches = F.when(F.size(hits) > 0, found).when(has(F.col("title")), zero("Title match: ", F.col("title"))).when(has(F.col("tags")), zero("Tag match: ", F.col("tags")))
    x = x.select("name", "title", matches.alias("matches")).filter("matches is not null")
    before = F.coalesce(F.sum(F.size("matches")).over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("before", before).filter(F.col("before") < budget)
    return x.select("name", "title", F.inline("matches"))


def log_tail(log: DataFrame, recent: int, text: str = "text") -> DataFrame:
    """Header and last ``recent`` entries of an append-only log with ``## [`` heads; 0 or more than there are gives all."""
    parts = F.split(F.col(text), r"(?=\n## \[)")
    n = F.size(parts) - 1
    keep = F.when((F.lit(recent) == 0) | (F.lit(recent) >= n), parts).otherwise(F.concat(F.slice(parts, 1, 1), F.slice(parts, -recent, recent) if recent else parts))
    return log.withColumn("tail", F.array_join(keep, ""))


# Names that no page may take.
RESERVED = ["log", "index", "conventions"]


def upsert_pages(pages: DataFrame, new: DataFrame, key: str = "name", at: str = "updated") -> DataFrame:
    """``pages`` with ``new`` put in; of one name the latest stays, of equal times the new one. Reserved and unsafe names are left out."""
    ok = new.filter(t.safe_path(F.col(key)) & ~F.col(key).isin(*RESERVED))
    both = pages.withColumn("__new", F.lit(0)).unionByName(ok.withColumn("__new", F.lit(1)))
    return both.groupBy(key).agg(F.max_by(F.struct(*[c for c in pages.columns if c != key]), F.struct(at, "__new")).alias("r")).select(key, "r.*").select(*pages.columns)


def delete_pages(pages: DataFrame, names: DataFrame, key: str = "name") -> DataFrame:
    """``pages`` without those named."""
    return pages.join(names.select(key), key, "left_anti")


def related(queries: DataFrame, docs: DataFrame, most: int = 5, block: int = 50_000) -> DataFrame:
    """query_id, doc_id, rank: for each query the first ``most`` documents that contain its phrase, whatever its case.

    Phrases go to the workers in blocks of ``block`` as one automaton each, and
    every document is scanned once a block for all of them. A task keeps the
    first ``most`` documents of a phrase, so frequent phrases cost little to
    shuffle. Null and empty phrases match nothing; a repeated query_id counts
    with all its phrases.
    """
    import pandas as pd

    spark = docs.sparkSession
    wanted = queries.select("query_id", F.lower("phrase").alias("phrase")).filter("query_id is not null and phrase <> ''")
    wanted = staged(wanted.withColumn("__block", F.floor(F.monotonically_increasing_id() % (1 << 33) / block) + F.spark_partition_id() * (1 << 20)), "related-phrases")
    texts = spread(docs.select("doc_id", "text").filter("doc_id is not null and text is not null"))
    found = None
    for (b,) in wanted.select("__block").distinct().collect():  # a number for each block of phrases
        rows = wanted.filter(F.col("__block") == b).select("query_id", "phrase").collect()  # at most ``block`` phrases
        shared = spark.sparkContext.broadcast([(r.query_id, r.phrase) for r in rows])

        def run(batches, shared=shared):
            import ahocorasick

            automaton, of = ahocorasick.Automaton(), {}
            for q, phrase in shared.value:
                of.setdefault(phrase, []).append(q)
            for phrase in of:
                automaton.add_word(phrase, phrase)
            automaton.make_automaton()
            first: dict = {}
            for x in batches:
                for i, t in zip(x["doc_id"], x["text"]):
                    for q in {q for _, phrase in automaton.iter(t.lower()) for q in of[phrase]}:
                        kept = first.setdefault(q, [])
                        if len(kept) < most or i < kept[-1]:
                            kept[:] = sorted({*kept, i})[:most]
            yield pd.DataFrame([(q, i) for q, kept in first.items() for i in kept], columns=["query_id", "doc_id"])

        kinds = dict(wanted.dtypes)["query_id"], dict(docs.dtypes)["doc_id"]
        x = texts.mapInPandas(run, f"query_id {kinds[0]}, doc_id {kinds[1]}")
        found = x if found is None else found.unionByName(x)
    if found is None:
        return wanted.join(docs.limit(0), F.lit(False)).select("query_id", "doc_id", F.lit(0).alias("rank"))
    k = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
    return found.distinct().withColumn("rank", k).filter(F.col("rank") <= most)


# Names that are no pages but views of the store.
VIRTUAL = ["index", "log", "conventions"]


def read_pages(requests: DataFrame, pages: DataFrame, sources: DataFrame, views: DataFrame) -> DataFrame:
    """``requests`` (column name) with ``text``, or with ``error`` where there is no such page.

    ``index``, ``log`` and ``conventions`` are read from ``views``, names that
    begin with sources/ from ``sources``, all others from ``pages`` (name,
    text each); an ending .md does not matter. Unsafe names are errors.
    """
    name = F.col("name")
    bare = F.regexp_replace(F.regexp_replace(name, r"^sources/", ""), r"\.md$", "")
    kind = F.when(name.isin(*VIRTUAL), "view").when(name.startswith("sources/"), "source").otherwise("page")
    store = pages.select(F.lit("page").alias("__kind"), F.col("name").alias("__key"), "text").unionByName(sources.select(F.lit("source").alias("__kind"), F.col("name").alias("__key"), "text")).unionByName(views.select(F.lit("view").alias("__kind"), F.col("name").alias("__key"), "text"))
    x = requests.withColumns({"__kind": F.when(t.safe_path(name), kind), "__key": bare}).join(store, ["__kind", "__key"], "left")
    missing = F.when(F.col("__kind") == "source", F.concat(F.lit("Source not found: "), name)).otherwise(F.concat(F.lit("Page not found: "), name))
    error = F.when(F.col("__kind").isNull(), F.concat(F.lit("Invalid path: "), name)).when(F.col("text").isNull(), missing)
    return x.select(*requests.columns, "text", error.alias("error"))


def page_names(pages: DataFrame) -> DataFrame:
    """Names of all pages, by title and name: what is shown beside a missing page."""
    return list_pages(pages).select("doc_id")


def list_lines(pages: DataFrame) -> DataFrame:
    """Pages in order as lines: name, title and category."""
    shown = F.concat(F.col("doc_id").cast("string"), F.lit(" — "), "title", F.lit(" ["), "category", F.lit("]"))
    return list_pages(pages).select("doc_id", shown.alias("line"))


def search_blocks(matches: DataFrame) -> DataFrame:
    """name, block: the matches of each document as text; a search has a bounded number of them."""
    shown = lambda m: F.concat(F.lit("  Line "), m.line_number.cast("string"), F.lit(":\n    "), F.replace(m.context, F.lit("\n"), F.lit("\n    ")))
    x = matches.groupBy("name", "title").agg(F.array_sort(F.collect_list(F.struct("line_number", "context"))).alias("m"))
    head = F.concat(F.lit("### "), F.col("name").cast("string"), F.lit(" — "), "title")
    return x.select("name", F.concat_ws("\n", head, F.array_join(F.transform("m", shown), "\n"), F.lit("")).alias("block"))


def yaml_scalar(v: Column) -> Column:
    """A string as YAML: plain where it reads as itself, in single quotes where not, in double quotes where it has line ends."""
    plain = v.rlike(r"^[\p{L}_][\p{L}\p{N} _,.()/&+'’\-]*$") & ~v.rlike(r"(?i)^(?:true|false|null|yes|no|on|off|y|n)$") & ~v.rlike(r"\s$")
    escaped = F.replace(F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.when(plain, v).when(v.rlike(r"[\n\r]"), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'")))


def render_page(title: Column, category: Column, tags: Column, sources: Column, related_to: Column, source_date: Column, ingested: Column, updated: Column, text: Column) -> Column:
    """A page as Markdown with front matter; empty lists and a null source date are left out."""
    line = lambda k, v: F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v))
    day = lambda c: F.concat(F.lit("'"), c.cast("string"), F.lit("'"))
    listed = lambda k, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{k}:\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), yaml_scalar(x))), "\n")))
    head = F.concat_ws("\n", F.lit("---"), line("title", yaml_scalar(title)), line("category", yaml_scalar(category)), listed("tags", tags), listed("sources", sources), listed("related", related_to), line("source_date", day(source_date)), line("ingested", day(ingested)), line("updated", day(updated)), F.lit("---"))
    return F.concat(head, F.lit("\n\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def _unquoted(v: Column) -> Column:
    """The string that a YAML scalar stands for."""
    double = F.replace(F.replace(F.replace(F.replace(F.replace(F.regexp_replace(v, r'^"|"$', ""), F.lit("\\\\"), F.lit("\u0001")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")), F.lit("\u0001"), F.lit("\\"))
    return F.when(v.rlike(r'^".*"$'), double).when(v.rlike("^'.*'$"), F.replace(F.regexp_replace(v, "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(v)


def read_front_matter(text: Column) -> Column:
    """STRUCT of a page's fields: lists inline or one item a line, scalars plain or quoted; body without outer white space."""
    front = F.concat(F.lit("\n"), t.front_matter(F.regexp_replace(text, r"^\s+", "")), F.lit("\n"))
    one = lambda k: F.nullif(_unquoted(F.trim(F.regexp_extract(front, rf"\n{k}:[ \t]*([^\n]*)\n", 1))), F.lit(""))
    inline = lambda k: F.split(F.regexp_extract(front, rf"\n{k}:[ \t]*\[([^\n]*)\][ \t]*\n", 1), r",[ \t]*")
    block = lambda k: F.regexp_extract_all(F.regexp_extract(front, rf"\n{k}:[ \t]*\n((?:[ \t]*- [^\n]*\n)+)", 1), F.lit(r"(?m)^[ \t]*- ([^\n]*)$"), 1)
    single = lambda k: F.when(one(k).isNotNull() & ~F.coalesce(one(k), F.lit("")).rlike(r"^\["), F.array(one(k))).otherwise(F.array().cast("array<string>"))
    values = lambda k: F.filter(F.transform(F.concat(block(k), F.filter(inline(k), lambda x: x != ""), single(k)), lambda x: _unquoted(F.trim(x))), lambda x: x != "")
    day = lambda k: F.try_to_date(one(k), "yyyy-MM-dd").alias(k)
    return F.struct(one("title").alias("title"), one("category").alias("category"), values("tags").alias("tags"), values("sources").alias("sources"), values("related").alias("related"), day("source_date"), day("ingested"), day("updated"), F.regexp_replace(t.body(F.regexp_replace(text, r"^\s+", "")), r"^\s+|\s+$", "").alias("body"))
