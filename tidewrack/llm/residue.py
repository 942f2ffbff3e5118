"""Problem 1: template residue, filler, error pages and script notices.

1. Each text loses its site furniture and what accompanies residue (buttons,
   request numbers). The rest is read as a template: identifiers and numbers
   drop out, unfilled slots, names, paths, parts of a page and filler Latin
   become one mark each, and units that repeat at once count once. Texts with
   equal sets of shingles of five such words are one node.
2. Every node gets a SimHash of BITS bits over its shingles. Each of a number
   of tables keys the nodes by another selection of bits. The width of a key
   follows the number of labelled nodes, and the number of tables follows from
   the width, so that a pair of similarity SIMILARITY is found with probability
   RECALL at every size. Nodes send only keys that a labelled node has, told by
   a bitmap of bounded size.
3. Pairs from the tables are verified by Hamming distance and then by the
   Jaccard similarity of their shingles.
4. Labels start at trusted texts (TRUSTED, and texts whose own slots are
   unfilled) and spread along verified links until nothing changes: the
   connected components that hold a trusted text. Links among components
   without one are never built.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.bitmaps import in_bitmap, key_bitmap
from tidewrack.llm.furniture import is_furniture, visible_lines
from tidewrack.llm.words import WORD, WordHash, mix, shingles
from tidewrack.session import spread, staged

SIMILARITY = 0.8
SHINGLE = 5
BITS = 128
#: Share of the pairs of similarity SIMILARITY that share a table and differ in RADIUS bits at most.
RECALL = 0.93
#: Bits in which a pair may differ: 19.4 +- 4.1 at similarity 0.8, 64 +- 6 without any.
RADIUS = 30
#: Keys of labelled nodes are broadcast up to this many (44 bytes each); beyond, the join sorts both sides.
BROADCAST_KEYS = 500_000

# Forms of unfilled slots.
SLOT = re.compile(
    r"(?=[{<%@*_$#\[])(?:\{\{\{?[^{}]{1,60}\}?\}\}|\{%[^%]{1,60}%\}|<%[=-]?[^%]{1,60}%>|<<[^<>]{1,60}>>|%%[^%\s]{1,60}%%|@@[^@\s]{1,60}@@|\*\|[^|]{1,60}\|\*|(?<!\w)__\w[\w .]{0,58}?__(?!\w)|[$#]\{[^{}]{1,60}\}|\[(?=[A-Za-z])[A-Za-z][A-Za-z_.]{1,40}\](?![(\w]))"
)
SLOT_SHARE = 0.08
# Texts trusted to be residue, in English, German, French and Spanish.
TRUSTED = [
    # errors
    "Error 404: the document could not be located on this server.", "The page you asked for has moved or no longer exists.", "Oops! We looked everywhere and /notes is not here.", "Page not found", "404 Not Found", '{"error": "not_found", "status": 404}', '{"error": "not_found", "status": 404, "id": "5"}',
    "Access denied. You do not have permission to open this resource.", "403 Forbidden", "Internal Server Error", "502 Bad Gateway", "Gateway timeout", "503 Service Temporarily Unavailable. The server is down for maintenance. Please retry in 5 minutes.", "Error connecting to the database.",
    "upstream connect error or disconnect; reset reason 5", "Fatal error: Uncaught ValueException in /srv/app/main.tpl on line 5", "Warning: undefined variable $post in /srv/theme/main.tpl:5", 'Traceback (most recent call last):\nFile "/srv/app/main.py", line 5, in fetch\nTimeoutError:',
    "This video is private.", "This content is not available in your region.", "This page is no longer available.",
    "Fehler 404: Diese Seite gibt es nicht mehr.", "Seite nicht gefunden", "Leider ist hier nichts zu sehen. Die Adresse /notes ist ungültig.", "Zugriff verweigert",
    "Erreur 404 : cette page n'existe plus.", "Page introuvable", "Désolé, /notes a disparu de notre site.", "Accès refusé", "Error 404: esta página ya no existe.", "Página no encontrada", "Lo sentimos, /notes no está disponible.", "Acceso denegado",
    # scripts
    "Please enable JavaScript to view this page.", "You need to enable JavaScript to run this app.", "This site requires scripts. Turn them on in your browser settings and reload.", "Your browser does not support scripting, so nothing can be displayed here.", "Scripts are switched off. Name cannot be shown without them.",
    "noscript: interactive reader unavailable, allow scripts and cookies to go on", "Loading… If nothing happens, allow active content for Name.", "Loading…", "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "Ohne Skripte kann Name nicht angezeigt werden.",
    "Veuillez activer JavaScript pour afficher cette page.", "Les scripts sont désactivés : Name ne peut s'afficher.", "Les scripts sont désactivés : rien ne peut s'afficher.", "Active JavaScript para ver esta página.", "Sin scripts no se puede mostrar Name.",
    # sign-in, robots, limits
    "Please sign in to continue. Your session has expired.", "Subscribers only. Log in to read on.", "Your request looked automated and has been blocked.", "Too many requests. You have been rate limited; wait 5 seconds.", "Checking your browser before you proceed… this takes up to 5 seconds.", "Verify that you are human by completing the step below.", "Just a moment…",
    # filler and unwritten text
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Text text text. Text text text.", "text text text", "Blindtext Blindtext", "Blindtext", "sample paragraph sample paragraph", "asdf qwer asdf qwer", "asdf asdf", "bla bla bla", "test test", "xxx xxx xxx", "foo bar foo bar", "Hello world!", "TBD",
    "XXXX headline XXXX", "Add headline (max. 200 characters)", "This is a sample headline. Edit or delete it, then start writing!", "[Insert headline here]", "Click to edit this headline", "Your headline here. Replace this text before publishing.", "Headline goes here.", "TODO: write headline", "TK – headline to come",
]
# What accompanies residue and counts as no text of its own.
BUTTONS = ["reload", "try searching instead", "go back to the homepage", "back to the homepage", "zur startseite", "retour à l'accueil", "volver al inicio", "neu laden", "recharger", "recargar"]
NUMBERS = ["request id", "reference", "referenz", "incident", "ray id", "ray", "réf", "ref", "error id"]
# Parts of a page that templates name.
PARTS = {"article", "caption", "description", "headline", "intro", "paragraph", "summary", "title", "subtitle", "teaser"}
# Vocabulary of filler Latin.
LATIN = set(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat
    duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
    risus mattis ornare fauci faucibus congue bibend bibendum sollic sollicitudin viverra vestra vestibulum tellus eros orci lacus pretium porta elementum vel vitae nunc mauris donec pellentesque cras justo odio dapibus ac facilisis egestas nam quam ligula""".split()
)
_BUTTONS = re.compile(r"(?:^|(?<=[\s.!?…;:]))(?:" + "|".join(BUTTONS) + r")[\s.!]*$", re.I | re.M)
_NUMBERED = re.compile(r"\b(?:" + "|".join(NUMBERS) + r")[ .:#]+(?:[0-9a-f]+(?:-[0-9a-f]+)*)[\s.)]*$", re.I | re.M)
_SERVER = re.compile(r"^[a-z]{2,12}/\d+(?:\.\d+)+$", re.I | re.M)
_IDS = re.compile(r"\b(?=[0-9a-f-]*\d)[0-9a-f]{6,}(?:-[0-9a-f]{2,})*\b", re.I)
_PATHS = re.compile(r"(?<![\w/<])/[\w./-]*\w")
_BODY = re.compile(r"\bbody text\b", re.I)
_CUT = re.compile(r"</p\s*>|<br\s*/?>|</(?:div|li|h\d|td|tr)\s*>", re.I)
_SLOT_MARK = "slotmark"

_furniture = lru_cache(maxsize=200_000)(is_furniture)


def core_text(text: str) -> str:
    """The lines of a text that are no site furniture, visible text only; unfilled slots become a mark."""
    t = SLOT.sub(f" {_SLOT_MARK} ", text)
    if "<" in t:
        t = _CUT.sub("\n", t)
    return "\n".join(s for s in visible_lines(t) if s and not _furniture(s))


def template_words(core: str) -> tuple[list[str], int, int]:
    """The words of a core read as a template, how many slots it has, and how many words and slots before repeats were joined."""
    t, low = core, core.lower()
    if _IDS.search(t):
        t = _IDS.sub(" ", _NUMBERED.sub(" ", t))
    if any(map(low.__contains__, BUTTONS)):
        t = _BUTTONS.sub(" ", t)
    if "/" in t:
        t = _PATHS.sub(" path ", _SERVER.sub(" ", t))
    if "body text" in low:
        t = _BODY.sub("paragraph", t)
    raw = WORD.findall(t)
    written = set(raw)
    out: list[str] = []
    slots = total = 0
    for w in raw:
        low = w.lower()
        if low.isdigit():
            continue
        total += 1
        if low == _SLOT_MARK:
            slots += 1
        elif low in LATIN:
            low = "latin"
        elif low in PARTS:
            low = "part"
        elif low != w and out and w[0].isupper() and not w.isupper() and low not in written:
            low = "name"
        out.append(low)
        # a word or two words that repeat at once
        if len(out) > 1 and out[-1] == out[-2]:
            out.pop()
        if len(out) > 3 and out[-2:] == out[-4:-2]:
            del out[-2:]
    return out, slots, total


def template_set(core: str, hashed: WordHash) -> tuple[np.ndarray, bool]:
    """The sorted shingles of a core, and whether its own slots are unfilled."""
    words, slots, total = template_words(core)
    return np.unique(shingles(hashed(words), SHINGLE)), slots > 0 and slots >= SLOT_SHARE * total


_A, _B = (mix(np.arange(BITS // 8, dtype=np.uint64), k) for k in (71, 72))
_A |= np.uint64(1)


def simhash(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, 2) uint64: the signs of BITS sums of pseudo-random numbers, one each for every shingle; no set is empty."""
    out = np.empty((len(sets), 2), np.uint64)
    ends = np.cumsum([0, *map(len, sets)])
    a = 0
    while a < len(sets):
        # a group is one set, or has so few shingles that its numbers stay in the cache
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + 3000, "right")) - 1)
        with np.errstate(over="ignore"):
            x = np.concatenate(sets[a:b])[:, None] * _A + _B
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
        x, at = x.view(np.int8), ends[a : b + 1] - ends[a]
        sums = np.array([x[i:j].sum(axis=0, dtype=np.int32) for i, j in zip(at, at[1:])])
        # the numbers are -128 .. 127, half below their middle
        bits = sums * 2 + np.diff(at)[:, None] > 0
        out[a:b] = np.packbits(bits, axis=1).view(np.uint64)
        a = b
    return out


def table_plan(labelled: int) -> tuple[int, int]:
    """Bits of a key and number of tables for so many labelled nodes.

    A sixteenth of all keys, at most, is then that of a labelled node by chance.
    """
    width = max(10, math.ceil(math.log2(max(2, labelled))) + 4)
    # two sets of similarity s have a cosine of 2 s / (1 + s) or more, and differ in a bit with probability angle / pi
    p = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    far = np.arange(RADIUS + 1)
    weight = np.array([math.comb(BITS, k) * p**k * (1 - p) ** (BITS - k) for k in far])
    # a table takes width of the BITS, and finds a pair that differs in k of them if it takes none of these
    hit = np.array([math.comb(BITS - k, width) / math.comb(BITS, width) for k in far])
    tables = 1
    while weight @ (1 - (1 - hit) ** tables) < RECALL:
        tables = math.ceil(tables * 1.05)
    return width, tables


def table_masks(width: int, tables: int) -> np.ndarray:
    """(tables, 2) uint64: the bits that each table takes."""
    r = np.random.default_rng(5)
    masks = np.zeros((tables, BITS), np.uint8)
    for m in masks:
        m[r.permutation(BITS)[:width]] = 1
    return np.packbits(masks, axis=1).view(np.uint64)


def table_keys(prints: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """(nodes, tables) int64 keys; equal ones of different tables differ."""
    with np.errstate(over="ignore"):
        x = (prints[:, :1] & masks[:, 0]) * np.uint64(0x9E3779B97F4A7C15) + np.arange(len(masks), dtype=np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB) + (prints[:, 1:] & masks[:, 1])
    return mix(x, 3).view(np.int64)


_NODE = "tbl string, rec_id bigint, k1 bigint, k2 bigint, s1 bigint, s2 bigint, n int, trusted boolean"


def _nodes(texts: DataFrame) -> DataFrame:
    """A row of _NODE for every row whose core has words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHash()
        for b in batches:
            rows, sets = [], []
            for tbl, i, t in zip(b["tbl"], b["rec_id"], b["text"]):
                s, trusted = template_set(core_text(t), hashed)
                if len(s):
                    k1, k2 = np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64)
                    rows.append([tbl, i, int(k1), int(k2), 0, 0, len(s), trusted])
                    sets.append(s)
            for r, p in zip(rows, simhash(sets).view(np.int64).tolist()) if sets else ():
                r[4:6] = p
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _NODE.split(", ")])

    return texts.mapInPandas(run, _NODE)


def _keyed(nodes: DataFrame, masks: np.ndarray, bitmap: np.ndarray | None = None) -> DataFrame:
    """key, k1, k2, s1, s2, n: a row for every node and table; with ``bitmap`` only for keys that are in it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 4096):
                part = b.iloc[lo : lo + 4096]
                keys = table_keys(part[["s1", "s2"]].to_numpy().astype(np.int64).view(np.uint64), masks)
                if bitmap is None:
                    at, k = np.divmod(np.arange(keys.size), keys.shape[1])
                else:
                    at, k = np.nonzero(in_bitmap(bitmap, keys.view(np.uint64)))
                out = part.iloc[at]
                yield pd.DataFrame({"key": keys[at, k], **{c: out[c].to_numpy() for c in ("k1", "k2", "s1", "s2", "n")}})

    return nodes.select("k1", "k2", "s1", "s2", "n").mapInPandas(run, "key bigint, k1 bigint, k2 bigint, s1 bigint, s2 bigint, n int")


def residue_rows(sources: list[tuple[str, DataFrame, str, str]], trusted: list[str] | None = None) -> DataFrame:
    """tbl, rec_id of rows whose whole content, site furniture aside, is residue.

    ``sources`` are (tbl, table, key, text column); ``trusted`` are texts known
    to be residue, TRUSTED where not given. Null and empty texts, and texts of
    furniture only, are no cases. A real text that mentions or quotes residue
    is none. Repeated keys are judged row by row. One round labels all nodes
    one link further from a trusted one; rounds end when none is new.
    """
    spark = sources[0][1].sparkSession
    texts = spark.createDataFrame(list(enumerate(TRUSTED if trusted is None else trusted)), "rec_id bigint, text string").select(F.lit(None).cast("string").alias("tbl"), "rec_id", "text").coalesce(1)
    for tbl, df, key, text in sources:
        x = df.filter(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.lit(tbl).alias("tbl"), F.col(key).alias("rec_id"), F.col(text).alias("text"))
        texts = texts.unionByName(x)
    rows = staged(_nodes(spread(texts)), "residue-rows")
    # equal sets are one node; a hot one costs a row per map task
    first = F.min(F.struct("tbl", "rec_id"))
    node = rows.groupBy("k1", "k2").agg(F.max("trusted").alias("trusted"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("n").alias("n"), first.alias("rep"))
    node = staged(node.select("k1", "k2", "s1", "s2", "n", "trusted", "rep.tbl", "rep.rec_id"), "residue-nodes")
    # trusted texts are labelled; nodes with the set of one are found by the tables like all others
    known = staged(rows.filter("tbl is null").dropDuplicates(["k1", "k2"]).withColumn("trusted", F.lit(True)).select(*node.columns), "residue-trusted")
    front, reached = known.unionByName(node.filter("trusted")), None
    masks = table_masks(*table_plan(front.count()))
    while True:
        rest = node.filter("not trusted")
        if reached is not None:
            rest = rest.join(reached.select("k1", "k2"), ["k1", "k2"], "left_anti")
        pairs = staged(_candidates(front, rest, masks), "residue-pairs")
        if pairs.isEmpty():
            break
        linked = _verified(pairs, node, texts)
        front = staged(rest.join(linked, ["k1", "k2"], "left_semi"), "residue-new")
        if front.isEmpty():
            break
        reached = front if reached is None else reached.unionByName(front)
    found = rows.filter("trusted")
    if reached is not None:
        found = found.unionByName(rows.filter("not trusted").join(reached.select("k1", "k2"), ["k1", "k2"], "left_semi"))
    return found.filter("tbl is not null").select("tbl", "rec_id")


def _candidates(front: DataFrame, rest: DataFrame, masks: np.ndarray) -> DataFrame:
    """a1, a2 of the front and b1, b2 of the rest: pairs of a table with few unequal bits."""
    a = staged(_keyed(front, masks), "residue-keys")
    n = a.count()
    b = _keyed(rest, masks, key_bitmap(a, "key", n))
    a = a.selectExpr("key", "k1 as a1", "k2 as a2", "s1 as t1", "s2 as t2", "n as m")
    # the other side's size is not known from its scan, so the planner must not choose it
    x = b.join(F.broadcast(a) if n <= BROADCAST_KEYS else a.hint("merge"), "key")
    # the texts of a pair are alike only if their sizes are
    alike = (F.least("n", "m") >= SIMILARITY * F.greatest("n", "m") - 1e-6) & (F.expr("bit_count(s1 ^ t1) + bit_count(s2 ^ t2)") <= RADIUS)
    return x.filter(alike).selectExpr("a1", "a2", "k1 as b1", "k2 as b2").distinct()


def _verified(pairs: DataFrame, node: DataFrame, texts: DataFrame) -> DataFrame:
    """k1, k2 of the second nodes of pairs whose shingle sets reach SIMILARITY."""
    ids = pairs.selectExpr("a1 as k1", "a2 as k2").unionByName(pairs.selectExpr("b1 as k1", "b2 as k2")).distinct()
    wanted = node.join(ids, ["k1", "k2"], "left_semi").select("tbl", "rec_id")
    # the trusted texts are few and all needed
    some = texts.filter("tbl is null").unionByName(texts.join(wanted, ["tbl", "rec_id"], "left_semi"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHash()
        for b in batches:
            sets = [template_set(core_text(t), hashed)[0] for t in b["text"]]
            names = [np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64) for s in sets]
            yield pd.DataFrame({"k1": [int(k[0]) for k in names], "k2": [int(k[1]) for k in names], "s": pd.Series([s.view(np.int64) for s in sets], dtype=object)})

    sets = some.select("text").mapInPandas(run, "k1 bigint, k2 bigint, s array<bigint>").dropDuplicates(["k1", "k2"])
    x = pairs.join(sets.selectExpr("k1 as a1", "k2 as a2", "s as s_a"), ["a1", "a2"]).join(sets.selectExpr("k1 as b1", "k2 as b2", "s"), ["b1", "b2"])
    both = F.size(F.array_intersect("s", "s_a"))
    return x.filter(both >= SIMILARITY * (F.size("s") + F.size("s_a") - both) - 1e-9).selectExpr("b1 as k1", "b2 as k2").distinct()


def residue_of(items: DataFrame, feed_results: DataFrame) -> DataFrame:
    """``residue_rows`` of items.text and feed_results.content."""
    return residue_rows([("items", items, "item_id", "text"), ("feed_results", feed_results, "result_id", "content")])
