"""Problem 10: subject areas of documents.

One-versus-rest linear classifiers on hashed word n-grams (single words and
pairs), fitted by logistic regression on a bounded sample of weakly labelled
documents. The classifiers are linear, so their weights also score single
sentences; a second fit on the sample's sentences, labelled by the first,
teaches them which sentences have no subject. A document's subjects are those
that enough of its sentences are about: how strong a sentence must be, how
many there must be and which share of the sentences with any subject is
calibrated on a held-out quarter of the sample. A passing sentence stays below
these thresholds, and everyday sentences reach none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.leakage import MARKS
from tidewrack.llm.words import WordHash, mix
from tidewrack.session import spread

BITS = 16
DUMMY = 1 << BITS
#: At most so many labelled documents are fitted on, taken in order of a hash of their ids.
MAX_LABELLED = 4000
_ALPHA = re.compile(r"[^\W\d_]+")
_FRONT = re.compile(r"\A---\n.*?\n---\n", re.S)
_HEADER = re.compile(r"^WEBVTT.*$", re.M)
_HEADING = re.compile(r"^#+ .*$", re.M)
_BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*\n")


def sentences(text: str) -> list[str]:
    """Sentences of a text without front matter, marks and caption times; headings stand alone."""
    captions = "-->" in text
    t = _HEADER.sub("\n\n", MARKS.sub(" ", _FRONT.sub("", text, count=1)))
    t = _HEADING.sub(lambda m: f"\n\n{m.group(0)}\n\n", t)
    t = re.sub(r"\s*\n\s*", " ", t) if captions else t
    return [s for s in _BREAK.split(t) if s.strip()]


@dataclass
class Bags:
    """Features of sentences, flat: two per word (itself, and its pair with the next word; DUMMY at a sentence's end)."""

    words: np.ndarray
    pairs: np.ndarray
    starts: np.ndarray  # of each sentence, into the words
    sentences: np.ndarray  # number of sentences of each document

    @staticmethod
    def of(texts, hashed: WordHash) -> Bags:
        words: list[str] = []
        lengths: list[int] = []
        per_doc = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if isinstance(t, str):
                for s in sentences(t):
                    w = _ALPHA.findall(s.lower())
                    if w:
                        words += w
                        lengths.append(len(w))
                        per_doc[k] += 1
        h = hashed(words)
        size = np.array(lengths, np.int64)
        ends = np.cumsum(size)
        shift = np.uint64(64 - BITS)
        with np.errstate(over="ignore"):
            pairs = (mix(h * np.uint64(3) + np.concatenate([h[1:], h[:1]]), 2) >> shift).astype(np.int32) if len(h) else np.zeros(0, np.int32)
        pairs[ends - 1] = DUMMY
        return Bags((mix(h, 1) >> shift).astype(np.int32), pairs, ends - size, per_doc)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Score of every sentence for every subject."""
        if not len(self.starts):
            return np.zeros((0, weights.shape[1]), weights.dtype)
        return np.add.reduceat(weights[self.words] + weights[self.pairs], self.starts, axis=0)

    def rows(self, by_document: bool) -> tuple[np.ndarray, np.ndarray]:
        """(feature, row) of all features but DUMMY; rows are documents or sentences."""
        n = np.diff(np.concatenate([self.starts, [len(self.words)]]))
        row = np.repeat(np.arange(len(n)), n)
        if by_document:
            row = np.repeat(np.arange(len(self.sentences)), self.sentences)[row]
        f, r = np.concatenate([self.words, self.pairs]), np.concatenate([row, row])
        keep = f != DUMMY
        return f[keep].astype(np.int64), r[keep]


@dataclass
class SubjectModel:
    subjects: list[str]
    weights: np.ndarray  # features x subjects
    strength: float = 1.0
    least_sentences: int = 2
    least_share: float = 0.25

    def counts(self, bags: Bags, strength: float | None = None, scores: np.ndarray | None = None) -> np.ndarray:
        """Sentences about each subject, per document (one row each)."""
        z = bags.scores(self.weights) if scores is None else scores
        out = np.zeros((len(bags.sentences), len(self.subjects)), np.int32)
        if len(z):
            best = z.argmax(axis=1)
            ok = z[np.arange(len(z)), best] > (self.strength if strength is None else strength)
            doc = np.repeat(np.arange(len(bags.sentences)), bags.sentences)
            np.add.at(out, (doc[ok], best[ok]), 1)
        return out

    def decide(self, counts: np.ndarray, sizes: np.ndarray, least: int | None = None, share: float | None = None) -> np.ndarray:
        """Main subjects from ``counts`` of documents of ``sizes`` sentences; where less than ``least`` can be had, half of the sentences must do."""
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        enough = (counts >= (self.least_sentences if least is None else least)) | (2 * counts >= np.maximum(sizes, 1)[:, None])
        return enough & (counts / total >= (self.least_share if share is None else share)) & (counts > 0)


def _fit_sentences(bags: Bags, y: np.ndarray, sure: float = 4.0, none: float = 2.0) -> np.ndarray:
    """Weights that score sentences: the document classifiers label those they are sure of, as a subject of their document or as none."""
    f, r = bags.rows(True)
    known = _specific(f, r, y)
    w = _fit(f[known[f]], r[known[f]], y, batch=16)
    z = bags.scores(w)
    doc = np.repeat(np.arange(len(bags.sentences)), bags.sentences)
    best = z.argmax(axis=1)
    top = z[np.arange(len(z)), best]
    yes = (top >= sure) & (y[doc, best] > 0)
    used = yes | (top < none)
    if not yes.any():
        return w
    target = np.zeros((len(z), y.shape[1]))
    target[np.flatnonzero(yes), best[yes]] = 1
    f, r = bags.rows(False)
    new = np.cumsum(used) - 1
    keep = used[r] & known[f]
    return _fit(f[keep], new[r[keep]], target[used], epochs=4, batch=64)


def _specific(feature: np.ndarray, row: np.ndarray, y: np.ndarray, least_rows: int = 3, least_lift: float = 4.0, prior_rows: float = 4.0) -> np.ndarray:
    """Which features tell a subject at all: in enough documents, and with one subject far above its share.

    Everyday wording occurs with all subjects alike; left in, small chance
    correlations of its many occurrences would add up to a subject. The odds of
    the subject given the feature, drawn towards its general odds by
    ``prior_rows``, must exceed these ``least_lift`` times.
    """
    size = DUMMY + 1
    key = np.unique(row.astype(np.int64) * size + feature)
    row, feature = key // size, key % size
    n = np.bincount(feature, minlength=size)
    lift = np.zeros(size)
    for c in range(y.shape[1]):
        share = np.clip(y[:, c].mean(), 0.001, 0.999)
        k = np.bincount(feature, y[row, c], minlength=size)
        lift = np.maximum(lift, (k + prior_rows * share) / (n - k + prior_rows * (1 - share)) / (share / (1 - share)))
    return (n >= least_rows) & (lift >= least_lift)


def _fit(feature: np.ndarray, row: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 16, rate: float = 0.3, shrink: float = 1e-5, least_rows: int = 3) -> np.ndarray:
    """One-versus-rest logistic regression on square-root counts of unit length, by AdaGrad in small batches; weights of features in fewer than ``least_rows`` rows stay 0, as names are no subjects."""
    size = DUMMY + 1
    key, count = np.unique(row.astype(np.int64) * size + feature, return_counts=True)
    row, feature = key // size, key % size
    known = np.bincount(feature, minlength=size) >= least_rows
    m = known[feature]
    row, feature, value = row[m], feature[m], np.sqrt(count[m])
    value = value / np.sqrt(np.bincount(row, value * value, minlength=len(y)))[row]
    first = np.searchsorted(row, np.arange(len(y) + 1))
    share = np.clip(y.mean(axis=0), 0.01, 0.99)
    w, b, g2 = np.zeros((size, y.shape[1])), np.log(share / (1 - share)), np.full((size, y.shape[1]), 1e-2)
    rng = np.random.default_rng(0)
    has = np.flatnonzero(np.diff(first))
    for _ in range(epochs):
        order = rng.permutation(has)
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            n = first[rows + 1] - first[rows]
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            at = np.repeat(first[rows] - starts, n) + np.arange(n.sum())
            f, v = feature[at], value[at, None]
            err = 1 / (1 + np.exp(-(np.add.reduceat(v * w[f], starts, axis=0) + b))) - y[rows]
            u, inv = np.unique(f, return_inverse=True)
            g = np.zeros((len(u), y.shape[1]))
            np.add.at(g, inv, v * np.repeat(err, n, axis=0))
            g += shrink * w[u]
            g2[u] += g * g
            w[u] -= rate * g / np.sqrt(g2[u])
            b -= 0.02 * err.sum(axis=0) / np.sqrt(batch)
    return w


def fit_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, max_labelled: int = MAX_LABELLED) -> SubjectModel | None:
    """Fit and calibrate on at most ``max_labelled`` labelled documents; None without any label.

    The sample, its texts and the model are all that comes to the driver.
    """
    known = subjects.filter("subject is not null").distinct()
    per_doc = labels.filter("doc_id is not null and subject is not null").join(known, "subject", "left_semi").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    sample = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = sample.join(documents.filter("text is not null").select("doc_id", "text"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    names = sorted(r.subject for r in known.collect())
    if not rows or not names:
        return None
    y = np.array([[x in r.subjects for x in names] for r in rows], float)
    held = np.arange(len(rows)) % 4 == 0 if len(rows) >= 40 else np.zeros(len(rows), bool)
    hashed = WordHash()
    part = lambda m: Bags.of([r.text for r, x in zip(rows, m) if x], hashed)
    m = SubjectModel(names, _fit_sentences(part(~held), y[~held]).astype(np.float32))
    if not held.any():
        return m
    best, truth, test = -1.0, y[held], part(held)
    scores = test.scores(m.weights)
    for strength in (4.0, 3.0, 2.0, 1.0):  # of equals the strictest
        c = m.counts(test, strength, scores)
        for least in (2, 3, 1):
            for share in (0.35, 0.3, 0.25, 0.2, 0.15):
                p = m.decide(c, test.sentences, least, share)
                f1 = 2 * (p * truth).sum() / max(1.0, p.sum() + truth.sum())
                if f1 > best + 0.003:
                    best, m.strength, m.least_sentences, m.least_share = f1, strength, least, share
    return m


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, subject: one row per subject that is a main one of the document.

    Null and empty texts, and texts about everyday matters only, have no row.
    A repeated doc_id is classified row by row and each subject comes out
    once. Without labels or subjects the result is empty.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, subject string"
    model = fit_subjects(documents, labels, subjects, max_labelled)
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, hashed = shared.value, WordHash()
        for b in batches:
            bags = Bags.of(list(b["text"]), hashed)
            hit = m.decide(m.counts(bags), bags.sentences)
            r, c = np.nonzero(hit)
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[r], "subject": np.array(m.subjects, dtype=object)[c]})

    docs = spread(documents.filter("doc_id is not null and text is not null").select("doc_id", "text"))
    return docs.mapInPandas(run, schema).distinct()
