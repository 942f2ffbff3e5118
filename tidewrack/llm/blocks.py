"""Problem 2: page boilerplate mixed with main content.

A recurrent block labeller. A page is the sequence of its lines with visible
text; each is read as a vector of its hashed words, its hashed tag path and a
few shapes. A bidirectional LSTM (plain numpy) reads the sequence both ways,
so that every line is classified with the whole page as context, and a
logistic layer says whether the line is furniture.

The network is trained on a bounded sample of pages whose lines are labelled
weakly, by wording that sites have in common and by recurrence on pages of
different content (see ``furniture``); it is told neither. Hidden layers and embeddings are small
enough to be broadcast (about 0.4 MB); labelling is a map over pages without a
shuffle other than the one that spreads large files over the cores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.furniture import recurrent_lines, visible_lines, weak_labels
from tidewrack.llm.words import WordHash, mix, words_of
from tidewrack.session import spread

WORD_BITS, WORD_DIM = 12, 16
PATH_BITS, PATH_DIM = 8, 4
SHAPES, HIDDEN = 12, 16
#: Pages of each table that the network is trained on, taken in order of a hash of their ids.
MAX_PAGES = 1200
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^>]*?(/?)>")
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "area", "base", "col", "source"}
_INLINE = {"a", "b", "i", "em", "strong", "span", "u", "small", "code"}


def tag_paths(text: str) -> list[str]:
    """For each line, the path of open block elements at its first text."""
    lines = text.split("\n")
    if "<" not in text:
        return ["text"] * len(lines)
    stack: list[str] = []
    out = []
    for s in lines:
        path, at = None, 0
        for m in _TAG.finditer(s):
            if path is None and s[at : m.start()].strip():
                path = "/".join(stack)
            at = m.end()
            tag = m.group(2).lower()
            if tag in _VOID or tag in _INLINE or m.group(3):
                continue
            if not m.group(1):
                stack.append(tag)
            elif tag in stack:
                while stack and stack.pop() != tag:
                    pass
        out.append("/".join(stack) if path is None else path)
    return out


def page_blocks(text: str, hashed: WordHash) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, list[str]]:
    """Line numbers (from 1), word features per line, path features, shapes and texts of a page's visible lines."""
    vis = visible_lines(text)
    nos = [k for k, s in enumerate(vis) if s]
    texts = [vis[k] for k in nos]
    paths = tag_paths(text)
    words, path_ids, shapes = [], [], np.zeros((len(nos), SHAPES), np.float32)
    for r, (k, s) in enumerate(zip(nos, texts)):
        w = words_of(s)
        words.append((mix(hashed(w), 5) >> np.uint64(64 - WORD_BITS)).astype(np.int32) if w else np.zeros(1, np.int32))
        path_ids.append(paths[k])
        n = len(s)
        shapes[r] = (
            min(n, 400) / 200, min(len(w), 60) / 30, s[-1] in ".!?…", s[-1] == ":", sum(map(s.count, "|·•>")) / (1 + len(w)), s[0] in "*-»›•", s[0] == "#", "](" in s or "http" in s, any(c.isdigit() for c in s), 2 * r / max(1, len(nos) - 1) - 1, " > " in s, 0 < s.find(":") < 22,
        )
    p = (mix(hashed(path_ids), 6) >> np.uint64(64 - PATH_BITS)).astype(np.int32) if path_ids else np.zeros(0, np.int32)
    return np.array(nos, np.int32) + 1, words, p, shapes, texts


class BlockLabeller:
    """Embeddings, one LSTM in each direction and a logistic output, in numpy."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        d = WORD_DIM + PATH_DIM + SHAPES
        n = lambda *s: (r.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {"words": n(1 << WORD_BITS, WORD_DIM) * 2, "paths": n(1 << PATH_BITS, PATH_DIM), "out": n(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": n(d, 4 * HIDDEN), f"h{way}": n(HIDDEN, 4 * HIDDEN), f"c{way}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)}

    def _inputs(self, words: list[np.ndarray], paths: np.ndarray, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words])
        flat = np.concatenate(words)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mean = np.add.reduceat(self.p["words"][flat], starts, axis=0) / np.sqrt(sizes)[:, None]
        return np.concatenate([mean, self.p["paths"][paths], shapes], axis=1).astype(np.float32), flat, sizes

    @staticmethod
    def _padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each (step, page) into the flat lines, and its mask; pages are in order of falling length."""
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        t = np.arange(lengths.max())[:, None]
        return np.minimum(starts + t, starts + lengths - 1), t < lengths

    def _run(self, z: np.ndarray, wh: np.ndarray, mask: np.ndarray, steps: range, keep: bool):
        """Hidden states of one direction: z is (steps, pages, 4 * HIDDEN). Pages beyond their length keep a zero state."""
        n_t, n_b = mask.shape
        h, c = np.zeros((n_b, HIDDEN), np.float32), np.zeros((n_b, HIDDEN), np.float32)
        hs = np.zeros((n_t, n_b, HIDDEN), np.float32)
        trace = {}
        active = mask.sum(axis=1)  # pages are sorted by length, so the active ones are the first
        for t in steps:
            b = active[t]
            g = z[t, :b] + h[:b] @ wh
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * HIDDEN], -30, 30)))
            i, f, o, u = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(g[:, 3 * HIDDEN :])
            old_h, old_c = h, c
            h, c = np.zeros_like(h), np.zeros_like(c)
            c[:b] = f * old_c[:b] + i * u
            tc = np.tanh(c[:b])
            h[:b] = o * tc
            hs[t] = h
            if keep:
                trace[t] = (b, i, f, o, u, tc, old_h[:b], old_c[:b])
        return hs, trace

    def _forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
        at, mask = self._padded(lengths)
        out, saved = [], {}
        for way, steps in (("f", range(len(at))), ("b", range(len(at) - 1, -1, -1))):
            z = (x @ self.p[f"x{way}"] + self.p[f"c{way}"])[at]
            hs, trace = self._run(z, self.p[f"h{way}"], mask, steps, keep)
            out.append(hs)
            saved[way] = trace
        h = np.concatenate(out, axis=2)
        logit = h @ self.p["out"] + self.p["bias"]
        return at, mask, h, logit, saved

    def score(self, pages: list[tuple]) -> list[np.ndarray]:
        """Log-odds of furniture for every line; ``pages`` are (words, paths, shapes), none of them empty."""
        order = sorted(range(len(pages)), key=lambda k: -len(pages[k][0]))
        out: list = [None] * len(pages)
        a = 0
        while a < len(order):
            # a group holds pages of similar length and a bounded number of padded lines
            most = len(pages[order[a]][0])
            b = min(len(order), a + max(1, min(512, 40_000 // most)))
            group = order[a:b]
            lengths = np.array([len(pages[k][0]) for k in group])
            x, _, _ = self._inputs([w for k in group for w in pages[k][0]], np.concatenate([pages[k][1] for k in group]), np.concatenate([pages[k][2] for k in group]))
            _, mask, _, logit, _ = self._forward(x, lengths)
            for m, k in enumerate(group):
                out[k] = logit[: lengths[m], m]
            a = b
        return out

    def train(self, pages: list[tuple], labels: list[np.ndarray], epochs: int = 8, batch: int = 32, rate: float = 0.01) -> None:
        """Back-propagation through time with Adam, on batches of pages of similar length."""
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        order = sorted(range(len(pages)), key=lambda k: -len(pages[k][0]))
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        rng, step = np.random.default_rng(1), 0
        for epoch in range(epochs):
            for j in rng.permutation(len(groups)):
                group = groups[j]
                lengths = np.array([len(pages[k][0]) for k in group])
                paths = np.concatenate([pages[k][1] for k in group])
                y = np.concatenate([labels[k] for k in group])
                x, flat, sizes = self._inputs([w for k in group for w in pages[k][0]], paths, np.concatenate([pages[k][2] for k in group]))
                at, mask, h, logit, saved = self._forward(x, lengths, keep=True)
                d = np.where(mask, 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[at], 0.0).astype(np.float32) / mask.sum()
                grad = {"out": np.einsum("tb,tbh->h", d, h), "bias": np.array([d.sum()], np.float32)}
                dx = np.zeros_like(x)
                for w, (way, steps) in enumerate((("f", range(len(at) - 1, -1, -1)), ("b", range(len(at))))):
                    wh, gz = self.p[f"h{way}"], np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
                    gh, gc = np.zeros((len(group), HIDDEN), np.float32), np.zeros((len(group), HIDDEN), np.float32)
                    gwh = np.zeros_like(wh)
                    for t in steps:
                        b, i, f, o, u, tc, old_h, old_c = saved[way][t]
                        dh = gh[:b] + d[t, :b, None] * self.p["out"][w * HIDDEN : (w + 1) * HIDDEN]
                        dc = gc[:b] + dh * o * (1 - tc * tc)
                        g = np.concatenate([dc * u * i * (1 - i), dc * old_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                        gz[t, :b] = g
                        gwh += old_h.T @ g
                        gh, gc = np.zeros_like(gh), np.zeros_like(gc)
                        gh[:b], gc[:b] = g @ wh.T, dc * f
                    rows = gz[mask]
                    lines = at[mask]
                    grad[f"h{way}"], grad[f"c{way}"], grad[f"x{way}"] = gwh, rows.sum(axis=0), x[lines].T @ rows
                    dx[lines] += rows @ self.p[f"x{way}"].T
                grad["words"] = np.zeros_like(self.p["words"])
                np.add.at(grad["words"], flat, np.repeat(dx[:, :WORD_DIM] / np.sqrt(sizes)[:, None], sizes, axis=0))
                grad["paths"] = np.zeros_like(self.p["paths"])
                np.add.at(grad["paths"], paths, dx[:, WORD_DIM : WORD_DIM + PATH_DIM])
                step += 1
                lr = rate * (0.4 if epoch >= epochs - 2 else 1.0)
                for k, g in grad.items():
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.99 * m2[k] + 0.01 * g * g
                    self.p[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def fit_block_labeller(texts: list[str], seed: int = 0) -> BlockLabeller | None:
    """Train on pages labelled weakly, by general wording and by recurrence; None where no page has a visible line."""
    hashed, pages, shown = WordHash(), [], []
    for t in texts:
        _, words, paths, shapes, lines = page_blocks(t, hashed)
        if words:
            pages.append((words, paths, shapes))
            shown.append(lines)
    if not pages:
        return None
    again = recurrent_lines(shown)
    m = BlockLabeller(seed)
    m.train(pages, [np.array(weak_labels(lines, again), np.float32) for lines in shown])
    return m


def _sample(df: DataFrame, key: str, text: str, n: int) -> list[str]:
    rows = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0)).select(key, text).orderBy(F.xxhash64(key), key).limit(n).collect()
    return [r[1] for r in rows]


def furniture_lines(sources: list[tuple[str, DataFrame, str, str]], max_pages: int = MAX_PAGES) -> DataFrame:
    """tbl, rec_id, line_no of lines that do not belong to the article.

    ``sources`` are (tbl, table, key, text column). Lines are counted from 1
    in the text split at line feeds; only lines with visible text come out.
    Null and empty texts have none. Repeated keys are labelled row by row.
    The network is trained on ``max_pages`` pages of each source and applied
    to all lines of all pages, whole.
    """
    spark = sources[0][1].sparkSession
    schema = "tbl string, rec_id bigint, line_no int"
    model = fit_block_labeller([t for _, df, key, text in sources for t in _sample(df, key, text, max_pages)])
    if model is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(model.p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, hashed = BlockLabeller(), WordHash()
        m.p = shared.value
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.iloc[lo : lo + 1000]
                seen = [(tbl, i, page_blocks(t, hashed)) for tbl, i, t in zip(part["tbl"], part["rec_id"], part["text"])]
                seen = [x for x in seen if x[2][1]]
                if not seen:
                    continue
                hits = [s > 0 for s in m.score([(w, p, sh) for _, _, (_, w, p, sh, _) in seen])]
                counts = [int(h.sum()) for h in hits]
                yield pd.DataFrame(
                    {
                        "tbl": np.repeat(np.array([x[0] for x in seen], dtype=object), counts),
                        "rec_id": np.repeat(np.array([x[1] for x in seen], np.int64), counts),
                        "line_no": np.concatenate([x[2][0][h] for x, h in zip(seen, hits)]),
                    }
                )

    pages = None
    for tbl, df, key, text in sources:
        x = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.lit(tbl).alias("tbl"), F.col(key).alias("rec_id"), F.col(text).alias("text"))
        pages = x if pages is None else pages.unionByName(x)
    return spread(pages).mapInPandas(run, schema)


def page_furniture(items: DataFrame, messages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """``furniture_lines`` of items.text and messages.html_body."""
    return furniture_lines([("items", items, "item_id", "text"), ("messages", messages, "delivery_id", "html_body")], max_pages)
