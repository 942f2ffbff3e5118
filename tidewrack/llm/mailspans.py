"""Problem 3: quoted history, signatures and notices in mail.

A semi-Markov model over the lines of a message. A state is a span of one
kind: authored text, quotation by prefix, quotation by header (all that
follows a forwarded or copied head), signature (closing formula, sign-off,
device line) or notice (legal and company text). A span's score is

    start cue + sum of line cues + length term + whole-span terms,

and decoding takes the best sequence of spans. Start cues are attributions,
copied mail heads, closing formulas, separators and the first words of
notices; line cues are prefixes, contact lines, sentences and so on; whole-span
terms look at the span as one (does a prefixed quotation have prefixes, does a
notice have enough legal wording). The scores are fixed log-weights, listed
below; nothing is learned from the data decoded.

What follows a copied head is quoted however long it is: no kind of line pays
more in a headed quotation than elsewhere, and authored text comes after one
only where a line says that the forwarded mail ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.session import spread

AUTHORED, PREFIXED, HEADED, SIGNATURE, NOTICE, TRAILER = range(6)
#: A trailer is a notice below a headed quotation.
KINDS = ["authored", "quoted", "quoted", "signature", "notice", "notice"]
#: Lines of a span of a kind that cost nothing, and what each further one costs: signatures are short, notices not long.
FREE_LINES = {SIGNATURE: (7, 0.35), NOTICE: (9, 0.25), TRAILER: (9, 0.25)}
#: What a prefixed quotation without any prefix costs, as one attribution.
NO_PREFIX = 3.0

# Wording in English, German, French and Spanish.
_PREFIX = re.compile(r"^\s{0,3}(?:[>|:]\s?)+(?=\s|\S|$)")
_QUOTED = re.compile(r"^\s{0,3}(?:>|\|(?:\s|$)|:(?:\s|$))")
_HEAD = re.compile(
    r"^\s*\*?(?:From|Sent|To|Cc|Bcc|Subject|Date|Reply-To|Von|Gesendet|An|Betreff|Datum|De|Enviado(?: el)?|Para|Asunto|Fecha|Envoyé(?: le)?|À|Objet|Date)\s?:\*?\s", re.I
)
_FORWARD = re.compile(
    r"^\s*(?:-{2,}|_{5,}|={5,})?\s*(?:begin forwarded message|anfang der weitergeleiteten|original message|forwarded message|forwarded by\b.*|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|message transféré|mensaje original|mensaje reenviado|début du message)\s*:?\s*(?:-{2,}|:)?\s*$",
    re.I,
)
_FORWARD_END = re.compile(
    r"^\s*(?:-{2,}|_{3,}|={3,})?\s*(?:end (?:of )?(?:the )?(?:forwarded|original) (?:message|mail|e-?mail)|ende der (?:weitergeleiteten|ursprünglichen) (?:nachricht|e-?mail)|fin du (?:message|courriel) (?:transféré|d'origine)|fin del mensaje (?:reenviado|original))\s*[.:]?\s*(?:-{2,}|_{3,}|={3,})?\s*$",
    re.I,
)
_RULE = re.compile(r"^\s*(?:--\s?|—|_{3,}|={3,}|~{3,}|\*{3,}|-{3,}|#{3,})\s*$")
_CLOSING = re.compile(
    r"^\s*(?:(?:with )?(?:best|kind|warm|kindest|warmest) (?:regards|wishes)|regards|best|cheers|(?:many )?thanks(?: again| in advance)?|thank you|all the best|(?:yours )?sincerely|yours(?: truly| faithfully)?|take care|"
    r"mit (?:freundlichen|besten|herzlichen) gr(?:ü|ue)(?:ß|ss)en|(?:viele|beste|liebe|herzliche|freundliche|schöne) gr(?:ü|ue)(?:ß|ss)e|gru(?:ß|ss)|lg|mfg|hochachtungsvoll|"
    r"(?:bien )?cordialement|bien à (?:vous|toi)|amicalement|(?:sincères|meilleures) salutations|salutations|à bientôt|merci|"
    r"saludos(?: cordiales)?|un (?:cordial )?saludo|un abrazo|atentamente|cordialmente|gracias)\s*[,.!–-]?\s*$",
    re.I,
)
_DEVICE = re.compile(r"^\s*(?:sent from my|sent via|get the \S+ app|get outlook|enviado desde mi|envoyé de(?:puis)? mon|von meinem .*gesendet|gesendet von|unterwegs getippt|diese nachricht wurde von meinem)\b", re.I)
_CONTACT = re.compile(r"^\s*(?:(?:t|tel|tél|m|mob|mobile|phone|fon|fax|f|móvil|telefon)?\.?\s*:?\s*\+?\d[\d ()/.-]{5,}|\S+@\S+\.\S+|(?:https?://|www\.)\S+)\s*$", re.I)
_TITLE = re.compile(r"^\s*[A-ZÄÖÜÉÀ][\w'’.-]*(?: (?:of|de|für|for|the|and|[A-ZÄÖÜÉ][\w'’.-]*))*\s*(?:@|\||,|-|–|·)\s*[A-ZÄÖÜÉ][\w'’.-]*(?:,? [A-ZÄÖÜÉ][\w'’.-]*)*\s*$")
_NAME = re.compile(r"^\s*[A-ZÄÖÜÉ][\w'’-]+(?: [A-ZÄÖÜÉ][\w'’.-]*){0,3}\s*$")
_ATTRIBUTION = re.compile(
    r"^\s*(?:on\b.{6,160}\bwrote|am\b.{6,160}\bschrieb\b[^:]{0,80}|le\b.{6,160}\ba écrit|el\b.{6,160}\bescribió|in reply to\b.{3,140}\)|in antwort auf\b.{3,140}\)|.{3,120}\b(?:said|wrote|schrieb|a écrit|escribió)|.{3,120}\b(?:wrote on|schrieb am|a écrit le|escribió el)\b.{3,40})\s?:\s*$",
    re.I | re.S,
)
_NOTICE_START = re.compile(
    r"^\s*(?:confidential(?:ity)?\b|this (?:e-?mail|message|communication)\b|the (?:views|information|contents?)\b.*\b(?:above|this|not those)|notice to\b|disclaimer|please consider the environment|e-?mail is not secure|unauthori[sz]ed|"
    r"(?:diese|dieses) (?:nachricht|e-?mail|schreiben)\b|der inhalt dieser|ce (?:message|courriel|mail)\b|este (?:mensaje|correo)\b|.{2,40} is registered in\b|.{2,40}, (?:sitz |registered )|.{2,40}, (?:n°|núm\.|nr\.|no\.) ?\d|.{2,60}, (?:n°|núm\.) )",
    re.I,
)
_LEGAL = [
    "confidential", "privileged", "legally protected", "intended reader", "intended recipient", "named recipient", "addressee", "by mistake", "in error", "destroy all copies", "delete it", "tell the sender", "inform us", "unlawful", "not allowed", "unauthorised", "unauthorized", "accept no liability", "accepts no liability", "not secure", "registered in", "under no.", "not those of", "environment before you print", "print this", "attachment",
    "vertraulich", "geschützt", "adressat", "empfänger", "irrtum", "löschen sie", "haftet nicht", "weitergabe", "untersagt", "registernummer", "sitz ", "umwelt",
    "confidentiel", "protégé", "destinataire", "erreur", "détruire", "prévenir", "responsabilité", "l'expéditeur", "désigné", "n° ",
    "reservado", "destinatario", "por error", "bórrelo", "remitente", "responsabilidad", "núm. ", "se dirige solo",
]
_SENTENCE = re.compile(r"[.!?…]['\"»”)]?\s*$")

# Log-weights. Rows of line cues: authored, prefixed, headed, signature, notice, trailer. A forwarded mail has
# lines of every kind, so those of headed are the best of the others.
_W_PLAIN = np.array([0.0, -5.0, 0.0, -4.0, -2.0, -2.0])
_W_PREFIX = np.array([-8.0, 1.0, 1.0, -8.0, -8.0, -8.0])
_W_LINE_HEAD = np.array([-3.0, -2.0, 0.8, -4.0, -4.0, -4.0])
_W_ATTRIBUTION = np.array([-5.0, 1.5, 2.5, -5.0, -5.0, -5.0])
_W_CLOSING = np.array([-3.0, -5.0, 1.5, 1.5, -5.0, -5.0])
_W_RULE = np.array([-2.5, -4.0, 1.0, 1.0, -3.0, -3.0])
_W_DEVICE = np.array([-4.0, -5.0, 1.5, 1.5, -4.0, -4.0])
_W_CONTACT = np.array([-0.3, -5.0, 0.8, 0.8, -2.5, -2.5])
_W_TITLE = np.array([-1.2, -5.0, 0.6, 0.6, -2.0, -2.0])
_W_NAME = np.array([-1.5, -5.0, 0.6, 0.6, -2.0, -2.0])
_W_LEGAL = np.array([-3.5, -5.0, 1.5, -4.0, 1.5, 1.5])
_NEVER = -1e6
_START_WITHOUT_CUE = np.array([-1.0, -3.0, _NEVER, -5.0, -5.0, -5.0])


def _legal(s: str) -> int:
    """Number of words of notices in a line."""
    low = s.lower()
    return sum(w in low for w in _LEGAL)


def _lookahead(lines: list[str], k: int) -> tuple[bool, int]:
    """Whether an attribution starts at line ``k``, on one to three wrapped lines, and on how many."""
    joined = ""
    for m in range(3):
        if k + m >= len(lines) or not lines[k + m].strip() or (m and _QUOTED.match(lines[k + m])):
            return False, 0
        joined = f"{joined} {lines[k + m].strip()}" if m else lines[k].strip()
        if joined.endswith(":"):
            return bool(_ATTRIBUTION.match(joined)) and _told(joined), m + 1
        if m == 0 and _SENTENCE.search(joined) and not re.search(r"\d\.$|\bno\.$", joined):
            return False, 0
    return False, 0


def _near(lines: list[str], heads: list[bool], k: int) -> int:
    """How many of the three lines with text from ``k`` on look like a mail's head."""
    return sum(heads[i] for i in [i for i in range(k, min(len(lines), k + 6)) if lines[i].strip()][:3])


def _told(s: str) -> bool:
    """An attribution names a date, an address or a person, and little else."""
    return bool(re.search(r"\d{1,4}[-./:]\d|@|\d{4}|^\S+ \S+ (?:said|wrote|schrieb|escribió)\s?:$|^\S+ \S+ a écrit\s?:$|wrote on|schrieb am|^\S+(?: \S+)?(?: <\S+>)? (?:said|wrote|schrieb|a écrit|escribió)\b", s, re.I))


_EACH = np.arange(6)
# Log-weights of a kind (row) being followed by another; a headed quotation runs to the end, to a notice or to
# the line that ends it (_RELEASE: its row there).
_FOLLOW = np.array(
    [
        [-3.0, -0.2, -0.2, -0.2, -0.2, _NEVER],
        [-0.2, -3.0, -0.2, -0.2, -0.2, _NEVER],
        [_NEVER, _NEVER, -3.0, _NEVER, _NEVER, 0.0],
        [-2.0, -0.2, -0.2, -3.0, -0.2, _NEVER],
        [-2.0, -0.2, -0.2, -0.2, -3.0, _NEVER],
        [_NEVER, _NEVER, -0.2, _NEVER, _NEVER, -3.0],
    ]
)
_RELEASE = np.array([0.0, -0.2, -0.2, -0.2, -0.2, 0.0])


def _best_spans(e: np.ndarray, start: np.ndarray, prefixed: np.ndarray, ended: np.ndarray) -> tuple[list[list[int]], list[list[int]], int]:
    """For every line end and kind the start of the best span and the kind before it, and the kind that ends the text.

    ``e`` are the weights of the lines (from row 1), ``start`` those of a span
    that starts at a line. Every span is scored whole, whatever its length, in
    a time that is linear in the lines: the best start of a span follows from
    running maxima of what each start is worth, one over all starts, or one
    over those far enough back to pay for length and one by one over the rest.
    """
    n = len(start)
    total = np.cumsum(e, axis=0)
    first, came = [[-1] * 6 for _ in range(n + 1)], [[-1] * 6 for _ in range(n + 1)]
    lead, lead_from = np.zeros(6), [0] * 6  # best of the spans that may come before
    lead[TRAILER] = _NEVER
    none = (-1e18, -1)
    top = {AUTHORED: none, HEADED: none, PREFIXED: none}  # best worth and start; of prefixed quotations, those with a prefix
    bare = none  # starts below the last prefix
    far = dict.fromkeys(FREE_LINES, none)
    worth: list[list[float]] = []
    before: list[list[int]] = []
    for j in range(1, n + 1):
        i = j - 1
        g = (lead + start[i] - total[i]).tolist()
        worth.append(g)
        before.append(lead_from)
        for c in (AUTHORED, HEADED):
            if g[c] > top[c][0]:
                top[c] = (g[c], i)
        if g[PREFIXED] > bare[0]:
            bare = (g[PREFIXED], i)
        if prefixed[j]:
            top[PREFIXED], bare = max(top[PREFIXED], bare, key=lambda x: x[0]), none
        best = [0.0] * 6
        best[AUTHORED], first[j][AUTHORED] = top[AUTHORED]
        best[HEADED], first[j][HEADED] = top[HEADED]
        with_prefix, without = top[PREFIXED], (bare[0] - NO_PREFIX, bare[1])
        best[PREFIXED], first[j][PREFIXED] = with_prefix if with_prefix[0] >= without[0] else without
        for c, (free, price) in FREE_LINES.items():
            m = j - free - 1  # the latest start that pays
            if m >= 0 and (x := worth[m][c] + price * m) > far[c][0]:
                far[c] = (x, m)
            at = (far[c][0] - price * (j - free), far[c][1])
            for k in range(max(0, m + 1), j):
                if worth[k][c] > at[0]:
                    at = (worth[k][c], k)
            best[c], first[j][c] = at
        came[j] = [before[first[j][c]][c] for c in range(6)]
        scores = np.array(best) + total[j]
        step = scores[:, None] + _FOLLOW
        if ended[j]:
            step[HEADED] = scores[HEADED] + _RELEASE
        at = step.argmax(axis=0)
        lead, lead_from = step[at, _EACH], at.tolist()
    return first, came, int(scores.argmax())


def decode(text: str) -> list[str]:
    """The kind of each line of ``text`` split at line feeds: authored, quoted, signature or notice. Blank lines take their span's kind."""
    lines = text.split("\n")
    n = len(lines)
    e = np.zeros((n + 1, 6))
    start = np.tile(_START_WITHOUT_CUE, (n, 1))
    prefixed, ended = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    heads = [bool(_HEAD.match(s)) and len(s) < 200 for s in lines]
    k = 0
    while k < n:
        s = lines[k]
        if not s.strip():
            # blank lines weigh little, and start nothing
            start[k] = -6.0
            start[k, AUTHORED] = -0.5
            start[k, HEADED] = _NEVER
            if k == 0:
                start[k, AUTHORED] = 0.0
            k += 1
            continue
        if _QUOTED.match(s):
            e[k + 1] = _W_PREFIX
            prefixed[k + 1] = True
            start[k, PREFIXED] = 1.0
            k += 1
            continue
        told, m = _lookahead(lines, k)
        if told:
            for i in range(k, k + m):
                e[i + 1] = _W_ATTRIBUTION
            start[k, PREFIXED] = 2.0
            k += m
            continue
        if _FORWARD.match(s):
            e[k + 1] = _W_LINE_HEAD
            start[k, HEADED] = 6.0
        elif _FORWARD_END.match(s):
            e[k + 1] = _W_LINE_HEAD
            ended[k + 1] = True
        elif heads[k] and (_near(lines, heads, k) >= 2 or (k > 0 and sum(heads[max(0, k - 4) : k]) >= 1 and e[k][HEADED] > 0)):
            e[k + 1] = _W_LINE_HEAD
            start[k, HEADED] = 5.0
        elif _CLOSING.match(s):
            e[k + 1] = _W_CLOSING
            start[k, SIGNATURE] = 3.0
        elif _RULE.match(s):
            e[k + 1] = _W_RULE
            start[k, SIGNATURE] = 2.5
            nxt = next((i for i in range(k + 1, n) if lines[i].strip()), n)
            if nxt < n and (heads[nxt] or _FORWARD.match(lines[nxt])):
                start[k, HEADED] = 5.0
            if nxt < n and _NOTICE_START.match(lines[nxt]):
                e[k + 1, [NOTICE, TRAILER]] = 1.0
                start[k, [NOTICE, TRAILER]] = 2.0
        elif _DEVICE.match(s):
            e[k + 1] = _W_DEVICE
            start[k, SIGNATURE] = 3.0
        else:
            legal = _legal(s)
            opens = bool(_NOTICE_START.match(s))
            if legal or opens:
                joined = " ".join(lines[k : k + 4])
                strong = _legal(joined) >= 2 or bool(re.search(r"environment before you print|not those of", joined, re.I))
                e[k + 1] = _W_LEGAL if legal and strong else _W_PLAIN + np.array([0, 0, 0, 0, 1.0, 1.0])
                if opens and strong:
                    start[k, [NOTICE, TRAILER]] = 3.0
                elif legal and strong:
                    start[k, [NOTICE, TRAILER]] = -1.0
            elif _CONTACT.match(s):
                e[k + 1] = _W_CONTACT
            elif _NAME.match(s):
                e[k + 1] = _W_NAME
                last = not any(lines[i].strip() and not _QUOTED.match(lines[i]) for i in range(k + 1, n))
                start[k, SIGNATURE] = 0.5 if last else -2.5
            elif len(s) < 70 and _TITLE.match(s) and not _SENTENCE.search(s):
                e[k + 1] = _W_TITLE
            else:
                e[k + 1] = _W_PLAIN
                if not _SENTENCE.search(s) and len(s) < 40:
                    e[k + 1, [NOTICE, TRAILER]] += 1.0
                e[k + 1, [NOTICE, TRAILER]] += 1.2  # notices are wrapped: any line may be one's middle
        k += 1
    start[0, AUTHORED] = 0.0
    e[1:][ended[:-1], HEADED] -= 4.0  # below the end of a forward
    first, came, end = _best_spans(e, start, prefixed, ended)
    out, j, c = [""] * n, n, end
    while j > 0:
        i = first[j][c]
        for k in range(i, j):
            out[k] = KINDS[c]
        j, c = i, came[j][c]
    return out


def mail_lines(messages: DataFrame) -> DataFrame:
    """delivery_id, line_no, kind: every line with visible text of text_body; lines count from 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, nos, kinds = [], [], []
            for i, t in zip(b["delivery_id"], b["text_body"]):
                for k, (s, kind) in enumerate(zip(t.split("\n"), decode(t)), 1):
                    if s.strip():
                        ids.append(i)
                        nos.append(k)
                        kinds.append(kind)
            yield pd.DataFrame({"delivery_id": pd.Series(ids, dtype="int64"), "line_no": pd.Series(nos, dtype="int32"), "kind": pd.Series(kinds, dtype=object)})

    x = messages.filter("delivery_id is not null and text_body is not null").select("delivery_id", "text_body")
    return spread(x, 4).mapInPandas(run, "delivery_id bigint, line_no int, kind string")


def unauthored_lines(messages: DataFrame) -> DataFrame:
    """delivery_id, line_no of lines that the sender did not newly write. Null and empty bodies have none."""
    return mail_lines(messages).filter("kind <> 'authored'").select("delivery_id", "line_no")


def authored_text(messages: DataFrame) -> DataFrame:
    """delivery_id, authored: the newly written lines, in order; empty where nothing is left."""

    @F.pandas_udf("string")
    def keep(s: pd.Series) -> pd.Series:
        return s.map(lambda t: "\n".join(x for x, k in zip(t.split("\n"), decode(t)) if k == "authored" and x.strip()) if isinstance(t, str) else None)

    return messages.select("delivery_id", keep("text_body").alias("authored"))
