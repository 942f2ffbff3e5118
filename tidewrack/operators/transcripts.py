"""Subtitles and transcripts, within the row: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions.text import speaker_label, timestamp_mark

_TIME = r"^\s*(\d{1,2}:\d{2}:\d{2})[.,]\d{3}\s*-->"


def cues(text: Column) -> Column:
    """ARRAY<STRUCT<at, text>> of a VTT or SRT text: cue start as [HH:MM:SS] and its lines joined; tags, headers, numbers and empty cues dropped.

    Cues end at blank lines, number lines and time lines.
    """
    # every time line, number line and blank line opens a block
    marked = F.regexp_replace(F.regexp_replace(text, r"\r", ""), r"(?m)^[ \t]*(?:\d+[ \t]*)?$|(?m)^(?=[ \t]*\d{1,2}:\d{2}:\d{2}[.,]\d{3}[ \t]*-->)", "\u0001")
    blocks = F.filter(F.split(marked, "\u0001"), lambda b: b.rlike(r"^\s*\d{1,2}:\d{2}:\d{2}[.,]\d{3}[ \t]*-->"))
    words = lambda b: F.filter(F.transform(F.filter(F.split(F.regexp_replace(b, r"^\s+", ""), "\n"), lambda s, i: i > 0), lambda s: F.trim(s)), lambda s: (s != "") & ~s.rlike(r"^(?:WEBVTT$|Kind:|Language:|NOTE)"))
    said = F.transform(blocks, lambda b: F.struct(F.concat(F.lit("["), F.lpad(F.regexp_extract(b, _TIME, 1), 8, "0"), F.lit("]")).alias("at"), F.trim(F.regexp_replace(F.array_join(words(b), " "), r"<[^>]+>", "")).alias("text")))
    return F.filter(said, lambda c: c.text != "")


def without_repeats(entries: Column) -> Column:
    """Entries whose text differs from the one before."""
    return F.filter(entries, lambda c, i: (i == 0) | (c.text != entries[F.greatest(i - 1, F.lit(0))].text))


def paragraphs(lines: Column, size: int = 5) -> Column:
    """Paragraphs of ``size`` lines each, joined by spaces; paragraphs are apart by a blank line."""
    n = F.ceil(F.size(lines) / size).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.array_join(F.slice(lines, k * size + 1, size), " "))
    return F.when(n > 0, F.array_join(groups, "\n\n")).otherwise("")


def segments_text(segments: Column) -> Column:
    """Segments (start in seconds, speaker, text) as lines: [HH:MM:SS], the speaker where known, the text; empty texts drop out."""
    said = F.filter(segments, lambda s: F.trim(s.text) != "")
    who = lambda s: F.when(s.speaker.isNotNull() & (s.speaker != ""), F.concat(speaker_label(s.speaker), F.lit(": "))).otherwise("")
    return F.array_join(F.transform(said, lambda s: F.concat(timestamp_mark(s.start), F.lit(" "), who(s), F.trim(s.text))), "\n")
