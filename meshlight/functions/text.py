"""Splitting text into bounded chunks, entirely with JVM-side array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshlight.values import CHUNK_CHARS

_BLANKS = r"[\s\x1c-\x1f]+"
_STATE = "struct<done: array<string>, open: string>"


def strip(text: Column) -> Column:
    """Remove white space (Unicode included) from both ends."""
    return F.regexp_replace(text, rf"(?U)^{_BLANKS}|{_BLANKS}$", "")


def _close(done: Column, open_: Column) -> Column:
    """Append the open chunk to the finished ones unless there is nothing in it."""
    return F.when(open_ == "", done).otherwise(F.array_append(done, strip(open_)))


def _state(done: Column, open_: Column) -> Column:
    return F.named_struct(F.lit("done"), done, F.lit("open"), open_)


def _pack(pieces: Column, glue: str, limit: int, done: Column) -> Column:
    """Greedily join pieces with ``glue`` while the chunk stays within ``limit`` characters."""

    def step(state: Column, piece: Column) -> Column:
        fits = F.length(state["open"]) + F.length(piece) + len(glue) <= limit
        joined = F.when(state["open"] == "", piece).otherwise(F.concat(state["open"], F.lit(glue), piece))
        return F.when(fits, _state(state["done"], joined)).otherwise(
            _state(_close(state["done"], state["open"]), piece)
        )

    return F.aggregate(pieces, _state(done, F.lit("")).cast(_STATE), step)


def chunks(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """Array of chunks: paragraphs are packed together; a paragraph over the limit is packed by
    sentence; one sentence over the limit stays whole. The last sentence pack of a long paragraph
    stays open, so the next paragraph may join it."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")

    def step(state: Column, paragraph: Column) -> Column:
        fits = F.length(state["open"]) + F.length(paragraph) + 2 <= limit
        joined = F.when(state["open"] == "", paragraph).otherwise(
            F.concat(state["open"], F.lit("\n\n"), paragraph)
        )
        closed = _close(state["done"], state["open"])
        sentences = F.split(F.replace(paragraph, F.lit(". "), F.lit(".\n")), "\n")
        return (
            F.when(fits, _state(state["done"], joined))
            .when(F.length(paragraph) > limit, _pack(sentences, " ", limit, closed))
            .otherwise(_state(closed, paragraph))
        )

    start = _state(F.array().cast("array<string>"), F.lit("")).cast(_STATE)
    packed = F.aggregate(paragraphs, start, step, lambda s: _close(s["done"], s["open"]))
    return F.filter(F.coalesce(packed, F.array().cast("array<string>")), lambda c: c != "")
