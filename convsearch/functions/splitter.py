"""Recursive splitting of texts into overlapping chunks, as a Column.

A text is cut before each occurrence of the first separator that it holds. The
pieces are folded, in order, over the chunks so far and the window of pieces
that the next chunk will hold:

* a piece that fits joins the window;
* one that does not closes the window (its text, without white space at both
  ends, is a chunk if anything is left) and leaves as overlap the longest run
  of its last pieces that is no longer than ``overlap`` and leaves room;
* a piece of ``size`` or more closes the window, too; it is split by the later
  separators, and its chunks follow.

The fold is nested once for each separator, all of it in one expression without
Python. Lengths are in code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: separator order; at last single characters ---
SEPARATORS = ("\n\n", "\n", " ", "")

#: White space at both ends, as a string's strip() takes it.
ENDS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _strings(*items) -> Column:
    return F.array(*items).cast("array<string>")


def _once(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pieces(text: Column, separator: str) -> Column:
    if not separator:
        return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    parts = F.split(text, separator, -1)
    return F.filter(F.transform(parts, lambda p, i: F.when(i > 0, F.concat(F.lit(separator), p)).otherwise(p)), lambda p: p != "")


def _closed(state: Column) -> Column:
    """The chunks once the window is closed."""
    chunk = F.regexp_replace(F.array_join(state["window"], ""), ENDS, "")
    return _once(chunk, lambda c: F.when(c != "", F.concat(state["chunks"], F.array(c))).otherwise(state["chunks"]))


def _state(chunks: Column, window: Column, length: Column) -> Column:
    return F.struct(chunks.alias("chunks"), window.alias("window"), length.cast("int").alias("length"))


def _overlap(window: Column, most: Column) -> Column:
    """How many of the last pieces are together no longer than ``most``, and
    how long they are."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("length"), F.lit(False).alias("over"))

    def back(acc, piece):
        longer = acc["length"] + F.char_length(piece)
        return F.when(acc["over"] | (longer > most), F.struct(acc["n"].alias("n"), acc["length"].alias("length"), F.lit(True).alias("over"))).otherwise(
            F.struct((acc["n"] + 1).alias("n"), longer.alias("length"), F.lit(False).alias("over")))

    return F.aggregate(F.reverse(window), start, back)


def chunks_of(text, size: int = 512, overlap: int = 64, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """The chunks of ``text`` (null or empty: none) as an array of strings."""
    text = F.col(text) if isinstance(text, str) else text

    def split(text: Column, separators: tuple[str, ...]) -> Column:
        separator, later = separators[0], separators[1:]

        def step(state, piece):
            n = F.char_length(piece)
            fits = state["length"] + n <= size
            # a piece shorter than ``size`` always leaves room for some overlap
            reopened = _once(_overlap(state["window"], F.least(F.lit(overlap), F.lit(size) - n)), lambda tail: _state(
                _closed(state), F.concat(F.slice(state["window"], F.size(state["window"]) - tail["n"] + 1, tail["n"]), F.array(piece)), tail["length"] + n))
            longer = _state(state["chunks"], F.concat(state["window"], F.array(piece)), state["length"] + n)
            deeper = split(piece, later) if later else _strings(piece)
            return (F.when(n >= size, _state(F.concat(_closed(state), deeper), _strings(), F.lit(0)))
                    .when(fits | (F.size(state["window"]) == 0), longer).otherwise(reopened))

        folded = F.aggregate(_pieces(text, separator), _state(_strings(), _strings(), F.lit(0)), step, _closed)
        return F.when(F.contains(text, F.lit(separator)), folded).otherwise(split(text, later)) if later else folded

    return F.when(text.isNotNull() & (text != ""), split(text, tuple(separators))).otherwise(_strings())
