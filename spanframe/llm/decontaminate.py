"""Operator 3: benchmark decontamination by pigeonhole edit matching.

A test item may occur with up to k edits (inserted, deleted, replaced characters). Cut into k + 1 pieces, at least one piece occurs unchanged, so an
automaton over all pieces finds the places to look at, and Myers' bit-parallel distance verifies the text around them. Texts and items are
compared in lower case with white space as single blanks. The items are a stated query set: they go to the tasks in blocks of bounded size,
and every block meets every whole text; documents are not shuffled.

Defined results: null and empty texts match nothing; items that are null or blank are left out, items shorter than ``LEAST``
characters match only without edits and as whole words; repeated items match each; rows with a null or repeated doc_id are searched each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of an item below which it is searched without edits and as whole words.
LEAST = 20
#: Characters of items that are searched in one go.
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int) -> int:
    """Edits allowed: one in 16 characters, for short items up to 8 but not over one in 10, below LEAST none."""
    return 0 if length < LEAST else max(length // 16, min(8, length // 10))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(start, piece) of edits + 1 pieces that make up the item, lengths differing by one at most."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def parts_word(text: str, at: int) -> bool:
    """Whether a word goes on across the place before the character ``at``."""
    return 0 < at < len(text) and all(c.isalnum() or c == "_" for c in text[at - 1 : at + 1])


@lru_cache(4096)
def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distance(pattern: str, text: str) -> tuple[int, int]:
    """Least edits between the pattern and any stretch of the text, and where the first such stretch ends (Myers 1999)."""
    masks, m = _masks(pattern), len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = (down | ~(diagonal | up)) & full
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up = (minus | ~(diagonal | plus)) & full
        down = plus & diagonal
        if score < best:
            best, at = score, j
    return best, at


class Finder:
    """Searches texts for a block of (item_id, normalised item)."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, found = items, {}
        for i, (_, text) in enumerate(items):
            for start, piece in pieces(text, budget(len(text))):
                found.setdefault(piece, []).append((i, start))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(number of the item, edits, end in the normalised text) of every item found, once each, at its first verified place."""
        done: dict[int, tuple[int, int]] = {}
        seen: set[tuple[int, int]] = set()  # (item, begin) verified without success
        for end, (length, where) in self.automaton.iter(text):
            for i, start in where:
                if i in done:
                    continue
                item = self.items[i][1]
                edits = budget(len(item))
                begin = end + 1 - length - start
                if len(item) < LEAST:
                    if not parts_word(text, begin) and not parts_word(text, end + 1):
                        done[i] = (0, end + 1)
                    continue
                if any((i, begin - d) in seen for d in range(edits + 1)):  # the window of that place held all that this one can match
                    continue
                low = max(0, begin - edits)
                best, at = distance(item, text[low : begin + len(item) + 2 * edits])
                if best <= edits:
                    done[i] = (best, low + at)
                else:
                    seen.add((i, begin))
        return [(i, best, at) for i, (best, at) in sorted(done.items())]


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of about BLOCK_CHARS characters; the driver holds one at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if text := normal(r["text"]):
            if block and size + len(text) > BLOCK_CHARS:
                yield block
                block, size = [], 0
            block.append((r["item_id"], text))
            size += len(text)
    if block:
        yield block


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, item_chars, stop) of every item that occurs in a text; stop is an end in the normalised text."""
    schema = "doc_id long, item_id long, edits int, item_chars int, stop long"

    def search(df: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(items)
            for batch in batches:
                out = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    out += [(doc, items[i][0], best, len(items[i][1]), at) for i, best, at in finder.hits(normal(text.as_py()))]
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["doc_id", "item_id", "edits", "item_chars", "stop"])

        return df.mapInArrow(rows, schema)

    df = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [search(df, items) for items in blocks(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else df.sparkSession.createDataFrame([], schema)


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text has no item, in one pass for each block of items; columns stay as they are."""

    def keep(df: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(items)
            for batch in batches:
                clean = [not finder.hits(normal(t.as_py())) for t in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return df.mapInArrow(rows, df.schema)

    return reduce(keep, blocks(benchmark), documents)
