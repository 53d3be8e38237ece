"""Benchmark decontamination by pigeonhole pieces and Myers bit-parallel edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.llm.common import batch, keep, kept_rows, map_batches, text_of

#: One edit is allowed for each so many characters of an item.
CHARS_PER_EDIT = 16
#: Benchmark text that one pass over the documents looks for.
BLOCK_CHARS = 1_000_000
WORD = re.compile(r"\w+")

Item = tuple[int | None, str]


def normal(text: str) -> str:
    """Words in lower case, with one space between: case, punctuation and white space are no edits."""
    return " ".join(WORD.findall(text.lower()))


def place(text: str, start: int, end: int) -> tuple[int, int]:
    """Where the span of the normal text lies in the text, in code points."""
    at, found = 0, []
    for word in WORD.finditer(text):
        size = len(word[0].lower())
        if at + size > start and not found:
            found.append(word.start() + min(max(0, start - at), len(word[0])))
        if at + size >= end:
            return (found or [word.start()])[0], word.start() + min(end - at, len(word[0])) if end > at else word.start()
        at += size + 1
    return (found or [len(text)])[0], len(text)


def pieces(length: int, edits: int) -> list[tuple[int, int]]:
    """Borders of ``edits + 1`` pieces of nearly equal length: with no more edits than that, one of them is untouched."""
    cut = [length * i // (edits + 1) for i in range(edits + 2)]
    return list(zip(cut, cut[1:], strict=False))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distances(pattern_masks: dict[str, int], length: int, text: str, anchored: bool) -> Iterator[int]:
    """After each character of the text: the least edit distance of the pattern to a part that ends here.

    ``anchored``: to the whole text so far. One bit of a long integer per character of the pattern.
    """
    ones, top = (1 << length) - 1, 1 << (length - 1)
    up, down, score = ones, 0, length
    for c in text:
        same = pattern_masks.get(c, 0)
        vertical = same | down
        level = (((same & up) + up) ^ up) | same
        rise = down | (~(level | up) & ones)
        fall = up & level
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = (rise << 1 | anchored) & ones
        fall = fall << 1 & ones
        up = fall | (~(vertical | rise) & ones)
        down = rise & vertical
        yield score


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[Item], chars_per_edit: int):
        self.items = []
        hits: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            pattern = normal(text)
            if not pattern:
                continue
            edits = len(pattern) // chars_per_edit
            for a, b in pieces(len(pattern), edits):
                hits.setdefault(pattern[a:b], []).append((len(self.items), b))
            self.items.append((item_id, len(pattern), edits, masks(pattern), masks(pattern[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, of in hits.items():
            self.automaton.add_word(piece, of)
        if hits:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int | None, int, int, int]]:
        """The nearest occurrence of each item that is within its edits: item id, distance, start, end in the normal text.

        Windows around the hits of an item are merged, so each place is verified once; of equal distances the first counts.
        """
        if not self.items:
            return
        windows: dict[int, list[list[int]]] = {}
        for last, of in self.automaton.iter(text):
            for i, b in of:
                _, length, edits, _, _ = self.items[i]
                origin = last + 1 - b
                if not edits and not (text[origin - 1 : origin].strip() == "" == text[last + 1 : last + 2].strip()):
                    continue
                a, z = max(0, origin - edits), min(len(text), origin + length + edits)
                mine = windows.setdefault(i, [])
                if mine and a <= mine[-1][1]:
                    mine[-1][0], mine[-1][1] = min(a, mine[-1][0]), max(z, mine[-1][1])
                else:
                    mine.append([a, z])
        for i, mine in windows.items():
            item_id, length, edits, ahead, back = self.items[i]
            best = None
            for a, z in mine:
                for at, d in enumerate(distances(ahead, length, text[a:z], False), a + 1):
                    if d <= edits and (best is None or d < best[0]):
                        best = (d, at)
            if best:
                d, end = best
                back_from = text[max(0, end - length - edits) : end][::-1]
                size = next(n for n, x in enumerate(distances(back, length, back_from, True), 1) if x == d)
                yield item_id, d, end - size, end


def matches(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """doc_id, item_id, edits, start_char, end_char: the nearest occurrence of each item in each document that holds it.

    ``items`` (item_id, text) is the stated query set; it is taken to the workers in blocks of bounded size, one pass over
    the documents each. An item of m characters in normal form (lower case, words with one space between) is found
    with up to ``m // chars_per_edit`` edits: it is cut into one piece more than that, exact hits of the pieces give the
    windows, and Myers' distance decides. An item of fewer than ``chars_per_edit`` characters has no edits and counts only as whole
    words: 'no' is not in 'I know', but it is in every text that says no, so give items that are long enough to be a
    trace. Whole texts are searched; nothing is shuffled. Null or empty texts hold nothing;
    items without a word are in no text; repeated rows and items each give their rows; a null id stays null.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text).alias("text"))
    schema = "doc_id long, item_id long, edits long, start_char long, end_char long"
    found = None
    for block in blocks_of(items):
        mine = map_batches(rows, finder(block, chars_per_edit), schema)
        found = mine if found is None else found.unionByName(mine)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def blocks_of(items: DataFrame) -> Iterator[list[Item]]:
    """The items in blocks of about BLOCK_CHARS characters, dealt by a hash; none without items."""
    asked = keep(items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")), "items")
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_CHARS)
    for b in range(blocks):
        one = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text")
        yield [(r.item_id, r.text) for r in one.collect()]


def finder(items: list[Item], chars_per_edit: int):
    held: list[Matcher] = []

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not held:
            held.append(Matcher(items, chars_per_edit))
        out = []
        for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            for item_id, d, a, z in held[0].find(normal(text)):
                out.append((doc_id, item_id, d, *place(text, a, z)))
        yield batch(**{c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("doc_id", "item_id", "edits", "start_char", "end_char"))})

    return run


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """The documents that hold no item (see ``matches``), with all their columns; every row is judged by itself, in one pass per block of items."""

    def free_of(block: list[Item]):
        held: list[Matcher] = []

        def good(texts: pa.Array) -> np.ndarray:
            if not held:
                held.append(Matcher(block, chars_per_edit))
            return np.array([next(held[0].find(normal(t)), None) is None for t in texts.to_pylist()], bool)

        return good

    for block in blocks_of(items):
        docs = kept_rows(docs, text, free_of(block))
    return docs
