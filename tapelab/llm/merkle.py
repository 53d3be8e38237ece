"""Document fingerprints: Merkle trees over sections, paragraphs and their pieces."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapelab.llm.common import GOLD, batch, map_batches, mix, slices, text_of

#: Pieces get longer with their place in the text (not with its length, so that equal beginnings have equal pieces): words,
#: then clauses, then sentences. A piece of more code points than the limit is cut on, at borders its own content sets.
PIECES = (
    (256, re.compile(r"\S+\s*|\s+"), 32),
    (4096, re.compile(r"[^.!?,;\n]+[.!?,;]*\s*|[.!?,;]+\s*|\s+"), 48),
    (None, re.compile(r"[^.!?\n]+[.!?]*\s*|[.!?]+\s*|\s+"), 200),
)
#: A border lies after a window of so many code points whose hash falls into one of so many classes as half the limit.
WINDOW = 4
#: Hexadecimal digits of a piece and of the root.
PIECE_HEX, ROOT_HEX = 8, 32
_BLANK_LINE = re.compile(r"\n\s*\n")
_PARAGRAPH = re.compile(r"[^\n]*\n\s*|[^\n]+")
_SPACE = re.compile(r"\s*")


def digest(data: bytes, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def borders(text: str, mean: int) -> list[int]:
    """Places after which the content ends a piece: one in ``mean``, by the hash of the code points before it alone."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = np.zeros(len(points), np.uint64)
    for i in range(min(WINDOW, len(points))):
        mixed[i:] = mixed[i:] * GOLD + points[: len(points) - i] + np.uint64(1)
    return (np.flatnonzero(mix(mixed) % np.uint64(mean) == 0) + 1).tolist()


def cut(piece: str, limit: int, places: list[int], start: int) -> Iterator[str]:
    """A long piece in parts of limit / 8 to 2 x limit code points at the borders of its zone; an edit moves those near it only.

    Where no border comes (one letter over and over) the parts are as long as allowed. Space at the end stays with the last.
    """
    at, least, most = 0, limit // 8, 2 * limit
    low, high = bisect.bisect_left(places, start + 1), bisect.bisect_left(places, start + len(piece.rstrip()))
    for to in (*(x - start for x in places[low:high]), len(piece)):
        while to - at > most:
            yield piece[at : at + most]
            at += most
        if to - at >= least or to == len(piece):
            yield piece[at:to]
            at = to


def pieces(text: str) -> list[str]:
    """The leaves of the tree; end to end they are the text."""
    out, at = [], 0
    for end, kind, limit in PIECES:
        # space over the end of a zone stays whole: it may end a section
        to = len(text) if end is None or end >= len(text) else max(at, _SPACE.match(text, end).end() if text[end - 1].isspace() else end)
        zone, start, places = text[at:to], 0, None
        for piece in kind.findall(zone):
            if len(piece) <= limit:
                out.append(piece)
            else:
                places = borders(zone, limit // 2) if places is None else places
                out += cut(piece, limit, places, start)
            start += len(piece)
        at = to
    return out


def fingerprint(text: str) -> str:
    """``root:sections``: sections joined by ``|``, their paragraphs by ``.``, each its digest and those of its pieces.

    A paragraph ends with a line, a section with a blank line. A paragraph's digest is that of its text, so it does not depend
    on what stands before it (its pieces may); a section's digest is that of its paragraphs' digests, the root's that of
    the sections'. A paragraph of one piece shows its digest alone. Equal texts have equal fingerprints, and the
    empty text has the root of no sections.
    """
    leaf = iter(pieces(text))
    sections: list[list[str]] = []
    tops, own, shown = [], [], []
    for found in _PARAGRAPH.finditer(text):
        paragraph, left, parts = found[0], len(found[0]), []
        while left:
            parts.append(next(leaf))
            left -= len(parts[-1])
        own.append(digest(paragraph.encode("utf-8", "surrogatepass")))
        marks = [digest(x.encode("utf-8", "surrogatepass"))[: PIECE_HEX // 2].hex() for x in parts] if len(parts) > 1 else []
        shown.append(own[-1][: PIECE_HEX // 2].hex() + "".join(marks))
        if _BLANK_LINE.search(paragraph) or found.end() == len(text):
            sections.append(shown)
            tops.append(digest(b"\2" + b"".join(own)))
            own, shown = [], []
    return f"{digest(b'\3' + b''.join(tops)).hex()[:ROOT_HEX]}:{'|'.join('.'.join(x) for x in sections)}"


def leaves(mark: str) -> list[str]:
    """Digests of the pieces."""
    shown = [p[PIECE_HEX:] or p for p in mark[ROOT_HEX + 1 :].replace("|", ".").split(".")]
    return [p[i : i + PIECE_HEX] for p in shown for i in range(0, len(p), PIECE_HEX)]


def tree(mark: str) -> list[tuple[str, ...]]:
    """The paragraphs' digests of each section."""
    return [tuple(p[:PIECE_HEX] for p in s.split(".")) for s in mark[ROOT_HEX + 1 :].split("|") if s]


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else twice the pieces in common over the pieces of both (0 to 1)."""
    if a[:ROOT_HEX] == b[:ROOT_HEX]:
        return 1.0
    x, y = leaves(a), leaves(b)
    return 2.0 * (Counter(x) & Counter(y)).total() / (len(x) + len(y))


def in_both(x: Sequence, y: Sequence) -> list[tuple[int, int]]:
    """Places of equal children, ascending on both sides: the k-th of equal digests meets the k-th, and the longest
    ascending run of these pairs stays (n log n steps, whatever the texts)."""
    held: dict = {}
    for j, child in enumerate(y):
        held.setdefault(child, []).append(j)
    used: Counter = Counter()
    pairs = []
    for i, child in enumerate(x):
        places = held.get(child, ())
        if used[child] < len(places):
            pairs.append((i, places[used[child]]))
            used[child] += 1
    ends: list[int] = []
    last: list[int] = []
    before = []
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(ends, j)
        before.append(last[k - 1] if k else -1)
        if k == len(ends):
            ends.append(j)
            last.append(n)
        else:
            ends[k], last[k] = j, n
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def gaps(x: Sequence, y: Sequence) -> Iterator[tuple[int | None, int | None]]:
    """Children that differ, in order: those between two equal ones are paired from the left, the rest stand alone."""
    i = j = 0
    for to_i, to_j in (*in_both(x, y), (len(x), len(y))):
        yield from itertools.zip_longest(range(i, to_i), range(j, to_j))
        i, j = to_i + 1, to_j + 1


Branch = tuple[int | None, int | None, int | None, int | None]


def changed(a: str, b: str) -> list[Branch]:
    """(section, paragraph, other_section, other_paragraph) of the branches in which two trees differ.

    Equal roots end the search, and so do equal sections; the children of what differs are aligned by their digests, so an
    inserted paragraph is one branch without a place in ``a``, a removed one without a place in ``b``, and what comes
    after is not reported. A changed paragraph has both places; copies and the empty text report nothing against
    themselves. Two paragraphs that differ pass as equal with probability 2^-32.
    """
    if a[:ROOT_HEX] == b[:ROOT_HEX]:
        return []
    x, y = tree(a), tree(b)
    out: list[Branch] = []
    for i, j in gaps(x, y):
        for k, n in gaps(x[i] if i is not None else (), y[j] if j is not None else ()):
            out.append((i if k is not None else None, k, j if n is not None else None, n))
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of each document; a null text counts as empty, rows are independent of each other."""

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = part.column("text").to_pylist()
        yield batch(doc_id=part.column("doc_id"), n_chars=pa.array([len(t) for t in texts], pa.int64()), fingerprint=pa.array(map(fingerprint, texts), pa.string()))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return map_batches(rows, run, "doc_id long, n_chars long, fingerprint string")


def locate_edits(pairs: DataFrame, one: str = "fingerprint", other: str = "edited_fingerprint", column: str = "edits") -> DataFrame:
    """``pairs`` with the branches in which two fingerprints of a row differ (:func:`changed`); none where one is null.

    Rows are independent of each other; a column of the result's name is replaced.
    """
    kept = pairs.drop(column)

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [changed(a, b) if a and b else [] for a, b in zip(part.column(one).to_pylist(), part.column(other).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*part.columns, branches(found)], [*part.schema.names, column])

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, one):
            yield from run(part)

    return kept.mapInArrow(sliced, T.StructType([*kept.schema.fields, *T._parse_datatype_string(f"{column} {EDITS}").fields]))


def branches(found: list[list[Branch]]) -> pa.Array:
    flat = [b for own in found for b in own]
    first = np.concatenate([[0], np.cumsum([len(own) for own in found], dtype=np.int64)]).astype(np.int32)
    places = [pa.array([b[i] for b in flat], pa.int32()) for i in range(4)]
    return pa.ListArray.from_arrays(pa.array(first), pa.StructArray.from_arrays(places, fields=list(_EDITS.value_type)))


def edited_text(text: str, following: str) -> str:
    """The last half of the text replaced by as many code points from the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: A differing branch: its place in the one tree and in the other, null where a tree lacks it.
EDITS = "array<struct<section: int, paragraph: int, other_section: int, other_paragraph: int>>"
_EDITS = pa.list_(pa.struct([(c, pa.int32()) for c in ("section", "paragraph", "other_section", "other_paragraph")]))
#: Ranges that one sketch of the ids cuts; more come from a sketch inside each.
RANKS = 2048
COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
COMPARED += f"edits {EDITS}"


def range_borders(rows: DataFrame, ranges: int) -> np.ndarray:
    """Ascending ids that cut the rows into about so many even ranges.

    One sketch has at most ``RANKS`` ranks, so its size is fixed; where more ranges are wanted, a sketch inside each of
    its ranges, in Spark's own groups, cuts that one further. Only the borders reach the driver.
    """
    coarse = min(ranges, RANKS)
    found = rows.approxQuantile("doc_id", [i / coarse for i in range(1, coarse)], 0.2 / coarse) if coarse > 1 else []
    cuts = np.unique(np.array(found, float)).astype(np.int64)
    inner = -(-ranges // RANKS)
    if inner > 1:
        at = F.percentile_approx("doc_id", [i / inner for i in range(1, inner)], 10 * inner).alias("cuts")
        ids = rows.select("doc_id").where("doc_id IS NOT NULL")

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                own = part.column("doc_id")
                yield batch(at=np.searchsorted(cuts, own.to_numpy(zero_copy_only=False), side="left"), doc_id=own)

        more = ids.mapInArrow(place, "at long, doc_id long").groupBy("at").agg(at).collect()
        cuts = np.unique(np.concatenate([cuts, *(np.array(r["cuts"], np.int64) for r in more)]))
    return cuts


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's (descending id; after the last the first).

    ``edits`` has the branches in which the edited text's tree differs from the document's. The ids are cut into ranges of
    about one input task's rows (approximate quantiles, in two levels); each document goes to its
    range, and the first document of a range also to the range before, so every document meets its successor in one
    shuffle of the compressed texts and no range needs another. Only range borders and first ids (one per task) reach
    the driver. Null texts count as empty; null ids come last; rows that share an id are ordered by a hash of the text and
    lie in one range. One document is its own successor; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text).alias("text"))
    cuts = range_borders(rows, rows.rdd.getNumPartitions())

    def range_of(ids: pa.Array) -> np.ndarray:
        place = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left") + 1
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, place)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids = part.column("doc_id")
            yield batch(at=range_of(ids), doc_id=ids)

    first = rows.select("doc_id").mapInArrow(tops, "at long, doc_id long").groupBy("at").agg(F.max("doc_id").alias("doc_id")).orderBy("at").collect()
    heads = {r["at"]: r["doc_id"] for r in first}
    order = [r["at"] for r in first]
    before = dict(zip(order, order[1:] + order[:1], strict=True))

    def deal(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, at = part.column("doc_id"), range_of(part.column("doc_id"))
        blobs, out = [], []
        for i, (doc_id, place, value) in enumerate(zip(ids.to_pylist(), at.tolist(), part.column("text").to_pylist(), strict=True)):
            raw = value.encode("utf-8", "surrogatepass")
            blobs.append(len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True))
            out.append((place, False, i, digest(raw, 8)))
            if doc_id == heads[place]:
                out.append((before[place], True, i, out[-1][3]))
        take = pa.array([x[2] for x in out], pa.int64())
        yield batch(
            at=pa.array([x[0] for x in out], pa.int64()), guest=pa.array([x[1] for x in out], pa.bool_()), doc_id=ids.take(take),
            tie=pa.array([x[3] for x in out], pa.binary()), blob=pa.array(blobs, pa.binary()).take(take),
        )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, guests = None, None, False
        for part in batches:
            done = []
            for at, guest, doc_id, blob in zip(*(part.column(c).to_pylist() for c in ("at", "guest", "doc_id", "blob")), strict=True):
                if at != now:
                    now, last, guests = at, None, False
                if guests:
                    continue
                value = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True).decode("utf-8", "surrogatepass")
                mark = fingerprint(value)
                if last:
                    own_id, own, own_mark = last
                    edited = edited_text(own, value)
                    edited_mark = fingerprint(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    done.append((own_id, len(own), sha, own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark), changed(own_mark, edited_mark)))
                last, guests = (doc_id, value, mark), guest
            if done:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                columns = [pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*columns, branches([d[-1] for d in done])], [c.split()[0] for c in COMPARED.split(", ")[:7]] + ["edits"])

    dealt = map_batches(rows, deal, "at long, guest boolean, doc_id long, tie binary, blob binary")
    sorted_ = dealt.repartitionById(len(cuts) + 2, F.col("at").cast("int")).sortWithinPartitions("at", "guest", F.desc_nulls_last("doc_id"), "tie")
    return sorted_.select("at", "guest", "doc_id", "blob").mapInArrow(meet, COMPARED)
