"""Collocations: phrases of two to four words that occur together, counted in counting quotient filters.

Level by level: words first, then pairs, triples and quadruples of which all shorter parts are frequent (a part occurs at
least as often as its phrase, so nothing is lost). Frequent words get 32-bit ids; a phrase is its ids packed into one or two 64-bit
words. Tasks count into filters, filters of one range of quotients are merged, and the frequent phrases are stored as arrays that
the next level's tasks map into memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelab.llm import quotient
from tapelab.llm.common import GOLD, batch, bytes_of, keep, mix, slices, span_hashes, text_of
from tapelab.session import scratch

LONGEST, LEAST, BEST = 4, 30, 2000
#: A phrase goes if a longer one with its words has this share of its occurrences, in hundredths.
COVERED = 80
SCALE = 2_000_000
UNKNOWN = "und"
#: Words (of different spelling) or phrases that a task holds before it hands its counts on.
FLUSH_WORDS, FLUSH = 1 << 19, 1 << 21
#: Occurrences that a merging task gets, and entries of one stored file.
SHARD, FILE = 1 << 21, 1 << 22
#: Shards that a round of merging deals to, as a power of two.
FAN_BITS = 8

_CUT = np.zeros(256, bool)
_CUT[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _CUT.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EXACT = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLD)


def words_of(texts: pa.Array, langs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all rows: hash of (lang, lower-cased word), row, start and end byte, whether a piece begins; and the bytes.

    A piece begins at a row's first word and after any of the cutting characters.
    """
    raw, borders = bytes_of(texts)
    raw = _LOWER[raw]
    word = ~_GAP[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[borders] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False])))) + 1
    row = np.searchsorted(borders, starts, side="right") - 1
    cuts = np.cumsum(_CUT[raw])[starts] if len(starts) else np.zeros(0, np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (cuts[1:] != cuts[:-1]) | (row[1:] != row[:-1])
    lang = lang_hashes(langs)
    return mix(span_hashes(raw, starts, ends, _EXACT) ^ (lang[row] * GOLD)), row, starts, ends, fresh, raw


def lang_hashes(langs: pa.Array) -> np.ndarray:
    raw, at = bytes_of(langs)
    return span_hashes(raw, at[:-1], at[1:], _EXACT)


def spelled(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words of byte spans, as one string array."""
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(at[-1]) + np.repeat(starts - at[:-1], size)
    return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw[place])])


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, word, h, f); a row without word has the language's hash and all its words."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        h, f = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        text, lang = (pa.concat_arrays([x[i] for x in held]) for i in (2, 3))
        held.clear()
        order = np.argsort(h, kind="stable")
        at = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1]))) if len(h) else np.zeros(0, np.int64)
        one = order[at]
        total = np.add.reduceat(f[order], at) if len(at) else f
        return batch(lang=lang.take(pa.array(one)), word=text.take(pa.array(one)), h=h[one].view(np.int64), f=total)

    for part in slices(batches):
        langs = part.column("lang")
        h, row, starts, ends, _, raw = words_of(part.column("text"), langs)
        kinds, at, n = np.unique(h, return_index=True, return_counts=True)
        held.append((kinds, n.astype(np.int64), spelled(raw, starts[at], ends[at]), langs.take(pa.array(row[at]))))
        all_words = np.bincount(row, minlength=len(langs)).astype(np.int64)
        held.append((lang_hashes(langs), all_words, pa.nulls(len(langs), pa.string()), langs))
        if sum(len(x[0]) for x in held) >= FLUSH_WORDS:
            yield flush()
    if held:
        yield flush()


def grouped(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of one key after another, from batches sorted by it."""
    now, held = None, []
    for part in batches:
        keys = list(zip(*(part.column(c).to_pylist() for c in names), strict=True))
        a = 0
        for b in range(1, len(keys) + 1):
            if b == len(keys) or keys[b] != keys[a]:
                if keys[a] != now:
                    if held:
                        yield now, pa.Table.from_batches(held)
                    now, held = keys[a], []
                held.append(part.slice(a, b - a))
                a = b
    if held:
        yield now, pa.Table.from_batches(held)


def file_bits(rows: int) -> int:
    return max(0, (rows - 1) // FILE).bit_length()


def mounted(path: str) -> str:
    """The shared folder as a path that workers can map into memory."""
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"{path}: the filters are memory-mapped; name a mounted shared folder in spark.checkpoint.dir")
    return found.path


class Dictionary:
    """Ids of the frequent words: stored arrays by hash and, file after file, by id; ``rows`` has (id, lang, word)."""

    def __init__(self, counted: DataFrame, folder: str) -> None:
        words = counted.where(F.col("word").isNotNull())
        total = words.count()
        if total >= 1 << 32:
            raise ValueError(f"{total} frequent words do not fit 32-bit ids; raise the least count")
        self.folder, self.bits = folder, file_bits(total)
        file = F.shiftrightunsigned("h", 64 - self.bits) if self.bits else F.lit(0).cast("long")
        words = words.withColumn("file", file)
        sizes = {r.file: r["count"] for r in words.groupBy("file").count().collect()}  # one row per stored file
        self.starts = [sum(sizes.get(i, 0) for i in range(f)) for f in range(1 << self.bits)]
        folder, bits, starts = self.folder, self.bits, self.starts

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (f,), rows in grouped(batches, "file"):
                h = rows.column("h").to_numpy().view(np.uint64)
                order = np.argsort(h)
                rows, h = rows.take(pa.array(order)), h[order]
                if (h[1:] == h[:-1]).any():
                    raise ValueError("two frequent words share a 64-bit hash")
                ids = np.arange(len(h), dtype=np.uint64) + np.uint64(starts[f] + 1)
                values = {"id": ids, "count": rows.column("f").to_numpy(), "lang": lang_hashes(rows.column("lang").combine_chunks())}
                quotient.store_filter(folder, f, (h,), values, bits)
                yield from pa.table({"id": ids.astype(np.int64), "lang": rows.column("lang"), "word": rows.column("word")}).combine_chunks().to_batches()

        dealt = words.repartitionByRange(1 << self.bits, "file").sortWithinPartitions("file")
        self.rows = keep(dealt.mapInArrow(write, "id long, lang string, word string"), "phrases-words")

    def ids(self, h: np.ndarray) -> np.ndarray:
        return quotient.find(self.folder, (h,), ["id"], self.bits)[0].astype(np.uint32)

    def of_ids(self, ids: np.ndarray, name: str) -> np.ndarray:
        out = np.zeros(len(ids), np.uint64)
        place = ids.astype(np.int64) - 1
        file = np.searchsorted(self.starts, place, side="right") - 1
        for f in np.unique(file).tolist():
            at = file == f
            out[at] = quotient.mapped(f"{self.folder}/{f}-{name}")[place[at] - self.starts[f]]
        return out

    def light(self) -> Dictionary:
        """The same without its DataFrame, for tasks."""
        out = Dictionary.__new__(Dictionary)
        out.folder, out.bits, out.starts = self.folder, self.bits, self.starts
        return out


def id_rows(docs: DataFrame, known: Dictionary) -> DataFrame:
    """Slices of texts as word ids (32-bit, binary), 0 between pieces and for words that are not frequent; n is how many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            h, _, _, _, fresh, _ = words_of(part.column("text"), part.column("lang"))
            kinds, at = np.unique(h, return_inverse=True)
            ids = known.ids(kinds)[at]
            out = np.zeros(len(ids) + int(fresh.sum()), np.uint32)
            out[np.arange(len(ids)) + np.cumsum(fresh)] = ids
            out = out[(out != 0) | np.concatenate(([True], out[:-1] != 0))] if len(out) else out
            yield batch(n=[len(out)], ids=pa.array([out.astype("<u4").tobytes()], pa.binary()))

    return docs.mapInArrow(run, "n long, ids binary")


def packed(ids: np.ndarray, n: int) -> quotient.Keys:
    """The phrases of n words in a (m, n) array of ids, as one word (pairs) or two."""
    wide = ids.astype(np.uint64)
    first = (wide[:, 0] << np.uint64(32)) | wide[:, 1]
    if n == 2:
        return (first,)
    return first, (wide[:, 2] << np.uint64(32)) | (wide[:, 3] if n > 3 else np.uint64(0))


def unpacked(keys: quotient.Keys, n: int) -> np.ndarray:
    low = np.uint64((1 << 32) - 1)
    return np.stack([x for k in keys for x in (k >> np.uint64(32), k & low)], axis=1)[:, :n].astype(np.uint32)


def frequency(ids: np.ndarray, known: Dictionary, levels: dict[int, tuple[str, int]]) -> np.ndarray:
    """How often each row of ids (one word or more) occurs, for frequent ones; else 0."""
    n = ids.shape[1]
    if n == 1:
        return known.of_ids(ids[:, 0], "count")
    folder, bits = levels[n]
    return quotient.find(folder, quotient.permute(packed(ids, n)), ["count"], bits)[0]


def count_level(n: int, known: Dictionary, levels: dict[int, tuple[str, int]], bits: int):
    """Counts the phrases of n words of which both parts of n - 1 are frequent, into filters by the top ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = quotient.summed(tuple(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            yield from filter_rows(part, keys, counts, bits)

        for rows in batches:
            for data in rows.column("ids"):
                ids = np.frombuffer(data.as_buffer(), "<u4")
                for a in range(0, len(ids), FLUSH):  # a phrase that begins in a stretch may end behind it
                    some = np.lib.stride_tricks.sliding_window_view(ids[a : a + FLUSH + n - 1], n) if len(ids) - a >= n else np.zeros((0, n), np.uint32)
                    some = some[(some != 0).all(axis=1)]
                    if n > 2 and len(some):
                        some = some[frequency(some[:, :-1], known, levels) > 0]
                        some = some[frequency(some[:, 1:], known, levels) > 0]
                    if len(some):
                        held.append(quotient.permute(packed(some, n)))
                    if sum(len(h[0]) for h in held) >= FLUSH:
                        yield from flush()
        if held:
            yield from flush()

    return run


FILTERS = "part long, shard long, data binary"


def filter_rows(part: int, keys: quotient.Keys, counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    for shard, a, b in quotient.runs(keys, bits):
        data = quotient.pack(tuple(k[a:b] for k in keys), counts[a:b], bits)
        yield batch(part=[part], shard=[shard], data=pa.array([data], pa.binary()))


def merged(filters: DataFrame, bits: int, least: int, width: int) -> DataFrame:
    """(k0, k1, f): all keys that the filters hold ``least`` times, from filters dealt by the first FAN_BITS bits of ``bits``.

    Rounds deal to 2^FAN_BITS times as many shards each. Before the last, the tasks that merge one shard share it by the parts
    its filters come from, so every round has 2^``bits`` merging tasks and no task writes more than 2^FAN_BITS filters.
    """
    done = min(bits, FAN_BITS)
    while True:
        last, groups = done == bits, 1 << (bits - done)
        after = min(bits, done + FAN_BITS)

        def merge(batches: Iterator[pa.RecordBatch], last: bool = last, after: int = after) -> Iterator[pa.RecordBatch]:
            for (_, group), rows in grouped(batches, "shard", "group"):
                keys, counts = zip(*(quotient.unpack(x.as_buffer()) for x in rows.column("data")), strict=True)
                keys, counts = quotient.summed(tuple(map(np.concatenate, zip(*keys, strict=True))), np.concatenate(counts))
                if not last:
                    yield from filter_rows(group, keys, counts, after)
                    continue
                often = counts >= least
                keys = tuple(k[often].view(np.int64) for k in keys)
                yield batch(k0=keys[0], k1=keys[-1], f=counts[often].astype(np.int64))

        dealt = filters.withColumn("group", F.col("part") % groups)
        dealt = dealt.repartition(1 << bits, "shard", "group").sortWithinPartitions("shard", "group")
        if last:
            return dealt.mapInArrow(merge, "k0 long, k1 long, f long")
        filters, done = dealt.mapInArrow(merge, FILTERS), after


def store_level(found: DataFrame, n: int, folder: str) -> tuple[str, int]:
    """Stores the frequent phrases of n words as arrays to map; returns their folder and how many bits name a file."""
    bits, folder, width = file_bits(found.count()), f"{folder}/{n}", 1 if n == 2 else 2

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (f,), rows in grouped(batches, "file"):
            keys = tuple(rows.column(f"k{i}").to_numpy().view(np.uint64) for i in range(width))
            keys, counts = quotient.summed(keys, rows.column("f").to_numpy())
            quotient.store_filter(folder, f, keys, {"count": counts}, bits)
            yield batch(n=[len(counts)])

    file = F.shiftrightunsigned("k0", 64 - bits) if bits else F.lit(0).cast("long")
    dealt = found.withColumn("file", file).repartitionByRange(1 << bits, "file").sortWithinPartitions("file")
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()
    return folder, bits


def candidate_rows(found: DataFrame, n: int, known: Dictionary, levels: dict[int, tuple[str, int]]) -> DataFrame:
    """lang_h, ids, a, and for every cut in turn the counts of its first part and of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys = tuple(rows.column(f"k{i}").to_numpy().view(np.uint64) for i in range(1 if n == 2 else 2))
            ids = unpacked(quotient.restore(keys), n)
            parts = [[frequency(p, known, levels) for p in (ids[:, :k], ids[:, k:])] for k in range(1, n)]
            left, right = (np.stack([p[i] for p in parts], axis=1).astype(np.int64) for i in (0, 1))
            at = lambda k: pa.array(np.arange(len(ids) + 1, dtype=np.int32) * k)
            as_list = lambda x: pa.ListArray.from_arrays(at(x.shape[1]), pa.array(x.reshape(-1)))
            yield batch(
                lang_h=known.of_ids(ids[:, 0], "lang").view(np.int64), ids=as_list(ids.astype(np.int64)), a=rows.column("f"),
                left=as_list(left), right=as_list(right),
            )

    return found.mapInArrow(run, "lang_h long, ids array<long>, a long, left array<long>, right array<long>")


def counted_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The candidates (lang_h, ids, a, left, right), the frequent words (id, lang, word), the languages (lang, lang_h, n)."""
    spark = docs.sparkSession
    folder = mounted(scratch(spark, "phrases"))
    rows = docs.select(text_of().alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    counted = rows.mapInArrow(word_counts, "lang string, word string, h long, f long")
    counted = counted.groupBy("lang", "word", "h").agg(F.sum("f").alias("f"))
    counted = keep(counted.where((F.col("f") >= least) | F.col("word").isNull()), "phrases-counts")
    langs = counted.where("word is null").select("lang", F.col("h").alias("lang_h"), F.col("f").alias("n"))
    words = Dictionary(counted, f"{folder}/1")
    known = words.light()
    ids = keep(id_rows(rows, known), "phrases-ids")
    bits = max(0, int(ids.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) - 1) // SHARD
    bits, levels, found = bits.bit_length(), {}, []
    for n in range(2, longest + 1):
        filters = ids.mapInArrow(count_level(n, known, dict(levels), min(bits, FAN_BITS)), FILTERS)
        level = keep(merged(filters, bits, least, 1 if n == 2 else 2), f"phrases-{n}")
        levels[n] = store_level(level, n, folder)
        found.append((level, n))
    rows = None
    for level, n in found:
        scored = candidate_rows(level, n, known, levels)
        rows = scored if rows is None else rows.unionByName(scored)
    return keep(rows, "phrases-candidates"), words.rows, langs


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``best`` phrases of two to four words that occur ``least`` times.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs; phrases do not
    leave their piece. Null texts are empty; null languages count as 'und'; repeated rows count each time; other columns are
    ignored; an empty table gives no row. A score is floor(2,000,000 a / (l + r)) of the lowest-scoring cut, in decimals. Words are told apart
    by 64-bit hashes (two frequent ones that share one raise an error).
    """
    found, words, langs = counted_phrases(docs, least)
    size = F.size("ids")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("ids", i, m))))
    inner = found.where(size > 2).select("a", F.explode(spans).alias("ids")).groupBy("ids").agg(F.max("a").alias("longer"))
    found = found.join(inner, "ids", "left").where(F.coalesce(100 * F.col("longer") < COVERED * F.col("a"), F.lit(True)))
    cut = F.expr(
        f"array_min(transform(left, (l, i) -> struct(cast(cast(a as decimal(28,0)) * {SCALE} div (cast(l as decimal(20,0)) + right[i]) as bigint)"
        " as score, i as k, l as l, right[i] as r)))"
    )
    found = found.withColumn("cut", cut).select("lang_h", "ids", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang_h").orderBy(F.desc("score"), F.desc("a"))
    found = found.withColumn("place", F.rank().over(order)).where(F.col("place") <= best).drop("place")
    found = keep(found, "phrases-best")
    spelled = found.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("w"))
    found = found.join(spelled, "ids").join(langs, "lang_h").withColumn("phrase", F.array_join("w", " "))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
