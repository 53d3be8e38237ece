"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, memory-mapped to score."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.llm.common import GOLD, batch, map_batches, mix, rows_of, slices, text_of, words
from tapelab.session import scratch

#: Tokens that a task counts before it hands its sums on.
FLUSH = 4_000_000
#: The end of a text as a predicted token, and its beginning as a context.
END, BEGIN = np.uint64(0xE4D0000000000001), np.uint64(0xBE61000000000001)
#: Bigrams carry the first 48 bits of their words' hashes.
CUT = np.uint64(16)
UNI, BI, CONT, ONE, TWO, MORE, TOTAL = range(7)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of all rows (words, then one end each), of the token before each, and the rows' first tokens."""
    hashed, first = words(texts)
    rows = np.arange(len(first) - 1)
    token = np.empty(len(hashed) + len(rows), np.uint64)
    token[np.arange(len(hashed)) + rows_of(first)] = hashed
    token[first[1:] + rows] = END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    starts = first + np.arange(len(first))
    before[starts[:-1]] = BEGIN
    return token, before, starts


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * GOLD + mix(w + GOLD))


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def pack(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Keys in 6 or 8 bytes each, ordered by count: those counted once carry no count."""
    order = np.argsort(counts != 1, kind="stable")
    once = int((counts == 1).sum())
    head = np.array([len(counts), once, len(columns), columns[0].itemsize], np.int64)
    return b"".join([head.tobytes(), *(c[order].tobytes() for c in columns), counts[order][once:].astype(np.uint64).tobytes()])


def unpack(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    n, once, k, width = np.frombuffer(data, np.int64, 4)
    at, columns = 32, []
    for _ in range(k):
        columns.append(np.frombuffer(data, f"V{width}", n, at))
        at += n * width
    counts = np.ones(n, np.uint64)
    counts[once:] = np.frombuffer(data, np.uint64, n - once, at)
    return columns, counts


def short(keys: np.ndarray) -> np.ndarray:
    """48-bit keys as 6 bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").reshape(-1)


def full(keys: np.ndarray) -> np.ndarray:
    if keys.dtype.itemsize == 8:
        return keys.view(np.uint64)
    out = np.zeros((len(keys), 8), np.uint8)
    out[:, :6] = keys.view(np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def tally(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys))).astype(np.uint64)


def sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of one occurrence of each, and the sum of the counts of each."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[at], order[at], np.add.reduceat(counts[order], at) if len(at) else np.zeros(0, np.uint64)


def runs(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """Each shard of sorted keys, and where it starts and ends."""
    shard = shard_of(keys, bits)
    cut = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(keys)])) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield int(shard[a]), a, b


def parts(kind: int, keys: np.ndarray, columns: list[np.ndarray], counts: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (kind, shard, data) of what is sorted by ``keys``."""
    for shard, a, b in runs(keys, bits):
        yield batch(kind=[kind], shard=[shard], data=pa.array([pack([c[a:b] for c in columns], counts[a:b])], pa.binary()))


SCHEMA = "kind long, shard long, data binary"


def count_rows(bits: int, word_bits: int):
    def flush(token: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, n = tally(np.concatenate((token, before[before == BEGIN])))
        yield from parts(UNI, keys, [keys.view("V8")], n, word_bits)
        order = np.argsort(keys := pair_key(before >> CUT, token >> CUT))
        keys = keys[order]
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        n = np.diff(np.append(at, len(keys))).astype(np.uint64)
        keys, order = keys[at], order[at]
        yield from parts(BI, keys, [short(before[order] >> CUT), short(token[order] >> CUT)], n, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def gathered() -> Iterator[pa.RecordBatch]:
            token, before = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            held.clear()
            yield from flush(token, before)

        for part in slices(batches):
            held.append(tokens(part.column("text"))[:2])
            if sum(len(t) for t, _ in held) >= FLUSH:
                yield from gathered()
        if held:
            yield from gathered()

    return run


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
    """The data of one (kind, shard) after another, from rows sorted by both."""
    now, held = None, []
    for part in batches:
        for kind, shard, data in zip(*(part.column(c).to_pylist() for c in ("kind", "shard", "data")), strict=True):
            if (kind, shard) != now:
                if held:
                    yield *now, held
                now, held = (kind, shard), []
            held.append(data)
    if held:
        yield *now, held


def store(folder: str, name: str, values: np.ndarray) -> None:
    """Writes an array under its final name at once, so a repeated task does no harm."""
    os.makedirs(folder, exist_ok=True)
    aside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    values.tofile(aside)
    os.replace(aside, f"{folder}/{name}")


def smallest(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == i).sum() for i in range(1, 5)], np.int64)


def merge_rows(folder: str, word_bits: int):
    """Sums a shard's bigrams, stores them, and hands on what its words and contexts need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, shard, held in by_shard(batches):
            columns, counts = zip(*map(unpack, held), strict=True)
            counts = np.concatenate(counts)
            if kind == UNI:
                keys, _, n = sums(full(np.concatenate([c[0] for c in columns])), counts)
                yield from parts(UNI, keys, [keys.view("V8")], n, word_bits)
                continue
            v, w = (full(np.concatenate([c[i] for c in columns])) for i in (0, 1))
            keys, at, n = sums(pair_key(v, w), counts)
            v, w = v[at], w[at]
            values = smallest(n)
            store(folder, f"pairs-{shard}-{values.dtype}", values)
            store(folder, f"pairs-{shard}", keys)
            for what, key in ((CONT, w), (ONE, v[n == 1]), (TWO, v[n == 2]), (MORE, v[n > 2])):
                key, times = tally(key << CUT)
                yield from parts(what, key, [short(key >> CUT)], times, word_bits)
            total = np.concatenate((of_counts(n), [0] * 10)).astype(np.int64)
            yield batch(kind=[TOTAL], shard=[0], data=pa.array([total.tobytes()], pa.binary()))

    return run


def word_rows(folder: str):
    """Stores each shard of words: key, count, continuation count, and its followers by count (1, 2, more)."""

    def finish(shard: int, got: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        zero = np.zeros(0, np.uint64)
        keys, count = got.get(UNI, (zero, zero))
        own = keys >> CUT
        kept = [count]
        for what in (CONT, ONE, TWO, MORE):
            have, n = got.get(what, (zero, zero))
            out = np.zeros(len(keys), np.uint64)
            at = np.minimum(np.searchsorted(have, own), max(0, len(have) - 1))
            if len(have):
                hit = have[at] == own
                out[hit] = n[at[hit]]
            kept.append(out)
        store(folder, f"words-{shard}", np.concatenate([keys, *kept]))
        token, cont = keys != BEGIN, kept[1]
        more = [count[token].sum(), token.sum(), cont.sum(), (cont == 1).sum(), (cont == 2).sum(), (cont > 2).sum()]
        return np.concatenate(([0] * 4, of_counts(cont), more)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, {}
        total = np.zeros(14, np.int64)
        for kind, shard, held in by_shard(batches):
            if kind == TOTAL:
                total += sum(np.frombuffer(x, np.int64) for x in held)
                continue
            if shard != now and got:
                total += finish(now, got)
                got = {}
            now = shard
            columns, counts = zip(*map(unpack, held), strict=True)
            keys, _, n = sums(full(np.concatenate([c[0] for c in columns])), np.concatenate(counts))
            got[kind] = (keys, n)
        if got:
            total += finish(now, got)
        yield batch(**{f"t{i}": [int(x)] for i, x in enumerate(total)})

    return run


def discounts(n: list[int]) -> list[float]:
    """The three discounts from the numbers of n-grams counted 1 to 4 times; 0.5, 1, 1.5 where they aren't defined.

    They are held between 0.05 and k, so that every context leaves something to the words it was not seen with.
    """
    out = []
    for k in (1, 2, 3):
        ok = n[0] and n[1] and n[k - 1]
        d = k - (k + 1) * (n[0] / (n[0] + 2 * n[1])) * n[k] / n[k - 1] if ok else k / 2
        out.append(min(max(d, 0.05), float(k)))
    return out


def mounted(path: str) -> str:
    """The shared folder as a path that workers can map into memory."""
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"{path}: the model's arrays are memory-mapped; name a mounted shared folder in `folder`")
    return found.path


@functools.lru_cache(maxsize=1 << 16)
def mapped(path: str, kind: str) -> np.ndarray | None:
    try:
        return np.memmap(path, np.dtype(kind), "r") if os.path.getsize(path) else None
    except FileNotFoundError:
        return None


@functools.lru_cache(maxsize=1 << 16)
def pairs_of(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray] | None:
    keys = mapped(f"{folder}/pairs-{shard}", "u8")
    if keys is None:
        return None
    return keys, next(v for k in ("uint8", "uint16", "uint32", "uint64") if (v := mapped(f"{folder}/pairs-{shard}-{k}", k)) is not None)


def looked_up(keys: np.ndarray, bits: int, columns: int, table) -> np.ndarray:
    """For sorted distinct keys the values of each column (0 where a key is missing)."""
    out = np.zeros((columns, len(keys)), np.int64)
    for shard, a, b in runs(keys, bits):
        have = table(shard)
        if have is None:
            continue
        at = np.searchsorted(have[0], keys[a:b])
        at[at == len(have[0])] = 0
        hit = have[0][at] == keys[a:b]
        for i in range(columns):
            out[i, a:b][hit] = have[i + 1][at[hit]]
    return out


def train(docs: DataFrame, folder: str | None = None) -> dict:
    """Counts the model over all rows of (text) and stores it under ``folder``; returns what is needed to score.

    Each task sums its own tokens before the shuffle, so a frequent word or pair is one row of a task. Bigrams are dealt
    by the hash of the pair, words by their own hash; a shard holds about half of what one input task reads. The arrays grow with
    the corpus; only the folder's name and fourteen totals reach the driver.
    """
    folder = mounted(folder or scratch(docs.sparkSession, "ngrams"))
    tasks = max(1, docs.rdd.getNumPartitions())
    bits, word_bits = (2 * tasks - 1).bit_length(), max(0, (tasks // 4).bit_length())
    counted = docs.select(text_of().alias("text")).mapInArrow(count_rows(bits, word_bits), SCHEMA)
    shard = F.col("shard").cast("int")
    merged = counted.repartitionById(1 << bits, shard).sortWithinPartitions("kind", "shard").mapInArrow(merge_rows(folder, word_bits), SCHEMA)
    dealt = merged.select("shard", "kind", "data").repartitionById(1 << word_bits, shard).sortWithinPartitions("shard", "kind")
    total = dealt.mapInArrow(word_rows(folder), ", ".join(f"t{i} long" for i in range(14)))
    n = [int(x or 0) for x in total.agg(*(F.sum(f"t{i}") for i in range(14))).first()]
    return {"folder": folder, "bits": bits, "word_bits": word_bits, "pairs": discounts(n[:4]), "words": discounts(n[4:8])} | dict(
        zip(("tokens", "vocabulary", "cont", "one", "two", "more"), n[8:], strict=True)
    )


def word_table(folder: str, shard: int) -> list[np.ndarray] | None:
    flat = mapped(f"{folder}/words-{shard}", "u8")
    return None if flat is None else list(flat.reshape(6, -1))


def score_texts(texts: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: tokens, known tokens, base score and the model's log10 probability."""
    token, before, starts = tokens(texts)
    row = rows_of(starts)
    rows = len(starts) - 1
    kinds, at = np.unique(np.concatenate((token, before)), return_inverse=True)
    count, cont, one, two, more = looked_up(kinds, model["word_bits"], 5, lambda s: word_table(model["folder"], s))
    keys, pair_at = np.unique(pair_key(before >> CUT, token >> CUT), return_inverse=True)
    pair = looked_up(keys, model["bits"], 1, lambda s: pairs_of(model["folder"], s))[0][pair_at].astype(float)
    at, ctx = at[: len(token)], at[len(token) :]
    d, e = np.array([0.0, *model["pairs"]]), np.array([0.0, *model["words"]])
    uniform, everything = 1.0 / (model["vocabulary"] + 1), max(1, model["cont"])
    spare = (e[1] * model["one"] + e[2] * model["two"] + e[3] * model["more"]) / everything if model["cont"] else 1.0
    word = np.maximum(cont - e[np.minimum(cont, 3)], 0) / everything + spare * uniform
    seen = count[ctx].astype(float)
    left = d[1] * one[ctx] + d[2] * two[ctx] + d[3] * more[ctx]
    safe = np.maximum(seen, 1.0)
    p = np.where(seen > 0, np.maximum(pair - d[np.minimum(pair, 3).astype(int)], 0) / safe + left / safe * word[at], word[at])
    known = count[at] > 0
    base = np.log10((count[at] + 1.0) / (model["tokens"] + model["vocabulary"] + 1.0))
    add = lambda x: np.bincount(row, x, rows)
    return np.diff(starts), add(known).astype(np.int64), add(base), add(np.log10(p))


def score(docs: DataFrame, model: dict, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every whole text under a trained model."""

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, known, base, own = score_texts(part.column("text"), model)
        yield batch(doc_id=part.column("doc_id"), n_tokens=n.astype(np.int64), n_known=known, base_score=base, score=own)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of().alias("text"))
    return map_batches(rows, run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
