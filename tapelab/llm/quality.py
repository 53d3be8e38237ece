"""Quality classifier: random-indexing vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.llm.common import GOLD, batch, bytes_of, fold_of, keep, kept_rows, list_array, map_batches, mix, slices, span_hashes, text_of, word_spans

#: Hash buckets of words and of word shapes, and the length of their vectors: 3.2 MB, whatever the corpus.
WORD_BUCKETS, SHAPE_BUCKETS, WIDTH = 1 << 14, 1 << 10, 48
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
#: Tasks whose matrices are added before the last sum.
GROUP = 1024
#: Each index vector has so many entries of 1 or -1; a word gathers those of the words beside it.
ENTRIES = 2
#: Labelled rows that the network is fitted on, at most; every fifth of them calibrates the temperature.
SAMPLE = 20_000
HIDDEN, EPOCHS, STEP, DECAY = 32, 40, 2e-3, 1e-4
#: A score of at least this is predicted good.
CUT = 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91], _CLASS[48:58] = ord("A"), ord("0")
_PLAIN = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * GOLD)


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each word, of its shape, and the rows' first words.

    In a shape runs of one class of characters count once; a word that repeats the one before has the shape of a repetition.
    """
    raw, borders = bytes_of(texts)
    starts, ends, first = word_spans(raw, borders)
    hashed = span_hashes(raw, starts, ends)
    word = hashed % np.uint64(WORD_BUCKETS)
    kind = _CLASS[raw]
    kept = np.ones(len(raw), bool)
    kept[1:] = kind[1:] != kind[:-1]
    kept[starts] = True
    at = np.concatenate(([0], np.cumsum(kept)))
    shape = span_hashes(kind[kept], at[starts], at[ends], _PLAIN) % np.uint64(SHAPE_BUCKETS)
    again = np.zeros(len(hashed), bool)
    again[1:] = hashed[1:] == hashed[:-1]
    again[first[:-1][first[:-1] < len(hashed)]] = False
    shape[again] = 0
    return word.astype(np.int64), shape.astype(np.int64) + WORD_BUCKETS, first


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's index vector."""
    drawn = mix(np.arange(BUCKETS * ENTRIES, dtype=np.uint64) * GOLD + np.uint64(7)).reshape(BUCKETS, ENTRIES)
    return (drawn % np.uint64(WIDTH)).astype(np.int64), np.where(drawn >> np.uint64(63), 1, -1).astype(np.int64)


def gather(texts: pa.Array, into: np.ndarray) -> None:
    """Adds to each word's (and shape's) vector the index vectors of the words (shapes) on its left and right."""
    places, signs = index_vectors()
    word, shape, first = buckets(texts)
    inner = np.ones(max(0, len(word) - 1), bool)
    inner[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(word))] - 1] = False
    for ids in (word, shape):
        a, b = ids[:-1][inner], ids[1:][inner]
        to, of = np.concatenate((a, b)), np.concatenate((b, a))
        for e in range(ENTRIES):
            into += np.bincount(to * WIDTH + places[of, e], signs[of, e], BUCKETS * WIDTH).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all buckets, from the neighbours of every word of every text.

    Each task sums its own matrix; matrices are added in as many blocks as there are buckets / 512, first those of each
    ``GROUP`` tasks, then the sums. These (of whole numbers, so the order of tasks doesn't matter) are all that reaches the driver: one
    fixed-size matrix.
    """
    size = 512 * WIDTH

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * WIDTH, np.int64)
        for part in slices(batches):
            gather(part.column("text"), total)
        blocks = total.reshape(-1, size)
        group = np.full(len(blocks), TaskContext.get().partitionId() // GROUP)
        yield batch(block=np.arange(len(blocks)), group=group, data=pa.array([b.tobytes() for b in blocks], pa.binary()))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for part in batches:
            for block, group, data in zip(part.column("block").to_pylist(), part.column("group").to_pylist(), part.column("data"), strict=True):
                total[block, group] = total.get((block, group), 0) + np.frombuffer(data.as_buffer(), np.int64)
        block, group = (pa.array([k[i] for k in total], pa.int64()) for i in (0, 1))
        yield batch(block=block, group=group, data=pa.array([b.tobytes() for b in total.values()], pa.binary()))

    schema = "block long, group long, data binary"
    summed = docs.select(text_of().alias("text")).mapInArrow(partial, schema).repartition("block", "group").mapInArrow(add, schema)
    summed = summed.withColumn("group", F.lit(0).cast("long")).repartition(BUCKETS // 512, "block").mapInArrow(add, schema)
    matrix = np.zeros((BUCKETS * WIDTH // size, size))
    for row in summed.collect():
        matrix[row["block"]] = np.frombuffer(row["data"], np.int64)
    matrix = matrix.reshape(BUCKETS, WIDTH)
    return (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1.0)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Per row the mean vectors of its words and of their shapes; zeros without words."""
    word, shape, first = buckets(texts)
    count = np.diff(first)
    out = np.zeros((len(count), 2 * WIDTH), np.float32)
    some = count > 0
    if some.any():
        for i, ids in enumerate((word, shape)):
            out[some, i * WIDTH : (i + 1) * WIDTH] = np.add.reduceat(vectors[ids], first[:-1][some], axis=0) / count[some, None]
    return out


class Network:
    """Two layers: tanh, then one logit, divided by a temperature that was fitted on rows set aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11):
        self.temperature = 1.0
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-3
        aside = np.arange(len(y)) % 5 == 4
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.fit((x[~aside] - self.shift) / self.scale, y[~aside], rng)
        if aside.any() and 0 < y[aside].sum() < aside.sum():
            z = self.logits(x[aside])
            steps = np.geomspace(0.2, 10, 100)
            loss = [np.logaddexp(0, -np.where(y[aside] > 0, z, -z) / t).mean() for t in steps]
            self.temperature = float(steps[int(np.argmin(loss))])

    def fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        """Adam on the logistic loss, in small batches."""
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(max(EPOCHS, 100_000 // max(1, len(y)))):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 256):
                xs, ys = x[order[at : at + 256]], y[order[at : at + 256]]
                h = np.tanh(xs @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - ys) / len(ys)
                back = np.outer(d, self.w[2]) * (1 - h * h)
                grads = [xs.T @ back + DECAY * self.w[0], back.sum(0), h.T @ d + DECAY * self.w[2], d.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - STEP * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.shift) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


def labelled_sample(rows: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled rows outside the held-out fold, chosen by a hash of the id.

    The chosen ids and labels are a table of bounded size, so only the texts of their documents are pooled here.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    known = known.where(fold_of("doc_id", 5) != 0)
    size = max(1, known.count())
    # a little more than the part that is wanted passes the draw, on 63 bits; the limit then takes the first ``most`` of it
    draw = F.xxhash64("doc_id").bitwiseAND((1 << 63) - 1)
    until = ((1 << 63) - 1) * min(size, most * 11 // 10 + 100) // size
    drawn = keep(known.withColumn("draw", draw).where(F.col("draw") <= until).orderBy("draw", "doc_id").limit(most), "drawn")

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = pooled(part.column("text"), vectors)
        features = list_array(found.reshape(-1), np.arange(len(found) + 1) * 2 * WIDTH)
        yield batch(features=features, quality=part.column("quality"), draw=part.column("draw"), doc_id=part.column("doc_id"))

    chosen = map_batches(rows.join(drawn, "doc_id"), run, "features array<float>, quality double, draw long, doc_id long")
    held = chosen.orderBy("draw", "doc_id", "features").limit(most).toArrow()
    y = held.column("quality").to_numpy().astype(float)
    return np.array(held.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(y), 2 * WIDTH), y


def scorer(rows: DataFrame, labels: DataFrame):
    """The function from texts to scores that ``rows`` (doc_id, text) and ``labels`` teach."""
    vectors = word_vectors(rows)
    x, y = labelled_sample(rows, labels, vectors)
    both = len(y) and 0 < y.sum() < len(y)
    network = Network(x, y) if both else None
    constant = float(y.mean()) if len(y) else 0.5

    def scores(texts: pa.Array) -> np.ndarray:
        return network.scores(pooled(texts, vectors).astype(float)) if network else np.full(len(texts), constant)

    return scores


def score_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Word vectors come from all texts, the network from a bounded sample of labels (``SAMPLE``) outside the fold that is held
    out (crc32 of the id as text, modulo 5, is 0). Scores depend on the text alone. Null and empty texts have zero
    features and get the score of those; without labels, or with one kind of label, every score is that label's (0.5 without
    any); repeated ids are scored each; repeated labels count once, the lower one; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text).alias("text"))
    scores = scorer(rows, labels)

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch(doc_id=part.column("doc_id"), score=scores(part.column("text")))

    scored = map_batches(rows, run, "doc_id long, score double")
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are predicted good, with all their columns; every row is judged by itself, in one pass."""
    scores = scorer(docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text).alias("text")), labels)
    return kept_rows(docs, text, lambda texts: scores(texts) >= CUT)
