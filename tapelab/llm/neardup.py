"""Near-duplicates by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.llm.common import GOLD, batch, bytes_of, keep, list_array, map_batches, mix, rows_of, words

#: 40 bands of 5 bins: a pair of similarity 0.8 shares no band with probability 1.2e-7.
BANDS, BINS_PER_BAND = 40, 5
#: Rounds in which the copies of a bucket are compared with one of them, before all open pairs are.
ROUNDS = 2
#: Items (and so many more for each set) that one block of sets holds.
BLOCK_ITEMS, NODE_WEIGHT = 32_768, 64


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of each row, and each row's first (n + 1 values).

    A row with fewer words than ``size`` has its whole sequence as its one shingle, a row without words none.
    """
    hashed, first = words(texts)
    count = np.diff(first)
    row = rows_of(first)
    place = np.arange(len(hashed)) - first[row]
    value = np.full(len(hashed), np.uint64(size))
    for i in range(size):
        moved = np.zeros(len(hashed), np.uint64)
        moved[: max(0, len(hashed) - i)] = hashed[i:]
        value = mix(value * GOLD + np.where(place + i < count[row], moved, np.uint64(0)) + np.uint64(i))
    whole = (place == 0) | (place + size <= count[row])
    row, value = row[whole], value[whole]
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[fresh], np.searchsorted(row[fresh], np.arange(len(count) + 1))


def set_hash(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit hash per row of its whole set."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values + GOLD), out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64) * GOLD)


def sketches(values: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """Fast similarity sketch of each non-empty row: ``bins`` values; empty rows stay at the largest value.

    In round i every element goes to one bin with a value of i and a fraction; a bin keeps its smallest value. In the
    rounds from ``bins`` on every element goes to bin i - bins, so each bin is full after 2 x bins rounds at the latest.
    A row stops once all its bins are full: later rounds only have larger values.
    """
    rows = len(first) - 1
    out = np.full((rows, bins), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    row = rows_of(first)
    for i in range(2 * bins):
        if not len(values):
            break
        hashed = mix(values + np.uint64((int(GOLD) * (i + 1)) % 2**64))
        value = (np.uint64(i) << np.uint64(40)) | (hashed & np.uint64((1 << 40) - 1))
        place = ((hashed >> np.uint64(40)) % np.uint64(bins)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, row * bins + place, value)
        open_ = (out.max(axis=1) == np.iinfo(np.uint64).max)[row]
        if not open_.all():
            values, row = values[open_], row[open_]
    return out


def bands(sketch: np.ndarray, n_bands: int, width: int) -> np.ndarray:
    """One 64-bit key per row and band."""
    parts = sketch.reshape(len(sketch), n_bands, width)
    key = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64) * GOLD, parts.shape[:2])
    for i in range(width):
        key = mix(key ^ parts[:, :, i]) + GOLD
    return key


def sketch_table(docs: DataFrame, size: int, n_bands: int, width: int) -> DataFrame:
    """Per row of (row, doc_id, text): row, doc_id, n_shingles, node (hash of the set; null if empty), bands."""

    def run(part: pa.RecordBatch):
        values, first = shingles(part.column("text"), size)
        count = np.diff(first)
        keys = bands(sketches(values, first, n_bands * width), n_bands, width)
        keys = keys[count > 0].reshape(-1).view(np.int64)
        yield batch(
            row=part.column("row"), doc_id=part.column("doc_id"), n_shingles=count.astype(np.int64),
            node=pa.array(set_hash(values, first).view(np.int64), mask=count == 0),
            bands=list_array(keys, np.concatenate(([0], np.cumsum((count > 0) * n_bands)))),
        )

    return map_batches(docs, run, "row long, doc_id long, n_shingles long, node long, bands array<long>")


def sets_of(texts: DataFrame, size: int) -> DataFrame:
    """(node, items): the whole set of each (node, text), as sorted 64-bit hashes."""

    def run(part: pa.RecordBatch):
        values, first = shingles(part.column("text"), size)
        yield batch(node=part.column("node"), items=pa.array([values[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary()))

    return map_batches(texts, run, "node long, items binary")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets have 100 x intersection >= percent x union."""

    def run(batches: Iterator[pa.RecordBatch]):
        for part in batches:
            held = {}
            good = np.zeros(part.num_rows, bool)
            left, right = part.column("a_items"), part.column("b_items")
            for i, (a, b) in enumerate(zip(part.column("a").to_numpy(), part.column("b").to_numpy(), strict=True)):
                if a not in held:
                    held = {a: np.frombuffer(left[i].as_buffer(), np.uint64)}
                x, y = held[a], np.frombuffer(right[i].as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(good)) for c in ("a", "b")], ["a", "b"])

    a = sets.select(F.col("node").alias("a"), F.col("items").alias("a_items"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("b_items"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "a_items", "b_items").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that is reachable, by alternating large and small stars.

    Each step hangs neighbours on the smallest one they know; it ends when the edges no longer change. All state stays in
    tables; every step is written to the shared folder.
    """

    def both_ways(e: DataFrame) -> DataFrame:
        return e.union(e.select("b", "a"))

    def star(e: DataFrame, large: bool) -> DataFrame:
        sides = both_ways(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        hung = sides.join(lowest, "a")
        if large:
            hung = hung.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            hung = hung.select(F.col("b").alias("a"), F.col("low").alias("b")).union(lowest.select("a", F.col("low").alias("b")))
        return hung.where("a <> b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = keep(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = state(edges)
    while before[0]:
        edges = keep(star(star(edges, True), False), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label")).groupBy("node").agg(F.min("label").alias("label"))


def common_items(x: np.ndarray, first_x: np.ndarray, y: np.ndarray, first_y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each set of one block with each of another, as one product of 0/1 matrices."""
    both = np.intersect1d(x, y)
    sides = []
    for items, first in ((x, first_x), (y, first_y)):
        matrix = np.zeros((len(first) - 1, len(both)), np.float32)
        if len(both):
            at = np.minimum(np.searchsorted(both, items), len(both) - 1)
            hit = both[at] == items
            matrix[rows_of(first)[hit], at[hit]] = 1
        sides.append(matrix)
    return np.rint(sides[0] @ sides[1].T).astype(np.int64)


def block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the sets of two blocks of different labels; one is enough for a set and a label."""

    def block(held: pa.ListScalar):
        rows = held.values
        raw, borders = bytes_of(rows.field("items"))
        return rows.field("node").to_numpy(), rows.field("label").to_numpy(), raw.view(np.uint64), borders // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for left, right in zip(part.column("some"), part.column("all"), strict=True):
                node, label, x, first_x = block(left)
                other, other_label, y, first_y = block(right)
                both = common_items(x, first_x, y, first_y)
                union = np.diff(first_x)[:, None] + np.diff(first_y) - both
                good = (100 * both >= percent * union) & (label[:, None] != other_label)
                i, k = np.nonzero(good)
                _, once = np.unique(np.stack((i, other_label[k])), axis=1, return_index=True)
                yield batch(a=np.minimum(node[i], other[k])[once], b=np.maximum(node[i], other[k])[once])

    return blocks.mapInArrow(run, "a long, b long")


def near_links(marked: DataFrame, texts: DataFrame, size: int, percent: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, label) of the nodes that are linked with others.

    ``marked`` is the sketch table, ``texts`` has (row, text). Nodes are sets, so copies are one node. A bucket is
    open while its nodes have different labels. In each round every open bucket compares one of its nodes, chosen by hash,
    with those of other labels; what is linked gets one label, so after the rounds nearly all of a large group has one.

    The rest meets in blocks. A node's hub is the largest label it shares an open bucket with. The nodes outside their
    hub's label are compared with all nodes of that hub, block by block: a task holds two blocks of bounded size and counts
    all their intersections at once, so no pair becomes a row. Nodes of different hubs in one bucket are compared pair by
    pair. So no pair that shares a bucket is left out, however large its group.
    """
    per_band = marked.where("node IS NOT NULL").select("node", F.explode("bands").alias("bucket"))
    shared = per_band.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket")
    members = keep(per_band.join(shared, "bucket").distinct(), "members")
    nodes = members.select("node").distinct()
    chosen = marked.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row"))
    sets = keep(sets_of(texts.join(chosen, "row").select("node", "text"), size), "sets")
    labels = links = tested = None

    def labelled() -> DataFrame:
        now = members if labels is None else members.join(labels, "node", "left")
        return now.withColumn("label", F.col("node") if labels is None else F.coalesce("label", "node"))

    def pairs_of(apart: DataFrame) -> DataFrame:
        found = apart.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
        return keep(found if tested is None else found.join(tested, ["a", "b"], "left_anti"), "pairs")

    mixed = (F.min("label").alias("low"), F.max("label").alias("high"))
    for turn in range(rounds):
        now = labelled()
        pick = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "label")).alias("c")
        centres = now.groupBy("bucket").agg(pick, *mixed).where("low < high").select("bucket", F.col("c.node").alias("centre"), F.col("c.label").alias("of"))
        pairs = pairs_of(now.join(centres, "bucket").where("label <> of"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = keep(linked(pairs, sets, percent), "links")
        links = found if links is None else links.unionByName(found)
        labels = keep(components(links), "labels")

    sizes = labels.groupBy("label").agg((F.count("*") + 1).alias("size"))
    now = labelled().join(sizes, "label", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    hubs = now.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("c"), *mixed).where("low < high").select("bucket", F.col("c").alias("of"))
    left = keep(now.join(hubs, "bucket").drop("size"), "left")
    if left.isEmpty():
        return labels
    own = keep(left.groupBy("node").agg(F.first("label").alias("label"), F.max("of")["label"].alias("hub")), "hubs")
    outside = F.col("label") != F.col("hub")
    pool = own.join(own.where(outside).select("hub").distinct(), "hub").join(sets, "node")
    weight = F.octet_length("items") / 8 + NODE_WEIGHT
    parts = pool.groupBy("hub").agg(*(F.ceil(F.sum(w) / BLOCK_ITEMS).alias(n) for n, w in (("all_parts", weight), ("some_parts", F.when(outside, weight)))))
    held = F.collect_list(F.struct("node", "label", "items"))
    pool = keep(pool.join(parts, "hub"), "pool")
    place = F.xxhash64("node")
    every = pool.groupBy("hub", F.pmod(place, F.col("all_parts"))).agg(held.alias("all")).select("hub", "all")
    some = pool.where(outside).groupBy("hub", F.pmod(place, F.col("some_parts"))).agg(held.alias("some")).select("hub", "some")
    found = block_links(some.join(every, "hub").select("some", "all"), percent)
    odd = left.join(own.select("node", "hub"), "node")
    apart = odd.where(F.col("hub") != F.col("of.label")).select("bucket", F.col("node").alias("centre"), F.col("label").alias("centre_label"), F.col("hub").alias("centre_hub"))
    pairs = pairs_of(odd.join(apart, "bucket").where("hub <> centre_hub AND label <> centre_label"))
    found = keep(found.unionByName(linked(pairs, sets, percent)), "links")
    return labels if found.isEmpty() else keep(components(links.unionByName(found)), "labels")


def classify(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80,
    n_bands: int = BANDS, width: int = BINS_PER_BAND,
) -> tuple[DataFrame, DataFrame]:
    """The numbered documents (row, doc), and per row: row, doc_id, n_shingles, component_id, first.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set are its distinct shingles of ``size`` words
    (with fewer words the whole sequence; none without words or text). Documents with 100 x intersection >= percent x
    union are linked; the candidates share a band of the sketches and are confirmed on their whole sets.
    ``component_id`` is the smallest id that is reachable, ``first`` marks one row of each component.

    Equal sets are one node, known by a 64-bit hash of the set (n distinct sets collide with probability n^2 / 2^65), so
    copies are neither paired nor compared. Null ids are linked as others; a component with no other id has the null id,
    and a component's first row has its smallest id (a repeated id: the first of its rows). Null or empty texts are
    linked with nothing. An empty table gives no rows. No bucket or group is capped; each join has one row per bucket
    or node on one side, so that a hot one can be split.
    """
    numbered = keep(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    texts = numbered.select("row", F.col("doc")[id_column].cast("long").alias("doc_id"), F.coalesce(F.col("doc")[text], F.lit("")).alias("text"))
    marked = keep(sketch_table(texts, size, n_bands, width), "sketches")
    labels = near_links(marked, texts.select("row", "text"), size, percent)
    classes = marked.join(labels, "node", "left")
    group = F.when(F.col("node").isNull(), F.struct(F.lit(1).alias("own"), F.col("row").alias("key"))).otherwise(
        F.struct(F.lit(0).alias("own"), F.coalesce("label", "node").alias("key"))
    )
    classes = keep(classes.select("row", "doc_id", "n_shingles", group.alias("group")), "classes")
    heads = classes.groupBy("group").agg(
        F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("head")
    )
    heads = keep(heads, "heads")
    found = classes.join(heads, "group").select("row", "doc_id", "n_shingles", "component_id", (F.col("row") == F.col("head.row")).alias("first"))
    return numbered, found


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, first; see ``classify``."""
    return classify(docs, **options)[1].drop("row")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The documents, one of each component; see ``classify``."""
    numbered, found = classify(docs, **options)
    gone = keep(found.where(~F.col("first")).select("row"), "gone")
    return numbered.join(gone, "row", "left_anti").select("doc.*")
