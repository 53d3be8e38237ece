"""Language identification: nearest of several clustered TF-IDF centroids per language, with rejection by distance."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapelab.llm import common
from tapelab.llm.common import batch, bytes_of, fold_of, keep, list_array, rows_of, text_of

#: Hashed features; n-grams of 2 and 3 bytes of the lower-cased text, with all else than letters as one kind of gap.
FEATURES = 2048
#: Training texts per language that the centroids are clustered from, at most (counts cover all training texts).
SAMPLE = 1000
CENTROIDS, ITERATIONS = 4, 12
#: A text is rejected if it is further from its centroid than this part of the centroid's own texts.
TAIL = 0.005
UNKNOWN = "und"
#: Rows of a slice: a slice holds several matrices of rows x FEATURES doubles.
ROWS = 512

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of bounded bytes of text and of at most ROWS rows."""
    for part in common.slices(batches):
        for at in range(0, part.num_rows, ROWS):
            yield part.slice(at, ROWS)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield from fn(part)

    return df.mapInArrow(run, schema)


def counts(texts: pa.Array) -> np.ndarray:
    """Rows x features: how often each hashed n-gram occurs."""
    raw, borders = bytes_of(texts)
    n = len(borders) - 1
    code = _FOLD[raw]
    row = rows_of(borders)
    out = np.zeros(n * FEATURES)
    gram, same = code, np.ones(len(code), bool)
    for size in (2, 3):
        gram = gram[:-1] * np.uint32(257) + code[size - 1 :] if len(gram) > 1 else gram[:0]
        same = row[size - 1 :] == row[: len(row) - size + 1] if len(row) >= size else np.zeros(0, bool)
        blank = gram == (32 * 257 + 32 if size == 2 else (32 * 257 + 32) * 257 + 32)
        good = same & ~blank
        place = (gram[good] * np.uint32(2654435761)) >> np.uint32(32 - FEATURES.bit_length() + 1)
        out += np.bincount(row[: len(gram)][good] * FEATURES + place, minlength=n * FEATURES)
    return out.reshape(n, FEATURES)


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors, with 1 + log counts."""
    x = np.where(found > 0, 1 + np.log(np.maximum(found, 1)), 0) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts; each task hands on one row of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for part in slices(batches):
            total += (counts(part.column("text")) > 0).sum(0)
            n += part.num_rows
        yield batch(feature=np.arange(FEATURES + 1), n=np.append(total, n))

    summed = rows.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(FEATURES + 1, np.int64)
    for r in summed.collect():
        out[r["feature"]] = r["n"]
    return out[:-1], int(out[-1])


def clusters(x: np.ndarray, k: int, rounds: int = ITERATIONS) -> np.ndarray:
    """Spherical k-means from the first vector and those furthest from the ones before; empty clusters go."""
    centres = x[:1]
    for _ in range(min(k, len(x)) - 1):
        centres = np.vstack((centres, x[int(np.argmin((x @ centres.T).max(1)))]))
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = np.array([x[own == i].sum(0) for i in range(len(centres)) if (own == i).any()])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def drawn(rows: DataFrame, most: int) -> DataFrame:
    """(lang, order, text): for each language the ``most`` different texts with the smallest hashes, or all if it has fewer.

    Copies count once and only texts with an n-gram count. The hashes of all different texts are written once; about twice ``most`` of a
    language are ordered, and the last hash of each language is a row of a table that is joined back. Tasks drop the copies they see
    before the shuffle.
    """
    rows = rows.where((F.octet_length("text") > 1) & F.col("text").rlike(r"[A-Za-z]|[^\x00-\x7F]")).withColumn("order", F.xxhash64("text"))
    different = keep(rows.select("lang", "order").distinct(), "langid-texts")
    sizes = keep(different.groupBy("lang").agg(F.count("*").alias("n")), "langid-sizes")
    # hashes are spread evenly, so a part of their range holds a little more than twice as many as are wanted
    part = F.expr(f"least(cast(18446744073709551616 as decimal(20,0)), floor(cast(18446744073709551616 as decimal(20,0)) * {2 * most + 100} / n))")
    low = different.join(sizes, "lang").where(F.col("order") <= part - F.expr("cast(9223372036854775809 as decimal(20,0))"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    last = low.withColumn("place", place).where(F.col("place") <= most).groupBy("lang").agg(F.max("order").alias("last"))
    last = keep(last, "langid-last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for part in batches:
            fresh = []
            for key in zip(part.column("lang").to_pylist(), part.column("order").to_pylist(), strict=True):
                fresh.append(key not in seen)
                seen.add(key)
            yield part.filter(pa.array(fresh, pa.bool_()))

    few = rows.join(last, "lang").where(F.col("order") <= F.col("last")).select("lang", "order", "text").mapInArrow(run, "lang string, order long, text string")
    return few.groupBy("lang", "order").agg(F.first("text").alias("text"))


def train(rows: DataFrame, most: int = SAMPLE) -> dict:
    """The model of training rows (text, lang): languages, idf, centroids with their language and limit.

    Frequencies cover all training texts. The centroids come from at most ``most`` different texts a language; a bounded
    table of vectors and of hashes and one row per language are all that reaches the driver. A language has a centroid unless
    none of its texts has an n-gram (each is shorter than two bytes or has nothing but ASCII other than letters).
    """
    rows = rows.where("lang IS NOT NULL").select("lang", text_of().alias("text"))
    seen, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + seen)) + 1

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = vectors(counts(part.column("text")), idf).astype(np.float32)
        yield batch(lang=part.column("lang"), order=part.column("order"), x=list_array(x.reshape(-1), np.arange(len(x) + 1) * FEATURES))

    held = map_batches(drawn(rows, most), run, "lang string, order long, x array<float>").orderBy("lang", "order").toArrow()
    langs = np.array(held.column("lang").to_pylist(), object)
    x = held.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(langs), FEATURES) if len(langs) else np.zeros((0, FEATURES))
    centres, of, limits = [np.zeros((0, FEATURES))], [], []
    for lang in sorted(set(langs)):
        mine = x[langs == lang]
        found = clusters(mine, CENTROIDS)
        near = mine @ found.T
        own = near.argmax(1)
        centres.append(found)
        of += [lang] * len(found)
        limits += [float(np.quantile(near[own == i].max(1), TAIL)) if (own == i).any() else 1.0 for i in range(len(found))]
    return {"idf": idf, "centres": np.vstack(centres).astype(np.float32), "langs": of, "limits": np.array(limits)}


def predict(rows: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, rejected of (doc_id, text, letters)."""
    centres, langs, limits = model["centres"], np.array([*model["langs"], UNKNOWN], object), np.append(model["limits"], 0.0)

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = vectors(counts(part.column("text")), model["idf"])
        letters = part.column("letters").to_numpy(zero_copy_only=False)
        known = letters & (len(langs) > 1)
        near = x @ centres.T if len(langs) > 1 else np.zeros((len(x), 1))
        best, score = near.argmax(1), np.clip(near.max(1), 0, 1)
        best = np.where(known, best, len(langs) - 1)
        score = np.where(known, score, 0.0)
        yield batch(
            doc_id=part.column("doc_id"), lang_pred=pa.array(langs[best].tolist(), pa.string()), score=score, rejected=known & (score < limits[best]),
        )

    return map_batches(rows, run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document.

    The model is learned from rows with a language outside the held-out fold (crc32 of the id as text, modulo 5, is 0).
    ``lang_pred`` is the language of the nearest centroid, ``score`` the cosine to it, ``rejected`` whether the text is
    further from it than nearly all texts it was learned from. Null texts, texts without a letter and texts of
    a table without any language are ``und`` with score 0. Ties go to the first centroid; every row is judged by itself, so
    repeated rows agree; an empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), text_of(text).alias("text"), F.col(lang).alias("lang"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    model = train(rows.where(fold_of("doc_id", 5) != 0))
    return predict(rows.drop("lang"), model).select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
