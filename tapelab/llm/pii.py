"""Personal data and the terms that disclose it, by information-theoretic sanitisation."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelab.llm.common import batch, keep, map_batches, slices, text_of

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity, in at most so many characters, that are its context.
WINDOW_WORDS, WINDOW_CHARS = 8, 200
#: A term must share this many different contexts with an entity before it is judged.
SUPPORT = 3
#: A term discloses an entity if it gives at least this part of the entity's information.
DISCLOSURE = 0.75
#: Slots of the filter that tells the counting pass which terms are candidates: 4 Mi bits, whatever the corpus.
SLOTS = 1 << 22
#: Distinct terms that a task counts before it hands its sums on.
FLUSH = 200_000
#: Risky terms that are sent to the workers as a table, at most.
RISKY_MOST = 100_000

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"\w+")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches without overlap, found from each @: a long run without one costs nothing."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            floor = domain.end()
            yield start, floor
        at = text.find("@", max(floor, at + 1))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of each kind in the order of KINDS, then by start; in code points, ends exclusive."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    if _DIGITS.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def entity_of(kind: str, found: str) -> int:
    """The entity behind a span: the address in lower case, or the digits alone."""
    return hashed(kind + ":" + (found.lower() if kind == "email" else "".join(c for c in found if c.isdigit() or c == ".")))


def class_of(term: str) -> str:
    return "#number" if any(c.isdecimal() for c in term) else "#word"


def terms_of(text: str) -> set[str]:
    """The terms of a text: its words, each in lower case."""
    return {w.lower() for w in set(_WORD.findall(text))}


def whole(text: str, start: int, end: int) -> bool:
    """Whether no word character touches the span from outside."""
    inside = lambda i: text[i].isalnum() or text[i] == "_"
    return not (start and inside(start - 1)) and not (end < len(text) and inside(end))


def context(text: str, span: Span, taken: list[Span]) -> list[tuple[str, int, int]]:
    """Terms around a span, outside all spans, in order: whole words, as ``terms_of`` counts them; one that the window cuts is none."""
    _, a, b = span
    out = []
    for lo, hi, last in ((max(0, a - WINDOW_CHARS), a, True), (b, min(len(text), b + WINDOW_CHARS), False)):
        found = [m for m in _WORD.finditer(text, lo, hi) if whole(text, *m.span())]
        found = found[-WINDOW_WORDS:] if last else found[:WINDOW_WORDS]
        out += [(m[0].lower(), m.start(), m.end()) for m in found if not any(x < m.end() and m.start() < y for _, x, y in taken)]
    return out


def contexts(text: str, spans: list[Span]) -> Iterator[tuple[int, list[tuple[str, int, int]]]]:
    """The entity behind each span, and its context terms."""
    by_start = sorted(spans, key=lambda s: s[1])
    longest = max((b - a for _, a, b in spans), default=0)
    starts = [s[1] for s in by_start]
    for span in by_start:
        # only spans this close can touch the window
        first = bisect.bisect_left(starts, span[1] - WINDOW_CHARS - longest)
        close = by_start[first : bisect.bisect_right(starts, span[2] + WINDOW_CHARS)]
        yield entity_of(span[0], text[span[1] : span[2]]), context(text, span, close)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


NEAR = "array<struct<entity: bigint, context: bigint, term: string, start: bigint, end: bigint>>"
FOUND = f"row long, doc_id long, same long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, near {NEAR}"


def scan(rows: DataFrame) -> DataFrame:
    """Per row of (row, doc_id, text): a hash of its text, its base spans, and each entity's context terms."""
    near_type = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, shas, bases, nears = [], [], [], []
        for text in part.column("text").to_pylist():
            spans = base_spans(text)
            base, near = joined(spans), []
            for entity, terms in contexts(text, spans):
                where = hashed(" ".join(t for t, _, _ in terms))
                near += [{"entity": entity, "context": where, "term": t, "start": a, "end": b} for t, a, b in terms]
                near += [{"entity": entity, "context": where, "term": c, "start": -1, "end": -1} for c in {"", *(class_of(t) for t, _, _ in terms)}]
            counts.append(Counter(k for k, _, _ in spans))
            shas.append(hashlib.sha256(base.encode()).hexdigest())
            bases.append(base)
            nears.append(near)
        yield batch(
            row=part.column("row"), doc_id=part.column("doc_id"), same=part.column("same"),
            **{f"n_{k}": pa.array([c[k] for c in counts], pa.int64()) for k in KINDS},
            base_sha256=pa.array(shas, pa.string()), base=pa.array(bases, pa.string()), near=pa.array(nears, near_type),
        )

    return map_batches(rows.withColumn("same", F.xxhash64("text")), run, FOUND)


def document_counts(rows: DataFrame, candidates: DataFrame, copies: DataFrame) -> DataFrame:
    """(term, df): in how many different texts each candidate term occurs, over the whole texts of all documents.

    ``copies`` (same, copies) has the hashes of texts that occur more than once; each such row counts as one part in so many.
    The workers get a bit per slot of a fixed number of slots and sum what falls into a set one; the join with the
    candidates then removes the rest.
    """
    slots = candidates.select((F.crc32(F.col("term")) % SLOTS).cast("int").alias("slot")).distinct().toArrow().column(0).to_numpy()
    bits = np.zeros(SLOTS, bool)
    bits[slots] = True
    packed = np.packbits(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(packed).astype(bool)
        seen: defaultdict[int, Counter[str]] = defaultdict(Counter)

        def flush() -> pa.RecordBatch:
            held = [(t, c, n) for c, found in seen.items() for t, n in found.items() if wanted[zlib.crc32(t.encode()) % SLOTS]]
            seen.clear()
            return batch(term=pa.array([t for t, _, _ in held], pa.string()), copies=pa.array([c for _, c, _ in held], pa.int64()), n=pa.array([n for _, _, n in held], pa.int64()))

        for part in slices(batches):
            for text, c in zip(part.column("text").to_pylist(), part.column("copies").to_pylist(), strict=True):
                terms = terms_of(text)
                seen[c].update(terms)
                seen[c].update({class_of(t) for t in terms})
            if sum(map(len, seen.values())) >= FLUSH:
                yield flush()
        if seen:
            yield flush()

    shared = rows.select("text", F.xxhash64("text").alias("same")).join(copies, "same", "left").select("text", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    # sums of the rows with equal copies are whole multiples of them
    counted = shared.mapInArrow(run, "term string, copies long, n long").groupBy("term", "copies").agg(F.sum("n").alias("n"))
    counted = counted.groupBy("term").agg(F.sum(F.expr("n div copies")).alias("df"))
    return counted.join(candidates.select("term").distinct(), "term", "left_semi")


def disclosure(joint: Column, of_entity: Column, of_term: Column, n: Column) -> Column:
    """PMI of term and entity over the entity's information: 1 if the term occurs with the entity alone, 0 if they are independent."""
    information = F.log2(n / of_entity)
    return F.when(information > 0, F.log2(joint * n / (of_entity * of_term)) / information).otherwise(0.0)


def risky_terms(near: DataFrame, rows: DataFrame, texts: DataFrame, support: int = SUPPORT, threshold: float = DISCLOSURE) -> DataFrame:
    """(entity, term, label): terms that disclose an entity, and what stands for them.

    All probabilities are parts of the different texts (``texts`` has each with its number of copies), so copies of a document
    count once in each of them. Only the support counts different contexts, so a passage that many texts share supports
    nothing by itself. The label is the term's class if that discloses less than the threshold, else empty (removed).
    """
    terms = near.where("term <> ''")
    supported = terms.select("entity", "term", "context").distinct().groupBy("entity", "term").agg(F.count("*").alias("support"))
    supported = keep(supported.where(F.col("support") >= support).select("entity", "term"), "supported")
    if supported.isEmpty():
        return supported.select("entity", "term", F.lit("").alias("label"))
    joint = terms.join(supported, ["entity", "term"], "left_semi").select("entity", "term", "same").distinct().groupBy("entity", "term").agg(F.count("*").alias("joint"))
    held = near.where("term = ''").select("entity", "same").distinct().groupBy("entity").agg(F.count("*").alias("of_entity"))
    pairs = keep(joint.join(held, "entity"), "pairs")
    copies = keep(texts.where("copies > 1"), "copies")
    judged = pairs.join(document_counts(rows, pairs, copies), "term").select(
        "entity", "term", disclosure(F.col("joint"), F.col("of_entity"), F.col("df"), F.lit(float(texts.count()))).alias("given")
    )
    judged = keep(judged, "judged")
    above = judged.where((F.col("given") >= threshold) & ~F.col("term").startswith("#"))
    kind = F.when(F.col("term").rlike(r"\p{Nd}"), "#number").otherwise("#word")
    classes = judged.where(F.col("term").startswith("#")).select("entity", F.col("term").alias("kind"), F.col("given").alias("class_given"))
    general = F.when(F.coalesce("class_given", F.lit(0.0)) < threshold, F.concat(F.lit("["), F.upper(F.substring("kind", 2, 9)), F.lit("]"))).otherwise("")
    return above.withColumn("kind", kind).join(classes, ["entity", "kind"], "left").select("entity", "term", general.alias("label"))


def find_spans(rows: DataFrame, **options) -> DataFrame:
    """Per row of (row, doc_id, text): the base counts and digest, ``base``, and ``terms`` (array of start, end, label).

    Base spans: email, ip, card, phone, leftmost without overlap per kind; matches that fail their check are dropped. Terms
    are the words near an entity that disclose it. Null texts count as empty and have none; repeated rows each get theirs;
    an empty table gives no rows. A frequent entity, term or pair is summed in parts before the shuffle.
    """
    return with_terms(*disclosed(rows, **options))


def with_terms(found: DataFrame, near: DataFrame, risky: DataFrame) -> DataFrame:
    """The scanned rows with the places of the risky terms in them."""
    flagged = near.where("start >= 0").join(risky, ["entity", "term"]).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end", "label"))).alias("terms"))
    return found.drop("near", "same").join(flagged, "row", "left")


def scanned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned rows and their context terms."""
    found = keep(scan(rows), "found")
    return found, found.select("row", "same", F.explode("near").alias("x")).select("row", "same", "x.*")


def disclosed(rows: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scanned rows, their context terms, and the risky terms."""
    found, near = scanned(rows)
    texts = keep(found.groupBy("same").agg(F.count("*").alias("copies")), "texts")
    return found, near, risky_terms(near, rows, texts, **options)


def all_spans() -> Column:
    """Base spans, then terms, as kind:start:end, comma-joined."""
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"]))
    return F.array_join(F.array_compact(F.concat(F.array(F.nullif(F.col("base"), F.lit(""))), F.coalesce(F.array_distinct(terms), F.array()))), ",")


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with spans (start, end, mark) replaced; spans that overlap are replaced as one, by the mark of the first.

    Of equal spans the empty mark wins: a term that is removed for one entity goes, whatever stands for it for another.
    """
    out, at = [], 0
    for a, b, mark in sorted(spans, key=lambda s: (s[0], -s[1], s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def clean(text: str, labels: dict[tuple[int, str], str]) -> str:
    """The text with its personal data, and the risky terms near it, replaced."""
    spans = base_spans(text)
    if not spans:
        return text
    marks = [(a, b, f"[{k.upper()}]") for k, a, b in spans]
    if labels:
        marks += [(a, b, labels[e, t]) for e, terms in contexts(text, spans) for t, a, b in terms if (e, t) in labels]
    return replaced(text, marks)


def sanitised(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: str = "n_chars", **options) -> DataFrame:
    """The documents with personal data and disclosing terms replaced in their texts; all other columns stay.

    ``length`` is set to the new number of code points where the table has that column and the text changed. Null texts stay
    null. Up to ``RISKY_MOST`` risky terms go to the workers, which replace them in one pass; more are joined with the texts, to the
    same result (``replaced`` settles both).
    """
    row = F.monotonically_increasing_id().alias("row")
    rows = docs.select(row, F.col(id_column).cast("long").alias("doc_id"), text_of(text).alias("text"))
    risky = keep(disclosed(rows, **options)[2], "risky")
    if risky.limit(RISKY_MOST + 1).count() > RISKY_MOST:
        return sanitised_by_join(docs, id_column, text, length, risky)
    labels = {(r.entity, r.term): r.label for r in risky.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            old = part.column(text).to_pylist()
            new = [t if t is None else clean(t, labels) for t in old]
            columns = {c: part.column(c) for c in part.schema.names}
            columns[text] = pa.array(new, part.schema.field(text).type)
            if length in columns:
                sizes = [n if a == b else len(b) for n, a, b in zip(columns[length].to_pylist(), old, new, strict=True)]
                columns[length] = pa.array(sizes, part.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)


def sanitised_by_join(docs: DataFrame, id_column: str, text: str, length: str, risky: DataFrame) -> DataFrame:
    """``sanitised`` for any number of risky terms: numbered rows meet the spans found in them."""
    numbered = keep(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    doc = F.col("doc")
    rows = numbered.select("row", doc[id_column].cast("long").alias("doc_id"), F.coalesce(doc[text], F.lit("")).alias("text"))
    spans = with_terms(*scanned(rows), risky).where("base <> ''").select("row", "base", "terms")

    def run(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        new = []
        for old, base, terms in zip(*(part.column(c).to_pylist() for c in ("text", "base", "terms")), strict=True):
            marks = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (s.split(":") for s in base.split(","))]
            new.append(replaced(old, [*marks, *((t["start"], t["end"], t["label"]) for t in terms or ())]))
        yield batch(row=part.column("row"), new_text=pa.array(new, pa.string()))

    changed = keep(map_batches(rows.join(spans, "row").select("row", "text", "base", "terms"), run, "row long, new_text string"), "changed")
    other = doc.withField(text, F.col("new_text"))
    if length in docs.columns:
        other = other.withField(length, F.length("new_text").cast(docs.schema[length].dataType))
    return numbered.join(changed, "row", "left").select(F.when(F.col("new_text").isNotNull(), other).otherwise(doc).alias("doc")).select("doc.*")
