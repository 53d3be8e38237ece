"""Packing, conversation tries and collocations against brute force; their filters against exact counts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapelab.llm import packing, phrases, quotient, trie
from tapelab.llm.common import table
from tapelab.llm.queries import OP13_SQL

SF = "/root/testdata/sf0.001"


def public_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return lambda t: [*made.encode(t or "", add_special_tokens=False).ids, 0]


def packed_rows(df, length=packing.LENGTH, key="doc_id"):
    rows = [r.asDict() for r in packing.pack(df, key, length=length).collect()]
    for r in rows:
        r["ids"] = np.frombuffer(r["ids"], "<u4").tolist()
    return rows


def check_packing(docs, rows, length, key="doc_id"):
    """Each document's pieces join to its ids; sequences are gapless and full but for the last."""
    want = Counter(tuple(x) for x in docs)
    at = defaultdict(dict)
    flow = []
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["length"] == len(r["ids"]) > 0 and r["offset"] + r["length"] <= length
        assert r["offset"] not in at[r["sequence_id"]]
        at[r["sequence_id"]][r["offset"]] = r["length"]
        flow += [(r[key], r["start"], r["doc_tokens"], i, x) for i, x in enumerate(r["ids"])]
    for s, held in at.items():
        total = sum(held.values())
        assert sorted(held) == np.cumsum([0, *(held[o] for o in sorted(held))]).tolist()[:-1]
        assert total == length or s == max(at)
    got, now = Counter(), None
    for k, start, n, i, x in flow:
        if start + i == 0:
            now = []
        now.append(x)
        assert len(now) == start + i + 1
        if len(now) == n:
            got[(k, *now)] += 1
    assert got == want


def test_packing_equals_brute_force(spark):
    ids = public_ids()
    docs = table(spark, SF, "documents")
    held = [(r.doc_id, *ids(r.text)) for r in docs.collect()]
    check_packing(held, packed_rows(docs), 1024)


def test_packing_of_dirty_rows(spark, dirty, nothing):
    ids = public_ids()
    more = dirty.unionByName(spark.createDataFrame([(90, "<|endoftext|> 's\u00a0\u4e2d\u6587 " + "a" * 50_000 + " " * 9_000, *[None] * 10)], dirty.schema))
    for length in (1, 7, 1024):
        held = [(r.doc_id, *ids(r.text)) for r in more.collect()]
        rows = packed_rows(more, length)
        check_packing(held, rows, length)
    assert packed_rows(nothing) == []
    whole = packing.sequences(packing.pack(more, length=7))
    flat = [i for r in whole.orderBy("sequence_id").collect() for i in np.frombuffer(r.ids, "<u4").tolist()]
    assert len(flat) == sum(len(h) - 1 for h in held)
    for r in whole.collect():
        assert sum(b.length for b in r.boundaries) == r.length and r.boundaries[0].offset == 0


def test_partition_totals_are_summed_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 3)
    n = [5, 0, 7, 1, 2, 9, 4, 4, 8, 3, 1]
    rows = spark.createDataFrame([(p, x) for p, x in enumerate(n)], "part long, n long")
    got = {r.part: r.base for r in packing.partition_starts(rows).collect()}
    assert got == {p: sum(n[:p]) for p in range(len(n))}


def trie_by_hand(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        first = c - int(np.fmod(c, 5))
        built[c] = own.get(first, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    children = Counter(n[:-1] for n in nodes if n)
    out = {}
    for n, members in nodes.items():
        below = [m for m in nodes if m[: len(n)] == n]
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(n))))
        out[(min(members), len(n))] = (
            min(nodes[n[:-1]]) if n else None, len(members), children[n], sum(not children[m] for m in below),
            sum((len(nodes[m]) - 1) * (len(m[-1][1].encode()) if m else 0) for m in below), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def got_nodes(df):
    rows = trie.nodes(df).collect()
    out = {(r.conv_id, r.depth): tuple(r[2:]) for r in rows}
    assert len(out) == len(rows)
    return out


TURNS = "conv_id long, turn long, role string, text string, place long, ha long, depth long, extra string"


def talk(seed, convs, deep=12):
    rng = random.Random(seed)
    out = []
    for c in convs:
        kind = rng.choice("abc")
        out += [(c, t, ("user", "assistant")[t % 2], f"{kind}\u00e9{t if t < 6 else rng.choice('xy')}") for t in range(rng.randrange(1, deep))]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", (3, 4096)[seed - 1])
    monkeypatch.setattr(trie, "CHUNK", 2)
    rows = talk(seed, [*range(-7, 40), 1000, 10**12])
    rows += [(50, None, None, None), (50, 0, "", ""), (51, None, "user", None), (53, 2, "user", "x"), (53, 2, "user", "x"), (None, 1, "user", "lost")]
    df = spark.createDataFrame([(*r, 1, 2, 3, "e") for r in rows], TURNS).repartition(5)
    assert got_nodes(df) == trie_by_hand(rows)


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 300) for t in range(3)] + [(900, t, "user", f"{t}") for t in range(400)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "e") for r in rows], TURNS).repartition(3)
    assert got_nodes(df) == trie_by_hand(rows)
    assert got_nodes(spark.createDataFrame([], TURNS)) == {}


words64 = st.integers(0, 2**64 - 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(words64, words64, st.integers(1, 2**40)), max_size=60), st.sampled_from([1, 2]), st.sampled_from([0, 1, 5, 12]))
def test_filters_are_lossless(items, width, bits):
    keys = tuple(np.array([i[j] for i in items], np.uint64) for j in range(width))
    back = quotient.restore(quotient.permute(keys))
    assert all((a == b).all() for a, b in zip(keys, back, strict=True))
    sums = Counter()
    for i in items:
        sums[i[:width]] += i[2]
    spread, counts = quotient.summed(quotient.permute(keys), np.array([i[2] for i in items], np.uint64))
    got = Counter()
    for _, a, b in quotient.runs(spread, bits):
        k, n = quotient.unpack(quotient.pack(tuple(x[a:b] for x in spread), counts[a:b], bits))
        assert all((x == y[a:b]).all() for x, y in zip(k, spread, strict=True))
        got.update(dict(zip(zip(*(x.tolist() for x in quotient.restore(k)), strict=True), n.tolist(), strict=True)))
    assert got == sums


@pytest.mark.parametrize("width", [1, 2])
def test_stored_filters_find_what_they_hold(tmp_path, width):
    rng = np.random.default_rng(5)
    keys = tuple(rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(width))
    spread, counts = quotient.summed(quotient.permute(keys), np.arange(1, 5001))
    for f, a, b in quotient.runs(spread, 2):
        quotient.store_filter(str(tmp_path), f, tuple(k[a:b] for k in spread), {"count": counts[a:b]}, 2)
    order = rng.permutation(5000)
    asked = tuple(np.concatenate((k[order], ~k[order[:50]])) for k in spread)
    (got,) = quotient.find(str(tmp_path), asked, ["count"], 2)
    assert (got[:5000] == counts[order]).all() and not got[5000:].any()


def dirty_phrases(spark):
    rows = [("Alpha beta gamma. alpha BETA\tgamma! delta" + "\r" + "alpha beta", "en")] * 40 + [("x,y z;  x y", None)] * 35 + [("x y", "und")] * 3
    rows += [(None, "en"), ("", None), (" \t .,;", "de"), ("un deux trois quatre cinq. " * 50, ""), ("\u00c9t\u00e9 \u00e9t\u00e9\u00a0X " * 3000, "fr"), ("solo " * 40, "es")]
    rows += [("one two three four five six " * 31 + "one two", "en"), ("a" * 100_000 + " b", "en")]
    return spark.createDataFrame([(*r, 1, 2, 3, "w") for r in rows], "text string, lang string, h long, f long, n long, word string").repartition(6)


def twin_of_phrases(rows):
    con = duckdb.connect()
    con.register("documents", pa.table({"text": pa.array([r.text for r in rows], pa.string()), "lang": pa.array([r.lang for r in rows], pa.string())}))
    return sorted(map(repr, con.sql(OP13_SQL).project("lang, rank, phrase, a, l, r, n, score").fetchall()))


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_brute_force(spark, monkeypatch, small):
    """With small bounds the words fill several files, counts several flushes, and filters are merged in three rounds."""
    if small:
        for name, value in {"SHARD": 40, "FILE": 3, "FLUSH": 50, "FLUSH_WORDS": 20, "FAN_BITS": 2}.items():
            monkeypatch.setattr(phrases, name, value)
    df = dirty_phrases(spark)
    got = [tuple(r) for r in phrases.collocations(df).collect()]
    assert sorted(map(repr, got)) == twin_of_phrases(df.collect()) and len(got) > 8


def test_collocations_of_nothing(spark, nothing):
    got = phrases.collocations(nothing)
    assert got.collect() == [] and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_scores_past_64_bits(spark):
    rows = spark.createDataFrame([(7_000_000_000_000, [9_000_000_000_000], [9_000_000_000_001])], "a long, left array<long>, right array<long>")
    cut = rows.select(F.expr(f"cast(cast(a as decimal(28,0)) * {phrases.SCALE} div (cast(left[0] as decimal(20,0)) + right[0]) as bigint)")).first()[0]
    assert cut == 2_000_000 * 7_000_000_000_000 // 18_000_000_000_001
