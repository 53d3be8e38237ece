"""Near-duplicates, language scores, mixing and decontamination against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapelab.llm import decontam, kneser_ney, mixing, neardup
from tapelab.llm.common import slices, words

from .conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def tokens_of(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = tokens_of(text)
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j in range(i):
                b = sets[j]
                if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label, sets


def test_words_match_the_pattern():
    texts = ["", "A b\tC", "  x", "é\u00a0Ü ab\x0bcd", "tail ", "", "same", "SAME"]
    hashed, first = words(pa.array(texts))
    assert np.diff(first).tolist() == [len(tokens_of(t)) for t in texts]
    flat = [w for t in texts for w in tokens_of(t)]
    assert len(set(flat)) == len(set(hashed.tolist())) and hashed[first[6]] == hashed[first[7]]
    parts = list(slices([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])], most=4))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts and len(parts) > 3


def test_sketches_fill_every_bin_and_estimate():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    other = np.concatenate((base[:240], rng.integers(0, 2**63, 60).astype(np.uint64)))
    one = base[:1]
    values, first = np.concatenate((base, other, one)), np.array([0, 300, 600, 601])
    found = neardup.sketches(values, first, 200)
    assert (found != np.iinfo(np.uint64).max).all()
    assert abs((found[0] == found[1]).mean() - 240 / 360) < 0.12


def test_near_duplicates_are_the_components(spark):
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(12):
        base = [random.choice(vocabulary) for _ in range(random.choice((6, 40, 90)))]
        for _ in range(random.choice((1, 3, 12))):
            copy = list(base)
            for _ in range(random.randint(0, len(copy) // 8)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["One", "one", "", None, texts[0].upper()]
    want, sets = components(texts, 2, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, size=2).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].first for i in range(len(texts))] == [i == w for i, w in enumerate(want)]


def test_bounded_pairs_lose_no_link(spark):
    """A large group whose members differ about as much as the limit: the last pass decides most of them."""
    random.seed(9)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(90):
        copy = list(base)
        for at in random.sample(range(60), random.randint(1, 6)):
            copy[at] = random.choice((f"x{i}-{at}", f"y{at}"))
        texts.append(" ".join(copy))
    want, _ = components(texts, 2, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, size=2).collect()}
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) > 3


def test_near_duplicates_of_dirty_rows(dirty, nothing):
    found = neardup.near_duplicates(dirty)
    assert found.count() == len(rows()) and found.where("component_id = 0").count() == 3
    kept = neardup.deduplicated(dirty)
    assert kept.columns == dirty.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[20] == ids[21] == 0 and ids[26] == 1 and ids[22] == ids[23] == ids[24] == 1 and ids[None] == 1
    assert neardup.near_duplicates(nothing).count() == neardup.deduplicated(nothing).count() == 0


def test_kneser_ney_equals_brute_force(spark):
    texts = [r[1] for r in rows() if r[1] is None or len(r[1]) < 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    learned = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 7 != 2]
    model = kneser_ney.train(docs.where(docs.doc_id.isin(learned)))
    tok = [[*tokens_of(t), "</s>"] for t in texts]
    uni, bi = Counter(), Counter()
    for i in learned:
        uni.update(tok[i])
        bi.update(zip(["<s>", *tok[i]], tok[i], strict=False))
    n, v = sum(uni.values()), len(uni)
    cont, ctx, kinds = Counter(w for _, w in bi), Counter(), defaultdict(Counter)
    for (a, _), c in bi.items():
        ctx[a] += c
        kinds[a][min(c, 3)] += 1
    d, e = ([0, *kneser_ney.discounts([sum(c == i for c in of.values()) for i in (1, 2, 3, 4)])] for of in (bi, cont))
    everything = sum(cont.values())
    spare = sum(e[min(c, 3)] for c in cont.values()) / everything

    def p(a, w):
        low = max(cont[w] - e[min(cont[w], 3)], 0) / everything + spare / (v + 1)
        if not ctx[a]:
            return low
        return max(bi[a, w] - d[min(bi[a, w], 3)], 0) / ctx[a] + sum(d[k] * x for k, x in kinds[a].items()) / ctx[a] * low

    assert (model["tokens"], model["vocabulary"]) == (n, v)
    assert math.isclose(sum(p("alpha0", w) for w in [*uni, "unseen"]), 1, rel_tol=1e-9)
    for r in kneser_ney.score(docs, model).collect():
        w = tok[r.doc_id]
        assert (r.n_tokens, r.n_known) == (len(w), sum(uni[x] > 0 for x in w))
        assert math.isclose(r.base_score, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w], w, strict=False)), rel_tol=1e-9)


def test_kneser_ney_of_dirty_rows(dirty, nothing):
    model = kneser_ney.train(dirty)
    found = kneser_ney.score(dirty, model).collect()
    assert len(found) == len(rows()) and all(math.isfinite(r.score) for r in found)
    empty = kneser_ney.train(nothing)
    assert empty["tokens"] == 0 and all(r.score == r.base_score == 0 for r in kneser_ney.score(dirty, empty).collect())
    with pytest.raises(ValueError, match="mounted"):
        kneser_ney.train(dirty, "s3://bucket/folder")


def test_mix_levels_and_draws(spark):
    sizes = {"a": 5, "b": 400, "c": 300, None: 90}
    docs = [(i * 4 + k, "w " * (1 + i % 7), s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_sources(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(df.repartition(2)).collect()), key=str)
    total = sum(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
    assert math.isclose(sum(x[0].target for x in by.values()), total)
    for s, x in by.items():
        assert x[0].source_size == sum(r.size for r in x) and x[0].target <= 3 * x[0].source_size
        assert abs(sum(r.taken for r in x) - x[0].target) <= 7
    assert by["a"][0].target == 3 * by["a"][0].source_size
    assert math.isclose(by["b"][0].target / 2, by["c"][0].target / 3) and math.isclose(by[None][0].target, by["b"][0].target / 2)


def test_mix_of_dirty_rows(dirty, nothing):
    assert mixing.mix_sources(dirty).count() == len(rows())
    kept = mixing.mixed_documents(dirty)
    assert kept.columns == [*dirty.columns, "mix_taken"] and kept.where("mix_taken <= 0").count() == 0
    assert mixing.mix_sources(nothing).count() == mixing.mixed_documents(nothing).count() == 0
    again = mixing.mixed_documents(dirty.withColumn("Mix_Taken", F.lit("old")).withColumn("taken", F.lit(-1)))
    assert again.columns == [*dirty.columns, "taken", "mix_taken"]
    assert sorted(map(str, again.drop("taken").collect())) == sorted(map(str, kept.collect()))


def edit_distance(p, t):
    """Least distance of the pattern to any part of the text."""
    column, best = list(range(len(p) + 1)), len(p)
    for c in t:
        new = [0]
        for i, x in enumerate(p, 1):
            new.append(min(column[i - 1] + (x != c), column[i] + 1, new[i - 1] + 1))
        column = new
        best = min(best, column[-1])
    return best


def test_matches_equal_brute_force(spark):
    random.seed(2)
    letters = "abcdefgh  "
    items = ["".join(random.choice(letters) for _ in range(random.choice((5, 40, 90)))) for _ in range(12)] + ["", "...", None]
    texts = []
    for i in range(60):
        text = "".join(random.choice(letters) for _ in range(150))
        item = list(items[i % 12])
        for _ in range(i // 12):
            at = random.randrange(len(item))
            item[at : at + 1] = random.choice((["z"], [], [item[at], "q"]))
        texts.append(text[:70] + " " + "".join(item).upper() + " " + text[70:])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.matches(docs, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            p = decontam.normal(item or "")
            if p and len(p) < decontam.CHARS_PER_EDIT:
                if f" {p} " in f" {decontam.normal(t)} ":
                    want[i, j] = 0
            elif p and (d := edit_distance(p, decontam.normal(t))) <= len(p) // decontam.CHARS_PER_EDIT:
                want[i, j] = d
    assert {k: r.edits for k, r in got.items()} == want and len(want) > 30
    for (i, j), r in got.items():
        p, found = decontam.normal(items[j]), decontam.normal(texts[i][r.start_char : r.end_char])
        # an occurrence that begins or ends between two words is shown from word to word
        assert r.edits <= edit_distance(p, found) <= r.edits + 2 and abs(len(found) - len(p)) <= r.edits + 2


def test_short_items_count_as_whole_words(spark):
    texts = ["I know the party", "no", "Oh NO!", "noon, no noon", "n o", "piano", "a no-go area"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, "no"), (2, "The Party!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, texts[r.doc_id][r.start_char : r.end_char]) for r in decontam.matches(docs, bench).collect()}
    assert got == {(1, 1, "no"), (2, 1, "NO"), (3, 1, "no"), (6, 1, "no"), (0, 2, "the party")}
    assert sorted(r.doc_id for r in decontam.clean_documents(docs, bench).collect()) == [4, 5]


def test_blocks_and_dirty_rows(spark, dirty, nothing, monkeypatch):
    bench = spark.createDataFrame([(1, rows()[3][1]), (None, rows()[5][1]), (2, None)], "item_id long, text string")
    whole = sorted(map(str, decontam.matches(dirty, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 100)
    assert sorted(map(str, decontam.matches(dirty, bench).collect())) == whole and len(whole) == 4
    kept = decontam.clean_documents(dirty, bench)
    assert kept.columns == dirty.columns and kept.count() == len(rows()) - 4
    assert decontam.matches(nothing, bench).count() == 0 and decontam.matches(dirty, bench.limit(0)).count() == 0
