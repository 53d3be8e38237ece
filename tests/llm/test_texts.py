"""Personal data, fingerprints, classifiers, URL filters and chat formatting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tapelab.llm import chat, langid, merkle, pii, quality, urlfilter

from .conftest import rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    random.seed(5)
    for _ in range(4000):
        for letters, n in (("a1.@@-+ ()b2é\n", 40), ("12.5 -+0", 60)):
            text = "".join(random.choice(letters) for _ in range(random.randint(1, n)))
            assert pii.base_spans(text) == brute_spans(text), text
    assert pii.base_spans("a" * 300_000 + " " + "1" * 300_000) == []


def test_disclosing_terms_are_found_and_generalised(spark, monkeypatch):
    docs = [(i, f"call zorb{i % 4} {i} times at p{i % 4}@mail.example.com please number {i * 3}") for i in range(80)]
    docs += [(100 + i, f"call the times at please number {i} and so on") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in pii.find_spans(df.withColumn("row", F.monotonically_increasing_id())).select("doc_id", "base", "terms", pii.all_spans().alias("spans")).collect()}
    for i, text in docs[:80]:
        assert [text[t.start : t.end] for t in found[i].terms] == [f"zorb{i % 4}"]
        assert found[i].spans == f"{pii.joined(brute_spans(text))},term:5:10"
    assert all(found[i].spans == "" for i, _ in docs[80:])
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[4] == "call [NUMBER] 4 times at [EMAIL] please number 12" and clean[105] == docs[85][1]
    monkeypatch.setattr(pii, "RISKY_MOST", 1)
    assert {r.doc_id: r.text for r in pii.sanitised(df).collect()} == clean


def test_copies_of_a_document_disclose_nothing(spark):
    df = spark.createDataFrame([(i, "only here is q@mail.example.com kept") for i in range(50)] + [(99, "other text")], "doc_id long, text string")
    assert pii.find_spans(df.withColumn("row", F.monotonically_increasing_id())).where("terms IS NOT NULL").count() == 0


def test_copies_and_shared_passages_hide_no_disclosure(spark):
    common = [f"call or write the times at now please {i} and so on" for i in range(300)]
    copied = ["call the zorb at q@mail.example.com please"] * 200 + ["write zorb now at q@mail.example.com", "q@mail.example.com or zorb the times"]
    padding = " and so on" * 10
    shared = [f"{i}{padding} call the quib at r@mail.example.com please{padding}" for i in range(60)] + ["write quib now at r@mail.example.com", "r@mail.example.com or quib the times"]
    texts = dict(enumerate(common + copied + shared))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = pii.find_spans(df.withColumn("row", F.monotonically_increasing_id())).select("doc_id", "terms").collect()
    terms = {r.doc_id: [texts[r.doc_id][t.start : t.end] for t in r.terms or ()] for r in found}
    assert terms == {i: ["zorb"] if "zorb" in t else ["quib"] if "quib" in t else [] for i, t in texts.items()}
    # a term is counted once a different text, however many copies the texts have
    ids = df.groupBy(F.xxhash64("text").alias("same")).agg(F.count("*").alias("copies")).where("copies > 1")
    asked = spark.createDataFrame([("zorb",), ("quib",), ("call",)], "term string")
    assert {r.term: r.df for r in pii.document_counts(df, asked, ids).collect()} == {"zorb": 3, "quib": 62, "call": 300 + 1 + 60}


def risky_by_hand(texts):
    """(entity, term) -> label by the definition, from all different texts at once."""
    different = sorted(set(texts))
    support, joint, held = defaultdict(set), defaultdict(set), defaultdict(set)
    words = {t: {w.lower() for w in re.findall(r"\w+", t)} for t in different}
    df = Counter(w for t in different for w in words[t] | {pii.class_of(x) for x in words[t]})
    for t in different:
        for entity, terms in pii.contexts(t, pii.base_spans(t)):
            held[entity].add(t)
            names = [x for x, _, _ in terms]
            for x in {*names, *map(pii.class_of, names)}:
                support[entity, x].add(tuple(names))
                joint[entity, x].add(t)
    n, given = len(different), {}
    for (entity, x), found in support.items():
        if len(found) >= pii.SUPPORT:
            e = len(held[entity])
            given[entity, x] = math.log2(len(joint[entity, x]) * n / (e * df[x])) / math.log2(n / e) if n > e else 0.0
    return {
        (e, x): f"[{pii.class_of(x)[1:].upper()}]" if given.get((e, pii.class_of(x)), 0.0) < pii.DISCLOSURE else ""
        for (e, x), g in given.items() if g >= pii.DISCLOSURE and not x.startswith("#")
    }


def test_disclosure_equals_brute_force(spark, monkeypatch):
    """Both ways of replacing, on terms whose label differs by entity, and the measure itself by its definition."""
    rng = random.Random(9)
    common = "call write the times at please number now and so".split()
    texts = []
    for i in range(240):
        words = [rng.choice(common) for _ in range(rng.randrange(4, 14))]
        if i % 3 == 0:
            k = rng.randrange(5)
            words.insert(rng.randrange(len(words) + 1), f"p{k}@mail.example.com")
            words += [f"zorb{k}", ("quib", "x77")[k % 2]][: rng.randrange(3)]
            if i % 9 == 0:
                words.append(f"also p{rng.randrange(5)}@mail.example.com")
        texts.append(" ".join(words))
    texts += texts[:20] + ["\u0130zorb \u0130 at p1@mail.example.com"] * 4
    texts += [f"12 34 {i} p9@mail.example.com 55{i} 7 secret p8@mail.example.com tail" for i in range(4)] + [f"secret p8@mail.example.com number {w}" for w in "abcd"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = risky_by_hand(texts)
    rows_ = df.withColumn("row", F.monotonically_increasing_id())
    got = {(r.entity, r.term): r.label for r in pii.disclosed(rows_)[2].collect()}
    assert got == want and len(want) > 4
    clean = {i: pii.clean(t, want) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in pii.sanitised(df).collect()} == clean
    monkeypatch.setattr(pii, "RISKY_MOST", 0)
    assert {r.doc_id: r.text for r in pii.sanitised(df).collect()} == clean


def test_a_term_with_two_labels_is_removed(spark):
    text = "see a@mail.example.com word b@mail.example.com end"
    a, b = (pii.hashed(f"email:{x}@mail.example.com") for x in "ab")
    for labels in ({(a, "word"): "[WORD]", (b, "word"): ""}, {(a, "word"): "", (b, "word"): "[WORD]"}):
        assert pii.clean(text, labels) == "see [EMAIL]  [EMAIL] end"
        risky = spark.createDataFrame([(e, t, label) for (e, t), label in labels.items()], "entity long, term string, label string")
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert pii.sanitised_by_join(docs, "doc_id", "text", "n_chars", risky).first().text == "see [EMAIL]  [EMAIL] end"


def test_windows_cut_no_word():
    text = "confidential " + "x" * (pii.WINDOW_CHARS - 8) + " a.b@mail.example.com " + "y" * (pii.WINDOW_CHARS - 4) + " secret"
    ((_, terms),) = pii.contexts(text, pii.base_spans(text))
    assert [t for t, _, _ in terms] == ["x" * (pii.WINDOW_CHARS - 8), "y" * (pii.WINDOW_CHARS - 4)]
    ((_, terms),) = pii.contexts("\u00fca.b@mail.example.com z", pii.base_spans("\u00fca.b@mail.example.com z"))
    assert [t for t, _, _ in terms] == ["z"]


def test_personal_data_of_dirty_rows(dirty, nothing):
    clean = pii.sanitised(dirty)
    assert clean.columns == dirty.columns and clean.count() == len(rows())
    changed = [r for r in clean.collect() if r.doc_id == 26]
    assert [(r.text, r.n_chars) for r in changed] == [("Mail [EMAIL] now", 16)] * 2
    assert clean.where("text IS NULL").count() == 2 and pii.sanitised(nothing).count() == 0


def test_overlaps_are_replaced_once():
    text = "x +12 345 678 901 y"
    assert pii.replaced(text, [(3, 17, "[CARD]"), (2, 17, "[PHONE]")]) == "x [PHONE] y"
    assert pii.clean("x +12 345 678 901 y", {}) == "x [PHONE] y"


def test_fingerprints_locate_edits():
    text = "One line here.\nTwo lines, here.\n\nNext part.\nEnd of it.\n"
    edited = text.replace("Next", "Last")
    a, b = merkle.fingerprint(text), merkle.fingerprint(edited)
    assert "".join(merkle.pieces(text)) == text and merkle.fingerprint(str(text)) == a
    assert merkle.changed(a, b) == [(1, 0, 1, 0)] and 0.7 < merkle.likeness(a, b) < 1 and merkle.likeness(a, a) == 1
    assert merkle.fingerprint("")[:32] == merkle.fingerprint("")[:32] != merkle.fingerprint(" ")[:32]
    assert merkle.likeness(merkle.fingerprint(""), a) == 0 and merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1


def longest_common(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            best[i + 1][j + 1] = best[i][j] + 1 if a == b else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_branches_are_aligned(spark):
    random.seed(8)
    lines = [f"Line {i} says {random.random()}, and ends.\n" for i in range(9)]
    mark = merkle.fingerprint("".join(lines))
    new = "A line that is new.\n"
    assert merkle.changed(mark, merkle.fingerprint("".join([new, *lines]))) == [(None, None, 0, 0)]
    assert merkle.changed(merkle.fingerprint("".join([*lines[:4], new, *lines[4:]])), mark) == [(0, 4, None, None)]
    assert merkle.changed(mark, merkle.fingerprint("")) == [(0, i, None, None) for i in range(9)] and merkle.changed(mark, mark) == []
    parts = ["".join(lines[:3]) + "\n", "".join(lines[3:6]) + "\n", "".join(lines[6:])]
    moved = merkle.changed(merkle.fingerprint("".join(parts)), merkle.fingerprint("".join([parts[0], new + "\n", *parts[1:]])))
    assert moved == [(None, None, 1, 0)]
    for _ in range(300):
        # without repeats an aligned child is a longest common subsequence; with repeats never more, and all pairs are equal
        x, y = ([random.choice("abcdefgh") for _ in range(random.randint(0, 9))] for _ in range(2))
        found = merkle.in_both(x, y)
        assert all(x[i] == y[j] for i, j in found) and found == sorted(found) and len({j for _, j in found}) == len(found) <= longest_common(x, y)
        x, y = list(dict.fromkeys(x)), list(dict.fromkeys(y))
        assert len(merkle.in_both(x, y)) == longest_common(x, y)
        one, two = ([i for i, _ in merkle.gaps(x, y) if i is not None], [j for _, j in merkle.gaps(x, y) if j is not None])
        assert sorted(one + [i for i, _ in merkle.in_both(x, y)]) == list(range(len(x))) and sorted(two + [j for _, j in merkle.in_both(x, y)]) == list(range(len(y)))
    pairs = spark.createDataFrame([(1, mark, merkle.fingerprint(new + "".join(lines)), "x"), (2, mark, mark, None), (3, None, mark, "")], "id long, fingerprint string, edited_fingerprint string, edits string")
    got = {r.id: [tuple(e) for e in r.edits] for r in merkle.locate_edits(pairs).collect()}
    assert got == {1: [(None, None, 0, 0)], 2: [], 3: []}
    assert merkle.locate_edits(pairs.limit(0)).count() == 0


def test_leaves_follow_the_content():
    random.seed(9)
    script = "".join(chr(random.randrange(0x4E00, 0x9FA5)) for _ in range(6000))
    for at in (3, 300, 5000):
        edited = script[:at] + "\u4e00" + script[at:]
        assert "".join(merkle.pieces(edited)) == edited
        assert merkle.likeness(merkle.fingerprint(script), merkle.fingerprint(edited)) > 0.9
    for text in ("a" * 100_000, " " * 70_000, "a b" * 9_000, "\n" * 600, "x" * 255 + "\n\n" + "y" * 600, "\ud800" * 900):
        assert "".join(merkle.pieces(text)) == text
        assert max(map(len, merkle.pieces(text.replace(" ", "z").replace("\n", "z")))) <= 400
    assert merkle.fingerprint("x" * 255 + "\n\n" + "y" * 600).count("|") == 1


def test_ids_are_cut_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANKS", 4)
    ids = spark.range(4000).select((F.col("id") * F.col("id")).alias("doc_id")).repartition(5)
    borders = merkle.range_borders(ids, 32)
    sizes = np.bincount(np.searchsorted(borders, (np.arange(4000) ** 2)))
    assert 28 <= len(borders) + 1 <= 33 and sizes.max() <= 2.5 * 4000 / 32 and (np.diff(borders) > 0).all()
    assert len(merkle.range_borders(ids.limit(0), 32)) == 0 and len(merkle.range_borders(ids, 1)) == 0


def test_every_document_meets_the_next(spark, dirty, nothing):
    texts = {r[0]: r[1] or "" for r in rows() if r[0] is not None and r[0] < 26}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r for r in merkle.compare_with_next(df).collect()}
    order = sorted(texts, reverse=True)
    for i, k in enumerate(order):
        own, after = texts[k], texts[order[(i + 1) % len(order)]]
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (merkle.fingerprint(own), merkle.fingerprint(edited))
        assert [tuple(e) for e in r.edits] == merkle.changed(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == merkle.likeness(r.fingerprint, merkle.fingerprint(after)) and 0 <= r.near_edited <= 1
    assert merkle.compare_with_next(dirty).count() == merkle.fingerprints(dirty).count() == len(rows())
    assert merkle.compare_with_next(nothing).count() == 0
    assert merkle.compare_with_next(df.where("doc_id = 4")).first().near_next == 1


def test_quality_is_learned_and_held_out(spark):
    random.seed(3)
    good = [" ".join(random.choice("the of and to in it was red blue tree".split()) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(random.choice("the of and BUY NOW FREE CLICK".split()) + random.choice(("!!", "$$$", "")) for _ in range(60)) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string").repartition(3)
    labels = docs.select("doc_id", (F.col("doc_id") < 150).cast("int").alias("quality"))
    got = quality.score_documents(docs, labels)
    held = got.where("held_out").collect()
    assert len(held) > 30 and all((r.predicted == 1) == (r.doc_id < 150) for r in held)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, quality.score_documents(docs, labels).collect()))


def test_word_vectors_equal_brute_force(spark, monkeypatch):
    """Sums of the neighbours' index vectors, added in groups of tasks; features are means over words."""
    monkeypatch.setattr(quality, "GROUP", 2)
    texts = ["a b c a", "", "Solo", "x1 x1 Y, z", "b a", "\u00e9 a"]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts * 3], "text string").repartition(5))
    places, signs = quality.index_vectors()
    want = np.zeros((quality.BUCKETS, quality.WIDTH))
    for t in texts:
        word, shape, _ = quality.buckets(pa.array([t]))
        for ids in (word.tolist(), shape.tolist()):
            for i, own in enumerate(ids):
                for other in ids[max(0, i - 1) : i] + ids[i + 1 : i + 2]:
                    for e in range(quality.ENTRIES):
                        want[own, places[other, e]] += 3 * signs[other, e]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1.0)
    assert np.allclose(got, want, atol=1e-6)
    features = quality.pooled(pa.array(texts), got)
    word, shape, _ = quality.buckets(pa.array([texts[3]]))
    assert np.allclose(features[3], np.concatenate((got[word].mean(0), got[shape].mean(0))), atol=1e-6) and not features[1].any()


def test_labelled_sample_is_drawn_by_hash(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, quality int")
    vectors = quality.word_vectors(docs)
    x, y = quality.labelled_sample(docs, labels, vectors, most=50)
    assert len(x) == len(y) == 50 and 0 < y.sum() < 50
    fold = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5]
    order = {r.doc_id: r.h & (2**63 - 1) for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    first = sorted(fold, key=order.get)[:50]
    assert y.tolist() == [i % 2 for i in first]
    assert np.allclose(x, [quality.pooled(pa.array([f"text {i}"]), vectors)[0] for i in first], atol=1e-6)


def test_quality_of_dirty_rows(spark, dirty, nothing):
    labels = spark.createDataFrame([(i, i % 2 if i != 3 else None) for i in range(12)] + [(None, 1), (1, 0), (22, 1)], "doc_id long, quality int")
    got = quality.score_documents(dirty, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality.good_documents(dirty, labels).columns == dirty.columns
    assert {r.score for r in quality.score_documents(dirty, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(nothing, labels).count() == quality.good_documents(nothing, labels).count() == 0


def test_languages_are_told_apart(spark):
    random.seed(8)
    kinds = {"aa": "ka lo mi nu pe".split(), "bb": "strz krz wsch prz".split(), "ü": "öäü ßüö äöß".split()}
    data = [(i, "".join(random.choice(kinds[k]) + random.choice(("", " ")) for _ in range(40)), k) for i, k in enumerate(list(kinds) * 60)]
    docs = spark.createDataFrame(data + [(900, None, "aa"), (901, "12 34", "aa"), (902, "", None)], "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == k for i, _, k in data) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    strange = spark.createDataFrame([(1000, "QXQX JJQX " * 20, None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.rejected for r in langid.identify(docs.unionByName(strange)).collect()}[1000]


def test_copies_leave_every_language_its_texts(spark):
    random.seed(9)
    kinds = {"aa": "ka lo mi nu pe".split(), "bb": "strz krz wsch prz".split(), "cc": "thod quib voun".split()}
    texts = [(f"{i} " + " ".join(random.choice(kinds[k]) for _ in range(30)), k) for i, k in enumerate(list(kinds) * 40)]
    copied = [(f"copy {' '.join(kinds[k])}", k) for k in kinds]
    rows = spark.createDataFrame(texts + copied * 4000 + [("x", "dd"), ("12 34", "dd"), ("", "dd")], "text string, lang string").repartition(3)
    drawn = [(r.lang, r.text) for r in langid.drawn(rows, 20).collect()]
    assert len(set(drawn)) == len(drawn) and {k: sum(a == k for a, _ in drawn) for k in kinds} == dict.fromkeys(kinds, 20)
    assert len(langid.drawn(rows, 100).collect()) == 3 * 41
    model = langid.train(rows, 20)
    assert set(model["langs"]) == set(kinds)
    docs = spark.createDataFrame([(i, t, k, True) for i, (t, k) in enumerate(texts)], "doc_id long, text string, lang string, letters boolean")
    assert all(texts[r.doc_id][1] == r.lang_pred for r in langid.predict(docs.drop("lang"), model).collect())


def test_languages_equal_brute_force(spark):
    """The drawn texts, the counts of n-grams and the nearest centroid by their definitions."""
    rng = random.Random(4)
    texts = [("".join(rng.choice("abc de" if i % 2 else "xyz vw") for _ in range(rng.randrange(2, 60))), "ef"[i % 2]) for i in range(60)] * 2
    df = spark.createDataFrame(texts, "text string, lang string").repartition(4)
    got = {(r.lang, r.text) for r in langid.drawn(df, 7).collect()}
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    want = set()
    for lang in "ef":
        mine = {t for t, x in texts if x == lang and re.search("[A-Za-z]", t)}
        want |= {(lang, t) for t in sorted(mine, key=hashes.get)[:7]}
    assert got == want
    model = langid.train(df, most=7)
    docs = df.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.lit(True).alias("letters"))
    idf = np.asarray(model["idf"])
    for r in docs.join(langid.predict(docs, model), "doc_id").collect():
        grams = Counter(r.text[i : i + k] for k in (2, 3) for i in range(len(r.text) - k + 1) if r.text[i : i + k].strip())
        x = np.zeros(langid.FEATURES)
        for g, n in grams.items():
            code = 0
            for c in g.encode():
                code = (code * 257 + c) % 2**32
            x[(code * 2654435761 % 2**32) >> (32 - langid.FEATURES.bit_length() + 1)] += n
        x = np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0) * idf
        near = model["centres"] @ (x / max(np.linalg.norm(x), 1e-12))
        assert r.lang_pred == model["langs"][int(near.argmax())] and math.isclose(r.score, min(1.0, max(0.0, near.max())), abs_tol=1e-5)


def test_languages_of_dirty_rows(dirty, nothing):
    assert langid.identify(dirty).count() == len(rows()) and langid.identify(nothing).count() == 0
    unlabelled = langid.identify(dirty.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unlabelled} == {("und", 0.0)}


def test_rules_and_tokens():
    assert urlfilter.literals("||casino-*.") == ["casino"] and urlfilter.literals("||example.org/en/1") == ["en", "example", "org"]
    assert urlfilter.literals("*x*") == [] and urlfilter.literals("/ads^") == ["ads"]
    assert re.search(urlfilter.expression("||example.org/en/1"), "a.example.org/en/17") and not re.search(urlfilter.expression("||example.org/es/"), "xexample.org/es/")


def test_longest_rule_wins(spark):
    urls = [
        ("HTTP://A.Example.ORG/en/12?x", "org/", "allow"), ("x://example.org/en/1", "example.org/en/1", "block"), ("x://example.org/es/?", "example.org/es/", "block"),
        ("x://net.com/fr/", "com/fr/", "allow"), ("x://com/de/a#b", "com/de/", "block"), ("x://example.com/de", None, "allow"), ("x://cheap-pills.example.com/", None, "block"),
        ("example.org/es/", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("x://ORG", None, "allow"), ("x://example.net/ads/1", None, "block"), ("x://a.org/\nads/", "org/", "allow"),
    ]
    urls[0] = ("HTTP://A.Example.ORG/en/12?x", "example.org/en/1", "block")
    pages = spark.createDataFrame([(i, u, "h", "p") for i, (u, _, _) in enumerate(urls)] * 2, "page_id long, url string, host string, rule string")
    got = urlfilter.judge_urls(pages).collect()
    assert len(got) == 2 * len(urls) and {(r.page_id, r.rule, r.verdict) for r in got} == {(i, rule, v) for i, (_, rule, v) in enumerate(urls)}
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0
    odd = (urlfilter.Rule("block", "*q*"), urlfilter.Rule("allow", "||q.com^"))
    assert {(r.page_id, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame([(1, "x://aqb.net/"), (2, "x://q.com/")], "page_id long, url string"), rules=odd).collect()} == {(1, "block"), (2, "allow")}


def test_escapes_are_reversible():
    for text in ("<|end|>", "<\\|", "<\\\\||<|", "<", "|", "<|role|>x<|text|>", "</s>[INST]", "a<\n|"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.read_turns(chat.format_turn(text, text) * 2) == [(text, text)] * 2


def test_masks_hold_the_learned_texts():
    long = "\u00e9<|end|>" * 60_000
    for turns in ([("user", "a"), ("assistant", ""), ("assistant", long), ("system", "<|role|>assistant<|text|>")], [("<|text|>", "assistant")], [("assistant", "<\\|end|>"), ("assistant", "b")]):
        ids, mask = chat.token_ids("".join(chat.format_turn(*t) for t in turns))
        assert chat.read_turns(chat.read_tokens(ids)) == turns
        assert chat.learned_texts(ids, mask) == "".join(x for r, x in turns if r == "assistant")
        assert not chat.learned_texts(ids, np.zeros(len(ids), bool))


def conversation_rows():
    talks = {
        1: ["hi", "yes", "more", "ok"], 2: ["hi", "yes", "less", "no"], 3: ["hi", "no"], 4: ["alone", "b"], 5: ["hi", "yes"], 6: ["hi", "yes", "more", "ok"], 7: ["<|end|>", None],
        None: ["lost"], 8: ["hi", "yes", "more", "other", "x", "y"],
    }
    out = [(c, t, ("user", "assistant")[t % 2], x) for c, xs in talks.items() for t, x in enumerate(xs)]
    return out + [(9, None, None, "no role"), (9, 1, "assistant", "tie b"), (9, 1, "assistant", "tie a")]


def test_trees_share_turns_and_read_back(spark):
    given = conversation_rows()
    turns = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").repartition(4).withColumn("node", F.lit(1))
    nodes, ways = chat.prefix_trees(turns)
    held = [r.asDict(recursive=True) for r in nodes.collect()]
    assert len({n["node"] for n in held}) == len(held) and sum("hi" in n["text"] for n in held) == 1
    by = {n["node"]: n for n in held}
    for n in held:
        above = []
        up = n["parent"]
        while up is not None:
            above.insert(0, {"start": by[up]["start"], "end": by[up]["start"] + by[up]["n_tokens"]})
            up = by[up]["parent"]
        assert n["attend"] == above and n["position"] == sum(a["end"] - a["start"] for a in above)
        assert len(chat.token_ids(n["text"])[0]) == n["n_tokens"]
    for tree in {n["tree"] for n in held}:
        mine = sorted((n for n in held if n["tree"] == tree), key=lambda n: n["start"])
        at = 0
        open_ = []
        for n in mine:
            assert n["start"] == at
            at += n["n_tokens"]
            while open_ and open_[-1] != n["parent"]:
                open_.pop()
            assert n["parent"] is None or open_
            open_.append(n["node"])
    got = {r.conv_id: r for r in chat.read_back(nodes, ways).collect()}
    for c in {r[0] for r in given}:
        mine = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in given if k == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in mine]
        assert got[c].learned == "".join(x for _, r, x in mine if r == "assistant")
    made = {r.node: r for r in chat.training_rows(nodes).collect()}
    names = {i: x for x, i in chat.CONTROLS.items()}
    for n in held:
        r = made[n["node"]]
        assert r.positions == list(range(n["position"], n["position"] + n["n_tokens"])) and len(r.tokens) == len(r.learned) == n["n_tokens"]
        assert b"".join(names[t].encode() if t > 255 else bytes([t]) for t in r.tokens).decode() == n["text"] == chat.read_tokens(np.array(r.tokens))
        shown = [bytes(t for t, m in zip(r.tokens, r.learned, strict=True) if m and t < 256).decode(), sum(m and t == 258 for t, m in zip(r.tokens, r.learned, strict=True))]
        own = [chat.escape(x) for role, x in chat.read_turns(n["text"]) if role == "assistant"]
        assert shown == ["".join(own), len(own)]
    assert chat.training_rows(nodes.limit(0)).count() == 0
    empty, none = chat.prefix_trees(turns.limit(0))
    assert empty.count() == none.count() == 0
