"""The registered corpus queries against their SQL twins, and the pipeline against a brute-force version."""

import os

import duckdb
import pytest

import corpus_pipeline
from tapelab.llm import decontam, mixing, neardup, pii, queries, quality
from tapelab.llm.common import table

from .test_pairs import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_twin(spark, con, key):
    df = queries.QUERIES[key](spark, SF)
    names = sorted(df.columns)
    twin = con.sql(queries.ORACLES[key])
    assert sorted(twin.columns) == names
    mine = sorted(map(repr, (tuple(r) for r in df.select(names).collect())))
    assert mine == sorted(map(repr, twin.project(", ".join(names)).fetchall()))


def test_queries_cover_their_tables(spark):
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    for key, of in (("op1", "documents"), ("op2", "documents"), ("op9", "documents")):
        name = next(k for k in queries.QUERIES if k.split("_")[0] == key)
        assert queries.QUERIES[name](spark, SF).count() == table(spark, SF, of).count()


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    scores = {r.doc_id: r.predicted for r in quality.score_documents(docs, table(spark, SF, "labels")).collect()}
    held = [r.asDict() for r in docs.orderBy("doc_id").collect() if scores[r.doc_id]]
    label, _ = components([r["text"] for r in held], 5, 80)
    held = [r for i, r in enumerate(held) if label[i] == i]
    matcher = decontam.Matcher([(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()], decontam.CHARS_PER_EDIT)
    held = [r for r in held if not list(matcher.find(decontam.normal(r["text"])))]
    for r in held:
        r["text"] = pii.clean(r["text"], {})
        r["n_chars"] = len(r["text"])
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(spark.createDataFrame(held, docs.schema)).collect()}
    want = {(r["doc_id"], r["text"], r["source"], r["n_chars"], taken[r["doc_id"]]) for r in held if taken[r["doc_id"]]}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "mix_taken"]
    assert {(r.doc_id, r.text, r.source, r.n_chars, r.mix_taken) for r in got.collect()} == want
    assert neardup.BANDS * neardup.BINS_PER_BAND == 200
