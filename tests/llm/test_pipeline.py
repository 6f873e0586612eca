"""The pipeline's stages against plain versions, and the registered SQL."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from partloom.llm import bpe, exact_dedup, near_dedup, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        nxt = f(spark, docs, SF).toPandas()
        out.append((name, docs.toPandas(), nxt))
        docs = spark.createDataFrame(nxt)
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["quality rules", "exact dedup", "near-dedup", "source mixing", "byte-level BPE"]
    for _, before, after in stages[:-1]:
        assert list(after) == list(before)


def test_quality_stage(spark, stages):
    _, before, after = stages[0]
    kept = {r["doc_id"] for r in quality.quality_report(spark.createDataFrame(before)).where("kept").collect()}
    assert set(after.doc_id) == kept


def test_exact_stage(stages):
    _, before, after = stages[1]
    assert sorted(after.doc_id) == sorted(before.groupby("text").doc_id.max())


def test_near_stage(stages):
    _, before, after = stages[2]
    sets = {}
    for i, t in zip(before.doc_id, before.text, strict=True):
        w = t.encode().lower().split()
        sets[i] = {b" ".join(w[j : j + 5]) for j in range(len(w) - 4)} or {b" ".join(w)}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    assert sorted(after.doc_id) == sorted({find(i) for i in ids})


def test_mix_stage(stages):
    _, before, after = stages[3]
    words = lambda d: d.text.str.split().str.len().sum()
    assert abs(words(after) - words(before)) <= 0.05 * words(before) and set(after.doc_id) <= set(before.doc_id)
    assert after.groupby("doc_id").size().max() <= 3


def test_last_stage(stages):
    _, before, after = stages[4]
    assert sorted(after.doc_id) == sorted(before.doc_id) and (after.n_tokens > 0).all()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLES[name]).df()
    cols = sorted(want)
    assert sorted(got) == cols and (got.sort_values("doc_id").reset_index(drop=True)[cols] == want.sort_values("doc_id").reset_index(drop=True)[cols]).all().all()


def test_every_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    assert bpe and exact_dedup and near_dedup
