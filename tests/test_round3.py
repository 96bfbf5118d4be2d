"""Findings of round 3: work that grew faster than the input, or lay on one core."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovex.operators import dense_cells
from trovex.operators import retrieval as R


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<float>, label int")


def brute(rows, places=4):
    out = {}
    for q, x, _ in rows[::3]:
        for d, y, _ in rows:
            if q != d:
                total = 0.0
                for a, b in zip(x, y):
                    total += a * b
                out[q, d] = dense_cells._rounded(total, places)
    return out


def test_dense_cells_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    # eighths: many equal scores, and scores in the middle between two of one place
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 8], int(rng.integers(3)) if i % 7 else None) for i in range(60)]
    want = brute(rows, 1)
    docs = vectors(spark, rows)
    queries = docs.where("id % 3 = 0")
    small = {"query_rows": 6, "doc_rows": 17}
    monkeypatch.setattr(dense_cells, "BLOCK_PAIRS", 40)
    got = {(r.query_id, r.doc_id): r.score for r in dense_cells.scores(queries, docs, 1, **small).collect()}
    assert got == want
    order = {q: sorted((d for a, d in want if a == q), key=lambda d: (-want[q, d], d)) for q, _ in want}
    top = R.ranked(dense_cells.top(queries, docs, 4, 1, **small), 4, 1).collect()
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in top) == sorted((q, n + 1, d) for q in order for n, d in enumerate(order[q][:4]))
    label = {i: c for i, _, c in rows}
    rel = {q: [label[q] is not None and label[d] == label[q] for d in order[q]] for q in order}
    ranks = {r.query_id: (r.first, r.ranking) for r in dense_cells.ranks(queries, docs, 4, 1, **small).collect()}
    assert ranks == {q: (1 + x.index(True) if any(x) else None, x[:4]) for q, x in rel.items()}
    m = R.dense_metrics(queries, docs, (2,), 1).first()
    have = [x for x in rel.values() if any(x)]
    assert m.mrr == pytest.approx(np.mean([1 / (1 + x.index(True)) for x in have]))
    assert m.map_2 == pytest.approx(np.mean([sum(sum(x[: i + 1]) / (i + 1) for i in range(2) if x[i]) / min(2, sum(x)) for x in have]))
    assert m.ndcg_2 == pytest.approx(np.mean([sum(1 / math.log2(i + 2) for i in range(2) if x[i]) / sum(1 / math.log2(i + 2) for i in range(min(2, sum(x)))) for x in have]))


def test_dense_rows_do_not_outgrow_the_ranking(spark):
    docs = vectors(spark, [(i, [math.cos(i), math.sin(i)], i % 2) for i in range(400)])
    assert dense_cells.top(docs, docs, 3, query_rows=100, doc_rows=200).count() <= 400 * 2 * 3


def test_dense_odd_vectors(spark):
    docs = vectors(spark, [(1, [1.0, 2.0], 1), (2, None, 1), (3, [1.0], 1), (4, [2.0, None], 1), (None, [1.0, 1.0], 1), (5, [0.5, 0.25], 1), (6, [], 1)])
    got = {r.doc_id: r.score for r in R.dense(docs.where("id = 1"), docs).collect()}
    assert got == {2: None, 3: None, 4: None, 5: 1.0, 6: None}
    assert [r.doc_id for r in R.dense_top(docs.where("id = 1"), docs, 3).orderBy("rank").collect()] == [5, 2, 3]
    assert R.dense(docs.where("id = 0"), docs).count() == 0


def test_small_tables_of_costly_rows_use_all_cores(spark):
    from trovex.plans import registry

    for name in ("patent_pages", "page_videos", "fuzzy_mask"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_lexical_pairs_do_not_become_joined_rows(spark):
    docs = spark.createDataFrame([(i, f"common words w{i}") for i in range(50)] + [(None, "common null"), (77, None)], "doc_id long, text string")
    asks = spark.createDataFrame([(i, f"common w{i}") for i in range(20)] + [(90, "absent")], "item_id long, text string")
    v = R.bm25(asks, docs, "item_id", "doc_id")
    rows = v.scores().collect()
    # a document without an id is a row, one without a common word is none
    assert len(rows) == 20 * 51 and {r.query_id for r in rows} == set(range(20)) and sum(r.doc_id is None for r in rows) == 20
    assert v.docs.count() == 51  # postings travel once a document, not once a query
    top = {(r.query_id, r["rank"]): r.doc_id for r in v.top(1).collect()}
    assert top == {(i, 1): i for i in range(20)}
    m = v.metrics(spark.createDataFrame([(0, 0), (1, 5), (90, 3)], "query_id long, doc_id long"), (10,)).first()
    place = {r.doc_id: r["rank"] for r in R.ranked(v.scores()).where("query_id = 1 and doc_id is not null").collect()}
    assert m.mrr == pytest.approx((1 + 1 / place[5] + 0) / 3)


def test_tokens_need_no_pattern(spark):
    import re
    import string

    from trovex.functions.text import bm25_tokens

    odd = ["", " \t\n\x0b\x0c\r", string.printable, "A-b c_D e f, g", "É'tat «x» 漢字.", "a" * 3 + "\t\tb\r\n" + string.punctuation]
    got = spark.createDataFrame([(x,) for x in odd], "t string").select("t", bm25_tokens(F.col("t")).alias("w")).collect()
    for t, w in got:
        assert w == [x for x in re.split("[ \t\n\x0b\x0c\r]+", "".join(c for c in t.lower() if c not in string.punctuation)) if x]
    assert "regexp" not in spark.range(1).select(bm25_tokens(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
