"""Cuts found by review: each case fails where part of the job is left out."""

import numpy as np
import pytest

from trovex.llm import lattice_lm, line_join


def test_line_links_count_every_similar_class(spark):
    base = [f"w{i}" for i in range(20)]
    near = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(5)]  # 18 of 22 words in common: all alike
    texts = [*near, near[2], "something else\nwholly", " \n", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in line_join.line_links(docs, cell_bits=10, place_bits=10).collect()}
    assert sorted(got) == list(range(9))
    assert [got[i].links for i in range(9)] == ["4"] * 6 + ["0,0", "", ""]
    named = {i: ",".join(":".join(x.split(":")[::2]) for x in r.classes.split(",")) for i, r in got.items()}  # without the hash of the text
    assert [named[i] for i in range(9)] == ["0:0", "1:0", "2:0", "3:0", "4:0", "2:0", "6:0,6:1", "", ""]
    assert [got[i].n_removed for i in range(9)] == [0, 1, 1, 1, 1, 1, 0, 0, 0]
    assert got[7].n_lines == got[8].n_links == 0


def test_rows_without_an_id_of_their_own_lose_only_their_lines(spark):
    rows = [(1, "alpha beta"), (None, "alpha beta"), (None, "gamma delta"), (None, None), (5, "one two\nalpha beta"), (5, "three four\nfive six"), (None, "seven eight\nalpha beta")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_join.drop_similar_lines(docs, cell_bits=10, place_bits=10).collect()
    want = {(1, "alpha beta"), (None, "gamma delta"), (None, None), (5, "one two"), (5, "three four\nfive six"), (None, "seven eight")}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    per_row = sorted((r.n_lines, r.n_removed) for r in line_join.line_links(docs, cell_bits=10, place_bits=10).collect())
    assert per_row == [(0, 0), (1, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 1)]


def test_long_training_words_are_counted():
    p = lattice_lm.Pieces([bytes([b]) for b in range(256)] + [lattice_lm.MARK + b"a", b"ab", b"b" * 3, b"abcab"], np.log(np.arange(1, 261) / np.arange(1, 261).sum()))
    words = [b"ab" * 20, b"abcab" * 9, b"x" * 44, lattice_lm.END]
    count = np.array([3.0, 2.0, 5.0, 7.0])
    long = [w * 2 for w in words[:3]]
    assert min(map(len, long)) > lattice_lm.LONG
    for w, c in zip(words[:3], count):  # one word at a time equals rows of words of one length
        one = np.zeros(len(p.logp))
        lattice_lm._long_counts(lattice_lm.MARK + w, c, p, one)
        assert one == pytest.approx(lattice_lm.expected_counts([w], np.array([c]), p))
    got = lattice_lm.expected_counts(long, count[:3], p)
    size = np.array([*map(len, p.text)])
    assert (got * size).sum() == pytest.approx(sum(c * len(lattice_lm.MARK + w) for w, c in zip(long, count)))


def test_frequent_long_words_gain_by_learning(spark):
    word = "数据处理" * 6  # 72 bytes without a blank
    docs = spark.createDataFrame([(i, word) for i in range(40)], "doc_id long, text string")
    first, learned = (lattice_lm.lattice_scores(docs, em_rounds=2).first()[c] for c in ("score", "em_score"))
    assert learned > first + 10
