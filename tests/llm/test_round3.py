"""Findings of round 3 on the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trovex.llm import lattice_lm

SF = "/root/testdata/sf0.001"


def test_held_out_scores_keep_up_with_the_word_model(spark):
    got = lattice_lm.op9_lattice_lm(spark, SF).where("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count_if(F.isnan("score") | (F.abs("score") > 1e9) | F.col("score").isNull()).alias("bad")).first()
    assert got.bad == 0 and got.s / got.n > got.b / got.n - 1.2


def test_words_as_pieces_share_one_probability():
    count, lattice = np.array([7, 2, 1, 0]), np.log([0.4, 0.3, 0.2, 0.1])
    got = np.exp(lattice_lm._with_words(lattice, count, 3, 10, 0.5))
    assert got.sum() == pytest.approx(1) and got == pytest.approx([(c - 0.5 * (c > 0) + 1.5 * p) / 10 for c, p in zip(count, np.exp(lattice))])
    assert lattice_lm._with_words(np.array([-5000.0]), np.array([0]), 3, 10, 1.0)[0] == pytest.approx(-5000 + math.log(0.3))
    assert lattice_lm._with_words(np.array([-5.0]), np.array([0]), 0, 0, 0.5)[0] == -5
