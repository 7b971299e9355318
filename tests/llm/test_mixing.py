"""The size of the mixture with a scarce domain, and the test that ends the steps."""

from __future__ import annotations

import numpy as np
import pytest

from grainspark.llm import mixing


def scarce_model():
    """Three domains; the third has posterior 0.0004 everywhere, which rounds to nothing."""
    return mixing.DomainModel(["a", "b", "c"], weights=np.log([[0.7996], [0.2], [0.0004]]))


def test_a_scarce_domain_does_not_empty_the_mixture(spark):
    docs = spark.createDataFrame([(i, "one two three four five") for i in range(40)], "doc_id long, text string")
    shares = {"a": 0.8, "b": 0.19, "c": 0.01}
    whole = mixing.mix(docs, scarce_model(), shares, mixing.INPUT).toPandas()
    assert (whole.rate > 0.5).all() and (whole.copies >= 0).all()
    assert mixing.mix(docs, scarce_model(), shares).toPandas().equals(whole)
    small = mixing.mix(docs, scarce_model(), shares, mixing.UNREPEATED).toPandas()
    assert (small.rate > 0).all()


def test_rows_without_ids_draw_each_for_itself(spark):
    rows = [(None, f"word number {i}") for i in range(300)] + [(7, f"other {i}") for i in range(300)] + [(None, "one and the same")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = mixing.mix(docs, mixing.DomainModel(["all"]), {"all": 1.0}, 1080.0).toPandas()  # 2,700 tokens come in
    assert np.allclose(got.rate, 1080 / 2700, rtol=1e-3) and set(got.copies) == {0, 1}
    for part in (got[got.text.str.startswith("word")], got[got.doc_id == 7], got[got.text == "one and the same"]):
        assert 80 < part.copies.sum() < 160


def test_input_size_is_kept_with_rates_above_one(spark):
    p = np.array([[990, 10], [5, 995]])
    types = spark.createDataFrame([([990, 10], 9900.0), ([5, 995], 100.0)], "p array<int>, tokens double")
    steps = mixing.fit_rates(types, 2, np.array([0.5, 0.5]) * 10_000)
    rate = steps.rates(p / 1000)
    assert steps.gap <= 1e-4 and rate[1] > 40 and np.allclose((rate * [9900, 100]) @ (p / 1000), [5000, 5000], rtol=1e-3)


def test_steps_that_end_too_early_are_reported(spark):
    types = spark.createDataFrame([([600, 400], 100.0), ([500, 500], 100.0), ([550, 450], 300.0)], "p array<int>, tokens double")
    with pytest.warns(UserWarning, match="optimality test"):
        assert mixing.fit_rates(types, 2, np.array([290.0, 210.0]), max_steps=2).gap > 1e-4
    steps = mixing.fit_rates(types, 2, np.array([400.0, 100.0]), max_steps=400)  # no rates meet these targets
    assert steps.gap <= 1e-4 and np.allclose(steps.rates(np.array([[0.5, 0.5]])), 0)
