"""Lookups whose rows can grow with the square of the tables."""

import random

from lexengine.operators import lookup


def test_forms_are_met_in_blocks(spark, monkeypatch):
    """Rows of the second pass are made in blocks and not shuffled once more; each is there once, whatever dictionaries its ids share."""
    monkeypatch.setattr(lookup, "BLOCK", (7, 5))
    monkeypatch.setattr(lookup, "TASK_PAIRS", 100)
    rng = random.Random(3)
    hits = [(rng.randint(0, 2), i, rng.choice("ABC")) for i in range(60) for _ in range(2)] + [(0, None, "A"), (1, 3, None)]
    redirects = [(i, rng.choice(["x", "y", "none", None])) for i in range(60)] + [(3, "x"), (4, "y")]
    keys = [(rng.choice(["x", "y", "z"]), s, i, rng.choice("ABC"), 0) for i in range(40, 140) for s in (0, 1, 1)] + [("x", 0, None, "A", 0), ("x", 0, 5, None, 0), (None, 0, 6, "A", 0)]
    out = lookup.form_of(
        spark.createDataFrame(hits, "pos int, id long, dictionary string"), spark.createDataFrame(redirects, "id long, form_of string"),
        spark.createDataFrame(keys, "key string, src int, id long, dictionary string, dict_idx int"),
    )
    expected = {
        (pos, i, form, k)
        for pos, i, own in hits for of, form in redirects for key, _, k, d, _ in keys
        if None not in (i, own, form, k) and i == of and form == key and own == d and i != k
    }
    rows = [tuple(r) for r in out.collect()]
    assert len(expected) > 1500 and set(rows) == expected and len(rows) == len(expected)
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in above
    assert out.rdd.getNumPartitions() > 4
