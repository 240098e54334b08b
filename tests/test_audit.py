"""Recomputed totals and score distributions against plain Python."""

import json
import math
import random
from decimal import Decimal

from pyspark.sql import functions as F

from candrank.operators import audit
from candrank.schemas import RUBRIC
from candrank.sources import documents

TEXTS = "role string, candidate_id string, document string"


def rubric(spark, *roles):
    rows = [(r, r, 1, [], [("a", 0.1, ""), ("b", 0.2, ""), ("c", 0.7, "")]) for r in roles]
    return spark.createDataFrame(rows, RUBRIC)


def answer(total, *criteria):
    return json.dumps({"criteria": [{"id": i, "score": s} for i, s in criteria], "weighted_total": total})


def totals(spark, texts, rubrics):
    view = documents.criteria_view(spark.createDataFrame(texts, TEXTS))
    return {r.candidate_id: r for r in audit.recomputed_totals(view, rubrics).collect()}


def test_every_verdict(spark):
    full = (("a", 3), ("b", 0.3), ("c", "9.1"))
    texts = [
        ("r", "exact", answer(6.73, *full)),
        ("r", "near", answer(6.78, *full)),
        ("r", "far", answer(6.781, *full)),
        ("r", "none", answer(None, *full)),
        ("r", "missing", answer(6.37, ("c", 9.1))),
        ("r", "unscored", answer(6.37, ("a", 3), ("b", None), ("c", 9.1))),
        ("r", "unknown", answer(6.73, *full, ("z", 4))),
        ("r", "twice", answer(6.73, *full, ("a", 1))),
        ("r", "no list", json.dumps({"weighted_total": 5})),
        ("r", "empty", answer(5)),
        ("r", "odd items", json.dumps({"criteria": [1, None, {"id": 5, "score": 5}], "weighted_total": 0})),
        ("other", "no rubric", answer(6.73, *full)),
        ("r", "unreadable", "{"),
        ("r", "null", None),
    ]
    got = totals(spark, texts, rubric(spark, "r"))
    assert {k: r.verdict for k, r in got.items()} == {
        "exact": "agrees",
        "near": "agrees",
        "far": "differs",
        "none": "no total",
        "missing": "ids differ",
        "unscored": "ids differ",
        "unknown": "ids differ",
        "twice": "ids differ",
        "no list": "no criteria",
        "empty": "ids differ",
        "odd items": "ids differ",
        "no rubric": "no rubric",
    }
    assert got["exact"].recomputed == Decimal("6.73") and got["exact"].difference == 0
    assert got["twice"].recomputed == Decimal("6.83") and got["twice"].repeated_ids == ["a"]
    assert got["unscored"].missing_ids == ["b"] and got["unscored"].recomputed == Decimal("6.67")
    assert got["unknown"].unknown_ids == ["z"] and got["empty"].missing_ids == ["a", "b", "c"]
    assert got["no rubric"].recomputed is None


def test_a_long_answer_keeps_its_criteria(spark, monkeypatch):
    monkeypatch.setattr(documents, "LONG_CHARS", 10)
    got = totals(spark, [("r", "x", answer(6.73, ("a", 3), ("b", 0.3), ("c", 9.1)))], rubric(spark, "r"))
    assert got["x"].verdict == "agrees"


def test_no_answers(spark):
    view = documents.criteria_view(spark.createDataFrame([], TEXTS))
    found = audit.recomputed_totals(view, rubric(spark, "r"))
    assert found.isEmpty() and audit.audit_summary(found).isEmpty()


def test_distributions_are_those_of_all_rows(spark):
    draw = random.Random(5)
    rows = [
        (draw.choice("rs"), draw.choice(["x", "y", None]), round(draw.random() * 10, 3), draw.random() < 0.3)
        for _ in range(900)
    ] + [("r", "x", None, True), ("r", "x", math.nan, False), ("r", "only", math.inf, False)]
    df = spark.createDataFrame(rows, "role string, g string, weighted_total double, chosen boolean")
    parts = [df.filter(F.col("weighted_total") < 4), df.filter(~F.coalesce(F.col("weighted_total") < 4, F.lit(False)))]
    bins = [audit.score_bins(p, ["g"], F.col("chosen")) for p in parts]
    merged = audit.merged_bins(bins[0].unionByName(bins[1]), ["g"])
    got = {(r.role, r.g): r for r in audit.distributions(merged, ["g"]).collect()}
    assert set(got) == {(r, g) for r in "rs" for g in ("x", "y", None)} | {("r", "only")}
    rates = {}
    for role, g in got:
        mine = [x for x in rows if x[:2] == (role, g)]
        rates[role, g] = sum(x[3] for x in mine) / len(mine)

    def finite(role, g=...):
        return sorted(
            x[2] for x in rows
            if x[0] == role and g in (..., x[1]) and x[2] is not None and math.isfinite(x[2])
        )

    for (role, g), r in got.items():
        values, every = finite(role, g), finite(role)
        assert r.scored == len(values)
        assert r.selection_rate == rates[role, g]
        assert r.impact_ratio == rates[role, g] / max(v for (o, _), v in rates.items() if o == role)
        if not values:
            assert r.mean is None and r.q_50 is None and r.ks is None
            continue
        assert abs(r.mean - sum(values) / len(values)) < 1e-9
        for q in audit.QUANTILES:
            exact = values[max(1, math.ceil(q * len(values))) - 1]
            assert abs(r[f"q_{q * 100:g}"] - exact) <= 0.5 / audit.BINS + 1e-9
        ks = max(
            abs(sum(v <= t for v in values) / len(values) - sum(v <= t for v in every) / len(every)) for t in every
        )
        assert abs(r.ks - ks) < 1e-12


def test_totals_of_more_digits_stay_within_half_a_bin(spark):
    values = sorted(random.Random(6).random() * 10 for _ in range(501))
    df = spark.createDataFrame([("r", v) for v in values], "role string, weighted_total double")
    row = audit.distributions(audit.score_bins(df, [], F.lit(False)), []).first()
    assert abs(row.q_50 - values[250]) <= 0.5 / audit.BINS and row.impact_ratio is None and row.ks == 0.0
