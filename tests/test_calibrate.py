import random
from math import ceil

import pytest

from tests.frames import by_id
from merchlens.operators import calibrate


def brute_force(pairs, q33, q67, shares):
    """Labels by limits, then one row moved at a time."""
    labels = {i: "Low" if s <= q33 else "High" if s >= q67 else "Medium" for i, s in pairs}
    n, scores = len(pairs), dict(pairs)

    def count(name):
        return sum(1 for v in labels.values() if v == name)

    def move_one(source, centre, target):
        nearest = min((abs(scores[i] - centre), str(i), i) for i in labels if source(labels[i]))
        labels[nearest[2]] = target

    floor = ceil(shares.medium * n)
    while count("Medium") < floor and any(v != "Medium" for v in labels.values()):
        move_one(lambda v: v != "Medium", 0.5, "Medium")
    for name, centre, share in (("Low", q33, shares.low), ("High", q67, shares.high)):
        while count(name) < ceil(share * n) and count("Medium") > floor:
            move_one(lambda v: v == "Medium", centre, name)
    return labels


@pytest.mark.parametrize("seed", range(4))
def test_minimum_shares_match_moving_one_by_one(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, round(rng.choice([0.1, 0.9, 0.9, rng.random()]), 2)) for i in range(120)]
    shares = calibrate.Shares(rng.choice([0.05, 0.4]), rng.choice([0.05, 0.3, 0.6]), rng.choice([0.05, 0.35]))
    df = spark.createDataFrame(pairs, "id long, score double")
    got = calibrate.classify_with_thresholds(df, "score", calibrate.Thresholds(0.15, 0.85), shares)
    assert by_id(got, "label") == brute_force(pairs, 0.15, 0.85, shares)


def test_terciles_are_winsorised_from_fifty_rows(spark):
    pairs = [(i, float(i)) for i in range(100)]
    fitted = calibrate.fit_terciles(spark.createDataFrame(pairs, "id long, score double"), "score")
    assert fitted.winsor == (pytest.approx(4.95), pytest.approx(94.05))
    assert fitted.q33 == pytest.approx(33.0) and fitted.q67 == pytest.approx(66.0) and not fitted.by_rank
    few = calibrate.fit_terciles(spark.createDataFrame(pairs[:49], "id long, score double"), "score")
    assert few.winsor is None


def test_few_or_flat_scores_are_split_by_rank(spark):
    few = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.5), (4, 0.4)], "id long, score double")
    fitted = calibrate.fit_terciles(few, "score")
    assert fitted.by_rank
    assert by_id(calibrate.classify_terciles(few, "score", fitted), "label") == {2: "Low", 4: "Medium", 3: "Medium", 1: "High"}
    flat = spark.createDataFrame([(i, 0.5) for i in range(9)], "id long, score double")
    labels = by_id(calibrate.classify_terciles(flat, "score", calibrate.fit_terciles(flat, "score")), "label")
    assert [labels[i] for i in range(9)] == ["Low"] * 3 + ["Medium"] * 3 + ["High"] * 3


def test_no_scores(spark):
    empty = spark.createDataFrame([], "id long, score double")
    assert calibrate.fit_terciles(empty, "score") is None
    assert calibrate.calibrate(empty, "score").count() == 0


def test_stored_thresholds(spark):
    table = spark.createDataFrame(
        [("desire", 3, "m", 0.2, 0.8), ("desire", 4, "m", 0.1, 0.9), ("competition", 3, "m", 0.3, 0.6)],
        "measure string, weights_version int, model string, q33 double, q67 double",
    )
    got = calibrate.load_thresholds(table, 3, "m")
    assert got == {"desire": calibrate.Thresholds(0.2, 0.8), "competition": calibrate.Thresholds(0.3, 0.6)}


def test_demand_needs_every_input_to_be_high(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 0.1, 3.0), (2, 50.0, 0.5, 5.0), (3, 100.0, 0.9, None), (4, 120.0, 0.95, 5.0)],
        "id long, units_sold double, conversion_rate double, rating double",
    )
    assert by_id(calibrate.demand_baseline(df), "demand") == {1: "Low", 2: "Medium", 3: "Medium", 4: "High"}


def test_competition_and_reconciliation(spark):
    df = spark.createDataFrame([(i, "A > x") for i in range(5)] + [(9, "B"), (10, "C"), (11, "C")], "id long, category string")
    similar = spark.createDataFrame([(0, 1), (9, 2), (10, 8)], "id long, similar_at_least long")
    got = by_id(calibrate.competition_baseline(df, similar), "competition")
    assert got[0] == "High" and got[9] == "Low" and got[10] == "High" and got[11] == "Medium"
    labels = spark.createDataFrame([(1, "ALTA", "Low", "baja", "Medium"), (2, None, "High", "High", "Low")], "id long, d string, db string, c string, cb string")
    out = calibrate.reconcile_labels(labels, "d", "db", "c", "cb")
    assert by_id(out, "demand_final", "competition_final") == {1: ("Low", "Medium"), 2: ("Medium", "High")}
