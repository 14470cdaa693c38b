from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests.frames import by_id
from merchlens.operators import scoring
from merchlens.operators.ranks import apportion

TODAY = date(2024, 6, 1)
FLAT = {f: 50 for f in ("price", "rating", "units_sold", "revenue", "desire", "competition", "awareness")}


def config(weights, **kwargs):
    return scoring.ScoreConfig({**FLAT, **weights}, as_of=TODAY, **kwargs)


@pytest.fixture
def aged(spark):
    return spark.createDataFrame(
        [(1, str(TODAY - timedelta(days=200))), (2, str(TODAY - timedelta(days=10)))], "id long, first_seen string"
    )


def test_oldness_slider_sets_direction(aged):
    old = by_id(scoring.winner_score(aged, config({"oldness": 100})), "score_raw")
    new = by_id(scoring.winner_score(aged, config({"oldness": 0})), "score_raw")
    none = by_id(scoring.winner_score(aged, config({"oldness": 50})), "score_raw")
    assert old[1] > old[2] and new[1] < new[2] and none[1] == none[2]


def test_equal_ages_are_neutral(spark):
    df = spark.createDataFrame([(1, "2024-05-01"), (2, "2024-05-01")], "id long, first_seen string")
    only_age = {f: 0 for f in FLAT} | {"oldness": 100, "awareness": 0}
    scores = by_id(scoring.winner_score(df, config(only_age)), "score_raw")
    assert scores[1] == pytest.approx(50.0) and scores[2] == pytest.approx(50.0)


def test_missing_dates_have_no_age(spark):
    df = spark.createDataFrame([(1, None), (2, "2024-05-22")], "id long, first_seen string")
    bounds = scoring.oldness_bounds(df, TODAY).first()
    assert (bounds["min_age"], bounds["max_age"]) == (10, 10)
    assert "oldness" in by_id(scoring.explain_score(df, config({"oldness": 100})), "missing")[1]


def test_date_range_comes_before_first_seen(spark):
    df = spark.createDataFrame([(1, "2024-05-02~2024-05-30", "2024-01-01")], "id long, date_range string, first_seen string")
    assert scoring.oldness_bounds(df, TODAY).first()["max_age"] == 30


def test_order_changes_effective_weights(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0)], "id long, price double, rating double")
    base = {f: 0 for f in FLAT} | {"price": 50, "rating": 50, "oldness": 50}
    first_price = scoring.ScoreConfig(base, ["price", "rating"], as_of=TODAY)
    first_rating = scoring.ScoreConfig(base, ["rating", "price"], as_of=TODAY)
    a = scoring.winner_score(df, first_price).first()["score_raw"]
    b = scoring.winner_score(df, first_rating).first()["score_raw"]
    # eight ranks: the first place weighs 8, the second 7
    assert first_price.effective_weights()["price"] == pytest.approx(8 / 15)
    assert a == pytest.approx(100 * (8 / 15 * 0.01 + 7 / 15)) and b > a


def test_disabled_weight_is_zero_but_keeps_its_place():
    base = {f: 0 for f in FLAT} | {"price": 50, "rating": 50, "oldness": 50}
    cfg = scoring.ScoreConfig(base, ["price", "rating"], {"price": False}, TODAY)
    assert cfg.effective_weights()["price"] == 0 and cfg.effective_weights()["rating"] == 1


def test_awareness_closeness(spark):
    df = spark.createDataFrame(
        [(1, "unaware"), (2, "Most-Aware"), (3, "nonsense"), (4, None)], "id long, awareness_level string"
    )
    only = {f: 0 for f in FLAT} | {"awareness": 100, "oldness": 50}
    high = by_id(scoring.winner_score(df, config(only)), "score")
    assert high == {1: 0, 2: 88, 3: 38, 4: 38}
    stages = by_id(df.select("id", scoring.awareness_stage(df).alias("s")), "s")
    assert stages == {1: 0, 2: 4, 3: 2, 4: 2}


def test_features_fall_back_to_extras(spark):
    df = spark.createDataFrame(
        [(1, None, {"price": "500", "Product Rating": "2.5", "ai_desire_score": "80", "competition_level": "High"}), (2, 1000.0, {"rating": "bad"})],
        "id long, price double, extra map<string,string>",
    )
    f = scoring.features(df, TODAY)
    got = by_id(df.select("id", *[c.alias(n) for n, c in f.items()]), "price", "rating", "desire", "competition")
    assert got == {1: (500.0, 2.5, 0.8, 0.2), 2: (1000.0, None, None, None)}


def test_rescoring_some_leaves_the_rest(spark):
    df = spark.createDataFrame([(i, {"rating": "4.5"}, 1) for i in range(1, 9)], "id long, extra map<string,string>, winner_score int")
    scored = scoring.score_catalog(df, config({"oldness": 50}), ids=[1, 2, 3, 4, 5])
    counts = scoring.score_counts(scored).first()
    assert (counts["processed"], counts["updated"]) == (5, 5)
    again = scored.select("id", "extra", F.col("score").cast("int").alias("winner_score"), F.col("score_raw").alias("winner_score_raw"))
    second = scoring.score_catalog(again, config({"oldness": 50}))
    assert second.where("changed").count() == 0


def test_explain_lists_what_counts(spark):
    df = spark.createDataFrame([(1, 10.0)], "id long, price double")
    row = scoring.explain_score(df, config({"oldness": 50})).first()
    assert row["present"] == ["price", "awareness"] and "rating" in row["missing"]


def test_fingerprints_follow_the_weights():
    a, b = config({"oldness": 50}), config({"oldness": 51})
    assert a.fingerprints() != b.fingerprints() and len(a.fingerprints()["weights_all"]) == 8


def test_largest_remainder(spark):
    weights = {"price": 0.35, "rating": 0.25, "units_sold": 0.15, "revenue": 0.15, "desire": 0.07, "competition": 0.03}
    df = spark.createDataFrame([("g", k, v) for k, v in weights.items()], "g string, key string, value double")
    got = {r["key"]: r["share"] for r in apportion(df, ["g"]).collect()}
    assert got == {"price": 35, "rating": 25, "units_sold": 15, "revenue": 15, "desire": 7, "competition": 3}


def test_apportion_ties_and_zero_totals(spark):
    df = spark.createDataFrame(
        [("thirds", k, 1.0) for k in "abc"] + [("none", k, 0.0) for k in "abcdef"] + [("one", "a", 5.0), ("one", "b", -3.0)],
        "g string, key string, value double",
    )
    got = {(r["g"], r["key"]): r["share"] for r in apportion(df, ["g"]).collect()}
    assert [got[("thirds", k)] for k in "abc"] == [33, 33, 34]  # the larger key gets the rest
    assert [got[("none", k)] for k in "abcdef"] == [17, 17, 17, 17, 16, 16]  # smaller keys first
    assert got[("one", "a")] == 100 and got[("one", "b")] == 0


@pytest.mark.parametrize("scale", [1e-300, 4e-7, 1.0, 3e40])
def test_apportion_without_groups_sums_to_100_at_any_scale(spark, scale):
    values = [("a", 1.5), ("b", 1.5), (None, 1.0), ("d", None), ("e", float("inf")), ("f", float("nan"))]
    df = spark.createDataFrame([(k, v and v * scale) for k, v in values], "key string, value double")
    got = {r["key"]: r["share"] for r in apportion(df).collect()}
    assert got == {"a": 37, "b": 38, None: 25, "d": 0, "e": 0, "f": 0}


def test_apportion_falls_back_to_earlier_shares(spark):
    df = spark.createDataFrame(
        [("old", "a", 0.0, 70.9), ("old", "b", None, None), ("new", "a", 1.0, 3.0), ("new", "b", 1.0, None),
         ("bare", "a", 0.0, None), ("bare", "b", -1.0, None)],
        "g string, key string, value double, before double",
    )
    got = {(r["g"], r["key"]): r["share"] for r in apportion(df, ["g"], previous="before").collect()}
    assert got == {("old", "a"): 70, ("old", "b"): 0, ("new", "a"): 50, ("new", "b"): 50, ("bare", "a"): 50, ("bare", "b"): 50}


def test_apportion_keeps_rows_without_a_group(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (None, "b", 3.0), ("g", "a", 2.0)], "g string, key string, value double")
    got = {(r["g"], r["key"]): r["share"] for r in apportion(df, ["g"]).collect()}
    assert got == {(None, "a"): 25, (None, "b"): 75, ("g", "a"): 100}


def test_metric_score_renormalises_over_known(spark):
    df = spark.createDataFrame(
        [(1, "High", 0.0), (2, "Low", None), (3, None, None)], "id long, magnitud_deseo string, recencia_lanzamiento double"
    )
    got = by_id(scoring.metric_score(df, {"magnitud_deseo": 1.0, "recencia_lanzamiento": 3.0, "escalabilidad": 2.0}, {}), "metric_score")
    assert got == {1: pytest.approx(1.0), 2: pytest.approx(0.33), 3: None}


def test_rubric_and_rescale(spark):
    df = spark.createDataFrame([(1, "9", None), (2, "x", 1)], "id long, magnitud_deseo string, escalabilidad int")
    got = by_id(scoring.rubric_score(df, {"magnitud_deseo": 0.5, "escalabilidad": 0.5}), "rubric_pct")
    assert got == {1: 75.0, 2: 25.0}  # (5 + 3) / 2 and (3 + 1) / 2
    metrics = spark.createDataFrame([(1, 10.0, 5.0), (2, 20.0, 5.0)], "id long, orders double, sellers double")
    out = scoring.metric_rescale(metrics, scoring.metric_bounds(metrics, ["orders", "sellers"]))
    assert by_id(out, "magnitud_deseo", "saturacion_mercado") == {1: (1, 3), 2: (5, 3)}


def test_extras_replace_dates_and_any_numeric_stage_counts(spark):
    df = spark.createDataFrame([(1, "2022-01-01", {"first_seen": "2023-12-01"}, None, 4)], "id long, first_seen string, extra map<string,string>, awareness_type string, awareness_level int")
    row = df.select(scoring.age_days(df, date(2024, 1, 1)).alias("age"), scoring.awareness_stage(df).alias("stage")).first()
    assert (row["age"], row["stage"]) == (31, 4)


def test_extras_replace_dates_also_when_empty_or_unreadable(spark):
    rows = [
        (1, "2024-01-01~2024-02-01", "2023-06-01", {"date_range": ""}), (2, "2024-01-01~2024-02-01", "2023-06-01", {"date_range": "soon"}),
        (3, "2024-01-01~2024-02-01", "2023-06-01", {"first_seen": "2020-01-01"}), (4, None, "2023-06-01", {"first_seen": None}),
        (5, None, "2023-06-01", None), (6, "", None, {"Date Range": " 2024-02-01 ~ x"}),
    ]
    df = spark.createDataFrame(rows, "id long, date_range string, first_seen string, extra map<string,string>")
    got = by_id(df.select("id", scoring.age_days(df, date(2024, 3, 1)).alias("age")), "age")
    assert got == {1: 274, 2: 274, 3: 60, 4: None, 5: 274, 6: 29}
