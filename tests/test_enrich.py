from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.frames import by_id, rows
from merchlens.functions import vocab
from merchlens.functions.text import cache_key, low_quality_text
from merchlens.operators import enrich, jobs, validate, weights

NOW = datetime(2024, 3, 1)


def test_cache_expires(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, sig_hash string")
    cache = spark.createDataFrame([("a", 5, datetime(2024, 2, 1)), ("b", 6, datetime(2024, 1, 30))], "sig_hash string, v int, updated_at timestamp")
    found = by_id(enrich.cache_lookup(items, cache, NOW), "hit", "v")
    assert found == {1: (True, 5), 2: (False, None), 3: (False, None)}
    assert sorted(by_id(enrich.cache_misses(items, cache, NOW), "sig_hash")) == [2, 3]


def test_cached_texts_are_judged_once_a_title(spark):
    items = spark.createDataFrame(
        [(i, "a", "lamp") for i in range(60)] + [(60, "a", "desk"), (61, "a", None), (62, "b", "lamp"), (63, None, "lamp")], "id long, sig_hash string, title string"
    )
    cache = spark.createDataFrame([("a", "lamp text", 1), ("b", None, 2), ("c", "lamp", 3)], "sig_hash string, body string, v int")
    calls = spark.sparkContext.accumulator(0)

    def judge(body, title):
        calls.add(1)
        return None if body is None else title is None or title in body

    good = F.udf(judge, "boolean").asNondeterministic()(F.col("body"), F.col("title"))
    plain = enrich.cache_lookup(items, cache, NOW, None, None, good)
    found = enrich.cache_lookup(items, cache, NOW, None, None, good, ["title"])
    assert found.columns == plain.columns
    rows = by_id(found, "hit", "v")
    assert calls.value <= 4
    assert rows == by_id(plain, "hit", "v")
    assert rows[0] == (True, 1) and rows[60] == (False, 1) and rows[61] == (True, 1) and rows[62] == (False, 2) and rows[63] == (False, None)


def test_cache_keys_are_stable(spark):
    import hashlib
    import json

    row = ("Lámpara \"mini\"\n", "a/b", None)
    df = spark.createDataFrame([row], "title string, category string, desc string")
    blob = json.dumps({"title": row[0], "category": row[1], "desc": ""}, sort_keys=True, ensure_ascii=False)
    got = df.select(cache_key("v1", title=F.col("title"), category=F.col("category"), desc=F.col("desc"))).first()[0]
    assert got == hashlib.sha256(f"v1::{blob}".encode()).hexdigest()


def test_text_quality(spark):
    good = "people want to feel calm at home and forget about noise " * 6
    cases = [(1, good, "Lamp"), (2, "short", "Lamp"), (3, good + " 30 ml", "x"), (4, good + " champú", "x"), (5, good, "calm home noise"), (6, good + " settle", "x")]
    df = spark.createDataFrame(cases, "id long, t string, title string")
    got = by_id(df.select("id", low_quality_text(F.col("t"), F.col("title")).alias("low")), "low")
    assert got == {1: False, 2: True, 3: True, 4: True, 5: True, 6: False}


def test_variants_by_title_and_parent(spark):
    df = spark.createDataFrame(
        [(3, "Lamp red XL", None, None), (1, "Lamp (blue)", None, "High"), (2, "LAMP 30 cm", "7", None), (4, "Box", "7", "Low"), (5, "lamp", None, "Medium")],
        "id long, title string, parent string, desire string",
    )
    assert by_id(enrich.propagate_variants(df, ["desire"], "parent"), "desire") == {1: "High", 2: None, 3: "High", 4: "Low", 5: "Medium"}


def test_triage_takes_the_first_readable_value(spark):
    df = spark.createDataFrame(
        [(1, "2,9", "5", None, None), (2, "n/a", "2", None, None), (3, None, None, "49", None), (4, "4", None, "50", "2022-08-01"), (5, "4", None, "50", "01/01/2024"), (6, None, None, None, None)],
        "id long, stars string, rating string, units string, launched string",
    )
    got = by_id(enrich.triage(df, date(2024, 3, 1), ["stars", "rating"], ["units"], ["launched"]), "low_priority")
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False}
    marked = enrich.skipped_by_triage(enrich.triage(df, date(2024, 3, 1), ["stars"], ["units"], ["launched"]), exhaustive=True)
    assert marked.where(F.col("state") == "failed").count() == 0


def test_batches(spark):
    df = spark.createDataFrame([(i * 3, "x" * i) for i in range(1, 8)], "id long, t string")
    got = rows(enrich.plan_batches(df, 3, F.length("t")), "batch_no", "items", "first_id", "est_tokens")
    assert got == [(0, 3, 3, 2), (1, 3, 12, 4), (2, 1, 21, 2)]
    assert enrich.batch_size(6000, 10) == 10 and enrich.batch_size(600, 10) == 30 and enrich.batch_size(0, 0, 12) == 12


def test_budget_stops_for_good_at_the_first_overflow(spark):
    queue = spark.createDataFrame([(1, True, 10), (2, False, 1000), (3, False, 5000), (4, False, 10)], "queue_no long, low_priority boolean, est_tokens long")

    def admitted(**kwargs):
        out = enrich.budget_admission(queue, **kwargs)
        return sorted(r["queue_no"] for r in out.where("admitted").collect())

    assert admitted(max_cost=20.0) == [2]  # batch 4 would fit, but the queue has ended
    assert admitted() == [2, 3, 4] and admitted(exhaustive=True) == [1, 2, 3, 4]
    assert admitted(max_requests=2) == [2, 3] and admitted(max_requests=3, exhaustive=True) == [2, 3, 4]


def test_results(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "item_id long, sig_hash string")
    results = spark.createDataFrame([(1, "250", "bad", " " + "r" * 130), (7, "1", "1", "")], "id long, desire string, awareness string, reason string")
    out = enrich.apply_results(items, results)
    got = {r["item_id"]: r for r in out.collect()}
    assert (got[1]["state"], got[1]["desire"], got[1]["awareness"], len(got[1]["reason"])) == ("enriched", 100, 0, 120)
    assert (got[2]["state"], got[2]["error"]) == ("failed", "missing_result")
    products = spark.createDataFrame([(5, "a", None, None), (6, "b", 3, None)], "id long, sig_hash string, desire long, completed_at timestamp")
    cache = spark.createDataFrame([("b", 1, 1, "old", datetime(2024, 1, 1))], "sig_hash string, desire long, awareness long, reason string, updated_at timestamp")
    after, cached = enrich.store_results(products, cache, out, F.lit(NOW))
    assert by_id(after, "desire", "completed_at") == {5: (100, NOW), 6: (3, None)}
    assert rows(cached, "sig_hash", "desire") == [("a", 100), ("b", 1)]


def test_confidence_and_states(spark):
    df = spark.createDataFrame([(1, 0.9, 0.1), (2, None, 0.7), (3, None, None), (4, 0.69, 1.0)], "id long, a double, t double")
    routed = enrich.route_by_confidence(df, F.col("a"), F.col("t"))
    assert by_id(routed, "accepted") == {1: True, 2: True, 3: False, 4: False}
    assert tuple(enrich.route_counts(routed).first()) == (2, 2)
    items = spark.createDataFrame([(1, "raw"), (2, "raw"), (3, "pending_enrich"), (4, "enriched")], "item_id long, state string")
    changes = spark.createDataFrame([(1, "pending_enrich"), (2, "enriched"), (3, "failed"), (4, "raw")], "item_id long, state string")
    assert rows(enrich.advance_state(items, changes), "item_id", "state") == [(1, "pending_enrich"), (2, "raw"), (3, "failed"), (4, "enriched")]


def line(pid, **fields):
    import json

    full = {"desire": "d", "desire_magnitude": 1, "awareness_level": "x", "competition_level": None}
    return json.dumps({"product_id": pid, **full, **fields})


def test_strict_validation(spark):
    good = [line(1), line(2)]
    batches = {
        1: good, 2: good[:1], 3: [line(1), "{broken"], 4: [line(1), '{"desire": 1}'], 5: [line(1), line(1)], 6: [line(1), '{"product_id": 2}'],
        7: [line(1), line(3)], 8: [" ", *good, ""], 9: [], 10: [line(1), "[1]"],
    }
    responses = spark.createDataFrame([(b, t) for b, ls in batches.items() for t in ls] or [], "batch_id long, line string")
    expected = spark.createDataFrame([(b, i) for b in batches for i in (1, 2)], "batch_id long, product_id long")
    got = {r["batch_id"]: r["reason"] for r in validate.validate_responses(responses, expected).collect()}
    assert got == {
        1: None, 2: "length", 3: "invalid_json", 4: "missing_product_id", 5: "duplicate_product_id", 6: "missing_field", 7: "id_set", 8: None,
        9: "length", 10: "invalid_json",
    }


def test_lenient_validation(spark):
    responses = spark.createDataFrame([(1, 1, line(1, desire="a")), (1, 2, "junk"), (1, 3, line(1, desire="b"))], "batch_id long, n long, line string")
    expected = spark.createDataFrame([(1, 1), (1, 2)], "batch_id long, product_id long")
    assert validate.readable_responses(responses, "n").first()["fields"]["desire"] == "b"
    assert rows(validate.missing_responses(responses, expected, "n")) == [(1, 2)]


def test_normalised_answers(spark):
    cases = [
        (1, "low", "10", "x kit", "33", "HIGH", "67", None), (2, "High", "90", None, "66.5", "low", "0", "1"), (3, "medium", "101", "d", "1", "low", "1", None),
        (4, "huge", "1", "d", "1", "low", "1", None), (5, "low", "11", "kit", "1", "low", "1", "2"),
    ]
    df = spark.createDataFrame(cases, "id long, aw string, aw_m string, d string, d_m string, c string, c_m string, confidence string")
    got = by_id(validate.normalise_responses(df.select(*df.columns)).drop("d"), "error", "desire", "desire_magnitude", "awareness_level", "competition_level")
    assert got[1] == (None, "x", "Low", "Unaware", "High") and got[2] == (None, "", "Medium", "Most Aware", "Low")
    assert [got[i][0] for i in (3, 4, 5)] == ["aw_m", "aw", "confidence"] and got[3][1:] == (None,) * 4
    strict = by_id(validate.normalise_responses(df, require_confidence=True), "error")
    assert strict[1] == "confidence" and strict[2] is None


# --- job metrics ------------------------------------------------------------------------


def test_status_and_eta(spark):
    items = spark.createDataFrame([(1, s) for s in ["enriched", "failed", "pending_enrich", "pending_enrich", "raw"]] + [(2, "raw")], "job_id long, state string")
    durations = spark.createDataFrame([(1, 4000.0)], "job_id long, total_duration_ms double")
    got = {r["job_id"]: (r["total"], r["processed"], r["queued"], r["eta_estimate"]) for r in jobs.job_status_counts(items, durations).collect()}
    assert got == {1: (5, 2, 2, 4.0), 2: (1, 0, 0, None)}


def test_latency_and_durations(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "s double")
    r = jobs.latency_summary(df, "s", 10.0).first()
    assert (r["requests"], r["p50"], r["p95"], r["total"], r["concurrency_eff"]) == (10, 5.5, pytest.approx(9.55), 55.0, 5.5)
    runs = spark.createDataFrame([(i, 5, 5.0 * i) for i in range(1, 31)] + [(31, 0, 1.0), (32, 600, 600.0)], "run_id long, total long, duration_ms double")
    got = {r["bucket"]: r["ms_per_item"] for r in jobs.duration_estimate(runs).collect()}
    assert got[10] == 18.0 and got[500] == 1.0 and got[25] == 2500.0  # the last 25 of 30 runs


@pytest.mark.parametrize(
    "reason, code",
    [
        (None, "ko.unknown"), ("  ", "ko.unknown"), ("no API key", "auth.missing_api_key"), ("budget", "quota.cost_cap_reached"), ("Error 429", "remote.rate_limited"),
        ("read timeout on connection", "remote.timeout"), ("DNS", "remote.network_error"), ("invalid JSON", "response.invalid_json"), ("invalid", "ko.unclassified"),
        ("missing id", "data.missing_ai_output"), ("HTTP 502", "remote.server_error"), ("404", "remote.not_found"),
    ],
)
def test_failure_codes(spark, reason, code):
    assert spark.createDataFrame([(reason,)], "r string").select(jobs.failure_code(F.col("r"))["code"]).first()[0] == code


def test_failure_samples_are_the_smallest_ids(spark):
    df = spark.createDataFrame([(i, "timeout") for i in range(9, 0, -1)], "id long, reason string")
    r = jobs.failure_summary(df).first()
    assert (r["count"], r["sample_ids"], r["retryable"]) == (9, [1, 2, 3, 4, 5], True)


def test_usage_cost_fallbacks(spark):
    df = spark.createDataFrame(
        [(1, 100, 50, None, None, None), (2, None, None, None, 30, 100), (3, None, None, 0, None, 80), (4, None, None, None, None, None)],
        "id long, prompt_tokens long, completion_tokens long, input_tokens long, tokens_in long, total_tokens long",
    )
    got = by_id(jobs.usage_cost(df, 10.0, 20.0), "tokens_in", "tokens_out")
    assert got == {1: (100, 50), 2: (30, 70), 3: (80, 0), 4: (0, 0)}


def test_stale_jobs(spark):
    df = spark.createDataFrame(
        [(1, "pending", datetime(2024, 2, 29, 23, 0)), (2, "pending", datetime(2024, 2, 29, 23, 1)), (3, "done", datetime(2020, 1, 1))], "id long, status string, created_at timestamp"
    ).withColumn("updated_at", F.col("created_at")).withColumn("error", F.lit(None).cast("string"))
    assert by_id(jobs.expire_stale_jobs(df, NOW, 60), "status", "error") == {1: ("error", "server restarted"), 2: ("pending", None), 3: ("done", None)}


# --- weights ----------------------------------------------------------------------------

PROFILE = "metric string, min double, max double, mean double, std double, p25 double, p50 double, p75 double, coverage double"


def test_low_coverage_caps_the_weight(spark):
    df = spark.createDataFrame([("revenue", 0.0, 100.0, 90.0, 1.0, 80.0, 95.0, 99.0, 0.2), ("rating", 0.0, 5.0, 4.0, 1.0, 3.0, 4.0, 5.0, 1.0)], PROFILE)
    got = {r["metric"]: r for r in weights.weights_from_profile(df).collect()}
    assert got["revenue"]["weight"] <= 15 and got["revenue"]["notes"] == ["revenue: cobertura baja (0.20)"] and got["rating"]["weight"] > 50
    assert len(got) == 8 and got["price"]["weight"] == 0 and got["price"]["notes"] == ["price: sin datos en agregados"]
    assert [r["metric"] for r in weights.weight_order(weights.weights_from_profile(df)).collect()] == ["rating", "revenue"]


def test_no_profile_gives_zero_weights(spark):
    got = weights.weights_from_profile(spark.createDataFrame([], PROFILE)).collect()
    assert len(got) == 8 and {r["weight"] for r in got} == {0}
    assert {tuple(r["notes"]) for r in got} == {("sin agregados: no se pueden fijar pesos sin inventar",)}


def test_shape_rules(spark):
    flat = ("p", 1.0, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 1.0)
    crowded = (0.0, 1.0, 0.9, None, None, 0.9, None, 1.0)
    df = spark.createDataFrame([("competition", *crowded), ("oldness", *crowded), ("units_sold", *flat[1:])], PROFILE)
    got = {r["metric"]: r for r in weights.weights_from_profile(df).collect()}
    assert got["competition"]["notes"] == ["competition: promedio alto, peso moderado"]
    # no position: strength 0.65 * 0.5 + 0.35 * 0.65
    assert got["units_sold"]["weight"] == round(74 * (0.6 + 0.8 * (0.325 + 0.35 * 0.65)))


def test_profile_of_missing_values(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), ("b", None, 2.0)], "seg string, x double, y double")
    got = {(r["seg"], r["metric"]): r for r in weights.profile_metrics(df, ["x", "y"], ["seg"]).collect()}
    assert len(got) == 4 and got[("a", "x")]["p50"] == 2.0 and got[("a", "y")]["coverage"] == 0 and got[("a", "y")]["p50"] is None
    assert got[("b", "y")]["coverage"] == 1.0 and got[("b", "y")]["std"] is None


def test_correlation_weights(spark):
    df = spark.createDataFrame([(float(i), float(-2 * i), 1.0, float(i * i)) for i in range(6)], "price double, rating double, desire double, t double")
    got = {r["feature"]: r["weight"] for r in weights.weights_by_correlation(df, ["price", "rating", "desire"], "t").collect()}
    assert got == {"price": 100, "rating": 100, "desire": 0}
    silent = df.withColumn("t", F.lit(1.0))
    assert {r["weight"] for r in weights.weights_by_correlation(silent, ["price", "desire"], "t").collect()} == {50}
    profile = {r["feature"]: r["weight"] for r in weights.weights_by_correlation(silent, ["price", "desire"], "t", "profile").collect()}
    assert profile == {"price": 55, "desire": 45}


def test_inverse_mean_weights(spark):
    sub = vocab.SUB_SCORES
    schema = "id long, product_id long, created_at string, " + ", ".join(f"{m} double" for m in sub)
    empty = spark.createDataFrame([], schema)
    assert {r["weight"] for r in weights.weights_inverse_mean(empty).collect()} == {1.0}
    df = spark.createDataFrame([(1, 1, "a", *[9.0] * 6), (2, 1, "b", 1.0, *[2.0] * 5)], schema)
    got = {r["metric"]: r["weight"] for r in weights.weights_inverse_mean(df).collect()}
    assert sum(got.values()) == pytest.approx(6) and got["momentum"] == pytest.approx(2 * got["margin"], rel=1e-4)


def test_samples_stick_to_the_first_success_metric(spark):
    products = spark.createDataFrame(
        [(1, {"gmv": "x"}), (2, {"sales": "5", "units": "1"}), (3, {"revenue": "9", "sales": "6"}), (4, {"units": "2"}), (5, {"sales": "7"})], "id long, extra map<string,string>"
    )
    full = {f: 3.0 for f in vocab.RUBRIC_FIELDS}
    scores = spark.createDataFrame(
        [(i, i, "d", full if i != 5 else {"escalabilidad": 1.0}) for i in range(1, 6)], "id long, product_id long, created_at string, breakdown map<string,double>"
    )
    assert weights.success_metric(products) == "sales"
    assert by_id(weights.weight_samples(products, scores), "success") == {2: 5.0, 3: 6.0, 4: 2.0}


def test_first_answered_member_speaks_for_later_variants(spark):
    df = spark.createDataFrame([(1, "Mug - red", None), (2, "Mug - red", "High"), (3, "Mug - red", None)], "id long, title string, desire string")
    assert by_id(enrich.propagate_variants(df, ["desire"]), "desire") == {1: None, 2: "High", 3: "High"}


def test_quoted_ids_are_no_ids(spark):
    fields = '"desire": "x", "desire_magnitude": "High", "awareness_level": "Unaware", "competition_level": "Low"'
    lines = spark.createDataFrame([(1, '{"product_id": "7", %s}' % fields), (2, '{"product_id": 7, %s}' % fields)], "batch_id long, line string")
    expected = spark.createDataFrame([(1, 7), (2, 7)], "batch_id long, product_id long")
    got = {r["batch_id"]: (r["valid"], r["reason"]) for r in validate.validate_responses(lines, expected).collect()}
    assert got == {1: (False, "id_set"), 2: (True, None)}
