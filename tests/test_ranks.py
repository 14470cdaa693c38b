import bisect
import random

import pytest
from pyspark.sql import functions as F

from tests.frames import by_id
from merchlens.operators import ranks


def linear(values, q):
    ordered = sorted(values)
    pos = (len(ordered) - 1) * q
    low = int(pos)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (pos - low)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows shares one value, a third of them one group."""
    rng = random.Random(7)
    data = []
    for i in range(3000):
        value = 5.0 if i % 3 == 0 else rng.choice([rng.random() * 10, float(rng.randint(0, 9))])
        group = "hot" if rng.random() < 0.34 else rng.choice("abcdef")
        data.append((i, group, value if i % 50 else None))
    return data, spark.createDataFrame(data, "id long, g string, v double").cache()


def test_quantiles_match_a_sort(skewed):
    data, df = skewed
    values = [v for _, _, v in data if v is not None]
    probs = {"a": 0.0, "b": 0.25, "c": 1 / 3, "d": 0.5, "e": 0.95, "f": 1.0}
    got = ranks.quantile_values(df, "v", probs)
    for name, q in probs.items():
        assert got[name] == pytest.approx(linear(values, q))
    floors = ranks.quantile_values(df, "v", probs, method="floor")
    for name, q in probs.items():
        assert floors[name] == sorted(values)[int((len(values) - 1) * q)]


def test_grouped_quantiles(skewed):
    data, df = skewed
    for r in ranks.exact_quantiles(df, "v", {"m": 0.5, "h": 0.9}, ["g"]).collect():
        values = [v for _, g, v in data if g == r["g"] and v is not None]
        assert r["n"] == len(values)
        assert r["m"] == pytest.approx(linear(values, 0.5)) and r["h"] == pytest.approx(linear(values, 0.9))


def test_pct_rank_inside_and_outside_the_population(skewed, spark):
    data, df = skewed
    values = sorted(v for _, _, v in data if v is not None)
    got = by_id(ranks.pct_rank(df, "v", "p"), "p")
    for i, _, v in data:
        want = None if v is None else bisect.bisect_left(values, v) / (len(values) - 1)
        assert got[i] == (want if want is None else pytest.approx(want))
    probes = spark.createDataFrame([(1, -5.0), (2, 5.0), (3, 99.0), (4, None)], "id long, v double")
    got = by_id(ranks.pct_rank(probes, "v", "p", df), "p")
    n = len(values)
    assert got[1] == 0 and got[2] == pytest.approx(bisect.bisect_left(values, 5.0) / (n - 1))
    assert got[3] == pytest.approx(n / (n - 1)) and got[4] is None  # above one outside the population


def test_rank_percentile_ties_lone_and_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 3.0), (5, None)], "id long, v double")
    assert by_id(ranks.rank_percentile(df, "v", "p"), "p") == {1: 0.0, 2: 0.5, 3: 0.5, 4: 1.0, 5: 0.5}
    lone = spark.createDataFrame([(1, 7.0), (2, None)], "id long, v double")
    assert by_id(ranks.rank_percentile(lone, "v", "p"), "p") == {1: 1.0, 2: 0.5}


def test_row_numbers_and_unique_numbers(skewed):
    data, df = skewed
    known = df.where(F.col("v").isNotNull())
    order = sorted((v, i) for i, _, v in data if v is not None)
    want = {i: place for place, (_, i) in enumerate(order, start=1)}
    assert by_id(ranks.row_numbers(known, "v", "id", "p"), "p") == want
    assert by_id(ranks.number_by_unique(df, "id", "p"), "p") == {i: i for i in range(3000)}


@pytest.mark.parametrize("k", [1, 7, 400, 1100, 2999, 5000])
def test_smallest_with_text_ties(skewed, k):
    data, df = skewed
    work = df.where(F.col("v").isNotNull()).withColumn("t", F.col("id").cast("string"))
    cutoff = ranks.smallest(work, "v", "t", k)
    got = {r["id"] for r in work.where(cutoff.admits(F.col("v"), F.col("t"))).collect()}
    want = sorted((v, str(i)) for i, _, v in data if v is not None)[:k]
    assert got == {int(i) for _, i in want}


def test_smallest_of_nothing(spark):
    empty = spark.createDataFrame([], "v double, t string")
    assert ranks.smallest(empty, "v", "t", 3) is None and ranks.smallest(empty, "v", "t", 0) is None


def test_fill_by_rank(spark):
    df = spark.createDataFrame(
        [(1, 1200, 4.8, 80), (2, 80, 4.1, 65), (3, 500, 4.5, None)], "id long, units_sold long, rating double, m int"
    )
    assert by_id(ranks.fill_by_rank(df, "m"), "m") == {1: 80, 2: 65, 3: 50}


def test_text_range_key_never_falls(spark):
    words = sorted(["", "1", "10", "100", "2", "29", "3", "z", "é", "abc", "abcdefgh"], key=lambda w: w.encode())
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, w string")
    keys = by_id(df.select("id", ranks.text_range_key(F.col("w")).alias("k")), "k")
    assert [keys[i] for i in range(len(words))] == sorted(keys.values())


@pytest.mark.parametrize("prefix", ["", "item-0000000-"])
def test_nth_text_goes_on_behind_a_common_prefix(spark, prefix):
    words = [prefix + w for w in ("", "\0", "1", "10", "10", "2", "29", "é", "abcdefgh", "abcdefgi")]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "w string")
    ordered = sorted(words, key=lambda w: w.encode())
    assert [ranks.nth_text(df, "w", k) for k in (1, 2, 5, 8, 10, 99)] == [ordered[i] for i in (0, 1, 4, 7, 9, 9)]
