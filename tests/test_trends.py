from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.frames import rows
from merchlens.functions.dates import period_bounds
from merchlens.operators import analytics, trends

SCHEMA = "id long, category string, price double, units double, revenue double, rating double, import_date timestamp"
MAY = (datetime(2024, 5, 1), datetime(2024, 6, 1))


def test_empty_period(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trends.trends_by_category(df, *MAY).count() == 0
    assert trends.trends_timeseries(df, *MAY).count() == 0
    total = trends.trends_totals(df, *MAY).first()
    assert total["unique_products"] == 0 and total["revenue"] == 0 and total["delta_revenue_pct"] == 0


def test_no_previous_period_means_no_change(spark):
    df = spark.createDataFrame([(1, "Cat/Sub", 10.0, 2.0, 20.0, 4.0, datetime(2024, 5, 3))], SCHEMA)
    r = trends.trends_by_category(df, *MAY).first()
    assert (r["category"], r["units"], r["revenue"], r["avg_rating"], r["delta_revenue_pct"]) == ("Cat/Sub", 2, 20, 4, 0)


def test_change_missing_revenue_and_half_open_bounds(spark):
    df = spark.createDataFrame(
        [
            (1, "A", 10.0, 3.0, None, None, datetime(2024, 5, 1)),
            (1, "A", None, 1.0, 20.0, 5.0, datetime(2024, 5, 31, 23, 59)),
            (2, "A", 99.0, 9.0, 9.0, 1.0, datetime(2024, 6, 1)),
            (3, "A", 1.0, 5.0, 25.0, 1.0, datetime(2024, 4, 30, 23)),
            (4, None, 1.0, 0.0, 0.0, None, datetime(2024, 5, 2)),
        ],
        SCHEMA,
    )
    got = {r["category"]: r for r in trends.trends_by_category(df, *MAY).collect()}
    assert got["A"]["unique_products"] == 1 and got["A"]["revenue"] == 50 and got["A"]["avg_price"] == 10
    assert got["A"]["delta_revenue_pct"] == pytest.approx(100.0) and got["A"]["rev_per_unit"] == 12.5
    assert got[""]["rev_per_unit"] == 0


def test_absurd_amounts_neither_fail_nor_vanish(spark):
    df = spark.createDataFrame(
        [(1, "A", 1e20, 1.0, 2e20, None, datetime(2024, 5, 2)), (2, "A", 1.0, 1.0, 0.1, None, datetime(2024, 5, 3)), (3, "B", 1.0, 1.0, 0.2, None, datetime(2024, 5, 3))], SCHEMA
    )
    got = {r["category"]: r["revenue"] for r in trends.trends_by_category(df, *MAY).collect()}
    assert got == {"A": 2e20, "B": 0.2} and trends.trends_totals(df, *MAY).first()["revenue"] == 2e20


def test_category_filter_covers_both_periods_unless_asked(spark):
    df = spark.createDataFrame(
        [
            (1, "Toys", 1.0, 1.0, 30.0, None, datetime(2024, 5, 2)),
            (2, "toys/x", 1.0, 1.0, 10.0, None, datetime(2024, 4, 2)),
            (3, "Home", 1.0, 1.0, 50.0, None, datetime(2024, 4, 3)),
        ],
        SCHEMA,
    )
    both = trends.trends_totals(df, *MAY, category_prefix="TOY").first()
    loose = trends.trends_totals(df, *MAY, category_prefix="TOY", compat_prev_unfiltered=True).first()
    assert both["delta_revenue_pct"] == pytest.approx(200.0) and loose["delta_revenue_pct"] == pytest.approx(-50.0)


def test_buckets(spark):
    df = spark.createDataFrame([(i, "A", 1.0, 1.0, 1.0, None, datetime(2024, 5, d)) for i, d in enumerate((5, 6, 12))], SCHEMA)
    days = rows(trends.trends_timeseries(df, *MAY), "date", "units")
    assert [d for d, _ in days] == [date(2024, 5, 5), date(2024, 5, 6), date(2024, 5, 12)]
    weeks = rows(trends.trends_timeseries(df, datetime(2024, 4, 1), datetime(2024, 6, 1)), "date", "units")
    assert weeks == [(date(2024, 4, 29), 1.0), (date(2024, 5, 6), 2.0)]


def test_period_defaults():
    today = date(2024, 5, 30)
    assert period_bounds(None, None, today) == (datetime(2024, 5, 1), datetime(2024, 5, 31))
    assert period_bounds(date(2024, 5, 1), None) == (datetime(2024, 5, 1), datetime(2024, 5, 31))
    assert period_bounds(date(2024, 5, 9), date(2024, 5, 2)) == (datetime(2024, 5, 2), datetime(2024, 5, 10))


def test_rows_from_extras(spark):
    df = spark.createDataFrame(
        [(1, "A", 2.0, {"units_sold": "3", "rating": "x"}, "2024-05-02"), (2, "A", 2.0, {"units_sold": "many"}, "2024-05-03")],
        "id long, category string, price double, extra map<string,string>, import_date string",
    )
    found = trends.trend_rows(df)
    assert found.where("bad_units").count() == 1
    assert trends.trends_totals(found, *MAY).first()["revenue"] == 6


CATALOGUE = "id long, name string, category string, price double, units_sold double, revenue double, rating double"


@pytest.fixture
def catalogue(spark):
    return spark.createDataFrame(
        [
            (1, "Acme Lámpara mini 🔥🔥", " Home ", 10.0, 5.0, 50.0, 4.0),
            (2, "Acme lámpara grande", "home", None, None, 70.0, None),
            (3, "The box", "", 30.0, 7.0, 900.0, 4.9),
            (4, "Bob's kit", "Toys", 20.0, 0.0, None, 4.7),
        ],
        CATALOGUE,
    )


def test_summary_and_rollup_average_differently(catalogue):
    summary = {r["category"]: r for r in analytics.category_summary(catalogue).collect()}
    assert set(summary) == {"Home", "Toys"} and summary["Home"]["avg_price"] == 10.0 and summary["Home"]["avg_revenue"] == 60
    rollup = {r["path"]: r for r in analytics.category_rollup_view(catalogue).collect()}
    assert rollup["home"]["price"] == 0 and rollup[" Home "]["rating"] == 4


def test_keywords_brands_kpis(catalogue):
    words = {r["keyword"]: r["count"] for r in analytics.top_keywords(catalogue).collect()}
    assert words["lámpara"] == 2 and "the" not in words and words["box"] == 1 and "mini" in words
    brands = {r["brand"]: r["count"] for r in analytics.top_brands(catalogue).collect()}
    assert brands == {"Acme": 2, "Bob": 1}
    k = analytics.kpis(catalogue).first()
    assert (k["total_revenue"], k["avg_price"], k["top_category"], k["top_product"]) == (1020.0, 20.0, "Home", "The box")


def _most_frequent_by_hand(values, top):
    counts = Counter(v for v in values if v is not None)
    return sorted(((v, n) for v, n in counts.items()), key=lambda r: (-r[1], r[0]))[:top]


def _values(df):
    return df.select("v")


@pytest.mark.parametrize("slots", [1, 7, 1 << 16])
@pytest.mark.parametrize("guess_rows", [0, 30, 5000])
def test_most_frequent_against_brute_force(spark, slots, guess_rows):
    """A hot value, many rare ones, ties at the border, NULL and empty; bad guesses and few slots change nothing."""
    values = [f"r{i}" for i in range(300)] + ["hot"] * 400 + [f"w{i % 40}" for i in range(900)] + [None] * 50 + [""] * 23
    df = spark.createDataFrame([(v,) for v in values], "v string").coalesce(3)
    for top in (0, 1, 20, 10_000):
        got = [(r["v"], r["count"]) for r in analytics.most_frequent(df, _values, top, slots, guess_rows).collect()]
        assert got == _most_frequent_by_hand(values, top), (slots, guess_rows, top)
    assert analytics.most_frequent(df.limit(0), _values, 5, slots, guess_rows).collect() == []


def test_most_frequent_counts_again_only_where_slots_are_full(spark):
    """A clear answer needs one scan; where slots reach it, their values are counted, filtered before the shuffle."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    values = [f"hot{i}" for i in range(6) for _ in range(100 - i)] + [f"r{i}" for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    clear = analytics.most_frequent(df, _values, 6, guess_rows=5000)
    mixed = analytics.most_frequent(df, _values, 6, slots=8, guess_rows=150)
    assert [tuple(r) for r in clear.collect()] == [tuple(r) for r in mixed.collect()] == _most_frequent_by_hand(values, 6)
    assert "Aggregate" not in plan(clear)
    assert plan(mixed).index("Aggregate") < plan(mixed).index("LeftSemi")


def test_pareto_is_relative_to_the_shown_rows(spark):
    df = spark.createDataFrame([(f"c{i:02}", float(i)) for i in range(20)], "path string, revenue double")
    out = analytics.pareto(df, top=4).collect()
    assert [r["path"] for r in out] == ["c19", "c18", "c17", "c16"]
    assert out[0]["cumulative_pct"] == pytest.approx(100 * 19 / 70) and out[-1]["cumulative_pct"] == pytest.approx(100)


def test_growth_reads_the_first_fitting_key(spark):
    df = spark.createDataFrame(
        [("a", {"Revenue Growth %": "n/a", "growth of revenue": "1,5%", "Unit growth": "$7"}), ("a", {"revenue growth": "2"}), ("b", {"revenue": "9"})],
        "category string, extra map<string,string>",
    )
    assert rows(analytics.growth_by_category(df)) == [("a", 17.0)]
    assert rows(analytics.growth_by_category(df, "units")) == [("a", 7.0)]


def test_sorting_puts_unreadable_last(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, "40"), (4, None), (5, "NaN")], "id long, v string")
    assert [r["id"] for r in analytics.sort_products(df, "v").collect()] == [1, 3, 2, 4, 5]
    assert [r["id"] for r in analytics.sort_products(df, "v", descending=True).collect()] == [3, 1, 2, 4, 5]


def test_insights_ignore_zeros_in_thresholds(spark):
    df = spark.createDataFrame(
        [(i, f"n{i}", "c", float(i), float(i), float(i), 5.0 if i > 8 else 0.0) for i in range(11)], CATALOGUE
    )
    out = {}
    for r in analytics.local_insights(df).collect():
        out.setdefault(r["block"], []).append(r["name"])
    assert out["top_revenue"] == ["n10", "n9", "n8"] and out["pricey_sellers"] == ["n8", "n9", "n10"]
    assert out["fan_favourites"] == ["n9", "n10"] and out["top_categories"] == ["c"]


def test_texts_are_sorted_as_in_a_dictionary_and_digits_by_value(spark):
    names = ["item 10", "item 9", "Item 09b", "árbol", "zeta", "Arbol 2", "ñu", "nube", "oso", None, "item 9a", "item 100000000000000000000"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = [r["name"] for r in analytics.sort_products(df, "name", numeric=False).collect()]
    assert got == ["árbol", "Arbol 2", "item 9", "item 9a", "Item 09b", "item 10", "item 100000000000000000000", "nube", "ñu", "oso", "zeta", None]
    down = [r["name"] for r in analytics.sort_products(df, "name", True, numeric=False).collect()]
    assert down == got[-2::-1] + [None]


def test_overview_has_categories_and_totals_from_one_scan(spark, tmp_path):
    rows = [(1, "A", 10.0, 2.0, 20.0, 4.0, "2024-05-03"), (2, "B", 5.0, 1.0, 5.0, None, "2024-05-04"), (2, "A", 5.0, 1.0, 6.0, 3.0, "2024-05-04"), (3, "C", 1.0, 1.0, 9.0, 1.0, "2024-04-20")]
    df = spark.createDataFrame(rows, "id long, category string, price double, units double, revenue double, rating double, d string").withColumn("import_date", F.to_timestamp("d"))
    df.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    period = datetime(2024, 5, 1), datetime(2024, 6, 1)
    got = trends.trends_overview(df, *period)
    shared = ["unique_products", "units", "revenue", "avg_price", "avg_rating", "rev_per_unit", "delta_revenue_pct"]
    total = got.where("is_total").select(*shared, "delta_units_pct").collect()
    assert total == trends.trends_totals(df, *period).collect() and total[0]["delta_units_pct"] == 300
    per_category = got.where("NOT is_total").orderBy(F.desc("revenue"), "category").select("category", *shared).collect()
    assert per_category == trends.trends_by_category(df, *period).collect()
    assert got._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert trends.trends_overview(df.limit(0), *period).count() == 0
