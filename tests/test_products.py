from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.frames import by_id, rows
from merchlens.functions import vocab
from merchlens.operators import filters, imports, latest, lists, merge, scoring


def test_id_queries():
    assert filters.parse_id_query(" 3-5, 9,x, 8 - 7,,") == [(3, 5), (9, 9), (7, 8)]
    assert filters.parse_id_query(None) == []


def test_select_ids_short_long_and_empty(spark):
    df = spark.range(5000)
    assert filters.select_ids(df, [1, 1, 4999, 9999]).count() == 2
    assert filters.select_ids(df, list(range(2000))).count() == 2000
    assert filters.select_ids(df, spark.range(3)).count() == 3
    assert filters.select_ids(df, []).count() == 5000 and filters.select_ids(df, [], empty_means_all=False).count() == 0


COLUMNS = "id long, category string, price double, launch_date date, awareness_level string, winner_score int"


@pytest.fixture
def shop(spark):
    d = datetime(2024, 5, 5).date()
    return spark.createDataFrame(
        [(1, "Home > Lamp", 5.0, d, "Problem-Aware", 85), (2, None, None, None, None, 60), (3, "Toys", 9.0, None, "problem aware", 10)], COLUMNS
    )


@pytest.mark.parametrize(
    "want, ids",
    [
        (filters.ProductFilter(), [1, 2, 3]),
        (filters.ProductFilter(category="HOME"), [1]),
        (filters.ProductFilter(price=(5.0, None)), [1, 3]),
        (filters.ProductFilter(price=(None, 5.0)), [1]),
        (filters.ProductFilter(awareness_level="problem-aware"), [1, 3]),
        (filters.ProductFilter(ids=[(2, 3)], winner_score=(0, 50)), [3]),
        (filters.ProductFilter(launched=("2024-05-05", "2024-05-05")), [1]),
    ],
)
def test_filters(shop, want, ids):
    assert sorted(by_id(filters.filter_products(shop, want), "price")) == ids


def test_lenient_dates_let_undated_rows_pass(shop):
    want = filters.ProductFilter(launched=("2024-06-01", None))
    assert sorted(by_id(filters.filter_products(shop, want, lenient_dates=True), "price")) == [2, 3]


def test_bands(shop):
    assert by_id(shop.select("id", filters.score_band(F.col("winner_score")).alias("b")), "b") == {1: "green", 2: "amber", 3: "red"}


def test_missing_enrichment_modes(spark):
    df = spark.createDataFrame(
        [(1, "a", "d", "Low", "Unaware", "Low", "2024"), (2, "b", "", "Low", "Unaware", "Low", "2024"), (3, "", None, None, None, None, None), (4, "c", "d", "Low", "Unaware", "Low", None)],
        "id long, name string, desire string, desire_magnitude string, awareness_level string, competition_level string, completed_at string",
    )
    assert sorted(by_id(filters.missing_enrichment(df), "name")) == [2, 3]
    assert [r["id"] for r in filters.missing_enrichment(df, "incomplete", 1).collect()] == [4]
    assert sorted(by_id(filters.missing_enrichment(df, "candidate"), "name")) == [2, 4]


def test_updates_replace_or_keep(spark):
    products = spark.createDataFrame([(1, "old", "Low", None), (2, "old", "High", None)], "id long, desire string, desire_magnitude string, completed_at timestamp")
    updates = spark.createDataFrame([(1, None, "enormous", "x"), (9, "new", "Low", "y")], "id long, desire string, desire_magnitude string, other string")
    stamp = F.lit(datetime(2024, 1, 1))
    replaced = by_id(filters.update_columns(products, updates), "desire", "desire_magnitude")
    assert replaced == {1: (None, None), 2: ("old", "High")}
    kept = by_id(filters.update_columns(products, updates, "coalesce", stamp), "desire", "desire_magnitude", "completed_at")
    assert kept == {1: ("old", "Low", datetime(2024, 1, 1)), 2: ("old", "High", None)}


def test_delete_cascades(spark):
    products, doomed = spark.range(3), spark.createDataFrame([(1,), (1,)], "id long")
    linked = spark.createDataFrame([(1, 5), (2, 5)], "product_id long, list_id long")
    a, b, c = filters.delete_products(doomed, products, linked, linked)
    assert (a.count(), b.count(), c.count()) == (2, 1, 1)


def test_served_rows_follow_the_fallback_chains(spark):
    extra = {"units_sold": "3", "rating": "4", "Product Rating": "keep", "DATERANGE": "no", "First seen": "2024-01-02T00", "last_SEEN": "2024-02-03"}
    df = spark.createDataFrame(
        [(1, "Lamp 🔥", "c", 2.675, " ", "Low", None, "Unaware", None, 0, 7, extra)],
        "id long, name string, category string, price double, desire string, desire_magnitude string, awareness_level string, ai_awareness_level string, competition_level string, winner_score int, ai_winner_score int, extra map<string,string>",
    )
    r = filters.serve_products(df).first()
    assert (r["name"], r["desire"], r["awareness_level"], r["winner_score"]) == ("Lamp", None, "Unaware", 7)
    assert r["date_range"] == "no" and r["first_seen"] == "2024-01-02T00"
    assert r["extras"]["Item Sold"] == "3" and r["extras"]["Product Rating"] == "keep"
    other = df.withColumn("extra", F.map_filter("extra", lambda k, _: k != "DATERANGE"))
    assert filters.serve_products(other).first()["date_range"] == "2024-01-02—2024-02-03"


# --- lists ------------------------------------------------------------------------------


@pytest.fixture
def groups(spark):
    names = spark.createDataFrame([(1, "todos"), (2, "b"), (3, "a"), (4, "empty")], "id long, name string")
    members = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11)], "list_id long, product_id long")
    return names, members


def test_counts_include_empty_lists(groups):
    assert [(r["name"], r["count"]) for r in lists.list_counts(*groups).collect()] == [("a", 1), ("b", 2), ("empty", 0), ("todos", 1)]


def test_moving_members(groups):
    kept, members, moved = lists.move_list_members(*groups, 2, 3)
    assert rows(kept, "id") == [(1,), (3,), (4,)] and rows(members) == [(1, 10), (3, 10), (3, 11)] and moved.first()[0] == 1
    _, members, gone = lists.move_list_members(*groups, 2, None)
    assert rows(members) == [(1, 10), (3, 11)] and gone.first()[0] == 2
    for source, target in ((1, 3), (9, 3), (2, 2), (2, 9)):
        with pytest.raises(ValueError):
            lists.move_list_members(*groups, source, target)


def test_members_are_added_once(spark, groups):
    new = spark.createDataFrame([(2, 10), (4, 12)], "list_id long, product_id long")
    grown = lists.add_list_members(groups[1], new)
    assert grown.count() == 5 and lists.remove_list_members(grown, new).count() == 3


def test_lookups(spark):
    products = spark.createDataFrame([(5, "Lamp", "s1"), (3, "LAMP", "s2"), (4, "Box", "s1")], "id long, name string, sig_hash string")
    wanted = spark.createDataFrame([("lamp",), ("none",)], "name string")
    assert rows(lists.find_by_name(products, wanted)) == [("lamp", 3)]
    items = spark.createDataFrame([(1, "s1"), (1, "s1"), (2, "s2")], "job_id long, sig_hash string")
    assert rows(lists.job_products(products, items, 1)) == [(4,), (5,)]


def test_latest_and_comparison(spark):
    sub = ["total_score", "momentum", "saturation", "differentiation", "social_proof", "margin", "logistics"]
    scores = spark.createDataFrame(
        [(1, 1, "2024-01-01", *[1.0] * 7), (2, 1, "2024-02-01", *[2.0] * 7), (3, 1, "2024-02-01", *[3.0] * 7), (4, 2, "2023-01-01", *[9.0] * 7)],
        "id long, product_id long, created_at string, " + ", ".join(f"{c} double" for c in sub),
    )
    products = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert by_id(latest.attach_latest_score(products, scores, ["total_score"]), "total_score") == {1: 3.0, 2: 9.0, 3: None}
    table = {r["metric"]: (r["p1"], r["p2"], r["p3"]) for r in lists.compare_products(products, scores, [1, 2, 3]).collect()}
    assert len(table) == 7 and table["margin"] == (3.0, 9.0, None)


# --- merging ----------------------------------------------------------------------------

STAGED = "sig_hash string, name string, price double, winner_score int, seq long"


def test_last_staged_row_wins_then_merges(spark):
    old = spark.createDataFrame([("a", "A", 1.0, 50), ("b", "B", 2.0, 60)], "sig_hash string, name string, price double, winner_score int")
    staged = spark.createDataFrame([("a", "first", 9.0, 1, 1), ("a", "last", None, None, 2), ("c", "C", 3.0, None, 3)], STAGED)
    assert rows(merge.upsert_products(old, staged)) == [("a", "last", None, 50), ("b", "B", 2.0, 60), ("c", "C", 3.0, 0)]


def test_changes_read_like_merges_one_after_another(spark, tmp_path):
    root = str(tmp_path / "t")
    assert merge.read_merged(spark, root) is None
    base = spark.createDataFrame([("a", "A", 1.0, 50), ("b", "B", 2.0, 60)], "sig_hash string, name string, price double, winner_score int")
    merge.append_changes(base, root, "base")
    want = base
    batches = [[("a", "A2", None, None, 1), ("c", "C", 3.0, None, 2)], [("a", "A3", 5.0, 7, 1), ("c", "C2", 4.0, None, 2)], [("a", "A4", 6.0, None, 1)]]
    keep = {"winner_score": 0}
    for number, batch in enumerate(batches):
        staged = spark.createDataFrame(batch, STAGED)
        for _ in range(2):  # the second time as a retry
            merge.append_changes(merge.dedup_last(staged, ["sig_hash"], "seq").drop("seq"), root, "writer", number)
        want = merge.upsert_products(want, staged)
        assert rows(merge.read_merged(spark, root, keep_old_if_null=keep)) == rows(want)
    assert rows(want) == [("a", "A4", 6.0, 7), ("b", "B", 2.0, 60), ("c", "C2", 4.0, 0)]


# --- imports ----------------------------------------------------------------------------


def test_imports_keep_ids_and_number_new_products(spark, tmp_path):
    config = scoring.ScoreConfig({f: 50 for f in vocab.SCORE_FIELDS}, as_of=date(2024, 3, 1))
    root, sheets = str(tmp_path / "store"), [tmp_path / f"sheet{i}.csv" for i in range(3)]
    sheets[0].write_text("name,price,rating\nLamp,10,4\nBox,2,\nlamp,12,\n,9,\n")
    sheets[1].write_text('name,price\nPen,1\nBOX,3\n"Desk\nlarge",80\n')
    sheets[2].write_text("name,price\n,1\n")
    seen = []
    for sheet in sheets:
        got = imports.import_catalog(spark, str(sheet), root, config, "csv", locale="us", run=sheet.name)
        seen.append({r["id"]: (r["name"], r["price"]) for r in got.collect()})
    assert seen[0] == {1: ("Box", 2.0), 2: ("lamp", 12.0)}
    assert seen[1] == seen[2] == {1: ("BOX", 3.0), 2: ("lamp", 12.0), 4: ("Pen", 1.0), 5: ("Desk\nlarge", 80.0)}
    again = imports.import_catalog(spark, str(sheets[1]), root, config, "csv", locale="us", run="sheet1.csv")
    assert {r["id"]: (r["name"], r["price"]) for r in again.collect()} == seen[1]
    assert again.where("score IS NULL").count() == 0
