import json
import random
from contextlib import contextmanager
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.frames import by_id, rows
from merchlens.functions import numbers, text
from merchlens.sources import catalog, export, normalise, pages

NOW = datetime(2024, 1, 1)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "b_shop.csv").write_text(
        'Nombre,Title,Precio,Item Sold,Rating,Brand,ASIN,Notes\n'
        ' Lamp ,Ignored,"1.234,50 €",2k,"4,5",Acme,X1,"two\nlines"\n'
        ',Fallback title,19.99,,,,, \n'
        ',,5,,,,,nameless\n',
        encoding="utf-8",
    )
    (tmp_path / "a_shop.csv").write_text("name,price\nFirst,1\nSecond,2\n", encoding="utf-8")
    (tmp_path / "list.json").write_text(json.dumps([{"title": "Json one", "price": 19.99}, 5, {"title": "Json two"}]))
    return tmp_path


def test_csv_cells_and_names(spark, folder):
    df = catalog.read_catalog(spark, str(folder / "b_shop.csv"))
    assert df.count() == 3 and df.first()["Notes"] == "two\nlines" and df.first()["_file"] == "b_shop"


@pytest.mark.parametrize(
    ("body", "crosses"),
    [
        ('1,"a, b"\n2,"say ""hi"""\n3,""\n4,plain\n', False),
        ('1,"a, b"\r\n2,x\r\n', False),
        ('1,5" pipe\n2,15" monitor,x\n3, "a\n', False),
        ('1,"two\nlines"\n', True),
        ('1,"ends with """\n2,"opens "",\nhere"\n', True),
        ('1,"""\n"\n2,"a""\n""b","\n"\n3,"x"\n', True),
        ('1,"a\r\nb"\r\n2,c\r\n', True),
        ('1,5" pipe\n2,"5"" tube\n,""x"\n', True),
        ('1,a\rb\n', True),
    ],
)
def test_cells_may_cross_lines_and_splits(spark, tmp_path, body, crosses):
    end = "\r\n" if "\r\n" in body else "\n"
    (tmp_path / "shop.csv").write_bytes(f"id,name{end}{body}".encode())
    path = str(tmp_path / "shop.csv")
    assert catalog._cells_cross_lines(spark, path) == crosses
    want = rows(catalog.read_catalog(spark, path, whole_files=True), "id", "name")
    with small_splits(spark, "16"):
        assert rows(catalog.read_catalog(spark, path).orderBy("_seq"), "id", "name") == want


def test_a_cell_that_is_never_closed_takes_the_rest_of_its_file(spark, tmp_path):
    (tmp_path / "shop.csv").write_text('id,name\n1,"open\n2,x\n')
    assert rows(catalog.read_catalog(spark, str(tmp_path)), "id", "name") == [("1", "open\n2,x")]


@contextmanager
def small_splits(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.files.openCostInBytes": size}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


def test_random_quotes_read_the_same_in_splits_and_whole(spark, tmp_path):
    rng = random.Random(4)
    cells = lambda: rng.choice(["a", "", '"x\ny"', '"say ""hi""\n"', "b c", '"1,2"', '"\n\n"', '""', 'd"e', '"f"', '"""q"""'])
    for n in range(3):
        body = "".join(f"{i},{cells()},{cells()}\n" for i in range(120))
        (tmp_path / f"s{n}.csv").write_text("id,name,brand\n" + body)
    want = rows(catalog.read_catalog(spark, str(tmp_path), whole_files=True), "id", "name", "brand", "_file")
    with small_splits(spark, "200"):
        df = catalog.read_catalog(spark, str(tmp_path))
        assert rows(df, "id", "name", "brand", "_file") == want and len(want) == 360


def test_cells_with_line_breaks_are_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "shop.csv").write_text("id,name\n" + "".join(f'{i},"item\n {i}"\n' for i in range(60_000)))
    (tmp_path / "inches.csv").write_text("id,name\n" + "".join(f'{i},15" monitor {i}\n' for i in range(60_000)))
    with small_splits(spark, "128k"):
        for name, value in (("shop", "item\n 7"), ("inches", '15" monitor 7')):
            path = str(tmp_path / f"{name}.csv")
            pieces = catalog.records.pieces(spark, path, "\n")
            assert pieces.select("block").distinct().count() > 4
            df = catalog.read_catalog(spark, path)
            assert df.count() == 60_000 and df.where("id = '7'").first()["name"] == value


LISTS = [
    '[{"title": "a } b", "n": {"x": [1, {"y": 2}]}}, 5, "s}{", [1, {"z": 3}], null, {"title": "q\\"}", "price": 1.50}]',
    '[\n  {"title": "C:\\\\"},\n  {"title": "é", "tags": ["{", "}"]}\n]\n',
    "[]", "  [ ]", '{"title": "no list", "x": {"y": 1}}', "", '[{}]', '[{"title": "last"}, 7]',
]


@pytest.mark.parametrize("split", ["40", "1m"])
def test_json_lists_are_cut_between_their_objects(spark, tmp_path, split):
    for n, text in enumerate(LISTS):
        (tmp_path / f"l{n}.json").write_text(text, encoding="utf-8")
    want = []
    for n, text in enumerate(LISTS):
        entries = json.loads(text) if text.strip() else []
        want += [(f"l{n}", e.get("title"), str(e["price"]) if "price" in e else None) for e in entries if isinstance(entries, list) and isinstance(e, dict)]
    with small_splits(spark, split):
        df = catalog.read_catalog(spark, str(tmp_path), "json")
        got = [(r["_file"], r["title"], r["price"] and str(float(r["price"]))) for r in df.orderBy("_seq").collect()]
        assert got == want
        nested = df.where("_file = 'l0' AND n IS NOT NULL").first()
        assert json.loads(nested["n"]) == {"x": [1, {"y": 2}]}


def test_one_long_json_list_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"title": f"t {i}", "note": "{" * (i % 3) + '"'} for i in range(50_000)]))
    with small_splits(spark, "128k"):
        assert catalog.records.pieces(spark, str(tmp_path), "}").select("block").distinct().count() > 4
        df = catalog.read_catalog(spark, str(tmp_path), "json")
        assert df.agg(F.count("*"), F.count_distinct("title")).first() == (50_000, 50_000)
        assert "wholetext" not in df._jdf.queryExecution().toString().lower()


def test_large_csv_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "shop.csv").write_text("id,name\n" + "".join(f'{i},"item, {i}"\n' for i in range(200_000)))
    with small_splits(spark, "512k"):
        df = catalog.read_catalog(spark, str(tmp_path / "shop.csv"))
        assert df.select(F.spark_partition_id()).distinct().count() > 4
        assert df.agg(F.count_distinct("name")).first()[0] == 200_000


def test_json_list_skips_non_objects(spark, folder):
    df = catalog.read_catalog(spark, str(folder / "list.json"), "json")
    assert rows(df, "title", "price") == [("Json one", "19.99"), ("Json two", None)]


def test_folder_is_read_as_one_catalogue(spark, folder):
    df = catalog.read_catalog_dir(spark, str(folder))
    counts = {r["_file"]: r["count"] for r in df.groupBy("_file").count().collect()}
    assert counts == {"a_shop": 2, "b_shop": 3, "list": 2}
    with pytest.raises(FileNotFoundError):
        catalog.read_catalog_dir(spark, str(folder / "nothing"))


def test_first_alias_with_a_value_wins_per_row(spark, folder):
    mapped = catalog.map_columns(catalog.read_catalog(spark, str(folder / "b_shop.csv")))
    got = {r["name"]: r for r in mapped.collect()}
    assert set(got) == {"Lamp", "Fallback title", None}
    assert got["Lamp"]["other"]["Title"] == "Ignored" and "Title" not in got["Fallback title"]["other"]
    assert got["Fallback title"]["other"] == {}


def test_normalised_rows(spark, folder):
    mapped = catalog.map_columns(catalog.read_catalog(spark, str(folder / "b_shop.csv")))
    got = {r["name"]: r for r in normalise.normalise_products(mapped, import_date=F.lit(NOW)).collect()}
    lamp = got["Lamp"]
    assert lamp["price"] == 1234.5 and lamp["source"] == "b_shop" and len(got) == 2
    assert lamp["extra"]["units_sold"] == "2000" and lamp["extra"]["rating"] == "4.5" and lamp["extra"]["Notes"] == "two\nlines"
    # a point groups thousands in this locale; the other locale reads it as the decimal mark
    assert got["Fallback title"]["price"] == 1999
    us = normalise.normalise_products(mapped, locale="us", source="s", import_date=F.lit(NOW))
    assert {r["name"]: r["price"] for r in us.collect()}["Fallback title"] == 19.99


def test_numbers_that_are_numbers_are_not_parsed_again(spark, folder):
    mapped = catalog.map_columns(catalog.read_catalog(spark, str(folder / "list.json"), "json"))
    got = normalise.normalise_products(mapped, numeric_input=True, import_date=F.lit(NOW))
    assert rows(got, "name", "price") == [("Json one", 19.99), ("Json two", None)]


def test_signature_ignores_case_space_and_missing_parts(spark):
    df = spark.createDataFrame([(1, " Big\t LAMP", None), (2, "big lamp", ""), (3, "big lamp", "x")], "id long, n string, b string")
    got = by_id(df.select("id", text.signature(F.col("n"), F.col("b")).alias("s")), "s")
    assert got[1] == got[2] != got[3]


def test_substring_headers_are_claimed_once():
    found = catalog.resolve_contains(["Sale Date", "Date Range", "Product Rating", "Product Title", "Units Sold", "Ventas_por_dia"])
    assert found["launch_date"] == ["Sale Date"] and found["date_range"] == ["Date Range"]
    assert found["rating"] == ["Product Rating"] and found["name"] == ["Product Title"]
    assert found["units_sold"] == ["Units Sold"] and found["ventas_por_dia"] == ["Ventas_por_dia"]


def test_substring_mode_derives_revenue_and_repairs_dots(spark):
    raw = spark.createDataFrame(
        [("A", "2,5", "1.000 pcs", None, "1.234.5"), ("B", "bad", "3", "9,5", "")], "`Product Name` string, Price string, Units string, Sales string, Stars string"
    )
    got = {r["name"]: r for r in normalise.normalise_products_contains(catalog.map_columns(raw, "contains")).collect()}
    assert got["A"]["extra"]["revenue"] == "2500.0" and got["A"]["extra"]["rating"] == "1234.5"
    assert got["B"]["price"] is None and got["B"]["extra"]["Revenue($)"] == "9.5" and "rating" not in got["B"]["extra"]


def test_ids_follow_files_and_lines(spark, folder):
    df = catalog.read_catalog_dir(spark, str(folder)).withColumn("label", F.coalesce("name", F.trim("Nombre"), "Title", "Notes", "title"))
    got = {r["label"]: r["id"] for r in normalise.assign_ids(df).collect()}
    assert got == {"First": 1, "Second": 2, "Lamp": 3, "Fallback title": 4, "nameless": 5, "Json one": 6, "Json two": 7}
    a = catalog.read_catalog(spark, str(folder / "a_shop.csv"))
    existing = spark.createDataFrame([(7,), (3,)], "id long")
    assert {r["name"]: r["id"] for r in normalise.assign_ids(a, existing).collect()} == {"First": 9, "Second": 10}


def test_other_headers_are_never_mixed_up(spark, folder):
    with pytest.raises(Exception, match="header"):
        catalog.read_catalog(spark, str(folder / "*_shop.csv")).collect()


@pytest.mark.parametrize(
    "parser, cell, want",
    [
        (numbers.parse_eu, "1.234,5", 1234.5), (numbers.parse_eu, "2,5K", 2500), (numbers.parse_eu, "€ 3m", 3e6), (numbers.parse_eu, "12 %", 12),
        (numbers.parse_eu, "abc", None), (numbers.parse_us, "$1,234.5", 1234.5), (numbers.parse_us, "1.5k", 1500), (numbers.parse_us, "4d", None),
        (numbers.parse_metric, "12,5 %", 0.125), (numbers.parse_metric, "~7", 7), (numbers.repair_dots, "1.234.567,8", 1234567.8),
        (numbers.score_fraction, "85%", 0.85), (numbers.score_fraction, "0.4", 0.4), (numbers.score_fraction, "HIGH", 0.8), (numbers.score_fraction, "500", None),
    ],
)
def test_number_formats(spark, parser, cell, want):
    got = spark.createDataFrame([(cell,)], "c string").select(parser(F.col("c"))).first()[0]
    assert got == want if want is None else got == pytest.approx(want)


@pytest.mark.parametrize(
    "fn, cell, want",
    [
        (text.tri_level, "Álta", "High"), (text.tri_level, "??", "Medium"), (text.awareness_label, "Solución consciente", "Solution-Aware"),
        (text.awareness_label, None, "Problem-Aware"), (text.cleanse, "Set of 30 ml bottles, x2.", "of 30 bottles"),
        (text.variant_title, "Lamp (Red) XL 30 cm!", "lamp"), (text.clean_name, "Lamp🔥🔥 ", "Lamp🔥🔥"), (text.clean_name, "Lamp 🔥🔥", "Lamp"),
        (lambda c: text.truncate(c, 5), "abc defgh", "abc…"), (lambda c: text.token_estimate(F.length(c)), "12345", 2),
    ],
)
def test_text_helpers(spark, fn, cell, want):
    assert spark.createDataFrame([(cell,)], "c string").select(fn(F.col("c"))).first()[0] == want


def test_join_bullets(spark):
    df = spark.createDataFrame([([" a ", "", "b\nc"],)], "x array<string>")
    assert df.select(text.join_bullets(F.col("x"), 50)).first()[0] == "a • b c"


# --- pages ------------------------------------------------------------------------------

PAGES = [
    (1, "http://x.com/a", "<title> Lamp &amp; co </title><meta name='description' content='Nice > best'><p>$5.50 or € 4,20</p>"),
    (2, "http://X.com/b", "<META property=og:description content=\"Only graph\"><b>7,5 €</b>"),
    (3, "http://y.com", "<p>nothing 3.5 USD</p>"),
    (4, "http://y.com/d", "<title>T</title><meta name='description' content=''><meta property='og:description' content='no'><p>12 USD</p>"),
    (5, "http://y.com/e", "<title>C</title><!-- €9.99 --><i data-x='1>2'>9.5 USD</i>"),
]
# as a parser sees them: comments, scripts, quoted values and attributes in any order
PARSED = [
    ("<!-- <title>No</title> <meta name='description' content='no'> --><title>Yes</title>", ("Yes", None, None)),
    ("<script>var t = '<title>No</title>', p = '€ 1,50';</script><TITLE lang=en>Yes &lt;3</TITLE><p>€ 2,50", ("Yes <3", None, 2.5)),
    ("<style>a:after{content:'<meta name=description content=no>'}</style><title>T</title>", ("T", None, None)),
    ("<title>T</title><meta content='first' charset=x name='description'/>", ("T", "first", None)),
    ("<title>T</title><meta content=\"name='description' > x\" name=keywords><meta CONTENT=\"it's\" NAME=description>", ("T", "it's", None)),
    ("<title>T</title><a title='<meta name=description content=no>'>x</a><meta property='og:description' content='og'>", ("T", "og", None)),
    ("<title></title><meta name=description content=only>", ("", "only", None)),
    ("<title>T</title> 1 < 2 <b>3,50 €</b> <!-- open 9,99 €", ("T", None, 3.5)),
    ("<script src='x'>never closed <title>No</title>", None),
    (None, None),
    ("", None),
    ("<p " + "a='1' " * 3000 + "><title>Long</title>" + "<i>x</i>" * 3000, ("Long", None, None)),
]


def test_pages_as_a_parser_sees_them(spark):
    df = spark.createDataFrame([(i, None, html) for i, (html, _) in enumerate(PARSED)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["name"], r["description"], r["price"]) for r in pages.extract_pages(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PARSED) if want}


def test_pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = {r["page_id"]: (r["name"], r["description"], r["price"]) for r in pages.extract_pages(df).collect()}
    assert got == {
        1: ("Lamp & co", "Nice > best", 4.2),  # the euro pattern is tried first
        2: ("", "Only graph", 7.5),
        4: ("T", None, None),
        5: ("C", None, 9.5),
    }
    hosts = {r["host"]: (r["pages"], r["priced"]) for r in pages.host_counts(pages.extract_pages(df)).collect()}
    assert hosts == {"x.com": (2, 2), "y.com": (2, 1)}


# --- exports ----------------------------------------------------------------------------

PRODUCT = "id long, name string, category string, price double, image_url string, desire string, desire_magnitude string, awareness_level string, competition_level string, extra map<string,string>"


def test_analysis_report(spark):
    first = {
        "TikTokUrl": "https://t/alpha", "KalodataUrl": "https://k/alpha", "Img_url": "https://i/alpha", "Category": "Beauty", "Price($)": "$19.99",
        "Product Rating": "4.8", "Item Sold": "1,200", "Revenue($)": "1000", "Live Revenue($)": "200", "Video Revenue($)": "300",
        "Shopping Mall Revenue($)": "50", "Launch Date": "2024-01-01", "desire_score": "0.8", "awareness_level": "2", "competition": "0.3",
    }
    second = {
        "tiktok_url": "https://t/beta", "image_url": "https://i/beta", "price": "29", "rating": "4.1", "units_sold": "80", "Revenue($)": "400",
        "Video Revenue($)": "100", "Launch Date": "15/12/2023", "desire_magnitude": "65", "customer_desire": "Resuelve dolor",
        "awareness_level_label": "Product-aware", "competition_level_label": "Medium",
    }
    third = {
        "price": "15.50", "rating": "4.5", "units_sold": "500", "Revenue($)": "250", "Live Revenue($)": "30", "Video Revenue($)": "20",
        "Launch Date": "45260", "desires": "Resolver frustración", "awareness_level": "4", "competition_level": "80", "name": "n/a",
    }
    df = spark.createDataFrame(
        [
            (1, "Alpha 🔥", "Beauty", 19.99, None, "Fuerte deseo", None, None, None, first),
            (2, "Beta", "Home", None, None, None, None, None, None, second),
            (3, "Gamma", "Kitchen", None, None, None, None, None, None, third),
        ],
        PRODUCT,
    )
    out = export.export_analysis(df)
    assert out.columns[1:] == ["image preview", "name", "category", "launch date", "price", "rating", "revenue", "items sold", "desire",
                               "desire magnitude", "awareness level", "competition level", "TikTokUrl", "KalodataUrl", "Img_url"]
    got = {r["id"]: r for r in out.collect()}
    assert [got[i]["revenue"] for i in (1, 2, 3)] == [1550.0, 500.0, 300.0]
    assert [got[i]["items sold"] for i in (1, 2, 3)] == [1200, 80, 500]
    assert [got[i]["desire magnitude"] for i in (1, 2, 3)] == [80, 65, 50]
    assert [got[i]["awareness level"] for i in (1, 2, 3)] == ["Solution-aware", "Product-aware", "Most aware"]
    assert [got[i]["competition level"] for i in (1, 2, 3)] == ["Low", "Medium", "High"]
    assert [got[i]["launch date"] for i in (1, 2, 3)] == ["2024-01-01", "2023-12-15", "2023-11-30"]
    assert [got[i]["price"] for i in (1, 2, 3)] == [19.99, 29.0, 15.5] and got[1]["name"] == "Alpha" and got[3]["name"] == "Gamma"
    assert got[2]["desire"] == "Resuelve dolor" and got[2]["TikTokUrl"] == "https://t/beta" and got[3]["KalodataUrl"] == ""


def test_canonical_order(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "`Extra.col` int, Title int, Image int, Thumbnail int, `Price($)` int")
    out = export.canonical_order(df)
    assert out.columns == ["image preview", "name", "price", "Extra.col"] and tuple(out.first()) == (4, 2, 5, 1)


def test_table_and_ranking(spark, tmp_path):
    products = spark.createDataFrame(
        [(1, "A🔥", "", None, None, "d", "High", "Unaware", "Low", {}), (2, "B", "", None, None, None, None, None, None, {})], PRODUCT
    ).withColumn("date_range", F.lit("x~y"))
    sub = "momentum double, saturation double, differentiation double, social_proof double, margin double, logistics double"
    scores = spark.createDataFrame(
        [(1, 1, "2024-01-01", 10, 5.0, *[1.0] * 6, "old"), (2, 1, "2024-01-02", 20, 3.0, *[1.0] * 6, "new"), (3, 2, "2024-01-01", 7, 9.0, *[1.0] * 6, "b")],
        f"id long, product_id long, created_at string, winner_score int, total_score double, {sub}, summary string",
    )
    table = export.export_table(products, scores)
    assert rows(table, "id", "name", "Winner Score") == [(1, "A", 20), (2, "B", 7)]
    assert [r["id"] for r in export.rank_report(products, scores).collect()] == [2, 1]
    export.write_table(table, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
