"""Licence detection in product descriptions by ordered signature rules."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchlens.llm.common import low, text_key
from merchlens.llm.license_rules import BASE, HINT, Rule, all_rules

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OPEN, _CLOSE = "\u0001", "\u0002"  # never inside a word


def spaced_words(text: Column) -> Column:
    """The words of a text, lower-cased, each with a blank before and after it."""
    words = F.trim(F.regexp_replace(low(text), NOT_WORD, " "))
    return F.concat(F.lit(" "), words, F.when(words != "", F.lit(" ")).otherwise(F.lit("")))


def _rule_array(rules: list[Rule]) -> Column:
    """The rules as one constant, so that a text's rules are picked without a join."""
    rows = [
        {"rule": number, "gate": r.gate, "pattern": f"(?<= )({r.pattern})(?= )", "label": r.label, "priority": r.priority, "weight": r.weight}
        for number, r in enumerate(rules)
    ]
    fields = "array<struct<rule:int,gate:string,pattern:string,label:string,priority:int,weight:double>>"
    return F.from_json(F.lit(json.dumps(rows)), fields)


def detect_licenses(products: DataFrame, rules: list[Rule] | None = None, id: str = "id", text: str = "description") -> DataFrame:
    """Every place where a rule matches: id, _key, first and last word, rule, label, priority, weight.

    A rule is tried only on texts that hold its gate word. A rule's own matches don't overlap;
    matches of different rules may, which :func:`resolve` settles. ``_key`` tells texts apart
    that share an id.
    """
    rules = all_rules() if rules is None else rules
    gates = "|".join(sorted({r.gate for r in rules}))
    gated = (
        products.select(F.col(id).alias("id"), text_key(F.col(text)).alias("_key"), spaced_words(F.col(text)).alias("_words"))
        .where(F.col("_words").rlike(f"(?<= )(?:{gates})(?= )"))
        .withColumn("_gates", F.array_distinct(F.regexp_extract_all("_words", F.lit(f"(?<= )({gates})(?= )"), F.lit(1))))
    )
    tried = gated.select(
        "id",
        "_key",
        "_words",
        F.explode(F.filter(_rule_array(rules), lambda r: F.array_contains("_gates", r["gate"]))).alias("r"),
    ).where(F.regexp("_words", F.col("r.pattern")))
    marked = F.regexp_replace(F.col("_words"), F.col("r.pattern"), F.lit(f"{_OPEN}$1{_CLOSE}"))
    words = F.split(F.trim(marked), " ")
    at = lambda test: F.filter(F.transform(words, lambda w, i: F.when(test(w), i)), lambda i: i.isNotNull())
    places = tried.select(
        "id",
        "_key",
        "r",
        F.explode(
            F.arrays_zip(
                at(lambda w: w.startswith(_OPEN)).alias("first"),
                at(lambda w: w.endswith(_CLOSE)).alias("last"),
            )
        ).alias("p"),
    )
    return places.select(
        "id",
        "_key",
        F.col("p.first").cast("long").alias("first"),
        F.col("p.last").cast("long").alias("last"),
        "r.rule",
        "r.label",
        "r.priority",
        "r.weight",
    )


def resolve(detections: DataFrame) -> DataFrame:
    """Detections that stay: a place inside another one of the same or a better priority goes.

    Of detections over the very same words the better priority stays, then the earlier rule.
    Base phrases always stay. One pass over a text's detections ordered by place: a detection
    lies inside an earlier one if the furthest end so far reaches its own.
    """
    order = Window.partitionBy("id", "_key").orderBy("first", F.desc("last"), "priority", "rule")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("priority") <= p, F.col("last"))).over(before).alias(f"_reach{p}") for p in range(BASE, HINT + 1)]
    inside = reduce(
        lambda otherwise, p: F.when(F.col("priority") == p, F.coalesce(F.col(f"_reach{p}") >= F.col("last"), F.lit(False))).otherwise(otherwise),
        range(BASE, HINT + 1),
        F.lit(False),
    )
    kept = detections.select("*", *reach).where((F.col("priority") == BASE) | ~inside)
    return kept.drop(*[f"_reach{p}" for p in range(BASE, HINT + 1)])


def scan_licenses(products: DataFrame, rules: list[Rule] | None = None, id: str = "id", text: str = "description") -> DataFrame:
    """One row per product: its licence notices.

    Ordered signature rules (:mod:`merchlens.llm.license_rules`), gated by keywords, with
    priority and interval containment settling overlaps. Returns ``id, n_words, n_base,
    first_word, last_word, base_labels, labels, n_found, score``: the number of words, of base
    phrases (all places), the smallest and largest word where one starts (from 0, else NULL),
    the distinct labels of base phrases and of all detections that stay (sorted, joined by
    commas), their number, and the weight of the surest one (0 without any).

    A missing or empty text has no words and no detections. Rows with equal id and text get
    equal results, one for each; a NULL id is an id like any other; further columns of
    ``products`` are ignored whatever their names; an empty table gives no rows.
    """
    rules = all_rules() if rules is None else rules
    is_base = F.col("priority") == BASE
    join_labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = (
        resolve(detect_licenses(products, rules, id, text))
        # rows that repeat id and text would count their places again
        .groupBy("id", "_key", "first", "last", "rule", "label", "priority")
        .agg(F.max("weight").alias("weight"))
        .groupBy("id", "_key")
        .agg(
            F.count_if(is_base).alias("n_base"),
            F.min(F.when(is_base, F.col("first"))).alias("first_word"),
            F.max(F.when(is_base, F.col("first"))).alias("last_word"),
            join_labels(F.when(is_base, F.col("label"))).alias("base_labels"),
            join_labels(F.col("label")).alias("labels"),
            F.count(F.lit(1)).alias("n_found"),
            F.max("weight").alias("score"),
        )
        .withColumnsRenamed({"id": "_id", "_key": "_found"})
    )
    words = spaced_words(F.col(text))
    counted = products.select(
        F.col(id).alias("id"),
        text_key(F.col(text)).alias("_key"),
        F.greatest(F.length(words) - F.length(F.translate(words, " ", "")) - 1, F.lit(0)).cast("long").alias("n_words"),
    )
    joined = counted.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_found")), "left")
    return joined.select(
        "id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("n_found", F.lit(0).cast("long")).alias("n_found"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
