"""Label calibration: terciles with winsorising, minimum class shares, baselines.

Every threshold is one exact number read from a distributed rank, so the labels themselves
are a projection over (id, score) and no row is ever moved to a single task.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import ceil, floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.functions import vocab
from merchlens.functions.numbers import clamp
from merchlens.functions.text import tri_level
from merchlens.operators.histogram import histogram, values_at
from merchlens.operators.ranks import Cutoff, pct_rank, quantile_values, row_numbers, smallest
from merchlens.session import cut_lineage

WINSORISE_FROM = 50
TERCILES_FROM, DISTINCT_FROM = 6, 3
SAME = 1e-6
MIDDLE = 0.5
MANY_SIMILAR, FEW_SIMILAR = 8, 2


@dataclass(frozen=True)
class Thresholds:
    """Upper end of Low and lower end of High, with how they came about."""

    q33: float | None
    q67: float | None
    winsor: tuple[float, float] | None = None
    by_rank: bool = False
    counts: dict[str, int] | None = field(default=None, compare=False)  # rows of each class, where known


@dataclass(frozen=True)
class Shares:
    """Smallest share of the rows each class must hold."""

    low: float = 0.05
    medium: float = 0.05
    high: float = 0.05


STORED_FALLBACK = Thresholds(0.33, 0.66)


def fit_terciles(df: DataFrame, score: str, winsorise: float = 0.05, known: DataFrame | None = None) -> Thresholds | None:
    """Tercile limits of the winsorised scores; marked ``by_rank`` when too few or too flat.

    Two passes over the scores: their histogram, and the bins that hold the wanted positions. With
    ``known``, a stored histogram of the scores, the first is saved.
    """
    thirds = {"q33": 1 / 3, "q67": 2 / 3}
    probs = {"min": 0.0, "max": 1.0, **thirds, "lo": winsorise, "hi": 1 - winsorise}
    scores = df.select(score)
    known = cut_lineage(histogram(scores, score)) if known is None else known
    places = lambda n: [f((n - 1) * F.lit(float(p))) for p in probs.values() for f in (F.floor, F.ceil)]
    steps = values_at(scores, score, places, known=known).distinct().collect()  # at most two a position
    if not steps:
        return None
    n = steps[0]["n"]

    def around(p: float):
        place = (n - 1) * p
        low, high = (next(s for s in steps if s["before"] <= f(place) < s["before"] + s["cnt"]) for f in (floor, ceil))
        return low, high, low[score] + (high[score] - low[score]) * (place - floor(place))

    cut = {name: around(p)[2] for name, p in probs.items()}
    limits = None
    if n >= WINSORISE_FROM and winsorise > 0:
        limits = (cut["lo"], cut["hi"])
        if winsorise >= 0.3:  # the tails may reach the terciles: take them from clipped scores
            clipped = scores.select(_winsorised(F.col(score), limits).alias(score))
            cut |= quantile_values(clipped, score, thirds)
    good = n >= TERCILES_FROM and abs(cut["q67"] - cut["q33"]) > SAME
    good = good and _third_value(scores, score, known, cut["min"], cut["max"])
    counts = None
    if good and winsorise < 0.3:
        low, high = around(thirds["q33"]), around(thirds["q67"])
        least = low[1] if low[2] == low[1][score] else low[0]  # the largest score up to the limit
        below = high[0]["before"] + (high[0]["cnt"] if high[2] > high[0][score] else 0)
        counts = {"Low": least["before"] + least["cnt"], "High": n - below}
        counts["Medium"] = n - counts["Low"] - counts["High"]
    return Thresholds(cut["q33"], cut["q67"], limits, not good, counts)


def _third_value(scores: DataFrame, score: str, known: DataFrame, least: float, most: float) -> bool:
    """Whether a score lies strictly between the extremes, before winsorising; bins usually tell."""
    between = [(F.col(c) > least) & (F.col(c) < most) for c in ("low", "high")]
    if known.where(between[0] | between[1]).head(1):
        return True
    several = known.where("low < high").head(1)
    return bool(several) and bool(scores.where((F.col(score) > least) & (F.col(score) < most)).take(1))


def _winsorised(score: Column, limits: tuple[float, float] | None) -> Column:
    return score if limits is None else F.least(F.greatest(score, F.lit(limits[0])), F.lit(limits[1]))


def classify_terciles(df: DataFrame, score: str, thresholds: Thresholds, label: str = "label") -> DataFrame:
    """Adds Low / Medium / High, and the winsorised score as ``_score``."""
    rows = df.withColumn("_score", _winsorised(F.col(score), thresholds.winsor))
    if thresholds.by_rank or thresholds.q33 is None or thresholds.q67 is None:
        return _thirds_by_rank(rows, label)
    return rows.withColumn(label, _by_limits(F.col("_score"), thresholds))


def _by_limits(score: Column, t: Thresholds) -> Column:
    return F.when(score <= t.q33, "Low").when(score >= t.q67, "High").when(score.isNotNull(), "Medium")


def _thirds_by_rank(rows: DataFrame, label: str) -> DataFrame:
    n = rows.where(F.col("_score").isNotNull()).count()
    first, second = round(n / 3), round(2 * n / 3)
    placed = row_numbers(rows.where(F.col("_score").isNotNull()), "_score", "id", "_place")
    name = F.when(F.col("_place") <= first, "Low").when(F.col("_place") <= second, "Medium").otherwise("High")
    return placed.withColumn(label, name).drop("_place")


def enforce_min_shares(
    labelled: DataFrame,
    shares: Shares = Shares(),
    centres: tuple[float, float] = (0.33, 0.67),
    label: str = "label",
    counts: dict[str, int] | None = None,
) -> DataFrame:
    """Moves the closest rows until every class holds its minimum share.

    Medium is filled first from both sides (closest to 0.5), then Low and High from Medium
    (closest to their limit), never below Medium's own minimum. Ties go by id as text. Each
    step finds one cut-off (distance, id) in a stored copy of ids, scores and labels; the labels stay
    a projection. ``counts`` are the rows of each class, where known already.
    """
    slim = None
    if counts is None:
        slim = _slim(labelled, label)
        counts = {r["_class"]: r["count"] for r in slim.groupBy("_class").count().collect()}  # three rows
    have = {name: counts.get(name, 0) for name in vocab.TRI_LEVELS}
    n = sum(have.values())
    need = {
        "Low": ceil(shares.low * n), "Medium": ceil(shares.medium * n), "High": ceil(shares.high * n),
    }
    moves: list[tuple[str, float, str, Cutoff]] = []

    def move(source: str, centre: float, target: str, k: int) -> None:
        nonlocal slim
        slim = _slim(labelled, label) if slim is None else slim
        now = _moved(slim, moves, "_class").withColumn("_d", F.abs(F.col("_score") - centre))
        candidates = now.where(_sources(source, "_class"))
        cutoff = smallest(candidates, "_d", "_i", k)
        if cutoff is None:
            return
        gone = candidates.where(cutoff.admits(F.col("_d"), F.col("_i"))).groupBy("_class").count().collect()
        moves.append((source, centre, target, cutoff))
        for r in gone:
            have[r["_class"]] -= r["count"]
            have[target] += r["count"]

    if need["Medium"] > have["Medium"]:
        move("others", MIDDLE, "Medium", need["Medium"] - have["Medium"])
    for name, centre in (("Low", centres[0]), ("High", centres[1])):
        wanted = min(need[name] - have[name], have["Medium"] - need["Medium"])
        if wanted > 0:
            move("Medium", centre, name, wanted)
    if not moves:
        return labelled
    return _moved(labelled.withColumn("_i", F.col("id").cast("string")), moves, label).drop("_i")


def _slim(labelled: DataFrame, label: str) -> DataFrame:
    return cut_lineage(labelled.select(F.col("id").cast("string").alias("_i"), "_score", F.col(label).alias("_class")))


def _sources(source: str, label: str) -> Column:
    return F.col(label) == "Medium" if source == "Medium" else F.col(label) != "Medium"


def _moved(rows: DataFrame, moves: list[tuple[str, float, str, Cutoff]], label: str) -> DataFrame:
    """The labels after some moves, one after the other."""
    for source, centre, target, cutoff in moves:
        chosen = _sources(source, label) & cutoff.admits(F.abs(F.col("_score") - centre), F.col("_i"))
        rows = rows.withColumn(label, F.when(chosen, target).otherwise(F.col(label)))
    return rows


def calibrate(
    df: DataFrame, score: str, winsorise: float = 0.05, shares: Shares = Shares(), label: str = "label"
) -> DataFrame:
    """Terciles, then minimum shares: the label of every scored row."""
    scored = df.where(F.col(score).isNotNull())
    fitted = fit_terciles(scored, score, winsorise)
    if fitted is None:
        return scored.withColumn(label, F.lit(None).cast("string"))
    labelled = classify_terciles(scored, score, fitted, label)
    return enforce_min_shares(labelled, shares, (fitted.q33, fitted.q67), label, fitted.counts).drop("_score")


def classify_with_thresholds(
    df: DataFrame, score: str, stored: Thresholds | None = None, shares: Shares = Shares(), label: str = "label"
) -> DataFrame:
    """Labels from stored limits (no winsorising), 0.33 / 0.66 when none are stored."""
    limits = replace(stored or STORED_FALLBACK, winsor=None, by_rank=False, counts=None)
    if limits.q33 is not None and limits.q67 is not None and abs(limits.q67 - limits.q33) < SAME:
        limits = replace(limits, by_rank=True)
    labelled = classify_terciles(df.where(F.col(score).isNotNull()), score, limits, label)
    centres = (0.33 if limits.q33 is None else limits.q33, 0.67 if limits.q67 is None else limits.q67)
    return enforce_min_shares(labelled, shares, centres, label).drop("_score")


def load_thresholds(table: DataFrame, weights_version: int, model: str) -> dict[str, Thresholds]:
    """Stored limits per measure for one (weights version, model) pair: a handful of rows."""
    rows = table.where(
        (F.col("weights_version") == weights_version) & (F.col("model") == model)
    ).select("measure", "q33", "q67")
    return {r["measure"]: Thresholds(r["q33"], r["q67"]) for r in rows.collect()}  # a handful of rows


# --- baselines ------------------------------------------------------------------------


def _rating_share() -> Column:
    return clamp((F.col("rating") - 3.0) / 2.0)


def demand_baseline(df: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Low / Medium / High demand from units, conversion and rating; High needs all three."""
    ranked = pct_rank(df, "units_sold", "units_pct", population)
    ranked = pct_rank(ranked, "conversion_rate", "conversion_pct", population)
    inputs = [F.col("units_pct"), F.col("conversion_pct"), _rating_share()]
    signal = sum(
        (F.coalesce(c, F.lit(0.0)) * w for c, w in zip(inputs, (0.45, 0.35, 0.20))), F.lit(0.0)
    )
    complete = inputs[0].isNotNull() & inputs[1].isNotNull() & inputs[2].isNotNull()
    label = F.when((signal > 0.66) & complete, "High").when(signal < 0.33, "Low").otherwise("Medium")
    return ranked.withColumn("demand_signal", signal).withColumn("demand", label)


def main_category(c: Column) -> Column:
    """Category text before the first ``>``."""
    return F.trim(F.substring_index(F.coalesce(c, F.lit("")), ">", 1))


def category_frequency(df: DataFrame) -> DataFrame:
    """Products per main category and the category's rank share among all categories."""
    counts = (
        df.select(main_category(F.col("category")).alias("main_category"))
        .where(F.col("main_category") != "")
        .groupBy("main_category")
        .agg(F.count(F.lit(1)).alias("category_count"))
    )
    return pct_rank(counts, "category_count", "category_pct")


def competition_baseline(df: DataFrame, similar: DataFrame) -> DataFrame:
    """Low / Medium / High competition from category frequency and similar names.

    ``similar`` holds ``id, similar_at_least``; counts up to :data:`MANY_SIMILAR` are enough.
    """
    high_from, low_to = MANY_SIMILAR, FEW_SIMILAR
    rows = (
        df.withColumn("main_category", main_category(F.col("category")))
        .join(category_frequency(df), "main_category", "left")
        .join(similar, "id", "left")
        .withColumn("similar_at_least", F.coalesce("similar_at_least", F.lit(0)))
    )
    share, names = F.col("category_pct"), F.col("similar_at_least")
    high = F.coalesce(share >= 0.70, F.lit(False)) | (names >= high_from)
    low = F.coalesce(share <= 0.30, F.lit(False)) & (names <= low_to)
    return rows.withColumn("competition", F.when(high, "High").when(low, "Low").otherwise("Medium"))


def _ordinal(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in vocab.TRI_LEVELS]), c)


def reconcile_labels(df: DataFrame, demand: str, demand_base: str, competition: str, competition_base: str) -> DataFrame:
    """Demand never above, competition never below its baseline."""
    levels = F.array(*[F.lit(v) for v in vocab.TRI_LEVELS])

    def position(name: str) -> Column:
        return _ordinal(tri_level(F.col(name)))

    lower = F.least(position(demand), position(demand_base)).cast("int")
    upper = F.greatest(position(competition), position(competition_base)).cast("int")
    return df.withColumn("demand_final", F.element_at(levels, lower)).withColumn(
        "competition_final", F.element_at(levels, upper)
    )
