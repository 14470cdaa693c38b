import random
import re

import pytest
from pyspark.sql import functions as F

from tests.frames import by_id
from merchlens.functions import vocab
from merchlens.operators import similarity


def brute_force(products):
    words = {i: [w for w in re.findall("[a-z0-9]+", (n or "").lower()) if w not in vocab.NAME_STOP_WORDS] for i, n in products}
    index = {i: set(w) for i, w in words.items()}
    return {
        i: sum(1 for o in words if o != i and sum(w in index[o] for w in words[i]) >= 2) for i in words
    }


@pytest.fixture(scope="module")
def products():
    rng = random.Random(3)
    common = ["mini", "red", "the", "lamp", "pro"]
    rare = [f"w{i}" for i in range(40)]
    names = [(0, None), (1, "of the"), (2, "solo"), (3, "box box"), (4, "Box lid"), (5, "box, box"), (6, "¡Mini! RED-lamp")]
    for i in range(7, 160):
        picked = rng.sample(common, rng.randint(0, 3)) + rng.sample(rare, rng.randint(0, 2))
        if rng.random() < 0.2 and picked:
            picked.append(picked[0])
        rng.shuffle(picked)
        names.append((i, " ".join(picked)))
    return names


@pytest.mark.parametrize("light_group", [0, 2, 8, 1000])
def test_full_count_is_exact_on_every_path(spark, products, light_group):
    df = spark.createDataFrame(products, "id long, name string")
    got = by_id(similarity.name_similarity(df, light_group=light_group), "similar_names")
    assert got == brute_force(products)


@pytest.mark.parametrize("block", [1, 7, 8192])
def test_blocks_of_frequent_tokens_add_up(spark, products, block):
    df = spark.createDataFrame(products + [(1000 + i, "mini mini lamp pro") for i in range(70)], "id long, name string")
    got = by_id(similarity.name_similarity(df, light_group=1, block=block), "similar_names")
    assert got == brute_force(products + [(1000 + i, "mini mini lamp pro") for i in range(70)])


def test_names_of_twenty_frequent_tokens(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    names = [(i, " ".join(rng.sample(words, 20))) for i in range(600)] + [(600, " ".join(words)), (601, "w1 w1"), (602, "w1"), (603, None)]
    got = by_id(similarity.name_similarity(spark.createDataFrame(names, "id long, name string")), "similar_names")
    assert got == brute_force(names)


@pytest.mark.parametrize("limit", [1, 3, 8, 500])
def test_limited_count_is_exact_below_the_limit(spark, products, limit):
    df = spark.createDataFrame(products, "id long, name string")
    got = by_id(similarity.similar_up_to(df, limit), "similar_at_least")
    assert got == {i: min(limit, n) for i, n in brute_force(products).items()}


def test_token_pairs_are_never_broadcast(spark):
    """Exploded rows look as small to Spark as the names they come from."""
    names = spark.range(3000).select("id", F.concat_ws(" ", F.lit("ring ring"), F.col("id").cast("string"), F.pmod("id", F.lit(9)).cast("string")).alias("name"))
    plan = similarity.similar_up_to(names, 3)._jdf.queryExecution().executedPlan().toString()
    assert all("LeftSemi" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
