"""Exact duplicates among product descriptions that arrive in batches, behind static filters."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens import session
from merchlens.llm.common import free_shuffles, join_unique, mix

BUCKET_KEYS = 8192  # digests a filter holds; a snapshot has as many filters as its texts need
SCREENED = 16 * BUCKET_KEYS  # digests that one task takes through a filter at a time
SPACES = " \t\n\x0b\x0c\r"
FILTER = "snapshot int, bucket long, buckets long, seed long, segment long, segments long, slots binary"


def bare(text: Column) -> Column:
    """A text without ASCII white space, a missing one being empty. Equal texts are equal in this form."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


# --- binary-fuse filters -----------------------------------------------------------------


class Fuse:
    """A static binary-fuse filter of 64-bit keys: one byte in each of three neighbouring segments.

    The three bytes a key names, combined by exclusive or, give the key's own byte. Every key
    it was built from is found; another one with chance 1/256.
    """

    def __init__(self, seed: int, segment: int, segments: int, slots: np.ndarray) -> None:
        self.seed, self.segment, self.segments, self.slots = seed, segment, segments, slots

    @classmethod
    def build(cls, keys: np.ndarray) -> Fuse:
        keys = np.unique(keys.astype(np.uint64))
        n = max(len(keys), 2)
        segment = 1 << max(2, min(18, int(log(n) / log(3.33) + 2.25)))
        room = n * max(1.125, 0.875 + 0.25 * log(1e6) / log(n))
        segments = max(1, ceil(room / segment) - 2)
        for seed in range(1, 1000):
            made = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint8))
            if made._fill(keys):
                return made
        raise ArithmeticError("no seed orders these keys")

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(keys.astype(np.uint64) ^ mix(np.uint64([self.seed])))
        first = (h >> np.uint64(32)) * np.uint64(self.segments * self.segment) >> np.uint64(32)
        within = np.uint64(self.segment - 1)
        places = np.stack(
            [
                first,
                (first + np.uint64(self.segment)) ^ ((h >> np.uint64(18)) & within),
                (first + np.uint64(2 * self.segment)) ^ (h & within),
            ]
        ).astype(np.int64)
        return places, ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)

    def _fill(self, keys: np.ndarray) -> bool:
        """Peels keys off slots that only they name, then sets these slots in the opposite order."""
        places, own = self._places(keys)
        size = len(self.slots)
        named = np.bincount(places.ravel(), minlength=size)
        index = np.arange(len(keys))
        total = sum(np.bincount(p, weights=index, minlength=size) for p in places).astype(np.int64)
        layers, left, single = [], len(keys), np.flatnonzero(named == 1)
        while len(single):
            peeled, at = np.unique(total[single], return_index=True)
            layers.append((peeled, single[at]))
            left -= len(peeled)
            for p in places[:, peeled]:
                np.subtract.at(named, p, 1)
                np.subtract.at(total, p, peeled)
            touched = np.unique(places[:, peeled])
            single = touched[named[touched] == 1]
        for peeled, slot in reversed(layers):
            a, b, c = self.slots[places[:, peeled]]
            self.slots[slot] = own[peeled] ^ a ^ b ^ c
        return left == 0

    def holds(self, keys: np.ndarray) -> np.ndarray:
        places, own = self._places(keys)
        a, b, c = self.slots[places]
        return (a ^ b ^ c) == own


def _build_filters(keys: DataFrame, snapshot: int, buckets: int) -> DataFrame:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        made = Fuse.build(rows["key"].to_numpy())
        row = (snapshot, int(rows["bucket"].iloc[0]), buckets, made.seed, made.segment, made.segments, made.slots.tobytes())
        return pd.DataFrame([row], columns=["snapshot", "bucket", "buckets", "seed", "segment", "segments", "slots"])

    dealt = keys.select("key", F.pmod("key", F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(build, FILTER)


def _screen(entries: DataFrame, filters: DataFrame, n_entries: int) -> DataFrame:
    """``entry, snapshot`` of the entries that a snapshot's filter lets through.

    Each entry meets one filter of each snapshot. Where a filter is met by more entries than a
    task should take, they are dealt to several copies of it.
    """
    sizes = filters.select("snapshot", "buckets").distinct().collect()  # one row a snapshot
    shares = [(s, b, max(1, ceil(n_entries / b / SCREENED))) for s, b in sizes]
    if not shares:
        return entries.select("entry", F.lit(None).cast("int").alias("snapshot")).limit(0)
    met = F.explode(F.array(*[F.struct(F.lit(s).alias("snapshot"), F.lit(b).alias("buckets"), F.lit(p).alias("parts")) for s, b, p in shares]))
    asked = entries.select("entry", "key", met.alias("m")).select(
        "entry", "key", "m.snapshot", F.pmod("key", "m.buckets").alias("bucket"), F.pmod("entry", "m.parts").cast("int").alias("part")
    )
    parts = F.element_at(F.create_map(*[F.lit(x) for s, _, p in shares for x in (s, p)]), F.col("snapshot"))
    copies = filters.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))

    def ask(rows: pd.DataFrame, filter: pd.DataFrame) -> pd.DataFrame:
        if not len(filter) or not len(rows):
            return pd.DataFrame({"entry": [], "snapshot": []})
        f = filter.iloc[0]
        made = Fuse(int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["slots"], np.uint8))
        return rows.loc[made.holds(rows["key"].to_numpy()), ["entry", "snapshot"]]

    by = ["snapshot", "bucket", "part"]
    return asked.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(ask, "entry long, snapshot int")


# --- the store of snapshots --------------------------------------------------------------


def _folder(store: str, number: int, table: str) -> str:
    return f"{store}/{number:06d}/{table}"


def _finished(spark: SparkSession, store: str) -> int:
    """How many snapshots are complete. The filters are written last."""
    number = 0
    while True:
        path, files = session.hadoop_path(spark, f"{_folder(store, number, 'filters')}/_SUCCESS")
        if not files.exists(path):
            return number
        number += 1


def _read(spark: SparkSession, store: str, numbers: range, table: str) -> DataFrame:
    """A table of several snapshots, each row with its snapshot's number."""
    frames = [spark.read.parquet(_folder(store, n, table)) for n in numbers]
    if table != "filters":
        frames = [f.withColumn("snapshot", F.lit(n)) for n, f in zip(numbers, frames)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def add_batch(
    products: DataFrame, store: str, id: str = "id", text: str = "description", digest: Callable[[Column], Column] = sha256
) -> int:
    """Adds a batch of products to the folder ``store`` as its next snapshot, and returns its number.

    Equal texts of the batch are grouped first, by digest and bytes. The distinct digests are
    screened by the static filters of the snapshots before; only those let through are joined to
    these snapshots' texts, where bytes decide. Texts met for the first time get filters of their
    own. A snapshot is never changed later; one left unfinished by a failed run is written anew.

    ``digest`` maps a text to its digest. Texts that differ but share a digest stay apart.
    """
    spark = products.sparkSession
    number = _finished(spark, store)

    def put(df: DataFrame, table: str) -> DataFrame:
        path = _folder(store, number, table)
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = products.select(F.col(id).alias("id"), F.coalesce(F.length(F.col(text)), F.lit(0)).alias("n_chars"), bare(F.col(text)).alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    # nothing but the text itself is a key of this shuffle: copies are joined before it and in it
    distinct = rows.select("digest", "text").distinct().withColumn("key", F.xxhash64("digest"))
    texts = put(distinct.withColumn("entry", F.monotonically_increasing_id()), "texts")
    clashes = put(texts.groupBy("digest").count().where("count > 1").select("digest"), "clashes")
    clashed = bool(clashes.head(1))
    free_shuffles(spark)

    def named(df: DataFrame) -> DataFrame:
        """Names each text by its digest, or by digest and bytes where that digest has several."""
        if not clashed:
            return df.withColumn("name", F.col("digest"))
        marked = df.join(clashes.withColumn("_clash", F.lit(True)), "digest", "left")
        return marked.withColumn("name", F.when(F.col("_clash"), F.concat_ws(":", "digest", "text")).otherwise(F.col("digest"))).drop("_clash")

    put(named(rows).select("id", "n_chars", "name", F.monotonically_increasing_id().alias("row")), "members")

    n_texts = texts.count()
    found = texts.select("entry", F.lit(None).cast("int").alias("home_snapshot"), F.lit(None).cast("long").alias("home_entry")).limit(0)
    if number:
        earlier = range(number)
        passed = put(_screen(texts.select("entry", "key"), _read(spark, store, earlier, "filters"), n_texts), "passed")
        ours = texts.join(passed, "entry").select("snapshot", "digest", "text", "entry")
        wanted = ours.select("snapshot", "digest").distinct()
        theirs = _read(spark, store, earlier, "texts").join(wanted, ["snapshot", "digest"], "left_semi")
        theirs = theirs.select("snapshot", "digest", F.col("text").alias("_text"), F.col("entry").alias("home_entry"))
        same = ours.join(theirs, ["snapshot", "digest"]).where(F.col("text") == F.col("_text"))
        found = put(same.select("entry", F.col("snapshot").alias("home_snapshot"), "home_entry"), "found")
        # a text that was found before is no snapshot's own but that of its first one
        found = found.groupBy("entry").agg(F.min(F.struct("home_snapshot", "home_entry")).alias("home")).select("entry", "home.*")
    homes = named(texts).select("entry", "name", "digest").join(found, "entry", "left")
    entries = homes.select(
        "name", "digest", F.coalesce("home_snapshot", F.lit(number)).alias("home_snapshot"), F.coalesce("home_entry", "entry").alias("home_entry")
    )
    put(entries, "entries")
    fresh = texts.select("entry", "key").join(found.select("entry"), "entry", "left_anti")
    buckets = max(1, ceil(n_texts / BUCKET_KEYS))
    put(_build_filters(fresh, number, buckets), "filters")
    free_shuffles(spark)
    return number


def duplicate_classes(spark: SparkSession, store: str) -> DataFrame:
    """Every product of all snapshots in ``store`` with the one that stays of those of equal text.

    That is the one of the longest description (in code points, white space counted), then of
    the smallest id. Returns ``id, keep_id, group_size, kept, digest``, one row a product.
    """
    numbers = range(_finished(spark, store))
    members, entries = _read(spark, store, numbers, "members"), _read(spark, store, numbers, "entries")
    best = F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "snapshot", "row")
    by_name = members.groupBy("snapshot", "name").agg(F.count("*").alias("held"), F.min(best).alias("best"))
    placed = by_name.join(entries, ["snapshot", "name"])
    classes = placed.groupBy("home_snapshot", "home_entry").agg(F.sum("held").alias("group_size"), F.min("best").alias("stays"))
    facts = placed.join(classes, ["home_snapshot", "home_entry"]).select("snapshot", "name", "digest", "held", "group_size", "stays")
    rows = join_unique(members, facts, ["snapshot", "name"], "held")
    kept = (F.col("stays.snapshot") == F.col("snapshot")) & (F.col("stays.row") == F.col("row"))
    return rows.select("id", F.col("stays.id").alias("keep_id"), "group_size", kept.alias("kept"), "digest")


def dedup_batches(
    batches: list[DataFrame], store: str, id: str = "id", text: str = "description", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """Adds the batches of products one after another to ``store`` and returns its classes.

    Products are the same if their descriptions are once ASCII white space (space, tab, line and
    page ends) is deleted. ``id, keep_id, group_size, kept, digest``, one row per product.

    NULLs: a missing description is empty, and equal to one of white space alone; a NULL id
    stays and comes last among equally long copies. Rows may repeat: each counts, and one of them
    is kept. Ids are numbers or text, other columns are ignored whatever their names, and empty
    batches give no rows. Several batches that hold the same product count it each time.
    """
    for batch in batches:
        add_batch(batch, store, id, text, digest)
    return duplicate_classes(batches[0].sparkSession, store)
