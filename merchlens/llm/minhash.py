"""Near-duplicate product descriptions: SuperMinHash, banding, verification and union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchlens.llm.common import free_shuffles, in_batches, in_pieces, joined_bytes, mix, prefix_hash, span_hash, stored, word_bounds
from merchlens.llm.components import connected_components

SLOTS = 128
BANDS = 32  # of SLOTS / BANDS values each; at similarity 0.8 a pair misses all with chance 5e-8
CHUNK = 512  # texts of a bucket that are compared in one group
TASK_VALUES = 1 << 20  # 64-bit values of sets, signatures and band keys that a task takes at least
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text as 64-bit hashes: values, and where each text's begin.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than
    ``width`` has them all as one shingle, one without words has none. Values rise within a text.
    """
    raw, begins = joined_bytes(texts)
    data = _LOWER[np.frombuffer(raw, np.uint8)] if raw else np.zeros(0, np.uint8)
    start, end = word_bounds(data)
    words = span_hash(prefix_hash(data), start, end)
    text = np.searchsorted(begins, start, side="right") - 1
    counts = np.bincount(text, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    ahead = np.cumsum(counts) - counts
    n = max(0, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = mix(h + words[j : j + n])
    inside = text[:n] == text[width - 1 : width - 1 + n]
    owner, value = text[:n][inside], h[inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            held = counts[short] > j
            whole[held] = mix(whole[held] + words[ahead[short[held]] + j])
        owner, value = np.concatenate([owner, short]), np.concatenate([value, mix(whole ^ np.uint64(0x5851F42D4C957F2D))])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[new], value[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1))


def superminhash(values: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures of sets: one row of ``slots`` values per set; rows of empty sets are infinite.

    An element offers its step number plus a random fraction to one slot per step, the slots in
    a random order of its own (a Fisher-Yates shuffle that goes on by one place a step). A slot
    keeps the least offer. A set is finished once all its slots hold less than the next step's
    number, which large sets reach at the first steps. All sets of a batch step side by side.
    """
    sets = len(bounds) - 1
    least = np.full(sets * slots, np.inf)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    value, shuffle = values, None
    for step in range(slots):
        if not len(value):
            break
        drawn = mix(value ^ mix(np.full(1, step + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        place = step + (((drawn & np.uint64(0xFFFFFF)) * np.uint64(slots - step)) >> np.uint64(24)).astype(np.int64)
        offer = step + (drawn >> np.uint64(24)).astype(np.float64) * 2.0**-40
        if step == 0:
            slot = place
        else:
            rows = np.arange(len(value))
            slot = shuffle[rows, place].astype(np.int64)
            shuffle[rows, place] = shuffle[rows, step]
        np.minimum.at(least, owner * slots + slot, offer)
        going = least.reshape(sets, slots).max(axis=1) >= step + 1
        stay = going[owner]
        value, owner = value[stay], owner[stay]
        if step == 0:
            shuffle = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(value), slots)).copy()
            shuffle[np.arange(len(value)), slot[stay]] = 0
        else:
            shuffle = shuffle[stay]
    return least.reshape(sets, slots)


SKETCH = "key long, n_shingles long, node binary, bands array<long>, signature binary"


def sketches(products: DataFrame, width: int, id: str, text: str) -> DataFrame:
    """Per row: id, a hash of the text, set size, digest of the set, band keys and signature."""
    kind = products.schema[id].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            texts = b.column("text").to_pylist()
            for begin, end in in_batches(texts, 1 << 20):
                values, bounds = shingle_sets(texts[begin:end], width)
                least = superminhash(values, bounds)
                bits = mix(least.view(np.uint64))
                keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], len(least), axis=0)
                for j in range(SLOTS // BANDS):
                    keys = mix(keys * np.uint64(31) + bits[:, j :: SLOTS // BANDS])
                short = (bits >> np.uint64(48)).astype(np.uint16)
                size = np.diff(bounds)
                digests = [hashlib.blake2b(values[i:j].tobytes(), digest_size=16).digest() for i, j in zip(bounds[:-1], bounds[1:])]
                held = [len(bands) if n else 0 for n, bands in zip(size, keys)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").slice(begin, end - begin),
                        b.column("key").slice(begin, end - begin),
                        pa.array(size, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.cumsum([0, *held]), pa.int32()), pa.array(keys.view(np.int64)[np.array(held) > 0].ravel())),
                        pa.array([s.tobytes() for s in short], pa.binary()),
                    ],
                    ["id", "key", "n_shingles", "node", "bands", "signature"],
                )

    texts = products.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    return texts.mapInArrow(sketch, f"id {kind}, {SKETCH}")


def full_sets(products: DataFrame, wanted: DataFrame, width: int, id: str, text: str) -> DataFrame:
    """node and its whole shingle set as bytes, for the wanted (node, _id, _key) texts."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for begin, end in in_batches(texts):
                values, bounds = shingle_sets(texts[begin:end], width)
                yield pd.DataFrame({"node": b["node"].iloc[begin:end].to_numpy(), "members": [values[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:])]})

    texts = products.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    chosen = texts.join(wanted, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("node", "text")
    return chosen.mapInPandas(build, "node binary, members binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have ``100 |a & b| >= percent |a | b|``."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = []
            for x, y in zip(p["of_a"], p["of_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield p.loc[keep, ["a", "b"]]

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("of_b")), "b")
    return with_b.join(sets.select(F.col("node").alias("a"), F.col("members").alias("of_a")), "a").mapInPandas(confirm, "a binary, b binary")


def _likely(rows: pd.DataFrame, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Open texts of a chunk pair, each with the texts it may be linked to, likeliest first.

    Pairs of one component are left out. Others go on if their signatures agree as much as those
    of linked texts do but for five deviations. A pair belongs to the first band it shares by the
    keys that buckets go by, and of two open texts the smaller one looks at the other.
    """
    p = percent / 100
    floor = SLOTS * p - 5 * (SLOTS * p * (1 - p)) ** 0.5
    left, right = np.flatnonzero(rows["open"]), np.flatnonzero(~rows["open"])
    if not len(left) or not len(right):
        return
    signatures, band = [np.frombuffer(s, np.uint16) for s in rows["signature"]], int(rows["band"].iloc[0])
    node, root, main = rows["node"].to_numpy(), rows["root"].to_numpy(), rows["main"].iloc[0]
    others, other_roots, other_nodes = np.stack([signatures[i] for i in right]), root[right], node[right]
    keys = rows["bands"].to_numpy()
    other_keys = np.stack([keys[i] for i in right])
    for i in left:
        agree = (signatures[i] == others).sum(axis=1)
        first = (keys[i] == other_keys).argmax(axis=1)
        ok = (agree >= floor) & (first == band) & (other_roots != root[i]) & ((other_roots == main) | (other_nodes > node[i]))
        found = np.flatnonzero(ok)
        if len(found):
            yield i, right[found[np.argsort(-agree[found], kind="stable")]]


def _in_question(percent: int):
    """The rows of a chunk pair that take part in a likely pair."""

    def pick(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        used = np.zeros(len(rows), bool)
        for i, found in _likely(rows, percent):
            used[i] = used[found] = True
        return rows[used]

    return pick


def _linking(percent: int):
    """Links of a chunk pair by full sets: for each open text one to every component it reaches."""

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sets = [np.frombuffer(m, np.uint64) for m in rows["members"]]
        node, root, out = rows["node"].to_numpy(), rows["root"].to_numpy(), []
        for i, found in _likely(rows, percent):
            own, reached = sets[i], set()
            while len(found):
                some, found = found[:32], found[32:]
                held = np.concatenate([sets[j] for j in some])
                at = np.minimum(np.searchsorted(own, held), len(own) - 1)
                sizes = np.array([len(sets[j]) for j in some])
                common = np.add.reduceat((own[at] == held).astype(np.int64), np.cumsum(sizes) - sizes)
                for j in some[100 * common >= percent * (len(own) + sizes - common)]:
                    if root[j] not in reached:
                        reached.add(root[j])
                        out.append((node[i], node[j]))
                if reached:
                    found = found[[root[j] not in reached for j in found]]
        return pd.DataFrame(out, columns=["a", "b"])

    return link


def near_duplicates(products: DataFrame, width: int = 5, percent: int = 80, id: str = "id", text: str = "description") -> DataFrame:
    """One row per product: ``id, n_shingles, component_id, kept``.

    Products are linked if the sets of their ``width``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more; ``component_id`` is the smallest id that links reach, its own
    included, ``kept`` whether it is the own one.

    Texts with one and the same set form a class, of which one goes on. SuperMinHash signatures
    are cut into bands; classes that share a band are candidates. Every bucket links its members
    to its first one, which is verified on full sets. Members that are left unconnected in a
    bucket are compared with its other components chunk by chunk, by signature and, where that
    leaves it open, on full sets; so no pair of a bucket goes unlooked at, and none within a
    component is looked at again. Union-find joins the links.

    A text without words, or missing, has no shingles and is linked with nothing; its component
    is its own id. Rows that repeat an id count as one product of several texts; a NULL id is
    never a component's name unless all its members have none. Further columns are ignored; an
    empty table gives no rows.
    """
    spark = products.sparkSession
    rows = stored(sketches(products, width, id, text), "sketches")
    tasks = 1 + (rows.agg(F.sum(F.col("n_shingles") + SLOTS)).head()[0] or 0) // TASK_VALUES  # small tables are not stored as many tiny files
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "key")).alias("first")
    classes = rows.where("n_shingles > 0").groupBy("node").agg(first, F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = stored(classes.coalesce(tasks), "classes")
    named = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = named.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(named.join(buckets, "bucket").coalesce(tasks), "buckets")
    wanted = members.select("node").distinct().join(classes, "node").select("node", F.col("first.id").alias("_id"), F.col("first.key").alias("_key"))
    sets = stored(full_sets(products, wanted, width, id, text).coalesce(tasks), "sets")
    free_shuffles(spark)
    stars = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(confirmed(stars, sets, percent).coalesce(tasks), "links")
    roots = connected_components(links)
    free_shuffles(spark)

    # buckets that hold more than one component
    placed = members.where("size > 2").join(roots, "node", "left").select("bucket", "band", "node", F.coalesce("root", "node").alias("root"))
    shares = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    split = (
        shares.groupBy("bucket")
        .agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
        .where("all > most")
        .select(
            "bucket",
            "main",
            F.ceil(F.col("all") / CHUNK).cast("int").alias("right_chunks"),
            F.ceil((F.col("all") - F.col("most")) / CHUNK).cast("int").alias("left_chunks"),
        )
    )
    unsettled = stored(placed.join(split, "bucket").join(classes.select("node", "signature", "bands"), "node").coalesce(tasks), "unsettled")
    if unsettled.head(1):
        kept = ["bucket", "band", "node", "root", "main", "signature", "bands"]
        chunk = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        apart = unsettled.where("root <> main")
        sides = apart.select(*kept, F.lit(True).alias("open"), chunk("left_chunks").alias("left"), every("right_chunks").alias("right")).unionByName(
            unsettled.select(*kept, F.lit(False).alias("open"), every("left_chunks").alias("left"), chunk("right_chunks").alias("right"))
        )
        pair = ["bucket", "left", "right"]
        asked = sides.groupBy(*pair).applyInPandas(_in_question(percent), sides.schema)
        more = asked.join(sets, "node").groupBy(*pair).applyInPandas(_linking(percent), "a binary, b binary")
        more = stored(more.distinct().coalesce(tasks), "links")
        if more.head(1):
            links = links.unionByName(more)
            roots = connected_components(links)
        free_shuffles(spark)

    in_component = classes.select("node", F.col("first.id").alias("least")).join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = in_component.groupBy("root").agg(F.min("least").alias("component_id"))
    component = in_component.join(least, "root").select("node", "component_id")
    result = rows.select("id", "n_shingles", "node").join(component, "node", "left")
    name = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return result.select("id", "n_shingles", name.alias("component_id"), F.col("id").eqNullSafe(name).alias("kept"))
