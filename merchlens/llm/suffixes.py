"""Removes byte strings that product descriptions repeat, by blockwise sorted suffix buckets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from merchlens.llm.common import free_shuffles, mix, partitions, prefix_hash, release, span_hash, stored

WIDTH = 100
# A difference cover: any two residues modulo PERIOD are met by one shift of up to PERIOD - 1.
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
PACK_BYTES = 2 << 20
PACK_TEXTS = 65_535
BUCKET_SAMPLES = 1 << 21
PASSES = 6

_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True
PACK = "pack long, ids array<long>, missing array<boolean>, keys array<long>, sizes array<int>, data binary"
PART = "pack long, bucket long, payload binary"


# --- packs of texts ----------------------------------------------------------------------


def pack_texts(products: DataFrame, id: str, text: str) -> DataFrame:
    """Rows of about ``PACK_BYTES`` of whole texts, compressed, ordered by id within a pack.

    A text longer than that is a pack of its own. Every later step reads packs, so that a
    pack's part in it never depends on how files are split.
    """
    if not isinstance(products.schema[id].dataType, IntegralType):
        raise TypeError(f"ids order products and are whole numbers here, not {products.schema[id].dataType.simpleString()}")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def full() -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            raw = [r[2] for r in rows]
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(raw))
            values = [number, [r[0] or 0 for r in rows], [r[0] is None for r in rows], [r[1] for r in rows], [len(b) for b in raw], data]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], ["pack", "ids", "missing", "keys", "sizes", "data"])

        for b in batches:
            for key, value, content in zip(*(b.column(c).to_pylist() for c in ("id", "key", "text"))):
                content = (content or "").encode("utf-8")
                if rows and (size + len(content) > PACK_BYTES or len(rows) == PACK_TEXTS):
                    yield full()
                    number, rows, size = number + 1, [], 0
                rows.append((key, value, content))
                size += len(content)
        if rows:
            yield full()

    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    texts = products.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    return texts.mapInArrow(pack, PACK)


class Pack:
    """The bytes of a pack's texts one after another, with running hashes."""

    def __init__(self, data: bytes, sizes: list[int]) -> None:
        self.sizes = np.asarray(sizes, np.int64)
        raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(self.sizes.sum()))) if self.sizes.sum() else b""
        self.data = np.frombuffer(raw, np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.prefix = prefix_hash(self.data)

    def samples(self) -> np.ndarray:
        """Cover samples: where ``WIDTH - PERIOD + 1`` bytes are named, in texts that can hold a match."""
        long = np.flatnonzero(self.sizes >= WIDTH)
        if not len(long):
            return np.zeros(0, np.int64)
        counts = self.sizes[long] - (WIDTH - PERIOD)
        local = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        chosen = np.flatnonzero(_IN_COVER[local % PERIOD])
        return local[chosen] + np.repeat(self.starts[long], counts)[chosen]

    def sample_names(self, at: np.ndarray) -> np.ndarray:
        return span_hash(self.prefix, at, at + (WIDTH - PERIOD + 1))

    def candidates(self, live: np.ndarray) -> np.ndarray:
        """Starts of ``WIDTH``-byte strings that hold a live sample within their first ``PERIOD`` bytes."""
        change = np.zeros(len(self.data) + 1, np.int32)
        text = np.searchsorted(self.ends, live, side="right")
        change += np.bincount(np.maximum(self.starts[text], live - (PERIOD - 1)), minlength=len(change)).astype(np.int32)
        change[live + 1] -= 1
        at = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        return at[at + WIDTH <= self.ends[np.searchsorted(self.ends, at, side="right")]]


def group_equal(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first of each distinct value, by rising value, and each element's group.

    Values are sorted together with their index in one word; only if two different values share
    all the bits kept of them, or there are too many, the plain sort is used.
    """
    if 0 < len(h) <= 1 << 22:
        low = np.uint64((1 << 22) - 1)
        order = (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
        seen = h[order]
        new = np.ones(len(h), bool)
        new[1:] = seen[1:] != seen[:-1]
        if not (new[1:] & ((seen[1:] & ~low) == (seen[:-1] & ~low))).any():
            group = np.empty(len(h), np.int64)
            group[order] = np.cumsum(new) - 1
            return order[new], group
    _, first, group = np.unique(h, return_index=True, return_inverse=True)
    return first, group


def group_names(pack: Pack, at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`group_equal` of the strings at some places, by their names and check bits together."""
    first, group = group_equal(names)
    check = _check(pack, at)
    if (check != check[first][group]).any():
        pairs = np.stack([names, check.astype(np.uint64)], axis=1)
        _, first, group = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
        group = group.ravel()
    return first, group


# --- cover samples -----------------------------------------------------------------------


def _bucket_rows(pack: int, names: np.ndarray, bits: int, payload, lo: int, hi: int) -> list[tuple]:
    """Cuts sorted ``names`` at bucket borders lo .. hi: (pack, bucket, payload of the slice)."""
    edges = np.searchsorted(names >> np.uint64(64 - bits), np.arange(lo, hi + 1, dtype=np.uint64))
    return [(pack, lo + i, payload(slice(a, b))) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]


def _emit_samples(bits: int):
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, data, sizes in zip(b["pack"], b["data"], b["sizes"]):
                pack = Pack(data, sizes)
                names = pack.sample_names(pack.samples())
                first, _ = group_equal(names)
                names = names[first]
                short = ((names << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
                yield pd.DataFrame(_bucket_rows(number, names, bits, lambda s: short[s].tobytes(), 0, 1 << bits), columns=["pack", "bucket", "payload"])

    return emit


def _shared_samples(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Which names of one bucket occur in more than one pack: a bit each."""
    parts = [np.frombuffer(p, np.uint32) for p in rows["payload"]]
    names = np.concatenate(parts)
    ordered = np.sort(names)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    shared = np.isin(names, again, kind="sort")
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return pd.DataFrame({"pack": rows["pack"], "bucket": rows["bucket"], "payload": [np.packbits(s).tobytes() for s in np.split(shared, cuts)]})


def _bits_of(buckets: list[int], payloads: list[bytes], names: np.ndarray, bits: int) -> np.ndarray:
    """The bits that came back for sorted ``names``, bucket by bucket; absent buckets are False."""
    out = np.zeros(len(names), bool)
    edges = np.searchsorted(names >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    for bucket, payload in zip(buckets, payloads):
        a, b = edges[bucket], edges[bucket + 1]
        out[a:b] = np.unpackbits(np.frombuffer(payload, np.uint8), count=int(b - a)).astype(bool)
    return out


def _with_runs(bits: int):
    """Adds a pack's candidate runs: starts and ends of the stretches of positions to be sorted."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            runs = []
            for data, sizes, buckets, payloads in zip(b["data"], b["sizes"], b["buckets"], b["payloads"]):
                pack = Pack(data, sizes)
                at = pack.samples()
                names = pack.sample_names(at)
                first, group = group_equal(names)
                live = np.bincount(group, minlength=len(first)) > 1
                if buckets is not None:
                    live |= _bits_of(buckets, payloads, names[first], bits)
                found = pack.candidates(at[live[group]])
                breaks = np.flatnonzero(np.diff(found) != 1)
                runs.append(np.stack([found[np.r_[0, breaks + 1]], found[np.r_[breaks, len(found) - 1]] + 1]).T.ravel().astype(np.int32) if len(found) else [])
            yield b[["pack", "ids", "missing", "keys", "sizes", "data"]].assign(runs=runs)

    return find


def _positions(runs: np.ndarray) -> np.ndarray:
    runs = np.asarray(runs, np.int64).reshape(-1, 2)
    sizes = runs[:, 1] - runs[:, 0]
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(runs[:, 0], sizes)


# --- suffix buckets ----------------------------------------------------------------------


def _check(pack: Pack, at: np.ndarray) -> np.ndarray:
    """32 further bits of each candidate's name, from its two halves' hashes in the other order."""
    half = WIDTH // 2
    return (mix(span_hash(pack.prefix, at + half, at + WIDTH) * np.uint64(3) + span_hash(pack.prefix, at, at + half)) >> np.uint64(32)).astype(np.uint32)


def _emit_suffixes(bits: int, lo: int, hi: int):
    """The distinct candidates of a pack in buckets lo .. hi - 1: name, check bits and text of the first."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                if not len(row.runs):
                    continue
                pack, at = Pack(row.data, row.sizes), _positions(row.runs)
                names = span_hash(pack.prefix, at, at + WIDTH)
                bucket = names >> np.uint64(64 - bits)
                inside = np.flatnonzero((bucket >= lo) & (bucket < hi))
                if not len(inside):
                    continue
                first, _ = group_names(pack, at[inside], names[inside])
                at, names = at[inside][first], names[inside][first]
                check = _check(pack, at)
                text = np.searchsorted(pack.ends, at, side="right")

                def payload(s: slice) -> bytes:
                    held, ordinal = np.unique(text[s], return_inverse=True)
                    missing, known = np.asarray(row.missing, np.uint8)[held], np.asarray(row.ids, np.int64)[held]
                    keys = np.asarray(row.keys, np.int64)[held]
                    head = np.array([len(held)], np.int64)
                    return b"".join(x.tobytes() for x in (head, missing, known, keys, names[s], check[s], ordinal.astype(np.uint16)))

                yield pd.DataFrame(_bucket_rows(row.pack, names, bits, payload, lo, hi), columns=["pack", "bucket", "payload"])

    return emit


def _later_suffixes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Sorts one bucket and marks, a bit each, all but the first text's of equal suffixes."""
    texts, names, checks, owners, counts, done = [], [], [], [], [], 0
    for pack, p in zip(rows["pack"], rows["payload"]):
        t = int(np.frombuffer(p, np.int64, 1)[0])
        at = 8
        missing, at = np.frombuffer(p, np.uint8, t, at), at + t
        known, at = np.frombuffer(p, np.int64, t, at), at + 8 * t
        keys, at = np.frombuffer(p, np.int64, t, at), at + 8 * t
        n = (len(p) - at) // 14
        names.append(np.frombuffer(p, np.uint64, n, at))
        checks.append(np.frombuffer(p, np.uint32, n, at + 8 * n))
        owners.append(np.frombuffer(p, np.uint16, n, at + 12 * n).astype(np.int64) + done)
        texts.append((missing, known, keys, np.full(t, pack)))
        counts.append(n)
        done += t
    missing, known, keys, packs = (np.concatenate(x) for x in zip(*texts))
    place = np.empty(done, np.int64)
    place[np.lexsort((np.arange(done), packs, keys, known, missing))] = np.arange(done)
    name, check, owner = np.concatenate(names), np.concatenate(checks), place[np.concatenate(owners)]
    order = np.argsort(name)
    same = name[order][1:] == name[order][:-1]
    if (same & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, name))
    new = np.ones(len(order), bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (check[order][1:] != check[order][:-1])
    starts = np.flatnonzero(new)
    earliest = np.repeat(np.minimum.reduceat(owner[order], starts), np.diff(np.append(starts, len(order))))
    later = np.empty(len(order), bool)
    later[order] = owner[order] > earliest
    cut = np.split(later, np.cumsum(counts)[:-1])
    return pd.DataFrame({"pack": rows["pack"], "bucket": rows["bucket"], "payload": [np.packbits(c).tobytes() for c in cut]})


def _cut_texts(bits: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                pack = Pack(row.data, row.sizes)
                gone = np.zeros(len(pack.data) + 1, bool)
                if len(row.runs):
                    at = _positions(row.runs)
                    names = span_hash(pack.prefix, at, at + WIDTH)
                    first, group = group_names(pack, at, names)
                    later = np.zeros(len(first), bool)
                    if row.buckets is not None:
                        later = _bits_of(row.buckets, row.payloads, names[first], bits)
                    copy = np.ones(len(at), bool)
                    copy[first] = later
                    change = np.zeros(len(pack.data) + 1, np.int32)
                    change[at[copy]] += 1
                    change[at[copy] + WIDTH] -= 1
                    gone = np.cumsum(change) > 0
                rows = []
                for i, (begin, end) in enumerate(zip(pack.starts, pack.ends)):
                    out = gone[begin:end]
                    spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
                    rows.append((int(end - begin), int(out.sum()), spans, pack.data[begin:end][~out].tobytes()))
                frame = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
                yield frame.assign(id=pd.arrays.IntegerArray(np.array(row.ids, np.int64), np.array(row.missing, bool)))

    return cut


def _returned(rows: DataFrame, label: str) -> DataFrame:
    """Rows (pack, bucket, bits) gathered per pack, stored: a few bits per candidate."""
    return stored(rows, label)


def _per_pack(rows: DataFrame) -> DataFrame:
    gathered = rows.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("bucket", "payload"))).alias("r"))
    return gathered.select("pack", F.col("r.bucket").alias("buckets"), F.col("r.payload").alias("payloads"))


def remove_repeats(products: DataFrame, id: str = "id", text: str = "description", passes: int = PASSES) -> DataFrame:
    """One row per product: its description without byte strings that occur earlier.

    A byte goes if it is covered by a ``WIDTH``-byte string that also starts earlier: in a product
    of smaller id, or earlier in the same text. Overlaps count; strings are judged on the input.
    Returns ``id, n_bytes, n_removed, n_spans, kept``: UTF-8 bytes, those removed, their maximal
    runs, and the bytes that stay.

    Difference-cover blockwise construction in its outline: samples at the positions of a difference
    cover are named, two equal strings have equal samples at a common shift, so only strings around a
    sample name that occurs twice can repeat; those suffixes are dealt to buckets, and a group of
    buckets is sorted at a time, ``passes`` in all, which bounds disk and memory. Names are hashes,
    though, not ranks: a name of 96 bits (from hashes of the string and of its halves) stands for the
    string, within a pack as between packs, and buckets go by name. What comes back is one bit per
    suffix.
    A pack of texts counts a string once, so that a string most texts hold is few rows.

    A missing text is empty; texts shorter than ``WIDTH`` stay whole. Products without an id come
    last; ids are whole numbers, others are refused; products that share one follow each other by a hash of the text; equal rows by their place
    in the input, each with its own result. Further columns are ignored; an empty
    table gives no rows.
    """
    spark = products.sparkSession
    packs = stored(pack_texts(products, id, text), "packs")
    size = packs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    wanted = max(2 * partitions(spark), passes, size * len(COVER) // PERIOD // BUCKET_SAMPLES)
    bits = max(1, int(wanted - 1).bit_length())

    shared = packs.mapInPandas(_emit_samples(bits), PART).groupBy("bucket").applyInPandas(_shared_samples, PART)
    shared = _returned(shared, "samples")
    free_shuffles(spark)
    runs = packs.join(_per_pack(shared), "pack", "left").mapInPandas(_with_runs(bits), f"{PACK}, runs array<int>")
    runs = stored(runs, "runs")
    release(packs)
    free_shuffles(spark)

    later, step = [], -(-(1 << bits) // passes)
    for lo in range(0, 1 << bits, step):
        sent = runs.mapInPandas(_emit_suffixes(bits, lo, min(lo + step, 1 << bits)), PART)
        later.append(_returned(sent.groupBy("bucket").applyInPandas(_later_suffixes, PART), "suffixes"))
        free_shuffles(spark)
    bits_of = later[0]
    for more in later[1:]:
        bits_of = bits_of.unionByName(more)
    kept = runs.join(_per_pack(bits_of), "pack", "left").mapInPandas(_cut_texts(bits), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return kept.withColumn("id", F.col("id").cast(products.schema[id].dataType))
