"""Finds benchmark questions in product descriptions, re-parameterised ones included."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.llm.common import in_batches, in_pieces, joined_bytes, mix, prefix_hash, span_hash, stored, word_bounds

WINDOW = 8  # tokens of a template window
MIN_LITERAL = 4  # of them not placeholders
MIN_COVER = 0.5  # share of a question's windows, or of the tokens under them, that must be found on one alignment
PASSAGE = 16  # windows in a row that are a leak whatever their share
FILTER_BITS = 23  # a fixed megabyte of Bloom filter, whatever the benchmark's size

NUMBER, NAME, UNIT = 1, 2, 3
# Units whose word becomes a placeholder when a number stands before it.
UNITS = (
    "mm cm m km inch inches in ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ton tons "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours h day days week weeks month months year years "
    "dollar dollars usd euro euros eur cent cents percent pct degree degrees c f watt watts w kw volt volts v kb mb gb tb byte bytes"
).split()

_OUTSIDE = np.ones(256, bool)
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    _OUTSIDE[ord(_first) : ord(_last) + 1] = False
_OUTSIDE[0x80:] = False
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_INNER = np.zeros(256, bool)
_INNER[[*b",."]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[*b" \t"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ENDS = np.zeros(256, bool)
_ENDS[[*b".!?:;\n\r\"'()[]{}|*#-"]] = True


def _word_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode("utf-8"), np.uint8)
    return span_hash(prefix_hash(data), np.array([0]), np.array([len(data)]))[0]


_UNIT_HASHES = np.sort(np.array([_word_hash(u) for u in UNITS], np.uint64))


def _lower_case(texts: list[str | None]) -> bytes:
    """The joined texts in lower case, byte for byte beside the originals.

    Where lower-casing changes a text's length, only A-Z of it are lower-cased.
    """
    out = []
    for t in texts:
        raw, low = (t or "").encode("utf-8"), (t or "").lower().encode("utf-8")
        out.append(low if len(low) == len(raw) else raw)
    return b"\n".join([*out, b""]) if out else b""


def _joined(start: np.ndarray, end: np.ndarray, goes_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens joined with those before them where ``goes_on`` says so."""
    return start[~goes_on], end[np.append(~goes_on[1:], True)] if len(end) else end


def _whole_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers with a comma or point between digits are one token."""
    goes_on = np.zeros(len(start), bool)
    last, first = end[:-1], start[1:]
    goes_on[1:] = (first == last + 1) & _INNER[data[last]] & _DIGIT[data[last - 1]] & _DIGIT[data[first]] & _DIGIT[data[start[:-1]]]
    return _joined(start, end, goes_on)


def _cut(own: np.ndarray, kind: np.ndarray, text: np.ndarray, window: int, literal: int) -> tuple[np.ndarray, np.ndarray]:
    """First tokens and hashes of the windows that lie in one text and hold enough literals."""
    shown = np.where(kind > 0, mix(kind.astype(np.uint64)), own)
    n = max(0, len(own) - window + 1)
    h = np.zeros(n, np.uint64)
    for j in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + shown[j : j + n]
    literals = np.cumsum(np.concatenate([[0], kind == 0]))
    whole = (text[:n] == text[window - 1 : window - 1 + n]) & (literals[window : window + n] - literals[:n] >= literal)
    first = np.flatnonzero(whole)
    return first, mix(h[first])


class Templates:
    """Template windows of some texts.

    Tokens are runs of letters and digits. One that begins with a digit is a number, together with
    further digits after a comma or point; a unit word after a number is a unit; capitalised words
    that no sentence end precedes and only blanks part are one name; all others stand for
    themselves, lower-cased. Placeholders hash by their type, and their own words become the
    window's slots. Windows that hold a name come a second time with its words as literals, not
    ``typed``, so that they equal those of a text whose names have lost their capitals.
    """

    def __init__(self, texts: list[str | None], window: int = WINDOW, literal: int = MIN_LITERAL) -> None:
        raw, begins = joined_bytes(texts)
        data = np.frombuffer(b"\n" + raw + b"\n", np.uint8)
        start, end = _whole_numbers(data, *word_bounds(data, _OUTSIDE))
        prefix = prefix_hash(_LOWER[np.frombuffer(b"\n" + _lower_case(texts) + b"\n", np.uint8)])
        self.own = span_hash(prefix, start, end)
        text = np.searchsorted(begins + 1, start, side="right") - 1
        kind = np.zeros(len(start), np.uint8)
        kind[_DIGIT[data[start]]] = NUMBER
        after_number = np.zeros(len(start), bool)
        after_number[1:] = (kind[:-1] == NUMBER) & (text[1:] == text[:-1])
        at = np.minimum(np.searchsorted(_UNIT_HASHES, self.own), len(_UNIT_HASHES) - 1)
        kind[after_number & (_UNIT_HASHES[at] == self.own) & (kind == 0)] = UNIT
        ends = np.cumsum(_ENDS[data])
        before = np.concatenate([[0], end[:-1]]) if len(start) else end
        sentence_start = (ends[np.maximum(start - 1, 0)] - ends[np.maximum(before - 1, 0)]) > 0
        # a single capital or capitals throughout are no sign of a name
        second = data[np.minimum(start + 1, len(data) - 1)]
        kind[(kind == 0) & _UPPER[data[start]] & ~_UPPER[second] & ~_OUTSIDE[second] & ~sentence_start] = NAME
        # names of several words are one token
        blanks = np.cumsum(~_BLANK[data])
        goes_on = np.zeros(len(start), bool)
        goes_on[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME) & (blanks[start[1:] - 1] == blanks[end[:-1] - 1])
        apart, place = (self.own, np.where(kind == NAME, 0, kind).astype(np.uint8), text), np.cumsum(~goes_on) - 1
        named = np.cumsum(np.concatenate([[0], kind == NAME]))
        start, end = _joined(start, end, goes_on)
        kind, text = kind[~goes_on], text[~goes_on]
        typed = (span_hash(prefix, start, end), kind, text)
        opens = np.searchsorted(text, np.arange(len(texts)))
        first, typed_hash = _cut(*typed, window, literal)
        second, apart_hash = _cut(*apart, window, literal)
        holds_name = named[second + window] > named[second] if len(second) else np.zeros(0, bool)
        second, apart_hash = second[holds_name], apart_hash[holds_name]
        self.views = (typed, apart)
        self.first = np.concatenate([first, second])  # a window's first token in its view
        self.hash = np.concatenate([typed_hash, apart_hash])
        self.typed = np.arange(len(self.first)) < len(first)
        self.text = np.concatenate([text[first], apart[2][second]])
        # places count names as one token in either view
        self.place = np.concatenate([first, place[second]]) - opens[self.text] if len(self.first) else self.first
        self.window = window

    def slots(self, row: int) -> list[int]:
        """The placeholders' own words in a window, as hashes."""
        own, kind, _ = self.views[0 if self.typed[row] else 1]
        inside = slice(self.first[row], self.first[row] + self.window)
        return own[inside][kind[inside] > 0].view(np.int64).tolist()


WINDOW_SCHEMA = "window long, place int, typed boolean, slots array<long>"


def _windows(df: DataFrame, id: str, text: str, window: int, literal: int, bloom: np.ndarray | None = None) -> DataFrame:
    kind = df.schema[id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            texts = b.column("text").to_pylist()
            for begin, end in in_batches(texts):
                t = Templates(texts[begin:end], window, literal)
                rows = np.arange(len(t.hash)) if bloom is None else np.flatnonzero(in_filter(bloom, t.hash))
                if not len(rows):
                    continue
                of = pa.array(begin + t.text[rows])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").take(of),
                        b.column("key").take(of),
                        pa.array(t.hash[rows].view(np.int64)),
                        pa.array(t.place[rows].astype(np.int32)),
                        pa.array(t.typed[rows].astype(bool)),
                        pa.array([t.slots(r) for r in rows], pa.list_(pa.int64())),
                    ],
                    ["id", "key", "window", "place", "typed", "slots"],
                )

    texts = df.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    return texts.mapInArrow(cut, f"id {kind}, key long, {WINDOW_SCHEMA}")


SHORTEST = 4  # tokens of a question that is looked for as a whole


def _whole_runs(df: DataFrame, id: str, text: str, lengths: list[int] | None, bloom: np.ndarray | None = None) -> DataFrame:
    """Runs of tokens as they are, lower-cased: of whole texts, or of all runs of the given lengths."""
    kind = df.schema[id].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            texts = b.column("text").to_pylist()
            for begin, end in in_batches(texts):
                raw, begins = joined_bytes(texts[begin:end])
                data = np.frombuffer(b"\n" + raw + b"\n", np.uint8)
                first, last = _whole_numbers(data, *word_bounds(data, _OUTSIDE))
                prefix = prefix_hash(_LOWER[np.frombuffer(b"\n" + _lower_case(texts[begin:end]) + b"\n", np.uint8)])
                own, of = span_hash(prefix, first, last), np.searchsorted(begins + 1, first, side="right") - 1
                counts = np.bincount(of, minlength=end - begin)
                starts = np.cumsum(counts) - counts
                for n in sorted(set(counts.tolist())) if lengths is None else lengths:
                    at = starts[counts == n] if lengths is None else np.arange(max(0, len(own) - n + 1))
                    at = at[of[at] == of[at + n - 1]] if n and len(at) else at[:0]
                    h = np.full(len(at), n, np.uint64)
                    for j in range(n):
                        h = mix(h * np.uint64(3) + own[at + j])
                    at, h = (at, h) if bloom is None else (at[in_filter(bloom, h)], h[in_filter(bloom, h)])
                    if not len(at):
                        continue
                    rows = pa.array(begin + of[at])
                    size = pa.array(np.full(len(at), n), pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("key").take(rows), pa.array(h.view(np.int64)), size], ["id", "key", "window", "tokens"])

    texts = df.select(F.col(id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("key"), F.col(text).alias("text"))
    return texts.mapInArrow(cut, f"id {kind}, key long, window long, tokens int")


def find_whole_questions(products: DataFrame, questions: DataFrame, id: str, text: str, question_id: str, question_text: str) -> DataFrame:
    """``id, _key, question_id`` of texts that hold all tokens of a question in a row, in any case."""
    asked = stored(_whole_runs(questions, question_id, question_text, None).where(F.col("tokens") >= SHORTEST), "short-questions")
    lengths = [r["tokens"] for r in asked.select("tokens").distinct().orderBy("tokens").collect()]
    if not lengths:
        return products.select(F.col(id).alias("id"), F.lit(0).cast("long").alias("_key"), F.lit(None).cast(questions.schema[question_id].dataType).alias("question_id")).limit(0)
    held = _whole_runs(products, id, text, lengths, bloom_filter(asked))
    wanted = asked.select(F.col("id").alias("question_id"), "window", "tokens").distinct()
    return held.join(wanted, ["window", "tokens"]).select("id", F.col("key").alias("_key"), "question_id").distinct()


def bloom_filter(windows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of ``2^bits`` bits over window hashes; tasks fill their own, which are joined."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(1 << bits, bool)
        for b in batches:
            for spot in _spots(b["window"].to_numpy(np.int64).view(np.uint64), bits):
                held[spot] = True
        yield pd.DataFrame({"bits": [np.packbits(held).tobytes()]})

    filled = windows.select("window").coalesce(8).mapInPandas(fill, "bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in filled.toLocalIterator():
        out |= np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(out).astype(bool)


def _spots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h >> np.uint64(64 - bits)).astype(np.int64), ((h >> np.uint64(8)) & np.uint64((1 << bits) - 1)).astype(np.int64)]


def in_filter(held: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits = int(np.log2(len(held)))
    first, second = _spots(h, bits)
    return held[first] & held[second]


def _spanned(at: Column, window: int) -> Column:
    """How many tokens lie under windows at these places (sorted)."""
    gaps = F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window))))
    return F.aggregate(gaps, F.lit(0), lambda s, n: s + n)


def _in_a_row(at: Column) -> Column:
    """How many of the places (sorted) follow each other without a gap, at most."""
    start = F.struct(F.lit(-2).alias("last"), F.lit(0).alias("row"), F.lit(0).alias("most"))

    def step(s: Column, p: Column) -> Column:
        row = F.when(p == s["last"] + 1, s["row"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("last"), row.alias("row"), F.greatest(s["most"], row).alias("most"))

    return F.aggregate(at, start, step)["most"]


def find_questions(
    products: DataFrame,
    questions: DataFrame,
    window: int = WINDOW,
    literal: int = MIN_LITERAL,
    cover: float = MIN_COVER,
    id: str = "id",
    text: str = "description",
    question_id: str = "id",
    question_text: str = "description",
) -> DataFrame:
    """Questions found in products: one row per product text and question.

    Numbers, names and units of both sides become typed placeholders; windows that hold a name
    are also cut with its words as literals, as text in lower case or capitals has them. Template windows of
    ``window`` tokens, ``literal`` of them literal, are joined by hash; a Bloom filter of fixed
    size keeps most windows of the products out of the join. Joined windows of one product,
    question and offset form a piece. Its slots must agree: each of the question's values always
    stands for one and the same value of the product, and the other way round. Pieces whose
    offsets differ by up to half the question's length, as inserted and deleted words make them,
    form an alignment. It counts if it holds at least the share ``cover`` of the question's
    windows or of the tokens under them, or a piece of ``PASSAGE`` windows in a row. Windows at one
    place count once; shares are taken of the typed windows and of all, and the larger one counts.

    Returns ``id, _key, question_id, n_windows, coverage, changed``: at how many places
    of the question the best alignment holds a window, the largest of its shares, and how many of its slot
    values differ from the question's. ``_key`` is a
    hash of the text. A question without windows, having too few tokens or literals, is found where
    all its tokens stand in a row, if these are ``SHORTEST`` or more; it counts as one window. Missing and
    empty texts hold none and are found nowhere. Rows that repeat id and text count once. Further columns
    are ignored; ids may be NULL; without products or questions there are no rows.
    """
    text_column = text
    asked = stored(_windows(questions, question_id, question_text, window, literal), "question-windows")
    asked = asked.select(F.col("id").alias("question_id"), F.col("key").alias("_question"), "window", F.col("place").alias("asked_at"), F.col("typed").alias("asked_typed"), F.col("slots").alias("asked"))
    held = _windows(products, id, text, window, literal, bloom_filter(asked)).withColumnRenamed("key", "_key")
    places = (F.sort_array(F.collect_set("asked_at")).alias("at"), F.sort_array(F.collect_set(F.when(F.col("asked_typed"), F.col("asked_at")))).alias("typed_at"))
    sizes = asked.groupBy("question_id", "_question").agg(*places)
    sizes = sizes.select(
        F.col("question_id").alias("_q"), F.col("_question").alias("_k"), F.struct("at", "typed_at").alias("of"),
        F.greatest(F.lit(window), F.ceil((F.array_max("at") + window) / 2)).cast("int").alias("half"),
    )
    pairs = held.join(asked, "window").select(
        "id", "_key", "question_id", "_question", "asked_at", "asked_typed", (F.col("place") - F.col("asked_at")).alias("offset"), F.arrays_zip("asked", "slots").alias("slots")
    )
    text, pair = ["id", "_key"], ["question_id", "_question"]
    pieces = pairs.groupBy(*text, *pair, "offset").agg(
        *places, F.array_distinct(F.flatten(F.collect_set("slots"))).alias("values")
    )
    one_to_one = (F.size(F.array_distinct(F.col("values.asked"))) == F.size("values")) & (F.size(F.array_distinct(F.col("values.slots"))) == F.size("values"))
    sized = pieces.where(one_to_one).join(sizes, F.col("question_id").eqNullSafe(F.col("_q")) & (F.col("_question") == F.col("_k")))
    # bands of offsets twice as wide as the drift begin at each half of them: what drifts less shares a band
    band = F.floor(F.col("offset") / F.col("half"))
    aligned = (
        sized.withColumn("band", F.explode(F.array(band, band - 1)))
        .groupBy(*text, *pair, "band")
        .agg(
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"),
            F.sort_array(F.array_distinct(F.flatten(F.collect_list("typed_at")))).alias("typed_at"),
            F.array_distinct(F.flatten(F.collect_list("values"))).alias("values"),
            F.max(_in_a_row(F.col("at"))).alias("row"),
            F.first("of").alias("of"),
        )
    )
    # a question without typed windows has no share of them
    parts = [(F.col(c), F.col(f"of.{c}")) for c in ("at", "typed_at")]
    shares = F.greatest(*[F.when(F.size(of) > 0, f(at) / f(of)) for at, of in parts for f in (F.size, lambda c: _spanned(c, window))])
    changed = F.size(F.filter("values", lambda v: v["asked"] != v["slots"])).cast("long")
    best = F.max(F.struct("coverage", F.size("at").cast("long").alias("n_windows"), (-changed).alias("same")))
    found = (
        aligned.withColumn("coverage", shares)
        .where((F.col("coverage") >= cover) | (F.col("row") >= PASSAGE))
        .groupBy(*text, "question_id")
        .agg(best.alias("best"))
        .select(*text, "question_id", "best.n_windows", "best.coverage", (-F.col("best.same")).alias("changed"))
    )
    key = F.xxhash64(F.coalesce(F.col(question_text), F.lit("")))
    short = questions.join(sizes, F.col(question_id).eqNullSafe(F.col("_q")) & (key == F.col("_k")), "left_anti")
    whole = find_whole_questions(products, short, id, text_column, question_id, question_text)
    one = whole.select(*text, "question_id", F.lit(1).cast("long").alias("n_windows"), F.lit(1.0).alias("coverage"), F.lit(0).cast("long").alias("changed"))
    return found.unionByName(one)
