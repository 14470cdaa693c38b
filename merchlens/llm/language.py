"""Language of product descriptions by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.llm.common import in_batches, in_pieces, joined_bytes, mix, prefix_hash, span_hash, word_bounds

PER_LANGUAGE = 250  # labelled rows a language is learned from, by their first MOST_CHARS characters
MOST_CHARS = 20_000
LABELLED_CHARS = 1 << 20  # texts that are labelled together, which bounds a worker's arrays
EPOCHS = 5
STEP = 1024  # words of a block; blocks of one text are joined by their transfer matrices
UNDETERMINED = "und"

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[ord("a") : ord("z") + 1] = False
_OUTSIDE[0x80:] = False
# first index and bits of each feature group: trigrams, prefixes, suffixes, lexicon
_BITS = (17, 15, 15, 18)
_BASE = np.concatenate([[0], np.cumsum([1 << b for b in _BITS])])
_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


@dataclass
class Words:
    """Words of some texts: each one's text, and its features as indices into the weights."""

    text: np.ndarray  # per word
    grams: np.ndarray  # per byte of a word: the trigram around it, blank beyond the word
    first: np.ndarray  # per word, its first row in ``grams``
    single: np.ndarray  # per word, (words, 3): prefix, suffix, lexicon entry


def _bucket(h: np.ndarray, group: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - _BITS[group])).astype(np.int64) + _BASE[group]


def words_of(texts: list[str | None]) -> Words:
    """Cuts texts into runs of letters (a-z and all beyond ASCII, lower-cased) with their features."""
    raw, begins = joined_bytes([(t or "").lower() for t in texts])
    data = np.frombuffer(b"\n" + raw + b"\n\n", np.uint8)
    start, end = word_bounds(data, _OUTSIDE)
    shown = np.where(_OUTSIDE[data], 0, data).astype(np.uint32)
    around = (shown[:-2] << np.uint32(16)) | (shown[1:-1] << np.uint32(8)) | shown[2:]
    around = around[shown[1:-1] > 0] * np.uint32(2654435761)
    grams = (around >> np.uint32(32 - _BITS[0])).astype(np.int32)
    prefix = prefix_hash(data)
    single = np.empty((len(start), 3), np.int64)
    single[:, 0] = _bucket(span_hash(prefix, start, np.minimum(start + 4, end)), 1)
    single[:, 1] = _bucket(span_hash(prefix, np.maximum(end - 4, start), end), 2)
    single[:, 2] = _bucket(span_hash(prefix, start, end), 3)
    first = np.zeros(len(start), np.int64)
    np.cumsum((end - start)[:-1], out=first[1:]) if len(start) else None
    return Words(np.searchsorted(begins + 1, start, side="right") - 1, grams, first, single)


def emissions(words: Words, weights: np.ndarray) -> np.ndarray:
    """Score of each word in each language: the sum of its features' weights."""
    if not len(words.first):
        return np.zeros((0, weights.shape[1]), np.float32)
    out = weights[words.single[:, 0]] + weights[words.single[:, 1]] + weights[words.single[:, 2]]
    return out + np.add.reduceat(weights[words.grams], words.first, axis=0)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language marginals of each word, and the expected number of transitions.

    ``scores`` holds the words of all sequences one after another. Sequences are cut into blocks
    of ``STEP`` words. Blocks of longer sequences first work out their transfer matrix side by
    side, then each sequence passes messages from block to block, then all blocks fill in their
    words; so the number of steps does not grow with the longest text.
    """
    k = scores.shape[1]
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros((0, k)), np.zeros((k, k))
    per = -(-lengths // STEP)
    leader = np.cumsum(per) - per
    place = np.arange(int(per.sum())) - np.repeat(leader, per)  # a block's place in its sequence
    sequence = np.repeat(np.arange(len(lengths)), per)
    used = np.minimum(STEP, lengths[sequence] - place * STEP)
    # blocks by falling length: those with a word at step t are the first live[t]
    order = np.argsort(-used, kind="stable")
    row = np.empty(len(order), np.int64)
    row[order] = np.arange(len(order))
    steps = int(used.max())
    live = np.searchsorted(-used[order], -np.arange(steps), side="left")
    opening = place[order] == 0
    word_row = np.repeat(row, used)
    word_step = np.arange(len(scores)) - np.repeat(np.cumsum(used) - used, used)
    e = np.ones((steps, len(order), k), np.float32)
    e[word_step, word_row] = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(transitions).astype(np.float32)
    a /= a.sum()

    def forward(f: np.ndarray, rows: np.ndarray, width: int, out: np.ndarray | None = None) -> np.ndarray:
        """Advances messages (rows x width, k) through their blocks."""
        f = f.reshape(len(rows), width, k)
        for t in range(int(used[order[rows[0]]]) if len(rows) else 0):
            n = np.searchsorted(rows, live[t])
            moved = f[:n] @ a
            if t == 0:
                moved = np.where(opening[rows[:n], None, None], f[:n], moved)
            moved *= e[t][rows[:n], None, :] if out is None else e[t, :n, None, :]
            f[:n] = moved / moved.sum(axis=(1, 2), keepdims=True)
            if out is not None:
                out[t, :n] = f[:n, 0]
        return f

    into, beyond = np.full((len(order), k), 1.0 / k, np.float32), np.ones((len(order), k), np.float32)
    longest = int(per.max())
    if longest > 1:
        rows = np.flatnonzero(per[sequence[order]] > 1)
        eye = np.broadcast_to(np.eye(k, dtype=np.float32), (len(rows), k, k)).copy()
        transfer = np.empty((len(order), k, k), np.float32)
        transfer[rows] = forward(eye, rows, k)
        for at in range(1, longest):
            here = leader[per > at] + at
            message = np.einsum("bi,bij->bj", into[row[here - 1]], transfer[row[here - 1]])
            into[row[here]] = message / message.sum(axis=1, keepdims=True)
        for at in range(longest - 1, 0, -1):
            here = leader[per > at] + at
            message = np.einsum("bij,bj->bi", transfer[row[here]], beyond[row[here]])
            beyond[row[here - 1]] = message / message.sum(axis=1, keepdims=True)

    alpha = np.empty_like(e)
    forward(into.copy(), np.arange(len(order)), 1, alpha)
    g, switches = beyond, np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        n = live[t]
        ahead = e[t, :n] * g[:n]
        before, inner = (alpha[t - 1, :n], ahead) if t else (into[:n][~opening[:n]], ahead[~opening[:n]])
        if len(inner):
            moved = inner @ a.T
            total = np.einsum("bi,bi->b", before, moved)[:, None]
            switches += a * (np.maximum(before / total, 0).T @ inner)
        alpha[t, :n] *= g[:n]
        back = ahead @ a.T
        g[:n] = back / back.sum(axis=1, keepdims=True)
    marginal = alpha[word_step, word_row]
    return marginal / marginal.sum(axis=1, keepdims=True), switches


@dataclass
class Model:
    """Languages in order, and the learned weights of features and transitions."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray


def fit(texts: list[str], languages: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Learns feature weights and transitions by stochastic gradient ascent of the likelihood.

    Each text's words are labelled with its language. Texts are cut into spans of 4 to 60 words
    that are shuffled and strung together, so that the sequences learned from switch languages.
    """
    names = sorted(set(languages))
    k, rng = len(names), np.random.default_rng(seed)
    model = Model(names, np.zeros((int(_BASE[-1]), k), np.float32), np.eye(k))
    if k < 2:
        return model
    words = words_of(texts)
    label = np.array([names.index(v) for v in languages])[words.text]
    n = len(label)
    if not n:
        return model
    grown = np.full(model.weights.shape, 1e-2, np.float32)
    byte_count = np.diff(np.append(words.first, len(words.grams)))
    grown_t = np.full((k, k), 1.0)
    for _ in range(epochs):
        cuts, at = [0], 0
        breaks = set(np.flatnonzero(np.diff(words.text)) + 1)
        for step in rng.integers(4, 60, n // 4 + 1):
            at += int(step)
            if at >= n:
                break
            cuts.append(at)
        cuts = sorted({*cuts, *map(int, breaks), n})
        spans = list(zip(cuts[:-1], cuts[1:]))
        rng.shuffle(spans)
        size = max(1, len(spans) // max(1, n // 20_000))
        for i in range(0, len(spans), size):
            picked = np.concatenate([np.arange(s, e) for s, e in spans[i : i + size]])
            grams = words.grams[np.concatenate([np.arange(words.first[w], words.first[w] + byte_count[w]) for w in picked])]
            first = np.concatenate([[0], np.cumsum(byte_count[picked])[:-1]])
            batch = Words(picked, grams, first, words.single[picked])
            lengths = np.array([len(c) for c in np.array_split(picked, max(1, len(picked) // 400))])
            truth = label[picked]
            marginal, expected = forward_backward(emissions(batch, model.weights), lengths, model.transitions)
            error = -marginal
            error[np.arange(len(truth)), truth] += 1
            slot = np.concatenate([batch.single.ravel(), grams])
            owner = np.concatenate([np.repeat(np.arange(len(truth)), 3), np.repeat(np.arange(len(truth)), byte_count[picked])])
            touched, where = np.unique(slot, return_inverse=True)
            gradient = np.stack([np.bincount(where, error[owner, j], len(touched)) for j in range(k)], axis=1) / len(lengths)
            gradient -= 1e-4 * model.weights[touched]
            grown[touched] += gradient**2
            model.weights[touched] += (0.1 * gradient / np.sqrt(grown[touched])).astype(np.float32)
            starts = np.cumsum(lengths) - lengths
            inner = np.ones(len(truth), bool)
            inner[starts] = False
            seen = np.zeros((k, k))
            np.add.at(seen, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
            change = (seen - expected) / len(lengths) - 1e-3 * model.transitions
            grown_t += change**2
            model.transitions += 0.2 * change / np.sqrt(grown_t)
    return model


def label_texts(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """The language that most words of each text are in by their marginals, and its share of them."""
    names, shares = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not model.languages:
        return names, shares
    for begin, end in in_batches(texts, LABELLED_CHARS):
        part = texts[begin:end]
        words = words_of(part)
        lengths = np.bincount(words.text, minlength=len(part))
        marginal, _ = forward_backward(emissions(words, model.weights), lengths, model.transitions)
        k = len(model.languages)
        mass = np.stack([np.bincount(words.text, marginal[:, j], len(part)) for j in range(k)], axis=1)
        best = mass.argmax(axis=1)
        for i in np.flatnonzero(lengths > 0):
            if has_letter(part[i]):
                names[begin + i] = model.languages[best[i]]
                shares[begin + i] = float(min(1.0, mass[i, best[i]] / lengths[i]))
    return names, shares


def held_out(id: Column) -> Column:
    """Every third id by its checksum is kept from learning; a missing id is not."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_languages(
    products: DataFrame, per_language: int = PER_LANGUAGE, most_chars: int = MOST_CHARS, id: str = "id", text: str = "description", language: str = "language"
) -> Model:
    """Fits the model on a bounded sample of labelled rows that are not held out.

    About ``per_language`` rows of each language, chosen by a hash of id and text, come to the driver,
    texts of more than ``most_chars`` characters cut there for learning; equal tables give equal models.
    """
    labelled = products.select(
        F.col(id).alias("id"), F.col(text).alias("text"), F.col(language).alias("language")
    ).where(~held_out(F.col("id")) & F.col("language").isNotNull() & F.col("text").isNotNull())
    known = {r["language"]: r["count"] for r in labelled.groupBy("language").count().collect()}
    if not known:
        return Model([], np.zeros((int(_BASE[-1]), 0), np.float32), np.zeros((0, 0)))
    rate = F.create_map(*[F.lit(v) for name, n in sorted(known.items()) for v in (name, 1.25 * per_language / n)])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.withColumn("draw", draw).where(F.col("draw") < F.element_at(rate, F.col("language")))
    drawn = drawn.withColumn("text", F.substring("text", 1, most_chars)).toPandas()
    drawn = drawn.sort_values(["language", "draw", "id"], kind="stable").groupby("language").head(per_language)
    return fit(drawn["text"].tolist(), drawn["language"].tolist())


def predict_languages(products: DataFrame, model: Model, id: str = "id", text: str = "description") -> DataFrame:
    """One row per product: ``id, language_pred, score``; only the text is looked at."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            names, shares = label_texts(b.column("text").to_pylist(), model)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["id", "language_pred", "score"])

    kind = products.schema[id].dataType.simpleString()
    return products.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(predict, f"id {kind}, language_pred string, score double")


def identify_languages(
    products: DataFrame, per_language: int = PER_LANGUAGE, id: str = "id", text: str = "description", language: str = "language"
) -> DataFrame:
    """One row per product: ``id, held_out, language_pred, score``.

    A linear-chain conditional random field with affix, n-gram and lexicon features and learned
    transitions labels the words of each whole text by forward-backward; the text's language is
    the one with most of the words' probability, ``score`` its share. It learns from a bounded
    sample of the given labels (:func:`learn_languages`).

    A text that is missing or holds no letter is ``und`` with score 0, as is every text if no
    row is labelled. Of languages with equal shares the first by name is taken. Rows may repeat, ids
    and labels may be NULL; further columns are ignored; an empty table gives no rows.
    """
    model = learn_languages(products, per_language, id=id, text=text, language=language)
    found = predict_languages(products, model, id, text)
    return found.select("id", held_out(F.col("id")).alias("held_out"), "language_pred", "score")


def drop_unidentified(products: DataFrame, model: Model, least: float = 0.4, id: str = "id", text: str = "description") -> DataFrame:
    """The products whose language is found with a score of ``least`` or more, all columns as they are.

    Texts that are missing or hold no letter go, as do those in which no language has that share
    of the words; texts that switch between two languages stay. Nothing is shuffled. If no row was labelled, nothing can be told and every product stays.
    """
    if not model.languages:
        return products

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_pieces(batches):
            names, shares = label_texts(b.column(b.schema.get_field_index(text)).to_pylist(), model)
            yield b.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, shares)], pa.bool_()))

    return products.mapInArrow(keep, products.schema)
