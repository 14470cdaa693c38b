"""Token counts of product descriptions from a cache of digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the byte-level tokenizer files split text by before merging (their documented pattern).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters whose classes all Unicode versions share; other texts are encoded as a whole.
STEADY = regex.compile("[\x00-ɏ‐-‧]*")
KEPT_PIECES = 1_000_000  # distinct pieces a worker remembers before it starts anew
CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"


def digest(text: Column) -> Column:
    """Digest of a text's content, a missing one being empty. Nothing else is normalised, as
    any other change could change the count."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


@lru_cache(maxsize=8)
def tokenizer_version(path: str) -> str:
    """Names a tokenizer by its file's content, so that a changed file finds no old counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class Counter:
    """Counts tokens with the library that a tokenizer file is made for.

    Byte-level tokenizers split a text into pieces and merge within a piece only, so each
    distinct piece is encoded once per worker and then looked up. Texts that hold a special
    string or unusual characters are encoded whole, as are all texts of other tokenizers.
    """

    def __init__(self, path: str) -> None:
        self.pieces: dict[str, int] = {}
        self.split, self.special = None, ()
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
            return
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        self.whole = lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True):
            self.split = regex.compile(PATTERN)
            self.special = tuple(t["content"] for t in spec.get("added_tokens", []))

    def counts(self, texts: list[str]) -> list[int]:
        out, rest = [0] * len(texts), []
        for i, text in enumerate(texts):
            if self.split is None or any(s in text for s in self.special) or not STEADY.fullmatch(text):
                rest.append(i)
            else:
                out[i] = self.by_pieces(self.split.findall(text))
        for i in rest:
            out[i] = self.whole([texts[i]])[0]
        return out

    def by_pieces(self, pieces: list[str]) -> int:
        known = self.pieces
        new = list({p for p in pieces if p not in known})
        if new:
            if len(known) > KEPT_PIECES:
                known.clear()
                new = list(set(pieces))
            known.update(zip(new, self.whole(new)))
        return sum(map(known.__getitem__, pieces))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """Token counts of rows (digest, text), one worker's batch at a time."""
    version = tokenizer_version(path)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(path).counts
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "tokenizer": version, "n_tokens": count(b["text"].tolist())})

    return misses.select("digest", "text").mapInPandas(encode, CACHE_SCHEMA)


def count_tokens(
    products: DataFrame, cache: str, tokenizer: str, limit: int = 1024, id: str = "id", text: str = "description"
) -> DataFrame:
    """One row per product: the tokens of its whole description.

    ``cache`` is the folder of a Parquet table (digest, tokenizer, n_tokens), which need not
    exist yet; ``tokenizer`` the path of a tokenizer file (.json or .model), readable on every
    machine. Descriptions are joined to the cache by the digests of content and tokenizer;
    only distinct contents without a stored count are encoded, without begin, end or added
    special tokens, and their counts appended to the cache. The call itself runs that job.

    Returns ``id, n_bytes, n_tokens, over_limit`` (UTF-8 bytes; n_tokens > ``limit``). A
    missing text is empty and has 0 tokens. Equal texts are encoded once and counted for every
    row; rows may repeat, ids may be NULL, further columns are ignored; an empty table gives no
    rows. A cache row that two runs appended counts once.
    """
    spark, version = products.sparkSession, tokenizer_version(tokenizer)
    texts = products.select(digest(F.col(text)).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    stored = _stored_counts(products, cache, version)
    # one text per digest is kept before the shuffle already, so that copies don't meet in one task
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct if stored is None else distinct.join(stored, "digest", "left_anti")
    encode_misses(misses, tokenizer).write.mode("append").parquet(cache)
    counts = _stored_counts(products, cache, version)
    wanted = products.select(
        F.col(id).alias("id"),
        digest(F.col(text)).alias("digest"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return wanted.join(counts, "digest").select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _stored_counts(products: DataFrame, cache: str, version: str) -> DataFrame | None:
    from merchlens.session import hadoop_path

    spark = products.sparkSession
    path, files = hadoop_path(spark, cache)
    if not files.exists(path):
        return None
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    return known.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
