"""Text expressions: header keys, signatures, labels, tokens and variant keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from merchlens.functions import vocab


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def header_key(name: str) -> str:
    """A header reduced to its lower-case letters and digits."""
    return "".join(filter(str.isalnum, name)).lower()


_SPACE = " \t\n\r\x0b\x0c\xa0"


def strip(c: Column) -> Column:
    """Both ends without white space of any kind."""
    return F.trim(c, F.lit(_SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(_SPACE))


def none_if_blank(c: Column) -> Column:
    stripped = strip(c)
    return F.when(stripped != "", stripped)


def signature(*parts: Column) -> Column:
    """SHA-1 over the case- and space-normalised parts; a missing part counts as empty."""
    cleaned = [
        F.lower(F.trim(F.regexp_replace(F.coalesce(p.cast("string"), F.lit("")), r"\s+", " ")))
        for p in parts
    ]
    return F.sha1(F.concat_ws("|", *cleaned))


def cache_key(version: str, **payload: Column) -> Column:
    """SHA-256 over a version and the payload as a JSON object with sorted keys."""

    def quoted(value: Column) -> Column:
        listed = F.to_json(F.array(F.coalesce(value.cast("string"), F.lit(""))))
        return F.substring(listed, 2, F.length(listed) - 2)

    pairs = [F.concat(F.lit(f'"{name}": '), quoted(payload[name])) for name in sorted(payload)]
    return F.sha2(F.concat(F.lit(version + "::{"), F.concat_ws(", ", *pairs), F.lit("}")), 256)


def _latin_folding() -> tuple[str, str]:
    """Accented Latin letters and the base letter each decomposes to, from Unicode data."""
    source, target = [], []
    for point in range(0x00C0, 0x0250):
        parts = unicodedata.normalize("NFKD", chr(point))
        base = [p for p in parts if not unicodedata.combining(p)]
        if len(parts) > 1 and len(base) == 1 and base[0].isascii():
            source.append(chr(point))
            target.append(base[0])
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _latin_folding()


def fold_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}", "")


def ascii_lower(c: Column) -> Column:
    """Accents folded, whatever is still outside ASCII removed, lower case."""
    return F.lower(F.regexp_replace(fold_accents(F.coalesce(c, F.lit(""))), r"[^\x00-\x7F]", ""))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(fold_accents(F.coalesce(c, F.lit("")))), "[^a-z]", "")


def lookup(key: Column, table: dict, default=None) -> Column:
    """``table[key]`` as a literal-map lookup, ``default`` when the key is unknown."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(entries, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def tri_level(c: Column, default: str = "Medium") -> Column:
    return lookup(letters_only(c), vocab.TRI_SYNONYMS, default)


def awareness_label(c: Column) -> Column:
    return lookup(letters_only(c), vocab.AWARENESS_SYNONYMS, "Problem-Aware")


def title_case(c: Column) -> Column:
    return F.initcap(F.lower(c))


def clean_name(c: Column) -> Column:
    """Trailing flame marks removed."""
    return strip(F.regexp_replace(c, f"{vocab.FLAME}+$", ""))


def name_tokens(c: Column) -> Column:
    """Lower-case ASCII words without stop words, duplicates kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    stop = F.array(*[F.lit(w) for w in vocab.NAME_STOP_WORDS])
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


def variant_title(c: Column) -> Column:
    """Title without punctuation, colours, sizes and pack counts."""
    spaced = F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\W_]+", " "))
    without = F.regexp_replace(spaced, "(?iU)" + vocab.VARIANT_WORDS, "")
    return F.trim(F.regexp_replace(without, r"\s+", " "))


def variant_key(title: Column, parent_id: Column | None = None) -> Column:
    by_title = F.substring(variant_title(title), 1, vocab.VARIANT_KEY_LENGTH)
    if parent_id is None:
        return by_title
    parent = parent_id.cast("string")
    known = parent.isNotNull() & ~parent.isin("", "0")
    return F.when(known, F.concat(F.lit("parent:"), parent)).otherwise(by_title)


def cleanse(c: Column) -> Column:
    """Units and pack words dropped, spaces collapsed, edge punctuation trimmed."""
    units = r"(?i)\b(" + "|".join(vocab.UNIT_WORDS) + r")\b"
    packs = r"(?i)\b(" + "|".join(vocab.PACK_WORDS) + r"|x\d+)\b"
    text = F.regexp_replace(F.coalesce(c, F.lit("")), units, "")
    text = F.regexp_replace(F.regexp_replace(text, packs, ""), r"\s{2,}", " ")
    return F.regexp_replace(text, r"^[ ,;.\-]+|[ ,;.\-]+$", "")


def truncate(c: Column, limit: int, ellipsis: str = "…") -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    if limit <= 0:
        return text
    cut = rstrip(F.substring(text, 1, limit - len(ellipsis)))
    return F.when(F.length(text) > limit, F.concat(cut, F.lit(ellipsis))).otherwise(text)


def join_bullets(items: Column, limit: int) -> Column:
    kept = F.filter(F.transform(items, strip), lambda x: x != "")
    return truncate(F.regexp_replace(F.array_join(kept, " • "), r"[\n\r]", " "), limit)


def token_estimate(chars: Column) -> Column:
    """Tokens for a number of characters: a quarter, rounded up, 0 for none."""
    return F.when(chars > 0, F.ceil(chars / 4)).otherwise(0).cast("long")


def low_quality_text(text: Column, title: Column, min_chars: int = 280) -> Column:
    """True when a text is too short or reads like a product description."""
    def judge(body: Column) -> Column:
        return (F.length(strip(body)) < min_chars) | reads_like_product(body, title)

    return bind(F.coalesce(text, F.lit("")), judge)


def reads_like_product(text: Column, title: Column) -> Column:
    units = F.array(*[F.lit(u) for u in vocab.UNIT_WORDS])
    title_terms = F.array_union(
        F.regexp_extract_all(ascii_lower(title), F.lit("([a-z]{3,})"), F.lit(1)),
        F.array(*[F.lit(w) for w in vocab.PACK_WORDS]),
    )

    def judge(plain: Column) -> Column:
        text_terms = F.regexp_extract_all(plain, F.lit("([a-z]{3,})"), F.lit(1))
        return (
            F.arrays_overlap(F.split(plain, r"\s+"), units)
            | plain.rlike(r"\b(" + "|".join(vocab.CATEGORY_WORDS) + r")\b")
            | (F.size(F.array_intersect(title_terms, text_terms)) >= 3)
        )

    return bind(ascii_lower(text), judge)
