"""Product facts from stored HTML pages: title, description, first price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchlens.functions import vocab
from merchlens.functions.numbers import ratio
from merchlens.functions.text import none_if_blank

# A page as a parser sees it: comments, scripts and styles with all they hold, tags with quoted
# values, and text. A tag ends outside quotes.
_REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = rf"""(?is)(<!--.*?(?:-->|$)|<(script|style)\b{_REST}>.*?(?:</\2\s*+>|$)|<[/!?]?[a-z]{_REST}>?|[^<]++|<)"""
_ATTRIBUTE = r"""(?s)\s([^\s=/>"']++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++)"""
_ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
    ("&euro;", "€"), ("&amp;", "&"),
]


def unescape(c: Column) -> Column:
    for entity, char in _ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def page_tokens(html: Column) -> Column:
    """Comments, scripts, tags and texts of a page, in order."""
    return F.regexp_extract_all(html, F.lit(_TOKEN), 1)


def page_title(tokens: Column) -> Column:
    """The text of the first title element that is no part of a comment or script."""
    opens = F.transform(tokens, lambda t, i: F.when(F.regexp(t, F.lit(r"(?i)^<title\b")), i))
    at = F.get(F.filter(opens, lambda i: i.isNotNull()), 0)
    text, end = F.get(tokens, at + 1), F.get(tokens, at + 2)
    return none_if_blank(unescape(F.when(F.regexp(end, F.lit(r"(?i)^</title\b")) & ~text.startswith("<"), text)))


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, wherever it stands in the tag."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 1), F.lower)
    values = F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), 2)
    value = F.get(values, F.array_position(names, name).cast("int") - 1)
    return unescape(F.regexp_replace(value, r"""^["']|["']$""", ""))


def _meta(metas: Column, name: str, value: str) -> Column:
    """The content of the first such tag, as the only entry of a list that is empty without one."""
    wanted = F.filter(metas, lambda t: attribute(t, name) == value)
    return F.transform(F.slice(wanted, 1, 1), lambda t: attribute(t, "content"))


def page_description(tokens: Column) -> Column:
    """Meta description; the Open Graph one only where there is no plain tag at all."""
    metas = F.filter(tokens, lambda t: F.regexp(t, F.lit(r"(?i)^<meta\b")))
    found = F.concat(_meta(metas, "name", "description"), _meta(metas, "property", "og:description"))
    return none_if_blank(F.get(found, 0))


def page_text(tokens: Column) -> Column:
    """Text of a page; what is no text becomes a space."""
    return unescape(F.array_join(F.transform(tokens, lambda t: F.when(t.startswith("<") & (t != "<"), " ").otherwise(t)), ""))


def first_price(text: Column) -> Column:
    """First amount by the first currency pattern that finds one."""
    found = [
        F.replace(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit(","), F.lit("."))
        for p in vocab.PRICE_PATTERNS
    ]
    return F.coalesce(*[f.try_cast("double") for f in found])


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """``name, description, price`` per page; pages with neither title nor description go."""
    tokens = F.col("_tokens")
    rows = pages.select("page_id", "url", page_tokens(F.col(html)).alias("_tokens")).select(
        "page_id",
        "url",
        page_title(tokens).alias("title"),
        page_description(tokens).alias("description"),
        first_price(page_text(tokens)).alias("price"),
    ).where(F.col("title").isNotNull() | F.col("description").isNotNull())
    return rows.select(
        "page_id", "url", F.coalesce("title", F.lit("")).alias("name"), "description", "price"
    )


def host_counts(extracted: DataFrame) -> DataFrame:
    """Pages, titled and priced pages per host."""
    host = F.lower(F.parse_url(F.col("url"), F.lit("HOST")))
    return extracted.groupBy(host.alias("host")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.count("description").alias("described"),
        F.count("price").alias("priced"),
        ratio(F.sum(F.length("name")), F.count(F.lit(1))).alias("avg_name_length"),
    )
