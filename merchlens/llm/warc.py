"""WARC archives of product pages and a two-level capture index over them."""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.llm.common import free_shuffles, partitions, stored, whole_numbers

REVISIT_FROM = 100  # bytes of a payload that later captures refer back to
BLOCK_LINES = 1000  # index lines in a compressed block
OPEN_FILES = 32
LINE_END = "%0D%0A"  # what a line end in a URL becomes, as headers are lines
PAGE_URN = "urn:merchlens:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "surt string, id long, file string, offset long, length long"
NO_ID = -(1 << 63)  # the number of a page without an id in keys of the index
BLOCK_SCHEMA = "part int, block int, first_surt string, first_id long, lines int, data binary"
RECORD_SCHEMA = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


# --- writing -----------------------------------------------------------------------------


def _uri(id: Column) -> Column:
    return F.concat(F.lit(f"<{PAGE_URN}"), F.coalesce(id.cast("string"), F.lit("none")), F.lit(">"))


def capture_records(pages: DataFrame, captured: str, id: str = "id", url: str = "url", html: str = "html") -> DataFrame:
    """One WARC record per page as text, without the two line ends that close it.

    Of pages with equal payloads of ``REVISIT_FROM`` bytes or more the one with the smallest id
    becomes a response, the others revisits of it that hold no payload.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    digested = pages.select(
        F.col(id).alias("id"),
        F.regexp_replace(F.col(url), r"[\r\n]+", LINE_END).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).alias("size"),
        F.sha2(F.encode(payload, "UTF-8"), 256).alias("digest"),
    )
    shared = (
        digested.where(F.col("size") >= REVISIT_FROM)
        .groupBy("digest")
        .agg(F.min("id").alias("original"), F.count(F.lit(1)).alias("captures"))
        .where("captures > 1 AND original IS NOT NULL")
        .select("digest", "original")
    )
    # stored, so that Spark knows its size and, while that is small, need not shuffle the pages
    shared = stored(shared, "originals")
    known = digested.join(shared, "digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _uri(F.col("id"))),
        F.coalesce(line("WARC-Target-URI", F.col("url")), F.lit("")),
        line("WARC-Date", F.lit(captured)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", _uri(F.col("original"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
    )
    return known.select(F.concat(head, F.lit("\r\n"), block).alias("value"))


def write_archives(pages: DataFrame, folder: str, captured: str = "2024-01-01T00:00:00Z", id: str = "id", url: str = "url", html: str = "html") -> None:
    """Writes the pages as uncompressed WARC 1.1 archives, one per task, into ``folder``.

    Spark's own text writer does it: a record is a row, and what ends a line are the two line
    ends that close a record. So a task that is lost and runs again leaves one archive.
    """
    capture_records(pages, captured, id, url, html).write.option("lineSep", "\r\n\r\n").text(folder)


# --- reading -----------------------------------------------------------------------------


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], int, int]:
    """Headers of the record at ``at``, where its block starts, and where the record ends."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = stop + 4
    return head, block, block + int(head["Content-Length"]) + 4


def page_of(uri: str | None) -> int | None:
    number = uri[len(PAGE_URN) + 1 : -1] if uri else "none"
    return None if number == "none" else int(number)


def surt(url: str | None) -> str:
    """A URL's sort key: host labels from the right, then path and query; scheme, ``www.``,
    default ports, user and fragment are dropped. A missing or unreadable URL sorts as itself."""
    if not url:
        return ""
    url = re.sub(r"[\r\n]+", LINE_END, url)  # as it stands in a record
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url
    if not host:
        return url
    labels = host.removeprefix("www.").split(".")[::-1]
    port = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(labels)}{port}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _index_archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, data in zip(b["path"], b["content"]):
            rows, at = [], 0
            while at < len(data):
                head, _, end = parse_record(data, at)
                number = page_of(head["WARC-Record-ID"])
                rows.append((surt(head.get("WARC-Target-URI")), NO_ID if number is None else number, path, at, end - at))
                at = end
            yield pd.DataFrame(rows, columns=["surt", "id", "file", "offset", "length"]).astype({"id": "int64"})


def _blocks(lines: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block() -> pd.DataFrame:
            data = zlib.compress("\n".join(json.dumps(r) for r in held).encode("utf-8"))
            return pd.DataFrame([(part, number, held[0][0], held[0][1], len(held), data)], columns=["part", "block", "first_surt", "first_id", "lines", "data"])

        for b in batches:
            for row in zip(b["surt"], b["id"], b["file"], b["offset"], b["length"]):
                held.append([row[0], int(row[1]), row[2], int(row[3]), int(row[4])])
                if len(held) == lines:
                    yield block()
                    number, held = number + 1, []
        if held:
            yield block()

    return pack


def build_index(spark: SparkSession, archives: str, index: str, lines: int = BLOCK_LINES) -> None:
    """Writes the capture index of a folder of archives: compressed blocks of sorted lines.

    A line holds reversed-host key, page id, archive, offset and length. Lines are sorted over
    the whole index; a block's first key is stored beside it, which makes the sparse directory.
    Each archive is read by one task, so archives should stay well below a task's memory.
    """
    found = spark.read.format("binaryFile").load(archives).select("path", "content").mapInPandas(_index_archives, INDEX_SCHEMA)
    ordered = found.repartitionByRange(partitions(spark), "surt", "id").sortWithinPartitions("surt", "id", "file", "offset")
    ordered.mapInPandas(_blocks(lines), BLOCK_SCHEMA).write.parquet(index)


def _search(key, wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """Binary search of keys in one part of the index: directory first, then the block it names."""
    blocks = blocks.sort_values("block")
    directory = list(zip(blocks["first_surt"], blocks["first_id"].astype("int64")))
    data, opened, rows = list(blocks["data"]), {}, []
    for name, number in sorted({(s, int(i)) for s, i in zip(wanted["surt"], wanted["id"])}):
        # equal keys may fill several blocks: begin with the last that starts before the key
        at = max(0, bisect_right(directory, (name, number - 1)) - 1)
        while at < len(directory) and directory[at] <= (name, number):
            if at not in opened:
                opened = {at: [json.loads(line) for line in zlib.decompress(data[at]).decode("utf-8").split("\n")]}
            lines = opened[at]
            i = bisect_right(lines, [name, number - 1, "\U0010ffff"])
            while i < len(lines) and lines[i][0] == name and lines[i][1] == number:
                rows.append(lines[i])
                i += 1
            at += 1
    out = pd.DataFrame(rows, columns=["surt", "id", "file", "offset", "length"])
    return out.astype({"id": "int64", "offset": "int64", "length": "int64"})


def lookup(pages: DataFrame, index: str, id: str = "id", url: str = "url") -> DataFrame:
    """Where the captures of pages (id, url) lie: surt, id, file, offset, length; ``NO_ID`` for no id.

    Keys go to the part of the index they fall into, by the first key of each part (as many
    as the index has files); within a part a binary search of the directory names a block and
    one in the block the lines. Only blocks that hold a key are unpacked. Repeated keys count once.
    """
    spark = pages.sparkSession
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(index)
    firsts = blocks.where("block = 0").select("first_surt", "first_id", "part").collect()
    bounds = sorted((r.first_surt, r.first_id, r.part) for r in firsts)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = [surt(u) for u in b["url"]]
            numbers = b["id"]
            spots = [max(0, bisect_right(bounds, (s, i, 1 << 31)) - 1) for s, i in zip(names, numbers)]
            yield pd.DataFrame({"part": [bounds[p][2] for p in spots], "surt": names, "id": numbers})

    if not bounds:
        return spark.createDataFrame([], INDEX_SCHEMA)
    wanted = pages.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(url).cast("string").alias("url")).mapInPandas(keyed, "part int, surt string, id long")
    return wanted.distinct().groupBy("part").cogroup(blocks.groupBy("part")).applyInPandas(_search, INDEX_SCHEMA)


def read_captures(captures: DataFrame) -> DataFrame:
    """Reads records by their ranges: id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    A response's size and digest are taken from its payload, and a digest that differs from the
    one stored is an error; a revisit has no payload and those of the page it refers to.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files: OrderedDict = OrderedDict()
        for b in batches:
            rows = []
            for name, offset, length in zip(b["file"], b["offset"], b["length"]):
                if name not in files:
                    uri = "file://" + name[5:] if name.startswith("file:/") and not name.startswith("file://") else name
                    system, path = fs.FileSystem.from_uri(uri)
                    files[name] = system.open_input_file(path)
                    if len(files) > OPEN_FILES:
                        files.popitem(last=False)[1].close()
                files[name].seek(offset)
                rows.append(_capture(files[name].read(length)))
            out = pd.DataFrame(rows, columns=["id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"], dtype=object)
            numbers = {c: whole_numbers(out[c].tolist()) for c in ("id", "refers_to", "payload_bytes")}
            yield out.assign(**numbers)

    return captures.select("file", "offset", "length").mapInPandas(read, RECORD_SCHEMA)


def _capture(record: bytes) -> tuple:
    head, block, end = parse_record(record)
    body = record.index(b"\r\n\r\n", block) + 4
    http = dict(line.split(": ", 1) for line in record[block : body - 4].decode("utf-8").split("\r\n")[1:])
    kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"])
    payload = None
    if kind == "response":
        payload = record[body : end - 4]
        if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"damaged payload in {head['WARC-Record-ID']}")
    return page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, page_of(head.get("WARC-Refers-To")), size, digest, payload


def archive_pages(pages: DataFrame, folder: str, captured: str = "2024-01-01T00:00:00Z", id: str = "id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages as WARC archives with a capture index, then reads every record back by range.

    ``folder`` is an unused folder that all machines share; archives go to ``archives`` and the
    index to ``index`` in it. Returns the records as :func:`read_captures` does, one per page.

    A missing page has an empty payload, a missing URL the empty key; payloads below
    ``REVISIT_FROM`` bytes are all responses. Rows that repeat the smallest id of a payload are
    all responses, a row without an id revisits a page that has one. Ids are whole numbers. Further
    columns are ignored; an empty table gives no rows.
    """
    write_archives(pages, f"{folder}/archives", captured, id, url, html)
    free_shuffles(pages.sparkSession)
    build_index(pages.sparkSession, f"{folder}/archives", f"{folder}/index")
    return read_captures(lookup(pages, f"{folder}/index", id, url))
