"""Reading messy catalogues: files, header resolution, column mapping."""

from __future__ import annotations

import re
from collections import Counter
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchlens.functions import vocab
from merchlens.functions.text import header_key, none_if_blank
from merchlens.session import cut_lineage, hadoop_path
from merchlens.sources import records

FILE_COLUMN, SEQ_COLUMN = "_file", "_seq"


def read_catalog(
    spark: SparkSession, path: str | list[str], fmt: str = "csv", whole_files: bool | None = None
) -> DataFrame:
    """Rows of CSV or JSON files as text columns, with ``_file`` (stem) and ``_seq``.

    ``path`` is a file, a folder, a glob or a list of files. ``_seq`` grows by file name and
    line and decides which of two equal signatures is the later one.

    CSV files read together have to share one header (see :func:`read_catalog_dir` for a mix);
    a file with another header is an error, never a silent mix-up. JSON files hold a list of
    objects; entries that are no objects are skipped. Large files are split over tasks, also
    where quoted cells hold line breaks, and JSON lists that are one long line. ``whole_files`` set to
    True reads each CSV file in one piece; set to False it tells that files are one record per
    line, JSON objects and CSV rows alike, which saves a first look at them.
    """
    if fmt == "csv":
        if whole_files is None and _cells_cross_lines(spark, path):
            return _with_stem(_csv_records(spark, path))
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
        rows = _placed(reader.option("multiLine", bool(whole_files)).option("enforceSchema", False).csv(path))
    elif fmt == "json" and whole_files is not False:
        rows = _json_lists(spark, path)
    elif fmt == "json":
        rows = spark.read.option("primitivesAsString", True).json(path)
        if "_corrupt_record" in rows.columns:
            rows = rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
        rows = _placed(rows)
    else:
        raise ValueError(f"unknown format: {fmt}")
    return _with_stem(rows)


def _cells_cross_lines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a quoted cell of some line goes on in the next one.

    A carriage return inside a line would be a line end to one reader and a character to the other.
    """
    line = F.regexp_replace("text", r"\r$", "")
    lines = records.pieces(spark, path, "\n").select(line.alias("text"))
    return not lines.where(records.opens_cell(F.col("text")) | F.contains("text", F.lit("\r"))).isEmpty()


def _csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of CSV files whose cells may hold line breaks, split over tasks, with ``_seq``.

    A cell that is never closed holds the rest of its file but for the last line end.
    """
    effects = records.csv_effects(records.pieces(spark, path, "\n"))
    found = records.whole_records(effects, records.block_states(effects), "\n")
    found = cut_lineage(found.where(F.rtrim(F.col("record"), F.lit(" \r")) != ""))
    outset = F.min(F.struct("block", "row", "record")).alias("first")
    firsts = cut_lineage(found.where("block = 0").groupBy("file").agg(outset).select("file", "first.*"))
    # a file whose first line ends with a carriage return has them as part of its line ends
    firsts = firsts.select("file", "block", "row", F.regexp_replace("record", r"\r$", "").alias("header"), F.endswith("record", F.lit("\r")).alias("crlf"))
    heads = firsts.select("header").distinct().limit(2).collect()
    if len(heads) > 1:
        raise ValueError(f"files of different headers: {heads[0]['header']!r} and {heads[1]['header']!r}")
    if not heads:
        return spark.createDataFrame([], f"{SEQ_COLUMN} struct<file:string,block:long,row:long>")
    columns = _header_columns(spark, heads[0]["header"])
    is_first = firsts.select("file", "crlf", F.struct("block", "row").alias("first"))
    rows = found.join(is_first, "file").where(F.struct("block", "row") != F.col("first"))
    plain = F.regexp_replace(F.regexp_replace("record", r"\r\n", "\n"), r"\r$", "")
    rows = rows.withColumn("record", F.when(F.col("crlf"), plain).otherwise(F.col("record")))
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    cells = F.from_csv("record", schema, {"escape": '"', "mode": "PERMISSIVE"})
    parsed = rows.select(cells.alias("cells"), F.struct("file", "block", "row").alias(SEQ_COLUMN))
    return parsed.select(*[F.col(f"cells.c{i}").alias(c) for i, c in enumerate(columns)], SEQ_COLUMN)


def _header_columns(spark: SparkSession, header: str) -> list[str]:
    """Column names as Spark's own reader takes them from a header."""
    lines = spark.createDataFrame([(header,)], "value string")
    parsed = lines.select(F.from_csv("value", ", ".join(f"c{i} string" for i in range(header.count(",") + 1)), {"escape": '"'}).alias("h"))
    names = [n for n in parsed.select("h.*").first()]
    while names and names[-1] is None and not header.endswith(","):
        names.pop()  # commas inside quotes
    seen = Counter(n.lower() for n in names if n)
    return [f"_c{i}" if not n else f"{n}{i}" if seen[n.lower()] > 1 else n for i, n in enumerate(names)]


def stream_catalog(spark: SparkSession, folder: str, headers: list[str]) -> DataFrame:
    """CSV files with known headers as a stream of text rows, with ``_file`` and ``_seq``.

    Lines cannot be numbered in a stream: :func:`number_lines` does it batch by batch.
    """
    schema = ", ".join("`" + h.replace("`", "``") + "` string" for h in headers)
    reader = spark.readStream.schema(schema).option("header", True).option("escape", '"')
    rows = reader.option("multiLine", True).option("enforceSchema", False).csv(folder)
    return _with_stem(rows.select("*", _place(F.lit(0).cast("long")).alias(SEQ_COLUMN)))


def number_lines(batch: DataFrame) -> DataFrame:
    """A batch of :func:`stream_catalog` with its lines numbered inside each block."""
    row = F.monotonically_increasing_id()
    return batch.withColumn(SEQ_COLUMN, F.col(SEQ_COLUMN).withField("row", row))


def _with_stem(rows: DataFrame) -> DataFrame:
    stem = F.regexp_extract(F.element_at(F.split(F.col(SEQ_COLUMN)["file"], "/"), -1), r"^(.+?)(\.[^.]*)?$", 1)
    return rows.withColumn(FILE_COLUMN, F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B"))))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their place: blocks are ordered by file and offset, lines inside a block."""
    return rows.select("*", _place(F.monotonically_increasing_id()).alias(SEQ_COLUMN))


def _place(row: Column) -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), row.alias("row")
    )


def _json_lists(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The objects of JSON lists; columns in the order their keys first appear.

    Lists are cut where an object of theirs ends, whatever lines they are written in. What stands before
    an object is the list's opening bracket or a comma, and entries that are no objects.
    """
    effects = records.json_effects(records.pieces(spark, path, "}"))
    states = cut_lineage(records.block_states(effects))
    lists = states.where((F.col("block") == 0) & F.ltrim("begins").startswith("[")).select("file")
    found = records.whole_records(effects, states, "}", depth=1).join(lists, "file", "left_semi")
    entries = F.from_json(F.concat(F.lit("["), F.regexp_replace("record", r"^\s*+[\[,]", ""), F.lit("}]")), "array<string>")
    objects = found.select(
        F.from_json(F.try_element_at(F.filter(entries, lambda e: e.startswith("{")), F.lit(-1)), "map<string,string>").alias("cells"),
        F.struct("file", "block", "row").alias(SEQ_COLUMN),
    ).where(F.col("cells").isNotNull())
    objects = cut_lineage(objects)
    keys = (
        objects.select(SEQ_COLUMN, F.posexplode(F.map_keys("cells")).alias("place", "key"))
        .groupBy("key")
        .agg(F.min(F.struct(SEQ_COLUMN, "place")).alias("first"))
        .orderBy("first")
        .collect()  # one row per header
    )
    cells = [F.try_element_at("cells", F.lit(r["key"])).alias(r["key"]) for r in keys]
    return objects.select(*cells, SEQ_COLUMN)


def read_catalog_dir(spark: SparkSession, folder: str, whole_files: bool | None = None) -> DataFrame:
    """Every ``.csv`` and ``.json`` file of a folder; columns are united by name.

    One job finds the header lines of all CSV files; files of one header are read together.
    """
    base, frames = folder.rstrip("/"), []
    if _any_file(spark, f"{base}/*.csv"):
        effects = records.csv_effects(records.pieces(spark, f"{base}/*.csv", "\n"))
        headers = records.block_states(effects).where("block = 0").select("file", F.regexp_replace("begins", r"\r$", "").alias("header"))
        groups = headers.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy(F.col("files")[0])
        for group in groups.collect():  # one row a header
            frames.append(read_catalog(spark, [_path(f) for f in group["files"]], "csv", whole_files))
    if _any_file(spark, f"{base}/*.json"):
        frames.append(read_catalog(spark, f"{base}/*.json", "json", whole_files))
    if not frames:
        raise FileNotFoundError(f"no .csv or .json files in {folder}")
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame, allowMissingColumns=True)
    return united


def _any_file(spark: SparkSession, pattern: str) -> bool:
    path, fs = hadoop_path(spark, pattern)
    return bool(fs.globStatus(path))


def _path(uri: str) -> str:
    """A path from the form in which files report it, where blanks and the like are escaped."""
    return unquote(uri)


def _data_headers(columns: list[str]) -> list[str]:
    return [c for c in columns if c not in (FILE_COLUMN, SEQ_COLUMN)]


def resolve_exact(columns: list[str]) -> dict[str, list[str]]:
    """Field to headers by exact alias; several headers of a field are tried in alias order."""
    by_key: dict[str, str] = {}
    for header in _data_headers(columns):
        by_key.setdefault(header_key(header), header)
    found = {}
    for name, aliases in vocab.HEADER_ALIASES.items():
        keys = dict.fromkeys(header_key(a) for a in aliases)
        headers = [by_key[k] for k in keys if k in by_key]
        if headers:
            found[name] = headers
    return found


def resolve_contains(columns: list[str]) -> dict[str, list[str]]:
    """Field to header by substring; each header serves the first field that claims it."""
    headers = _data_headers(columns)
    free = list(headers)
    found: dict[str, list[str]] = {}

    def claim(name: str, patterns: list[str]) -> None:
        for header in free:
            if any(p in header_key(header) for p in patterns):
                free.remove(header)
                found[name] = [header]
                return

    for name, patterns in vocab.HEADER_PATTERNS.items():
        if name == "date_range" and "Date Range" in free:
            free.remove("Date Range")
            found[name] = ["Date Range"]
        else:
            claim(name, patterns)
    for metric in vocab.LEGACY_METRICS:
        claim(metric, [re.sub(r"[^a-z0-9]", "", metric)])
    return found


RESOLVERS = {"exact": resolve_exact, "contains": resolve_contains}


def _cell(header: str) -> Column:
    """A header's value, None when blank."""
    quoted = header.replace("`", "``")
    return none_if_blank(F.col(f"`{quoted}`").cast("string"))


def field_value(headers: list[str]) -> Column:
    """First non-empty header value of a row."""
    return F.coalesce(*[_cell(h) for h in headers])


def map_columns(df: DataFrame, mode: str = "exact") -> DataFrame:
    """Recognised fields as columns, the row's other cells as the map ``other``.

    In ``exact`` mode a header that lost to another alias on a row stays in ``other`` of
    that row; in ``contains`` mode recognised headers never do. Blank cells are dropped.
    """
    resolved = RESOLVERS[mode](df.columns)
    fields = {name: field_value(headers) for name, headers in resolved.items()}
    entries = []
    for header in _data_headers(df.columns):
        cell = _cell(header)
        for name, headers in resolved.items():
            if header not in headers:
                continue
            earlier = headers[: headers.index(header)]
            if mode == "contains" or not earlier:
                cell = None
                break
            lost = F.coalesce(*[_cell(h) for h in earlier]).isNotNull()
            cell = F.when(lost, cell)
        if cell is not None:
            entries.append(F.struct(F.lit(header).alias("key"), cell.alias("value")))
    if entries:
        other = F.map_filter(F.map_from_entries(F.array(*entries)), lambda _, v: v.isNotNull())
    else:
        other = F.create_map().cast("map<string,string>")
    kept = [c for c in (FILE_COLUMN, SEQ_COLUMN) if c in df.columns]
    return df.select(*kept, *[c.alias(n) for n, c in fields.items()], other.alias("other"))
