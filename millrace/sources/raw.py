"""Raw lines and files as rows, with what could not be read kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Adds ``record`` (null where the line is bad) and ``error`` to rows of ``_file, _line, _raw``; blank lines go.

    A line is bad if it is no JSON object; the error shows its first 200 characters.
    """
    rows = lines.where(F.trim("_raw") != "")
    whole = F.try_parse_json("_raw")
    ok = whole.isNotNull() & F.ltrim("_raw").startswith("{")
    return rows.withColumn("record", F.when(ok, F.from_json("_raw", schema))).withColumn("error", F.when(~ok, F.substring("_raw", 1, 200)))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of all .jsonl files below ``path``: file, record, error."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    return json_lines(raw.select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("_raw")), schema)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents (an array gives a row for each element) of all .json files below ``path``."""
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; rows of another width have their text in ``_corrupt``, whichever columns are used (so none is pruned before the parser)."""
    return spark.read.schema(f"{schema}, _corrupt string").option("header", "true").option("columnPruning", "false").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)


def inventory(spark: SparkSession, path: str, endings: tuple[str, ...] = ("html", "md", "txt", "json", "jsonl", "pdf")) -> DataFrame:
    """Files below ``path`` with an allowed ending: path, bytes, sha256. Spark itself passes over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.where(ending.isin(*endings)).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, navigation, comments and tags out, common entities read, blanks collapsed."""
    for tag in ("script", "style", "nav", "header", "footer"):
        html = F.regexp_replace(html, f"(?is)<{tag}\\b.*?</{tag}>", " ")
    html = F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", " "), "(?s)<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(html, r"[ \t\r\n\f\x0B]+", " "))


def headings(html: Column) -> Column:
    """Contents of h1 to h6 in order, tags out."""
    found = F.regexp_extract_all(html, F.lit("(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))
    return F.transform(found, lambda h: F.trim(F.regexp_replace(h, "<[^>]*>", "")))


def convert(spark: SparkSession, source: str, target: str, path_in: str, path_out: str) -> None:
    """Rewrite the files below a path: csv or json to jsonl, or jsonl to csv with the sorted union of all keys as header.

    Values of CSV stay strings; nested values become JSON text in CSV. Other pairs of formats raise.
    """
    if (source, target) not in (("csv", "jsonl"), ("json", "jsonl"), ("jsonl", "csv")):
        raise ValueError(f"no conversion from {source} to {target}")
    if target == "jsonl":
        rows = spark.read.option("header", "true").csv(path_in) if source == "csv" else spark.read.option("multiLine", "true").json(path_in)
        rows.write.json(path_out)
        return
    rows = spark.read.json(path_in)
    nested = {f.name for f in rows.schema if f.dataType.typeName() in ("struct", "array", "map")}
    flat = [F.to_json(f"`{c}`").alias(c) if c in nested else F.col(f"`{c}`") for c in sorted(rows.columns)]
    rows.select(*flat).write.option("header", "true").csv(path_out)


def validity(spark: SparkSession, path: str) -> DataFrame:
    """One row on the files below a path: total_files, valid_files, empty_files, total_bytes.

    Only names and sizes are listed, no contents. A path that does not exist or a
    file that cannot be read raises. Spark passes over empty files when it plans
    a scan, so the listing is the file system's own.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(root)
    full = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.count("*").alias("valid_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))
    total = F.lit(listed.getFileCount()).cast("long")
    return full.select(total.alias("total_files"), "valid_files", (total - F.col("valid_files")).alias("empty_files"), "total_bytes")


def profile(spark: SparkSession, path: str, kind: str, columns: list[str] | None = None) -> DataFrame:
    """One row on the files of one kind (csv or jsonl) below a path: file_count, total_bytes, row_count, empty_rows, missing_values, malformed_rows.

    All files are read, not the first alone. Rows of a CSV are its lines but the
    header, which names ``columns``, so values do not hold line ends; a row
    without any value is empty, one of another width malformed. A JSON line is
    malformed if it is no object; its missing values are keys with null or blank.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").text(path)
    files = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("at"), "value")
    sizes = files.groupBy("file").agg(F.min("bytes").alias("bytes")).agg(F.count("*").alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    if kind == "csv":
        # A quoted value may hold commas; quotes inside are doubled.
        cells = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "value"), F.lit(r',((?:"(?:[^"]|"")*"|[^,"])*)'), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))
        rows = files.where(F.col("value") != ",".join(columns or [])).withColumn("cells", cells) if columns else files.withColumn("cells", cells)
        blank = F.size(F.filter("cells", lambda c: c == ""))
        empty = F.trim("value") == ""
        odd = ~empty & (F.size("cells") != len(columns)) if columns else F.lit(False)
        facts = rows.agg(F.count_if(~empty).alias("row_count"), F.count_if(empty | (blank == F.size("cells"))).alias("empty_rows"), F.coalesce(F.sum(F.when(~empty, blank)), F.lit(0)).alias("missing_values"), F.count_if(odd).alias("malformed_rows"))
    else:
        empty = F.trim("value") == ""
        parsed = F.from_json(F.when(F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{"), F.col("value")), "map<string,string>")
        rows = files.withColumn("keys", parsed)
        blank = F.size(F.filter(F.map_values("keys"), lambda v: v.isNull() | (F.trim(v) == "")))
        facts = rows.agg(F.count_if(~empty).alias("row_count"), F.count_if(empty).alias("empty_rows"), F.coalesce(F.sum(F.when(F.col("keys").isNotNull(), blank)), F.lit(0)).alias("missing_values"), F.count_if(~empty & F.col("keys").isNull()).alias("malformed_rows"))
    return sizes.join(F.broadcast(facts))  # one row each


def rename_endings(spark: SparkSession, path: str, old: str, new: str) -> int:
    """Give files below a path another ending, and say how many; only names are touched, on the driver."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    root = at(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, n = system.listFiles(root, True), 0
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(old):
            system.rename(at(name), at(name.removesuffix(old) + new))
            n += 1
    return n
