"""Sources: file intake, text documents, converter output, stored tables and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables.functions import text
from doctables.session import stored

# Accepted extensions with their MIME types, and the narrower list of schema inference.
MIME = {
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "txt": "text/plain; charset=utf-8",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "html": "text/html; charset=utf-8",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "csv": "text/csv; charset=utf-8",
}
ALLOWED = ("pdf", "png", "jpg", "jpeg", "txt", "docx", "html", "xlsx", "xls", "csv")
SCHEMA_ALLOWED = ("pdf", "docx", "png", "jpg", "jpeg", "xlsx", "xls", "csv")
TEXT_ALLOWED = ("txt", "html", "csv")
CATALOG = ("companies", "users", "api_keys", "templates", "jobs", "app_settings", "stats")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\.([^.]*)$", 1))


def tag_files(files: DataFrame, allowed: Sequence[str] = ALLOWED) -> tuple[DataFrame, DataFrame]:
    """Split a table with a ``path`` column into accepted files (with MIME type) and rejected ones."""
    ext = extension(F.col("path"))
    mime = F.coalesce(*[F.when(ext == k, v) for k, v in MIME.items()], F.lit("application/octet-stream"))
    tagged = files.withColumn("ext", ext).withColumn("mime", mime)
    accepted = tagged.where(F.col("ext").isin(list(allowed)))
    reason = F.concat(F.lit("Unsupported: "), "ext", F.lit(f". Allowed: {', '.join(allowed)}"))
    rejected = tagged.where(~F.col("ext").isin(list(allowed))).withColumn("error", reason)
    return accepted, rejected


def scan_files(spark: SparkSession, path: str, allowed: Sequence[str] = ALLOWED) -> tuple[DataFrame, DataFrame]:
    """Files below a folder, accepted and rejected; only their names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return tag_files(_in_fewer_tasks(files), allowed)


def _in_fewer_tasks(files: DataFrame) -> DataFrame:
    """Small files by the hundred to a task: Spark counts each as megabytes, so its own tasks read a handful and take longer to start."""
    parts = files.rdd.getNumPartitions()
    return files.coalesce(max(1, parts // 32, min(parts, 4 * files.sparkSession.sparkContext.defaultParallelism)))


def scan_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Natively readable documents (txt, html, csv, in any case) as one-page documents; ``scan_files`` reports the others."""
    names = ",".join("".join(f"[{c}{c.upper()}]" for c in ext) for ext in TEXT_ALLOWED)
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{names}}}").text(path, wholetext=True)
           .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    return _in_fewer_tasks(raw).select("path", text.file_stem(F.col("path")).alias("file_name"), F.lit(1).alias("page"), "content", F.length("content").alias("content_length"))


def scan_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(path, row_no, cells)``: the rows of CSV documents, each under the header of its own file.

    A file's first record names its columns; ``cells`` maps a name to the cell's text (null: empty). A cell without a name, under a name
    that stood before, or beyond the header is called ``_c`` and its position (from 0), so no cell is lost. Cells may hold line breaks and
    quotes in quotes; empty lines are skipped; files differ in any way. Rows are numbered from 1 in a file. A file with a header alone or
    nothing gives no row. Reads the files twice, first to learn the most cells of a record, and stores the records when called.
    """
    reader = spark.read.option("escape", '"').option("multiLine", "true").option("recursiveFileLookup", "true")
    # with one column asked for, a record of more is kept as it stands; its commas bound its cells
    text_of = reader.schema("cell string, record string").option("columnNameOfCorruptRecord", "record").csv(path)
    commas = F.length(F.regexp_replace(F.coalesce("record", "cell"), "[^,]", ""))
    width = (text_of.select("cell", commas.alias("n")).agg(F.max("n")).first()[0] or 0) + 1
    names = [f"c{i}" for i in range(width)]
    raw = reader.schema(", ".join(f"{n} string" for n in names)).option("columnNameOfCorruptRecord", "").csv(path)
    cells = F.array(*(F.col(n) for n in names))
    raw = raw.select(F.col("_metadata.file_path").alias("path"), cells.alias("cells"))
    # a file is read by one task in its order, so numbers grow by one within it
    records = stored(raw.withColumn("at", F.monotonically_increasing_id()), "csv-records")
    head = records.groupBy("path").agg(F.min("at").alias("first"), F.min_by("cells", "at").alias("header"))
    rows = records.join(head, "path").where(F.col("at") > F.col("first"))
    header = F.transform("header", lambda h: F.regexp_replace(F.trim(F.coalesce(h, F.lit(""))), "^\ufeff", ""))
    rows = rows.withColumn("header", header).withColumn("width", F.greatest(_filled("header", ""), _filled("cells")))
    own = F.transform("header", lambda h, i: F.when(
        h.rlike(r"^(_c\d+)?$") | (F.array_position("header", h) <= i), F.concat(F.lit("_c"), i.cast("string"))).otherwise(h))
    named = F.map_from_arrays(F.slice(own, 1, F.col("width")), F.slice("cells", 1, F.col("width")))
    return rows.select("path", (F.col("at") - F.col("first")).alias("row_no"), named.alias("cells"))


def _filled(column: str, blank: str | None = None) -> Column:
    """The number of values up to the last one that is not blank."""
    last = F.transform(column, lambda v, i: F.when(v.isNotNull() & (v != blank if blank is not None else F.lit(True)), i + 1).otherwise(0))
    return F.array_max(last)


CONVERTED = "pages array<string>, total bigint, totalChars bigint, avgCharsPerPage double, scannedPages array<int>, scannedShare double, usable boolean"


def scan_converted(df: DataFrame, col: str = "output") -> tuple[DataFrame, DataFrame]:
    """Page rows of converter output, and the rows without any page as errors.

    The JSON object is what lies between the outermost braces; noise around it is ignored.
    """
    rest = [c for c in df.columns if c != col]
    body = F.from_json(F.regexp_extract(F.col(col), r"(?s)\{.*\}", 0), CONVERTED)
    parsed = df.select(*rest, body.alias("_r"))
    empty = F.coalesce(F.size("_r.pages"), F.lit(-1)) <= 0
    errors = parsed.where(empty).select(*rest, F.lit("no pages").alias("error"))
    pages = parsed.where(~empty).select(*rest, F.col("_r.usable").alias("usable"), F.posexplode("_r.pages").alias("_i", "content"))
    return pages.select(*rest, "usable", (F.col("_i") + 1).alias("page"), "content", F.length("content").alias("content_length")), errors


def load_catalog(spark: SparkSession, folder: str, tables: Sequence[str] = CATALOG) -> dict[str, DataFrame]:
    """Stored tables by name, as lazy Parquet scans."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in tables}


def load_catalog_jdbc(spark: SparkSession, url: str, properties: dict[str, str], partition: dict[str, tuple[str, int, int, int]] | None = None,
                      tables: Sequence[str] = CATALOG) -> dict[str, DataFrame]:
    """Stored tables from a database; ``partition`` names (column, low, high, parts) of big ones."""
    out = {}
    for name in tables:
        if partition and name in partition:
            column, low, high, parts = partition[name]
            out[name] = spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)
        else:
            out[name] = spark.read.jdbc(url, name, properties=properties)
    return out


def scan_results(jobs: DataFrame, col: str = "result_data") -> DataFrame:
    """Stored result texts as JSON; what does not parse becomes an empty object."""
    value = F.try_parse_json(col)
    shown = F.when(F.schema_of_variant(value) != "VOID", F.to_json(value))
    return jobs.withColumn("result", F.coalesce(shown, F.lit("{}"))).drop(col)


def storage_keys(files: DataFrame, prefix: str = "") -> DataFrame:
    """Add ``safe_name`` and ``storage_key`` (prefix/job/name) of uploaded files."""
    clean = prefix.strip("/")
    named = files.withColumn("safe_name", text.safe_name(F.col("file_name")))
    parts = [F.lit(clean)] if clean else []
    return named.withColumn("storage_key", F.concat_ws("/", *parts, "job_id", "safe_name"))


def file_stem(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn("stem", text.file_stem(F.col(col)))
