"""Sinks: CSV exports, markdown documents, job tables."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables.operators.export import CHARGES_COLUMNS

# Fixed value: extensions that a download name drops.
SOURCE_EXTENSION = r"(?i)\.(pdf|png|jpg|jpeg|txt|docx|html|xlsx|xls)$"
BOM = "\ufeff"


def export_name(file_name, kind: str):
    """Download name: the source name without its extension, plus ``-charges.csv`` or ``-details.csv``."""
    base = F.coalesce(F.nullif(file_name, F.lit("")), F.lit("task"))
    return F.concat(F.regexp_replace(base, SOURCE_EXTENSION, ""), F.lit(f"-{kind}.csv"))


def _csv(df: DataFrame, path: str, bom: bool) -> None:
    header = list(df.columns)
    if bom:
        df = df.withColumnRenamed(header[0], BOM + header[0])
    df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').option(
        "emptyValue", "").option("nullValue", "").option("ignoreLeadingWhiteSpace", "false").option(
        "ignoreTrailingWhiteSpace", "false").csv(path)


def write_charges_csv(charges: DataFrame, path: str, bom: bool = False) -> None:
    """Charges as CSV part files, each with the fixed header; rows of a document stay in order."""
    _csv(charges.sortWithinPartitions("doc_id", "row_no").select(*[F.col(f"`{c}`") for c in CHARGES_COLUMNS]), path, bom)


def write_details_csv(details: DataFrame, path: str, bom: bool = False, per_document: bool = False) -> None:
    """Key/value CSV; all keys of a document are always there.

    Part files hold many documents, with ``doc_id`` as their first column; ``per_document`` writes a folder for each instead, for
    tables of few documents.
    """
    rows = details.sortWithinPartitions("doc_id", "ord").select("doc_id", "Key", "Value")
    if not per_document:
        _csv(rows, path, bom)
        return
    if bom:
        rows = rows.withColumnRenamed("Key", BOM + "Key")
    rows.write.mode("overwrite").partitionBy("doc_id").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def write_markdown(docs: DataFrame, path: str, per_document: bool = False) -> None:
    """Documents (file_name, markdown), one row each, as JSON lines in part files.

    ``per_document`` writes a folder below ``path`` for each name, holding its text as a single file, for documents with different
    names.
    """
    if not per_document:
        docs.select("file_name", "markdown").write.mode("overwrite").json(path)
        return
    write_files(docs.select("file_name", F.col("markdown").alias("value")), path, "text")


def write_files(docs: DataFrame, path: str, kind: str) -> None:
    """A folder below ``path`` for each ``file_name``, with the other columns as a file: one text column (``text``) or a JSON object (``json``).

    In a mounted folder (``file:``) the tasks write the files themselves: Spark's writer starts processes there to set the rights of each
    folder and file, and moves them one by one when the job ends. A task that runs again writes the same names, each in one step.
    Elsewhere Spark's writer is used.
    """
    folder = _mounted(docs.sparkSession, path)
    if folder is None:
        docs.write.mode("overwrite").partitionBy("file_name").format(kind).save(path)
        return
    # an earlier folder goes, the mark of a finished write comes
    docs.limit(0).write.mode("overwrite").partitionBy("file_name").format(kind).save(path)
    rest = [c for c in docs.columns if c != "file_name"]
    value = F.col(rest[0]) if kind == "text" else F.to_json(F.struct(*rest))
    named = docs.select("file_name", value.cast("binary").alias("value")).sortWithinPartitions("file_name")
    named.mapInArrow(_file_each(folder, "txt" if kind == "text" else kind), "n long").agg(F.sum("n")).collect()


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder that ``path`` is on every machine, or None in a store that only Spark reaches."""
    scheme = urlsplit(path).scheme or urlsplit(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")).scheme
    if scheme != "file":
        return None
    return unquote(urlsplit(path).path) if path.startswith("file:") else path


def _file_each(folder: str, ext: str):
    """Write rows sorted by name; rows of one name in a task share a file."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, rows, files = f"part-{task.partitionId():05d}.{ext}", [], 0
        last: str | None = None

        def write() -> None:
            # as Spark names the folder of a partition
            value = re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", last) if last else "__HIVE_DEFAULT_PARTITION__"
            own = f"{folder}/file_name={value}"
            os.makedirs(own, exist_ok=True)
            with open(f"{own}/.{name}-{task.taskAttemptId()}", "wb") as f:
                f.writelines(rows)
            os.replace(f.name, f"{own}/{name}")

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rows and (key or "") != (last or ""):
                    write()
                    files += 1
                    rows.clear()
                last = key
                rows += [value or b"", b"\n"]
        if rows:
            write()
            files += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([files], pa.int64())})
    return run


def write_jobs(jobs: DataFrame, path: str, grain: str = "day") -> None:
    """Jobs as Parquet by creation day (or month), nested columns as JSON text.

    The rebalance hint gathers small days into few files and splits a busy one over several tasks.
    """
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f.name) for f in jobs.schema]
    column = f"created_{grain}"
    when = F.to_date(F.date_trunc(grain, F.timestamp_millis("created_at")))
    jobs.select(*flat, when.alias(column)).hint("rebalance", column).write.mode("overwrite").partitionBy(column).parquet(path)
