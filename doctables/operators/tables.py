"""Table maintenance as DataFrame rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctables.operators.jobs import TERMINAL
from doctables.operators.scan import number_rows

# What a new job gets where nothing is given.
JOB_DEFAULTS = {"file_name": "", "pages": 0, "status": "in-progress", "calls": 0, "user_id": "system"}


def append_jobs(jobs: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Add jobs, filling defaults."""
    for name, value in {**JOB_DEFAULTS, "created_at": now}.items():
        kind = jobs.schema[name].dataType
        given = F.col(name).cast(kind) if name in new.columns else F.lit(None).cast(kind)
        new = new.withColumn(name, F.coalesce(given, F.lit(value).cast(kind)))
    return jobs.unionByName(new, allowMissingColumns=True)


def patch(target: DataFrame, patches: DataFrame, key: str, now: int | None = None) -> DataFrame:
    """Change only the columns a patch supplies; a terminal status stamps the completion time.

    ``patches`` holds one row per key; null means "not supplied".
    """
    changed = [c for c in patches.columns if c != key]
    new = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    out = target.join(new, key, "left")
    for c in changed:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c))
    if "status" in changed and now is not None and "completed_at" in target.columns:
        done = F.col("_new_status").isin(*TERMINAL)
        out = out.withColumn("completed_at", F.when(done, F.lit(now).cast("bigint")).otherwise(F.col("completed_at")))
    return out.select(*target.columns)


def delete_keys(target: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return target.join(keys.select(*on).distinct(), list(on), "left_anti")


def insert_new(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert the rows whose key is not there yet."""
    return target.unionByName(new.join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(target: DataFrame, updates: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """Insert or replace by key: an update beats a stored row; among several rows of one side the latest version wins."""
    both = target.withColumn("_src", F.lit(0)).unionByName(updates.withColumn("_src", F.lit(1)))
    latest = Window.partitionBy(*key).orderBy(F.desc("_src"), F.desc(version))
    return both.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn", "_src")


def assign_ids(new: DataFrame, order: Sequence[str], start: int = 0, prefix: str = "np_") -> DataFrame:
    """Sequential ids that continue a counter: at least three digits, more when needed."""
    numbered = number_rows(new, order, "_no").withColumn("_no", F.col("_no") + start)
    digits = F.col("_no").cast("string")
    return numbered.withColumn("id", F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0")))).drop("_no")


def union_pages(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of several page row sets, with the set's number as ``part``."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both sides once, by content; the order of the columns does not matter."""
    return a.unionByName(b).distinct()
