"""Record quality: totals against line sums, row coverage, repair and retry choices."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctables.functions.money import to_num

# Tolerances of a total (absolute, and relative to the line sum) and repair limits.
TOTAL_TOLERANCE, TOTAL_SHARE = 0.02, 0.001
MAX_REPAIR_ROWS = 500
MAX_RETRY_GAP = 5


def line_value(spec: dict) -> Column:
    """Value of one line under an amount rule: a column, or quantity times price where both parse."""
    if spec["type"] == "product":
        return to_num(F.col(spec["qty"])) * to_num(F.col(spec["price"]))
    return to_num(F.col(spec["name"]))


def exact_sum(value: Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows, 0 without any.

    Added up as decimals with ten places; only where a value or the sum does not fit one, as doubles.
    """
    exact = value.try_cast("decimal(38,10)")
    fits = F.count_if(value.isNotNull() & exact.isNull()) == 0
    return F.coalesce(F.when(fits, F.try_sum(exact)).cast("double"), F.sum(value), F.lit(0.0))


def line_sums(items: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """Line sum and row count per document and array; arrays without an amount rule are left out."""
    value = None
    for array, spec in specs.items():
        hit = F.col("array_name") == array
        value = F.when(hit, line_value(spec)) if value is None else value.when(hit, line_value(spec))
    rows = items.where(F.col("array_name").isin(list(specs)))
    return rows.groupBy("doc_id", "array_name").agg(
        exact_sum(value).alias("line_sum"),
        F.count("*").alias("n_rows"))


def name_tokens(c: Column) -> Column:
    """Name parts longer than two characters, lower case."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: F.length(x) > 2)


def relevant_arrays(totals: DataFrame, arrays: DataFrame) -> DataFrame:
    """Arrays that share a name part with a total; all arrays of the group when none does.

    ``totals`` has (group_id, total_path), ``arrays`` has (group_id, array_name).
    """
    pairs = totals.withColumn("_t", name_tokens(F.col("total_path"))).join(
        arrays.withColumn("_a", name_tokens(F.col("array_name"))), "group_id")
    pairs = pairs.withColumn("_match", F.arrays_overlap("_t", "_a"))
    matched = pairs.where("_match").select("group_id", "total_path", "array_name")
    rest = pairs.join(matched.select("group_id", "total_path").distinct(), ["group_id", "total_path"], "left_anti")
    return matched.unionByName(rest.select("group_id", "total_path", "array_name"))


def named_arrays(total: str, arrays: Sequence[str]) -> list[str]:
    """:func:`relevant_arrays` of one total, for names that are configuration."""
    def parts(name: str) -> set[str]:
        return {p for p in re.split("[^a-z0-9]+", name.lower()) if len(p) > 2}
    return [a for a in arrays if parts(a) & parts(total)] or list(arrays)


def within_tolerance(total: Column, line_sum: Column) -> Column:
    diff = F.abs(total - line_sum)
    return (diff <= TOTAL_TOLERANCE) | (diff <= F.abs(line_sum) * TOTAL_SHARE)


def two_places(c: Column) -> Column:
    return F.coalesce(F.round(c, 2).try_cast("decimal(38,2)").cast("string"), c.cast("string"))


def totals_report(headers: DataFrame, sums: DataFrame, totals: Sequence[str], links: dict[str, Sequence[str]] | None = None,
                  labels: dict[str, str] | None = None, arrays: Sequence[str] | None = None) -> DataFrame:
    """Totals that are missing or do not agree with their line items; one row per document and total.

    ``sums`` comes from ``line_sums``. ``links`` names the arrays of a total; without it a total belongs to the arrays that share a
    part of its name, else to all (see ``relevant_arrays``). ``arrays`` names all arrays; without it they are looked up in ``sums``, which
    are then computed twice. A document without any item row gives no row at all.
    """
    labels, links = labels or {}, links or {}
    spark = headers.sparkSession
    if arrays is not None:
        links = {t: links.get(t) or named_arrays(t, arrays) for t in totals}
    free = [(0, t) for t in totals if arrays is None and not links.get(t)]
    pairs = spark.createDataFrame([(t, a) for t in totals for a in links.get(t) or ()], "total_path string, array_name string")
    if free:
        names = sums.select(F.lit(0).alias("group_id"), "array_name").distinct()
        found = relevant_arrays(spark.createDataFrame(free, "group_id int, total_path string"), names).select("total_path", "array_name")
        pairs = pairs.unionByName(found) if links else found
    part = sums.join(pairs, "array_name").groupBy("doc_id", "total_path").agg(
        exact_sum(F.col("line_sum")).alias("line_sum"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_arrays"),
        F.array_join(F.array_sort(F.collect_set("array_name")), " + ").alias("arrays"))
    values = headers.select("doc_id", F.inline(F.array(*(F.struct(F.lit(t).alias("total_path"), to_num(F.col(t)).alias("total_value")) for t in totals))))
    out = values.join(part, ["doc_id", "total_path"]).where(F.col("n_rows") > 0)
    status = F.when(F.col("total_value").isNull(), "missing").when(
        ~within_tolerance(F.col("total_value"), F.col("line_sum")), "mismatch")
    out = out.withColumn("status", status).where(F.col("status").isNotNull())
    diff = F.abs(F.col("total_value") - F.col("line_sum"))
    label = F.col("arrays")
    for array, text in labels.items():
        label = F.replace(label, F.lit(array), F.lit(text))
    message = F.when(F.col("status") == "missing", F.concat(
        F.col("total_path"), F.lit(" is missing; its line items ("), label, F.lit(") sum to "), two_places(F.col("line_sum")))).otherwise(F.concat(
            F.col("total_path"), F.lit(" = "), two_places(F.col("total_value")), F.lit(", line items ("), label, F.lit(") sum to "),
            two_places(F.col("line_sum")), F.lit(", difference "), two_places(diff)))
    return out.select("doc_id", "total_path", "status", "total_value", "line_sum", F.round(diff, 2).alias("difference"), message.alias("message"))


def merge_corrected(current: DataFrame, corrected: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Take corrected values, but never replace a line-item array that has rows.

    ``corrected`` has one row per corrected document; null there means "not given".
    """
    new = [c for c in corrected.columns if c != "doc_id"]
    joined = current.join(corrected.select("doc_id", *[F.col(c).alias(f"_new_{c}") for c in new]), "doc_id", "left")
    cols = []
    for c in current.columns:
        if c not in new:
            cols.append(F.col(c))
        elif c in arrays:
            cols.append(F.when(F.size(c) > 0, F.col(c)).otherwise(F.coalesce(f"_new_{c}", c)).alias(c))
        else:
            cols.append(F.coalesce(f"_new_{c}", c).alias(c))
    return joined.select(*cols)


def guard_repair(prev: DataFrame, new: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """A repaired document, except that an array the repair emptied keeps its rows."""
    old = prev.select("doc_id", *[F.col(a).alias(f"_old_{a}") for a in arrays])
    joined = new.join(old, "doc_id", "left")
    return joined.select(*[
        F.when((F.size(c) == 0) & (F.size(f"_old_{c}") > 0), F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) if c in arrays else F.col(c)
        for c in new.columns])


def expected_rows(page_counts: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Expected rows per document and array: the sum of the page counts when every page has one, else
    the fallback count."""
    summed = page_counts.groupBy("doc_id", "array_name").agg(
        F.when(F.count("counted") == F.count("*"), F.sum("counted")).alias("_sum"))
    if fallback is None:
        return summed.select("doc_id", "array_name", F.col("_sum").cast("bigint").alias("expected"))
    other = fallback.select("doc_id", "array_name", F.col("counted").alias("_fallback"))
    return summed.join(other, ["doc_id", "array_name"], "left").select(
        "doc_id", "array_name", F.coalesce("_sum", "_fallback").cast("bigint").alias("expected"))


def coverage_gap(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Arrays whose row count is not the expected one; an array without rows counts as 0."""
    keys = [c for c in expected.columns if c != "expected"]
    joined = expected.where(F.col("expected").isNotNull()).join(actual, keys, "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.where(F.col("actual") != F.col("expected")).select(*keys, "expected", "actual")


def row_counts(items: DataFrame, keys: Sequence[str] = ("doc_id", "array_name")) -> DataFrame:
    return items.groupBy(*keys).agg(F.count("*").alias("actual"))


def gap_total(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("doc_id").agg(F.sum(F.abs(F.col("expected") - F.col("actual"))).alias("gap"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """``name: actual/expected, …`` per document."""
    text = F.concat("array_name", F.lit(": "), F.col("actual").cast("string"), F.lit("/"), F.col("expected").cast("string"))
    return gaps.groupBy("doc_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("array_name", text.alias("text")))), lambda g: g["text"]), ", ").alias("summary"))


def coverage_report(items: DataFrame, counts: DataFrame, max_rows: int = MAX_REPAIR_ROWS) -> DataFrame:
    """Gaps per document and array, and whether the document is small enough to be repaired in one go."""
    actual = row_counts(items)
    sizes = actual.groupBy("doc_id").agg(F.sum("actual").alias("doc_rows"))
    gaps = coverage_gap(actual, counts.select("doc_id", "array_name", F.col("counted").cast("bigint").alias("expected")))
    return gaps.join(sizes, "doc_id", "left").withColumn(
        "repairable", F.coalesce("doc_rows", F.lit(0)) <= max_rows).drop("doc_rows")


def page_coverage(items: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Gaps per document, page and array."""
    keys = ["doc_id", "page", "array_name"]
    return coverage_gap(row_counts(items, keys), page_counts.select(*keys, F.col("counted").cast("bigint").alias("expected")))


def best_attempt(attempts: DataFrame, min_rows: Column | int = 0) -> DataFrame:
    """Attempt with the most rows per document, the earliest on a tie; null when it has too few.

    As in a run that stops early, attempts after the first one that is good enough do not count.
    """
    least = F.lit(min_rows) if isinstance(min_rows, int) else min_rows
    good = attempts.withColumn("_least", least)
    first_good = good.where(F.col("rows") >= F.col("_least")).groupBy("doc_id").agg(F.min("attempt").alias("_stop"))
    used = good.join(first_good, "doc_id", "left").where(F.col("_stop").isNull() | (F.col("attempt") <= F.col("_stop")))
    rank = Window.partitionBy("doc_id").orderBy(F.desc("rows"), F.asc("attempt"))
    best = used.withColumn("_rn", F.row_number().over(rank)).where("_rn = 1")
    accepted = F.col("rows") >= F.col("_least")
    return best.select("doc_id", F.when(accepted, F.col("attempt")).alias("attempt"), "rows", accepted.alias("accepted"))


def choose_retry(first: DataFrame, second: DataFrame, expected: DataFrame, limit: int = MAX_RETRY_GAP) -> DataFrame:
    """Per document: its gap, and whether a retry is kept.

    A retry happens for a gap of 1 to ``limit`` and is kept only when its own gap is smaller.
    """
    gap_a = gap_total(coverage_gap(first, expected)).withColumnRenamed("gap", "_a")
    gap_b = gap_total(coverage_gap(second, expected)).withColumnRenamed("gap", "_b")
    docs = expected.select("doc_id").distinct().join(gap_a, "doc_id", "left").join(gap_b, "doc_id", "left")
    a, b = F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))
    retried = (a > 0) & (a <= limit)
    kept = retried & (b < a)
    return docs.select("doc_id", a.alias("first_gap"), F.when(retried, b).alias("retry_gap"), retried.alias("retried"),
                       F.when(kept, "retry").otherwise("first").alias("chosen"), F.when(kept, b).otherwise(a).alias("final_gap"))
