"""Page tables: assembling, selecting, regrouping and judging pages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doctables.operators.scan import carry_forward, page_block

# Separators between pages of returned markdown and of extraction input.
RULE_SEPARATOR = "\n\n---\n\n"
BLANK_SEPARATOR = "\n\n"
CONTEXT_MARKER = "===== CURRENT PAGE BELOW ====="


def join_ordered(order: Sequence[str], text: str, sep: str) -> Column:
    """Aggregate: the texts of a group in order, joined by ``sep``."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return F.array_join(F.transform(rows, lambda r: r[text]), sep)


def assemble(pages: DataFrame, sep: str = RULE_SEPARATOR) -> DataFrame:
    """One text per document, pages in order."""
    return pages.groupBy("doc_id").agg(join_ordered(["page"], "content", sep).alias("markdown"))


def parse_page_spec(spec: str | None) -> list[tuple[int, int]]:
    """Closed page ranges of a spec such as ``1,3,5-7``; bad parts are ignored."""
    ranges = []
    for part in (spec or "").split(","):
        found = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part.strip(), flags=re.ASCII)
        if found:
            a, b = int(found[1]), int(found[2] or found[1])
            ranges.append((min(a, b), max(a, b)))
    return ranges


def filter_pages(pages: DataFrame, spec: str | None) -> DataFrame:
    """Keep the pages of a range; a document without any such page stays whole."""
    ranges = parse_page_spec(spec)
    if not ranges:
        return pages
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | F.col("page").between(low, high)
    matched = pages.where(inside).select("doc_id").distinct().withColumn("_matched", F.lit(True))
    return pages.join(matched, "doc_id", "left").where(inside | F.col("_matched").isNull()).drop("_matched")


def with_page_context(pages: DataFrame, n: int = 25, marker: str = CONTEXT_MARKER) -> DataFrame:
    """Add ``input``: the last ``n`` lines of the previous page, a marker and the page."""
    lines = F.split("content", "\n")
    tail = F.array_join(F.slice(lines, F.greatest(F.size(lines) - (n - 1), F.lit(1)), n), "\n")
    out = carry_forward(pages, ["doc_id"], ["page"], tail, "_tail", page_block(F.col("page")), inclusive=False)
    return out.withColumn("input", F.when(F.col("_tail").isNull(), F.col("content")).otherwise(
        F.concat("_tail", F.lit(f"\n\n{marker}\n\n"), "content"))).drop("_tail")


def regroup_tiles(tiles: DataFrame) -> DataFrame:
    """Join page tiles (``…_page_00001_03.png``) into pages; missing tiles are skipped."""
    stem = F.regexp_extract("tile_name", r"^(.*_page_\d{5})(?:_\d+)?\.png$", 1)
    keyed = tiles.withColumn("page_key", F.when(stem != "", stem).otherwise(F.col("tile_name")))
    return keyed.groupBy("doc_id", "page_key").agg(
        join_ordered(["tile_name"], "content", BLANK_SEPARATOR).alias("content")
    ).withColumn("content_length", F.length("content"))


def page_scan_flags(pages: DataFrame, min_chars: int = 30, min_coverage: float = 0.25) -> DataFrame:
    """Flag pages that hold an image instead of text."""
    area = F.when(F.col("page_area") == 0, F.lit(1.0)).otherwise(F.col("page_area"))
    coverage = F.least(F.col("image_area") / area, F.lit(1.0))
    return pages.withColumn("image_coverage", coverage).withColumn(
        "scanned", (F.col("char_count") < min_chars) & (F.col("image_coverage") >= min_coverage))


def doc_usability(pages: DataFrame, min_avg: float = 30) -> DataFrame:
    """Per document: page and character counts, scanned pages, and whether the text is usable."""
    stats = pages.groupBy("doc_id").agg(
        F.count("page").alias("total"),
        F.coalesce(F.sum("content_length"), F.lit(0)).cast("bigint").alias("total_chars"),
        F.count_if(F.col("scanned") & F.col("page").isNotNull()).alias("n_scanned"),
        F.array_sort(F.collect_list(F.when(F.col("scanned"), F.col("page") - 1))).alias("scanned_pages"),
    )
    average = F.coalesce(F.try_divide("total_chars", "total"), F.lit(0.0))
    share = F.coalesce(F.try_divide("n_scanned", "total"), F.lit(0.0))
    return stats.select(
        "doc_id", "total", "total_chars", F.round(average, 2).alias("avg_chars"), "scanned_pages",
        F.round(share, 4).alias("scanned_share"), ((average >= min_avg) & (share < 1.0)).alias("usable"))


def route_docs(docs: DataFrame) -> DataFrame:
    """Text path for usable PDF documents, conversion for everything else."""
    ext = F.lower(F.regexp_extract("file_name", r"\.([^.]*)$", 1))
    text_path = (ext == "pdf") & F.coalesce(F.col("usable"), F.lit(False)) & (F.coalesce(F.col("total"), F.lit(0)) > 0)
    return docs.withColumn("source", F.when(text_path, "text").otherwise("needs_conversion"))


def extraction_plan(docs: DataFrame) -> DataFrame:
    """Whole-document or per-page extraction, the number of attempts and the least rows accepted."""
    has_arrays = F.col("n_arrays") > 0
    whole = (F.col("n_pages") <= 20) & ~F.col("per_page")
    return (
        docs.withColumn("strategy", F.when(whole | ~has_arrays, "document").otherwise("page"))
        .withColumn("attempts", F.when(whole & has_arrays, 2).otherwise(1))
        .withColumn("min_rows", F.when(whole & (F.col("n_pages") >= 6), 5).otherwise(0))
        .withColumn("protect_arrays", ((F.col("n_pages") > 20) | F.col("per_page")) & has_arrays)
    )


def tile_grid(images: DataFrame, max_side: int = 2400, overlap: float = 0.04, max_tiles: int = 16) -> DataFrame:
    """Overlapping tiles of oversized page images, row by row; other images stay one tile."""
    w, h = F.col("width"), F.col("height")
    rows = F.when(h > max_side, F.ceil(h / max_side)).otherwise(1).cast("int")
    cols = F.when((w > max_side) & (w > h), F.ceil(w / max_side)).otherwise(1).cast("int")
    whole = (rows * cols > max_tiles) | (w <= 0) | (h <= 0)
    out = images.withColumn("n_rows", F.when(whole, 1).otherwise(rows)).withColumn(
        "n_cols", F.when(whole, 1).otherwise(cols))
    out = out.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("n_rows") * F.col("n_cols") - 1)))
    split = (F.col("n_rows") * F.col("n_cols")) > 1
    tile_w, tile_h = F.ceil(w / F.col("n_cols")), F.ceil(h / F.col("n_rows"))
    ov_x = F.when(split, F.floor(tile_w * overlap)).otherwise(0)
    ov_y = F.when(split, F.floor(tile_h * overlap)).otherwise(0)
    left = F.greatest((F.col("tile") % F.col("n_cols")) * tile_w - ov_x, F.lit(0))
    top = F.greatest(F.floor(F.col("tile") / F.col("n_cols")) * tile_h - ov_y, F.lit(0))
    out = out.withColumn("left", left.cast("bigint")).withColumn("top", top.cast("bigint"))
    full_w = tile_w + ov_x * F.when(F.col("left") == 0, 1).otherwise(2)
    full_h = tile_h + ov_y * F.when(F.col("top") == 0, 1).otherwise(2)
    return out.withColumn("tile_width", F.least(full_w, w - F.col("left")).cast("bigint")).withColumn(
        "tile_height", F.least(full_h, h - F.col("top")).cast("bigint"))


def pick_with_margin(df: DataFrame, keys: Sequence[str], choice: str, score: str, min_score: float,
                     margin: float, default) -> DataFrame:
    """Best candidate per group when it is good enough and leads clearly, else the default.

    Equal scores keep the smallest choice first.
    """
    # a rank filter of 2 is applied before the shuffle, so a very large group stays cheap
    rank = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(choice))
    top = df.withColumn("_rank", F.row_number().over(rank)).where("_rank <= 2")
    pair = top.groupBy(*keys).agg(
        F.max(F.when(F.col("_rank") == 1, F.col(choice))).alias("_best"),
        F.max(F.when(F.col("_rank") == 1, F.col(score))).alias("top_score"),
        F.max(F.when(F.col("_rank") == 2, F.col(score))).alias("second_score"))
    clear = (F.col("_best") != F.lit(default)) & (F.col("top_score") >= min_score) & (
        F.col("second_score").isNull() | (F.col("top_score") - F.col("second_score") >= margin))
    return pair.select(*keys, F.when(clear, F.col("_best")).otherwise(F.lit(default)).alias("chosen"),
                       "top_score", "second_score")


def head_samples(docs: DataFrame, sizes: Sequence[int] = (30000, 10000, 4000)) -> DataFrame:
    """Head samples of shrinking size; sizes that coincide after capping appear once."""
    capped = F.array_distinct(F.array(*[F.least(F.lit(s), F.length("text")) for s in sizes]))
    return docs.select("*", F.posexplode(capped).alias("attempt", "sample_size")).withColumn(
        "sample", F.expr("substring(text, 1, sample_size)"))


def estimate_time(docs: DataFrame) -> DataFrame:
    """Processing-time estimate in ms and its label."""
    pages = F.when(F.coalesce(F.col("n_pages"), F.lit(0)) == 0, 1).otherwise(F.col("n_pages"))
    per_page = F.when(pages > 20, 8).when(F.col("has_schema"), 12).otherwise(6)
    extraction = (5 + pages * per_page) * 1000
    inference = pages * 25000 + 15000
    is_schema_job = F.col("kind") == "schema"
    ms = F.when(is_schema_job, inference).otherwise(extraction).cast("bigint")
    short = F.concat(F.when(is_schema_job, "~").otherwise(""), F.floor(ms / 1000 + 0.5).cast("string"), F.lit("s"))
    minutes = F.concat(F.lit("~"), F.floor(ms / 60000 + 0.5).cast("string"), F.lit(" min"))
    return docs.withColumn("estimate_ms", ms).withColumn("estimate", F.when(ms < 60000, short).otherwise(minutes))
