"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

A listed entry is a host with a path, as text ``host/path``; it fits its host and all subdomains where the url's path starts
with its path. For each url the canonical keys that an entry could have (host suffix and path prefix, of the shapes that the
list has) are tested against the filter inside the row; only keys that pass reach the join, which removes false positives.
Expressions of Spark only, no Python code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WORDS_PER_BLOCK = 4
BITS_PER_WORD = 2
#: Keys a block is sized for, and the most blocks. Beyond them more keys pass the filter; the join still decides.
KEYS_PER_BLOCK = 20
MAX_BLOCKS = 1 << 15

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)), F.lit(""))


def _mask(key: str, word: int) -> str:
    """The bits of one word that a key sets: two slices of its second hash."""
    bits = [f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 1), {6 * (word * BITS_PER_WORD + i)}) & 63L as int))" for i in range(BITS_PER_WORD)]
    return "(" + " | ".join(bits) + ")"


def _block(key: str, blocks: int) -> str:
    return f"cast(pmod(xxhash64({key}), {blocks}) as int)"


def bloom_literal(keys: DataFrame, blocks: int) -> str:
    """The filter over column ``key`` as a foldable SQL array of ``blocks * 4`` longs (1 MB at most)."""
    words = [F.bit_or(F.expr(_mask("key", w))).alias(f"w{w}") for w in range(WORDS_PER_BLOCK)]
    flat = [0] * (blocks * WORDS_PER_BLOCK)
    for row in keys.select("key", F.expr(_block("key", blocks)).alias("b")).groupBy("b").agg(*words).collect():
        flat[row.b * WORDS_PER_BLOCK:(row.b + 1) * WORDS_PER_BLOCK] = row[1:]
    return "cast(split('" + ",".join(map(str, flat)) + "', ',') as array<bigint>)"


def judge_urls(urls: DataFrame, listed: DataFrame, keep: tuple[str, ...] = ("page_id",), url: str = "url", default: str = "allow") -> DataFrame:
    """One row per url: the columns ``keep``, host, path, rule and verdict.

    ``listed`` has ``rule`` (``host/path`` or a host alone) and ``verdict``; null rules and repeated entries are left out (of
    repeated ones the smallest verdict stays). The longest fitting rule decides, else rule is null and the verdict is
    ``default``. Null or empty urls, and urls without ``://``, have an empty host and path. An empty list gives the default. A kept column
    that has the name of a result column comes back with an underscore behind it. Urls that the filter rules out take no part in the join.
    """
    out = [F.col(f"_keep{i}").alias(c + "_" if c.lower() in ("host", "path", "rule", "verdict") else c) for i, c in enumerate(keep)]
    held = [f"_keep{i}" for i in range(len(keep))]
    listed = (listed.where("rule is not null").select(F.col("rule").alias("key"), "verdict").groupBy("key").agg(F.min("verdict").alias("verdict")))
    slash = F.instr("key", "/")
    host = F.when(slash > 0, F.substring("key", F.lit(1), slash - 1)).otherwise(F.col("key"))
    shapes = listed.select(F.size(F.split(host, r"\.")).alias("labels"), (F.length("key") - F.length(host)).alias("chars"))
    found = shapes.groupBy("labels", "chars").count().collect()  # bounded by labels in a host times characters in a path
    total = sum(r["count"] for r in found)
    rows = urls.select(*(F.col(c).alias(h) for c, h in zip(keep, held)), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not found:
        return rows.select(*out, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = min(MAX_BLOCKS, max(1, -(-total // KEYS_PER_BLOCK)))
    bloom = bloom_literal(listed, blocks)
    shape = "array(" + ",".join(f"named_struct('l', {r.labels}, 'c', {r.chars})" for r in sorted(found)) + ")"
    keys = (f"transform(filter({shape}, s -> s.l <= size(split(host, '[.]')) and s.c <= length(path)), "
            "s -> concat(substring_index(host, '.', -s.l), substring(path, 1, s.c)))")
    test = " and ".join(f"({bloom}[{_block('k', blocks)} * {WORDS_PER_BLOCK} + {w}] & {_mask('k', w)}) = {_mask('k', w)}" for w in range(WORDS_PER_BLOCK))
    probed = rows.select(*held, "host", "path", F.expr(f"filter({keys}, k -> {test})").alias("_keys"))
    free = probed.where(F.size("_keys") == 0).select(*out, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    asked = probed.where(F.size("_keys") > 0).withColumn("_row", F.monotonically_increasing_id())
    joined = asked.select("_row", *held, "host", "path", F.explode("_keys").alias("key")).join(listed, "key", "left")
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("key").alias("n"), "key", "verdict")))
    picked = joined.groupBy("_row").agg(*(F.first(c).alias(c) for c in (*held, "host", "path")), best.alias("_best"))
    return free.unionByName(picked.select(*out, "host", "path", F.col("_best.key").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict")))


RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op4_url_filter(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, spark.createDataFrame(list(RULES), "rule string, verdict string"))


_FITS = {rule: f"(path LIKE '{rule[rule.index('/'):]}%' AND (host = '{rule[:rule.index('/')]}' OR host LIKE '%.{rule[:rule.index('/')]}'))" for rule, _ in RULES}
_LONGEST = sorted(RULES, key=lambda r: -len(r[0]))
SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut)
SELECT page_id, host, path,
  CASE {' '.join(f"WHEN {_FITS[r]} THEN '{r}'" for r, _ in _LONGEST)} END AS rule,
  CASE {' '.join(f"WHEN {_FITS[r]} THEN '{v}'" for r, v in _LONGEST)} ELSE 'allow' END AS verdict
FROM parts
"""
