"""Secret scan with an incremental blob ledger.

Every version of a text is addressed by its SHA-256. The ledger, a Parquet table in the shared folder, holds one row per blob and
rule version that has been scanned, with its findings. A scan keeps the distinct blobs, leaves out the pairs that the ledger has,
scans the rest once each, appends them, and joins the findings back to all paths by blob. Texts move once, after copies have
been folded before the shuffle; the join back moves addresses only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from doctables.llm.common import column, free_name, slices, written
from doctables.session import scratch_path

#: kind -> (pattern, group whose length counts, least length); letters of ``assign`` keys are in either case
RULES = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
#: Equal matches, found faster: runs below the length are skipped by the pattern itself.
_FAST = {r"[0-9a-f]+": r"[0-9a-f]{%d,}"}

FINDING = "struct<start:int,kind:string,end:int>"


def rule_version(rules: dict) -> str:
    return hashlib.sha256(repr(sorted(rules.items())).encode()).hexdigest()[:16]


def find_secrets(text: str, compiled: list) -> list[dict]:
    """Leftmost matches that do not overlap, for each kind, as code points; sorted by start, then by the order of the kinds."""
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, group, least) in enumerate(compiled)
             for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [{"start": s, "kind": kind, "end": e} for s, _, kind, e in sorted(found)]


def compile_rules(rules: dict) -> list:
    return [(kind, re.compile(_FAST[p] % least if p in _FAST else p, re.ASCII), group, least) for kind, (p, group, least) in rules.items()]


def _scanner(rules: dict):
    kind = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compile_rules(rules)
        for batch in slices(batches):
            found = [find_secrets(t, compiled) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "blob"), pa.array(found, pa.list_(kind))], ["blob", "findings"])
    return scan


def address(text: str = "text"):
    """The blob of a text: the SHA-256 of its bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def read_ledger(spark, ledger: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"blob binary, rules string, findings array<{FINDING}>").parquet(ledger)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def update_ledger(versions: DataFrame, ledger: str, rules: dict = RULES) -> DataFrame:
    """Scan the unseen blobs of ``versions (text)``, append them to the ledger, and return ``(blob, findings)`` for these rules.

    A blob that is scanned twice by writers at the same time gives equal rows; they are folded when read.
    """
    spark, version = versions.sparkSession, rule_version(rules)
    known = read_ledger(spark, ledger)
    blobs = versions.select(address().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    if known is not None:
        blobs = blobs.join(known.where(F.col("rules") == version).select("blob"), "blob", "left_anti")
    unseen = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    scanned = unseen.mapInArrow(_scanner(rules), f"blob binary, findings array<{FINDING}>")
    scanned.select("blob", F.lit(version).alias("rules"), "findings").write.mode("append").parquet(ledger)
    return (read_ledger(spark, ledger).where(F.col("rules") == version).groupBy("blob").agg(F.first("findings").alias("findings")))


def scan_versions(versions: DataFrame, ledger: str, paths: tuple[str, ...] = ("doc_id",), rules: dict = RULES) -> DataFrame:
    """One row per row of ``versions``: its path columns and ``findings array<struct<start, kind, end>>``.

    ``text`` null or empty: no findings. Repeated rows each get a row. An empty table gives no rows; other columns are ignored.
    """
    # stored, so that the join is one that Spark can send whole or split at an often repeated blob
    found = written(update_ledger(versions, ledger, rules).where(F.size("findings") > 0), "found")
    placed = versions.select(*paths, address().alias("_blob"))
    return (placed.join(found.select(F.col("blob").alias("_blob"), "findings"), "_blob", "left")
            .select(*paths, F.coalesce("findings", F.expr(f"cast(array() as array<{FINDING}>)")).alias("findings")))


def redact(text: str, findings: list, mark: str = "[{}]") -> str:
    """The text with each run of overlapping findings replaced by ``[kind]`` of its first finding."""
    out, at = [], 0
    for f in findings:
        if f["start"] >= at:
            out += [text[at:f["start"]], mark.format(f["kind"])]
        at = max(at, f["end"])
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, ledger: str, rules: dict = RULES) -> DataFrame:
    """All rows and columns of ``docs``; texts with findings are redacted, and ``n_chars``, where there is one, follows."""
    blob, findings = free_name(docs, "_blob"), free_name(docs, "_findings")

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [redact(t, f) if f else t for t, f in zip(column(batch, "text").to_pylist(), column(batch, findings).to_pylist())]
            names = [n for n in batch.schema.names if n != findings]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else column(batch, n) for n in names], names)
    # only blobs with findings take part; the stored table has a known size, so Spark picks the join
    found = written(update_ledger(docs, ledger, rules).where(F.size("findings") > 0).select(F.col("blob").alias(blob), F.col("findings").alias(findings)), "found")
    joined = docs.withColumn(blob, address()).join(found, blob, "left").drop(blob)
    out = joined.mapInArrow(put, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out


def op7_secret_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_versions(docs, scratch_path(spark, "ledger"))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    return found.select("doc_id", *(count(k) for k in RULES), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def _sql_spans(kind: str, pattern: str, group: int, least: int) -> str:
    inner = f"regexp_extract(m[i], '{pattern}', {group})" if group else "m[i]"
    return f"""
{kind}_cut AS (SELECT rid, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM d),
{kind} AS (SELECT rid, list_transform(list_filter(range(1, len(m) + 1), lambda i: length({inner}) >= {least}),
  lambda i: {{'s': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
         'k': {list(RULES).index(kind)}, 'n': length(m[i])}}) AS f FROM {kind}_cut)"""


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_ASSIGN = "(" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r")[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
{_sql_spans('assign', _ASSIGN, 2, 8)},
{_sql_spans('access', 'AKIA[A-Z0-9]+', 0, 16)},
{_sql_spans('hex', '[0-9a-f]+', 0, 32)},
lists AS (
  SELECT d.doc_id, a.f AS a, c.f AS c, h.f AS h, list_transform(list_sort(list_concat(a.f, c.f, h.f)),
    lambda x: ['assign', 'access', 'hex'][x.k + 1] || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT) AS spans
  FROM d JOIN assign a USING (rid) JOIN access c USING (rid) JOIN hex h USING (rid))
SELECT doc_id, len(a) AS n_assign, len(c) AS n_access, len(h) AS n_hex, sha256(array_to_string(spans, ',')) AS base_sha256,
  array_to_string(spans, ',') AS spans FROM lists
"""
