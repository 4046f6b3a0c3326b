"""Text-to-column queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from doctables.functions import dates, money, text
from doctables.operators import text as X
from doctables.operators.extract import DOMAINS, apply_extractor, load_domain
from doctables.workload import query
from doctables.workload.fixtures import with_fixtures as fx

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8199) || chr(8239) || chr(65279) || chr(12288)"
WS += "".join(f" || chr({c})" for c in (5760, *range(8192, 8203), 8232, 8233, 8287))

# every document as a fenced block with an image link and separator runs
MARKED = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {tick} || 'markdown' || chr(10) || text || chr(10) || {tick}
  WHEN doc_id % 3 = 1 THEN '  ' || {tick} || 'markdown' || chr(10) || {tick} || 'markdown' || chr(10) || text || ' ![logo](http://x/y.png) ' || chr(10) || {tick} || chr(10) || {tick} || chr(10)
  ELSE repeat('_', 12) || text || repeat('-', 250) || repeat('=', 100) END AS content FROM {documents}"""
TICK = "'```'"
MARKED_DUCK = MARKED.format(tick=TICK, documents="documents")


def marked(t):
    return t.spark.sql(MARKED.replace("{tick}", TICK), documents=t.documents)


@query("t1_clean_markdown", f"""
WITH m AS ({MARKED_DUCK}), s0 AS (SELECT doc_id, trim(content, {WS}) AS c FROM m),
s1 AS (SELECT doc_id, CASE WHEN regexp_full_match(c, '(?s)```markdown\\n.*\\n```') THEN trim(c[13:-5], {WS}) ELSE c END AS c FROM s0),
s2 AS (SELECT doc_id, CASE WHEN regexp_full_match(c, '(?s)```markdown\\n.*\\n```') THEN trim(c[13:-5], {WS}) ELSE c END AS c FROM s1),
s3 AS (SELECT doc_id, CASE WHEN regexp_full_match(c, '(?s)```markdown\\n.*\\n```') THEN trim(c[13:-5], {WS}) ELSE c END AS c FROM s2)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(c, '!\\[[^\\]]*\\]\\([^)]*\\)\\s*', '', 'g'), '_{{10,}}', '---', 'g'), '[-=~*.]{{200,}}', '---', 'g')) AS digest FROM s3""")
def clean_markdown(t):
    return X.clean_markdown(marked(t), "content").select("doc_id", F.md5("content").alias("digest"))


@query("t2_normalize_markdown", "SELECT page_id, md5(replace(regexp_replace(html, '(?i)<br\\s*/?>', ' ', 'g'), '**', '')) AS digest FROM pages")
def normalize_markdown(t):
    return X.normalize_markdown(t.pages, "html").select("page_id", F.md5("html").alias("digest"))


def _rewrites(sql: str) -> str:
    steps = [("\\*\\*([^\\n]*?)\\*\\*|__([^\\n]*?)__", "\\1\\2"), ("\\*([^\\n]*?)\\*|_([^\\n]*?)_", "\\1\\2"), ("#+\\s", ""),
             ("\\[([^\\n]*?)\\]\\([^\\n]*?\\)", "\\1"), ("!\\[([^\\n]*?)\\]\\([^\\n]*?\\)", "\\1"), ("```[^\\n]*?\\n(?s:.*?)\\n```|`[^\\n]*?`", ""),
             (">+", ""), ("\\n{2,}", "\n"), ("\\|\\s*([^|]*?)\\s*\\|", "\\1"), ("-+", "")]
    for pattern, repl in steps:
        value = "chr(10)" if repl == "\n" else f"'{repl}'"
        sql = f"regexp_replace({sql}, '{pattern}', {value}, 'g')"
    return f"trim({sql}, {WS})"


@query("t3_markdown_to_text", fx(f"""
SELECT doc_id, md5({_rewrites("line || ' ' || '# [a' || line || '](u) `x` > ' || chr(10) || chr(10) || '_i_ --- ![p](q)'")}) AS digest FROM (
  SELECT doc_id, pos, line FROM rendered) UNION ALL SELECT -1 - doc_id, md5({_rewrites("text")}) FROM documents"""))
def markdown_to_text(t):
    lines = t.rendered.selectExpr("doc_id", "line || ' ' || '# [a' || line || '](u) `x` > ' || chr(10) || chr(10) || '_i_ --- ![p](q)' AS content")
    docs = t.documents.selectExpr("-1 - doc_id AS doc_id", "text AS content")
    return X.markdown_to_text(lines.unionAll(docs), "content").select("doc_id", F.md5("content").alias("digest"))


@query("t4_split_lines", """SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents""")
def split_lines(t):
    return X.split_lines(t.documents.select("doc_id", "text"), "text")


@query("t5_table_rows", fx("""
SELECT doc_id, page, pos, CAST(CASE kind WHEN 'movement' THEN 6 WHEN 'pairs' THEN 1 WHEN 'total' THEN 2 ELSE 4 END AS INT) AS n_cells,
  CASE kind WHEN 'pairs' THEN line[3:-3] ELSE amount_text END AS last_cell FROM rendered"""))
def table_rows(t):
    rows = X.table_rows(t.rendered.select("doc_id", "page", "pos", "line"))
    return rows.select("doc_id", "page", "pos", F.size("cells").alias("n_cells"), "last_cell")


@query("t6_extract_vocab", fx("""
SELECT doc_id, page, pos, CASE WHEN kind = 'movement' THEN replace(flights, ' ', '|') ELSE '' END AS flights,
  CASE WHEN kind = 'movement' THEN reg END AS registration,
  CASE kind WHEN 'movement' THEN date_text WHEN 'fee' THEN '22.07' ELSE '' END AS first_date,
  CASE WHEN kind = 'movement' THEN clock END AS time, CASE WHEN kind = 'movement' THEN origin END AS origin FROM rendered"""))
def extract_vocab(t):
    out = X.extract_vocab(t.rendered.select("doc_id", "page", "pos", "line"), DOMAINS["aviation"]["vocabulary"])
    return out.select("doc_id", "page", "pos", F.array_join("flights", "|").alias("flights"), "registration",
                      F.coalesce(F.get("dates", F.lit(0)), F.lit("")).alias("first_date"), "time", "origin")


@query("t6_all_dates", fx("""
SELECT doc_id, page, pos, CASE kind WHEN 'movement' THEN date_text || '|31/12/99|15-3' WHEN 'fee' THEN '22.07|31/12/99|15-3' ELSE '31/12/99|15-3' END ||
  CASE WHEN pos % 2 = 0 THEN '|7-11-2022' ELSE '' END AS dates FROM rendered"""))
def all_dates(t):
    """Lines with several dates: all of them in order, dates written without separators behind the others."""
    line = F.concat("line", F.lit(" 31/12/99 to 15-3 "), F.when(F.col("pos") % 2 == 0, "| 07112022 |").otherwise("| 07132022 |"))
    out = X.extract_vocab(t.rendered.select("doc_id", "page", "pos", line.alias("line")), DOMAINS["aviation"]["vocabulary"])
    return out.select("doc_id", "page", "pos", F.array_join("dates", "|").alias("dates"))


@query("t7_compact_dates", """
SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE
  CAST(extract(day FROM l_shipdate) AS VARCHAR) || '-' || CAST(extract(month FROM l_shipdate) AS VARCHAR) || '-' || CAST(extract(year FROM l_shipdate) AS VARCHAR) END AS dates
FROM lineitem""")
def compact_dates(t):
    # both fields with two digits, so that the split is unambiguous; every fourth month is out of range
    line = F.concat(F.lit("| "), F.date_format("l_shipdate", "dd"),
                    F.when(F.expr("l_linenumber % 4 = 0"), "47").otherwise(F.date_format("l_shipdate", "MM")),
                    F.date_format("l_shipdate", "yyyy"), F.lit(" | 12345 |"))
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), "l_partkey", "l_suppkey",
                             F.array_join(dates.compact_dates(line), ",").alias("dates"))


@query("t8_extract_amounts", fx("""
SELECT doc_id, pos, CAST(n AS INT) AS amount_no, token, CAST(replace(token, ',', '.') AS DOUBLE) AS amount FROM (
  SELECT *, unnest(tokens) AS token, unnest(range(len(tokens))) AS n FROM (
    SELECT doc_id, pos, CASE kind WHEN 'pairs' THEN [amount_text, fee_text] WHEN 'fee' THEN [fee_text, amount_text]
      WHEN 'movement' THEN CASE WHEN length(date_text) = 5 THEN [date_text, amount_text] ELSE [amount_text] END ELSE [amount_text] END AS tokens FROM rendered))"""))
def extract_amounts(t):
    return X.extract_amounts(t.rendered.select("doc_id", "pos", "line")).select("doc_id", "pos", "amount_no", "token", "amount")


AMOUNT_TEXT = """SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_quantity FROM {lineitem}"""


@query("t9_normalize_amounts", f"""
SELECT doc_id, l_partkey, l_suppkey, CASE l_linenumber % 6
  WHEN 0 THEN CAST(cents AS DOUBLE) / 100 WHEN 1 THEN CAST(cents AS DOUBLE) / 100 WHEN 2 THEN CAST(cents AS DOUBLE) / 100
  WHEN 3 THEN CASE WHEN cents < 1000 THEN CAST(cents AS DOUBLE) ELSE CAST(cents AS DOUBLE) / 100 END
  WHEN 4 THEN CAST(cents // 1000 || (cents % 1000 // 100) || (cents % 100 // 10) || (cents % 10) AS DOUBLE) END AS amount
FROM ({AMOUNT_TEXT.format(lineitem='lineitem')})""")
def normalize_amounts(t):
    base = t.spark.sql(AMOUNT_TEXT, lineitem=t.lineitem)
    written = F.expr("""CASE l_linenumber % 6
      WHEN 0 THEN 'EUR ' || regexp_replace(CAST(cents div 100 AS STRING), '(\\\\d)(?=(\\\\d{3})+$)', '$1.') || ',' || lpad(CAST(cents % 100 AS STRING), 2, '0')
      WHEN 1 THEN '**' || regexp_replace(CAST(cents div 100 AS STRING), '(\\\\d)(?=(\\\\d{3})+$)', '$1,') || '.' || lpad(CAST(cents % 100 AS STRING), 2, '0') || '** x 4'
      WHEN 2 THEN CAST(cents div 100 AS STRING) || ',' || lpad(CAST(cents % 100 AS STRING), 2, '0')
      WHEN 3 THEN CAST(cents AS STRING)
      WHEN 4 THEN CAST(cents div 1000 AS STRING) || ',' || lpad(CAST(cents % 1000 AS STRING), 3, '0')
      ELSE 'n/a' END""")
    return X.normalize_amounts(base.withColumn("amount", written), ["amount"]).select("doc_id", "l_partkey", "l_suppkey", "amount")


@query("t10_to_num", """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 5 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN CAST(floor(o_totalprice) AS DOUBLE)
  WHEN 3 THEN CAST(floor(o_totalprice) AS DOUBLE) / 1000 WHEN 4 THEN -1 * CAST(floor(o_totalprice) AS DOUBLE) END AS value FROM orders""")
def to_num(t):
    written = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN '$ ' || format_number(o_totalprice, 2) WHEN 1 THEN '€' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || 'abc'
      WHEN 2 THEN '(5)' WHEN 3 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || 'e-3' ELSE '-' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '.' END""")
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), money.to_num(written).alias("value"))


WRITTEN_DATE = """CASE o_orderkey % 8
  WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') || 'T10:30:00' WHEN 1 THEN date_format(o_orderdate, 'dd.MM.yyyy')
  WHEN 2 THEN date_format(o_orderdate, 'd') || ' ' || {month} || ' ' || date_format(o_orderdate, 'yyyy') || ' 9:15 PM'
  WHEN 3 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 4 THEN date_format(o_orderdate, 'dd/MM/yy') WHEN 5 THEN 'n/a'
  WHEN 6 THEN date_format(o_orderdate, 'dd/MM') ELSE {month} || ' ' || date_format(o_orderdate, 'd') || ', ' || date_format(o_orderdate, 'yyyy') END"""
MONTH_CASE = "CASE month(o_orderdate) " + " ".join(f"WHEN {i + 1} THEN '{m}'" for i, m in enumerate(dates.MONTHS)) + " END"

# two-digit years count from 2000; day and month swap where the text is ambiguous for the reader
PARTS_DUCK = """SELECT o_orderkey AS doc_id, o_orderkey % 8 AS k, CAST(day(o_orderdate) AS INT) AS d, CAST(month(o_orderdate) AS INT) AS m, CAST(year(o_orderdate) AS INT) AS y FROM orders"""


@query("t11_parse_dates", f"""
SELECT doc_id, CASE WHEN k NOT IN (5, 6) THEN CASE WHEN k = 4 THEN CAST(2000 + y % 100 AS INT) ELSE y END END AS year,
  CASE WHEN k NOT IN (5, 6) THEN CASE WHEN k = 3 AND d <= 12 THEN d ELSE m END END AS month,
  CASE WHEN k NOT IN (5, 6) THEN CASE WHEN k = 3 AND d <= 12 THEN m ELSE d END END AS day FROM ({PARTS_DUCK})""")
def parse_dates(t):
    docs = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.expr(WRITTEN_DATE.replace("{month}", MONTH_CASE)).alias("written"))
    return X.parse_dates(docs, ["written"], "DD").select("doc_id", "written_parts.*")


@query("t12_format_dates", """
SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, CASE WHEN l_linenumber % 5 = 0 THEN 'open' ELSE
  CAST(day(l_shipdate) AS VARCHAR) || ' ' || strftime(l_shipdate, '%b') || '-' || strftime(l_shipdate, '%y/%B/%m/%d') END AS date FROM lineitem""")
def format_dates(t):
    text_date = F.when(F.expr("l_linenumber % 5 = 0"), "open").otherwise(F.date_format("l_shipdate", "dd.MM.yyyy"))
    docs = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), "l_partkey", "l_suppkey",
                             F.struct(F.array(F.struct(text_date.alias("date"), F.lit("x").alias("note"))).alias("rows")).alias("data"))
    out = X.format_dates(docs, [("data", "rows", "date"), ("data", "missing")], "D MMM-YY/MMMM/MM/DD", "DD")
    return out.select("doc_id", "l_partkey", "l_suppkey", F.get("data.rows", F.lit(0))["date"].alias("date"))


@query("t13_complete_dates", fx("""
SELECT doc_id, pos, CASE WHEN kind <> 'movement' THEN 'n/a' ELSE substr(date_text, 7, 4) || CASE WHEN length(date_text) < 6 THEN '2024' ELSE '' END || '/' || substr(date_text, 4, 2) || '/' || substr(date_text, 1, 2) END AS date
FROM rendered"""))
def complete_dates(t):
    lines = t.rendered.select("doc_id", "pos", F.when(F.col("kind") == "movement", F.col("date_text")).otherwise("n/a").alias("date"), F.lit("2024").alias("year"))
    return X.complete_dates(lines, "date", "year", "YYYY/MM/DD").drop("year")


@query("t14_clean_charge_name", """SELECT p_partkey, p_name AS cleaned FROM part""")
def clean_charge_name(t):
    dirty = F.concat(F.lit(" 7 ABC XYZ "), "p_name", F.lit("\t"))
    return t.part.select("p_partkey", text.clean_charge_name(dirty).alias("cleaned"))


@query("t15_label_amount_pairs", fx("""
SELECT doc_id, pos, CAST(n AS INT) AS pair_no, CASE n WHEN 0 THEN 'Landing Fee' ELSE 'Take off Fee' END AS name,
  CASE n WHEN 0 THEN amount ELSE CAST(replace(fee_text, ',', '.') AS DOUBLE) END AS amount
FROM rendered, (SELECT unnest([0, 1]) AS n) WHERE kind = 'pairs'"""))
def label_amount_pairs(t):
    lines = X.normalize_markdown(t.rendered.select("doc_id", "pos", "line"), "line")
    return X.explode_label_pairs(lines).select("doc_id", "pos", "pair_no", "name", "amount")


@query("t16_normalizers", """SELECT c_custkey, regexp_replace(lower(c_name || ' Tax_Amount'), '[^a-z0-9]+', '', 'g') AS key,
  regexp_replace(lower(c_name || '–fee—per__unit'), '[-–—_]+', ' ', 'g') AS label FROM customer""")
def normalizers(t):
    return t.customer.select("c_custkey", text.norm_key(F.concat("c_name", F.lit(" Tax_Amount"))).alias("key"),
                             text.norm_text(F.concat("c_name", F.lit("–fee—per__unit"))).alias("label"))


@query("t18_cap_words", f"""
SELECT doc_id, array_to_string(w[1:20], ' ') || CASE WHEN len(w) > 20 THEN '…' ELSE '' END AS text FROM (
  SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g'), {WS}), ' ') AS w FROM documents)""")
def cap_words(t):
    return X.cap_words(t.documents.select("doc_id", "text"), "text")


@query("f12_is_present", """SELECT l_orderkey AS doc_id, l_partkey, l_suppkey, l_linenumber % 4 = 3 OR l_linenumber % 4 = 0 AS present FROM lineitem""")
def is_present(t):
    value = F.expr("CASE l_linenumber % 4 WHEN 1 THEN ' NULL ' WHEN 2 THEN '  ' WHEN 3 THEN 'x' ELSE CAST(l_partkey AS STRING) END")
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), "l_partkey", "l_suppkey", text.is_present(value).alias("present"))


def word_counter(content: str, schema: str) -> tuple[dict, int, int]:
    """A small stand-in extractor: counts words and characters."""
    return {"words": len(content.split()), "schema": schema}, len(content), len(content.split())


@query("x1_apply_extractor", fx("""SELECT doc_id, page, '{"words": ' || CAST(n AS VARCHAR) || ', "schema": "s"}' AS record, CAST(content_length AS BIGINT) AS input_tokens, CAST(n AS BIGINT) AS output_tokens
FROM (SELECT *, len(regexp_extract_all(content, '\\S+')) AS n FROM conv_pages)"""))
def extractor(t):
    return apply_extractor(t.conv_pages, word_counter, "s").drop("content_length")


@query("x2_load_domain", fx("""SELECT doc_id, pos, kind = 'movement' AS has_clock, CASE WHEN kind IN ('fee', 'pairs') THEN 'LANDING' END AS alias FROM rendered"""))
def domain(t):
    # the stored setting is taken from the data: the first company's name is of no effect on the patterns
    settings = t.region.selectExpr("CASE WHEN r_regionkey = 0 THEN 'domains' ELSE 'other' END AS key",
                                   """'{{"mine": {{"charge_aliases": {{"LANDING": "landing"}}}}}}' AS value""".replace("{{", "{").replace("}}", "}"))
    cfg = load_domain(settings, "mine")
    (name, patterns), = cfg["charge_aliases"].items()
    return t.rendered.select("doc_id", "pos", F.col("line").rlike(cfg["vocabulary"]["time"]).alias("has_clock"),
                             F.when(F.lower("line").rlike(patterns[0]), name).alias("alias"))
