"""Text columns as table jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doctables.functions import dates, money, text


def clean_markdown(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, text.clean_markdown(F.col(col)))


def normalize_markdown(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, text.normalize_markdown(F.col(col)))


def markdown_to_text(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, text.markdown_to_text(F.col(col)))


def split_lines(docs: DataFrame, col: str = "content", normalize: bool = False) -> DataFrame:
    """One row per line with its number; the text column itself is not carried along."""
    source = text.normalize_markdown(F.col(col)) if normalize else F.coalesce(F.col(col), F.lit(""))
    rest = [c for c in docs.columns if c != col]
    return docs.select(*rest, F.posexplode(F.split(source, "\n")).alias("line_no", "line"))


def table_rows(lines: DataFrame) -> DataFrame:
    """Pipe-table lines with their cells and last cell."""
    return lines.where(text.is_table_line(F.col("line"))).withColumn("cells", text.table_cells(F.col("line"))).withColumn(
        "last_cell", F.try_element_at("cells", F.lit(-1)))


def vocab_matches(line: Column, pattern: str, first: bool = False) -> Column:
    """Matches of one vocabulary pattern in a line: all of them, or the first or null."""
    if first:
        return F.nullif(F.regexp_extract(line, pattern, 0), F.lit(""))
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(0))


def _upper(c: Column) -> Column:
    # case conversion is costly and almost never needed here
    return F.when(c.rlike(r"[^\x20-\x60]"), F.upper(c)).otherwise(c)


def extract_vocab(lines: DataFrame, vocab: Mapping[str, str], asked: Column | None = None) -> DataFrame:
    """Vocabulary columns of each line: ``flights`` and ``dates`` hold all matches, the rest the first.

    With ``asked``, a condition on flights and registration, the others are searched for only where it holds, and null elsewhere.
    """
    def where_asked(c: Column) -> Column:
        return c if asked is None else F.when(asked, c)

    upper = F.transform(vocab_matches(F.col("line"), vocab["flight_number"]),
                        lambda x: _upper(F.regexp_replace(x, text.WS + "+", " ")))
    out = lines.withColumn("flights", upper).withColumn(
        "registration", vocab_matches(F.col("line"), vocab["aircraft_registration"], first=True))
    out = out.withColumn("dates", where_asked(F.concat(vocab_matches(F.col("line"), vocab["date"]), dates.compact_dates(F.col("line")))))
    out = out.withColumn("time", where_asked(vocab_matches(F.col("line"), vocab["time"], first=True)))
    airports = F.filter(vocab_matches(F.col("line"), vocab["origin"]), lambda x: ~x.eqNullSafe(F.col("registration")))
    return out.withColumn("origin", where_asked(F.get(airports, F.lit(0))))


def extract_amounts(lines: DataFrame) -> DataFrame:
    """One row per money token of a line."""
    return lines.select("*", F.posexplode(money.money_tokens(F.col("line"))).alias("amount_no", "token")).withColumn(
        "amount", money.parse_amount(F.col("token")))


def normalize_amounts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: money.parse_amount(F.col(c)) for c in cols})


def parse_dates(df: DataFrame, cols: Sequence[str], hint: str = "") -> DataFrame:
    """Add ``<col>_parts`` with year, month and day."""
    return df.withColumns({f"{c}_parts": dates.parse_date_parts(F.col(c), hint) for c in cols})


def format_dates(df: DataFrame, paths: Sequence[Sequence[str]], fmt: str, hint: str = "") -> DataFrame:
    """Rewrite date texts at nested paths, through objects and arrays of objects."""
    def rewrite(value: Column, kind: T.DataType, path: Sequence[str]) -> Column:
        if not path:
            return dates.format_date(value, fmt, hint) if isinstance(kind, T.StringType) else value
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda x: rewrite(x, kind.elementType, path))
        if isinstance(kind, T.StructType) and path[0] in kind.names:
            return value.withField(path[0], rewrite(value[path[0]], kind[path[0]].dataType, path[1:]))
        return value

    for path in paths:
        if path[0] in df.columns:
            df = df.withColumn(path[0], rewrite(F.col(path[0]), df.schema[path[0]].dataType, list(path)[1:]))
    return df


def complete_dates(lines: DataFrame, col: str, year_col: str, fmt: str = "DD-MM-YYYY") -> DataFrame:
    return lines.withColumn(col, dates.complete_date(F.col(col), F.col(year_col), fmt))


def label_amount_pairs(line: Column) -> Column:
    """``name: … amount`` pairs of a line, matched by position; amounts of zero are skipped.

    Null unless the line has both a name and an amount.
    """
    found = F.regexp_extract_all(line, F.lit(r"([A-Za-z][A-Za-z .&/-]{2,30}?)\s*:"), F.lit(1))
    names = F.filter(F.transform(found, text.clean_charge_name), lambda n: F.length(n) > 2)

    def pair(n: Column, a: Column) -> Column:
        pairs = F.zip_with(n, a, lambda x, y: F.struct(x.alias("name"), money.parse_amount(y).alias("amount")))
        kept = F.filter(F.slice(pairs, 1, F.least(F.size(n), F.size(a))), lambda p: p["amount"] != 0)
        return F.when((F.size(n) > 0) & (F.size(a) > 0), kept)

    # most lines have no colon, or a number before it, and need no search for names
    both = F.struct(names.alias("n"), money.money_tokens(line).alias("a"))
    return F.when(line.contains(":") & line.rlike(r"[A-Za-z .&/-]{3}\s*:"), text.let(both, lambda x: pair(x["n"], x["a"])))


def explode_label_pairs(lines: DataFrame) -> DataFrame:
    """One row per label/amount pair."""
    return lines.select("*", F.posexplode(label_amount_pairs(F.col("line"))).alias("pair_no", "pair")).select(
        *lines.columns, "pair_no", "pair.name", "pair.amount")


def cap_words(df: DataFrame, col: str, n: int = 20) -> DataFrame:
    return df.withColumn(col, text.cap_words(F.col(col), n))
