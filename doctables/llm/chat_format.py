"""Chat formatting: turns to one training text per conversation with a loss mask, and back again.

Turn structs are collected and sorted, adjacent turns of one role become one block, and the blocks are joined to text, all
with Spark expressions. A conversation's text is one value by definition, so its turns meet in one row.

Template: a block is ``<|im_start|>role``, a line break, its turns' texts with ``<|im_next|>`` between them, ``<|im_end|>`` and a
line break. Inside roles and texts a backslash is doubled, and one is put behind the first character of each control string
(``CONTROL``), so that no control string is left in them; :func:`unescape` takes that back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from doctables.functions.text import let

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_CONTROL_PATTERN = r"([<\[])(?=\||/s>|s>|INST\]|/INST\]|<SYS>>|</SYS>>)"

_BLOCK = r"(?s)\A<\|im_start\|>((?:[^\\\n]|\\.)*+)\n(.*)\z"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL_PATTERN, r"$1\\")


def escape_role(role: Column) -> Column:
    """As :func:`escape`; a line break in a role gets a backslash too, since one ends the role."""
    return F.regexp_replace(escape(role), "\n", "\\\\\n")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(conversations: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, formatted, mask)``: the text and the trained spans, as code points ``struct(start, length)`` in order.

    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have one order; each row is a turn.
    A null text or role is empty; rows with a null conv_id form one conversation. An empty table gives no rows.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    # first turn of each block, then the block as a struct of its head and texts; turns are taken by number, since a slice copies the array
    firsts = F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 or t[i].role <> t[i - 1].role)")
    turns = turns.select("conv_id", "t", firsts.alias("f"))
    blocks = F.transform(F.sequence(F.lit(0), F.size("f") - 1), lambda b: F.struct(
        F.concat(F.lit(START), escape_role(F.col("t")[F.col("f")[b]]["role"]), F.lit("\n")).alias("head"),
        F.col("t")[F.col("f")[b]]["role"].isin(*trained).alias("on"),
        F.transform(F.sequence(F.col("f")[b], F.coalesce(F.get(F.col("f"), b + 1), F.size("t")) - 1),
                    lambda i: escape(F.col("t")[i]["text"])).alias("texts")))
    turns = turns.select("conv_id", blocks.alias("blocks"))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], F.array_join(b["texts"], NEXT), F.lit(END + "\n"))), "")
    # what stands before each text (its block's head or a separator, and the end of the block before), and its length
    steps = F.flatten(F.transform("blocks", lambda b, k: F.transform(b["texts"], lambda x, i: F.struct(
        F.when(i > 0, F.lit(len(NEXT))).otherwise(F.length(b["head"]) + F.when(k > 0, F.lit(len(END) + 1)).otherwise(F.lit(0))).alias("gap"),
        F.length(x).alias("n"), b["on"].alias("on")))))

    def mask(s: Column, ends: Column) -> Column:
        spans = F.zip_with(s, ends, lambda step, end: F.struct((end - step["n"]).alias("start"), step["n"].alias("length"), step["on"].alias("on")))
        return F.transform(F.filter(spans, lambda x: x["on"]), lambda x: F.struct(x["start"], x["length"]))

    spans = let(steps, lambda s: mask(s, running_sums(F.transform(s, lambda x: x["gap"] + x["n"]))))
    return turns.select("conv_id", text.alias("formatted"), spans.alias("mask"))


# steps that are summed one after another; an array that grows by one copies itself, so none grows beyond this or the number of stretches
STRETCH = 64
# code points of a text that are cut off at once
CUT = 1024


def running_sums(numbers: Column) -> Column:
    """Running sums of an array of integers, in stretches: sums within each, then one running sum over the stretches."""
    def sums(a: Column) -> Column:
        return F.aggregate(a, F.expr("cast(array() as array<int>)"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))

    def cut(a: Column) -> Column:
        ends = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / STRETCH).cast("int"))
        return F.transform(ends, lambda c: sums(F.transform(
            F.sequence(c * STRETCH, F.least(F.size(a), (c + 1) * STRETCH) - 1), lambda i: a[i])))

    def shifted(parts: Column, totals: Column) -> Column:
        return F.flatten(F.transform(parts, lambda p, c: F.transform(p, lambda x: x + F.when(c > 0, totals[c - 1]).otherwise(F.lit(0)))))

    some = let(numbers, lambda a: F.when(F.size(a) > 0, cut(a)).otherwise(F.expr("cast(array() as array<array<int>>)")))
    return let(some, lambda parts: let(sums(F.transform(parts, lambda p: F.element_at(p, -1))), lambda totals: shifted(parts, totals)))


def read_spans(text: Column, spans: Column) -> Column:
    """The pieces of a text at ``struct(start, length)`` in code points. The text is cut once, so that no piece is counted from its start."""
    def piece(cuts: Column, s: Column) -> Column:
        first, last = F.floor(s["start"] / CUT).cast("int"), F.floor((s["start"] + s["length"]) / CUT).cast("int")
        near = F.array_join(F.transform(F.sequence(first, last), lambda i: F.coalesce(F.get(cuts, i), F.lit(""))), "")
        return F.substring(near, s["start"] % CUT + 1, s["length"])
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), lambda cuts: F.transform(spans, lambda s: piece(cuts, s)))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss_text, formatted)`` from formatted text and mask alone; turns are ``struct(role, text)``."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != "")
    whole = F.transform(blocks, lambda b: F.struct(
        unescape(F.regexp_extract(b, _BLOCK, 1)).alias("role"),
        F.split(F.regexp_extract(b, _BLOCK, 2), r"<\|im_next\|>").alias("texts")))
    turns = F.flatten(F.transform(whole, lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), unescape(x).alias("text")))))
    loss = F.array_join(F.transform(read_spans(F.col("formatted"), F.col("mask")), unescape), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_format(spark, sf_dir):
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    back = read_back(format_chats(given.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_ESC = r"regexp_replace(regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(\||/s>|s>|<SYS>>|</SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g'), '<(<SYS>>|</SYS>>)', '<\\\1', 'g')"
SQL = rf"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, lag(role) OVER w AS before,
    length({_ESC.format('text')}) AS n_text, length({_ESC.format('role')}) AS n_role
  FROM given WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n_text + CASE WHEN role IS NOT DISTINCT FROM before THEN {len(NEXT)} ELSE {len(START) + len(END) + 2} + n_role END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
