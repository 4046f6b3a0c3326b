"""The rewrites to plain text against plain replacements, one after another, on texts made of their marks."""

import random
import re

from pyspark.sql import functions as F

from doctables.functions import text

PARTS = ["**", "__", "*", "_", "# ", "#", "[a](u)", "[", "](", ")", "![p](q)", "```x\n", "\n```\n", "`", ">", "\n\n", "\n", "|", " | ", "|\t ", " |", "-", "word", "a b", "　"]


def plain(value: str) -> str:
    blank = text.WS
    for pattern, new in ((r"(\*\*|__)(.*?)\1", r"\2"), (r"(\*|_)(.*?)\1", r"\2"), ("#+" + blank, ""), (r"\[(.*?)\]\(.*?\)", r"\1"), (r"!\[(.*?)\]\(.*?\)", r"\1"),
                         (r"```.*?\n(?s:.*?)\n```|`.*?`", ""), (r">+", ""), (r"\n{2,}", "\n"), (rf"\|{blank}*([^|]*?){blank}*\|", r"\1"), (r"-+", "")):
        value = re.sub(pattern, new, value)
    return value.strip(text.BLANKS)


def test_rewrites(spark):
    draw = random.Random(4)
    texts = ["", "||", "| |", "|a", "| a |b| c |"] + ["".join(draw.choices(PARTS, k=draw.randrange(1, 25))) for _ in range(4000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    got = {r.i: r.p for r in rows.select("i", text.markdown_to_text(F.col("t")).alias("p")).collect()}
    assert got.pop(-1) is None
    assert {i: (texts[i], p) for i, p in got.items() if p != plain(texts[i])} == {}
