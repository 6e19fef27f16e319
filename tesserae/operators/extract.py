"""Extraction from raw notes: front matter, links, tasks, headings, code, callouts, tables.

Everything hangs on one line table per note.  Front matter and fences are found within a note's
row, as stretches of its lines, and code by its block structure, so that the line table shuffles
nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.blocks import code_starts
from ..functions.text import slugify
from ..sources.shared import short_batches

TASK = r"^(\s*)(?:[-*+]|\d{1,9}[.)])\s+\[([ xX])\]\s+(.*)$"
#: A line that toggles the fence of links.
TOGGLE = r"^[\s\p{Z}]*```"
#: Pieces of a text without which no line of it is code.
CODE_SIGNS = ("```", "~~~", "    ", "\t")


@F.pandas_udf(ArrayType(IntegerType()))
def _code_starts(raw: pd.Series) -> pd.Series:
    return raw.map(code_starts)


def _places(holds) -> Column:
    return F.filter(F.transform("lines", lambda x, i: F.when(holds(x, i), i)), lambda i: i.isNotNull())


def _split(raw: DataFrame) -> DataFrame:
    """``path, raw, lines, close``: close is the last line of the front matter, -1 where there is none.

    The first line is three dashes and blanks; the front matter ends at the first line behind the
    second that begins with three dashes.  If it never ends there is none.
    """
    split = raw.where("raw is not null").select("path", "raw", F.split("raw", "\n", -1).alias("lines"))
    opens = F.get("lines", F.lit(0)).rlike(r"^---[\s\p{Z}]*$")
    return split.withColumn("close", F.coalesce(F.when(opens, F.get(_places(lambda x, i: (i > 1) & x.startswith("---")), F.lit(0))), F.lit(-1)))


def line_table(raw: DataFrame, code: bool = True) -> DataFrame:
    """``path, ln, line, in_front, in_body, in_fence`` of ``raw(path, raw)``, and ``code_ln, in_code`` unless ``code`` is False.

    in_fence is the mask of links: lines of the body that begin with ``` and those between every
    other one and the next.  in_code is that of all else: lines of fenced and indented code blocks
    as the block structure has them; code_ln is the first line of the block.  Null text has no lines.
    """
    found = _split(raw).withColumn("marks", _places(lambda x, i: x.rlike(TOGGLE) & (i > F.col("close"))))
    # masked from every other mark to the next one, both included
    begin = lambda k: F.coalesce(F.get("marks", k - 1) + F.when(k % 2 == 0, 1).otherwise(0), F.lit(0))
    end = lambda k: F.coalesce(F.get("marks", k) + F.when(k % 2 == 1, 1).otherwise(0), F.size("lines"))
    fence = F.flatten(F.transform(F.sequence(F.lit(0), F.size("marks")), lambda k: F.array_repeat(k % 2 == 1, end(k) - begin(k))))
    zipped = [F.col("lines").alias("line"), fence.alias("in_fence")]
    if code:  # texts without a sign of code don't travel
        signs = F.greatest(*[F.contains("raw", F.lit(x)) for x in CODE_SIGNS])
        found = short_batches(found).withColumn("starts", F.coalesce(_code_starts(F.when(signs, F.col("raw"))), F.array().cast("array<int>")))
        zipped.append(F.col("starts").alias("code_ln"))
    rows = found.select("path", "close", F.posexplode(F.arrays_zip(*zipped)).alias("ln", "x"))
    states = [((F.col("ln") > 0) & (F.col("ln") < F.col("close"))).alias("in_front"), (F.col("ln") > F.col("close")).alias("in_body"), "x.in_fence"]
    code_ln = F.coalesce("x.code_ln", F.lit(-1)) if code else None
    return rows.select("path", "ln", "x.line", *states, *([code_ln.alias("code_ln"), (code_ln >= 0).alias("in_code")] if code else []))


def split_front_matter(raw: DataFrame) -> DataFrame:
    """``path, front, body``; without front matter the whole text is body."""
    part = lambda begin, n: F.array_join(F.slice("lines", begin, F.greatest(n, F.lit(0))), "\n")
    close = F.col("close")
    return _split(raw).select("path", F.when(close < 0, "").otherwise(part(F.lit(2), close - 1)).alias("front"), F.when(close < 0, F.col("raw")).otherwise(part(close + 2, F.size("lines") - close - 1)).alias("body"))


def front_properties(lines: DataFrame) -> DataFrame:
    """``path, key, values`` of every root-level field: scalars, ``[a, b]`` lists and ``- a`` items."""
    front = lines.where("in_front")
    key = F.regexp_extract("line", r"^([^\s#:-][^:]*):", 1)
    keyed = front.withColumn("own", F.when(key != "", F.trim(key)))
    carried = keyed.withColumn("key", F.last("own", ignorenulls=True).over(W.partitionBy("path").orderBy("ln").rowsBetween(W.unboundedPreceding, 0)))
    value = F.trim(F.when(F.col("own").isNotNull(), F.regexp_replace("line", r"^[^:]*:", "")).otherwise(F.regexp_extract("line", r"^\s*-\s+(.*)$", 1)))
    bare = lambda c: F.trim(F.regexp_replace(F.trim(c), r"""^["'](.*)["']$""", "$1"))
    items = F.when(value.rlike(r"^\[.*\]$"), F.transform(F.split(F.regexp_extract(value, r"^\[(.*)\]$", 1), ","), bare)).otherwise(F.array(bare(value)))
    one = carried.where("key is not null").select("path", "ln", "key", F.posexplode(items).alias("k", "value")).where("value <> ''")
    # the value lists of one note are as long as its front matter
    return one.groupBy("path", "key").agg(F.array_sort(F.collect_list(F.struct("ln", "k", "value"))).alias("v")).select("path", "key", F.transform("v", lambda x: x["value"]).alias("values"))


def without_inline_code(line: Column) -> Column:
    """A line without what stands between backticks."""
    return F.array_join(F.filter(F.split(line, "`", -1), lambda x, i: i % 2 == 0), "")


def wikilinks(lines: DataFrame) -> DataFrame:
    """``path, ln, k, target`` of ``[[target]]`` in prose, anchor and alias kept; up to the first ``]]``, without a further ``[[``."""
    prose = lines.where("in_body and not in_fence")
    found = F.regexp_extract_all(without_inline_code(F.col("line")), F.lit(r"\[\[((?:(?!\]\]).)*)\]\]"), F.lit(1))
    return prose.select("path", "ln", F.posexplode(found).alias("k", "t")).where(~F.contains("t", F.lit("[["))).select("path", "ln", "k", F.trim("t").alias("target")).where("target <> ''")


def markdown_links(lines: DataFrame) -> DataFrame:
    """``path, ln, k, target``: the note name of ``](some/note.md#x)`` links that aren't web addresses."""
    prose = lines.where("in_body and not in_fence")
    found = F.regexp_extract_all(without_inline_code(F.col("line")), F.lit(r"\]\(([^)]*)\)"), F.lit(1))
    links = prose.select("path", "ln", F.posexplode(found).alias("k", "t")).select("path", "ln", "k", F.trim(F.regexp_extract("t", r"^[^#?]*", 0)).alias("t"))
    local = links.where(F.lower("t").endswith(".md") & ~F.col("t").rlike("^(https?://|mailto:)"))
    return local.select("path", "ln", "k", F.trim(F.regexp_replace(F.element_at(F.split("t", "/"), -1), r"(?i)\.md$", "")).alias("target")).where("target <> ''")


def all_links(lines: DataFrame) -> DataFrame:
    """Wikilinks, then markdown links whose name no earlier target of the note equals (case aside)."""
    both = wikilinks(lines).withColumn("kind", F.lit(0)).unionByName(markdown_links(lines).withColumn("kind", F.lit(1)))
    name = W.partitionBy("path", F.lower("target")).orderBy("kind", "ln", "k")
    ranked = both.withColumn("first", F.row_number().over(name) == 1)
    return ranked.where("kind = 0 or first").select("path", "ln", "k", "target")


def embeds(lines: DataFrame) -> DataFrame:
    """``path, ln, target, anchor`` of ``![[Note#Heading|label]]``."""
    found = F.regexp_extract_all(without_inline_code(F.col("line")), F.lit(r"!\[\[([^\[\]]+)\]\]"), F.lit(1))
    inner = lines.where("in_body and not in_code").select("path", "ln", F.explode(found).alias("t")).select("path", "ln", F.trim(F.regexp_extract("t", r"^[^|]*", 0)).alias("t"))
    return inner.select("path", "ln", F.trim(F.regexp_extract("t", r"^[^#]*", 0)).alias("target"), F.regexp_extract("t", r"#(.*)$", 1).alias("anchor"))


def inline_tags(lines: DataFrame) -> DataFrame:
    """``path, ln, tag`` of ``#tag`` in prose."""
    found = F.regexp_extract_all(without_inline_code(F.col("line")), F.lit(r"(?<![\p{L}\p{N}_#/])#([\p{L}_][\p{L}\p{N}_/-]*)"), F.lit(1))
    return lines.where("in_body and not in_code").select("path", "ln", F.explode(found).alias("tag"))


def tasks(lines: DataFrame) -> DataFrame:
    """``path, ln, text, depth, done`` of task items outside code."""
    items = lines.where(F.col("line").contains("[") & ~F.col("in_code") & F.col("line").rlike(TASK))
    indent = F.char_length(F.regexp_replace(F.regexp_extract("line", TASK, 1), "\t", "    "))
    return items.select(
        "path", "ln", F.trim(F.regexp_extract("line", TASK, 3)).alias("text"), F.floor(indent / 2).cast("int").alias("depth"), (F.lower(F.regexp_extract("line", TASK, 2)) == "x").alias("done")
    )


def headings(lines: DataFrame) -> DataFrame:
    """``path, ord, level, text, slug, ln``; the n-th repeat of a slug in a note ends in ``-n``."""
    atx = r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$"
    by_line = W.partitionBy("path").orderBy("ln")
    marked = lines.where("in_body").withColumns({"next": F.lead("line").over(by_line), "next_code": F.lead("in_code").over(by_line)})
    under = F.when(F.col("next").rlike(r"^ {0,3}=+\s*$"), 1).when(F.col("next").rlike(r"^ {0,3}-{2,}\s*$"), 2)
    setext = (F.trim("line") != "") & ~F.col("next_code") & under.isNotNull() & ~F.col("line").rlike(r"^ {0,3}([-=]+|[-*+>] .*|\d+[.)] .*)\s*$")
    level = F.when(F.col("line").rlike(atx), F.char_length(F.regexp_extract("line", atx, 1))).when(setext, under)
    text = F.when(F.col("line").rlike(atx), F.regexp_extract("line", atx, 2)).otherwise(F.trim("line"))
    plain = F.regexp_replace(text, r"[*_`]|\[\[|\]\]", "")
    found = marked.where(~F.col("in_code") & level.isNotNull()).select("path", "ln", level.alias("level"), plain.alias("text"), slugify(plain).alias("base"))
    n = F.row_number().over(W.partitionBy("path", "base").orderBy("ln")) - 1
    return found.select("path", (F.row_number().over(by_line) - 1).alias("ord"), "level", "text", F.when(n == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), n)).alias("slug"), "ln")


def code_lines(lines: DataFrame) -> DataFrame:
    """``path, ln`` of the body's lines in fenced and indented code blocks."""
    return lines.where("in_body and in_code").select("path", "ln")


def callouts(lines: DataFrame) -> DataFrame:
    """``path, ln, kind, title`` of block quotes that begin ``[!kind] title`` with a known kind."""
    pattern = r"(?i)^ {0,3}>\s?\[!(note|tip|important|warning|caution)\][+-]?\s*(.*)$"
    before = F.lag("line").over(W.partitionBy("path").orderBy("ln"))
    begins = lines.where("in_body").withColumn("before", before).where(~F.col("in_code") & F.col("line").rlike(pattern) & ~F.coalesce(F.col("before").rlike(r"^ {0,3}>"), F.lit(False)))
    kind, title = F.lower(F.regexp_extract("line", pattern, 1)), F.trim(F.regexp_extract("line", pattern, 2))
    return begins.select("path", "ln", kind.alias("kind"), F.when(title == "", F.initcap(kind)).otherwise(title).alias("title"))


def table_rows(lines: DataFrame) -> DataFrame:
    """``path, table_ln, row_no, cells`` of pipe tables; row 0 is the header."""
    by_line = W.partitionBy("path").orderBy("ln")
    rule = F.col("line").rlike(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$") & F.col("line").contains("-") & F.col("line").contains("|")
    pipes = F.col("line").contains("|") & ~F.col("in_code")
    marked = lines.where("in_body").withColumns({"pipe": pipes, "rule": rule & pipes})
    marked = marked.withColumn("stretch", F.sum(F.when(F.col("pipe"), 0).otherwise(1)).over(by_line.rowsBetween(W.unboundedPreceding, 0)))
    marked = marked.where("pipe").withColumn("rule_ln", F.min(F.when(F.col("rule"), F.col("ln"))).over(W.partitionBy("path", "stretch")))
    rows = marked.where("not rule and ln >= rule_ln - 1")
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||(?<!\\)\|$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    row_no = F.row_number().over(W.partitionBy("path", "stretch").orderBy("ln")) - 1
    return rows.select("path", F.col("rule_ln").alias("table_ln"), row_no.alias("row_no"), cells.alias("cells"))


def saved_queries(lines: DataFrame, fence: str = "notes-query", default_limit: int = 20, most: int = 200) -> DataFrame:
    """``path, ln, doc_kinds, topics, tags, text, limit, errors`` of fenced query blocks."""
    opens = lines.where("ln = code_ln").where(F.col("line").rlike(rf"^\s{{0,3}}```\s*{fence}\s*$")).select("path", "code_ln")
    blocks = lines.where("in_code and ln > code_ln").where(~F.col("line").rlike(r"^\s{0,3}`{3,}\s*$")).join(opens, ["path", "code_ln"], "left_semi")
    inner = blocks.withColumn("block", F.col("code_ln")).where("trim(line) <> '' and not trim(line) like '#%'")
    key, value = F.trim(F.regexp_extract("line", r"^([^:]*):", 1)), F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    known = key.isin("doc_kind", "topic", "tag", "text", "limit")
    error = (
        F.when(~F.col("line").contains(":"), "no colon").when(~known, F.concat(F.lit("unknown key "), key)).when(value == "", F.concat(F.lit("empty "), key)).when((key == "limit") & ~value.rlike(r"^[1-9]\d*$"), "bad limit")
    )
    rows = inner.select("path", F.col("block").alias("ln"), F.col("ln").alias("at"), key.alias("key"), value.alias("value"), error.alias("error"))
    listed = lambda k: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.when((F.col("key") == k) & F.col("error").isNull(), F.struct("at", "value")))), lambda x: F.filter(F.transform(F.split(x["value"], ","), lambda y: F.trim(y)), lambda y: y != ""))))
    grouped = rows.groupBy("path", "ln").agg(
        listed("doc_kind").alias("doc_kinds"), listed("topic").alias("topics"), listed("tag").alias("tags"),
        F.max_by(F.when(F.col("error").isNull(), F.col("value")), F.when((F.col("key") == "text") & F.col("error").isNull(), F.col("at"))).alias("text"),
        F.max_by(F.col("value"), F.when((F.col("key") == "limit") & F.col("error").isNull(), F.col("at"))).alias("lim"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("at", "error")))), lambda x: x["error"]).alias("errors"),
    )
    nothing = (F.size("doc_kinds") + F.size("topics") + F.size("tags") == 0) & F.col("text").isNull()
    return grouped.select(
        "path", "ln", "doc_kinds", "topics", "tags", "text", F.least(F.coalesce(F.col("lim").cast("int"), F.lit(default_limit)), F.lit(most)).alias("limit"),
        F.when(nothing, F.concat("errors", F.array(F.lit("nothing selected")))).otherwise(F.col("errors")).alias("errors"),
    )
