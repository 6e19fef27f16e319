"""Line-first quality rules, in DataFrame functions only.

Every line is held against punctuation, navigation and boilerplate rules and goes if it fails
one; a document that loses too much of its text this way is rejected.  All of it is expressions
over one row: nothing is shuffled, and no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import docs_of, table

BLANK = " \t\n\x0b\x0c\r"
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Marks that may end a sentence or a quotation.
ENDS = ".!?;:…。！？؟।)]\"'”’»"
#: Fixed words of menus and of legal lines.
NAVIGATION = r"^(home|menu|next|previous|prev|back|back to top|skip to content|read more|click here|login|log in|sign in|sign up|subscribe|share|search|contact|contact us|about|about us)[ .!:>»]*$"
BOILERPLATE = ("cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "©", "licensed under", "javascript", "lorem ipsum", "powered by", "permission is hereby granted", "spdx-license-identifier")
#: Marks that part the entries of a menu, and runs of one mark that draw a line or shout.
BARS = "|>»•"
RUNS = ("!!!!", "????", "====", "----", "____", "****", "####", "~~~~")
NO_LETTER, SMALL, CAPITAL = r"[^\p{L}]", r"\p{Ll}", r"\p{Lu}"
#: Capitals of a line without a small letter from which it is all capitals.
CAPITALS = 10
#: A document is rejected if less than this share of its characters is in lines that stay.
LEAST_SHARE = 0.5


def symbols_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def _let(name: str, value: str, body: str) -> str:
    """SQL that computes ``value`` once for its uses in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def repeated_words_sql(words: str, n: str, hashed: str = "xxhash64({})") -> str:
    """Words within 3-word windows that occur twice or more, for an array column of ``n`` words.

    If the windows' 64-bit hashes are all different, there is none.  Else the hashes are sorted
    with the low bits replaced by the window's place, which brings equal windows side by side; a
    pair of neighbours counts if its words are equal too.  Should neighbours of one hash differ
    in their words, that text's windows are sorted by the words themselves.
    """
    at = lambda p, q: " AND ".join(f"{words}[{p} + {k}] = {words}[{q} + {k}]" for k in range(3))
    place = lambda x: f"CAST({x} & m AS INT)"
    near = lambda x, y: f"shiftrightunsigned({x}, b) = shiftrightunsigned({y}, b)"
    same = lambda x, y: f"coalesce({near(x, y)} AND {at(place(x), place(y))}, false)"
    twice = f"transform(filter(s, (x, k) -> {same('x', 'get(s, k - 1)')} OR {same('x', 'get(s, k + 1)')}), x -> x & m)"
    clash = f"exists(transform(s, (x, k) -> coalesce({near('x', 'get(s, k + 1)')} AND NOT ({at(place('x'), place('get(s, k + 1)'))}), false)), x -> x)"
    rows = f"array_sort(transform(sequence(0, {n} - 3), i -> struct({words}[i] AS p, {words}[i + 1] AS q, {words}[i + 2] AS r, CAST(i AS BIGINT) AS i)))"
    like = lambda y: f"coalesce(x.p = {y}.p AND x.q = {y}.q AND x.r = {y}.r, false)"
    by_words = _let("g", rows, f"transform(filter(g, (x, k) -> {like('get(g, k - 1)')} OR {like('get(g, k + 1)')}), x -> x.i)")
    places = _let("s", "sort_array(transform(h, (x, i) -> shiftleft(x, b) | i))", f"CASE WHEN {clash} THEN {by_words} ELSE {twice} END")
    covered = _let("p", f"array_sort({places})", "aggregate(transform(p, (x, k) -> least(3L, coalesce(get(p, k + 1) - x, 3L))), 0L, (a, x) -> a + x)")
    with_bits = _let("b", f"char_length(bin({n}))", _let("m", "shiftleft(1L, b) - 1", covered))
    hashes = f"transform(sequence(0, {n} - 3), i -> {hashed.format(f'{words}[i], {words}[i + 1], {words}[i + 2]')})"
    return f"CASE WHEN {n} < 4 THEN 0L ELSE {_let('h', hashes, f'CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE {with_bits} END')} END"


def any_of(text: Column, parts: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(x) for x in parts])


def line_verdict(line: Column, low: Column, marked: Column, barred: Column) -> Column:
    """True if a line stays, for the trimmed line and its lower case; marked, barred: the text has symbols or "!!", and bars.

    Punctuation: it ends like a sentence, has few symbols by its words, no long run of one mark,
    letters for at least half of its characters, and isn't all capitals.  Navigation: few bars,
    and no fixed word of menus.  Boilerplate: no fixed phrase.
    """
    words = F.regexp_count(line, F.lit(BLANKS)) + 1
    marks = F.when(marked, F.regexp_count(line, F.lit(f"[{SYMBOLS}]|!!"))).otherwise(0)
    bars = F.when(barred, F.regexp_count(line, F.lit(f"[{BARS}]"))).otherwise(0)
    ends = F.instr(F.lit(ENDS), F.right(line, F.lit(1))) > 0
    letters = F.regexp_count(line, F.lit(NO_LETTER)) * 2 <= F.char_length(line)
    shouted = ~line.rlike(SMALL) & (F.regexp_count(line, F.lit(CAPITAL)) >= CAPITALS)
    punctuated = ends & (marks * 10 <= words * 3) & ~any_of(line, RUNS) & letters & ~shouted
    navigation = (bars * 5 > words) | low.rlike(NAVIGATION)
    return punctuated & ~navigation & ~any_of(low, BOILERPLATE)


def line_rules(docs: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """Counts and verdict of every row: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, clean_text``.

    Words are runs without ASCII white space.  clean_text has the lines that stay.  Null and
    empty texts have no words and fail the base; repeated rows are judged one by one.
    """
    text = docs_of(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bare = F.trim(F.col("text"), F.lit(BLANK))
    trimmed = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("line"), F.trim(x, F.lit(BLANK)).alias("bare")))
    split = text.select(
        "doc_id", "text", symbols_in(F.col("text")).cast("long").alias("n_symbols"), any_of(F.col("text"), BARS).alias("barred"),
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANKS)).alias("words"),
        F.transform(F.filter(trimmed, lambda x: x["bare"] != ""), lambda x: F.struct(x["line"].alias("line"), x["bare"].alias("bare"), F.lower(x["bare"]).alias("low"))).alias("lines"),
    )
    counted = split.withColumn("marked", (F.col("n_symbols") > 0) | F.col("text").contains("!!")).select(
        "doc_id", "n_symbols", F.col("lines.line").alias("lines"), "words", F.size("words").alias("n"),
        F.transform("lines", lambda x: F.struct(F.char_length(x["line"]).alias("chars"), line_verdict(x["bare"], x["low"], F.col("marked"), F.col("barred")).alias("stays"), x["line"].alias("line"))).alias("judged"),
    )
    measured = counted.select(
        "doc_id", F.col("n").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeated_words_sql("words", "n")).alias("n_repeat_words"),
        F.aggregate("judged", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("chars"),
        F.filter("judged", lambda x: x["stays"]).alias("stay"),
    )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    left = F.aggregate("stay", F.lit(0).cast("long"), lambda a, x: a + x["chars"])
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left * 1000 >= F.col("chars") * int(least_share * 1000))).alias("kept"),
        F.array_join(F.transform("stay", lambda x: x["line"]), "\n").alias("clean_text"),
    )


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents")).drop("clean_text")


def _sql() -> str:
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    low = "lower(t)"
    n_of = lambda pattern: f"len(regexp_extract_all(t, '{pattern}'))"
    bars, marks = n_of(f"[{BARS}]"), f"(length(t) - length(translate(t, '{SYMBOLS}', '')) + length(t) - length(replace(t, '!!', '!')))"
    shape = f"NOT ({' OR '.join(f"contains(t, '{x}')" for x in RUNS)}) AND {n_of(NO_LETTER)} * 2 <= length(t) AND NOT (NOT regexp_matches(t, '{SMALL}') AND {n_of(CAPITAL)} >= {CAPITALS})"
    ends, nav, boiler = (x.replace("'", "''") for x in (ENDS, NAVIGATION, "|".join(BOILERPLATE)))
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {blank}) <> '') AS lines
  FROM documents
), windows AS (
  SELECT r, unnest(generate_series(1, len(words) - 2)) AS i, words FROM d WHERE len(words) >= 3
), grams AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM windows
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), split AS (
  SELECT r, unnest(lines) AS line FROM d
), judged AS (
  SELECT r, length(line) AS chars,
         contains('{ends}', right(t, 1)) AND {marks} * 10 <= n * 3 AND {shape}
         AND NOT ({bars} * 5 > n OR regexp_matches({low}, '{nav}')) AND NOT regexp_matches({low}, '{boiler}') AS stays
  FROM (SELECT r, line, trim(line, {blank}) AS t, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n FROM split)
), shares AS (
  SELECT r, sum(chars) AS chars, coalesce(sum(chars) FILTER (WHERE stays), 0) AS left_chars FROM judged GROUP BY r
), counted AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(translate(text, {blank}, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(s.chars, 0) AS chars, coalesce(s.left_chars, 0) AS left_chars
  FROM d LEFT JOIN covered c ON d.r = c.r LEFT JOIN shares s ON d.r = s.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND left_chars * 1000 >= chars * {int(LEAST_SHARE * 1000)} AS kept
FROM counted
"""


OP9_SQL = _sql()
