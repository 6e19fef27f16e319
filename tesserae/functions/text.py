"""Column helpers for names, paths, times and text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The lifecycle words of a status field.  Any other word belongs to no group.
STATUS_WORDS = {
    "done": ("완료", "반영됨", "해결됨", "닫힘", "이전됨"),
    "active": ("진행 중",),
    "todo": ("미착수", "열림"),
}
#: What parts search terms: white space, punctuation, symbols.
SEPARATOR = r"[\s\p{Z}\x{FEFF}\p{P}\p{S}]+"
#: Characters that are read one by one (Chinese, Japanese, Korean).
WIDE = r"[\x{1100}-\x{11FF}\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3130}-\x{318F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
#: Leading consonants of Hangul syllables in Unicode order.
CONSONANTS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
#: Front matter as rewrites and snippets see it: it ends at the first line that begins with three dashes, which needn't be bare.
FRONT = r"^---[ \t]*\r?\n([\s\S]*?)\r?\n---"
FRONT_AND_END = FRONT + r"[ \t]*\r?\n?"
KEBAB = r"^[a-z0-9]+(-[a-z0-9]+)*$"
KEBAB_PATH = r"^[a-z0-9]+(-[a-z0-9]+)*(/[a-z0-9]+(-[a-z0-9]+)*)*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dirname(path: Column | str) -> Column:
    """The folder of a path, empty at the root."""
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def stem(path: Column | str) -> Column:
    """The last segment without its .md or .mmd ending."""
    return F.regexp_replace(F.element_at(F.split(col(path), "/"), -1), r"(?i)\.(md|mmd)$", "")


def display_name(path: Column | str) -> Column:
    """The last two segments, without the note ending."""
    parts = F.split(F.regexp_replace(col(path), r"(?i)\.(md|mmd)$", ""), "/")
    return F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2)), "/")


def fold(text: Column | str) -> Column:
    """Trimmed, inner white space collapsed, lower case."""
    return F.lower(F.regexp_replace(F.trim(col(text)), r"\s+", " "))


def slugify(text: Column | str) -> Column:
    """Heading anchor: letters, digits and hyphens in lower case; ``section`` if nothing is left."""
    kept = F.regexp_replace(F.lower(F.trim(col(text))), r"[^\p{L}\p{N}\s-]", "")
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"\s+", "-"), "-+", "-"), "^-|-$", "")
    return F.when(slug == "", F.lit("section")).otherwise(slug)


def date_ms(text: Column | str) -> Column:
    """Epoch milliseconds of ``YYYY-MM-DD`` or ``YYYY-MM-DD[T ]time``; anything else is null."""
    c = F.trim(col(text))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.unix_millis(F.try_to_timestamp(F.regexp_replace(c, "T", " "))))


def lifecycle(status: Column | str) -> Column:
    """done, active or todo for a known status word, else null."""
    word = fold(status)
    out = F.lit(None).cast("string")
    for group, words in STATUS_WORDS.items():
        out = F.when(word.isin(*words), F.lit(group)).otherwise(out)
    return out


def note_tokens(text: Column | str) -> Column:
    """Search tokens: what stands between separators, in lower case; Hangul runs give overlapping pairs.

    Texts are taken to be composed (NFC), as ``read_vault`` makes them.
    """
    runs = F.filter(F.split(F.lower(col(text)), SEPARATOR), lambda x: x != "")
    return F.when(col(text).rlike("[가-힣]"), _pairs_of_hangul(runs)).otherwise(runs)


def _pairs_of_hangul(runs: Column) -> Column:
    pieces = F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, F.lit(r"([가-힣]+|[^가-힣]+)"), F.lit(1))))

    def grams(r: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))
        return F.when(r.rlike("^[가-힣]{2,}$"), pairs).otherwise(F.array(r))

    return F.flatten(F.transform(pieces, grams))


def consonants(text: Column | str) -> Column:
    """Hangul syllables as their leading consonants, other characters as they are."""
    letters = F.split(col(text), "")
    lead = lambda x: F.substr(F.lit(CONSONANTS), (F.floor((F.ascii(x) - 44032) / 588) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(letters, lambda x: F.when(x.rlike("^[가-힣]$"), lead(x)).otherwise(x)), "")


def fuzzy_score(query: str, text: Column | str) -> Column:
    """Score of a lower-case query against a lower-case text; null if it isn't a subsequence.

    Equal 1000; prefix 800 and substring 500, less the surplus length; else a greedy
    subsequence: 100, 1 a hit, 5 for a hit beside the one before, 20 for one at the start.
    """
    t = col(text)
    surplus = F.char_length(t) - len(query)
    if not query:
        return F.lit(0)
    state = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("last"), F.lit(100).alias("score"))
    q = F.lit(query)

    def step(acc: Column, i: Column) -> Column:
        hit = (acc["at"] < len(query)) & (F.substr(t, i + 1, F.lit(1)) == F.substr(q, acc["at"] + 1, F.lit(1)))
        gain = 1 + F.when(acc["last"] == i - 1, 5).otherwise(0) + F.when(i == 0, 20).otherwise(0)
        return F.struct(
            (acc["at"] + F.when(hit, 1).otherwise(0)).alias("at"), F.when(hit, i).otherwise(acc["last"]).alias("last"), (acc["score"] + F.when(hit, gain).otherwise(0)).alias("score")
        )

    places = F.when(F.char_length(t) > 0, F.sequence(F.lit(0), F.char_length(t) - 1)).otherwise(F.array().cast("array<int>"))
    folded = F.aggregate(places, state, step, lambda acc: F.when(acc["at"] == len(query), acc["score"] - surplus))
    return F.when(t == query, F.lit(1000)).when(t.startswith(query), 800 - surplus).when(t.contains(query), 500 - surplus).otherwise(folded)


def nfc(text: str) -> str:
    """A query's own text, composed as the notes are."""
    return unicodedata.normalize("NFC", text)


def composed():
    """The function that composes letters with their combining marks (NFC), batch by batch; Spark has none of its own."""

    @F.pandas_udf("string")
    def nfc_of(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))

    return nfc_of


def register_functions(spark) -> None:
    """SQL names of what ad-hoc queries need most: ``nfc``, ``slugify`` and ``note_stem``."""
    spark.udf.register("nfc", composed())
    spark.sql(
        r"CREATE OR REPLACE TEMPORARY FUNCTION slugify(t STRING) RETURNS STRING RETURN coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), r'[^\p{L}\p{N}\s-]', ''), r'[\s-]+', '-'), '^-|-$', ''), ''), 'section')"
    )
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION note_stem(p STRING) RETURNS STRING RETURN regexp_replace(element_at(split(p, '/'), -1), r'(?i)\.(md|mmd)$', '')")
