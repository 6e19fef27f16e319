"""Vault-wide rewrite plans: which notes change, how often, and into what."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FRONT, FRONT_AND_END


def replace_plan(raw: DataFrame, pattern: str, replacement: str, regex: bool = False, case: bool = True, word: bool = False) -> DataFrame:
    """``path, n, new_raw`` of notes that a find-and-replace changes."""
    if not pattern:
        raise ValueError("empty pattern")
    body = pattern if regex else re.escape(pattern)
    body = rf"\b(?:{body})\b" if word else body
    java = f"(?m){body}" if case else f"(?mi){body}"
    to = replacement if regex else replacement.replace("\\", "\\\\").replace("$", "\\$")
    return raw.select("path", F.regexp_count("raw", F.lit(java)).cast("long").alias("n"), F.regexp_replace("raw", java, to).alias("new_raw"), "raw").where("new_raw <> raw").drop("raw")


def link_rename_plan(lines: DataFrame, old: str, new: str) -> DataFrame:
    """``path, n, new_raw`` of notes whose links to ``old`` follow a rename; code stays as it is."""
    o, to = re.escape(old), new.replace("\\", "\\\\").replace("$", "\\$")
    wiki, md = rf"\[\[{o}(?=[\]#|])", rf"(?i)(\]\((?:[^()\s]*/)?){o}(?=\.md[)#?])"
    parts = F.split("line", "`", -1)
    fixed = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.regexp_replace(F.regexp_replace(p, wiki, f"[[{to}"), md, f"$1{to}")).otherwise(p)), "`")
    count = F.aggregate(F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.regexp_count(p, F.lit(wiki)) + F.regexp_count(p, F.lit(md))).otherwise(0)), F.lit(0), lambda a, x: a + x)
    touched = F.col("in_body") & ~F.col("in_code")
    done = lines.select("path", "ln", F.when(touched, fixed).otherwise(F.col("line")).alias("line"), F.when(touched, count).otherwise(0).alias("n"))
    hit = done.where("n > 0").select("path").distinct()
    # a note is gathered only if a line of it changes
    return done.join(hit, "path", "left_semi").groupBy("path").agg(F.sum("n").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ln", "line"))), lambda x: x["line"]), "\n").alias("new_raw"))


def tag_rename_plan(notes: DataFrame, old: str, new: str) -> DataFrame:
    """``path, n, new_tags, merged``: the tag and those below it renamed, doubles dropped."""
    low, tags = old.lower(), F.col("tags")
    hit = lambda t: (F.lower(t) == low) | F.lower(t).startswith(low + "/")
    renamed = F.transform(tags, lambda t: F.when(hit(t), F.concat(F.lit(new), F.substr(t, F.lit(len(old) + 1)))).otherwise(t))
    out = notes.select("path", F.size(F.filter(tags, hit)).cast("long").alias("n"), F.array_distinct(renamed).alias("after"), F.size(tags).alias("was"))
    return out.where("n > 0").select("path", "n", F.array_join("after", ",").alias("new_tags"), (F.size("after") < F.col("was")).alias("merged"))


def property_rename_plan(lines: DataFrame, field: str, old: str, new: str) -> DataFrame:
    """``path, n`` of notes whose front-matter scalar ``field`` is ``old``; and the new line."""
    pattern = rf"^({re.escape(field)}:\s*)([\"']?){re.escape(old)}\2(\s*(?:#.*)?)$"
    hits = lines.where("in_front").where(F.col("line").rlike(pattern))
    return hits.select("path", F.regexp_replace("line", pattern, "$1$2" + new.replace("$", "\\$") + "$2$3").alias("new_line"))



#: Where a field that a note doesn't have yet is put among others that it doesn't have.
PREFERRED_KEYS = ("title", "doc_kind", "topic", "tags", "aliases", "related", "date", "status")
#: Plain words that YAML reads as something else than text.
NOT_TEXT = (
    r"^(~|null|Null|NULL|true|True|TRUE|false|False|FALSE|y|Y|yes|Yes|YES|n|N|no|No|NO|on|On|ON|off|Off|OFF"
    r"|[-+]?(0b[01_]+|0x[0-9a-fA-F_]+|0o[0-7_]+|[0-9][0-9_]*)|[-+]?([0-9][0-9_]*(\.[0-9_]*)?([eE][-+]?[0-9]+)?|\.[0-9_]+([eE][-+]?[0-9]+)?|\.(inf|Inf|INF))|\.(nan|NaN|NAN))$"
)
#: Text that can't stand without quotes: a mark of YAML at its start, or one that would end it.
NEEDS_QUOTES = r"""^[\s\-?:,\[\]{}#&*!|>'"%@`=]|: |:$| #|\s$|^$"""


def yaml_text(text: Column) -> Column:
    """A text as a YAML scalar: plain where that reads back as the same text, else in single quotes."""
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(text.rlike(NEEDS_QUOTES) | text.rlike(NOT_TEXT), quoted).otherwise(text)


def _scalar(value: Column) -> Column:
    """A trimmed scalar of the source as it is written again; null if it isn't YAML."""
    double, single = r'^"[^"\\]*"$', r"^'([^']|'')*'$"
    bare = F.trim(F.regexp_replace(value, r"\s#.*$", ""))
    inner = F.substr(value, F.lit(2), F.char_length(value) - 2)
    return (
        F.when(value.rlike(double), yaml_text(inner))
        .when(value.rlike(single), yaml_text(F.replace(inner, F.lit("''"), F.lit("'"))))
        .when(value.rlike(r'^"([^"\\]|\\[0abtnvfre "/\\N_LPxuU])*"$') | value.rlike(r"^\{.*\}$") | value.rlike(r"^[&!|>*]"), value)  # escapes, maps, tags and blocks stay as they stand
        .when(value.rlike(r"""^["'\[\]{}@`%,]""") | bare.rlike(r": |:$"), None)
        .when(bare.rlike(r"^(y|Y|yes|Yes|YES|n|N|no|No|NO|on|On|ON|off|Off|OFF)$"), yaml_text(bare))
        .otherwise(bare)
    )


def _items(key: Column, items: Column) -> Column:
    """A field with a list, one item a line; null if an item isn't YAML."""
    lines = F.transform(items, lambda x: F.concat(F.lit("  - "), x))
    return F.when(F.size(items) == 0, F.concat(key, F.lit(": []"))).when(~F.exists(items, lambda x: x.isNull()), F.concat(key, F.lit(":\n"), F.array_join(lines, "\n")))


def _field(chunk: Column) -> Column:
    """``key, text`` of one root-level field, written again; text is null if it isn't YAML."""
    lines = F.filter(F.split(chunk, "\n"), lambda x: ~x.rlike(r"^\s*(#|$)"))
    head, more = F.get(lines, F.lit(0)), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    shape = r"""^([^\s\-?:,\[\]{}#&*!|>'"%@`][^:]*?)\s*:(?:\s+(.*))?$"""
    key, value = F.regexp_extract(head, shape, 1), F.trim(F.regexp_extract(head, shape, 2))
    value = F.when(value.rlike("^#"), "").otherwise(value)
    flow = F.regexp_extract(value, r"^\[(.*)\](?:\s+#.*)?$", 1)
    in_flow = F.when(F.trim(flow) == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(F.regexp_replace(flow, r",\s*$", ""), r""",(?=(?:[^"']*["'][^"']*["'])*[^"']*$)"""), lambda x: F.when(F.trim(x) != "", _scalar(F.trim(x)))))
    dashed = F.transform(more, lambda x: _scalar(F.trim(F.regexp_extract(x, r"^\s*-(?:\s+(.*))?$", 1))))
    text = (
        F.when(key == "", None)
        .when(F.exists(more, lambda x: x.rlike(r"^ *\t")), None)
        .when((F.size(more) > 0) & (value == "") & F.forall(more, lambda x: x.rlike(r"^\s*-\s+[^\s{\[]") & ~x.rlike(r"^\s*-\s+[^\s\"':]+:(\s|$)")), _items(key, dashed))
        .when(F.size(more) > 0, F.when(F.forall(more, lambda x: x.rlike(r"^\s|^-\s")), F.array_join(lines, "\n")))
        .when(value == "", F.concat(key, F.lit(": null")))
        .when(value.rlike(r"^\[.*\](\s+#.*)?$"), F.when(flow.rlike(r"[\[\]{}]"), F.array_join(lines, "\n")).otherwise(_items(key, in_flow)))
        .otherwise(F.concat(key, F.lit(": "), _scalar(value)))
    )
    return F.struct(key.alias("key"), text.alias("text"))


def patch_front_matter(raw: DataFrame, set_: dict[str, str | list[str]], remove: tuple[str, ...] = ()) -> DataFrame:
    """``path, refused, new_raw`` of the notes that a patch of their front matter changes, or that refuse it.

    Fields keep their order; those a note didn't have come behind, the preferred ones first.  A
    field set to nothing is removed; without fields the front matter goes.  Lists are written
    one item a line, texts with quotes only where they need them, comments go, and nested values
    stay as they stand.  Front matter that isn't YAML by fields (a line that is none, an open
    quote or bracket, a key given twice) refuses: refused is true and new_raw null.  A note
    without front matter gets one; null texts are no notes.
    """
    gone = [*remove, *(k for k, v in set_.items() if not (v.strip() if isinstance(v, str) else v))]
    given = {k: v for k, v in set_.items() if k not in gone}
    ranked = sorted(given, key=lambda k: PREFERRED_KEYS.index(k) if k in PREFERRED_KEYS else len(PREFERRED_KEYS))
    text_of = {k: F.concat(F.lit(f"{k}: "), yaml_text(F.lit(v))) if isinstance(v, str) else _items(F.lit(k), F.transform(F.array(*[F.lit(x) for x in v]), yaml_text)) for k, v in given.items()}

    def patched(field: Column) -> Column:
        out = field["text"]
        for k, text in text_of.items():
            out = F.when(field["key"] == k, text).otherwise(out)
        return out

    front = F.regexp_replace(F.regexp_extract("raw", FRONT, 1), r"\r\n", "\n")
    chunks = F.filter(F.split(front, r"\n(?=[^\s#\-])"), lambda x: ~x.rlike(r"^(\s*(#[^\n]*)?(\n|$))*$"))
    read = raw.where("raw is not null").select("path", "raw", F.transform(chunks, _field).alias("fields"))
    keys = F.col("fields.key")
    bad = F.exists("fields", lambda f: f["text"].isNull()) | (F.size(F.array_distinct(keys)) < F.size(keys))
    kept = F.transform(F.filter("fields", lambda f: ~f["key"].isin(*gone)) if gone else F.col("fields"), patched)
    fresh = F.filter(F.array(*[F.when(~F.array_contains(keys, k), text_of[k]) for k in ranked]).cast("array<string>"), lambda x: x.isNotNull())
    body = F.regexp_replace("raw", FRONT_AND_END, "")
    texts = read.select("path", "raw", bad.alias("refused"), F.concat(kept, fresh).alias("texts"), body.alias("body"))
    new = F.when(~F.col("refused"), F.when(F.size("texts") == 0, F.col("body")).otherwise(F.concat(F.lit("---\n"), F.array_join("texts", "\n"), F.lit("\n---\n"), "body")))
    done = F.array(F.struct("refused", new.alias("new_raw")))
    # filtered before it is a column: a filter on top would be pushed down, and all of the above written out once more in it
    return texts.select("path", F.inline(F.filter(done, lambda x: x["refused"] | (x["new_raw"] != F.col("raw")))))
