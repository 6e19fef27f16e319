"""Filters, facets, table cells, sorts and counts over notes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import KEBAB, KEBAB_PATH, WIDE, date_ms, dirname, lifecycle, stem
from ..sources.shared import set_down

ARCHIVE = "_memories"


def starts_with_any(path: Column, prefixes: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def exact_filter(notes: DataFrame, doc_kinds=(), topics=(), folders=(), props: dict[str, list[str]] | None = None, properties: DataFrame | None = None) -> DataFrame:
    """Notes that pass every axis given; nothing selected gives nothing.

    props names string columns, or fields of ``properties(path, key, values)``.
    """
    if not (doc_kinds or topics or folders or props):
        return notes.limit(0)
    out = notes
    if doc_kinds:
        out = out.where(F.col("doc_kind").isin(*doc_kinds))
    if topics:
        out = out.where(F.col("topic").isin(*topics))
    if folders:
        out = out.where(starts_with_any(F.col("path"), folders))
    for field, values in (props or {}).items():
        out = with_value(out, field, values, properties)
    return out


def with_value(notes: DataFrame, field: str, values: Iterable[str], properties: DataFrame | None = None) -> DataFrame:
    """Notes whose column, or open property, ``field`` has one of the values, white space around them aside."""
    wanted = [v.strip() for v in values]
    if field in notes.columns or properties is None:
        return notes.where(F.trim(field).isin(*wanted))
    has = properties.where((F.col("key") == field) & F.exists("values", lambda v: F.trim(v).isin(*wanted)))
    return notes.join(has.select("path").distinct(), "path", "left_semi")


def expand_status(values: Iterable[str]) -> list[str]:
    """Status groups ``@done``, ``@active``, ``@todo`` as their words; an unknown group is an error."""
    from ..functions.text import STATUS_WORDS

    out: list[str] = []
    for v in values:
        if v.startswith("@"):
            if v[1:] not in STATUS_WORDS:
                raise ValueError(f"unknown status group {v}")
            out += STATUS_WORDS[v[1:]]
        else:
            out.append(v)
    return out


def tag_matches(tags: Column, wanted: str) -> Column:
    """A tag equals the wanted one or lies below it, case aside; an empty wanted matches nothing."""
    w = wanted.strip().lower()
    if not w:
        return F.lit(False)
    return F.exists(tags, lambda t: (F.lower(F.trim(t)) == w) | F.lower(F.trim(t)).startswith(w + "/"))


def any_tag(tags: Column, wanted: Iterable[str]) -> Column:
    wanted = list(wanted)
    out = F.lit(not wanted)
    for w in wanted:
        out = out | tag_matches(tags, w)
    return out


def in_scope(path: Column, under: Iterable[str] = (), exclude: Iterable[str] = (), include_archive: bool = False) -> Column:
    """Plain string prefixes; exclusion wins, and the archive is left out unless asked for."""
    under, exclude = list(under), list(exclude)
    if not include_archive:
        exclude.append(ARCHIVE)
    keep = ~starts_with_any(path, exclude)
    return F.coalesce(keep & starts_with_any(path, under) if under else keep, F.lit(True))  # a row without a path stays


def since_ms(text: str, now_ms: int) -> int:
    """``Nh``, ``Nd``, ``Nw`` back from now, or the UTC midnight of ``YYYY-MM-DD``."""
    import datetime as dt
    import re

    if m := re.fullmatch(r"(\d+)([hdw])", text.strip()):
        return now_ms - int(m[1]) * {"h": 3_600_000, "d": 86_400_000, "w": 604_800_000}[m[2]]
    day = dt.datetime.strptime(text.strip(), "%Y-%m-%d").replace(tzinfo=dt.UTC)
    return int(day.timestamp() * 1000)


def time_of(axis: str) -> Column:
    """The time of a note on the ``mtime`` or ``date`` axis, in milliseconds."""
    return F.col("mtime_ms") if axis == "mtime" else date_ms("date")


def since_report(notes: DataFrame, cutoff: int, axis: str) -> DataFrame:
    """One row: notes kept, older, and without a time."""
    t = time_of(axis)
    return notes.agg(F.count_if(t >= cutoff).alias("kept"), F.count_if(t < cutoff).alias("dropped_older"), F.count_if(t.isNull()).alias("dropped_no_time"))


def cells(notes: DataFrame) -> DataFrame:
    """Table cells of a note: title or name, kind, topic, tags joined, folder."""
    return notes.select("path", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "name").alias("title"), "doc_kind", "topic", F.array_join("tags", ", ").alias("tags"), dirname("path").alias("folder"))


def row_filter(notes: DataFrame, text: str = "", doc_kinds=(), topics=()) -> DataFrame:
    """Table rows: kind and topic any-of, and a substring of title or path, case aside; no filter keeps all."""
    out = notes
    if doc_kinds:
        out = out.where(F.col("doc_kind").isin(*doc_kinds))
    if topics:
        out = out.where(F.col("topic").isin(*topics))
    if text:
        label = F.coalesce(F.nullif(F.trim("title"), F.lit("")), "name")
        out = out.where(F.lower(F.concat_ws("\n", label, "path")).contains(text.lower()))
    return out


def cell_order(cell: Column, ascending: bool = True) -> list[Column]:
    """Blanks last either way; then dates, numbers and texts as classes, each in its own order."""
    blank = F.coalesce(F.trim(cell) == "", F.lit(True))
    number = F.when(F.trim(cell).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.trim(cell).cast("double"))
    is_date = cell.rlike(r"^\d{4}-\d{2}-\d{2}")
    kind = F.when(is_date, 0).when(number.isNotNull(), 1).otherwise(2)
    keys = [kind, F.when(~is_date, number), F.when(is_date | number.isNull(), F.lower(cell))]
    return [blank.asc(), *[k.asc() if ascending else k.desc() for k in keys]]


def table_column_order(cell: Column, ascending: bool = True) -> list[Column]:
    """Order of a column of an extracted table: blanks last, then numbers without ``,``, blanks and ``%``, then text."""
    bare = F.regexp_replace(cell, r"[, %]", "")
    number = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), bare.cast("double"))
    blank = F.coalesce(F.trim(cell) == "", F.lit(True))
    keys = [number.isNull(), number, F.when(number.isNull(), F.lower(cell))]
    return [blank.asc(), *[k.asc() if ascending else k.desc() for k in keys]]


def facet(notes: DataFrame, kind: str, properties: DataFrame | None = None) -> DataFrame:
    """``value, n`` of a facet: topics, doc_kinds, tags (occurrences), fields (notes that have it) or a field's values."""
    if kind in ("topics", "doc_kinds"):
        rows = notes.select(F.trim(kind[:-1]).alias("value")).where("value <> ''")
    elif kind == "tags":
        rows = notes.select(F.explode("tags").alias("t")).select(F.lower(F.trim("t")).alias("value"))
    elif kind == "fields":
        rows = properties.where(~F.col("key").isin("title", "doc_kind", "topic", "tags")).select(F.col("key").alias("value"))
    else:
        rows = properties.where(F.col("key") == kind).select("path", F.explode("values").alias("v")).select("path", F.trim("v").alias("value")).distinct().select("value")
    return rows.groupBy("value").agg(F.count("*").alias("n"))


def facet_listing(notes: DataFrame, kind: str, properties: DataFrame | None = None, cap: int = 50) -> DataFrame:
    """``value, n, total_distinct, truncated``: the first ``cap`` values, most notes first, then by value."""
    counts = facet(notes, kind, properties)
    total = counts.agg(F.count("*").alias("total_distinct"))
    top = counts.orderBy(F.desc("n"), "value").limit(cap)
    return top.join(F.broadcast(total)).select("value", "n", "total_distinct", (F.col("total_distinct") > cap).alias("truncated"))  # one row


#: Fields with an axis of their own, and fields that hold names of notes.
NOT_AXES = ("doc_kind", "topic", "tags", "title", "aliases", "related", "amends", "superseded_by", "parent_plan", "depends_on")
#: Identifiers, relations, prose and dates, which group nothing.
NOT_GROUPS = (
    "title", "name", "aliases", "tags",
    "related", "related_pr", "parent_plan", "depends_on", "related_brainstorm", "superseded_by", "supersedes", "related_solutions", "related_files", "related_branch", "related_seed", "related_dmg",
    "description", "purpose", "decision", "output", "deferred_reason", "target_audience", "source", "confluence_parent", "metadata", "files",
    "date", "created", "last_update", "originsessionid",
)


def kind_topic_counts(notes: DataFrame) -> DataFrame:
    """Counts by kind and by topic in one pass."""
    grouped = notes.groupingSets([["doc_kind"], ["topic"]], "doc_kind", "topic").agg(F.count("*").alias("n"), F.grouping("doc_kind").alias("no_kind"))
    return grouped.select(F.when(F.col("no_kind") == 0, "doc_kind").otherwise("topic").alias("axis"), F.coalesce("doc_kind", "topic").alias("value"), "n")


def filter_axes(properties: DataFrame, least: int = 4, most_share: float = 0.5, skip=NOT_AXES) -> DataFrame:
    """``key, value, n`` of fields used often enough with few enough distinct values; a note counts once for a value."""
    values = properties.where(~F.col("key").isin(*skip)).select("key", F.explode(F.array_distinct("values")).alias("v")).select("key", F.trim("v").alias("value")).where("value <> ''").groupBy("key", "value").agg(F.count("*").alias("n"))
    good = values.groupBy("key").agg(F.sum("n").alias("used"), F.count("*").alias("distinct_values")).where(F.col("used") >= least).where(F.col("distinct_values") <= F.col("used") * most_share)
    return values.join(good.select("key"), "key", "left_semi")


def grouping_candidates(properties: DataFrame, least: int = 3, most: int = 50, skip=NOT_GROUPS) -> DataFrame:
    """``key, n_notes, n_values`` of fields that could group notes by their first value: few values, not one a note."""
    first = properties.where(~F.lower("key").isin(*skip) & (F.size("values") > 0)).select("path", "key", F.element_at("values", 1).alias("value"))
    counted = first.groupBy("key").agg(F.count_distinct("path").alias("n_notes"), F.count_distinct("value").alias("n_values"))
    return counted.where((F.col("n_notes") >= least) & (F.col("n_values") <= most) & (F.col("n_values") < F.col("n_notes")))


def group_by_field(notes: DataFrame, properties: DataFrame, field: str) -> DataFrame:
    """``value, is_none, n`` of notes by a field's first value."""
    first = properties.where(F.col("key") == field).select("path", F.trim(F.element_at("values", 1)).alias("value"))
    joined = notes.select("path").join(first, "path", "left").withColumn("value", F.nullif("value", F.lit("")))
    return joined.groupBy(F.coalesce("value", F.lit("(none)")).alias("value"), F.col("value").isNull().alias("is_none")).agg(F.count("*").alias("n"))


def available_columns(properties: DataFrame) -> DataFrame:
    """``key, n``: fields with a non-blank value."""
    return properties.where(F.exists("values", lambda v: F.trim(v) != "")).groupBy("key").agg(F.count_distinct("path").alias("n"))


def tag_prefixes(notes: DataFrame) -> DataFrame:
    """``prefix, depth, tag, path``: every level of every tag, in lower case."""
    tags = notes.select("path", F.explode("tags").alias("spelled")).withColumn("tag", F.lower(F.trim("spelled")))
    parts = F.split("tag", "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("prefix"), i.alias("depth")))
    return tags.select("path", "tag", "spelled", F.explode(levels).alias("l")).select("path", "tag", "spelled", "l.prefix", "l.depth")


def tag_index(notes: DataFrame) -> DataFrame:
    """``prefix, depth, n_notes, n_exact, n_children, display`` of every tag level."""
    levels = tag_prefixes(notes)
    counts = levels.groupBy("prefix", "depth").agg(F.count_distinct("path").alias("n_notes"), F.count_distinct(F.when(F.col("tag") == F.col("prefix"), F.col("path"))).alias("n_exact"))
    parent = F.regexp_extract("prefix", r"^(.*)/[^/]*$", 1)
    children = counts.where("depth > 1").groupBy(parent.alias("prefix")).agg(F.count("*").alias("n_children"))
    spelled = levels.where("tag = prefix").groupBy("prefix", "spelled").agg(F.count("*").alias("n"))
    best = spelled.withColumn("r", F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("n"), "spelled"))).where("r = 1").select("prefix", F.col("spelled").alias("display"))
    joined = counts.join(children, "prefix", "left").join(best, "prefix", "left")
    return joined.select("prefix", "depth", "n_notes", "n_exact", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("display", "prefix").alias("display"))


def notes_of_tag(notes: DataFrame, wanted: str, prefix: bool) -> DataFrame:
    """``path, label`` of notes with a tag, or at any level below it."""
    w = wanted.lower()
    has = tag_matches(F.col("tags"), w) if prefix else F.exists("tags", lambda t: F.lower(F.trim(t)) == w)
    return notes.where(has).select("path", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "name").alias("label"))


def folder_levels(notes: DataFrame) -> DataFrame:
    """``folder, depth, path``: every folder above every note."""
    parts = F.split(dirname("path"), "/")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder"), i.alias("depth")))
    return notes.where(dirname("path") != "").select("path", F.explode(levels).alias("l")).select("path", "l.folder", "l.depth")


def folder_listing(notes: DataFrame) -> DataFrame:
    """``parent, is_dir, name, path, n``: what each folder holds, folders before notes, each by name, case aside.

    n: notes at any depth below a folder, null for a note; the root's parent is empty.  Folders
    without notes don't show.  The order is one over the table, so that a folder that holds most
    notes is no task of its own.
    """
    above = folder_levels(notes).groupBy("folder").agg(F.count("*").alias("n"))
    dirs = above.select(dirname("folder").alias("parent"), F.lit(True).alias("is_dir"), F.element_at(F.split("folder", "/"), -1).alias("name"), F.col("folder").alias("path"), "n")
    files = notes.select(dirname("path").alias("parent"), F.lit(False).alias("is_dir"), stem("path").alias("name"), "path", F.lit(None).cast("long").alias("n"))
    return dirs.unionByName(files).orderBy("parent", F.desc("is_dir"), F.lower("name"), "path")


def folder_rollup(notes: DataFrame, n_notes: int, depth: int = 2, least: int = 2) -> DataFrame:
    """``folder, n`` of folders that narrow a scope: at least ``least`` notes, not all."""
    return folder_levels(notes).where(F.col("depth") <= depth).groupBy("folder").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") < n_notes))


def tree_filter(notes: DataFrame, needle: str) -> DataFrame:
    """Notes with a path segment that contains the needle, case aside."""
    return notes.where(F.exists(F.split("path", "/"), lambda s: F.lower(s).contains(needle.lower())))


def statistics(notes: DataFrame) -> DataFrame:
    """``path, words, chars, chars_solid, minutes`` of the text without its front matter; a blank text has none.

    500 wide characters or 200 tokens with a Latin letter or digit take a minute.
    """
    space = r"[\s\p{Z}\x{FEFF}]"
    whole = notes.select("path", F.regexp_replace(F.coalesce("text", F.lit("")), r"^---\s*\r?\n[\s\S]*?\r?\n---\s*\r?\n?", "").alias("text"))
    # every pattern takes each character once: spaces are counted, not cut out, and a token from its first letter or digit on
    token = "[A-Za-z0-9]" + space.replace("[", "[^", 1) + "*+"
    counts = {"words": F.regexp_count("text", F.lit(space.replace("[", "[^", 1) + "++")), "chars": F.char_length("text"), "spaces": F.regexp_count("text", F.lit(space)), "wide": F.regexp_count("text", F.lit(WIDE)), "tokens": F.regexp_count("text", F.lit(token))}
    # a row's counts are made once, not wherever they are asked for
    found = whole.select("path", F.explode(F.array(F.struct(*[c.alias(name) for name, c in counts.items()]))).alias("c")).select("path", "c.*")
    raw = F.col("wide") / 500 + F.col("tokens") / 200
    out = {"words": F.col("words"), "chars": F.col("chars"), "chars_solid": F.col("chars") - F.col("spaces"), "minutes": F.when(raw > 0, F.greatest(F.lit(1), F.ceil(raw))).otherwise(0)}
    return found.select("path", *[F.when(F.col("chars") == F.col("spaces"), 0).otherwise(c).cast("long").alias(name) for name, c in out.items()])


def bad_values(notes: DataFrame) -> DataFrame:
    """``path, field, value, reason`` of topics and tags that aren't kebab-case."""
    topics = notes.select("path", F.lit("topic").alias("field"), F.col("topic").alias("value"), F.when(F.coalesce(F.trim("topic"), F.lit("")) == "", "empty").when(F.col("topic").contains("/"), "nested").when(~F.col("topic").rlike(KEBAB), "not kebab-case").alias("reason"))
    tags = notes.select("path", F.lit("tag").alias("field"), F.explode("tags").alias("value")).withColumn("reason", F.when(F.trim("value") == "", "empty").when(~F.col("value").rlike(KEBAB_PATH), "not kebab-case"))
    return topics.unionByName(tags).where("reason is not null")


def audited(found: DataFrame, check: str, unit: str, order: list[str], cap: int = 20) -> DataFrame:
    """Rows of an audit in order, at most ``cap``, with ``check, unit, total, truncated``: the total counts before the cut."""
    total = found.agg(F.count("*").alias("total"))
    head = found.orderBy(*order).limit(cap).join(F.broadcast(total))  # one row
    return head.select(F.lit(check).alias("check"), F.lit(unit).alias("unit"), *found.columns, "total", (F.col("total") > cap).alias("truncated"))


def tag_issues(notes: DataFrame) -> DataFrame:
    """``issue, key, members, n``: spellings that differ by case, equal last segments, tags on nearly all notes."""
    total = notes.agg(F.count("*").alias("total"))
    tags = notes.select("path", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count_distinct("path").alias("n"))
    low = F.lower("tag")
    case_only = tags.groupBy(low.alias("key")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("members"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    leaf = tags.groupBy(F.lower(F.element_at(F.split("tag", "/"), -1)).alias("key")).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("members"), F.sum("n").alias("n"), F.count_distinct(low).alias("k")).where("k > 1")
    # one row holds the total; the join is against it alone
    common = tags.join(F.broadcast(total)).where("total >= 5 and n >= 0.9 * total").select(F.col("tag").alias("key"), F.col("tag").alias("members"), "n")
    return case_only.select(F.lit("case-only").alias("issue"), "key", "members", "n").unionByName(leaf.select(F.lit("same-leaf").alias("issue"), "key", "members", "n")).unionByName(common.select(F.lit("near-universal").alias("issue"), "key", "members", "n"))


def value_issues(properties: DataFrame, relation_types: DataFrame, least: int = 5, most_share: float = 0.5, always=("doc_kind", "topic")) -> DataFrame:
    """``key, issue, value, other``: values of a field that look alike, and fields of mostly single values.

    Pairs meet through equi-join keys: lower case, plural stem, and boundary prefixes and
    suffixes of the longer value; no two values are compared that share none.
    """
    values = properties.select("key", F.explode("values").alias("v")).select("key", F.trim("v").alias("value")).where("value <> ''").groupBy("key", "value").agg(F.count("*").alias("n"))
    fields = values.groupBy("key").agg(F.sum("n").alias("used"), F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single"))
    fit = fields.where((F.col("used") >= least) & ((F.col("kinds") <= F.col("used") * most_share) | F.col("key").isin(*always))).join(relation_types.select(F.col("type").alias("key")).distinct(), "key", "left_anti")
    own = values.join(fit.select("key"), "key", "left_semi")
    a = own.select("key", F.col("value").alias("other"), F.lower("value").alias("low"))
    case = own.select("key", "value", F.lower("value").alias("low")).join(a, ["key", "low"]).where("value < other").select("key", F.lit("case-only").alias("issue"), "value", "other")
    longer = own.select("key", F.col("value").alias("other"), F.lower("value").alias("long"))
    plural = longer.select("key", "other", F.explode(F.array(F.when(F.col("long").endswith("s"), F.expr("left(long, char_length(long) - 1)")), F.when(F.col("long").endswith("es"), F.expr("left(long, char_length(long) - 2)")))).alias("low")).where("low <> ''")
    plural = plural.join(own.select("key", "value", F.lower("value").alias("low")), ["key", "low"]).select("key", F.lit("plural").alias("issue"), "value", "other")
    places = F.filter(F.sequence(F.lit(1), F.char_length("long") - 1), lambda i: F.substr(F.col("long"), i + 1, F.lit(1)).rlike(r"[^\p{L}\p{N}]"))
    heads = longer.where("char_length(long) > 1").select("key", "other", F.explode(F.transform(places, lambda i: F.substr(F.col("long"), F.lit(1), i))).alias("low"))
    tails = longer.where("char_length(long) > 2").select("key", "other", F.explode(F.transform(places, lambda i: F.substr(F.col("long"), i + 2))).alias("low")).where("low <> ''")
    low = own.select("key", "value", F.lower("value").alias("low"))
    prefix = heads.join(low, ["key", "low"]).select("key", F.lit("prefix").alias("issue"), "value", "other")
    suffix = tails.join(low, ["key", "low"]).select("key", F.lit("suffix").alias("issue"), "value", "other")
    sparse = fit.where("single >= 3 and single >= 0.5 * kinds").select("key", F.lit("sparse").alias("issue"), F.col("single").cast("string").alias("value"), F.lit("").alias("other"))
    return case.unionByName(plural).unionByName(prefix).unionByName(suffix).unionByName(sparse).distinct()


#: Fields whose values are looked at elsewhere.
NOT_AUDITED = ("tags", "aliases")
#: Single values that a finding of a field that never settled shows.
SHOWN_VALUES = 8
#: Parts into which a field's single values are dealt before the first ones are kept.
SHOWN_PARTS = 32


def field_issues(properties: DataFrame, relation_types: DataFrame, least: int = 5, most_share: float = 0.5, always=("doc_kind", "topic")) -> DataFrame:
    """``field, issue, head, value, n, total``: a row for every value of every finding about a field's values.

    case-only: values that differ by case (head: the lower case); plural: one is the other with s
    or es behind (head: the first), neither of them a case-only one, a plural not looked at as a
    singular again; prefix, suffix: one begins or ends the other and no letter or digit
    follows or precedes it there (head: the shorter one); sparse: at least 3 values, and half of
    all, are used by one note (head empty, the first 8 values, total: all of them).  n: notes
    with the value.  Fields with links to notes are left out, and so are those with fewer than
    ``least`` uses or with more kinds of values than ``most_share`` of the uses, but for ``always``.
    """
    trimmed = F.array_distinct(F.transform("values", lambda v: F.trim(v)))
    values = properties.where(~F.lower("key").isin(*NOT_AUDITED)).select("key", F.explode(trimmed).alias("value")).where("value <> ''").groupBy("key", "value").agg(F.count("*").alias("n"))
    fields = values.groupBy("key").agg(F.sum("n").alias("used"), F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("single"))
    fit = fields.where((F.col("used") >= least) & (F.col("kinds") <= F.col("used") * most_share) | F.col("key").isin(*always)).join(relation_types.select(F.col("type").alias("key")).distinct(), "key", "left_anti")
    # one row a value of a field; all findings read it
    own = set_down(values.join(fit.select("key", "kinds", "single"), "key").withColumn("low", F.lower("value")), "field-values")
    folded = own.groupBy("key", "low").agg(F.count("*").alias("k"), F.min("value").alias("value"), F.max("n").alias("n"))
    cased = own.join(folded.where("k > 1").select("key", "low"), ["key", "low"]).select("key", F.lit("case-only").alias("issue"), F.col("low").alias("head"), "value", "n")

    one = folded.where("k = 1").select("key", "low", "value", "n")
    cut = F.array(F.when(F.col("low").endswith("s"), F.expr("left(low, char_length(low) - 1)")), F.when(F.col("low").endswith("es"), F.expr("left(low, char_length(low) - 2)")))
    pairs = one.select("key", F.col("value").alias("other"), F.col("n").alias("other_n"), F.explode(cut).alias("low")).where("low <> ''").join(one, ["key", "low"])
    pairs = pairs.join(pairs.select("key", F.col("other").alias("value")).distinct(), ["key", "value"], "left_anti")
    both = F.explode(F.array(F.struct("value", "n"), F.struct(F.col("other").alias("value"), F.col("other_n").alias("n")))).alias("v")
    plural = pairs.select("key", F.col("value").alias("head"), both).select("key", F.lit("plural").alias("issue"), "head", "v.value", "v.n").distinct()

    at = F.filter(F.sequence(F.lit(1), F.char_length("value") - 1), lambda i: F.substr(F.col("value"), i + 1, F.lit(1)).rlike(r"[^\p{L}\p{N}]"))
    before = F.filter(F.sequence(F.lit(1), F.char_length("value") - 1), lambda i: F.substr(F.col("value"), i, F.lit(1)).rlike(r"[^\p{L}\p{N}]"))
    long = own.where("char_length(value) > 1").select("key", "value", "n", F.transform(at, lambda i: F.substr(F.col("value"), F.lit(1), i)).alias("heads"), F.transform(before, lambda i: F.substr(F.col("value"), i + 1)).alias("tails"))
    found = None
    for issue, parts in (("prefix", "heads"), ("suffix", "tails")):
        met = long.select("key", "value", "n", F.explode(parts).alias("head")).join(own.select("key", F.col("value").alias("head"), F.col("n").alias("head_n")), ["key", "head"])
        rows = met.select("key", "head", "value", "n").unionByName(met.select("key", "head", F.col("head").alias("value"), F.col("head_n").alias("n")).distinct())
        rows = rows.select("key", F.lit(issue).alias("issue"), "head", "value", "n")
        found = rows if found is None else found.unionByName(rows)

    part = F.pmod(F.xxhash64("value"), F.lit(SHOWN_PARTS))
    first = own.where("n = 1 and single >= 3 and single >= 0.5 * kinds").withColumn("total", F.col("single")).withColumn("r", F.row_number().over(W.partitionBy("key", part).orderBy("value"))).where(F.col("r") <= SHOWN_VALUES)
    first = first.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy("value"))).where(F.col("r") <= SHOWN_VALUES)
    sparse = first.select("key", F.lit("sparse").alias("issue"), F.lit("").alias("head"), "value", "n", "total")
    return cased.unionByName(plural).unionByName(found).withColumn("total", F.lit(None).cast("long")).unionByName(sparse).withColumnRenamed("key", "field")


def task_groups(tasks: DataFrame) -> DataFrame:
    """``path, open, done, first_open`` of notes with open tasks."""
    return tasks.groupBy("path").agg(F.count_if(~F.col("done")).alias("open"), F.count_if("done").alias("done"), F.min_by(F.when(~F.col("done"), F.col("text")), F.when(~F.col("done"), F.col("ln"))).alias("first_open")).where("open > 0")


def fullest_tasks(groups: DataFrame, top: int) -> DataFrame:
    """The ``top`` notes with the most open tasks, fullest first; with all ``notes`` that have some, and how many are ``hidden``."""
    total = groups.agg(F.count("*").alias("notes"))
    return groups.orderBy(F.desc("open"), "path").limit(top).join(total).withColumn("hidden", F.greatest(F.col("notes") - top, F.lit(0)).cast("long")).orderBy(F.desc("open"), "path")  # one row beside


def task_concentration(groups: DataFrame) -> DataFrame:
    """One row: open tasks, notes with some, the fullest note and its share."""
    top = F.min(F.struct((-F.col("open")).alias("o"), "path"))
    return groups.agg(F.sum("open").alias("total_open"), F.count("*").alias("notes"), top.alias("top")).select(F.coalesce("total_open", F.lit(0)).alias("total_open"), "notes", F.col("top.path").alias("top_path"), F.try_divide(-F.col("top.o"), F.col("total_open")).alias("share"))


def decayed(notes: DataFrame, groups: DataFrame) -> DataFrame:
    """``path, status, open``: notes said to be done that have open tasks."""
    return notes.where(lifecycle("status") == "done").join(groups.select("path", "open"), "path").select("path", "status", "open")


def stale(notes: DataFrame, now_ms: int, days: int = 180) -> DataFrame:
    """``path, days``: notes whose latest time is at least so many days back."""
    t = F.greatest(F.col("mtime_ms"), date_ms("date"))
    aged = notes.select("path", t.alias("t")).where(F.col("t").isNotNull() & (F.col("t") <= now_ms)).withColumn("days", F.floor((F.lit(now_ms) - F.col("t")) / 86_400_000).cast("long"))
    return aged.where(F.col("days") >= days).select("path", "days")
