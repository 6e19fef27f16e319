"""The corpus query: structural arms, a text arm, time, sort and limit; and saved queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import nfc, note_tokens
from ..operators import facets, search
from ..operators.graph import hash_filter
from ..sources.shared import set_down


class QueryError(ValueError):
    """A named error of the query's arguments; no hits are never an error."""

    def __init__(self, name: str, message: str) -> None:
        super().__init__(f"{name}: {message}")
        self.name = name


@dataclass
class CorpusQuery:
    text: str = ""
    backlinks_of: str = ""
    tag: str = ""
    props: dict[str, list[str]] = field(default_factory=dict)
    under: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include_archive: bool = False
    since: str = ""
    axis: str = "mtime"
    sort: str = ""
    min_rel: float = 0.0
    limit: int = 10
    now_ms: int = 0

    def check(self) -> None:
        if not (self.text.strip() or self.backlinks_of or self.tag or self.props or self.since):
            raise QueryError("no_criteria", "give a text, a note, a tag, fields or a time")
        if self.axis not in ("mtime", "date"):
            raise QueryError("bad_axis", self.axis)
        if self.sort not in ("", "recent", "path"):
            raise QueryError("bad_sort", self.sort)
        for key, values in self.props.items():
            if key != "status" and any(v.startswith("@") for v in values):
                raise QueryError("bad_group", f"groups are for status, not {key}")
        if self.since:
            try:
                facets.since_ms(self.since, self.now_ms)
            except ValueError as e:
                raise QueryError("bad_since", self.since) from e

    def cap(self) -> int:
        return max(1, min(50, int(self.limit)))


def find_note(notes: DataFrame, names: DataFrame, wanted: str) -> str:
    """Path of a note by path or name; at most two rows are looked at."""
    by_path = [r.path for r in notes.where((F.col("path") == wanted)).select("path").limit(1).collect()]
    if by_path:
        return by_path[0]
    found = [r.path for r in names.where(F.col("key") == wanted.strip().lower()).select("path").orderBy("path").limit(2).collect()]
    if len(found) > 1:
        raise QueryError("name_ambiguous", wanted)
    if not found:
        raise QueryError("path_not_indexed" if "/" in wanted else "name_unknown", wanted)
    return found[0]


def structural(q: CorpusQuery, notes: DataFrame, references: DataFrame | None = None, properties: DataFrame | None = None) -> DataFrame:
    """Notes that pass all structural arms; fields that aren't columns are looked up in ``properties``."""
    pool = notes.where(facets.in_scope(F.col("path"), q.under, q.exclude, q.include_archive))
    if q.backlinks_of:
        pool = pool.join(references.where(F.col("dst") == q.backlinks_of).select(F.col("src").alias("path")).distinct(), "path", "left_semi")
    if q.tag:
        pool = pool.where(facets.tag_matches(F.col("tags"), nfc(q.tag)))
    for key, values in q.props.items():
        if values:
            pool = facets.with_value(pool, key, facets.expand_status(map(nfc, values)), properties)
    if q.since:
        pool = pool.where(facets.time_of(q.axis) >= facets.since_ms(q.since, q.now_ms))
    return pool


def corpus_query(q: CorpusQuery, notes: DataFrame, posted: DataFrame, lengths: DataFrame, references: DataFrame | None = None, fuzzy: bool = True, properties: DataFrame | None = None) -> DataFrame:
    """``path, score, rel, sources, title, doc_kind, topic, via, snippet`` in order, at most the limit.

    With structure and text: ranked notes of the pool by score, then the rest of the pool.
    With text alone: ranked notes.  Unscored notes by path, or by time with nulls last.  sources:
    structural, bm25 or both; via: what refers to the note asked for, links and fields; snippet:
    the text around the first word found, looked up for the rows of the answer alone.
    """
    q.check()
    pool = structural(q, notes, references, properties)
    only_text = bool(q.text.strip()) and not (q.backlinks_of or q.tag or q.props or q.since)
    rows = pool.select("path", "title", "doc_kind", "topic", facets.time_of(q.axis).alias("t"))
    terms: list[str] = []
    if q.text.strip():
        queries = notes.sparkSession.createDataFrame([(0, nfc(q.text))], "qid int, query string")
        terms = list(dict.fromkeys(queries.select(note_tokens("query")).first()[0]))  # the words of one query
        hits = search.search(queries, posted, lengths, 0, fuzzy, fuzzy).where(F.col("rel") >= max(0.0, min(1.0, q.min_rel)))
        rows = rows.join(hits.select("path", "score", "rel"), "path", "inner" if only_text else "left")
    else:
        rows = rows.withColumns({"score": F.lit(None).cast("double"), "rel": F.lit(None).cast("double")})
    order = [F.col("score").desc_nulls_last()] if q.sort == "" else []
    order += [F.col("t").desc_nulls_last()] if q.sort == "recent" else []
    first = rows.orderBy(*order, "path").limit(q.cap())
    via = references.where(F.col("dst") == q.backlinks_of).select(F.col("src").alias("path"), "via") if q.backlinks_of else None
    first = first.join(via, "path", "left") if via is not None else first.withColumn("via", F.lit(None).cast("string"))
    shown = first.join(notes.select("path", "text"), "path") if terms else first.withColumn("text", F.lit(None).cast("string"))
    snippet = search.around(F.col("text"), terms) if terms else F.col("text")
    scored = F.when(F.col("score").isNotNull(), "structural,bm25").otherwise("structural")
    return shown.orderBy(*order, "path").select("path", "score", "rel", (F.lit("bm25") if only_text else scored).alias("sources"), "title", "doc_kind", "topic", "via", snippet.alias("snippet"))


def query_report(q: CorpusQuery, notes: DataFrame, posted: DataFrame, lengths: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """``arm, matched, body, frontmatter, corpus``: how many notes each arm matches; of references, by links and by fields."""
    arms = []
    none = F.lit(None).cast("long")
    put = lambda arm, df, body=none, front=none: arms.append(df.select(F.lit(arm).alias("arm"), "matched", body.alias("body"), front.alias("frontmatter")))
    total = notes.agg(F.count("*").alias("corpus"))
    if q.backlinks_of:
        parts = F.split("via", ",")
        own = references.where(F.col("dst") == q.backlinks_of)
        put("refs", own.agg(F.count("*").alias("matched"), F.count_if(F.array_contains(parts, "link")).alias("b"), F.coalesce(F.sum(F.size(F.filter(parts, lambda x: x.startswith("fm:")))), F.lit(0)).alias("f")), F.col("b"), F.col("f"))
    if q.tag:
        put("tag", notes.agg(F.count_if(facets.tag_matches(F.col("tags"), q.tag)).alias("matched")))
    for key, values in q.props.items():
        put(f"props:{key}", notes.agg(F.count_if(F.trim(key).isin(*facets.expand_status(values))).alias("matched")))
    if q.text.strip():
        queries = notes.sparkSession.createDataFrame([(0, nfc(q.text))], "qid int, query string")
        put("text", search.search(queries, posted, lengths, 0, False, False).agg(F.count("*").alias("matched")))
    put("pool", structural(q, notes, references).agg(F.count("*").alias("matched")))
    out = arms[0]
    for a in arms[1:]:
        out = out.unionByName(a)
    return out.join(F.broadcast(total)).select("arm", "matched", "body", "frontmatter", "corpus")  # one row


def query_outcome(q: CorpusQuery, notes: DataFrame, posted: DataFrame, lengths: DataFrame, references: DataFrame | None = None, fuzzy: bool = True, properties: DataFrame | None = None) -> DataFrame:
    """One row: ``returned, total, truncated, combine, dropped_low, dropped_outside`` of a query with a text.

    combine is the step of the ladder that answered; hits are dropped for a low relative score,
    or because no structural arm lets them in; truncated counts what the answer could have held.
    """
    pool = structural(q, notes, references, properties).select("path")
    hits = search.search(notes.sparkSession.createDataFrame([(0, nfc(q.text))], "qid int, query string"), posted, lengths, 0, fuzzy, fuzzy)
    only_text = not (q.backlinks_of or q.tag or q.props or q.since)
    judged = hits.select("path", "stage", (F.col("rel") >= max(0.0, min(1.0, q.min_rel))).alias("near")).join(pool.withColumn("inside", F.lit(True)), "path", "left")
    seen = judged.agg(F.first("stage").alias("combine"), F.count_if(F.expr("near and inside")).alias("hits"), F.count_if(F.expr("not near")).alias("dropped_low"), F.count_if(F.expr("near and inside is null")).alias("dropped_outside"))
    total = F.col("hits") if only_text else F.col("pool")
    row = seen.join(pool.agg(F.count("*").alias("pool")))  # single rows
    return row.select(F.least(total, F.lit(q.cap())).alias("returned"), total.alias("total"), (total > q.cap()).alias("truncated"), "combine", "dropped_low", "dropped_outside")


#: Letters of the pieces by which needles and labels meet; parts into which a query's hits are dealt before they are ranked.
GRAM, PARTS = 3, 32


def grams_of(text: Column, size: Column | int) -> Column:
    """The distinct pieces of ``size`` letters of a text."""
    last = F.char_length(text) - size
    return F.array_distinct(F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substr(text, i + 1, F.lit(size) if isinstance(size, int) else size))).otherwise(F.array().cast("array<string>")))


def containing(needles: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, path`` of the ``labels(path, label)`` that contain the needle of ``needles(id, needle)``.

    Every distinct needle waits under its rarest piece, counted over all labels; labels meet it by
    the pieces they have, and only those are searched.  Empty needles are in every label's way and
    find nothing.
    """
    asked = needles.where("needle <> ''").select("needle").distinct()
    pieces = set_down(asked.select("needle", F.explode(grams_of(F.col("needle"), F.least(F.lit(GRAM), F.char_length("needle")))).alias("piece")), "needle-pieces")
    sizes = [r[0] for r in pieces.select(F.char_length("piece")).distinct().collect()]  # three at most
    known = pieces.select(F.xxhash64("piece").alias("h")).distinct()
    some = hash_filter(known, known.count())
    # pieces that no needle has are dropped where they arise
    shown = labels.select("path", "label", F.explode(F.concat(F.array().cast("array<string>"), *[grams_of(F.col("label"), k) for k in sizes])).alias("piece"))
    used = shown.select("piece").where(some(F.xxhash64("piece"))).groupBy("piece").agg(F.count("*").alias("n"))
    waiting = set_down(pieces.join(used, "piece").groupBy("needle").agg(F.min(F.struct("n", "piece")).alias("p")).select("needle", "p.piece"), "waiting-needles")
    rare = waiting.select(F.xxhash64("piece").alias("h")).distinct()
    met = shown.where(hash_filter(rare, rare.count())(F.xxhash64("piece"))).join(waiting, "piece").where(F.contains("label", F.col("needle"))).select("needle", "path")
    return met.join(needles.select("id", "needle"), "needle").select("id", "path")


def run_saved(saved: DataFrame, notes: DataFrame) -> DataFrame:
    """``query_path, ln, path, pos, total``: the first ``limit`` notes of every saved query, and how many there are.

    A query's conditions are any-of lists and a text; its notes are found by joining on each
    list's values, and by the pieces of its text.
    """
    from pyspark.sql import Window as W

    good = saved.where("size(errors) = 0").withColumn("id", F.struct("path", "ln"))
    levels = facets.tag_prefixes(notes).select("path", F.col("prefix").alias("v")).distinct()
    sides = []
    for column, values in (("doc_kinds", notes.select("path", F.col("doc_kind").alias("v"))), ("topics", notes.select("path", F.col("topic").alias("v"))), ("tags", levels)):
        asked = good.where(F.size(column) > 0).select("id", F.explode(column).alias("v")).withColumn("v", F.lower("v") if column == "tags" else F.col("v"))
        sides.append(asked.join(values, "v").select("id", "path").distinct())
    labels = notes.select("path", F.lower(F.concat_ws("\n", "title", "path")).alias("label"))
    texts = good.where("text is not null").select("id", F.lower("text").alias("needle"))
    sides.append(containing(texts, labels))
    need = good.select("id", "limit", sum((F.when(F.size(c) > 0, 1).otherwise(0) for c in ("doc_kinds", "topics", "tags")), F.when(F.col("text").isNotNull(), 1).otherwise(0)).alias("need"))
    met = sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3]).groupBy("id", "path").agg(F.count("*").alias("k"))
    rows = met.join(need, "id").where("k = need").drop("k", "need")
    # a query that most notes answer is ranked part by part before its first ones are
    by = W.partitionBy("id", F.pmod(F.xxhash64("path"), F.lit(PARTS))).orderBy("path")
    first = rows.withColumn("r", F.row_number().over(by)).where("r <= limit").withColumn("pos", F.row_number().over(W.partitionBy("id").orderBy("path"))).where("pos <= limit")
    totals = rows.groupBy("id").agg(F.count("*").alias("total"))
    return first.join(totals, "id").select(F.col("id.path").alias("query_path"), F.col("id.ln").alias("ln"), "path", "pos", "total")
