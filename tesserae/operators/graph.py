"""Names, links and relations between notes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import windows
from ..functions.text import slugify, stem
from ..sources.shared import set_down, short_batches

#: Fields that hold plain values, not references to notes.
PLAIN_FIELDS = (
    "title", "name", "aliases", "tags", "doc_kind", "topic", "date", "created", "last_update", "status", "priority", "phase", "severity", "branch", "current_branch", "description", "purpose",
    "target_audience", "decision", "output", "deferred_reason", "user_confirmed", "metadata", "files", "owner",
)


def resolver(notes: DataFrame) -> DataFrame:
    """``key, path, n_candidates``: lower-case names to notes; of alias, title and stem the best tier a key has."""
    return best_names(name_rows(notes))


def name_rows(notes: DataFrame) -> DataFrame:
    """``key, tier, path``: the lower-case aliases, title and stem of every note."""
    aliases = F.col("aliases") if "aliases" in notes.columns else F.array().cast("array<string>")
    named = [notes.select(F.explode(aliases).alias("key"), F.lit(0).alias("tier"), "path"), notes.select(F.col("title").alias("key"), F.lit(1).alias("tier"), "path"), notes.select(F.col("name").alias("key"), F.lit(2).alias("tier"), "path")]
    return named[0].unionByName(named[1]).unionByName(named[2]).select(F.lower(F.trim("key")).alias("key"), "tier", "path").where("key <> ''")


def best_names(keys: DataFrame) -> DataFrame:
    """``key, path, n_candidates`` of name rows: the notes of each key's best tier."""
    best = keys.groupBy("key").agg(F.min("tier").alias("tier"))  # pre-aggregated: a popular title is no hot window
    kept = keys.join(best, ["key", "tier"]).select("key", "path").distinct()
    return kept.join(kept.groupBy("key").agg(F.count("*").alias("n_candidates")), "key")


def target_keys(links: DataFrame) -> DataFrame:
    """``whole`` and ``bare`` lower-case keys of a link target: before the alias, and before the anchor too."""
    name = F.trim(F.regexp_extract("target", r"^[^|]*", 0))
    bare = F.trim(F.regexp_extract(name, r"^[^#]*", 0))
    return links.withColumns({"whole": F.lower(name), "bare": F.when(bare != "", F.lower(bare)), "anchor": F.regexp_extract(name, r"#(.*)$", 1)})


def folders_above(path: str) -> Column:
    """Every folder above a path as (depth, folder), the root of depth 0 included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("folder")))


def resolve(links: DataFrame, names: DataFrame) -> DataFrame:
    """``links(path, target, ...)`` with ``dst`` (null if unknown) and ``anchor``.

    The whole name wins over the name without anchor; of several candidates the one that shares
    the most leading folders with the linking note, then the smallest path.
    """
    keyed = target_keys(links).withColumn("link_id", F.struct("path", "target"))
    asked = keyed.select("path", "target", "whole", "bare", "anchor").distinct()
    known = names.select("key").distinct()
    whole = asked.join(known.withColumnRenamed("key", "whole"), "whole", "left_semi").withColumn("key", F.col("whole"))
    bare = asked.join(known.withColumnRenamed("key", "whole"), "whole", "left_anti").withColumn("key", F.col("bare"))
    # a name stands once below every folder, by its smallest path there: links and notes of a popular name are never paired
    below = names.select("key", "path", F.explode(folders_above("path")).alias("f")).groupBy("key", "f").agg(F.min("path").alias("dst"))
    candidates = whole.unionByName(bare).select("path", "target", "key", F.explode(folders_above("path")).alias("f")).join(below, ["key", "f"])
    best = candidates.groupBy("path", "target").agg(F.max_by("dst", "f.depth").alias("dst"))
    return keyed.drop("link_id", "whole", "bare").join(best, ["path", "target"], "left")


def resolve_anchors(links: DataFrame, names: DataFrame, headings: DataFrame) -> DataFrame:
    """``path, target, dst, anchor, same_note, missing`` of links with an anchor.

    A bare ``#anchor`` is of the linking note itself; missing: the note is known and has no such heading.
    """
    resolved = resolve(links.select("path", "target").distinct(), names).where("anchor <> ''")
    own = F.trim(F.regexp_extract("target", r"^[^#|]*", 0)) == ""
    placed = resolved.select("path", "target", F.when(own, F.col("path")).otherwise(F.col("dst")).alias("dst"), "anchor", slugify("anchor").alias("slug"))
    known = headings.select(F.col("path").alias("dst"), "slug", F.lit(True).alias("has")).distinct()
    joined = placed.join(known, ["dst", "slug"], "left")
    return joined.select("path", "target", "dst", "anchor", (F.col("dst") == F.col("path")).alias("same_note"), (F.col("dst").isNotNull() & F.col("has").isNull()).alias("missing"))


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` of resolved links, self-links dropped."""
    return resolved.where("dst is not null and dst <> path").select(F.col("path").alias("src"), "dst").distinct()


def relations(properties: DataFrame, names: DataFrame, plain: tuple[str, ...] = PLAIN_FIELDS) -> DataFrame:
    """Distinct ``src, type, dst`` of front-matter values that name a note."""
    return related(resolve(reference_targets(properties, plain), names))


def reference_targets(properties: DataFrame, plain: tuple[str, ...] = PLAIN_FIELDS) -> DataFrame:
    """``path, type, target`` of front-matter values that may name a note."""
    fields = properties.where(~F.lower("key").isin(*plain))
    refs = fields.select("path", "key", F.explode("values").alias("v")).select("path", "key", F.explode(F.split("v", ",")).alias("v"))
    clean = F.trim(F.regexp_replace(F.trim("v"), r"^\[\[|\]\]$", ""))
    clean = F.regexp_replace(F.regexp_extract(clean, r"^[^|]*", 0), r"\s*\([^()]*\)\s*$", "")
    clean = stem(F.regexp_replace(F.trim(clean), r"""^["']|["']$""", ""))
    return refs.select("path", F.col("key").alias("type"), clean.alias("target")).where("target <> ''")


def related(resolved: DataFrame) -> DataFrame:
    """Distinct ``src, type, dst`` of resolved references, those to the note itself dropped."""
    return resolved.where("dst is not null and dst <> path").select(F.col("path").alias("src"), "type", "dst").distinct()


def references(edges_: DataFrame, relations_: DataFrame) -> DataFrame:
    """``dst, src, via``: body links and relations that point to a note, with their evidence joined."""
    both = edges_.select("dst", "src", F.lit("link").alias("via")).unionByName(relations_.select("dst", "src", F.concat(F.lit("fm:"), "type").alias("via")))
    return both.groupBy("dst", "src").agg(F.array_join(F.array_sort(F.collect_set("via")), ",").alias("via"))


def backlink_listing(edges_: DataFrame, notes: DataFrame) -> DataFrame:
    """``dst, src, label``; sort by lower label for display."""
    labelled = notes.select(F.col("path").alias("src"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), "name").alias("label"))
    return edges_.join(labelled, "src").select("dst", "src", "label", F.row_number().over(W.partitionBy("dst").orderBy(F.lower("label"), "src")).alias("pos"))


def backlink_context(edges_: DataFrame, notes: DataFrame, names: DataFrame, links: DataFrame, lines: DataFrame, radius: int = 60) -> DataFrame:
    """``dst, src, snippet``: each edge's first line with a link to its target, cut around the target's name, title or alias.

    The place is that of the first name, title or alias inside the link, or the link's own.
    """
    aliases = F.col("aliases") if "aliases" in notes.columns else F.array().cast("array<string>")
    terms = notes.select(F.col("path").alias("dst"), F.filter(F.concat(F.array("name", "title"), F.coalesce(aliases, F.array().cast("array<string>"))), lambda t: F.trim(t) != "").alias("terms"))
    at = resolve(links.select("path", "target", "ln", "k"), names).where("dst is not null").groupBy(F.col("path").alias("src"), "dst").agg(F.min_by(F.struct("ln", "target"), F.struct("ln", "k")).alias("at"))
    found = edges_.join(at, ["src", "dst"]).select("src", "dst", "at.ln", "at.target").join(lines.select(F.col("path").alias("src"), "ln", "line"), ["src", "ln"]).join(terms, "dst")
    opens = F.instr("line", F.concat(F.lit("[["), F.col("target")))
    begun = F.when(opens > 0, opens).otherwise(F.instr("line", F.col("target")))  # the link itself, where white space pads it
    rest = F.lower(F.substr("line", F.greatest(begun, F.lit(1))))
    in_link = F.array_min(F.filter(F.transform("terms", lambda t: F.instr(F.substr(rest, F.lit(1), F.char_length("target") + 2), F.lower(t))), lambda x: x > 0))
    return found.select("dst", "src", within(F.col("line"), F.greatest(begun, F.lit(1)) + F.coalesce(in_link, F.lit(1)) - 1, radius).alias("snippet"))


def within(text: Column, at: Column, radius: int) -> Column:
    """Text within ``radius`` of a place, white space as one space, marked where it is cut."""
    begin, end = F.greatest(F.lit(1), at - radius), F.least(F.char_length(text), at + radius)
    cut = F.trim(F.regexp_replace(F.substr(text, begin, end - begin + 1), r"\s+", " "))
    return F.concat(F.when(begin > 1, "…").otherwise(""), cut, F.when(end < F.char_length(text), "…").otherwise(""))


def relation_groups(relations_: DataFrame) -> DataFrame:
    """``src, type, notes``: the targets of a relation type joined in order."""
    return relations_.groupBy("src", "type").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("notes"))


def neighbourhood(edges_: DataFrame, relations_: DataFrame) -> DataFrame:
    """``path, direction, type, n``: outgoing relations, incoming relations and backlinks of each note."""
    out = relations_.select(F.col("src").alias("path"), F.lit("out").alias("direction"), "type")
    into = relations_.select(F.col("dst").alias("path"), F.lit("in").alias("direction"), "type")
    back = edges_.select(F.col("dst").alias("path"), F.lit("link").alias("direction"), F.lit("").alias("type"))
    return out.unionByName(into).unionByName(back).groupBy("path", "direction", "type").agg(F.count("*").alias("n"))


def broken_links(links: DataFrame, names: DataFrame) -> DataFrame:
    """``target, n_sources, first_source``: targets that no name answers, by lower-case name."""
    keyed = target_keys(links).withColumn("spelled", F.trim(F.regexp_extract("target", r"^[^|]*", 0)))
    known = names.select("key").distinct()
    missing = keyed.join(known.withColumnRenamed("key", "whole"), "whole", "left_anti").join(known.withColumnRenamed("key", "bare"), "bare", "left_anti")
    per = missing.groupBy("whole", "path").agg(F.min("spelled").alias("spelled"))
    return per.groupBy(F.col("whole").alias("key")).agg(F.min_by("spelled", F.struct("path", "spelled")).alias("target"), F.count("*").alias("n_sources"), F.min("path").alias("first_source")).drop("key")


def orphans(notes: DataFrame, edges_: DataFrame, relations_: DataFrame) -> DataFrame:
    """``path, outgoing``: notes that no link and no relation points to, and how many notes they point to."""
    pairs = edges_.select("src", "dst").unionByName(relations_.select("src", "dst")).distinct()
    outgoing = pairs.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("outgoing"))
    alone = notes.select("path").join(pairs.select(F.col("dst").alias("path")).distinct(), "path", "left_anti")
    return alone.join(outgoing, "path", "left").select("path", F.coalesce("outgoing", F.lit(0)).cast("long").alias("outgoing"))


def ambiguous_names(names: DataFrame) -> DataFrame:
    """``key, n_candidates, first_path`` of names with two or more notes."""
    return names.groupBy("key").agg(F.count("*").alias("n_candidates"), F.min("path").alias("first_path")).where("n_candidates > 1")


#: Bits of a filter of hashes at most: eight megabytes.  Beyond it lets more through, and the joins behind it do the rest.
FILTER_BITS = 26
#: Tokens by which a name's beginning is known: two are soon found everywhere, the more names there are.
BEGIN = 4
#: Sets hashes of beginnings apart from those of whole names: what one filter lets through by chance, the other doesn't.
SALT = 0x632BE59BD9B4E019


def filter_words(hashes: DataFrame, n: int) -> tuple[int, DataFrame]:
    """Bits of a Bloom filter of three probes of about ``n`` 64-bit hashes (one column), and its words ``id, x`` that aren't zero."""
    bits = max(10, min(FILTER_BITS, (16 * n).bit_length()))
    (column,) = hashes.columns
    set_ = hashes.select(F.explode(F.array(*_probes(F.col(column), bits))).alias("p")).select((F.col("p") / 64).cast("long").alias("id"), F.expr("shiftleft(1L, CAST(p % 64 AS INT))").alias("x"))
    return bits, set_.groupBy("id").agg(F.bit_or("x").alias("x"))


def _probes(h: Column, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(h, k).bitwiseAND((1 << bits) - 1) for k in (0, 20, 40)]


def hash_filter(hashes: DataFrame, n: int) -> Callable[[Column], Column]:
    """A test if a 64-bit hash may be among about ``n`` hashes (one column): a Bloom filter of three probes.

    Its words are an array that a scalar subquery makes once; all that are among them pass.  It is
    an expression of plain columns, no join: rows are dropped where they arise.
    """
    bits, set_ = filter_words(hashes, n)
    dense = hashes.sparkSession.range(1 << (bits - 6)).join(set_, "id", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("x", F.lit(0)).alias("x")))), lambda w: w["x"]).alias("words"))
    words = dense.scalar()
    on = lambda p: F.getbit(F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1
    return lambda h: reduce(lambda a, b: a & b, [on(p) for p in _probes(h, bits)])


def _filter_array(hashes: DataFrame, n: int) -> np.ndarray:
    """The words of such a filter as an array, for Python workers: eight megabytes at most."""
    bits, set_ = filter_words(hashes, n)
    found, out = set_.toArrow(), np.zeros(1 << (bits - 6), np.int64)
    out[found["id"].to_numpy()] = found["x"].to_numpy()
    return out.view(np.uint64)


def _prose(lines: DataFrame) -> DataFrame:
    return lines.where("in_body and not in_code and not line like '# %'")


def mentioned(lines: DataFrame, names: DataFrame, edges_: DataFrame, relations_: DataFrame) -> DataFrame:
    """``dst, src, n, first_ln``: unambiguous names in prose that aren't links.

    Prose is cut into tokens, many lines at a time.  A window of as many tokens as a name has leaves
    its row if two filters let it through: of all names' beginnings (their first ``BEGIN`` tokens, or
    all they have), and of whole names.  Those that are left meet the names by equality.  Of
    overlapping matches the leftmost wins, then the longest, found by a fold over a line's matches.
    """
    spark = lines.sparkSession
    wanted = names.where("n_candidates = 1 and char_length(key) >= 3").select(F.regexp_extract_all("key", F.lit(windows.TOKEN), F.lit(0)).alias("w"), F.col("path").alias("dst")).where("size(w) > 0")
    kinds = spark.sparkContext.broadcast(windows.kinds(spark))  # a megabyte

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, part in windows.parts(batch["name"].to_pylist()):
                t = windows.Tokens(part, kinds.value)
                n = np.diff(t.first)
                hashes = (t.hashes(t.first[:-1], n), t.hashes(t.first[:-1], np.minimum(n, BEGIN), SALT))
                yield pa.record_batch([*batch.slice(k, len(part)).columns, pa.array(n, pa.int32()), *[pa.array(h.view(np.int64)) for h in hashes]], names=["name", "dst", "n", "whole", "begin"])

    wanted = set_down(wanted.select(F.array_join("w", " ").alias("name"), "dst").mapInArrow(hashed, "name string, dst string, n int, whole long, begin long"), "wanted-names")
    n_names, lengths = wanted.agg(F.count("*"), F.sort_array(F.collect_set("n"))).first()  # as many lengths as the longest name has tokens
    named, begun = (spark.sparkContext.broadcast(_filter_array(wanted.select(c), n_names)) for c in ("whole", "begin"))  # of bounded size

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, part in windows.parts(batch["prose"].to_pylist()):
                t = windows.Tokens(part, kinds.value)
                every = np.arange(len(t.row))
                for size, longer in groupby(lengths, lambda n: min(n, BEGIN)):
                    likely = t.within(every, size)
                    likely = likely[windows.may_hold(begun.value, t.hashes(likely, size, SALT))]
                    for n in longer:
                        at = t.within(likely, n)
                        at = at[windows.may_hold(named.value, t.hashes(at, n))]
                        if len(at):
                            own = batch.select(["path", "ln"]).take(pa.array(k + t.row[at]))
                            i = pa.array(at - t.first[t.row[at]] + 1, pa.int32())
                            yield pa.record_batch([*own.columns, i, pa.repeat(pa.scalar(n, pa.int32()), len(at)), pa.array([t.joined(x, n) for x in at.tolist()], pa.string())], names=["path", "ln", "i", "n", "name"])

    masked = F.regexp_replace(F.regexp_replace("line", r"`[^`]*`", " ¦ "), r"!?\[\[[^\[\]]*\]\]|\[[^\[\]]*\]\([^()]*\)", " ¦ ")
    masked = F.when(F.contains("line", F.lit("`")) | F.contains("line", F.lit("[")), masked).otherwise(F.col("line"))
    places = short_batches(_prose(lines).where("line <> ''").select("path", F.col("ln").cast("int").alias("ln"), F.lower(masked).alias("prose"))).mapInArrow(found, "path string, ln int, i int, n int, name string")
    hits = places.join(wanted.select("name", "dst"), "name")
    per_line = hits.groupBy("path", "ln").agg(F.array_sort(F.collect_list(F.struct("i", (-F.col("n")).alias("neg"), "dst"))).alias("hits"))
    taken = F.aggregate(
        "hits", F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("got")),
        lambda acc, h: F.when(h["i"] > acc["end"], F.struct((h["i"] - h["neg"] - 1).alias("end"), F.concat(acc["got"], F.array(h["dst"])).alias("got"))).otherwise(acc), lambda acc: acc["got"],
    )
    mentions = per_line.select(F.col("path").alias("src"), "ln", F.explode(taken).alias("dst")).where("src <> dst")
    linked = edges_.select("src", "dst").unionByName(relations_.select("src", "dst")).distinct()
    free = set_down(mentions.join(linked, ["src", "dst"], "left_anti").groupBy("dst", "src").agg(F.count("*").alias("n"), F.min("ln").alias("first_ln")), "mentions")
    for sent in (kinds, named, begun):  # what is written needs them no more
        sent.destroy()
    return free


def unlinked_mentions(notes: DataFrame, lines: DataFrame, names: DataFrame, edges_: DataFrame, relations_: DataFrame) -> DataFrame:
    """``dst, src, n, first_ln, preview`` of ``mentioned``, with the beginning of the first line that holds the name."""
    # a written table: where it is small enough to be broadcast, the prose is read again without a shuffle
    free = mentioned(lines, names, edges_, relations_)
    shown = _prose(lines).select(F.col("path").alias("src"), F.col("ln").alias("first_ln"), F.substr(F.trim("line"), F.lit(1), F.lit(120)).alias("preview"))
    return free.join(shown, ["src", "first_ln"]).select("dst", "src", "n", "first_ln", "preview")


def sections(headings: DataFrame) -> DataFrame:
    """``path, slug, begin, end``: a heading's lines up to the next heading of its level or a higher one, null where none follows."""
    all_ = headings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ln", "level", "slug"))).alias("h"))  # the headings of one note
    later = lambda x: F.array_min(F.transform(F.filter("h", lambda y: (y["ln"] > x["ln"]) & (y["level"] <= x["level"])), lambda y: y["ln"]))
    cut = all_.select("path", F.explode(F.transform("h", lambda x: F.struct(x["slug"].alias("slug"), x["ln"].alias("begin"), later(x).alias("end")))).alias("s"))
    return cut.groupBy("path", "s.slug").agg(F.min(F.struct("s.begin", "s.end")).alias("s")).select("path", "slug", "s.begin", "s.end")


def filled_embeds(embedded: DataFrame, names: DataFrame, headings: DataFrame, depth: int = 3) -> DataFrame:
    """``root, chain, ln, path, anchor, begin, end, level, failure`` of every embed that a note shows, ``depth`` levels deep.

    Of ``embedded(path, ln, target, anchor)`` those within the shown lines are followed: of a
    section, or of a whole note (begin and end are null).  chain: the notes around the place, its
    own root not among them; ln: the place in the last of them, or in the root.  failure, in this
    order: unresolved, cycle, too-deep or no-section; null where something is shown.  Without a
    target it is a section of the note itself.  A level is a join, and a written table.
    """
    label = F.when(F.col("anchor") == "", F.col("target")).otherwise(F.concat("target", F.lit("#"), F.col("anchor")))
    asked = embedded.select("path", "ln", F.trim("target").alias("own"), "anchor", label.alias("target"))
    found = resolve(asked.select("path", "target").distinct(), names).select("path", "target", "dst")
    placed = asked.join(found, ["path", "target"], "left").select(F.col("path").alias("src"), "ln", "anchor", F.when(F.col("own") == "", F.col("path")).otherwise(F.col("dst")).alias("dst"), slugify("anchor").alias("slug"))
    cut = sections(headings).select(F.col("path").alias("dst"), "slug", "begin", "end", F.lit(True).alias("has"))
    step = placed.withColumn("slug", F.when(F.col("anchor") != "", F.col("slug"))).join(cut, ["dst", "slug"], "left")
    step = set_down(step.select("src", "ln", "dst", "anchor", "begin", "end", ((F.col("anchor") != "") & F.col("has").isNull()).alias("no_section")), "embeds")
    level = step.withColumns({"root": F.col("src"), "chain": F.array().cast("array<string>")})
    out = None
    for k in range(1, depth + 2):
        failure = F.when(F.col("dst").isNull(), "unresolved").when(F.array_contains("chain", F.col("dst")), "cycle").when(F.lit(k > depth), "too-deep").when(F.col("no_section"), "no-section")
        shown = set_down(level.select("root", "chain", "ln", F.col("dst").alias("path"), "anchor", "begin", "end", F.lit(k).alias("level"), failure.alias("failure")), f"embeds-{k}")
        out = shown if out is None else out.unionByName(shown)
        if k <= depth:
            around = shown.where("failure is null").select("root", F.concat("chain", F.array("path")).alias("chain"), F.col("path").alias("src"), F.col("begin").alias("from"), F.col("end").alias("to"))
            level = around.join(step, "src").where("(from is null or ln >= from) and (to is null or ln < to)").drop("from", "to")
    return out


def shown_texts(filled: DataFrame, lines: DataFrame) -> DataFrame:
    """``path, begin, end, text`` of the distinct pieces that embeds show: whole lines of the body, white space at the end cut."""
    pieces = filled.where("failure is null").select("path", "begin", "end").distinct()
    wanted = lines.where("in_body").join(pieces.select("path").distinct(), "path", "left_semi")
    bodies = wanted.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("b"))  # the lines of one note
    part = F.filter("b", lambda x: (F.col("begin").isNull() | (x["ln"] >= F.col("begin"))) & (F.col("end").isNull() | (x["ln"] < F.col("end"))))
    return pieces.join(bodies, "path").select("path", "begin", "end", F.regexp_replace(F.array_join(F.transform(part, lambda x: x["line"]), "\n"), r"\s+$", "").alias("text"))
