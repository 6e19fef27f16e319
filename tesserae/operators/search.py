"""Full-text search: index tables, BM25+ scores, expansion, the combination ladder, snippets, grep."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import CONSONANTS, FRONT_AND_END, consonants, fuzzy_score, nfc, note_tokens
from ..sources.shared import set_down, short_batches

if TYPE_CHECKING:
    from ..sources.keptindex import KeptIndex

K, B, D = 1.2, 0.3, 0.5
BOOST = {"name": 3.0, "title": 1.0, "body": 1.0}
#: Words up to which "all but one" is tried.
ALL_BUT_ONE = 8
LEAST_SHARE = 0.6
#: Bytes of tokens that are counted together at most, but for one long note.
SEGMENT_BYTES = 32 << 20


SEGMENT = "term string, field string, paths array<string>, lens array<int>, tfs array<int>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each slice of ``path, field, tokens`` with the notes that have them."""
    for whole in batches:
        step = max(1, int(whole.num_rows * SEGMENT_BYTES / max(1, whole.nbytes)))
        for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
            paths, fields, tokens = batch.columns
            fields, terms = fields.dictionary_encode(), tokens.flatten().dictionary_encode()
            row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(row):
                continue
            k, n_rows = len(terms.dictionary), batch.num_rows
            field = fields.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            key, tf = np.unique((field[row] * k + terms.indices.to_numpy(zero_copy_only=False)) * n_rows + row, return_counts=True)
            group, at = np.divmod(key, n_rows)
            begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            bounds = pa.array(np.r_[begins, len(key)].astype(np.int32))
            lens = np.bincount(at, minlength=n_rows)[at].astype(np.int32)
            lists = [pa.ListArray.from_arrays(bounds, x) for x in (paths.take(pa.array(at)), pa.array(lens), pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(group[begins] % k)), fields.dictionary.take(pa.array(group[begins] // k)), *lists], names=["term", "field", "paths", "lens", "tfs"])


def segments(notes: DataFrame) -> DataFrame:
    """``term, field, paths, lens, tfs``: the postings of a few notes at a time, as many as an Arrow batch has; nothing is shuffled."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("text")) for f, c in (("name", "name"), ("title", "title"), ("body", "text"))])
    tokens = notes.select("path", F.explode(fields).alias("f")).select("path", "f.field", note_tokens("f.text").alias("t"))
    return short_batches(tokens).mapInArrow(_segments, SEGMENT)


def postings_of(segments_: DataFrame) -> DataFrame:
    """``term, field, path, len, tf`` of segments."""
    rows = segments_.select("term", "field", F.explode(F.arrays_zip("paths", "lens", "tfs")).alias("p"))
    return rows.select("term", "field", F.col("p.paths").alias("path"), F.col("p.lens").cast("long").alias("len"), F.col("p.tfs").cast("long").alias("tf"))


def postings(notes: DataFrame) -> DataFrame:
    """``term, field, path, len, tf``: len is the number of distinct terms of the field in the note.

    A note's tokens are counted where its row is; nothing is shuffled.
    """
    return postings_of(segments(notes))


def note_terms(notes: DataFrame) -> DataFrame:
    """``path, field, terms``: the distinct terms of each field of a note, within its row."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(c), F.lit("")).alias("text")) for f, c in (("name", "name"), ("title", "title"), ("body", "text"))])
    return notes.select("path", F.explode(fields).alias("f")).select("path", "f.field", F.array_distinct(note_tokens("f.text")).alias("terms")).where("size(terms) > 0")


def field_lengths(notes: DataFrame) -> DataFrame:
    """``field, avg_len, n_docs`` over all notes."""
    return lengths_of(postings(notes), notes.count())


def lengths_of(posted: DataFrame, n_docs: int) -> DataFrame:
    """``field, avg_len, n_docs``; a note without a term in a field has length 0 there."""
    per = posted.groupBy("field").agg((F.count("*") / F.lit(n_docs)).alias("avg_len"))
    return per.withColumn("n_docs", F.lit(n_docs).cast("long"))


def vocabulary(posted: DataFrame) -> DataFrame:
    """``term, field, df``."""
    return posted.groupBy("term", "field").agg(F.count("*").alias("df"))


def query_words(queries: DataFrame) -> DataFrame:
    """``qid, word, n_words`` of ``queries(qid, query)``; distinct words."""
    words = queries.select("qid", F.array_distinct(note_tokens("query")).alias("w"))
    return words.select("qid", F.explode("w").alias("word"), F.size("w").alias("n_words"))


def expand(words: DataFrame, vocab: DataFrame, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """``qid, word, n_words, term, weight``: exact terms, terms the word begins, and terms within the edit distance.

    Candidates meet by keys: a term's prefixes for the first, and for the second a term and a
    word with one run of letters left out at each of few places, so that no word meets the
    whole vocabulary.  The weight falls with the surplus length and with the distance.
    """
    terms = vocab.select("term").distinct()
    exact = words.join(terms.withColumnRenamed("term", "word"), "word").select("qid", "word", "n_words", F.col("word").alias("term"), F.lit(1.0).alias("weight"))
    out = exact
    if prefix:
        heads = terms.where("char_length(term) > 3").select("term", F.explode(F.transform(F.sequence(F.lit(3), F.char_length("term") - 1), lambda i: F.substr(F.col("term"), F.lit(1), i))).alias("word"))
        begun = words.where("char_length(word) > 2").join(heads, "word")
        surplus = F.char_length("term") - F.char_length("word")
        out = out.unionByName(begun.select("qid", "word", "n_words", "term", (0.375 * F.char_length("term") / (F.char_length("term") + 0.3 * surplus)).alias("weight")))
    if fuzzy:
        # within distance d one of d + 1 equal parts of the word stays whole in the term, moved by at most d
        most = F.least(F.lit(3), F.round(F.char_length("word") * 0.15).cast("int"))
        asked = words.where("char_length(word) > 3").withColumn("most", most).where("most > 0")
        n = F.char_length("word")
        cut = F.transform(F.sequence(F.lit(0), F.col("most")), lambda i: F.struct(F.floor(i * n / (F.col("most") + 1)).cast("int").alias("a"), (F.floor((i + 1) * n / (F.col("most") + 1)) - F.floor(i * n / (F.col("most") + 1))).cast("int").alias("l")))
        parts = asked.select("qid", "word", "n_words", "most", F.explode(cut).alias("c")).select("qid", "word", "n_words", "most", "c.a", F.substr(F.col("word"), F.col("c.a") + 1, F.col("c.l")).alias("part"))
        sizes = parts.select(F.char_length("part").alias("l")).distinct()
        shifted = terms.join(F.broadcast(sizes), F.char_length("term") >= F.col("l")).select("term", F.explode(F.transform(F.sequence(F.lit(0), F.char_length("term") - F.col("l")), lambda i: F.struct(i.alias("at"), F.substr(F.col("term"), i + 1, F.col("l")).alias("part")))).alias("s")).select("term", "s.at", "s.part")
        near = parts.join(shifted, "part").where("abs(at - a) <= most and term <> word and abs(char_length(term) - char_length(word)) <= most").select("qid", "word", "n_words", "most", "term").distinct()
        distance = F.levenshtein("word", "term")
        near = near.withColumn("d", distance).where("d <= most").where(~F.col("term").startswith(F.col("word"))) if prefix else near.withColumn("d", distance).where("d <= most")
        out = out.unionByName(near.select("qid", "word", "n_words", "term", (0.45 * F.char_length("term") / (F.char_length("term") + F.col("d"))).alias("weight")))
    return out


#: Terms of all queries together, and queries, up to which they are broadcast; pairs of note and query that a task adds up at most, about.
FEW_TERMS, TASK_PAIRS = 200_000, 1_000_000


def scored_notes(asked: DataFrame, posted: DataFrame, lengths: DataFrame, vocab: DataFrame | None = None, n_docs: int = 0, exact: bool = False) -> DataFrame:
    """``qid, path, n_words, sum, words, terms``: BM25+ of a note over the terms of a query, and how many words and terms it has.

    A note's terms are brought together once, whatever the number of queries; what the queries make
    of them is added up at the same place, so that pairs of note and query are never shuffled.
    Document frequencies are those of ``vocab``, or counted from the postings.  exact: a word's only
    term is itself.
    """
    n_asked, n_queries = asked.agg(F.count("*"), F.count_distinct("qid")).first()
    few = F.broadcast if n_asked <= FEW_TERMS else lambda df: df
    terms = asked.select("term").distinct()
    vocab = vocabulary(posted.join(few(terms), "term", "left_semi")) if vocab is None else vocab
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    boost = F.lit(1.0)
    for field, b in BOOST.items():
        boost = F.when(F.col("field") == field, b).otherwise(boost)
    # lengths has one row a field; a term's score in a note is the same for all queries
    known = vocab.join(terms, "term", "left_semi").join(F.broadcast(lengths), "field").select("term", "field", (boost * idf).alias("most"), "avg_len")
    part = F.col("most") * (D + F.col("tf") * (K + 1) / (F.col("tf") + K * (1 - B + B * F.col("len") / F.col("avg_len"))))
    hits = posted.join(few(known), ["term", "field"]).select("term", "path", part.alias("part"))
    parts = max(int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_docs * n_queries // TASK_PAIRS))
    own = hits.repartition(parts, "path").groupBy("path", "term").agg(F.sum("part").alias("own"))
    score = F.sum(F.col("weight") * F.col("own"))
    if exact:
        return own.join(few(asked), "term").groupBy("qid", "path", "n_words").agg(score.alias("sum"), F.count("*").alias("words"), F.count("*").alias("terms"))
    once = asked.withColumn("once", (F.row_number().over(W.partitionBy("qid", "term").orderBy("word")) == 1).cast("long"))  # a term that several words ask for counts once
    words = own.join(few(once), "term").groupBy("qid", "path", "n_words", "word").agg(score.alias("s"), F.sum("once").alias("t"))
    return words.groupBy("qid", "path", "n_words").agg(F.sum("s").alias("sum"), F.count("*").alias("words"), F.sum("t").alias("terms"))


def staged(scored: DataFrame) -> DataFrame:
    """Scored notes with ``stage`` and ``total``: the sum over its terms times the number of query words it matches."""
    need = F.greatest(F.lit(1), F.ceil(F.col("n_words") * LEAST_SHARE))
    stage = (
        F.when(F.col("words") == F.col("n_words"), 0).when(F.col("n_words").between(3, ALL_BUT_ONE) & (F.col("words") == F.col("n_words") - 1), 1).when(F.col("terms") >= need, 2).otherwise(3)
    )
    return scored.select("qid", "path", "terms", stage.alias("stage"), (F.col("sum") * F.col("words")).alias("total"))


def first_stage(found: DataFrame) -> DataFrame:
    """``qid, stage, top``: the first stage of and, all-but-one, most words, any that has a hit, and its highest total."""
    best = found.groupBy("qid").agg(F.max(F.struct((-F.col("stage")).alias("s"), F.col("total").alias("top"))).alias("t"))  # combined before the shuffle
    return best.select("qid", (-F.col("t.s")).alias("stage"), "t.top")


def ladder(found: DataFrame, first: DataFrame) -> DataFrame:
    """``qid, path, stage, score, matched, rel`` of the notes at their query's first stage; ``first`` has a row a query."""
    kept = found.join(first, ["qid", "stage"])
    rel = F.when(F.col("top") > 0, F.col("total") / F.col("top")).otherwise(0.0)
    names = F.element_at(F.array(*[F.lit(x) for x in ("and", "and-1", "or-min", "or")]), F.col("stage") + 1)
    return kept.select("qid", "path", names.alias("stage"), F.round("total", 4).alias("score"), F.col("terms").alias("matched"), F.round(rel, 4).alias("rel"))


#: Parts into which a query's hits are dealt before the first ones are ranked, where Spark doesn't cut them in each task by itself.
RANK_PARTS, GROUP_LIMIT = 32, 1000


def _found(queries: DataFrame, posted: DataFrame | KeptIndex, lengths: DataFrame | None, prefix: bool, fuzzy: bool) -> DataFrame:
    words = query_words(queries)
    exact = not prefix and not fuzzy
    if isinstance(posted, DataFrame):
        return staged(scored_notes(set_down(expand(words, vocabulary(posted), prefix, fuzzy), "query-terms"), posted, lengths, exact=exact))
    asked = posted.asked(words, prefix, fuzzy)
    return staged(scored_notes(asked, posted.postings(asked), posted.lengths(), posted.vocabulary(asked), posted.n_docs(), exact))


def search(queries: DataFrame, posted: DataFrame | KeptIndex, lengths: DataFrame | None = None, limit: int = 10, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """Ranked hits of many queries at once; limit 0 keeps all.  Ties go to the smaller path.

    Of a kept index only the postings of the queries' terms are read.  With a limit, a query's
    hits are cut in each task before they are ranked, so that no task sorts all of them.
    """
    found = _found(queries, posted, lengths, prefix, fuzzy)
    hits = ladder(found, set_down(first_stage(found), "first-stages"))
    order = [F.desc("score"), "path"]
    if limit > GROUP_LIMIT:
        part = F.pmod(F.xxhash64("path"), F.lit(RANK_PARTS))
        hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("qid", part).orderBy(*order))).where(F.col("rank") <= limit).drop("rank")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(*order)))
    return ranked.where(F.col("rank") <= limit) if limit > 0 else ranked


def standings(queries: DataFrame, posted: DataFrame | KeptIndex, lengths: DataFrame | None = None, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """``qid, stage, matched, rank`` of ``queries(qid, query, target)``: how many hits a query has, and the target's rank among them (null: none).

    As ``search`` without a limit would rank them, but hits are counted where they are and never sorted.
    """
    found = _found(queries, posted, lengths, prefix, fuzzy)
    first = set_down(first_stage(found), "first-stages")
    hits = ladder(found, first).select("qid", "path", "stage", "score")
    wanted = queries.select("qid", F.col("target").alias("path"))
    own = set_down(hits.join(F.broadcast(queries.select(F.col("target").alias("path")).distinct()), "path", "left_semi").join(wanted, ["qid", "path"]).select("qid", F.col("path").alias("target"), F.col("score").alias("own")), "targets")
    ahead = F.count_if((F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("path") < F.col("target"))))
    counted = hits.join(F.broadcast(own), "qid", "left").groupBy("qid").agg(F.first("stage").alias("stage"), F.count("*").alias("matched"), F.max("own").alias("own"), ahead.alias("ahead"))
    return counted.select("qid", "stage", "matched", F.when(F.col("own").isNotNull(), (F.col("ahead") + 1).cast("int")).alias("rank"))


def best_line(raw: Column, terms: list[str]) -> Column:
    """The line with the most distinct terms (the first of equals), list marks cut, at most 180 characters."""
    body = F.regexp_replace(raw, r"^---[ \t]*\n[\s\S]*?\n---[ \t]*(\n|$)", "")
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    words = [t.lower() for t in dict.fromkeys(terms) if len(t) >= 2]
    hits = lambda x: sum((F.when(F.lower(x).contains(t), 1).otherwise(0) for t in words), F.lit(0))
    ranked = F.array_sort(F.transform(lines, lambda x, i: F.struct((-hits(x)).alias("h"), i.alias("i"), x.alias("line"))))
    line = F.regexp_replace(F.get(ranked, F.lit(0))["line"], r"^[#>\-*\s]+", "")
    return F.when(F.char_length(line) > 180, F.concat(F.substr(line, F.lit(1), F.lit(180)), F.lit("…"))).otherwise(F.coalesce(line, F.lit("")))


def _near(text: Column, terms: Column, radius: int) -> Column:
    """Up to 2 x ``radius`` characters about the first of the lower-case terms, white space as one space; null if none is there."""
    low = F.lower(text)
    at = F.array_min(F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda x: x > 0))
    begin, end = F.greatest(F.lit(1), at - radius), F.least(F.char_length(text), at + radius - 1)
    cut = F.trim(F.regexp_replace(F.substr(text, begin, end - begin + 1), r"\s+", " "))
    return F.when(at.isNotNull(), F.concat(F.when(begin > 1, "…").otherwise(""), cut, F.when(end < F.char_length(text), "…").otherwise("")))


def _begin(text: Column, chars: int) -> Column:
    return F.trim(F.regexp_replace(F.substr(text, F.lit(1), F.lit(chars)), r"\s+", " "))


def around(text: Column, terms: list[str], radius: int = 60) -> Column:
    """Text within ``radius`` of the first term found, white space as one space; the first 120 characters if none is."""
    return F.coalesce(_near(text, F.array(*[F.lit(t.lower()) for t in terms]), radius), _begin(text, 120))


def snippet_for_query(raw: Column, query: str, radius: int = 60) -> Column:
    """The snippet of a result: about the first of the query's words in the note's body, as they stand; else about the
    first of its search tokens (parts between marks, pairs of Hangul syllables); else the body's beginning.

    Front matter is no body.  A blank query, or one of which nothing is there, gives the beginning.
    """
    words, whole = [w for w in query.lower().split() if w], nfc(query)
    body = F.regexp_replace(raw, FRONT_AND_END, "")
    found = [_near(body, F.array(*[F.lit(w) for w in words]), radius), _near(body, note_tokens(F.lit(whole)), radius)] if words else []
    return F.coalesce(*found, F.concat(_begin(body, 2 * radius), F.lit("…")))


def grep(lines: DataFrame, pattern: str, regex: bool = False, case: bool = False, word: bool = False, limit: int = 200) -> DataFrame:
    """``path, line, text, col, len, clipped``: the first match of every line, exact under the limit.

    Long lines are cut to 300 characters from 60 before the match; col counts UTF-16 units.
    """
    import re

    body = pattern if regex else re.escape(pattern)
    body = rf"\b(?:{body})\b" if word else body
    java = body if case else f"(?i){body}"
    found = lines.where(F.col("line").contains(pattern)) if not regex and case and not word else lines.where(F.col("line").rlike(java))
    flags = "(?s)" if case else "(?si)"
    at = F.char_length(F.regexp_extract("line", rf"{flags}^(.*?)(?:{body})", 1)) + 1  # in code points, unlike regexp_instr
    match = F.regexp_extract("line", java, 0)
    start = F.when(F.char_length("line") > 300, F.greatest(F.lit(1), at - 60)).otherwise(1)
    shown = F.substr(F.col("line"), start, F.lit(300))
    utf16 = lambda c: F.char_length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    before = F.substr(F.col("line"), start, at - start)
    most = max(1, min(2000, limit))
    hits = found.select("path", (F.col("ln") + 1).alias("line"), shown.alias("text"), utf16(before).alias("col"), utf16(match).alias("len"), (F.char_length("line") > 300).alias("clipped"))
    return hits.orderBy("path", "line").limit(most)


def quick_entries(notes: DataFrame) -> DataFrame:
    """``path, label, key``: distinct names a note can be opened by."""
    keys = F.array_distinct(F.filter(F.array(F.lower("name"), F.lower(F.trim("title"))), lambda k: k.isNotNull() & (k != "")))
    return notes.select("path", F.coalesce(F.nullif(F.trim("title"), F.lit("")), "name").alias("label"), F.explode(keys).alias("key"))


def quick_search(entries: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """``path, score``: the best key of each entry by fuzzy score; an empty query gives the first entries.

    A query of leading consonants alone is held against the keys' consonants, with and then without their spaces.
    """
    q = query.strip().lower()
    score = fuzzy_score(q, "key")
    if q and not set(q) - set(CONSONANTS) - {" "}:
        folded = consonants("key")
        score = F.coalesce(fuzzy_score(q, folded), fuzzy_score(q, F.regexp_replace(folded, r"\s+", "")))
    scored = entries.withColumn("score", score).where("score is not null")
    return scored.groupBy("path").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "path").limit(limit)


def link_completion(notes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """``path, score``: 2 for a name that begins with the query, 1 for one that holds it."""
    q = query.lower()
    best = quick_entries(notes).groupBy("path").agg(F.max(F.when(F.col("key").startswith(q), 2).when(F.col("key").contains(q), 1)).alias("score")).where("score is not null")
    return best.orderBy(F.desc("score"), "path").limit(limit)


def unified(files: DataFrame, content: DataFrame, tags: DataFrame, facets: DataFrame, limit: int = 30) -> DataFrame:
    """``kind, path, score`` of files, content hits, tags and facets; a note once, with its best score."""
    rows = files.select(F.lit("file").alias("kind"), "path", F.col("score").cast("double").alias("score")).unionByName(content.select(F.lit("content").alias("kind"), "path", (F.col("score") * 60).alias("score")))
    rows = rows.unionByName(tags.select(F.lit("tag").alias("kind"), "path", (F.col("score") * 0.85).alias("score"))).unionByName(facets.select(F.lit("facet").alias("kind"), "path", F.lit(700.0).alias("score")))
    best = rows.groupBy("path").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
    return best.select("kind", "path", "score").orderBy(F.desc("score"), "path").limit(limit)
