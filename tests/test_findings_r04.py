"""What the findings of the fourth round were about, on small cases."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae import queries as Q
from tesserae.functions import windows
from tesserae.operators import extract, graph

ODD = ["", " ", "a", "_a-b c.d", "don't  stop here", "가나 다　라", "é é", "\U0001d400\U0001d401 x\U0001f600y", "i̇ ς", "\x00\x85﻿‍", "tab\tand\x0bvt\r", "¼²Ⅷ a1_", "x" * 300, "a a a a a", "\U0010ffff͸", "١٢ ab"]


def test_tokens_are_those_of_the_pattern(spark):
    """Cut many texts at a time, as Spark's pattern cuts each; windows have one hash if, and only if, their tokens are the same."""
    rows = spark.createDataFrame(list(enumerate(ODD * 3)), "k int, t string").select("k", F.regexp_extract_all("t", F.lit(windows.TOKEN), F.lit(0)).alias("w")).collect()
    want = [list(r.w) for r in sorted(rows)]
    t = windows.Tokens(ODD * 3, windows.kinds(spark))
    assert [[t.joined(x, 1) for x in range(t.first[k], t.first[k + 1])] for k in range(len(want))] == want
    for n in (1, 2, 3, 5):
        at = t.within(np.arange(len(t.row)), n)
        spelled = [(int(h), tuple(want[t.row[x]][x - t.first[t.row[x]] : x - t.first[t.row[x]] + n])) for x, h in zip(at.tolist(), t.hashes(at, n))]
        assert len(at) == sum(max(0, len(w) - n + 1) for w in want) and len({h for h, _ in spelled}) == len({w for _, w in spelled}) == len(set(spelled))
    assert [(k, len(p)) for k, p in windows.parts(["x" * windows.PART, "", "y", "z" * windows.PART])] == [(0, 1), (1, 2), (3, 1)]


def test_names_of_many_lengths_in_long_lines(spark):
    """Names that begin alike, in every length, where every fourth place of long lines may begin one."""
    words = ["ga", "bu", "zo", "meu"]
    names = spark.createDataFrame([(" ".join((words * 20)[:n]) + f" end{n}", f"n{n}.md", 1) for n in range(4, 44)], "key string, path string, n_candidates long")
    texts = spark.range(48, numPartitions=4).selectExpr("concat('t', id, '.md') AS path", f"concat(repeat('{' '.join(words)} ', 10000), 'end', id, '\\nother') AS raw")
    none = spark.createDataFrame([], "src string, dst string")
    got = {tuple(r) for r in graph.mentioned(extract.line_table(texts), names, none, none).collect()}
    assert got == {(f"n{n}.md", f"t{n}.md", 1, 0) for n in range(4, 44, 4)}


def test_windows_of_any_length_cost_the_same():
    """A million tokens and all their windows of 40 lengths: sums are subtracted, no window is read anew."""
    kinds = np.where(np.arange(0x110000) == 32, windows.SPACE, windows.WORD).astype(np.uint8)
    kinds[10] = windows.SPACE
    begun = time.process_time()
    t = windows.Tokens(["ga bu zo meu " * 25_000] * 10, kinds)
    for n in range(1, 4_000, 100):
        at = t.within(np.arange(len(t.row)), n)
        assert len(set(t.hashes(at, n)[: 1000].tolist())) == 4
    assert time.process_time() - begun < 30


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("named")
    docs = [(k, f"The title of {k % 31}\nsays doc-{k + 7}, and The Title of {(k + 3) % 31}.\n- [ ] own", "en", f"src{k % 3}", 60) for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(0, 30, 3)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_mentions_without_previews_read_prose_once(spark, folder):
    """What is counted is a table that was set down; only who asks for previews has the prose read again."""
    found = Q.FOUND["grf13_note_mentions"][0](spark, folder)
    assert found.count() and not any("documents.parquet" in f for f in found.inputFiles())


def test_the_doctor_reads_no_texts_for_its_mentions(spark, folder):
    """Mentions are counted from a table, and the total from the counts: no check is in the plan twice."""
    found = Q.FOUND["aud6_doctor_mentions"][0](spark, folder)
    assert not any("documents.parquet" in f or "labels.parquet" in f for f in found.inputFiles())
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    n = {r.check: r.n for r in found.collect()}["mentions"]
    assert n == Q.FOUND["grf13_note_mentions"][0](spark, folder).select("dst").distinct().count() > 0
