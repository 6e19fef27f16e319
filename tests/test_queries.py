"""Registered corpus queries against their DuckDB twins."""

from collections import defaultdict
from decimal import Decimal

import duckdb
import pytest
import regex

from tesserae import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_its_twin(spark, sf, duck, name):
    f, sql = Q.FOUND[name]
    df = f(spark, sf)
    cols = sorted(df.columns)
    twin = duck.sql(sql)
    at = [list(twin.columns).index(c) for c in cols]
    rounded = lambda v: round(v, 4) if isinstance(v, (float, Decimal)) else v
    assert sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=str) == sorted((tuple(rounded(r[k]) for k in at) for r in twin.fetchall()), key=str)
    assert len(cols) == len(twin.columns)


def test_mentions_equal_brute_force(spark, sf, duck):
    got = {(r.dst, r.src): (r.n, r.first_ln) for r in Q.FOUND["grf13_mentions"][0](spark, sf).collect()}
    _, _, edges, relations = Q.graph_of(spark, sf)
    linked = {tuple(r) for r in edges.select("src", "dst").union(relations.select("src", "dst")).collect()}
    texts = duck.sql(f"WITH {Q.NOTES_SQL} SELECT path, text FROM notes").fetchall()
    named = defaultdict(list)
    for path, text in texts:
        words = regex.split(r"[ \t-\r]+", regex.sub(r"[^\p{L}\p{N}_\s]", "", text))
        if len(words) > 1 and len(words[1]) >= 6:
            named[words[1].lower()].append(path)
    want = {}
    for path, text in texts:
        code = False
        for ln, line in enumerate(text.split("\n")):
            if regex.match(r"\s{0,3}(```|~~~)", line):
                code = not code
            elif not code and not line.startswith("# "):
                bare = regex.sub(r"`[^`]*`|!?\[\[[^\[\]]*\]\]|\[[^\[\]]*\]\([^()]*\)", " ¦ ", line)
                for token in regex.findall(r"[\p{L}\p{N}_]+", bare.lower()):
                    of = named.get(token, [])
                    if len(of) == 1 and of[0] != path and (path, of[0]) not in linked:
                        n, first = want.get((of[0], path), (0, ln))
                        want[of[0], path] = (n + 1, first)
    assert want and got == want


def test_the_names_are_whole(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_snippets_and_fuzzy_expansion_push_down(spark, sf):
    plan = Q.notes(spark, sf).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema: ")[1].split(">")[0]


def test_line_table_and_index_shuffle_nothing(spark, sf):
    from tesserae.operators import extract, search

    n = Q.notes(spark, sf)
    plain = n.drop("status").select("path", "raw", "name", "title", "text")
    lines = extract.line_table(spark.createDataFrame([], plain.schema).select("path", "raw"))
    posted = search.postings(spark.createDataFrame([], plain.schema))
    for df in (lines, posted):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_measures_equal_brute_force(spark, sf):
    """Ranks of the evaluation's cases, counted in Python from the ranked hits of all of them."""
    from tesserae.operators import evaluate, search

    n = Q.notes(spark, sf)
    plain = evaluate.cases(evaluate.sample(n, 120, 12345)).collect()
    assert {r.kind for r in plain} == {"title", "middle", "prose"}
    got = {r.kind: r for r in Q.FOUND["evl4_measures"][0](spark, sf).collect()}
    queries = spark.createDataFrame([(k, r.query) for k, r in enumerate(plain)], "qid long, query string")
    hits = defaultdict(list)
    for r in search.search(queries, *Q.index_of(spark, sf), limit=0, prefix=False, fuzzy=False).collect():
        hits[r.qid].append((r["rank"], r.path))
    for kind in ("title", "middle", "prose"):
        ranks = [next((rank for rank, path in hits[k] if path == r.target), None) for k, r in enumerate(plain) if r.kind == kind]
        of = got[f"plain {kind}"]
        assert of.cases == len(ranks) and of.r1 == pytest.approx(sum(r == 1 for r in ranks) / len(ranks), abs=1e-4)
        assert of.mrr == pytest.approx(sum(1 / r for r in ranks if r and r <= 10) / len(ranks), abs=1e-4)
        assert got[f"noisy {kind}"].cases == len(ranks)
