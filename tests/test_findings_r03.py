"""What the findings of the third round were about, on small cases."""

import time

import duckdb

from tesserae import queries as Q
from tesserae.operators import extract, search


def test_titles_with_quotes_equal_the_twin(spark, tmp_path):
    """A title with a quote in it is no YAML and refuses; one with an escape stays as it stands."""
    titles = ["plain one", 'token = "5aad00', 'a "b" c', r"tab \t in it", r"no \q escape", r"end \ ", "'single'", "12"]
    docs = [(k, f"{titles[k % len(titles)]}\nbody {k}", "en", f"src{k % 3}", 20) for k in range(7 * len(titles))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(0, 50, 3)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    f, sql = Q.FOUND["rwr6_patch"]
    got = sorted((r.path, r.refused, r.new_raw) for r in f(spark, str(tmp_path)).collect())
    assert got == sorted(c.sql(f"SELECT path, refused, new_raw FROM ({sql})").fetchall())
    by = {p: refused for p, refused, _ in got}
    assert by["en/src1/doc-1.md"] and not by["en/src0/doc-3.md"]


def test_targets_stand_where_the_search_ranks_them(spark):
    """Ranks are counted, not sorted; pairs of note and query aren't shuffled before they are added up."""
    notes = spark.createDataFrame([(f"d/n{k}.md", f"n{k}", f"Title {k % 3}", f"alpha beta{k % 5} " * (k % 4) + f"word{k}") for k in range(30)], "path string, name string, title string, text string")
    posted = search.postings(notes).cache()
    lengths = search.lengths_of(posted, notes.count())
    asked = [("alpha beta1", "d/n6.md"), ("alpha beta1 title", "d/n3.md"), ("word7 alpha", "d/n9.md"), ("zzz", "d/n1.md")]
    queries = spark.createDataFrame([(k, q, t) for k, (q, t) in enumerate(asked)], "qid int, query string, target string")
    hits = search.search(queries.select("qid", "query"), posted, lengths, 0, False, False).collect()
    got = {r.qid: (r.stage, r.matched, r["rank"]) for r in search.standings(queries, posted, lengths, False, False).collect()}
    want = {q: (own[0].stage, len(own), next((r["rank"] for r in own if r.path == asked[q][1]), None)) for q in range(4) if (own := [r for r in hits if r.qid == q])}
    assert got == want and 3 not in got
    words = search.expand(search.query_words(queries), search.vocabulary(posted), False, False)
    plan = search.scored_notes(words, posted, lengths, exact=True)._jdf.queryExecution().executedPlan().toString().replace("(qid", "(path, qid")
    assert "hashpartitioning(path" in plan and "hashpartitioning(qid" not in plan.split("InMemoryTableScan")[0]


def test_texts_go_to_python_in_short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    extract.line_table(spark.createDataFrame([("a", "x\n    y")], "path string, raw string"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1_000


def test_statistics_meet_no_labels_and_take_long_words_once(spark, tmp_path):
    """Words of one kind of mark are counted in time that follows their length; labels are joined only where they can matter."""
    def told(folder, source):
        docs = [(k, ["***" * 60_000, "가나" * 40_000, "a-b 가c \u00a0 ---\nx", "", None, " \t\n", "1 ," * 50, "\ufeffé"][k % 8] , "en", source, 20) for k in range(32)]
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(k, k % 2) for k in range(0, 30, 3)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
        c = duckdb.connect()
        for t in ("documents", "labels"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        f, sql = Q.FOUND["prj5_statistics"]
        df, begun = f(spark, str(folder)), time.time()
        assert sorted(map(tuple, df.collect())) == sorted(c.sql(f"SELECT path, words, chars, chars_solid, minutes FROM ({sql})").fetchall())
        assert time.time() - begun < 30
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert "Join" not in told(tmp_path / "usual", "src1")
    assert "Join" in told(tmp_path / "dashes", "src1\n---\nx")


def test_the_doctor_reads_texts_for_two_tables_only(spark, tmp_path):
    """Its checks read notes without texts, and tasks, that were set down; tasks are found without labels."""
    docs = [(k, f"text {k}\n- [ ] own", "en", f"src{k % 3}", 20) for k in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(0, 30, 3)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = Q.FOUND["aud6_doctor"][0](spark, str(tmp_path))
    assert not any("documents.parquet" in f or "labels.parquet" in f for f in found.inputFiles())
    bare, whole = (Q.facets.task_groups(extract.tasks(extract.line_table(Q.notes(spark, str(tmp_path), status_line=x).select("path", "raw")))) for x in (False, True))
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, whole.collect()))
