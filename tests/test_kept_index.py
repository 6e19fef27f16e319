"""The kept index answers as postings made anew do, and is read by terms."""

from pathlib import Path

from pyspark.sql import functions as F

from tesserae.operators import changes, search, usage
from tesserae.plans import query as plans
from tesserae.sources.keptindex import KeptIndex, kept_index

NOTES = [(f"d/n{k}.md", f"n{k}", f"Title {k % 3} deep", f"alpha beta{k % 5} gamma{'s' * (k % 2)} word{k} work " + "delta " * (k % 4)) for k in range(40)] + [("d/e.md", "e", None, "")]
ASKED = ["alpha beta1", "gamma delta nothing", "wrok gammas", "title 2", "zzz", "word7 word8 word9 deep"]


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_kept_postings_answer_like_fresh_ones(spark, tmp_path):
    notes = spark.createDataFrame(NOTES, "path string, name string, title string, text string")
    asked = spark.createDataFrame(list(enumerate(ASKED)), "qid int, query string")
    posted = search.postings(notes).cache()
    lengths = search.lengths_of(posted, notes.count())
    index = KeptIndex(spark, str(tmp_path / "index"), buckets=8)
    assert not index.whole()
    assert index.build(notes).whole()
    assert rows(index.postings().select(posted.columns)) == rows(posted)
    assert rows(index.vocabulary()) == rows(search.vocabulary(posted)) and rows(index.lengths()) == rows(lengths)
    for limit in (0, 3):
        for wide in (False, True):
            assert rows(search.search(asked, index, None, limit, wide, wide)) == rows(search.search(asked, posted, lengths, limit, wide, wide))


def test_a_query_reads_the_buckets_of_its_terms(spark, tmp_path):
    notes = spark.createDataFrame(NOTES, "path string, name string, title string, text string")
    index = KeptIndex(spark, str(tmp_path / "index"), buckets=16).build(notes)
    own = index.postings(spark.createDataFrame([("alpha",)], "term string"))
    assert own.select(F.input_file_name().alias("f")).distinct().count() <= 4 and own.count() == 40
    scan = own._jdf.queryExecution().executedPlan().toString()
    assert "(b#" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_an_index_is_built_once_a_state(spark):
    notes = spark.createDataFrame(NOTES, "path string, name string, title string, text string")
    state = notes.agg(F.count("*").alias("n"), F.lit("s1").alias("tag"))
    first = kept_index(notes, "own", state)
    mark = Path(first.root.removeprefix("file:")) / "_whole"
    was = mark.stat().st_mtime_ns
    assert kept_index(notes, "own", state).root == first.root and mark.stat().st_mtime_ns == was
    assert kept_index(notes.limit(3), "own", state.withColumn("tag", F.lit("s2"))).root != first.root
    mark.unlink()  # a build that wasn't finished is made again
    assert rows(kept_index(notes, "own", state).lengths()) == rows(first.lengths()) and mark.exists()


def test_answers_tell_their_sources(spark):
    notes = spark.createDataFrame([(p, n, t, x, "plan", "t", ["a"], 0, "2024-01-01") for p, n, t, x in NOTES], "path string, name string, title string, text string, doc_kind string, topic string, tags array<string>, mtime_ms long, date string")
    posted = search.postings(notes)
    lengths = search.lengths_of(posted, notes.count())
    got = {r.path: r for r in plans.corpus_query(plans.CorpusQuery(text="word7", tag="a", limit=50), notes, posted, lengths, fuzzy=False).collect()}
    assert got["d/n7.md"].sources == "structural,bm25" and got["d/n7.md"].snippet.startswith("alpha beta2 gammas word7 work") and got["d/n8.md"].sources == "structural" and len(got) == 41
    alone = plans.corpus_query(plans.CorpusQuery(text="word7"), notes, posted, lengths, fuzzy=False).collect()
    assert [(r.path, r.sources, r.via) for r in alone] == [("d/n7.md", "bm25", None)]
    refs = spark.createDataFrame([("d/e.md", "d/n1.md", "fm:a,fm:b,link"), ("d/e.md", "d/n2.md", "link"), ("x", "d/n3.md", "link")], "dst string, src string, via string")
    q = plans.CorpusQuery(backlinks_of="d/e.md")
    assert [(r.path, r.via, r.snippet) for r in plans.corpus_query(q, notes, None, None, refs).collect()] == [("d/n1.md", "fm:a,fm:b,link", None), ("d/n2.md", "link", None)]
    assert [tuple(r) for r in plans.query_report(q, notes, None, None, refs).where("arm = 'refs'").collect()] == [("refs", 2, 2, 2, 41)]


def test_old_session_ends_are_spans(spark):
    ev = [(1, 0, 1, "session", "start", None), (1, 5, 2, "open", None, None), (1, 9, 3, "session", "end", 100.0), (2, 3, 4, "session", "start", None), (3, 1, 5, "session", "end", 20.0), (3, 2, 6, "session", None, None)]
    df = spark.createDataFrame(ev, "user_id long, t long, seq long, k string, ev string, ms double")
    assert tuple(usage.session_summary(df).first()) == (2, 3, (9 + 100 + 20) / 3)


def test_staleness_names_the_result(spark):
    files = lambda *rows: spark.createDataFrame(rows, "path string, mtime_ms long, size long")
    was, now = files(("a", 1000, 1), ("b", 1000, 1)), files(("a", 5000, 1), ("b", 1000, 1))
    at = lambda p: spark.createDataFrame([(p,)], "path string")
    assert changes.staleness(was, now, at("a")).first().affects_results and not changes.staleness(was, now, at("b")).first().affects_results
    assert "affects_results" not in changes.staleness(was, now).columns
