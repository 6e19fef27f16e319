"""Every saved query of text alone is run."""

from tesserae.plans.query import run_saved


def test_all_saved_queries_of_text_are_run(spark):
    notes = spark.createDataFrame([(f"n{k}.md", f"Title {k} end", "plan", "t", ["a"]) for k in range(30)], "path string, title string, doc_kind string, topic string, tags array<string>")
    texts = [f"TITLE {k % 30} e" for k in range(450)] + ["gone", "title"]
    saved = spark.createDataFrame([(f"q{k}.md", 0, [], [], [], t, 3, []) for k, t in enumerate(texts)], "path string, ln int, doc_kinds array<string>, topics array<string>, tags array<string>, text string, limit int, errors array<string>")
    got = sorted((r.query_path, r.path, r.pos, r.total) for r in run_saved(saved, notes).collect())
    paths = sorted(f"n{k}.md" for k in range(30))
    want = [(f"q{k}.md", f"n{k % 30}.md", 1, 1) for k in range(450)] + [("q451.md", p, i + 1, 30) for i, p in enumerate(paths[:3])]
    assert got == sorted(want)
