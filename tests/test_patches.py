"""Patches of front matter, snippets by query, folder listings and findings about fields, on small cases."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import facets, rewrite, search


def patched(spark, raw, set_, remove=()):
    rows = rewrite.patch_front_matter(spark.createDataFrame([("a", raw)], "path string, raw string"), set_, remove).collect()
    return ("refused" if rows[0].refused else rows[0].new_raw) if rows else "same"


@pytest.mark.parametrize(
    "raw, set_, remove, wanted",
    [
        ("---\ndate: 2024-01-01\ntitle: old\n---\nbody", {"title": "new", "zeta": "1a", "tags": ["x"]}, (), "---\ndate: 2024-01-01\ntitle: new\ntags:\n  - x\nzeta: 1a\n---\nbody"),  # order kept, preferred first
        ("---\r\ntitle: a\r\n---\r\nbody\r\n", {"title": "b"}, (), "---\ntitle: b\n---\nbody\r\n"),
        ("---\ntitle: a\n---\nbody", {}, ("title",), "body"),  # the last field gone
        ("---\ntitle: a\n---\nbody", {"title": "  "}, (), "body"),  # nothing is a removal
        ("---\ntitle: a\n---\nbody", {"tags": []}, (), "same"),
        ("no front", {"title": "a"}, (), "---\ntitle: a\n---\nno front"),
        ("---\nnever ends", {"title": "a"}, (), "---\ntitle: a\n---\n---\nnever ends"),
        ("---\ntitle: a\n---x\nbody", {"title": "b"}, (), "---\ntitle: b\n---\nx\nbody"),
        ("---\ntags: [a, 'b c', \"d: e\"]\n---\n", {"k": "v"}, (), "---\ntags:\n  - a\n  - b c\n  - 'd: e'\nk: v\n---\n"),
        ("---\ntags:\n- a\n-  \"7\"\nx:\n---\n", {"k": "v"}, (), "---\ntags:\n  - a\n  - '7'\nx: null\nk: v\n---\n"),
        ("---\n# note\ntitle: a # why\n\nmap:\n  in: 1\n---\n", {"k": "yes"}, (), "---\ntitle: a\nmap:\n  in: 1\nk: 'yes'\n---\n"),
        ("---\ntags: []\nq: 'it''s'\n---\n", {"k": "v"}, (), "---\ntags: []\nq: it's\nk: v\n---\n"),
        ("---\ntitle: \"open\nk: 1\n---\n", {"k": "v"}, (), "refused"),
        ("---\ntitle: \"a \"b\" c\"\n---\n", {"k": "v"}, (), "refused"),
        ("---\ntags: [a\n---\n", {"k": "v"}, (), "refused"),
        ("---\na: b: c\n---\n", {"k": "v"}, (), "refused"),
        ("---\na: 1\na: 2\n---\n", {"k": "v"}, (), "refused"),
        ("---\njust words\n---\n", {"k": "v"}, (), "refused"),
        ("---\n- a\n- b\n---\n", {"k": "v"}, (), "refused"),  # a list is no front matter
        (None, {"k": "v"}, (), "same"),
    ],
)
def test_patches(spark, raw, set_, remove, wanted):
    assert patched(spark, raw, set_, remove) == wanted


@pytest.mark.parametrize("text, wanted", [("plain", "plain"), ("", "''"), ("12", "'12'"), ("1e3", "'1e3'"), ("true", "'true'"), ("- x", "'- x'"), ("a: b", "'a: b'"), ("it's", "it's"), ("'q", "'''q'"), ("a #b", "'a #b'"), ("2024-01-01", "2024-01-01"), ("열림", "열림")])
def test_yaml_texts(spark, text, wanted):
    assert spark.range(1).select(rewrite.yaml_text(F.lit(text))).first()[0] == wanted


def snippet(spark, raw, query, radius=60):
    return spark.createDataFrame([(raw,)], "raw string").select(search.snippet_for_query(F.col("raw"), query, radius)).first()[0]


def test_snippets_by_query(spark):
    text = "---\nkey: indexes\n---\n" + "x" * 100 + "\n the  index 인덱스를 here " + "y" * 100
    body = text[len("---\nkey: indexes\n---\n") :]
    at = body.index("index")
    assert snippet(spark, text, "index", 10) == "…" + " ".join(body[at - 10 : at + 10].split()) + "…" == "…xxx the index 인덱스를…"  # front matter is no body
    at = body.index("인덱")
    assert snippet(spark, text, "인덱스로", 10) == "…" + " ".join(body[at - 10 : at + 10].split()) + "…"  # by pairs of syllables
    assert snippet(spark, "short text", "text") == "short text"
    assert snippet(spark, "short text", "absent") == "short text…" == snippet(spark, "short text", " ")
    assert snippet(spark, "", "a") == "…"


def test_folder_listing(spark):
    rows = facets.folder_listing(spark.createDataFrame([("b/z.md",), ("b/A.md",), ("b/c/d/e.mmd",), ("top.md",)], "path string")).collect()
    assert [tuple(r) for r in rows] == [
        ("", True, "b", "b", 3), ("", False, "top", "top.md", None),
        ("b", True, "c", "b/c", 1), ("b", False, "A", "b/A.md", None), ("b", False, "z", "b/z.md", None),
        ("b/c", True, "d", "b/c/d", 1), ("b/c/d", False, "e", "b/c/d/e.mmd", None),
    ]


def test_field_issues(spark):
    values = ["todo"] * 5 + ["todos"] * 2 + ["todos late", "all todo", "Done", "done", "dones", "undone", "x1", "x2"] + ["open"] * 10
    props = [(f"p{k}", "state", [v, f" {v} ", ""]) for k, v in enumerate(values)] + [(f"p{k}", key, [f"v{k}"]) for k in range(9) for key in ("title", "topic", "rel")] + [(f"p{k}", "tags", ["A", "a"]) for k in range(9)]
    found = facets.field_issues(spark.createDataFrame(props, "path string, key string, values array<string>"), spark.createDataFrame([("rel",)], "type string")).collect()
    got = {(r.field, r.issue, r.head, r.value, r.n, r.total) for r in found}
    assert len(got) == len(found)
    state = {x[1:] for x in got if x[0] == "state"}
    assert state == {
        ("case-only", "done", "Done", 1, None), ("case-only", "done", "done", 1, None),  # so dones is no plural of either
        ("plural", "todo", "todo", 5, None), ("plural", "todo", "todos", 2, None),
        ("prefix", "todos", "todos", 2, None), ("prefix", "todos", "todos late", 1, None),
        ("suffix", "todo", "todo", 5, None), ("suffix", "todo", "all todo", 1, None),
    } | {("sparse", "", v, 1, 8) for v in ["Done", "all todo", "done", "dones", "todos late", "undone", "x1", "x2"]}
    assert {x[1:] for x in got if x[0] == "topic"} == {("sparse", "", f"v{k}", 1, 9) for k in range(8)}  # always looked at; the first 8
    assert {x[0] for x in got} == {"state", "topic"}
    assert facets.field_issues(spark.createDataFrame([], "path string, key string, values array<string>"), spark.createDataFrame([], "type string")).count() == 0


def test_the_doctor_counts_mentions(spark, sf):
    from tesserae import queries as Q

    found = {r.check: r.n for r in Q.doctor(spark, sf, mentions=True).collect()}
    assert found["mentions"] == Q.note_mentions(spark, sf).select("dst").distinct().count()
    assert found["total"] == sum(n for check, n in found.items() if check != "total")
