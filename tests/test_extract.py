"""Golden rows of the extraction jobs on a small vault."""

import pytest

from tesserae.operators import extract, graph, rewrite, search
from tesserae.plans import query as plans

NOTE = """---
title: "A note"
tags: [one, Two/three]
aliases:
  - Alpha
  - 'Beta'
# comment
nested:
  inner: x
status: done
---
# Head
text with [[Other#Part|label]] and `[[code]]` and [md](dir/Third.md#x) and [web](https://a.b/c.md)
- [ ] open
  - [x] Done here
1. [ ] numbered

```
[[hidden]]
- [ ] hidden
```

    indented code

Second
------
## Head
> [!tip] Careful
> body

| a | b |
|---|--:|
| 1 | x \\| y |

![[Other#Part]] #tag/one a#no

```notes-query
doc_kind: plan, adr
tag: one
limit: 500
oops
color: red
```
"""


@pytest.fixture(scope="module")
def lines(spark):
    raw = spark.createDataFrame([("d/a.md", NOTE), ("d/b.md", "no front matter\n"), ("d/n.md", None), ("d/e.md", "")], "path string, raw string")
    return extract.line_table(raw).cache()


def rows(df, *cols):
    return [tuple(r) for r in df.where("path = 'd/a.md'").select(*cols).collect()]


def test_front_matter(spark, lines):
    got = {r["key"]: r["values"] for r in extract.front_properties(lines).where("path = 'd/a.md'").collect()}
    assert got == {"title": ["A note"], "tags": ["one", "Two/three"], "aliases": ["Alpha", "Beta"], "status": ["done"]}
    parts = {r.path: (r.front, r.body) for r in extract.split_front_matter(spark.createDataFrame([("a", "---\nx: 1\n---\nbody"), ("b", "plain")], "path string, raw string")).collect()}
    assert parts == {"a": ("x: 1", "body"), "b": ("", "plain")}


def test_links(lines):
    assert rows(extract.wikilinks(lines).orderBy("ln"), "target") == [("Other#Part|label",), ("Other#Part",)]
    assert rows(extract.markdown_links(lines), "target") == [("Third",)]
    assert rows(extract.embeds(lines), "target", "anchor") == [("Other", "Part")]
    assert rows(extract.inline_tags(lines), "tag") == [("tag/one",)]
    assert len(rows(extract.all_links(lines), "target")) == 3


def test_tasks(lines):
    assert sorted(rows(extract.tasks(lines), "text", "depth", "done")) == [("Done here", 1, True), ("numbered", 0, False), ("open", 0, False)]


def test_headings_code_callouts_tables(lines):
    assert rows(extract.headings(lines).orderBy("ord"), "level", "text", "slug") == [(1, "Head", "head"), (2, "Second", "second"), (2, "Head", "head-1")]
    code = {r[0] for r in rows(extract.code_lines(lines), "ln")}
    text = NOTE.split("\n")
    assert {text[k] for k in code} >= {"```", "[[hidden]]", "    indented code"} and "Second" not in {text[k] for k in code}
    assert rows(extract.callouts(lines), "kind", "title") == [("tip", "Careful")]
    assert rows(extract.table_rows(lines).orderBy("row_no"), "row_no", "cells") == [(0, ["a", "b"]), (1, ["1", "x | y"])]


def test_saved_queries(lines):
    (r,) = extract.saved_queries(lines).collect()
    assert (r.doc_kinds, r.topics, r.tags, r.text, r.limit) == (["plan", "adr"], [], ["one"], None, 200)
    assert r.errors == ["no colon", "unknown key color"]


def test_names_resolve_to_the_nearest_note(spark):
    notes = spark.createDataFrame(
        [("a/x.md", "x", "Guide", ["Al"]), ("b/x.md", "x", None, []), ("b/c/y.md", "y", "x y", []), ("a/C#.md", "C#", None, [])], "path string, name string, title string, aliases array<string>"
    )
    names = graph.resolver(notes)
    links = spark.createDataFrame([("b/c/y.md", "X#part|z"), ("a/q.md", "x"), ("a/q.md", "C#"), ("a/q.md", "AL"), ("a/q.md", "#only"), ("a/q.md", "gone")], "path string, target string")
    got = {(r.path, r.target): r.dst for r in graph.resolve(links, names).collect()}
    assert got == {("b/c/y.md", "X#part|z"): "b/x.md", ("a/q.md", "x"): "a/x.md", ("a/q.md", "C#"): "a/C#.md", ("a/q.md", "AL"): "a/x.md", ("a/q.md", "#only"): None, ("a/q.md", "gone"): None}
    broken = {r.target for r in graph.broken_links(links, names).collect()}
    assert broken == {"#only", "gone"}


def test_mentions_take_the_leftmost_longest(spark):
    notes = spark.createDataFrame([("a.md",), ("b.md",), ("c.md",)], "path string")
    names = spark.createDataFrame([("deep work", "a.md", 1), ("work", "b.md", 1), ("c note", "c.md", 1)], "key string, path string, n_candidates long")
    lines = extract.line_table(spark.createDataFrame([("c.md", "Some Deep Work here, then work and `work`.\nnetworking [[work]] c note")], "path string, raw string"))
    none = spark.createDataFrame([], "src string, dst string")
    got = {(r.dst, r.n, r.first_ln) for r in graph.unlinked_mentions(notes, lines, names, none, none.withColumn("type", none.src)).collect()}
    assert got == {("a.md", 1, 0), ("b.md", 1, 0)}


def test_embeds_expand_and_fail_by_name(spark):
    e = spark.createDataFrame([("a", 0, "b", ""), ("b", 5, "a", ""), ("a", 1, "zz", ""), ("a", 2, "b", "No"), ("a", 3, "b", "Yes"), ("a", 4, "", "Own")], "path string, ln int, target string, anchor string")
    names = spark.createDataFrame([("a", "a", 1), ("b", "b", 1)], "key string, path string, n_candidates long")
    heads = spark.createDataFrame([("b", 2, "yes", 1), ("b", 3, "deeper", 3), ("b", 2, "yes", 7), ("b", 1, "top", 9), ("a", 1, "own", 8)], "path string, level int, slug string, ln int")
    filled = graph.filled_embeds(e, names, heads).cache()
    got = {(r.root, r.path, r.anchor, r.level, r.failure) for r in filled.where("root = 'a' and level <= 2").collect()}
    assert got == {
        ("a", "b", "", 1, None), ("a", None, "", 1, "unresolved"), ("a", "b", "No", 1, "no-section"), ("a", "b", "Yes", 1, None), ("a", "a", "Own", 1, None),
        ("a", "a", "", 2, None),  # the root itself is not around the place
    }
    deep = {(tuple(r.chain), r.path, r.failure) for r in filled.where("root = 'a' and level > 2").collect()}
    assert deep == {(("b", "a"), "b", "cycle"), (("b", "a"), None, "unresolved"), (("b", "a"), "a", "cycle")}
    lines = spark.createDataFrame([("b", k, f"line {k} ", True) for k in range(12)] + [("a", k, "x", k > 0) for k in range(9)], "path string, ln int, line string, in_body boolean")
    assert {(r.path, r.begin): r.text for r in graph.shown_texts(filled, lines).collect()} == {("b", None): " \n".join(f"line {k}" for k in range(12)), ("b", 1): " \n".join(f"line {k}" for k in range(1, 7)), ("a", None): "\n".join("x" * 8), ("a", 8): "x"}


def test_grep_windows_and_utf16(spark):
    long = "x" * 400 + "needle" + "y" * 100
    lines = spark.createDataFrame([("a", 0, "😀 Needle"), ("a", 1, long), ("b", 0, "none")], "path string, ln int, line string")
    got = [tuple(r) for r in search.grep(lines, "needle").select("path", "line", "col", "len", "clipped").collect()]
    assert got == [("a", 1, 3, 6, False), ("a", 2, 60, 6, True)]


def test_rewrites_leave_code_alone(spark, lines):
    (r,) = rewrite.link_rename_plan(lines, "Other", "New").collect()
    assert r.n == 2 and "[[New#Part|label]]" in r.new_raw and "`[[code]]`" in r.new_raw and r.new_raw.count("\n") == NOTE.count("\n")
    with pytest.raises(ValueError):
        rewrite.replace_plan(lines.withColumn("raw", lines.line), "", "x")


def test_query_errors_have_names(spark):
    for q, name in ((plans.CorpusQuery(), "no_criteria"), (plans.CorpusQuery(since="soon"), "bad_since"), (plans.CorpusQuery(props={"topic": ["@done"]}), "bad_group")):
        with pytest.raises(plans.QueryError) as e:
            q.check()
        assert e.value.name == name
    names = spark.createDataFrame([("x", "a/x.md"), ("x", "b/x.md"), ("y", "y.md")], "key string, path string")
    notes = names.select("path")
    assert plans.find_note(notes, names, "y") == "y.md" and plans.find_note(notes, names, "a/x.md") == "a/x.md"
    for wanted, name in (("x", "name_ambiguous"), ("q/z.md", "path_not_indexed"), ("z", "name_unknown")):
        with pytest.raises(plans.QueryError) as e:
            plans.find_note(notes, names, wanted)
        assert e.value.name == name
