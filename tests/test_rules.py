"""Values and rules of the notes' domain, one case each."""

import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.functions.blocks import code_starts
from tesserae.operators import extract, facets, graph, search
from tesserae.plans.query import CorpusQuery, structural
from tesserae.sources import vault


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


@pytest.mark.parametrize(("word", "group"), [("완료", "done"), ("반영됨", "done"), ("해결됨", "done"), ("닫힘", "done"), ("이전됨", "done"), ("진행 중", "active"), (" 진행   중 ", "active"), ("진행중", None), ("미착수", "todo"), ("열림", "todo"), ("wip", None), ("done", None)])
def test_lifecycle_words(spark, word, group):
    assert one(spark, word, T.lifecycle("x"))[0] == group


def test_status_groups_expand():
    assert facets.expand_status(["@todo", "x"]) == ["미착수", "열림", "x"]
    with pytest.raises(ValueError):
        facets.expand_status(["@foo"])


@pytest.mark.parametrize(("text", "want"), [
    ("", (0, 0, 0, 0)), (" \n\t ", (0, 0, 0, 0)), ("one two", (2, 7, 6, 1)), ("…  —", (2, 4, 2, 0)), ("---\ntitle: a\n---\nb c", (2, 3, 2, 1)),
    (" ".join(["가나다라마"] * 500), (500, 2999, 2500, 5)), (" ".join(["word"] * 401), (401, 2004, 1604, 3)),
])
def test_statistics(spark, text, want):
    df = spark.createDataFrame([("p", text)], "path string, text string")
    r = facets.statistics(df).first()
    assert (r.words, r.chars, r.chars_solid, r.minutes) == want


@pytest.mark.parametrize(("text", "want"), [("हिन्दी भाषा", ["हिन्दी", "भाषा"]), ("e\u0301tude—Zwei_drei", ["e\u0301tude", "zwei", "drei"]), ("C++ a1.b", ["c", "a1", "b"]), ("한국어x 가", ["한국", "국어", "x", "가"]), ("", [])])
def test_tokens_part_at_space_marks_and_symbols(spark, text, want):
    assert one(spark, text, T.note_tokens("x"))[0] == want


def test_postings_count_terms_within_a_note(spark):
    notes = spark.createDataFrame([("p", "n-1", "The the", "b a b. B c"), ("q", "n", None, "")], "path string, name string, title string, text string")
    got = {(r.path, r.field, r.term): (r.tf, r.len) for r in search.postings(notes).collect()}
    assert got == {("p", "name", "n"): (1, 2), ("p", "name", "1"): (1, 2), ("p", "title", "the"): (2, 1), ("p", "body", "a"): (1, 3), ("p", "body", "b"): (3, 3), ("p", "body", "c"): (1, 3), ("q", "name", "n"): (1, 1)}


def states(spark, **raw):
    rows = extract.line_table(spark.createDataFrame(list(raw.items()), "path string, raw string")).collect()
    return {p: {w: [r.ln for r in sorted(rows, key=lambda r: r.ln) if r.path == p and r[w]] for w in ("in_front", "in_body", "in_fence", "in_code")} for p in raw}


def test_line_states(spark):
    got = states(spark, p="---\na: 1\n---\nx\n```\n---\n~~~\ny\n```", open="---\nnever [[a]]", none=None, empty="", dashes="---\na: 1\n---x\nb", two="---\n---\nb", text="--- x\na\n---\nb", cr="---\r\na\r\n---\r\nb")
    assert got["p"] == {"in_front": [1], "in_body": [3, 4, 5, 6, 7, 8], "in_fence": [4, 5, 6, 7, 8], "in_code": [4, 5, 6, 7, 8]}
    assert got["open"]["in_body"] == [0, 1] and got["empty"]["in_body"] == [0] and not any(got["none"].values())
    assert got["dashes"]["in_front"] == [1] and got["dashes"]["in_body"] == [3]
    assert got["two"]["in_body"] == [0, 1, 2] and got["text"]["in_body"] == [0, 1, 2, 3] and got["cr"]["in_front"] == [1]


def test_links_and_code_have_masks_of_their_own(spark):
    mixed = "```\n~~~\n```\n[[after]]\n- [ ] after\n~~~\n[[tilde]]\n- [ ] tilde\n~~~\n````\n```\n[[within]]\n- [ ] within\n````\n[[lost]]\n- [ ] shown"
    lines = extract.line_table(spark.createDataFrame([("m", mixed), ("f", "---\nintro\n[[a]]\n- [ ] t")], "path string, raw string"))
    assert {(r.path, r.target) for r in extract.wikilinks(lines).collect()} == {("m", "after"), ("m", "tilde"), ("m", "within"), ("f", "a")}
    assert {(r.path, r.text) for r in extract.tasks(lines).collect()} == {("m", "after"), ("m", "shown"), ("f", "t")}


def test_links_end_at_the_first_brackets(spark):
    lines = extract.line_table(spark.createDataFrame([("m", "[[a[1]]] [[x [[y]] [[ z#h|q ]] [b](p q/n (1).md) [c](d/e f.MD#x) [[]] [w](https://a/b.md) [m](n.mmd)")], "path string, raw string"), code=False)
    assert [r.target for r in extract.wikilinks(lines).orderBy("k").collect()] == ["a[1", "z#h|q"]
    assert [r.target for r in extract.markdown_links(lines).orderBy("k").collect()] == ["e f"]


def test_front_matter_is_split_as_lines_are(spark):
    raw = {"a": "---\nt: 1\nu: 2\n--- \nx\ny", "b": "---\nt: 1", "c": "---\nt\n---", "d": "x\n---\n"}
    got = {r.path: (r.front, r.body) for r in extract.split_front_matter(spark.createDataFrame(list(raw.items()), "path string, raw string")).collect()}
    assert got == {"a": ("t: 1\nu: 2", "x\ny"), "b": ("", "---\nt: 1"), "c": ("t", ""), "d": ("", "x\n---\n")}


CODE = [
    ("a\n```\nb\n```\nc", [1, 2, 3]), ("a\n~~~\nb\n~~~\nc", [1, 2, 3]), ("p\n\n    code", [2]), ("- [ ] p\n    - [ ] c", []), ("```\n~~~\n```\nx", [0, 1, 2]), ("````\n```\nx\n````\ny", [0, 1, 2, 3]),
    ("p\n    lazy", []), ("    a\n\n    b\n\nc", [0, 1, 2]), ("> ```\n> x\ny", [0, 1]), ("- a\n\n      code\n- b", [2]), ("- a\n\n    text", []), ("1. x\n   ```\n   y\n   ```\n2. z", [1, 2, 3]), ("# h\n    code", [1]),
    ("```a`b\nx", []), ("```\nx\n", [0, 1]), ("-     code", [0]), (">     code", [0]), ("a\n===\n    code", [2]), ("\tcode", [0]), ("- a\n  ```\nb\n```\nc", [1, 3, 4]), ("p\n\n    - [ ] code\n\n- [ ] r\n    - [ ] k", [2]),
    ("* * *\n    c", [1]), ("a\n2. x\n       y", []), ("~~~ a`b\nx\n~~~~\nz", [0, 1, 2]), ("", []), ("```", [0]), ("p\n~~~\n- [ ] t\n~~~\n\n    - [ ] i\n\n- [ ] r\n    - [ ] c", [1, 2, 3, 5]), ("```\r\nx\r\n```\r\ny", [0, 1, 2]),
]


@pytest.mark.parametrize(("text", "code"), CODE)
def test_code_follows_the_block_structure(text, code):
    starts = code_starts(text)
    assert len(starts) == text.count("\n") + 1 and [k for k, s in enumerate(starts) if s >= 0] == code
    assert code_starts(None) is None


def test_rows_without_a_path_stay_in_scope(spark):
    df = spark.createDataFrame([("en/a",), ("de/b",), (None,)], "path string")
    assert {r.path for r in df.where(facets.in_scope(F.col("path"), ["en/"], ["en/x"])).collect()} == {"en/a", None}


def test_open_fields_filter_by_the_property_table(spark):
    notes = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, topic string")
    props = spark.createDataFrame([("a", "owner", ["kim ", "lee"]), ("b", "owner", ["ann"])], "path string, key string, values array<string>")
    q = CorpusQuery(props={"owner": ["kim"]}, include_archive=True)
    assert [r.path for r in structural(q, notes, properties=props).collect()] == ["a"]
    assert [r.path for r in facets.exact_filter(notes, props={"owner": ["ann"], "topic": ["y"]}, properties=props).collect()] == ["b"]


def test_facet_listing_orders_and_counts_before_the_cut(spark):
    notes = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", "z"])], "path string, tags array<string>")
    assert [tuple(r) for r in facets.facet_listing(notes, "tags", cap=2).collect()] == [("y", 2, 3, True), ("x", 1, 3, True)]


def test_a_popular_title_resolves_by_the_nearest_folder(spark):
    paths = [f"{a}/{b}/n{k}.md" for a in "pq" for b in "rs" for k in range(5)]
    notes = spark.createDataFrame([(p, "Same", p.rsplit("/", 1)[1][:-3]) for p in paths], "path string, title string, name string")
    links = spark.createDataFrame([(p, t) for p in [*paths, "q/x.md", "z.md"] for t in ("same", "Same#part|shown", "gone")], "path string, target string")
    got = {(r.path, r.target): r.dst for r in graph.resolve(links, graph.resolver(notes)).collect()}

    def nearest(p):
        shared = lambda d: next((k for k, (x, y) in enumerate(zip(p.split("/")[:-1], d.split("/")[:-1], strict=False)) if x != y), min(p.count("/"), d.count("/")))
        return min(paths, key=lambda d: (-shared(d), d))

    assert got == {(p, t): None if t == "gone" else nearest(p) for p in [*paths, "q/x.md", "z.md"] for t in ("same", "Same#part|shown", "gone")}


def test_notes_are_read_composed(spark, tmp_path):
    (tmp_path / "e\u0301.md").write_text("cafe\u0301 \u1112\u1161\u11ab", encoding="utf-8")
    (r,) = vault.read_vault(spark, str(tmp_path)).collect()
    assert r.raw == "café 한" and r.name == "é"


def test_axes_and_groups_leave_out_fixed_fields(spark):
    rows = [(f"p{k}", key, [value]) for k in range(8) for key, value in (("topic", "a"), ("owner", "ab"[k % 2]), ("source", "s"), ("id", str(k)), ("depends_on", "n"))]
    props = spark.createDataFrame(rows, "path string, key string, values array<string>")
    assert {r.key for r in facets.filter_axes(props).collect()} == {"owner", "source"}
    assert {r.key for r in facets.grouping_candidates(props).collect()} == {"owner", "topic"}


def test_plain_fields_name_no_notes(spark):
    notes = spark.createDataFrame([("a.md", "a", "a"), ("b.md", "b", "b")], "path string, title string, name string")
    props = spark.createDataFrame([("a.md", k, ["b"]) for k in ("owner", "name", "phase", "author", "amends")], "path string, key string, values array<string>")
    assert {r.type for r in graph.relations(props, graph.resolver(notes)).collect()} == {"author", "amends"}


def test_a_filter_of_hashes_lets_all_of_them_through(spark):
    hashes = spark.range(2000).select(F.xxhash64("id").alias("h"))
    passes = graph.hash_filter(hashes, 2000)
    got = spark.range(20_000).where(passes(F.xxhash64("id"))).agg(F.count_if(F.col("id") < 2000).alias("own"), F.count_if(F.col("id") >= 2000).alias("other")).first()
    assert got.own == 2000 and got.other < 400
    assert spark.range(9).where(graph.hash_filter(hashes.limit(0), 0)(F.xxhash64("id"))).count() == 0
