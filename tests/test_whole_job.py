"""Operators over the whole job: long names, every link, every saved query."""

from collections import defaultdict

import regex

from tesserae import queries as Q
from tesserae.operators import extract, graph

TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def plain_mentions(texts, named, linked):
    """``(dst, src): (n, first_ln)`` by trying every name at every token."""
    by_first = defaultdict(list)
    for name, path in named.items():
        by_first[name[0]].append((name, path))
    want = {}
    for path, text in texts:
        code = False
        for ln, line in enumerate(text.split("\n")):
            if regex.match(r"\s{0,3}(```|~~~)", line):
                code = not code
            elif not code and not line.startswith("# "):
                t = regex.findall(TOKEN, regex.sub(r"`[^`]*`|!?\[\[[^\[\]]*\]\]|\[[^\[\]]*\]\([^()]*\)", " ¦ ", line).lower())
                i = 0
                while i < len(t):
                    found = [(len(w), p) for w, p in by_first.get(t[i], []) if t[i : i + len(w)] == list(w)]
                    if not found:
                        i += 1
                        continue
                    size = max(k for k, _ in found)
                    dst = min(p for k, p in found if k == size)
                    i += size
                    if dst != path and (path, dst) not in linked:
                        n, first = want.get((dst, path), (0, ln))
                        want[dst, path] = (n + 1, first)
    return want


def test_mentions_of_names_of_any_length(spark):
    long = "a name of seven words, it ends."
    notes = spark.createDataFrame([("a.md",), ("b.md",), ("c.md",), ("d.md",)], "path string")
    names = spark.createDataFrame([(long, "a.md", 1), ("a name of seven", "b.md", 1), ("one two three four.", "d.md", 1)], "key string, path string, n_candidates long")
    lines = extract.line_table(spark.createDataFrame([("c.md", f"x {long} y\nA Name of Seven words\nOne two three four. {long.upper()}\none two three four")], "path string, raw string"))
    none = spark.createDataFrame([], "src string, dst string")
    got = {(r.dst, r.n, r.first_ln, r.preview) for r in graph.unlinked_mentions(notes, lines, names, none, none.withColumn("type", none.src)).collect()}
    assert got == {("a.md", 2, 0, f"x {long} y"), ("b.md", 1, 1, "A Name of Seven words"), ("d.md", 1, 2, f"One two three four. {long.upper()}")}


def test_mentions_of_titles_equal_brute_force(spark, sf):
    got = {(r.dst, r.src): (r.n, r.first_ln) for r in Q.FOUND["grf13_note_mentions"][0](spark, sf).collect()}
    n, names, edges, relations = Q.graph_of(spark, sf)
    linked = {tuple(r) for r in edges.select("src", "dst").union(relations.select("src", "dst")).collect()}
    named = {}
    for r in names.where("n_candidates = 1").collect():
        tokens = tuple(regex.findall(TOKEN, r.key))
        if len(r.key) >= 3 and tokens:
            named[tokens] = min(r.path, named.get(tokens, r.path))
    texts = [(r.path, r.text) for r in n.select("path", "text").collect()]
    want = plain_mentions(texts, named, linked)
    assert max(map(len, named)) > 4 and want and got == want
