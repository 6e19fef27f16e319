"""Backlink snippets are the link's own."""

import re

from tesserae import queries as Q
from tesserae.operators import extract, graph


def test_each_target_has_its_own_snippet(spark):
    notes = spark.createDataFrame([("a.md", "a", "", []), ("b.md", "bee", "Bee Title", ["beta"]), ("c.md", "cee", "", [])], "path string, name string, title string, aliases array<string>")
    raw = spark.createDataFrame([("a.md", f"bee first\n{'x' * 200} [[Bee Title|b]] {'y' * 200}\nnow [[cee]] here\nagain [[bee]]")], "path string, raw string")
    lines = extract.line_table(raw)
    links, names = extract.wikilinks(lines), graph.resolver(notes)
    got = {r.dst: r.snippet for r in graph.backlink_context(graph.edges(graph.resolve(links, names)), notes, names, links, lines).collect()}
    assert got == {"b.md": f"…{'x' * 57} [[Bee Title|b]] {'y' * 47}…", "c.md": "now [[cee]] here"}


def test_registered_backlinks_cover_every_edge(spark, sf):
    rows = Q.FOUND["prj4_backlink_context"][0](spark, sf).collect()
    n, _, e, _ = Q.graph_of(spark, sf)
    name = {r.path: r.asDict() for r in n.select("path", "name", "raw").collect()}
    assert {(r.src, r.dst) for r in rows} == {(r.src, r.dst) for r in e.collect()}
    for r in rows:
        link = re.compile(rf"\[\[(?={re.escape(name[r.dst]['name'])}[\]#|])", re.I)
        line = next(x for x in name[r.src]["raw"].split("\n") if link.search(x))
        at = link.search(line).end()
        assert r.snippet.strip("…") == " ".join(line[max(0, at - 60) : at + 61].split())
