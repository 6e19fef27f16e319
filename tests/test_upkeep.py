"""The graph kept up by changes equals a rebuild; bursts of file events, renames over batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tesserae.operators import extract, graph, search, upkeep
from tesserae.sources import safewrite
from tesserae.sources.notelog import NoteLog
from tesserae.streaming import debounce, streams, usagelog

NOTE = "path string, name string, title string, aliases array<string>, text string, raw string, related array<string>"


def note(path, title, aliases, body, related):
    return path, path.rsplit("/", 1)[-1][:-3], title, aliases, body, body, related


def parts_of(notes):
    props = notes.select("path", F.lit("related").alias("key"), F.col("related").alias("values"))
    lines = extract.line_table(notes.select("path", "raw"), code=False)
    return {"names": graph.name_rows(notes), "links": extract.all_links(lines).select("path", "target"), "refs": graph.reference_targets(props), "terms": search.postings(notes).select("path", "term", "field")}


def rebuilt(notes):
    parts = parts_of(notes)
    names = graph.best_names(parts["names"])
    return names, graph.edges(graph.resolve(parts["links"].distinct(), names)), graph.related(graph.resolve(parts["refs"], names)), search.vocabulary(search.postings(notes))


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def same(kept, notes):
    names, links, relations, terms = rebuilt(notes)
    assert rows(kept.resolver().select("key", "path", "n_candidates")) == rows(names.select("key", "path", "n_candidates"))
    assert rows(kept.edges().select("src", "dst")) == rows(links.select("src", "dst"))
    assert rows(kept.relations().select("src", "type", "dst")) == rows(relations.select("src", "type", "dst"))
    assert rows(kept.frequencies().select("term", "field", "n")) == rows(terms.select("term", "field", "df"))


def test_upkeep_equals_a_rebuild(spark, tmp_path):
    dice = random.Random(5)
    words = ["ann", "bob", "cat", "dog", "eve"]

    def made(path):
        links = " ".join(f"[[{dice.choice(words)}{dice.choice(['', '#part', '|shown'])}]]" for _ in range(3))
        return note(path, dice.choice([*words, ""]), dice.sample(words, dice.randint(0, 2)), f"{dice.choice(words)} {links}", [dice.choice(words)])

    paths = [f"{a}/{w}.md" for a in ("p", "q", "q/r") for w in words]
    disk = {p: made(p) for p in paths[:11]}
    kept = upkeep.GraphUpkeep(NoteLog(spark, str(tmp_path / "log"), buckets=8))
    kept.build(0, parts_of(spark.createDataFrame(list(disk.values()), NOTE)))
    same(kept, spark.createDataFrame(list(disk.values()), NOTE))
    for version in (1, 2):
        touched = dice.sample(paths, 4)
        for p in touched:
            if p in disk and dice.random() < 0.5:
                del disk[p]
            else:
                disk[p] = made(p)
        now = spark.createDataFrame(list(disk.values()), NOTE)
        fresh = parts_of(now.where(F.col("path").isin(touched)))
        assert kept.apply(version, spark.createDataFrame([(p,) for p in touched], "path string"), fresh)
        assert not kept.apply(version, spark.createDataFrame([(p,) for p in touched], "path string"), fresh)  # it comes again
        same(kept, now)
    kept.compact(3)
    kept.log.sweep()
    same(kept, now)
    assert not kept.apply(1, now.select("path"), parts_of(now))  # versions before the base stay known


def test_a_change_reads_and_writes_what_it_touches(spark, tmp_path):
    notes = [note(f"d/n{k}.md", f"t{k}", [], f"[[n{k + 1}]] word{k}", []) for k in range(60)]
    kept = upkeep.GraphUpkeep(NoteLog(spark, str(tmp_path / "log"), buckets=32))
    kept.build(0, parts_of(spark.createDataFrame(notes, NOTE)))
    changed = spark.createDataFrame([note("d/n7.md", "other", [], "[[t9]]", [])], NOTE)
    kept.apply(1, changed.select("path"), parts_of(changed))
    written = {t: spark.read.parquet(f"{tmp_path}/log/{t}/v=1").count() for t in ("names", "links", "resolved", "resolver", "frequencies")}
    assert written == {"names": 2, "links": 1, "resolved": 1, "resolver": 1, "frequencies": 5}  # t7, word7 and n8 go, other and t9 come
    plan = kept.log.rows("links", upkeep.LINKS, "path", buckets=[3])._jdf.queryExecution().executedPlan().toString()
    assert "b#" in plan and "PartitionFilters: [" in plan and "(b#" in plan.split("PartitionFilters: [")[1].split("]")[0]


# bursts -------------------------------------------------------------------------------------
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = [
    ("created", "a.md", None, 0), ("modified", "a.md", None, 50), ("renamed-from", "b.md", None, 100), ("modified", "z.md", None, 500), ("created", "c.md", None, 900), ("modified", "d.md", None, 950), ("removed", "d.md", None, 1000),
    ("renamed", "f.md", "e.md", 2000), ("renamed-from", "g.md", None, 3000), ("renamed-to", "h.md", None, 3100), ("modified", "h.md", None, 3150), ("removed", ".git/x.md", None, 3200), ("renamed-from", "i.md", None, 4000), ("modified", "end.md", None, 60000),
]


def plain_bursts(events, gap, give_up):
    burst, out = debounce.Burst(gap, give_up, {}, None, 0), []
    for k, (kind, path, from_path, ms) in enumerate(events):
        if not path.startswith("."):
            out += burst.take((ms, k, kind, path, from_path, ms))
    return out


def test_bursts_by_hand():
    got = [(path, kind, from_path, quiet) for path, kind, from_path, _, _, quiet in plain_bursts(EVENTS, 200, None)]
    assert got == [
        ("a.md", "modified", None, 300), ("z.md", "modified", None, 700), ("c.md", "renamed", "b.md", 1200), ("d.md", "removed", None, 1200), ("f.md", "renamed", "e.md", 2200), ("h.md", "modified", None, 3350),
    ]
    assert ("i.md", "removed", None, 14000) in [(r[0], r[1], r[2], r[5]) for r in plain_bursts(EVENTS, 200, 10_000)]


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_renames_are_paired_over_batches(spark, tmp_path, batches):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        folder = tmp_path / "in"
        folder.mkdir()
        at = lambda ms: f"2024-01-01T00:{ms // 60000:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}Z"
        lines = [json.dumps({"root": root, "kind": k, "path": p, "from_path": f, "mtime_ms": ms, "ts": at(ms), "seq": n}) for n, (k, p, f, ms) in enumerate(EVENTS) for root in ("one", "two")]
        size = -(-len(lines) // batches)
        for k in range(batches):
            (folder / f"{k}.json").write_text("\n".join(lines[k * size : (k + 1) * size]))
        (folder / "late.json").write_text(json.dumps({"root": "none", "kind": "modified", "path": "x.md", "ts": at(3_000_000), "seq": 0}))
        source = streams.event_stream(spark, str(folder))
        source = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).json(str(folder)).where(~F.col("path").startswith("."))
        quiet = debounce.quiet_renames(source, late="30 minutes", give_up_ms=10_000)
        for again in range(2):  # a replay gives the same
            q = quiet.writeStream.format("parquet").option("path", f"{tmp_path}/out{again}").option("checkpointLocation", f"{tmp_path}/ck{again}").trigger(availableNow=True).start()
            q.awaitTermination(240)
            got = sorted((r.root, r.quiet_ms - 1704067200000, r.path, r.kind, r.from_path) for r in spark.read.parquet(f"{tmp_path}/out{again}").collect())
            want = sorted((root, r[5], r[0], r[1], r[2]) for root in ("one", "two") for r in plain_bursts(EVENTS, 200, 10_000) if r[0] != "end.md")
            assert [r for r in got if r[2] not in ("end.md", "x.md")] == want
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_batches_keep_the_graph(spark, tmp_path):
    before = [note("a.md", "A", [], "old [[c]]", []), note("b.md", "B", [], "beta [[a]]", ["c"]), note("c.md", "C", [], "gone", [])]
    now = [note("a.md", "A", [], "alpha [[b]]", []), note("b.md", "B", [], "beta [[a]]", ["c"]), note("d.md", "C", [], "new [[a]]", [])]
    kept = upkeep.GraphUpkeep(NoteLog(spark, str(tmp_path / "log"), buckets=4))
    kept.build(0, parts_of(spark.createDataFrame(before, NOTE)))
    folder = tmp_path / "in"
    folder.mkdir()
    ev = [("modified", "a.md", None, 1), ("renamed", "d.md", "c.md", 2)]
    (folder / "1.json").write_text("\n".join(json.dumps({"kind": k, "path": p, "from_path": f, "mtime_ms": s, "ts": "2024-01-01T00:00:00", "seq": s}) for k, p, f, s in ev))
    disk = spark.createDataFrame(now, NOTE)
    apply = streams.graph_upkeep(kept, lambda touched: parts_of(disk.join(touched.select("path"), "path", "left_semi")))
    for again in ("ck1", "ck2"):
        streams.keep_index(streams.change_stream(spark, str(folder)), apply, str(tmp_path / again)).awaitTermination(120)
        same(kept, disk)


# usage log ----------------------------------------------------------------------------------
def plain_appends(lines, most):
    log, out = usagelog.Appends(most, [], {}), []
    for ms, line in lines:
        out += log.take(ms, line)
    return out


def test_appends_by_hand():
    lines = [(k, f"l{k}") for k in range(64)] + [(1000, "a"), (1500, "b\nc"), (7000, "d"), (20000, "end")]
    got = [(len(x[2]), x[1], x[3], x[4]) for x in plain_appends(lines, 1 << 20)]
    assert got == [(64, 63, 64, 0), (1, 6000, 2, 0), (1, 12000, 1, 0)]


def test_a_months_cap_drops_and_counts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        month = [(1704067200000 + 10_000 * k, f"{k:03d}" + "é" * 10) for k in range(30)]
        later = [(1706745600000 + 10_000 * k, f"next {k}") for k in range(3)]
        lines = month + later
        folder = tmp_path / "in"
        folder.mkdir()
        df = spark.createDataFrame([("r", ms, k, line) for k, (ms, line) in enumerate(lines)] + [("other", 1706845600000 + 60_000, 0, "end")], "root string, ms long, seq long, line string").withColumn("ts", F.timestamp_millis("ms"))
        df.drop("ms").repartition(3, "seq").write.parquet(str(folder / "p"))
        source = spark.readStream.schema("root string, seq long, line string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder / "p"))
        out = usagelog.usage_appends(source, late="40 days", most=200)
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(240)
        last = spark.createDataFrame([("other", 1, "end", 1806845600)], "root string, seq long, line string, s long").select("root", "seq", "line", F.timestamp_seconds("s").alias("ts"))
        last.write.mode("append").parquet(str(folder / "p"))
        q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(240)
        got = sorted((r.flush_ms, r.month, r.lines, r.written, r.dropped, r.bytes) for r in spark.read.parquet(f"{tmp_path}/out").where("root = 'r'").collect())
        want = plain_appends([*lines, (1806845600000, "end")], 200)
        assert got == sorted((ms, m, x, w, d, b) for m, ms, x, w, d, b in want)
        assert sum(r[4] for r in got) == 21 and {r[1] for r in got if r[4]} == {"2024-01"}  # 9 appends of 24 bytes reach 200
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


# plans --------------------------------------------------------------------------------------
def test_a_plan_is_applied_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    log = NoteLog(spark, str(tmp_path / "raw"), buckets=4)
    state = {f"n{k}.md": f"text {k}" for k in range(9)}
    safewrite.start(log, spark.createDataFrame(list(state.items()), "path string, raw string"))
    now = lambda: {r.path: r.raw for r in safewrite.raw_notes(log).collect()}
    plan = lambda **new: spark.createDataFrame([(f"{p}.md", x) for p, x in new.items()], "path string, new_raw string")
    assert safewrite.apply_plan(log, plan(n1="one", n2="two")) == 1
    after = state | {"n1.md": "one", "n2.md": "two"}
    assert now() == after and safewrite.apply_plan(log, plan(n1="x").limit(0)) is None
    for bad in (plan(gone="x"), plan(n1="x").unionByName(plan(n1="y"))):
        with pytest.raises(safewrite.PlanError) as e:
            safewrite.apply_plan(log, bad)
        assert e.value.step == "plan" and now() == after
    put = NoteLog.put
    with monkeypatch.context() as m, pytest.raises(safewrite.PlanError) as e:
        m.setattr(NoteLog, "put", lambda self, v, t, rows, by, touched: put(self, v, t, rows.where("path <> 'n4.md'"), by, touched))  # a row is lost on the way
        safewrite.apply_plan(log, plan(n3="three", n4="four"))
    assert e.value.step == "write" and now() == after and {r.raw for r in spark.read.parquet(f"{tmp_path}/raw/_backups/000000000002").collect()} == {"text 3", "text 4"}
    assert safewrite.apply_plan(log, plan(n1="uno", n5="five")) == 2
    assert now() == after | {"n1.md": "uno", "n5.md": "five"}
    assert safewrite.roll_back(log, 2) == 3 and now() == after
    assert safewrite.roll_back(log, 1) == 4 and now() == state
    for k in range(3):
        safewrite.apply_plan(log, plan(n6=f"v{k}"), keep=2)
    assert len(safewrite.backups(log)) == 2
    with pytest.raises(safewrite.PlanError):
        safewrite.roll_back(log, 1)


def test_terms_are_a_row_a_note_and_field(spark, tmp_path):
    """They are found once a version, and written and shuffled with their note's path once."""
    notes = spark.createDataFrame([note(f"d/n{k}.md", f"t{k % 3}", [], " ".join(f"w{j % (k + 2)}" for j in range(40)), []) for k in range(20)], NOTE)
    found = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: found.add(1) or t).asNondeterministic()
    told = lambda df: parts_of(df) | {"terms": search.note_terms(df).withColumn("field", seen("field"))}
    kept = upkeep.GraphUpkeep(NoteLog(spark, str(tmp_path / "log"), buckets=4))
    kept.build(0, told(notes))
    same(kept, notes)
    assert spark.read.parquet(f"{tmp_path}/log/terms/v=0").count() == 60 == found.value
    now = notes.withColumn("text", F.when(F.col("path") == "d/n4.md", "other w1").otherwise(F.col("text")))
    kept.apply(1, now.where("path = 'd/n4.md'").select("path"), told(now.where("path = 'd/n4.md'")))
    assert rows(kept.frequencies()) == rows(search.vocabulary(search.postings(now)))
    assert spark.read.parquet(f"{tmp_path}/log/terms/v=1").count() == 3 == found.value - 60
