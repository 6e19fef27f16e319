"""Sources, snapshots and streams."""

import json

from pyspark.sql import functions as F

from tesserae import queries as Q
from tesserae.functions import text as T
from tesserae.operators import changes, facets, usage
from tesserae.sources import store, vault
from tesserae.streaming import streams


def test_vault_scan(spark, tmp_path):
    for name, data in (("a.md", b"one"), ("sub/B.MMD", b"two"), ("sub/bad.md", b"\xff\xfe\xfa"), (".hid/c.md", b"x"), ("node_modules/d.md", b"x"), ("e.txt", b"x")):
        p = tmp_path / "v" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r.path: (r.name, r.raw) for r in vault.read_vault(spark, str(tmp_path / "v")).collect()}
    assert got == {"a.md": ("a", "one"), "sub/B.MMD": ("B", "two")}
    assert {r.rel for r in vault.files(spark, str(tmp_path / "v")).collect()} == {"a.md", "sub/B.MMD", "sub/bad.md"}


def test_commit_log_and_assets(spark, tmp_path):
    log = tmp_path / "log.txt"
    log.write_text("h1\x1fs1\x1fann\x1f10\x1ffirst\nh2\x1fs2\x1fbob\x1fxx\x1fsecond\nbroken\nh3\x1fs3\x1fcat\x1f20\x1fa\x1fb\n")
    assert [(r.hash, r.ts, r.subject) for r in vault.read_commits(spark, str(log)).collect()] == [("h3", 20, "a\x1fb"), ("h1", 10, "first"), ("h2", 0, "second")]
    notes = spark.createDataFrame([("d/plan.md",)], "path string")
    images = spark.createDataFrame([("d/plan.png",), ("d/plan-2.svg",), ("d/planet.png",), ("e/plan.png",), ("d/plan_x.txt",)], "path string")
    assert {r.asset for r in vault.note_assets(notes, images).collect()} == {"d/plan.png", "d/plan-2.svg"}


def test_usage_log(spark, tmp_path):
    good = [{"k": "cmd", "t": 1, "id": "a", "via": "menu"}, {"k": "err", "t": 2, "at": "x", "msg": "warn: slow"}, {"k": "odd", "t": 3}, {"k": "open", "t": 4, "path": "p"}]
    (tmp_path / "2024-05.log").write_text("\n".join(json.dumps(g) for g in good) + "\nnot json\n")
    (tmp_path / "other.txt").write_text("{}\n")
    parsed = usage.parse_lines(vault.read_usage_log(spark, str(tmp_path)))
    got = sorted((r.month, r.k or "", r.status, r.lvl or "") for r in parsed.collect())
    assert got == [("2024-05", "", "malformed", ""), ("2024-05", "cmd", "ok", ""), ("2024-05", "err", "ok", "warn"), ("2024-05", "odd", "unknown-kind", ""), ("2024-05", "open", "malformed", "")]


def test_snapshots_flip_and_restore(spark, tmp_path):
    root = str(tmp_path / "store")
    store.write_snapshot(spark, root, {"t": spark.range(3)}, "one")
    store.write_snapshot(spark, root, {"t": spark.range(5)}, "two")
    assert store.current(spark, root, "t").count() == 5
    assert store.restore(spark, root) == "one" and store.current(spark, root, "t").count() == 3


def test_delta_gate_and_refresh(spark):
    assert [changes.delta_gate(*x) for x in ((0, 10), (5, 10), (10, 10), (11, 10), (5, 10, 4, 8))] == [("full", "empty"), ("delta", ""), ("delta", ""), ("full", "too-many"), ("full", "part-count-change")]


def test_cell_order(spark):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(["b", "", "10", "9", "2024-01-02", None, "A"])], "k int, c string")
    up = [r.c for r in rows.orderBy(*facets.cell_order(F.col("c"))).collect()]
    down = [r.c for r in rows.orderBy(*facets.cell_order(F.col("c"), False)).collect()]
    assert up[:5] == ["2024-01-02", "9", "10", "A", "b"] and down[:5] == ["b", "A", "10", "9", "2024-01-02"]
    percent = spark.createDataFrame([("1,200",), ("30%",), ("",), ("x",)], "c string")
    assert [r.c for r in percent.orderBy(*facets.table_column_order(F.col("c"))).collect()] == ["30%", "1,200", "x", ""]


def test_text_functions(spark):
    T.register_functions(spark)
    r = spark.range(1).select(
        T.slugify(F.lit("  Héllo, World! ")).alias("a"), T.slugify(F.lit("!!")).alias("b"), T.consonants(F.lit("한글 ab")).alias("c"), T.note_tokens(F.lit("한국어 Hi, 가 x2")).alias("d"),
        T.fuzzy_score("abc", F.lit("abc")).alias("e"), T.fuzzy_score("ab", F.lit("abcd")).alias("f"), T.fuzzy_score("bc", F.lit("abcd")).alias("g"), T.fuzzy_score("ad", F.lit("abcd")).alias("h"), T.fuzzy_score("da", F.lit("abcd")).alias("i"),
        F.expr("slugify('A  b')").alias("j"), F.expr("nfc('é')").alias("k"),
    ).first()
    assert (r.a, r.b, r.c, r.d) == ("héllo-world", "section", "ㅎㄱ ab", ["한국", "국어", "hi", "가", "x2"])
    assert (r.e, r.f, r.g, r.h, r.i) == (1000, 798, 498, 100 + 1 + 5 + 20 + 1 - 2, None)
    assert (r.j, r.k) == ("a-b", "é")


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_change_stream_keeps_the_last_change(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    ev = [("created", "a.md", None, 1), ("modified", "a.md", None, 2), ("renamed", "c.md", "b.md", 3), ("removed", ".git/x.md", None, 4), ("modified", "z.txt", None, 5)]
    (folder / "1.json").write_text("\n".join(json.dumps({"kind": k, "path": p, "from_path": f, "mtime_ms": s, "ts": "2024-01-01T00:00:00", "seq": s}) for k, p, f, s in ev))
    stream = streams.change_stream(spark, str(folder))
    q = streams.keep_index(stream, lambda df, b: df.write.mode("overwrite").parquet(f"{out}/{b}"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert {(r.path, r.kind) for r in spark.read.parquet(f"{out}/0").collect()} == {("a.md", "modified"), ("c.md", "modified"), ("b.md", "removed")}


def test_index_upkeep_equals_a_rebuild(spark, tmp_path):
    from tesserae.operators import changes

    columns = "path string, name string, title string, text string, raw string"
    note = lambda p, body: (p, p[:-3], p.upper(), body, body)
    now = {"a.md": "alpha [[b]] beta", "b.md": "beta", "d.md": "new [[a]] words"}
    before = spark.createDataFrame([note("a.md", "old [[c]]"), note("b.md", "beta"), note("c.md", "gone")], columns)
    root, folder = str(tmp_path / "store"), tmp_path / "in"
    store.write_snapshot(spark, root, {"notes": before} | changes.derived(before), "start")
    folder.mkdir()
    ev = [("modified", "a.md", 1), ("removed", "c.md", 2), ("created", "d.md", 3)]
    (folder / "1.json").write_text("\n".join(json.dumps({"kind": k, "path": p, "mtime_ms": s, "ts": "2024-01-01T00:00:00", "seq": s}) for k, p, s in ev))
    disk = spark.createDataFrame([note(p, t) for p, t in now.items()], columns)
    apply = streams.index_upkeep(spark, root, lambda touched: disk.join(touched.select("path"), "path", "left_semi"))
    for again in ("ck1", "ck2"):  # the second run brings the same batch again
        streams.keep_index(streams.change_stream(spark, str(folder)), apply, str(tmp_path / again)).awaitTermination(120)
        for name, want in ({"notes": disk} | changes.derived(disk)).items():
            got = store.current(spark, root, name).select(want.columns)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert [r.snapshot_id for r in store.history(spark, root)] == ["batch-0", "start"]


def test_counts_of_parts_add_up(spark, sf):
    """The usage log in parts gives the tables of the whole: counts are sums of the parts' counts."""
    from tesserae.operators import usage

    events = Q.usage_events(spark, sf)
    whole = {tuple(r[:3]): r.n for r in usage.errors(events).collect()}
    parts = None
    for k in range(3):
        one = usage.errors(events.where(f"event_id % 3 = {k}"))
        parts = one if parts is None else parts.unionByName(one)
    assert {tuple(r[:3]): r.n for r in parts.groupBy("lvl", "at", "msg").agg(F.sum("n").alias("n")).collect()} == whole


def test_tables_as_csv_and_markdown(spark, tmp_path):
    from tesserae.sources import vault

    rows = spark.createDataFrame([("a/n.md", 3, 0, ["h", "i, j"]), ("a/n.md", 3, 1, ['say "x"', "p|q"])], "path string, table_ln int, row_no int, cells array<string>")
    assert [r.line for r in vault.csv_lines(rows).orderBy("row_no").collect()] == ['h,"i, j"', '"say ""x""",p|q']
    assert [r.line for r in vault.to_markdown(rows).orderBy("row_no").collect()] == ["| h | i, j |", '| say "x" | p\\|q |']
    vault.to_csv(rows, str(tmp_path / "csv"))
    (file,) = (tmp_path / "csv").rglob("part-*.txt")
    assert file.read_text() == 'h,"i, j"\n"say ""x""",p|q\n'


def test_streams_equal_batches(spark, sf, tmp_path):
    events = Q.usage_events(spark, sf).withColumn("ts", F.timestamp_micros("us"))
    events.repartition(3).write.parquet(str(tmp_path / "e"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    counted = streams.usage_windows(source.withColumn("ts", F.col("ts")), late="1000 days")
    got = {(r.day, r.k): r.n for r in run(counted, "usage_days", "complete").collect()}
    want = {(r.day, r.k): r.n for r in events.groupBy(F.window("ts", "1 day").start.alias("day"), "k").agg(F.count("*").alias("n")).collect()}
    assert got == want
    gaps = run(streams.gap_sessions(source, late="1000 days"), "gap_sessions", "complete").agg(F.sum("n")).first()[0]
    assert gaps == events.count()


def test_marker_sessions(spark, tmp_path):
    rows = [(1, 10, 1, True), (1, 15, 2, False), (1, 30, 3, True), (2, 5, 4, False), (2, 7, 5, True), (2, 9, 6, True)]
    df = spark.createDataFrame(rows, "user_id long, us long, seq long, starts boolean")
    df.write.parquet(str(tmp_path / "e"))
    got = run(streams.marker_sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))), "markers")
    assert {tuple(r) for r in got.collect()} == {(1, 10, 5, 2), (2, 7, 0, 1)}


def test_unread(spark):
    t = lambda rows: spark.createDataFrame(rows, "path string, ts long")
    assert [r.path for r in streams.unread_notes(t([("a", 1), ("b", 9)]), t([("a", 5), ("b", 5), ("c", 7)])).collect()] == ["a"]
