"""Operators with one right answer, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from tesserae.llm import components, decontaminate, linededup, linerules, packing, rans, simhash, tokens

WORD = "[^\x20\x09-\x0d]+"
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(WORD, low)
    if not w:
        return 0
    parts = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))]
    count = Counter()
    for h in (xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts):
        count.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * count[b] > len(parts))


def plain_components(values, radius=4):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= radius):
            a, b = find(i), find(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(values))]


def test_simhash_equals_brute_force(docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    rows = sorted(pairs_of(docs))
    fps = [plain_fingerprint(t) for _, t in rows]
    root = plain_components(np.array(fps, np.uint64))
    for k, (i, _) in enumerate(rows):
        assert got[i].fingerprint == f"{fps[k]:016x}" and got[i].component_id == rows[root[k]][0]


@pytest.mark.parametrize("hot_variants", [10, 5_000, simhash.HOT_VARIANTS])
def test_balls_of_near_fingerprints_link_whole(spark, hot_variants):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    fps = {int(c) ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False))) for c in centres for _ in range(15)} | {0, 1, (1 << 64) - 1}
    values = np.array(sorted(fps), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    got = {(r.node, r.root) for r in components.connected_components(simhash.near_links(df, prefix=8, hot_variants=hot_variants)).collect()}
    parent = {int(v): int(v) for v in values.view(np.int64)} | dict(got)
    want, have = defaultdict(set), defaultdict(set)
    for k, r in enumerate(plain_components(values)):
        want[r].add(int(values.view(np.int64)[k]))
    for n, r in parent.items():
        have[r].add(n)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, have.values()))


def test_simhash_edges(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert by[2] == by[3] == by[4] == ("0" * 16, 2) and by[9][1] == 1
    assert simhash.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.near_links(odd, radius=3)


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(1000, 1200)] + [(7, 7), (None, 7), (160, None)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "u long, v long").where("u is not null and v is not null")).collect()}
    assert got == {k: 100 for k in range(101, 161)} | {k: 7 for k in range(1000, 1200)}


def check_packing(df, rows):
    encode = library(BYTE)
    got = packing.pack(df, BYTE, 1).toPandas()
    want = Counter()
    for _, text in rows:
        ids = np.array([*encode(text), 1], "<u4")
        want[len(ids)] += 1
    assert (got["length"] > 0).all() and got["length"].sum() == sum(n * k for n, k in want.items())
    for _, piece in got.groupby("sequence_id"):
        p = piece.sort_values("offset")
        assert p["offset"].tolist() == [0, *np.cumsum(p["length"]).tolist()[:-1]] and p["length"].sum() <= 2048
    used = got.groupby("sequence_id")["length"].sum()
    assert (used < 2048).sum() <= 1
    return got


def test_packing(docs):
    rows = pairs_of(docs)
    got = check_packing(docs, rows)
    encode = library(BYTE)
    for i, text in rows:
        ids, at = np.array([*encode(text), 1], "<u4"), 0
        for r in got[got.doc_id == i].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_edges(odd, empty):
    check_packing(odd, pairs_of(odd))
    assert packing.pack(empty, BYTE, 1).count() == 0


def check_plan(counts):
    slots, residual, stream = packing.plan(counts)
    by = defaultdict(list)
    for length, first, seq, off in slots:
        by[length].append((first, seq, off))
    used = defaultdict(list)
    for length in np.flatnonzero(counts).tolist():
        ends = [f for f, _, _ in by[length][1:]] + [counts[length] - residual[length]]
        for (first, seq, off), end in zip(by[length], ends, strict=False):
            for k in range(end - first):
                used[seq + k].append((off, length))
    assert sorted(used) == list(range(stream))
    for pieces in used.values():  # every window that combinations fill is full, without a gap
        at = 0
        for off, length in sorted(pieces):
            assert off == at
            at += length
        assert at == len(counts)
    assert sum(map(len, used.values())) + residual.sum() == counts.sum()
    return residual


def test_plan_uses_every_document_once():
    counts = np.zeros(64, np.int64)
    counts[[10, 20, 34, 32, 63, 1]] = [50, 60, 40, 31, 7, 9]
    assert check_plan(counts).sum() < counts.sum() / 4
    for only in ({}, {40: 5}, {32: 4}, {1: 64}):
        counts = np.zeros(64, np.int64)
        for k, n in only.items():
            counts[k] = n
        residual = check_plan(counts)
        assert residual.sum() == (5 if only == {40: 5} else 0)


def test_the_least_squares_place_most_remainders():
    rng = np.random.default_rng(4)
    lengths = np.minimum(2047, rng.gamma(1.5, 450, 10_000)).astype(int) + 1
    counts = np.bincount(lengths[lengths < 2048], minlength=2048)
    rows, x = packing.solve(counts, packing.STEPS, np.random.default_rng(1))
    placed = (np.floor(x)[:, None] * (rows > 0)).sum()  # whole repeat counts alone
    assert (rows.sum(axis=1) == 2048).all() and placed > counts.sum() / 4
    residual = check_plan(counts)
    assert residual.sum() < 0.05 * counts.sum()
    assert check_plan(counts * 50).sum() < 0.05 * 50 * counts.sum()


def test_the_longest_first_knapsack_is_the_best_combination():
    rng = np.random.default_rng(2)
    value = np.where(rng.random(24) < 0.5, rng.integers(-3, 9, 24), -np.inf)
    value[0] = -np.inf
    have = np.flatnonzero(np.isfinite(value)).tolist()
    found = {max(r): value[r[r > 0]].sum() for r in packing.combinations_of(value, 4)}
    best = defaultdict(lambda: -np.inf)
    for n in range(1, 5):
        for c in combinations_with_replacement(have, n):
            if sum(c) == 24:
                best[c] = sum(value[k] for k in c)
    for k in have:
        with_k = [v for c, v in best.items() if k in c]
        if with_k:
            assert any(np.isclose(value[r[r > 0]].sum(), max(with_k)) for r in packing.combinations_of(value, 4) if k in r)
    assert found


@pytest.mark.parametrize(("path", "led"), [(BYTE, True), (WORDS, False)])
def test_units_encode_like_the_whole(docs, path, led, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 500)
    encode, own = library(path), tokens.Encoder(path, 1, led)
    odd = ["", " ", "a  b", "a \nb", "a\u00a0\n b", "a \t\r\n  b\u3000 c", "tail \n ", "a\n\nb", " a", "a ", "don't can't 's", "x's. y", "É é. ﬁ İ. ΣΑΣ.", "<|endoftext|>x", "a\x00b", "1.2, a1.", "日本語。 नमस्ते.", "\x1c a", "\n.", "THE the."]
    for texts in (odd, [t for _, t in pairs_of(docs)][:120], odd):
        ids, counts = own.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [[*encode(t), 1] for t in texts]


@pytest.mark.parametrize("letters", ["aAsStzZéÉßñ×÷'.,!?|<>#12 \n", "aAsJΣσİK中é\u030c\u0301\u0338'’.,=<#12٣\t\r \n\u00a0\u200d"])
def test_marks_apart_from_words_change_nothing(letters):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list(letters), n)) for n in rng.integers(0, 30, 3000)] + ["it's ..'s x.'s 'S we'LL", "<|endoftext|>a", ""]
    encode = library(WORDS)
    for at in range(0, len(texts), 40):
        ids, counts = tokens.Encoder(WORDS, 2, False).encode(texts[at : at + 40]) if at % 400 == 0 else tokens.encoder(WORDS, 2, False).encode(texts[at : at + 40])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == [encode(t) + [2] for t in texts[at : at + 40]]


def test_token_file_round_trip(spark, docs, tmp_path):
    encode, at = library(WORDS), 0
    rans.write_tokens(docs, str(tmp_path / "f"), WORDS, 2)
    got = {r.doc_id: r for r in rans.read_tokens(spark, str(tmp_path / "f")).collect()}
    for i, text in sorted(pairs_of(docs)):
        ids = np.array([*encode(text), 2], "<u4")
        r = got[i]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        at += len(ids)


def test_token_file_edges(spark, odd, empty, tmp_path):
    rans.write_tokens(odd, str(tmp_path / "a"), WORDS, 2)
    rows = rans.read_tokens(spark, str(tmp_path / "a")).collect()
    assert len(rows) == odd.count() and {r.doc_id: r.ids for r in rows}[2] == [2]
    assert [r.doc_id for r in sorted(rows, key=lambda r: r.start)] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    rans.write_tokens(empty, str(tmp_path / "b"), WORDS, 2)
    assert rans.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_blocks_decode_from_checkpoints_and_show_damage():
    rng = np.random.default_rng(1)
    ids = (rng.zipf(1.3, 300_000) % 40_000).astype(np.uint32)
    table = rans.Table.from_counts(np.bincount(ids, minlength=49_408))
    assert table.freq.sum() == 1 << rans.BITS
    data = rans.encode_block(ids, table)
    assert (rans.decode_block(data, table) == ids).all() and len(data) < 2 * len(ids)
    step = rans.CHECKPOINT_STEPS * rans.LANES
    for k in (1, 2):
        assert (rans.decode_block(data, table, k) == ids[k * step :]).all()
    with pytest.raises(ValueError):
        rans.decode_block(data[:-4] + bytes(4), table)
    for few in (ids[:1], ids[:0], ids[:5000]):
        assert (rans.decode_block(rans.encode_block(few, table), table) == few).all()


def test_line_dedup_equals_its_twin(spark, sf, docs):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: tuple(r[1:]) for r in duckdb.sql(linededup.OP10_SQL).fetchall()}
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.op10_line_dedup(spark, sf).collect()}
    assert got == want and any(v[1] for v in got.values())


def test_line_dedup_edges(spark, odd, empty):
    rows = linededup.drop_repeated_lines(odd).collect()
    assert len(rows) == odd.count() and all(r.lines == r.kept for r in rows)
    assert linededup.drop_repeated_lines(empty).count() == 0
    line = "A line of more than forty characters, all of it."
    df = spark.createDataFrame([(k, f" {line.upper()}\t\nown {k}") for k in range(6)] + [(5, line), (None, line)], "doc_id long, text string")
    kept = sorted((r.doc_id is None, r.doc_id, r.kept) for r in linededup.drop_repeated_lines(df).collect())
    assert [k[2] for k in kept[:5]] == [[f"own {k}"] for k in range(5)] and all(line in k[2][0].capitalize() or "LINE" in k[2][0] for k in kept[5:])


def test_line_rules_equal_their_twin(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    r = duckdb.sql(linerules.OP9_SQL)
    df = linerules.op9_line_rules(spark, sf)
    assert sorted(r.columns) == sorted(df.columns)
    at = [list(r.columns).index(c) for c in df.columns]
    assert sorted(tuple(x[k] for k in at) for x in r.fetchall()) == sorted(tuple(x) for x in df.collect())


def test_line_rules_edges(spark, odd, empty):
    got = {r.doc_id: r for r in linerules.line_rules(odd).collect()}
    assert [got[k].n_words for k in (2, 3, 4, 8)] == [0, 0, 0, 1] and got[2].base_failed and got[5].n_repeat_words == got[5].n_words == 360_000
    assert linerules.line_rules(empty).count() == 0
    texts = ["a b c a b c", "x x x x", "a b c d a b c", "a b\nc a\tb c z", "q w e r t y"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in linerules.line_rules(df).collect():
        w = re.findall(WORD, texts[r.doc_id])
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        assert r.n_repeat_words == len({k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_decontamination_equals_containment(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    norm = lambda s: " " + " ".join(re.findall(r"\w+", s.lower())) + " "
    stated = [(r.item_id, norm(r.text)) for r in items.collect()]
    want = {(i, k) for i, t in pairs_of(docs) for k, x in stated if x in norm(t)}
    for chunk in (1000, 7):
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, chunk).collect()} == want
    assert want


def test_decontamination_wants_question_and_answer(spark, odd, empty):
    q = "What is the name of the long river that runs through the old town in the north?"
    a = "It is called the silver river by all people there."
    items = spark.createDataFrame([(1, f"{q} {a}"), (2, None), (3, "")], "item_id long, text string")
    filler = "some other words stand here and there without any use at all " * 20
    df = spark.createDataFrame([(1, f"{filler}{q.upper()}  {a}{filler}"), (2, filler + q), (3, filler + a), (4, None)], "doc_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, items).collect()] == [(1, 1)]
    assert decontaminate.contaminated(odd, items).count() == 0 and decontaminate.contaminated(empty, items).count() == 0
    assert decontaminate.contaminated(df, items.limit(0)).count() == 0


def test_kept_hash_is_of_the_joined_lines(spark, sf):
    (r,) = [r for r in linededup.op10_line_dedup(spark, sf).where("doc_id = 1").collect()]
    (t,) = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 1").collect()]
    assert r.n_dropped or r.kept_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_line_runs_take_batches_one_by_one_and_go_on_later(spark):
    rng = np.random.default_rng(6)
    rows = [(int(d), int(k), int(k) * 7) for d in range(60) for k in rng.integers(0, 40, 6)]
    df = spark.createDataFrame(rows, "doc_id long, h1 long, h2 long")
    runs = linededup.LineRuns(spark)
    for k in range(3):
        runs.add(df.where(f"doc_id % 5 = {k}"))
    later = linededup.LineRuns(spark, runs.state)
    for k in (3, 4):
        later.add(df.where(f"doc_id % 5 = {k}"))
    docs_by = defaultdict(set)
    for d, k, _ in rows:
        docs_by[k].add(d)
    got = {r.h1: r.last_doc for r in later.repeated(5).collect()}
    assert got == {k: max(v) for k, v in docs_by.items() if len(v) >= 5}
    tables = [later._read(p) for level in later.state["levels"] for p in level]
    assert sum(t.count() for t in tables) == len(docs_by)  # a line is in one run
    assert [len(level) for level in later.state["levels"]] == [1, 0, 1]
    plan = tables[0].join(tables[-1].hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_documents_of_many_long_lines_are_linear(spark):
    import time

    def seconds(n):
        text = "\n".join(f"line number {k} of the very same long document, shared by all" for k in range(n))
        df = spark.createDataFrame([(k, text) for k in range(6)], "doc_id long, text string")
        began = time.time()
        rows = {r.doc_id: len(r.kept) for r in linededup.drop_repeated_lines(df).collect()}
        assert rows == {k: 0 for k in range(5)} | {5: n}
        return time.time() - began

    seconds(1000)
    few, many = seconds(4000), seconds(16_000)
    assert many < 4 * few


@pytest.mark.parametrize("hashed", ["xxhash64({})", "pmod(xxhash64({}), 5L)", "0L * xxhash64({})"])
def test_repeated_windows_are_counted_by_their_words(spark, hashed):
    """Whatever the hash does: a poor one only sends texts the longer way."""
    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(list("abcde"), n)) for n in rng.integers(1, 60, 80)] + ["a b c d e f g h", "a b c a b c", "x"]
    df = spark.createDataFrame([(k, t.split()) for k, t in enumerate(texts)], "k int, w array<string>").selectExpr("k", "w", "size(w) AS n")
    for r in df.selectExpr("k", linerules.repeated_words_sql("w", "n", hashed) + " AS c").collect():
        w = texts[r.k].split()
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        assert r.c == len({k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)})


def test_a_text_of_many_words_has_no_false_repeats(spark):
    n = 300_000
    df = spark.range(1).selectExpr("id AS doc_id", f"array_join(transform(sequence(1, {n}), i -> concat('w', i)), ' ') AS text")
    r = linerules.line_rules(df).first()
    assert r.n_words == n and r.n_repeat_words == 0


@pytest.mark.parametrize(("line", "stays"), [
    ("This is a sentence of some words.", True), ("Dies ist ein Satz, der endet.", True), ("これは文です。", True), ("no mark at its end", False), ("# * $ % is | not <text>.", False), ("Home | News | About | More.", False),
    ("Read more.", False), ("See our privacy policy for details.", False), ("THIS IS ALL CAPITALS AND SHOUTED.", False), ("12.5 33.1 2024-01-02 99.9.", False), ("---- this is a rule ----.", False), ("", None),
])
def test_lines_are_judged_one_by_one(spark, line, stays):
    r = linerules.line_rules(spark.createDataFrame([(1, f"  {line} ")], "doc_id long, text string")).first()
    assert r.clean_text == (f"  {line} " if stays else "")


def test_wand_finds_what_scoring_every_item_finds():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary, rng.integers(3, 15)))) for k in range(150)]
    known = decontaminate.Statistics.of([decontaminate.words_of(t) for _, t in items])
    index = decontaminate.Index(items, known)
    share = defaultdict(dict)
    for t in range(len(index.terms)):
        for at in range(index.start[t], index.start[t + 1]):
            share[index.item[at]][t] = index.share[at]
    for least in (0.3, 0.6, 0.95):
        for _ in range(40):
            terms = sorted(rng.choice(len(index.terms), rng.integers(1, 30), replace=False).tolist())
            for low, high in ((0, 150), (13, 97)):
                want = {i: sum(share[i].get(t, 0) for t in terms) for i in range(low, high)}
                got = dict(decontaminate.wand(terms, index, low, high, least))
                assert set(got) == {i for i, x in want.items() if x >= least - 1e-12} and all(np.isclose(got[i], want[i]) for i in got)


def test_scores_do_not_depend_on_the_parts(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = items.unionByName(items.limit(3).selectExpr("item_id + 1000 AS item_id", "concat(text, ' ', text, ' with more words behind it') AS text")).unionByName(spark.createDataFrame([(5000, "w " * 700), (5001, None)], "item_id long, text string"))
    some = docs.where("doc_id % 3 <> 1")
    got = [sorted((r.doc_id, r.item_id, round(r.question_overlap, 6), round(r.score, 6)) for r in decontaminate.contaminated(some, items, chunk).collect()) for chunk in (1000, 9)]
    assert got[0] and [g[:3] for g in got[0]] == [g[:3] for g in got[1]]
    clean = decontaminate.without_items(some, items, 9)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in some.collect()} - {g[0] for g in got[0]} and clean.columns == some.columns
