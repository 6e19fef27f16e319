"""Phrase counting, url rules and alignment, against brute force."""

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tesserae.llm import alignment, phrases, tokens, urlrules

BYTE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def of(rows):
    return sorted(map(str, map(tuple, rows)))


# phrases ------------------------------------------------------------------------------------
def plain_collocations(rows, least=10, most=3, share=50, top=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", small(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            for n in range(1, most + 1):
                f[lang or "und"].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    out = []
    for lang, c in f.items():
        total = sum(n for p, n in c.items() if len(p) == 1)
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = defaultdict(int)
        for p, a in cand.items():
            for n in range(2, len(p)):
                for k in range(len(p) - n + 1):
                    inner[p[k : k + n]] = max(inner[p[k : k + n]], a)
        scored = []
        for p, a in cand.items():
            if p in inner and 100 * inner[p] >= share * a:
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, total, -s) for r, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return out


def texts(docs):
    return [(r.text, r.lang) for r in docs.select("text", "lang").collect()]


def test_collocations_equal_brute_force(docs):
    assert of(phrases.collocations(docs).collect()) == of(plain_collocations(texts(docs)))


def test_collocations_of_other_lengths_shards_and_a_full_filter(docs):
    want = of(plain_collocations(texts(docs), 6, 4, 80, 50))
    assert of(phrases.collocations(docs, 6, 4, 80, 50).collect()) == want
    few = phrases.phrase_counts(docs, 6, 4, shards=5, bits=16)  # nearly all cells are set: no figure hangs on the filter
    assert of(few.collect()) == of(phrases.phrase_counts(docs, 6, 4).collect())


def test_odd_texts_have_collocations(spark, odd, empty):
    assert of(phrases.collocations(odd).collect()) == of(plain_collocations(texts(odd)))
    assert phrases.collocations(empty).collect() == []
    rows = [("A b\tA b. a B, a\nb A b\x0bab A  b", None)] * 7 + [("ä Ä é é " * 9 + "x", "fr"), ("x", None), ("tail tail", "und")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert of(phrases.collocations(df).collect()) == of(plain_collocations(rows))


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10, 11, 12), (4 * 10**12, 10**13 - 7, 4 * 10**12 + 1), (9 * 10**15, 9 * 10**15, 9 * 10**15), (123_456_789_012, 987_654_321_098, 123_456_789_013)]
    got = spark.createDataFrame(rows, "a long, l long, r long").selectExpr("a", f"{phrases.SCORE} AS s").collect()
    assert {r.a: r.s for r in got} == {a: 1_000_000 * a * a // (x * y) for a, x, y in rows}


def test_collocations_equal_their_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert of(phrases.op11_collocations(spark, sf).collect()) == of(con.sql(phrases.OP11_SQL).fetchall())


# url rules ----------------------------------------------------------------------------------
def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    return small(host), re.match("[^?#]*", rest[len(host) :])[0]


def plain_regex(rule):
    rule = small(rule)
    begin = "^[a-z][a-z0-9+.-]*://(?:[^/?#]*\\.)?" if rule.startswith("||") else "^" if rule.startswith("|") else ""
    end = "\\Z" if rule.endswith("|") else ""
    body = rule.lstrip("|") if begin else rule
    body = body[:-1] if end else body
    parts = {"*": ".*", "^": "(?:[^a-z0-9_.%-]|\\Z)"}
    return begin + "".join(parts.get(c, re.escape(c)) for c in body) + end


def plain_verdicts(rows, rules):
    out = []
    for page, url in rows:
        host, path = plain_parts(url)
        site = sorted((-len(r), r, v) for k, r, v in rules if k == "site" and (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :]))
        hits = {v for k, r, v in rules if k == "pattern" and re.search(plain_regex(r), small(url or ""))}
        verdict = site[0][2] if site else "allow" if "allow" in hits else "block" if hits else "allow"
        out.append((page, url, host, path, site[0][1] if site else None, verdict, not site and bool(hits)))
    return out


RULES = [("site", r, v) for r, v in urlrules.SITE_RULES] + [("pattern", r, v) for r, v in urlrules.PATTERNS]
URLS = [
    (1, "http://www.Example.com/en/x?q=/de/"), (1, "http://www.Example.com/en/x?q=/de/"), (2, None), (2, None), (3, ""), (4, "no scheme.com/"), (5, "https://a.b.NET/es/"), (6, "https://net/es"), (7, "https://xnet/es/1"), (8, "ftp://com"),
    (9, "https://com/"), (10, "https://shop.org/cart"), (11, "https://shop.org/cart-wheel"), (12, "https://ads.shop.org/a"), (13, "https://heads.shop.org/a"), (14, "https://a.org/f.ZIP"), (15, "https://a.org/f.zip.html"),
    (16, "https://a.org/help/x/login"), (17, "https://a.org/login?x"), (18, "x://y/ads.z"), (None, "https://free-bets.example.org/"), (20, "https://user@example.com:80/en/"), (21, "https://example.com/EN/"), (22, "https://é.net/fr/ü#z://q"), (23, "https://a.org/tag/b/c/page/2"),
]


def test_url_rules_equal_brute_force(spark):
    pages = spark.createDataFrame([(p, u, 0, 0) for p, u in URLS], "page_id long, url string, rule int, token int")
    got = urlrules.judged(pages, urlrules.production_rules(spark))
    assert of(got.collect()) == of(plain_verdicts(URLS, RULES))
    assert urlrules.judged(pages.limit(0), urlrules.production_rules(spark)).collect() == []
    none = urlrules.judged(pages, spark.createDataFrame([], urlrules.RULES))
    assert of(none.collect()) == of(plain_verdicts(URLS, []))


def test_rules_without_whole_tokens_and_contrary_rules(spark):
    rules = [("pattern", "art", "block"), ("pattern", "*", "block"), ("site", "org/", "allow"), ("site", "org/", "block"), ("site", "a.org/f", "allow"), ("pattern", "|ftp", "allow")]
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    got = urlrules.judged(pages, spark.createDataFrame([*rules, ("odd", "x", "block"), ("site", None, "block")], urlrules.RULES))
    assert of(got.collect()) == of(plain_verdicts(URLS, [r for r in rules if r != ("site", "org/", "allow")]))


def test_rules_are_found_by_their_rarest_token(spark):
    pages = spark.createDataFrame([(1, "https://a.com/x"), (2, "https://b.com/x"), (3, "https://a.com/y/z/")], "page_id long, url string")
    rules = spark.createDataFrame([("site", "a.com/", "block"), ("site", "com/y/z/", "block"), ("pattern", "/y", "block")], urlrules.RULES)
    index = {r.rule: r.token for r in urlrules.rule_index(rules, pages).collect()}
    assert index == {"a.com/": "a", "com/y/z/": "y", "/y": ""}


def test_url_rules_are_native_and_equal_their_sql(spark, sf):
    df = urlrules.op12_url_rules(spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet'")
    assert of(df.collect()) == of(con.sql(urlrules.OP12_SQL).fetchall())


# alignment ----------------------------------------------------------------------------------
def plain_alignment(rows):
    library, pieces = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    library.encode_special_tokens = True
    back = {chr(v): k for k, v in tokens.byte_letters().items()}
    count, docs = Counter(), []
    for doc, text in rows:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        bytes_a = [bytes(back.get(c, ord(c) & 255) for c in library.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            docs.append((doc, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links, k = [], 0
        for i, end in enumerate(ends_a):
            begin = end - len(bytes_a[i])
            while ends_b[k] <= begin:
                k += 1
            at = k
            while at < len(b) and ends_b[at] - len(bytes_b[at]) < end:
                links.append((a[i], b[at]))
                at += 1
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        count.update(links)
        docs.append((doc, a, b, links, groups))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [
        (doc, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else "")
        for doc, a, b, links, groups in docs
    ]


ODD = [
    None, "", " ", "a<|endoftext|>b <s> </s> <unk>", "x▁y", "  two  spaces\n\nlines\t tab   nb \xa0 \u3000wide ", "ﬁ½ é e\u0301 日本語 😀😀", "a\x00b", "same", "same", "word " * 3000, "xyzzy" * 2000, "\n", "<0x41>", " ▁a", "\u2028x\u0085 y", "'s don't I'll 123456 $%&",
]


def test_alignment_equals_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert of(alignment.aligned(docs, BYTE, PIECES).collect()) == of(plain_alignment(rows))


def test_odd_texts_are_aligned(spark, odd, empty):
    rows = [(k if k != 9 else None, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame([(k, t, 0, 0, 0) for k, t in rows], "doc_id long, text string, slice int, a int, links int")
    assert of(alignment.aligned(df, BYTE, PIECES).collect()) == of(plain_alignment(rows))
    assert alignment.aligned(empty, BYTE, PIECES).collect() == []
    assert len(alignment.aligned(odd, BYTE, PIECES).collect()) == odd.count()


def test_forgotten_units_change_nothing(spark, docs, monkeypatch):
    import pyarrow as pa

    some = [r.text for r in docs.where("text is not null").limit(40).collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = alignment.PieceTokens(PIECES)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    for begin in range(0, 40, 10):
        ids, counts = own.encode(pa.array([" " + t for t in some[begin : begin + 10]], pa.large_string()))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t) for t in some[begin : begin + 10]]


def test_lanes_change_nothing():
    rng = np.random.default_rng(3)
    for _ in range(20):
        total = int(rng.integers(1, 400))
        a, b = (np.append(np.flatnonzero(rng.random(total - 1) < 0.4) + 1, total) if total > 1 else np.array([1]) for _ in range(2))
        whole = alignment.lockstep(a, b, np.array([0, total]))
        lanes = alignment.lockstep(a, b, np.append(0, np.intersect1d(a, b)))
        for x, y in zip(whole, lanes, strict=True):
            assert sorted(x.tolist()) == sorted(y.tolist())


def test_a_slice_is_aligned_in_parts(monkeypatch):
    """A worker's memory hangs on a part of a slice, and where the parts end changes nothing."""
    a, b = alignment.tokenizers(BYTE, PIECES)
    texts = pa.array([None if k % 97 == 0 else "" if k % 89 == 0 else " ".join(f"word{k * j % 61} und, Straße." for j in range(40 + k % 30)) for k in range(2500)], pa.large_string())
    plain = lambda f: {k: v if isinstance(v, list | bytes) else v.tolist() for k, v in f.items()}
    tracemalloc.start()
    try:
        own = plain(alignment.align(texts, a, b))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert texts.nbytes > 2 << 20 and most < 30 * texts.nbytes
    monkeypatch.setattr(alignment, "PART_BYTES", texts.nbytes)
    assert plain(alignment.align(texts, a, b)) == own
