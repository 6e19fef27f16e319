"""Learned operators: held-out quality, defined edges; and the pipeline's stages."""

import html
import math
import re
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import blocks, languages, resample, toxicity

SF01 = "/root/testdata/sf0.01"


def auc(score, label):
    rank = np.argsort(np.argsort(score)) + 1
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def test_main_text_is_the_article(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in blocks.op1_main_text(spark, sf).collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", pages[r.page_id], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert r.text == "\n\n".join(b for b in want if b) and r.n_chars == len(r.text)


def test_blocks_of_unusual_markup():
    got = blocks.blocks_of("<!-- <p>x</p> --><p>a &amp; b<br>c<script>x<b></script><p>d <b>e</b><ul><li>f<li>g</ul><a href='x>y'>h</a></div>i<style>z")
    assert [(b[1], b[0][-1:] or ("",)) for b in got] == [("a & b c", ("p",)), ("d e", ("p",)), ("f", ("li",)), ("g", ("li",)), ("h", ("",)), ("i", ("",))] and got[4][2] == 1
    assert blocks.blocks_of("") == [] and blocks.blocks_of("<") != [] and blocks.blocks_of("<p") != None  # noqa: E711


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2, 3, blocks.DIM))
    w = blocks.new_weights()
    for d in "fb":
        keep = []
        blocks._run(x, w, d, keep)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        dout = rng.normal(size=(2, 3, blocks.HIDDEN))
        blocks._back(x, w, d, keep, dout, grad)
        for name in (f"x{d}", f"h{d}", f"b{d}"):
            at = tuple(rng.integers(0, s) for s in w[name].shape)
            more, less = {k: v.copy() for k, v in w.items()}, {k: v.copy() for k, v in w.items()}
            more[name][at] += 1e-5
            less[name][at] -= 1e-5
            slope = ((blocks._run(x, more, d) - blocks._run(x, less, d)) * dout).sum() / 2e-5
            assert abs(slope - grad[name][at]) < 1e-4 * max(1, abs(slope))


def test_main_text_edges(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (3, "u", "plain words"), (None, "u", "<p>x</p>"), (4, "u", "<article>" + "<p>word and more.</p>" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("x", F.lit(2))
    got = blocks.main_text(pages).collect()
    assert len(got) == 6 and all(r.text == "" for r in got if r.page_id in (1, 2)) and max(r.n_blocks for r in got) == 5000
    assert blocks.main_text(pages.limit(0)).count() == 0


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang")
    got = languages.op4_language_mixture(spark, SF01).where("held_out").join(docs, "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_a_mixture_finds_both_languages(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    langs, model = languages.learn(docs)
    en, de = (docs.where(f"lang = '{x}' and n_chars between 1500 and 2500").orderBy("doc_id").first().text for x in ("en", "de"))
    names, scores = languages.predict([en, en + "\n" + de[: len(en) // 2], "12 ***"], langs, languages.Likelihoods(model))
    assert names[0] == names[1] == "en" and scores[0] > 0.9 > scores[1] > 0.4 and (names[2], scores[2]) == ("und", 0)


def test_languages_edges(odd, empty):
    got = languages.identify(odd, odd).collect()
    by = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == odd.count() and [by[k] for k in (2, 3, 4, 7)] == ["und"] * 4 and by[5] == "de"
    assert languages.identify(empty, odd).count() == 0 and {r.lang_pred for r in languages.identify(odd, empty).collect()} == {"und"}


def test_quality_keeps_the_good(spark):
    kept = {r.doc_id for r in resample.op5_importance_resampling(spark, SF01).collect()}
    labels = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    good, bad = [r.doc_id in kept for r in labels if r.quality == 1], [r.doc_id in kept for r in labels if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.15


def test_quality_equals_brute_force(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1} - {r.doc_id for r in labels.collect() if r.quality == 0}
    rows = docs.select("doc_id", "text", resample.gumbel(resample.SEED, "doc_id", "text").alias("g")).collect()
    grams = {r.doc_id: Counter(resample.features([r.text or ""])[0].tolist()) for r in rows}
    target, raw = Counter(), Counter()
    for i, c in grams.items():
        raw.update(c)
        target.update(c if i in good else {})
    size = 1 << resample.BITS
    ratio = lambda b: math.log((target[b] + 1) / (sum(target.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size))
    ratios = {b: ratio(b) for b in raw}
    weight = {i: sum(ratios[b] * n for b, n in c.items()) * resample.LENGTH / (sum(c.values()) + resample.EVEN) for i, c in grams.items()}
    key = {r.doc_id: weight[r.doc_id] + r.g for r in rows}
    got = {r.doc_id: r for r in resample.op5_importance_resampling(spark, sf).collect()}
    assert set(got) == set(sorted(key, key=key.get, reverse=True)[: len(got)])
    assert all(np.isclose(r.key, key[i]) and np.isclose(r.log_weight, weight[i]) for i, r in got.items())
    w = np.exp(np.array(list(weight.values())))
    assert abs(resample.draw_size(w, np.ones(len(w))) - len(got)) <= 1
    assert sum(np.exp(weight[i]) for i in got) > 0.999 * w.sum()


def test_the_draw_follows_the_weights(spark):
    """Inclusion by weight is that of drawing one by one without replacement, and the noise decides it."""
    weights = [1.0, 0.1, 0.01, 0.001]
    k = resample.draw_size(np.array(weights), np.full(4, 2500), 0.95)
    df = spark.range(10_000).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("id") % 4 + 1).cast("int")))
    keyed = df.withColumn("key", F.log("w") + resample.gumbel(7, "id"))
    least = resample.kth_largest(keyed, "key", k)
    got = Counter(r.w for r in keyed.where(F.col("key") >= least).collect())
    rng = np.random.default_rng(0)
    w = np.repeat(weights, 2500)
    came = np.argsort(rng.exponential(1 / w))[:k]  # the order of drawing one by one
    want = Counter(w[came].tolist())
    assert sum(got.values()) == k
    for x in weights:
        assert abs(got[x] - want[x]) < 5 * np.sqrt(max(want[x], 4))
    assert 0 < got[0.01] < 2500 and got[0.1] > 5 * got[0.01] > 20 * got[0.001] / 4


def test_kth_largest_equals_sorting(spark):
    rng = np.random.default_rng(2)
    values = [*rng.normal(size=5000).round(3).tolist(), *[1.0] * 3000, -1e9, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 17, 2500, 4000, len(values)):
        assert resample.kth_largest(df, "x", k, 50) == sorted(values, reverse=True)[k - 1]
    assert resample.kth_largest(df, "x", 0) is None and resample.kth_largest(df.limit(0), "x", 1) is None


def test_quality_edges(odd, empty):
    labels = odd.select("doc_id", "quality")
    assert resample.resample(empty, labels).count() == 0
    assert resample.resample(odd, labels.limit(0)).count() == odd.count()
    assert resample.resample(odd, labels).where("doc_id = 1").count() == 2


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").toPandas()
    assert auc(got.score.to_numpy(), got.toxic.to_numpy()) > 0.95 and (got.predicted == got.toxic).mean() > 0.95


def test_toxicity_edges(odd, empty):
    labels = odd.selectExpr("doc_id", "quality as toxic")
    got = toxicity.toxicity(odd, labels).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == odd.count() and by[2] == by[3] == by[4] and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(empty, labels).count() == 0 and {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.5}


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_pipeline_stages_bear_odd_rows(spark, sf, which, request, tmp_path):
    docs = request.getfixturevalue(which)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))


def test_pipeline_decisions_take_effect(spark, sf):
    """Each stage's effect, held against the stage's own operator on the same input."""
    from tesserae.llm import decontaminate, linededup, simhash

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)

    def written(df):
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    kept = written(stages["quality"](spark, docs, sf))
    assert ids(kept) == ids(resample.resample(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    lines = written(stages["repeated lines"](spark, kept, sf))
    want = {r.doc_id: "\n".join(r.kept) for r in linededup.drop_repeated_lines(kept).collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in lines.collect()} == {k: (v, len(v)) for k, v in want.items()}
    near = written(stages["near duplicates"](spark, lines, sf))
    groups = simhash.near_duplicates(lines).collect()
    assert ids(near) == {r.component_id for r in groups}
    clean = stages["benchmark leaks"](spark, near, sf)
    assert ids(clean) == ids(near) - ids(decontaminate.contaminated(near, spark.read.parquet(f"{sf}/benchmark.parquet")))


def test_more_languages_than_any_fixed_number_and_long_texts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    letters = [chr(0x4E00 + 40 * k + j) for k in range(140) for j in range(8)]
    word = lambda k: "".join(rng.choice(letters[8 * k : 8 * k + 8], 4))
    rows = [(k, " ".join(word(k) for _ in range(60)), f"l{k:03d}") for k in range(140)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = languages.identify(df, df).collect()
    assert len(got) == 140 and all(r.lang_pred == f"l{r.doc_id:03d}" for r in got)
    langs, model = languages.learn(df)
    many = [" ".join(r[1] for r in rows[k : k + 5]) for k in (0, 50)]  # five languages in one text
    want = languages.predict(many, langs, languages.Likelihoods(model))
    assert all(s < 0.25 for s in want[1])
    monkeypatch.setattr(languages, "CELLS", 2000)
    monkeypatch.setattr(languages, "REMEMBERED_CELLS", 100)
    of = languages.Likelihoods(model)
    for _ in range(2):
        got = languages.predict(many, langs, of)
        assert got[0] == want[0] and np.allclose(got[1], want[1])
