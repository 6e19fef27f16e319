"""Pages with custom, self-closed and unclosed elements keep what follows."""

import re
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import blocks

AFTER = "<p>article text</p><p>more</p>"


@pytest.mark.parametrize("tag", ["<video-js id='v'></video-js>", "<button-group>", "<select-box/>", "<svg viewBox='0'/>", "<math/>", "<button class=x>", "<select>", "<object data='>'>", "<button>A</button><button>", "<svg>a<svg>b</svg>c</svg>", "<svg><svg/>x</svg>", "<BUTTON>x</button >", "<style>p</style>", "<video><source></video>"])
def test_what_follows_a_dropped_element_is_kept(tag):
    got = [t for _, t, _ in blocks.blocks_of(f"<p>a</p>{tag}{AFTER}")]
    assert got == ["a", "article text", "more"]


def test_raw_text_runs_to_the_end_and_its_like_does_not():
    assert [t for _, t, _ in blocks.blocks_of(f"<p>a</p><script>x{AFTER}")] == ["a"]
    assert [t for _, t, _ in blocks.blocks_of("<button>A<p>b</p><button>C</button><p>d</p>")] == ["A", "b", "d"]


def test_deep_blocks_differ_by_their_whole_path():
    deep = "<div>" * 30 + "<p>x</p>"
    a, b = (blocks.blocks_of(f"<{top} class='c1 c2 c3 c4 c5 c6 {top}'>{deep}") for top in ("article", "nav"))
    assert ".nav" in b[0][0] and not np.array_equal(blocks.vectors(a), blocks.vectors(b))


def _stripped(page):
    page = re.sub(r"\s(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page or "")
    return re.sub(r"(</?)(article|main|nav|footer|aside|header|section|form|menu|dialog|figure)\b", r"\1div", page, flags=re.I)


def _blocks(text):
    return Counter(text.split("\n\n")) if text else Counter()


def test_held_out_pages_without_telling_names(spark):
    """Trained on pages as they are, tried on other pages stripped of classes and telling elements."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    w = blocks.learned(pages.where("page_id % 2 = 0"))
    held = [blocks.blocks_of(r.html or "") for r in pages.where("page_id % 2 = 1").collect()]
    bare = [blocks.blocks_of(_stripped(r.html)) for r in pages.where("page_id % 2 = 1").collect()]
    scores = []
    for b, p, named in zip(bare, blocks.label([blocks.vectors(b) for b in bare], w), held, strict=True):
        got, want = Counter(x[1] for x, q in zip(b, p, strict=True) if q >= 0.5), Counter(t for path, t, _ in named if blocks.weak_label(path) == 1)
        scores.append(2 * sum((got & want).values()) / max(1, sum(got.values()) + sum(want.values())))
    assert sum(scores) / len(scores) > 0.9


def test_pages_without_any_telling_name_are_learned_by_density(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: _blocks(r.text) for r in blocks.main_text(pages).collect()}
    bare = spark.createDataFrame([(r.page_id, r.url, _stripped(r.html)) for r in pages.collect()], "page_id long, url string, html string")
    got = {r.page_id: _blocks(r.text) for r in blocks.main_text(bare).collect()}
    f1 = [2 * sum((got[k] & want[k]).values()) / max(1, sum(got[k].values()) + sum(want[k].values())) for k in want if want[k]]
    assert sum(f1) / len(f1) > 0.7


def test_without_a_label_every_block_is_text(spark):
    pages = spark.createDataFrame([(1, "u", "<p>some words of middling length here</p><p>and a few other words beside them</p>")], "page_id long, url string, html string")
    assert blocks.main_text(pages).first().text == "some words of middling length here\n\nand a few other words beside them"


def test_a_footer_far_above_still_tells():
    deep = blocks.blocks_of("<footer class='a b c d e f g site-footer'>" + "<div>" * 15 + "words" + "</div>" * 15 + "</footer>")
    assert blocks.weak_label(deep[0][0]) == 0 and len(deep[0][0]) > 20


def test_deep_pages_take_time_by_their_length():
    import time

    for page in ("<div>" * 8000 + "x" + "<p>y" * 8000, "".join(f"<div class=c{k}><p>word {k}</p>" for k in range(8000)), "<ul><li>" * 8000 + "x</li>" * 8000):
        began = time.process_time()
        found = blocks.blocks_of(page)
        assert blocks.vectors(found).shape == (len(found), blocks.DIM) and len(blocks.labels_of(found)) == len(found)
        assert len([blocks.plain(p) for p, _, _ in found]) == len(found)
        assert time.process_time() - began < 8  # work by the square of the depth takes longer
    assert len(found[0][0]) == 16_000
    before = list(blocks.blocks_of("<article class='a'><div><p>x</article>")[0][0])
    for k in range(3):  # paths of earlier pages are forgotten
        blocks.blocks_of("".join(f"<div id=n{k}-{n}>" for n in range(blocks.PATHS)) + "x")
    assert list(blocks.blocks_of("<article class='a'><div><p>x</article>")[0][0]) == before == ["article", ".a", "div", "p"]
