"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks.  Each block is a vector of its hashed tag path, its hashed
words and a few measures; a bidirectional LSTM, in numpy, reads the whole sequence and labels
every block with the document around it in view.  It is trained on a bounded sample of the
pages themselves: blocks below telling elements or classes (an article, a menu, a footer)
are its labels.  A page without such names is labelled by density: long, punctuated blocks with
few links are text, short or linked ones aren't, and the others take their label from what was
learned.  Every page is learned twice, with its names and stripped of them, so that pages
without telling names are labelled from words, measures and plain elements.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, short_batches, slices, table, texts_of

#: Pages that training reads at most, those with the least hash of page_id.
TRAIN_PAGES = 400
SEED = 5_113
EPOCHS, BATCH, RATE = 10, 16, 0.02
PATH_DIM, WORD_DIM, HIDDEN = 24, 12, 16
PATH_ROWS, WORD_ROWS = 4096, 4096
DIM = PATH_DIM + WORD_DIM + 6
#: Padded cells (pages x blocks) that are labelled at a time.
CELLS = 40_000

#: Elements whose content is never text of the page.
RAW = "script|style|textarea|title"  #: of these, what is never closed runs to the end of the page
DROPPED = "noscript|template|select|button|svg|math|iframe|object|audio|video|canvas"
ATTRIBUTES = "(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+"
#: The content of a dropped element (group 2) without, and with, an element of its own name inside.
LEAF = r"(?:[^<]++|<(?!/?\2[\s/>]))*+"
NESTED = rf"(?:[^<]++|<(?!/?\2[\s/>])|<\2(?=[\s/>]){ATTRIBUTES}(?:(?<=/)>|>{LEAF}</\2(?=[\s/>])[^>]*+>))*+"
TAG = re.compile(
    rf"<(?:!--.*?(?:-->|\Z)|({RAW})(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*+>|\Z)|(?:svg|math)(?=[\s/>]){ATTRIBUTES}(?<=/)>|({DROPPED})(?=[\s/>]){ATTRIBUTES}>{NESTED}</\2(?=[\s/>])[^>]*+>"
    rf"|(/?)([a-z][a-z0-9:-]*+)({ATTRIBUTES})>|(/?)([a-z][a-z0-9:-]*+)[^>]*+>|[!?/][^>]*+>)",
    re.S | re.I,
)
#: Elements within a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Dropped elements without an end: only their tags go.
UNCLOSED = frozenset(f"{RAW}|{DROPPED}".split("|"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the same name ends.
ENDS_ITSELF = frozenset("li dt dd tr td th option".split())
LISTS = frozenset("ul ol dl table".split())
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

MAIN = re.compile(r"^(article|main)$|^[.](article|main|content|post|story|entry|body)(-|_|$)|(article|entry|post|story)[-_]?(body|content|text)")
REST = re.compile(r"^(nav|footer|aside|form|menu|dialog)$|^[.](ad|ads|advert\w*|banner|promo\w*|sponsor\w*|nav\w*|menu|breadcrumb\w*|sidebar|footer|cookie\w*|consent|notice|alert|popup|modal|comment\w*|share|sharing|social|related|newsletter|subscribe|login|search|navigation|complementary|contentinfo)(-|_|$)")


#: Paths that a worker remembers between pages.
PATHS = 50_000


class Path:
    """An element and those around it: its own names, on top of a path that all its blocks share.

    What is asked of a path (its label, its vector, itself without telling names) is worked out
    once, from the path above, so that a page's work doesn't grow with the depth of its blocks.
    """

    __slots__ = ("above", "own", "size", "told", "below", "vector", "bare")
    made = 0

    def __init__(self, above: Path | None = None, own: tuple[str, ...] = ()) -> None:
        self.above, self.own, self.below = above, own, {}
        self.size, told = (0, 0) if above is None else (above.size + len(own), above.told)
        self.told = told | any(map(REST.search, own)) | any(map(MAIN.search, own)) << 1
        self.vector = self.bare = None
        Path.made += 1

    def __len__(self) -> int:
        return self.size

    def __iter__(self) -> Iterator[str]:
        chain, node = [], self
        while node is not None:
            chain.append(node.own)
            node = node.above
        return (t for own in reversed(chain) for t in own)

    def __getitem__(self, k: int | slice) -> str | tuple[str, ...]:
        return tuple(self)[k]

    def under(self, own: tuple[str, ...]) -> Path:
        found = self.below.get(own)
        if found is None:
            found = self.below[own] = Path(self, own)
        return found

    def _missing(self, what: str) -> list[Path]:
        """The path and those above it for which ``what`` isn't known yet, outermost first."""
        out, node = [], self
        while node is not None and getattr(node, what) is None:
            out.append(node)
            node = node.above
        return out[::-1]

    def total(self, rows: np.ndarray) -> np.ndarray:
        """The sum of the rows of all names."""
        for node in self._missing("vector"):
            node.vector = np.zeros(rows.shape[1], rows.dtype) if node.above is None else node.above.vector
            for t in node.own:
                node.vector = node.vector + rows[zlib.crc32(t.encode("utf-8", "surrogatepass")) % len(rows)]
        return self.vector if self.size else rows[0]


_top = Path()


def blocks_of(page: str) -> list[tuple[Path, str, int]]:
    """Leaf blocks in page order: (path of elements and .classes, text, characters in links)."""
    global _top
    if Path.made > PATHS:
        _top, Path.made = Path(), 0
    out: list[tuple[Path, str, int]] = []
    stack: list[tuple[str, Path]] = []
    places: dict[str, list[int]] = {}  # of open elements in the stack, by name
    parts: list[str] = []
    linked = link = at = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append((stack[-1][1] if stack else _top, text, min(linked, len(text))))
            parts.clear()
            linked = 0

    def pop_to(name: str, barrier: frozenset[str] = frozenset()) -> None:
        k = places[name][-1] if places.get(name) else -1
        if k >= 0 and not any(places[b][-1] > k for b in barrier if places.get(b)):
            while len(stack) > k:
                places[stack.pop()[0]].pop()

    for m in TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += link * (m.start() - at)
        at = m.end()
        name = (m[4] or m[7] or "").lower()
        if not name:
            continue
        end = bool(m[3] or m[6])
        if name in INLINE:
            if name == "a":
                link = 0 if end else 1
            elif name in ("br", "img", "wbr"):
                parts.append(" ")
            continue
        close()
        if end:
            pop_to(name)
            continue
        pop_to("p", LISTS)  # a block's start ends an open paragraph
        if name in ENDS_ITSELF:
            pop_to(name, LISTS)
        if name in VOID or name in UNCLOSED or m[0].endswith("/>"):
            continue
        marks = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(m[5])) if m[5] else ""
        places.setdefault(name, []).append(len(stack))
        stack.append((name, (stack[-1][1] if stack else _top).under((name, *("." + x for x in marks.lower().split())))))
    if at < len(page):
        parts.append(page[at:])
    close()
    return out


def weak_label(path: Path) -> int:
    """1 main text, 0 not, -1 unknown, by the block's ancestors; the innermost telling one but for rest within main."""
    return 0 if path.told & 1 else 1 if path.told & 2 else -1


#: Elements that tell what they hold; stripped of it they are plain ones.
TELLING = frozenset("article main nav footer aside header section form menu dialog figure".split())


def plain(path: Path) -> Path:
    """A path without classes, its telling elements as ``div``."""
    for node in path._missing("bare"):
        own = tuple("div" if t in TELLING else t for t in node.own if not t.startswith("."))
        node.bare = node if node.above is None else node.above.bare.under(own)
    return path.bare


def density_label(text: str, linked: int) -> int:
    """1 for a long, punctuated block with few links, 0 for a short or linked one, -1 between."""
    words = text.count(" ") + 1
    ends = text[-1] in ".!?…\"”"
    if words >= 15 and ends and linked * 10 < 3 * len(text):
        return 1
    return 0 if linked * 2 >= len(text) or (words <= 4 and not ends) else -1


def labels_of(blocks: list[tuple[Path, str, int]]) -> list[int]:
    """Labels of a page's blocks by telling names, or by density if it has none."""
    named = [weak_label(p) for p, _, _ in blocks]
    return named if 1 in named else [density_label(t, k) for _, t, k in blocks]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, dict[str, int]]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(PATH_ROWS, PATH_DIM)).astype(np.float32), (rng.normal(size=(WORD_ROWS, WORD_DIM)) * 2).astype(np.float32), {}


def vectors(blocks: list[tuple[Path, str, int]]) -> np.ndarray:
    """One row a block (of one page or of many): hashed path, hashed words, measures."""
    if not blocks:
        return np.zeros((0, DIM), np.float32)
    path_rows, word_rows, memory = _tables()
    if len(memory) > 300_000:
        memory.clear()
    split = [b[1].split() for b in blocks]
    new = {w for words in split for w in words if w not in memory}
    memory.update((w, zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_ROWS) for w in new)
    n_words = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((memory[w] for words in split for w in words), np.int64, int(n_words.sum()))
    words = np.add.reduceat(word_rows[ids], np.cumsum(n_words) - n_words, axis=0) / n_words[:, None]
    paths = np.stack([p.total(path_rows) for p, _, _ in blocks]) / 2
    chars = np.array([len(t) for _, t, _ in blocks], np.float32)
    measures = np.stack([
        np.log1p(chars) / 3, np.log1p(n_words) / 3, np.array([k for _, _, k in blocks]) / chars,
        np.array([t[-1] in ".!?…\"”" for _, t, _ in blocks]), np.array([t.count(",") + t.count(".") for _, t, _ in blocks]) / np.maximum(1, n_words), np.ones(len(blocks)),
    ], axis=1)
    return np.concatenate((paths, words, measures), axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_weights() -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED + 1)
    out = {}
    for d in "fb":
        out[f"x{d}"] = rng.normal(size=(DIM, 4 * HIDDEN)) / np.sqrt(DIM)
        out[f"h{d}"] = rng.normal(size=(HIDDEN, 4 * HIDDEN)) / np.sqrt(HIDDEN)
        out[f"b{d}"] = np.concatenate((np.ones(HIDDEN), np.zeros(3 * HIDDEN)))
    out["o"] = rng.normal(size=(2 * HIDDEN, 1)) / np.sqrt(2 * HIDDEN)
    out["c"] = np.zeros(1)
    return out


def _run(x: np.ndarray, w: dict[str, np.ndarray], d: str, keep: list | None = None) -> np.ndarray:
    """Hidden states (pages, blocks, HIDDEN) of one direction; gates in the order forget, input, output, cell."""
    pages, steps, _ = x.shape
    from_x = x @ w[f"x{d}"] + w[f"b{d}"]
    h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    out = np.empty((pages, steps, HIDDEN))
    for t in range(steps):
        g = from_x[:, t] + h @ w[f"h{d}"]
        fio = _sigmoid(g[:, : 3 * HIDDEN])
        cell = np.tanh(g[:, 3 * HIDDEN :])
        before, h_before = c, h
        c = fio[:, :HIDDEN] * before + fio[:, HIDDEN : 2 * HIDDEN] * cell
        tc = np.tanh(c)
        h = fio[:, 2 * HIDDEN :] * tc
        out[:, t] = h
        if keep is not None:
            keep.append((fio, cell, before, h_before, tc))
    return out


def _back(x: np.ndarray, w: dict[str, np.ndarray], d: str, keep: list, dout: np.ndarray, grad: dict[str, np.ndarray]) -> None:
    pages, steps, _ = x.shape
    dh, dc = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
    dg_all = np.empty((pages, steps, 4 * HIDDEN))
    for t in range(steps - 1, -1, -1):
        fio, cell, before, h_before, tc = keep[t]
        f, i, o = fio[:, :HIDDEN], fio[:, HIDDEN : 2 * HIDDEN], fio[:, 2 * HIDDEN :]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dg = np.concatenate((dc * before * f * (1 - f), dc * cell * i * (1 - i), dh * tc * o * (1 - o), dc * i * (1 - cell * cell)), axis=1)
        dg_all[:, t] = dg
        grad[f"h{d}"] += h_before.T @ dg
        dh, dc = dg @ w[f"h{d}"].T, dc * f
    flat = dg_all.reshape(-1, 4 * HIDDEN)
    grad[f"x{d}"] += x.reshape(-1, DIM).T @ flat
    grad[f"b{d}"] += flat.sum(axis=0)


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded vectors, the mask of true cells, and for each cell the cell that mirrors it in its own page."""
    steps = max(map(len, rows))
    x = np.zeros((len(rows), steps, DIM))
    mask = np.zeros((len(rows), steps), bool)
    mirror = np.tile(np.arange(steps), (len(rows), 1))
    for k, r in enumerate(rows):
        x[k, : len(r)] = r
        mask[k, : len(r)] = True
        mirror[k, : len(r)] = np.arange(len(r))[::-1]
    return x, mask, mirror


def label(rows: list[np.ndarray], w: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Probability of main text for every block of every page."""
    out: list[np.ndarray] = [np.zeros(0)] * len(rows)
    order = sorted((k for k in range(len(rows)) if len(rows[k])), key=lambda k: len(rows[k]))
    while order:
        steps = len(rows[order[0]])
        take = 1
        while take < len(order) and (take + 1) * len(rows[order[take]]) <= CELLS and len(rows[order[take]]) <= 2 * steps + 8:
            take += 1
        some, order = order[:take], order[take:]
        x, _, mirror = _padded([rows[k] for k in some])
        flip = mirror[:, :, None]
        h = np.concatenate((_run(x, w, "f"), np.take_along_axis(_run(np.take_along_axis(x, flip, 1), w, "b"), flip, 1)), axis=2)
        p = _sigmoid((h @ w["o"])[:, :, 0] + w["c"])
        for k, r in zip(some, p, strict=True):
            out[k] = r[: len(rows[k])]
    return out


def train(rows: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Weights by Adam on the cross-entropy of blocks with a label."""
    w = new_weights()
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    known = [k for k in range(len(rows)) if len(rows[k]) and (labels[k] >= 0).any()]
    if not known:  # nothing to learn from: every block is text
        return w | {"o": np.zeros_like(w["o"]), "c": np.full(1, 9.0)}
    rng = np.random.default_rng(SEED + 2)
    step = 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(known)
        for a in range(0, len(shuffled), BATCH):
            some = shuffled[a : a + BATCH].tolist()
            x, _, mirror = _padded([rows[k] for k in some])
            y = np.full(mirror.shape, -1.0)
            for r, k in enumerate(some):
                y[r, : len(labels[k])] = labels[k]
            flip = mirror[:, :, None]
            back_x = np.take_along_axis(x, flip, 1)
            keep_f: list = []
            keep_b: list = []
            hf, hb = _run(x, w, "f", keep_f), np.take_along_axis(_run(back_x, w, "b", keep_b), flip, 1)
            h = np.concatenate((hf, hb), axis=2)
            p = _sigmoid((h @ w["o"])[:, :, 0] + w["c"])
            dz = np.where(y >= 0, p - y, 0.0) / max(1, (y >= 0).sum())
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            grad["o"] = h.reshape(-1, 2 * HIDDEN).T @ dz.reshape(-1, 1)
            grad["c"] = np.array([dz.sum()])
            dh = dz[:, :, None] * w["o"][:, 0]
            _back(x, w, "f", keep_f, dh[:, :, :HIDDEN], grad)
            _back(back_x, w, "b", keep_b, np.take_along_axis(dh[:, :, HIDDEN:], flip, 1), grad)
            step += 1
            for k in w:
                g = np.clip(grad[k], -1, 1)
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                w[k] = w[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return w


def learned(pages: DataFrame, most: int = TRAIN_PAGES) -> dict[str, np.ndarray]:
    """Weights from a bounded sample of pages; one task trains, the driver gets the weights."""
    sample = pages.where("page_id is not null and html is not null").select(F.col("page_id").cast("long").alias("page_id")).distinct().orderBy(F.xxhash64(F.lit(SEED), "page_id"), "page_id").limit(most)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [blocks_of(t) for t in texts_of(batch, "html")]
            x = [vectors(b).tobytes() for b in found]
            bare = [vectors([(plain(p), t, k) for p, t, k in b]).tobytes() for b in found]
            y = [np.array(labels_of(b), np.int8).tobytes() for b in found]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), *(pa.array(v, pa.binary()) for v in (x, bare, y))], names=["page_id", "x", "bare", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        rows = [np.frombuffer(v, np.float32).reshape(-1, DIM) for _, x, bare, _ in got for v in (x, bare)]
        w = train(rows, [np.frombuffer(y, np.int8) for _, _, _, y in got for _ in range(2)])
        yield pa.RecordBatch.from_arrays([pa.array(list(w)), pa.array([v.astype(float).ravel().tolist() for v in w.values()])], names=["name", "w"])

    some = pages.select(F.col("page_id").cast("long").alias("page_id"), "html").join(F.broadcast(sample), "page_id")  # most ids
    rows = some.mapInArrow(extract, "page_id long, x binary, bare binary, y binary").repartition(1).mapInArrow(fit, "name string, w array<double>").collect()
    shapes = new_weights()
    got = {r.name: np.array(r.w).reshape(shapes[r.name].shape) for r in rows}
    return got if got else train([], [])


def main_text(pages: DataFrame, least: float = 0.5) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_main`` of every page.

    text joins the blocks labelled main, in page order, by an empty line; references are decoded
    and white space within a block is one space.  Null or empty html gives the empty string.
    Repeated pages come out repeatedly; an empty table gives an empty table.  If no page of the
    sample has a block that names or density label, every block is text.
    """
    w = learned(short_batches(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [blocks_of(t) for t in texts_of(batch, "html")]
            x = vectors([b for page in found for b in page])
            cuts = np.cumsum([len(b) for b in found])[:-1]
            chosen = [np.flatnonzero(p >= least).tolist() for p in label(np.split(x, cuts), w)]
            texts = ["\n\n".join(b[k][1] for k in ks) for b, ks in zip(found, chosen, strict=True)]
            columns = [pa.array(texts, pa.string()), *(pa.array(v, pa.int64()) for v in ([len(t) for t in texts], [len(b) for b in found], [len(k) for k in chosen]))]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), *columns], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_main long")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
