"""Main text of web pages by a recurrent block labeller (operator 3).

A lenient parser cuts a page into leaf blocks: runs of text between block-level tags, with the path of open
tags. Scripts, styles, comments and form controls never make blocks: a RAW element ends at its own literal end
tag, whatever stands in it; an UNSHOWN one without an end tag hides only the text that follows it at once. Formulas are
text. A quote opens an attribute's value only after "=". Each block has a vector of its tag
path (hashed tag names, class, id and role words), a vector of its hashed words, and a few measures. A
bidirectional LSTM in numpy reads the vectors of a page in order, so each label depends on the whole page,
and classifies every block as main text or not.

The weights are trained here, on at most `train_pages` pages chosen by a hash of the id. Their first labels
come from what page authors state: blocks in `article` or `main` are main text unless an element of a
boilerplate kind lies between. Altered copies of the training pages teach the labeller to use context and
class names and nothing else: containers are renamed, lists, tables, quotes, code and captions hold main text and
boilerplate alike, and menus, notices, adverts, forms and comments are put in anywhere.

Character references are decoded, white space in a block becomes one space, blocks are trimmed and joined
by line breaks in page order; nothing is capped. A NULL or empty html, and a page without main text, give
the empty string. Pages are labelled in batches of like length, of at most STEPS blocks with the padding; a longer
page is read alone, CHUNK blocks at a time in either direction. A page's labels do not depend on the others in
its batch. Equal page_ids are pages of their own, and other columns of the input are dropped.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import slices

PATHS, WORDS, MEASURES, HIDDEN, BATCH = 256, 24, 8, 16, 128
STEPS, CHUNK = 1 << 14, 1 << 12
INPUTS = PATHS + WORDS + MEASURES

# HTML element kinds and the usual names of page parts.
RAW = frozenset("script style title textarea noscript iframe".split())
UNSHOWN = frozenset("template svg select button object video audio canvas annotation annotation-xml".split())
OPTIONS = frozenset("option optgroup".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MATH = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom mspace msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark meter nobr output picture progress q rb rp rt rtc ruby s samp small source span strike strong sub sup time track tt u var wbr img br input".split()) | MATH
PHRASES = frozenset("p h1 h2 h3 h4 h5 h6 li td th dt dd figcaption caption summary pre".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
MAIN = frozenset("article main content post entry story body-text maincontent post-content entry-content article-body".split())
OTHER = frozenset("nav aside footer header form menu sidebar comment comments reply notice notices cookie cookies consent banner ad ads advert adverts advertisement sponsored promo newsletter subscribe related share social breadcrumb breadcrumbs login signup search copyright widget pagination toolbar popup modal".split())

# A quote opens a value only after "=", and closes it where a name, "/" or ">" can follow, or before the next ">".
_VALUE = r"""=\s*+(?:"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>])|"[^">]*+"|'[^'>]*+')"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:{_VALUE}|[^>])*+)>|<[!?][^>]*>|[^<]+|<", re.DOTALL)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE) for tag in RAW}
_SPANS = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in UNSHOWN}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_PART = re.compile(r"[\s_]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # of each open element: its tag and names, from the outside
    linked: int = 0  # characters in links
    tags: frozenset[str] = field(default_factory=frozenset)


def _unshown_end(page: str, tag: str, at: int) -> int:
    """Where an element that is not shown ends: after its end tag, or, if that is missing, where its own text does. A
    button does not hold another one, so the end tag of a later one is not its own."""
    deep = 1
    for token in _SPANS[tag].finditer(page, at):
        if not token[1] and tag in ("button", "select"):
            break
        deep += -1 if token[1] else not token[0].endswith("/>")
        if not deep:
            return token.end()
    own = page.find("<", at)
    return own if own >= 0 else len(page)


def parse_blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    blocks: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # tag, tag and names, whether it is inline
    text: list[str] = []
    at = linked = links = 0

    def close() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                blocks.append(Block(joined, tuple(name for _, name, inline in stack if not inline), linked))
        text, linked = [], 0

    def cut(low: int) -> None:
        nonlocal links
        links -= sum(x[0] == "a" for x in stack[low:])
        del stack[low:]

    while token := _TOKEN.match(page, at):
        at = token.end()
        tag = token[2]
        if tag is None:
            piece = token[0]
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                linked += len(piece) if links else 0
            continue
        tag = tag.lower()
        if token[1]:
            low = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if not (tag in INLINE or tag in UNSHOWN or tag in RAW or tag in OPTIONS or low is None and "-" in tag or low is not None and stack[low][2]):
                close()
            if low is not None and not (stack[low][2] and any(not x[2] for x in stack[low:])):
                cut(low)
            continue
        if tag in RAW:
            if not token[0].endswith("/>"):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in UNSHOWN:
            at = at if token[0].endswith("/>") else _unshown_end(page, tag, at)
            continue
        if tag in OPTIONS:
            at = at if (own := page.find("<", at)) < 0 else own
            continue
        # an element of the page's own kind is inline where a phrase is under way
        inline = tag in INLINE or "-" in tag and bool(stack and (stack[-1][2] or stack[-1][0] in PHRASES) or "".join(text).strip())
        if not inline:
            close()
        elif tag == "br":
            text.append(" ")
        if tag in VOID or token[0].endswith("/>") and tag in MATH:
            continue
        closes = CLOSES.get(tag, {"p"})
        while stack and not inline and (stack[-1][0] in closes or stack[-1][2]):
            cut(len(stack) - 1)
        names = " ".join(x for m in _NAMES.findall(token[3]) for x in m if x).lower() if token[3] and "=" in token[3] else ""
        stack.append((tag, f"{tag} {names}" if names else tag, inline))
        links += tag == "a"
    close()
    return blocks


def kinds_of(path: tuple[str, ...]) -> tuple[bool, bool]:
    """Whether a path has an element of a main kind, and one of a boilerplate kind; the header of a main element is part
    of it."""
    main = other = False
    for name in path:
        words = set(_PART.split(name))
        other = other or bool(words & OTHER) and not (main and words & OTHER == {"header"})
        main = main or bool(words & MAIN)
    return main, other


def stated_labels(blocks: list[Block]) -> list[int]:
    """1 where a block lies in an element of a main kind and in none of a boilerplate kind."""
    return [int(main and not other) for main, other in (kinds_of(b.path) for b in blocks)]


def vectors(blocks: list[Block]) -> np.ndarray:
    """Input vectors of a page's blocks."""
    out = np.zeros((len(blocks), INPUTS), np.float32)
    for row, block in zip(out, blocks, strict=True):
        depth = len(block.path)
        for k, name in enumerate(block.path):
            for word in _PART.split(name):
                row[zlib.crc32(word.encode()) % PATHS] += 1
        words = block.text.split()
        for word, n in Counter(words).items():
            row[PATHS + zlib.crc32(word.lower().encode()) % WORDS] += n
        n = len(words)
        row[PATHS : PATHS + WORDS] /= n
        marks = sum(block.text.count(c) for c in ".,;:!?")
        row[PATHS + WORDS :] = (np.log1p(n) / 4, min(1.0, block.linked / len(block.text)), marks / n, depth / 8, block.text[-1] in ".!?", 1, *kinds_of(block.path))
    return np.minimum(out, 3)


class Labeller:
    """Bidirectional LSTM with one output per block."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(INPUTS + HIDDEN)
        self.p = {f"{d}{n}": (rng.normal(0, scale, shape)).astype(np.float32) for d in "fb" for n, shape in (("x", (INPUTS, 4 * HIDDEN)), ("h", (HIDDEN, 4 * HIDDEN)), ("c", (4 * HIDDEN,)))}
        for d in "fb":
            self.p[f"{d}c"][:] = 0
            self.p[f"{d}c"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.p |= {"out": rng.normal(0, scale, 2 * HIDDEN).astype(np.float32), "skip": np.zeros(INPUTS, np.float32), "bias": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, state: tuple[np.ndarray, np.ndarray] | None = None):
        """Hidden states of a direction over x (steps, pages, inputs), what the gradients need, and the last state."""
        steps, pages, _ = x.shape
        h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
        out = np.zeros((steps, pages, HIDDEN), np.float32)
        past = []
        given = x @ self.p[f"{d}x"] + self.p[f"{d}c"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[t] + h @ self.p[f"{d}h"]
            i, f, o = (1 / (1 + np.exp(-np.clip(z[:, k * HIDDEN : (k + 1) * HIDDEN], -20, 20))) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c2 = f * c + i * g
            squashed = np.tanh(c2)
            if keep:
                past.append((t, h, c, i, f, o, g, squashed))
            h, c = np.where(m, o * squashed, h), np.where(m, c2, c)
            out[t] = h
        return out, past, (h, c)

    def forward(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Probability of main text, (steps, pages)."""
        f, b = (self._run(x, mask, d, False)[0] for d in "fb")
        z = f @ self.p["out"][:HIDDEN] + b @ self.p["out"][HIDDEN:] + x @ self.p["skip"] + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(z, -20, 20)))

    def long_page(self, blocks: list[Block]) -> np.ndarray:
        """As `forward` of one page, whose vectors are made and read CHUNK blocks at a time."""
        z = np.zeros(len(blocks), np.float32)
        cuts = [(low, min(low + CHUNK, len(blocks))) for low in range(0, len(blocks), CHUNK)]
        for d, way, w in (("f", cuts, self.p["out"][:HIDDEN]), ("b", cuts[::-1], self.p["out"][HIDDEN:])):
            state = None
            for low, high in way:
                x = vectors(blocks[low:high])[:, None]
                out, _, state = self._run(x, np.ones(x.shape[:2], bool), d, False, state)
                z[low:high] += out[:, 0] @ w + (x[:, 0] @ self.p["skip"] + self.p["bias"] if d == "f" else 0)
        return 1 / (1 + np.exp(-np.clip(z, -20, 20)))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        f, past_f, _ = self._run(x, mask, "f", True)
        b, past_b, _ = self._run(x, mask, "b", True)
        z = f @ self.p["out"][:HIDDEN] + b @ self.p["out"][HIDDEN:] + x @ self.p["skip"] + self.p["bias"]
        error = np.where(mask, 1 / (1 + np.exp(-np.clip(z, -20, 20))) - y, 0).astype(np.float32) / mask.sum()
        g = {"out": np.concatenate([(error[..., None] * s).sum((0, 1)) for s in (f, b)]), "skip": (error[..., None] * x).sum((0, 1)), "bias": np.array([error.sum()], np.float32)}
        for d, past, w in (("f", past_f, self.p["out"][:HIDDEN]), ("b", past_b, self.p["out"][HIDDEN:])):
            g |= {f"{d}{n}": np.zeros_like(self.p[f"{d}{n}"]) for n in "xhc"}
            dh, dc = np.zeros((x.shape[1], HIDDEN), np.float32), np.zeros((x.shape[1], HIDDEN), np.float32)
            for t, h, c, i, fg, o, gate, squashed in reversed(past):
                m = mask[t][:, None]
                dh = dh + error[t][:, None] * w
                out, cell = np.where(m, dh, 0), np.where(m, dc, 0)
                cell = cell + out * o * (1 - squashed**2)
                dz = np.concatenate((cell * gate * i * (1 - i), cell * c * fg * (1 - fg), out * squashed * o * (1 - o), cell * i * (1 - gate**2)), 1)
                g[f"{d}x"] += x[t].T @ dz
                g[f"{d}h"] += h.T @ dz
                g[f"{d}c"] += dz.sum(0)
                dh = np.where(m, dz @ self.p[f"{d}h"].T, dh)
                dc = np.where(m, cell * fg, dc)
        return g

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 12, rate: float = 0.02, batch: int = 32, seed: int = 7) -> None:
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        order = sorted(range(len(pages)), key=lambda k: len(pages[k][1]))
        groups = [order[k : k + batch] for k in range(0, len(order), batch)]
        for done in range(rounds):
            pace = rate * (1 - done / rounds)
            for k in rng.permutation(len(groups)):
                x, mask = padded([pages[j][0] for j in groups[k]])
                y = np.zeros(mask.shape, np.float32)
                for col, j in enumerate(groups[k]):
                    y[: len(pages[j][1]), col] = pages[j][1]
                step += 1
                for name, value in self.gradients(x, mask, y).items():
                    value = np.clip(value, -1, 1)
                    first[name] += 0.1 * (value - first[name])
                    second[name] += 0.001 * (value**2 - second[name])
                    self.p[name] -= pace * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages), default=0)
    x = np.zeros((longest, len(pages), INPUTS), np.float32)
    mask = np.zeros((longest, len(pages)), bool)
    for k, page in enumerate(pages):
        x[: len(page), k] = page
        mask[: len(page), k] = True
    return x, mask


# What a block can stand in, in main text and boilerplate alike.
LEAVES = [tuple(x.split()) for x in ("p", "p", "p", "", "ul li", "ol li", "ul li p", "table tr td", "table tbody tr td", "table tr th", "blockquote p", "blockquote", "pre", "figure figcaption", "dl dt", "dl dd", "h1", "h2", "h3", "h4", "div", "section p", "section h2", "div p", "details summary", "address", "center")]
WRAPPERS = [(), (), (), ("div",), ("div wrapper",), ("section",), ("div container", "div row"), ("div inner",), ("center",)]


def altered(blocks: list[Block], labels: list[int], rng: np.random.Generator) -> tuple[list[Block], list[int]]:
    """A copy of a page in which only the kinds of its parts tell main text from boilerplate: the main container gets
    another name, or none; blocks of either kind stand in leaves and wrappers drawn from the same ones, with texts and
    links of any block; boilerplate of other kinds is put in anywhere, and more main text beside main text."""
    mains, others, texts = sorted(MAIN), sorted(OTHER), [b.text for b in blocks] or ["menu"]
    draw = lambda items: items[rng.integers(len(items))]
    name = draw(mains)
    name = name if name in ("article", "main") else draw(("div", "section")) + " " + name
    name = draw(("div", "section")) if rng.random() < 0.15 else name
    wrapped = draw(WRAPPERS)

    def part(path: tuple[str, ...], kinds: frozenset[str]) -> int:
        return next((k + 1 for k, n in enumerate(path) if set(_PART.split(n)) & kinds), 0)

    def block(text: str, path: tuple[str, ...], linked: int) -> Block:
        if rng.random() < 0.5:
            text = draw(texts)
            if rng.random() < 0.5:
                text = " ".join(text.split()[: 1 + rng.integers(4)])
            linked = len(text) if rng.random() < 0.3 else 0
        return Block(text, path, linked)

    out, marks, body = [], [], ("html", "body")
    for b, y in zip(blocks, labels, strict=True):
        low = part(b.path, MAIN if y else OTHER)
        if y:
            body = (*b.path[: low - 1], *wrapped, name)
            for _ in range(1 + (rng.integers(1, 4) if rng.random() < 0.2 else 0)):
                leaf = b.path[low:] if rng.random() < 0.4 else (("header", draw(("h1", "p"))) if rng.random() < 0.08 else draw(WRAPPERS) + draw(LEAVES))
                out.append(block(b.text, (*body, *leaf), b.linked))
                marks.append(1)
        else:
            leaf = b.path[low:] if not low or rng.random() < 0.4 else draw(WRAPPERS) + draw(LEAVES)
            out.append(block(b.text, (*b.path[:low], *leaf), b.linked) if low else b)
            marks.append(0)
    for _ in range(rng.integers(1, 6)):
        at = int(rng.integers(len(out) + 1))
        near = out[max(0, at - 1)].path if out else ("html", "body")
        other = draw(others)
        own = other if other in ("nav", "aside", "footer", "header", "form") and rng.random() < 0.7 else draw(("div", "section", "ul", "p")) + " " + other
        inside = rng.random() < 0.6 and not own.startswith("header")  # a header inside would be the article's
        base = near[: next((k for k, n in enumerate(near) if set(_PART.split(n)) & OTHER), len(near))] if inside else near[:2]
        run = [block(draw(texts), (*base, own, *draw(WRAPPERS), *draw(LEAVES)), 0) for _ in range(rng.integers(1, 5))]
        out[at:at] = run
        marks[at:at] = [0] * len(run)
    return out, marks


def train_labeller(pages: list[str], examples: int = 1200, longest: int = 60, seed: int = 7) -> Labeller:
    """Trains on `pages` and altered copies of them, about `examples` in all; training reads at most
    `longest` blocks in a row of one."""
    rng = np.random.default_rng(seed)
    copies = max(2, examples // max(1, len(pages)) - 1)
    data = []
    for page in pages:
        blocks = parse_blocks(page or "")
        labels = stated_labels(blocks)
        for b, y in ((blocks, labels), *(altered(blocks, labels, rng) for _ in range(copies))):
            if b:
                low = int(rng.integers(max(1, len(b) - longest)))
                data.append((vectors(b[low : low + longest]), np.array(y[low : low + longest], np.float32)))
    labeller = Labeller(seed)
    if data:
        labeller.train(data)
    return labeller


def extract(labeller: Labeller, pages: list[str]) -> list[str]:
    """Main text of each page of a batch."""
    blocks = [parse_blocks(p) for p in pages]
    out = [""] * len(pages)
    main: dict[int, np.ndarray] = {}
    for own in _batches([len(b) for b in blocks]):
        if len(blocks[own[0]]) > STEPS:
            main[own[0]] = labeller.long_page(blocks[own[0]]) > 0.5
        else:
            labels = labeller.forward(*padded([vectors(blocks[k]) for k in own])) > 0.5
            main |= {k: labels[:, col] for col, k in enumerate(own)}
    for k, labels in main.items():
        out[k] = "\n".join(b.text for b, m in zip(blocks[k], labels, strict=False) if m)
    return out


def _batches(sizes: list[int]) -> Iterator[list[int]]:
    """Pages with blocks, in batches of like length: up to BATCH pages and STEPS blocks, or one page."""
    batch: list[int] = []
    for k in sorted((k for k, n in enumerate(sizes) if n), key=lambda k: sizes[k]):
        if batch and (len(batch) == BATCH or sizes[k] * (len(batch) + 1) > STEPS):
            yield batch
            batch = []
        batch.append(k)
    if batch:
        yield batch


def main_text(pages: DataFrame, train_pages: int = 256) -> DataFrame:
    """Per page: page_id, url, text, n_chars.

    Training reads one page of each of at most `train_pages` ids, chosen before any html is read for it.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    ids = own.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages)
    chosen = own.join(F.broadcast(ids), "page_id", "left_semi").groupBy("page_id").agg(F.min("html").alias("html"))
    sample = sorted(chosen.collect(), key=lambda r: r["page_id"])
    labeller = pages.sparkSession.sparkContext.broadcast(train_labeller([r["html"] for r in sample]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            text = extract(labeller.value, part.column("html").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return own.mapInArrow(label, "page_id long, url string, text string, n_chars long")
