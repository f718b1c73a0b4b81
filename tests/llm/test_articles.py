"""Operator 3: articles of many kinds of elements, and markup that is broken or inline."""

import random
import time

import pytest
from pyspark.sql import functions as F

from factorspark.llm import html_extract


def _article(rng):
    """A page with an article of many kinds of elements, and the lines of its main text."""
    words = "the of harvest year better than feared prices fell and market town river old new plan was made by many people".split()
    said = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    parts, want = [], []
    for k in [8] + [rng.randrange(8) for _ in range(rng.randrange(2, 9))]:
        own = [said(rng.randrange(1, 4)) for _ in range(4)] if k in (3, 4) else [said(rng.randrange(4, 40))]
        body = own[0]
        parts.append(
            {3: "<ul>" + "".join(f"<li>{x}</li>" for x in own) + "</ul>", 4: "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in zip(own[::2], own[1::2])) + "</table>", 5: f"<blockquote>{body}</blockquote>", 6: f"<figure><img src=x><figcaption>{body}</figcaption></figure>", 7: f"<pre><code>{body}</code></pre>", 8: f"<header><h1>{body}</h1></header>"}.get(k, f"<p>{body}</p>")
        )
        want += own
    if rng.random() < 0.5:
        parts.insert(rng.randrange(len(parts) + 1), f"<aside><p>{said(9)}</p></aside>")
    head, tail = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")])
    extra = rng.choice(["", f"<div class=sidebar><ul><li>{said(3)}</li></ul></div>", f"<div class='cookie notice'>{said(8)}</div>", f"<form><p>{said(3)}</p></form>"])
    return f"<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class=ad>Buy now.</div>{extra}{head}{''.join(parts)}{tail}<footer>&copy; 2020</footer></body></html>", want


@pytest.mark.parametrize("sf", ["sf0.1", "sf0.01"])
def test_articles_come_out_whole_whatever_the_sample(spark, data, sf):
    pages = spark.read.parquet(f"{data.rsplit('/', 1)[0]}/{sf}/pages.parquet").orderBy(F.xxhash64("page_id")).limit(256)
    labeller = html_extract.train_labeller([r.html for r in pages.collect()])
    rng = random.Random(11)
    made = [_article(rng) for _ in range(200)]
    found = html_extract.extract(labeller, [p for p, _ in made])
    assert [f.split("\n") for f in found] == [w for _, w in made]
    plain = "<html><body><div>The harvest was better than feared.</div><div>Prices fell again.</div></body></html>"
    assert html_extract.extract(labeller, [plain]) == ["The harvest was better than feared.\nPrices fell again."]


def test_broken_and_inline_markup():
    lines = lambda page: [b.text for b in html_extract.parse_blocks(page)]
    assert lines("<p don't>Hello</p><p>next it's para</p>") == ["Hello", "next it's para"]
    assert lines('<p class="x>Hello</p><p class="y">next</p>') == ["Hello", "next"]
    assert lines("<p title=\"a > b\">one</p><a href='x'y>two</a>") == ["one", "two"]
    assert lines("<article><button>Go<p>one</p><p>two</p></article>") == ["one", "two"]
    assert lines("<article><template>Go<p>one</p></article><button>x</button>end") == ["one", "end"]
    assert lines("<p>a<svg><g/></svg>b <button>Go</button>c <video>no</video>d <ruby>k<rt>r</rt></ruby> <output>5</output> <big>g</big> <x-y>i</x-y>.</p>") == ["ab c d kr 5 g i."]
    assert lines("<x-app><p>one</p></x-app><p>two</p>") == ["one", "two"]
    assert lines("<select><option>a<option>b</select>c<select><option>d<p>e</p>") == ["c", "e"]
    began = time.process_time()
    lines("<p " + "a='x\" " * 50_000)
    lines("<button>x" * 50_000)
    assert time.process_time() - began < 20  # no part of a page is read again and again
