"""Pages labelled by hand: what stands between « and » is the main text."""

from __future__ import annotations

import re
import time

import pyarrow.parquet as pq
import pytest

from ledgerlens.llm.pages import PRIOR, blocks_of, features, fit, label, main_text, odds

SF = "/root/testdata/sf0.01"
STORIES = [
    ("Harbour bridge reopens", ["The old bridge over the harbour opened again on Monday, after two years of repairs.", "Engineers had replaced most of its cables, and the towers were painted anew.", "Trains will cross it from next spring, the city said."]),
    ("How to bake rye bread", ["Mix the flour with warm water, salt and a spoon of sourdough, and let it rest overnight.", "Short of time? A little yeast will help.", "Bake it for an hour, first hot, then at a lower heat, until the crust is dark."]),
    ("Share prices and what they tell", ["A price is what buyers and sellers agree on, no more.", "It may move because of news, or because of nothing at all, as many studies have found.", "In the long run, profits decide; in the short run, moods do."]),
]
LAYOUTS = [
    "<header><a href=/>Site</a></header><nav><ul><li><a href=1>News</a><li><a href=2>Sport</a></ul></nav><main><article><h1>«{t}»</h1><p>«{a}»</p><p>«{b}»</p><p>«{c}»</p></article></main><footer><p>All rights reserved, by the publisher of this site.</p></footer>",
    "<form id=aspnetForm action=/><div id=wrap><div class=topnav><a href=1>Home</a> <a href=2>About</a></div><main><h1>«{t}»</h1><p>«{a}»</p><p>«{b}»</p><p>«{c}»</p></main><div class=footer>Imprint, terms and privacy.</div></div></form>",
    "<div class=content-sidebar-wrap><article class=post><header class=entry-header><h1>«{t}»</h1></header><div class=entry-content><p>«{a}»</p><p>«{b}»</p><blockquote><p>«{c}»</p></blockquote></div></article><aside class=sidebar><h3>More</h3><ul><li><a href=1>Another story</a></ul></aside></div>",
    "<main><h2>«{t}»</h2><div class=share-price-report><p>«{a}»</p><p>«{b}»</p></div><p>«{c}»</p><div class=share-buttons><a href=1>Send</a> <a href=2>Print</a></div></main>",
    "<article><h1>«{t}»</h1><p>«{a}»</p><section class=related-work><p>«{b}»</p></section><p>«{c}»</p><section id=comments><h2>Comments</h2><p>I liked this a lot, and I will read it again, thanks.</p><p>So did I, but the end was weak, was it not?</p></section></article>",
    "<div id=cookie-banner><p>We use cookies, as all sites do, to make this site better for you.</p><button>Agree</button></div><article><h1>«{t}»</h1><p>«{a}»</p><div class=ad><p>Buy the best shoes now, and get the second pair for free.</p></div><p>«{b}»</p><ul><li>«{c}»</ul></article>",
    "<table><tr><td class=menu><a href=1>One</a><br><a href=2>Two</a></td><td><div role=main><h1>«{t}»</h1><p>«{a}»</p><p>«{b}»</p><p>«{c}»</p></div></td></tr></table><div class=footer-links><a href=1>Help</a></div>",
    "<article><header><h1>«{t}»</h1></header><p>«{a}»</p></article><nav class=pagination><a href=1>Next</a></nav>",
    "<select><option>Choose<option>Other</select><div id=newsletter-signup><p>Sign up for our newsletter, and never miss a story again.</p><form><input><button>Go</button></form></div><main><h1>«{t}»</h1><p>«{a}»</p><p>«{b}»</p></main>",
    "<div class=page><div class=masthead>The Daily</div><div class=story><h1>«{t}»</h1><p>«{a}»</p><p>«{b}»</p><p>«{c}»</p></div><div class=promo><p>Read the paper for four weeks, and pay for two only.</p></div></div>",
    "<article><h1>«{t}»</h1><p>«{a}»</p><figure><img src=x><figcaption>«A view of it all, taken last year.»</figcaption></figure><p>«{b}»</p><form class=subscribe><p>Give us your address, and we write to you each week.</p></form><p>«{c}»</p></article>",
    "<div><div><a href=1>Home</a> <a href=2>About us</a></div><div><h1>«{t}»</h1><p>«{a}»</p><p>«Why so»</p><p>«{b}»</p><p>«We asked»</p><p>«{c}»</p></div></div>",
]
PAGES = [page.format(t=t, a=p[0], b=p[1], c=p[2]) for page in LAYOUTS for t, p in STORIES]


@pytest.fixture(scope="module")
def weights():
    """As the registered query fits them."""
    return fit(pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist())


def test_recall_and_precision(weights):
    assert len(PAGES) >= 30
    for w in (weights,):
        hit = kept = wanted = 0
        for page in PAGES:
            want = " ".join(re.findall("«(.*?)»", page)).split()
            got = main_text(re.sub("[«»]", "", page), w).split()
            left = list(want)
            for word in got:
                if word in left:
                    left.remove(word)
                    hit += 1
            kept, wanted = kept + len(got), wanted + len(want)
        assert hit / wanted >= 0.95 and hit / kept >= 0.95, (hit / wanted, hit / kept)


def test_lost_text_is_kept(weights):
    prose = "The paragraph of this page is long enough to be read, and it has commas, too."
    for page, want in {
        "<form id=aspnetForm><main><p>{}</p></main></form>": prose,
        "<form><article><p>{}</p></article></form>": prose,
        "<main><div class=share-price-report><p>{}</p></div></main>": prose,
        "<main><p>Yes, this is a first sentence of it.</p><div class=share-price-report><p>{}</p></div></main>": f"Yes, this is a first sentence of it. {prose}",
        "<article><p>Yes, this is a first sentence of it.</p><section class=related-work><p>{}</p></section></article>": f"Yes, this is a first sentence of it. {prose}",
        "<article><header><h1>Title</h1></header><p>{}</p></article>": f"Title {prose}",
    }.items():
        for w in (weights, PRIOR):
            assert main_text(page.format(prose), w) == want, page


def test_hostile_pages_take_linear_time(weights):
    for part in ('<div class="ad">x', "<form>x", "<select><div>x", "<p>x<b>", "<section class='related share'>abc, def. ", "<article><div class=ad>hello there.<p>Some text, which is long enough for all.</div>"):
        took = []
        for size in (1 << 18, 1 << 20):
            began = time.process_time()
            main_text(part * (size // len(part)), weights)
            took.append(time.process_time() - began)
        assert took[1] < max(4.0, 8 * took[0]), (part, took)
    assert main_text("<div>" * 50_000 + "</x>" * 50_000 + "x" + "</div>" * 100, weights) in ("", "x")


def test_model_and_cut_decide_beside_the_lists(weights):
    """Shape decides where names are in doubt or missing: some labels differ from what elements alone say, and some from what the model alone says."""
    against = cut = blocks_seen = 0
    for page in PAGES:
        blocks = blocks_of(re.sub("[«»]", "", page))
        said = features(blocks)[:, -2:]
        scores, kept = odds(blocks, weights), label(blocks, weights)
        against += sum((p > n) != k for (p, n), k in zip(said.tolist(), kept, strict=True))
        cut += sum((x > 0) != k for x, k in zip(scores, kept, strict=True))
        blocks_seen += len(blocks)
    assert blocks_seen > 190 and against > 0 and cut > 0
