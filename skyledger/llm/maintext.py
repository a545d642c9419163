"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of text blocks; a bidirectional LSTM reads hashed
vectors of each block's tags and words and labels every block in the light of
all others of the page.

The labeller is trained here, on a bounded sample: ``SAMPLE`` pages, the ones of
least hash. Markup that says what it is (article, nav, class names) labels the
blocks of the sample; rearranged pages made from the sample's own texts, with
other containers and with sidebars, notices, forms and comments, teach it to
tell these parts apart when the markup says less. Every page is then labelled
where it is read.

Edge cases: null or empty html, and a page without text, give the empty text and
0 characters. Unclosed or cut tags are closed by what follows. A null url or id
stays; repeated rows are rows of their own; an empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.blocks import Block, parse
from skyledger.llm.labeller import Labeller, vectors

#: Pages the labeller is trained on, and rearranged pages made of each.
SAMPLE, VARIANTS = 160, 4

# Words in tags, classes, ids and roles that tell main text from the rest.
MAIN = frozenset("article main .article .post .entry .story .content .body .main".split())
REST = frozenset(
    "nav header footer aside form button menu dialog .nav .navbar .navigation .menu .breadcrumb .header"
    " .footer .sidebar .widget .ad .ads .advert .advertisement .banner .promo .sponsored .notice .cookie"
    " .cookies .consent .alert .popup .modal .newsletter .subscribe .signup .login .share .social .related"
    " .comment .comments .reply .disqus .copyright .tags .pagination .complementary .contentinfo".split()
)


def teacher(block: Block) -> int:
    """1 main text, 0 not, -1 where the markup does not say."""
    rest = block.place.summed("rest", False, lambda before, tokens: before or not REST.isdisjoint(tokens))
    main = block.place.summed("main", False, lambda before, tokens: before or not MAIN.isdisjoint(tokens))
    return 0 if rest else 1 if block.marked or main else -1


_CONTAINERS = (
    ("<article>", "</article>"),
    ("<main>", "</main>"),
    ("<main><article>", "</article></main>"),
    ('<div class="content">', "</div>"),
    ('<div id="main-content"><div class="post-body">', "</div></div>"),
    ('<section class="entry story">', "</section>"),
    ('<div class="page"><div class="text">', "</div></div>"),
    ("<div><div>", "</div></div>"),
)
_ASIDES = (
    ("<aside>", "</aside>"),
    ('<div class="sidebar">', "</div>"),
    ('<div class="widget related">', "</div>"),
    ('<div id="cookie-notice">', "</div>"),
    ('<div class="notice">', "</div>"),
    ('<div class="ad">', "</div>"),
    ('<div class="advert banner">', "</div>"),
    ('<section class="newsletter">', "</section>"),
    ('<form action="/search">', "</form>"),
    ('<div class="share social">', "</div>"),
)
_COMMENTS = (
    ('<section id="comments">', '<div class="comment">', "</div>", "</section>"),
    ('<div class="comments">', "<p>", "</p>", "</div>"),
    ('<ol class="comment-list">', "<li>", "</li>", "</ol>"),
)
_MENUS = (
    ("<nav><ul>", "</ul></nav>"),
    ('<div class="menu"><ul>', "</ul></div>"),
    ("<header><nav><ul>", "</ul></nav></header>"),
    ('<ul class="nav">', "</ul>"),
)
_HEADERS = (
    ("<header><h1>", "</h1></header>"),
    ('<div id="header"><h2>', "</h2></div>"),
    ('<div class="banner"><p>', "</p></div>"),
)
_FOOTERS = (("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="copyright">', "</div>"))


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def _rearranged(main: list[str], rest: list[str], draw: random.Random) -> str:
    """A page of these texts; what is main text is marked, unseen by the vectors."""
    some = lambda: _escaped(draw.choice(rest))

    def aside() -> str:
        opens, closes = draw.choice(_ASIDES)
        inner = "".join(draw.choice(("<p>{}</p>", "<h3>{}</h3>", "{}", "<ul><li><a href='#'>{}</a></li></ul>")).format(some()) for _ in range(draw.randint(1, 4)))
        if opens.startswith("<form"):
            inner += "<label>{}</label><button>{}</button>".format(some(), some())
        return f"{opens}{inner}{closes}"

    opens, closes = draw.choice(_MENUS)
    menu = opens + "".join(f"<li><a href='/x'>{_escaped(w)}</a></li>" for w in some().split()[: draw.randint(2, 8)]) + closes
    opens, closes = draw.choice(_CONTAINERS)
    body = [f"<h1>{_escaped(main[0])}</h1>"]
    for text in main[1:]:
        body.append(draw.choice(("<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{}</p>", "<blockquote>{}</blockquote>", "<h2>{}</h2><p>{}</p>")).replace("{}", _escaped(text)))
    if draw.random() < 0.3:
        body.insert(draw.randint(1, len(body)), "</x-main>" + aside() + "<x-main data-main>")
    article = f"{opens}<x-main data-main>{''.join(body)}</x-main>{closes}"
    parts = [menu, *[aside() for _ in range(draw.randint(0, 2))], article, *[aside() for _ in range(draw.randint(0, 2))]]
    if draw.random() < 0.4:
        opens, closes = draw.choice(_HEADERS)
        parts.insert(draw.randint(0, 1), opens + some() + closes)
    if draw.random() < 0.5:
        whole, one, end_one, end_whole = draw.choice(_COMMENTS)
        texts = [draw.choice([*rest, *main[1:]]) for _ in range(draw.randint(1, 4))]
        parts.append(whole + "".join(one + _escaped(t) + end_one for t in texts) + end_whole)
    opens, closes = draw.choice(_FOOTERS)
    parts.append(f"{opens}&copy; {some()}{closes}")
    return f"<html><body>{''.join(parts)}</body></html>"


def trained(pages: list[str]) -> Labeller:
    """The labeller from a sample of pages."""
    draw = random.Random(11)
    inputs: list[np.ndarray] = []
    labels: list[np.ndarray] = []
    for html in pages:
        blocks = parse(html)
        known = [teacher(b) for b in blocks]
        if blocks:
            inputs.append(vectors(blocks))
            labels.append(np.array(known, np.float32))
        main = [b.text for b, k in zip(blocks, known, strict=True) if k == 1]
        rest = [b.text for b, k in zip(blocks, known, strict=True) if k == 0]
        if not main or not rest:
            continue
        for _ in range(VARIANTS):
            made = parse(_rearranged(main[: draw.randint(2, 25)], rest, draw))
            inputs.append(vectors(made))
            labels.append(np.array([b.marked for b in made], np.float32))
    labeller = Labeller()
    return labeller.fit(inputs, labels) if inputs else labeller


def fit(pages: DataFrame) -> Labeller:
    """Trains on the sample, which is the same in every run.

    The least hashes are found first, so that only the sampled pages are sent.
    """
    html = F.col("html").cast("string")
    ranked = pages.where(F.length(html) > 0).select(
        F.xxhash64("page_id", "url").alias("rank"), html.alias("html")
    )
    ranks = [r.rank for r in ranked.select("rank").orderBy("rank").limit(SAMPLE).collect()]
    if not ranks:
        return Labeller()
    sampled = ranked.where(F.col("rank") <= max(ranks)).groupBy("rank").agg(F.min("html").alias("html"))
    return trained([r.html for r in sampled.orderBy("rank").collect()])


def main_texts(pages: list[str | None], labeller: Labeller) -> Iterator[str]:
    """The main text of each page."""
    parsed = [parse(html or "") for html in pages]
    found = labeller.probabilities([vectors(b) for b in parsed])
    for blocks, p in zip(parsed, found, strict=True):
        yield " ".join(b.text for b, chance in zip(blocks, p, strict=True) if chance >= 0.5)


_EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract_table(pages: DataFrame) -> DataFrame:
    """Every page with its main text."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = list(main_texts(part.column("html").to_pylist(), shared.value))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    names=["page_id", "url", "text", "n_chars"],
                )

    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return plain.mapInArrow(run, _EXTRACTED)
