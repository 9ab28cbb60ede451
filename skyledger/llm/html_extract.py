"""Main text of web pages, by a conditional random field over the leaf blocks of the DOM.

A page is cut into leaf blocks: runs of text between the borders of block elements, with their
ancestors. A linear-chain CRF labels the blocks of a page in one pass (Viterbi) as article or
page furniture, from ancestor tags, class and id words, and features of the text. It is trained
on the driver, on labelled pages that `labelled_pages` lays out from a list of page parts, in
about a second; it is broadcast, and its size is that of its feature list.

Character references are decoded, white space inside a block becomes one space, blocks are joined
by newlines in page order. Null and empty html, and pages without an article, give empty text.
Whatever is not well formed is read as far as it goes: open elements end with the page, and end
tags without a start are ignored. The content of raw-text elements (scripts, styles, titles, text
areas, frames) is no markup: it goes up to the element's end tag, or to the end of the page. Pages
are read whole; repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm import crf
from skyledger.llm.common import pieces, share, shared

#: Elements that don't break a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr br img picture source".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without text for readers; their content is skipped up to the end tag.
RAW = frozenset("script style noscript template textarea title svg iframe object select button".split())
#: Those of them whose content has no tags or comments but their own end tag, and where it ends.
RAW_TEXT = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in "script style title textarea iframe".split()}
#: A start tag that ends an open element of the same group.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[^<]*|[^<]+", re.S)
#: What decides where a script ends: inside `<!--` and `-->` it may hold scripts of its own.
_SCRIPT = re.compile(r"<!--(?:-?>)?|-->|<(/?)script(?=[\s/>])", re.I)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")


def _script_end(page: str, at: int) -> int | None:
    """Where the end tag starts of a script whose content starts at `at`; None if it has none."""
    hidden = inner = False
    for m in _SCRIPT.finditer(page, at):
        if m[1] is None:
            hidden = m[0] == "<!--"
            inner = inner and hidden
        elif not m[1]:
            inner = hidden
        elif inner:
            inner = False
        else:
            return m.start()
    return None


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]  # ancestors, outermost first
    words: tuple[str, ...]  # of the ancestors' class, id and role
    linked: float  # share of the text in links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    run: list[str] = []
    linked = link = 0
    skip = None
    deep = place = 0
    nested = True  # scripts end as a browser ends them, until one would take the rest of the page

    def close_block() -> None:
        nonlocal linked
        if run:
            text = " ".join(references.unescape("".join(run)).split())
            if text:
                own = [t for t in stack if t[0] not in INLINE]
                out.append(Block(text, tuple(t[0] for t in own), tuple(w for t in own for w in t[1]),
                                 min(1.0, linked / max(1, sum(map(len, run))))))
            run.clear()
        linked = 0

    def pop_to(i: int) -> None:
        close_block()
        del stack[i:]

    def after_raw(tag: str, start: int) -> int:
        """The place behind the end tag of a raw-text element whose content starts at `start`."""
        nonlocal nested
        if tag == "script" and nested:
            end = _script_end(page, start)
            nested = end is not None
            start = end if nested else start
        end = RAW_TEXT[tag].search(page, start)
        return end.end() if end else len(page)

    while place < len(page):
        piece = _PIECE.match(page, place)[0]
        place += len(piece)
        if piece[0] != "<" or not (name := _NAME.match(piece)) or piece[-1] != ">":
            if not skip and not piece.startswith(("<!--", "<!", "<?")):
                run.append(piece)
                linked += len(piece) if link else 0
            continue
        tag = name[1].lower()
        ends = piece[1] == "/"
        raw = tag in RAW_TEXT and not ends and not piece.endswith("/>")
        if raw:
            place = after_raw(tag, place)
        if skip:
            if tag == skip:
                deep += -1 if ends else 1
                if deep == 0:
                    skip = None
            continue
        if tag in RAW:
            if not (raw or ends or piece.endswith("/>")):
                skip, deep = tag, 1
            if tag not in ("button",):
                run.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                link = 0 if ends else 1
            elif tag in ("br", "img"):
                run.append(" ")
            continue
        if ends:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                pop_to(at)
            else:
                close_block()
            link = 0
            continue
        close_block()
        link = 0
        if tag in ENDS_P:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
            if at is not None:
                pop_to(at)
        if tag in CLOSES and stack and stack[-1][0] in CLOSES[tag]:
            pop_to(len(stack) - 1)
        if tag not in VOID and not piece.endswith("/>"):
            words = tuple(w for m in _NAMED.findall(piece) for w in _WORD.findall(m.lower()))
            stack.append((tag, words))
    close_block()
    return out


# ---- Features -----------------------------------------------------------------------------


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features of every block."""
    out = []
    for b in page:
        n = len(b.text.split())
        names = {f"in:{t}" for t in b.tags} | {f"word:{w}" for w in b.words}
        names |= {f"own:{b.tags[-1] if b.tags else ''}", f"length:{min(6, n.bit_length())}",
                  f"linked:{int(b.linked * 4)}", f"end:{b.text[-1] in '.!?:;…”»'}",
                  f"commas:{min(2, b.text.count(','))}", "any"}
        if "©" in b.text:
            names.add("sign")
        out.append(sorted(names))
    return out


# ---- Labelled pages -----------------------------------------------------------------------

#: Parts of a page: (markup around the blocks, markup of one block, fewest and most blocks, words
#: in a block, label). `{}` is where the blocks, or a block's text, go.
FURNITURE = [
    ("<nav><ul>{}</ul></nav>", '<li><a href="/">{}</a></li>', 2, 8, (1, 3)),
    ('<div class="menu"><ul>{}</ul></div>', '<li><a href="/">{}</a></li>', 2, 8, (1, 3)),
    ('<ul id="navigation">{}</ul>', '<li><a href="/">{}</a></li>', 2, 8, (1, 3)),
    ('<div class="breadcrumb">{}</div>', '<span><a href="/">{}</a></span>', 2, 4, (1, 2)),
    ("<header>{}</header>", "<div>{}</div>", 1, 2, (1, 8)),
    ('<div id="header">{}</div>', "<p>{}</p>", 1, 2, (1, 8)),
    ('<div class="ad">{}</div>', "{}", 1, 1, (2, 30)),
    ('<div class="advert banner sponsored">{}</div>', "<p>{}</p>", 1, 2, (2, 30)),
    ("<aside>{}</aside>", "<p>{}</p>", 1, 4, (3, 40)),
    ('<div class="sidebar widget related">{}</div>', '<p><a href="/">{}</a></p>', 1, 5, (2, 25)),
    ('<div class="cookie notice consent">{}</div>', "<p>{}</p>", 1, 1, (5, 40)),
    ('<div id="popup" class="newsletter subscribe promo">{}</div>', "<div>{}</div>", 1, 2, (3, 25)),
    ("<form>{}</form>", "<div>{}</div>", 1, 3, (1, 10)),
    ('<div class="share social">{}</div>', '<a href="/">{}</a> ', 1, 4, (1, 2)),
    ('<section id="comments">{}</section>', '<div class="comment"><p>{}</p></div>', 1, 6, (3, 60)),
    ('<div class="comments reply thread">{}</div>', "<p>{}</p>", 1, 6, (3, 60)),
    ('<ol class="commentlist">{}</ol>', '<li class="comment">{}</li>', 1, 6, (3, 60)),
    ('<div class="pagination pager">{}</div>', '<a href="/">{}</a> ', 2, 6, (1, 2)),
    ('<div class="login search toolbar topbar">{}</div>', "<div>{}</div>", 1, 4, (1, 4)),
    ('<div class="tags categories meta byline author">{}</div>', '<a href="/">{}</a> ', 1, 5, (1, 3)),
    ('<ul class="links recent popular">{}</ul>', '<li><a href="/">{}</a></li>', 2, 8, (2, 10)),
    ('<table class="navbar"><tr>{}</tr></table>', '<td><a href="/">{}</a></td>', 2, 6, (1, 3)),
    ('<div class="legal disclaimer privacy">{}</div>', "<p>{}</p>", 1, 2, (3, 40)),
    ("<footer>{}</footer>", "&copy; {} &middot; {}", 1, 1, (2, 25)),
    ('<div class="footer copyright">{}</div>', "<p>&copy; {}</p>", 1, 3, (2, 25)),
]
ARTICLES = [
    "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>",
    '<div id="content" class="article post entry">{}</div>', '<div class="story body text">{}</div>',
    "<section>{}</section>", "<div>{}</div>",
]
INNER = [
    ("<p>{}</p>", (8, 120)), ("<p>{}</p>", (1, 60)), ("<p><b>{}<br>", (1, 80)), ("<p>{}</p>", (1, 3)), ("<h2>{}</h2>", (2, 8)),
    ("<blockquote>{}</blockquote>", (8, 50)), ("<ul><li>{}</li></ul>", (3, 25)),
    ("<table><tr><td>{}</td></tr></table>", (1, 8)), ("<pre>{}</pre>", (3, 20)),
    ("<figure><figcaption>{}</figcaption></figure>", (4, 20)), ("<div>{}</div>", (8, 80)),
]
_SYLLABLES = "an be co de er fi go ha in ka lo me no or pa re sa ti un ve wo".split()
#: Marks that tell the label of a block of a laid-out page; taken off before features are made.
_MARKS = ("\ue000", "\ue001")


def labelled_pages(count: int = 300, seed: int = 7) -> Iterator[tuple[list[Block], list[int]]]:
    """Pages laid out at random from the parts, with the label of each block (1: article)."""
    draw = random.Random(seed)

    def text(span: tuple[int, int], label: int, sentence: bool) -> str:
        words = ["".join(draw.choices(_SYLLABLES, k=draw.randint(1, 4))) for _ in range(draw.randint(*span))]
        if sentence:
            words = [w + draw.choice(["", "", "", "", ","]) for w in words]
            words[-1] = words[-1].rstrip(",") + draw.choice([".", ".", ".", "!", "?"])
        if draw.random() < 0.15:  # odd writing, in articles as elsewhere
            odd = draw.choice(["| ", "*** ", "!! ", "# ", "&amp; ", "; ", "» "])
            words = [w + draw.choice([" " + odd.strip(), ""]) for w in words]
        return _MARKS[label] + " ".join(words).capitalize()

    def part(p) -> str:
        around, one, fewest, most, span = p
        inner = "".join(one.replace("{}", text(span, 0, span[1] > 10)) for _ in range(draw.randint(fewest, most)))
        return around.replace("{}", inner)

    for _ in range(count):
        article = [f"<h1>{text((2, 12), 1, draw.random() < 0.3)}</h1>"] if draw.random() < 0.85 else []
        for _ in range(draw.choice([1, 1, 2, 3, 5, 8, 12])):
            inner, span = draw.choice(INNER[:4] if draw.random() < 0.7 else INNER)
            article.append(inner.replace("{}", text(span, 1, draw.random() < 0.9)))
            if draw.random() < 0.06:
                article.append(part(draw.choice(FURNITURE[5:22])))
        top = "".join(part(p) for p in draw.sample(FURNITURE[:13], draw.randint(0, 4)))
        bottom = "".join(part(p) for p in draw.sample(FURNITURE[6:], draw.randint(0, 4)))
        page = f"<html><body>{top}{draw.choice(ARTICLES).replace('{}', ''.join(article))}{bottom}"
        found = blocks(page)
        labels = [int(_MARKS[1] in b.text) for b in found]
        for b in found:
            for mark in _MARKS:
                b.text = b.text.replace(mark, "")
        kept = [(b, y) for b, y in zip(found, labels, strict=True) if b.text]
        if kept:
            yield [b for b, _ in kept], [y for _, y in kept]


@dataclass
class Extractor:
    """Feature numbers and a trained chain."""

    number: dict[str, int]
    chain: crf.Chain

    def text(self, page: str) -> str:
        found = blocks(page)
        known = [[self.number[f] for f in names if f in self.number] for names in features(found)]
        labels = self.chain.viterbi(known)
        return "\n".join(b.text for b, y in zip(found, labels, strict=True) if y)


def fit(pages: list[tuple[list[Block], list[int]]] | None = None) -> Extractor:
    """Train on labelled pages: lists of blocks with labels, 1 for article."""
    pages = list(labelled_pages()) if pages is None else pages
    named = [(features(b), y) for b, y in pages]
    number = {f: i for i, f in enumerate(sorted({f for names, _ in named for fs in names for f in fs}))}
    sequences = [([[number[f] for f in fs] for fs in names], y) for names, y in named]
    return Extractor(number, crf.train(sequences, len(number)))


def extract(pages: DataFrame, extractor: Extractor | None = None, html: str = "html",
            keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, `text` and `n_chars` of every page."""
    handle = share(pages.sparkSession, extractor or fit())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared(handle)
        for whole in batches:
            width = np.asarray(pc.fill_null(pc.binary_length(whole.column(whole.num_columns - 1)), 0), np.int64)
            for a, b in pieces(np.concatenate(([0], np.cumsum(width)))):
                part = whole.slice(a, b - a)
                texts = [model.text(h) if h else "" for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*part.schema.names[:-1], "text", "n_chars"])

    kept = pages.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias("__html")).mapInArrow(
        run, f"{schema}, text string, n_chars bigint")
