import html
import random
import re

import numpy as np

from skyledger.llm import crf, html_extract
from skyledger.llm.queries import html_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header><div>My site</div></header><nav><ul><li><a href="/">Home</a></li><li><a href="/">News</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="cookie notice"><p>We use cookies on this site, please accept.</p></div>
<article><h1>A  title</h1><p><b>First &eacute;&#233; part,<br>second line.<p>Next &lt;one&gt; is here, and it goes on.
<form><div>Your name</div></form><p>Last of all the paragraphs.</article><aside><p>Other stories you may like</p></aside>
<section id="comments"><div class="comment"><p>Great post, I agree with all of it.</p></div></section>
<footer>&copy; site &middot; about</footer></body></html>"""


def test_one_page():
    text = html_extract.fit().text(PAGE)
    assert text == "A title\nFirst éé part, second line.\nNext <one> is here, and it goes on.\nLast of all the paragraphs."


def test_raw_text_is_no_markup():
    """Whatever a raw-text element holds, the page around it stays as it is."""
    model = html_extract.fit()
    for raw in ("<script>for(i=0;i<n;i++){a();}</script>", "<script>var s='<!--';</script>", "<SCRIPT async>if(a<b && c>d)x('<p>')</Script >",
                "<script>s='</scripty><article>'</script\n>", "<style>a<b{content:'<!--'}</style>", "<title>a <b c <!-- d</title>",
                "<textarea>x <y <!-- z</textarea>", "<iframe src='/'>a<b</iframe>", "<script>'<b title=\"'</script>",
                "<script><!--\nwrite('<script>x()</script>')\n//--></script>", "<script>'<!-->';'<script>'</script>",
                "<noscript><style>a<b</style></noscript>", "<script>'<!--<script>'</script><script>i<n</script>"):
        for page in (PAGE.replace("</head>", raw + "</head>"), PAGE.replace("<p><b>First", raw + "<p><b>First"),
                     PAGE.replace("<article>", raw + "<article>"), PAGE.replace("</article>", raw + "</article>")):
            assert model.text(page) == model.text(PAGE), raw


def test_scripts_take_linear_time():
    page = "<script><!--<script></script>" * 40_000 + "<article><p>A text that goes on and on, to the end."
    assert len(html_extract.blocks(page)) == 1


def test_held_out_pages():
    model = html_extract.fit()
    wrong = total = 0
    for found, labels in html_extract.labelled_pages(150, seed=99):
        known = [[model.number[f] for f in fs if f in model.number] for fs in html_extract.features(found)]
        wrong += int((model.chain.viterbi(known) != labels).sum())
        total += len(labels)
    assert wrong <= 0.01 * total


#: Layouts whose tags, classes and ids the training pages don't have: (furniture, article).
OTHER = [
    ('<div class="masthead"><dl><dt><a href="/">{}</a><dd><a href="/">{}</a></dl></div>', '<div class="prose"><h3>{}</h3><p>{}</p><p>{}</p></div>'),
    ('<div class="toc"><a href="/">{}</a><p><a href="/">{}</a></p></div>', '<div itemprop="articleBody"><h4>{}</h4><p>{}</p><dl><dt>{}<dd>{}</dl></div>'),
    ('<center><table><tr><td><a href="/">{}</a><td><a href="/">{}</a></table></center>', '<td class="copytext"><h3>{}</h3><p>{}</p><p>{}</p></td>'),
    ('<div class="disqus"><h5>{}</h5><div>{}</div></div>', '<div class="hentry"><h3>{}</h3><p>{}</p><p>{}</p><p>{}</p></div>'),
    ('<div class="colophon"><small>{}</small><div>{}</div></div>', '<div id="bodytext"><p>{}</p><p>{}</p><p>{}</p></div>'),
    ('<dialog class="gdpr"><p>{}</p><div>{}</div></dialog>', '<div class="richtext"><h3>{}</h3><p>{}</p><p>{}</p></div>'),
]


def other_layouts(count, seed):
    """HTML with the texts of its article and of its furniture; every text has a word of its own."""
    draw = random.Random(seed)
    words = "the of river market one house from light city under paper before green road winter small".split()
    for n in range(count):
        texts = [[], []]

        def text(label, low, high):
            texts[label].append(f"{'fa'[label]}{n}x{len(texts[label])} " + " ".join(draw.choices(words, k=draw.randint(low, high))))
            return texts[label][-1] + ("." if high > 10 else "")

        def fill(part, label):
            while "{}" in part:
                at = part.index("{}")
                short = not label or part[:at].endswith(("<h3>", "<h4>", "<dt>"))
                part = part.replace("{}", text(label, *((1, 7) if short else (15, 90))), 1)
            return part

        tops = [fill(draw.choice(OTHER)[0], 0) for _ in range(draw.randint(1, 3))]
        body = fill(draw.choice(OTHER)[1], 1)
        yield f"<html><body>{''.join(tops)}{body}{fill(draw.choice(OTHER)[0], 0)}", texts


def wrong_on_other_layouts(model, count=200, seed=5):
    """Share of blocks of other layouts that get the wrong label."""
    wrong = total = 0
    for page, (furniture, article) in other_layouts(count, seed):
        got = set(model.text(page).split())
        wrong += sum(t.split()[0] in got for t in furniture) + sum(t.split()[0] not in got for t in article)
        total += len(furniture) + len(article)
    return wrong / total


def test_layouts_kept_out_of_training():
    model = html_extract.fit()
    unknown = "masthead toc prose copytext disqus hentry colophon bodytext gdpr richtext".split()
    tags = "h3 h4 h5 dl dt dd center dialog".split()
    assert not {f"word:{w}" for w in unknown} & set(model.number) and not {f"in:{t}" for t in tags} & set(model.number)
    assert wrong_on_other_layouts(model) <= 0.08


def test_viterbi_finds_the_best_path():
    draw = np.random.default_rng(0)
    chain = crf.Chain(draw.normal(size=(5, 2)), draw.normal(size=(2, 2)), draw.normal(size=2))
    features = [[int(x) for x in draw.choice(5, 2, replace=False)] for _ in range(7)]

    def score(path):
        s = chain.first[path[0]]
        for i, y in enumerate(path):
            s += chain.weight[features[i], y].sum() + (chain.follow[path[i - 1], y] if i else 0)
        return s

    paths = [[n >> i & 1 for i in range(7)] for n in range(128)]
    assert chain.viterbi(features).tolist() == max(paths, key=score)


def test_pages_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_text(spark, sf).collect():
        page = pages[r.page_id]
        article = page[page.index("<article>") + 9 :].split("</article>")[0]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_broken_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<"), (4, "u", "<article><p>unclosed <b>text that goes on and on"),
            (5, None, "</p></div>"), (6, "u", "<article><p>" + "long words here. " * 50_000), (7, "u", "<script>x"),
            (7, "u", "<script>x"), (8, "u", "&#xD800; &bogus; <p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(df).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == 9 and [by[i] for i in (1, 2, 5, 7)] == [""] * 4
    assert by[4] == "unclosed text that goes on and on" and len(by[6]) == 17 * 50_000 - 1
    assert html_extract.extract(df.limit(0)).count() == 0
