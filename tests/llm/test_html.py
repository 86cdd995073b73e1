"""Page extraction: what decides it, broken markup, hostile pages."""

import time

import duckdb

from quillspark.llm import html


def test_threshold_decides(sf_dir, monkeypatch):
    pages = [h for (h,) in duckdb.sql(f"select html from '{sf_dir}/pages.parquet' where html is not null").fetchall()]
    got = [html.extract(h) for h in pages]
    monkeypatch.setattr(html, "threshold", lambda fused, mean: -1.0)
    assert sum(html.extract(h) != x for h, x in zip(pages, got)) > len(pages) / 2


def test_sample_pages_give_their_article(sf_dir):
    import html as entities
    import re

    for (page,) in duckdb.sql(f"select html from '{sf_dir}/pages.parquet' where html is not null").fetchall():
        inner = page.split("<article>")[1].split("</article>")[0]
        parts = re.split(r"</?(?:h1|p)>", inner)  # the sample's articles hold these blocks, b and br only
        lines = [" ".join(entities.unescape(re.sub(r"</?b>", "", re.sub("<br>", " ", x))).split()) for x in parts]
        assert html.extract(page) == "\n".join(x for x in lines if x)


def test_unmarked_short_text_outside_the_article_goes():
    body = "".join(f"<p>Sentence {k} is long enough, with commas, to be text. It goes on.</p>" for k in range(20))
    lines = [f"Sentence {k} is long enough, with commas, to be text. It goes on." for k in range(20)]
    assert html.extract(f"<body><div class='x1'>Buy now</div><article>{body}</article><div>More</div></body>").split("\n") == lines
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul>"
    assert html.extract(f"<body>{menu}{body}{menu}</body>").split("\n") == lines
    assert html.extract(f"<div class='share-price'>{body}</div>").split("\n") == lines


def test_broken_quotes_lose_nothing():
    assert html.extract("<p title='x>One, it is.</p><p>Two, it's gone.</p><p>Three, ok.</p>") == "One, it is.\nTwo, it's gone.\nThree, ok."
    assert html.extract("<p class=it's>Text, one.</p><p title='a > b'>Text, two. a < b</p>") == "Text, one.\nText, two. a < b"


def test_hostile_pages_are_read_in_linear_time():
    pages = ["<a " * 350_000, "<a " * 350_000 + ">", '<a x="' * 200_000, "<a x='>" * 150_000, "<a " + "=" * 1_000_000, "<" * 1_000_000, "<!--" * 250_000, "<script>" * 100_000, "<span>" * 20_000 + "x</b>" * 20_000]
    for page in pages:
        begin = time.time()
        html.extract(page)
        assert time.time() - begin < 15
    assert html.extract("<div>" * 20_000 + "Deep, text.") == "Deep, text."
    assert html.extract("<div><p>One, two." * 20_000).count("\n") == 19_999
