import math

import numpy as np
from pyspark.sql import functions as F

from lakeloom.llm import html_text, topk, warc
from lakeloom.llm.html_text import main_text
from lakeloom.session import fresh_dir
from tests.conftest import rows

STOPS = "This is the text of the article and it has a lot of words that are in the list of the stop words, so it is good."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></ul></nav><div class="ad">Buy the best of it now</div>
<article><h1>A title</h1><p><b>One &amp; two<br>three&nbsp;four<p>{STOPS}<div class=comments><p>{STOPS}</p></div></article>
<aside>{STOPS}</aside><footer>&copy; x</footer></body></html>"""


def test_article():
    assert main_text(PAGE) == f"A title\n\nOne & two\n\nthree four\n\n{STOPS}"


def test_neighbours_decide_short_blocks():
    page = f"<div>Short lead.</div><p>{STOPS}</p><p>Short one.</p><p>{STOPS}</p><div><a href=x>Menu item</a></div><div>tiny</div>"
    assert main_text(page) == f"Short lead.\n\n{STOPS}\n\nShort one.\n\n{STOPS}"


def test_odd_pages():
    for page in (None, "", "   ", "<", "<p", "<p class='x", "</p></div>", "<!--", "<script>", "plain", "<div>" * 5000, "<p>" * 5000):
        assert isinstance(main_text(page), str)
    assert main_text("<div class='content has-sidebar'><p>" + STOPS + "</p></div>") == STOPS


def test_raw_content_ends_at_its_own_tag():
    article = f"<article><p>{STOPS}</p></article>"
    for script in ("for(i=0;i<n;i++){f()}", "if (a<b) x='", "a<b && c<d // <!-- \"", "s='<p class=\"x'"):
        for page in (f"<script>{script}</script>{article}", f"<script>{script}</SCRIPT >{article}<script>g()</script>",
                     f"<title>a<b</title><style>{script}</style>{article}"):
            assert main_text(page) == STOPS
    assert main_text(f"<script>a<b {article}") == ""


def test_text_around_a_bad_inline_element():
    half, rest = STOPS[:60], STOPS[60:]
    for bad in ('<span class="ad">x</span>', "<button>x</button>", "<label>x <b>y</b></label>", '<x-box class="share">x</x-box>',
                "<textarea>x</textarea>"):
        for page in (f"<article><p>{half}{bad}{rest}</p></article>", f"<p>{half}{bad}{rest}</p>", f"<div>{half}{bad}{rest}</div>"):
            assert main_text(page) == STOPS
    assert main_text(f'<article><p>First half <span class="ad">x</span> second half.</p></article>') == "First half second half."
    # What holds blocks ends the paragraph; so does an element that was never closed, at the end of its parent.
    assert main_text(f'<article>{half}<span class="ad"><div>x</div></span>{STOPS}</article>') == f"{half.strip()}\n\n{STOPS}"
    assert main_text(f'<article><div>One <span class="ad">x</div>{STOPS}</article>') == f"One\n\n{STOPS}"


def test_languages_without_known_stop_words():
    for text in ("Вчера вечером жители города собрались на площади, чтобы обсудить новый план строительства моста через реку.",
                 "昨天晚上市民们聚集在广场上，讨论跨河大桥的新建设计划。" * 4):
        page = f'<nav><a href="/">{text}</a></nav><div><a href=x>{text}</a></div><p>{text}</p><p>{text}</p><div class="ad">{text}</div>'
        assert main_text(page) == f"{text}\n\n{text}"
    # A block without stop words on a page in a known language stays out.
    assert main_text(f"<p>{STOPS}</p><p>{'Foo bar baz. ' * 10}</p><p>{STOPS}</p>") == f"{STOPS}\n\n{STOPS}"


def test_the_article_is_kept_whatever_is_around_it():
    more = f"And {STOPS} But {STOPS}"
    body = f"<h1>A title</h1><p>{STOPS}</p><p>{more}</p>"
    text = f"A title\n\n{STOPS}\n\n{more}"
    menu = '<ul><li><a href="/a">Home</a><li><a href="/b">All news</a></ul>'
    card = "<article><h3>Other story</h3><p>The lead of it.</p></article>"
    for page in (
            f"<aside>{card}</aside><div>{body}</div>",
            f"<nav>{menu}</nav><div>{body}</div><div class=cards>{card}</div>",
            f"<body><form action=x>{body}<footer>The end of the page</footer></form></body>",
            f"<nav>{menu}<div>{body}</div>",
            f"<div class='side-by-side'>{body}</div>",
            f"<article><h1>A title</h1><p>{STOPS}</p><section class='legal-analysis'><p>{more}</p></section></article>",
            f"<main>{body}<section class=comments>{f'<p>{more}</p>' * 9}</section></main>",
            f"<nav>{menu}</nav>{body}<div id=comments>{f'<p>{more}</p>' * 9}</div>"):
        assert main_text(page) == text, page
    for name in ("side", "right-side", "ad", "ad-slot", "legal", "legal-links", "site-footer", "cookie-notice", "related-posts", "tags"):
        assert main_text(f"<div>{body}</div><div class='{name}'><p>{more}</p></div>") == text, name


def test_a_very_long_page():
    many = "".join(f"<p>{STOPS} {i}</p>" for i in range(20_000))
    image = f'<img src="data:image/png;base64,{"A" * 3_000_000}">'
    assert main_text(f"<article>{many}{image}</article>").count("\n\n") == 19_999


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", "x")],
                                  "page_id bigint, url string, html string, text string")
    found = rows(html_text.extract(pages))
    assert [r for r in found if r[0] == 2] == [(2, None, "", 0)] and len(found) == 4
    assert all(r[3] == len(r[2]) for r in found)


def test_archives_round_trip(spark):
    pages = [(3, "u3", "same"), (1, "u1\r\nX: y", "same"), (2, None, "é" * 50_000), (4, "u4", None), (5, "u5", ""), (1, "u1\r\nX: y", "same"),
             (None, "u", "same"), (6, "u6", "a\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    folder = fresh_dir(spark, "warc")
    index = warc.write(df, folder)
    assert index.count() == len(pages)
    found = {r.page_id: r for r in warc.read(index, folder).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in found.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None), 5: ("revisit", 4),
        None: ("revisit", 1), 6: ("response", None)}
    assert bytes(found[2].payload).decode() == "é" * 50_000 and found[2].payload_bytes == 100_000
    assert found[3].payload_digest == found[1].payload_digest and found[3].payload_bytes == 4
    some = warc.read(index.filter("page_id = 6"), folder).collect()
    assert [bytes(r.payload) for r in some] == [b"a\r\n\r\nWARC/1.1\r\n"]
    all_responses = warc.write(df, fresh_dir(spark, "warc"), min_revisit_bytes=5)
    assert rows(all_responses.groupBy("record_type").count()) == [("response", 8)]


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.round_trip(spark, empty).count() == 0 and html_text.extract(empty).count() == 0


def test_ranges_are_read_together():
    rows_ = [("a", 0, 10), ("a", 10, 10), ("a", 100, 10), ("b", 0, 10)]
    assert list(warc.coalesced(iter(rows_), gap=5, most=1000)) == [
        ("a", [(0, 10), (10, 10)]), ("a", [(100, 10)]), ("b", [(0, 10)])]


def plain_search(vectors, step, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in usable if i % step == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(0, rng.choice([0.1, 1, 4]), 8) * (rng.random(8) < 0.6)])
               for i in range(400)]
    vectors += [(i, vectors[i % 7][1]) for i in range(400, 420)]
    vectors += [(500, None), (501, [None, 1.0]), (502, [math.nan] * 8), (503, [math.inf] * 8), (504, []), (None, [1.0] * 8),
                (505, [0.0] * 8), (510, [1.0, 2.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").withColumn("norm", F.lit("clash"))
    expected = plain_search(vectors, 5, 3)
    for high in (0.0, 0.5, 9.0):
        found = topk.search(df, F.col("vec_id") % 5 == 0, k=3, bucket_rows=64, block_bytes=2048, seed_rows=16, high=high)
        assert sorted(rows(found)) == expected


def test_search_without_candidates(spark):
    one = spark.createDataFrame([(50, [1.0])], "vec_id bigint, embedding array<float>")
    assert topk.search(one, F.lit(True)).count() == 0 and topk.search(one.limit(0), F.lit(True)).count() == 0
