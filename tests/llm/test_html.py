import html
import itertools
import random
import re
from collections import Counter

import numpy as np

from tests.conftest import SF_MID
from veldt.llm import html_extract as H
from veldt.llm import queries
from veldt.llm.common import table

W = [float(x) for x in H.PLAIN]


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(1, 9)
        u = [rng.uniform(-2, 2) for _ in range(n)]
        e = [(a, b, rng.random()) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]

        def cost(label):
            return (sum(abs(x) for x, k in zip(u, label, strict=True) if (x > 0) != k)
                    + sum(w for a, b, w in e if label[a] != label[b]))

        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert abs(cost(H.min_cut(u, e)) - best) < 1e-9 and abs(cost(H._flow(u, e)) - best) < 1e-9


def test_article_of_given_pages(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, SF_MID, "pages").collect()}
    got = queries.QUERIES["op8_min_cut_extraction"](spark, SF_MID).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
        assert r["text"] == want and r["n_chars"] == len(want)


def test_boilerplate_inside_and_around_the_article():
    body = "This is a long paragraph of the article, with commas, and it goes on for a while so that nobody could miss it."
    page = (f"<title>t</title><body class='has-sidebar'><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>"
            f"<article><header><h1>Head &amp; line</h1></header><p>{body}<p class=x>In<b>line</b> tags &lt;b&gt; stay\n\n one word."
            f"<aside class='ad-box'><p>{body}</p></aside><script>var a='</p>'; if (a<b) x()</script><!-- <p>no</p> --><p>{body}</p>"
            f"<form><p>Sign up</p></form></article><div class='comments'><p>{body}</p></div><footer>&copy; x</footer>")
    assert H.main_text(page, W) == f"Head & line {body} Inline tags <b> stay one word. {body}"


def test_raw_elements_end_where_they_end():
    """Self-closed, custom and unclosed elements named like raw ones leave the article alone."""
    body = "This is a long paragraph of the article, with commas, and it goes on for a while so that nobody could miss it."
    art = f"<article><p>{body}</p><p>{body}</p></article>"
    for lead in ('<svg class="i"/>', '<svg d="a>b" />', "<math/>", "<title-bar>T</title-bar>", "<select-menu>", "<object-view></object-view>",
                 "<object>", "<svg><svg></svg>", '<svg><path d="M0"/></svg>', "<title>T <b></title>", "<SVG><p>no</p></SVG >",
                 "<script>var s = '<svg>';</script>", "<!-- <svg> -->", "<style>p > a {}</style>"):
        assert H.main_text(lead + art + "<svg><text>x</text></svg>", W).endswith(f"{body} {body}"), lead
    assert H.main_text(art.replace("</p><p>", "<svg><p>no</p><svg/></svg></p><p>"), W) == f"{body} {body}"
    assert H.main_text("<svg>" * 20_000 + art, W) == f"{body} {body}"


def test_without_semantic_elements():
    body = "A paragraph of plain prose, rather long, with several commas, and a full stop at its end. It says little, but at length."
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(8))
    page = f"<div><ul>{links}</ul></div><div><h2>Title</h2><p>{body}</p><p>{body}</p><p>{body}</p></div><div><ul>{links}</ul></div>"
    assert H.main_text(page, W).endswith(" ".join([body] * 3)) and "Link" not in H.main_text(page, W)


def test_edge_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (None, "u", "<article><p>x y z, with words enough to be read.</p>"),
            (4, "u", "<script>no end"), (5, "u", "a < b > c <"), (6, "u", "<p>" * 3000 + "deep"), (6, "u", "<p>" * 3000 + "deep"),
            (7, "u", "<article>" + "<p>Words of the text, again and again.</p>" * 5000 + "</article>"), (8, "u", "<!-- open")]
    df = spark.createDataFrame([(*r, "t", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = H.extract(df, H.train(df)).collect()
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[2] == text[3] == text[4] == text[8] == "" and len(text[7]) == 5000 * 36 - 1
    assert text[None] == "x y z, with words enough to be read."
    assert H.extract(df.where("false"), H.train(df.where("false"))).count() == 0


def test_constant_features_give_the_plain_weights():
    assert (H.fit_shape(np.ones((3, H.FEATURES)), np.ones(3)) == H.PLAIN).all()
