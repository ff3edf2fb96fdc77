import itertools
import math
import random

import pytest

from factloom.llm import html_main as H

FIELDS = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def crf():
    return H.trained()


def texts(page):
    return [b.text for b in H.blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        (None, []),
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a\n b<p>c &lt;d&gt; &#233;&eacute;</p>e", ["a b", "c <d> éé", "e"]),
        ('<script>var t="</p>";x("<p>no</p>")</script><p>yes', ["yes"]),
        ("<p><b>one<br>two<p>three</p>", ["one two", "three"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<div>a<!-- <p>no</p> -->b</div></div></p>c", ["ab", "c"]),
        ("<title>t</title><style>p{}</style><P CLASS='x>y'>up</P>", ["up"]),
        ("a < b and <3 hearts <unclosed", ["a < b and <3 hearts"]),
        ("a<!-->b<!--->c<!-- x --!>d<!-- y -- > z -->e<!--- q --->f", ["abcdef"]),
        ("<p data-x=it's>one</p><p title=\"it's\">two</p><p>it's three</p>", ["one", "two", "it's three"]),
        ('<p class="x>one</p><p>two</p>', ["one", "two"]),
        ("<p class='x>one</p><p class=\"y\">two</p>", ["one", "two"]),
        ("<p class=a/b id = 'c' hidden=''>one<br/>two</p><p =odd>three</p><p a='1'b=\"2\">four", ["one two", "three", "four"]),
        ("<p>one</ ignored>two</>three<?php x ?>four<!DOCTYPE html>five", ["onetwothreefourfive"]),
        ("<a href=x <a href=y>link</a> text", ["link text"]),
        ("text <a href=", ["text"]),
        ("<svg>no<b>yes</b>", ["yes"]),
        ("<template><p>no</b></p></template><dl><dt>a<dd>b<dt>c</dl>d", ["a", "b", "c", "d"]),
        ("<p>\xa0 x\xa0y </p><p>  </p>", ["x y"]),
        ("<textarea>typed <b></textarea><script>never ends", ["typed <b>"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_ancestors():
    page = '<nav class="main menu"><a href=x>here</a></nav><article id=story><p>there'
    a, b = H.blocks(page)
    assert a.tags == ("nav",) and a.kinds == {"nav"}
    assert a.names == {"main", "menu"} and a.linked == 4 and b.tags == ("article", "p") and b.names == {"story"} and b.linked == 0


def test_viterbi_and_marginals_equal_all_labellings():
    rng = random.Random(1)
    for n in (1, 2, 5):
        crf = H.Field({f"f{k}": rng.uniform(-2, 2) for k in range(6)}, [[rng.uniform(-1, 1) for _ in (0, 1)] for _ in (0, 1)])
        found = [[f"f{rng.randrange(6)}" for _ in range(3)] for _ in range(n)]
        s = crf.scores(found)
        value = {y: sum(s[k] for k in range(n) if y[k]) + sum(crf.pairs[a][b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=n)}
        assert tuple(crf.best(found)) == max(value, key=value.get)
        total = sum(map(math.exp, value.values()))
        ones, expected = crf.marginals(s)
        for k in range(n):
            assert ones[k] == pytest.approx(sum(math.exp(v) for y, v in value.items() if y[k]) / total)
        for a in (0, 1):
            for b in (0, 1):
                want = sum(math.exp(v) * sum((y[k], y[k + 1]) == (a, b) for k in range(n - 1)) for y, v in value.items()) / total
                assert expected[a][b] == pytest.approx(want)


def test_accuracy_on_pages_held_out(crf):
    held = H.labelled(150, 4321)
    right = sum(a == b for found, labels in held for a, b in zip(crf.best(found), labels))
    assert right / sum(len(labels) for _, labels in held) > 0.98


def test_extraction(spark, crf):
    page = (
        '<!DOCTYPE html><html><head><title>No</title></head><body><nav><ul><li><a href="/a">menu</a></li><li><a href="/b">more</a></li></ul></nav><div class="ad">Buy this now, it is very good.</div>'
        "<article><h1>A headline of the story</h1><p><b>First part of the\nstory, which goes on.<br><p>Sh is.</p><p>Second part &amp; the end of it.</p></article>"
        '<section class="comments"><p>I do not agree with this at all.</p></section><footer>&copy; host &middot; All rights reserved.</footer></body></html>'
    )
    want = "A headline of the story\n\nFirst part of the story, which goes on.\n\nSh is.\n\nSecond part & the end of it."
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "", ""), (None, "n", "<div>" * 2000 + "x")]
    df = spark.createDataFrame(rows, FIELDS).selectExpr("*", "'other' AS text", "1 AS n_chars")
    got = H.extracted(df, crf).collect()
    assert len(got) == 5 and [(r.text, r.n_chars) for r in got if r.page_id == 1] == [(want, len(want))] * 2
    assert [(r.url, r.text, r.n_chars) for r in got if r.page_id in (2, 3)] == [(None, "", 0), ("", "", 0)]
    assert H.extracted(df.limit(0), crf).collect() == []


@pytest.mark.parametrize(
    "inside, shown",
    [
        ('<script>var a="</p><p>no";</script>', ""),
        ("<style>p{}</style>", ""),
        ('<svg viewBox="0 0 1 1"><title>no</title><path d="M0"/><text>no</text></svg>', ""),
        ("<svg/>", ""),
        ("<template><p>no<p>no</p><ul><li>no<li>no</ul></template>", ""),
        ("<template></p></div>no</template>", ""),
        ("<object><p>no</p></object>", ""),
        ("<iframe src=x></iframe>", ""),
        ("<math><mi>x</mi><mo>=</mo><mspace/><msup><mn>2</mn><mi>y</mi></msup></math>", "x=2y"),
        ("<button>press</button>", "press"),
        ("<select><option>a<option>b</select>", "a b"),
        ("<picture><source srcset=a><img src=b></picture>", ""),
        ("<noscript>off</noscript>", "off"),
        ("<canvas>flat</canvas>", "flat"),
        ("<audio>hear</audio>", "hear"),
        ("<video>see</video>", "see"),
        ("<x-note>own</x-note>", "own"),
    ],
)
def test_phrasing_does_not_cut_a_paragraph(inside, shown):
    got = H.blocks(f"<div><p>one {inside} two</p><p>three</p></div>")
    assert [b.text for b in got] == [" ".join(f"one {shown} two".split()), "three"]
    assert [b.tags for b in got] == [("div", "p")] * 2


def test_drawing_left_open_and_verbatim_text():
    assert texts("<p>one <svg><path> no<p>two</p>") == ["one", "two"]
    assert texts("one <template><p>no") == texts("<p>one <template><p>no") == texts("<p>one <object>no</p>") == ["one"]
    assert texts("<xmp>a <b> &amp;</xmp>c") == ["a <b> &amp;", "c"]


def test_formulas_and_scripts_inside_an_article(crf):
    story = "It goes on for a while, with commas, and comes to its end here."
    formula = "<math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math>"
    body = f'<h1>A headline of the story</h1><p>{story}</p><p>{story} <script>ad("<p>");</script> {story}</p><p>Here {formula} is met. {story}</p>'
    body += f'{formula.replace("<math>", "<math display=block>")}<p>{story} <svg><path d="M0"/></svg> {story}</p><p>{story} <button>Play</button> {story}</p>'
    page = f'<html><head><title>t</title></head><body><nav><ul><li><a href="/a">menu</a></li><li><a href="/b">more</a></li></ul></nav><article>{body}</article><footer>&copy; host</footer></body></html>'
    want = ["A headline of the story", story, f"{story} {story}", f"Here E=mc2 is met. {story}", "E=mc2", f"{story} {story}", f"{story} Play {story}"]
    assert H.main_text(page, crf).split("\n\n") == want


MB = 1_000_000


@pytest.mark.parametrize(
    "piece",
    ["<div>x", "<div class=a{k}>x", "<a href=x", "<a href=x>y", "<b>", "<p>x", "<p><b>x", "<li>x", "<td>x", "<svg>", "<template><p>", "<p class=\"x>y", "<p class='x", "</b>", "<i></b>x", "<", "<!--", "<!", "</", "x", "<dl><dt>x", "&amp;", "<script>", "<object><p>x</div>", "=\"'>"],
)
def test_a_long_page_takes_seconds(crf, piece):
    import time

    page = "".join(piece.replace("{k}", str(k)) for k in range(MB // len(piece)))
    began = time.process_time()
    H.main_text(page, crf)
    assert time.process_time() - began < 20


def test_names_that_have_no_weight_make_no_difference(crf):
    composer = H.Composer(77)
    for _ in range(30):
        page = composer.page().replace('class="', 'class="other words ')
        found = H.blocks(page)
        assert H.main_text(page, crf) == "\n\n".join(b.text for b, y in zip(found, crf.best(H.features(found))) if y)
