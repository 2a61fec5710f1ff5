"""What pages show, and cards of result pages, from markup that is not well formed."""

import pytest
from pyspark.sql import functions as F

from leadweave.functions.markup import cards, visible_text, visible_text_column
from leadweave.operators.site import site_table
from leadweave.sources.providers import web_search

SHOWN = [
    ("<p>a</p>x<p>b<p>c", "a\n\nx\n\nb\n\nc"),
    ("<div>a <b>b<div>c</div></b> d</div>", "a b\nc\nd"),
    ("a</i>b</br>c", "ab\nc"),
    ("<ul><li>one<li>two</ul>three", "one\ntwo\nthree"),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", "a\tb\nc\nd"),
    ("<title>t</title><body>x<script>var a='<p>';</script>y<style>p{}</style>", "xy"),
    ("<div style='color:red; DISPLAY : none'>no<p>no</p></div>yes", "yes"),
    ("<div style='visibility:hidden'>no</div><span hidden>no</span>yes", "yes"),
    ("<details><summary>s</summary>no<p>no</p></details><details open>o</details>", "s\no"),
    ("<pre>a  b\n c</pre>z", "a  b\n c\nz"),
    ("a<br><br>b", "a\n\nb"),
    ("  lead  <span> trail </span> ", "lead trail"),
    ("<head><title>q</title><div>body</div>", "body"),
    ("r&nbsp;&amp;&copy;&#65;", "r &©A"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<div>x</span></div>y", "x\ny"),
    ("<table><tr><td>a</b></div></td></tr></table><b>q</b>", "a\nq"),
    ("a < b <a href='x", "a < b"),
    ("<!-- <p>no</p> -->yes", "yes"),
    (None, ""),
    ("", ""),
]


@pytest.mark.parametrize(("html", "text"), SHOWN)
def test_visible_text(html, text):
    assert visible_text(html) == text


def test_deep_nesting_and_long_texts():
    assert visible_text("<div>" * 3000 + "x" + "</div>" * 10) == "x"
    assert len(visible_text("<p>word </p>" * 20_000).split()) == 20_000


def test_cards_survive_stray_ends():
    for stray in ("</p>", "</br>", "</span></i>"):
        found = cards(f'<div class="g"><h3>Title</h3>{stray}<a href="x">go</a></div><div class="g">two', lambda tag, kinds: "g" in kinds)
        assert [[e.tag for e in card if e.tag != "br"] for card in found] == [["div", "h3", "a"], ["div"]]
        assert "".join(found[0][0].text) == "Titlego"


def test_stray_ends_in_results(spark):
    pages = spark.createDataFrame([(1, 0, '<div class="g"><h3>Title</h3></p><a href="https://x.example/">go</a></div>')], "query long, place long, html string")
    assert [(r["company_name"], r["website"]) for r in web_search(pages).collect()] == [("Title", "https://x.example/")]


def test_pages_without_text(spark):
    """Address, contact, email and numbers come from the markup alone, hidden ones left out."""
    html = "<div hidden>no@x.example 70000 11111</div><ul><li>Plot 4, SIDCO Estate<li>Chennai, Tamil Nadu 600001</ul><p>Asha Rao (Managing Director)<p>info@two.example +91 98765 43210"
    row = site_table(spark.createDataFrame([("A", 0, "https://a.example", html)], "company_name string, place int, url string, html string")).first()
    assert row["address"] == "Plot 4, SIDCO Estate, Chennai, Tamil Nadu 600001" and row["contact_person"] == "Asha Rao"
    assert row["email"] == "info@two.example" and row["phones"] == ["+91 98765 43210"]


def test_null_pages(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "id long, html string").select(visible_text_column(F.col("html")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["", ""]
