import random
import time
from collections import Counter

import pytest

from graphloom.llm import pages
from graphloom.llm.queries import llm_queries


def extract(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in pages.extract_text(df).collect()}


def host(spark, htmls, name="h"):
    return list(extract(spark, [(i, f"http://{name}/{i}", h) for i, h in enumerate(htmls)]).values())


def test_nothing_of_an_article_is_dropped(spark):
    """Headings and sentences that recur on every page of a host are its text all the same, with or without an article element."""
    inner = "<h1>Title {0}</h1><h2>Summary</h2><p>Body text number {0}, of which there is more than of anything else on the page, and more yet.</p><h2>Method</h2><p>We did the usual thing.</p>"
    want = ["\n\n".join([f"Title {k}", "Summary", f"Body text number {k}, of which there is more than of anything else on the page, and more yet.", "Method", "We did the usual thing."]) for k in range(6)]
    frame = "<html><body><nav><ul><li>Home</li></ul></nav>{0}<footer>f</footer></body></html>"
    assert host(spark, [frame.format("<article>" + inner.format(k) + "</article>") for k in range(6)]) == want
    assert host(spark, [frame.format("<div class='content'>" + inner.format(k) + "</div>") for k in range(6)]) == want


def test_slots_between_template_tokens(spark):
    """No article, no telling names: the template's boxes hold the same on all pages, the slot holds what differs."""
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    page = "<html><body><div class='a'><div class='b'><p>Welcome to our site</p><p>Call us</p></div></div><div class='c'><h1>About {0}</h1><p>{1}</p><p>{0} again</p></div><div class='d'><p>All rights reserved</p><div class='e'>Made here</div></div></body></html>"
    body = {w: " ".join(f"{w}{k}" for k in range(20)) for w in words}
    assert host(spark, [page.format(w, body[w]) for w in words]) == [f"About {w}\n\n{body[w]}\n\n{w} again" for w in words]
    flat = "<html><body><div class='b'><p>Welcome to our site</p><p>Call us</p></div><h1>About {0}</h1><p>{1}</p><div class='d'><p>All rights reserved</p></div></body></html>"
    assert host(spark, [flat.format(w, body[w]) for w in words]) == [f"About {w}\n\n{body[w]}" for w in words]


def brute_classes(htmls):
    """Occurrence vectors written out: tokens with equal ones, on half of the pages and on three at least."""
    seen = {}
    for i, raw in enumerate(htmls):
        for token, text, _, _ in pages.Page(raw).tokens():
            seen.setdefault((token, text), [0] * len(htmls))[i] += 1
    often = {t: tuple(v) for t, v in seen.items() if 2 * sum(n > 0 for n in v) >= len(htmls) and sum(n > 0 for n in v) >= 3}
    large = {v for v, n in Counter(often.values()).items() if n >= 2}
    groups = {}
    for (token, _), v in often.items():
        if v in large:
            groups.setdefault(v, set()).add(token)
    return sorted(map(sorted, groups.values()))


def test_classes_against_written_out_vectors(spark):
    rng = random.Random(4)
    for _ in range(3):
        boxes = [f"<div class='x{k}'>{'<p>same ' + str(k) + '</p>' if k % 2 else ''}{{}}</div>" for k in range(6)]
        htmls = []
        for i in range(7):
            held = "".join(b.format(" ".join(rng.choice("abc") for _ in range(rng.randrange(3)))) * (2 if rng.random() < 0.3 else 1) for b in boxes if rng.random() < 0.85)
            htmls.append(f"<html><body>{held}<p>page {i}</p></body></html>")
        df = spark.createDataFrame([(i, "h", h) for i, h in enumerate(htmls)] + [(99, "h", htmls[0])], "page_id long, host string, html string")
        got = {}
        for r in pages.candidates(df)[0].collect():
            got.setdefault(r["class"], set()).add(r.token)
        assert sorted(map(sorted, got.values())) == brute_classes(htmls)


def test_ordered_and_nested():
    sizes = {1: 3, 2: 2, 3: 2}
    order = lambda text: [({"A": 10, "B": 11, "C": 12, "x": 20, "y": 21, "s": 30, "t": 31}[c], {"A": 1, "B": 1, "C": 1, "x": 2, "y": 2, "s": 3, "t": 3}[c]) for c in text]
    assert pages.nesting(order("AxyBC"), sizes) == ({1: (10, 11, 12), 2: (20, 21)}, set())
    assert pages.nesting(order("AxyxystBC"), sizes)[1] == set()
    assert pages.nesting(order("AxByC"), sizes)[1] == {2}  # crosses a gap of the class around it
    assert pages.nesting(order("Axsyt BC".replace(" ", "")), sizes)[1] == {3}
    assert pages.nesting(order("xyyxABC"), sizes)[1] == {2}  # not one cycle
    assert pages.nesting(order("ABxyCA"), sizes)[1] == {1}  # a cycle that doesn't end


def test_linear_on_broken_and_deep_pages():
    for text in ("<a ", "<li>x ", "<div>", "<a title=\"", "<a title='x\" ", "<p><b>", "</div>", "<!-- ", "<script>", "<![CDATA[", "<td>x<table>", "= ' \" <", "<ul><li>", "<button>", "<div class='ad'>x", "<p class=it's>y"):
        took = []
        for n in (20_000, 200_000):
            raw = text * (n // len(text) + 1)
            began = time.time()
            pages.main_text(raw, None)
            took.append(time.time() - began)
        assert took[1] < 4, (text, took)


def test_linear_after_an_open_script():
    for head, text in (("<script>", "</script "), ("<p>x<style>", "</style\n"), ("<textarea>", "</textarea x=' ")):
        began = time.time()
        pages.main_text(head + text * 40_000, None)
        assert time.time() - began < 4, text


def test_reading():
    read = lambda raw: pages.main_text(raw, None)
    assert read("<ul><li>a<li>b<p>c</ul><table><tr><td>1<td>2<tr><td>3</table><dl><dt>x<dd>y</dl>") == "a\n\nb\n\nc\n\n1\n\n2\n\n3\n\nx\n\ny"
    assert read("a < b and c > d <1> <") == "a < b and c > d <1> <"
    assert read("<p title='a>b' class=\"c>d\">one</p><p class=it's>two</p>") == "one\n\ntwo"
    assert read("<p>say <button>Buy <b>now</b></button> it &amp; go &lt;b&gt; &#233;</p>") == "say it & go <b> é"
    assert read("<p>x<!-- <p>no --> y</p><script>var a='</p>';</script ><p>z<!-- open") == "x y\n\nz"
    assert read("text <b unfinished") == "text <b unfinished"
    assert read("<p>one <i>two</i>\n three<br>four</p>") == "one two three four"
    assert read("") == "" and read("<p></p>") == ""


def test_odd_rows(spark):
    same = "<html><body><article>only this &copy;</article></body></html>"
    rows = [(1, None, None), (2, None, ""), (3, "no url", same), (3, "no url", same), (None, "http://H:80/x", same), (5, "http://user@h/y", "<p>" + "long " * 300_000 + "</p>")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, host string, main int")
    out = pages.extract_text(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 11), (1, 0), (2, 0), (3, 11), (3, 11), (5, 1_499_999)]
    assert all(r.text in ("", "only this ©") or r.text.startswith("long long") for r in out)
    assert pages.extract_text(df.limit(0)).collect() == []


def test_shuffled_and_broadcast_templates_agree(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    one = sorted(map(tuple, pages.extract_text(df).collect()))
    monkeypatch.setattr(pages, "BROADCAST_NUMBERS", 0)
    assert sorted(map(tuple, pages.extract_text(df.repartition(5)).collect())) == one


@pytest.mark.parametrize("sf", ["0.001"])
def test_query(spark, sf):
    out = llm_queries()["op5_main_text"](spark, f"/root/testdata/sf{sf}").collect()
    assert len(out) == spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet").count() and all(r.n_chars == len(r.text) for r in out)
