"""Blocks of simple HTML: golden cases, and random token sequences against a machine in SQL."""

import random

import duckdb

from quillspan.operators import html
from quillspan.plans import documents

CASES = {
    "<h3>Q &gt; A</h3><p>one<i>two</i><b>three</b><br>four <em><strong>both</strong></em></p>": [("heading", 3, None, None, "Q > A"), ("paragraph", 0, None, None, "one|/two|*three|\n|four |*/both")],
    "<ol><li>first<ol><li>inner</li><li>next inner</li></ol></li><li>last</li></ol><ul><li>dot</li></ul>": [("listItem", 0, True, 1, "first"), ("listItem", 1, True, 1, "inner"), ("listItem", 1, True, 2, "next inner"), ("listItem", 0, True, 2, "last"), ("listItem", 0, False, 1, "dot")],
    "<table><tr><td>k</td><th>v</th></tr><tr><td><h2>left</h2><p>right</p></td></tr></table>": [("table", 2, None, None, "k|\t|*v|\t|\n|left|\n|right|\t|\n")],
    '<h6>pic<img alt="g" src="data:image/gif;base64,R0lG"/><img SRC="data:image/JPEG;base64,/9j/">ture</h6>': [("heading", 6, None, None, "pic|/9j/|ture")],
    "<p>open<p>next</p>": [("paragraph", 0, None, None, "next")],
    "<table><tr></tr><tr><td>x</td><td></td></tr>never closed": [],
    "<table><tr></tr><tr><td>x</td><td></td></tr></table>": [("table", 2, None, None, "\n|x|\t|\t|\n")],
    "</ul></li><li>no list</li><p></p> <p> </p>": [("paragraph", 0, None, None, " ")],
    "<ol><li>lost<li>kept</ol>after": [("listItem", 0, True, 2, "kept")],
    "": [],
}


def test_blocks(spark):
    docs = spark.createDataFrame([*enumerate(CASES), (99, None)], "id long, html string")
    got = {}
    for r in html.blocks(docs, "id", "html").orderBy("doc_id", "block_no").collect():
        text = "|".join("*" * x.bold + "/" * x.italic + x.text for x in r.inlines)
        got.setdefault(r.doc_id, []).append((r.kind, r.level, r.ordered, r.number, text))
    assert [got.get(i, []) for i in range(len(CASES))] == list(CASES.values()) and 99 not in got


def test_random_tokens(spark):
    """Whatever the order of tags, the windows give what reading the tokens one by one gives."""
    rng = random.Random(5)
    tags = ["p", "h2", "ul", "ol", "li", "table", "tr", "td", "th", "b", "em"]
    token = lambda: rng.choice([f"<{rng.choice(tags)}>", f"</{rng.choice(tags)}>", "<br>", "x", " y &amp; z", " "])
    pages = [(i, "u", "".join(token() for _ in range(rng.randrange(60)))) for i in range(400)]
    nested = ["<table>", "<tr>", "<td>", "<p>", "<ul>", "<li>"]
    pages += [(400 + i, "u", "".join(rng.choice([rng.choice(nested), rng.choice(nested).replace("<", "</"), "t"]) for _ in range(80))) for i in range(200)]
    columns = ["doc_id", "block_no", "kind", "level", "ordered", "number", "inlines"]
    docs = spark.createDataFrame(pages, "doc_id long, url string, text string").select("doc_id", "text")
    got = [tuple(r) for r in documents.rendered_blocks(docs).select(columns).collect()]
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", pages)
    want = c.sql(f"select {', '.join(columns)} from ({documents.SQL['html_blocks']})").fetchall()
    assert len(got) > 500 and sorted(got, key=repr) == sorted(want, key=repr)
