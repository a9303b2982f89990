"""Redacted Word parts, and joins of intervals by position."""

import random

import pytest

from quillspan.operators import docx, intervals, pages, redact, rules


@pytest.mark.parametrize("bucket", [1, 7, 1024])
def test_overlaps_are_all_pairs_that_meet(spark, bucket):
    r = random.Random(bucket)
    span = lambda: (a := r.randrange(0, 60), a + r.choice([0, 1, 2, 9, 50]))
    left = [(r.randrange(3), i, *span()) for i in range(90)]
    right = [(r.randrange(3), i, *span()) for i in range(90)]
    x = spark.createDataFrame(left, "k int, i int, a int, b int")
    y = spark.createDataFrame(right, "k int, j int, c int, d int")
    got = sorted((p.i, p.j) for p in intervals.overlapping(x, y, "k", "a", "b", "c", "d", bucket).collect())
    assert got == sorted((p[1], q[1]) for p in left for q in right if p[0] == q[0] and p[2] < q[3] and q[2] < p[3])


def text(*runs):
    return "<w:p>" + "".join(f"<w:r>{style}<w:t>{t}</w:t></w:r>" for style, t in runs) + "</w:p>"


B, I = "<w:rPr><w:b/></w:rPr>", "<w:rPr><w:i/></w:rPr>"


def redacted(spark, parts):
    files = spark.createDataFrame([(d, n, x) for d, n, x in parts], "doc_id int, name string, xml string")
    _, whole = docx.parts(files)
    plan = redact.plan(rules.candidates(whole, [rules.BY_NAME["email"]]))
    out = docx.redact(files, plan).cache()
    want = {r.doc_id: r.redacted for r in redact.apply(whole, plan).collect()}
    assert {r.doc_id: r.text for r in docx.parts(out)[1].collect()} == want
    return {(r.doc_id, r.name): r.xml for r in out.collect()}


def test_a_value_over_several_runs_keeps_their_formats(spark):
    body = text((B, "Write to zoe@"), (I, "river."), ("", "example"), ("", ".org; bye"))
    got = redacted(spark, [(1, "word/document.xml", body)])[1, "word/document.xml"]
    keep = '<w:t xml:space="preserve">'
    assert got == f"<w:p><w:r>{B}{keep}Write to [EMAIL_1]</w:t></w:r><w:r>{I}{keep}</w:t></w:r><w:r>{keep}</w:t></w:r><w:r>{keep}; bye</w:t></w:r></w:p>"


def test_parts_share_labels_and_keep_signs(spark):
    one = text(("", "q@w.de &amp; k@l.de &lt;ok&gt;")) + '<w:p><w:r><w:t xml:space="default">q@w.de</w:t></w:r></w:p>'
    parts = [(1, "word/document.xml", one), (1, "word/footer2.xml", text(("", "again k@l.de"))), (1, "word/styles.xml", '<x w:author="Kim">k@l.de</x>'), (2, "word/document.xml", text(("", "nothing &amp; more"))), (2, "word/header1.xml", "")]
    got = redacted(spark, parts)
    assert got[1, "word/document.xml"] == '<w:p><w:r><w:t xml:space="preserve">[EMAIL_1] &amp; [EMAIL_2] &lt;ok&gt;</w:t></w:r></w:p><w:p><w:r><w:t xml:space="default">[EMAIL_1]</w:t></w:r></w:p>'
    assert got[1, "word/footer2.xml"] == '<w:p><w:r><w:t xml:space="preserve">again [EMAIL_2]</w:t></w:r></w:p>'
    assert got[1, "word/styles.xml"] == '<x w:author="">k@l.de</x>'
    assert got[2, "word/document.xml"] == parts[3][2] and got[2, "word/header1.xml"] == ""


def test_changes_and_people_go(spark):
    body = '<w:p><w:ins w:author="Kim"><w:r><w:t>stays</w:t></w:r></w:ins><w:del w:author="Lou"><w:r><w:delText>o@p.fr</w:delText></w:r></w:del></w:p>'
    parts = [(1, "word/document.xml", body), (1, "word/comments.xml", f'<w:c w:author="Lou" w:initials="L">{text(("", "seen"))}</w:c>'), (1, "docProps/core.xml", "<c><dc:title>Plan\nB</dc:title><dc:creator>Kim</dc:creator><n>1</n></c>"), (1, "docProps/app.xml", "<p><Company>Acme</Company><Pages>3</Pages></p>")]
    got = redacted(spark, parts)
    assert not any(s in "".join(got.values()) for s in ("Kim", "Lou", "o@p.fr", "Plan", "Acme"))
    assert got[1, "word/document.xml"] == "<w:p><w:r><w:t>stays</w:t></w:r></w:p>" and "<Pages>3</Pages>" in got[1, "docProps/app.xml"] and "<n>1</n>" in got[1, "docProps/core.xml"]


def test_an_empty_node_within_a_value_gets_no_label(spark):
    files = spark.createDataFrame([(1, "word/document.xml", "<w:p><w:tab/><w:t></w:t><w:t>abc</w:t><w:t>d</w:t></w:p>")], "doc_id int, name string, xml string")
    plan = spark.createDataFrame([(1, 0, 3, "[X_1]")], "doc_id int, start int, end int, label string")
    keep = '<w:t xml:space="preserve">'
    assert docx.redact(files, plan).head().xml == f"<w:p><w:tab/>{keep}</w:t>{keep}[X_1]c</w:t><w:t>d</w:t></w:p>"


def test_a_long_part_with_many_values(spark):
    n = 4000
    body = text(*(("", f"u{i % 50}@mail.org, x") for i in range(n)))
    got = redacted(spark, [(1, "word/document.xml", body)])[1, "word/document.xml"]
    assert got.count("[EMAIL_") == n and "@" not in got


def test_boxes_by_width(spark):
    items = spark.createDataFrame([(1, 1, 0, "iiWW", 100.0, 10.0, 40.0, 10.0, False, True)], "doc_id int, page int, item int, str string, left double, top double, width double, height double, has_eol boolean, horizontal boolean")
    _, spans = pages.page_text(items)
    ranges = spark.createDataFrame([(1, 0, 2)], "doc_id int, start int, end int")
    even, wide = pages.boxes(ranges, items, spans).head(), pages.boxes(ranges, items, spans, by_width=True).head()
    assert even.width == pytest.approx(20 + 3) and wide.width == pytest.approx(40 * 444 / 2332 + 3)


def test_packages_need_no_group_of_their_own(spark):
    """Each document was a group of pandas; packages hold the same parts in the order of their names."""
    import io
    import zipfile

    rows = [(d, n, f"<w:t>{d}{n}é</w:t>") for d in (3, 1, 2, None, 70_000) for n in ("word/b.xml", "word/a.xml", "docProps/core.xml")]
    df = docx.zip_parts(spark.createDataFrame(rows, "doc_id long, name string, xml string").repartition(5))
    assert "FlatMapGroups" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: bytes(r.content) for r in df.collect()}
    assert set(got) == {3, 1, 2, None, 70_000}
    for d, content in got.items():
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            assert z.namelist() == ["docProps/core.xml", "word/a.xml", "word/b.xml"] and z.read("word/b.xml").decode() == f"<w:t>{d}word/b.xmlé</w:t>"
