"""Null ids, texts longer than a chunk and clashing columns, for every operator."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.llm import ann, decontaminate, jaccard, lm, mixing, substring, suffix, token_store, toxicity, warc
from quillspan.llm.queries import tokenizer_path

from .fixtures import DATA, DOCS, documents, rows
from .test_jaccard import shingles
from .test_sequences import Plain, fold, lowered, removed
from .test_stores import plain_hits

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """Also rows with null ids, two of which repeat each other and one a text with an id, and repeated ids."""
    base = documents(spark)
    long = max((r.text or "" for r in base.collect()), key=len)
    more = [(None, long), (None, long), (None, long + " tail"), (None, None), (None, ""), (1, "one two three four five six"), (1, long[:900])]
    extra = spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in more], DOCS)
    # columns named as those that operators add
    return base.union(extra).withColumns({c: F.lit(7) for c in ("hits", "items", "n_words", "target", "key", "salt", "rate", "exchange", "offsets", "folds")}).cache()


@pytest.fixture
def small(monkeypatch):
    """Chunks far smaller than the longer texts."""
    for m in (lm, suffix, jaccard):
        monkeypatch.setattr(m, "CHUNK", 700)
    whole = substring.chunked
    monkeypatch.setattr(substring, "chunked", lambda d, i, t: whole(d, i, t, 700))


def test_substrings(spark, docs, small):
    data = [(r.doc_id, WORD.findall(r.text or "")) for r in docs.collect()]
    want = [(i, len(u), sum(g), hashlib.sha256(" ".join(w for w, x in zip(u, g) if not x).encode()).hexdigest()) for i, u, g in removed(data, 50, tuple)]
    assert rows(substring.deduplicate(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert any(i is None and n for i, _, n, _ in want)


def test_suffixes(spark, docs, small):
    data = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = [(i, len(u), sum(g), hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest()) for i, u, g in removed(data, 50, bytes)]
    assert rows(suffix.deduplicate(docs), "doc_id", "n_bytes", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_language_model(spark, docs, small):
    data = [(r.doc_id, WORD.findall(lowered(r.text)) + [None]) for r in docs.collect()]
    plain = Plain(data, 3)
    got = lm.score(docs).collect()
    key = lambda x: (x[0] is None, x[0], x[1])
    have, want = sorted(((r.doc_id, r.n_tokens, r.score) for r in got), key=key), sorted(((i, len(t), plain.score(t)) for i, t in data), key=key)
    assert [x[:2] for x in have] == [x[:2] for x in want] and [x[2] for x in have] == pytest.approx([x[2] for x in want], rel=1e-6)
    assert all(r.held_out == (fold(r.doc_id) == 1) for r in got)


def test_tokens(spark, docs):
    """The ids of each document are the library's own, and lie one after the other."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    plain = []
    for r in docs.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        plain.append((r.doc_id, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    got = token_store.token_file_table(docs, tokenizer_path())
    assert rows(got, "doc_id", "n_tokens", "ids_crc32") == sorted(plain, key=repr)
    at, before = 0, None
    for r in got.orderBy("start").collect():
        key = (r.doc_id is not None, r.doc_id or 0)
        assert r.start == at and (before is None or before <= key)
        at, before = at + r.n_tokens, key


def test_toxicity(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0, 5), (4, 0, 0, 5), (None, 1, None, 5), (4, None, 0, 5)], "doc_id long, toxic int, quality int, text int")
    got = toxicity.toxicity(docs, labels)
    assert got.count() == docs.count() and got.filter("score between 0 and 1 and (score >= 0.5) = (predicted = 1)").count() == docs.count()


def test_join(spark, docs, small):
    """Components and links of null ids and of texts longer than a chunk: a component of null ids alone has none."""
    data = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    near = lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)
    left, want = set(range(len(data))), []
    while left:
        part, edge = set(), {left.pop()}
        while edge:
            part |= edge
            edge = {y for y in left for x in edge if near(data[x][1], data[y][1])}
            left -= edge
        least = min((data[x][0] for x in part if data[x][0] is not None), default=None)
        kinds = {frozenset(data[x][1]) for x in part}
        want += [(data[x][0], len(data[x][1]), least, sum(k != data[x][1] and near(k, data[x][1]) for k in kinds)) for x in part]
    assert rows(jaccard.join(docs), "doc_id", "n_shingles", "component_id", "n_links") == sorted(want, key=repr)
    assert any(i is None and c is not None for i, _, c, _ in want) and any(n for *_, n in want)


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs)
    size = {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text or ""))
    assert Counter((r.doc_id, r["size"]) for r in got.collect()) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in docs.collect())
    assert all(r.source_size == size[r.source] and r.taken <= 3 * r["size"] for r in got.collect())
    assert rows(got, "doc_id", "size", "taken") == rows(mixing.mix_sources(docs.repartition(5)), "doc_id", "size", "taken")


def test_contamination(spark, docs):
    long = max((r.text or "" for r in docs.collect()), key=len)
    items = [(None, long[100:300]), (7, long[400:700]), (7, "two three four"), (8, None)]
    bench = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in items], "item_id long, text string, doc_id int, hits int, items string")
    got = rows(decontaminate.contamination(docs, bench), "doc_id", "n_words", "n_hit", "contaminated")
    assert got == sorted([(r[0], r[1], r[2], r[5]) for r in plain_hits([(r.doc_id, r.text) for r in docs.collect()], items)], key=repr)


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 3_000_000), (2, "u", "x" * 3_000_000), (None, None, None), (3, "v", "")], "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("z") for c in ("sha", "n", "row", "first", "of", "payload")})
    assert rows(warc.archive(pages), "page_id", "payload_bytes", "record_type", "refers_to") == sorted([(1, 3_000_000, "revisit", 2), (2, 3_000_000, "response", None), (3, 0, "response", None), (None, 0, "revisit", 3)], key=repr)


def test_vectors(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    clash = e.withColumns({c: F.lit("z") for c in ("query_id", "rank", "score", "e", "g", "cell", "n")})
    assert rows(ann.neighbours(clash), "query_id", "rank", "vec_id") == rows(ann.neighbours(e), "query_id", "rank", "vec_id")
