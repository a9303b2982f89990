"""Token files, archives, mixing and decontamination against plain definitions."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quillspan.llm import decontaminate, mixing, token_store, warc
from quillspan.llm.queries import tokenizer_path

from .fixtures import DATA, documents, real, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, np.uint32), np.array([0, 255, 256, 65535, 65536, 2**31]), rng.integers(0, 60000, 5000), rng.geometric(0.01, 3000)):
        codes = token_store.load(token_store.dump([1], np.array([0, len(ids)]), ids))[2]
        assert codes.all().tolist() == ids.tolist()
        assert [codes[i] for i in range(0, len(ids), 37)] == ids[::37].tolist()


def odd(spark):
    r = random.Random(2)
    bits = ["ab", "Zé", "'s", "'", "n't", ".", "—", "12", "|", "<|", "<|endoftext|>", "endoftext", "e", "\u0301", "日", " ", "\u00a0", "\t", "'LL", "ß", "=", "\u0338", "\u2028", "_"]
    return spark.createDataFrame([(i, "".join(r.choices(bits, k=r.randrange(30)))) for i in range(800)], "doc_id long, text string")


@pytest.mark.parametrize("table", [documents, real, odd])
def test_token_store(spark, table):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    docs = table(spark)
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows(token_store.token_file_table(docs, tokenizer_path()), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_store.token_file_table(docs.limit(0), tokenizer_path()).count() == 0


def test_archives(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html")
    extra = spark.createDataFrame([(1000, None, None), (1001, "u\r\nv", ""), (1002, "u", "é"), (1003, "u", "é"), (1003, "u", "é"), (None, "u", "é"), (None, "v", "lone"), (None, "v", "lone")], pages.schema)
    pages = pages.union(extra)
    data = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    best = {}
    for i, b in data:
        best[b] = max(best.get(b, -1), -1 if i is None else i)
    want, done = [], set()
    for i, b in data:
        first = best[b] < 0 or i == best[b] and b not in done
        done |= {b} if first else set()
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else best[b]))
    assert rows(warc.archive(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert warc.archive(pages.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    made = [warc.record(i, f"http://h/{i}", f"body {i} ".encode() * 50, 3 if i == 5 else None) for i in range(8)]
    parts = [warc.member(x) if packed else x for x in made]
    whole = list(warc.salvage(b"".join(parts)))
    assert [x.headers["warc-record-id"] for x in whole] == [f"<urn:page:{i}>" for i in range(8)]
    hurt = list(parts)
    hurt[2] = hurt[2][: len(hurt[2]) // 2]
    broken = bytearray(hurt[4])
    broken[len(broken) // 2] ^= 0xFF
    hurt[4] = bytes(broken)
    hurt[6] = b"junk" + hurt[6]
    found = list(warc.salvage(b"".join(hurt) + parts[0][:40]))
    assert [x.headers["warc-record-id"][10:-1] for x in found if isinstance(x, warc.Record)] == ["0", "1", "3", "5", "6", "7"]
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert [g.length for g in gaps] == [len(hurt[2]), len(hurt[4]), 4, 40]


@pytest.mark.parametrize("table", [documents, real])
def test_mixing(spark, table):
    docs = table(spark)
    got = mixing.mix_sources(docs).toPandas()
    data = [(r.doc_id, len(WORD.findall(r.text or "")), r.source) for r in docs.collect()]
    total = defaultdict(int)
    for _, n, s in data:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    goal, free, rest = {}, set(order), float(sum(total.values()))
    while True:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * total[s]]
        if not over:
            goal |= share
            break
        for s in over:
            goal[s] = 3.0 * total[s]
            rest -= goal[s]
            free.remove(s)
    source = {i: s for i, _, s in data}
    assert sorted(zip(got.doc_id, got["size"])) == sorted((i, n) for i, n, _ in data)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got.itertuples():
        s = source[r.doc_id]
        assert r.source_size == total[s] and abs(r.target - goal[s]) < 1e-6 * max(1, goal[s])
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in order)
    assert rows(mixing.mix_sources(docs), "doc_id", "taken") == sorted(zip(got.doc_id, got.taken), key=repr)
    assert mixing.mix_sources(docs.limit(0)).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_hits(docs, items):
    grams = defaultdict(set)
    for i, t in items:
        w = TERM.findall(lowered(t))
        n = min(13, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[j : j + n])].add(i)
    sizes = {len(g) for g in grams}
    out = []
    for i, t in docs:
        w = TERM.findall(lowered(t))
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (g := tuple(w[j : j + n])) in grams:
                    hit.update(range(j, j + n))
                    found |= grams[g]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("table", [documents, real])
@pytest.mark.parametrize("limit", [4 << 20, 900])
def test_contamination(spark, table, limit, monkeypatch):
    """Also with shards of a few documents each."""
    whole = decontaminate.slices
    monkeypatch.setattr(decontaminate, "slices", lambda b, t, n=limit: whole(b, t, n))
    docs = table(spark)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    some = [r.text for r in docs.filter("length(text) > 200").limit(4).collect()]
    items += [(900, some[0][40:220]), (901, some[1][30:60]), (902, None), (903, ""), (904, "a"), (905, "A, b!"), (906, some[2]), (900, some[0][40:220])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == plain_hits([(r.doc_id, r.text) for r in docs.collect()], items)


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "The cat sat. The CAT sat on a mat"), (2, "a mat for the cat"), (3, None)], "doc_id long, text string")
    assert rows(decontaminate.phrase_matches(docs, ["the cat", "mat"]), "doc_id", "phrase_no", "word") == [(1, 0, 0), (1, 0, 3), (1, 1, 8), (2, 0, 3), (2, 1, 1)]
    assert rows(decontaminate.phrase_matches(docs, ["cat mat"], slop=4), "doc_id", "phrase_no") == [(1, 0), (2, 0)]
