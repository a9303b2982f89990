"""Token counts, codes over metric trees and source divergence against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspan.llm import balls, divergence, queries, token_counts
from quillspan.llm.queries import tokenizer_path

from .fixtures import DATA, documents, real, rows

BYTES = "byte_bpe_50k.json"

# ---------------------------------------------------------------- op11


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(BYTES))


def plain_count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_token_counts_of_the_table(spark, library):
    want = [(r.doc_id, len((r.text or "").encode()), n := plain_count(library, r.text), n > 1024) for r in real(spark).collect()]
    assert rows(queries.op11_whole_token_counts(spark, DATA), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)


def test_token_counts_of_awkward_rows(spark, library):
    docs = documents(spark).withColumns({c: F.lit("z") for c in ("n_bytes", "n_tokens", "over_limit")})
    got = token_counts.token_counts(docs, tokenizer_path(BYTES))
    want = [(r.doc_id, len((r.text or "").encode()), plain_count(library, r.text)) for r in docs.collect()]
    assert rows(got, "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)
    assert token_counts.token_counts(docs.limit(0), tokenizer_path(BYTES)).count() == 0


SIGNS = ["a", "Z", "é", "ß", "日", "٣", "7", "½", " ", "  ", "\n", "\t", " ", " ", "\x1c", "\x85", "​", "'s", "'ll", "'", "!", "😀", "́", "<|endoftext|>", "<|", "|>", "endoftext", "᠎", "\U0001e030", "Ᲊ", "\U00010ec2", "\x00"]


def test_token_counts_of_random_signs(library):
    r, counter = random.Random(5), token_counts.TokenCounter(tokenizer_path(BYTES))
    for _ in range(4000):
        text = "".join(r.choices(SIGNS, k=r.randrange(0, 14)))
        assert counter(text)[0] == plain_count(library, text), repr(text)


def test_characters_on_which_versions_differ_go_to_the_library(library):
    counter = token_counts.TokenCounter(tokenizer_path(BYTES))
    counter.unlike.add("é")
    counter.alike.discard("é")
    assert counter("né à côté")[0] == plain_count(library, "né à côté") and counter("né à côté")[1] == 0


def test_long_texts_are_cut_where_pre_tokens_end(library, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE", 50)
    counter = token_counts.TokenCounter(tokenizer_path(BYTES))
    text = " ".join("word" * (i % 3 + 1) + "'s  7"[: i % 6] for i in range(400)) + "x" * 300 + "\n\n  end"
    assert len(list(counter.pieces(text))) > 10
    assert counter(text)[0] == plain_count(library, text)


def test_every_proven_string_is_one_token(library):
    proven, cut = token_counts.prove(library), token_counts.TokenCounter(tokenizer_path(BYTES)).cut
    assert len(proven) > 40_000
    assert all(plain_count(library, x) == 1 for x in random.Random(1).sample(sorted(proven), 3000) if len(cut(x)) == 1)


# ---------------------------------------------------------------- op12


def plain_codes(data, parts=8, k=16, rounds=6):
    """data: (vec_id, label, vector or None)."""
    kept = [(i, la, [int(np.floor(4096 * float(c))) for c in v]) for i, la, v in data if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return []
    w = max(1, -(-max(len(v) for _, _, v in kept) // parts))
    kept = [(i, la, v + [0] * (parts * w - len(v))) for i, la, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))]
    codes, errors, books = [[] for _ in kept], [0] * len(kept), []
    for part in range(parts):
        xs = [v[part * w : part * w + w] for _, _, v in kept]
        book = xs[:k]
        for n in range(rounds + 1):
            own = [min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book)) for x in xs]
            if n < rounds:
                book = [[sum(col) // len(mine) for col in zip(*mine)] if (mine := [x for x, o in zip(xs, own) if o[1] == e]) else c for e, c in enumerate(book)]
        for j, (d, e) in enumerate(own):
            codes[j].append(e)
            errors[j] += d
        books += [str(x) for c in book for x in c]
    by = Counter()
    for (_, la, _), e in zip(kept, errors):
        by[la] += e
    sha = hashlib.sha256(",".join(books).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for e in c), err, by[la], sha) for (i, la, _), c, err in zip(kept, codes, errors)]


COLUMNS = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


@pytest.mark.parametrize("seed", range(3))
def test_codes_of_awkward_vectors(spark, seed, monkeypatch):
    monkeypatch.setattr(balls, "CHUNK", 37)
    r = random.Random(seed)
    length = (16, 19, 5)[seed]
    vector = lambda: [r.choice([r.gauss(0, 1), 0.25, -0.5]) for _ in range(length)]
    data = [(i, r.choice([1, 2, None]), vector()) for i in range(150)]
    data += [(900 + i, 3, data[5][2]) for i in range(90)] + [(7, 4, vector()), (7, 4, data[7][2]), (None, None, vector()), (None, 1, None)]
    data += [(801, 1, [float("nan")] * length), (802, 1, vector()[:-1] + [float("inf")]), (803, 1, vector()[:-1] + [None]), (804, 1, vector()[:3]), (805, 1, [])]
    df = spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("z") for c in ("code", "error", "n", "x", "same", "salt")})
    want = sorted(plain_codes(data), key=repr)
    assert rows(balls.compress(df.repartition(3)), *COLUMNS) == want
    monkeypatch.setattr(balls, "FEW_LABELS", 1)
    assert rows(balls.compress(df), *COLUMNS) == want


def test_codes_of_few_vectors(spark):
    schema = "vec_id long, label int, embedding array<float>"
    data = [(3, 1, [0.5] * 8), (1, None, [0.25] * 8), (2, None, [0.5] * 8)]
    assert rows(balls.compress(spark.createDataFrame(data, schema)), *COLUMNS) == sorted(plain_codes(data), key=repr)
    assert balls.compress(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="too large"):
        balls.compress(spark.createDataFrame([(1, 1, [1e30] * 8)], schema)).count()


def test_tree_has_every_point_once_and_owns_whole_balls():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 40, (400, 8)) for c in (-5000, 0, 5000)]).astype(np.int64)
    tree = balls.Tree(x)
    assert sorted(tree.points) == list(range(1200)) and (tree.sum[0] == x.sum(0)).all()
    inner = [np.sqrt(((x[tree.points[a:b]] - c) ** 2).sum(1).max()) <= r for a, b, c, r in zip(tree.start, tree.end, tree.centre, tree.radius)]
    assert all(inner)
    entries = x[[0, 400, 800]]
    counts, sums, label = tree.assign(x, entries, True)
    assert counts.tolist() == [400] * 3 and (sums == x.reshape(3, 400, 8).sum(1)).all()
    # no point has to be looked at: its ball has one owner
    counts, sums, _ = tree.assign(x * 0, entries, False)
    assert counts.tolist() == [400] * 3 and (sums == x.reshape(3, 400, 8).sum(1)).all()


# ---------------------------------------------------------------- op13

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(data, least, top=50):
    """data: (text, lang, source)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df, out = {}, {}, []
    for text, lang, source in data:
        lang, words = lang or "", TERM.findall((text or "").translate(low))
        counts.setdefault(lang, {}).setdefault(source or "", Counter()).update(words)
        df.setdefault(lang, Counter()).update(set(words))
    for lang, groups in counts.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, v, rank))
    return sorted(out, key=repr)


ROW = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("seed", range(4))
def test_divergence_of_random_groups(spark, seed, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", (1, 40, 1 << 15, 7)[seed])
    monkeypatch.setattr(divergence, "DENSE", (1 << 23, 30, 1, 25)[seed])
    monkeypatch.setattr(divergence, "FEW_GROUPS", (0, 1000)[seed % 2])
    monkeypatch.setattr(divergence, "HELD", 20)
    r = random.Random(seed)
    vocab = [a + b for a in ("Th", "on", "éR", "ß", "日本") for b in ("at", "IN", "", "ue", "'s", "3x")]
    data = [(" ".join(r.choices(vocab, weights=range(1, 31), k=r.randrange(0, 12))), r.choice(["en", "de", None, "x"]), r.choice(["a", "b", "c", "É", "z", None, ""])) for _ in range(160)]
    data += [(None, "en", "silent"), ("", "fr", "one"), (None, "fr", "two"), ("!!! 123", None, "signs"), (data[0][0], "en", "a"), ("word " * 5000, "en", "b")]
    df = spark.createDataFrame(data, "text string, lang string, source string").withColumns({c: F.lit("z") for c in ("term", "n", "df", "no", "part", "value", "p")})
    assert rows(divergence.audit(df.repartition(3), least=4), *ROW) == plain_audit(data, 4)


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0
