"""PartEnum join against all pairs, on small tables."""

import random
import re

import numpy as np
import pytest

from quillspan.llm import jaccard

from .fixtures import documents, real, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(data):
    sets = [(i, shingles(t)) for i, t in data]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        r = root(x)
        least[r] = min(least.get(r, i), i)
    return sorted([(i, len(s), least[root(x)]) for x, (i, s) in enumerate(sets)], key=repr)


def near(spark):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    passage = r.choices(vocab, k=40)
    out = []
    for n in [1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 18, 19, 20, 22, 24, 26, 30, 34, 40, 48, 60, 75, 90, 120, 160, 220, 300]:
        for _ in range(3):
            base = r.choices(vocab, k=n)
            out.append(base)
            for _ in range(5):
                w = list(base)
                for _ in range(r.choice([0, 1, 1, max(1, n // 40), max(1, n // 30)])):
                    kind, at = r.randrange(3), r.randrange(len(w))
                    if kind == 0:
                        w[at] = r.choice(vocab)
                    elif kind == 1:
                        w = w[: -max(1, n // 12)] or w
                    else:
                        w = w + r.choices(vocab, k=max(1, n // 12))
                out.append(w)
    out += [r.choices(vocab, k=r.randrange(5, 120)) + passage + r.choices(vocab, k=r.randrange(0, 120)) for _ in range(150)]
    r.shuffle(out)
    return spark.createDataFrame([(i * 7 % 10007, " ".join(w)) for i, w in enumerate(out)], "doc_id long, text string")


@pytest.mark.parametrize("table", [documents, real, near])
@pytest.mark.parametrize("tile", [3, 4096])
def test_components(spark, table, tile, monkeypatch):
    """Also with groups cut into tiles, all large, and every shingle of two sets frequent."""
    if tile == 3:
        for name, value in (("TILE", 3), ("FEW", 2), ("FREQUENT", 2)):
            monkeypatch.setattr(jaccard, name, value)
    docs = table(spark).repartition(3)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert rows(jaccard.join(docs), "doc_id", "n_shingles", "component_id") == want
    assert sum(a != c for a, _, c in want) > 5


def hot(spark):
    """A group of distinct texts that all link with each other, and one in which only some do."""
    r = random.Random(3)
    base, out = [f"b{i}" for i in range(400)], []
    for i in range(60):
        out.append(" ".join([*base, f"x{i}"]))
    for _ in range(60):
        w = [f"c{i}" for i in range(300)]
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(300)] = f"y{r.random()}"
        out.append(" ".join(w))
    out += out[:5]
    return spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")


@pytest.mark.parametrize("table", [documents, real, near, hot])
@pytest.mark.parametrize("block", [7, 512])
def test_links(spark, table, block, monkeypatch):
    """Every document has the number of other distinct sets that are similar to its own, also across blocks."""
    monkeypatch.setattr("quillspan.llm.jaccard.BLOCK_SETS", block)
    docs = table(spark).repartition(3)
    sets = [(r.doc_id, frozenset(shingles(r.text))) for r in docs.collect()]
    distinct = {s for _, s in sets if s}
    links = {s: sum(a != s and 100 * len(a & s) >= 80 * len(a | s) for a in distinct) for s in distinct}
    want = sorted([(i, links.get(s, 0)) for i, s in sets], key=repr)
    assert rows(jaccard.join(docs), "doc_id", "n_links") == want


def test_links_of_a_lone_side():
    """A block whose partner is empty has no links with it."""
    sets = [np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64)]
    assert jaccard.linked_in(sets, np.array([True, True]), False).tolist() == [0, 0]
    assert jaccard.linked_in(sets, np.array([False, False]), False).tolist() == [0, 0]
    assert jaccard.linked_in(sets, np.array([True, True]), True).tolist() == [1, 1]
    assert jaccard.linked_in(sets, np.array([True, False]), False).tolist() == [1, 1]


def test_empty(spark):
    assert jaccard.join(documents(spark).limit(0)).count() == 0


def test_signatures_meet():
    """Every similar pair of random sets shares a signature, with and without frequent elements left out."""
    rng = np.random.default_rng(5)

    class Fake:
        pass

    for n in [*range(1, 60), 75, 100, 140, 200, 333, 800]:
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        lists = [a]
        for _ in range(12):
            drop = rng.integers(0, max(1, n // 5) + 1)
            b = np.concatenate([rng.permutation(a)[: n - drop], rng.integers(0, 1 << 63, rng.integers(0, max(1, n // 4) + 1), dtype=np.uint64)])
            lists.append(b)
        sets = Fake()
        lists = [np.unique(x) for x in lists if len(x)]
        sets.s, sets.d = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        sets.n = np.array([len(x) for x in lists])
        sets.first = np.concatenate([[0], np.cumsum(sets.n)])
        sets.own = np.arange(len(lists))
        for frequent in (np.zeros(0, np.uint64), np.sort(rng.permutation(a)[: n // 2]), np.sort(a)):
            keys, who = jaccard.signatures(sets, ~np.isin(sets.s, frequent))
            of = [set(keys[who == i].tolist()) for i in range(len(lists))]
            for i in range(len(lists)):
                for j in range(i):
                    both = len(np.intersect1d(lists[i], lists[j]))
                    if 100 * both >= 80 * (len(lists[i]) + len(lists[j]) - both):
                        assert of[i] & of[j], (n, len(lists[i]), len(lists[j]), both)
