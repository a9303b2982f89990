"""Language model, substring deduplication and suffix sorting against plain definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillspan.llm import lm, substring, suffix

from .fixtures import documents, real, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fold(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5


class Plain:
    """The interpolated model by its definition, over lists of tokens."""

    def __init__(self, data, order):
        self.order = order
        est, held = ([t for i, t in data if keep(fold(i))] for keep in (lambda f: f not in (lm.HELD_OUT, lm.TUNE), lambda f: f == lm.TUNE))
        self.count(est)
        events = defaultdict(list)
        for t in held:
            for j in range(len(t)):
                b, ml = self.estimates(self.history(t, j), t[j])
                # estimates in the steps of the events' bins
                events[b].append([1 / (self.types + 1), *(2 ** (round(math.log2(p) * lm.BINS) / lm.BINS) if p else 0.0 for p in ml)])
        self.weights = {}
        for b, rows_ in events.items():
            w = [1 / (order + 1)] * (order + 1)
            some = [0.01 * any(r[k] for r in rows_) for k in range(order + 1)]
            for _ in range(40):
                now = list(some)
                for r in rows_:
                    s = sum(x * y for x, y in zip(r, w))
                    for k in range(order + 1):
                        now[k] += r[k] * w[k] / s
                w = [x / sum(now) for x in now]
            self.weights[b] = w
        self.count([t for i, t in data if fold(i) != lm.HELD_OUT])

    def count(self, texts):
        self.grams = Counter((*self.history(t, j)[self.order - n :], t[j]) for t in texts for j in range(len(t)) for n in range(1, self.order + 1))
        self.texts, self.tokens, self.types = len(texts), sum(map(len, texts)), sum(len(g) == 1 for g in self.grams)

    def history(self, t, j):
        """The order - 1 tokens before; 0 stands before a text."""
        return tuple(t[k] if k >= 0 else 0 for k in range(j - self.order + 1, j))

    def estimates(self, history, word):
        b, ml = 0, [self.grams[word,] / max(self.tokens, 1)]
        for n in range(2, self.order + 1):
            h = history[self.order - n :]
            c = self.texts if h[-1] == 0 else self.grams[h]
            if c:
                b = 32 * n + min(int(math.log2(c)), 31)
            ml.append(self.grams[*h, word] / max(c, 1))
        return b, ml

    def p(self, history, word):
        b, ml = self.estimates(history, word)
        at = max((x for x in self.weights if x <= b), default=None)
        w = [0.5, 0.5, *[0.0] * (self.order - 1)] if at is None else self.weights[at]
        return sum(max(x, 1e-9) * y for x, y in zip(w, [1 / (self.types + 1), *ml]))

    def score(self, t):
        return sum(math.log10(self.p(self.history(t, j), t[j])) for j in range(len(t)))


@pytest.mark.parametrize("table", [documents, real])
@pytest.mark.parametrize("order", [2, 3])
def test_language_model(spark, table, order):
    docs = table(spark)
    data = [(r.doc_id, WORD.findall(lowered(r.text)) + [None]) for r in docs.collect()]
    c = Counter(w for i, t in data if fold(i) != 1 for w in t)
    n, v = sum(c.values()), len(c)
    got = lm.score(docs, order).collect()
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr)
    assert have == sorted(((i, fold(i) == 1, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t in data), key=repr)
    plain = Plain(data, order)
    scores, want = sorted((r.doc_id, r.score) for r in got), sorted((i, plain.score(t)) for i, t in data)
    assert [i for i, _ in scores] == [i for i, _ in want] and [x for _, x in scores] == pytest.approx([x for _, x in want], rel=1e-6)
    held = [r for r in got if r.held_out]
    assert all(r.score < 0 for r in got) and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("order", [2, 3])
def test_probabilities_sum_to_one(order):
    """Over every known word and the one unknown, after seen and unseen histories."""
    model = Plain([(i, [*t.split(), None]) for i, t in enumerate(["a b a c a b", "b a", "c", "a b c", "b b a c"] * 6)], order)
    words = [*{g[0] for g in model.grams if len(g) == 1}, "unknown"]
    for h in ((0, 0), (0, "a"), ("b", "a"), ("c", "b"), ("unknown", "c"), ("a", "unknown")):
        assert abs(sum(model.p(h[3 - order :], w) for w in words) - 1) < 1e-6


def removed(docs, k, units):
    """docs: (id, units).  Which units a run of k that also starts in a smaller id covers."""
    least = {}
    for i, u in docs:
        for j in range(len(u) - k + 1):
            g = units(u[j : j + k])
            least[g] = min(least.get(g, math.inf), math.inf if i is None else i)
    for i, u in docs:
        gone = [False] * len(u)
        for j in range(len(u) - k + 1):
            if least[units(u[j : j + k])] < (math.inf if i is None else i):
                gone[j : j + k] = [True] * k
        yield i, u, gone


@pytest.mark.parametrize("table", [documents, real])
def test_substrings(spark, table):
    docs = table(spark)
    data = [(r.doc_id, WORD.findall(r.text or "")) for r in docs.collect()]
    want = [(i, len(u), sum(g), hashlib.sha256(" ".join(w for w, x in zip(u, g) if not x).encode()).hexdigest()) for i, u, g in removed(data, 50, tuple)]
    got = substring.deduplicate(docs)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 0
    texts = dict(data)
    for r in got.collect():
        for f in r.factors:
            assert f.reference < r.doc_id and texts[r.doc_id][f.word : f.word + f.n_words] == texts[f.reference][f.reference_word : f.reference_word + f.n_words]
    assert substring.deduplicate(docs.limit(0)).count() == 0


def test_factors_are_compared_with_their_references(spark, monkeypatch):
    """A hash that only knows the length of a word proposes wrong factors; none of them is believed."""
    monkeypatch.setattr(substring, "COMPARED", 2)
    docs = real(spark).limit(60).union(real(spark).limit(3).selectExpr("doc_id + 1000000", "concat('one more ', text)", *real(spark).columns[2:]))
    data = [(r.doc_id, WORD.findall(r.text or "")) for r in docs.collect()]
    want = [(i, sum(g)) for i, _, g in removed(data, 50, tuple)]
    lengths = lambda data, starts, ends: (ends - starts).astype("u8")
    assert rows(substring.deduplicate(docs, word_hash=lengths), "doc_id", "n_removed") == sorted(want, key=repr)
    short = spark.createDataFrame([(1, "ab " * 60), (2, "cd " * 60), (3, "x " + "cd " * 50)], "doc_id long, text string")
    assert rows(substring.deduplicate(short, word_hash=lengths), "doc_id", "n_removed") == [(1, 0), (2, 0), (3, 50)]
    store = substring.chunked(short)
    assert substring._differing(store, substring._parsed(store, 50, lengths)) > 0
    assert substring._differing(store, substring._parsed(store, 50, substring.plain_hash)) == 0


@pytest.mark.parametrize("table", [documents, real])
def test_suffixes(spark, table):
    docs = table(spark)
    data = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = []
    for i, u, g in removed(data, 50, bytes):
        runs = sum(x and not y for x, y in zip(g, [False, *g]))
        want.append((i, len(u), sum(g), runs, hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest()))
    got = suffix.deduplicate(docs)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 0
    assert suffix.deduplicate(docs.limit(0)).count() == 0


def test_difference_cover_order(spark, monkeypatch):
    """Ranks agree with sorting the suffixes themselves, as far as the window reaches."""
    import random

    from quillspan.llm.common import Chunk, chunked, stored

    r = random.Random(4)
    texts = ["".join(r.choices("ab", k=r.randrange(0, 160))) for _ in range(30)] + ["ab" * 70, "a" * 130, "a" * 131]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pieces = chunked(docs)
    back, rank_of = suffix.suffix_ranks(pieces, 4)

    def out(c: Chunk, got):
        import pyarrow as pa

        return pa.table({"chunk": [c.name], "rank": [rank_of(suffix.Suffixes(c), got).tolist()], "text": [c.data.tobytes()], "ends": [c.offsets.tolist()]})

    all_ = []
    for row in stored(suffix.each_answered(pieces, back, out, "chunk string, rank array<long>, text binary, ends array<long>")).collect():
        for a, b in zip(row.ends[:-1], row.ends[1:]):
            all_ += [(row.rank[i], bytes(row.text[i:b][:54]).ljust(54, b"\0")) for i in range(a, b)]
    all_.sort()
    assert [t for _, t in all_] == sorted(t for _, t in all_) and len({x for x, _ in all_}) > 1000


def edited(n, seed=5):
    """Texts that are one text with other edits in each, so that few segments of them are equal and most windows are."""
    import random

    r = random.Random(seed)
    base = "".join(r.choices("abcdefgh ", k=3000))
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(20):
            t[r.randrange(len(t))] = r.choice("XYZ")
        out.append("".join(t))
    return out


def plain_removed(data):
    return [(i, len(u), sum(g), hashlib.sha256(bytes(b for b, x in zip(u, g) if not x)).hexdigest()) for i, u, g in removed(data, 50, bytes)]


def test_exchanges_of_suffixes_are_bounded_by_the_text(spark, monkeypatch):
    """What a task of an exchange holds follows from what is brought to it: no exchange brings several times the text."""
    from pyspark.sql import functions as F

    texts = edited(120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    brought = []
    frame = type(df)
    plain = frame.repartitionById

    def spied(self, n, by):
        size = sum(F.length(c) for c, kind in self.dtypes if kind == "binary")
        brought.append(self.agg(F.sum(size)).first()[0])
        return plain(self, n, by)

    monkeypatch.setattr(frame, "repartitionById", spied)
    got = rows(suffix.deduplicate(df), "doc_id", "n_bytes", "n_removed", "kept_sha256")
    assert got == sorted(plain_removed([(i, t.encode()) for i, t in enumerate(texts)]), key=repr)
    assert brought and max(brought) < 3 * sum(map(len, texts))


def test_windows_in_order():
    """A bucket's windows are sorted by all their bytes, and only equal ones are held equal."""
    import numpy as np

    r = np.random.default_rng(0)
    for trial in range(60):
        window = (50, 51, 52, 20, 100)[trial % 5]
        data = r.integers(97, 98 + trial % 4, int(r.integers(window, 900))).astype(np.uint8)
        if len(data) > 200:
            data[100:180] = data[:80]
        at = np.flatnonzero(r.random(len(data) - window + 1) < 0.8)
        if len(at):
            order, new = suffix.sorted_windows(data, at, window)
            have = [data[a : a + window].tobytes() for a in at[order]]
            assert have == sorted(have) and new.tolist() == [True] + [x != y for x, y in zip(have[1:], have[:-1])]


@pytest.mark.parametrize("flag", [1, 2])
def test_hashes_only_choose_the_bucket(spark, monkeypatch, flag):
    """All grams have one hash, so all windows go to one bucket as if they had one minimizer: results are the same."""
    import numpy as np
    import pyarrow as pa

    from quillspan.llm.common import Chunk, chunked

    monkeypatch.setattr(suffix, "_grams", lambda head, tail: np.zeros(len(head), np.uint64))
    texts = [*edited(12), "x" * 200, "x" * 49, "", "x" * 51, edited(1)[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    chunks = [Chunk(pa.table({k: [r[k]] for k in ("chunk", "doc_ids", "folds", "offsets", "text")}).combine_chunks()) for r in chunked(df).collect()]
    sent = {c.name: suffix.Sent(c, 50, np.full(1, flag, np.uint8), 1) for c in chunks}
    told = suffix.decide(pa.Table.from_batches([sent[c.name].rows(c.name) for c in chunks if len(sent[c.name].texts)]), 50)
    got = []
    for c in chunks:
        gone = set(sent[c.name].gone(told.filter(pa.compute.equal(told["chunk"], c.name))).tolist())
        for i, a, b in zip(c.ids.to_pylist(), c.offsets[:-1].tolist(), c.offsets[1:].tolist()):
            got.append((i, sum(any(k in gone for k in range(max(a, j - 49), j + 1)) for j in range(a, b))))
    assert sorted(got) == sorted((i, n) for i, _, n, _ in plain_removed([(i, t.encode()) for i, t in enumerate(texts)]))


def test_very_common_minimizers(spark, monkeypatch):
    """Windows of minimizers with very many pieces are dealt one by one, by their own hash."""
    monkeypatch.setattr(suffix, "HOT", 2)
    monkeypatch.setattr(suffix, "CHUNK", 9000)
    monkeypatch.setattr(suffix, "BUCKET", 4000)
    data = list(enumerate([*edited(40), "ab" * 300, "q" + "ab" * 100, "a" * 500, "a" * 50]))
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    want = plain_removed([(i, t.encode()) for i, t in data])
    assert rows(suffix.deduplicate(df), "doc_id", "n_bytes", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_repeated_minimizers():
    """Lines of few letters make few pieces, and each window is in one piece."""
    import numpy as np

    class Text:
        pass

    for text in ("a" * 100_000, "abcde" * 20_000, "x" * 60 + "ab" * 3000 + "".join(edited(1))):
        c = Text()
        c.data, c.offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, 0, len(text) - 500, len(text) - 480, len(text)])
        p = suffix.Pieces(c, 50)
        at = np.concatenate([np.arange(i, i + n) for i, n in zip(p.start, p.size)])
        want = [i for a, b in zip(c.offsets[:-1], c.offsets[1:]) for i in range(a, b - 49)]
        assert at.tolist() == want and p.size.max() < suffix.MOST + 50 and len(p.start) < len(text) / 300 + 400
