"""Toxicity and nearest neighbours."""

import numpy as np

from quillspan.llm import ann, toxicity

from .fixtures import documents, rows

DIR = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    print(held.groupby("toxic").predicted.mean(), len(held))
    assert (held.predicted == held.toxic).mean() > 0.95
    assert got[got.toxic == 0].predicted.mean() < 0.02


def test_toxicity_cases(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, toxic int, quality int")
    got = toxicity.toxicity(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0
    assert set(toxicity.toxicity(docs, labels.limit(0)).toPandas().predicted) == {0}


def test_label_model():
    """Without labels of its own, the model tells good voters from bad ones and counts one that repeats another once."""
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    good, fair, bad = vote(0.9), vote(0.8), vote(0.55)
    v = np.column_stack([good, fair, bad, bad, bad]).astype(np.int8)
    noisy = np.where(rng.random(4000) < 0.75, y, ~y).astype(float)
    model = toxicity.label_model(v, noisy)
    assert {int(x) for x in model.parent[2:]} < {2, 3, 4}
    # the copies change the posteriors of no text
    once = toxicity.label_model(v[:, :3], noisy)
    assert np.abs(model.posterior(v) - once.posterior(v[:, :3])).max() < 0.01
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.88


def brute(rows_, every=50, k=5):
    v = {i: np.array(e, float) for i, e in rows_}
    out = {}
    ids = sorted(v)
    m = np.stack([v[i] for i in ids])
    n = np.sqrt((m * m).sum(1))
    for q in ids:
        if q % every == 0:
            s = (m * v[q]).sum(1) / (n * np.sqrt((v[q] * v[q]).sum()))
            out[q] = [(ids[j], s[j]) for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    data += [(1000 + i, [1.0] * 8) for i in range(60)] + [(2000, None), (2001, []), (2050, [0.0] * 8), (2100, [1.0] * 7 + [None]), (2150, [float("nan")] * 8), (None, [1.0] * 8), (50, data[50][1])]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in data], "vec_id long, embedding array<float>, label int, key string")
    got = ann.neighbours(df, share=1.0)
    clean = {r.vec_id: r.embedding for r in df.collect() if r.vec_id is not None and r.embedding and r.vec_id not in (2050, 2100, 2150)}
    want = brute(clean.items())
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: [i for i, _ in x] for q, x in found.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(found[q], want[q]))
    assert ann.neighbours(df.limit(0)).count() == 0
    assert rows(ann.neighbours(df.filter("vec_id in (0, 1, 2)")), "query_id", "rank") == [(0, 1), (0, 2)]


def test_many_ties(spark):
    """Scaled copies of a vector tie exactly; the smaller ids are its neighbours, however many there are."""
    rng = np.random.default_rng(4)
    base = rng.integers(-8, 9, 8)
    data = [(int(i), (base * 2.0**j).tolist()) for j, i in enumerate(rng.permutation(80))]
    data += [(100 + i, rng.integers(-8, 9, 8).astype(float).tolist()) for i in range(100)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = {}
    for r in ann.neighbours(df, share=1.0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {q: [i for i, _ in x] for q, x in brute(data).items()}


def test_lengths(spark):
    """Vectors of each length are searched among themselves."""
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=3 if i % 2 else 5).tolist()) for i in range(205)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    want = {q: x for n in (3, 5) for q, x in brute([d for d in data if len(d[1]) == n]).items()}
    found = {}
    for r in ann.neighbours(df, share=1.0).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {q: [i for i, _ in x] for q, x in want.items()}


def test_recall_of_clusters(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24)) * 3
    data = [(i, (centres[i % 40] + rng.normal(size=24)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    want, got = brute(data), {}
    for r in ann.neighbours(df, share=0.05, least=200).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()])
    got = {}
    for r in ann.neighbours(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9
