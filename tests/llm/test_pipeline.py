"""Every stage on its own input against a plain version of its rule."""

from collections import Counter

import corpus_pipeline as p
from quillspan.llm import mixing, token_store, toxicity
from quillspan.llm.common import read, stored
from quillspan.llm.queries import tokenizer_path

from .fixtures import DATA, documents, rows
from .test_jaccard import brute
from .test_stores import plain_hits

DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = read(spark, DATA, "documents")
    columns = docs.columns
    now = docs
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    out = stored(p.STAGES[0][1](spark, now, DATA))
    assert out.columns == columns
    model = toxicity.fit(now, read(spark, DATA, "labels"))
    assert ids(out) == sorted(r.doc_id for r in toxicity.score(now, model).collect() if r.score < 0.5)
    now, out = out, stored(p.STAGES[1][1](spark, out, DATA))
    assert out.columns == columns and ids(out) == sorted({c for _, _, c in brute([(r.doc_id, r.text) for r in now.collect()])})
    now, out = out, stored(p.STAGES[2][1](spark, out, DATA))
    bench = [(r.item_id, r.text) for r in read(spark, DATA, "benchmark").collect()]
    assert out.columns == columns and ids(out) == sorted(r[0] for r in plain_hits([(r.doc_id, r.text) for r in now.collect()], bench) if not r[5])
    now, out = out, stored(p.STAGES[3][1](spark, out, DATA))
    want = Counter({r.doc_id: r.copies for r in mixing.mix_sources(now).collect() if r.copies})
    assert out.columns == columns and Counter(ids(out)) == want
    got = p.STAGES[4][1](spark, out, DATA)
    assert rows(got, "doc_id", "start", "n_tokens", "ids_crc32") == rows(token_store.token_file_table(out, tokenizer_path()), "doc_id", "start", "n_tokens", "ids_crc32")
    assert ids(got) == sorted(want.elements())


def test_awkward_rows_pass(spark):
    docs = documents(spark)
    n = docs.count()
    for _, stage in p.STAGES[:-1]:
        out = stored(stage(spark, docs, DATA))
        assert out.columns == docs.columns and 0 < out.count() <= 3 * n
        docs = out
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert p.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
