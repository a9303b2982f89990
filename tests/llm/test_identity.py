"""Rows keep their identity however their files are split, and words that simple hashes confuse stay apart."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspan.llm import decontaminate, jaccard, lm, substring, suffix, token_store, warc
from quillspan.llm.common import numbered, stored
from quillspan.llm.queries import tokenizer_path

from .fixtures import DATA, documents, real, rows


@pytest.fixture
def split(spark, tmp_path):
    """documents as eight files, and a way to change how they are split."""
    path = f"file://{tmp_path}/documents"
    real(spark).repartition(8).write.parquet(path)

    def finer(fine: bool) -> None:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k" if fine else "128m")
        spark.conf.set("spark.sql.files.openCostInBytes", "1" if fine else "4m")

    yield spark.read.parquet(path), finer
    for key in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{key}")


def test_numbers_do_not_follow_the_splits(spark, split):
    docs, finer = split
    finer(False)
    first = dict(rows(numbered(docs, "row"), "doc_id", "row"))
    finer(True)
    assert docs.rdd.getNumPartitions() > 3 and dict(rows(numbered(docs, "row"), "doc_id", "row")) == first
    assert len(set(first.values())) == len(first) == 200
    made = numbered(spark.range(50).withColumn("x", F.lit(1)), "row")
    assert len({r.row for r in made.collect()}) == 50 and made.columns == ["id", "x", "row"]


def test_decisions_reach_their_rows_after_other_splits(spark, split):
    docs, finer = split
    finer(False)
    plans = [stage(spark, docs, DATA) for _, stage in corpus_pipeline.STAGES[1:4]]
    want = [rows(p, "doc_id") for p in plans]
    finer(True)
    assert [rows(stage(spark, docs, DATA), "doc_id") for _, stage in corpus_pipeline.STAGES[1:4]] == want
    # planned under one split, read under the other
    finer(False)
    kept = corpus_pipeline.keep_one_of_each(spark, docs, DATA)
    finer(True)
    assert rows(kept, "doc_id") == want[0]


def test_archives_after_other_splits(spark, tmp_path, split):
    _, finer = split
    pages = spark.createDataFrame([(i, "u", f"<p>{i % 20}</p>" * 50) for i in range(400)], "page_id long, url string, html string")
    pages.repartition(8).write.parquet(f"file://{tmp_path}/pages")
    pages = spark.read.parquet(f"file://{tmp_path}/pages")
    want = [(i, "response" if i >= 380 else "revisit", None if i >= 380 else 380 + i % 20) for i in range(400)]
    for fine in (False, True):
        finer(fine)
        assert rows(warc.archive(pages), "page_id", "record_type", "refers_to") == sorted(want, key=repr)


def test_pipeline_with_null_ids(spark):
    docs = documents(spark)
    docs = docs.unionByName(docs.limit(20).withColumn("doc_id", F.lit(None).cast("long")))
    n = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, before = stored(stage(spark, docs, DATA)), docs
        assert docs.columns == before.columns and 0 < docs.count() <= 3 * n
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()


def thue_morse(n):
    """Two words of n letters that agree in every sum of powers modulo 2^64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_complementary_words_stay_apart(spark, n):
    a, b = thue_morse(n)
    schema = "doc_id long, text string"
    same = " ".join(f"w{i}" for i in range(49))
    pair = spark.createDataFrame([(1, f"{same} {a}"), (2, f"{same} {b}")], schema).coalesce(1)
    assert [r.n_removed for r in substring.deduplicate(pair).collect()] == [0, 0]
    two = spark.createDataFrame([(1, a), (2, b)], schema).coalesce(1)
    assert rows(jaccard.join(two), "doc_id", "component_id") == [(1, 1), (2, 2)]
    found = decontaminate.contamination(two, spark.createDataFrame([(7, a)], "item_id long, text string"))
    assert rows(found, "doc_id", "n_hit") == [(1, 1), (2, 0)]
    got = {r.doc_id: r.ids_crc32 for r in token_store.token_file_table(two, tokenizer_path()).collect()}
    each = {i: token_store.token_file_table(spark.createDataFrame([(i, t)], schema), tokenizer_path()).head().ids_crc32 for i, t in ((1, a), (2, b))}
    assert got == each and got[1] != got[2]
    known = spark.createDataFrame([(i, t) for i, t in ((0, a), (2, a), (3, a))] + [(9, b)], schema)
    scored = {r.doc_id: r.n_known for r in lm.score(known).collect()}
    held = {r.doc_id: r.held_out for r in lm.score(known).collect()}
    assert all(scored[i] == 2 for i in scored if not held[i])


def test_complementary_segments_stay_apart(spark):
    a, b = thue_morse(4096)
    data = [(1, a), (2, b), (3, "x" + a[:300] + "y"), (4, b[1000:1400])]
    df = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    seen, want = set(), []
    for i, t in data:
        hit = [t[j : j + 50] in seen for j in range(max(0, len(t) - 49))]
        want.append((i, sum(any(hit[max(0, j - 49) : j + 1]) for j in range(len(t)))))
        seen |= {t[j : j + 50] for j in range(max(0, len(t) - 49))}
    assert rows(suffix.deduplicate(df), "doc_id", "n_removed") == want
