"""Greedy choice of spans against a plain version."""

import random

import pytest

from quillspan.operators import resolve

SCHEMA = "doc_id int, type string, start int, end int, value string, priority int, source int"


def plain(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (r[0], r[2] - r[3], -r[5], r[2], r[6], r[3], r[1], r[4])):
        if not any(k[0] == r[0] and r[2] < k[3] and k[2] < r[3] for k in kept):
            kept.append(r)
    return sorted((r[0], r[1], r[2], r[3], r[4], f"{r[1]}-{r[2]}-{r[3]}") for r in kept)


@pytest.mark.parametrize("seed", range(3))
def test_greedy(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(900):
        s = r.randrange(0, 120)
        rows.append((r.randrange(6), r.choice("AB"), s, s + r.choice([0, 1, 2, 3, 3, 8, 30]), r.choice("xy"), r.choice([10, 20]), r.randrange(3)))
    got = resolve.greedy(spark.createDataFrame(rows, SCHEMA))
    assert sorted((x.doc_id, x.type, x.start, x.end, x.value, x.id) for x in got.collect()) == plain(rows)


def test_one_island_of_many_spans(spark):
    n = 100_000
    rows = spark.range(n).selectExpr("1 as doc_id", "'A' as type", "cast(id * 2 as int) as start", "cast(id * 2 + 3 + id % 2 as int) as end", "'v' as value", "1 as priority", "0 as source")
    got = resolve.greedy(rows)
    # each odd one is longer than both neighbours
    assert got.count() == n // 2 and got.filter("start % 4 = 0").count() == 0
