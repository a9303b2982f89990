"""A small table with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pandas as pd
from pyspark.sql import types as T

DATA = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("bucket", T.StringType())])


def texts(seed=3):
    r = random.Random(seed)
    vocab = [a + b for a in ("Th", "on", "er", "é", "ß", "q") for b in ("at", "in", "", "ue", "日本", "x")]
    base = [" ".join(r.choices(vocab, k=n)) for n in (3, 5, 12, 13, 49, 50, 51, 80, 120, 200, 400, 2000)]
    out = list(base)
    for t in base[4:]:
        w = t.split(" ")
        out.append(t)
        out.append(" ".join(w[: len(w) // 2] + r.choices(vocab, k=9) + w[len(w) // 2 :]))
        out.append(" ".join(r.choices(vocab, k=20) + w[5:70] + r.choices(vocab, k=15)))
        w = list(w)
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w).upper() if r.random() < 0.3 else "\t\n".join(w))
    passage = " ".join(r.choices(vocab, k=60))
    out += [f"{' '.join(r.choices(vocab, k=r.randrange(0, 40)))} {passage} {' '.join(r.choices(vocab, k=r.randrange(0, 40)))}" for _ in range(12)]
    out += ["", "   ", "a", "a " * 130, "a " * 131, "ab" * 70, "x" * 49, "x" * 50, "x" * 51, "é" * 25, "é" * 26, "\x00\x0b \x0cword", "İstanbul ſ K ÀÉ", None]
    r.shuffle(out)
    return out


def documents(spark):
    rows = [(i * 3 + 1, t, "en", f"s{i % 4}" if i % 9 else None, 1, "x", 2, "c", "b") for i, t in enumerate(texts())]
    rows.append(rows[5])
    rows.append(rows[6])
    return spark.createDataFrame(rows, DOCS)


def pandas(df):
    return df.toPandas()


def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def rows(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


__all__ = ["documents", "pandas", "real", "rows", "texts", "pd"]
