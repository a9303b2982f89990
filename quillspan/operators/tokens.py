"""Words of a text with the flags that the context detectors need."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.text import SPACE, all_caps, capitalized, normalize_key

from .spans import span_rows

# Letter runs joined by hyphens; possessive, so that no text can exhaust Java's stack.
WORD = "\\p{L}(?:\\p{L}|-(?=\\p{L}))*+"
_SKIP = f"[{SPACE}\"«»“”'(\\[•*·–—-]"
BLANKS = "^[ \\t\\u00A0]+\\z"


def tokenize(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, pos, word, key, start, end, capitalized, all_caps, sentence_start, gap, blank_gap."""
    rows = span_rows(docs, WORD, id_col, text)
    first = F.col("pos") == 0
    start = F.col("gap").rlike(f"[\\n.!?…]{_SKIP}*\\z") | (first & F.col("gap").rlike(f"^{_SKIP}*\\z"))
    word = F.col("value")
    return rows.select(id_col, "pos", word.alias("word"), normalize_key(word).alias("key"), "start", "end", capitalized(word).alias("capitalized"), all_caps(word).alias("all_caps"), start.alias("sentence_start"), "gap", (F.col("gap").rlike(BLANKS) & ~first).alias("blank_gap"))


def lexicon(spark: SparkSession, lists: dict[str, list[str]]) -> DataFrame:
    """Kind, key from inline lists; kinds are firstNames, surnames, places, territories, words."""
    pairs = [(k, w) for k, ws in lists.items() for w in ws]
    # from an Arrow table, so that the optimizer knows its size
    rows = spark.createDataFrame(pa.table({"kind": pa.array([k for k, _ in pairs], pa.string()), "word": pa.array([w for _, w in pairs], pa.string())}))
    return rows.select("kind", normalize_key(F.col("word")).alias("key")).distinct()


def parse_lexicon(lines: DataFrame) -> DataFrame:
    """Kind, line from files; empty lines and line ends go, the files of a kind are one set."""
    return lines.select("kind", F.regexp_replace("line", "\\r\\z", "").alias("key")).filter("key != ''").distinct()


def known(tokens: DataFrame, lexicon: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds is_first, is_surname, is_place (places and territories), common.

    A word with hyphens is common, too, if all of its parts are.  A word asks for its key and, if it has any, for its
    parts in one join; whether the list is sent to all tasks or joined by key is up to its size as the optimizer knows it.
    """
    is_kind = lambda *k: F.max(F.col("kind").isin(*k))
    entries = lexicon.groupBy(F.col("key").alias("asked")).agg(is_kind("firstNames").alias("is_first"), is_kind("surnames").alias("is_surname"), is_kind("places", "territories").alias("is_place"), is_kind("words").alias("in_words"))
    asks = F.when(F.instr("key", "-") > 0, F.concat(F.array("key"), F.split("key", "-"))).otherwise(F.array("key"))
    rows = tokens.select("*", F.posexplode(asks).alias("_no", "asked")).join(entries, "asked", "left")
    part = (F.length("asked") < 2) | F.coalesce("in_words", F.lit(False))
    compound = F.bool_and(F.when(F.col("_no") > 0, part)).over(W.partitionBy(id_col, "pos"))
    out = rows.withColumn("compound", compound).filter("_no = 0")
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("is_first", "is_surname", "is_place")}
    return out.withColumns(flags).withColumn("common", F.coalesce("in_words", F.lit(False)) | F.coalesce("compound", F.lit(False))).drop("in_words", "compound", "asked", "_no")
