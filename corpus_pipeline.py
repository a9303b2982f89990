"""From raw documents to token files, in five stages.

Each stage reads what its predecessor kept, written as Parquet, and its decisions take effect: toxic
documents go, one document of each group of near-duplicates stays, contaminated documents go, the sources
are mixed to their target weights (a document's rate becomes whole copies), and what is left becomes token
files.  The stages only pass on the columns of documents, whatever further columns there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import decontaminate, jaccard, mixing, token_store, toxicity
from quillspan.llm.common import dropped, numbered, read, stored
from quillspan.llm.queries import tokenizer_path


def _tagged(docs: DataFrame) -> DataFrame:
    """Documents with a number for each row, so that rows that repeat an id stay apart; the same at each reading."""
    return numbered(docs, "_quillspan_row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), name="_quillspan_score")
    return scored.filter("_quillspan_score < 0.5").select(*map(_name, docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near-duplicates; documents without words are no one's copy."""
    rows = _tagged(docs)
    joined = jaccard.join(rows.select("_quillspan_row", "text"), doc_id="_quillspan_row", links=False)
    order = rows.select("_quillspan_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_quillspan_row").alias("_quillspan_order"))
    first = joined.withColumnRenamed("doc_id", "_quillspan_row").join(order, "_quillspan_row").groupBy("component_id").agg(F.min("_quillspan_order").alias("first"))
    keep = first.select(F.col("first._quillspan_row").alias("_quillspan_row"))
    return rows.join(keep, "_quillspan_row", "left_semi").select(*map(_name, docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves."""
    rows = _tagged(docs)
    found = decontaminate.contamination(rows, read(spark, sf_dir, "benchmark"), keep=("_quillspan_row",))
    bad = found.filter("contaminated").select("_quillspan_row")
    return rows.join(bad, "_quillspan_row", "left_anti").select(*map(_name, docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    rows = _tagged(docs)
    copies = mixing.mix_sources(rows, keep=("_quillspan_row",)).select("_quillspan_row", F.col("copies").alias("_quillspan_copies"))
    out = rows.join(copies, "_quillspan_row").withColumn("_quillspan_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_quillspan_copies"), F.lit(1)).cast("int"))))
    return out.filter("_quillspan_copies > 0").select(*map(_name, docs.columns))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the token files."""
    return token_store.token_file_table(docs, tokenizer_path())


def _name(column: str):  # noqa: ANN202
    return F.col(f"`{column}`")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
    ("token files", token_files),
]

#: SQL can express neither the classifier nor the tokenizer; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, before = stored(stage(spark, docs, sf_dir)), docs
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
