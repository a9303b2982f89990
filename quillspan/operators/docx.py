"""Word documents: text of the parts, tracked changes, redaction that keeps formatting, metadata."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.text import SPACE, decode_xml, encode_xml
from quillspan.operators.intervals import overlapping

# The parts that are shown, in reading order; the pieces of a part that make text; the properties that name people.
PARTS = ["document", "header[0-9]*", "footer[0-9]*", "footnotes", "endnotes", "comments"]
TOKEN = f"<w:t([{SPACE}][^>]*)?>([^<]*)</w:t>|<w:t([{SPACE}][^>]*)?/>|<w:tab/>|<w:(?:br|cr)([{SPACE}][^>]*)?/>|</w:p>"
CORE = "<(dc:creator|cp:lastModifiedBy|dc:title|dc:subject|dc:description|cp:keywords)([ \\t\\r\\n][^>]*)?>(?s:.*?)</\\1>"
APP = "<(Company|Manager)>(?s:.*?)</\\1>"


def unzip(packages: DataFrame, doc_id: str = "doc_id", content: str = "content") -> DataFrame:
    """doc_id, name, xml of every XML part, or error where the package cannot be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, data in zip(b["doc_id"], b["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        out += [(key, n, z.read(n).decode("utf-8", "replace"), None) for n in z.namelist() if n.endswith(".xml")]
                except (zipfile.BadZipFile, RuntimeError, TypeError) as problem:
                    out.append((key, None, None, "password" if "password" in str(problem) else "damaged"))
            yield pd.DataFrame(out, columns=["doc_id", "name", "xml", "error"])

    return packages.select(F.col(doc_id).alias("doc_id"), F.col(content).alias("content")).mapInPandas(run, "doc_id long, name string, xml string, error string")


def zip_parts(parts: DataFrame) -> DataFrame:
    """doc_id, content: one package of all (name, xml) of a document, stored.

    Parts stream by in the order of documents and names, so that a package costs no group of its own."""

    def package(own: list[tuple[str, str]]) -> bytes:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_STORED) as z:
            for name, xml in own:
                z.writestr(zipfile.ZipInfo(name), xml)
        return data.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda out: pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([c for _, c in out], pa.binary())], ["doc_id", "content"])
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out, size = [], 0
        for key, own in groupby(rows, lambda r: r[0]):
            out.append((key, package([(name, xml) for _, name, xml in own])))
            size += len(out[-1][1])
            if size > 1 << 22 or len(out) == 10_000:
                yield table(out)
                out, size = [], 0
        yield table(out)

    rows = parts.select(F.col("doc_id").cast("long"), "name", "xml").repartition("doc_id").sortWithinPartitions("doc_id", "name", "xml")
    return rows.mapInArrow(run, "doc_id long, content binary")


def accept_changes(xml: Column) -> Column:
    """Without what was deleted or moved away; insertions are plain content."""
    x = F.regexp_replace(xml, "<w:(?:del|ins|moveFrom|moveTo)(?![A-Za-z0-9_])[^>]*/>", "")
    x = F.regexp_replace(x, "(?s)<w:del(?![A-Za-z0-9_])[^>]*>.*?</w:del>", "")
    x = F.regexp_replace(x, "(?s)<w:moveFrom(?![A-Za-z0-9_])[^>]*>.*?</w:moveFrom>", "")
    return F.regexp_replace(x, "</?w:(?:ins|moveTo)(?![A-Za-z0-9_])[^>]*>", "")


def clear_authors(xml: Column) -> Column:
    """W6"""
    return F.regexp_replace(xml, '(?<![A-Za-z0-9_])(w[0-9]*:author|w:initials)="[^"]*"', '$1=""')


def clear_core(xml: Column) -> Column:
    """Titles and people in docProps/core.xml"""
    return F.regexp_replace(xml, CORE, "<$1$2></$1>")


def clear_app(xml: Column) -> Column:
    return F.regexp_replace(xml, APP, "<$1></$1>")


def _pieces(xml: DataFrame, keys: list[str]) -> DataFrame:
    """A part cut into its tokens and what stands before each: keys, pos, token (null: the end of the part), gap."""
    pairs = F.arrays_zip(F.regexp_extract_all("xml", F.lit(TOKEN), F.lit(0)).alias("token"), F.split("xml", TOKEN, -1).alias("gap"))
    return xml.select(*keys, F.posexplode(pairs).alias("pos", "m")).select(*keys, "pos", "m.token", "m.gap")


def tokens(xml: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, pos, token, piece (its text), is_node, open_tag."""
    rows = _pieces(xml, keys).filter("token is not null")
    node = F.col("token").endswith("</w:t>")
    tag = F.regexp_extract("token", "^<w:t[^>]*>", 0)
    text = F.when(node, decode_xml(F.regexp_extract("token", ">([^<]*)<", 1))).when(F.col("token") == "<w:tab/>", "\t").when(F.col("token").startswith("<w:t"), "").otherwise("\n")
    return rows.select(*keys, "pos", "token", text.alias("piece"), node.alias("is_node"), F.when(node, tag).alias("open_tag"))


def _shown(files: DataFrame) -> DataFrame:
    """The parts that are shown, without tracked changes, in reading order by part_class and name."""
    rank = F.coalesce(*(F.when(F.col("name").rlike(f"^word/{p}\\.xml\\z"), i) for i, p in enumerate(PARTS)))
    return files.withColumn("part_class", rank).filter("part_class is not null").withColumn("xml", accept_changes(F.col("xml")))


def parts(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files doc_id, name, xml.  Gives the tokens of all shown parts with `start` in the document's text, and
    doc_id, text."""
    shown = _shown(files)
    t = tokens(shown, ["doc_id", "part_class", "name"])
    body = shown.select("doc_id", "part_class", "name").join(t.groupBy("doc_id", "part_class", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("body")), ["doc_id", "part_class", "name"], "left")
    body = body.withColumn("body", F.coalesce("body", F.lit("")))
    body = body.withColumn("body", F.when(F.col("body").endswith("\n") | (F.col("body") == ""), F.col("body")).otherwise(F.concat("body", F.lit("\n"))))
    before = F.coalesce(F.sum(F.length("body")).over(W.partitionBy("doc_id").orderBy("part_class", "name").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    body = body.withColumn("before", before)
    text = body.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part_class", "name", "body"))), lambda x: x["body"]), "").alias("text"))
    inside = F.coalesce(F.sum(F.length("piece")).over(W.partitionBy("doc_id", "part_class", "name").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = t.withColumn("_in", inside).join(body.select("doc_id", "name", "before"), ["doc_id", "name"])
    return placed.withColumn("start", (F.col("before") + F.col("_in")).cast("int")).drop("_in", "before"), text


def redact(files: DataFrame, plan: DataFrame) -> DataFrame:
    """doc_id, name, xml with each replacement's label where its value starts and the rest of the value gone.

    plan: doc_id, start, end, label over the text that parts() gives; its spans do not overlap.  Text nodes meet the
    plan by position; a label goes to the first node that has a character of its span.  A node that is touched is
    written anew, all else stays, and a part is its pieces in order, so the work grows with the length of the parts.
    """
    t, _ = parts(files)
    keys = ["doc_id", "name", "pos"]
    nodes = t.filter("is_node").select("doc_id", "name", "pos", "part_class", "open_tag", "piece", "start", (F.col("start") + F.length("piece")).alias("end"))
    p = plan.select("doc_id", F.col("start").alias("r0"), F.col("end").alias("r1"), "label")
    hit = overlapping(nodes, p, "doc_id", "start", "end", "r0", "r1")
    # of the nodes of one span: those with a character of it first, in reading order
    by_span = W.partitionBy("doc_id", "r0").orderBy(F.col("piece") == "", "part_class", "name", "pos")
    a, b = F.greatest(F.col("r0") - F.col("start"), F.lit(0)), F.least(F.col("r1") - F.col("start"), F.length("piece"))
    hit = hit.withColumn("_label", F.when((F.row_number().over(by_span) == 1) & (F.col("piece") != ""), F.col("label")).otherwise("")).withColumns({"a": a, "b": b})
    kept = F.substr("piece", F.coalesce(F.lag("b").over(W.partitionBy(*keys).orderBy("a")), F.lit(0)) + 1, F.col("a") - F.coalesce(F.lag("b").over(W.partitionBy(*keys).orderBy("a")), F.lit(0)))
    cuts = hit.withColumn("_part", F.concat(kept, "_label")).groupBy(*keys, "open_tag", "piece").agg(F.array_sort(F.collect_list(F.struct("a", "_part"))).alias("c"), F.max("b").alias("last"))
    text = F.concat(F.array_join(F.transform("c", lambda x: x["_part"]), ""), F.substr("piece", F.col("last") + 1))
    tag = F.when(F.instr("open_tag", "xml:space=") > 0, F.col("open_tag")).otherwise(F.regexp_replace("open_tag", "^<w:t", '<w:t xml:space="preserve"'))
    new = cuts.select(*keys, F.concat(tag, encode_xml(text), F.lit("</w:t>")).alias("put"))
    pieces = _pieces(_shown(files), ["doc_id", "name"]).join(new, keys, "left").select(*keys, F.concat("gap", F.coalesce("put", "token", F.lit(""))).alias("out"))
    whole = pieces.groupBy("doc_id", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), "").alias("_new"))
    out = files.join(whole, ["doc_id", "name"], "left").withColumn("_y", F.coalesce("_new", "xml"))
    final = F.when(F.col("name").rlike("^word/.*\\.xml\\z"), clear_authors(F.col("_y"))).when(F.col("name") == "docProps/core.xml", clear_core(F.col("_y"))).when(F.col("name") == "docProps/app.xml", clear_app(F.col("_y"))).otherwise(F.col("_y"))
    return out.select("doc_id", "name", final.alias("xml"))
