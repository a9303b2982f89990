"""Redaction of threads of messages, at once or as they come in.

Labels are numbered for each thread and type by first appearance, in the order of `seq` and then of the place in the
message, so a value keeps its label through all messages of its thread.  A table is redacted by windows over the spans of
a thread.  A stream keeps, for each thread, the values met so far in keyed state; a message that comes after the trigger of
a later one of its thread gets the labels that are known by then.  Everything before the numbering is the same for both and
keeps nothing: rules, islands of overlapping candidates, and keys of values.

A task holds the messages that one trigger brings for one thread, so the rate of the source (files or bytes a trigger)
bounds it.  The state of a thread grows with its distinct values, and no thread is ever forgotten, as its next message
must find its labels: with very many threads choose the state store that keeps its rows on disk.

Defined results: a null text stays null and has no labels; a null thread is a thread of its own; a null seq comes first;
rows of equal seq are numbered in the order of their texts and equal rows stay apart; an empty table gives no rows; other
columns do not go through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspan.functions.text import label_key
from quillspan.operators import scan
from quillspan.operators.rules import RULES, Rule, rule_spans
from quillspan.sources import scratch

_MERGED = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_STATE = "types array<string>, keys array<string>"


def islands(found: list[dict]) -> list[dict]:
    """R2 within one text: overlapping candidates as one span, with the type of the strongest."""
    out, best = [], None
    for c in sorted(found, key=lambda c: (c["start"], -c["end"], c["source"], c["priority"])):
        rank = (c["end"] - c["start"], c["priority"], -c["start"], -c["source"])
        if not out or c["start"] >= out[-1]["end"]:
            out.append({"type": c["type"], "start": c["start"], "end": c["end"]})
            best = rank
        else:
            out[-1]["end"] = max(out[-1]["end"], c["end"])
            if rank > best:
                out[-1]["type"], best = c["type"], rank
    return out


def found_spans(messages: DataFrame, rules: list[Rule] = RULES, thread: str = "thread", seq: str = "seq", text: str = "text") -> DataFrame:
    """thread, seq, text, spans (type, start, end, key): one pass over the messages, a stream or a table."""
    if scan.known(rules):
        return scan.rule_spans(messages.select(F.col(thread).alias("thread"), F.col(seq).alias("seq"), F.col(text).cast("string").alias("text")), rules, "text")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [islands(c or []) for c in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(spans, _MERGED)], ["thread", "seq", "text", "spans"])

    found = F.concat(*(rule_spans(F.col("text"), r, i) for i, r in enumerate(rules)))
    rows = messages.select(F.col(thread).alias("thread"), F.col(seq).alias("seq"), F.col(text).cast("string").alias("text"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"thread {kind['thread']}, seq {kind['seq']}, text string, spans array<struct<type:string,start:int,end:int>>"
    merged = rows.withColumn("found", found).mapInArrow(merge, schema)
    key = lambda s: label_key(s["type"], F.substr("text", s["start"] + 1, s["end"] - s["start"])).alias("key")
    return merged.withColumn("spans", F.transform("spans", lambda s: F.struct(s["type"].alias("type"), s["start"].alias("start"), s["end"].alias("end"), key(s))))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with `row`, a number of their own, and `tie`, the order by text of those with one thread and seq."""
    tie = F.row_number().over(W.partitionBy("thread", "seq").orderBy("text"))
    return rows.withColumn("tie", tie).withColumn("row", F.monotonically_increasing_id())


def _whole(rows: DataFrame) -> DataFrame:
    """A table: numbers by windows over the distinct values of a thread; what is joined and grouped has no texts."""
    uses = rows.select("thread", "row", "seq", "tie", F.explode("spans").alias("s")).select("thread", "row", "seq", "tie", "s.*")
    first = uses.groupBy("thread", "type", "key").agg(F.min(F.struct("seq", "tie", "start")).alias("at"))
    number = F.row_number().over(W.partitionBy("thread", "type").orderBy("at"))
    names = first.select("thread", "type", "key", F.format_string("[%s_%d]", "type", number).alias("label"))
    # the labels of one message's values come to it by key, so that no thread's names are gathered
    same = uses["thread"].eqNullSafe(names["thread"]) & (uses["type"] == names["type"]) & (uses["key"] == names["key"])
    placed = uses.join(names, same).select("row", "start", "end", "label")
    plan = placed.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("plan"))
    both = rows.select("thread", "row", "seq", "text").join(plan, "row", "left")
    text, plan_ = F.col("text"), F.coalesce("plan", F.array().cast("array<struct<start:int,end:int,label:string>>"))
    before = lambda i: F.when(i == 0, 0).otherwise(F.element_at("plan", i)["end"])
    parts = F.transform(plan_, lambda r, i: F.concat(F.substr(text, before(i) + 1, r["start"] - before(i)), r["label"]))
    last = F.coalesce(F.get("plan", F.size("plan") - 1)["end"], F.lit(0))
    redacted = F.when(text.isNotNull(), F.concat(F.array_join(parts, ""), F.substr(text, last + 1)))
    return both.select("thread", "seq", redacted.alias("redacted"), F.transform(plan_, lambda r: r["label"]).alias("labels"))


def _stream(rows: DataFrame) -> DataFrame:
    """A stream: the values met so far are the state of their thread."""
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def number(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        types, keys = (list(x) for x in state.get) if state.exists else ([], [])
        known, count = {}, {}
        for t, k in zip(types, keys):
            count[t] = count.get(t, 0) + 1
            known[t, k] = f"[{t}_{count[t]}]"
        rows = [r for chunk in chunks for r in zip(chunk["seq"].tolist(), chunk["text"].tolist(), chunk["spans"].tolist())]
        rows.sort(key=lambda r: (not pd.isna(r[0]), 0 if pd.isna(r[0]) else r[0], r[1] or ""))
        out = []
        for seq, text, spans in rows:
            parts, labels, at = [], [], 0
            for s in spans if text is not None else []:
                value = s["type"], s["key"]
                if value not in known:
                    count[s["type"]] = count.get(s["type"], 0) + 1
                    known[value] = f"[{s['type']}_{count[s['type']]}]"
                    types.append(s["type"])
                    keys.append(s["key"])
                parts += [text[at : s["start"]], known[value]]
                labels.append(known[value])
                at = s["end"]
            out.append((key[0], None if pd.isna(seq) else seq, None if text is None else "".join(parts) + text[at:], labels))
        state.update((types, keys))
        # one frame of objects: there are as many frames as threads
        yield pd.DataFrame(out, columns=["thread", "seq", "redacted", "labels"], dtype=object)

    schema = f"thread {kind['thread']}, seq {kind['seq']}, redacted string, labels array<string>"
    return rows.groupBy("thread").applyInPandasWithState(number, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def redact_threads(messages: DataFrame, rules: list[Rule] = RULES, thread: str = "thread", seq: str = "seq", text: str = "text") -> DataFrame:
    """thread, seq, redacted, labels of each message."""
    rows = found_spans(messages, rules, thread, seq, text)
    # a table's spans are read three times (values, uses, texts): the rules run once, into a table of their own
    return _stream(rows) if messages.isStreaming else _whole(scratch.written(_numbered(rows)))


def redact_stream(messages: DataFrame, path: str, checkpoint: str, **options) -> None:  # noqa: ANN003
    """Everything that is there now, appended to Parquet at `path`; the checkpoint carries the state to the next call."""
    out = redact_threads(messages, **options)
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
