"""Threads of messages as a table, as a stream in parts, and by a plain version."""

import random
import tempfile

from quillspan.sources import scratch
from quillspan.operators.rules import BY_NAME
from quillspan.streaming import threads

RULES = [BY_NAME[n] for n in ("email", "ip", "date_iso", "url")]
SCHEMA = "conv string, turn long, body string, text int"


def plain(rows: list[tuple]) -> list[tuple]:
    """Values of the made messages are known words, so a message is redacted word by word."""
    names: dict = {}
    out = []
    for conv, turn, body, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2] or "")):
        words, labels = [], []
        for w in body.split(" ") if body is not None else []:
            kind = "EMAIL" if "@" in w else "IP" if w.startswith("10.") else "DATE" if w.startswith("20") else None
            if kind:
                seen = names.setdefault((conv, kind), [])
                if w.lower() not in seen:
                    seen.append(w.lower())
                labels.append(f"[{kind}_{seen.index(w.lower()) + 1}]")
                w = labels[-1]
            words.append(w)
        out.append((conv, turn, None if body is None else " ".join(words), labels))
    return sorted(out, key=repr)


def messages(seed: int, n: int = 300) -> list[tuple]:
    rng = random.Random(seed)
    word = lambda: rng.choice(["mot", "é\U0001f600", f"a{rng.randrange(5)}@x.fr", f"A{rng.randrange(5)}@X.fr", f"10.0.0.{rng.randrange(4)}", f"2020-01-0{rng.randrange(1, 6)}", ""])
    rows = [(rng.choice(["a", "a", "b", None, ""]), i // 2 if i > 3 else None, " ".join(word() for _ in range(rng.randrange(9))), 7) for i in range(n)]
    rows += [("b", 20, None, 7), ("a", 21, "same a1@x.fr", 7), ("a", 21, "same a1@x.fr", 7), ("long", 1, "mot " * 30000 + "z@x.fr", 7)]
    return rows


def read(df) -> list[tuple]:  # noqa: ANN001
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_table(spark):
    rows = messages(1)
    got = read(threads.redact_threads(spark.createDataFrame(rows, SCHEMA), RULES, "conv", "turn", "body"))
    assert got == plain(rows)
    assert read(threads.redact_threads(spark.createDataFrame([], SCHEMA), RULES, "conv", "turn", "body")) == []


def test_stream_in_parts(spark):
    """Three parts and a restart between them give what the whole table gives."""
    rows = messages(2)
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for low, high in ((-1, 40), (40, 90), (90, 1000)):
        part = [r for r in rows if low <= (-1 if r[1] is None else r[1]) < high]
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(f"{base}/in")
        threads.redact_stream(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), f"{base}/out", f"{base}/state", rules=RULES, thread="conv", seq="turn", text="body")
    got = read(spark.read.parquet(f"{base}/out"))
    assert got == plain(rows)


def test_islands_take_the_strongest_type():
    c = lambda s, e, t, p, n=0: {"start": s, "end": e, "type": t, "priority": p, "source": n}
    got = threads.islands([c(5, 9, "IP", 20), c(0, 6, "URL", 50), c(8, 12, "DATE", 30), c(12, 13, "IP", 20), c(0, 6, "EMAIL", 45, 1)])
    assert [(x["type"], x["start"], x["end"]) for x in got] == [("URL", 0, 12), ("IP", 12, 13)]
    assert threads.islands([]) == []


def test_rules_run_outside_the_jvm_and_joins_have_no_texts(spark):
    """The rules of the package were columns, and texts were keys of windows, groupings and joins; results stay those of the columns."""
    rows = [(c, t % 3, f"a{t % 4}@x.fr, 10.0.0.{t % 5} et www.s{c}.fr/É le 2020-01-0{t % 9 + 1}") for c in (1, 2, None) for t in range(12)] + [(1, None, "a1@x.fr"), (1, 0, None), (1, 0, "a9@x.fr")]
    messages = spark.createDataFrame(rows, "thread long, seq long, text string")
    found = threads.found_spans(messages)
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()
    other = [r._replace(priority=r.priority) for r in threads.RULES]  # equal rules that only have their columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, threads.found_spans(messages, other).collect()))
    plan = threads._whole(scratch.written(threads._numbered(found)))._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if ("Aggregate" in line or "Window" in line) and "text#" in line]
    got, want = (sorted(map(repr, threads.redact_threads(messages, r).collect())) for r in (threads.RULES, other))
    assert got == want and len(got) == len(rows)
