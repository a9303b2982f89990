"""Span primitives against Python's own regular expressions and definitions."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.operators import context, redact, resolve, rules, tokens
from quillspan.operators.spans import span_rows, spans
from quillspan.plans.sources import LEXICON


def random_texts(n=60, seed=1):
    r = random.Random(seed)
    bits = ["a", "É", "l'", "-", " ", ". ", "\n", "x@y.fr", "12", "!", "«", "Jean", "ß", "😀", " ", "(", "MAJ"]
    return ["".join(r.choices(bits, k=r.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(random_texts())), "doc_id long, text string").cache()


@pytest.mark.parametrize("pattern", ["[a-z]+", "\\p{L}+", "[0-9]{2}", "-[^-]"])
def test_spans(texts, pattern):
    want = {i: [(m.start(), m.end(), m[0]) for m in regex.finditer(pattern, t)] for i, t in enumerate(random_texts())}
    got = {r.doc_id: [tuple(s) for s in r.s] for r in texts.select("doc_id", spans(F.col("text"), pattern).alias("s")).collect()}
    assert got == want
    rows = {}
    for r in span_rows(texts, pattern).orderBy("doc_id", "pos").collect():
        rows.setdefault(r.doc_id, []).append((r.start, r.end, r.value))
    assert rows == {k: v for k, v in want.items() if v}


def sentence_start(text, at):
    for c in reversed(text[:at]):
        if c in "\n.!?…":
            return True
        if not (c.isspace() or c in "﻿\"«»“”'([•*·–—-"):
            return False
    return True


def test_sentence_start(texts):
    got = tokens.tokenize(texts).collect()
    all_ = random_texts()
    assert len(got) > 200
    for r in got:
        assert r.sentence_start == sentence_start(all_[r.doc_id], r.start), (all_[r.doc_id], r)


def greedy(cands):
    kept = []
    for c in sorted(cands, key=lambda c: (c[0] - c[1], -c[2], c[0], c[3])):
        if all(c[0] >= k[1] or k[0] >= c[1] for k in kept):
            kept.append(c)
    return sorted((c[0], c[1]) for c in kept)


def test_greedy_resolution(spark):
    r = random.Random(7)
    data = [(d, "T", s, s + r.randrange(1, 9), "v", r.choice([10, 20, 30]), i) for d in range(80) for i in range(r.randrange(9)) for s in [r.randrange(25)]]
    got = {}
    for x in resolve.greedy(spark.createDataFrame(data, "doc_id long, type string, start int, end int, value string, priority int, source int")).collect():
        got.setdefault(x.doc_id, []).append((x.start, x.end))
    for d in {x[0] for x in data}:
        assert sorted(got[d]) == greedy([(x[2], x[3], x[5], x[6]) for x in data if x[0] == d])


def test_labels_and_redaction(spark):
    docs = spark.createDataFrame([(1, "A@x.fr, a@x.fr, 06 12 34 56 78 et 0612345678 puis b@x.fr"), (2, "rien à masquer"), (3, "")], "doc_id long, text string")
    found = rules.candidates(docs, [rules.BY_NAME["email"], rules.BY_NAME["phone"]])
    out = {r.doc_id: r.redacted for r in redact.apply(docs, redact.plan(found)).collect()}
    assert out == {1: "[EMAIL_1], [EMAIL_1], [TELEPHONE_1] et [TELEPHONE_1] puis [EMAIL_2]", 2: "rien à masquer", 3: ""}


def test_check_digits(spark):
    df = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32", True), ("GB82 WEST 1234 5698 7654 33", False), ("DE89370400440532013000", True), ("x", False)], "v string, ok boolean")
    assert all(r.ok == r.got for r in df.withColumn("got", X.is_valid_iban(F.col("v"))).collect())
    cards = spark.createDataFrame([("4539 1488 0343 6467", True), ("4539 1488 0343 6468", False), ("12", False)], "v string, ok boolean")
    assert all(r.ok == r.got for r in cards.withColumn("got", X.is_valid_card(F.col("v"))).collect())


def test_code_reader(spark):
    cases = {"1710026022 C suite": 12, "CLI 00457,": 9, "CLI 7.2.": 8, "AB": -1, "A1": -1, "x12": 3, "12  34": 2, "": -1, "K9 ABC 77 abcd": 9}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, n int")
    assert {r.t: r.got for r in df.withColumn("got", context.read_code(F.col("t"))).collect()} == cases


ANNOTATED = ["Madame ⟦Lucie Grandel⟧ habite vers ⟦Valbrune⟧.", "Nom : ⟦Vaubrun⟧ ; dossier n° ⟦AB-2231⟧", "Né à ⟦Port Lancel⟧ le ⟦3 mai 1990⟧, tel ⟦06 12 34 56 78⟧", "Bonjour, votre facture est reglee."]


def test_no_secret_is_left(spark):
    plain = [t.replace("⟦", "").replace("⟧", "") for t in ANNOTATED]
    docs = spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string")
    found = context.detect(docs, tokens.lexicon(spark, LEXICON), strict=True)
    out = {r.doc_id: r.redacted for r in redact.apply(docs, redact.plan(found)).collect()}
    for i, t in enumerate(ANNOTATED):
        for secret in regex.findall("⟦(.*?)⟧", t):
            assert secret not in out[i], (secret, out[i])


@pytest.mark.parametrize("name", list(rules.BY_NAME))
def test_long_inputs_do_not_exhaust_the_stack(spark, name):
    bad = ["x@" + "a." * 100_000, "a-" * 100_000, "12 rue X, 75001 " + "Paris " * 40_000, "12 " * 70_000, "FR76" + " 1234" * 40_000, "www." + "a" * 200_000, "1.1." * 50_000, "12 RUE X 75001 " + "PARIS " * 30_000]
    df = spark.createDataFrame(list(enumerate(bad)), "doc_id long, text string")
    rules.candidates(df, [rules.BY_NAME[name]]).count()


def test_cities_of_any_length(spark):
    """All capitalised words that follow a postcode belong to the place."""
    data = [("address_full", "12 rue Xy, 75001 " + "Paris " * 3000 + "et", 3000 * 6 - 1), ("address_full_caps", "12 RUE XY 75001 " + "PARIS " * 3000 + "et", 3000 * 6 - 1), ("address_full", "12 rue Xy, 75001 Le Bourg-Neuf, ici", 13)]
    for name, text, city in data:
        found = rules.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string"), [rules.BY_NAME[name]]).collect()
        assert [(r.start, r.end) for r in found] == [(0, text.index("75001 ") + 6 + city)]


def greedy_lines(text, width):
    lines, now = [], ""
    for piece in regex.findall("[^ ]+| +", text):
        if piece[0] == " ":
            now += " " if now else ""
            continue
        for part in [piece[i : i + width] for i in range(0, len(piece), width)]:
            if now and len(now) + len(part) > width:
                lines.append(now.rstrip(" "))
                now = ""
            now += part
    return lines + ([now.rstrip(" ")] if now.strip(" ") else [])


def test_line_breaking(spark):
    from quillspan.operators import typeset

    r = random.Random(3)
    data = ["".join(r.choices(["a", "bb", " ", "  ", "longerword"], k=r.randrange(30))) for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, t string")
    got = {x.doc_id: x.l for x in df.select("doc_id", typeset.break_lines(F.col("t"), F.lit(8)).alias("l")).collect()}
    assert got == {i: greedy_lines(t, 8) for i, t in enumerate(data)}


def test_masks_of_a_document(spark):
    """Masks one after the other, each taking in all that it overlaps, in any order."""
    rng = random.Random(5)
    found, masks, want = [], [], []
    text = "".join(chr(97 + i % 26) for i in range(60))
    for d in range(60):
        cuts = sorted(rng.sample(range(60), 8))
        spans = [("X", a, b) for a, b in zip(cuts[::2], cuts[1::2])]
        found += [(d, k, a, b, text[a:b]) for k, a, b in spans]
        for _ in range(rng.randrange(4)):
            a, b = rng.randrange(60), rng.randrange(60)
            masks.append((d, a, b))
            lo, hi = min(a, b), max(a, b)
            if lo == hi:
                continue
            hit = [s for s in spans if s[1] < hi and lo < s[2]]
            spans = [s for s in spans if s not in hit] + [("MASQUE", min([lo, *(s[1] for s in hit)]), max([hi, *(s[2] for s in hit)]))]
        want += [(d, k, a, b, text[a:b]) for k, a, b in spans]
    docs = spark.createDataFrame([(d, text) for d in range(60)], "doc_id long, text string")
    made = resolve.add_manual(spark.createDataFrame(found, "doc_id long, type string, start int, end int, value string"), spark.createDataFrame(masks, "doc_id long, from int, to int"), docs)
    assert sorted(tuple(r) for r in made.select("doc_id", "type", "start", "end", "value").collect()) == sorted(want)


def test_mixed_codes(spark):
    """The same codes as the plain pattern finds, and a text of any length."""
    plain = regex.compile(r"(?<![\p{L}0-9])(?=[A-Z0-9-]*[0-9])(?=[A-Z0-9-]*[A-Z])[A-Z0-9](?:-*[A-Z0-9]){4,}(?![\p{L}0-9])")
    rng = random.Random(6)
    data = ["".join(rng.choice("AAB12--éx _") for _ in range(40)) for _ in range(2000)] + ["A1" * 20_000 + "-" * 200 + "B"]
    got = context.mixed_codes(spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")).select("doc_id", "start", "end").collect()
    assert sorted(map(tuple, got)) == sorted((i, *m.span()) for i, t in enumerate(data) for m in plain.finditer(t))


def test_items_at_one_place(spark):
    """They keep their order, whatever their text."""
    from quillspan.operators import layout

    rows = [(1, 0, i, s, 0.0, 0.0, 5.0, 10.0, False, False) for i, s in enumerate(["b", "a", "c"])]
    made = layout.lines(spark.createDataFrame(rows, "doc_id long, page int, item int, str string, x double, y double, width double, size double, bold boolean, italic boolean"))
    assert made.select(layout.text_of(made.runs)).first()[0] == "bac"
