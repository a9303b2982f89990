"""Detectors that look at the words around: identifiers, people, places, proper nouns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspan.functions.text import SPACE

from .rules import _B
from .spans import spans
from .tokens import known, tokenize

# Word lists that decide what a word near a name means.
CIVILITIES = ["m", "mr", "mme", "mlle", "madame", "monsieur", "mademoiselle", "dr", "docteur", "me", "maitre", "pr", "professeur", "mrs", "ms", "miss", "mister", "sir"]
PARTICLES = ["de", "du", "des", "d", "le", "la", "van", "von", "der", "den", "di", "da", "del", "dos", "ben", "bin", "el", "al", "ibn"]
FUNCTION_WORDS = ["les", "des", "une", "aux", "par", "pour", "sur", "sous", "avec", "sans", "mais", "donc", "car", "est", "son", "sa", "ses", "mon", "ton", "nos", "vos", "leur", "the", "and", "for", "with", "from", "not", "but", "you", "all", "any", "can", "may", "will", "his", "her", "our"]
CONNECTORS = ["sur", "sous", "en", "les", "lès", "le", "la", "de", "du", "des", "d", "aux", "et", "on", "upon"]
PREPOSITIONS = ["a", "au", "aux", "en", "de", "d", "vers", "pres", "sur", "in", "at", "from", "near"]
ACRONYMS = [
    "pdf", "docx", "txt", "iban", "bic", "rib", "tva", "ttc", "ht", "siret", "siren", "ape", "naf", "rcs", "sas", "sasu", "sarl", "eurl", "sa", "sci", "scop",
    "cdi", "cdd", "rh", "drh", "pdg", "dg", "ceo", "cto", "cfo", "ia", "ai", "api", "url", "sms", "mms", "faq", "rgpd", "gdpr", "cnil", "ue", "eu", "usa",
    "uk", "ok", "nb", "ps", "cv", "pme", "tpe", "eti", "sncf", "ratp", "edf", "urssaf", "caf", "cpam", "mdph", "ars", "chu", "chr", "ehpad", "samu", "smic",
    "rsa", "apl", "bac", "bts", "dut", "but", "du", "dea", "dess", "licence", "master", "phd", "mba", "ine", "nir", "rdv", "tel", "fax", "cedex", "bp", "cs",
    "zi", "za", "zac", "hlm", "id", "n", "no", "num", "ref", "mr", "mme", "mlle", "dr", "pr", "st", "ste", "cie", "etc", "am", "pm", "utc", "gmt", "eur",
    "usd", "gbp", "chf",
]

# The grammars of labels, place formulas, datelines and numbers.
_BLANK = "[ \\t\\u00A0]"
NAME_LABEL = (
    "(?iu)(?<!\\p{L})(?:nom(?: de famille| d['’]usage| de naissance| marital| et pr[ée]noms?)?|pr[ée]noms?|signataire|sign[ée] par|destinataire|exp[ée]dit(?:eur|rice)|titulaire|[ée]l[èe]ve|[ée]tudiante?|patiente?|"
    "salari[ée]e?|b[ée]n[ée]ficiaire|assur[ée]e?|locataire|bailleu(?:r|resse)|propri[ée]taire|interlocut(?:eur|rice)|repr[ée]sentante?(?: l[ée]gale?)?|responsable|conseill[èe]re?|m[ée]decin(?: traitant)?|praticienn?e?|"
    f"conjointe?|p[èe]re|m[èe]re|tut(?:eur|rice)|[àa] l['’]attention de|full name|first name|last name|surname|name)[{SPACE}]*:{_BLANK}*"
)
PLACE_FORMULA = (
    "(?iu)(?<!\\p{L})(?:n[ée]e?|n[ée]\\(e\\)|fait|domicili[ée]e?|demeurant|r[ée]sidant|habitant|originaire|lieu de naissance|ville de naissance|ville|commune|localit[ée]|born|residing|living)"
    f"(?:{_BLANK}+le{_BLANK}+[^\\n]{{1,25}}?)?{_BLANK}*(?:(?:[àa]|au|aux|en|de|in|at)(?!\\p{{L}})|d['’]|:){_BLANK}*"
)
DATELINE = (
    "(?<=\\A|[\\n\\r\\u2028\\u2029])[ \\t]*(?:[àÀ][ \\t]+)?(\\p{Lu}[\\p{L}'’-]*(?:[ \\t]+(?:(?:sur|sous|en|les|le|la|de|du|des|aux)[ \\t]+)?\\p{Lu}[\\p{L}'’-]*){0,3}),[ \\t]+le[ \\t]+(?:\\d|1er|premier)"
)
PARENTHESIS = f"^{_BLANK}*\\([^()\\n]{{1,40}}\\)"
ID_LABEL = (
    f"(?iu)(?<![\\p{{L}}\\d])(?:n°|n[oº]\\.?(?=[{SPACE}]*[:\\d])|(?:id(?:entifiant)?s?|num(?:é|e)ros?|num\\.?|matricule|ine|r[ée]f(?:[ée]rence)?s?\\.?|dossier|contrat|client|adh[ée]rent|compte|passeport|permis|carte|badge|"
    "licence|siret|siren|tva|allocataire|s[ée]curit[ée] sociale|immatriculation|police|sinistre|facture|commande|ticket|code)(?!\\p{L}))"
)
_AFTER = f"(?![\\p{{L}}\\d]|[.,]\\d|[{SPACE}]?(?:€|%|eur{_B}|euros?{_B}))"
LONG_NUMBER = f"(?iu)(?<![\\p{{L}}\\d,.])\\d{{5,}}{_AFTER}"
GROUPED_NUMBER = f"(?iu)(?<![\\p{{L}}\\d,.])\\d{{2,4}}(?:[ .]\\d{{2,4}}){{2,512}}{_AFTER}"
# Possessive, so that no text can exhaust Java's stack; codes of fewer than five characters are left out afterwards.
MIXED_CODE = "(?<![\\p{L}\\d])(?=[A-Z0-9-]*\\d)(?=[A-Z0-9-]*[A-Z])[A-Z0-9]++(?![\\p{L}\\d])(?:-++[A-Z0-9]++(?![\\p{L}\\d]))*+"
# Priorities and the order of sources after the format rules; five words make a name or place at most.
PERSON, PLACE, LABELLED, STRICT, PROPER = 35, 33, 28, 15, 10
AFTER_RULES = {"labelled": 100, "person": 101, "person_label": 102, "place_formula": 103, "dateline": 104, "place": 105, "long": 106, "grouped": 107, "mixed": 108, "proper": 109}
REACH = 4


def _candidates(rows: DataFrame, kind: str, priority: int, source: str, docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """rows: id, start, end."""
    out = rows.select(id_col, F.col("start").cast("int"), F.col("end").cast("int")).join(docs.select(id_col, F.col(text).alias("_t")), id_col)
    value = F.substr("_t", F.col("start") + 1, F.col("end") - F.col("start"))
    return out.select(id_col, F.lit(kind).alias("type"), "start", "end", value.alias("value"), F.lit(priority).alias("priority"), F.lit(AFTER_RULES[source]).alias("source"))


# ---------------------------------------------------------------- identifiers


def read_code(rest: Column) -> Column:
    """Length of the code at the beginning of `rest`, -1 if there is none.

    Chunks are parted by single spaces; each holds a digit or is one to three capitals; capitals count only
    once a digit has been read; two digits at least.
    """
    chunk = "[A-Za-z0-9][A-Za-z0-9./_-]{0,63}"
    head = F.regexp_extract(rest, f"^{chunk}(?: {chunk})*", 0)
    begin = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("end"), F.lit(0).alias("digits"), F.lit(True).alias("go"))

    def step(a: Column, c: Column) -> Column:
        digits, short = F.regexp_count(c, F.lit("[0-9]")), c.rlike("^[A-Z]{1,3}\\z")
        ok = a["go"] & ((digits > 0) | short)
        at, total = a["at"] + F.length(c), a["digits"] + digits
        return F.when(ok, F.struct((at + 1).alias("at"), F.when((digits > 0) | (total > 0), at).otherwise(a["end"]).alias("end"), total.alias("digits"), F.lit(True).alias("go"))).otherwise(F.struct(a["at"].alias("at"), a["end"].alias("end"), a["digits"].alias("digits"), F.lit(False).alias("go")))

    got = F.aggregate(F.split(head, " "), begin, step)
    return F.when((head != "") & (got["digits"] >= 2), got["end"]).otherwise(-1)


def labelled_ids(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """What follows a label such as a number sign or "matricule", after a colon or right away."""
    hits = docs.select(id_col, F.col(text).alias("_t"), F.explode(spans(F.col(text), ID_LABEL)).alias("s"))
    rest = F.substr("_t", F.col("s.end") + 1, F.lit(80))
    colon, direct = F.regexp_extract(rest, f"^[^:\\n]{{0,40}}?:{_BLANK}*", 0), F.regexp_extract(rest, "^[ \\t\\u00A0°]*", 0)
    start = F.col("s.end") + F.length(F.when(colon != "", colon).otherwise(direct))
    rows = hits.withColumn("start", start).withColumn("n", read_code(F.substr("_t", F.col("start") + 1)))
    rows = rows.filter("n > 0").withColumn("end", F.col("start") + F.col("n")).select(id_col, "start", "end").distinct()
    return _candidates(rows, "IDENTIFIANT", LABELLED, "labelled", docs, id_col, text)


def _pattern(docs: DataFrame, pattern: str, source: str, id_col: str, text: str) -> DataFrame:
    rows = docs.select(id_col, F.explode(spans(F.col(text), pattern)).alias("s")).select(id_col, "s.*")
    return rows.select(id_col, F.lit("IDENTIFIANT").alias("type"), "start", "end", "value", F.lit(STRICT).alias("priority"), F.lit(AFTER_RULES[source]).alias("source"))


def long_numbers(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """C3"""
    return _pattern(docs, LONG_NUMBER, "long", id_col, text)


def grouped_numbers(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """C4: seven digits at least"""
    return _pattern(docs, GROUPED_NUMBER, "grouped", id_col, text).filter(F.length(F.regexp_replace("value", "[^0-9]", "")) >= 7)


def mixed_codes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Capitals and digits mixed, five characters at least"""
    return _pattern(docs, MIXED_CODE, "mixed", id_col, text).filter(F.length(F.replace("value", F.lit("-"))) >= 5)


# ---------------------------------------------------------------- words around a word


def context_tokens(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, all: the tokens of each document in order, with list flags and name_like."""
    t = known(tokenize(docs, id_col, text), words, id_col)
    t = t.withColumn("acronym", F.col("key").isin(ACRONYMS)).withColumn("particle", F.col("key").isin(PARTICLES) & ~F.col("capitalized"))
    named = ~F.col("common") | ((F.col("is_surname") | F.col("is_first")) & (F.col("all_caps") | ~F.col("sentence_start")))
    t = t.withColumn("name_like", F.col("capitalized") & (F.length("key") >= 2) & ~F.col("acronym") & named)
    fields = ("pos", "key", "start", "end", "gap", "blank_gap", "capitalized", "all_caps", "sentence_start", "name_like", "particle", "acronym", "common", "is_first", "is_place")
    return t.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all"))



def around(tokens: DataFrame, centres: dict[str, Callable[[Column, Column], Column]], id_col: str = "doc_id", *more: str) -> DataFrame:
    """The tokens at which any of the conditions holds: id, the token's fields, a flag for each condition, and the words
    ahead and behind.

    A condition sees the token and the one before it (null for the first).  Only the neighbourhoods of these tokens are
    ever built, as slices of the document's array.
    """

    def place(x: Column, i: Column) -> Column:
        before = F.get("all", i - 1)
        flags = [F.coalesce(c(x, before), F.lit(False)).alias(n) for n, c in centres.items()]
        return F.struct(i.alias("i"), *flags)

    hits = F.filter(F.transform("all", place), lambda h: reduce(or_, (h[n] for n in centres)))

    def build(h: Column) -> Column:
        i = h["i"]
        # the name after a form of address begins one word on, and a particle looks one word further
        ahead, behind = F.slice("all", i + 2, F.lit(REACH + 2)), F.reverse(F.slice("all", F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH))))
        return F.struct(F.get("all", i).alias("own"), ahead.alias("ahead"), behind.alias("behind"), *(h[n].alias(n) for n in centres))

    rows = tokens.select(id_col, *more, F.explode(F.transform(hits, build)).alias("h"))
    return rows.select(id_col, *more, "h.own.*", "h.ahead", "h.behind", *(F.col(f"h.{n}") for n in centres))


def _next(i: int = 0) -> Column:
    return F.get("ahead", F.lit(i))


def extend(ahead: Column, first: int = 0) -> Column:
    """How many words on a name reaches, from the word before ahead[first]."""

    def step(a: Column, j: Column) -> Column:
        t, n = F.get(ahead, j - 1 + first), F.get(ahead, j + first)
        joined = a["go"] & t.isNotNull() & t["blank_gap"]
        passes = t["particle"] & F.coalesce(n["blank_gap"] & n["name_like"], F.lit(False))
        word = ~t["particle"] & (t["name_like"] | ((a["last"] == j - 1) & t["capitalized"] & ~t["sentence_start"]))
        return F.struct(F.when(joined & word, j).otherwise(a["last"]).alias("last"), F.coalesce(joined & (passes | word), F.lit(False)).alias("go"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(REACH)), F.struct(F.lit(0).alias("last"), F.lit(True).alias("go")), step)["last"]


def extend_back(behind: Column, gap_here: Column) -> Column:
    """C11: how many name-like words before belong to the name."""

    def step(a: Column, j: Column) -> Column:
        t = F.get(behind, j - 1)
        gap = F.when(j == 1, gap_here).otherwise(F.get(behind, j - 2)["blank_gap"])
        ok = F.coalesce(a["go"] & gap & t["name_like"] & ~t["key"].isin(CIVILITIES), F.lit(False))
        return F.struct(F.when(ok, j).otherwise(a["last"]).alias("last"), ok.alias("go"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(REACH)), F.struct(F.lit(0).alias("last"), F.lit(True).alias("go")), step)["last"]


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def _civility(x: Column, before: Column) -> Column:
    return x["capitalized"] & x["key"].isin(CIVILITIES)


def _civility_span() -> Column:
    n = _next()
    named = n["gap"].rlike(f"^\\.?{_BLANK}+\\z") & n["capitalized"] & (F.length(n["key"]) >= 2)
    return F.when(named, _span(n["start"], F.get("ahead", extend(F.col("ahead"), 1))["end"]))


def _first_name(x: Column, before: Column) -> Column:
    return x["capitalized"] & x["is_first"] & (F.length(x["key"]) >= 3) & ~x["key"].isin(CIVILITIES + PARTICLES + FUNCTION_WORDS) & ~x["acronym"]


def _first_name_span() -> Column:
    n = _next()
    followed = F.coalesce(n["blank_gap"] & n["name_like"], F.lit(False))
    doubtful = F.col("common") & F.col("sentence_start") & ~F.col("all_caps") & ~followed
    on, back = extend(F.col("ahead")), extend_back(F.col("behind"), F.col("blank_gap"))
    start, end = F.when(back > 0, F.get("behind", back - 1)["start"]).otherwise(F.col("start")), F.when(on > 0, F.get("ahead", on - 1)["end"]).otherwise(F.col("end"))
    return F.when(~doubtful, _span(start, end))


def _after(array: str) -> Callable[[Column, Column], Column]:
    """The capitalized token that starts right where one of the document's labels ends."""
    return lambda x, before: x["capitalized"] & F.array_contains(F.col(array), x["start"])


def _chain(step: Callable[[Column, Column, Column], tuple[Column, Column]]) -> Column:
    """How many words on something reaches; step gives for a word, the next and its number: may it end here, does it go on."""

    def walk(a: Column, j: Column) -> Column:
        t, n = F.get("ahead", j - 1), F.get("ahead", j)
        joined = F.coalesce(a["go"] & t["blank_gap"], F.lit(False))
        ends, goes = step(t, n, j)
        return F.struct(F.when(joined & ends, j).otherwise(a["last"]).alias("last"), F.coalesce(joined & goes, F.lit(False)).alias("go"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(REACH)), F.struct(F.lit(0).alias("last"), F.lit(True).alias("go")), walk)["last"]


def _label_span() -> Column:
    on = _chain(lambda t, n, j: (t["capitalized"], t["capitalized"] | t["key"].isin(PARTICLES)))
    return _span(F.col("start"), F.when(on > 0, F.get("ahead", on - 1)["end"]).otherwise(F.col("end")))


def _place_span() -> Column:
    """Capitalized words and connectors (what stands in a bracket behind is added later)."""
    link = lambda t, n: ~t["capitalized"] & t["key"].isin(CONNECTORS) & F.coalesce(n["capitalized"] & n["blank_gap"], F.lit(False))
    on = _chain(lambda t, n, j: (t["capitalized"], t["capitalized"] | link(t, n)))
    return _span(F.col("start"), F.when(on > 0, F.get("ahead", on - 1)["end"]).otherwise(F.col("end")))


def _known_place(x: Column, before: Column) -> Column:
    after = ~before["capitalized"] & before["key"].isin(PREPOSITIONS) & (~x["common"] | ~before["key"].isin("de", "d")) & x["gap"].rlike("^[ \\t\\u00A0'’]+\\z")
    clear = ~x["common"] & (~x["sentence_start"] | x["all_caps"])
    return x["capitalized"] & x["is_place"] & (F.coalesce(after, F.lit(False)) | clear)


#: By detector: the words that it starts from, the span there, type, priority, source.
_DETECTORS = {
    "civility": (_civility, _civility_span, "PERSONNE", PERSON, "person"),
    "first": (_first_name, _first_name_span, "PERSONNE", PERSON, "person"),
    "label": (_after("label_ends"), _label_span, "PERSONNE", PERSON, "person_label"),
    "formula": (_after("formula_ends"), _place_span, "LIEU", PLACE, "place_formula"),
    "place": (_known_place, _place_span, "LIEU", PLACE, "place"),
}
_ENDS = {"label": ("label_ends", NAME_LABEL), "formula": ("formula_ends", PLACE_FORMULA)}


def by_words(tokens: DataFrame, docs: DataFrame, names: Sequence[str] = tuple(_DETECTORS), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Candidates of some of the detectors: one pass over the words of each document, and one look at its text for
    labels, brackets and values."""
    ends = {column: pattern for n, (column, pattern) in _ENDS.items() if n in names}
    t = tokens
    if ends:
        marks = docs.select(id_col, *(F.transform(spans(F.col(text), p), lambda s: s["end"]).alias(c) for c, p in ends.items()))
        t = tokens.join(marks, id_col)
    rows = around(t, {n: _DETECTORS[n][0] for n in names}, id_col, *ends)
    each = [F.when(F.col(n), F.struct(F.lit(kind).alias("type"), span()["start"].alias("start"), span()["end"].alias("end"), F.lit(priority).alias("priority"), F.lit(AFTER_RULES[source]).alias("source"))) for n in names for _, span, kind, priority, source in [_DETECTORS[n]]]
    found = rows.select(id_col, F.explode(F.array_compact(F.array(*each))).alias("c")).select(id_col, "c.*").filter("start is not null").distinct()
    found = found.join(docs.select(id_col, F.col(text).alias("_t")), id_col)
    bracket = F.when(F.col("type") == "LIEU", F.length(F.regexp_extract(F.substr("_t", F.col("end") + 1, F.lit(48)), PARENTHESIS, 0))).otherwise(0)
    found = found.withColumn("end", F.col("end") + bracket)
    value = F.substr("_t", F.col("start") + 1, F.col("end") - F.col("start"))
    return found.select(id_col, "type", "start", "end", value.alias("value"), "priority", "source")


def civility_people(tokens: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The name after a form of address, which stays visible itself."""
    return by_words(tokens, docs, ["civility"], id_col, text)


def first_name_people(tokens: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A known first name and the name-like words around it."""
    return by_words(tokens, docs, ["first"], id_col, text)


def labelled_people(tokens: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Whatever name stands after a label such as "Nom :"."""
    return by_words(tokens, docs, ["label"], id_col, text)


def formula_places(tokens: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """C12"""
    return by_words(tokens, docs, ["formula"], id_col, text)


def known_places(tokens: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """C14"""
    return by_words(tokens, docs, ["place"], id_col, text)


def datelines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The place at the head of a letter; the span is the name alone."""
    hits = docs.select(id_col, F.explode(spans(F.col(text), DATELINE)).alias("s"))
    name = F.regexp_extract(F.col("s.value"), DATELINE, 1)
    start = F.col("s.start") + F.instr(F.col("s.value"), name) - 1
    return _candidates(hits.select(id_col, start.alias("start"), (start + F.length(name)).alias("end")), "LIEU", PLACE, "dateline", docs, id_col, text)


def proper_nouns(tokens: DataFrame, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of capitalized words that are neither ordinary words nor acronyms."""
    hit = lambda x: x["capitalized"] & (F.length(x["key"]) >= 2) & ~x["acronym"] & ~x["common"]
    rows = around(tokens, {"hit": lambda x, before: hit(x)}, id_col)
    before = F.get("behind", F.lit(0))
    new = F.when(F.col("blank_gap") & F.coalesce(hit(before), F.lit(False)), 0).otherwise(1)
    t = rows.select(id_col, "pos", "start", "end", new.alias("new")).withColumn("run", F.sum("new").over(W.partitionBy(id_col).orderBy("pos")))
    return _candidates(t.groupBy(id_col, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")), "NOM_PROPRE", PROPER, "proper", docs, id_col, text)


def proper_noun_spans(docs: DataFrame, words: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """C16 from texts: id, type, start, end, value, in one pass over each text where the word lists fit a task."""
    from . import scan

    if scan.fits(words):
        return scan.detect(docs, words, ["proper"], rules=[], merge=False, id_col=id_col, text=text)
    return proper_nouns(context_tokens(docs, words, id_col, text), docs, id_col, text).select(id_col, "type", "start", "end", "value")


def detect(docs: DataFrame, words: DataFrame | None = None, strict: bool = False, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All detectors; without word lists the format rules alone, resolved greedily.

    One pass over each text by itself; with word lists that are too long for every task, windows and joins instead.
    """
    from . import resolve, rules, scan

    if words is not None and scan.fits(words):
        found = scan.detect(docs, words, list(scan.DETECTORS) if strict else scan.BALANCED, id_col=id_col, text=text)
        return found.withColumn("id", resolve.span_id(F.col("type"), F.col("start"), F.col("end")))
    found = rules.candidates(docs, id_col=id_col, text=text)
    if words is None:
        return resolve.greedy(found, id_col)
    t = context_tokens(docs, words, id_col, text)
    more = [labelled_ids(docs, id_col, text)]
    more += [by_words(t, docs, id_col=id_col, text=text), datelines(docs, id_col, text)]
    if strict:
        more += [f(docs, id_col, text) for f in (long_numbers, grouped_numbers, mixed_codes)] + [proper_nouns(t, docs, id_col, text)]
    for m in more:
        found = found.unionByName(m)
    return resolve.merge(found, docs, id_col, text)
