"""The one pass over a text against the columns and windows that say the same.

Not right after a French date: there Java takes ı, İ, ſ and K for letters of ASCII, unlike the SQL and the one pass.
"""

import random

from quillspan.operators import context, rules, scan, tokens
from quillspan.plans.sources import LEXICON

PARTS = [
    "Élodie", "Jean-Marc", "LUCIE", "Rose", "rose", "Otto", "De", "de", "van", "d", "Vaubrun", "TERSANNE", "O", "Pierre", "Valbrune", "Saint-Orme", "Lancel", "sur", "les", "(Drome)", "(", ")", "M", "Mme", "Dr", "Madame", "monsieur", "PDF", "IBAN", "Nom", "nom de famille", "NOM", "ex-nom", "Responsable", "Name", "Prénom", "à l’attention de",
    "Né", "née", "Fait", "FAIT", "Ville", "Born in", "à", "À", "au", "en", "d'", "l’", ", le 1er", ", le 3 mai", "N°", "n°", "no.", "nº", "Matricule", " İne", " ıd", "Id", "dossier", "Réf.", "réf", "code", "Reſponsable :", "tic\u212aet", "Signataire :", "SİGNATAİRE : ", "vılle :", "AB12", "CLI 00", "x77", "K9-AX4", "AAAA1-2--B", "b2C", "12345", "1234567 €", "12.345", "12 345 678", "12 34 56,7", "20 eur", "٣٤٥",
    "12 rue du Port", "7 bis RUE DES LILAS, 75011 CHANVRAY SUR", "3, avenue des Bois, 69003 Orme Les", "FR76 3000 6000 0112 3456 7890 189", "fr7630006000011234567890189", "FR14 2004 1010 0505 0001 3M02 606", "1 84 12 76 451 089 46", "184127645108946", "2 55 08 14 168 025 38", "4970 1012 3456 7890", "4539578763621486", "4539-5787-6362-1486", "HTTPS://h.example/a?b=1).", "www.site.fr/é,", " ſ", " K",
    "jean.x@mail.example.fr", "Élx@a.b.co", "@", "06 12 34 56 78", "+33 6 12 34 56 78", "0033.7.12.34.56.78", "+44 20 7946 0958", "1/2/2019", "31-12-1999", "2021-02-30", "1er août 2021", "3 FÉVRIER 2020", "2 avrİl 2019", "5 ſeptembre 2001", "12 AOÛT 1999", "May 3rd, 2019", "march 4 2020", "10.0.0.7", "256.1.1.1", "1.2.3.4.5",
    "\n", "\n", " ", "  ", " ", "\t", " ", "\r\n", ".", "!", "…", ":", " : ", ",", "«", "•", "-", "–", "’", "_", "\x00", "\x00\n", "é", "😀", "日本",
]


def texts(seed: int, n: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    glue = ["", " ", " ", " ", " ", ", ", ". ", "\n"]
    return [(i, None if i % 97 == 5 else "".join(rng.choice(PARTS) + rng.choice(glue) for _ in range(rng.choice([0, 1, 3, 8, 40])))) for i in range(n)]


def read(df):
    return sorted(df.select("doc_id", "type", "start", "end", "value").collect())


def test_one_pass_agrees_with_windows(spark, monkeypatch):
    docs, words = spark.createDataFrame(texts(1, 1500), "doc_id long, text string").repartition(3), tokens.lexicon(spark, LEXICON)
    for strict in (False, True):
        got = read(context.detect(docs, words, strict))
        with monkeypatch.context() as m:
            m.setattr(scan, "LISTS", -1)
            want = read(context.detect(docs, words, strict))
        assert len(want) > 3000 and got == want


def test_each_detector_and_rule(spark):
    docs, words = spark.createDataFrame(texts(2, 800), "doc_id long, text string").repartition(2).cache(), tokens.lexicon(spark, LEXICON)
    t = context.context_tokens(docs, words).cache()
    plain = {"labelled": context.labelled_ids(docs), "dateline": context.datelines(docs), "long": context.long_numbers(docs), "grouped": context.grouped_numbers(docs), "mixed": context.mixed_codes(docs), "proper": context.proper_nouns(t, docs)}
    plain |= {n: context.by_words(t, docs, [n]) for n in ("civility", "first", "label", "formula", "place")}
    for n, want in plain.items():
        got = scan.detect(docs, words, [n], rules=[], merge=False)
        assert sorted(set(read(got))) == sorted(set(read(want))), n
    for r in rules.RULES:
        got, want = scan.detect(docs, words, [], rules=[r], merge=False), rules.candidates(docs, [r])
        assert read(got) == read(want), r.name


def test_plan_has_no_shuffle(spark):
    """Words were rows that windows, joins and groupings dealt by document."""
    docs = spark.createDataFrame(texts(3, 20), "doc_id long, text string")
    plan = context.detect(docs, tokens.lexicon(spark, LEXICON), True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_long_text_and_batches(spark, monkeypatch):
    """Texts of many batches' size, empty ones and one long one stand apart."""
    data = [(1, ""), (2, "Nom"), (3, ": Rose Vaubrun"), (4, "x " * 700_000 + "M. Otto Grandel"), (5, "12 34"), (6, "56 78 90"), (7, None), (8, "Fait à"), (9, "Valbrune")]
    got = context.detect(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), tokens.lexicon(spark, LEXICON), True)
    assert [(r.doc_id, r.type, r.value) for r in got.orderBy("doc_id").collect()] == [(3, "PERSONNE", "Rose Vaubrun"), (4, "PERSONNE", "Otto Grandel"), (9, "NOM_PROPRE", "Valbrune")]


def test_proper_nouns_without_windows(spark):
    docs, words = spark.createDataFrame(texts(4, 60), "doc_id long, text string"), tokens.lexicon(spark, LEXICON)
    got = context.proper_noun_spans(docs, words)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString() and got.count() > 50
