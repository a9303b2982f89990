"""Texts that the detection queries run on, derived from the given tables by SQL that both engines read alike."""

from __future__ import annotations


def pick(number: str, items: list[str]) -> str:
    """SQL that picks an item by a number."""
    quoted = [i.replace("'", "''") for i in items]
    return f"CASE {number} % {len(items)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(quoted)) + " END"


def digits(number: str, n: int) -> str:
    return f"lpad(CAST({number} AS STRING), {n}, '0')"


FIRST = ["Élodie", "Jean-Marc", "LUCIE", "Karim", "Rose", "Otto", "Maëlle", "De"]
LAST = ["Vaubrun", "Grandel", "TERSANNE", "de Montrel", "Pierre", "Quinault", "O", "van der Meulen"]
CITY = ["Valbrune", "Saint-Orme", "CHANVRAY", "Port Lancel", "Orme"]
WORDS = ["bonjour", "merci", "client", "rose", "pierre", "orme", "commande", "dossier", "le", "la", "de", "un", "une", "pour", "avec", "votre", "rendez", "vous", "lettre", "port", "saint", "fait", "habite", "hello", "dear", "invoice", "madame", "monsieur", "rue", "avenue", "place", "total", "paye", "nom", "ville", "reference", "code", "ticket", "tel", "et", "depuis", "ne", "vers", "responsable"]
LEXICON = {"firstNames": ["Élodie", "Jean-Marc", "Lucie", "Karim", "Rose", "Otto", "Maëlle", "De"], "surnames": ["Vaubrun", "Grandel", "Tersanne", "Montrel", "Pierre", "Quinault", "Meulen"], "places": ["Valbrune", "Saint-Orme", "Chanvray", "Lancel", "Orme"], "territories": ["Drome"], "words": WORDS}

_K = "c_custkey"
_BBAN = f"('2004101005' || {digits(f'{_K} * 7919', 13)})"
_CHECK = f"(98 - CAST(CAST({_BBAN} || '152700' AS DECIMAL(38, 0)) % 97 AS INT))"
_NIR = f"(CAST({_K} % 2 + 1 AS STRING) || {digits(f'{_K} % 100', 2)} || {digits(f'{_K} % 12 + 1', 2)} || '75' || {digits(f'{_K} % 1000', 3)} || {digits(f'({_K} * 37) % 1000', 3)})"

#: doc_id, text: letters with every kind of thing that the format rules know; every third check digit is wrong.
CONTACTS = f"""SELECT {_K} AS doc_id, 'Compte ' || {pick(_K, ["IBAN", "RIB", "no"])} || ' FR' || {digits(f'{_CHECK} + CASE WHEN {_K} % 3 = 0 THEN 1 ELSE 0 END', 2)}
 || ' ' || substr({_BBAN}, 1, 4) || ' ' || substr({_BBAN}, 5, 4) || ' ' || substr({_BBAN}, 9, 4) || ' ' || substr({_BBAN}, 13, 4) || ' ' || substr({_BBAN}, 17, 4) || ' ' || substr({_BBAN}, 21, 3) || '. NIR '
 || {_NIR} || {digits(f'97 - CAST({_NIR} AS BIGINT) % 97 - CASE WHEN {_K} % 3 = 1 THEN 1 ELSE 0 END', 2)} || ', carte 4970' || {digits(f'{_K} * 104729', 12)} || chr(10)
 || 'Tel ' || {pick(_K, ["06 ", "+33 6 ", "0033 7.", "+44 20 ", "x06 "])} || {digits(f'{_K} % 90 + 10', 2)} || ' ' || {digits(f'{_K} % 100', 2)} || ' ' || {digits(f'({_K} * 3) % 100', 2)} || ' ' || {digits(f'({_K} * 7) % 100', 2)} || ' puis '
 || {pick(_K, ["jean.", "Élodie", "a%b_", ""])} || 'x' || CAST({_K} AS STRING) || '@mail' || CAST({_K} % 5 AS STRING) || {pick(_K, [".example.fr", ".co", "", ".sub.domain.org."])} || ' et (www.site' || CAST({_K} AS STRING) || '.fr/a?b=1). https://h.example/' || {pick(_K, ["x!", 'y"z', "é,"])} || chr(10)
 || 'Le ' || CAST({_K} % 31 + 1 AS STRING) || {pick(_K, ["/", "-", "."])} || CAST({_K} % 13 AS STRING) || '/' || CAST(1890 + {_K} % 150 AS STRING) || ' ou ' || CAST(1990 + {_K} % 30 AS STRING) || '-' || {digits(f'{_K} % 13', 2)} || '-' || {digits(f'{_K} % 32', 2)}
 || ', le ' || {pick(_K, ["1er", "3", "31", "0"])} || ' ' || {pick(_K, ["août", "FÉVRIER", "mai", "smarch"])} || ' 2021 / ' || {pick(_K, ["March", "may", "Smarch"])} || ' ' || CAST({_K} % 33 AS STRING) || {pick(_K, ["th, ", "", ", ", "nd"])} || ' 2019'
 || ' IP 10.' || CAST({_K} % 300 AS STRING) || '.0.' || CAST({_K} % 7 AS STRING) || '; habite ' || CAST({_K} % 200 AS STRING) || {pick(_K, [" bis rue", ", avenue", " RUE", " ter Impasse", " allée"])} || {pick(_K, [" du Port", " DES LILAS", " de l’Orme Gris Bleu Vert"])} || {pick(_K, [", 75011 ", " 69003 ", ", "])} || {pick(_K, ["Valbrune", "CHANVRAY SUR ORME", "Saint-Orme Les Bains"])} || '.' AS text FROM customer"""

_O = "o_orderkey"
#: doc_id, text: short letters with people, places and identifiers.
LETTERS = f"""SELECT {_O} AS doc_id, {pick(_O, CITY)} || ', le ' || CAST({_O} % 28 + 1 AS STRING) || ' mai. ' || {pick(_O, ["Madame ", "M. ", "Dr ", "Bonjour ", "Merci "])} || {pick(f"({_O} + 3)", FIRST)} || ' ' || {pick(_O, LAST)} || {pick(_O, [" habite ", ", né à ", " vers ", " (PDF) "])} || {pick(f"({_O} + 1)", CITY)} || {pick(_O, [" (Drome)", " de Rose", ".", " sur Orme"])} || chr(10)
 || {pick(_O, ["Nom : ", "Responsable: ", "Patient ", "Name:"])} || {pick(f"({_O} + 2)", LAST)} || ' ' || {pick(_O, FIRST)} || '. ' || {pick(_O, ["Né à ", "Fait à ", "Ville : ", "Born in ", "Depuis "])} || {pick(f"({_O} + 3)", CITY)} || '! '
 || {pick(_O, ["N° ", "Matricule ", "Dossier client : ", "Réf. ", "Facture n°"])} || {pick(_O, ["AB", "", "CLI 00", "x"])} || CAST({_O} AS STRING) || {pick(_O, [" C", "-7", " fin", ""])} || ' total ' || CAST({_O} * 13 AS STRING) || {pick(_O, [" €", "", " eur", "a"])}
 || ' puis ' || {digits(f"{_O} % 100", 2)} || ' ' || {digits(f"({_O} * 7) % 1000", 3)} || ' ' || {digits(f"({_O} * 11) % 1000", 3)} || ' ' || {pick(_O, ["K9-AX", "AAAA1", "b2C"])} || CAST({_O} % 97 AS STRING) || ' – Rose Vaubrun Quinault' AS text FROM orders"""

#: thread, seq, text: a customer's orders as messages that name some things again and again.
MESSAGES = f"""SELECT o_custkey AS thread, {_O} AS seq, 'Du ' || substr(CAST(o_orderdate AS STRING), 1, 10) || ' : a Client' || CAST({_O} % 4 AS STRING) || '@Mail.example.fr ou au ' || {pick(_O, ["06 12 34 56 ", "0612.34.56.", "+33 6 12 34 56 ", "x "])} || {digits(f"{_O} % 20", 2)}
 || ', poste 10.0.0.' || CAST({_O} % 9 AS STRING) || {pick(_O, [" (www.site", " – WWW.site", " et é"])} || CAST(o_custkey % 3 AS STRING) || '.fr/a), client' || CAST(({_O} + 1) % 4 AS STRING) || '@mail.example.fr' || {pick(_O, [".", "", " et 192.168.1.1"])} AS text FROM orders"""

#: doc_id, page, item, str, left_, top_, width, height, has_eol, horizontal: lines of orders as text items of pages.
ITEMS = f"""SELECT l_orderkey AS doc_id, CAST(l_linenumber % 3 AS INT) AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS item, l_returnflag || ' item ' || CAST(l_partkey AS STRING) AS str,
 CAST(l_linenumber * 10 AS DOUBLE) AS left_, CAST((l_linenumber * 7) % 40 AS DOUBLE) AS top_, CAST(l_partkey % 90 + 10 AS DOUBLE) AS width, CAST(8 + l_linenumber % 3 * 2 AS DOUBLE) AS height,
 l_linenumber % 2 = 0 AS has_eol, l_suppkey % 5 <> 0 AS horizontal FROM lineitem"""
