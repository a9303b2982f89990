"""Queries of the span engine: rules, words, context, resolution, labels; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.operators import context, redact, resolve, rules, tokens
from quillspan.operators.rules import _B, BY_NAME, RULES
from quillspan.types import COMPACT, TYPES, type_table

from .sources import CONTACTS, LETTERS, LEXICON

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def tables(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The given SQL over tables read from the folder."""
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
    return spark.sql(sql)


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by the key that the windows and joins after the scan need, which also spreads a small file over all cores."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.read.parquet(f"{sf_dir}/customer.parquet").repartition(parts, "c_custkey").createOrReplaceTempView("customer")
    return spark.sql(CONTACTS)


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, LETTERS, "orders")


def dealt_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A letter is made from its key alone: keys are dealt, so that a small or badly cut file keeps all cores busy."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").repartition(parts, "o_orderkey").createOrReplaceTempView("orders")
    return spark.sql(LETTERS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def words(spark: SparkSession) -> DataFrame:
    return tokens.lexicon(spark, LEXICON)


def out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "value", *more)


# ---------------------------------------------------------------- SQL building blocks


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The same grammar for RE2, whose word border is ASCII as it should be."""
    return pattern.replace(_B, "\\b").replace(X.SPACE, "\\s\\x{00A0}").replace("\\u00A0", "\\x{00A0}").replace("(?iu)", "(?i)").replace("\\x0B", "\\x0b").replace("*+", "*").replace("{0,126}", "*")


def spans_sql(source: str, pattern: str, extra: str = "") -> str:
    """doc_id, text, i, s, e, v of all matches."""
    p = quoted(pattern)
    return (
        f"SELECT doc_id, text{extra}, i, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS INT) AS s, ms[i] AS v, ps[i] AS gap "
        f"FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT *, regexp_extract_all(text, {p}) AS ms, regexp_split_to_array(text, {p}) AS ps FROM ({source})) WHERE len(ms) > 0)"
    )


IBAN_OK = (
    "regexp_full_match(upper(regexp_replace(v, '\\s', '', 'g')), '[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}') AND list_reduce(list_transform(string_split(upper(regexp_replace(v[5:] || v[1:4], '\\s', '', 'g')), ''), "
    "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS BIGINT) ELSE CAST(ascii(c) - 55 AS BIGINT) END), lambda a, d: (a * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97) = 1"
)
# The first four characters of the compact form go last; the texts write them without a space.
NIR_OK = "97 - CAST(replace(replace(regexp_replace(v, '\\s', '', 'g')[1:13], '2A', '19'), '2B', '18') AS BIGINT) % 97 = CAST(regexp_replace(v, '\\s', '', 'g')[14:15] AS BIGINT)"
CARD_OK = (
    "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(regexp_replace(v, '[^0-9]', '', 'g')) + 1), "
    "lambda k: CASE WHEN k % 2 = 1 THEN CAST(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[k] AS INT) ELSE CAST(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[k] AS INT) * 2 - CASE WHEN CAST(reverse(regexp_replace(v, '[^0-9]', '', 'g'))[k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
)
CHECKS = {"iban": IBAN_OK, "nir": NIR_OK, "card": CARD_OK}
# RE2 has no look-behind: the character before is checked after the match.
PHONE = "(?:(?:\\+|00)33[\\s.-]?[1-9]|0[1-9])(?:[\\s.-]?\\d{2}){4}|\\+[1-9]\\d{0,2}(?:[\\s.-]?\\d{2,4}){2,5}"


def rule_sql(name: str, source: str) -> str:
    if name == "phone":
        rows = spans_sql(source, PHONE)
        fine = "NOT regexp_matches(gap, '[A-Za-z0-9_+]$') AND NOT regexp_matches(substr(text, CAST(s + length(v) AS INT) + 1, 1), '[0-9]')"
        return f"SELECT doc_id, s, s + length(v) AS e, v FROM ({rows}) WHERE {fine} AND (NOT regexp_matches(v, '^\\+33') OR regexp_full_match(v, '\\+33[\\s.-]?[1-9](?:[\\s.-]?\\d{{2}}){{4}}'))"
    check = f" WHERE {CHECKS[name]}" if name in CHECKS else ""
    return f"SELECT doc_id, s, CAST(s + length(v) AS INT) AS e, v FROM ({spans_sql(source, re2(BY_NAME[name].pattern))}){check}"


for _rule in RULES:

    def _run(spark: SparkSession, sf_dir: str, rule=_rule) -> DataFrame:  # noqa: ANN001
        return out(rules.candidates(contacts(spark, sf_dir), [rule]))

    query(f"detect_{_rule.name}", f"SELECT doc_id, s AS span_start, CAST(e AS INT) AS span_end, v AS value FROM ({rule_sql(_rule.name, CONTACTS)})")(_run)


@query("detect_email_documents", f"SELECT doc_id, s AS span_start, e AS span_end, v AS value FROM ({rule_sql('email', 'SELECT doc_id, text FROM documents')})")
def detect_email_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(rules.candidates(documents(spark, sf_dir), [BY_NAME["email"]]))


@query("detect_url_pages", f"SELECT doc_id, s AS span_start, e AS span_end, v AS value FROM ({rule_sql('url', 'SELECT page_id AS doc_id, html AS text FROM pages')})")
def detect_url_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return out(rules.candidates(pages, [BY_NAME["url"]]))


# ---------------------------------------------------------------- resolution


def candidates_sql(source: str) -> str:
    """doc_id, type, s, e, v, priority, source of every rule."""
    return " UNION ALL ".join(f"SELECT doc_id, '{r.type}' AS type, s, CAST(e AS INT) AS e, v, {r.priority} AS priority, {i} AS source FROM ({rule_sql(r.name, source)})" for i, r in enumerate(RULES))


def merge_sql(cands: str, source: str) -> str:
    return f"""WITH c AS ({cands}), o AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e DESC, source, priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
 g AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e DESC, source, priority ROWS UNBOUNDED PRECEDING) AS island FROM o),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY e - s DESC, priority DESC, s, source) AS best FROM g)
 SELECT doc_id, max(CASE WHEN best = 1 THEN type END) AS type, min(s) AS s, max(e) AS e FROM r GROUP BY doc_id, island"""


def merged_sql(cands: str, source: str) -> str:
    """doc_id, type, s, e, v, text, id of the merged spans."""
    return f"SELECT m.doc_id, m.type, m.s, m.e, substr(t.text, m.s + 1, m.e - m.s) AS v, t.text, m.type || '-' || m.s || '-' || m.e AS id FROM ({merge_sql(cands, source)}) m JOIN ({source}) t USING (doc_id)"


def greedy_sql(cands: str) -> str:
    """doc_id, type, s, e, v of the candidates that overlap none of those kept before them."""
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, priority DESC, s, source, e, type, v) AS r FROM ({cands})),
 g AS (SELECT doc_id, r, [struct_pack(s := s, e := e)] AS kept, true AS keep FROM o WHERE r = 1
 UNION ALL SELECT o.doc_id, o.r, CASE WHEN len(list_filter(kept, lambda k: o.s < k.e AND k.s < o.e)) > 0 THEN kept ELSE list_append(kept, struct_pack(s := o.s, e := o.e)) END, len(list_filter(kept, lambda k: o.s < k.e AND k.s < o.e)) = 0 FROM g JOIN o ON o.doc_id = g.doc_id AND o.r = g.r + 1)
 SELECT o.doc_id, type, s, e, v FROM o JOIN g USING (doc_id, r) WHERE keep"""


def manual_sql(merged: str, masks: str, source: str) -> str:
    """doc_id, type, span_start, span_end, value of spans and masks; an island with a mask is one mask."""
    order = "(PARTITION BY doc_id ORDER BY s, e DESC, masked, type"
    return f"""WITH x AS (SELECT doc_id, type, s, e, false AS masked FROM ({merged}) UNION SELECT doc_id, 'MASQUE', least(a, b), greatest(a, b), true FROM ({masks}) WHERE a <> b),
 o AS (SELECT *, max(e) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
 g AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER {order} ROWS UNBOUNDED PRECEDING) AS island FROM o),
 h AS (SELECT doc_id, CASE WHEN bool_or(masked) THEN 'MASQUE' ELSE any_value(type) END AS type, min(s) AS span_start, max(e) AS span_end FROM g GROUP BY doc_id, island)
 SELECT h.*, substr(t.text, span_start + 1, span_end - span_start) AS value FROM h JOIN ({source}) t USING (doc_id)"""


@query("merge_overlaps", f"SELECT doc_id, type, s AS span_start, e AS span_end FROM ({merge_sql(candidates_sql(CONTACTS), CONTACTS)})")
def merge_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contacts(spark, sf_dir)
    return resolve.merge(rules.candidates(docs), docs).select("doc_id", "type", F.col("start").alias("span_start"), F.col("end").alias("span_end"))


@query("detect_rules", f"SELECT doc_id, s AS span_start, e AS span_end, v AS value, type, type || '-' || s || '-' || e AS id FROM ({greedy_sql(candidates_sql(CONTACTS))})")
def detect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(context.detect(contacts(spark, sf_dir)), "type", "id")


@query("resolve_overlaps", f"SELECT doc_id, s AS span_start, e AS span_end, v AS value, type FROM ({greedy_sql(candidates_sql('SELECT doc_id, text FROM documents'))})")
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return out(resolve.greedy(rules.candidates(docs)), "type")


@query("count_active", f"SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({merge_sql(candidates_sql(CONTACTS), CONTACTS)}) GROUP BY type")
def count_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contacts(spark, sf_dir)
    return resolve.merge(rules.candidates(docs), docs).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def _detections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = contacts(spark, sf_dir)
    return docs, resolve.merge(rules.candidates(docs), docs)


_MERGED = merged_sql(candidates_sql(CONTACTS), CONTACTS)


@query("active_detections", f"SELECT doc_id, id FROM ({_MERGED}) WHERE NOT (type = 'EMAIL' AND doc_id % 2 = 0)")
def active_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _detections(spark, sf_dir)
    off = found.filter("type = 'EMAIL' and doc_id % 2 = 0")
    return resolve.active(found, off).select("doc_id", "id")


_MASKS = "SELECT c_custkey AS doc_id, CAST(c_custkey % 150 AS INT) AS a, CAST((c_custkey * 7) % 150 AS INT) AS b FROM customer"


@query(
    "add_manual",
    f"""WITH d AS ({_MERGED}), m AS (SELECT doc_id, least(a, b) AS lo, greatest(a, b) AS hi FROM ({_MASKS}) WHERE a <> b), h AS (SELECT d.doc_id, min(s) AS s, max(e) AS e FROM d JOIN m USING (doc_id) WHERE s < hi AND lo < e GROUP BY d.doc_id)
 SELECT m.doc_id, 'MASQUE' AS type, least(lo, coalesce(s, lo)) AS span_start, greatest(hi, coalesce(e, hi)) AS span_end, substr(t.text, least(lo, coalesce(s, lo)) + 1, greatest(hi, coalesce(e, hi)) - least(lo, coalesce(s, lo))) AS value FROM m LEFT JOIN h USING (doc_id) JOIN ({CONTACTS}) t USING (doc_id)
 UNION ALL SELECT d.doc_id, d.type, d.s, d.e, d.v FROM d LEFT JOIN m USING (doc_id) WHERE m.lo IS NULL OR NOT (d.s < m.hi AND m.lo < d.e)""",
)
def add_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _detections(spark, sf_dir)
    masks = tables(spark, sf_dir, _MASKS, "customer").select("doc_id", F.col("a").alias("from"), F.col("b").alias("to"))
    return out(resolve.add_manual(found, masks, docs), "type")


@query("add_masks", manual_sql(_MERGED, f"{_MASKS} UNION ALL SELECT c_custkey, CAST((c_custkey * 13) % 150 AS INT), CAST((c_custkey * 29) % 150 AS INT) FROM customer", CONTACTS))
def add_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several masks a document, which may overlap each other."""
    docs, found = _detections(spark, sf_dir)
    masks = tables(spark, sf_dir, f"{_MASKS} UNION ALL SELECT c_custkey, CAST((c_custkey * 13) % 150 AS INT), CAST((c_custkey * 29) % 150 AS INT) FROM customer", "customer")
    return out(resolve.add_manual(found, masks.select("doc_id", F.col("a").alias("from"), F.col("b").alias("to")), docs), "type")


@query(
    "highlight_segments",
    f"""WITH d AS ({_MERGED}), w AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM d)
 SELECT doc_id, s AS span_start, e AS span_end, type, v AS piece FROM d UNION ALL SELECT doc_id, p, s, NULL, substr(text, p + 1, s - p) FROM w WHERE p < s
 UNION ALL SELECT t.doc_id, coalesce(x.e, 0), length(t.text), NULL, substr(t.text, coalesce(x.e, 0) + 1) FROM ({CONTACTS}) t LEFT JOIN (SELECT doc_id, max(e) AS e FROM d GROUP BY doc_id) x USING (doc_id) WHERE coalesce(x.e, 0) < length(t.text)""",
)
def highlight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _detections(spark, sf_dir)
    return resolve.segments(found, docs).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "type", "piece")


# ---------------------------------------------------------------- labels and redaction


def plan_sql(merged: str) -> str:
    compact = ", ".join(f"'{t}'" for t in COMPACT)
    key = f"CASE WHEN type IN ({compact}) THEN upper(regexp_replace(v, '[^A-Za-z0-9+]', '', 'g')) ELSE lower(regexp_replace(trim(v, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '[\\s\\x{{00A0}}]+', ' ', 'g')) END"
    return f"""SELECT doc_id, s, e, '[' || type || '_' || dense_rank() OVER (PARTITION BY doc_id, type ORDER BY seen) || ']' AS label, v, text
 FROM (SELECT *, min(s) OVER (PARTITION BY doc_id, type, {key.replace('{{', '{').replace('}}', '}')}) AS seen FROM ({merged}))"""


@query("plan_replacements", f"SELECT doc_id, s AS span_start, e AS span_end, label FROM ({plan_sql(_MERGED)})")
def plan_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _detections(spark, sf_dir)
    return redact.plan(found).select("doc_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "label")


def redact_sql(merged: str, source: str) -> str:
    return f"""WITH p AS ({plan_sql(merged)}), w AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS b FROM p),
 j AS (SELECT doc_id, string_agg(substr(text, b + 1, s - b) || label, '' ORDER BY s) AS head, max(e) AS e FROM w GROUP BY doc_id)
 SELECT t.doc_id, CASE WHEN j.e IS NULL THEN t.text ELSE j.head || substr(t.text, j.e + 1) END AS redacted FROM ({source}) t LEFT JOIN j USING (doc_id)"""


@query("redact_text", redact_sql(_MERGED, CONTACTS))
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _detections(spark, sf_dir)
    return redact.apply(docs, redact.plan(found)).select("doc_id", "redacted")


_EMAILS = f"SELECT doc_id, 'EMAIL' AS type, s, e, v, text FROM (SELECT *, CAST(s + length(v) AS INT) AS e FROM ({spans_sql('SELECT doc_id, text FROM documents', re2(BY_NAME['email'].pattern))}))"


@query("redact_email", redact_sql(_EMAILS, "SELECT doc_id, text FROM documents"))
def redact_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = rules.candidates(docs, [BY_NAME["email"]])
    return redact.apply(docs, redact.plan(found)).select("doc_id", "redacted")


@query("privacy_leaks", f"WITH r AS ({redact_sql(_MERGED, CONTACTS)}) SELECT count(*) AS n FROM r JOIN ({_MERGED}) d USING (doc_id) WHERE contains(r.redacted, d.v)")
def privacy_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, found = _detections(spark, sf_dir)
    return redact.leaks(redact.apply(docs, redact.plan(found)), found).agg(F.count("*").alias("n"))


@query("type_labels", f"SELECT d.type, label_fr, label_en, count(*) AS n FROM ({_MERGED}) d JOIN (VALUES {', '.join(f'({quoted(a)}, {quoted(c)}, {quoted(d)})' for a, _, c, d in TYPES)}) AS t(type, label_fr, label_en) USING (type) GROUP BY ALL")
def type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = _detections(spark, sf_dir)
    return found.join(type_table(spark), "type").groupBy("type", "label_fr", "label_en").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- words

_WORDS = "\\p{L}+(?:-\\p{L}+)*"
_KEY = "strip_accents(lower(replace(replace(v, '’', ''''), '‘', '''')))"


def tokens_sql(source: str) -> str:
    skip = "[\\s\\x{00A0}\"«»“”''(\\[•*·–—-]"
    return f"""SELECT doc_id, i - 1 AS pos, v AS word, {_KEY} AS key, s, CAST(s + length(v) AS INT) AS e, regexp_matches(v, '^\\p{{Lu}}') AS capitalized, length(v) >= 2 AND NOT regexp_matches(v, '\\p{{Ll}}') AS all_caps,
 regexp_matches(gap, '[\\n.!?…]{skip}*$') OR (i = 1 AND regexp_matches(gap, '^{skip}*$')) AS sentence_start, gap, i > 1 AND regexp_full_match(gap, '[ \\t\\x{{00A0}}]+') AS blank_gap, text FROM ({spans_sql(source, _WORDS)})"""


_TOKEN_COLUMNS = "doc_id, CAST(pos AS INT) AS pos, word, key, s AS span_start, e AS span_end, capitalized, all_caps, sentence_start, blank_gap"


def _tokens_out(t: DataFrame) -> DataFrame:
    return t.select("doc_id", "pos", "word", "key", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "capitalized", "all_caps", "sentence_start", "blank_gap")


@query("tokenize", f"SELECT {_TOKEN_COLUMNS} FROM ({tokens_sql(LETTERS)})")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens_out(tokens.tokenize(letters(spark, sf_dir)))


@query("tokenize_documents", f"SELECT {_TOKEN_COLUMNS} FROM ({tokens_sql('SELECT doc_id, text FROM documents')})")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens_out(tokens.tokenize(documents(spark, sf_dir)))


_LEX = "SELECT kind, strip_accents(lower(w)) AS key FROM (VALUES " + ", ".join(f"('{k}', {quoted(w)})" for k, ws in LEXICON.items() for w in ws) + ") AS t(kind, w)"
_WORD_LIST = "[" + ", ".join(quoted(w) for w in LEXICON["words"]) + "]"
_FLAGS = f"""SELECT t.*, coalesce(f.first, false) AS is_first, coalesce(f.surname, false) AS is_surname, coalesce(f.place, false) AS is_place, coalesce(f.word, false) OR (contains(t.key, '-') AND list_bool_and(list_transform(string_split(t.key, '-'), lambda p: length(p) < 2 OR list_contains({_WORD_LIST}, p)))) AS common
 FROM ({tokens_sql(LETTERS)}) t LEFT JOIN (SELECT key, bool_or(kind = 'firstNames') AS first, bool_or(kind = 'surnames') AS surname, bool_or(kind IN ('places', 'territories')) AS place, bool_or(kind = 'words') AS word FROM ({_LEX}) GROUP BY key) f USING (key)"""


@query("common_words", f"SELECT key, is_first, is_surname, is_place, common, count(*) AS n FROM ({_FLAGS}) GROUP BY ALL")
def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens.known(tokens.tokenize(letters(spark, sf_dir)), words(spark))
    return t.groupBy("key", "is_first", "is_surname", "is_place", "common").agg(F.count("*").alias("n"))


@query("parse_lexicon", "SELECT DISTINCT lang AS kind, regexp_replace(line, '\\r$', '') AS key FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_replace(line, '\\r$', '') <> ''")
def parse_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokens.parse_lexicon(docs.select(F.col("lang").alias("kind"), F.explode(F.split("text", "\n", -1)).alias("line")))


# ---------------------------------------------------------------- context


def _list(words_: list[str]) -> str:
    return "(" + ", ".join(quoted(w) for w in words_) + ")"


_LIKE = f"capitalized AND length(key) >= 2 AND NOT acronym AND (NOT common OR ((is_surname OR is_first) AND (all_caps OR NOT sentence_start)))"
_CONTEXT = f"""SELECT *, {_LIKE} AS name_like FROM (SELECT *, key IN {_list(context.ACRONYMS)} AS acronym, key IN {_list(context.PARTICLES)} AND NOT capitalized AS particle FROM ({_FLAGS}))"""


def chain_sql(rows: str, first: int, mode: str) -> str:
    """Adds last: how many words on a name reaches, one step of SQL a word.  mode: name, label or place."""
    w = "OVER (PARTITION BY doc_id ORDER BY pos)"
    cols = []
    for j in range(1, 6):
        k = j + first
        cols += [f"lead({c}, {k}) {w} AS {c}_{j}" for c in ("key", "e", "blank_gap", "capitalized", "sentence_start", "name_like", "particle")]
    at = f"lead(e, {first}) {w}" if first else "e"
    sql = f"SELECT *, true AS go_0, 0 AS last_0, {at} AS e_0, {', '.join(cols)} FROM ({rows})"
    for j in range(1, 5):
        joined = f"coalesce(go_{j - 1} AND blank_gap_{j}, false)"
        if mode == "name":
            passes = f"coalesce(particle_{j} AND blank_gap_{j + 1} AND name_like_{j + 1}, false)"
            word = f"coalesce(NOT particle_{j} AND (name_like_{j} OR (last_{j - 1} = {j - 1} AND capitalized_{j} AND NOT sentence_start_{j})), false)"
        else:
            word = f"coalesce(capitalized_{j}, false)"
            passes = f"coalesce(NOT capitalized_{j} AND key_{j} IN {_list(context.PARTICLES)}, false)" if mode == "label" else f"coalesce(NOT capitalized_{j} AND key_{j} IN {_list(context.CONNECTORS)} AND capitalized_{j + 1} AND blank_gap_{j + 1}, false)"
        sql = f"SELECT *, {joined} AND ({word} OR {passes}) AS go_{j}, CASE WHEN {joined} AND {word} THEN {j} ELSE last_{j - 1} END AS last_{j} FROM ({sql})"
    return f"SELECT *, CASE last_4 WHEN 0 THEN e_0 WHEN 1 THEN e_1 WHEN 2 THEN e_2 WHEN 3 THEN e_3 ELSE e_4 END AS last_e FROM ({sql})"


def _value(rows: str) -> str:
    return f"SELECT doc_id, CAST(s AS INT) AS span_start, CAST(e AS INT) AS span_end, substr(text, CAST(s AS INT) + 1, CAST(e - s AS INT)) AS value FROM ({rows})"


def _context(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = letters(spark, sf_dir)
    return docs, context.context_tokens(docs, words(spark))


_CIVIL = f"""SELECT doc_id, text, ns AS s, last_e AS e FROM (SELECT *, lead(s) {'OVER (PARTITION BY doc_id ORDER BY pos)'} AS ns, lead(gap) OVER (PARTITION BY doc_id ORDER BY pos) AS ngap, lead(capitalized) OVER (PARTITION BY doc_id ORDER BY pos) AS ncap, lead(key) OVER (PARTITION BY doc_id ORDER BY pos) AS nkey FROM ({chain_sql(_CONTEXT, 1, "name")}))
 WHERE capitalized AND key IN {_list(context.CIVILITIES)} AND regexp_full_match(ngap, '\\.?[ \\t\\x{{00A0}}]+') AND ncap AND length(nkey) >= 2"""


@query("detect_person_civility", _value(_CIVIL))
def detect_person_civility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, t = _context(spark, sf_dir)
    return out(context.civility_people(t, docs))


_W = "OVER (PARTITION BY doc_id ORDER BY pos)"
_BACK = f"""SELECT *, CASE WHEN b4 THEN lag(s, 4) {_W} WHEN b3 THEN lag(s, 3) {_W} WHEN b2 THEN lag(s, 2) {_W} WHEN b1 THEN lag(s, 1) {_W} ELSE s END AS first_s FROM (SELECT *, b3 AND coalesce(lag(blank_gap, 3) {_W} AND lag(ok, 4) {_W}, false) AS b4 FROM (SELECT *, b2 AND coalesce(lag(blank_gap, 2) {_W} AND lag(ok, 3) {_W}, false) AS b3
 FROM (SELECT *, b1 AND coalesce(lag(blank_gap, 1) {_W} AND lag(ok, 2) {_W}, false) AS b2 FROM (SELECT *, coalesce(blank_gap AND lag(ok, 1) {_W}, false) AS b1, coalesce(lead(blank_gap) {_W} AND lead(name_like) {_W}, false) AS followed FROM (SELECT *, name_like AND key NOT IN {_list(context.CIVILITIES)} AS ok FROM ({chain_sql(_CONTEXT, 0, "name")}))))))"""
_FIRST = f"SELECT doc_id, text, first_s AS s, last_e AS e FROM ({_BACK}) WHERE capitalized AND is_first AND length(key) >= 3 AND key NOT IN {_list(context.CIVILITIES + context.PARTICLES + context.FUNCTION_WORDS)} AND NOT acronym AND NOT (common AND sentence_start AND NOT all_caps AND NOT followed)"


@query("detect_person_firstname", _value(_FIRST))
def detect_person_firstname(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, t = _context(spark, sf_dir)
    return out(context.first_name_people(t, docs))


def _after_sql(pattern: str, mode: str) -> str:
    """Tokens right after a match whose look-behind is checked on the text before it."""
    p = re2(pattern).replace("(?<!\\p{L})", "").replace("(?![\\p{L}])", "").replace("(?!\\p{L})", "\\b")
    ends = f"SELECT DISTINCT doc_id, CAST(s + length(v) AS INT) AS s FROM ({spans_sql(LETTERS, p)}) WHERE NOT regexp_matches(gap, '\\p{{L}}$')"
    return f"SELECT c.* FROM ({chain_sql(_CONTEXT, 0, mode)}) c SEMI JOIN ({ends}) x ON c.doc_id = x.doc_id AND c.s = x.s WHERE c.capitalized"


_LABELLED = f"SELECT doc_id, text, s, last_e AS e FROM ({_after_sql(context.NAME_LABEL, 'label')})"


@query("detect_person_label", _value(_LABELLED))
def detect_person_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, t = _context(spark, sf_dir)
    return out(context.labelled_people(t, docs))


def _bracket(rows: str) -> str:
    return f"SELECT doc_id, text, s, last_e + length(regexp_extract(substr(text, CAST(last_e AS INT) + 1, 48), '^[ \\t\\x{{00A0}}]*\\([^()\\n]{{1,40}}\\)')) AS e FROM ({rows})"


# The word border of RE2 is ASCII and does not end an accented letter.
_FORMULA_PLACES = f"SELECT * FROM ({_after_sql(context.PLACE_FORMULA, 'place')})".replace("(?:[àa]|au|aux|en|de|in|at)\\b", "(?:à|(?:a|au|aux|en|de|in|at)\\b)")


@query("detect_place_formula", _value(_bracket(_FORMULA_PLACES)))
def detect_place_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, t = _context(spark, sf_dir)
    return out(context.formula_places(t, docs))


_DATELINE = f"SELECT doc_id, text, s + position(n IN v) - 1 AS s, s + position(n IN v) - 1 + length(n) AS e FROM (SELECT *, regexp_extract(v, {quoted(re2(context.DATELINE).replace('(?<=\\A|[\\n\\r\\u2028\\u2029])', '(?m:^)'))}, 1) AS n FROM ({spans_sql(LETTERS, re2(context.DATELINE).replace('(?<=\\A|[\\n\\r\\u2028\\u2029])', '(?m:^)'))}))"


@query("detect_place_dateline", _value(_DATELINE))
def detect_place_dateline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(context.datelines(letters(spark, sf_dir)))


_PLACES = f"""SELECT * FROM (SELECT *, lag(key) {_W} AS pk, lag(capitalized) {_W} AS pc FROM ({chain_sql(_CONTEXT, 0, "place")})) WHERE capitalized AND is_place AND (coalesce(NOT pc AND pk IN {_list(context.PREPOSITIONS)} AND (NOT common OR pk NOT IN ('de', 'd')) AND regexp_full_match(gap, '[ \\t\\x{{00A0}}''’]+'), false) OR (NOT common AND (NOT sentence_start OR all_caps)))"""


@query("detect_place_lexicon", _value(_bracket(_PLACES)))
def detect_place_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, t = _context(spark, sf_dir)
    return out(context.known_places(t, docs))


_PROPER = f"""SELECT doc_id, min(s) AS s, max(e) AS e, any_value(text) AS text FROM (SELECT *, sum(CASE WHEN hit AND blank_gap AND coalesce(ph, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, lag(hit) {_W} AS ph FROM (SELECT *, capitalized AND length(key) >= 2 AND NOT acronym AND NOT common AS hit FROM ({_CONTEXT})))) WHERE hit GROUP BY doc_id, run"""


@query("detect_proper_noun", _value(_PROPER))
def detect_proper_noun(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(context.proper_noun_spans(dealt_letters(spark, sf_dir), words(spark)))


_HEAD = "^[A-Za-z0-9][A-Za-z0-9./_-]{0,63}(?: [A-Za-z0-9][A-Za-z0-9./_-]{0,63})*"
_LABEL = re2(context.ID_LABEL).replace("(?<![\\p{L}\\d])", "").replace("(?!\\p{L})", "").replace("(?=[\\s\\x{00A0}]*[:\\d])", "")
# What the label must not stand in or before is checked on the text around it.
_ID_ENDS = f"""SELECT doc_id, text, x, regexp_extract(substr(text, x + 1, 80), '^[^:\\n]{{0,40}}?:[ \\t\\x{{00A0}}]*') AS colon, regexp_extract(substr(text, x + 1, 80), '^[ \\t\\x{{00A0}}°]*') AS direct FROM (SELECT *, CAST(s + length(v) AS INT) AS x FROM ({spans_sql(LETTERS, _LABEL)}))
 WHERE NOT regexp_matches(gap, '[\\p{{L}}0-9]$') AND (lower(v) = 'n°' OR CASE WHEN regexp_full_match(v, '(?i)n[oº]\\.?') THEN regexp_matches(substr(text, x + 1), '^[\\s\\x{{00A0}}]*[:0-9]') ELSE NOT regexp_matches(substr(text, x + 1, 1), '\\p{{L}}') END)"""
# The longest run of parts that hold a digit or are one to three capitals, if it has two digits.
_LABELLED_IDS = f"""SELECT DISTINCT doc_id, text, b AS s, b + length(code) AS e FROM (SELECT *, array_to_string(ps[1:coalesce(nullif(list_position(list_transform(ps, lambda p: NOT (regexp_matches(p, '[0-9]') OR regexp_full_match(p, '[A-Z]{{1,3}}'))), true), 0), len(ps) + 1) - 1], ' ') AS code
 FROM (SELECT *, string_split(regexp_extract(substr(text, b + 1), {quoted(_HEAD)}), ' ') AS ps FROM (SELECT *, CAST(x + length(CASE WHEN colon <> '' THEN colon ELSE direct END) AS INT) AS b FROM ({_ID_ENDS})))) WHERE length(regexp_replace(code, '[^0-9]', '', 'g')) >= 2"""


@query("detect_labelled_id", _value(_LABELLED_IDS))
def detect_labelled_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(context.labelled_ids(letters(spark, sf_dir)))


# Maximal digit runs; the guards are checked on the characters around them.
def _guarded(pattern: str) -> str:
    return f"SELECT * FROM (SELECT *, substr(text, s, 1) AS b, substr(text, CAST(s + length(v) AS INT) + 1) AS a FROM ({spans_sql(LETTERS, pattern)})) WHERE (s = 0 OR NOT regexp_matches(b, '[\\p{{L}}0-9,.]')) AND NOT regexp_matches(a, '(?i)^(?:[\\p{{L}}0-9]|[.,][0-9]|\\s?(?:€|%|eur\\b|euros?\\b))')"


_LONG = _guarded("[0-9]{5,}")
_GROUPED = f"SELECT * FROM ({_guarded('[0-9]{2,4}(?:[ .][0-9]{2,4}){2,}')}) WHERE length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7"
# Runs of letters, digits and hyphens, cut at hyphens; neighbouring parts of capitals and digits alone are one code.
_MIXED = f"""SELECT doc_id, any_value(text) AS text, min(b) FILTER (ok) AS s, max(b + length(p)) FILTER (ok) AS e FROM (SELECT *, sum(CASE WHEN ok OR p LIKE '-%' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, i ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, regexp_full_match(p, '[A-Z0-9]+') AS ok FROM (SELECT doc_id, text, i, k, ps[k] AS p, CAST(s + coalesce(list_sum(list_transform(ps[1:k-1], lambda x: length(x))), 0) AS INT) AS b
 FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT *, regexp_extract_all(v, '[^-]+|-+') AS ps FROM ({spans_sql(LETTERS, '[\\p{L}0-9-]+')}))))))
 GROUP BY doc_id, i, run HAVING coalesce(sum(length(p)) FILTER (ok), 0) >= 5 AND regexp_matches(regexp_extract(substr(any_value(text), min(b) FILTER (ok) + 1), '^[A-Z0-9-]*'), '[0-9]') AND regexp_matches(regexp_extract(substr(any_value(text), min(b) FILTER (ok) + 1), '^[A-Z0-9-]*'), '[A-Z]')"""


@query("detect_long_number", f"SELECT doc_id, s AS span_start, CAST(s + length(v) AS INT) AS span_end, v AS value FROM ({_LONG})")
def detect_long_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(context.long_numbers(letters(spark, sf_dir)))


@query("detect_grouped_number", f"SELECT doc_id, s AS span_start, CAST(s + length(v) AS INT) AS span_end, v AS value FROM ({_GROUPED})")
def detect_grouped_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(context.grouped_numbers(letters(spark, sf_dir)))


@query("detect_mixed_code", _value(_MIXED))
def detect_mixed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(context.mixed_codes(letters(spark, sf_dir)))


def _found(rows: str, kind: str, priority: int, source: str) -> str:
    return f"SELECT doc_id, '{kind}' AS type, CAST(s AS INT) AS s, CAST(e AS INT) AS e, substr(text, CAST(s AS INT) + 1, CAST(e - s AS INT)) AS v, {priority} AS priority, {context.AFTER_RULES[source]} AS source FROM ({rows})"


def all_sql(strict: bool) -> str:
    """Candidates of all detectors, each once, merged."""
    c = context
    parts = [candidates_sql(LETTERS), _found(_LABELLED_IDS, "IDENTIFIANT", c.LABELLED, "labelled")]
    parts += [_found(rows, "PERSONNE", c.PERSON, source) for rows, source in ((_CIVIL, "person"), (_FIRST, "person"), (_LABELLED, "person_label"))]
    parts += [_found(rows, "LIEU", c.PLACE, source) for rows, source in ((_bracket(_FORMULA_PLACES), "place_formula"), (_DATELINE, "dateline"), (_bracket(_PLACES), "place"))]
    if strict:
        numbers = [(f"SELECT *, s + length(v) AS e FROM ({rows})", source) for rows, source in ((_LONG, "long"), (_GROUPED, "grouped"))]
        parts += [_found(rows, "IDENTIFIANT", c.STRICT, source) for rows, source in (*numbers, (_MIXED, "mixed"))] + [_found(_PROPER, "NOM_PROPRE", c.PROPER, "proper")]
    return merged_sql("SELECT DISTINCT * FROM (" + " UNION ALL ".join(parts) + ")", LETTERS)


@query("detect_balanced", f"SELECT doc_id, s AS span_start, e AS span_end, v AS value, type, id FROM ({all_sql(False)})")
def detect_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(context.detect(dealt_letters(spark, sf_dir), words(spark)), "type", "id")


@query("detect_strict", f"SELECT doc_id, s AS span_start, e AS span_end, v AS value, type, id FROM ({all_sql(True)})")
def detect_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out(context.detect(dealt_letters(spark, sf_dir), words(spark), strict=True), "type", "id")


@query("redetect_with_manual", manual_sql(all_sql(True), f"SELECT doc_id, 3 AS a, 20 AS b FROM ({LETTERS})", LETTERS))
def redetect_with_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt_letters(spark, sf_dir)
    masks = docs.select("doc_id", F.lit(3).alias("from"), F.lit(20).alias("to"))
    return out(resolve.add_manual(context.detect(docs, words(spark), strict=True), masks, docs), "type")


# ---------------------------------------------------------------- scalar functions


@query("normalize_key", "SELECT n_name || ' Élève’s ÀÇÑ œuvre ß' AS raw, replace(replace(strip_accents(lower(n_name || ' Élève’s ÀÇÑ œuvre ß')), '’', ''''), '‘', '''') AS key FROM nation")
def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat("n_name", F.lit(" Élève’s ÀÇÑ œuvre ß")).alias("raw"))
    return n.select("raw", X.normalize_key(F.col("raw")).alias("key"))


@query("validate_ids", f"SELECT doc_id, i AS n, ok FROM (SELECT doc_id, 1 AS i, ({IBAN_OK}) AS ok FROM (SELECT doc_id, regexp_extract(text, 'FR[0-9 ]{{27,}}') AS v FROM (SELECT doc_id, replace(text, '. NIR', ' NIR') AS text FROM ({CONTACTS}))) UNION ALL SELECT doc_id, 2, ({CARD_OK}) FROM (SELECT doc_id, regexp_extract(text, '4970[0-9]{{12}}') AS v FROM ({CONTACTS})))")
def validate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = contacts(spark, sf_dir)
    iban = X.is_valid_iban(F.regexp_extract(F.replace("text", F.lit(". NIR"), F.lit(" NIR")), "FR[0-9 ]{27,}", 0))
    card = X.is_valid_card(F.regexp_extract("text", "4970[0-9]{12}", 0))
    return docs.select("doc_id", F.lit(1).alias("n"), iban.alias("ok")).unionByName(docs.select("doc_id", F.lit(2).alias("n"), card.alias("ok")))
