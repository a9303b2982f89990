"""Format rules: patterns with a priority and, for some, a check of the match."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import SPACE, is_valid_card, is_valid_iban, is_valid_nir

from .spans import spans

# ASCII word borders: Java's \b minds Unicode letters, the grammar does not.
_B = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# The grammars. Repeats are possessive, or bounded where that would match otherwise, as plain ones could
# exhaust Java's stack.
_NUMBER = _B + "\\d{1,4}(?: ?(?:bis|ter|BIS|TER))?,? "
_STREET = "(?:[Rr]ue|[Aa]venue|[Aa]v\\.|[Bb]oulevard|[Bb]d|[Pp]lace|[Cc]hemin|[Aa]ll[ée]e|[Ii]mpasse|[Rr]oute|[Qq]uai|[Cc]ours|[Ss]quare)"
_STREET_CAPS = "(?:RUE|AVENUE|AV\\.|BOULEVARD|BD|PLACE|CHEMIN|ALL[ÉE]E|IMPASSE|ROUTE|QUAI|COURS|SQUARE)"
_WORD, _WORD_CAPS = "[A-Za-zÀ-ÿ'’-]+", "[A-ZÀ-Þ'’-]+"
_DAY, _MONTH, _YEAR = "(?:0?[1-9]|[12]\\d|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)\\d{2}"
_FR_MONTHS = "janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre"
_EN_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_OCTET = "(?:25[0-5]|2[0-4]\\d|1\\d\\d|[1-9]?\\d)"
_SEP = f"[{SPACE}.-]?"


class Rule(NamedTuple):
    name: str
    type: str
    priority: int
    pattern: str
    valid: Callable[[Column], Column] | None = None


RULES = [
    Rule("address_full", "ADRESSE", 90, f"{_NUMBER}{_STREET} [^\\n,]{{2,60}}?,? \\d{{5}} [A-ZÀ-Þ]{_WORD}(?: [A-ZÀ-Þ]{_WORD})*+"),
    Rule("address_full_caps", "ADRESSE", 90, f"{_NUMBER}{_STREET_CAPS} [^\\n,]{{2,60}}?,? \\d{{5}} {_WORD_CAPS}(?: {_WORD_CAPS})*+"),
    Rule("address_street", "ADRESSE", 90, f"{_NUMBER}{_STREET} {_WORD}(?: {_WORD}){{0,3}}"),
    Rule("address_street_caps", "ADRESSE", 90, f"{_NUMBER}{_STREET_CAPS} {_WORD_CAPS}(?: {_WORD_CAPS}){{0,3}}"),
    Rule("iban", "IBAN", 80, f"(?i){_B}[A-Z]{{2}}\\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?{_B}", is_valid_iban),
    Rule("nir", "NIR", 70, f"{_B}[12] ?\\d{{2}} ?\\d{{2}} ?(?:\\d{{2}}|2[AB]) ?\\d{{3}} ?\\d{{3}} ?\\d{{2}}{_B}", is_valid_nir),
    Rule("card", "CARTE_BANCAIRE", 60, f"{_B}\\d(?:[ -]?\\d){{12,18}}{_B}", is_valid_card),
    Rule("url", "URL", 50, f"(?i){_B}(?:https?://|www\\.)[^{SPACE}<>\"']*[^{SPACE}<>\"'.,;:!?)\\]]"),
    Rule("email", "EMAIL", 45, "[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63}){0,126}\\.[A-Za-z]{2,24}"),
    Rule("phone", "TELEPHONE", 40, f"(?<![A-Za-z0-9_+])(?:(?:\\+|00)33{_SEP}[1-9]|0[1-9])(?:{_SEP}\\d{{2}}){{4}}(?!\\d)|(?<![A-Za-z0-9_+])\\+(?!33)[1-9]\\d{{0,2}}(?:{_SEP}\\d{{2,4}}){{2,5}}(?!\\d)"),
    Rule("date_dmy", "DATE", 30, f"{_B}{_DAY}[/.-]{_MONTH}[/.-]{_YEAR}{_B}"),
    Rule("date_iso", "DATE", 30, f"{_B}{_YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\\d|3[01]){_B}"),
    Rule("date_fr", "DATE", 30, f"(?iu){_B}(?:1er|{_DAY}) (?:{_FR_MONTHS}) {_YEAR}{_B}"),
    Rule("date_en", "DATE", 30, f"(?i){_B}(?:{_EN_MONTHS}) {_DAY}(?:st|nd|rd|th)?,? {_YEAR}{_B}"),
    Rule("ip", "IP", 20, f"{_B}{_OCTET}(?:\\.{_OCTET}){{3}}{_B}"),
]
BY_NAME = {r.name: r for r in RULES}


def rule_spans(text: Column, rule: Rule, order: int = 0) -> Column:
    """Valid matches of a rule as candidates; a match that fails its check still uses up its characters."""
    found = spans(text, rule.pattern)
    if rule.valid is not None:
        found = F.filter(found, lambda s: rule.valid(s["value"]))
    return F.transform(found, lambda s: F.struct(F.lit(rule.type).alias("type"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(rule.priority).alias("priority"), F.lit(order).alias("source")))


def candidates(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, type, start, end, value, priority, source (number of the rule): one scan for all rules."""
    found = F.concat(*(rule_spans(F.col(text), r, i) for i, r in enumerate(rules)))
    # the outer form keeps the optimizer from testing the size of the array first, which would run every pattern again
    return docs.select(id_col, F.explode_outer(found).alias("c")).filter("c is not null").select(id_col, "c.*")
