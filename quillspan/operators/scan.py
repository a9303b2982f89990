"""All detectors in one pass: a batch of texts is one string, words and their surroundings are arrays over it.

The rules, labels and numbers are those of `rules` and `context`, whose columns and windows say the same for one
detector at a time.  Here nothing is shuffled and no word becomes a row: a linear pattern (RE2) first tells which texts
can match a format rule at all, letters are classed by a table, and what a word is by itself is worked out once for each
distinct word of a task.  Texts are parted by line ends with a zero between, which no pattern passes.

Letters are those of Python's Unicode tables; Java's may know fewer of the latest scripts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.text import BARE, MARKED, SPACE
from quillspan.types import COMPACT, TYPES

from . import context as C
from .rules import _B, _DAY, _EN_MONTHS, _NUMBER, _SEP, _STREET, _STREET_CAPS, BY_NAME, RULES, Rule

KINDS = [t for t, *_ in TYPES]
#: Between two texts; characters of texts that are looked at together at most (a longer text is looked at by itself).
APART, TOGETHER = "\n\x00\n", 1 << 20
#: Word lists up to this size go to every task; longer ones are joined by key.
LISTS = 64 << 20
#: Distinct words that a task remembers.
WORDS = 200_000

_FIRST_DIGITS = _NUMBER.replace(_B, "")
#: By rule: what any match has in it, for RE2 (with its wider sense of equal case).
_NEEDS = {
    "address_full": f"{_FIRST_DIGITS}{_STREET} ",
    "address_full_caps": f"{_FIRST_DIGITS}{_STREET_CAPS} ",
    "address_street": f"{_FIRST_DIGITS}{_STREET} ",
    "address_street_caps": f"{_FIRST_DIGITS}{_STREET_CAPS} ",
    "iban": "(?i)[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4}",
    "nir": "[12] ?[0-9]{2} ?[0-9]{2} ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}",
    "card": "[0-9](?:[ -]?[0-9]){12}",
    "url": "(?i)https?://|www\\.",
    "email": "@",
    "phone": f"(?:(?:\\+|00)33{_SEP}[1-9]|0[1-9])(?:{_SEP}[0-9]{{2}}){{4}}|\\+[1-9]".replace("\\u", "\\x").replace(SPACE.replace("\\u", "\\x"), "\\s\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}\\x0B"),
    "date_dmy": "[0-9][/.-][0-9]{1,2}[/.-](?:19|20)[0-9]{2}",
    "date_iso": "(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]",
    "date_fr": "[^ ] [^ ]{3,9} (?:19|20)[0-9]{2}",
    "date_en": f"(?i)(?:{_EN_MONTHS}) {_DAY.replace(chr(92) + 'd', '[0-9]')}",
    "ip": "[0-9]\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]",
}


@lru_cache(None)
def _rule(name: str) -> re.Pattern:
    """The same grammar for Python: digits and word borders are ASCII, and case is but where the rule says (?iu)."""
    p = BY_NAME[name].pattern.replace("\\d", "[0-9]").replace(_B, "(?a:\\b)")
    return re.compile(p.replace("(?iu)", "(?i)")) if p.startswith("(?iu)") else re.compile("(?a)" + p)


def known(rules: Sequence[Rule]) -> bool:
    """Only the rules of the package have a form for Python."""
    return all(BY_NAME.get(r.name) is r for r in rules)


def _mod97(iban: str) -> int:
    return int("".join(str(ord(c) - 55) if c.isalpha() else c for c in iban[4:] + iban[:4])) % 97


def _valid(name: str, raw: str) -> bool:
    """X9 to X11."""
    if name == "card":
        digits = re.sub("[^0-9]", "", raw)
        each = [int(c) for c in reversed(digits)]
        return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(each)) % 10 == 0
    text = re.sub(f"[{SPACE}]", "", raw).upper()
    if name == "iban":
        return re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", text) is not None and _mod97(text) == 1
    if re.fullmatch("[12][0-9]{4}(?:[0-9]{2}|2A|2B)[0-9]{8}", text) is None:
        return False
    return 97 - int(text[:13].replace("2A", "19").replace("2B", "18")) % 97 == int(text[13:15])


def rule_hits(column: pa.Array, texts: list[str | None], at: Sequence[int], rules: Sequence[Rule]) -> list[tuple[int, int, int, int, int]]:
    """start, end, kind, priority, source of the rules' valid matches; at: where each text begins."""
    out = []
    for source, rule in enumerate(rules):
        pattern, kind = _rule(rule.name), KINDS.index(rule.type)
        fits = pc.match_substring(column, "@") if rule.name == "email" else pc.match_substring_regex(column, _NEEDS[rule.name])
        for i in pc.indices_nonzero(fits.fill_null(False)).to_pylist():
            base = at[i]
            for m in pattern.finditer(texts[i]):
                if rule.valid is None or _valid(rule.name, m[0]):
                    out.append((base + m.start(), base + m.end(), kind, rule.priority, source))
    return out


def merged(start: np.ndarray, end: np.ndarray, kind: np.ndarray, priority: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """R2: start, end and kind of the islands of overlapping spans; texts lie apart."""
    order = np.lexsort((-end, start))
    start, end, kind, priority, source = (x[order] for x in (start, end, kind, priority, source))
    new = np.ones(len(start), bool)
    reach = np.maximum.accumulate(end)
    new[1:] = start[1:] >= reach[:-1]
    island = np.cumsum(new) - 1
    best = np.lexsort((source, start, -priority, start - end, island))
    first = np.flatnonzero(new)
    return start[first], np.maximum.reduceat(end, first) if len(first) else end, kind[best][first]


# ---------------------------------------------------------------- characters and words

_LETTER, _HYPHEN, _BLANK, _SKIPPED, _STOP, _DIGIT, _CAPITAL, _LINE = (1 << i for i in range(8))


@lru_cache(None)
def _classes() -> np.ndarray:
    """What each code point is."""
    out = np.zeros(0x110000, np.uint8)
    out[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]] = _LETTER
    space = [c for c in range(0x10000) if re.match(f"[{SPACE}]", chr(c))]
    for bit, chars in ((_HYPHEN, "-"), (_BLANK, " \t\xa0"), (_SKIPPED, "\"«»“”'([•*·–—-" + "".join(map(chr, space))), (_STOP, "\n.!?…"), (_DIGIT, "0123456789"), (_CAPITAL, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_LINE, "\n\r\u2028\u2029")):
        out[[ord(c) for c in chars]] |= bit
    return out


@lru_cache(None)
def _pattern(name: str):  # noqa: ANN202
    import regex

    p = {"name": C.NAME_LABEL, "formula": C.PLACE_FORMULA, "id": C.ID_LABEL, "dateline": C.DATELINE, "long": C.LONG_NUMBER, "grouped": C.GROUPED_NUMBER, "mixed": C.MIXED_CODE}[name]
    # digits are ASCII, in classes and by themselves
    p = p.replace("\\p{L}\\d", "\\p{L}0-9").replace("[:\\d]", "[:0-9]").replace("\\d", "[0-9]")
    return regex.compile(p.replace("(?iu)", "(?i)"))


#: Java takes these for the same letter as i where case does not count.
_DOTS = {ord("ı"): "i", ord("İ"): "i"}


_BITS = ["capitalized", "all_caps", "first", "surname", "place", "common", "acronym", "particle_key", "civility", "connector", "preposition", "of", "no_name", "two", "three", "name", "formula", "id"]
BIT = {n: 1 << i for i, n in enumerate(_BITS)}
_BARE = {ord(m): b for m, b in zip(MARKED + "’‘", BARE + "''")}


class Flags(dict):
    """What a word is by itself, as bits; lists: key -> bits of the word lists."""

    def __init__(self, lists: dict[str, int]) -> None:
        super().__init__()
        self.lists = lists

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS:
            self.clear()
        key = word.translate(_BARE).lower()
        kind = [unicodedata.category(c) for c in word]
        listed = self.lists.get(key, 0)
        if "-" in key and all(len(p) < 2 or self.lists.get(p, 0) & BIT["common"] for p in key.split("-")):
            listed |= BIT["common"]
        facts = {
            "capitalized": kind[0] == "Lu", "all_caps": len(word) >= 2 and "Ll" not in kind, "acronym": key in C.ACRONYMS, "particle_key": key in C.PARTICLES, "civility": key in C.CIVILITIES, "connector": key in C.CONNECTORS, "preposition": key in C.PREPOSITIONS,
            "of": key in ("de", "d"), "no_name": key in C.CIVILITIES or key in C.PARTICLES or key in C.FUNCTION_WORDS, "two": len(key) >= 2, "three": len(key) >= 3,
        } | {n: _pattern(n).match(word.translate(_DOTS), partial=True) is not None for n in ("name", "formula", "id")}
        self[word] = out = listed | sum(BIT[n] for n, yes in facts.items() if yes)
        return out


def _list_bits(words: DataFrame) -> dict[str, int]:
    bit = {"firstNames": BIT["first"], "surnames": BIT["surname"], "places": BIT["place"], "territories": BIT["place"], "words": BIT["common"]}
    out: dict[str, int] = {}
    for kind, key in zip(*(c.to_pylist() for c in words.select("kind", "key").toArrow().columns)):
        if key is not None:
            out[key] = out.get(key, 0) | bit.get(kind, 0)
    return out


def _starts(pattern, joined: str, starts: list[int]) -> list[tuple[int, int]]:  # noqa: ANN001
    """Matches that begin at the given places, as a search from left to right finds them."""
    out, at = [], 0
    for s in starts:
        if s >= at and (m := pattern.match(joined, s)):
            out.append(m.span())
            at = m.end()
    return out


_CHUNKS = re.compile("(?:[A-Za-z0-9][A-Za-z0-9./_-]{0,63}(?: [A-Za-z0-9][A-Za-z0-9./_-]{0,63})*)?")
_SHORT, _NO_DIGITS = re.compile("[A-Z]{1,3}"), re.compile("[^0-9]+")
_COLON, _RIGHT_AWAY = re.compile("[^:\\n]{0,40}?:[ \\t\\xa0]*"), re.compile("[ \\t\\xa0°]*")


def _code(joined: str, start: int) -> int:
    """C2; a code ends with its line, so texts stay apart."""
    head, at, end, digits = _CHUNKS.match(joined, start)[0], 0, -1, 0
    for c in head.split(" "):
        n = len(_NO_DIGITS.sub("", c))
        if not (n or _SHORT.fullmatch(c)):
            break
        digits += n
        at += len(c)
        end = at if digits else end
        at += 1
    return end if digits >= 2 else -1


class Words:
    """The words of a batch and what stands around each, as arrays."""

    def __init__(self, joined: str, begin: np.ndarray, flags: Flags) -> None:
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        self.joined, self.dotted, self.cls = joined, joined.translate(_DOTS) if "ı" in joined or "İ" in joined else joined, _classes()[chars]
        letter = self.cls & _LETTER > 0
        inside = letter.copy()
        inside[1:-1] |= (self.cls[1:-1] & _HYPHEN > 0) & letter[:-2] & letter[2:]
        self.start, self.end = _runs(inside)
        n = len(self.start)
        self.doc = np.searchsorted(begin, self.start, "right") - 1
        head = np.ones(n, bool)
        head[1:] = self.doc[1:] != self.doc[:-1]
        gap = np.where(head, begin[self.doc], np.concatenate([[0], self.end[:-1]])) if n else self.start
        self.gap, place = gap, np.arange(len(chars), dtype=np.int32)
        other = np.maximum.accumulate(np.where(self.cls & _SKIPPED > 0, -1, place))[self.start - 1]
        stop = np.maximum.accumulate(np.where(self.cls & _STOP > 0, place, -1))[self.start - 1]
        blanks = np.concatenate([[0], np.cumsum(self.cls & _BLANK > 0)])
        self.sentence = ((stop >= gap) & (stop >= other)) | (head & (other < gap))
        self.blank = ~head & (self.start > gap) & (blanks[self.start] - blanks[gap] == self.start - gap)
        words = [joined[s:e] for s, e in zip(self.start.tolist(), self.end.tolist())]
        self.bits = np.fromiter(map(flags.__getitem__, words), np.int64, n)
        # a label may also begin after a hyphen in a word
        split = [(s + m.start(), flags[m[0]]) for s, w in zip(self.start.tolist(), words) if "-" in w for m in re.finditer("[^-]+", w)]
        whole = np.fromiter(("-" not in w for w in words), bool, n)
        self.run_at = np.concatenate([self.start[whole], np.array([s for s, _ in split], np.int64)])
        self.run_bits = np.concatenate([self.bits[whole], np.array([b for _, b in split], np.int64)])
        has = self.has
        self.capitalized, self.all_caps, self.common, self.particle = has("capitalized"), has("all_caps"), has("common"), has("particle_key") & ~has("capitalized")
        named = ~self.common | ((has("surname") | has("first")) & (self.all_caps | ~self.sentence))
        self.like = self.capitalized & has("two") & ~has("acronym") & named

    def has(self, name: str) -> np.ndarray:
        return self.bits & BIT[name] > 0

    def labels(self, name: str) -> list[tuple[int, int]]:
        return _starts(_pattern(name), self.dotted, np.sort(self.run_at[self.run_bits & BIT[name] > 0]).tolist())

    def by(self, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The words k on from those of i, and whether they are there, in the same text."""
        j = np.clip(i + k, 0, len(self.start) - 1)
        return j, (i + k == j) & (self.doc[j] == self.doc[i])

    def extend(self, i: np.ndarray) -> np.ndarray:
        """The last word of the name that goes on from each of i."""
        last, go = np.zeros(len(i), np.int64), np.ones(len(i), bool)
        for j in range(1, C.REACH + 1):
            (t, there), (n, next_) = self.by(i, j), self.by(i, j + 1)
            joined = go & there & self.blank[t]
            passes = self.particle[t] & next_ & self.blank[n] & self.like[n]
            word = ~self.particle[t] & (self.like[t] | ((last == j - 1) & self.capitalized[t] & ~self.sentence[t]))
            last, go = np.where(joined & word, j, last), joined & (passes | word)
        return i + last

    def extend_back(self, i: np.ndarray) -> np.ndarray:
        """C11"""
        last, go, civil = np.zeros(len(i), np.int64), np.ones(len(i), bool), self.has("civility")
        for j in range(1, C.REACH + 1):
            (t, there), (g, _) = self.by(i, -j), self.by(i, 1 - j)
            go = go & there & self.blank[g] & self.like[t] & ~civil[t]
            last = np.where(go, j, last)
        return i - last

    def chain(self, i: np.ndarray, link: str) -> np.ndarray:
        """The last of the capitalized words from each of i on, over what links them."""
        last, go, links = np.zeros(len(i), np.int64), np.ones(len(i), bool), self.has("particle_key" if link == "label" else "connector")
        for j in range(1, C.REACH + 1):
            (t, there), (n, next_) = self.by(i, j), self.by(i, j + 1)
            joined = go & there & self.blank[t]
            over = links[t] if link == "label" else ~self.capitalized[t] & links[t] & next_ & self.capitalized[n] & self.blank[n]
            last, go = np.where(joined & self.capitalized[t], j, last), joined & (self.capitalized[t] | over)
        return i + last

    def gaps_fit(self, i: np.ndarray, pattern: str) -> np.ndarray:
        fit = re.compile(pattern).fullmatch
        return np.fromiter((fit(self.joined, g, s) is not None for g, s in zip(self.gap[i].tolist(), self.start[i].tolist())), bool, len(i))

    def bracketed(self, end: np.ndarray) -> np.ndarray:
        fit = re.compile(C.PARENTHESIS[1:]).match
        return end + np.fromiter((m.end() - e if (m := fit(self.joined, e, e + 48)) else 0 for e in end.tolist()), np.int64, len(end))

    # the detectors: start and end of each candidate

    def civility(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(self.capitalized & self.has("civility"))
        n, there = self.by(i, 1)
        n = n[there & self.capitalized[n] & self.has("two")[n]]
        n = n[self.gaps_fit(n, "\\.?[ \\t\\xa0]+")]
        return self.start[n], self.end[self.extend(n)]

    def first(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(self.capitalized & self.has("first") & self.has("three") & ~self.has("no_name") & ~self.has("acronym"))
        n, there = self.by(i, 1)
        followed = there & self.blank[n] & self.like[n]
        i = i[~(self.common[i] & self.sentence[i] & ~self.all_caps[i] & ~followed)]
        return self.start[self.extend_back(i)], self.end[self.extend(i)]

    def label(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(self.capitalized & np.isin(self.start, np.array([e for _, e in self.labels("name")], np.int64)))
        return self.start[i], self.end[self.chain(i, "label")]

    def formula(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(self.capitalized & np.isin(self.start, np.array([e for _, e in self.labels("formula")], np.int64)))
        return self.start[i], self.bracketed(self.end[self.chain(i, "place")])

    def place(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.flatnonzero(self.capitalized & self.has("place"))
        b, there = self.by(i, -1)
        after = there & ~self.capitalized[b] & self.has("preposition")[b] & (~self.common[i] | ~self.has("of")[b])
        after[after] = self.gaps_fit(i[after], "[ \\t\\xa0'’]+")
        i = i[after | (~self.common[i] & (~self.sentence[i] | self.all_caps[i]))]
        return self.start[i], self.bracketed(self.end[self.chain(i, "place")])

    def proper(self) -> tuple[np.ndarray, np.ndarray]:
        hit = self.capitalized & self.has("two") & ~self.has("acronym") & ~self.common
        i = np.flatnonzero(hit)
        b, there = self.by(i, -1)
        new = ~(self.blank[i] & there & hit[b])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(i) - 1]]) if len(i) else first
        return self.start[i[first]], self.end[i[last]]

    def labelled(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for _, e in self.labels("id"):
            s = (_COLON.match(self.joined, e, e + 80) or _RIGHT_AWAY.match(self.joined, e, e + 80)).end()
            if (n := _code(self.joined, s)) > 0:
                out.append((s, s + n))
        return _pairs(out)

    def dateline(self) -> tuple[np.ndarray, np.ndarray]:
        out, p = [], _pattern("dateline")
        head = np.flatnonzero(self.cls[:-1] & _LINE) + 1
        for s in head[self.cls[head] & (_LETTER | _BLANK) > 0].tolist():
            if (m := p.match(self.joined, s)):
                at = s + m[0].index(m[1])
                out.append((at, at + len(m[1])))
        return _pairs(out)

    def _digits(self) -> tuple[np.ndarray, np.ndarray]:
        start, end = _runs(self.cls & _DIGIT > 0)
        free = self.cls[start - 1] & _LETTER == 0
        return start[free], end[free]

    def long(self) -> tuple[np.ndarray, np.ndarray]:
        start, end = self._digits()
        return _pairs(_starts(_pattern("long"), self.joined, start[end - start >= 5].tolist()))

    def grouped(self) -> tuple[np.ndarray, np.ndarray]:
        start, end = self._digits()
        # two to four digits and, behind a blank or dot, more
        fits = (end - start >= 2) & (end - start <= 4) & (self.cls[end + 1] & _DIGIT > 0)
        found = _starts(_pattern("grouped"), self.joined, start[fits].tolist())
        return _pairs([(s, e) for s, e in found if len(_NO_DIGITS.sub("", self.joined[s:e])) >= 7])

    def mixed(self) -> tuple[np.ndarray, np.ndarray]:
        digit, capital = self.cls & _DIGIT > 0, self.cls & _CAPITAL > 0
        mine = digit | capital
        s, e = _runs(mine | (self.cls & _HYPHEN > 0))
        digits, capitals = (np.concatenate([[0], np.cumsum(x)]) for x in (digit, capital))
        fits = (digits[e] > digits[s]) & (capitals[e] > capitals[s])
        inside = np.zeros(len(self.cls) + 1, np.int8)
        inside[s[fits]], inside[e[fits]] = 1, -1
        i = np.flatnonzero((np.cumsum(inside)[:-1] > 0) & mine)
        found = _starts(_pattern("mixed"), self.joined, i[self.cls[i - 1] & (_LETTER | _DIGIT) == 0].tolist())
        return _pairs([(a, b) for a, b in found if b - a - self.joined.count("-", a, b) >= 5])


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _pairs(found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    got = np.array(found, np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


#: By detector: type, priority, source.
DETECTORS = {
    "labelled": ("IDENTIFIANT", C.LABELLED, "labelled"),
    "civility": ("PERSONNE", C.PERSON, "person"),
    "first": ("PERSONNE", C.PERSON, "person"),
    "label": ("PERSONNE", C.PERSON, "person_label"),
    "formula": ("LIEU", C.PLACE, "place_formula"),
    "dateline": ("LIEU", C.PLACE, "dateline"),
    "place": ("LIEU", C.PLACE, "place"),
    "long": ("IDENTIFIANT", C.STRICT, "long"),
    "grouped": ("IDENTIFIANT", C.STRICT, "grouped"),
    "mixed": ("IDENTIFIANT", C.STRICT, "mixed"),
    "proper": ("NOM_PROPRE", C.PROPER, "proper"),
}
BALANCED = ["labelled", "civility", "first", "label", "formula", "dateline", "place"]


def sliced(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Rows of about TOGETHER bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // TOGETHER
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def laid_out(column: pa.Array) -> tuple[list[str | None], np.ndarray, str]:
    """The texts, where each begins, and all of them in one string."""
    texts = column.to_pylist()
    length = np.array([len(t or "") + len(APART) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(length)])[:-1] + len(APART)
    return texts, begin, APART + APART.join(t or "" for t in texts) + APART


def candidates(column: pa.Array, rules: Sequence[Rule], names: Sequence[str], flags: Flags | None) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined texts, where each begins, and a row of start, end, kind, priority, source for each candidate."""
    texts, begin, joined = laid_out(column)
    rows = [np.array(rule_hits(column, texts, begin.tolist(), rules), np.int64).reshape(-1, 5)]
    if names:
        words = Words(joined, begin, flags)
        for n in names:
            kind, priority, source = DETECTORS[n]
            start, end = getattr(words, n)()
            rows.append(np.stack([start, end, *(np.full(len(start), x, np.int64) for x in (KINDS.index(kind), priority, C.AFTER_RULES[source]))], 1))
    return joined, begin, np.concatenate(rows)


def fits(words: DataFrame) -> bool:
    """Whether word lists are small enough to be sent to all tasks, as far as the optimizer knows."""
    return int(str(words._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= LISTS


def detect(docs: DataFrame, words: DataFrame, names: Sequence[str], rules: Sequence[Rule] = RULES, merge: bool = True, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, type, start, end, value of the given detectors and rules, merged (R2) or each by itself."""
    lists = docs.sparkSession.sparkContext.broadcast(_list_bits(words))
    rows = docs.select(id_col, F.col(text).alias("_t")).filter(F.col(id_col).isNotNull())
    names = list(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = Flags(lists.value)
        for whole in batches:
            for b in sliced(whole, 1):
                joined, begin, found = candidates(b.column(1), rules, names, flags)
                start, end, kind = merged(*found.T) if merge else found.T[:3]
                doc = np.searchsorted(begin, start, "right") - 1
                values = [joined[s:e] for s, e in zip(start.tolist(), end.tolist())]
                kinds = pa.array(KINDS, pa.string()).take(pa.array(kind, pa.int64()))
                at = begin[doc] if len(doc) else doc
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), kinds, pa.array(start - at, pa.int32()), pa.array(end - at, pa.int32()), pa.array(values, pa.string())], [id_col, "type", "start", "end", "value"])

    schema = T.StructType([rows.schema[0], T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType())])
    return rows.mapInArrow(run, schema)


_SEPARATORS, _EDGES, _WHITE = re.compile("[^A-Za-z0-9+]"), re.compile(f"^[{SPACE}]+|[{SPACE}]+\\Z"), re.compile(f"[{SPACE}]+")


def key_of(kind: str, value: str) -> str:
    """X12"""
    return _SEPARATORS.sub("", value).upper() if kind in COMPACT else _WHITE.sub(" ", _EDGES.sub("", value)).lower()


_SPANS = pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("key", pa.string())])


def rule_spans(rows: DataFrame, rules: Sequence[Rule], text: str) -> DataFrame:
    """rows with `spans`: type, start, end and key of what the rules find in each text, merged (R2); a table or a stream."""
    at, rules = rows.columns.index(text), list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in sliced(whole, at):
                joined, begin, found = candidates(b.column(at), rules, [], None)
                start, end, kind = merged(*found.T)
                doc = np.searchsorted(begin, start, "right") - 1
                kinds = [KINDS[k] for k in kind.tolist()]
                keys = [key_of(k, joined[s:e]) for k, s, e in zip(kinds, start.tolist(), end.tolist())]
                base = begin[doc] if len(doc) else doc
                each = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(start - base, pa.int32()), pa.array(end - base, pa.int32()), pa.array(keys, pa.string())], fields=list(_SPANS))
                cuts = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b.num_rows))])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), each)], [*b.schema.names, "spans"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("spans", T._parse_datatype_string("array<struct<type:string,start:int,end:int,key:string>>"))]))
