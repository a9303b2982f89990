"""Scalar functions on text as Columns: keys, validators, names of files."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's \s has it, for Java character classes.
SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def _decomposed() -> tuple[str, str]:
    """Latin letters with marks, up to U+024F and U+1E00-1EFF, and their bare letters, from the Unicode rule."""
    marked, bare = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.category(c).startswith("M"))
        if len(plain) == 1 and plain != chr(code):
            marked.append(chr(code))
            bare.append(plain)
    return "".join(marked), "".join(bare)


MARKED, BARE = _decomposed()


def normalize_key(value: Column) -> Column:
    """Without accents, curly quotes straight, lower case."""
    return F.lower(F.translate(F.regexp_replace(value, "\\p{M}", ""), MARKED + "’‘", BARE + "''"))


def capitalized(word: Column) -> Column:
    """X3"""
    return word.rlike("^\\p{Lu}")


def all_caps(word: Column) -> Column:
    """X4"""
    return (F.length(word) >= 2) & ~word.rlike("\\p{Ll}")


def _compact(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, f"[{SPACE}]", ""))


def is_valid_iban(raw: Column) -> Column:
    """ISO 7064 check of the rearranged number, digit by digit, as 68 digits fit no integer type."""
    iban = _compact(raw)
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    code = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.expr("0") + F.coalesce(c.try_cast("int"), F.lit(0)))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(F.pmod(acc * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + code(c), F.lit(97)).cast("int")))
    return iban.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\\z") & (rest == 1)


def is_valid_nir(raw: Column) -> Column:
    """Two-digit key of a 15-character social number; the Corsican 2A and 2B count as 19 and 18."""
    nir = _compact(raw)
    body = F.replace(F.replace(F.substring(nir, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    return nir.rlike("^[12][0-9]{4}(?:[0-9]{2}|2A|2B)[0-9]{8}\\z") & (97 - body.try_cast("long") % 97 == F.substring(nir, 14, 2).try_cast("long"))


def is_valid_card(raw: Column) -> Column:
    """X11: 13 to 19 digits that pass Luhn's check."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def label_key(kind: Column, value: Column) -> Column:
    """What makes two values of a type one."""
    from quillspan.types import COMPACT

    spaced = F.lower(F.regexp_replace(F.regexp_replace(value, f"^[{SPACE}]+|[{SPACE}]+\\z", ""), f"[{SPACE}]+", " "))
    return F.when(kind.isin(COMPACT), F.upper(F.regexp_replace(value, "[^A-Za-z0-9+]", ""))).otherwise(spaced)


def _decode(value: Column, names: dict[str, str]) -> Column:
    """One pass: the text is cut before each reference, and each piece decodes the one it begins with."""
    pattern = "&(#x[0-9a-fA-F]+|#[0-9]+|" + "|".join(names) + ");"
    pieces = F.split(value, f"(?i)(?={pattern})", -1)

    def one(piece: Column) -> Column:
        ref = F.regexp_extract(piece, f"(?i)^{pattern}", 1)
        number = F.when(F.lower(ref).startswith("#x"), F.conv(F.substr(ref, F.lit(3)), 16, 10)).otherwise(F.substr(ref, F.lit(2))).try_cast("int")
        out = F.when(ref.startswith("#"), F.decode(F.encode(_code_point(number), "UTF-16BE"), "UTF-16BE"))
        for name, char in names.items():
            out = out.when(F.lower(ref) == name, F.lit(char))
        return F.when(ref == "", piece).otherwise(F.concat(out, F.substr(piece, F.length(ref) + 3)))

    return F.when(value.isNotNull(), F.array_join(F.transform(pieces, one), ""))


def _code_point(n: Column) -> Column:
    """The character of a code point, through its UTF-16 code units."""
    unit = lambda u: F.unhex(F.lpad(F.hex(u.cast("int")), 4, "0"))
    high, low = F.floor((n - 0x10000) / 0x400) + 0xD800, (n - 0x10000) % 0x400 + 0xDC00
    return F.decode(F.when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low))), "UTF-16BE")


XML_NAMES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
HTML_NAMES = {**XML_NAMES, "nbsp": " "}


def decode_xml(value: Column) -> Column:
    """X13"""
    return _decode(value, XML_NAMES)


def decode_html(value: Column) -> Column:
    """Unknown names stay as they are."""
    return _decode(value, HTML_NAMES)


def encode_xml(value: Column) -> Column:
    return F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _last_dot(name: Column) -> Column:
    """Place of the last dot from 0; -1: none."""
    back = F.instr(F.reverse(name), ".")
    return F.when(back == 0, -1).otherwise(F.length(name) - back)


def filtered_name(original: Column, extension: Column | None = None) -> Column:
    """X15"""
    dot = _last_dot(original)
    base = F.when(dot <= 0, F.when(original == "", "texte").otherwise(original)).otherwise(F.substr(original, F.lit(1), dot))
    own = F.when(dot <= 0, ".txt").otherwise(F.substr(original, dot + 1))
    return F.concat(base, F.lit("_prv"), own if extension is None else F.coalesce(extension, own))


def base_name(name: Column) -> Column:
    """X16"""
    dot = _last_dot(name)
    base = F.when(dot > 0, F.substr(name, F.lit(1), dot)).otherwise(name)
    return F.when(base == "", "document").otherwise(base)


def extension_of(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "(?s)^.*\\.", ""))


def output_name(name: Column, kind: Column, label: Column | None = None) -> Column:
    """Names of what is made of a file: merge, pages, part (with its label), parts, docx, pdf."""
    end = F.when(kind == "merge", "_fusion.pdf").when(kind == "pages", "_pages.pdf").when(kind == "parts", "_decoupe.zip").when(kind == "docx", ".docx").when(kind == "pdf", ".pdf")
    if label is not None:
        end = F.when(kind == "part", F.concat(F.lit("_"), label, F.lit(".pdf"))).otherwise(end)
    return F.concat(base_name(name), end)


def fill(template: Column, values: dict[str, Column]) -> Column:
    """{name} becomes its value, in one pass; unknown names stay."""
    pieces = F.split(template, "(?=\\{[A-Za-z0-9_]+\\})", -1)

    def one(piece: Column) -> Column:
        key = F.regexp_extract(piece, "^\\{([A-Za-z0-9_]+)\\}", 1)
        out = F.when(key == "", piece)
        for name, value in values.items():
            out = out.when(key == name, F.concat(value.cast("string"), F.substr(piece, F.length(key) + 3)))
        return out.otherwise(piece)

    return F.array_join(F.transform(pieces, one), "")


def is_pdf(name: Column, mime: Column, content: Column) -> Column:
    """By extension, by type, or by the first kilobyte."""
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    return (extension_of(name) == "pdf") | F.coalesce(mime == "application/pdf", F.lit(False)) | F.coalesce(F.instr(head, "%PDF-") > 0, F.lit(False))


def route(name: Column, mime: Column, content: Column) -> Column:
    """Txt, docx or pdf; null: not supported."""
    ext = extension_of(name)
    return F.when(ext == "txt", "txt").when(ext == "docx", "docx").when(is_pdf(name, mime, content), "pdf")


def is_blank(text: Column) -> Column:
    """Nothing but white space, as the text of a scanned page is."""
    return ~text.rlike(f"[^{SPACE}]")
