"""Token counts by the whole-token shortcut.

A byte-level BPE tokenizer first cuts a text into pre-tokens, and each pre-token is encoded by itself.  So a
pre-token that is a string of the vocabulary counts one token wherever it stands, if that string encodes alone
as one token.  `prove` finds out for which strings of the vocabulary this holds, with the tokenizer's own
merges, before any text is read; a text's count is then a sum of look-ups over its pre-tokens, and only the
pre-tokens that are no such string are merged.

Pre-tokens are cut by the tokenizer's pattern with the `regex` module.  Its ideas of letters, numbers and white
space may be those of another Unicode version than the library's, so each distinct character is checked against
the library once; texts with a character on which they differ are counted by the library as a whole.

Null texts are empty and count 0.  Rows are independent: null or repeated ids and extra columns change nothing.
Strings of special tokens within a text are one token each, which is the library's default.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the ByteLevel pre-tokenizer cuts a text (fixed value: it must equal the library's).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that are cut at once; longer texts are taken in pieces between a word and the next.
PIECE = 1 << 20
#: Merged pre-tokens that a worker remembers, and their longest length.
KEEP, SHORT = 1_000_000, 64
_COUNTERS: dict[str, "TokenCounter"] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest in order from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def prove(tokenizer) -> dict[str, int]:  # noqa: ANN001
    """Strings of the vocabulary (as text) that encode alone as one token.

    A string that is no whole UTF-8 text can be no pre-token's text and is left out.
    """
    model, back = tokenizer.model, {c: b for b, c in enumerate(byte_letters())}
    out: dict[str, int] = {}
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        if any(c not in back for c in entry):
            continue
        try:
            text = bytes(back[c] for c in entry).decode()
        except UnicodeDecodeError:
            continue
        if len(model.tokenize(entry)) == 1:
            out[text] = 1
    return out


class _Merged(dict):
    """Tokens of pre-tokens: the proven ones from the start, others merged when they are first met."""

    def __init__(self, proven: dict[str, int], tokenizer) -> None:  # noqa: ANN001
        super().__init__(proven)
        self.proven, self.model, self.letters = proven, tokenizer.model, dict(enumerate(byte_letters()))

    def __missing__(self, pre: str) -> int:
        n = len(self.model.tokenize(pre.encode().decode("latin-1").translate(self.letters)))
        if len(pre) <= SHORT:
            self[pre] = n
        return n

    def trim(self) -> None:
        if len(self) > len(self.proven) + KEEP:
            self.clear()
            self.update(self.proven)


class TokenCounter:
    """Counts the tokens of texts for one tokenizer file (byte-level BPE without a normalizer)."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or spec["model"].get("dropout"):
            raise ValueError(f"{path} is no byte-level BPE that cuts its texts by the usual pattern")
        odd = [t["content"] for t in spec.get("added_tokens", []) if t["single_word"] or t["lstrip"] or t["rstrip"]]
        if odd:
            raise ValueError(f"{path}: added tokens that take what stands beside them: {odd}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut = regex.compile(PATTERN).findall
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.specials, self.special = added, regex.compile("|".join(map(regex.escape, added))) if added else None
        self.kinds = [regex.compile(p).match for p in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]")]
        self.seams = regex.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
        self.alike: set[str] = set()
        self.unlike: set[str] = set()
        self.tokens = _Merged(prove(self.tokenizer), self.tokenizer)
        self.check(set(map(chr, range(128))))

    @classmethod
    def of(cls, path: str) -> TokenCounter:
        """One for each worker process."""
        if path not in _COUNTERS:
            _COUNTERS[path] = cls(path)
        return _COUNTERS[path]

    def check(self, characters: set[str]) -> None:
        """Finds the characters that the library and the pattern put into different classes.

        A character goes on with what stands before it if both are letters, numbers or other signs.
        """
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for c in characters:
            theirs = [len(cut(first + c)) == 1 for first in "a1!"]
            (self.alike if theirs == [bool(k(c)) for k in self.kinds] else self.unlike).add(c)

    def pieces(self, text: str) -> Iterator[str]:
        """A long text in pieces between a letter and the space before the next, where every cut of the pattern falls."""
        at = 0
        while len(text) - at > PIECE:
            seam = self.seams.search(text, at + PIECE)
            if seam is None:
                break
            yield text[at : seam.start()]
            at = seam.start()
        yield text[at:] if at else text

    def __call__(self, text: str) -> tuple[int, int]:
        """Tokens, and the pre-tokens they come from."""
        if not text.isascii() and (new := set(text) - self.alike):
            self.check(new - self.unlike)
            if not self.unlike.isdisjoint(new):
                return self.plain(text), 0
        tokens = pre = 0
        if self.special is not None and any(s in text for s in self.specials):
            marks = len(self.special.findall(text))
            parts, tokens, pre = self.special.split(text), marks, marks
        else:
            parts = [text]
        count = self.tokens.__getitem__
        for part in parts:
            for piece in self.pieces(part):
                found = self.cut(piece)
                tokens += sum(map(count, found))
                pre += len(found)
        self.tokens.trim()
        return tokens, pre

    def plain(self, text: str) -> int:
        """The library's own count."""
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens), n_pretokens of every row of docs (0 pre-tokens: counted by the library as a whole)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter.of(tokenizer)
        for b in batches:
            tokens, pre = [], []
            for x in b.column(2):
                n, m = counter(x.as_py() or "")
                tokens.append(n)
                pre.append(m)
            n = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n, pa.array(pre, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "n_pretokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    out = rows.mapInArrow(count, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, n_tokens long, n_pretokens long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_pretokens")
