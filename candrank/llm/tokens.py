"""Token ids of whole texts with public vocabularies, quickly where words come again.

A text is cut where no match of the vocabulary's pattern can reach across, so equal pieces
always have equal ids and need to be encoded once.
"""

from __future__ import annotations

import base64
import os
import re
from unicodedata import category

import numpy as np

#: Pieces a worker remembers; beyond that it starts again, with the same ids.
REMEMBERED = 600_000

#: Words of ASCII and Latin-1 letters, whose lower case and normal form need no tables.
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+\Z")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_names() -> dict[int, str]:
    """The printable stand-in of each byte: itself if printable, else the next from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Memory(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[key] = self.make(key)
        return found


class WordPieces:
    """Ids of the word BPE, as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(vocabulary)
        # The strings of special tokens are ordinary text.
        self._whole.encode_special_tokens = True
        self._model = self._whole.model
        self._names = _byte_names()
        self._words = _Memory(self._word)
        self._parts = _Memory(self._part)

    def _part(self, part: str) -> bytes:
        named = part.encode().decode("latin-1").translate(self._names)
        return np.array([t.id for t in self._model.tokenize(named)], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word:
            return b""
        if _PLAIN.match(word):
            return b"".join(map(self._parts.__getitem__, _PARTS.findall(word.lower())))
        return np.array(self._whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        # White space separates words for this vocabulary; other kinds than these two are
        # left to the tokenizer.
        return b"".join(map(self._words.__getitem__, text.replace("\n", " ").split(" ")))


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def rank_encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding(
        "public", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={}
    )


#: White space other than a space or a line feed.
_OTHER_SPACE = re.compile(
    "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
#: A space between two characters that are not white space: no match reaches across it.
_BORDER = re.compile(r"(?<=\S)(?= \S)")


def spans(text: str) -> list[str]:
    """The text cut before each single space between words; joined, they are the text."""
    if not text:
        return []
    if (
        "  " in text
        or " \n" in text
        or "\n " in text
        or text[0] == " "
        or text[-1] == " "
        or _OTHER_SPACE.search(text)
    ):
        return _BORDER.split(text)
    first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)]


#: Characters of which every reading of the pattern's classes is the same.
_SURE = re.compile(r"[\n\x20-\x7eÀ-ÖØ-öø-ÿ]*\Z")
#: Controls and spaces that some readings count as white space, and the long s, an s without case.
_UNSURE = re.compile("[\x00-\x09\x0b-\x1f\x7f-\xa0\u017f\u180e\u2028\u2029]")


_MARKS = frozenset(".,;:!?")


def pre_tokens(find, span: str) -> list[str]:
    """The matches in a span of any script.

    A span stays whole for the encoder where it has a character whose class readings of the
    pattern could differ in: one that is not assigned yet, or one of ``_UNSURE``.
    """
    # Most are a word, or a word and a mark; letters are of one class to every reading.
    word = span[1:] if span[:1] == " " else span
    if word.isalpha():
        return [span]
    if word[-1:] in _MARKS and word[:-1].isalpha():
        return [span[:-1], span[-1]]
    if _SURE.match(span):
        return find(span)
    if _UNSURE.search(span) or any(category(c) in ("Cn", "Cs") for c in set(span)):
        return [span]
    return find(span)
