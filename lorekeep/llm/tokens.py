"""Encoding whole texts with a public tokenizer file, a repeated piece only once.

Tokens of both vocabularies never cross from a visible character into white space, so a text's ids
are those of its pieces (white space and the word behind it) in turn; plain Latin text is cut further,
into the words of the vocabulary's own pattern. A worker keeps the ids of parts in a dictionary of
bounded size; what is new goes to the tokenizers library.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from array import array
from collections.abc import Callable

#: Unicode white space, as the tokenizers' \s has it.
WHITE = "\t-\r \x85\xa0  -     　"
_PIECE = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Plain Latin text: its letters are letters in every Unicode version, and none of them combine.
_LATIN = re.compile("[\x00-\x7f\xa1-ɏ]*")
_LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
_OTHERS = f"[^{WHITE}{_LETTERS}{_NUMBERS}]+"
#: How the two kinds of vocabulary part plain Latin text.
_PARTS = {
    "bytes": re.compile(f"{_SUFFIXES}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?{_OTHERS}|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"),
    "words": re.compile(f"{_SUFFIXES}|[{_LETTERS}]+|[{_NUMBERS}]|{_OTHERS}"),
}
#: Byte-level vocabularies spell a byte that prints as itself, and the others in turn from U+0100 on.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELLING = {b: chr(b) for b in _PRINTS} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}
#: Bytes that a worker's dictionary of remembered parts may take in all, with about ENTRY_BYTES for each beside its own.
CACHE_BYTES = 160 << 20
ENTRY_BYTES = 170


class PieceEncoder:
    """ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._kind = "words" if self._tokenizer.normalizer is not None else "bytes"
        self._parts = _PARTS[self._kind]
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._model = self._tokenizer.model
        self._known = Remembered(self._merge, cache_bytes)

    def _cut(self, text: str) -> tuple[list[str], bool]:
        """The parts of a text, and whether each is one word of the vocabulary's pattern."""
        if not (text.isascii() or _LATIN.fullmatch(text)) or any(s in text for s in self._special):
            return _PIECE.findall(text), False
        if self._kind == "words":  # as the vocabulary's normaliser does
            text = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower()
        return self._parts.findall(text), True

    def _merge(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        spelled = word.replace(" ", _SPELLING[0x20]) if plain else word.encode().decode("latin-1").translate(_SPELLING)
        return array("I", [t.id for t in self._model.tokenize(spelled)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        self._known.age()
        known = self._known.now
        out, left = [], []
        for text in texts:
            parts, single = self._cut(text)
            if single:
                out.append(b"".join(map(known.__getitem__, parts)))  # new words are merged as they are met
            else:
                left.append((len(out), parts, list(map(known.get, parts))))
                out.append(b"")
        gaps = [_places_of_none(g) for _, _, g in left]
        new = self._known.missing({parts[i] for (_, parts, _), gap in zip(left, gaps, strict=True) for i in gap})
        if new:
            found = self._tokenizer.encode_batch_fast(new, add_special_tokens=False)
            self._known.add({p: struct.pack(f"<{len(f.ids)}I", *f.ids) for p, f in zip(new, found, strict=True)})
        for (k, parts, g), gap in zip(left, gaps, strict=True):
            for i in gap:
                g[i] = known[parts[i]]
            out[k] = b"".join(g)
        return out


def _places_of_none(found: list) -> list[int]:
    """Where a list holds None; the search itself is the list's own."""
    at, i = [], -1
    try:
        while True:
            i = found.index(None, i + 1)
            at.append(i)
    except ValueError:
        return at


class Remembered:
    """A dictionary of what was added or asked for last, `most` bytes large at most between two texts.

    make: what `now` calls for a key that it is asked for by [] and that neither half holds.
    """

    def __init__(self, make: Callable | None = None, most: int = CACHE_BYTES) -> None:
        self._make, self._most = make, most
        self.now: dict = _Now(self)
        self._past: dict = {}
        self._size = 0

    def age(self) -> None:
        if self._size > self._most // 2:
            self._past, self.now, self._size = dict(self.now), _Now(self), 0

    def made(self, key: object) -> bytes:
        found = self._past.get(key)
        if found is None:
            if self._make is None:
                raise KeyError(key)
            found = self._make(key)
        self.now[key] = found
        self._size += len(key) + len(found) + ENTRY_BYTES
        return found

    def add(self, entries: dict) -> None:
        self.now.update(entries)
        self._size += sum(len(k) + len(v) + ENTRY_BYTES for k, v in entries.items())

    def missing(self, keys: set) -> list:
        """The keys that neither half holds; those of the older half move to the newer one."""
        past, now = self._past, self.now
        self.add({k: past[k] for k in keys if k in past})
        return [k for k in keys if k not in now]


class _Now(dict):
    """The newer half, which makes what it doesn't hold."""

    def __init__(self, owner: Remembered) -> None:
        self._owner = owner

    def __missing__(self, key: object) -> bytes:
        return self._owner.made(key)


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; it stays for the worker's next tasks, until forget() is called."""
    if (path, cache_bytes) not in _ENCODERS:
        _ENCODERS[path, cache_bytes] = PieceEncoder(path, cache_bytes)
    return _ENCODERS[path, cache_bytes]


def forget() -> None:
    """Give the encoders' memory back: called where a worker turns to work without a tokenizer."""
    _ENCODERS.clear()
