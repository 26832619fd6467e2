"""Tokenising whole texts with the tokenizers library and a bounded word cache.

Both public vocabularies split a text into pieces before the byte-pair merges
and never merge across a piece, so the ids of a text are the joined ids of its
parts as long as the cuts fall between pieces. Parts repeat far more often than
texts do: each worker keeps a bounded cache from part to packed ids and asks
the library for the parts it has not seen.

Cuts that fall between pieces:

* the vocabulary that drops white space: every ASCII space and line feed;
* the byte-level vocabulary: before a single space, and around a single line
  feed, whose neighbours are not white space.

Strings of special tokens in a text are ordinary text. Any other tokenizer
file is used without the cache."""

from __future__ import annotations

import os
import re
import struct

# letters that lower-case and normalise one by one, then plain punctuation:
# the library splits between the two groups
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#*$%&|()]*)")
_CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")

_LOADED: dict = {}


def _byte_chars() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others follow from U+0100 on, in ascending order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    table = {b: chr(b) for b in own}
    table.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return table


class PackedTokenizer:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes.

    ``cache_size`` bounds the number of cached parts (two generations)."""

    def __init__(self, path: str, cache_size: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(path)
        self.tk.encode_special_tokens = True
        self.model = self.tk.model
        self.half = max(1, cache_size // 2)
        self.young: dict = {}
        self.old: dict = {}
        self.map = _byte_chars()
        pre, norm = repr(self.tk.pre_tokenizer), self.tk.normalizer
        if norm is None and "use_regex=True" in pre and "add_prefix_space=False" in pre and "Split" not in pre:
            self.encode, self.lower = self._encode_spaced, False
        elif norm is not None and "Removed" in pre and "Lowercase" in repr(norm):
            self.encode, self.lower = self._encode_words, True
        else:
            self.encode = self._library

    def _library(self, text: str) -> bytes:
        ids = self.tk.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _merged(self, part: str) -> bytes:
        """Ids of one piece, given in the byte-level alphabet's plain form."""
        ids = [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.map))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _cached(self, key: str, make) -> bytes | None:
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is None and (got := make(key)) is None:
                return None
            if len(self.young) >= self.half:
                self.old, self.young = self.young, {}
            self.young[key] = got
        return got

    def _part(self, part: str) -> bytes:
        """Ids of a part (with its leading space, if it has one)."""
        lead, word = (" ", part[1:]) if part[:1] == " " else ("", part)
        m = _PLAIN.fullmatch(word)
        if not m:
            return self._library(part)
        core = m[1].lower() if self.lower else lead + m[1]
        out = self._cached(core, self._merged) if core != part else self._merged(core)
        return out + self._cached(m[2], self._merged) if m[2] else out

    def _lookup(self, parts: list[str]) -> bytes:
        young, old = self.young, self.old
        found = list(map(young.get, parts))
        if None in found:
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self._cached(parts[i], self._part)
        return b"".join(found)

    def _encode_words(self, text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        return self._lookup([p for p in parts if p] if "" in parts else parts)

    def _spaced(self, key: str) -> bytes | None:
        """Ids of a key's part. Keys: a word (its part has a space before it),
        ``\\0`` and a word (without that space), a line feed; ``\\n`` and any part
        of a text that is not split in words so. None for a word that is empty
        or has white space in it."""
        first = key[:1]
        part = " " + key if first not in ("\0", "\n", "") else key[1:] or key
        m = _PLAIN.fullmatch(part, 1 if part[:1] == " " else 0)
        if not m:
            return self._library(part) if first == "\n" or (key != "\0" and key.split() == [key]) else None
        if not m[2]:
            return self._merged(part)
        return self._cached(key[:-len(m[2])], self._spaced) + self._cached("\0" + m[2], self._spaced_marks)

    def _spaced_marks(self, key: str) -> bytes:
        return self._merged(key[1:])

    def _encode_spaced(self, text: str) -> bytes:
        if "\0" not in text:
            keys = ("\0" + text.replace("\n", " \n \0")).split(" ")
            found = list(map(self.young.get, keys))
            if None not in found:
                return b"".join(found)
            for i, x in enumerate(found):
                if x is None:
                    found[i] = x = self._cached(keys[i], self._spaced)
                    if x is None:
                        break
            else:
                return b"".join(found)
        # other white space than single spaces and line feeds within the text
        return b"".join([self._cached("\n" + p, self._spaced) for p in _CUT.split(text) if p])


def packed_tokenizer(path: str) -> PackedTokenizer:
    """One tokenizer and cache for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = PackedTokenizer(path)
    return _LOADED[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
