"""Splitting text as word-level BPE vocabularies do, and memos of bounded size."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import regex

#: White space to Python but not to the vocabulary's rules.
_CONTROL = re.compile("[\x1c-\x1f]")
#: Up to here letters are known one by one; beyond, normal forms and lower case take the slow way.
_LATIN = range(0x250)
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


class Memo(dict):
    """Remembers results in two generations, so that a full memo forgets only what was not used lately."""

    def __init__(self, compute: Callable, entries: int, longest: int = 48):
        super().__init__()
        self.compute, self.entries, self.longest, self.old = compute, entries // 2, longest, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def latin_pattern(pattern: str) -> Callable[[str], list[str]] | None:
    """The pattern's ``findall`` with its letter and number classes spelt out for Latin text, if that is all it needs."""
    spelt = lambda kind: "".join(re.escape(chr(c)) for c in _LATIN if unicodedata.category(chr(c))[0] == kind)
    plain = pattern.replace(r"\p{L}", spelt("L")).replace(r"\p{N}", spelt("N"))
    return None if r"\p" in plain else re.compile(plain).findall


class WordSplitter:
    """Combines the results of a text's words; each word is computed once while the memo holds it."""

    def __init__(self, pattern: str, special: list[str], word: Callable[[bytes], object], join: Callable, entries: int = 240_000):
        self.find = regex.compile(pattern).findall
        self.quick = latin_pattern(pattern) or self.find
        self.special = special
        self.join = join
        self.words = Memo(lambda w: word(w.encode("utf-8")), entries)

    def simple(self, text: str) -> bool:
        """Whether lower case, normal form and white space are the same to Python and to the vocabulary's rules."""
        return not (_BEYOND_LATIN.search(text) or _CONTROL.search(text) or any(s in text for s in self.special))

    def plain(self, text: str):
        return self.join(map(self.words.__getitem__, self.quick(text.lower())))

    def normalised(self, text: str):
        """For any text without special strings: NFC, then lower case letter by letter."""
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return self.join(map(self.words.__getitem__, self.find(text)))
