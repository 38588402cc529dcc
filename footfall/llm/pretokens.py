"""Splitting texts into the pieces that byte-level BPE merges separately."""

from __future__ import annotations

import regex

#: Characters with the Unicode property White_Space (fixed values).
SPACES = r"\t-\r \x85\xa0  -     　"


class CutUnsafe(Exception):
    """A space that is not between two characters that are no white space."""


def splitter(pattern: str):
    """All matches of a pre-token pattern in a text; ``\\s`` means White_Space."""
    exact = pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"\S", f"[^{SPACES}]")
    return regex.compile(exact.replace(r"\s", f"[{SPACES}]")).findall


class Words(dict):
    """Remembers a value for each word that follows a single space.

    A space between two characters that are no white space always starts a pre-token,
    so what lies between two such spaces can be worked out on its own.  Any other
    space raises CutUnsafe.  The number of words remembered is bounded.
    """

    def __init__(self, value, limit: int):
        self.value, self.limit = value, limit

    def __missing__(self, word: str):
        if not word or word[0].isspace() or word[-1].isspace():
            raise CutUnsafe
        found = self.value(" " + word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = found
        return found
