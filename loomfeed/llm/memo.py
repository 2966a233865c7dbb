"""Encoding texts word by word: a token sequence is the concatenation of its words' sequences, and words repeat.

A single space between two non-space characters always starts a token of the byte-level
patterns and a piece of the sentencepiece models used here, so a text can be cut there
and each part encoded once per worker. Texts where that is not certain go to the library whole.
"""

from __future__ import annotations


class Unsafe(Exception):
    """This part must be encoded together with its neighbours."""


class Memo(dict):
    """part -> encoded value, filled on demand, emptied when it holds `bound` parts."""

    def __init__(self, encode, bound: int = 400_000, longest: int = 64):
        super().__init__()
        self.encode, self.bound, self.longest = encode, bound, longest

    def __missing__(self, part: str):
        if not part or part[0].isspace() or part[-1].isspace():
            raise Unsafe
        value = self.encode(part)
        if len(part) <= self.longest:
            if len(self) >= self.bound:
                self.clear()
            self[part] = value
        return value


class Recent(dict):
    """key -> made value; when it holds `bound` keys they become the older ones, from which those asked for again come back."""

    def __init__(self, make, bound: int, longest: int = 64):
        super().__init__()
        self.make, self.bound, self.longest, self.older = make, bound, longest, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.bound:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
