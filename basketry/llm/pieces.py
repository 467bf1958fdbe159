"""Whole texts to codes through remembered parts and words.

Byte-level vocabularies split a text into words by a pattern and encode each
word alone.  A single space between two characters that are not white space
always begins a new match of the pattern, so a text may be cut there and most
of its parts need not be matched again: the codes of parts and words seen
before come from dictionaries.  These take no more entries once they are full,
which bounds their memory; what they lack is encoded each time.
"""

from __future__ import annotations

import re
from collections.abc import Callable

CUT = re.compile(r"(?<=\S) (?=\S)")
STOPS = tuple(".,;:!?")
LONG = 64  # longer parts and words are not remembered


def _clean(part: str) -> bool:
    return bool(part) and not part[0].isspace() and not part[-1].isspace()


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """Matches of the byte-level ``pattern``; letters with at most one stop after them need no matching."""
    import regex
    match = regex.compile(pattern).findall

    def words(part: str) -> list[str]:
        body = part[1:] if part[:1] == " " else part
        if body.isalpha():
            return [part]
        if body[-1:] in STOPS and body[:-1].isalpha():
            return [part[:-1], body[-1]]
        return match(part)
    return words


class PieceCodes:
    """``words(text)`` splits a text; ``encode(words)`` gives the codes (bytes) of distinct words."""

    def __init__(self, words: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]],
                 parts_limit: int = 300_000, words_limit: int = 400_000):
        self.words, self.encode = words, encode
        self.parts_limit, self.words_limit = parts_limit, words_limit
        self.parts: dict[str, bytes] = {}
        self.seen: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        get, cut, new, firsts = self.parts.get, [], set(), set()
        for text in texts:
            parts = text.split(" ")
            got = list(map(get, parts))
            got[0] = b""  # the first part has no space before it
            odd = not parts[0] or parts[0][-1].isspace()
            if odd or None in got:
                lacking = [p for p, g in zip(parts, got) if g is None]
                if odd or "" in lacking or list(map(str.strip, lacking)) != lacking:
                    parts = CUT.split(text)
                    lacking = parts[1:]
                    got = [b""] + [None] * len(lacking)
                new.update(lacking)
            firsts.add(parts[0])
            cut.append((parts, got))
        first, rest = self._codes(firsts, new)
        out = []
        for parts, got in cut:
            if None in got:
                got = [rest[p] if g is None else g for p, g in zip(parts, got)]
            got[0] = first[parts[0]]
            out.append(b"".join(got))
        return out

    def _codes(self, firsts: set[str], rest: set[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Codes of parts that begin a text, and of parts with a space before them."""
        parts, seen, words = self.parts, self.seen, self.words
        split, known, letters = {}, {}, []
        for p in rest:
            if p.isalpha():
                letters.append(p)
            elif p[-1:] in STOPS and (c := parts.get(p[:-1])) is not None and p[:-1].isalpha():
                known[p] = c, p[-1]  # a remembered word and a stop
            else:
                split[p] = words(" " + p)
        begins = {p: words(p) for p in firsts}
        whole = [" " + p for p in letters]
        lacking = set(whole).union(STOPS, *split.values(), *begins.values()).difference(seen)
        lacking = list(lacking)
        fresh = dict(zip(lacking, self.encode(lacking)))
        out = {p: fresh[w] if w in fresh else seen[w] for p, w in zip(letters, whole)}
        for coded, group in ((out, split), (first := {}, begins)):
            for p, found in group.items():
                coded[p] = b"".join([fresh[w] if w in fresh else seen[w] for w in found])
        stops = {w: fresh[w] if w in fresh else seen[w] for w in STOPS}
        room = self.words_limit - len(seen)
        if room > 0:
            seen.update([(w, c) for w, c in fresh.items() if len(w) < LONG][:room])
        room = self.parts_limit - len(parts)
        if room > 0:
            parts.update([(p, c) for p, c in out.items() if len(p) < LONG and _clean(p)][:room])
        out.update((p, c + stops[w]) for p, (c, w) in known.items())
        return first, out
