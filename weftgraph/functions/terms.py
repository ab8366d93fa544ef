"""All terms of a taxonomy looked up in one pass over a text, whatever their number.

Literal terms are the keys of one Aho-Corasick automaton over the text in lower case with single blanks. What it finds is held against
word edges; then each entry's finds are counted as one alternation of its terms would count them: from the left, without
overlaps, at one place the first term of the list. Entries with a pattern of their own (`re:`) are searched by expression, and where
the pattern needs some literal to be there, only in texts that hold it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from re import _parser as syntax

import ahocorasick

PATTERN = "re:"
_BLANKS = re.compile(r"\s+")
_LEAST_NEEDLE = 3


class _Folding(dict):
    """Code point to its one spelling without case, of one character."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        upper = char.upper()
        found = self[code] = (upper if len(upper) == 1 else char).lower()[:1]
        return found


_folding = _Folding()


def folded(text: str) -> str:
    """Without case, character by character, and with a single blank for any white space."""
    return _BLANKS.sub(" ", text.lower() if text.isascii() else text.translate(_folding))


def term_pattern(terms: list[str]) -> str:
    """The alternation of the terms. A final `*` leaves the last word open."""
    made = []
    for term in terms:
        if term.startswith(PATTERN):
            made.append(f"(?:{term[len(PATTERN) :]})")
        else:
            words = r"\s+".join(map(re.escape, term.rstrip("*").split()))
            made.append(r"(?<!\w)" + words + (r"\w*" if term.endswith("*") else r"(?!\w)"))
    return "|".join(made)


def needle(pattern: str) -> str | None:
    """The longest literal that every match of the pattern holds, if it has one of some length."""
    best, run = "", ""
    for op, value in syntax.parse(pattern):
        run = run + chr(value) if op is syntax.LITERAL else ""
        best = max(best, run, key=len)
    return folded(best) if len(best) >= _LEAST_NEEDLE and " " not in folded(best) else None


def _word(char: str) -> bool:
    return char.isalnum() or char == "_"


class Terms:
    """Lists of terms, each called by its place."""

    def __init__(self, entries: list[list[str]]):
        self.expressions = {}
        known: dict[str, list[tuple[int, int, bool]]] = defaultdict(list)
        for entry, terms in enumerate(entries):
            if any(t.startswith(PATTERN) for t in terms):
                needles = [needle(t[len(PATTERN) :]) if t.startswith(PATTERN) else folded(" ".join(t.rstrip("*").split())) for t in terms]
                self.expressions[entry] = re.compile(term_pattern(terms), re.IGNORECASE), None if None in needles else needles
                continue
            for order, term in enumerate(terms):
                known[folded(" ".join(term.rstrip("*").split()))].append((entry, order, term.endswith("*")))
        self.automaton = None
        if known:
            self.automaton = ahocorasick.Automaton()
            for key, value in known.items():
                self.automaton.add_word(key, (len(key), value))
            self.automaton.make_automaton()

    def finds(self, text: str) -> dict[int, list[tuple[int, int, int]]]:
        """For each literal entry its finds (start, order of the term, end), overlaps included."""
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        if self.automaton is None or not text:
            return found
        plain = folded(text)
        for last, (size, value) in self.automaton.iter(plain):
            start, end = last + 1 - size, last + 1
            if start and _word(plain[start - 1]):
                continue
            inside = end < len(plain) and _word(plain[end])
            for entry, order, is_open in value:
                if not inside:
                    found[entry].append((start, order, end))
                elif is_open:
                    stop = end
                    while stop < len(plain) and _word(plain[stop]):
                        stop += 1
                    found[entry].append((start, order, stop))
        return found

    def _searched(self, text: str) -> list[int]:
        """Entries with expressions whose literals the text holds."""
        plain = folded(text) if any(needles for _, needles in self.expressions.values()) else ""
        return [k for k, (_, needles) in self.expressions.items() if needles is None or any(n in plain for n in needles)]

    def counts(self, text: str) -> dict[int, int]:
        """How often each entry occurs; entries that don't are absent."""
        out = {}
        for entry, found in self.finds(text).items():
            free = n = 0
            for start, _, end in sorted(found):
                if start >= free:
                    free, n = end, n + 1
            out[entry] = n
        for entry in self._searched(text) if text else ():
            if n := sum(1 for _ in self.expressions[entry][0].finditer(text)):
                out[entry] = n
        return out
