"""Ways to write the ``find`` of a rule."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from enum import Enum

import regex

from sparkscour.functions.patterns import js
from sparkscour.operators.page import Page
from sparkscour.plans.rules import DELETE, Match


class Verdict(Enum):
    """What a fix returns for a match that is none after all."""

    LEAVE = 0


LEAVE = Verdict.LEAVE
Fix = str | None | Callable[[regex.Match, Page], object]
Told = str | None | Callable[[regex.Match, Page], str | None]


class Needed:
    """Phrases, and whether a text has the words of one of them."""

    def __init__(self, phrases: Iterable[str]):
        parts = [frozenset(re.findall("[a-z]+", x.lower())) for x in phrases]
        self.single = frozenset(x for part in parts if len(part) == 1 for x in part)
        self.several = [part for part in parts if len(part) > 1]
        self.none = not parts

    def may_be(self, page: Page) -> bool:
        return self.none or not self.single.isdisjoint(page.words) or any(part <= page.words for part in self.several)


def every(pattern: str, fix: Fix, flags: str = "", suggest: Iterable[str] | Callable[[regex.Match, Page], Iterable[str]] = (), note: Told = None, needs: str | tuple[str, ...] = "", words: Iterable[str] = ()) -> Callable[[Page], Iterable[Match]]:
    """All matches of a pattern. ``fix``: a text, None (ask), or a function that gives either, or LEAVE. ``needs``: strings
    (or the characters of one) of which a text with a match has at least one; looking for them is cheap. ``words``: phrases
    of which a text with a match has all words of at least one, in any case."""
    needed = Needed(words)

    def find(page: Page) -> Iterable[Match]:
        if needs and not any(c in page.text for c in needs) or not needed.may_be(page):
            return
        for m in js(pattern, flags).finditer(page.text):
            if m.end() == m.start():
                continue
            repl = fix(m, page) if callable(fix) else fix
            if repl is LEAVE:
                continue
            offered = () if repl is not None else suggest(m, page) if callable(suggest) else suggest
            yield Match(m.start(), m.end(), repl, tuple(offered), note(m, page) if callable(note) else note)

    return find


def ask(pattern: str, flags: str = "", suggest: Iterable[str] | Callable[[regex.Match, Page], Iterable[str]] = (DELETE,), note: Told = None, needs: str | tuple[str, ...] = "", words: Iterable[str] = ()) -> Callable[[Page], Iterable[Match]]:
    """Matches for a reader to judge."""
    return every(pattern, None, flags, suggest, note, needs, words)


def match_case(orig: str, word: str) -> str:
    """``word`` in the case of ``orig``: all capitals, a first capital, or as it is. Remarks in brackets stay."""
    if not word or word[0] == "(":
        return word
    if len(orig) > 1 and orig == orig.upper() and js("[A-Z]").search(orig):
        return word.upper()
    return word[0].upper() + word[1:] if "A" <= orig[:1] <= "Z" else word
