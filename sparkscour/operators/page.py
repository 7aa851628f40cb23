"""One text as the rules see it."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import cached_property

from sparkscour.functions.patterns import js
from sparkscour.operators.spans import Cover, Region, Wording, fences, markdown_regions, regions
from sparkscour.plans.rules import Config


_LETTERS = re.compile("[a-z]+")


class Page:
    def __init__(self, text: str, config: Config, protected: Iterable[str], plain: bool = False, hidden: Iterable[Region] = ()):
        self.text, self.config = text, config
        self.kind = config.file_type
        self.output = "txt" if plain else self.kind
        self.regions = [*regions(text, self.kind), *hidden]
        self._protected = frozenset(protected)
        self._covers: dict[str, Cover] = {}
        self.wording = Wording(text)
        self.rule = ""

    @property
    def option(self) -> str | None:
        return self.config.option(self.rule)

    @cached_property
    def protection(self) -> Cover:
        """What guards protect; code in Markdown form is protected in every file type."""
        spans = [(r.start, r.end) for r in self.regions if r.type in self._protected]
        if "verbatim" in self._protected:
            spans += [(r.start, r.end) for r in markdown_regions(self.text) if r.type == "verbatim"] if "`" in self.text else [(r.start, r.end) for r in fences(self.text)]
        return Cover(spans)

    @cached_property
    def words(self) -> frozenset[str]:
        """The runs of ASCII letters of the text, in lower case."""
        return frozenset(_LETTERS.findall(self.text.lower()))

    def within(self, kind: str, at: int) -> bool:
        if kind not in self._covers:
            self._covers[kind] = Cover((r.start, r.end) for r in self.regions if r.type == kind)
        return self._covers[kind].has(at)

    def protected(self, at: int) -> bool:
        return self.protection.has(at)

    def before(self, at: int) -> str:
        """The character before a place; empty at the start."""
        return self.text[at - 1 : at] if at else ""

    def at(self, at: int) -> str:
        return self.text[at : at + 1]

    def line(self, at: int) -> tuple[int, int]:
        """Where the line of a place begins and ends."""
        end = self.text.find("\n", at)
        return self.text.rfind("\n", 0, at) + 1, len(self.text) if end < 0 else end

    def line_text(self, at: int) -> str:
        a, b = self.line(at)
        return self.text[a:b]

    def has(self, pattern: str, flags: str = "") -> bool:
        return js(pattern, flags).search(self.text) is not None
