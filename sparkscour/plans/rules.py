"""What a rule is, and which rules a run uses: presets, options, selections."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from sparkscour.operators.page import Page

# Kinds of file, presets, groups in their order, and the parts of a text that guards protect.
FILE_TYPES = ("tex", "bib", "md", "txt")
PRESETS = ("latex", "markdown", "plain", "keep")
GROUPS = {
    "inv": "Invisible characters",
    "enc": "Encoding damage",
    "res": "Chat leftovers",
    "sp": "Spaces and line breaks",
    "pu": "Dashes, quotes and symbols",
    "uf": "Lookalikes and styled letters",
    "md": "Markdown leftovers",
    "ws": "Whitespace and layout",
    "tex": "LaTeX safety",
    "sty": "Style signals",
    "plain": "Convert to plain text",
}
EXTENSIONS = {"tex": "tex ltx sty cls latex", "bib": "bib", "md": "md markdown mdx rmd qmd"}
DELETE = "(delete)"
ALL = frozenset(PRESETS)
NOT_KEEP = ALL - {"keep"}
PASTE = ALL - {"markdown"}
#: Rules outside these groups, and rules inside them, whose bulk class is not that of their group.
MODERATE_GROUPS = frozenset("inv enc sp pu uf ws".split())
MODERATE_MORE = frozenset("res.cite res.entity res.utm res.wrapper tex.mathsym md.mathdelim".split())
EXPLICIT_MORE = frozenset("inv.hidden ws.unwrap".split())
WORDING = frozenset(["sty.concise"])


@dataclass(frozen=True)
class Match:
    """A span and what becomes of it: a text, nothing (""), or a question to the reader (None)."""

    start: int
    end: int
    repl: str | None
    suggestions: tuple[str, ...] = ()
    note: str | None = None


@dataclass(frozen=True)
class Rule:
    """``find`` yields the matches of one page. A guard finds nothing; it names the parts that prose rules must not touch."""

    id: str
    about: str
    presets: frozenset[str]
    find: Callable[[Page], Iterable[Match]] | None = None
    scope: str = "all"
    files: tuple[str, ...] = FILE_TYPES
    guard: tuple[str, ...] = ()
    late: bool = False
    tex_output: bool = False
    options: dict[str, str] = field(default_factory=dict)  # by preset; the value for "latex" where a preset has none

    @property
    def group(self) -> str:
        return self.id.split(".")[0]

    @property
    def bulk(self) -> str:
        if self.id in WORDING:
            return "wording"
        moderate = self.id in MODERATE_MORE or self.group in MODERATE_GROUPS and self.id not in EXPLICIT_MORE
        return "moderate" if moderate else "explicit"


def file_type(name: str) -> str:
    ending = name.lower().rsplit(".", 1)[-1]
    return next((kind for kind, endings in EXTENSIONS.items() if ending in endings.split()), "txt")


def preset_for(kind: str) -> str:
    return {"tex": "latex", "bib": "latex", "md": "markdown"}.get(kind, "plain")


@dataclass(frozen=True)
class Config:
    """A run's file type, preset, enabled rules and options. Rules that cannot act are never run."""

    file_type: str = "txt"
    preset: str = "plain"
    enabled: frozenset[str] = frozenset()
    options: tuple[tuple[str, str], ...] = ()

    def option(self, rule_id: str) -> str | None:
        return dict(self.options).get(rule_id)


def config(rules: Iterable[Rule], kind: str = "txt", preset: str | None = None, enable: Iterable[str] = (), disable: Iterable[str] = (), only: Iterable[str] | None = None, options: dict[str, str] | None = None) -> Config:
    """The defaults of ``preset`` (that of the file type), less ``disable``, with ``enable``; or ``only`` and the guards."""
    rules = list(rules)
    preset = preset or preset_for(kind)
    on = {r.id for r in rules if preset in r.presets}
    if only is not None:
        on = {r.id for r in rules if r.guard and r.id in on} | set(only)
    on = (on | set(enable)) - set(disable)
    chosen = {r.id: r.options.get(preset, r.options.get("latex", "")) for r in rules if r.options} | (options or {})
    return Config(kind, preset, frozenset(on), tuple(sorted(chosen.items())))


@dataclass(frozen=True)
class Selection:
    """Rules that a cleaning applies."""

    rule_ids: frozenset[str]
    include_wording: bool = False


def moderate(rules: Iterable[Rule]) -> Selection:
    return Selection(frozenset(r.id for r in rules if r.bulk == "moderate"))


def selected(rule_ids: Iterable[str], include_wording: bool = False) -> Selection:
    return Selection(frozenset(rule_ids), include_wording)
