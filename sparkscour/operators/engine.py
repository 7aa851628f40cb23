"""Find, settle and apply: the pass over one text, and passes until nothing changes.

Every step is a pure function of one text, so the DataFrame operators run it per row, without a shuffle.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import NamedTuple

from sparkscour.functions.patterns import js
from sparkscour.operators.page import Page
from sparkscour.operators.spans import Region
from sparkscour.plans.rules import DELETE, Config, Rule, Selection

# Most passes, and most passes of a conversion to plain text.
PASSES, CONVERSION_PASSES = 8, 24
_LEAKS = js(r"[\u200B-\u200F\u2060\uFEFF\u00AD\u202A-\u202E\u2066-\u2069\U000E0000-\U000E007F]")


class Finding(NamedTuple):
    rule_id: str
    start: int
    end: int
    orig: str
    repl: str | None
    suggestions: tuple[str, ...] = ()
    note: str | None = None

    @property
    def kind(self) -> str:
        return "review" if self.repl is None else "replace" if self.repl else "remove"


class Change(NamedTuple):
    start: int
    end: int
    insert: str


class Registry:
    """Rules in their order; the order decides between equal matches."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = list(rules)
        self.by_id = {r.id: r for r in self.rules}
        self.rank = {r.id: i for i, r in enumerate(self.rules)}

    def active(self, config: Config) -> tuple[list[Rule], list[str], bool]:
        """The rules that can act, the kinds of region that guards protect, and whether the output is plain text."""
        on = [r for r in self.rules if r.id in config.enabled and config.file_type in r.files]
        plain = any(r.group == "plain" for r in on)
        protected = [kind for r in self.rules if r.id in config.enabled for kind in r.guard]
        return [r for r in on if r.find and not (plain and r.tex_output)], protected, plain


def _allowed(page: Page, rule: Rule, start: int, end: int) -> bool:
    if rule.scope == "text" and page.protection.meets(start, end):
        return False
    if rule.scope == "math" and not page.within("math", start):
        return False
    return not (rule.group == "sty" or rule.bulk == "wording") or not page.wording.cover.meets(start, end)


def scan(text: str, config: Config, registry: Registry, hidden: Iterable[Region] = ()) -> list[Finding]:
    """Findings of one text, settled and in order."""
    rules, protected, plain = registry.active(config)
    page = Page(text, config, protected, plain, hidden)
    found: list[Finding] = []
    for rule in rules:
        page.rule = rule.id
        for m in rule.find(page):
            if m.end < m.start or m.repl == (orig := text[m.start : m.end]) or not _allowed(page, rule, m.start, m.end):
                continue
            found.append(Finding(rule.id, m.start, m.end, orig, m.repl, tuple(_LEAKS.sub("", s) for s in m.suggestions), m.note))
    if any(f.repl is not None and not registry.by_id[f.rule_id].late for f in found):
        found = [f for f in found if f.repl is None or not registry.by_id[f.rule_id].late]
    return settle(found, registry.rank)


def settle(found: list[Finding], rank: dict[str, int]) -> list[Finding]:
    """Without overlaps. Among fixes, and among reviews, the first that begins wins, then the longer, then the earlier rule.
    A review gives way to a fix that covers it or reaches across one of its ends; a fix inside a review disturbs nothing."""

    def order(f: Finding) -> tuple:
        return f.start, f.rule_id != "sty.cluster", f.start - f.end, rank[f.rule_id]

    fixes: list[Finding] = []
    reviews: list[Finding] = []
    free = {True: 0, False: 0}  # from where on the next review, or fix, may begin
    for f in sorted(found, key=order):
        review = f.repl is None
        if f.start >= free[review]:
            (reviews if review else fixes).append(f)
            free[review] = max(f.end, f.start + review)
    solid = [f for f in fixes if f.end > f.start]
    ends = [f.end for f in solid]

    def undisturbed(r: Finding) -> bool:
        i = bisect_left(ends, r.start + 1)  # the first fix that ends beyond the review's start
        while i < len(solid) and solid[i].start < r.end:
            inside = r.start <= solid[i].start and solid[i].end <= r.end and (solid[i].start, solid[i].end) != (r.start, r.end)
            if not inside:
                return False
            i += 1
        return True

    return sorted(fixes + [r for r in reviews if undisturbed(r)], key=order)


@dataclass
class Decision:
    """What a reader said about a finding: leave it, or take the suggestion of that number."""

    skip: bool = False
    pick: int | None = None


def replacement(f: Finding, decision: Decision | None = None) -> str | None:
    """The text that a finding becomes; None if it stays."""
    decision = decision or Decision()
    if f.repl is not None:
        return None if decision.skip else f.repl
    if decision.pick is None or not 0 <= decision.pick < len(f.suggestions):
        return None
    chosen = f.suggestions[decision.pick]
    if chosen == DELETE:
        return ""
    return chosen if js(r"\s$").search(chosen) else chosen + js(r"\s*$").search(f.orig)[0]


_SENTENCE_START = js(r"(?:^|[.!?][\"')\]]?\s+|\n\s*|\\item\s+)$")
_LOWER = js(r"^[ \t]*([a-z])")


def changes(text: str, findings: Iterable[Finding], decide: Callable[[Finding], str | None]) -> list[Change]:
    """Edits that do not overlap. Where a reader deletes a phrase, one of two spaces goes with it, and a sentence that then
    begins with a small letter gets a capital."""
    out: list[Change] = []
    done = 0
    for f in findings:
        insert = decide(f) if f.start >= done else None
        if insert is None:
            continue
        end, capital = f.end, None
        if f.repl is None and insert == "":
            if text[f.start - 1 : f.start] == " " and text[end : end + 1] == " ":
                end += 1
            if _SENTENCE_START.search(text[max(0, f.start - 64) : f.start] if f.start > 64 else text[: f.start]):
                capital = _LOWER.match(text[end:])
        out.append(Change(f.start, end, insert))
        done = end
        if capital:
            out.append(Change(end + capital.start(1), end + capital.end(1), capital[1].upper()))
            done = end + capital.end(1)
    return out


def applied(text: str, edits: Iterable[Change]) -> str:
    parts, done = [], 0
    for c in sorted(edits, key=lambda c: c.start):
        parts += [text[done : c.start], c.insert]
        done = c.end
    return "".join([*parts, text[done:]])


def moved(at: int, edits: Iterable[Change]) -> int | None:
    """Where a place of the old text is in the new; None if it was inside something replaced."""
    shift = 0
    for c in edits:
        if c.start < at < c.end:
            return None
        if c.end <= at and not c.start == c.end == at:
            shift += len(c.insert) - (c.end - c.start)
    return at + shift


def carried(at: int, edits: Iterable[Change], after: bool) -> int:
    """Where an end of a span is after edits in order; one inside something replaced moves to its end or its start."""
    shift = 0
    for c in edits:
        if c.end < at or c.end == at and (after or c.start < at):
            shift += len(c.insert) - (c.end - c.start)
        elif c.start < at < c.end:
            return c.start + shift + (len(c.insert) if after else 0)
        else:
            break
    return at + shift


@dataclass
class Cleaned:
    text: str
    passes: list[list[Change]] = field(default_factory=list)
    applied: Counter = field(default_factory=Counter)
    refused: int = 0


def clean(text: str, config: Config, registry: Registry, selection: Selection, skips: Iterable[tuple[str, int]] = (), allow: Callable[[Finding], bool] | None = None, wording: Iterable[tuple[int, int]] | None = None) -> Cleaned:
    """Apply the selected rules until the text is stable. Rules that are not selected are off from the start, so they cannot
    win an overlap. ``skips`` (rule, start) stay as they are through all passes; ``allow`` may refuse a change. With
    ``wording``, spans of the text, rules of wording may change only what lies in one of them."""
    chosen = selection.rule_ids
    on = frozenset(x for x in config.enabled if (r := registry.by_id.get(x)) and (r.guard or x in chosen and (r.bulk != "wording" or selection.include_wording)))
    narrowed = Config(config.file_type, config.preset, on, config.options)
    plain = any(x.startswith("plain.") and config.file_type in registry.by_id[x].files for x in config.enabled if x in registry.by_id)
    out, kept = Cleaned(text), set(skips)
    free = None if wording is None else sorted(wording)
    for _ in range(CONVERSION_PASSES if plain else PASSES):
        taken: list[Finding] = []
        for f in scan(out.text, narrowed, registry):
            if (f.rule_id, f.start) in kept:
                continue
            about_wording = registry.by_id[f.rule_id].bulk == "wording"
            wording = about_wording and selection.include_wording
            if f.repl is None and not wording:
                continue
            if allow and not allow(f) or about_wording and free is not None and not any(a <= f.start and f.end <= b for a, b in free):
                out.refused += 1
                kept.add((f.rule_id, f.start))
            elif not wording:
                taken.append(f)
            elif f.suggestions:
                taken.append(f._replace(repl=f.suggestions[0]))
        edits = changes(out.text, taken, lambda f: f.repl)
        if not edits:
            break
        out.applied.update(f.rule_id for f in taken)
        out.passes.append(edits)
        before, out.text = out.text, applied(out.text, edits)
        kept = {(rule, to) for rule, at in kept if (to := moved(at, edits)) is not None}
        free = free and [(carried(a, edits, True), carried(b, edits, False)) for a, b in free]
        if out.text == before:
            break
    return out
