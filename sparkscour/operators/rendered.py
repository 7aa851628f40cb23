"""Formulas that a copy from a chat window holds twice: as they looked, then as LaTeX."""

from __future__ import annotations


from sparkscour.functions.patterns import js

# What commands look like, how far a formula's copy reaches, and how its end may go on.
GLYPHS = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ϵ", "varepsilon": "ε", "theta": "θ", "lambda": "λ",
    "mu": "μ", "pi": "π", "sigma": "σ", "tau": "τ", "phi": "ϕ", "varphi": "φ", "omega": "ω", "Delta": "Δ", "Sigma": "Σ",
    "Omega": "Ω", "times": "×", "cdot": "·", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "approx": "≈",
    "in": "∈", "infty": "∞", "sum": "∑", "int": "∫", "partial": "∂", "to": "→", "rightarrow": "→", "pm": "±", "ldots": "…", "cdots": "⋯",
}
REACH, TAILS, ROUNDS = 90, 3, 6
SPACE = frozenset("\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")
_TAIL = js(r"[ \t]+[=+\-*/<>()0-9A-Za-z\\^_{}.,]{1,12}")
_FRACTION = js(r"\\frac\{([^{}]*)\}\{([^{}]*)\}")
_STYLED = js(r"\\(?:sqrt|mathrm|mathbf|mathit|text|operatorname|mathcal|mathbb)\{([^{}]*)\}")
_ALIKE = {"−": "-", "–": "-", "⋅": "·", "∙": "·", "…": "..."}


def alike(text: str) -> str:
    """``text`` without spaces, with one character for those that look the same."""
    return "".join(_ALIKE.get(c, c) for c in js(r"\s").sub("", text))


def shown(source: str) -> str:
    """What a formula's source looks like on one line."""
    for _ in range(ROUNDS):
        before = source
        source = _STYLED.sub(r"\1", _FRACTION.sub(r"\1\2", source))
        if source == before:
            break
    source = js(r"\\(?:left|right)").sub("", source)
    source = js(r"\\([A-Za-z]+)").sub(lambda m: GLYPHS.get(m[1], m[0]), source)
    return alike(js(r"[\^_{}\\]").sub("", source))


class FormulaReader:
    def __init__(self, text: str):
        self.text = text

    def _ends(self, end: int) -> list[int]:
        """Where a formula may end: here, or after up to TAILS short pieces more."""
        out = [end]
        while len(out) <= TAILS and (m := _TAIL.match(self.text, end, end + 20)):
            end = m.end()
            out.append(end)
        return out

    def _spelt_before(self, at: int, look: str, floor: int) -> int | None:
        """Where a spelling of ``look`` starts that ends just before ``at``; spaces do not count."""
        left = len(look)
        while left and at > floor:
            at -= 1
            c = self.text[at]
            if js(r"\s").match(c):
                continue
            if alike(c) != look[left - 1]:
                return None
            left -= 1
        return None if left else at

    def _last_shown(self, floor: int, stop: int) -> set[str] | None:
        """What the look of any source that ends at ``stop`` can end with; None if that is not plain."""
        body = js(r"[.,;:]$").sub("", self.text[floor:stop]).rstrip("^_{}\\ \t")
        if not body:
            return None
        command = js(r"\\([A-Za-z]+)$").search(body)
        if command and command[1] in ("left", "right"):
            return None
        return {alike(x)[-1:] for x in (body[-1], GLYPHS.get(command[1], "") if command else "")} - {""}

    def twice(self, start: int, end: int) -> tuple[int, int, str] | None:
        """(start, end, source) of the longest doubled formula whose source holds the piece [start, end)."""
        floor = self.text.rfind("\n", 0, start) + 1
        best = None
        for stop in self._ends(end):
            last = self._last_shown(max(floor, stop - REACH), stop)
            for at in range(stop - 1, max(floor, stop - REACH), -1):
                if self.text[at] in SPACE:
                    continue
                before = at - 1
                while before >= floor and self.text[before] in SPACE:
                    before -= 1
                if before < floor or last and alike(self.text[before])[-1:] not in last:
                    continue
                source = js(r"[.,;:]$").sub("", self.text[at:stop])
                if not js(r"\\[A-Za-z]|[\^_]").search(source):
                    continue
                look = shown(source)
                first = self._spelt_before(at, look, floor) if len(look) > 1 else None
                if first is not None and (best is None or stop - first > best[1] - best[0]):
                    best = first, at + len(source), source.strip()
        return best

    def plain(self, source: str) -> str:
        from sparkscour.operators.plain_text import formula

        return formula(source)


