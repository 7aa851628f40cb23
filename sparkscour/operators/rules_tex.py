"""Rules that keep LaTeX files safe: guards, symbols in formulas, and characters that break a build."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

import regex

from sparkscour.functions.patterns import js
from sparkscour.operators.finders import LEAVE, ask, every
from sparkscour.operators.page import Page
from sparkscour.operators.spans import Cover
from sparkscour.plans.rules import ALL, DELETE, Match, Rule

LATEX, TEX = frozenset(["latex"]), ("tex",)

# Packages of engines that print Unicode, environments with alignment marks, symbols and their commands.
_UNICODE_ENGINE = r"\\usepackage(?:\[[^\]]*\])?\{[^}]*\b(?:fontspec|polyglossia|xeCJK|unicode-math|luatexja|ctex)\b[^}]*\}|\\setmainfont|%\s*!TEX\s+(?:TS-)?program\s*=\s*(?:xe|lua)(?:la)?tex"
_UNICODE_MATH = r"\\usepackage(?:\[[^\]]*\])?\{[^}]*unicode-math"
ALIGNED = "tabular|tabularx|tabulary|tabu|longtable|array|matrix|pmatrix|bmatrix|vmatrix|Bmatrix|Vmatrix|cases|align|alignat|eqnarray|split|tblr|longtblr|NiceTabular"
MATH = {
    "×": r"\times", "÷": r"\div", "±": r"\pm", "∓": r"\mp", "−": r"-", "·": r"\cdot", "⋅": r"\cdot", "∘": r"\circ",
    "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx", "≡": r"\equiv", "∼": r"\sim", "≃": r"\simeq", "≅": r"\cong",
    "∝": r"\propto", "≪": r"\ll", "≫": r"\gg", "≺": r"\prec", "≻": r"\succ", "⪯": r"\preceq", "⪰": r"\succeq", "∞": r"\infty",
    "∂": r"\partial", "∇": r"\nabla", "∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∬": r"\iint", "∮": r"\oint", "√": r"\sqrt",
    "∈": r"\in", "∉": r"\notin", "∋": r"\ni", "⊂": r"\subset", "⊃": r"\supset", "⊆": r"\subseteq", "⊇": r"\supseteq",
    "∪": r"\cup", "∩": r"\cap", "∅": r"\emptyset", "∖": r"\setminus", "∀": r"\forall", "∃": r"\exists", "∄": r"\nexists",
    "¬": r"\neg", "∧": r"\wedge", "∨": r"\vee", "→": r"\to", "←": r"\leftarrow", "↔": r"\leftrightarrow", "⇒": r"\Rightarrow",
    "⇐": r"\Leftarrow", "⇔": r"\Leftrightarrow", "↦": r"\mapsto", "⟶": r"\longrightarrow", "…": r"\ldots", "⋯": r"\cdots",
    "⋮": r"\vdots", "⋱": r"\ddots", "′": r"'", "″": r"''", "⊗": r"\otimes", "⊕": r"\oplus", "⊙": r"\odot", "∥": r"\parallel",
    "⊥": r"\perp", "∠": r"\angle", "⌈": r"\lceil", "⌉": r"\rceil", "⌊": r"\lfloor", "⌋": r"\rfloor", "⟨": r"\langle",
    "⟩": r"\rangle", "‖": r"\|", "∣": r"\mid", "ℓ": r"\ell", "ℏ": r"\hbar", "°": r"^\circ", "⊤": r"\top", "†": r"\dagger",
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\varepsilon", "ϵ": r"\epsilon", "ζ": r"\zeta",
    "η": r"\eta", "θ": r"\theta", "ϑ": r"\vartheta", "ι": r"\iota", "κ": r"\kappa", "λ": r"\lambda", "μ": r"\mu", "µ": r"\mu",
    "ν": r"\nu", "ξ": r"\xi", "ο": r"o", "π": r"\pi", "ϖ": r"\varpi", "ρ": r"\rho", "ϱ": r"\varrho", "σ": r"\sigma",
    "ς": r"\varsigma", "τ": r"\tau", "υ": r"\upsilon", "φ": r"\varphi", "ϕ": r"\phi", "χ": r"\chi", "ψ": r"\psi",
    "ω": r"\omega", "Γ": r"\Gamma", "Δ": r"\Delta", "Θ": r"\Theta", "Λ": r"\Lambda", "Ξ": r"\Xi", "Π": r"\Pi", "Σ": r"\Sigma",
    "Υ": r"\Upsilon", "Φ": r"\Phi", "Ψ": r"\Psi", "Ω": r"\Omega",
}
RAISED = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ", "0123456789+-=()ni", strict=True))
LOWERED = dict(zip("₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜ", "0123456789+-=()aeoxhklmnpst", strict=True))
PRINTABLE = r"\x00-\x7F\u00A0-\u017F\u2010-\u2027\u2030-\u205F\uFB00-\uFB06\uE000-\uF8FF\uFE00-\uFE0F\uFFFD\U000E0000-\U000E0FFF\u2190-\u21FF\u2200-\u22FF\u2400-\u27BF\U0001D400-\U0001D7FF\u2100-\u214F\u02BC\u0300-\u036F"
_REFERENCE_WORDS = r"Figure|Fig\.|Table|Tab\.|Section|Sec\.|Chapter|Eq\.|Equation|Appendix|Algorithm|Theorem|Lemma|al\.|[a-z]"


class Facts:
    """What a whole document says about itself; found when first asked for, kept with the page."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def unicode_engine(self) -> bool:
        return js(_UNICODE_ENGINE, "i").search(self.text) is not None

    @cached_property
    def unicode_math(self) -> bool:
        return js(_UNICODE_MATH).search(self.text) is not None

    @cached_property
    def aligned(self) -> Cover:
        """Inside environments with alignment marks; one that stays open runs to the end."""
        spans, open_ = [], []
        for m in js(rf"\\(begin|end)\{{(?:{ALIGNED})\*?\}}").finditer(self.text):
            if m[1] == "begin":
                open_.append(m.start())
            elif open_:
                spans.append((open_.pop() + 1, m.start()))
        return Cover(spans + [(at + 1, len(self.text)) for at in open_])


def facts(page: Page) -> Facts:
    if not hasattr(page, "tex_facts"):
        page.tex_facts = Facts(page.text)
    return page.tex_facts


def macro(symbols: str, following: str) -> str:
    """LaTeX for a symbol, or a run of raised or lowered ones; a space keeps a command from a following letter."""
    for known, mark in ((RAISED, "^"), (LOWERED, "_")):
        if symbols[0] in known:
            return f"{mark}{{{''.join(known[c] for c in symbols)}}}"
    command = MATH[symbols]
    return command + " " if js(r"\\[A-Za-z]+$").match(command) and js("[A-Za-z]").match(following) else command


def _math_symbol(m: regex.Match, page: Page) -> object:
    if facts(page).unicode_math:
        return LEAVE
    return None if page.option == "review" else macro(m[0], page.at(m.end()))


def _print_as(m: regex.Match, page: Page) -> tuple[str, ...]:
    c = m[0]
    if c in MATH and ("\u0370" <= c <= "\u03ff" or c == "µ"):
        return (f"${MATH[c]}$",)
    if c in RAISED:
        return (rf"\textsuperscript{{{RAISED[c]}}}",)
    if c in LOWERED:
        return (rf"\textsubscript{{{LOWERED[c]}}}",)
    return (DELETE,) if js(r"\p{Extended_Pictographic}").match(c) else ()


def _special(page: Page) -> Iterable[Match]:
    """Characters that LaTeX takes for commands. After a number, % starts a comment nobody meant, so prose goes on there."""
    text = page.text
    inside = lambda at, *kinds: any(page.within(k, at) for k in kinds)
    meant = Cover((r.start, r.end) for r in page.regions if r.type == "comment" and js(r"\d").match(text[max(0, r.start - 1) : r.start]))

    def guarded(at: int) -> bool:
        return page.protected(at) and (not meant.has(at) or inside(at, "math", "verbatim", "keys", "url", "cmd"))

    for m in js(r"(?<=\d)(?<!\\)%").finditer(text):
        at = m.start()
        if not (page.within("comment", at - 1) or inside(at, "verbatim", "keys", "url")):
            yield Match(at, at + 1, None, (r"\%",), "Starts a comment: the rest of the line is not printed.")
    for m in js(r"(?<=[A-Za-z0-9.)] ?)(?<!\\)&(?= ?[A-Za-z0-9(])").finditer(text):
        if not guarded(m.start()) and not facts(page).aligned.has(m.start()):
            yield Match(*m.span(), None, (r"\&",), "Outside a table it stops the build.")
    for m in js(r"(?<=[A-Za-z0-9])(?<!\\)_(?=[A-Za-z0-9])").finditer(text):
        if not guarded(m.start()):
            yield Match(*m.span(), None, (r"\_",), "Outside a formula it stops the build.")
    for m in js(r"(?<!\\)#(?=\S)").finditer(text):
        line, _ = page.line(m.start())
        defines = js(r"\\(?:re)?newcommand|\\def|\\NewDocumentCommand|\\newenvironment").search(text[line : m.start()])
        if not (page.protected(m.start()) or defines or js(r"#{1,6}[ \t]").match(text, m.start())):
            yield Match(*m.span(), None, (r"\#",), "Stands for the parameter of a macro.")


_SYMBOLS = rf"[{''.join(RAISED)}]+|[{''.join(LOWERED)}]+|[{''.join(MATH)}]"
LATEX_RULES = [
    Rule("tex.pmath", "protects formulas", ALL, guard=("math",)),
    Rule("tex.pverb", "protects comments and code", ALL, guard=("verbatim", "comment")),
    Rule("tex.pkeys", "protects keys, links and command names", ALL, guard=("keys", "cmd", "url")),
    Rule("tex.mathsym", "Unicode symbols in formulas", LATEX, every(_SYMBOLS, _math_symbol, suggest=lambda m, p: (macro(m[0], p.at(m.end())),)), "math", TEX, tex_output=True, options={"latex": "auto"}),
    Rule("tex.unicode", "characters that pdfLaTeX cannot print", LATEX, every(f"[^{PRINTABLE}]", lambda m, p: LEAVE if facts(p).unicode_engine else None, suggest=_print_as), "text", TEX, tex_output=True),
    Rule("tex.special", "special characters without a backslash", LATEX, _special, "all", TEX, tex_output=True),
    Rule("tex.dollars", "formulas between two dollar signs", LATEX, every(r"\$\$([\s\S]+?)\$\$", lambda m, p: LEAVE if p.within("verbatim", m.start()) or p.within("comment", m.start()) else None, suggest=lambda m, p: (rf"\[{m[1]}\]",), needs="$"), "all", TEX, tex_output=True),
    Rule("tex.tie", "a space before a reference", frozenset(), ask(rf"(?<=\b(?:{_REFERENCE_WORDS}))[ \t]+(?=\\(?:ref|eqref|cref|autoref|cite[a-z]*)\b)", "", ("~",)), "text", TEX, tex_output=True),
]
