"""Style signals. All of them ask; none changes a text by itself."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import cache

import regex

from sparkscour.functions.patterns import js
from sparkscour.operators.finders import LEAVE, Needed, ask, every, match_case
from sparkscour.operators.page import Page
from sparkscour.operators.style_words import COPULA, INTENSIFIERS, OPENERS, PHRASES
from sparkscour.operators.style_words import VOCABULARY as WORDS
from sparkscour.plans.rules import ALL, DELETE, PASTE, Match, Rule

# Limits, and patterns of rhetoric, of sources and of sentences.
CLUSTER_LONGEST, CLUSTER_WORDS, CLUSTER_FAMILIES = 12_000, 120, 3
SOURCE_BEFORE, SOURCE_AFTER = 160, 350
REPEATED, SAME_START, SAME_SENTENCE_WORDS = 3, 3, 12
EACH_SENTENCE, ALL_SENTENCES = 20, 100
FAMILIES = {
    "stock framing": r"\b(?:in today's (?:rapidly evolving|ever-changing) (?:world|landscape)|in the (?:ever-evolving|rapidly evolving) landscape|in the realm of)\b",
    "inflated significance": r"\b(?:plays? a (?:pivotal|crucial|vital) role|a testament to|underscores? the importance of|paving the way for)\b",
    "formulaic contrast": r"\bnot (?:just|merely|only)\b[^.!?\n]{1,100}\bbut (?:also|rather)\b",
    "generic conclusion": r"\b(?:only time will tell|the possibilities are endless|a brighter future|it remains to be seen|in conclusion, it is (?:clear|evident))\b",
}
VAGUE_SOURCE = r"\b(?:studies (?:have shown|show|suggest)|research (?:has shown|shows|suggests)|experts (?:agree|believe|suggest)|it is widely (?:accepted|believed|recognized))\b"
CITED_NEARBY = r"\\(?:cite\w*|parencite|textcite|autocite|footcite)\b|\[\d+(?:\s*[,;–-]\s*\d+)*\]|\([^\n()]*\b(?:19|20)\d{2}[a-z]?[^\n()]*\)"
CITED_IN_SENTENCE = r"\\(?:cite[a-z]*|footcite|parencite|textcite|autocite)\b|\[\d+(?:[,\u2013-]\s*\d+)*\]|\([A-Z][A-Za-z-]+(?: et al\.)?,? (?:19|20)\d{2}"
SENTENCE_START = r"(?<=^|[.!?:][\"')\]]?\s+|\n\s*|\\item\s+|^\s*[-*]\s+)"
CONCISE = {"in order to": "to", "due to the fact that": "because", "at this point in time": "now", "in the event that": "if"}
BOTH = r"\bnot (?:just|only|merely|simply) ([^,.;:!?\n]{1,80}?),? but (?:also |rather |instead )?([^,.;:!?\n]{1,80}?)(?=[,.;:!?\n)]|$)"
RATHER = r"\b(?:it'?s|it is|this is|that'?s|that is|this isn'?t|it isn'?t|this was|it was|they'?re|they are|isn'?t|aren'?t|is not|are not) not? ?(?:just |only |merely |simply |really |about )?[^,.;:!?\n\u2014]{1,60}?(?:,|;|\s?\u2014\s?|\s-{1,3}\s)\s?(?:it'?s|it is|this is|they'?re|but|rather)\b[^.!?\n]{1,100}[.!?]?"
NEITHER = r"\bno [^,.\n]{1,30}, no [^,.\n]{1,30},? (?:just|only|simply) [^.\n]{1,60}"
TAIL = r",[ \t]+(?:further |thereby |thus )?(?:highlighting|underscoring|emphasi[sz]ing|showcasing|reflecting|demonstrating|illustrating|signal(?:l)?ing|symboli[sz]ing|ensuring|fostering|paving|contributing to|solidifying|cementing|reinforcing|marking|setting the stage|laying the groundwork|shedding light)\b[^.!?\n]{0,160}(?=[.!?])"
TRIAD = r"\b([A-Za-z-]{3,}), ([A-Za-z-]{3,}),? (?:and|or) ([A-Za-z-]{3,})\b"
ADJECTIVES = frozenset(
    "robust scalable efficient reliable secure flexible powerful seamless intuitive comprehensive innovative dynamic engaging"
    " accessible sustainable transparent actionable holistic rich vibrant clear concise fast simple safe smart modern elegant"
    " lightweight versatile adaptable resilient interpretable explainable fair accurate effective practical meaningful"
    " impactful insightful nuanced rigorous thorough timely inclusive diverse equitable".split()
)
ADJECTIVE_END = r"(?:ive|ous|ful|ic|ent|ant|able|ible|less|ary|ory|ular|ical)$"
SMALL_WORDS = r"(?:a|an|the|and|or|of|in|on|for|to|with|at|by|vs\.?)$"


def _words(words: Iterable[str]) -> str:
    return rf"\b(?:{'|'.join(regex.escape(w, special_only=True) for w in sorted(words, key=len, reverse=True))})\b"


@cache
def _excess(listed: str) -> str:
    return _words(w for w in listed.split() if w not in WORDS)


def _excess_words(page: Page) -> Iterable[Match]:
    """Words of the list in the option (style_words.EXCESS is the published one); without a list there are none."""
    if page.option and page.option.split():
        yield from ask(_excess(page.option), "i", (), "Rose in abstracts after 2022; a weak sign by itself.")(page)


def _cited(text: str, at: int) -> bool:
    """Whether the sentence around a place has a citation."""
    start = max(text.rfind(". ", 0, at + 2), text.rfind("\n\n", 0, at + 2), 0)
    end = js(r"[.!?](?:\s|$)").search(text, at)
    return bool(js(CITED_IN_SENTENCE).search(text[start : end.start() + 1 if end else len(text)]))


def _either(choice: str) -> Iterable[str]:
    """The words of a choice, each with and without a last letter that may be missing."""
    for word in choice.split("|"):
        yield word.removesuffix("?")
        if word.endswith("?"):
            yield word[:-2]


def _word_sets(pattern: str) -> list[frozenset[str]]:
    """Sets of words of which a text that a phrase matches has one each: its parts between spaces that are a word, a choice of words, or a word and how it goes on after an apostrophe."""
    out = []
    for part in js(r"(?:\((?:[^()]|\([^()]*\))*\)|[^ ()])+").findall(pattern):
        if m := js(r"([a-z]+\??)|\(\?:([a-z]+\??(?:\|[a-z]+\??)*)\)").fullmatch(part):
            out.append(frozenset(_either(m[1] or m[2])))
        elif m := js(r"([a-z]+)\(\?:'.*").fullmatch(part):
            out.append(frozenset([m[1]]))
    return out


def _choices(pattern: str) -> list[list[frozenset[str]]]:
    """The word sets of a phrase, or of each phrase of a choice of them."""
    whole = js(r"\(\?:((?:[^()]|\((?:[^()]|\([^()]*\))*\))*)\)").fullmatch(pattern)
    return [_word_sets(x) for x in js(r"(?:\((?:[^()]|\([^()]*\))*\)|[^()|])+").findall(whole[1] if whole else pattern)] if whole else [_word_sets(pattern)]


_PHRASES = [(js(rf"\b{pattern}", "i"), _choices(pattern), instead) for pattern, instead in PHRASES]


def _phrases(page: Page) -> Iterable[Match]:
    for pattern, choices, instead in _PHRASES:
        if all(any(x.isdisjoint(page.words) for x in word_sets) for word_sets in choices):
            continue
        source = "add a citation" in instead[0]
        for m in pattern.finditer(page.text):
            if not (page.protected(m.start()) or source and _cited(page.text, m.start())):
                yield Match(*m.span(), None, tuple(match_case(m[0], x) for x in instead if not x.startswith("(add")), "A stock phrase.")


def _contrasts(page: Page) -> Iterable[Match]:
    for m in js(BOTH, "i").finditer(page.text):
        if not page.protected(m.start()):
            yield Match(*m.span(), None, (f"{m[1].strip()} and {m[2].strip()}",), "Say both directly.")
    for m in js(RATHER, "i").finditer(page.text):
        if not page.protected(m.start()) and js(r"\bnot\b|n't\b", "i").search(m[0][:30]):
            yield Match(*m.span(), None, (), "Say what it is.")
    for m in js(NEITHER, "i").finditer(page.text):
        if not page.protected(m.start()):
            yield Match(*m.span(), None, (), "A list of what it is not.")


def _adjective(word: str) -> bool:
    return word.lower() in ADJECTIVES or bool(js(ADJECTIVE_END, "i").search(word)) and word.lower() not in ("and", "or", "the", "that", "this", "with", "from", "than")


def _triads(page: Page) -> Iterable[Match]:
    for m in js(TRIAD).finditer(page.text):
        if not page.protected(m.start()) and all(map(_adjective, m.groups())):
            yield Match(*m.span(), None, (), "Three adjectives in a row.")


def _same_starts(page: Page) -> Iterable[Match]:
    """Runs of sentences that begin with one word."""
    run: list[regex.Match] = []

    def told() -> Iterable[Match]:
        if len(run) >= SAME_START:
            for m in run:
                yield Match(*m.span(1), None, (), f'{len(run)} sentences in a row begin with "{m[1]}".')

    for m in js(r"(?:^|(?<=[.!?]\s+))([A-Z][a-z]+)\b[^.!?\n]*+[.!?]", "m").finditer(page.text):
        if page.protected(m.start()):
            continue
        if run and m[1] != run[-1][1]:
            yield from told()
            run = []
        run.append(m)
    yield from told()


def _heading_words(m: regex.Match) -> tuple[str, list[str]]:
    title = (m[1] if m[1] is not None else m[2]).strip()
    return title, [w for w in js(r"\s+").split(title) if not js(SMALL_WORDS, "i").match(w)]


def _title_case(m: regex.Match, page: Page) -> object:
    _, words = _heading_words(m)
    capital = sum(bool(js(r"[A-Z][a-z]").match(w)) for w in words)
    return None if len(words) >= 3 and capital / len(words) >= 0.8 else LEAVE


def _sentence_case(m: regex.Match, page: Page) -> tuple[str, ...]:
    title, _ = _heading_words(m)
    lower = title[:1] + js(r"\b([A-Z])([a-z]+)\b").sub(lambda w: w[0].lower(), title[1:])
    return (m[0].replace(title, lower, 1),)


#: For each family, phrases of which it holds one.
_FAMILY_WORDS = [Needed(x) for x in (("rapidly evolving", "ever changing", "ever evolving", "realm"), ("role", "testament", "importance", "paving"), ("not but",), ("time tell", "possibilities", "brighter", "remains", "conclusion"))]
_VAGUE_WORDS = Needed(("studies", "research", "experts", "widely"))


def _clusters(page: Page) -> Iterable[Match]:
    if sum(needed.may_be(page) for needed in _FAMILY_WORDS) < CLUSTER_FAMILIES:
        return
    for p in js(r"[^\n]+(?:\n(?!\s*\n)[^\n]+)*").finditer(page.text):
        if len(p[0]) > CLUSTER_LONGEST or len(js(r"\b[\w'-]+\b").findall(p[0])) < CLUSTER_WORDS:
            continue
        hits = []
        for name, pattern in FAMILIES.items():
            first = next((m for m in js(pattern, "i").finditer(p[0]) if not page.protected(p.start() + m.start())), None)
            if first:
                hits.append((p.start() + first.start(), p.start() + first.end(), name))
        if len(hits) >= CLUSTER_FAMILIES:
            start, end, _ = min(hits, key=lambda h: h[0])
            yield Match(start, end, None, (), f"{len(hits)} kinds of rhetoric in one paragraph: {', '.join(h[2] for h in hits)}.")


def _vague_sources(page: Page) -> Iterable[Match]:
    if not _VAGUE_WORDS.may_be(page):
        return
    for m in js(VAGUE_SOURCE, "i").finditer(page.text):
        _, line_end = page.line(m.start())
        around = page.text[max(0, m.start() - SOURCE_BEFORE) : min(line_end, m.start() + SOURCE_AFTER)]
        if not js(CITED_NEARBY).search(around):
            yield Match(*m.span(), None, (), "Which source? No citation was found nearby.")


def _same_sentences(page: Page) -> Iterable[Match]:
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    # sentences begin after another's end, so a long line without an end is looked at once
    for m in js(r"(?<![^.!?\n])[^.!?\n]++[.!?](?=\s|$)").finditer(page.text):
        sentence = m[0].strip()
        start = m.start() + m[0].index(sentence)
        places[js(r"\s+").sub(" ", sentence.lower())].append((start, start + len(sentence)))
    long = {x: spans for x, spans in places.items() if len(spans) >= REPEATED and len(js(r"\b[\w'-]+\b").findall(x)) >= SAME_SENTENCE_WORDS}
    free = sorted([s for s in spans if not page.protected(s[0])] for spans in long.values())
    often = [(span, len(spans)) for spans in free if len(spans) >= REPEATED for span in spans[:EACH_SENTENCE]]
    for (start, end), n in often[:ALL_SENTENCES]:
        yield Match(start, end, None, (), f"This sentence stands here {n} times.")


ACADEMIC = [
    Rule("sty.cluster", "several kinds of stock rhetoric in one paragraph", ALL, _clusters, "text"),
    Rule("sty.attribution", "claims of unnamed studies or experts", ALL, _vague_sources, "text"),
    Rule("sty.duplicate", "long sentences that are repeated", ALL, _same_sentences, "text"),
]
_OPENER = SENTENCE_START + rf"(?:{'|'.join(OPENERS)}),[ \t]?"
STYLE = [
    Rule("sty.concise", "four wordy phrases", ALL, ask(_words(CONCISE), "i", lambda m, p: (match_case(m[0], CONCISE[m[0].lower()]),), words=CONCISE), "text", ("txt", "md", "tex")),
    Rule("sty.vocab", "words that language models overuse", ALL, ask(_words(WORDS), "i", lambda m, p: tuple(match_case(m[0], x) for x in WORDS[m[0].lower()]), words=WORDS), "text"),
    Rule("sty.vocabx", "more such words, from a list that the option gives", frozenset(), _excess_words, "text", options={"latex": ""}),
    Rule("sty.phrase", "stock phrases", ALL, _phrases, "text"),
    Rule("sty.negpar", "contrasts with what nobody said", ALL, _contrasts, "text"),
    Rule("sty.opener", "transitions at the start of sentences", ALL, ask(_OPENER, "m", lambda m, p: (DELETE, "Also, ") if js("(?:Furthermore|Moreover|Additionally|In addition)").match(m[0]) else (DELETE,)), "text"),
    Rule("sty.ingtail", "clauses at the end that assert meaning", ALL, ask(TAIL, "i"), "text"),
    Rule("sty.copula", "long words for is and has", ALL, ask(rf"\b(?:{'|'.join(COPULA)})\b", "i", lambda m, p: (match_case(m[0], COPULA[m[0].lower()]),), words=COPULA), "text"),
    Rule("sty.intensifier", "empty intensifiers", ALL, ask(rf"\b(?:{'|'.join(INTENSIFIERS)})\b[ \t]?", "i", note=lambda m, p: "Is there a statistical test?" if m[0].lower().startswith("significantly") else None, words=INTENSIFIERS), "text"),
    Rule("sty.triad", "three adjectives in a row", ALL, _triads, "text"),
    Rule("sty.emoji", "emoji in prose", PASTE, every(r"\p{Extended_Pictographic}(?:\uFE0F|\p{Emoji_Modifier}|\u200D\p{Extended_Pictographic})*[ \t]?", lambda m, p: LEAVE if m[0][0] in "©®™" else None, suggest=(DELETE,)), "text"),
    Rule("sty.exclaim", "exclamation marks", frozenset(["latex"]), ask(r"(?<=[A-Za-z)'\"])!(?=\s|$)", "", (".",), needs="!"), "text"),
    Rule("sty.repeat", "sentences in a row that begin alike", ALL, _same_starts, "text"),
    Rule("sty.headcase", "headings with a capital on every word", frozenset(), every(r"\\(?:sub)*section\*?\{([^}\n]+)\}|^#{1,6}[ \t]+(.+)$", _title_case, "m", _sentence_case)),
]
