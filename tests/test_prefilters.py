"""Rules look at cheap signs of a match first: no match may be without them."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkscour.operators import rules_characters, rules_chat, rules_style
from sparkscour.operators.page import Page
from sparkscour.operators.style_words import COPULA, INTENSIFIERS, PHRASES
from sparkscour.plans.rules import Config


def page(text: str) -> Page:
    return Page(text, Config(), ())


@pytest.mark.parametrize("i", range(len(PHRASES)))
@settings(max_examples=25, deadline=None)
@given(data=st.data())
def test_phrases(i, data):
    text = data.draw(st.from_regex(re.compile(PHRASES[i][0], re.ASCII), fullmatch=True))
    for made in (text, f"X {text.capitalize()} y"):
        p = page(made)
        assert any(all(not x.isdisjoint(p.words) for x in word_sets) for word_sets in rules_style._PHRASES[i][1])


@pytest.mark.parametrize("i", range(4))
@settings(max_examples=50, deadline=None)
@given(data=st.data())
def test_families(i, data):
    text = data.draw(st.from_regex(re.compile(list(rules_style.FAMILIES.values())[i], re.ASCII), fullmatch=True))
    assert rules_style._FAMILY_WORDS[i].may_be(page(text))


@settings(max_examples=100, deadline=None)
@given(st.from_regex(re.compile(rules_style.VAGUE_SOURCE, re.ASCII), fullmatch=True))
def test_vague_sources(text):
    assert rules_style._VAGUE_WORDS.may_be(page(text))


@settings(max_examples=300, deadline=None)
@given(st.from_regex(re.compile(rules_chat.PLACEHOLDER, re.ASCII | re.IGNORECASE), fullmatch=True))
def test_placeholders(text):
    p = page(text)
    assert "[" in text or not p.words.isdisjoint(("xx", "tbd"))


@settings(max_examples=200, deadline=None)
@given(st.from_regex(re.compile(rules_characters.INJECTION, re.ASCII | re.IGNORECASE), fullmatch=True))
def test_instructions(text):
    assert rules_characters._INJECTED.may_be(page(text)) or not text.isascii()


def test_word_lists():
    for words, rule in ((rules_style.WORDS, "sty.vocab"), (COPULA, "sty.copula"), (INTENSIFIERS, "sty.intensifier"), (rules_style.CONCISE, "sty.concise")):
        find = next(r for r in rules_style.STYLE if r.id == rule).find
        for w in words:
            assert [m.start for m in find(page(f"So {w.upper()} it"))] == [3], w
