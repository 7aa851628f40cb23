"""All rules in their order."""

from __future__ import annotations

from sparkscour.operators.engine import Registry
from sparkscour.operators.plain_text import PLAIN
from sparkscour.operators.rules_characters import ENCODING, INVISIBLE, LETTERS, PUNCTUATION, SPACES, WHITESPACE
from sparkscour.operators.rules_chat import CHAT, MARKDOWN
from sparkscour.operators.rules_style import ACADEMIC, STYLE
from sparkscour.operators.rules_tex import LATEX_RULES

REGISTRY = Registry([*INVISIBLE, *ENCODING, *CHAT, *SPACES, *PUNCTUATION, *LETTERS, *MARKDOWN, *WHITESPACE, *LATEX_RULES, *ACADEMIC, *STYLE, *PLAIN])
