"""Tables and lists in Markdown: where they are and what they hold, for the rules that write them in another form."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from sparkscour.functions.patterns import js

# Lines of a table, its rule, and lines of a list.
TABLE_LINE = r"[ \t]*\|.*\|[ \t]*"
TABLE_RULE = r"[ \t]*\|?[ \t]*:?-{2,}"
LIST_MARK = r"[ \t]*(?:[-*+]|\d{1,2}[.)])[ \t]+"


@dataclass
class Block:
    """Lines in a row, without the last line's end, and what each of them holds."""

    start: int
    end: int
    rows: list[list[str]] = field(default_factory=list)
    numbered: bool = False

    @property
    def width(self) -> int:
        return max(map(len, self.rows), default=0)


def _runs(text: str, line: str) -> Iterator[tuple[int, list[str]]]:
    """Where two lines or more in a row begin that look like ``line``, and the lines."""
    for found in js(rf"(?:^{line}(?:\n|$)){{2,}}", "m").finditer(text):
        yield found.start(), found[0].removesuffix("\n").split("\n")


def _block(start: int, lines: list[str]) -> Block:
    return Block(start, start + sum(map(len, lines)) + len(lines) - 1)


def _cells(line: str) -> list[str]:
    return [cell.strip() for cell in line.strip().removeprefix("|").removesuffix("|").split("|")]


def tables(text: str) -> Iterator[Block]:
    """Tables with the cells of each row; their rules are no rows."""
    rule = js(TABLE_RULE)
    for start, lines in _runs(text, TABLE_LINE):
        block = _block(start, lines)
        block.rows = [_cells(line) for line in lines if not rule.match(line)]
        yield block


def lists(text: str) -> Iterator[Block]:
    """Lists of two items or more, one cell each; the first mark says whether they are numbered."""
    mark = js(LIST_MARK)
    for start, lines in _runs(text, rf"{LIST_MARK}\S.*"):
        block = _block(start, lines)
        block.numbered = lines[0].lstrip(" \t")[0].isdigit()
        block.rows = [[line[mark.match(line).end() :]] for line in lines]
        yield block
