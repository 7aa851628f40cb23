"""Main text of web pages by a tree-structured graphical model.

Every element is a variable: frame (what holds the parts of a page), other, or content. Its evidence (words in class, id and role; given its tag, how much text it holds,
how much of that is links and whether it has sentences) is a naive Bayes potential; a potential on each edge ties a child to
its parent, given the child's tag and whether it has a name. Sum-product messages
go up the tree and down again, which gives every element's exact marginal. Text stays where the element that holds it is
content with a probability of one half or more.

The potentials are smoothed counts over labelled pages: HTML in which ``data-label`` ("content" or "other") marks elements
and holds for what they contain; elements without a mark around them are frame. ``html_pages.labelled_pages`` makes the built-in set; ``train`` takes any other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.llm.common import ship, spread
from sparkscour.llm.html_pages import labelled_pages
from sparkscour.llm.html_tree import Tree

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SMOOTHING = 0.5
#: Children that every tag is taken to have had besides those seen, with the states that children of any tag have.
LIKE_ANY = 1.0
FRAME, OTHER, CONTENT = STATES = range(3)


def _amount(n: int) -> str:
    return next(name for bound, name in ((0, "none"), (3, "few"), (9, "some"), (29, "many"), (99, "lots"), (math.inf, "most")) if n <= bound)


def _share(part: int, whole: int) -> str:
    return "empty" if not whole else "links" if part > 0.6 * whole else "mixed" if part > 0.2 * whole else "text"


def evidence(tree: Tree) -> list[tuple[str, str, list[str]]]:
    """Of every node its kind (tag, and whether it has a name), the shape of its text, and the words it is named by."""
    size = len(tree.tag)
    own, linked, stops = [0] * size, [0] * size, [0] * size
    for node, text, link in tree.pieces:
        if text:
            n = len(text.split())
            own[node] += n
            linked[node] += n * link
            stops[node] += any(x in text for x in ".!?\u3002")
    below, below_linked = own[:], linked[:]
    for node in range(size - 1, 0, -1):
        below[tree.parent[node]] += below[node]
        below_linked[tree.parent[node]] += below_linked[node]
    out = []
    for node in range(size):
        names = " ".join(tree.attributes[node].get(k, "") for k in ("class", "id", "role"))
        words = sorted({w.lower() for w in _NAME.findall(names)})
        held = _amount(own[node]) if own[node] else f"below {_amount(below[node])}"
        out.append((tree.tag[node] + " named" * bool(words), f"{held} {_share(below_linked[node], below[node])} {bool(stops[node])}", words))
    return out


Potential = tuple[float, ...]


@dataclass
class Model:
    """Log potentials of the states."""

    shapes: dict[tuple[str, str], Potential]  # by kind and shape
    names: dict[str, Potential]
    edges: dict[str, tuple[Potential, ...]]  # by the child's kind; of the parent's state, then of the child's
    root: Potential

    def local(self, tree: Tree) -> tuple[list[list[float]], list[tuple[Potential, ...]]]:
        """Evidence of every node, and what ties it to its parent. Siblings of one kind look alike whatever they are, so
        their shapes have one voice together."""
        none = (0.0,) * len(STATES)
        found = evidence(tree)
        alike = Counter((parent, kind) for parent, (kind, _, _) in zip(tree.parent, found, strict=True))
        out = []
        for node, (kind, shape, names) in enumerate(found):
            shown = self.shapes.get((kind, shape), none) if node else self.root
            voice = 1 / alike[tree.parent[node], kind]
            out.append([shown[y] * voice + sum(self.names[x][y] for x in names if x in self.names) for y in STATES])
        return out, [self.edges.get(kind) or self.edges[""] for kind, _, _ in found]

    def marginals(self, tree: Tree) -> list[float]:
        """Probability of content for every node, by one pass up and one down; no recursion, so depth has no limit."""
        belief, tie = self.local(tree)  # belief: first a node's own evidence and what its children say
        message = [[0.0] * len(STATES) for _ in belief]
        for node in range(len(belief) - 1, 0, -1):
            message[node] = [_log_sum([tie[node][p][y] + belief[node][y] for y in STATES]) for p in STATES]
            above = belief[tree.parent[node]]
            for p in STATES:
                above[p] += message[node][p]
        for node in range(1, len(belief)):
            above = belief[tree.parent[node]]
            rest = [above[p] - message[node][p] for p in STATES]
            found = [belief[node][y] + _log_sum([rest[p] + tie[node][p][y] for p in STATES]) for y in STATES]
            top = max(found)
            belief[node] = [x - top for x in found]
        return [math.exp(x[CONTENT] - _log_sum(x)) for x in belief]


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def _labels(tree: Tree) -> list[int]:
    marks = {"other": OTHER, "content": CONTENT}
    out = [FRAME] * len(tree.tag)
    for node in range(1, len(out)):
        out[node] = marks.get(tree.attributes[node].get("data-label", ""), out[tree.parent[node]])
    return out


def train(pages: Iterable[str]) -> Model:
    """Potentials from labelled pages. Evidence is what the page shows: ``data-label`` is no feature."""
    shapes, kinds, names, ties, roots = Counter(), Counter(), Counter(), Counter(), Counter()
    for page in pages:
        tree = Tree(page)
        labels = _labels(tree)
        for node, (kind, shape, own) in enumerate(evidence(tree)):
            y = labels[node]
            shapes[kind, shape, y] += 1
            kinds[kind, y] += 1
            for x in own:
                names[x, y] += 1
            if not node:
                roots[y] += 1
                continue
            for t in ("", kind):
                ties[t, labels[tree.parent[node]], y] += 1
    wide, words = len({shape for _, shape, _ in shapes}), {x for x, _ in names}
    total = [sum(n for (_, y), n in names.items() if y == state) for state in STATES]
    share = lambda n, of, wide: math.log((n + SMOOTHING) / (of + SMOOTHING * wide))
    each = lambda f: tuple(map(f, STATES))
    any_tag = each(lambda p: each(lambda y: math.exp(share(ties["", p, y], sum(ties["", p, c] for c in STATES), len(STATES)))))
    tied = lambda t, p, y: math.log((ties[t, p, y] + LIKE_ANY * any_tag[p][y]) / (sum(ties[t, p, c] for c in STATES) + LIKE_ANY))
    return Model(
        {(t, s): each(lambda y, t=t, s=s: share(shapes[t, s, y], kinds[t, y], wide)) for t, s, _ in shapes},
        {x: each(lambda y, x=x: share(names[x, y], total[y], len(words))) for x in words},
        {t: each(lambda p, t=t: each(lambda y: tied(t, p, y))) for t in {t for t, _, _ in ties}},
        each(lambda y: share(roots[y], roots.total(), len(STATES))),
    )


@cache
def built_in() -> Model:
    return train(labelled_pages())


def main_text(html: str | None, model: Model) -> str:
    """Blocks of content in page order, white space as one space; all text of a page without elements, which has no frame."""
    tree = Tree(html)
    kept = model.marginals(tree) if len(tree.tag) > 1 else [1.0]
    return " ".join("".join(" " if text is None else text for node, text, _ in tree.pieces if text is None or kept[node] >= 0.5).split())


def extracted(html: Column, model: Model) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, model) for x in pages], dtype=object)

    return run(html.cast("string"))


def extract(pages: DataFrame, html_col: str = "html", model: Model | None = None, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Per row: the columns ``keep``, text, n_chars (code points).

    A null or empty page, or one without content, has an empty text; a page of plain text, without elements, keeps all of it.
    Broken markup is read as far as it goes, and pages of any length and depth whole. Repeated rows come back as often as they
    are there, rows without id or URL like any other. Other columns are not read, also if they are called text or n_chars.
    An empty table gives no rows.
    """
    ship(pages.sparkSession)
    rows = spread(pages.select(*keep, html_col)).select(*keep, extracted(F.col(html_col), model or built_in()).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
