"""A small HTML tree: elements in page order, the text each one holds, and where blocks break."""

from __future__ import annotations

from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is never text of the page.
HIDDEN = frozenset("head script style noscript template title iframe object svg math canvas select option datalist textarea".split())
#: Elements within a line of text. Without class, id or role they are no nodes of their own.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: An open element of the first kind ends where one of the second begins.
_ENDS = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: An implied end does not look past these.
_WALLS = frozenset("article aside body button caption div dl footer form header html li main nav ol section table td th ul".split())


class Tree(HTMLParser):
    """``parent``, ``tag``, ``attributes`` of each node, parents first; node 0 is the page. ``pieces``: (node, text, linked)
    in page order; a piece with text None is the end of a block."""

    def __init__(self, html: str | None):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.attributes = [-1], ["#page"], [{}]
        self.pieces: list[tuple[int, str | None, bool]] = []
        self._open: list[tuple[str, int]] = [("#page", 0)]  # tag and the node that holds what is in it
        self._count: dict[str, int] = {}
        self.feed(html or "")
        self.close()

    def _pop(self) -> None:
        tag, _ = self._open.pop()
        self._count[tag] -= 1
        if tag not in INLINE:
            self.pieces.append((0, None, False))

    def _imply(self, tag: str) -> None:
        for at in range(len(self._open) - 1, 0, -1):
            if tag in _ENDS.get(self._open[at][0], ()):
                while len(self._open) > at:
                    self._pop()
                return
            if self._open[at][0] in _WALLS:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self._count.get("head") and tag not in _IN_HEAD:
            self._pop()
        if tag not in INLINE:
            self._imply(tag)
            self.pieces.append((0, None, False))
        if tag in VOID:
            return
        node = self._open[-1][1]
        kept = {k: v or "" for k, v in attrs}
        if tag not in INLINE or {"class", "id", "role", "data-label"} & kept.keys():
            self.parent.append(node)
            self.tag.append(tag)
            self.attributes.append(kept)
            node = len(self.tag) - 1
        self._open.append((tag, node))
        self._count[tag] = self._count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash closes void elements only

    def handle_endtag(self, tag: str) -> None:
        if not self._count.get(tag):
            return
        if tag in INLINE:
            for name, _ in reversed(self._open):
                if name == tag:
                    break
                if name not in INLINE:
                    return  # a block is open inside it
        while self._open[-1][0] != tag:
            self._pop()
        self._pop()

    def handle_data(self, data: str) -> None:
        if not any(self._count.get(x) for x in HIDDEN):
            self.pieces.append((self._open[-1][1], data, self._count.get("a", 0) > 0))
