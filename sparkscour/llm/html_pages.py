"""Labelled pages to train the extraction model from: layouts, names and amounts vary, the words mean nothing."""

from __future__ import annotations

from collections.abc import Iterator
from random import Random

PAGES = 1500
_SYLLABLES = "ka lo mi ten ra su vel dor en is par tu gri no fa che".split()
# Names that pages give to their parts.
_CONTENT_NAMES = "article content main post entry story text body page-content post-body entry-content article-body main-content hentry blog-post news-article prose markdown-body".split()
_LAYOUT_NAMES = "container wrapper wrap row col inner outer page site layout grid section block box clearfix".split()
_PARTS = {
    "menu": ("nav", "nav navbar menu main-menu topnav navigation breadcrumb breadcrumbs pagination toc"),
    "header": ("header", "header site-header masthead topbar page-header logo branding"),
    "footer": ("footer", "footer site-footer bottom copyright legal page-footer colophon"),
    "sidebar": ("aside", "sidebar aside side widget widgets rail related recommended trending popular"),
    "notice": ("div", "cookie cookies consent notice gdpr banner alert popup modal overlay cookie-banner privacy-notice"),
    "advert": ("div", "ad ads advert advertisement sponsor sponsored promo promotion ad-slot banner-ad"),
    "form": ("form", "form search login signup subscribe newsletter contact-form search-form"),
    "comments": ("section", "comments comment discussion replies responses comment-list disqus reader-comments"),
    "share": ("div", "share social sharing share-buttons follow tags meta"),
}


class _Writer:
    def __init__(self, seed: int):
        self.r = Random(seed)
        self.longest = self.r.choice([2, 4, 8, 18])  # words of a sentence: some pages are terse

    def some(self, few: int, many: int) -> int:
        return self.r.randint(few, many)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def words(self, n: int) -> str:
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.some(1, 4))) for _ in range(n))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(self.some(1, self.longest)).capitalize() + self.r.choice([".", ".", ".", "!", "?"]) for _ in range(n))

    def named(self, names: str | list[str], p: float = 0.8) -> str:
        names = names.split() if isinstance(names, str) else names
        return f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"' if self.chance(p) else ""

    def link(self, n: int) -> str:
        return f'<a href="#">{self.words(n)}</a>'

    def prose(self) -> str:
        """Sentences, now and then words without an end, numbers or shouting."""
        text = self.sentences(self.some(1, 7)) if self.chance(0.85) else self.words(self.some(1, 120))
        return text.upper() if self.chance(0.03) else text

    def title(self) -> str:
        return self.words(self.some(1, 9)) if self.chance(0.6) else self.sentences(self.some(1, 3)) if self.chance(0.8) else self.words(self.some(10, 60))

    def paragraph(self) -> str:
        text = self.prose()
        if self.chance(0.15):
            text = text.replace(" ", " " + self.link(self.some(1, 2)) + " ", 1)
        if self.chance(0.1):
            text = f"<b>{text}" + "</b>" * self.chance(0.5)
        if self.chance(0.1):
            text += "<br>" + self.sentences(1)
        return f"<p>{text}" + "</p>" * self.chance(0.9)

    def content_block(self) -> str:
        kind = self.some(0, 15)
        if kind == 0:
            return f"<h{(h := self.some(2, 4))}>{self.words(self.some(1, 7))}</h{h}>"
        if kind == 1:
            return "<{0}>{1}</{0}>".format(self.r.choice(["ul", "ol"]), "".join(f"<li>{self.words(self.some(1, 15))}</li>" for _ in range(self.some(2, 6))))
        if kind == 2:
            return f"<blockquote>{self.paragraph()}</blockquote>"
        if kind == 3:
            return f"<figure><img src=x><figcaption>{self.words(self.some(2, 10))}</figcaption></figure>"
        if kind == 4:
            return f"<pre><code>{self.words(self.some(2, 20))}</code></pre>"
        if kind == 5:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{self.words(self.some(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(self.some(1, 4))) + "</table>"
        if kind == 6:
            return f"<div>{self.sentences(self.some(1, 5))}</div>"
        return self.paragraph()

    def part(self, kind: str) -> str:
        tag, names = _PARTS[kind]
        named = self.named(names, 0.55 if tag != "div" else 1.0)
        tag = tag if self.chance(0.75) or not named else "div"
        links = "<ul>" + "".join(f"<li>{self.link(self.some(1, 3))}</li>" for _ in range(self.some(2, 8))) + "</ul>"
        if kind == "menu":
            inside = links if self.chance(0.8) else " ".join(self.link(1) for _ in range(self.some(2, 6)))
        elif kind == "header":
            inside = self.r.choice([f"<h1>{self.words(2)}</h1>", f"<div>{self.words(3)}</div>", self.link(2), f"<p>{self.words(4)}</p>"]) + (self.part("menu") if self.chance(0.4) else "")
        elif kind == "footer":
            inside = self.r.choice(["&copy; ", "", "<p>"]) + self.sentences(self.some(1, 4)) + (links if self.chance(0.4) else "")
        elif kind == "sidebar":
            inside = f"<h3>{self.words(2)}</h3>" * self.chance(0.6) + self.r.choice([links, f"<p>{self.sentences(2)}</p>", self.sentences(1)])
        elif kind == "form":
            inside = f"<label>{self.words(1)}</label><input name=q><button>{self.words(1)}</button>" + f"<p>{self.sentences(1)}</p>" * self.chance(0.4)
        elif kind == "comments":
            tag = self.r.choice([tag, tag, "ul", "ol"])
            one = lambda: "<{0}{1}>{2}</{0}>".format(self.r.choice(["div", "li", "article"]), self.named("comment reply comment-body review", 0.8), f"<p>{self.sentences(self.some(1, 4))}</p>" if self.chance(0.7) else self.sentences(self.some(1, 3)))
            inside = f"<h3>{self.words(1)}</h3>" * self.chance(0.6) + "".join(one() for _ in range(self.some(1, 5)))
        elif kind == "share":
            inside = " ".join(self.link(1) for _ in range(self.some(1, 5)))
        else:
            inside = self.r.choice([self.sentences(self.some(1, 3)), f"<p>{self.sentences(self.some(1, 3))}</p>", self.link(4), self.words(5) + " <button>" + self.words(1) + "</button>"])
        return f'<{tag}{named} data-label="other">{inside}</{tag}>'

    def page(self) -> str:
        blocks = [self.content_block() for _ in range(self.some(1, self.r.choice([2, 5, 15])))]
        if self.chance(0.7):
            title = f"<h1>{self.title()}</h1>"
            blocks.insert(0, f"<header>{title}</header>" if self.chance(0.15) else title)
        if self.chance(0.35):
            blocks.insert(self.some(0, len(blocks)), self.part(self.r.choice(["advert", "share", "sidebar", "form", "notice"])))
        tag = self.r.choice(["article", "article", "main", "div", "section"])
        named = self.named(_CONTENT_NAMES, 0.8 if tag in ("div", "section") else 0.4)
        body = f'<{tag}{named} data-label="content">{"".join(blocks)}</{tag}>'
        if self.chance(0.4):
            body = f"<main>{body}</main>" if tag != "main" else body
        if self.chance(0.15):
            loose = self.chance(0.5)  # no one element holds the content
            body = "".join(b.replace(">", ' data-label="content">', 1) if loose and "data-label" not in b[: b.index(">")] else b for b in blocks)
            bare = "" if loose else ' data-label="content"'
            if loose and self.chance(0.4):
                return body
        else:
            bare = ""
        before = [self.part(k) for k in ("notice", "header", "menu", "advert") if self.chance(0.6)]
        after = [self.part(k) for k in ("comments", "form", "sidebar", "share", "advert", "notice", "footer") if self.chance(0.5)]
        if self.chance(0.4):
            body = f"<div{self.named(_LAYOUT_NAMES)}{bare}>{''.join(before)}{body}{''.join(after[:-1])}</div>" + "".join(after[-1:])
        else:
            body = "".join([*before, body, *after])
            return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title></head><body{bare}>{body}</body></html>"
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title></head><body>{body}</body></html>"


def labelled_pages(n: int = PAGES, seed: int = 7) -> Iterator[str]:
    for i in range(n):
        yield _Writer(seed * 1_000_003 + i).page()
