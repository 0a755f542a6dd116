"""Labelled pages on which the extractor is trained: made here, from a fixed seed, in many layouts.

A page is HTML and, for each text block in order, 1 (main text) or 0.
"""

from __future__ import annotations

import random
from html import escape

#: What sites call the parts of their pages.
CONTAINERS = ("article", "main", "section", "div")
CONTENT_NAMES = ("post-content", "entry-content", "story", "article-body", "content", "post", "text", "main-content", "article", "entry", "body-text", "page-content")
MENU_NAMES = ("nav", "menu", "navbar", "navigation", "main-menu", "breadcrumbs", "topbar", "nav-links", "pagination")
HEADER_NAMES = ("header", "masthead", "site-header", "branding", "logo", "top")
ADVERT_NAMES = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot")
SIDE_NAMES = ("sidebar", "widget", "related", "aside", "popular", "recommended", "tags", "share", "social", "newsletter")
NOTICE_NAMES = ("notice", "cookie", "cookie-banner", "alert", "consent", "gdpr", "announcement", "warning", "paywall")
FOOTER_NAMES = ("footer", "site-footer", "bottom", "copyright", "legal", "colophon")
COMMENT_NAMES = ("comments", "comment-list", "responses", "discussion", "replies", "disqus")
WRAPPERS = ("wrapper", "container", "row", "col", "inner", "page", "layout", "box", "")
MENU_WORDS = ("Home", "About", "About us", "Contact", "News", "Sports", "Blog", "Archive", "Login", "Sign in", "Products", "Services", "Help", "FAQ", "Next", "Previous", "RSS", "Search")
NOTICE_TEXTS = ("We use cookies to improve your experience.", "This site uses cookies. By continuing you accept our policy.", "Accept all", "Please enable JavaScript to view this page.", "Subscribe now to read more.", "Sign up for our newsletter", "Your session has expired.", "Notice: planned maintenance tonight.")
SYLLABLES = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "é", "ü", "ñ", "sch", "que", "ción", "ß", "ая", "но", "の", "語")


class _Page:
    def __init__(self, seed: int):
        self.r, self.out, self.labels = random.Random(seed), [], []
        self.named = self.r.random() < 0.75  # whether this site's parts have telling names
        self.tags = self.r.random() < 0.7  # whether it uses the tags meant for them

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def phrase(self, least: int, most: int) -> str:
        words = [self.word() + self.r.choice(("", "", "", "", "", "", ",", "###", "%%%")[: 7 if self.r.random() < 0.9 else 9]) for _ in range(self.r.randint(least, most))]
        return escape(" ".join(words).capitalize()) + self.r.choice((".", ".", ".", "", "?", "!"))

    def sentences(self, least: int, most: int) -> str:
        return " ".join(self.phrase(1, 18) for _ in range(self.r.randint(least, most)))

    def name(self, names: tuple[str, ...]) -> str:
        if not self.named or self.r.random() < 0.1:
            names = WRAPPERS
        name = self.r.choice(names)
        return f' {self.r.choice(("class", "id"))}="{name}"' if name else ""

    def block(self, tag: str, text: str, label: int, closed: bool = True) -> None:
        self.out.append(f"<{tag}>{text}" + (f"</{tag}>" if closed else ""))
        self.labels.append(label)

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{text}</a>'

    def part(self, tag: str, names: tuple[str, ...], fill) -> None:
        tag = tag if self.tags else "div"
        # a part with neither a telling tag nor a telling name can be told by its text alone
        self.out.append(f"<{tag}{self.name(names)}>")
        fill()
        self.out.append(f"</{tag}>")

    def menu(self) -> None:
        def fill() -> None:
            self.out.append("<ul>")
            for _ in range(self.r.randint(2, 8)):
                self.block("li", self.link(self.r.choice(MENU_WORDS) if self.r.random() < 0.5 else self.word() + self.r.choice(("", ".", ","))), 0)
            self.out.append("</ul>")

        self.part("nav", MENU_NAMES, fill)

    def header(self) -> None:
        def fill() -> None:
            if self.r.random() < 0.7:
                self.block(self.r.choice(("h1", "div", "p", "h2")), self.link(self.phrase(1, 3)), 0)
            if self.r.random() < 0.5:
                self.block("p", self.phrase(2, 6), 0)
            if self.r.random() < 0.5:
                self.menu()

        self.part("header", HEADER_NAMES, fill)

    def advert(self) -> None:
        self.out.append(f'<{self.r.choice(("div", "div", "div", "aside", "section"))} class="{self.r.choice(ADVERT_NAMES)}">')
        tag = self.out[-1][1:].split(" ")[0]
        if self.r.random() < 0.5:
            self.out.append(self.sentences(1, 4))
            self.labels.append(0)
        else:
            for _ in range(self.r.randint(1, 3)):
                self.block("p", self.link(self.phrase(2, 8)) if self.r.random() < 0.5 else self.sentences(1, 3), 0)
        self.out.append(f"</{tag}>")

    def side(self) -> None:
        def fill() -> None:
            self.block(self.r.choice(("h2", "h3", "h4")), self.phrase(1, 3), 0)
            for _ in range(self.r.randint(1, 5)):
                if self.r.random() < 0.75:
                    self.block(self.r.choice(("li", "p", "div")), self.link(self.phrase(2, 9)), 0)
                else:
                    self.block("p", self.phrase(3, 14), 0)

        self.part("aside", SIDE_NAMES, fill)

    def notice(self) -> None:
        self.out.append(f'<div {self.r.choice(("class", "id"))}="{self.r.choice(NOTICE_NAMES)}">')
        for _ in range(self.r.randint(1, 2)):
            self.block("p", self.r.choice(NOTICE_TEXTS) if self.r.random() < 0.6 else self.phrase(4, 14), 0)
        self.out.append("</div>")

    def form(self) -> None:
        self.out.append('<form action="/x">')
        for _ in range(self.r.randint(1, 3)):
            self.block(self.r.choice(("p", "div", "fieldset")), self.r.choice(("E-mail", "Name", "Your message", "Search", self.phrase(1, 5))), 0)
            self.out.append('<input type="text" name="q">')
        self.out.append("</form>")

    def comments(self) -> None:
        tag = self.r.choice(("section", "div", "ol", "aside"))
        self.out.append(f'<{tag} {self.r.choice(("id", "class"))}="{self.r.choice(COMMENT_NAMES)}">')
        self.block(self.r.choice(("h2", "h3")), self.r.choice(("Comments", "3 comments", "Responses", "Leave a reply", self.phrase(1, 3))), 0)
        for _ in range(self.r.randint(1, 4)):
            self.out.append(f'<{"li" if tag == "ol" else "div"} class="{self.r.choice(("comment", "comment-body", "reply", "response"))}">')
            self.block("p", self.phrase(1, 3), 0)
            for _ in range(self.r.randint(1, 3)):
                self.block("p", self.sentences(1, 5), 0)
            self.out.append(f'</{"li" if tag == "ol" else "div"}>')
        self.out.append(f"</{tag}>")

    def footer(self) -> None:
        def fill() -> None:
            if self.r.random() < 0.7:
                text = f"&copy; {self.r.choice(('2024', 'example.com', 'm.' + self.word() + '.example.net'))} &middot; {self.sentences(1, 2)}"
                if self.r.random() < 0.5:
                    self.out.append(text)
                    self.labels.append(0)
                else:
                    self.block("p", text, 0)
            else:
                self.block("p", self.r.choice(("All rights reserved.", "Terms of use", "Privacy policy", self.phrase(2, 9))), 0)
            if self.r.random() < 0.4:
                self.menu()

        self.part("footer", FOOTER_NAMES, fill)

    def article(self) -> None:
        tag = self.r.choice(CONTAINERS[:3]) if self.tags else "div"
        bare = self.r.random() < 0.08
        if not bare:
            self.out.append(f"<{tag}{self.name(CONTENT_NAMES) if tag != 'article' or self.r.random() < 0.3 else ''}>")
        if self.r.random() < 0.85:
            self.block("h1", self.phrase(1, 12), 1)
        for _ in range(self.r.randint(1, 14)):
            x = self.r.random()
            if x < 0.62:
                text = self.sentences(1, 8)
                if self.r.random() < 0.2:
                    text = text.replace(" ", " " + self.link(self.word()) + " ", 1) if " " in text else text
                if self.r.random() < 0.2:
                    text = f"<b>{text}<br>"
                self.block("p", text, 1, self.r.random() < 0.9)
            elif x < 0.72:
                self.block("p", self.phrase(1, 2), 1)
            elif x < 0.8:
                self.block(self.r.choice(("h2", "h3")), self.phrase(1, 7), 1)
            elif x < 0.86:
                self.out.append("<ul>")
                for _ in range(self.r.randint(1, 4)):
                    self.block("li", self.phrase(2, 14), 1)
                self.out.append("</ul>")
            elif x < 0.9:
                self.block("blockquote", self.sentences(1, 3), 1)
            elif x < 0.94:
                self.advert()
            elif x < 0.97:
                self.out.append("<table><tr>")
                for _ in range(self.r.randint(2, 4)):
                    self.block("td", self.phrase(1, 4), 1)
                self.out.append("</tr></table>")
            else:
                self.out.append('<figure><img src="a.png">')
                self.block("figcaption", self.phrase(2, 10), 1)
                self.out.append("</figure>")
        if not bare:
            self.out.append(f"</{tag}>")


def page(seed: int) -> tuple[str, list[int]]:
    """One labelled page."""
    p = _Page(seed)
    r = p.r
    p.out.append(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{p.phrase(1, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
    before = [f for f, share in ((p.header, 0.5), (p.menu, 0.75), (p.notice, 0.3), (p.advert, 0.5), (p.side, 0.15), (p.form, 0.15)) if r.random() < share]
    after = [f for f, share in ((p.comments, 0.4), (p.side, 0.4), (p.advert, 0.25), (p.form, 0.2), (p.notice, 0.1)) if r.random() < share]
    wrapped = r.random() < 0.4
    if wrapped:
        p.out.append(f'<div class="{r.choice(WRAPPERS[:-1])}">')
    for f in before:
        f()
    p.out.append(f"<!-- {p.word()} -->")
    p.article()
    for f in after:
        f()
    if wrapped:
        p.out.append("</div>")
    if r.random() < 0.85:
        p.footer()
    p.out.append("</body></html>" if r.random() < 0.9 else "")
    return "\n".join(p.out) if r.random() < 0.3 else "".join(p.out), p.labels


def pages(n: int, seed: int = 1) -> list[tuple[str, list[int]]]:
    return [page(seed * 1_000_003 + i) for i in range(n)]
