"""Pages with known main text, drawn from random templates, to train the extractor on.

No table says which part of a page is its main text, so the extractor learns from pages
that are built: an article among menus, headers, sidebars, notices, adverts, forms,
comments and footers, in many orders and notations, with names of elements present,
misleading or missing.
"""

from __future__ import annotations

import numpy as np

WORDS = 4000
MARK = "\ue000"
LETTERS = np.array(list("abcdefghilmnoprstuvz"))


class Drawer:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        sizes = self.rng.integers(2, 10, WORDS)
        self.words = ["".join(self.rng.choice(LETTERS, n)) for n in sizes]

    def one(self, *options):
        return options[self.rng.integers(len(options))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def number(self, low: int, high: int) -> int:
        return int(self.rng.integers(low, high + 1))

    def word(self) -> str:
        return self.words[self.rng.integers(WORDS)]

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.number(low, high)))

    def prose(self, low: int, high: int) -> str:
        out = []
        while len(out) < low or self.chance(0.8) and len(out) < high:
            part = self.phrase(3, 14).capitalize()
            out += (part + self.one(".", ".", ".", "?", "!", ", " + self.word() + ".")).split()
        return " ".join(out)

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.word()}">{self.phrase(low, high)}</a>'

    def named(self, *names: str) -> str:
        """A class or id attribute, or none."""
        if self.chance(0.15):
            return ""
        name = self.one(*names)
        if self.chance(0.3):
            name = f"{name}{self.one('-', '_', ' ')}{self.word()}"
        return f' {self.one("class", "class", "id")}="{name}"'

    def links(self) -> str:
        items = [self.link() for _ in range(self.number(3, 12))]
        style = self.one("list", "list", "list", "line", "blocks")
        if style == "list":
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.one(" | ", " ", " &middot; ").join(items) if style == "line" else "".join(f"<div>{i}</div>" for i in items)

    # parts without main text

    def menu(self) -> str:
        tag = self.one("nav", "nav", "div", "ul")
        if tag == "ul":
            return f"<ul{self.named('menu', 'nav', 'navbar')}>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.number(3, 9))) + "</ul>"
        return f"<{tag}{self.named('nav', 'menu', 'main-menu', 'breadcrumb', 'toc')}>{self.links()}</{tag}>"

    def header(self) -> str:
        tag = self.one("header", "div")
        inner = self.one(f"<h1>{self.phrase(1, 4)}</h1>", f"<p>{self.phrase(2, 8)}</p>", self.link(), "")
        return f"<{tag}{self.named('header', 'masthead', 'site-header', 'top')}>{inner}{self.menu() if self.chance(0.6) else self.phrase(1, 5)}</{tag}>"

    def footer(self) -> str:
        tag = self.one("footer", "footer", "div")
        inner = self.one(f"&copy; {self.word()} {self.prose(3, 20)}", f"<p>&copy; {self.phrase(2, 9)}</p>{self.links()}", self.links(), self.prose(4, 25))
        return f"<{tag}{self.named('footer', 'foot', 'copyright', 'colophon')}>{inner}</{tag}>"

    def sidebar(self) -> str:
        tag = self.one("aside", "aside", "div", "section")
        boxes = "".join(
            f"<{self.one('h3', 'h4', 'div')}>{self.phrase(1, 3)}</div>" + self.one(self.links(), f"<p>{self.prose(5, 60)}</p>")
            for _ in range(self.number(1, 3))
        )
        return f"<{tag}{self.named('sidebar', 'side', 'widget', 'related', 'recommended', 'more')}>{boxes}</{tag}>"

    def advert(self) -> str:
        tag = self.one("div", "div", "section", "aside", "p")
        inner = self.one(self.prose(3, 30), f"<p>{self.prose(3, 30)}</p>", self.link(2, 9), f"<p>{self.prose(3, 12)}</p>{self.link()}")
        return f"<{tag} {self.one('class', 'class', 'id')}=\"{self.one('ad', 'ads', 'advert', 'ad-box', 'sponsored', 'promo', 'banner-ad', 'advertisement')}\">{inner}</{tag}>"

    def notice(self) -> str:
        tag = self.one("div", "div", "section", "aside", "dialog")
        return f"<{tag} {self.one('class', 'id')}=\"{self.one('cookie', 'cookie-notice', 'consent', 'gdpr-banner', 'alert', 'notice', 'popup', 'modal', 'paywall')}\">{self.one('<p>{}</p>', '{}').format(self.prose(5, 45))}{self.one('', '<button>' + self.word() + '</button>', self.link())}</{tag}>"

    def form(self) -> str:
        inner = f"<label>{self.phrase(1, 4)}</label><input type=\"text\"><button>{self.word()}</button>"
        lead = self.one("", f"<p>{self.prose(4, 25)}</p>", f"<h3>{self.phrase(1, 5)}</h3>")
        form = f"<form{self.named('form', 'search', 'newsletter', 'subscribe', 'login')}>{lead}{inner}</form>"
        return self.one(form, f"<div{self.named('newsletter', 'signup', 'subscribe')}>{lead}{form}</div>")

    def comments(self) -> str:
        tag, each = self.one("section", "div", "div"), self.one("div", "li", "article", "p", "div")
        name = self.one("comment", "comment", "reply", "review")
        bodies = [self.one("<p>{}</p>", "{}").format(self.prose(3, 90)) for _ in range(self.number(1, 6))]
        if each == "p":
            parts = "".join(f'<p class="{name}">{self.prose(3, 60)}</p>' for _ in bodies)
        else:
            parts = "".join(f'<{each}{self.one("", f" class={chr(34)}{name}{chr(34)}")}>{self.one("", f"<b>{self.word()}</b>", f"<span>{self.word()}:</span>")}{b}</{each}>' for b in bodies)
        parts = f"<ul>{parts}</ul>" if each == "li" else parts
        title = self.one("", f"<h3>{self.phrase(1, 3)}</h3>", f"<h2>{self.number(1, 99)} {self.word()}</h2>")
        return f"<{tag} {self.one('class', 'id')}=\"{self.one('comments', 'comment-list', 'reader-comments', 'discussion', 'responses', 'replies')}\">{title}{parts}</{tag}>"

    def share(self) -> str:
        return f"<div{self.named('share', 'social', 'tags', 'byline', 'meta')}>{self.links() if self.chance(0.6) else self.phrase(1, 6)}</div>"

    # main text

    def main_text(self, low: int, high: int) -> str:
        return MARK + self.prose(low, high)

    def article_parts(self) -> list[str]:
        out = [f"<h1>{MARK}{self.phrase(2, 12)}</h1>"] if self.chance(0.75) else []
        for _ in range(self.number(1, self.one(1, 3, 9, 9))):
            kind = self.rng.random()
            inline = self.one("{}", "{}", "<b>{}</b>", "<em>{}</em>", "{} " + self.link())
            text = inline.format(self.main_text(2, self.one(12, 60, 140)))
            if kind < 0.7:
                out.append(f"<p>{text}</p>" if self.chance(0.85) else f"<p><b>{text}<br>")
            elif kind < 0.78:
                level = self.number(2, 4)
                out.append(f"<h{level}>{MARK}{self.phrase(1, 7)}</h{level}>")
            elif kind < 0.86:
                items = "".join(f"<li>{self.main_text(2, 25)}</li>" for _ in range(self.number(2, 6)))
                out.append(f"<ul>{items}</ul>")
            elif kind < 0.91:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.95:
                out.append(f"<table><tr><td>{MARK}{self.phrase(1, 5)}</td><td>{MARK}{self.phrase(1, 5)}</td></tr></table>")
            else:
                out.append(f"<div>{text}</div>")
        return out

    def page(self) -> str:
        """A page in which each piece of main text starts with MARK."""
        parts = self.article_parts()
        inside = [self.advert, self.share, self.form, self.sidebar, self.notice]
        for _ in range(self.number(0, 2) if self.chance(0.5) else 0):
            parts.insert(self.number(0, len(parts)), self.one(*inside)())
        if self.chance(0.12):
            parts.append(self.comments())
        tag = self.one("article", "article", "main", "div", "section", "div")
        name = self.named("article", "content", "post", "entry", "main", "story", "text", "body")
        body = f"<{tag}{name if tag != 'article' or self.chance(0.3) else ''}>{''.join(parts)}</{tag}>"
        if self.chance(0.3):
            outer = self.one("main", "div", "section")
            beside = self.one("", "", self.sidebar(), self.comments(), self.advert())
            body = f"<{outer}{self.named('main', 'wrapper', 'container', 'content', 'page')}>{body}{beside}</{outer}>"
        before = [f for f, p in ((self.header, 0.5), (self.menu, 0.7), (self.notice, 0.25), (self.advert, 0.5), (self.form, 0.15), (self.sidebar, 0.12)) if self.chance(p)]
        behind = [f for f, p in ((self.comments, 0.4), (self.sidebar, 0.35), (self.advert, 0.3), (self.form, 0.2), (self.share, 0.2), (self.menu, 0.15), (self.notice, 0.12), (self.footer, 0.85)) if self.chance(p)]
        self.rng.shuffle(before)
        page = "".join(f() for f in before) + body + "".join(f() for f in behind)
        if self.chance(0.2):
            page = f"<div{self.named('page', 'wrapper', 'site')}>{page}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.phrase(1, 5)}</title></head><body>{page}</body></html>"
