"""Made-up web pages whose main text is known, to train the extractor on."""

from __future__ import annotations

import html

import numpy as np

# Class and id names as pages use them.
_BODY = ["content", "post-content", "entry-content", "article-body", "story", "main-content", "post", "entry", "page-content", "text", "blog-post", "c1", "col-8", "wrapper", ""]
_MENU = ["nav", "menu", "main-nav", "navbar", "site-navigation", "breadcrumb", "pagination", "toc", ""]
_ADVERT = ["ad", "ads", "advert", "banner-ad", "sponsored", "promo", "adsbox", "ad-slot"]
_SIDE = ["sidebar", "widget", "related", "recommended-posts", "aside", "trending", "right-rail"]
_FOOT = ["footer", "site-footer", "copyright", "bottom", "legal"]
_HEAD = ["header", "site-header", "masthead", "top-bar", "logo"]
_NOTE = ["cookie-notice", "consent", "alert", "popup", "notice", "gdpr-banner", "modal"]
_FORM = ["newsletter", "subscribe-form", "search", "login", "contact-form", "signup"]
_TALK = ["comments", "comment-list", "discussion", "responses", "disqus_thread", "reviews"]
_SYLLABLES = "an ba co de en fi ga he in jo ka le mo ne on pa re si ta un ve wo ze th er st ou".split()


class _Maker:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        self.wanted: set[str] = set()

    def pick(self, options: list):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self) -> str:
        return "".join(self.pick(_SYLLABLES) for _ in range(int(self.rng.integers(1, 5))))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(low, high + 1))))

    def prose(self, low: int, high: int) -> str:
        noise = self.pick(["", "", "", "***", "!!", " |"])
        left, out = int(self.rng.integers(low, high + 1)), []
        while left > 0:
            n = min(left, int(self.rng.integers(3, 18)))
            words = [self.word() + (noise if noise and self.chance(0.7) else "") for _ in range(n)]
            if n > 6 and self.chance(0.5):
                words[n // 2] += ","
            out.append(" ".join(words).capitalize() + self.pick([".", ".", ".", "?", "!"]))
            left -= n
        return " ".join(out)

    def named(self, names: list[str]) -> str:
        name = self.pick(names)
        return f' {self.pick(["class", "class", "id"])}="{name}"' if name else ""

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{html.escape(text)}</a>'

    def want(self, text: str) -> str:
        self.wanted.add(" ".join(text.split()))
        return html.escape(text)

    # what is not wanted

    def menu(self) -> str:
        items = [self.link(self.phrase(1, 2)) for _ in range(int(self.rng.integers(2, 12)))]
        if self.chance(0.75):
            body = "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        else:
            body = " ".join(items)
        return f"<nav{self.named(_MENU)}>{body}</nav>" if self.chance(0.6) else f"<div{self.named(_MENU[:-1])}>{body}</div>"

    def advert(self) -> str:
        tag = self.pick(["div", "div", "aside", "section"])
        text = self.prose(4, self.pick([12, 12, 60]))
        return f"<{tag}{self.named(_ADVERT)}>{text if self.chance(0.6) else f'<p>{text}</p>'}</{tag}>"

    def side(self) -> str:
        tag = self.pick(["aside", "div", "section"])
        inner = f"<h3>{self.phrase(1, 3)}</h3>" * self.chance(0.7)
        if self.chance(0.7):
            inner += "<ul>" + "".join(f"<li>{self.link(self.phrase(2, 8))}</li>" for _ in range(int(self.rng.integers(2, 8)))) + "</ul>"
        else:
            inner += f"<p>{self.prose(8, 60)}</p>"
        return f"<{tag}{self.named(_SIDE)}>{inner}</{tag}>"

    def foot(self) -> str:
        text = f"&copy; {self.word()}.example &middot; {self.prose(3, self.pick([15, 15, 50]))}"
        inner = self.pick([text, f"<p>{text}</p>", f"<p>{text}</p><ul><li>{self.link(self.phrase(1, 2))}</li></ul>"])
        return f"<footer{self.named([*_FOOT, ''])}>{inner}</footer>" if self.chance(0.65) else f"<div{self.named(_FOOT)}>{inner}</div>"

    def head(self) -> str:
        inner = self.pick([f"<h1>{self.phrase(1, 3)}</h1>", f"<div>{self.link(self.phrase(1, 3))}</div>", f"<p>{self.phrase(2, 8)}</p>", f"<h2>{self.phrase(1, 3)}</h2><p>{self.prose(4, 12)}</p>"])
        inner += self.menu() * self.chance(0.5)
        return f"<header{self.named([*_HEAD, ''])}>{inner}</header>" if self.chance(0.65) else f"<div{self.named(_HEAD)}>{inner}</div>"

    def note(self) -> str:
        tag = self.pick(["div", "div", "section", "dialog"])
        text = self.prose(5, 40)
        return f"<{tag}{self.named(_NOTE)}>{self.pick([text, f'<p>{text}</p>'])}<button>{self.word()}</button></{tag}>"

    def form(self) -> str:
        inner = f"<p>{self.prose(3, 20)}</p>" * self.chance(0.6)
        inner += "".join(f'<label>{self.phrase(1, 2)}</label><input name="{self.word()}">' for _ in range(int(self.rng.integers(1, 4))))
        body = f"<form{self.named([*_FORM, ''])}>{inner}<button>{self.word()}</button></form>"
        return body if self.chance(0.7) else f"<div{self.named(_FORM)}><h3>{self.phrase(1, 3)}</h3>{body}</div>"

    def talk(self) -> str:
        tag, item = self.pick(["section", "div", "div"]), self.pick(["div", "li", "article"])
        each = [
            f'<{item} class="{self.pick(["comment", "reply", "comment-body", "review"])}">'
            + (f"<h4>{self.word()}</h4>" if self.chance(0.4) else f"<span>{self.word()}</span>" * self.chance(0.6))
            + (f"<p>{self.prose(3, 70)}</p>" if self.chance(0.8) else self.prose(3, 40))
            + f"</{item}>"
            for _ in range(int(self.rng.integers(1, 7)))
        ]
        body = "".join(each)
        if item == "li":
            body = f"<ol>{body}</ol>"
        return f"<{tag}{self.named(_TALK)}>" + f"<h3>{self.phrase(1, 3)}</h3>" * self.chance(0.6) + body + f"</{tag}>"

    # what is wanted

    def paragraph(self, low: int = 1, high: int = 160) -> str:
        text = self.prose(low, high) if self.chance(0.85) else self.prose(1, 6)
        shown = self.want(text)
        if self.chance(0.15):
            words = shown.split(" ")
            i = int(self.rng.integers(len(words)))
            words[i] = f"{self.pick(['<b>', '<em>', '<a href=/x>'])}{words[i]}"
            words[i] += {"b": "</b>", "e": "</em>", "a": "</a>"}[words[i][1]]
            shown = " ".join(words)
        style = self.rng.random()
        if style < 0.15:
            return f"<p><b>{shown}<br>"
        return f"<p>{shown}" if style < 0.25 else f"<p>{shown}</p>"

    def piece(self) -> str:
        r = self.rng.random()
        if r < 0.72:
            return self.paragraph()
        if r < 0.82:
            level = self.pick([2, 3])
            return f"<h{level}>{self.want(self.phrase(1, 8))}</h{level}>"
        if r < 0.9:
            n = int(self.rng.integers(1, 6))
            return "<ul>" + "".join(f"<li>{self.want(self.prose(2, 25))}</li>" for _ in range(n)) + "</ul>"
        if r < 0.95:
            return f"<blockquote>{self.want(self.prose(4, 50))}</blockquote>"
        if r < 0.98:
            return f"<div>{self.want(self.prose(10, 60))}</div>"
        return f"<table><tr><td>{self.want(self.phrase(1, 4))}</td><td>{self.want(self.prose(1, 6))}</td></tr></table>"

    def article(self) -> str:
        title = self.phrase(2, 12) if self.chance(0.8) else self.prose(2, 12)
        heading = f"<h1>{self.want(title)}</h1>" if self.chance(0.8) else ""
        if heading and self.chance(0.15):
            heading = f"<header>{heading}</header>"
        pieces = [self.paragraph(1, 200)]
        pieces += [self.piece() for _ in range(int(self.rng.integers(0, self.pick([2, 6, 18]))))]
        for make, p in ((self.advert, 0.2), (self.note, 0.05), (self.form, 0.08), (self.side, 0.08)):
            if self.chance(p):
                pieces.insert(int(self.rng.integers(len(pieces) + 1)), make())
        if self.chance(0.12):
            pieces.append(f'<div class="{self.pick(["share", "social-links", "tags"])}">' + " ".join(self.link(self.word()) for _ in range(3)) + "</div>")
        if self.chance(0.1):
            pieces.append(self.talk())
        body = "".join(pieces)
        r = self.rng.random()
        if r < 0.45:
            inner = f"<article{self.named(['', '', *_BODY])}>{heading}{body}</article>"
        elif r < 0.6:
            inner = f"<article>{heading}<div{self.named(_BODY)}>{body}</div></article>"
        elif r < 0.7:
            return f"<main{self.named(['', *_BODY])}>{heading}{body}</main>"
        else:
            inner = f"<{self.pick(['div', 'div', 'section'])}{self.named(_BODY)}>{heading}{body}</div>"
        return f"<main>{inner}</main>" if self.chance(0.25) else (f"<div{self.named(_BODY)}>{inner}</div>" if self.chance(0.2) else inner)

    def page(self) -> str:
        before = [make() for make, p in ((self.note, 0.2), (self.head, 0.6), (self.menu, 0.75), (self.advert, 0.4), (self.form, 0.1), (self.side, 0.15)) if self.chance(p)]
        after = [make() for make, p in ((self.talk, 0.35), (self.side, 0.4), (self.advert, 0.25), (self.form, 0.2), (self.menu, 0.15), (self.foot, 0.85), (self.note, 0.15)) if self.chance(p)]
        body = "".join(before) + self.article() + "".join(after)
        start = f"<!DOCTYPE html><html><head><title>{self.phrase(2, 8)}</title><style>p{{margin:0}}</style><script>var x='</p>';</script></head><body>"
        return start + body + self.pick(["</body></html>", ""])


def synthetic_page(rng: np.random.Generator) -> tuple[str, set[str]]:
    """A page and the texts of the blocks that belong to its main text."""
    maker = _Maker(rng)
    return maker.page(), maker.wanted
