"""Made-up pages with known main text, for training and testing the block labeller."""

from __future__ import annotations

import html

import numpy as np

# Phrases that boilerplate has on many sites, and names that sites give its places.
MENU = "Home|About us|Contact|News|Sports|Login|Sign in|Register|Shop|Help|FAQ|Search|Archive|Categories|Tags|Next page|Previous|Back to top|Read more".split("|")
NOTICES = "We use cookies to improve your experience|Accept all cookies|Subscribe to our newsletter|Enter your email|Your browser is out of date|Advertisement|Sponsored content|Share on social media|Follow us|Sign up for free".split("|")
LEGAL = "All rights reserved|Privacy policy|Terms of service|Copyright|Imprint|Powered by|Legal notice".split("|")
REPLIES = "Reply|Report|3 comments|Leave a comment|says:|Posted by|Log in to comment".split("|")
SIDES = "sidebar|related|widget|popular|trending|promo|recommended|aside".split("|")
ADS = "ad|ads|advert|banner|sponsored|ad-slot|adsbox|promo".split("|")
NOTES = "cookie|notice|consent|alert|popup|newsletter|modal|subscribe".split("|")
TALK = "comments|comment-list|discussion|replies|respond".split("|")
BODIES = "content|post|entry|entry-content|article-body|story|post-body|main-text|article".split("|")


class Maker:
    """Pages from a seed: invented words, random layouts, unclosed tags now and then."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)
        letters = list("aeioustrnlmdhcéüñ")
        self.vocabulary = ["".join(self.r.choice(letters, self.r.integers(2, 9))) for _ in range(600)]

    def pick(self, options: list[str]) -> str:
        return options[int(self.r.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def words(self, least: int, most: int) -> str:
        few = self.vocabulary if self.chance(0.95) else self.vocabulary[: self.r.integers(1, 4)]
        text = " ".join([few[i] for i in self.r.integers(len(few), size=self.r.integers(least, most + 1))])
        return text[:1].upper() + text[1:] + self.pick([".", ".", "", "!", " &", ","])

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        """The page, and (text, 1 if main text) of each block in order."""
        out: list[str] = []
        truth: list[tuple[str, int]] = []

        def put(tag: str, text: str, main: int, attributes: str = "") -> None:
            inner = html.escape(text, quote=False)
            if main and self.chance(0.15):
                head, _, tail = inner.partition(" ")
                inner = f"<b>{head}</b> {tail}" if tail else inner
            if not main and self.chance(0.5):
                inner = f'<a href="/x">{inner}</a>'
            close = "" if tag in ("p", "li") and self.chance(0.1) else f"</{tag}>"
            out.append(f"<{tag}{attributes}>{inner}{close}")
            truth.append((" ".join(text.split()), main))

        def named(options: list[str]) -> str:
            return f' {self.pick(["class", "class", "id"])}="{self.pick(options)}"'

        def menu() -> None:
            tag = self.pick(["nav", "header", "div"])
            out.append(f"<{tag}{named(['nav', 'menu', 'topbar', 'header', 'navigation', 'breadcrumbs']) if tag == 'div' or self.chance(0.3) else ''}><ul>")
            for _ in range(self.r.integers(2, 8)):
                text = self.pick(MENU) if self.chance(0.4) else self.words(1, 2)
                put("li", text, 0)
            out.append(f"</ul></{tag}>")

        def boxed(names: list[str], phrases: list[str], tags: list[str], most: int = 4) -> None:
            tag = self.pick(tags)
            bare = tag not in ("div", "section", "ul", "p")
            out.append(f"<{tag}{named(names) if not bare or self.chance(0.4) else ''}>")
            for _ in range(self.r.integers(1, most)):
                text = self.pick(phrases) if self.chance(0.4) else self.words(2, 30)
                inner = self.pick(["p", "div", "li", "h3", ""])
                if inner:
                    put(inner, text, 0)
                else:
                    out.append("<br>" + html.escape(text, quote=False) + "<br>")
                    truth.append((" ".join(text.split()), 0))
            out.append(f"</{tag}>")

        ad = lambda: boxed(ADS, NOTICES, ["div", "div", "aside", "section"], 3)
        side = lambda: boxed(SIDES, MENU, ["aside", "div", "section"])
        note = lambda: boxed(NOTES, NOTICES, ["div", "section", "form", "dialog"], 3)
        talk = lambda: boxed(TALK, REPLIES, ["div", "section", "ul"], 6)
        foot = lambda: boxed(["footer", "bottom", "legal", "copyright"], LEGAL, ["footer", "footer", "div"], 5)

        out.append("<!DOCTYPE html><html><head><title>x</title><style>p{a:b}</style><script>var a='<p>';</script></head><body>")
        for make in self.r.permutation(np.array([menu, menu, note, ad, side], object))[: self.r.integers(1, 5)]:
            make()
        if self.chance(0.3):
            out.append('<div class="wrapper">')
        tag = self.pick(["article", "article", "main", "div", "section"])
        out.append(f"<{tag}{named(BODIES) if tag in ('div', 'section') or self.chance(0.3) else ''}>")
        if self.chance(0.9):
            put(self.pick(["h1", "h1", "h2"]), self.words(2, 9), 1)
        inside = [ad, side, note]
        for _ in range(self.r.integers(1, 14)):
            kind = self.r.random()
            if kind < 0.05:
                inside[int(self.r.integers(3))]()
            elif kind < 0.15:
                put("h2", self.words(1, 6), 1)
            elif kind < 0.25:
                out.append("<ul>")
                for _ in range(self.r.integers(1, 5)):
                    put("li", self.words(1, 15), 1)
                out.append("</ul>")
            elif kind < 0.3:
                put("blockquote", self.words(3, 30), 1)
            else:
                put("p", self.words(1, 80), 1)
        if self.chance(0.15):
            talk()
        out.append(f"</{tag}>")
        for make in self.r.permutation(np.array([talk, side, ad, note, menu], object))[: self.r.integers(0, 4)]:
            make()
        foot()
        out.append("</body></html>" if self.chance(0.9) else "")
        return "".join(out), truth
