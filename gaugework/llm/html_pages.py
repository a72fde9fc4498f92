"""Pages made for training the block labeller, with their main blocks known; run as a program, it trains the weights.

Each page draws its frame (element names, class words or none), the parts around the article (menus, banners, adverts,
notices, side bars, forms, comments, links to other articles, footers) and their order, words from its own invented
vocabulary, and now and then junk characters, unclosed tags or a cut end.
"""

from __future__ import annotations

import random
from html import escape

from gaugework.llm.html_blocks import Block, blocks

MARK = "⁣"  # before each main block's text, taken out again once blocks are found


class Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        syllables = ["".join(rng.choices("bcdfghjklmnprstvwz", k=1)) * rng.randint(0, 1) + rng.choice("aeiouéèöäüó") + rng.choice([
            "", "n", "r", "s", "t", "nd"
        ]) for _ in range(40)]
        self.words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(300)]
        self.junk = rng.random() < 0.15
        self.bare = rng.random() < 0.25  # no class words
        self.own = None if rng.random() < 0.8 else {}  # class words of this page's own instead of the usual ones
        self.nested = rng.choice([0, 0, 0.1, 0.3, 0.6])  # how often parts lie in wrappers

    def text(self, n: int, end: str = ".") -> str:
        r, out = self.rng, []
        for k in range(max(n, 1)):
            w = r.choice(self.words)
            w = w.capitalize() if k == 0 or r.random() < 0.06 else w
            out.append(w + (r.choice(["&&&", "***", "%%%", "###", "$$$"]) if self.junk else r.choice([",", "."]) if r.random() < 0.1 else ""))
        return escape(" ".join(out) + end, quote=False)

    def tag(self, name: str, inner: str, *words: str) -> str:
        key = self.rng.choice(["class", "class", "id"])
        word = self.rng.choice(words) if words else ""
        if word and self.own is not None:
            word = self.own.setdefault(word, self.rng.choice(self.words))
        attribute = f' {key}="{word}"' if word and not self.bare and self.rng.random() < 0.8 else ""
        return f"<{name}{attribute}>{inner}</{name}>"

    def wrapped(self, inner: str) -> str:
        """The same in some elements more: wrappers with words of layout, or with invented ones."""
        r = self.rng
        while r.random() < self.nested:
            words = r.choice(["row", "col", "container", "wrapper", "inner", "grid", "box", "clearfix", "layout", "section", "block", r.choice(self.words)])
            inner = f'<{(name := r.choice(["div", "div", "div", "section"]))} class="{words}">{inner}</{name}>' if r.random() < 0.7 else f"<section>{inner}</section>"
        return inner

    def links(self, n: int, size: tuple[int, int] = (1, 2)) -> str:
        return "".join(f'<li><a href="/{k}">{self.text(self.rng.randint(*size), "")}</a></li>' for k in range(n))

    def menu(self) -> str:
        r = self.rng
        inner = f"<ul>{self.links(r.randint(2, 10))}</ul>" if r.random() < 0.7 else " ".join(f'<a href="#">{self.text(1, "")}</a>' for _ in range(r.randint(
            2, 8
        )))
        return self.tag(r.choice(["nav", "nav", "div"]), inner, "nav", "menu", "navigation", "navbar", "topnav", "breadcrumbs")

    def header(self) -> str:
        r = self.rng
        inner = r.choice(["<h1>{0}</h1>", "<div>{0}</div>", "<p>{0}</p>", "<a href='/'>{0}</a>"]).format(self.text(r.randint(1, 5), ""))
        return self.tag(
            r.choice(["header", "header", "div"]), inner + (self.menu() if r.random() < 0.3 else ""), "header", "banner", "masthead", "top",
            "site header"
        )

    def advert(self) -> str:
        r = self.rng
        inner = self.text(r.randint(2, 30))
        inner = inner if r.random() < 0.5 else f"<p>{inner}</p>" if r.random() < 0.6 else f'<a href="x">{inner}</a>'
        return self.tag(
            r.choice(["div", "div", "aside", "section", "ins"]), inner, "ad", "ads", "advert", "sponsored", "promo", "advertisement", "banner ad"
        )

    def notice(self) -> str:
        r = self.rng
        inner = f"<p>{self.text(r.randint(5, 30))}</p>" + (f"<button>{self.text(1, '')}</button>" if r.random() < 0.6 else "")
        return self.tag("div", inner, "cookie", "cookie notice", "consent", "notice", "gdpr", "alert", "subscribe", "newsletter", "popup")

    def side(self) -> str:
        r = self.rng
        inner = f"<h3>{self.text(2, '')}</h3>" + (f"<ul>{self.links(r.randint(2, 8), (2, 8))}</ul>" if r.random() < 0.7 else f"<p>{self.text(r.randint(5, 40))}</p>")
        return self.tag(r.choice(["aside", "aside", "div"]), inner, "sidebar", "side", "widget", "related", "rail")

    def form(self) -> str:
        return f"<form>{self.tag('label', self.text(2, ''))}<input name=q><p>{self.text(self.rng.randint(2, 12))}</p><button>{self.text(1, '')}</button></form>"

    def comments(self) -> str:
        r = self.rng
        each = "".join(self.tag(
            "div", f"<b>{self.text(1, '')}</b> <p>{self.text(r.randint(3, 50))}</p>", "comment", "reply"
        ) for _ in range(r.randint(1, 5)))
        return self.tag(
            r.choice(["section", "div"]), f"<h3>{self.text(2, '')}</h3>{each}", "comments", "comment list", "discussion", "responses", "disqus"
        )

    def footer(self) -> str:
        r = self.rng
        inner = r.choice(["&copy; {0} &middot; {1}", "<p>&copy; {0}</p><ul>{2}</ul>", "<p>{1}</p>", "{0}"]).format(
            self.text(r.randint(1, 8)), self.text(r.randint(2, 20)), self.links(r.randint(1, 5))
        )
        return self.tag(r.choice(["footer", "footer", "div"]), inner, "footer", "foot", "bottom", "copyright", "site footer")

    def article(self) -> str:
        r, out = self.rng, []
        body = lambda: MARK + self.text(int(r.choice([r.randint(1, 4), r.randint(5, 30), r.randint(30, 120)])))
        if r.random() < 0.8:
            out.append(f"<h1>{MARK}{self.text(r.randint(1, 10), '')}</h1>")
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 12, 20])):
            kind = r.random()
            if kind < 0.7:
                out.append(f"<p>{body()}</p>" if r.random() < 0.8 else f"<p><b>{body()}<br>")
            elif kind < 0.78:
                level = r.randint(2, 4)
                out.append(f"<h{level}>{MARK}{self.text(r.randint(1, 6), '')}</h{level}>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.text(r.randint(2, 15))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote>{body()}</blockquote>")
            elif kind < 0.9:
                cell = lambda name: f"<{name}>{MARK}{self.text(r.randint(1, 6), '')}</{name}>"
                rows = "".join("<tr>" + "".join(cell("td") for _ in range(r.randint(1, 4))) + "</tr>" for _ in range(r.randint(1, 4)))
                out.append(r.choice([
                    f"<table>{rows}</table>", f"<figure><img src=x><figcaption>{body()}</figcaption></figure>", f"<pre><code>{body()}</code></pre>",
                    "<dl>" + "".join(cell("dt") + cell("dd") for _ in range(r.randint(1, 4))) + "</dl>"
                ]))
            elif kind < 0.94:
                out.append(f"<div>{body()}</div>")
            elif kind < 0.97:
                out.append(f"<p>{body()} <a href='/x'>{self.text(2, '')}</a> {self.text(5)}</p>")
            else:
                out.append(r.choice([self.advert, self.side, self.notice])())
        if r.random() < 0.15:
            out.append(self.comments())
        name = r.choice(["article", "article", "article", "main", "div", "section"])
        cut = r.randint(0, len(out))
        parts = self.wrapped("".join(out[:cut])) + self.wrapped("".join(out[cut:])) if r.random() < 0.5 else "".join(out)
        inner = self.tag(name, self.wrapped(parts), "article", "content", "post", "entry content", "main", "story body")
        return self.wrapped(inner if r.random() < 0.7 else self.tag(r.choice(["main", "div"]), inner, "main", "content", "page", "wrapper"))

    def html(self) -> str:
        r = self.rng
        maybe = lambda share, *makers: "".join(self.wrapped(m()) for m in r.sample(makers, len(makers)) if r.random() < share)
        plain = r.random() < 0.35
        before = self.menu() + self.advert() if plain else maybe(0.45, self.header, self.menu, self.advert, self.notice, self.form, self.side)
        after = self.footer() if plain else maybe(
            0.45, self.side, self.comments, self.advert, self.notice, self.form, self.menu
        ) + maybe(0.8, self.footer)
        page = f"<!DOCTYPE html><html><head><title>{self.text(4, '')}</title><style>p{{margin:0}}</style></head><body>{self.wrapped(f'{before}<!-- {self.text(1)} -->{self.article()}{after}')}</body></html>"
        return page[: r.randint(len(page) // 3, len(page))] if r.random() < 0.1 else page


def labelled(seed: int) -> tuple[list[Block], list[bool]]:
    """Blocks of a made page and which of them are main text."""
    found = blocks(Page(random.Random(seed)).html())
    return [b._replace(text=b.text.replace(MARK, "").strip() or "-") for b in found], [MARK in b.text for b in found]


if __name__ == "__main__":
    import numpy as np

    from gaugework.llm.html_model import WEIGHTS, Labeller

    model = Labeller.fresh().fit([labelled(k) for k in range(9_000)])
    tests = [labelled(k) for k in range(10_000, 10_600)]
    got = model.main_blocks([p for p, _ in tests])
    right = sum(a == b for g, (_, y) in zip(got, tests, strict=True) for a, b in zip(g, y, strict=True))
    print(
        "blocks right:", right / sum(len(y) for _, y in tests), "pages right:", sum(g == y for g, (_, y) in zip(got, tests, strict=True)) / len(tests)
    )
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float32) for k, v in model.w.items()})
