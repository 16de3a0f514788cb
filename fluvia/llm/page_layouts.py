"""Labelled training pages: random layouts of articles and boilerplate, whose article text bears a mark.

Layouts vary in what a site may choose: semantic elements, named or nameless ``div``s or table cells; where menus,
adverts, sidebars, notices, forms, comments and footers stand and how long and how linked they are; whether they lie
inside the article's element; how much text they bear beside that of the article; a form or several wrappers around the whole page; and classes that tell about the site or
the post (``has-...``, ``tag-...``, ``author-...``) on any element of the article. A part bears a telling name only
sometimes, so names can support a verdict but structure has to carry it. Words are random letters.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Mapping, Sequence

MARK = "⁣"

#: Names that the training pages draw class and id words from, by the part they stand for.
NAMES: Mapping[str, Sequence[str]] = {
    "menu": ("nav", "menu", "navbar", "main-menu", "breadcrumbs", "topnav", "site-navigation", "links"),
    "banner": ("header", "site-header", "masthead", "banner", "top-bar", "logo"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "adsbox"),
    "notice": ("cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "newsletter-popup"),
    "side": ("sidebar", "side", "widget", "related", "recommended", "trending-widget", "secondary", "widget-area"),
    "form": ("search", "login", "subscribe", "newsletter", "contact-form", "signup"),
    "comments": ("comments", "comment-list", "discussion", "responses", "disqus_thread", "comments-area", "replies"),
    "comment": ("comment", "comment-body", "reply"),
    "share": ("share", "social", "tags", "byline", "post-meta", "author", "share-buttons", "meta"),
    "foot": ("footer", "site-footer", "copyright", "legal", "colophon"),
    "article": ("post", "article", "content", "main-content", "story", "entry-content", "article-body", "post-body", "entry"),
    "wrapper": ("content", "page", "wrapper", "container", "main", "site", "layout"),
    "plain": ("clearfix", "row", "col-md-8", "col", "grid", "inner", "block", "section", "box"),
}


class _Writer:
    def __init__(self, rng: random.Random, names: Mapping[str, Sequence[str]]) -> None:
        self.rng, self.names, self.named, self.bulk = rng, names, 0.8, 1

    def word(self) -> str:
        return "".join(self.rng.choices("abcdefghijklmnopqrstuvwxyz", k=self.rng.randint(2, 9)))

    def words(self, low: int, high: int) -> str:
        """Words with the stops that running text has, the last one included; short ones are left bare."""
        rng, n = self.rng, self.rng.randint(low, high)
        out = [self.word() for _ in range(n)]
        if n >= 8 and rng.random() < 0.85:
            for i in range(rng.randint(4, 9), n, 9):
                out[i] += rng.choice((",", ".", "."))
            out[-1] = out[-1].rstrip(",.") + "."
        return " ".join(out)

    def site_words(self) -> list[str]:
        """Classes that tell about a site or a post; they name boilerplate without being any."""
        rng, out = self.rng, []
        other = lambda: rng.choice(self.names[rng.choice(("side", "menu", "comments", "banner", "advert", "share", "foot"))])
        made = (
            lambda: f"{rng.choice(('tag', 'category', 'author', 'topic'))}-{self.word()}",
            lambda: f"{rng.choice(('has', 'with', 'no', 'is'))}-{other()}",
            lambda: f"{other()}-{rng.choice(('left', 'right', 'on', 'off', 'open', 'active'))}",
            lambda: f"post-{rng.randint(1, 9999)}",
            lambda: rng.choice(("type-post", "status-publish", "hentry", "format-standard", "single")),
            lambda: rng.choice(self.names["plain"]),
        )
        for _ in range(rng.choice((1, 1, 2, 4, 7))):
            out.append(rng.choice(made)())
        return out

    def wrap(self, tag: str, inside: str, part: str = "", chance: float = 0.85, hidden: float = 0.0) -> str:
        rng, classes, attrs = self.rng, [], ""
        if part and rng.random() < chance * self.named:
            classes.append(rng.choice(self.names[part]))
        if part in ("article", "wrapper") and rng.random() < 0.35:
            classes += self.site_words()
        elif rng.random() < 0.25:
            classes.append(rng.choice((self.word(), rng.choice(self.names["plain"]))))
        rng.shuffle(classes)
        if len(classes) == 1 and rng.random() < 0.35:
            attrs = f' id="{classes[0]}"'
        elif classes:
            attrs = f' class="{" ".join(classes)}"'
        if rng.random() < hidden:
            attrs += rng.choice((' aria-hidden="true"', ' role="dialog"', ' role="complementary"'))
        return f"<{tag}{attrs}>{inside}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3 if self.rng.random() < 0.7 else 9)}</a>' for _ in range(self.rng.randint(low, high))]
        kind = self.rng.random()
        if kind < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<p>{x}</p>" for x in items) if kind < 0.8 else self.rng.choice((" ", " | ", "<br>")).join(items)

    # content

    def good(self, low: int, high: int) -> str:
        """Marked text, sometimes with inline elements."""
        text, rng = f"{MARK}{self.words(low, high)}", self.rng
        for _ in range(rng.choice((0, 0, 0, 1, 1, 3))):
            inline = rng.choice(("b", "em", "a", "a", "span", "i", "strong", "code", "math", "sup"))
            link = ' href="/x"' if inline == "a" else ' aria-hidden="true"' if inline == "span" and rng.random() < 0.2 else ""
            text += f" <{inline}{link}>{MARK}{self.words(1, 5)}</{inline}> {MARK}{self.words(1, 12)}."
        return text

    def good_list(self) -> str:
        """A list of the article; its items may be links, alone or with some words around."""
        rng, tag, linked = self.rng, self.rng.choice(("ul", "ul", "ol")), self.rng.random()
        items = []
        for _ in range(rng.randint(2, 8)):
            link = f'<a href="/{self.word()}">{MARK}{self.words(2, 9)}</a>'
            if linked < 0.3:
                items.append(link + (f" {MARK}{self.words(1, 12)}" if rng.random() < 0.5 else ""))
            else:
                items.append(self.good(2, 25))
        return f"<{tag}>" + "".join(f"<li>{x}" + rng.choice(("</li>", "</li>", "")) for x in items) + f"</{tag}>"

    def body(self) -> list[str]:
        rng = self.rng
        out = [self.title()] if rng.random() < 0.93 else []
        lengths = rng.choice((((1, 6),), ((1, 6), (5, 30), (20, 90), (60, 160)), ((5, 30), (20, 90), (60, 160))))
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8, 14, 30))):
            kind = rng.random()
            if kind < 0.08:  # a paragraph in one inline element, which many pages never close
                inline = rng.choice(("b", "b", "strong", "span", "em"))
                out.append(f"<p><{inline}>{self.good(1, 60)}" + rng.choice(("<br>", f"</{inline}></p>", "</p>")))
            elif kind < 0.68:
                out.append(self.wrap("p", self.good(*rng.choice(lengths)), "article", 0.03) if rng.random() < 0.1 else f"<p>{self.good(*rng.choice(lengths))}</p>")
            elif kind < 0.76:
                tag = rng.choice(("h2", "h3", "h4"))
                out.append(f"<{tag}>{self.good(1, 7)}</{tag}>")
            elif kind < 0.84:
                out.append(self.good_list())
            elif kind < 0.88:
                out.append(f"<blockquote><p>{self.good(8, 40)}</p></blockquote>")
            elif kind < 0.91:
                out.append(f'<figure><img src="x.png"><figcaption>{self.good(3, 12)}</figcaption></figure>')
            elif kind < 0.94:
                rows = "".join(f"<tr><td>{self.good(1, 3)}</td><td>{self.good(1, 6)}</td></tr>" for _ in range(rng.randint(2, 4)))
                out.append(f"<table>{rows}</table>")
            elif kind < 0.96:
                out.append(f"<pre>{self.good(5, 30)}</pre>")
            elif kind < 0.97:
                out.append(f"<dl><dt>{self.good(1, 3)}</dt><dd>{self.good(3, 20)}</dd></dl>")
            else:
                out.append(self.wrap("div", self.good(8, 60)))
        return out or [f"<p>{self.good(5, 90)}</p>"]

    def title(self) -> str:
        tag, text = self.rng.choice(("h1", "h1", "h1", "h2")), self.good(2, 12)
        inside = f"<{tag}><a href='/'>{text}</a></{tag}>" if self.rng.random() < 0.08 else self.wrap(tag, text)
        return self.wrap("header", inside) if self.rng.random() < 0.2 else inside

    # boilerplate

    def menu(self) -> str:
        tag = self.rng.choice(("nav", "nav", "div", "div", "menu"))
        return self.wrap(tag, self.links(3, 12), "menu", 0.9 if tag == "div" else 0.3)

    def banner(self) -> str:
        tag = self.rng.choice(("header", "header", "div"))
        inside = f'<a href="/">{self.words(1, 3)}</a>' + (f"<p>{self.words(2, 8 * self.bulk)}</p>" if self.rng.random() < 0.5 else "")
        if self.rng.random() < 0.4:
            inside = f"<h1>{self.words(1, 4)}</h1>" + inside
        return self.wrap(tag, inside + (self.menu() if self.rng.random() < 0.5 else ""), "banner", 0.9 if tag == "div" else 0.3)

    def advert(self) -> str:
        return self.wrap(self.rng.choice(("div", "div", "div", "section", "aside")), self.some(1, 2, 3, 25), "advert", 1.2, 0.05)

    def notice(self) -> str:
        inside = self.some(1, 2, 4, 30) + self.rng.choice(("", f"<button>{self.words(1, 2)}</button>"))
        return self.wrap(self.rng.choice(("div", "div", "section", "dialog")), inside, "notice", 1.2, 0.3)

    def side(self) -> str:
        tag = self.rng.choice(("aside", "aside", "div"))
        inside = f"<h3>{self.words(1, 4)}</h3>" + self.rng.choice((self.links(2, 9), self.some(1, 3, 5, 40)))
        if self.rng.random() < 0.3:
            inside += self.wrap("div", self.links(3, 9), "side", 0.5)
        return self.wrap(tag, inside, "side", 1.15 if tag == "div" else 0.4, 0.08)

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input>" for _ in range(self.rng.randint(1, 3)))
        inside = (f"<p>{self.words(3, 15)}</p>" if self.rng.random() < 0.5 else "") + fields + f"<button>{self.words(1, 2)}</button>"
        return self.wrap("form", inside, "form", 0.5)

    def comments(self) -> str:
        one, longest = [], self.rng.choice((20, 70, 70, 160))
        tag = self.rng.choice(("div", "li", "article"))
        for _ in range(self.rng.choice((1, 2, 3, 5, 9, 14))):
            inside = f"<span>{self.words(1, 2)}</span>" + "".join(f"<p>{self.words(3, longest)}</p>" for _ in range(self.rng.choice((1, 1, 2))))
            one.append(self.wrap(tag, inside, "comment", 1.2 if tag == "article" else 0.9))
        inside = f"<h3>{self.words(1, 3)}</h3>" + "".join(one)
        return self.wrap(self.rng.choice(("div", "section", "ol")), inside, "comments", 1.2)

    def share(self) -> str:
        return self.wrap(self.rng.choice(("div", "ul", "p")), "".join(f'<a href="/s">{self.words(1, 2)}</a> ' for _ in range(3)), "share", 1.2)

    def foot(self) -> str:
        tag = self.rng.choice(("footer", "footer", "div"))
        inside = self.rng.choice((self.words(3, 25 * self.bulk), self.some(1, 3, 3, 30), self.links(2, 6) + f"<p>{self.words(3, 12)}</p>"))
        return self.wrap(tag, inside, "foot", 1.15 if tag == "div" else 0.3)

    def some(self, low: int, high: int, least: int, most: int) -> str:
        """Plain texts of boilerplate, bare or in paragraphs."""
        texts = [self.words(least, most * self.bulk) for _ in range(self.rng.randint(low, high))]
        return texts[0] if len(texts) == 1 and self.rng.random() < 0.5 else "".join(f"<p>{t}</p>" for t in texts)

    def main(self, body: list[str]) -> str:
        """The article's element, with wrappers of its own inside and around."""
        rng = self.rng
        if rng.random() < 0.25:  # title outside, text in an element of its own
            body = [body[0], self.wrap("div", "".join(body[1:]), "article", 0.6)] if len(body) > 1 else body
        tag = rng.choice(("article", "article", "article", "main", "div", "div", "section"))
        out = self.wrap(tag, "".join(body), "article", 0.9 if tag in ("div", "section") else 0.35)
        for _ in range(rng.choice((0, 0, 1, 2))):
            out = self.wrap(rng.choice(("main", "div", "div", "section")), out + (self.side() if rng.random() < 0.25 else ""), "wrapper")
        return out

    def page(self) -> str:
        rng, body = self.rng, self.body()
        self.named, self.bulk = rng.choice((0.9, 0.9, 0.9, 0.6)), rng.choice((1, 1, 1, 3, 6))
        if rng.random() < 0.12:  # nothing but the text
            for _ in range(rng.choice((0, 1, 2))):
                body = [self.wrap("div", "".join(body), "article", 0.3)]
            return "".join(body[rng.choice((0, 0, 1)) :] or body)
        inner = (self.advert, self.share, self.side, self.form, self.notice)
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            body.insert(rng.randint(min(1, len(body)), len(body)), rng.choice(inner)())
        if rng.random() < 0.15:
            body.append(self.comments())
        if rng.random() < 0.1:
            body.append(self.foot())
        main = self.main(body)
        before = [f() for f in (self.notice, self.banner, self.menu, self.advert, self.form, self.side) if rng.random() < 0.4]
        after = [f() for f in (self.side, self.comments, self.share, self.form, self.advert, self.menu, self.notice) if rng.random() < 0.3]
        rng.shuffle(after)
        if rng.random() < 0.8:
            after.append(self.foot())
        if rng.random() < 0.06:  # columns by a table
            cells = [f"<td>{''.join(before)}</td>", f"<td>{main}</td>", f"<td>{''.join(after)}</td>"]
            inside = f"<table><tr>{''.join(cells)}</tr></table>"
        else:
            inside = "".join((*before, main, *after))
        if rng.random() < 0.12:
            inside = self.wrap("form", inside, "form", 0.1)
        for _ in range(rng.choice((0, 0, 1, 2))):
            inside = self.wrap("div", inside, "wrapper")
        if rng.random() < 0.2:  # a page without the outermost elements
            return inside
        classes = f' class="{" ".join(self.site_words())}"' if rng.random() < 0.4 else ""
        return f"<html><head><title>{self.words(2, 6)}</title></head><body{classes}>{inside}</body></html>"


def labelled_pages(count: int, seed: int, names: Mapping[str, Sequence[str]] = NAMES) -> Iterator[str]:
    """Pages whose parts are named by ``names``; the same arguments give the same pages."""
    writer = _Writer(random.Random(seed), names)
    for _ in range(count):
        yield writer.page()
