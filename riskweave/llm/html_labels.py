"""Labelled training pages: common layouts of web pages, composed by rule.

The test tables hold pages without labels, so the extractor is trained on pages that are put
together here from the usual parts (menus, headers, articles, adverts, notices, forms, comments, sidebars,
footers) in varying order, markup and nesting. Elements of the main text carry data-main="1"; the
mark is a label and never a feature. Words are random letters: only markup, lengths, punctuation and
a few cue phrases can be learned.
"""

from __future__ import annotations

import random


class _Page:
    def __init__(self, rng: random.Random):
        self.r = rng

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice("aeioubdfglmnrst") for _ in range(r.randint(2, 9)))
                        for _ in range(r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        value = self.words(low, high)
        if self.r.random() < 0.4:
            value = value.replace(" ", ", ", 1)
        return value[0].upper() + value[1:] + self.r.choice("....!?")

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, 6)))

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(low, high)}</a>'

    def some(self, *options):
        return self.r.choice(options)

    def links(self, n: int) -> str:
        kind = self.some("ul", "ul", "div", "p")
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return f"<{kind}>" + " | ".join(self.link() for _ in range(n)) + f"</{kind}>"

    def menu(self) -> str:
        inner = self.links(self.r.randint(3, 9))
        return self.some(f"<nav>{inner}</nav>", f'<div class="menu">{inner}</div>', inner,
                         f'<div id="main-nav">{inner}</div>', f"<header>{inner}</header>",
                         f'<ul class="breadcrumb"><li>{self.link()}</li><li>{self.link()}</li></ul>')

    def header(self) -> str:
        name = self.words(1, 3)
        return self.some(f"<header><div>{name}</div><p>{self.words(2, 6)}</p></header>",
                         f'<div class="site-header"><h1>{name}</h1>{self.sentence(3, 8)}</div>',
                         f'<div id="masthead"><a href="/">{name}</a></div>', "")

    def advert(self) -> str:
        value = self.some(self.sentence(), self.prose(), "Advertisement", self.link(3, 8))
        name = self.some("ad", "ads", "advert", "sponsored-box", "promo", "ad-slot")
        return self.some(f'<div class="{name}">{value}</div>', f'<div id="{name}"><p>{value}</p></div>',
                         f'<aside class="{name}"><p>{value}</p></aside>',
                         f'<section class="{name} wide"><h3>{self.words(1, 4)}</h3>{value}</section>')

    def notice(self) -> str:
        value = self.some("We use cookies. " + self.sentence(), self.prose(),
                          "Subscribe to our newsletter. " + self.sentence())
        name = self.some("cookie-notice", "notice", "consent", "newsletter", "alert", "popup")
        return self.some(f'<div class="{name}"><p>{value}</p></div>',
                         f'<div class="{name}">{value}<button>{self.words(1, 2)}</button></div>',
                         f'<div role="alert">{value}</div>', f"<noscript>{value}</noscript>",
                         f'<dialog class="{name}"><p>{value}</p></dialog>')

    def form(self) -> str:
        return (f"<form><label>{self.words(1, 4)}</label><input name=q><select><option>"
                f"{self.words(1, 2)}<option>{self.words(1, 2)}</select><p>{self.sentence()}</p>"
                f"<button>{self.words(1, 2)}</button></form>")

    def side(self) -> str:
        inner = f"<h3>{self.words(1, 3)}</h3>" + self.some(
            self.links(4), f"<p>{self.prose()}</p>", f"<ul><li>{self.sentence()}<li>{self.link()}</ul>")
        name = self.some("sidebar", "related", "widget", "right-rail")
        return self.some(f"<aside>{inner}</aside>", f'<div class="{name}">{inner}</div>',
                         f'<div id="{name}">{inner}</div>', f'<section class="{name}">{inner}</section>')

    def comments(self) -> str:
        one = lambda: self.some(
            f'<div class="comment"><b>{self.words(1, 2)}</b><p>{self.prose()}</p></div>',
            f'<li class="comment-body"><p>{self.prose()}</p><a href="#">Reply</a></li>',
            f'<article class="comment"><p>{self.prose()}</p></article>')
        inner = f"<h2>{self.words(1, 2)}</h2>" + "".join(one() for _ in range(self.r.randint(1, 5)))
        return self.some(f'<section id="comments">{inner}</section>',
                         f'<div class="comments">{inner}</div>',
                         f'<ol class="comment-list">{inner}</ol>')

    def footer(self) -> str:
        value = self.some("&copy; ", "Copyright ", "") + self.words(1, 3) + " &middot; " + self.sentence()
        return self.some(f"<footer>{value}</footer>", f"<footer><p>{value}</p>{self.links(3)}</footer>",
                         f'<div class="footer">{value}</div>', f'<div id="foot">{value}</div>')

    def body(self) -> str:
        """Main text: what an article consists of."""
        r, out = self.r, []
        title = self.some(self.words(1, 9).title(), self.sentence(2, 9), self.words(6, 14))
        if r.random() < 0.85:
            head = f"<h1>{title}</h1>"
            if r.random() < 0.15:
                head = f"<header>{head}<p>{self.words(2, 4)}</p></header>"
            out.append(head)
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            p = self.prose() if kind > 0.12 else self.some(self.words(1, 3), self.sentence(1, 3))
            if r.random() < 0.1:
                p = p.replace(" ", f" {self.link()} ", 1)
            if r.random() < 0.1:
                p = f"<b>{p}" + self.some("</b>", "<br>", "<br>")
            out.append(p if r.random() < 0.03 else f"<p>{p}" + self.some("</p>", "</p>", ""))
            if r.random() < 0.12:
                out.append(self.some(
                    f"<h2>{self.words(1, 5)}</h2>", f"<blockquote>{self.prose()}</blockquote>",
                    f"<ul><li>{self.sentence()}</li><li>{self.sentence()}</li></ul>",
                    f"<table><tr><td>{self.words(1, 3)}<td>{r.randint(1, 999)}</table>",
                    f"<pre>{self.words(3, 20)}</pre>",
                    f"<figure><img src=x><figcaption>{self.sentence()}</figcaption></figure>"))
            if r.random() < 0.1:
                out.append('<div data-main="0">' + self.some(
                    self.advert(), self.notice(), self.form(), self.side(),
                    f'<div class="share">{self.links(3)}</div>') + "</div>")
        return "".join(out)

    def page(self) -> str:
        r = self.r
        inner = self.body()
        if r.random() < 0.15:
            inner += f'<div data-main="0">{self.comments()}</div>'
        open_tag, close = self.some(
            ("<article", "</article>"), ("<article", "</article>"), ("<main", "</main>"),
            ("<main><article", "</article></main>"), ('<div class="content"', "</div>"),
            ('<div id="post-body"', "</div>"), ('<section class="entry"', "</section>"),
            ("<div", "</div>"), ('<article class="post"', "</article>"))
        main = f'{open_tag} data-main="1">{inner}{close}'
        before = [p() for p in (self.header, self.menu, self.notice, self.advert, self.form)
                  if r.random() < 0.55]
        after = [p() for p in (self.advert, self.side, self.comments, self.notice, self.form, self.menu)
                 if r.random() < 0.4]
        r.shuffle(before)
        r.shuffle(after)
        foot = self.footer() if r.random() < 0.85 else ""
        return (f"<!DOCTYPE html><html><head><title>{self.words(1, 6)}</title></head><body>"
                + "".join(before) + "<!-- x -->" + main + "".join(after) + foot
                + self.some("</body></html>", ""))


def labelled_pages(n: int, seed: int) -> list[str]:
    """n pages whose main text is marked; the same for the same arguments everywhere."""
    rng = random.Random(seed)
    return [_Page(rng).page() for _ in range(n)]
