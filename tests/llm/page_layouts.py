"""Made-up pages of many layouts, with the blocks that are their main text. They train and test the block model of html_cut."""

from __future__ import annotations

import random

SYLLABLES = "an be cor da el fi gu ho in ka lo me nor pa qui ra so ti un vel wo zu tha ing der schei eau cion".split()


class Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.content: list[str] = []

    def words(self, low: int, high: int, stop: str = ".") -> str:
        n = self.r.randint(low, high)
        text = " ".join("".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(n))
        return text.capitalize() + (stop if self.r.random() < 0.95 else "")

    def keep(self, text: str) -> str:
        self.content.append(text)
        return text

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{self.words(1, 3, "")}</a></{tag}>' for i in range(n))

    def body(self, heading: bool = True) -> str:
        """A heading, long and short paragraphs, now and then a list, a quotation, a table or a caption."""
        r, out = self.r, []
        if heading:
            out.append(f"<h1>{self.keep(self.words(3, 9, ''))}</h1>")
        for _ in range(r.randint(3, 9)):
            kind = r.random()
            if kind < 0.55:
                out.append(f"<p>{self.keep(self.words(20, 90))}</p>")
            elif kind < 0.8:
                out.append(f"<p>{self.keep(self.words(1, 6))}</p>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.keep(self.words(2, 12))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote>{self.keep(self.words(8, 30))}</blockquote>")
            elif kind < 0.94:
                out.append(f"<h2>{self.keep(self.words(1, 5, ''))}</h2>")
            elif kind < 0.97:
                a, b = self.words(2, 4, ""), self.words(10, 30, "")
                self.content.append(f"{b} {a}")
                out.append(f'<p>{b} <a href="/x">{a}</a></p>')
            else:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.keep(self.words(1, 3, ''))}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
        return "".join(out)

    def plain(self) -> str:
        """Text of boilerplate without links."""
        return self.words(3, 14) if self.r.random() < 0.7 else self.words(15, 45)

    def comments(self) -> str:
        return "".join(f"<div class=\"{self.r.choice(['comment', 'reply', 'comment-body'])}\"><p>{self.plain()}</p></div>" for _ in range(self.r.randint(1, 4)))

    def foot(self) -> str:
        return f"&copy; {self.words(1, 4, '')} {self.r.randint(1990, 2024)}. All rights reserved"


def html5(p: Page) -> str:
    return f"<header><a href=/>{p.words(1, 2, '')}</a></header><nav><ul>{p.links(6)}</ul></nav><div class=ad>{p.plain()}</div><article>{p.body()}</article><aside><h3>{p.words(1, 3, '')}</h3><p>{p.plain()}</p></aside><footer>{p.foot()}</footer>"


def cms(p: Page) -> str:
    return f'<div id="header"><h1>{p.words(1, 3, "")}</h1></div><div class="menu">{p.links(5, "span")}</div><div id="content"><div class="entry">{p.body()}</div><div id="comments"><h3>{p.words(1, 2, "")}</h3>{p.comments()}</div></div><div id="sidebar"><div class="widget"><p>{p.plain()}</p><ul>{p.links(4)}</ul></div></div><div id="footer"><p>{p.foot()}</p></div>'


def soup(p: Page) -> str:
    c = [f"x{p.r.randint(100, 999)}" for _ in range(5)]
    return f'<div class="{c[0]}"><ul>{p.links(7)}</ul></div><div class="{c[1]}"><div>{p.body()}</div></div><div class="{c[2]}"><div><ul>{p.links(5)}</ul></div><div><span>{p.words(1, 4, "")}</span></div></div><div class="{c[3]}">{p.foot()} <a href=/i>{p.words(1, 2, "")}</a> <a href=/j>{p.words(1, 2, "")}</a></div>'


def table(p: Page) -> str:
    return f'<table><tr><td colspan=3><b>{p.words(1, 3, "")}</b></td></tr><tr><td>{"".join(f"<a href=/{i}>{p.words(1, 2, str())}</a><br>" for i in range(6))}</td><td>{p.body(False)}</td><td class="ads"><p>{p.plain()}</p></td></tr><tr><td colspan=3>{p.foot()}</td></tr></table>'


def wrapped(p: Page) -> str:
    return f'<div class="content-sidebar-wrap"><article>{p.body()}</article><div class="sidebar"><p>{p.plain()}</p><ul>{p.links(4)}</ul></div></div><div class="site-footer">{p.foot()}</div>'


def unclosed(p: Page) -> str:
    return f"<nav>{p.links(4, 'span')}</nav><aside><p>{p.words(3, 12)}</p><article>{p.body()}</article><footer>{p.foot()}</footer>"


def crowded(p: Page) -> str:
    return f'<main><article class="post"><div class="byline-share"><a href=/s>{p.words(1, 1, "")}</a> <a href=/t>{p.words(1, 1, "")}</a></div>{p.body()}<div class="share-buttons">{p.links(3, "span")}</div><div class="related-posts"><h3>{p.words(2, 3, "")}</h3><ul>{p.links(4)}</ul></div><form class="newsletter"><p>{p.plain()}</p><button>{p.words(1, 2, "")}</button></form><section class="comments"><h3>{p.words(1, 2, "")}</h3>{p.comments()}</section></article></main>'


def notices(p: Page) -> str:
    return f'<a class="skip-link" href="#m">{p.words(2, 3, "")}</a><div id="cookie-notice"><p>{p.words(25, 60)}</p><button>{p.words(1, 1, "")}</button></div><div class="alert" role="alert">{p.plain()}</div><div id="m" class="story-text">{p.body()}</div><div class="pagination">{p.links(3, "span")}</div><div class="disclaimer"><p>{p.words(20, 50)}</p></div>'


def by_role(p: Page) -> str:
    return f'<div role="banner">{p.words(1, 3, "")}</div><div role="navigation">{p.links(5, "div")}</div><div role="main"><div class="breadcrumbs">{p.links(3, "span")}</div>{p.body()}</div><div role="complementary"><p>{p.plain()}</p></div><div role="contentinfo">{p.foot()}</div>'


def scientific(p: Page) -> str:
    return f'<main>{p.body()}<section id="discussion"><h2>{p.keep(p.words(1, 2, ""))}</h2><p>{p.keep(p.words(30, 90))}</p><p>{p.keep(p.words(30, 90))}</p></section></main><footer><p>{p.plain()}</p></footer>'


def deep_soup(p: Page) -> str:
    side = "".join(f"<div><h4>{p.words(1, 3, '')}</h4><p>{p.words(2, 9)}</p><p><a href=/m>{p.words(1, 3, '')}</a></p></div>" for _ in range(3))
    return f"<div><div>{p.links(5, 'span')}</div></div><div><div><div>{p.body()}</div></div><div>{side}</div></div><div><div><p>{p.foot()}</p></div></div>"


LAYOUTS = [html5, cms, soup, table, wrapped, unclosed, crowded, notices, by_role, scientific, deep_soup]


def page(layout, seed: int) -> tuple[str, list[str]]:
    """Html and the blocks of its main text, in order."""
    p = Page(seed)
    html = layout(p)
    return f"<!DOCTYPE html><html><head><title>{p.words(2, 5, '')}</title><style>p{{}}</style><script>var x='</p>';</script></head><body>{html}</body></html>", p.content


def pages(seed: int, each: int) -> list[tuple[str, list[str]]]:
    return [page(f, seed * 100_003 + 1009 * i + k) for i, f in enumerate(LAYOUTS) for k in range(each)]
