"""Labelled pages to learn from: layouts put together from ways to mark up main text and what stands around it.

Elements marked data-main hold main text. Names are common ones of class, id and role attributes; in a third of the pages most names say nothing, so that
lengths and links have to tell. All choices come from a seeded generator.
"""

from __future__ import annotations

import random

#: Where main text stands, from the outside in.
PLACES = ["article", "main section", "main article section", "div#content", "div.post div.entry-content", "div.article-body", "div#main div.story.text", "table tr td", "div div", "section div", "", "body div.page div.container.wrapper article", "div.row div.col article.post section", "main div.markdown", "div.a1 div.x7"]
#: What stands around it.
AROUND = {
    "nav": ["nav", "div.menu", "div#navigation", "ul.nav.navbar", "div.topnav", "div.breadcrumb", "div.breadcrumbs.trail", "div[navigation]", "div.pagination.pager", "div.mainmenu", "div.toc", "div.topnavigation"],
    "header": ["header", "div#header", "div.masthead", "div.site-header.branding", "div[banner]", "div.logo", "div.topbar.toolbar"],
    "footer": ["footer", "div#footer", "div.site-footer", "div.copyright", "div[contentinfo]", "div.legal.imprint", "div.footnotes.credits", "div.bottom.colophon"],
    "side": ["aside", "div.sidebar", "div#sidebar", "div.widget", "div.rail", "div.right-rail", "div.related", "div.more-stories", "div.recommended.popular", "div.trending", "div[complementary]", "section.related-posts", "div#secondary"],
    "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.ad-slot.banner", "div.sponsored", "div.promo", "div#ad-top", "aside.advertising", "div.promotion.teaser"],
    "notice": ["div.cookie", "div.cookie-consent", "div.notice", "div.popup.modal", "div.alert", "div.newsletter", "div.subscribe", "div.paywall", "div#gdpr", "div[alert]", "div.announcement.warning"],
    "form": ["form", "form.search", "form.login", "form.newsletter-signup", "div.searchbox form", "form#subscribe"],
    "comments": ["section.comments", "div#comments", "div.comment-list", "ol.commentlist", "div#disqus", "div.replies.responses", "section.discussion.thread", "div.comment", "div.user-comments.reader"],
    "share": ["div.share", "div.social", "div.follow.share-buttons", "ul.social-links"],
}
PLAIN = ["div", "div", "section", "div.b2", "div.q9.z3", "ul", "td"]
_WORDS = "the morning train left valley late and people on platform talked about rain that had come over hills while river rose near old mill town market where bread was sold before winter began they walked home with lamps in small groups because bridge had been closed since noon a letter came from north about work at harbour which none of them believed until it stood in print".split()


def _opened(path: str) -> tuple[str, str]:
    """Opening and closing tags of a path such as `div#id.class section[role]`."""
    begin, end = "", ""
    for step in path.split():
        name, role = (step.rstrip("]").split("[") + [""])[:2]
        names = name.replace("#", ".#").split(".")
        classes, ids = [n for n in names[1:] if n[0] != "#"], [n[1:] for n in names[1:] if n[0] == "#"]
        extra = (f' class="{" ".join(classes)}"' if classes else "") + (f' id="{ids[0]}"' if ids else "") + (f' role="{role}"' if role else "")
        begin, end = f"{begin}<{names[0]}{extra}>", f"</{names[0]}>{end}"
    return begin, end


class Page:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.silent = seed % 3 == 2
        self.bare = seed % 4 == 0  # sentences without stops

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(_WORDS) for _ in range(self.rng.randint(low, high))).capitalize()

    def prose(self, low: int, high: int) -> str:
        """Sentences, now and then with an inline element or a link."""
        out, left = [], self.rng.randint(low, high)
        while left > 0:
            n = min(left, self.rng.randint(4, 18))
            s = self.words(n, n)
            kind = self.rng.randrange(12)
            out.append((f"<b>{s}</b>" if kind == 0 else f'{s} <a href="/x">{self.words(1, 3)}</a>' if kind == 1 else s) + ("" if self.bare or not self.rng.randrange(12) else "."))
            left -= n
        return " ".join(out)

    def links(self, low: int, high: int, words: int) -> str:
        item = lambda: f'<li><a href="/l">{self.words(1, words)}</a></li>'
        return "<ul>" + "".join(item() for _ in range(self.rng.randint(low, high))) + "</ul>"

    def around(self, role: str) -> str:
        r = self.rng
        if self.silent and role in ("comments", "notice", "ad"):
            return ""
        begin, end = _opened(r.choice(PLAIN if self.silent and role != "form" else AROUND[role] if r.randrange(3) else AROUND[role][:1]))
        inner = {
            "nav": lambda: self.links(3, 9, 2) if r.randrange(3) else " | ".join(f'<a href="/n">{self.words(1, 2)}</a>' for _ in range(5)),
            "header": lambda: f'<a href="/">{self.words(1, 3)}</a> <span>{self.words(2, 6) if self.silent or r.randrange(3) else self.prose(4, 16)}</span>' + (self.links(2, 5, 2) if r.randrange(2) else ""),
            "footer": lambda: f"&copy; {self.words(2, 14)}" + ("" if r.randrange(2) else f"<p>{self.words(3, 12)}</p>" if self.silent or r.randrange(2) else f" &middot; {self.prose(4, 40)}") + (self.links(2, 6, 2) if r.randrange(2) else ""),
            "side": lambda: f"<h3>{self.words(1, 4)}</h3>" + (self.links(3, 8, 9) if r.randrange(3) or self.silent else f"<p>{self.prose(6, 25)}</p>"),
            "ad": lambda: f"<p>{self.prose(2, 16)}</p>" if r.randrange(2) else self.prose(2, 16),
            "notice": lambda: f'<p>{self.prose(6, 30)}</p><button>{self.words(1, 2)}</button>' if r.randrange(2) else self.prose(6, 30),
            "form": lambda: f"<label>{self.words(1, 4)}</label><input><button>{self.words(1, 2)}</button><p>{self.words(3, 14)}</p>",
            "comments": lambda: f"<h3>{self.words(1, 3)}</h3>" + "".join(f'<div><a href="/u">{self.words(1, 2)}</a><p>{self.prose(3, 40)}</p></div>' for _ in range(r.randint(1, 5))),
            "share": lambda: " ".join(f'<a href="/s">{self.words(1, 1)}</a>' for _ in range(4)),
        }[role]()
        return begin + inner + end

    def main(self) -> str:
        r = self.rng
        begin, end = _opened(r.choice(PLACES))
        out = [f"<h1 data-main>{self.words(3, 12)}</h1>"]
        if r.randrange(4) == 0:  # text broken by br, as old pages have it
            out.append(f"<div data-main>{self.prose(30, 90)}<br><br>{self.prose(20, 60)}<br>{self.prose(1, 8)}</div>")
        for _ in range(r.randint(2, 9)):
            out.append(f"<p data-main>{self.prose(*r.choice([(1, 3), (4, 20), (20, 60), (40, 120)]))}</p>")
            kind = r.randrange(16)
            if kind == 0:
                out.append("<ul data-main>" + "".join(f"<li>{self.prose(2, 14)}</li>" for _ in range(3)) + "</ul>")
            elif kind == 1:
                out.append(f"<h2 data-main>{self.words(2, 7)}</h2>")
            elif kind == 2:
                out.append(f"<blockquote data-main><p>{self.prose(6, 40)}</p></blockquote>")
            elif kind == 3:
                out.append("<table data-main>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind == 4:
                out.append(f"<pre data-main>{self.words(4, 20)}</pre>")
            elif kind == 5:
                out.append(f"<section data-main><h3>{self.words(2, 5)}</h3><p>{self.prose(8, 60)}</p></section>")
            elif kind == 6:
                out.append(f"<figure data-main><figcaption>{self.prose(4, 16)}</figcaption></figure>")
            elif kind == 7:
                out.append(f"<dl data-main><dt>{self.words(1, 3)}</dt><dd>{self.prose(4, 16)}</dd></dl>")
            elif kind == 8:
                out.append(self.around(r.choice(["ad", "share", "notice"])))
        return begin + "".join(out) + end

    def html(self) -> str:
        if self.rng.randrange(8) == 0:  # a page of little more than a text
            if self.rng.randrange(4) == 0:
                return f"<body data-main>{self.prose(*self.rng.choice([(3, 12), (10, 40)]))}</body>"
            begin, end = _opened(self.rng.choice(PLACES))
            tag = self.rng.choice(["p", "p", "div"])
            return begin + "".join(f"<{tag} data-main>{self.prose(*self.rng.choice([(3, 12), (10, 40)]))}</{tag}>" for _ in range(self.rng.choice([1, 1, 2, 3]))) + end
        some = lambda *roles: "".join(self.around(x) for x in roles if self.rng.randrange(3))
        return f"<html><head><title>{self.words(3, 8)}</title></head><body>" + some("notice", "header", "nav", "ad", "side") + self.main() + some("share", "form", "side", "comments", "ad", "nav", "footer") + "</body></html>"


def pages(n: int = 360) -> list[str]:
    """n labelled pages."""
    return [Page(k).html() for k in range(n)]
