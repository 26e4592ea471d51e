"""Labelled pages to train the text extraction on: layouts of many kinds, filled with made-up words.

Regions that are the article are marked ``data-content="yes"``, all others
``"no"``. Which elements, classes and orders a page uses is drawn anew, so the
weights learn what layouts have in common.
"""

from __future__ import annotations

import random
from functools import cache

from seedloom.llm.page_text import Model, train

# Pages to train on; all are held at once.
N_PAGES = 600

# Words of class and id by kind of region, as sites use them.
_CLASSES = {
    "content": "content article post entry story main body text page primary article-body post-content entry-content story-body "
    "main-content article__content articleBody blog-post single hentry markdown inhalt beitrag contenu contenido",
    "nav": "nav menu navbar navigation main-menu topnav site-nav breadcrumb breadcrumbs toc pagination pager tabs links menue menu-item sitemap",
    "header": "header masthead top topbar site-header branding logo page-header banner-top kopf",
    "footer": "footer foot bottom site-footer colophon copyright legal imprint footer-links pie fuss",
    "aside": "sidebar side aside rail widget widgets secondary related recommended trending popular most-read more-stories tags seitenleiste",
    "notice": "cookie consent notice banner gdpr alert popup modal overlay privacy cookie-banner announcement toast message paywall hinweis aviso",
    "ad": "ad ads advert advertisement sponsored promo promotion adsense sponsor ad-slot adbox commercial dfp werbung anzeige publicite publicidad",
    "form": "form search newsletter subscribe signup login contact-form search-form subscription register",
    "comments": "comments comment discussion responses replies disqus comment-list respond reader-comments feedback kommentare commentaires comentarios",
    "share": "share social sharing share-buttons social-links follow addthis",
}
_ELEMENTS = {
    "nav": ("nav", "div", "ul", "nav", "section"), "header": ("header", "div", "header"), "footer": ("footer", "div", "footer", "section"),
    "aside": ("aside", "div", "section", "aside"), "notice": ("div", "section", "p", "aside", "dialog"), "ad": ("div", "aside", "section", "ins", "p"),
    "form": ("form", "form", "div"), "comments": ("section", "div", "ol", "ul", "aside"), "share": ("div", "ul", "p"),
}
_SYLLABLES = "th er on an re he in ed nd ha at en es or nt ea ti to it st io le is ou ar as de rt ve ü é ñ sch eau ción".split()


class _Writer:
    def __init__(self, rng: random.Random) -> None:
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        pick = self.rng.choice
        return " ".join("".join(pick(_SYLLABLES) for _ in range(self.rng.randint(1, 4))) for _ in range(self.rng.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        out, size = [], self.rng.randint(low, high)
        while size > 0:
            n = min(size, self.rng.randint(1, 18))
            text = self.words(n, n)
            if n > 6 and self.rng.random() < 0.5:
                text = text.replace(" ", ", ", 1)
            out.append(text.capitalize() + self.rng.choice("...?!"))
            size -= n
        text = " ".join(out)
        if self.rng.random() < 0.25:
            some = self.rng.choice(("<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>", "<span class='hl'>{}</span>", "<a class='ref' href='#'>{}</a>"))
            text += " " + some.format(self.words(1, 4)) + " " + self.words(1, 6) + "."
        return text

    def element(self, tag: str, inside: str, classes: str = "", mark: str = "", quiet: float = 0.0) -> str:
        attributes = ""
        if classes and self.rng.random() >= quiet:
            name = self.rng.choice(classes.split())
            if self.rng.random() < 0.3:
                name += self.rng.choice((" clearfix", " col-md-4", " wrapper", " block", " box", " container", " inner"))
            attributes = f' {self.rng.choice(("class", "class", "class", "id"))}="{name}"'
        if mark:
            attributes += f' data-content="{mark}"'
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def links(self, low: int, high: int) -> str:
        items = [f"<a href='/{n}'>{self.words(1, 4)}</a>" for n in range(self.rng.randint(low, high))]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.rng.choice((" | ", " ", "<br>", " &middot; ")).join(items)

    def paragraphs(self, low: int, high: int) -> str:
        made = []
        for _ in range(self.rng.randint(low, high)):
            tag = self.rng.choices(("p", "div", "bare"), (12, 1, 1))[0]
            size = self.rng.choice(((1, 3), (1, 3), (3, 12), (10, 60), (40, 150), (40, 150), (200, 500)))
            text = self.prose(*size)
            made.append(text + "<br><br>" if tag == "bare" else f"<p>{text}" + ("" if self.rng.random() < 0.1 else "</p>") if tag == "p" else f"<div>{text}</div>")
        return "".join(made)

    def noise(self, kind: str, mark: bool = True) -> str:
        r, tag = self.rng, self.rng.choice(_ELEMENTS[kind])
        if kind in ("nav", "share"):
            inside = self.links(2, 9) if tag != "ul" else "".join(f"<li><a href='#'>{self.words(1, 2)}</a></li>" for _ in range(r.randint(2, 8)))
        elif kind == "header":
            inside = r.choice((f"<h1><a href='/'>{self.words(1, 3)}</a></h1>", f"<div>{self.words(1, 3)}</div>", f"<p>{self.words(2, 6)}</p>", f"<h1>{self.words(1, 4)}</h1>")) + (self.noise("nav", False) if r.random() < 0.5 else "")
        elif kind == "footer":
            inside = r.choice(("&copy; ", "Copyright ", "")) + self.prose(2, 15) + (self.links(1, 6) if r.random() < 0.6 else "")
            inside = f"<p>{inside}</p>" if r.random() < 0.4 else inside
        elif kind == "aside":
            inside = f"<h3>{self.words(1, 3)}</h3>" + (self.links(2, 8) if r.random() < 0.6 else f"<p>{self.prose(5, 60)}</p>")
        elif kind == "notice":
            inside = r.choice(("<p>{}</p>", "{}", "<span>{}</span>")).format(self.prose(4, 40)) + r.choice(("", "<button>OK</button>", "<a href='#'>Accept</a>"))
        elif kind == "ad":
            inside = r.choice(("{}", "<p>{}</p>", "<a href='#'>{}</a>", "<span>Ad</span>{}")).format(self.prose(1, 40))
        elif kind == "form":
            inside = f"<label>{self.words(1, 4)}</label><input name='q'><p>{self.prose(2, 15)}</p><button>{self.words(1, 2)}</button>"
        else:
            item, who = ("li", "div") if tag in ("ol", "ul") else (r.choice(("div", "article", "p", "blockquote")), "span")
            one = lambda: self.element(item, f"<{who} class='author'>{self.words(1, 2)}</{who}>" + f"<p>{self.prose(3, 60)}</p>" * (item != "p") + self.prose(3, 50) * (item == "p"), "comment reply response kommentar")
            inside = ("" if tag in ("ol", "ul") else f"<h3>{self.words(1, 2)}</h3>") + "".join(one() for _ in range(r.randint(1, 6)))
            if tag not in ("ol", "ul") and r.random() < 0.35:
                inside = r.choice(("<ol>{}</ol>", "<ul>{}</ul>", "{}")).format("".join(f"<li><p>{self.prose(3, 60)}</p></li>" for _ in range(r.randint(1, 6))))
        # A semantic element often has no class.
        plain = tag in ("nav", "header", "footer", "aside", "form") and self.rng.random() < 0.9
        return self.element(tag, inside, _CLASSES[kind], "no" if mark else "", 0.5 if plain else 0.03)

    def body_of_article(self) -> str:
        r, parts = self.rng, []
        head = f"<h1>{self.words(2, 12)}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.2:
            head = f"<header>{head}" + (f"<p>{self.words(2, 6)}</p>" if r.random() < 0.5 else "") + "</header>"
        if r.random() < 0.2:
            head += r.choice(("<p class='byline'>{}</p>", "<div class='meta'><time>{}</time></div>", "<span class='author'>{}</span>")).format(self.words(2, 5))
        for _ in range(r.choice((1, 1, 2, 3, 4, 5, 6))):
            kind = r.choices(("p", "h", "list", "quote", "pre", "table", "figure", "dl", "section"), (12, 3, 2, 1, 1, 1, 1, 0.5, 1))[0]
            if kind == "p":
                parts.append(self.paragraphs(1, 6))
            elif kind == "h":
                level = r.randint(2, 4)
                parts.append(f"<h{level}>{self.words(1, 8)}</h{level}>" + self.paragraphs(1, 2))
            elif kind == "list":
                tag = r.choice(("ul", "ol"))
                parts.append(f"<{tag}>" + "".join(f"<li>{self.prose(1, 25)}</li>" for _ in range(r.randint(1, 7))) + f"</{tag}>")
            elif kind == "quote":
                parts.append(f"<blockquote><p>{self.prose(5, 50)}</p></blockquote>")
            elif kind == "pre":
                parts.append(f"<pre><code>{self.words(3, 30)}</code></pre>")
            elif kind == "table":
                row = lambda: "<tr>" + "".join(f"<td>{self.words(1, 3)}</td>" for _ in range(3)) + "</tr>"
                parts.append("<table>" + "".join(row() for _ in range(r.randint(1, 5))) + "</table>")
            elif kind == "figure":
                parts.append(f"<figure><img src='x.png'><figcaption>{self.prose(2, 15)}</figcaption></figure>")
            elif kind == "dl":
                parts.append("<dl>" + "".join(f"<dt>{self.words(1, 3)}</dt><dd>{self.prose(2, 20)}</dd>" for _ in range(2)) + "</dl>")
            else:
                parts.append(f"<section><h2>{self.words(1, 6)}</h2>{self.paragraphs(1, 4)}</section>")
        for kind in ("ad", "ad", "aside", "form", "notice", "share", "nav", "comments", "footer"):
            if r.random() < 0.22:
                # Comments and footers come last, the others anywhere.
                parts.insert(len(parts) if kind in ("comments", "footer") else r.randint(0, len(parts)), self.noise(kind))
        return head + "".join(parts)

    def page(self) -> str:
        r = self.rng
        tag = r.choices(("article", "main", "div", "section", "td"), (7, 2, 4, 1, 0.3))[0]
        quiet = 0.6 if tag in ("article", "main") else 0.15
        article = self.element("div" if tag == "td" else tag, self.body_of_article(), _CLASSES["content"], "yes", quiet)
        if r.random() < 0.06:
            article = ""
        around = [k for k in ("notice", "header", "nav", "nav", "ad", "form", "aside") if r.random() < 0.45]
        r.shuffle(around)
        after = [k for k in ("share", "aside", "ad", "comments", "nav", "form", "footer", "notice") if r.random() < 0.4]
        near = [k for k in ("ad", "aside", "comments", "share", "nav") if r.random() < 0.15]
        middle = article + "".join(self.noise(k) for k in near)
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            middle = self.element(r.choice(("div", "main", "section")), middle, "wrapper container page site content main layout row outer column primary wrap", "", 0.3)
        if tag == "td":
            middle = f"<table><tr><td data-content='no'>{self.links(2, 6)}</td><td>{middle}</td></tr></table>"
        body = "".join(self.noise(k) for k in around) + middle + "".join(self.noise(k) for k in after)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body data-content=\"no\">{body}</body></html>"


    def plain_page(self) -> str:
        """A bare article of a heading and paragraphs, often very short, between menu and footer; at times one region inside."""
        r = self.rng
        parts = [f"<p>{self.prose(*r.choice(((1, 3), (3, 30), (30, 150), (100, 400))))}</p>" for _ in range(r.choice((1, 1, 2, 3, 6)))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, len(parts)), self.noise(r.choice(("ad", "aside", "notice", "comments", "form", "nav", "share"))))
        article = f'<article data-content="yes"><h1>{self.words(2, 12)}</h1>{"".join(parts)}</article>'
        around = [self.noise(k) if r.random() < 0.6 else "" for k in ("nav", "ad", "comments", "aside", "footer")]
        body = "".join(around[:2]) + article + "".join(around[2:])
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body data-content=\"no\">{body}</body></html>"


def labelled_pages(count: int = N_PAGES, seed: int = 11) -> list[str]:
    """``count`` marked pages, the same for the same seed."""
    writer = _Writer(random.Random(seed))
    return [writer.plain_page() if n % 4 == 3 else writer.page() for n in range(count)]


@cache
def default_model() -> Model:
    """Trained once in a process, on the driver."""
    return train(labelled_pages())
