"""Training pages: pages of known main text in many layouts, made of the words of given pages.

Layouts, tags and class names are drawn with a seeded generator; a part of the pages has no telling
names at all, so that the trees must learn from density, depth and siblings too."""

from __future__ import annotations

import random
from html import escape

# Words that sites use as class names, by what they mark.
CONTENT = "article content main post body entry story text prose markdown page-content post-body article-body entry-content story-body main-content".split()
WRAPS = "wrap wrapper container page row col layout site inner grid section block outer app root".split()
NOISE = {
    "menu": "nav menu navbar navigation topnav main-menu dropdown breadcrumb breadcrumbs tabs pagination pager toc skip-links".split(),
    "header": "header site-header masthead branding topbar logo hero-bar page-header".split(),
    "footer": "footer site-footer copyright legal colophon bottom page-footer credits".split(),
    "sidebar": "sidebar aside widget rail side secondary related recommended trending popular tags archive more-posts".split(),
    "notice": "cookie notice consent alert banner-notice gdpr message popup modal overlay toast warning announcement cookie-banner".split(),
    "advert": "ad ads advert advertisement sponsored promo banner sponsor ad-slot adsbygoogle promotion commercial".split(),
    "form": "form search login subscribe newsletter signup search-form contact-form register".split(),
    "comments": "comments comment comment-list replies reply discussion disqus respond thread reader-comments responses".split(),
    "embedded": "embed player video chart map lazy fallback no-js nojs captcha widget".split(),
    "share": "share social sharing share-buttons social-links follow byline-tools toolbar print-tools".split(),
}
_TAGS = {
    "menu": ["nav", "nav", "ul", "div"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"],
    "sidebar": ["aside", "aside", "div", "section"], "notice": ["div", "div", "section", "aside"], "advert": ["div", "div", "aside", "section"],
    "form": ["form", "form", "div"], "comments": ["section", "div", "ol", "ul", "aside"], "share": ["div", "ul", "p"],
    "embedded": ["noscript", "noscript", "iframe", "object", "canvas", "select", "textarea"],
}


class Maker:
    """Writes pages; content() marks what it writes as main text by collecting it."""

    def __init__(self, words: list[str], seed: int) -> None:
        self.r, self.words = random.Random(seed), words

    def some(self, low: int, high: int) -> str:
        at, count = self.r.randrange(len(self.words)), self.r.randint(low, high)
        return " ".join((self.words * (1 + count // max(1, len(self.words)) + 1))[at : at + count])

    def attrs(self, kind: str, plain: bool, single: bool = True) -> str:
        names = CONTENT if kind == "content" else WRAPS if kind == "wrap" else NOISE[kind]
        if plain or self.r.random() < 0.12:
            return self.r.choice(["", "", f' class="c{self.r.randrange(10**6)}x"', ' class="box"'])
        chosen = [self.r.choice(names)]
        if self.r.random() < 0.35:
            chosen.append(self.r.choice(WRAPS + ["left", "right", "clearfix", "small", "wide", "dark", "js"]))
        joined = self.r.choice(["-", "_"]).join(chosen) if self.r.random() < 0.3 else " ".join(chosen)
        return f' {self.r.choice(["class", "class", "class", "id"])}="{joined}"'

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randrange(10**5)}">{escape(text)}</a>'

    def inline(self, text: str) -> str:
        parts = text.split(" ")
        if len(parts) > 6 and self.r.random() < 0.35:
            at, end = sorted(self.r.sample(range(len(parts)), 2))
            end = min(end, at + 6)
            wrap = self.r.choice(["b", "i", "em", "strong", "span", "code", "a"])
            inner = " ".join(escape(p) for p in parts[at:end])
            return " ".join([*map(escape, parts[:at]), f"<{wrap}>{inner}</{wrap}>", *map(escape, parts[end:])])
        return escape(text)

    def items(self, low: int, high: int, words: tuple[int, int], linked: bool) -> str:
        made = []
        for _ in range(self.r.randint(low, high)):
            text = self.some(*words)
            made.append(f"<li>{self.link(text) if linked else self.inline(text)}</li>")
        return "<ul>" + "".join(made) + "</ul>"

    def noise(self, kind: str, plain: bool) -> str:
        r, tag = self.r, self.r.choice(_TAGS[kind])
        if kind == "menu":
            inner = self.items(2, 9, (1, 3), True) if tag != "ul" else self.items(2, 9, (1, 3), True)[4:-5]
            inner = inner if r.random() < 0.8 or tag == "ul" else " | ".join(self.link(self.some(1, 2)) for _ in range(r.randint(2, 6)))
        elif kind == "header":
            inner = r.choice([f"<h1>{self.link(self.some(1, 3))}</h1>", f"<div>{self.some(1, 4)}</div>"]) + r.choice(["", f"<p>{self.some(3, 12)}</p>", self.items(2, 6, (1, 2), True)])
        elif kind == "footer":
            mark = r.choice(["&copy; ", "&copy; ", "© 2024 ", "Copyright ", ""])
            inner = mark + f"www.{self.some(1, 1).lower()}.example.com {r.choice(['&middot; ', '| ', ''])}{self.some(2, 25)}"
            inner = r.choice([inner, f"<p>{inner}</p>", f"<p>{inner}</p>" + self.items(2, 6, (1, 3), True)])
        elif kind == "sidebar":
            inner = f"<h3>{self.some(1, 3)}</h3>" + r.choice([self.items(2, 7, (2, 9), True), f"<p>{self.some(5, 40)}</p>", self.items(2, 5, (1, 4), False)])
        elif kind == "notice":
            inner = r.choice(["{}", "<p>{}</p>", "<span>{}</span>"]).format(self.some(4, 40)) + r.choice(["", "<button>" + self.some(1, 2) + "</button>", self.link(self.some(1, 3))])
        elif kind == "advert":
            inner = r.choice(["{}", "{}", "<p>{}</p>", "<a href='/x'>{}</a>", "<div>{}</div>", "<h4>Ad</h4><p>{}</p>"]).format(self.some(2, 50))
        elif kind == "form":
            inner = f"<label>{self.some(1, 4)}</label><input name=q>" + r.choice(["", f"<p>{self.some(4, 25)}</p>", f"<select><option>{self.some(1, 3)}</option></select>", f"<textarea>{self.some(1, 9)}</textarea>"]) + f"<button>{self.some(1, 2)}</button>"
        elif kind == "embedded":
            inner = r.choice(["{}", "{}", "<span>{}</span>", "<p>{}</p>" if tag in ("noscript", "object") else "{}"]).format(self.some(1, 30))
        elif kind == "share":
            inner = " ".join(self.link(self.some(1, 2)) for _ in range(r.randint(2, 5)))
            inner = "".join(f"<li>{x}</li>" for x in inner.split("> ")) if tag == "ul" else inner
        else:
            made = []
            for _ in range(r.randint(1, 8)):
                own = "li" if tag in ("ol", "ul") else r.choice(["div", "div", "article", "li"])
                who = r.choice(["", f"<h4>{self.some(1, 2)}</h4>", f"<span>{self.some(1, 2)}</span> ", f"<cite>{self.some(1, 2)}</cite>"])
                said = r.choice(["<p>{}</p>", "<p>{}</p>", "{}", "<div>{}</div>"]).format(self.some(3, 90))
                made.append(f"<{own}{self.attrs('comments', plain)}>{who}{said}</{own}>")
            inner = r.choice([f"<h3>{self.some(1, 3)}</h3>", "", f"<h2>{r.randint(1, 90)} comments</h2>"]) * (tag not in ("ol", "ul")) + "".join(made)
        return f"<{tag}{self.attrs(kind, plain)}>{inner}</{tag}>"

    def content(self, plain: bool) -> str:
        """Blocks of main text; the text they hold is between the marks \\x01 and \\x02."""
        r, made = self.r, []
        mark = lambda tag, inner, close=True: f"<{tag}>\x01{inner}\x02" + (f"</{tag}>" if close else "")
        if r.random() < 0.85:
            made.append(mark(r.choice(["h1", "h1", "h2"]), self.inline(self.some(2, 14))))
        count, long = r.choice([0, 1, 1, 2, 3, 4, 6, 8, 12, 16]), r.choice([8, 25, 60, 120])
        open_p = r.random() < 0.3
        for _ in range(count + (not made)):
            kind = r.random()
            if kind < 0.72:
                text = self.inline(self.some(1, long))
                if open_p and r.random() < 0.4:
                    made.append(f"<p><b>\x01{text}\x02<br>")
                else:
                    made.append(mark("p", text, not open_p or r.random() < 0.7))
            elif kind < 0.8:
                made.append(mark(r.choice(["h2", "h3", "h4"]), self.some(1, 8)))
            elif kind < 0.88:
                made.append("<ul>" + "".join(mark("li", self.inline(self.some(1, 20))) for _ in range(r.randint(1, 6))) + "</ul>")
            elif kind < 0.91:
                made.append("<blockquote>" + mark("p", self.some(4, 50)) + "</blockquote>")
            elif kind < 0.93:
                rows = "".join("<tr>" + "".join(mark("td", self.some(1, 4)) for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 4)))
                made.append(f"<table>{rows}</table>")
            elif kind < 0.95:
                made.append("<figure><img src=x>" + mark("figcaption", self.some(2, 14)) + "</figure>")
            elif kind < 0.97:
                made.append(mark("pre", self.some(3, 30)))
            elif not plain:
                made.append(self.noise(r.choice(["advert", "advert", "share", "sidebar", "form", "notice", "embedded"]), False))
            elif kind < 0.98:
                made.append(self.noise("embedded", True))
            else:
                made.append(mark("div", self.inline(self.some(3, long))))
        return "".join(made)

    def page(self) -> str:
        r = self.r
        plain = r.random() < 0.12
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        tag = r.choice([tag, "div"]) if plain else tag
        own = self.attrs("content", plain) if tag == "div" or r.random() < 0.5 else ""
        middle = f"<{tag}{own}>{self.content(plain)}</{tag}>"
        if r.random() < 0.3:
            middle += self.noise("comments", plain)
        if r.random() < 0.2:
            middle = self.noise(r.choice(["share", "menu", "notice"]), plain) + middle
        if r.random() < 0.3:
            side = self.noise("sidebar", plain)
            middle = r.choice([middle + side, side + middle])
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            middle = f"<div{self.attrs('wrap', plain)}>{middle}</div>"
        top = [self.noise(k, plain) for k, share in (("notice", 0.2), ("header", 0.45), ("menu", 0.7), ("form", 0.15), ("advert", 0.4), ("embedded", 0.15)) if r.random() < share]
        end = [self.noise(k, plain) for k, share in (("sidebar", 0.15), ("comments", 0.12), ("advert", 0.25), ("form", 0.15), ("footer", 0.8), ("notice", 0.15), ("embedded", 0.1)) if r.random() < share]
        if r.random() < 0.5:
            r.shuffle(top)
        return f"<html><head><title>{self.some(2, 9)}</title></head><body>{''.join(top)}{middle}{''.join(end)}</body></html>"
