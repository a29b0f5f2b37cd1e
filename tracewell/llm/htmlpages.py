"""Labelled pages from which the extractor learns: made by rule, with their main text between the characters IN and OUT.

A page is an article of invented words in one of many layouts, with menus, notices, adverts, comments and the like before it,
beside it, in it and after it. Parts carry class names or none; wrappers of the article carry names that also mark other parts
(`with-sidebar`), so no name decides alone.
"""

from __future__ import annotations

import random

IN, OUT = "", ""
#: Of each kind of part: its elements, names of classes, and phrases.
PARTS = {
    "menu": ("nav div ul", "nav navbar navigation menu main-menu topnav breadcrumb breadcrumbs", "Home|News|Sport|About us|Contact|Startseite|Kontakt|Accueil|Inicio|Archive|Shop|Search|Log in|Sign up"),
    "head": ("header div", "header masthead branding top-bar banner toolbar", "The Daily|Wissen heute|Journal|Menu|Search"),
    "side": ("aside div section", "sidebar side-bar sidenav widget widgets rail popular trending", "Popular now|Most read|Latest|Meistgelesen|Top stories|Tags|Archives"),
    "foot": ("footer div p", "footer site-footer copyright colophon legal", "All rights reserved|Copyright|Terms|Privacy|Imprint|Impressum|Alle Rechte vorbehalten|Tous droits réservés|Cookies"),
    "advert": ("div section p aside", "ad ad ads advert advertisement adsense sponsor sponsored promo promotion ad-slot", "Advertisement|Anzeige|Sponsored|Buy now|Publicité|Special offer|Order today"),
    "notice": ("div section p", "cookie cookie-notice consent gdpr notice alert popup modal overlay", "We use cookies|Accept|Accept all|Manage settings|By using this site you agree|Wir verwenden Cookies|Enable notifications"),
    "form": ("form div p section", "newsletter newsletter-signup subscribe signup login search-form", "Subscribe to our newsletter|Your email|Sign up|Log in|Password|Search|Send|Jetzt abonnieren"),
    "comments": ("section div ol", "comments comment-list disqus respond replies discussion reader-comments", "Comments|Leave a reply|Reply|Report|says|Kommentare|Antworten|commented|days ago|hours ago|Like"),
    "share": ("div ul p", "share share-buttons sharing social social-links follow", "Share|Tweet|Facebook|Twitter|Email|Print|WhatsApp|Follow us|Teilen"),
    "related": ("div section aside ul", "related related-posts recommended recommendations more-stories read-next", "Related articles|Read more|You may also like|Recommended|More stories|Lesen Sie auch|À lire aussi"),
    "pager": ("div nav ul p", "pager pagination page-links", "Next|Previous|Older posts|Newer posts|Weiter|Zurück|Page 1 of 3"),
}
#: Names of wrappers of the article; some have parts that elsewhere mark other things.
WRAPPERS = "content|main|post|entry|article|story|text|page|container|wrapper|col|row|site|content with-sidebar|has-sidebar|page no-comments|post share-enabled|menu-page|single|main-content|post-body|layout no-ads|article-page has-banner|entry related-on|news-item"
ROLES = {"menu": "navigation", "head": "banner", "foot": "contentinfo", "side": "complementary", "form": "search", "notice": "alert"}
_SYLLABLES = "th er on an re he in at nd st es en of te ed or ti ha ing ou ver sch ge ung de la que ar os ci mo ta lo"

#: Words of running text, which therefore tell nothing, though they stand in phrases above.
_COMMON = "the of and to in is for by this that from with you we us use using our more it on at as are be my your out all about also may like was no not now top page site der die und das von zu wir auch le la les des et un une à tous de que el en los por a an up".split()
#: Words that stand in phrases above, but now and then in articles as well.
_EITHER = "days hours ago read report home news daily search sport shop contact menu related articles says comments buy leave archive terms journal privacy log sign settings enable manage accept agree heute alle wissen".split()


class Maker:
    def __init__(self, seed: int, names: bool = True):
        """names: whether parts may carry class names; without them, only elements, phrases and links tell."""
        self.r, self.names = random.Random(seed), names

    def word(self) -> str:
        if self.r.random() < 0.4:
            return self.r.choice(_COMMON if self.r.random() < 0.93 else _EITHER)
        return "".join(self.r.choice(_SYLLABLES.split()) for _ in range(self.r.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 22) -> str:
        w = [self.word() for _ in range(self.r.randint(low, high))]
        w[0] = w[0].capitalize()
        if len(w) > 8:
            w[len(w) // 2] += ","
        return " ".join(w) + self.r.choice("....?!")

    def prose(self, most: int = 6) -> str:
        longest = self.r.choice((12, 22, 22, 45))
        return " ".join(self.sentence(4, longest) for _ in range(self.r.randint(1, most)))

    def marked(self, text: str) -> str:
        """The text with some of its words in inline elements."""
        tag = lambda w: f"<{t}>{w}</{t}>" if (t := self.r.choice(("b", "i", "em", "strong", "span", "code", "sup"))) != "sup" else f"{w}<sup>1</sup>"
        return " ".join(tag(w) if self.r.random() < 0.05 else w for w in text.split(" "))

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def attributes(self, kind: str) -> str:
        out = ""
        if self.names and self.r.random() < 0.9:
            name = self.r.choice(PARTS[kind][1].split())
            extra = self.r.choice(("", "", " clearfix", " box", " block", " col-3", " inner"))
            out = f' {self.r.choice(("class", "class", "id"))}="{name}{extra}"'
        if kind in ROLES and self.r.random() < 0.5:
            out += f' role="{ROLES[kind]}"'
        return out

    def unseen(self) -> str:
        """Prose that is not shown."""
        return f"<div{self.r.choice((' hidden', ' aria-hidden=true', ' style=display:none', ' hidden class=box'))}>{self.prose(2)}</div>"

    def part(self, kind: str) -> str:
        r, phrases = self.r, PARTS[kind][2].split("|")
        tag = r.choice(PARTS[kind][0].split())
        said = lambda: r.choice(phrases)
        titles = lambda n: [self.link(" ".join(self.word() for _ in range(r.randint(1, 7)))) for _ in range(n)]
        listed = lambda items: "".join(f"<li>{x}</li>" for x in items) if tag in ("ul", "ol") else r.choice((" | ".join(items), " ".join(items), "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"))
        heading = f"<h{r.randint(2, 4)}>{said()}</h3>" if r.random() < 0.6 else ""
        if kind in ("menu", "share", "pager"):
            plain = r.random() < 0.15  # items that scripts make links of
            body = listed([(lambda x: x if plain else self.link(x))(said() if r.random() < 0.7 else self.word()) for _ in range(r.randint(1, 9))])
        elif kind == "head":
            body = f"<div>{self.link(said())}</div>" + r.choice(("", f"<p>{self.sentence(2, 6)}</p>", listed(titles(3))))
        elif kind == "side" and self.names and r.random() < 0.2:  # prose, which only a name tells
            return f'<{tag} class="{r.choice(PARTS[kind][1].split())}">{heading}' + "".join(f"<p>{self.prose(4)}</p>" for _ in range(r.randint(1, 3))) + f"</{tag}>"
        elif kind in ("side", "related"):
            body = heading + listed(titles(r.randint(2, 9)) if r.random() < 0.7 else [f"{x} {self.sentence(3, 9)}" for x in titles(r.randint(2, 5))])
        elif kind == "foot":
            body = r.choice(("&copy; 2023 ", "© ", "")) + said() + r.choice((". ", " ")) + r.choice((self.sentence(1, 8), self.word(), listed([self.link(said()) for _ in range(3)])))
        elif kind == "advert":
            body = r.choice(("", said() + " ", f"<b>{said()}</b> ")) + r.choice((self.sentence(3, 14), self.prose(2), self.link(self.sentence(2, 8))))
        elif kind == "notice":
            body = f"{said()} {self.sentence(2, 10)} <button>OK</button> {self.link(said())}"
        elif kind == "form":
            body = f"{heading}<label>{said()}</label><input name=q> {r.choice(('', self.sentence(2, 10)))}<button>{said()}</button>"
        else:
            each = lambda: f"<b>{self.word().capitalize()}</b> {said()} <p>{self.prose(3)}</p> {self.link(r.choice(('Reply', 'Antworten', 'Report', 'Like')))}"
            item = "li" if tag == "ol" else r.choice(("div", "article", "div"))
            body = (f"<h3>{r.randint(1, 40)} {said()}</h3>" if tag != "ol" else "") + "".join(f"<{item}>{each()}</{item}>" for _ in range(r.choice((1, 2, 3, 4, 5, 6, 12 if self.names else 3))))
        return f"<{tag}{self.attributes(kind)}>{body}</{tag}>"

    def listed(self) -> str:
        """Running text in the form of a list, or of lines."""
        r = self.r
        n = r.choice((2, 3, 4, 6, 10, 20, 40))
        item = lambda: self.sentence(2, 14) if n < 20 and r.random() < 0.6 else self.sentence(1, 4)[:-1]
        form = r.random()
        if form < 0.6:
            tag = r.choice(("ul", "ol"))
            return f"<{tag}>" + "".join(f"<li>{item()}</li>" for _ in range(n)) + f"</{tag}>"
        if form < 0.8:
            return "<dl>" + "".join(f"<dt>{self.sentence(1, 3)[:-1]}</dt><dd>{item()}</dd>" for _ in range(n)) + "</dl>"
        return "".join(f"<div>{item()}</div>" for _ in range(n))

    def opening(self) -> str:
        """The article's own header."""
        r = self.r
        byline = r.choice(("", f"<p class={r.choice(('byline', 'author', 'meta', 'date', 'dek'))}>{self.sentence(2, 6)[:-1]}</p>", f"<p>{self.sentence()}</p>", f"<time>{r.randint(1, 28)}.{r.randint(1, 12)}.2023</time>"))
        return f"<header{r.choice(('', ' class=entry-header', ' class=post-header', ' class=article-header'))}><h1>{self.sentence(2, 9)[:-1]}</h1>{byline}</header>"

    def block(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.6:
            text = self.marked(self.prose()) if r.random() < 0.6 else self.prose()
            if r.random() < 0.05:
                return f"<p><b>{text}<br><p>{self.prose()}</p>"
            if r.random() < 0.3:
                text += " " + self.link(" ".join(self.word() for _ in range(r.randint(1, 4)))) + " " + self.sentence()
            return f"<p>{text}</p>" if r.random() < 0.9 else f"<p>{self.sentence()}<br>{text}</p>"
        if x < 0.7:
            return f"<h{r.randint(2, 3)}>{' '.join(self.word() for _ in range(r.randint(1, 7)))}</h3>"
        if x < 0.8:
            return self.listed()
        if x < 0.85:
            return f"<blockquote>{self.prose(2)}</blockquote>"
        if x < 0.9:
            return "<table>" + "".join(f"<tr><td>{self.word()}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(2, 6))) + "</table>"
        if x < 0.95:
            tag = r.choice(("div", "section", "div", "header"))
            return f"<{tag}>{''.join(f'<p>{self.prose()}</p>' for _ in range(r.randint(1, 3)))}</{tag}>" if r.random() < 0.6 else f"<div>{self.prose()}</div>"
        return f"<figure><img src=x><figcaption>{self.sentence(2, 10)}</figcaption></figure>"

    def page(self) -> str:
        r = self.r
        title = self.opening() if r.random() < 0.15 else f"<h1>{self.sentence(2, 9)[:-1]}</h1>" if r.random() < 0.85 else ""
        blocks = [title] + [self.block() for _ in range(r.choice((1, 1, 2, 4, 7, 12, 20)))]
        inner = [f"{IN}{b}{OUT}" for b in blocks]
        for kind, chance in (("advert", 0.25), ("share", 0.25), ("related", 0.15), ("form", 0.1), ("side", 0.1), ("menu", 0.15), ("comments", 0.1), ("notice", 0.1)):
            if r.random() < chance:
                inner.insert(r.randint(1, len(inner)), self.part(kind))
        if r.random() < 0.1:
            inner.insert(r.randint(1, len(inner)), self.unseen())
        wrapper = lambda: f' {r.choice(("class", "id"))}="{r.choice(WRAPPERS.split("|"))}"' if r.random() < 0.8 else ""
        tag = r.choice(("article", "article", "main", "div", "div", "section"))
        story = f"<{tag}{wrapper()}>{''.join(inner)}</{tag}>"
        after = [self.part(k) for k, chance in (("share", 0.2), ("pager", 0.15), ("related", 0.4), ("comments", 0.9 if self.names and len(blocks) == 2 else 0.45), ("advert", 0.2), ("form", 0.15)) if r.random() < chance]
        beside = [self.part("side") for _ in range(r.choice((0, 0, 1, 1, 2)))]
        column = story + "".join(after)
        if r.random() < 0.5:
            column = f"<div{wrapper()}>{column}</div>"
        middle = "".join(beside) + column if r.random() < 0.4 else column + "".join(beside)
        if r.random() < 0.6:
            middle = f"<{r.choice(('div', 'div', 'section', 'form'))}{wrapper()}>{middle}</div>"
        before = [self.unseen()] * (r.random() < 0.1) + [self.part(k) for k, chance in (("notice", 0.3), ("head", 0.5), ("menu", 0.85), ("advert", 0.5), ("menu", 0.2)) if r.random() < chance]
        end = [self.part(k) for k, chance in (("foot", 0.9), ("notice", 0.15), ("menu", 0.15)) if r.random() < chance]
        head = f"<!DOCTYPE html><html><head><title>{self.word()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"{head}<body{wrapper()}>{''.join(before)}{middle}{''.join(end)}</body></html>"


def pages(n: int, seed: int = 0, names: bool = True) -> list[str]:
    return [Maker(seed * 1_000_003 + i, names).page() for i in range(n)]
