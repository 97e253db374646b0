"""Labelled pages for training the extractor: layouts, blocks and words are drawn at random from a seed."""

import random

MAIN_NAMES = ["content", "post", "entry-content", "article-body", "story", "main", "text", "post-body", "page-content", "inhalt", "artikel-text", "contenu", "texte", "contenido", "articulo"]
ROLES = {
    "menu": (["nav", "ul", "div", "header"], ["nav", "menu", "navbar", "top-links", "breadcrumb", "main-menu", ""]),
    "header": (["header", "div"], ["header", "masthead", "site-header", "logo", "banner", "kopfzeile", "entete", "cabecera", ""]),
    "footer": (["footer", "div"], ["footer", "site-footer", "copyright", "legal", "fusszeile", "impressum", "pied-de-page", "pie", ""]),
    "sidebar": (["aside", "div", "td"], ["sidebar", "widget", "related", "popular", "side", "rail", "seitenleiste", "barre", "lateral", ""]),
    "notice": (["div", "section"], ["cookie-notice", "notice", "alert", "gdpr", "banner", "popup", "hinweis", "avis", "aviso"]),
    "advert": (["div", "aside", "ins"], ["ad", "ads", "advert", "sponsored", "promo", "ad-slot", "werbung", "anzeige", "publicite", "publicidad"]),
    "form": (["form", "div"], ["search", "newsletter", "login", "subscribe", "signup", "suche", "recherche", "buscar"]),
    "comments": (["div", "section", "ol"], ["comments", "comment-list", "discussion", "replies", "respond", "kommentare", "commentaires", "comentarios"]),
    "share": (["div", "ul"], ["share", "social", "tags", "meta", "toolbar", "teilen", "partager", "compartir"]),
}
OWNERS = ["&copy;", "Copyright", "All rights reserved,", "(c)", "Alle Rechte vorbehalten,", "Tous droits réservés,", "Todos los derechos reservados,"]
# roles that what they hold and where they stand give away without a name
SHOWN = {"menu", "header", "footer", "sidebar", "form", "comments"}


class PageMaker:
    """Pages as (html, pieces of main text), the pieces in page order."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        syllables = ["".join(self.r.choices("bcdfghklmnprstvz", k=1)) + v + e for v in "aeiou" for e in ("", "n", "r", "s", "l")]
        self.words = ["".join(self.r.choices(syllables, k=self.r.choice((1, 1, 2, 2, 3)))) for _ in range(3000)]

    def sentence(self, low: int, high: int) -> str:
        ws = self.r.choices(self.words, k=self.r.randint(low, high))
        if high > 8 and self.r.random() < 0.01:
            ws[self.r.randrange(len(ws))] = self.r.choice(["copyright", "Copyright 2019", "©"])
        if self.r.random() < 0.15:
            ws[self.r.randrange(len(ws))] += self.r.choice([",", ";", ":", " & co", " (2)", " 50%", " -"])
        return (" ".join(ws)).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""])

    def prose(self, kind: float) -> str:
        return " ".join(self.sentence(1, 14) for _ in range(1 if kind < 0.3 else self.r.randint(1, 9)))

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{w}">{w}</a></li>' for w in self.r.choices(self.words, k=n))

    def attr(self, name: str) -> str:
        return f' {self.r.choice(("class", "class", "id"))}="{name}"' if name else ""

    def opaque(self) -> str:
        """A name that says nothing."""
        return "".join(self.r.choices("abcdefghkmprstuvxyz", k=self.r.randint(1, 4))) + self.r.choice(["", str(self.r.randint(0, 99))])

    def noise(self, role: str, plain: bool = False, named: bool = False) -> str:
        tags, names = ROLES[role]
        tag, name, r = self.r.choice(tags), self.r.choice(names), self.r.random()
        hidden = not named and role in SHOWN and (plain or self.r.random() < 0.15)
        if hidden:
            tag, name = "div", self.opaque() if self.r.random() < 0.85 else ""
        elif tag in ("div", "td", "section") and self.r.random() < 0.85 and not name:
            name = names[0]
        if role in ("menu", "share"):
            body = self.links(self.r.randint(2, 12)) if tag in ("ul", "ol") else f"<ul>{self.links(self.r.randint(2, 12))}</ul>"
        elif role == "form":
            body = f"<label>{self.sentence(1, 3)}</label><input type=text><button>{self.sentence(1, 2)}</button>" + (f"<p>{self.sentence(3, 12)}</p>" if r < 0.5 else "")
        elif role == "comments":
            each = self.opaque() if hidden else self.r.choice(["comment", "comment", "kommentar", "commentaire", "comentario", self.opaque()])
            inner = self.r.choice(["<b>{}</b><p>{}</p>", "<b>{}</b> <p>{}</p>", "<span class=who>{}</span><div>{}</div>", "<h4>{}</h4><p>{}</p>", "<p><b>{}</b></p><p>{}</p>", "<i>{}</i>: {}"])
            body = (f"<h3>{self.sentence(1, 3)}</h3>" if r < 0.5 else "") + "".join(
                f'<div class="{each}">{inner.format(self.sentence(1, 2), self.prose(self.r.random()))}</div>' for _ in range(self.r.randint(2 if hidden else 1, 6))
            )
        elif role == "sidebar":
            body = f"<h3>{self.sentence(1, 3)}</h3><ul>{self.links(self.r.randint(2, 8))}</ul>" + (f"<p>{self.sentence(4, 20)}</p>" if r < 0.4 else "")
        elif role == "footer":
            owner = self.r.choice(OWNERS if hidden else [*OWNERS, "Published by", ""]) + self.r.choice(["", " 2024", " 1998-2021"]) + " " + self.sentence(1, 6)
            body = owner if r < 0.4 else f"<p>{owner}</p><ul>{self.links(4)}</ul>" if r < 0.7 else f"{owner} | " + " | ".join(f'<a href="/{w}">{w}</a>' for w in self.r.choices(self.words, k=4))
        else:
            body = self.sentence(3, 16) if r < 0.5 else f"<p>{self.sentence(3, 20)}</p>"
        return f"<{tag}{self.attr(name)}>{body}</{tag}>"

    def page(self) -> tuple[str, list[str]]:
        r, pieces, body = self.r, [], []
        plain = r.random() < 0.2  # nothing but divs with names that say nothing
        named = f' class="{self.opaque()}"' if r.random() < 0.12 else ""

        def block(tag: str, text: str) -> str:
            pieces.append(text)
            words = text.replace("&", "&amp;").split(" ")
            if r.random() < 0.25:
                at = r.randrange(len(words))
                inline = r.choice(["b", "i", "em", "strong", "span", "code", 'a href="/x"'])
                words[at] = f"<{inline}>{words[at]}</{inline.split()[0]}>"
            whole = r.choice(["b", "em", "span"]) if r.random() < 0.08 else ""
            shown = f"<{whole}>{' '.join(words)}</{whole}>" if whole else " ".join(words)
            if tag == "p" and r.random() < 0.02:
                shown = f"<object data=x>{shown}</object>"
            return f"<{tag}{named if tag == 'p' else ''}>{shown}" + (r.choice(["</p>", "</p>", "</p>", "", "<br>"]) if tag == "p" else f"</{tag}>")

        def linked(tag: str) -> str:
            pieces.append(text := self.sentence(1, 9))
            return f'<{tag}><a href="/y">{text.replace("&", "&amp;")}</a></{tag}>'

        def section(i: int) -> str:
            return f'<div class="{part}">' + block("h3", self.sentence(1, 6)) + "".join(block("p", self.prose(1)) for _ in range(i)) + "</div>"

        part = self.opaque()
        for _ in range(1 if plain or r.random() < 0.9 else 0):
            title = block(r.choice(["h1", "h1", "h2"]), self.sentence(2, 12))
            body.append(f'<header{self.attr(r.choice(["", "entry-header", "post-header", "article-header"]))}>{title}</header>' if r.random() < 0.25 else title)
        for i in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.75:
                body.append(block("p", self.prose(r.random())))
            elif x < 0.8:
                body.append(block("h2", self.sentence(1, 6)))
            elif x < 0.85:
                body.append("<ul>" + "".join(block("li", self.sentence(2, 12)) for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.87:
                body.append("<blockquote>" + block("p", self.prose(1)) + "</blockquote>")
            elif x < 0.89:
                body.append("<section>" + block("h3", self.sentence(1, 6)) + block("p", self.prose(1)) + "</section>")
            elif x < 0.91:
                body.append("<figure><img src=x>" + block("figcaption", self.sentence(3, 12)) + "</figure>")
            elif x < 0.92:
                body.append("<pre>" + block("code", self.sentence(3, 12)) + "</pre>")
            elif x < 0.93:
                body.append("<table>" + "".join("<tr>" + "".join(block("td", self.sentence(1, 5)) for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif x < 0.965 and i:
                tag = r.choice(["ul", "ul", "ol"])
                body.append(f"<{tag}>" + "".join(linked("li") for _ in range(r.randint(1, 6))) + f"</{tag}>")
                if r.random() < 0.8:
                    body.append(block("p", self.prose(1)))
            elif x < 0.97 and i:
                body.append(linked("p") + block("p", self.prose(1)))
            elif x < 0.98 and not plain:
                body.append("".join(section(r.randint(2, 4)) for _ in range(r.randint(2, 4))))
            elif i:
                body.append(self.noise(r.choice(["advert", "share", "advert", "form"])))
        inner = "".join(body) + (self.noise("comments", named=True) if r.random() < 0.2 else "") + (self.noise("share") if r.random() < 0.1 else "")
        wrap = r.random()
        name = self.opaque() if plain or r.random() < 0.2 else r.choice(MAIN_NAMES)
        if plain:
            main = f"<div{self.attr(name)}>{inner}</div>" if wrap < 0.8 else inner
        elif wrap < 0.45:
            main = f"<article>{inner}</article>"
        elif wrap < 0.6:
            main = f"<main>{inner}</main>"
        elif wrap < 0.9:
            main = f"<div{self.attr(name)}>{inner}</div>"
        elif wrap < 0.95:
            main = f"<table><tr><td>{self.links(4)}</td><td{self.attr(name)}>{inner}</td></tr></table>"
        else:
            main = f"<div>{inner}</div>"
        if r.random() < 0.3:
            main = f'<div{self.attr(self.opaque() if plain else r.choice(["wrapper", "container", "page", "row"]))}>{main}{self.noise("sidebar", plain) if r.random() < 0.6 else ""}</div>'
        before = [self.noise(x, plain) for x in ("notice", "header", "menu", "form", "advert", "sidebar") if r.random() < 0.45]
        after = [self.noise(x, plain) for x in ("advert", "share", "comments", "sidebar", "form", "footer", "notice") if r.random() < 0.4]
        head = f"<head><title>{self.sentence(2, 8)}</title><meta name=description content=x><style>a{{color:red}}</style><script>load();</script></head>"
        end = "</body></html>" if r.random() < 0.85 else ""
        return f"<!DOCTYPE html><html>{head}<body>{''.join(before)}{main}{''.join(after)}{end}", pieces
