"""Layouts of web pages written by hand, apart from the training pages: functions of a word maker that give (html, pieces of main text)."""

import random


class Words:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.list = "harbour ledger copper meadow signal orchard winter market stone river glass paper garden engine village bridge letter number island season museum captain forest kitchen window doctor".split()

    def line(self, low=4, high=9):
        return " ".join(self.r.choices(self.list, k=self.r.randint(low, high))).capitalize()

    def text(self, n=4):
        return " ".join(self.line(6, 16) + "." for _ in range(n))


def news(w):
    title, paras = w.line(), [w.text() for _ in range(5)]
    page = f"""<!doctype html><html><head><title>{title}</title><link rel=stylesheet href=a.css></head><body class="home page">
<header class="site-header"><a class="logo" href="/">The {w.line(1, 2)}</a><nav class="main-nav"><ul><li><a href=/w>World</a><li><a href=/b>Business</a><li><a href=/s>Sport</a></ul></nav></header>
<div class="cookie-banner" role="dialog"><p>We use cookies to improve your visit. {w.line()}.</p><button>Accept</button></div>
<main><article itemscope><header><h1>{title}</h1></header>{"".join(f"<p>{p}</p>" for p in paras[:3])}
<aside class="related-box"><h4>Read more</h4><ul><li><a href=1>{w.line()}</a></li><li><a href=2>{w.line()}</a></li></ul></aside>
{"".join(f"<p>{p}</p>" for p in paras[3:])}</article>
<section id="comments"><h3>3 comments</h3><div class="comment"><p>{w.text(2)}</p></div><div class="comment"><p>{w.text(1)}</p></div></section></main>
<footer class="site-footer"><p>&copy; 2021 {w.line(2, 3)}. All rights reserved.</p><a href=/t>Terms</a> <a href=/p>Privacy</a></footer></body></html>"""
    return page, [title, *paras]


def blog(w):
    title, paras, items = w.line(), [w.text(3) for _ in range(4)], [w.line() for _ in range(4)]
    page = f"""<html><body><div id="wrap"><div id="top-nav"><a href=/>Home</a> <a href=/about>About</a> <a href=/rss>RSS</a></div>
<div class="post"><h2>{title}</h2><div class="entry-content"><p>{paras[0]}</p><p>{paras[1]}</p><ol>{"".join(f"<li>{i}</li>" for i in items)}</ol><p>{paras[2]}</p><blockquote><p>{paras[3]}</p></blockquote></div>
<div class="share-buttons"><a href=#>Tweet</a><a href=#>Share</a></div></div>
<div id="sidebar"><h3>Archive</h3><ul><li><a href=1>May</a></li><li><a href=2>June</a></li></ul><form class=search><input name=q><input type=submit></form></div>
<div id="respond"><h3>Leave a reply</h3><form><label>Name</label><textarea>your words</textarea></form></div></div><div id="footer">Powered by {w.line(1, 2)} | Theme by {w.line(1, 2)}</div></body></html>"""
    return page, [title, *paras[:2], *items, paras[2], paras[3]]


def omitted_tags(w):
    title, paras = w.line(), [w.text(3) for _ in range(5)]
    return f"<title>{title}</title><meta charset=utf-8><nav><a href=/>Home</a><a href=/x>Index</a></nav><article><h1>{title}</h1>" + "".join(f"<p>{p}\n" for p in paras) + f"</article><footer><p>Copyright {w.line(1, 3)}</footer>", [title, *paras]


def table_layout(w):
    title, paras = w.line(), [w.text(3) for _ in range(4)]
    page = f"""<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD CLASS=menu WIDTH=150><UL><LI><A HREF=1>News</A><LI><A HREF=2>Links</A><LI><A HREF=3>Mail</A></UL></TD>
<TD CLASS=content><H1>{title}</H1>{"".join(f"<P>{p}</P>" for p in paras)}</TD></TR><TR><TD COLSPAN=2 CLASS=footer>Last changed 1999 by <A HREF=4>{w.line(1, 2)}</A></TD></TR></TABLE></BODY></HTML>"""
    return page, [title, *paras]


def manual(w):
    title, paras, code = w.line(), [w.text(2) for _ in range(4)], w.line()
    page = f"""<!DOCTYPE html><html><head><script>if (a < b && c > d) {{ document.write("<p>no</p>"); }}</script></head><body><nav class="breadcrumb"><a href=/>Docs</a> / <a href=/g>Guide</a></nav>
<aside class="toc sidebar"><ul><li><a href=#a>{w.line(1, 3)}</a></li><li><a href=#b>{w.line(1, 3)}</a></li></ul></aside><main class="content"><h1>{title}</h1><section id=a><h2>{w.list[0].title()} first</h2><p>{paras[0]}</p><pre><code>{code}</code></pre><p>{paras[1]}</p></section>
<section id=b><h2>{w.list[1].title()} second</h2><p>{paras[2]}</p><p>{paras[3]}</p></section></main><footer><a href=prev>Previous</a><a href=next>Next</a></footer></body></html>"""
    return page, [title, f"{w.list[0].title()} first", paras[0], code, paras[1], f"{w.list[1].title()} second", *paras[2:]]


def shop_talk(w):
    title, paras = w.line(), [w.text(4) for _ in range(3)]
    page = f"""<html><body><header role=banner><div class=masthead>{w.line(1, 2)}</div></header><div class="alert">Free delivery this week, {w.line()}.</div><div class="story-body"><h1>{title}</h1><p>{paras[0]}</p><div class="advert">Sponsored: {w.line()}</div><p>{paras[1]}</p><div class="newsletter-signup"><form><p>Get our letter. {w.line()}.</p><input><button>Join</button></form></div><p>{paras[2]}</p></div>
<div class="sidebar"><h3>Popular</h3><ul><li><a href=1>{w.line()}</a><li><a href=2>{w.line()}</a></ul></div><footer>{w.line(2, 4)} &amp; sons</footer></body></html>"""
    return page, [title, *paras]


def link_list(w):
    title, paras, links = w.line(), [w.text() for _ in range(4)], [w.line(2, 5) for _ in range(2)]
    page = f"""<!doctype html><html><body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><article><h1>{title}</h1><p>{paras[0]}</p><p>{paras[1]}</p>
<ul>{"".join(f"<li><a href=/l>{x}</a></li>" for x in links)}</ul><p>{paras[2]}</p><p>{paras[3]}</p></article><footer>&copy; {w.line(2, 3)}</footer></body></html>"""
    return page, [title, *paras[:2], *links, *paras[2:]]


def object_text(w):
    title, paras = w.line(), [w.text(2) for _ in range(4)]
    page = f"""<html><body><div class=header>{w.line(1, 2)}</div><article><h1>{title}</h1><p>{paras[0]}</p><p>See <object data=map.svg type=image/svg+xml>the drawn map of the town</object> here.</p><p>{paras[1]}</p><p>{paras[2]}</p></article></body></html>"""
    return page, [title, paras[0], "See the drawn map of the town here.", *paras[1:3]]


def plain_divs(w):
    title, paras = w.line(), [w.text(3) for _ in range(5)]
    page = f"""<html><body><div class=d1><a href=/>Home</a> <a href=/a>About us</a> <a href=/k>Contact</a></div><div class=d2><h1>{title}</h1>{"".join(f"<p>{p}</p>" for p in paras)}</div><div class=d3><h4>More</h4><ul><li><a href=1>{w.line(2, 4)}</a></li><li><a href=2>{w.line(2, 4)}</a></li></ul></div>
<div class=d4>Copyright 2024 {w.line(2, 2)}</div></body></html>"""
    return page, [title, *paras]


def zeitung(w):
    title, paras = w.line(), [w.text(3) for _ in range(4)]
    notes = "".join(f"<div class=kommentar><span class=autor>{w.line(1, 2)}</span><p>{w.text(1)}</p></div>" for _ in range(3))
    page = f"""<html lang=de><body><div id=kopf><a href=/>Start</a> <a href=/p>Politik</a></div><div class=artikel><h1>{title}</h1>{"".join(f"<p>{p}</p>" for p in paras)}</div><div class=kommentare><h3>Kommentare</h3>{notes}</div><div id=fuss>© 2023 {w.line(1, 2)}. Alle Rechte vorbehalten.</div></body></html>"""
    return page, [title, *paras]


def diario(w):
    title, paras = w.line(), [w.text(3) for _ in range(4)]
    notes = "".join(f"<div class=opinion><b>{w.line(1, 2)}</b><p>{w.text(1)}</p></div>" for _ in range(4))
    page = f"""<html lang=es><body><header><h2>{w.line(1, 2)}</h2></header><div class=noticia><h1>{title}</h1>{"".join(f"<p>{p}</p>" for p in paras)}</div><div class=opiniones>{notes}</div><div class=abajo>Todos los derechos reservados, {w.line(1, 2)}</div></body></html>"""
    return page, [title, *paras]


def journal(w):
    title, paras = w.line(), [w.text(3) for _ in range(4)]
    notes = "".join(f"<li class=avis><h4>{w.line(1, 2)}</h4><p>{w.text(1)}</p></li>" for _ in range(3))
    page = f"""<html lang=fr><body><div class=haut><ul><li><a href=/>Accueil</a></li><li><a href=/m>Monde</a></li></ul></div><main><h1>{title}</h1>{"".join(f"<p>{p}</p>" for p in paras)}</main><ol class=reactions>{notes}</ol><div class=bas>Tous droits réservés, {w.line(1, 2)}</div></body></html>"""
    return page, [title, *paras]


LAYOUTS = {f.__name__: f for f in (news, blog, omitted_tags, table_layout, manual, shop_talk, link_list, object_text, plain_divs, zeitung, diario, journal)}
