"""Main text of web pages: boosted trees over DOM nodes and a decoding that keeps ancestors and descendants consistent."""

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, fit
from .html_pages import PageMaker

TRAINING_PAGES = 2000
# text of the article that is lost counts this many times as much as other text that is kept
LOSS = 2.0
_MARK = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*'|))*)>?)", re.S)
_ATTR = re.compile(r"(?<![-\w])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SIGN = re.compile(r"[.,;:!?]")

# Elements by their part in a page, as HTML defines them.
BLOCKS = "html body div section article main nav aside header footer form ul ol li dl dt dd table tbody thead tfoot tr td th p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address fieldset details summary center ins".split()
RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed"}
SKIP = {"svg", "template", "select", "button", "canvas", "video", "audio"}
# what a head may hold; anything else ends it, as its tags may be left out
IN_HEAD = {"head", "html", "base", "link", "meta", "title", "style", "script", "noscript", "template"}
# where one of these begins, an element of SKIP without end tag is over
ARTICLE = set("body p h1 h2 h3 h4 h5 h6 article main section ul ol dl table blockquote pre".split())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES_P = set(BLOCKS) - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dt", "dd", "ins"}
SAME = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# A choice of common words in class, id and role attributes, in English, German, French and Spanish; how they count is learnt.
FOR = set("article body content entry main page post story text blog news artikel beitrag inhalt haupttext contenu texte corps contenido texto articulo entrada cuerpo".split())
AGAINST = set(
    "ad ads advert banner breadcrumb comment comments consent cookie copyright discussion footer form gdpr header legal login logo masthead menu meta nav navbar navigation newsletter notice popular popup promo related replies respond search share side sidebar signup social sponsored subscribe tags toolbar widget alert rail "
    "anzeige werbung kommentar kommentare kopfzeile fusszeile hinweis impressum suche teilen seitenleiste antworten "
    "publicite pub commentaire commentaires entete pied avis recherche partager barre reponses "
    "publicidad anuncio comentario comentarios cabecera pie aviso buscar compartir lateral respuestas".split()
)
# Signs and phrases by which pages name the owner of their rights, in the same languages.
_OWNER = re.compile(r"©|\(c\)|copyright|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados", re.I)

KIND = {t: i for i, t in enumerate(BLOCKS)}
GROUPS = [["article"], ["main"], ["nav"], ["aside"], ["header"], ["footer"], ["form"], ["ul", "ol", "dl"], ["li", "dt", "dd"], ["table", "tr", "td", "th"], ["p"], ["h1", "h2", "h3", "h4", "h5", "h6"], ["blockquote", "pre", "figure"], ["div", "section", "center", "ins"], ["body", "html"]]
GROUP = np.full(len(BLOCKS) + 1, len(GROUPS))
for _g, _names in enumerate(GROUPS):
    for _t in _names:
        GROUP[KIND[_t]] = _g
TEXT = len(BLOCKS)
HEAD_GROUP, PARA_GROUP = GROUP[KIND["h1"]], GROUP[KIND["p"]]


def page_marks(page: str) -> list[re.Match]:
    """Tags and comments in page order, without what raw elements hold."""
    out, at = [], 0
    while m := _MARK.search(page, at):
        out.append(m)
        at = m.end()
        if m[2] and not m[1] and (name := m[2].lower()) in RAW:
            end = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            at = end.start() if end else len(page)
    return out


def skipped_ends(marks: list[re.Match]) -> dict[int, int]:
    """The mark that ends each element of SKIP, by the one that begins it, for those that have an end tag."""
    out, opened = {}, {}
    for i, m in enumerate(marks):
        if m[2] and (name := m[2].lower()) in SKIP:
            if not m[1] and not m[3].endswith("/"):
                opened.setdefault(name, []).append(i)
            elif m[1] and opened.get(name):
                out[opened[name].pop()] = i
    return out


class Dom:
    """Block nodes of one page in page order: kind, parent, depth, last node below, attribute words for and against, own pieces of text.

    The time is linear in the page: open elements are kept by name, so that a tag finds what it closes at once at any depth.
    """

    def __init__(self, page: str):
        self.kind, self.parent, self.depth, self.last, self.plus, self.minus = [KIND["html"]], [-1], [0], [0], [0], [0]
        self.text: list[list[str]] = [[]]
        self.linked, self.tags = [0], [0]
        # elements of one kind and class value have one number; 0 is none
        self.alike: list[int] = [0]
        self._names: dict[tuple[int, str], int] = {}
        self._read(page)

    def _node(self, kind: int, parent: int, attributes: str = "") -> int:
        named = [(name.lower(), a or b or c) for name, a, b, c in _ATTR.findall(attributes)] if attributes else []
        words = _TOKEN.findall(" ".join(value for _, value in named).lower())
        classes = [value for name, value in named if name == "class"]
        self.alike.append(self._names.setdefault((kind, classes[0]), len(self._names) + 1) if classes else 0)
        self.kind.append(kind)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.last.append(len(self.last))
        self.plus.append(sum(w in FOR for w in words))
        self.minus.append(sum(w in AGAINST for w in words))
        self.text.append([])
        self.linked.append(0)
        self.tags.append(0)
        return len(self.kind) - 1

    def _read(self, page: str) -> None:
        stack = [("html", 0)]
        opened: dict[str, list[int]] = {name: [] for name in BLOCKS}  # places in the stack, html's own left out
        run: list[str] = []
        links = at = 0
        linked = 0
        head = unclosed = False

        def close(place: int) -> None:
            """End the elements of the stack from ``place`` on."""
            while len(stack) > place:
                name, node = stack.pop()
                opened[name].pop()
                self.last[node] = len(self.kind) - 1

        def nearest(names: set[str]) -> int:
            return max(opened[n][-1] if opened[n] else 0 for n in names)

        def flush() -> None:
            nonlocal run, linked
            if run and (piece := " ".join(html.unescape("".join(run)).split())):
                node = stack[-1][1]
                self.text[self._node(TEXT, node)].append(piece)
                self.linked[-1] = linked
            run, linked = [], 0

        def add(end: int) -> None:
            nonlocal head, linked
            head = head and not page[at:end].strip()
            if not head and not unclosed and end > at:
                run.append(page[at:end])
                if links:
                    linked += end - at

        marks = page_marks(page)
        ends = skipped_ends(marks)
        past = 0
        for i, m in enumerate(marks):
            if i < past:
                continue
            add(m.start())
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if name == "head":
                head = not m[1] and len(self.kind) == 1 and not run
                continue
            head = head and (name in IN_HEAD or bool(m[1]) and name != "body")
            if name in RAW:
                if not m[1]:
                    at = marks[i + 1].start() if i + 1 < len(marks) else len(page)
                continue
            if name in SKIP:
                if i in ends:
                    past = ends[i] + 1
                    at = marks[ends[i]].end()
                elif not m[1] and not m[3].endswith("/"):
                    unclosed = True
                continue
            if unclosed:
                if name not in ARTICLE if not m[1] else not opened.get(name):
                    continue
                unclosed = False
            if name == "a":
                links = 0 if m[1] else 1
            if name in VOID:
                if name in ("br", "hr"):
                    run.append(" ")
                self.tags[stack[-1][1]] += 1
                continue
            if name not in KIND:
                self.tags[stack[-1][1]] += 1
                continue
            if name in ("html", "body") and (m[1] or name == "html" or opened["body"]):
                continue
            flush()
            if m[1]:
                if opened[name]:
                    close(opened[name][-1])
                continue
            if name in CLOSES_P and stack[-1][0] == "p":
                close(len(stack) - 1)
            elif name in SAME:
                closed, scope = SAME[name]
                if (place := nearest(closed)) > nearest(scope):
                    close(place)
            links = 0
            opened[name].append(len(stack))
            stack.append((name, self._node(KIND[name], stack[-1][1], m[3])))
        add(len(page))
        flush()
        close(1)
        self.last[0] = len(self.kind) - 1


def features(doms: list[Dom]) -> np.ndarray:
    """One row per node of all pages: own and subtree text, links, tags and owner marks, attributes, depth, siblings, headings and paragraphs before and behind, and the same of the parent."""
    sizes = np.array([len(d.kind) for d in doms])
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    page = np.repeat(np.arange(len(doms)), sizes)
    root = start[page]
    n = len(page)
    parent = np.concatenate([np.array(d.parent) for d in doms])
    top = parent < 0
    p = np.where(top, np.arange(n), parent + root)
    group = GROUP[np.concatenate([np.array(d.kind) for d in doms])]
    texts = [t for d in doms for t in d.text]
    length = np.array([sum(map(len, t)) for t in texts], dtype=float)
    words = np.array([sum(x.count(" ") + 1 for x in t) for t in texts], dtype=float)
    signs = np.array([sum(len(_SIGN.findall(x)) for x in t) for t in texts], dtype=float)
    linked, tags, plus, minus = (np.concatenate([np.array(getattr(d, name), dtype=float) for d in doms]) for name in ("linked", "tags", "plus", "minus"))
    marks = np.array([sum(len(_OWNER.findall(x)) for x in t) for t in texts], dtype=float)
    alike_as = np.concatenate([np.array(d.alike) for d in doms])
    head = (group == HEAD_GROUP) * 1.0
    para = (group == PARA_GROUP) * 1.0
    sub = np.stack([length, linked, words, signs, np.ones(n), tags, (length > 0) * 1.0, marks, head, para], axis=1)
    _, like, times = np.unique(np.stack([p, alike_as]), axis=1, return_inverse=True, return_counts=True)
    repeats = np.where(alike_as > 0, times[like.ravel()], 0)
    own = np.stack([np.isin(group, (0, 1)) * 1.0, np.isin(group, (2, 3, 4, 5, 6)) * 1.0, plus, minus, (repeats > 1) * 1.0], axis=1)
    depth = np.concatenate([np.array(d.depth) for d in doms])
    end = np.concatenate([np.array(d.last) for d in doms]) + root + 1
    # nodes stand in page order, so what is below node i are the nodes up to its last one: sums over subtrees and over ancestors are running totals
    held = np.concatenate((np.zeros((1, sub.shape[1])), np.cumsum(sub, axis=0)))
    sub = held[end] - held[:-1]
    ahead, behind = held[:-1] - held[root], held[end[root]] - held[end]
    edge = np.zeros((n + 1, own.shape[1]))
    edge[:-1] += own * ~top[:, None]
    np.subtract.at(edge, end, own * ~top[:, None])
    inside = np.cumsum(edge, axis=0)[:-1]
    total = np.maximum(sub[root, 0], 1)
    passed = np.concatenate(([0], np.cumsum(length)))
    before = (passed[:-1] - passed[root]) / total
    child = np.flatnonzero(~top)
    born = np.bincount(p[child], minlength=n)
    order = child[np.argsort(p[child], kind="stable")]
    rank = np.zeros(n)
    rank[order] = np.arange(len(order)) - (np.cumsum(born) - born)[p[order]]
    _, kind_of, common = np.unique(p * 64 + group, return_inverse=True, return_counts=True)
    alike = common[kind_of] * 1.0
    kin = (sub[p, 0] - sub[:, 0]) / np.maximum(born[p] - 1, 1)
    chars, above = np.maximum(sub[:, 0], 1), np.maximum(sub[p, 0], 1)
    none = len(GROUPS) + 1
    previous, following = np.full(n, none), np.full(n, none)
    same = p[order[1:]] == p[order[:-1]]
    previous[order[1:][same]] = group[order[:-1][same]]
    following[order[:-1][same]] = group[order[1:][same]]
    beside = np.bincount(p[child], para[child], minlength=n)
    return np.stack(
        [
            group, np.where(top, none, group[p]), np.where(top | top[p], none, group[p[p]]),
            own[:, 2], own[:, 3], inside[:, 0], inside[:, 1], inside[:, 2], inside[:, 3], own[p, 2], own[p, 3],
            np.log1p(sub[:, 0]), np.log1p(sub[:, 2]), sub[:, 1] / chars, sub[:, 3] / chars, sub[:, 4] / chars, sub[:, 5] / chars, sub[:, 0] / np.maximum(sub[:, 6], 1),
            sub[:, 0] / total, depth, rank, born[p], rank / np.maximum(born[p], 1), alike, np.log1p(np.maximum(kin, 0)), born,
            np.log1p(above), sub[p, 1] / above, sub[p, 3] / above, above / np.maximum(sub[p, 6], 1), above / total, before, np.log1p(total), (length > 0) * 1.0,
            np.log1p(sub[:, 7]), 40 * sub[:, 7] / chars, np.log1p(ahead[:, 8]), np.log1p(behind[:, 8]), np.log1p(ahead[:, 9]), np.log1p(behind[:, 9]), behind[:, 0] / total,
            repeats, inside[:, 4], (sub[p, 1] - sub[:, 1]) / np.maximum(sub[p, 0] - sub[:, 0], 1), beside[p], previous, following, sub[:, 8], sub[:, 9], np.where(top, none, previous[p]),
        ],
        axis=1,
    )


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """The likeliest labels with which no node below a rejected one is kept."""
    yes = -np.logaddexp(0, -odds)
    no = -np.logaddexp(0, odds)
    keep, drop = yes.tolist(), no.tolist()
    for i in range(len(parent) - 1, 0, -1):
        keep[parent[i]] += max(keep[i], drop[i])
        drop[parent[i]] += drop[i]
    out = np.zeros(len(parent), dtype=bool)
    out[0] = True
    for i in range(1, len(parent)):
        out[i] = out[parent[i]] and keep[i] > drop[i]
    return out


def training_nodes(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of made pages; a node is positive if it holds a piece of the main text."""
    maker = PageMaker(seed)
    xs, ys = [], []
    for _ in range(pages):
        page, pieces = maker.page()
        dom = Dom(page)
        wanted = [" ".join(p.split()) for p in pieces]
        label = np.zeros(len(dom.kind))
        at = 0
        for i, texts in enumerate(dom.text):
            for t in texts:
                if at < len(wanted) and t == wanted[at]:
                    label[i] = 1
                    at += 1
        for i in range(len(label) - 1, 0, -1):
            label[dom.parent[i]] = max(label[dom.parent[i]], label[i])
        if at == len(wanted):
            xs.append(dom)
            ys.append(label)
    return features(xs), np.concatenate(ys)


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = 5) -> BoostedTrees:
    """Trees fitted on ``pages`` made pages; a few seconds on the driver, independent of the table."""
    return fit(*training_nodes(pages, seed), trees=120, share=0.4)


def main_text(doms: list[Dom], model: BoostedTrees) -> list[str]:
    if not doms:
        return []
    odds = model.log_odds(features(doms))
    cuts = np.cumsum([len(d.kind) for d in doms])[:-1]
    out = []
    for dom, part in zip(doms, np.split(odds, cuts), strict=True):
        keep = decode(dom.parent, part + np.log(LOSS))
        out.append(" ".join(t for i, texts in enumerate(dom.text) if keep[i] for t in texts))
    return out


def extract_main_text(pages: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html), from the whole html.

    Every node of the page (block elements, and runs of text between them) gets the chance that it holds main text from trees over
    its features; the decoding then takes the likeliest choice in which nothing below a rejected node is kept. Kept runs
    of text, with character references decoded and white space (as str.split knows it) joined, follow in page order. Scripts,
    styles, buttons and the like are never text; what an object holds for readers without it is. Null html is empty; a page without main text has the empty text. Rows are
    judged one by one, so repeated ones agree and nothing is shuffled.
    """
    ready = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_, texts, held, size = batch.column(2).fill_null("").to_pylist(), [], [], 0
            for page in pages_:
                held.append(Dom(page))
                size += len(page)
                if size > 4 << 20:
                    texts += main_text(held, ready)
                    held, size = [], 0
            texts += main_text(held, ready)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", F.col("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
