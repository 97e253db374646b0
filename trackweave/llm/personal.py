"""Personal data in texts, also where it is disguised: transducers that keep the source place of every character."""

import bisect
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_()), ("value", pa.string())])
OUT = "spans array<struct<kind:string,start:long,stop:long,base:boolean,value:string>>"

# Possessive and anchored forms of the published patterns: a match takes whole runs of digits and of address characters, so none is tried from inside a run
# and every pattern takes linear time.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones (fixed values).
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "օ": "o", "ս": "u", "ո": "n", "հ": "h",
    "․": ".", "。": ".", "｡": ".", "·": ".", "•": ".", "‧": ".", "∙": ".", "⋅": ".", "٫": ".",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "﹣": "-", "ſ": "s", "\u212a": "K", "İ": "I",
    "﹫": "@", "﹢": "+", "⁺": "+",
    "\xa0": " ", "\u2002": " ", "\u2003": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
}
INVISIBLE = "\xad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
# Digits, signs and their names in the corpus' languages (fixed values).
DIGITS = {
    "0": "zero oh null zéro cero", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro", "5": "five fünf fuenf cinq cinco",
    "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
SIGNS = {
    "@": "at ät arroba arobase klammeraffe", ".": "dot punkt punto point", "+": "plus más", "-": "dash hyphen minus bindestrich tiret guion guión", "_": "underscore unterstrich",
}
# Last labels that an address written with plain words must have to count (fixed values).
ENDINGS = frozenset("com org net edu gov mil info biz io co dev app ai uk de fr es nl eu ca au ch pl ru cn jp br mx ar example".split())

NAMES = {word: sign for sign, words in (DIGITS | SIGNS).items() for word in words.split()}
JOINED = frozenset("@.-_")


def any_of(words: str) -> str:
    return "|".join(sorted(words.split(), key=len, reverse=True))


_bracketed = rf"[\[({{<]\x20?(?:{any_of(SIGNS['@'])}|{any_of(SIGNS['.'])}|[@.])\x20?[\])}}>]"
# a sign in brackets, a name between other characters than letters and digits, or invisible characters
TOKEN = re.compile(rf"(?P<bracketed>{_bracketed})|(?<![^\W_])(?P<name>{any_of(' '.join(NAMES))})(?![^\W_])|(?P<hidden>[{INVISIBLE}]+)", re.IGNORECASE)


@lru_cache(maxsize=1)
def character_table() -> dict[int, str]:
    """One character for one: look-alikes, full-width and mathematical forms of ASCII characters, decimal digits of every script."""
    table = {ord(c): to for c, to in LOOKALIKES.items()}
    for code in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) == 1 and plain.isascii():
            table[code] = plain
    for code in range(0x80, 0x1FBFA):
        if (digit := unicodedata.decimal(chr(code), None)) is not None:
            table[code] = str(digit)
    return table


@lru_cache(maxsize=1)
def disguise_pattern() -> str:
    """For Arrow's linear-time matcher; a text without a match has no disguise: no character of the table, no sign in brackets, no name of a sign but @, and no name of a digit by a digit or another one."""
    characters = "".join(rf"\x{{{c:x}}}" for c in (*character_table(), *map(ord, INVISIBLE)))
    signs, digits = any_of(" ".join(SIGNS[s] for s in ".+-_")), any_of(" ".join(DIGITS.values()))
    out = r"[^\pL\pN]"
    return rf"[{characters}]|(?i:{_bracketed}|(?:^|{out})(?:{signs})(?:{out}|$)|(?:^|{out})(?:{digits}){out}{{1,3}}(?:(?:{digits})(?:{out}|$)|\pN)|\pN{out}{{1,3}}(?:{digits})(?:{out}|$))"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address holds one @, so it reaches from the run of local characters before it, cut at the address before, over the domain behind it."""
    end, at = 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            start = at
            while start > end and LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                yield start, m.end()
                end = m.end()
        at = text.find("@", at + 1)


def identifiers(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the identifiers as they stand, leftmost and not overlapping per kind."""
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span()
    for m in PHONE.finditer(text):
        if 9 <= sum(map(m.group().count, "0123456789")) <= 15:
            yield "phone", *m.span()


class Plain:
    """A text in plain characters, with the source span of each of them; ``spoken``: which were written as words."""

    def __init__(self, text: str):
        shown = text.translate(character_table())
        out, first, last, spoken = [], [], [], []

        def copy(start: int, stop: int) -> None:
            out.append(shown[start:stop])
            first.append(np.arange(start, stop))
            last.append(np.arange(start + 1, stop + 1))
            spoken.append(np.zeros(stop - start, dtype=bool))

        end, digits_end = 0, -1
        for m in TOKEN.finditer(shown):
            start, stop = m.span()
            if m["hidden"]:
                copy(end, start)
                end = stop
                continue
            word = m["name"]
            sign = NAMES.get((word or m["bracketed"][1:-1].strip(" ")).lower(), None if word else m["bracketed"][1:-1].strip(" "))
            if start < end or sign is None:
                continue
            if sign in JOINED:  # the blanks around a name, or the strokes on either side of it, belong to it
                edge = " \t" if shown[start - 1 : start] in ("", " ", "\t") or shown[start - 1 : start] != shown[stop : stop + 1] else " \t_-"
                for _ in range(3):
                    start -= start > end and shown[start - 1] in edge
                    stop += stop < len(shown) and shown[stop] in edge
            # digits that are spelled one after the other, and a plus before them, stand together
            if not (digits_end == end and sign.isdigit() and shown[end:start] in ("", " ", "-", ", ")):
                copy(end, start)
            out.append(sign)
            first.append(np.array([start]))
            last.append(np.array([stop]))
            spoken.append(np.array([bool(word)]))
            end = stop
            digits_end = end if word and (sign.isdigit() or sign == "+") else -1
        copy(end, len(shown))
        self.source, self.text = text, "".join(out)
        self.first, self.last, self.spoken = (np.concatenate(x) for x in (first, last, spoken))

    def identifiers(self) -> Iterator[tuple[str, int, int, str]]:
        """(kind, start, stop, plain text) in the source of identifiers that differ from it.

        An address whose @ was a plain word needs a dot that was written out as well, and one with a plain word for @ or a dot a known ending: prose has such words, too.
        """
        for kind, s, e in identifiers(self.text):
            start, stop, found = int(self.first[s]), int(self.last[e - 1]), self.text[s:e]
            if found == self.source[start:stop]:
                continue
            if kind == "email" and self.spoken[s:e].any():
                at = found.index("@")
                signs = [i for i in range(at, len(found)) if found[i] in "@." and self.spoken[s + i]]
                written_out = any(found[i] == "." and self.last[s + i] - self.first[s + i] > 1 for i in range(at, len(found)))
                if signs and (found.rpartition(".")[2].lower() not in ENDINGS or signs[0] == at and not written_out):
                    continue
            yield kind, start, stop, found


def spans_of(text: str, disguises: bool) -> list[tuple[str, int, int, bool, str]]:
    """(kind, start, stop, base, value) by start, then kind as listed, then stop."""
    spans = [(kind, start, stop, True, text[start:stop]) for kind, start, stop in identifiers(text)]
    if disguises:
        known = {kind: [s for s in spans if s[0] == kind] for kind in KINDS}
        for kind, start, stop, value in Plain(text).identifiers():
            at = bisect.bisect_right(known[kind], start, key=lambda s: s[1]) - 1
            if at < 0 or known[kind][at][2] < stop:
                spans.append((kind, start, stop, False, value))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2], not s[3]))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """E-mail and IP addresses, card and phone numbers of every text, one row per row: the id and spans (kind, start, stop, base, value) in code points.

    Base spans stand in the text as they are. Further spans, with ``base`` false, are found in the text after its disguises were undone: look-alike letters, digits and signs of other scripts, invisible characters,
    digits written as words, and at, dot and other signs written as words or in brackets; they are given by their place in the source with their plain form as value, unless a base span
    of their kind holds them whole. Base spans are never changed by them. Null is the empty text, which has no spans. Whole texts are read in linear time, each row alone, whatever its id and other columns hold;
    repeated rows give repeated results, and an empty table an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).fill_null("")
            hidden = pc.match_substring_regex(texts, disguise_pattern())
            spans = [spans_of(t.as_py(), d.as_py()) for t, d in zip(texts, hidden, strict=True)]
            flat = [s for found in spans for s in found]
            columns = [pa.array([s[i] for s in flat], f.type) for i, f in enumerate(SPAN)]
            at = np.concatenate(([0], np.cumsum([len(x) for x in spans])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(SPAN)))], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {OUT}")
