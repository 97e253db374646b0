"""Periodic runs, whitening and personal data: against plain Python and numpy."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tests.conftest import SF
from tests.llm.test_text_operators import docs, empty
from trackweave.llm import queries
from trackweave.llm.personal import KINDS, disguise_pattern, find_personal_data, spans_of
from trackweave.llm.runs import find_runs, periodic_runs
from trackweave.llm.whitening import Whitening, exact_sums, whiten

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(words, least=6, exponent=4):
    """All maximal stretches by every period; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def repeated(r, n, vocabulary):
    words = [str(r.randrange(vocabulary)) for _ in range(n)]
    for _ in range(r.randint(0, 4) if n else 0):
        a = r.randrange(n)
        p = 1 + r.randrange(max(1, (n - a) // 3 + 1))
        for i in range(a, min(n, a + p * r.randint(3, 9) + r.randrange(p))):
            words[i] = words[a + (i - a) % p]
    return words


def test_runs_of_every_period():
    r = random.Random(1)
    for _ in range(150):
        texts = [repeated(r, r.choice([0, 1, 5, 7, 30, 100, 400, 900]), r.choice([1, 2, 3, 50])) for _ in range(r.randint(1, 6))]
        texts.append(([r.choice("ab") for _ in range(r.randint(1, 9))] * r.randint(1, 6) + ["x"]) * r.randint(3, 9))
        code = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        got = periodic_runs(np.array([code[w] for t in texts for w in t], dtype=np.int64), first)
        for i, t in enumerate(texts):
            assert [tuple(int(x[j]) for x in got[1:]) for j in np.flatnonzero(got[0] == i)] == plain_runs(t)


def test_runs_of_texts(spark):
    r = random.Random(2)
    texts = [" ".join(repeated(r, n, 9)) for n in (3, 40, 200, 700)] + ["", None, " \t\n", "a", "a " * 5, "a\x0bb\x0ca b\ta b\na b", "é x " * 9, "ab " * 30_000, "x" * 50_000]
    got = sorted(find_runs(docs(spark, texts)).collect(), key=lambda x: x.doc_id)
    for row, text in zip(got, texts, strict=True):
        words = WORD.findall(text or "")
        runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 1)]
        assert [tuple(x) for x in row.runs] == runs and row.n_words == len(words)
        assert row.collapsed == (collapsed(words, runs) if len(words) < 1000 else words[0])
    twice = find_runs(docs(spark, ["a " * 9] * 3, [4, 4, None])).collect()
    assert len(twice) == 3 and all([tuple(x) for x in t.runs] == [(0, 9, 1)] for t in twice)
    assert find_runs(empty(spark)).collect() == []
    longer = find_runs(docs(spark, ["a b " * 5]), least=11, exponent=4).collect()
    assert longer[0].runs == [] and longer[0].collapsed == " ".join(["a b"] * 5)
    with pytest.raises(ValueError):
        periodic_runs(np.zeros(3, dtype=np.int64), np.array([0, 3]), exponent=3)


def test_long_texts_take_linear_time():
    began = time.time()
    for ids in (np.zeros(300_000, dtype=np.int64), np.arange(300_000) % 1000, np.arange(300_000) % 70_000, np.random.default_rng(0).integers(0, 2, 300_000)):
        assert len(periodic_runs(ids, np.array([0, len(ids)]))[0]) > 0
    assert time.time() - began < 30


def test_periodic_runs_query(spark):
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(given)
    planted = 0
    for doc_id, text in given:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = plain_runs(words)
        r = got[doc_id]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(words, runs))
    assert planted > 5


VECTORS = "vec_id long, embedding array<float>, x string, n long, weight int, `a.b` string"


def plain_whitening(vectors, weights):
    """(distinct x, mean, eigenvalues, eigenvectors, trace) of a covariance by numpy."""
    xs = sorted({tuple(np.floor(256 * np.array(v, dtype=np.float64)).astype(int)) for v in vectors})
    x = np.array(xs)
    count = np.array([sum(tuple(np.floor(256 * np.array(v, dtype=np.float64)).astype(int)) == t for v in vectors) for t in xs]) if weights == "count" else np.ones(len(xs), dtype=int)
    v = np.cov(x.T, bias=True, fweights=count)
    values, e = np.linalg.eigh(v)
    return x, count, (x * count[:, None]).sum(0), values[::-1], e[:, ::-1], np.trace(v)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_whitening(spark, weights):
    r = np.random.default_rng(3)
    base = r.normal(size=(120, 7)) @ np.diag([9, 5, 3, 2, 1, 0.5, 0.1])
    vectors = [row.astype(np.float32).tolist() for row in base] + [base[0].astype(np.float32).tolist()] * 200
    bad = [None, [1.0, None] + [0.0] * 5, [float("nan")] * 7, [float("inf")] + [0.0] * 6, [-float("inf")] * 7]
    other = [[], [1.0, 2.0]]
    ids = [*range(len(vectors) - 3), None, None, 5]
    rows = [(i, v, "x", 1, 2, None) for i, v in zip(ids, vectors, strict=True)] + [(1000 + i, v, None, None, None, "y") for i, v in enumerate(bad + other)]
    got = whiten(spark.createDataFrame(rows, VECTORS), weights=weights).collect()
    x, count, s, values, e, trace = plain_whitening(vectors, weights)
    n = int(count.sum())
    assert len(got) == 4 * len(vectors) + 2
    assert sorted((g.vec_id, g.component, g.whitened) for g in got if g.vec_id and g.vec_id >= 1000) == [(1005, None, None), (1006, None, None)]
    sign = {}
    for g in got:
        if g.component is None or g.vec_id is None or g.vec_id == 5:
            continue
        own = np.floor(256 * np.array(vectors[g.vec_id], dtype=np.float64))
        want = (own - s / n) @ e[:, g.component - 1] / np.sqrt(values[g.component - 1])
        sign.setdefault(g.component, np.sign(want * g.whitened))
        assert abs(g.whitened - sign[g.component] * want) < 1e-9
        assert g.n == n and g.deviation == ((n * own.astype(int) - s) ** 2).sum()
        assert abs(g.explained - values[g.component - 1] / trace) < 1e-9 and g.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    table = lambda vectors: spark.createDataFrame([(i, v, "x", 1, 2, None) for i, v in enumerate(vectors)], VECTORS)
    assert whiten(table([])).collect() == [] and whiten(table([None, [float("nan")]])).collect() == []
    assert [(g.component, g.whitened, g.explained, g.identity_error) for g in whiten(table([[1.0, 2.0]] * 2)).collect()] == [(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)] * 2
    assert [(g.vec_id, g.component) for g in whiten(table([[]])).collect()] == [(0, None)]
    line = sorted(whiten(table([[0.0, 0.0], [1.0, 1.0]])).collect(), key=lambda g: (g.vec_id, g.component))
    assert [round(g.whitened, 9) for g in line] == [-1, 0, 1, 0] and line[0].identity_error < 1e-9 and [g.deviation for g in line] == [131072] * 4
    wide = sorted(whiten(table([[3e38, 1.0], [0.0, 1.0]]), components=1).collect(), key=lambda g: g.vec_id)
    assert [g.deviation for g in wide] == [None, None] and [round(g.whitened, 9) for g in wide] == [1, -1]
    far = spark.createDataFrame([([2**62, -5], 1), ([2**62, -5], 3)], "x array<long>, weight long")
    assert exact_sums(far, 2) == (4, [4 * 2**62, -20])
    huge = Whitening(2**33, [0], np.eye(1), np.ones(1), 1.0)
    assert huge.deviations(np.array([[1], [0]])) == [None, 0]
    with pytest.raises(ValueError):
        whiten(table([]), weights="two")


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0


def plain_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern in (("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def test_base_spans_are_the_patterns():
    r = random.Random(4)
    n = 0
    for signs in ("ab.@-", "0123.", "12 -+()", "a1@. +-", "0 1-", "é@a.1٣", "1.25@a"):
        for _ in range(1500):
            text = "".join(r.choice(signs) for _ in range(r.randint(0, 60)))
            want = plain_spans(text)
            assert [s[:3] for s in spans_of(text, True) if s[3]] == want
            n += len(want)
    assert n > 1000


DISGUISED = {
    "mail john dot doe at mail dot example dot com now": [("email", "john dot doe at mail dot example dot com", "john.doe@mail.example.com")],
    "john(at)example[dot]com": [("email", "john(at)example[dot]com", "john@example.com")],
    "see john [at] example.com.": [("email", "john [at] example.com", "john@example.com")],
    "j​ohn@exa\xadmple.com": [("email", "j​ohn@exa\xadmple.com", "john@example.com")],
    "user＠example．com": [("email", "user＠example．com", "user@example.com")],
    "max klammeraffe web punkt de": [("email", "max klammeraffe web punkt de", "max@web.de")],
    "juan guion paz arroba correo punto es": [("email", "juan guion paz arroba correo punto es", "juan-paz@correo.es")],
    "john_at_mail_dot_example_dot_com": [("email", "john_at_mail_dot_example_dot_com", "john@mail.example.com")],
    "one nine two dot one six eight dot zero dot one": [("ip", "one nine two dot one six eight dot zero dot one", "192.168.0.1")],
    "host 192[.]168[.]0[.]1 up": [("ip", "192[.]168[.]0[.]1", "192.168.0.1")],
    "call plus one five five five one two three four five six seven ok": [("phone", "plus one five five five one two three four five six seven", "+15551234567")],
    "+1 (743) five five five 3824": [("phone", "+1 (743) five five five 3824", "+1 (743) 555 3824")],
    "４７８５３８０５９２３９１１３９": [("card", "４７８５３８０５９２３９１１３９", "4785380592391139")],
    "card four seven eight five 3805 9239 1139 end": [("card", "four seven eight five 3805 9239 1139", "4785 3805 9239 1139")],
    "vier sieben acht fünf drei acht null fünf neun zwei drei neun eins eins drei neun": [("card", "vier sieben acht fünf drei acht null fünf neun zwei drei neun eins eins drei neun", "4785380592391139")],
    "look at the dot on the wall": [], "at home dot com": [], "meet me at this.place": [], "found at example.com": [], "un dos tres": [], "john@mail.example.com dot on": [], "the point at issue": [], "": [],
}


def test_disguises(spark):
    pattern = disguise_pattern()
    for text, want in DISGUISED.items():
        maybe = pc.match_substring_regex(pa.array([text]), pattern)[0].as_py()
        assert spans_of(text, maybe) == spans_of(text, True)
        assert [(s[0], text[s[1] : s[2]], s[4]) for s in spans_of(text, maybe) if not s[3]] == want
    # Cyrillic o: the base span stays beside the whole address
    assert [s[:4] for s in spans_of("jоhn@example.com", True)] == [("email", 0, 16, False), ("email", 2, 16, True)]
    texts = [*DISGUISED, None, "\U0001d7d2 \U0001f600 a@b.c " * 500, "x" * 100_000]
    got = sorted(find_personal_data(docs(spark, texts)).collect(), key=lambda x: x.doc_id)
    for row, text in zip(got, texts, strict=True):
        assert [tuple(s) for s in row.spans] == spans_of(text or "", True)
        assert all(s.value == text[s.start : s.stop] for s in row.spans if s.base)
    assert len(find_personal_data(docs(spark, ["a@b.c"] * 3, [4, 4, None])).collect()) == 3
    assert find_personal_data(empty(spark)).collect() == []


def test_spans_take_linear_time():
    began = time.time()
    for unit in ("1", "a", "a.", "@a.", "+1", "+1 ", " at", "one ", "[at", " ", "1.", "(", "1@"):
        spans_of(unit * (200_000 // len(unit)), True)
    assert time.time() - began < 40


def test_personal_data_query(spark):
    got = {r.doc_id: r for r in queries.op13_personal_data(spark, SF).collect()}
    n = 0
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        want = plain_spans(text or "")
        r = got.pop(doc_id)
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in want) for k in KINDS]
        assert r.base_sha256 == sha(",".join("%s:%d:%d" % s for s in want))
        assert {"%s:%d:%d" % s for s in want} <= set(r.spans.split(","))
        n += len(want)
    assert not got and n > 5
