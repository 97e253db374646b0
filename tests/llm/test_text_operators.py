"""Licence scan, exact dedup, Jaccard join, repeated passages, fingerprints, quality: against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from trackweave.llm import quality
from trackweave.llm import words as WD
from trackweave.llm.components import connected_components
from trackweave.llm.exact_dedup import drop_copies, exact_groups
from trackweave.llm.fingerprints import fingerprint, fingerprint_edits, likeness, sketches
from trackweave.llm.licenses import TEMPLATES, scan_licenses, words_of
from trackweave.llm.ngram_join import jaccard_join, keep_one_of_each, least_matches, overlaps
from trackweave.llm.quality import fit_quality, keep_good, kth_largest
from trackweave.llm.suffixes import repeated_passages

SCHEMA = "doc_id long, text string, source string, node string, n long, block long, kept boolean, `end` string, `doc` string, `row` long, key string, `a.b` string"


def docs(spark, texts, ids=None):
    """Documents with extra columns whose names operators use themselves."""
    rows = [(i if ids is None else ids[i], t, None if i % 5 == 0 else f"s{i % 3}", "x", 1, 2, True, "y", None, 3, "k", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefgé", k=r.randint(2, 6))) for _ in range(400)]
    passage = " ".join(r.choices(vocabulary, k=60))
    out = []
    for i in range(60):
        out.append(" ".join(r.choices(vocabulary, k=r.randint(60, 160))))
    for i in range(12):  # near copies of one text
        w = out[0].split()
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [out[5]] * 4 + [out[5].upper() + "!!", out[6] + ".", passage, "start " + passage + " tail", out[7] + " " + passage]
    out += ["", None, None, "   \n ", "one two", "one two", "!!!", "a b c d e", "x" * 5000 + " word", " ".join(["same"] * 300), " ".join(vocabulary * 40)]
    return out


def empty(spark):
    return docs(spark, ["x"]).filter("false")


def shingles(text):
    w = words_of(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_words_match_the_pattern(texts):
    plain = [t or "" for t in texts]
    got = [[bytes(w.lower[s:e]).decode() for s, e in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)] for w in WD.batch_words(pa.array(texts, pa.string()), 3000) for i in range(w.n_texts)]
    assert got == [words_of(t) for t in plain]
    sets = [set(v[b[i] : b[i + 1]].tolist()) for w in WD.batch_words(pa.array(texts, pa.string()), 3000) for v, b in [WD.shingle_sets(w)] for i in range(w.n_texts)]
    for i in range(0, len(texts), 3):
        assert len(sets[i]) == len(shingles(texts[i]))
        for j in range(0, len(texts), 7):
            assert len(sets[i] & sets[j]) == len(shingles(texts[i]) & shingles(texts[j]))


def best_cover(text, template):
    """Most words of the template that matches of three words and more cover in the order of both, at most 40 words of text apart."""
    found = []
    for i in range(len(text)):
        for j in range(len(template)):
            if text[i] == template[j] and not (i and j and text[i - 1] == template[j - 1]):
                n = 1
                while i + n < len(text) and j + n < len(template) and text[i + n] == template[j + n]:
                    n += 1
                if n >= 3:
                    found.append((i, j, n))
    best = []
    for i, j, n in found:
        before = [b + n - max(0, u + m - i, v + m - j) for (u, v, m), b in zip(found, best, strict=False) if u < i and v < j and u + m < i + n and v + m < j + n and i - u - m <= 40]
        best.append(max([n, *before]))
    return max(best, default=0)


def test_license_chains_find_every_cover(spark):
    r = random.Random(12)
    templates = {label: words_of(texts[0]) for label, texts in TEMPLATES.items() if label in ("mit", "bsd", "apache", "lgpl")}
    given, want = [], []
    for label, template in templates.items():
        quoted = [*template[:40], *template[-4:], *template[40:]]
        given.append((label, quoted))
        for _ in range(25):
            text = [w if r.random() > 0.05 else "other" for w in template]
            for _ in range(r.randint(0, 3)):
                at, a = r.randrange(len(text)), r.randrange(len(template) - 6)
                text[at:at] = template[a : a + r.randint(3, 6)]
            given.append((label, ["some"] * r.randint(0, 3) + text))
    for label, text in given:
        want.append(best_cover(text, templates[label]) / len(templates[label]))
    got = {x.doc_id: x for x in scan_licenses(docs(spark, [" ".join(t) for _, t in given])).collect()}
    found = 0
    for i, ((label, _), cover) in enumerate(zip(given, want, strict=True)):
        own = [s.coverage for s in got[i].spans if s.label == label]
        assert (label in got[i].labels.split(",")) >= (cover >= 0.75)
        assert not own or max(own) >= min(1.0, cover) - 1e-9 or cover < 0.75
        found += cover >= 0.75
    assert found > 40 and all(want[i] == 1.0 and given[i][0] in got[i].labels for i in range(0, len(given), 26))


def test_license_scan(spark):
    notice = TEMPLATES["bsd"][0]
    given = [
        "Released under the MIT License.\nApache-License and mit   LICENSE", "no permit licenses", None, "", "general public license " * 3, f"pre {notice} post", notice.replace("binary", "binary tiny", 1),
        "MIT", "the mit", "mité license", "x " * 9000 + "gnu general public license", "Licensed under CC BY-NC 4.0.", "x " + TEMPLATES["lgpl"][0], TEMPLATES["agpl"][0] + " y",
    ]
    rows = {r.doc_id: r for r in scan_licenses(docs(spark, given)).collect()}
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, text in enumerate(given):
        w = words_of(text or "")
        places = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert rows[5].labels == rows[6].labels == "bsd" and rows[5].spans[0].first == 1 and rows[5].score == 1
    for i, label in ((12, "lgpl"), (13, "agpl")):
        assert label in rows[i].labels.split(",") and "gpl" in rows[i].base_labels + ",gpl"
    assert rows[11].labels == "cc-by-nc" and rows[1].labels == ""
    assert scan_licenses(empty(spark)).collect() == []


def test_exact_groups(spark, texts):
    df = docs(spark, [*texts, "a\t\n b", "a b"])
    norm = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in df.collect()}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for r in exact_groups(df).collect():
        g = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(g), len(g), r.doc_id == min(g), hashlib.sha256(norm[r.doc_id].encode()).hexdigest())
    kept = drop_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())
    assert exact_groups(empty(spark)).collect() == [] and drop_copies(empty(spark)).collect() == []
    odd = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(docs(spark, ["q", "q", "q", "z"], [None, 4, 4, None])).collect()}
    assert odd == {(None, 4, 3, False), (4, 4, 3, True), (None, None, 1, False)}


def brute_classes(texts, ids):
    sets = [shingles(t) for t in texts]
    n = len(texts)
    links, group = [0] * n, list(range(n))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(n):
        for j in range(n):
            if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                group[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(n):
        least[find(i)].append(ids[i])
    return {(ids[i], min(least[find(i)]), links[i]) for i in range(n)}


def test_jaccard_join(spark, texts):
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join(docs(spark, texts)).collect()}
    assert got == brute_classes(texts, list(range(len(texts))))
    repeated = [texts[0], texts[0], texts[61], texts[3], None]
    rows = sorted((r.doc_id, r.class_id, r.copies, r.n_links) for r in jaccard_join(docs(spark, repeated, [7, 7, 5, 9, 1])).collect())
    assert rows == [(1, 1, 1, 0), (5, 5, 1, 2), (7, 5, 2, 2), (7, 5, 2, 2), (9, 9, 1, 0)]
    assert jaccard_join(empty(spark)).collect() == []
    kept = sorted(r.doc_id for r in keep_one_of_each(docs(spark, texts)).collect())
    assert kept == sorted({c for _, c, _ in got})


def test_repeated_and_null_ids_lose_no_text(spark):
    def kept(f, texts, ids):
        return sorted(((r.doc_id, r.text) for r in f(docs(spark, texts, ids)).collect()), key=str)

    # b is unique but shares its id with a; the second c (id 1) is a copy of id 0; null ids: d is unique, e stands twice
    exact = kept(drop_copies, ["a", "b", "c", "c", "d", "e", " e"[1:], "c", "a"], [1, 1, 0, 1, None, None, None, None, 1])
    assert exact == sorted([(1, "a"), (1, "b"), (0, "c"), (None, "d"), (None, "e")], key=str)
    r = random.Random(4)
    x, y, z = (" ".join(f"{k}{r.randrange(10**6)}" for _ in range(60)) for k in "xyz")
    # x and y share an id; near copies of x have id 5, of z null ids only; two texts without words
    texts = [x, y, x + " end", z, z + " end", z + " end", x, "...", "!"]
    near = kept(keep_one_of_each, texts, [1, 1, 1, None, None, None, 5, None, None])
    assert len(near) == 5 and {(1, y), (None, "..."), (None, "!")} < set(near)
    assert sum(t.startswith(x) and i == 1 for i, t in near) == 1 and sum(t.startswith(z) for _, t in near) == 1
    links = sorted((r.doc_id is None, r.n_links) for r in jaccard_join(docs(spark, texts[3:6], [None] * 3)).collect())
    assert links == [(True, 2)] * 3


def test_large_group_is_dealt_to_blocks(spark, monkeypatch):
    from trackweave.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = random.Random(1)
    base = [f"w{r.randrange(500)}" for _ in range(200)]
    near = []
    for i in range(50):
        w = list(base)
        w[r.randrange(200)] = f"z{i}"
        near.append(" ".join(w))
    got = {(x.doc_id, x.class_id, x.n_links) for x in jaccard_join(docs(spark, near)).collect()}
    assert got == brute_classes(near, list(range(50)))


def test_pruning_keeps_likely_pairs():
    needed = least_matches(0.8, 1e-5)
    assert needed == sorted(needed) and needed[-1] < 0.8 * 96
    a = [np.array(sorted(s), dtype=np.uint64) for s in ([1, 2, 3], [2, 3, 4], [9], [1, 2, 3, 4, 9])]
    i, j = np.triu_indices(4, 1)
    want = [len(set(a[x].tolist()) & set(a[y].tolist())) for x, y in zip(i, j, strict=True)]
    assert overlaps(a, i, j).tolist() == want
    assert overlaps(a, np.tile(i, 4), np.tile(j, 4)).tolist() == want * 4


def test_connected_components(spark):
    r = random.Random(5)
    edges = [(x, x + 1) for x in range(100, 160)] + [(r.randrange(40), r.randrange(40)) for _ in range(25)]
    edges = [e for e in edges if e[0] != e[1]]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, got.collect())) == label


def test_repeated_passages(spark, texts):
    least = 50
    seen, words = defaultdict(set), {}
    for d, t in enumerate(texts):
        words[d] = w = words_of(t or "")
        for i in range(len(w) - least + 1):
            seen[tuple(w[i : i + least])].add(d)
    want = {}
    for d, w in words.items():
        starts = [i for i in range(len(w) - least + 1) if len(seen[tuple(w[i : i + least])]) > 1]
        later = {j for i in starts if min(seen[tuple(w[i : i + least])]) < d for j in range(i, i + least)}
        spans = []
        for i in starts:
            if spans and i < spans[-1][1]:
                spans[-1][1] = i + least
            else:
                spans.append([i, i + least])
        want |= {(d, b, e - 1): len(later & set(range(b, e))) for b, e in spans}
    got = {(r.doc_id, r.first_word, r.last_word): r.later for r in repeated_passages(docs(spark, texts)).collect()}
    assert got == want and len(want) > 15
    assert repeated_passages(empty(spark)).collect() == []
    rows = sorted(((r.doc_id is None, r.n_words, r.later) for r in repeated_passages(docs(spark, [texts[0]] * 3, [4, 4, None])).collect()))
    n = len(words_of(texts[0]))
    assert rows == [(False, n, 0), (False, n, 0), (True, n, n)]
    # a passage in rows of one id, and in rows without ids
    r = random.Random(6)
    shared, own = (" ".join(f"{k}{r.randrange(10**6)}" for _ in range(60)) for k in "ps")
    odd = sorted((str(x.doc_id), x.first_word, x.n_words, x.later) for x in repeated_passages(docs(spark, [shared, "a b " + shared, "c " + shared, own, own + " d"], [3, 3, None, None, None])).collect())
    assert sorted(x[2] for x in odd) == [60] * 5 and sorted(x[3] for x in odd) == [0, 0, 60, 60, 60]
    assert [x[3] for x in odd if x[0] == "None" and x[1] == 1] == [60]


def test_longest_neighbour_is_not_enough():
    # of the sorted suffixes at "m", the neighbour of the first text shares more to the right; the third shares the passage that begins left of it
    left, right, more = [f"l{i}" for i in range(30)], [f"r{i}" for i in range(20)], ["s", "t"]
    a, b, c = [*left, *right, *more, "u"], ["x", *right, *more, "v"], [*left, *right, "w"]
    order = sorted((t[t.index("r0") :], n) for n, t in (("a", a), ("b", b), ("c", c)))
    assert [n for _, n in order] == ["a", "b", "c"] and a[:50] == c[:50]


def test_frequent_keys_are_joined_in_place(spark):
    from trackweave.llm.suffixes import split_join

    rows = spark.range(6000).select(F.expr("if(id % 3 = 0, 0, id)").alias("key"), "id")
    keys = rows.filter("key % 2 = 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    got = split_join(rows, keys, "key", 100)
    assert sorted(r.id for r in got.collect()) == [i for i in range(6000) if (i if i % 3 else 0) % 2 == 0]


def test_fingerprint_edits(spark, texts):
    ids = [3 * i % 101 for i in range(len(texts))]
    got = {r.doc_id: r for r in fingerprint_edits(docs(spark, texts, ids)).collect()}
    assert len(got) == len(texts)
    order = sorted(range(len(texts)), key=lambda i: -ids[i])
    known = {}
    for k, i in enumerate(order):
        own, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = own[: len(own) - len(own) // 2] + nxt[: len(own) // 2]
        r = got[ids[i]]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        (ta, a), (tb, b), (tc, c) = map(plain_sketch, (own, edited, nxt))

        def near(x, tx, y, ty):
            p, q = ({h for h in s if h <= min(tx, ty)} for s in (x, y))
            return 1 if not x and not y else len(p & q) / max(len(p | q), 1)

        assert r.near_edited == pytest.approx(near(a, ta, b, tb)) and r.near_next == pytest.approx(near(a, ta, c, tc))
        assert known.setdefault(own, r.fingerprint) == r.fingerprint == ("".join(f"{x:016x}" for x in [ta, *sorted(a)]) if a else "")
    assert fingerprint_edits(empty(spark)).collect() == []
    odd = fingerprint_edits(docs(spark, ["a b", "c d", "e f", "g h"], [None, None, 5, 5])).collect()
    assert len(odd) == 4
    assert sorted(r.n_chars for r in fingerprint(docs(spark, ["abc", None])).collect()) == [0, 3]


def plain_sketch(text):
    """(largest hash it would retain, retained hashes), from all shingle hashes."""
    v, at = [], None
    for w in WD.batch_words(pa.array([text])):
        v, at = WD.shingle_sets(w)
    for top in (2**61 - 1, 2**62 - 1, 2**63 - 1, 2**64 - 1):
        kept = {h for h in map(int, v) if h <= top}
        if len(kept) >= 32:
            break
    return top, kept


def test_fingerprints_of_hot_and_null_ids(spark, monkeypatch):
    from trackweave.llm import fingerprints

    r = random.Random(9)
    ids = [*range(60), *[7] * 80, *[None] * 70]
    texts = [" ".join(f"w{r.randrange(30)}" for _ in range(r.randint(0, 40))) for _ in ids]
    d = docs(spark, texts, ids)
    whole = fingerprints.neighbour_blocks
    monkeypatch.setattr(fingerprints, "neighbour_blocks", lambda *a: whole(*a, per_block=10))
    blocks = whole(d, "doc_id", "text", per_block=10).filter("ghost = 0").groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("id")).collect()
    assert max(b.n for b in blocks) < 40 and sum(b.id == 7 for b in blocks) > 3 and sum(b.id is None for b in blocks) > 3
    tie = {i: h for i, h in enumerate(x[0] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.xxhash64("t")).collect())}
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, -(ids[i] or 0), tie[i]))
    want = Counter()
    for k, i in enumerate(order):
        own, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        want[ids[i], hashlib.sha256((own[: len(own) - len(own) // 2] + nxt[: len(own) // 2]).encode()).hexdigest()] += 1
    assert Counter((x.doc_id, x.edited_sha256) for x in fingerprint_edits(d).collect()) == want


def test_ranges_of_null_and_hot_ids_reach_the_driver_in_bounded_number(spark):
    from trackweave.llm.fingerprints import neighbour_blocks

    d = spark.range(40_000).select(F.expr("if(id % 3 = 0, null, if(id % 3 = 1, 5, id))").alias("doc_id"), F.col("id").cast("string").alias("text"))
    blocks = neighbour_blocks(d, "doc_id", "text", per_block=100, most=50).groupBy("block").agg(F.sum(1 - F.col("ghost")).alias("n"), F.sum("ghost").alias("ghosts")).collect()
    assert 40 <= len(blocks) <= 50 and sum(b.n for b in blocks) == 40_000
    assert max(b.n for b in blocks) < 2_400 and all(b.ghosts == 1 for b in blocks)


def test_texts_of_regular_words_are_told_apart():
    from trackweave.llm.suffixes import sequence_keys

    ones = [bin(i).count("1") % 2 for i in range(4096)]
    texts = [" ".join("ab"[x] for x in ones), " ".join("ba"[x] for x in ones), "", None, "a.B", " a b!", "ab", "ä b", "\u00e4-b", *["x"] * 2, "..."]
    keys = [tuple(k) for w in WD.batch_words(pa.array(texts)) for k in sequence_keys(w).tolist()]
    alike = defaultdict(list)
    for i, k in enumerate(keys):
        alike[k].append(i)
    assert sorted(alike.values()) == [[0], [1], [2, 3, 11], [4, 5], [6], [7, 8], [9, 10]]


def test_sketch_estimates_containment():
    r = random.Random(2)
    words = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    got = sketches(pa.array([" ".join(words), " ".join(words[:5000]), "a b c", " ".join(words[:60])]))
    whole, part, tiny, short = (set(got.values[got.begin[i] : got.begin[i + 1]].tolist()) for i in range(4))
    assert len(part & whole) / len(part) == 1 and len(part & whole) / len(whole) == pytest.approx(0.25, abs=0.03) and len(tiny) == 1
    assert 32 <= len(short) <= 56 and likeness(got.take(np.array([3])), got.take(np.array([0])))[1][0] == 1
    near, inside = likeness(got.take(np.array([1])), got.take(np.array([0])))
    assert inside[0] == 1 and near[0] == pytest.approx(0.25, abs=0.03)


def test_quality_on_held_out_labels(spark):
    table = SF.replace("sf0.001", "sf0.1")
    d, labels = spark.read.parquet(f"{table}/documents.parquet").withColumn("target", F.lit(1)), spark.read.parquet(f"{table}/labels.parquet")
    _, scored = fit_quality(d, labels)
    held = scored.join(labels, "doc_id").filter("pmod(xxhash64(11, doc_id), 2) <> 0")
    good = held.filter("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    junk = held.filter("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.98 and junk < 0.12


def test_quality_edges(spark, texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = docs(spark, texts)
    assert keep_good(d, none).count() == len(texts)
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    model, scored = fit_quality(d, some)
    assert scored.count() == len(texts) and keep_good(d, some).columns == d.columns
    assert fit_quality(empty(spark), some)[1].collect() == []


def plain_resampling(rows, good, k):
    """Scores, keys and the chosen rows of (id, text), from dictionaries of counts."""

    def buckets(text):
        b = (text or "").encode()
        return [((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - quality.BITS) for i in range(len(b) - 2)]

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if i in good:
            target.update(buckets(t))
    size = 1 << quality.BITS
    raw_n, target_n = sum(raw.values()) + size, sum(target.values()) + size
    out = []
    for i, t in rows:
        b = buckets(t)
        score = sum(math.log((target[x] + 1) / target_n) - math.log((raw[x] + 1) / raw_n) for x in b) / max(len(b), 1)
        h = xxhash.xxh64_intdigest((20).to_bytes(4, "little"), 42)
        h = h if i is None else xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), h)
        out.append((i, score, 200 * score - math.log(-math.log(((h >> 11) + 0.5) / 2**53))))
    least = sorted((x[2] for x in out), reverse=True)[k - 1]
    return [(*x, x[2] >= least) for x in out]


def test_resampling_against_plain_python(spark, texts):
    d = docs(spark, [*texts, texts[3]], [*range(len(texts) - 1), None, 3])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(None, 1, 0), (2, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    fitted = {i for i in range(60) if (i % 3 > 0 or i == 3) and spark.range(1).select(F.expr(f"pmod(xxhash64(11, {i}L), 2)")).first()[0] == 0}
    for k in (1, 20, 60, len(rows)):
        want = plain_resampling(rows, fitted, k)
        got = fit_quality(d, labels, k=k)[1].collect()
        order = lambda x: (x[0] is None, x[0] or 0, x[2])
        for g, w in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
            assert g[0] == w[0] and g[1] == pytest.approx(w[1], abs=1e-9) and g[2] == pytest.approx(w[2], abs=1e-6) and g[3] == w[3]
        chosen = keep_good(d, labels, k=k)
        assert chosen.columns == d.columns and Counter((r.doc_id, r.text) for r in chosen.collect()) == Counter(r for r, w in zip(rows, want, strict=True) if w[3])


def test_gumbel_keys_sample_in_proportion_to_the_weights(spark):
    # the largest of key and noise falls on each of three weights by its share
    from trackweave.llm.quality import noise

    u = spark.range(30_000).select(*[(noise(F.col("id") * 3 + i) + math.log(w)).alias(f"k{i}") for i, w in enumerate((1, 2, 5))])
    shares = u.select(*[F.avg((F.col(f"k{i}") == F.greatest("k0", "k1", "k2")).cast("double")) for i in range(3)]).first()
    assert list(shares) == pytest.approx([1 / 8, 2 / 8, 5 / 8], abs=0.015)


def test_kth_largest(spark):
    r = random.Random(8)
    values = [r.gauss(0, 1) for _ in range(500)] + [0.25] * 20
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 2, 100, 300, 520):
        assert kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
