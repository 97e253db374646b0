"""Archives, mixing, page text, packing and the pipeline: round trips, exact totals, held-out pages."""

import base64
import gzip
import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from tests.llm.page_layouts import LAYOUTS, Words
from tests.llm.test_text_operators import brute_classes, docs, empty, plain_resampling
from trackweave.llm import packing, warc
from trackweave.llm.html_pages import PageMaker
from trackweave.llm.html_text import BLOCKS, Dom, decode, extract_main_text, features, main_text, trained
from trackweave.llm.mixing import mixing_plan, mixture, splitting_tree

PAGES = "page_id long, url string, html string, archive string, offset long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def test_archives_round_trip(spark):
    rows = [(i, f"http://h/{i} x", h) for i, h in enumerate(["<p>a</p>", "b", "<p>a</p>", None, "", "é" * 5000, "b", "<p>a</p>", "WARC/1.1\r\n\r\n", "line\nfiledesc://x 1"])]
    rows += [(3, None, "b"), (None, "http://n", "b")]
    got = warc.archive_pages(pages(spark, rows)).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    by_digest = {base64.b32encode(hashlib.sha1(k).digest()).decode(): (k, v) for k, v in groups.items()}
    for r in got:
        body, ids = by_digest[r.payload_digest]
        first = min(i for i in ids if i is not None)
        assert r.payload_bytes == len(body)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first else ("revisit", first))
    assert warc.archive_pages(pages(spark, [])).collect() == []
    few = warc.read_warc(warc.arc_to_warc(warc.write_arc(pages(spark, rows), 500), least_bytes=2)).collect()
    assert sum(r.record_type == "response" for r in few) == len(rows) - 2 and len({r.archive for r in few}) > 2


def test_arc_versions_and_damage():
    for version in (1, 2):
        body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nhello"
        data = warc.arc_start(version, "f.arc") + warc.arc_header(version, "http://a b/c", "20010203040506", "text/html", len(body), 0, "f.arc") + body + b"\n"
        data += b"rubbish line\n" + warc.arc_header(version, "dns:x", "200102", "text/dns", 99, 0, "f.arc") + b"short"
        for stored in (data, gzip.compress(data)):
            (start, _, _), (one, at, block), (cut, _, rest) = warc.parse_arc(stored)
            assert start["Version"] == str(version) and (one["URL"], block) == ("http://a b/c", body) and cut["truncated"] and rest == b"short"
        converted = list(warc.parse_warc(warc.convert_arc("f.arc", data, {})))
        assert [f["WARC-Type"] for f, _ in converted] == ["warcinfo", "response", "resource"]
        assert converted[1][0]["WARC-Date"] == "2001-02-03T04:05:06Z" and converted[1][0]["WARC-Payload-Digest"] == "sha1:" + warc.base32_sha1(b"hello")
        assert converted[1][0]["WARC-Record-ID"] == warc.record_id("f.arc", at) and converted[2][0]["WARC-Truncated"] == "length"


def waterfill(sizes, weights, total):
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    while True:
        left = total - sum(target[s] for s in sizes if s not in open_)
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
        open_ -= over
        if not open_:
            return target


def test_mixing(spark):
    d = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 11 != 0, F.col("source")))
    plan = mixing_plan(d).collect()
    source = {r.doc_id: r.source for r in d.collect()}
    assert len(plan) == len(source)
    sizes, taken, goal, largest = Counter(), Counter(), {}, Counter()
    for r in plan:
        s = source[r.doc_id]
        sizes[s] += r["size"]
        taken[s] += r["size"] * len(r.draws)
        goal[s] = r.target
        largest[s] = max(largest[s], r["size"])
        assert len(r.draws) <= 2
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = waterfill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    for s in sizes:
        assert goal[s] == pytest.approx(want[s]) and abs(taken[s] - goal[s]) <= largest[s]
    again = {r.doc_id: r.draws for r in mixing_plan(d.repartition(7)).collect()}
    assert again == {r.doc_id: r.draws for r in plan}
    mixed = Counter(r.doc_id for r in mixture(d).collect())
    assert mixed == Counter({r.doc_id: len(r.draws) for r in plan if r.draws})


def test_mixing_edges(spark):
    assert mixing_plan(empty(spark)).collect() == [] and mixture(empty(spark)).collect() == []
    rows = mixing_plan(docs(spark, [None, "", "a b", "a b", "c " * 4000], [1, 1, 2, 2, None])).collect()
    assert len(rows) == 5 and sorted(r["size"] for r in rows) == [0, 0, 2, 2, 4000]


def test_mixture_tells_rows_of_one_id_apart(spark):
    d = docs(spark, [f"t{i} a b" for i in range(40)], [i // 4 if i < 36 else None for i in range(40)])
    draws = sum(len(r.draws) for r in mixing_plan(d).collect())
    rows = Counter(r.text for r in mixture(d).collect())
    assert sum(rows.values()) == draws and max(rows.values()) <= 2
    same = mixture(docs(spark, ["a b"] * 4, [3, 3, None, None]))
    assert same.count() == sum(len(r.draws) for r in mixing_plan(docs(spark, ["a b"] * 4, [3, 3, None, None])).collect())


def test_mixing_of_more_sources_than_a_table_holds(spark, monkeypatch):
    from trackweave.llm import mixing

    monkeypatch.setattr(mixing, "LARGEST_TABLE", 64 * 3)
    monkeypatch.setattr(mixing, "GROUP_BLOCKS", 50)
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('a b ', 1 + id % 5)").alias("text"), F.expr("if(id % 300 = 0, null, 's' || id % 701)").alias("source"))
    rows = mixing.mixing_plan(d).collect()
    assert len(rows) == 3000
    taken, goal, largest, shards = Counter(), {}, Counter(), Counter()
    source = {r.doc_id: r.source for r in d.collect()}
    for r in rows:
        s = source[r.doc_id]
        taken[s] += r["size"] * len(r.draws)
        goal[s], largest[s] = r.target, max(largest[s], r["size"])
        shards.update({x.shard for x in r.draws})
    assert len(goal) == 702 and all(abs(taken[s] - goal[s]) <= largest[s] / 2 + 1e-6 for s in goal)
    assert set(shards) == set(range(64))


def test_group_shares_are_exact_and_even():
    from trackweave.llm.mixing import group_shares

    quotas, totals = np.array([50, 7, 0, 1000]), np.array([300, 0, 57, 700])
    mean = np.zeros((4, 4))
    for seed in range(300):
        out = np.zeros((4, 4), dtype=np.int64)
        for shard, at, n in group_shares(quotas, totals, seed):
            out[shard, at] = n
        assert out.sum(axis=0).tolist() == quotas.tolist() and out.sum(axis=1).tolist() == totals.tolist()
        mean += out / 300
    assert mean == pytest.approx(np.outer(totals, quotas) / quotas.sum(), abs=2.5)


def test_splitting_tree_is_exact():
    quotas = np.array([50, 7, 0, 1000])
    shares = splitting_tree(quotas, 8)
    assert shares.sum(axis=0).tolist() == quotas.tolist() and (shares >= 0).all()
    assert set(shares.sum(axis=1)) <= {132, 133} and (shares == splitting_tree(quotas, 8)).all()
    mean = np.mean([splitting_tree(quotas, 2, seed)[0] for seed in range(300)], axis=0)
    assert mean == pytest.approx(quotas / 2, abs=2.5)


def test_main_text_of_held_out_pages():
    maker, good, total = PageMaker(4242), 0, 150
    for _ in range(total):
        page, pieces = maker.page()
        good += main_text([Dom(page)], trained())[0] == " ".join(" ".join(p.split()) for p in pieces)
    assert good / total > 0.93


@pytest.mark.parametrize("name", LAYOUTS)
def test_main_text_of_layouts_written_apart(name):
    good = 0
    for seed in range(40):
        page, pieces = LAYOUTS[name](Words(seed))
        good += main_text([Dom(page)], trained())[0] == " ".join(pieces)
    assert good >= 38


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x" + "</div>" * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<div>" * 50_000 + "<li>x" * 50_000, "<div>" * 16_000 + "</section>" * 16_000])
def test_deep_pages_take_linear_time(page):
    model = trained()
    start = time.process_time()
    main_text([Dom(page)], model)
    assert time.process_time() - start < 15


def test_features_against_walks_over_the_tree():
    dom = Dom("<body><div class='post'>a<p>b <b>c</b><ul class=nav><li class=k>d<li class=k>e<p>f</ul></div><p>j<nav>g<div>© h</nav>i</body>")
    x = features([dom])
    n = len(dom.kind)
    chain = [[i] for i in range(n)]
    for c in chain:
        while dom.parent[c[-1]] >= 0:
            c.append(dom.parent[c[-1]])
    below = [[j for j in range(n) if i in chain[j]] for i in range(n)]
    for i in range(n):
        assert below[i] == list(range(i, dom.last[i] + 1)) and x[i, 19] == dom.depth[i] == len(chain[i]) - 1
        assert x[i, 7] == sum(dom.plus[j] for j in chain[i] if j) and x[i, 8] == sum(dom.minus[j] for j in chain[i] if j)
        assert x[i, 11] == pytest.approx(np.log1p(sum(len(t) for j in below[i] for t in dom.text[j])))
        behind = range(dom.last[i] + 1, n)
        paras = [j for j in range(n) if dom.kind[j] == BLOCKS.index("p")]
        alike = [j for j in range(1, n) if i and dom.alike[i] and dom.parent[j] == dom.parent[i] and dom.alike[j] == dom.alike[i]]
        assert x[i, 34] == pytest.approx(np.log1p(sum(t.count("©") for j in below[i] for t in dom.text[j])))
        assert x[i, 38] == pytest.approx(np.log1p(sum(j < i for j in paras))) and x[i, 39] == pytest.approx(np.log1p(sum(j in behind for j in paras)))
        assert x[i, 41] == len(alike) and x[i, 44] == sum(dom.parent[j] == dom.parent[i] for j in paras)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p data-x=it's>A don't b.</p><p title='x>y' class=\"a'b\">C.</p>", "A don't b. C."),
        ("<head><title>t</title><meta charset=x><p>Article <b>one</b>.<p>Two.", "Article one. Two."),
        ("<html><head><title>t</title>Text at once.", "Text at once."),
        ("<head><style>a</style></head><body><p>A.</p>", "A."),
        ("<p>A.<button>b<p>C.</p>", "A. C."),
        ("<div><button>b</div>C.<svg><g><p>D.</p>E.", "C. D. E."),
        ("<div>A <object data=x>o</div><p>B.<button>b<p>C.<button>b</button></p>", "A o B. C."),
        ("<p>A <video><p>Old browser</video> B <svg><svg></svg>x</svg><select><option>o</select>C", "A B C"),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.", "Let x=1 be."),
        ("<p>A.<script>for(i=0;i<n;i++){}</script><p>B.", "A. B."),
        ("<p>A.<script>i<n;s='it';t=\"</script><p class=\"x\">B.</p><script>'<p>'</script>C.", "A. B. C."),
        ("<p>A.<script>if(a<b)'x", "A."),
    ],
)
def test_pages_with_omitted_tags_keep_their_text(page, want):
    assert " ".join(t for texts in Dom(page).text for t in texts) == want


def test_main_text_of_pages(spark):
    real = spark.read.parquet(f"{SF}/pages.parquet")
    for r in extract_main_text(real).join(real.select("page_id", "html"), "page_id").collect():
        assert r.n_chars == len(r.text) > 0 and r.text in " ".join(Dom(r.html).text[i][0] for i in range(len(Dom(r.html).kind)) if Dom(r.html).text[i])
        assert "&copy;" not in r.text and "track(" not in r.text and "<" not in r.text
    article = "<article><h1>Big title &amp; more</h1><p>First  part\n of a<b>b</b> sentence, and so on.</p><p>Second &eacute; part, with more words in it.</p></article>"
    rows = [(1, "u", f"<html><body><nav><a href=x>menu</a></nav>{article}<footer>&copy; x</footer></body></html>"), (2, None, None), (3, "u", ""), (4, "u", "<script>x"), (5, "u", "<!-- " + "<div>" * 300), (5, "u", "<p>" + "word " * 50_000)]
    got = sorted(map(tuple, extract_main_text(pages(spark, rows)).collect()))
    assert got[0][2] == "Big title & more First part of ab sentence, and so on. Second é part, with more words in it."
    assert len(got) == 6 and got[1][2:] == ("", 0) and got[2][2] == "" and got[3][2] == ""
    assert extract_main_text(pages(spark, [])).collect() == []


def test_decoding_is_consistent():
    r = np.random.default_rng(1)
    for _ in range(50):
        n = 12
        parent = [-1, *[int(r.integers(0, i)) for i in range(1, n)]]
        odds = r.normal(size=n) * 3
        keep = decode(parent, odds)
        assert all(keep[parent[i]] or not keep[i] for i in range(1, n))
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        best = -np.inf
        for mask in range(1 << (n - 1)):
            k = [True, *[bool(mask >> i & 1) for i in range(n - 1)]]
            if all(k[parent[i]] or not k[i] for i in range(1, n)):
                best = max(best, sum(yes[i] if k[i] else no[i] for i in range(n)))
        assert sum(yes[i] if keep[i] else no[i] for i in range(n)) == pytest.approx(best)


def test_encoder_gives_the_tokenizers_ids():
    import random

    e, r = packing.Encoder(packing.tokenizer_file()), random.Random(1)
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    parts = ["'", "s", "t", "re", "ll", "m", " ", "  ", "\n", "\t", "a", "B", "é", "1", "٣", "!", "''", "—", "中", "'S", "x'", "<|endoftext|>", "<|", "endoftext|>", "\u0085", " ", "😀"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(4000)]
    for lot in (texts, [t for t in texts if "😀" not in t], [t for t in texts if "😀" not in t and "<|endoftext|>" not in t], ["", "hello <|endoftext|> world", ""]):
        ids, at = e.encode(lot)
        for i, t in enumerate(tokenizer.encode_batch(lot, add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == t.ids, lot[i]
    assert 50256 in ids and e.encode([])[0].tolist() == []
    # Thue-Morse texts and their mirrors have equal polynomial hashes modulo 2**64
    morse = "a"
    while len(morse) < 4096:
        morse += morse.translate(str.maketrans("ab", "ba"))
    pair = [morse, morse.translate(str.maketrans("ab", "ba"))]
    for lot in (pair, pair[::-1], pair[:1], pair[1:], [" ".join(pair), "x " + pair[1]]):
        ids, at = e.encode(lot)
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(lot))] == [x.ids for x in e.tokenizer.encode_batch(lot, add_special_tokens=False)]


def test_packing(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumn("length", F.lit(1)).withColumn("text", F.when(F.col("doc_id") == 6, F.concat("text", F.lit(" <|endoftext|> end"))).when(F.col("doc_id") != 5, F.col("text")))
    d = d.unionByName(d.filter("doc_id = 7")).unionByName(d.filter("doc_id = 9").withColumn("text", F.repeat("text", 40)).withColumn("doc_id", F.lit(-1).cast("long")))
    rows = packing.pack(d).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    total, per_doc, bins = 0, defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for r in d.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        total += len(ids)
        pieces = {p.piece: p for p in per_doc[r.doc_id]}
        assert sorted(pieces) == list(range(-(-len(ids) // 2048)))
        at = 0
        for k in sorted(pieces):
            p = pieces[k]
            assert p.start == at and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and (k == 0 or p.length == 2048)
            at += p.length
        assert at == len(ids)
    assert sum(r.length for r in rows) == total
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) * 1.02 + 1
    assert packing.pack(empty(spark)).collect() == []


def test_best_two_fit_replaces_the_smallest():
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10) == [([6, 2, 2], 1), ([3], 1)]
    r = np.random.default_rng(3)
    counts = dict(Counter(r.integers(1, 2048, size=3000).tolist()))
    out = packing.best_two_fit(counts)
    used = Counter()
    for lengths, times in out:
        assert sum(lengths) <= 2048
        for x in lengths:
            used[x] += times
    assert used == counts and sum(t for _, t in out) <= sum(k * v for k, v in counts.items()) / 2048 * 1.02 + 1


def test_pipeline_against_plain_python(spark):
    import corpus_pipeline
    from trackweave.llm import quality

    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").collect()
    steps = {name: f for name, f in corpus_pipeline.STAGES}
    assert list(steps) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]

    def stage(name, before):
        after = steps[name](spark, before, SF)
        return spark.createDataFrame(after.toPandas(), after.schema)

    rows = [(r.doc_id, r.text) for r in d.collect()]
    fits = {r.doc_id: not xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little"), xxhash.xxh64_intdigest((11).to_bytes(4, "little"), 42)) & 1 for r in labels}
    good = [r.doc_id for r in labels if r.quality]
    every = plain_resampling(rows, {i for i in good if fits[i]}, len(rows))
    held = sorted(s for i, s, *_ in every if i in good and not fits[i])
    cutoff = held[int(len(held) * quality.LOST)] - 1e-12
    want = plain_resampling(rows, {i for i in good if fits[i]}, sum(s >= cutoff for _, s, *_ in every))
    one = stage("quality classifier", d)
    assert sorted(r.doc_id for r in one.collect()) == sorted(w[0] for w in want if w[3]) and one.columns == d.columns

    two, first = stage("exact dedup", one), {}
    for r in one.orderBy("doc_id").collect():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    assert sorted(r.doc_id for r in two.collect()) == sorted(first.values()) and two.columns == d.columns

    three, texts = stage("n-gram Jaccard join", two), two.collect()
    assert sorted(r.doc_id for r in three.collect()) == sorted({c for _, c, _ in brute_classes([r.text for r in texts], [r.doc_id for r in texts])}) and three.columns == d.columns

    four = stage("mixing sources to target weights", three)
    sizes, taken, largest = Counter(), Counter(), Counter()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in three.collect()}
    for r in three.collect():
        sizes[r.source] += size[r.doc_id]
        largest[r.source] = max(largest[r.source], size[r.doc_id])
    times = Counter(r.doc_id for r in four.collect())
    for r in four.collect():
        taken[r.source] += size[r.doc_id]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = waterfill(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    assert max(times.values()) <= 2 and set(times) <= set(size) and all(abs(taken[s] - goal[s]) <= largest[s] for s in sizes) and four.columns == d.columns

    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    five = stage("best-fit packing", four).collect()
    lengths = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in three.collect()}
    assert Counter({i: n * lengths[i] for i, n in times.items()}) == sum((Counter({r.doc_id: r.length}) for r in five), Counter())
    bins = Counter()
    for r in five:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048 and len(bins) <= -(-sum(bins.values()) // 2048) * 1.02 + 1
    assert corpus_pipeline.run(spark, SF).count() == len(five)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    given = ["", None, "a b", "a b", "word " * 3000, *[f"t{i} some words of its own here" for i in range(20)], None]
    d = docs(spark, given, [None, None, 2, 2, 4, *range(3, 23), 7])
    for rows in (d, d.filter("false")):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, rows, SF)
            assert i == 4 or after.columns == d.columns
            n = after.count()
            assert (n == 0) == (rows is not d)
