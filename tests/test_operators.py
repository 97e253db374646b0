"""Operators against plain Python on random and hand-made input."""

import itertools
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackweave import plans
from trackweave.functions import probability as D
from trackweave.functions import strings as S
from trackweave.operators import aggregates as A
from trackweave.operators import binning as B
from trackweave.operators import filters as L
from trackweave.operators import greedy as G
from trackweave.operators import ranges as R
from trackweave.operators import reads as T
from trackweave.operators import selection as N
from trackweave.operators import windows as O


def intervals(seed, n, chroms=3, far=3000, longest=200):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        s = r.randrange(far)
        out.append((f"chr{r.randrange(chroms)}", s, s + r.randrange(1, longest)))
    return out


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("size", [7, 64, 100_000])
def test_overlap_pairs(spark, size):
    a, b = intervals(1, 120), intervals(2, 90)
    want = sorted((c, s, e, x, y) for c, s, e in a for d, x, y in b if c == d and x < e and s < y)
    got = R.overlap_pairs(frame(spark, a, "chrom string, start long, end long"), frame(spark, b, "chrom string, start long, end long"), size)
    assert sorted(map(tuple, got.select("chrom", "start", "end", "b_start", "b_end").collect())) == want


@pytest.mark.parametrize("closed", [True, False])
def test_points_in(spark, closed):
    a, r = intervals(3, 80), random.Random(4)
    pts = [(f"chr{r.randrange(3)}", r.randrange(3200)) for _ in range(200)]
    want = sorted((c, s, e, p) for c, s, e in a for d, p in pts if c == d and s <= p and (p <= e if closed else p < e))
    got = R.points_in(frame(spark, a, "chrom string, start long, end long"), frame(spark, pts, "chrom string, pos long"), 50, closed)
    assert sorted(map(tuple, got.select("chrom", "start", "end", "pos").collect())) == want


def merged(rows):
    out = []
    for c, s, e in sorted(rows):
        if out and out[-1][0] == c and s <= out[-1][2]:
            out[-1] = (c, out[-1][1], max(e, out[-1][2]))
        else:
            out.append((c, s, e))
    return out


@pytest.mark.parametrize("tile", [64, 500, 1 << 20])
def test_merge_intervals(spark, tile):
    a = [*intervals(5, 150, far=9000), ("chr0", 1, 5), ("chr0", 5, 8)]
    got = R.merge_intervals(frame(spark, a, "chrom string, start long, end long"), tile)
    assert sorted((r.chrom, r.start, r.end) for r in got.collect()) == merged(a)


def test_merge_of_nothing(spark):
    assert R.merge_intervals(frame(spark, [], "chrom string, start long, end long")).collect() == []


@pytest.mark.parametrize("tile", [50, 1 << 20])
def test_nearest(spark, tile):
    r = random.Random(6)
    pts = [(f"c{r.randrange(3)}", r.randrange(1000)) for _ in range(80)]
    marks = list({(f"c{r.randrange(2)}", r.randrange(1000)) for _ in range(30)})
    got = R.nearest(frame(spark, pts, "chrom string, pos long"), frame(spark, marks, "chrom string, pos long"), tile)
    want = [(c, p, max((m for d, m in marks if d == c and m <= p), default=None), min((m for d, m in marks if d == c and m > p), default=None)) for c, p in pts]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def points(seed, n, far=5000):
    r = random.Random(seed)
    return sorted({("c", r.randrange(far)): None for _ in range(n)})


@pytest.mark.parametrize("tile", [100, 777, 1 << 20])
def test_call_peaks(spark, tile):
    r = random.Random(7)
    pts = [(c, p, float(r.randrange(10))) for c, p in points(8, 700)]
    got = O.call_peaks(frame(spark, pts, "chrom string, pos long, value double"), 4, min_length=30, max_gap=15, span=5, tile=tile)
    runs = []
    for c, p, v in pts:
        if v >= 4:
            if runs and p - runs[-1][-1][0] <= 15:
                runs[-1].append((p, v))
            else:
                runs.append([(p, v)])
    want = [(x[0][0], x[-1][0] + 5, max(x, key=lambda q: (q[1], -q[0]))[0], max(v for _, v in x), len(x)) for x in runs if x[-1][0] - x[0][0] + 5 >= 30]
    assert sorted((r.start, r.end, r.summit, r.score, r.n) for r in got.collect()) == sorted(want)


def test_last_region_is_kept(spark):
    got = O.call_peaks(frame(spark, [("c", 1, 9.0), ("c", 5, 9.0)], "chrom string, pos long, value double"), 1, min_length=2, max_gap=10)
    assert [(r.start, r.end) for r in got.collect()] == [(1, 6)]


@pytest.mark.parametrize("tile", [16, 1 << 20])
def test_neighbours_across_tiles(spark, tile):
    pts = [(c, p, float(p % 7)) for c, p in points(12, 120, 900)]
    df = frame(spark, pts, "chrom string, pos long, value double")
    got = sorted((r.pos, r.prev and r.prev.pos, r.next and r.next.value) for r in R.with_neighbours(df, tile=tile).collect())
    want = [(p, pts[i - 1][1] if i else None, pts[i + 1][2] if i + 1 < len(pts) else None) for i, (_, p, _) in enumerate(pts)]
    assert got == want
    assert [r.running for r in O.running_total(df, tile).orderBy("pos").collect()] == [sum(v for _, _, v in pts[: i + 1]) for i in range(len(pts))]


@pytest.mark.parametrize("tile", [16, 1 << 20])
def test_extrema_do_not_depend_on_tiles(spark, tile):
    r = random.Random(13)
    df = frame(spark, [(c, p, float(r.randrange(6))) for c, p in points(14, 300, 1500)], "chrom string, pos long, value double")
    assert sorted(map(tuple, O.local_extrema(df, 20, tile=tile).collect())) == sorted(map(tuple, O.local_extrema(df, 20, tile=333).collect()))


def greedy(rows, width, better):
    """(chrom, pos, value) in order: what one pass over all leaves."""
    out = []
    for c, p, v in sorted(rows):
        if out and out[-1][0] == c and p - out[-1][1] <= width:
            if better and v > out[-1][2]:
                out[-1] = (c, p, v)
        else:
            out.append((c, p, v))
    return out


@pytest.mark.parametrize("tile", [1, 60, 700, 1 << 20])
@pytest.mark.parametrize("width", [0, 7, 90])
def test_greedy_choices_over_tiles(spark, tile, width):
    r = random.Random(tile + width)
    rows = {(c, p): float(r.choice([r.randrange(5), -p, p])) for c in ("a", "b") for p in [*r.sample(range(-2000, 2000), 500), *range(5000, 5400, 3), 9000, 20_000]}
    rows |= {("c", p): float(p) for p in range(0, 3000, 2)} | {("d", p): float(-p) for p in range(0, 3000, 2)} | {("e", 5): 1.0}
    rows = [(*k, v) for k, v in rows.items()]
    df = frame(spark, rows, "chrom string, pos long, value double")
    for better in (None, "value"):
        got = G.choose(df, "pos", width, better, ["pos"], tile)
        assert sorted(map(tuple, got.collect())) == greedy(rows, width, better)
    assert G.choose(df.filter("false"), "pos", width, None, ["pos"], tile).collect() == []


def test_extrema_compete(spark):
    pts = [("c", p, v) for p, v in [(0, 0.0), (10, 5.0), (20, 1.0), (30, 7.0), (40, 2.0), (200, 3.0), (210, 3.0), (220, 1.0)]]
    df = frame(spark, pts, "chrom string, pos long, value double")
    assert sorted((r.pos, r.value) for r in O.local_extrema(df, 50).collect()) == [(30, 7.0), (210, 3.0)]
    assert sorted((r.pos, r.value) for r in O.local_extrema(df, 5, peaks=False).collect()) == [(20, 1.0), (40, 2.0)]


@pytest.mark.parametrize("around", [(20, 35), (0, 0), (300, 5), (5, 2000)])
def test_sliding_sum(spark, around):
    r = random.Random(9)
    before, after = around
    a = [(c, p, 1.0) for c, p in points(10, 100, 900)] * 2
    b = [(c, p, float(r.randrange(9))) for c, p in points(11, 100, 900)] + [("chr0", -5, None), ("chr0", 3, None)]
    kind = "chrom string, pos long, value double"
    got = O.sliding_sum(frame(spark, a, kind), frame(spark, b, kind), before, after)
    inside = [[v for d, q, v in b if c == d and p - before <= q <= p + after and v is not None] for c, p, _ in a]
    assert sorted((r.chrom, r.pos, r.total is None, r.total or 0.0) for r in got.collect()) == sorted((c, p, not v, sum(v)) for (c, p, _), v in zip(a, inside, strict=True))


def test_sliding_sums_keep_small_values(spark):
    kind = "chrom string, pos long, value double"
    b = frame(spark, [("c", 0, 1e16), ("c", 1000, 1.0), ("c", 2000, 1.0), ("c", 3000, 0.25), ("c", 4000, float("inf")), ("c", 5000, 3.0)], kind)
    got = {x.pos: x.total for x in O.sliding_sum(b, b, 50, 50).collect()}
    assert got == {0: 1e16, 1000: 1.0, 2000: 1.0, 3000: 0.25, 4000: float("inf"), 5000: 3.0}


def test_long_and_short_intervals_in_few_bins(spark):
    r = random.Random(15)
    far = 10**8
    long = [("c", s, s + far) for s in r.sample(range(far), 15)]
    a = [("c", s, s + r.randint(0, 50)) for s in r.sample(range(2 * far), 150)] + long[:8]
    b = [("c", s, s + 50) for s in [x[1] - 20 for x in a[:60]]] + long[8:] + [("c", s, s + 30_000) for s in r.sample(range(far), 20)]
    kind = "chrom string, start long, end long"
    x, y = frame(spark, a, kind), frame(spark, b, kind)
    got = sorted((p.start, p.end, p.b_start, p.b_end) for p in R.overlap_pairs(x, y, 128).collect())
    assert got == sorted((s, e, u, v) for _, s, e in a for _, u, v in b if u < e and s < v)
    # two lengths on either side: fewer than three rows an interval
    two = x, y.filter("end - start <> 30000")
    for side, dealt in zip(two, R.dealt_for_pairs(two[0], two[1].selectExpr("chrom AS b_chrom", "start AS b_start", "end AS b_end"), 128), strict=True):
        assert dealt.count() < 3 * side.count()
    pts = frame(spark, [("c", p) for p in r.sample(range(2 * far), 300)], "chrom string, pos long")
    inside = sorted((p.start, p.end, p.pos) for p in R.points_in(x, pts, 128).collect())
    assert inside == sorted((s, e, p.pos) for _, s, e in a for p in pts.collect() if s <= p.pos <= e)


def test_equal_intervals_count_each(spark):
    kind = "chrom string, start long, end long"
    a = frame(spark, [("c", 0, 10)] * 3 + [("c", 20, 30), ("c", 50, 60)], kind)
    b = frame(spark, [("c", 5, 25), ("c", 5, 25)], kind)
    assert sorted(x.start for x in R.overlapping(a, b, 8).collect()) == [0, 0, 0, 20]
    assert sorted((x.start, x.covered) for x in R.covered_bases(a, b.distinct(), 8).collect()) == [(0, 5)] * 3 + [(20, 5)]


def test_thin_out(spark):
    rows = [("c", s, s + 5, 1.0) for s in (0, 10, 90, 101, 150, 260)]
    got = O.thin_out(frame(spark, rows, "chrom string, start long, end long, score double"), 100)
    assert sorted(r.start for r in got.collect()) == [0, 101, 260]


def test_tags_in_regions(spark):
    peaks = [("chr1", 24, 56), ("chr1", 100, 200), ("chr2", 14, 46), ("chr2", 900, 950)]
    at = {"chr1": [("+", x) for x in (0, 10, 40, 80, 100)] + [("-", x) for x in (20, 30, 50, 90)], "chr2": [("+", x) for x in (0, 10, 40)] + [("-", x) for x in (20, 30)]}
    tags = [(c, s, x if s == "+" else x + 25) for c, v in at.items() for s, x in v]
    got = T.tags_in_regions(frame(spark, peaks, "chrom string, start long, end long"), frame(spark, tags, "chrom string, strand string, pos long"), 25)
    found = {(r.chrom, r.start): [(t.at, t.strand) for t in r.tags] for r in got.collect()}
    assert found == {
        ("chr1", 24): [(0, "+"), (10, "+"), (20, "-"), (30, "-"), (40, "+"), (50, "-")],
        ("chr1", 100): [(80, "+"), (90, "-"), (100, "+")],
        ("chr2", 14): [(0, "+"), (10, "+"), (20, "-"), (30, "-"), (40, "+")],
    }


def test_best_pairs_must_be_unique(spark):
    rows = [(1, "L", "c", 100, "+", 0), (1, "R", "c", 300, "-", 1), (1, "R", "c", 900, "-", 0), (2, "L", "c", 100, "+", 0), (2, "R", "c", 310, "-", 0), (2, "R", "c", 290, "-", 0)]
    got = T.best_pairs(frame(spark, rows, "pair long, side string, chrom string, pos long, strand string, errors long"), 200)
    assert [(r.pair, r.pos, r.score) for r in got.collect()] == [(1, 200, 1)]


def test_nth_values_and_histogram(spark):
    values = [float(x) for x in (5, 1, 1, 9, 7, 3, 3, 3, 100)]
    df = frame(spark, [(v,) for v in values] + [(None,)], "value double")
    r = A.nth_values(df, "value", F.lit(0), F.floor(F.col("n") / 2), F.col("n") - 1).first()
    assert (r.v0, r.v1, r.v2) == (1.0, 3.0, 100.0)
    assert [x.n for x in A.histogram(df, "value", 0, 10, 5).orderBy("bin").collect()] == [2, 3, 1, 1, 1]


def test_selection_by_rounds(spark):
    r = random.Random(17)
    values = [("a", r.gauss(0, 1)) for _ in range(301)] + [("b", float(r.randrange(3))) for _ in range(200)] + [("b", 1e300), ("c", -0.0), ("c", 0.0), ("c", -5e-324), (None, float("inf")), (None, -1.0), ("d", None), ("e", float("nan")), ("e", 2.0)]
    df = frame(spark, values, "g string, v double")
    got = {(x.g, x.i): x.value for x in N.nth_by_group(df, ["g"], "v", F.lit(0), F.col("n") - 1, F.floor(F.col("n") / 3), F.lit(10_000)).collect()}
    for g in ("a", "b", "c", None):
        own = sorted(v for k, v in values if k == g)
        assert [got[g, i] for i in range(3)] == [own[0], own[-1], own[len(own) // 3]]
    assert got["e", 0] == 2.0 and math.isnan(got["e", 1]) and not any(k[0] == "d" or k[1] == 3 for k in got)
    whole = frame(spark, [(x,) for x in (2**62 + 1, 2**62, -(2**62), 7)], "v long")
    assert [x.value for x in N.nth_by_group(whole, [], "v", F.lit(3), F.lit(2)).orderBy("i").collect()] == [2**62 + 1, 2**62]
    assert {x.g: x.median for x in N.medians(df.filter("g in ('a', 'c')"), ["g"], "v").collect()} == {"a": sorted(v for k, v in values if k == "a")[150], "c": 0.0}
    assert N.medians(df.filter("false"), ["g"], "v").collect() == []


def test_correlations_by_products(spark):
    r = random.Random(19)
    rows = [(t, c, p, 1e6 + r.gauss(0, 1)) for t in "abcd" for c in "xy" for p in range(80) if r.random() < 0.7] + [("e", "x", p, 3.0) for p in range(9)] + [("a", "x", 3, 5.0), ("b", "x", 3, float("nan")), ("f", "z", 1, 1.0)]
    df = frame(spark, rows, "track string, chrom string, pos long, value double")
    ok = [x for x in rows if x[3] == x[3]]
    for cells in (7, 1 << 20):
        got = {(x.a, x.b): (x.n, x.r) for x in A.correlation_matrix(df, cells=cells).collect()}
        for a, b in itertools.combinations("abcdef", 2):
            pairs = [(v, w) for t, c, p, v in ok if t == a for u, d, q, w in ok if u == b and (c, p) == (d, q)]
            if not pairs:
                assert (a, b) not in got
                continue
            x, y = np.array(pairs).T
            want = None if x.std() == 0 or y.std() == 0 else pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-7)
            assert got[a, b] == (len(pairs), want)


def test_any_function_reduces(spark):
    df = frame(spark, [("a", 3, 1.0), ("a", 1, 5.0), ("a", 2, None), ("b", 1, None)], "chrom string, pos long, value double")
    got = {x.chrom: x.y for x in df.groupBy("chrom").agg(A.reducer(lambda v: v[0] * 10 + len(v)).alias("y")).collect()}
    assert got == {"a": 52.0, "b": None}
    assert [x.value for x in B.bin_values(df.filter("chrom = 'a'"), 10, lambda v: v[-1]).collect()] == [1.0]


def test_tails_against_exact_sums():
    r = random.Random(21)
    for _ in range(300):
        n, p, k = r.choice([1, 2, 30, 200]), Fraction(r.randrange(101), 100), r.randrange(-1, 202)
        terms = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        assert D.binomial_tail_value(k, n, float(p), False) == pytest.approx(float(sum(terms[: max(k + 1, 0)])), rel=1e-11, abs=1e-300)
        assert D.binomial_tail_value(k, n, float(p), True) == pytest.approx(float(sum(terms[max(k + 1, 0) :])), rel=1e-11, abs=1e-15)
        good, bad = r.randrange(60), r.randrange(60)
        draws, k = r.randrange(good + bad + 1), r.randrange(-1, 60)
        want = Fraction(sum(math.comb(good, i) * math.comb(bad, draws - i) for i in range(max(k + 1, 0), draws + 1)), math.comb(good + bad, draws))
        assert D.hypergeometric_upper_value(k, good, bad, draws) == pytest.approx(float(want), rel=1e-11, abs=1e-15)
        lam, k = r.choice([0.01, 0.5, 20.0, 150.0]), r.randrange(300)
        want = math.fsum(math.exp(-lam + i * math.log(lam) - math.lgamma(i + 1)) for i in range(k + 1, k + 900))
        assert D.poisson_tail_value(k, lam, True) == pytest.approx(want, rel=1e-11, abs=1e-290)
    # large counts: the tails of both sides of the mean are those of the normal distribution to its next term
    assert D.poisson_tail_value(10**7, 1e7, True) == pytest.approx(0.5 - 2 / 3 / math.sqrt(2 * math.pi * 1e7) + 0.0, abs=1e-5)
    assert D.binomial_tail_value(5 * 10**6, 10**7, 0.5, True) == pytest.approx(0.5 - 0.5 / math.sqrt(2 * math.pi * 2.5e6), abs=1e-8)


def test_scores_add_the_whole_tail(spark, tmp_path):
    # expectations some 1000 above small values: the first 399 terms of the tail leave nearly all of it out
    n = 400
    events = [(i, 0, "a", 4.0 * i if i < n - 1 else 9000.0) for i in range(n)] + [(i, 1, "a", 20.0) for i in range(n)] + [(i, 1, "b", 780.0) for i in range(n)]
    rows = frame(spark, events, "s long, user_id long, event_type string, value double")
    rows.selectExpr("cast(timestamp_seconds(s) as timestamp_ntz) AS ts", "user_id", "event_type", "value").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.pos: r.score for r in plans.QUERIES["treatment_control_scores"](spark, str(tmp_path)).collect()}
    met = {r.pos: (int(r.value), r.expected) for r in plans.QUERIES["treatment_control_difference"](spark, str(tmp_path)).collect()}

    def score(k, e, terms):
        p = math.fsum(math.exp(-e + i * math.log(e) - math.lgamma(i + 1)) for i in range(k + 1, k + 1 + terms))
        return 2900.0 if p < 1e-290 else abs(-10 * math.log10(min(p, 1)))

    want = {at: score(k, e, 400 + int(e + 40 * math.sqrt(e))) for at, (k, e) in met.items()}
    cut = {at: score(k, e, 399) for at, (k, e) in met.items()}
    assert len(got) == n and got == pytest.approx(want, abs=2e-4)
    assert max(got.values()) == 2900 and sum(0 < x < 2900 for x in got.values()) > 100
    assert sum(cut[at] - got[at] > 10 for at in got) > 100


def test_top_keeps_ties(spark):
    df = frame(spark, [(i, float(s)) for i, s in enumerate((5, 3, 3, 1, 9))], "id long, score double")
    assert sorted(r.id for r in L.top_by_score(df, 3).collect()) == [0, 1, 2, 4]


def test_random_regions_lie_inside(spark):
    got = B.random_regions(spark, frame(spark, [("a", 100), ("b", 900)], "chrom string, length long"), 50, 10).collect()
    assert len(got) == 50 and all(0 <= r.start < r.end <= {"a": 100, "b": 900}[r.chrom] for r in got)


def test_normal(spark):
    xs = [-40.0, -8.0, -7.0, -1.5, 0.0, 0.3, 2.0, 7.5]
    got = frame(spark, [(x,) for x in xs], "x double").select(D.normal_cdf(F.col("x")).alias("p")).collect()
    for x, r in zip(xs, got, strict=True):
        assert r.p == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-7, abs=1e-300)
    ps = [1e-9, 0.01, 0.3, 0.5, 0.99]
    got = frame(spark, [(p,) for p in ps], "p double").select(D.normal_cdf(D.normal_quantile(F.col("p"))).alias("q")).collect()
    assert [r.q for r in got] == pytest.approx(ps, rel=1e-6)


def test_count_tails():
    assert D.poisson_tail_value(3, 2.0, False) == pytest.approx(0.857123, abs=1e-6)
    assert D.poisson_tail_value(1000, 900.0, True) + D.poisson_tail_value(1000, 900.0, False) == pytest.approx(1)
    assert D.binomial_tail_value(5, 5, 0.3, False) == pytest.approx(1) and D.binomial_tail_value(5, 5, 0.3, True) == 0
    assert D.binomial_tail_value(1, 4, 0.5, False) == pytest.approx(5 / 16)
    assert D.hypergeometric_upper_value(0, 2, 2, 2) == pytest.approx(5 / 6)


def test_bwt(spark):
    df = frame(spark, [("test is terrible!",), ("banana",), ("",)], "t string")
    got = df.select(S.bwt(F.col("t")).alias("b"), S.ibwt(S.bwt(F.col("t"))).alias("back")).collect()
    assert got[0].b == "!tseilttr breies \0"
    assert [r.back for r in got] == ["test is terrible!", "banana", ""]


def test_gene_neighbours_both_ways(spark, monkeypatch):
    from trackweave.operators import annotate as N

    r = random.Random(12)
    rows = [(r.choice("ab"), f"g{i}", "+", s, s + r.choice((5, 40, 3000))) for i, s in enumerate(r.randrange(5000) for _ in range(120))]
    g = spark.createDataFrame(rows, "chrom string, name string, strand string, txStart long, txEnd long")
    want = set()
    for c in "ab":
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[3], x[4], x[1]))
        for i, x in enumerate(own):
            before = [y[4] for y in own[:i] if y[4] < x[3]]
            after = [y[3] for y in own if y[3] > x[4]]
            want.add((c, x[1], i + 1, before[-1] if before else 0, after[0] if after else max(y[4] for y in own) + 1_000_000))
    for few in (N.FEW, 0):
        monkeypatch.setattr(N, "FEW", few)
        assert {(x.chrom, x.name, x.nth, x.before, x.after) for x in N.neighbours(g).collect()} == want


@pytest.mark.parametrize("tile", [7, 50, 1000])
def test_merging_carries_only_tile_edges(spark, tile):
    r = random.Random(tile)
    rows = [("a", s, s + r.choice((1, 3, 9, 200 if r.random() < 0.1 else 2))) for s in (r.randrange(900) for _ in range(80))]
    for gap in (0, 4):
        want = []
        for _, s, e in sorted(rows):
            if want and s <= want[-1][1] + gap:
                want[-1] = (want[-1][0], max(want[-1][1], e), want[-1][2] + 1)
            else:
                want.append((s, e, 1))
        df = spark.createDataFrame(rows, "chrom string, start long, end long").withColumn("n", F.lit(1).cast("long"))
        sums = [F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")]
        assert sorted((x.start, x.end, x.n) for x in R.merged(df, sums, gap, tile).collect()) == want


def test_numbering_and_filling_across_blocks(spark):
    from trackweave.operators.windows import fill_forward, numbered

    rows = [("ab"[i % 2], 3 * i, float(i) if i % 5 == 2 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "chrom string, pos long, value double")
    got = {(x.chrom, x.pos): x.nth for x in numbered(df, ["chrom"], R.bin_of(F.col("pos"), 20), "pos").collect()}
    assert got == {(c, p): i // 2 for i, (c, p, _) in enumerate(rows)}
    last, want = {}, set()
    for c, p, v in rows:
        last[c] = v if v is not None else last.get(c)
        want.add((c, p, last[c]))
    assert {tuple(x) for x in fill_forward(df, 20).collect()} == want


def test_labels_round_as_sql_does(spark):
    import duckdb

    from trackweave.functions import strings as S

    values = [0.1225, 0.1235, 0.00085, 0.0125, 0.00045, 0.6250000000000001, 1.0000005, None]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", S.percent_label(F.col("x")).alias("p"), S.scientific(F.col("x")).alias("s"), S.p_value_label(F.col("x")).alias("v"))
    sql = """SELECT x, CASE WHEN x * 100 < 0.1 THEN printf('%.2f %%', x * 100) ELSE printf('%.1f %%', x * 100) END, printf('%.5e', x),
    CASE WHEN x < 0.001 THEN printf('(%.1e)', x) ELSE printf('(%.3f)', x) END FROM (SELECT unnest($v::DOUBLE[]) AS x)"""
    want = duckdb.execute(sql, {"v": values}).fetchall()
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)


def test_partitions_of_region_values_are_given(spark):
    from trackweave.operators import profiles as P

    rows = [("a", 10 * i, 10 * i + 15) for i in range(40)]
    regions, track = spark.createDataFrame(rows, "chrom string, start long, end long"), spark.createDataFrame([("a", 7 * i, float(i % 5)) for i in range(50)], "chrom string, pos long, value double")
    found = P.region_values(regions, track, F.max("value"), ["chrom", "start", "end"], parts=7)
    want = [(c, a, b, max((float(i % 5) for i in range(50) if a <= 7 * i < b), default=None)) for c, a, b in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chrom" in plan and ", 7)" in plan and "BroadcastExchange" not in plan
