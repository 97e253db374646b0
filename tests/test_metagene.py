"""Fitted profiles against plain Python that bins twice, as the definition says."""

import random

import pytest
from pyspark.sql import functions as F

from trackweave.operators import metagene as G
from trackweave.operators import profiles as P


def binned(points, start, end, n, strand):
    cells = [[] for _ in range(n)]
    for pos, value in sorted(points):
        if start <= pos < end:
            cells[(pos - start) * n // (end - start)].append(value)
    values = [c[len(c) // 2] if c else 0.0 for c in cells]
    return values if strand == "+" else values[::-1]


def fit(values, length, n, step, m, first):
    """Bins of a region of ``length`` cut into n, of which ``values`` are left, fitted to m."""
    k = len(values)
    if k == m:
        return values
    cells = [[] for _ in range(m)]
    for i, v in enumerate(values):
        cells[min((i * length + step // 2 * n) * m // (k * length), m - 1)].append(v)
    out, prior = [], first
    for c in cells:
        prior = c[len(c) // 2] if c else (prior if k < m else 0.0)
        out.append(prior)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(5)
    genes, points = [], {}
    for g in range(40):
        start = 10_000 * g + rnd.randrange(500)
        edges = sorted(rnd.sample(range(start, start + rnd.choice([90, 700, 4000])), 2 * rnd.randint(1, 4)))
        genes.append(("c", f"g{g}", rnd.choice("+-"), edges[0], edges[-1], edges[::2], edges[1::2]))
        if g % 7:
            points.update({rnd.randrange(start - 300, start + 4300): float(rnd.randrange(1, 99)) for _ in range(150)})
    table = spark.createDataFrame(genes, "chrom string, name string, strand string, txStart long, txEnd long, exonStarts array<long>, exonEnds array<long>")
    track = spark.createDataFrame([("c", p, v) for p, v in points.items()], "chrom string, pos long, value double")
    return genes, sorted(points.items()), table, track


def as_dict(df, *keys):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r["bin"]] = r["value"]
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


def values_of(df, *keys):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[k] for k in keys), {})[r["bin"]] = r["value"]
    return out


@pytest.mark.parametrize("size", [200, 1000, 5000])
def test_genes(data, size):
    genes, points, table, track = data
    want = {}
    for _, name, strand, a, b, _, _ in genes:
        start, end = a - 75, b + 75
        n = (end - start) // 50
        if n > 2 and any(start <= p < end for p, _ in points):
            v = binned(points, start, end, n, strand)
            want[(name,)] = fit(v[1:-1], end - start, n, 50, (size + 50) // 50, v[0])
    assert want and as_dict(G.gene_bins(table, track, size), "name") == want


def test_genes_of_one_name_stay_apart(data):
    genes, _, table, track = data
    start = {name: a for _, name, _, a, _, _, _ in genes}
    alike = table.withColumn("name", F.lit("g"))
    for make in (lambda t: G.gene_bins(t, track, 1000), lambda t: G.joined_bins(t, track, 500), lambda t: P.anchor_bins(t, track, 500)):
        by_name = {start[k[0]]: v for k, v in values_of(make(table), "name").items()}
        assert by_name and {k[0]: v for k, v in values_of(make(alike), "txStart").items()} == by_name
        twice = values_of(make(alike.unionByName(alike)), "txStart", "copy")
        assert {k[0]: v for k, v in twice.items() if k[1] == 1} == by_name == {k[0]: v for k, v in twice.items() if k[1] == 0}


@pytest.mark.parametrize("introns", [False, True])
def test_joined_parts(data, introns):
    genes, points, table, track = data
    want = {}
    for _, name, strand, _, _, starts, ends in genes:
        spans = list(zip(ends[:-1], starts[1:], strict=True)) if introns else list(zip(starts, ends, strict=True))
        spans = [(s - 25, e + 25) for s, e in spans]
        gap, moved, last = 0, [], None
        for i, (s, e) in enumerate(spans):
            gap += s - spans[i - 1][1] if i else 0
            mine = [(p - gap, v) for p, v in points if s <= p < e]
            d = max(10 - (mine[0][0] - last), 0) if mine and last is not None else 0
            moved += [(p + d, v) for p, v in mine]
            last = moved[-1][0] if moved else None
        if moved:
            start, end = spans[0][0], spans[-1][1] - gap
            n = (end - start) // 50
            if n > 0 and any(start <= p < end for p, _ in moved):
                v = binned(moved, start, end, n, strand)
                want[(name,)] = fit(v, end - start, n, 50, 11, v[0])
    assert want and as_dict(G.joined_bins(table, track, 500, introns=introns), "name") == want


def test_exons_by_class(data):
    genes, points, table, track = data
    classes, want = [(0, 200, 100), (150, 900, 600)], {}
    for _, name, strand, _, _, starts, ends in genes:
        for part, (s, e) in enumerate(zip(starts, ends, strict=True)):
            kind = next((i for i, (low, up, _) in enumerate(classes) if low <= e - s < up), None)
            start, end = s - 25, e + 25
            n = (end - start) // 50
            if kind is not None and n > 0 and any(start <= p < end for p, _ in points):
                v = binned(points, start, end, n, strand)
                want[(name, part, kind)] = fit(v, end - start, n, 50, (classes[kind][2] + 50) // 50, v[0])
    assert want and as_dict(G.part_bins(table, track, classes), "name", "part", "class") == want


def test_sides_and_breaks(data, spark):
    _, _, table, track = data
    sided = G.gene_with_sides(table, track, 500, 400, 200)
    bins = {r[0] for r in sided.select("bin").distinct().collect()}
    assert bins == set(range(4 + 11 + 4))
    assert G.gene_with_sides(table.limit(0), track, 500).count() == 0
    assert G.breaks(-100, 100, 50) == [-100, -50, 0, 50, 100]
    assert G.breaks(0, 200, 50, percent=True) == [0.0, 25.0, 50.0, 75.0, 100.0]


def test_gene_spans_are_never_broadcast(spark):
    """A file of few columns says little about the rows made from it: the join with the track is a merge join of partitions that follow the table."""
    from tests.conftest import SF
    from trackweave.plans import QUERIES
    from trackweave.plans import views as V

    for name in ("meta_gene_profile_of_namesakes", "spaced_exon_profile", "spaced_intron_profile"):
        assert "BroadcastExchange" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    rows = V.ROWS
    V.ROWS = 100
    try:
        assert V.parts(spark, SF) == -(-V.table(spark, SF, "lineitem").count() // 100)
    finally:
        V.ROWS = rows


def test_average_without_a_row_per_gene_and_bin(data, spark):
    """Bins without a value count as 0, parts without points do not count, as in the rows of genes."""
    _, _, table, track = data
    for size, reach, wing in ((500, 400, 200), (1500, 2000, 1000), (100, 200, 200)):
        want = P.average_profile(G.gene_with_sides(table, track, size, reach, wing)).collect()
        got = G.average_with_sides(table, track, size, reach, wing).collect()
        assert sorted((r.bin, r.n, round(r.value, 9)) for r in got) == sorted((r.bin, r.n, round(r.value, 9)) for r in want)
        assert got and any(r.value for r in got)
    assert G.average_with_sides(table.limit(0), track, 500).count() == 0
    plan = G.average_with_sides(table, track, 500, 400, 200)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate(" in line and "txStart" in line]
