"""Annotation of coordinates (chrom, pos) with genes: promoter, downstream and gene-body classes, summaries, enrichment.

Genes: chrom, name, strand, txStart, txEnd, cdsStart, cdsEnd, exonStarts, exonEnds.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import ordinate
from ..functions.probability import binomial_cdf, binomial_upper
from .profiles import GENE, told_apart
from .ranges import nearest, overlap_pairs, points_in

BIN = 1 << 14
FEW = 200_000
LEVELS = {"promoter": 3, "bipromoter": 2, "downstream": 3}


def gene_order(genes: DataFrame) -> DataFrame:
    return genes.withColumn("nth", F.row_number().over(W.partitionBy("chrom").orderBy("txStart", "txEnd", "name")))


def _neighbours_of_few(genes: DataFrame) -> DataFrame:
    """``neighbours`` for at most FEW genes, so that a chromosome's fit one task."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("txStart", "txEnd", "name")])
        start, end = (t.column(c).to_numpy() for c in ("txStart", "txEnd"))
        follows = np.searchsorted(start, end, side="right")
        after = np.where(follows < len(start), start[np.minimum(follows, len(start) - 1)], end.max() + 1_000_000)
        before = np.arange(len(start)) - 1
        while (open_ := (before >= 0) & (end[before] >= start)).any():
            before[open_] -= 1
        extra = (np.arange(1, len(start) + 1, dtype=np.int32), np.where(before >= 0, end[before], 0), after)
        for name, values in zip(("nth", "before", "after"), extra, strict=True):
            t = t.append_column(name, pa.array(values))
        return t

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in genes.schema)
    return genes.groupBy("chrom").applyInArrow(run, f"{fields}, nth int, before long, after long")


def neighbours(genes: DataFrame) -> DataFrame:
    """Genes with nth, ``before`` (end of the closest earlier gene, by order of starts, that ends before this one starts; 0 if none) and ``after``
    (start of the first later gene that starts after this one ends; else a million beyond the last end).

    Up to FEW genes are read in order, chromosome by chromosome. Beyond, the earlier gene starts at most one longest gene before, or it is the last of
    all that start before that, so a bounded range join and an as-of join find it.
    """
    if genes.limit(FEW + 1).count() <= FEW:
        return _neighbours_of_few(genes)
    ordered = gene_order(genes)
    ends = ordered.groupBy("chrom").agg(F.max(F.col("txEnd") - F.col("txStart")).alias("longest"), F.max("txEnd").alias("last_end"))
    g = ordered.join(ends, "chrom")
    key = ["chrom", "nth"]
    spans = g.select("chrom", "nth", (F.col("txStart") - F.col("longest")).alias("start"), F.col("txStart").alias("end"))
    starts = ordered.select("chrom", F.col("txStart").alias("pos"), F.col("txEnd").alias("o_end"), F.col("nth").alias("o_nth"))
    close = points_in(spans, starts, BIN, levels=False).filter((F.col("o_end") < F.col("end")) & (F.col("o_nth") < F.col("nth"))).groupBy(*key).agg(F.max_by("o_end", "o_nth").alias("close"))
    far_points = g.select("chrom", (F.col("txStart") - F.col("longest") - 1).alias("pos"), "nth")
    far = nearest(far_points, ordered.select("chrom", F.col("txStart").alias("pos")).distinct()).select("chrom", "nth", F.col("before").alias("far_start"))
    last_at = ordered.groupBy("chrom", F.col("txStart").alias("far_start")).agg(F.max_by("txEnd", "nth").alias("far_end"))
    far = far.join(last_at, ["chrom", "far_start"])
    after = nearest(g.select("chrom", F.col("txEnd").alias("pos"), "nth"), ordered.select("chrom", F.col("txStart").alias("pos")).distinct()).select("chrom", "nth", F.col("after").alias("next_start"))
    out = g.join(close, key, "left").join(far.select("chrom", "nth", "far_end"), key, "left").join(after, key, "left")
    return out.select(*ordered.columns, F.coalesce("close", "far_end", F.lit(0)).alias("before"), F.coalesce(F.col("next_start"), F.col("last_end") + 1_000_000).alias("after"))


def _share(offset: Column, length: Column, parts: int) -> Column:
    return F.least(F.floor(offset / F.nullif(F.round(length / parts), F.lit(0.0))) + 1, F.lit(parts)).cast("long")


def classify(pairs: DataFrame, prom: int, down: int) -> DataFrame:
    """Pairs of coordinate and gene with the signed promoter distance, the downstream distance, the gene code and relative locations."""
    c, plus = F.col("pos"), F.col("strand") == "+"
    upstream = F.when(plus & (c < F.col("txStart")) & (c >= F.col("txStart") - prom), F.col("txStart") - c).when(~plus & (c >= F.col("txEnd")) & (c < F.col("txEnd") + prom), F.col("txEnd") - c)
    beyond = F.when(plus & (c >= F.col("txEnd")) & (c < F.col("txEnd") + down), c - F.col("txEnd")).when(~plus & (c < F.col("txStart")) & (c >= F.col("txStart") - down), F.col("txStart") - c)
    inside = (c >= F.col("txStart")) & (c < F.col("txEnd"))
    hits = F.filter(F.sequence(F.lit(0), F.size("exonStarts") - 1), lambda i: (c >= F.get("exonStarts", i)) & (c < F.get("exonEnds", i)))
    exon = F.get(hits, F.size(hits) - 1)
    left, right = (c < F.col("cdsStart")), (c >= F.col("cdsEnd"))
    code = F.when(exon.isNull(), 4).when(~left & ~right, 3).when(F.when(plus, left).otherwise(right), 1).otherwise(2)
    lengths = F.zip_with("exonEnds", "exonStarts", lambda e, s: e - s)

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)

    whole = F.col("txEnd") - F.col("txStart") + 1
    offset = F.when(plus, c - F.col("txStart") + 1).otherwise(F.col("txEnd") - c + 1)
    in_cds = F.when(plus, c - F.get("exonStarts", exon) + total(F.slice(lengths, 1, exon))).otherwise(
        F.get("exonEnds", exon) - c + total(F.slice(lengths, exon + 2, F.greatest(F.size(lengths) - exon - 1, F.lit(0))))
    )
    out = pairs.withColumns({"upstream": upstream, "beyond": beyond, "code": F.when(inside, code)})
    coding = F.col("code") == 3
    return out.withColumns(
        {
            **{f"rel{k}": F.when(inside, _share(offset, whole, k)) for k in (3, 5)},
            **{f"cds{k}": F.when(coding, _share(in_cds, total(lengths), k)) for k in (3, 5)},
        }
    )


def annotate(coords: DataFrame, genes: DataFrame, prom: int = 3000, biprom: int = 5000, down: int = 3000, rois: DataFrame | None = None) -> DataFrame:
    """One row per distinct coordinate: promoter, bipromoter, downstream (distances; 0: none), gene (code; 0: none), rel3, rel5, cds3, cds5, roi.

    Each gene is searched in a window that its neighbours bound. Of several genes the nearest promoters of both directions, the nearest downstream
    edge and the smallest code count; relative locations come from the last gene. A distance of 0 is none.
    """
    points = coords.select("chrom", "pos").distinct()
    plus = F.col("strand") == "+"
    low = F.greatest(F.col("txStart") - F.when(plus, prom).otherwise(down), F.col("before"))
    high = F.least(F.col("txEnd") + F.when(plus, down).otherwise(prom), F.col("after"))
    windows = neighbours(genes).withColumns({"start": low, "end": high}).filter("end >= start")
    # a window is no longer than its gene and two flanks, and dear to make twice
    pairs = classify(points_in(windows, points, BIN, levels=False), prom, down)
    up = F.col("upstream")
    reduced = pairs.groupBy("chrom", "pos").agg(
        F.max(F.when(up < 0, up)).alias("m"),
        F.min(F.when(up > 0, up)).alias("p"),
        F.min(F.when(F.col("beyond") > 0, F.col("beyond"))).alias("downstream"),
        F.min("code").alias("gene"),
        *[F.max_by(k, F.when(F.col(k).isNotNull(), F.col("nth"))).alias(k) for k in ("rel3", "rel5", "cds3", "cds5")],
    )
    both = F.abs("m") + F.col("p")
    reduced = reduced.withColumns({"promoter": F.least(F.abs("m"), F.col("p")), "bipromoter": F.when(both <= biprom, both)})
    columns = ["promoter", "bipromoter", "downstream", "gene", "rel3", "rel5", "cds3", "cds5"]
    out = points.join(reduced, ["chrom", "pos"], "left").select("chrom", "pos", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in columns])
    if rois is None:
        return out.withColumn("roi", F.lit(0).cast("long"))
    hit = points_in(rois.select("chrom", "start", "end"), points, BIN).select("chrom", "pos").distinct().withColumn("roi", F.lit(1).cast("long"))
    return out.join(hit, ["chrom", "pos"], "left").withColumn("roi", F.coalesce("roi", F.lit(0)))


def summarise(annotated: DataFrame, prom: int = 3000, biprom: int = 5000, down: int = 3000) -> DataFrame:
    """Per chromosome and ``whole``: n and cumulative counts promoter1..3, bipromoter1..2, downstream1..3, counts gene1..4 and their total gene5, roi."""
    largest = {"promoter": prom, "bipromoter": biprom, "downstream": down}
    sums = [F.count(F.lit(1)).alias("n")]
    for name, levels in LEVELS.items():
        level = ordinate(F.col(name), levels, largest[name])
        sums += [F.sum(F.when((level > 0) & (level <= i), 1).otherwise(0)).alias(f"{name}{i}") for i in range(1, levels + 1)]
    sums += [F.sum((F.col("gene") == i).cast("long")).alias(f"gene{i}") for i in range(1, 5)] + [F.sum((F.col("gene") > 0).cast("long")).alias("gene5"), F.sum("roi").alias("roi")]
    for k in (3, 5):
        for name in ("rel", "cds"):
            sums += [F.sum((F.col(f"{name}{k}") == i).cast("long")).alias(f"{name}{k}_{i}") for i in range(1, k + 1)]
    return annotated.rollup("chrom").agg(*sums).withColumn("chrom", F.coalesce("chrom", F.lit("whole")))


def shares(summary: DataFrame) -> DataFrame:
    """Counts divided by n (1 where n is 0)."""
    counts = [c for c in summary.columns if c not in ("chrom", "n")]
    return summary.select("chrom", *[(F.col(c) / F.when(F.col("n") == 0, 1).otherwise(F.col("n"))).alias(c) for c in counts])


def site_distribution(annotated: DataFrame, prom: int = 3000, down: int = 3000) -> DataFrame:
    """Each coordinate in one class, by rank promoter1 > downstream1 > promoter2 > ... > gene > enhancer: chrom, site, n."""
    p, d = ordinate(F.col("promoter"), 3, prom), ordinate(F.col("downstream"), 3, down)
    site = F.when(p == 1, "promoter1").when(d == 1, "downstream1").when(p == 2, "promoter2").when(d == 2, "downstream2").when(p == 3, "promoter3").when(d == 3, "downstream3")
    site = site.when(F.col("gene") > 0, F.concat(F.lit("gene"), F.col("gene").cast("string"))).otherwise("enhancer")
    return annotated.groupBy("chrom", site.alias("site")).agg(F.count(F.lit(1)).alias("n"))


def cumulative_distances(annotated: DataFrame, column: str, edges: list[int]) -> DataFrame:
    """Per chromosome and upper edge: coordinates with a distance from 1 to below the edge."""
    steps = annotated.filter(F.col(column) > 0).groupBy("chrom").agg(*[F.sum((F.col(column) < e).cast("long")).alias(str(e)) for e in edges])
    pairs = F.explode(F.array(*[F.struct(F.lit(e).cast("long").alias("edge"), F.col(str(e)).alias("n")) for e in edges])).alias("x")
    return steps.select("chrom", pairs).select("chrom", "x.edge", "x.n")


def enrichment(observed: DataFrame, background: DataFrame, columns: list[str]) -> DataFrame:
    """Binomial tail of each count given the background share: chrom, name, n, k, share, p_background, p.

    The lower tail where the background share is at least the observed one, else the strict upper tail; 0 becomes 4.92e-324.
    """
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("k")) for c in columns])).alias("x")
    k = observed.select("chrom", "n", long).select("chrom", "n", "x.name", "x.k")
    b = background.select("chrom", long).select("chrom", "x.name", F.col("x.k").alias("p_background"))
    both = k.join(b, ["chrom", "name"]).withColumn("share", F.col("k") / F.greatest("n", F.lit(1)))
    p = F.when(F.col("p_background") >= F.col("share"), binomial_cdf(F.col("k"), F.col("n"), F.col("p_background"))).otherwise(binomial_upper(F.col("k"), F.col("n"), F.col("p_background")))
    return both.withColumn("p", p).withColumn("p", F.when(F.col("p") <= 0, 4.92e-324).otherwise(F.col("p")))


def nearest_sites(genes: DataFrame, peaks: DataFrame) -> DataFrame:
    """Per row of genes (GENE) the distance from start and end of transcription to the closest peak centre up- and downstream; missing if there is none."""
    centres = peaks.select("chrom", F.floor((F.col("start") + F.col("end")) / 2).cast("long").alias("pos")).distinct()
    plus, rows = F.col("strand") == "+", told_apart(genes)

    def around(pos: Column, name: str) -> DataFrame:
        got = nearest(rows.select(*GENE, pos.alias("pos")), centres)
        left, right = F.col("pos") - F.col("before"), F.col("after") - F.col("pos")
        return got.select(*GENE, F.when(plus, left).otherwise(right).alias(f"{name}_up"), F.when(plus, right).otherwise(left).alias(f"{name}_down"))

    first = around(F.when(plus, F.col("txStart")).otherwise(F.col("txEnd")), "start")
    last = around(F.when(plus, F.col("txEnd")).otherwise(F.col("txStart")), "end")
    return first.join(last, GENE)


def section_coverage(genes: DataFrame, peaks: DataFrame, upstream: int = 3000, downstream: int = 3000) -> DataFrame:
    """Share of each gene section that peaks cover, gene by gene: GENE, section, share. Sections: body1..3 in reading order, start (around it), end (after it)."""
    plus, s, e = F.col("strand") == "+", F.col("txStart"), F.col("txEnd")
    third = F.floor((e - s) / 3)
    cuts = [s, s + third, s + 2 * third, e]

    def part(name: Column, lo: Column, hi: Column) -> Column:
        return F.struct(name.alias("section"), F.greatest(lo, F.lit(0)).cast("long").alias("start"), hi.cast("long").alias("end"))

    sections = [part(F.when(plus, f"body{i + 1}").otherwise(f"body{3 - i}"), cuts[i], cuts[i + 1]) for i in range(3)]
    tss = F.when(plus, s).otherwise(e)
    sections += [part(F.lit("start"), tss - upstream, tss + upstream), part(F.lit("end"), F.when(plus, e).otherwise(s - downstream), F.when(plus, e + downstream).otherwise(s))]
    rows = told_apart(genes).select(*GENE, F.explode(F.array(*sections)).alias("x")).select(*GENE, "x.*").filter("end > start")
    shared = F.least("end", "b_end") - F.greatest("start", "b_start")
    hit = overlap_pairs(rows, peaks.select("chrom", "start", "end"), BIN, levels=False).groupBy(*GENE, "section").agg(F.sum(shared).alias("covered"))
    return rows.join(hit, [*GENE, "section"], "left").select(*GENE, "section", (F.coalesce("covered", F.lit(0)) / (F.col("end") - F.col("start"))).alias("share"))


def interpolated_background(background: DataFrame, at: int) -> DataFrame:
    """Background shares (chrom, distance, share) at a distance between two tabled ones, on the line that joins them."""
    lower = background.filter(F.col("distance") <= at).groupBy("chrom").agg(F.max("distance").alias("x0"), F.max_by("share", "distance").alias("y0"))
    upper = background.filter(F.col("distance") >= at).groupBy("chrom").agg(F.min("distance").alias("x1"), F.min_by("share", "distance").alias("y1"))
    line = F.when(F.col("x1") == F.col("x0"), F.col("y0")).otherwise(F.col("y0") + (at - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
    return lower.join(upper, "chrom").select("chrom", F.lit(at).cast("long").alias("distance"), line.alias("share"))
