"""Work is dealt to tasks by the size of the table, and no task gets a file, a batch or a group of ranges whole."""

import re
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from trackweave import plans
from trackweave.functions import strings as S
from trackweave.operators import aggregates as A
from trackweave.plans import views as V
from trackweave.sources import motifs as M
from trackweave.sources import text as X

# per query: keys of the exchanges that keep the session's number of partitions, as few rows pass them
SPREAD = {
    "binary_scan_files": set(),
    "eland_pair_files": {"file, block"},
    "trimmed_means": set(),
    "saved_interval_join": set(),
    "covered_bases": {"chrom"},
    "motif_enrichment": {"motif"},
    "tag_wiggle_files": {"file", "file, block"},
    "probes_in_peaks": {"chrom"},
    "roi_flags": set(),
}


@pytest.mark.parametrize("name", SPREAD)
def test_exchanges_follow_the_table(spark, monkeypatch, name):
    monkeypatch.setattr(V, "ROWS", 100)
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert ", 60), REPARTITION_BY_NUM" in plan
    kept = re.findall(r"(?:hash|range)partitioning\(([^()]*), 4\)", plan)
    assert {re.sub(r" ASC NULLS FIRST|#\d+L?", "", k) for k in kept} <= SPREAD[name]


def test_ranges_of_a_scan_are_many_tasks(spark, tmp_path):
    hits = spark.range(4000).selectExpr("'c' AS chrom", "'+' AS strand", "id AS pos", "1.0 AS score")
    out = str(tmp_path / "scan")
    M.write_scan(hits, out, ["c"])
    back = M.read_scan(spark, out, ["c"], 0.0, 4096)
    assert back.count() == 4000 and back.select(F.spark_partition_id()).distinct().count() > 1


def test_pairs_of_lines_of_folders_cut_unlike(spark, tmp_path):
    lines = {s: [f"r{i}\tACGT\t1:0:0\tc{s}.fa:{i}F0" for i in range(40)] for s in "LR"}
    for side, cut in (("L", 7), ("R", 16)):
        (tmp_path / side).mkdir()
        for k, at in enumerate(range(0, 40, cut)):
            (tmp_path / side / f"part-{k:05d}.txt").write_text("\n".join(lines[side][at : at + cut]) + "\n")
    got = X.read_eland_pairs(spark, str(tmp_path / "L"), str(tmp_path / "R"))
    assert sorted((r.pair, r.side, r.chrom, r.pos) for r in got.collect()) == sorted((i, s, f"c{s}", i) for i in range(40) for s in "LR")


def test_own_function_beside_other_aggregates(spark):
    rows = [("a", 3, 5.0), ("a", 1, 7.0), ("a", 2, None), ("a", 4, float("nan")), ("b", 1, None)]
    df = spark.createDataFrame(rows, "chrom string, pos long, value double")
    first = A.reducer(lambda v: v[0] * 100 + v[-1] * 10 + len(v))
    assert sorted(map(tuple, df.groupBy("chrom").agg(first.alias("x"), F.count(F.lit(1)).alias("n")).collect())) == [("a", 752.0, 4), ("b", None, 1)]


def test_texts_of_a_batch_are_strings_one_by_one():
    texts = pa.array([f"{i % 10}" * 20_000 for i in range(400)] + [None, ""])
    tracemalloc.start()
    got = S._one_by_one(str.upper).func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.equals(texts) and peak < 6_000_000
    for t in ("", "a", "banana", "test is terrible!", "\u00e4\u20ac\U0001f600 x" * 9):
        assert S.first_text(S.last_column(t)) == t


# per profile of genes: keys of the exchanges that keep the session's number of partitions: bins of the profile itself
PROFILES = {
    "meta_gene_profile": {"bin"},
    "meta_gene_profile_of_namesakes": {"bin"},
    "intron_profile": {"bin"},
    "weighted_profile_merge": {"bin", "chrom, bin"},
    "profile_by_gene_group": {"grp, bin"},
}


@pytest.mark.parametrize("name", PROFILES)
def test_genes_follow_the_table(spark, monkeypatch, name):
    """Genes are told apart and meet the track and their groups in as many partitions as the table gives; none is broadcast."""
    monkeypatch.setattr(V, "ROWS", 100)
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "collect_list" not in plan
    kept = re.findall(r"(?:hash|range)partitioning\(([^()]*), 4\)", plan)
    assert {re.sub(r" ASC NULLS FIRST|#\d+L?", "", k) for k in kept} == PROFILES[name]
