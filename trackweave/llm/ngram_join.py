"""N-gram Jaccard join with Bayesian candidate pruning."""

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .exact_dedup import row_key
from .storage import materialise, whole_row
from .words import SHINGLE, U64, batch_words, mix, shingle_sets

THRESHOLD = 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-5
BLOCK = 512
BLOCK_SHINGLES = 1 << 19
MOST_PAIRS = 1 << 16

_A, _B = np.random.Generator(np.random.Philox(key=[2718, 28])).integers(0, 2**64, size=(2, HASHES), dtype=U64)
_A |= U64(1)


def signatures(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 32 bits of each set of a ragged array; sets must not be empty."""
    out = np.empty((len(begin) - 1, HASHES), dtype=np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat(values * _A[i] + _B[i], begin[:-1]) >> U64(32)
    return out


def set_keys(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """128-bit keys of sets (as two columns): sums of two mixes of their members."""
    out = np.empty((len(begin) - 1, 2), dtype=U64)
    for i, salt in enumerate((U64(0x51ED270B7B4A3C19), U64(0xB492B66FBE98F273))):
        out[:, i] = np.add.reduceat(mix(values ^ salt), begin[:-1])
    return out


def least_matches(threshold: float, tolerance: float, hashes: int = HASHES, step: int = STEP) -> list[int]:
    """After each ``step`` hashes, the fewest matches with which a pair stays.

    With a uniform prior, m matches of n give the similarity the posterior Beta(m+1, n-m+1); the probability that it reaches
    t is that of at most m successes in n+1 trials of chance t. A pair is dropped when this falls below the tolerance.
    """
    out = []
    for n in range(step, hashes + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray, needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that keep a fair chance while their hashes are compared STEP by STEP."""
    matches = np.zeros(len(i), dtype=np.int32)
    for k, least in enumerate(needed):
        part = sig[:, k * STEP : (k + 1) * STEP]
        matches += (part[i] == part[j]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def local_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest number in each one's connected component, of n numbers and the links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label[i] == label[j]).all():
            return label
    return label


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows with equal first ``keys`` (long) columns, and where the groups begin; rows come sorted."""

    def edges(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), dtype=bool)
        new[:1] = True
        for k in range(keys):
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        begin = edges(t) if len(t) else np.zeros(0, dtype=np.int64)
        if len(begin) > 1:
            yield t.slice(0, int(begin[-1])), begin
            t = t.slice(int(begin[-1]))
        held = t if len(t) else None
    if held is not None:
        yield held, np.array([0, len(held)])


def group_pairs(begin: np.ndarray, side: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs inside groups (``cross``: only those of different sides), about MOST_PAIRS at a time; groups come one after the other."""
    parts, size = [], 0
    small: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if cross[b]:
            left, right = np.flatnonzero(side[b:e] == 0) + b, np.flatnonzero(side[b:e] == 1) + b
        elif e - b <= 256:
            if e - b not in small:
                small[e - b] = np.triu_indices(e - b, 1)
            x, y = small[e - b]
            parts.append((x + b, y + b))
            size += len(x)
            left = right = x[:0]
        else:
            left = right = np.arange(b, e)
        step = max(1, MOST_PAIRS // max(1, len(right)))
        for lo in range(0, len(left) if len(right) else 0, step):
            x, y = np.repeat(left[lo : lo + step], len(right)), np.tile(right, len(left[lo : lo + step]))
            if left is right:
                x, y = x[x < y], y[x < y]
            parts.append((x, y))
            size += len(x)
            if size >= MOST_PAIRS:
                yield tuple(np.concatenate(p) for p in zip(*parts, strict=True))
                parts, size = [], 0
        if size >= MOST_PAIRS:
            yield tuple(np.concatenate(p) for p in zip(*parts, strict=True))
            parts, size = [], 0
    if parts:
        yield tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def joined(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    """A binary column of values of one length as a matrix, without a copy per row."""
    array = column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)
    _, at, data = array.buffers()
    lo = np.frombuffer(at, dtype=np.int32)[array.offset]
    return np.frombuffer(data, dtype=kind, count=len(array) * width, offset=int(lo)).reshape(-1, width)


def text_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, node (key of its shingle set, null without words), n, signature, row_key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch_words(batch.column(1)):
                values, begin = shingle_sets(words, SHINGLE)
                n = np.diff(begin)
                full = np.flatnonzero(n)
                node, sig = [None] * len(n), [None] * len(n)
                if len(full):
                    at = np.append(begin[full], begin[-1])
                    k, s = set_keys(values, at), signatures(values, at)
                    for i, row in enumerate(full.tolist()):
                        node[row], sig[row] = k[i].tobytes(), s[i].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.row, len(n)).cast(pa.int64()), pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), batch.column(2).slice(words.row, len(n))],
                    names=["doc_id", "node", "n", "sig", "key"],
                )

    key = row_key(F.col(id_col).cast("long"), F.col(text_col))
    return docs.select(id_col, text_col, key).mapInArrow(run, "doc_id long, node binary, n long, sig binary, key binary")


def block_of(node: str, blocks: str) -> str:
    """SQL for the block, of ``blocks``, that a node stands in: ranges of a hash, so that blocks of groups of like size hold the same nodes."""
    return f"cast(floor(shiftrightunsigned(xxhash64({node}), 11) / {float(1 << 53)} * {blocks}) as long)"


def block_pairs(members: DataFrame, group: str, size: str) -> DataFrame:
    """Rows dealt to pairs of blocks (group, lo, hi) of about BLOCK members, so that every pair of a group meets once in one task.

    A group of any size becomes tasks of bounded size; a member of a group of k rows is copied k / BLOCK times.
    """
    blocks = f"ceil({size} / {BLOCK})"
    dealt = members.withColumn("own", F.expr(block_of("node", blocks)))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"cast({blocks} as long)") - 1)))
    return dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("long")}).drop("own", "other")


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(node, bucket, size) of the LSH buckets that hold several classes; of buckets with the same members one."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    rows = classes.select("node", F.explode(keys).alias("bucket"))
    buckets = (
        rows.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("size"), F.sum(F.expr("cast(xxhash64(node) as decimal(38,0))")).alias("sum"), F.min("node").alias("least"))
        .filter("size > 1")
    )
    buckets = buckets.groupBy("size", "sum", "least").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    return rows.join(buckets, "bucket").select("node", "bucket", "size")


def homes(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(home, block, node, copies, key, sig) of the classes in ``members``: the largest bucket of each, cut into blocks of bounded rows and bytes.

    Near copies of one text have few homes, so few pairs of blocks hold all their candidate pairs; in a loose chain of texts homes are
    as small as the buckets.
    """
    home = members.groupBy("node").agg(F.max(F.struct("size", "bucket")).alias("h")).select("node", F.col("h.bucket").alias("home"))
    own = home.join(classes, "node").select("node", "home", "n", "copies", F.col("name.key").alias("key"), "sig")
    blocks = own.groupBy("home").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    return own.join(blocks, "home").select("home", F.expr(block_of("node", "blocks")).alias("block"), "node", "copies", "key", "sig")


def plausible_blocks(members: DataFrame, homed: DataFrame, needed: list[int]) -> DataFrame:
    """(home_a, block_a, home_b, block_b): all pairs of blocks with a pair of classes that share a bucket and survive the pruning."""
    dealt = block_pairs(members, "bucket", "size").drop("size").join(homed.select("node", "sig", "home", "block"), "node").select("bucket", "lo", "hi", "side", "home", "block", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in whole_groups(batches, 3):
            sig = joined(t.column(6), np.uint32, HASHES)
            places, place = np.unique(np.stack((t.column(4).to_numpy(), t.column(5).to_numpy()), axis=1), axis=0, return_inverse=True)
            place, found = place.ravel(), []
            cross = t.column(1).to_numpy() != t.column(2).to_numpy()
            for i, j in group_pairs(begin, t.column(3).to_numpy(), cross):
                i, j = prune(sig, i, j, needed)
                found.append(np.unique(np.minimum(place[i], place[j]) * len(places) + np.maximum(place[i], place[j])))
            codes = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
            a, b = places[codes // len(places)], places[codes % len(places)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[:, 0], a[:, 1], b[:, 0], b[:, 1])], names=["home_a", "block_a", "home_b", "block_b"])

    found = dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(run, "home_a long, block_a long, home_b long, block_b long")
    return found.distinct()


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i and j of each pair."""
    rows = np.unique(np.concatenate((i, j)))
    if len(i) < 4 * len(rows):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    values, column = np.unique(np.concatenate([sets[r] for r in rows.tolist()]), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows.tolist()])
    common = np.bincount(column)
    number = np.cumsum(common > 1) - 1
    used = common[column] > 1
    row, column = row[used], number[column[used]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(rows), len(rows)), dtype=np.float32)
    for lo in range(0, int((common > 1).sum()), 4096):
        b, e = np.searchsorted(column, (lo, lo + 4096))
        part = np.zeros((len(rows), 4096), dtype=np.float32)
        part[row[b:e], column[b:e] - lo] = 1
        total += part @ part.T
    at = np.full(int(rows.max()) + 1, -1)
    at[rows] = np.arange(len(rows))
    return total[at[i], at[j]].astype(np.int64)


PAIR = ["home_a", "block_a", "home_b", "block_b"]


def exact_links(groups: DataFrame, threshold: float, needed: list[int]) -> DataFrame:
    """(node, links, peer) of rows (PAIR, side, node, copies, sig, set): links counts documents, peer joins what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in whole_groups(batches, 4):
            sig, node, copies, held = joined(t.column(7), np.uint32, HASHES), t.column(5), t.column(6).to_numpy(), t.column(8)
            cross = (t.column(0).to_numpy() != t.column(2).to_numpy()) | (t.column(1).to_numpy() != t.column(3).to_numpy())
            links, label = np.zeros(len(t), dtype=np.int64), np.arange(len(t))
            sets: list[np.ndarray | None] = [None] * len(t)
            past = 0
            for i, j in group_pairs(begin, t.column(4).to_numpy(), cross):
                i, j = prune(sig, i, j, needed)
                if not len(i):
                    continue
                # sets are held for the groups of these pairs only
                first = int(begin[np.searchsorted(begin, i.min(), side="right") - 1])
                sets[past:first] = [None] * (first - past)
                past = first
                for r in np.unique(np.concatenate((i, j))).tolist():
                    if sets[r] is None:
                        sets[r] = np.frombuffer(held[r].as_buffer(), dtype=U64)
                size = np.array([0 if x is None else len(x) for x in sets])
                cuts = np.flatnonzero(np.diff(np.searchsorted(begin, i, side="right"))) + 1
                both = np.concatenate([overlaps(sets, x, y) for x, y in zip(np.split(i, cuts), np.split(j, cuts), strict=True)])
                near = both >= threshold * (size[i] + size[j] - both) - 1e-9
                i, j = i[near], j[near]
                links += np.bincount(i, copies[j], len(t)).astype(np.int64) + np.bincount(j, copies[i], len(t)).astype(np.int64)
                label = local_labels(len(t), np.concatenate((i, np.arange(len(t)))), np.concatenate((j, label)))
            own = pa.array(np.flatnonzero(links))
            yield pa.RecordBatch.from_arrays([node.take(own).combine_chunks(), pa.array(links[own.to_numpy()]), node.take(pa.array(label[own.to_numpy()])).combine_chunks()], names=["node", "links", "peer"])

    return groups.repartition(*PAIR).sortWithinPartitions(*PAIR).mapInArrow(run, "node binary, links long, peer binary")


def row_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``jaccard_join`` with the key of each row and class_key, that of the row that names its class (null without words).

    Texts are sets of five-word shingles (shorter texts: one shingle; words in lower case without signs). Documents with equal
    sets are one class of ``copies`` documents, named by the smallest id, same_id. Two documents are linked when the Jaccard similarity
    of their sets is at least ``threshold``; n_links counts all other documents linked to one, copies included, and
    class_id is the smallest id of those it is joined to by links. Documents without words have no links.

    Classes that share a MinHash band are candidates (a pair at 0.8 shares none with probability 4e-6). Their hashes
    are compared 16 at a time and a pair is dropped when its posterior chance falls below ``tolerance``; the rest
    is verified on the whole sets. Pairs never become rows of a table. Every class has one block, of its largest bucket, of bounded rows and bytes;
    buckets of any size tell which pairs of blocks hold a surviving pair, and only these get the sets: each task
    prunes and verifies the pairs between two blocks, counts links and names one peer per document. So every pair is verified in one place, and
    a chain of loosely related texts costs no more than its candidates. Rows that repeat an id are separate documents.
    """
    needed = least_matches(threshold, tolerance)
    rows = materialise(text_classes(docs, id_col, text_col), "shingled")
    classes = materialise(
        rows.filter("n > 0")
        .groupBy("node")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("same_id"), "key")).alias("name"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        .select("node", "name", "name.same_id", "copies", "n", "sig"),
        "classes",
    )
    members = materialise(shared_buckets(classes), "buckets")
    homed = materialise(homes(members, classes), "homes")
    pairs = materialise(plausible_blocks(members, homed, needed), "plausible")
    sides = pairs.select(F.col("home_a").alias("home"), F.col("block_a").alias("block"), *PAIR, F.lit(0).cast("long").alias("side")).unionByName(
        pairs.filter("home_a <> home_b or block_a <> block_b").select(F.col("home_b").alias("home"), F.col("block_b").alias("block"), *PAIR, F.lit(1).cast("long").alias("side"))
    )
    kind = "home long, block long, node binary, copies long, sig binary, set binary"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in batch_words(batch.column(5)):
                values, begin = shingle_sets(words, SHINGLE)
                own = batch.slice(words.row, words.n_texts)
                found = pa.array([values[b:e].tobytes() for b, e in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(5)), found], names=[f.split()[0] for f in kind.split(", ")])

    texts = docs.select(row_key(F.col(id_col).cast("long"), F.col(text_col)).alias("__key"), F.col(text_col).alias("__text"))
    full = homed.join(texts, F.col("key") == F.col("__key")).select("home", "block", "node", "copies", "sig", "__text").mapInArrow(sets, kind)
    full = full.repartition("home", "block").dropDuplicates(["home", "block", "node"]).join(sides, ["home", "block"])
    links = materialise(exact_links(full.select(*PAIR, "side", "node", "copies", "sig", "set"), threshold, needed), "links")

    groups = connected_components(links.select(F.col("node").alias("a"), F.col("peer").alias("b")))
    named = groups.join(classes.select("node", "name"), "node").groupBy("label").agg(F.min("name").alias("class")).join(groups, "label").select("node", "class")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    final = (
        classes.select("node", "name", "same_id", "copies")
        .join(named, "node", "left")
        .join(counted, "node", "left")
        .withColumn("class", F.coalesce("class", "name"))
        .select("node", "same_id", F.col("class.same_id").alias("class_id"), F.col("class.key").alias("class_key"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return rows.select("doc_id", "key", "node").join(final, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("same_id")).alias("same_id"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("copies", F.lit(1)).alias("copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "key",
        "class_key",
    )


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, same_id, class_id, copies, n_links, as ``row_classes`` tells."""
    return row_classes(docs, id_col, text_col, threshold, tolerance).drop("key", "class_key")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group that links join, with all columns: one with the smallest id, null only if all are. Rows without words all stay.

    Rows are told apart by id and text, so a group keeps one row also where ids are null or repeat; of rows that repeat both, one stays. Null is the
    empty text; nulls in other columns, and columns of any names, are passed on; an empty table gives an empty one.
    """
    classes = row_classes(docs, id_col, text_col, threshold).filter("class_key is null or key = class_key")
    names = classes.groupBy("key").agg(F.first(F.col("class_key").isNull()).alias("free")).withColumnRenamed("key", "kept")
    rows = docs.select(whole_row(docs), row_key(F.col(id_col).cast("long"), F.col(text_col)).alias("key"), F.monotonically_increasing_id().alias("nth"))
    kept = rows.join(names, F.col("key") == F.col("kept")).withColumn("nth", F.when(F.col("free"), F.col("nth")))
    return kept.dropDuplicates(["key", "nth"]).select("doc.*")
