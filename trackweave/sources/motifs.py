"""Readers of motif matrices and binary motif scans."""

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import numbered_lines, split_lines, with_records

CHROM_SLOT = 128
SCHEMA = "id string, factors array<string>, species string, pwm array<struct<a:double,c:double,g:double,t:double>>"


def _row(cells: list[str]) -> dict[str, float]:
    return dict(zip("acgt", map(float, cells), strict=True))


def parse_motif(text: str) -> list[dict]:
    """Records of the sectioned format: rows pos A C G T consensus degenerate, then #Factor Name, #Species and other sections."""
    section, pwm, extra = "", [], {}
    for line in text.splitlines():
        cells = line.split()
        if line.startswith("#"):
            section = line[1:].strip().rstrip(":").lower()
        elif section.endswith("matrix") or not section:
            if len(cells) >= 5 and cells[0].isdigit():
                pwm.append(_row(cells[1:5]))
        elif line.strip():
            extra.setdefault(section, []).append(line.strip())
    return [{"factors": extra.get("factor name", []), "species": ",".join(extra.get("species", [])), "pwm": pwm}] if pwm else []


def parse_transfac(text: str) -> list[dict]:
    """Records of two-letter lines: AC or ID name, BF factors, numbered count rows after P0 (or PO), // ends one."""
    out, now = [], {"pwm": [], "factors": [], "species": "", "id": None}
    for line in [*text.splitlines(), "//"]:
        tag, _, rest = line.partition(" ")
        if tag in ("AC", "ID") and now["id"] is None:
            now["id"] = rest.strip()
        elif tag in ("BF", "NA"):
            now["factors"].append(rest.split(";")[0].strip())
        elif tag in ("OS", "HP"):
            now["species"] = rest.strip()
        elif tag.isdigit():
            now["pwm"].append(_row(rest.split()[:4]))
        elif tag.startswith("//"):
            if now["pwm"]:
                out.append(now)
            now = {"pwm": [], "factors": [], "species": "", "id": None}
    return out


def parse_jaspar(text: str) -> list[dict]:
    """Records of a header >id name and four rows of counts (with or without letter and brackets), A C G T."""
    out = []
    for block in text.split(">")[1:]:
        head, *rows = [x for x in block.splitlines() if x.strip()]
        counts = [[float(x) for x in r.replace("[", " ").replace("]", " ").split() if x.replace(".", "", 1).lstrip("-").isdigit()] for r in rows[:4]]
        if len(counts) == 4:
            name = head.split()
            out.append({"id": name[0], "factors": name[1:2], "species": "", "pwm": [_row(c) for c in zip(*counts, strict=True)]})
    return out


def parse_columns(text: str) -> list[dict]:
    """Records of a name line and rows of letter: values, as A: 0.1 0.2 (all positions of one base)."""
    out, name, rows = [], None, {}
    for line in [*text.splitlines(), ""]:
        head, sep, rest = line.partition(":")
        base = head.strip().lower()
        if sep and base in ("a", "c", "g", "t"):
            rows[base] = [float(x) for x in rest.split()]
            if len(rows) == 4:
                pwm = [dict(zip("acgt", v, strict=True)) for v in zip(*(rows[b] for b in "acgt"), strict=True)]
                out.append({"id": name, "factors": [name] if name else [], "species": "", "pwm": pwm})
                rows = {}
        elif line.strip():
            name = line.strip().lstrip(">#").split()[0]
    return out


PARSERS = {"motif": parse_motif, "transfac": parse_transfac, "jaspar": parse_jaspar, "columns": parse_columns}


def read_motifs(spark: SparkSession, path: str, kind: str = "motif") -> DataFrame:
    """Matrices of small text files, one record per motif; counts or shares as they stand in the file."""
    parse = PARSERS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows += [{"id": r.get("id") or name, "factors": r["factors"], "species": r["species"], "pwm": r["pwm"]} for r in parse(text)]
            row = pa.struct([(b, pa.float64()) for b in "acgt"])
            kinds = pa.schema([("id", pa.string()), ("factors", pa.list_(pa.string())), ("species", pa.string()), ("pwm", pa.list_(row))])
            yield from pa.Table.from_pylist(rows, schema=kinds).to_batches()

    return spark.read.text(path, wholetext=True).select(F.input_file_name(), "value").mapInArrow(run, SCHEMA)


class MotifRecord:
    """Table function over the lines (line number, text) of one record: id, factors, species, source, pwm as shares. What each format says stands in ``RECORD_FORMATS``."""

    def __init__(self):
        self.id, self.factors, self.species, self.source, self.rows, self.order, self.columns, self.awaited = None, [], [], None, [], "ACGT", {}, None
        self.file, self.record = "", 0

    def eval(self, row, kind):
        self.file, self.record = row["file"], row["record"]
        getattr(self, f"_{kind}")(row["value"].strip("\r\n"))

    def terminate(self):
        rows = self.rows or [dict(zip("ACGT", v)) for v in zip(*(self.columns.get(b, []) for b in "ACGT"))]
        if not rows:
            return
        shares = []
        for r in rows:
            total = sum(r.values()) or 1.0
            shares.append(tuple(r.get(b, 0.0) / total for b in "ACGT"))
        name = self.file.rsplit("/", 1)[-1]
        yield self.id or name.rsplit(".", 1)[0], self.record, self.factors, self.species, self.source, shares

    def _counts(self, cells):
        self.rows.append(dict(zip(self.order, map(float, cells))))

    def _listed(self, text, keep=()):
        """Names of factors; signs between names become commas, unless the text holds a name that they belong to."""
        for signs, exception in (("/", "C/EB"), ("()", "Su(H)"), (":+", None)):
            if exception is None or exception not in text or exception not in keep:
                text = text.translate({ord(c): "," for c in signs})
        self.factors += [x.strip() for x in text.split(",") if x.strip()]

    def _organisms(self, triple):
        for name in triple.replace(".", " ").partition(":")[2].split(","):
            if name.strip() and name.strip() not in self.species:
                self.species.append(name.strip())

    def _transfac(self, line):
        tag, rest = line[:2], line[2:].strip()
        if tag == "AC":
            self.id = rest.split()[0]
        elif tag == "NA":
            self._listed(rest, ("C/EB", "Su(H)"))
        elif tag == "BF" and rest.count(";") == 2:
            self._organisms(rest.split(";")[2])
        elif tag == "P0":
            self.order = [x.upper() for x in rest.split()[:4]]
        elif tag == "RX":
            self.source = line.replace(".", " ").split()[2]
        elif tag.isdigit():
            self._counts(rest.split()[:4])

    def _transfac_raw(self, line):
        """Sections whose content follows their title."""
        title = next((t for t in ("Accession Number", "Factor name", "Factors", "Binding Matrix") if line.startswith(t)), None)
        if title:
            self.awaited = title
        elif self.awaited == "Accession Number":
            self.id, self.awaited = line.strip(), None
        elif self.awaited == "Factor name":
            self._listed(line)
            self.factors, self.awaited = [f.replace("&", "/") for f in self.factors], None
        elif self.awaited == "Factors":
            for item in line.split(". T"):
                cells = item.strip().split(";")
                if len(cells) == 3 and cells[1].strip() in self.factors:
                    self._organisms(cells[2])
            self.awaited = None
        elif self.awaited == "Binding Matrix":
            cells = line.split()
            if len(cells) != 5:
                self.awaited = None
            elif cells[0].isalpha():
                self.order = [x.upper() for x in cells[:4]]
            else:
                self._counts(cells[:4])

    def _dfci(self, line):
        """The bases, then a number and four counts a line; the factor is the second part of the file's name."""
        cells = line.split()
        if len(cells) >= 5:
            self._counts(cells[1:5])
        elif len(cells) == 4:
            self.order = [x.upper() for x in cells]
            self.factors = [*self.file.rsplit("/", 1)[-1].split(".")[1:2]]
            self.id = f"DFCI.{self.factors[0]}" if self.factors else None

    def _bulyk(self, line):
        """A name up to the first low line, then a line of tabbed values for each base; records of a file are numbered."""
        base, colon, rest = line.partition(":")
        if "_" in line:
            self.factors, self.id = [line.split("_")[0].strip()], f"MB{self.record:04d}"
        elif colon and base in ("A", "C", "G", "T"):
            self.columns[base] = [float(x) for x in rest.split("\t") if x.strip()]


RECORD_FORMATS = {
    "transfac": lambda v: v.startswith("AC"),
    "transfac_raw": lambda v: F.lit(False),
    "dfci": lambda v: F.lit(False),
    "bulyk": lambda v: v.contains("_"),
}


def read_motif_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Motifs of record files of any size: id, record (its number in the file), factors, species, source, pwm as shares.

    Records are numbered over all splits of a file and dealt to tasks, which parse them line by line (a table function). What stands before the first record of a table is left out.
    """
    lines = with_records(split_lines(spark, path), RECORD_FORMATS[kind](F.col("value")))
    if kind in ("transfac", "bulyk"):
        lines = lines.filter("record > 0")
    schema = "id string, record long, factors array<string>, species array<string>, source string, pwm array<struct<a:double,c:double,g:double,t:double>>"
    parse = F.udtf(MotifRecord, returnType=schema)
    ordered = lines.select("file", "record", "block", F.col("id").alias("line"), "value").asTable().partitionBy("file", "record").orderBy("block", "line")
    return parse(ordered, F.lit(kind))


RECORD = np.dtype([("pos", "<i4"), ("score", "<f4")])
RANGE_BYTES = 4 << 20


def scan_ranges(head: bytes, size: int, chroms: list[str], most: int = RANGE_BYTES) -> list[tuple[str, int, int]]:
    """(chrom, first byte, end) of whole records, at most ``most`` bytes each, of a binary scan of ``size`` bytes.

    A scan begins with a slot of 128 bytes per chromosome that starts with the offset of its records (or 0); records are position and score, of four bytes each.
    """
    starts = [int.from_bytes(head[i * CHROM_SLOT : i * CHROM_SLOT + 4].ljust(4, b"\0"), "little") for i in range(len(chroms))]
    found = sorted((s, c) for s, c in zip(starts, chroms, strict=True) if s)
    most = max(most // RECORD.itemsize, 1) * RECORD.itemsize
    out = []
    for (s, c), e in zip(found, [*(x[0] for x in found[1:]), size], strict=False):
        e = s + (e - s) // RECORD.itemsize * RECORD.itemsize
        out += [(c, lo, min(lo + most, e)) for lo in range(s, e, most)]
    return out


def read_scan(spark: SparkSession, path: str, chroms: list[str], cutoff: float = 0.0, most: int = RANGE_BYTES) -> DataFrame:
    """(file, chrom, strand, pos, score): the sign of the position is the strand; positions count from 0.

    The headers give ranges of whole records, at most ``most`` bytes each, which are dealt to a task for RANGE_BYTES (the session's number at least): a file of any size is read in parts. The number of tasks is given, as adaptive
    execution sees few bytes in the rows that name the ranges and would leave them all to one task.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(file) as f:
                    rows += [(file, *r) for r in scan_ranges(f.read(CHROM_SLOT * len(chroms)), size, chroms, most)]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["file", "chrom", "lo", "hi"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, chrom, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(file) as f:
                    f.seek(lo)
                    found = np.frombuffer(f.read(hi - lo), dtype=RECORD)
                found = found[found["score"] > cutoff]
                n, pos = len(found), found["pos"]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.repeat(pa.scalar(x, pa.string()), n) for x in (file, chrom)), pc.if_else(pa.array(pos >= 0), "+", "-"), pa.array(np.abs(pos.astype(np.int64)) - 1), pa.array(found["score"].astype(float))],
                    names=["file", "chrom", "strand", "pos", "score"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "length")
    size = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    parts = files.mapInArrow(ranges, "file string, chrom string, lo long, hi long")
    return parts.repartition(tasks).mapInArrow(records, "file string, chrom string, strand string, pos long, score double")


def opened(path: str) -> pa.NativeFile:
    """A file that can be read from any byte, by its path or address on a file system that Arrow knows."""
    place = re.sub("^file:/+", "/", path)
    system, place = pafs.FileSystem.from_uri(place)
    return system.open_input_file(place)


def write_scan(hits: DataFrame, path: str, chroms: list[str], parts: int | None = None) -> int:
    """Write (chrom, strand, pos, score) as binary scans, one file per task; the number of records. Positions are below 2**31 - 1.

    Rows are dealt by ranges of chromosome and position to ``parts`` tasks (the session's number if not given), each of which holds its records. A file gets its name at the end and is replaced by a repeated task.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            chrom, strand, pos, score = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for c in np.unique(chrom.astype(str)):
                at = chrom == c
                part = np.zeros(int(at.sum()), dtype=RECORD)
                part["pos"], part["score"] = np.where(strand[at] == "-", -1, 1) * (pos[at] + 1), score[at]
                parts.setdefault(str(c), []).append(part)
        if unknown := set(parts) - set(chroms):
            raise ValueError(f"chromosomes without a slot: {sorted(unknown)}")
        n = sum(len(p) for c in parts.values() for p in c)
        if not n:
            return
        system, folder = pafs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
        system.create_dir(folder, recursive=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}"
        own = f"{folder}/.{uuid.uuid4().hex}"
        head, at = bytearray(CHROM_SLOT * len(chroms)), CHROM_SLOT * len(chroms)
        for i, c in enumerate(chroms):
            if c in parts:
                head[i * CHROM_SLOT : i * CHROM_SLOT + 4] = at.to_bytes(4, "little")
                at += sum(p.nbytes for p in parts[c])
        with system.open_output_stream(own) as f:
            f.write(bytes(head))
            for c in chroms:
                for p in parts.get(c, []):
                    f.write(p.tobytes())
        system.move(own, name)
        yield pa.RecordBatch.from_pydict({"file": [name], "n": [n]}, schema=pa.schema([("file", pa.string()), ("n", pa.int64())]))

    dealt = hits.select("chrom", "strand", F.col("pos").cast("long"), F.col("score").cast("double")).repartitionByRange(*([parts] if parts else []), "chrom", "pos").sortWithinPartitions("chrom", "pos")
    return dealt.mapInArrow(write, "file string, n long").agg(F.sum("n")).first()[0] or 0


def motif_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Positions of matrix files that have one row per position after a header."""
    return numbered_lines(spark, path).groupBy("file").agg((F.count(F.lit(1)) - 1).alias("length"))
