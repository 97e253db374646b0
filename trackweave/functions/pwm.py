"""Position weight matrices as arrays of struct<a, c, g, t>: consensus, information, sequences."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC codes of sets of bases in the order A, C, G, T.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "AC": "M", "AG": "R", "AT": "W", "CG": "S", "CT": "Y", "GT": "K", "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N"}


def _bases(row: Column) -> list[tuple[str, Column]]:
    return [("A", row.a), ("C", row.c), ("G", row.g), ("T", row.t)]


def iupac(bases: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in IUPAC.items() for x in pair]), bases)


def consensus(pwm: Column) -> Column:
    """Per position the base with the largest weight; ties as their IUPAC code."""
    return F.array_join(F.transform(pwm, lambda r: iupac(F.concat(*[F.when(v == F.greatest(r.a, r.c, r.g, r.t), b).otherwise("") for b, v in _bases(r)]))), "")


def degenerate(pwm: Column, least: float = 0.25) -> Column:
    """Per position the IUPAC code of all bases with a weight of at least ``least``."""
    return F.array_join(F.transform(pwm, lambda r: iupac(F.concat(*[F.when(v >= least, b).otherwise("") for b, v in _bases(r)]))), "")


def information(row: Column) -> Column:
    """2 + sum of p log2 p, in bits."""
    terms = [F.when(v > 0, v * F.log2(v)).otherwise(0.0) for _, v in _bases(row)]
    return terms[0] + terms[1] + terms[2] + terms[3] + 2


def total_information(pwm: Column) -> Column:
    return F.aggregate(pwm, F.lit(0.0), lambda s, r: s + information(r))


def normalised(pwm: Column) -> Column:
    """Counts as shares of their row."""
    return F.transform(pwm, lambda r: F.struct(*[(v / (r.a + r.c + r.g + r.t)).alias(b.lower()) for b, v in _bases(r)]))


def as_text(pwm: Column, digits: int = 3) -> Column:
    """Rows as a:c:g:t joined by commas."""
    return F.array_join(F.transform(pwm, lambda r: F.concat_ws(":", *[F.format_string(f"%.{digits}f", v) for _, v in _bases(r)])), ",")


def sequences(pwm: Column, n: int) -> Column:
    """n sequences whose letters at each position come in the numbers that the weights ask for, in order A, C, G, T."""

    def letter(row: Column, i: Column) -> Column:
        share = (i + 0.5) / n
        whole = row.a + row.c + row.g + row.t
        return F.when(share <= row.a / whole, "A").when(share <= (row.a + row.c) / whole, "C").when(share <= (row.a + row.c + row.g) / whole, "G").otherwise("T")

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_join(F.transform(pwm, lambda r: letter(r, i)), ""))
