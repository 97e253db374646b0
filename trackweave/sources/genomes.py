"""Lengths of the chromosomes of known genomes."""

from pyspark.sql import DataFrame, SparkSession

# fixed values: published lengths of the assemblies' chromosomes
LENGTHS = {
    "hg18": {
        "chr1": 247249719, "chr2": 242951149, "chr3": 199501827, "chr4": 191273063, "chr5": 180857866, "chr6": 170899992, "chr7": 158821424, "chr8": 146274826,
        "chr9": 140273252, "chr10": 135374737, "chr11": 134452384, "chr12": 132349534, "chr13": 114142980, "chr14": 106368585, "chr15": 100338915, "chr16": 88827254,
        "chr17": 78774742, "chr18": 76117153, "chr19": 63811651, "chr20": 62435964, "chr21": 46944323, "chr22": 49691432, "chrX": 154913754, "chrY": 57772954, "chrM": 16571,
    },
    "mm8": {
        "chr1": 197069962, "chr2": 181976762, "chr3": 159872112, "chr4": 155029701, "chr5": 152003063, "chr6": 149525685, "chr7": 145134094, "chr8": 132085098,
        "chr9": 124000669, "chr10": 129959148, "chr11": 121798632, "chr12": 120463159, "chr13": 120614378, "chr14": 123978870, "chr15": 103492577, "chr16": 98252459,
        "chr17": 95177420, "chr18": 90736837, "chr19": 61321190, "chrX": 165556469, "chrY": 16029404, "chrM": 16299,
    },
}


def chromosome_lengths(spark: SparkSession, genome: str) -> DataFrame:
    """chrom, length of a known genome; others come from a file (``read_chrom_lengths``) or a table."""
    if genome not in LENGTHS:
        raise ValueError(f"unknown genome {genome}: give its lengths as a table")
    return spark.createDataFrame(list(LENGTHS[genome].items()), "chrom string, length long")
