"""Names and formats of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FASTA, FASTQ = ("fasta", "fna", "fas", "fa"), ("fq", "fastq")


def file_format(path: Column) -> Column:
    """fasta, fastq, co (a sketch) or null, by the suffix below .gz or .bz2."""
    bare = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.(gz|bz2)$", "")
    suffix = F.regexp_extract(bare, r"\.([A-Za-z]+)$", 1)
    return F.when(suffix.isin(*FASTA), "fasta").when(suffix.isin(*FASTQ), "fastq").when(suffix == "co", "co")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def strip_suffix(path: Column, suffix: str) -> Column:
    return F.regexp_replace(path, rf"\.{suffix}$", "")


def clean_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^0-9a-zA-Z_.]", "_")


def archive_path(accession: Column, assembly: Column, root: str) -> Column:
    """Where an archive keeps an assembly: under the accession's digits, three by three."""
    full = F.regexp_extract(accession, r"(GC[AF]_[0-9.]+)", 1)
    digits = F.regexp_extract(full, r"_(\d{9})", 1)
    name = F.concat_ws("_", full, F.regexp_replace(assembly, r"\s", "_"))
    return F.when(digits != "", F.concat_ws("/", F.lit(root), F.substring(full, 1, 3), F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 3), name, F.concat(name, F.lit("_genomic.fna.gz"))))
