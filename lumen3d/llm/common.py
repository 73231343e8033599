"""What the corpus operators share; tables in the cluster's shared folder come from the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumen3d.functions.tables import broadcast_if_small, shared_root, shared_table

__all__ = ["LOWER", "UPPER", "WORD", "ascii_lower", "broadcast_if_small", "read", "row_key", "shared_root", "shared_table", "whole_text"]

#: Words are runs of anything but these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def whole_text(text_col: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits that name a row's identifier and text: two hashes, each seeded by that of the other column first; a null differs from every value."""
    both = F.xxhash64(F.col(id_col), F.col(text_col)), F.xxhash64(F.col(text_col), F.col(id_col), F.lit(1))
    return F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in both]))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
