"""Extinction tables from CSV, with their checks and the digest they are published with."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "wavelength_nm double, hbo2_cm1_M1 double, hbr_cm1_M1 double, source string, source_version string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(nm, hbo, hbr) of a table in 1/(cm M), as ``functions.optics.extinction`` takes it.

    One pass over the few hundred rows checks that wavelengths are positive and
    distinct, coefficients finite and not negative, and that one version of one
    source gave them all.
    """
    rows = spark.read.schema(SCHEMA).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    number = lambda c, least: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) < float("inf")) & least(F.col(c))
    named = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    fine = number("wavelength_nm", lambda x: x > 0) & number("hbo2_cm1_M1", lambda x: x >= 0) & number("hbr_cm1_M1", lambda x: x >= 0) & named("source") & named("source_version")
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(fine).alias("fine"), F.count_distinct("wavelength_nm").alias("steps"), F.count_distinct("source", "source_version").alias("sources")).first()
    if not (seen["n"] and seen["n"] == seen["fine"] == seen["steps"] and seen["sources"] == 1):
        raise ValueError(f"not an extinction table: {path}")
    return rows.select(F.col("wavelength_nm").alias("nm"), F.col("hbo2_cm1_M1").alias("hbo"), F.col("hbr_cm1_M1").alias("hbr"))


def verify(spark: SparkSession, path: str, manifest: str) -> str:
    """The SHA-256 of the file at ``path``, if ``manifest`` names it; else an error."""
    words = spark.read.text(manifest).first()
    want = words["value"].split()[0] if words and words["value"].split() else ""
    if not re.fullmatch("[0-9a-f]{64}", want):
        raise ValueError(f"not a digest manifest: {manifest}")
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha")).first()["sha"]
    if got != want:
        raise ValueError(f"{path} differs from its manifest")
    return got
