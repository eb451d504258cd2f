import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cwlight.operators.optical_density import intensity_to_od
from cwlight.sources import extinction, tables


def recording(spark):
    samples = spark.createDataFrame([(r, "raw", c, s, float(100 + 10 * s + c)) for r in (1, 2) for c in (1, 2) for s in (1, 2, 3)], "recording long, assay string, channel long, sample long, value double")
    listed = spark.createDataFrame([(r, c, 1, 1, nm, 1, 1, None, None) for r in (1, 2) for c, nm in ((1, 760), (2, 850))], "recording long, measurement_index int, source_index int, detector_index int, wavelength_nm int, data_type int, data_type_index int, source_label string, detector_label string")
    probe = spark.createDataFrame([(r, role, 1, 0.0, 0.0, 0.0) for r in (1, 2) for role in ("source", "detector")], "recording long, role string, idx long, x double, y double, z double")
    tags = spark.createDataFrame([(1, n, "x") for n in tables.REQUIRED_TAGS] + [(2, "SubjectID", "y")], "recording long, name string, value string")
    return tables.Recording(samples, listed, probe, None, tags, {"raw": {"kind": "continuous_wave_intensity"}})


def test_round_trip_and_pruning(spark, tmp_path):
    rec = recording(spark)
    tables.write(rec, str(tmp_path / "r"))
    back = tables.read(spark, str(tmp_path / "r"), rec.contracts)
    key = ["recording", "assay", "channel", "sample", "value"]
    assert sorted(map(tuple, back.samples.select(*key).collect())) == sorted(map(tuple, rec.samples.select(*key).collect()))
    assert {r.channel_label for r in back.measurements.collect()} == {"S1_D1_760", "S1_D1_850"} and back.stims is None
    one = back.samples.where("assay = 'raw' AND recording = 2")
    assert "PartitionFilters: [isnotnull(assay" in one._jdf.queryExecution().toString() and one.count() == 6


def test_assays_are_added_not_changed(spark):
    rec = recording(spark)
    od = rec.add("OD", intensity_to_od(rec.assay("raw")), {"kind": "optical_density"}, "intensity_to_od", baseline="mean")
    assert rec.contracts.keys() == {"raw"} and od.only("optical_density") == "OD" and od.assay("OD").count() == 12
    assert od.steps[0]["parameters"] == {"baseline": "mean"}
    for bad in (lambda: od.add("OD", od.assay("raw"), {"kind": "optical_density"}, "x"), lambda: od.assay("none"), lambda: od.only("haemoglobin_concentration")):
        with pytest.raises(ValueError):
            bad()


def test_fingerprints_follow_values_not_row_order(spark):
    rows = recording(spark).assay("raw")
    a = {r.recording: r.fingerprint for r in tables.fingerprint(rows).collect()}
    assert a == {r.recording: r.fingerprint for r in tables.fingerprint(rows.orderBy(F.desc("sample"))).collect()}
    b = {r.recording: r.fingerprint for r in tables.fingerprint(rows.withColumn("value", F.when(F.expr("recording = 1 AND channel = 1 AND sample = 1"), 0.0).otherwise(F.col("value")))).collect()}
    assert a[1] != b[1] and a[2] == b[2]


def test_missing_tags(spark):
    rec = recording(spark)
    got = tables.missing_tags(rec.tags, rec.measurements.select("recording").distinct()).collect()
    assert {r.recording for r in got} == {2} and len(got) == len(tables.REQUIRED_TAGS) - 1


def test_stale_results_are_refused(spark):
    rows = recording(spark).assay("raw")
    mask = rows.select("recording", "channel", "sample", F.lit(True).alias("masked"))
    kept = tables.bound(mask, rows)
    assert sorted(map(tuple, tables.still_bound(kept, rows).collect())) == sorted(map(tuple, mask.collect()))
    changed = rows.withColumn("value", F.when(F.expr("recording = 1 AND sample = 2"), 0.0).otherwise(F.col("value")))
    for other in (changed, rows.where("recording = 2")):
        with pytest.raises(PySparkException):
            tables.still_bound(kept, other).select("masked").collect()


TABLE = "wavelength_nm,hbo2_cm1_M1,hbr_cm1_M1,source,source_version\n760,586,1548.52,a,1\n762,598,1508.44,a,1\n"


def test_extinction_table_and_its_digest(spark, tmp_path):
    path, manifest = tmp_path / "t.csv", tmp_path / "t.sha256"
    path.write_text(TABLE)
    manifest.write_text(f"{hashlib.sha256(TABLE.encode()).hexdigest()}  t.csv\n")
    assert sorted(map(tuple, extinction.read(spark, str(path)).collect())) == [(760.0, 586.0, 1548.52), (762.0, 598.0, 1508.44)]
    assert extinction.verify(spark, str(path), str(manifest)) == hashlib.sha256(TABLE.encode()).hexdigest()
    for bad in ("", "abc", "0" * 64):
        manifest.write_text(bad)
        with pytest.raises(ValueError):
            extinction.verify(spark, str(path), str(manifest))


@pytest.mark.parametrize("row", ["760,1,1,a,1", "764,-1,1,a,1", "764,,1,a,1", "764,1,NaN,a,1", "-2,1,1,a,1", "764,1,1,b,1", "764,1,1,a,", "764,1,1,a,2"])
def test_malformed_extinction_tables(spark, tmp_path, row):
    path = tmp_path / "t.csv"
    path.write_text(f"{TABLE}{row}\n")
    with pytest.raises(ValueError):
        extinction.read(spark, str(path))
