from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cwlight.operators import measurements, motion
from cwlight.sources import context, tables
from cwlight.sources.tables import Recording
from cwlight.streaming.contract import StreamContract

GOOD = StreamContract(10.0, "HbO", ("S1_D1", "S1_D2", "S2_D1"), (1, 1, 2), (1, 2, 1), ("uM",) * 3)


def test_plans_name_channels():
    plan = GOOD.plan({"left": ["S2_D1", "S1_D1"], "right": ["S1_D2"]}, {"left": 1.0, "right": -1.0}, baseline_seconds=2.0)
    assert plan.regions == {"left": (2, 0), "right": (1,)} and plan.contrast == {"feedback": {"left": 1.0, "right": -1.0}} and plan.baseline_seconds == 2.0
    two = GOOD.plan({"left": ["S1_D1"], "right": ["S1_D2"]}, {"a": {"left": 1, "right": 0}, "b": {"left": 0, "right": 1}})
    assert list(two.contrast) == ["a", "b"]
    with pytest.raises(ValueError, match="S9_D9"):
        GOOD.plan({"left": ["S9_D9"]}, {"left": 1.0})
    with pytest.raises(ValueError, match="every region"):
        GOOD.plan({"left": ["S1_D1"], "right": ["S1_D2"]}, {"left": 1.0})


@pytest.mark.parametrize(
    "change,text",
    [({"fs": 0.0}, "rate"), ({"fs": float("nan")}, "rate"), ({"assay_name": ""}, "haemoglobin"), ({"assay_kind": "optical_density"}, "haemoglobin"), ({"identity_kind": "measurement"}, "pairs"), ({"channel_ids": ("a", "a", "b")}, "names"),
     ({"units": ("uM", "uM", "M")}, "uM"), ({"units": ("uM",)}, "uM"), ({"source_index": (1, 1, 0)}, "source"), ({"detector_index": (1, 1, 1)}, "source"), ({"detector_index": (1, 2)}, "source")],
)
def test_malformed_contracts_are_refused(change, text):
    with pytest.raises(ValueError, match=text):
        replace(GOOD, **change)


def test_fingerprints_tell_contracts_apart():
    assert GOOD.fingerprint == replace(GOOD).fingerprint != replace(GOOD, clock="other").fingerprint


PROBE = "recording long, role string, idx long, x double, y double, z double, label string"
ROWS = [(1, "source", 1, 0.0, 0.0, 0.0, None), (1, "detector", 1, 0.0, 1.0, 0.0, None), (1, "landmark", 1, 0.0, 0.0, None, "Cz"), (1, "landmark", 2, 0.0, 0.0, None, "Nz")]


@pytest.mark.parametrize(
    "at,row,text",
    [(1, (1, "landmark", 3, 0.0, 0.0, None, "Iz"), "both have places"), (0, (1, "lens", 1, 0.0, 0.0, 0.0, None), "unknown role|both have places"), (0, (1, "source", 1, float("nan"), 0.0, 0.0, None), "not finite"), (0, (1, "source", 1, None, 0.0, 0.0, None), "not finite"),
     (0, (1, "source", 1, 0.0, 0.0, None, None), "some sources"), (2, (1, "source", 1, 5.0, 0.0, 0.0, None), "two places"), (2, (1, "landmark", 1, 0.0, 0.0, None, None), "some landmarks")],
)
def test_unsound_probes_are_refused(spark, at, row, text):
    assert measurements.sound_probe(spark.createDataFrame(ROWS, PROBE)).count() == 4
    with pytest.raises(Exception, match=text):
        measurements.sound_probe(spark.createDataFrame([*ROWS[:at], row, *ROWS[at + 1 :]], PROBE)).count()


def test_reading_checks_tags_samples_and_stimuli(spark, tmp_path):
    listed = spark.createDataFrame([(1, 1, 1, 1, 760.0, 1, 1, None, None)], "recording long, measurement_index int, source_index int, detector_index int, wavelength_nm double, data_type int, data_type_index int, source_label string, detector_label string")
    probe = spark.createDataFrame(ROWS[:2], PROBE)
    stims = spark.createDataFrame([(1, 1, 1, "a", [0.0, 1.0, 2.0], None)], "recording long, stim_index int, row long, name string, data array<double>, data_labels array<string>")
    tags = spark.createDataFrame([(1, "SubjectID", "s")], "recording long, name string, value string")
    rec = Recording(spark.createDataFrame([(1, "OD", 1, 1, 0.5)], "recording long, assay string, channel long, sample long, value double"), listed, probe, stims, tags)
    path = str(tmp_path / "good")
    tables.write(rec, path)
    back = tables.read(spark, path)
    assert back.tags.count() == 6 and back.stims.count() == 1 and back.samples.count() == 1
    spark.createDataFrame([(1, "SubjectID", "s")], tags.schema).write.mode("overwrite").parquet(f"{path}/tags")
    with pytest.raises(Exception, match="lacks the tag"):
        tables.read(spark, path).tags.collect()
    rec.samples.withColumn("value", F.lit(float("nan"))).drop("assay").write.mode("overwrite").parquet(f"{path}/samples/assay=OD")
    with pytest.raises(Exception, match="not finite"):
        tables.read(spark, path).samples.collect()
    stims.withColumn("data", F.array(F.lit(1.0), F.lit(-1.0), F.lit(0.0))).write.mode("overwrite").parquet(f"{path}/stims")
    with pytest.raises(Exception, match="stimulus row"):
        tables.read(spark, path).stims.collect()


def test_masks_are_bound_to_their_own_assay_only(spark):
    samples = spark.createDataFrame([(1, a, 1, s, float(s % 7)) for a in ("OD", "other") for s in range(1, 61)], "recording long, assay string, channel long, sample long, value double")
    rec = Recording(samples, spark.createDataFrame([(1, 1)], "recording long, measurement_index int"), None, contracts={"OD": {"kind": "optical_density"}, "other": {"kind": "motion_corrected_signal"}})
    mask = samples.where("assay = 'OD'").select("recording", "channel", "sample", F.col("sample").between(20, 30).alias("masked"))
    mask = context.bound(mask, rec, context.of_assay(rec, "OD")).cache()
    fixed = motion.spline_correct(rec.assay("OD"), mask, 10.0, source=rec)
    assert fixed.count() == 60
    moved = lambda a: replace(rec, samples=samples.withColumn("value", F.when((F.col("assay") == a) & (F.col("sample") == 3), 99.0).otherwise(F.col("value"))))
    assert motion.spline_correct(rec.assay("OD"), mask, 10.0, source=moved("other")).count() == 60
    with pytest.raises(Exception, match="stale, or made from another recording: assay OD"):
        motion.spline_correct(rec.assay("OD"), mask, 10.0, source=moved("OD")).count()


def test_a_new_assay_is_finite_and_takes_no_stored_name(spark):
    samples = spark.createDataFrame([(1, "OD", 1, 1, 0.5)], "recording long, assay string, channel long, sample long, value double")
    rec = Recording(samples, None, None, contracts={"raw": {"kind": "optical_density"}})
    rows = samples.drop("assay")
    contract = {"kind": "motion_corrected_signal"}
    assert rec.add("new", rows, contract, "step").samples.count() == 2
    with pytest.raises(Exception, match="already have an assay OD"):
        rec.add("OD", rows, contract, "step").samples.collect()
    with pytest.raises(Exception, match="not finite"):
        rec.add("new", rows.withColumn("value", F.lit(float("inf"))), contract, "step").samples.collect()
