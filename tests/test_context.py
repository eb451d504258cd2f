from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cwlight.operators import geometry, short_separation
from cwlight.plans import recordings as rec
from cwlight.sources import context
from cwlight.sources.tables import Recording


@pytest.fixture(scope="module")
def whole(spark, data):
    samples = rec.vector_samples(spark, data).where("recording < 2").withColumn("assay", F.lit("OD")).cache()
    second = samples.withColumns({"assay": F.lit("HbO"), "value": F.col("value") * 2})
    times = samples.select("recording", "sample").distinct().withColumn("time_seconds", (F.col("sample") - 1) / 10.0)
    contracts = {"OD": {"kind": "optical_density", "unit": "1"}, "HbO": {"kind": "haemoglobin_concentration", "unit": "uM"}}
    return Recording(samples.unionByName(second), rec.vector_channels(spark, data).where("recording < 2"), rec.vector_probe(spark, data).where("recording < 2"), contracts=contracts, times=times)


@pytest.fixture(scope="module")
def bound_map(spark, whole):
    return context.bound(geometry.short_map(geometry.distances(whole.measurements, whole.probe)), whole).cache()


def bump(df, column, where):
    return df.withColumn(column, F.when(F.expr(where), F.col(column) + 0.5).otherwise(F.col(column)))


CHANGES = {
    "assay OD": lambda r: replace(r, samples=bump(r.samples, "value", "recording = 1 AND assay = 'OD' AND channel = 3 AND sample = 7")),
    "assay HbO": lambda r: replace(r, samples=bump(r.samples, "value", "recording = 0 AND assay = 'HbO' AND channel = 0 AND sample = 64")),
    "contract HbO": lambda r: replace(r, contracts={**r.contracts, "HbO": {"kind": "haemoglobin_concentration", "unit": "mM"}}),
    "clock": lambda r: replace(r, times=bump(r.times, "time_seconds", "recording = 1 AND sample = 64")),
    "probe": lambda r: replace(r, probe=bump(r.probe, "x", "recording = 0 AND role = 'source' AND idx = 2")),
    "list": lambda r: replace(r, measurements=r.measurements.withColumn("wavelength_nm", F.when(F.col("channel") == 5, 860).otherwise(F.col("wavelength_nm")))),
}


def test_a_bound_map_serves_its_own_recordings(whole, bound_map):
    od = whole.assay("OD")
    plain = bound_map.drop("context")
    for got, want in (
        (short_separation.regress_nearest(od, bound_map, 10.0, source=whole), short_separation.regress_nearest(od, plain, 10.0)),
        (short_separation.design_columns(od, bound_map, "mean", source=whole), short_separation.design_columns(od, plain, "mean")),
    ):
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("leaf", sorted(CHANGES))
def test_each_leaf_is_guarded_and_named(whole, bound_map, leaf):
    other = CHANGES[leaf](whole)
    with pytest.raises(Exception, match=f"stale, or made from another recording: {leaf} of recording"):
        short_separation.regress_nearest(whole.assay("OD"), bound_map, 10.0, source=other).collect()
    rest = [n for n in context.names(whole) if n != leaf]
    assert context.checked(bound_map, other, rest).count() == bound_map.count()
    with pytest.raises(Exception, match=leaf):
        context.checked(bound_map, other, [leaf]).count()


def test_all_regressions_and_designs_refuse_another_probe(whole, bound_map):
    od, other = whole.assay("OD"), CHANGES["probe"](whole)
    for run in (lambda: short_separation.regress_all(od, bound_map, 10.0, source=other), lambda: short_separation.design_columns(od, bound_map, source=other)):
        with pytest.raises(Exception, match="probe of recording 0"):
            run().collect()
    with pytest.raises(ValueError, match="as source"):
        short_separation.regress_nearest(od, bound_map, 10.0)


def test_new_and_lost_leaves_are_changes_too(whole, bound_map):
    more = replace(whole, contracts={**whole.contracts, "third": {"kind": "optical_density"}}, samples=whole.samples.unionByName(whole.samples.where("assay = 'OD'").withColumn("assay", F.lit("third"))))
    with pytest.raises(Exception, match="assay third, contract third"):
        context.checked(bound_map, more).count()
    with pytest.raises(Exception, match="clock"):
        context.checked(bound_map, replace(whole, times=None)).count()
    with pytest.raises(ValueError, match="no such leaf"):
        context.leaves(whole, ["assay none"])


def test_order_of_rows_and_columns_does_not_matter(whole):
    turned = replace(whole, probe=whole.probe.select(*reversed(whole.probe.columns)).orderBy(F.desc("idx")), samples=whole.samples.repartition(3))
    assert context.leaves(whole).exceptAll(context.leaves(turned)).count() == 0
