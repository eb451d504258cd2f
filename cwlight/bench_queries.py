"""The registered queries over the recordings of ``plans.recordings``, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cwlight.functions import kernels, optics
from cwlight.operators import geometry, measurements, motion, quality, short_separation
from cwlight.operators.mbll import mbll, with_distance, with_pathlength
from cwlight.operators.optical_density import intensity_to_od
from cwlight.plans import recordings as rec
from cwlight.sources import preparation
from cwlight.streaming.feedback import Plan, replay

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
FS, N = rec.FS, rec.LENGTH
SIZE, STEP = 32, 16


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded for comparison; adding 0 turns -0 into 0."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


EV = "ev AS (SELECT 0::BIGINT AS recording, user_id AS channel, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sample, value::DOUBLE + 0.01::DOUBLE AS value FROM events)"
VEC = "vec AS (SELECT vec_id // 24 AS recording, vec_id % 24 AS channel, i AS sample, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) r(i))"
CH = """ch AS (SELECT *, 0.5 * d AS mid FROM (SELECT vec_id // 24 AS recording, vec_id % 24 AS channel, (vec_id % 24) // 2 AS pair,
        CASE WHEN vec_id % 2 = 0 THEN 760 ELSE 850 END AS nm, [0.008, 0.009, 0.03][((vec_id % 24) // 2) % 3 + 1] AS d FROM embeddings))"""
R9 = "round({}, 9) + 0.0"


def _zero_phase_sql(b: list[float], a: list[float], ends: str, source: str = "vec") -> str:
    """A table ``filtered`` with each channel of ``source`` filtered forwards and backwards, by recursion over samples."""
    pad = 2 * len(b) if ends == "zeros" else 0
    gain = sum(b) / sum(a) if ends == "hold" else 0.0
    total = N + pad

    def tap(k: int, of: str, first: str) -> str:
        return f"CASE WHEN i >= {k} THEN {of}[i + 1 - {k}] ELSE {first} END"

    drive = " + ".join(f"({x!r}) * ({tap(k, 'xs', 'xs[1]' if gain or ends == 'hold' else '0')})" for k, x in enumerate(b))
    back = "".join(f" - ({x!r}) * ({tap(k, 'ys', f'xs[1] * ({gain!r})')})" for k, x in enumerate(a) if k)
    step = lambda name, source: f"""{name} AS (SELECT recording, channel, 0 AS i, xs, []::DOUBLE[] AS ys FROM {source}
        UNION ALL SELECT recording, channel, i + 1, xs, list_append(ys, {drive}{back}) FROM {name} WHERE i < {total})"""  # noqa: E731
    return f"""arr AS (SELECT recording, channel, list_concat(list(value ORDER BY sample), {[0.0] * pad}::DOUBLE[]) AS xs FROM {source} GROUP BY 1, 2),
      {step("ahead", "arr")}, turned AS (SELECT recording, channel, list_reverse(ys) AS xs FROM ahead WHERE i = {total}),
      {step("back", "turned")}, filtered AS (SELECT recording, channel, unnest(range(1, {N + 1})) AS sample, unnest(list_reverse(ys)[1:{N}]) AS value FROM back WHERE i = {total})"""


def _od(ref: str, value: str = "value") -> str:
    return f"WITH {EV} SELECT recording, channel, sample, round(ln({ref}) - ln({value}), 9) + 0.0 AS od FROM ev"


@query(_od("avg(value) OVER (PARTITION BY channel)"))
def intensity_to_od_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(intensity_to_od(rec.event_samples(spark, sf_dir)))


QUERIES["intensity_to_od"], ORACLE["intensity_to_od"] = QUERIES.pop("intensity_to_od_query"), ORACLE.pop("intensity_to_od_query")


@query(_od("median(value) OVER (PARTITION BY channel)"))
def od_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(intensity_to_od(rec.event_samples(spark, sf_dir), baseline="median"))


@query(f"WITH {EV}, z AS (SELECT channel, avg(value) AS zero FROM ev WHERE (sample - 1) / 10.0 BETWEEN 0 AND 1 GROUP BY channel) SELECT recording, channel, sample, round(ln(zero) - ln(value), 9) + 0.0 AS od FROM ev JOIN z USING (channel)")
def od_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(intensity_to_od(rec.event_samples(spark, sf_dir), interval=(0.0, 1.0), fs=FS))


@query(_od("100.0"))
def od_explicit_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(intensity_to_od(rec.event_samples(spark, sf_dir), reference=100.0))


@query(f"WITH {EV}, c AS (SELECT recording, channel, sample, CASE WHEN value - 20 > 0 THEN value - 20 ELSE 0.001 END AS value FROM ev) SELECT recording, channel, sample, round(ln(avg(value) OVER (PARTITION BY channel)) - ln(value), 9) + 0.0 AS od FROM c")
def od_nonpositive_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rec.event_samples(spark, sf_dir).withColumn("value", F.col("value") - 20)
    return _rounded(intensity_to_od(rows, nonpositive="replace", replacement=0.001))


@query("""SELECT c_custkey, nm, round(223.3 + 0.05624 * pow(c_custkey % 71, 0.8493) - 5.723e-7 * nm * nm * nm + 0.001245 * nm * nm - 0.9025 * nm, 9) AS dpf
          FROM (SELECT c_custkey, (650 + c_custkey % 301)::DOUBLE AS nm FROM customer)""")
def dpf_scholkmann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rec.table(spark, sf_dir, "customer").select("c_custkey", (F.lit(650) + F.col("c_custkey") % 301).cast("double").alias("nm"))
    return _rounded(rows.withColumn("dpf", optics.dpf_scholkmann(F.col("nm"), F.col("c_custkey") % 71)))


@query("""SELECT c_custkey, nm, round(CASE nm WHEN 690 THEN 5.38 + 0.049 * pow(age, 0.877) WHEN 744 THEN 5.11 + 0.106 * pow(age, 0.723) WHEN 807 THEN 4.99 + 0.067 * pow(age, 0.814) ELSE 4.67 + 0.062 * pow(age, 0.819) END, 9) AS dpf
          FROM (SELECT c_custkey, [690, 744, 807, 832][c_custkey % 4 + 1] AS nm, c_custkey % 51 AS age FROM customer)""")
def dpf_duncan(spark: SparkSession, sf_dir: str) -> DataFrame:
    nm = F.element_at(F.array(*map(F.lit, optics.DUNCAN)), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = rec.table(spark, sf_dir, "customer").select("c_custkey", nm.alias("nm"))
    return _rounded(rows.withColumn("dpf", optics.dpf_duncan(F.col("nm"), F.col("c_custkey") % 51)))


GRID = "grid(nm, hbo, hbr) AS (VALUES " + ", ".join(f"({k}.0::DOUBLE, {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in optics.EXTINCTION.items()) + ")"


def _extinction_sql(factor: str) -> str:
    return f"""WITH {GRID}, seg AS (SELECT *, lead(nm) OVER (ORDER BY nm) AS nm2, lead(hbo) OVER (ORDER BY nm) AS hbo2, lead(hbr) OVER (ORDER BY nm) AS hbr2 FROM grid),
      q AS (SELECT p_partkey, [250.0, 250.5, 251.0, 252.0, 690.0, 760.0, 761.0, 761.5, 762.0, 850.0][p_partkey % 10 + 1]::DOUBLE AS wavelength_nm FROM part)
      SELECT p_partkey, wavelength_nm, round((hbo + CASE WHEN wavelength_nm = nm THEN 0 ELSE (wavelength_nm - nm) / (nm2 - nm) * (hbo2 - hbo) END) * {factor}, 4) AS hbo,
             round((hbr + CASE WHEN wavelength_nm = nm THEN 0 ELSE (wavelength_nm - nm) / (nm2 - nm) * (hbr2 - hbr) END) * {factor}, 4) AS hbr
      FROM q JOIN seg ON wavelength_nm = nm OR (wavelength_nm > nm AND wavelength_nm < nm2 AND nm2 - nm <= 2)"""


def _extinction(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    nm = F.element_at(F.array(*map(F.lit, [250.0, 250.5, 251.0, 252.0, 690.0, 760.0, 761.0, 761.5, 762.0, 850.0])), (F.col("p_partkey") % 10 + 1).cast("int"))
    grid = spark.createDataFrame([(float(k), a, b) for k, (a, b) in optics.EXTINCTION.items()], "nm double, hbo double, hbr double")
    return _rounded(optics.extinction(rec.table(spark, sf_dir, "part").select("p_partkey", nm.alias("wavelength_nm")), grid, unit), 4)


@query(_extinction_sql("1.0"))
def extinction_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extinction(spark, sf_dir, "cm-1 M-1")


@query(_extinction_sql("(100 * ln(10.0))"))
def extinction_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extinction(spark, sf_dir, "m-1 M-1")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.distances(rec.vector_channels(spark, sf_dir), rec.vector_probe(spark, sf_dir))


@query(f"WITH {CH} SELECT recording, channel, pair, nm AS wavelength_nm, d AS distance_m FROM ch")
def source_detector_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_placed(spark, sf_dir).select("recording", "channel", "pair", "wavelength_nm", "distance_m"))


@query(f"WITH {CH} SELECT recording, channel, d AS distance_m, pair::DOUBLE AS midpoint_x_m, mid AS midpoint_y_m, d < 0.01 AS is_short FROM ch")
def short_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(geometry.short_map(_placed(spark, sf_dir)).select("recording", "channel", "distance_m", "midpoint_x_m", "midpoint_y_m", "is_short"))


NEAREST = f"""{CH}, near AS (SELECT t.recording, t.channel AS target, s.channel AS short, sqrt(pow(t.pair - s.pair, 2) + pow(t.mid - s.mid, 2)) AS between_m
    FROM ch t JOIN ch s ON t.recording = s.recording AND t.nm = s.nm AND t.d >= 0.01 AND s.d < 0.01
    QUALIFY row_number() OVER (PARTITION BY t.recording, t.channel ORDER BY round(sqrt(pow(t.pair - s.pair, 2) + pow(t.mid - s.mid, 2)), 11), s.channel) = 1)"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.short_map(_placed(spark, sf_dir))


@query(f"WITH {NEAREST} SELECT recording, target, short, round(between_m, 9) AS between_m FROM near")
def short_nearest_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(geometry.nearest_short(_mapped(spark, sf_dir)))


def _regress_sql(lag: int) -> str:
    return f"""WITH {VEC}, {NEAREST},
      j AS (SELECT v.recording, v.channel, v.sample, v.value, x.value AS x FROM vec v LEFT JOIN near n ON v.recording = n.recording AND v.channel = n.target
            LEFT JOIN vec x ON x.recording = v.recording AND x.channel = n.short AND x.sample = v.sample - {lag}),
      b AS (SELECT recording, channel, regr_slope(value, x) AS slope, avg(x) AS m FROM j WHERE x IS NOT NULL GROUP BY 1, 2)
      SELECT j.recording, j.channel, j.sample, round(CASE WHEN x IS NULL THEN value ELSE value - (x - m) * slope END, 6) + 0.0 AS value FROM j LEFT JOIN b ON j.recording = b.recording AND j.channel = b.channel"""


@query(_regress_sql(0))
def short_regress_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(short_separation.regress_nearest(rec.vector_samples(spark, sf_dir), _mapped(spark, sf_dir), FS), 6)


@query(_regress_sql(3))
def short_regress_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(short_separation.regress_nearest(rec.vector_samples(spark, sf_dir), _mapped(spark, sf_dir), FS, 0.3), 6)


def _regress_all_sql(most: int) -> str:
    """Short channels made orthogonal one after the other; each takes its part from all that follow."""
    steps = ""
    for k in range(1, most + 1):
        steps += f""", q{k} AS (SELECT recording, nm, xs AS q FROM c{k - 1} WHERE k = {k}),
      c{k} AS (SELECT c.recording, c.nm, c.channel, c.k, c.m, CASE WHEN q IS NULL OR c.k <= {k} THEN xs ELSE [xs[i] - list_dot_product(xs, q) / list_dot_product(q, q) * q[i] for i in range(1, {N + 1})] END AS xs
            FROM c{k - 1} c LEFT JOIN q{k} q ON c.recording = q.recording AND c.nm = q.nm)"""
    return f"""WITH {VEC}, {CH}, r AS (SELECT recording, channel, nm, CASE WHEN d < 0.01 THEN row_number() OVER (PARTITION BY recording, nm, d < 0.01 ORDER BY channel) END AS k FROM ch),
      a AS (SELECT recording, channel, avg(value) AS m, list(value ORDER BY sample) AS xs FROM vec GROUP BY 1, 2),
      c0 AS (SELECT recording, nm, channel, k, m, [x - m for x in xs] AS xs FROM a JOIN r USING (recording, channel)){steps},
      o AS (SELECT recording, channel, unnest(range(1, {N + 1})) AS sample, unnest(xs) + m AS value FROM c{most} WHERE k IS NULL)
      SELECT v.recording, v.channel, v.sample, round(coalesce(o.value, v.value), 6) + 0.0 AS value FROM vec v LEFT JOIN o USING (recording, channel, sample)"""


@query(_regress_all_sql(rec.CHANNELS // 3))
def short_regress_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(short_separation.regress_all(rec.vector_samples(spark, sf_dir), _mapped(spark, sf_dir), FS), 6)


SHORTS = f"{VEC}, {CH}, s AS (SELECT v.recording, pair, nm, sample, value FROM vec v JOIN ch ON v.recording = ch.recording AND v.channel = ch.channel WHERE d < 0.01)"


@query(f"WITH {SHORTS} SELECT recording, 'short_S' || pair || '_D' || pair || '_wl' || nm AS \"column\", sample, round(value, 9) + 0.0 AS value FROM s")
def design_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(short_separation.design_columns(rec.vector_samples(spark, sf_dir), _mapped(spark, sf_dir), "all"))


@query(f"WITH {SHORTS} SELECT recording, 'short_mean_wl' || nm AS \"column\", sample, round(avg(value), 9) + 0.0 AS value FROM s GROUP BY ALL")
def design_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(short_separation.design_columns(rec.vector_samples(spark, sf_dir), _mapped(spark, sf_dir), "mean"))


@query(f"""WITH {SHORTS}, m AS (SELECT recording, nm, sample, avg(value) AS value FROM s GROUP BY ALL)
           SELECT recording, 'short_mean_wl' || nm AS \"column\", sample, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) + 0.0 AS value FROM m WINDOW w AS (PARTITION BY recording, nm)""")
def design_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(short_separation.standardized(short_separation.design_columns(rec.vector_samples(spark, sf_dir), _mapped(spark, sf_dir), "mean")), 6)


def _design_bands_sql(band: str) -> str:
    b, a = (x.tolist() for x in kernels.butterworth(3, short_separation.BANDS[band], FS))
    return f"""WITH RECURSIVE {SHORTS}, design AS (SELECT recording, 'short_mean_wl' || nm AS channel, sample, avg(value) AS value FROM s GROUP BY ALL),
      {_zero_phase_sql(b, a, "zeros", "design")}
      SELECT recording, channel AS "column", sample, round(value, 6) + 0.0 AS value FROM design
      UNION ALL SELECT recording, channel || '_{band}', sample, round(value, 6) + 0.0 FROM filtered"""


@query(_design_bands_sql("respiration"))
def design_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = short_separation.design_columns(rec.vector_samples(spark, sf_dir), _mapped(spark, sf_dir), "mean")
    return _rounded(short_separation.with_bands(mean, FS, {"respiration": short_separation.BANDS["respiration"]}), 6)


def _mbll_sql(factor: str = "6", distance: str = "d") -> str:
    return f"""WITH {VEC}, {CH}, e(nm, o, r) AS (VALUES (760, 586.0::DOUBLE, 1548.52::DOUBLE), (850, 1058.0::DOUBLE, 691.32::DOUBLE)),
      c AS (SELECT recording, channel, pair, o * 100 * ln(10.0) * ({distance}) * ({factor}) AS eo, r * 100 * ln(10.0) * ({distance}) * ({factor}) AS er FROM ch JOIN e USING (nm)),
      p AS (SELECT recording, pair, sum(eo * eo) AS oo, sum(eo * er) AS co, sum(er * er) AS rr FROM c GROUP BY 1, 2 HAVING count(*) = 2),
      w AS (SELECT c.recording, channel, pair, (rr * eo - co * er) / (oo * rr - co * co) * 1e6 AS wo, (oo * er - co * eo) / (oo * rr - co * co) * 1e6 AS wr FROM c LEFT JOIN p USING (recording, pair)),
      s AS (SELECT w.recording, pair, sample, sum(wo * value) AS hbo, sum(wr * value) AS hbr FROM w JOIN vec v ON w.recording = v.recording AND w.channel = v.channel GROUP BY 1, 2, 3)
      SELECT recording, pair, sample, round(hbo, 6) + 0.0 AS hbo, round(hbr, 6) + 0.0 AS hbr, round(hbo + hbr, 6) + 0.0 AS hbt FROM s"""


def _mbll(spark: SparkSession, sf_dir: str, placed: DataFrame) -> DataFrame:
    """Every pair has rows; one with a single wavelength has nulls."""
    return _rounded(mbll(rec.vector_samples(spark, sf_dir).withColumnRenamed("value", "od"), optics.extinction(placed, _grid(spark)), incomplete="null"), 6)


@query(_mbll_sql())
def mbll_hbo_hbr_hbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mbll(spark, sf_dir, with_pathlength(_placed(spark, sf_dir), 6.0))


@query(_mbll_sql("CASE nm WHEN 760 THEN 6.25 ELSE 5.5 END"))
def mbll_factor_by_wavelength(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rec.vector_channels(spark, sf_dir).select("wavelength_nm").distinct().withColumn("pathlength_factor", F.when(F.col("wavelength_nm") == 760, 6.25).otherwise(5.5))
    return _mbll(spark, sf_dir, with_pathlength(_placed(spark, sf_dir), table))


@query(_mbll_sql("5 + channel / 32.0"))
def mbll_factor_by_measurement(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rec.vector_channels(spark, sf_dir).select("recording", "channel", (5 + F.col("channel") / 32.0).alias("pathlength_factor"))
    return _mbll(spark, sf_dir, with_pathlength(_placed(spark, sf_dir), table))


@query(_mbll_sql("6", "0.02 + pair / 512.0"))
def mbll_distance_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = with_pathlength(_placed(spark, sf_dir), 6.0)
    table = placed.select("recording", "pair").distinct().withColumn("distance_m", 0.02 + F.col("pair") / 512.0)
    return _mbll(spark, sf_dir, with_distance(placed, table))


def _hbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oxygenated haemoglobin as a signal of pairs; pairs of one wavelength have none."""
    rows = mbll(rec.vector_samples(spark, sf_dir).withColumnRenamed("value", "od"), optics.extinction(with_pathlength(_placed(spark, sf_dir), 6.0), _grid(spark)), incomplete="null")
    return rows.where("hbo IS NOT NULL").select("recording", F.col("pair").alias("channel"), "sample", F.col("hbo").alias("value"))


def _grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(float(k), a, b) for k, (a, b) in optics.EXTINCTION.items()], "nm double, hbo double, hbr double")


HBO = _mbll_sql().replace("SELECT recording, pair, sample, round(hbo, 6)", "SELECT recording, pair AS channel, sample, hbo AS value, round(hbo, 6)")
HBO_ROWS = f"hb AS (SELECT recording, channel, sample, value FROM ({HBO}) WHERE value IS NOT NULL), pr AS (SELECT DISTINCT recording, pair, d, 0.5 * d AS mid FROM (SELECT vec_id // 24 AS recording, (vec_id % 24) // 2 AS pair, [0.008, 0.009, 0.03][((vec_id % 24) // 2) % 3 + 1] AS d FROM embeddings))"


@query(f"""WITH {HBO_ROWS}, near AS (SELECT t.recording, t.pair AS target, s.pair AS short FROM pr t JOIN pr s ON t.recording = s.recording AND t.d >= 0.01 AND s.d < 0.01
        QUALIFY row_number() OVER (PARTITION BY t.recording, t.pair ORDER BY round(sqrt(pow(t.pair - s.pair, 2) + pow(t.mid - s.mid, 2)), 11), s.pair) = 1),
      j AS (SELECT v.recording, v.channel, v.sample, v.value, x.value AS x FROM hb v LEFT JOIN near n ON v.recording = n.recording AND v.channel = n.target LEFT JOIN hb x ON x.recording = v.recording AND x.channel = n.short AND x.sample = v.sample),
      b AS (SELECT recording, channel, regr_slope(value, x) AS slope, avg(x) AS m FROM j WHERE x IS NOT NULL GROUP BY 1, 2)
      SELECT j.recording, j.channel, j.sample, round(CASE WHEN x IS NULL THEN value ELSE value - (x - m) * slope END, 5) + 0.0 AS value FROM j LEFT JOIN b ON j.recording = b.recording AND j.channel = b.channel""")
def short_regress_hbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(short_separation.regress_nearest(_hbo(spark, sf_dir), geometry.pair_map(_placed(spark, sf_dir)), FS), 5)


@query(f"""WITH {HBO_ROWS} SELECT hb.recording, 'short_mean' AS "column", sample, round(avg(value), 6) + 0.0 AS value FROM hb JOIN pr ON hb.recording = pr.recording AND hb.channel = pr.pair WHERE d < 0.01 GROUP BY ALL""")
def design_hbo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(short_separation.design_columns(_hbo(spark, sf_dir), geometry.pair_map(_placed(spark, sf_dir)), "mean"), 6)


_AHEAD = "greatest(max(value) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) - value, value - min(value) OVER (PARTITION BY channel ORDER BY sample ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"


@query(f"WITH {EV} SELECT recording, channel, sample, round({_AHEAD}, 9) AS change FROM ev")
def motion_max_lag_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(motion.max_lag_change(rec.event_samples(spark, sf_dir), 5).drop("value"))


def _mask_sql(source: str, sd: float, amplitude: float) -> str:
    part = "PARTITION BY recording, channel"
    ahead = _AHEAD.replace("PARTITION BY channel", part)
    return f"""a AS (SELECT recording, channel, sample, {ahead} AS change, value - lag(value) OVER ({part} ORDER BY sample) AS step FROM {source}),
      b AS (SELECT recording, channel, sample, coalesce(change > {sd} * stddev_samp(step) OVER ({part}) OR change > {amplitude}, false) AS bad FROM a),
      mask AS (SELECT recording, channel, sample, sample > 1 AND coalesce(bool_or(bad) OVER ({part} ORDER BY sample ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), false) AS masked FROM b)"""


def _event_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.motion_mask(rec.event_samples(spark, sf_dir), FS, t_motion=0.5, t_mask=0.2, sd_threshold=3.0, amplitude_threshold=400.0)


def _vector_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.motion_mask(rec.vector_samples(spark, sf_dir), FS, t_motion=0.5, t_mask=0.2, sd_threshold=2.6, amplitude_threshold=0.45)


@query(f"WITH {EV}, {_mask_sql('ev', 3.0, 400.0)} SELECT * FROM mask")
def motion_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_mask(spark, sf_dir)


VMASK = f"{VEC}, {CH}, {_mask_sql('vec', 2.6, 0.45)}"
GROUPED = f"{VMASK}, grouped AS (SELECT m.recording, m.channel, sample, bool_or(masked) OVER (PARTITION BY m.recording, pair, sample) AS masked FROM mask m JOIN ch ON m.recording = ch.recording AND m.channel = ch.channel)"


@query(f"WITH {GROUPED} SELECT * FROM grouped")
def motion_mask_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.group_wavelengths(_vector_mask(spark, sf_dir), rec.vector_channels(spark, sf_dir))


@query(f"WITH {GROUPED} SELECT recording, sample, bool_or(masked) AS masked FROM grouped GROUP BY 1, 2")
def motion_mask_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion_mask_grouped(spark, sf_dir).groupBy("recording", "sample").agg(F.bool_or("masked").alias("masked"))


@query(f"""WITH {EV}, {_mask_sql('ev', 3.0, 400.0)}, r AS (SELECT *, sample - row_number() OVER (PARTITION BY channel ORDER BY sample) AS run FROM mask WHERE masked)
      SELECT recording, channel, min(sample) AS start_index, max(sample) AS end_index, round((min(sample) - 1) / 10.0, 9) AS start_time, round((max(sample) - 1) / 10.0, 9) AS end_time FROM r GROUP BY recording, channel, run""")
def motion_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(motion.intervals(_event_mask(spark, sf_dir), FS))


def _tddr_sql() -> str:
    """The weighted mean of the slow part's steps by recursion; steps of equal size everywhere do not occur here."""
    b, a = (x.tolist() for x in kernels.butterworth(3, 0.5, FS))
    weights = "[pow(greatest(1 - pow(abs(d - centre) / (4.685 * 1.4826 * spread), 2), 0), 2) for d in step]"
    spread = "list_median([abs(d - {}) for d in step])"
    moved = f"list_dot_product({weights}, step) / list_sum({weights})"
    return f"""WITH RECURSIVE {VEC}, flat AS (SELECT recording, channel, sample, value - avg(value) OVER (PARTITION BY recording, channel) AS value FROM vec),
      {_zero_phase_sql(b, a, "hold", "flat")},
      d AS (SELECT recording, channel, sample, value - lag(value) OVER (PARTITION BY recording, channel ORDER BY sample) AS d FROM filtered),
      l AS (SELECT recording, channel, list(d ORDER BY sample) AS step, avg(d) AS centre FROM d WHERE d IS NOT NULL GROUP BY 1, 2),
      rounds AS (SELECT recording, channel, 0 AS i, step, centre, {spread.format("centre")} AS spread, false AS done FROM l
        UNION ALL SELECT recording, channel, i, step, moved, {spread.format("moved")}, abs(moved - centre) < {kernels.ROOT_EPS!r} * greatest(abs(moved), abs(centre))
        FROM (SELECT recording, channel, i + 1 AS i, step, centre, {moved} AS moved FROM rounds WHERE NOT done AND i < 50)),
      last AS (SELECT recording, channel, unnest(range(2, {N + 1})) AS sample, unnest({weights}) * (unnest(step) - centre) AS rise FROM rounds QUALIFY i = max(i) OVER (PARTITION BY recording, channel)),
      level AS (SELECT f.recording, f.channel, f.sample, coalesce(sum(rise) OVER (PARTITION BY f.recording, f.channel ORDER BY f.sample), 0) + flat.value - f.value AS value
        FROM filtered f JOIN flat USING (recording, channel, sample) LEFT JOIN last USING (recording, channel, sample))
      SELECT recording, channel, sample, round(level.value - avg(level.value) OVER w + avg(vec.value) OVER w, 6) + 0.0 AS value FROM level JOIN vec USING (recording, channel, sample) WINDOW w AS (PARTITION BY recording, channel)"""


@query(_tddr_sql())
def tddr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(motion.tddr(rec.vector_samples(spark, sf_dir), FS), 6)


@query(f"""WITH {VEC}, taps(tap, low, high) AS (SELECT i - 1, l[i], [l[4], -l[3], l[2], -l[1]][i] FROM (SELECT [(1 + sqrt(3)) / (4 * sqrt(2)), (3 + sqrt(3)) / (4 * sqrt(2)), (3 - sqrt(3)) / (4 * sqrt(2)), (1 - sqrt(3)) / (4 * sqrt(2))] AS l), range(1, 5) r(i))
      SELECT recording, channel, ((sample - tap + 64) % 64) // 2 + 1 AS k, round(sum(value * low), 9) + 0.0 AS approximation, round(sum(value * high), 9) + 0.0 AS detail
      FROM vec, taps WHERE (sample - tap + 64) % 2 = 0 GROUP BY 1, 2, 3""")
def wavelet_db2_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(motion.db2_level(rec.vector_samples(spark, sf_dir), N))


#: At 64 samples only the finest level is judged: details of the channel and of itself moved by one sample; those
#: beyond their fences leave the half of the signal that they make up.
@query(f"""WITH {VEC}, taps(tap, high) AS (SELECT i - 1, [l[4], -l[3], l[2], -l[1]][i] FROM (SELECT [(1 + sqrt(3)) / (4 * sqrt(2)), (3 + sqrt(3)) / (4 * sqrt(2)), (3 - sqrt(3)) / (4 * sqrt(2)), (1 - sqrt(3)) / (4 * sqrt(2))] AS l), range(1, 5) r(i)),
      met AS (SELECT recording, channel, sample, value, high, moved, (sample + moved - tap + {N}) % {N} AS place FROM vec, taps, range(0, 2) m(moved)),
      d AS (SELECT recording, channel, moved, place, sum(value * high) AS detail FROM met WHERE place % 2 = 0 GROUP BY 1, 2, 3, 4),
      q AS (SELECT *, quantile_cont(detail, 0.25) OVER w AS q1, quantile_cont(detail, 0.75) OVER w AS q3 FROM d WINDOW w AS (PARTITION BY recording, channel, moved)),
      gone AS (SELECT recording, channel, sample, sum(detail * high) / 2 AS part FROM met JOIN q USING (recording, channel, moved, place) WHERE detail < q1 - 1.5 * (q3 - q1) OR detail > q3 + 1.5 * (q3 - q1) GROUP BY 1, 2, 3)
      SELECT recording, channel, sample, round(value - coalesce(part, 0), 6) + 0.0 AS value FROM vec LEFT JOIN gone USING (recording, channel, sample)""")
def wavelet_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(motion.wavelet_correct(rec.vector_samples(spark, sf_dir)), 6)


def _spline_sql() -> str:
    """Samples lie evenly, so one elimination serves the masked stretches of every length; stretches are levelled by running sums."""
    p, h = 0.99, 1 / FS
    k, inv = 6 * (1 - p), FS
    d0, d1, d2 = 6 * k * inv**2 + 4 * p * h, -4 * k * inv**2 + p * h, k * inv**2
    reach = f"CASE WHEN n < {0.3 * FS} THEN n WHEN n < {3 * FS} THEN {max(1, int(0.3 * FS))} ELSE n // 10 END"
    return f"""WITH RECURSIVE {GROUPED},
      elim AS (SELECT 1 AS i, {d0!r}::DOUBLE AS d, 0::DOUBLE AS below, 0::DOUBLE AS l1, 0::DOUBLE AS l2
        UNION ALL SELECT i + 1, {d0!r} - f1 * f1 * d - f2 * f2 * below, d, f1, f2
        FROM (SELECT i, d, below, f2, ({d1!r} - f2 * below * l1) / d AS f1 FROM (SELECT *, CASE WHEN i >= 2 THEN {d2!r} / below ELSE 0 END AS f2 FROM elim)) WHERE i < {N}),
      fac AS (SELECT list(d ORDER BY i) AS d, list(l1 ORDER BY i) AS l1, list(l2 ORDER BY i) AS l2 FROM elim),
      flag AS (SELECT g.*, v.value, CASE WHEN masked = lag(masked) OVER w THEN 0 ELSE 1 END AS new FROM grouped g JOIN vec v USING (recording, channel, sample) WINDOW w AS (PARTITION BY g.recording, g.channel ORDER BY sample)),
      seg AS (SELECT recording, channel, k, min(sample) AS a, count(*) AS n, any_value(masked) AS masked, list(value ORDER BY sample) AS y
        FROM (SELECT *, sum(new) OVER (PARTITION BY recording, channel ORDER BY sample) AS k FROM flag) GROUP BY ALL),
      fwd AS (SELECT recording, channel, k, n, y, 0 AS i, []::DOUBLE[] AS z FROM seg WHERE masked AND n > 2
        UNION ALL SELECT recording, channel, k, n, y, i + 1, list_append(z, {inv!r} * (y[i + 3] - 2 * y[i + 2] + y[i + 1])
          - CASE WHEN i >= 1 THEN l1[i + 1] * z[i] ELSE 0 END - CASE WHEN i >= 2 THEN l2[i + 1] * z[i - 1] ELSE 0 END) FROM fwd, fac WHERE i < n - 2),
      back AS (SELECT recording, channel, k, n, z, n - 2 AS i, [0, 0]::DOUBLE[] AS u FROM fwd WHERE i = n - 2
        UNION ALL SELECT recording, channel, k, n, z, i - 1, list_prepend(z[i] / d[i] - CASE WHEN i + 1 <= n - 2 THEN l1[i + 1] * u[1] ELSE 0 END - CASE WHEN i + 2 <= n - 2 THEN l2[i + 2] * u[2] ELSE 0 END, u) FROM back, fac WHERE i > 0),
      bent AS (SELECT recording, channel, k, list_prepend(0::DOUBLE, u)[1:n] AS u FROM back WHERE i = 0),
      raw AS (SELECT recording, channel, k, a, n, masked, y, {reach} AS r, CASE WHEN NOT masked THEN y WHEN u IS NULL THEN [0.0 for x in y]
        ELSE [{k * inv!r} * (CASE WHEN j < n THEN u[j + 1] - u[j] ELSE 0 END - CASE WHEN j > 1 THEN u[j] - u[j - 1] ELSE 0 END) for j in range(1, n + 1)] END AS x
        FROM seg LEFT JOIN bent USING (recording, channel, k)),
      ends AS (SELECT *, list_avg(x[1:r]) AS head, list_avg(x[n - r + 1:n]) AS tail, list_avg(y[1:r]) AS clean FROM raw),
      rise AS (SELECT *, sum(CASE WHEN before IS NOT NULL THEN before - head WHEN masked THEN after - tail ELSE 0 END) OVER (PARTITION BY recording, channel ORDER BY k) AS lift
        FROM (SELECT *, lag(tail) OVER w AS before, lead(clean) OVER w AS after FROM ends WINDOW w AS (PARTITION BY recording, channel ORDER BY k)))
      SELECT recording, channel, unnest(range(a, a + n)) AS sample, round(unnest(x) + lift, 6) + 0.0 AS value FROM rise"""


def _wavelet_tree_sql(levels: int, min_level: int) -> str:
    """The tree by joins with the taps, level by level; what lies beyond the fences of its block is carried back up and taken off."""
    low = [(1 + 3**0.5) / 32**0.5, (3 + 3**0.5) / 32**0.5, (3 - 3**0.5) / 32**0.5, (1 - 3**0.5) / 32**0.5]
    high = [low[3], -low[2], low[1], -low[0]]
    key = "recording, channel"
    out = f"""WITH {EV}, size AS (SELECT {key}, count(*) AS n, CASE WHEN count(*) = 1 THEN 0 ELSE ceil(log2(count(*)))::INT END AS e, list(value ORDER BY sample) AS v FROM ev GROUP BY ALL),
      pad AS (SELECT {key}, n, e - {min_level} AS depth, list_concat(v, list_transform(range(n, (1 << e)), lambda i: 0.0::DOUBLE)) AS v FROM size),
      b0 AS (SELECT {key}, n, depth, 0 AS block, [x - list_avg(v) for x in v] AS xs FROM pad)"""
    read = lambda taps: "[" + " + ".join(f"({t!r}) * xs[(2 * j + {i} - 1 + m) % m + 1]" for i, t in enumerate(taps)) + " for j in range(0, m // 2)]"
    for k in range(levels):
        out += f""",
      r{k} AS (SELECT {key}, n, depth, block, s, len(xs) AS m, CASE s WHEN 0 THEN xs ELSE list_concat([xs[len(xs)]], xs[1:len(xs) - 1]) END AS xs FROM b{k}, range(0, 2) t(s) WHERE depth > {k}),
      d{k} AS (SELECT {key}, n, depth, block, s, m, {read(low)} AS low, {read(high)} AS high FROM r{k}),
      b{k + 1} AS (SELECT {key}, n, depth, 2 * block + s AS block, low AS xs FROM d{k}),
      q{k} AS (SELECT *, list_aggregate(high[1:least(n >> {k + 1}, m // 2)], 'quantile_cont', 0.25) AS q1, list_aggregate(high[1:least(n >> {k + 1}, m // 2)], 'quantile_cont', 0.75) AS q3 FROM d{k}),
      g{k} AS (SELECT {key}, block, s, m, [CASE WHEN depth - 1 > {k} AND (h < q1 - 1.5 * (q3 - q1) OR h > q3 + 1.5 * (q3 - q1)) THEN h ELSE 0 END for h in high] AS gone FROM q{k})"""
    tap = lambda t: f"(CASE WHEN (i + 1 - {t} + m) % 2 = 0 THEN ({low[t]!r}) * coalesce(up[((i + 1 - {t} + m) % m) // 2 + 1], 0) + ({high[t]!r}) * gone[((i + 1 - {t} + m) % m) // 2 + 1] ELSE 0 END)"
    for k in reversed(range(levels)):
        above = f"SELECT g.*, c.xs AS up FROM g{k} g LEFT JOIN c{k + 1} c ON c.recording = g.recording AND c.channel = g.channel AND c.block = 2 * g.block + g.s" if k + 1 < levels else f"SELECT *, NULL::DOUBLE[] AS up FROM g{k}"
        out += f""",
      m{k} AS (SELECT {key}, block, s, m, [{' + '.join(tap(t) for t in range(4))} for i in range(0, m)] AS xs FROM ({above})),
      c{k} AS (SELECT x.recording, x.channel, x.block, [(x.xs[i + 1] + y.xs[(i + 1) % x.m + 1]) / 2 for i in range(0, x.m)] AS xs FROM m{k} x JOIN m{k} y ON x.recording = y.recording AND x.channel = y.channel AND x.block = y.block AND x.s = 0 AND y.s = 1)"""
    return out + " SELECT ev.recording, ev.channel, sample, round(value - xs[sample], 6) + 0.0 AS value FROM ev JOIN c0 USING (recording, channel)"


@query(_wavelet_tree_sql(9, 1))
def wavelet_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of some 40 to 100 samples: four levels or more are judged, each block by its own fences."""
    return _rounded(motion.wavelet_correct(rec.event_samples(spark, sf_dir), min_level=1), 6)


@query(_spline_sql())
def spline_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(motion.spline_correct(rec.vector_samples(spark, sf_dir), motion_mask_grouped(spark, sf_dir), FS, lost="null"), 6)


def _band_sql(name: str, digits: int) -> str:
    b, a = (x.tolist() for x in kernels.butterworth(3, short_separation.BANDS[name], FS))
    return f"WITH RECURSIVE {VEC}, {_zero_phase_sql(b, a, 'zeros')} SELECT recording, channel, sample, round(value, {digits}) + 0.0 AS value FROM filtered"


#: The narrow Mayer band is the worst conditioned, so it is compared to fewer digits.
DIGITS = {"mayer": 4, "respiration": 6, "cardiac": 6}


def _band(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(short_separation.bandpass(rec.vector_samples(spark, sf_dir), FS, name), DIGITS[name])

    return run


for _name in short_separation.BANDS:
    QUERIES[f"bandpass_{_name}"], ORACLE[f"bandpass_{_name}"] = _band(_name), _band_sql(_name, DIGITS[_name])


def bandpass_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The respiration band of channels cut into blocks, which are dealt out and filtered apart."""
    return _rounded(short_separation.bandpass(rec.vector_samples(spark, sf_dir), FS, "respiration", split=48), 5)


QUERIES["bandpass_split"], ORACLE["bandpass_split"] = bandpass_split, _band_sql("respiration", 5)


def _sci_sql() -> str:
    b, a = (x.tolist() for x in kernels.butterworth(3, (0.7, 1.5), FS))
    core = CORE.removeprefix(f"{VEC}, ").replace("FROM vec v", "FROM filtered v")
    return f"WITH RECURSIVE {VEC}, {_zero_phase_sql(b, a, 'hold')}, {core} SELECT recording, channel, win::INT AS \"window\", round(score, 6) + 0.0 AS score FROM scored"


def sci_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.scalp_coupling(rec.vector_samples(spark, sf_dir), rec.vector_channels(spark, sf_dir), FS, N, SIZE, STEP), 6)


CORE = f"""{VEC}, {CH}, w AS (SELECT v.recording, pair, v.channel, sample, value, unnest(range(1, 4)) AS win FROM vec v JOIN ch ON v.recording = ch.recording AND v.channel = ch.channel),
      i AS (SELECT * FROM w WHERE sample BETWEEN (win - 1) * 16 + 1 AND (win - 1) * 16 + 32),
      core AS (SELECT a.recording, a.pair, a.win, corr(a.value, b.value) AS score FROM i a JOIN i b ON a.recording = b.recording AND a.pair = b.pair AND a.win = b.win AND a.sample = b.sample AND a.channel < b.channel GROUP BY 1, 2, 3),
      scored AS (SELECT ch.recording, ch.channel, ch.pair, win, score FROM core JOIN ch ON core.recording = ch.recording AND core.pair = ch.pair)"""


QUERIES["sci_windows"], ORACLE["sci_windows"] = sci_windows, _sci_sql()


def _core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.coupling(rec.vector_samples(spark, sf_dir), rec.vector_channels(spark, sf_dir), N, SIZE, STEP)


@query(f"WITH {CORE} SELECT recording, channel, win::INT AS \"window\", round(score, 9) + 0.0 AS score FROM scored")
def coupling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_core(spark, sf_dir))


SNR = f"""{VEC}, x AS (SELECT recording, channel, sample - 1 AS n, (value - avg(value) OVER (PARTITION BY recording, channel)) * (0.54 - 0.46 * cos(2 * pi() * (sample - 1) / 63)) AS v FROM vec),
      f AS (SELECT recording, channel, k, (pow(sum(v * cos(2 * pi() * k * n / 64)), 2) + pow(sum(v * sin(2 * pi() * k * n / 64)), 2)) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p FROM x, range(0, 33) r(k) GROUP BY 1, 2, 3),
      g AS (SELECT recording, channel, k * 10 / 64.0 AS lo, (k + 1) * 10 / 64.0 AS hi, p, lead(p) OVER (PARTITION BY recording, channel ORDER BY k) AS q FROM f),
      band(name, a, b) AS (VALUES ('s', 0.7, 1.5), ('n', 10 / 64.0, 0.7), ('n', 1.5, 5.0)),
      o AS (SELECT recording, channel, name, p, q, lo, hi, greatest(lo, a) AS u, least(hi, b) AS v FROM g, band WHERE q IS NOT NULL AND greatest(lo, a) < least(hi, b)),
      t AS (SELECT recording, channel, name, sum((v - u) * ((p + (q - p) * (u - lo) / (hi - lo)) + (p + (q - p) * (v - lo) / (hi - lo))) / 2) AS area FROM o GROUP BY 1, 2, 3),
      snr AS (SELECT recording, channel, 10 * log10(sum(area) FILTER (name = 's') / sum(area) FILTER (name = 'n')) AS score FROM t GROUP BY 1, 2)"""


def _snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.snr(rec.vector_samples(spark, sf_dir), FS, N, N)


@query(f"WITH {SNR} SELECT recording, channel, 1 AS \"window\", round(score, 6) + 0.0 AS score FROM snr")
def snr_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_snr(spark, sf_dir), 6)


def _peak_power_sql() -> str:
    b, a = (x.tolist() for x in kernels.butterworth(3, (0.7, 1.5), FS))
    n = 2 * SIZE - 1
    part = "PARTITION BY recording, channel, win"
    return f"""WITH RECURSIVE {VEC}, {CH}, {_zero_phase_sql(b, a, "hold")},
      w AS (SELECT f.recording, pair, f.channel, win, sample, value FROM filtered f JOIN ch ON f.recording = ch.recording AND f.channel = ch.channel, range(1, {(N - SIZE) // STEP + 2}) r(win) WHERE sample BETWEEN (win - 1) * {STEP} + 1 AND (win - 1) * {STEP} + {SIZE}),
      i AS (SELECT *, stddev_samp(value) OVER ({part}) AS sd, max(abs(value)) OVER ({part}) AS most FROM w),
      u AS (SELECT *, value / sd AS v FROM i WHERE sd > {kernels.ROOT_EPS!r} * greatest(1, most)),
      c AS (SELECT x.recording, x.pair, x.win, x.sample - y.sample + {SIZE - 1} AS n, sum(x.v * y.v) / {SIZE} AS c FROM u x JOIN u y ON x.recording = y.recording AND x.pair = y.pair AND x.win = y.win AND x.channel < y.channel GROUP BY 1, 2, 3, 4),
      h AS (SELECT recording, pair, win, n, (c - avg(c) OVER (PARTITION BY recording, pair, win)) * (0.54 - 0.46 * cos(2 * pi() * n / {n - 1})) AS v FROM c),
      p AS (SELECT recording, pair, win, k, (pow(sum(v * cos(2 * pi() * k * n / {n})), 2) + pow(sum(v * sin(2 * pi() * k * n / {n})), 2)) * CASE k WHEN 0 THEN 1 ELSE 2 END AS p FROM h, range(0, {SIZE}) r(k) GROUP BY 1, 2, 3, 4),
      peak AS (SELECT recording, pair, win, max(p) / ({FS} * (SELECT sum(pow(0.54 - 0.46 * cos(2 * pi() * j / {n - 1}), 2)) FROM range(0, {n}) r(j))) AS score FROM p GROUP BY 1, 2, 3)
      SELECT DISTINCT w.recording, w.channel, w.win::INT AS "window", round(coalesce(score, 0), 6) + 0.0 AS score FROM w LEFT JOIN peak ON w.recording = peak.recording AND w.pair = peak.pair AND w.win = peak.win"""


@query(_peak_power_sql())
def peak_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.peak_power(rec.vector_samples(spark, sf_dir), rec.vector_channels(spark, sf_dir), FS, N, SIZE, STEP), 6)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_core(spark, sf_dir), "coupling", -0.3)


JUDGED = f"WITH {CORE}, j AS (SELECT *, score >= -0.3 AS ok FROM scored), c AS (SELECT recording, channel, pair, bool_and(ok) AS passed, 'coupling' AS metrics, coalesce(string_agg(CASE WHEN NOT ok THEN 'coupling:w' || lpad(win::VARCHAR, 4, '0') END, ';' ORDER BY win), '') AS failed_windows FROM j GROUP BY 1, 2, 3)"


@query(f"{JUDGED} SELECT recording, channel, passed, metrics, failed_windows FROM c")
def prune_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.prune(_judged(spark, sf_dir), rec.vector_channels(spark, sf_dir), "mark")


@query(f"{JUDGED} SELECT recording, channel, passed, metrics, failed_windows FROM c QUALIFY bool_and(passed) OVER (PARTITION BY recording, pair)")
def prune_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.prune(_judged(spark, sf_dir), rec.vector_channels(spark, sf_dir), "drop")


@query(f"""WITH {CORE.replace("range(1, 4)", "range(1, 2)").replace("+ 32)", "+ 64)")}, {SNR.removeprefix(f"{VEC}, ")},
      j AS (SELECT recording, channel, pair, s.score >= -0.3 AS a, n.score >= -1.5 AS b FROM scored s JOIN snr n USING (recording, channel)
        UNION ALL SELECT ch.recording, ch.channel, ch.pair, NULL, n.score >= -1.5 FROM ch JOIN snr n ON n.recording = ch.recording AND n.channel = ch.channel ANTI JOIN scored s ON s.recording = ch.recording AND s.channel = ch.channel)
      SELECT recording, channel, coalesce(a, false) AND b AS passed, 'coupling,snr' AS metrics, concat_ws(';', CASE WHEN NOT coalesce(a, false) THEN 'coupling:w0001' END, CASE WHEN NOT b THEN 'snr:w0001' END) AS failed_windows FROM j""")
def prune_two_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupling and signal to noise over whole recordings; a channel without a partner has no coupling and scores 0 less than the bound."""
    channels = rec.vector_channels(spark, sf_dir)
    found = quality.coupling(rec.vector_samples(spark, sf_dir), channels, N, N, N)
    alone = channels.join(found, ["recording", "channel"], "left_anti").select("recording", "channel", F.lit(1).alias("window"), F.lit(-1.0).alias("score"))
    both = quality.judged(found.unionByName(alone), "coupling", -0.3).unionByName(quality.judged(_snr(spark, sf_dir), "snr", -1.5))
    return quality.prune(both, channels, "mark")


@query(f"{JUDGED} SELECT 'coupling' AS metric, count(DISTINCT (recording, channel)) AS channels, count(DISTINCT win) AS windows, count(*) FILTER (ok) AS passed, count(*) AS scored FROM j")
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(_judged(spark, sf_dir))


@query("""SELECT recording, measurement_index, base || CASE WHEN count(*) OVER (PARTITION BY recording, base) > 1 THEN '_T1I' || data_type_index || 'M' || measurement_index ELSE '' END AS channel_label
          FROM (SELECT l_orderkey AS recording, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS measurement_index,
                       'S' || (l_suppkey % 3 + 1) || '_D' || (l_partkey % 2 + 1) || '_' || CASE WHEN l_linenumber % 2 = 0 THEN 760 ELSE 850 END AS base, l_linenumber AS data_type_index FROM lineitem)""")
def measurement_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = rec.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("recording"), F.row_number().over(line).alias("measurement_index"), (F.col("l_suppkey") % 3 + 1).alias("source_index"), (F.col("l_partkey") % 2 + 1).alias("detector_index"),
        F.when(F.col("l_linenumber") % 2 == 0, 760).otherwise(850).alias("wavelength_nm"), F.lit(1).alias("data_type"), F.col("l_linenumber").alias("data_type_index"),
        F.lit(None).cast("string").alias("source_label"), F.lit(None).cast("string").alias("detector_label"),
    )
    return measurements.labels(measurements.checked(rows)).select("recording", "measurement_index", "channel_label")


@query("""WITH m AS (SELECT l_orderkey AS recording, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::INT AS measurement_index,
                       l_suppkey % 3 + 1 AS s, l_partkey % 2 + 1 AS d, l_linenumber % 3 + 1 AS w FROM lineitem),
           f AS (SELECT *, min(measurement_index) OVER (PARTITION BY recording, s, d) AS first FROM m)
           SELECT recording, measurement_index, dense_rank() OVER (PARTITION BY recording ORDER BY first)::BIGINT AS pair, 'S' || s || '_D' || d AS channel_id, [690, 760, 850][w]::DOUBLE AS wavelength_nm FROM f""")
def pairs_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = rec.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("recording"), F.row_number().over(line).alias("measurement_index"), (F.col("l_suppkey") % 3 + 1).alias("source_index"),
        (F.col("l_partkey") % 2 + 1).alias("detector_index"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("wavelength_index"),
    )
    table = rows.select("recording").distinct().select("recording", F.posexplode(F.array(*map(F.lit, (690.0, 760.0, 850.0)))).alias("at", "wavelength_nm")).select("recording", (F.col("at") + 1).alias("wavelength_index"), "wavelength_nm")
    found = measurements.pairs(measurements.checked(measurements.with_wavelengths(rows, table)))
    return found.select("recording", "measurement_index", "pair", "channel_id", "wavelength_nm")


@query("""SELECT recording, onset, duration, type, value, row_number() OVER (PARTITION BY recording ORDER BY onset, stim_index, "row")::INT AS position
          FROM (SELECT user_id AS recording, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS stim_index, event_id AS "row", (event_id % 100) / 10.0 AS onset, 0.5::DOUBLE AS duration, event_type AS type, value::DOUBLE AS value FROM events)""")
def stim_events_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    data = F.array(((F.col("event_id") % 100) / 10.0).cast("double"), F.lit(0.5), F.col("value").cast("double"))
    rows = rec.table(spark, sf_dir, "events").select(F.col("user_id").alias("recording"), kind.alias("stim_index"), F.col("event_id").alias("row"), F.col("event_type").alias("name"), data.alias("data"))
    return measurements.events(rows).select("recording", "onset", "duration", "type", "value", "position")


@query("""WITH e AS (SELECT user_id AS recording, event_id AS id, (event_id % 100) / 10.0 AS onset, 0.5::DOUBLE AS duration, event_type AS type, value::DOUBLE AS value, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AS stim FROM events),
      c AS (SELECT DISTINCT recording FROM e WHERE id % 97 = 0),
      n AS (SELECT recording, onset, duration, type, value + CASE WHEN id % 97 = 0 THEN 1 ELSE 0 END AS value FROM e SEMI JOIN c USING (recording)),
      p AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY onset, type, duration, value) AS place FROM n),
      f AS (SELECT *, min(place) OVER (PARTITION BY recording, type) AS first FROM p)
      SELECT recording, dense_rank() OVER (PARTITION BY recording ORDER BY first)::INT AS stim_index, row_number() OVER (PARTITION BY recording, type ORDER BY place)::BIGINT AS "row", type AS name, onset AS start, value, 3 AS numbers FROM f
      UNION ALL SELECT recording, stim, id, type, onset, value, 4 FROM e ANTI JOIN c USING (recording)""")
def stimuli_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored stimuli with an extra column; events of every 97th row were edited since."""
    kind = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    onset, value = ((F.col("event_id") % 100) / 10.0).cast("double"), F.col("value").cast("double")
    rows = rec.table(spark, sf_dir, "events")
    stored = rows.select(F.col("user_id").alias("recording"), kind.alias("stim_index"), F.col("event_id").alias("row"), F.col("event_type").alias("name"), F.array(onset, F.lit(0.5), value, F.lit(7.0)).alias("data"), F.lit(None).cast("array<string>").alias("data_labels"))
    now = rows.select(F.col("user_id").alias("recording"), onset.alias("onset"), F.lit(0.5).alias("duration"), F.col("event_type").alias("type"), (value + F.when(F.col("event_id") % 97 == 0, 1.0).otherwise(0.0)).alias("value"))
    out, _ = preparation.stimuli(now, stored)
    return out.select("recording", "stim_index", "row", "name", F.col("data")[0].alias("start"), F.col("data")[2].alias("value"), F.size("data_labels").alias("numbers"))


@query(f"""WITH {EV}, t AS (SELECT recording, channel, sample, CASE WHEN channel % 5 = 0 AND sample = 3 THEN 0.25 ELSE (sample - 1) / 10.0 END::DOUBLE AS t FROM ev),
      d AS (SELECT recording, channel, t - lag(t) OVER (PARTITION BY recording, channel ORDER BY sample) AS d FROM t), m AS (SELECT recording, channel, d, median(d) OVER (PARTITION BY recording, channel) AS s FROM d WHERE d IS NOT NULL)
      SELECT recording, channel, round(any_value(s), 9) AS step_seconds, min(d) > 0 AND max(abs(d - s)) <= greatest(1e-12, 1e-9 * any_value(s)) AS uniform FROM m GROUP BY 1, 2""")
def uniform_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when((F.col("channel") % 5 == 0) & (F.col("sample") == 3), 0.25).otherwise((F.col("sample") - 1) / 10.0)
    return _rounded(measurements.uniform_step(rec.event_samples(spark, sf_dir).withColumn("t", t)))


#: The first and the last channels of each wavelength; together they are all channels of a recording.
REGIONS = {f"{side}_{nm}": tuple(range(first + at, first + rec.CHANNELS // 2, 2)) for at, nm in enumerate((760, 850)) for side, first in (("left", 0), ("right", rec.CHANNELS // 2))}
PLAN = Plan(fs=FS, regions=REGIONS, contrast={f"lateral_{nm}": {**dict.fromkeys(REGIONS, 0.0), f"left_{nm}": 1.0, f"right_{nm}": -1.0} for nm in (760, 850)}, baseline_seconds=2.0, update_seconds=0.2, smoothing_seconds=0.4)


#: In closed form: chunks of two samples, a baseline of the first 20, and from sample 22 on an update with every chunk.
@query(f"""WITH {VEC}, able AS (SELECT recording FROM vec GROUP BY 1 HAVING count(DISTINCT channel) = {rec.CHANNELS}),
      v AS (SELECT recording, sample, CASE WHEN channel % 2 = 0 THEN 'lateral_760' ELSE 'lateral_850' END AS target, avg(value) FILTER (channel < 12) - avg(value) FILTER (channel >= 12) AS v FROM vec JOIN able USING (recording) GROUP BY 1, 2, 3),
      b AS (SELECT recording, target, avg(v) AS b FROM v WHERE sample <= 20 GROUP BY 1, 2),
      m AS (SELECT *, (v / 2 + lag(v) OVER w + lag(v, 2) OVER w + lag(v, 3) OVER w + lag(v, 4) OVER w / 2) / 4 AS mean FROM v WINDOW w AS (PARTITION BY recording, target ORDER BY sample))
      SELECT recording::VARCHAR AS stream, (sample - 22) // 2 AS sequence, round((sample - 1) / 10.0, 6) + 0.0 AS "time", round(2.0 + (sample - 22) / 10.0, 6) + 0.0 AS scheduled, target, round(mean - b, 6) + 0.0 AS value,
             NULL::VARCHAR AS skipped, 0::BIGINT AS skipped_count FROM m JOIN b USING (recording, target) WHERE sample >= 22 AND sample % 2 = 0
      UNION ALL SELECT recording::VARCHAR, NULL, NULL, NULL, NULL, NULL, 'missing_channels', {rec.CHANNELS} - count(DISTINCT channel) FROM vec GROUP BY recording HAVING count(DISTINCT channel) < {rec.CHANNELS}""")
def feedback_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = rec.vector_samples(spark, sf_dir).groupBy("recording", "sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda s: s["value"]).alias("channels"))
    return _rounded(replay(packed.select(F.col("recording").cast("string").alias("stream"), ((F.col("sample") - 1) / FS).alias("t"), "channels"), PLAN, missing="skip"), 6)
