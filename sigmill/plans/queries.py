"""The operators as queries on the driver's tables, each with SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import detectors as D
from ..operators import framing, onsets, projection, segments, spectral, stats
from .tables import DAY, LENGTH, points, table, vectors
from .tables import onsets as onset_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _off(n: int) -> float:
    return float(f"3e-{n + 2}")


def r(x, n: int = 6):
    """Rounded to n places, without a negative zero. Means of few decimals often end on half of the last
    place, where two engines' last bits decide: a shift by 3 % of that place moves them off it."""
    return F.round((F.col(x) if isinstance(x, str) else x) + F.lit(_off(n)), n) + F.lit(0.0)


def sr(x: str, n: int = 6) -> str:
    return f"(round({x} + {_off(n)!r}::double, {n}) + 0::double)"


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.select(*[r(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


# -- statistics ---------------------------------------------------------------------------------

MOMENTS = "with m as (select user_id, event_type, avg(value) mu from events group by all), d as (select user_id, event_type, value - mu x from events join m using (user_id, event_type)) "


def _by_type(spark, sf_dir, x):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(r(x).alias("x"))


@query(f"select user_id, event_type, {sr('avg(value)')} as x from events group by all")
def q_event_mean(spark, sf_dir):
    return _by_type(spark, sf_dir, stats.mean("value"))


@query(f"select user_id, event_type, {sr('median(value)')} as x from events group by all")
def q_event_median(spark, sf_dir):
    return _by_type(spark, sf_dir, stats.median("value"))


@query(f"select user_id, event_type, {sr('var_pop(value)', 4)} as x from events group by all")
def q_event_variance(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(r(F.var_pop("value"), 4).alias("x"))


@query(MOMENTS + f"select user_id, event_type, {sr('avg(x*x*x)/nullif(power(avg(x*x), 1.5), 0)')} as x from d group by user_id, event_type")
def q_event_skewness(spark, sf_dir):
    return _by_type(spark, sf_dir, F.skewness("value"))


@query(MOMENTS + f"select user_id, event_type, {sr('avg(x*x*x*x)/nullif(power(avg(x*x), 2), 0) - 3')} as x from d group by user_id, event_type")
def q_event_kurtosis(spark, sf_dir):
    return _by_type(spark, sf_dir, F.kurtosis("value"))


@query(f"select user_id, {sr('sum(value*exp(value*0.05::double))/sum(exp(value*0.05::double))')} as x from events group by all")
def q_weighted_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(r(stats.weighted_mean("value", stats.weight("value", 0.05))).alias("x"))


BINS = "with v as (select vec_id, label, unnest(range(len(embedding))) bin, unnest(embedding)::double x from embeddings) "


@query(BINS + f"select bin::int as bin, {sr('min(x)')} as low, {sr('max(x)')} as high from v group by bin")
def q_dim_range(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.posexplode("frame").alias("bin", "x"))
    return rounded(stats.dimension_range(rows, "x", ["bin"]), "low", "high")


@query(BINS + f"select bin::int as bin, {sr('1/nullif(greatest(abs(min(x)), abs(max(x))), 0)')} as multiplier from v group by bin")
def q_norm_multiplier(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.posexplode("frame").alias("bin", "x"))
    return rounded(stats.normalization_multiplier(rows, "x", ["bin"]), "multiplier")


@query(BINS + f"select label, bin::int as bin, {sr('median(x)')} as value from v group by all")
def q_binwise_stat(spark, sf_dir):
    return rounded(stats.binwise(vectors(spark, sf_dir), "frame", stats.median, ["label"]), "value")


@query(BINS + f"select bin::int as bin, count(*) as n, {sr('arg_min(x, vec_id)')} as first, {sr('arg_max(x, vec_id)')} as last from v group by bin")
def q_transpose(spark, sf_dir):
    out = stats.transpose(vectors(spark, sf_dir), "frame", "vec_id")
    return out.select("bin", F.size("column").cast("long").alias("n"), r(F.col("column")[0]).alias("first"), r(F.element_at("column", -1)).alias("last"))


#: Places of the variances; small numbers need more.
PLACES = {"price": 0, "discount": 8, "tax": 8}
LINE = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}


def _line(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *[F.col(c).alias(n) for n, c in LINE.items()])
    return stats.event_statistics(rows, ["l_orderkey"], list(LINE))


def _line_sql():
    mu = ", ".join(f"avg({c}) mu_{n}" for n, c in LINE.items())
    d = ", ".join(f"{c} as {n}, {c} - mu_{n} as d_{n}" for n, c in LINE.items())
    out = []
    for n in LINE:
        v, x = f"avg(d_{n}*d_{n})", f"d_{n}"
        out += [f"{sr(f'avg({n})')} as {n}_mean", f"{sr(f'median({n})')} as {n}_median", f"{sr(v, PLACES.get(n, 2))} as {n}_variance"]
        out += [f"case when {v} > 1e-9 then {sr(f'avg({x}*{x}*{x})/power({v}, 1.5)', 4)} end as {n}_skewness", f"case when {v} > 1e-9 then {sr(f'avg({x}*{x}*{x}*{x})/power({v}, 2) - 3', 4)} end as {n}_kurtosis"]
    return f"with m as (select l_orderkey, {mu} from lineitem group by l_orderkey), d as (select l_orderkey, {d} from lineitem join m using (l_orderkey)) select l_orderkey, {', '.join(out)} from d group by l_orderkey"


@query(_line_sql())
def q_event_timbre_stats(spark, sf_dir):
    e, out = _line(spark, sf_dir), []
    for n in LINE:
        for s in stats.STATISTICS:
            x = r(F.col(f"{n}.{s}"), PLACES.get(n, 2) if s == "variance" else 4 if s in ("skewness", "kurtosis") else 6)
            out.append((F.when(F.col(f"{n}.variance") > 1e-9, x) if s in ("skewness", "kurtosis") else x).alias(f"{n}_{s}"))
    return e.select("l_orderkey", *out)


@query(f"select l_orderkey, {sr('median(l_quantity)')} as quantity, {sr('median(l_tax)')} as tax from lineitem group by all")
def q_project_statistic(spark, sf_dir):
    return rounded(stats.project(_line(spark, sf_dir), ["l_orderkey"], ["quantity", "tax"], "median"), "quantity", "tax")


@query(" union all ".join(f"select l_orderkey, '{n}' as feature, {sr(f'avg({c})')} as mean, {sr(f'median({c})')} as median from lineitem group by l_orderkey" for n, c in LINE.items()))
def q_feature_long_form(spark, sf_dir):
    out = stats.long_form(_line(spark, sf_dir), ["l_orderkey"], list(LINE)).select("l_orderkey", "feature", "mean", "median")
    return rounded(out, "mean", "median")


@query("select event_id, value from events where value between 50 and 200")
def q_feature_range_filter(spark, sf_dir):
    return stats.in_range(table(spark, sf_dir, "events"), "value", 50, 200).select("event_id", "value")


@query(f"select event_id, {sr('cume_dist() over (partition by event_type order by value)')} as equalized from events")
def q_hist_equalize(spark, sf_dir):
    return rounded(stats.equalize_histogram(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_id", "equalized"), "equalized")


@query("select event_id, value from events order by ts limit 100")
def q_truncate(spark, sf_dir):
    return stats.truncate(table(spark, sf_dir, "events"), "ts", 100).select("event_id", "value")


# -- onsets -------------------------------------------------------------------------------------

U, GAP5, GAP10 = ["user_id"], 5 * DAY, 10 * DAY
E = "e as (select user_id, (epoch_us(ts) - 1704067200000000)::double / 1e6 as s, value from events)"


def _lists(gap: float) -> str:
    return f"""{E}, l as (select user_id, list(s order by s) o from e where s <= {LENGTH} - {gap} group by user_id),
k as (select user_id, case when len(o) < 2 then o else list_reduce(list_transform(o, lambda x: [x]), lambda p, q: case when q[1] - p[-1] >= {gap} then list_concat(p, q) else p end) end as o from l)"""


def _filled(gap: float, least: int = 4) -> str:
    """Recursive: f holds lists of at least `least`."""
    gaps = "list_transform(range(1, len(o)), lambda j: o[j + 1] - o[j])"
    p = f"list_position({gaps}, list_max({gaps}))"
    return f"""with recursive {_lists(gap)}, g as (select user_id, o from k union all
select user_id, case when len(o) = 1 then [o[1], (o[1] + {LENGTH}) / 2] else list_concat(o[1:{p}], [(o[{p}] + o[{p} + 1]) / 2], o[{p} + 1:]) end from g where len(o) < {least}),
f as (select user_id, o from g where len(o) >= {least})"""


_rows = "select user_id, (i - 1)::int as event_idx, {x} from (select user_id, o, unnest(range(1, len(o) + 1)) i from {t})"


@query("""with s as (select s_suppkey, abs(s_acctbal) / 1000 as length from suppliers_), n as (select s_suppkey, floor(length / (0.05::float)::double)::int n from s)
select s_suppkey, i::int as event_idx, (round((i::float * 0.05::float)::double + 3e-8::double, 6) + 0::double) as onset_s from (select s_suppkey, unnest(range(n)) i from n)""".replace("suppliers_", "supplier"))
def q_uniform_onsets(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 1000).alias("length"))
    return rounded(onsets.uniform_grid(s, ["s_suppkey"], "length"), "onset_s")


@query(f"with {E} select user_id, {sr('s')} as onset_s from e where s <= {LENGTH} - {GAP5}")
def q_tail_filter(spark, sf_dir):
    return rounded(onsets.tail_filter(onset_rows(spark, sf_dir), LENGTH, GAP5), "onset_s")


def _deduped(spark, sf_dir, gap=GAP5):
    return onsets.min_gap_dedup(onset_rows(spark, sf_dir), U, gap, LENGTH)


@query(f"with {_lists(GAP5)} " + _rows.format(x=sr("o[i]") + " as onset_s", t="k"))
def q_min_gap_dedup(spark, sf_dir):
    return rounded(_deduped(spark, sf_dir), "onset_s")


@query(f"with {E}, n as (select user_id, s, lead(s, 1, {LENGTH}) over (partition by user_id order by s) e from e), k as (select *, case when e - s > {DAY} then 3 else 0 end k from n) "
       f"select user_id, {sr(f's + (e - s) * i / (k + 1)')} as onset_s from (select *, unnest(range(k + 1)) i from k)")  # fmt: skip
def q_subdivide_gap(spark, sf_dir):
    k = F.when(F.col("gap") > DAY, 3).otherwise(0)
    return rounded(onsets.subdivide_gaps(onset_rows(spark, sf_dir), U, k, LENGTH), "onset_s")


@query(_filled(GAP10) + " " + _rows.format(x=sr(f"o[i]") + " as onset_s", t="f"))
def q_min_count_fill(spark, sf_dir):
    return rounded(onsets.min_count_fill(_deduped(spark, sf_dir, GAP10).select("user_id", "onset_s"), U, 4, LENGTH), "onset_s")


@query(f"with {E}, n as (select user_id, s, lead(s) over (partition by user_id order by s) - s g from e), q as (select *, quantile_cont(g, 0.25) over w q1, quantile_cont(g, 0.5) over w q2, quantile_cont(g, 0.75) over w q3 from n window w as (partition by user_id)), "
       f"k as (select *, coalesce(case when g > q3 + 1.5::double * (q3 - q1) then greatest(0, floor(g / q2)::int - 1) else 0 end, 0) k from q) "
       f"select user_id, {sr(f's + coalesce(g, 0) * i / (k + 1)')} as onset_s from (select *, unnest(range(k + 1)) i from k)")  # fmt: skip
def q_iqr_gap_equalize(spark, sf_dir):
    return rounded(onsets.equalize_density(onset_rows(spark, sf_dir), U, LENGTH), "onset_s")


@query(f"with {E}, n as (select user_id, s, lead(s) over (partition by user_id order by s) - s g from e) select user_id, {sr('s')} as s, {sr('g')} as gap from n where g is not null qualify row_number() over (partition by user_id order by g desc, s) = 1")
def q_largest_gap(spark, sf_dir):
    return rounded(onsets.largest_gap(onset_rows(spark, sf_dir), U), "s", "gap")


@query(f"with {E} select user_id, {sr('s')} as onset_s, {sr(f's / {LENGTH}')} as onset_norm from e")
def q_normalize_onsets(spark, sf_dir):
    return rounded(onsets.normalize(onset_rows(spark, sf_dir), LENGTH), "onset_s", "onset_norm")


@query(f"with {E} select user_id, {sr('s')} as onset_s from e")
def q_denormalize_onsets(spark, sf_dir):
    n = onsets.normalize(onset_rows(spark, sf_dir), LENGTH).drop("onset_s")
    return rounded(onsets.denormalize(n, LENGTH).select("user_id", "onset_s"), "onset_s")


@query(_filled(GAP10) + " " + _rows.format(x=f"{sr(f'o[i]')} as onset_s, {sr(f'o[i] / {LENGTH}')} as onset_norm", t="f"))
def q_onset_pipeline(spark, sf_dir):
    return rounded(onsets.pipeline(onset_rows(spark, sf_dir), U, LENGTH, GAP10, 4), "onset_s", "onset_norm")


@query(f"with {E}, n as (select user_id, count(*) n from e group by user_id) select user_id, n from n qualify row_number() over (order by n desc, user_id) = 1")
def q_longest(spark, sf_dir):
    n = onset_rows(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.agg(F.max(F.struct("n", (-F.col("user_id")).alias("u"))).alias("b")).select((-F.col("b.u")).alias("user_id"), F.col("b.n").alias("n"))


# -- events -------------------------------------------------------------------------------------

BOUNDS = f"{_lists(GAP5)}, x as (select user_id, (i - 1)::int event_idx, o[i] as start_s, coalesce(o[i + 1], {LENGTH}) as end_s from (select user_id, o, unnest(range(1, len(o) + 1)) i from k))"
ASSIGNED = BOUNDS + ", a as (select e.user_id, x.event_idx, e.s, e.value from e join x on e.user_id = x.user_id and e.s >= x.start_s and e.s < x.end_s)"


def _bounds(spark, sf_dir):
    return segments.bounds(_deduped(spark, sf_dir), U, LENGTH)


def _assigned(spark, sf_dir):
    return segments.assign(points(spark, sf_dir).withColumn("s", F.col("t")), _bounds(spark, sf_dir), U, "t")


@query(f"with {BOUNDS} select user_id, event_idx, {sr('start_s')} as start_s, {sr('end_s')} as end_s from x")
def q_event_bounds(spark, sf_dir):
    return rounded(_bounds(spark, sf_dir), "start_s", "end_s")


@query(f"with {ASSIGNED} select user_id, event_idx, {sr('s')} as s, value from a")
def q_event_assign(spark, sf_dir):
    return rounded(_assigned(spark, sf_dir).select("user_id", "event_idx", "s", "value"), "s")


_T = "greatest(avg(d*d), 0)"


@query(f"""with {ASSIGNED}, m as (select user_id, event_idx, avg(value) mu from a group by all), d as (select user_id, event_idx, value, value - mu as d from a join m using (user_id, event_idx))
select user_id, event_idx, count(*) as n_frames, {sr('avg(value)', 4)} as mean, {sr('median(value)', 4)} as median, {sr('avg(d*d)', 3)} as variance,
case when avg(d*d) > 1e-9 then {sr('avg(d*d*d)/power(avg(d*d), 1.5)', 4)} end as skewness, case when avg(d*d) > 1e-9 then {sr('avg(d*d*d*d)/power(avg(d*d), 2) - 3', 4)} end as kurtosis from d group by user_id, event_idx""")
def q_timbre_space(spark, sf_dir):
    """The flagship: onsets, minimum gap, event bounds, assignment, statistics per event."""
    out = _assigned(spark, sf_dir).groupBy("user_id", "event_idx").agg(F.count("*").alias("n_frames"), stats.statistics("value").alias("x"))
    moment = lambda s: F.when(F.col("x.variance") > 1e-9, r(F.col(f"x.{s}"), 4)).alias(s)
    return out.select("user_id", "event_idx", "n_frames", r("x.mean", 4).alias("mean"), r("x.median", 4).alias("median"), r("x.variance", 3).alias("variance"), moment("skewness"), moment("kurtosis"))


def _fade_sql(n: str, i: str = "i", a: int = 5, b: int = 5) -> str:
    return f"x * case when {i} < least({a}, {n}) then {i}::double / least({a}, {n}) else 1 end * case when {n} - 1 - {i} < least({b}, {n}) then ({n} - 1 - {i})::double / least({b}, {n}) else 1 end"


@query(BINS + f"select vec_id, bin::int as i, {sr(_fade_sql('64', 'bin'))} as x from v")
def q_fade(spark, sf_dir):
    out = vectors(spark, sf_dir).select("vec_id", F.posexplode(segments.fade("frame", 5, 5)).alias("i", "x"))
    return rounded(out, "x")


@query(BINS + f"select vec_id, (bin // 16)::int as event_idx, (bin % 16)::int as i, {sr(_fade_sql('16', '(bin % 16)'))} as x from v")
def q_split_events(spark, sf_dir):
    v = vectors(spark, sf_dir).select("vec_id", "frame", F.lit(64.0).alias("rate"))
    on = v.select("vec_id", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75)))).alias("onset_s"))
    out = segments.split(v, segments.bounds(on, ["vec_id"], 63 / 64), ["vec_id"], "frame", "rate")
    return rounded(out.select("vec_id", "event_idx", F.posexplode("samples").alias("i", "x")), "x")


# -- frames and spectra -------------------------------------------------------------------------


@query(BINS + f", f as (select unnest(range(7)) f), j as (select unnest(range(16)) j), g as (select distinct vec_id from v) select g.vec_id, f::int as frame_idx, j::int as i, {sr('coalesce(x, 0)')} as x from g cross join f cross join j left join v on v.vec_id = g.vec_id and v.bin = f * 8 + j")
def q_frames(spark, sf_dir):
    out = framing.frames(vectors(spark, sf_dir), ["vec_id"], "frame", 16, 8)
    return rounded(out.select("vec_id", "frame_idx", F.posexplode("frame").alias("i", "x")), "x")


@query(BINS + f"select vec_id, bin::int as i, {sr('x * (0.5::double - 0.5::double * cos(2 * pi() * bin / 63))')} as x from v")
def q_window_taper(spark, sf_dir):
    return rounded(vectors(spark, sf_dir).select("vec_id", F.posexplode(framing.weighted("frame", "hann", 64)).alias("i", "x")), "x")


DFT = BINS + """, b as (select unnest(range(33)) k), z as (select vec_id, label, k, sum(x * cos(2 * pi() * ((bin * k) % 64) / 64)) re, -sum(x * sin(2 * pi() * ((bin * k) % 64) / 64)) im from v cross join b group by all),
p as (select vec_id, label, k, re * re + im * im as p, sqrt(re * re + im * im) as m, atan2(im, re) as a from z) """


def _spectra(spark, sf_dir, kind="power"):
    return framing.spectra(vectors(spark, sf_dir), ["vec_id", "label"], "frame", kind)


@query(DFT + f"select vec_id, k::int as bin, {sr('p')} as power from p")
def q_power_spectrum(spark, sf_dir):
    return rounded(_spectra(spark, sf_dir).select("vec_id", F.posexplode("spectrum").alias("bin", "power")), "power")


@query(DFT + f"select vec_id, k::int as bin, {sr('p')} as power from p")
def q_power_spectrum_relational(spark, sf_dir):
    out = framing.relational_power(vectors(spark, sf_dir), ["vec_id"], "frame", 64)
    return rounded(out, "power")


@query(DFT + f"select vec_id, k::int as bin, {sr('m')} as magnitude from p")
def q_magnitude_spectrum(spark, sf_dir):
    return rounded(_spectra(spark, sf_dir, "magnitude").select("vec_id", F.posexplode("spectrum").alias("bin", "magnitude")), "magnitude")


@query(DFT + f"select vec_id, k::int as bin, {sr('m * cos(a)')} as re, {sr('m * sin(a)')} as im from p")
def q_polar_spectrum(spark, sf_dir):
    z = framing.polar_spectra(vectors(spark, sf_dir), ["vec_id"], "frame")
    z = z.select("vec_id", F.posexplode(F.arrays_zip("mag", "phase")).alias("bin", "z"))
    return z.select("vec_id", "bin", r(F.col("z.mag") * F.cos("z.phase")).alias("re"), r(F.col("z.mag") * F.sin("z.phase")).alias("im"))


def _feature(spark, sf_dir, x, n=6):
    return _spectra(spark, sf_dir).select("vec_id", r(x, n).alias("x"))


@query(DFT + f"select vec_id, {sr('sum(p * k * 22050.0::double / 32) / nullif(sum(p), 0)', 4)} as x from p group by vec_id")
def q_spectral_centroid(spark, sf_dir):
    return _feature(spark, sf_dir, spectral.centroid("spectrum", 22050.0), 4)


@query(DFT + f"select vec_id, {sr('regr_slope(p, k * 22050.0::double / 32)', 9)} as x from p group by vec_id")
def q_spectral_decrease(spark, sf_dir):
    return _feature(spark, sf_dir, spectral.decrease("spectrum", 22050.0), 9)


@query(DFT + f"select vec_id, {sr('case when avg(p) <= 0 then null when min(p) <= 0 then 1 else greatest(0, least(1, log10(exp(avg(ln(case when p > 0 then p end))) / avg(p)) / -6)) end')} as x from p group by vec_id")
def q_spectral_flatness(spark, sf_dir):
    return _feature(spark, sf_dir, spectral.flatness("spectrum"))


@query(DFT + f"select vec_id, {sr('max(p) / nullif(avg(p), 0)')} as x from p group by vec_id")
def q_spectral_crest(spark, sf_dir):
    return _feature(spark, sf_dir, spectral.crest("spectrum"))


@query(DFT + f", n as (select *, lag(p) over w b, lead(p) over w c from p window w as (partition by vec_id order by k)) select vec_id, {sr('count(*) filter (p > b and p >= c and p > 0.005::double)')} as x from n group by vec_id")
def q_spectral_complexity(spark, sf_dir):
    return _feature(spark, sf_dir, spectral.complexity("spectrum"))


@query(DFT + """, t as (select vec_id, max(p) mx, arg_min(k, (-p, k)) kk from p group by vec_id), l as (select p.vec_id, mx, kk,
coalesce(max(k) filter (k < kk and p < mx / 2), -1) + 1 as a, coalesce(min(k) filter (k > kk and p < mx / 2), 33) - 1 as b from p join t using (vec_id) group by all)
select vec_id, (round(mx / log10((b + 2)::double / (a + 1)) + 3e-6::double, 4) + 0::double) as x from l""")
def q_strong_peak(spark, sf_dir):
    out = framing.map_frames(_spectra(spark, sf_dir), ["vec_id"], "spectrum", {"x": "double"}, lambda m: {"x": K.strong_peak(m)})
    return rounded(out, "x", n=4)


RATE = 8000.0
BANDS = 20
BARK = DFT + f""", e0 as (select unnest(range({BANDS + 2})) i), lo as (select 26.81::double * 500 / 2460 - 0.53::double as a, 26.81::double * 4000 / 5960 - 0.53::double as b),
e1 as (select i, a + (b - a) * i / {BANDS + 1} as z from e0 cross join lo), f as (select k, 26.81::double * (k * 125.0::double) / (1960 + k * 125.0::double) - 0.53::double as z from b),
t as (select x.i as band, f.k, greatest(0, least((f.z - x.z) / (y.z - x.z), (w.z - f.z) / (w.z - y.z))) as w from e1 x join e1 y on y.i = x.i + 1 join e1 w on w.i = x.i + 2 cross join f),
n as (select band, k, w / case when sum(w) over (partition by band) > 0 then sum(w) over (partition by band) else 1 end as w from t),
bb as (select vec_id, band, sum(p * w) as e from p join n using (k) group by all) """
_BANK = {"bands": BANDS, "low": 500.0, "high": 4000.0}


@query(BARK + f"select vec_id, band::int as band, {sr('e', 5)} as energy from bb")
def q_bark_bands(spark, sf_dir):
    out = spectral.bark_bands(_spectra(spark, sf_dir), ["vec_id"], "spectrum", RATE, **_BANK)
    return rounded(out.select("vec_id", F.posexplode("bands").alias("band", "energy")), "energy", n=5)


@query(BARK + f", c as (select unnest(range(13)) c) select vec_id, c::int as coef, {sr(f'sum(10 * log10(greatest(e, 1e-10::double)) * cos(pi() / {BANDS} * (band + 0.5::double) * c) * sqrt(2.0::double / {BANDS}) * case when c = 0 then sqrt(0.5::double) else 1 end)', 4)} as x from bb cross join c group by all")
def q_bfcc(spark, sf_dir):
    out = spectral.bfcc(_spectra(spark, sf_dir), ["vec_id"], "spectrum", RATE, **_BANK)
    return rounded(out.select("vec_id", F.posexplode("bfcc").alias("coef", "x")), "x", n=4)


@query(BINS + f"select vec_id, {sr('power(sum(x * x), 0.67::double)')} as x from v group by vec_id")
def q_loudness(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", r(spectral.loudness("frame")).alias("x"))


@query(f"select event_id, {sr('case when hz <= 0 then 0 else 69 + 12 * log2(hz / 440) end')} as midi from (select event_id, case when event_id % 10 = 0 then 0 else value * 10 end::double as hz from events)")
def q_hz_to_midi(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, 0.0).otherwise(F.col("value") * 10).alias("hz"))
    return e.select("event_id", r(spectral.hz_to_midi("hz")).alias("midi"))


# -- detectors: the vectors of a label, by vec_id, are consecutive frames ---------------------------

SEQ = ", q as (select vec_id, label, k, m, a, lag(m) over w m1, lag(a, 1) over w a1, lag(a, 2) over w a2 from p window w as (partition by label, k order by vec_id)) "


def _polar(spark, sf_dir):
    return framing.polar_spectra(vectors(spark, sf_dir), ["vec_id", "label"], "frame")


@query(DFT + f"select vec_id, {sr('sum(m * k)', 4)} as x from p group by vec_id")
def q_onset_hfc(spark, sf_dir):
    return _spectra(spark, sf_dir, "magnitude").select("vec_id", r(D.hfc("spectrum"), 4).alias("x"))


@query(DFT + SEQ + f"select vec_id, {sr('sum(coalesce(greatest(m - m1, 0), 0))', 4)} as x from q group by vec_id")
def q_onset_flux(spark, sf_dir):
    return _spectra(spark, sf_dir, "magnitude").select("vec_id", r(D.flux("spectrum", ["label"], "vec_id"), 4).alias("x"))


@query(BINS + f", m as (select vec_id, label, sqrt(sum(x * x) / 64) e from v group by all) select vec_id, {sr('coalesce(greatest(e - lag(e) over (partition by label order by vec_id), 0), 0)')} as x from m")
def q_onset_rms(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", r(D.rms_rise("frame", ["label"], "vec_id")).alias("x"))


@query(DFT + SEQ + f"select vec_id, {sr('sum(case when a2 is null then 0 else sqrt(greatest(m * m + m1 * m1 - 2 * m * m1 * cos(a - 2 * a1 + a2), 0)) end)', 3)} as x from q group by vec_id")
def q_onset_complex(spark, sf_dir):
    return _polar(spark, sf_dir).select("vec_id", r(D.complex_domain("mag", "phase", ["label"], "vec_id"), 3).alias("x"))


@query(DFT + SEQ + f"select vec_id, {sr('sum(case when a2 is null then 0 else m * acos(greatest(-1, least(1, cos(a - 2 * a1 + a2)))) end)', 3)} as x from q group by vec_id")
def q_onset_complex_phase(spark, sf_dir):
    return _polar(spark, sf_dir).select("vec_id", r(D.complex_phase("mag", "phase", ["label"], "vec_id"), 3).alias("x"))


@query(f"with {_lists(GAP5)} " + f"select user_id, {sr('s')} as onset_s from (select user_id, unnest(o) s from k)")
def q_min_gap_stream(spark, sf_dir):
    return rounded(onsets.min_gap_stream(onsets.tail_filter(onset_rows(spark, sf_dir), LENGTH, GAP5), U, GAP5), "onset_s")


def _frame_no(df):
    return df.withColumn("frame_idx", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)


@query(DFT + """, h as (select vec_id, label, sum(m * k) x, row_number() over (partition by label order by vec_id) - 1 as i from p group by vec_id, label),
t as (select *, median(x) over w + 0.1::double * avg(x) over w as t, lag(x) over o as a, lead(x) over o as b from h window w as (partition by label order by i rows between 5 preceding and current row), o as (partition by label order by i))
select label, i::int as frame_idx, """ + sr("x", 4) + " as x, " + sr("i / (44100.0::double / 512)") + " as onset_s from t where x > coalesce(a, -1) and x >= coalesce(b, -1) and x > t and x > 0.1::double")  # fmt: skip
def q_peak_pick(spark, sf_dir):
    h = _frame_no(_spectra(spark, sf_dir, "magnitude").select("vec_id", "label", D.hfc("spectrum").alias("x")))
    return rounded(rounded(D.peak_pick(h, ["label"], "frame_idx", "x"), "onset_s"), "x", n=4)


@query(DFT + f""", h as (select vec_id, label, sum(m * k) h, sum(m) e from p group by all) select vec_id, {sr('(0.5::double * h / max(h) over (partition by label) + 0.25::double * e / max(e) over (partition by label)) / 0.75::double')} as strength from h""")
def q_detector_mix(spark, sf_dir):
    total = F.expr("aggregate(spectrum, 0D, (s, v) -> s + v)")
    h = _spectra(spark, sf_dir, "magnitude").select("vec_id", "label", D.hfc("spectrum").alias("hfc"), total.alias("energy"), F.lit(0.0).alias("unused"))
    return rounded(D.combine(h, ["label"], ["hfc", "energy", "unused"], [0.5, 0.25, 0.0]).select("vec_id", "strength"), "strength")


# -- projection, change points, conditioning ----------------------------------------------------------


@query(" union all ".join(f"select '{a}' as i, '{b}' as j, {sr(f'covar_pop({LINE[a]}, {LINE[b]})', 4)} as covariance from lineitem" for k, a in enumerate(LINE) for b in list(LINE)[k:]))
def q_covariance(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*[F.col(c).alias(n) for n, c in LINE.items()])
    return rounded(projection.covariance(rows, list(LINE)), "covariance", n=4)


@query(f"select i, {sr('sin(2 * pi() * (100 + 3900 * i::double / 4409) * i / 44100)')} as x from (select unnest(range(4410)) i)")
def q_sweep(spark, sf_dir):
    from ..sources.wave import swept_sine

    return swept_sine(spark, 100.0, 4000.0, 4410).select(F.col("i"), r("x").alias("x"))


@query("select user_id, (epoch_us(time_bucket(interval 6 hours, ts)) - 1704067200000000) // 1000000 as start_s, count(*) as n, (round(avg(value) + 3e-6::double, 4) + 0::double) as mean from events group by all")
def q_stream_windows(spark, sf_dir):
    """The streaming operator's aggregation, on a bounded table."""
    from ..streaming.windows import tumbling

    out = tumbling(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"], None)
    s = F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', window.start)")
    return out.select("user_id", s.alias("start_s"), "n", r("mean", 4).alias("mean"))
