"""The wave operators as queries: synthetic waves made from the table of regions, and the SQL of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import kernels as K
from ..operators import changepoints, conditioning, framing, onsets, projection, segments, spectral, stats
from ..settings import SBic, Settings, nearest_power_of_two, specification
from ..sources import wave as W
from . import wave_sql as Q
from .analyze import prepare, timbre_space
from .queries import BANDS, BARK, BINS, DFT, LINE, RATE, SEQ, D, _line, query, r, rounded, sr, table, vectors
from .run import Run, counted

N, SR, SIZE = 13230, 44100.0, 256
#: Five onsets of the uniform grid lie in 0.3 s; the last event runs to the end.
STARTS = [0, 2205, 4410, 6615, 8820, N]


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal_id, samples): per region two rising partials and a little noise."""
    x = f"(sin(2D * pi() * (220 + 130 * k) * i / 44100) + 0.3D * sin(2D * pi() * (1700 + 310 * k) * i / 44100)) * (0.5D + 0.5D * i / {N}) + 0.01D * sin(cast(i as double) * i * 0.37D + k)"
    out = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("k"))
    return out.select(F.col("k").alias("signal_id"), F.expr(f"transform(sequence(0, {N - 1}), i -> {x})").alias("samples"))


WAVES = f"""w as (select r_regionkey::int as signal_id, i, (sin(2 * pi() * (220 + 130 * r_regionkey) * i / 44100) + 0.3::double * sin(2 * pi() * (1700 + 310 * r_regionkey) * i / 44100)) * (0.5::double + 0.5::double * i / {N}) + 0.01::double * sin(i::double * i * 0.37::double + r_regionkey) as x
from region cross join (select unnest(range({N})) i))"""
EVENTS = (
    WAVES
    + ", b as (select * from (values "
    + ", ".join(f"({k}, {a}, {z})" for k, (a, z) in enumerate(zip(STARTS[:-1], STARTS[1:], strict=True)))
    + """) v(event_idx, a, z)),
s as (select signal_id, event_idx, i - a as j, z - a as n, x * (case when i - a < 5 then (i - a)::double / 5 else 1 end) * (case when z - 1 - i < 5 then (z - 1 - i)::double / 5 else 1 end) as x from w join b on i >= a and i < z)"""
)
_EV = "signal_id, event_idx"
_FR = "signal_id, event_idx, frame_idx"


def _framed(src: str, out: str, keys: str = _EV) -> str:
    """Frames of SIZE samples of src(keys, j, n, x) from sample 0, the last one padded."""
    return f"""{out}n as (select {keys}, any_value(n) n from {src} group by {keys}), {out}q as (select {keys}, unnest(range(1 + greatest(0, ceil((n - {SIZE})::double / {SIZE}))::int)) as frame_idx from {out}n),
{out} as (select q.*, k.j, coalesce(x, 0) as x from {out}q q cross join (select unnest(range({SIZE})) j) k left join {src} s on s.signal_id = q.signal_id and s.event_idx = q.event_idx and s.j = q.frame_idx * {SIZE} + k.j)"""


def settings() -> Settings:
    return Settings().with_(Analysis={"frameSize": SIZE, "hopSize": SIZE})


def _analysis_sql() -> str:
    taps = 2600  # what follows is below 1e-17
    parts = [
        Q.impulse(taps), EVENTS, _framed("s", "f"), Q.spectra(_FR, SIZE), Q.cepstra(_FR, SIZE, SR), Q.shape(_FR, SIZE, SR), Q.pitch(_FR, 2 * SIZE, SR, "t"),
        "y as (select signal_id, event_idx, j + h.i as j, any_value(n) n, sum(x * h) as x from s join h on j + h.i < n group by signal_id, event_idx, j + h.i)",
        _framed("y", "yf"), f"loud as (select {_FR}, power(sum(x * x), 0.67::double) as x from yf group by {_FR})",
        f"w0 as (select {_FR}, exp(0.05::double * x) as w from c where coef = 0)",
        f"""ft as (select {_FR}, 'bfcc' || coef as feature, x from c union all select * from (unpivot (select {_FR}, "SpectralCentroid", "SpectralDecrease", "SpectralFlatness", "SpectralCrest", "SpectralComplexity" from d) on columns(* exclude ({_FR})) into name feature value x)
union all select {_FR}, 'StrongPeak', "StrongPeak" from strong union all select {_FR}, 'Periodicity', sure from pitch union all select {_FR}, 'f0', case when hz > 0 then 69 + 12 * log2(hz / 440) else 0 end from pitch union all select {_FR}, 'Loudness', x from loud)""",
        f"""u as (select ft.*, case when feature in ('StrongPeak', 'Periodicity', 'Loudness', 'f0') then 1 else w end as w from ft join w0 using ({_FR})),
mu as (select {_EV}, feature, avg(x) as m from u group by {_EV}, feature), v as (select u.*, x - m as d, m from u join mu using ({_EV}, feature)),
g as (select {_EV}, feature, sum(x * w) / sum(w) as mean, median(x) as median, avg(d * d) as variance, avg(d * d) / (1 + power(median(x), 2)) as rel, avg(d * d * d) as m3, avg(d * d * d * d) as m4 from v group by {_EV}, feature)""",
    ]
    big = "case when rel > 1e-6::double then"
    return f"""with recursive {', '.join(parts)} select signal_id, event_idx::int as event_idx, feature, {sr('mean', 4)} as mean, {sr('median', 4)} as median, {sr('rel', 7)} as variance, {big} {sr('m3 / power(variance, 1.5)', 4)} end as skewness, {big} {sr('m4 / power(variance, 2) - 3', 4)} end as kurtosis from g"""


@query(_analysis_sql())
def q_wave_timbre_space(spark, sf_dir):
    """The whole analysis of waves: uniform onsets, events, fades, frames, all 22 features (with equal
    loudness and pitch), statistics. Variances are divided by 1 + the squared median."""
    out = stats.long_form(timbre_space(waves(spark, sf_dir), SR, settings()), ["signal_id", "event_idx"], schema.FEATURES)
    out = out.withColumn("rel", F.col("variance") / (1 + F.col("median") * F.col("median")))
    big = F.col("rel") > 1e-6
    return out.select(
        "signal_id", "event_idx", "feature", r("mean", 4).alias("mean"), r("median", 4).alias("median"), r("rel", 7).alias("variance"),
        F.when(big, r("skewness", 4)).alias("skewness"), F.when(big, r("kurtosis", 4)).alias("kurtosis"),
    )


@query(f"with {EVENTS} select signal_id, event_idx::int as event_idx, {sr('event_idx * 0.05::float::double')} as onset_s, count(*) as n, {sr('sum(x)', 5)} as total, {sr('sum(x * x)', 5)} as energy from s group by signal_id, event_idx")
def q_wave_events(spark, sf_dir):
    """Onsets of the dispatcher, bounds, and the events cut from the waves."""
    w = waves(spark, sf_dir).withColumn("rate", F.lit(SR))
    on = prepare(w, Settings(), SR)
    ev = segments.split(w, segments.bounds(on, ["signal_id"], (N - 1) / SR), ["signal_id"], "samples", "rate")
    total = lambda f: F.expr(f"aggregate(samples, 0D, (s, x) -> s + {f})")
    return ev.select("signal_id", "event_idx", r("start_s").alias("onset_s"), F.size("samples").cast("long").alias("n"), r(total("x"), 5).alias("total"), r(total("x * x"), 5).alias("energy"))


@query(f"with {WAVES}, q as (select unnest(range({1 + -(-(N + 512 - 1024) // 512)})) as frame_idx), f as (select signal_id, frame_idx, count(*) n, sum(x) t, sum(x * x) e from w join q on i >= frame_idx * 512 - 512 and i < frame_idx * 512 + 512 group by all) select signal_id, frame_idx::int as frame_idx, 1024::bigint as n, {sr('t', 5)} as total, {sr('e', 5)} as energy from f")
def q_onset_frames(spark, sf_dir):
    f = framing.onset_frames(waves(spark, sf_dir), ["signal_id"], "samples", 1024)
    total = lambda x: F.expr(f"aggregate(frame, 0D, (s, x) -> s + {x})")
    return f.select("signal_id", "frame_idx", F.size("frame").cast("long").alias("n"), r(total("x"), 5).alias("total"), r(total("x * x"), 5).alias("energy"))


_WHOLE = WAVES + f", s as (select signal_id, 0 as event_idx, i as j, {N} as n, x from w)"


@query("with " + ", ".join([_WHOLE, _framed("s", "f"), Q.spectra(_FR, SIZE), Q.cepstra(_FR, SIZE, SR)]) + f" select signal_id, frame_idx::int as frame_idx, coef::int as coef, {sr('x', 4)} as x from c")
def q_changepoint_features(spark, sf_dir):
    """Cepstra of a wave's frames, as change-point search takes them."""
    out = changepoints.cepstra(waves(spark, sf_dir), "signal_id", "samples", SR, settings())
    return rounded(out.select("signal_id", "frame_idx", F.posexplode("cepstra").alias("coef", "x")), "x", n=4)


@query(f"with {EVENTS} select signal_id, event_idx::int as event_idx, count(*) as n, sum(greatest(-8388608, least(8388607, round(x * 8388608)))::bigint)::bigint as total, sum(greatest(-8388608, least(8388607, round(x * 8388608)))::bigint * (j % 7))::bigint as weighted from s group by signal_id, event_idx")
def q_wav_round_trip(spark, sf_dir):
    """Events as 24-bit PCM files and back."""
    w = waves(spark, sf_dir).withColumn("rate", F.lit(SR))
    ev = segments.split(w, segments.bounds(prepare(w, Settings(), SR), ["signal_id"], (N - 1) / SR), ["signal_id"], "samples", "rate")
    files = W.events_as_wav(ev.withColumn("sample_rate", F.lit(SR)), "/events/", settings_hash=Settings().hash())
    back = W.whole(W.decoded(files, f"/events/{Settings().hash()}"))
    name = lambda k: F.split("signal_id", "_")[k].cast("int")
    total = lambda x: F.expr(f"aggregate(transform(samples, (x, i) -> cast(round(x * 8388608D) as bigint) * {x}), 0L, (s, x) -> s + x)")
    return back.select(name(0).alias("signal_id"), name(1).alias("event_idx"), F.col("n_samples").alias("n"), total("1").alias("total"), total("(i % 7)").alias("weighted"))


@query(f"with {EVENTS} select count(*) as done, 1::double as progress from (select distinct signal_id, event_idx from s)")
def q_completed_events(spark, sf_dir):
    """A background run over all events: how many it has completed, and its progress when it has ended."""
    w = waves(spark, sf_dir).withColumn("rate", F.lit(SR))
    ev = segments.split(w, segments.bounds(prepare(w, Settings(), SR), ["signal_id"], (N - 1) / SR), ["signal_id"], "samples", "rate")
    df, seen = counted(ev)
    run = Run(spark, lambda: df.write.format("noop").mode("overwrite").save())
    run.result()
    return spark.createDataFrame([(seen.get["done"], run.progress())], "done long, progress double")


# -- frames of 64 samples ------------------------------------------------------------------------------

_F64 = BINS + ", f as (select vec_id, bin as j, x from v), "


@query(_F64 + ", ".join([Q.spectra("vec_id", 64), Q.cepstra("vec_id", 64, RATE), Q.shape("vec_id", 64, RATE), "wide as (select vec_id, " + ", ".join(f"{sr(f'max(x) filter (coef = {k})', 4)} as bfcc{k}" for k in range(13)) + " from c group by vec_id)"])
    + " select wide.*, " + ", ".join(f'{sr(f"{chr(34)}{x}{chr(34)}", 4)} as "{x}"' for x in schema.SPECTRAL) + " from wide join d using (vec_id) join strong using (vec_id)")
def q_timbre_frames(spark, sf_dir):
    """All cepstral and spectral columns of each frame, by one kernel."""
    out = spectral.timbre(vectors(spark, sf_dir), ["vec_id"], "frame", RATE)
    return rounded(out, *out.columns[1:], n=4)


@query(_F64 + Q.pitch("vec_id", 64, RATE, "f") + f" select vec_id, {sr('hz', 4)} as hz, {sr('sure', 4)} as confidence from pitch")
def q_pitch_yin(spark, sf_dir):
    return rounded(spectral.pitches(vectors(spark, sf_dir), ["vec_id"], "frame", RATE), "hz", "confidence", n=4)


@query(BINS + f", o as (select unnest(range(128)) i), k as (select unnest(range(-15, 17)) k), t as (select o.i, floor(o.i * 22050.0::double / 44100) + k as place, o.i * 22050.0::double / 44100 - (floor(o.i * 22050.0::double / 44100) + k) as d from o cross join k), "
    f"u as (select i, place, (case when d = 0 then 1 else sin(pi() * d) / (pi() * d) end) * case when abs(d) < 16 then 0.5::double + 0.5::double * cos(pi() * d / 16) else 0 end as w from t) select vec_id, i::int as i, {sr('sum(x * w)', 5)} as x from v join u on u.place = v.bin group by vec_id, i")  # fmt: skip
def q_resample(spark, sf_dir):
    out = conditioning.resample(vectors(spark, sf_dir), ["vec_id"], "frame", 22050.0)
    return rounded(out.select("vec_id", F.posexplode("frame").alias("i", "x")), "x", n=5)


@query("with recursive " + Q.impulse(64) + ", " + BINS.removeprefix("with ") + f" select vec_id, (v.bin + h.i)::int as i, {sr('sum(x * h)', 6)} as x from v join h on v.bin + h.i < 64 group by all")
def q_equal_loudness(spark, sf_dir):
    out = conditioning.equal_loudness(vectors(spark, sf_dir), ["vec_id"], "frame")
    return rounded(out.select("vec_id", F.posexplode("frame").alias("i", "x")), "x")


@query(DFT + SEQ + f""", s as (select vec_id, sqrt(sum(x * x) / 64) e, any_value(label) label from v group by vec_id), u as (select vec_id, greatest(e - lag(e) over (partition by label order by vec_id), 0) as rms from s)
select vec_id, {sr('sum(m * k)', 4)} as hfc, {sr('sum(coalesce(greatest(m - m1, 0), 0))', 4)} as flux, {sr('coalesce(any_value(rms), 0)')} as rms, {sr('sum(case when a2 is null then 0 else sqrt(greatest(m * m + m1 * m1 - 2 * m * m1 * cos(a - 2 * a1 + a2), 0)) end)', 3)} as complex,
{sr('sum(case when a2 is null then 0 else m * acos(greatest(-1, least(1, cos(a - 2 * a1 + a2)))) end)', 3)} as complex_phase from q join u using (vec_id) group by vec_id""")
def q_onset_matrix(spark, sf_dir):
    """The five detectors side by side."""
    p = framing.map_frames(vectors(spark, sf_dir), ["vec_id", "label"], "frame", {"mag": "array<double>", "phase": "array<double>", "frame": "array<double>"}, lambda m: dict(zip(("mag", "phase", "frame"), (*K.polar(m), m), strict=True)))
    d = D.matrix(p, ["label"], "vec_id", "mag", "phase", "frame")
    return d.select("vec_id", r("hfc", 4).alias("hfc"), r("flux", 4).alias("flux"), r("rms").alias("rms"), r("complex", 3).alias("complex"), r("complexPhase", 3).alias("complex_phase"))


# -- projection --------------------------------------------------------------------------------------


@query(BINS + ", mu as (select bin, avg(x) m from v group by bin), z as (select vec_id, bin, x - m as x from v join mu using (bin)), cov as (select a.bin i, b.bin j, avg(a.x * b.x) v from z a join z b using (vec_id) group by a.bin, b.bin), " + Q.eigenvectors(64, 6)
    + ", e as (" + " union all ".join(f"select {c} as dim, i, v from e{c + 1}" for c in range(6)) + f") select vec_id, dim::int as dim, {sr('sum(x * v)')} as x from z join e on e.i = z.bin group by vec_id, dim")
def q_pca6(spark, sf_dir):
    out = projection.pca(vectors(spark, sf_dir), ["vec_id"], "frame", 6)
    return rounded(out.select("vec_id", F.posexplode("pc").alias("dim", "x")), "x")


#: Without the price, whose variance is 10^7 times the others': the second component of rows unscaled would
#: depend on the last bits.
_CHOSEN = ["quantity", "discount", "tax"]
_MED = ", ".join(f"median({LINE[n]}) as {n}" for n in _CHOSEN)
_FIELDS = " union all ".join(f"select l_orderkey, {k} as i, {n}::double as x from o" for k, n in enumerate(_CHOSEN))


@query(f"with o as (select l_orderkey, {_MED} from lineitem group by l_orderkey), v as ({_FIELDS}), mu as (select i, avg(x) m from v group by i), z as (select l_orderkey, i, x - m as x from v join mu using (i)), cov as (select a.i, b.i as j, avg(a.x * b.x) v from z a join z b using (l_orderkey) group by a.i, b.i), "
    + Q.eigenvectors(len(_CHOSEN), 2, doublings=8) + f", e as (select 0 as dim, i, v from e1 union all select 1, i, v from e2) select l_orderkey, dim::int as dim, {sr('sum(x * v)', 4)} as x from z join e using (i) group by l_orderkey, dim")
def q_event_pca(spark, sf_dir):
    """Components of one statistic of chosen features, over all events."""
    out = projection.pca_of_statistic(_line(spark, sf_dir), ["l_orderkey"], _CHOSEN, "median", 2)
    return rounded(out.select("l_orderkey", F.posexplode("pc").alias("dim", "x")), "x", n=4)


# -- change points -----------------------------------------------------------------------------------

_BIC = SBic(cpw=0.3, size1=60, inc1=4, size2=40, inc2=2, minLength=8)


def _bic_sql(s: SBic) -> str:
    """Prefix sums of two features per sequence; the search as a recursion over windows."""
    m = s.minLength

    def logdet(a: str, b: str) -> str:
        mean = lambda f: f"(({b}.{f} - {a}.{f}) / ({b}.pos - {a}.pos))"
        var = lambda f, g, h: f"({mean(f)} - {mean(g)} * {mean(h)})"
        return f"ln(({var('xx', 'x', 'x')} + 1e-9::double) * ({var('yy', 'y', 'y')} + 1e-9::double) - power({var('xy', 'x', 'y')}, 2))"

    gain = f"0.5::double * ((pj.pos - pi.pos) * {logdet('pi', 'pj')} - (pk.pos - pi.pos) * {logdet('pi', 'pk')} - (pj.pos - pk.pos) * {logdet('pk', 'pj')}) - 0.5::double * {s.cpw}::double * 5 * ln(pj.pos - pi.pos)"

    def best(src: str, a: str, b: str, step: int) -> str:
        return f"""(select {src}.label, arg_max(pk.pos, (gain, -pk.pos)) filter (gain > 0) as k from {src} join ps pi on pi.label = {src}.label and pi.pos = {a} join ps pj on pj.label = {src}.label and pj.pos = {b}
join ps pk on pk.label = {src}.label and pk.pos >= {a} + {m} and pk.pos <= {b} - {m} and (pk.pos - {a} - {m}) % {step} = 0, lateral (select {gain} as gain) group by {src}.label)"""

    return f""", seq as (select vec_id, label, row_number() over (partition by label order by vec_id) as pos, max(x) filter (coef = 0) as x, max(x) filter (coef = 1) as y from c2 join (select distinct vec_id, label from v) using (vec_id) group by vec_id, label),
ps as materialized (select label, pos, sum(x) over w x, sum(y) over w y, sum(x * x) over w xx, sum(y * y) over w yy, sum(x * y) over w xy from seq window w as (partition by label order by pos)
union all select distinct label, 0, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double from seq), len as (select label, max(pos) n from ps group by label),
r as (select label, n, 0::bigint as i, least(n, {s.size1})::bigint as j, 0::bigint as k, false as done from len union all
select t.label, t.n, case when t.kk is not null then t.kk else t.i end, case when t.kk is not null then least(t.n, t.kk + {s.size1}) else least(t.n, t.j + {s.inc1}) end, t.kk, t.kk is null and t.j = t.n
from (select u.*, case when u.k1 is null then null when u.b - u.a >= {2 * m} and g.k > u.i then g.k else u.k1 end as kk from
(select st.label, st.n, st.i, st.j, f.k as k1, greatest(st.i, f.k - {s.size2 // 2}) as a, least(st.n, f.k + {s.size2 // 2}) as b from r st left join {best('r', 'r.i', 'r.j', s.inc1)} f on f.label = st.label where not st.done and st.j - st.i >= {2 * m}) u
left join lateral (select arg_max(pk.pos, (gain, -pk.pos)) filter (gain > 0) as k from ps pi, ps pj, ps pk, lateral (select {gain} as gain) where pi.label = u.label and pj.label = u.label and pk.label = u.label and pi.pos = u.a and pj.pos = u.b and pk.pos >= u.a + {m} and pk.pos <= u.b - {m} and (pk.pos - u.a - {m}) % {s.inc2} = 0) g on true) t)
select label, k::int as start_frame from r where k is not null"""


_TWO = f", c2 as (select vec_id, c.c as coef, sum(10 * log10(greatest(e, 1e-10::double)) * cos(pi() / {BANDS} * (band + 0.5::double) * c) * sqrt(2.0::double / {BANDS}) * case when c = 0 then sqrt(0.5::double) else 1 end) as x from bb cross join (select unnest(range(2)) c) c group by vec_id, c.c)"


@query("with recursive " + (BARK + _TWO).removeprefix("with ") + _bic_sql(_BIC))
def q_bic_segments(spark, sf_dir):
    """Change points of each label's sequence of frames, by their first two cepstral coefficients, which
    cover the whole frame."""
    bank = {"bands": BANDS, "low": 500.0, "high": 4000.0, "coefficients": 2}
    c = spectral.bfcc(framing.spectra(vectors(spark, sf_dir), ["vec_id", "label"], "frame"), ["vec_id", "label"], "spectrum", RATE, **bank)
    return changepoints.bic(c, "label", "vec_id", "bfcc", _BIC)


# -- names, settings, lengths, hashes ---------------------------------------------------------------------

#: The features in order, as in schema.py.
_NAMES = ["bfcc0", "bfcc1", "bfcc2", "bfcc3", "bfcc4", "bfcc5", "bfcc6", "bfcc7", "bfcc8", "bfcc9", "bfcc10", "bfcc11", "bfcc12", "SpectralCentroid", "SpectralDecrease", "SpectralFlatness", "SpectralCrest", "SpectralComplexity", "StrongPeak", "Periodicity", "Loudness", "f0"]


@query("select i::int as ordinal, n as name, n like 'bfcc%' as cepstral, i < 18 as timbral from (select unnest(range(22)) i, unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "]) n)")
def q_feature_names(spark, sf_dir):
    """Names to ordinals and back, the cepstral predicate, the timbral block."""
    rows = [(schema.feature(n.upper()), schema.FEATURES[schema.feature(n)], schema.is_cepstral(n), n in schema.TIMBRAL) for n in schema.FEATURES]
    return spark.createDataFrame(rows, "ordinal int, name string, cepstral boolean, timbral boolean")


@query("select * from (values (0, 'mean'), (1, 'median'), (2, 'variance'), (3, 'skewness'), (4, 'kurtosis')) v(ordinal, name)")
def q_statistic_names(spark, sf_dir):
    return spark.createDataFrame([(schema.statistic(n), n) for n in schema.STATISTICS], "ordinal int, name string")


@query("""select * from (values ('Analysis', 'frameSize', '1024', 64.0::double, 8192.0::double, true), ('Analysis', 'hopSize', '1024', 32, 4096, true), ('Onset', 'segmentation', 'Uniform', null, null, false), ('Onset', 'silenceThreshold', '0.1', 0, 1, false),
('Onset', 'alpha', '0.1', 0, 1, false), ('Onset', 'numFrames_shortOnsetFilter', '5', 1, 64, false), ('BFCC', 'numBands', '40', 1, 128, false), ('BFCC', 'numCoefficients', '13', 5, 26, false), ('Pitch', 'pitchDetectionAlgorithm', 'yin', null, null, false), ('Loudness', 'equalizeLoudness', 'True', null, null, false)) v(branch, name, preset, low, high, power_of_two)""")
def q_settings_specification(spark, sf_dir):
    """Defaults and ranges of some settings, from the specification that checks them."""
    chosen = ["Analysis.frameSize", "Analysis.hopSize", "Onset.segmentation", "Onset.silenceThreshold", "Onset.alpha", "Onset.numFrames_shortOnsetFilter", "BFCC.numBands", "BFCC.numCoefficients", "Pitch.pitchDetectionAlgorithm", "Loudness.equalizeLoudness"]
    rows = [x for x in specification() if f"{x[0]}.{x[1]}" in chosen]
    return spark.createDataFrame(rows, "branch string, name string, preset string, low double, high double, power_of_two boolean")


@query("select n_nationkey, (case when n_nationkey % 5 = 0 then 'missing' when n_nationkey % 5 = 1 then 'unknown' when 20 + n_nationkey * 11 not in (64, 128, 256) then 'range' else 'ok' end) as verdict from nation")
def q_settings_check(spark, sf_dir):
    """Trees of settings: a missing branch, an unknown key, a frame size that is no power of two in range."""
    keys = [x[0] for x in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame([(k, _verdict(k)) for k in keys], f"n_nationkey {dict(table(spark, sf_dir, 'nation').dtypes)['n_nationkey']}, verdict string")


def _verdict(k: int) -> str:
    tree = Settings().to_dict()
    if k % 5 == 0:
        del tree["Pitch"]
    elif k % 5 == 1:
        tree["Pitch"]["colour"] = 1
    else:
        tree["Analysis"]["frameSize"] = 20 + 11 * k
    try:
        Settings.from_dict(tree)
    except ValueError as e:
        return "missing" if "missing" in str(e) else "unknown" if "unknown" in str(e) else "range"
    return "ok"


@query("select n_nationkey, least(greatest(power(2, round(log2(greatest(1 + n_nationkey * 397, 1)))), 64), 8192)::bigint as snapped from nation")
def q_power_of_two(spark, sf_dir):
    keys = [x[0] for x in table(spark, sf_dir, "nation").select("n_nationkey").collect()]
    return spark.createDataFrame([(k, nearest_power_of_two(1 + 397 * k, 64, 8192)) for k in keys], f"n_nationkey {dict(table(spark, sf_dir, 'nation').dtypes)['n_nationkey']}, snapped long")


@query(f"select s_suppkey, {sr('s_suppkey * 1000 / 44100.0::double')} as seconds from supplier")
def q_length_seconds(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 1000).alias("n"), F.lit(44100.0).alias("rate"))
    return s.select("s_suppkey", r(onsets.length_seconds("n", "rate")).alias("seconds"))


@query("select l_orderkey, sha256(string_agg((l_linenumber / 8)::double::varchar, ',' order by l_linenumber)) as audio_hash from lineitem group by l_orderkey")
def q_audio_hash(spark, sf_dir):
    x = F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda v: (v / 8).cast("double"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(x.alias("samples")).select("l_orderkey", W.audio_hash("samples").alias("audio_hash"))
