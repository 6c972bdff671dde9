"""Onset algebra, events, waves, the whole analysis, and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.functions import kernels as K
from sigmill.operators import onsets as O
from sigmill.operators import projection, segments, stats
from sigmill.plans.analyze import prepare, timbre_space
from sigmill.schema import FEATURES
from sigmill.settings import Settings
from sigmill.sources import wave as W
from sigmill.streaming import windows as S

RATE = 44100.0


def rows(spark, *times, key="a"):
    return spark.createDataFrame([(key, float(t)) for t in times], "k string, onset_s double")


def times(df):
    return [r["onset_s"] for r in df.orderBy("onset_s").collect()]


def test_dedup_compares_with_the_last_kept(spark):
    d = rows(spark, 0, 0.015, 0.03, 0.045, 0.1)
    once = O.min_gap_dedup(d, ["k"], 0.02)
    assert times(once) == [0, 0.03, 0.1]
    assert times(O.min_gap_dedup(once.select("k", "onset_s"), ["k"], 0.02)) == [0, 0.03, 0.1]
    assert times(O.min_gap_dedup(d, ["k"], 0.02, length=0.1)) == [0, 0.03]


@pytest.mark.parametrize(("given", "want"), [([1], [1, 2.125, 3.25, 5.5]), ([0, 1, 5], [0, 1, 3, 5]), ([0, 1, 2, 3, 4], [0, 1, 2, 3, 4])])
def test_minimum_count(spark, given, want):
    assert times(O.min_count_fill(rows(spark, *given), ["k"], 4, 10.0)) == want


def test_minimum_count_of_none(spark):
    all_keys = spark.createDataFrame([("a",), ("b",)], "k string")
    out = O.min_count_fill(rows(spark, 0, 1, 5), ["k"], 4, 9.0, all_keys)
    assert times(out.where("k = 'b'")) == [0, 3, 6, 9] and out.where("k = 'a'").count() == 4


@pytest.mark.parametrize(("seconds", "count"), [(1.0, 19), (10.0, 199), (60.0, 1199), (0.04, 0), (0.12, 2)])
def test_uniform_grid(spark, seconds, count):
    out = O.uniform_grid(spark.createDataFrame([("a", seconds)], "k string, n double"), ["k"], "n")
    assert out.count() == count


def test_subdivision_and_density(spark):
    assert times(O.subdivide_gaps(rows(spark, 0, 4), ["k"], F.lit(1), 10.0)) == [0, 2, 4, 7]
    assert times(O.subdivide_gaps(rows(spark, 0, 4), ["k"], F.lit(0), 10.0)) == [0, 4]
    assert times(O.equalize_density(rows(spark, 0, 1, 2, 3, 4, 5, 10), ["k"], 11.0)) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert times(O.equalize_density(rows(spark, 3), ["k"], 11.0)) == [3]


def test_normalisation_is_undone(spark):
    n = O.normalize(rows(spark, 1, 5, 9), 10.0)
    assert n.agg(F.max("onset_norm")).first()[0] <= 1
    assert times(O.denormalize(n.drop("onset_s"), 10.0)) == [1, 5, 9]


def test_largest_gap_takes_the_first(spark):
    assert tuple(O.largest_gap(rows(spark, 0, 2, 3, 5), ["k"]).first()) == ("a", 0.0, 2.0)


def test_bounds_and_assignment(spark):
    b = segments.bounds(rows(spark, 1, 4), ["k"], 9.0)
    found = sorted(tuple(r) for r in b.collect())
    assert found == [("a", 0, 1.0, 4.0), ("a", 1, 4.0, 9.0)]
    p = spark.createDataFrame([("a", t, t) for t in (0.5, 1.0, 3.9, 4.0, 8.0)], "k string, t double, v double")
    assert sorted((r["v"], r["event_idx"]) for r in segments.assign(p, b, ["k"], "t").collect()) == [(1.0, 0), (3.9, 0), (4.0, 1), (8.0, 1)]


def test_fade(spark):
    x = spark.range(1).select(F.array_repeat(F.lit(1.0), 8).alias("x")).select(segments.fade("x", 5, 5).alias("x")).first()["x"]
    a = np.array([0, 0.2, 0.4, 0.6, 0.8, 1, 1, 1])
    assert np.allclose(x, a * a[::-1]) and x[0] == x[-1] == 0
    assert spark.range(1).select(F.array(F.lit(1.0)).alias("x")).select(segments.fade("x", 5, 5).alias("x")).first()["x"] == [0.0]


def test_one_event_is_the_whole_wave(spark):
    w = spark.createDataFrame([("a", [1.0] * 10, 10.0), ("b", [1.0] * 10, 10.0)], "k string, x array<double>, r double")
    e = segments.bounds(rows(spark, 0.3).union(rows(spark, 0.2, 0.6, key="b")), ["k"], 0.9)
    out = {(r["k"], r["event_idx"]): r["samples"] for r in segments.split(w, e, ["k"], "x", "r", 0, 0).collect()}
    assert out["a", 0] == [1.0] * 10 and len(out["b", 0]) == 4 and len(out["b", 1]) == 4


def test_statistics(spark):
    d = spark.createDataFrame([(1, float(x), 1.0) for x in (1, 2, 3, 10)] + [(2, 5.0, 1.0)], "k int, x double, w double")
    out = {r["k"]: r["x"].asDict() for r in stats.event_statistics(d, ["k"], ["x"]).collect()}
    assert out[1]["mean"] == 4 and out[1]["median"] == 2.5 and out[1]["variance"] == 12.5
    assert out[2]["variance"] == 0 and out[2]["skewness"] is None
    plan = stats.project(stats.event_statistics(d, ["k"], ["x"]), ["k"], ["x"], "mean")._jdf.queryExecution().optimizedPlan().toString()
    assert "avg" in plan and "kurtosis" not in plan


def test_weighted_mean_without_weight(spark):
    d = spark.createDataFrame([(2.0,), (4.0,)], "x double")
    assert d.agg(stats.weighted_mean("x", F.lit(0.0))).first()[0] == 0.0
    assert d.agg(stats.weighted_mean("x", F.col("x"))).first()[0] == pytest.approx(20 / 6)


def test_range_ignores_nan(spark):
    d = spark.createDataFrame([(1.0,), (float("nan"),), (-3.0,)], "x double")
    assert tuple(stats.dimension_range(d, "x").first()) == (-3.0, 1.0)
    assert stats.normalization_multiplier(d, "x").first()[0] == pytest.approx(1 / 3)
    assert stats.normalization_multiplier(spark.createDataFrame([(0.0,)], "x double"), "x").first()[0] is None


def test_pca_matches_svd(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 5)) @ np.diag([5, 3, 1, 0.5, 0.1])
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, x array<double>")
    out = np.array([r["pc"] for r in projection.pca(d, ["id"], "x", 3).orderBy("id").collect()])
    c = m - m.mean(axis=0)
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(out), np.abs((u * s)[:, :3]))
    assert projection.pca(d.limit(1), ["id"], "x").count() == 0


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav_round_trip(spark, tmp_path, bits):
    x = np.sin(np.arange(1000) / 9) * 0.9
    (tmp_path / "one.wav").write_bytes(W.encode(x, RATE, bits))
    df = W.read_wav(spark, str(tmp_path), chunk=300)
    assert df.count() == 4
    r = W.whole(df).first()
    assert (r["signal_id"], r["sample_rate"], r["bit_depth"], r["n_samples"]) == ("one", RATE, bits, 1000)
    assert np.abs(np.array(r["samples"]) - x).max() <= 1.01 / 2 ** (bits - 1) + 1e-7


def test_bad_wav(spark, tmp_path):
    (tmp_path / "bad.wav").write_bytes(b"no wave")
    with pytest.raises(Exception):  # noqa: B017
        W.read_wav(spark, str(tmp_path)).count()
    r = W.read_wav(spark, str(tmp_path), permissive=True).first()
    assert r["samples"] is None and r["n_samples"] == 0


def test_event_files(spark, tmp_path):
    e = spark.createDataFrame([("s", 0, [0.5, -0.5], RATE), ("s", 1, [0.25], RATE)], "signal_id string, event_idx int, samples array<double>, sample_rate double")
    assert W.write_wav(e, f"file://{tmp_path}/out") == 2
    back = W.whole(W.read_wav(spark, f"{tmp_path}/out")).orderBy("signal_id").collect()
    assert [(r["signal_id"], len(r["samples"]), r["bit_depth"]) for r in back] == [("s_0", 2, 24), ("s_1", 1, 24)]


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder, n in (("a", 10), ("b", 20)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "kick.WAV").write_bytes(W.encode(np.zeros(n), RATE, 16))
    out = W.whole(W.read_wav(spark, f"{tmp_path}/*"))
    assert sorted((r["signal_id"], r["n_samples"]) for r in out.collect()) == [("a/kick", 10), ("b/kick", 20)]
    e = out.select("signal_id", F.lit(0).alias("event_idx"), "samples", "sample_rate")
    assert W.write_wav(e, f"{tmp_path}/out-", settings_hash="abc") == 2
    assert W.write_wav(e, f"{tmp_path}/out-", settings_hash="abc") == 2  # once more: the same files
    assert sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.glob("out-abc/**/*") if p.is_file()) == ["out-abc/a/kick_0.wav", "out-abc/b/kick_0.wav"]


def test_a_wave_passes_no_window(spark):
    w = spark.createDataFrame([("a", [1.0] * 10, 10.0)], "k string, x array<double>, r double")
    out = segments.split(w, segments.bounds(rows(spark, 0.2, 0.6), ["k"], 0.9), ["k"], "x", "r")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "_x" not in "".join(x for x in plan.split("\n") if "Window" in x)


def test_background_run(spark):
    import time

    from sigmill.plans.run import Run, counted

    df, seen = counted(spark.range(1000))
    run = Run(spark, lambda: df.write.format("noop").mode("overwrite").save() or "ended")
    assert run.result() == "ended" and run.progress() == 1 and seen.get["done"] == 1000
    with pytest.raises(ZeroDivisionError):
        Run(spark, lambda: 1 / 0).result()
    slow = spark.range(0, 64, 1, 64).selectExpr("reflect('java.lang.Thread', 'sleep', 2000L)")
    run = Run(spark, lambda: slow.write.format("noop").mode("overwrite").save())
    time.sleep(1.5)
    assert not run.wait(0.1) and run.progress() < 1
    run.cancel()
    assert run.wait(30)
    with pytest.raises(Exception):  # noqa: B017
        run.result()


def bursts():
    rng = np.random.default_rng(4)
    x = np.zeros(int(2 * RATE))
    at = [0.25, 0.7, 1.2, 1.6]
    for t in at:
        i = int(t * RATE)
        x[i : i + 4000] = rng.normal(0, 0.5, 4000)
    return x, at


def waves(spark, **signals):
    return spark.createDataFrame([(k, [float(v) for v in x]) for k, x in signals.items()], "signal_id string, samples array<double>")


def test_bursts_are_found(spark):
    x, at = bursts()
    s = Settings().with_(Onset={"segmentation": "Event", "weight_complex": 0.0, "weight_complexPhase": 0.0})
    found = times(prepare(waves(spark, b=x), s, RATE))
    assert all(min(abs(t - f) for f in found) < 0.05 for t in at)


def test_other_rates_are_resampled(spark):
    x, at = bursts()
    s = Settings().with_(Onset={"segmentation": "Event", "weight_complex": 0.0, "weight_complexPhase": 0.0})
    found = times(prepare(waves(spark, b=K.resample(x, RATE, 22050.0)), s, 22050.0))
    assert all(min(abs(t - f) for f in found) < 0.05 for t in at)


def test_timbre_space(spark):
    x = np.concatenate([np.sin(2 * np.pi * 440 * np.arange(8820) / RATE), np.sin(2 * np.pi * 880 * np.arange(8820) / RATE)])
    out = timbre_space(waves(spark, tone=x, silence=np.zeros(8820), short=np.zeros(1000), none=[]), RATE).cache()
    assert out.columns == ["signal_id", "event_idx", *FEATURES]
    n = {r["signal_id"]: r["count"] for r in out.groupBy("signal_id").count().collect()}
    assert n == {"tone": 7, "silence": 4} or set(n) == {"tone", "silence"}
    tone = out.where("signal_id = 'tone'").orderBy("event_idx").collect()
    assert tone[1]["f0"]["median"] == pytest.approx(69, abs=0.3) and tone[-1]["f0"]["median"] == pytest.approx(81, abs=0.3)
    assert tone[1]["Periodicity"]["mean"] > 0.7  # of a tapered frame
    quiet = out.where("signal_id = 'silence'").first()
    assert quiet["SpectralCentroid"]["mean"] is None or np.isnan(quiet["SpectralCentroid"]["mean"])
    assert quiet["Loudness"]["mean"] == 0


def test_command(spark, tmp_path):
    from sigmill.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.wav").write_bytes(W.encode(K.chirp(100, 4000, 13230), RATE, 16))
    assert main(["analyze", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--settings", '{"Analysis": {"hopSize": 512}}']) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() >= 4
    assert main(["version"]) == 0


def test_registered_wave(spark):
    W.register(spark, "mem", [0.0, 1.0], RATE)
    assert spark.sql("select n_samples from mem").first()[0] == 2
    assert len(W.whole(spark.table("mem")).select(W.audio_hash("samples")).first()[0]) == 64


def test_streams(spark, tmp_path):
    src = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 5.0), (1, 5.5), (2, 3.0)], "k long, onset_s double")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    q = S.min_gap_stream(stream, "k", 2.0).writeStream.format("memory").queryName("gaps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("gaps").collect()) == [(1, 0.0), (1, 5.0), (2, 3.0)]


def test_stream_windows(spark, tmp_path):
    src = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 1 as k, 2D as value union all select timestamp'2024-01-01 00:50:00', 1, 4D union all select timestamp'2024-01-01 01:10:00', 1, 6D")
    src.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    q = S.tumbling(stream, "ts", "1 hour", ["k"]).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["mean"]) for r in spark.table("hours").collect()) == [(1, 6.0), (2, 3.0)]
    assert S.sessions(src, "ts", "30 minutes", ["k"], None).count() == 2
