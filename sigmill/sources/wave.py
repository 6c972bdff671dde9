"""WAV files as tables and back, and synthetic signals."""

from __future__ import annotations

import io
import logging
import math
import re
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

#: Samples per row of a signal.
CHUNK = 1 << 18
#: One more than the most samples of a file.
MAX_SAMPLES = 1 << 31
SIGNALS = "signal_id string, path string, sample_rate double, bit_depth int, n_samples long, chunk_idx int, chunk_start long, samples array<float>"


def decode(data: bytes) -> tuple[np.ndarray, float, int]:
    """First channel in [-1, 1), sample rate, bit depth, of PCM with 8 to 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        n, ch, width = w.getnframes(), w.getnchannels(), w.getsampwidth()
        if n >= MAX_SAMPLES:
            raise ValueError("too many samples")
        raw = np.frombuffer(w.readframes(n), np.uint8)
        raw = raw[: len(raw) // (ch * width) * ch * width].reshape(-1, ch, width)[:, 0]
        rate = float(w.getframerate())
    if width == 1:
        return (raw[:, 0].astype(np.float32) - 128) / 128, rate, 8
    x = np.zeros(len(raw), np.int64)
    for k in range(width):
        x |= raw[:, k].astype(np.int64) << (8 * k)
    x -= (x >> (8 * width - 1)) << (8 * width)
    return (x / float(1 << (8 * width - 1))).astype(np.float32), rate, 8 * width


def encode(samples, rate: float, bits: int = 24) -> bytes:
    """Mono PCM."""
    top = 1 << (bits - 1)
    x = np.clip(np.round(np.asarray(samples, float) * top), -top, top - 1).astype("<i8")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(bits // 8)
        w.setframerate(int(rate))
        w.writeframes(x.view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes() if bits > 8 else (x + 128).astype(np.uint8).tobytes())
    return out.getvalue()


def fixed_part(path: str) -> str:
    """The folders of a path before its first pattern, or before the file that it names."""
    head = re.split(r"[*?\[{]", path, maxsplit=1)[0]
    return head if head == path and not path.lower().endswith(".wav") else head.rsplit("/", 1)[0]


def identity(path: str, root: str) -> str:
    """A file's path below the folder `root`, without its suffix: files of one name in several folders
    stay apart."""
    plain = lambda x: re.sub(r"^[a-z0-9]+:/*", "/", x).rstrip("/")
    p, r = plain(path), plain(root)
    return (p[len(r) + 1 :] if p.startswith(f"{r}/") else p).rsplit(".", 1)[0]


def decoded(files: DataFrame, root: str = "", permissive: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Signals of (path, content), in chunks; see read_wav()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SIGNALS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float32())]
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sid = identity(p, root)
                try:
                    x, rate, bits = decode(data)
                except (wave.Error, EOFError, ValueError) as e:
                    if not permissive:
                        raise
                    log.warning("%s: %s", p, e)
                    rows = [(sid, p, 0.0, 0, 0, 0, 0, None)]
                else:
                    rows = [(sid, p, rate, bits, len(x), k, at, x[at : at + chunk]) for k, at in enumerate(range(0, max(len(x), 1), chunk))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, SIGNALS)


def read_wav(spark: SparkSession, path: str, permissive: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Signals of WAV files (.wav in any case), in chunks, named by their path below the fixed part of
    `path`. permissive: files that can't be read become a row without samples; else they are an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    return decoded(files, fixed_part(path), permissive, chunk)


def whole(signals: DataFrame) -> DataFrame:
    """One row per signal, its chunks joined; signals without samples drop out."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_idx", "samples"))), lambda p: p["samples"])
    out = signals.where("samples is not null").groupBy("signal_id", "path", "sample_rate", "bit_depth", "n_samples").agg(F.flatten(parts).alias("samples"))
    return out


def register(spark: SparkSession, name: str, samples, rate: float) -> DataFrame:
    """An in-memory wave as a signal and as the temporary view `name`."""
    x = [float(v) for v in samples]
    df = spark.createDataFrame([(name, "", float(rate), 32, len(x), 0, 0, x)], SIGNALS)
    df.createOrReplaceTempView(name)
    return df


def swept_sine(spark: SparkSession, low: float, high: float, n: int, rate: float = 44100.0) -> DataFrame:
    """(i, x): sin of 2 pi f i / rate with f linear in i (the phase isn't integrated)."""
    i = F.col("id").cast("double")
    f = F.lit(low) + F.lit(high - low) * i / F.lit(float(max(n - 1, 1)))
    return spark.range(n).select(F.col("id").alias("i"), F.sin(F.lit(2 * math.pi) * f * i / F.lit(rate)).alias("x"))


def audio_hash(samples: str) -> F.Column:
    return F.sha2(F.array_join(F.transform(samples, lambda x: x.cast("string")), ",").cast("binary"), 256)


def events_as_wav(events: DataFrame, base: str, bits: int = 24, settings_hash: str = "") -> DataFrame:
    """(path, content) of events (signal_id, event_idx, samples, sample_rate):
    <base><settings_hash>/<signal>_<idx>.wav, where folders in a signal's name become folders."""
    src = events.select(F.col("signal_id").cast("string"), "event_idx", "samples", "sample_rate")
    folder = f"{base}{settings_hash}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
            made = [(f"{folder}/{s}_{i}.wav", encode(x, rate, bits)) for s, i, x, rate in rows]
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], ["path", "content"])

    return src.mapInArrow(run, "path string, content binary")


def write_wav(events: DataFrame, base: str, bits: int = 24, settings_hash: str = "") -> int:
    """Writes the files in the tasks that make them; returns how many there are. base: a folder, or a URI
    that pyarrow's file systems open, which all executors reach. A file appears under its name only when
    it is whole, so that a task that runs again does no harm."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                part = f"{name}.{uuid.uuid4().hex}.part"
                with system.open_output_stream(part) as out:
                    out.write(data)
                system.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    made = events_as_wav(events, base, bits, settings_hash).mapInArrow(put, "n long")
    return int(made.agg(F.sum("n")).first()[0] or 0)
