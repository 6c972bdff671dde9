"""python -m sigmill analyze FILE_OR_FOLDER --out FOLDER [--settings JSON] | version"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from .plans.analyze import timbre_space
from .plans.run import Run
from .settings import Settings
from .sources.wave import read_wav, whole

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sigmill")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    a = sub.add_parser("analyze", help="event features of WAV files, as Parquet")
    a.add_argument("path")
    a.add_argument("--out", required=True)
    a.add_argument("--settings", help="JSON; missing keys take their defaults")
    args = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    if args.command == "version":
        print(VERSION)
        return 0
    s = Settings.from_json(args.settings, fill=True) if args.settings else Settings()
    print(s.to_json())
    spark = SparkSession.builder.appName("sigmill").getOrCreate()
    waves = whole(read_wav(spark, args.path))
    rates = [r[0] for r in waves.select("sample_rate").distinct().collect()]
    for k, rate in enumerate(rates):  # a second call replaces the first one's result
        out = timbre_space(waves.where(waves.sample_rate == rate), rate, s)
        run = Run(spark, lambda out=out, k=k: out.write.mode("append" if k else "overwrite").parquet(args.out))
        while not run.wait(5):
            logging.info("%.0f Hz: %.0f %%", rate, 100 * run.progress())
        run.result()
    logging.info("complete: %s", args.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
