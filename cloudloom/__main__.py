"""Command line: ``python -m cloudloom transcode`` and ``python -m cloudloom bench``."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession

from . import params as P
from .plans import sweep, tool
from .sources import files, payloads


def numbers(text: str) -> tuple[float, ...]:
    return tuple(float(v) for v in text.replace(",", " ").split())


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="cloudloom")
    sub = out.add_subparsers(dest="command", required=True)
    t = sub.add_parser("transcode", help="files of clouds to files of another codec")
    t.add_argument("source")
    t.add_argument("target")
    how = t.add_mutually_exclusive_group(required=True)
    how.add_argument("--params", help="a TOML file of codec parameters")
    how.add_argument("--codec", help="a format with default parameters")
    t.add_argument("--kind", choices=["points", "points_rgba", "splats"], default="points")
    t.add_argument("--count", type=int, help="points that are kept of each cloud")
    t.add_argument("--recursive", action="store_true")
    t.add_argument("--overwrite", action="store_true")
    t.add_argument("--grid", type=numbers, help="nx,ny,nz")
    t.add_argument("--tile", type=float, help="edge of cubic tiles")
    t.add_argument("--percentages", type=numbers)
    t.add_argument("--region", type=numbers, action="append", help="min x,y,z,max x,y,z; several times")
    t.add_argument("--drop-rest", action="store_true", help="points outside all regions go")
    b = sub.add_parser("bench", help="codec sweeps of a TOML file")
    b.add_argument("config")
    b.add_argument("--out", default="outcomes.csv", help="CSV, or JSON lines if it ends in .jsonl")
    return out


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("cloudloom").getOrCreate()
    if a.command == "transcode":
        params = P.from_toml(Path(a.params).read_text()) if a.params else P.defaults(a.codec)
        chunks = {"grid": tuple(map(int, a.grid)) if a.grid else None, "tile": a.tile, "percentages": list(map(int, a.percentages)) if a.percentages else None, "regions": a.region}
        tool.transcode(spark, a.source, a.target, params, a.kind, a.count, None, a.recursive, a.overwrite, keep_rest=not a.drop_rest, **chunks)
        return
    config = sweep.read_config(Path(a.config).read_text())
    clouds = None
    for root in config.roots:
        part = files.read_payloads(spark, root)
        clouds = part if clouds is None else clouds.union(part)
    outcomes = sweep.run(payloads.decode(clouds), config).cache()
    files.write_outcomes(outcomes, a.out)
    summary = sweep.summary(outcomes.where("error is null"))
    summary.show(200, False)
    Path(f"{a.out}.txt").write_text("\n".join(str(r.asDict()) for r in summary.collect()) + "\n")


if __name__ == "__main__":
    main()
