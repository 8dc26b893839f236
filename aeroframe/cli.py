"""Command line over the DataFrame functions."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from aeroframe import doctor
from aeroframe.operators import fields, grid, reports, spectral, stats
from aeroframe.sources import binary, discovery, netcdf, text


def session() -> SparkSession:
    return SparkSession.builder.appName("aeroframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _show(rows) -> None:
    print(json.dumps([r.asDict(True) for r in rows], indent=2, default=str))


def _discover(a):
    _show(discovery.discover(session(), a.directory, a.domain, a.start, a.end, a.recursive).collect())


def _inspect(a):
    _show(netcdf.read_file_meta(session(), a.path).collect())


def _validate(a):
    _show(discovery.validate_columns(session().read.parquet(a.path)).limit(0).collect())


def _concat(a):
    netcdf.aggregate(session(), a.paths, a.variables.split(","), a.output)


def _bts_info(a):
    _show(binary.read_meta(session(), a.path).collect())


def _bts_compare(a):
    spark = session()
    found = fields.max_error(*[binary.read_bts(spark, p).drop("path") for p in (a.first, a.second)]).first()
    if found["unmatched"]:
        raise SystemExit("field shapes differ")
    _show([found])


def _extract(a):
    df = session().read.parquet(a.path)
    grid.point(df, a.latitude, a.longitude, a.lat, a.lon).write.parquet(a.output)


def _filter(a):
    df = session().read.parquet(a.path)
    spectral.butterworth_spatial(df, a.variable, a.by.split(","), a.dx, a.cutoff, a.order, kind=a.kind).write.parquet(a.output)


def _spectra(a):
    df = session().read.parquet(a.path)
    spectral.power_spectrum(df, a.variable, a.by.split(","), a.order, a.spacing).write.parquet(a.output)


def _report(a):
    df = session().read.parquet(a.path)
    row = reports.comparison_report(df, a.model, a.observed).first().asDict()
    (reports.write_html_report if a.output.endswith(".html") else reports.write_json_report)({"comparison": row}, a.output)


def _channels(a):
    spark = session()
    read = binary.read_binary_output if a.path.lower().endswith((".outb", ".bin")) else text.read_ascii_output
    _show(read(spark, a.path).groupBy("channel", "unit").agg(*stats.class_statistics("value")).orderBy("channel").collect())


def _doctor(a):
    print(json.dumps(doctor.environment_report(), indent=2))


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="aeroframe")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *arguments):
        c = sub.add_parser(name)
        for names, options in arguments:
            c.add_argument(*names.split("|"), **options)
        c.set_defaults(run=run)

    need = {"required": True}
    command("discover", _discover, ("directory", {}), ("--domain", {}), ("--start", {}), ("--end", {}), ("--recursive", {"action": "store_true"}))
    command("inspect", _inspect, ("path", {}))
    command("validate", _validate, ("path", {}))
    command("concat", _concat, ("paths", {"nargs": "+"}), ("--variables", need), ("--output", need))
    command("bts-info", _bts_info, ("path", {}))
    command("bts-compare", _bts_compare, ("first", {}), ("second", {}))
    command("extract", _extract, ("path", {}), ("--latitude", need | {"type": float}), ("--longitude", need | {"type": float}), ("--lat", {"default": "lat"}), ("--lon", {"default": "lon"}), ("--output", need))
    command("filter", _filter, ("path", {}), ("--variable", need), ("--by", need), ("--dx", need | {"type": float}), ("--cutoff", need | {"type": float}), ("--order", {"type": int, "default": 2}), ("--kind", {"default": "lowpass"}), ("--output", need))
    command("spectra", _spectra, ("path", {}), ("--variable", need), ("--by", need), ("--order", {"default": "n"}), ("--spacing", {"type": float, "default": 1.0}), ("--output", need))
    command("report", _report, ("path", {}), ("--model", need), ("--observed", need), ("--output", need))
    command("channels", _channels, ("path", {}))
    command("doctor", _doctor)
    return p


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    args.run(args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
