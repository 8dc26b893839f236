"""Round trips and readers."""

import struct
from unittest.mock import MagicMock

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroframe import cli, doctor
from aeroframe.operators import fields
from aeroframe.plans import domains
from aeroframe.sources import archive, binary, discovery, netcdf, sinks, text


@pytest.fixture
def field(spark):
    rng = np.random.default_rng(42)
    v = rng.normal(10, 2, (12, 4, 5, 3))
    rows = [(t, k, j, *map(float, v[t, k, j])) for t in range(12) for k in range(4) for j in range(5)]
    df = spark.createDataFrame(rows, "t int, k int, j int, u double, v double, w double")
    return df, fields.with_mean_speed(df, fields.FieldMeta(12, 4, 5, 8.0, 10.0, 0.2, 30.0, 0.0, "test field"))


def test_full_field_round_trip(spark, field, tmp_path):
    df, meta = field
    path = binary.write_bts(df, meta, str(tmp_path / "a.bts"))
    assert binary.validate_bts(spark, str(path), df).count() == df.count()
    got = binary.read_meta(spark, str(path)).first()
    assert (got["nt"], got["description"]) == (12, "test field") and got["mean_speed"] == pytest.approx(meta.mean_speed, rel=1e-6)
    with pytest.raises(ValueError):
        binary.validate_bts(spark, str(path), df.withColumn("u", F.col("u") + 1))


def test_constant_components_keep_their_value(spark, tmp_path):
    df = fields.step_field(spark, [7.0, 8.0], 1.0, 0.5, 2, 3).withColumn("v", F.lit(0.2)).withColumn("w", F.lit(-0.05))
    path = binary.write_bts(df, fields.FieldMeta(4, 3, 2, 1.0, 1.0, 0.5, 1.0, 0.0, mean_speed=7.5), str(tmp_path / "c.bts"))
    got = binary.read_bts(spark, str(path)).agg(F.max(F.abs(F.col("v") - 0.2)), F.max(F.abs(F.col("w") + 0.05))).first()
    assert max(got) < 1e-7


def test_wnd_round_trip(spark, field, tmp_path):
    df, meta = field
    path = binary.write_bladed_wnd(df, meta, str(tmp_path / "a.wnd"), clockwise=True)
    back = binary.read_bladed_wnd(spark, str(path), clockwise=True).drop("path")
    assert fields.max_error(df, back).first()["max_abs_error"] < 0.002


def test_small_contents_reach_the_store_together(monkeypatch):
    session = MagicMock()
    monkeypatch.setattr(sinks, "PIECE", 1000, raising=False)
    with sinks.opened(session, "store:/a") as write:
        for n in range(5000):
            write(bytes([n % 251]))
        write(b"x" * 2500)
    calls = session._jvm.org.apache.hadoop.fs.Path().getFileSystem().create().write.call_args_list
    assert b"".join(bytes(c.args[0]) for c in calls) == bytes(n % 251 for n in range(5000)) + b"x" * 2500
    assert len(calls) == 8


@pytest.mark.parametrize("kind", ["bts", "wnd"])
def test_runs_of_a_field_are_dealt_out(spark, field, tmp_path, monkeypatch, kind):
    df, meta = field
    path = str(tmp_path / f"runs.{kind}")
    if kind == "bts":
        binary.write_bts(df, meta, path)
    else:
        binary.write_bladed_wnd(df, meta, path, clockwise=True)
    read = (lambda: binary.read_bts(spark, path)) if kind == "bts" else lambda: binary.read_bladed_wnd(spark, path, clockwise=True)
    whole = sorted(read().drop("path").collect())
    monkeypatch.setattr(binary, "RUN", 50, raising=False)  # two steps of 20 cells
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = read().withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len({r["task"] for r in got}) > 1 and {r["path"].rsplit("/", 1)[1] for r in got} == {f"runs.{kind}"}
    assert sorted((r["t"], r["k"], r["j"], r["u"], r["v"], r["w"]) for r in got) == [tuple(r) for r in whole] and len(got) == 240


def test_other_binaries(spark, tmp_path):
    (tmp_path / "hub.bin").write_bytes(np.arange(28, dtype="<f4").tobytes())
    assert binary.read_hub_height_binary(spark, str(tmp_path / "hub.bin")).count() == 2
    (tmp_path / "p.pts").write_bytes(struct.pack("<hii5f", -99, 3, 2, 10, 5, 10, 20, 30) + np.zeros(12, "<i2").tobytes())
    got = binary.read_coherent_points(spark, str(tmp_path / "p.pts")).orderBy("time").toPandas()
    assert list(got["u"]) == [5] * 4 and list(got["time"]) == [0, 0, 2, 2]
    names = b"".join(n.ljust(10).encode() for n in ("Time", "Wind", "")) + b"".join(n.ljust(10).encode() for n in ("(s)", "(m/s)", "(kN)"))
    content = struct.pack("<hiidd", 2, 2, 3, 0.0, 0.5) + np.ones(2, "<f4").tobytes() + np.zeros(2, "<f4").tobytes() + struct.pack("<i", 0) + names + np.arange(6, dtype="<i2").tobytes()
    (tmp_path / "o.outb").write_bytes(content)
    got = binary.read_binary_output(spark, str(tmp_path / "o.outb")).where("channel = 'Wind'").orderBy("time").toPandas()
    assert list(got["time"]) == [0, 0.5, 1] and list(got["value"]) == [0, 2, 4] and set(got["unit"]) == {"m/s"}
    assert {r["channel"] for r in binary.read_binary_output(spark, str(tmp_path / "o.outb")).collect()} == {"Wind", "channel_2"}


def test_text_sources(spark, tmp_path):
    (tmp_path / "s.tslist").write_text("# head\n! more\n\nCabauw tower              cab    51.9710     4.9270\nnot a station\n")
    got = text.read_tslist(spark, str(tmp_path / "s.tslist")).collect()
    assert [tuple(r) for r in got] == [("Cabauw tower", "cab", 51.971, 4.927)]
    text.write_tslist(spark.createDataFrame(got), str(tmp_path / "t.tslist"))
    assert text.read_tslist(spark, str(tmp_path / "t.tslist")).count() == 1
    (tmp_path / "o.out").write_text("junk\nTime Wind\n(s) (m/s)\n0 1\n1 2\n")
    assert [r["value"] for r in text.read_ascii_output(spark, str(tmp_path / "o.out")).orderBy("time").collect()] == [1, 2]
    (tmp_path / "p.dat").write_text('10  NBlades - number\n"a b"  Name - text\n')
    assert {r["label"]: r["value"] for r in text.read_parameters(spark, str(tmp_path / "p.dat")).collect()} == {"NBlades": "10", "Name": "a b"}
    text.update_parameters(str(tmp_path / "p.dat"), {"NBlades": 3, "Name": "c"})
    assert (tmp_path / "p.dat").read_text() == '3  NBlades - number\n"c"  Name - text\n'
    with pytest.raises(KeyError):
        text.update_parameters(str(tmp_path / "p.dat"), {"Nope": 1})
    (tmp_path / "obs.csv").write_text("when;wind\n2020-01-01 00:00:00;5\n2020-01-01 01:00:00;6\n")
    assert text.read_csv(spark, str(tmp_path / "obs.csv"), "when", ["wind"], ";").agg(F.sum("wind")).first()[0] == 11
    (tmp_path / "f.txt").write_text("a\nb\nc\nd\n2 2 8 10 0.5 90 7\nx\nx\n-5 5\nx\nx\n-4 4\nx\n0 7 1 2 3 4\n")
    full = text.read_full_field_text(spark, str(tmp_path / "f.txt")).orderBy("k", "j").toPandas()
    assert list(full["u"]) == [2, 1, 4, 3] and list(full["z"]) == [85, 85, 95, 95]


def test_station_family(spark, tmp_path):
    head = "Cabauw".ljust(26) + " 1  2".ljust(7) + "cab".ljust(6) + "51.971".rjust(7) + " " + "4.927".rjust(8) + "  (" + " 12".rjust(5) + "," + " 34 " + ") (" + " 51.970" + "," + "  4.930" + ")  -0.7 meters"
    (tmp_path / "cab.d01.TS").write_text(head + "\n" + " ".join(str(k) for k in range(19)) + "\n")
    (tmp_path / "cab.d01.UU").write_text("0.0 1 2 3\n0.5 4 5 6\n")
    surface, profiles = text.read_station_family(spark, str(tmp_path / "cab.d01.TS"))
    assert surface.first()["ts_hour"] == 1 and profiles.count() == 6
    assert text.read_station_header(spark, str(tmp_path / "cab.d01.TS")).first()["name"] == "Cabauw"
    (tmp_path / "bad.TS").write_text("x\n1 2 3\n")
    with pytest.raises(Exception, match="19 columns"):
        text.read_station_surface(spark, str(tmp_path / "bad.TS")).collect()


def test_namelist_and_domains(spark, tmp_path):
    path = tmp_path / "n.wps"
    path.write_text("&share\n max_dom = 2,\n start_date = 'a',\n end_date = 'b',\n/\n&geogrid\n parent_id = 1, 1,\n parent_grid_ratio = 1, 3,\n i_parent_start = 1, 10,\n j_parent_start = 1, 10,\n e_we = 100, 31,\n e_sn = 100, 31,\n dx = 9000,\n dy = 9000,\n flag = .true.,\n odd = 1d0,\n/\n")
    got = text.read_namelist(str(path))
    assert got["geogrid"]["flag"] is True and got["geogrid"]["odd"] == "1d0"
    nest = {r["domain"]: r for r in domains.place_domains(domains.nest_table(spark, got), 9000, 9000).collect()}
    assert nest[2]["dx"] == 3000 and nest[2]["x0"] == 81000 and nest[1]["parent"] == 0
    text.update_namelist_dates(str(path), "2020-01-01", "2020-01-02", domains=2)
    assert text.read_namelist(str(path))["share"]["start_date"] == ["2020-01-01"] * 2
    got["geogrid"]["e_we"] = [100, 400]
    with pytest.raises(ValueError):
        domains.place_domains(domains.nest_table(spark, got), 9000, 9000)
    eta = [r["eta"] for r in domains.eta_levels(spark, 5).orderBy("level").collect()]
    assert eta[0] == 1 and eta[-1] == 0 and eta == sorted(eta, reverse=True)


def test_discovery(spark, tmp_path):
    for name in ("wrfout_d01_2020-01-01_00_00_00", "wrfout_d02_2020-01-01_06:00:00", "wrfout_d02_2020-01-02_00_00_00", "other.txt"):
        (tmp_path / name).write_text("x")
    assert discovery.discover(spark, str(tmp_path)).count() == 3
    got = discovery.discover(spark, str(tmp_path), "2", "2020-01-01 06:00:00", "2020-01-01 06:00:00").collect()
    assert [r["domain"] for r in got] == ["d02"]
    with pytest.raises(NotADirectoryError):
        discovery.discover(spark, str(tmp_path / "none"))


def _classic(times, dx=1000.0):
    """A small CDF-1 file: Times(Time, 19), T(Time, south_north 1, west_east 2)."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    dims = [("Time", 0), ("DateStrLen", 19), ("south_north", 1), ("west_east", 2)]
    head = b"CDF\x01" + struct.pack(">i", len(times)) + struct.pack(">ii", 10, len(dims)) + b"".join(name(n) + struct.pack(">i", s) for n, s in dims)
    head += struct.pack(">ii", 12, 1) + name("DX") + struct.pack(">ii", 6, 1) + struct.pack(">d", dx)

    def variables(begin):
        out = struct.pack(">ii", 11, 2)
        out += name("Times") + struct.pack(">iii", 2, 0, 1) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 2, 20, begin)
        return out + name("T") + struct.pack(">iiii", 3, 0, 2, 3) + struct.pack(">ii", 0, 0) + struct.pack(">iii", 5, 8, begin + 20)

    begin = len(head) + len(variables(0))
    body = b"".join(pad(t.encode()) + struct.pack(">ff", n, n + 0.5) for n, t in enumerate(times))
    return head + variables(begin) + body


def test_netcdf_sequence(spark, tmp_path):
    a, b, c = (str(tmp_path / n) for n in "abc")
    for path, content in ((a, _classic(["2020-01-01_00:00:00", "2020-01-01_01:00:00"])), (b, _classic(["2020-01-01_02:00:00"])), (c, _classic(["2020-01-01_03:00:00"], 500.0))):
        with open(path, "wb") as f:
            f.write(content)
    got = netcdf.open_sequence(spark, [a, b], ["T"]).orderBy("t", "i").toPandas()
    assert list(got["t"]) == [0, 0, 1, 1, 2, 2] and list(got["T_"]) == [0, 0.5, 1, 1.5, 0, 0.5]
    with pytest.raises(ValueError, match="grids"):
        netcdf.open_sequence(spark, [a, c], ["T"])
    with pytest.raises(ValueError, match="rise"):
        netcdf.open_sequence(spark, [b, a], ["T"])


def test_archive_doctor_and_cli(tmp_path, capsys):
    (tmp_path / "x").write_text("1")
    archive.archive_outputs([str(tmp_path / "x")], str(tmp_path / "to"))
    with pytest.raises(FileExistsError):
        archive.archive_outputs([str(tmp_path / "x")], str(tmp_path / "to"))
    assert doctor.environment_report()["packages"]["pyspark"]
    assert cli.main(["doctor"]) == 0 and "pyspark" in capsys.readouterr().out


def test_conic_projection(spark):
    # a published worked example on an older ellipsoid
    old = domains.Conic(23, -96, 33, 45, (6378206.4, 0.00676866))
    x, y = old.forward(-75, 35)
    assert (x, y) == (pytest.approx(1894410.9, abs=0.1), pytest.approx(1564649.5, abs=0.1))
    lon, lat = old.inverse(F.lit(x), F.lit(y))
    assert tuple(spark.range(1).select(lon, lat).first()) == (pytest.approx(-75, abs=1e-8), pytest.approx(35, abs=1e-8))
    nest = spark.createDataFrame([(1, 0, 1, 1, 1, 101, 101)], domains.NEST)
    got = domains.geographic_corners(domains.place_domains(nest, 9000, 9000), 52.0, 5.0, 30.0, 60.0, 5.0).orderBy("corner").collect()
    west, east = got[0], got[1]
    assert west["latitude"] == pytest.approx(east["latitude"]) and west["longitude"] + east["longitude"] == pytest.approx(10)
    south = domains.Conic(-30, 150, -30, -30)
    lon, lat = south.inverse(*map(F.lit, south.forward(170, -40)))
    assert tuple(spark.range(1).select(lon, lat).first()) == (pytest.approx(170), pytest.approx(-40))


def test_hub_height_of_the_caller(spark, field, tmp_path):
    df, meta = field
    path = binary.write_bladed_wnd(df, meta, str(tmp_path / "h.wnd"))
    assert binary.read_meta(spark, path, "wnd", hub_height=42).first()["hub_height"] == 42
