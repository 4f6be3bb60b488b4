"""Streams over landed files, and readers and writers, on small hand-made inputs."""

import json
import os

import pytest

from wakeline.sources import archive, csv_positions, lists
from wakeline.streaming import positions


def message(mmsi, time, lat=1.0, lon=2.0, sog=5.0):
    return json.dumps({"MessageType": "PositionReport", "MetaData": {"MMSI": mmsi, "ShipName": "X", "latitude": lat, "longitude": lon, "time_utc": time}, "Message": {"PositionReport": {"Sog": sog, "Cog": 400.0, "TrueHeading": 511, "NavigationalStatus": 0}}})


def run(stream, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


@pytest.fixture
def landed(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    first = [message(123, "2024-01-01 00:00:00.123456789 +0000 UTC"), message(123, "2024-01-01 00:00:00.123456789 +0000 UTC"), message(456, "2024-01-01 00:05:00 +0000 UTC"), message(None, "2024-01-01 00:00:00 +0000 UTC"), message(7, "no time")]
    second = [message(123, "2024-01-01 05:00:00 +0000 UTC", 3.0, sog=102.3), message(123, "2024-01-01 00:30:00 +0000 UTC")]
    third = [message(123, "2024-01-01 06:00:00 +0000 UTC")]
    for i, part in enumerate((first, second, third)):
        (folder / f"{i}.json").write_text("\n".join(part))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in this order
    return str(folder)


def test_messages_are_mapped(spark, landed):
    rows = positions.from_messages(spark.read.schema(positions.MESSAGE).json(landed)).collect()
    assert len(rows) == 6 and {r.mmsi for r in rows} == {"000000123", "000000456"}
    assert all(r.cog is None and r.heading is None for r in rows) and any(r.sog is None for r in rows)


def test_repeats_go(spark, landed, tmp_path):
    rows = run(positions.without_repeats(positions.read_messages(spark, landed, 1)), "repeats", tmp_path)
    assert len(rows) == len({(r.mmsi, r.ts) for r in rows}) == 5


def test_windows(spark, landed, tmp_path):
    rows = run(positions.tumbling(positions.read_messages(spark, landed)), "windows", tmp_path, "complete")
    assert sorted((r.reports, r.vessels) for r in rows) == [(1, 1), (1, 1), (1, 1), (3, 2)]


def test_gaps_open_and_close(spark, landed, tmp_path):
    rows = run(positions.gaps(positions.read_messages(spark, landed, 1)), "silences", tmp_path)
    assert any(r.mmsi == "000000123" and not r.open and r.gap_end.hour == 5 for r in rows)
    assert any(r.mmsi == "000000456" and r.open and r.gap_end is None for r in rows)


@pytest.mark.parametrize("compact", [2, 3, 20])
def test_latest_reports(spark, landed, tmp_path, compact):
    folder = str(tmp_path / "latest")
    positions.write_latest(positions.read_messages(spark, landed, 1), folder, str(tmp_path / "cp"), compact).awaitTermination(120)
    assert {r.mmsi: r.ts.hour for r in positions.read_latest(spark, folder, compact).collect()} == {"000000123": 6, "000000456": 0}
    assert (tmp_path / "latest" / "whole").exists() == (compact < 20)


def test_archive_and_restore(spark, tmp_path):
    points = spark.createDataFrame([(i, i % 2, i * 86_400 * 20, "ais") for i in range(6)], "point_id long, vessel_id long, t long, source string")
    gaps = spark.createDataFrame([(1,)], "gap_id long")
    path = str(tmp_path / "archive")
    archive.archive(points, gaps, 86_400 * 60, path)
    left = archive.archive(points, gaps, 86_400 * 60, path)  # again, as after a failure
    assert spark.read.parquet(path).count() + left.count() == points.count()
    assert sorted(r.point_id for r in left.collect()) == [1, 3, 4, 5]
    assert sorted(r.point_id for r in archive.restore(spark, path, left).collect()) == list(range(6))
    assert archive.retained(points, 86_400 * 100, {"ais": 41}).count() == 3


@pytest.mark.parametrize("fmt", archive.FORMATS)
def test_export(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    archive.export(spark.range(10).selectExpr("id", "id * 2 AS twice"), path, fmt, ["twice"], "id > 2", ["id"], 3)
    back = spark.read.option("header", True).format(fmt).load(path)
    assert sorted(int(r.twice) for r in back.collect()) == [6, 8, 10]
    with pytest.raises(ValueError):
        archive.export(spark.range(1), path, "xml")


def test_csv_positions(spark, tmp_path):
    (tmp_path / "p.csv").write_text("MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading\n123456789,2024-01-01T00:00:00,1,2,102.3,360,511\n123456789,2024-01-01T00:00:00,99,2,1,1,1\n123456789,bad,1,2,1,1,1\n970000001,2024-01-01T00:00:00,1,2,1,1,1\n")
    good, bad = csv_positions.read_csv(spark, str(tmp_path / "p.csv"))
    assert [(r.sog, r.cog, r.heading) for r in good.collect()] == [(None, None, None)]
    assert sorted(r.reject for r in bad.collect()) == ["id", "position", "time"]


def test_lists(spark, tmp_path):
    (tmp_path / "g.csv").write_text("imo,mmsi,vessel_name,date_listed,notes\n1234567,,A,2024-02-03,x\n,111111111,B,never,\n9999999,999,C,,\n")
    vessels = spark.createDataFrame([(1, "1234567", "222222222"), (2, None, "111111111")], "vessel_id long, imo string, mmsi string")
    rows = {r.vessel_name: (r.vessel_id, r.date_listed is not None) for r in lists.linked(lists.ground_truth(spark, str(tmp_path / "g.csv"), "listed"), vessels).collect()}
    assert rows == {"A": (1, True), "B": (2, False), "C": (None, False)}
    (tmp_path / "e.json").write_text(json.dumps({"id": "a", "schema": "Vessel", "caption": "V", "properties": {"imoNumber": ["IMO1234567"], "flag": ["pa"]}, "first_seen": "2024-01-02T00:00:00"}) + "\n" + json.dumps({"id": "b", "schema": "Person", "caption": "P"}))
    assert [(r.name, r.imo, r.flag) for r in lists.entities(spark, str(tmp_path / "e.json")).collect()] == [("V", "1234567", "PA")]
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"mmsi": 5, "geometry": {"coordinates": [2.0, 1.0]}, "properties": {"sog": 3.0, "cog": 360.0, "navStat": 1, "timestampExternal": 1_700_000_000_000}}]}))
    assert [(r.mmsi, r.lat, r.lon, r.cog) for r in lists.features(spark, str(tmp_path / "f.json")).collect()] == [("000000005", 1.0, 2.0, None)]
    (tmp_path / "n.csv").write_text("Date_Mscan,Lat_DNB,Lon_DNB,Rad_DNB,QF_Detect\n2024-01-01 01:00:00,1,2,9.5,1\n2024-01-01 01:00:00,1,2,9.5,2\n")
    assert lists.night_lights(spark, str(tmp_path / "n.csv")).count() == 1
