"""Readers of landed vendor files on small files made here."""

import json

import pytest

from wakeline.sources import feeds, lists


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text if isinstance(text, str) else json.dumps(text))
    return str(tmp_path / name)


def test_daily_archives(spark, tmp_path):
    us = put(tmp_path, "us.csv", "MMSI,BaseDateTime,LAT,LON,SOG,COG,Heading,VesselName,IMO,CallSign,VesselType,Status,Length,Width,Draft,Cargo\n367000001,2024-01-02T03:04:05,29.5,-90.1,102.3,360.0,511,A B ,IMO9074729,X,80,0,1,1,9.5,80\n1,2024-01-02T03:04:05,99,0,1,1,1,x,,,,,,,,\n367000002,2024-01-02T03:04:05,50.0,0.0,3.5,90,1,C,,,70,1,1,1,,\n")
    got = {r.mmsi: r for r in feeds.us_archive(spark, us).collect()}
    assert set(got) == {"367000001", "367000002"} and got["367000001"].sog is None and got["367000001"].cog is None and got["367000001"].imo == "9074729" and got["367000002"].sog == 3.5
    zones = spark.createDataFrame([(29.0, 30.0, -91.0, -89.0)], "min_lat double, max_lat double, min_lon double, max_lon double")
    assert [r.mmsi for r in feeds.us_archive(spark, us, zones).collect()] == ["367000001"]
    dk = put(tmp_path, "dk.csv", "# Timestamp,Type of mobile,MMSI,Latitude,Longitude,Navigational status,ROT,SOG,COG,Heading,IMO,Callsign,Name,Ship type\n31/12/2023 23:59:59,Class A,219000001,55.1,10.2,x,,12.1,45,,Unknown,,Nord,Tanker\n31/12/2023 23:59:59,Class B,219000002,55.1,10.2,x,,12.1,45,,,,Syd,Fishing\n")
    r = feeds.danish_archive(spark, dk).collect()
    assert len(r) == 1 and r[0].ais_class == "A" and str(r[0].ts) == "2023-12-31 23:59:59" and r[0].imo is None
    assert feeds.danish_archive(spark, dk, ()).count() == 2


def test_rest_and_stream_dumps(spark, tmp_path):
    track = put(tmp_path, "t.json", [{"mmsi": 257000001, "msgtime": "2024-01-02T03:04:05+00:00", "latitude": 60.0, "longitude": 5.0, "speedOverGround": 10.0, "courseOverGround": 360.0}, {"mmsi": None, "msgtime": "x"}])
    r = feeds.tracks(spark, track).collect()
    assert len(r) == 1 and r[0].cog is None and r[0].sog == 10.0
    area = put(tmp_path, "a.json", [{"ERROR": False}, [{"MMSI": 1234567, "TIME": "2024-01-02 03:04:05 GMT", "LATITUDE": 1.0, "LONGITUDE": 2.0, "SOG": 102.4, "COG": 10.0}]])
    assert [(x.mmsi, x.sog) for x in feeds.area_positions(spark, area).collect()] == [("001234567", None)]
    assert feeds.area_positions(spark, put(tmp_path, "e.json", [{"ERROR": "true"}, []])).count() == 0
    page = put(tmp_path, "g.json", {"data": {"vessels": {"nodes": [{"staticData": {"mmsi": 273000001, "name": "N"}, "lastPositionUpdate": {"timestamp": "2024-01-02T03:04:05.000Z", "latitude": 3.0, "longitude": 4.0, "speed": 5.0}}]}}})
    assert feeds.satellite_positions(spark, page).first().lat == 3.0
    calls = spark.createDataFrame([("2024-01-05",), ("2024-01-09",), ("2024-02-01",)], "ts string").selectExpr("cast(ts as timestamp) as ts")
    assert feeds.within_quota(calls, "2024-01", 3) and not feeds.within_quota(calls, "2024-01", 2)


def test_sentences(spark):
    # A well-known sample sentence of type 1.
    lines = spark.createDataFrame([("!AIVDM,1,1,,B,177KQJ5000G?tO`K>RA1wUbN0TKH,0*5C", "2024-01-01"), ("noise", "2024-01-01"), (None, "2024-01-01"), ("!AIVDM,2,1,3,B,55P5TL01VIaAL@7W,0*1C", "2024-01-01")], "value string, ts string").selectExpr("value", "cast(ts as timestamp) as ts")
    r = feeds.sentences(lines).collect()
    assert len(r) == 1 and r[0].mmsi == "477553000" and r[0].nav_status == 5
    assert abs(r[0].lat - 47.58283) < 1e-4 and abs(r[0].lon + 122.34583) < 1e-4 and r[0].sog == 0.0 and r[0].cog == 51.0


def test_events_sweeps_scenes_and_voyages(spark, tmp_path):
    v = {"ssvid": "273000001", "name": "N"}
    events = [
        {"id": "1", "type": "GAP", "start": "2024-01-01T00:00:00Z", "end": "2024-01-02T00:00:00Z", "position": {"lat": 1.0, "lon": 2.0}, "vessel": v, "gap": {"durationHours": 24.0, "distanceKm": 185.2}},
        {"id": "1", "type": "GAP", "start": "2024-01-01T00:00:00Z", "end": "2024-01-02T00:00:00Z", "position": {"lat": 1.0, "lon": 2.0}, "vessel": v, "gap": {"durationHours": 24.0, "distanceKm": 185.2}},
        {"id": "2", "type": "encounter", "start": "2024-01-01T00:00:00Z", "end": "2024-01-01T05:00:00Z", "vessel": v, "encounter": {"vessel": {"ssvid": "12345678"}, "medianDistanceKilometers": 0.1}},
        {"id": "3", "type": "port_visit", "start": "2024-01-01T00:00:00Z", "end": "2024-01-01T05:00:00Z", "vessel": v, "port_visit": {"startAnchorage": {"name": "P", "flag": "RUS"}}},
        {"id": "4", "type": "gap", "start": "2024-01-03T00:00:00Z", "end": "2024-01-02T00:00:00Z", "vessel": v},
    ]
    gaps, met, visits = feeds.vendor_events(spark, put(tmp_path, "e.json", {"entries": events}))
    assert [(r.id, round(r.nm, 6)) for r in gaps.collect()] == [("1", 100.0)] and met.first().other_mmsi == "012345678" and met.first().metres == 100.0 and visits.first().port == "P"
    sweep = put(tmp_path, "s.json", "\n".join(json.dumps(x) for x in ({"corridor_id": 1, "date": "2024-01-01", "lat": 1.0, "lon": 1.0, "vesselIDs": 0}, {"corridor_id": 1, "date": "2024-01-02", "lat": 1.0, "lon": 1.0, "vesselIDs": 2, "detections": 3}, {"corridor_id": 1, "date": "bad", "lat": 1.0, "lon": 1.0})))
    every = feeds.radar_detections(spark, sweep)
    assert sorted((str(r.day), r.detections, r.matched) for r in every.collect()) == [("2024-01-01", 1, False), ("2024-01-02", 3, True)]
    assert feeds.radar_detections(spark, sweep, every.filter("matched").select("corridor_id", "day")).count() == 1
    found = {"value": [{"Id": "a", "Name": "S1A_x", "ContentDate": {"Start": "2024-01-01T00:00:00.000Z"}, "Footprint": "geography'SRID=4326;POLYGON((0 0,1 0,1 1,0 0))'"}, {"Id": "b", "Name": "S2B_x", "ContentDate": {"Start": "2024-01-01T00:00:00.000Z"}, "Attributes": [{"Name": "cloudCover", "Value": "80.5"}]}]}
    r = feeds.scenes(spark, put(tmp_path, "c.json", found)).collect()
    assert [(x.scene_id, x.platform, x.footprint[:7]) for x in r] == [("a", "S1A", "POLYGON")]
    known = spark.createDataFrame([("9074729",)], "imo string")
    trips = {"data": [{"id": "1", "ship_imo": "9074729", "departure_date": "2024-01-01T10:00:00", "commodity": "crude", "value_tonne": 5.0}, {"id": "2", "ship_imo": "1"}]}
    assert [(r.voyage_id, str(r.departed)) for r in feeds.voyages(spark, put(tmp_path, "v.json", trips), known).collect()] == [("1", "2024-01-01")]


def test_enrichment_registry_and_zones(spark):
    vessels = spark.createDataFrame([("1", "A", None, None), ("2", None, "7", 5.0)], "mmsi string, name string, imo string, dwt double")
    first = spark.createDataFrame([("1", "X", "9"), ("2", "B", "8")], "mmsi string, name string, imo string")
    second = spark.createDataFrame([("1", "3", 80.0)], "mmsi string, imo string, dwt double")
    assert sorted(tuple(r) for r in feeds.enriched(vessels, first, second).collect()) == [("1", "A", "9", 80.0), ("2", "B", "7", 5.0)]
    page = "<table><tr><th>Company</th><th>Role</th><th>Since</th></tr><tr><td><b>Sea&nbsp;Co</b></td><td>Owner</td><td>01/02/2023</td></tr><tr><td>x</td></tr></table>"
    r = feeds.registry_history(spark.createDataFrame([("1", page), ("2", None)], "imo string, html string")).collect()
    assert [(x.imo, x.company, x.role, str(x.since)) for x in r] == [("1", "Sea Co", "Owner", "2023-02-01")]
    zones = [{"name": "b", "geometry": "POLYGON((0 0, 2 0, 2 1, 0 1, 0 0))", "weight": 2}, {"name": "a", "geometry": "POINT(5 6)"}]
    assert [(x.corridor_id, x.corridor, x.max_lon, x.max_lat) for x in feeds.configured_zones(spark, zones).orderBy("corridor_id").collect()] == [(1, "a", 5.0, 6.0), (2, "b", 2.0, 1.0)]
    with pytest.raises(ValueError):
        feeds.configured_zones(spark, zones + zones)


def test_lists(spark, tmp_path):
    row = '1,"BAD SHIP",vessel,SDN,-0-,ABC,Tanker,-0-,-0-,Iran,-0-,"Vessel Registration Identification IMO 9074729; MMSI 422000001"\n2,"MAN",individual,SDN,,,,,,,,\n'
    for head in ("", "ent_num,SDN_Name,SDN_Type,Program,Title,Call_Sign,Vess_type,Tonnage,GRT,Vess_flag,Vess_owner,Remarks\n"):
        r = lists.sanctioned_vessels(spark, put(tmp_path, f"s{len(head)}.csv", head + row)).collect()
        assert [tuple(x) for x in r] == [("1", "BAD SHIP", "Iran", "9074729", "422000001")]
    listed = lists.listed_csv(spark, put(tmp_path, "k.csv", "Vessel Name,IMO number,Date\n Ship ,IMO 1234567,2024-01-05\n,,\n"), {"name": "vessel name", "imo": "imo number", "listed": "date"})
    assert [(x.name, x.imo, str(x.listed)) for x in listed.collect()] == [("Ship", "1234567", "2024-01-05")]
    assert [tuple(x) for x in lists.listed_json(spark, put(tmp_path, "f.json", [{"name": "N", "imo": "IMO 7654321", "flag": "ir"}, {}])).collect()] == [("N", "7654321", None, "IR")]
    vessels = spark.createDataFrame([(1, "ship", "1234567", "1"), (2, "n", None, "2")], "vessel_id long, name string, imo string, mmsi string")
    entries = spark.createDataFrame([("Q", "1234567", None), ("N", None, None), ("Z", "1111111", None)], "name string, imo string, mmsi string")
    got = {x.name: (x.vessel_id, x.stub) for x in lists.stub_vessels(entries, vessels).collect()}
    assert got["Q"] == (1, False) and got["N"] == (2, False) and got["Z"][1]
    seen = [{"id": "a", "imo": "1", "date": "2024-01-01", "detained": True, "deficiencies": 4}, {"id": "a", "imo": "1", "date": "2024-01-01", "detained": True, "deficiencies": 4}, {"id": "b", "imo": "1", "date": "2019-01-01", "deficiencies": 9}, {"id": "c", "imo": "2", "date": "2023-06-01", "ban": True}]
    rows, summary = lists.inspections(spark, put(tmp_path, "p.json", seen), "2024-06-01")
    assert rows.count() == 3 and {x.imo: (x.inspections, x.detentions, x.worst) for x in summary.collect()} == {"1": (1, 1, 4), "2": (1, 1, 0)}
