"""Register matching end to end, and files, writers and the watched folder."""

import json
import re

import pytest
from pyspark.sql import functions as F

from gridfold.functions.geometry import feature
from gridfold.operators import density, filters, lookup, register
from gridfold.plans import pipelines, views
from gridfold.sources import readers, writers
from gridfold.streaming.register_drop import clear_register, latest_results, publish, retire, watch_registers

REGISTER = [
    ("A1", "Flat 1, 5 High St, OX1 1AA"), ("A2", "Flat 2, 5 High St, OX1 1AA"), ("", "5 High St, OX1 1AA"), ("A4", "9 Nowhere, ox1  1aa"),
    ("A5", "Room 1, 9 Nowhere, OX1 1AA"), ("A6", "3 Low Rd, OX9 9ZZ"), ("A7", "no code here"), ("A8", "   "), ("A9", "5 High St, OX9 9ZZ"),
]


def frames(spark):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(REGISTER)], "ord long, `Register ID` string, Address string")
    made = spark.createDataFrame([(1, "5 high st", "OX1 1AA"), (2, "5 high st", "OX2 2BB")], "ord long, match_key string, addr_postcode string")
    places = spark.createDataFrame([(1, "OX1 1AA", "old", 0.0, 0.0), (2, "ox1 1aa", "North", 51.5, -1.5)], "ord long, postcode string, lsoa string, centroid_lat double, centroid_lon double")
    areas = spark.createDataFrame([(1, "North"), (2, "South")], "area_ord long, area_name string")
    return rows, made, places, areas


def test_register_to_classes(spark):
    rows, made, places, areas = frames(spark)
    got = pipelines.register_to_classes(rows.repartition(3), made, places, areas)
    group = {r["match_key"]: r for r in got["building_groups"].collect()}["5 high st"]
    assert (group["hmo_id"], group["sub_units"], group["entry_count"], group["building_ord"], group["lsoa"]) == ("A1, A2, A9", "Flat 1, Flat 2", 4, 1, "North")
    fallback = got["fallback_groups"].collect()
    assert [(r["group_key"], r["hmo_id"], r["sub_units"], r["entry_count"], r["pc_lon"]) for r in fallback] == [("9 nowhere", "A4, A5", "Room 1", 2, -1.5)]
    assert {r["area_name"]: r["value"] for r in got["areas"].collect()} == {"North": 5, "South": 0}
    funnel = got["funnel"].first().asDict()
    assert funnel == {"total": 8, "matched": 1, "fallback": 1, "no_postcode": 1, "no_lsoa": 2, "multi_household": 2}
    assert funnel["total"] == 5 + funnel["no_postcode"] + funnel["no_lsoa"]
    strict = register.match_register(pipelines.with_roles(rows, "ord"), made, places, require_postcode=True)
    assert strict.where("kind = 'building'").count() == 3


def test_empty_register(spark):
    rows, made, places, areas = frames(spark)
    with pytest.raises(ValueError, match="empty"):
        pipelines.register_to_classes(rows.limit(0), made, places, areas)
    matched = register.match_register(pipelines.with_roles(rows.limit(0), "ord"), made, places)
    assert register.match_funnel(matched).first()[:] == (0, 0, 0, 0, 0, 0) and register.building_groups(matched).count() == 0


def test_features_of_a_register(spark):
    rows, made, places, areas = frames(spark)
    ringed = made.withColumn("ring", F.expr("array(array(0D, 0D), array(1D, 0D), array(1D, 1D), array(0D, 0D))"))
    got = pipelines.register_to_classes(rows, ringed, places, areas)
    polygon, point = (json.loads(got[k].first()["feature"]) for k in ("building_features", "fallback_features"))
    assert polygon["geometry"] == {"type": "Polygon", "coordinates": [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]} and polygon["properties"]["entry_count"] == 4
    assert point["geometry"] == {"type": "Point", "coordinates": [-1.5, 51.5]} and point["properties"]["hmo_id"] == "A4, A5" and "licence_start" in point["properties"]
    back = density.restored_metric(got["areas"], spark.createDataFrame([("South", 7)], "area_name string, value long"))
    assert {r["area_name"]: r["value"] for r in back.collect()} == {"North": 0, "South": 7}


def test_funnel_reads_each_table_once(spark):
    rows, made, places, _ = frames(spark)
    matched = register.match_register(pipelines.with_roles(rows, "ord"), made, places)
    plan = register.match_funnel(matched)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 3


def test_csv_source(spark, tmp_path):
    (tmp_path / "r.CSV").write_bytes('﻿id,Address\r\n1,"5 ""High"" St\nline two"\r\n\r\n2\r\n3,x,surplus\r\n'.encode())
    (tmp_path / "other.txt").write_text("id,Address\n9,no\n")
    rows = readers.register_csv(spark, str(tmp_path)).orderBy("ord").drop("ord").collect()
    assert [r[:] for r in rows] == [("1", '5 "High" St\nline two'), ("2", ""), ("3", "x")]
    with pytest.raises(ValueError, match="found: ord, id, Address"):
        readers.require_columns(readers.register_csv(spark, str(tmp_path)), "neighbourhood")
    with pytest.raises(ValueError, match="empty"):
        readers.require_rows(spark.range(0))
    with pytest.raises(FileNotFoundError, match="run the step"):
        readers.geojson(spark, str(tmp_path / "missing.geojson"))


def test_geojson_and_elements(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},"properties":{"LSOA21NM":"x","n":3}},{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]},"properties":{}},{"type":"Feature","geometry":{"type":"Point","coordinates":[7,8]},"properties":{}}]}')
    got = readers.geojson(spark, str(tmp_path / "a.geojson")).orderBy("ord").collect()
    assert [len(r["rings"] or []) for r in got] == [1, 2, 0] and (got[2]["lon"], got[2]["lat"]) == (7.0, 8.0) and got[0]["properties"]["LSOA21NM"] == "x"
    (tmp_path / "e.json").write_text('{"elements":[{"type":"node","id":1,"lat":51.75,"lon":-1.25,"tags":{"amenity":"pub"}},{"type":"way","id":2,"tags":{},"geometry":[{"lat":1,"lon":2}]}]}')
    rows = readers.map_elements(spark, str(tmp_path / "e.json"))
    assert [(r["ord"], r["id"], r["type"]) for r in rows.orderBy("ord").collect()] == [(0, 1, "node"), (1, 2, "way")]
    areas = spark.createDataFrame([(1, "town", [[[-2.0, 51.0], [-1.0, 51.0], [-1.0, 52.0], [-2.0, 52.0], [-2.0, 51.0]]])], "area_ord long, area_name string, rings array<array<array<double>>>")
    placed, counted = pipelines.area_density(rows, areas)
    assert placed.first()["amenity"] == "pub" and counted.first()["value"] == 1


def test_writers(spark, tmp_path):
    made = spark.createDataFrame([(1, "a", None), (0, "b", "c")], "ord long, name string, extra string").withColumn("feature", feature("Point", F.array(F.lit(1.0), F.lit(2.0)), name=F.col("name"), extra=F.col("extra")))
    assert writers.write_geojson_lines(made, str(tmp_path / "lines")) == 2
    back = readers.geojson(spark, str(tmp_path / "lines"), lines=True).collect()
    assert sorted((r["properties"]["name"], r["lon"]) for r in back) == [("a", 1.0), ("b", 1.0)] and "extra" not in next(r for r in back if r["properties"]["name"] == "a")["properties"]
    document = writers.feature_collection(made).first()[0]
    assert document.index('"b"') < document.index('"a"')
    writers.write_csv(spark.createDataFrame([("x, y", 1)], "neighbourhood string, value long").coalesce(1), str(tmp_path / "csv"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "csv").glob("*.csv"))
    assert text == b'neighbourhood,value\r\n"x, y",1\r\n'
    (tmp_path / "pc.csv").write_text("postcode,lsoa,centroid_lat,centroid_lon\nox1  1aa,N,1.5,bad\n ,x,1,1\n")
    assert [r[1:] for r in readers.postcode_lookup_csv(spark, str(tmp_path / "pc.csv")).collect()] == [("OX1 1AA", "N", 1.5, 0.0)]


def test_order_of_lines(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("".join(f'{{"type":"node","id":{i}}}\n' for i in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.map_elements(spark, str(tmp_path / "e.jsonl"), lines=True)
        assert rows.rdd.getNumPartitions() > 3
        assert [r["id"] for r in rows.orderBy("ord").collect()] == list(range(500))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_metric_file_and_staging(spark, tmp_path):
    (tmp_path / "m.csv").write_text('neighbourhood,value,value_label\n"a, b",3,HMO count\nc,,x\n')
    assert [r[:] for r in readers.area_metric_csv(spark, str(tmp_path / "m.csv")).collect()] == [("a, b", 3.0, "HMO count"), ("c", None, "x")]
    rows = spark.createDataFrame([(1, {"addr:street": "High", "x": "y"})], "id long, tags map<string,string>")
    writers.stage(rows, str(tmp_path / "staged"), "addr:street")
    assert spark.read.parquet(str(tmp_path / "staged")).where("tag_addr_street = 'High'").first()["tags"]["x"] == "y"


def test_watched_folder(spark, tmp_path):
    import os

    rows, made, places, areas = frames(spark)
    out = str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    for k, name in enumerate(("one.csv", "two.CSV", "skip.txt")):
        path = tmp_path / "in" / name
        if k:
            path.write_text("Notes,Property Address,Ref\n" + "".join(f'x,"{a}",{i}\n' for i, a in REGISTER[:8]) + 'y,"5 High St,\nOX9 9ZZ",A9\n')
        else:
            path.write_text("Register ID,Address\n" + "".join(f'{i},"{a}"\n' for i, a in REGISTER[:3]))
        os.utime(path, (1_700_000_000 + k * 10,) * 2)
    query = watch_registers(spark, str(tmp_path / "in"), made, places, areas, out, str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    latest = latest_results(spark, out)
    assert latest["funnel"].first()["total"] == 8 and latest["legend"].count() == 4
    group = {r["match_key"]: r for r in latest["building_groups"].collect()}["5 high st"]
    assert (group["hmo_id"], group["entry_count"]) == ("A1, A2, A9", 4)
    publish(spark, out, {"funnel": latest["funnel"].limit(0)}, f"{tmp_path / 'cp'} 1")  # the batch again
    assert latest_results(spark, out)["funnel"].count() == 1
    clear_register(spark, out, areas, spark.createDataFrame([("South", 7)], "area_name string, value long"))
    cleared = latest_results(spark, out)
    assert cleared["building_groups"].count() == 0 and cleared["funnel"].first()["total"] == 0
    assert {r["area_name"]: r["value"] for r in cleared["areas"].collect()} == {"North": 0, "South": 7}


def test_no_results_yet(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="no results"):
        latest_results(spark, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_versions_are_claimed_by_one_publisher(spark, tmp_path):
    """Publishers at once get versions of their own; old sets go after the grace period, kept ones stay readable."""
    from concurrent.futures import ThreadPoolExecutor

    out = str(tmp_path / "out")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: publish(spark, out, {"funnel": spark.range(k)}, f"cause {k}"), range(1, 5)))
    switches = spark.read.option("recursiveFileLookup", True).parquet(f"{out}/switch").collect()
    assert sorted(r["version"] for r in switches) == [1, 2, 3, 4] and len({r["cause"] for r in switches}) == 4
    last = max(switches, key=lambda r: r["version"])
    assert f"cause {latest_results(spark, out, ('funnel',))['funnel'].count()}" == last["cause"]
    (tmp_path / "out/claims/000000000005").touch()  # a publisher that died after its claim
    publish(spark, out, {"funnel": spark.range(9)}, "after")
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{out}/switch").agg(F.max("version")).first()[0] == 6
    assert retire(spark, out, keep=2) == 0 and retire(spark, out, keep=2, grace_seconds=-5) == 3
    assert len(list((tmp_path / "out").glob("set-*"))) == 2 and latest_results(spark, out, ("funnel",))["funnel"].count() == 9
    publish(spark, out, {"funnel": spark.range(1)}, "cause 1")
    assert latest_results(spark, out, ("funnel",))["funnel"].count() == 9


def test_staged_lookups(spark, tmp_path):
    """Staged lookups give the rows of the plain match; their side of the joins has no exchange and no aggregate."""
    rows, made, places, _ = frames(spark)
    register_rows = pipelines.with_roles(rows, "ord")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keyed, postcodes = lookup.stage_lookups(made, places, "staged_test", 4)
        for strict in (False, True):
            plain = register.match_register(register_rows, made, places, strict)
            staged = register.match_keyed(register_rows, keyed, postcodes, strict)
            assert sorted(map(str, staged.collect())) == sorted(map(str, plain.collect()))
        plan = staged._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == 2 and "Aggregate" not in plan and "Window" not in plan
        groups = register.building_groups(register.match_register(register_rows, made, places))._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"\bSortAggregate", groups)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        for name in ("staged_test_buildings", "staged_test_postcodes"):
            spark.sql(f"drop table if exists {name}")


def test_one_key_of_many_rows(spark):
    """A key with many rows is joined by runs of their order, with the result of one list; nulls and repeats included."""
    import random

    rng = random.Random(5)
    ords = rng.sample(range(-(2**20), 2**20), 3000)
    data = [(o, "k" if i % 3 else f"k{i % 50}", rng.choice(["", None, f"R{i}"]), rng.choice(["", "Flat 1", "Flat 2"]), f"a{i}") for i, o in enumerate(ords)]
    rows = spark.createDataFrame(data, "ord long, match_key string, id string, sub_unit string, core string").withColumns({c: F.lit("") for c in ("street", "postcode", "lsoa", "licence_start", "licence_end")})
    got = {r["match_key"]: r for r in register.building_groups(rows.withColumns({"kind": F.lit("building"), "building_ord": F.lit(1)}).repartition(7)).collect()}
    for key in {d[1] for d in data}:
        mine = sorted(d for d in data if d[1] == key)
        assert (got[key]["hmo_id"], got[key]["sub_units"], got[key]["address"], got[key]["entry_count"]) == (", ".join(d[2] for d in mine if d[2]), ", ".join(d[3] for d in mine if d[3]), mine[0][4], len(mine))


def test_collection_from_many_tasks(spark, tmp_path):
    made = spark.range(200).repartition(5).select(F.col("id").alias("ord"), feature("Point", F.array(F.lit(1.0), F.lit(2.0)), n=F.col("id")).alias("feature"))
    for rows, size in ((made, 200), (made.where("ord = 7"), 1), (made.limit(0), 0)):
        assert writers.write_feature_collection(rows, str(tmp_path / "fc")) == size
        whole = json.loads("".join(p.read_text() for p in sorted((tmp_path / "fc").glob("part-*"))))
        assert [f["properties"]["n"] for f in whole["features"]] == ([7] if size == 1 else list(range(size)))


def test_headers_by_file(spark, tmp_path):
    """Files that name and order their columns in their own way, small ones in one task and a split one."""
    for name, text in {
        "a.csv": "\ufeffRegister ID,Address,Start\nA1,9 Low Rd,2020\n",
        "b.csv": '\n"Full address",Ref,End,"Notes, etc"\n"5 High St, ""X""",B1,2030,n\n\n6 High St,B2\n',
        "c.CSV": "street,property address\nLow,7 Low Rd\n",
        "d.csv": "id,address\n",
        "e.csv": "id,address\n" + "".join(f"E{i},{i} Long Lane\n" for i in range(400)),
    }.items():
        (tmp_path / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for lines in (True, False):
            rows = readers.register_roles_csv(spark, str(tmp_path), multi_line=lines)
            got = [r[1:] for r in rows.orderBy("ord").collect()]
            assert got[:4] == [("A1", "9 Low Rd", "", "2020", ""), ("B1", '5 High St, "X"', "", "", "2030"), ("B2", "6 High St", "", "", ""), ("", "7 Low Rd", "Low", "", "")]
            assert got[4:] == [(f"E{i}", f"{i} Long Lane", "", "", "") for i in range(400)]
            named = readers.register_csv(spark, str(tmp_path), multi_line=lines)
            assert named.columns == ["ord", "Register ID", "Address", "Start", "Full address", "Ref", "End", "Notes, etc", "street", "property address", "id", "address"] or len(named.columns) == 11
            assert named.where("Ref = 'B1'").first()["Full address"] == '5 High St, "X"'
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "f.csv").write_text("id,place\n1,x\n")
    with pytest.raises(ValueError, match="f.csv has no address column; found: id, place"):
        readers.register_roles_csv(spark, str(tmp_path))
    (tmp_path / "f.csv").write_text('id,"two\nlines",address\n1,2,3\n')
    with pytest.raises(ValueError, match="f.csv: the header is longer"):
        readers.register_csv(spark, str(tmp_path))


def test_numbers_read_from_the_left(spark, tmp_path):
    (tmp_path / "pc.csv").write_text("lsoa,postcode,centroid_lon,centroid_lat\nN,OX1 1AA, 1.5x,-2e1z\nM,OX1 1AB,.5,x1\n")
    assert [r[1:] for r in readers.postcode_lookup_csv(spark, str(tmp_path / "pc.csv")).orderBy("ord").collect()] == [("OX1 1AA", "N", -20.0, 1.5), ("OX1 1AB", "M", 0.0, 0.5)]


def test_area_density_from_files_to_files(spark, tmp_path):
    """Points and areas as features, and the metric as CSV with CRLF in the order of the areas, byte by byte."""
    import json

    square = lambda x: [[[x, 51.72], [x + 0.01, 51.72], [x + 0.01, 51.75], [x, 51.75], [x, 51.72]]]
    shapes = [("Oxford 002", -1.25), ("Oxford 001", -1.23), ('Oxford, "003"', -1.20), ("Cherwell 1", -1.28)]
    collection = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": square(x)}, "properties": {"LSOA21NM": n, "code": i}} for i, (n, x) in enumerate(shapes)]}
    (tmp_path / "areas.geojson").write_text(json.dumps(collection))
    nodes = [("pub", -1.245, {"name": "The Bell"}), ("cafe", -1.246, {}), ("bar", -1.225, {}), ("pub", -1.275, {}), ("pub", -1.0, {})]
    elements = [{"type": "node", "id": i, "lat": 51.73, "lon": x, "tags": {"amenity": a, **t}} for i, (a, x, t) in enumerate(nodes)]
    (tmp_path / "nodes.json").write_text(json.dumps({"elements": elements}))
    written = pipelines.area_density_files(spark, str(tmp_path / "nodes.json"), str(tmp_path / "areas.geojson"), str(tmp_path / "out"), prefix="Oxford")
    assert written == {"amenities": 3, "neighbourhoods": 3, "metric": 3}
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out/metric").glob("*.csv")))
    assert text == b'neighbourhood,value,value_label\r\nOxford 002,2,OSM amenity count (placeholder)\r\nOxford 001,1,OSM amenity count (placeholder)\r\n"Oxford, ""003""",0,OSM amenity count (placeholder)\r\n'
    features = [json.loads(x) for p in sorted((tmp_path / "out/neighbourhoods").glob("part-*")) for x in p.read_text().splitlines()]
    assert [(f["properties"]["LSOA21NM"], f["properties"]["amenity_count"]) for f in features] == [("Oxford 002", 2), ("Oxford 001", 1), ('Oxford, "003"', 0)]
    assert features[0]["geometry"] == {"type": "Polygon", "coordinates": square(-1.25)}
    points = [json.loads(x) for p in (tmp_path / "out/amenities").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted((f["properties"]["name"], f["properties"]["amenity"], f["properties"]["lsoa"]) for f in points) == [("", "bar", "Oxford 001"), ("", "cafe", "Oxford 002"), ("The Bell", "pub", "Oxford 002")]
    (tmp_path / "register.csv").write_text("neighbourhood,x\nB,1\n a,2\nb ,3\n")
    assert pipelines.preaggregate_files(spark, str(tmp_path / "register.csv"), str(tmp_path / "counts")) == 2
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "counts").glob("*.csv"))) == b"neighbourhood,value,value_label\r\na,1,HMO count\r\nB,2,HMO count\r\n"


def test_rejected_ways_are_a_result(spark):
    ways = spark.createDataFrame([(1, "way", {"building": "yes", "addr:housenumber": "1", "addr:street": "A"}, [(51.75, -1.25), (51.76, -1.25), (51.75, -1.25)])], "ord long, type string, tags map<string,string>, geometry array<struct<lat:double,lon:double>>")
    areas = spark.createDataFrame([], "area_ord long, area_name string, rings array<array<array<double>>>")
    made, places, rejected = pipelines.build_lookup(ways, areas)
    assert made.count() == 0 and places.count() == 0 and [r["ord"] for r in rejected.collect()] == [1]


def test_addresses_are_parsed_by_many_tasks_of_one_row_group(spark):
    rows = views.register(spark, "/root/testdata/sf0.001")
    assert views.read(spark, "/root/testdata/sf0.001", "orders").rdd.getNumPartitions() == 1
    assert rows.rdd.getNumPartitions() > 1
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \u2003\n"), (4, " a\n"), (5, "\u00a0\u00a0x")], "ord long, address string")
    assert [r["ord"] for r in filters.not_blank(blank, "address").orderBy("ord").collect()] == [4, 5]
