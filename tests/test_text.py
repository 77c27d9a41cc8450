"""Address parts and keys: each quirk is a row, its expected value found by hand."""

import pytest
from pyspark.sql import functions as F

from gridfold.functions import text as T
from gridfold.operators.register import parse_register

CASES = [
    # address, sub-unit, house number, postcode, street, key
    ("18 Abbey Road, OX2 0AE", "", "18", "OX2 0AE", "Abbey Road", "18 abbey road"),
    ("Flat B, 65 Ashhurst Way, OX4 4RF", "Flat B", "65", "OX4 4RF", "Ashhurst Way", "65 ashhurst way"),
    ("Room 3, 12 James Street, ox4  1eu", "Room 3", "12", "OX4 1EU", "James Street", "12 james street"),
    ("First Floor Flat, 4 High St, OX1 1AA", "", "", "OX1 1AA", "First Floor Flat", "first floor flat"),
    ("12-14 High Street, OX1 4AA", "", "12", "OX1 4AA", "-14 High Street", "12 14 high street"),
    ("12Abbey Road, OX20AE", "", "", "OX20AE", "bbey Road", "bbey road"),
    ("7 St. Mary's Road", "", "7", "", "St. Mary's Road", ""),
    ("Flat 1,2, 9 Low Road, OX1 1AB", "Flat 1,2", "9", "OX1 1AB", "Low Road", "9 low road"),
    ("12é St, OX1 1AA", "", "12", "OX1 1AA", "é St", "12 st"),
    (" 5 Lane, OX1 1AA", "", "", "OX1 1AA", "Lane", "lane"),
]


def test_address_parts(spark):
    rows = spark.createDataFrame([(i, "", a, "", "", "") for i, (a, *_) in enumerate(CASES)] + [(99, "x", "   ", "", "", ""), (100, "x", None, "", "", "")], "ord long, id string, address string, street string, licence_start string, licence_end string")
    got = {r["ord"]: (r["sub_unit"], r["house_number"], r["postcode"], r["match_street"], r["match_key"]) for r in parse_register(rows).collect()}
    assert got == {i: tuple(c[1:]) for i, c in enumerate(CASES)}


def test_street_column_counts_even_if_blank(spark):
    row = spark.sql("select '1 High St, OX1 1AA' as core, ' ' as s, '' as e")
    assert row.select(T.street_for_match(F.col("s"), F.col("core"), F.lit("OX1 1AA"))).first()[0] == " "
    assert row.select(T.street_for_match(F.col("e"), F.col("core"), F.lit("OX1 1AA"))).first()[0] == "High St"


@pytest.mark.parametrize(("raw", "name"), [("St. Mary's", "st marys"), ("12-14", "1214"), ("a  b\tc", "a b c"), ("!!!", ""), (None, ""), ("  É x ", "x")])
def test_normalise_name(spark, raw, name):
    assert spark.createDataFrame([(raw,)], "s string").select(T.normalise_name(F.col("s"))).first()[0] == name


def test_postcode_keeps_a_missing_space(spark):
    assert spark.sql("select 'ox20ae' as p").select(T.normalise_postcode(F.col("p"))).first()[0] == "OX20AE"


def test_roles():
    assert T.register_roles(["Address ref", "Street address", "Street", "Start", "Gender"]) == {"id": "Address ref", "address": "Street address", "street": "Street", "licence_start": "Start", "licence_end": "Gender"}
    assert T.register_roles(["ID", "ref", "Address"]) == {"id": "ID", "address": "Address"}


def test_no_address_column(spark):
    with pytest.raises(ValueError, match="found: a, b"):
        T.with_roles(spark.createDataFrame([("1", "2")], "a string, b string"))


def test_labels_and_details(spark):
    row = spark.sql("select '' as n, 'pub' as k, 'Fox' as m, cast(null as string) as z, 3 as c")
    assert row.select(T.point_label(F.col("n"), F.col("k")), T.point_label(F.col("m"), F.col("k")), T.area_label(F.col("n"))).first()[:] == ("pub", "Fox (pub)", "(unnamed)")
    got = row.select(T.feature_details({"address": F.col("m"), "sub_units": F.col("z"), "entry_count": F.col("c"), "hmo_id": F.col("n")}, separator="<br>")).first()[0]
    assert got == "Fox<br>3 separate HMO entries at this address"
