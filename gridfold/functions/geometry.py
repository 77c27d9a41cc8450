"""Rings, edges, centroids and containment as column expressions, in planar longitude and latitude."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Factor that splits a double into two halves of 26 bits, and the relative errors of a determinant and of a product of doubles.
SPLITTER, DETERMINANT_ERROR, PRODUCT_ERROR = 134217729.0, 4e-16, 2.3e-16


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _product_parts(p: Column) -> Column:
    """Two doubles whose sum is ``sign * a * b`` without any error, for a struct of the three."""
    high = lambda v: v * SPLITTER - (v * SPLITTER - v)
    halves = F.struct((p["a"] * p["b"]).alias("p"), high(p["a"]).alias("ah"), high(p["b"]).alias("bh"), p["a"].alias("a"), p["b"].alias("b"), p["sign"].alias("sign"))

    def parts(h: Column) -> Column:
        al, bl = h["a"] - h["ah"], h["b"] - h["bh"]
        error = ((h["ah"] * h["bh"] - h["p"]) + h["ah"] * bl + al * h["bh"]) + al * bl
        return F.array(h["p"] * h["sign"], error * h["sign"])

    return _let(halves, parts)


def rounded(value: Column, decimals: int = 6) -> Column:
    """``value`` rounded as its exact binary value asks, ties to the even digit; what has no such decimals stays as it is.

    Only a product with the power of ten that is within its own error of the middle between two decimals is
    computed without error; any other falls to the nearest side as it is.
    """
    scale = float(10**decimals)
    product, most = value * scale, 2.0**52 / scale
    close = F.abs(product - F.floor(product) - 0.5) <= F.abs(product) * PRODUCT_ERROR
    return F.when(F.abs(value) < most, F.when(close, _rounded_exactly(value, scale)).otherwise(F.rint(product) / scale)).otherwise(value)


def _rounded_exactly(value: Column, scale: float) -> Column:
    parts = _product_parts(F.struct(value.alias("a"), F.lit(scale).alias("b"), F.lit(1.0).alias("sign")))
    known = _let(parts, lambda p: F.struct(p[0].alias("p"), p[1].alias("e"), F.floor(p[0]).cast("double").alias("k")))

    def near(t: Column) -> Column:
        over = (t["p"] - (t["k"] + 0.5)) + t["e"]
        up = (over > 0) | ((over == 0) & (t["k"] % 2 != 0))
        return F.when(up, t["k"] + 1).otherwise(t["k"]) / scale

    return _let(_let(known, near), lambda r: F.when((r == 0) & (value < 0), F.lit(-0.0)).otherwise(r))


def way_ring(geometry: Column) -> Column:
    """Closed ring of ``[lon, lat]``, rounded to 6 decimals, from an array of ``(lat, lon)`` nodes."""
    open_ring = F.transform(geometry, lambda g: F.array(rounded(g["lon"]), rounded(g["lat"])))
    first, last = (lambda r: F.element_at(r, 1)), (lambda r: F.element_at(r, -1))
    return _let(open_ring, lambda r: F.when(first(r) == last(r), r).otherwise(F.concat(r, F.array(first(r)))))


def ring_of_four(geometry: Column) -> Column:
    """Whether :func:`way_ring` has four points or more; only of three nodes are any looked at."""
    end = lambda k: _let(F.element_at(geometry, k), lambda g: F.array(rounded(g["lon"]), rounded(g["lat"])))
    return F.when(F.size(geometry) == 3, ~F.coalesce(end(1) == end(-1), F.lit(False))).otherwise(F.size(geometry) > 3)


def ring_edges(ring: Column) -> Column:
    """Edges ``(x1, y1, x2, y2)`` of a closed ring."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
    return F.transform(pairs, lambda p: F.struct(p["a"][0].alias("x1"), p["a"][1].alias("y1"), p["b"][0].alias("x2"), p["b"][1].alias("y2")))


def rings_edges(rings: Column) -> Column:
    """Edges of all rings of an area in one array."""
    return F.flatten(F.transform(rings, lambda r: ring_edges(r)))


def centroid(ring: Column) -> Column:
    """``(lon, lat)`` of a closed ring's area centroid, rounded to 6 decimals.

    Summed relative to the first vertex; a ring without area has the centroid of its length.
    """
    x0, y0 = ring[0][0], ring[0][1]
    zero = F.lit(0.0)

    def terms(a: Column, b: Column) -> Column:
        return F.struct((a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"), (a["x"] * b["y"] - b["x"] * a["y"]).alias("cross"))

    def lengths(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        return F.struct((a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y"), F.sqrt(dx * dx + dy * dy).alias("length"))

    def total(edges: Column, term: Callable[[Column], Column]) -> Column:
        return F.aggregate(edges, zero, lambda s, e: s + term(e))

    def finish(moved: Column) -> Column:
        # Each product is computed once an edge, and lengths only where there is no area.
        pairs = lambda of: F.zip_with(F.slice(moved, 1, F.size(moved) - 1), F.slice(moved, 2, F.size(moved) - 1), of)
        by_area = _let(pairs(terms), lambda t: F.struct(*(total(t, lambda e, c=c: e[c] * e["cross"]).alias(c) for c in "xy"), total(t, lambda e: e["cross"]).alias("n")))
        by_length = _let(pairs(lengths), lambda t: F.struct(*(total(t, lambda e, c=c: e[c] / 2 * e["length"]).alias(c) for c in "xy"), total(t, lambda e: e["length"]).alias("n")))
        mean = lambda s, n: F.struct(*((s[c] / F.nullif(n, zero)).alias(c) for c in "xy"))
        none = F.struct(zero.alias("x"), zero.alias("y"))
        line = _let(by_length, lambda s: F.when(s["n"] != 0, mean(s, s["n"])).otherwise(none))
        return _let(by_area, lambda s: F.when(s["n"] != 0, mean(s, 3 * s["n"])).otherwise(line))

    moved = F.transform(ring, lambda p: F.struct((p[0] - x0).alias("x"), (p[1] - y0).alias("y")))
    placed = _let(_let(moved, finish), lambda m: F.struct((x0 + m["x"]).alias("x"), (y0 + m["y"]).alias("y")))
    return F.when(ring.isNotNull(), _let(placed, lambda v: F.struct(rounded(v["x"]).alias("lon"), rounded(v["y"]).alias("lat"))))


def envelope(edges: Column) -> Column:
    """``(minx, miny, maxx, maxy)`` of edges."""
    low = lambda k: F.array_min(F.transform(edges, lambda e: F.least(e[f"{k}1"], e[f"{k}2"])))
    high = lambda k: F.array_max(F.transform(edges, lambda e: F.greatest(e[f"{k}1"], e[f"{k}2"])))
    return F.struct(low("x").alias("minx"), low("y").alias("miny"), high("x").alias("maxx"), high("y").alias("maxy"))


def _sign_of_sum(terms: Column) -> Column:
    """Sign of the exact sum of doubles: each term is added to an expansion, whose parts do not overlap."""
    none = F.array().cast("array<double>")

    def add(parts: Column, term: Column) -> Column:
        def carry(s: Column, part: Column) -> Column:
            total = s["q"] + part
            back = total - s["q"]
            lost = (s["q"] - (total - back)) + (part - back)
            return F.struct(total.alias("q"), F.concat(s["parts"], F.array(lost)).alias("parts"))

        summed = F.aggregate(parts, F.struct(term.alias("q"), none.alias("parts")), carry)
        return F.concat(summed["parts"], F.array(summed["q"]))

    parts = F.filter(F.aggregate(terms, none, add), lambda v: v != 0)
    return F.coalesce(F.signum(F.try_element_at(parts, F.lit(-1))), F.lit(0.0))


def side_of(e: Column, x: Column, y: Column) -> Column:
    """1, -1 or 0: the point lies left of the edge, right of it, or on its line, decided exactly.

    The determinant of doubles decides where it is larger than its error; else the six products of
    coordinates are summed without error. Coordinates lie between 1e-100 and 1e100 or are zero.
    """
    products = [(e["x2"], y, 1.0), (e["x2"], e["y1"], -1.0), (e["x1"], y, -1.0), (x, e["y2"], -1.0), (x, e["y1"], 1.0), (e["x1"], e["y2"], 1.0)]
    listed = F.array(*(F.struct(a.alias("a"), b.alias("b"), F.lit(sign).alias("sign")) for a, b, sign in products))
    exact = _sign_of_sum(F.flatten(F.transform(listed, _product_parts)))
    terms = F.struct(((e["x2"] - e["x1"]) * (y - e["y1"])).alias("l"), ((x - e["x1"]) * (e["y2"] - e["y1"])).alias("r"))
    sure = lambda t: F.abs(t["l"] - t["r"]) > (F.abs(t["l"]) + F.abs(t["r"])) * DETERMINANT_ERROR
    return _let(terms, lambda t: F.when(sure(t), F.signum(t["l"] - t["r"])).otherwise(exact))


def _relation(e: Column, x: Column, y: Column) -> Column:
    """2: the point lies on the edge; 1: the edge crosses the ray from it to the right; else 0."""
    upward, straddles = e["y2"] > e["y1"], (e["y1"] > y) != (e["y2"] > y)
    near = _let(side_of(e, x, y), lambda side: F.when(side == 0, 2).when(straddles & ((side > 0) == upward), 1).otherwise(0))
    return F.when(x < F.least(e["x1"], e["x2"]), straddles.cast("int")).otherwise(near)


def _reached(e: Column, x: Column, y: Column) -> Column:
    """Whether the ray from the point to the right meets the edge's box."""
    return (y >= F.least(e["y1"], e["y2"])) & (y <= F.greatest(e["y1"], e["y2"])) & (x <= F.greatest(e["x1"], e["x2"]))


def _on_edge(e: Column, x: Column, y: Column) -> Column:
    return _reached(e, x, y) & (_relation(e, x, y) == 2)


def inside_given(edges: Column, x: Column, y: Column, odd: Column) -> Column:
    """Whether a point is on none of the edges and inside by the even-odd rule, ``odd`` telling of edges not in the array."""

    def step(s: Column, e: Column) -> Column:
        return F.when((s == 2) | ~_reached(e, x, y), s).otherwise(_let(_relation(e, x, y), lambda r: F.when(r == 2, 2).otherwise(s.bitwiseXOR(r))))

    crossings = F.aggregate(edges, F.lit(0), step)
    return _let(crossings, lambda c: (c != 2) & ((c == 1) != odd))


def strictly_inside(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside by the even-odd rule and on no edge, exactly for the coordinates as they are."""
    return inside_given(edges, x, y, F.lit(False))


def meets_box(edges: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether an area and a box share a point: a vertex in the box, a box corner in the area, or edges that cross."""
    w, s, e_, n = map(F.lit, (float(west), float(south), float(east), float(north)))
    vertex = F.exists(edges, lambda e: e["x1"].between(w, e_) & e["y1"].between(s, n))
    corner = strictly_inside(edges, w, s) | F.exists(edges, lambda e: _on_edge(e, w, s))

    def side(e: Column) -> Column:
        at_x = lambda x: F.when((e["x1"] - x) * (e["x2"] - x) <= 0, (e["y1"] + (e["y2"] - e["y1"]) * (x - e["x1"]) / F.nullif(e["x2"] - e["x1"], F.lit(0.0))).between(s, n))
        at_y = lambda y: F.when((e["y1"] - y) * (e["y2"] - y) <= 0, (e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))).between(w, e_))
        return F.coalesce(at_x(w), F.lit(False)) | F.coalesce(at_x(e_), F.lit(False)) | F.coalesce(at_y(s), F.lit(False)) | F.coalesce(at_y(n), F.lit(False))

    return vertex | corner | F.exists(edges, side)


def feature(kind: str, coordinates: Column, **properties: Column) -> Column:
    """GeoJSON text of a feature; null properties are left out."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*(c.alias(k) for k, c in properties.items())).alias("properties")))
