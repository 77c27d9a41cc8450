"""The registered queries as SQL for a second engine, on the same tables."""

from __future__ import annotations

from gridfold.functions import text as T
from gridfold.plans import views as V


def _plain(text: str) -> str:
    return text.replace("{", "").replace("}", "")


AREA_EDGES = """select area_ord, area_name, x0 as x1, y0 as y1, x0 + 1 as x2, y0 as y2 from area_base
union all select area_ord, area_name, x0 + 1, y0, x0 + 1, y0 + 1 from area_base
union all select area_ord, area_name, x0 + 1, y0 + 1, x0 + cast(0.5 as double), y0 + cast(0.25 as double) from area_base
union all select area_ord, area_name, x0 + cast(0.5 as double), y0 + cast(0.25 as double), x0, y0 + 1 from area_base
union all select area_ord, area_name, x0, y0 + 1, x0, y0 from area_base"""
#: Side of the edge on which a point lies, exactly: corners are quarters, and coordinates are whole multiples of 2 to the -62.
UNIT = "cast(4611686018427387904 as hugeint)"
SIDE = """(cast((x2 - x1) * 4 as hugeint) * (cast({y} * 4611686018427387904.0 as hugeint) - cast(y1 * 4 as hugeint) * ({unit} // 4))
  - (cast({x} * 4611686018427387904.0 as hugeint) - cast(x1 * 4 as hugeint) * ({unit} // 4)) * cast((y2 - y1) * 4 as hugeint))""".replace("{unit}", UNIT)
CROSSING = f"sum(case when (y1 > {{y}}) <> (y2 > {{y}}) and {SIDE} <> 0 and ({SIDE} > 0) = (y2 > y1) then 1 else 0 end) % 2 = 1"
ON_EDGE = f"max(case when {SIDE} = 0 and {{x}} between least(x1, x2) and greatest(x1, x2) and {{y}} between least(y1, y2) and greatest(y1, y2) then 1 else 0 end)"
INSIDE = "having " + CROSSING + " and " + ON_EDGE + " = 0"


def _placed(points: str, key: str, x: str = "lon", y: str = "lat") -> str:
    """First area that strictly holds each point."""
    hit = f"select {key}, area_ord, area_name from {points}, area_edges group by {key}, area_ord, area_name, {x}, {y} " + INSIDE.format(x=x, y=y)
    return f"select {key}, arg_min(area_name, area_ord) as area_name from ({hit}) group by {key}"


def _ascii_space(pattern: str) -> str:
    """A pattern with white space as the second engine writes it; the test views hold no other."""
    return pattern.replace(r"(?U:\s)", r"\s").replace(r"(?U:\S)", r"\S")


SUB_UNIT, POSTCODE = _ascii_space(T.SUB_UNIT), _ascii_space(T.POSTCODE)


def _key(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({text}), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"


CTES = {
    "area_base": _plain(V.AREA_BASE),
    "area_edges": AREA_EDGES,
    "point": _plain(V.POINT),
    "building": _plain(V.BUILDING),
    "register": _plain(V.REGISTER),
    "names": _plain(V.NAMES),
    "placed": _placed("point", "point_id"),
    "counts": "select area_name, count(*) as value, min(point_id) as first_ord from placed group by area_name",
    "area_value": "select area_ord, b.area_name, coalesce(value, 0) as value from area_base b left join counts c on b.area_name = c.area_name",
    "breaks": "select i as class_index, (select value from (select value, row_number() over (order by value) - 1 as place from area_value) where place = cast(floor(i / 4 * (select count(*) from area_value)) as bigint)) as break_value from (values (1), (2), (3)) t(i)",
    "made": f"select bid as ord, hn, street, pc, lon, lat, {_key("hn || ' ' || street")} as match_key from building where bid % 29 <> 0 and bid % 19 <> 0 and bid % 23 <> 0",
    "pc_first": "select pc as postcode, arg_min(lon, ord) as lon, arg_min(lat, ord) as lat from made where trim(pc) <> '' group by pc",
    "pc_placed": _placed("pc_first", "postcode"),
    "lookup": "select f.postcode, coalesce(area_name, '') as lsoa, lat as centroid_lat, lon as centroid_lon from pc_first f left join pc_placed p on f.postcode = p.postcode",
    "split": f"select *, trim(regexp_extract(address, '{SUB_UNIT}', 1)) as sub_unit, regexp_replace(address, '{SUB_UNIT}', '') as core from register where trim(address) <> ''",
    "found": f"select *, case when regexp_extract(core, '{POSTCODE}') <> '' then regexp_extract(core, '{POSTCODE}') else regexp_extract(address, '{POSTCODE}') end as found from split",
    "parsed0": r"select *, trim(regexp_replace(upper(found), '\s+', ' ', 'g')) as postcode, regexp_extract(core, '^([0-9]+[A-Za-z]?)\b', 1) as house_number, regexp_replace(trim(split_part(case when found <> '' and strpos(core, found) > 0 then substr(core, 1, strpos(core, found) - 1) || substr(core, strpos(core, found) + length(found)) else core end, ',', 1)), '^[0-9]+[A-Za-z]?\s*', '') as match_street from found",
    "parsed": f"select *, case when postcode <> '' then {_key("house_number || ' ' || match_street")} else '' end as match_key from parsed0",
    "first_building": "select match_key, min(ord) as building_ord from made where match_key <> '' group by match_key",
    "matched": "select p.*, case when p.postcode = '' then 'no_postcode' when b.building_ord is not null then 'building' when l.postcode is not null then 'fallback' else 'unplaced' end as kind, case when p.postcode = '' then '' else coalesce(l.lsoa, '') end as lsoa, b.building_ord, l.centroid_lat as pc_lat, l.centroid_lon as pc_lon from parsed p left join first_building b on p.match_key = b.match_key and p.match_key <> '' left join lookup l on p.postcode = l.postcode",
    "keyed": "select *, case when match_key <> '' then match_key else postcode || '|' || core end as group_key from matched where kind in ('building', 'fallback')",
}
FOLD = """select {key}, arg_min(core, ord) as address, arg_min(match_street, ord) as street, arg_min(postcode, ord) as postcode, arg_min(lsoa, ord) as lsoa,
  arg_min(licence_start, ord) as licence_start, arg_min(licence_end, ord) as licence_end, {extra},
  coalesce(string_agg(id, ', ' order by ord) filter (where id <> ''), '') as hmo_id,
  case when count(*) > 1 or max(sub_unit) <> '' then coalesce(string_agg(sub_unit, ', ' order by ord) filter (where sub_unit <> ''), '') end as sub_units,
  case when count(*) > 1 then count(*) end as entry_count from {source} group by {key}"""
GROUPS = FOLD.format(key="match_key", extra="arg_min(building_ord, ord) as building_ord", source="(select * from matched where kind = 'building')")
NODES = "select point_id as id, lon, lat, name from point where point_id % 4 <> 0 and lat between 1 and 4 and lon between 1 and 4"
IN_BOX = """select area_ord, area_name from area_edges where area_name like 'NATION_1%' and contains(area_name, 'NATION_1') group by area_ord, area_name having
  max(case when x1 between 1.3 and 2.9 and y1 between 0.9 and 3.1 then 1 else 0 end) = 1 or ({inside} and {edge} = 0) or {edge} = 1
  or max(case when coalesce((x1 - 1.3) * (x2 - 1.3) <= 0 and y1 + (y2 - y1) * (1.3 - x1) / nullif(x2 - x1, 0) between 0.9 and 3.1, false)
    or coalesce((x1 - 2.9) * (x2 - 2.9) <= 0 and y1 + (y2 - y1) * (2.9 - x1) / nullif(x2 - x1, 0) between 0.9 and 3.1, false)
    or coalesce((y1 - 0.9) * (y2 - 0.9) <= 0 and x1 + (x2 - x1) * (0.9 - y1) / nullif(y2 - y1, 0) between 1.3 and 2.9, false)
    or coalesce((y1 - 3.1) * (y2 - 3.1) <= 0 and x1 + (x2 - x1) * (3.1 - y1) / nullif(y2 - y1, 0) between 1.3 and 2.9, false) then 1 else 0 end) = 1""".format(inside=CROSSING.format(x="cast(1.3 as double)", y="cast(0.9 as double)"), edge=ON_EDGE.format(x="cast(1.3 as double)", y="cast(0.9 as double)"))
DETAILS = "concat_ws(chr(10), nullif(address, ''), 'Units: ' || nullif(sub_units, ''), entry_count || ' separate HMO entries at this address', 'ID: ' || nullif(hmo_id, ''), 'Start: ' || nullif(licence_start, ''), 'End: ' || nullif(licence_end, ''))"
PLAIN = "case when {c} = floor({c}) then cast(cast({c} as bigint) as varchar) else cast({c} as varchar) end"



def _json(**fields: str) -> str:
    """Members of a JSON object in order, those that are null left out."""
    members = ", ".join(f"""'"{name}":' || case when {value} is not null then cast(to_json({value}) as varchar) end""" for name, value in fields.items())
    return f"'{{' || concat_ws(',', {members}) || '}}'"


def _feature(kind: str, coordinates: str, *properties: str) -> str:
    return f"""'{{"type":"Feature","geometry":{{"type":"{kind}","coordinates":' || {coordinates} || '}},"properties":' || {_json(**{p.removeprefix('g.'): p for p in properties})} || '}}'"""


SQUARE = [(-0.002, -0.002), (0.002, -0.002), (0.002, 0.002), (-0.002, 0.002), (-0.002, -0.002)]
RING = "'[[' || " + " || ',' || ".join(f"'[' || round(lon + cast({dx} as double), 6) || ',' || round(lat + cast({dy} as double), 6) || ']'" for dx, dy in SQUARE) + " || ']]'"
GROUP_PROPERTIES = ("address", "street", "postcode", "lsoa", "hmo_id", "licence_start", "licence_end", "sub_units", "entry_count")
FALLBACK = FOLD.format(key="group_key", extra="arg_min(pc_lon, ord) as pc_lon, arg_min(pc_lat, ord) as pc_lat", source="(select * from keyed where kind = 'fallback')")
BUILDING_PROPERTIES = ("addr_housenumber", "addr_street", "addr_postcode", "match_key", "centroid_lat", "centroid_lon")
BUILT = "select *, hn as addr_housenumber, street as addr_street, pc as addr_postcode, round(lat, 6) as centroid_lat, round(lon, 6) as centroid_lon from made"

BODIES = {
    "points_in_areas": "select point_id, area_name from placed",
    "points_left_areas": "select p.point_id, coalesce(area_name, '') as area_name from point p left join placed q on p.point_id = q.point_id",
    "area_point_counts": "select area_ord, area_name, value from area_value",
    "area_rank": "select area_name, value, first_ord from counts order by value desc, first_ord limit 10",
    "quantile_breaks": "select class_index, break_value from breaks",
    "event_value_breaks": "select i as class_index, v as break_value from (select coalesce(value, 0) as v, row_number() over (order by coalesce(value, 0)) - 1 as place, count(*) over () as n from events), (select unnest(range(1, 10)) as i) where place = cast(floor(cast(i as double) / 10 * n) as bigint)",
    "value_range": "select min(value) as min_value, max(value) as max_value from area_value",
    "choropleth_classes": "select area_name, value, cast((select count(*) from breaks where break_value <= value) as int) as class_index from area_value",
    "legend_ranges": f"select cast(k as int) as class_index, lo, hi, {PLAIN.format(c='lo')} || '–' || coalesce({PLAIN.format(c='hi')}, '+') as label from (select k, coalesce(cast((select break_value from breaks where class_index = k) as double), 0) as lo, cast((select break_value from breaks where class_index = k + 1) as double) as hi from (select unnest(range(0, 4)) as k))",
    "normalised_name_counts": f"select arg_min(trim(neighbourhood), ord) as neighbourhood, count(*) as value, 'HMO count' as value_label from names where trim(neighbourhood) <> '' group by {_key('trim(neighbourhood)')}",
    "strip_sub_unit": "select ord, sub_unit, core from parsed",
    "extract_postcode": "select ord, found from parsed",
    "normalise_postcode": "select ord, postcode from parsed",
    "housenumber": "select ord, house_number from parsed",
    "street_for_match": "select ord, match_street from parsed",
    "match_key": "select ord, match_key from parsed",
    "tag_bbox_filter": NODES,
    "ways_filter": "select bid as id from building where bid % 29 <> 0 and bid % 19 <> 0 and bid % 23 <> 0 and lon - 0.002 <= 4 and lon + 0.002 >= 1 and lat - 0.002 <= 4 and lat + 0.002 >= 1",
    "ring_centroid": "select ord, cast(5 as bigint) as n_points, round(lon, 6) as centroid_lon, round(lat, 6) as centroid_lat, match_key from made",
    "areas_envelope_prefix": IN_BOX,
    "building_index": "select match_key, min(ord) as ord, arg_min(pc, ord) as addr_postcode from made where match_key <> '' group by match_key",
    "postcode_index": "select upper(pc) as postcode, max(ord) as ord, arg_max(lon, ord) as centroid_lon, arg_max(lat, ord) as centroid_lat from made where pc <> '' group by upper(pc)",
    "postcode_lookup": "select postcode, lsoa, centroid_lat, centroid_lon from lookup",
    "lookup_coverage": "select count(*) filter (where lsoa <> '') as with_area, count(*) filter (where lsoa = '') as without_area from lookup",
    "register_rows": "select ord, kind, lsoa, match_key, postcode, building_ord, pc_lat, pc_lon from matched",
    "register_area_counts": "select b.area_name, coalesce(n, 0) as value from area_base b left join (select lsoa, count(*) as n from matched where lsoa <> '' group by lsoa) on lsoa = b.area_name",
    "building_groups": GROUPS,
    "fallback_groups": FALLBACK,
    "geojson_features": f"select ord, {_feature('Polygon', RING, *BUILDING_PROPERTIES)} as feature from ({BUILT})",
    "building_features": f"select g.match_key, {_feature('Polygon', RING, *('g.' + p for p in GROUP_PROPERTIES))} as feature from ({GROUPS}) g join made m on m.ord = g.building_ord",
    "fallback_features": f"select group_key, {_feature('Point', "'[' || pc_lon || ',' || pc_lat || ']'", *GROUP_PROPERTIES)} as feature from ({FALLBACK})",
    "match_funnel": "select (select count(*) from matched) as total, (select count(distinct match_key) from matched where kind = 'building') as matched, (select count(distinct group_key) from keyed where kind = 'fallback') as fallback, (select count(*) from matched where kind = 'no_postcode') as no_postcode, (select count(*) from matched where kind <> 'no_postcode' and lsoa = '') as no_lsoa, (select count(*) from (select 1 from keyed group by kind, group_key having count(*) > 1)) as multi_household",
    "metric_join": "select area_ord, case when area_ord % 7 = 0 then '(unnamed)' else area_name end as label, case when area_ord % 7 = 0 then 0 else coalesce(cents, 0) end as value from area_base left join (select c_nationkey, cast(sum(cast(round(c_acctbal * 100) as bigint)) as bigint) as cents from customer where c_nationkey % 4 <> 0 group by c_nationkey) on c_nationkey = area_ord",
    "point_labels": "select point_id, case when name <> '' then name || ' (' || amenity || ')' else amenity end as label from point",
    "feature_details": f"select match_key, {DETAILS} as details from ({GROUPS})",
    "register_roles": "select ord, id, address, '' as street, licence_start, licence_end from register",
}


def oracle_sql() -> dict[str, str]:
    """SQL by query name; all view definitions stand in front, and only those used are run."""
    views = ",\n".join(f"{name} as ({body})" for name, body in CTES.items())
    return {name: f"with {views}\n{body}" for name, body in BODIES.items()}
