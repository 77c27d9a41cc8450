"""Name, address and postcode expressions. Missing strings count as empty throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of postcodes, sub-units and house numbers. ``(?U)`` makes white space Unicode's.
POSTCODE = r"(?i)[A-Z]{1,2}[0-9][A-Z0-9]?(?U:\s)*[0-9][A-Z]{2}"
SUB_UNIT = r"(?i)^(flat(?U:\s)+(?U:\S)+|room(?U:\s)+(?U:\S)+|unit(?U:\s)+(?U:\S)+|apt\.?(?U:\s)+(?U:\S)+|apartment(?U:\s)+(?U:\S)+|studio(?U:\s)+(?U:\S)+|basement|ground(?U:\s)+floor|first(?U:\s)+floor|second(?U:\s)+floor)(?U:\s)*,(?U:\s)*"
HOUSE_NUMBER = r"^([0-9]+[A-Za-z]?)(?![A-Za-z0-9_])"
LEADING_NUMBER = r"^[0-9]+[A-Za-z]?(?U:\s)*"
ROLES = ("id", "address", "street", "licence_start", "licence_end")


def present(text: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(text, F.lit(""))


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(present(text), r"(?U)^\s+|\s+$", "")


def normalise_name(text: Column) -> Column:
    """Lower case; all but a-z, 0-9 and white space deleted; white space collapsed and trimmed."""
    kept = F.regexp_replace(F.lower(present(text)), r"(?U)[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", " "))


def match_key(house_number: Column, street: Column) -> Column:
    """The key that register rows and buildings meet on."""
    return normalise_name(F.concat(present(house_number), F.lit(" "), present(street)))


def normalise_postcode(postcode: Column) -> Column:
    """Upper case, white space collapsed and trimmed; a missing space stays missing."""
    return F.trim(F.regexp_replace(F.upper(present(postcode)), r"(?U)\s+", " "))


def find_postcode(core: Column, raw: Column) -> Column:
    """The first postcode as written, in the core address or else the raw one; empty if there is none."""
    first = F.regexp_extract(present(core), POSTCODE, 0)
    return F.when(first != "", first).otherwise(F.regexp_extract(present(raw), POSTCODE, 0))


def sub_unit(address: Column) -> Column:
    """A leading flat, room or floor; empty if there is none."""
    return stripped(F.regexp_extract(present(address), SUB_UNIT, 1))


def core_address(address: Column) -> Column:
    """The address after a leading sub-unit."""
    return F.regexp_replace(present(address), SUB_UNIT, "")


def house_number(address: Column) -> Column:
    """A number with at most one letter at the very start; empty if there is none."""
    return F.regexp_extract(present(address), HOUSE_NUMBER, 1)


def street_for_match(street: Column, core: Column, postcode: Column) -> Column:
    """The street column if it isn't empty, else the address up to a comma without number and first postcode."""
    at = F.instr(core, postcode)
    without = F.when((postcode != "") & (at > 0), F.concat(F.substring(core, F.lit(1), at - 1), F.substring(core, at + F.length(postcode), F.length(core)))).otherwise(core)
    first = F.regexp_replace(stripped(F.substring_index(without, ",", 1)), LEADING_NUMBER, "")
    return F.when(present(street) != "", street).otherwise(first)


def tag(tags: Column, name: str) -> Column:
    """A map entry, with the empty string where it is missing."""
    return F.coalesce(tags[name], F.lit(""))


def area_label(name: Column) -> Column:
    """An area's name, or a stand-in where it has none."""
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("(unnamed)"))


def point_label(name: Column, kind: Column) -> Column:
    """``name (kind)``, or the kind alone where there is no name."""
    return F.when(present(name) != "", F.concat(name, F.lit(" ("), kind, F.lit(")"))).otherwise(kind)


def feature_details(columns: dict[str, Column], entries_text: str = "{} separate HMO entries at this address", separator: str = "\n") -> Column:
    """Lines of what is known of a building or point, missing ones left out.

    ``columns`` may name address, sub_units, entry_count, hmo_id, licence_start and licence_end.
    """
    before, after = entries_text.split("{}")
    wording = {"address": ("", ""), "sub_units": ("Units: ", ""), "entry_count": (before, after), "hmo_id": ("ID: ", ""), "licence_start": ("Start: ", ""), "licence_end": ("End: ", "")}
    lines = []
    for name, (left, right) in wording.items():
        if name in columns:
            text = columns[name].cast("string")
            lines.append(F.when((present(text) != "") & (text != "0"), F.concat(F.lit(left), text, F.lit(right))) if name == "entry_count" else F.when(present(text) != "", F.concat(F.lit(left), text)))
    return F.concat_ws(separator, *lines)


def register_roles(headers: list[str]) -> dict[str, str]:
    """Which header plays which role; each header takes the first role that is free and that it suits."""
    suits = {
        "id": lambda h: h == "id" or any(x in h for x in ("register", "ref", "licence id")),
        "address": lambda h: "address" in h,
        "street": lambda h: "street" in h,
        "licence_start": lambda h: "start" in h,
        "licence_end": lambda h: "end" in h,
    }
    found: dict[str, str] = {}
    for header in headers:
        plain = header.lower().strip()
        role = next((r for r in ROLES if r not in found and suits[r](plain)), None)
        if role:
            found[role] = header
    return found


def with_roles(df: DataFrame, *keep: str) -> DataFrame:
    """The role columns of a register as strings, empty where a role is absent, and the columns to ``keep``.

    Raises ``ValueError`` naming the columns found where no column holds addresses.
    """
    found = register_roles([c for c in df.columns if c not in keep])
    if "address" not in found:
        raise ValueError(f"no address column; found: {', '.join(df.columns)}")
    value = lambda r: present(F.col(f"`{found[r]}`").cast("string")) if r in found else F.lit("")
    return df.select(*keep, *(value(r).alias(r) for r in ROLES))
