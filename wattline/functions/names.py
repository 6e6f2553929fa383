"""Station tokens in equipment and constraint names, as array<string> expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names are fixed width: eight characters of station code, or 'AAAAAAAA-BBBBBBBB_..' for a line between two stations.
# Interface names carry the external area's code; the home area starts with NY.


def station(text: Column) -> Column:
    return F.substring(F.regexp_replace(F.upper(text), "[^A-Z0-9]", ""), 1, 8)


def _set(arr: Column) -> Column:
    return F.array_distinct(F.filter(arr, lambda t: t.isNotNull() & (t != "")))


def line_or_station(text: Column) -> Column:
    s = F.upper(text)
    is_line = F.substring(s, 9, 1) == "-"
    one = F.array(station(F.substring(s, 1, 8)))
    two = F.array(station(F.substring(s, 1, 8)), station(F.substring(s, 10, 8)))
    return _set(F.when(is_line, two).otherwise(one))


def interface_area(text: Column) -> Column:
    """First part of an interface name that is neither the home area, a number nor the word LIMIT."""
    parts = F.transform(F.split(F.upper(text), "[-_]"), lambda p: F.trim(p))
    foreign = F.filter(parts, lambda p: (p != "") & (p != "LIMIT") & ~p.startswith("NY") & ~F.regexp_like(p, F.lit("^[0-9]+$")))
    return F.when(F.size(foreign) > 0, F.array(F.concat(F.lit("SCH:"), F.substring(F.get(foreign, F.lit(0)), 1, 2)))).otherwise(
        F.array().cast("array<string>"))


def equipment_tokens(name: Column) -> Column:
    s = F.upper(name)
    return F.when(s.startswith("SCH-"), interface_area(F.substr(s, F.lit(5)))).otherwise(line_or_station(s))


def facility_tokens(key: Column) -> Column:
    fac = F.trim(F.upper(F.get(F.split(key, " \\| ", 2), F.lit(0))))
    words = F.transform(F.filter(F.split(fac, "\\s+"), lambda t: F.regexp_like(t, F.lit("[A-Z]"))), station)
    return F.when(fac.startswith("SCH"), interface_area(F.substr(fac, F.lit(4)))).otherwise(_set(words))


def contingency_tokens(key: Column) -> Column:
    ctg = F.trim(F.upper(F.coalesce(F.get(F.split(key, " \\| ", 2), F.lit(1)), F.lit(""))))
    body = F.regexp_replace(ctg, "^[A-Z]{2,4}:\\s*", "")
    head = _set(F.array(station(F.get(F.split(body, "[\\s(#&_]", 2), F.lit(0)))))
    tokens = F.when(F.substring(body, 9, 1) == "-", line_or_station(body)).otherwise(head)
    return F.when((ctg == "") | (ctg == "BASE CASE"), F.array().cast("array<string>")).otherwise(tokens)


def constraint_key(facility: Column, contingency: Column) -> Column:
    """'facility | contingency'; NULL when either side is NULL (concat_ws would skip it)."""
    return F.concat(facility, F.lit(" | "), contingency)
