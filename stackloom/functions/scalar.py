"""Scalar expressions: times, sizes, ids, text. All are built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Factors of size units as container tools print them: SI to the base 1000, IEC to 1024.
# Fixed values.
SIZE_UNITS = {
    "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12,
    "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40,
}


def iso_to_us(text: Column) -> Column:
    """Epoch microseconds of an ISO-8601 time; null where it cannot be read."""
    return F.unix_micros(F.try_to_timestamp(text))


def us_to_iso(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def ns_to_iso(ns: Column) -> Column:
    return us_to_iso(F.floor(ns / 1000).cast("bigint"))


def event_time_us(text: Column) -> Column:
    """Epoch microseconds of a time given as ISO text or as integer nanoseconds; else null."""
    digits = text.rlike("^-?[0-9]+$")
    ns = text.try_cast("bigint")
    return F.when(digits, ((ns - F.pmod(ns, F.lit(1000))) / 1000).cast("bigint")).otherwise(iso_to_us(text))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def rightmost_identifier(expr: Column) -> Column:
    """Last identifier of a receiver expression such as ``self.repo.session``; null if there is none."""
    last = F.regexp_extract(expr, r"([A-Za-z_$][A-Za-z0-9_$]*)[^A-Za-z0-9_$]*$", 1)
    return F.when(last != "", last)


def node_id(file: Column, name: Column, qualified: Column) -> Column:
    """``file::class::method`` for methods, ``file::name`` for functions and closures."""
    owner, method = F.regexp_extract(qualified, r"^(.+)\.([^.]+)$", 1), F.substring_index(qualified, ".", -1)
    is_method = (qualified != "") & ~F.contains(qualified, F.lit("<locals>")) & (owner != "") & (method != "")
    place = F.coalesce(file, F.lit(""))
    return F.when(is_method, F.concat_ws("::", place, owner, method)).otherwise(F.concat_ws("::", place, name))


def symbol_kind(qualified: Column) -> Column:
    method = F.contains(qualified, F.lit(".")) & ~F.contains(qualified, F.lit("<locals>"))
    return F.when(method, "Method").otherwise("Function")


def parent_class(qualified: Column) -> Column:
    """What stands before the last dot; null for functions and closures."""
    owner = F.regexp_extract(qualified, r"^(.+)\.[^.]*$", 1)
    return F.when(~F.contains(qualified, F.lit("<locals>")) & (owner != ""), owner)


def size_to_bytes(text: Column) -> Column:
    """Bytes of a text such as ``81.4MiB`` or ``1.5MB``; 0 where it cannot be read."""
    number = F.regexp_extract(F.trim(text), r"^([0-9.]+)", 1).try_cast("double")
    unit = F.lower(F.trim(F.regexp_extract(F.trim(text), r"^[0-9.]*(.*)$", 1)))
    factors = F.create_map(*[F.lit(x) for pair in SIZE_UNITS.items() for x in pair])
    return F.coalesce((number * F.coalesce(F.try_element_at(factors, unit), F.lit(1))).cast("bigint"), F.lit(0))


def percent_to_double(text: Column) -> Column:
    return F.trim(F.rtrim(text, F.lit("%"))).try_cast("double")


def truncated(text: Column, width: int) -> Column:
    """The text cut to ``width`` characters, the last being an ellipsis if any were cut."""
    return F.when(F.length(text) > width, F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))).otherwise(text)


def squeezed_hash(text: Column) -> Column:
    """Hash of a text without regard to runs of white space; for equality only."""
    return F.xxhash64(F.regexp_replace(F.trim(text), r"\s+", " "))


def line_of_offset(text: Column, offset: Column) -> Column:
    """One-based line of a zero-based character offset."""
    head = F.left(text, offset.cast("int"))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def js_round(x: Column) -> Column:
    """Half-way cases go up, as in JavaScript."""
    return F.floor(x + 0.5)


def human_count(n: Column) -> Column:
    """Numbers as dashboards print them: 950, 1.2k, 3.4M."""
    return (
        F.when(F.abs(n) >= 1_000_000, F.format_string("%.1fM", n / 1_000_000))
        .when(F.abs(n) >= 1_000, F.format_string("%.1fk", n / 1_000))
        .otherwise(n.cast("string"))
    )


# Ranks of severities and efforts.
SEVERITIES = {"high": 3, "medium": 2, "low": 1}
EFFORTS = {"trivial": 1, "small": 2, "medium": 3, "large": 4}


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in SEVERITIES.items() for x in p])[severity], F.lit(0))


def effort_rank(effort: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in EFFORTS.items() for x in p])[effort], F.lit(0))
