"""How a catalogue writes sizes, shutter times and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _tenths(x: Column) -> Column:
    """One decimal, ties decided by the binary value."""
    return F.call_function("format_number", x, F.lit("0.0"))


def bytes_text(n: Column) -> Column:
    """Bytes, KiB or MiB, the last two with one decimal."""
    part = lambda unit, size: F.concat(_tenths(n / float(size)), F.lit(f" {unit}"))
    return F.when(n >= 1 << 20, part("MiB", 1 << 20)).when(n >= 1 << 10, part("KiB", 1 << 10)).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def shutter_text(ns: Column) -> Column:
    """Seconds, or one over a whole number below a second; a dash for no time."""
    return F.when(ns >= 10**9, F.concat(_tenths(ns / 1e9), F.lit(" s"))).when(ns > 0, F.format_string("1/%d s", F.rint(1.0 / (ns / 1e9)).cast("long"))).otherwise("-")


def elided(text: Column, most: int) -> Column:
    """Text with its middle left out where it is longer than most."""
    head = most // 2
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("…"), F.right(text, F.lit(most - 1 - head))))


def safe(part: Column) -> Column:
    """A path's part with letters, digits, points, dashes and underscores only; never empty."""
    out = F.regexp_replace(part, "[^A-Za-z0-9._-]", "_")
    return F.when(out == "", "capture").otherwise(out)


def path_key(path: Column, root: str) -> Column:
    """The parts of a path below root, the last without its extension, joined by two underscores."""
    below = F.regexp_replace(F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))).otherwise(path), r"(?<=[^/])\.[^./]*$", "")
    parts = F.filter(F.split(below, "/"), lambda p: (p != "") & (p != ".") & (p != ".."))
    return F.array_join(F.transform(parts, safe), "__")


def has_extension(path: Column, extension: str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)) == extension


# Names of lights by number.
LIGHTS = {0: "A", 1: "D50", 2: "D65", 3: "D75", 4: "F2", 5: "F7", 6: "F11", 7: "TL84", 99: "UNKNOWN"}


def illuminant(number: Column) -> Column:
    known = F.when(number.isNull(), "MISSING")
    for n, name in LIGHTS.items():
        known = known.when(number == n, name)
    return known.otherwise("UNRECOGNIZED")


def decimal_size(n: Column) -> Column:
    """Bytes in units of a thousand: a whole number from 100 of a unit on, else one decimal."""
    out = F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        v = n / float(1000**i)
        told = F.concat(F.when(v >= 100, F.call_function("format_number", v, F.lit("0"))).otherwise(_tenths(v)), F.lit(f" {unit}"))
        out = out.when(n < 1000 ** (i + 1), told) if unit != "TB" else out.otherwise(told)
    return out


def moment(at: Column, zone: Column) -> Column:
    """Date and time, with the offset from UTC in minutes where it is known."""
    size = F.abs(zone)
    offset = F.concat(F.lit(" "), F.when(zone < 0, "-").otherwise("+"), F.format_string("%02d:%02d", F.floor(size / 60).cast("int"), (size % 60).cast("int")))
    return F.concat(F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.when(zone.isNull(), "").otherwise(offset))


def summary(iso: Column, shutter_ns: Column, focal: Column, moment_: Column) -> Column:
    """What is known of a capture, in one line."""
    return F.concat_ws("  |  ", F.concat(F.lit("ISO "), iso.cast("string")), F.when(shutter_ns.isNotNull(), shutter_text(shutter_ns)), F.concat(focal.cast("string"), F.lit(" mm")), moment_)


# The patterns of a mosaic.
PATTERNS = ("RGGB", "GRBG", "GBRG", "BGGR", "MONO")


def override(value: Column) -> tuple[Column, Column]:
    """Camera and pattern of CAMERA=PATTERN, in capitals; a pattern that is none is null."""
    pattern = F.upper(F.regexp_extract(value, "=(.*)$", 1))
    return F.upper(F.regexp_extract(value, "^([^=]*)=", 1)), F.when(pattern.isin(*PATTERNS), pattern)
