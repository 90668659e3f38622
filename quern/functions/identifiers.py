"""Packed identifiers, positions written as text, file names and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_observation(plate: Column, mjd: Column, fiber: Column) -> Column:
    return plate.cast("long") * 1_000_000_000 + mjd.cast("long") * 10_000 + fiber.cast("long")


def unpack_observation(packed: Column) -> dict[str, Column]:
    return {
        "plate": F.floor(packed / 1_000_000_000).cast("long"),
        "mjd": (F.floor(packed / 10_000) % 100_000).cast("long"),
        "fiber": (packed % 10_000).cast("long"),
    }


def dashed_observation(packed: Column) -> Column:
    """plate-mjd-fiber with 4, 5 and 4 digits."""
    parts = unpack_observation(packed)
    return F.concat_ws(
        "-", *(F.lpad(parts[k].cast("string"), n, "0") for k, n in (("plate", 4), ("mjd", 5), ("fiber", 4)))
    )


def pack_run(feature: Column, scorer: Column, cls: Column) -> Column:
    return feature * 1_000_000 + scorer * 1_000 + cls


def unpack_run(run: Column) -> dict[str, Column]:
    return {
        "feature": F.floor(run / 1_000_000).cast("long"),
        "scorer": (F.floor(run / 1_000) % 1_000).cast("long"),
        "cls": (run % 1_000).cast("long"),
    }


def sexagesimal(name: Column) -> dict[str, Column]:
    """Right ascension and declination in degrees of a name ``Jhhmmss.s+ddmmss.s``; null if it isn't one."""
    pattern = r"J(\d{2})(\d{2})(\d{2}(?:\.\d*)?)([+-])(\d{2})(\d{2})(\d{2}(?:\.\d*)?)"
    got = [F.nullif(F.regexp_extract(name, pattern, i), F.lit("")) for i in range(1, 8)]
    h, m, s, sign, d, dm, ds = (g if i == 3 else g.cast("double") for i, g in enumerate(got))
    turn = F.when(sign == "-", -1.0).otherwise(1.0)
    return {"ra": (h + m / 60 + s / 3600) * 15, "dec": turn * (d + dm / 60 + ds / 3600)}


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def file_extension(path: Column) -> Column:
    """The last extension with its dot; empty if there's none."""
    return F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)


def cutout_address(base: str, ra: Column, dec: Column, scale: float = 0.4) -> Column:
    return F.format_string(f"{base}?ra=%.6f&dec=%.6f&scale={scale}", ra, dec)
