"""Geohash decoding (F7) and spatial prefixes (F8) as native column expressions.

A geohash of n characters is 5n bits, longitude and latitude interleaved
(longitude first).  Decoding = translate the geohash alphabet to base-32 digits,
``conv`` to a bit string, split even/odd bits, read each half as an integer k
over m bits; the cell midpoint is ``lo + span * (k + 0.5) / 2^m``.  No Python; equal to interval
bisection bit for bit as long as a double holds the bits.  Text of any length is decoded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zonecast.schema import GEOHASH_ALPHABET

_BASE32_DIGITS = "0123456789abcdefghijklmnopqrstuv"
_VALID = r"^[0-9b-hjkmnp-z]+$"
# conv() works on 64-bit values: text is decoded 12 characters (60 bits) at a time.
_CHUNK = 12


def _bits(g: Column) -> Column:
    """The bits of at most ``_CHUNK`` lower-case geohash characters."""
    return F.lpad(F.conv(F.translate(g, GEOHASH_ALPHABET, _BASE32_DIGITS), 32, 2), F.length(g) * 5, "0")


def _fraction(bits: Column, group: str) -> Column:
    """The number 0.b1 b2 b3 ... of every second bit (longitude: $1, latitude: $2)."""
    half = F.regexp_replace(bits, "(.)(.?)", group)
    return F.conv(half, 2, 10).cast("bigint").cast("double") / F.pow(F.lit(2.0), F.length(half))


def _midpoint(g: Column, group: str, lo: float, span: float) -> Column:
    n = F.length(g)
    # chunks of an even number of bits keep longitude first; each adds its part of the fraction
    chunks = F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int"))
    part = lambda i: F.coalesce(_fraction(_bits(F.substr(g, i * _CHUNK + 1, F.lit(_CHUNK))), group), F.lit(0.0))
    long = F.aggregate(chunks, F.lit(0.0), lambda acc, i: acc + part(i) / F.pow(F.lit(2.0), i * (_CHUNK * 5 // 2)))
    at = F.when(n <= _CHUNK, F.coalesce(_fraction(_bits(F.substring(g, 1, _CHUNK)), group), F.lit(0.0))).otherwise(long)
    m = F.floor((n * 5 + (1 if group == "$1" else 0)) / 2)
    return F.lit(lo) + F.lit(span) * (at + F.lit(0.5) / F.pow(F.lit(2.0), m))


def geohash_latlon(geohash: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of the cell midpoint; NULL for NULL/empty/invalid."""
    g = F.lower(geohash)
    valid = g.rlike(_VALID)
    return (F.when(valid, _midpoint(g, "$2", -90.0, 180.0)), F.when(valid, _midpoint(g, "$1", -180.0, 360.0)))


def with_geohash_latlon(df, col: str = "geohash", lat: str = "latitude",
                        lon: str = "longitude"):
    la, lo = geohash_latlon(F.col(col))
    return df.withColumn(lat, la).withColumn(lon, lo)


def geo_prefix(geohash: Column, n: int) -> Column:
    """First n characters (Python slicing semantics: shorter strings unchanged)."""
    return F.substring(geohash, 1, n)


def with_geo_prefixes(df, col: str = "geohash"):
    return df.withColumns({f"geo_prefix_{n}": geo_prefix(F.col(col), n) for n in (5, 4, 3)})
