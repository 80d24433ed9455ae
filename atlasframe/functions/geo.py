"""Geohashes as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the geohash alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
MAX_PRECISION = 12


def _spread(three: int, two: int) -> int:
    """Five bits, the first, third and fifth from ``three`` and the others from ``two``."""
    return (three & 4) << 2 | (two & 2) << 2 | (three & 2) << 1 | (two & 1) << 1 | three & 1


_REORDERED = "".join(ALPHABET[_spread(i >> 2, i & 3)] for i in range(32))


def valid_coordinate(lat: Column, lon: Column) -> Column:
    """Whether both can be encoded: finite, latitude in [-90, 90)."""
    finite = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lon) < float("inf"))
    return F.coalesce(finite & (lat >= -90) & (lat < 90), F.lit(False))


def geohash(lat: Column, lon: Column, precision: int = MAX_PRECISION) -> Column:
    """The cell of a point, of up to 12 characters; longitudes wrap; null where the point is invalid.

    Both coordinates become 30-bit integers.  A character's five bits alternate between them, three
    of one and two of the other; the two groups pick the character from the alphabet, reordered so
    that they need no interleaving.  Everything stays inside code generation; validity is tested in the two
    integers, since only outside of a condition Spark computes each once for all characters.
    """
    ok = valid_coordinate(lat, lon)
    wrapped = lon - F.floor((lon + 180) / 360) * 360
    y = F.when(ok, F.floor((lat + 90) / 180 * F.lit(float(1 << 30))).cast("int"))
    x = F.when(ok, F.least(F.floor((wrapped + 180) / 360 * F.lit(float(1 << 30))), F.lit((1 << 30) - 1)).cast("int"))

    def char(k: int) -> Column:
        three, two = (x, y) if k % 2 == 0 else (y, x)
        high = F.shiftright(three, 30 - 3 - 5 * (k // 2) - 2 * (k % 2)).bitwiseAND(F.lit(7))
        low = F.shiftright(two, 30 - 2 - 5 * (k // 2) - 3 * (k % 2)).bitwiseAND(F.lit(3))
        return F.substr(F.lit(_REORDERED), high * 4 + low + 1, F.lit(1))

    return F.concat(*[char(k) for k in range(precision)])


def common_prefix(a: Column, b: Column, longest: int) -> Column:
    """Length of the longest common prefix, as far as ``longest``; 0 if either is null."""
    out = F.lit(0)
    for n in range(1, longest + 1):
        same = (F.length(a) >= n) & (F.length(b) >= n) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n)))
        out = F.when(same, F.lit(n)).otherwise(out)
    return F.coalesce(out, F.lit(0))
