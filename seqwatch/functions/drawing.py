"""What maps are drawn with: colours on a ramp, paths, round numbers. All are expressions that give text or whole numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The colours of the lowest to the highest count, at equal distances, and of no count.
RAMP = ("#FCDACA", "#F49489", "#EA332F", "#E60D0C", "#7C000C")
NO_VALUE = "#CCCCCC"

# The sRGB primaries in XYZ, back again, and the white of D65.
_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
_FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
_WHITE = (0.95047, 1.0, 1.08883)
_STEP = 6 / 29


def lab_of(colour: str) -> tuple[float, float, float]:
    """A colour #RRGGBB as lightness and the two opponents of CIE Lab."""
    shares = [int(colour[i : i + 2], 16) / 255 for i in (1, 3, 5)]
    linear = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in shares]
    xyz = [sum(m * c for m, c in zip(row, linear, strict=True)) / white for row, white in zip(_TO_XYZ, _WHITE, strict=True)]
    x, y, z = (t ** (1 / 3) if t > _STEP**3 else t / (3 * _STEP**2) + 4 / 29 for t in xyz)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def ramp_colour(position: Column, colours: Sequence[str] = RAMP, missing: str = NO_VALUE) -> Column:
    """The colour at a position from 0 to 1, mixed in Lab between its neighbours on the ramp; ``missing`` for NULL."""
    stops = [lab_of(c) for c in colours]
    last = len(stops) - 1
    place = F.least(F.greatest(position, F.lit(0.0)), F.lit(1.0)) * last
    # Each step's numbers are fields of the one before, so that none is computed twice.
    at = F.array(F.struct(F.least(F.floor(place), F.lit(last - 1)).cast("int").alias("i"), place.alias("place")))

    def mixed(p: Column, k: int) -> Column:
        low = F.array(*[F.lit(stop[k]) for stop in stops])
        return F.get(low, p["i"]) + (p["place"] - p["i"]) * (F.get(low, p["i"] + 1) - F.get(low, p["i"]))

    lab = F.transform(at, lambda p: F.struct(*[mixed(p, k).alias(n) for k, n in enumerate(("l", "a", "b"))]))
    bent = F.transform(lab, lambda c: F.struct(
        ((c["l"] + 16) / 116 + c["a"] / 500).alias("x"), ((c["l"] + 16) / 116).alias("y"), ((c["l"] + 16) / 116 - c["b"] / 200).alias("z"),
    ))

    def unbent(t: Column, white: float) -> Column:
        return white * F.when(t > _STEP, t * t * t).otherwise(3 * _STEP**2 * (t - 4 / 29))

    xyz = F.transform(bent, lambda t: F.struct(*[unbent(t[n], white).alias(n) for n, white in zip("xyz", _WHITE, strict=True)]))
    rgb = F.transform(xyz, lambda t: F.struct(*[
        F.least(F.greatest(sum((m * t[n] for m, n in zip(row[1:], "yz", strict=True)), row[0] * t["x"]), F.lit(0.0)), F.lit(1.0)).alias(n)
        for row, n in zip(_FROM_XYZ, "rgb", strict=True)
    ]))

    def byte(c: Column) -> Column:
        share = F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)
        return F.lpad(F.hex(F.floor(share * 255 + 0.5)), 2, "0")

    found = F.transform(rgb, lambda c: F.concat(F.lit("#"), byte(c["r"]), byte(c["g"]), byte(c["b"])))[0]
    return F.when(position.isNull(), missing).otherwise(found)


def round_step(most: Column) -> Column:
    """The largest of 1, 2 and 5 times a power of ten that isn't more."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(most)))
    return F.when(5 * power <= most, 5 * power).when(2 * power <= most, 2 * power).otherwise(power)


def escaped(text: Column) -> Column:
    """Text for XML."""
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def path(polygons: Column, x_of, y_of) -> Column:
    """The rings as the data of an SVG path, in whole units: ``x_of`` and ``y_of`` say where a point is."""
    point = lambda p: F.concat_ws(" ", F.round(x_of(p["x"])).cast("long"), F.round(y_of(p["y"])).cast("long"))
    ring = lambda r: F.concat(F.lit("M"), F.array_join(F.transform(r, point), "L"), F.lit("Z"))
    return F.array_join(F.transform(F.filter(F.flatten(polygons), lambda r: F.size(r) > 0), ring), "")


def inches(size: float, units: int) -> int:
    return math.floor(size * units)
