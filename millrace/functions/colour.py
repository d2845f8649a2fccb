"""Colour algebra on structs of red, green and blue between 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = ("r", "g", "b")


def rgb(r: Column | float, g: Column | float, b: Column | float) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(float(x))).cast("double").alias(n) for n, x in zip(RGB, (r, g, b))])


def _each(function, *colours: Column) -> Column:
    return rgb(*[F.least(F.greatest(function(*[c[n] for c in colours]), F.lit(0.0)), F.lit(1.0)) for n in RGB])


def from_hex(h: Column) -> Column:
    """rrggbb, with or without a hash sign."""
    h = F.regexp_replace(h, "^#", "")
    return rgb(*[F.conv(F.substring(h, at, 2), 16, 10).cast("double") / 255 for at in (1, 3, 5)])


def to_hex(c: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.bround(c[n] * 255).cast("long"))), 2, "0") for n in RGB])


def distance(a: Column, b: Column) -> Column:
    """Euclidean."""
    return F.sqrt(sum((F.pow(a[n] - b[n], F.lit(2.0)) for n in RGB[1:]), F.pow(a[RGB[0]] - b[RGB[0]], F.lit(2.0))))


def mix(a: Column, b: Column, weight_a: float = 1.0, weight_b: float = 1.0) -> Column:
    return _each(lambda x, y: (x * weight_a + y * weight_b) / (weight_a + weight_b), a, b)


def add(a: Column, b: Column) -> Column:
    return _each(lambda x, y: x + y, a, b)


def subtract(a: Column, b: Column) -> Column:
    return _each(lambda x, y: x - y, a, b)


def negative(a: Column) -> Column:
    return _each(lambda x: 1 - x, a)


def lighten(a: Column, by: float) -> Column:
    return _each(lambda x: x + (1 - x) * by, a)


def darken(a: Column, by: float) -> Column:
    return _each(lambda x: x * (1 - by), a)


def grey(a: Column) -> Column:
    mean = (a["r"] + a["g"] + a["b"]) / 3
    return rgb(mean, mean, mean)


def to_hsl(c: Column) -> Column:
    """Hue in turns, saturation and lightness, all between 0 and 1."""
    high, low = F.greatest(*[c[n] for n in RGB]), F.least(*[c[n] for n in RGB])
    light, span = (high + low) / 2, high - low
    saturation = F.when(span == 0, 0.0).when(light <= 0.5, F.try_divide(span, high + low)).otherwise(F.try_divide(span, 2 - high - low))
    part = lambda x, y: F.try_divide(c[x] - c[y], span)
    hue = F.when(span == 0, 0.0).when(c["r"] == high, part("g", "b")).when(c["g"] == high, part("b", "r") + 2).otherwise(part("r", "g") + 4)
    return F.struct(F.pmod(hue / 6, F.lit(1.0)).alias("h"), saturation.alias("s"), light.alias("l"))


def from_hsl(hsl: Column) -> Column:
    """The inverse of ``to_hsl``."""
    spread = hsl["s"] * F.least(hsl["l"], 1 - hsl["l"])

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + hsl["h"] * 12, F.lit(12.0))
        return hsl["l"] - spread * F.greatest(F.least(k - 3, 9 - k, F.lit(1.0)), F.lit(-1.0))

    return rgb(channel(0), channel(8), channel(4))


def gradient(a: Column, b: Column, steps: int) -> Column:
    """``steps`` colours from ``a`` to ``b``, ends included."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: rgb(*[a[n] + (b[n] - a[n]) * i / max(steps - 1, 1) for n in RGB]))


def to_hsv(c: Column) -> Column:
    high, low = F.greatest(*[c[n] for n in RGB]), F.least(*[c[n] for n in RGB])
    return F.struct(to_hsl(c)["h"].alias("h"), F.when(high == 0, 0.0).otherwise(F.try_divide(high - low, high)).alias("s"), high.alias("v"))


def from_hsv(hsv: Column) -> Column:
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + hsv["h"] * 6, F.lit(6.0))
        return hsv["v"] * (1 - hsv["s"] * F.greatest(F.least(k, 4 - k, F.lit(1.0)), F.lit(0.0)))

    return rgb(channel(5), channel(3), channel(1))


def _with_hsl(c: Column, **changed) -> Column:
    hsl = to_hsl(c)
    return from_hsl(F.struct(*[(changed[n](hsl[n]) if n in changed else hsl[n]).alias(n) for n in "hsl"]))


def saturate(c: Column, by: float) -> Column:
    return _with_hsl(c, s=lambda s: s + (1 - s) * by)


def pale(c: Column, by: float) -> Column:
    return _with_hsl(c, s=lambda s: s * (1 - by))


def shift_hue(c: Column, turns: float) -> Column:
    return _with_hsl(c, h=lambda h: F.pmod(h + turns, F.lit(1.0)))


def nearest(c: Column, palette: dict[str, str]) -> Column:
    """The name of the nearest colour of a palette of hexadecimal values, the first of equally near ones."""
    ranked = [F.struct(distance(c, from_hex(F.lit(h))).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, h) in enumerate(palette.items())]
    return (F.least(*ranked) if len(ranked) > 1 else ranked[0])["n"]
