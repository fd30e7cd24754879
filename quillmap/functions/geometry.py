"""Eras, angles and sizes of the atlas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import noise

R_INNER, R_MAX, SPAN, NOW = 600.0, 7100.0, 2800.0, 2000
JITTER, ARC, SCATTER = 2.5, 140.0, 350.0
TAU = 2 * math.pi


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def era_radius(year: Column) -> Column:
    """Distance from the centre: recent years inside."""
    return R_INNER + (R_MAX - R_INNER) * clip((NOW - year) / SPAN, 0.0, 1.0)


def year_of_radius(radius: Column) -> Column:
    return NOW - (radius - R_INNER) / (R_MAX - R_INNER) * SPAN


def uncertainty(birth: Column, death: Column) -> Column:
    """How vague a date is: round years are vaguer, and early ones."""
    y = F.abs(death)
    base = F.when(F.coalesce(birth == death, F.lit(False)), 1.0).when((y % 1000 == 0) & (death != 0), 1.0).when(y % 100 == 0, 0.7).when(y % 10 == 0, 0.3).otherwise(0.1)
    return clip((1000 - death) / 1000.0, 0.0, 1.0) * F.greatest(base, F.lit(0.3))


def reflect(radius: Column) -> Column:
    return F.when(radius < R_INNER, 2 * R_INNER - radius).otherwise(radius)


def placed_radius(ident: Column, birth: Column, death: Column) -> Column:
    return reflect(era_radius(death) + JITTER * noise.normal(ident, "radius") + SCATTER * noise.normal(ident, "scatter") * uncertainty(birth, death))


def base_angle(lon: Column, turn: Column) -> Column:
    """The longitude on the circle; without one a share of it."""
    return F.coalesce((lon + 180) / 360 * TAU, turn * TAU)


def wrap(angle: Column) -> Column:
    return F.pmod(angle, F.lit(TAU))


def placed_angle(ident: Column, base: Column, radius: Column) -> Column:
    return wrap(base + noise.normal(ident, "angle") * ARC / F.greatest(radius, F.lit(R_INNER)))


def book_scale(words: Column) -> Column:
    """Size from the logarithm of an article's words, 100 to 5000 onto 0.8 to 2.6."""
    w = clip(F.coalesce(words, F.lit(100)).cast("double"), 100.0, 5000.0)
    return 0.8 + 1.8 * (F.ln(w) - math.log(100)) / (math.log(5000) - math.log(100))


def smootherstep(t: Column) -> Column:
    t = clip(t, 0.0, 1.0)
    return t * t * t * (t * (t * 6 - 15) + 10)


def decade(year: Column) -> Column:
    """A year rounded half up to ten, for display."""
    return (F.floor(year / 10 + 0.5) * 10).cast("int")


def bearing(dx: Column, dz: Column, facing: Column, half_span: float) -> Column:
    """Place from 0 to 1 on a compass of `half_span` to either side, 0.5 ahead; what lies behind goes to an edge."""
    turn = F.atan2(dx, dz) - facing
    return 0.5 - 0.5 * clip(F.atan2(F.sin(turn), F.cos(turn)) / half_span, -1.0, 1.0)


def hue_arc(a: Column, b: Column) -> Column:
    """Shortest signed turn from a to b in turns."""
    return F.pmod(b - a + 0.5, F.lit(1.0)) - 0.5


def sector(angle: Column, n: int = 24) -> Column:
    return F.least(F.floor(wrap(angle) / (TAU / n)), F.lit(n - 1)).cast("int")


def ring(radius: Column, most: Column, n: int = 14) -> Column:
    return clip(F.floor(radius / F.when(most > 0, most).otherwise(1.0) * n), 0, n - 1).cast("int")


def imul(a: Column, b: Column | int) -> Column:
    """The low 32 bits of a product of 32-bit numbers held in longs, by 16-bit halves, so that no long overflows."""
    b = F.lit(b).cast("long") if isinstance(b, int) else b
    high = F.pmod(F.shiftrightunsigned(a, 16) * b.bitwiseAND(65535) + a.bitwiseAND(65535) * F.shiftrightunsigned(b, 16), F.lit(65536))
    return F.pmod(high * 65536 + a.bitwiseAND(65535) * b.bitwiseAND(65535), F.lit(1 << 32))


def _word(x: Column) -> Column:
    return F.pmod(x.cast("long"), F.lit(1 << 32))


#: Multipliers and the mask of the two hashes of a row's number.
NEAR_HASH, FAR_HASH, FAR_MASK = 2654435761, 2246822519, 0x9E3779B9


def near_hash(i: Column) -> Column:
    """A hash of a row's number in [0, 1)."""
    return imul(_word(i), NEAR_HASH) / float(1 << 32)


def far_hash(i: Column) -> Column:
    """Another one."""
    return imul(_word(i).bitwiseXOR(F.lit(FAR_MASK).cast("long")), FAR_HASH) / float(1 << 32)


def mulberry(seed: Column, n: Column) -> Column:
    """The n-th number in [0, 1), from 1, of the mulberry32 generator of a seed; its state moves by a fixed step, so any number is at hand."""
    a = _word(_word(seed) + imul(_word(n), 0x6D2B79F5))
    one = lambda x: x.bitwiseOR(F.lit(1).cast("long"))
    t = imul(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), one(a))
    t = _word(t + imul(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseXOR(t)
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / float(1 << 32)
