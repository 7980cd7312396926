"""Scalar rules of terrain, imagery, elevation sources and walking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Heights of a storey and square metres for a resident and for an evacuee.
FLOOR_M, M2_PER_PERSON, M2_PER_EVACUEE = 3.0, 15.0, 3.5
#: Vertical datum by elevation source.
DATUMS = {
    "copernicus_glo30": "EGM2008",
    "cartodem": "WGS84 ellipsoid (CartoDEM V3R1)",
    "srtm": "EGM96",
    "nasadem": "EGM96",
    "synthetic": "WGS84 ellipsoid (synthetic, CartoDEM-like)",
}
ELLIPSOIDAL = ("cartodem", "synthetic")
COVERS = ("flat ground", "hillside", "forest on a slope", "flat greenery", "building", "water")


def tobler_speed(slope: Column) -> Column:
    """Walking speed in metres a second on a signed slope."""
    return 6.0 * F.exp(-3.5 * F.abs(slope + 0.05)) / 3.6


def excess_green(red: Column, green: Column, blue: Column) -> Column:
    r, g, b = (x.cast("double") for x in (red, green, blue))
    return (2 * g - r - b) / (r + g + b + 1)


def water_colour(red: Column, green: Column, blue: Column) -> Column:
    """Is a (blurred) colour that of open water: blue hue, some saturation, neither black nor white."""
    r, g, b = (x.cast("double") / 255 for x in (red, green, blue))
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    hue = F.when(span == 0, 0.0).when(top == r, F.pmod(60 * (g - b) / span, F.lit(360.0))).when(top == g, 60 * (b - r) / span + 120).otherwise(60 * (r - g) / span + 240)
    saturation = F.when(top == 0, 0.0).otherwise(span / top)
    return (hue > 185) & (hue < 250) & (saturation > 0.25) & (top > 0.08) & (top < 0.8)


def land_cover(building: Column, water: Column, green: Column, slope: Column) -> Column:
    """Codes 0 to 5, places in COVERS."""
    hillside = slope >= 15
    return F.when(water, 5).when(building, 4).when(hillside & green, 2).when(hillside, 1).when(green, 3).otherwise(0).cast("int")


def confidence(sigma: Column, height: Column, shadow: Column, water: Column) -> Column:
    """2 good, 1 fair, 0 poor, for heights in metres; shadow is fair at best, water poor."""
    found = F.when(sigma < F.greatest(F.lit(2.0), 0.2 * height), 2).when(sigma < F.greatest(F.lit(5.0), 0.5 * height), 1).otherwise(0)
    return F.when(water, 0).when(shadow, F.least(found, F.lit(1))).otherwise(found).cast("int")


def relative_confidence(doubt: Column, q60: Column, q90: Column, shadow: Column, water: Column) -> Column:
    """2, 1 or 0 as confidence() for heights without a unit: by the scene's own quantiles of doubt."""
    found = F.when(doubt <= q60, 2).when(doubt <= q90, 1).otherwise(0)
    return F.when(water, 0).when(shadow, F.least(found, F.lit(1))).otherwise(found).cast("int")


def landslide_score(slope: Column, accumulation_share: Column, vegetation: Column) -> Column:
    steep = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (slope - 15) / 25))
    return 0.6 * steep + 0.25 * F.when(slope > 10, accumulation_share).otherwise(0.0) + 0.15 * (1 - vegetation)


def population(building: Column, height: Column, cell_area: float, metric: bool = True) -> Column:
    floors = F.greatest(F.lit(1.0), F.rint(height / FLOOR_M)) if metric else F.lit(1.0)
    return F.when(building, cell_area * floors / M2_PER_PERSON).otherwise(0.0)


def leading_number(text: Column) -> Column:
    """The number that a tag begins with, such as 12.5 of "12.5 m"; else null."""
    return F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def tagged_height(height: Column, levels: Column) -> Column:
    """Height tag, else storeys and a roof; zero counts as missing."""
    return F.coalesce(F.nullif(leading_number(height), F.lit(0.0)), F.nullif(leading_number(levels), F.lit(0.0)) * FLOOR_M + 1.0)


def dem_source(path: Column, tag: Column) -> Column:
    """Elevation source by tag, by a word of the path, by the shape of a tile's name, or else the file's own name."""
    low = F.lower(path)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")
    words = (("carto", "cartodem"), ("copernicus", "copernicus_glo30"), ("nasadem", "nasadem"), ("srtm", "srtm"))
    named = F.coalesce(*[F.when(low.contains(w), F.lit(n)) for w, n in words])
    shaped = F.when(F.lower(stem).rlike(r"^cdn.[0-9]{2}.$"), "cartodem")
    return F.coalesce(F.nullif(tag, F.lit("")), named, shaped, stem)


def datum(source: Column) -> Column:
    return F.coalesce(*[F.when(source == k, F.lit(v)) for k, v in DATUMS.items()], F.lit("unknown"))


def datum_shift(source: Column, manual: Column, geoid: Column, tagged: Column, measured: Column) -> Column:
    """What is added to heights: the user's offset, or for ellipsoidal sources minus the geoid by the best source."""
    own = F.nullif(manual, F.lit(0.0))
    return F.coalesce(own, F.when(source.isin(*ELLIPSOIDAL), -F.coalesce(geoid, tagged, measured)), F.lit(0.0))


def zone_name(rank: Column) -> Column:
    """A to Z, then AA, AB and so on, for 0, 1, 2 ... up to any 32-bit rank."""
    name, left = F.lit(""), rank.cast("long") + 1
    for _ in range(7):  # 26 ** 7 is beyond 2 ** 31
        name = F.concat(F.when(left > 0, F.chr((left - 1) % 26 + 65)).otherwise(""), name)
        left = F.greatest(F.floor((left - 1) / 26), F.lit(0))
    return name


def ramp(value: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear between (place, value) stops, flat beyond them."""
    out = F.when(value <= stops[0][0], F.lit(float(stops[0][1])))
    for (x0, y0), (x1, y1) in zip(stops, stops[1:], strict=False):
        out = out.when(value <= x1, y0 + (value - x0) * ((y1 - y0) / (x1 - x0)) if x1 > x0 else F.lit(float(y1)))
    return out.otherwise(F.lit(float(stops[-1][1])))


#: Colours of walking times in minutes.
TIME_STOPS = [(0, (40, 190, 90)), (5, (40, 190, 90)), (10, (240, 200, 40)), (15, (245, 140, 30)), (30, (215, 40, 40))]


def time_colour(minutes: Column) -> Column:
    """(red, green, blue, alpha) of a walking time; null means that no safe place is reached."""
    parts = [F.floor(ramp(minutes, [(x, rgb[k]) for x, rgb in TIME_STOPS])).cast("int") for k in range(3)]
    trapped = F.array(*[F.lit(x) for x in (90, 0, 120, 200)])
    return F.when(minutes.isNull(), trapped).otherwise(F.array(*parts, F.lit(150)))


def shadow_height(length: Column, gsd: Column, elevation: Column, slope_along: Column, off_nadir: Column, view_minus_sun: Column) -> Column:
    """Height in metres of what throws a shadow of ``length`` pixels; null where the view or the slope hides it."""
    tangent = F.tan(F.radians(elevation))
    k = F.greatest(tangent + slope_along, 0.2 * tangent)
    per = 1 / k - F.tan(F.radians(off_nadir)) * F.cos(F.radians(view_minus_sun))
    height = length * gsd / per
    return F.when((per >= 0.15 / k) & (height >= 2), height)
