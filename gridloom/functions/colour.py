"""Colour spaces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of CIE: red, green and blue (sRGB, linear) in X, Y and Z, and the white point D65.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


def lab(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* of bytes of sRGB, as whole numbers from 0 to 255: L* by 255 / 100, a* and b* from 128."""

    def linear(c: Column) -> Column:
        s = c.cast("double") / 255.0
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    bands = [linear(c) for c in (red, green, blue)]
    x, y, z = ((a * bands[0] + b * bands[1] + c * bands[2]) / w for (a, b, c), w in zip(XYZ, WHITE, strict=True))
    root = lambda t: F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)
    lightness = F.when(y > 0.008856, 116.0 * F.cbrt(y) - 16.0).otherwise(903.3 * y)
    return F.rint(lightness * 2.55), F.rint(500.0 * (root(x) - root(y)) + 128.0), F.rint(200.0 * (root(y) - root(z)) + 128.0)
