"""Magnitudes, contrasts, angular units and detector response as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC = 180 * 3600 / math.pi
# Bits of a data-quality flag.
BAD_PIXEL, SATURATED, NOT_OVERLAPPING, INTERPOLATED, BG_ESTIMATE_PIX = 1, 2, 4, 8, 16
# The published response polynomial of the detector, lowest power first, and where it holds.
LINEARITY = (112.575, 1.00273, -1.40776e-6, 4.59015e-11)
LINEARITY_DOMAIN = (2.7e4, 4.5e4)


def apparent_mag(absolute: Column, parsec: Column) -> Column:
    return 5 * F.log10(parsec / 10) + absolute


def absolute_mag(apparent: Column, parsec: Column) -> Column:
    return apparent - 5 * F.log10(parsec / 10)


def contrast_to_deltamag(contrast: Column) -> Column:
    return -2.5 * F.log10(contrast)


def deltamag_to_contrast(deltamag: Column) -> Column:
    return F.pow(F.lit(10.0), deltamag / -2.5)


def stddev_to_mag_err(value: Column, stddev: Column) -> Column:
    return F.abs(-2.5 * stddev / (value * math.log(10)))


def lambda_over_d_to_arcsec(x: Column, wavelength_m: float, diameter_m: float) -> Column:
    return x * (wavelength_m / diameter_m * ARCSEC)


def arcsec_to_lambda_over_d(x: Column, wavelength_m: float, diameter_m: float) -> Column:
    return x / (wavelength_m / diameter_m * ARCSEC)


def arcsec_to_pixel(x: Column, arcsec_per_px: float) -> Column:
    return x / arcsec_per_px


def pixel_to_arcsec(x: Column, arcsec_per_px: float) -> Column:
    return x * arcsec_per_px


def horner(x: Column, coefficients) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        out = out * x + float(c)
    return out


def linearised(v: Column, coefficients=LINEARITY, domain=LINEARITY_DOMAIN) -> Column:
    """The response polynomial within its domain, which is first mapped linearly to the polynomial's values at its ends."""
    lo, hi = domain
    at = lambda x: sum(c * x**k for k, c in enumerate(coefficients))
    a, b = at(lo), at(hi)
    mapped = (v - lo) * ((b - a) / (hi - lo)) + a
    return F.when((v >= lo) & (v <= hi), horner(mapped, coefficients)).otherwise(v)


def flagged(dq: Column, where: Column, flag: int) -> Column:
    """dq with `flag` set where the condition holds."""
    return F.when(where, dq.bitwiseOR(F.lit(flag))).otherwise(dq)


def permitted(v: Column, dq: Column, flags: int) -> Column:
    """v where no flag but the permitted ones is set, else NULL."""
    return F.when(dq.bitwiseAND(F.lit(~flags)) == 0, v)
