"""Sky geometry as Column expressions; all angles in degrees unless a name says otherwise."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The rotation from equatorial (ICRS) to galactic axes, row by row.
GALACTIC = ((-0.0548755604, -0.8734370902, -0.4838350155), (0.4941094279, -0.4448296300, 0.7469822445), (-0.8676661490, -0.1980763734, 0.4559837762))
SUN_DISTANCE_KPC = 8.2


def unit_vector(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(ra), F.radians(dec)
    return F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d)


def chord_of_angle(angle: Column) -> Column:
    return 2 * F.sin(F.radians(angle) / 2)


def angle_of_chord(chord: Column) -> Column:
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), chord / 2)))


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Haversine, the sine's square held within 0..1."""
    s = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    a = s(dec2 - dec1) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * s(ra2 - ra1)
    return F.degrees(2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))))


def tangent_plane(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """Gnomonic (xi, eta) about (ra0, dec0)."""
    a, d, d0 = F.radians(ra - ra0), F.radians(dec), F.radians(dec0)
    down = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(a)
    xi = F.cos(d) * F.sin(a) / down
    eta = (F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(a)) / down
    return F.degrees(xi), F.degrees(eta)


def elliptical_radius(xi: Column, eta: Column, ellipticity: Column, position_angle: Column) -> Column:
    """Radius with the minor axis stretched; ellipticity is held to 0..0.95."""
    e = F.least(F.lit(0.95), F.greatest(F.lit(0.0), ellipticity))
    t = F.radians(position_angle)
    major, minor = xi * F.sin(t) + eta * F.cos(t), xi * F.cos(t) - eta * F.sin(t)
    return F.sqrt(major * major + F.pow(minor / (1 - e), 2))


def galactic(ra: Column, dec: Column) -> tuple[Column, Column]:
    x, y, z = unit_vector(ra, dec)
    gx, gy, gz = (F.lit(a) * x + F.lit(b) * y + F.lit(c) * z for a, b, c in GALACTIC)
    return F.pmod(F.degrees(F.atan2(gy, gx)), F.lit(360.0)), F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), gz))))


def galactocentric_radius(lon: Column, lat: Column, distance: Column) -> Column:
    x = distance * F.cos(F.radians(lat)) * F.cos(F.radians(lon)) - SUN_DISTANCE_KPC
    y = distance * F.cos(F.radians(lat)) * F.sin(F.radians(lon))
    z = distance * F.sin(F.radians(lat))
    return F.sqrt(x * x + y * y + z * z)


def degree_pixel(ra: Column, dec: Column) -> Column:
    """One-degree pixel number."""
    return (F.floor(ra) % 360 * 180 + F.floor(dec + 90) % 180).cast("long")


def healpix_ring(ra: Column, dec: Column, nside: int) -> Column:
    """Ring-ordered HEALPix pixel (Gorski et al. 2005), without a Python function."""
    z = F.sin(F.radians(dec))
    tt = F.pmod(ra, F.lit(360.0)) / 90.0
    flat = lambda x: F.floor(x).cast("long")
    # equatorial belt
    t1, t2 = nside * (0.5 + tt), nside * z * 0.75
    up, down = flat(t1 - t2), flat(t1 + t2)
    ring = nside + 1 + up - down
    shift = F.pmod(ring + 1, F.lit(2))
    column = F.pmod(F.floor((up + down - nside + shift + 1) / 2), F.lit(4 * nside))
    belt = 2 * nside * (nside - 1) + (ring - 1) * 4 * nside + column
    # polar caps
    tp = tt - F.floor(tt)
    tmp = nside * F.sqrt(3 * (1 - F.abs(z)))
    jp, jm = flat(tp * tmp), flat((1 - tp) * tmp)
    r = jp + jm + 1
    ip = F.pmod(flat(tt * r), 4 * r)
    cap = F.when(z > 0, 2 * r * (r - 1) + ip).otherwise(12 * nside * nside - 2 * r * (r + 1) + ip)
    return F.when(F.abs(z) <= 2.0 / 3.0, belt).otherwise(cap).cast("long")


def healpix_nested(ra: Column, dec: Column, nside: int) -> Column:
    """Nested HEALPix pixel (Gorski et al. 2005) of a power of two nside: the face, then the bits of its two axes in turn."""
    assert nside & (nside - 1) == 0
    z, tt = F.sin(F.radians(dec)), F.pmod(ra, F.lit(360.0)) / 90.0
    flat = lambda x: F.floor(x).cast("long")
    down, up = flat(nside * (0.5 + tt) - nside * z * 0.75), flat(nside * (0.5 + tt) + nside * z * 0.75)
    f_down, f_up = flat(down / nside), flat(up / nside)
    belt_face = F.when(f_down == f_up, F.when(f_down < 4, f_down + 4).otherwise(f_down)).when(f_down < f_up, f_down).otherwise(f_up + 8)
    quarter = F.least(flat(tt), F.lit(3))
    reach = nside * F.sqrt(3 * (1 - F.abs(z)))
    p = F.least(flat((tt - quarter) * reach), F.lit(nside - 1))
    m = F.least(flat((1 - tt + quarter) * reach), F.lit(nside - 1))
    belt, north = F.abs(z) <= 2.0 / 3.0, z > 0
    face = F.when(belt, belt_face).when(north, quarter).otherwise(quarter + 8)
    x = F.when(belt, F.pmod(up, F.lit(nside))).when(north, nside - 1 - m).otherwise(p)
    y = F.when(belt, nside - 1 - F.pmod(down, F.lit(nside))).when(north, nside - 1 - p).otherwise(m)
    pixel = face * nside * nside
    for bit in range(nside.bit_length() - 1):
        pixel = pixel + flat(x / 2**bit) % 2 * 4**bit + flat(y / 2**bit) % 2 * (2 * 4**bit)
    return pixel.cast("long")


def healpix_area_deg2(nside: int) -> float:
    return 4 * math.pi * (180 / math.pi) ** 2 / (12 * nside * nside)


def propagate(ra: Column, dec: Column, pmra: Column, pmdec: Column, years: Column) -> tuple[Column, Column]:
    """Linear motion in mas/yr; rows without proper motion stay."""
    c = F.cos(F.radians(dec))
    c = F.when(F.abs(c) < 1e-10, 1e-10).otherwise(c)
    return F.coalesce(ra + pmra * years / (c * 3.6e6), ra), F.coalesce(dec + pmdec * years / 3.6e6, dec)


def space_motion(ra: Column, dec: Column, pmra: Column, pmdec: Column, years: Column, rv: Column | None = None, kpc: Column | None = None) -> tuple[Column, Column]:
    """Straight motion in space: pmra (with cos dec) and pmdec in mas/yr, and where both are known rv in km/s at a distance
    in kpc, without which the distance does not change. Rows without proper motion stay."""
    sa, ca, sd, cd = F.sin(F.radians(ra)), F.cos(F.radians(ra)), F.sin(F.radians(dec)), F.cos(F.radians(dec))
    along = lambda pm: F.radians(pm / 3.6e6) * years
    grown = F.lit(1.0) if rv is None or kpc is None else 1 + F.coalesce(F.when(kpc > 0, rv / kpc), F.lit(0.0)) * 1.0227121650537077e-9 * years
    a, d = along(pmra), along(pmdec)
    x, y, z = grown * cd * ca - a * sa - d * sd * ca, grown * cd * sa + a * ca - d * sd * sa, grown * sd + d * cd
    return F.coalesce(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), ra), F.coalesce(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), dec)


def parallax_distance(parallax: Column) -> Column:
    """kpc from mas; none for a parallax that is not positive."""
    return F.when(parallax > 0, 1 / parallax)


def distance_modulus(kpc: Column) -> Column:
    return 5 * F.log10(F.greatest(kpc, F.lit(0.01)) * 1000) - 5


def better_distance(d: Column, d_err: Column, plx: Column, plx_err: Column) -> Column:
    """The distance, or the parallax's where its relative error is smaller."""
    rel_d, rel_p = F.abs(F.try_divide(d_err, d)), F.abs(F.try_divide(plx_err, plx))
    return F.when(rel_d.isNull(), parallax_distance(plx)).when(rel_p.isNull() | (plx <= 0) | (rel_d <= rel_p), d).otherwise(1 / plx)


def parallaxes_agree(a: Column, b: Column, sigma: float = 3.0, share: float = 0.2) -> Column:
    """a, b: arrays of struct(value, error). True if either is empty or any two values agree within sigma
    combined errors, or within a share of the larger; an error that is missing or not positive counts as
    a tenth of its value."""
    err = lambda x: F.when(x["error"] > 0, x["error"]).otherwise(0.1 * F.abs(x["value"]))

    def near(x, y):
        gap = F.abs(x["value"] - y["value"])
        return (gap <= sigma * F.sqrt(err(x) * err(x) + err(y) * err(y))) | F.coalesce(F.try_divide(gap, F.greatest(F.abs(x["value"]), F.abs(y["value"]))) < share, F.lit(False))

    given = lambda xs: F.filter(F.coalesce(xs, F.array()), lambda x: x["value"].isNotNull())
    return (F.size(given(a)) == 0) | (F.size(given(b)) == 0) | F.exists(given(a), lambda x: F.exists(given(b), lambda y: near(x, y)))


def parallax_within(p1: Column, e1: Column, p2: Column, e2: Column, sigma: float = 3.0, floor: float = 1.0, default: float = 0.5) -> Column:
    """Difference within the larger of sigma combined errors and a floor; unknown values pass."""
    e1, e2 = F.coalesce(e1, F.lit(default)), F.coalesce(e2, F.lit(default))
    return F.coalesce(F.abs(p1 - p2) <= F.greatest(sigma * F.sqrt(e1 * e1 + e2 * e2), F.lit(floor)), F.lit(True))


def parallax_near(left, right, sigma: float = 3.0, floor: float = 1.0, default: float = 0.5):
    """parallax_within of arrays (parallax, error) that broadcast, where unknown values are NaN."""
    (p1, e1), (p2, e2) = left, right
    e1, e2 = (np.where(np.isnan(e), default, e) for e in (e1, e2))
    return ~(np.abs(p1 - p2) > np.fmax(sigma * np.sqrt(e1 * e1 + e2 * e2), floor))
