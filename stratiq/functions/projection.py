"""Transverse Mercator on the WGS 84 ellipsoid by Krueger's series to the third order: SQL text that Spark and other engines read alike.

Good to a millimetre within the width of a zone.
"""

from __future__ import annotations

# Semi-major axis, flattening, scale on the central meridian, false easting.
AXIS, FLATTENING, SCALE, EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_E = (4 * _N) ** 0.5 / (1 + _N)


def _sql(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def forward(lon: str, lat: str, zone: str) -> tuple[str, str]:
    """Easting and northing (north of the equator) of degrees, in the zone given."""
    away = f"radians({lon} - ({zone} * 6 - 183))"
    t = f"sinh(atanh(sin(radians({lat}))) - {_sql(_E)} * atanh({_sql(_E)} * sin(radians({lat}))))"
    xi, eta = f"atan2({t}, cos({away}))", f"atanh(sin({away}) / sqrt(1 + {t} * {t}))"
    east = " + ".join([eta, *[f"{_sql(a)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1)]])
    north = " + ".join([xi, *[f"{_sql(a)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1)]])
    return f"({_sql(EAST)} + {_sql(SCALE * _RADIUS)} * ({east}))", f"({_sql(SCALE * _RADIUS)} * ({north}))"


def backward(east: str, north: str, zone: str) -> tuple[str, str]:
    """Longitude and latitude in degrees."""
    xi, eta = f"({north} / {_sql(SCALE * _RADIUS)})", f"(({east} - {_sql(EAST)}) / {_sql(SCALE * _RADIUS)})"
    x = "(" + " - ".join([xi, *[f"{_sql(b)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, b in enumerate(_BETA, 1)]]) + ")"
    e = "(" + " - ".join([eta, *[f"{_sql(b)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, b in enumerate(_BETA, 1)]]) + ")"
    chi = f"asin(sin({x}) / cosh({e}))"
    lat = " + ".join([chi, *[f"{_sql(d)} * sin({2 * j} * {chi})" for j, d in enumerate(_DELTA, 1)]])
    return f"({zone} * 6 - 183 + degrees(atan2(sinh({e}), cos({x}))))", f"degrees({lat})"
