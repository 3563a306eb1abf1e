"""Column expressions on one row: ramps, penalties, directions, calendars, names and codes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directions, lengths and weights.
SECTORS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
METRES_PER_DEGREE = 111_320.0
METRES_PER_DEGREE_NORTH = 110_540.0
FACTOR_WEIGHTS = {"wind": 0.35, "edges": 0.30, "pinch": 0.20, "water": 0.15}
TRAVEL_WEIGHT = 0.30
SCORE_TOP = 1.30 * 1.25**4 * 1.2 * 1.5
METRES_PER_MILE = 1609.344


def _col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Null stays null, unlike with least and greatest."""
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def ramp(x: Column | str, lo: float, hi: float) -> Column:
    """0 at lo, 1 at hi, linear between and held beyond; lo may be above hi."""
    return clip((_col(x) - lo) / (hi - lo))


def fading(distance: Column | str, reach: float) -> Column:
    """1 at no distance, 0 from reach on and where nothing is in reach (null)."""
    return F.coalesce(clip(1 - _col(distance) / reach), F.lit(0.0))


def factor_boost(x: Column | str) -> Column:
    return 1 + 0.25 * ramp(x, 0.35, 0.65)


def spot_score(factors: dict[str, Column | str], travel: Column | str) -> Column:
    """Weighted sum of the four factors and travel, raised for each strong factor."""
    total = sum((w * _col(factors[k]) for k, w in FACTOR_WEIGHTS.items()), F.lit(0.0)) + TRAVEL_WEIGHT * _col(travel)
    for k in FACTOR_WEIGHTS:
        total = total * factor_boost(factors[k])
    return total


def habitat(edge_density: Column | str, water_density: Column | str) -> Column:
    return (0.2 + clip(_col(edge_density) / 0.3)) * (0.5 + clip(_col(water_density) / 0.3))


def score_100(smoothed: Column | str) -> Column:
    return clip(100 * 3.0 * _col(smoothed) / SCORE_TOP, 0.0, 100.0)


def strong_factors(factors: Sequence[Column | str]) -> Column:
    return sum(((_col(f) >= 0.5).cast("int") for f in factors), F.lit(0))


def penalty(paved: Column | str, houses: Column | str, recreation: Column | str) -> Column:
    """Product of what near pavement, houses and recreation sites take away."""
    n = F.greatest(_col(houses), F.lit(0.0))
    return (1 - 0.7 * ramp(paved, 800, 20)) * (1 - 0.7 * ramp(houses, 15, 60)) * F.pow(1 + n, F.lit(-0.34)) * (1 - 0.3 * ramp(recreation, 400, 50))


def usable(inside: Column, cliff: Column, road: Column, lake: Column, public: Column, walk: Column, miles: float = 1.0) -> Column:
    return inside & ~cliff & (road > 8) & ~lake & public & (walk <= miles * METRES_PER_MILE)


def unit_from(degrees: Column | str) -> Column:
    """The vector (east, north) that points where a flow from this direction goes."""
    a = F.radians(_col(degrees))
    return F.struct((-F.sin(a)).alias("east"), (-F.cos(a)).alias("north"))


def normalised(east: Column, north: Column) -> Column:
    size = F.greatest(F.hypot(east, north), F.lit(1e-9))
    return F.struct((east / size).alias("east"), (north / size).alias("north"))


def sector_index(degrees: Column | str) -> Column:
    """0 to 15, north first; each sector is centred on its direction."""
    return (F.floor((F.pmod(_col(degrees), F.lit(360.0)) + 11.25) / 22.5) % 16).cast("int")


def sector(degrees: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, SECTORS)), sector_index(degrees) + 1)


def drainage_strength(catchment: Column | str) -> Column:
    return clip((F.log10(F.greatest(_col(catchment), F.lit(1.0))) - 1.7) / 3.8)


def snow_use(depth_cm: Column | str) -> Column:
    """1 up to 25 cm, down to 0.2 at 60 cm and beyond; no measurement counts as bare ground."""
    return 1 - 0.8 * clip((F.coalesce(F.nanvl(_col(depth_cm), F.lit(None).cast("double")), F.lit(0.0)) - 25) / 35)


def walking_kmh(slope_degrees: Column | str) -> Column:
    """Tobler's pace averaged over up and down the slope, at least 0.05 km/h."""
    s = F.tan(F.radians(_col(slope_degrees)))
    up, down = 6 * F.exp(-3.5 * F.abs(s + 0.05)), 6 * F.exp(-3.5 * F.abs(-s + 0.05))
    return F.greatest((up + down) / 2, F.lit(0.05))


def wind_choice(override: Column, day: Column, dawn: Column) -> Column:
    return F.pmod(F.coalesce(override, F.nanvl(day, F.lit(None).cast("double")), dawn), F.lit(360.0))


def sunny(aspect_north: Column | str, slope: Column | str) -> Column:
    """0.5 on level and north ground, 1 on steep south ground; slope as a share."""
    return 0.5 + 0.5 * clip(-_col(aspect_north)) * clip(_col(slope) / 0.25)


def gentle(slope_degrees: Column | str) -> Column:
    """1 to 8 degrees, down to 0.5 at 25 and beyond."""
    return 1 - 0.5 * ramp(slope_degrees, 8, 25)


def base_rate(month: Column | str) -> Column:
    """Detections expected per 100 nights."""
    m = _col(month)
    return F.when(m.isin(7, 8, 9), 0.87).when(m.isin(12, 1, 2), 0.37).otherwise(0.62)


def threshold(best: Column | str) -> Column:
    return F.least(F.lit(5.0), F.greatest(F.lit(0.5), 0.2 * _col(best)))


def slug(name: Column | str, default: str = "area") -> Column:
    """Lower case, other signs as single hyphens, 60 characters at most."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(s, 1, 60), F.lit("")), F.lit(default))


def display_name(unit: Column | str, manager: Column | str) -> Column:
    u, m = F.nullif(F.trim(_col(unit)), F.lit("")), F.nullif(F.trim(_col(manager)), F.lit(""))
    return F.when(u.isNotNull() & m.isNotNull(), F.concat(u, F.lit(" ("), m, F.lit(")"))).otherwise(F.coalesce(u, m, F.lit("unnamed")))


def mentions(name: Column | str, words: Sequence[str]) -> Column:
    """Whether a name contains one of the words in any case; false for null."""
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(_col(name)), w)), F.lit(False))


def normalised_code(x: Column | str, aliases: dict[str, str]) -> Column:
    """Trimmed, lower case, `_` and blanks as hyphens, then the aliases."""
    code = F.translate(F.lower(F.trim(_col(x))), "_ ", "--")
    if not aliases:
        return code
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in aliases.items() for v in kv)), code), code)


def must_be(code: Column, allowed: Sequence[str]) -> Column:
    """The code, or an error that names it where it isn't allowed; null stays null."""
    return F.when(code.isNull() | code.isin(*allowed), code).otherwise(F.raise_error(F.concat(F.lit("not allowed: "), code)))


def open_in_month(spans: Column | str, month: Column | int) -> Column:
    """Whether one of the spans "MM/DD-MM/DD,..." touches a month; spans may run over the new year, malformed ones count as open."""
    m = F.lit(month) if isinstance(month, int) else month

    def touches(span: Column) -> Column:
        start, end = (F.try_to_number(F.nullif(F.regexp_extract(span, r"^\s*(\d{1,2})/\d{1,2}\s*-\s*(\d{1,2})/\d{1,2}\s*$", g), F.lit("")), F.lit("99")).cast("int") for g in (1, 2))
        ok = start.between(1, 12) & end.between(1, 12)
        inside = F.when(start <= end, m.between(start, end)).otherwise((m >= start) | (m <= end))
        return F.coalesce(~ok | inside, F.lit(True))

    return F.exists(F.split(_col(spans), ","), touches)


def seasonal(spans: Column | str) -> Column:
    """Not open in all twelve months."""
    return ~F.forall(F.sequence(F.lit(1), F.lit(12)), lambda m: open_in_month(spans, m))


def rate_per_100(hits: Column | str, nights: Column | str, least: float = 0.0) -> Column:
    """Per 100 nights, rounded to two places; null without nights or below the least."""
    n = _col(nights)
    return F.when(n >= least, F.round(F.try_divide(100.0 * _col(hits), n), 2))


def local_plane(lon: Column | str, lat: Column | str, lon0: float, lat0: float) -> Column:
    """Metres east and north of a point on the plane that touches there."""
    return F.struct(
        ((_col(lon) - lon0) * METRES_PER_DEGREE * math.cos(math.radians(lat0))).alias("x"), ((_col(lat) - lat0) * METRES_PER_DEGREE).alias("y")
    )


def ring_area(ring: Column | str, lat: Column | str) -> Column:
    """Square metres of a ring array<struct<lon, lat>>, by the shoelace formula on a local plane."""
    r = _col(ring)
    shifted = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    cross = F.zip_with(r, shifted, lambda p, q: p["lon"] * q["lat"] - q["lon"] * p["lat"])
    area = F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2
    return area * METRES_PER_DEGREE * F.cos(F.radians(_col(lat))) * METRES_PER_DEGREE_NORTH


def tile_xy(lon: Column | str, lat: Column | str, zoom: int) -> Column:
    """Column and row of the web-mercator tile, held inside the map."""
    n = 2**zoom
    x = F.floor((_col(lon) + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(F.radians(_col(lat)))) / math.pi) / 2 * n)
    hold = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1)).cast("int")
    return F.struct(hold(x).alias("x"), hold(y).alias("y"))


def quadkey(x: Column | str, y: Column | str, zoom: int) -> Column:
    """The digits of a tile from the coarsest level on: 1 for the east half, 2 for the south half."""
    digit = lambda level: (F.shiftright(_col(x), level - 1) % 2 + 2 * (F.shiftright(_col(y), level - 1) % 2)).cast("string")
    return F.concat(*(digit(level) for level in range(zoom, 0, -1)))


def degree_tile(lon: Column | str, lat: Column | str) -> Column:
    """Name of the one-degree tile by its north-west corner, such as n48w118."""
    north, west = F.floor(_col(lat)) + 1, F.floor(_col(lon))
    return F.format_string("%s%02d%s%03d", F.when(north >= 0, "n").otherwise("s"), F.abs(north), F.when(west < 0, "w").otherwise("e"), F.abs(west))


def sun_angle(epoch: Column | str, lon: Column | str, lat: Column | str) -> Column:
    """Degrees of the sun above the horizon, by the almanac's low-precision formulas."""
    n = _col(epoch) / 86400.0 + 2440587.5 - 2451545.0
    g = F.radians(357.528 + 0.9856003 * n)
    ecliptic = F.radians(280.460 + 0.9856474 * n + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    tilt = F.radians(23.439 - 0.0000004 * n)
    rise = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal = F.pmod(18.697374558 + 24.06570982441908 * n, F.lit(24.0)) * 15
    hour = F.radians(sidereal + _col(lon)) - rise
    phi = F.radians(_col(lat))
    return F.degrees(F.asin(F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour)))


def utm(lon: Column | str, lat: Column | str) -> Column:
    """Zone, easting and northing on WGS 84 by the Krueger series to the fourth order."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)
    zone = F.floor((_col(lon) + 180) / 6) + 1
    away, phi = F.radians(_col(lon) - (zone * 6 - 183)), F.radians(_col(lat))
    e = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(away)), F.asinh(F.sin(away) / F.hypot(t, F.cos(away)))
    east = eta + sum((c * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, c in enumerate(alpha)), F.lit(0.0))
    north = xi + sum((c * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, c in enumerate(alpha)), F.lit(0.0))
    return F.struct(
        zone.cast("int").alias("zone"), (500000 + 0.9996 * radius * east).alias("easting"), (F.when(_col(lat) < 0, 1e7).otherwise(0.0) + 0.9996 * radius * north).alias("northing")
    )


def half_precision(x: Column | str) -> Column:
    """The nearest number of 11 significant bits, ties to even: what a layer stored as float16 gives back within its normal range."""
    v = _col(x).cast("double")
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14)) - 10)
    return F.when((v == 0) | v.isNull(), v).otherwise(F.bround(v / unit) * unit)


# The months whose records are read with the run of a month.
SEASONS = {10: (5, 6, 7, 8, 9, 10, 11), 1: (12, 1, 2, 3, 4)}


def season_months(month: Column | str) -> Column:
    """The months that go with the run of a month, null where there is no such run."""
    table = F.create_map(*(x for m, months in SEASONS.items() for x in (F.lit(m), F.array(*map(F.lit, months)))))
    return F.try_element_at(table, _col(month).cast("int"))


def local_time(text: Column | str, zone: str) -> Column:
    """A date or time with or without an offset as naive time of a zone; bare dates are midnight."""
    t = _col(text)
    return F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_timestamp(t).cast("timestamp_ntz"))).otherwise(F.try_to_timestamp(t).cast("timestamp_ntz"))


# Classes of roads, surfaces, water bodies and trails as their sources code them.
DRIVABLE = ("motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "road")
MAYBE_DRIVABLE = ("track", "service")
PAVED_ROADS = ("motorway", "trunk", "primary", "secondary", "tertiary", "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link")
PAVED_SURFACES = ("paved", "asphalt", "concrete", "chipseal")
LAKE_TYPES, LAKE_CODES = (390, 436), (39000, 39004, 39009, 39010, 39011, 39012, 43600, 43601)
ON_TRAIL = ("open-dirt", "closed-road", "hiking-trail", "game-trail")
CONFIDENCE = ("certain", "probable", "possible")


def one_of(x: Column, values: Sequence[str | int]) -> Column:
    """Whether x is one of the values; false for null."""
    return F.coalesce(x.isin(*values), F.lit(False))


def drivable(tags: Column) -> Column:
    """yes, maybe (tracks and service roads) or null, of a way's tags map<string, string>."""
    t = lambda k: F.try_element_at(tags, F.lit(k))
    closed = one_of(t("access"), ("private", "no")) | one_of(t("motor_vehicle"), ("private", "no")) | one_of(t("service"), ("driveway", "parking_aisle", "drive-through"))
    return F.when(closed, None).when(one_of(t("highway"), DRIVABLE), "yes").when(one_of(t("highway"), MAYBE_DRIVABLE), "maybe")


def paved(tags: Column) -> Column:
    """A large road, or any with a paved surface."""
    t = lambda k: F.try_element_at(tags, F.lit(k))
    return one_of(t("highway"), PAVED_ROADS) | (t("highway").isNotNull() & one_of(t("surface"), PAVED_SURFACES))


def quiet(tags: Column) -> Column:
    """Neither closed to the public nor paved."""
    return ~one_of(F.try_element_at(tags, F.lit("access")), ("private", "no")) & ~paved(tags)


def is_barrier(tags: Column) -> Column:
    t = lambda k: F.try_element_at(tags, F.lit(k))
    return one_of(t("barrier"), ("fence", "wall")) | (F.coalesce(t("railway"), F.lit("")) != "") | one_of(t("man_made"), ("pipeline",))


def is_lake(ftype: Column, fcode: Column) -> Column:
    return one_of(ftype, LAKE_TYPES) | one_of(fcode, LAKE_CODES)


def is_winter_range(name: Column, notes: Column, kind: Column) -> Column:
    """Deer or elk, and winter in the notes or a regular concentration."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return (F.upper(F.coalesce(notes, F.lit(""))).contains("WINTER") | one_of(kind, ("Regular Concentration",))) & (low.contains("deer") | low.contains("elk"))


def placement(trail: Column, arm: Column) -> Column:
    """on-feature, off-feature or unrecorded: by the kind of trail, without one by the arm."""
    said = F.nullif(trail, F.lit(""))
    return F.when(said.isNotNull(), F.when(said.isin(*ON_TRAIL), "on-feature").otherwise("off-feature")).when(one_of(arm, ("on-feature", "off-feature")), arm).otherwise("unrecorded")


def confident(level: Column, least: str = "probable") -> Column:
    """Whether a level is at least as sure as the least; null for a level that isn't known."""
    levels = F.array(*map(F.lit, CONFIDENCE))
    return F.nullif(F.array_position(levels, level), F.lit(0)) <= CONFIDENCE.index(least) + 1


def inside_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Half-open: the west and south borders belong to the box."""
    return (lon >= west) & (lon < east) & (lat >= south) & (lat < north)


def along_line(distance: Column, angle: Column, close: float = 1.5, reach: float = 10.0, parallel: float = 30.0) -> Column:
    """Whether a line runs along another: as close as `close`, or within reach and within so many degrees of parallel; angle: between them, degrees."""
    turned = F.abs(F.pmod(angle + 90, F.lit(180.0)) - 90)
    return F.coalesce((distance <= close) | ((distance <= reach) & (turned <= parallel)), F.lit(False))


def degree_tiles(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The names of all one-degree tiles that a box touches, from south to north, then west to east."""
    rows, cols = F.sequence(F.floor(south), F.floor(north)), F.sequence(F.floor(west), F.floor(east))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: degree_tile(c + 0.5, r + 0.5))))


def past_days(today: Column, month: Column, day: Column, years: int) -> Column:
    """The last so many yearly dates of a month and day that are before today."""
    last = F.year(today) - F.when(F.make_date(F.year(today), month, day) < today, 0).otherwise(1)
    return F.transform(F.sequence(F.lit(0), F.lit(years - 1)), lambda k: F.make_date(last - k, month, day))


def share_tag(sender: Column) -> Column:
    """A sender's name as a prefix of ids."""
    return slug(sender, "shared")
