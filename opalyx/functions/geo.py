"""Closed-form geography: spans, projection, tiles, datum shifts, confidence."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.32
TILE = 256
LATITUDE_LIMIT = 85.05112878


def valid_coordinates(lat: Column, lng: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


def box_diagonal_km(south: Column, north: Column, west: Column, east: Column) -> Column:
    tall = F.abs(north - south) * KM_PER_DEGREE
    wide = F.abs(east - west) * KM_PER_DEGREE * F.cos(F.radians((south + north) / 2))
    return F.sqrt(tall * tall + wide * wide)


def world_pixels(lat: Column, lng: Column, zoom: Column) -> Column:
    """Web-Mercator pixels (x, y) with the latitude clamped."""
    scale = F.pow(F.lit(2.0), zoom) * TILE
    s = F.sin(F.radians(F.greatest(F.least(lat, F.lit(LATITUDE_LIMIT)), F.lit(-LATITUDE_LIMIT))))
    return F.struct(((lng + 180) / 360 * scale).alias("x"), ((0.5 - F.ln((1 + s) / (1 - s)) / (4 * pi)) * scale).alias("y"))


def tiles(x: Column, y: Column, zoom: Column, side: int) -> Column:
    """Tiles (tile_x, tile_y, wrapped_x) that an image of this side around a pixel needs; rows outside the world left out."""
    per_axis = F.pow(F.lit(2), zoom).cast("long")
    low = lambda c: F.floor((c - side / 2) / TILE).cast("long")
    high = lambda c: F.floor((c + side / 2) / TILE).cast("long")
    every = F.flatten(F.transform(F.sequence(low(x), high(x)), lambda tx: F.transform(F.sequence(low(y), high(y)), lambda ty: F.struct(tx.alias("tile_x"), ty.alias("tile_y"), F.pmod(tx, per_axis).alias("wrapped_x")))))
    return F.filter(every, lambda t: (t["tile_y"] >= 0) & (t["tile_y"] < per_axis))


def _wave(x: Column, first: float, second: float) -> Column:
    return (F.lit(first) * F.sin(x * (6 * pi)) + F.lit(second) * F.sin(x * (2 * pi))) * 2 / 3


def gcj02_to_wgs84(lat: Column, lng: Column) -> Column:
    """(lat, lng) on the common datum; unchanged outside the shifted area."""
    # The shifted datum's ellipsoid, area and series.
    axis, ecc = 6378245.0, 0.00669342162296594323
    outside = (lng < 72.004) | (lng > 137.8347) | (lat < 0.8293) | (lat > 55.8271)
    x, y = lng - 105, lat - 35
    d_lat = x * 2 - 100 + y * 3 + y * y * 0.2 + x * y * 0.1 + F.sqrt(F.abs(x)) * 0.2 + _wave(x, 20, 20)
    d_lat = d_lat + (F.sin(y * pi) * 20 + F.sin(y / 3 * pi) * 40) * 2 / 3 + (F.sin(y / 12 * pi) * 160 + F.sin(y * pi / 30) * 320) * 2 / 3
    d_lng = x + 300 + y * 2 + x * x * 0.1 + x * y * 0.1 + F.sqrt(F.abs(x)) * 0.1 + _wave(x, 20, 20)
    d_lng = d_lng + (F.sin(x * pi) * 20 + F.sin(x / 3 * pi) * 40) * 2 / 3 + (F.sin(x / 12 * pi) * 150 + F.sin(x / 30 * pi) * 300) * 2 / 3
    rad = F.radians(lat)
    m = 1 - F.pow(F.sin(rad), 2) * ecc
    root = F.sqrt(m)
    to_lat = lat - d_lat * 180 / (axis * (1 - ecc) / (m * root) * pi)
    to_lng = lng - d_lng * 180 / (axis / root * F.cos(rad) * pi)
    return F.struct(F.when(outside, lat).otherwise(to_lat).alias("lat"), F.when(outside, lng).otherwise(to_lng).alias("lng"))


def bd09_to_gcj02(lat: Column, lng: Column) -> Column:
    x, y, turn = lng - 0.0065, lat - 0.006, pi * 3000 / 180
    z = F.sqrt(x * x + y * y) - F.sin(y * turn) * 0.00002
    theta = F.atan2(y, x) - F.cos(x * turn) * 0.000003
    return F.struct((z * F.sin(theta)).alias("lat"), (z * F.cos(theta)).alias("lng"))


def bd09_to_wgs84(lat: Column, lng: Column) -> Column:
    g = bd09_to_gcj02(lat, lng)
    return gcj02_to_wgs84(g["lat"], g["lng"])


def geocode_confidence(kind: Column, place_type: Column, importance: Column, known_country: Column) -> Column:
    """How far a geocoder's answer is trusted, rounded half to even."""
    score = F.lit(0.68)
    score = score + F.when(kind == "place", 0.14).otherwise(0.0)
    score = score + F.when(place_type.isin("city", "town", "village", "municipality"), 0.1).otherwise(0.0)
    score = score + F.when(known_country, 0.04).otherwise(0.0)
    score = score + F.greatest(F.lit(0.0), F.least(F.lit(0.08), (F.coalesce(importance, F.lit(0.5)) - 0.4) * 0.16))
    return F.bround(F.least(score, F.lit(0.96)), 2)


#: Zoom and circle radius of each precision.
ZOOM = {"city": 13, "locality": 14, "square": 16, "site": 16, "street": 16, "number": 18}
RADIUS_PX = {"city": 118, "locality": 92, "square": 58, "site": 52, "street": 40, "number": 28}


def precision_value(precision: Column, table: dict[str, int], otherwise: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[precision], F.lit(otherwise))


# Types and categories of a geocoder's answers.
REFUSED_TYPES = ["city", "county", "country", "municipality", "postcode", "province", "region", "state", "town"]
EXACT_TYPES = ["amenity", "building", "commercial", "construction", "farm", "hamlet", "hospital", "house", "industrial", "isolated_dwelling", "locality", "neighbourhood", "neighborhood", "office", "residential", "retail", "road", "school", "service", "square", "suburb", "village"]
BROAD_TYPES = ["city", "hamlet", "locality", "municipality", "neighbourhood", "neighborhood", "place", "quarter", "road", "square", "suburb", "town", "village"]
CATEGORIES, SITE_CATEGORIES, LOCALITY_CATEGORIES = ["building", "highway", "landuse", "place"], ["amenity", "building", "landuse"], ["boundary", "place"]
# Widest diagonals in km.
WIDEST = {"town": 14.0, "municipality": 10.0, "locality": 18.0, "site": 8.0, "street_address": 4.0, "street": 18.0}


def acceptable_geocode(kind: Column, diagonal_km: Column, category: Column | None = None, address_type: Column | None = None, place_type: Column | None = None, house_number: Column | None = None) -> Column:
    """Whether a geocoder's answer fits what was asked (kind: locality, site, street, street_address).

    Its types must not be wider than an address unless a locality was asked, its category must fit the
    kind, and its box must not be too wide; what an answer doesn't tell doesn't speak against it."""
    said = lambda c: F.lower(F.coalesce(c, F.lit(""))) if c is not None else F.lit("")
    category, address, place = said(category), said(address_type), said(place_type)
    numbered = F.coalesce(house_number != "", F.lit(False)) if house_number is not None else F.lit(False)
    locality, site, street = kind == "locality", kind == "site", kind == "street"
    narrow = locality | ~(address.isin(REFUSED_TYPES) | place.isin(REFUSED_TYPES))
    fitting = (category == "") | category.isin(CATEGORIES) | (locality & category.isin(LOCALITY_CATEGORIES)) | (site & category.isin(SITE_CATEGORIES))
    exact = (address == "") | ((address == "place") & numbered) | address.isin(EXACT_TYPES) | locality | (street & (address.isin(BROAD_TYPES) | place.isin(BROAD_TYPES)))
    towns = address.isin("city", "town") | place.isin("city", "town")
    municipal = (address == "municipality") | (place == "municipality")
    widest = F.when(locality, F.when(towns, WIDEST["town"]).when(municipal, WIDEST["municipality"]).otherwise(WIDEST["locality"])).when(site, WIDEST["site"]).when(kind == "street_address", WIDEST["street_address"]).otherwise(WIDEST["street"])
    return narrow & fitting & exact & (diagonal_km.isNull() | (diagonal_km <= widest))


def geocode_precision(kind: Column, address_type: Column, place_type: Column) -> Column:
    """What a geocoder's answer is precise to."""
    said = F.lower(F.coalesce(F.nullif(address_type, F.lit("")), place_type, F.lit("")))
    square = said == "square"
    return F.when(kind == "locality", "locality").when(kind == "site", F.when(square, "square").otherwise("site")).when(square, "square").when(said.isin("city", "town", "municipality"), "city").when(kind == "street_address", "address").otherwise("street")


def query_variants(addresses: Column, places: Column) -> Column:
    """Each address with each place, as texts without repeated parts, distinct in order."""
    pairs = F.flatten(F.transform(addresses, lambda a: F.transform(places, lambda p: F.array_join(F.array_distinct(F.filter(F.array(a, p), lambda x: x.isNotNull() & (x != ""))), ", "))))
    return F.array_distinct(F.filter(pairs, lambda x: x != ""))
