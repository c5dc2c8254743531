"""Linked data of pages: addresses, images and links in one walk over JSON of any depth.

The walk goes down one level at a time for all pages together: a level's nodes are rows, their members
come from variant_explode, and it ends with the deepest page. No page is walked by a loop of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalyx.functions.text import all_matches, compact, or_null, resolve_url
from opalyx.runtime import written

# Members that lead to images, and those that hold links or a note with links.
IMAGE_KEYS = ["contentUrl", "image", "primaryImageOfPage", "thumbnail", "thumbnailUrl", "url"]
LINK_KEYS, NOTE_KEYS = ["documentsSourceUrl", "offerDigitalExternalPlatformUrl"], ["documentsSourceNote"]

_SCRIPT = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
_BARE = r"(?i)\b((?:https?://|www\.)[^\s<>\"']+)"


def _text(v: Column, *names: str) -> Column:
    """The first of these members that is a string; numbers and objects don't count."""
    one = lambda n: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")) == "STRING", F.try_variant_get(v, f"$.{n}", "string"))
    return F.coalesce(*map(one, names))


def _url(value: Column, base: Column) -> Column:
    v = F.trim(value)
    return resolve_url(base, F.when(F.lower(v).startswith("www."), F.concat(F.lit("https://"), v)).otherwise(or_null(v)))


def walk(values: DataFrame) -> DataFrame:
    """All nodes of JSON values: values has id, base (a URL) and json. A row for each node with

    place: the members' positions from the root; json; kind: OBJECT, ARRAY, STRING and so on; image: whether only
    arrays and image members lie above; link: 0, 1 under a member of links, 2 under one of notes; and the
    descriptor, width and height of the object above."""
    none = F.lit(None).cast("string")
    level = values.select("id", "base", F.array("part").alias("place"), F.lit(True).alias("image"), F.lit(0).alias("link"), none.alias("descriptor"), none.alias("width"), none.alias("height"), "json")
    out = []
    while True:
        level = level.withColumn("v", F.try_parse_json("json")).filter("v IS NOT NULL").withColumn("kind", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0))
        level = written(level.drop("v"), "level")
        if level.isEmpty():
            break
        out.append(level)
        v = F.col("v")
        inner = level.filter("kind IN ('OBJECT', 'ARRAY')").withColumn("v", F.parse_json("json"))
        told = F.when(F.col("kind") == "OBJECT", F.concat_ws(" ", F.lit("jsonld"), _text(v, "caption"), _text(v, "description"), _text(v, "name"))).otherwise(F.col("descriptor"))
        size = lambda n: F.when(F.col("kind") == "OBJECT", F.try_variant_get(v, f"$.{n}", "string")).otherwise(F.col(n))
        inner = inner.withColumns({"descriptor": told, "width": size("width"), "height": size("height")})
        below = level.sparkSession.sql("SELECT t.*, e.pos, e.key, to_json(e.value) AS member FROM {t} t, LATERAL variant_explode(t.v) e", t=inner)
        array = F.col("kind") == "ARRAY"
        link = F.when(F.col("link") > 0, F.col("link")).when(~array & F.col("key").isin(LINK_KEYS), 1).when(~array & F.col("key").isin(NOTE_KEYS), 2).otherwise(0)
        level = below.select("id", "base", F.concat("place", F.array("pos")).alias("place"), (F.col("image") & (array | F.col("key").isin(IMAGE_KEYS))).alias("image"), link.alias("link"), "descriptor", "width", "height", F.col("member").alias("json"))
    return reduce(DataFrame.unionByName, out) if out else level


def linked_data(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """(id, kind, place, value, street, locality, region, postal_code, country, name, descriptor, width, height) of pages.

    kind address: an object with parts of an address. kind image and link: a resolved URL as value. Scripts that
    aren't JSON are passed over; a page without any gives no rows."""
    scripts = pages.select(F.col(key).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("base"), F.posexplode(all_matches(F.coalesce(F.col(html), F.lit("")), _SCRIPT)).alias("part", "json"))
    nodes = walk(scripts)
    v, none = F.parse_json("json"), F.lit(None).cast("string")
    parts = {"street": _text(v, "streetAddress"), "locality": _text(v, "addressLocality", "locality"), "region": _text(v, "addressRegion"), "postal_code": _text(v, "postalCode"), "country": _text(v, "addressCountry")}
    objects = nodes.filter("kind = 'OBJECT'").select("id", "place", *(c.alias(n) for n, c in parts.items()), _text(v, "name", "alternateName", "description").alias("name"))
    blank = {n: none for n in ("value", "descriptor", "width", "height")}
    addresses = objects.filter(F.coalesce(*parts).isNotNull()).withColumns({"kind": F.lit("address"), **blank})
    strings = nodes.filter("kind = 'STRING' AND (image OR link > 0)").withColumn("text", F.try_variant_get(v, "$", "string"))
    bare = F.transform(all_matches(F.col("text"), _BARE), lambda u: F.regexp_replace(u, r"[),.;:]+$", ""))
    images = strings.filter("image").select("id", "place", F.lit("image").alias("kind"), _url(F.col("text"), F.col("base")).alias("value"), F.coalesce(compact(F.col("descriptor")), F.lit("jsonld image")).alias("descriptor"), "width", "height")
    links = strings.filter("link > 0").select("id", "place", F.lit("link").alias("kind"), F.explode(F.transform(F.when(F.col("link") == 2, bare).otherwise(F.array("text")), lambda u: _url(u, F.col("base")))).alias("value"), none.alias("descriptor"), none.alias("width"), none.alias("height"))
    found = images.unionByName(links).filter("value IS NOT NULL").withColumns({**{n: none for n in parts}, "name": none})
    columns = ["id", "kind", "place", "value", *parts, "name", "descriptor", "width", "height"]
    return addresses.select(*columns).unionByName(found.select(*columns))
