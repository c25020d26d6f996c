"""Gazetteer matches, nearest sites, and placing of people."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.fields import is_vague
from cairn.functions.geo import cell, haversine_km, inside
from cairn.functions.text import fold_lower, fold_upper
from cairn.operators import skew
from cairn.session import BROADCAST_BYTES, cut

BROAD = ("caracas", "guaira", "la guaira", "la guira", "vargas")
SNAP_KM, SNAP_DEGREES = 2.0, 0.03


def zones_found(places: DataFrame, zones: DataFrame, broad: tuple[str, ...] = BROAD, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(id, zone, lat, lng): for each (id, pos, origin) the most specific zone (zone, lat, lng) named in its first
    matching origin: sectors before broad names, then the longest, then by name.

    A zone is named where its folded text is a part of the folded origin. A gazetteer is a dimension of
    thousands of rows; it is broadcast while its size is small, and each origin is compared with all of it. A larger
    one meets the distinct origins on its first letters: the first 8, 4, 2 or 1 of a zone, as many as it has, are a
    part of an origin that names it. Both ways give the same rows."""
    z = zones.select("zone", "lat", "lng", fold_lower("zone").alias("z")).filter("z <> ''")
    o = places.select("id", "pos", fold_lower("origin").alias("o"))
    if z.count() * 64 <= limit:
        j = o.join(F.broadcast(z), F.contains("o", "z"))
    else:
        size = F.when(F.length("z") >= 8, 8).when(F.length("z") >= 4, 4).when(F.length("z") >= 2, 2).otherwise(1)
        parts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("o") - n + 1)), lambda i: F.substr("o", i, F.lit(n)))
        keys = F.array_distinct(F.concat(*[parts(n) for n in (8, 4, 2, 1)]))
        texts = o.select("o").distinct()
        named = skew.pairs(texts.select("o", F.explode(keys).alias("key")), z.withColumn("key", F.substr("z", F.lit(1), size)), "key").filter(F.contains("o", "z")).drop("key")
        j = o.join(named, "o")
    best = Window.partitionBy("id").orderBy("pos", F.col("z").isin(*broad), F.length("z").desc(), "zone")
    return j.withColumn("r", F.row_number().over(best)).filter("r = 1").select("id", "zone", "lat", "lng")


def order_origins(origins: str, known: F.Column | None = None) -> F.Column:
    """The origins that a zone is known for first (``known``: an array of them), then others, then the vague
    ones, each in its order."""
    zoned = (lambda x: F.array_contains(known, x)) if known is not None else (lambda x: F.lit(False))
    ranked = F.transform(origins, lambda x, i: F.struct(F.when(is_vague(x), 2).when(zoned(x), 0).otherwise(1).alias("rank"), i.alias("i"), x.alias("x")))
    return F.array_sort(ranked).getField("x")


def ordered(persons: DataFrame, zones: DataFrame) -> DataFrame:
    """persons (id, origins, ...) with their origins in the order of ``order_origins``: each distinct origin is
    looked up in the gazetteer once."""
    o = persons.select("id", F.posexplode("origins").alias("pos", "origin"))
    texts = o.select("origin").distinct()
    zoned = zones_found(texts.select(F.col("origin").alias("id"), F.lit(0).alias("pos"), "origin"), zones).select(F.col("id").alias("origin"))
    known = o.join(zoned, "origin", "left_semi").groupBy("id").agg(F.collect_set("origin").alias("_known"))
    out = persons.join(known, "id", "left")
    return out.withColumn("origins", order_origins("origins", F.coalesce("_known", F.array().cast("array<string>")))).drop("_known")


def nearest(points: DataFrame, sites: DataFrame, km: float = SNAP_KM, degrees: float = SNAP_DEGREES) -> DataFrame:
    """(id, site_id, dist_km): the nearest site (site_id, lat, lng) within ``km`` of each point (id, lat, lng).
    Cells of ``degrees`` make it an equality join of a site with its 3x3 neighbourhood. Distances are whole millimetres,
    so that of sites at one place the least site_id is the nearest, however the last bits fall."""
    p = points.select("id", F.col("lat").alias("a"), F.col("lng").alias("g"), cell("lat", degrees).alias("x"), cell("lng", degrees).alias("y"))
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    s = sites.select("site_id", "lat", "lng", around.alias("d")).select("site_id", "lat", "lng", (cell("lat", degrees) + F.col("d.dx")).alias("x"), (cell("lng", degrees) + F.col("d.dy")).alias("y"))
    d = p.join(s, ["x", "y"]).withColumn("dist", F.round(haversine_km("a", "g", "lat", "lng"), 6)).filter((F.col("dist") <= km) & (F.abs(F.col("a") - F.col("lat")) <= degrees) & (F.abs(F.col("g") - F.col("lng")) <= degrees))
    return d.groupBy("id").agg(F.min(F.struct("dist", "site_id")).alias("m")).select("id", F.col("m.site_id").alias("site_id"), F.col("m.dist").alias("dist_km"))


def footprint_centroids(texts: DataFrame, column: str = "json") -> DataFrame:
    """(feature, lat, lng): mean vertex of each GeoJSON feature, whatever the nesting of its coordinates;
    what isn't GeoJSON gives no rows."""
    features = texts.select(F.explode(F.from_json(F.get_json_object(column, "$.features"), "array<string>")).alias("f"))
    pairs = F.regexp_extract_all(F.get_json_object("f", "$.geometry.coordinates"), F.lit(r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)"), F.lit(1))
    v = features.withColumn("feature", F.monotonically_increasing_id()).select("feature", F.explode(pairs).alias("p"))
    v = v.select("feature", F.trim(F.split("p", ",")[1]).cast("double").alias("lat"), F.trim(F.split("p", ",")[0]).cast("double").alias("lng"))
    return v.groupBy("feature").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))


#: words by which an origin names a building
BUILDING = r"\b(bloque|conjunto|edf|edif|quinta|resid|residencia|residencial|torre)\b"
NEAR_KM = 4.0
CORE = (10.58, 10.63, -67.10, -66.66)
NO_BUILDING: str = "q string, lat double, lng double, label string"


def geocode(origins: DataFrame, zones: DataFrame, sites: DataFrame, hits: DataFrame | None = None, cache: DataFrame | None = None) -> DataFrame:
    """(q, lat, lng, tier, label) of each distinct ``origin``, q its folded first 160 letters; null where nothing is known.

    Tiers: a row of ``cache`` (q, lat, lng, tier, label) as it is; 'building', where the origin names one and a geocoder's
    hit (``hits``: q, lat, lng, label) shares a distinctive word with it and lies within NEAR_KM of the sector
    that it names, or, if it names none, in the CORE strip; else 'sector', its zone moved to the nearest site."""
    q = F.substring(fold_lower("origin"), 1, 160)
    o = origins.select(q.alias("q"), "origin").filter("q <> ''").groupBy("q").agg(F.min("origin").alias("origin"))
    known = o.join(cache.select("q"), "q", "left_semi") if cache is not None else None
    new = o.join(cache.select("q"), "q", "left_anti") if cache is not None else o
    z = zones_found(new.select(F.col("q").alias("id"), F.lit(0).alias("pos"), "origin"), zones).withColumnRenamed("id", "q")
    new = new.join(z.select("q", F.col("zone").alias("z_zone"), F.col("lat").alias("z_lat"), F.col("lng").alias("z_lng")), "q", "left")
    if hits is None:
        hits = origins.sparkSession.createDataFrame([], NO_BUILDING)
    new = new.join(hits.select("q", F.col("lat").alias("h_lat"), F.col("lng").alias("h_lng"), F.col("label").alias("h_label")), "q", "left")
    close = F.when(F.col("z_lat").isNotNull(), haversine_km("h_lat", "h_lng", "z_lat", "z_lng") <= NEAR_KM).otherwise(inside("h_lat", "h_lng", CORE))
    named = F.col("q").rlike(BUILDING) & F.arrays_overlap(distinctive_words("origin"), distinctive_words("h_label")) & close
    new = new.withColumn("built", F.coalesce(named, F.lit(False)))
    near = nearest(new.filter("not built and z_lat is not null").select(F.col("q").alias("id"), F.col("z_lat").alias("lat"), F.col("z_lng").alias("lng")), sites).join(sites.select("site_id", F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng")), "site_id")
    new = new.join(near.select(F.col("id").alias("q"), "s_lat", "s_lng"), "q", "left")
    pick = lambda h, s, z: F.when(F.col("built"), F.col(h)).otherwise(F.coalesce(s, z))
    tier = F.when(F.col("built"), "building").when(F.col("z_lat").isNotNull(), "sector")
    out = new.select("q", pick("h_lat", "s_lat", "z_lat").alias("lat"), pick("h_lng", "s_lng", "z_lng").alias("lng"), tier.alias("tier"), F.when(F.col("built"), F.col("h_label")).otherwise(F.col("z_zone")).alias("label"))
    return out if known is None else out.union(known.select("q").join(cache.select("q", "lat", "lng", "tier", "label"), "q"))


def attach(persons: DataFrame, zones: DataFrame, sites: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """persons (id, origins) with lat, lng and geo_tier, the best origin first: its cached place (q, lat, lng,
    tier, as ``geocode`` gives), else a site near the zone that an origin names ('zone')."""
    persons = cut(ordered(persons, zones))
    o = persons.select("id", F.posexplode("origins").alias("pos", "origin"))
    z = zones_found(o, zones)
    near = nearest(z, sites).join(sites.select("site_id", F.col("lat").alias("sa"), F.col("lng").alias("sg")), "site_id")
    placed = z.join(near, "id", "left").select("id", F.coalesce("sa", "lat").alias("lat"), F.coalesce("sg", "lng").alias("lng"), F.lit("zone").alias("geo_tier"))
    if cache is not None:
        first = o.filter("pos = 0").select("id", F.substring(fold_lower("origin"), 1, 160).alias("q"))
        known = first.join(cache.filter("lat is not null").select("q", F.col("lat").alias("ca"), F.col("lng").alias("cg"), "tier"), "q").select("id", "ca", "cg", "tier")
        placed = persons.select("id").join(placed, "id", "left").join(known, "id", "left").select("id", F.coalesce("ca", "lat").alias("lat"), F.coalesce("cg", "lng").alias("lng"), F.coalesce("tier", "geo_tier").alias("geo_tier"))
    return persons.join(placed, "id", "left")


def coverage(placed: DataFrame) -> DataFrame:
    """Share of people placed and on a building, as whole percent."""
    n = F.count(F.lit(1))
    pct = lambda c: F.floor(100 * c / F.greatest(F.lit(1), n)).cast("int")
    return placed.agg(n.alias("persons"), pct(F.count("lat")).alias("placed_pct"), pct(F.count_if(F.col("geo_tier") == "building")).alias("building_pct"))


def distinctive_words(name: str, stop: tuple[str, ...] = ()) -> F.Column:
    return F.filter(F.split(fold_upper(name), " "), lambda t: (F.length(t) >= 4) & ~t.isin(*(stop or ("",))))
