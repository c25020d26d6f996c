"""Aid centers: enrichment, upserts by key, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import fields
from cairn.functions.geo import haversine_km
from cairn.functions.text import fold_lower, present
from cairn.operators import skew
from cairn.operators.graph import components
from cairn.session import cut

JACCARD = 0.8
#: words that don't tell one center from another
GENERIC = tuple(
    "acopio ayuda ayudas alcaldia casa centro centros civil club comando comercial comunidad con del donacion donaciones "
    "fundacion gobernacion gobierno grupo las local los nacional operacion para punto puntos recoleccion rescatistas sede "
    "sociedad todos vecinos venezuela voluntariado voluntarios vzla".split()
)


def key(name: str = "name", place: str = "municipality") -> Column:
    return F.trim(F.lower(F.concat_ws("|", F.coalesce(F.col(name), F.lit("")), F.coalesce(F.col(place), F.lit("")))))


def enrich(centers: DataFrame) -> DataFrame:
    """Tags, type and defaults."""
    out = centers.withColumn("needs_tags", fields.needs_tags("needs")).withColumn("ctype", fields.center_type("name", "needs", "ctype"))
    out = out.withColumn("status", F.coalesce(present("status"), F.lit("active")) if "status" in centers.columns else F.lit("active"))
    return out.withColumn("confirmations", F.coalesce("confirmations", F.lit(0)) if "confirmations" in centers.columns else F.lit(0))


def places_to_ask(centers: DataFrame, country: str = "Venezuela") -> DataFrame:
    """(center_id, step, q): what to ask a geocoder for centers without coordinates: the address in the country, the municipality
    in it, then the municipality anywhere."""
    some = lambda *c: F.concat_ws(", ", *[present(x) for x in c])
    town = present("municipality")
    asked = F.array(F.nullif(some("address", "municipality"), F.lit("")), town, town)
    q = F.when(F.col("step") < 2, F.concat("at", F.lit(f", {country}"))).otherwise(F.col("at"))
    return centers.filter("lat is null").select("center_id", F.posexplode(asked).alias("step", "at")).filter("at is not null").select("center_id", "step", q.alias("q"))


def placed(centers: DataFrame, hits: DataFrame) -> DataFrame:
    """Centers with the coordinates of the first of their questions that has a hit (q, lat, lng); known ones stay."""
    h = places_to_ask(centers).join(hits.select("q", F.col("lat").alias("h_lat"), F.col("lng").alias("h_lng")), "q")
    h = h.groupBy("center_id").agg(F.min_by(F.struct("h_lat", "h_lng"), "step").alias("h"))
    out = centers.join(h, "center_id", "left")
    return out.withColumn("lng", F.when(F.col("lat").isNull(), F.col("h.h_lng")).otherwise(F.col("lng"))).withColumn("lat", F.coalesce("lat", "h.h_lat")).drop("h")


def merge_first(rows: DataFrame, by: str | list[str], order: str, columns: list[str]) -> DataFrame:
    """One row a key: the first value of each column that isn't empty."""
    at = lambda c: F.min_by(c, F.when(present(c).isNotNull(), F.col(order)))
    return rows.groupBy(by).agg(*[F.coalesce(at(c), F.lit("")).alias(c) for c in columns])


def merge_last(rows: DataFrame, by: str | list[str], order: str, columns: list[str], first: list[str] = []) -> DataFrame:
    """One row a key: the last value of each column that isn't empty; of ``first`` the first one."""
    at = lambda c: F.max_by(c, F.when(present(c).isNotNull(), F.col(order)))
    early = lambda c: F.min_by(c, F.when(present(c).isNotNull(), F.col(order)))
    return rows.groupBy(by).agg(*[F.coalesce(at(c), F.lit("")).alias(c) for c in columns], *[F.coalesce(early(c), F.lit("")).alias(c) for c in first])


def merge_by_id(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Rows of both tables; where both have an id, the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(F.col("_new").desc())
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def alike_names(groups: DataFrame) -> DataFrame:
    """(a, b): groups (id, place, words) of one place whose words have a Jaccard of JACCARD and share a distinctive one.

    Such names share all but a fifth of their words, so one of the rarest few of one is among the rarest few of
    the other (prefix filter)."""
    df = groups.select(F.explode("words").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = groups.select("id", F.explode("words").alias("token")).join(df, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("r"))
    n = F.size("words")
    first = F.slice(F.transform("r", lambda x: x["token"]), 1, (n - F.ceil(n * F.lit(JACCARD) - 1e-9) + 1).cast("int"))
    g = cut(groups.join(ranked, "id").select("id", "place", "words", first.alias("rare")))
    w = g.withColumn("w", F.explode("rare"))
    side = lambda s: w.select(F.struct("place", "w").alias("key"), F.struct("id", "words", "rare").alias(s))
    both = F.array_intersect("a.words", "b.words")
    union = F.size("a.words") + F.size("b.words") - F.size(both)
    alike = (F.size(both) / union >= JACCARD) & F.exists(both, lambda x: ~x.isin(*GENERIC))
    near = F.least(F.size("a.words"), F.size("b.words")) >= F.greatest(F.size("a.words"), F.size("b.words")) * JACCARD - 1e-9
    once = F.get(F.array_intersect("a.rare", "b.rare"), F.lit(0)) == F.col("key.w")
    p = skew.pairs(side("a"), side("b"), "key").filter((F.col("a.id") < F.col("b.id")) & near & once).filter(alike)
    return p.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def reconcile(centers: DataFrame) -> DataFrame:
    """(center_id, canonical_id, merged_sources): centers of different sources in one municipality whose names
    agree by JACCARD and share a distinctive word are one; the survivor has an address, then a phone,
    then the least id. A survivor's own canonical_id is null.

    Centers of one place, name and source have the same links, so distinct ones are compared."""
    words = F.array_sort(F.filter(F.array_distinct(F.split(fold_lower("name"), " ")), lambda t: F.length(t) > 2))
    c = centers.select("center_id", F.coalesce("source", F.lit("")).alias("source"), fold_lower("municipality").alias("place"), words.alias("words"))
    c = c.filter(F.col("place") != "").filter(F.size("words") > 0)
    node = c.groupBy("place", "words", "source").agg(F.min("center_id").alias("node"))
    node = cut(node.withColumn("id", F.min("node").over(Window.partitionBy("place", "words"))))
    names = node.filter("node = id").select("id", "place", "words")
    own = names.filter(F.exists("words", lambda x: ~x.isin(*GENERIC))).select(F.col("id").alias("a"), F.col("id").alias("b"))
    of = lambda s: node.select(F.col("id").alias(s), F.struct("node", "source").alias(f"{s}_"))
    links = alike_names(names).union(own).join(of("a"), "a").join(of("b"), "b").filter("a_.source <> b_.source").select(F.col("a_.node").alias("a"), F.col("b_.node").alias("b"))
    root = components(links).withColumnRenamed("id", "node")
    root = c.join(node.select("place", "words", "source", "node"), ["place", "words", "source"]).join(root, "node").select("center_id", "root")
    g = centers.select("center_id", "source", "address", "phone").join(root, "center_id")
    pick = F.struct(present("address").isNull().alias("a"), present("phone").isNull().alias("p"), "center_id")
    best = g.groupBy("root").agg(F.min(pick)["center_id"].alias("survivor"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("merged_sources"))
    return g.join(best, "root").select("center_id", F.nullif("survivor", "center_id").alias("canonical_id"), "merged_sources")


def merged(centers: DataFrame) -> DataFrame:
    """Centers after reconciliation: the survivors unite the tags (needs_tags) of their cluster and fill a blank address,
    phone or hours from its other members, the least center_id first; members point to their survivor."""
    found = cut(reconcile(centers))
    c = centers.drop("canonical_id", "merged_sources").join(found, "center_id", "left")
    fill = [x for x in ("address", "phone", "hours") if x in centers.columns]
    first = lambda x: F.min_by(x, F.when(present(x).isNotNull(), F.struct(F.col("canonical_id").isNotNull(), "center_id")))
    of = F.coalesce("canonical_id", "center_id")
    tags = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("needs_tags")))).alias("_tags")] if "needs_tags" in centers.columns else []
    g = c.groupBy(of.alias("center_id")).agg(*[first(x).alias(f"_{x}") for x in fill], *tags)
    out = c.join(g, "center_id", "left")
    lead = F.col("merged_sources").isNotNull() & F.col("canonical_id").isNull()
    for x in [*fill, *(["needs_tags"] if tags else [])]:
        other = F.col("_tags") if x == "needs_tags" else F.coalesce(F.col(f"_{x}"), F.col(x))
        out = out.withColumn(x, F.when(lead, other).otherwise(F.col(x)))
    return out.select(*[x for x in centers.columns if x not in ("canonical_id", "merged_sources")], "canonical_id", F.when(lead, F.col("merged_sources")).alias("merged_sources"))


def confirm(centers: DataFrame, center_id: Column, now: Column) -> DataFrame:
    hit = (F.col("center_id") == center_id) & F.lit(True)
    return centers.withColumn("confirmations", F.col("confirmations") + hit.cast("int")).withColumn("last_confirmed", F.when(hit, now).otherwise(F.col("last_confirmed")))


def search(centers: DataFrame, q: str | None = None, ctype: str | None = None, municipality: str | None = None, need: str | None = None, status: str | None = None, near: tuple[float, float] | None = None, radius_km: float = 10.0, limit: int = 100) -> DataFrame:
    """Active filters are joined by AND; with ``near`` the nearest come first."""
    if not 1 <= limit <= 500:
        raise ValueError("limit: 1 to 500")
    out = centers.filter("canonical_id is null") if "canonical_id" in centers.columns else centers
    has = lambda c, v: F.contains(fold_lower(c), fold_lower(F.lit(v)))
    if q:
        out = out.filter(has("name", q) | has("address", q))
    if ctype:
        out = out.filter(F.col("ctype") == ctype)
    if municipality:
        out = out.filter(has("municipality", municipality))
    if need:
        out = out.filter(F.array_contains("needs_tags", need) | has("needs", need))
    if status:
        out = out.filter(F.col("status") == status)
    if near:
        out = out.withColumn("dist_km", F.round(haversine_km("lat", "lng", F.lit(near[0]), F.lit(near[1])), 1)).filter(F.col("dist_km") <= radius_km)
        return out.orderBy("dist_km", "center_id").limit(limit)
    return out.orderBy("center_id").limit(limit)
