"""Mixing sources to target weights by temperature.

A source's share is its part of all tokens (runs of non-space characters); its weight is its share to
the power of an exponent, normalised. Exponent 1 keeps the shares, 0 gives equal weights. Bisection
finds the largest exponent whose weights reach ``entropy`` (a part of the greatest possible, log of the
number of sources), and no smaller one than ``repeats`` allows: no source may give more than that many
times its tokens. A budget in tokens (BUDGET_SHARE of the corpus: over 1, so that sources near their target are
seen whole and then in part again) becomes a quota for each source, realised as passes over
the source: a pass is a permutation of its blocks (md5 of seed, source, pass, block), a block holds
about BLOCK_TOKENS tokens (more, where a source would have over MOST_BLOCKS blocks) in a permuted order of its
own, and documents are taken while the quota isn't exceeded. Only a source's block totals are sorted as a whole;
documents only within a block. Up to DRIVER_SOURCES sources the driver bisects; of more, every step is an aggregation.

Defined results: rows of null doc_id are left out; a null source is the source ''; texts without a token
are left out; rows that repeat a doc_id are taken as so many documents; an empty table gives no rows;
columns but doc_id, source and text play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.session import bounded, cut

ENTROPY = 0.999
REPEATS = 4.0
BUDGET_SHARE = 1.25
BLOCK_TOKENS = 50_000
MOST_BLOCKS = 1 << 16
DRIVER_SOURCES = 100_000
GRID = 32
SEED = "cairn"


def weights(tokens: dict[str, int], alpha: float) -> dict[str, float]:
    total = sum(tokens.values())
    p = {k: math.pow(v / total, alpha) for k, v in tokens.items()}
    z = sum(p[k] for k in sorted(p))
    return {k: v / z for k, v in p.items()}


def exponent(tokens: dict[str, int], budget: float, entropy: float = ENTROPY, repeats: float = REPEATS, rounds: int = 50) -> float:
    """The bisected exponent in [0, 1]. Entropy falls and the repetition of small sources drops as it
    grows; where the two limits conflict, the repetition limit holds."""
    if len(tokens) < 2:
        return 1.0

    def even(a: float) -> bool:
        w = weights(tokens, a)
        return -sum(x * math.log(x) for _, x in sorted(w.items()) if x > 0) >= entropy * math.log(len(tokens))

    def fits(a: float) -> bool:
        w = weights(tokens, a)
        return all(w[k] * budget <= repeats * v for k, v in tokens.items())

    if even(1.0):
        high = 1.0
    else:
        low, top = 0.0, 1.0
        for _ in range(rounds):
            mid = (low + top) / 2
            low, top = (mid, top) if even(mid) else (low, mid)
        high = low
    if fits(high):
        return high
    low, top = high, 1.0
    for _ in range(rounds):
        mid = (low + top) / 2
        low, top = (low, mid) if fits(mid) else (mid, top)
    return top


def exponent_of(totals: DataFrame, sources: int, total: int, budget: float, entropy: float = ENTROPY, repeats: float = REPEATS, rounds: int = 11) -> float:
    """``exponent`` of a table (source, n): a round narrows the interval GRID + 1 times by one aggregation."""
    if sources < 2:
        return 1.0

    def tests(alphas: list[float]) -> list[tuple[bool, bool]]:
        """(even, fits) of each exponent: the entropy is ln z - a * sum(p**a * ln p) / z, z the sum of p**a."""
        p = F.col("n") / F.lit(float(total))
        aggs = []
        for a in alphas:
            x = F.pow(p, F.lit(a))
            aggs += [F.sum(x), F.sum(x * F.log(p)), F.max(x / F.col("n"))]
        r = totals.agg(*[c.alias(f"c{k}") for k, c in enumerate(aggs)]).first()
        out = []
        for k, a in enumerate(alphas):
            z, e, m = r[3 * k : 3 * k + 3]
            out.append((math.log(z) - a * e / z >= entropy * math.log(sources), m / z * budget <= repeats))
        return out

    def narrow(low: float, top: float, left: int) -> tuple[float, float]:
        """The step at which the test of index ``left & 1`` changes; bit 1 of ``left`` says that it holds below it."""
        for _ in range(rounds):
            grid = [low + (top - low) * k / (GRID + 1) for k in range(1, GRID + 1)]
            holds = [t[left & 1] == bool(left & 2) for t in tests(grid)]
            k = next((k for k, h in enumerate(holds) if not h), GRID)
            low, top = (grid[k - 1] if k else low), (grid[k] if k < GRID else top)
        return low, top

    high = 1.0 if tests([1.0])[0][0] else narrow(0.0, 1.0, 2)[0]
    return high if tests([high])[0][1] else narrow(high, 1.0, 1)[1]


def _hex(*cols) -> F.Column:
    return F.md5(F.concat_ws("|", *cols))


def quotas(totals: DataFrame, budget_share: float, entropy: float, repeats: float, block_tokens: int, driver_sources: int) -> DataFrame:
    """(source, blocks, pass, quota) of a table (source, n)."""
    spark = totals.sparkSession
    sources, total = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    budget = math.floor(total * budget_share)
    if sources <= driver_sources:
        n = {r["source"]: r["n"] for r in totals.collect()}
        w = weights(n, exponent(n, budget, entropy, repeats)) if n else {}
        q = spark.createDataFrame([(k, n[k], math.floor(round(w[k] * budget, 6) + 0.5)) for k in n], "source string, n long, q long")
    else:
        x = F.pow(F.col("n") / F.lit(float(total)), F.lit(exponent_of(totals, sources, total, budget, entropy, repeats)))
        z = totals.agg(F.sum(x)).first()[0]
        q = totals.select("source", "n", F.floor(F.round(x / F.lit(z) * F.lit(float(budget)), 6) + 0.5).cast("long").alias("q"))
    blocks = F.greatest(F.lit(1), F.least(F.floor(F.col("n") / block_tokens), F.lit(MOST_BLOCKS))).cast("long")
    p = q.filter("q > 0").select("source", "n", "q", blocks.alias("blocks"), F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("q") / F.col("n")).cast("long"))).alias("pass"))
    return p.select("source", "blocks", "pass", F.least(F.col("n"), F.col("q") - (F.col("pass") - 1) * F.col("n")).alias("quota"))


def mix(docs: DataFrame, budget_share: float = BUDGET_SHARE, entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS, seed: str = SEED, driver_sources: int = DRIVER_SOURCES) -> DataFrame:
    """(doc_id, source, tokens, pass, place): the sampled documents; ``place`` orders a pass of a source."""
    sized = docs.filter("doc_id is not null").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("tokens")).filter("tokens > 0")
    slot = F.conv(F.substring(_hex(F.lit(seed), F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    sized = cut(sized.withColumn("slot", slot))  # the one scan of the texts
    totals = cut(sized.groupBy("source").agg(F.sum("tokens").alias("n")))
    plan = bounded(cut(quotas(totals, budget_share, entropy, repeats, block_tokens, driver_sources)), 64)
    placed = sized.join(plan, "source").withColumn("block", F.pmod("slot", "blocks")).drop("slot", "blocks")
    sums = placed.groupBy("source", "pass", "quota", "block").agg(F.sum("tokens").alias("n"))
    order = Window.partitionBy("source", "pass").orderBy(_hex(F.lit(seed), "source", "pass", "block"), "block")
    sums = sums.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.coalesce("before", F.lit(0)))
    sums = sums.withColumn("turn", F.row_number().over(order)).filter("before < quota")
    whole = sums.filter("before + n <= quota").select("source", "pass", "block", "turn", F.lit(None).cast("long").alias("room"))
    part = sums.filter("before + n > quota").select("source", "pass", "block", "turn", (F.col("quota") - F.col("before")).alias("room"))
    chosen = placed.drop("quota").join(whole.union(part), ["source", "pass", "block"])
    inside = _hex(F.lit(seed), "source", "pass", F.col("doc_id").cast("string"))
    chosen = chosen.withColumn("place", F.concat(F.lpad(F.col("turn").cast("string"), 12, "0"), F.lit("-"), inside))
    cols = ["doc_id", "source", "tokens", "pass", "place"]
    run = F.sum("tokens").over(Window.partitionBy("source", "pass", "block").orderBy("place", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0))
    cut_off = chosen.filter("room is not null").withColumn("run", run).filter("run <= room")
    return chosen.filter("room is null").select(cols).union(cut_off.select(cols))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
with recursive sized as (
  select doc_id, coalesce(source, '') source, cast(len(regexp_extract_all(text, '\S+')) as bigint) tokens,
    cast('0x' || substr(md5('{SEED}|' || cast(doc_id as varchar)), 1, 8) as bigint) slot
  from documents where doc_id is not null and text is not null and regexp_matches(text, '\S')
), totals as (select source, cast(sum(tokens) as bigint) n from sized group by source
), whole as (select cast(sum(n) as double) total, floor(sum(n) * {BUDGET_SHARE}e0) budget, count(*) sources from totals
), even(round, low, top) as (
  select 0, 0e0, 1e0
  union all
  select round + 1, case when e then (low + top) / 2 else low end, case when e then top else (low + top) / 2 end
  from (select round, low, top,
      (select -sum(x / z * ln(x / z)) from (select x, sum(x) over () z from (select pow(n / total, (low + top) / 2) x from totals, whole))) >= {ENTROPY}e0 * ln((select sources from whole)) e
    from even where round < 60)
), high as (
  select case when (select -sum(x / z * ln(x / z)) from (select x, sum(x) over () z from (select n / total x from totals, whole))) >= {ENTROPY}e0 * ln((select sources from whole)) then 1e0
    else (select low from even order by round desc limit 1) end a
), fit(round, low, top) as (
  select 0, a, 1e0 from high
  union all
  select round + 1, case when f then low else (low + top) / 2 end, case when f then (low + top) / 2 else top end
  from (select round, low, top,
      (select bool_and(x / z * budget <= {REPEATS}e0 * n) from (select n, budget, x, sum(x) over () z from (select n, budget, pow(n / total, (low + top) / 2) x from totals, whole))) f
    from fit where round < 60)
), alpha as (select case when (select bool_and(x / z * budget <= {REPEATS}e0 * n) from (select n, budget, x, sum(x) over () z from (select n, budget, pow(n / total, a) x from totals, whole, high))) then a
    else (select top from fit order by round desc limit 1) end a from high
), w as (select source, n, x / sum(x) over () w from (select source, n, pow(n / total, a) x from totals, whole, alpha)
), quota as (select source, n, greatest(1, least(n // {BLOCK_TOKENS}, {MOST_BLOCKS})) blocks, cast(floor(round(w * budget, 6) + 0.5e0) as bigint) q from w, whole
), plan as (select source, blocks, p as pass, least(n, q - (p - 1) * n) quota from (select *, unnest(range(1, cast(ceil(q / n) as bigint) + 1)) p from quota)
), placed as (select s.doc_id, s.source, s.tokens, p.pass, p.quota, s.slot % p.blocks block from sized s join plan p on s.source = p.source
), sums as (
  select *, sum(n) over (partition by source, pass order by md5('{SEED}|' || source || '|' || pass || '|' || block), block) - n before,
    row_number() over (partition by source, pass order by md5('{SEED}|' || source || '|' || pass || '|' || block), block) turn
  from (select source, pass, quota, block, sum(tokens) n from placed group by all)
), chosen as (
  select d.doc_id, d.source, d.tokens, d.pass, lpad(cast(turn as varchar), 12, '0') || '-' || md5('{SEED}|' || d.source || '|' || d.pass || '|' || d.doc_id) place,
    s.quota - s.before room, d.block
  from placed d join sums s on d.source = s.source and d.pass = s.pass and d.block = s.block where s.before < s.quota
)
select doc_id, source, tokens, pass, place from (select *, sum(tokens) over (partition by source, pass, block order by place, doc_id, tokens rows unbounded preceding) run from chosen) where run <= room
"""
