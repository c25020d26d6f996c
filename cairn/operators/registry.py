"""Statistics, histories, ledgers and schedules of the registry."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("por_localizar", "localizado", "ingresado", "herido", "alta", "fallecido", "albergado")


def kpis(persons: DataFrame, records: DataFrame, centers: DataFrame) -> DataFrame:
    """One row of counts. The three tables are aggregated apart and their single rows are joined."""
    p = persons.agg(
        F.count(F.lit(1)).alias("persons"), F.count_if(F.col("primary_ci") != "").alias("with_number"), F.count_if("deceased").alias("deceased"), F.count_if("ci_conflict").alias("ci_conflict"),
        *[F.count_if(F.array_contains("statuses", s)).alias(s) for s in STATUSES],
    )
    return p.crossJoin(records.agg(F.count(F.lit(1)).alias("records"))).crossJoin(centers.agg(F.count(F.lit(1)).alias("centers")))


def status_histogram(persons: DataFrame) -> DataFrame:
    """(status, n): a person counts once for each of its statuses."""
    return persons.select(F.explode("statuses").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def zone_histogram(placed: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """placed (zone, status): counts by status and in total, fullest zone first, with the leading status."""
    out = placed.groupBy("zone").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses])
    lead = F.array_max(F.array(*[F.struct(F.col(s).alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(statuses)]))["s"]
    return out.withColumn("leading", lead).orderBy(F.col("total").desc(), "zone")


def history_delta(metrics: DataFrame, columns: list[str], last: int = 100) -> DataFrame:
    """Last minus first value of each column over the ``last`` rows by ts; no row for fewer than two."""
    recent = metrics.orderBy(F.col("ts").desc()).limit(last)
    out = recent.agg(F.count(F.lit(1)).alias("points"), F.min("ts").alias("since"), F.max("ts").alias("until"), *[(F.max_by(c, "ts") - F.min_by(c, "ts")).alias(c) for c in columns])
    return out.filter("points >= 2")


def recently_checked(ledger: DataFrame, now: Column, minutes: int) -> DataFrame:
    return ledger.filter(F.col("checked_at") > now - F.make_interval(mins=F.lit(minutes))).select("source", "identity")


def unchecked(wanted: DataFrame, ledger: DataFrame, now: Column, minutes: int) -> DataFrame:
    """The (source, identity) rows that weren't checked in the last ``minutes``."""
    return wanted.join(recently_checked(ledger, now, minutes), ["source", "identity"], "left_anti")


def due(sources: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Enabled sources whose content changed or whose cadence (cadence_min, 360 if null) has passed."""
    s = sources.join(state.select("id", F.col("hash").alias("seen"), "last_run"), "id", "left")
    passed = (F.unix_timestamp(now) - F.unix_timestamp("last_run")) >= F.coalesce("cadence_min", F.lit(360)) * 60
    return s.filter(F.col("enabled") & (F.col("seen").isNull() | (F.col("seen") != F.col("hash")) | F.coalesce(passed, F.lit(True)))).drop("seen", "last_run")


def marked(state: DataFrame, done: DataFrame, now: Column) -> DataFrame:
    """The state (id, hash, last_run) after the sources of ``done`` (id, hash) ran."""
    new = done.select("id", "hash", now.alias("last_run"))
    return state.select("id", "hash", "last_run").join(new, "id", "left_anti").unionByName(new)


def content_hash(files: DataFrame) -> DataFrame:
    """(id, hash) of files (id, path, modified): a digest of the sorted names and whole modification seconds."""
    entry = F.concat_ws(":", F.regexp_extract("path", r"([^/]+)$", 1), F.unix_timestamp("modified").cast("string"))
    return files.groupBy("id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), "|"), 256).alias("hash"))


def first_hits(hits: DataFrame) -> DataFrame:
    """hits (source, identity, variant, ...): those of each source's first variant that found anything."""
    w = Window.partitionBy("source", "identity")
    return hits.withColumn("_m", F.min("variant").over(w)).filter("variant = _m").drop("_m")


def window_counts(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests (key, ts) with the number in the window of ``seconds`` that ends with each of them."""
    w = Window.partitionBy("key").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumn("in_window", F.count(F.lit(1)).over(w))


def admit(times: Iterable[float], accepted: Iterable[float], limit: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Greedy limiter: a request passes if fewer than ``limit`` passed in the last ``seconds``. Times ascend, so the
    accepted ones leave the window in their order."""
    held, out = deque(accepted), []
    for t in times:
        while held and t - held[0] > seconds:
            held.popleft()
        out.append(len(held) < limit)
        if out[-1]:
            held.append(t)
    return out, list(held)


def rate_limit(requests: DataFrame, limit: int, seconds: float, order: str) -> DataFrame:
    """Requests (key, ts, ``order``) with ``allowed``. A refused request doesn't count, so no window frame
    tells; a key's requests are scanned in their order, a run of one key at a time."""
    names = requests.columns
    schema = requests.withColumn("allowed", F.lit(True)).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, accepted = object(), []
        for b in batches:
            times = b["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
            keys = b["key"].to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(b)] if len(b) else []
            out: list[bool] = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                if keys[s] != last:
                    last, accepted = keys[s], []
                ok, accepted = admit(times[s:e].tolist(), accepted, limit, seconds)
                out += ok
            yield b.assign(allowed=out)[[*names, "allowed"]]

    return requests.repartition("key").sortWithinPartitions("key", "ts", order).mapInPandas(run, schema)


def audit(placed: DataFrame, n: int = 45) -> DataFrame:
    """The origins of most people that weren't placed."""
    return placed.filter("lat is null").groupBy("origin").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "origin").limit(n)


def sample_rows(rows: DataFrame, key: str, n: int = 500, seed: int = 7) -> DataFrame:
    """A repeatable random sample."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
