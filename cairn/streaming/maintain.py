"""The registry kept current by micro-batches.

The store is two tables of deltas, each batch's in a folder of its own. ``records`` holds the rows with their
person, in buckets by (source, uid). ``index`` holds what a batch needs of all others, in buckets by key: records by
block, how many records a word is in, the numbers that bear a name. A batch reads only the buckets of its own keys, so its work grows with the
batch and the blocks that it touches, not with the store. Every KEEP batches the deltas become one base, and what that replaces goes with the next.

A new record joins the person of the best rule among the records it shares a block with, under statistics of store and
batch together; what joins nobody is resolved among the batch itself. Within one batch this may merge what record-at-a-
time insertion wouldn't, and it errs toward more entities where names alone would have to decide. A batch that is
run again under its version writes the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.fields import age_years
from cairn.functions.ids import derive_uid
from cairn.operators import resolve, skew
from cairn.session import _path, bounded, cut, delete, mark, release

RECORD = ("record_id", "source", "uid", "display_name", "name_key", "ci", "age", "status", "origin", "hospital", "ts")
COLUMNS = (*RECORD, "person")
SCHEMA = "record_id long, source string, uid string, display_name string, name_key string, ci string, age string, status string, origin string, hospital string, ts timestamp, person long"
INDEX = "key string, record_id long, name_key string, ci string, age string, person long, n long"
BUCKETS, KEEP = 64, 8


def with_uid(records: DataFrame) -> DataFrame:
    obs = "obs" if "obs" in records.columns else F.lit("")
    raw = "row_raw" if "row_raw" in records.columns else F.lit("")
    return records.withColumn("uid", derive_uid("uid", obs, "name_key", "ci", "status", "hospital", "origin", raw))


def latest(records: DataFrame, *more: Column) -> DataFrame:
    """One row for each (source, uid): the latest by ts, so that a replayed older status changes nothing."""
    w = Window.partitionBy("source", "uid").orderBy(F.col("ts").desc_nulls_last(), *more, F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in RECORD[3:]]).desc())
    return records.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def bucket(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")


def by_block(rows: DataFrame, n: int) -> DataFrame:
    """Index rows of records under their blocks; n = -1 takes a record out of a block."""
    words = resolve.words_of()
    name, number = resolve.blocks("_w", "ci")
    r = rows.withColumn("_w", words).withColumn("key", F.explode(F.array_compact(F.array(name, number))))
    return r.select(F.lit("block").alias("kind"), "key", "record_id", "name_key", "ci", "age", "person", F.lit(n).cast("long").alias("n"))


def by_word(rows: DataFrame, n: int) -> DataFrame:
    """Index rows of counts: of words, of all records (the word ''), and of a name's numbers."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("age", "string"), ("person", "long"))]
    size = F.lit(n).cast("long").alias("n")
    blank = F.lit(None).cast("long").alias("record_id")
    words = rows.select(F.lit("word").alias("kind"), F.explode(F.array_union(F.array(F.lit("")), resolve.words_of())).alias("key"), blank, F.lit(None).cast("string").alias("name_key"), F.lit(None).cast("string").alias("ci"), *none, size)
    names = rows.filter("ci <> ''").select(F.lit("name").alias("kind"), F.coalesce("name_key", F.lit("")).alias("key"), blank, "name_key", "ci", *none, size)
    return words.unionByName(names).groupBy("kind", "key", "record_id", "name_key", "ci", "age", "person").agg(F.sum("n").alias("n"))


class Snapshots:
    """The store in a folder, by versions; a reader takes what is complete."""

    def __init__(self, spark: SparkSession, folder: str, keep: int = KEEP):
        self.spark, self.folder, self.keep = spark, folder, keep

    def _versions(self) -> list[str]:
        """Names of complete versions: d... of a batch, b... of all up to one."""
        fs, path = _path(self.spark, f"{self.folder}/records")
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(p.getName().removeprefix("v=") for p in done)

    def _live(self, before: int | None = None) -> list[str]:
        every = [v for v in self._versions() if before is None or int(v[1:]) < before]
        base = max((v for v in every if v[0] == "b"), default="")
        return [*([base] if base else []), *[v for v in every if v[0] == "d" and v[1:] > base[1:]]]

    def _table(self, name: str, versions: list[str]) -> DataFrame:
        schema = f"{SCHEMA}, v string, bucket int" if name == "records" else f"{INDEX}, v string, kind string, bucket int"
        if not versions:
            return self.spark.createDataFrame([], schema)
        at = f"{self.folder}/{name}"
        return self.spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/v={v}" for v in versions])

    def _records(self, versions: list[str]) -> DataFrame:
        return latest(self._table("records", versions), F.col("v").desc()).select(*COLUMNS)

    def read(self, before: int | None = None) -> DataFrame:
        return self._records(self._live(before))

    def _probe(self, index: DataFrame, kind: str, keys: DataFrame) -> DataFrame:
        """Index rows of the given keys (key); only the buckets of these keys are read."""
        keys = cut(keys.select("key").distinct())
        some = [r[0] for r in keys.select(bucket("key")).distinct().collect()]  # BUCKETS at most
        return index.filter((F.col("kind") == kind) & F.col("bucket").isin(some)).join(bounded(keys, 48), "key", "left_semi")

    def _in_blocks(self, index: DataFrame, keys: DataFrame) -> DataFrame:
        w = Window.partitionBy("key", "record_id").orderBy(F.col("v").desc(), F.col("n").desc())
        return self._probe(index, "block", keys).withColumn("_r", F.row_number().over(w)).filter("_r = 1 and n > 0").select("key", "record_id", "name_key", "ci", "age", "person")

    def apply(self, batch: DataFrame, version: int) -> None:
        """For foreachBatch: the batch id is the version, and a replay starts from the versions before it."""
        start, live = mark(), self._live(version)
        index = self._table("index", live)
        batch = batch.select(*[c for c in batch.columns if c not in ("record_id", "person")], F.lit(0).cast("long").alias("record_id"))
        new = cut(latest(with_uid(batch).select(*RECORD)).withColumn("record_id", F.xxhash64("source", "uid")))
        some = [r[0] for r in new.select(bucket("source", "uid")).distinct().collect()]
        held = self._table("records", live).filter(F.col("bucket").isin(some)).join(bounded(new.select("source", "uid"), 96), ["source", "uid"], "left_semi")
        held = cut(latest(held, F.col("v").desc()).select(*COLUMNS))
        both = latest(held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("person", F.lit(None).cast("long")).withColumn("_new", F.lit(1))), F.col("_new").desc())
        owner = held.select("record_id", F.col("person").alias("_owner"))
        known = both.filter("_new = 1").drop("_new", "person").join(owner, "record_id").withColumnRenamed("_owner", "person").select(*COLUMNS)
        fresh = cut(new.join(owner, "record_id", "left_anti"))

        asked = by_block(fresh.withColumn("person", F.lit(None).cast("long")), 1).select("key", "record_id")
        near = cut(self._in_blocks(index, asked))
        rows = near.select("record_id", "name_key", "ci", "age", "person").distinct().unionByName(fresh.select("record_id", "name_key", "ci", "age", F.lit(None).cast("long").alias("person")))
        p = cut(self._profiles(index, rows, fresh))
        own, theirs = p.filter("person is null"), p.filter("person is not null")
        row = F.struct("record_id", "name_key", "ci", "years", "words", "common", "shared")
        a = asked.join(own.select("record_id", row.alias("a")), "record_id").select("key", "a")
        b = near.select("key", "record_id").join(theirs.select("record_id", "person", row.alias("b")), "record_id").select("key", "b", F.col("person").alias("to"))
        found = resolve.judged(skew.pairs(a, b, "key").withColumn("b", F.struct("b.*", "to")))
        rank = F.coalesce(*[F.when(F.col("reason") == r, k) for r, k in resolve.RANKS.items()])
        best = found.groupBy(F.col("a.record_id").alias("record_id")).agg(F.min(F.struct((-rank).alias("rank"), F.col("b.to").alias("to")))["to"].alias("to"))
        best = cut(best)
        founders = resolve.resolve(fresh.join(best, "record_id", "left_anti").select("record_id", "name_key", "ci", "age"))
        placed = fresh.join(best, "record_id", "left").join(founders, "record_id", "left").withColumn("person", F.coalesce("to", "entity")).select(*COLUMNS)
        placed = cut(placed)

        before = held.join(known.select("record_id"), "record_id", "left_semi")
        out = by_block(placed, 1).unionByName(by_block(known, 1)).unionByName(by_block(before, -1)).unionByName(by_word(placed, 1)).unionByName(by_word(known, 1)).unionByName(by_word(before, -1))
        self._write(placed.unionByName(known), out, f"d{version:012d}")
        release(self.spark, start)
        if len(live) >= self.keep:
            self.compact(version - 1)

    def _profiles(self, index: DataFrame, rows: DataFrame, fresh: DataFrame) -> DataFrame:
        """``rows`` as ``resolve.profiles`` gives them, with statistics of the store and the fresh records together."""
        added = by_word(fresh.withColumn("person", F.lit(None).cast("long")), 1)
        words = rows.select(F.explode(F.array_union(F.array(F.lit("")), resolve.words_of())).alias("key"))
        df = self._probe(index, "word", words).select("key", "n").union(added.filter("kind = 'word'").select("key", "n")).groupBy("key").agg(F.sum("n").alias("df"))
        least = df.filter("key = ''").select(F.greatest(F.lit(resolve.LEAST_FREQUENCY), F.floor(F.col("df") * resolve.FREQUENT_SHARE)).alias("least"))
        common = df.filter("key <> ''").crossJoin(F.broadcast(least)).filter("df >= least").select(F.col("key").alias("token"))
        names = rows.select(F.coalesce("name_key", F.lit("")).alias("key"))
        ids = self._probe(index, "name", names).select("key", "ci", "n").union(added.filter("kind = 'name'").select("key", "ci", "n"))
        shared = ids.groupBy("key", "ci").agg(F.sum("n").alias("n")).filter("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("ids")).filter("ids >= 2").select("key", F.lit(True).alias("shared"))
        r = rows.withColumn("words", resolve.words_of()).withColumn("key", F.coalesce("name_key", F.lit("")))
        own = r.select("record_id", F.explode("words").alias("token")).join(common, "token").groupBy("record_id").agg(F.collect_set("token").alias("common"))
        r = r.join(shared, "key", "left").join(own, "record_id", "left")
        return r.select("record_id", "person", F.col("key").alias("name_key"), F.coalesce("ci", F.lit("")).alias("ci"), age_years("age").alias("years"), "words",
                        F.coalesce("common", F.array().cast("array<string>")).alias("common"), F.coalesce("shared", F.lit(False)).alias("shared"))

    def _write(self, records: DataFrame, index: DataFrame, name: str) -> None:
        index.withColumn("bucket", bucket("key")).repartition("kind", "bucket").write.mode("overwrite").partitionBy("kind", "bucket").parquet(f"{self.folder}/index/v={name}")
        records.withColumn("bucket", bucket("source", "uid")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/records/v={name}")

    def compact(self, upto: int) -> None:
        """One base of the versions up to ``upto``. Those that the base before replaced are deleted: a reader may still hold the others."""
        live = self._live(upto + 1)
        if len(live) < 2:
            return
        index = self._table("index", live)
        w = Window.partitionBy("key", "record_id").orderBy(F.col("v").desc(), F.col("n").desc())
        names = ["kind", *[c.split()[0] for c in INDEX.split(", ")]]
        blocks = index.filter("kind = 'block'").withColumn("_r", F.row_number().over(w)).filter("_r = 1 and n > 0").select(names)
        sums = index.filter("kind <> 'block'").groupBy(names[:-1]).agg(F.sum("n").alias("n")).filter("n > 0").select(names)
        self._write(self._records(live), blocks.unionByName(sums), f"b{upto:012d}")
        old = live[0][1:] if live[0][0] == "b" else ""
        for v in self._versions():
            if v[1:] <= old and v != f"b{upto:012d}":
                for name in ("records", "index"):
                    delete(self.spark, f"{self.folder}/{name}/v={v}")


def persons(store: DataFrame) -> DataFrame:
    """The resolved persons of a store."""
    return resolve.summarize(store.drop("person"), store.select("record_id", F.col("person").alias("entity")))


def follow(stream: DataFrame, snapshots: Snapshots, checkpoint: str, every: str | None = None):
    """Start the micro-batch loop; without ``every`` it takes what is there and ends."""
    w = stream.writeStream.foreachBatch(lambda batch, k: snapshots.apply(batch, k)).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
