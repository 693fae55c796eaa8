"""Mixing sources to target weights, with DataFrame functions only.

Sizes are words. A source's target is its weighted share of the whole, stopped at
`cap` times its size with the excess reshared (water filling, in closed form). A
document belongs to one of `blocks` permuted blocks of its source. Whole passes take
every block; the last pass takes blocks in order and ends inside one, so only that
block's documents need a running sum. The (pass, block) units of each source are
dealt to output shards by a splitting tree: at each node the left half's counts by
source are a multivariate hypergeometric draw (selection sampling in `aggregate`),
and each shard then gets its own run of the source's permuted units.

Null text has size 0, a null source is a source of its own (the last one), empty
tables give empty results, repeated rows are mixed as rows of their own, and extra
columns are ignored (`mixed` keeps the document columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
BLOCKS, SHARDS, SEED = 512, 16, 6
WORD = r"[^\x20\x09-\x0D]+"


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) with index (from 0, by code point, null last) and target added."""
    ordered = sources.withColumn("index", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("index") % len(weights) + 1).cast("int"))
    w = ordered.withColumn("weight", weight).withColumn("limit", cap * F.col("source_size"))
    every = Window.partitionBy(F.lit(0))
    by = every.orderBy(F.col("limit") / F.col("weight"), "index")
    before = F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(every) - before) / rest  # were this source the first that isn't stopped
    w = w.withColumn("place", F.row_number().over(by)).withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= F.col("limit")
    chosen = F.min(F.when(fits, F.struct("place", "level"))).over(every)["level"]
    return w.withColumn("target", F.coalesce(F.least(F.col("limit"), chosen * F.col("weight")), F.col("limit"))).drop("place", "level", "limit", "weight")


def _draw(node: Column, counts: Column, take: Column, seed: int) -> Column:
    """How many of each source's units a draw of `take` from all of them has: a multivariate hypergeometric variate."""
    all_units = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    span = float(1 << 53)

    def source(state: Column, at: Column) -> Column:
        n = F.element_at(counts, at)

        def unit(s: Column, i: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed), node, at, i), F.lit(1 << 53)).cast("double") / span
            hit = (u * s["left"] < s["need"]).cast("long")
            return F.struct((s["left"] - 1).alias("left"), (s["need"] - hit).alias("need"), (s["got"] + hit).alias("got"))

        begin = F.struct(state["left"].alias("left"), state["need"].alias("need"), F.lit(0).cast("long").alias("got"))
        units = F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>"))
        end = F.aggregate(units, begin, unit)
        return F.struct(end["left"].alias("left"), end["need"].alias("need"), F.concat(state["out"], F.array(end["got"])).alias("out"))

    begin = F.struct(all_units.alias("left"), take.cast("long").alias("need"), F.array().cast("array<long>").alias("out"))
    places = F.when(F.size(counts) > 0, F.sequence(F.lit(1), F.size(counts))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, begin, source)["out"]


def split_tree(units: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(index, units) of sources -> (index, shard, first, last): the run of a source's permuted units that each shard gets. Shards get equally many units, one more or less."""
    counts = F.transform(F.array_sort(F.collect_list(F.struct("index", "units"))), lambda x: x["units"].cast("long"))
    keys = F.transform(F.array_sort(F.collect_list(F.struct("index", "units"))), lambda x: x["index"])
    tree = units.groupBy().agg(counts.alias("counts"), keys.alias("keys")).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(shards))
    width = shards
    while width > 1:
        half = ((F.col("hi") - F.col("lo")) / 2).cast("int")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        node = F.concat_ws("-", F.col("lo"), F.col("hi"))
        left = F.floor(total * half / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)))
        drawn = tree.withColumn("left", _draw(node, F.col("counts"), left, seed)).withColumn("mid", F.col("lo") + half)
        rest = F.zip_with("counts", "left", lambda a, b: a - b)
        one = F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), F.col("left").alias("counts"))
        two = F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), rest.alias("counts"))
        same = F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("counts").alias("counts"))
        tree = drawn.select("keys", F.explode(F.when(half > 0, F.array(one, two)).otherwise(F.array(same))).alias("n")).select("keys", "n.lo", "n.hi", "n.counts")
        width = (width + 1) // 2
    runs = tree.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip(F.col("keys").alias("index"), F.col("counts").alias("n"))).alias("x")).select("shard", "x.index", "x.n")
    last = F.sum("n").over(Window.partitionBy("index").orderBy("shard"))
    return runs.withColumn("last", last).withColumn("first", F.col("last") - F.col("n")).where("n > 0").select("index", "shard", "first", "last")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shards, text_hash): the words the mix takes of each row, and the output shard of each pass that takes it."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), "text")).otherwise(key)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _size(F.col("text")).alias("size"), F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), F.xxhash64("text").alias("text_hash"))
    sized = materialize(sized, "sizes")
    by_block = materialize(sized.groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")  # blocks rows a source at most
    goal = targets(by_block.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    quota = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    goal = materialize(goal.withColumn("passes", full).withColumn("rest", quota - F.col("passes") * F.col("source_size")), "targets")
    in_order = Window.partitionBy("source").orderBy("block")
    laid = by_block.join(goal, by_block["source"].eqNullSafe(goal["source"])).select(by_block["source"], "block", "words", "index", "passes", "rest")
    laid = laid.withColumn("before", F.sum("words").over(in_order) - F.col("words"))
    laid = laid.withColumn("left", F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before"))))
    passes = F.col("passes") + (F.col("left") > 0).cast("int")
    units = laid.where((passes > 0) & (F.col("words") > 0)).select("source", "block", "index", F.explode(F.sequence(F.lit(0), passes - 1)).alias("pass"))
    shuffled = Window.partitionBy("index").orderBy(F.xxhash64(F.lit(seed + 1), "index", "pass", "block"), "pass", "block")
    units = units.withColumn("rank", F.row_number().over(shuffled) - 1)
    runs = split_tree(units.groupBy("index").agg(F.count("*").alias("units")), shards, seed + 2)
    dealt = units.join(runs, "index").where("rank >= first and rank < last").groupBy("index", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("to"))
    blocks_plan = materialize(laid.join(dealt, ["index", "block"], "left").select("source", "block", "words", "passes", "left", F.transform("to", lambda x: x["shard"]).alias("shards")), "plan")

    d = sized.alias("d").join(blocks_plan.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.block") == F.col("b.block")))
    d = d.select("d.doc_id", "d.source", "d.size", "d.block", "d.text_hash", "b.words", "b.passes", "b.left", "b.shards")
    inside = (F.col("left") > 0) & (F.col("left") < F.col("words"))  # the one block of a source in which the last pass ends
    shuffle = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 3), "doc_id", "text_hash"), "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = d.where(inside).withColumn("before", F.sum("size").over(shuffle) - F.col("size"))
    cut = cut.withColumn("last", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("before")))).drop("before")
    whole = d.where(~inside).withColumn("last", F.when(F.col("left") > 0, F.col("size")).otherwise(F.lit(0)))
    d = whole.unionByName(cut).withColumn("taken", F.col("passes") * F.col("size") + F.col("last"))
    kept = F.when(F.col("taken") > 0, F.slice("shards", F.lit(1), F.col("passes") + (F.col("last") > 0).cast("int"))).otherwise(F.array().cast("array<int>"))
    return d.join(goal.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), kept.alias("shards"), "text_hash"
    )


def mixed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **options) -> DataFrame:
    """The mix itself: docs' columns and `mix_shard`, a row for every pass that takes a document, its text cut where the mix ends inside it; each shard shuffled.

    Rows that share doc_id, source and text are told apart by their number among these; each gets a plan of its own.
    """
    same = ["id", "s", "h"]
    taken = plan(docs, shards=shards, seed=seed, **options).where("taken > 0")
    taken = taken.select(F.col("doc_id").alias("id"), F.col("source").alias("s"), F.col("text_hash").alias("h"), F.struct("taken", "shards").alias("x"))
    taken = taken.groupBy(*same).agg(F.array_sort(F.collect_list("x")).alias("plans"))  # as many as a row is repeated
    rows = docs.select(F.struct("*").alias("doc"))  # apart, so that no column of docs clashes
    rows = rows.withColumn("h", F.xxhash64("doc.text"))
    repeated = rows.groupBy(F.col("doc.doc_id").alias("id"), F.col("doc.source").alias("s"), "h").count().where("count > 1").limit(1).count()
    nth = F.row_number().over(Window.partitionBy("doc.doc_id", "doc.source", "h").orderBy(F.lit(0))) if repeated else F.lit(1)
    rows = rows.withColumn("nth", nth).alias("r").join(taken.alias("t"), F.col("r.doc.doc_id").eqNullSafe(F.col("t.id")) & F.col("r.doc.source").eqNullSafe(F.col("t.s")) & (F.col("r.h") == F.col("t.h")))
    rows = rows.where("nth <= size(plans)").select("doc", "id", F.col("r.h").alias("h"), "nth", F.element_at("plans", F.col("nth")).alias("x"))
    rows = rows.select("doc", "id", "h", "nth", _size(F.col("doc.text")).alias("n"), "x.taken", "x.shards")
    rows = rows.select("doc", "id", "h", "nth", "n", "taken", F.posexplode("shards").alias("pass", "mix_shard"))
    words = F.least(F.col("n"), F.col("taken") - F.col("pass") * F.col("n"))
    part = F.array_join(F.slice(F.regexp_extract_all("doc.text", F.lit(WORD), F.lit(0)), F.lit(1), words.cast("int")), " ")
    rows = rows.withColumn("cut", F.when(words < F.col("n"), part))
    local = F.xxhash64(F.lit(seed + 4), "id", "h", "nth", "pass")
    salt = F.pmod(F.xxhash64(F.lit(seed + 5), "id", "h", "nth", "pass"), F.lit(16))
    rows = rows.withColumn("order", local).repartition("mix_shard", salt).sortWithinPartitions("mix_shard", "order")
    new = {"text": F.coalesce("cut", "doc.text"), "n_chars": F.when(F.col("cut").isNotNull(), F.length("cut").cast("long")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return rows.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns), "mix_shard")
