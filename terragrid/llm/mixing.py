"""Mixing sources to target weights by Sainte-Lague apportionment, DataFrame functions only.

Sources, in order of code points with null last, have repeating weights and
share ``share`` times all words; a target stops at ``most`` times its source's
size and the excess is reshared by weight.  The sum of the targets, in blocks of
``block`` words, is the number of seats; the seats go to the sources with the
highest quotients target / (2 i - 1), then each source's seats to its shards in
the same way by the shard's words.  Seats are thus integer quotas per shard.

A shard holds about ``per_shard`` documents, picked by hash, so a source of any
size is spread over many.  In a shard, a source's documents are laid end to end
in a seeded order and cut into blocks; the quota takes whole rounds of the line
and then as many blocks as are left, from a seeded block on.  No document
exceeds ``most`` times its size, since a quota is cut at ``most`` rounds.

The highest quotients are found without a seat-by-seat loop: with n parties and
T seats, rounding votes by the divisors V / (T - n/2) and V / (T + n/2) bounds
each party's seats from both sides; only the seats between are ranked.

Nulls: a null text has size 0, a null source is a source of its own, null ids
are ordered first within a seed.  Documents of size 0 take nothing.  Rows with
equal ids and sizes are interchangeable.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import settle

WEIGHTS = (3, 1, 2)
PER_SHARD = 20_000
BLOCK = 32


def _number(*parts: Column) -> Column:
    """32 bits of a hash that any SQL engine has."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def apportion(votes: DataFrame, by: list[str], vote: str, seats: str, order: list[str], out: str) -> DataFrame:
    """``votes`` with ``out``: the seats of each row, of ``seats`` for its group, by highest quotients.

    Rows without votes get none; so do all if a group has no votes.  Ties go by ``order``.
    """
    group = W.partitionBy(*by)
    v, t = F.col(vote).cast("double"), F.col(seats)
    df = votes.withColumns({"__v": F.sum(v).over(group), "__n": F.count(F.lit(1)).over(group)})
    low = F.when((t > F.col("__n") / 2) & (F.col("__v") > 0), F.floor(v * (t - F.col("__n") / 2) / F.col("__v") + 0.5) - 1).otherwise(0)
    high = F.when((F.col("__v") > 0) & (v > 0), F.floor(v * (t + F.col("__n") / 2) / F.col("__v") + 0.5) + 1).otherwise(0)
    df = df.withColumn("__low", F.greatest(F.lit(0), low)).withColumn("__high", F.greatest(F.col("__low"), high))
    df = df.withColumn("__left", t - F.sum("__low").over(group))
    df = df.withColumn("__k", F.explode(F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low") + 1, F.col("__high"))).otherwise(F.array(F.lit(None).cast("long")))))
    rank = F.row_number().over(group.orderBy((v / (2 * F.col("__k") - 1)).desc_nulls_last(), *order, "__k"))
    df = df.withColumn("__won", F.col("__k").isNotNull() & (rank <= F.col("__left")))
    return df.groupBy(*votes.columns).agg((F.max("__low") + F.sum(F.col("__won").cast("long"))).alias(out))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = 1.5, most: int = 2, block: int = BLOCK, per_shard: int = PER_SHARD, seed: int = 0) -> DataFrame:
    """(id, size, source_size, target, taken) of each row of ``docs``; see the module."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    base = settle(docs.select(F.col(id_col).alias("id"), F.coalesce(source, F.lit("")).alias("s"), source.isNull().alias("z"), size.alias("size"), draw.alias("draw")), "sizes")
    shards = max(1, -(-base.count() // per_shard))
    base = base.withColumn("shard", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.lit(shards)))
    lines = base.groupBy("z", "s", "shard").agg(F.sum("size").alias("line"))
    sources = lines.groupBy("z", "s").agg(F.sum("line").alias("source_size"))

    # targets: fill up from the source that reaches its cap first
    everything = W.partitionBy(F.lit(0))
    pick = F.array(*(F.lit(float(w)) for w in weights))
    t = sources.withColumn("rank", F.row_number().over(everything.orderBy("z", "s"))).withColumn("w", F.get(pick, F.pmod(F.col("rank") - 1, F.lit(len(weights)))))
    t = t.withColumns({"cap": F.col("source_size") * float(most), "all": F.sum("source_size").over(everything) * share})
    fill = everything.orderBy(F.col("cap") / F.col("w"), "rank")
    to_here = fill.rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("level", (F.col("all") - (F.sum("cap").over(to_here) - F.col("cap"))) / (F.sum("w").over(everything) - (F.sum("w").over(to_here) - F.col("w"))))
    t = t.withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
    level = F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "rank"))).over(everything)
    t = t.withColumn("target", F.when(F.col("free"), F.col("w") * level).otherwise(F.col("cap")))
    t = t.withColumn("seats", F.round(F.sum("target").over(everything) / block).cast("long"))
    t = apportion(t.select("z", "s", "rank", "source_size", "target", "seats"), ["seats"], "target", "seats", ["rank"], "source_seats")
    quotas = apportion(lines.join(t.select("z", "s", "source_size", "target", "source_seats"), ["z", "s"]), ["z", "s"], "line", "source_seats", ["shard"], "quota")

    # the documents' places on their lines, and what the quota takes of each
    here = W.partitionBy("z", "s", "shard")
    placed = base.withColumn("b", F.sum("size").over(here.orderBy("draw", "id", "size").rowsBetween(W.unboundedPreceding, 0))).withColumn("a", F.col("b") - F.col("size"))
    d = placed.join(quotas, ["z", "s", "shard"])
    line = F.col("line")
    d = d.withColumn("cover", F.least(F.col("quota") * block, line * most))
    d = d.withColumn("rounds", F.when(line > 0, F.floor(F.col("cover") / line)).otherwise(0)).withColumn("rest", F.col("cover") - F.col("rounds") * line)
    start = F.when(line > 0, F.pmod(_number(F.lit(str(seed)), F.col("shard").cast("string"), F.col("s")), F.greatest(F.lit(1), F.ceil(line / block))) * block).otherwise(0)
    d = d.withColumn("from", start).withColumn("to", F.col("from") + F.col("rest"))
    overlap = lambda x, y: F.greatest(F.lit(0), F.least("b", y) - F.greatest("a", x))
    taken = F.col("rounds") * F.col("size") + overlap(F.col("from"), F.col("to")) + overlap(F.lit(0), F.col("to") - line)
    return d.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, to the nearest whole number."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    base = settle(docs.select(row, F.col(text_col).alias("t"), F.col(source_col).alias("s"), F.monotonically_increasing_id().alias("n")), "rows")
    times = mix(base, "n", "t", "s", **how).where("taken * 2 >= size and size > 0").select("n", F.round(F.col("taken") / F.col("size")).cast("int").alias("times"))
    return base.join(times, "n").select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
