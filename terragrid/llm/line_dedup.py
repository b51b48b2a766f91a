"""Line dedup by pairwise alignment of documents that share lines.

Lines are compared without white space at their ends; lines without a word
don't count.  From each line on, the fewest consecutive lines that reach
``min_words`` words are a run; a block that can be deleted begins with one.  A run
hash that up to ``RARE`` documents hold pairs all of them.  The holders of a more
frequent one fall into ``CLASSES`` classes by hash, the first of each class is a
partner of all that come after it, so that pairs grow with the lines, not with
the square of a group.  What is deleted needs no further partner; where a line of a
frequent run stays, rounds with more classes follow and then one with all earlier
holders, so that what is deleted is that of the alignment of all pairs.  For
each line of a block a run from a line on, or one up to a line, is in the block and
has the line, so none is missed.  The last round's pairs grow with the holders of
runs that no partner so far has aligned.

Hashes that hold more than a ``SPLIT``-th of all runs are at most ``SPLIT`` and are
joined by broadcast; so are the ids of the partners that as many pairs name, whose
lines are then dealt ``SALT`` times.

A pair is aligned by patience diff: lines unique in both are matched by the
longest increasing run, then the gaps between them likewise; matches are grown
over equal neighbours.  Aligned common blocks of ``min_words`` words or more
are deleted from the later document.  The first holder of a line never deletes
it, so every distinct line stays somewhere.  Lines without a word stay as they are.

Order: by id, nulls last, then by place in the input; rows with equal ids are
different documents.  Null texts have no lines.  An empty table gives an empty
result.  Input columns named like an output are replaced.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import SPACE
from .runtime import let, settle

#: documents that a run may have for all pairs of them; classes of the holders of others
RARE, CLASSES = 4, 3
#: classes of the rounds that follow for what stays, before one with all holders
MORE = (32,)
#: share of all rows from which a key is split, and into how many
SPLIT, SALT = 4096, 16
OUTPUTS = ("n_lines", "n_removed", "kept_text")


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of equal items of a and b, increasing in both, by patience diff."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        count: dict = {}
        for side, lo, hi, items in ((0, a0, a1, a), (1, b0, b1, b)):
            for i in range(lo, hi):
                seen = count.setdefault(items[i], [0, 0, 0, 0])
                seen[side] += 1
                seen[2 + side] = i
        once = [(c[2], c[3]) for c in count.values() if c[0] == c[1] == 1]
        once.sort()
        # longest increasing run of places in b
        tops: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(once):
            p = bisect.bisect_left(tops, j)
            back.append(piles[p - 1] if p else -1)
            if p == len(tops):
                tops.append(j), piles.append(n)
            else:
                tops[p], piles[p] = j, n
        run, n = [], piles[-1] if piles else -1
        while n >= 0:
            run.append(once[n])
            n = back[n]
        if not run:
            continue
        found += run
        run = [(a1, b1), *run]
        for (hi_a, hi_b), (lo_a, lo_b) in zip(run, [*run[1:], (a0 - 1, b0 - 1)], strict=True):
            todo.append((lo_a + 1, hi_a, lo_b + 1, hi_b))
    return sorted(found)


def common_blocks(a: list, b: list, words: list[int], least: int) -> list[int]:
    """Lines of b in aligned blocks of at least so many words (``words``: of b's lines)."""
    out, block, last = [], [], None
    for i, j in [*patience(a, b), (-9, -9)]:
        if last != (i - 1, j - 1):
            if sum(words[x] for x in block) >= least:
                out += block
            block = []
        block.append(j)
        last = (i, j)
    return out


def _runs(h: Column, w: Column, live: Column, least: int) -> Column:
    """Hashes of the fewest lines from each line on that have ``least`` words (every line has one) and a line alive; none where the text ends before."""
    none = F.struct(F.lit(0).alias("words"), F.lit(0).cast("long").alias("hash"), F.lit(False).alias("live"))
    step = lambda s, x: F.when(s["words"] >= least, s).otherwise(F.struct((s["words"] + x["w"]).alias("words"), F.xxhash64(s["hash"], x["h"]).alias("hash"), (s["live"] | x["live"]).alias("live")))
    more = lambda z, i: F.aggregate(F.slice(z, i + 1, max(1, least)), none, step, lambda s: F.when((s["words"] >= least) & s["live"], s["hash"]))
    one = lambda x: F.when(x["live"], F.xxhash64(F.lit(0).cast("long"), x["h"]))
    run = lambda z: F.transform(z, lambda x, i: F.when(x["w"] >= least, one(x)).otherwise(more(z, i)))
    return F.filter(let(F.arrays_zip(h.alias("h"), w.alias("w"), live.alias("live")), run), lambda x: x.isNotNull())


def _seeds(live: Column, least: int) -> Column:
    """Runs from each line on and, the lines read backwards, up to each line: one of both is in a block for each of its lines."""
    back = lambda c: F.reverse(c)
    return F.array_distinct(F.concat(_runs(F.col("h"), F.col("w"), live, least), _runs(back(F.col("h")), back(F.col("w")), back(live), least)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """The rows of ``docs`` with n_lines, n_removed (long) and kept_text."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    place = F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("o"), F.monotonically_increasing_id().alias("n")).alias("doc")
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")).alias("t")
    base = settle(docs.select(row, place), "rows")
    trimmed = F.transform(F.split("t", "\n", -1), lambda x, i: F.struct(F.regexp_replace(x, f"^{SPACE}|{SPACE}$", "").alias("x"), i.alias("at")))
    table = base.select("doc", text).select("doc", F.filter(trimmed, lambda z: z["x"] != "").alias("l")).where(F.size("l") > 0)
    table = table.select("doc", F.transform("l", lambda z: F.xxhash64(z["x"], F.length(z["x"]))).alias("h"), F.transform("l", lambda z: F.size(F.split(z["x"], SPACE))).alias("w"), F.col("l.at").alias("at"))
    table = settle(table, "lines")
    # copies meet by a hash of the whole, which is a seed like others
    every = F.concat(_seeds(F.transform("h", lambda _: F.lit(True)), min_words), F.array(F.xxhash64(F.lit(1), "h")))
    each = settle(table.select("doc", F.explode(every).alias("h")), "runs")
    n_each = each.count()

    def met(runs, all_docs, classes):
        """(held, pairs): of each hash the holders' number and the first of each class, and the pairs of all that ``runs`` brings together."""
        some = each.groupBy("h", F.pmod(F.xxhash64("doc"), F.lit(classes)).alias("class")).agg(F.min("doc").alias("first"), F.count("*").alias("c"))
        if runs is not None:
            some = some.join(runs.select("h").distinct(), "h", "left_semi")
        held = settle(some.groupBy("h").agg(F.sum("c").alias("c"), F.collect_list("first").alias("firsts")).where("c > 1"), "holders")
        hot = F.col("c") > n_each / SPLIT
        rest = held.where((F.col("c") > RARE) | hot).select("h", "firsts", hot.alias("hot"))
        frequent, mine = rest.where("hot").select("h", "firsts"), each if runs is None else runs
        at_hot = mine.join(F.broadcast(frequent), "h").select("doc", "firsts")
        found = at_hot.unionByName(mine.join(F.broadcast(frequent.select("h")), "h", "left_anti").join(rest.where("not hot").select("h", "firsts"), "h").select("doc", "firsts"))
        if all_docs:
            few = each.join(held.where((F.col("c") <= RARE) & ~hot).select("h"), "h").groupBy("h").agg(F.collect_list("doc").alias("docs"))
            found = found.unionByName(few.select(F.explode("docs").alias("doc"), F.col("docs").alias("firsts")))
        return rest.select("h", F.array_min("firsts").alias("least")), found.select("doc", F.explode("firsts").alias("first")).where("first < doc").distinct()

    def needs(pairs):
        hubs = pairs.groupBy("first").agg(F.count("*").alias("c")).where(F.col("c") > max(1.0, pairs.count() / SPLIT)).select("first", F.lit(SALT).alias("salts"))
        hubs = F.broadcast(settle(hubs, "hubs"))
        salts = F.coalesce("salts", F.lit(1))
        dealt = pairs.join(hubs, "first", "left").select("doc", "first", F.pmod(F.xxhash64("doc"), salts).alias("salt"))
        theirs = table.select(F.col("doc").alias("first"), F.col("h").alias("theirs")).join(hubs, "first", "left").select("first", "theirs", F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long"))).alias("salt"))
        return settle(dealt.join(theirs, ["first", "salt"]).select("doc", "theirs"), "needed")

    kinds = table.schema

    def align(batch_iter):
        for b in batch_iter:
            out = []
            for x, y, w, at in zip(*(b[c].to_pylist() for c in ("theirs", "h", "w", "at")), strict=True):
                out.append([at[j] for j in common_blocks(x, y, w, min_words)])
            yield pa.RecordBatch.from_arrays([b["doc"], pa.array(out, pa.list_(pa.int32()))], ["doc", "gone"])

    doc_type = kinds["doc"].dataType.simpleString()

    def align_all(pairs, before=None):
        found = needs(pairs).join(table, "doc").mapInArrow(align, f"doc {doc_type}, gone array<int>").select(F.col("doc.n").alias("n"), "gone")
        found = found if before is None else found.unionByName(before)
        return settle(found.groupBy("n").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")), "gone")

    frequent, pairs = met(None, True, CLASSES)
    frequent, pairs = settle(frequent, "frequent"), settle(pairs, "pairs")
    gone, tried = align_all(pairs), pairs
    for classes in (*MORE, None):
        # frequent runs of which a line stays, though an earlier document holds them
        held = each.join(frequent, "h").where("doc > least").select("doc").distinct()
        open_ = table.join(held, "doc", "left_semi").join(gone.hint("merge"), F.col("doc.n") == F.col("n"), "left")
        alive = F.when(F.col("gone").isNull(), F.transform("at", lambda _: F.lit(True))).otherwise(F.transform("at", lambda x: ~F.array_contains("gone", x)))
        runs = open_.where(F.col("gone").isNull() | (F.size("gone") < F.size("at"))).select("doc", F.explode(_seeds(alive, min_words)).alias("h"))
        runs = settle(runs.join(frequent, "h").where("doc > least").select("doc", "h"), "open")
        if runs.isEmpty():
            break
        if classes:
            pairs = met(runs, False, classes)[1]
        else:
            pairs = runs.join(each.withColumnRenamed("doc", "first"), "h").where("first < doc").select("doc", "first").distinct()
        pairs = settle(pairs.join(tried, ["doc", "first"], "left_anti"), "pairs")
        gone, tried = align_all(pairs, gone), tried.unionByName(pairs)
    # what is gone grows with the documents: never broadcast
    joined = base.select("row", "doc", text).join(gone.hint("merge"), F.col("doc.n") == F.col("n"), "left")
    lines = F.split("t", "\n", -1)
    every = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    left = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n"))
    return joined.select("row", F.size(every).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), left.alias("kept_text")).select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in OUTPUTS), *OUTPUTS)
