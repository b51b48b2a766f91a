"""N-gram Jaccard join with rare-first prefix filtering; one row per document.

Two sets of word n-grams link when their Jaccard similarity reaches
``percent`` / 100.  A document's n-grams are put in one order for the whole
corpus: rarest first by levels of their count in a count-min sketch, ties by
hash.  If two sets link, they share an n-gram among the first
``n - ceil(percent * n / 100) + 1`` of each.  N-grams that are surely unique
join nothing and are never sent.

Documents with equal sets share a key and count as one node.  Nodes that share
a prefix n-gram are candidates; length, positional and suffix filters apply
before a pair, once, is verified on the whole sets.  N-grams with up to ``HOT``
nodes make pairs of nodes.  Nodes with an n-gram of more lie in blocks, by the
most frequent n-gram of their prefix and by length; such n-grams make pairs of
blocks, whose nodes are all compared inside one task.  So no n-gram makes more
rows than ``HOT`` times its nodes or the pairs of its blocks, and no task holds
more than some pairs and two blocks' sets.

A task returns, of each node that has links there, how many, and an edge to one
of those it is connected with: rows grow with nodes, not with links.  All links
are counted; the components are exact.

Nulls: a null text has no set and links with nothing; a null id is ignored when
a component's smallest id is taken (null if it has no other).  Rows with equal
ids and texts keep their rows.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import discard, fan, settle, text_bytes
from .sketch import Sketch, chunked, each_chunk, texts_of, with_levels
from .words import U64, Words, mix

#: nodes of an n-gram up to which it makes pairs of nodes
HOT = 32
#: nodes, and bytes of sets, in a block, about
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: ranges of hash values that the suffix filter counts a set's n-grams in
RANGES = 64
#: bytes of sets in a tile of pairs to verify, about
TILE = 16 << 20
#: log2 of the most bits that tell which sets to verify (32 MB)
FILTER_BITS = 28
#: counts that part rare n-grams from frequent ones
LEVELS = (2, 4, 16, 64)


def _sets(texts: list[bytes], k: int):
    """Distinct n-gram hashes of each text, sorted; the text's words as one if it has fewer."""
    w = Words(texts, lower=True)
    at, h = w.windows(k, whole=True)
    cut = np.searchsorted(at, w.first)
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _key(s: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return mix(s, 5).sum(dtype=U64).tobytes() + np.bitwise_xor.reduce(mix(s, 9)).tobytes()


def shingled(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, n, key, tokens, places, whole): a row per document; the set of a text that may link."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    sketch = Sketch(text_bytes(rows, "t") / 6, LEVELS)
    chunks = chunked(rows, "t", sketch)

    def distinct(rows):
        """The chunk's sets, and which of them no earlier one equals."""
        sets = _sets(texts_of(rows, "t"), k)
        keys = [_key(s) if len(s) else None for s in sets]
        first, seen = np.zeros(len(sets), bool), set()
        for i, key in enumerate(keys):
            first[i] = key is not None and key not in seen
            seen.add(key)
        return sets, keys, first

    def hashes(rows):
        sets, _, first = distinct(rows)
        return np.concatenate([s for s, f in zip(sets, first, strict=True) if f] or [np.zeros(0, U64)])

    def prefixes(batch_iter):
        for _, rows, told in each_chunk(batch_iter):
            sets, keys, fresh = distinct(rows)
            level = sketch.levels(np.concatenate([s for s, f in zip(sets, fresh, strict=True) if f] or [np.zeros(0, U64)]), told)
            tokens, places, whole, end = [], [], [], 0
            for s, new in zip(sets, fresh.tolist(), strict=True):
                n = len(s)
                lv, end = level[end : end + n * new], end + n * new
                first = n - -(-percent * n // 100) + 1
                alone = int((lv == 0).sum())
                if not new or alone >= first:
                    tokens.append(None), places.append(None), whole.append(None)
                    continue
                order = np.argsort(lv, kind="stable")[alone:first]
                tokens.append(s[order].view(np.int64))
                places.append(np.arange(alone, first, dtype=np.int32))
                whole.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [rows["id"], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(whole, pa.list_(pa.int64()))],
                ["id", "n", "key", "tokens", "places", "whole"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    made = with_levels(chunks, hashes, sketch).mapInArrow(prefixes, f"id {kind}, n long, key binary, tokens array<long>, places array<int>, whole array<long>")
    table = settle(made, "shingles")
    discard(chunks)
    return table


def _maybe(sets: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows of ``sets`` with a key in ``keys`` and few others, so that the rest needn't be shuffled.

    A bit for each hashed key, 16 bits a key up to ``FILTER_BITS``, is broadcast
    in blocks; more keys than that make it let more rows through, none fewer.
    """
    cells = 1 << min(FILTER_BITS, max(15, (16 * n).bit_length()))
    cell = F.pmod(F.xxhash64("key"), F.lit(cells))
    block, bit = F.shiftright(cell, 15).alias("block"), cell.bitwiseAND(32767)
    bits = keys.groupBy(block).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright("bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    known = sets.select("*", block, bit.alias("bit")).join(F.broadcast(bits), "block")
    return known.where(F.getbit(byte, F.col("bit").bitwiseAND(7).cast("int")) == 1).select(*sets.columns)


class _Sets:
    """The sets of a tile, end to end."""

    def __init__(self, table: pa.Table):
        self.key, self.rows = table["key"].to_pylist(), np.asarray(table["rows"])
        lists = table["whole"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        self.offset = np.asarray(lists.offsets).astype(np.int64)
        self.flat = np.asarray(lists.values).view(U64)
        self.n = np.diff(self.offset)
        owner = np.repeat(np.arange(len(self.n)), self.n)
        inside = self.flat[self.offset[0] : self.offset[-1]]
        self.ranges = np.bincount(owner * RANGES + (inside >> U64(58)).astype(np.int64), minlength=len(self.n) * RANGES).reshape(-1, RANGES).astype(np.int32)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.offset[i] : self.offset[i + 1]]


def _need(a, b, percent: int):
    """The least number of common n-grams with which sets of these sizes link."""
    return -(-(a + b) * percent // (100 + percent))


def _common_of_blocks(sets: _Sets, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each set of ``left`` with each of ``right``."""
    def laid(some):
        flat = np.concatenate([sets[i] for i in some])
        return flat, np.repeat(np.arange(len(some)), sets.n[some])

    a, owner_a = laid(left)
    b, owner_b = laid(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for flat, owner in ((a, owner_a), (b, owner_b)):
        column = np.searchsorted(both, flat).clip(max=max(0, len(both) - 1))
        hit = both[column] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(column[hit], kind="stable")
        sides.append((column[hit][order], owner[hit][order]))
    for start in range(0, len(both), 4096):
        width, dense = min(4096, len(both) - start), []
        for (column, owner), n in zip(sides, out.shape, strict=True):
            x, y = np.searchsorted(column, (start, start + width))
            m = np.zeros((n, width), np.float32)
            m[owner[x:y], column[x:y] - start] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _linked_in_tile(sets: _Sets, u: np.ndarray, v: np.ndarray):
    """(node, node it is connected with, rows it links with) of the nodes that the links (u, v) join."""
    up = list(range(len(sets.key)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    others = np.bincount(u, sets.rows[v], len(up)) + np.bincount(v, sets.rows[u], len(up))
    some = np.flatnonzero(others).tolist()
    return pa.table([pa.array([sets.key[i] for i in some], pa.binary()), pa.array([sets.key[top(i)] for i in some], pa.binary()), pa.array([int(others[i]) for i in some], pa.int64())], ["u", "v", "others"])


def _verified(pairs: DataFrame, tiles: DataFrame, blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, others) of nodes with links: of ``pairs`` (u, v, nu, nv), and of all pairs of the blocks in ``tiles`` (a, b).

    blocks: (key, block); sets: (key, rows, whole).
    """
    n, size = pairs.agg(F.count("*"), F.sum(8 * (F.col("nu") + F.col("nv")))).first()
    side = int(np.ceil(np.sqrt(max(2 * fan(pairs), (size or 0) / TILE))))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    tile = F.concat_ws("|", F.least(part("u"), part("v")), F.greatest(part("u"), part("v"))).alias("tile")
    pairs = pairs.select("u", "v", tile)
    single = pairs.select("tile", F.explode(F.array("u", "v")).alias("key"), F.lit(0).alias("side")).distinct()
    ends = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.lit(3).alias("side")))).otherwise(F.array(F.struct(F.col("a").alias("block"), F.lit(1).alias("side")), F.struct(F.col("b").alias("block"), F.lit(2).alias("side"))))
    whole = tiles.select(F.concat_ws("|", *(F.col(f"{x}.{y}") for x in "ab" for y in ("top", "length", "part"))).alias("tile"), F.explode(ends).alias("e")).select("tile", "e.*").join(blocks, "block").select("tile", "key", "side")
    ends = settle(single.unionByName(whole).withColumnRenamed("tile", "of"), "ends")
    sent = _maybe(sets, ends.select("key").distinct(), max(1, 2 * n)).join(ends, "key")

    def verify(left, right):
        held = _Sets(right)
        side = np.asarray(right["side"])
        if (side > 0).any():
            a, b = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
            n, m = held.n[a][:, None], held.n[b][None, :]
            common = _common_of_blocks(held, a, b)
            good = (common * 100 >= (n + m - common) * percent) & (common > 0)
            if (side == 3).all():
                good = np.triu(good, 1)
            x, y = np.nonzero(good)
            return _linked_in_tile(held, a[x], b[y])
        at = {k: i for i, k in enumerate(held.key)}
        u = np.array([at[x] for x in left["u"].to_pylist()], np.int64)
        v = np.array([at[x] for x in left["v"].to_pylist()], np.int64)
        order = np.argsort(u, kind="stable")
        u, v = u[order], v[order]
        # suffix filter: what the sets have apart in each range of hashes can't be common
        near = np.ones(len(u), bool)
        for i in range(0, len(u), 8192):
            x, y = u[i : i + 8192], v[i : i + 8192]
            apart = np.abs(held.ranges[x] - held.ranges[y]).sum(axis=1)
            near[i : i + 8192] = apart <= held.n[x] + held.n[y] - 2 * _need(held.n[x], held.n[y], percent)
        u, v = u[near], v[near]
        good, i = np.zeros(len(u), bool), 0
        while i < len(u):
            j = min(int(np.searchsorted(u, u[i], "right")), i + 4096)
            mine, others = held[u[i]], [held[x] for x in v[i:j]]
            every = np.concatenate(others)
            hit = mine[np.searchsorted(mine, every).clip(max=len(mine) - 1)] == every
            common = np.add.reduceat(hit, np.cumsum([0, *(len(o) for o in others[:-1])]), dtype=np.int64)
            good[i:j] = common * 100 >= (len(mine) + held.n[v[i:j]] - common) * percent
            i = j
        return _linked_in_tile(held, u[good], v[good])

    found = settle(pairs.groupBy("tile").cogroup(sent.select("of", "key", "side", "rows", "whole").groupBy("of")).applyInArrow(verify, "u binary, v binary, others long"), "links")
    discard(ends)
    return found


def links(table: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, comp): of each key that has links, its component's smallest key; and (node, others): the rows it links with."""
    nodes = table.where("tokens is not null").groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "tokens", "places")))
    entries = nodes.select("key", "n", F.explode(F.arrays_zip("tokens", "places")).alias("z")).select("key", "n", F.col("z.tokens").alias("t"), F.col("z.places").alias("place"))
    many = entries.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    shared = settle(entries.join(many, "t"), "tokens")
    # blocks of the nodes with a hot n-gram: by the most frequent one, length and, at last, by hash
    hot = shared.where(F.col("c") > HOT).select("key", "n", "t", "c")
    length = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("long")
    first = hot.groupBy("key").agg(F.max("n").alias("n"), F.max_by("t", F.struct("c", "t")).alias("top")).withColumn("length", length)
    size = first.groupBy("top", "length").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).alias("parts"))
    placed = first.join(size, ["top", "length"]).select("key", F.struct("top", "length", F.pmod(F.xxhash64("key"), F.col("parts")).alias("part")).alias("block"))
    blocks = settle(placed, "blocks")
    spots = hot.select("key", "t").join(blocks, "key").select("t", "block").distinct()
    one, two = F.col("x.block"), F.col("y.block")
    # sets link only if their lengths' classes are the same or neighbours; one more for rounding
    tiles = spots.alias("x").join(spots.alias("y"), "t").where((one <= two) & (F.abs(one["length"] - two["length"]) <= 2)).select(one.alias("a"), two.alias("b")).distinct()
    tiles = settle(tiles, "tiles")
    # pairs of the other n-grams, each once
    cold = shared.where(F.col("c") <= HOT).join(blocks, "key", "left").select("t", F.struct("key", "n", "place", "block").alias("a"))
    close = F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent
    need = F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100 + percent))
    rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    pairs = cold.join(cold.select("t", F.col("a").alias("b")), "t").where((F.col("a.key") < F.col("b.key")) & close & (rest >= need))
    pairs = pairs.groupBy(F.col("a.key").alias("u"), F.col("b.key").alias("v")).agg(*(F.first(c).alias(d) for c, d in (("a.n", "nu"), ("b.n", "nv"), ("a.block", "bu"), ("b.block", "bv"))))
    # pairs of blocks that a tile compares are left to it
    both = [F.least("bu", "bv").alias("a"), F.greatest("bu", "bv").alias("b")]
    pairs = pairs.select("u", "v", "nu", "nv", *(F.when(F.col("bu").isNotNull() & F.col("bv").isNotNull(), c).alias(d) for c, d in zip(both, ("a", "b"), strict=True)))
    pairs = settle(pairs.join(tiles.withColumn("held", F.lit(True)), ["a", "b"], "left").where("held is null").select("u", "v", "nu", "nv"), "pairs")
    rows = table.where("n > 0").groupBy("key").agg(F.count("*").alias("rows"))
    wanted = blocks.select("key").unionByName(pairs.select(F.explode(F.array("u", "v")).alias("key"))).distinct()
    copies = wanted.join(rows, "key")
    sets = _maybe(table.where("whole is not null").select("key", "whole"), wanted, max(1, 2 * wanted.count())).dropDuplicates(["key"])
    found = _verified(pairs, tiles, blocks, sets.join(copies, "key"), percent)
    discard(shared, blocks, tiles, pairs)
    return components(found.select("u", "v")), found.groupBy(F.col("u").alias("node")).agg(F.sum("others").alias("others"))


def _members(table: DataFrame, comp: DataFrame, links_of: DataFrame | None = None) -> DataFrame:
    """(id, n, component_id) of each row, and n_links if ``links_of`` (node, others) is given."""
    by_key = table.where("n > 0").groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("rows"))
    named = by_key.join(comp, F.col("key") == F.col("node"), "left").drop("node").withColumn("comp", F.coalesce("comp", "key"))
    more = []
    if links_of is not None:
        named = named.join(links_of, F.col("key") == F.col("node"), "left").withColumn("n_links", F.col("rows") - 1 + F.coalesce("others", F.lit(0)))
        more = ["n_links"]
    lowest = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "comp").select("key", "component_id", *more)
    out = table.select("id", "n", "key").join(named, "key", "left")
    return out.select("id", "n", F.coalesce("component_id", "id").alias("component_id"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in more))


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row: component_id is the smallest id reachable by links."""
    table = shingled(docs, id_col, text_col, k, percent)
    out = _members(table, links(table, percent)[0])
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``linked_components`` with n_links: the number of other rows that a row links with, those with an equal set included."""
    table = shingled(docs, id_col, text_col, k, percent)
    comp, links_of = links(table, percent)
    out = _members(table, comp, links_of)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")


def keep_one(docs: DataFrame, text_col: str = "text", k: int = 5, percent: int = 80, order_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, of each component only the one with the smallest ``order_col``; rows without a set stay."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    base = settle(docs.select(row, F.struct(F.col(order_col).isNull().alias("z"), F.col(order_col).alias("o"), F.monotonically_increasing_id().alias("n")).alias("place")), "rows")
    ranked = linked_components(base.select("place", F.col(f"row.`{text_col}`").alias("t")), "place", "t", k, percent)
    stay = ranked.where("n_shingles = 0 or place = component_id").select(F.col("place.n").alias("n"))
    return base.join(stay.hint("merge"), F.col("place.n") == F.col("n"), "left_semi").select("row.*")
