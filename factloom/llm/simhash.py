"""SimHash near-duplicate groups over word shingles, linked through pigeonhole blocks.

Fingerprint. ``A-Z`` is lower-cased, words are runs of anything but space and \\t..\\r, shingles are
three words joined by a space with repeats (fewer words: the whole sequence once). Bit *b* of the
64-bit fingerprint is 1 if it is set in over half of the shingles' XXH64 values (seed 42). A text
without words (null, empty, white space) has fingerprint 0 and is linked like any other.

Links. Two fingerprints link if at most three bits differ. The 64 bits are cut into six blocks; three
differing bits touch at most three of them, so a linked pair agrees on at least three whole blocks
and meets under one of the 20 keys made of three blocks (31 to 33 bits each). Keys with a single
fingerprint are dropped before any comparison. Under a key with more than ``DEEP`` fingerprints the
pigeonhole is used again: the other 31 to 33 bits are cut into six blocks, of which a linked pair again
agrees on three (15 bits or more). A key with more than ``TILE`` fingerprints left is cut into tiles
and each pair of tiles is its own work item, so no item grows with a hot key. Inside an item a
search from one fingerprint to the next removes what it has reached, so it emits a spanning forest
(fewer rows than fingerprints) instead of all pairs; connectivity is the same.

Groups. Exact copies collapse to one row per fingerprint first. Components are found with
alternating large-star and small-star steps on the spanning links, checkpointed each round.

Defined cases: a null ``doc_id`` never names a group unless its group has no other id; repeated rows
and ties share the group; an empty table gives an empty result; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut

SEED, SHINGLE, MAX_BITS = 42, 3, 3
#: (lowest bit, width) of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: The same for the rest of a key, which three blocks leave.
REST = ((0, 6), (6, 6), (12, 5), (17, 5), (22, 5), (27, 6))
TILE, DEEP = 4096, 1 << 16
#: Shingles hashed between two counts of bits.
CHUNK = 1 << 14


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of one text in UTF-8."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z only, splits at space and \t..\r only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s + len(w) for s, w in zip(starts[SHINGLE - 1 :], words[SHINGLE - 1 :], strict=True)] or [len(line)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, n, CHUNK):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[lo : lo + CHUNK], ends[lo : lo + CHUNK], strict=False)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series(np.array([fingerprint(t) for t in part], dtype=np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "_fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit number."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, _fingerprints(F.col(text).cast("binary")))


def hex16(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def _keys(fp: Column) -> Column:
    """The 20 keys of a fingerprint: three blocks, in the top bits which three; and the bits of the other blocks."""
    block = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)) for at, width in BLOCKS]

    def joined(chosen: tuple[int, ...], head: int) -> Column:
        out = F.lit(head).cast("long")
        for b in chosen:
            out = F.shiftleft(out, BLOCKS[b][1]).bitwiseOR(block[b])
        return out

    every = range(len(BLOCKS))
    return F.array(*[F.struct(joined(c, k).alias("item"), joined(tuple(b for b in every if b not in c), 0).alias("rest")) for k, c in enumerate(combinations(every, len(BLOCKS) - MAX_BITS))])


def _subkeys(rest: Column) -> Column:
    """The 20 keys of the bits that a key leaves: three of their blocks in place, and which three."""
    masks = [sum(((1 << REST[b][1]) - 1) << REST[b][0] for b in c) for c in combinations(range(len(REST)), len(REST) - MAX_BITS)]
    return F.array(*[rest.bitwiseAND(F.lit(m)).bitwiseOR(F.lit((k + 1) << 40)) for k, m in enumerate(masks)])


def forest(fps: np.ndarray, a_side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked by chains of at most MAX_BITS steps among ``fps`` (unsigned).

    With ``a_side`` (two tiles) only links between the sides count; those inside a tile come from the tile's own item.
    """
    left = np.ones(len(fps), dtype=bool)
    out: list[tuple[int, int]] = []
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start] = False
        stack = [start]
        while stack:
            i = stack.pop()
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= MAX_BITS]
            if a_side is not None:
                near = near[a_side[near] != a_side[i]]
            left[near] = False
            out.extend((int(fps[i]), int(fps[j])) for j in near)
            stack.extend(near.tolist())
    return out


def _forests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (item, sub, i, j); an item may cross batches and holds at most two tiles."""
    held: pd.DataFrame | None = None

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        item, sub = part["item"].to_numpy(), part["sub"].to_numpy()
        fps, side, i, j = part["fp"].to_numpy().view(np.uint64), part["tile"].to_numpy(), part["i"].to_numpy(), part["j"].to_numpy()
        edge = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (sub[1:] != sub[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), True])
        links: list[tuple[int, int]] = []
        size = np.diff(edge)
        pairs = edge[:-1][size == 2]
        close = pairs[np.bitwise_count(fps[pairs] ^ fps[pairs + 1]) <= MAX_BITS]
        links.extend(zip(fps[close].tolist(), fps[close + 1].tolist(), strict=True))
        for lo, n in zip(edge[:-1][size > 2], size[size > 2], strict=True):
            hi = lo + n
            links.extend(forest(fps[lo:hi], side[lo:hi] if i[lo] != j[lo] else None))
        ends = np.array(links, dtype=np.uint64).reshape(-1, 2)
        return pd.DataFrame({"a": ends[:, 0].view(np.int64) if len(ends) else np.array([], np.int64), "b": ends[:, 1].view(np.int64) if len(ends) else np.array([], np.int64)})

    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        last = frame[["item", "sub", "i", "j"]].to_numpy()
        open_from = len(last) - int((last[::-1] == last[-1]).all(axis=1).cumprod().sum())
        held, whole = frame.iloc[open_from:], frame.iloc[:open_from]
        if len(whole):
            yield solve(whole)
    if held is not None and len(held):
        yield solve(held)


def links(fps: DataFrame, tile: int = TILE, deep: int = DEEP) -> DataFrame:
    """Spanning links (a, b) between the distinct values of column ``fp``."""
    bounded_batches(fps.sparkSession)
    keyed = fps.select("fp", F.explode(_keys(F.col("fp"))).alias("k")).select("fp", "k.item", "k.rest")
    shared = cut(keyed.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = keyed.join(shared, "item").select("item", F.lit(0).cast("long").alias("sub"), "fp", "n", "rest")
    if not shared.filter(F.col("n") > deep).isEmpty():
        finer = rows.filter(F.col("n") > deep).select("item", F.explode(_subkeys(F.col("rest"))).alias("sub"), "fp", "rest")
        counts = finer.groupBy("item", "sub").agg(F.count("*").alias("n")).filter("n > 1")
        rows = rows.filter(F.col("n") <= deep).unionByName(finer.join(counts, ["item", "sub"]))
    rows = rows.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    pairs = F.expr("transform(sequence(0, tiles - 1), o -> struct(least(tile, o) AS i, greatest(tile, o) AS j))")
    items = rows.select("item", "sub", "fp", "tile", F.explode(pairs).alias("p")).select("item", "sub", "fp", "tile", "p.i", "p.j")
    dealt = items.repartition("item", "sub", "i", "j").sortWithinPartitions("item", "sub", "i", "j", "fp")
    return dealt.mapInPandas(_forests, "a long, b long").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of its component.

    Alternating large-star and small-star steps; the work of a round is two joins on the edges, and
    the number of rounds grows with the logarithm of the component sizes.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        kept = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = cut(kept.filter("u <> v").distinct())
        # A star forest: no node is both a leaf and a root, and every leaf has one root.
        n, leaves = small.agg(F.count("*"), F.countDistinct("u")).first()
        if n == leaves and small.join(small.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
        edges = small
    return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _grouped(docs: DataFrame, doc_id: str, text: str, tile: int) -> DataFrame:
    """(_id, _h: hash of the text, _fp, component_id, _root: smallest fingerprint of the group) for every row."""
    base = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_h"))
    marked = cut(with_fingerprint(base, "_text").select("_id", "_h", "_fp"))
    ids = cut(marked.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("first")))
    found = components(links(ids, tile))
    rooted = cut(ids.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id", F.col("root").alias("_root")))
    return marked.join(named, "_fp")


def group_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint: 16 hex digits, component_id: smallest id reachable) for every row of ``docs``."""
    return _grouped(docs, doc_id, text, tile).select(F.col("_id").alias(doc_id), hex16(F.col("_fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """One row of each group of near copies: the one whose id names the group (the smallest text hash, once, if rows share that id).

    A group without any id keeps one row as well, and so does each of the groups that one repeated id names.
    """
    groups = _grouped(docs, doc_id, text, tile)
    own = groups.filter(F.col("_id").eqNullSafe(F.col("component_id")))
    # Of each group the smallest hash among the rows with its id; how many rows share both is known before any text moves.
    each = own.groupBy("_root", "_id", "_h").agg(F.count("*").alias("_n"))
    chosen = each.groupBy("_root", "_id").agg(F.min(F.struct("_h", "_n")).alias("c")).select(F.col("_id").alias("_fl_id"), F.col("c._h").alias("_fl_kh"), F.col("c._n").alias("_fl_n"))
    chosen = cut(chosen.distinct())
    kept = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.withColumn("_fl_h", F.xxhash64(text)).join(chosen, F.col(doc_id).eqNullSafe(F.col("_fl_id")) & (F.col("_fl_h") == F.col("_fl_kh")))
    out = found.filter("_fl_n = 1").select(*kept)
    if chosen.filter("_fl_n > 1").isEmpty():
        return out
    one = found.filter("_fl_n > 1").groupBy("_fl_id", "_fl_h").agg(F.first(F.struct(*kept)).alias("_fl_row"))
    return out.unionByName(one.select("_fl_row.*"))
