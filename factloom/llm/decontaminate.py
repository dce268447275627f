"""Benchmark decontamination by the q-gram lemma: diagonal bands, an edit budget, banded alignment.

Texts and items are compared lower-cased with each run of white space as one space, in characters
(code points). A document leaks an item if it holds a passage within ``e`` edits of a window of ``W``
characters of the item, W = min(item length, ``WINDOW``) and e 8 % of W (less where the lemma would
give nothing to count). Such a passage shares at least ``t = W + 1 - q (e + 1)`` q-grams with the
window, all on diagonals that differ by e at most. So the shared q-grams are counted in overlapping
bands of ``2 * BAND`` diagonals; a run of t of them in one band and item within the length of a window
makes a candidate, and every window that a candidate allows is verified, by comparison and else by an
alignment that is banded to e diagonals on each side. The candidates of a chunk of text are aligned
together. A leak reaches over all windows within the budget of its text and item, and its edits are the
least of theirs; where a window has edits, its start is right to as many characters.

Windows of an item that read alike match the same passages, so only the first of them is indexed and
verified: what repeats itself inside an item costs no more than one window. The shared q-grams of a
chunk are taken ``HITS`` at a time, in stretches of the text that overlap by a window, so repetitive
texts need time but no more memory, and nothing is left out.

The items come in blocks of ``BLOCK_CHARS`` characters (or of one longer item). One block is on the
driver and on the executors at a time: with several blocks each pass over the texts is finished and
written out before the next block is read.

Defined cases: null and empty texts leak nothing; null and empty items are skipped; items shorter than
``Q + 4`` characters after normalisation are too short for q-grams and are leaked by texts that are
nothing but the item; equal items are all reported; repeated rows are reported alike; empty tables
give an empty result; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut

Q, WINDOW, RATE, BAND = 8, 120, 0.08, 16
CHUNK_CHARS, BLOCK_CHARS, HITS = 1 << 20, 1 << 21, 1 << 18
HASH_BITS = 22
#: Beyond Unicode: what stands between texts, and between items.
TEXT_GAP, ITEM_GAP = (np.full(2 * BAND, x, dtype=np.uint32) for x in (0x110001, 0x110002))
_FOUND = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"
_ODD = 0x9E3779B97F4A7C15


def normal(text: str | None) -> np.ndarray:
    """The code points of a text as it is compared."""
    return np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def budget(length: int) -> tuple[int, int, int]:
    """(W, e, t) of an item."""
    w = min(length, WINDOW)
    e = max(0, min(int(w * RATE), (w - Q) // Q))
    return w, e, w + 1 - Q * (e + 1)


def _grams(x: np.ndarray) -> np.ndarray:
    """A number for the q-gram at every character: pairs, fours, then eights, modulo 2**64."""
    if len(x) < Q:
        return np.zeros(0, dtype=np.uint64)
    out, base = x.astype(np.uint64), _ODD
    for step in (1, 2, 4):
        out = out[:-step] * np.uint64(base) + out[step:]
        base = base * base % (1 << 64)
    return out * np.uint64(_ODD)


@dataclass
class Index:
    """The items of one pass, joined by gaps, and where each of their q-grams stands."""

    joined: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    plan: np.ndarray  # W, e, t of each item
    fresh: np.ndarray  # places where a window begins that is the first of its kind in its item
    grams: np.ndarray
    first: np.ndarray
    count: np.ndarray
    places: np.ndarray
    seen: np.ndarray
    short: dict[str, list[int]]  # items too short for q-grams


def _first_windows(joined: np.ndarray, starts: np.ndarray, sizes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Where windows begin that read like no earlier one of their item."""
    fresh = np.zeros(len(joined), dtype=bool)
    n = sizes - widths + 1
    at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
    item, w = np.repeat(np.arange(len(n)), n), np.repeat(widths, n)
    power = np.full(len(joined) + 1, _ODD, dtype=np.uint64)
    back = np.full(len(joined) + 1, pow(_ODD, -1, 1 << 64), dtype=np.uint64)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(joined.astype(np.uint64) * power[:-1], dtype=np.uint64)]
    value = (sums[at + w] - sums[at]) * back[at]
    order = np.lexsort((at, value, item))
    same = np.r_[False, (value[order][1:] == value[order][:-1]) & (item[order][1:] == item[order][:-1])]
    fresh[at[order[~same]]] = True
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))  # the first of each kind
    for lo in range(0, int(same.sum()), 4096):  # equal numbers are held against each other
        k = np.flatnonzero(same)[lo : lo + 4096]
        a, b, span = at[order[k]], at[order[head[k]]], np.arange(WINDOW)
        inside = span < w[order[k]][:, None]
        last = len(joined) - 1
        differ = ((joined[np.minimum(a[:, None] + span, last)] != joined[np.minimum(b[:, None] + span, last)]) & inside).any(axis=1)
        fresh[a[differ]] = True
    return fresh


def build(items: list[tuple[int | None, str | None]]) -> Index:
    known = {(i, " ".join(text.lower().split())) for i, text in items if i is not None and text is not None}
    short: dict[str, list[int]] = {}
    for i, text in sorted(known):
        if 0 < len(text) < Q + 4:
            short.setdefault(text, []).append(i)
    kept = [(i, normal(text)) for i, text in sorted(known) if len(text) >= Q + 4]
    sizes = np.array([len(x) for _, x in kept], dtype=np.int64)
    starts = np.cumsum(sizes + len(ITEM_GAP)) - sizes - len(ITEM_GAP)
    joined = np.concatenate([np.concatenate([x, ITEM_GAP]) for _, x in kept]) if kept else np.zeros(0, np.uint32)
    plan = np.array([budget(n) for n in sizes], dtype=np.int64).reshape(-1, 3)
    fresh = _first_windows(joined, starts, sizes, plan[:, 0]) if kept else np.zeros(0, dtype=bool)
    # A q-gram is kept if a first window holds it.
    opens = np.flatnonzero(fresh)
    width = plan[np.searchsorted(starts, opens, side="right") - 1, 0] if kept else opens
    delta = np.bincount(opens, minlength=len(joined) + 1) - np.bincount(opens + width - Q + 1, minlength=len(joined) + 1)
    grams = _grams(joined)
    places = np.flatnonzero(np.cumsum(delta)[: len(grams)] > 0)
    order = places[np.argsort(grams[places], kind="stable")]
    unique, first, count = np.unique(grams[order], return_index=True, return_counts=True)
    seen = np.zeros(1 << HASH_BITS, dtype=bool)
    seen[(unique >> np.uint64(64 - HASH_BITS)).astype(np.int64)] = True
    return Index(joined, np.array([i for i, _ in kept], dtype=np.int64), starts, sizes, plan, fresh, unique, first.astype(np.int32), count.astype(np.int32), order.astype(np.int32), seen, short)


def align(text: np.ndarray, base: np.ndarray, item: np.ndarray, at: np.ndarray, w: int, e: int) -> tuple[np.ndarray, np.ndarray]:
    """Edits of item[at:at+w] against the text along the diagonals base-e..base+e, ends free, and how far from base the end is.

    e + 1 edits mean too many. Equal windows are not aligned, and those whose whole band is over the
    budget are left aside every few rows.
    """
    out, off = np.full(len(base), e + 1, dtype=np.int16), np.zeros(len(base), dtype=np.int64)
    wide, top = 2 * e + 1, len(text) - 1
    if len(text) >= w:
        rows = np.lib.stride_tricks.sliding_window_view
        inside = np.minimum(np.maximum(base, 0), len(text) - w)
        out[(inside == base) & (rows(text, w)[inside] == rows(item, w)[at]).all(axis=1)] = 0
    alive = np.flatnonzero(out)
    if not len(alive):
        return out, off
    base, at = base[alive], at[alive]
    cost = np.zeros((wide, len(base)), dtype=np.int16)
    shift = np.arange(wide)[:, None] - e + base[None, :]
    for i in range(w):
        place = shift + i
        other = text[np.minimum(np.maximum(place, 0), top)]  # a gap stands at the end; before the start only a budget's worth can be off
        step = cost + (other != item[at + i])
        np.minimum(step[:-1], cost[1:] + 1, out=step[:-1])
        for c in range(1, wide):
            np.minimum(step[c], step[c - 1] + 1, out=step[c])
        cost = step
        if i % 8 == 7:
            keep = cost.min(axis=0) <= e
            if not keep.all():
                alive, at, cost, shift = alive[keep], at[keep], cost[:, keep], shift[:, keep]
                if not len(alive):
                    return out, off
    out[alive], off[alive] = np.minimum(cost.min(axis=0), e + 1), cost.argmin(axis=0) - e
    return out, off


def _stretches(index: Index, buffer: np.ndarray, hits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of shared q-grams (in the text, in the items) by stretches of text; each reaches a window into the next."""
    grams = _grams(buffer)
    at = np.flatnonzero(index.seen[(grams >> np.uint64(64 - HASH_BITS)).astype(np.int64)])
    k = np.minimum(np.searchsorted(index.grams, grams[at]), len(index.grams) - 1)
    same = index.grams[k] == grams[at]
    at, k = at[same], k[same]
    n = index.count[k].astype(np.int64)
    total = np.cumsum(n)
    reach = int((index.plan[:, 0] - Q + index.plan[:, 1]).max())
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] - n[lo] + hits, side="right")))
        far = int(np.searchsorted(at, at[hi - 1] + reach, side="right")) if hi < len(at) else hi
        part = n[lo:far]
        inner = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
        yield np.repeat(at[lo:far], part), index.places[np.repeat(index.first[k[lo:far]], part) + inner].astype(np.int64)
        lo = hi


def _candidates(index: Index, p: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of t shared q-grams of one item and band within a window: item, first and last hit in the text, in the item."""
    least = int(index.plan[:, 2].min())
    low = (p - j + len(index.joined)) // BAND
    per = np.bincount(low, minlength=1)
    two = per + np.r_[per[1:], 0]  # a band holds its own diagonals and the next ones
    out = []
    for back in (0, 1):
        band = low - back
        keep = (band >= 0) & (two[np.maximum(band, 0)] >= least)
        item = np.searchsorted(index.starts, j[keep], side="right") - 1
        out.append((band[keep], item, p[keep], j[keep]))
    band, item, p, j = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((p, item, band))
    band, item, p, j = band[order], item[order], p[order], j[order]
    w, e, t = index.plan[item].T
    last = np.arange(len(p)) + t - 1
    fits = last < len(p)
    end = np.where(fits, last, 0)
    if len(p):
        fits &= (band[end] == band) & (item[end] == item) & (p[end] - p <= w - Q + e)
    k, end = np.flatnonzero(fits), end[fits]
    return item[k], p[k], p[end], j[k] - index.starts[item[k]], j[end] - index.starts[item[k]]


def _verified(index: Index, text: np.ndarray, item: np.ndarray, p: np.ndarray, p2: np.ndarray, j: np.ndarray, j2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Item, start and end in the text, and edits of all windows within the budget that the runs allow, and of the runs that allow one."""
    w, _, _ = index.plan[item].T
    top = index.sizes[item] - w
    ends = np.clip(j2 + Q - w, 0, top), np.clip(j, 0, top)
    d = p - j
    _, one, line = np.unique(item * (1 << 40) + d + (1 << 32), return_index=True, return_inverse=True)

    # The windows of one item and diagonal are numbers in a row, those of the next one begin beyond; runs are intervals.
    span = int(index.sizes.max()) + 1
    early, late = line * span + np.minimum(*ends), line * span + np.maximum(*ends)
    order = np.argsort(early, kind="stable")
    reach = np.maximum.accumulate(late[order])
    opens = np.r_[True, early[order][1:] > reach[:-1]]
    first = early[order][opens]
    n = reach[np.r_[opens[1:], True]] - first + 1
    window = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    of, at = one[window // span], window % span
    first_of_kind = index.fresh[index.starts[item[of]] + at]
    window, of, at = window[first_of_kind], of[first_of_kind], at[first_of_kind]
    kind, begin, diagonal = item[of], index.starts[item[of]] + at, d[of] + at
    w, e, _ = index.plan[kind].T
    edits, off = e + 1, np.zeros(len(window), dtype=np.int64)
    plans = w * 1000 + e
    for value in np.unique(plans):
        rows = np.flatnonzero(plans == value)
        for lo in range(0, len(rows), 4096):
            c = rows[lo : lo + 4096]
            edits[c], off[c] = align(text, diagonal[c], index.joined, begin[c], int(value // 1000), int(value % 1000))
    good = np.flatnonzero(edits <= e)
    start = diagonal[good] + off[good]
    a, b = np.searchsorted(window[good], early), np.searchsorted(window[good], late, side="right")
    held = np.flatnonzero(b > a)
    far = np.full(len(held), 1 << 14)
    return np.r_[kind[good], item[held]], np.r_[start, p[held]], np.r_[start + w[good], p2[held] + Q], np.r_[edits[good], far]


def find(index: Index, texts: list[str | None], hits: int = HITS) -> list[list[tuple[int, int, int, int]]]:
    """(item_id, start, end, edits) of each leak of each text; places are characters of the normalised text."""
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    chunk: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def solve() -> None:
        buffer = np.concatenate([x for _, _, body in chunk for x in (body, TEXT_GAP)])
        starts, sizes = np.array([s for _, s, _ in chunk]), np.array([len(b) for _, _, b in chunk])
        leaks: dict[int, tuple[int, int, int]] = {}
        for p, j in _stretches(index, buffer, hits):
            runs = _candidates(index, p, j)
            inside = np.searchsorted(starts, runs[1], side="right") == np.searchsorted(starts, runs[2], side="right")  # a window's own hits are of one text
            runs = tuple(x[inside] for x in runs)
            if not len(runs[0]):
                continue
            item, begin, end, edits = _verified(index, buffer, *runs)
            doc = np.searchsorted(starts, (begin + end) // 2, side="right") - 1  # a window within the budget does not reach over a gap
            begin, end = np.maximum(begin, starts[doc]) - starts[doc], np.minimum(end, starts[doc] + sizes[doc]) - starts[doc]
            pair, back = np.unique(doc * len(index.ids) + item, return_inverse=True)
            lo, hi, best = np.full(len(pair), 1 << 60), np.zeros(len(pair), dtype=np.int64), np.full(len(pair), 1 << 14)
            np.minimum.at(lo, back, begin)
            np.maximum.at(hi, back, end)
            np.minimum.at(best, back, edits)
            for x, a, b, c in zip(pair.tolist(), lo.tolist(), hi.tolist(), best.tolist(), strict=True):
                known = leaks.get(x, (a, b, c))
                leaks[x] = (min(a, known[0]), max(b, known[1]), min(c, known[2]))
        for x, leak in leaks.items():
            found[chunk[x // len(index.ids)][0]].append((int(index.ids[x % len(index.ids)]), *leak))

    for number, text in enumerate(texts):
        body = normal(text)
        if len(body) < Q + 4 and index.short:
            found[number] += [(i, 0, len(body), 0) for i in index.short.get(" ".join((text or "").lower().split()), ())]
        if len(body) < Q or not len(index.ids):
            continue
        chunk.append((number, size, body))
        size += len(body) + len(TEXT_GAP)
        if size >= CHUNK_CHARS:
            solve()
            chunk, size = [], 0
    if chunk:
        solve()
    return [sorted(x) for x in found]


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items block by block, read from one partition after the other; always one block, the last may be empty."""
    held: list[tuple[int, str]] = []
    size = 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        if held and size + len(r["t"]) > chars:
            yield held
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += len(r["t"])
    yield held


def _scanner(held: Broadcast) -> Callable[..., Column]:
    @F.pandas_udf(_FOUND)
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(**held.value)
        for part in parts:
            yield pd.Series([[dict(zip(("item_id", "start", "end", "edits"), x, strict=True)) for x in row] for row in find(index, part.tolist())])

    return scan


def _passes(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str, chars: int) -> Iterator[tuple[DataFrame, Broadcast, bool]]:
    """``docs`` with the leaks of one block after the other as ``_fl_leaks``, the block's broadcast, and whether there is one block alone."""
    bounded_batches(docs.sparkSession)
    left = blocks(benchmark, item_id, item_text, chars)
    block, only = next(left), True
    while block is not None:
        after = next(left, None)
        only &= after is None
        held = docs.sparkSession.sparkContext.broadcast(build(block).__dict__)
        yield docs.withColumn("_fl_leaks", _scanner(held)(F.col(text))), held, only
        block = after


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits) for every leak."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_fl_text"))
    done = None
    for marked, held, only in _passes(rows, benchmark, "_fl_text", item_id, item_text, chars):
        part = marked.select("doc_id", F.explode("_fl_leaks").alias("l")).select("doc_id", "l.item_id", "l.start", "l.end", "l.edits")
        if only:
            return part
        part = cut(part)
        held.destroy()
        done = part if done is None else done.unionByName(part)
    return done


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that leak no item. With several blocks the leaking texts' hashes are joined away at the end."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    key = [F.xxhash64(F.col(text)), F.sha1(F.col(text).cast("binary"))]
    bad = None
    for marked, held, only in _passes(docs, benchmark, text, item_id, item_text, chars):
        if only:
            return marked.filter(F.size("_fl_leaks") == 0).select(*kept)
        part = cut(marked.filter(F.size("_fl_leaks") > 0).select(*[k.alias(f"_fl_k{i}") for i, k in enumerate(key)]).distinct())
        held.destroy()
        bad = part if bad is None else bad.unionByName(part)
    found = bad.distinct().withColumnsRenamed({"_fl_k0": "_fl_b0", "_fl_k1": "_fl_b1"})
    keyed = docs.withColumns({f"_fl_k{i}": k for i, k in enumerate(key)})
    return keyed.join(found, (F.col("_fl_k0") == F.col("_fl_b0")) & (F.col("_fl_k1") == F.col("_fl_b1")), "left_anti").select(*kept)
