"""Sharding by a keyed Feistel permutation of global row numbers, with cycle walking. DataFrame functions only.

Rows are numbered from 0 in the order of (doc_id, CRC-32 of the text, size). A Feistel network over
the smallest power of two that holds the row count permutes the numbers; a value outside the count
walks on through the network until it is inside, so the result is a permutation of exactly the rows.
Place ``p`` gives shard ``p % shards`` and slot ``p // shards``: shards differ by one row at most
(law ``rows``), slots are gapless from 0, and both can be computed from a row number, the count and
the key alone (:func:`place_of`; :func:`row_of` is the inverse).

Defined cases: null texts count as empty; equal rows get different places; null ids sort first; an
empty table gives an empty result; extra columns are ignored by :func:`assign_shards` and kept by
:func:`shard_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, number_rows, one_row_each

ROUNDS, KEY = 6, 0x5DEECE66D
#: A walk leaves the count with a chance below 1/2 at each step; one longer than this raises an error.
WALK = 72


def widths(rows: int) -> tuple[int, int]:
    """Bits of the left and the right half."""
    bits = max(2, (max(rows, 1) - 1).bit_length())
    return bits // 2, bits - bits // 2


def _round_keys(key: int) -> list[int]:
    out, state = [], key & 0xFFFFFFFF
    for _ in range(ROUNDS):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append(state)
    return out


_MUL, _MASK = 0x45D9F3B, 0x7FFFFFFF


def _mix(value: int, key: int) -> int:
    """The round function: 31-bit multiply and shift steps, the same in SQL."""
    x = (value ^ key) & _MASK
    for _ in range(2):
        x = ((x ^ (x >> 16)) * _MUL) & _MASK
    return x ^ (x >> 15)


def _network(value: int, rows: int, key: int, back: bool = False) -> int:
    lw, rw = widths(rows)
    keys = _round_keys(key)
    left, right = value >> rw, value & ((1 << rw) - 1)
    # The halves swap at each round, and with them their widths.
    for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
        mask = (1 << (lw if k % 2 == 0 else rw)) - 1
        if back:
            left, right = (right ^ _mix(left, keys[k])) & mask, left
        else:
            left, right = right, (left ^ _mix(right, keys[k])) & mask
    return (left << rw) | right


def place_of(row: int, rows: int, key: int = KEY) -> int:
    value = _network(row, rows, key)
    while value >= rows:
        value = _network(value, rows, key)
    return value


def row_of(place: int, rows: int, key: int = KEY) -> int:
    value = _network(place, rows, key, back=True)
    while value >= rows:
        value = _network(value, rows, key, back=True)
    return value


def _network_sql(x: str, rows: int, key: int) -> str:
    lw, rw = widths(rows)
    steps = ",".join(f"struct({k & _MASK}L AS k, {(1 << (lw if i % 2 == 0 else rw)) - 1}L AS m)" for i, k in enumerate(_round_keys(key)))
    half = f"(((h ^ shiftright(h, 16)) * {_MUL}L) & {_MASK}L)"
    mixed = f"aggregate(array(1, 2), (s.r ^ q.k) & {_MASK}L, (h, unused) -> {half}, h -> h ^ shiftright(h, 15))"
    return f"aggregate(array({steps}), struct(shiftright({x}, {rw}) AS l, {x} & {(1 << rw) - 1}L AS r), (s, q) -> struct(s.r AS l, (s.l ^ {mixed}) & q.m AS r), s -> shiftleft(s.l, {rw}) | s.r)"


def place(row: str, rows: int, key: int = KEY) -> Column:
    """The place of the row number in column ``row``, as a column."""
    first = _network_sql(row, rows, key)
    walk = f"aggregate(sequence(1, {WALK}), {first}, (v, i) -> CASE WHEN v < {rows}L THEN v ELSE {_network_sql('v', rows, key)} END)"
    return F.expr(f"aggregate(array({walk}), 0L, (z, w) -> CASE WHEN w < {rows}L THEN w ELSE CAST(raise_error('cycle walk too long') AS BIGINT) END)")


def _measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))


def assign_shards(docs: DataFrame, shards: int = 16, key: int = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    numbered = number_rows(_measured(docs, doc_id, text), "doc_id", "text_crc32", "size", split_ties=True)
    rows = numbered.count()
    at = numbered.withColumn("_place", place("row_no", rows, key)) if rows else numbered.withColumn("_place", F.col("row_no"))
    return at.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_place") % shards).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def shard_rows(docs: DataFrame, shards: int = 16, key: int = KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (columns of these names are replaced).

    Numbers are given to narrow rows (id, CRC-32, size and a hash of all columns but maps) and go back to
    the texts in one join. Equal rows have numbers in a row; one of them stands for all.
    """
    same = [c for c, kind in docs.dtypes if "map<" not in kind]
    raw = F.coalesce(F.col(text), F.lit(""))
    marks = {"_fl_id": F.col(doc_id), "_fl_crc": F.crc32(raw.cast("binary")), "_fl_size": (F.octet_length(raw) + 1).cast("long"), "_fl_all": F.xxhash64(*[F.col(f"`{c}`") for c in same])}
    numbered = number_rows(docs.select(*[v.alias(k) for k, v in marks.items()]), *marks, name="_fl_row", split_ties=True)
    rows = numbered.count()
    groups = cut(numbered.groupBy(*marks).agg(F.min("_fl_row").alias("_fl_row"), F.count("*").alias("_fl_n")))
    named = groups.withColumnsRenamed({k: f"{k}_" for k in marks})
    found = docs.withColumns(marks).join(named, F.col("_fl_id").eqNullSafe(F.col("_fl_id_")) & (F.col("_fl_crc") == F.col("_fl_crc_")) & (F.col("_fl_size") == F.col("_fl_size_")) & (F.col("_fl_all") == F.col("_fl_all_")))
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    out = found.filter("_fl_n = 1").select(*[F.col(f"`{c}`") for c in kept], "_fl_row")
    if not groups.filter("_fl_n > 1").isEmpty():
        again = one_row_each(found.filter("_fl_n > 1"), list(marks), [*kept, "_fl_row"], "_fl_n")
        out = out.unionByName(again.withColumn("_fl_row", F.col("_fl_row") + F.col("_nth")).drop("_nth"))
    at = out.withColumn("_fl_place", place("_fl_row", rows, key) if rows else F.col("_fl_row"))
    return at.select(*[F.col(f"`{c}`") for c in kept], (F.col("_fl_place") % shards).cast("int").alias("shard"), F.expr(f"_fl_place div {shards}").alias("slot"))
