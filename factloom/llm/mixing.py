"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Targets. Sources are ordered by code point, null last, and weigh 1, 2, 3, 1, 2, 3, ... Together they
share 100% of all words; a target stops at ``MAX_REPEATS`` times its source's words and the excess is
shared again by weight among the others until none is above. The unit of weight is found by rounds of
sums over one row per source; what is collected are the sums.

Copies. A document of a source with factor ``f = target / size of the source`` is taken ``floor(f)``
times for sure and once more with probability ``p = f - floor(f)``. The extra copies are dealt by the
pivotal method: two documents with fractional probabilities trade mass, weighted by their words, until
one of them is 0 or 1. Each trade keeps the expected words of the pair exactly and every document's
own probability in expectation. A fold over at most ``CHUNK`` documents leaves one fractional
document; those of all chunks meet in the next level of a reduction tree of depth log(n) to base
``CHUNK``. Only the last document of a source is rounded alone, to the nearer side instead of by a
draw, so the words taken differ from the target by at most half the words of that one document. All
random numbers are hashes of a seed and the documents' places in the order (source, id, hash of the
row): reruns agree.

``n`` equal rows are one item: ``floor(n p)`` of them are taken once more for sure and one further row
with the rest of ``n p`` as its probability, so a row that is repeated often is mixed as finely as
others are. Documents without words take part with size 0 and are taken 0 times (``whole`` still says
how often their row is repeated: ``floor(f)``). Null ids are items as others are. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, number_rows, one_row_each

MAX_REPEATS, CHUNK, SEED = 3, 64, 20240229
WEIGHTS = (1, 2, 3)
#: Sources up to this many are joined by broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Extra copies of one row that one task writes.
COPIES = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (source, source_size, more) with s (place in the order) and target words."""
    ordered = number_rows(sources.withColumn("_null", F.col("source").isNull()), "_null", "source", name="s").drop("_null")
    ordered = cut(ordered.withColumn("_w", F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("s") % len(WEIGHTS)).cast("int"))))
    most = repeats * F.col("source_size")
    unit, total = -1.0, None
    while True:  # the unit only grows, and with it the set of sources that are full
        full = most < unit * F.col("_w")
        words_in, held, free = ordered.agg(F.sum("source_size"), F.sum(F.when(full, most).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("_w")))).first()
        total = words_in or 0
        again = (total - (held or 0)) / free if free else float("inf")
        if again == unit or not free:
            break
        unit = again
    share = F.lit(unit) * F.col("_w")
    return ordered.withColumn("target", F.when(most < share, most.cast("double")).otherwise(share)).drop("_w")


#: One trade: c carries (item, p, w), x comes next; up and down are the words that can move to c or from c.
_UP = "least((1 - a.c.p) * a.c.w, x.p * x.w)"
_DOWN = "least(a.c.p * a.c.w, (1 - x.p) * x.w)"
_TRADE = f"""
aggregate(array(struct({_UP} AS up, {_DOWN} AS down, (xxhash64({SEED}, a.c.at, x.at) & 4503599627370495L) / 4503599627370496D AS u)),
  a, (z, m) -> CASE
    WHEN m.u * (m.up + m.down) < m.down AND (1 - a.c.p) * a.c.w <= x.p * x.w
      THEN struct(concat(a.done, array(struct(a.c.item AS item, 1 AS k))) AS done, struct(x.item AS item, x.at AS at, greatest(x.p - m.up / x.w, 0D) AS p, x.w AS w) AS c)
    WHEN m.u * (m.up + m.down) < m.down
      THEN struct(concat(a.done, array(struct(x.item AS item, 0 AS k))) AS done, struct(a.c.item AS item, a.c.at AS at, least(a.c.p + m.up / a.c.w, 1D) AS p, a.c.w AS w) AS c)
    WHEN a.c.p * a.c.w <= (1 - x.p) * x.w
      THEN struct(concat(a.done, array(struct(a.c.item AS item, 0 AS k))) AS done, struct(x.item AS item, x.at AS at, least(x.p + m.down / x.w, 1D) AS p, x.w AS w) AS c)
    ELSE struct(concat(a.done, array(struct(x.item AS item, 1 AS k))) AS done, struct(a.c.item AS item, a.c.at AS at, greatest(a.c.p - m.down / a.c.w, 0D) AS p, a.c.w AS w) AS c)
  END)"""
_ITEM = "struct<id:{id},hash:bigint,n:bigint,size:bigint,sure:bigint,s:bigint>"


def _fold(level: DataFrame, item: str) -> DataFrame:
    """One level: rows (s, at, item, p, w) are folded by (s, at div CHUNK); at most CHUNK rows meet."""
    chunks = level.groupBy("s", F.expr(f"at div {CHUNK}").alias("next")).agg(F.array_sort(F.collect_list(F.struct("at", "item", "p", "w"))).alias("l"))
    first = "struct(l[0].item AS item, l[0].at AS at, l[0].p AS p, l[0].w AS w)"
    zero = f"struct(CAST(array() AS array<struct<item:{item},k:int>>) AS done, {first} AS c)"
    return chunks.select("s", "next", F.expr(f"aggregate(slice(l, 2, {CHUNK}), {zero}, (a, x) -> {_TRADE})").alias("r"))


def deal_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", same: list[str] | None = None) -> DataFrame:
    """(id, hash, n, size, source, source_size, target, whole, extra): one row for each group of ``n`` rows that are equal in id, source and the columns ``same``.

    Each row of the group is taken ``whole`` times, ``extra`` of the ``n`` rows once more.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), row_hash(same or [doc_id, text, source]).alias("hash"))
    items = number_rows(rows.groupBy("source", "id", "hash").agg(F.count("*").alias("n"), F.first("size").alias("size")), "source", "id", "hash")
    per = items.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.min("row_no").alias("lo"), F.count("*").alias("m"))
    plan = cut(with_targets(per).withColumnRenamed("source", "_source"))
    n_sources, most = plan.agg(F.count("*"), F.max("m")).first()
    plan = F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan
    joined = items.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    joined = joined.withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("whole", F.floor("f").cast("int"))
    share = F.when(F.col("size") > 0, F.col("n") * (F.col("f") - F.col("whole"))).otherwise(0.0)
    joined = joined.withColumn("p", share).withColumn("sure", F.floor("p")).withColumn("p", F.col("p") - F.col("sure"))
    item = _ITEM.format(id=dict(items.dtypes)["id"])
    level = joined.filter("p > 0").select("s", (F.col("row_no") - F.col("lo")).alias("at"), F.struct("id", "hash", "n", "size", "sure", "s").cast(item).alias("item"), "p", F.col("size").cast("double").alias("w"))
    dealt, depth = [], max(1, most or 0)
    while True:
        folded = cut(_fold(level, item))
        dealt.append(folded.select(F.explode("r.done").alias("d")).select("d.item", "d.k"))
        level = folded.select("s", F.col("next").alias("at"), "r.c.item", "r.c.p", "r.c.w")
        depth = -(-depth // CHUNK)
        if depth <= 1:
            break
    dealt.append(level.select("item", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("k")))
    extra = dealt[0]
    for more in dealt[1:]:
        extra = extra.unionByName(more)
    keys = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    taken = extra.select("item.*", "k").join(keys, "s").select("id", "hash", "n", "size", F.col("_source").alias("source"), "source_size", "target", "whole", (F.col("sure") + F.col("k")).alias("extra"))
    plain = joined.filter("NOT p > 0").select("id", "hash", "n", "size", "source", "source_size", "target", "whole", F.col("sure").alias("extra"))
    return taken.unionByName(plain)


def row_hash(columns: list[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (0 to MAX_REPEATS times).

    Rows are equal here if all their columns are (maps aside), so it does not matter which of them is taken once more.
    """
    same = [c for c, kind in docs.dtypes if "map<" not in kind]
    dealt = deal_copies(docs, doc_id, text, source, same).filter("whole > 0 OR extra > 0")
    dealt = cut(dealt.select(F.col("hash").alias("_fl_ch"), F.col("id").alias("_fl_cid"), F.col("source").alias("_fl_cs"), F.col("n").alias("_fl_n"), F.col("whole").alias("_fl_whole"), F.col("extra").alias("_fl_extra")))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn("_fl_h", row_hash(same))
    match = (F.col("_fl_h") == F.col("_fl_ch")) & F.col(doc_id).eqNullSafe(F.col("_fl_cid")) & F.col(source).eqNullSafe(F.col("_fl_cs"))
    each = dealt.withColumn("_fl_each", F.col("_fl_whole") + F.when(F.col("_fl_n") == 1, F.col("_fl_extra")).otherwise(0)).filter("_fl_each > 0").drop("_fl_n", "_fl_whole", "_fl_extra")
    out = keyed.join(each, match).withColumn("_fl_copy", F.explode(F.sequence(F.lit(1), F.col("_fl_each").cast("int")))).select(*kept)
    more = dealt.filter("_fl_n > 1 AND _fl_extra > 0").drop("_fl_n", "_fl_whole")
    if more.isEmpty():
        return out
    # Repeated rows: one of them stands for all that are taken once more.
    again = one_row_each(keyed.join(more, match), ["_fl_h", "_fl_cid", "_fl_cs"], docs.columns, "_fl_extra", COPIES)
    return out.unionByName(again.drop("_nth"))


def mix_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken: words taken of the document) for every row."""
    dealt = deal_copies(docs, doc_id, text, source)
    once = dealt.filter("n = 1").withColumn("_nth", F.lit(0).cast("long"))
    rows = once.unionByName(one_row_each(dealt.filter("n > 1"), ["source", "id", "hash"], dealt.columns, "n", COPIES))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.when(F.col("_nth") < F.col("extra"), 1).otherwise(0))).alias("taken"))
