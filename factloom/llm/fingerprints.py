"""Document fingerprints: bottom-k sketches of word-shingle hashes. DataFrame functions only.

Words are runs of anything but space and \\t..\\r, shingles are five words (fewer words: the whole
sequence once, no words: none), hashed to 64 bits. The sketch is the sorted array of the ``K``
smallest distinct hashes. Sketches of parts merge into the sketch of the whole
(:func:`merge_sketches`), and two of them estimate

* resemblance: the share of the K smallest hashes of the union that both hold (two empty sketches:
  1, one empty: 0; equal texts: 1),
* containment of the first in the second: resemblance * |union| / |first|,
* the number of distinct shingles: exact below K, else (K - 1) / the K-th smallest as a share of the
  hash range.

The neighbours of a document are found in buckets of the id order: quantiles of the ids cut them
into buckets of about ``BUCKET_ROWS`` rows, each bucket also gets the first row of the next one, and
a window inside the bucket pairs each row with the next. Texts are exchanged once, by bucket. An id
(or null) that more than one quantile falls on is cut again by the hash of the text, and a text that
repeats under such an id by the places where its rows are read. Above ``MOST_BUCKETS`` times
``BUCKET_ROWS`` rows the buckets grow; a window sorts and spills, so that costs time only.

Defined cases: null texts count as empty; null ids come last; ties in the order are broken by a hash
of the text (inside a hot id the texts that repeat often come after others of their part), equal rows
are in any order; a single document follows itself; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, SHINGLE = 128, 5
BUCKET_ROWS, MOST_BUCKETS = 1024, 1 << 18


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(text: Column, k: int = K) -> Column:
    """The bottom-k sketch of a text, an array of longs."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def smallest(h: Column) -> Column:
        """Of the words' hashes."""
        last = F.size(h) - F.lit(SHINGLE)
        many = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
        few = F.array(F.xxhash64(F.array_join(h, " ")))
        return F.when(last >= 0, many).when(F.size(h) > 0, few).otherwise(F.expr("CAST(array() AS array<bigint>)"))

    hashes = bind(F.transform(words, lambda w: F.xxhash64(w)), smallest)
    return F.slice(F.array_distinct(F.sort_array(hashes)), 1, k)


def merge_sketches(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    share = bind(merge_sketches(a, b, k), lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    rank = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / rank)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Of the shingles of a, the share that b has."""
    share = resemblance(a, b, k) * distinct_shingles(merge_sketches(a, b, k), k) / F.greatest(distinct_shingles(a, k), F.lit(1.0))
    return F.least(share, F.lit(1.0))


def fingerprint(a: Column) -> Column:
    """A sketch as hex digits, 16 for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _bucket(bounds: list[int], value: Column) -> Column:
    """How many bounds are below ``value``: three levels of at most cube root of their number, so a row costs few comparisons."""
    if not bounds:
        return F.lit(0)
    fan = max(2, math.ceil(len(bounds) ** (1 / 3)))

    fine = [bounds[i : i + fan] for i in range(0, len(bounds), fan)]
    middle = [fine[i : i + fan] for i in range(0, len(fine), fan)]
    lists = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # noqa: E731  folded to one constant
    heads = lists([m[0][0] for m in middle], "array<bigint>")
    mid_heads = lists([[f[0] for f in m] for m in middle], "array<array<bigint>>")
    leaves = lists(fine, "array<array<bigint>>")
    under = lambda array: F.size(F.filter(array, lambda x: x < value))
    top = F.greatest(under(heads) - 1, F.lit(0))
    mid = F.greatest(under(F.get(mid_heads, top)) - 1, F.lit(0)) + top * fan
    return under(F.get(leaves, mid)) + mid * fan


_BUCKET = ("b1", "b2", "b3")


def _placed(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """``rows`` (doc_id, text, h) with their bucket: b1 by the quantiles of the ids, b2 and b3 inside hot ids, -1 for null ids."""
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    m = min(MOST_BUCKETS, n // bucket_rows)
    cuts = rows.agg(F.percentile_approx("doc_id", [(i + 1) / (m + 1) for i in range(m)], max(10_000, 4 * m))).first()[0] if m and nulls < n else None
    met = Counter(cuts or [])
    by_id = F.when(F.col("doc_id").isNull(), -1).otherwise(_bucket(sorted(met), F.col("doc_id"))).cast("int")
    # A hot id is the largest of its bucket, so its parts come before the bucket's other rows.
    placed = rows.withColumns({"b1": by_id, "b2": F.lit(1 << 30), "b3": F.lit(0)})
    hot = [(i, c + 1) for i, c in met.items() if c > 1] + [(None, nulls // bucket_rows + 1)] * (nulls > bucket_rows)
    if not hot:
        return placed
    spark = rows.sparkSession
    hot_ids = F.broadcast(spark.createDataFrame(hot, "_id long, _parts int"))  # at most half as many as buckets
    share = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    part = F.least(F.floor(share * F.col("_parts")), F.col("_parts") - 1).cast("int")
    placed = placed.join(hot_ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("b2", F.coalesce(part, F.col("b2")))
    texts = placed.filter("_parts IS NOT NULL").groupBy(F.col("doc_id").alias("_tid"), F.col("h").alias("_th")).agg(F.count("*").alias("_n")).filter(F.col("_n") > bucket_rows)
    texts = F.broadcast(cut(texts.withColumn("_more", F.ceil(F.col("_n") / bucket_rows))))  # one row for more than a bucket of rows
    same = F.col("doc_id").eqNullSafe(F.col("_tid")) & (F.col("h") == F.col("_th"))
    placed = placed.join(texts, same, "left").withColumn("b3", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_more")).cast("int") + 1, F.col("b3")))
    return placed.drop("_id", "_parts", "_tid", "_th", "_n", "_more")


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, next_text, sketch, next_sketch): the next document is that of the next smaller id, after the last the first."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    placed = _placed(rows, bucket_rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), F.bitwise_not("doc_id").alias("down"), "h"))
    heads = placed.groupBy(*_BUCKET).agg(first.alias("f")).collect()  # one row for each bucket
    order = sorted(heads, key=lambda r: (-r["b1"], r["b2"], r["b3"]))
    after = [(*r[:3], None if (f := order[(i + 1) % len(order)]["f"])["null"] else ~f["down"], f["h"]) for i, r in enumerate(order)]
    firsts = F.broadcast(spark.createDataFrame(after, "b1 int, b2 int, b3 int, _id long, _h long"))
    heads_df = rows.join(firsts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    extra = heads_df.groupBy(*_BUCKET).agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "h")]).withColumn("guest", F.lit(True))
    both = placed.withColumn("guest", F.lit(False)).unionByName(extra).repartition(*_BUCKET)
    both = both.withColumn("sketch", sketch(F.col("text")))
    w = Window.partitionBy(*_BUCKET).orderBy(F.col("guest"), F.col("doc_id").desc_nulls_last(), "h")
    paired = both.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sketch", F.lead("sketch").over(w))
    return paired.filter("NOT guest").select("doc_id", "text", "next_text", "sketch", "next_sketch")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n / 2) code points of ``text`` replaced by the first as many (or all) of ``following``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are to the edited and the next text's."""
    rows = with_next(docs, doc_id, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    s, e, x = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(s).alias("fingerprint"), fingerprint(e).alias("edited_fingerprint"), resemblance(s, e).alias("near_edited"), resemblance(s, x).alias("near_next"),
        distinct_shingles(s).alias("distinct_shingles"), containment(s, e).alias("contained_in_edited"),
    )
