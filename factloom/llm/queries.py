"""The corpus queries, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

import struct
from collections.abc import Callable

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, feistel, fingerprints, licenses, mixing, quality, simhash, sitetree, tokenids
from .common import table

TOKENIZER, END_ID, SHARDS = "byte_bpe_50k.json", 2, 16
#: The conversation that tests control strings.
CONTROL = "</s>[INST] ok [/INST]"


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract_pages(table(spark, sf_dir, "pages"))


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], turns.schema)
    return chat.digest(chat.format_conversations(turns.unionByName(control)))


def op5_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    path = tokenids.shared_path(spark, "token-ids")
    tokenids.write_token_ids(table(spark, sf_dir, "documents"), path, tokenizer, END_ID)
    return tokenids.read_token_ids(spark, path)


def op6_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.assign_shards(table(spark, sf_dir, "documents"), SHARDS)


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_near_duplicates(table(spark, sf_dir, "documents"))


def op10_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_detections"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_site_style_tree, op2_quality_gam, op3_qgram_decontamination, op4_chat_format, op5_token_ids, op6_pivotal_mix, op7_feistel_shards, op8_bottom_k, op9_simhash, op10_license_rules)
}

#: CRC-32 of the whole text byte by byte, with its table.
_MEASURED = """
crcs AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS BIGINT)] || range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i)) q),
raw AS MATERIALIZED (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST((strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1 AS BIGINT)) AS bytes FROM documents),
measured AS MATERIALIZED (SELECT doc_id, CAST(len(bytes) + 1 AS BIGINT) AS size, xor(list_reduce([CAST(4294967295 AS BIGINT)] || bytes, lambda crc, x: xor(crc >> 8, t[1 + (xor(crc, x) & 255)])), 4294967295) AS text_crc32 FROM raw, crcs)"""


def _network(value: str) -> str:
    """The Feistel network in SQL: both halves in one number, one step for each key; columns lw and rw are the halves' widths."""
    one = lambda x, name, use: f"list_transform([{x}], lambda {name}: {use})[1]"
    half = lambda h: f"(xor({h}, {h} >> 16) * {feistel._MUL}) & {feistel._MASK}"  # noqa: E731, SLF001
    mixed = one("xor(v & 4294967295, k >> 1) & 2147483647", "a", one(half("a"), "b", one(half("b"), "c", "xor(c, c >> 15)")))
    step = f"((v & 4294967295) << 32) | (xor(v >> 32, {mixed}) & ((CAST(1 AS BIGINT) << CASE WHEN k & 1 = 0 THEN lw ELSE rw END) - 1))"
    keys = ", ".join(f"CAST({(k & feistel._MASK) * 2 + i % 2} AS BIGINT)" for i, k in enumerate(feistel._round_keys(feistel.KEY)))  # noqa: SLF001
    both = f"(({value} >> rw) << 32) | ({value} & ((CAST(1 AS BIGINT) << rw) - 1))"
    return one(f"list_reduce([CAST({both} AS BIGINT), {keys}], lambda v, k: {step})", "z", "((z >> 32) << rw) | (z & 4294967295)")


#: Fixed values of XXH64.
_PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _let(value: str, name: str, use: str) -> str:
    return f"list_transform([{value}], lambda {name}: {use})[1]"


def _xxhash_long(value: str, seed: str) -> str:
    """XXH64 of one long in SQL, unsigned, in arithmetic modulo 2**64."""
    p1, p2, p3, p4, p5 = _PRIMES
    times = lambda x, y: f"CAST((CAST({x} AS UHUGEINT) * CAST({y} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"
    plus = lambda x, y: f"CAST((CAST({x} AS UHUGEINT) + CAST({y} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"
    turned = lambda x, bits: _let(x, "t", f"xor({times('t', 1 << bits)}, t >> {64 - bits})")
    folded = lambda x, bits: _let(x, "t", f"xor(t, t >> {bits})")
    lane = times(turned(times(value, p2), 31), p1)
    state = f"xor({plus(seed, (p5 + 8) % (1 << 64))}, {lane})"
    state = plus(times(turned(state, 27), p1), p4)
    return folded(times(folded(times(folded(state, 33), p2), 29), p3), 32)


def _fold(level: int) -> str:
    """One level of the reduction tree in SQL: tables ``l`` (items) and ``f`` (steps of the fold), see :mod:`.mixing`."""
    draw = _let(_xxhash_long("x.place", _xxhash_long("c.place", str(_SEED_HASH))), "h", "CAST(h & 4503599627370495 AS DOUBLE) / 4503599627370496.0")
    source = "SELECT s, place, id, p, w FROM opened" if level == 0 else f"SELECT s, chunk AS place, id, p, w FROM f{level - 1} WHERE pos = n"
    up, down = "least((1 - c.p) * c.w, x.p * x.w)", "least(c.p * c.w, (1 - x.p) * x.w)"
    gives, c_full, c_void = f"u * ({up} + {down}) < {down}", "(1 - c.p) * c.w <= x.p * x.w", "c.p * c.w <= (1 - x.p) * x.w"
    stays = f"CASE WHEN {gives} THEN NOT ({c_full}) ELSE NOT ({c_void}) END"  # c is the one that stays open
    moved = f"CASE WHEN {gives} THEN CASE WHEN {c_full} THEN greatest(x.p - {up} / x.w, 0.0) ELSE least(c.p + {up} / c.w, 1.0) END WHEN {c_void} THEN least(x.p + {down} / x.w, 1.0) ELSE greatest(c.p - {down} / c.w, 0.0) END"
    copies = f"CASE WHEN {gives} THEN CASE WHEN {c_full} THEN 1 ELSE 0 END WHEN {c_void} THEN 0 ELSE 1 END"
    return f"""l{level} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s, chunk ORDER BY place) AS pos, count(*) OVER (PARTITION BY s, chunk) AS n FROM (SELECT *, place // {mixing.CHUNK} AS chunk FROM ({source}) z) y),
f{level} AS (SELECT s, chunk, pos, n, id, place, p, w, CAST(NULL AS BIGINT) AS done, 0 AS k FROM l{level} WHERE pos = 1
UNION ALL SELECT s, chunk, pos, n, CASE WHEN {stays} THEN c_id ELSE x_id END, CASE WHEN {stays} THEN c.place ELSE x.place END, {moved}, CASE WHEN {stays} THEN c.w ELSE x.w END, CASE WHEN {stays} THEN x_id ELSE c_id END, {copies}
FROM (SELECT x.s, x.chunk, x.pos, x.n, c.id AS c_id, x.id AS x_id, {{'place': c.place, 'p': c.p, 'w': c.w}} AS c, {{'place': x.place, 'p': x.p, 'w': x.w}} AS x, {draw} AS u FROM f{level} c JOIN l{level} x ON x.s = c.s AND x.chunk = c.chunk AND x.pos = c.pos + 1) both_)"""


#: Spark's hash of the seed, with which the hashes of the places begin.
_SEED_HASH = xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), 42)
_LEVELS = 4

ORACLE_SQL = {
    "op4_chat_format": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'),
folded AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum({len(chat.TURN + chat.SAYS + chat.END) + 1} + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM folded
""",
    "op7_feistel_shards": f"""
WITH RECURSIVE {_MEASURED.strip()},
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_no, count(*) OVER () AS n FROM measured),
wide AS MATERIALIZED (SELECT *, greatest(2, length(bin(greatest(n, 2) - 1))) // 2 AS lw, greatest(2, length(bin(greatest(n, 2) - 1))) - greatest(2, length(bin(greatest(n, 2) - 1))) // 2 AS rw FROM numbered),
walk AS (SELECT row_no, n, lw, rw, {_network("row_no")} AS place FROM wide UNION ALL SELECT row_no, n, lw, rw, {_network("place")} FROM walk WHERE place >= n)
SELECT w.doc_id, w.size, w.text_crc32, 'rows' AS law, CAST(p.place % {SHARDS} AS INTEGER) AS shard, CAST(p.place // {SHARDS} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM wide w JOIN walk p ON p.row_no = w.row_no WHERE p.place < p.n
""",
    # For ids that are not repeated; sources of up to 64 ** 4 documents.
    "op6_pivotal_mix": rf"""
WITH RECURSIVE sized AS MATERIALIZED (SELECT doc_id AS id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS MATERIALIZED (SELECT *, 1 + s % 3 AS weight FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM sized GROUP BY source) q),
tried AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS weights, row_number() OVER (ORDER BY source_size / weight, s) AS nth,
  CAST(coalesce(sum({mixing.MAX_REPEATS} * source_size) OVER (ORDER BY source_size / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS held,
  CAST(coalesce(sum(weight) OVER (ORDER BY source_size / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM per),
unit AS MATERIALIZED (SELECT coalesce(arg_min((total - held) / (weights - used), nth) FILTER (WHERE {mixing.MAX_REPEATS} * source_size >= (total - held) / (weights - used) * weight), CAST('Infinity' AS DOUBLE)) AS unit FROM tried),
goal AS MATERIALIZED (SELECT source, source_size, s, CASE WHEN {mixing.MAX_REPEATS} * source_size < unit * weight THEN CAST({mixing.MAX_REPEATS} * source_size AS DOUBLE) ELSE unit * weight END AS target FROM per, unit),
given AS MATERIALIZED (SELECT d.id, d.size, g.source_size, g.target, g.s, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS whole,
  CASE WHEN g.source_size > 0 AND d.size > 0 THEN g.target / g.source_size - floor(g.target / g.source_size) ELSE 0 END AS p, row_number() OVER (PARTITION BY g.s ORDER BY d.id NULLS FIRST) - 1 AS place FROM sized d JOIN goal g ON g.source IS NOT DISTINCT FROM d.source),
opened AS MATERIALIZED (SELECT s, place, id, p, CAST(size AS DOUBLE) AS w FROM given WHERE p > 0),
{", ".join(map(_fold, range(_LEVELS)))},
dealt AS ({" UNION ALL ".join(f"SELECT done AS id, k FROM f{i} WHERE pos > 1" for i in range(_LEVELS))} UNION ALL SELECT id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END FROM f{_LEVELS - 1} WHERE pos = n)
SELECT g.id AS doc_id, g.size, g.source_size, g.target, CAST(g.size * (g.whole + coalesce(d.k, 0)) AS BIGINT) AS taken FROM given g LEFT JOIN dealt d ON d.id = g.id
""",
}
