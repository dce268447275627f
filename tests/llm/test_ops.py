"""The corpus operators against brute force, and their defined cases: nulls, empties, repeats, clashing columns."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from factloom.llm import chat, decontaminate, feistel, fingerprints, licenses, quality, queries, simhash, sitetree, tokenids
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, _h string, fingerprint int, component_id int, size int"
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a"), (2, "The quick brown fox jumps over the lazy dog again and again.", "en", "b"), (3, None, None, None), (4, "", "en", "a"),
    (5, " \n\t ", "en", None), (None, "no id here at all", "en", "b"), (6, "word", "en", "a"), (6, "word", "en", "a"), (7, "x " * 30000, "en", "c"), (8, "é ü <|end|> </s>", "fr", "é"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "s", "h", 1, 2, 3) for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_simhash_equals_brute_force(docs):
    rows = docs.toPandas()
    fps = np.array([simhash.fingerprint(t.encode()) for t in rows.text], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = rows.doc_id.to_numpy().copy()
    while True:
        low = np.array([label[n].min() for n in near])
        if (low == label).all():
            break
        label = low
    got = simhash.group_near_duplicates(docs, tile=3).toPandas().set_index("doc_id")
    assert (got.component_id[rows.doc_id].to_numpy() == label).all()
    assert list(got.fingerprint[rows.doc_id]) == [f"{int(x):016x}" for x in fps]


def test_simhash_links_a_dense_group_through_tiles(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    fps = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, tile=40)).collect()}
    a = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    label = np.arange(len(a))
    for _ in range(300):
        label = np.array([label[n].min() for n in near])
    groups = {}
    for s, k in zip(signed, label, strict=True):
        groups.setdefault(k, set()).add(root.get(s, s))
    assert all(len(v) == 1 for v in groups.values())
    assert len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_simhash_odd_rows(odd):
    got = [(r["doc_id"], r["component_id"]) for r in simhash.group_near_duplicates(odd).collect()]
    assert len(got) == len(ODD)
    assert {c for d, c in got if d in (3, 4, 5)} == {3}
    assert {c for d, c in got if d in (1, 2)} == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 2 not in ids and ids.count(6) == 1 and 1 in ids


def test_simhash_keeps_one_of_each_group(spark):
    rng = random.Random(3)
    long = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300))
    a, b, c = long(), long(), long()
    near = next(f"{c[:k]}#{c[k + 1:]}" for k in range(5, 2000) if c[k] != " " and 0 < (simhash.fingerprint(c.encode()) ^ simhash.fingerprint(f"{c[:k]}#{c[k + 1:]}".encode())).bit_count() <= 3)
    rows = [(1, a), (1, b), (2, a), (3, b), (None, c), (None, near)]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(x for x in kept if x[0] is not None) == sorted([(1, a), (1, b)])
    assert len(kept) == 3 and kept.count((None, c)) + kept.count((None, near)) == 1


def test_feistel_is_a_permutation(spark, odd):
    for n in (1, 2, 3, 17, 1000):
        places = [feistel.place_of(i, n) for i in range(n)]
        assert sorted(places) == list(range(n))
        assert all(feistel.row_of(p, n) == i for i, p in enumerate(places))
    got = spark.range(500).select(feistel.place("id", 500).alias("p"), "id").collect()
    assert all(feistel.place_of(r["id"], 500) == r["p"] for r in got)
    rows = feistel.shard_rows(odd, 4)
    assert rows.count() == len(ODD)
    assert set(odd.columns) | {"slot"} == set(rows.columns)
    seen = sorted((r["shard"], r["slot"]) for r in rows.collect())
    assert seen == sorted((p % 4, p // 4) for p in range(len(ODD)))
    assert feistel.assign_shards(odd.filter("false")).count() == 0


def test_quality_on_held_out_labels(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.85
    odd_rows = quality.classify(odd, labels).collect()
    assert len(odd_rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd_rows)
    none = quality.keep_good(odd, labels.filter("false"))
    assert none.columns == odd.columns and none.count() == len(ODD)


def test_decontamination_finds_edited_passages(spark, docs, odd):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    texts = docs.toPandas()
    index = decontaminate.build(list(zip(items.item_id, items.text, strict=True)))
    found = decontaminate.find(index, texts.text.tolist())
    got = {(d, x[0]) for d, row in zip(texts.doc_id, found, strict=True) for x in row}
    assert got == {(d, i) for d, t in zip(texts.doc_id, texts.text, strict=True) for i, x in zip(items.item_id, items.text, strict=True) if x in t}
    rng = random.Random(5)
    for i, x in zip(items.item_id, items.text, strict=True):
        y = list(x)
        for _ in range(len(y) // 25):
            y[rng.randrange(len(y))] = rng.choice("aeiou")
        assert i in {h[0] for h in decontaminate.find(index, ["some words before " + "".join(y) + " and after"])[0]}
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, None), (None, "word word word word"), (3, "word")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.find_leaks(odd, bench).collect()} == {1, 2, 6}  # 6 is nothing but the item "word"
    kept = decontaminate.drop_leaks(odd, bench)
    assert kept.count() == len(ODD) - 4 and kept.columns == odd.columns


def test_decontamination_spans_whole_passages():
    rng = random.Random(9)
    item = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(390))
    index = decontaminate.build([(1, item), (2, item[::-1][:130])])
    find = lambda *texts: decontaminate.find(index, list(texts))
    assert find(f"before {item} after") == [[(1, 7, 397, 0)]]
    assert find(f"before {item[:200]}#{item[201:]} after") == [[(1, 7, 397, 0)]]
    other = item[::-1][:130]
    ((leak,),) = find(f"{'z' * 50} {other[:60]}#{other[61:]} after")
    assert leak[0] == 2 and leak[3] == 1 and abs(leak[1] - 51) <= 1 and leak[2] == 181
    # Two texts of one chunk that hold parts of the item on one diagonal of the joined buffer.
    assert find(item[:150], item[182:]) == [[(1, 0, 150, 0)], [(1, 0, 208, 0)]]
    # A cut passage: by the budget of a window, up to so many bytes around it belong to the span.
    ((leak,),) = find(f"{'0' * 60}{item[100:300]}{'1' * 60}")
    e = decontaminate.budget(390)[1]
    assert leak[3] == 0 and 60 - e <= leak[1] <= 60 and 260 <= leak[2] <= 260 + e


def test_fingerprints_follow_the_texts(docs, odd):
    got = fingerprints.fingerprint_report(docs).toPandas().set_index("doc_id")
    rows = docs.toPandas().sort_values("doc_id", ascending=False)
    texts = rows.text.tolist()
    sets = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    wrong = []
    for k, (d, t) in enumerate(zip(rows.doc_id, texts, strict=True)):
        e = t[: len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][: len(t) // 2]
        assert got.edited_sha256[d] == hashlib.sha256(e.encode()).hexdigest()
        a, b = sets(t), sets(e)
        wrong.append(abs(len(a & b) / len(a | b) - got.near_edited[d]))
    assert np.mean(wrong) < 0.04
    assert fingerprints.fingerprint_report(odd).count() == len(ODD)


def test_sketches_merge(spark):
    frame = spark.createDataFrame([(" ".join(map(str, range(400))), " ".join(map(str, range(396, 900))), " ".join(map(str, range(900))))], "a string, b string, whole string")
    s = fingerprints.sketch
    r = frame.select((fingerprints.merge_sketches(s(F.col("a")), s(F.col("b"))) == s(F.col("whole"))).alias("same"), fingerprints.distinct_shingles(s(F.col("whole"))).alias("n"), fingerprints.containment(s(F.col("a")), s(F.col("whole"))).alias("c")).first()
    assert r["same"] and abs(r["n"] - 896) < 250 and r["c"] > 0.7


def test_sketch_of_five_words_is_their_shingle(spark):
    frame = spark.createDataFrame([("a b c d e", "x a b c d e y", "a b c d")], "five string, more string, four string")
    s = lambda c: fingerprints.sketch(F.col(c))
    r = frame.select(fingerprints.resemblance(s("five"), s("more")).alias("r"), fingerprints.containment(s("five"), s("more")).alias("c"), F.size(s("four")).alias("n")).first()
    assert r["r"] == pytest.approx(1 / 3) and r["c"] == pytest.approx(1) and r["n"] == 1


def test_token_ids_round_trip(spark, odd, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rng = np.random.default_rng(1)
    for n in (0, 1, 255, 256, 257, 3000):
        ids = np.minimum(rng.zipf(1.3, n), 50256)
        segment = tokenids.Segment(tokenids.pack(ids, [(None, n)] if n else []))
        assert (segment.ids() == ids).all()
    out = str(tmp_path / "ids")
    tokenids.write_token_ids(odd, out, path, 2)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokenids.read_token_ids(spark, out).collect())
    at, want = 0, []
    for d, t in sorted(((r[0], r[1]) for r in ODD), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_token_encoder_equals_tokenizer():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        encoder = tokenids.Encoder(file.read(), "fuzz")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    pick = random.Random(5)
    letters = list("abZé'st1,.# \n\t　中ß\xa0\x85\x1c​ñ́ſ²½ـא\x00\xad🙂")
    words = ["<|endoftext|>", "don't", "I'll", "x'", "''s", "  ", "\n\n", " \n", "a\tb", " ", "Straße,", "中文字", "12.5%"]
    texts = ["".join(pick.choice(letters if pick.random() < 0.8 else words) for _ in range(pick.randint(0, 40))) for _ in range(4000)]
    texts += [" ".join(pick.choice(words) for _ in range(pick.randint(0, 12))) for _ in range(2000)]
    assert encoder.memo.split
    for _ in range(2):  # with empty memos and with full ones
        for text, ids in zip(texts, encoder(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_chat_folds_and_round_trips(spark):
    events = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", ""), (1, 3, "delta", 2, None, "he"), (1, 4, "delta", 2, None, "llo"), (1, 5, "message", 3, "user", "bye"),
        (1, 6, "regenerate", 2, None, None), (1, 7, "delta", 2, None, "yo"), (1, 8, "message", 4, "user", "ok"), (1, 9, "edit", 4, None, "ok!"),
    ]
    frame = spark.createDataFrame(events, "conv_id long, seq long, event string, msg_id long, role string, text string")
    got = [(r["role"], r["text"]) for r in chat.fold_events(frame).orderBy("position").collect()]
    assert got == [("user", "hi"), ("assistant", "yo"), ("user", "ok!")]
    turns = [(1, 0, "us<|er", "a<|end|>b<\\|x <\\\\| <"), (1, 1, "assistant", None), (1, 2, "assistant", "|<|says|>\n"), (None, 0, None, "alone"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    out = chat.digest(chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    by = {r["conv_id"]: r for r in out}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert by[1]["turns_sha256"] == sha("us<|er\na<|end|>b<\\|x <\\\\| <\nassistant\n\nassistant\n|<|says|>\n\n")
    assert by[1]["loss_sha256"] == sha("|<|says|>\n") and by[2]["n_turns"] == 2 and by[None]["n_turns"] == 1


def test_site_tree(spark):
    page = '<body><header>Top</header><article><h1>T</h1><p>One<p>Two &amp; <b>three</b><br>four<div class="comments"><p>Me</div><ul><li>a<li>b</ul></article><form><p>q</p></form></body>'
    assert sitetree.extract(page) == "T\n\nOne\n\nTwo & three four\n\na\n\nb"
    assert sitetree.extract(None) == "" == sitetree.extract("")
    same = [(k, f"http://h.org/{k}", f'<div class="x1"><p>Read our rules</p></div><div class="x2"><p>Story {k} is about {k * 7}.</p></div>') for k in range(30)]
    rows = [*same, (100, None, None), (101, "http://one.org/", '<div class="x1"><p>Read our rules</p></div>'), (100, None, None)]
    got = {r["page_id"]: r["text"] for r in sitetree.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3 is about 21." and got[100] == "" and got[101] == "Read our rules"


def test_site_tree_measures_whole_pages(spark):
    story = "Story {0} is about {1} and tells at some length what came of it."
    page = '<body class="page has-sidebar"><div class="top">All rights of this site</div><div class="{2}"><p>' + story + '</p></div><article class="teaser"><p>Tease {3}</p></article><div class="comments"><p>Me {0}</p></div></body>'
    rows = [(k, f"http://{h}.org/{k}", page.format(k, k * 7, style, "more")) for h, n, style in (("a", 2, "story with-comments"), ("b", 9, "search-result")) for k in range(n * 100, n * 101)]
    got = {r["page_id"]: r["text"] for r in sitetree.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: story.format(k, k * 7) for k, *_ in rows}
    assert sitetree.extract(page.format(1, 7, "story", "more")) == f"All rights of this site\n\n{story.format(1, 7)}\n\nTease more"


def test_licenses(odd):
    text = b"Licensed under the Apache License, Version 2.0. CC-BY-SA 4.0 and CC BY; apache license"
    n, base, first, last, base_labels, labels, score, spans = licenses.scan_text(text)
    assert (base, first, last, base_labels) == (4, 3, 16, "apache,cc-by") and "cc-by-sa" in labels and score == 0.9
    assert not any(a[0] <= b[0] and b[1] <= a[1] for a in spans for b in spans if a != b and a[2] <= b[2])
    assert licenses.scan_text(None)[:6] == (0, 0, None, None, "", "")
    assert licenses.scan_licenses(odd).count() == len(ODD)


def _matches(pattern):
    """Strings that a pattern can match: every choice and optional part, and for a long repeat the least and two."""
    from re import _constants as C
    from re import _parser

    def of(node):
        done = {""}
        for op, value in node:
            if op is C.LITERAL:
                here = {chr(value)}
            elif op is C.ANY:
                here = {"y"}
            elif op is C.IN:
                here = {c for kind, x in value for c in ([chr(x)] if kind is C.LITERAL else [chr(x[0]), chr(x[1])])}
            elif op is C.BRANCH:
                here = set().union(*map(of, value[1]))
            elif op is C.SUBPATTERN:
                here = of(value[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                each = of(value[2])
                here = {a * n for a in each for n in {value[0], min(value[1], 2)}}
            else:
                raise ValueError(op)
            done = {a + b for a in done for b in here}
        return done

    return of(_parser.parse(pattern))


def test_license_keywords_stand_in_every_match():
    for rule in licenses.RULES:
        pattern = rule.pattern.decode().removeprefix("(?<![^ ])").removesuffix("(?![^ ])")
        for text in _matches(pattern):
            found = set(licenses.words(text.encode()))
            assert rule.keywords and rule.keywords <= found, (rule.label, pattern, text)


def test_licenses_in_one_word_forms():
    for name, label in (("ShareAlike", "cc-by-sa"), ("NoDerivs", "cc-by-nd"), ("NoDerivatives", "cc-by-nd"), ("NonCommercial", "cc-by-nc"), ("NonCommercial-ShareAlike", "cc-by-nc-sa"), ("NonCommercial-NoDerivs", "cc-by-nc-nd"), ("Share Alike", "cc-by-sa")):
        for text in ("Creative Commons Attribution-{}", "licensed under the Creative Commons Attribution-{} License", "Creative Commons Attribution-{} 4.0"):
            assert licenses.scan_text(text.format(name).encode())[5] == label, text.format(name)
    assert licenses.scan_text(b"GNU General Public Licensev2")[5] == "" and licenses.scan_text(b"Apache License2.0")[5] == "apache"


def test_every_query_is_registered():
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 11))


def test_pipeline_stages(spark, odd):
    import corpus_pipeline

    rows = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        assert rows.columns == odd.columns
    docs = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard", "slot"} <= set(docs.columns) and docs.count() > 0
