"""The corpus operators against plain versions of the same rules, and their defined cases on tables with hot rows."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import deal, edits, spark_hash, targets
from factloom.llm import chat, decontaminate, feistel, fingerprints, licenses, mixing, quality, simhash, sitetree, tokenids
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
EXTRA = "lang string, source string, _h string, size int, hash int, n int, s int, p double, target string, row_no int, shard string, slot int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def hot(spark, docs, tmp_path_factory):
    """The documents, one row 100,000 times, one id with 3,000 texts, 3,000 rows without id, and columns with names that operators use."""
    more = (
        spark.range(100_000).selectExpr("3000000L AS doc_id", "'one and the same row again' AS text").unionByName(spark.range(3000).selectExpr("3000001L AS doc_id", "concat('text of number ', id) AS text"))
        .unionByName(spark.range(3000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "concat('no id ', id % 1500) AS text")).unionByName(spark.createDataFrame([(None, None), (3000002, ""), (3000003, None)], "doc_id long, text string"))
    )
    rows = more.withColumns({"lang": F.lit("en"), "source": F.when(F.col("doc_id") != 3000000, F.lit("src"))}).unionByName(docs.select("doc_id", "text", "lang", "source"))
    rows = rows.withColumns({x.split()[0]: F.lit(None).cast(x.split()[1]) for x in EXTRA.split(", ")[2:]})
    path = str(tmp_path_factory.mktemp("hot") / "documents.parquet")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def same_rows(a, b, columns):
    return sorted(map(repr, a.select(*columns).collect())) == sorted(map(repr, b.select(*columns).collect()))


# ---- 1: site style tree


def importance(pages):
    """{path: (pages, named, importance, removed alone)} of the pages of one host, from the definition."""
    trees = [sitetree.read(p) for p in pages]
    shapes, contents, where, named = {}, {}, {}, {}

    def text(node):
        out = []
        for c in node.children:
            if isinstance(c, str):
                out += c.split()
            elif not c.silent and not c.noise and (inner := text(c)):
                out.append(("in", *inner))
        return out

    def visit(node, page):
        plain = node.tag in sitetree.INLINE or node.tag in ("html", "body") or node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and node.style == node.tag
        if node.parent is None or not plain:
            styles = [c.style for c in node.children if not isinstance(c, str)]
            shapes.setdefault(node.path, set()).add((page, tuple(s for i, s in enumerate(styles) if not i or styles[i - 1] != s)))
            contents.setdefault(node.path, set()).add((page, repr(text(node))))
            where.setdefault(node.path, set()).add(page)
            named[node.path] = named.get(node.path, False) or node.noise
        for c in node.children:
            if not isinstance(c, str) and not c.silent:
                visit(c, page)

    for k, tree in enumerate(trees):
        sitetree.spare(tree)
        visit(tree, k)

    def own(path):
        m = len(where[path])
        if m < sitetree.LEAST_PAGES:
            return 1.0
        kinds = Counter(s for _, s in shapes[path])
        t = sum(kinds.values())
        h = -sum(c / t * math.log(c / t, t) for c in kinds.values()) if t > 1 else 0.0
        shared = Counter(s for _, s in contents[path])
        c = 1 - sum(math.log(shared[s], m) for _, s in contents[path]) / len(contents[path])
        return (1 - sitetree.GAMMA) * h + sitetree.GAMMA * c

    best = own(trees[0].path)
    return {p: (len(where[p]), named[p], sitetree.NAMED * min(own(p), best) if named[p] else own(p), own(p) < sitetree.LEAST_SHARE * best) for p in where if p != trees[0].path}


def test_style_tree_equals_brute_force(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choice("ab bc cd de ef fg gh hi ij jk".split()) for _ in range(n))
    pages = []
    for k in range(40):
        rules = "".join(f'<li class="r{j}">rule {j if rng.random() < 0.9 else k}</li>' for j in range(rng.randint(1, 4)))
        pages.append(f'<body><div class="top">Same <b>words</b> here</div><nav>{words(3)}</nav><ul class="x">{rules}</ul><div class="story"><p>{words(30)}</p>{"<div class=q>" + words(5) + "</div>" if k % 3 else ""}</div></body>')
    frame = spark.createDataFrame([(1, p) for p in pages], "host long, html string")
    tree = sitetree.style_tree(frame).collect()
    got = {r["path"]: (r["pages"], r["named"], r["importance"], r["alone"]) for r in tree}
    assert all(r["removed"] == (r["named"] or r["alone"]) for r in tree)
    want = importance(pages)
    assert got.keys() == want.keys()
    for path, (m, named, value, removed) in want.items():
        assert got[path][:2] == (m, named) and got[path][2] == pytest.approx(value, abs=1e-9) and got[path][3] == removed
    assert sum(r for *_, r in want.values()) >= 3  # the top and some rules, by their own importance
    assert any(v[1] for v in want.values())


def test_removed_paths_are_joined_as_they_are_broadcast(spark):
    rows = [(k, f"http://h{k % 3}.org/{k}", f'<div class="x1"><p>Read our rules</p></div><div class="x2"><p>Story {k} is about {k * 7}.</p></div>', "t", 1) for k in range(30)]
    pages = spark.createDataFrame([*rows, (None, None, None, None, None), rows[0]], "page_id long, url string, html string, text string, host int")
    a, b = sitetree.extract_pages(pages), sitetree.extract_pages(pages, broadcast_paths=0)
    assert same_rows(a, b, a.columns) and a.count() == 32
    assert {r["text"] for r in a.filter("page_id = 4").collect()} == {"Story 4 is about 28."}
    assert sitetree.extract_pages(pages.filter("false")).collect() == []


def test_names_are_whole_and_spare_the_page():
    for page in ('<body class="no-sidebar"><article><p>Hi', '<body class="single comments-open"><p>Hi', '<article class="post has-toc"><p>Hi</article>', '<article id="search-engines">Hi</article>'):
        assert sitetree.extract(page) == "Hi", page
    long = "<p>a text that is long enough</p>"
    assert sitetree.extract(f'<main>{long}<div class="share-price">Hi</div></main>').endswith("Hi")
    for name in ("adBox", "site-footer", "cookie-consent-banner", "reader-comments", "comment-list", "sidebar", "related_posts", "newsletter-signup-form"):
        assert sitetree.extract(f'<main>{long}<div class="{name}">Hi</div></main>') == "a text that is long enough", name
    assert sitetree.extract('<main><p title="5" tall">Hi <a href=x>there</a></p></main>') == "Hi there"


def test_deep_and_long_pages_are_read_in_linear_time():
    def took(n):
        began = time.perf_counter()
        page = "<div>x" * n + "</b></q>" * n
        assert sitetree.style_rows(page) and sitetree.extract(page).startswith("x\n\nx")
        return time.perf_counter() - began

    took(100)
    assert took(4000) < 1.0 and took(16000) < 4.0
    assert len(sitetree.extract("<p>" + "word " * 200_000)) == 999_999


# ---- 2: additive model


def test_trees_find_the_best_cuts():
    rng = np.random.default_rng(3)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.uniform(5, 9, size=9)
        gain = lambda part: g[part].sum() ** 2 / (h[part].sum() + 1)
        best = max(range(1, 9), key=lambda c: gain(slice(0, c)) + gain(slice(c, 9)))
        value, cut = quality._best_cut(g, h, 0, 9)
        assert cut == best and value == pytest.approx(gain(slice(0, best)) + gain(slice(best, 9)) - gain(slice(0, 9)))
        grid, weight = rng.normal(size=(4, 5)), rng.uniform(5, 9, size=(4, 5))
        part = lambda r, c: grid[r, c].sum() ** 2 / (weight[r, c].sum() + 1)
        four = [sum(part(rows, slice(0, k)) + part(rows, slice(k, 5)) if k else part(rows, slice(0, 5)) for rows, k in ((slice(0, c), a), (slice(c, 4), b))) for c in range(1, 4) for a in range(5) for b in range(5)]
        assert quality._pair_tree(grid, weight)[0] == pytest.approx(max(four) - part(slice(0, 4), slice(0, 5)))


def test_scores_are_sums_of_table_entries(spark, docs, hot):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows, marks = docs.toPandas(), labels.toPandas().set_index("doc_id").quality
    x = np.array([quality.features(t.encode()) for t in rows.text])
    known = [k for k, d in enumerate(rows.doc_id) if d in marks.index and zlib.crc32(str(d).encode()) % 4 != 2]
    model = quality.fit(x[known], marks[rows.doc_id[known]].to_numpy().astype(float))

    def score(v):
        total = model.intercept
        for value, edges, table in zip(v, model.edges, model.tables, strict=True):
            total += table[sum(e <= value for e in edges)]
        for a, b, ea, eb, grid in model.pairs:
            total += grid[sum(e <= v[a] for e in ea)][sum(e <= v[b] for e in eb)]
        return 1 / (1 + math.exp(-total))

    got = quality.classify(docs, labels).toPandas().set_index("doc_id")
    for d, v in zip(rows.doc_id, x, strict=True):
        assert got.score[d] == pytest.approx(score(v), abs=1e-9) and got.held_out[d] == (zlib.crc32(str(d).encode()) % 4 == 2) and got.predicted[d] == (got.score[d] >= 0.7)
    assert quality.classify(docs.filter("false"), labels).collect() == []
    clashing = labels.withColumns({"text": F.lit("x"), "y": F.lit(1), "_id": F.lit(2)}).unionByName(labels.withColumns({"text": F.lit("x"), "y": F.lit(1), "_id": F.lit(2)}))
    again = quality.classify(docs.withColumns({"quality": F.lit(0), "y": F.lit(0), "score": F.lit("s")}), clashing).toPandas().set_index("doc_id")
    assert np.allclose(again.score[rows.doc_id], got.score[rows.doc_id])
    assert quality.classify(hot, labels).count() == hot.count()


# ---- 3: decontamination


def test_leaks_equal_brute_force_around_the_budget():
    rng = random.Random(11)
    letters = "abcdefghij é中"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n)).strip().replace("  ", "e ")
    items = [(k, " ".join(make(n).split())) for k, n in enumerate((14, 30, 47, 64, 90, 118, 121, 150))]
    index = decontaminate.build(items)
    met = Counter()
    for _ in range(120):
        i, item = items[rng.randrange(len(items))]
        y = list(item)
        w, e, _ = decontaminate.budget(len(item))
        for _ in range(rng.randint(max(0, e - 2), e + 4)):
            at = rng.randrange(len(y))
            y[at : at + 1] = rng.choice([[], [rng.choice(letters[:10])], [y[at], rng.choice(letters[:10])]])
        text = " ".join(f"{make(40)} {''.join(y)} {make(40)}".split())
        want = {k for k, x in items if min(edits(x[s : s + decontaminate.budget(len(x))[0]], text) for s in range(len(x) - decontaminate.budget(len(x))[0] + 1)) <= decontaminate.budget(len(x))[1]}
        got = decontaminate.find(index, [text])[0]
        assert {x[0] for x in got} == want, (i, text)
        met[i in want] += 1
        for k, start, end, n in got:
            least = min(edits(items[k][1][s : s + decontaminate.budget(len(items[k][1]))[0]], text) for s in range(len(items[k][1]) - decontaminate.budget(len(items[k][1]))[0] + 1))
            assert n == least and 0 <= start < end <= len(text)
    assert min(met.values()) > 20


def test_repetitive_texts_need_little_memory():
    import resource

    index = decontaminate.build([(1, "x " * 1000)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert decontaminate.find(index, ["x " * 10_000]) == [[(1, 0, 19_999, 0)]]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    text = "some words " * 300 + "x " * 500 + "and more " * 400
    assert decontaminate.find(index, [text], hits=1000) == decontaminate.find(index, [text]) and decontaminate.find(index, [text])[0]
    rng = random.Random(2)
    item = "".join(rng.choice("ab ") for _ in range(700))
    near = decontaminate.build([(1, item)])
    assert decontaminate.find(near, [item * 3], hits=500) == decontaminate.find(near, [item * 3], hits=1 << 22)


def test_blocks_one_after_the_other(spark, docs, hot):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("doc_id", F.lit(1))
    assert len(list(decontaminate.blocks(items, chars=1000))) > 3
    one, many = decontaminate.find_leaks(docs, items), decontaminate.find_leaks(docs, items, chars=1000)
    assert same_rows(one, many, one.columns) and one.count() > 0
    a, b = decontaminate.drop_leaks(hot, items), decontaminate.drop_leaks(hot, items, chars=1000)
    assert a.columns == b.columns == hot.columns and a.count() == b.count() == hot.count() - one.select("doc_id").distinct().count()
    empty = items.filter("false")
    assert decontaminate.find_leaks(docs, empty).count() == 0 and decontaminate.drop_leaks(docs, empty).count() == docs.count() and decontaminate.find_leaks(docs.filter("false"), items).count() == 0


# ---- 4: chat


def test_chat_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, seq int, event string, msg_id string, formatted int"
    long = "ab<|" * 200_000
    rows = [(1, 0, "user", long, 1, "x", "y", 2), (1, 1, "assistant", long, 1, "x", "y", 2), (None, 0, "user", "a", 1, "x", "y", 2), (None, 0, "assistant", "b", 1, "x", "y", 2), (2, None, None, None, None, None, None, None)]
    got = chat.digest(chat.format_conversations(spark.createDataFrame(rows, schema))).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert sorted((r["conv_id"] or 0, r["n_turns"], r["turns_sha256"], r["loss_sha256"]) for r in got) == sorted(
        [(1, 2, sha(f"user\n{long}\nassistant\n{long}\n"), sha(long)), (0, 1, sha("user\na\n"), sha("")), (0, 1, sha("assistant\nb\n"), sha("b")), (2, 1, sha("\n\n"), sha(""))]
    )
    assert chat.format_conversations(spark.createDataFrame([], schema)).collect() == []


def test_hot_turns_without_conversation_spread(spark):
    turns = spark.range(50_000).selectExpr("CAST(NULL AS BIGINT) AS conv_id", "0L AS turn", "'user' AS role", "'hi' AS text")
    assert chat.format_conversations(turns).count() == 50_000


# ---- 5: token ids


def test_token_ids_of_odd_tables(spark, hot, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenids.write_token_ids(hot.filter("false"), str(tmp_path / "none"), path, 2)
    assert tokenids.read_token_ids(spark, str(tmp_path / "none")).collect() == []
    tokenids.write_token_ids(hot, str(tmp_path / "hot"), path, 2)
    got = tokenids.read_token_ids(spark, str(tmp_path / "hot")).toPandas()
    known = {}
    want = Counter()
    for r in hot.select("doc_id", "text").toLocalIterator():
        if r["text"] not in known:
            ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2]
            known[r["text"]] = len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        want[r["doc_id"], *known[r["text"]]] += 1
    assert Counter((None if np.isnan(d) else int(d), n, c) for d, n, c in zip(got.doc_id.astype(float), got.n_tokens, got.ids_crc32, strict=True)) == want
    got = got.sort_values(["start", "n_tokens"])
    assert (got.start.to_numpy() == np.r_[0, got.n_tokens.cumsum().to_numpy()[:-1]]).all()
    ids = [-1 if np.isnan(d) else d for d in got.doc_id.astype(float)]
    assert ids == sorted(ids)


def test_memo_is_bounded_by_bytes(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(tokenids, "MEMO_BYTES", 200_000)
    with open(path, encoding="utf-8") as file:
        encoder = tokenids.Encoder(file.read(), "bounded")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(8)
    for _ in range(12):
        texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(100)) for _ in range(20)] + ["the same words\nagain and again", "x" * 3000, "中" * 500, ""]
        for text, ids in zip(texts, encoder(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.memo.bytes < 3 * tokenids.MEMO_BYTES and 0 < len(encoder.memo.keys) and (np.diff(encoder.memo.keys.astype(float)) >= 0).all()


def test_letters_met_before_are_known_with_other_punctuation():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        encoder = tokenids.Encoder(file.read(), "punctuation")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    given = []

    class Counting:  # stands for the tokenizer and for its model
        def __init__(self, real):
            self.real = real

        @property
        def model(self):
            return Counting(self.real.model)

        def tokenize(self, piece):
            given.append(piece)
            return self.real.tokenize(piece)

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.real.encode_batch_fast(texts, **options)

    encoder.memo.tokenizer = Counting(encoder.memo.tokenizer)
    rng = random.Random(4)
    letters = ["".join(rng.choice("abcdeéßñŁɏ") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    for after in ("", ".", ",***", "'", "!?", "."):
        given.clear()
        text = " ".join(w + after for w in letters) + "\n" + letters[0] + after
        assert np.frombuffer(encoder([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert sum(map(len, given)) > 1000 if after == "" else sum(map(len, given)) < 10
    # Where the pattern cuts elsewhere, or may do so.
    heads, ends = ["a", "Ŀ", "é", "×", "÷", "º", "ñ́", "e\u0301", "…", "ж", "中", "1", "_", "'", "''", "I'", "ab'", "ɐ", "\u0250"], ["", ".", "'", "'s", "'ll", "'s.", "…", ".…", "…." "²", "_", "<|endoftext|>", "1.", "é.", "-x", "x" * 80, "." * 80]
    texts = [between.join(h + e for h in heads for e in ends[k:]) for between in (" ", "\n", "  ", " \n") for k in range(len(ends))] + [h + e for h in heads for e in ends]
    for _ in range(2):
        for text, ids in zip(texts, encoder(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
    assert len(np.unique(encoder.memo.keys)) == len(encoder.memo.keys) and not encoder.memo.fresh


def test_segments_with_exceptions_of_all_widths():
    rng = np.random.default_rng(7)
    for n in (1, 256, 300, 256 * 40 + 17):
        ids = np.concatenate([rng.integers(0, 1 << rng.integers(1, 33), 256) for _ in range(-(-n // 256))])[:n]
        ids = np.where(rng.random(n) < 0.08, rng.integers(0, 1 << 32, n), ids)
        segment = tokenids.Segment(tokenids.pack(ids, [(1, n)]))
        assert (segment.ids() == ids).all()
        assert (np.concatenate([segment.block(k) for k in range(segment.n_blocks)]) == ids).all()


# ---- 6: mixing


def test_mixing_equals_trades_in_python(docs):
    assert targets({"a": 10, "b": 10, None: 80}) == pytest.approx({"a": 17.5, "b": 30.0, None: 52.5})
    rows = docs.toPandas()
    rows["words"] = rows.text.map(lambda t: len(t.encode().split()))
    sizes = rows.groupby("source").words.sum().to_dict()
    goal = targets({k: int(v) for k, v in sizes.items()})
    want = {}
    for source, part in rows.groupby("source"):
        f = goal[source] / sizes[source]
        part = part.sort_values("doc_id")
        opened = [(d, at, f - math.floor(f), float(w)) for at, (d, w) in enumerate(zip(part.doc_id, part.words, strict=True)) if f > math.floor(f) and w]
        extra = deal(opened, mixing.CHUNK, mixing.SEED)
        want |= {d: (w, sizes[source], goal[source], w * (math.floor(f) + extra.get(d, 0))) for d, w in zip(part.doc_id, part.words, strict=True)}
    got = mixing.mix_report(docs).toPandas().set_index("doc_id")
    assert len(got) == len(want)
    for d, (size, source_size, target, taken) in want.items():
        r = got.loc[d]
        assert (r["size"], r.source_size, r.taken) == (size, source_size, taken) and r.target == pytest.approx(target)
    again = mixing.mix_report(docs.repartition(7)).toPandas().set_index("doc_id")
    assert (again.taken[got.index] == got.taken).all()


def test_mixing_deals_single_copies_of_equal_rows(spark, hot):
    report = mixing.mix_report(hot).toPandas()
    assert len(report) == hot.count() and (report.taken <= 3 * report["size"]).all()
    for (_, target), part in report.groupby(["source_size", "target"]):
        assert abs(part.taken.sum() - target) <= part["size"].max() / 2 + 1e-6
    mixed = mixing.mix(hot)
    assert mixed.columns == hot.columns
    goals = {r["source"]: (r["target"], r["most"]) for r in mixing.deal_copies(hot).groupBy("source").agg(F.first("target").alias("target"), F.max("size").alias("most")).collect()}
    taken = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
    assert all(abs(taken.get(s, 0) - t) <= most / 2 + 1e-6 for s, (t, most) in goals.items())
    # Sources a and b of 100 words; the targets are a third and two thirds of 200.
    frame = spark.createDataFrame([(7, "w " * 10, "a", k) for k in [1] * 10] + [(8, "w " * 10, "b", 1)] * 10, "doc_id long, text string, source string, k long")
    taken = {r["source"]: r["n"] for r in mixing.mix(frame).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert taken["a"] in (6, 7) and taken["b"] in (13, 14)
    assert mixing.mix_report(hot.filter("false")).count() == 0 and mixing.mix(hot.filter("false")).count() == 0


# ---- 7: Feistel shards


def test_shards_equal_the_permutation_in_python(spark, docs, hot):
    rows = docs.toPandas()
    keyed = sorted((d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in zip(rows.doc_id, rows.text, strict=True))
    want = {(*k, p % 16, p // 16) for i, k in enumerate(keyed) for p in [feistel.place_of(i, len(keyed))]}
    got = {(r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in feistel.assign_shards(docs).collect()}
    assert got == want
    kept = feistel.shard_rows(docs)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in kept.collect()} == {(d, s, t) for d, _, _, s, t in want}
    for made in (feistel.shard_rows(hot, 4), feistel.assign_shards(hot, 4)):
        places = [(r["shard"], r["slot"]) for r in made.select("shard", "slot").collect()]
        assert sorted(places) == sorted((p % 4, p // 4) for p in range(hot.count()))
    rest = [c for c in hot.columns if c not in ("shard", "slot")]
    assert feistel.shard_rows(hot, 4).select(*rest).exceptAll(hot.select(*rest)).isEmpty()
    assert feistel.shard_rows(hot.filter("false")).count() == 0


# ---- 8: bottom-k


def sketch(text):
    w = [spark_hash(x) for x in text.translate(dict.fromkeys(range(9, 14), " ")).split(" ") if x]
    if not w:
        return []
    return sorted({spark_hash(*w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {spark_hash(" ".join(map(str, w)))})[:128]


def test_sketches_equal_brute_force(docs):
    rows = docs.toPandas().sort_values("doc_id", ascending=False)
    got = fingerprints.fingerprint_report(docs).toPandas().set_index("doc_id")
    texts = rows.text.tolist()
    hexed = lambda s: "".join(f"{x & (1 << 64) - 1:016x}" for x in s)

    def near(a, b):
        union = sorted({*a, *b})[:128]
        return 1.0 if not a and not b else len({*union} & {*a} & {*b}) / len(union)

    for k, (d, t) in enumerate(zip(rows.doc_id, texts, strict=True)):
        after = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = sketch(t), sketch(edited), sketch(after)
        r = got.loc[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b))
        assert r.near_edited == pytest.approx(near(a, b)) and r.near_next == pytest.approx(near(a, c))


def test_next_documents_of_hot_ids(spark, hot):
    got = fingerprints.with_next(hot, bucket_rows=500).select("doc_id", "text", "next_text").collect()
    assert len(got) == hot.count()
    assert Counter(r["text"] for r in got) == Counter(r["next_text"] for r in got)  # one cycle visits every row once
    after = {}
    for r in got:
        after.setdefault(r["text"], Counter())[r["next_text"]] += 1
    same = "one and the same row again"
    assert after[same][same] == 99_999  # the one left is followed by the next id's text
    plain = sorted(((r["doc_id"], r["text"]) for r in hot.filter("doc_id < 3000000").collect()), reverse=True)
    for (_, a), (_, b) in zip(plain, plain[1:], strict=False):
        assert b in after[a]
    one = fingerprints.fingerprint_report(spark.createDataFrame([(None, "a b c d e f g h")], "doc_id long, text string")).first()
    assert one["doc_id"] is None and one["near_next"] == 1.0
    assert fingerprints.fingerprint_report(hot.filter("false")).collect() == []


# ---- 9: SimHash


def test_simhash_hot_keys_are_cut_again(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & ((1 << 64) - 1) for _ in range(500)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    a = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 3
    label = np.arange(len(a))
    while True:
        low = np.array([label[n].min() for n in near])
        if (low == label).all():
            break
        label = low
    for tile, deep in ((4096, 10), (20, 10), (50, 1 << 16)):
        root = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, tile=tile, deep=deep)).collect()}
        groups = {}
        for s, k in zip(signed, label, strict=True):
            groups.setdefault(k, set()).add(root.get(s, s))
        assert all(len(v) == 1 for v in groups.values()) and len({next(iter(v)) for v in groups.values()}) == len(groups)


def test_simhash_hot_rows(hot):
    groups = simhash.group_near_duplicates(hot)
    assert groups.count() == hot.count()
    kept = simhash.keep_one(hot)
    assert kept.columns == hot.columns
    assert kept.count() == simhash._grouped(hot, "doc_id", "text", simhash.TILE).select("_root").distinct().count()
    assert kept.filter("doc_id = 3000000").count() == 1
    assert simhash.group_near_duplicates(hot.filter("false")).collect() == [] and simhash.keep_one(hot.filter("false")).collect() == []


# ---- 10: licenses


def naive(found):
    """All rules on all texts; a hit is dropped if it lies inside one of a class above, or inside another of its own class that is longer or comes first."""
    import re

    line = b" ".join(found)
    hits = set()
    for r in licenses.RULES:
        for m in re.finditer(r.pattern, line):
            lo = line[: m.start()].count(b" ")
            hits.add((lo, lo + m.group().count(b" ") + 1, r.priority, r.label))
    kept = []
    for a in sorted(hits, key=lambda h: (h[2], h[0], -h[1], h[3])):
        if not any(b[0] <= a[0] and a[1] <= b[1] for b in kept):
            kept.append(a)
    return sorted(kept)


def test_detections_equal_a_naive_scan(spark, docs):
    rng = random.Random(6)
    phrases = [*(f[2].replace("(?:", "").replace(")?", "").replace(")", "").split("|")[0] for f in licenses.FAMILIES), *(p for _, ps in licenses.SIGNATURES for p in ps if not set(p) & set("|(?[.")), "SPDX-License-Identifier: GPL-2.0 or later", "CC BY-SA 4.0", "cc by", "version 2.0", "All rights reserved", "some other words"]
    texts = [" ".join(rng.choice(phrases) for _ in range(rng.randint(1, 6))) for _ in range(60)] + [r["text"] for r in docs.select("text").limit(100).collect()]
    n = 0
    for t in texts:
        found = licenses.words(t.encode())
        assert licenses.detect(found) == naive(found), t
        n += len(naive(found))
    assert n > 100
    assert licenses.detect(licenses.words(("mit license " * 50_000).encode()))[-1][0] == 99_998
    odd = spark.createDataFrame([(1, "MIT License", "x", 1), (1, "MIT License", "x", 1), (None, None, None, None)], "doc_id long, text string, labels string, spans int")
    got = licenses.scan_licenses(odd).collect()
    assert sorted((r["doc_id"] or 0, r["labels"]) for r in got) == [(0, ""), (1, "mit"), (1, "mit")] and licenses.scan_licenses(odd.filter("false")).collect() == []


# ---- pipeline


def test_pipeline_equals_its_stages_in_python(spark, docs):
    import corpus_pipeline

    rows = docs.toPandas().sort_values("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    marks = labels.toPandas().set_index("doc_id").quality
    x = np.array([quality.features(t.encode()) for t in rows.text])
    known = [k for k, d in enumerate(rows.doc_id) if d in marks.index and zlib.crc32(str(d).encode()) % 4 != 2]
    model = quality.fit(x[known], marks[rows.doc_id.iloc[known]].to_numpy().astype(float))
    rows = rows[model.score(x) >= quality.THRESHOLD]
    fps = np.array([simhash.fingerprint(t.encode()) for t in rows.text], dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = rows.doc_id.to_numpy().copy()
    while True:
        low = np.array([label[n].min() for n in near])
        if (low == label).all():
            break
        label = low
    rows = rows[label == rows.doc_id]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    index = decontaminate.build(list(zip(items.item_id, items.text, strict=True)))
    rows = rows[[not found for found in decontaminate.find(index, rows.text.tolist())]].copy()
    rows["words"] = rows.text.map(lambda t: len(t.encode().split()))
    sizes = {k: int(v) for k, v in rows.groupby("source").words.sum().items()}
    goal, copies = targets(sizes), {}
    for source, part in rows.groupby("source"):
        f = goal[source] / sizes[source]
        extra = deal([(d, at, f - math.floor(f), float(w)) for at, (d, w) in enumerate(zip(part.doc_id, part.words, strict=True)) if f > math.floor(f) and w], mixing.CHUNK, mixing.SEED)
        copies |= {d: math.floor(f) + extra.get(d, 0) for d in part.doc_id}
    mixed = [d for d in sorted(copies) for _ in range(copies[d])]
    want = sorted((d, p % 16, p // 16) for i, d in enumerate(mixed) for p in [feistel.place_of(i, len(mixed))])
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*docs.columns, "shard", "slot"]
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got.collect()) == want and len(want) > 50


def test_pipeline_stages_on_hot_and_empty_tables(spark, hot):
    import corpus_pipeline

    for frame in (hot.withColumn("shard", F.lit("x")), hot.filter("false")):
        rows = frame
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == frame.columns
        last = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        assert set(last.columns) == set(frame.columns) and sorted((r["shard"], r["slot"]) for r in last.collect()) == sorted((p % 16, p // 16) for p in range(rows.count()))


# ---- SQL


def test_oracle_sql_equals_the_queries(spark):
    import duckdb
    from factloom.llm import queries

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want, got = con.execute(sql).df(), queries.QUERIES[name](spark, SF).toPandas()
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns, name
        plain = lambda f, columns=columns: sorted(map(repr, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
        assert plain(got) == plain(want), name
