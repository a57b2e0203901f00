"""The ten operators against brute force, and on odd rows."""

import gzip
import hashlib
import io
import os
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trackweave.llm import decontaminate, language_id, mixing, ngram_lm, quality, queries, simhash, token_counts, token_store, toxicity, warc
from trackweave.llm.pieces import PieceTable

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.TOKENIZER)
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, n int, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 997} <|endoftext|>x" for i in range(60_000))
ODD = [
    (1, "Plain words on a line, that's all of them here.\nPlain words on a line, that's all of them here.", "en", "a", 1, 0.5, 1, "k"),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "b", 0, 0.5, 1, "k"),
    (4, " \t\n\x0b\x0c\r ", "de", "b", 7, 0.5, 1, "k"),
    (5, LONG, "en", "a", len(LONG), 0.5, 1, "k"),
    (5, LONG, "en", "a", len(LONG), 0.5, 1, "k"),
    (None, "Plain words on a line, that's all of them here.", "fr", None, 1, 0.5, 1, "k"),
    (7, "ÉCOLE école İ  nbsp  em <|endoftext|> a<|ENDOFTEXT|>b ̈x", "fr", "c", 1, 0.5, 1, "k"),
    (8, "x" * 5000 + " " + "y" * 70_000, "es", "a", 1, 0.5, 1, "k"),
    (9, "1234 !!! ###", "es", "d", 1, 0.5, 1, "k"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_toxicity(spark, odd, empty):
    rows = queries.op1_toxicity(spark, "/root/testdata/sf0.01").collect()
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(p == t for p, t in held) / len(held) > 0.85  # 330 labels to learn from, under 50 of them toxic
    texts = [b"a fine day out", b"you are a moron", b"what a nice idea"] * 40
    net = toxicity.train(texts, np.array([0, 1, 0] * 40), ["en"] * 120, epochs=8)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(odd, net).collect()}
    assert len(got) == 9 and got[2] == got[3] == got[4]
    assert toxicity.score_toxicity(odd, net).count() == 10 and toxicity.score_toxicity(empty, net).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(odd, None).collect()} == {0.0}
    score = net.score([b"you are a moron", b"a fine day out"])
    assert score[0] > 0.5 > score[1]
    # pieces of a long text give what the whole text gives
    whole = net.score([LONG.encode()])[0]
    assert abs(got[5] - whole) < 1e-5
    assert toxicity.fit_toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")) is None
    texts = [" ".join(f"{'moron' if (i * j) % 7 == 0 else 'fine'} word{i * j % 50} you are a day" for j in range(1, 60)) for i in range(20)] + ["", "one", "x " * 200]
    whole = net.score([t.encode() for t in texts])
    pieces = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"), net, batch_bytes=40).collect()}
    assert [pieces[i] for i in range(len(texts))] == pytest.approx(whole.tolist(), abs=1e-6)
    # brute force: the largest response of each filter over all windows, words beyond the end counting nothing
    for text, want in zip(texts[:5] + texts[-3:], whole.tolist()[:5] + whole.tolist()[-3:]):
        words, hidden, tap = text.encode().split(), [], 0
        rows = net.vectors(words) if words else np.zeros((0, net.embed.shape[1]))
        for width in net.widths:
            got = [sum(rows[p + k] @ net.taps[tap + k] for k in range(width) if p + k < len(rows)) for p in range(max(1, len(rows)))]
            hidden += np.max([g if np.ndim(g) else np.zeros(net.filters) for g in got], axis=0).tolist()
            tap += width
        logit = np.maximum(np.array(hidden) + net.bias, 0) @ net.out[:-1] + net.out[-1] + net.shift
        assert 1 / (1 + np.exp(-logit)) == pytest.approx(want, abs=1e-5)


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"{'bad' if i % 2 else 'good'} " * 50, "en") for i in range(80)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.fit_toxicity(docs, labels, max_rows=30, max_bytes=4000) is not None


def brute_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(codes):
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    unique = sorted(codes)
    for i, a in enumerate(unique):
        for b in unique[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


@pytest.mark.parametrize("table", ["sf", "odd"])
def test_simhash(spark, odd, docs, table):
    df = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    want = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
    root = brute_components({f for _, f in want})
    least = {}
    for i, f in want:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    got = simhash.simhash_components(df).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted([(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got], key=key) == sorted([(i, f"{f:016x}", least.get(root[f])) for i, f in want], key=key)


def test_simhash_links_random_groups():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) if k else np.uint64(0) for k in rng.integers(0, 6, 400)], np.uint64)
    codes = rng.permutation(base[rng.integers(0, 40, 400)] ^ flips)
    stops = np.array([1, 3, 70, 71, 300, 400])
    ends = np.repeat(stops, np.diff(np.append(0, stops)))
    i, j = simhash.links_in_groups(codes, ends)
    assert all((int(codes[a]) ^ int(codes[b])).bit_count() <= 4 and b < ends[a] for a, b in zip(i, j))
    for a, b in zip(np.append(0, stops[:-1]), stops):
        want = brute_components({int(c) for c in codes[a:b]})
        root = {int(c): int(c) for c in codes[a:b]}
        inside = [(int(codes[p]), int(codes[q])) for p, q in zip(i, j) if a <= p < b]
        for _ in range(len(root)):
            for p, q in inside:
                root[p] = root[q] = min(root[p], root[q])
        assert len(set(want.values())) == len(set(root.values()))


def test_simhash_large_bucket(spark):
    """A bucket that is divided into chunks loses no link."""
    rng = np.random.default_rng(2)
    codes = sorted({int(x) & 0xFFFFF for x in rng.integers(0, 1 << 20, 500)})
    df = spark.createDataFrame([(c,) for c in codes], "code long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.near_pairs(df, chunk=64)).collect()}
    assert {c: found.get(c, c) for c in codes} == brute_components(set(codes))


def test_simhash_empty_and_drop(spark, odd, empty):
    assert simhash.simhash_components(empty).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect())[:3] == [0, 1, 2]
    assert kept.where("doc_id = 5").count() == 1 and kept.where("doc_id in (3, 4)").count() == 0


def test_token_counts(spark, odd, empty):
    tok = Tokenizer.from_file(PATH)
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        want = [(r["doc_id"], len((r["text"] or "").encode()), len(tok.encode(r["text"] or "", add_special_tokens=False))) for r in df.collect()]
        got = [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, PATH, batch_bytes=20_000).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.token_counts(empty, PATH).count() == 0
    other = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=other)
    some = odd.where("doc_id in (1, 2, 7, 9)")
    assert sorted((r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(some, other).collect()) == sorted((r["doc_id"], len(model.encode(r["text"] or ""))) for r in some.collect())


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality(spark, odd, empty):
    for df in (odd, spark.read.parquet(f"{SF}/documents.parquet")):
        want = [(r["doc_id"], *brute_quality(r["text"])) for r in df.collect()]
        got = quality.quality_rules(df, None).collect()
        assert sorted([tuple(r)[:6] for r in got], key=str) == sorted(want, key=str)
        assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in got)
    assert quality.quality_rules(empty, None).count() == 0
    assert quality.keep_quality(odd, None).columns == odd.columns
    assert quality.fit_quality(empty, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = (x[:, 0] < 0.5).astype(float) * (rng.random(3000) < 0.95)
    trees = quality.fit_trees(x, y, [-1, 0, 1], rounds=20)
    line = np.stack([np.linspace(0, 1, 200), np.full(200, 0.3), np.full(200, 0.7)], axis=1)
    assert (np.diff(trees.score(line)) <= 1e-12).all()
    line = np.stack([np.full(200, 0.45), np.full(200, 0.3), np.linspace(0, 1, 200)], axis=1)
    assert (np.diff(trees.score(line)) >= -1e-12).all()
    assert ((trees.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.95


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.fit_quality(docs, labels.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in quality.quality_rules(docs, trees).collect()}
    test = [(got[r["doc_id"]], r["quality"]) for r in labels.where("doc_id % 2 = 1").collect()]
    assert np.mean([(g["quality_score"] >= trees.threshold) == bool(q) for g, q in test]) > 0.9


@pytest.mark.parametrize("table", ["sf", "odd"])
def test_token_store(spark, odd, empty, table):
    df = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    tok = Tokenizer.from_file(PATH)
    start, want = 0, []
    for r in sorted(df.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")):
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_store.token_store(df, PATH, file_ids=50_000, block=1000).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    if table == "odd":
        assert token_store.token_store(empty, PATH).count() == 0


@pytest.mark.parametrize("n, top, block", [(0, 5, 7), (1, 5, 7), (7, 5, 7), (8, 5, 7), (5000, 65536, 512), (5000, 3, 512), (4097, 49408, 4096), (3000, 1 << 32, 1000)])
def test_range_coder(n, top, block):
    rng = np.random.default_rng(n)
    ids = (np.minimum(rng.zipf(1.3, n) % top, top - 1) if top < 1 << 32 else rng.choice(rng.integers(0, top, 200), n)).astype(np.uint32)
    coded = token_store.encode_blocks(ids, block)
    assert (token_store.decode_blocks(coded, n, block) == ids).all()
    cuts = [0, *sorted(rng.integers(0, n + 1, min(n, 20)).tolist()), n]  # documents from no ids to several blocks
    names = [None if i % 5 == 4 else -i for i in range(len(cuts) - 1)]
    out = io.BytesIO()
    file = token_store.TokenFile(out, block)
    for name, a, b in zip(names, cuts, cuts[1:]):
        file.add([name], np.array([b - a]), ids[a:b])
    file.close()
    read = lambda data: [row for part in token_store.read_file(pa.BufferReader(bytes(data))) for row in zip(part[0], part[1].tolist(), part[2].tolist(), part[3])]
    want = [(name, a, b - a, zlib.crc32(ids[a:b].tobytes())) for name, a, b in zip(names, cuts, cuts[1:])]
    assert read(out.getvalue()) == (want if n else [])
    if n > 100:
        assert top == 1 << 32 or sum(map(len, coded)) < n  # under 16 bits an id
        for at in (-3, len(out.getvalue()) // 2, 20, len(out.getvalue()) - 60):
            broken = bytearray(out.getvalue())
            broken[at] ^= 1
            with pytest.raises(ValueError):
                read(broken)


def test_pieces_give_the_librarys_ids():
    tok = Tokenizer.from_file(PATH)
    rng = np.random.default_rng(0)
    marks = list("ßÀéàÿ×÷ÞaBzQ1²'<|>é\u0301İ\u0130\u00a0 \n_#.\x1c\x00ΣΑς©漢½") + ["<|endoftext|>", "n't", "'LL", " ", "a" * 17, "é" * 8, "é" * 9]
    texts = ["", " ", "İstanbul ẞ ΣΑΣ don't X'S y'all'd !!'s x'sy a<|endoftext|>b 123abc45 q" + "w" * 16, "©® © a©b", "<|", "\n\n"]
    texts += ["".join(marks[k] for k in rng.integers(0, len(marks), rng.integers(1, 40))) for _ in range(3000)]
    want = [[*e.ids, 2] for e in tok.encode_batch(texts, add_special_tokens=False)]
    table = PieceTable(PATH, limit=500, word_bytes=20_000)  # it starts anew between batches
    for a in range(0, len(texts), 301):
        ids, n = table.encode([t.encode() for t in texts[a : a + 301]], 2)
        assert n.tolist() == [len(w) for w in want[a : a + 301]] and ids.tolist() == [x for w in want[a : a + 301] for x in w]
        assert (table.lengths([t.encode() for t in texts[a : a + 301]]) == n - 1).all()
    other = public_tokenizers.path("byte_bpe_50k.json")  # a file whose tokens reach over spaces: whole texts
    assert PieceTable(other).encode([b"a b  c", b""], 7)[0].tolist() == [*Tokenizer.from_file(other).encode("a b  c", add_special_tokens=False).ids, 7, 7]


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("table", ["sf", "odd"])
def test_mixing(spark, odd, table):
    df = odd if table == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix_plan(df, block_words=2000).collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows if r["doc_id"]) == sorted((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in df.collect() if r["doc_id"])
    sizes = Counter()
    taken = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["shard"] is not None
    target = water_fill(sizes)
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] for r in rows)
    longest = {s: max(r["size"] for r in rows if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= 0.5 + longest[s] / 2 for s in sizes)
    assert all(r["size"] == 0 or r["taken"] % r["size"] == 0 for r in rows)  # whole documents only
    assert sorted(map(str, mixing.mix_plan(df, block_words=2000).collect())) == sorted(map(str, rows))


def test_mixing_tree_and_documents(spark, odd, empty):
    blocks = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 1), (None, 301)], "source string, blocks long")
    rows = mixing.splitting_tree(blocks, levels=3).collect()
    total = Counter()
    for r in rows:
        total[r["source"]] += r["n"]
    assert total == {"a": 1000, "b": 10, "c": 1, None: 301}
    by_shard = Counter()
    for r in rows:
        by_shard[r["shard"]] += r["n"]
    assert max(by_shard.values()) - min(by_shard.values()) <= 3 and len(by_shard) == 8
    shares = [r["n"] for r in rows if r["source"] == "a"]
    assert 90 < min(shares) and max(shares) < 160
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    mixed = mixing.mix_documents(odd)
    assert mixed.columns == odd.columns
    clash = odd.select("doc_id", "text", "source", *[F.lit(k).alias(c) for k, c in enumerate(("copies", "cut", "plan_id", "words_", "words", "shard", "place", "copy", "row", "size", "block", "s_", "h"))])
    got, want = Counter(), Counter()
    for r in mixing.mix_documents(clash).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert (r["copies"], r["place"], r["h"]) == (0, 6, 12)
    for r in mixing.mix_plan(clash).collect():
        want[r["doc_id"]] += r["taken"]
    assert got == +want


def test_mixing_draws_through_the_tree(spark):
    """What is taken is what the shards draw: the first blocks of each one's pool, as many as the tree gave it."""
    texts = [(d, f"t{d} " + "w " * (d % 17), "abc"[d % 3]) for d in range(9000)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    sets = {}
    for seed, levels in ((42, 3), (42, 1), (7, 3)):
        options = mixing.OPTIONS | {"share": 0.7, "block_words": 120, "seed": seed, "levels": levels}
        small = mixing._rows(df, seed)
        sources = {r["source"]: r for r in mixing._drawn(small, **options).collect()}
        rows = mixing.mix_plan(df, **options).collect()
        block = {(r["doc_id"], r["source"]): r["h"] % sources[r["source"]]["blocks"] for r in small.collect()}
        sets[seed, levels] = {r["doc_id"] for r in rows if r["taken"] > r["size"] * sources[r["source"]]["rounds"]}
        for s, known in sources.items():
            pools = sorted(known["pools"], key=lambda p: p["first"])
            assert sum(p["n"] for p in pools) == known["blocks"] and sum(p["drawn"] for p in pools) == known["quota"]
            assert [p["first"] for p in pools] == [sum(q["n"] for q in pools[:i]) for i in range(len(pools))]
            pool_of = lambda b: next(p for p in pools if p["first"] <= b < p["first"] + p["n"])  # noqa: E731, B023
            words, lacks = Counter(), round(known["target"]) - known["rounds"] * known["source_size"]
            for r in rows:
                if r["source"] == s:
                    b = block[r["doc_id"], s]
                    assert r["shard"] == pool_of(b)["shard"]
                    words[b] += r["size"]
            order = sorted(words, key=lambda b: (b - pool_of(b)["first"] >= pool_of(b)["drawn"], b))
            begin = 0
            for b in order:
                extra = sum(r["taken"] - known["rounds"] * r["size"] for r in rows if r["source"] == s and block[r["doc_id"], s] == b)
                assert abs(extra - max(0, min(words[b], lacks - begin))) <= 9  # half of the longest document
                begin += words[b]
    first = sets[42, 3]
    assert all(len(first & other) < 0.95 * len(first) for k, other in sets.items() if k != (42, 3))


def test_rows_with_equal_or_no_ids(spark, odd):
    got, want = Counter(), Counter()
    for r in mixing.mix_documents(odd).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    for r in mixing.mix_plan(odd).collect():
        want[r["doc_id"]] += r["taken"]
    assert got == +want and got[5] and got[None]
    rng = np.random.default_rng(0)
    a, b, c, d = (" ".join(f"{x}{i}" for i in rng.integers(0, 9999, 80)) for x in "abcd")
    table = spark.createDataFrame([(5, a), (5, b), (3, b), (5, c), (5, c), (None, a), (None, d), (None, d)], "doc_id long, text string")
    kept = [tuple(r) for r in simhash.drop_near_duplicates(table).collect()]
    assert Counter(kept) == Counter([(5, a), (3, b), (5, c), (None, d)])


def test_mixing_shards_hold_the_mix(spark):
    # weights a 3, b 1, c 2: b is over its weight (0.5 times its size), a under it
    texts = [(d, f"t{d} " + "w " * 9, "abbbbcc"[d % 7]) for d in range(14_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    rows = mixing.mix_plan(df, share=1.0, block_words=100).collect()
    target = {r["source"]: r["target"] / r["source_size"] for r in rows}
    assert target["a"] > 1 and target["b"] < 1
    taken, places = Counter(), {}
    for r in rows:
        taken[r["shard"], r["source"]] += r["taken"]
        places.setdefault(r["shard"], []).append((r["place"], r["source"]))
    for s in "abc":
        whole = sum(taken[k, s] for k in range(8))
        assert all(0.7 < taken[k, s] / (whole / 8) < 1.3 for k in range(8)), (s, taken)
    got = [(r["doc_id"], r["source"]) for r in mixing.mix_documents(df, share=1.0, block_words=100).collect()]
    shard = {r["doc_id"]: r["shard"] for r in rows}
    order = [shard[d] for d, _ in got]
    assert order == sorted(order) and Counter(got) == Counter({(r["doc_id"], r["source"]): r["copies"] for r in rows if r["taken"]})
    first = [s for (_, s), k in zip(got, order) if k == 0]
    assert sum(a != b for a, b in zip(first, first[1:])) > 0.3 * len(first)  # shuffled inside the shard, not source by source


def test_decontamination(spark, odd, empty):
    rng = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(3000)]
    say = lambda n: [vocabulary[i] for i in rng.integers(0, 3000, n)]
    items = [say(int(n)) for n in rng.integers(12, 60, 30)]
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)] + [(90, None, "x"), (91, "too short", "x")], "item_id long, text string, score string")
    rows, want = [], set()
    for d in range(300):
        words = say(200)
        if d % 3 == 0:
            item = d // 3 % 30
            copy = [w if rng.random() > 0.15 * (d % 2) else vocabulary[rng.integers(0, 3000)] for w in items[item]]
            if d % 5 == 0:
                del copy[len(copy) // 2]
            words[100:100] = copy
            want.add((d, item))
        rows.append((d, (" ".join(words) if d % 2 else ", ".join(words).upper()), "s"))
    docs = spark.createDataFrame([*rows, (1000, None, "s"), (1001, "", "s"), (None, " ".join(items[3]), "s")], "doc_id long, text string, score string")
    got = decontaminate.contaminated(docs, bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] is not None}
    assert len(pairs & want) >= 0.95 * len(want) and not pairs - want
    assert any(r["doc_id"] is None and r["item_id"] == 3 and r["score"] == 1 for r in got)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, _ in pairs})
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(odd, bench).count() == 0


def test_decontamination_of_partial_copies(spark):
    item = [f"q{i}" for i in range(40)]
    twice = ["la", "li", "lo", "lu", *(f"r{i}" for i in range(20)), "la", "li", "lo", "lu"]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(twice)), (None, " ".join(f"z{i}" for i in range(15)))], "item_id long, text string")
    # 5,000 documents hold 24 of the 40 words, 300 the last 17 and one all; 300 share 8 words only
    texts = [item[:24]] * 5000 + [item[23:]] * 300 + [item] + [item[8:16]] * 300 + [twice] + [[f"z{i}" for i in range(15)]]
    docs = spark.createDataFrame([(d, f"before{d} " + " ".join(t) + f" after{d}") for d, t in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, bench).collect()}
    want = {(d, 1): 0.6 for d in range(5000)} | {(d, 1): 17 / 40 for d in range(5000, 5300)} | {(5300, 1): 1.0, (5601, 2): 1.0, (5602, None): 1.0}
    assert got == pytest.approx(want)
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()) == list(range(5301, 5601))


def test_decontamination_of_edited_copies(spark):
    rng = np.random.default_rng(5)
    item = [[f"i{i}w{k}" for k in range(int(m))] for i, m in enumerate(rng.integers(10, 60, 40))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(item)], "item_id long, text string")
    other = lambda n: [f"o{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    for every in (3, 4, 5):  # words replaced at a steady distance
        texts += [[w if k % every else other(1)[0] for k, w in enumerate(words, 1)] for words in item]
    for share in (0.1, 0.2, 0.3, 0.4):  # words replaced, left out or put in anywhere
        for words in item:
            copy = []
            for w in words:
                edit = rng.integers(0, 3) if rng.random() < share else 3
                copy += [other(1), [], [w, *other(1)], [w]][edit]
            texts.append(copy)
    texts = [[*other(30), *t, *other(30)] for t in texts] + [other(200) for _ in range(50)]
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    code = {w: k for k, w in enumerate({w for t in [*texts, *item] for w in t})}
    number = lambda ws: np.array([code[w] for w in ws])
    # every document aligned with every item, whatever they share
    want = {}
    for i, words in enumerate(item):
        for d, score in enumerate(decontaminate.align([number(words)] * len(texts), [number(t) for t in texts]) / (2 * len(words))):
            if score >= 0.4:
                want[d, i] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert len(want) > 200 and not got.keys() - want.keys() and len(got) >= 0.98 * len(want)
    assert np.mean([got[p] == pytest.approx(want[p]) for p in got]) > 0.98
    # with every third or fourth word replaced none is lost
    steady = {p for p in want if p[0] < 120}
    assert len(steady) >= 118 and steady <= got.keys()


def test_alignment():
    def brute(q, t):
        h, best = np.zeros((len(q) + 1, len(t) + 1), int), 0
        for i in range(1, len(q) + 1):
            for j in range(1, len(t) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if q[i - 1] == t[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
                best = max(best, h[i, j])
        return best

    rng = np.random.default_rng(0)
    pairs = [(rng.integers(0, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 40))) for _ in range(80)]
    assert decontaminate.align([q for q, _ in pairs], [t for _, t in pairs]).tolist() == [brute(q, t) for q, t in pairs]


def test_language_id(spark, odd, empty):
    rows = queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r["lang_pred"] == true[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.95 and len(rows) == 1000
    trees = language_id.ContextTrees.fit({"xx": [b"abab abab abab ba"], "yy": [b"zz zz"]}, 2)
    # code lengths are those of a distribution: all bytes that can follow a context sum to at most one
    total = sum(2 ** -trees.cost(language_id.grams(b"    ab" + bytes([97, b]), 2))[:, 0] for b in range(256))[0]
    assert 0.5 < total <= 1 + 1e-6
    got = {r["doc_id"]: r for r in language_id.identify_languages(odd, trees).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (2, 3, 4, 9)) and got[1]["lang_pred"] in ("xx", "yy")
    assert language_id.identify_languages(empty, trees).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(odd, language_id.fit_languages(empty)).collect()} == {"und"}


def test_code_lengths_against_brute_force(spark):
    """Bits of whole texts, also in pieces, as a plain dictionary of contexts gives them."""
    rng = np.random.default_rng(3)
    say = lambda letters, n: " ".join("".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(1, 7))) for _ in range(n))
    sample = {"aa": [say("abcde", 60), say("abé", 30)], "bb": [say("cdefg", 80)]}
    order = 3
    trees = language_id.ContextTrees.fit({k: [t.encode() for t in v] for k, v in sample.items()}, order)

    def line(text):
        return bytes(7) + b"".join(b" " + w for w in text.lower().encode().split())

    seen = {k: {} for k in sample}
    for k, texts in sample.items():
        for t in map(line, texts):
            for i in range(7, len(t)):
                for n in range(order + 1):
                    seen[k].setdefault(t[i - n : i], Counter())[t[i]] += 1

    def bits(k, text):
        total, t = 0.0, line(text)
        for i in range(7, len(t)):
            for n in range(order, -1, -1):
                after = seen[k].get(t[i - n : i])
                if after is None:
                    continue
                whole = sum(after.values()) + len(after)
                if t[i] in after:
                    total += np.log2(whole / after[t[i]])
                    break
                total += np.log2(whole / len(after))
            else:
                total += 8
        return total

    tests = [say("abcdefgxyzé", int(n)) for n in rng.integers(1, 300, 25)]
    df = spark.createDataFrame(list(enumerate(tests)), "doc_id long, text string")
    for size in (1 << 19, 50):
        for r in language_id.identify_languages(df, trees, batch_bytes=size).collect():
            want = {k: bits(k, tests[r["doc_id"]]) for k in sample}
            assert r["lang_pred"] == min(want, key=want.get) and abs(r["bits"] - min(want.values())) < 1e-3 * min(want.values())


def test_every_language_is_learned(spark):
    names = [f"l{i:03d}" for i in range(300)]
    rows = [(i, f"word{x} " * 3 + chr(200 + i % 40) * 5, x, None) for i, x in enumerate(names)] + [(1000, "y" * 50_000, "long", None), (1001, None, "null", None)]
    trees = language_id.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string, h string"), max_rows=100, max_bytes=1000)
    assert trees.languages == sorted([*names, "long"])


def test_warc(spark, empty, tmp_path):
    rows = [(3, "u3", "a" * 200), (1, "u1\r\nX: y", "a" * 200), (2, None, "b" * 50), (4, "u4", "b" * 50), (5, "u5", None), (6, "u6", ""), (None, "u", "a" * 200), (1, "u1", "a" * 200), (7, "ü", "\r\n\r\nWARC/1.1\r\n" + "é" * 90_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = sorted([tuple(r) for r in warc.round_trip(pages).collect()], key=str)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        first = min((p for p, _, h in rows if h == html and p is not None), default=None)
        revisit = len(body) >= 100 and page != first
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.where("false")).count() == 0
    folder = warc.archive_pages(pages, f"file://{tmp_path}/w", file_bytes=1000)
    assert len([f for f in os.listdir(tmp_path / "w") if f.endswith(".warc")]) > 1
    some = warc.read_warc(spark, folder).where("target_uri = 'u4' and record_type in ('response', 'x')")
    assert some.count() == 1
    reader = warc.WarcReader(folder, True, 1 << 20)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("content_length",), 3)]))
    assert len(left) == 1 and reader.wanted == {"record_type": {"revisit"}}
    assert [bytes(r["payload"]) for r in some.collect()] == [b"b" * 50]
    assert warc.read_warc(spark, folder, payload="false").where("payload is not null").count() == 0
    packed = tmp_path / "gz"
    packed.mkdir()
    whole = sorted([r.asDict() for r in warc.read_warc(spark, folder).collect()], key=str)
    for name in os.listdir(tmp_path / "w"):  # a member for each half of the bytes, as archives may be packed
        if name.endswith(".warc"):
            data = (tmp_path / "w" / name).read_bytes()
            (packed / f"{name}.gz").write_bytes(gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]))
    assert sorted([r.asDict() for r in warc.read_warc(spark, f"file://{packed}").collect()], key=str) == whole
    assert warc.read_warc(spark, f"file://{packed}", payload="false").where("record_type = 'revisit'").count() == sum(r["record_type"] == "revisit" for r in whole) == 2
    record = lambda head, block=b"": b"WARC/1.1\r\n" + head + b"\r\n\r\n" + block + b"\r\n\r\n"
    read = lambda data: list(warc.records(pa.BufferReader(data), {}, True))
    assert [r["target_uri"] for r in read(record(b"WARC-Target-URI: \xff\r\nContent-Length: 0"))] == ["\ufffd"]
    for bad in (record(b"WARC-Type: x"), record(b"Content-Length: 9", b"short")[:-8], b"WARC/1.1\r\nContent-Length: 1", b"HTTP\r\n\r\n"):
        with pytest.raises(ValueError):
            read(bad)


def test_kneser_ney(spark, odd, empty):
    texts = ["a b c a b", "A b d", "c", "", None, "a b c a b zz"]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    model = ngram_lm.fit_kneser_ney(docs, shards=3)
    words = [[*WORD.findall((t or "").lower()), "</s>"] for t in texts]
    uni = Counter(w for ws in words for w in ws)
    pairs = Counter(p for ws in words for p in zip(["<s>", *ws], ws))
    left = Counter(w for _, w in pairs)
    n, v = sum(uni.values()), len(uni)
    assert (model.tokens, model.distinct, model.texts, model.left_total) == (n, v, len(texts), len(pairs))
    of = lambda c: [sum(x == k for x in c.values()) for k in range(5)]
    assert model.pair_of[1:] == of(pairs)[1:] and model.left_of[1:] == of(left)[1:]
    d2, d1 = ngram_lm.discounts(of(pairs)), ngram_lm.discounts(of(left))

    def lower(w):
        rest = sum(d1[min(c, 3)] for c in left.values()) / len(pairs)
        return max(left[w] - d1[min(left[w], 3)], 0) / len(pairs) + rest / (v + 1)

    def chance(h, w):
        after = {b: c for (a, b), c in pairs.items() if a == h}
        if not after:
            return lower(w)
        total = sum(after.values())
        return max(after.get(w, 0) - d2[min(after.get(w, 0), 3)], 0) / total + sum(d2[min(c, 3)] for c in after.values()) / total * lower(w)

    assert abs(sum(chance("a", w) for w in uni) + chance("a", "unknown") - 1) < 1e-9
    test = [*texts, "b zz unknown a", "unknown"]
    got = {r["doc_id"]: r for r in ngram_lm.score_texts(spark.createDataFrame(list(enumerate(test)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(test):
        ws = [*WORD.findall((t or "").lower()), "</s>"]
        assert got[i]["n_tokens"] == len(ws) and got[i]["n_known"] == sum(uni[w] > 0 for w in ws)
        assert abs(got[i]["base_score"] - sum(log10((uni[w] + 1) / (n + v + 1)) for w in ws)) < 1e-9
        assert abs(got[i]["score"] - sum(log10(chance(h, w)) for h, w in zip(["<s>", *ws], ws))) < 1e-9
    assert ngram_lm.score_texts(odd, ngram_lm.fit_kneser_ney(odd)).count() == 10
    assert ngram_lm.score_texts(empty, model).count() == 0
    nothing = ngram_lm.score_texts(odd, ngram_lm.fit_kneser_ney(empty)).collect()
    assert len(nothing) == 10 and all(r["n_known"] == 0 and np.isfinite(r["score"]) for r in nothing)


def test_lm_held_out(spark):
    rows = queries.op10_lm_scoring(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
