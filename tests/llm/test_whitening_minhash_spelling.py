"""Whitening, MinHash components and spelling variants against brute force, and on odd rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_llm_operators import DOC, ODD, SF, WORD

from trackweave.llm import minhash, queries, spelling, whitening


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def check_whitening(vectors, rows):
    """vectors: (id, list) without those to drop."""
    x = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for i, v in vectors}
    fit = np.array(sorted({tuple(v.tolist()) for v in x.values()}))
    n, sums = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov((fit - fit.mean(axis=0)).T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    assert len(rows) == len(x) * min(16, len(sums))
    signs = {}
    for r in rows:
        k, v = r["component"] - 1, x[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == sum(d * d for d in (n * v - sums).tolist())
        assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-6) and r["identity_error"] < 1e-6
        want = (v - sums / n) @ axes[:, k] / values[k] ** 0.5
        if abs(want) > 1e-3:
            signs.setdefault(k, set()).add(np.sign(want) == np.sign(r["whitened"]))
        assert abs(r["whitened"]) == pytest.approx(abs(want), abs=1e-6)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening(spark):
    got = queries.op11_whitening(spark, SF).collect()
    check_whitening([(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()], got)
    assert [r["whitened"] for r in got] == [r["whitened"] for r in queries.op11_whitening(spark, SF).collect()]


def test_whitening_odd_rows(spark):
    kind = "vec_id long, embedding array<float>, component int, n string, x array<long>"
    rng = np.random.default_rng(1)
    good = [(i, [float(np.float32(v)) for v in rng.normal(size=3)]) for i in range(40)]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 0.0]), (94, [float("inf"), 0.0, 0.0]), (95, [1.0]), (96, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v, 7, "x", [1]) for i, v in [*good, (41, good[0][1]), *bad]], kind)
    rows = whitening.whiten(df, whitening.fit_whitening(df)).collect()
    check_whitening([*good, (41, good[0][1])], rows)
    fit = whitening.fit_whitening(df.where("vec_id in (0, 41)"))  # one distinct vector: nothing varies
    rows = whitening.whiten(df.where("vec_id < 2"), fit).collect()
    assert {(r["n"], r["whitened"], r["explained"]) for r in rows} == {(1, None, None)} and any(r["deviation"] for r in rows)
    nothing = df.where("vec_id > 89 and vec_id < 95")
    assert whitening.fit_whitening(nothing) is None and whitening.whiten(nothing, None).count() == 0
    assert whitening.whiten(nothing, fit).count() == 0
    large = spark.createDataFrame([(i, [1e30 * (i % 2), float(i)]) for i in range(4000)], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(large, whitening.fit_whitening(large)).collect()} == {None}


def brute_minhash(docs, percent=80):
    sets = {}
    for i, text in docs:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = [i for i in sorted(sets) if sets[i]]
    for n, i in enumerate(ids):
        for j in ids[:n]:
            small, large = sorted((len(sets[i]), len(sets[j])))
            if 100 * small >= percent * large:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (small + large - both):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.integers(1 << 30)}" for w in words)


def test_minhash_links_what_brute_force_links(spark):
    rng = np.random.default_rng(5)
    docs = []
    for group in range(12):
        words = [f"w{v}" for v in rng.integers(0, 5000, rng.integers(30, 200))]
        docs += [edited(rng, words, share) for share in rng.uniform(0, 0.06, 12)]
    # a group of which only the first text is near all others: 99 % of the pairs lie just below the threshold
    words = [f"v{k}" for k in range(120)]
    docs += [" ".join(words)] + [" ".join(w if k not in {5 + i % 100, 10 + (i * 7) % 100} else f"x{i}" for k, w in enumerate(words)) for i in range(150)]
    docs += ["", "a b", "A  B", "a b c", " \n ", "a b c d"]
    docs = list(enumerate(docs, 1))
    want = brute_minhash(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for options in ({}, {"rows": 16}, {"weight": 3000}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.minhash_components(table, **options).collect()}
        assert got == want


def test_minhash_large_groups_in_chunks(spark):
    rng = np.random.default_rng(6)
    words = [f"w{v}" for v in range(80)]
    docs = list(enumerate([edited(rng, words, 0.02) for _ in range(60)]))
    sig = [minhash.signature(minhash.shingle_set(t.encode()))[: minhash.KEPT].astype(np.uint8).tobytes() for _, t in docs]
    members = spark.createDataFrame([(g, i, 1, bytearray(s)) for (i, _), s in zip(docs, sig) for g in (1, 2)] + [(3, 1, 1, bytearray(sig[1]))], "`group` long, node long, weight int, low binary")
    low = members.select("node", "low").dropDuplicates(["node"])
    compare = lambda s, joined: minhash.likely(s, joined, minhash.least_matches(0.8, 1e-6))
    links = minhash.group_links(members.select("group", "node", "weight"), "low", lambda p: p.join(low, "node"), compare, rows=16, weight=1 << 40).collect()
    root = list(range(60))
    for r in links:
        root = [min(root[r["a"]], root[r["b"]]) if v in (root[r["a"]], root[r["b"]]) else v for v in root]
    assert len(set(root)) < 6


def test_bayesian_bounds():
    least = minhash.least_matches(0.8, 1e-6)
    assert least == sorted(least) and len(least) == minhash.KEPT // minhash.STEP
    rng = np.random.default_rng(0)
    trials = rng.random((200_000, minhash.KEPT)) < 0.8
    ends = np.cumsum(trials, axis=1)[:, minhash.STEP - 1 :: minhash.STEP]
    assert (ends < least).any(axis=1).mean() < 1e-4  # few pairs at the threshold are dropped
    assert ((rng.random((2000, minhash.KEPT)) < 0.4).sum(axis=1) < least[-1]).all()


def test_minhash_odd_rows(spark, odd, empty):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.minhash_components(odd).collect()]
    assert len(got) == len(ODD)
    by_id = {g[0]: g[1:] for g in got}
    assert by_id[2] == (0, 2, True) and by_id[3] == (0, 3, True) and by_id[4] == (0, 4, True)
    assert sum(g[0] == 5 for g in got) == 2 and by_id[5][1:] == (5, True)
    assert by_id[None][1:] == (None, False) and by_id[8] == (1, 8, True)  # the text without an id says one line once
    clash = odd.selectExpr("*", "1 AS node", "2 AS id", "3 AS `group`", "4 AS root", "'x' AS bands")
    assert minhash.minhash_components(clash).count() == len(ODD) and minhash.minhash_components(empty).count() == 0


def brute_words(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def brute_variants(n):
    keys = {}
    for w in n:
        for i in range(len(w) + 1):
            keys.setdefault(w[:i] + "*" + w[i:], set()).add(w)  # another word has one more here
            if i < len(w):
                keys.setdefault(w[:i] + "*" + w[i + 1 :], set()).add(w)
    near = {w: set() for w in n}
    for group in keys.values():
        for a in group:
            near[a] |= group - {a}
    near = {w: {v for v in others if abs(len(v) - len(w)) <= 1 and distance_one(w, v)} for w, others in near.items()}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top and n[top] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_word(df):
    rows = df.collect()
    assert len(rows) == len({r["word"] for r in rows})
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def test_spelling(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute_variants(brute_words(docs))
    assert by_word(queries.op13_spelling(spark, SF)) == want
    assert sum(v[0] is not None for v in want.values()) > 5


def test_spelling_made_up_words(spark):
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abé"), rng.integers(7, 10))): int(rng.integers(2, 2000)) for _ in range(1500)}
    words |= {"zzzzzzz": 5, "zzzzzzzz": 60, "yzzzzzz": 60, "zzzzzzzzz": 700, "aaaaaaa": 4, "𝒳aaaaaa": 3}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(5)
    want = brute_variants(words)
    assert by_word(spelling.variant_groups(table)) == want
    assert by_word(spelling.variant_groups(table, shard_words=20)) == want  # each key over the bound: words dealt, queries copied
    assert want["zzzzzzz"][:2] == ("yzzzzzz", "yzzzzzz") and want["zzzzzzzz"][:2] == ("zzzzzzzzz", "zzzzzzzzz")


def test_automaton_numbers_words():
    words = sorted({"tap", "taps", "top", "tops", "stop", "stops", "", "sto"})
    automaton = spelling.Automaton(words)
    assert [automaton.walk(w, automaton.start, 0)[1] for w in words] == list(range(len(words)))
    assert len(automaton.edges) < sum(map(len, words)) / 2  # common endings are shared
    assert spelling.Automaton([]).walk("a", 0, 0) is None


def test_spelling_odd_rows(spark, odd, empty):
    assert by_word(spelling.spelling_variants(odd)) == brute_variants(brute_words([(r[0], r[1]) for r in ODD]))
    clash = odd.selectExpr("*", "1 AS word", "2 AS run", "3 AS h", "4 AS id")
    assert by_word(spelling.spelling_variants(clash)) == by_word(spelling.spelling_variants(odd))
    assert spelling.spelling_variants(empty).count() == 0
