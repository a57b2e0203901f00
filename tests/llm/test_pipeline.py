"""The pipeline against a plain version of each stage, and its stages on odd rows."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_llm_operators import DOC, ODD, WORD, brute_components, brute_fingerprint
from trackweave.llm import decontaminate, mixing, quality

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def align_all(item, words):
    """Best local alignment of an item anywhere in a text, one row of the matrix at a time."""
    row, best = np.zeros(len(words) + 1, int), 0
    for q in item:
        old, row = row, np.zeros(len(words) + 1, int)
        for j, w in enumerate(words, 1):
            row[j] = max(0, old[j - 1] + (2 if w == q else -1), old[j] - 1, row[j - 1] - 1)
        best = max(best, int(row.max()))
    return best / (2 * len(item))


def plain(text):
    out = [w.lower().strip(decontaminate.STRIP) for w in WORD.findall(text or "")]
    return [w for w in out if w]


def brute_contaminated(docs, items):
    """(doc, item) of all pairs with an alignment of 0.4 or more; where fewer of an item's words stand in the text none can be."""
    listed = [(i, plain(t)) for i, t in items]
    out = set()
    for d, text in docs:
        words = plain(text)
        mine = set(words)
        out |= {(d, i) for i, item in listed if item and sum(w in mine for w in item) >= 0.4 * len(item) and align_all(item, words) >= 0.4}
    return out


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    # 1: base rules and trees by the same statistics
    trees = quality.fit_quality(docs, labels)
    stats = {d: quality.document_stats((t or "").encode()) for d, t in text.items()}
    score = dict(zip(stats, trees.score(np.array([s[1] for s in stats.values()], np.float32).astype(float))))
    kept = {d for d, (s, _) in stats.items() if s[0] >= 20 and 100 * s[4] <= 30 * s[0] and score[d] >= trees.threshold}
    one = STAGE["quality rules"](spark, docs, SF)
    assert {r["doc_id"] for r in one.collect()} == kept and one.columns == docs.columns
    # 2: the smallest id of each component of fingerprints
    code = {d: brute_fingerprint(text[d]) for d in kept}
    root = brute_components(set(code.values()))
    least = {}
    for d, c in code.items():
        least[root[c]] = min(d, least.get(root[c], d))
    two = STAGE["near-duplicates"](spark, one, SF)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted(least.values())
    # 3: every item aligned with every whole text
    bad = brute_contaminated([(d, text[d]) for d in least.values()], [(r["item_id"], r["text"]) for r in benchmark.collect()])
    three = STAGE["decontamination"](spark, two, SF)
    assert {r["doc_id"] for r in three.collect()} == set(least.values()) - {d for d, _ in bad}
    # 4: as often as the plan takes each
    four = STAGE["mixing"](spark, three, SF)
    plan = {r["doc_id"]: r for r in mixing.mix_plan(three).collect()}
    rows = four.collect()
    assert four.columns == docs.columns and Counter(r["doc_id"] for r in rows) == +Counter({d: r["copies"] for d, r in plan.items()})
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == +Counter({d: r["taken"] for d, r in plan.items()})
    # 5: the library's ids, and run() gives all of it
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        want[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert [a for a, _ in ends] == [0, *[b for _, b in ends[:-1]]]


@pytest.mark.parametrize("name", list(STAGE))
def test_stages_on_odd_rows(spark, name):
    docs = spark.createDataFrame(ODD, DOC).withColumnRenamed("n", "copies").withColumnRenamed("key", "shard")
    out = STAGE[name](spark, docs, SF)
    rows = out.collect()
    ids = Counter(r["doc_id"] for r in rows)
    if name == "token output":
        assert ids == Counter(d for d, *_ in ODD) and {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 4)} == {1}
    else:
        assert out.columns == docs.columns
    if name == "quality rules":
        assert not set(ids) & {2, 3, 4, 9}
    if name == "near-duplicates":
        apart = min((brute_fingerprint(ODD[6][1]) ^ brute_fingerprint(t)).bit_count() for d, t, *_ in ODD if d is not None) > 4
        assert ids[5] == 1 and ids[2] == 1 and not ids[3] and ids[1] and ids[None] == int(apart)
    if name == "decontamination":
        assert ids == Counter(d for d, *_ in ODD)
    if name == "mixing":
        assert not set(ids) & {2, 3, 4} and ids[None]
    none = STAGE[name](spark, docs.where("1 = 0"), SF)
    assert none.count() == 0


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(5)
    say = lambda n: [f"w{i}" for i in rng.integers(0, 400, n)]
    items = [say(int(n)) for n in rng.integers(4, 40, 12)]
    texts = []
    for d in range(80):
        words = say(int(rng.integers(0, 120)))
        for _ in range(rng.integers(0, 3)):  # whole, partial and edited copies
            item = items[rng.integers(0, len(items))]
            a, b = sorted(rng.integers(0, len(item) + 1, 2))
            piece = [w if rng.random() > 0.15 else "other" for w in item[a:b]]
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = piece
        texts.append((d, " ".join(words)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    want = brute_contaminated(texts, [(i, " ".join(w)) for i, w in enumerate(items)])
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert want and found <= want and len(want - found) <= 0.1 * len(want)
    # two words reach the threshold of an item of four or five, and hold no seed of three
    assert all(len(items[i]) < 6 for _, i in want - found)
