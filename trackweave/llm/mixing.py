"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import WORD_BREAK, written

#: Weights by rank of the source, repeating (fixed values of the contract).
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    """Words of a text: the parts between runs of white space, less the empty ends."""
    text = F.coalesce(text, F.lit(""))
    return F.size(F.array_remove(F.split(text, WORD_BREAK), "")).cast("long")


def source_targets(sizes: DataFrame, *, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources by code point, null last, weigh weights in turn. Targets share
    share times all words by weight; one that would exceed most times its
    source stops there and the others take its excess by weight. As that fill
    level only rises, a source stops exactly if its cap per weight is at most
    the level that the sources with larger caps share.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (rank % len(weights) + 1).cast("int"))
    caps = sizes.withColumn("weight", w).withColumn("cap", most * F.col("source_size")).withColumn("per", F.col("cap") / F.col("weight"))
    order = Window.orderBy("per", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    above = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(everything) - before) / above
    placed = caps.withColumn("level", level)
    # the first source in this order whose cap is over the level sets it for all later ones
    placed = placed.withColumn("fill", F.min(F.when(F.col("per") > F.col("level"), F.struct("per", "level"))).over(everything)["level"])
    target = F.when(F.col("fill").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("fill")))
    return placed.select("source", "source_size", target.alias("target"))


def _log_factorial(n: Column) -> Column:
    """Stirling's series from 10 on (error under 1e-10), the product below."""
    x = n + 1.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    exact = F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))
    return F.when(n < 10, exact).otherwise(series)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of good among drawn out of total, by inverting the distribution at u.

    The chances are summed over 12 standard deviations about the mean, which
    holds all but 1e-30 of them.
    """
    def chosen(n: Column, k: Column) -> Column:
        return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)

    mean = drawn * good / F.greatest(total, F.lit(1.0))
    spread = F.ceil(12 * F.sqrt(mean * (1 - good / F.greatest(total, F.lit(1.0))) + 1)).cast("double")
    low = F.greatest(F.lit(0.0), good + drawn - total, F.floor(mean) - spread)
    high = F.least(good, drawn, F.ceil(mean) + spread)
    steps = F.sequence(low.cast("long"), F.greatest(low, high).cast("long"))
    chance = lambda k: F.exp(chosen(good, k) + chosen(total - good, drawn - k) - chosen(total, drawn))
    start = F.struct(F.lit(0.0).alias("sum"), low.alias("at"))
    passed = F.aggregate(
        steps, start,
        lambda acc, k: F.when(acc["sum"] >= u, acc).otherwise(F.struct((acc["sum"] + chance(k.cast("double"))).alias("sum"), k.cast("double").alias("at"))),
    )
    return passed["at"]


def splitting_tree(blocks: DataFrame, *, levels: int = 3, seed: int = 42) -> DataFrame:
    """(source, shard, first, n): how many of each source's blocks go to each of 2^levels shards.

    blocks: one row per source with its number of blocks; with a further column
    times, one row per source and times, and each value of times has a tree of
    its own (times is then a column of the result). At every node the blocks of
    all sources are split in halves as by drawing without
    replacement: in the order of the sources, each takes a hypergeometric share of what the left half
    has room for. first is where the shard's range of the source's permuted blocks begins.
    """
    by = [c for c in blocks.columns if c == "times"]
    salt = F.col("times") if by else F.lit(0)
    order = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", F.col("blocks").cast("double").alias("n"))))
    nodes = blocks.groupBy(*by).agg(order.alias("quota")).withColumn("node", F.lit(0))
    for level in range(levels):
        room = F.aggregate("quota", F.lit(0.0), lambda a, q: a + q["n"])
        nodes = nodes.withColumn("total", room)
        uniform = lambda i: (F.xxhash64(F.lit(seed), F.lit(level), F.col("node"), salt, i).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)
        # the left half has room for half the blocks; the odd one goes left or right by a coin
        coin = (uniform(F.lit(-1)) < 0.5).cast("double")
        start = F.struct(F.col("total").alias("total"), F.floor((F.col("total") + coin) / 2).cast("double").alias("room"), F.lit(0).alias("i"), F.array().cast("array<double>").alias("left"))

        def draw(acc, q):
            k = hypergeometric(acc["total"], q["n"], acc["room"], uniform(acc["i"]))
            return F.struct((acc["total"] - q["n"]).alias("total"), (acc["room"] - k).alias("room"), (acc["i"] + 1).alias("i"), F.concat(acc["left"], F.array(k)).alias("left"))

        # written apart: an expression that holds itself several times would grow with every level
        drawn = written(nodes.select(*by, "node", "quota", F.aggregate("quota", start, draw)["left"].alias("left")), "split")
        side = lambda right: F.transform("quota", lambda q, i: F.struct(q["last"].alias("last"), q["source"].alias("source"), (q["n"] - F.get("left", i) if right else F.get("left", i)).alias("n")))
        both = F.array(F.struct((2 * F.col("node")).alias("node"), side(False).alias("quota")), F.struct((2 * F.col("node") + 1).alias("node"), side(True).alias("quota")))
        nodes = drawn.select(*by, F.explode(both).alias("x")).select(*by, "x.*")
    flat = nodes.select(*by, F.col("node").alias("shard"), F.explode("quota").alias("q")).select(F.col("q.source").alias("source"), *by, "shard", F.col("q.n").cast("long").alias("n"))
    by_source = Window.partitionBy(*by, "source").orderBy("shard")
    return flat.withColumn("first", F.sum("n").over(by_source) - F.col("n"))


def _drawn(sizes: DataFrame, *, share: float, most: float, block_words: int, most_blocks: int, levels: int, seed: int) -> DataFrame:
    """What each source's documents need to know, one row per source: targets, rounds, blocks, the shards' pools and where the draw ends.

    sizes: source, size, h of all documents. Every source has blocks of about
    block_words words, at most most_blocks of them. Its quota of blocks to draw
    once more than in whole rounds is split among the shards by one tree, the
    rest by another; a shard's pool is a range of the permuted blocks, of which
    it draws the first ones. seam is the block in which the words drawn reach
    what the source lacks, in the order of drawn blocks by shard, then those
    left; before is how many words come before it.
    """
    goal = F.round("target").cast("long")
    of_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0)
    targets = source_targets(of_source, share=share, most=most).withColumn("goal", goal).withColumn("rounds", rounds)
    targets = targets.withColumns({"blocks": F.least(F.lit(most_blocks), F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words))).cast("long"), "lacks": F.col("goal") - F.col("rounds") * F.col("source_size")})
    quota = F.when(F.col("source_size") > 0, F.round(F.col("lacks") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    sid = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    targets = written(targets.withColumns({"quota": quota, "sid": sid}), "targets")

    parts = F.explode(F.array(F.struct((F.col("rounds") + 1).alias("times"), F.col("quota").alias("blocks")), F.struct(F.col("rounds").alias("times"), (F.col("blocks") - F.col("quota")).alias("blocks"))))
    tree = splitting_tree(targets.select(F.col("sid").alias("source"), parts.alias("p")).select("source", "p.*"), levels=levels, seed=seed)
    shards = tree.withColumnRenamed("source", "sid").join(targets.select("sid", "rounds"), "sid").groupBy("sid", "shard").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("times") > F.col("rounds"), F.col("n")).otherwise(0)).alias("drawn"))
    first = F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n")
    pools = shards.withColumn("first", first).where("n > 0").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("first", "n", "drawn", "shard"))).alias("pools"))
    known = targets.join(pools, "sid")
    placed = _in_pool(_joined(sizes, known)).groupBy("sid", "block", "order").agg(F.sum("size").alias("words"), F.first("lacks").alias("lacks"))
    w = Window.partitionBy("sid").orderBy("order")
    runs = placed.withColumn("before", F.sum("words").over(w) - F.col("words"))
    seam = runs.where((F.col("before") < F.col("lacks")) & (F.col("before") + F.col("words") > F.col("lacks")))
    seam = seam.groupBy("sid").agg(F.min(F.struct("before", "block", "order")).alias("seam"))
    # all blocks lie before the seam of a source that lacks just as many words as blocks end at
    reached = runs.where(F.col("before") + F.col("words") <= F.col("lacks")).groupBy("sid").agg(F.max("order").alias("reached"))
    return written(known.join(seam, "sid", "left").join(reached, "sid", "left"), "pools")


def _joined(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (source, h and others) with the row of their source (a small table) and their block."""
    known = sources.withColumnRenamed("source", "s_")
    return rows.join(known, F.col("source").eqNullSafe(F.col("s_"))).drop("s_").withColumn("block", F.pmod("h", "blocks"))


def _in_pool(rows: DataFrame) -> DataFrame:
    """Adds the shard of the block, whether that draws it, and its place in the order of the draw."""
    pool = F.get(F.filter("pools", lambda p: (p["first"] <= F.col("block")) & (F.col("block") < p["first"] + p["n"])), F.lit(0))
    out = rows.withColumn("pool_", pool)
    drawn = F.col("block") - F.col("pool_.first") < F.col("pool_.drawn")
    return out.withColumns({"shard": F.col("pool_.shard"), "order": F.struct((~drawn).alias("left"), F.col("block").alias("at"))}).drop("pool_")


OPTIONS = {"share": 1.5, "most": 2.0, "block_words": 1 << 16, "most_blocks": 1 << 16, "levels": 3, "seed": 42}


def _taken(rows: DataFrame, sources: DataFrame, size: Column, seed: int) -> DataFrame:
    """rows (doc_id, source, h and others) with size, rounds, extra, full, shard and place, from what _drawn says of their sources.

    Only the documents of each source's seam block are ordered, by a second
    hash, and the one there at which the source has its words is taken whole or
    not at all, whichever ends nearer to them.
    """
    placed = _in_pool(_joined(rows, sources))
    at_seam = F.coalesce(F.col("block") == F.col("seam.block"), F.lit(False))
    whole = F.coalesce(F.col("order") <= F.col("reached"), F.lit(False))
    plain = placed.where(~at_seam).withColumn("size", size)
    plain = plain.withColumns({"extra": F.when(whole, F.col("size")).otherwise(0).cast("long"), "nth": F.lit(0)})
    w = Window.partitionBy("sid").orderBy(F.xxhash64("h", F.lit(seed + 1)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    seam = placed.where(at_seam).withColumn("size", size)
    left = F.col("lacks") - F.col("seam.before") - (F.sum("size").over(w) - F.col("size"))
    seam = seam.withColumns({"extra": F.when((left > 0) & (2 * left >= F.col("size")), F.col("size")).otherwise(0).cast("long"), "nth": F.row_number().over(w)})
    return plain.unionByName(seam).withColumn("place", F.xxhash64("h", "nth", F.lit(seed + 2)))


def _rows(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"), word_count(F.col("text")).alias("size"))


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken, copies, shard, place.

    Every document is taken floor(target / source_size) times; what then lacks
    is drawn in blocks. A hash deals the documents of a source into blocks in
    permuted order. The splitting tree shares the source's exact quota of
    blocks, and in a tree of its own those that aren't drawn, among 2^levels
    shards; each shard has a disjoint pool of blocks and draws its first ones.
    As blocks differ in words, the draw goes on into blocks left over or stops
    short in the last one drawn until the source has its rounded target; the
    document at which that is reached is taken whole or not at all, whichever
    ends nearer, so a source is off by half a document at most. In every shard sources have their shares of the mix
    but for the chance of the draw; place orders the rows of a shard at random.

    Only sums of at most most_blocks blocks of a source are ordered, and the
    documents of one block.

    Options: share, most, block_words, most_blocks, levels, seed. Null text has
    no words and is taken 0 words; null sources form one source, ranked last;
    rows with equal ids and texts are ordered as one after the other (they are
    alike); an empty table gives an empty result; further columns are ignored,
    whatever their names. Reruns agree, as hashes take the place of chance.
    """
    o = OPTIONS | options
    small = written(_rows(docs, o["seed"]), "sizes")
    out = _taken(small.withColumnRenamed("size", "words_"), _drawn(small, **o), F.col("words_"), o["seed"])
    full = (F.col("extra") == F.col("size")) & (F.col("size") > 0)
    taken = F.col("rounds") * F.col("size") + F.col("extra")
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), (F.col("rounds") + full.cast("long")).alias("copies"), "shard", "place")


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, in the columns of docs, ordered by shard and, inside it, by chance.

    They are whole copies. Each row has its own share of the plan, also
    where ids or texts are null, empty or repeated; copies of a row are
    shuffled one by one; rows without words don't come. An empty table gives an
    empty result; further columns are kept, whatever their names. Texts are
    read twice, once for their sizes, and shuffled once, into the shards.
    """
    o = OPTIONS | options
    sources = _drawn(written(_rows(docs, o["seed"]).select("source", "h", "size"), "sizes"), **o)
    rows = docs.select("doc_id", "source", F.xxhash64("doc_id", "text", F.lit(o["seed"])).alias("h"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    worded = F.col("row.text").rlike(r"[^\x20\x09-\x0D]")
    out = _taken(rows.where(worded), sources, word_count(F.col("row.text")), o["seed"])
    full = F.col("extra") == F.col("size")
    copies = F.array_repeat(F.lit(0), (F.col("rounds") + full.cast("long")).cast("int"))
    spread = out.select("row", "shard", "place", F.posexplode(copies).alias("copy", "one")).orderBy("shard", F.xxhash64("place", "copy"))
    return spread.select(*[F.col("row")[c].alias(c) for c in docs.columns])
