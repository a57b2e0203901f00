"""Spelling variants: near words found by forward and backward minimal acyclic automata."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """Minimal acyclic automaton of sorted distinct words, with their numbers.

    A state is (edges, final): edges maps a character to (state, number of
    words that the smaller edges and the state's own end come before). The
    number of a word, its rank, is the sum of these along its path: a minimal
    perfect hash of the words.
    """

    def __init__(self, words: Iterable[str]):
        #: by state: {character: (state, words before)}, whether a word ends, words below
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.below: list[int] = []
        register: dict[tuple, int] = {}
        # the states of the last word, open: lists of (character, closed state) and whether a word ends
        path: list[list] = [[[], False]]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                edges, final = path.pop()
                key = (final, *edges)
                state = register.get(key)
                if state is None:
                    state = register[key] = self._state(edges, final)
                path[-1][0].append((last[len(path) - 1], state))

        for word in words:
            same, most = 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            close(same)
            path.extend([[], False] for _ in word[same:])
            path[-1][1] = True
            last = word
        close(0)
        self.start = self._state(*path[0])

    def _state(self, edges: list[tuple[str, int]], final: bool) -> int:
        before, numbered = int(final), {}
        for c, state in edges:
            numbered[c] = (state, before)
            before += self.below[state]
        self.edges.append(numbered)
        self.final.append(final)
        self.below.append(before)
        return len(self.edges) - 1

    def walk(self, text: str, state: int, number: int) -> tuple[int, int] | None:
        """State and number after text; None if no word goes that way."""
        for c in text:
            step = self.edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def complete(self, rest: str, state: int, number: int) -> Iterator[tuple[str, int]]:
        """Endings (and their words' numbers) that differ from rest by exactly one character inserted, deleted or replaced."""
        edges, final, walk = self.edges, self.final, self.walk
        for i in range(len(rest) + 1):
            c, tail = rest[i : i + 1], rest[i + 1 :]
            for x, (to, before) in edges[state].items():
                # x inserted before c; before an equal c it is the same word as after it
                if x != c and (end := walk(rest[i:], to, number + before)) and final[end[0]]:
                    yield rest[:i] + x + rest[i:], end[1]
                if c and x != c and (end := walk(tail, to, number + before)) and final[end[0]]:
                    yield rest[:i] + x + tail, end[1]
            if not c:
                return
            # c deleted; of a run of equal characters the last one
            if tail[:1] != c and (end := walk(tail, state, number)) and final[end[0]]:
                yield rest[:i] + tail, end[1]
            step = edges[state].get(c)
            if step is None:
                return
            state, number = step[0], number + step[1]


def near_in_shard(words: list[str], queries: Iterable[str], backward: bool) -> Iterator[tuple[str, str, int]]:
    """(query, near word, its number): the exact half is walked, the other completed with one error.

    Forward, the first half of a query is exact; backward, words and queries
    come reversed and the second half, of which the longer part is, is exact.
    """
    automaton = Automaton(words)
    for query in queries:
        half = (len(query) + 1) // 2 if backward else len(query) // 2
        at = automaton.walk(query[:half], automaton.start, 0)
        if at:
            for ending, number in automaton.complete(query[half:], *at):
                yield query, query[:half] + ending, number


def corpus_words(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shortest: int = 7, least: int = 2, drop_one_in: int = 31) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lower-cased, of at least `shortest` code points, that occur at least `least` times.

    Where drop_one_in divides the crc32 of `<id>:<run>`, the run loses the code
    point at that number modulo its length. Null texts have no runs; a null id
    counts as empty.
    """
    run, h = F.col("run"), F.col("h")
    runs = df.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text_column, UPPER, LOWER), F.lit(f"([A-Za-zÀ-ÿ]{{{shortest},}})"), 1)).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    words = hashed.select(F.when(h % drop_one_in == 0, cut).otherwise(run).alias("word")).where(F.char_length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def near_words(words: DataFrame, *, shard_words: int = 20_000, key: int = 3) -> DataFrame:
    """(word, near, near_n) for each pair of words (word, n), each of at least 2 * key code points, one error apart.

    One error leaves either the first or the second half of a word as it is,
    so near words share their first or their last `key` code points. Each
    direction deals words to shards by these, so many words to a shard on
    average; every word is looked up in the automaton of its own shard. A key
    of over shard_words words has its words dealt to several shards by a hash
    and its queries sent to each of them, so no automaton grows with a key.
    """
    both = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("backward"))
    both = both.withColumn("spelt", F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))).withColumn("key", F.substring("spelt", 1, key))
    sizes = both.groupBy("backward", "key").agg(F.count("*").alias("size"))
    total = words.count()
    shards = max(1, -(-total // shard_words))
    parts = F.ceil(F.col("size") / shard_words).cast("int")
    placed = both.join(sizes, ["backward", "key"]).withColumn("parts", parts)
    first = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    shard = lambda part: F.struct("backward", F.when(F.col("parts") > 1, F.col("key")).otherwise(F.lit("")).alias("key"), F.when(F.col("parts") > 1, part).otherwise(first).alias("number"))
    entries = placed.select(shard(F.pmod(F.xxhash64("spelt"), F.col("parts")).cast("int")).alias("shard"), F.lit(0).alias("query"), "spelt", "n")
    queries = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(shard(F.col("part")).alias("shard"), F.lit(1).alias("query"), "spelt", F.lit(0).cast("long").alias("n"))
    rows = entries.union(queries).select("shard.*", "query", "spelt", "n").repartition("backward", "key", "number").sortWithinPartitions("backward", "key", "number", "query", "spelt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found, automaton_words, counts, queries = None, [], [], [], []

        def close() -> None:
            for word, near, number in near_in_shard(automaton_words, queries, bool(at and at[0])):
                found.append((word[::-1], near[::-1], counts[number]) if at[0] else (word, near, counts[number]))
            automaton_words.clear(), counts.clear(), queries.clear()

        def out() -> pa.RecordBatch:
            word, near, n = zip(*found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

        for batch in batches:
            for backward, key_, number, query, spelt, n in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (backward, key_, number):
                    close()
                    at = (backward, key_, number)
                if query:
                    queries.append(spelt)
                else:
                    automaton_words.append(spelt)
                    counts.append(n)
            if found:
                yield out()
        close()
        if found:
            yield out()

    return rows.mapInArrow(run, "word string, near string, near_n long").distinct()


def variant_groups(words: DataFrame, *, times: int = 10, **options) -> DataFrame:
    """Per word of (word, n): form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point.
    The form is the near word of largest n, the smallest in code-point order
    among ties, if that n is at least times the word's; root is where following
    forms ends, the word itself without a form. Counts grow along forms, so
    there is no circle; each round doubles the steps followed.
    """
    words = written(words, "words")
    pairs = near_words(words, **options)
    best = F.min(F.struct((-F.col("near_n")).alias("fewer"), "near"))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.fewer")).alias("top"))
    fits = F.col("top") >= times * F.col("n")
    out = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("top")).alias("form_n"))
    out = written(out, "forms")
    links = written(out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = links.join(onward, "root", "left")
        if step.where("further is not null").isEmpty():
            break
        links = written(step.select("word", F.coalesce("further", "root").alias("root")), "roots")
    return out.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Words of df's whole texts with their commoner spelling: corpus_words(), then variant_groups().

    Rows with null or empty texts add no words; repeated rows count again;
    further columns are ignored; a table without words gives an empty result.
    """
    return variant_groups(corpus_words(df, id_column=id_column, text_column=text_column), **options)
