"""Spelling variants: words at one edit, found by a frontier that walks a trie as a relation.

The words lie in a path-compressed trie kept as an edge table (node, label, child).  A
node is the 64-bit hash of a prefix; what a hash collision could add is removed by the
edit distance at the end, and it can hide nothing.  A frontier row is (word, position,
node, edits).  Words stand on their own path with no edit; level 0 spends the one edit
on an edge that leaves that path (replace, insert or delete at the first difference),
and every further level joins the rows with the edges that continue with the word's
next letters.  A row at the end of its word on a node where a word ends is a neighbour.
Levels run until no row is left: as many as a path has branches after the edit.

Two tries halve the work at the top: the first difference of two words lies in the
later half of the word, or, read backwards, the later half of the mirrored word.  So
only the lower halves of both tries exist and no word starts at the root.  Edges name
the letters that may follow, so most rows end before they are shuffled.  A node that
many words pass is salted by their number, with its (few) edges repeated.  No table is
broadcast: all grow with the words, and Spark sizes prefixes, paths and edges too low.

``corpus_words`` counts the words; ``variants`` works on any (word, n) table of distinct
non-empty words.  Null text has no words; a null id never deletes a letter.  Repeated
rows count each for itself.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.llm.common import by_merge, python_ready, table, written
from txnwatch.llm.lexicon import ragged
from txnwatch.llm.token_counts import grouped

RUN = "[A-Za-zÀ-ÿ]+"
EVERY = 199               # a run whose hash this divides loses a letter
MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
SHARE = 4096              # words that share one salt of a node
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END, _BITS = 62, 61      # bit of a word's end; letters share the others


def corpus_words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS,
                 min_count: int = MIN_COUNT) -> DataFrame:
    """word and n: the letter runs of all texts, some with one letter left out."""
    runs = df.select(F.col(doc_id).cast("long").cast("string").alias("_id"),
                     F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0))).alias("_run"))
    runs = runs.where(F.char_length("_run") >= min_letters).withColumn("_run", F.translate("_run", _UPPER, _LOWER))
    runs = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    less = F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.char_length("_run")))
    words = runs.select(F.when(F.col("_h") % EVERY == 0, less).otherwise(F.col("_run")).alias("word"))
    words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.where((F.char_length("word") >= min_letters) & (F.col("n") >= min_count))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefixes(words: list[str], mirrored: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every prefix from the middle on: the word's place, its depth, its hash and the letter after it (0: end)."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(w[::-1] if mirrored else w for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(len(codes)) - np.repeat(first, size)
    powers = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
    sums = np.r_[np.uint64(0), np.cumsum(_mix(codes) * powers[place])]
    # prefixes as deep as the middle of a word one letter shorter
    top = size // 2 if mirrored else (size - 1) // 2
    own = np.repeat(np.arange(len(words)), size - top + 1)
    depth = ragged(top, size - top + 1)
    value = sums[first[own] + depth] - sums[first[own]] + depth.astype(np.uint64) * np.uint64(2) + np.uint64(mirrored)
    after = np.r_[codes, np.uint64(0)][np.minimum(first[own] + depth, len(codes))]
    return own, depth, _mix(value).view(np.int64), np.where(depth < size[own], after, 0).astype(np.int64)


def _prefix_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for s in grouped(b["word"]):
            part = b.iloc[s]
            for mirrored in (False, True):
                own, depth, node, after = _prefixes(part["word"].tolist(), mirrored)
                yield pd.DataFrame({"wid": part["wid"].to_numpy()[own], "mirrored": mirrored, "depth": depth.astype(np.int32),
                                    "node": node, "next": after.astype(np.int32)})


def _bit(letter: Column) -> Column:
    """The bit of the letter that follows (0 and empty: the end)."""
    place = F.when(letter == 0, F.lit(_END)).otherwise(letter % _BITS).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _may_follow(at: Column, following: Column) -> Column:
    """Whether the letter of ``text`` after position ``at`` (or its end) is among ``following``."""
    letter = F.when(at == F.char_length("text"), F.lit(0)).otherwise(F.ascii(F.col("text").substr(at + 1, F.lit(1))))
    return following.bitwiseAND(_bit(letter)) != 0


def trie(words: DataFrame) -> DataFrame:
    """The stored path of every word and mirrored word (wid, word, n): text, and path as an array of
    (depth, node, following, salts), its last element the node where the word ends."""
    rows = words.select("wid", "word").mapInPandas(_prefix_rows, "wid long, mirrored boolean, depth int, node long, next int")
    # a node that branches, or where a word ends
    nodes = rows.groupBy("node").agg(F.min("next").alias("_low"), F.max("next").alias("_high"), F.bit_or(_bit(F.col("next"))).alias("following"),
                                     F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("salts"))
    nodes = written(nodes.where((F.col("_low") < F.col("_high")) | (F.col("_low") == 0)).drop("_low", "_high"), "spelling-nodes")
    paths = rows.select("wid", "mirrored", "depth", "node").join(by_merge(nodes), "node").groupBy("wid", "mirrored").agg(
        F.sort_array(F.collect_list(F.struct("depth", "node", "following", "salts"))).alias("path"))
    text = F.when(F.col("mirrored"), F.reverse("word")).otherwise(F.col("word"))
    return written(paths.join(by_merge(words), "wid").select("wid", "mirrored", text.alias("text"), "n", "path"), "spelling-paths")


def edge_table(paths: DataFrame) -> DataFrame:
    """One stored row per edge: node, first (letter), label, child, following (letters after the child), salts."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.struct(
        F.col("path")[k - 1]["node"].alias("node"),
        F.col("text").substr(F.col("path")[k - 1]["depth"] + 1, F.col("path")[k]["depth"] - F.col("path")[k - 1]["depth"]).alias("label"),
        F.col("path")[k]["node"].alias("child"), F.col("path")[k]["following"].alias("following"), F.col("path")[k - 1]["salts"].alias("salts")))
    edges = paths.where(F.size("path") > 1).select(F.explode(steps).alias("e")).select("e.*").distinct()
    return written(edges.withColumn("first", F.substring("label", 1, 1)), "spelling-edges")


def _spend_edit(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Level 0: rows (wid, mirrored, text, position, node) that have left their own path by one edit."""
    size = F.char_length("text")
    middle = F.when(F.col("mirrored"), F.ceil(size / 2)).otherwise(F.floor(size / 2))
    own = paths.select("wid", "mirrored", "text", F.explode("path").alias("p")).where(F.col("p.depth") >= middle)
    own = own.select("wid", "mirrored", "text", F.col("p.depth").alias("depth"), F.col("p.node").alias("node"),
                     F.col("p.following").alias("here"), F.pmod(F.hash("wid"), F.col("p.salts")).alias("salt"))
    # the word without its last letter is a word
    shorter = own.where((F.col("depth") == size - 1) & (F.col("here").bitwiseAND(F.lit(1 << _END)) != 0)) \
        .select("wid", "mirrored", "text", size.alias("position"), "node")
    salted = edges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    text, depth, label, n = F.col("text"), F.col("depth"), F.col("label"), F.char_length("label")
    tail = F.substring(label, 2, 1 << 30)
    replaced = F.when(text.substr(depth + 2, n - 1) == tail, depth + n)
    inserted = F.when(text.substr(depth + 1, n - 1) == tail, depth + n - 1)
    deleted = F.when(text.substr(depth + 2, n) == label, depth + n + 1)
    rows = own.join(by_merge(salted), ["node", "salt"]).where(F.col("first") != text.substr(depth + 1, F.lit(1)))
    rows = rows.select("wid", "mirrored", "text", "child", "following", F.explode(F.array(replaced, inserted, deleted)).alias("position"))
    rows = rows.where(F.col("position") <= size).where(_may_follow(F.col("position"), F.col("following")))
    return rows.select("wid", "mirrored", "text", "position", F.col("child").alias("node")).unionByName(shorter)


def _next_level(live: DataFrame, edges: DataFrame) -> DataFrame:
    at, label = F.col("position"), F.col("label")
    rows = live.withColumn("first", F.col("text").substr(at + 1, F.lit(1))).join(by_merge(edges.drop("salts")), ["node", "first"])
    rows = rows.where(F.col("text").substr(at + 1, F.char_length(label)) == label).withColumn("position", at + F.char_length(label))
    return rows.where(_may_follow(F.col("position"), F.col("following"))).select(
        "wid", "mirrored", "text", "position", F.col("child").alias("node"))


def neighbours(words: DataFrame) -> DataFrame:
    """Both directions of every pair at one edit, of a stored table (wid, word, n): wid, near, near_n."""
    python_ready(words.sparkSession)
    paths = trie(words)
    edges = edge_table(paths)
    ended = []
    states = written(_spend_edit(paths, edges), "spelling-frontier")
    while True:
        ended.append(states.where(F.col("position") == F.char_length("text")))
        live = states.where(F.col("position") < F.char_length("text"))
        if live.isEmpty():
            break
        states = written(_next_level(live, edges), "spelling-frontier")
    done = ended[0]
    for more in ended[1:]:
        done = done.unionByName(more)
    words_at = paths.select(F.element_at("path", -1)["node"].alias("node"), F.col("text").alias("other"), F.col("n").alias("near_n"))
    pairs = done.join(by_merge(words_at), "node").where(F.levenshtein("text", "other", 1) == 1)
    near = F.when(F.col("mirrored"), F.reverse("other")).otherwise(F.col("other"))
    return pairs.select("wid", near.alias("near"), "near_n").distinct()


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of a table of distinct words (word, n)."""
    words = written(words.select("word", F.col("n").cast("long").alias("n"), F.monotonically_increasing_id().alias("wid")), "spelling-words")
    best = neighbours(words).groupBy("wid").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    much = -F.col("best.m") >= ratio * F.col("n")
    formed = written(words.join(by_merge(best), "wid", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(much, F.col("best.w")).alias("form"), F.when(much, -F.col("best.m")).alias("form_n")), "spelling-forms")
    # follow the forms; counts grow by ``ratio`` at every step, so chains are short
    step = formed.where(F.col("form").isNotNull()).select(F.col("word").alias("root"), F.col("form").alias("further"))
    open_, closed = step.select(F.col("root").alias("word"), F.col("further").alias("root")), []
    while not open_.isEmpty():
        moved = written(open_.join(by_merge(step), "root", "left"), "spelling-roots")
        closed.append(moved.where(F.col("further").isNull()).select("word", "root"))
        open_ = moved.where(F.col("further").isNotNull()).select("word", F.col("further").alias("root"))
    columns = ["word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"]
    if not closed:
        return formed.withColumn("root", F.col("word")).select(*columns)
    roots = closed[0]
    for more in closed[1:]:
        roots = roots.unionByName(more)
    return formed.join(by_merge(roots), "word", "left").select(*columns)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(corpus_words(table(spark, sf_dir, "documents")))
