"""Which of many texts hold which of many patterns, without comparing every text with every pattern."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept

#: Patterns and keys are broadcast up to so many rows (counted first); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Patterns that every task holds as a whole have at most so many characters.
BROADCAST_CHARACTERS = 16_000_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def only(df: DataFrame, few: DataFrame, on: str) -> DataFrame:
    """The rows of ``df`` whose ``on`` is in ``few``, which is broadcast if it is bounded, so that no text is shuffled to be dropped."""
    return df.join(bounded(few.select(on).distinct()), on, "left_semi")


def words(x: str | Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def inner_words(x: str) -> Column:
    """The words of a pattern without its first and last: they stand in a text as whole words."""
    every = words(x)
    return F.array_distinct(F.slice(every, F.lit(2), F.greatest(F.size(every) - 2, F.lit(0))))


def character_pairs(x: str) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(2))))


def _met(texts: DataFrame, patterns: DataFrame, of_text: Column, of_pattern: Column) -> DataFrame:
    """Pairs (text_id, pattern_id) by the rarest key of each pattern; keys of patterns are whole keys of texts."""
    keyed = kept(patterns.select("pattern_id", F.explode(of_pattern).alias("key")), "pattern-keys")
    known = bounded(keyed.select("key").distinct())
    hit = kept(texts.select("text_id", F.explode(F.array_distinct(of_text)).alias("key")).join(known, "key", "left_semi"), "key-hits")
    count = hit.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # a pattern with a key that no text has stands nowhere
    rarest = keyed.join(count, "key", "left").groupBy("pattern_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k")).where("k.n > 0").select("pattern_id", F.col("k.key").alias("key"))
    return hit.join(bounded(rarest), "key").select("text_id", "pattern_id")


def _looked_up(texts: DataFrame, patterns: DataFrame, whole: bool) -> DataFrame | None:
    """(text_id, pattern_id) of texts that hold a pattern, where the patterns fit a task: two passes over the texts, and nothing but counts and hits is shuffled.

    The first counts the texts of every word of a pattern, the second looks patterns up by the rarest. Texts and patterns are split alike.
    """
    spark = texts.sparkSession
    size = patterns.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("size")).first()
    if size["n"] > BROADCAST_ROWS or size["size"] > BROADCAST_CHARACTERS:
        return None
    rows = patterns.select("pattern_id", "pattern").collect()  # counted
    own = [sorted(set(words if whole else words[1:-1])) for words in (r["pattern"].split() for r in rows)]
    keys = sorted({w for every in own for w in every})
    sent = spark.sparkContext.broadcast({w: i for i, w in enumerate(keys)})

    def count(batches):
        place = sent.value
        known, total = frozenset(place), [0] * len(place)
        for batch in batches:
            for text in batch["text"].to_pylist():
                for w in known.intersection(text.split()):
                    total[place[w]] += 1
        met = [(i, n) for i, n in enumerate(total) if n]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in met], pa.int64()) for k in range(2)], ["key", "n"])

    n = dict(texts.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n")).collect())
    place, by_key = sent.value, {}
    for at, every in enumerate(own):
        rarest = min(((n.get(place[w], 0), w) for w in every), default=(0, ""))
        if rarest[0]:
            by_key.setdefault(rarest[1], []).append((at, rows[at]["pattern"]))
    looked = spark.sparkContext.broadcast(by_key)

    def find(batches):
        by_key = looked.value
        known = frozenset(by_key)
        for batch in batches:
            met = [(row, at) for row, text in enumerate(batch["text"].to_pylist()) for w in known.intersection(text.split()) for at, pattern in by_key[w] if pattern in text]
            yield pa.RecordBatch.from_arrays([batch["text_id"].take(pa.array([x[0] for x in met], pa.int64())), pa.array([x[1] for x in met], pa.int64())], ["text_id", "at"])

    found = texts.select("text_id", "text").mapInArrow(find, f"text_id {texts.schema['text_id'].dataType.simpleString()}, at long")
    ids = spark.createDataFrame([(i, r["pattern_id"]) for i, r in enumerate(rows)], f"at long, pattern_id {patterns.schema['pattern_id'].dataType.simpleString()}")
    return found.join(F.broadcast(ids), "at").select("text_id", "pattern_id")


def piece_size(length: int) -> int:
    """The size of the piece by which a string of this length is looked up: all of it up to 12 characters, two thirds at least beyond."""
    if length <= 12:
        return length
    power = 1 << (length.bit_length() - 1)
    return power + power // 2 if length >= power + power // 2 else power


def _windows(sizes: list[int]):
    """Makes (word, key) of words: every run of characters of one of these sizes."""

    def run(batches):
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for word in batch["word"].to_pylist():
                for size in sizes:
                    if size > len(word):
                        break
                    keys = {word[i : i + size] for i in range(len(word) - size + 1)}
                    out[0].extend([word] * len(keys))
                    out[1].extend(keys)
                    if len(out[1]) * len(word) >= 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["word", "key"])
                        out = ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in out], ["word", "key"])

    return run


def _in_words(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(text_id, pattern_id), each once, of texts with a word that holds the longest word of a pattern.

    Patterns are looked up among the different words of all texts, by their first characters, and each text by its words.
    """
    longest = F.array_max(F.transform(words("pattern"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    known = patterns.select("pattern_id", longest.alias("x")).select("pattern_id", F.col("x.w").alias("piece"), F.col("x.n").alias("n"))
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())  # different lengths of words in patterns
    size = F.create_map(*[F.lit(x) for n in lengths for x in (n, piece_size(n))])[F.col("n")]
    known = kept(known.select("pattern_id", "piece", F.substring("piece", F.lit(1), size).alias("key")), "pattern-pieces")
    own = texts.select("text_id", F.explode(F.array_distinct(words("text"))).alias("word")).where(F.length("word") >= lengths[0])
    near = own.select("word").distinct().mapInArrow(_windows(sorted({piece_size(n) for n in lengths})), "word string, key string").join(bounded(known), "key")
    held = kept(near.where(F.contains("word", "piece")).groupBy("word").agg(F.collect_set("pattern_id").alias("held")), "words-held")
    found = own.join(bounded(held), "word").groupBy("text_id").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
    return found.select("text_id", F.explode("held").alias("pattern_id"))


def contained(texts: DataFrame, patterns: DataFrame, whole_words: bool = False) -> DataFrame:
    """(text_id, pattern_id) of every text that holds a pattern as it stands; texts: text_id, text; patterns: pattern_id, pattern.

    A pattern of three words or more is looked up by the rarest of its inner words, any other by its longest word
    among the different words of the texts; blanks alone are looked up by their pairs. What is
    met is compared as a whole. ``whole_words`` says that patterns begin and end with a blank, so that all their words are whole. Null texts and null or empty patterns are in no pair; ids must be unique.
    """
    texts = texts.where("text IS NOT NULL")
    own = words if whole_words else inner_words
    patterns = kept(patterns.where("length(pattern) > 0").select("pattern_id", "pattern", F.size(own("pattern")).alias("inner"), F.size(words("pattern")).alias("words"), F.col("pattern").rlike(r"\s").alias("blank")), "patterns")
    found, met = [], []
    some = lambda condition: bool(patterns.where(condition).limit(1).count())
    if some("inner > 0"):
        long = patterns.where("inner > 0")
        looked = _looked_up(texts, long, whole_words)
        if looked is not None:
            found.append(looked)
        else:
            met.append(_met(texts, long, words("text"), own("pattern")))
    if some("inner = 0 AND words > 0 AND blank"):
        met.append(_in_words(texts, patterns.where("inner = 0 AND words > 0 AND blank")))
    if some("inner = 0 AND words = 0"):
        pairs = F.when(F.length("text") > 0, F.concat(character_pairs("text"), F.split("text", ""))).otherwise(F.array().cast("array<string>"))
        met.append(_met(texts, patterns.where("inner = 0 AND words = 0"), pairs, F.when(F.length("pattern") > 1, character_pairs("pattern")).otherwise(F.array("pattern"))))
    if some("inner = 0 AND words > 0 AND NOT blank"):
        # what stands in a word of a text stands in the text
        found.append(_in_words(texts, patterns.where("inner = 0 AND words > 0 AND NOT blank")))
    if met:
        both = reduce(DataFrame.unionByName, met).join(bounded(patterns.select("pattern_id", "pattern")), "pattern_id").join(texts.select("text_id", "text"), "text_id")
        found.append(both.where(F.contains("text", "pattern")).select("text_id", "pattern_id"))
    return reduce(DataFrame.unionByName, found) if found else texts.select("text_id").crossJoin(patterns.select("pattern_id")).limit(0)
