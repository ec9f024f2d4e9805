"""Inverted index and lexical ranking over batches of questions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import DEFAULT, Config
from ..functions import hangul
from ..functions.text import lower, more_tokens, query_tokens, tokens
from ..sources.scratch import kept
from . import scoring
from .containment import bounded

FIELDS = ("title", "body", "memory")
#: What was said of chunks is broadcast up to so many characters.
SAID = 32_000_000


def texts(chunks: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """(slot, title, text, said): what there is to search; confirmed questions are the memory of a chunk."""
    if memory is None:
        return chunks.select("slot", "title", "text", F.lit("").alias("said"))
    # what was said is short: where it is bounded, no text is shuffled for it
    said = memory.groupBy("slot").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("seq", "query"))), lambda x: x["query"]), " ").alias("said"))
    said = kept(said.withColumn("slot", F.col("slot").cast(chunks.schema["slot"].dataType)), "said")
    size = said.agg(F.coalesce(F.sum(F.length("said")), F.lit(0))).first()[0]
    return chunks.select("slot", "title", "text").join(bounded(said) if size <= SAID else said, "slot", "left").select("slot", "title", "text", F.coalesce("said", F.lit("")).alias("said"))


def tokenized(chunks: DataFrame, memory: DataFrame | None = None) -> DataFrame:
    """(slot, title_tokens, body_tokens, memory_tokens)."""
    return _tokenized(texts(chunks, memory), memory is None)


def _tokenized(texts: DataFrame, bare: bool = False) -> DataFrame:
    none = F.array().cast("array<string>")
    return texts.select("slot", tokens("title").alias("title_tokens"), tokens("text").alias("body_tokens"), (none if bare else tokens("said")).alias("memory_tokens"))


def postings(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(slot, term, tf_title, tf_body, tf_memory), one row for each term of a chunk; with ``only`` (term), of those terms.

    Nothing is shuffled unless slots repeat, whose counts are summed.
    """
    if only is None and not scoring.repeats(docs.select("slot")):
        return scoring.postings(docs)
    rows = docs.select("slot", F.posexplode(F.array(*[f"{f}_tokens" for f in FIELDS])).alias("f", "t")).select("slot", "f", F.explode("t").alias("term"))
    if only is not None:
        rows = rows.join(only, "term", "left_semi")
    return rows.groupBy("slot", "term").agg(*[F.sum((F.col("f") == k).cast("long")).alias(f"tf_{f}") for k, f in enumerate(FIELDS)])


@dataclass(frozen=True)
class Index:
    """What ranking reads: postings, lengths, one row of averages, and frequencies of terms."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    terms: DataFrame

    @staticmethod
    def of(docs: DataFrame | Index, terms: DataFrame | None = None) -> Index:
        """An index as it is, or one of tokenized chunks for these terms (term) alone."""
        if isinstance(docs, Index):
            return docs
        index = postings(docs, None if terms is None else bounded(terms.select("term").distinct()))
        if terms is not None:
            index = kept(index, "postings")
        return Index(index, lengths(docs), field_stats(docs), term_stats(index))

    @staticmethod
    def build(docs: DataFrame) -> Index:
        """The same as tables: texts are tokenized once, however many questions follow."""
        tokens_once = kept(docs, "tokens")
        index = kept(postings(tokens_once), "postings")
        return Index(index, kept(lengths(tokens_once), "lengths"), kept(field_stats(tokens_once), "stats"), kept(term_stats(index), "terms"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("slot", *[F.size(f"{f}_tokens").cast("long").alias(f"len_{f}") for f in FIELDS])


def field_stats(docs: DataFrame) -> DataFrame:
    """One row: number of chunks, and the average length of each field (1 where it would be 0)."""
    return averages(lengths(docs))


def averages(sizes: DataFrame) -> DataFrame:
    """``field_stats`` of lengths."""
    average = lambda f: F.coalesce(F.nullif(F.avg(f"len_{f}"), F.lit(0.0)), F.lit(1.0)).alias(f"avg_{f}")
    return sizes.agg(F.count(F.lit(1)).alias("n"), *[average(f) for f in FIELDS])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(term, df, dfe) as ``term_stats`` of all postings has it, counted from tokens without building them."""
    content = docs.select(F.explode(F.array_distinct(F.concat("title_tokens", "body_tokens"))).alias("term"), F.lit(1).alias("c"), F.lit(0).alias("e"))
    memory = docs.where(F.size("memory_tokens") > 0).select(F.explode(F.array_distinct("memory_tokens")).alias("term"), F.lit(0).alias("c"), F.lit(1).alias("e"))
    return content.unionByName(memory).groupBy("term").agg(F.sum("c").alias("df"), F.sum("e").alias("dfe"))


def term_stats(index: DataFrame) -> DataFrame:
    """(term, df, dfe): chunks with the term in their content, and in their memory."""
    content = (F.col("tf_title") + F.col("tf_body")) > 0
    return index.groupBy("term").agg(F.sum(content.cast("long")).alias("df"), F.sum((F.col("tf_memory") > 0).cast("long")).alias("dfe"))


def idf(n: Column, df: Column, power: float = DEFAULT.idf_pow) -> Column:
    """Rarity of a term; doubles throughout, as decimal literals would round it."""
    return F.pow(F.log(F.lit(1.0) + (n.cast("double") - df.cast("double") + F.lit(0.5)) / (df.cast("double") + F.lit(0.5))), F.lit(power))


def total(weight: Column) -> Column:
    """A score to nine places: sums come in any order, and equal texts must tie."""
    return F.round(F.sum(weight), 9).alias("score")


def memory_stats(docs: DataFrame, memory: DataFrame) -> DataFrame:
    """(term, df, dfe, n and averages) of the terms of memory; docs: ``texts`` with it. Of them only these terms are counted."""
    terms = kept(memory.select(F.explode(tokens("query")).alias("term")).distinct(), "memory-terms")
    if terms.count() <= scoring.TERMS:
        every = [r["term"] for r in terms.collect()]  # counted
        rows = kept(scoring.of_texts(searched(docs), every), "counted")
        if not scoring.repeats(rows):
            return counted_terms(rows, every).where("dfe > 0").crossJoin(F.broadcast(averages(rows)))
    docs = _tokenized(docs)
    return term_stats(postings(docs, bounded(terms))).where("dfe > 0").crossJoin(F.broadcast(field_stats(docs)))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of the terms that bear a question's subject."""
    return queries.select("query_id", F.explode(query_tokens("question")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def bm25(docs: DataFrame | Index, queries: DataFrame, config: Config = DEFAULT, multiplicity: bool = True) -> DataFrame:
    """(query_id, slot, score, complete) over bodies alone.

    ``complete`` tells that a whole Korean stem of the question was met.
    """
    terms = kept(query_terms(queries), "terms")
    ix = Index.of(docs, terms)
    index = ix.postings.where("tf_body > 0").select("slot", "term", F.col("tf_body").alias("tf"))
    # frequent terms have many postings: the question's side is sent to them, with the rarity of its terms
    rarity = index.join(bounded(terms.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = index.join(bounded(kept(terms.join(rarity, "term"), "asked-terms")), "term").join(ix.lengths.select("slot", "len_body"), "slot").crossJoin(F.broadcast(ix.stats.select("n", "avg_body")))
    length = F.greatest("len_body", F.lit(1)) / F.col("avg_body")
    weight = idf(F.col("n"), F.col("df"), config.idf_pow) * (config.k1 + 1) * F.col("tf") / (F.col("tf") + config.k1 * (1 - config.b + config.b * length))
    times = F.col("qtf") if multiplicity else F.lit(1)
    return hits.groupBy("query_id", "slot").agg(total(times * weight), F.max(F.col("term").startswith("#")).alias("complete"))


def bm25f(docs: DataFrame | Index, queries: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(query_id, slot, score, complete) over titles, bodies and memory.

    Memory is not normalised by length, counts in no content frequency, and lends a term its
    rarity only where no content has the term. A repeated question term counts once.
    """
    terms = kept(query_terms(queries).drop("qtf"), "terms")
    ix = Index.of(docs, terms)
    hits = ix.postings.join(bounded(kept(terms.join(ix.terms, "term"), "asked-terms")), "term").join(ix.lengths, "slot").crossJoin(F.broadcast(ix.stats))
    part = lambda f, w: w * F.col(f"tf_{f}") / (1 - config.b + config.b * (F.greatest(f"len_{f}", F.lit(1)) / F.col(f"avg_{f}")))
    tf = part("title", config.title_weight) + part("body", config.body_weight) + config.memory_weight * F.col("tf_memory")
    df = F.coalesce(F.nullif("df", F.lit(0)), F.col("dfe"))
    score = idf(F.col("n"), df, config.idf_pow) * tf * (config.k1 + 1) / (config.k1 + tf)
    return hits.groupBy("query_id", "slot").agg(total(score), F.max(F.col("term").startswith("#")).alias("complete"))


def coordinate(scores: DataFrame, recover: bool = True) -> DataFrame:
    """Where a question's whole Korean stem was met, only chunks with one; perhaps one more.

    The best of the others comes back if it beats the worst that is kept.
    """
    w = Window.partitionBy("query_id")
    marked = scores.withColumn("some", F.max("complete").over(w)).withColumn("kept", ~F.col("some") | F.col("complete"))
    if not recover:
        return marked.where("kept").select("query_id", "slot", "score")
    low = F.min(F.when(F.col("kept"), F.col("score"))).over(w)
    first = F.row_number().over(Window.partitionBy("query_id", "kept").orderBy(F.desc("score"), "slot"))
    marked = marked.withColumn("low", low).withColumn("r", first)
    return marked.where("kept OR (r = 1 AND score > low)").select("query_id", "slot", "score")


def top_k(scores: DataFrame, k: int, tie: str = "slot") -> DataFrame:
    """The k best of each question with their rank; scores that are not above 0 are no hits."""
    if k < 0:
        raise ValueError("k must not be negative")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), tie)
    return scores.where((F.col("score") > 0) & ~F.isnan("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Counted:
    """How often the terms of questions (query_id, term, qtf; terms in order) stand in each chunk, see ``scoring``."""

    rows: DataFrame
    asked: list
    terms: list[str]


def counted(docs: DataFrame | Index, queries: DataFrame) -> Counted | None:
    """Counts for ``best``, made in one pass over the chunks; none where slots repeat, or terms or questions are too many for a task."""
    asked = kept(query_terms(queries), "terms")
    if asked.limit(scoring.ASKED + 1).count() > scoring.ASKED or asked.select("term").distinct().count() > scoring.TERMS:
        return None
    every = asked.orderBy("query_id", "term").collect()  # counted
    terms = sorted({r["term"] for r in every})
    rows = kept(scoring.of_index(docs.postings, docs.lengths, terms) if isinstance(docs, Index) else scoring.of_texts(searched(docs), terms), "counted")
    return None if scoring.repeats(rows) else Counted(rows, every, terms)


def searched(docs: DataFrame) -> DataFrame:
    """``texts`` as ``scoring`` reads them: the stem of a word of a to z is told there, without tokens of all texts."""
    return docs.select("slot", *[x for f, c in zip(FIELDS, ("title", "text", "said"), strict=True) for x in (lower(c).alias(f), more_tokens(c).alias(f"{f}_more"))])


def best(docs: DataFrame | Index, queries: DataFrame, k: int, config: Config = DEFAULT, fielded: bool = True, multiplicity: bool = True, coordinated: bool = False, recover: bool = True, counts: Counted | None = None) -> DataFrame:
    """(query_id, slot, score, rank) of an index or ``texts``: ``top_k`` of ``bm25f`` or ``bm25``, with ``coordinate`` between them if asked for.

    Chunks are scored where they lie, and only the best of each task are shuffled. Where ``counted`` gives none, or ``k`` is
    too much for a task, pairs of question and chunk are summed by a shuffle instead. ``counts`` saves counting again.
    """
    counts = (counts or counted(docs, queries)) if 0 < k <= scoring.MOST else None
    if counts is not None:
        return _best(counts, queries.schema["query_id"].dataType, k, config, fielded, multiplicity, coordinated, recover)
    docs = docs if isinstance(docs, Index) else _tokenized(docs)
    scores = bm25f(docs, queries, config) if fielded else bm25(docs, queries, config, multiplicity)
    return top_k(coordinate(scores, recover) if coordinated else scores, k).select("query_id", "slot", "score", "rank")


def counted_terms(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(term, at, df, df_body, dfe) of the terms that counted chunks have."""
    return scoring.frequencies(rows, terms).join(F.broadcast(scoring.docs_of(rows.sparkSession, terms)), "at")


def _best(counts: Counted, kind: T.DataType, k: int, config: Config, fielded: bool, multiplicity: bool, coordinated: bool, recover: bool) -> DataFrame:
    counted, terms = counts.rows, counts.terms
    stats = averages(counted)
    df = F.coalesce(F.nullif("df", F.lit(0)), F.col("dfe")) if fielded else F.col("df_body")
    rarity = np.zeros(len(terms))
    for r in counted_terms(counted, terms).crossJoin(F.broadcast(stats)).select("at", idf(F.col("n"), df, config.idf_pow).alias("w")).collect():  # a row for each term
        rarity[r["at"]] = r["w"]
    one = stats.first()
    law = scoring.Law(rarity, tuple(one[f"avg_{f}"] for f in FIELDS), fielded, config.k1, config.b, (config.title_weight, config.body_weight, config.memory_weight))
    place, each = {t: i for i, t in enumerate(terms)}, {}
    for r in counts.asked:
        each.setdefault(r["query_id"], []).append((place[r["term"]], r["qtf"] if multiplicity and not fielded else 1))
    every, marked = list(each.items()), {i for i, t in enumerate(terms) if t.startswith("#")} if coordinated else set()
    found = counted.sparkSession.createDataFrame([], T.StructType([T.StructField("query_id", kind), *T._parse_datatype_string("slot long, score double, complete boolean, low double")]))
    for i in range(0, len(every), scoring.QUESTIONS):
        found = found.unionByName(scoring.hits(counted, law, every[i : i + scoring.QUESTIONS], kind, marked, k))
    if marked:
        w = Window.partitionBy("query_id")
        found = found.withColumn("some", F.max("complete").over(w)).withColumn("low", F.min("low").over(w)).where("slot IS NOT NULL").withColumn("kept", ~F.col("some") | F.col("complete"))
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "kept").orderBy(F.desc("score"), "slot")))
        found = found.where("kept OR (r = 1 AND score > low)" if recover else "kept")
    return top_k(found.select("query_id", "slot", "score"), k)


def korean_fallback(chunks: DataFrame, queries: DataFrame, k: int, config: Config = DEFAULT) -> DataFrame:
    """(query_id, slot, score, rank) by shared characters of Korean stems, for questions with no other hit."""
    docs = chunks.select("slot", hangul.characters(F.concat_ws(" ", "title", "text")).alias("c"))
    asked = queries.select("query_id", F.explode(hangul.query_characters("question")).alias("ch"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.nullif(F.avg(F.size("c")), F.lit(0.0)), F.lit(1.0)).alias("avg"))
    has = docs.select("slot", F.greatest(F.size("c"), F.lit(1)).alias("len"), F.explode("c").alias("ch"))
    rarity = has.groupBy("ch").agg(F.count(F.lit(1)).alias("df"))
    hits = has.join(asked, "ch").join(rarity, "ch").crossJoin(F.broadcast(stats))
    weight = idf(F.col("n"), F.col("df"), DEFAULT.idf_pow) * (DEFAULT.k1 + 1) / (1 + DEFAULT.k1 * (1 - DEFAULT.b + DEFAULT.b * F.col("len") / F.col("avg")))
    return top_k(hits.groupBy("query_id", "slot").agg(total(weight)), k)


def fetch(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chunks in the order asked for: wanted is (pos, chunk_id); unknown ids give nothing, repeated ones repeat."""
    return wanted.join(chunks, "chunk_id").orderBy("pos")
