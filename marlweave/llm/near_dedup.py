"""Near duplicates by order MinHash and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import distances
from .common import BASE, U64, blocks, mix, staged, text_key, unused, utf8, whole_text
from .packs import PACKS, Packer, range_bits, repeated, texts
from .toxicity import words

SEEDS = mix(np.arange(1, 1025, dtype=U64) * U64(BASE))


def units(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's words (letters in lower case); of a text without letters, its bytes."""
    h, text = words(data, offsets)
    cuts = np.searchsorted(text, np.arange(len(offsets)))
    out = []
    for i in range(len(offsets) - 1):
        own = h[cuts[i] : cuts[i + 1]]
        out.append(own if len(own) else mix(data[offsets[i] : offsets[i + 1]].astype(U64) + U64(1)))
    return out


def sketch(u: np.ndarray, gram: int, kept: int, samples: int) -> np.ndarray:
    """One number for each sample: its ``kept`` smallest occurrence-labelled k-mers, in text order."""
    k = min(gram, len(u))
    x = np.zeros(len(u) - k + 1, U64)
    for t in range(k):
        x = (x + u[t : t + len(x)]) * U64(BASE)
    x = mix(x)
    order = np.argsort(x, kind="stable")
    run = np.arange(len(x))
    new = np.concatenate([[True], x[order][1:] != x[order][:-1]])
    label = np.empty(len(x), U64)
    label[order] = (run - np.maximum.accumulate(np.where(new, run, 0))).astype(U64)
    y = mix(x + label * U64(BASE))
    take = min(kept, len(x))
    places = np.arange(len(x), dtype=U64)
    out = np.empty(samples, U64)
    step = max(1, (1 << 18) // len(x))
    for a in range(0, samples, step):
        s = SEEDS[a : min(a + step, samples)]
        h = (y[None, :] ^ s[:, None]) * (s[:, None] | U64(1))
        h ^= h >> U64(29)
        if take < len(x):  # the place stands in the lowest bits, so that values can be partitioned
            bits = U64(len(x).bit_length())
            low = np.partition((h >> bits << bits) | places, take - 1, axis=1)[:, :take]
            low = np.sort((low & ((U64(1) << bits) - U64(1))).astype(np.int64), axis=1)
        else:
            low = np.broadcast_to(np.arange(len(x)), (len(s), len(x)))
        z = s.copy()
        for t in range(take):
            z = mix(z * U64(BASE) + x[low[:, t]])
        out[a : a + len(s)] = z
    return out


def short_keys(u: np.ndarray, share: float, short: int) -> np.ndarray:
    """Keys of a text of at most ``short`` words, of which two such texts within the edit budget share one.

    The longer text, of n words, is cut into one part more than the edits it allows, so one part is
    whole in the shorter one. To both sides of the part the lengths may differ by the edits there,
    which bounds the places where it can be. A key is n, the number of the part, and its words.
    """
    size, out = len(u), []
    for n in range(size, short + 1):
        d = int(share * n)
        if n - size > d:
            break
        cuts = np.arange(d + 2) * n // (d + 1)
        for part in range(d + 1):
            a, width = int(cuts[part]), int(cuts[part + 1] - cuts[part])
            starts = np.arange(max(0, a - (d + n - size) // 2), min(size - width, a + (d - n + size) // 2) + 1)
            if not len(starts):
                continue
            z = np.full(len(starts), n * 1000 + part + 1, U64) * U64(BASE)
            for t in range(width):
                z = mix(z * U64(BASE) + u[starts + t])
            out.append(z)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U64)


def word_counts(u: np.ndarray) -> bytes:
    """How many words of a text fall into each of 64 classes, at most 255."""
    return np.minimum(np.bincount((u >> U64(58)).astype(np.int64), minlength=64), 255).astype(np.uint8).tobytes()


def sketches(gram: int, kept: int, samples: int, share: float, short: int, bits: int, common: int = 64):
    """Packs of the keys of each text; a text that the task met before is skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Packer({}, bits, common=common)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in blocks(offsets, 1 << 20):
                part = offsets[a : b + 1]
                for i, u in enumerate(units(data[part[0] : part[-1]], part - part[0])):
                    if len(u) and pack.fresh(ids[a + i]):
                        k = sketch(u, gram, kept, samples)
                        k = np.unique(np.concatenate([k, short_keys(u, share, short)]) if len(u) <= short else k)
                        number = pack.text(ids[a + i], len(u), word_counts(u))
                        pack.add(k, np.full(len(k), number))
                if pack.full():
                    yield pack.flush()
        yield pack.flush()

    return run


def possible(share: float):
    """Pairs with sizes and word counts -> those whose counts allow the edit budget; an edit changes a class by one at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(utf8(batch.column(c))[0], np.uint8).reshape(-1, 64).astype(np.int16) for c in ("x_counts", "y_counts"))
            more = x - y
            least = np.maximum(np.where(more > 0, more, 0).sum(axis=1), np.where(more < 0, -more, 0).sum(axis=1))
            longer = np.maximum(batch.column("x_size").to_numpy(), batch.column("y_size").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(least <= (share * longer).astype(np.int64)))

    return run


def verify(share: float, most: int = 16 << 20):
    """Pairs of texts -> the pairs within the edit budget, with their distance; about ``most`` bytes and at most 1024 pairs at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(np.diff(utf8(batch.column(c))[1]) for c in ("text_a", "text_b")) + most // 1024
            for first, past in blocks(np.concatenate([[0], np.cumsum(size)]), most):
                part = batch.slice(first, past - first)
                # a text is in many pairs, and is cut into words once
                both = pa.concat_arrays([part.column("text_a"), part.column("text_b")]).dictionary_encode()
                known, at = units(*utf8(both.dictionary)), both.indices.to_pylist()
                one, two = [known[i] for i in at[: part.num_rows]], [known[i] for i in at[part.num_rows :]]
                limit = np.array([int(share * max(len(x), len(y))) for x, y in zip(one, two)], np.int64)
                got = distances(list(zip(one, two)), limit)
                ok = got <= limit
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(got), pa.array(ok)], names=["a", "b", "edits", "near"])

    return run


def components(spark: SparkSession, links: DataFrame, at_driver: int = 500_000) -> DataFrame:
    """(tid, root): the smallest key that links (a, b) connect each key with.

    Up to ``at_driver`` links are united on the driver; beyond, labels are lowered over
    the cluster, through neighbours and then through the label's own label, until none changes.
    """
    if links.limit(at_driver + 1).count() <= at_driver:
        parent: dict = {}

        def top(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for r in links.select("a", "b").toLocalIterator():
            a, b = (top(bytes(x) if isinstance(x, bytearray) else x) for x in (r["a"], r["b"]))
            if a != b:
                parent[max(a, b)] = min(a, b)
        kind = links.schema["a"].dataType
        rows = [tuple(bytearray(v) if isinstance(v, bytes) else v for v in (x, top(x))) for x in sorted(parent)]
        return spark.createDataFrame(rows, T.StructType([T.StructField("tid", kind), T.StructField("root", kind)]))
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = staged(both.groupBy(F.col("a").alias("tid")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("tid", "b"), "b").groupBy(F.col("a").alias("tid")).agg(F.min("root").alias("low"))
        low = label.join(near, "tid").select("tid", F.least("root", "low").alias("root"))
        jump = low.select(F.col("tid").alias("root"), F.col("root").alias("next"))
        new = staged(low.join(jump, "root", "left").select("tid", F.least("root", F.coalesce("next", "root")).alias("root")), "labels")
        changed = new.join(label.withColumnRenamed("root", "old"), "tid").where("root <> old").limit(1).count()
        label = new
        if not changed:
            return label


def met(left: DataFrame, right: DataFrame, by: str, block: int = 512) -> DataFrame:
    """Every row of ``left`` with every row of ``right`` of the same ``by``; of both, n rows at most have it.

    left: by, n, x, x_*; right: by, n, y, y_*. A large group is cut into blocks on both sides, and every
    two blocks meet under a key of their own, so that no task has to make all pairs of a group.
    """
    many = F.ceil(F.col("n") / block).cast("int")
    own = lambda c: F.pmod(F.xxhash64(c), many).cast("int")
    every = F.explode(F.sequence(F.lit(0), many - 1))
    one = left.withColumn("i", own("x")).withColumn("j", every).drop("n")
    two = right.withColumn("j", own("y")).withColumn("i", every).drop("n")
    return one.join(two, [by, "i", "j"])


def members(docs: DataFrame, gram: int, kept: int, samples: int, share: float, short: int) -> tuple[DataFrame, DataFrame]:
    """The texts (h, tid, size, counts), each once, and (key, h, size) of the keys that more than one text has; docs: doc_id, text, tid."""
    bits = range_bits(docs.count() * (samples + 16))
    made = staged(docs.select("tid", "text").mapInArrow(sketches(gram, kept, samples, share, short, bits), PACKS), "sketches")
    every = texts(made).withColumnRenamed("extra", "counts")
    # a text that several tasks met has a number of each; the smallest stays
    twice = every.groupBy("tid").agg(F.min("h").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("tid", "keep")
    gone = staged(every.select("tid", "h").join(twice, "tid").where("h <> keep").select("h"), "copies")
    found = repeated(made, {})
    found = found.join(gone, "h", "left_anti").join(every.select("h", "size"), "h")
    return staged(every.join(gone, "h", "left_anti"), "texts"), staged(found, "members")


def fits(share: float, x: str, y: str) -> Column:
    """The edits are no fewer than the words that one has more than the other."""
    return F.abs(F.col(x) - F.col(y)) <= limit(share, x, y)


def limit(share: float, x: str, y: str) -> Column:
    return (share * F.greatest(x, y)).cast("int")


def linked(docs: DataFrame, gram: int, kept: int, samples: int, share: float, short: int, broadcast_rows: int, every: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The texts (h, tid), links (a, b) that connect the classes, and the number of links of each text (h, links) with ``every``.

    1. A bucket's members are compared with its first. Each text near a first has the smallest of them for its centre.
    2. Texts of one centre are told apart by size and distance to it only: those two decide most
       pairs by the triangle inequality, for all texts with the same two at once. The other pairs are compared.
    3. Members of a bucket with different centres are compared.

    So no table has a row for each pair, but for those that have to be compared.
    """
    known, bucket = members(docs, gram, kept, samples, share, short)
    first = bucket.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h", "size")).alias("f")).where("n > 1").select("key", "n", F.col("f.h").alias("a"), F.col("f.size").alias("a_size"))
    shared = staged(bucket.join(first, "key"), "buckets")
    star = staged(shared.where("h <> a").where(fits(share, "size", "a_size")).select("a", F.col("h").alias("b"), "size", "a_size").distinct(), "pairs")
    same = lambda df, a, b: aligned(docs, known, df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")), share, broadcast_rows).where("near").select("a", "b", "edits")
    one = staged(same(star, "a", "b").join(star, ["a", "b"]), "links")
    near = one.groupBy(F.col("b").alias("h")).agg(F.min(F.struct("a", "size", "edits")).alias("c")).select("h", F.col("c.a").alias("p"), F.col("c.size").alias("size"), F.col("c.edits").alias("edits"))
    alone = one.select(F.col("a").alias("h"), F.col("a").alias("p"), F.col("a_size").alias("size"), F.lit(0).cast("long").alias("edits")).distinct().join(near, "h", "left_anti")
    centre = staged(near.unionByName(alone), "centres")
    # members of a bucket with different centres
    placed = shared.join(centre.select("h", "p"), "h", "left").withColumn("p", F.coalesce("p", "h"))
    mixed = placed.groupBy("key").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("key", "n")
    placed = staged(placed.drop("n", "a_size").join(mixed, "key"), "mixed")
    if not every:  # what is near a bucket's first is connected by it
        by = one.select("a", F.col("b").alias("h"), F.lit(True).alias("at"))
        placed = placed.join(by, ["a", "h"], "left").withColumn("at", (F.col("h") == F.col("a")) | F.col("at").isNotNull())
    side = lambda c: placed.select("key", "n", F.col("h").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in (["size", "p"] + ["at"] * (not every))])
    rest = met(side("x"), side("y"), "key").where("x < y AND x_p <> y_p").where(fits(share, "x_size", "y_size"))
    if not every:
        rest = rest.where("NOT (x_at AND y_at)")
    rest = rest.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    two = staged(same(rest, "a", "b"), "more-links")
    enough = one.select("a", "b").union(two.select("a", "b"))
    if not every:
        return known, enough, None
    kinds = centre.groupBy("p", "size", "edits").agg(F.count(F.lit(1)).alias("c"))
    kind = lambda x: kinds.select("p", *[F.col(c).alias(f"{x}_{c}") for c in ("size", "edits", "c")])
    both = kind("x").join(kind("y"), "p").where(fits(share, "x_size", "y_size")).where(F.abs(F.col("x_edits") - F.col("y_edits")) <= limit(share, "x_size", "y_size"))
    sure = F.col("x_edits") + F.col("y_edits") <= limit(share, "x_size", "y_size")
    self = (F.col("x_size") == F.col("y_size")) & (F.col("x_edits") == F.col("y_edits"))
    many = both.where(sure).groupBy("p", F.col("x_size").alias("size"), F.col("x_edits").alias("edits")).agg(F.sum(F.col("y_c") - self.cast("int")).alias("links"))
    open_ = both.where(~sure).where("x_size < y_size OR x_size = y_size AND x_edits <= y_edits").where(~self | (F.col("x_c") > 1)).drop("x_c", "y_c")
    own = lambda x: centre.select("p", F.col("h").alias(x), F.col("size").alias(f"{x}_size"), F.col("edits").alias(f"{x}_edits"))
    unsure = open_.join(own("x"), ["p", "x_size", "x_edits"]).join(own("y"), ["p", "y_size", "y_edits"]).where((F.col("x") < F.col("y")) | ~self)
    three = same(unsure, "x", "y")
    # links of the first kind between texts of different centres; those of one centre are in the counts
    where = centre.select("h", "p")
    across = one.select("a", "b").join(where.select(F.col("h").alias("a"), F.col("p").alias("pa")), "a").join(where.select(F.col("h").alias("b"), F.col("p").alias("pb")), "b").where("pa <> pb")
    single = across.select("a", "b").union(two.select("a", "b")).union(three.select("a", "b"))
    ends = single.select(F.col("a").alias("h")).union(single.select("b")).groupBy("h").agg(F.count(F.lit(1)).alias("links"))
    links = centre.join(many, ["p", "size", "edits"]).select("h", "links").unionByName(ends).groupBy("h").agg(F.sum("links").alias("links"))
    return known, enough, links


def aligned(docs: DataFrame, known: DataFrame, pairs: DataFrame, share: float, broadcast_rows: int) -> DataFrame:
    """The pairs (a, b) that may be near, with their texts compared; (a, b, edits, near)."""
    own = lambda x, h: known.select(F.col("h").alias(h), F.col("size").alias(f"{x}_size"), F.col("counts").alias(f"{x}_counts"))
    pairs = staged(pairs.join(own("x", "a"), "a").join(own("y", "b"), "b").mapInArrow(possible(share), "a long, b long"), "possible")
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct().join(known.select("h", "tid"), "h")
    few = wanted.limit(broadcast_rows + 1).count() <= broadcast_rows  # 24 bytes each
    body = docs.join(F.broadcast(wanted) if few else wanted, "tid").groupBy("h").agg(F.first("text").alias("text"))
    body = staged(body, "bodies")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism * 2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    half = pairs.join(body.select(F.col("h").alias("a"), F.col("text").alias("text_a")), "a").repartition(tasks, "b")
    both = half.join(body.select(F.col("h").alias("b"), F.col("text").alias("text_b")).repartition(tasks, "b").hint("merge"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify(share), "a long, b long, edits long, near boolean")


def classes(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", gram: int = 2, kept: int = 3, samples: int = 64, share: float = 0.2, short: int = 36, broadcast_rows: int = 1_000_000, every: bool = True) -> DataFrame:
    """(tid, root, links) of every text that has a near duplicate; tid stands for the text, root for its class. Links are null without ``every``."""
    docs = df.select(F.col(id_column).alias("doc_id"), whole_text(text_column).alias("text")).withColumn("tid", text_key(F.col("text")))
    known, enough, links = linked(docs, gram, kept, samples, share, short, broadcast_rows, every)
    root = components(df.sparkSession, enough).withColumnRenamed("tid", "h")
    name = known.select("h", "tid")
    out = root.join(name, "h").join(name.select(F.col("h").alias("root"), F.col("tid").alias("named")), "root").select("h", "tid", F.col("named").alias("root"))
    out = out.join(links, "h") if links is not None else out.withColumn("links", F.lit(None).cast("long"))
    return staged(out.select("tid", "root", "links"), "classes")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """A row for every document: doc_id, class_id, class_size, copies, links.

    Texts are sequences of words (letters in lower case). Each of ``samples`` samples takes the
    ``kept`` smallest k-mers of ``gram`` words under its own hash, where equal k-mers are told apart by
    their number of occurrence, and keeps their order in the text; texts with an equal sample are
    candidates, and so are, without loss, texts of at most ``short`` words within the edit budget. A pair is near if it
    takes at most ``share`` edits per word of the longer text. All candidates are decided, and all pairs of texts near the same
    first of a bucket: by their distances to it where the triangle inequality suffices, else by alignment. Word
    counts that differ by more than the budget settle a pair before its texts are sent. Classes are what links connect.

    ``copies`` counts the rows of the same text, ``links`` the different texts that it is near, among those decided,
    ``class_id`` is the smallest id in the class. Equal texts are always in one class, all null and
    empty texts too. Repeated rows are rows; ids may be null (they are no class_id); an empty
    table gives no rows. Other columns are ignored.
    """
    known = classes(df, id_column, text_column, **settings)
    ids = df.select(F.col(id_column).alias("doc_id"), text_key(whole_text(text_column)).alias("tid"))
    per = ids.groupBy("tid").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    per = per.join(known, "tid", "left").withColumns({"root": F.coalesce("root", "tid"), "links": F.coalesce("links", F.lit(0))})
    whole = per.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("copies").alias("class_size"))
    per = per.join(whole, "root").select("tid", "class_id", "class_size", "copies", "links")
    return ids.join(per, "tid").select("doc_id", "class_id", "class_size", "copies", "links")


def keep_one(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """The rows of ``df`` that stay if each class keeps its row of the smallest id (null last; then any)."""
    known = classes(df, id_column, text_column, every=False, **settings)
    key = text_key(whole_text(text_column))
    ids = df.select(F.col(id_column).alias("i"), key.alias("t"))
    per = ids.groupBy("t").agg(F.min("i").alias("i")).join(known.select(F.col("tid").alias("t"), "root"), "t", "left")
    # the smallest id of each text, and of those the smallest of each class
    mark, t, i = unused(df, "key", "text", "id")
    stay = per.groupBy(F.coalesce("root", "t").alias("r")).agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i", "t")).alias("s")).select(F.col("s.t").alias(t), F.col("s.i").alias(i))
    named = df.withColumn(mark, key)
    kept = named.join(stay, (named[mark] == stay[t]) & named[id_column].eqNullSafe(stay[i]), "left_semi")
    twice = ids.groupBy("t", "i").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates([mark]) if twice else kept).drop(mark)
