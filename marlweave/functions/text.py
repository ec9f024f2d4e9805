"""Text analysis as Column expressions; everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: English words that carry a question's form and not its subject, compared after stemming.
STOPWORDS = tuple(
    """yourselves themselves ourselves yourself himself herself through itself myself whom
    having theirs should would which where while until under those these there other might doing could
    being yours your with will were when what very they then them their than that this such some same
    over ours once only most more just into hers here have from does both been who why you was too the
    she out our own off nor not may its him his how her had has for did can but are and
    up to we so or on of no my me it is in if i he do by be at as an am a""".split()
)
PERSONAL = ("we've", "we're", "we'll", "we'd", "us", "we", "ours", "ourselves", "our", "mine", "myself", "my", "me", "i've", "i'm", "i'll", "i'd", "i")
HANGUL_RUN = "[가-힣]+"
CJK_RUN = "[぀-ヿ一-鿿]+"


def column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lower(x: str | Column) -> Column:
    return F.lower(F.coalesce(column(x), F.lit("")))


def s_stem(w: Column) -> Column:
    """Singular of an English plural: only words over three letters that end in s change."""
    size = F.length(w)
    cut = F.substring(w, F.lit(1), size - 1)
    tail = lambda n: F.right(w, F.lit(n))
    rule = (
        F.when((tail(3) == "ies") & ~tail(4).isin("eies", "aies"), F.concat(F.substring(w, F.lit(1), size - 3), F.lit("y")))
        .when((tail(2) == "es") & ~tail(3).isin("aes", "ees", "oes"), cut)
        .when(~tail(2).isin("us", "ss"), cut)
        .otherwise(w)
    )
    return F.when((size > 3) & (tail(1) == "s"), rule).otherwise(w)


def latin_words(x: str | Column) -> Column:
    return F.regexp_extract_all(lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def latin_tokens(x: str | Column) -> Column:
    """The words of a text, each as ``s_stem`` has it; the endings are cut from the whole text, which stays in compiled code."""
    singular = F.regexp_replace(lower(x), "(?<=[b-df-z0-9])ies(?![a-z0-9])", "y")
    singular = F.regexp_replace(singular, "(?<=[a-z0-9]{2}[a-rtv-z0-9])s(?![a-z0-9])", "")
    return F.regexp_extract_all(singular, F.lit("[a-z0-9]+"), F.lit(0))


def bigram_strings(run: Column) -> Column:
    """A run of one character itself, else its pairs of neighbouring characters."""
    return F.when(F.length(run) == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def cjk_tokens(x: str | Column) -> Column:
    runs = F.regexp_extract_all(lower(x), F.lit(CJK_RUN), F.lit(0))
    return F.flatten(F.transform(runs, bigram_strings))


def hangul_stem_tokens(stem: Column) -> Column:
    """A stem of one character itself, else its pairs and the whole stem marked with '#'."""
    return F.when(F.length(stem) == 1, F.array(stem)).otherwise(F.concat(bigram_strings(stem), F.array(F.concat(F.lit("#"), stem))))


def not_ascii(x: str | Column) -> Column:
    return F.coalesce(column(x), F.lit("")).rlike("[^\\x00-\\x7F]")


def tokens(x: str | Column) -> Column:
    """Latin stems, then pairs of kana and hanja, then Hangul stems; other scripts cost nothing on Latin text."""
    from .hangul import stems

    text = column(x)
    hangul = F.flatten(F.transform(stems(F.when(text.rlike("[가-힣]"), lower(text))), hangul_stem_tokens))
    wide = F.concat(latin_tokens(text), cjk_tokens(text), F.coalesce(hangul, F.array().cast("array<string>")))
    return F.when(not_ascii(text), wide).otherwise(latin_tokens(text))


def more_tokens(x: str | Column) -> Column:
    """The ``tokens`` of a text that are no words of a to z and 0 to 9."""
    from .hangul import stems

    text, none = column(x), F.array().cast("array<string>")
    hangul = F.flatten(F.transform(stems(F.when(text.rlike("[가-힣]"), lower(text))), hangul_stem_tokens))
    # sizes tell plain ASCII without a search
    wide = (F.octet_length(text) > F.length(text)) & text.rlike(f"[{HANGUL_RUN[1:-2]}{CJK_RUN[1:-2]}]")
    return F.when(wide, F.concat(cjk_tokens(text), F.coalesce(hangul, none))).otherwise(none)


def query_tokens(x: str | Column) -> Column:
    """Tokens that bear a question's subject; all tokens if none is left."""
    from .hangul import query_stems

    text = column(x)
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    latin = F.filter(latin_tokens(text), lambda t: ~F.array_contains(stop, t))
    hangul = F.flatten(F.transform(query_stems(F.when(text.rlike("[가-힣]"), lower(text))), hangul_stem_tokens))
    wide = F.concat(latin, cjk_tokens(text), F.coalesce(hangul, F.array().cast("array<string>")))
    kept = F.when(not_ascii(text), wide).otherwise(latin)
    return F.when(F.size(kept) == 0, tokens(text)).otherwise(kept)


def is_personal(x: str | Column) -> Column:
    """Whether a question speaks of its speaker or their group."""
    words = F.regexp_extract_all(F.regexp_replace(lower(x), "’", "'"), F.lit("[a-z]+('[a-z]+)?"), F.lit(0))
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in PERSONAL]))


def pairs(t: Column) -> Column:
    """Distinct pairs of neighbouring tokens."""
    n = F.size(t)
    zipped = F.zip_with(F.slice(t, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(n > 1, zipped).otherwise(F.array().cast("array<string>")))


def pair_fraction(query: Column, document: Column) -> Column:
    """The share of the question's pairs that the document has too."""
    q = pairs(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, pairs(document))) / F.size(q))


def jaccard(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def casefold(x: str | Column) -> Column:
    return F.replace(lower(x), F.lit("ß"), F.lit("ss"))


def surface_score(question: str | Column, title: str | Column, body: str | Column) -> Column:
    """Evidence of the question's words as they stand, in a title and a body."""
    q, t, b = casefold(question), casefold(title), casefold(body)
    terms = F.filter(F.split(q, "\\s+"), lambda w: w != "")
    n = F.size(terms)
    inside = lambda w: F.struct(t.contains(w).cast("int").alias("t"), b.contains(w).cast("int").alias("b"))
    seen = F.transform(terms, inside)
    total = F.aggregate(seen, F.lit(0), lambda s, x: s + 2 * x["t"] + x["b"])
    matched = F.size(F.filter(seen, lambda x: x["t"] + x["b"] > 0))
    two = F.zip_with(F.slice(terms, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(terms, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    beside = F.size(F.filter(two, lambda p: t.contains(p) | b.contains(p)))
    cover = matched / n
    bonus = F.when(cover >= 0.8, 1.5 * n).when(cover >= 0.5, 0.5 * n).otherwise(0.0)
    score = F.when(t.contains(q), 3.0 * n).otherwise(0.0) + total + 1.5 * beside + bonus
    return F.when(n == 0, F.lit(0.0)).otherwise(score)


def without_parenthetical(title: str | Column) -> Column:
    return F.trim(F.regexp_replace(column(title), "\\s*\\([^()]*\\)\\s*$", ""))


def aliases_of(t: Column) -> Column:
    """Names of a title given as tokens: all of it, and what stands before a location."""
    place = lambda w: F.array_position(F.slice(t, F.lit(3), F.greatest(F.size(t) - 2, F.lit(0))), w)
    spots = F.filter(F.array(*[place(w) for w in ("in", "of", "from")]), lambda p: p > 0)
    both = F.when(F.size(spots) > 0, F.array(t, F.slice(t, F.lit(1), (F.array_min(spots) + 1).cast("int")))).otherwise(F.array(t))
    return F.when(F.size(t) < 2, F.array().cast("array<array<string>>")).otherwise(F.array_distinct(both))


def with_title_aliases(df: DataFrame, title: str, out: str, lone: bool = False) -> DataFrame:
    """Adds the names of a title; with ``lone`` also a single long token where a parenthetical was dropped.

    Tokens are a column of their own first, so that they are computed once.
    """
    rows = df.withColumn("__base", without_parenthetical(title)).withColumn("__t", tokens("__base"))
    names = aliases_of(F.col("__t"))
    if lone:
        only = (F.size("__t") == 1) & (F.col("__base") != F.trim(column(title))) & (F.length(F.element_at("__t", 1)) >= 5)
        names = F.array_distinct(F.concat(names, F.when(only, F.array("__t")).otherwise(F.array().cast("array<array<string>>"))))
    return rows.withColumn(out, names).drop("__base", "__t")


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def with_title_match(df: DataFrame, question: str, title: str, out: str) -> DataFrame:
    """Adds struct(affinity, offset) of the best mention of a title in a question; null if there is none."""
    none = F.array().cast("array<struct<a:double,offset:int>>")

    def at(alias: Column, q: Column) -> Column:
        width = F.size(alias)

        def one(start: Column) -> Column:
            span = F.slice(q, start + 1, width)
            wrong = F.filter(F.zip_with(alias, span, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda z: z["x"] != z["y"])
            few = F.slice(wrong, 1, 2)
            near = F.transform(few, lambda z: F.when(within_one_edit(z["x"], z["y"]), 1).otherwise(2))
            cost = F.aggregate(near, F.lit(0), lambda s, x: s + x)
            aff = F.when(cost == 0, F.lit(-1.0)).when((cost == 1) & (width >= 2), F.lit(-0.95))
            return F.struct(aff.alias("a"), start.alias("offset"))

        last = F.size(q) - width
        return F.when((last >= 0) & (width > 0), F.filter(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one), lambda m: m["a"].isNotNull())).otherwise(none)

    rows = with_title_aliases(df.withColumn("__q", tokens(question)), title, "__names", lone=True)
    # the question is handed to the function beside each name: it may come from Python, which must not be captured
    rows = rows.withColumn("__m", F.array_min(F.flatten(F.zip_with("__names", F.array_repeat("__q", F.size("__names")), at))))
    return rows.withColumn(out, F.when(F.col("__m").isNotNull(), F.struct((-F.col("__m.a")).alias("affinity"), F.col("__m.offset").alias("offset")))).drop("__q", "__names", "__m")


def local_name(uri: str | Column) -> Column:
    return F.element_at(F.split(F.element_at(F.split(column(uri), "#"), -1), "/"), -1)


def normal_answer(x: str | Column) -> Column:
    """Lower case, punctuation to blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(lower(x), "[^\\p{L}\\p{N}_\\s]", " "), "\\s+", " "))


def answer_correctness(answer: str | Column, gold: str | Column) -> Column:
    """1 if the gold answer stands in the answer, 0.9 if all its tokens do, else the tokens' F1."""
    a, g = normal_answer(answer), normal_answer(gold)
    words = lambda t: F.array_distinct(F.filter(F.split(t, " "), lambda w: F.length(w) >= 2))
    x, y = words(a), words(g)
    both = F.size(F.array_intersect(x, y))
    f1 = 2 * both / (F.size(x) + F.size(y))
    return F.when(F.length(g) == 0, 0.0).when(a.contains(g), 1.0).when(both == 0, 0.0).when(both == F.size(y), 0.9).otherwise(f1)


def context_support(context: str | Column, gold: str | Column) -> Column:
    """1 if the gold answer stands in the context, else the share of its tokens that do."""
    c, g = normal_answer(context), normal_answer(gold)
    words = lambda t: F.array_distinct(F.filter(F.split(t, " "), lambda w: F.length(w) >= 2))
    share = F.size(F.array_intersect(words(c), words(g))) / F.size(words(g))
    return F.when(F.length(g) == 0, 0.0).when(c.contains(g), 1.0).when(F.size(words(g)) == 0, 0.0).otherwise(share)


def truncate_words(x: str | Column, n: int = 2048) -> Column:
    return F.array_join(F.slice(F.filter(F.split(column(x), "\\s+"), lambda w: w != ""), 1, n), " ")


def prompt(question: Column, class_seed: Column, relations: Column, evidence: Column) -> Column:
    """The synthesis prompt of one question."""
    nonempty = lambda x: F.when(F.length(F.coalesce(x, F.lit(""))) > 0, x)
    rel = F.when(F.size(relations) > 0, F.concat(F.lit("[Graph relations]\n"), F.array_join(relations, "\n")))
    ev = F.when(F.size(evidence) > 0, F.concat(F.lit("[Evidence passages]\n"), F.array_join(evidence, "\n---\n")))
    return F.concat_ws("\n\n", F.concat(F.lit("Question: "), question), nonempty(class_seed), rel, ev)


def cited_nodes(relations: Column, class_seed: Column, answer: Column) -> Column:
    """Names from relations and from the class list that the answer has, sorted."""

    def ends(r: Column) -> Column:
        p = F.transform(F.split(r, "→"), lambda x: F.trim(x))
        return F.when(F.size(p) >= 3, F.array(F.element_at(p, 1), F.element_at(p, -1))).otherwise(F.array().cast("array<string>"))

    seed = F.coalesce(class_seed, F.lit(""))
    label = F.trim(F.regexp_extract(seed, "'([^']+)'", 1))
    body = F.element_at(F.split(F.regexp_extract(seed, "instances:\\s*(.+)", 1), "[.\\]]|\\(\\+"), 1)
    names = F.filter(F.transform(F.split(body, "\\|"), lambda x: F.trim(x)), lambda n: (F.length(n) >= 2) & (F.length(n) <= 50))
    every = F.concat(F.flatten(F.transform(relations, ends)), F.array(label), names)
    return F.array_sort(F.array_distinct(F.filter(every, lambda c: (F.length(c) >= 2) & F.coalesce(answer, F.lit("")).contains(c))))

