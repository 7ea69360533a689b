"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation learns how far to trust each.

Every step is a DataFrame expression. Each rule votes good (1), bad (-1) or abstains (0). Texts with the same votes are
alike to the model, so the corpus is reduced to its counts of vote patterns (at most 3 to the number of rules), and a
fixed number of EM rounds over them runs inside one aggregate expression on one row. It estimates how many texts are
good and how each rule votes on good and on bad ones, with a mild prior that rules beat chance; a text is kept when its
posterior probability of being good is at least ``KEEP``.

Defined results: null text has no words; texts without words fail the base rules and are not kept; a text on which all
rules abstain gets the share of good texts; an empty table gives no rows; repeated rows are judged alike; null ids are
kept. Texts of any length are counted whole. The
input's columns travel as one struct beside the working columns, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm.common import materialise, packed, table

KEEP, ROUNDS, PRIOR = 0.5, 30, 50.0
SPACE = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: How each rule votes: bad from the first bound on, good up to the second, else it abstains. All are shares.
BOUNDS = {
    "symbols": (0.10, 0.02),  # symbols to words
    "repeats": (0.30, 0.15),  # words in repeated windows to words
    "lines": (0.30, 0.10),  # repeated lines to lines
    "capitals": (0.40, 0.15),  # A-Z to characters of words
    "digits": (0.30, 0.10),  # 0-9 to characters of words
    "marks": (0.15, 0.08),  # other ASCII punctuation to characters of words
    "variety": (0.70, 0.55),  # words that the text has used before to words
}
RULES = [*BOUNDS, "word_length"]
MEAN_WORD = ((2.5, 12.0), (3.0, 10.0))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeated(words: Column) -> Column:
    """Words inside a three-word window that occurs twice or more.

    Windows' hashes are sorted with their places; equal neighbours mark repeated ones; their places, sorted, cover three
    words each, less what the next one covers too.
    """
    windows = F.when(
        F.size(words) > 2,
        F.zip_with(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(words, 3, F.size(words)), lambda ab, c: F.when(c.isNotNull(), F.xxhash64(ab["a"], ab["b"], c))),
    )

    def places(h: Column) -> Column:
        ordered = F.array_sort(F.slice(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))), 1, F.size(h) - 2))

        def twice(s: Column) -> Column:
            n = F.size(s)
            same = F.filter(s, lambda x, i: ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])) | ((i < n - 1) & (x["h"] == F.get(s, i + 1)["h"])))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        return _let(ordered, twice)

    # Most texts have no repeated window at all: counting different hashes tells that without sorting.
    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)

    return F.coalesce(_let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h) - F.when(F.size(h) > 2, 1).otherwise(0), _let(places(h), covered))), F.lit(0)).cast("long")


def counts(df: DataFrame, text: str) -> DataFrame:
    """(row, q): the input's columns as one struct, and one with word counts and the other counts that rules look at."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: _without(x, WHITE) != "")
    first = df.select(packed(df).alias("row"), words.alias("w"), _without(t, WHITE).alias("t"), lines.alias("l"))
    word_chars = F.length("t").cast("long")
    some = F.greatest(word_chars, F.lit(1))
    n = F.size("w").cast("long")
    q = F.struct(
        n.alias("n_words"),
        word_chars.alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("w")).alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        ((F.length("t") - F.length(_without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) / some).alias("capitals"),
        ((F.length("t") - F.length(_without(F.col("t"), "0123456789"))) / some).alias("digits"),
        ((F.length("t") - F.length(_without(F.col("t"), "!\"'()+,-./:;=?@[\\]^_`{}~"))) / some).alias("marks"),
        ((n - F.size(F.array_distinct("w"))) / F.greatest(n, F.lit(1))).alias("reused"),
    )
    return first.select("row", q.alias("q"))


def signals(df: DataFrame, text: str) -> DataFrame:
    """The input with struct column __q, the signals; an existing column of that name is replaced."""
    return counts(df.drop("__q"), text).select("row.*", F.col("q").alias("__q"))


def votes(q: Column) -> Column:
    """The rules' votes, as one string of +, - and 0, in the order of RULES."""
    n = F.greatest(q["n_words"], F.lit(1))
    # A long text uses its common words again and again; the share expected grows with its length.
    expected = F.log10(n.cast("double") / 50) * 0.15
    value = {
        "symbols": q["n_symbols"] / n,
        "repeats": q["n_repeat_words"] / n,
        "lines": q["n_dup_lines"] / F.greatest(q["n_lines"], F.lit(1)),
        "capitals": q["capitals"],
        "digits": q["digits"],
        "marks": q["marks"],
        "variety": q["reused"] - expected,
    }
    cast = [F.when(q["n_words"] == 0, "0").when(value[k] >= bad, "-").when(value[k] <= good, "+").otherwise("0") for k, (bad, good) in BOUNDS.items()]
    mean = q["word_chars"] / n
    (low, high), (least, most) = MEAN_WORD
    cast.append(F.when(q["n_words"] == 0, "0").when((mean < low) | (mean > high), "-").when((mean >= least) & (mean <= most), "+").otherwise("0"))
    return F.concat(*cast)


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def posterior(pattern: Column, model: Column) -> Column:
    """The probability that a text with these votes is good."""

    def log_odds(i: int) -> Column:
        vote = F.substring(pattern, i + 1, 1)
        return F.when(vote == "+", F.log(model["good"][i] / model["bad"][i])).when(vote == "-", F.log((1 - model["good"][i]) / (1 - model["bad"][i]))).otherwise(0.0)

    total = F.log(model["share"] / (1 - model["share"]))
    for i in range(len(RULES)):
        total = total + log_odds(i)
    return 1 / (1 + F.exp(-total))


def learn(patterns: DataFrame) -> DataFrame:
    """One row, one column ``model``: share of good texts, and each rule's chance to vote good on good and on bad texts.

    patterns: (votes, n). Given that a rule votes, it votes good with its chance; abstaining tells nothing.
    """
    rows = F.sort_array(F.collect_list(F.struct("votes", "n")))  # at most 3 ** len(RULES) patterns
    start = F.struct(F.lit(0.8).alias("share"), F.array(*[F.lit(0.9)] * len(RULES)).alias("good"), F.array(*[F.lit(0.3)] * len(RULES)).alias("bad"))

    def step(rows: Column, model: Column) -> Column:
        weighed = F.transform(rows, lambda r: F.struct(r["votes"].alias("p"), (r["n"] * posterior(r["votes"], model)).alias("g"), (r["n"] * (1 - posterior(r["votes"], model))).alias("b")))

        def maximised(w: Column) -> Column:
            def total(of) -> Column:
                return F.aggregate(F.transform(w, of), F.lit(0.0), lambda a, b: a + b)

            def chance(i: int, side: str, prior: float) -> Column:
                vote = lambda r: F.substring(r["p"], i + 1, 1)
                plus = total(lambda r: F.when(vote(r) == "+", r[side]).otherwise(0.0))
                cast = total(lambda r: F.when(vote(r) != "0", r[side]).otherwise(0.0))
                return (plus + PRIOR * prior) / (cast + PRIOR)

            good, bad = total(lambda r: r["g"]), total(lambda r: r["b"])
            return F.struct(
                ((good + PRIOR * 0.8) / (good + bad + PRIOR)).alias("share"),
                F.array(*[chance(i, "g", 0.9) for i in range(len(RULES))]).alias("good"),
                F.array(*[chance(i, "b", 0.3) for i in range(len(RULES))]).alias("bad"),
            )

        return _let(weighed, maximised)

    return patterns.agg(rows.alias("rows")).select(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda model, _: step(F.col("rows"), model)).alias("model"))


def with_posterior(counted: DataFrame) -> DataFrame:
    """A written table with q (signals) -> the same with votes, good (posterior), failed (base rules) and kept."""
    voted = counted.withColumn("votes", votes(F.col("q")))
    # A cross join with one row: the model.
    judged = voted.crossJoin(F.broadcast(learn(voted.groupBy("votes").agg(F.count("*").alias("n")))))
    judged = judged.withColumn("good", posterior(F.col("votes"), F.col("model"))).withColumn("failed", base_failed(F.col("q")))
    return judged.withColumn("kept", ~F.col("failed") & (F.col("good") >= KEEP)).drop("model")


def judge(df: DataFrame, text: str) -> DataFrame:
    """(row, q, votes, good, failed, kept): the input's columns as one struct, null where the base rules fail, and what is known of each row.

    Whole texts are counted once and written once; the rules learn from all of them.
    """
    counted = counts(df, text)
    return with_posterior(materialise(counted.withColumn("row", F.when(~base_failed(F.col("q")), F.col("row"))), "signals"))


def keep(df: DataFrame, text: str) -> DataFrame:
    """The rows that are kept, with the input's columns."""
    return judge(df, text).filter("kept").select("row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The signals are written once, so that whole texts are counted once.
    judged = with_posterior(materialise(counts(docs, "text").select(F.col("row.doc_id").alias("doc_id"), "q"), "signals"))
    return judged.select(
        "doc_id", *(F.col("q")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.col("failed").alias("base_failed"), "kept", F.round("good", 6).alias("good"), "votes"
    )
