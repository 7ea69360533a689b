"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Tokens are a text's words, A-Z lower-cased, and one end. All training texts are counted. Words with at least ``HOT_SHARE``
of the training tokens are held: there can be no more than its inverse, which bounds what is sent to the tasks. A token's
probability is that of its class times that of the word among the class's:

* the ``SINGLES`` most frequent words and the end are classes of their own;
* the other held words, in the order of their reversed letters, so that endings stand together, are cut into groups of
  about equal mass; each group is a class, and each of its words has a vector of its own;
* words that are not held are classes by a hash of their last three letters; within, a word has its smoothed share.

A class is predicted from the classes of the two words before it: their vectors, each weighted by its place, are added,
and the sum's product with the target's vector plus the target's bias is its score. A word of a group is predicted alike
from the class before it. So the number of vectors grows with the held vocabulary, up to 1 / HOT_SHARE; words before a
token are told apart by their classes only.

Scores are normalised exactly: with E1 = exp(first place's products + bias) and E2 = exp(second place's products), the
normalisers of all pairs of contexts are one matrix product, E1 @ E2.T; those of all groups under all contexts are
products of the contexts with blocks of the groups' vectors.

Training. Texts are dealt to replicas by a hash of id and text, as many as the count of training tokens asks for
(``EACH``), and every replica walks its texts in the order of their hash, in batches of whole ``BATCH`` tokens. There are
``ROUNDS`` rounds, each over other texts and from the average of the copies that the round before left, weighted by
tokens and added block by block in a fixed order. So the model depends on the rows alone, not on how they are partitioned.

Defined results: null text is empty: only its end is scored; null ids are kept, and fold as the text 'null'; repeated
rows are scored alike and counted each; without training texts every token gets the smoothed share of an empty corpus.
Whole texts are read. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm.common import chunks, fold_column, materialise, new_name, once_per_worker, table, utf8

#: Classes of one word, of words that are not held, and of groups at most; a group has at least MEMBERS words on average.
SINGLES, OTHERS, GROUPS, MEMBERS = 1400, 64, 560, 16
#: Dimensions of classes and of a group's words, noise words of a batch for each, tokens of a batch.
DIMENSIONS, INNER, NOISE, BATCH, RATE = 24, 16, 32, 2048, 0.05
#: A word with at least this share of the training tokens is held in the tasks.
HOT_SHARE = 1e-6
SMOOTH = 0.1
END = OTHERS
#: Different words that a task counts before it passes them on, and bytes of text that it holds as words at a time.
COUNTED, TEXT = 150_000, 2_000_000
#: Training tokens of a replica, replicas at most (beyond, each has more tokens), rounds of several replicas, and parts of the model that are averaged apart.
EACH, REPLICAS, ROUNDS, BLOCKS = 8_000_000, 8192, 3, 32


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) over all rows; the empty word stands for the end of a text."""

    def run(batches):
        counts = {}

        def out():
            words = list(counts)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for whole in batches:
            for batch in chunks(whole, text, TEXT):
                for t in utf8(batch.column(text)):
                    for w in t.lower().split():
                        counts[w] = counts.get(w, 0) + 1
                    counts[b""] = counts.get(b"", 0) + 1
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return df.select(F.col(text).cast("string").alias(text)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def other_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % OTHERS


class Places(dict):
    """Held word -> its place; of any other, -1 less its class, so that arrays end with what such words share."""

    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word[-3:]) % OTHERS


class Lexicon:
    """The held words, most frequent first, their classes and groups, and the counts of all."""

    def __init__(self, words: list[bytes], counts: list[int], end: int, total: int, distinct: int, others: dict[int, tuple[int, int]]):
        """others: class -> (tokens, different words) that are not held."""
        self.place = Places((w, i) for i, w in enumerate(words))
        self.total, self.known_end = total, end > 0
        n = np.array(counts, np.float64)
        self.singles = min(SINGLES, len(words))
        rest = np.array(sorted(range(self.singles, len(words)), key=lambda i: words[i][::-1]), np.int64)
        # Groups are runs of about equal mass; runs without a word are passed over.
        mass = n[rest] + SMOOTH
        wanted = min(GROUPS, -(-len(rest) // MEMBERS))
        run = np.minimum(((mass.cumsum() - mass / 2) / max(mass.sum(), SMOOTH) * wanted).astype(np.int64), max(wanted - 1, 0))
        self.group = np.unique(run, return_inverse=True)[1].astype(np.int64)
        self.groups = int(self.group[-1]) + 1 if len(rest) else 0
        self.first = np.searchsorted(self.group, np.arange(self.groups + 1))
        self.member_at = np.full(len(words) + OTHERS, -1)
        self.member_at[rest] = np.arange(len(rest))
        of_group = np.bincount(self.group, mass, self.groups)
        self.member_share = mass / mass.sum() if len(rest) else mass  # among all words of groups
        backwards = np.arange(OTHERS)[::-1]
        first_group = OTHERS + 1 + self.singles
        of_word = np.r_[np.arange(self.singles) + OTHERS + 1, np.zeros(len(rest), np.int64)]
        of_word[rest] = self.group + first_group
        self.classes, self.first_group = first_group + self.groups, first_group
        self.of_place = np.r_[of_word, backwards].astype(np.int64)
        self.log_count = np.r_[np.log10(n + SMOOTH), np.zeros(OTHERS)]  # those of words not held are added from the join
        self.log_end = math.log10(end + SMOOTH)
        tokens, kinds = (np.array([others.get(b, (0, 0))[i] for b in range(OTHERS)], np.float64) for i in (0, 1))
        self.log_other = np.log10(tokens + SMOOTH * (kinds + 1))
        unigram = np.r_[tokens, end, n[: self.singles], of_group - SMOOTH * np.bincount(self.group, minlength=self.groups)] + SMOOTH
        self.unigram = unigram / unigram.sum()
        self.log_all = math.log10(total + SMOOTH * (distinct + 1))

    def places(self, texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
        """The words of each text, their places one after the other, and how many each has."""
        words = [t.lower().split() for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter((p for w in words for p in map(self.place.__getitem__, w)), np.int64, sizes.sum())
        return words, at, sizes

    def sequences(self, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Targets with an end after each text, their places among the groups' words (or -1), the two classes before each (ends before a text), and the texts' starts."""
        ends = sizes.cumsum()
        target = np.insert(self.of_place[at], ends, END)
        member = np.insert(self.member_at[at], ends, -1)
        starts = np.r_[0, (ends + np.arange(1, len(ends) + 1))[:-1]].astype(np.int64)
        one = np.r_[END, target[:-1]]
        two = np.r_[END, END, target[:-2]][: len(target)]
        one[starts] = END
        two[starts] = END
        two[starts[starts + 1 < len(target)] + 1] = END
        return target, member, one, two, starts


class Model:
    """Vectors of contexts and targets, weights of the two places, biases; and of a group's words their vectors, biases, and the contexts' vectors for them."""

    def __init__(self, lexicon: Lexicon):
        rng, k, inside = np.random.default_rng(7), lexicon.classes, len(lexicon.group)
        self.context, self.target = (rng.normal(0, 0.1, (k, DIMENSIONS)).astype(np.float32) for _ in range(2))
        self.place = np.ones((2, DIMENSIONS), np.float32)
        self.log_noise = np.log(lexicon.unigram).astype(np.float32)
        self.bias, self.noise = self.log_noise.copy(), lexicon.unigram.cumsum()
        self.inner, self.member = (rng.normal(0, 0.1, (n, INNER)).astype(np.float32) for n in (k, inside))
        self.log_share, self.inner_noise = np.log(lexicon.member_share).astype(np.float32), lexicon.member_share.cumsum()
        self.member_bias = self.log_share.copy()
        self.group, self.first = lexicon.group, lexicon.first
        self.squares = [np.full(x.shape, 1e-8, np.float32) for x in self.parameters()]

    def parameters(self) -> list[np.ndarray]:
        return [self.context, self.target, self.place, self.bias, self.inner, self.member, self.member_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.parameters(), *self.squares)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in (*self.parameters(), *self.squares):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def learn(self, target: np.ndarray, member: np.ndarray, one: np.ndarray, two: np.ndarray, rng: np.random.Generator) -> None:
        """One step up the noise-contrastive likelihood of a batch. Only rows of words that it holds, or that are drawn, are touched."""
        drawn = np.minimum(np.searchsorted(self.noise, rng.random(NOISE)), len(self.bias) - 1)
        first, second = self.context[one], self.context[two]
        sums = first * self.place[0] + second * self.place[1]
        vectors, drawn_vectors = self.target[target], self.target[drawn]
        log_k, n = np.float32(math.log(NOISE)), np.float32(1 / len(target))
        good = sigmoid(log_k + self.log_noise[target] - np.einsum("ij,ij->i", sums, vectors) - self.bias[target])
        bad = sigmoid(sums @ drawn_vectors.T + (self.bias - self.log_noise)[drawn] - log_k)
        good *= n
        bad *= -n
        pull = good[:, None] * vectors
        pull += bad @ drawn_vectors
        place = np.stack([np.einsum("ij,ij->j", pull, first), np.einsum("ij,ij->j", pull, second)])
        before = np.concatenate([pull * self.place[0], pull * self.place[1]])
        sums_bad = bad.T @ sums
        sums *= good[:, None]
        self.step(np.concatenate([one, two]), {0: before})
        self.step(np.concatenate([target, drawn]), {1: np.concatenate([sums, sums_bad]), 3: np.concatenate([good, bad.sum(axis=0)])})
        self.squares[2] += place * place
        self.place += np.float32(RATE) * place / np.sqrt(self.squares[2])
        some = np.flatnonzero(member >= 0)
        if len(some):
            self.learn_members(member[some], one[some], n, rng)

    def learn_members(self, member: np.ndarray, one: np.ndarray, n: np.float32, rng: np.random.Generator) -> None:
        """The same for words of groups, against noise from all of them: what is learned of all holds within each group."""
        drawn = np.minimum(np.searchsorted(self.inner_noise, rng.random(NOISE)), len(self.member_bias) - 1)
        queries, vectors, drawn_vectors = self.inner[one], self.member[member], self.member[drawn]
        log_k = np.float32(math.log(NOISE))
        good = sigmoid(log_k + self.log_share[member] - np.einsum("ij,ij->i", queries, vectors) - self.member_bias[member])
        bad = sigmoid(queries @ drawn_vectors.T + (self.member_bias - self.log_share)[drawn] - log_k)
        good *= n
        bad *= -n
        self.step(one, {4: good[:, None] * vectors + bad @ drawn_vectors})
        self.step(np.concatenate([member, drawn]), {5: np.concatenate([good[:, None] * queries, bad.T @ queries]), 6: np.concatenate([good, bad.sum(axis=0)])})

    def step(self, rows: np.ndarray, steps: dict[int, np.ndarray]) -> None:
        """Adds steps to some rows of parameters, by their number; the other rows aren't touched."""
        size = len(self.parameters()[next(iter(steps))])
        order = np.argsort(rows.astype(np.uint16 if size <= 65536 else rows.dtype), kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        at = rows[first]
        for i, more in steps.items():
            x, square, step = self.parameters()[i], self.squares[i], np.add.reduceat(more[order], first, axis=0)
            root = square[at] + step * step
            square[at] = root
            np.sqrt(root, out=root)
            step *= np.float32(RATE)
            step /= root
            x[at] += step

    def tables(self) -> tuple[np.ndarray, ...]:
        """Log10 scores by (class before, target), (class two before, target), log10 normalisers by both classes before, and those of groups by the class before."""
        one = (self.context * self.place[0]) @ self.target.T + self.bias
        two = (self.context * self.place[1]) @ self.target.T
        top_one, top_two = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
        z, by_two = np.empty((len(one), len(two)), np.float32), exp_of(two - top_two).T
        for i in range(0, len(one), 256):
            z[i : i + 256] = np.log(exp_of(one[i : i + 256] - top_one[i : i + 256]) @ by_two)
            z[i : i + 256] += top_one[i : i + 256] + top_two.T
        inner = np.zeros((len(self.bias), len(self.first) - 1), np.float32)
        start = 0
        while start < inner.shape[1]:  # whole groups, about 2,048 words at a time
            stop = max(start + 1, int(np.searchsorted(self.first, self.first[start] + 2048, "right")) - 1)
            a, b = self.first[start], self.first[stop]
            products = self.inner @ self.member[a:b].T + self.member_bias[a:b]
            top = products.max(axis=1, keepdims=True)
            products -= top
            inner[:, start:stop] = np.log(np.add.reduceat(exp_of(products), self.first[start:stop] - a, axis=1)) + top
            start = stop
        for x in (one, two, z, inner):
            x /= np.float32(math.log(10))
        return one, two, z, inner


class Scorer:
    """Log10 probabilities of tokens by the tables of a model. Of words that are not held, without their own smoothed count."""

    def __init__(self, lexicon: Lexicon, model: Model):
        self.lexicon, self.model = lexicon, model
        self.by_one, self.by_two, self.normal, self.inner = model.tables()

    def __call__(self, target: np.ndarray, member: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out = (self.by_one[one, target] + self.by_two[two, target] - self.normal[one, two]).astype(np.float64)
        some = np.flatnonzero(member >= 0)
        m, before = member[some], one[some]
        products = np.einsum("ij,ij->i", self.model.inner[before], self.model.member[m]) + self.model.member_bias[m]
        out[some] += products / math.log(10) - self.inner[before, self.model.group[m]]
        outside = np.flatnonzero(target < OTHERS)
        out[outside] -= self.lexicon.log_other[target[outside]]
        return out


def exp_of(x: np.ndarray) -> np.ndarray:
    """The exponential, in the place of x."""
    return np.exp(x, out=x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of x."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def train(df: DataFrame, lexicon: Lexicon) -> Model:
    """From (place, text), place being a hash of the row: a model averaged over replicas, round by round."""
    spark, name = df.sparkSession, new_name("language model")  # what a worker holds of the model before goes
    sent = spark.sparkContext.broadcast(lexicon)  # at most 1 / HOT_SHARE words
    replicas = min(REPLICAS, max(1, math.ceil(lexicon.total / EACH)))
    rounds = ROUNDS if replicas > 1 else 1
    model = Model(lexicon)
    at = F.pmod("place", F.lit(replicas * rounds))
    dealt = df.withColumn("replica", F.floor(at / rounds).cast("int")).withColumn("round", (at % rounds).cast("int"))

    def pack(batches):
        held = once_per_worker(name, lambda: sent.value)
        for whole in batches:
            for batch in chunks(whole, "text", TEXT):
                _, at, sizes = held.places(utf8(batch.column("text")))
                at, ends = at.astype("<i4"), sizes.cumsum()
                parts = [at[b - n : b].tobytes() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("replica"), batch.column("place"), pa.array(parts, pa.binary())], ["replica", "place", "ids"])

    def add(batches):
        sums = {}
        for batch in batches:
            for block, _, seen, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, values = sums.get(block, (0, 0.0))
                sums[block] = n + seen, values + np.frombuffer(part, np.float32).astype(np.float64) * seen
        for block, (n, values) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(values / n).astype(np.float32).tobytes()], pa.binary())], ["block", "part"])

    nothing = [np.zeros(0, np.int64)] * 4
    for number in range(rounds):
        start = spark.sparkContext.broadcast(model.flat())

        def walk(batches, number=number, start=start):
            held, walker = once_per_worker(name, lambda: sent.value), None
            waiting, left, size, seen, rng = [], nothing, 0, 0, None

            def step(whole: bool):
                nonlocal waiting, left, seen
                sizes = np.array([len(x) for x in waiting], np.int64)
                fresh = held.sequences(np.concatenate([np.frombuffer(x, "<i4") for x in waiting]).astype(np.int64), sizes // 4)[:4] if waiting else [np.zeros(0, np.int64)] * 4
                every = [np.concatenate(x) for x in zip(left, fresh, strict=True)]
                n = len(every[0]) // BATCH * BATCH if whole else len(every[0])
                for i in range(0, n, BATCH):
                    walker.learn(*(x[i : min(i + BATCH, n)] for x in every), rng)
                seen += n
                waiting, left = [], [x[n:] for x in every]

            def out(replica):
                step(whole=False)
                parts = np.array_split(walker.flat(), BLOCKS)
                columns = [pa.array(range(BLOCKS), pa.int32()), pa.array([replica] * BLOCKS, pa.int32()), pa.array([seen] * BLOCKS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())]
                return pa.RecordBatch.from_arrays(columns, ["block", "replica", "seen", "part"])

            last = None
            for batch in batches:
                for replica, ids in zip(batch["replica"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                    if replica != last:
                        if walker is not None:
                            yield out(last)
                        walker, waiting, left, size, seen, last = Model(held), [], nothing, 0, 0, replica
                        walker.load(start.value)
                        rng = np.random.default_rng((replica, number))
                    waiting.append(ids)
                    size += len(ids)
                    if size >= 16 * BATCH:  # four batches' places of four bytes
                        step(whole=True)
                        size = 0
            if walker is not None:
                yield out(last)

        packed = dealt.filter(F.col("round") == number).select("replica", "place", "text").mapInArrow(pack, "replica int, place long, ids binary")
        copies = packed.repartitionById(replicas, "replica").sortWithinPartitions("replica", "place", "ids").mapInArrow(walk, "block int, replica int, seen long, part binary")
        sums = copies.repartitionById(BLOCKS, "block").sortWithinPartitions("block", "replica").mapInArrow(add, "block int, part binary").orderBy("block").collect()
        if sums:
            model.load(np.concatenate([np.frombuffer(r.part, np.float32) for r in sums]))
        start.destroy()
    model.squares = []
    return model


def lexicon_of(counts: DataFrame) -> tuple[Lexicon, Column]:
    """The lexicon, and whether a row of counts is held in it."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = (counts["n"] >= F.lit(max(1, math.ceil(total * HOT_SHARE)))) | (F.length("word") == 0)
    frequent = sorted(((bytes(r.word), r.n) for r in counts.filter(hot).collect()), key=lambda r: (-r[1], r[0]))
    end = sum(n for w, n in frequent if not w)
    frequent = [r for r in frequent if r[0]]
    other = (F.crc32(F.substring("word", -3, 3)) % OTHERS).cast("int").alias("other")
    others = {r.other: (r.tokens, r.kinds) for r in counts.filter(~hot).groupBy(other).agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds")).collect()}  # at most OTHERS rows
    return Lexicon([w for w, _ in frequent], [n for _, n in frequent], end, total, distinct, others), hot


def scores(df: DataFrame, key: str, text: str, learned: Column) -> DataFrame:
    """The key, whether the row was held out of training, and the scores of each text."""
    spark = df.sparkSession
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key), F.col(text).cast("string").alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"), F.xxhash64(F.col(key).cast("string"), plain).alias("place"))
    training = rows.filter("learned")
    counts = materialise(word_counts(training, "text"), "counts")
    lexicon, hot = lexicon_of(counts)
    model = train(training.select("place", "text"), lexicon)
    sent, name = spark.sparkContext.broadcast((lexicon, model)), new_name("language model")

    def run(batches):
        scorer = once_per_worker(name, lambda: Scorer(*sent.value))
        held = scorer.lexicon
        task, made = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in chunks(whole, "text", TEXT):
                words, at, sizes = held.places(utf8(batch.column("text")))
                target, member, one, two, starts = held.sequences(at, sizes)
                tokens = sizes + 1
                log_counts = np.insert(held.log_count[at], sizes.cumsum(), held.log_end)
                base = np.add.reduceat(log_counts, starts) - tokens * held.log_all
                score = np.add.reduceat(scorer(target, member, one, two), starts)
                rare_at = np.flatnonzero(at < 0)
                rare, ends = [], sizes.cumsum()
                cuts = np.searchsorted(rare_at, np.r_[0, ends])
                for i, w in enumerate(words):
                    rare.append([w[j] for j in (rare_at[cuts[i] : cuts[i + 1]] - (ends[i] - sizes[i])).tolist()])
                known = tokens - np.diff(cuts) - (not held.known_end)
                number = (task << 40) + made + np.arange(len(words))
                made += len(words)
                columns = [pa.array(number), batch.column(0), pa.compute.invert(batch.column(2)), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score), pa.array(rare, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, ["row", key, "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    schema = f"row long, `{key}` {df.schema[key].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<binary>"
    scored = materialise(rows.drop("place").mapInArrow(run, schema), "scored")
    # The same word adds the same to both scores, so one sum per text serves them.
    rare = scored.select("row", F.explode("rare").alias("word"))
    joined = rare.join(counts.filter(~hot), "word", "left").select("row", F.log10(F.coalesce("n", F.lit(0)) + SMOOTH).alias("more"), F.col("n").isNotNull().cast("long").alias("known"))
    more = joined.groupBy("row").agg(F.sum("more").alias("more"), F.sum("known").alias("known"))
    zero = F.coalesce("more", F.lit(0.0))
    return scored.drop("rare").join(more, "row", "left").select(
        key, "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(lexicon.total)).cast("long").alias("train_tokens"), (F.col("base_score") + zero).alias("base_score"), (F.col("score") + zero).alias("score")
    )


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), "doc_id", "text", fold_column(F.col("doc_id"), 10) != 0)
