"""Operator 8: toxicity by a convolutional text classifier, with thresholds calibrated by language.

A word is the sum of two rows of a hashed embedding, one for the word and one for how it begins. Filters of several widths slide over a text's words, each keeps its
largest response after a ReLU, and a linear layer makes a logit of them. The network is trained on all labelled rows outside the held-out third, from random numbers alone: tasks each train on a part of the rows, and
after every epoch their networks are averaged. Batches have as many toxic rows as others, and the rows of the embedding take steps by their own past gradients, so that a rare word's first steps are large. The language of
a text is found from its words alone, by word shares of all those rows. For each language the logit at which F1 on the held-back fifth of them is best becomes score 0.7.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .language import learnable, spelled

#: What a task holds at once while it trains: so many rows, or rows of about so many characters. Rows of a part, and the most parts.
STRETCH_ROWS, TRAIN_CHARS, PART_ROWS, MOST_PARTS = 4096, 16_000_000, 4096, 256
#: Languages that a model has at most: the most frequent ones.
LANGUAGES = 128
#: In how many pieces networks are summed.
PIECES, PART_SCHEMA = 17, "key int, part int, numbers binary"
#: Logits are counted for thresholds in steps of 1 / STEPS up to LARGEST on both sides.
STEPS, LARGEST = 256, 30.0
#: Rows of the embedding for words (as many again for beginnings of BEGINS bytes), its width, and filters of each width.
ROWS, BEGINS, WIDTH, FILTERS = 1 << 15, 4, 12, {1: 12, 2: 8, 3: 8}
EPOCHS, BATCH, RATE, DECAY, DROP = 10, 64, 0.05, 1e-5, 0.3
#: All rows are met in every epoch; there are as many epochs as it takes to meet about so many rows, between LEAST_EPOCHS and EPOCHS.
MET_ROWS, LEAST_EPOCHS = 40_000, 2
#: The spread of the embedding's first numbers, and what the sum of a row's squared gradients starts from: next to nothing, or words of few documents never move.
SCALE, FIRST_SQUARE = 0.1, 1e-8
#: The score that stands for a language's threshold, and the positives that a language needs for a threshold of its own.
CUT, LEAST_POSITIVES = 0.7, 40


def word_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two embedding rows of each word of lower-cased texts (words x 2), from 1 up, and how many words each text has."""
    data, starts = spelled(texts)
    (spaces,) = np.nonzero(data == 32)
    begins = spaces[:-1] + 1 if len(spaces) else spaces
    begins = begins[data[begins] != 32]
    n = np.searchsorted(begins, np.append(starts[1:], len(data))) - np.searchsorted(begins, starts)
    if not len(begins):
        return np.empty((0, 2), np.int32), n
    lengths = np.diff(np.append(begins, len(data)))
    place = (np.arange(begins[0], len(data)) - np.repeat(begins, lengths)).astype(np.uint64)
    mixed = (data[begins[0] :].astype(np.uint64) + np.uint64(1)) * ((place * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    mixed = np.where(data[begins[0] :] == 32, np.uint64(0), mixed ^ (mixed >> np.uint64(29)))  # spaces, of which there may be several before a text, aren't part of a word
    row = lambda values: ((np.add.reduceat(values, begins - begins[0]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(ROWS - 1)).astype(np.int32) + 1
    return np.stack([row(mixed), ROWS + row(np.where(place < BEGINS, mixed, np.uint64(0)))], axis=1), n


def laid_out(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with zeros after each text, as many as the widest filter may reach over, and where each text begins."""
    gap = max(FILTERS) - 1
    starts = np.concatenate([[0], np.cumsum(n + gap + 1)[:-1]])
    out = np.zeros((int((n + gap + 1).sum()) + gap, 2), np.int32)
    out[np.arange(len(rows)) + np.repeat(starts - (np.cumsum(n) - n), n)] = rows
    return out, starts


@dataclass
class Network:
    """Parameters, word shares of each language (rows x languages, logs), thresholds of each language, and the general one."""

    embedding: np.ndarray
    filters: dict[int, list[np.ndarray]]
    bias: dict[int, np.ndarray]
    weights: np.ndarray
    offset: float
    languages: np.ndarray
    thresholds: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """The embedding after each filter tap: looking up a row gives what a word adds to a response."""
        return {k: [self.embedding @ w for w in taps] for k, taps in self.filters.items()}

    def pooled(self, tables, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """The largest response of each filter in each text (texts x filters), and the responses of each width."""
        parts, all_, ends = [], {}, np.append(starts[1:], len(ids) - max(FILTERS) + 1)
        for k, taps in tables.items():
            r = np.zeros((len(ids) - k + 1, taps[0].shape[1]), np.float32)
            for j in range(k):
                for c in (0, 1):
                    r += taps[j][ids[j : len(ids) - k + 1 + j, c]]
            r += self.bias[k]
            np.maximum(r, 0, out=r)
            for j in range(1, k):  # windows that would reach into the next text
                r[ends - j] = 0
            parts.append(np.maximum.reduceat(r, starts, axis=0))
            all_[k] = r
        return np.concatenate(parts, axis=1), all_

    def spoken(self, rows: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The likeliest language of each text by its words' shares."""
        if not self.languages.shape[1]:
            return np.zeros(len(n), int)
        sums = np.zeros((len(n), self.languages.shape[1]), np.float32)
        (some,) = np.nonzero(n)
        if len(some):
            sums[some] = np.add.reduceat(self.languages[rows[:, 0]], (np.cumsum(n) - n)[some], axis=0)
        return sums.argmax(1)

    def scores(self, tables, texts: list[bytes]) -> np.ndarray:
        """Scores of lower-cased texts, 0.7 at the threshold of a text's language."""
        rows, n = word_rows(texts)
        ids, starts = laid_out(rows, n)
        logits = self.pooled(tables, ids, starts)[0] @ self.weights + self.offset
        z = logits - self.thresholds[self.spoken(rows, n)] + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


DENSE = [("weights", None, 0), *[("bias", k, 0) for k in FILTERS], *[("filters", k, j) for k in FILTERS for j in range(k)]]


class Trainer:
    """A network in training: the moments of the dense parameters, and of each embedding row what its squared gradients add up to and whether it was met."""

    def __init__(self, network: Network):
        self.net, self.steps = network, 0
        self.mean, self.spread = ({key: np.zeros_like(self.get(*key)) for key in DENSE} for _ in range(2))
        self.square, self.met = np.full((2 * ROWS, 1), FIRST_SQUARE, np.float32), np.zeros(2 * ROWS, bool)

    def get(self, name: str, k: int | None, j: int) -> np.ndarray:
        return self.net.weights if name == "weights" else self.net.bias[k] if name == "bias" else self.net.filters[k][j]

    def learn(self, texts: list[np.ndarray], labels: np.ndarray, sides: list[np.ndarray], rate: float, rng) -> None:
        """One pass. Batches alternate rows of both sides (places in texts); the shorter one's come again as often as it takes."""
        longer = max(map(len, sides))
        turns = np.stack([np.resize(rng.permutation(s), longer) for s in sides if len(s)], axis=1).ravel()
        for at in range(0, len(turns), BATCH):
            self.step(texts, labels, turns[at : at + BATCH], rate, rng)

    def step(self, texts: list[np.ndarray], labels: np.ndarray, batch: np.ndarray, rate: float, rng) -> None:
        net = self.net
        n = np.array([len(texts[i]) for i in batch])
        ids, starts = laid_out(np.concatenate([texts[i] for i in batch]), n)
        used, local = np.unique(ids, return_inverse=True)
        local = local.reshape(ids.shape)  # only the rows of this batch take part
        part = net.embedding[used]
        tables = {k: [part @ w for w in taps] for k, taps in net.filters.items()}
        pooled, responses = net.pooled(tables, local, starts)
        keep = rng.random(pooled.shape) >= DROP
        fed = pooled * keep / (1 - DROP)
        p = 1 / (1 + np.exp(-np.clip(fed @ net.weights + net.offset, -30, 30)))
        delta = ((p - labels[batch]) / len(batch)).astype(np.float32)
        grads = {("weights", None, 0): fed.T @ delta}
        back_pooled = np.outer(delta, net.weights) * keep / (1 - DROP)
        rows_grad = np.zeros_like(part)
        first = 0
        for k, f in FILTERS.items():
            r = responses[k]
            top = pooled[:, first : first + f]
            g = np.where(top > 0, back_pooled[:, first : first + f], 0).astype(np.float32)
            ends = np.append(starts[1:], len(r))
            where = np.stack([starts[t] + r[starts[t] : ends[t]].argmax(0) for t in range(len(batch))])
            grads[("bias", k, 0)] = g.sum(0)
            for j in range(k):
                back = (g[:, :, None] * net.filters[k][j].T).reshape(-1, WIDTH)
                grad = 0
                for side in (0, 1):
                    words = local[where + j, side]
                    grad = grad + np.einsum("bfw,bf->wf", part[words], g)
                    np.add.at(rows_grad, words.ravel(), back)
                grads[("filters", k, j)] = grad
            first += f
        self.steps += 1
        for key in DENSE:
            value, grad = self.get(*key), grads[key]
            self.mean[key] = m = 0.9 * self.mean[key] + 0.1 * grad
            self.spread[key] = v = 0.99 * self.spread[key] + 0.01 * grad * grad
            value -= (rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-8)).astype(np.float32) + DECAY * value
        net.offset -= rate * float(delta.sum()) * 10
        self.square[used] += (rows_grad * rows_grad).mean(1, keepdims=True)
        net.embedding[used] -= rate * rows_grad / np.sqrt(self.square[used] + 1e-12)
        net.embedding[0] = 0
        self.met[used[rows_grad.any(1)]] = True

    def numbers(self) -> np.ndarray:
        """The dense parameters and their moments, one after another."""
        return np.concatenate([*(x.ravel() for key in DENSE for x in (self.get(*key), self.mean[key], self.spread[key])), [self.net.offset]])

    def sums(self, before: Trainer) -> list[np.ndarray]:
        """What a part has to say of its steps since before, in PIECES arrays that add up over parts: of each embedding row it moved, by how much and that it did, and all dense numbers."""
        met = self.met[:, None]
        rows = np.concatenate([(self.net.embedding - before.net.embedding) * met, (self.square - before.square) * met, met], axis=1).astype(np.float32)
        pieces = [x.ravel() for x in np.split(rows, PIECES - 1)]
        return [*pieces, np.append(self.numbers(), [self.steps, 1]).astype(np.float32)]

    def move(self, pieces: list[np.ndarray]) -> None:
        """To the mean of what parts came to. An embedding row is moved by the mean of the parts that moved it, or words of few parts would hardly move."""
        rows = np.concatenate([x.reshape(-1, WIDTH + 2) for x in pieces[:-1]])
        by = np.maximum(rows[:, -1:], 1)
        self.net.embedding += (rows[:, :WIDTH] / by).astype(np.float32)
        self.square += (rows[:, WIDTH : WIDTH + 1] / by).astype(np.float32)
        dense, at = pieces[-1] / pieces[-1][-1], 0
        for key in DENSE:
            for kept in (None, self.mean, self.spread):
                value = self.get(*key) if kept is None else kept[key]
                value[...] = dense[at : at + value.size].reshape(value.shape)
                at += value.size
        self.net.offset, self.steps = float(dense[at]), max(1, round(float(dense[at + 1])))


def untrained(names: list[str], rng) -> Network:
    net = Network(rng.normal(0, SCALE, (2 * ROWS, WIDTH)).astype(np.float32), {k: [rng.normal(0, (2 / (k * WIDTH)) ** 0.5, (WIDTH, f)).astype(np.float32) for _ in range(k)] for k, f in FILTERS.items()}, {k: np.zeros(f, np.float32) for k, f in FILTERS.items()}, rng.normal(0, 0.3, sum(FILTERS.values())).astype(np.float32), 0.0, np.zeros((ROWS, len(names)), np.float32), np.zeros(max(1, len(names)), np.float32))
    net.embedding[0] = 0
    return net


def shares_of(counts: np.ndarray) -> np.ndarray:
    """Logs of the shares of a language's words, from their counts."""
    return np.log((counts + 0.1) / (counts.sum() + 0.1 * ROWS))


def indifferent(net: Network, toxic: bool) -> Network:
    """Where there is nothing to tell apart."""
    net.weights[:] = 0
    net.thresholds[:] = -5.0 if toxic else 5.0
    return net


def threshold(z: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> float:
    """The logit, between two of z, above which F1 is best; toxic, other: how many rows of each kind have a logit."""
    by = np.argsort(-z)
    z, toxic, other = z[by], toxic[by], other[by]
    hit, wrong = np.cumsum(toxic), np.cumsum(other)
    f1 = 2 * hit / (hit + wrong + toxic.sum())
    top = np.nonzero(f1 >= f1.max() - 1e-12)[0]
    k = int(top[len(top) // 2])
    return float((z[k] + (z[k + 1] if k + 1 < len(z) else z[k] - 2)) / 2)


def calibrate(net: Network, z: np.ndarray, spoken: np.ndarray, toxic: np.ndarray, other: np.ndarray) -> Network:
    """Sets the thresholds: a language's own where it has enough toxic rows, else that of all rows."""
    everywhere = threshold(z, toxic, other) if toxic.sum() else 0.0
    for k in range(len(net.thresholds)):
        own = spoken == k
        enough = toxic[own].sum() >= LEAST_POSITIVES
        net.thresholds[k] = threshold(z[own], toxic[own], other[own]) if enough else everywhere
    return net


def judged(net: Network, tables, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The logit and the likeliest language of each text of word rows."""
    n = np.array([len(t) for t in texts])
    rows = np.concatenate(texts)
    ids, starts = laid_out(rows, n)
    return net.pooled(tables, ids, starts)[0] @ net.weights + net.offset, net.spoken(rows, n)


def fit(texts: list[np.ndarray], labels: np.ndarray, langs: list[str | None], weights: np.ndarray, seed: int = 7) -> Network:
    """Trains on word rows of texts that are at hand. weights: how many rows each stands for; used for thresholds only.

    A fifth of the rows is held back for thresholds.
    """
    rng = np.random.default_rng(seed)
    names = sorted({x for x in langs if x is not None})
    net = untrained(names, rng)
    for k, name in enumerate(names):
        counts = np.zeros(ROWS, np.float64)
        for rows, lang in zip(texts, langs):
            if lang == name:
                counts += np.bincount(rows[:, 0], minlength=ROWS)
        net.languages[:, k] = shares_of(counts)
    if not 0 < labels.sum() < len(labels):
        return indifferent(net, labels.sum() > 0)
    order = rng.permutation(len(texts))
    back, front = order[: len(order) // 5], order[len(order) // 5 :]
    trainer = Trainer(net)
    for epoch in range(EPOCHS):
        trainer.learn(texts, labels, [front[labels[front] == k] for k in (0, 1)], RATE * (1 - epoch / EPOCHS), rng)
    if not len(back):  # too few rows to hold any back
        return net
    z, spoken = judged(net, net.tables(), [texts[i] for i in back])
    return calibrate(net, z, spoken, labels[back] * weights[back], (1 - labels[back]) * weights[back])


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums by key of arrays of numbers (key int, part int, numbers binary of floats), always in the order of parts. Keys are few and their arrays of fixed size."""

    def run(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, numbers in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(numbers.as_buffer(), np.float32).astype(np.float64)
                sums[key] = sums[key] + own if key in sums else own
        for key, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["key", "numbers"])

    got = parts.repartition(PIECES, "key").sortWithinPartitions("key", "part").select("key", "numbers").mapInArrow(run, "key int, numbers binary")
    return {r["key"]: np.frombuffer(r["numbers"]) for r in got.toLocalIterator()}


def labelled(docs: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """doc_id, lang, toxic, chars, words (word rows as pairs of 16 bits) and back (held back for thresholds) of each labelled id with a text, dealt to so many parts by id, in the order of a hash.

    Of several rows with one id the longest text counts.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in common.short(batches):
            ids, n = word_rows([t.encode() for t in pc.utf8_lower(batch.column(4)).to_pylist()])
            pairs = (ids - np.array([0, ROWS], np.int32)).astype(np.uint16)
            cuts = np.cumsum(n)
            words = [pairs[b - k : b].tobytes() for b, k in zip(cuts.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(words, pa.binary())], ["doc_id", "lang", "toxic", "chars", "words"])

    texts = docs.where("doc_id is not null and text is not null").where(F.pmod(common.crc_of_id(F.col("doc_id")), F.lit(3)) != 1).select("doc_id", "text", "lang")
    joined = texts.repartition(parts, "doc_id").join(labels.repartition(parts, "doc_id"), "doc_id")
    each = joined.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(F.struct(F.length("text").alias("chars"), "text", "lang")).alias("row"))
    ready = each.sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("doc_id", "row.lang", "toxic", "row.chars", "row.text")
    out = ready.mapInArrow(run, "doc_id long, lang string, toxic int, chars int, words binary")
    return out.withColumn("back", F.pmod(F.xxhash64(F.lit("held back"), "doc_id"), F.lit(5)) == 0)


def unpacked(words) -> np.ndarray:
    """Word rows from an Arrow value of labelled's words."""
    return np.frombuffer(words.as_buffer(), np.uint16).reshape(-1, 2).astype(np.int32) + np.array([0, ROWS], np.int32)


def train(docs: DataFrame, labels: DataFrame, train_chars: int = TRAIN_CHARS, part_rows: int = PART_ROWS, seed: int = 7) -> Network:
    """Learns from all labelled rows outside the held-out third, with their whole texts however long. train_chars: about how many characters' rows a task holds at once, unless a text alone has more.

    In each epoch every part of the rows goes on by itself from the same network, and the next begins at the mean of all parts' networks. Ids with more than one label count as toxic if any of them does; null labels and texts
    aren't used; of rows that share an id one is.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    usable = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(F.pmod(common.crc_of_id(F.col("doc_id")), F.lit(3)) != 1)
    parts = max(1, min(MOST_PARTS, -(-usable.count() // part_rows)))
    rows = labelled(docs, usable, parts).persist(StorageLevel.DISK_ONLY)
    try:
        found = {(r["back"], r["toxic"]): r["count"] for r in rows.groupBy("back", "toxic").count().collect()}  # four rows at most
        names = sorted(learnable(rows.where("lang is not null"), LANGUAGES))
        net = untrained(names, np.random.default_rng(seed))
        if names:
            number = F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int") - 1

            def count(batches):
                import pyarrow as pa
                from pyspark import TaskContext

                counts: dict[int, np.ndarray] = {}
                for batch in common.short(batches):
                    for lang, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                        counts[lang] = counts.get(lang, 0) + np.bincount(unpacked(words)[:, 0], minlength=ROWS)
                for lang, own in counts.items():
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([own.astype(np.float32).tobytes()], pa.binary())], ["key", "part", "numbers"])

            for k, own in added(rows.where(F.col("lang").isin(names)).select(number, "words").mapInArrow(count, PART_SCHEMA)).items():
                net.languages[:, k] = shares_of(own)
        toxic, other = (sum(n for (_, t), n in found.items() if t == k) for k in (1, 0))
        if not toxic or not other:
            return indifferent(net, toxic > 0)
        front = sum(n for (back, _), n in found.items() if not back)
        trainer, epochs = Trainer(net), min(EPOCHS, max(LEAST_EPOCHS, -(-MET_ROWS // max(front, 1))))
        for epoch in range(epochs if front else 0):
            shared = spark.sparkContext.broadcast(trainer)  # of fixed size
            got = added(rows.where("not back").select("toxic", "chars", "words").mapInArrow(part_of_epoch(shared, RATE * (1 - epoch / epochs), train_chars, [seed, epoch]), PART_SCHEMA))
            trainer.move([got[k] for k in range(PIECES)])
            shared.destroy()
        shared = spark.sparkContext.broadcast(net)

        def logits(batches):
            import pyarrow as pa

            tables = shared.value.tables()
            for batch in common.short(batches):
                z, spoken = judged(shared.value, tables, [unpacked(w) for w in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spoken.astype(np.int32)), pa.array(np.rint(np.clip(z, -LARGEST, LARGEST) * STEPS).astype(np.int32))], ["toxic", "spoken", "z"])

        counted = rows.where("back").select("toxic", "words").mapInArrow(logits, "toxic int, spoken int, z int").groupBy("spoken", "z").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("other")).orderBy("spoken", "z").toArrow()
        shared.destroy()
        if counted.num_rows:
            spoken, z, toxic, other = (c.to_numpy() for c in counted.columns)
            calibrate(net, z / STEPS, spoken, toxic, other)
        return net
    finally:
        rows.unpersist()


def part_of_epoch(shared, rate: float, train_chars: int, seed: list[int]):
    """A task's part of an epoch: rows (toxic, chars, words) are learned a stretch at a time. A stretch without toxic rows, or without others, learns with the ones met last."""

    def run(batches):
        import copy

        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before, trainer = shared.value, copy.deepcopy(shared.value)
        trainer.met[:] = False
        rng = np.random.default_rng([*seed, part])
        held: list[list[np.ndarray]] = [[], []]
        last: list[list[np.ndarray]] = [[], []]

        def learn():
            for k in (0, 1):
                last[k] = held[k][-BATCH:] or last[k]
            sides = [held[k] or last[k] for k in (0, 1)]
            n = len(sides[0])
            places = [np.arange(n), np.arange(n, n + len(sides[1]))]
            trainer.learn(sides[0] + sides[1], np.repeat([0.0, 1.0], [n, len(sides[1])]), places, rate, rng)
            held[0], held[1] = [], []

        chars = 0
        for batch in common.short(batches):
            for toxic, n, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held[toxic].append(unpacked(words))
                chars += n
                if len(held[0]) + len(held[1]) >= STRETCH_ROWS or chars >= train_chars:
                    learn()
                    chars = 0
        if held[0] or held[1]:
            learn()
        if trainer.steps > before.steps:
            numbers = [x.tobytes() for x in trainer.sums(before)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([part] * PIECES, pa.int32()), pa.array(numbers, pa.binary())], ["key", "part", "numbers"])

    return run


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, score and predicted of every row, from its whole text however long. Null text: empty, which has a score too; repeated rows and null ids stay."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(network)  # of fixed size

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        tables = shared.value.tables()
        for batch in common.short(batches):
            scores = shared.value.scores(tables, [t.encode() for t in pc.utf8_lower(pc.fill_null(batch.column(1), "")).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= CUT).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted."""
    docs = common.table(spark, sf_dir, "documents")
    network = train(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, network).select("doc_id", (F.pmod(common.crc_of_id(F.col("doc_id")), F.lit(3)) == 1).alias("held_out"), "score", "predicted")
