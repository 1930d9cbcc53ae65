"""Operator 6: languages of documents as mixtures, by expectation-maximisation over n-gram likelihoods.

A language's model gives each byte of a lower-cased word, and the space after it, a probability after the three bytes before: an interpolation of its shares among n-grams of one to
four bytes, counted in hashed tables over a bounded sample of documents with that language. A document's words are taken as drawn from a mixture of the
languages; expectation-maximisation finds the proportions. From all languages, the one of least proportion is dropped as long as the
penalised likelihood does not fall, which leaves the document's set of languages; the prediction is the one of the largest proportion.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: At most about so many documents of each language are counted for its model.
TRAIN_DOCS, TRAIN_TASKS = 1500, 8
#: A model has at most so many languages, of 0.8 MB each: driver and workers hold all of them.
LANGUAGES = 128
#: Entries of a table of hashed n-grams, the weights of orders 4 to 1, and what is left for bytes never seen.
TABLE, WEIGHTS, UNSEEN = 1 << 16, (0.45, 0.3, 0.15, 0.099), 0.001 / 256
#: Rounds of expectation-maximisation, and the penalty for a language more, times the logarithm of the number of words.
ROUNDS, PENALTY = 8, 2.0
#: Bytes worked on at once.
STRIDE = 1 << 19
#: A document with a lower share for its language is rejected by filter_documents.
LEAST_SHARE = 0.5
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[65:91] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


@dataclass
class Model:
    """languages, and for each order a table of counts (entries x languages)."""

    languages: list[str]
    tables: list[np.ndarray]


def spelled(texts: list[bytes], apart: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 texts as one run of bytes, words apart by single spaces and so many before each text; and where each text begins, with its spaces."""
    gap = b" " * apart
    raw = _KEEP[np.frombuffer(gap + gap.join(texts) + b" ", np.uint8)]
    starts = np.cumsum([0, *(len(t) + apart for t in texts)])
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    for k in range(apart):
        keep[starts[:-1] + k] = True
    return raw[keep], (np.cumsum(keep) - 1)[starts[:-1]]


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Table entries of the n-grams of one to four bytes that end at each byte from the fourth on."""
    b = data.astype(np.uint32)
    two = b[2:-1] << 8 | b[3:]
    three = b[1:-2] << 16 | two
    four = b[:-3] << 24 | three
    return [b[3:], two, three * np.uint32(0x9E3779B1) >> np.uint32(16), four * np.uint32(0x85EBCA6B) >> np.uint32(16)]


def log_likelihoods(model: Model, data: np.ndarray) -> np.ndarray:
    """Log-probability of each byte from the fourth on in each language."""
    counts = [t[g] for t, g in zip(model.tables, grams(data))]
    p = np.full_like(counts[0], UNSEEN)
    p += WEIGHTS[3] * counts[0] / model.tables[0].sum(0)
    for n in (1, 2, 3):
        p += WEIGHTS[3 - n] * np.minimum(counts[n] / np.maximum(counts[n - 1], 1), 1)
    return np.log(p, out=p)


def word_likelihoods(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each word in each language, and how many words each text has."""
    data, starts = spelled(texts, 4)  # so that a text's first word doesn't hang on the text before
    padded = np.concatenate([np.full(3, 32, np.uint8), data])
    (spaces,) = np.nonzero(data == 32)
    begins = spaces[:-1] + 1 if len(spaces) else spaces  # a word begins after a space and ends with the next
    begins = begins[data[begins] != 32]
    n = np.searchsorted(begins, np.append(starts[1:], len(data))) - np.searchsorted(begins, starts)
    parts, k = [], 0
    while k < len(begins):  # stretches of whole words
        stop = max(k + 1, int(np.searchsorted(begins, begins[k] + STRIDE)))
        a, b = begins[k], begins[stop] if stop < len(begins) else len(data)
        each = log_likelihoods(model, padded[a : b + 3])
        each[np.nonzero((data[a + 1 : b] == 32) & (data[a : b - 1] == 32))[0] + 1] = 0  # only one space is part of a word
        parts.append(np.add.reduceat(each, begins[k:stop] - a, axis=0))
        k = stop
    return (np.concatenate(parts) if parts else np.empty((0, len(model.languages)), np.float32)), n


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of n values each, n > 0, along the last axis."""
    return np.add.reduceat(values, np.cumsum(n) - n, axis=-1)


def proportions(likelihoods: np.ndarray, n: np.ndarray, active: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (languages x texts) of mixtures of the active languages, and their log-likelihoods.

    likelihoods: languages x words; n: words of each text, over 0; active: languages x texts.
    """
    share = active / active.sum(0)
    top = np.where(np.repeat(active, n, axis=1), likelihoods, -np.inf).max(0)
    relative = np.exp(np.minimum(likelihoods - top, 0)).astype(np.float32)
    for _ in range(rounds):
        weight = relative * np.repeat(share.astype(np.float32), n, axis=1)
        weight /= weight.sum(0)
        share = _sums(weight, n) / n
    mixed = (relative * np.repeat(share.astype(np.float32), n, axis=1)).sum(0)
    return share, _sums(np.log(np.maximum(mixed, 1e-30)) + top, n)


def select(likelihoods: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Proportions (texts x languages) over each text's language set of best penalised likelihood, dropping languages of least proportion one at a time.

    likelihoods: words x languages; n: words of each text, over 0.
    """
    likelihoods = np.ascontiguousarray(likelihoods.T)
    languages, texts = len(likelihoods), len(n)
    cost = PENALTY * np.log(n + 1.0)
    alone = _sums(likelihoods.astype(np.float64), n)
    best = np.zeros((languages, texts))
    best[alone.argmax(0), np.arange(texts)] = 1
    score = alone.max(0)
    # no mixture is likelier than each word's likeliest language: where even that doesn't pay for a second language, one is enough
    bound = _sums(likelihoods.max(0).astype(np.float64), n)
    (open_,) = np.nonzero(bound - score > cost)
    if languages > 1 and len(open_):
        chosen = np.zeros(texts, bool)
        chosen[open_] = True
        part, m, active = likelihoods[:, np.repeat(chosen, n)], n[open_], np.ones((languages, len(open_)), bool)
        for size in range(languages, 1, -1):
            share, like = proportions(part, m, active)
            penalised = like - cost[open_] * (size - 1)
            better = penalised > score[open_]
            best[:, open_[better]], score[open_[better]] = share[:, better], penalised[better]
            active[np.where(active, share, np.inf).argmin(0), np.arange(len(open_))] = False
    return best.T


def learnable(usable: DataFrame, most: int) -> dict[str, int]:
    """Documents of each language that a model is made of: the most frequent ones, of equally frequent ones the first by name. Others are named in a warning by their number and their documents'."""
    counts = usable.groupBy("lang").count()
    first = counts.orderBy(F.desc("count"), "lang").limit(most + 1).collect()
    if len(first) > most:
        n, rows = counts.agg(F.count("*"), F.sum("count")).first()
        warnings.warn(f"{n - most} values of lang with {rows - sum(r['count'] for r in first[:most])} documents aren't learned: a model has the {most} most frequent", stacklevel=3)
    return {r["lang"]: r["count"] for r in first[:most]}


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, most: int = LANGUAGES) -> Model:
    """Counts n-grams of a bounded sample of the documents that have a language and a text, in tasks that each give a table.

    A column of many values (a dirty one) gives the most frequent ones and a warning.
    """
    common.prepare(docs.sparkSession)
    usable = docs.where("lang is not null and text is not null").where(F.pmod(common.crc_of_id(F.col("doc_id")), F.lit(4)) != 2)
    counts = learnable(usable, most)
    languages = sorted(counts)
    if not languages:
        return Model([], [])
    bounds = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(common.sample_bound(train_docs / counts[k])))))
    sample = usable.where(common.sampled(F.xxhash64("doc_id", "text"), bounds[F.col("lang")])).select("lang", "text")
    sizes = (256, TABLE, TABLE, TABLE)

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        tables: dict[str, list[np.ndarray]] = {}
        for batch in common.short(batches):
            lowered = pc.utf8_lower(batch.column(1)).to_pylist()
            for lang, text in zip(batch.column(0).to_pylist(), lowered):
                data, _ = spelled([text.encode()])
                own = tables.setdefault(lang, [np.zeros(s, np.int64) for s in sizes])
                for table, g in zip(own, grams(np.concatenate([np.full(3, 32, np.uint8), data]))):
                    table += np.bincount(g, minlength=len(table))
        for lang, own in tables.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": pa.array([np.concatenate(own).astype("<i4").tobytes()], pa.binary())})

    # the sample is bounded, so TRAIN_TASKS do, each of which sends the driver a table of fixed size for each language
    tables = {k: np.zeros(sum(sizes), np.float32) for k in languages}
    for row in sample.repartition(TRAIN_TASKS).mapInArrow(count, "lang string, counts binary").toLocalIterator():
        tables[row["lang"]] += np.frombuffer(row["counts"], "<i4")
    if lacking := [k for k in languages if not tables[k].any()]:
        raise ValueError(f"no document of {lacking} was sampled")
    joined = np.stack([tables[k] for k in languages], axis=1)
    return Model(languages, np.split(joined, np.cumsum(sizes)[:-1]))


def predict(model: Model, column) -> tuple[list[str], list[float]]:
    """Language and its share for each text of an Arrow column; und and 0 where a text is null or has no letter."""
    import pyarrow.compute as pc

    lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    names, shares = ["und"] * len(column), [0.0] * len(column)
    if not model.languages:
        return names, shares
    texts = [t.encode() for t in pc.utf8_lower(pc.fill_null(column, "")).to_pylist()]
    likelihoods, n = word_likelihoods(model, texts)
    (spoken,) = np.nonzero(n > 0)
    if len(spoken):
        best = select(likelihoods, n[spoken])
        for k, share in zip(spoken.tolist(), best):
            if lettered[k]:
                names[k], shares[k] = model.languages[share.argmax()], float(min(1.0, share.max()))
    return names, shares


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its whole text however long. Of languages of equal share the first by name is predicted.

    Repeated rows and null ids stay; null texts and those without a letter are und with score 0; an empty table gives no rows.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # tables of fixed size for each language

    def run(batches):
        import pyarrow as pa

        for batch in common.short(batches):
            names, shares = predict(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def filter_documents(docs: DataFrame, model: Model, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows whose language has at least least_share of their words, with all their columns; texts without a letter go."""
    spark = docs.sparkSession
    common.prepare(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in common.short(batches):
            names, shares = predict(shared.value, batch.column(at))
            yield batch.filter(pa.array([(n != "und" and s >= least_share) or not shared.value.languages for n, s in zip(names, shares)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(common.crc_of_id(doc_id), F.lit(4)) == 2


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document: doc_id, held_out, lang_pred, score."""
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
