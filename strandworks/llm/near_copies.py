"""Near copies by exact Jaccard similarity of word shingles; candidates come from anchors of SimHash fingerprints, then from bands of minimum hashes.

Two documents are linked where the sets of their lower-cased 5-word shingles have a similarity of at least 4/5. First each distinct set's fingerprint is replicated
to the anchors of simhash.py, compared there, and what differs in at most 3 of 64 bits is checked exactly. At a similarity of 4/5 two fingerprints differ in about 10 bits
and often in 17, for which no covering code is small, so the anchors alone would lose links. For the rest each distinct set gets 128 minimum
hashes in 32 bands of 4, and documents that share a band are candidates. A pair at exactly 4/5 shares none with a chance of (1 - 0.8^4)^32 = 5e-8.

Only components are asked for, so pairs that are already connected, by anchors or by bands, aren't compared again: in each bucket all members are compared with a first one (the pivot),
which then has met everybody and leaves. After PIVOTS rounds all pairs left of different components are gone through by a byte of each minimum hash; those
that agree in AGREE of 128 at least (a pair at exactly 4/5 has 102 on average, and fewer than 75 with a chance of about 1e-8) are compared exactly.
The comparison has the shingles themselves beside the sketches and gives links of a spanning forest, so what leaves a bucket never grows with the square of its members.
Buckets with more members than BLOCK, or more shingles than BLOCK_SHINGLES, are dealt out as pairs of blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash
from .components import connected_components

SEED, SHINGLE = 42, 5
#: Linked from a similarity of PART / OF.
PART, OF = 4, 5
BANDS, ROWS = 32, 4
PIVOTS, AGREE, BLOCK, BLOCK_SHINGLES = 2, 75, 2048, 4_000_000
#: Shingles that a worker keeps of texts met before.
CACHE = 2_000_000
_rng = np.random.default_rng(SEED)
_ADD, _TIMES = (_rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes, ascending, of a text's shingles; a shorter text is one shingle, one without a word the empty one."""
    from xxhash import xxh64_intdigest

    words = (text or "").lower().encode().split()  # ASCII white space only
    joined, at, starts, ends = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    spans = zip(starts, ends[SHINGLE - 1 :]) if len(words) >= SHINGLE else [(0, len(joined))]
    return np.unique(np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return OF * shared >= PART * (len(a) + len(b) - shared)


def common_hashes(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of some ascending sets, none empty, has in common with one."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))


def buckets(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """A hash of each band of the minimum hashes and of its number, and a byte of each minimum hash."""
    from xxhash import xxh64_intdigest

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[at : at + 1024] ^ _ADD) * _TIMES).min(1), out=least)
    ids = np.array([xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64).tolist()
    return ids, least.astype(np.uint8).tobytes()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key (a hash of the shingles), n (their number), fp (their fingerprint's bits as a signed long), buckets and sketch of every row."""

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in common.short(batches):
            sets = [shingles(t.as_py()) for t in batch.column(2)]
            keys = np.array([xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            fps = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
            found = [buckets(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(fps, pa.int64()), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.binary())], ["doc_id", "text_hash", "key", "n", "fp", "buckets", "sketch"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, key long, n int, fp long, buckets array<long>, sketch binary")


def hashed(texts: DataFrame) -> DataFrame:
    """key and hashes (the ascending shingle hashes, 8 bytes each) of texts (key, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in common.short(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["key", "hashes"])

    return texts.select("key", "text").mapInArrow(run, "key long, hashes binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts are similar."""

    def run(batches):
        import pyarrow as pa

        cache, held = {}, 0

        def of(key, text):
            nonlocal held
            if key not in cache:
                if held > CACHE:
                    cache.clear()
                    held = 0
                cache[key] = shingles(text.as_py())
                held += len(cache[key])
            return cache[key]

        for batch in common.short(batches):
            keep = [similar(of(a, x), of(b, y)) for a, b, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, other = (texts.select(F.col("key").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return pairs.join(other, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def close(rows: DataFrame) -> DataFrame:
    """Links (a, b) of similar keys of a bucket that join all its components that similar texts join. rows: bucket, key, n, component, sketch, buckets, hashes.

    Every pair of different components is gone through in its first common bucket, but links are no more than a bucket's components: no table of pairs is made.
    """

    def links_of(band, keys, n, label, sketch, ids, sets):
        label = label.copy()
        for k in range(len(keys) - 1):
            low, high = np.minimum(n[k], n[k + 1 :]), np.maximum(n[k], n[k + 1 :])
            (at,) = np.nonzero((label[k + 1 :] != label[k]) & (low * OF >= high * PART))
            at += k + 1
            at = at[(sketch[at] == sketch[k]).sum(1) >= AGREE]
            # a bucket of a band before has had the pair
            at = at[~(ids[at, :band] == ids[k, :band]).any(1)]
            if not len(at):
                continue
            shared = common_hashes(sets[k], [sets[j] for j in at])
            for j in at[OF * shared >= PART * (n[k] + n[at] - shared)].tolist():
                if label[j] != label[k]:
                    label[label == label[j]] = label[k]
                    yield int(keys[k]), int(keys[j])

    def compare(batches):
        """Rows come sorted by group, so a group is at hand in full when the next begins; a group has at most two blocks."""
        import pyarrow as pa

        kept = None

        def found(group, band, *columns):
            cuts = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(group)]])
            out = [x for i, j in zip(cuts, cuts[1:]) for x in links_of(band[i], *(c[i:j] for c in columns))]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            now.append(np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS))
            now.append(batch.column(6).flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS))
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(7)]
            kept = [*now, sets] if kept is None else [*(np.concatenate(x) for x in zip(kept[:-1], now)), kept[-1] + sets]
            done = int(np.searchsorted(kept[0], kept[0][-1]))
            if done:
                yield found(*(x[:done] for x in kept))
                kept = [x[done:] for x in kept]
        if kept is not None:
            yield found(*kept)

    blocks = F.least("count", F.greatest(F.ceil(F.col("count") / F.lit(BLOCK)), F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES))))
    large = common.stored(rows.groupBy("bucket").agg(F.count("*").alias("count"), F.sum("n").alias("shingles")).select("bucket", blocks.alias("blocks")).where("blocks > 1"), "large-buckets")
    columns = ["group", F.array_position("buckets", F.col("bucket")).cast("int").alias("place"), "key", "n", "component", "sketch", "buckets", "hashes"]
    if large.isEmpty():
        dealt = rows.withColumn("group", F.col("bucket")).select(columns)
    else:
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64("bucket", F.least(k, F.col("block")), F.greatest(k, F.col("block"))))
        split = rows.join(large, "bucket").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks"))).withColumn("group", F.explode(pair))
        dealt = rows.join(large, "bucket", "left_anti").withColumn("group", F.col("bucket")).select(columns).unionByName(split.select(columns))
    dealt = dealt.withColumn("place", F.col("place") - 1)
    return dealt.repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long")


def anchored(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys whose fingerprints are equal or meet at an anchor and differ in at most 3 bits; they join all keys (key, fp) that such pairs join."""
    each = common.stored(distinct.groupBy("fp").agg(F.min("key").alias("node"), F.count("*").alias("sharing")), "fingerprints")
    met = simhash.links(each.select("fp", "node"), direct=True)
    keys, nodes = common.with_salt(distinct.select("fp", "key"), each.where("sharing > 1"), ["fp"], "sharing", distinct.count(), F.xxhash64("key"))
    equal = keys.join(nodes, ["fp", "salt"]).where("key != node").select(F.col("key").alias("a"), F.col("node").alias("b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().union(equal)


def _fits(n: str, m: str):
    """Whether sets of such sizes can be similar at all."""
    return F.least(n, m) * OF >= F.greatest(n, m) * PART


def components(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (smallest doc_id that links reach), for each text of every row with an id. Rows that share an id count as one document."""
    common.prepare(docs.sparkSession)
    rows = common.stored(sketches(docs.where("doc_id is not null")), "sketches")
    distinct = common.stored(rows.groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("buckets").alias("buckets"), F.any_value("sketch").alias("sketch")), "distinct-shingles")
    members = distinct.select(F.explode("buckets").alias("bucket"), "key", "n")
    shared = members.groupBy("bucket").count().where("count > 1").select("bucket")
    members = common.stored(members.join(shared, "bucket"), "buckets")
    near = common.stored(anchored(distinct), "anchored")
    wanted = members.select("key").union(near.select("a")).union(near.select("b")).distinct()
    wanted = distinct.join(wanted, "key", "left_semi").select("key", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    texts = common.stored(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(wanted, ["doc_id", "text_hash"]).select("key", "text").dropDuplicates(["key"]), "candidates")
    # an id with several texts links their keys
    several = rows.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low != high").select("doc_id", "low")
    edges = common.stored(rows.join(several, "doc_id").select(F.col("key").alias("a"), F.col("low").alias("b")).distinct(), "links")
    edges = edges.union(common.stored(verified(near, texts), "links"))
    found = common.stored(connected_components(edges, "near-copies"), "components")
    for k in range(PIVOTS + 1):
        placed = members.join(found.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", "n", F.coalesce("component", "key").alias("component"))
        placed = common.stored(placed, "placed")
        # buckets of one component have nothing left to tell
        open_ = placed.groupBy("bucket").agg(F.min(F.struct("key", "n", "component")).alias("pivot"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket", "pivot")
        if k < PIVOTS:
            met = common.stored(placed.join(open_, "bucket").where("key != pivot.key"), "met")
            pairs = met.where((F.col("component") != F.col("pivot.component")) & _fits("n", "pivot.n")).select(F.col("pivot.key").alias("a"), F.col("key").alias("b"))
            members = met.select("bucket", "key", "n")
            pairs = common.stored(pairs.distinct(), "pairs")
            new = verified(pairs, texts)
        else:
            left = common.stored(placed.join(open_.select("bucket"), "bucket"), "left")
            sets = hashed(texts.join(left.select("key").distinct(), "key", "left_semi"))
            new = close(left.join(distinct.select("key", "sketch", "buckets").join(sets, "key"), "key"))
        new = common.stored(new, "links")
        if not new.isEmpty():
            edges = edges.union(new)
            found = common.stored(connected_components(edges, "near-copies"), "components")
    named = rows.select("doc_id", "key").join(found.withColumnRenamed("node", "key"), "key", "left").select("doc_id", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component").select("doc_id", "component_id")


def filter_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that with the group's smallest doc_id, with all its columns.

    Rows that repeat that id go but one. Rows with a null id belong to no group: one for each different text stays.
    """
    kept = common.stored(components(docs.select("doc_id", "text")).select(F.col("component_id").alias("kept_id")).distinct(), "kept-ids")
    with_id = docs.join(kept, docs["doc_id"] == kept["kept_id"], "left_semi").dropDuplicates(["doc_id"])
    return with_id.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))
