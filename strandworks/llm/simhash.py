"""Operator 10: SimHash near-duplicates by anchor points of a covering code.

A document's fingerprint has a bit set where over half the hashes of its word shingles have it set. Two fingerprints that differ in at most 3 of
64 bits differ in at most 1 bit of one half or the other, so each half is covered by itself. The anchors of a half are the words of the Hamming
code of length 31, a perfect code: every 31-bit word lies within 1 bit of exactly one anchor (its home). If two words differ in at most 1 bit, the
home of either lies within 1 + 1 = 2 bits of the other. So every distinct fingerprint is replicated to the 16 anchors within 2 bits of each half, and
compared at each anchor with the fingerprints at home there. No link of at most 3 bits is missed.

Comparison runs over rows sorted by anchor, in blocks, and gives only the links of a spanning forest of each anchor's fingerprints, never all pairs.
Anchors with more fingerprints than BLOCK are dealt out as pairs of blocks. A half has 2^26 anchors and a fingerprint 16 places, so up to some 10^10 distinct fingerprints an
anchor is a block or less and work grows with the fingerprints; beyond, it grows with their square over 2^26, as it must for any code of 31 bits, and results stay whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import connected_components

SEED, SHINGLE, DIFFER = 42, 3, 3
#: Fingerprints of an anchor that are compared in one go; more are dealt out by pairs of blocks of this many.
BLOCK = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text; 0 where it has no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, at, starts, ends = b" ".join(words), 0, [], []
        for w in words:
            starts.append(at)
            at += len(w)
            ends.append(at)
            at += 1
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]
    return majority(np.array(hashes, "<u8"))


def majority(h: np.ndarray) -> int:
    """The unsigned 64-bit number with the bits that are set in over half of some hashes."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(h), 4096):
        counts += np.unpackbits(h[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row. Null text: 0."""

    common.prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in common.short(batches):
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """The exclusive or of the places (1 to 31) of the set bits of 31-bit words: 0 for the words of the Hamming code."""
    out = np.zeros(len(words), np.int64)
    for place in range(1, 32):
        out ^= ((words >> (place - 1)) & 1) * place
    return out


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code words within 2 bits of 31-bit words: row of the word, code word, whether it is the word's home (within 1 bit)."""
    s, n = syndromes(words), len(words)
    bit = lambda place: np.where(place > 0, np.int64(1) << (np.maximum(place, 1) - 1), 0)
    rows, codes, home = [np.arange(n)], [words ^ bit(s)], [np.ones(n, bool)]
    for place in range(1, 32):  # with the other place of the pair that makes up the syndrome
        other = s ^ place
        (r,) = np.nonzero((s > 0) & (other > place))
        rows.append(r)
        codes.append(words[r] ^ bit(np.full(len(r), place)) ^ bit(other[r]))
        home.append(np.zeros(len(r), bool))
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(home)


def forest(fps: np.ndarray, nodes: np.ndarray, home: np.ndarray, direct: bool = False) -> list[tuple[int, int]]:
    """Links (node, smallest linked node) of one anchor's fingerprints, where one of a compared pair is at home and they differ in at most 3 bits. direct: as many compared pairs."""
    parent, pairs = list(range(len(fps))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    fps = fps.view(np.uint64)  # bitwise_count takes the absolute value of signed ones
    (at_home,) = np.nonzero(home)
    if not len(at_home):
        return []
    for k in at_home.tolist():
        for j in np.nonzero(np.bitwise_count(fps ^ fps[k]) <= DIFFER)[0].tolist():
            a, b = root(k), root(j)
            if a != b:
                parent[b] = a
                pairs.append((int(nodes[k]), int(nodes[j])))
    if direct:
        return pairs
    best: dict[int, int] = {}
    for i in range(len(fps)):
        r = root(i)
        best[r] = min(best.get(r, nodes[i]), nodes[i])
    return [(int(nodes[i]), int(best[root(i)])) for i in range(len(fps)) if nodes[i] != best[root(i)]]


def links(distinct: DataFrame, direct: bool = False) -> DataFrame:
    """Links (a, b) that join all of distinct fingerprints (fp, node) that differ in at most 3 bits, directly or through others. direct: each link's own fingerprints differ so little."""

    def replicate(batches):
        import pyarrow as pa

        for batch in batches:
            fps, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for half in (0, 1):
                rows, codes, home = anchors((fps >> (32 * half)) & 0x7FFFFFFF)
                yield pa.RecordBatch.from_arrays([pa.array(codes << 1 | half, pa.int64()), pa.array(home), pa.array(fps[rows], pa.int64()), pa.array(nodes[rows], pa.int64())], ["anchor", "home", "fp", "node"])

    def compare(batches):
        """Rows come sorted by group, so a group is at hand in full when the next begins; a group has at most two blocks."""
        import pyarrow as pa

        kept = None

        def found(group, home, fps, nodes, last):
            cuts = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [len(group)]])
            stop = len(cuts) - 1 if last else len(cuts) - 2
            out = []
            for k in np.nonzero(np.diff(cuts[: stop + 1]) > 1)[0]:
                a, b = cuts[k], cuts[k + 1]
                if home[a:b].any():
                    out += forest(fps[a:b], nodes[a:b], home[a:b], direct)
            return out, cuts[stop]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["a", "b"])

        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            kept = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
            if len(kept[0]) < 50_000 and batch.num_rows:
                continue
            out, done = found(*kept, False)
            kept = [x[done:] for x in kept]
            if out:
                yield batch_of(out)
        if kept is not None and len(kept[0]):
            out, _ = found(*kept, True)
            if out:
                yield batch_of(out)

    replicas = common.stored(distinct.mapInArrow(replicate, "anchor long, home boolean, fp long, node long"), "replicas")
    # anchors with more than a block
    hot = replicas.groupBy("anchor").count().where(F.col("count") > BLOCK)
    hot = common.stored(hot.withColumn("blocks", F.ceil(F.col("count") / F.lit(BLOCK))), "hot-anchors")
    if hot.isEmpty():
        dealt = replicas.withColumn("group", F.col("anchor"))
    else:
        cold = replicas.join(hot, "anchor", "left_anti").withColumn("group", F.col("anchor"))
        block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.xxhash64("anchor", F.least(k, F.col("block")), F.greatest(k, F.col("block"))))
        dealt = cold.select("group", "home", "fp", "node").unionByName(replicas.join(hot.select("anchor", "blocks"), "anchor").withColumn("block", block).withColumn("group", F.explode(pair)).select("group", "home", "fp", "node"))
    return dealt.select("group", "home", "fp", "node").repartition("group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that links reach) of every row of documents.

    Links: at most 3 differing bits; texts without a word have fingerprint 0 and link like any other. Null text: no word; long texts count whole. Rows that share an id
    are not linked by that. Rows with a null id link like others; the component is null if none of its rows has an id. An empty table gives no rows; other columns don't matter.
    """
    fps = common.stored(fingerprints(docs), "fingerprints")
    distinct = common.stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    components = common.stored(connected_components(links(distinct.select("fp", F.col("fp").alias("node"))), "near-duplicates"), "components")
    # few fingerprints have a link; those that have none are components by themselves
    linked = distinct.join(components, distinct["fp"] == components["node"]).select("fp", "least", "component")
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "component").select("fp", "component_id")
    labelled = distinct.join(named, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    rows, labelled = common.with_salt(fps, common.stored(labelled, "labelled"), ["fp"], "n", fps.count(), F.xxhash64("doc_id"))
    out = rows.join(labelled.drop("n"), ["fp", "salt"])
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document: doc_id, fingerprint, component_id."""
    common.prepare(spark)
    return near_duplicates(common.table(spark, sf_dir, "documents"))
