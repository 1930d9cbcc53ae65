"""Operators 5 and 10, components, and the pipeline."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_data import LONG, ROWS, documents, empty
from oracle import assert_same, connect
from strandworks.llm import common, components, queries, simhash, warc

PAGES = [(1, "http://a/ü x", "same"), (2, "http://b", "same"), (3, None, None), (4, "u", ""), (5, "u", "é" * 70_000), (6, "u", "é" * 70_000), (6, "u", "é" * 70_000), (8, "u\r\nX: y", "<p>0\r\n\r\n</p>")]


def test_archives_come_back(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(warc.with_refers_to(pages), common.work_dir(spark, "w"))).collect()
    largest = {}
    for p, _, h in PAGES:
        largest[h or ""] = max(largest.get(h or "", p), p)
    want = []
    for p, _, h in PAGES:
        raw, first = (h or "").encode(), largest[h or ""]
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == first else "revisit", None if p == first else first))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_archives_oracle(spark, small):
    assert_same(queries.QUERIES["op5_warc"](spark, small), connect(small), queries.ORACLE_SQL["op5_warc"])


def test_small_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert warc.with_refers_to(pages, 10).where("refers_to is not null").select("page_id").collect() == [(5,)]


def test_pages_with_clashing_columns_and_null_ids(spark):
    pages = spark.createDataFrame([(None, "u", "x" * 20_000, "c"), (None, "v", "x" * 20_000, "c"), (1, None, "y", None)], "page_id long, url string, html string, salt string").withColumns({c: F.lit(1) for c in ("sha", "bytes", "n", "first", "refers_to", "number")})
    got = warc.read_archives(warc.write_archives(warc.with_refers_to(pages), common.work_dir(spark, "w"))).collect()
    # rows without an id refer to nothing and are responses
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"]) for r in got) == [("1", 1, "response"), ("None", 20_000, "response"), ("None", 20_000, "response")]


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.with_refers_to(pages), common.work_dir(spark, "w"))).count() == 0


def test_segments():
    block = bytes(range(256)) * 10
    parts = [(k + 1, len(block) if k == 9 else None, block[256 * k : 256 * (k + 1)]) for k in range(10)]
    random.Random(1).shuffle(parts)
    assert warc.reassemble(parts) == block
    with pytest.raises(ValueError):
        warc.reassemble([p for p in parts if p[0] != 4])
    with pytest.raises(ValueError):
        warc.reassemble([(1, 5, b"1234")])


def test_chunks():
    for payload in (b"", b"x", b"\r\n0\r\n" * 3000):
        assert warc.unchunked(warc.chunked(payload, 7)) == payload
    assert warc.unchunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: t\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_archives_cut_short():
    import io

    whole = zlib.compressobj(wbits=31)
    raw = whole.compress(warc.record("response", [("WARC-Record-ID", "<urn:x-page:1>")], b"abc")[:-6]) + whole.flush()
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(raw)))


def test_perfect_code():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 31, 500)
    rows, codes, home = simhash.anchors(words)
    for k in range(len(words)):
        own = codes[rows == k]
        assert len(set(own.tolist())) == len(own) and home[rows == k].sum() == 1
        far = np.bitwise_count((own ^ words[k]).astype(np.uint64))
        assert (far <= 2).all() and len(own) == (1 if far.min() == 0 and len(own) == 1 else 16)
    assert (simhash.syndromes(codes) == 0).all()


def brute(rows):
    import xxhash

    fps = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted((str(d), f"{f:016x}", least.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    near = []
    for k in range(40):
        words = list(base)
        for _ in range(k % 5):
            words[rng.randrange(400)] = "zz"
        near.append((1000 - k, " ".join(words), "en", "s", 0))
    rows = [*ROWS, *near, (13, LONG, "en", "s", 0), (None, None, "en", "s", 0)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in map(tuple, got)) == brute([(d, t) for d, t, *_ in rows])
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [4096, 8])
def test_no_link_is_missed(spark, monkeypatch, block):
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(30):
            y = x
            for _ in range(rng.randint(0, 5)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    fps = sorted(fps)
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root(i), root(j)
                group[max(a, b)] = min(a, b)
    monkeypatch.setattr(simhash, "BLOCK", block)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, node long")
    got = {i: i for i in range(len(fps))} | {r["node"]: r["component"] for r in components.connected_components(simhash.links(df)).collect()}
    assert got == {i: root(i) for i in range(len(fps))}


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000, k) for k in range(100, 160)] + [(5, 5)]
    random.Random(3).shuffle(edges)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 160)}, 1000: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, small):
    import corpus_pipeline

    docs = common.table(spark, small, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, small), name)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_stages_take_odd_rows(spark, small):
    import corpus_pipeline

    for docs in (documents(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = common.stored(stage(spark, docs, small), name)
        docs.count()
