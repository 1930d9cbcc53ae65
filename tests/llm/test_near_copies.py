"""Near copies of the pipeline against brute force."""

import os
import random
import re

import pytest

from llm_data import ROWS, documents, empty
from strandworks.llm import near_copies, simhash


def brute(rows):
    """doc_id -> smallest doc_id of its group, by comparing all pairs."""
    rows = [(d, t) for d, t in rows if d is not None]
    sets = []
    for _, t in rows:
        words = (t or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)})
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def mutated(rng, base, n):
    words = list(base)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.random()}"
    return " ".join(words)


def near_rows():
    rng, out = random.Random(4), []
    for g in range(40):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 6) for _ in range(rng.choice([12, 60, 300]))]
        for k in range(5):
            out.append((10_000 - len(out), mutated(rng, base, min(len(base), k * len(base) // 90)).upper() if k == 3 else mutated(rng, base, k * len(base) // 90)))
    return out


@pytest.mark.parametrize("pivots,block", [(2, 2048), (0, 2048), (0, 8)])
def test_groups_are_those_of_brute_force(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(near_copies, "PIVOTS", pivots)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = [*((d, t) for d, t, *_ in ROWS), *near_rows(), *((500 + k, mutated(rng, base, 4)) for k in range(40))]
    want = brute(rows)
    assert len(set(want.values())) < len(want) - 20
    got = near_copies.components(documents(spark, [(d, t, "en", "s", 0) for d, t in rows])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("hashes", [4_000_000, 2000])
def test_a_group_of_unlike_texts_makes_no_table_of_pairs(spark, monkeypatch, hashes):
    """Texts that share buckets though few are similar: tables grow with the texts, not with their pairs."""
    monkeypatch.setattr(near_copies, "BLOCK_SHINGLES", hashes, raising=False)
    rng, counts = random.Random(8), {}
    base = [f"w{i}" for i in range(200)]
    rows = [(k, mutated(rng, base, 4)) for k in range(200)]
    stored = near_copies.common.stored

    def counted(df, name):
        out = stored(df, name)
        counts[name] = max(counts.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_copies.common, "stored", counted)
    got = near_copies.components(documents(spark, [(d, t, "en", "s", 0) for d, t in rows])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == (want := brute(rows))
    assert len(set(want.values())) > 150
    assert max(counts.values()) <= near_copies.BANDS * len(rows) < len(rows) * (len(rows) - 1) // 3


def test_anchors_link_copies_that_differ_in_few_bits(spark, monkeypatch):
    """Without any round of bands, similar texts whose fingerprints differ in at most 3 bits are linked, and no others."""
    monkeypatch.setattr(near_copies, "PIVOTS", -1)
    rng, rows, want, linked = random.Random(9), [], {}, 0
    for g in range(30):
        base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        pair = [" ".join(base), mutated(rng, base, 1)]
        rows += [(2 * g, pair[0]), (2 * g + 1, pair[1])]
        one, other = (simhash.majority(near_copies.shingles(t)) for t in pair)
        near = (one ^ other).bit_count() <= simhash.DIFFER
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g + (not near)}
        linked += near
    assert 5 < linked < 30
    got = near_copies.components(documents(spark, [(d, t, "en", "s", 0) for d, t in rows])).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_the_stage_drops_near_copies(spark):
    import corpus_pipeline

    rows = [(d, t, "en", "s", 0) for d, t in near_rows()] + [(None, "a", "en", "s", 0)] * 2
    docs = documents(spark, rows)
    out = corpus_pipeline.near_dedup(spark, docs, "")
    want = {d for d, least in brute([r[:2] for r in rows]).items() if d == least}
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted([*map(str, want), "None"])
    assert corpus_pipeline.near_dedup(spark, empty(spark), "").count() == 0


def plain_groups(rows):
    """Smallest id of each id's group. All pairs that can be similar are looked at: of two sets with a similarity of 4/5 or more, each has one of the other's among its rarest n - ceil(4 n / 5) + 1 shingles."""
    from collections import Counter, defaultdict

    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[i] = frozenset(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else frozenset([tuple(words)])
    first, owner = {}, {i: i for i in sets}

    def root(i):
        while owner[i] != i:
            owner[i] = i = owner[owner[i]]
        return i

    def link(a, b):
        a, b = sorted((root(a), root(b)))
        owner[b] = a

    for i in sorted(sets):
        link(first.setdefault(sets[i], i), i)
    count = Counter(s for x in first for s in x)
    having = defaultdict(list)
    linked = 0
    for x, i in first.items():
        rare = sorted(x, key=lambda s: (count[s], s))[: len(x) - -(-4 * len(x) // 5) + 1]
        for y in {y for s in rare for y in having[s]}:
            shared = len(x & y)
            if 5 * shared >= 4 * (len(x) + len(y) - shared):
                linked += 1
                link(first[y], i)
        for s in rare:
            having[s].append(x)
    return {i: root(i) for i in sets}, linked


@pytest.mark.parametrize("size", os.environ.get("NEAR_COPIES_SIZES", "sf0.01").split(","))
def test_no_link_of_the_given_documents_is_lost(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").select("doc_id", "text")
    want, linked = plain_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert linked > 0
    got = {r["doc_id"]: r["component_id"] for r in near_copies.components(docs).collect()}
    assert got == want
    print(f"{size}: {len(want)} documents, {linked} pairs of different texts linked")
