"""Operators 1, 3 and 9."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_data import ROWS, documents, empty
from strandworks.llm import common, packing, pieces, simple8b
from strandworks.llm.token_ids import Encoder, encoder, vocabulary


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def ids_of(enc, texts):
    ids, bounds = enc.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_ids_are_the_librarys(bpe):
    rng = random.Random(1)
    parts = ["a", "The", " ", " ", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'", "é", "Ä", "中", "9", "12", "\x1c", "\xa0", "!?", "×", "Ȁ", "ɐ", "\u3000", "\u2028", "x" * 40, "<|endoftext|>", "<|endoftext"]
    few = Encoder(vocabulary(), literal=False, most=100)  # most segments are forgotten after their batch
    for enc in (few, encoder(vocabulary(), literal=False)):
        for _ in range(60):
            texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) if rng.random() > 0.03 else None for _ in range(100)]
            assert ids_of(enc, texts) == [bpe(t) for t in texts]
    sliced = pa.array(["never", "a b", None, "c d"])[1:]
    assert [x.tolist() for x in few.encode_with_end(sliced, 7)] == [[*bpe("a b"), 7, 7, *bpe("c d"), 7], [0, 3, 4, 7]]


def test_every_character_is_cut_where_the_library_cuts(bpe):
    enc = Encoder(vocabulary(), literal=False, most=50_000)
    points = [c for c in range(1, 0x3400) if not 0xD800 <= c < 0xE000] + list(range(0x1F300, 0x1F400))
    texts = [f"x{chr(c)}y a {chr(c)} {chr(c)}.{chr(c)}1 q{chr(c)}" for c in points]
    for text, ids in zip(texts, ids_of(enc, texts)):
        assert ids == bpe(text), repr(text)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60_000) | st.just(0), max_size=3000), st.integers(1, 7))
def test_simple8b_comes_back(tmp_path_factory, values, parts):
    path = (tmp_path_factory.mktemp("s8b") / "x.ids").as_uri()
    writer, ids = simple8b.Writer(path), np.array(values, np.uint64)
    cuts = np.array_split(ids, parts)
    for k in range(0, parts, 2):  # two documents at a time
        two = cuts[k : k + 2]
        writer.add(list(range(k, k + len(two))), np.concatenate(two), np.cumsum([0, *map(len, two)]))
    writer.close()
    reader = simple8b.Reader(path)
    for k, (doc, _, got) in enumerate(reader):
        assert doc == k and got.tolist() == cuts[k].tolist()
    assert all(reader.document(k).tolist() == part.tolist() for k, part in enumerate(cuts))


def test_small_values_share_words():
    words, *_ = simple8b.pack(np.ones(1024, np.uint64))
    assert len(words) == -(-1024 // 60)


def test_token_files_in_order(spark, bpe):
    docs = documents(spark)
    manifest = simple8b.write_token_files(docs, vocabulary(), 2, common.work_dir(spark, "t"))
    got = sorted(map(tuple, simple8b.read_token_files(manifest).collect()), key=lambda r: r[1])
    start, want = 0, []
    for doc, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*bpe(text), 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_long_parts_go_on_in_new_files(spark):
    docs = documents(spark)
    short = simple8b.write_token_files(docs, vocabulary(), 2, common.work_dir(spark, "t"), file_docs=1)
    one = simple8b.write_token_files(docs, vocabulary(), 2, common.work_dir(spark, "t"))
    assert short.count() >= one.count()
    assert sorted(map(str, simple8b.read_token_files(short).collect())) == sorted(map(str, simple8b.read_token_files(one).collect()))


def test_no_documents_no_tokens(spark):
    manifest = simple8b.write_token_files(empty(spark), vocabulary(), 2, common.work_dir(spark, "t"))
    assert simple8b.read_token_files(manifest).count() == 0
    assert packing.pack_documents(empty(spark), vocabulary(), 1).count() == 0
    assert pieces.digest_documents(empty(spark), vocabulary("piece_bpe_32k.model")).count() == 0


def test_best_fill_is_best():
    rng = random.Random(2)
    for _ in range(300):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 8))}
        room = rng.randint(0, 60)
        used = packing.best_fill(sorted(counts), dict(counts), room)
        sums = {0}
        for k, n in counts.items():
            for _ in range(n):
                sums |= {s + k for s in sums}
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in used.items())


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(1, 300), max_size=120))
def test_windows_hold_each_id_once(sizes):
    found = packing.windows(sizes, 64)
    seen: dict = {}
    for w in found:
        assert 0 < sum(p[2] for p in w) <= 64
        for doc, start, length in w:
            seen.setdefault(doc, []).append((start, length))
    for doc, size in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == size
    assert len(found) == -(-sum(sizes) // 64)


def test_packed_pieces(spark, bpe):
    rows = packing.pack_documents(documents(spark), vocabulary(), 1).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for pieces_ in by.values():
        at = 0
        for r in sorted(pieces_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sum(r["length"] for r in rows) == sum(len(bpe(t)) + 1 for _, t, *_ in ROWS)
    nine = sorted((r for r in rows if r["doc_id"] == 9), key=lambda r: r["start"])
    ids = np.array([*bpe(ROWS[3][1]), 1], "<u4")
    for r in nine:
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids)


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(vocabulary("piece_bpe_32k.model"))


def crc_of(spans):
    return zlib.crc32(b"".join(v.to_bytes(4, "little") for s in spans for v in s))


def librarys_spans(coder, text):
    return [(p.begin, p.end) for p in coder.library.encode(text or "", return_type="proto").pieces]


def test_pieces_and_spans_are_the_librarys(coder):
    random.seed(3)
    parts = ["a", "the", "b", " ", "  ", "\n", "é", "中", "▁", "\U0001f600", ".", "x", "<s>", "\t", "\x00", "ﬁ"]
    for _ in range(3000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 12)))
        ids, spans = coder.aligned(text)
        said = coder.library.encode(text, return_type="proto")
        assert ids == coder.library.encode(text)
        assert spans == [(p.begin, p.end) for p in said.pieces], repr(text)
        ((n,), (sha,), (decoded,), (covered,), (crc,)) = coder.digest(pa.array([text]), 2)
        assert crc == crc_of(spans)
        ids = coder.library.encode(text, add_eos=True)
        assert (n, sha) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert decoded == hashlib.sha256(coder.library.decode(ids).encode()).hexdigest()
        assert covered == len(text.encode())


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_maps_are_read_as_the_library_reads_them(rule):
    import sentencepiece

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    own = pieces.Normalizer(next(v for k, v in pieces._fields(library.serialized_model_proto()) if k == 3))
    random.seed(4)
    parts = ["a", "Ⅷ", "B", " ", "  ", "\n", "é", "é", "ﬁ", "①", "　", "ガ", "ｶﾞ", ".", "\t", "​", "㍿"]
    for _ in range(1500):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 10)))
        want, offsets = library.normalize(text, with_offsets=True)
        out, origin = own.align(text)
        at, places = 0, []
        for ch in out.decode():
            places.append(origin[at])
            at += len(ch.encode())
        assert out.decode() == want
        assert [*places, origin[-1]] == [len(text[:k].encode()) for k in offsets]


def test_many_texts_at_once_are_the_librarys(coder):
    rng = random.Random(6)
    parts = ["a", "the", " ", " ", "  ", "\n", "é", "中", "▁", "\U0001f600", ".", "x" * 40, "<s>", "</s>", "<unk>", "<0x41>", "\t", "\x00", "\u3000"]
    few = pieces.PieceCoder(vocabulary("piece_bpe_32k.model"), most=100)
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) if rng.random() > 0.03 else None for _ in range(100)]
        ids, spans = few.encode(pa.array(texts, pa.string()))
        assert ids == [coder.library.encode(t or "") for t in texts]
        assert [list(map(tuple, s.tolist())) for s in spans] == [librarys_spans(coder, t) for t in texts]


def test_pieces_of_documents(spark, coder):
    got = pieces.digest_documents(documents(spark), vocabulary("piece_bpe_32k.model")).collect()
    library = coder.library
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [(d, t or "", [*library.encode(t or ""), 2]) for d, t, *_ in ROWS]
    want = sorted((str(d), len(i), sha(" ".join(map(str, i))), sha(library.decode(i)), len(t.encode()), crc_of(librarys_spans(coder, t))) for d, t, i in ids)
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, got)) == want
    spans = pieces.encode_documents(documents(spark), vocabulary("piece_bpe_32k.model")).where("doc_id = 13").first()
    assert spans["begins"][0] == 0 and spans["ends"][-1] == 3


def test_spans_of_real_texts_are_the_librarys(spark, small, coder):
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, small, "documents").select("doc_id", "text").collect()}
    got = pieces.op9_sentencepiece(spark, small).collect()
    assert {r["doc_id"]: r["spans_crc32"] for r in got} == {d: crc_of(librarys_spans(coder, t)) for d, t in texts.items()}


def test_long_chunks_are_aligned_as_short_ones(coder):
    rng = random.Random(8)
    for n in (20, 70, 500):
        for _ in range(20):
            text = "".join(rng.choice(["é", "中", "a", "  ", "\U0001f600"]) for _ in range(n))
            assert coder.aligned(text)[1] == librarys_spans(coder, text)
