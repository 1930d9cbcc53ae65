"""Ids of texts with the content of an added token are the library's at its defaults."""

import random
import zlib

import numpy as np
import pyarrow as pa

from llm_data import documents
from strandworks.llm import common, packing, simple8b
from strandworks.llm.token_ids import encoder, vocabulary


def test_operators_ids_are_the_librarys_at_its_defaults(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    ids = lambda text: library.encode(text, add_special_tokens=False).ids
    assert 50256 in ids("a <|endoftext|> b")
    rng = random.Random(1)
    parts = ["a", "The", " ", " ", "\n", ".", "'s", "é", "9", "<|endoftext|>", "<|endoftext", "|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    found, bounds = encoder(vocabulary(), literal=False).encode(pa.array(texts))
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert found[a:b].tolist() == ids(text), repr(text)
    docs = documents(spark, [(1, "a <|endoftext|> b", "en", "s", 0), (2, "plain", "en", "s", 0)])
    start, want = 0, []
    for doc, text in ((1, "a <|endoftext|> b"), (2, "plain")):
        got = np.array([*ids(text), 2], "<u4")
        want.append((doc, start, len(got), zlib.crc32(got.tobytes())))
        start += len(got)
    manifest = simple8b.write_token_files(docs, vocabulary(), 2, common.work_dir(spark, "t"))
    assert sorted(map(tuple, simple8b.read_token_files(manifest).collect())) == want
    assert sum(r["length"] for r in packing.pack_documents(docs, vocabulary(), 1).collect()) == start
