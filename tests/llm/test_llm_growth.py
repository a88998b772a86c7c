"""What a task of the packing step holds, whatever the size of the table."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from metaloom.llm import packing


def test_chunks_are_forgotten_and_texts_split_before_they_take_much_memory():
    assert packing.CACHE <= 300_000 and packing.SPLIT_BYTES <= 1 << 20
    path = public_tokenizers.path("word_bpe_49k.json")
    little, much = packing.ChunkTokenizer(path, most=5), packing.ChunkTokenizer(path)
    for k in range(4):
        texts = pa.array([f"word{k * i} again, and {i}\nmore é" for i in range(20)] + [None, ""])
        (a, n), (b, m) = little.encode(texts), much.encode(texts)
        assert np.array_equal(a, b) and np.array_equal(n, m)
