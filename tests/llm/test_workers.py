"""What operators leave in a Python worker, which serves all stages of a pipeline one after another."""

import tracemalloc

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from weftgraph.llm import bpe, ngram_join, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_sets_of_shingles_leave_nothing():
    text = " ".join(f"w{k:x}" for k in range(60_000))
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    n = len(ngram_join.shingle_set(text, 3))
    left = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert n == 59_998 and left < 1 << 20


def test_packing_keeps_few_words_and_no_second_vocabulary(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 50)
    bpe.vocabulary.cache_clear()
    ids_of, library = packing.LibraryIds(PATH), Tokenizer.from_file(PATH)
    texts = [" ".join(f"w{k * j}" for k in range(90)) for j in range(9)] + ["", "a<|endoftext|>b", "é 漢字 😀", "<|endoftext|>"]
    for t in texts * 2:
        assert np.frombuffer(ids_of(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(ids_of.known) + len(ids_of.known.old) <= 100
    assert bpe.vocabulary.cache_info().currsize == 0
