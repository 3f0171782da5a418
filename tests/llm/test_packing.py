"""Work of the word encoder."""

import numpy as np
import pytest

from ledgerloom.llm import common as C, packing, simhash


def test_stems_are_encoded_once_a_worker():
    """A stem that comes up again with another tail, in another step, is not encoded again."""
    tokenizers = pytest.importorskip("public_tokenizers")
    encode = packing.WordEncoder(tokenizers.path("word_bpe_49k.json"))
    letters, asked = encode.letters, []

    class Counting:
        def encode_batch_fast(self, words, **kwargs):
            asked.extend(words)
            return letters.encode_batch_fast(words, **kwargs)

    encode.letters = Counting()
    texts = ["harbour, lantern", "harbour. lantern! moss", "HARBOUR lantern; moss?"]
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        ids, bounds = encode(data, np.array([0, len(data)]))
        want = encode.tokenizer.encode(text, add_special_tokens=False).ids + [packing.END]
        assert ids.tolist() == want and bounds.tolist() == [0, len(want)]
    assert sorted(asked) == ["harbour", "lantern", "moss"]


def test_memory_starts_over_when_full():
    memory = C.Memory(lambda words: [[len(w), 7] for w in words], 3)
    for words in (["a", "bb"], ["bb", "ccc"], ["dddd", "a"], []):
        ids, length = memory(words)
        assert ids.tolist() == [n for w in words for n in (len(w), 7)] and length.tolist() == [2] * len(words)


def test_a_worker_keeps_tables_of_one_operator():
    """What packing kept goes when a stage of another operator begins in the same worker."""
    closed = []

    class Table:
        def close(self):
            closed.append(self)

    table = C.own("packing").setdefault("table", Table())
    assert C.own("packing")["table"] is table and not closed
    packing_powers = C.powers(5)
    assert [b.num_rows for b in simhash._word_prints(iter([]))] == [] and closed == [table]
    assert C.own("packing") == {} and (C.powers(5) == packing_powers).all()


def test_words_are_remembered_without_their_marks():
    tokenizers = pytest.importorskip("public_tokenizers")
    encode = packing.WordEncoder(tokenizers.path("word_bpe_49k.json"))
    texts = ["harbour, Harbour. élan! élan", "", " ...", "Élan, İx, d'or; x1, éa, <|a"]
    for some in (texts[:3], texts):
        raw = [t.encode() for t in some]
        ids, bounds = encode(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
        for i, text in enumerate(some):
            want = encode.tokenizer.encode(text, add_special_tokens=False).ids + [packing.END]
            assert ids[bounds[i]: bounds[i + 1]].tolist() == want
        if some != texts:
            assert set(encode.memory.index) == {b"harbour", "élan".encode(), b",", b".", b"!", b"..."}


def test_memory_works_out_few_words_at_once():
    asked = []

    def work(words):
        asked.append(len(words))
        return [[len(w)] * len(w) for w in words]

    ids, length = C.Memory(work, 9, 2)(["a", "bb", "ccc", "bb", "", "dddd"])
    assert asked == [2, 2, 1] and length.tolist() == [1, 2, 3, 2, 0, 4]
    assert ids.tolist() == [1, 2, 2, 3, 3, 3, 2, 2, 4, 4, 4, 4]


def test_powers_go_with_the_operator():
    C.own("packing")
    C.powers(5)
    C.own("simhash")
    assert "powers" not in C.kept()
