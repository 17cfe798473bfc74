import random

import pyarrow as pa
import pytest
from gridtide.llm import pieces
from hypothesis import given, settings
from hypothesis import strategies as st

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "a\t b", "a \tb", "a\t \tb", "a\r\nb", "x  y", "x  y",
    "a<|endoftext|>b", "a  <|endoftext|>  b", "<|endoftext|> c", "<s>hi</s> <unk>", "▁a ▁ b▁ c", "don't 'll  's", "\x1c a\x1cb \x1c",
    "é ́a", "ΣΑΣ ΑΣ.", "日本 語", "a" * 3000, "\x00abc \x00abc", "12 345  6", "a b   c", "a　b 　c",
]


def whole(path, texts):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def by_pieces(own, texts):
    ids, lens = own.ids(texts)
    out, at = [], 0
    for n in lens:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


@pytest.mark.parametrize("name", FILES)
def test_odd_texts_give_the_library_ids(name):
    path = pieces.tokenizer_path(name)
    own = pieces.PieceEncoder(path)
    expected = whole(path, ODD)
    for _ in range(2):  # the second time from memory
        assert by_pieces(own, ODD) == expected
    assert pieces.PieceEncoder(path, ids=False).lengths([*ODD, None]).tolist() == [*map(len, expected), 0]


@pytest.mark.parametrize("name", FILES)
def test_random_texts_and_a_tiny_memory(name, monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_PIECES", 40)
    path, rng = pieces.tokenizer_path(name), random.Random(1)
    bits = ["the", " ", "  ", "\n", "Hello", "'s", "▁", "<|endoftext|>", "\t", "é", "7", ".", "\r\n", " ", "wör", "-"]
    own = pieces.PieceEncoder(path)
    for _ in range(20):
        texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(12)]
        assert by_pieces(own, texts) == whole(path, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\tabA1.'é▁ 　\r<|>/s")), max_size=25), max_size=4))
def test_any_text(texts):
    for name in FILES:
        path = pieces.tokenizer_path(name)
        assert by_pieces(pieces.encoder(path), texts) == whole(path, texts)


def test_end_id_and_byte_balance():
    own = pieces.encoder(pieces.tokenizer_path(FILES[0]))
    ids, lens = own.ids(["", None, "a b"], end=2)
    assert lens.tolist() == [1, 1, 3] and ids.tolist()[:2] == [2, 2] and ids[-1] == 2
    ranges = list(pieces.byte_balanced([5, 50, 0, 0, 4, 4], 10))
    assert ranges == [(0, 1), (1, 2), (2, 6)] and list(pieces.byte_balanced([])) == []
    column = pa.array(["é" * 3, None, "", "abc" * 4])
    assert list(pieces.text_batches(column, 8)) == [(0, 3, ["é" * 3, None, ""]), (3, 4, ["abc" * 4])]


@pytest.mark.parametrize("untold", ["none", "some", "all"])
def test_new_words_are_encoded_without_a_string_each(untold):
    """Words are told apart by the tokens that begin with a space; where that fails they are encoded one by one."""
    path = pieces.tokenizer_path("byte_bpe_50k.json")
    own, single = pieces.PieceEncoder(path), []
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)} été{'x' * (k % 5)}q" for k in range(a, a + 300)) for a in (0, 150)] + ["", None, " end", "one"]
    if untold == "some":
        own._starts[own._lib.encode(" waa", add_special_tokens=False).ids[0]] = False
    elif untold == "all":
        own._starts[:] = False
    encode = own._encode
    own._encode = lambda strings, plain: single.extend(strings) or encode(strings, plain)
    ids, lens = own.ids(texts)
    whole = [own._lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert lens.tolist() == [len(x) for x in whole]
    assert ids.tolist() == [i for x in whole for i in x]
    assert untold != "none" or len(single) < 10
