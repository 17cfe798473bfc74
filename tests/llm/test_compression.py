"""The context-mixing coder on real documents, against zlib and the entropy of single ids; whole vocabularies; damage."""

import tracemalloc
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from gridtide.llm import context_coder, pieces

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def ids():
    own = pieces.encoder(pieces.tokenizer_path("byte_bpe_50k.json"))
    texts = pq.read_table(DOCUMENTS, columns=["text"]).column("text").combine_chunks()
    return np.concatenate([x for _, _, x, _ in own.batches(texts, end=2)]).astype(np.uint32)


def test_it_beats_zlib_and_the_entropy_of_single_ids(ids):
    coded = context_coder.encode(ids)
    assert (context_coder.decode(coded) == ids).all()
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    entropy = float(-(share * np.log2(share)).sum())
    bits, deflated = 8 * len(coded) / len(ids), 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)
    print(f"{bits:.2f} bits an id; zlib {deflated:.2f}, entropy {entropy:.2f}")
    assert bits < deflated and bits < entropy


def test_blocks_stand_alone(ids):
    """A damaged block is named; each block's checksum is its own."""
    some = ids[: 4096 * 6]
    data = bytearray(context_coder.encode(some))
    data[-10] ^= 1  # in the words of the last block
    with pytest.raises(ValueError, match="block 5"):
        context_coder.decode(bytes(data))


def test_wide_vocabularies_are_coded_in_several_groups(monkeypatch):
    monkeypatch.setattr(context_coder, "_GROUP_NUMBERS", 4000)
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, 262144, 900), rng.integers(0, 5, 3000)])
    assert (context_coder.decode(context_coder.encode(ids, 256)) == ids).all()


def test_a_wide_vocabulary_does_not_narrow_the_lockstep(monkeypatch):
    """Tables of a lane don't grow with the distinct ids, so all blocks of a call are decoded in one loop."""
    ids, calls, decoded = np.random.default_rng(7).permutation(262144), [], context_coder._decoded
    monkeypatch.setattr(context_coder, "_decoded", lambda *x: calls.append(1) or decoded(*x))
    assert (context_coder.decode(context_coder.encode(ids, 512)) == ids).all()
    assert len(calls) == 1


def test_coding_holds_few_bytes_an_id(ids):
    """Slots are looked up for some steps at a time, so a shard can be long and its lockstep wide."""
    some = np.tile(ids, -(-1_000_000 // len(ids)))[:1_000_000]
    tracemalloc.start()
    coded = context_coder.encode(some)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 25 * len(some)
    assert (context_coder.decode(coded) == some).all()


@pytest.mark.parametrize("count", [1, 63, 64, 65, 4095, 4096, 4097, 4096 * 3 + 64, 4096 * 3 + 65])
def test_last_blocks_of_any_length(ids, count):
    assert (context_coder.decode(context_coder.encode(ids[:count])) == ids[:count]).all()
