"""Context-mixing range coder for token ids.

Ids are cut into blocks that are coded independently. Within a block three
models predict the next id:

- order 2 and order 1 predict the id that followed the last two ids, or the last
  one, when they stood there before in the block. Their tables keep the context itself beside
  the id, so a prediction is always made from the right context.
- order 0 gives every id the frequency that it has, in the whole call, where neither of the others was right.

Which of them is right is itself predicted: for each state of confidence the
call counts how often order 2, order 1 or neither was, and these counts mix the
three. A range coder (asymmetric numerals) codes that choice, and an id by order 0 where neither of the others has it.
Every block starts with empty tables, and carries a checksum.

All blocks of a group are coded in lockstep, one numpy lane per block. An encoder
knows all ids beforehand, so its predictions are made by sorting, without a loop over
time; a decoder steps through the same tables. Choice and id together take 31 bits of
slots, so a step moves at most one word of 32 bits, in or out.

Layout (little-endian): magic, u32 ids in all, u32 ids per block, u32 blocks, u32
distinct ids, u32 bytes of the deflated head (differences of the distinct ids, then their
slots, as u32, then order 2's and order 1's slots of each state, as u16); the head; then per block u32 words and u32 CRC-32
of its ids; then the words (u32) of all blocks.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"GTCM0003"
#: Ids of a block, blocks that are coded in lockstep, and blocks that are modelled together when encoding.
BLOCK_IDS, LANES, MODELLED = 4096, 2048, 32
_STEPS = 64  # whose slots are looked up together when encoding
#: Ids are at most so large: 18 bits stand for one in the tables of contexts.
MOST_ID = 262143
_CHOICE_BITS, _ID_BITS = 11, 20  # slots of the choice, and of order 0
_CHOICE, _SLOTS = 1 << _CHOICE_BITS, 1 << _ID_BITS
_LEAST = 1 << 31  # a coder's register is never smaller between steps
_BITS1, _BITS2 = 11, 12  # places of the context tables
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D)
_STATES = 128
_HAS2, _HAS1 = (np.arange(_STATES) >> 4) > 0, ((np.arange(_STATES) >> 1 & 7) > 0) & (np.arange(_STATES) & 1 == 0)
#: The state for each pair of confidences as the decoder holds them: order 1's in 3 bits, order 2's in 3, whether they differ.
_BY_CONFIDENCE = (np.arange(_STATES) >> 3 & 7) << 4 | (np.arange(_STATES) & 7) << 1 | (np.arange(_STATES) < 64)
_GROUP_NUMBERS = 1 << 24  # entries of all lanes' context tables


def _place1(p1: np.ndarray) -> np.ndarray:
    return (p1 * _K1) >> np.uint64(64 - _BITS1)


def _place2(pair: np.ndarray) -> np.ndarray:
    return (pair * _K2) >> np.uint64(64 - _BITS2)


def _shared(counts: np.ndarray, slots: int) -> np.ndarray:
    """``slots`` shared out by ``counts``: whole numbers that sum up to it, 1 at least."""
    freq = 1 + (counts * ((slots - len(counts)) / max(int(counts.sum()), 1))).astype(np.int64)
    freq[freq.argmax()] += slots - freq.sum()
    return freq


def _choices(counts: np.ndarray) -> np.ndarray:
    """Slots of neither, order 1 and order 2: a row per state, from how often each was right; none where there is no prediction."""
    out = np.zeros((_STATES, 3), np.int64)
    for state, own in enumerate(counts):
        some = np.flatnonzero([True, _HAS1[state], _HAS2[state]])
        out[state, some] = _shared(own[some], _CHOICE)
    return out


def _lane_groups(lanes: int) -> list[tuple[int, int]]:
    size = max(1, min(LANES, _GROUP_NUMBERS // ((1 << _BITS1) + (1 << _BITS2))))
    return [(a, min(a + size, lanes)) for a in range(0, lanes, size)]


# --- encoding


def _followed(place: np.ndarray, bits: int, context: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``place`` of a lane's table predicts at each step (-1: nothing), and its confidence (0: none, then 1 to 4)."""
    shift = int(len(x) - 1).bit_length()
    at = np.arange(len(x), dtype=np.int64)
    key = (((at // n) << bits) + place.astype(np.int64)) << shift | at
    key.sort()
    order = key & ((1 << shift) - 1)
    own, seen = context[order], x[order]
    same = np.zeros(len(order), bool)
    same[1:] = (own[1:] == own[:-1]) & ((key[1:] ^ key[:-1]) < (1 << shift))
    hit = same.copy()
    hit[1:] &= seen[1:] == seen[:-1]
    run = at - np.maximum.accumulate(np.where(hit, -1, at))
    said, sure = np.empty(len(order), np.int32), np.empty(len(order), np.uint8)
    now, past = np.zeros(len(order), np.uint8), np.full(len(order), -1, np.int32)
    now[1:] = (np.minimum(run[:-1], 3) + 1) * same[1:]
    past[1:] = np.where(same[1:], seen[:-1], -1)
    sure[order], said[order] = now, past
    return said, sure


def _model(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """State, and who is right (0: neither, 1: order 1, 2: order 2), at each id: a row per block."""
    lanes, n = x.shape
    flat = x.ravel()
    before = np.full((lanes, n + 2), width, np.uint64)
    before[:, 2:] = x
    p1 = before[:, 1:-1].ravel()
    pair = p1 * np.uint64(width + 1) + before[:, :-2].ravel()
    c1, f1 = _followed(_place1(p1), _BITS1, p1, flat, n)
    c2, f2 = _followed(_place2(pair), _BITS2, pair, flat, n)
    agree = c1 == c2
    right = np.where(c2 == flat, 2, c1 == flat).astype(np.uint8)
    return (f2 << 4 | f1 << 1 | agree).reshape(lanes, n), right.reshape(lanes, n)


def _coded(x: np.ndarray, who: np.ndarray, slots: np.ndarray, choices: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of each block, one after another, and how many each has. Only the last block may be shorter: ``last`` ids.

    A row per block: the id that order 0 is asked for, or ``len(slots)``, and three times the state plus who is right.
    """
    u = np.uint64
    wide0, start0 = np.append(slots, _SLOTS).astype(u), np.append(np.cumsum(slots) - slots, 0).astype(u)  # where it isn't asked, order 0 has all its slots
    wide1 = choices.astype(u).ravel()
    start1 = (np.cumsum(choices[:, ::-1], 1)[:, ::-1] - choices).astype(u).ravel()  # order 2 first, then order 1, then neither
    lanes, n = x.shape
    reg, half = np.full(lanes, _LEAST, u), np.full(lanes, 32, u)
    room = n + 2
    out, pos = np.zeros(lanes * room, np.uint32), np.arange(1, lanes + 1, dtype=np.int64) * room
    first = n if lanes > 1 else last
    while first:
        stop, first = first, max(last if first > last else 0, first - _STEPS)
        m = lanes if stop <= last else lanes - 1
        asked, chosen = np.ascontiguousarray(x[:m, first:stop].T), np.ascontiguousarray(who[:m, first:stop].T)
        f0, f1, s0, s1 = wide0[asked], wide1[chosen], start0[asked], start1[chosen]
        bound, more0, more1 = f0 * f1, u(_SLOTS) - f0, u(_CHOICE) - f1
        own, by = reg[:m], half[:m]
        for t in range(stop - first - 1, -1, -1):
            high = own >> by
            full = (high >= bound[t]).nonzero()[0]
            if len(full):
                at = pos[full]
                at -= 1
                pos[full] = at
                out[at] = own[full].astype(np.uint32)  # its low half
                own[full] = high[full]
            part = own // f0[t]
            part *= more0[t]
            part += s0[t]
            own += part
            part = own // f1[t]
            part *= more1[t]
            part += s1[t]
            own += part
    for part in (reg, reg >> half):
        pos -= 1
        out[pos] = part.astype(np.uint32)
    words = out.reshape(lanes, room)
    begin = pos - np.arange(lanes) * room
    return words[np.arange(room) >= begin[:, None]].astype("<u4", copy=False), room - begin


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """Ids (0 to ``MOST_ID``) as coded bytes."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and int(ids.max()) > MOST_ID:
        raise ValueError(f"ids above {MOST_ID} can't be coded")
    lanes = -(-len(ids) // block_ids)
    if not lanes:
        return MAGIC + np.array([0, block_ids, 0, 0, 0], "<u4").tobytes()
    sums = [zlib.crc32(ids[k : k + block_ids]) for k in range(0, len(ids), block_ids)]
    names = np.flatnonzero(np.bincount(ids))
    dense = np.zeros(int(names[-1]) + 1, np.int32)
    dense[names] = np.arange(len(names))
    last, width = len(ids) - (lanes - 1) * block_ids, len(names)
    n = block_ids if lanes > 1 else last
    x = np.zeros(lanes * n, np.int32)
    x[: len(ids)] = dense[ids]
    x = x.reshape(lanes, n)
    who, missed, counts = np.empty((lanes, n), np.uint16), np.zeros(width, np.int64), np.zeros(3 * _STATES, np.int64)
    for a in range(0, lanes, MODELLED):
        part = x[a : a + MODELLED]
        state, right = _model(part, width)
        own = who[a : a + MODELLED]
        own[:] = state * np.uint16(3) + right
        used = slice(0, len(ids) - a * n)  # without what fills the last block up
        missed += np.bincount(part.ravel()[used][right.ravel()[used] == 0], minlength=width)
        counts += np.bincount(own.ravel()[used], minlength=3 * _STATES)
        part[right > 0] = width
    slots, choices = _shared(missed, _SLOTS), _choices(counts.reshape(_STATES, 3))
    head = np.diff(names, prepend=0).astype("<u4").tobytes() + slots.astype("<u4").tobytes() + choices[:, :0:-1].astype("<u2").tobytes()
    head = zlib.compress(head, 9)
    table, words = [], []
    for a, b in _lane_groups(lanes):
        coded, pos = _coded(x[a:b], who[a:b], slots, choices, last if b == lanes else n)
        words.append(coded.tobytes())
        table += pos.tolist()
    blocks = np.stack([np.array(table, np.int64), np.array(sums, np.int64)], 1).astype("<u4").tobytes()
    return b"".join([MAGIC, np.array([len(ids), block_ids, lanes, width, len(head)], "<u4").tobytes(), head, blocks, *words])


# --- decoding


def decode(data: bytes) -> np.ndarray:
    """The ids again (uint32); an error if the bytes aren't whole or a block's checksum differs."""
    if data[:8] != MAGIC or len(data) < 28:
        raise ValueError("not a coded id block file")
    n, block_ids, lanes, width, size = np.frombuffer(data, "<u4", 5, 8).astype(np.int64).tolist()
    if not lanes:
        return np.zeros(0, np.uint32)
    if not block_ids or lanes != -(-n // block_ids) or len(data) < 28 + size + 8 * lanes:
        raise ValueError("the block table is cut off")
    try:
        head = zlib.decompress(data[28 : 28 + size])
    except zlib.error as e:
        raise ValueError("the head is damaged") from e
    if not width or len(head) != 8 * width + 4 * _STATES:
        raise ValueError("the head is damaged")
    names, slots = np.frombuffer(head, "<u4", 2 * width).astype(np.int64).reshape(2, width)
    names = np.cumsum(names)
    by_state = np.frombuffer(head, "<u2", 2 * _STATES, 8 * width).astype(np.int64).reshape(_STATES, 2)
    if slots.sum() != _SLOTS or not slots.all() or (by_state.sum(1) > _CHOICE).any() or by_state[~_HAS2, 0].any() or by_state[~_HAS1, 1].any():
        raise ValueError("the head is damaged")
    table = np.frombuffer(data, "<u4", 2 * lanes, 28 + size).reshape(lanes, 2).astype(np.int64)
    kept = np.frombuffer(data[28 + size + 8 * lanes :], np.uint8)
    if len(kept) != 4 * table[:, 0].sum() or (table[:, 0] < 2).any() or names[-1] > MOST_ID:
        raise ValueError("the coded words are cut off")
    names, kept, at, out = names.astype("<u4"), kept.view("<u4"), np.concatenate([[0], np.cumsum(table[:, 0])]), []
    last = n - (lanes - 1) * block_ids
    steps = block_ids if lanes > 1 else last
    for a, b in _lane_groups(lanes):
        x = _decoded(kept[at[a] : at[b]], table[a:b, 0], steps, last if b == lanes else steps, slots, by_state)
        out.append(names[x.T])
    ids = np.ascontiguousarray(np.concatenate(out).ravel()[:n])
    for i in range(lanes):
        if zlib.crc32(ids[i * block_ids : (i + 1) * block_ids]) != table[i, 1]:
            raise ValueError(f"block {i} fails its checksum")
    return ids


def _decoded(words: np.ndarray, lens: np.ndarray, n: int, last: int, slots: np.ndarray, by_state: np.ndarray) -> np.ndarray:
    """Places of ids in the table of distinct ones, a row per step.

    A step is bound by its calls and not by its lanes, so order 1 and order 2 are two rows of the same arrays.
    """
    u = np.uint64
    lanes, width, half = len(lens), len(slots), u(32)
    starts = np.cumsum(lens) - lens
    pos = starts + 2
    reg = words[starts].astype(u) << u(32) | words[starts + 1]
    words = np.concatenate([words, np.zeros(n + 2, np.uint32)]).astype(u)  # a damaged lane may read on
    # for each slot of the choice and confidence (order 1's in 3 bits, order 2's in 3, whether they differ): slots of who is right, the slot less the start (12 bits), who (2)
    wide = np.concatenate([by_state, _CHOICE - by_state.sum(1, keepdims=True)], 1)
    who = np.repeat(np.tile([2, 1, 0], _STATES), wide.ravel())
    inside = np.tile(np.arange(_CHOICE), _STATES) - np.repeat((np.cumsum(wide, 1) - wide).ravel(), wide.ravel())
    choice = (np.repeat(wide.ravel(), wide.ravel()) << 14 | inside << 2 | who).reshape(_STATES, _CHOICE)[_BY_CONFIDENCE].T.ravel().astype(np.uint32)
    id_of = np.repeat(np.arange(width, dtype=np.int32), slots)
    slots_of, start_of = slots.astype(u), (np.cumsum(slots) - slots).astype(u)
    # a place of a table: context, id (18 bits), confidence (3 bits of order 2, 3 of order 1); no prediction is an id that can't be, with no confidence
    table, none = np.full(lanes * ((1 << _BITS1) + (1 << _BITS2)), ~u(0), u), u(1 << 24)
    grown, other = np.zeros(66, u), np.array([[64], [65]], u)
    grown[[1, 2, 3, 4, 64]], grown[[8, 16, 24, 32, 65]] = [2, 3, 4, 4, 1], [16, 24, 32, 32, 8]
    lane = np.arange(lanes, dtype=u)
    base = np.stack([lane << u(_BITS1), (lane << u(_BITS2)) + u(lanes << _BITS1)])
    out = np.zeros((n, lanes), np.uint32)
    before = np.full((2, lanes), width, u)  # the last id; the last two
    before[1] += u(width * (width + 1))
    for first, stop, m in ((0, last, lanes), (last, n if lanes > 1 else last, lanes - 1)):
        s, before, base, pos = reg[:m], np.ascontiguousarray(before[:, :m]), np.ascontiguousarray(base[:, :m]), pos[:m]
        # numpy takes whole arrays faster than numbers
        zero, one, two, three, six, bits, slot_mask, id_bits, id_mask, state_bits, state_mask, most, inside_mask, wide_bits, least, pairs = (
            np.full(m, x, u) for x in (0, 1, 2, 3, 6, _CHOICE_BITS, _CHOICE - 1, _ID_BITS, _SLOTS - 1, 7, 63, 64, 0xFFF, 14, _LEAST, width + 1)
        )
        factor, shift, other, up, down, nothing = (
            np.repeat(np.array([[x], [y]], u), m, 1) for x, y in ((_K1, _K2), (64 - _BITS1, 64 - _BITS2), (64, 65), (24, 24), (6, 6), (none, none))
        )
        for t in range(first, stop):
            place = before * factor
            place >>= shift
            place += base
            place = place.view(np.int64)
            context = before << up
            said = table[place]
            said ^= context
            np.minimum(said, nothing, said)
            state = said[0] ^ said[1]
            key = s & slot_mask
            key <<= state_bits
            key |= state & state_mask
            np.minimum(state, most, state)
            state &= most
            key |= state
            own = choice[key.view(np.int64)].astype(u)
            s >>= bits
            s *= own >> wide_bits
            inside = own >> two
            inside &= inside_mask
            s += inside
            own &= three
            slot = s & id_mask
            found = id_of[slot.view(np.int64)].astype(np.int64)
            part = s >> id_bits
            part *= slots_of[found]
            part += slot
            part -= start_of[found]
            np.copyto(s, part, where=own == zero)
            x = found.view(u)
            ids = said >> down
            np.copyto(x, ids[0], where=own == one)
            np.copyto(x, ids[1], where=own == two)
            small = (s < least).nonzero()[0]
            if len(small):
                at = pos[small]
                part = s[small]
                part <<= half
                part |= words[at]
                s[small] = part
                at += 1
                pos[small] = at
            out[t, :m] = x
            own = x << six
            said ^= own
            np.minimum(said, other, said)
            said = grown[said.view(np.int64)]
            said |= own
            said |= context
            table[place] = said
            pair = x * pairs
            pair += before[0]
            before[0], before[1] = x, pair
    return out
