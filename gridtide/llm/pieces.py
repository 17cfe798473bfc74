"""Whole-text encoding through memoised pieces.

All three public tokenizers split a text before they merge characters, and no
token crosses the place between a non-blank character and a single space with
another non-blank character behind it. A text is therefore cut at such places,
and where the vocabulary's own rules always cut (in front of punctuation behind
an ASCII letter). Each distinct piece is encoded by the tokenizer library, and the
ids of the text are the concatenation of the ids of its pieces. Runs of blanks and
rare blanks are never cut: they stay inside one piece.

Pieces are found, hashed and looked up as bytes in numpy; a worker remembers
a bounded number of pieces by two 64-bit hashes each, in arrays of some 50 MB,
and no strings. Long pieces, and those that may hold a special token, are not
remembered but encoded anew in each batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import itertools
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pieces that a worker remembers, and ids of theirs; beyond it, those that only one batch had are forgotten.
MEMORY_PIECES, MEMORY_IDS = 500_000, 4_000_000
_BITS = 20  # of the hash table's places
#: UTF-8 bytes of text that one batch holds; a longer text is worked off in windows of so many.
BATCH_BYTES = 1 << 19
#: A longer piece is not remembered.
LONG_PIECE = 64
#: Pieces that are encoded by one call.
_CALL = 4096
#: Stands between pieces that are encoded together.
_BETWEEN = "\x01"

_loaded: dict[tuple[str, bool], PieceEncoder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoder(path: str, ids: bool = True) -> PieceEncoder:
    """The worker's own encoder for a vocabulary file."""
    if (path, ids) not in _loaded:
        _loaded[path, ids] = PieceEncoder(path, ids)
    return _loaded[path, ids]


def release() -> None:
    """Drop all encoders of this worker, and give freed memory back."""
    if _loaded:
        _loaded.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)  # glibc


def tidy(run: Callable, encodes: bool = False) -> Callable:
    """A function of Arrow batches that leaves a lean worker behind, as workers are used again by later stages.

    It begins without the encoders of earlier stages, unless it ``encodes`` itself.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (give_back if encodes else release)()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


# --- bytes


def _class_table() -> np.ndarray:
    """Kind of each byte: 1 starts a character that is surely not blank, 2 goes on with one, 0 else.

    Left out are the characters that start with C2, E1, E2 or E3, some of which are blanks.
    """
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = kinds[0xC3:0xE0] = kinds[0xE4:0xF5] = 1
    kinds[0x80:0xC0] = 2
    return kinds


_CLASS = _class_table()
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_PUNCTUATION = [c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum()]
_HASHES = 2
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd
_CODE = np.random.Generator(np.random.Philox(50)).integers(1, 1 << 63, (_HASHES, 256), dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64)] * _HASHES
_inverses: list[np.ndarray] = [np.ones(1, np.uint64)] * _HASHES


def _grow_powers(n: int) -> None:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate(_BASE):
            for kept, x in ((_powers, base), (_inverses, pow(base, -1, 1 << 64))):
                steps = np.full(size, x, np.uint64)
                steps[0] = 1
                kept[k] = np.cumprod(steps, dtype=np.uint64)


def _surely_not_blank(data: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a character that is surely not blank."""
    kinds = _CLASS[data]
    ok, more = kinds == 1, kinds == 2
    if more.any():
        for _ in range(3):
            ok[1:] |= more[1:] & ok[:-1]
    return ok


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins (one more than texts)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, values = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


class PieceEncoder:
    """Encode texts; ``ids=False`` remembers lengths only.

    Kinds, by the vocabulary: ``byte`` (byte-level BPE, a space belongs to the
    word behind it), ``word`` (white space is dropped, A-Z is a-z), ``piece``
    (sentencepiece). A null text counts as empty.
    """

    def __init__(self, path: str, ids: bool = True) -> None:
        self.with_ids, self._special, self._cuts, self._starts, self._between = ids, [], np.zeros(256, bool), None, None
        if path.endswith(".model"):
            import sentencepiece

            self.kind, self._lib = "piece", sentencepiece.SentencePieceProcessor(model_file=path)
            names = (self._lib.id_to_piece(i) for i in range(self._lib.get_piece_size()))
            if any("▁" in x.lstrip("▁") for x in names):
                raise ValueError("a piece of this vocabulary crosses a space; texts can't be cut there")
        else:
            self._read_tokenizer(path)
        self._code = _CODE.copy()
        if self.kind == "word":
            self._code[:, 0x41:0x5B] = self._code[:, 0x61:0x7B]
        self._reset()

    def _read_tokenizer(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._lib = Tokenizer.from_file(path)
        own = json.loads(self._lib.to_str())
        added = own["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or len(t["content"]) < 2 or any(c.isspace() for c in t["content"]) for t in added):
            raise ValueError("a special token of this vocabulary reaches beyond its own text; texts can't be cut")
        self._special = [t["content"].encode() for t in added]
        drops_blanks = not self._lib.encode(" ", add_special_tokens=False).ids
        lowers = drops_blanks and self._lib.normalizer is not None and self._lib.normalizer.normalize_str("AZ") == "az"
        if drops_blanks and not lowers:
            raise ValueError("a vocabulary that drops blanks is taken to drop case too")
        self.kind = "word" if drops_blanks else "byte"
        within = {t[k : k + 1] for t in self._special for k in range(1, len(t)) if t[k - 1 : k].isalpha()}
        for c in _PUNCTUATION:  # where the vocabulary always cuts behind a letter
            first = self._lib.pre_tokenizer.pre_tokenize_str(f"ab{c}")[0][1]
            self._cuts[ord(c)] = first == (0, 2) and c.encode() not in within
        names = self._lib.get_vocab(with_added_tokens=True)
        if self.kind == "byte":  # a piece that begins with its only space has one token that begins with one
            self._starts = np.zeros(max(names.values()) + 1, bool)
            self._starts[[i for t, i in names.items() if t.startswith("Ġ")]] = True
        else:
            alone = self._lib.encode(_BETWEEN, add_special_tokens=False).ids
            self._between = alone[0] if len(alone) == 1 else None

    # --- memory

    def _reset(self, entries: int = 0) -> None:
        size = 1 << 16
        while size < entries:
            size *= 2
        self._key, self._entry = np.zeros(1 << _BITS, np.uint64), np.zeros(1 << _BITS, np.int32)
        self._check, self._first = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self._start, self._len, self._batches = (np.zeros(size, np.int32) for _ in range(3))
        self._flat = np.zeros(1 << 16, np.uint32)
        self._n = self._used = 0

    def _forget(self) -> None:
        """Keep the pieces that most batches had: two at least, half of the memory at most."""
        batches = self._batches[: self._n]
        order = np.argsort(-batches, kind="stable")[: MEMORY_PIECES // 2]
        order = order[batches[order] > 1]
        lens = self._len[order].astype(np.int64)
        kept = np.sort(order[np.cumsum(lens) <= MEMORY_IDS // 2]) if self.with_ids else np.sort(order)
        first, check, lens, start, counts, flat = self._first[kept], self._check[kept], self._len[kept].astype(np.int64), self._start[kept], self._batches[kept], self._flat
        self._reset(len(kept))
        n = self._n = len(kept)
        self._first[:n], self._check[:n], self._len[:n], self._batches[:n] = first, check, lens, counts
        if self.with_ids:
            own = _gathered(flat, start.astype(np.int64), lens)
            self._flat = np.concatenate([own, np.zeros(1 << 16, np.uint32)])
            self._start[:n], self._used = np.cumsum(lens) - lens, len(own)
        self._place(first, np.arange(n, dtype=np.int32))

    def _place(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Enter distinct keys into the hash table."""
        at, open_ = (keys >> np.uint64(64 - _BITS)).astype(np.int64), np.arange(len(keys))
        while len(open_):
            free = open_[self._key[at[open_]] == 0]
            self._key[at[free]] = keys[free]
            mine = self._key[at[open_]] == keys[open_]
            self._entry[at[open_[mine]]] = entries[open_[mine]]
            open_ = open_[~mine]
            at[open_] = (at[open_] + 1) & ((1 << _BITS) - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's entry, -1 where there is none."""
        found, at, open_ = np.full(len(keys), -1, np.int64), (keys >> np.uint64(64 - _BITS)).astype(np.int64), np.arange(len(keys))
        while len(open_):
            there = self._key[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self._entry[at[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
            at[open_] = (at[open_] + 1) & ((1 << _BITS) - 1)
        return found

    # --- cutting

    def _pieces(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every piece, and the number of pieces of each text."""
        n, full = len(data), begins[1:] > begins[:-1]
        cut = np.zeros(n + 1, bool)
        if self.kind == "word":
            inside = ~_BLANK[data]
            cut[1:n] = inside[1:] & ~inside[:-1]
            cut[begins[:-1][full]] = True
        else:
            ok = _surely_not_blank(data)
            alone = np.zeros(n, bool)
            alone[1:-1] = ok[:-2] & ok[2:]
            alone[begins[1:][full] - 1] = False  # a blank at the end of a text
            cut[:n] = (data == 0x20) & alone
            if self.kind == "byte":
                line = np.flatnonzero((data == 0x0A) & alone)
                cut[line] = cut[line + 1] = True
            cut[begins[:-1][full]] = True
        if self._cuts.any() and n:
            cut[1:n] |= self._cuts[data[1:]] & _LETTER[data[:-1]]
        starts = np.flatnonzero(cut[:n])
        stops = np.append(starts[1:], n)
        if self.kind == "word":  # up to the next blank
            blank = np.flatnonzero(~inside)
            following = np.append(blank, n)[np.searchsorted(blank, starts)]
            stops = np.minimum(stops, following)
            full_piece = stops > starts
            starts, stops = starts[full_piece], stops[full_piece]
        counts = np.diff(np.searchsorted(starts, begins))
        if self.kind == "piece":  # the space between two pieces is each later one's own
            starts = starts + ((data[starts] == 0x20) & ~np.isin(starts, begins))
        return starts, stops, counts

    def _hashes(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[np.ndarray]:
        _grow_powers(len(data) + 1)
        out, total = [], np.zeros(len(data) + 1, np.uint64)
        for k in range(_HASHES):
            np.cumsum(self._code[k][data] * _powers[k][: len(data)], out=total[1:])
            x = (total[stops] - total[starts]) * _inverses[k][starts]
            x = (x ^ (x >> np.uint64(32))) * _MIX
            out.append((x ^ (x >> np.uint64(29))) | np.uint64(1))
        return out

    # --- encoding

    def _library(self, strings: list[str]) -> list[list[int]]:
        if self.kind == "piece":
            return self._lib.encode(strings, num_threads=1)
        return [x.ids for x in self._lib.encode_batch_fast(strings, add_special_tokens=False)]

    def _encode(self, strings: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings in one array, and how many each has. ``plain`` ones are encoded together, as that is faster."""
        lens, own = np.zeros(len(strings), np.int64), [np.zeros(0, np.uint32)] * len(strings)
        rest = np.flatnonzero(~plain).tolist() if self._between is not None else list(range(len(strings)))
        if self._between is not None:
            groups = np.flatnonzero(plain)
            groups = [groups[k : k + 256] for k in range(0, len(groups), 256)]
            for g, ids in zip(groups, self._library([f" {_BETWEEN} ".join(strings[k] for k in g) for g in groups]), strict=True):
                ids = np.array(ids, np.uint32)
                between = np.flatnonzero(ids == self._between)
                at, ends = np.append(0, between + 1), np.append(between, len(ids))
                if len(at) != len(g):  # never seen; the pieces are then encoded one by one
                    rest += g.tolist()
                    continue
                for k, a, b in zip(g.tolist(), at.tolist(), ends.tolist(), strict=True):
                    own[k] = ids[a:b]
        for k in range(0, len(rest), _CALL):
            some = rest[k : k + _CALL]
            for i, ids in zip(some, self._library([strings[i] for i in some]), strict=True):
                own[i] = np.array(ids, np.uint32)
        lens[:] = [len(x) for x in own]
        return np.concatenate(own) if own else np.zeros(0, np.uint32), lens

    def _encode_new(self, data: np.ndarray, raw: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces in one array, how many each has, and where they begin."""
        plain = self._plain(data, starts, stops)
        joined, counts, own = np.flatnonzero(plain), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        if self._starts is not None and len(joined):
            own, counts, whole = self._joined(data, starts[joined], stops[joined])
            joined, plain = joined[whole], np.zeros(len(plain), bool)
        else:
            joined = joined[:0]
        alone = np.ones(len(starts), bool)
        alone[joined] = False
        rest = np.flatnonzero(alone)
        strings = [raw[a:b].decode() for a, b in zip(starts[rest].tolist(), stops[rest].tolist(), strict=True)]
        more, more_counts = self._encode(strings, plain[rest])
        lens, where, order = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.concatenate([joined, rest])
        lens[order] = ordered = np.concatenate([counts, more_counts])
        where[order] = np.cumsum(ordered) - ordered
        return np.concatenate([own, more]), lens, where

    def _joined(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of plain pieces of kind ``byte``, encoded 256 together, how many each has, and for which pieces that holds.

        No string is made of a single piece: the tokens that begin with a space tell where the next one begins.
        """
        ends = np.cumsum(stops - starts)
        raw, edges = _gathered(data, starts, stops - starts).tobytes(), [0, *ends[255:-1:256].tolist(), int(ends[-1])]
        found = self._library([raw[a:b].decode() for a, b in itertools.pairwise(edges)])
        sizes = np.array([len(x) for x in found])
        ids = np.concatenate([np.array(x, np.uint32) for x in found])
        begins = self._starts[ids]
        group, held = np.repeat(np.arange(len(found)), sizes), np.full(len(found), 256)
        held[-1] = len(starts) - 256 * (len(found) - 1)
        good = np.bincount(group[begins], minlength=len(found)) == held
        good &= begins[np.cumsum(sizes) - sizes]
        ids, begins = ids[good[group]], begins[good[group]]  # others were never seen; their pieces are then encoded one by one
        at = np.flatnonzero(begins)
        return ids, np.diff(np.append(at, len(ids))), np.repeat(good, held)

    def _learn(self, data: np.ndarray, raw: bytes, starts: np.ndarray, stops: np.ndarray, first: np.ndarray, check: np.ndarray) -> None:
        """Encode new pieces (distinct by ``first``) and remember them."""
        flat, lens, where = self._encode_new(data, raw, starts, stops)
        end = self._n + len(starts)
        while end > len(self._len):
            self._check, self._first, self._start, self._len, self._batches = (np.concatenate([x, np.zeros_like(x)]) for x in (self._check, self._first, self._start, self._len, self._batches))
        self._first[self._n : end], self._check[self._n : end], self._len[self._n : end] = first, check, lens
        if self.with_ids:
            while self._used + len(flat) > len(self._flat):
                self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
            self._flat[self._used : self._used + len(flat)] = flat
            self._start[self._n : end] = self._used + where
            self._used += len(flat)
        self._place(first, np.arange(self._n, end, dtype=np.int32))
        self._n = end

    def _plain(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Whether pieces can be encoded together: nothing odd in them, and for ``byte`` one space, in front."""
        odd = np.concatenate([[0], np.cumsum(~_surely_not_blank(data))])
        if self.kind == "byte":
            return (data[starts] == 0x20) & (odd[stops] == odd[np.minimum(starts + 1, stops)]) & (stops > starts + 1)
        return odd[stops] == odd[starts]

    def _window(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
        """All ids of some texts in one array (None without ids), and how many each text has."""
        starts, stops, counts = self._pieces(data, begins)
        if not len(starts):
            return (np.zeros(0, np.uint32) if self.with_ids else None), np.zeros(len(counts), np.int64)
        first, check = self._hashes(data, starts, stops)
        direct = stops - starts > LONG_PIECE
        for token in self._special:
            marks = np.flatnonzero((data[:-1] == token[0]) & (data[1:] == token[1]))
            if len(marks):
                direct[np.maximum(np.searchsorted(starts, marks, side="right") - 1, 0)] = True
        raw = data.tobytes()
        places = np.empty(len(starts), np.int64)
        known = np.flatnonzero(~direct)
        places[known] = self._find(first[known])
        new = known[places[known] < 0]
        if len(new):
            _, one = np.unique(first[new], return_index=True)
            if self._n + len(one) > MEMORY_PIECES or self._used > MEMORY_IDS:
                self._forget()
                places[known] = self._find(first[known])
                new = known[places[known] < 0]
                _, one = np.unique(first[new], return_index=True)
            one = new[one]
            for k in range(0, len(one), _CALL * 8):
                some = one[k : k + _CALL * 8]
                self._learn(data, raw, starts[some], stops[some], first[some], check[some])
            places[new] = self._find(first[new])
        direct[known[self._check[places[known]] != check[known]]] = True  # another piece has its first hash
        known = np.flatnonzero(~direct)
        had = np.zeros(self._n, bool)
        had[places[known]] = True
        self._batches[: self._n] += had
        lens = np.zeros(len(starts), np.int64)
        lens[known] = self._len[places[known]]
        odd, own, own_lens = np.flatnonzero(direct), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(odd):
            strings = [raw[a:b].decode() for a, b in zip(starts[odd].tolist(), stops[odd].tolist(), strict=True)]
            names = {s: k for k, s in enumerate(dict.fromkeys(strings))}
            own, own_lens = self._encode(list(names), np.zeros(len(names), bool))
            which = np.array([names[s] for s in strings])
            lens[odd] = own_lens[which]
        totals = _sums(lens, counts)
        if not self.with_ids:
            return None, totals
        where = np.zeros(len(starts), np.int64)
        where[known] = self._start[places[known]]
        if not len(odd):
            return _gathered(self._flat, where, lens), totals
        where[odd] = self._used + (np.cumsum(own_lens) - own_lens)[which]
        return _gathered(np.concatenate([self._flat[: self._used], own]), where, lens), totals

    def batches(self, column: pa.Array, end: int | None = None, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray | None, np.ndarray]]:
        """Byte-balanced row ranges of a text column: first and last row, all ids in one array, each text's number of ids.

        ``end`` is appended to each text. A text of more than two batches is worked off in windows.
        """
        data, begins = _text_bytes(column)
        for a, b in byte_balanced(np.diff(begins).tolist(), limit):
            low, high = int(begins[a]), int(begins[b])
            if high - low <= 2 * limit:
                ids, lens = self._window(data[low:high], begins[a : b + 1] - low)
            else:  # one long text
                parts = [self._window(data[x:y], np.array([0, y - x])) for x, y in self._windows(data, low, high, limit)]
                ids, lens = np.concatenate([x for x, _ in parts]) if self.with_ids else None, sum(n for _, n in parts)
            if end is not None:
                ids, lens = np.insert(ids, np.cumsum(lens), np.uint32(end)) if self.with_ids else None, lens + 1
            yield a, b, ids, lens

    def _windows(self, data: np.ndarray, low: int, high: int, limit: int) -> Iterator[tuple[int, int]]:
        """Ranges of a long text, cut at single spaces between ASCII letters; without one a range goes on."""
        at, look = low, limit
        while at < high:
            if high - at > look:
                part = data[at : at + look]
                safe = np.flatnonzero((part[1:-1] == 0x20) & _LETTER[part[:-2]] & _LETTER[part[2:]])
                if not len(safe):
                    look *= 2
                    continue
                stop = at + int(safe[-1]) + 1
            else:
                stop = high
            yield at, stop
            at, look = stop + (self.kind == "piece" and stop < high), limit

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        own = [n for *_, n in self.batches(pa.array(texts, pa.string()))]
        return np.concatenate(own) if own else np.zeros(0, np.int64)

    def ids(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and each text's number of ids; ``end`` is appended to each text."""
        own = list(self.batches(pa.array(texts, pa.string()), end))
        if not own:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([x for _, _, x, _ in own]), np.concatenate([n for *_, n in own])


def _gathered(flat: np.ndarray, start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``start`` and are ``lens`` long, one after another."""
    total = int(lens.sum())
    return flat[np.repeat(start - np.cumsum(lens) + lens, lens) + np.arange(total)]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, ``counts`` long each."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def byte_balanced(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes each; a longer text stands alone."""
    start = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > limit:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def text_batches(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int, list[str | None]]]:
    """Byte-balanced row ranges of a text column, and the texts of one range at a time."""
    for a, b in byte_balanced(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
        yield a, b, column.slice(a, b - a).to_pylist()
