"""Language identification: words first, then shorter and shorter n-grams.

Known words score by their log frequency in each language. An unseen word is
read by character n-grams: at every place of the word the longest known n-gram,
from ``LONGEST`` characters down to one, gives its log frequencies.

Words are a letter and the letters and combining marks behind it. Words and
n-grams are known by 64-bit hashes of their characters, in sorted arrays; of each only the
languages that have it are held, as all others have the same log frequency. So
a model grows with the text it was learned from, which is bounded, and not with the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces, runtime

#: Documents to learn from, and bytes of their texts: a hash picks about so many, by language.
MAX_DOCS, MAX_BYTES = 20_000, 32 << 20
LONGEST = 5
#: An unseen word counts this much of a known one.
BACKOFF = 0.5
#: Smallest count of a word or n-gram in a language that doesn't have it.
LEAST = 0.5
#: Numbers (words times languages) that one batch of texts may have at most, unless a single text has more.
BATCH_NUMBERS, BATCH_BYTES = 1 << 22, 1 << 19
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNDETERMINED = "und"
_MIX = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.random.Generator(np.random.Philox(60)).integers(1, 1 << 63, LONGEST + 1, dtype=np.uint64)  # 0 words, else n-grams of so many
_EDGE = "\0"  # in front of and behind a word, as n-grams see it


def words_of(text: str | None) -> list[str]:
    """The words of a whole text, in lower case."""
    return _WORD.findall(text.lower()) if text else []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


class _Hashed:
    """Hashes of words and of the n-grams at their places."""

    def __init__(self, words: list[str]) -> None:
        text = "".join(f"{_EDGE}{w}{_EDGE}" for w in words)
        self.chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.word = np.repeat(np.arange(len(words)), sizes)  # of each place
        self.codes = _mixed(self.chars + np.uint64(1))

    def words(self) -> np.ndarray:
        """A hash of each word."""
        place = np.arange(len(self.codes)) - self.starts[self.word]
        power = np.cumprod(np.full(int(place.max(initial=0)) + 1, _STEP, np.uint64), dtype=np.uint64)
        parts = self.codes * power[place]
        return _mixed(np.add.reduceat(parts, self.starts) + _KIND[0]) if len(self.starts) else np.zeros(0, np.uint64)

    def grams(self, n: int) -> np.ndarray:
        """A hash of the n characters from each place on, 0 where the word ends before."""
        size = len(self.codes) - n + 1
        out = np.zeros(len(self.codes), np.uint64)
        if size > 0:
            rolled = np.zeros(size, np.uint64)
            for k in range(n):
                rolled = rolled * _STEP + self.codes[k : k + size]
            out[:size] = _mixed(rolled + _KIND[n])
        out[np.arange(len(out)) + n > self.ends[self.word]] = 0
        return out


@dataclass
class LanguageModel:
    """Log frequencies: ``floors[kind]`` in general, ``deltas`` above them for the languages that have the word or n-gram."""

    languages: list[str]
    keys: np.ndarray  # sorted hashes
    begins: np.ndarray  # of each key's run in the next two
    langs: np.ndarray
    deltas: np.ndarray
    floors: np.ndarray  # a row per kind, a column per language

    @classmethod
    def learn(cls, langs: list[str], words: list[str], counts: list[int]) -> LanguageModel:
        """From a row per language and word with its count; n-grams are counted over the same words."""
        languages = sorted(set(langs))
        lang = np.array([languages.index(x) for x in langs] if len(languages) < 8 else list(map({x: k for k, x in enumerate(languages)}.__getitem__, langs)), np.int64)
        n, hashed = np.array(counts, np.float64), _Hashed(words)
        floors, parts = np.zeros((LONGEST + 1, len(languages))), []
        for kind in range(LONGEST + 1):
            keys = hashed.grams(kind) if kind else hashed.words()
            own, by = (lang[hashed.word], n[hashed.word]) if kind else (lang, n)
            there = keys != 0
            order = np.lexsort((own[there], keys[there]))
            keys, own, by = keys[there][order], own[there][order], by[there][order]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])])) if len(keys) else np.zeros(0, np.int64)
            keys, own, by = keys[new], own[new], np.add.reduceat(by, new) if len(new) else by
            totals = np.bincount(own, by, len(languages)) + LEAST * (len(np.unique(keys)) + 1)
            floors[kind] = np.log(LEAST / totals)
            parts.append((keys, own, np.log((by + LEAST) / LEAST)))
        keys, own, deltas = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, begins = np.unique(keys[order], return_index=True)
        return cls(languages, keys, np.append(begins, len(order)).astype(np.int64), own[order].astype(np.int32), deltas[order].astype(np.float32), floors)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's key, -1 where it isn't known."""
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where((self.keys[at] == hashes) & (hashes != 0), at, -1)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row of log frequencies for each word, a column per language."""
        hashed = _Hashed(words)
        found = self._find(hashed.words())
        row, key, kind, weight = np.flatnonzero(found >= 0), found[found >= 0], np.zeros(int((found >= 0).sum()), np.int64), np.ones(int((found >= 0).sum()))
        if (found < 0).any():
            unseen = _Hashed([words[k] for k in np.flatnonzero(found < 0)])
            longest, kinds = np.full(len(unseen.codes), -1, np.int64), np.zeros(len(unseen.codes), np.int64)
            for n in range(LONGEST, 0, -1):
                open_ = np.flatnonzero(longest < 0)
                got = self._find(unseen.grams(n)[open_])
                longest[open_], kinds[open_[got >= 0]] = got, n
            has = longest >= 0
            own, places = unseen.word[has], np.bincount(unseen.word[has], minlength=len(unseen.starts))
            row = np.concatenate([row, np.flatnonzero(found < 0)[own]])
            key, kind, weight = np.concatenate([key, longest[has]]), np.concatenate([kind, kinds[has]]), np.concatenate([weight, BACKOFF / places[own]])
        width = len(self.languages)
        general = np.bincount(row * (LONGEST + 1) + kind, weight, len(words) * (LONGEST + 1)).reshape(len(words), LONGEST + 1)
        lens = self.begins[key + 1] - self.begins[key]
        run = np.repeat(self.begins[key] - np.cumsum(lens) + lens, lens) + np.arange(int(lens.sum()))
        special = np.bincount(np.repeat(row, lens) * width + self.langs[run], np.repeat(weight, lens) * self.deltas[run], len(words) * width)
        return general @ self.floors + special.reshape(len(words), width)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and posterior of each text; ``und`` and 0 for null texts and texts without letters."""
        langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return langs, scores
        names: dict[str, int] = {}
        held: list[tuple[int, np.ndarray]] = []

        def close() -> None:
            if not held:
                return
            rows = self.word_scores(list(names))
            places = np.concatenate([p for _, p in held])
            begins = np.cumsum([0, *(len(p) for _, p in held[:-1])])
            total = np.add.reduceat(rows[places], begins) if rows.shape[1] * len(places) <= 4 * BATCH_NUMBERS else np.stack([np.bincount(p, minlength=len(rows)) @ rows for _, p in held])
            best = total.argmax(1)
            score = 1 / np.exp(np.clip(total - total[np.arange(len(best)), best][:, None], -700, 0)).sum(1)
            for (k, _), b, s in zip(held, best.tolist(), score.tolist(), strict=True):
                langs[k], scores[k] = self.languages[b], s
            names.clear()
            held.clear()

        for k, text in enumerate(texts):
            own = words_of(text)
            if own:
                held.append((k, np.fromiter((names.setdefault(w, len(names)) for w in own), np.int64, len(own))))
                if len(names) * len(self.languages) > BATCH_NUMBERS:
                    close()
        close()
        return langs, scores


def _word_counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, counts = np.unique(np.array(words_of(text.as_py()), object), return_counts=True) if text.is_valid else ([], [])
                if len(words):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words), pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])

    return rows.mapInArrow(pieces.tidy(run), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fair_share(sizes: list[tuple[int, int]], most: int) -> int | None:
    """Documents that a language may keep so that all together keep about ``most``; None if all may stay.

    ``sizes``: number of documents, and of languages that have so many.
    """
    left, languages = most, sum(n for _, n in sizes)
    for size, n in sorted(sizes):
        if size * languages > left:
            return max(1, left // languages)
        left, languages = left - size * n, languages - n
    return None


def identify_language(
    docs: DataFrame, fold: int = 2, folds: int = 4, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``lang_pred`` and ``score``.

    Learns from text and non-null language of documents whose
    ``crc32(id as text) mod folds`` is not ``fold``: of all up to ``max_docs`` and
    ``max_bytes``, beyond either of about so many: a language keeps all its documents up to an
    equal share, and about that share, drawn by a hash of the id, beyond it. All
    words and n-grams of these documents are learned.
    Every whole text is predicted; the score is the posterior of the predicted
    language, and of equal ones (a tie) the first by name is predicted.

    A null text, or one without a letter (Unicode's, so not ``½`` or ``²``), is ``und`` with score 0, as is all if
    there was nothing to learn. Null ids are never learned from and count
    as not held out; rows that repeat an id are predicted alike. An
    empty table gives no rows; further columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    runtime.prepare(spark)
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % folds == fold, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = rows.filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(~held)
    sizes = known.groupBy("lang").agg(F.count("*").alias("size"), F.ceil(F.sum(F.octet_length("text")) / 1024).alias("kilobytes"))
    sizes = runtime.write_table(sizes, "languages")
    rates = []
    for column, most in (("size", max_docs), ("kilobytes", max_bytes // 1024)):
        share = fair_share([(r[column], r["n"]) for r in sizes.groupBy(column).agg(F.count("*").alias("n")).collect()], most)
        if share is not None:
            rates.append(share / F.col(column))
    if rates:
        large = sizes.withColumn("rate", F.least(*rates, F.lit(1.0))).filter("rate < 1").select("lang", "rate")  # as many languages as have more than a share
        rate = F.coalesce("rate", F.lit(1.0))
        known = known.join(F.broadcast(large), "lang", "left").filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < (1 << 30) * rate)
    found = _word_counts(known.select("lang", "text")).toArrow()
    model = LanguageModel.learn(*(found.column(c).to_pylist() for c in ("lang", "word", "n")))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in pieces.text_batches(batch.column(1), BATCH_BYTES):
                langs, scores = shared.value.predict(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    predicted = rows.select("id", "text").mapInArrow(pieces.tidy(run), f"id {kind}, lang_pred string, score double")
    return predicted.select(F.col("id").alias(id_col), held.alias("held_out"), "lang_pred", "score")
