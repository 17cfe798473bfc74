"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from gridtide.llm import blocks, context_coder, mixing, near_dedup, packing, pieces, quality, token_output, vector_dedup, warc
from gridtide.llm.components import connected_components
from gridtide.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from gridtide.llm.langid import identify_language
from gridtide.llm.shingles import shingle_sets
from gridtide.llm.token_counts import count_tokens
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, to clash with.
CLASHES = ("id", "rep", "key", "size", "bin", "digest", "group", "share", "mark", "component", "label", "x", "score")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = [words(rng, rng.randint(5, 60)) for _ in range(30)]
    rows = [(k, t, "en" if k % 2 else "de", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    rows += [(100 + k, base[0].replace(" ", "  " if k else "\n"), "en", "s0", 1) for k in range(4)]
    rows += [(200 + k, " ".join(base[1].split()[:-1] + [f"w{k}"]) + " tail" * (k % 2), "en", None, 1) for k in range(4)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t", "en", "s1", 3), (303, "one", "en", "s1", 3), (304, "ONE two", "en", "s2", 7), (305, "one TWO", "en", "s2", 7)]
    rows += [(400, words(rng, 6000), "en", "s2", 1), (500, "same row", "en", "s0", 8), (500, "same row", "en", "s0", 8), (None, "no id here at all", "en", "s0", 8), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(corpus(), DOCS).repartition(3)
    return out.withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, key="doc_id"):
    out = defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# --- exact duplicates


def test_exact_dedup(docs, empty):
    found, groups = exact_dedup(docs).collect(), defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for i, t, *_ in corpus():
        groups[norm(t)].append((-len(t or ""), i is None, i))
    assert len(found) == len(corpus())
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): sorted(v, key=lambda x: (x[0], x[1], x[2] or 0)) for k, v in groups.items()}
    for r in found:
        own = by_hash[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (own[0][2], len(own), r["doc_id"] == own[0][2])
    assert exact_dedup(empty).count() == 0
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[500] == 1 and ids[0] == 0 and ids[101] == 1 and ids[None] == 2 and ids[300] + ids[301] == 0 and ids[302] == 1


# --- near duplicates


def brute_near(rows, k, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if None not in (a, b) and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    return sets, least


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(docs, empty, k, percent):
    sets, least = brute_near(corpus(), k, percent)
    for i, own in rows_of(near_dedup.near_dedup(docs, k, percent)).items():
        for r in own:
            if i is None:
                assert (r["component_id"], r["kept"]) == (None, True)
            else:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), least[i], least[i] == i), i
    assert near_dedup.near_dedup(empty).count() == 0


def test_large_groups_are_searched_in_blocks(spark, monkeypatch):
    """A chain in which only neighbours are linked, and strangers that share a passage: no link is lost in small blocks."""
    monkeypatch.setattr(near_dedup, "SHORT", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows, text = [], list(base)
    for k in range(60):
        text[rng.randrange(120)] = f"n{k}"
        rows.append((k, " ".join(text), None, None, None))
    rows += [(100 + k, " ".join(base[:60]) + " " + words(rng, 40), None, None, None) for k in range(40)]
    sets, least = brute_near(rows, 3, 85)
    found = near_dedup.near_dedup(spark.createDataFrame(rows, DOCS), 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == least


def test_shingles_of_long_and_odd_texts():
    long = " ".join(map(str, range(300_000))).encode()
    sets = shingle_sets([long, b"", b" ", b"a b", b"A\x0bB", b"a b c a b c"], 3)
    assert [len(x) for x in sets] == [299_998, 0, 0, 1, 1, 3] and sets[3][0] == sets[4][0]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, None), (7, 7)]
    least = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(60):
        for a, b in edges:
            if b is not None and a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == least and len(found) == len(least)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- vectors


def test_near_vectors(spark):
    rng, rows = np.random.default_rng(3), []
    centres = rng.standard_normal((6, 16))
    for k in range(120):
        rows.append((k, (centres[k % 6] + 0.12 * rng.standard_normal(16)).tolist(), k % 3))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (201, rows[0][1], 0), (202, [0.0] * 16, 0), (203, None, 0), (204, [float("nan")] * 16, 0), (205, [1.0] * 15 + [None], 0), (206, [], 0)]
    rows += [(207, rows[0][1], None), (208, [x * 1e200 for x in rows[0][1]], 0), (209, [1.0, 2.0], 0), (210, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    own = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, least = Counter(), {i: i for i, *_ in own}
    unit = [v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for _, v, _ in own]
    pairs = [(a, b) for a in range(len(own)) for b in range(a) if own[a][2] == own[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in own:
        for a, b in pairs:
            least[own[a][0]] = least[own[b][0]] = min(least[own[a][0]], least[own[b][0]])
    expected = {own[k][0]: links[k] for k in range(len(own))}
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"vec": F.lit(1), "rep": F.lit(2), "id": F.lit(3)})
    found = vector_dedup.near_vectors(data, block=16).collect()
    assert len(found) == len(rows)
    for r in found:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (expected.get(i, 0), least.get(i, i), least.get(i, i) == i), i
    assert vector_dedup.near_vectors(data.limit(0)).count() == 0
    assert vector_dedup.collision(0.3) > vector_dedup.collision(1.4) and vector_dedup.table_plan(10**9, 0.93)[0] > vector_dedup.table_plan(10**4, 0.93)[0]
    assert blocks.forest(np.array([0, 2]), np.array([1, 3]), 5).tolist() == [0, 0, 2, 2, 4]


# --- tokens


def library_ids(name, texts):
    from tokenizers import Tokenizer

    return [x.ids for x in Tokenizer.from_file(pieces.tokenizer_path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_token_counts(docs, empty):
    import sentencepiece

    path = pieces.tokenizer_path("piece_bpe_32k.model")
    whole, found = sentencepiece.SentencePieceProcessor(model_file=path), rows_of(count_tokens(docs, path, 1000))
    for i, t, *_ in corpus():
        n = len(whole.encode(t or ""))
        assert any((r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 1000) for r in found[i])
    assert sum(map(len, found.values())) == len(corpus()) and count_tokens(empty, path).count() == 0


def test_token_output(docs, empty, monkeypatch):
    path = pieces.tokenizer_path("byte_bpe_50k.json")
    shards = token_output.write_token_shards(docs, path, 2, shard_ids=500)
    assert shards.count() > 3
    found = token_output.token_digests(shards).orderBy("start").collect()
    order = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in found] == [r[0] for r in order] and [r["start"] for r in found] == np.cumsum([0] + [r["n_tokens"] for r in found])[:-1].tolist()
    ids = dict(zip((r[0] for r in order), library_ids("byte_bpe_50k.json", [r[1] for r in order]), strict=True))
    for r in found:
        if r["doc_id"] is not None:
            own = np.array([*ids[r["doc_id"]], 2], "<u4")
            assert (r["n_tokens"], r["ids_crc32"]) == (len(own), zlib.crc32(own))
    read = {r["id"]: r["ids"] for r in token_output.read_token_shards(shards).collect()}
    assert read[303] == [*ids[303], 2] and read[301] == [2]
    assert token_output.tokenize_corpus(empty, path, 2).count() == 0


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_coder_round_trip(block):
    rng = np.random.default_rng(4)
    for ids in ([], [0], [262143] * 50, rng.integers(0, 262144, 1500), rng.zipf(1.2, 1500) % 50257, [1, 2, 3] * 600, rng.integers(0, 3, 1200)):
        data = context_coder.encode(np.array(ids, np.int64), block)
        assert context_coder.decode(data).tolist() == list(ids)
    assert len(context_coder.encode(np.array([1, 2, 3, 50000] * 2000), 4096)) < 1200


def test_coder_finds_damage():
    data = bytearray(context_coder.encode(np.arange(3000) % 700, 500))
    with pytest.raises(ValueError):
        context_coder.encode(np.array([262144]))
    for at in (3, 25, len(data) - 40):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            context_coder.decode(bytes(bad))
    for cut in (10, 30, len(data) - 2):
        with pytest.raises(ValueError):
            context_coder.decode(bytes(data[:cut]))


def check_packing(found, rows, capacity, end):
    ids = library_ids("word_bpe_49k.json", [r[1] for r in rows])
    expected = Counter()
    for (i, *_), own in zip(rows, ids, strict=True):
        own = [*own, end]
        expected.update((i, p, a, len(own[a : a + capacity]), zlib.crc32(np.array(own[a : a + capacity], "<u4"))) for p, a in enumerate(range(0, len(own), capacity)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.parametrize("group_items", [4096, 8])
def test_packing(docs, empty, group_items):
    path = pieces.tokenizer_path("word_bpe_49k.json")
    found = packing.pack(docs, path, 256, 0, group_items=group_items).collect()
    n, least = check_packing(found, corpus(), 256, 0), -(-sum(r["length"] for r in found) // 256)
    assert n <= least + (1 if group_items > 100 else 8)
    assert packing.pack(empty, path).count() == 0


def test_best_fit():
    bins, offsets, n = packing.best_fit([6, 5, 5, 4], 10)
    assert (bins, offsets, n) == ([0, 1, 1, 0], [0, 0, 5, 6], 2)


# --- mixing


def test_mixing(docs, empty):
    found = mixing.mix(docs).collect()
    sizes, source = Counter(), {}
    for i, t, _, s, _ in corpus():
        sizes[s] += len(WORD.findall(t or ""))
        source.setdefault(i, s)
    names = sorted((s for s in sizes if s is not None)) + [None]
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names], [3, 1, 2, 3], 1.5 * sum(sizes.values()), 2), strict=True))
    taken, by_size = Counter(), {sizes[s]: s for s in names}
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        s = by_size[r["source_size"]]
        taken[s] += r["taken"]
        assert r["target"] == pytest.approx(goal[s])
    assert all(abs(taken[s] - goal[s]) <= 1 for s in names) and len(found) == len(corpus())
    key = lambda rows: sorted(map(str, rows))
    assert key(mixing.mix(docs.repartition(7)).collect()) == key(found)
    whole = mixing.mix(docs, residual="round")
    assert all(r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"] for r in whole.collect())
    repeated = mixing.repeat_documents(docs, whole)
    assert repeated.columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.repeat_documents(empty, mixing.mix(empty, residual="round")).count() == 0


def test_targets_and_pivot():
    assert mixing.targets([10, 100, 0], [3, 1, 2], 90, 2) == [20, 70, 0] and mixing.targets([0, 0], [1, 2], 0, 2) == [0, 0]
    draws = np.random.default_rng(1)
    total = np.zeros(5)
    for _ in range(4000):
        shares, sizes = np.array([0.3, 0.5, 0.7, 0.2, 0.9]), np.array([5, 1, 8, 2, 4])
        left = mixing.pivot(shares, sizes, draws.random)
        assert shares @ sizes == pytest.approx(12.0 + 0.0 * left, abs=1e-6) or shares @ sizes == pytest.approx(np.array([0.3, 0.5, 0.7, 0.2, 0.9]) @ sizes)
        assert all(x in (0, 1) for k, x in enumerate(shares) if k != left)
        total += shares
    assert total / 4000 == pytest.approx([0.3, 0.5, 0.7, 0.2, 0.9], abs=0.04)


# --- quality and language


def test_quality(spark, docs, empty):
    rng = random.Random(8)
    rows = [(k, words(rng, 40) + "." if k % 2 else "BUY!! NOW!! " * 20, "en", "s", 1) for k in range(120)] + [(900, None, None, None, None), (901, "", None, None, None), (None, "x", None, None, None)]
    data = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = rows_of(quality.score_quality(data, labels))
    assert all(found[k][0]["predicted"] == k % 2 for k in range(120)) and all(0 <= r["score"] <= 1 for own in found.values() for r in own)
    assert [found[k][0]["held_out"] for k in range(9)] == [zlib.crc32(str(k).encode()) % 3 == 1 for k in range(9)]
    kept = quality.keep_good(data, labels)
    assert kept.columns == data.columns and {r["doc_id"] for r in kept.collect()} >= set(range(1, 120, 2)) and not {r["doc_id"] for r in kept.collect()} & set(range(0, 120, 2))
    assert {r["score"] for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5} and quality.score_quality(empty, labels).count() == 0
    bounded = quality.learn_quality(data, labels, max_labelled=40)
    assert bounded.weights.any()


def test_language(spark, docs, empty):
    rng = random.Random(9)
    alphabets = {"aa": "abcd", "bb": "wxyz", "cc": "éèàù"}
    make = lambda a: " ".join("".join(rng.choices(a, k=5)) for _ in range(12))
    rows = [(k, make(alphabets[lang]), lang, "s", 1) for k, lang in enumerate(list(alphabets) * 30)]
    rows += [(500, None, "aa", None, None), (501, "12 34 !!", "aa", None, None), (502, "", None, None, None), (503, make("wxyz"), None, None, None), (None, make("abcd"), "bb", None, None)]
    found = rows_of(identify_language(spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(0))))
    assert all(found[k][0]["lang_pred"] == lang for k, _, lang, *_ in rows[:90])
    assert [found[k][0]["lang_pred"] for k in (500, 501, 502, 503, None)] == ["und", "und", "und", "bb", "aa"]
    assert found[500][0]["score"] == 0 and all(0 <= r["score"] <= 1 for own in found.values() for r in own)
    assert found[2][0]["held_out"] == (zlib.crc32(b"2") % 4 == 2) and identify_language(empty).count() == 0
    assert {r["lang_pred"] for r in identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- archives


def test_archives_and_audit(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}é</p>" * (k % 5)) for k in range(90)] + [(3, "http://h/3", "twice"), (None, None, None), (91, "a\r\nb", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "archive": F.lit(2)}).repartition(2)
    found = warc.fixity(pages).collect()
    assert len(found) == len(rows) and all(r["intact"] for r in found)
    archives = warc.write_archives(pages)
    data = "".join(r["record"] for r in archives.filter("archive = 0").orderBy("seq").collect()).encode()
    parsed = warc.parse_archive(data)
    assert len(parsed) == archives.filter("archive = 0").count() and parsed[0][0]["WARC-Type"] == "resource"
    assert {b.decode() for _, b in parsed} <= {h or "" for *_, h in rows}
    replica = archives.select("archive", "seq", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    assert warc.audit(replica, replica, fan_out=4) is None
    order = [r["seq"] for r in archives.filter("archive = 1").orderBy("seq").collect()]
    hurt = replica.withColumn("digest", F.when((F.col("archive") == 1) & F.col("seq").isin(order[5], order[20]), F.sha2("digest", 256)).otherwise(F.col("digest")))
    bad = warc.audit(replica, hurt, fan_out=4).collect()
    assert {(r["archive"], r["seq"], r["status"]) for r in bad} == {(1, 5, "corrupt"), (1, 20, "corrupt")}
    short = warc.audit(replica, replica.filter(~((F.col("archive") == 1) & (F.col("seq") == order[-1]))), fan_out=4).collect()
    assert [(r["archive"], r["seq"], r["status"]) for r in short] == [(1, len(order) - 1, "missing")]
    assert warc.fixity(pages.limit(0)).count() == 0
