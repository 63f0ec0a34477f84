"""Operators against brute force, on small tables with every odd case."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from chronoweave.llm import bpe, class_lm, embed_dedup, langid, license_scan, merkle, near_copies, packing, queries, sharding, simhash, suffix_dedup
from chronoweave.llm import vector_text as vt

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("shard", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("piece", T.StringType()),
])


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    texts = [None, "", "   \n\t ", "a", "Été à l’école — 日本語 🎉", "<|endoftext|> x<|endoftext|>", "Released under the MIT License. CC BY-NC 4.0; Apache License, Version 2.0"]
    for i in range(40):
        texts.append("\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) + "." for _ in range(rng.randint(1, 8))))
    texts += [texts[10], texts[10] + " tail", texts[11] + " " + passage, passage + "\n" + texts[12], "x " * 3000, "word" * 2000, texts[20] + " " + " ".join(rng.choice(words) for _ in range(4000))]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None][i % 4], None if t is None else len(t), "clash", "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[9], rows[9]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(t):
    return (t or "").encode().translate(FOLD).split()


def test_license_scan(docs, empty):
    import re

    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, t, *_ in corpus():
        w = rule.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        found = [(k, label) for label, p in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(found))
        assert r["first_word"] == min((k for k, _ in found), default=None) and r["last_word"] == max((k for k, _ in found), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert {x for _, x in found} <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert license_scan.scan(empty).count() == 0


def test_automaton_statistics():
    rng = random.Random(1)
    seqs = [[rng.randrange(3) for _ in range(12)] for _ in range(4)]
    sc = license_scan.Scanner()
    sc.sam = license_scan.Automaton(seqs)
    text = [rng.randrange(4) for _ in range(200)]
    subs = {tuple(s[a:b]) for s in seqs for a in range(len(s)) for b in range(a + 1, len(s) + 1)}
    for i, (_, k) in enumerate(sc.matching_statistics(text)):
        assert k == max((n for n in range(1, 13) if i + 1 - n >= 0 and tuple(text[i + 1 - n : i + 1]) in subs), default=0)


def test_sharding(docs, empty):
    rows = sharding.shard(docs, rows_per_bucket=7).collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == len(corpus()) and max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    texts = {r[0]: r[1] or "" for r in corpus()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    for source in ("s0", "s1", None):
        per = collections.Counter(r["shard"] for r in rows if r["source"] == source)
        assert max(per.values()) - min(per.get(s, 0) for s in range(8)) <= 2
    assert sharding.shard(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    rows = packing.pack(docs, queries.vocabulary()).collect()
    texts, copies = {r[0]: r[1] or "" for r in corpus()}, collections.Counter(r[0] for r in corpus())
    want = collections.Counter()
    for i, t in texts.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        for k, (at, n) in enumerate(packing.cut(len(ids), 1024)):
            want[i, k, at, n, zlib.crc32(np.asarray(ids[at : at + n], "<u4").tobytes())] += copies[i]
    assert want == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(by) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.pack(empty, queries.vocabulary()).count() == 0


def test_fullest_is_exact():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        room, sums = rng.randint(0, 60), {0}
        for k, v in counts.items():
            sums = {s + k * c for s in sums for c in range(v + 1)}
        got = packing.fullest(room, counts)
        assert sum(got) == max(s for s in sums if s <= room) and all(c <= counts[k] for k, c in collections.Counter(got).items())


def test_bpe_equals_tokenizers(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    codec = bpe.codec(queries.vocabulary())
    rng = random.Random(3)
    alphabet = "aàé ñ'stremvl ld12½²\n\t\r\x0b\x1c\x85\xa0   _-.,!?日本🎉́|<>endoftext\x00﻿ẞ"
    texts = [t or "" for _, t, *_ in corpus()] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t, got, want in zip(texts, codec.encode(texts), tok.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids and codec.decode(got).decode() == t
    back = bpe.decode(bpe.encode(docs, queries.vocabulary()), queries.vocabulary()).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {r[0]: r[1] or "" for r in corpus()}
    assert bpe.round_trip(empty, queries.vocabulary()).count() == 0


def test_simhash(docs, empty):
    rows = simhash.cluster(docs).collect()
    ids, fps = [], []
    for i, t, *_ in corpus():
        w = words_of(t)
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        ids.append(i)
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    label = dict(zip(ids, ids))
    for _ in ids:
        for i, x in zip(ids, fps):
            for j, y in zip(ids, fps):
                if (x ^ y).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(i, f"{x:016x}", label[i]) for i, x in zip(ids, fps)}
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert sorted(kept) == sorted(set(label.values())) and simhash.keep_one(docs).columns == docs.columns
    assert simhash.cluster(empty).count() == 0


def brute_near(rows, similarity=0.8, shingle=5):
    """doc_id -> smallest id that links of Jaccard similarity reach."""
    held = []
    for i, t, *_ in rows:
        w = words_of(t)
        held.append((i, {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))}))
    label = {i: i for i, _ in held}
    links = [(i, j) for i, a in held for j, b in held if len(a & b) >= similarity * len(a | b) - 1e-9]
    for _ in held:
        before = dict(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    return label


def test_near_copies_at_the_similarity(spark, docs, empty):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(900)]
    line, rows = " ".join(words[:12]), list(corpus())
    for i in range(40):
        w = [rng.choice(words) for _ in range(rng.choice([6, 20, 90, 300]))]
        rows.append((1000 + 10 * i, " ".join(w) + " " + line, *rows[0][2:]))
        for k in range(1, 6):
            v = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 30))):
                v[rng.randrange(len(v))] = rng.choice(words)
            rows.append((1000 + 10 * i + k, " ".join(v) + " " + line, *rows[0][2:]))
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_near(rows)
    assert {(r["doc_id"], r["component_id"]) for r in near_copies.components(d).collect()} == set(want.items())
    kept = near_copies.keep_one(d)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns
    # SimHash at 3 bits leaves near copies in.
    assert len(set(want.values())) < simhash.keep_one(d, shingle=5).count()
    assert near_copies.components(empty).count() == 0 and near_copies.keep_one(empty).count() == 0


def test_near_copies_of_one_text_are_joined_before_the_rest(spark, monkeypatch):
    """Copies that were edited each in its own way: pairs of the group are not left to the join that completes it."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(240):
        words = list(base)
        for at in rng.sample(range(150), i % 8):
            words[at] = f"x{i}x{at}"
        rows.append((i, " ".join(words)))
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in (text.split() for _, text in rows)]
    want = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) - 1e-9 and want[i] != want[j]:
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    counts, verified = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *more: counts.append(pairs.count()) or verified(pairs, *more))
    got = near_copies.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == set(enumerate(want))
    assert 10 < len(set(want)) < 200 and len(counts) == 2 and counts[1] <= 20


def test_sketches_never_outnumber_the_difference():
    rng = np.random.default_rng(3)
    groups = []
    for n in (0, 1, 2, 31, 32, 33, 700, 5000):
        base = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        for change in (0, 1, n // 20, n // 3, n):
            groups.append(np.unique(np.concatenate([base[change:], rng.integers(1, 1 << 63, change, dtype=np.uint64)])))
    bounds = np.concatenate([[0], np.cumsum([len(g) for g in groups])])
    data, at = near_copies.sketches(np.concatenate(groups), bounds)
    assert all(at[i + 1] - at[i] <= max(8, len(g) / 2) for i, g in enumerate(groups))
    rows = [data[at[i] : at[i + 1]] for i in range(len(groups))]
    for i, g in enumerate(groups):
        for j, h in enumerate(groups):
            assert near_copies.apart(rows[i], rows[j]) <= len(np.setxor1d(g, h))
            assert near_copies.apart(rows[i], rows[j]) == near_copies.apart(rows[j], rows[i])
    # Sets without a common element are told apart well beyond what a similarity of 0.8 allows.
    one, other = (rng.integers(1, 1 << 63, 700, dtype=np.uint64) for _ in range(2))
    x, where = near_copies.sketches(np.concatenate([one, other]), np.array([0, 700, 1400]))
    assert near_copies.apart(x[: where[1]], x[where[1] :]) > 1400 / 9


def test_simhash_crowded_buckets_lose_nothing(spark):
    from chronoweave.llm.common import Scratch

    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)}
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))]
    want = {(max(i, j), min(i, j)) for f, i in rows for g, j in rows if i < j and ((f ^ g) & (1 << 64) - 1).bit_count() <= 3}
    classes = spark.createDataFrame(rows, "fp long, rep long")
    for crowd in (5, 512):
        assert {(r["a"], r["b"]) for r in simhash.class_links(classes, Scratch(spark, "t"), crowd=crowd).collect()} == want


def test_language_id(spark, empty):
    rng = random.Random(4)
    en, fr = ["the", "thing", "with", "other", "house"], ["être", "élève", "garçon", "où", "château"]
    rows = [(i, " ".join(rng.choice(en if i % 2 else fr) for _ in range(20)), "en" if i % 2 else "fr") for i in range(120)] + [(500, None, "en"), (501, "12 !", "fr"), (502, "", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(d, docs_per_lang=40, epochs=30).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (500, 501, 502))
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i]["score"] <= 1 for i, *_ in rows)
    held = [(r[2], got[r[0]]["lang_pred"]) for r in rows[:120] if got[r[0]]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert langid.keep_identified(d, docs_per_lang=40, epochs=30).count() == 120
    assert langid.identify(empty).count() == 0 and langid.keep_identified(empty).count() == 0


def test_texts_stay_where_no_language_is_known(spark):
    d = spark.createDataFrame([(1, "some words", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in langid.keep_identified(d).collect()] == [1]


def test_gradients_agree_with_differences():
    net = langid.Network(["a", "b"], 3, 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    units, label = np.asarray([[1, 2, 3], [3, 2, 2]], np.uint8), np.asarray([0, 1])

    def cost():
        p = net.positions(units)
        return -np.log(p[np.arange(2)[:, None], np.arange(3)[None], label[:, None]]).mean()

    g = net.gradients(units, label)
    for k in net.w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep, e = net.w[k][at], 1e-4
        net.w[k][at] = keep + e
        up = cost()
        net.w[k][at] = keep - e
        down = cost()
        net.w[k][at] = keep
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-3


def test_suffix_dedup(docs, empty):
    rows = suffix_dedup.passages(docs).collect()
    texts = {r[0]: (r[1] or "").encode().split() for r in corpus()}
    first, owners = {}, collections.defaultdict(set)
    for i in sorted(texts):
        for s in range(len(texts[i]) - 49):
            h = tuple(texts[i][s : s + 50])
            owners[h].add(i)
            first.setdefault(h, (i, s))
    gone = {(i, j) for i in texts for s in range(len(texts[i]) - 49) if len(owners[h := tuple(texts[i][s : s + 50])]) > 1 and first[h] != (i, s) for j in range(s, s + 50)}
    assert {(r["doc_id"], j) for r in rows if r["removed"] for j in range(r["start_word"], r["start_word"] + r["n_words"])} == gone and gone
    left = {r["doc_id"]: (r["text"] or "").encode().split() for r in suffix_dedup.strip(docs).collect()}
    for i, w in texts.items():
        rest = [x for j, x in enumerate(w) if (i, j) not in gone]
        assert left.get(i, []) == rest
    assert suffix_dedup.passages(empty).count() == 0 and suffix_dedup.strip(empty).count() == 0


def test_first_copy_of_a_periodic_passage_stays_whole(spark):
    period = " ".join(f"w{i}" for i in range(31))
    d = spark.createDataFrame([(1, " ".join([period] * 5)), (2, " ".join([period] * 3))], "doc_id long, text string")
    left = {r["doc_id"]: r["text"].split() for r in suffix_dedup.strip(d).collect()}
    w = " ".join([period] * 5).split()
    # Windows begin at the 31 places of the first period; 31 + 49 words hold them all.
    assert left == {1: w[:80]}


def test_suffix_dedup_where_ids_repeat(spark):
    rng = random.Random(8)
    passage = " ".join(f"p{rng.randrange(999)}" for _ in range(60))
    rows = [(1, passage), (1, "short"), (1, "before it " + passage), (2, passage + " and after"), (None, passage), (3, None)]
    d = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n_chars long, gram string")
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in suffix_dedup.strip(d).collect())
    assert (0, passage) in left and (1, "short") in left and (2, "and after") in left and (3, "") in left
    # Of the two texts of id 1 one keeps the passage.
    assert sum(passage in t for i, t in left if i == 1) == 1
    assert {r["doc_id"] for r in suffix_dedup.passages(d).collect()} == {1, 2}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 16))
    rows = []
    for i in range(200):
        v = base[i % 30] + rng.normal(size=16) * rng.choice([0, 0.02, 0.08, 0.3])
        rows.append((i, [float(x) for x in v], int(i % 2)))
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [float("nan")] * 16, 1), (303, rows[0][1], None), (304, rows[0][1], 0), (305, [], 0), (306, [1.0, None], 0), rows[5]]
    rows += [(None, rows[7][1], 1), (None, rows[7][1], 1), (None, [9.0, -1.0] * 8, 0), (7, rows[8][1], 0), (7, rows[9][1], 1), (400, [float(x) for x in base[0]][:8], 0)]
    # Extra columns clash with names that the operator uses.
    d = spark.createDataFrame([(*r, "a", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, cid string, keys int, m int")
    unit = [np.asarray(v) / np.linalg.norm(v) if y is not None and v and None not in v and np.isfinite(v).all() and any(v) else None for _, v, y in rows]
    n = range(len(rows))
    links = [(a, b) for a in n for b in n if a != b and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    group = list(n)
    for _ in range(40):
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    count, least = collections.Counter(a for a, _ in links), {}
    for a in n:
        if rows[a][0] is not None:
            least[group[a]] = min(least.get(group[a], rows[a][0]), rows[a][0])
    want = collections.Counter((rows[a][0], count[a], least.get(group[a])) for a in n)
    for block, crowd in ((1024, 4096), (3, 4096), (4, 5)):
        got = embed_dedup.near(d, block=block, crowd=crowd).collect()
        assert collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert embed_dedup.near(d.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):  # pairs at a cosine of 0.98 to 0.982 in 64 dimensions
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9801, 0.982)
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for crowd, least in ((4096, 0.98), (1, 0.95)):  # in the second all buckets are hashed anew
        got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near(d, crowd=crowd).collect()}
        assert sum(got[2 * i] == got[2 * i + 1] == 1 for i in range(400)) >= least * 400


def test_embedding_links_do_not_depend_on_the_size_of_buckets(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1000):  # pairs at a cosine of just over 0.98, of which further hashes would miss some
        a, b = (v / np.linalg.norm(v) for v in rng.normal(size=(2, 64)))
        b = (b - (b @ a) * a) / np.linalg.norm(b - (b @ a) * a)
        rows += [(2 * i, a.tolist(), 0), (2 * i + 1, (0.9801 * a + math.sqrt(1 - 0.9801**2) * b).tolist(), 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near(d, **how).collect()) for how in ({}, {"crowd": 1})]
    assert got[0] == got[1] and sum(n for _, n, _ in got[0]) >= 1960


def test_components_of_a_star_and_a_path(spark):
    from chronoweave.llm.common import Scratch
    from chronoweave.llm.components import connected_components

    links = [(0, k) for k in range(1, 700)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5), (2000, 1999)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect())
    assert got == {k: 0 for k in range(700)} | {k: 1000 for k in range(1000, 1041)} | {1999: 1999, 2000: 1999}


def naive_exchange(pairs, movable, classes):
    """The exchange with the whole likelihood worked out for every move."""
    n = len(pairs)
    cls = np.concatenate([np.arange(movable) % classes, classes + np.arange(n - movable)])
    moved = True
    while moved:
        moved = False
        for w in range(movable):
            value = []
            for b in range(classes):
                cls2 = cls.copy()
                cls2[w] = b
                value.append(class_lm.likelihood(pairs, np.append(cls2, classes + n - movable - 1)[: n]))
            b = int(np.argmax(value))
            if value[b] > value[cls[w]] + 1e-7:
                cls[w], moved = b, True
    return cls


def test_exchange_is_that_of_the_whole_likelihood():
    rng = np.random.default_rng(3)
    pairs = rng.poisson(rng.gamma(0.4, 4, (30, 30))).astype(float)
    assert class_lm.exchange(pairs, 22, 4).tolist() == naive_exchange(pairs, 22, 4).tolist()


def brute_lm(tokens, train, top, classes):
    """Scores by the rules of the module, with dictionaries of whole words."""
    c = collections.Counter(w for i in train for w in tokens[i])
    end = b"\n"

    def key(w):
        return vt.word_hash(w) - (1 << 64 if vt.word_hash(w) >> 63 else 0)

    def shape(w):
        if w == end:
            return 16
        last = w[-1]
        kind = 0 if 97 <= last <= 122 else 1 if last >= 128 else 2 if 48 <= last <= 57 else 3
        return sum(len(w) > x for x in (3, 6, 10)) * 4 + kind

    often = sorted((w for w in c if w != end), key=lambda w: (-c[w], key(w)))[:top]
    rank = {w: k for k, w in enumerate(often)}
    n = len(often) + 17
    pairs = np.zeros((n, n))
    for i in train:
        states = [n - 1, *[rank.get(w, len(often) + shape(w)) for w in tokens[i]]]
        for a, b in zip(states, states[1:]):
            pairs[a, b] += 1
    start = class_lm.exchange(pairs, len(often), classes)
    cls = {w: int(start[rank.get(w, len(often) + shape(w))]) for w in c}
    k = int(start.max()) + 1

    def counted():
        N, before, after = np.zeros((k, k)), collections.defaultdict(lambda: np.zeros(k)), collections.defaultdict(lambda: np.zeros(k))
        for i in train:
            line = [end, *tokens[i]]
            for a, b in zip(line, line[1:]):
                N[cls[a], cls[b]] += 1
                before[b][cls[a]] += 1
            for a, b in zip(tokens[i], [*tokens[i][1:], end]):
                after[a][cls[b]] += 1
        return N, before, after

    N, before, after = counted()
    rows, cols, new = N.sum(axis=1), N.sum(axis=0), {}
    for w in c:
        if w == end or w in rank:
            continue
        gain = []
        for b in range(k - 1):
            own = b == cls[w]
            x = sum(before[w][j] * math.log(max(N[j, b] - own * before[w][j], 0) + 0.5) + after[w][j] * math.log(max(N[b, j] - own * after[w][j], 0) + 0.5) for j in range(k))
            gain.append(x - c[w] * (math.log(max(rows[b] - own * c[w], 0) + 0.5 * k) + math.log(max(cols[b] - own * c[w], 0) + 0.5 * k)))
        b = int(np.argmax(gain))
        new[w] = b if gain[b] > gain[cls[w]] + 1e-9 else cls[w]
    cls |= new
    N, _, _ = counted()
    tail = collections.defaultdict(lambda: [0, 0, 0, 0])
    for w in c:
        if w != end:
            for j, x in enumerate((c[w], 1, c[w] == 1, c[w] == 2)):
                tail[cls[w], shape(w)][j] += x
    model = class_lm.Model(N, {x: tuple(y) for x, y in tail.items()})
    out = {}
    for i, line in tokens.items():
        total, prev = 0.0, k - 1
        for w in line:
            here = cls[w] if w in c else k - 1 if w == end else int(model.new[shape(w)])
            total += model.move[prev, here]
            if w != end:
                total += math.log10((c[w] - model.discount[here]) / model.total[here]) if w in c else model.unseen[shape(w)]
            prev = here
        out[i] = total
    return c, out


def test_class_lm(docs, empty):
    got = class_lm.score(docs, top=30, classes=5, chunk_chars=4000).collect()
    rows = corpus()
    tokens = {r[0]: [*words_of(r[1]), b"\n"] for r in rows}
    train = [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    c, want = brute_lm(tokens, train, 30, 5)
    n, v = c.total(), len(c)
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-9)
    assert class_lm.score(empty).count() == 0
    assert class_lm.score(docs, top=30, classes=5, passes=2).count() == len(rows)


def test_class_lm_with_nothing_to_train_on(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    d = spark.createDataFrame([(i, "a b", "x") for i in held], "doc_id long, text string, chunk string")
    got = class_lm.score(d).collect()
    assert len(got) == len(held) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_class_model_sums_to_one():
    rng = np.random.default_rng(0)
    N = rng.integers(0, 9, (6, 6)).astype(float)
    words = [(int(rng.integers(1, 5)), int(rng.integers(5)), int(rng.integers(16))) for _ in range(400)]
    tail = collections.defaultdict(lambda: [0, 0, 0, 0])
    for c, k, s in words:
        for j, x in enumerate((c, 1, c == 1, c == 2)):
            tail[k, s][j] += x
    m = class_lm.Model(N, {x: tuple(y) for x, y in tail.items()})
    assert np.allclose((10**m.move).sum(axis=1), 1)
    for k in range(5):
        known = sum((c - m.discount[k]) / m.total[k] for c, b, _ in words if b == k)
        assert known + sum(10 ** m.unseen[s] for s in range(16) if m.new[s] == k) == pytest.approx(1)


def brute_leaves(t):
    """Leaves of a text by its lines and words, one after another."""
    import re

    out = []
    for line in re.findall(r"[^\n]*\n|[^\n]+", t):
        begin, k, stopped = 0, 0, True
        for m in re.finditer(r"[^ \t\n\r\x0b\x0c]+", line):
            k = 0 if stopped else k + 1
            if k % 4 == 0 and m.start() and out is not None and begin_seen(line, m.start()):
                out.append(line[begin : m.start()])
                begin = m.start()
            stopped = m.group()[-1] in "!.?"
        out.append(line[begin:])
    return out


def begin_seen(line, at):
    """Whether a word stands before ``at``."""
    return bool(line[:at].strip(" \t\n\r\x0b\x0c"))


def brute_likeness(a, b):
    if a == b:
        return 1.0
    x, y = collections.Counter(brute_leaves(a)), collections.Counter(brute_leaves(b))
    return 2 * (x & y).total() / (x.total() + y.total()) if x and y else 0.0


def test_merkle_with_ids_of_text(spark):
    rows = [("b", "one\n\ntwo"), ("a", "x y z w v"), (None, "end"), ("é", "last. one two")]
    got = merkle.against_edit(spark.createDataFrame([(*r, 1) for r in rows], "doc_id string, text string, bucket int")).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or ""))] == ["a", "b", "é", None]
    after = {"a": "one\n\ntwo", "b": "last. one two", "é": "end", None: "x y z w v"}
    texts = dict(rows)
    for r in got:
        t = texts[r["doc_id"]]
        new = t[: len(t) - len(t) // 4] + after[r["doc_id"]][: len(t) // 4]
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()


def test_merkle(docs, empty):
    got = sorted(merkle.against_edit(docs).collect(), key=lambda r: r["doc_id"])
    rows = sorted(corpus(), key=lambda r: (r[0], r[1] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    for k, r in enumerate(got):
        t, after = rows[k][1] or "", rows[(k + 1) % len(rows)][1] or ""
        new = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == merkle.tree(t).root and (r["fingerprint"] == r["edited_fingerprint"]) == (t == new)
        assert (r["near_edited"], r["near_next"]) == pytest.approx((brute_likeness(t, new), brute_likeness(t, after)))
    assert merkle.first_difference(merkle.tree("a\n\nb\nc\n"), merkle.tree("a\n\nb\nd\n")) == (1, 1)
    assert merkle.against_edit(empty).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = read
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == read.columns, name
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} <= {r[0] for r in corpus()} and rows


def test_short_sketches_never_differ_in_more_bits_than_the_sets():
    rng = np.random.default_rng(5)
    one = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    groups = [one, np.unique(np.concatenate([one[:250], rng.integers(0, 1 << 63, 40).astype(np.uint64)])), one[:1], one[:0], one]
    rows = near_copies.short_sketches(np.concatenate(groups), np.cumsum([0] + [len(g) for g in groups])).view(np.uint64)  # numpy counts the bits of a signed number's absolute value, Spark those of the number
    assert rows.shape == (5, near_copies.PARTS) and (rows[0] == rows[4]).all() and not rows[3].any()
    for g, x in zip(groups, rows):
        for h, y in zip(groups, rows):
            assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(g, h))
    assert np.bitwise_count(rows[0] ^ rows[1]).sum() > 45  # and seldom in many fewer
    assert near_copies.short_sketches(np.empty(0, np.uint64), np.array([0])).shape == (0, near_copies.PARTS)
