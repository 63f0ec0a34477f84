"""The whole pipeline against brute force from its second stage on."""

import collections
import random

import corpus_pipeline
from chronoweave.llm import langid
from chronoweave.llm.queries import vocabulary


def corpus():
    rng = random.Random(21)
    letters = {"en": "etaoinshrdlu", "fr": "éàçeaisntrul", "de": "üößenistradh"}
    lexicon = {k: ["".join(rng.choice(v) for _ in range(rng.randint(3, 9))) for _ in range(300)] for k, v in letters.items()}
    say = lambda lang, n: [rng.choice(lexicon[lang]) for _ in range(n)]
    texts = []
    for i in range(90):
        lang = ("en", "fr", "de")[i % 3]
        texts.append((lang, say(lang, rng.choice([30, 60, 150, 400]))))
    passage = say("en", 70)
    for k in range(0, 30, 3):  # a passage that many share
        lang, w = texts[k]
        texts[k] = (lang, w[:20] + passage + w[20:])
    near = []
    for lang, w in texts[30:50]:  # near copies: one word in eighty is another one
        near.append((lang, [rng.choice(lexicon[lang]) if rng.random() < 0.012 else x for x in w]))
    rows = [(lang, " ".join(w)) for lang, w in texts + near + texts[50:55]]
    rows += [("en", None), ("en", ""), ("fr", "12 34 !?"), (None, " ".join(say("de", 80)))]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, (lang, t) in enumerate(rows)]


def shingles(t):
    w = t.translate({c: c + 32 for c in range(65, 91)}).split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def one_of_each(texts):
    """The smallest id of each component of texts with a Jaccard similarity of 0.8 or more."""
    sets, group = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    links = [(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in texts:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return {i: t for i, t in texts.items() if group[i] == i}, len(links)


def without_repeats(texts):
    """What is left of each text when words of later places of shared windows of 50 go, but for words that a first place holds."""
    words = {i: t.split() for i, t in texts.items()}
    owners, first = collections.defaultdict(set), {}
    for i in sorted(words):
        for s in range(len(words[i]) - 49):
            w = tuple(words[i][s : s + 50])
            owners[w].add(i)
            first.setdefault(w, (i, s))
    out, n = {}, 0
    for i, w in words.items():
        gone = [False] * len(w)
        shared = [(s, first[h] == (i, s)) for s in range(len(w) - 49) if len(owners[h := tuple(w[s : s + 50])]) > 1]
        for s, mine in sorted(shared, key=lambda x: x[1]):
            gone[s : s + 50] = [not mine] * 50
        n += sum(gone)
        if not all(gone):
            out[i] = [x for x, g in zip(w, gone) if not g]
    return out, n


def test_whole_run(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    known = {r["doc_id"]: r["text"] for r in langid.keep_identified(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()}
    clean = {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert set(known) <= clean and len(known) >= 0.97 * len(clean)  # what has no letter goes, nearly all else stays
    apart, links = one_of_each(known)
    left, gone = without_repeats(apart)
    assert links > 15 and gone > 400 and len(apart) < len(known)
    tok = Tokenizer.from_file(vocabulary())
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(left)
    for i, ps in pieces.items():
        ps.sort(key=lambda r: r["piece"])
        # White space around a removed stretch goes with it: words decide, so lengths are those of the stripped text.
        assert [r["piece"] for r in ps] == list(range(len(ps))) and [r["start"] for r in ps] == [sum(q["length"] for q in ps[:k]) for k in range(len(ps))]
        text = " ".join(left[i])
        n = len(tok.encode(text, add_special_tokens=False).ids) + 1
        whole = sum(r["length"] for r in ps)
        assert abs(whole - n) <= (1 if text != apart[i] else 0), i
    for rs in sequences.values():
        rs.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rs] == [sum(q["length"] for q in rs[:k]) for k in range(len(rs))] and sum(r["length"] for r in rs) <= 1024


def test_empty_and_odd_runs(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, piece string"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "a")).count() == 0
    text = " ".join(f"mot{i} été" for i in range(40))
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (3, text, "fr", "s", len(text)), (3, text, "fr", "s", len(text)), (4, text, "fr", None, None), (5, "12 !?", "fr", "s", 5)]
    spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "b")).collect()
    assert {r["doc_id"] for r in got} == {3} and sorted(r["piece"] for r in got) == list(range(len(got)))
