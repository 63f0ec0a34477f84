"""Filter audit, reply trees and fill-in-the-middle against brute force."""

import collections
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from chronoweave.llm import chat, fill_middle, filter_audit

DOCS = "doc_id long, text string, lang string, source string, part string, words string, digest string, h1 string, first string"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def corpus():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "A", "<P>", "a<S>b", "été 日本語 🎉x🎉", "<M", "P>", "x" * 5000, "1 " * 3000, "AB cd!" * 700, "w$ " * 300]
    for _ in range(60):
        words = [rng.choice(["alpha", "Beta", "g", "été", "日", "12", "#", "LOUD", "x1y"]) if rng.random() < 0.4 else f"w{rng.randrange(500)}" for _ in range(rng.choice([5, 150, 199, 200, 201, 400]))]
        texts.append(rng.choice([" ", "\n", "\x0b ", "  "]).join(words))
    texts += [texts[20], texts[20], texts[21], texts[2], None, texts[30] + " "]
    rows = [(i, t, ["en", "fr", None, ""][i % 4], "s", "clash", "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    return rows + [rows[20], rows[21], (None, texts[22], "en", "s", *["c"] * 5), (None, "only here", "en", "s", *["c"] * 5), (20, "another text of id 20", "fr", "s", *["c"] * 5)]


LABELS = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, 0, 1), (4, 1, 0), (None, 1, 1), (8, None, None), (9999, 1, 1)]


def failures(rows):
    least = {}
    for i, t, *_ in rows:
        t = t or ""
        if i is not None:
            least[t] = min(i, least.get(t, i))
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = t in least and (i is None or i > least[t])
        bits = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), copy]
        mine = [x for x in LABELS if x[0] is not None and x[0] == i]
        yield lang or "", {f for f, b in zip("ABCDE", bits) if b}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)


def test_filter_audit(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(docs, labels).collect()}
    fails = list(failures(rows))
    parts = {p for p, *_ in fails}
    assert set(got) == {(p, "".join(o), s) for p in parts for o in itertools.permutations("ABCDE") for s in range(1, 6)}
    total = collections.Counter()
    for p in parts:
        for order in map("".join, itertools.permutations("ABCDE")):
            kept = [x for x in fails if x[0] == p]
            for step, f in enumerate(order, 1):
                mine = [x for x in fails if x[0] == p and f in x[1]]
                gone = [x for x in kept if f in x[1]]
                kept = [x for x in kept if f not in x[1]]
                total[p, f] += len(gone)
                r = got[p, order, step]
                want = (f, len(kept), len(gone), len(mine) - len(gone), sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone))
                assert tuple(r[c] for c in ("filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) == want
    assert all(r["shapley"] == total[p, r["filter"]] for (p, _, _), r in got.items())
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_removal_polynomial():
    rng = random.Random(5)
    counts = {m: rng.randrange(50) for m in range(8)}
    p = filter_audit.Removal(counts, 3)
    for s in range(8):
        assert p.corner(s) == sum(c for m, c in counts.items() if m & s)
    for i in range(3):
        want = 0
        for order in itertools.permutations(range(3)):
            seen = sum(1 << j for j in order[: order.index(i)])
            want += sum(c for m, c in counts.items() if m >> i & 1 and not m & seen)
        assert p.shapley(i) == want


def test_interactions_refuses_too_many(spark):
    with pytest.raises(ValueError):
        filter_audit.interactions(spark.range(1), {c: F.lit(False) for c in "ABCDEFG"}, F.lit(""), F.lit(False), F.lit(False))


def test_fill_middle(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = fill_middle.transform(docs).withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    want, forms = collections.Counter(), set()
    for i, t, *_ in rows:
        t = t or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        h = [int(sha(f"1:{'' if i is None else i}")[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
            row = (i, len(units), "plain", None, None, t)
        elif h[3] % 100 < 20:
            row = (i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
        else:
            row = (i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
        want[row, t] += 1
        forms.add(row[2])
    assert forms == {"plain", "psm", "spm"}
    assert collections.Counter((tuple(r)[:6], r["back"]) for r in got) == want
    assert fill_middle.digests(docs.limit(0)).count() == 0


def test_runs_across_steps(monkeypatch):
    rng = random.Random(9)
    for step in (1, 2, 3, 7, 1 << 20):
        monkeypatch.setattr(fill_middle, "STEP", step)
        for _ in range(60):
            t = "".join(rng.choice("abZ 1é日🎉") for _ in range(rng.randrange(25)))
            units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
            runs = fill_middle.Runs(t)
            assert runs.n == len(units)
            assert [runs.offset(u) for u in range(runs.n + 1)] == [len("".join(units[:u])) for u in range(len(units) + 1)]


TREE = "conv_id long, msg_id long, parent_id long, role string, text string, score double, key string, leaf string, rank string, conv string"


def spelt(messages, best):
    """Paths by walking parents in Python."""
    first, nodes = {}, []
    groups = collections.defaultdict(list)
    for m in messages:
        groups[m[0], m[1]].append(m)
    low = lambda v: (v is not None, v if v is not None else 0)  # noqa: E731  nulls first
    score = lambda v: 0.0 if v is None or v != v else v
    for (c, i), ms in groups.items():
        for k, m in enumerate(sorted(ms, key=lambda m: (low(m[2]), m[3] or "", m[4] or "", score(m[5])))):
            first[c, i, k] = m
            nodes.append((c, i, k))
    up = {n: (n[0], first[n][2], 0) if first[n][2] is not None and (n[0], first[n][2], 0) in first else None for n in nodes}
    order = lambda n: tuple(low(x) for x in n)
    for n in nodes:  # circles
        seen, at = [], n
        while at is not None and at not in seen:
            seen.append(at)
            at = up[at]
        if at is not None:
            circle = seen[seen.index(at) :]
            up[min(circle, key=order)] = None
    inner = set(up.values())
    trees = collections.defaultdict(list)
    for n in nodes:
        if n not in inner:
            path, at = [], n
            while at is not None:
                path.append(at)
                at = up[at]
            mean = sum(score(first[x][5]) for x in path) / len(path)
            trees[path[-1]].append((-mean, -len(path), order(n), path[::-1]))
    for root, branches in trees.items():
        for rank, (mean, _, _, path) in enumerate(sorted(branches, key=lambda b: (round(b[0], 9), *b[1:3]))[:best], 1):
            yield (root[0], root[1], path[-1][1], rank, len(branches), round(-mean, 9), tuple((first[x][3] or "", first[x][4] or "") for x in path))


def tree_rows():
    rng = random.Random(11)
    odd = ["", None, "</s>", "[INST] x [/INST]", "<\\/s>\\", "<|user|>\nhi</s>\n", "[\\/INST]<", "<s><", "日本🎉", "plain text", "\\"]
    rows = []
    for c in range(12):
        for i in range(rng.randint(1, 30)):
            rows.append((c, i, rng.randrange(i) if i and rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", None, "a|>b c\n", "é"]), rng.choice(odd) if rng.random() < 0.5 else f"t{rng.random()}", rng.choice([0.5, 0.25, 0.0, -1.0, None, float("nan")])))
    chain = [(50, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"c{i}", 1.0) for i in range(100)]
    circle = [(60, 1, 3, "user", "a", 0.0), (60, 2, 1, "assistant", "b", 0.0), (60, 3, 2, "user", "c", 0.0), (60, 0, 2, "user", "tail", 0.0), (60, 9, 9, "user", "self", 0.0), (60, 7, 0, "user", "t2", 0.0)]
    more = [(61, 1, 77, "user", "no such parent", 0.0), (None, 1, None, "user", "x", 0.0), (None, 2, 1, "assistant", "y", 0.0), (62, None, None, "user", "no id", 0.0), (62, None, 1, "user", "no id 2", 0.0)]
    twice = [(63, 1, None, "user", "q", 0.0), (63, 1, None, "user", "q", 0.0), (63, 1, None, "user", "another q", 0.0), (63, 2, 1, "assistant", "reply", 1.0)]
    return [(*r, "clash", "clash", "clash", "clash") for r in rows + chain + circle + more + twice]


@pytest.mark.parametrize("best", [1, 3])
def test_reply_trees(spark, best):
    rows = tree_rows()
    df = spark.createDataFrame(rows, TREE).repartition(3)
    got = chat.conversations(df, best, score_col="score").withColumn("formatted", chat.formatted(F.col("segments")))
    got = got.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()
    have = collections.Counter((r["conv_id"], r["root"], r["leaf"], r["rank"], r["n_branches"], round(r["score"], 9), tuple(map(tuple, r["turns"]))) for r in got)
    assert have == collections.Counter(spelt(rows, best))
    for r in got:
        assert r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        assert r["formatted"].count("</s>") == len(r["turns"]) and "[INST]" not in r["formatted"]
    assert chat.conversations(df.limit(0), best).count() == 0


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "a </s>"), (1, 3, "assistant", None), (2, 5, "user", None), (3, 0, None, "x"), (3, 0, None, "x"), (3, 0, "assistant", "y")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, msg_id string, segments string")
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    planted = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == {-1, 1, 2, 3}
    for c in got:
        turns = sorted((t, r or "", x or "") for i, t, r, x in rows + planted if i == c)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
