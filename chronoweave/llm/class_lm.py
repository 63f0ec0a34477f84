"""LM scoring with Brown's class-based bigrams.

Tokens are lower-cased white-space delimited words and one end per text, known
by 64-bit hashes.  Exchange clustering gives *every* word of the vocabulary a
class.  At first the ``top`` most frequent words are spread over ``classes``
classes and all others stand in one of 16 further classes by their shape
(length and last character).  The frequent words are exchanged one by one in
memory (each moves to the class that most raises the likelihood of the class
bigrams, until none moves).  Then ``passes`` batch passes over the corpus
exchange all the others: a word's counts of classes before and after it, from
the whole training corpus, tell which of all classes raises the likelihood
most.  A pass reads the classes that the pass before it gave.

A text's probability is the product of class transitions P(C_i | C_i-1) and
emissions P(w_i | C_i).  Words not seen in training count as one type a shape,
which lies in the class where the words of that shape seen once mostly are;
its emission is what absolute discounting takes from the words of that class.

Nothing of the size of the vocabulary is broadcast or collected.  The
vocabulary is dealt by hash over parts; a chunk of texts asks each part for
its distinct words with one packed row, and the parts stream through tables of
their own words.  The driver gets the ``top`` words and counts of class pairs.

Null text counts as empty (its end alone).  Repeated rows repeat results.  Of
words with equal counts the smaller hash is the more frequent; of equal gains
a word takes its own class, else the first.  With nothing to train on, all
tokens are unknown.  An empty table gives no rows.  A chunk holds whole texts:
a very long text is a chunk of its own, and memory follows the longest text.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoweave.llm import vector_text as vt
from chronoweave.llm.common import Scratch, crc_mod, ddl, id_text, map_docs, rows_in

SHAPES = 16
PIECE = 1 << 18  # bytes hashed at a time, which bounds a worker's memory; a longer text is hashed alone
END = np.uint64(vt.word_hash(b"\n"))  # no word holds a line end


def shapes(w: vt.Words) -> np.ndarray:
    """Shape class of each word: four lengths by four kinds of last character."""
    last = w.data[w.end - 1]
    kind = np.select([(last >= 97) & (last <= 122), last >= 128, (last >= 48) & (last <= 57)], [0, 1, 2], 3)
    return np.searchsorted((3, 6, 10), w.end - w.start) * 4 + kind


def squeeze(values: np.ndarray) -> bytes:
    """Integers of 0 or more by byte planes, compressed: a fraction of their size on disk and in shuffles."""
    size = next(s for s in (1, 2, 4, 8) if s == 8 or not len(values) or int(values.max()) < 1 << 8 * s)
    planes = values.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def spread_out(cell: bytes) -> np.ndarray:
    """What :func:`squeeze` packed, as int64."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell[1:]), np.uint8).reshape(cell[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{cell[0]}")[:, 0].astype(np.int64)


def _keys(cell: bytes) -> np.ndarray:
    return np.frombuffer(cell, np.uint64)


def _tokens(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words a text, and the hash and shape of every token, each text's end included."""
    w = vt.Words(part.column(1), lower=True)
    n = len(w.counts)
    tokens, shape = np.full(len(w.start) + n, END, np.uint64), np.full(len(w.start) + n, SHAPES, np.int8)
    where = np.arange(len(w.start)) + w.text_of()
    tokens[where] = w.hashes()
    shape[where] = shapes(w)
    return w.counts, tokens, shape


def chunks(docs: DataFrame, held_out: int, of: int, chars: int, id_col: str, text_col: str) -> DataFrame:
    """chunk, doc_ids, held, sizes, codes, keys, shape, n_keys: tokenised texts.

    codes index the distinct keys of the chunk; sizes are tokens a text.
    """
    df = id_text(docs, id_col, text_col).select("doc_id", "text", (crc_mod(F.col("doc_id"), of) == held_out).alias("held"))
    kind = ddl(df, "doc_id")

    def run(batch):
        from pyspark import TaskContext

        part_id = TaskContext.get().partitionId()
        for part in rows_in([batch], chars):
            counts, tokens, shape = (np.concatenate(x) for x in zip(*map(_tokens, rows_in([part], PIECE))))
            keys, first, codes, often = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent keys get small codes, which compress well
            keys, first = keys[order], first[order]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            run.n += 1
            yield {
                "chunk": [(part_id << 32) + run.n], "doc_ids": [part.column(0).to_pylist()], "held": [part.column(2).to_pylist()], "sizes": [(counts + 1).astype(np.int32)],
                "codes": [squeeze(rank[codes])], "keys": [keys.tobytes()], "shape": [squeeze(shape[first])], "n_keys": [len(keys)],
            }

    run.n = 0
    return map_docs(df, run, f"chunk long, doc_ids array<{kind}>, held array<boolean>, sizes array<int>, codes binary, keys binary, shape binary, n_keys long")


class Chunk:
    """The arrays of one row of a chunk table."""

    def __init__(self, batch, row: int) -> None:
        self._cell = lambda name: batch.column(name)[row]
        self.held = self._cell("held").values.to_numpy(zero_copy_only=False).astype(bool)
        self.sizes = self._cell("sizes").values.to_numpy(zero_copy_only=False)
        self.codes, self.shape = spread_out(self._cell("codes").as_py()), spread_out(self._cell("shape").as_py())
        self.training = np.repeat(~self.held, self.sizes)

    def keys(self) -> np.ndarray:
        return _keys(self._cell("keys").as_py())

    def values(self, name: str) -> np.ndarray:
        return spread_out(self._cell(name).as_py())


def parts_of(keys: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """Places of the keys of each part of the vocabulary, ascending."""
    p = (keys >> np.uint64(20)) % np.uint64(parts)
    order = np.argsort(p, kind="stable")
    cut = np.searchsorted(p[order], np.arange(parts + 1))
    return [(k, order[a:b]) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if a < b]


def vocabulary(tokenised: DataFrame, parts: int) -> DataFrame:
    """p, keys (sorted), shape, c, total: one row a part, counted over all training tokens."""

    def ask(batch):
        for row in range(batch.num_rows):
            k = Chunk(batch, row)
            keys, c = k.keys(), np.bincount(k.codes[k.training])
            c = np.pad(c, (0, len(keys) - len(c)))
            seen = np.flatnonzero(c)
            for p, at in parts_of(keys[seen], parts):
                at = seen[at]
                yield {"p": [p], "keys": [keys[at].tobytes()], "shape": [squeeze(k.shape[at])], "c": [squeeze(c[at])]}

    def merged(held):
        keys, shape, c = (np.concatenate(x) for x in zip(*held))
        keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, c)
        return keys, shape[first], total

    def count(batches):
        import pyarrow as pa

        held: dict[int, list] = {}
        loose: dict[int, int] = {}
        for batch in batches:
            for p, keys, shape, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                new = _keys(keys), spread_out(shape), spread_out(c)
                held.setdefault(p, []).append(new)
                loose[p] = loose.get(p, 0) + len(new[0])
                if loose[p] > 1 << 20:
                    held[p], loose[p] = [merged(held[p])], 0
        for p in sorted(held):
            keys, shape, c = merged(held.pop(p))
            cols = [[p], [keys.tobytes()], [squeeze(shape)], [squeeze(c)], [int(c.sum())], [len(keys)]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], ["p", "keys", "shape", "c", "total", "types"])

    asked = map_docs(tokenised.select("held", "sizes", "codes", "shape", "keys"), ask, "p int, keys binary, shape binary, c binary")
    return asked.repartitionById(parts, "p").mapInArrow(count, "p int, keys binary, shape binary, c binary, total long, types long")


def most_frequent(words: DataFrame, top: int) -> np.ndarray:
    """The ``top`` most frequent keys, as int64."""

    def run(batch):
        for row in range(batch.num_rows):
            keys, shape, c = _keys(batch.column(0)[row].as_py()), spread_out(batch.column(1)[row].as_py()), spread_out(batch.column(2)[row].as_py())
            at = np.flatnonzero(shape < SHAPES)
            at = at[np.lexsort((keys[at].view(np.int64), -c[at]))[:top]]
            yield {"key": keys[at].view(np.int64), "c": c[at]}

    best = map_docs(words.select("keys", "shape", "c"), run, "key long, c long").orderBy(F.desc("c"), "key").limit(top).collect()
    return np.asarray([r[0] for r in best], np.int64)


def _states(keys: np.ndarray, shape: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Frequent words by rank, others by shape behind them; the end is the last state."""
    if not len(top):
        return shape.astype(np.int64)
    order, keys = np.argsort(top), keys.view(np.int64)
    at = np.searchsorted(top, keys, sorter=order)
    at[at == len(top)] = 0
    rank = order[at]
    return np.where((top[rank] == keys) & (shape < SHAPES), rank, len(top) + shape)


def _previous(states: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    prev = np.empty_like(states)
    prev[1:] = states[:-1]
    prev[np.cumsum(sizes) - sizes] = end
    return prev


def pair_counts(table: DataFrame, n: int, states) -> np.ndarray:
    """Counts of all pairs of ``n`` states in training texts; ``states(chunk)``: a state a key.  The last state is the end."""

    def run(batch):
        for row in range(batch.num_rows):
            k = Chunk(batch, row)
            state = states(k)[k.codes]
            code = (_previous(state, k.sizes, n - 1) * n + state)[k.training]
            pair, c = np.unique(code, return_counts=True)
            yield {"pair": pair, "c": c}

    out = np.zeros(n * n)
    for r in map_docs(table, run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).collect():  # at most n * n rows
        out[r[0]] = r[1]
    return out.reshape(n, n)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray, cls: np.ndarray) -> float:
    """What classes add to the log-likelihood of bigrams; the rest does not depend on them."""
    to = np.zeros((len(pairs), int(cls.max()) + 1))
    to[np.arange(len(pairs)), cls] = 1
    N = to.T @ pairs @ to
    return float(_xlogx(N).sum() - _xlogx(N.sum(axis=1)).sum() - _xlogx(N.sum(axis=0)).sum())


def exchange(pairs: np.ndarray, movable: int, classes: int) -> np.ndarray:
    """Class of each state: the first ``movable`` by exchange, the others alone.

    Starts with words dealt by frequency rank; each pass moves every word to
    its best class.  Every move raises the likelihood, so the passes end: when
    none moves.
    """
    n = len(pairs)
    classes = max(1, min(classes, movable))
    cls = np.concatenate([np.arange(movable) % classes, classes + np.arange(n - movable)])
    k = classes + n - movable
    to = np.zeros((n, k))
    to[np.arange(n), cls] = 1
    N = to.T @ pairs @ to
    moved = movable
    while moved:
        moved = 0
        for w in range(movable):
            a = cls[w]
            row, col, own = pairs[w] @ to, pairs[:, w] @ to, pairs[w, w]
            row[a] -= own
            col[a] -= own
            N[a] -= row
            N[:, a] -= col
            N[a, a] -= own
            rows, cols = N.sum(axis=1) + col, N.sum(axis=0) + row  # wherever the word stands, its neighbours' sums hold it
            here = slice(0, classes)
            gain = (_xlogx(N[here] + row) - _xlogx(N[here])).sum(axis=1) + (_xlogx(N[:, here] + col[:, None]) - _xlogx(N[:, here])).sum(axis=0)
            d = np.arange(classes)
            old = N[d, d]
            gain += _xlogx(old + row[d] + col[d] + own) - _xlogx(old + row[d]) - _xlogx(old + col[d]) + _xlogx(old)
            wr, wc = row.sum() + own, col.sum() + own
            gain -= _xlogx(rows[here] + wr) - _xlogx(rows[here]) + _xlogx(cols[here] + wc) - _xlogx(cols[here])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9 * (1 + abs(gain[a])):
                b = a
            moved += b != a
            to[w, a], to[w, b], cls[w] = 0, 1, b
            N[b] += row
            N[:, b] += col
            N[b, b] += own
    return cls


def batch_moves(before: np.ndarray, after: np.ndarray, own: np.ndarray, N: np.ndarray) -> np.ndarray:
    """Best class of each word, from its counts of classes before and after it (n, k).

    Gains are of first order in a word's counts, which are small beside those
    of a class; the word's own counts are taken out of the class it is in.
    The last class is the end's alone.
    """
    k, half = len(N), 0.5
    rows, cols = N.sum(axis=1), N.sum(axis=0)
    log = np.log(N + half)
    base = np.log(rows + half * k) + np.log(cols + half * k)
    c = after.sum(axis=1)
    gain = before @ log + after @ log.T - c[:, None] * base
    i = np.arange(len(own))
    kept = (before * np.log(np.maximum(N.T[own] - before, 0) + half)).sum(axis=1) + (after * np.log(np.maximum(N[own] - after, 0) + half)).sum(axis=1)
    kept -= c * (np.log(np.maximum(rows[own] - c, 0) + half * k) + np.log(np.maximum(cols[own] - c, 0) + half * k))
    gain[i, own] = kept
    gain[:, -1] = -np.inf
    best = gain.argmax(axis=1)
    return np.where(gain[i, best] > kept + 1e-9, best, own)


def _beside(parts: int, *tables: DataFrame) -> DataFrame:
    """The rows of tables that share columns, dealt by ``p``, those of the first before the others."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("turn", F.lit(k))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out.repartitionById(parts, "p").sortWithinPartitions("p", "turn")


def reassigned(table: DataFrame, words: DataFrame, states, fixed: np.ndarray, fixed_cls: np.ndarray, N: np.ndarray, parts: int) -> DataFrame:
    """p, keys, shape, c, cls: the vocabulary after a batch pass; ``states(chunk)``: the class of each key so far.

    The keys ``fixed`` keep ``fixed_cls``.
    """
    n = len(N)

    def ask(batch):
        for row in range(batch.num_rows):
            k = Chunk(batch, row)
            keys = k.keys()
            cls = states(k)
            state = cls[k.codes]
            prev = _previous(state, k.sizes, n - 1)
            follows = np.append(state[1:], n - 1)
            train, t = k.codes[k.training], k.training
            ends = k.codes == np.flatnonzero(k.shape == SHAPES)[0]
            t = t & ~ends  # the end has its own class
            train = k.codes[t]
            code, c = np.unique(np.concatenate([train * (2 * n) + prev[t], train * (2 * n) + n + follows[t]]), return_counts=True)
            key, where = code // (2 * n), code % (2 * n)
            bounds = np.searchsorted(key, np.arange(len(keys) + 1))
            size = np.diff(bounds)
            seen = np.flatnonzero(size)
            for p, at in parts_of(keys[seen], parts):
                at = seen[at]
                take = np.repeat(bounds[at] - np.cumsum(size[at]) + size[at], size[at]) + np.arange(size[at].sum())
                yield {"p": [p], "keys": [keys[at].tobytes()], "own": [squeeze(cls[at])], "size": [squeeze(size[at])], "where": [squeeze(where[take])], "n": [squeeze(c[take])]}

    def gather(batches):
        import pyarrow as pa

        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

        def done(w):
            p, keys, shape, c, counts, own = w
            cls = np.full(len(keys), n - 1, np.int64)
            for a in range(0, len(keys), 4096):
                s = slice(a, a + 4096)
                b = counts[s].reshape(-1, 2, n)
                cls[s] = batch_moves(b[:, 0].astype(np.float64), b[:, 1].astype(np.float64), own[s], N)
            state = _states(keys, shape, fixed)
            cls = np.where(shape == SHAPES, n - 1, np.where(state < len(fixed), np.append(fixed_cls, 0)[np.minimum(state, len(fixed))], cls))
            cols = [[p], [keys.tobytes()], [squeeze(shape)], [squeeze(c)], [squeeze(cls)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], ["p", "keys", "shape", "c", "cls"])

        now = None
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                if cell("turn") == 0:
                    if now is not None:
                        yield done(now)
                    keys = _keys(cell("keys"))
                    now = cell("p"), keys, spread_out(cell("shape")), spread_out(cell("c")), np.zeros((len(keys), 2 * n), np.float32), np.zeros(len(keys), np.int64)
                    continue
                at = np.searchsorted(now[1], _keys(cell("keys")))
                now[5][at] = spread_out(cell("own"))
                flat = np.repeat(at, spread_out(cell("size"))) * (2 * n) + spread_out(cell("where"))
                now[4].reshape(-1)[flat] += spread_out(cell("n"))  # places differ within a row
        if now is not None:
            yield done(now)

    asked = map_docs(table.select("held", "sizes", "codes", "shape", "keys", *[c for c in table.columns if c == "cls"]), ask, "p int, keys binary, own binary, size binary, where binary, n binary")
    dealt = _beside(parts, words.select("p", "keys", "shape", "c"), asked)
    return dealt.mapInArrow(gather, "p int, keys binary, shape binary, c binary, cls binary")


def looked_up(table: DataFrame, words: DataFrame, parts: int, keep_keys: bool) -> DataFrame:
    """The chunks with ``c`` and ``cls`` of each of their keys; cls is 0 for unknown ones, else the class plus 1."""

    def ask(batch):
        for chunk, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            keys = _keys(cell)
            for p, at in parts_of(keys, parts):
                yield {"p": [p], "chunk": [chunk], "at": [squeeze(at)], "keys": [keys[at].tobytes()]}

    def answer(batches):
        import pyarrow as pa

        p = keys = c = cls = None
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                if cell("turn") == 0:
                    p, keys, c, cls = cell("p"), _keys(cell("keys")), spread_out(cell("c")), spread_out(cell("cls"))
                    continue
                asked = _keys(cell("keys"))
                if p != cell("p"):  # a part without a training word
                    p, keys = cell("p"), np.empty(0, np.uint64)
                k = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
                known = keys[k] == asked if len(keys) else np.zeros(len(asked), bool)
                got = (np.where(known, x[k], 0) if len(keys) else np.zeros(len(asked), np.int64) for x in (c, cls + 1 if len(keys) else cls))
                out.append((cell("chunk"), cell("at"), *map(squeeze, got)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["chunk", "at", "c", "cls"])

    asked = map_docs(table.select("chunk", "keys"), ask, "p int, chunk long, at binary, keys binary")
    answers = _beside(parts, words.select("p", "keys", "c", "cls"), asked).mapInArrow(answer, "chunk long, at binary, c binary, cls binary")
    own = table.drop("c", "cls", *[] if keep_keys else ["keys"]).withColumn("turn", F.lit(0))
    both = own.unionByName(answers.withColumn("turn", F.lit(1)), allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "turn")
    schema = StructType.fromDDL(", ".join(f"{c} {ddl(table, c)}" for c in table.columns if c not in ("c", "cls") and (keep_keys or c != "keys")) + ", c binary, cls binary")

    def join(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, now = to_arrow_schema(schema), None

        def done():
            row, c, cls = now
            cols = [row.column(f.name).cast(f.type) for f in arrow if f.name not in ("c", "cls")]
            return pa.RecordBatch.from_arrays([*cols, pa.array([squeeze(c)], pa.binary()), pa.array([squeeze(cls)], pa.binary())], schema=arrow)

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                if row.column("turn")[0].as_py() == 0:
                    if now:
                        yield done()
                    n = row.column("n_keys")[0].as_py()
                    now = row, np.zeros(n, np.int64), np.zeros(n, np.int64)
                    continue
                at = spread_out(row.column("at")[0].as_py())
                for x, name in zip(now[1:], ("c", "cls")):
                    x[at] = spread_out(row.column(name)[0].as_py())
        if now:
            yield done()

    return both.mapInArrow(join, schema)


class Model:
    """Log10 tables: transitions between classes, and the discounts of emissions.

    ``N``: counts of class pairs, the end's class last.  ``tail``: by (class,
    shape) tokens, types, and types seen once and twice.
    """

    def __init__(self, N: np.ndarray, tail: dict[tuple[int, int], tuple[int, int, int, int]]) -> None:
        k = len(N)
        prior = (N.sum(axis=0) + 1) / (N.sum() + k)
        self.move = np.log10((N + 5 * prior) / (N.sum(axis=1, keepdims=True) + 5))
        stats, once = np.zeros((k, 4)), np.zeros((SHAPES, k))
        for (cls, shape), x in tail.items():
            stats[cls] += x
            once[shape, cls] += x[2]
        tokens, types, ones, twos = stats.T
        #: Class of an unseen word of each shape, and its emission.
        self.new = np.where(once.any(axis=1), once.argmax(axis=1), int(np.argmax(tokens[:-1])) if k > 1 else 0)
        share = np.maximum(once[np.arange(SHAPES), self.new], 0.5)
        whole = np.zeros(k)
        np.add.at(whole, self.new, share)
        self.discount = np.where(whole > 0, np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.05, 0.95), 0.0)
        self.total = np.maximum(tokens, 1e-9)
        left = np.maximum(self.discount * types / self.total, 1e-300)
        self.unseen = np.where(tokens[self.new] > 0, np.log10(left[self.new] * share / whole[self.new]), np.log10(share / whole[self.new]))

    def classes(self, cls: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Class of each key; cls as :func:`looked_up` gives it."""
        out = np.where(cls > 0, cls - 1, self.new[np.minimum(shape, SHAPES - 1)])
        return np.where(shape == SHAPES, len(self.move) - 1, out)

    def emissions(self, c: np.ndarray, cls: np.ndarray, shape: np.ndarray) -> np.ndarray:
        known = np.log10(np.maximum(c - self.discount[cls], 1e-9) / self.total[cls])
        return np.where(shape == SHAPES, 0.0, np.where(c > 0, known, self.unseen[np.minimum(shape, SHAPES - 1)]))

    def log10(self, c: np.ndarray, cls: np.ndarray, shape: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each token of a chunk."""
        cls = self.classes(cls, shape)
        emit, at = self.emissions(c, cls, shape)[codes], cls[codes]
        return self.move[_previous(at, sizes, len(self.move) - 1), at] + emit


def tails(words: DataFrame) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """Tokens, types, and types seen once and twice by (class, shape), without the end."""

    def run(batch):
        for row in range(batch.num_rows):
            shape, c, cls = (spread_out(batch.column(k)[row].as_py()) for k in range(3))
            at = np.flatnonzero(shape < SHAPES)
            code, back = np.unique(cls[at] * SHAPES + shape[at], return_inverse=True)
            sums = [np.bincount(back, weights=x, minlength=len(code)).astype(np.int64) for x in (c[at], np.ones(len(at)), c[at] == 1, c[at] == 2)]
            yield {"code": code, **dict(zip(("tokens", "types", "once", "twice"), sums))}

    rows = map_docs(words.select("shape", "c", "cls"), run, "code long, tokens long, types long, once long, twice long").groupBy("code").agg(*[F.sum(x).alias(x) for x in ("tokens", "types", "once", "twice")]).collect()
    return {(r[0] // SHAPES, r[0] % SHAPES): tuple(r[1:]) for r in rows}


def trained(tokenised: DataFrame, scratch: Scratch, top: int, classes: int, passes: int, per_part: int = 1_000_000) -> tuple[DataFrame, Model, int, int]:
    """The chunks with counts and classes, the model, and the tokens and types of training."""
    pairs_asked = tokenised.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    parts = int(max(tokenised.sparkSession.sparkContext.defaultParallelism, 8, -(-pairs_asked // per_part)))
    words = scratch.table(vocabulary(tokenised, parts))
    total, types = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    often = most_frequent(words, top)
    n = len(often) + SHAPES + 1
    pairs = pair_counts(tokenised.select("held", "sizes", "codes", "shape", "keys"), n, lambda k: _states(k.keys(), k.shape, often))
    cls = exchange(pairs, len(often), classes)
    to = np.zeros((n, int(cls.max()) + 1))
    to[np.arange(n), cls] = 1
    N = to.T @ pairs @ to
    k = len(N)
    table, states = tokenised, lambda x: cls[_states(x.keys(), x.shape, often)]
    for turn in range(passes + 1):
        if turn:
            states = lambda x: np.where(x.shape == SHAPES, k - 1, np.maximum(x.values("cls") - 1, 0))
            N = pair_counts(table.select("held", "sizes", "codes", "shape", "cls"), k, states)
            if turn == passes:
                break
        words, old = scratch.table(reassigned(table, words, states, often, cls[: len(often)], N, parts)), words
        scratch.drop(old)
        table, old = scratch.table(looked_up(table, words, parts, keep_keys=turn + 1 < passes)), table
        scratch.drop(old)
    return table, Model(N, tails(words)), total, types


def score(docs: DataFrame, held_out: int = 0, of: int = 10, top: int = 512, classes: int = 48, passes: int = 1, chunk_chars: int = 3_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    base_score: the additively smoothed unigram log10 probability; score: the
    class model's; perplexity: 10 ** (-score / n_tokens).
    """
    if passes < 1:
        raise ValueError("at least one pass gives every word its class")
    scratch = Scratch(docs.sparkSession, "lm")
    tokenised = scratch.table(chunks(docs, held_out, of, chunk_chars, id_col, text_col))
    table, model, total, types = trained(tokenised, scratch, top, classes, passes)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batch):
        for row in range(batch.num_rows):
            k = Chunk(batch, row)
            c = k.values("c")
            base = np.log10((c + 0.1) / (total + 0.1 * (types + 1)))[k.codes]
            first = np.concatenate([[0], np.cumsum(k.sizes)])
            sums = np.add.reduceat(model.log10(c, k.values("cls"), k.shape, k.codes, k.sizes), first[:-1])
            yield {
                "doc_id": batch.column("doc_ids")[row].values, "held_out": k.held, "n_tokens": k.sizes.astype(np.int64), "n_known": vt.segment_sums((c[k.codes] > 0).astype(np.int64), first),
                "train_tokens": np.full(len(k.sizes), total), "base_score": np.add.reduceat(base, first[:-1]), "score": sums, "perplexity": 10 ** np.minimum(300, -sums / k.sizes),
            }

    return map_docs(table.drop("chunk", "n_keys"), run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
