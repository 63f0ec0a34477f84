"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads text byte by byte in both directions and gives every
position a distribution over the learned languages; a document's distribution
is the mean over all its positions.  A text is read in windows of ``WINDOW``
bytes that overlap: state is carried across words for ``AROUND`` bytes before a
position counts and after, in both directions, and every position counts once.
So windows of many texts are run together, and no text, however long, needs
more memory than its bytes and some windows.  Short texts are padded with
blanks, which do not count.

Training is in numpy, by backpropagation through time with Adam, on a sample
of at most ``docs_per_lang`` labelled rows a language, whole texts (a
documented limit of the fit; prediction covers all texts).

Null texts and texts without a letter are ``und`` with score 0.  With nothing
to learn from, every text is ``und``.  Rows with a null language are not
learned from.  Of equally likely languages the first in order of names is
taken.  Repeated rows repeat results; an empty table gives no rows; extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm import ranking
from chronoweave.llm import vector_text as vt
from chronoweave.llm.common import crc_mod, ddl, give_back, id_text, map_docs, rows_in

WINDOW, AROUND = 320, 32
CORE = WINDOW - 2 * AROUND
PAD = 32  # short texts are padded to a multiple of it
UNDETERMINED = "und"


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place: the squashing function of states, a quarter of the cost of ``np.tanh``."""
    y = np.abs(x)
    y += 1
    x /= y
    return x


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * squash(x)


def _slope(y: np.ndarray) -> np.ndarray:
    """Of :func:`squash` where its value is y."""
    return (1 - np.abs(y)) ** 2


class Network:
    """Weights by name.  Per direction: X (bytes to 3 gates), U (state to 3 gates), b; and the output O, c."""

    def __init__(self, langs: list[str], hidden: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        w = {}
        for d in "fb":
            w["X" + d] = rng.normal(0, 0.3, (256, 3 * hidden))
            w["U" + d] = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
            w["b" + d] = np.zeros(3 * hidden)
        w["O"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, len(langs)))
        w["c"] = np.zeros(len(langs))
        self.w = {k: v.astype(np.float32) for k, v in w.items()}

    def _run(self, units: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each byte of equally long units, (length, n, hidden)."""
        n, length = units.shape
        h, H = np.zeros((n, self.hidden), np.float32), self.hidden
        X, U, b = (self.w[k + d] for k in "XUb")
        out = np.empty((length, n, H), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            x, u = X[units[:, t]] + b, h @ U
            gates = _gate(x[:, : 2 * H] + u[:, : 2 * H])
            z, r = gates[:, :H], gates[:, H:]
            cand = squash(x[:, 2 * H :] + r * u[:, 2 * H :])
            if keep is not None:
                keep.append((t, h, z, r, cand, u[:, 2 * H :]))
            h = cand + z * (h - cand)
            out[t] = h
        return out

    def _states(self, units: np.ndarray, d: str) -> np.ndarray:
        """What :meth:`_run` gives, as (length, hidden, n): gates lie in rows, so that each step works on few large blocks."""
        n, length = units.shape
        H = self.hidden
        X = np.ascontiguousarray((self.w["X" + d] + self.w["b" + d]).T)
        U = np.ascontiguousarray(self.w["U" + d].T)
        by_step = np.ascontiguousarray(units.T)
        h, out = np.zeros((H, n), X.dtype), np.empty((length, H, n), X.dtype)
        x, u = np.empty((3 * H, n), X.dtype), np.empty((3 * H, n), X.dtype)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            np.take(X, by_step[t], axis=1, out=x, mode="clip")
            np.matmul(U, h, out=u)
            gates, cand = x[: 2 * H], x[2 * H :]
            gates += u[: 2 * H]
            squash(gates)
            gates *= 0.5
            gates += 0.5
            u[2 * H :] *= gates[H:]
            cand += u[2 * H :]
            squash(cand)
            h = h - cand
            h *= gates[:H]
            h += cand
            out[t] = h
        return out

    def by_language(self, units: np.ndarray) -> np.ndarray:
        """Language probabilities at each byte, (length, languages, n)."""
        H, O = self.hidden, self.w["O"].T
        p = np.matmul(O[:, :H], self._states(units, "f"))
        p += np.matmul(O[:, H:], self._states(units, "b"))
        p += self.w["c"][:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def positions(self, units: np.ndarray) -> np.ndarray:
        """Language probabilities at each byte, (n, length, languages)."""
        return self.by_language(units).transpose(2, 0, 1)

    def gradients(self, units: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over positions, by backpropagation through time."""
        n, length = units.shape
        H, tapes = self.hidden, {"f": [], "b": []}
        both = np.concatenate([self._run(units, d, tapes[d]) for d in "fb"], axis=2)
        logits = both @ self.w["O"] + self.w["c"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(n), label] -= 1
        p /= n * length
        g = {"O": both.reshape(-1, 2 * H).T @ p.reshape(n * length, -1), "c": p.sum(axis=(0, 1))}
        back = p @ self.w["O"].T
        for d, part in (("f", back[:, :, :H]), ("b", back[:, :, H:])):
            gX, gU, gb = (np.zeros_like(self.w[k + d]) for k in "XUb")
            dh = np.zeros((n, H), np.float32)
            for t, h, z, r, cand, un in reversed(tapes[d]):
                dh = dh + part[t]
                dz = dh * (h - cand) * 0.5 * _slope(2 * z - 1)
                dc = dh * (1 - z) * _slope(cand)
                dr = dc * un * 0.5 * _slope(2 * r - 1)
                dx = np.concatenate([dz, dr, dc], axis=1)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(gX, units[:, t], dx)
                gU += h.T @ du
                gb += dx.sum(axis=0)
                dh = dh * z + du @ self.w["U" + d].T
            g["X" + d], g["U" + d], g["b" + d] = gX, gU, gb
        return g


def train(units: list[np.ndarray], labels: list[np.ndarray], langs: list[str], hidden: int = 12, epochs: int = 2, batch: int = 64, rate: float = 0.01, seed: int = 42) -> Network:
    """``units``: arrays of equally long windows, with the language of each window in ``labels``."""
    net = Network(langs, hidden, seed)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    steps = [(s, at) for s, x in enumerate(units) for at in range(0, len(x), batch)]
    step, total = 0, epochs * len(steps)
    for _ in range(epochs):
        orders = [rng.permutation(len(x)) for x in units]
        for k in rng.permutation(len(steps)):
            s, at = steps[k]
            pick = orders[s][at : at + batch]
            g = net.gradients(units[s][pick], labels[s][pick])
            step += 1
            lr = rate * (1 - 0.9 * step / total) * min(1.0, len(pick) / 32)
            for key, grad in g.items():
                m[key] += 0.1 * (grad - m[key])
                v[key] += 0.002 * (grad * grad - v[key])
                net.w[key] -= (lr * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
    return net


def windows(data: np.ndarray, offsets: np.ndarray):
    """Windows over texts that lie behind one another, in sets of one length.

    Yields the bytes (n, length), and of each window its text and the first
    and the end of the places that count in it.
    """
    size = np.diff(offsets)
    long = np.flatnonzero(size > WINDOW)
    count = -(-size[long] // CORE)
    owner = np.repeat(long, count)
    core = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * CORE
    n = size[owner]
    start = np.clip(core - AROUND, 0, n - WINDOW)
    for at in range(0, len(owner), 512):
        s = slice(at, at + 512)
        yield data[(offsets[owner[s]] + start[s])[:, None] + np.arange(WINDOW)], owner[s], core[s] - start[s], np.minimum(core[s] + CORE, n[s]) - start[s]
    padded = -(-size // PAD) * PAD
    for length in range(PAD, WINDOW + 1, PAD):
        of = np.flatnonzero((padded == length) & (size > 0))
        for at in range(0, len(of), 512):
            own = of[at : at + 512]
            place = np.arange(length)[None]
            inside = place < size[own, None]
            where = np.minimum(offsets[own, None] + place, len(data) - 1)
            yield np.where(inside, data[where], np.uint8(32)), own, np.zeros(len(own), np.int64), size[own]


def _folded(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, lower-cased in A-Z, and their offsets."""
    data, offsets = vt.column_bytes(col)
    return vt.byte_table(b"", True)[1][data], offsets


def documents(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean position probabilities of each text; zeros for empty texts."""
    total = np.zeros((len(offsets) - 1, len(net.langs)))
    for units, owner, a, b in windows(data, offsets):
        p = net.by_language(units)
        place = np.arange(units.shape[1])[:, None]
        p *= ((place >= a) & (place < b))[:, None]
        np.add.at(total, owner, p.sum(axis=0, dtype=np.float64).T)
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def fit(docs: DataFrame, docs_per_lang: int = 100, hidden: int = 12, epochs: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network fitted on at most ``docs_per_lang`` rows a language with text and language.

    Rows are taken by a seeded hash of their id, so the sample does not depend
    on partitions; whole texts are learned from.
    """
    import pyarrow as pa

    known = docs.where(docs[text_col].isNotNull() & docs[lang_col].isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    at = ranking.spread(F.col(id_col), seed=seed)
    limit = F.lit(0)
    for lang, n in counts.items():  # some more than needed, which the window below cuts by rank
        limit = F.when(F.col(lang_col) == lang, int((1 << ranking.SPREAD_BITS) * min(1.0, (2 * docs_per_lang + 20) / n))).otherwise(limit)
    some = known.where(at < limit).select(F.col(lang_col).alias("l"), F.col(text_col).alias("t"), at.alias("at"), F.col(id_col).cast("string").alias("i"))
    order = Window.partitionBy("l").orderBy("at", "i", "t")
    rows = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_per_lang).orderBy("l", "k").collect()
    langs = sorted(counts)
    data, offsets = _folded(pa.array([r["t"] for r in rows], pa.string()))
    label = np.asarray([langs.index(r["l"]) for r in rows], np.int64)
    sets: dict[int, list] = {}
    for units, owner, _, _ in windows(data, offsets):
        sets.setdefault(units.shape[1], []).append((units, label[owner]))
    if not sets:
        return None
    units, labels = zip(*[[np.concatenate(x) for x in zip(*s)] for s in sets.values()])
    return train(list(units), list(labels), langs, hidden, epochs, seed=seed)


@lru_cache(maxsize=1 << 16)
def _is_letter(ch: str) -> bool:
    return unicodedata.category(ch)[0] == "L"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(_is_letter, text))


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    df = id_text(docs, id_col, text_col)

    def run(batch):
        for part in rows_in([batch], 500_000):
            letters = np.fromiter((has_letter(t) for t in part.column(1).to_pylist()), bool, part.num_rows)
            if net is None:
                yield {"doc_id": part.column(0), "lang_pred": [UNDETERMINED] * len(letters), "score": [0.0] * len(letters)}
                continue
            p = documents(net, *_folded(part.column(1)))
            best = p.argmax(axis=1)
            score = np.minimum(1.0, p[np.arange(len(p)), best])
            yield {"doc_id": part.column(0), "lang_pred": [net.langs[b] if ok else UNDETERMINED for b, ok in zip(best, letters)], "score": np.where(letters, score, 0.0)}

    return map_docs(df, run, f"doc_id {ddl(df, 'doc_id')}, lang_pred string, score double")


def label_positions(net: Network, text: str) -> list[str]:
    """The language of every byte of a text."""
    import pyarrow as pa

    data, offsets = _folded(pa.array([text], pa.string()))
    out = []
    for units, _, a, b in windows(data, offsets):
        best = net.by_language(units).argmax(axis=1)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
            out += [net.langs[x] for x in best[i:j, k].tolist()]
    return out


def identify(docs: DataFrame, held_out: int = 2, of: int = 4, id_col: str = "doc_id", **fitting) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows not held out alone.

    Rows whose crc32(id as text) mod ``of`` is ``held_out`` are held out.
    """
    net = fit(docs.where(crc_mod(docs[id_col], of) != held_out), id_col=id_col, **fitting)
    out = predict(docs, net, id_col)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), of) == held_out).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """The rows of docs whose language can be told, all columns kept; null languages are filled in.

    Rejected: texts without a letter and, if there is anything to learn from,
    rows that score under ``min_score``.  The verdict falls in the pass that reads the text, so nothing is shuffled.
    """
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401
    from pyspark.sql.pandas.types import to_arrow_schema

    net = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **fitting)
    schema, at, named = docs.schema, docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches):
        arrow = to_arrow_schema(schema)
        for part in rows_in(batches, 500_000):
            text, cols = part.column(at), list(part.columns)
            keep = np.fromiter((has_letter(t) for t in text.to_pylist()), bool, part.num_rows)
            if net is not None:
                p = documents(net, *_folded(text))
                keep &= p.max(axis=1) >= min_score
                told = pa.array([net.langs[k] for k in p.argmax(axis=1).tolist()], pa.string()).cast(cols[named].type)
                cols[named] = pa.compute.coalesce(cols[named], told)
            part = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow)], schema=arrow)
            yield part.filter(pa.array(keep))
        give_back()

    return docs.mapInArrow(run, schema)
