"""Fill-in-the-middle transformation by run-length encoding of character classes.

A text is n units: a run of the letters A-Z and a-z is one unit, any other code
point is one unit of its own.  Only the maximal runs of the two classes are
stored, each with its start and the number of units before it.  A cut after u
units is found by binary search for the run that holds unit u; within a run of
letters it is the run's start, within other characters the offset is a sum.
No unit is ever listed.

Defined cases: a null text is the empty text and stays plain; texts that hold a
sentinel stay plain; a null id hashes as the empty text; rows that repeat an id
are cut by the same hashes, each in its own text; ties (both cuts at one place)
give an empty middle; an empty table gives no rows; extra columns never reach
the operator.  A very long text is encoded in steps of ``STEP`` code points:
what is held for it is the text, its output and sixteen bytes a run.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import ddl, id_text, map_docs

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
STEP = 1 << 20


class Runs:
    """Maximal runs of letters and of other characters, with the units before each."""

    def __init__(self, text: str) -> None:
        starts, last, first = [], None, False
        for at in range(0, len(text), STEP):
            codes = np.frombuffer(text[at : at + STEP].encode("utf-32-le"), np.uint32)
            letter = ((codes | np.uint32(32)) - np.uint32(97)) < 26
            new = np.flatnonzero(letter[1:] != letter[:-1]) + (at + 1)
            if last is None:
                first = bool(letter[0])
            if last is None or bool(letter[0]) != last:
                starts.append(np.array([at]))
            starts.append(new)
            last = bool(letter[-1])
        self.chars, self.first = len(text), first
        self.starts = np.concatenate(starts) if starts else np.empty(0, np.int64)
        units = np.diff(self.starts, append=self.chars)
        units[0 if first else 1 :: 2] = 1  # classes alternate
        self.ends = np.cumsum(units)

    @property
    def n(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def offset(self, units: int) -> int:
        """Code points before unit ``units`` (the text's length if there is none)."""
        k = int(np.searchsorted(self.ends, units, "right"))
        if k == len(self.ends):
            return self.chars
        before = int(self.ends[k - 1]) if k else 0
        return int(self.starts[k]) + (0 if (k % 2 == 0) == self.first else units - before)


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of ``seed:doc_id``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.

    ``plain`` per cent of the texts stay as they are, ``spm`` per cent of the
    others have the suffix first.  One pass, no shuffle.
    """
    df = id_text(docs, id_col, text_col)
    df = df.select("doc_id", "text", *draws(seed, F.col("doc_id")))

    def run(batch):
        out = {c: [] for c in ("n", "form", "prefix_chars", "middle_chars", "output")}
        for text, h1, h2, h3, h4 in zip(*(batch.column(k) for k in range(1, 6))):
            text = text.as_py()
            runs = Runs(text)
            if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3.as_py() % 100 >= 100 - plain:
                row = (runs.n, "plain", None, None, text)
            else:
                a, b = sorted(runs.offset(h.as_py() % (runs.n + 1)) for h in (h1, h2))
                if h4.as_py() % 100 < spm:
                    row = (runs.n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b])))
                else:
                    row = (runs.n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b])))
            for c, v in zip(out, row):
                out[c].append(v)
        yield {"doc_id": batch.column(0), **out}

    return map_docs(df, run, f"doc_id {ddl(df, 'doc_id')}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    rest = F.substring(head, len(PREFIX) + 1, 2**31 - 1)
    psm = F.concat(F.substring_index(rest, SUFFIX, 1), middle, F.substring_index(rest, SUFFIX, -1))
    spm = F.concat(F.substring_index(rest, PREFIX, -1), middle, F.substring_index(rest, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The columns of the contract, read from the operator's outputs."""
    t = transform(docs)
    sha = lambda c, name: F.sha2(c, 256).alias(name)
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output"), "output_sha256"), sha(restore(F.col("output"), F.col("form")), "restored_sha256"))
