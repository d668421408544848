"""Periodic runs: stretches of words that repeat with a period at least four times over.

A run is a stretch with smallest period q (words q apart are equal) and a length of at least max(6, 4 q) that no
neighbouring word extends. Its words match those q further on max(6 - q, 3 q) times in a row, so lags are counted first
and only lags with that many matches are looked at:

* heavy words, too frequent for pairs, by the exact autocorrelation of their places (FFT, rounded to whole numbers),
* light words by the differences of their places, pair by pair.

A lag with enough matches gets island scans: at every place for short lags, else at every quarter of the lag first, of
which an island must hit a dozen in a row, and at every place only around such rows. Matches that a found run explains at
the multiples of its period are taken off the counts: those lags have no run of their own there, since two periods of a
stretch longer than their sum make their common divisor one (Fine and Wilf). So a text of one repeated word is one scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimp.llm.durable import few_at_once

#: What a word is, the least length of a run, and how often its period fits into it at least.
WORD, LEAST, TIMES = r"[^\x20\x09-\x0D]+", 6, 4
#: Words that occur fewer times are light in any text; lags below DENSE are scanned at every place.
LIGHT, DENSE = 64, 16
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def lag_counts(words: np.ndarray, most: int, light: float | None = None) -> np.ndarray:
    """How many words equal the one q further on, for each q up to `most`; words as whole numbers from 0."""
    n = len(words)
    light = max(LIGHT, np.sqrt(n * np.log2(max(n, 2)))) if light is None else light
    heavy = np.flatnonzero(np.bincount(words) > light)
    counts = np.zeros(most + 1, np.int64)
    if len(heavy):
        size = 1 << int(n + most).bit_length()  # no lag up to `most` wraps around
        power = sum(np.abs(np.fft.rfft(words == w, size)) ** 2 for w in heavy)
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    places = np.argsort(words, kind="stable")
    if len(heavy):
        places = places[~np.isin(words[places], heavy)]
    at, k = places, 1
    while len(at) == len(places) or len(at):
        # Places of words that have a k-th next place at most `most` further on; later ones are further still.
        at = np.arange(len(places) - k) if k == 1 else at[at < len(places) - k]
        far = places[at + k] - places[at]
        near = (words[places[at]] == words[places[at + k]]) & (far <= most)
        at = at[near]
        if not len(at):
            break
        counts += np.bincount(far[near], minlength=most + 1)
        k += 1
    counts[0] = 0
    return counts


def islands(hits: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of at least `least` hits."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hits.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))


def matches(words: np.ndarray, q: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches of at least `least` places whose word equals the one q further on."""
    last = len(words) - q
    if q < DENSE:
        yield from islands(words[q:] == words[:last], least)
        return
    step = q // 4
    some = np.arange(0, last, step)
    for a, b in islands(words[some] == words[some + q], least // step):
        lo, hi = max(0, int(some[a]) - step + 1), min(last, int(some[b - 1]) + step)
        yield from ((lo + s, lo + e) for s, e in islands(words[lo:hi] == words[lo + q : hi + q], least))


def runs(words: np.ndarray, light: float | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    n = len(words)
    if n < LEAST:
        return []
    counts = lag_counts(words, n // TIMES, light)
    lags = np.arange(len(counts))
    need = np.maximum(LEAST - lags, (TIMES - 1) * lags)
    found = []
    stretches: set[tuple[int, int]] = set()
    for q in np.flatnonzero((counts >= need) & (lags > 0)).tolist():
        if counts[q] < need[q]:
            continue  # a shorter period explains them
        for start, end in matches(words, q, int(need[q])):
            length = end - start + q
            if (start, length) in stretches:
                continue
            stretches.add((start, length))
            found.append((start, length, q))
            again = np.arange(2 * q, min(length, len(counts)), q)
            counts[again] -= length - again
    return sorted(found, key=lambda r: (r[0], r[2]))


def greatest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run whose period fits into it most often, exactly; ties go to the smallest start, then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: all but those behind the first period of a run."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def collapse(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, runs (array of start, length, period; by start, then period), greatest (null without runs), collapsed (the
    words outside the repetitions, joined by one space) of each row.

    Each text is worked on where it is read: nothing is shuffled, and no text is cut. A null or empty text has no words:
    no runs and an empty collapsed text. Repeated rows give a row each, an empty table none. Only `key` and `text` are
    read, so other columns cannot clash; any type of key, null too, passes through.
    """
    kind = docs.select(F.col(f"`{key}`").alias(key)).schema
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([*kind.fields, T.StructField("runs", T.ArrayType(run)), T.StructField("greatest", run), T.StructField("collapsed", T.StringType())])
    names = run.fieldNames()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        split = re.compile(WORD).findall
        for batch in batches:
            all_runs, tops, left = [], [], []
            for x in batch.column(1):
                words = split(x.as_py() or "")
                known: dict[str, int] = {}
                ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                found = runs(ids)
                top = greatest(found)
                all_runs.append([dict(zip(names, r, strict=True)) for r in found])
                tops.append(top and dict(zip(names, top, strict=True)))
                left.append(" ".join([words[i] for i in np.flatnonzero(kept(len(words), found))] if found else words))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, types.field(i + 1).type) for i, c in enumerate((all_runs, tops, left)))], schema=types)

    return few_at_once(docs).select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(work, schema)
