"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

A vector's components are terms with integer weights. A block of candidates is inverted into postings (the rows with a
weight for a term, and the weights); each query, a sparse row, scatters its weight times a term's postings into a dense
array of scores, one entry for each candidate. Partition selection takes the best of a block, and the blocks' are merged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from palimp.llm import tiles

SCALE = 256
#: Queries whose score arrays a task holds at once.
AT_ONCE = 64


#: A term that more than one in so many candidates hold has its weights for all of them: adding zeros is cheaper than scattering.
DENSE = 16


def weights(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) in the smallest integers that hold them."""
    w = np.floor(SCALE * x)
    most = np.abs(w).max(initial=0)
    return w.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def postings(x: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each term the candidates that hold it (a slice of all, if many do) and their weights."""
    out = []
    for column in x.T:
        rows = np.flatnonzero(column)
        out.append((slice(None), np.ascontiguousarray(column)) if len(rows) * DENSE > len(column) else (rows, column[rows]))
    return out


def accumulate(q: np.ndarray, lists: list, n: int) -> np.ndarray:
    """Scores of n candidates for each query, in 32 bits if no sum on the way can be larger."""
    most = np.array([np.abs(w.astype(float)).max(initial=0) for _, w in lists])
    kind = np.int32 if (np.abs(q.astype(float)) @ most).max(initial=0) < 1 << 31 else np.int64
    lists, q = [(rows, w.astype(kind)) for rows, w in lists], q.astype(kind)
    score, made = np.zeros((len(q), n), kind), np.empty(n, kind)
    for own, s in zip(q, score, strict=True):
        for t in np.flatnonzero(own).tolist():
            rows, w = lists[t]
            if isinstance(rows, slice):
                s += np.multiply(w, own[t], out=made)
            elif len(w):
                s[rows] += own[t] * w
    return score


def tile():
    def best(q_ids, q, ids, x, k):
        lists = postings(x)
        place = {int(v): i for i, v in enumerate(ids)}
        who, other, score = [], [], []
        for a in range(0, len(q), AT_ONCE):
            for i, s in enumerate(accumulate(q[a : a + AT_ONCE], lists, len(ids)), a):
                own = place.get(int(q_ids[i]))
                if own is None:
                    at = tiles.select(s, ids, k)
                else:
                    rest = np.r_[0:own, own + 1 : len(s)]
                    at = rest[tiles.select(s[rest], ids[rest], k)]
                who.append(np.full(len(at), i))
                other.append(ids[at])
                score.append(s[at].astype(np.int64))
        return tuple(np.concatenate(v) if v else np.empty(0, np.int64) for v in (who, other, score))

    return best


def top_k(vectors: DataFrame, *, every: int = 50, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, <key>, score: for each row whose key is divisible by `every`, the k rows of highest integer inner
    product of floor(256 * component), ties to the smaller key.

    Null vectors and those with a null or non-finite component take no part; zero vectors do. Vectors meet only those of
    their own length. Rows that share a key count once, with the vector that comes first
    component by component; a query never finds its own key. An empty table gives an empty
    result; other columns are not read. Scores must fit 64 bits.
    """
    return tiles.search(vectors, every, k, tile, key=key, vector=vector, kind="long", zero=True, weights=weights)
