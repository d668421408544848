"""Pairing equals the sequential greedy over all pairs, in small groups and in large ones, whatever the lists and tiles are."""

import difflib
import random

import pytest

from palimp.operators import pairing


def sequential(a, b):
    """All pairs by score, i and j, from the largest; then what is left."""
    out = {}
    for g in {r[0] for r in a} | {r[0] for r in b}:
        left, right = [r for r in a if r[0] == g], [r for r in b if r[0] == g]
        ranked = sorted(((difflib.SequenceMatcher(None, x or "", y or "").quick_ratio(), i, j) for _, i, x in left for _, j, y in right), reverse=True)
        used_i, used_j, rows = set(), set(), []
        for s, i, j in ranked:
            if i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                rows.append((i, j, s))
        rows += [(i, None, None) for _, i, _ in sorted(left, key=lambda r: r[1]) if i not in used_i] + [(None, j, None) for _, j, _ in sorted(right, key=lambda r: r[1]) if j not in used_j]
        out |= {(g, n): r for n, r in enumerate(rows, 1)}
    return out


def texts(rng, g, n, sizes=(0, 3, 10, 50, 200)):
    return [(g, i, None if rng.random() < 0.05 else "".join(rng.choice("abcdefgé ") for _ in range(rng.choice(sizes)))) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"small": 0, "keep": 4, "tile": 16}])
def test_equals_sequential(spark, settings):
    rng = random.Random(4)
    a = texts(rng, 1, 7) + texts(rng, 3, 40) + texts(rng, 4, 20) + [(6, k, "x") for k in range(3)]
    b = texts(rng, 1, 9) + texts(rng, 2, 3) + texts(rng, 3, 35) + texts(rng, 4, 20) + [(6, 0, "x")]
    got = pairing.paired(spark.createDataFrame(a, "g int, i int, x string"), spark.createDataFrame(b, "g int, j int, y string"), ["g"], **settings)
    assert {(r["g"], r["documento"]): (r["i"], r["j"], r["score"]) for r in got.collect()} == sequential(a, b)


def test_a_large_group(spark):
    """400 x 400 texts with near copies on the other side: more pairs than one task takes."""
    rng = random.Random(8)
    a = texts(rng, 1, 400, (20, 60, 150, 400))
    b = [(1, j, (x or "") + rng.choice(["", "z", "zz"])) for j, (_, _, x) in enumerate(rng.sample(a, 400))]
    got = pairing.paired(spark.createDataFrame(a, "g int, i int, x string"), spark.createDataFrame(b, "g int, j int, y string"), ["g"])
    assert {(r["g"], r["documento"]): (r["i"], r["j"], r["score"]) for r in got.collect()} == sequential(a, b)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "g int, i int, x string"), spark.createDataFrame([], "g int, j int, y string")
    assert pairing.paired(*none, ["g"]).collect() == []
