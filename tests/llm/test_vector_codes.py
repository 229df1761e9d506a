import hashlib
import math
import random

import numpy as np
import pytest
from sensorloom.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def plain(rows, n_entries=64, parts=16, rounds=2):
    """The contract over Python integers; rows of (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == width * parts]
    ints = [[math.floor(256 * float(np.float32(v))) for v in r[1]] for r in kept]
    cut = [[tuple(x[p * width : (p + 1) * width]) for p in range(parts)] for x in ints]
    books = [[x[p] for x in cut[:n_entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            mine = [[] for _ in books[p]]
            for x in cut:
                mine[nearest(p, x[p])[1]].append(x[p])
            new.append([tuple(sum(v) // len(m) for v in zip(*m)) if m else c for c, m in zip(books[p], mine)])
        books = new
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    found = [[nearest(p, x[p]) for p in range(parts)] for x in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by: dict = {}
    for r, e in zip(kept, errors):
        by[r[2]] = by.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, by[r[2]], sha) for r, f, e in zip(kept, found, errors)), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert rows_of(queries.op12_vector_codes(spark, path)) == plain(rows)


def test_odd_rows(spark):
    """Nulls, NaN, infinities, other lengths, ties, repeated rows and ids, null ids and labels, clashing columns."""
    rng = random.Random(5)
    vec = lambda: [rng.randrange(-6, 6) / 8 for _ in range(32)]  # noqa: E731  # coarse, so that ties are common
    rows = [(k, vec(), rng.choice([None, 1, 2])) for k in range(150)]
    rows += [rows[3], rows[3], (None, vec(), 1), (None, vec(), None), (3, vec(), 7), (-5, [], 1), (-6, None, 1)]
    rows += [(-7, [float("nan")] * 32, 1), (-8, [math.inf] + [0.0] * 31, 1), (-9, [None] + [0.0] * 31, 1), (7, [0.5] * 16, 1), (-0, [-0.0] * 32, 2)]
    got = rows_of(vector_codes.compressed(table(spark, rows)))
    assert got == plain(rows)
    assert rows_of(vector_codes.compressed(table(spark, rows).repartition(7))) == got


@pytest.mark.parametrize("rows", [[], [(1, None, 2)], [(4, [1.0] * 16, None)], [(4, [0.3] * 16, 1)] * 90])
def test_few_rows(spark, rows):
    assert rows_of(vector_codes.compressed(table(spark, rows))) == plain(rows)


def test_no_equal_parts(spark):
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compressed(table(spark, [(1, [1.0] * 17, 1)]))


@pytest.mark.parametrize("size", [3, 300, 1 << 14, 1 << 24, 1 << 25])
@pytest.mark.parametrize("width", [1, 4, 48])
def test_screening_never_changes_a_result(size, width):
    """Integers that float32 cannot tell apart, with many near and exact ties."""
    rng = np.random.default_rng(size + width)
    entries = rng.integers(-size, size + 1, (64, width))
    entries[32:] = np.clip(entries[:32] + rng.integers(-1, 2, (32, width)), -vector_codes.LIMIT, vector_codes.LIMIT)
    x = np.concatenate([rng.integers(-size, size + 1, (300, width)), entries[rng.integers(0, 64, 300)] + rng.integers(-2, 3, (300, width))])
    codes, gaps = vector_codes.nearest(x, entries)
    exact = ((x[:, None, :] - entries[None]) ** 2).sum(2)
    assert (codes == exact.argmin(1)).all() and (gaps == exact.min(1)).all()


def test_bare_float32_would_be_wrong():
    """The cases above need the second look: the float32 minimum alone picks other entries."""
    rng = np.random.default_rng(0)
    entries = rng.integers(-(1 << 20), 1 << 20, (64, 4))
    entries[32:] = entries[:32] + 1
    x = entries[rng.integers(0, 64, 500)]
    s = (entries**2).sum(1).astype(np.float32) - 2 * (x.astype(np.float32) @ entries.astype(np.float32).T)
    assert (s.argmin(1) != vector_codes.nearest(x, entries)[0]).any()


def test_decoded_vectors_are_near(spark):
    path = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{path}/embeddings.parquet")
    books = vector_codes.train(vectors)
    coded = vector_codes.encode(vectors, books, ["vec_id"])
    back = {r[0]: np.array(r[1]) for r in vector_codes.decode(coded, books, ["vec_id"]).collect()}
    was = {r[0]: np.array(r[1]) for r in vectors.select("vec_id", "embedding").collect()}
    gaps = {r[0]: r[1] for r in coded.select("vec_id", "error").collect()}
    assert set(back) == set(was)
    rough = [abs(((back[k] - was[k]) ** 2).sum() * 65536 - gaps[k]) for k in was]
    assert max(rough) <= 0.25 * 64 + max(gaps.values()) ** 0.5 * 8 + 1
