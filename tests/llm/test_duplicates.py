import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from sensorloom.llm import near_duplicates, substring_dedup
from sensorloom.llm.components import components


def test_near_duplicates(spark, docs, none):
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    for size in (2, 5):
        got = {r.doc_id: r for r in near_duplicates.near_duplicates(docs, size).collect()}
        want = brute.components(pairs, size, 80)
        assert {i: r.component_id for i, r in got.items()} == want
        assert all(got[i].n_shingles == len(brute.shingles(t, size)) and got[i].kept == (want[i] == i) for i, t in pairs)
    assert near_duplicates.near_duplicates(none).count() == 0


def test_near_duplicates_of_odd_rows(odd):
    out = near_duplicates.near_duplicates(odd, 2).collect()
    assert len(out) == odd.count()
    assert [r.component_id for r in out if r.doc_id == 15] == [12, 12]
    assert all(r.component_id is None for r in out if r.doc_id is None)
    assert near_duplicates.keep_one(odd).columns == odd.columns


def test_large_group_of_copies(spark):
    """Copies with differing edits: some are linked to the origin only, some to each other, some to nothing."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        words = list(base)
        for p in rng.choice(100, size=int(rng.integers(0, 9)), replace=False):
            words[p] = f"e{rng.integers(0, 30)}"
        rows.append((int(i), " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == brute.components(rows, 2, 80)


def test_words_of_equal_checksums_are_not_linked(spark):
    """Two words that any pair of CRC-32s with different start values takes for one."""
    rows = [(1, "uejgtcuo"), (2, "iiwucoup"), (3, "x uejgtcuo y"), (4, "x iiwucoup y"), (5, "x iiwucoup y")]
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (3, 2), 4: (4, 2), 5: (4, 2)}


def test_links_at_the_limit(spark):
    """Pairs just at, above and below 80 percent, of sizes up to a thousand shingles."""
    rows = []
    for k, n in enumerate((4, 8, 40, 400, 996)):
        base = [f"b{k}x{i}" for i in range(n + 1)]
        for extra in (n // 4 - 1, n // 4, n // 4 + 1):  # n of n + extra shingles in common
            rows.append((len(rows), " ".join([*base, *(f"e{k}x{extra}x{i}" for i in range(extra))])))
        rows.append((len(rows), " ".join(base)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(frame, 2).collect()} == brute.components(rows, 2, 80)


def test_one_row_of_equal_rows_stays(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "other words"), (3, "entirely new text"), (None, "q r s"), (None, "q r s"), (4, None), (4, None)]
    out = near_duplicates.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), words_a_shingle=2).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(1, "a b c d e f"), (3, "entirely new text"), (None, "q r s"), (None, "q r s"), (4, None)], key=str)


def test_registers_estimate_similarity():
    a, b = near_duplicates.multipliers(288)
    x = near_duplicates.shingle_set(" ".join(f"a{i}" for i in range(900)), 2)
    y = near_duplicates.shingle_set(" ".join(f"a{i}" for i in range(90, 990)), 2)
    agree = np.mean(near_duplicates.registers(x, a, b) == near_duplicates.registers(y, a, b))
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs(agree - true) < 0.09
    assert 0 < near_duplicates.chance_collision(np.array([900.0]), np.array([900.0]))[0] < 0.01


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(40, 41), (41, 42), (40, 42)] + [(100, k) for k in range(101, 160)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 31), 1), 40: 40, 41: 40, 42: 40, **dict.fromkeys(range(100, 160), 100)}


@pytest.mark.parametrize("length", [8, 50])
def test_substrings(docs, none, length):
    pairs = [(r.doc_id, r.text) for r in docs.collect()]
    rows = substring_dedup.remove_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in rows} == brute.without_repeats(pairs, length)
    assert substring_dedup.remove_repeats(none, length).count() == 0


def test_substrings_of_odd_rows(odd):
    out = substring_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    rows = out.collect()
    assert all(r.n_chars == len(r.text or "") for r in rows)
    assert {r.text for r in rows if r.doc_id == 15} == {""}  # a copy of document 12, twice


def test_names_do_not_depend_on_place():
    data = np.frombuffer(b"xxhello world, hello world", np.uint8)
    n = substring_dedup.names(data, 11)
    assert n[2] == n[15] and len(np.unique(n)) == len(n) - 1
