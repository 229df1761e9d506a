from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from brute import WORD
from hypothesis import given, settings
from hypothesis import strategies as st
from sensorloom.llm import mixing, queries


def plain_targets(sizes, weights, most=3):
    """The level at which sources stop: each gets level * weight or its limit, and all words are shared."""
    total = sum(sizes)
    levels = sorted({Fraction(most * s, w) for s, w in zip(sizes, weights)})
    given = lambda level: [min(Fraction(most * s), level * w) for s, w in zip(sizes, weights)]
    top = next((x for x in levels if sum(given(x)) >= total), None)
    if not total:
        return [Fraction(0)] * len(sizes)
    fixed = [Fraction(most * s, w) < top for s, w in zip(sizes, weights)]
    rest = total - sum(most * s for s, f in zip(sizes, fixed) if f)
    weight = sum(w for w, f in zip(weights, fixed) if not f)
    return [Fraction(most * s) if f else rest * w / Fraction(weight) for s, w, f in zip(sizes, weights, fixed)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60) | st.integers(0, 3000), max_size=12))
def test_shares_equal_definition(sizes):
    weights = [1 + k % 3 for k in range(len(sizes))]
    got = mixing.shares(sizes, weights, 3)
    assert got == plain_targets(sizes, weights) and sum(got) == sum(sizes)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 63, 64, 65, 1000, 4097])
def test_permutations(n):
    for key in (0, 7, 1 << 63):
        x = np.arange(n)
        y = mixing.permuted(x, np.full(n, n), np.full(n, key, np.uint64))
        assert sorted(y.tolist()) == x.tolist()
        assert (mixing.permuted(y, np.full(n, n), np.full(n, key, np.uint64), back=True) == x).all()
    if n > 60:
        assert (mixing.permuted(x, np.full(n, n), np.full(n, 1, np.uint64)) != mixing.permuted(x, np.full(n, n), np.full(n, 2, np.uint64))).any()


def checked(docs, **settings):
    """The mix of a table, held against streams of words built in plain Python."""
    mix = mixing.mix(docs, with_texts=True, **settings)
    b = settings.get("block_words", 128)
    rows = [(r.doc_id, r.source, WORD.findall(r.text or ""), r.text) for r in docs.collect()]
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(w) for _, s, w, _ in rows if s == n) for n in names]
    want = plain_targets(sizes, [1 + k % 3 for k in range(len(names))])
    assert (mix.plan.names, mix.plan.sizes, mix.plan.targets) == (names, sizes, want)
    placed = {r.row: r for r in mix.ordered.collect()}
    streams = {k: [None] * n for k, n in enumerate(sizes)}
    for r in placed.values():
        for i, w in enumerate(WORD.findall(r.text or "")):
            assert streams[r.source_no][r.pos + i] is None
            streams[r.source_no][r.pos + i] = (r.row, w)
    slots = sorted(mix.slots.collect())
    texts = {(r.shard, r.slot): r.text for r in mix.texts().collect()}
    assert set(texts) == {(s.shard, s.slot) for s in slots} and len(slots) == mix.plan.slots.sum()
    assert [s.slot for s in slots] == [k % settings.get("shard_slots", 1024) for k in range(len(slots))]
    took, words, blocks = Counter(), Counter(), defaultdict(Counter)
    for s in slots:
        part = streams[s.source_no][s.block * b : (s.block + 1) * b][: s.words]
        assert texts[s.shard, s.slot] == " ".join(w for _, w in part) and part
        took.update(row for row, _ in part)
        words[s.source_no] += len(part)
        blocks[s.source_no][s.block] += 1
    for k, t in enumerate(want):
        assert words[k] == int(t + Fraction(1, 2))
        if blocks[k]:  # passes through the source are whole before the next one starts
            n = -(-sizes[k] // b)
            assert max(blocks[k].values()) - min(blocks[k].get(i, 0) for i in range(n)) <= 1
    got = sorted((tuple(r) for r in mix.taken().collect()), key=repr)
    assert got == sorted(((r.doc_id, r.source, r["size"], sizes[r.source_no], float(want[r.source_no]), took[r.row]) for r in placed.values()), key=repr)
    assert Counter((r.doc_id, r.source, r.text) for r in placed.values()) == Counter((d, s, t) for d, s, _, t in rows)
    assert all(r[5] <= 3 * r[2] for r in got)
    return got


@pytest.mark.parametrize("settings", [{}, {"block_words": 7, "shard_slots": 16}, {"block_words": 1, "shard_slots": 5, "seed": 4}])
def test_uneven_sources(spark, settings):
    """Sources of which some reach three times their size, tiny ones, one without words, a null one."""
    size = {"a": 900, "b": 40, "c": 3, "d": 2000, None: 150, "é": 11, "Z": 0, "e": 1}
    rows, k = [], 0
    for s, n in size.items():
        for m in ([n // 3, 0, n - n // 3] if n > 20 else [n]):
            rows.append((k * 7 % 41, " ".join(f"w{k}_{i}" for i in range(m)) if m else None, s, 1))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block long")
    got = checked(docs, **settings)
    assert got == checked(docs.repartition(3), **settings)


def test_odd_rows(spark, odd):
    """Null, empty and long texts, repeated rows and ids, null ids, columns of clashing names."""
    checked(odd.withColumnsRenamed({"id": "row", "key": "slot", "start": "size", "c": "n"}), block_words=5, shard_slots=9)


def test_empty_tables(spark, none):
    assert mixing.mix(none).taken().count() == 0
    blank = spark.createDataFrame([(1, None, "s"), (2, " \n", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.mix(blank).taken().collect()) == [(1, "s", 0, 0, 0.0, 0), (2, None, 0, 0, 0.0, 0)]


def test_draws_are_multinomial(spark):
    """Shards differ from each other as independent draws do, and no source is favoured at either end."""
    rows = [(k, "w " * 64, "abcd"[k % 4]) for k in range(4000)]
    mix = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block_words=8, shard_slots=100)
    p = mix.plan.slots / mix.plan.slots.sum()
    n = mixing.draws(spark, mix.plan).toPandas().pivot_table(index="shard", columns="source_no", values="n", fill_value=0).to_numpy()
    assert len(n) == 321  # targets are no whole numbers of slots: the last shard is short
    n = n[:320]
    assert np.abs(n.mean(0) - 100 * p).max() < 1.5 and np.abs(n.var(0) / (100 * p * (1 - p)) - 1).max() < 0.35


def test_query_equals_plain_streams(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    want = checked(docs)
    got = sorted((tuple(r) for r in queries.op13_source_mix(spark, path).collect()), key=repr)
    assert got == sorted(((d, n, m, t, k) for d, _, n, m, t, k in want), key=repr)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        assert got == sorted((tuple(r) for r in queries.op13_source_mix(spark, path).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
