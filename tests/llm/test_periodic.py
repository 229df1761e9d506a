import hashlib
import random
import zlib

import numpy as np
import pytest
from brute import WORD
from hypothesis import given, settings
from hypothesis import strategies as st
from sensorloom.llm import periodic_runs, queries


def changed(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def smallest_period(words):
    """By the failure function of the whole stretch."""
    fail = [0] * len(words)
    for i in range(1, len(words)):
        k = fail[i - 1]
        while k and words[i] != words[k]:
            k = fail[k - 1]
        fail[i] = k + (words[i] == words[k])
    return len(words) - fail[-1]


def plain_runs(words, least=12):
    """Every stretch that keeps some distance and cannot be extended, if its smallest period is that distance."""
    out = []
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p) and smallest_period(words[i : j + p]) == p:
                out.append((i, j + p - i, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is not None:
        words = changed(doc_id, words)
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def runs_in(texts):
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    rows = periodic_runs.runs_of(np.array([c for t in texts for c in t], np.int64), bounds)
    return [[(s - bounds[k], e - s, p) for t, s, e, p in rows.tolist() if t == k] for k in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=60), max_size=4))
def test_runs_equal_definition(texts):
    assert runs_in(texts) == [plain_runs(t) for t in texts]


def test_runs_in_runs_and_neighbours():
    """Runs within a longer run's period, the same word on both sides of a text's end, powers of one word."""
    inner = [1, 2] * 7 + [3]
    texts = [inner * 3, [5] * 40, [5] * 12, [5] * 11, [1, 2, 3, 4] * 3 + [9] + [4, 3, 2, 1] * 4, [7, 8] * 5 + [7], [7, 8] * 6]
    assert runs_in(texts) == [plain_runs(t) for t in texts]
    assert runs_in(texts)[1:4] == [[(0, 40, 1)], [(0, 12, 1)], []]
    rng = random.Random(1)
    for size in (1, 7, 1000):  # pairs cut anywhere
        periodic_runs.PAIRS_AT_ONCE, before = size, periodic_runs.PAIRS_AT_ONCE
        many = [[rng.randrange(2) for _ in range(rng.randrange(50))] for _ in range(20)]
        assert runs_in(many) == [plain_runs(t) for t in many]
        periodic_runs.PAIRS_AT_ONCE = before


def test_lying_hashes_are_noticed(monkeypatch):
    """With a hash that calls everything equal, the comparison of words finds the texts to do again."""
    monkeypatch.setattr(periodic_runs.Prefixes, "equal", lambda self, a, b, x, y: np.ones(len(a), bool))
    rng = random.Random(2)
    texts = [[rng.randrange(3) for _ in range(40)] for _ in range(10)] + [[1, 2] * 9]
    assert runs_in(texts) == [plain_runs(t) for t in texts]


def test_words_are_cut_at_ascii_white_space_only(spark):
    words = "x1 y z\u0085w v\u001cu".split(" ")
    text = " \t".join(words * 6) + "\n"
    row = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert [tuple(r) for r in row.runs] == [(0, 18, 3)] and row.collapsed == " ".join(words)


def test_query_equals_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len(WORD.findall(r.text or "")) < 700}
    got = {r[0]: tuple(r) for r in queries.op11_periodic_runs(spark, path).collect()}
    assert len(got) == len(docs) and len(short) > 150
    assert [got[k] for k in sorted(short)] == [plain_row(k, short[k]) for k in sorted(short)]
    assert sum(g[1] > 0 for g in got.values()) >= 10


@pytest.mark.parametrize("name", ["docs", "odd"])
def test_odd_rows(spark, request, name):
    """Nulls, empty and very long texts, repeated rows and ids, null ids, columns of clashing names."""
    table = request.getfixturevalue(name)
    rows = [(r.doc_id, r.text) for r in table.collect() if len((r.text or "").split()) < 1000]
    found = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_repeated_tails(table)))
    got = as_rows(found.where("n_runs >= 0"))
    assert len(got) == table.count()
    want = sorted((plain_row(*r) for r in rows), key=repr)
    assert [g for g in got if g in set(want)] == want


def test_empty_table(spark, none):
    found = periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_repeated_tails(none)))
    assert found.count() == 0 and found.columns[:2] == ["doc_id", "n_runs"]
