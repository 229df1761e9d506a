import json
import random

import brute
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sensorloom.llm import packing, shared, token_store, tokens

BYTE, WORD = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_library(path):
    enc = tokens.encoder(path)

    @settings(max_examples=150, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.text(alphabet="ab 'sS0é\n\t.,#ſĳÀ", max_size=40)))
    def check(text):
        assert enc.encode(text) == enc.by_library([text])[0]

    check()


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_batches_equal_library(path, texts):
    """Texts of all kinds in one batch, with pieces that must not cross from one text to the next."""
    rng = random.Random(4)
    enc, more = tokens.Encoder(path), ["ab 'sSlLrevVdmMtT0é\n,#ĳÀ", "a' \n", "ab 'st\t\n.,日"]
    rows = [t or "" for t in texts] + ["".join(rng.choice(a) for _ in range(rng.randrange(14))) for a in more for _ in range(3000)]
    ids, ends = enc.encode_batch(pa.array(rows), 7)
    assert [ids[i:j].tolist() for i, j in zip(ends[:-1], ends[1:])] == [[*x, 7] for x in enc.by_library(rows)]
    some = pa.array(["x", *rows]).slice(1, 40)  # a part of a longer array
    assert enc.encode_batch(some)[0].tolist() == [i for x in enc.by_library(rows[:40]) for i in x]


def test_other_tokenizer_files_go_to_the_library(tmp_path):
    settings = json.load(open(BYTE, encoding="utf-8"))
    settings["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "Digits", "individual_digits": True}, settings["pre_tokenizer"]]}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(settings))
    enc = tokens.Encoder(str(path))
    assert not enc.known and enc.encode("in 1984 and 2001") == enc.by_library(["in 1984 and 2001"])[0] != tokens.encoder(BYTE).encode("in 1984 and 2001")


def test_store(spark, odd, none, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(odd, path, BYTE, metadata=["lang"])
    rows = token_store.id_checksums(token_store.read_store(spark, path), "doc_id", "start", "n_tokens").collect()
    rows.sort(key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x)) and len(ids) == odd.count()
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = sorted(brute.crc(x) for x in brute.ids_by_library(BYTE, [r.text for r in odd.select("text").collect()], 0))
    assert sorted(r.ids_crc32 for r in rows) == want
    # A read of metadata alone leaves the ids untouched.
    assert spark.read.parquet(path).where("doc_id = 15").select("lang").count() == 2
    empty = str(tmp_path / "empty")
    token_store.write_store(none, empty, BYTE)
    assert token_store.read_store(spark, empty).count() == 0


def test_packing(spark, odd, none):
    cut = packing.pieces(odd, WORD, capacity=64)
    placed = packing.pack(cut, capacity=64)
    rows = placed.collect()
    texts = odd.select("text").collect()
    ids = brute.ids_by_library(WORD, [r.text for r in texts], 1)
    total = sum(map(len, ids))
    assert sum(r.length for r in rows) == total
    want = sorted((k, brute.crc(x[k * 64 : (k + 1) * 64])) for x in ids for k in range(-(-len(x) // 64)))
    assert sorted((r.piece, r.ids_crc32) for r in rows) == want
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert by.get(r.sequence_id, 0) == r.offset and r.offset + r.length <= 64
        by[r.sequence_id] = r.offset + r.length
    assert len(by) <= -(-total // 64) + 2
    unique = packing.pieces(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), WORD, capacity=64)
    assert packing.sequences(unique, packing.pack(unique, 64)).where(F.size("ids") > 64).count() == 0
    assert packing.pack(packing.pieces(none, WORD)).count() == 0


def test_plan_uses_every_piece_once():
    rng = __import__("random").Random(1)
    histogram = {rng.randint(1, 100): rng.randint(1, 5000) for _ in range(60)}
    fillings = packing.plan(dict(histogram), 100)
    used = {}
    for filling, n in fillings:
        assert sum(filling) <= 100
        for x in filling:
            used[x] = used.get(x, 0) + n
    assert used == histogram
    assert sum(n for _, n in fillings) <= 1.25 * sum(x * n for x, n in histogram.items()) / 100 + 1


def test_shared_folder_comes_from_the_session(spark):
    assert shared.shared_folder(spark)
