import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailassay.llm import bpe
from mailassay.llm.common import text_bytes
from tests.llm import awkward

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_vocabulary(FILE)


@pytest.fixture(scope="module")
def judge():
    return tokenizers.Tokenizer.from_file(FILE)


def unpacked(ids):
    return np.frombuffer(ids, "<u4").tolist()


def odd_texts():
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(1, 0x250), 0xA0, 0x3000, 0x1C89, 0xA7CB, 0x20AC, 0x1F600, 0x4E00, 0x660, 0x2028, 0x1E5F1, 0x301]]
    special = "<|endoftext|>"
    return [
        *(t or "" for t in awkward.texts()),
        special, f"x{special} y{special}{special}", special[:-1], "it's  we'll\n\n  x ' 's", " " * 100 + "a", "\n \n a",
        "ab" * 300 + " cd", "aaaa" * 20, "abcabcabc" * 7,
        *("".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(500)),
        *("".join(rng.choice("etaoin") for _ in range(n)) for n in range(1, 120)),
    ]


def test_ids_are_those_of_the_library(vocabulary, judge):
    texts = odd_texts()
    found = bpe.Encoder(vocabulary).encode(texts)
    for text, ids in zip(texts, found):
        assert unpacked(ids) == judge.encode(text, add_special_tokens=False).ids


def test_pieces_and_forgotten_words_change_nothing(vocabulary, monkeypatch):
    texts = odd_texts()
    whole = bpe.Encoder(vocabulary).encode(texts)
    monkeypatch.setattr(bpe, "STRETCH", 50)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 10)
    assert bpe.Encoder(vocabulary).encode(texts) == whole
    assert [bpe.Encoder(vocabulary).encode([t])[0] for t in texts[:40]] == whole[:40]


def test_scan_and_heap_agree(vocabulary):
    """Words around the length at which the heap takes over, and words of one repeated letter."""
    encoder = bpe.Encoder(vocabulary)
    rng = random.Random(1)
    for _ in range(300):
        word = bytes(rng.choice(b"abcdeinrst ") for _ in range(rng.randint(1, 60)))
        ids, sizes = encoder.encode_short(np.frombuffer(word, np.uint8).reshape(1, -1))
        assert ids[0, : sizes[0]].tolist() == encoder.encode_long(word)


def test_a_very_long_word(vocabulary, judge):
    word = "xyz" * 60_000
    assert unpacked(bpe.Encoder(vocabulary).encode([word])[0]) == judge.encode(word, add_special_tokens=False).ids


def test_character_sets_without_the_library(monkeypatch):
    """Python's own Unicode tables give the same sets, but for characters of later versions."""
    with_library = bpe.character_sets()
    bpe.character_sets.cache_clear()
    monkeypatch.setitem(__import__("sys").modules, "tokenizers", None)
    try:
        points = [{p for low, high in ranges for p in range(low, high + 1)} for ranges in bpe.character_sets()]
    finally:
        bpe.character_sets.cache_clear()
    for ours, ranges in zip(points, with_library):
        theirs = {p for low, high in ranges for p in range(low, high + 1)}
        assert len(ours ^ theirs) < 6000 and {p for p in ours ^ theirs if p < 0x800} == set()


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"model": "dropout"}])
def test_other_kinds_are_refused(tmp_path, change):
    import json

    whole = json.load(open(FILE, encoding="utf-8"))
    if "normalizer" in change:
        whole |= change
    else:
        whole["model"]["dropout"] = 0.1
    path = tmp_path / "other.json"
    path.write_text(json.dumps(whole))
    with pytest.raises(ValueError):
        bpe.read_vocabulary(str(path))


def test_columns_on_awkward_rows(spark, vocabulary, judge):
    docs = awkward.frame(spark)
    ids = bpe.encode(spark, vocabulary)(text_bytes())
    coded = docs.withColumn("ids", ids).withColumn("decoded", bpe.decode(spark, vocabulary)(F.col("ids")))
    rows = coded.collect()
    assert len(rows) == len(awkward.rows())
    for row in rows:
        assert unpacked(row["ids"]) == judge.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["decoded"] == (row["text"] or "")
    assert coded.filter("false").count() == 0
    none = awkward.empty(spark).withColumn("ids", bpe.encode(spark, vocabulary)(text_bytes()))
    assert none.collect() == []


def test_query_against_the_library(spark, sf, judge):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = bpe.op13_contiguous_rank_array(spark, sf).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(texts)
    for row in found:
        ids = judge.encode(texts[row["doc_id"]], add_special_tokens=False).ids
        decoded = judge.decode(ids, skip_special_tokens=False)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
