import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuematch.llm import bpe
from cuematch.llm.queries import bpe_model
from tests.llm import cases

ODD = ["a", "th", "ing", "é", "é", "İ", "中", "文", "1", "!", "'", "'s", "<|endoftext|>", "<|EndOfText|>", " ", "\n", "\xa0", "\x1c",
       "\U0001f600", "ß", "́", "ΑΣ", "가", "한", "​", "="]


def library():
    return bpe.Bpe(bpe_model()).tokenizer


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=60), st.sampled_from([2, 5, 16]))
def test_pieces_joined_equal_the_library(parts, size):
    text, table = "".join(parts), bpe.Bpe(bpe_model())
    nodes = [(inside, np.frombuffer(table.piece(kind, content), "<i4")) for kind, content, inside in table.pieces(text.encode(), size)]
    got = table.concatenated(nodes).tolist() if nodes else []
    assert got == table.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("word", ["a" * 9001, "ab" * 4000, "中文" * 3000, "=" * 7001, "".join(random.Random(1).choices("etaoinshrdlu", k=20_000))])
def test_windows_grow_until_both_sides_agree(word):
    table = bpe.Bpe(bpe_model())
    nodes = [(inside, np.frombuffer(table.piece(kind, content), "<i4")) for kind, content, inside in table.pieces(word.encode(), 500)]
    assert len(nodes) > 10 and sum(inside for inside, _ in nodes) == len(nodes) - 1
    assert table.concatenated(nodes).tolist() == table.tokenizer.encode(word, add_special_tokens=False).ids


def test_tables_equal_the_library(spark):
    rows = cases.documents(copies=2) + [(2000 + i, t, None, None, 0) for i, t in enumerate(ODD)]
    rows += [(2100, "x" + "ha" * 9000 + " y", "fr", None, 1), (2101, " " * 5000, None, "s", 2), (2102, "ab" * 3000 + "<|endoftext|>" + "1" * 3000, None, None, 3)]
    out = bpe.encode(cases.table(spark, rows), bpe_model(), keep=["doc_id", "n_chars", "c0", "key"], long_bytes=2000, piece_bytes=64).collect()
    tokenizer = library()
    want = [(r[0], r[4], ids := tokenizer.encode(r[1] or "", add_special_tokens=False).ids, tokenizer.decode(ids, skip_special_tokens=False)) for r in rows]
    assert cases.ordered((r["doc_id"], r["n_chars"], r["ids"], r["decoded"]) for r in out) == cases.ordered(want)
    assert {(r["c0"], r["key"]) for r in out} == {("c0", "key")}


def test_table_starts_anew_at_its_bound(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_CHUNKS", 5)
    table, texts = bpe.Bpe(bpe_model()), [cases.prose(random.Random(i), 30).encode() for i in range(4)]
    for t in texts:
        assert np.frombuffer(table.encode([t])[0], "<i4").tolist() == library().encode(t.decode(), add_special_tokens=False).ids
    assert len(table.known) <= 30


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="word ends"):
        bpe._load(public_tokenizers.path("byte_bpe_50k.json"))


def test_map_column_and_empty_table(spark):
    rows = spark.sql("select 1L doc_id, 'a b' text, map('k', array(1)) m")
    assert bpe.encode(rows, bpe_model()).first()["m"] == {"k": [1]}
    assert bpe.encode(cases.table(spark, []), bpe_model()).collect() == []
