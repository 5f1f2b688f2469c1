import numpy as np
import pytest
import sentencepiece

from cuematch.llm import pieces
from cuematch.llm.queries import piece_model
from tests.llm import cases


def test_ids_and_texts_equal_the_library(spark):
    rows = cases.documents(copies=2)
    odd = [" ", "  ", "   a  b   ", "▁", "▁▁x", "\n\n a\n", "<s> </s> <unk> <0x41>", "a" * 3000, "é" * 500, "� 　 ﬁ", "ｗｉｄｅ"]
    rows += [(2000 + i, t, None, None, 0) for i, t in enumerate(odd)]
    out = pieces.encode(cases.table(spark, rows), piece_model(), keep=["doc_id", "n_chars", "c0"]).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = [(r[0], tuple(ids := model.encode(r[1] or "", add_bos=True, add_eos=True)), model.decode(ids)) for r in rows]
    got = [(r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded"]) for r in out]
    assert cases.ordered(got) == cases.ordered(want)
    assert {r["c0"] for r in out} == {"c0"}


def test_table_starts_anew_at_its_bound(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 5)
    table, texts = pieces.ChunkTable(piece_model()), [cases.prose(__import__("random").Random(i), 30) for i in range(4)]
    ids = [table.encode([t])[0] for t in texts]
    assert len(table.ids) <= 30 and table.decode(ids) == texts


def test_model_that_crosses_marks_is_refused():
    class Crossing:
        def get_piece_size(self):
            return 1

        def id_to_piece(self, _i):
            return "a▁b"

    pieces._load.cache_clear()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sentencepiece, "SentencePieceProcessor", lambda **_: Crossing())
        with pytest.raises(ValueError, match="cross"):
            pieces._load("any")
    pieces._load.cache_clear()


def test_empty_table(spark):
    assert pieces.encode(cases.table(spark, []), piece_model()).collect() == []
