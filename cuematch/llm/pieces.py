"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model holds a space mark after another character, merges
cannot cross the start of a mark run. A text is then the chain of its chunks
(marks, then other characters), and each chunk can be segmented alone. A task
keeps a table chunk -> ids, segments each distinct chunk once, in one library
call per slice of texts, and joins the ids back by position. The table starts
anew when it reaches its bound, so memory does not grow with the text. The
joining happens inside the task: a shuffled join would send each word of each
text through the disk.

Nulls: a null text is an empty text. Any character is encoded (bytes stand in
for unknown ones); a space mark in the text counts as a space, as in the
library. Other columns are carried along untouched, whatever their names; the
result columns replace columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from cuematch.llm.words import slices, trimmed

MARK = "▁"
SLICE = 1 << 20
TABLE_CHUNKS = 150_000
LONG_CHUNK = 200
_CHUNK = re.compile(" +[^ ]*")


@lru_cache(maxsize=4)
def _load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    crossing = [p for i in range(model.get_piece_size()) if re.search(f"[^{MARK}]{MARK}", p := model.id_to_piece(i))]
    if crossing:
        raise ValueError(f"pieces cross space marks, for example {crossing[:3]}")
    if model.encode("a", out_type=str)[0][0] != MARK or model.encode("  a ") == model.encode("a"):
        raise ValueError("the model must add a space before the text and keep all spaces")
    return model


class ChunkTable:
    """ids of distinct chunks, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.model, self.ids = _load(path), {}
        self.begin = np.uint32(self.model.bos_id()).tobytes()
        self.end = np.uint32(self.model.eos_id()).tobytes()
        self.mark = np.uint32(self.model.piece_to_id(MARK)).tobytes()

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks of a text, each beginning with the spaces before it; the first gets one more."""
        return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.ids]
        # the library itself puts one space before what it encodes
        for c, ids in zip(new, self.model.encode([c[1:] for c in new], num_threads=1), strict=True):
            self.ids[c] = np.array(ids, "<u4").tobytes() if c != " " else self.mark

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.chunks(t) for t in texts]
        self.learn(set().union(*split))
        get = self.ids.__getitem__
        out = [b"".join([self.begin, *map(get, chunks), self.end]) for chunks in split]
        if len(self.ids) > TABLE_CHUNKS:
            self.ids = {}
        else:
            for c in [c for chunks in split for c in chunks if len(c) > LONG_CHUNK]:
                self.ids.pop(c, None)
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.model.decode([np.frombuffer(x, "<u4").tolist() for x in ids]) if ids else []


def _encoder(path: str, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for a, b in slices(np.concatenate(([0], np.cumsum(lengths))), SLICE):
                ids = table.encode(texts.slice(a, b - a).to_pylist())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(at)), pa.array(ids, pa.binary()), pa.array(table.decode(ids), pa.string())],
                    names=[f"c{i}" for i in range(at + 2)],
                )

    return run


def encode(docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all) with ids (binary, four bytes each, with begin and end) and decoded (text).

    ``model`` is a path every worker can read, or a file added to the session.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    n = len(keep)
    sent = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias(f"c{n}"))
    schema = StructType([*sent.schema.fields[:n], StructField(f"c{n}", BinaryType()), StructField(f"c{n + 1}", StringType())])
    out = sent.mapInArrow(trimmed(_encoder(model, n)), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate([*keep, "ids", "decoded"])])


def n_tokens(ids: Column) -> Column:
    return F.floor(F.octet_length(ids) / 4).cast("long")
