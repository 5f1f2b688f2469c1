"""BPE encoding and decoding; long texts by tree concatenation.

The tokenizer drops white space and marks the end of a word, so a text is the
chain of its blank-free chunks and each chunk can be encoded alone. A task keeps
a bounded table chunk -> ids, so that a chunk that returns is not encoded again.

A text of more than ``long_bytes`` becomes pieces, which are rows that any task
may encode. Pieces end at blanks where there are any. A run without a blank is
normalised and split into words as the tokenizer does, and a word longer than a
piece is cut anywhere: its pieces are encoded as if each were a word, and a tree
of ``FAN`` nodes per step joins them. At each join the tokens beside the cut are
encoded again in a window, which grows to either side until its first token is
the left side's token at that place, and until it meets a token of the right
side. Byte pair merges taken by rank, then from the left, give a sequence of
tokens exactly if each two neighbours are what their own text is encoded to; all
neighbours of the joined sequence were neighbours in one of the three encodings,
none of them at an end that is not the word's, so it is the encoding of the whole.

Nulls: a null text is an empty text and has no ids. Texts of blanks have none
either. Very long texts are cut, never shortened. Strings of the special tokens
in a text count as those tokens, as in the library. Other columns are carried
along untouched, whatever their names or types; the result columns replace
columns of the same name. Rows that repeat are encoded each. An empty table
gives no rows.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from cuematch.llm.words import slices, trimmed
from cuematch.plans.storage import materialize

SLICE = 1 << 20
TABLE_CHUNKS = 400_000
LONG_CHUNK = 200
FAN = 16
WINDOW = 8
END = "</w>"
_BLANK = re.compile(rb"[ \t\n\r\x0b\x0c]")


@lru_cache(maxsize=4)
def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("end_of_word_suffix") != END or model.get("ignore_merges"):
        raise ValueError("the tokenizer must be plain BPE that marks word ends")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    sample = ["a", "'s", "1", "!", "é", "'"]
    if tokenizer.encode(" \n".join(sample), add_special_tokens=False).ids != [
        i for s in sample for i in tokenizer.encode(s, add_special_tokens=False).ids
    ]:
        raise ValueError("the tokenizer must drop white space")
    return tokenizer


class Bpe:
    """Encodes texts, pieces of texts and joins of pieces."""

    def __init__(self, path: str):
        self.tokenizer = _load(path)
        self.known: dict[bytes, bytes] = {}
        found = self.tokenizer.get_added_tokens_decoder()
        self.added, added = set(found), [t.content for t in found.values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._tokens: list[str] | None = None

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """ids of whole texts, as little-endian 32-bit numbers."""
        split = [t.split() for t in texts]
        new = [c for c in set().union(*split) if c not in self.known]
        for c, ids in zip(new, self._batch([c.decode() for c in new]), strict=True):
            self.known[c] = np.array(ids, "<i4").tobytes()
        get = self.known.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in split]
        if len(self.known) > TABLE_CHUNKS:
            self.known = {}
        else:
            for c in [c for c in new if len(c) > LONG_CHUNK]:
                del self.known[c]
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        numbers = [np.frombuffer(x, "<i4").tolist() for x in ids]
        return self.tokenizer.decode_batch(numbers, skip_special_tokens=False) if ids else []

    def pieces(self, text: bytes, size: int) -> Iterator[tuple[str, str, bool]]:
        """Kind (text, words or part), content, and whether it goes on with the word of the piece before."""
        at = 0
        while at < len(text):
            cut = text[at : at + size].rsplit(None, 1)
            if at + size >= len(text):
                end = len(text)
            elif len(cut) == 2:
                end = at + len(text[at : at + size]) - len(text[at : at + size].lstrip()) + len(cut[0].lstrip())
            elif not cut:
                end = at + size  # blanks alone
            else:
                first = at + size - len(text[at : at + size].lstrip())
                found = _BLANK.search(text, first)
                end = found.start() if found else len(text)
                if end - first > size:
                    yield from self._run(text[first:end].decode(), size)
                    at = end
                    continue
            yield "text", text[at:end].decode(), False
            at = end

    def _run(self, run: str, size: int) -> Iterator[tuple[str, str, bool]]:
        """Pieces of a run without blanks."""
        for part in self.special.split(run) if self.special else [run]:
            if self.special and self.special.fullmatch(part):
                yield "text", part, False
                continue
            normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
            held, length = [], 0
            for word, _place in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                if held and length + len(word) > size:
                    yield "words", " ".join(held), False
                    held, length = [], 0
                if len(word) <= size:
                    held.append(word)
                    length += len(word)
                    continue
                for i in range(0, len(word), size):
                    yield "part", word[i : i + size], i > 0
            if held:
                yield "words", " ".join(held), False

    def word(self, word: str) -> list[int]:
        """ids of one word, given in the model's own letters."""
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def piece(self, kind: str, content: str) -> bytes:
        if kind == "text":
            return self.encode([content.encode()])[0]
        words = [content] if kind == "part" else content.split(" ")
        return np.array([i for w in words for i in self.word(w)], "<i4").tobytes()

    @property
    def tokens(self) -> list[str]:
        if self._tokens is None:
            self._tokens = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        return self._tokens

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """ids of a word and what is around it, of whose two sides the first ends and the second begins within the word."""
        token = self.tokens
        first = len(left) - 1
        while first > 0 and not token[left[first - 1]].endswith(END) and left[first - 1] not in self.added:
            first -= 1
        stop = 1
        while not token[right[stop - 1]].endswith(END):
            stop += 1
        back = ahead = WINDOW
        while True:
            a, b = max(first, len(left) - back), min(stop, ahead)
            before = "".join(token[i] for i in left[a:]).removesuffix(END)
            after = [token[i].removesuffix(END) if n == stop - 1 else token[i] for n, i in enumerate(right[:b])]
            found = np.array(self.word(before + "".join(after)), "<i4")
            if a > first and (len(found) < 2 or found[0] != left[a]):
                back *= 2
                continue
            if b == stop:
                return np.concatenate([left[:a], found, right[b:]])
            place = np.cumsum([0, *(len(token[i]) for i in found[:-1])])  # the last one ends where the window does
            other = len(before) + np.cumsum([0, *(len(x) for x in after[:-1])])
            _same, i, j = np.intersect1d(place[:-1], other, assume_unique=True, return_indices=True)
            meets = np.flatnonzero(found[i] == right[j])
            if len(meets):
                return np.concatenate([left[:a], found[: i[meets[0]]], right[j[meets[0]] :]])
            ahead *= 2

    def concatenated(self, nodes: list[tuple[bool, np.ndarray]]) -> np.ndarray:
        """Nodes in order, as (goes on with the word before, ids), joined in pairs until one is left."""
        while len(nodes) > 1:
            pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
            nodes = [
                p[0] if len(p) == 1 else (p[0][0], self.joined(p[0][1], p[1][1]) if p[1][0] else np.concatenate([p[0][1], p[1][1]]))
                for p in pairs
            ]
        return nodes[0][1]


def _lists(ids: list[bytes]) -> pa.ListArray:
    sizes = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _batch(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])


def _encoder(path: str, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for a, b in slices(np.concatenate(([0], np.cumsum(lengths))), SLICE):
                ids = bpe.encode(texts.slice(a, b - a).to_pylist())
                part = batch.slice(a, b - a)
                yield _batch([*(part.column(i) for i in range(at)), _lists(ids), pa.array(bpe.decode(ids), pa.string())])

    return run


def _cutter(path: str, at: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of the long texts, numbered; the other columns stay with the first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        for batch in batches:
            for r in range(len(batch)):
                row, first, found = batch.slice(r, 1), True, []
                for piece in bpe.pieces(row.column(at).cast(pa.large_binary())[0].as_py(), size):
                    found.append(piece)
                    if len(found) == FAN:
                        yield _pieces(row, at, found, first)
                        found, first = [], False
                if found:
                    yield _pieces(row, at, found, first)

    def _pieces(row: pa.RecordBatch, at: int, found: list[tuple[str, str, bool]], first: bool) -> pa.RecordBatch:
        take = pa.array([0 if first and i == 0 else None for i in range(len(found))], pa.int64())
        kind, content, inside = zip(*found, strict=True)
        return _batch([
            pa.repeat(row.column(at + 1)[0], len(found)), pa.array([x is not None for x in take.to_pylist()]),
            *(row.column(i).take(take) for i in range(at)), pa.array(kind, pa.string()), pa.array(content, pa.string()), pa.array(inside),
        ])

    return run


def _piece_encoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        for batch in batches:
            key, node, inside, kind, content = batch.columns
            ids = [bpe.piece(k.as_py(), c.as_py()) for k, c in zip(kind, content, strict=True)]
            yield pa.RecordBatch.from_arrays([key, node, inside, _lists(ids)], names=["key", "node", "inside", "ids"])

    return run


def _joiner(path: str) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("node").combine_chunks()
        inside = group.column("inside").to_pylist()
        nodes = [(x, group.column("ids")[i].values.to_numpy()) for i, x in enumerate(inside)]
        whole = Bpe(path).concatenated(nodes)
        return pa.table({
            "key": group.column("key")[:1], "node": pa.array([group.column("node")[0].as_py() // FAN]),
            "inside": pa.array([nodes[0][0]]), "ids": _lists([whole.tobytes()]),
        })

    return run


def _decoder(path: str, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(path)
        for batch in batches:
            for r in range(len(batch)):
                row = batch.slice(r, 1)
                ids = row.column(at).flatten().to_numpy().astype("<i4").tobytes()
                yield _batch([*row.columns, pa.array(bpe.decode([ids]), pa.string())])

    return run


def encode(
    docs: DataFrame, model: str, text: str = "text", keep: list[str] | None = None, long_bytes: int = 1 << 16, piece_bytes: int = 1 << 15
) -> DataFrame:
    """The columns ``keep`` (default: all) with ids (array of int, no special tokens added) and decoded (text).

    ``model`` is a path every worker can read, or a file added to the session.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "decoded")]
    n = len(keep)
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    sent = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], content.alias(f"c{n}"))
    is_long = F.octet_length(f"c{n}") > long_bytes
    kept = [StructField(f.name, f.dataType) for f in sent.schema.fields[:n]]
    ids, decoded = StructField(f"c{n}", ArrayType(IntegerType())), StructField(f"c{n + 1}", StringType())
    schema = StructType([*kept, ids, decoded])
    out = sent.where(~is_long).mapInArrow(trimmed(_encoder(model, n)), schema)

    cut_schema = StructType.fromDDL("k long, first boolean")
    renamed = [StructField(f"x{i}", f.dataType) for i, f in enumerate(kept)]
    cut_schema = StructType([*cut_schema.fields, *renamed, *StructType.fromDDL("kind string, content string, inside boolean").fields])
    keyed = sent.where(is_long).withColumn("k", F.monotonically_increasing_id())
    wanted = [f.name for f in cut_schema.fields]
    names = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(cut_schema.fields)])
    cut = keyed.mapInArrow(trimmed(_cutter(model, n, piece_bytes)), names).toDF(*wanted)
    # pieces of a text come from one task in order, and the task's rows are numbered upwards
    cut = materialize(cut.withColumn("at", F.monotonically_increasing_id()), "bpe-pieces")
    firsts = cut.where("first").select("k", F.col("at").alias("start"), *[F.col(f"x{i}").alias(f"c{i}") for i in range(n)])
    nodes = cut.join(firsts.select("k", "start"), "k").select(
        F.col("k").alias("key"), (F.col("at") - F.col("start")).alias("node"), "inside", "kind", "content"
    )
    most = nodes.agg(F.max("node")).first()[0]
    if most is None:
        return _named(out, keep)
    form = "key long, node long, inside boolean, ids array<int>"
    tree = nodes.repartition("key", "node").mapInArrow(trimmed(_piece_encoder(model)), form)
    while most > 0:
        tree = tree.groupBy("key", F.floor(F.col("node") / FAN)).applyInArrow(_joiner(model), form)
        most //= FAN
    whole = firsts.join(tree.withColumnRenamed("key", "k"), "k").select(*[f"c{i}" for i in range(n)], F.col("ids").alias(f"c{n}"))
    return _named(out.unionByName(whole.mapInArrow(trimmed(_decoder(model, n)), schema)), keep)


def _named(out: DataFrame, keep: list[str]) -> DataFrame:
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate([*keep, "ids", "decoded"])])
