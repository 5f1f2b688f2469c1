"""Scores of whole texts under a gated recurrent language model learned from the corpus.

Tokens are the lower-cased words and one end per text. All training texts are
counted. The 2,047 most frequent words and the end form the short list of the
network (``gru``); a word beyond it costs its class in the network and
log((c + 1) / (n + v + 1)) within the class, over the n tokens and v words
beyond the short list, so that the probabilities sum to one with one unseen
word. A text's score carries the state from its first token to its last.

Training. Every training text gives all its tokens in segments of 64 (or one
segment in ``every``, at a phase drawn from the text's hash, and one at least).
Texts are dealt to the rounds by hash, each to one. Tasks train copies of the parameters on their segments by
truncated backpropagation (windows of 16); the copies are averaged by their
numbers of tokens, in two steps, after each round. Work and traffic grow with the
corpus.

Counts of words beyond the short list: up to ``send`` words they go to all
tasks as two arrays; beyond that, words of texts and counts meet in a shuffle.
Both give the same sums.

Nulls and edges: a null or empty text is its end token alone. A null doc_id
belongs to the training part. Rows that repeat are scored alike, each one. No
training texts: all counts are 0 and the network keeps its first parameters. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuematch.llm import gru
from cuematch.llm.words import mixed, slices, text_bytes, trimmed, word_hashes
from cuematch.plans.storage import materialize

END = np.uint64(0x7E57_0000_0000_0E0D)
SEGMENT = 64
_SEND = 4_000_000
_SCORE_BYTES = 12 << 20
_FIRST_BITS = 16  # of a word's hash, that the short list is looked up by


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts, each text's end included, and their numbers."""
    parts = [word_hashes(data, offsets[a : b + 1]) for a, b in slices(offsets)]
    words = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    return np.insert(words, np.cumsum(counts), END), counts + 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their numbers, summed over as much of the task as fits."""
    words, numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(numbers)], names=["word", "c"])

    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for a, b in slices(offsets, 4 << 20):
            new, c = np.unique(_tokens(data, offsets[a : b + 1])[0], return_counts=True)
            both, where = np.unique(np.concatenate((words, new)), return_inverse=True)
            numbers = np.bincount(where, np.concatenate((numbers, c)), len(both)).astype(np.int64)
            words = both
            if len(words) > 2_000_000:
                yield out()
                words, numbers = words[:0], numbers[:0]
    yield out()


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c): every distinct token of the texts, as a hash, and its number."""
    parts = docs.select("text").mapInArrow(trimmed(_counted), "word long, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


class _Model:
    """What every task needs: short list, parameters and totals; arrays of counts if they are sent."""

    def __init__(self, short: list[tuple[int, int]], n: int, v: int, flat: np.ndarray, words=None, counts=None):
        words_ = np.array([w for w, _ in short], np.int64).view(np.uint64)
        self.order = np.argsort(words_)
        self.short, self.ids = words_[self.order], self.order.astype(np.int16)
        self.near = np.array([c for _, c in short] + [0], np.int64)  # counts by place; TAIL has its own
        # the short list by the first bits of its words: where they begin, and where a second word has them
        starts = np.arange((1 << _FIRST_BITS) + 1, dtype=np.uint64)
        begin = np.searchsorted(self.short >> np.uint64(64 - _FIRST_BITS), starts)
        self.begin, self.several = np.minimum(begin[:-1], len(short) - 1), np.diff(begin) > 1
        inside = sum(c for _, c in short)
        self.n, self.v, self.flat, self.words, self.counts = n, v, flat, words, counts
        self.base = n + v + 1
        self.tail = max(n - inside, 0) + max(v - sum(c > 0 for _, c in short), 0) + 1

    def number(self, tokens: np.ndarray) -> np.ndarray:
        """Places in the short list, TAIL for all others."""
        first = (tokens >> np.uint64(64 - _FIRST_BITS)).astype(np.int64)
        at = self.begin[first]
        again = np.flatnonzero(self.several[first])
        at[again] = np.minimum(np.searchsorted(self.short, tokens[again]), len(self.short) - 1)
        return np.where(self.short[at] == tokens, self.ids[at], gru.TAIL)

    def count(self, tokens: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of the tokens in the training texts; ``ids`` are their places in the short list."""
        out = self.near[np.minimum(ids, len(self.near) - 1)]
        far = np.flatnonzero(ids == gru.TAIL)
        if len(self.words) and len(far):
            tokens = tokens[far]
            at = np.minimum(np.searchsorted(self.words, tokens), len(self.words) - 1)
            out[far] = np.where(self.words[at] == tokens, self.counts[at], 0)
        return out


def _segments(ids: np.ndarray, counts: np.ndarray, first: np.ndarray, every: int):
    """Inputs and targets (segments x steps) of the segments taken from each text."""
    begin = np.cumsum(counts) - counts
    number = -(-counts // SEGMENT)
    text = np.repeat(np.arange(len(counts)), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    draw = (mixed(first + counts.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
    period = np.minimum(number, every)
    take = (k - draw[text]) % period[text] == 0
    text, k = text[take], k[take]
    at = begin[text] + k * SEGMENT
    left = counts[text] - k * SEGMENT
    steps = np.arange(SEGMENT)
    where = at[:, None] + steps
    live = steps < left[:, None]
    target = np.where(live, ids[np.minimum(where, len(ids) - 1)], -1)
    before = np.where(live, ids[np.minimum(np.maximum(where - 1, 0), len(ids) - 1)], 0)
    before[:, 0] = np.where(k == 0, 0, before[:, 0])
    return before, target


def _trained(model, every: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        trainer = gru.Trainer(gru.unpacked(m.flat), rate)
        waiting: list = []

        def batch(rows: int) -> None:
            nonlocal waiting
            before, target = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            while len(target) >= rows and len(target):
                trainer.batch(before[:rows].T, target[:rows].T)
                before, target = before[rows:], target[rows:]
            waiting = [(before, target)]

        for arrow in batches:
            data, offsets = text_bytes(arrow.column(0))
            for a, b in slices(offsets):
                tokens, counts = _tokens(data, offsets[a : b + 1])
                ids = m.number(tokens)
                found = _segments(ids, counts, tokens[np.cumsum(counts) - counts], every)
                if len(found[1]):
                    waiting.append(found)
                    batch(trainer.lanes)
        if waiting and len(waiting[0][1]):
            batch(len(waiting[0][1]))
        yield _blob(gru.packed(trainer.p).astype(np.float64) * trainer.tokens, trainer.tokens)

    return run


def _blob(flat: np.ndarray, weight: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([flat.astype("<f8").tobytes()]), pa.array([weight], pa.int64())], names=["flat", "tokens"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flat, weight = None, 0
    for batch in batches:
        for x, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(x, "<f8")
            flat, weight = (part.copy() if flat is None else flat + part), weight + w
    if flat is not None:
        yield _blob(flat, weight)


def _average(parts: DataFrame, flat: np.ndarray) -> np.ndarray:
    """Weighted mean of the tasks' parameters, summed on a few executors first."""
    parts = materialize(parts, "parameters")
    groups = max(1, math.isqrt(parts.count()))
    sums = parts.repartition(groups, F.xxhash64("flat")).mapInArrow(trimmed(_summed), parts.schema)
    total, weight = np.zeros(len(flat)), 0
    for row in sums.toLocalIterator():
        total += np.frombuffer(row["flat"], "<f8")
        weight += row["tokens"]
    return (total / weight).astype(np.float32) if weight else flat


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        p = gru.unpacked(m.flat)
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in slices(offsets, _SCORE_BYTES):
                tokens, counts = _tokens(data, offsets[a : b + 1])
                ids = m.number(tokens)
                logs = gru.score(p, ids, counts) / math.log(10)
                text = np.repeat(np.arange(b - a), counts)
                base, known = np.zeros(b - a), np.zeros(b - a, np.int64)
                if m.words is not None:
                    c = m.count(tokens, ids)
                    base = np.bincount(text, np.log10((c + 1) / m.base), b - a)
                    known = np.bincount(text[c > 0], minlength=b - a)
                    far = ids == gru.TAIL
                    logs = logs + np.bincount(text[far], np.log10((c[far] + 1) / m.tail), b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(logs)],
                    names=["doc_id", "row", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, word, k): the distinct tokens of each text."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        row = batch.column(0).to_numpy()
        for a, b in slices(offsets):
            tokens, counts = _tokens(data, offsets[a : b + 1])
            text = np.repeat(np.arange(b - a), counts)
            order = np.lexsort((tokens, text))
            tokens, text = tokens[order], text[order]
            first = np.flatnonzero(np.append(True, (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])))
            k = np.diff(np.append(first, len(tokens)))
            yield pa.RecordBatch.from_arrays([pa.array(row[a:b][text[first]]), pa.array(tokens[first].view(np.int64)), pa.array(k, pa.int64())], names=["row", "word", "k"])


def _joined_sums(docs: DataFrame, counts: DataFrame, m: _Model) -> DataFrame:
    """Per distinct row: known, base and tail, by a shuffled join of words with counts."""
    spark = docs.sparkSession
    short = F.broadcast(spark.createDataFrame([(int(x),) for x in m.short.view(np.int64)], "word long").withColumn("near", F.lit(True)))
    words = docs.select("row", "text").mapInArrow(trimmed(_words), "row long, word long, k long").dropDuplicates(["row", "word"])
    c = F.coalesce("c", F.lit(0))
    joined = words.join(counts, "word", "left").join(short, "word", "left")
    far = F.col("near").isNull()
    return joined.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("known_"),
        F.sum(F.col("k") * F.log10((c + 1) / F.lit(m.base))).alias("base_"),
        F.sum(F.when(far, F.col("k") * F.log10((c + 1) / F.lit(m.tail))).otherwise(0.0)).alias("tail_"),
    )


def score_texts(docs: DataFrame, train: Column, every: int = 1, rounds: int = 2, rate: float = 0.01, send: int = _SEND) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document; ``train`` marks those to learn from."""
    spark = docs.sparkSession
    learn = docs.where(train)
    counts = materialize(token_counts(learn), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    end = int(END.astype(np.int64))
    top = counts.where(F.col("word") != end).orderBy(F.col("c").desc(), "word").limit(gru.SHORT - 1).collect()
    ends = counts.where(F.col("word") == end).agg(F.sum("c")).first()[0] or 0
    short = [(end, ends), *((r["word"], r["c"]) for r in top)]
    inside = [c for _, c in short]
    flat = gru.packed(gru.fresh(np.array(inside, float), max(n - sum(inside), 0)))
    for turn in range(rounds if n else 0):
        model = spark.sparkContext.broadcast(_Model(short, n, v, flat))
        dealt = learn.where(F.pmod(F.crc32(F.coalesce("text", F.lit("")).cast("binary")), F.lit(rounds)) == turn)
        parts = dealt.select("text").mapInArrow(trimmed(_trained(model, every, rate / (1 + turn))), "flat binary, tokens long")
        flat = _average(parts, flat)
    words = numbers = None
    if v <= send:
        table = counts.toArrow()
        words = table.column("word").to_numpy().view(np.uint64)
        order = np.argsort(words)
        words, numbers = words[order], table.column("c").to_numpy()[order]
    own = _Model(short, n, v, flat, words, numbers)
    model = spark.sparkContext.broadcast(own)
    row = F.xxhash64("doc_id", "text")
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text")
    out = sent.mapInArrow(trimmed(_scored(model)), "doc_id long, row long, n_tokens long, n_known long, base_score double, score double")
    if words is None:
        sums = _joined_sums(docs.select(row.alias("row"), "text"), counts, own)
        out = out.join(sums, "row").withColumns({"n_known": F.col("known_"), "base_score": F.col("base_"), "score": F.col("score") + F.col("tail_")})
    return out.select("doc_id", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
