"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Training. All text of one half of the trusted documents (by the hash of their
ids) gives word trigrams. Counts, continuation counts and context counts are
grouped by their words in shuffles, and joined to probabilities of seen n-grams
and weights of contexts, with three discounts per order from the counts of counts.

Scoring. Every word of every text, and its end, gets the probability of its
trigram, or the weighted one of the bigram, and so on down to unseen words. Each
seen n-gram has one number, what it adds to the log10 beyond shorter ones, so a
text's log10 is a sum over its n-grams: each text's distinct n-grams with their
multiplicities meet the numbers in a shuffle by the n-gram's hash. No part of the
model goes through the driver. Perplexity is 10 to the mean negative log10.

Waves. What is shuffled and stored at once is a share of it: words are dealt to
``_WAVES`` waves, a trigram with its shorter forms and contexts goes by its middle
word, and a wave counts, makes its numbers, adds its part to every text and deletes
its tables before the next one starts; few texts are one wave. Every wave reads all texts; n-grams travel
packed (sorted hashes as differences, texts as places in a list).

Thresholds. Trusted documents of the other half, scored like all others, give
quantiles of perplexity per language and length band (powers of four): a document
is kept up to the ``high`` quantile times ``margin``. A language's quantile is its
own median times its spread (quantile by median); the spread of n documents is
drawn towards that of all languages about their own medians with the weight of
``support`` documents, and a band's quantile in the same way towards its language's. There is no lower end: a copy of
trusted text is known to the model by heart. Repetition, which perplexity does not
see, is a second view: the number of words by that of distinct trigrams, limited by
the same quantiles (``most``).

Nulls and edges: a null or empty text has its end as only word. A null language
is a language of its own; documents of a language without trusted documents in
that half are kept. Without any trusted document everything is kept and
perplexity is null. A null doc_id is never trusted. Rows that repeat are scored
alike. Other columns may have any name and type. An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuematch.llm.rows import packed, row_hash
from cuematch.llm.words import distinct, mixed, slices, text_bytes, trimmed, word_hashes
from cuematch.plans.storage import delete, free_shuffles, materialize

_WAVES = 8     # a power of two
_SMALL = 64 << 20  # bytes of all texts that go in one wave
_PARTS = 32    # of the n-grams of a wave, one task each
_CONTEXT = np.uint64(0x6A09E667F3BCC909)  # tells a context of two words from the bigram
_CHUNK_BYTES = 4 << 20  # of texts whose n-grams are packed together
START, END = np.uint64(0x5747_0000_0000_0001), np.uint64(0x5747_0000_0000_0003)
_SEND = 2_000_000
_U = np.uint64


def _sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The two words before, the word, and its text, for every word and end."""
    words, counts = word_hashes(data, offsets)
    words = np.insert(words, np.cumsum(counts), END)
    counts = counts + 1
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    one, two = np.roll(words, 1), np.roll(words, 2)
    one[order < 1] = START
    two[order < 2] = START
    return two, one, words, text


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * _U(0x9E3779B97F4A7C15) + b)


def _shift(waves: int) -> int:
    return 65 - waves.bit_length()


def _wave(words: np.ndarray, waves: int) -> np.ndarray:
    return words >> _U(_shift(waves)) if waves > 1 else np.zeros(len(words), np.uint64)


def _trigrams(wave: int, waves: int):
    """Trigrams of the texts whose middle word is in the wave."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in slices(offsets):
                u, v, w, _ = _sequences(data, offsets[a : b + 1])
                if waves > 1:
                    own = _wave(v, waves) == wave
                    u, v, w = u[own], v[own], w[own]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v, w)], names=["u", "v", "w"])

    return run


def _seen(counts: DataFrame, c: str) -> list[int]:
    """How many n-grams were seen once, twice, three and four times."""
    return list(counts.agg(*[F.count(F.when(F.col(c) == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first())


def _discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen once to four times."""
    if not all(n):
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    out = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
    return [min(max(d, 0.05), i - 0.05) for i, d in zip((1, 2, 3), out, strict=True)]


def _discount(c: Column, d: list[float]) -> Column:
    return F.when(c == 1, F.lit(d[0])).when(c == 2, F.lit(d[1])).otherwise(F.lit(d[2]))


def _contexts(counts: DataFrame, by: list[str], c: str, d: list[float]) -> DataFrame:
    """Per context: total, and the weight that goes to the shorter n-gram."""
    col = F.col(c)
    return counts.groupBy(*by).agg(F.sum(col).alias("total"), F.sum(_discount(col, d)).alias("saved")).withColumn(
        "weight", F.col("saved") / F.col("total")
    )


def _ngram_counts(texts: DataFrame, wave: int = 0, waves: int = 1) -> tuple[DataFrame, DataFrame]:
    """Trigrams with their counts, and bigrams with the numbers of words before them; stored."""
    found = texts.select("text").mapInArrow(trimmed(_trigrams(wave, waves)), "u long, v long, w long")
    tri = materialize(found.groupBy("u", "v", "w").agg(F.count(F.lit(1)).alias("c")), "trigrams")
    return tri, materialize(tri.groupBy("v", "w").agg(F.count(F.lit(1)).alias("c")), "bigrams")


def _words(uni: DataFrame) -> tuple[DataFrame, float] | None:
    """Shares of words by the numbers of words before them, and that of an unseen word; None without words."""
    total, words = uni.agg(F.sum("c"), F.count(F.lit(1))).first()
    if not total:
        return None
    d = _discounts(_seen(uni, "c"))
    saved = uni.agg(F.sum(_discount(F.col("c"), d))).first()[0] / total
    floor = saved / (words + 1)
    return uni.select("w", ((F.col("c") - _discount(F.col("c"), d)) / F.lit(total) + F.lit(floor)).alias("p1")), floor


def _shares(tri: DataFrame, bi: DataFrame, p1: DataFrame, d3: list[float], d2: list[float]) -> dict[str, DataFrame]:
    """Probabilities of seen bigrams and trigrams and weights of contexts, keyed by words."""
    c2 = _contexts(bi, ["v"], "c", d2)
    p2 = bi.join(c2, "v").join(p1, "w")
    p2 = p2.select("v", "w", "weight", "p1", ((F.col("c") - _discount(F.col("c"), d2)) / F.col("total") + F.col("weight") * F.col("p1")).alias("p2"))
    p2 = materialize(p2, "bigram-shares")
    c3 = _contexts(tri, ["u", "v"], "c", d3)
    p3 = tri.join(c3, ["u", "v"]).join(p2.select("v", "w", "p2"), ["v", "w"])
    p3 = p3.select("u", "v", "w", "weight", "p2", ((F.col("c") - _discount(F.col("c"), d3)) / F.col("total") + F.col("weight") * F.col("p2")).alias("p3"))
    return {"p3": p3, "c3": c3.select("u", "v", "weight"), "p2": p2, "c2": c2.select("v", "weight"), "p1": p1}


def _tables(texts: DataFrame) -> dict[str, DataFrame] | None:
    """The whole model at once, for :class:`KneserNey`."""
    tri, bi = _ngram_counts(texts)
    found = _words(materialize(bi.groupBy("w").agg(F.count(F.lit(1)).alias("c")), "words"))
    if found is None:
        return None
    p1, floor = found
    floor_ = texts.sparkSession.createDataFrame([(float(floor),)], "p double")
    return _shares(tri, bi, p1, _discounts(_seen(tri, "c")), _discounts(_seen(bi, "c"))) | {"floor": floor_}


class _Lookup:
    """Values by 64-bit key, in sorted arrays."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], np.log10(value[order]).astype(np.float32)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return self.value[at], self.key[at] == key


class KneserNey:
    """A small model in one process: log10 probabilities of words after two others. ``classify`` joins instead."""

    def __init__(self, tables: dict[str, DataFrame]):
        def read(name: str, *keys: str) -> _Lookup:
            got = tables[name].toArrow()
            cols = [got.column(k).to_numpy().view(np.uint64) for k in keys]
            key = cols[0] if len(cols) == 1 else _pair(*cols[:2])
            key = _pair(key, cols[2]) if len(cols) == 3 else key
            return _Lookup(key, got.column(got.num_columns - 1).to_numpy())

        self.p3, self.c3 = read("p3", "u", "v", "w"), read("c3", "u", "v")
        self.p2, self.c2, self.p1 = read("p2", "v", "w"), read("c2", "v"), read("p1", "w")
        self.floor = float(np.log10(tables["floor"].first()[0]))

    def log10(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        p1, seen = self.p1.get(w)
        out = np.where(seen, p1, self.floor).astype(np.float64)
        weight, known = self.c2.get(v)
        out += np.where(known, weight, 0)
        p2, seen = self.p2.get(_pair(v, w))
        out = np.where(seen, p2, out)
        uv = _pair(u, v)
        weight, known = self.c3.get(uv)
        out += np.where(known, weight, 0)
        both = np.flatnonzero(known & seen)  # a seen trigram has a seen context and a seen bigram
        p3, seen = self.p3.get(_pair(uv[both], w[both]))
        out[both[seen]] = p3[seen]
        return out


_PACKED = "part int, kind int, keys binary, more binary, k binary, rows binary"


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers of eight or four bytes, compressed byte by byte of all."""
    plain = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, "zstd", asbytes=True)


def _whole(data: bytes, kind: type) -> np.ndarray:
    plain = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(plain.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _parts(key: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, first, end) of keys that are sorted by part."""
    part = key % _U(_PARTS)
    cuts = np.searchsorted(part, np.arange(_PARTS + 1, dtype=np.uint64))
    for p in range(_PARTS):
        if cuts[p] < cuts[p + 1]:
            yield p, int(cuts[p]), int(cuts[p + 1])


def _rows_of(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "kind", "keys", "more", "k", "rows"])


def _keyed(salt: np.uint64):
    """Packed keys and values of n-grams given by one to three words and a value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = [batch.column(i).to_numpy().view(np.uint64) for i in range(batch.num_columns - 1)]
            key = words[0]
            for w in words[1:]:
                key = _pair(key, w)
            key, value = key ^ salt, batch.column(batch.num_columns - 1).to_numpy()
            order = np.lexsort((key, key % _U(_PARTS)))
            key, value = key[order], value[order]
            yield _rows_of([(p, 0, _squeezed(np.diff(key[a:b], prepend=_U(0))), _squeezed(value[a:b]), None, None) for p, a, b in _parts(key)])

    return run


def _numbers(tables: dict[str, DataFrame], floor: float) -> DataFrame:
    """What each n-gram adds to the log10 of a text, beyond ``floor`` for each of its words, packed.

    A context adds its weight; a seen word, bigram or trigram adds its probability
    and takes away what its shorter forms and their weights have added.
    """
    log = lambda c: F.log10(F.col(c))
    none = _U(0)
    parts = [
        (none, tables["p1"].select("w", log("p1") - F.lit(floor))),
        (none, tables["c2"].select("v", log("weight"))),
        (none, tables["p2"].select("v", "w", log("p2") - log("weight") - log("p1"))),
        (_CONTEXT, tables["c3"].select("u", "v", log("weight"))),
        (none, tables["p3"].select("u", "v", "w", log("p3") - log("weight") - log("p2"))),
    ]
    out = None
    for salt, part in parts:
        keyed = part.toDF(*part.columns[:-1], "value").mapInArrow(trimmed(_keyed(salt)), _PACKED)
        out = keyed if out is None else out.unionAll(keyed)
    return out


def _ngrams(wave: int, waves: int):
    """Each text's distinct n-grams of the wave and how often it has them, packed; the start is the first context."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            rows = batch.column(0).to_numpy()
            for a, b in slices(offsets, _CHUNK_BYTES):
                u, v, w, text = _sequences(data, offsets[a : b + 1])
                own = _wave(w, waves) == wave
                key, owner = [w[own]], [text[own]]
                own = _wave(v, waves) == wave
                u, v, w, text = u[own], v[own], w[own], text[own]
                before = _pair(u, v)
                key += [_pair(v, w), before ^ _CONTEXT, _pair(before, w)]
                owner += [text] * 3
                if _wave(np.array([START]), waves)[0] == wave:
                    key.append(np.full(b - a, START))
                    owner.append(np.arange(b - a))
                key, owner = np.concatenate(key), np.concatenate(owner)
                order = np.lexsort((owner, key, key % _U(_PARTS)))
                key, owner = key[order], owner[order]
                first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))[: len(key)])
                k = np.diff(np.append(first, len(key))).astype(np.uint32)
                key, owner = key[first], owner[first]
                out = []
                for p, lo, hi in _parts(key):
                    met, place = np.unique(owner[lo:hi], return_inverse=True)
                    out.append((
                        p, 1, _squeezed(np.diff(key[lo:hi], prepend=_U(0))), _squeezed(place.astype(np.uint32)),
                        _squeezed(k[lo:hi]), _squeezed(rows[a:b][met]),
                    ))
                if out:
                    yield _rows_of(out)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, sum): what the n-grams of one part add to each text; a part's numbers come before its n-grams."""
    at, numbers, keys, values = None, [], None, None
    for batch in batches:
        columns = [batch.column(i) for i in range(6)]
        for i in range(batch.num_rows):
            part, kind, key, more, k, rows = (c[i].as_py() for c in columns)
            if part != at:
                at, numbers, keys = part, [], None
            key = np.cumsum(_whole(key, np.uint64), dtype=np.uint64)
            if kind == 0:
                numbers.append((key, _whole(more, np.float64)))
                continue
            if not numbers:
                continue
            if keys is None:
                keys, place = np.unique(np.concatenate([x for x, _ in numbers]), return_inverse=True)
                values = np.bincount(place, np.concatenate([x for _, x in numbers]))
                numbers[1:] = []
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            value = np.where(keys[found] == key, values[found], 0.0) * _whole(k, np.uint32)
            rows = _whole(rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(_whole(more, np.uint32), value, len(rows)))], names=["row", "sum"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with their numbers of words, ends included, and of words by distinct trigrams, in place of the texts."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(3))
        n, new = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in slices(offsets):
            u, v, w, text = _sequences(data, offsets[a : b + 1])
            n.append(np.bincount(text, minlength=b - a))
            new.append(np.bincount(distinct(_pair(_pair(u, v), w), text)[1], minlength=b - a))
        n, new = np.concatenate(n), np.concatenate(new)
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n, pa.int64()), pa.array(n / new)], names=["doc_id", "row", "lang", "n_tokens", "repetition"])


def _dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """The files of stored tables, and shuffle files that nothing refers to any more, are deleted."""
    for table in tables:
        delete(spark, table.inputFiles()[0].rsplit("/", 1)[0]) if table.inputFiles() else None
    free_shuffles(spark)


def _model(texts: DataFrame, waves: int) -> tuple[DataFrame, float, list[float], list[float]] | None:
    """Shares of words, that of an unseen word, and the discounts of trigrams and bigrams."""
    spark = texts.sparkSession
    seen3, seen2, words = [0] * 4, [0] * 4, []
    for wave in range(waves):
        tri, bi = _ngram_counts(texts, wave, waves)
        seen3 = [a + b for a, b in zip(seen3, _seen(tri, "c"), strict=True)]
        seen2 = [a + b for a, b in zip(seen2, _seen(bi, "c"), strict=True)]
        words.append(materialize(bi.groupBy("w").agg(F.count(F.lit(1)).alias("c")), "words-of-wave"))
        _dropped(spark, tri, bi)
    uni = materialize(functools.reduce(DataFrame.unionAll, words).groupBy("w").agg(F.sum("c").alias("c")), "words")
    _dropped(spark, *words)
    found = _words(uni)
    return None if found is None else (*found, _discounts(seen3), _discounts(seen2))


def _sums(rows: DataFrame, texts: DataFrame, p1: DataFrame, floor: float, d3: list[float], d2: list[float], waves: int) -> DataFrame:
    """(row, sum) of all waves: what the n-grams of each text add to its log10; stored."""
    spark = rows.sparkSession
    out = []
    for wave in range(waves):
        tri, bi = _ngram_counts(texts, wave, waves)
        tables = _shares(tri, bi, p1, d3, d2)
        own = p1.where(F.shiftrightunsigned("w", _shift(waves)) == wave) if waves > 1 else p1
        numbers = materialize(_numbers(tables | {"p1": own}, floor), "numbers")
        _dropped(spark, tri, bi, tables["p2"])
        grams = rows.select("row", "text").mapInArrow(trimmed(_ngrams(wave, waves)), _PACKED)
        dealt = numbers.unionAll(grams).repartition(_PARTS, "part").sortWithinPartitions("part", "kind")
        added = dealt.mapInArrow(trimmed(_added), "row long, sum double")
        out.append(materialize(added.groupBy("row").agg(F.sum("sum").alias("sum")), "sums"))
        _dropped(spark, numbers)
    return functools.reduce(DataFrame.unionAll, out).groupBy("row").agg(F.sum("sum").alias("sum"))


def _scored(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, row, lang, n_tokens, repetition, log10_prob of every row, by the model of ``texts``."""
    counted = materialize(rows.mapInArrow(trimmed(_counted), "doc_id long, row long, lang string, n_tokens long, repetition double"), "counted")
    texts = materialize(texts.select("text"), "training-texts")
    waves = 1 if (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= _SMALL else _WAVES
    found = _model(texts, waves)
    if found is None:
        return counted.withColumn("log10_prob", F.lit(None).cast("double"))
    p1, share, d3, d2 = found
    floor = float(np.log10(share))
    sums = _sums(rows, texts, p1, floor, d3, d2, waves)
    copies = counted.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))  # rows that repeat have added up
    each = copies.join(sums, "row", "left").select("row", (F.coalesce("sum", F.lit(0.0)) / F.col("copies")).alias("sum"))
    logs = F.round(F.col("n_tokens") * F.lit(floor) + F.col("sum"), 9)  # sums of doubles vary in the last digits with the order
    return materialize(counted.join(each, "row").select("doc_id", "row", "lang", "n_tokens", "repetition", logs.alias("log10_prob")), "scored")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_id of documents labelled good by all their rows, and never toxic."""
    each = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return each.where("q = 1 and t = 0").select("doc_id")


def _half(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(41)), F.lit(2))


def _limited(scored: DataFrame, known: DataFrame, value: str, name: str, high: float, margin: float, support: int) -> DataFrame:
    """``scored`` with the limit ``name`` of ``value`` for each row's language and band; null for a language not in ``known``."""
    at = lambda c, p: F.percentile_approx(c, p, F.lit(100_000))
    own = known.groupBy(F.col("lang").alias("_l")).agg(at(value, 0.5).alias("_mid"), at(value, high).alias("_q"), F.count(F.lit(1)).alias("_n"))
    own = materialize(own, "limits")
    spread = known.join(own, known["lang"].eqNullSafe(own["_l"])).agg(at(F.col(value) / F.col("_mid"), high)).first()[0]
    shrunk = (F.col("_n") * F.col("_q") / F.col("_mid") + F.lit(support) * F.lit(spread).cast("double")) / (F.col("_n") + support)
    own = own.select("_l", (F.col("_mid") * shrunk).alias("_own"))
    fine = known.groupBy(F.col("lang").alias("_m"), F.col("band").alias("_b")).agg(at(value, high).alias("_fine"), F.count(F.lit(1)).alias("_k"))
    out = scored.join(own, scored["lang"].eqNullSafe(own["_l"]), "left")
    out = out.join(fine, out["lang"].eqNullSafe(fine["_m"]) & (out["band"] == fine["_b"]), "left")
    k = F.coalesce("_k", F.lit(0))
    limit = (k * F.coalesce("_fine", F.lit(0.0)) + F.lit(support) * F.col("_own")) / (k + support) * F.lit(margin)
    return out.select(*scored.columns, limit.alias(name))


def classify(
    docs: DataFrame,
    trusted: DataFrame,
    high: float = 0.999,
    margin: float = 1.1,
    support: int = 100,
) -> DataFrame:
    """doc_id, row (hash of all columns), lang, n_tokens, log10_prob, perplexity, upper, repetition, most, keep of every document."""
    row = row_hash(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "lang", "text")
    first = materialize(trusted.select("doc_id").distinct().where(_half(F.col("doc_id")) == 0), "training-half")
    send = F.broadcast if first.count() <= _SEND else (lambda x: x)
    scored = _scored(rows, rows.join(send(first), "doc_id", "left_semi"))
    scored = scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("log10_prob") / F.col("n_tokens"))).withColumn(
        "band", F.floor(F.log2("n_tokens") / 2).cast("int")
    )
    known = scored.join(trusted.select("doc_id").distinct(), "doc_id", "left_semi").where(_half(F.col("doc_id")) == 1)
    out = _limited(scored, known, "perplexity", "upper", high, margin, support)
    out = _limited(out, known, "repetition", "most", high, margin, support)
    keep = F.coalesce(F.col("perplexity") <= F.col("upper"), F.lit(True)) & F.coalesce(F.col("repetition") <= F.col("most"), F.lit(True))
    return out.select("doc_id", "row", "lang", "n_tokens", "log10_prob", "perplexity", "upper", "repetition", "most", keep.alias("keep"))


def accepted(docs: DataFrame, trusted: DataFrame, **options) -> DataFrame:
    """The documents that are kept, all columns."""
    gone = materialize(classify(docs, trusted, **options).where("not keep").select("row").distinct(), "rejected")
    send = F.broadcast if gone.count() <= _SEND else (lambda x: x)
    return packed(docs).join(send(gone), "row", "left_anti").select("doc.*")
