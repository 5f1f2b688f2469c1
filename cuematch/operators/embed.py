"""Texts to vectors, pooled vectors, and the vector packages of a record."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuematch import fixed_values as fv
from cuematch.functions import vectors as V
from cuematch.functions.text import strip
from cuematch.plans.storage import materialize

Encoder = Callable[[Sequence[str]], np.ndarray]
_TEXT_BYTES = 4 << 20  # of texts that are encoded at once; one text at least


@functools.lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


def hashing_encoder(dim: int = fv.VECTOR_DIM) -> Encoder:
    """Word counts hashed into ``dim`` buckets: the first 8 hex digits of MD5, modulo ``dim``.

    Words are runs of letters and digits of any script. Each distinct word of a
    batch is hashed once.
    """

    def encode(texts: Sequence[str]) -> np.ndarray:
        words = [re.findall(r"[^\W_]+", text.lower()) for text in texts]
        bucket = {w: _word_hash(w) % dim for w in set().union(*words)}
        rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        columns = np.fromiter((bucket[w] for listed in words for w in listed), np.int64, len(rows))
        return np.bincount(rows * dim + columns, minlength=len(texts) * dim).reshape(len(texts), dim).astype(float)

    return encode


_ERRORS = "array<struct<column:string,error_type:string,error:string>>"


def _try(encode: Encoder, texts: Sequence[str]) -> list[tuple[np.ndarray | None, str | None, str | None]]:
    """(unit vector, error type, error) of each text.

    A matrix of another shape is an error of the encoder as a whole and raises.
    Where the encoder itself fails, the texts are halved until the one is found.
    """
    try:
        m = np.asarray(encode(texts))
    except Exception as error:  # any model may stand behind it; the text is reported, the others go on
        if len(texts) == 1:
            return [(None, type(error).__name__, str(error)[:500])]
        half = len(texts) // 2
        return _try(encode, texts[:half]) + _try(encode, texts[half:])
    if m.ndim != 2 or len(m) != len(texts) or not m.shape[1]:
        raise ValueError(f"the encoder gave shape {m.shape} for {len(texts)} texts")
    m = m.astype(np.float64)
    norms = np.linalg.norm(m, axis=1)
    good = np.isfinite(norms) & (norms > 0)
    return [
        (m[i] / norms[i], None, None) if good[i] else (None, "NoVector", f"the encoder gave no usable vector for {texts[i][:80]!r}")
        for i in range(len(texts))
    ]


def _bounded(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts have ``_TEXT_BYTES`` at most, or are one text."""
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column))), dtype=np.int64)
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + _TEXT_BYTES, side="right")))
        yield batch.slice(first, last - first)
        first = last


def _digest(c: Column | str) -> Column:
    """What stands for a text in joins: 32 bytes, however long it is."""
    return F.unhex(F.sha2(c, 256))


def encoded_texts(texts: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """(digest, vector, error_type, error): each distinct text of the column ``text``, encoded once and stored.

    Nothing but the texts goes through Python, a bounded number of bytes at once, whatever
    the size of an Arrow batch. A text that the encoder cannot
    take has an error in place of its vector; the others are not touched by it.
    """
    encode = encoder or hashing_encoder()

    def run(batches):
        for batch in (piece for whole in batches for piece in _bounded(whole, 1)):
            found = _try(encode, batch.column(1).to_pylist())
            vectors = [None if v is None else v.astype(np.float32) for v, _kind, _text in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(vectors, pa.list_(pa.float32())),
                 pa.array([kind for _v, kind, _text in found], pa.string()), pa.array([text for _v, _kind, text in found], pa.string())],
                names=["digest", "vector", "error_type", "error"],
            )

    distinct = texts.select("text").distinct().select(_digest("text").alias("digest"), "text")
    made = distinct.mapInArrow(run, "digest binary, vector array<float>, error_type string, error string")
    return materialize(made, "encoded")


def _blank(c: str) -> Column:
    return F.coalesce(strip(F.col(c)), F.lit("")) == ""


def embed_rows(
    df: DataFrame, columns: dict[str, str], encoder: Encoder | None = None, errors: str = "encode_errors"
) -> DataFrame:
    """Add a unit vector per text column, and what went wrong as ``errors``.

    ``columns`` maps text column to vector column. ``errors`` is an array of
    (column, error_type, error), empty for a row with all its vectors; a failed
    text has a NULL vector. All columns' texts make one narrow table, in which
    each distinct text stands once; its vector goes back to the rows by the text's
    SHA-256, and whether it is blank is told before, so no text is shuffled a second time
    unless the caller reads it. With several text columns the rows are stored once under a number.
    """
    names = list(columns)
    answer = F.struct("vector", "error_type", "error")
    blank = {f"_blank_{i}": _blank(c) for i, c in enumerate(names)}
    if len(names) == 1:
        texts = df.filter(~_blank(names[0])).select(F.col(names[0]).alias("text"))
        known = encoded_texts(texts, encoder).select(F.col("digest").alias("_digest"), answer.alias("_0"))
        hashed = df.withColumns(blank).withColumn("_digest", F.when(~F.col("_blank_0"), _digest(names[0])))
        joined = hashed.join(known, "_digest", "left")
    else:
        keyed = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
        cells = F.array(*[F.struct(F.lit(i).alias("no"), F.when(~_blank(c), F.col(c)).alias("text")) for i, c in enumerate(names)])
        long = keyed.select("_row", F.inline(cells)).filter(F.col("text").isNotNull())
        known = encoded_texts(long, encoder)
        long = long.select("_row", "no", _digest("text").alias("digest"))
        one = [F.max_by(answer, F.when(F.col("no") == i, F.lit(1))).alias(f"_{i}") for i in range(len(names))]
        joined = keyed.withColumns(blank).join(long.join(known, "digest").groupBy("_row").agg(*one), "_row", "left")
    told = F.array(*[
        F.when(F.col(f"_blank_{i}"), F.struct(F.lit(c).alias("column"), F.lit("EmptyText").alias("error_type"), F.lit(f"{c} is empty").alias("error")))
        .otherwise(F.struct(F.lit(c).alias("column"), F.col(f"_{i}.error_type").alias("error_type"), F.col(f"_{i}.error").alias("error")))
        for i, c in enumerate(names)
    ])
    return joined.select(
        *df.columns,
        *[F.col(f"_{i}.vector").alias(out) for i, out in enumerate(columns.values())],
        F.filter(told, lambda e: e["error_type"].isNotNull()).cast(_ERRORS).alias(errors),
    )


def _first_error(errors: str) -> Column:
    return F.concat(F.get(errors, F.lit(0))["column"], F.lit(": "), F.get(errors, F.lit(0))["error"])


def embed_texts(df: DataFrame, columns: dict[str, str], encoder: Encoder | None = None) -> DataFrame:
    """:func:`embed_rows` for texts that must all have a vector: any error fails the job.

    The encoder gets distinct texts, some of an Arrow batch at once, and returns a matrix;
    any model can stand in.
    """
    rows = embed_rows(df, columns, encoder, "_errors")
    checked = [
        F.when(F.size("_errors") > 0, F.raise_error(_first_error("_errors"))).otherwise(F.col(out)).alias(out)
        for out in columns.values()
    ]
    return rows.select(*df.columns, *checked)


def ensemble_vector(vectors: Sequence[Column]) -> Column:
    return V.weighted_average(vectors, list(fv.ENSEMBLE_PROMPTS.values()))


def tag_vector(vectors: Sequence[Column]) -> Column:
    return V.weighted_average(vectors, fv.TAG_PROMPT_WEIGHTS)


def hybrid_vector(main: Column, tags: Column, ensemble: Column) -> Column:
    return V.weighted_average([main, tags, ensemble], list(fv.HYBRID_WEIGHTS.values()))


def _package(
    df: DataFrame, title: str, description: str, prompts: str, encoder: Encoder | None, errors: str | None
) -> DataFrame:
    kept = df.columns
    lacking = _blank(title) | _blank(description)
    main = F.concat(strip(F.col(title)), F.lit(". "), strip(F.col(description)))
    texts = df.withColumn("_main_text", F.when(~lacking, main)).withColumn("_tags_text", strip(F.col("tags_summary_en")))
    wanted = {"_main_text": "embedding_main", "_tags_text": "embedding_tags"}
    for name in fv.ENSEMBLE_PROMPTS:
        texts = texts.withColumn(f"_{name}", strip(F.col(f"{prompts}.{name}")))
        wanted[f"_{name}"] = f"_v_{name}"
    embedded = embed_rows(texts, wanted, encoder, "_errors")
    lengths = F.array_distinct(F.filter(F.array(*[F.size(v) for v in wanted.values()]), lambda n: n > 0))
    uneven = F.struct(F.lit("").alias("column"), F.lit("UnevenVectors").alias("error_type"), F.lit("vectors of unequal length").alias("error"))
    labelled = F.transform("_errors", lambda e: F.struct(
        F.ltrim(e["column"], F.lit("_")).alias("column"), e["error_type"].alias("error_type"), F.ltrim(e["error"], F.lit("_")).alias("error")
    ))
    embedded = embedded.withColumn("_errors", F.when((F.size("_errors") == 0) & (F.size(lengths) > 1), F.array(uneven)).otherwise(labelled))
    good = F.size("_errors") == 0
    if errors is None:
        good = F.when(~good, F.raise_error(_first_error("_errors")).cast("boolean")).otherwise(F.lit(True))
    whole = lambda v: F.when(good, v.cast("array<float>"))
    ensemble = ensemble_vector([F.col(f"_v_{name}") for name in fv.ENSEMBLE_PROMPTS])
    out = embedded.withColumn("embedding_clap_ensemble", whole(ensemble)).withColumn(
        "embedding_hybrid", whole(hybrid_vector(F.col("embedding_main"), F.col("embedding_tags"), F.col("embedding_clap_ensemble")))
    )
    told = [] if errors is None else [F.col("_errors").alias(errors)]
    return out.select(*kept, "embedding_main", "embedding_tags", "embedding_clap_ensemble", "embedding_hybrid", *told)


def scene_vectors(records: DataFrame, encoder: Encoder | None = None, errors: str | None = None) -> DataFrame:
    """Add the four vectors of a scene record.

    A text without a vector fails the job, or, with ``errors``, is told in that
    column (see :func:`embed_rows`); such a row lacks its two averaged vectors.
    """
    return _package(records, "theme_title_en", "description_en", "clap_prompt_ensemble", encoder, errors)


def track_vectors(contracts: DataFrame, encoder: Encoder | None = None, errors: str | None = None) -> DataFrame:
    """Add the four text vectors of a track, as :func:`scene_vectors`; the audio vector comes from :func:`mean_pool`."""
    return _package(contracts, "semantic_title_en", "description_en", "track_clap_prompt_ensemble", encoder, errors)


def tag_vectors(tags: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """(tag_no, category, name, embedding) from the three prompts of each tag."""
    listed = tags.select(
        "tag_no", "category", "name",
        *[F.get("prompts", F.lit(i)).alias(f"p{i}") for i in range(len(fv.TAG_PROMPT_TEMPLATES))],
    )
    embedded = embed_texts(listed, {f"p{i}": f"v{i}" for i in range(len(fv.TAG_PROMPT_TEMPLATES))}, encoder)
    return embedded.select(
        "tag_no", "category", "name",
        tag_vector([F.col(f"v{i}") for i in range(len(fv.TAG_PROMPT_TEMPLATES))]).cast("array<float>").alias("embedding"),
    )


def mean_pool(segments: DataFrame, key: str, vec_col: str) -> DataFrame:
    """(key, embedding, n_segments): unit mean of the vectors of each key.

    The built-in vector mean is combined map-side, so a key with very many
    segments costs one partial sum per task.
    """
    rows = segments.select(key, array_to_vector(V.doubles(F.col(vec_col))).alias("v"))
    pooled = rows.groupBy(key).agg(
        Summarizer.mean(F.col("v")).alias("mean"), F.count("*").alias("n_segments")
    )
    return pooled.select(key, V.l2_normalize(vector_to_array("mean")).alias("embedding"), "n_segments")


def score_tags(
    tracks: DataFrame, tag_vecs: DataFrame, track_vec: str = "embedding_audio", track_id: str = "id",
    limit_bytes: int = 64 << 20,
) -> DataFrame:
    """Cosine of each track with every tag, packed as ``tag_scores`` per track.

    A tag of another length than a track scores 0 with it. The tag vectors are at
    most one row per tag of the taxonomy; their size is checked before they are
    sent to the tasks. Beyond the limit they go in slices,
    and the slices' scores of a track are put together. Tracks are not shuffled
    otherwise.
    """
    from cuematch.operators.retrieval import vector_bytes

    size = vector_bytes(tag_vecs, "embedding")
    if size > limit_bytes:
        slices = -(-2 * size // limit_bytes)
        number = F.pmod(F.xxhash64("tag_no"), F.lit(slices))
        parts = [_score_some(tracks, tag_vecs.filter(number == s), track_vec, track_id) for s in range(slices)]
        joined = functools.reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.flatten(F.collect_list("tag_scores")).alias("t"))
        return joined.select("id", F.array_sort("t").alias("tag_scores"))
    return _score_some(tracks, tag_vecs, track_vec, track_id)


def _score_some(tracks: DataFrame, tag_vecs: DataFrame, track_vec: str, track_id: str) -> DataFrame:
    from cuematch.operators.retrieval import _by_width, _unit

    table = tag_vecs.select("tag_no", "category", "name", "embedding").toArrow().sort_by("tag_no")
    column = table.column("embedding").combine_chunks()
    units = {m.shape[1]: (at, _unit(m)[0]) for at, m in _by_width(column)}
    info = [table.column(c).to_pylist() for c in ("tag_no", "category", "name")]
    shared = tracks.sparkSession.sparkContext.broadcast((units, info))

    def run(batches):
        tags, (numbers, categories, names) = shared.value
        kind = pa.struct([("tag_no", pa.int32()), ("category", pa.string()), ("name", pa.string()), ("score", pa.float64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            n, k = batch.num_rows, len(numbers)
            sims = np.zeros((n, k))
            for rows, vectors in _by_width(batch.column(1)):
                if vectors.shape[1] in tags:
                    at, own = tags[vectors.shape[1]]
                    sims[np.ix_(rows, at)] = _unit(vectors)[0] @ own.T
            values = pa.StructArray.from_arrays(
                [
                    pa.array(np.tile(np.array(numbers, dtype=np.int32), n)),
                    pa.array(np.tile(np.array(categories, dtype=object), n), pa.string()),
                    pa.array(np.tile(np.array(names, dtype=object), n), pa.string()),
                    pa.array(sims.ravel()),
                ],
                fields=list(kind),
            )
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "tag_scores"])

    narrow = tracks.select(F.col(track_id).alias("id"), F.col(track_vec).alias("vec"))
    return narrow.mapInArrow(
        run, f"id {narrow.schema['id'].dataType.simpleString()}, tag_scores array<struct<tag_no:int,category:string,name:string,score:double>>"
    )
