import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuematch.llm import gru, language_model, quality, secret_scan
from tests.llm import cases


# language model


def base_scores(rows: list[tuple]) -> list[tuple]:
    def tokens(text):
        return [*cases.WORD.findall((text or "").translate(cases.LOWER)), None]

    def held(doc_id):
        return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2

    counts = Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in rows:
        own = tokens(r[1])
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        out.append((r[0], len(own), sum(counts[t] > 0 for t in own), n, round(base, 6)))
    return out


def test_scores_and_both_ways_of_counting(spark):
    rows = cases.documents(copies=10)
    docs = cases.table(spark, rows)
    ways = []
    for send in (4_000_000, 0):
        out = language_model.score_texts(docs, ~language_model.held_out(F.col("doc_id")), send=send).collect()
        assert cases.ordered((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == cases.ordered(base_scores(rows))
        ways.append(sorted(round(r["score"], 4) for r in out))
    assert ways[0] == pytest.approx(ways[1], rel=1e-5)


def test_every_training_token_is_trained_on_once(spark, monkeypatch):
    seen, average = [], language_model._average

    def counted(parts, flat):
        parts = language_model.materialize(parts, "parts")
        seen.append(parts.agg(F.sum("tokens")).first()[0])
        return average(parts, flat)

    monkeypatch.setattr(language_model, "_average", counted)
    docs = cases.table(spark, cases.documents(copies=3))
    out = language_model.score_texts(docs, ~language_model.held_out(F.col("doc_id"))).collect()
    assert sum(seen) == out[0]["train_tokens"]


def test_no_training_texts_and_empty_table(spark):
    docs = cases.table(spark, [(1, "some words", "en", "s", 1), (2, None, None, None, None)])
    out = language_model.score_texts(docs, F.lit(False)).collect()
    assert cases.ordered((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in out) == [(1, 3, 0, 0), (2, 1, 0, 0)]
    assert language_model.score_texts(cases.table(spark, []), F.lit(True)).collect() == []


def parameters(seed: int = 1) -> dict:
    rng = np.random.default_rng(seed)
    p = gru.fresh(rng.integers(1, 50, gru.SHORT).astype(float), 500.0)
    return {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in p.items()}


def test_probabilities_sum_to_one():
    p, h = parameters(), np.random.default_rng(2).normal(0, 0.5, (3, gru.HIDDEN)).astype(np.float32)
    every = np.arange(gru.SHORT + 1)
    for state in h:
        logs = gru.log_probs(p, np.tile(state, (len(every), 1)), every)
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_lanes_give_the_scores_of_single_texts():
    p, rng = parameters(), np.random.default_rng(3)
    counts = np.array([1, 5, 400, 2, 33, 1, 90])
    ids = rng.integers(0, gru.SHORT + 1, counts.sum())
    together = gru.score(p, ids, counts)
    for i, s in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
        h, total, before = np.zeros((1, gru.HIDDEN), np.float32), 0.0, 0
        for t in s:  # word by word, state carried from the first to the last
            h = gru._step(p, np.array([before]), h)[0]
            total += gru.log_probs(p, h, np.array([t]))[0]
            before = int(t)
        assert together[i] == pytest.approx(total, rel=1e-4)


def test_gradient_equals_differences():
    p = {k: v.astype(np.float64) for k, v in parameters().items()}
    rng = np.random.default_rng(4)
    target, before = rng.integers(0, gru.SHORT + 1, (5, 3)), rng.integers(0, gru.SHORT + 1, (5, 3))
    mask = np.ones((5, 3), bool)
    mask[3:, 1] = False
    start = rng.normal(0, 0.3, (3, gru.HIDDEN))

    def loss(q):
        h, total = start, 0.0
        for t in range(5):
            h = gru._step(q, before[t], h)[0]
            total -= (gru.log_probs(q, h, target[t]) * mask[t]).sum()
        return total / mask.sum()

    g, _ = gru._gradient(p, before, target, mask, start)
    for k in p:
        at = np.unravel_index(np.argsort(-np.abs(g[k]).ravel())[:3], p[k].shape)
        for i in zip(*at, strict=True):
            up, down = ({**p, k: p[k].copy()} for _ in range(2))
            up[k][i] += 1e-4
            down[k][i] -= 1e-4
            assert g[k][i] == pytest.approx((loss(up) - loss(down)) / 2e-4, rel=2e-2, abs=1e-5), k


def test_probabilities_far_below_the_range_of_floats():
    p = parameters()
    p["cb"] -= 300
    p["wb"] -= 300
    every = np.arange(gru.SHORT + 1)
    logs = gru.log_probs(p, np.zeros((len(every), gru.HIDDEN), np.float32), every)
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-3)


def test_places_and_counts_of_words_with_the_same_first_bits():
    words = np.array([5, 6, 1 << 60, (1 << 60) + 1, (1 << 63) + 9, 2**64 - 1], np.uint64)
    short = [(int(words[i].astype(np.int64)), 10 + i) for i in (3, 0, 2, 5)]
    m = language_model._Model(short, 100, 6, np.zeros(0), words, 10 + np.arange(6))
    asked = np.append(words, np.array([7, 1 << 61], np.uint64))
    places = m.number(asked)
    assert places.tolist() == [1, gru.TAIL, 2, 0, gru.TAIL, 3, gru.TAIL, gru.TAIL]
    assert m.count(asked, places).tolist() == [10, 11, 12, 13, 14, 15, 0, 0]


def test_training_learns_a_pattern_and_held_out_text_gains():
    rng = np.random.default_rng(5)
    phrase = np.arange(1, 12)
    text = np.concatenate([np.roll(phrase, -rng.integers(11)) for _ in range(2000)])
    rows = text[: 20480].reshape(-1, 64)
    before = np.concatenate((np.zeros((len(rows), 1), int), rows[:, :-1]), 1)
    trainer = gru.Trainer(gru.fresh(np.bincount(text, minlength=gru.SHORT).astype(float), 1.0), 0.02)
    fresh = gru.score(trainer.p, rows[-20:].ravel(), np.full(20, 64)).mean()
    for i in range(0, 256, 64):
        trainer.batch(before[i : i + 64].T, rows[i : i + 64].T)
    for _ in range(10):
        trainer.batch(before[:256].T, rows[:256].T)
    assert gru.score(trainer.p, rows[-20:].ravel(), np.full(20, 64)).mean() > 0.7 * fresh


# quality


def test_waves_leave_no_ngrams_on_disk_and_change_nothing(spark, monkeypatch):
    from cuematch.plans import storage

    rng = random.Random(9)
    docs = cases.table(spark, [*[(i, cases.prose(rng, 400), "en", "s", 1) for i in range(12)], (None, None, None, None, None)])
    trusted = spark.createDataFrame([(i,) for i in range(12)], "doc_id long")
    scores = lambda: sorted((r["row"], r["log10_prob"]) for r in quality.classify(docs, trusted).collect())
    whole = scores()
    monkeypatch.setattr(quality, "_SMALL", -1)
    folder = storage.run_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert scores() == whole and len(whole) == 13
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert "scored" in left and not left & {"trigrams", "bigrams", "bigram-shares", "numbers"}


def test_kneser_ney_sums_to_one(spark):
    rng = random.Random(2)
    words = ["a", "b", "c", "d", "e", "f", "g", "h"]
    texts = [" ".join(rng.choices(words, weights=range(1, 9), k=rng.randint(1, 30))) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model = quality.KneserNey(quality._tables(docs))
    code = {}
    for w in [*words, "unseen", "another"]:
        code[w] = quality.word_hashes(*quality.text_bytes(quality.pa.array([w])))[0][0]
    seen = np.array([*(code[w] for w in words), quality.END], np.uint64)
    for u, v in [("a", "b"), ("h", "h"), ("unseen", "g"), ("a", "unseen"), ("unseen", "another")]:
        p = 10 ** model.log10(np.full(9, code[u]), np.full(9, code[v]), seen)
        new = 10 ** model.log10(*(np.array([code[x]]) for x in (u, v, "another")))[0]
        assert p.sum() + new == pytest.approx(1, abs=1e-4) and (p > 0).all()


def test_all_trusted_text_counts_and_joined_scores_are_the_models(spark):
    rng = random.Random(6)
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    half = [r["doc_id"] for r in trusted.where(quality._half(F.col("doc_id")) == 0).collect()]
    rows = [(i, cases.prose(rng, 20_000 if i in half else 40) + f" seldom{i}", "en", "s", 1) for i in range(60)]
    rows += [(200, f"ba seldom{half[0]} seldom{half[-1]}", "en", "s", 1), (None, None, None, None, None), rows[3], rows[3]]
    docs = cases.table(spark, rows)
    got = quality.classify(docs, trusted).collect()
    assert len(got) == len(rows)
    model = quality.KneserNey(quality._tables(docs.join(spark.createDataFrame([(i,) for i in half], "doc_id long"), "doc_id", "left_semi").select("text")))
    want = []
    for r in rows:
        u, v, w, _ = quality._sequences(*quality.text_bytes(quality.pa.array([r[1]], quality.pa.string())))
        want.append((r[0], len(w), model.log10(u, v, w).sum()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for a, b in zip(sorted(((r["doc_id"], r["n_tokens"], r["log10_prob"]) for r in got), key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-5)


def test_clean_texts_stay_and_noise_goes(spark):
    rng = random.Random(3)
    clean = [(i, cases.prose(rng, 120), "en", "s", 1) for i in range(500)]
    noise = [(1000 + i, " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in cases.prose(rng, 120).split()), "en", "s", 1) for i in range(40)]
    docs = cases.table(spark, clean + noise)
    trusted = spark.createDataFrame([(i,) for i in range(400)], "doc_id long")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs, trusted, support=20).collect()}
    assert sum(got[i] for i in range(500)) >= 495 and not any(got[1000 + i] for i in range(40))
    kept = quality.accepted(docs, trusted, support=20)
    assert kept.columns == docs.columns and kept.count() == sum(got.values())


def test_repeated_words_and_lines_go(spark):
    rng = random.Random(10)
    rows = [(i, cases.prose(rng, 120), "en", "s", 1) for i in range(400)]
    words = rows[0][1].split()
    rows += [(1000, " ".join(words[:1] * 500), "en", "s", 1), (1001, " ".join(words[:8] * 30), "en", "s", 1)]
    trusted = spark.createDataFrame([(i,) for i in range(300)], "doc_id long")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(cases.table(spark, rows), trusted).collect()}
    assert not got[1000] and not got[1001] and sum(got[i] for i in range(400)) >= 396


def test_rare_and_unlabelled_languages_have_own_limits(spark):
    rng = random.Random(9)
    prose = lambda mark, n=120: " ".join(w + mark for w in cases.prose(rng, n).split())
    rows = [(i, cases.prose(rng, 120), "en", "s", 1) for i in range(400)]
    rows += [(1000 + i, prose("x"), "rare", "s", 1) for i in range(60)]
    rows += [(2000 + i, prose("y"), "unlabelled", "s", 1) for i in range(30)] + [(3000 + i, prose("z"), None, "s", 1) for i in range(30)]
    trusted = spark.createDataFrame([(i,) for i in [*range(400), *range(1000, 1030)]], "doc_id long")
    out = quality.classify(cases.table(spark, rows), trusted).collect()
    assert all(r["keep"] and r["upper"] is None for r in out if r["lang"] in ("unlabelled", None))
    limits = {lang: {r["upper"] for r in out if r["lang"] == lang} for lang in ("en", "rare")}
    assert min(limits["rare"]) > max(limits["en"])
    assert sum(r["keep"] for r in out if r["lang"] == "rare") >= 58 and sum(r["keep"] for r in out if r["lang"] == "en") >= 396


def test_quality_of_awkward_tables(spark):
    rows = cases.documents(copies=3)
    docs = cases.table(spark, rows)
    none = spark.createDataFrame([], "doc_id long")
    out = quality.classify(docs, none).collect()
    assert len(out) == len(rows) and all(r["keep"] and r["perplexity"] is None for r in out)
    some = spark.createDataFrame([(i,) for i in range(40)] + [(None,), (3,)], "doc_id long")
    out = quality.classify(docs, some).collect()
    assert len(out) == len(rows) and all(r["perplexity"] > 0 for r in out)
    assert quality.classify(cases.table(spark, []), some).collect() == []
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, None), (4, 0, 0), (None, 1, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    assert cases.ordered(quality.trusted_ids(labels).collect()) == [(1,), (5,)]


# secrets


def planted(n: int = 60) -> tuple[list[tuple], dict]:
    rng = random.Random(8)
    hexes = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    rows, secrets = [], {}
    for i in range(n):
        parts = cases.prose(rng, 80).split(" ")
        kind = i % 6
        value = {0: hexes(40), 1: hexes(18), 2: "AKIA" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZ234567", k=16))}.get(kind)
        if value:
            secrets[i] = value
            parts.insert(40, [f'token = "{value}"', f"password={value}", value][kind])
        else:
            parts.insert(40, ["".join(rng.choices("0123456789", k=16)), "someone.42@mail8.example.com", f"https://example.com/{rng.choice('abcdef')}/report{rng.randrange(10**4)}/summary{rng.randrange(100)}.html"][kind - 3])
        rows.append((i, " ".join(parts), "en", "s", len(" ".join(parts))))
    return rows, secrets


def test_planted_secrets_are_found_and_others_left(spark):
    rows, secrets = planted()
    docs = cases.table(spark, rows)
    out = secret_scan.scan(docs).collect()
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r["doc_id"]][r["begin"] : r["begin"] + len(r["value"])] == r["value"] for r in out)
    assert {(r["doc_id"], r["value"]) for r in out if r["secret"]} == set(secrets.items())
    clean = secret_scan.redacted(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        want = texts[r["doc_id"]].replace(secrets[r["doc_id"]], secret_scan.MASK) if r["doc_id"] in secrets else texts[r["doc_id"]]
        assert (r["text"], r["n_chars"]) == (want, len(want))


def test_named_values_of_any_characters_are_candidates_and_go(spark):
    shapes = [
        ('password = "p@ssw0rd!x9"', "p@ssw0rd!x9"), ('password="Tr0ub4dor&3"', "Tr0ub4dor&3"), ("pwd: hunter2", "hunter2"), ("token =  AbCdEfGhIjKlMn", "AbCdEfGhIjKlMn"),
        ("secret => QwErTyUiOpAsDf", "QwErTyUiOpAsDf"), ("Authorization: Bearer AbCdEfGhIjKlMnOpQrSt", "AbCdEfGhIjKlMnOpQrSt"), ("passphrase: 'two w0rds, one!'", "two w0rds, one!"),
    ]
    rows, _ = planted(120)
    rng = random.Random(11)
    rows += [(1000 + i, f"{cases.prose(rng, 30)} {text} {cases.prose(rng, 30)}", "en", "s", 1) for i, (text, _) in enumerate(shapes)]
    rows += [(2000 + i, f"{cases.prose(rng, 30)} the secret: {w} was here and {cases.prose(rng, 30)}", "en", "s", 1) for i, w in enumerate(["nobody", "she", "rain", "someone"] * 5)]
    docs = cases.table(spark, rows)
    found = {(r["doc_id"], r["value"]) for r in secret_scan.candidates(docs).collect()}
    assert all((1000 + i, value) in found for i, (_, value) in enumerate(shapes))
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redacted(docs).collect()}
    texts = {r[0]: r[1] for r in rows}
    assert all(clean[1000 + i] == texts[1000 + i].replace(value, secret_scan.MASK) for i, (_, value) in enumerate(shapes))
    assert all(clean[i] == texts[i] for i in texts if i >= 2000)


def test_held_out_findings(spark):
    """A forest from labelled findings of some documents judges those of others."""
    rows, secrets = planted(240)
    found = secret_scan.candidates(cases.table(spark, rows))
    findings = found.where("doc_id < 150").withColumn("secret", F.concat_ws(" ", "doc_id", "value").isin([f"{i} {v}" for i, v in secrets.items()]).cast("int"))
    out = secret_scan.scan(cases.table(spark, rows[150:]), findings=findings).collect()
    wrong = [r for r in out if r["secret"] != (secrets.get(r["doc_id"]) == r["value"])]
    assert len(out) >= 60 and len(wrong) <= 0.05 * len(out)


def test_secret_scan_of_awkward_tables(spark):
    rows = cases.documents(copies=2) + [(None, 'token = "0123456789abcdef0123"', None, None, None)] * 2 + [(9000, "x1" * 50_000, "en", "s", 100_000)]
    docs = cases.table(spark, rows)
    out = secret_scan.scan(docs).collect()
    assert sum(r["secret"] for r in out if r["doc_id"] is None) == 2
    assert secret_scan.redacted(docs).count() == len(rows)
    many = " ".join(f"A{i:015d}" for i in range(700))
    begins = [r["begin"] for r in secret_scan.candidates(cases.table(spark, [(1, many, "en", "s", 1)])).orderBy("number").collect()]
    assert begins == [17 * i for i in range(700)]
    assert secret_scan.scan(cases.table(spark, [])).collect() == []
