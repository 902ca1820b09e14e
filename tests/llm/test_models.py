"""The toxicity model and the quality score against plain Python without hashed buckets."""

from __future__ import annotations

import random
import zlib
import re
from collections import Counter

import numpy as np

from ebbflow.llm import quality, toxicity

WORDS = [f"wd{i}" for i in range(40)]


def grams(text: str) -> set[bytes]:
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return {data[i : i + k] for k in toxicity.ORDERS for i in range(len(data) - k + 1)}


def test_toxicity_scores_equal_a_plain_classifier(spark):
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(160):
        toxic = i % 3 == 0
        words = [rng.choice(WORDS) for _ in range(rng.randint(4, 10))] + (["Vile"] if toxic and i % 2 else []) + (["nasty"] if toxic else [])
        rng.shuffle(words)
        texts.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    frame, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, known, kept_back=0)
    got = {r["doc_id"]: (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0, r["__score"]) for r in toxicity.score_texts(frame, model).collect()}

    train = [i for i, _ in texts if not got[i][0]]
    y = np.array([labels[i][2] for i in train], float)
    sets = [grams(texts[i][1]) for i in train]
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    seen = {1: Counter(g for s, t in zip(sets, y, strict=True) if t for g in s), 0: Counter(g for s, t in zip(sets, y, strict=True) if not t for g in s)}
    ratio = {g: np.log(((seen[1][g] + 1) / (n1 + 2)) / ((seen[0][g] + 1) / (n0 + 2))) for g in {*seen[0], *seen[1]}}
    top = sorted(ratio)  # all of them
    x = np.array([[ratio[g] if g in s else 0.0 for g in top] for s in sets])
    # accelerated steps over dense features, until nothing changes
    w, b, step = np.zeros(len(top)), float(np.log((n1 + 1) / (n0 + 1))), 4 / ((x * x).sum(axis=1).max() + 1 + toxicity.PENALTY / len(y))
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(5000):
        wrong = 1 / (1 + np.exp(-(x @ ahead + ahead_b))) - y
        new, new_b = ahead - step * (x.T @ wrong + toxicity.PENALTY * ahead) / len(y), ahead_b - step * wrong.mean()
        grown = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, ahead_b = new + (t - 1) / grown * (new - w), new_b + (t - 1) / grown * (new_b - b)
        w, b, t = new, new_b, grown
    w = np.append(w, b)
    for i, t in texts:
        s = grams(t)
        want = 1 / (1 + np.exp(-(sum(ratio[g] * w[k] for k, g in enumerate(top) if g in s) + w[-1])))
        assert abs(got[i][1] - want) < 0.02, (i, got[i], want)  # a few n-grams share hashed buckets


def test_fitting_comes_to_the_least_loss():
    """On features of one size, the steps reach what Newton's method finds."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (200, 6)).astype(float)
    y = (rng.random(200) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 1, -2, 0.5] - 0.3)))).astype(float)

    def loss_of(v):
        odds = x @ v[:-1] + v[-1]
        wrong = 1 / (1 + np.exp(-odds)) - y
        return (np.logaddexp(0, odds) - y * odds).sum() + toxicity.PENALTY / 2 * v[:-1] @ v[:-1], np.append(x.T @ wrong + toxicity.PENALTY * v[:-1], wrong.sum())

    got = toxicity.minimise(loss_of, np.zeros(7), enough=1e-8)
    full, w, penalty = np.hstack([x, np.ones((200, 1))]), np.zeros(7), np.append(np.full(6, toxicity.PENALTY), 0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-full @ w))
        w -= np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty), full.T @ (p - y) + penalty * w)
    assert np.abs(got - w).max() < 1e-3


def test_odds_are_calibrated_on_documents_kept_back():
    rng = np.random.default_rng(4)
    odds = rng.normal(0, 3, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * odds - 1)))).astype(float)
    slope, offset = toxicity.calibrated(odds, y)
    assert abs(slope - 0.5) < 0.05 and abs(offset + 1) < 0.15
    assert toxicity.calibrated(odds, np.zeros(4000)) == (1.0, 0.0) == toxicity.calibrated(odds[:0], y[:0])
    slope, offset = toxicity.calibrated(np.array([-1e6, -2.0, 3.0]), np.array([0.0, 0.0, 1.0]))
    assert np.isfinite([slope, offset]).all() and slope > 0


def test_quality_scores_equal_plain_ratios(spark):
    rng = random.Random(12)
    texts = [(i, " ".join(rng.choice(WORDS[: 7 if i % 2 else 11]) for _ in range(rng.randint(20, 90)))) for i in range(40)] + [(98, None), (99, "one"), (3, "again the same id " * 20)]
    labels = [(i, int(i % 2), 0) for i in range(30)] + [(3, 0, 0), (None, 1, 0)]
    frame, known = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trusted = {i for i, q, _ in labels if q == 1 and i is not None}
    raw, target = Counter(), Counter()

    def ngrams(text: str | None) -> list:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return words + list(zip(words, words[1:], strict=False))

    for i, t in texts:
        raw.update(ngrams(t))
        if i in trusted:
            target.update(ngrams(t))
    scale = target.total() / raw.total()
    rows = sorted((r["doc_id"], r["n_words"], round(r["score"], 9), r["kept"]) for r in quality.judge_quality(frame, known).collect())
    want = []
    for i, t in texts:
        own = ngrams(t)
        score = sum(np.log((target[g] + quality.PRIOR) / (raw[g] * scale + quality.PRIOR)) for g in own) / max(len(own), 1)
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeat = sum(any(windows[tuple(words[j : j + 3])] > 1 for j in range(max(0, k - 2), min(k, len(words) - 3) + 1)) for k in range(len(words))) if len(words) > 2 else 0
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        want.append((i, len(words), round(float(score), 9), not failed and round(float(score), 9) >= quality.THRESHOLD))
    want.sort()
    assert [(a, b, d) for a, b, _, d in rows] == [(a, b, d) for a, b, _, d in want]
    assert max(abs(r[2] - v[2]) for r, v in zip(rows, want, strict=True)) < 1e-6


def test_toxicity_fit_does_not_depend_on_how_rows_are_dealt(spark):
    rng = random.Random(13)
    texts = [(i, " ".join(rng.choice(WORDS) for _ in range(12)) + (" vile" if i % 3 == 0 else "")) for i in range(90)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)] + [(500, 1, 1)], "doc_id long, quality int, toxic int")  # 500 has no document
    again = [*texts, *texts[:40], *[(7, f"another text {i}") for i in range(30)], (8, None)]
    a = toxicity.fit(spark.createDataFrame(texts, "doc_id long, text string").repartition(1), labels)
    b = toxicity.fit(spark.createDataFrame(texts[::-1], "doc_id long, text string").repartition(7), labels)
    assert np.allclose(a.weight, b.weight, atol=1e-5) and abs(a.bias - b.bias) < 1e-4
    sample = toxicity.labelled_sample(spark.createDataFrame(again, "doc_id long, text string"), labels).collect()
    trained = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 5]
    assert sorted(r["doc_id"] for r in sample) == trained and len({r["number"] for r in sample}) == len(trained)
    assert all(r["text"] == texts[r["doc_id"]][1] for r in sample if r["doc_id"] not in (7, 8))


def test_packed_pairs_come_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 3000):
        keys = np.sort(rng.choice(1 << 31, n, replace=False)).astype(np.int32)
        assert np.array_equal(toxicity._unpacked(toxicity._packed(keys)), keys)
