"""The two fitted models against plain recomputations, and that held-out labels are never read."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import quality_model, toxicity


def fold(i: int | None, n: int) -> int:
    return zlib.crc32(str(i).encode()) % n if i is not None else 0


@pytest.fixture(scope="module")
def marks(rows):
    """(quality, toxic) by id."""
    ids = sorted({r[0] for r in rows if r[0] is not None})
    return {i: (int(i % 3 != 0), int(i % 4 == 1)) for i in ids}


def table(spark, marks):
    return spark.createDataFrame([(i, *m) for i, m in marks.items()], "doc_id long, quality int, toxic int")


def by_row(found) -> list[tuple]:
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["score"], r["predicted"]) for r in found.collect()), key=lambda t: (t[:2], t[3]))


def plain_isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The greatest over beginnings of the least mean over ends."""
    mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
    n = len(y)
    return np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])


def plain_quality(rows, marks) -> list[tuple]:
    x = np.array([quality_model.statistics(r[1]) for r in rows])
    folds = np.array([fold(r[0], 4) for r in rows])
    known = np.array([r[0] in marks for r in rows])
    y = np.array([float(marks[r[0]][0]) if r[0] in marks else 0.0 for r in rows])
    fit, cal = known & (folds != 2) & (folds != 3), known & (folds == 3)
    mean, sd = x[fit].mean(0), np.maximum(x[fit].std(0), 1e-6)
    rng = np.random.default_rng(quality_model.SEED)
    w = rng.normal(0, np.sqrt(2 * quality_model.GAMMA), (x.shape[1], quality_model.FEATURES))
    b = rng.uniform(0, 2 * np.pi, quality_model.FEATURES)
    z = np.hstack([np.sqrt(2 / quality_model.FEATURES) * np.cos(np.clip((x - mean) / sd, -6, 6) @ w + b), np.ones((len(x), 1))])
    penalty = quality_model.RIDGE * fit.sum() / quality_model.FEATURES
    # Ridge as least squares on rows that pull each weight to zero; the constant is hardly pulled.
    pull = np.sqrt(penalty) * np.diag([*[1.0] * quality_model.FEATURES, 1e-3])
    weights = np.linalg.lstsq(np.vstack([z[fit], pull]), np.append(y[fit], np.zeros(len(pull))), rcond=None)[0]
    raw = z @ weights
    at = np.clip(((raw + 0.5) / 2 * quality_model.BINS).astype(int), 0, quality_model.BINS - 1)
    bins = sorted(set(at[cal]))
    n = np.array([(cal & (at == k)).sum() for k in bins], dtype=float)
    good = np.array([y[cal & (at == k)].sum() for k in bins])
    rate = np.interp(raw, (np.array(bins) + 0.5) / quality_model.BINS * 2 - 0.5, plain_isotonic(good / n, n))
    score = np.clip(0.999 * rate + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)
    return sorted(((r[0] is None, r[0] or 0, bool(f == 2), s, int(s >= 0.7)) for r, f, s in zip(rows, folds, score, strict=True)), key=lambda t: (t[:2], t[3]))


def plain_features(text: str | None) -> set[int]:
    words = set(re.findall(r"\w+", (text or "").lower()))
    out = {zlib.crc32(f"w {w}".encode()) % toxicity.SPACE for w in words}
    out |= {zlib.crc32(f"{n} {w[:n]}".encode()) % toxicity.SPACE for w in words for n in toxicity.PREFIXES if len(w) > n}
    return out | {toxicity.SPACE + min(len(words).bit_length(), toxicity.SIZES - 1)}


def plain_toxicity(rows, marks) -> list[tuple]:
    training = [r for r in rows if fold(r[0], 3) != 1]
    known = {i: m[1] for i, m in marks.items() if fold(i, 3) != 1}
    prior = sum(known.values()) / len(known)
    has = [plain_features(r[1]) for r in rows]
    u = [plain_features(r[1]) for r in training]
    p = [plain_features(r[1]) for r in training if known.get(r[0]) == 1]
    count = lambda sets, f: sum(f in s for s in sets)
    words = [f for f in sorted(set().union(*p)) if f < toxicity.SPACE and count(p, f) >= max(toxicity.MIN_POSITIVE, toxicity.MIN_SHARE * len(p))]
    kept = [f for f in words if (count(p, f) / len(p)) / ((count(u, f) + 0.5) / len(u)) >= toxicity.MIN_LIFT] + [toxicity.SPACE + k for k in range(toxicity.SIZES)]
    dense = lambda sets: np.array([[float(f in s) for f in kept] + [1.0] for s in sets])
    xp, xu = dense(p), dense(u)
    theta = np.zeros(len(kept) + 1)
    theta[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, toxicity.STEPS + 1):
        sp, su = 1 / (1 + np.exp(-xp @ theta)), 1 / (1 + np.exp(-xu @ theta))
        second = -np.log(1 - su).mean() + prior * np.log(1 - sp).mean()
        slope = xu.T @ su / len(u) - prior * xp.T @ sp / len(p)
        g = prior * xp.T @ (sp - 1) / len(p) + slope if second >= 0 else -slope
        g[:-1] += toxicity.DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - toxicity.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    score = 1 / (1 + np.exp(-dense(has) @ theta))
    return sorted(((r[0] is None, r[0] or 0, fold(r[0], 3) == 1, s, int(s >= 0.7)) for r, s in zip(rows, score, strict=True)), key=lambda t: (t[:2], t[3]))


@pytest.mark.parametrize(("module", "plain", "close"), [(quality_model, plain_quality, 1e-6), (toxicity, plain_toxicity, 1e-4)])
def test_scores_equal_a_plain_recomputation(spark, docs, rows, marks, module, plain, close):
    got, want = by_row(module.score_documents(docs, table(spark, marks))), plain(rows, marks)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.array([g[3] for g in got]) == pytest.approx(np.array([w[3] for w in want]), abs=close)
    assert len({round(g[3], 4) for g in got}) > 20, "the scores tell documents apart"
    assert [g[4] for g in got] == [int(g[3] >= 0.7) for g in got]


@pytest.mark.parametrize(("module", "folds", "held_out"), [(quality_model, 4, 2), (toxicity, 3, 1)])
def test_held_out_labels_are_never_read(spark, docs, marks, module, folds, held_out):
    turned = {i: (1 - q, 1 - t) if fold(i, folds) == held_out else (q, t) for i, (q, t) in marks.items()}
    assert turned != marks
    a, b = (by_row(module.score_documents(docs, table(spark, m))) for m in (marks, turned))
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.array([x[3] for x in a]) == pytest.approx(np.array([x[3] for x in b]), abs=1e-9)


@pytest.mark.parametrize("module", [quality_model, toxicity])
def test_other_columns_are_never_read(spark, docs, marks, module):
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("else")).withColumn("score", F.lit(9.0)).withColumn("held_out", F.lit(True))
    a, b = (by_row(module.score_documents(d, table(spark, marks))) for d in (docs, other))
    assert np.array([x[3] for x in a]) == pytest.approx(np.array([x[3] for x in b]), abs=1e-9)
