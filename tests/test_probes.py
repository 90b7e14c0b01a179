"""Probes against plain numpy that fits every model from its own rows."""

import numpy as np
import pytest

from reviewlake.operators import probes, ranking


def ridge(x, y, alpha):
    mean, std = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return lambda q: (q - mean) / std @ w + y.mean()


@pytest.mark.parametrize("link", ["sigmoid", "clip", "none"])
def test_alphas_by_absolute_error(spark, link):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 12))
    y = 1 / (1 + np.exp(-(x[:, 0] - x[:, 3] + rng.normal(size=160))))
    y[:8] = rng.random(8)  # a few that squared and absolute errors weigh differently
    alphas = [0.1, 30.0, 300.0]
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, y double").repartition(5)
    out, chosen = probes.nested_ridge(ranking.with_fold(df, "id", 4, 1), "id", "v", "y", "fold", alphas, 3, link, 7)
    rows = {r["id"]: r for r in out.collect()}
    fold = np.array([rows[i]["fold"] for i in range(160)])
    inner = {r["id"]: r["i"] for r in ranking.with_fold(df, "id", 3, 130, name="i").collect()}
    inner = np.array([inner[i] for i in range(160)])
    t = np.log(np.clip(y, 1e-4, 1 - 1e-4) / (1 - np.clip(y, 1e-4, 1 - 1e-4))) if link == "sigmoid" else y
    back = {"sigmoid": lambda p: 1 / (1 + np.exp(-np.clip(p, -50, 50))), "clip": lambda p: np.clip(p, 0, 1), "none": lambda p: p}[link]
    for k in range(4):
        loss = []
        for a in alphas:
            mae = []
            for i in range(3):
                fit, val = (fold != k) & (inner != i), (fold != k) & (inner == i)
                mae.append(np.abs(back(ridge(x[fit], t[fit], a)(x[val])) - y[val]).mean())
            loss.append(np.mean(mae))
        assert chosen[k] == alphas[int(np.argmin(loss))]
        p = back(ridge(x[fold != k], t[fold != k], chosen[k])(x[fold == k]))
        assert np.allclose(p, [rows[i]["prediction"] for i in np.flatnonzero(fold == k)])


def logistic(z, y, weight, c=1.0):
    z = np.column_stack([z, np.ones(len(z))])
    b, keep = np.zeros(z.shape[1]), np.append(np.full(z.shape[1] - 1, 1 / c), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -50, 50)))
        b = b - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9), z.T @ (weight * (p - y)) + keep * b)
    return b


def test_leave_one_out_with_components_of_the_other_rows(spark):
    rng = np.random.default_rng(4)
    n, d, names = 21, 16, [f"s{k}" for k in range(10)]
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 5, d)
    scores = x[:, :10] + rng.normal(size=(n, 10))
    scores[:, 9] = np.append(np.zeros(n - 1), -1.0)  # one row below the median: its probe sees one class
    df = spark.createDataFrame([(f"e{i}", v.tolist(), *map(float, s)) for i, (v, s) in enumerate(zip(x, scores))], "id string, v array<double>, " + ", ".join(f"{k} double" for k in names)).repartition(3)
    got = {(r["id"], r["dim"]): (r["truth"], r["said"]) for r in probes.loo_pca_predictions(df, "id", "v", names).collect()}
    assert len(got) == n * 10
    close = 0
    for k, name in enumerate(names):
        y = scores[:, k] >= np.median(scores[:, k])
        for i in range(n):
            keep = np.arange(n) != i
            a, b = x[keep], y[keep]
            if b.all() or not b.any():
                want = bool(b[0])
            else:
                mean, std = a.mean(0), a.std(0)
                z = (a - mean) / std
                turn = np.linalg.svd(z - z.mean(0), full_matrices=False)[2][:8].T
                w = np.where(b, len(b) / (2 * b.sum()), len(b) / (2 * (~b).sum()))
                beta = logistic(z @ turn, b.astype(float), w)
                score = np.append((x[i] - mean) / std @ turn, 1.0) @ beta
                want = bool(score >= 0)
                close += abs(score) < 1e-6
            assert got[f"e{i}", name] == (bool(y[i]), want)
    assert close == 0
    f1 = {r["group"]: r["f1"] for r in probes.loo_pca_f1(df, "id", "v", names, {k: "a" if k < "s5" else "b" for k in names}).collect()}
    for group in "ab":
        some = [v for (i, k), v in got.items() if ("a" if k < "s5" else "b") == group]
        tp, wrong = sum(t and s for t, s in some), sum(t != s for t, s in some)
        assert abs(f1[group] - 2 * tp / (2 * tp + wrong)) < 1e-12


def test_variants_against_their_anchors(spark):
    rng = np.random.default_rng(6)
    n, d, tags, alphas = 120, 10, ["t0", "t1", "t2"], [1.0, 10.0, 1000.0]
    x = rng.normal(size=(n, d)) * rng.uniform(0.5, 3, d)
    y = (x[:, :3] + rng.normal(size=(n, 3)) > 0.4).astype(int)
    split = np.array(["train", "val", "test"])[rng.choice(3, n, p=[0.6, 0.2, 0.2])]
    anchors = spark.createDataFrame([(i, v.tolist(), str(s), *map(int, t)) for i, (v, s, t) in enumerate(zip(x, split, y))], "id long, v array<double>, split string, t0 int, t1 int, t2 int").repartition(4)
    shifted = {"positive": x + 0.3, "noname": x * np.where(np.arange(d) < 5, 1, 0.1)}
    some = {k: [i for i in range(n) if (i + len(k)) % 3] for k in shifted}
    variants = spark.createDataFrame([(i, k, v[i].tolist()) for k, v in shifted.items() for i in some[k]] + [(999, "positive", x[0].tolist())], "id long, variant string, v array<double>")

    def prf(truth, said):
        tp, fp, fn = (truth & said).sum(), (~truth & said).sum(), (truth & ~said).sum()
        p, r = tp / max(1, tp + fp), tp / max(1, tp + fn)
        return (2 * p * r / (p + r) if p + r else 0.0), p, r

    a, b = x[split == "train"], x[split == "val"]
    mean, std = a.mean(0), a.std(0)
    best = None
    for alpha in alphas:
        z, t = (a - mean) / std, y[split == "train"]
        w = np.linalg.solve(z.T @ z + alpha * np.eye(d), z.T @ (t - t.mean(0)))
        score = lambda q, w=w, t=t: (q - mean) / std @ w + t.mean(0)
        for th in np.linspace(score(b).min(), score(b).max(), 33):
            f1, _, r = prf(y[split == "val"] > 0, score(b) >= th)
            if best is None or (round(f1, 12), round(r, 12), -alpha) > best[0]:
                best = (round(f1, 12), round(r, 12), -alpha), th, score
    _, th, score = best
    got = {r["part"]: r for r in probes.variant_robustness(anchors, variants, "id", "variant", "v", tags, "split", alphas).collect()}
    assert set(got) == {"anchor_train", "anchor_val", "anchor_test", "positive", "noname"}
    for s in ("train", "val", "test"):
        r = got[f"anchor_{s}"]
        assert np.allclose((r["micro_f1"], r["precision"], r["recall"]), prf(y[split == s] > 0, score(x[split == s]) >= th)) and r["n"] == (split == s).sum() and r["drop_f1"] is None
    for k, v in shifted.items():
        own, base = (prf(y[some[k]] > 0, score(m[some[k]]) >= th) for m in (v, x))
        cos = [(v[i] @ x[i]) / np.linalg.norm(v[i]) / np.linalg.norm(x[i]) for i in some[k]]
        r = got[k]
        want = (*own, base[0], base[2], base[0] - own[0], base[2] - own[2], np.mean(cos), np.median(cos))
        assert np.allclose([r[c] for c in ("micro_f1", "precision", "recall", "anchor_f1", "anchor_recall", "drop_f1", "drop_recall", "cosine_mean", "cosine_median")], want, atol=1e-7)
        assert r["n"] == len(some[k])
