"""Operators 11 and 13 against brute force: search by ball trees, and whitening."""

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import topk_search, whitening
from lexweave.llm.topk_search import Best, BallTree, Queries, op11_ball_tree_topk, top_k
from lexweave.llm.whitening import Welford, fit_whitening, moments, op13_welford_whitening, symmetric_qr, whitened

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, q string, score string, `a.b` string"


def written(spark, tmp_path, vectors):
    rows = [(i, v, None, "x", None, "s", "d") for i, v in vectors]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def odd(clean):
    """Rows with a null vector, null and non-finite entries, and a null key."""
    nan, inf = float("nan"), float("inf")
    return [*clean, (900, None), (901, [None, 1.0, 1.0]), (902, [nan, 1.0, 1.0]), (1000, [inf, 1.0, 1.0]), (1100, [-inf, 1.0, 1.0]), (None, [0.5, 0.5, 0.5])]


def exact(rows, k, every=100):
    """Each query's best k by plain comparison; rows are (id, integer vector)."""
    out = []
    for qid, q in {(i, v) for i, v in rows if i is not None and i % every == 0}:
        met = sorted((-sum(a * b for a, b in zip(q, v)), i is None, i or 0) for i, v in rows if i != qid and len(v) == len(q))
        out += [(qid, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(met[:k])]
    return sorted(out, key=str)


def integers(rows):
    return [(i, tuple(int(np.floor(1024 * float(np.float32(c)))) for c in v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


@pytest.mark.parametrize("kind", ["random", "clustered", "copies", "lengths", "few", "none"])
def test_search_is_brute_force(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(topk_search, "LEAF", 8)
    monkeypatch.setattr(topk_search, "SHARD_BYTES", 2000)
    monkeypatch.setattr(topk_search, "QUERY_BYTES", 3000)
    rng = np.random.default_rng(5)
    n = {"few": 4, "none": 0}.get(kind, 700)
    own = rng.normal(size=(n, 3))
    if kind == "clustered":
        own = own * 0.05 + rng.normal(size=(7, 3))[rng.integers(0, 7, n)]
    if kind == "copies":
        own[n // 3 :] = np.round(own[n // 3 :] * 2) / 2
        own[: n // 3] = own[0]
    rows = [(i * 25, v.tolist()) for i, v in enumerate(own)]
    if kind == "lengths":
        rows = [(i, v[: 1 + i % 3]) for i, v in rows] + [(100, []), (7, [])]
    if kind not in ("none", "few"):
        # Repeated rows, a query with two vectors, and one of the largest values that doubles don't hold.
        rows = odd(rows + rows[:5]) + [(300, [1.0, 2.0, 3.0])]
    out = op11_ball_tree_topk(spark, written(spark, tmp_path, rows))
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, out.collect()), key=str) == exact(integers(rows), 10)


def test_search_is_exact_beyond_doubles(spark):
    big = 1 << 29
    rows = [(i * 100, [big + i, big - i, 3 * i]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id bigint, x array<bigint>")
    assert sorted(map(tuple, top_k(df, df, 5).collect()), key=str) == exact([(i, tuple(v)) for i, v in rows], 5)
    huge = spark.createDataFrame([(0, [1 << 40]), (1, [1 << 40])], "vec_id bigint, x array<bigint>")
    with pytest.raises(Exception, match="may not fit into 64 bits"):
        top_k(huge, huge, 5).collect()


def test_bounds_cut_most_leaves_of_clustered_vectors(monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(32, 8)) * 1000
    own = (centres[np.repeat(np.arange(32), 256)] + rng.normal(size=(32 * 256, 8)) * 20).astype(np.int64)
    tree, asked = BallTree(own, np.arange(len(own))), own[::97]
    seen = []
    monkeypatch.setattr(BallTree, "_scores", lambda self, queries, q, run, f=BallTree._scores: (seen.append(len(q) * (run.stop - run.start)), f(self, queries, q, run))[1])
    best = Best.empty(len(asked), 10)
    tree.search(Queries(np.arange(len(asked)), np.arange(len(own))[::97], asked, best), best)
    assert sum(seen) < 0.15 * len(own) * len(asked)
    scores = asked @ own.T
    scores[np.arange(len(asked)), np.arange(len(own))[::97]] = -(1 << 60)
    assert (np.sort(scores, 1)[:, :-11:-1] == best.scores).all()


def plain(x, k=8):
    n, far = len(x), x - x.sum(0) / len(x)
    v = far.T @ far / n
    e, u = np.linalg.eigh(v)
    return v, e[::-1][:k], u[:, ::-1][:, :k], far


@pytest.mark.parametrize("length", [1, 2, 3, 12])
def test_whitening_is_numpys(spark, tmp_path, length):
    rng = np.random.default_rng(length)
    own = (rng.normal(size=(400, length)) @ rng.normal(size=(length, length))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(own)] + [(3, own[3].tolist()), (None, own[5].tolist()), (901, None), (902, [None] * length), (903, [float("nan")] * length), (904, [1.0] * (length + 1)), (905, [])]
    got = op13_welford_whitening(spark, written(spark, tmp_path, rows)).toPandas()
    fit = [(i, v) for i, v in integers(rows) if len(v) == length]
    x = np.array([v for _, v in fit], np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    v, e, u, far = plain(x)
    assert len(got) == n * len(e) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    key = [(-1 if i is None else i) for i, _ in fit]
    for c in range(len(e)):
        own = got[got.component == c + 1].fillna({"vec_id": -1})
        z, want = far @ u[:, c] / np.sqrt(e[c]), {}
        for i, w, d in zip(key, z, ((n * x - sums) ** 2).sum(1).tolist()):
            want.setdefault(i, []).append((w, d))
        sign = np.sign(sum(r.whitened * want[r.vec_id][0][0] for r in own.itertuples()))
        for r in own.itertuples():
            assert min(abs(sign * r.whitened - w) + abs(r.deviation - d) for w, d in want[r.vec_id]) < 1e-8
        assert abs(own.explained.iloc[0] - e[c] / np.trace(v)) < 1e-9


def test_whitening_of_few_equal_or_no_vectors(spark, tmp_path):
    for i, rows in enumerate(([], [(1, [0.5, 0.5])], [(i, [0.5, 0.25]) for i in range(9)], [(1, None)])):
        assert op13_welford_whitening(spark, written(spark, tmp_path / str(i), rows)).count() == 0
    # One direction only: one component.
    out = op13_welford_whitening(spark, written(spark, tmp_path / "line", [(i, [i / 8, i / 4, 0.0]) for i in range(20)])).toPandas()
    assert set(out.component) == {1} and len(out) == 20 and abs(out.explained - 1).max() < 1e-12


def test_moments_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    x = np.random.default_rng(2).integers(0, 1000, (500, 4)) + 10**9
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<bigint>").repartition(29)
    state = moments(df, "x", 4)
    far = (x - 10**9) - (x - 10**9).mean(0)
    assert state.n == 500 and state.sums.tolist() == x.sum(0).tolist()
    assert np.allclose(state.m, far.T @ far, rtol=0, atol=1e-12 * np.trace(far.T @ far))


def test_welford_updates_are_rank_one():
    x = np.random.default_rng(3).normal(size=(50, 3)) + 1e6
    state, mean, m = Welford.empty(3, False), np.zeros(3), np.zeros((3, 3))
    for i, v in enumerate(x):
        d = v - mean
        mean = mean + d / (i + 1)
        m += np.outer(d, v - mean)
    for at in range(0, 50, 7):
        state.update(x[at : at + 7])
    assert np.allclose(state.base + state.mean, mean, rtol=1e-14) and np.allclose(state.m, m, rtol=1e-7)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 80])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.ones((n, n)), np.diag(np.arange(n)), np.zeros((n, n)), np.diag([1e8] + [1e-8] * (n - 1))):
        a = np.array(a + a.T, float)
        e, u = symmetric_qr(a)
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-12 * max(1, np.abs(a).sum()))
        assert np.allclose(u.T @ u, np.eye(n), atol=1e-12) and np.allclose(a @ u, u * e, atol=1e-11 * max(1, np.abs(a).sum()))


def test_deviations_are_exact_beyond_longs():
    state = Welford(10**7, np.zeros(2), np.zeros(2), np.eye(2), np.array([10**12, -(10**12)], object))
    fit = whitening.Whitening(state, np.ones(2), np.eye(2), 2.0)
    x = np.array([[100_000, -100_000], [2 * 10**6, 5]], np.int64)
    assert fit.deviations(x) == [sum((10**7 * int(c) - s) ** 2 for c, s in zip(r, state.sums)) for r in x]


def test_whitened_keeps_other_columns(spark):
    rows = [(i, [i, i * i % 7, 3], "w", "r") for i in range(30)] + [(99, None, "w", "r")]
    df = spark.createDataFrame(rows, "k int, t array<bigint>, whitened string, rest string")
    out = whitened(df, fit_whitening(df.where("t IS NOT NULL"), "t"), "t")
    assert out.columns == ["k", "t", "rest", "whitened", "deviation"] and out.count() == 30
    assert isinstance(out.first()["t"], list) and pa is not None
