import numpy as np

from headway.operators import anomaly


def series(n, seed=0):
    rng = np.random.default_rng(seed)
    t = rng.uniform(0, 6, n)[:, None] + np.arange(12) * 0.5
    return 30 + 10 * np.sin(t) + rng.normal(0, 0.3, t.shape)


def test_loss_falls_and_a_seed_fixes_the_model():
    a, b = (anomaly.train(series(600), epochs=12, seed=2) for _ in range(2))
    assert a.losses[-1] < 0.6 * a.losses[0]
    assert (a.mse(series(20, 5)) == b.mse(series(20, 5))).all()


def test_an_injected_jump_stands_out():
    model = anomaly.train(series(1500), epochs=20)
    plain, jump = series(300, 7), series(300, 8)
    jump[:, 6] += 60
    cut = np.quantile(model.mse(series(1500)), 0.99)
    assert (model.mse(jump) > cut).mean() > 0.95 and (model.mse(plain) > cut).mean() < 0.06


def test_gradients_equal_differences():
    x = np.random.default_rng(1).normal(size=(3, 4))
    rng = np.random.default_rng(0)
    cell = anomaly.Cell(3, rng)
    h = rng.normal(size=(3, 3))
    out, kept = cell.forward(x[:, :1], h)
    grad = {k: np.zeros_like(v) for k, v in cell.p.items()}
    back = cell.backward(np.ones_like(out), kept, grad)
    for k in cell.p:
        at = (0,) * cell.p[k].ndim
        old = cell.p[k][at]
        cell.p[k][at] = old + 1e-6
        up = cell.forward(x[:, :1], h)[0].sum()
        cell.p[k][at] = old
        assert abs((up - out.sum()) / 1e-6 - grad[k][at]) < 1e-4
    moved = h.copy()
    moved[1, 2] += 1e-6
    assert abs((cell.forward(x[:, :1], moved)[0].sum() - out.sum()) / 1e-6 - back[1, 2]) < 1e-4


def test_spark_scores_and_rejection(spark):
    xs = series(200)
    xs[0, 5] += 90
    rows = spark.createDataFrame([(1, i, x.tolist()) for i, x in enumerate(xs)], "vehicle_id long, fix_id long, xs array<double>")
    model = anomaly.fit_autoencoder(rows, epochs=5)
    scored = anomaly.reconstruction_mse(rows, model)
    kept = anomaly.reject(rows, scored, anomaly.threshold(scored, 0.99))
    assert 0 not in {r["fix_id"] for r in kept.collect()} and kept.count() == 198


def test_no_windows(spark):
    none = spark.createDataFrame([], "vehicle_id long, fix_id long, xs array<double>")
    assert anomaly.fit_autoencoder(none).losses[-1] == 0.0
