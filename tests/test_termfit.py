"""The row-space Newton fit against a dense fit of the same objective, and its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixtext.operators import models as M
from mixtext.operators import termfit as TF


def dense_newton(x, y, weight, k, penalty, steps=60):
    """Plain Newton on all coefficients and intercepts at once."""
    n, d = x.shape
    xa = np.hstack([x, np.ones((n, 1))])
    theta = np.zeros((d + 1, k))
    keep = np.ones((d + 1, 1)) * penalty
    keep[-1] = 0
    hot = np.eye(k)[y]
    for _ in range(steps):
        z = xa @ theta
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = xa.T @ (weight[:, None] * (p - hot)) + keep * theta
        h = np.zeros((k, d + 1, k, d + 1))
        for a in range(k):
            for b in range(k):
                m = weight * p[:, a] * ((a == b) - p[:, b])
                h[a, :, b] = (xa * m[:, None]).T @ xa
                if a == b:
                    h[a, :, b] += np.diag(keep[:, 0])
        step = np.linalg.lstsq(h.reshape(k * (d + 1), -1), grad.T.ravel(), rcond=None)[0].reshape(k, d + 1).T
        theta = theta - step
    return theta


class DenseGram:
    def __init__(self, x):
        self.x = x

    def __call__(self, s):
        u = self.x.T @ s
        return self.x @ u, float(np.abs(u).max())


@pytest.mark.parametrize("k", [2, 3])
def test_newton_reaches_the_dense_optimum(k):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(120, 15)) * (rng.random((120, 15)) < 0.4)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    y = rng.choice(k, 120, p=[0.6, 0.4] if k == 2 else [0.6, 0.3, 0.1])
    counts = np.bincount(y, minlength=k)
    weight = 120 / (k * counts[y])
    data = TF.RowTable(y, weight, k)
    fit = TF.newton(DenseGram(x), data, 50, 1e-11)
    want = dense_newton(x, y, weight, k, data.penalty)
    got = x.T @ fit.rows
    assert fit.peak <= 1e-11 and np.abs(got - want[:-1]).max() < 1e-6
    assert np.abs((fit.intercept - fit.intercept.mean()) - (want[-1] - want[-1].mean())).max() < 1e-6
    if k == 2:  # the two-class form penalises the difference of the two rows once
        z = x @ (got[:, 1] - got[:, 0]) + fit.intercept[1] - fit.intercept[0]
        slope = x.T @ (weight * (1 / (1 + np.exp(-z)) - y)) + got[:, 1] - got[:, 0]
        assert np.abs(slope).max() < 1e-7


def test_cells_hold_every_entry_and_multiply(spark, monkeypatch):
    monkeypatch.setattr(TF, "CELL_ENTRIES", 50)
    monkeypatch.setattr(TF, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 40)) * (rng.random((60, 40)) < 0.3)
    x[:, 0] = 1.0  # a term of every row
    entries = [(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    cells = TF.build_cells(spark.createDataFrame(entries, "i long, term string, weight double"), len(entries))
    assert cells.count() > 4
    s = rng.normal(size=(60, 3))
    for few in (16, 0):
        monkeypatch.setattr(TF, "FEW_CELLS", few)
        got, peak = TF.Gram(cells, 60)(s)
        assert np.abs(got - x @ (x.T @ s)).max() < 1e-9 and abs(peak - np.abs(x.T @ s).max()) < 1e-9
    fit = TF.Fit(s, np.zeros(3), 0.0, 0, 0)
    table = {r.term: r for r in TF.coefficients(cells, fit, 60).collect()}
    w = x.T @ s
    for j in range(40):
        df = int((x[:, j] != 0).sum())
        if df:
            assert np.abs(np.array(table[f"t{j}"].w) - w[j]).max() < 1e-9
            assert abs(table[f"t{j}"].idf - (np.log(61 / (1 + df)) + 1)) < 1e-12


def test_rows_are_numbered_without_gaps(spark):
    rows = TF.number_rows(spark.range(1000).repartition(7).where("id % 3 <> 0"))
    assert sorted(r.i for r in rows.collect()) == list(range(rows.count()))
    assert TF.number_rows(spark.range(0)).count() == 0


def test_fit_rows_takes_at_most_the_bound(spark):
    rows = spark.range(5000).withColumnRenamed("id", "row_id")
    assert M.fit_rows(rows, 5000).count() == 5000
    for most in (4999, 1700, 3, 0):
        kept = M.fit_rows(rows, most)
        assert kept.count() <= most and kept.count() >= most - 40
        least = F.shiftrightunsigned(F.xxhash64("row_id"), 44)
        if kept.count():
            cut = kept.agg(F.max(least)).first()[0]
            assert rows.where(least <= cut).count() == kept.count()


def test_text_model_ends_at_its_optimum(spark):
    rows = [(i, " ".join(t), y) for i, (t, y) in enumerate([(("good", "fine", f"x{i % 7}"), "p") for i in range(30)]
            + [(("bad", "poor", f"x{i % 5}"), "n") for i in range(20)] + [(("so", f"x{i % 3}"), "z") for i in range(9)] + [((), "z")])]
    train = spark.createDataFrame(rows, "row_id long, text string, label string")
    model = M.TfidfModel.fit(train, tol=1e-9)
    assert model.peak <= 1e-9 and model.gradient_peak(train) < 1e-8
    got = {r.row_id: r.probabilities for r in model.with_probabilities(train, "text").collect()}
    assert len(got) == len(rows) and all(model.classes[int(np.argmax(got[i]))] == y for i, _, y in rows)
    with pytest.raises(ValueError):
        M.TfidfModel.fit(train.limit(0))
    with pytest.raises(FileNotFoundError):
        M.TfidfModel.load("/nowhere/model")


def test_counts_dealt_once_give_the_normalised_products(spark, monkeypatch):
    """Cells of term counts: idf by the cells' own document frequencies, norms summed over cells."""
    monkeypatch.setattr(TF, "CELL_ENTRIES", 50)
    rng = np.random.default_rng(7)
    tf = rng.integers(1, 5, (60, 40)) * (rng.random((60, 40)) < 0.3)
    tf[3] = 0  # a row without terms
    entries = [(int(i), f"t{j}", float(tf[i, j])) for i, j in zip(*np.nonzero(tf), strict=True)]
    cells = TF.build_cells(spark.createDataFrame(entries, "i long, term string, weight double"), len(entries))
    idf = np.log(61 / (1 + (tf > 0).sum(axis=0))) + 1
    x = tf * idf
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = rng.normal(size=(60, 3))
    gram = TF.Gram(cells, 60, 60)
    got, peak = gram(s)
    assert np.abs(got - x @ (x.T @ s)).max() < 1e-9 and abs(peak - np.abs(x.T @ s).max()) < 1e-9
    table = {r.term: r for r in TF.coefficients(cells, TF.Fit(s, np.zeros(3), 0.0, 0, 0), 60, gram).collect()}
    assert max(abs(table[f"t{j}"].idf - idf[j]) + np.abs(np.array(table[f"t{j}"].w) - x[:, j] @ s).max() for j in range(40)) < 1e-9


def test_answers_of_a_product_follow_slots_and_bytes_not_cells(spark, monkeypatch):
    monkeypatch.setattr(TF, "CELL_ENTRIES", 20)
    entries = [(i, f"t{i % 40}", 1.0) for i in range(2000)]
    cells = TF.build_cells(spark.createDataFrame(entries, "i long, term string, weight double"), len(entries))
    slots = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))  # a partition for each cell's file
    try:
        gram = TF.Gram(spark.read.parquet(cells.inputFiles()[0].rsplit("/", 1)[0]), 2000)
        assert cells.count() > slots and gram.tasks(3) == slots
        monkeypatch.setattr(TF, "FEW_CELLS", 2)
        monkeypatch.setattr(TF, "ANSWER_BYTES", 8 * 2000 * 3 * 4)
        assert gram.tasks(3) == min(4, slots)
        got, _ = gram(np.ones((2000, 3)))
        assert np.array_equal(got, np.full((2000, 3), 50.0))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
