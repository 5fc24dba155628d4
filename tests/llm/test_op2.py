import numpy as np
import pytest

from rowforge.llm import op2_mixing as op


def staged(spark, tokens, p):
    return spark.createDataFrame([(int(t), [float(x) for x in row], i) for i, (t, row) in enumerate(zip(tokens, p))], "_tokens long, _p array<double>, doc_id long")


@pytest.mark.parametrize("low,high,targets", [(0.0, 4.0, [0.5, 0.3, 0.2]), (1.0, 4.0, [0.3, 0.4, 0.3]), (0.0, 1.2, [0.1, 0.1, 0.8])])
def test_rates_against_plain_least_squares(spark, low, high, targets):
    rng = np.random.default_rng(3)
    tokens, p = rng.integers(0, 500, 200), rng.dirichlet([0.3, 0.3, 0.3], 200)
    rows = staged(spark, tokens, p)
    mix = op.fit_rates(rows, targets, 1.1, low, high, steps=150)
    a = p * tokens[:, None]
    got = mix.rates(a)
    total = tokens.sum()
    goal = np.array(targets) * 1.1 * total

    def loss(r):
        return 0.5 * (((r @ a - goal) / total) ** 2).sum() + 0.5 * op.PULL * (tokens / total * (r - 1) ** 2).sum()

    r = np.ones(200)
    for _ in range(20000):  # plain projected gradient on scaled variables
        r = np.clip(r - 0.5 * (p @ ((r @ a - goal) / total) + op.PULL * (r - 1)), low, high)
    assert loss(got) <= loss(r) + 1e-5 and (got >= low).all() and (got <= high).all()
    assert np.allclose(got @ a, mix.reached, rtol=1e-6)


@pytest.mark.parametrize("low,targets,budget", [(0.0, [0.88, 0.08, 0.04], 1.0), (1.0, [0.9, 0.07, 0.03], 1.15)])
def test_default_fit_is_optimal(spark, low, targets, budget):
    """As production calls it: each rate is the one that the totals' distance from the goal asks for, to a thousandth."""
    rng = np.random.default_rng(5)
    tokens, p = rng.integers(1, 800, 3000), rng.dirichlet([2.0, 0.5, 0.2], 3000)
    mix = op.fit_rates(staged(spark, tokens, p), targets, budget, low)
    r = mix.rates(p * tokens[:, None])
    off = (r @ (p * tokens[:, None]) - np.array(targets) * budget * tokens.sum()) / tokens.sum()
    assert np.abs(r - np.clip(1 - p @ off / op.PULL, low, 4.0)).max() < 1e-3
    assert np.allclose(mix.reached, r @ (p * tokens[:, None]), rtol=1e-6)
    assert op.fit_rates(staged(spark, tokens, p), targets, budget, low, pull=1e-5).still <= op.EXACT  # starts at a bound


def test_domains_meet_their_targets(spark):
    """As the query calls it, at sf0.1: every domain's total within 2 % of its goal, and posteriors as sure as they are right."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    targets = np.array([0.88, 0.08, 0.04])
    got = op.mixing_rates(docs, op.label_domains(labels), targets.tolist(), tolerance=0.02)
    rows = got.collect()
    assert len(rows) == docs.count()
    n, r, p = (np.array([x[k] for x in rows], float) for k in ("n_tokens", "rate", "posteriors"))
    assert np.allclose(p.sum(1), 1) and (r >= 0).all() and (r <= 4).all()
    reached = ((n * r)[:, None] * p).sum(0)
    assert np.allclose(reached, rows[0].reached_tokens) and np.allclose(rows[0].wanted_tokens, targets * n.sum())
    assert (np.abs(reached / n.sum() - targets) <= 0.02 * targets).all()
    assert abs(np.mean([x.copies for x in rows]) - r.mean()) < 0.1
    told = {x.doc_id: x.grade for x in op.label_domains(labels).collect()}
    truth = np.array([told.get(x.doc_id, -1) for x in rows])
    for d in range(3):  # expected domain tokens against labelled ones
        assert abs((n * (truth >= 0) * p[:, d]).sum() / n[truth == d].sum() - 1) < 0.15


def test_targets_out_of_reach(spark):
    """With rates of one or more no domain can fall: the totals come as near as they can, or it is an error."""
    rows = staged(spark, [100] * 10, [[1.0, 0.0]] * 5 + [[0.0, 1.0]] * 5)
    mix = op.fit_rates(rows, [0.9, 0.1], 1.0, low=1.0)
    assert np.allclose(mix.targets, [900, 100]) and np.allclose(mix.reached, [900, 500], rtol=1e-3)
    docs = spark.createDataFrame([(k, "good words here" if k % 2 else "bad sort $$$ of") for k in range(40)], "doc_id long, text string")
    labelled = spark.createDataFrame([(k, 1 - k % 2) for k in range(40)], "doc_id long, grade int")
    with pytest.raises(ValueError, match="out of reach"):
        op.mixing_rates(docs, labelled, [0.9, 0.1], low=1.0, tolerance=0.02)


def test_temperature_makes_held_out_labels_likeliest():
    """Of labels that a word gets right nine times of ten, the posterior says nine of ten."""
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 2, 4000)
    sets = [np.unique(np.append(rng.integers(100, 5000, 30), 7 if (g == 1) == (rng.random() < 0.9) else 8)).astype(np.uint64) for g in truth]
    p = op.fit_calibrated(truth, sets, 2).posteriors([np.array([k], np.uint64) for k in (7, 8)])
    assert np.abs(p - [[0.1, 0.9], [0.9, 0.1]]).max() < 0.05


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "x " * 50_000, 7), (3, "x " * 50_000, 7), (None, "idiot", 8)], "doc_id long, text string, rate int")
    for data in ([], [(1, 1, None), (None, 0, 1)], [(1, 1, 0), (3, 0, 0)]):
        labelled = op.label_domains(spark.createDataFrame(data, "doc_id long, quality int, toxic int"))
        assert op.mixing_rates(docs, labelled, [1, 1, 1]).count() == 5
        more = docs.withColumns({c: op.F.lit(1) for c in ("_tokens", "_p", "_rate", "_copies", "_copy")})
        assert op.mix_documents(more, labelled, [0.6, 0.3, 0.1], 1.2, low=1.0).columns == more.columns
        out = op.mix_documents(docs, labelled, [0.6, 0.3, 0.1], 1.2, low=1.0)
        assert out.columns == docs.columns and out.count() >= 5
    assert op.mixing_rates(docs.limit(0), labelled, [1, 1, 1]).count() == 0


def test_values_of_edge_cases(spark):
    """Null and empty texts have no tokens, the prior's posteriors and the rate one; a very long text counts every word; copies follow rates."""
    long = "calm water " * 60_000
    rows = [(k, f"good words here and more than{k}" if k % 2 else f"bad sort of it as{k}") for k in range(60)]
    docs = spark.createDataFrame([*rows, (100, None), (101, ""), (102, long), (None, "good words"), (103, " \n ")], "doc_id long, text string").withColumn("_rate", op.F.lit(9)).withColumn("copies", op.F.lit("x"))
    labelled = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "doc_id long, grade int")
    got = {r.doc_id: r for r in op.mixing_rates(docs, labelled, [0.5, 0.5]).collect()}
    assert [got[k].n_tokens for k in (100, 101, 102, 103, None)] == [0, 0, 120_000, 0, 2]
    assert got[100].rate == got[101].rate == got[103].rate == 1.0 and got[100].posteriors == got[101].posteriors
    assert sum(got[100].posteriors) == pytest.approx(1) and got[1].posteriors[0] > 0.9 > 0.1 > got[0].posteriors[0]
    assert all(abs(r.copies - r.rate) < 1 for r in got.values())
