"""Histogram boosting: splits against brute force, patience, resuming, best-first growth, bins, published versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonecast.ml import boosting
from zonecast.ml.boosting import Binner, Spec, Tree, best_first, boost
from zonecast.session import publish, published, scratch_dir


def table(spark, n=600, sets=2, noise=False, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 8, (n, 3)).astype(np.uint8)
    y = rng.random(n) if noise else (x[:, 0] > 3) * 0.5 + (x[:, 1] == 2) * 0.2 + (x[:, 0] > 3) * (x[:, 2] > 5) * 0.3
    rows = [(s, bytearray(x[i].tobytes()), float(y[i]), i % 5 == s, i * 7919) for i in range(n) for s in range(sets)]
    return x, y, spark.createDataFrame(rows, "set int, x binary, y double, valid boolean, u long").repartition(5)


def brute_tree(x, g, depth, spec):
    """Predictions of a greedily grown tree."""
    out = np.full(len(x), spec.step * g.sum() / (len(g) + spec.smoothing))
    best = (1e-12, None)
    for f in range(x.shape[1]):
        for b in range(8):
            left = x[:, f] <= b
            if 0 < left.sum() < len(x):
                score = lambda k: g[k].sum() ** 2 / (k.sum() + spec.smoothing)
                gain = score(left) + score(~left) - score(np.ones(len(x), bool))
                if gain > best[0] + 1e-9:
                    best = (gain, left)
    if depth and best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = brute_tree(x[side], g[side], depth - 1, spec)
    return out


def test_trees_equal_brute_force(spark):
    x, y, df = table(spark)
    specs = [Spec(max_depth=3, step=0.3), Spec(max_depth=2, step=0.5, smoothing=2.0)]
    models = boost(df, specs, 3)
    for s in range(2):
        train = np.arange(len(y)) % 5 != s
        for m, spec in enumerate(specs):
            p = np.full(len(y), y[train].mean())
            for _ in range(3):
                step = np.zeros(len(y))
                step[train] = brute_tree(x[train], (y - p)[train], spec.max_depth, spec)
                p += step
            assert models[s, m].predict(x[train]) == pytest.approx(p[train], abs=1e-4)


def test_noise_stops_near_the_patience_without_refit(spark, monkeypatch):
    _, _, df = table(spark, 300, 1, noise=True)
    runs, run = [], boosting._run
    monkeypatch.setattr(boosting, "_run", lambda *a: runs.append(1) or run(*a))
    b = boost(df, [Spec(max_depth=2)], 1000, patience=4)[0, 0]
    grown = len(b.errors)
    assert 4 < grown < 60 and len(b.trees) == int(np.argmin(b.errors)) + 1 == grown - 4
    assert len(runs) <= 2 * (grown + 1)  # one pass a level, and nothing after the stop


def test_stopped_training_resumes(spark, monkeypatch):
    x, _, df = table(spark, 300)
    specs = [Spec(max_depth=2, rows=0.8, features=0.7), Spec(max_depth=2, leaves=3)]
    want = boost(df, specs, 5, patience=50)
    work, run, runs = scratch_dir(spark, "resume"), boosting._run, []

    def failing(*a):
        runs.append(1)
        if len(runs) > 7:
            raise RuntimeError("lost")
        return run(*a)

    monkeypatch.setattr(boosting, "_run", failing)
    with pytest.raises(RuntimeError, match="lost"):
        boost(df, specs, 5, patience=50, save_every=2, work=work)
    runs.clear()
    monkeypatch.setattr(boosting, "_run", lambda *a: runs.append(1) or run(*a))
    got = boost(df, specs, 5, patience=50, save_every=2, work=work)
    assert len(runs) <= 2 * 4  # three of the five rounds, and the last errors
    for sm in want:
        assert got[sm].errors == pytest.approx(want[sm].errors) and (got[sm].predict(x) == want[sm].predict(x)).all()


def test_best_first_growth_keeps_the_greatest_gains():
    t = Tree.empty(3)
    for i, gain in {0: 9.0, 1: 1.0, 2: 8.0, 3: 7.0, 5: 2.0, 6: 6.0, 13: 5.0}.items():
        t.feature[i], t.gain[i] = 0, gain
    best_first(t, 5)  # root, its right child, that one's right child, and then the left child's subtree is behind
    assert np.flatnonzero(t.feature >= 0).tolist() == [0, 2, 6, 13]


def test_leaf_limit_prefers_a_deep_one_sided_signal(spark):
    """With as many leaves, best-first growth goes down the one branch that has signal."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (2000, 6)).astype(np.uint8)
    deep = np.cumprod(x, axis=1).sum(axis=1).astype(float)  # each further step matters only where all before are 1
    df = spark.createDataFrame([(0, bytearray(r.tobytes()), float(v), False, i) for i, (r, v) in enumerate(zip(x, deep))],
                               "set int, x binary, y double, valid boolean, u long")
    models = boost(df, [Spec(max_depth=6, leaves=7, step=1.0, smoothing=0.0), Spec(max_depth=2, step=1.0, smoothing=0.0)], 1)
    error = [float(((models[0, m].predict(x) - deep) ** 2).mean()) for m in range(2)]
    assert error[0] < 1e-6 < 0.05 < error[1]


def test_bins_of_numbers_and_categories(spark):
    rows = [(i, float(i % 100), f"v{i % 5}", f"h{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, a double, few string, many string")
    binner = Binner.fit(df, ["a"], ["few", "many"])
    assert binner.values["few"] == ["v0", "v1", "v2", "v3", "v4"] and binner.values["many"] is None and len(binner.cuts["a"]) < boosting.BINS
    new = df.union(spark.createDataFrame([(900, float("nan"), "unseen", "other"), (901, -1e9, "v0", "")], df.schema))
    got = {r.row_id: list(r.x) for r in binner.transform(new).collect()}
    assert [got[i][1] for i in range(5)] == [1, 2, 3, 4, 5] and got[900][1] == 0
    assert [got[i][0] for i in range(100)] == sorted(got[i][0] for i in range(100)) and got[901][0] == 0 and got[900][0] == len(binner.cuts["a"])
    assert all(0 < g[2] < boosting.BINS for g in got.values()) and len({g[2] for g in got.values()}) > 40
    boosting.save_binner(spark, path := scratch_dir(spark, "bins"), binner)
    assert boosting.load_binner(spark, path) == binner


def test_scoring_rows_of_one_file_are_dealt_to_many_tasks(spark, tmp_path):
    """One file of one row group leaves reading to one task; the members' work must not stay there."""
    from zonecast.operators.cleaning import Medians
    from zonecast.plans import modelling

    ts = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id % 30, id % 24)")
    spark.range(3000).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 200).alias("user_id"), F.lit("view").alias("event_type"),
                             (F.col("id") % 90).cast("double").alias("value"), F.lit("{}").alias("props")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")

    class Counting:
        """Names the task that each row is scored in."""
        def score(self, rows, features=True):
            return rows.select("row_id", *[F.spark_partition_id().cast("double").alias(c) for c in
                                           ("pred_cat", "pred_lgb", "pred_xgb", "pred_ensemble_blend", "pred_ensemble_trio")])

    e = modelling.experiment(spark, str(tmp_path))
    e.final, e.ctx.medians = Counting(), Medians(17.5, 3)
    got = modelling.q_score_trio(spark, str(tmp_path)).groupBy("demand").count().collect()
    n, want = sum(r["count"] for r in got), e.ctx.score_raw.count()
    assert n == want > 500 and len(got) > 4 and max(r["count"] for r in got) < n / 4


def test_predictions_without_the_features_are_the_same(spark):
    df = spark.createDataFrame([(i, float(i % 50), f"v{i % 5}") for i in range(400)], "row_id long, a double, b string")
    binner = Binner.fit(df, ["a"], ["b"])
    binned = binner.transform(df.withColumn("y", F.col("a") * 2))
    models = boost(binned.selectExpr("0 AS set", "x", "y", "false AS valid", "row_id AS u"), [Spec(max_depth=3)], 2)
    whole, lean = (boosting.predict(df, models, ["p"], binner=binner, features=f) for f in (True, False))
    assert whole.columns == ["row_id", "a", "b", "p"] and lean.columns == ["row_id", "p"]
    assert sorted(lean.collect()) == sorted(whole.select("row_id", "p").collect()) and lean.count() == 400


def test_a_version_that_was_not_published_is_not_read(spark):
    path = scratch_dir(spark, "versions")
    with pytest.raises(FileNotFoundError):
        published(spark, path)
    spark.range(3).write.parquet(f"{path}/one/data")
    publish(spark, path, "one")
    spark.range(4).write.parquet(f"{path}/two/data")  # its run stopped before the manifest
    spark.range(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/manifest-00000002")  # or inside it
    assert published(spark, path) == "one"
    publish(spark, path, "three")
    assert published(spark, path) == "three"


def test_prediction_keeps_other_columns(spark):
    _, _, df = table(spark, 100, 1)
    models = boost(df, [Spec(max_depth=1)], 1)
    got = boosting.predict(df.selectExpr("*", "7 AS tag"), models, ["pred_a"])
    assert got.columns == ["set", "y", "valid", "u", "tag", "pred_a"] and got.where("tag = 7 and pred_a is not null").count() == 100


def test_state_carries_every_round_and_drops_the_one_before(spark):
    """A pass adds no earlier trees on the fly: the predictions in the state are those of all trees so far."""
    x, y, df = table(spark, 300)
    work = scratch_dir(spark, "state")
    specs = [Spec(max_depth=2, rows=0.8), Spec(max_depth=3, leaves=3)]
    models = boost(df, specs, 6, save_every=3, work=work)
    folder = spark._jvm.org.apache.hadoop.fs.Path(work)
    kept = sorted(f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder))
    assert kept == ["blocks-3", "blocks-5", "trees-3"]  # no pass needs the state of the last round
    seen = 0
    for b in spark.read.schema(boosting.STATE).parquet(f"{work}/blocks-5").toArrow().to_batches():
        for s, _, bx, by, _, p in boosting._blocks_of(b, 2):
            seen += len(by)
            for m in range(2):
                five = boosting.Boosted(models[s, m].base, models[s, m].trees[:5], [])
                assert p[m] == pytest.approx(five.predict(np.ascontiguousarray(bx.T)), abs=1e-12)
    assert seen == 600


def test_places_by_rows_and_by_features_follow_the_splits():
    rng = np.random.default_rng(4)
    t = Tree.empty(3)
    for i in (0, 1, 2, 4, 5):
        t.feature[i], t.bin[i] = rng.integers(3), rng.integers(200)
    x = rng.integers(0, 256, (500, 3)).astype(np.uint8)
    for depth in range(4):
        want = []
        for row in x:
            at = 0
            for _ in range(depth):
                at = 2 * at + 1 + int(row[t.feature[at]] > t.bin[at]) if t.feature[at] >= 0 else at
            want.append(at)
        assert t.places(x, depth).tolist() == t.places(np.ascontiguousarray(x.T).T, depth).tolist() == want


def test_a_pass_reads_bins_and_residuals_alone(spark, monkeypatch):
    """Labels, hashes and predictions are read once a round, not once a level."""
    _, _, df = table(spark, 300)
    read, run = [], boosting._run
    monkeypatch.setattr(boosting, "_run", lambda state, p: read.append((p.level, sorted(p.rows(state).columns))) or run(state, p))
    boost(df, [Spec(max_depth=3, rows=0.8)], 2, patience=5)
    assert {(0, "e"), (1, "g"), (2, "g")} <= {(level, c) for level, cols in read for c in cols}
    assert not {"y", "u", "p"} & {c for _, cols in read for c in cols}
    assert read[-1] == (0, ["e", "set"])  # after the last tree only errors are missing


@pytest.mark.parametrize("greatest", [100, boosting.NEAR - 1, boosting.NEAR, (1 << 31) - 1])
def test_rows_and_residuals_added_at_once_are_exact(greatest):
    rng = np.random.default_rng(5)
    n = boosting.BLOCK
    x, base = rng.integers(0, 4, (3, n)).astype(np.uint8), rng.integers(0, 2, n) * boosting.BINS
    for g in (rng.integers(-greatest, greatest, n, endpoint=True), np.full(n, greatest), np.full(n, -greatest)):
        h = np.zeros((3, 2, 2 * boosting.BINS))
        boosting._add(h, x, base, g.astype(np.int32), [0, 2])
        boosting._add(h, x, base, g.astype(np.int32), [0, 2])
        for f in (0, 2):
            for place in range(2 * boosting.BINS):
                mine = base + x[f] == place
                assert (h[f, 0, place], h[f, 1, place]) == (2 * mine.sum(), 2 * int(g[mine].sum()))
        assert not h[1].any()


def same_trees(got, want, x):
    assert got.keys() == want.keys()
    for sm, b in want.items():
        mine = got[sm]
        assert mine.base == b.base and len(mine.trees) == len(b.trees) and mine.errors[:len(b.errors)] == pytest.approx(b.errors)
        for t, u in zip(mine.trees, b.trees):
            for c in ("feature", "bin", "value", "gain"):
                assert (getattr(t, c) == getattr(u, c)).all()
        assert (mine.predict(x) == b.predict(x)).all()


def test_trees_grown_in_one_task_are_those_of_the_passes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 20, (900, 5)).astype(np.uint8)
    y = np.sin(x[:, 0]) + (x[:, 1] > x[:, 2]) + rng.random(900)
    rows = [(s, bytearray(x[i].tobytes()), float(y[i]), i % 5 == s and s < 2, i * 7919) for i in range(900) for s in range(3)]
    df = spark.createDataFrame(rows + rows[:40], "set int, x binary, y double, valid boolean, u long").repartition(7)
    specs = [Spec(max_depth=5, smoothing=3.0), Spec(max_depth=5, leaves=6, rows=0.8, features=0.6, smoothing=0.0, min_rows=20, step=0.5), Spec(max_depth=2, rows=0.7, step=1.0)]
    want = boost(df, specs, 9, patience=3)
    monkeypatch.setattr(boosting, "_run", lambda *a: pytest.fail("a pass over the table"))
    same_trees(boosting.train(df, specs, 9, patience=3), want, x)
    monkeypatch.undo()
    monkeypatch.setattr(boosting, "BLOCK", 64)  # many blocks
    same_trees(boosting.boost_held(df, specs, 9, patience=3, save_every=2), want, x)
    monkeypatch.undo()
    monkeypatch.setattr(boosting, "HELD_ROWS", 900)  # the first set has more rows
    monkeypatch.setattr(boosting, "boost_held", lambda *a, **k: pytest.fail("a set beyond the bound in one task"))
    same_trees(boosting.train(df, specs, 3), boost(df, specs, 3), x)


def test_training_in_one_task_resumes(spark, monkeypatch):
    x, _, df = table(spark, 300)
    specs = [Spec(max_depth=2, rows=0.8, features=0.7), Spec(max_depth=2, leaves=3)]
    want, work, save, grown = boost(df, specs, 5, patience=50), scratch_dir(spark, "resume"), boosting.save_trees, []

    def stopping(spark, path, models):
        save(spark, path, models)
        if path.endswith("held-4"):
            raise RuntimeError("lost")

    monkeypatch.setattr(boosting, "save_trees", stopping)
    with pytest.raises(RuntimeError, match="lost"):
        boosting.boost_held(df, specs, 5, patience=50, save_every=2, work=work)
    monkeypatch.undo()
    tree = boosting._Held.__init__
    monkeypatch.setattr(boosting._Held, "__init__", lambda self, *a: grown.append(a[2]) or tree(self, *a))
    same_trees(boosting.boost_held(df, specs, 5, patience=50, save_every=2, work=work), want, x)
    assert grown == [5]  # the last round alone


def test_registered_model_queries_train_at_the_reference_length(monkeypatch):
    """1000 rounds with patience 50 in cross-validation, 1200 final ones, three members of depth 7 each."""
    from types import SimpleNamespace

    from zonecast.ml.members import MemberConfig
    from zonecast.plans import modelling

    seen = []
    monkeypatch.setattr(modelling, "context", lambda spark, sf: SimpleNamespace(labelled_clean=SimpleNamespace(where=lambda c: c), train_clean="rows"))
    monkeypatch.setattr(modelling, "F", SimpleNamespace(col=lambda c: 0))
    monkeypatch.setattr(modelling, "cross_validate", lambda rows, holdout, cfg: seen.append(cfg))
    monkeypatch.setattr(modelling, "fit_final", lambda rows, cfg, rounds: seen.append((cfg, rounds)))
    e = modelling.Experiment(None, "none")
    e.cv, e.final
    assert seen == [MemberConfig(rounds=1000, patience=50), (MemberConfig(rounds=1000, patience=50), 1200)] == [MemberConfig(), (MemberConfig(), 1200)]
    assert [s.max_depth for s in MemberConfig().specs()] == [7, 7, 7]
