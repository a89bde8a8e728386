"""Gradient boosting on binned features: one histogram aggregation a tree level for all models at once.

Features are cut into at most ``BINS`` bins (one byte a value; quantiles of numbers, values of categories).  A pass
over the binned rows adds up, for every (model, node, feature, bin), the number of rows and their residuals; tasks
pre-aggregate, sums are dealt by node, and the best split of each node comes back to the driver: a few numbers a node.
A tree of depth 7 takes seven passes, and one pass serves the trees of all members and folds.

* The state table holds blocks of rows, features side by side, with their running predictions.  A round's trees are added
  to them once, and the table before is dropped.  The same step draws the next round's samples and writes its residuals, so a
  pass reads bins and residuals alone.  Every ``save_every`` rounds the trees are written and their state stays,
  so a run that stops resumes there.
* A round's validation errors come with the next round's first pass.  A model stops when ``patience`` rounds bring no
  better error and keeps its best prefix; no model is fitted again.
* ``leaves``: a tree is grown best-first up to that many leaves.  The gains of all nodes down to the greatest depth are
  known after its passes, so a queue of leaves by gain picks the splits that stay.
* Residuals are summed as integers of 2^-22 of the label's range, so results do not depend on partitions.
* ``train`` takes one of two ways to the same trees.  Where no set has more than ``HELD_ROWS`` rows, each model grows in one task that
  holds its set's rows: no job a level, and of two siblings only the smaller is counted, the other is what remains of their parent.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from zonecast.session import materialize, scratch_dir

BINS, UNIT = 64, 1 << 22
#: A category with more values than this is told by a hash of its values.
MAX_VALUES = BINS - 2
#: Rows of one set in a block of the state table.
BLOCK = 8192
#: Rows of a set, some 100 bytes each, up to which a model grows in one task, its rounds a job, and the rows worked on at once.
HELD_ROWS, HELD_ROUNDS, HELD_CHUNK = 6_000_000, 400, 1 << 16
#: The residual of a row that is not in a member's sample of the round.
SKIPPED = -1 << 31
#: What a row weighs beside its residual where both are added up at once: more than twice the residuals of a block, each below ``NEAR``.
ONE, NEAR = float(1 << 38), 1 << 24
_MIX, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1


# ---- bins

@dataclass(frozen=True)
class Binner:
    """``cuts``: for each numeric feature its ascending cut points; ``values``: for each category its ascending values, or
    None where they are hashed."""
    cuts: dict[str, list[float]]
    values: dict[str, list[str] | None]

    @property
    def features(self) -> list[str]:
        return [*self.cuts, *self.values]

    @staticmethod
    def fit(frame: DataFrame, numeric: list[str], categorical: list[str]) -> "Binner":
        """One pass for the quantiles (a mergeable sketch), one for the categories' values."""
        probabilities = [i / BINS for i in range(1, BINS)]
        found = frame.approxQuantile(numeric, probabilities, 0.25 / BINS)
        cuts = {c: sorted({x for x in q if x == x}) for c, q in zip(numeric, found)}
        pair = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in categorical]))
        pairs = materialize(frame.select(pair.alias("p")).select("p.*").distinct(), scratch_dir(frame.sparkSession, "bin-values"))
        count = {r["feature"]: r["count"] for r in pairs.groupBy("feature").count().collect()}
        values: dict[str, list[str] | None] = {c: [] if count.get(c, 0) <= MAX_VALUES else None for c in categorical}
        few = [c for c in categorical if values[c] is not None]
        for r in pairs.where(F.col("feature").isin(few)).collect():  # at most MAX_VALUES a feature
            values[r["feature"]].append(r["value"])
        return Binner(cuts, {c: v if v is None else sorted(v) for c, v in values.items()})

    def codes(self, b: pa.RecordBatch) -> np.ndarray:
        """The bins of a batch's rows, ``(rows, features)`` of one byte."""
        out = np.empty((b.num_rows, len(self.features)), np.uint8)
        for k, (c, cut) in enumerate(self.cuts.items()):
            x = b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
            out[:, k] = np.searchsorted(np.array(cut), x, "left")
        for k, (c, known) in enumerate(self.values.items(), len(self.cuts)):
            col = b.column(b.schema.get_field_index(c))
            if known is None:
                import zlib
                words = col.dictionary_encode(null_encoding="encode")
                code = np.array([1 + zlib.crc32(str(w).encode()) % MAX_VALUES for w in words.dictionary.to_pylist()], np.uint8)
                out[:, k] = code[words.indices.to_numpy()]
            else:  # an unseen value has a bin of its own
                out[:, k] = pc.add(pc.fill_null(pc.index_in(col, pa.array(known, pa.string())), -1), 1).to_numpy(zero_copy_only=False)
        return out

    def transform(self, frame: DataFrame) -> DataFrame:
        """``frame`` with its features replaced by their bins ``x``."""
        kept = [c for c in frame.columns if c not in set(self.features)]

        def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                x = self.codes(b)
                ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.tobytes())])
                yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], packed], names=[*kept, "x"])

        fields = [f for f in frame.schema.fields if f.name in set(kept)]
        return frame.select(*[F.col(f"`{c}`") for c in kept], *self.features).mapInArrow(rows, StructType(fields).add("x", "binary"))


def _codes(b: pa.RecordBatch) -> np.ndarray:
    """The bins ``x`` of a batch's rows: equal lengths, so one block of bytes."""
    col = b.column(b.schema.get_field_index("x")).cast(pa.large_binary())
    at = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(len(col), -1)


# ---- trees

@dataclass(frozen=True)
class Spec:
    """How a member grows its trees."""
    max_depth: int = 7
    leaves: int | None = None
    rows: float = 1.0
    features: float = 1.0
    smoothing: float = 1.0
    min_rows: int = 1
    step: float = 0.05


@dataclass
class Tree:
    """Nodes in heap order (the children of i are 2i + 1 and 2i + 2): a split's feature and greatest bin to the left, or
    feature -1 and the leaf's value; ``gain`` of each split."""
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = (2 << depth) - 1
        return Tree(np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n), np.zeros(n))

    def places(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row reaches within ``depth`` levels; ``x`` ``(rows, features)`` may lie by rows or by features."""
        n, width = x.shape
        if not depth or self.feature[0] < 0:
            return np.zeros(n, np.intp)
        flat, start, stride = (x.reshape(-1), np.arange(n) * width, 1) if x.flags.c_contiguous else (np.ascontiguousarray(x.T).reshape(-1), np.arange(n), n)
        inner = self.feature >= 0
        offset = np.where(inner, self.feature, 0).astype(np.intp) * stride
        child = np.where(inner, 2 * np.arange(len(inner)) + 1, np.arange(len(inner)))
        cut = np.where(inner, self.bin, 255).astype(np.uint8)  # a leaf's rows stay
        at = 1 + (x[:, self.feature[0]] > self.bin[0]).astype(np.intp)
        for _ in range(depth - 1):
            right = flat.take(offset.take(at) + start) > cut.take(at)
            at = child.take(at)
            at += right
        return at

    @property
    def depth(self) -> int:
        return int(len(self.feature) + 1).bit_length() - 2


def best_first(tree: Tree, leaves: int) -> None:
    """Keeps the splits that growth by greatest gain makes until there are ``leaves`` leaves."""
    queue = [(-tree.gain[0], 0)] if tree.feature[0] >= 0 else []
    kept, n = set(), 1
    while queue and n < leaves:
        _, i = heapq.heappop(queue)
        kept.add(i)
        n += 1
        for child in (2 * i + 1, 2 * i + 2):
            if child < len(tree.feature) and tree.feature[child] >= 0:
                heapq.heappush(queue, (-tree.gain[child], child))
    for i in np.flatnonzero(tree.feature >= 0).tolist():
        if i not in kept:
            tree.feature[i], tree.gain[i] = -1, 0.0


@dataclass
class Boosted:
    """One model: the label's mean and its trees; ``errors``: the mean squared validation error after each round."""
    base: float
    trees: list[Tree]
    errors: list[float]

    def predict(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """The sum of the trees from ``first`` on, with the base if that is 0."""
        out = np.full(len(x), self.base if first == 0 else 0.0)
        for t in self.trees[first:]:
            out += t.value[t.places(x, t.depth)]
        return out


def best_rounds(errors: list[float], patience: int | None) -> int:
    """Rounds kept by early stopping: stop once ``patience`` rounds pass without
    a new best validation error; keep the best round."""
    best_i, best = 0, float("inf")
    for i, e in enumerate(errors):
        if e < best:
            best_i, best = i, e
        elif patience is not None and i - best_i >= patience:
            break
    return best_i + 1


# ---- growing

@dataclass(frozen=True)
class _Round:
    """What the state holds for a round's passes: the residuals of the rows that are drawn, and the validation errors so far."""
    number: int
    specs: list[Spec]
    scale: float

    def drawn(self, u: np.ndarray, member: int) -> np.ndarray:
        """Rows of this round's sample."""
        h = u.view(np.uint64) + np.uint64((self.number * len(self.specs) + member + 1) * _MIX & _WORD)
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return (h ^ h >> np.uint64(31)).astype(np.float64) / 2.0 ** 64 < self.specs[member].rows

    def columns(self, valid: bool, y: np.ndarray, u: np.ndarray, p: np.ndarray) -> tuple[bytes, bytes]:
        """``g`` and ``e`` of a block."""
        if valid:
            return b"", np.array([len(y), *[((y - q) ** 2).sum() for q in p]], np.float64).tobytes()
        with np.errstate(invalid="ignore"):
            g = np.rint((y - p) * self.scale).astype(np.int32)
        for m, spec in enumerate(self.specs):
            if spec.rows < 1:
                g[m, ~self.drawn(u, m)] = SKIPPED
        return g.tobytes(), b""


def _add(h: np.ndarray, x: np.ndarray, base: np.ndarray, g: np.ndarray, features: list[int]) -> None:
    """Adds the rows and residuals ``g`` of a block to ``h (features, 2, places)``, at ``base`` and the bin ``x`` of each feature.
    A row weighs ``ONE`` and its residual, so one count gives both; whole numbers below 2^53, so the sums are exact."""
    at, size = np.empty_like(base), h.shape[2]
    near = len(g) <= BLOCK and -NEAR < g.min() and g.max() < NEAR
    w = g + (ONE if near else 0.0)
    for f in features:
        np.add(base, x[f], out=at)
        s = np.bincount(at, w, size)
        if near:
            n = np.rint(s / ONE)
            s -= n * ONE
        else:
            n = np.bincount(at, minlength=size)
        h[f, 0] += n
        h[f, 1] += s


def _splits(h: np.ndarray, spec: Spec, allowed: np.ndarray, scale: float) -> tuple[np.ndarray, ...]:
    """Of each node of ``h (features, 2, nodes, BINS)``: rows, residuals, and the feature (-1: no split), greatest bin to the left, gain,
    rows and residuals to the left of its best split."""
    own = np.flatnonzero(allowed)
    n, s = (np.cumsum(h[own, i], axis=2).astype(float) for i in range(2))
    s /= scale
    all_n, all_s = n[0, :, -1], s[0, :, -1]  # the same by any feature
    rest_n, rest_s = all_n[:, None] - n, all_s[:, None] - s
    with np.errstate(invalid="ignore", divide="ignore"):  # an empty side is no split
        gain = s ** 2 / (n + spec.smoothing) + rest_s ** 2 / (rest_n + spec.smoothing) - (all_s ** 2 / (all_n + spec.smoothing))[:, None]
    gain[(n < spec.min_rows) | (rest_n < spec.min_rows)] = 0
    nodes = np.arange(len(all_n))
    f, cut = np.divmod(gain.transpose(1, 0, 2).reshape(len(nodes), -1).argmax(axis=1), BINS)
    best = gain[f, nodes, cut]
    return all_n, all_s, np.where(best > 1e-12, own[f], -1), cut, best, n[f, nodes, cut], s[f, nodes, cut]


@dataclass(frozen=True)
class _Pass:
    """What a task needs: the partial trees by (set, member), the features each may split by and the level."""
    partial: dict[tuple[int, int], Tree]
    allowed: dict[int, np.ndarray]
    level: int
    specs: list[Spec]
    width: int
    scale: float

    def rows(self, state: DataFrame) -> DataFrame:
        """The blocks and columns that this pass reads; validation rows have errors only."""
        if self.level:
            return state.where(~F.col("valid")).select("set", "x", "g")
        return state.select("set", "x", "g", "e") if self.partial else state.where("valid").select("set", "e")

    def histograms(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``key, data``: for each (set, member, node) of this level the rows and residuals by feature and bin; and, at
        the first level, for each (set, member) with key -1 - model the validation rows and their squared error."""
        n_nodes, low = 1 << self.level, (1 << self.level) - 1
        size = (n_nodes + 1) * BINS  # the last node takes the rows that are not drawn or lie in a finished leaf
        sums: dict[int, np.ndarray] = {}
        errors: dict[int, np.ndarray] = {}
        for b in it:
            for s, x, g, e in _passed(b, self.width, len(self.specs)):
                for m, spec in enumerate(self.specs):
                    model = s * len(self.specs) + m
                    if model not in self.allowed:
                        continue
                    if len(e):
                        sum_e = errors.setdefault(model, np.zeros(2))
                        sum_e += e[0], e[1 + m]
                        continue
                    if (s, m) not in self.partial:
                        continue
                    base = self.partial[s, m].places(x.T, self.level) - low
                    base[base < 0] = n_nodes
                    mine = g[m]
                    if spec.rows < 1:
                        out = mine == SKIPPED
                        base[out], mine = n_nodes, np.where(out, 0, mine)
                    base *= BINS
                    h = sums.setdefault(model, np.zeros((self.width, 2, size)))
                    _add(h, x, base, mine, np.flatnonzero(self.allowed[model]).tolist())
        keys, data = [], []
        for model, h in sums.items():
            h = h.reshape(self.width, 2, n_nodes + 1, BINS)
            for node in np.flatnonzero(h[self.counted(model), 0, :n_nodes].sum(axis=1)).tolist():
                keys.append(model * n_nodes + node)
                data.append(pa.compress(np.ascontiguousarray(h[:, :, node]).astype("<i8").tobytes(), "lz4", asbytes=True))
        for model, e in errors.items():
            keys.append(-1 - model)
            data.append(e.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=["key", "data"])

    def counted(self, model: int) -> int:
        """A feature that the model's rows are counted by."""
        return int(np.flatnonzero(self.allowed[model])[0])

    def best(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``SPLIT`` of each key; the sums of all tasks are added first."""
        size, total = self.width * 2 * BINS * 8, {}
        for b in it:
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one = np.frombuffer(data) if key < 0 else np.frombuffer(pa.decompress(data, size, "lz4", asbytes=True), "<i8").reshape(self.width, 2, BINS)
                total[key] = total[key] + one if key in total else one
        rows = []
        for key, h in sorted(total.items()):
            if key < 0:
                rows.append((key, h[0], h[1], -1, 0, 0.0, 0.0, 0.0))
                continue
            model = key >> self.level
            n, s, f, cut, gain, left_n, left_s = (v[0].item() for v in _splits(h[:, :, None], self.specs[model % len(self.specs)], self.allowed[model], self.scale))
            rows.append((key, n, s, f, cut, gain, left_n, left_s))
        out = list(zip(*rows)) or [[]] * 8
        types = (pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["key", "n", "s", "feature", "bin", "gain", "left_n", "left_s"])


SPLIT = "key long, n double, s double, feature int, bin int, gain double, left_n double, left_s double"


def _run(state: DataFrame, p: _Pass) -> list:
    tasks = max(1, (len(p.allowed) << p.level) // 64)  # some dozens of nodes a task
    return p.rows(state).mapInArrow(p.histograms, "key long, data binary").repartition(tasks, "key").mapInArrow(p.best, SPLIT).collect()  # a few numbers a node


def _grow(state: DataFrame, models: list, active: list, rnd: int, specs: list[Spec], width: int, scale: float, seed: int) -> tuple[dict, dict]:
    """The validation errors of ``models`` so far, and one more tree for each of the ``active`` ones."""
    partial = {sm: Tree.empty(specs[sm[1]].max_depth) for sm in active}
    allowed = {}
    for s, m in models:
        allowed[s * len(specs) + m] = _drawn_features(seed, rnd, s, m, specs[m], width)
    errors: dict[tuple[int, int], float] = {}
    level, splits = 0, True
    while splits and (level == 0 or level < max(s.max_depth for s in specs)):
        splits = False
        for r in _run(state, _Pass(partial, allowed, level, specs, width, scale)):
            if r["key"] < 0:
                errors[divmod(-1 - r["key"], len(specs))] = r["s"] / max(r["n"], 1)
                continue
            sm = divmod(r["key"] >> level, len(specs))
            tree, spec, i = partial[sm], specs[sm[1]], (1 << level) - 1 + r["key"] % (1 << level)
            leaf = lambda n, s: spec.step * s / max(n + spec.smoothing, 1e-9)  # noqa: B023, E731
            if level == 0:
                tree.value[0] = leaf(r["n"], r["s"])
            if r["feature"] >= 0 and level < spec.max_depth:
                tree.feature[i], tree.bin[i], tree.gain[i] = r["feature"], r["bin"], r["gain"]
                tree.value[2 * i + 1], tree.value[2 * i + 2] = leaf(r["left_n"], r["left_s"]), leaf(r["n"] - r["left_n"], r["s"] - r["left_s"])
                splits = True
        level += 1
    return errors, partial


def _start(binned: DataFrame, k: int) -> tuple[dict[tuple[int, int], Boosted], int, float]:
    """The models without trees, the number of features and the units of a residual."""
    start = binned.where(~F.col("valid")).groupBy("set").agg(F.avg("y").alias("base"), F.min("y").alias("lo"), F.max("y").alias("hi")).orderBy("set").collect()
    if not start:
        raise ValueError("no rows to train on")
    models = {(r["set"], m): Boosted(r["base"], [], []) for r in start for m in range(k)}
    return models, len(binned.select("x").first()["x"]), UNIT / (max(r["hi"] for r in start) - min(r["lo"] for r in start) or 1.0)


def _stops(errors: list[float], patience: int | None) -> bool:
    return patience is not None and bool(errors) and len(errors) - 1 - int(np.argmin(errors)) >= patience


def _drawn_features(seed: int, rnd: int, s: int, m: int, spec: Spec, width: int) -> np.ndarray:
    """Whether each feature is in a tree's sample."""
    drawn = np.random.default_rng([seed, rnd, s, m]).permutation(width)[:max(1, round(spec.features * width))]
    return np.isin(np.arange(width), drawn)


def train(binned: DataFrame, specs: list[Spec], rounds: int, patience: int | None = None, seed: int = 42, work: str | None = None) -> dict[tuple[int, int], Boosted]:
    """The models of ``boost``, grown in tasks that hold their rows where no set has more than ``HELD_ROWS``."""
    most = binned.groupBy("set").count().agg(F.max("count")).first()[0] or 0
    if most > HELD_ROWS or work and _saved_round(binned.sparkSession, work):
        return boost(binned, specs, rounds, patience, seed, work=work)
    return boost_held(binned, specs, rounds, patience, seed, work=work)


def boost(binned: DataFrame, specs: list[Spec], rounds: int, patience: int | None = None, seed: int = 42, save_every: int = 10,
          work: str | None = None) -> dict[tuple[int, int], Boosted]:
    """The models by (set, member) of ``binned (set, x, y, valid, u)``: rows with ``valid`` are a set's validation rows, ``u`` is a
    hash that draws samples.  ``work``: a folder to which state and trees go every ``save_every`` rounds and from which
    a run that was stopped resumes."""
    spark, k = binned.sparkSession, len(specs)
    work = work or scratch_dir(spark, "boosting")
    models, width, scale = _start(binned, k)
    done = _saved_round(spark, work)
    if done:
        load_trees(spark, f"{work}/trees-{done}", models)
        state = spark.read.schema(STATE).parquet(f"{work}/blocks-{done}")
    else:
        state = _written(_blocks(binned, {sm: b.base for sm, b in models.items()}, _Round(0, specs, scale)), f"{work}/blocks-0")
    rnd = saved = done
    while True:
        current = [sm for sm, b in models.items() if len(b.trees) == rnd]  # the others have stopped
        active = current if rnd < rounds else []
        if not active and (patience is None or not current):
            break
        errors, partial = _grow(state, current, active, rnd, specs, width, scale, seed)
        for sm, e in errors.items():
            if len(models[sm].errors) < rnd:
                models[sm].errors.append(e)
        grown = {}
        for sm, tree in partial.items():
            b = models[sm]
            if _stops(b.errors, patience):
                continue
            if specs[sm[1]].leaves:
                best_first(tree, specs[sm[1]].leaves)
            b.trees.append(tree)
            grown[sm] = tree
        rnd += 1
        if rnd > rounds:
            break
        if grown and (rnd < rounds or patience is not None):
            state = _written(_advanced(state, grown, _Round(rnd, specs, scale)), f"{work}/blocks-{rnd}")
            if rnd - 1 != saved or rnd == 1:
                _drop(spark, f"{work}/blocks-{rnd - 1}")
            if rnd % save_every == 0 and rnd < rounds:
                save_trees(spark, f"{work}/trees-{rnd}", models)
                if saved:
                    _drop(spark, f"{work}/blocks-{saved}")
                saved = rnd
    return _cut(models, patience)


def _cut(models: dict[tuple[int, int], Boosted], patience: int | None) -> dict[tuple[int, int], Boosted]:
    """Each model's best prefix."""
    for b in models.values():
        if patience is not None and b.errors:
            del b.trees[best_rounds(b.errors, patience):]
    return models


# ---- growing in one task a model


@dataclass(frozen=True)
class _Held:
    """What a task needs that grows a model of ``models`` up to ``upto`` rounds over all rows of its set."""
    models: object  # a broadcast: (set, member) -> Boosted
    specs: list[Spec]
    upto: int
    patience: int | None
    width: int
    scale: float
    seed: int

    def grow(self, it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``GROWN`` rows of one more tree each, from blocks ``model, valid, x, y, u`` of one model."""
        parts: dict[bool, list] = {False: [], True: []}
        model = None
        for b in it:
            col = lambda c, i, t: np.frombuffer(b.column(b.schema.get_field_index(c))[i].as_buffer(), t)  # noqa: B023, E731
            for i, (model, valid) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("model", "valid")))):
                parts[valid].append((col("x", i, np.uint8).reshape(self.width, -1), col("y", i, np.float64), col("u", i, np.int64)))
        if model is None:
            return
        s, m = divmod(model, len(self.specs))
        x, y, u = (np.concatenate([p[j] for v in (False, True) for p in parts[v]], axis=-1) for j in range(3))
        n = sum(len(p[1]) for p in parts[False])  # training rows come first
        del parts
        before, spec = self.models.value[s, m], self.specs[m]
        errors, p, chunks = list(before.errors), np.full(len(y), before.base), range(0, len(y), HELD_CHUNK)

        def add(t: Tree) -> None:
            for lo in chunks:
                p[lo:lo + HELD_CHUNK] += t.value.take(t.places(x[:, lo:lo + HELD_CHUNK].T, t.depth))

        for t in before.trees:
            add(t)
        g = np.empty(n, np.int32)
        for rnd in range(len(before.trees), self.upto):
            drawn, rows = _Round(rnd, self.specs, self.scale), []
            for lo in range(0, n, HELD_CHUNK):
                hi = min(lo + HELD_CHUNK, n)
                with np.errstate(invalid="ignore"):
                    g[lo:hi] = np.rint((y[lo:hi] - p[lo:hi]) * self.scale).astype(np.int32)
                rows.append(np.arange(lo, hi, dtype=np.int32) if spec.rows >= 1 else (lo + np.flatnonzero(drawn.drawn(u[lo:hi], m))).astype(np.int32))
            t = self.tree(x, g, np.concatenate(rows), spec, _drawn_features(self.seed, rnd, s, m, spec, self.width))
            add(t)
            # summed exactly, so the order of the rows does not matter
            squares = ((y[lo:lo + HELD_CHUNK] - p[lo:lo + HELD_CHUNK]) ** 2 for lo in range(n, len(y), HELD_CHUNK))
            error = math.fsum(e for some in squares for e in some.tolist()) / (len(y) - n) if len(y) > n else None
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((s, m, rnd, error, *(c.tobytes() for c in (t.feature, t.bin, t.value, t.gain))), GROWN)],
                                             schema=GROWN)
            if error is not None:
                errors.append(error)
                if _stops(errors, self.patience):
                    return

    def tree(self, x: np.ndarray, g: np.ndarray, rows: np.ndarray, spec: Spec, allowed: np.ndarray) -> Tree:
        """The tree that ``_grow`` grows level by level, over the rows ``rows`` of ``x (features, rows)``."""
        tree, features, flat, width = Tree.empty(spec.max_depth), np.flatnonzero(allowed).tolist(), x.reshape(-1), x.shape[1]
        leaf = lambda n, s: spec.step * s / np.maximum(n + spec.smoothing, 1e-9)
        nodes, at = np.zeros(1, np.intp), np.zeros(len(rows), np.int32)  # places in the tree; each row's in ``nodes``
        h = _counted(x, g, rows, at, features, 1)
        for level in range(spec.max_depth if len(rows) else 0):
            n, s, f, cut, gain, left_n, left_s = _splits(h, spec, allowed, self.scale)
            if level == 0:
                tree.value[0] = leaf(n, s)[0]
            split = f >= 0
            i = nodes[split]
            tree.feature[i], tree.bin[i], tree.gain[i] = f[split], cut[split], gain[split]
            tree.value[2 * i + 1], tree.value[2 * i + 2] = leaf(left_n, left_s)[split], leaf(n - left_n, s - left_s)[split]
            if level + 1 == spec.max_depth or not len(i):
                break
            keep = split[at]
            rows, at = rows[keep], at[keep]
            offset, left = f * width, 2 * (np.cumsum(split) - 1)
            for lo in range(0, len(rows), HELD_CHUNK):
                a = at[lo:lo + HELD_CHUNK]
                at[lo:lo + HELD_CHUNK] = left[a] + (flat.take(offset[a] + rows[lo:lo + HELD_CHUNK]) > cut[a])
            least = 2 * np.arange(len(i)) + (2 * left_n > n)[split]  # of each two siblings the one with fewer rows
            mine = np.zeros(2 * len(i), bool)
            mine[least] = True
            few = mine[at]
            one = _counted(x, g, rows[few], at[few] >> 1, features, len(i))
            both, h = h[:, :, split], np.empty((len(x), 2, 2 * len(i), BINS))
            h[:, :, least], h[:, :, least ^ 1] = one, both - one
            nodes = np.stack([2 * i + 1, 2 * i + 2], axis=1).ravel()
        if spec.leaves:
            best_first(tree, spec.leaves)
        return tree


def _counted(x: np.ndarray, g: np.ndarray, rows: np.ndarray, at: np.ndarray, features: list[int], nodes: int) -> np.ndarray:
    """Rows and residuals ``(features, 2, nodes, BINS)`` of the rows ``rows`` that lie in the nodes ``at``."""
    h = np.zeros((len(x), 2, nodes * BINS))
    for lo in range(0, len(rows), BLOCK):
        r = rows[lo:lo + BLOCK]
        _add(h, x[:, r[0]:r[-1] + 1] if r[-1] - r[0] == len(r) - 1 else x.take(r, axis=1), at[lo:lo + BLOCK].astype(np.intp) * BINS, g[r], features)
    return h.reshape(len(x), 2, nodes, BINS)


GROWN = pa.schema([("set", pa.int32()), ("member", pa.int32()), ("round", pa.int32()), ("error", pa.float64()),
                   *[(c, pa.binary()) for c in ("feature", "bin", "value", "gain")]])


def boost_held(binned: DataFrame, specs: list[Spec], rounds: int, patience: int | None = None, seed: int = 42, save_every: int = HELD_ROUNDS,
               work: str | None = None) -> dict[tuple[int, int], Boosted]:
    """The models of ``boost``, each grown by one task at a time that holds its set's rows.  ``work``: a folder to which the trees go every
    ``save_every`` rounds and from which a run that was stopped resumes."""
    spark, k = binned.sparkSession, len(specs)
    work = work or scratch_dir(spark, "boosting")
    models, width, scale = _start(binned, k)
    upto = _last_whole(spark, work, "held")
    if upto:
        load_trees(spark, f"{work}/held-{upto}", models)
    first = _Round(0, specs, scale)
    rows = materialize(_blocks(binned, {sm: b.base for sm, b in models.items()}, first).select("set", "valid", "x", "y", "u"), f"{work}/rows")
    while active := [sm for sm, b in models.items() if len(b.trees) < rounds and not _stops(b.errors, patience)]:
        upto = min(upto + save_every, rounds)
        shared = spark.sparkContext.broadcast({sm: models[sm] for sm in active})
        task = _Held(shared, specs, upto, patience, width, scale, seed)
        places = F.create_map(*[F.lit(v) for i, (s, m) in enumerate(active) for v in (s * k + m, i)])
        model = F.explode(F.array(*[F.col("set") * k + m for m in range(k)]))
        dealt = rows.select(model.alias("model"), "valid", "x", "y", "u").withColumn("place", F.element_at(places, F.col("model"))).where("place is not null")
        grown = dealt.repartitionById(len(active), F.col("place")).drop("place").mapInArrow(
            task.grow, "set int, member int, round int, error double, feature binary, bin binary, value binary, gain binary").collect()  # 5 kB a tree
        for r in sorted(grown, key=lambda r: r["round"]):
            b = models[r["set"], r["member"]]
            b.trees.append(Tree(*(np.frombuffer(r[c], t).copy() for c, t in (("feature", np.int16), ("bin", np.uint8), ("value", float), ("gain", float)))))
            if r["error"] is not None:
                b.errors.append(r["error"])
        shared.destroy()
        if upto < rounds:
            save_trees(spark, f"{work}/held-{upto}", models)
    _drop(spark, f"{work}/rows")
    return _cut(models, patience)


# ---- the state table

#: Blocks of rows of one set, for training or for validation: the bytes of ``x`` by feature, of the doubles ``y``, the
#: hashes ``u`` and the running predictions ``p`` by member; for the next passes, of training rows the int residuals ``g`` by member
#: (``SKIPPED`` where not drawn), of validation rows their number and their squared errors by member, ``e``.
STATE = "set int, valid boolean, x binary, y binary, u binary, p binary, g binary, e binary"


def _blocks_of(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each block's set, ``valid``, ``x (features, rows)``, ``y``, ``u`` and ``p (members, rows)``."""
    col = {c: b.column(b.schema.get_field_index(c)) for c in ("set", "valid", "x", "y", "u", "p")}
    for i in range(b.num_rows):
        x, y, u, p = (np.frombuffer(col[c][i].as_buffer(), t) for c, t in (("x", np.uint8), ("y", np.float64), ("u", np.int64), ("p", np.float64)))
        yield col["set"][i].as_py(), col["valid"][i].as_py(), x.reshape(-1, len(y)), y, u, p.reshape(k, len(y))


def _passed(b: pa.RecordBatch, width: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Each block's set, ``x (features, rows)``, ``g (members, rows)`` and ``e``; columns that a pass does not read are empty."""
    def values(c: str, i: int, t: type) -> np.ndarray:
        at = b.schema.get_field_index(c)
        return np.frombuffer(b.column(at)[i].as_buffer(), t) if at >= 0 else np.empty(0, t)

    for i, s in enumerate(b.column(b.schema.get_field_index("set")).to_pylist()):
        yield s, values("x", i, np.uint8).reshape(width, -1), values("g", i, np.int32).reshape(k, -1), values("e", i, np.float64)


def _blocks(binned: DataFrame, bases: dict[tuple[int, int], float], first: _Round) -> DataFrame:
    """The rows of ``binned`` in blocks, predictions at the sets' bases."""
    names, k = STATE.replace(",", "").split()[::2], len(first.specs)

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, bool], list] = {}

        def block(s: int, v: bool, x: np.ndarray, y: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
            y, u = y.astype(np.float64), u.astype(np.int64)
            p = np.repeat([bases[s, m] for m in range(k)], len(y)).reshape(k, -1)
            data = [np.ascontiguousarray(x.T).tobytes(), y.tobytes(), u.tobytes(), p.tobytes(), *first.columns(v, y, u, p)]
            return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([v]), *[pa.array([d], pa.binary()) for d in data]], names=names)

        for b in it:
            col = lambda c: b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            x, y, u, sets, valid = _codes(b), col("y"), col("u"), col("set"), col("valid").astype(bool)
            for s in np.unique(sets).tolist():
                for v in (False, True):
                    mine = np.flatnonzero((sets == s) & (valid == v))
                    if (s, 0) not in bases or not len(mine):  # a set without training rows has no model
                        continue
                    parts = waiting.setdefault((s, v), [])
                    parts.append((x[mine], y[mine], u[mine]))
                    if sum(len(q[1]) for q in parts) >= BLOCK:
                        whole = [np.concatenate(c) for c in zip(*parts)]
                        full = len(whole[1]) // BLOCK * BLOCK
                        for i in range(0, full, BLOCK):
                            yield block(s, v, *[c[i:i + BLOCK] for c in whole])
                        waiting[s, v] = [tuple(c[full:] for c in whole)]
        for (s, v), parts in waiting.items():
            whole = [np.concatenate(c) for c in zip(*parts)]
            if len(whole[1]):
                yield block(s, v, *whole)

    return binned.mapInArrow(blocks, STATE)


def _advanced(state: DataFrame, grown: dict[tuple[int, int], Tree], after: _Round) -> DataFrame:
    """The state with the predictions of one more tree a model added, for the round ``after``; sets without one have stopped and are
    left out."""
    sets, k = sorted({s for s, _ in grown}), len(after.specs)

    def blocks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new: dict[str, list[bytes]] = {"p": [], "g": [], "e": []}
            for s, valid, x, y, u, p in _blocks_of(b, k):
                p = p.copy()
                for m in range(k):
                    if (s, m) in grown:
                        t = grown[s, m]
                        p[m] += t.value.take(t.places(x.T, t.depth))
                for c, data in zip(new, (p.tobytes(), *after.columns(valid, y, u, p))):
                    new[c].append(data)
            kept = [b.column(b.schema.get_field_index(c)) for c in before]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(d, pa.binary()) for d in new.values()]], names=[*before, *new])

    before = ["set", "valid", "x", "y", "u"]
    return state.where(F.col("set").isin(sets)).select(*before, "p").mapInArrow(blocks, STATE)


def _written(state: DataFrame, path: str) -> DataFrame:
    state.write.mode("overwrite").parquet(path)
    return state.sparkSession.read.schema(STATE).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    """Removes a table of this run that no later pass reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# ---- saved trees

TREES = "set int, member int, round int, base double, error double, feature array<int>, bin array<int>, value array<double>, gain array<double>"


def save_trees(spark: SparkSession, path: str, models: dict[tuple[int, int], Boosted]) -> None:
    rows = []
    for (s, m), b in models.items():
        rows.append((s, m, -1, b.base, None, None, None, None, None))
        for r in range(max(len(b.trees), len(b.errors))):
            t = b.trees[r] if r < len(b.trees) else None
            parts = [None] * 4 if t is None else [t.feature.tolist(), t.bin.tolist(), t.value.tolist(), t.gain.tolist()]
            rows.append((s, m, r, None, b.errors[r] if r < len(b.errors) else None, *parts))
    spark.createDataFrame(rows, TREES).coalesce(1).write.mode("overwrite").parquet(path)


def load_trees(spark: SparkSession, path: str, models: dict[tuple[int, int], Boosted]) -> None:
    """Fills ``models`` from a saved table of trees."""
    for r in spark.read.schema(TREES).parquet(path).orderBy("set", "member", "round").collect():
        if r["round"] < 0:  # comes first
            models[r["set"], r["member"]] = Boosted(r["base"], [], [])
            continue
        b = models[r["set"], r["member"]]
        if r["feature"] is not None:
            b.trees.append(Tree(np.array(r["feature"], np.int16), np.array(r["bin"], np.uint8), np.array(r["value"]), np.array(r["gain"])))
        if r["error"] is not None:
            b.errors.append(r["error"])


def _whole(spark: SparkSession, work: str) -> set[str]:
    """The names of the tables in ``work`` that were written to the end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(work)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return set()
    return {f.getPath().getName() for f in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))}


def _last_whole(spark: SparkSession, work: str, name: str, *beside: str) -> int:
    """The greatest number of a whole table ``name`` in ``work`` that has those ``beside`` it, else 0."""
    whole = _whole(spark, work)
    rounds = [int(n.split("-")[1]) for n in whole if n.startswith(f"{name}-") and all(f"{b}-{n.split('-')[1]}" in whole for b in beside)]
    return max(rounds, default=0)


def _saved_round(spark: SparkSession, work: str) -> int:
    """The last round whose state and trees are complete in ``work``, else 0."""
    return _last_whole(spark, work, "trees", "blocks")


def save_binner(spark: SparkSession, path: str, binner: Binner) -> None:
    rows = [(k, c, cut, None, False) for k, (c, cut) in enumerate(binner.cuts.items())]
    rows += [(k, c, None, v, True) for k, (c, v) in enumerate(binner.values.items(), len(rows))]
    spark.createDataFrame(rows, BINNER).coalesce(1).write.mode("overwrite").parquet(path)


def load_binner(spark: SparkSession, path: str) -> Binner:
    rows = spark.read.schema(BINNER).parquet(path).orderBy("place").collect()
    return Binner({r["feature"]: r["cuts"] for r in rows if not r["category"]}, {r["feature"]: r["vals"] for r in rows if r["category"]})


BINNER = "place int, feature string, cuts array<double>, vals array<string>, category boolean"


# ---- scoring

def predict(rows: DataFrame, models: dict[tuple[int, int], Boosted], names: list[str], of: str | None = None, binner: Binner | None = None,
            features: bool = True) -> DataFrame:
    """``rows`` with ``names``: the predictions of each member, of the set in column ``of`` (else of set 0).  Rows hold bins ``x``,
    which are dropped, or with ``binner`` the features, which stay unless ``features`` is False."""
    shared = rows.sparkSession.sparkContext.broadcast((models, binner))  # trees of 255 nodes
    dropped = {"x"} if binner is None else set() if features else set(binner.features)
    kept = [f for f in rows.schema.fields if f.name not in dropped]

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bins = shared.value
        for b in it:
            x = bins.codes(b) if bins else _codes(b)
            sets = b.column(b.schema.get_field_index(of)).to_numpy() if of else np.zeros(b.num_rows, np.int64)
            out = np.zeros((len(names), b.num_rows))
            for s in np.unique(sets).tolist():
                mine = np.flatnonzero(sets == s)
                for m in range(len(names)):
                    out[m, mine] = held[s, m].predict(x[mine])
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(f.name)) for f in kept], *map(pa.array, out)],
                                             names=[*[f.name for f in kept], *names])

    schema = StructType(list(kept))
    for n in names:
        schema = schema.add(n, "double")
    return rows.mapInArrow(score, schema)
