"""Boosted regression trees as MLlib's models: all rounds of a target in one task, rows scored in blocks.

MLlib runs a job for every level of every tree, and most of a round is the starting of jobs. Rows with
the same bin in every input cannot be told apart by a tree, so they are one row here, with a mean and a
weight. Up to ``ROWS`` of them are fitted by one task a target, which keeps some 45 bytes a row; more
are left to MLlib, which spreads them. Bins, splits and steps are those of MLlib. Rows that it would fit
in one piece are added up in its order, so that even splits that differ by rounding only fall as they do
there; of more rows, where that hangs on the order in which its pieces meet, the first input counts.

To score, every bin of an input tells which leaves of a tree it leaves open, as one bit for each leaf;
what all inputs leave open is the leaf of the row. That is a few look-ups a tree for a block of rows,
where MLlib goes down each tree row by row.
"""

from __future__ import annotations

import json
import math
import sys
import time
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fiscus.session import materialize, shared_folder

# The tasks get this module's code with the job: unlike those of ``fiscus.llm``, their workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most rows, after equal ones are one, that a task fits alone; most different numbers of all inputs together; most bins of an input.
ROWS = 4_000_000
VALUES = 1 << 18
BINS = 1 << 12
#: Rows in a piece of what MLlib fits, and most rows that are added up in its order.
ROWS_EACH = 50_000
IN_ORDER = ROWS_EACH
#: Combinations of values that are counted at a time for each node, and rows that are worked on at a time.
CELLS = 2048
BLOCK = 1 << 17
#: Shares of a gain, and of the sum of squares, below which two results differ by rounding only.
NEAR, ROUNDING = 1e-9, 1e-14
#: A node with less variance is not split.
NO_SPREAD = float(np.finfo(float).eps)
#: Most leaves of a tree that is scored by bits.
LEAVES = 32
#: A number whose 32 runs of five bits all differ, and the place where each of them starts.
BITS = 0x077CB531
PLACES = np.argsort([(BITS << k & 0xFFFFFFFF) >> 27 for k in range(LEAVES)])

MODEL = "org.apache.spark.ml.regression.GBTRegressionModel"
TREE = "org.apache.spark.ml.regression.DecisionTreeRegressionModel"
#: What MLlib stores of a node, and the settings that it stores with a tree.
NODES = (
    "treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,"
    "gain:double,leftChild:int,rightChild:int,"
    "split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>"
)
TREE_SETTINGS = ("featuresCol", "labelCol", "maxBins", "maxDepth", "predictionCol", "seed", "weightCol")

_SPLIT = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
_NODE = pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
    ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", _SPLIT),
])


def fit_all(rows: DataFrame, makers: Sequence[GBTRegressor]) -> list[GBTRegressionModel]:
    """A model for each of ``makers``, which differ by their label; all are fitted at the same time.

    ``rows`` is a stored table. Of the makers' settings the columns, rounds, depth, bins and step count, the
    others are MLlib's defaults: squared error, all rows and inputs for every tree, one row a leaf at least.
    """
    first = makers[0]
    features, weight, labels = first.getFeaturesCol(), first.getWeightCol(), [m.getLabelCol() for m in makers]
    widths = categories(rows, features)
    inputs = vector_to_array(features)
    size = rows.select(F.size(inputs)).first()
    # No rows are left to MLlib, which says so.
    cuts = size and cuts_of(rows, inputs, [i for i in range(size[0]) if i not in widths], weight, first.getMaxBins())
    if cuts is not None and max([*widths.values(), *[len(c) + 1 for c in cuts.values()]]) <= BINS:
        bins = [f"bin{i}" for i in range(size[0])]
        binned = rows.select(
            *[(bin_of(inputs[i], cuts[i]) if i in cuts else inputs[i].cast("int")).alias(b) for i, b in enumerate(bins)], *labels, weight
        )
        in_order = rows.count() <= IN_ORDER
        if not in_order:
            means = [(F.sum(F.col(m) * F.col(weight)) / F.sum(weight)).alias(m) for m in labels]
            binned = materialize(binned.groupBy(*bins).agg(*means, F.sum(weight).alias(weight)), "binned")
        if in_order or binned.count() <= ROWS:
            with ThreadPoolExecutor(len(makers)) as pool:
                return list(pool.map(lambda m: fit_in_task(binned, bins, cuts, widths, m, in_order), makers))
    return fit_spread(rows, makers)


def fit_spread(rows: DataFrame, makers: Sequence[GBTRegressor]) -> list[GBTRegressionModel]:
    """By MLlib, a job for every level of every tree; the lineage is cut every ten rounds in the shared folder."""
    spark = rows.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "rounds"))
    # Few rows are best in few pieces: the time of a round is that of starting its tasks.
    pieces = max(1, math.ceil(rows.count() / ROWS_EACH))
    if rows.rdd.getNumPartitions() > pieces:
        rows = rows.coalesce(pieces)
    rows.persist()
    try:
        with ThreadPoolExecutor(len(makers)) as pool:
            return list(pool.map(lambda m: m.fit(rows), makers))
    finally:
        rows.unpersist()


def categories(rows: DataFrame, features: str) -> dict[int, int]:
    """Number of values of each input that is a category, by its place."""
    kinds = rows.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    named = {a["idx"]: len(a["vals"]) if "vals" in a else a["num_vals"] for a in kinds.get("nominal", [])}
    return named | {a["idx"]: 2 for a in kinds.get("binary", [])}


def cuts_of(rows: DataFrame, inputs: Column, numeric: Sequence[int], weight: str, max_bins: int) -> dict[int, list[float]] | None:
    """Thresholds of each number among the inputs, from all rows; ``None`` if there are too many different numbers."""
    if not numeric:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("input"), inputs[i].alias("value")) for i in numeric]))
    counts = rows.select(pairs.alias("p"), weight).groupBy("p").agg(F.sum(weight).alias("n")).limit(VALUES + 1).collect()
    if len(counts) > VALUES:
        return None
    found: dict[int, list[tuple[float, float]]] = {i: [] for i in numeric}
    for (place, value), n in counts:
        found[place].append((value, n))
    return {i: thresholds(sorted(pairs), max_bins - 1) for i, pairs in found.items()}


def thresholds(counts: Sequence[tuple[float, float]], most: int) -> list[float]:
    """Middles between neighbours: all of them if they are few, and if not, those nearest to equal shares."""
    if len(counts) - 1 <= most:
        return [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:])]
    stride = sum(n for _, n in counts) / (most + 1)
    found, passed, wanted = [], counts[0][1], stride
    for (a, _), (b, n) in zip(counts, counts[1:]):
        before, passed = passed, passed + n
        if abs(before - wanted) < abs(passed - wanted):
            found.append((a + b) / 2)
            wanted += stride
    return found


def bin_of(value: Column, cuts: Sequence[float]) -> Column:
    """How many thresholds are below the value."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value))


def fit_in_task(
    binned: DataFrame, bins: Sequence[str], cuts: dict[int, list[float]], widths: dict[int, int], maker: GBTRegressor, in_order: bool
) -> GBTRegressionModel:
    """All rounds in one task, which stores the nodes of the trees where MLlib loads them from."""
    spark, label, weight = binned.sparkSession, maker.getLabelCol(), maker.getWeightCol()
    rounds, depth, step = maker.getMaxIter(), maker.getMaxDepth(), maker.getStepSize()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boost = Boost(batches, len(bins), cuts, widths, depth, in_order)
        for k in range(rounds):
            found = boost.tree(1.0 if k == 0 else step)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int32()), pa.array(found, _NODE)], ["treeID", "nodeData"])

    path = shared_folder(spark, "trees")
    binned.select(*bins, label, weight).coalesce(1).mapInArrow(fit, NODES).write.parquet(f"{path}/data")
    settings, usual = ({p.name: v for p, v in maker.extractParamMap().items() if maker.isSet(p) is given} for given in (True, False))
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "defaultParamMap": usual}
    one = {"paramMap": {k: settings[k] for k in TREE_SETTINGS if k in settings}, "defaultParamMap": {"impurity": maker.getImpurity()}}
    told = [
        (k, json.dumps(about | one | {"class": TREE, "uid": f"dtr_{uuid.uuid4().hex[:12]}"}), 1.0 if k == 0 else step)
        for k in range(rounds)
    ]
    spark.createDataFrame(told, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = about | {"class": MODEL, "uid": maker.uid, "paramMap": settings, "numFeatures": len(bins), "numTrees": rounds}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return GBTRegressionModel.load(path)


def transform(model: PipelineModel, rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    """What ``model.transform`` gives, of whose columns ``keep`` and the predictions of the boosted trees at its end."""
    stages, ends = list(model.stages), []
    while stages and isinstance(stages[-1], GBTRegressionModel):
        ends.insert(0, stages.pop())
    if not ends or len({e.getFeaturesCol() for e in ends}) > 1:
        return model.transform(rows)
    found = [nodes_of(rows.sparkSession, e) for e in ends]
    if any(len(tree) > 2 * LEAVES - 1 for trees in found for tree in trees.values()):
        return model.transform(rows)
    masks = Masks(found, [e.treeWeights for e in ends], ends[0].numFeatures)
    if max(masks.sizes) > BINS:
        return model.transform(rows)
    ready = PipelineModel(stages).transform(rows) if stages else rows
    ready = ready.select(*keep, vector_to_array(ends[0].getFeaturesCol()).alias("inputs"))
    names = [e.getPredictionCol() for e in ends]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks.unfold()
        for batch in batches:
            inputs = batch.column(len(keep))
            values = inputs.flatten().to_numpy(zero_copy_only=False).reshape(len(inputs), masks.inputs)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, masks.score(values))], [*keep, *names])

    schema = T.StructType([*ready.schema.fields[:-1], *[T.StructField(n, T.DoubleType()) for n in names]])
    return ready.mapInArrow(score, schema)


def nodes_of(spark: SparkSession, model: GBTRegressionModel) -> dict[int, dict[int, object]]:
    """The nodes of each tree by their number, as MLlib stores them."""
    path = shared_folder(spark, "scoring")
    model.write().save(path)
    found: dict[int, dict[int, object]] = {}
    for tree, node in spark.read.parquet(f"{path}/data").select("treeID", "nodeData").collect():
        found.setdefault(tree, {})[node["id"]] = node
    return found


class Masks:
    """For each tree and bin of an input: the leaves that it leaves open, as bits."""

    def __init__(self, models: Sequence[dict[int, dict[int, object]]], weights: Sequence[Sequence[float]], inputs: int):
        self.inputs, self.of_model = inputs, [len(m) for m in models]
        splits = [n["split"] for m in models for tree in m.values() for n in tree.values() if n["leftChild"] >= 0]
        self.cuts: dict[int, np.ndarray] = {}
        self.sizes = [1] * inputs
        for f in range(inputs):
            own = [s for s in splits if s["featureIndex"] == f]
            if any(s["numCategories"] >= 0 for s in own):
                self.sizes[f] = max(s["numCategories"] for s in own)
            else:
                self.cuts[f] = np.unique([s["leftCategoriesOrThreshold"][0] for s in own])
                self.sizes[f] = len(self.cuts[f]) + 1
        self.packs = packs(self.sizes)
        total = sum(self.of_model)
        self.values = np.zeros((total, LEAVES))
        self.open = [np.full((total, n), 0xFFFFFFFF, np.uint32) for n in self.sizes]
        k = 0
        for model, shares in zip(models, weights):
            for tree in sorted(model):
                leaves = self.fill(k, model[tree], 0, 0, shares[tree])
                for table in self.open:
                    table[k] &= np.uint32((1 << leaves) - 1)
                k += 1
        self.tables: list[np.ndarray] | None = None

    def fill(self, k: int, nodes: dict[int, object], at: int, leaves: int, share: float) -> int:
        """Takes in what is below a node whose first leaf has the number ``leaves``; the number after its last one."""
        node = nodes[at]
        if node["leftChild"] < 0:
            self.values[k, leaves] = share * node["prediction"]
            return leaves + 1
        middle = self.fill(k, nodes, node["leftChild"], leaves, share)
        end = self.fill(k, nodes, node["rightChild"], middle, share)
        left, right = ((1 << b) - (1 << a) for a, b in ((leaves, middle), (middle, end)))
        split = node["split"]
        f, told = split["featureIndex"], split["leftCategoriesOrThreshold"]
        if f in self.cuts:
            goes_left = np.arange(self.sizes[f]) <= np.searchsorted(self.cuts[f], told[0])
        else:
            goes_left = np.isin(np.arange(self.sizes[f]), told)
        self.open[f][k] &= np.where(goes_left, 0xFFFFFFFF ^ right, 0xFFFFFFFF ^ left).astype(np.uint32)
        return end

    def unfold(self) -> None:
        """One table for the inputs of a pack, by task."""
        self.tables = []
        for pack in self.packs:
            table = np.full((len(self.values), 1), 0xFFFFFFFF, np.uint32)
            for f in pack:
                table = (table[:, :, None] & self.open[f][:, None, :]).reshape(len(table), -1)
            self.tables.append(table)

    def score(self, values: np.ndarray) -> list[np.ndarray]:
        """The predictions of each model."""
        cells = []
        for pack in self.packs:
            cell = np.zeros(len(values), np.int64)
            for f in pack:
                cell *= self.sizes[f]
                cell += np.searchsorted(self.cuts[f], values[:, f]) if f in self.cuts else values[:, f].astype(np.int64)
            cells.append(cell)
        found, k = [], 0
        for trees in self.of_model:
            total = np.zeros(len(values))
            for k in range(k, k + trees):
                leaf = self.tables[0][k].take(cells[0])
                for table, cell in zip(self.tables[1:], cells[1:]):
                    leaf &= table[k].take(cell)
                # One bit is left; this product has the number of the bit in its five leading bits.
                leaf *= np.uint32(BITS)
                leaf >>= np.uint32(27)
                total += self.values[k].take(PLACES.take(leaf))
            k += 1
            found.append(total)
        return found


class Boost:
    """The rows of a target and what is left of it after the trees so far."""

    def __init__(
        self, batches: Iterator[pa.RecordBatch], inputs: int, cuts: dict[int, list[float]], widths: dict[int, int], depth: int,
        in_order: bool,
    ):
        """``batches``: the bin of each input, the target and the weight, which is a whole number.

        ``in_order``: sums are taken row by row as the rows come, for each input alone.
        """
        self.cuts, self.widths, self.depth, self.in_order = cuts, widths, depth, in_order
        self.sizes = [widths[i] if i in widths else len(cuts[i]) + 1 for i in range(inputs)]
        self.packs = [[f] for f in range(inputs)] if in_order else packs(self.sizes)
        parts = [[*self.coded(batch), batch.column(inputs).to_numpy(), batch.column(inputs + 1).to_numpy()] for batch in batches]
        *codes, label, weight = (np.concatenate(p) for p in zip(*parts))
        del parts
        if not in_order:
            # By their bins, so that sums do not depend on the order in which rows come.
            order = np.lexsort(codes)
            codes, label, weight = [c[order] for c in codes], label[order], weight[order]
        self.codes, self.label, self.weight = codes, label.astype(float), weight.astype(float)
        #: What the next tree is fitted to, and the sum of the trees so far.
        self.goal, self.guess = self.label.copy(), np.zeros(len(label))
        self.block = max(1, len(label)) if in_order else BLOCK
        self.slot = np.zeros(len(label), np.uint8 if depth <= 8 else np.int32)
        widest = max(self.sizes)
        self.own = np.arange(widest)
        self.is_category = np.array([i in widths for i in range(inputs)])
        self.bin_in = {f: self.bins_of_cells(pack, f) for pack in self.packs for f in pack}
        self.pack_of = {f: p for p, pack in enumerate(self.packs) for f in pack}
        self.at_root: list[np.ndarray] | None = None

    def coded(self, batch: pa.RecordBatch) -> list[np.ndarray]:
        """The cell of each row in each pack."""
        found = []
        for pack in self.packs:
            code = np.zeros(batch.num_rows, np.int32)
            for f in pack:
                code *= self.sizes[f]
                code += batch.column(f).to_numpy()
            found.append(code.astype(np.int16) if self.cells(pack) <= 1 << 15 else code)
        return found

    def cells(self, pack: Sequence[int]) -> int:
        return math.prod(self.sizes[f] for f in pack)

    def bins_of_cells(self, pack: Sequence[int], f: int) -> np.ndarray:
        after = math.prod(self.sizes[g] for g in pack[pack.index(f) + 1:])
        return np.arange(self.cells(pack)) // after % self.sizes[f]

    def blocks(self, routes: Sequence[tuple[int, np.ndarray]]) -> Iterator[tuple[slice, np.ndarray]]:
        """Rows of a block and the slot of each, after they went left or right by ``routes``."""
        for start in range(0, len(self.label), self.block):
            rows = slice(start, start + self.block)
            slot = self.slot[rows].astype(np.int64)
            if routes:
                right = np.zeros(len(slot), np.uint8)
                for p, table in routes:
                    at = slot * self.cells(self.packs[p])
                    at += self.codes[p][rows]
                    right |= table.take(at)
                slot += slot
                slot += right
                self.slot[rows] = slot
            yield rows, slot

    def sums(self, slots: int, routes: Sequence[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights, weighted targets and their weighted squares of each slot, input and bin."""
        sizes = [slots * self.cells(pack) for pack in self.packs]
        known = self.at_root if slots == 1 else None
        weights, pulls, squares = known or [np.zeros(n) for n in sizes], [np.zeros(n) for n in sizes], [np.zeros(n) for n in sizes]
        for rows, slot in self.blocks(routes):
            weight, goal = self.weight[rows], self.goal[rows]
            pull = weight * goal
            square = pull * goal
            for p, pack in enumerate(self.packs):
                at = slot * self.cells(pack)
                at += self.codes[p][rows]
                pulls[p] += np.bincount(at, pull, sizes[p])
                squares[p] += np.bincount(at, square, sizes[p])
                if not known:
                    weights[p] += np.bincount(at, weight, sizes[p])
        if slots == 1:
            self.at_root = weights
        return self.by_input(weights, slots), self.by_input(pulls, slots), self.by_input(squares, slots)

    def by_input(self, sums: Sequence[np.ndarray], slots: int) -> np.ndarray:
        found = np.zeros((slots, len(self.sizes), len(self.own)))
        for pack, flat in zip(self.packs, sums):
            cube = flat.reshape(slots, *[self.sizes[f] for f in pack])
            for k, f in enumerate(pack):
                found[:, f, :self.sizes[f]] = cube.sum(tuple(j + 1 for j in range(len(pack)) if j != k))
        return found

    def tree(self, step: float) -> list[dict]:
        """The next tree, whose share ``step`` is added to the guesses; the nodes as MLlib stores them."""
        nodes: list[dict] = [{}]
        owners: list[int | None] = [0]
        routes: list[tuple[int, np.ndarray]] = []
        grown = 0
        for level in range(self.depth):
            sums = self.sums(1 << level, routes)
            if level == 0:
                nodes[0] = {"sums": whole(*(x[0] for x in sums), self.sizes)}
                noise = 0.0 if self.in_order else ROUNDING * float(nodes[0]["sums"][2])
            spread = np.array([np.nan if n is None else variance(*nodes[n]["sums"]) for n in owners])
            routes, owners = self.divide(nodes, owners, best_splits(*sums, spread, self.is_category, self.own, noise), level)
            grown = level + 1
            if not routes:
                break
        slots = 1 << grown
        many = np.zeros(slots, np.int64)
        values = np.array([0.0 if n is None else nodes[n]["sums"][1] / nodes[n]["sums"][0] for n in owners])
        for rows, slot in self.blocks(routes or [(0, np.zeros(slots * self.cells(self.packs[0]), np.uint8))]):
            many += np.bincount(slot, minlength=slots)
            self.guess[rows] += values.take(slot) * step
            self.goal[rows] = 2.0 * (self.label[rows] - self.guess[rows])
        self.slot[:] = 0
        for n, k in zip(owners, many):
            if n is not None:
                nodes[n]["rows"] = int(k)
        return self.stored(nodes)

    def divide(self, nodes: list[dict], owners: list[int | None], splits, level: int) -> tuple[list[tuple[int, np.ndarray]], list[int | None]]:
        """Splits the nodes of a level: who goes right, by pack and cell, and the nodes of the next slots.

        What is not split goes left as it is.
        """
        inputs, places, orders, gains, lefts, rights = splits
        tables: dict[int, np.ndarray] = {}
        following: list[int | None] = []
        for j, n in enumerate(owners):
            if n is None or "leaf" in nodes[n] or not gains[j] > 0:
                if n is not None:
                    nodes[n]["leaf"] = True
                following += [n, None]
                continue
            f, place = int(inputs[j]), int(places[j])
            goes = np.ones(self.sizes[f], np.uint8)
            goes[orders[j][:place + 1]] = 0
            p = self.pack_of[f]
            cells = self.cells(self.packs[p])
            table = tables.setdefault(p, np.zeros(len(owners) * cells, np.uint8))
            table[j * cells:(j + 1) * cells] = goes[self.bin_in[f]]
            nodes[n] |= {
                "gain": gains[j], "input": f, "place": place, "chosen": orders[j][:place + 1].tolist(),
                "children": (len(nodes), len(nodes) + 1),
            }
            following += [len(nodes), len(nodes) + 1]
            for sums in (lefts[j], rights[j]):
                nodes.append({"sums": sums} | ({"leaf": True} if abs(variance(*sums)) < NO_SPREAD else {}))
        return list(tables.items()), following

    def stored(self, nodes: list[dict]) -> list[dict]:
        """The nodes from the root down, left before right; two leaves that predict the same are one."""
        for node in reversed(nodes):
            if "children" in node:
                node["rows"] = sum(nodes[c]["rows"] for c in node["children"])
        found: list[dict] = []

        def add(n: int) -> int:
            node, here = nodes[n], len(found)
            w, s, q = map(float, node["sums"])
            told = {
                "id": here, "prediction": s / w, "impurity": variance(w, s, q), "impurityStats": [w, s, q],
                "rawCount": node["rows"], "gain": -1.0, "leftChild": -1, "rightChild": -1,
                "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1},
            }
            found.append(told)
            if "children" in node:
                left, right = (add(c) for c in node["children"])
                a, b = found[left], found[right]
                if a["leftChild"] == b["leftChild"] == -1 and a["prediction"] == b["prediction"]:
                    told["prediction"] = a["prediction"]
                    del found[here + 1:]
                    return here
                f = node["input"]
                category = f in self.widths
                told |= {
                    "gain": node["gain"], "leftChild": left, "rightChild": right,
                    "split": {
                        "featureIndex": f,
                        "leftCategoriesOrThreshold": [float(c) for c in node["chosen"]] if category else [self.cuts[f][node["place"]]],
                        "numCategories": self.widths[f] if category else -1,
                    },
                }
            return here

        add(0)
        return found


def variance(weight: float, pull: float, square: float) -> float:
    return (square - pull * pull / weight) / weight


def whole(weights: np.ndarray, pulls: np.ndarray, squares: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """Sums of the root, put together from both sides of the first split, as MLlib has them."""
    f = next((f for f, n in enumerate(sizes) if n > 1), 0)
    return np.array([x[f, 0] + (x[f].cumsum()[-1] - x[f, 0]) for x in (weights, pulls, squares)])


def packs(sizes: Sequence[int]) -> list[list[int]]:
    """Inputs that are counted together, as one of few combinations each."""
    found: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        for pack in found:
            if math.prod(sizes[g] for g in pack) * sizes[f] <= CELLS:
                pack.append(f)
                break
        else:
            found.append([f])
    return found


def best_splits(
    weights: np.ndarray, pulls: np.ndarray, squares: np.ndarray, spread: np.ndarray, is_category: np.ndarray, own: np.ndarray, noise: float
):
    """Input, place, order of the bins, gain and sums on both sides of the best split of each slot.

    A number is cut between bins, a category between its values in order of their means, those without rows last.
    Of splits that differ by rounding the first counts, and a gain that may be rounding is none, if there is ``noise``.
    """
    slots, inputs, bins = weights.shape
    order = np.broadcast_to(own, weights.shape).copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        if is_category.any():
            w = weights[:, is_category]
            order[:, is_category] = np.argsort(np.where(w > 0, pulls[:, is_category] / w, np.inf), axis=2, kind="stable")
        left = [np.take_along_axis(x, order, 2).cumsum(2) for x in (weights, pulls, squares)]
        right = [x[:, :, -1:] - x for x in left]
        total = left[0] + right[0]
        gain = spread[:, None, None] - left[0] / total * variance(*left) - right[0] / total * variance(*right)
        gain = np.where((left[0] > 0) & (right[0] > 0) & (gain >= 0), gain, -np.inf).reshape(slots, -1)
        best = gain.max(1)
        least = noise / weights[:, 0].sum(1)
        near = (NEAR * np.maximum(best, 0) + least) if noise else 0.0
        at = (gain >= (best - near)[:, None]).argmax(1)
    j = np.arange(slots)
    found = np.where(np.isfinite(best) & (best > least), gain[j, at], 0.0)
    f, place = at // bins, at % bins
    return f, place, order[j, f], found, *(np.stack([x[j, f, place] for x in side], 1) for side in (left, right))
