"""Linear probes and surface baselines on Spark ML, fitted on the train fold and chosen on validation.

A fitted probe is a row (layer, seed, weights, bias) for unscaled vectors: probes are kept, read again
and applied to other tables by a join on the layer.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.functions.text import ABLATED, ablate_class, ngram_class, ngram_documents, ngram_numbers, single_blanks, text_blocks
from lexiprobe.functions.vectors import margin
from lexiprobe.operators.batched_fits import fit_probes
from lexiprobe.operators.joins import Refused, matched, small_side
from lexiprobe.operators.metrics import macro_f1
from lexiprobe.operators.splits import hash_split
from lexiprobe.operators.summaries import mass_by_class, strongest, surviving_mass, weighted_agreement

#: Partitions of a fit's rows for each core.
PARTS_PER_CORE = 4

PROBE = "layer int, seed int, weights array<double>, bias double"


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """Adds weight n / (classes * n of the class)."""
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    n, k = sizes.agg(F.sum("__c"), F.count(F.lit(1))).first()
    return rows.join(small_side(sizes), label).withColumn("weight", F.lit(float(n or 0)) / (F.lit(float(k or 1)) * F.col("__c"))).drop("__c")


def fit_logistic(train: DataFrame, features: str = "features", label: str = "y", c: float = 1.0, balanced: bool = True, max_iter: int = 200):
    """L2 logistic regression whose penalty 1/(C n) equals a summed loss with C; no inner scaling.

    Each partition shuffles a vector as wide as the features in every step, so their number is bounded by the cores.
    """
    rows = balanced_weights(train, label) if balanced else train.withColumn("weight", F.lit(1.0))
    n = rows.count()
    rows = rows.select(features, label, "weight").coalesce(PARTS_PER_CORE * train.sparkSession.sparkContext.defaultParallelism)
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", regParam=1.0 / (c * max(1, n)), standardization=False, maxIter=max_iter, family="auto", predictionCol="y_pred").fit(rows)


def population_scaler(train: DataFrame, raw: str = "raw"):
    """(mean, deviation) of the train fold's components, the deviation that of a population and 1 where there is none."""
    n = train.count()
    model = StandardScaler(inputCol=raw, outputCol="features", withMean=True, withStd=True).fit(train)
    shrink = math.sqrt((n - 1) / n) if n > 1 else 1.0
    return model.mean.toArray().tolist(), [s * shrink or 1.0 for s in model.std.toArray().tolist()]


def scaled(train: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides scaled by the train fold's mean and population deviation."""
    n = train.count()
    model = StandardScaler(inputCol="raw", outputCol="sample", withMean=True, withStd=True).fit(train)
    grow = ElementwiseProduct(inputCol="sample", outputCol="features", scalingVec=Vectors.dense([math.sqrt(n / (n - 1)) if n > 1 else 1.0] * len(model.mean)))
    both = [grow.transform(model.transform(x)).drop("sample") for x in (train, rest)]
    return both[0], both[1]


def fit_probe(train: DataFrame, c: float = 1.0, balanced: bool = True) -> tuple[list[float], float]:
    """(weights, bias) for unscaled vectors of a binary probe fitted on scaled ones; ``train`` has raw and y (0 or 1)."""
    mean, deviation = population_scaler(train)
    model = fit_logistic(scaled(train, train.limit(0))[0], c=c, balanced=balanced)
    weights = [w / d for w, d in zip(model.coefficients.toArray().tolist(), deviation, strict=True)]
    bias = model.intercept - sum(w * m for w, m in zip(weights, mean, strict=True))
    if not all(math.isfinite(x) for x in (*weights, bias)):
        raise Refused("the probe's parameters are not finite")
    return weights, float(bias)


def apply_probes(rows: DataFrame, probes: DataFrame, vec: str = "vec") -> DataFrame:
    """``rows`` (layer, ``vec``) with seed, margin and y_pred of every probe of their layer."""
    own = rows.join(small_side(probes.select("layer", "seed", "weights", "bias")), "layer")
    return own.withColumn("margin", margin(F.col("weights"), F.col("bias"), F.col(vec))).withColumn("y_pred", (F.col("margin") > 0).cast("int")).drop("weights", "bias")


def layer_sweep(rows: DataFrame, group: str, label: str, vec: str, seeds: list[int], c: float = 1.0, balanced: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(probes, curves, chosen) over ``rows`` (layer, group, label 0 or 1, vec).

    curves: seed, layer, fold, macro_f1, accuracy, n. chosen: of each seed the layer with the highest macro F1 on
    validation (the lowest of several), with its validation and test figures. Seeds with an empty fold or one class in
    train are left out; where all are, the sweep is refused.
    """
    spark = rows.sparkSession
    base = rows.select("layer", F.col(group).alias("g"), F.col(label).cast("int").alias("y"), F.col(vec).cast("array<double>").alias("vec")).persist()
    try:
        folds = base.select("*", *(hash_split(F.col("g"), s).alias(f"__{i}") for i, s in enumerate(seeds)))
        sizes = folds.agg(*(F.collect_set(F.struct(F.col(f"__{i}").alias("fold"), "y")).alias(f"s{i}") for i in range(len(seeds)))).first()
        usable = [i for i in range(len(seeds)) if {p["fold"] for p in sizes[f"s{i}"]} == {"train", "val", "test"} and len([1 for p in sizes[f"s{i}"] if p["fold"] == "train"]) >= 2]
        fitted = []
        if usable:
            use = F.array(*(F.col(f"__{i}") == "train" for i in usable)).alias("use")
            found = fit_probes(folds.select("layer", "vec", "y", use), c, balanced)
            layers = {r["layer"] for r in base.select("layer").distinct().collect()}
            missing = sorted(layers - {k[0] for k in found})
            if missing:
                raise Refused(f"layers {missing[:3]} have a single class to learn from")
            fitted = [(layer, seeds[usable[k]], *p) for (layer, k), p in sorted(found.items())]
            if not all(math.isfinite(x) for _, _, w, b in fitted for x in (*w, b)):
                raise Refused("a probe's parameters are not finite")
        if not fitted:
            raise Refused("no seed has three folds and two classes to learn from")
        probes = spark.createDataFrame(fitted, PROBE)
        found = apply_probes(base, probes).withColumn("fold", hash_split(F.col("g"), F.col("seed")))
        by = ["seed", "layer", "fold"]
        plain = found.groupBy(*by).agg(F.avg((F.col("y") == F.col("y_pred")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
        curves = spark.createDataFrame(macro_f1(found, by, y="y").join(plain, by).collect(), "seed int, layer int, fold string, macro_f1 double, accuracy double, n long")
    finally:
        base.unpersist()
    val, test = curves.filter("fold = 'val'"), curves.filter("fold = 'test'").select("seed", "layer", F.col("macro_f1").alias("test_f1"), F.col("accuracy").alias("test_accuracy"))
    best = val.groupBy("seed").agg(F.max_by(F.struct("layer", "macro_f1"), F.struct("macro_f1", -F.col("layer"))).alias("b")).select("seed", "b.layer", F.col("b.macro_f1").alias("val_f1"))
    return probes, curves, best.join(test, ["seed", "layer"])


def sweep_summary(chosen: DataFrame) -> dict:
    """Selected layers and their median, mean and population deviation of the test figures over seeds."""
    rows = sorted(chosen.collect(), key=lambda r: r["seed"])
    f1, layers = [r["test_f1"] for r in rows], sorted(r["layer"] for r in rows)
    mean, k = sum(f1) / len(f1), len(layers)
    return {
        "selected_layers": [r["layer"] for r in rows], "selected_layer": int((layers[(k - 1) // 2] + layers[k // 2]) / 2), "test_f1_mean": mean,
        "test_f1_std": math.sqrt(sum((x - mean) ** 2 for x in f1) / k), "test_accuracy_mean": sum(r["test_accuracy"] for r in rows) / k,
    }


def selectivity(rows: DataFrame, group: str, name: str, label: str, vec: str, seeds: list[int]) -> dict:
    """Macro F1 of the sweep, of a sweep on labels dealt to names by hash, and the difference."""
    from lexiprobe.operators.occurrences import label_by_name

    control = label_by_name(rows, name, label, 1234).drop(label).withColumnRenamed("control_label", label)
    real, other = (sweep_summary(layer_sweep(x, group, label, vec, seeds)[2])["test_f1_mean"] for x in (rows, control))
    return {"macro_f1": real, "control_macro_f1": other, "selectivity": real - other}


def evaluate_probes(rows: DataFrame, probes: DataFrame, label: str, vec: str = "vec", by: list[str] | None = None) -> DataFrame:
    """by, layer, seed, accuracy, macro_f1 of probes fitted elsewhere; layers that one side lacks are left out."""
    keys = [*(by or []), "layer", "seed"]
    found = apply_probes(rows, probes, vec).withColumn("y", F.col(label).cast("int"))
    return macro_f1(found, keys, y="y").join(found.groupBy(*keys).agg(F.avg((F.col("y") == F.col("y_pred")).cast("double")).alias("accuracy")), keys)


def nearest_layers(a: DataFrame, b: DataFrame, layer: str = "layer") -> DataFrame:
    """layer_a, layer_b: for each layer of ``a`` the one of ``b`` at the nearest share of its depth; ties to the lower."""
    depth = lambda d, n: d.select(F.col(layer).alias(n)).distinct()
    top = lambda d: max(1, d.agg(F.max(layer)).first()[0] or 0)
    x, y = depth(a, "layer_a"), depth(b, "layer_b")
    far = F.abs(F.col("layer_a") / F.lit(float(top(a))) - F.col("layer_b") / F.lit(float(top(b))))
    # layers of one model: at most some hundreds
    return x.crossJoin(F.broadcast(y)).groupBy("layer_a").agg(F.min_by("layer_b", F.struct(far, F.col("layer_b"))).alias("layer_b"))


def cross_model_matrix(probes: dict[str, DataFrame], rows: dict[str, DataFrame], label: str, vec: str = "vec") -> list[dict]:
    """source, target, macro_f1 (mean over aligned layers and seeds) for each pair of models with vectors of one length."""
    out = []
    for a, own in probes.items():
        for b, table in rows.items():
            aligned = own.join(nearest_layers(own, table).withColumnRenamed("layer_a", "layer"), "layer").drop("layer").withColumnRenamed("layer_b", "layer")
            found = apply_probes(table, aligned.withColumn("seed", F.monotonically_increasing_id()), vec).withColumn("y", F.col(label).cast("int"))
            out.append({"source": a, "target": b, "macro_f1": macro_f1(found, ["layer", "seed"], y="y").agg(F.avg("macro_f1")).first()[0]})
    return out


def _checksum(probes: DataFrame) -> str:
    line = F.to_json(F.struct("layer", "seed", "weights", "bias"))
    # probes are rows of a small table: layers times seeds
    return probes.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256)).first()[0]


def write_probes(probes: DataFrame, path: str, metadata: dict) -> dict:
    """Writes probes and, behind them, their metadata with a checksum."""
    probes = probes.select("layer", "seed", "weights", "bias")
    probes.coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
    known = metadata | {"sha256": _checksum(probes), "rows": probes.count()}
    probes.sparkSession.createDataFrame([(json.dumps(known, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return known


def read_probes(spark: SparkSession, path: str, expected: dict) -> DataFrame:
    """Probes whose checksum holds and whose metadata have the expected values; others are refused."""
    known = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    differ = [k for k, v in expected.items() if known.get(k) != v]
    if differ:
        raise Refused(f"the probes' metadata differ in {differ}")
    probes = spark.read.schema(PROBE).parquet(f"{path}/probes")
    if _checksum(probes) != known["sha256"]:
        raise Refused("the probes are not those that were written")
    return probes


def fit_probe_link(rows: DataFrame, group: str, label: str, vec: str, seeds: list[int], c: float = 1.0, expected_splits: dict[int, int] | None = None) -> dict:
    """Probes of one layer over several seeds, all of which must be usable: probes, test figures by seed and their means, and
    a hash of each seed's test members, which must be those ``expected_splits`` names."""
    one = rows.withColumn("layer", F.lit(0)) if "layer" not in rows.columns else rows
    probes, curves, chosen = layer_sweep(one, group, label, vec, seeds, c)
    if chosen.count() != len(seeds):
        raise Refused("a seed has an empty fold or a single class to learn from")
    each = rows.select(F.col(group).alias("g")).distinct().withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds))))
    members = {r["seed"]: r["h"] for r in each.filter(hash_split(F.col("g"), F.col("seed")) == "test").groupBy("seed").agg(F.bit_xor(F.xxhash64("g")).alias("h")).collect()}
    if expected_splits is not None and members != expected_splits:
        raise Refused("the test folds are not those that were recorded")
    return {"probes": probes, "splits": members, **sweep_summary(chosen)}


def probe(rows: DataFrame, vec: str, label: str, group: str, seeds: list[int], c: float = 1.0) -> DataFrame:
    """seed, fold, macro_f1, n of a linear probe; groups stay within one fold; seeds whose train fold has one class are left out."""
    base = rows.select(F.col(group).alias("g"), array_to_vector(F.col(vec).cast("array<double>")).alias("raw"), F.col(label).cast("double").alias("y")).persist()
    out = None
    for seed in seeds:
        folds = base.withColumn("fold", hash_split(F.col("g"), seed))
        train = folds.filter("fold = 'train'")
        if train.select("y").distinct().limit(2).count() < 2:
            continue
        a, b = scaled(train, folds.filter("fold <> 'train'"))
        found = fit_logistic(a, c=c).transform(b).select("fold", "y", "y_pred").withColumn("seed", F.lit(seed))
        scored = macro_f1(found, ["seed", "fold"], y="y").join(found.groupBy("seed", "fold").agg(F.count(F.lit(1)).alias("n")), ["seed", "fold"])
        out = scored if out is None else out.unionByName(scored)
    return out if out is not None else rows.sparkSession.createDataFrame([], "seed int, fold string, macro_f1 double, n long")


def _gram_features(vocabulary: list[str], weights: list[float], low: int, high: int):
    """Lowered texts in UTF-8 to sparse vectors, of length 1, of their counts of the vocabulary's n-grams times the weights.

    Vectors take several times the memory of their texts: they are given back for each block of texts, not for each Arrow
    batch. A text longer than a block is counted in parts.
    """

    @F.arrow_udf(VectorUDT())
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, weight = {g: i for i, g in enumerate(vocabulary)}, np.array(weights)

        def vectors(rows):
            parts = []
            for held, n in rows:
                x = n * weight[held]
                parts.append((held, x / (np.sqrt((x * x).sum()) or 1.0)))
            cuts = pa.array(np.cumsum([0, *(len(held) for held, _ in parts)]), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate([p[i] for p in parts]), t)) for i, t in enumerate((pa.int32(), pa.float64()))]
            return pa.StructArray.from_arrays([pa.array([0] * len(parts), pa.int8()), pa.array([len(weight)] * len(parts), pa.int32()), *lists], ["type", "size", "indices", "values"])

        def numbered():
            seen = 0
            for texts in batches:
                yield pa.RecordBatch.from_arrays([pa.array(range(seen, seen + len(texts)), pa.int64()), texts], ["row", "text"])
                seen += len(texts)

        last, open_ = None, []  # the row that may go on in the next block, and its counts
        for block in text_blocks(numbered()):
            names, texts = ngram_numbers([t for _, t in block], low, high)
            place = np.array([known.get(g, -1) for g in names], np.int64)
            own = np.argsort(place)[np.count_nonzero(place < 0) :]  # the block's n-grams of the vocabulary, in its order
            slot = np.full(len(names), len(own))
            slot[own] = np.arange(len(own))
            rows = open_
            for (row, _), grams in zip(block, texts, strict=True):
                n = np.bincount(slot[grams], minlength=len(own) + 1)[: len(own)]
                at = np.flatnonzero(n)
                held, n = place[own[at]].astype(np.int32), n[at].astype(np.float64)
                if row == last:
                    held, which = np.unique(np.concatenate([rows[-1][0], held]), return_inverse=True)
                    rows[-1] = held, np.bincount(which, np.concatenate([rows[-1][1], n]))
                else:
                    rows.append((held, n))
                last = row
            open_ = [rows.pop()]
            if rows:
                yield vectors(rows)
        if open_:
            yield vectors(open_)

    return features


class Grams:
    """Character n-gram weights: vocabulary (most frequent first, ties in order of the n-grams) and document frequencies of a train side.

    Each row is a document of its own, and its features are counted where it is.
    """

    def __init__(self, train: DataFrame, key: str, text: str, low: int = 2, high: int = 4, min_df: int = 2, features: int = 60_000):
        self.key, self.text, self.low, self.high = key, text, low, high
        found = ngram_documents(train, None, text, low, high, min_df).orderBy(F.desc("tf"), "ngram").limit(features).collect()
        if not found:
            raise ValueError("no n-gram reaches min_df")
        n = train.filter(F.col(text).rlike(r"\S")).count()
        self.vocabulary = [r["ngram"] for r in found]
        # ln((1 + n) / (1 + df)) + 1 as the weight of a count
        self.weights = [math.log((1 + n) / (1 + r["df"])) + 1 for r in found]

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with features, of length 1; rows without n-grams keep the zero vector."""
        features = _gram_features(self.vocabulary, self.weights, self.low, self.high)
        return rows.withColumn("features", features(F.lower(F.col(self.text)).cast("binary")))


def tfidf(rows: DataFrame, key: str, text: str, train: DataFrame, low: int = 2, high: int = 4, min_df: int = 2, features: int = 60_000) -> DataFrame:
    """``rows`` with features: L2-normalised counts times ln((1+n)/(1+df)) + 1; vocabulary and df from ``train`` alone, most frequent first."""
    return Grams(train, key, text, low, high, min_df, features).transform(rows)


def _indexed(rows: DataFrame, label: str) -> tuple[DataFrame, list]:
    """Adds y, the label's number; and the labels."""
    names = sorted(r[0] for r in rows.select(label).distinct().collect())
    number = F.create_map(*(x for i, n in enumerate(names) for x in (F.lit(n), F.lit(float(i)))))
    return rows.withColumn("y", number[F.col(label)]), names


FAMILIES = ("name_only", "line_masked", "statement_masked", "window_masked")


def surface_baselines(rows: DataFrame, key: str, label: str, group: str, seeds: list[int], covariates: list[str], texts: tuple[str, ...] = FAMILIES) -> tuple[DataFrame, DataFrame]:
    """(figures, predictions): seed, family, macro_f1, accuracy of the majority, the covariates and of each text column's n-grams, and
    the test predictions (key, seed, y_true, y_pred, cluster) of the strongest family by mean macro F1; ties to the last name.

    Train and validation are one, as there is no layer to choose. A family without any n-gram in two rows has no figures.
    """
    if rows.select(key).distinct().count() != rows.filter(F.col(key).isNotNull()).count() or rows.filter(F.col(key).isNull()).limit(1).count():
        raise Refused(f"predictions can be paired only if each row has its own {key}")
    rows, names = _indexed(rows, label)
    found = None
    for seed in seeds:
        folds = rows.withColumn("fold", F.when(hash_split(F.col(group), seed) == "test", "test").otherwise("train"))
        train, test = folds.filter("fold = 'train'"), folds.filter("fold = 'test'")
        order = train.groupBy("y").count().orderBy(F.desc("count"), "y").first()
        if order is None or train.select("y").distinct().count() < 2:
            continue
        pick = lambda d, family, seed=seed: d.select(key, F.col(group).alias("cluster"), "y", "y_pred", F.lit(seed).alias("seed"), F.lit(family).alias("family"))
        parts = [pick(test.withColumn("y_pred", F.lit(order["y"])), "majority")]
        raw = lambda d: d.withColumn("raw", array_to_vector(F.array(*(F.col(c).cast("double") for c in covariates))))
        if covariates:
            a, b = scaled(raw(train), raw(test))
            parts.append(pick(fit_logistic(a, balanced=False).transform(b), "covariates_only"))
        for text in texts:
            try:
                grams = Grams(train, key, text)
            except ValueError:
                continue
            model = fit_logistic(grams.transform(train), c=4.0, balanced=False)
            parts.append(pick(model.transform(grams.transform(test)), text))
        for part in parts:
            found = part if found is None else found.unionByName(part)
    if found is None:
        raise Refused("no seed has two classes to learn from")
    found = found.persist()
    fixed = [float(i) for i in range(len(names))]
    plain = found.groupBy("seed", "family").agg(F.avg((F.col("y") == F.col("y_pred")).cast("double")).alias("accuracy"))
    figures = macro_f1(found, ["seed", "family"], fixed, y="y").join(plain, ["seed", "family"])
    best = strongest(figures.groupBy("family").agg(F.avg("macro_f1").alias("macro_f1")), [], "family", "macro_f1").first()["family"]
    said = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("y_pred").cast("int") + 1)
    true = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("y").cast("int") + 1)
    return figures, found.filter(F.col("family") == best).select(key, "seed", true.alias("y_true"), said.alias("y_pred"), "cluster", "family")


def surface_baseline(rows: DataFrame, key: str, text: str, label: str, group: str, seed: int, c: float = 4.0) -> DataFrame:
    """fold, macro_f1 of a character n-gram baseline and of the majority class."""
    split = hash_split(F.col(group), seed).alias("fold")
    # the texts are put together once, on disk; features, several times as large, are made anew where they are needed
    folds = rows.select(key, text, F.col(label).cast("double").alias("y"), split).persist(StorageLevel.DISK_ONLY)
    try:
        train = folds.filter("fold = 'train'")
        grams = Grams(train, key, text)
        model = fit_logistic(grams.transform(train), c=c)
        found = model.transform(grams.transform(folds.filter("fold <> 'train'"))).select("fold", "y", "y_pred").persist()
        found.count()
        major = train.groupBy("y").count().orderBy(F.desc("count"), "y").first()["y"]
    finally:
        folds.unpersist()
    both = macro_f1(found, ["fold"], y="y").withColumnRenamed("macro_f1", "ngram_f1").join(macro_f1(found.withColumn("y_pred", F.lit(major)), ["fold"], y="y").withColumnRenamed("macro_f1", "majority_f1"), "fold")
    return both


def _transferred(a: DataFrame, b: DataFrame, key: str, text: str) -> tuple[Grams, object, float, DataFrame]:
    """n-grams and model fitted on ``a`` (key, text, y 0 or 1), and the macro F1 on ``b``."""
    grams = Grams(a, key, text)
    model = fit_logistic(grams.transform(a).select("features", "y"), c=4.0, balanced=True)
    x = grams.transform(b)
    return grams, model, macro_f1(model.transform(x).withColumn("one", F.lit(1)), ["one"], [0.0, 1.0], y="y").first()["macro_f1"], x


def mechanism(source: DataFrame, target: DataFrame, key: str, shared: str, role: str, label: str, texts: tuple[str, ...] = FAMILIES[1:], classes: tuple[str, ...] = tuple(ABLATED), same_blanks: bool = False) -> dict:
    """What a surface model of ``source`` keeps in ``target``, on the masked text that transfers best over shared problems.

    best (text column), macro_f1, surviving mass, agreement of the coefficients with those of a model fitted on the
    target in the same features (weighted by the source's coefficients times the target's weights), the n-grams read most
    oppositely, mass by class, and ablations: class, macro_f1, delta with the class's characters blank on both sides.
    """
    a, b = matched(source, target, shared)
    clean = (lambda c: single_blanks(F.col(c))) if same_blanks else F.col
    prep = lambda d, text, name=None: d.select(F.col(key), ablate_class(clean(text), name).alias("text"), (F.col(label) == role).cast("double").alias("y"))
    scored = {text: _transferred(prep(a, text), prep(b, text), key, "text") for text in texts}
    best = max(scored, key=lambda t: scored[t][2])
    grams, model, f1, x = scored[best]
    mean = lambda d: d.select(Summarizer.mean(F.col("features"))).first()[0].toArray().tolist()
    other = fit_logistic(x.select("features", "y"), c=4.0, balanced=True)
    rows = zip(grams.vocabulary, model.coefficients.toArray().tolist(), other.coefficients.toArray().tolist(), mean(grams.transform(prep(a, best))), mean(x), strict=True)
    # at most as many rows as there are features
    features = source.sparkSession.createDataFrame(list(rows), "ngram string, source_weight double, target_weight double, source_mean double, target_mean double").withColumn("w", F.abs("source_weight") * F.col("target_mean"))
    flip = F.col("w") * F.greatest(F.lit(0.0), -F.col("source_weight") * F.col("target_weight"))
    ablations = {c: _transferred(prep(a, best, c), prep(b, best, c), key, "text")[2] for c in classes}
    return {
        "best": best, "macro_f1": f1, **surviving_mass(features, "source_weight", "source_mean", "target_mean").first().asDict(),
        **weighted_agreement(features, "source_weight", "target_weight", "w").first().asDict(),
        "by_class": [r.asDict() for r in mass_by_class(features, ngram_class(F.col("ngram")), "source_weight", "source_mean", "target_mean").collect()],
        "flipped": [r.asDict() for r in features.filter(flip > 0).orderBy(flip.desc(), "ngram").limit(25).select("ngram", "source_weight", "target_weight").collect()],
        "ablations": [{"class": c, "macro_f1": v, "delta": v - f1} for c, v in ablations.items()],
    }


def transfer(source: DataFrame, target: DataFrame, vec: str, label: str, shared: str, least: int = 0) -> DataFrame:
    """macro_f1 on the target of a probe fitted on the source, with shuffled and majority controls; both restricted to shared keys."""
    from lexiprobe.operators.occurrences import resampled_labels

    a, b = matched(source, target, shared, least)
    prep = lambda d: d.select(F.col(shared).alias("k"), array_to_vector(F.col(vec).cast("array<double>")).alias("raw"), F.col(label).cast("double").alias("y"))
    train, test = scaled(prep(a), prep(b))
    mixed = resampled_labels(train, "y", "k", [], 0).withColumn("y", F.col("control_label"))
    major = train.groupBy("y").count().orderBy(F.desc("count"), "y").first()["y"]
    found = fit_logistic(train).transform(test).select("y", "y_pred").withColumn("model", F.lit("transfer"))
    found = found.unionByName(fit_logistic(mixed.select("features", "y")).transform(test).select("y", "y_pred").withColumn("model", F.lit("shuffled")))
    found = found.unionByName(test.select("y", F.lit(major).alias("y_pred"), F.lit("majority").alias("model")))
    return macro_f1(found, ["model"], y="y")


def principal(rows: DataFrame, vec: str, k: int = 2) -> DataFrame:
    """component, share: the variance shares of the first ``k`` principal components."""
    x = rows.select(array_to_vector(F.col(vec).cast("array<double>")).alias("x"))
    shares = PCA(k=k, inputCol="x", outputCol="p").fit(x).explainedVariance.toArray().tolist()
    return rows.sparkSession.createDataFrame(list(enumerate(shares)), "component int, share double")
