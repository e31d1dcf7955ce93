"""Readers and writers: JSON lines, whole JSON, corpora with row order, activation stores, result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROGRAM = "problem_id string, language string, split string, code string, text string"
ACTIVATION = "occurrence_id string, problem_id string, label string, variable string, function string, layer int, vec array<float>"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_or_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array, or lines."""
    first = spark.read.text(path).select(F.trim("value").alias("v")).filter("v <> ''").limit(1).collect()
    whole = bool(first) and first[0]["v"].startswith("[")
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def with_file_order(rows: DataFrame, name: str = "file_ord") -> DataFrame:
    """Adds the row's place in its files' order: by file path, then by place in the file.

    Line-based files are cut into pieces that are numbered in order, so a piece's number and the place in it order a file's rows.
    """
    place = F.struct(F.input_file_name().alias("file"), F.expr("input_file_block_start()").alias("piece"), F.monotonically_increasing_id().alias("at"))
    return rows.withColumn(name, place)


def with_source_row(rows: DataFrame, order: str = "file_ord") -> DataFrame:
    """Adds the 1-based source_row in file order."""
    from lexiprobe.operators.splits import global_rank

    return global_rank(rows, [F.col(order)], "source_row")


def load_programs(spark: SparkSession, root: str, language: str, split: str, limit: int | None = None) -> DataFrame:
    """Programs of one language and split (files root/language/split.jsonl), empty ones left out, in file order."""
    from lexiprobe.functions.text import join_tokens

    rows = with_file_order(spark.read.schema("idx bigint, code_tokens array<string>").json(f"{root}/{language}/{split}.jsonl"))
    rows = rows.select("idx", join_tokens(F.col("code_tokens")).alias("code"), F.lit(language).alias("language"), F.lit(split).alias("split"), "file_ord").filter("code <> ''")
    return rows if limit is None else rows.orderBy("file_ord").limit(limit)


def project_repository(rows: DataFrame, body: bool = False, docstring: bool = False) -> DataFrame:
    """repo, path, code[, docstring], language of hub rows under either of their field names."""
    pick = lambda *names: F.coalesce(*(F.col(n) for n in names if n in rows.columns), F.lit(None).cast("string"))
    code = pick("func_code_string", "code") if body else pick("whole_func_string", "original_string", "code")
    return rows.select(pick("repository_name", "repo").alias("repo"), pick("func_path_in_repository", "path").alias("path"), code.alias("code"), *([pick("func_documentation_string", "docstring").alias("docstring")] if docstring else []), F.col("language"))


def read_activations(spark: SparkSession, path: str, layers: list[int] | None = None) -> DataFrame:
    """An activation store, partitioned by layer so that other layers are never read."""
    rows = spark.read.schema(ACTIVATION).parquet(path)
    return rows if layers is None else rows.filter(F.col("layer").isin(layers))


def write_activations(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("layer").parquet(path)


def check_stores(a: dict, b: dict, fields: tuple[str, ...] = ("label_field", "model_id")) -> None:
    """Two stores' metadata must agree on ``fields``."""
    differ = [f for f in fields if a.get(f) != b.get(f)]
    if differ:
        raise ValueError(f"stores differ in {differ}")


def dimensions_of_file(pattern: str, names: list[str]) -> list[Column]:
    """Columns taken out of the file's name by a pattern's groups."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return [F.regexp_extract(name, pattern, i + 1).alias(n) for i, n in enumerate(names)]


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """One folder a split."""
    rows.write.mode("overwrite").partitionBy(split).json(path)


def guarded_write(rows: DataFrame, old: DataFrame | None, path: str, key: list[str]) -> None:
    """Writes results; refuses when keys that are published already would go."""
    if old is not None:
        gone = old.join(rows, key, "left_anti").select(*key).limit(5).collect()
        if gone:
            raise ValueError(f"published rows would be dropped: {[tuple(r) for r in gone]}")
    rows.write.mode("overwrite").option("header", True).csv(path)


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def read_synthetic(spark: SparkSession, path: str) -> DataFrame:
    """example_id and code of a CSV in the order of its ids as numbers (0 where one is none); rows without code are left out."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    rows = rows.withColumn("example_id", F.coalesce(F.expr("try_cast(example_id AS BIGINT)"), F.lit(0).cast("bigint")))
    return rows.filter(F.coalesce(F.col("code"), F.lit("")) != "").select("example_id", "code").orderBy("example_id")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def manifest_records(manifest: DataFrame, tensors: DataFrame, span: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(records, stats): manifest rows (activation_path, occurrence_type, ``span`` columns) with the vector of the tensor (name, vec) of their file.

    Rows without a path or type are not usable. Of rows with one span the first stays, or none where their types differ;
    rows whose file is missing are counted. occurrence_id is the file's name without its ending.
    """
    from lexiprobe.operators.occurrences import conflict_free

    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    usable = manifest.filter(full("activation_path") & full("occurrence_type"))
    groups = usable.groupBy(*span).agg(F.count(F.lit(1)).alias("k"), F.count_distinct("occurrence_type").alias("types"))
    # null is a value of a span as any other: it is replaced for grouping only
    kept = conflict_free(usable.withColumn("__span", F.to_json(F.struct(*span), {"ignoreNullFields": "false"})), ["__span"], "occurrence_type", order).drop("__span")
    both = kept.withColumn("__name", base_name(F.col("activation_path"))).join(tensors.select(F.col("name").alias("__name"), "vec"), "__name", "left")
    records = both.filter("vec IS NOT NULL").withColumn("occurrence_id", F.regexp_replace("__name", r"\.[^.]*$", "")).drop("__name")
    n = groups.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("usable"), F.coalesce(F.sum(F.when(F.col("types") == 1, F.col("k") - 1)), F.lit(0)).alias("duplicates"), F.coalesce(F.sum(F.when(F.col("types") > 1, F.col("k"))), F.lit(0)).alias("conflicts"))
    return records, n.crossJoin(both.agg(F.count_if(F.col("vec").isNull()).alias("missing"), F.count_if(F.col("vec").isNotNull()).alias("records")))
