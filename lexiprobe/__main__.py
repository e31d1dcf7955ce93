"""Command line: python -m lexiprobe COMMAND ... Each command is one function of the library over files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from lexiprobe.session import local_session

PROGRAMS = "problem_id string, language string, split string, code string"


def _programs(spark, path):
    return spark.read.schema(PROGRAMS).json(path)


def query(spark, a) -> None:
    """Run a registered query over a folder of tables."""
    from lexiprobe import queries

    rows = queries.queries()[a.name](spark, a.tables)
    rows.write.mode("overwrite").parquet(a.output) if a.output else rows.show(50, truncate=False)


def names(spark, a) -> None:
    """List the registered queries."""
    from lexiprobe import queries

    print("\n".join(sorted(queries.queries())))


def build(spark, a) -> None:
    """Roles of programs, those without any left out; counts beside the output."""
    from lexiprobe.functions.roles import roles_of
    from lexiprobe.sources.reports import write_marked

    rows = _programs(spark, a.input).withColumn("roles", roles_of(F.col("code"), F.col("language")))
    some = F.exists(F.map_values("roles"), lambda names: F.size(names) > 0)
    print(json.dumps(write_marked(rows.filter(some), a.output, {"programs": F.count(F.lit(1)), "languages": F.count_distinct("language")}), sort_keys=True))


def extract(spark, a) -> None:
    """Occurrences of flags, or of the names of all roles."""
    from lexiprobe.operators.occurrences import program_occurrences, role_occurrence_rows
    from lexiprobe.sources.reports import write_marked

    rows = (role_occurrence_rows if a.roles else program_occurrences)(_programs(spark, a.input))
    print(json.dumps(write_marked(rows, a.output, {"rows": F.count(F.lit(1)), "programs": F.count_distinct("problem_id")}), sort_keys=True))


def rename(spark, a) -> None:
    """Programs renamed by a strategy."""
    from lexiprobe.functions.rename import renamed

    rows = _programs(spark, a.input).withColumn("strategy", F.lit(a.strategy))
    rows.withColumn("code", renamed("code", "strategy", F.xxhash64("problem_id"), F.col("language"))).write.mode("overwrite").json(a.output)


def split(spark, a) -> None:
    """Groups with their fold by hash."""
    from lexiprobe.operators.splits import hash_split

    rows = spark.read.json(a.input).select(F.col(a.group).alias("group")).distinct()
    rows.select("group", hash_split(F.col("group"), a.seed).alias("split")).write.mode("overwrite").json(a.output)


def delta(spark, a) -> None:
    """Paired difference of macro F1 of two prediction files, with its interval over clusters; refused where they are not of one data set."""
    from lexiprobe.operators import bootstrap as B
    from lexiprobe.operators import metrics as M
    from lexiprobe.operators.joins import paired_predictions

    schema = "occurrence_id string, seed int, y_true int, y_pred int, cluster string"
    read = lambda path: spark.read.schema(schema).json(path).filter(F.col("seed") == a.seed)
    both = paired_predictions(read(a.first), read(a.second), "occurrence_id", partial=a.allow_partial)
    sums = ["tn", "fp", "fn", "tp"]
    cells = M.confusion_by(both, ["cluster"], p="pred_a").withColumn("m", F.lit("a")).unionByName(M.confusion_by(both, ["cluster"], p="pred_b").withColumn("m", F.lit("b")))
    f = M.macro_f1_binary(*(F.col(x) for x in ("tp", "fp", "fn", "tn")))
    boot = B.replicates(cells, B.draws(cells, "cluster", a.n_boot), "cluster", sums, ["m"]).withColumn("f", f)
    wide = boot.groupBy("replicate").agg((F.max(F.when(F.col("m") == "a", F.col("f"))) - F.max(F.when(F.col("m") == "b", F.col("f")))).alias("delta"), F.lit(1).alias("one"))
    print(json.dumps(B.percentile_interval(wide, ["one"], F.col("delta")).drop("one").first().asDict()))


def prompts(spark, a) -> None:
    """The paired prompts and the hash of their canonical form."""
    from lexiprobe.plans.prompts import canonical_payload, prompt_pairs

    rows = prompt_pairs(spark)
    rows.write.mode("overwrite").json(a.output)
    print(json.dumps(canonical_payload(rows, ["pair_id"]).first().asDict()))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lexiprobe", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    path = {"input": "--input", "output": "--output"}
    for f, needs in ((query, ()), (names, ()), (build, ("input", "output")), (extract, ("input", "output")), (rename, ("input", "output")), (split, ("input", "output")), (delta, ()), (prompts, ("output",))):
        c = commands.add_parser(f.__name__, help=f.__doc__)
        c.set_defaults(run=f)
        for n in needs:
            c.add_argument(path[n], required=True)
        if f is query:
            c.add_argument("name")
            c.add_argument("tables")
            c.add_argument("--output")
        elif f is extract:
            c.add_argument("--roles", action="store_true")
        elif f is rename:
            c.add_argument("--strategy", required=True)
        elif f is split:
            c.add_argument("--group", required=True)
            c.add_argument("--seed", type=int, default=0)
        elif f is delta:
            c.add_argument("first")
            c.add_argument("second")
            c.add_argument("--seed", type=int, default=0)
            c.add_argument("--n-boot", type=int, default=2000)
            c.add_argument("--allow-partial", action="store_true", help="pair what little is shared, too")
    a = parser.parse_args(argv)
    a.run(local_session(), a)


if __name__ == "__main__":
    main()
