"""Scans, checks, snapshot registry and run outputs."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SENTINELS, clean_nulls, zero_padded


def raw_delimited(spark: SparkSession, path: str | list[str], columns: Sequence[str], keep: Mapping[str, Sequence[str]] | None = None, sep: str = ";", encoding: str = "ISO-8859-1", sentinels: list[str] = SENTINELS) -> DataFrame:
    """Rows of delimited text as strings: the columns that exist, sentinels null, rows kept by case-insensitive values, and the file's name."""
    df = spark.read.csv(path, sep=sep, encoding=encoding, header=True, inferSchema=False, enforceSchema=False)
    own = [c for c in columns if c in df.columns]
    missing = [c for c in keep or {} if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing} in {path}")
    for c, values in (keep or {}).items():
        df = df.where(F.upper(F.col(c)).isin([v.upper() for v in values]))
    return df.select(*[clean_nulls(c, sentinels).alias(c) for c in own], F.col("_metadata.file_name").alias("source_file"))


def preferred_files(files: DataFrame, name: str = "name", marker: str = "_BRASIL.", by: Sequence[str] = ()) -> DataFrame:
    """Of a listing, only the consolidated files if there are any, else all delimited ones; for each ``by`` (a year, an office) on its own."""
    text = files.where(F.lower(F.col(name)).rlike(r"\.(csv|txt)$"))
    whole = F.upper(F.col(name)).contains(marker)
    has = text.groupBy(*by).agg(F.coalesce(F.max(whole), F.lit(False)).alias("_any"))
    met = text.join(has, list(by)) if by else text.crossJoin(F.broadcast(has))
    return met.where(whole | ~F.col("_any")).drop("_any")


def conform(df: DataFrame, renames: Mapping[str, Sequence[str]], types: Mapping[str, str] | None = None) -> DataFrame:
    """Targets from the first non-null of the source columns that exist; a target without any is null."""
    types = types or {}
    out = []
    for target, sources in renames.items():
        have = [F.col(s) for s in sources if s in df.columns]
        value = F.coalesce(*have) if have else F.lit(None).cast("string")
        out.append((value.try_cast(types[target]) if target in types else value).alias(target))
    return df.select(*out)


def first_existing(df: DataFrame, *names: str) -> str:
    """The first of the names that is a column."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {names} among {df.columns}")


def column_roles(columns: Sequence[str], roles: Mapping[str, str], optional: Sequence[str] = ()) -> dict[str, str]:
    """Role of every column by the regular expression it matches; a column without role, and a role missing or doubled, is an error."""
    import re

    found: dict[str, str] = {}
    for c in columns:
        hits = [r for r, pattern in roles.items() if re.search(pattern, c, re.I)]
        if len(hits) != 1:
            raise ValueError(f"column {c!r} has the roles {hits}")
        if hits[0] in found.values() and not hits[0].endswith("*"):
            raise ValueError(f"role {hits[0]!r} twice")
        found[c] = hits[0]
    lacking = [r for r in roles if r not in found.values() and r not in optional]
    if lacking:
        raise ValueError(f"no column for {lacking}")
    return found


RESULT_SCHEMA = "cdabr string, dt string, ht string, pst string, carg array<struct<cd:string, agr:array<struct<par:array<struct<sg:string, cand:array<struct<n:string, nm:string, vap:string, st:string>>>>>>>>"


def nested_results(docs: DataFrame) -> DataFrame:
    """Rows per candidate of result documents ``RESULT_SCHEMA``: unit, share counted, office, party, number, name, votes."""
    c = docs.select("cdabr", F.replace("pst", F.lit(","), F.lit(".")).try_cast("double").alias("counted_pct"), F.explode("carg").alias("c"))
    a = c.select("cdabr", "counted_pct", F.col("c.cd").alias("office"), F.explode("c.agr").alias("a"))
    p = a.select("cdabr", "counted_pct", "office", F.explode("a.par").alias("p"))
    return p.select("cdabr", "counted_pct", "office", F.col("p.sg").alias("party"), F.explode("p.cand").alias("d")).select("cdabr", "counted_pct", "office", "party", F.col("d.n").alias("number"), F.col("d.nm").alias("name"), F.col("d.vap").try_cast("long").alias("votes"))


def reference_json(spark: SparkSession, path: str, schema: str, fields: Mapping[str, str]) -> DataFrame:
    """A reference list in JSON: each target is the (dotted) path of a field."""
    df = spark.read.schema(schema).json(path)
    return df.select(*[F.col(source).alias(target) for target, source in fields.items()])


def reference_csv(spark: SparkSession, path: str, padded: Mapping[str, int] | None = None) -> DataFrame:
    """A reference table as strings; empty is null, codes keep their zeros."""
    df = spark.read.csv(path, header=True, nullValue="", inferSchema=False)
    return df.withColumns({c: zero_padded(c, n) for c, n in (padded or {}).items()})


def census_counts(parts: Sequence[tuple[DataFrame, str, Mapping[str, Sequence[str]]]]) -> DataFrame:
    """Wide census tables joined by sector: each ``(table, key, {target: source columns})`` gives sums of its columns.

    Decimal commas are read, suppressed values (``X``) and missing sectors are 0.
    """
    out: DataFrame | None = None
    for df, key, targets in parts:
        value = lambda c: F.coalesce(F.replace(F.col(c), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
        own = df.select(F.trim(F.col(key)).alias("sector"), *[sum((value(c) for c in cols), F.lit(0.0)).alias(t) for t, cols in targets.items()])
        out = own if out is None else out.join(own, "sector", "full_outer")
    if out is None:
        raise ValueError("no census table")
    return out.fillna(0.0)


def latest_version(snapshots: DataFrame, by: Sequence[str], version: str = "version") -> DataFrame:
    """The rows of the last version of each dataset."""
    top = F.max(version).over(Window.partitionBy(*by))
    return snapshots.withColumn("_top", top).where(F.col(version) == F.col("_top")).drop("_top")


def inventory(manifests: DataFrame) -> DataFrame:
    """One row per snapshot: size, number of files, short digest, in order of dataset and version."""
    return manifests.select("dataset", "version", F.size("files").cast("long").alias("n_files"), F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + F.coalesce(f["bytes"], F.lit(0).cast("long"))).alias("bytes"), F.substring("sha256", 1, 12).alias("digest")).orderBy("dataset", "version")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and SHA-256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed_snapshots(snapshots: DataFrame, by: Sequence[str] = ("dataset",), version: str = "version", digest: str = "sha256") -> DataFrame:
    """Snapshots whose content differs from the one before."""
    before = F.lag(digest).over(Window.partitionBy(*by).orderBy(version))
    return snapshots.withColumn("_before", before).where(~F.col(digest).eqNullSafe(F.col("_before"))).drop("_before")


def stored_results(spark: SparkSession, path: str, inputs: DataFrame, compute: Callable[[DataFrame], DataFrame], digest: str = "sha256") -> DataFrame:
    """The results of ``inputs``, of which those with a stored digest are not computed again.

    ``compute`` gives rows with the digest of the input that they come from;
    they are appended under it.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = to_recompute(inputs, spark.read.parquet(path).select(F.col(digest).cast("string")), digest) if there else inputs
    compute(fresh).write.mode("append").partitionBy(digest).parquet(path)
    stored = spark.read.parquet(path).withColumn(digest, F.col(digest).cast("string"))
    return stored.join(inputs.select(digest).distinct(), digest, "left_semi")


def to_recompute(inputs: DataFrame, done: DataFrame, digest: str = "sha256") -> DataFrame:
    """Inputs whose digest has no result yet."""
    return inputs.join(done.select(digest).distinct(), digest, "left_anti")


def expect(df: DataFrame, required: Sequence[str] = (), min_rows: int = 1, exact_rows: int | None = None, checks: Mapping[str, Column] | None = None) -> DataFrame:
    """``(rule, passed, found)`` rows from one aggregate over the table; a check passes if no row breaks it."""
    spark = df.sparkSession
    lacking = [c for c in required if c not in df.columns]
    rules: list[tuple[str, Column, Column]] = [("min_rows", F.col("n") >= min_rows, F.col("n"))]
    if exact_rows is not None:
        rules.append(("exact_rows", F.col("n") == exact_rows, F.col("n")))
    own = {k: v for k, v in (checks or {}).items()}
    sums = [F.coalesce(F.sum(F.when(v, 0).otherwise(1)), F.lit(0)).cast("long").alias(f"c{i}") for i, v in enumerate(own.values())]
    one = df.agg(F.count("*").alias("n"), *sums)
    rules += [(k, F.col(f"c{i}") == 0, F.col(f"c{i}")) for i, k in enumerate(own)]
    made = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), p.alias("passed"), f.alias("found")) for k, p, f in rules])).alias("r")).select("r.*")
    names = spark.createDataFrame([("required_columns", not lacking, len(lacking))], "rule string, passed boolean, found long")
    return names.unionByName(made)


def require(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``df`` if all rules passed; else an error that names those that didn't."""
    failed = [r["rule"] for r in rules.where("not passed").limit(20).collect()]
    if failed:
        raise ValueError(f"failed: {failed}")
    return df


def dimension(spark: SparkSession, values: Mapping[str, Any], key: str, value: str) -> DataFrame:
    """A two-column table from a parsed mapping of names to a value or a list of values."""
    rows = [(k, str(x)) for k, v in values.items() for x in (v if isinstance(v, (list, tuple)) else [v])]
    return spark.createDataFrame(rows, f"{key} string, {value} string")


def write_run(df: DataFrame, path: str, run_id: str, parameters: Mapping[str, str], inputs: Mapping[str, str]) -> None:
    """Write a run's rows under its id, and a row of parameters and input digests beside them; a run that is repeated replaces its own."""
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"not a name of a folder: {run_id!r}")
    df.write.mode("overwrite").parquet(f"{path}/data/run_id={run_id}")
    meta = df.sparkSession.createDataFrame([(dict(parameters), dict(inputs))], "parameters map<string,string>, inputs map<string,string>")
    meta.write.mode("overwrite").parquet(f"{path}/runs/run_id={run_id}")


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last run."""
    last = spark.read.parquet(f"{path}/runs").agg(F.max(F.col("run_id").cast("string")).alias("run_id"))
    return spark.read.parquet(f"{path}/data").withColumn("run_id", F.col("run_id").cast("string")).join(F.broadcast(last), "run_id", "left_semi")
