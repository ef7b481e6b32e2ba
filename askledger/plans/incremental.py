"""The analysis tables kept up to date file by file: a load rewrites the partitions of the files it concerns, no others.

Every table lies in one folder per source file. A file concerns itself and each file that shares a key with it, because of
two copies of a run, an entity or a record the first is kept and all are flagged. What a file holds of each key is a narrow
table of claims; only that is read over all files. From it follow

- the touched keys: those of the loaded files now, and those their old rows had;
- the affected files: the loaded ones and those that claim a touched key (an output file is also touched by its entities'
  input rows); their partitions are written again;
- the contested files: those that claim any key of an affected file; only their parsed rows are read.

For a key of an affected file all copies lie in contested files, so the operators give the same rows there as over all
files. If the first record with questions changes, every output file is affected: its question list judges all of them.

Loaded files whose time of loading the ledger does not know yet are taken up by the next `update`. The claims that old rows
had are noted before anything is replaced and the ledger is written last, so an update cut short is done again in full.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from askledger.operators import entities, records, weblogs
from askledger.operators.anomaly import union_all
from askledger.plans.pipeline import TABLES, tables_of
from askledger.sources import lines as ln
from askledger.sources.tables import drop_table, write_table
from askledger.streaming.resume import ingested_files, read_bronze

#: Parsed tables by the kind of file they come from, then analysis tables; `questions` has rows of one record only.
SHREDDED = {"weblogs": "weblog", "entities": "input", "records": "output", "output_runs": "output"}
KIND_OF = {
    "runs": "weblog", "search_calls": "weblog", "query_instances": "weblog", "merchants": "input", "terms": "input",
    "output_records": "output", "answers": "output", "citations": "output", "votes": "output",
}
STAGE_OF = {"weblog": weblogs.STAGE, "input": entities.STAGE, "output": records.STAGE}
FILE = "kind string, src_file string"
CLAIM = f"se10 string, run_key string, {FILE}"
LEDGER = f"{FILE}, ingested_at timestamp"
#: Claims of these kinds are by entity; those of logs by entity and run.
BY_RUN = "weblog"


def typed_path(out: str, name: str) -> str:
    return f"{out}/typed/{name}"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _read(spark: SparkSession, out: str, name: str, schema: StructType | str) -> DataFrame:
    path = typed_path(out, name)
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else spark.createDataFrame([], schema)


def _of(df: DataFrame, files: Iterable[str]) -> DataFrame:
    """Rows of some files; a filter on the partition column, so that other files are not opened."""
    return df.filter(F.col("src_file").isin(sorted(files)))


def _replace(df: DataFrame, out: str, name: str, files: Iterable[str], by: str = "src_file") -> None:
    """Write the partitions of the given files anew; those without rows now are removed."""
    spark = df.sparkSession
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    path = typed_path(out, name)
    for file in files:
        drop_table(spark, f"{path}/src_file={escape(file)}")
    df.write.mode("append").partitionBy(by).parquet(path)


def _shred(bronze: DataFrame, name: str) -> DataFrame:
    parse = {"weblogs": weblogs.shred, "entities": entities.shred, "records": records.shred_records, "output_runs": records.shred_runs}
    return parse[name](bronze)


@cache
def schemas(spark: SparkSession) -> dict[str, StructType]:
    """Schemas of parsed and analysis tables, from plans over no rows; they never change."""
    none = spark.createDataFrame([], ln.SCHEMA)
    parsed = {n: _shred(none, n) for n in ("weblogs", "entities", "records")}
    parsed["output_runs"] = _shred(parsed["records"], "output_runs")
    return {n: df.schema for n, df in {**parsed, **_analysed(parsed)}.items()}


def _analysed(parsed: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The analysis tables, terms with the file of their entity."""
    tables = tables_of(parsed)
    terms = tables["merchants"].select("src_file", "se10", F.explode("terms").alias("t")).select("src_file", "se10", "t.*")
    return {**tables, "terms": terms}


def _claims(parsed: DataFrame, name: str) -> DataFrame:
    """Which keys the rows of a parsed table have."""
    run_key = F.col("run_key") if name == "weblogs" else F.lit(None).cast("string")
    kept = F.col("is_run") if name == "weblogs" else F.col("is_record") if name == "records" else F.lit(True)
    return parsed.filter(kept & F.col("se10").isNotNull()).select("se10", run_key.alias("run_key"), "src_file").distinct()


def _all_claims(spark: SparkSession, out: str) -> DataFrame:
    schema = "se10 string, run_key string, src_file string"
    return union_all([_read(spark, out, f"claims_{kind}", schema).withColumn("kind", F.lit(kind)) for kind in STAGE_OF])


def _sharing(claims: DataFrame, keys: DataFrame, pairs: Iterable[tuple[str, str]]) -> dict[str, set[str]]:
    """Files of each kind that claim a key which `keys` has; `pairs` are (kind of the keys, kind of the files)."""
    found: dict[str, set[str]] = {kind: set() for kind in STAGE_OF}
    for theirs, kind in pairs:
        on = ["se10", "run_key"] if theirs == kind == BY_RUN else ["se10"]
        wanted = keys.filter(F.col("kind") == theirs).select(*on).distinct()
        files = claims.filter(F.col("kind") == kind).join(wanted, on, "left_semi").select("src_file").distinct()
        found[kind] |= {r.src_file for r in files.toLocalIterator()}
    return found


def _seed(spark: SparkSession, out: str, schema: StructType) -> tuple | None:
    """Place and questions of the first record with questions."""
    first = records.canonical(_read(spark, out, "seeds", schema)).first()
    return None if first is None else (tuple(first.seed), first.questions)


def waiting(spark: SparkSession, out: str) -> dict[str, set[str]]:
    """Loaded files, by kind, that the analysis tables do not hold as they were loaded last."""
    known = _read(spark, out, "files", LEDGER).withColumnRenamed("ingested_at", "known_at")
    loaded = ingested_files(spark, out).join(known, ["kind", "src_file"], "left").filter("known_at IS NULL OR known_at != ingested_at")
    files: dict[str, set[str]] = {kind: set() for kind in STAGE_OF}
    for r in loaded.select("kind", "src_file").toLocalIterator():
        files[r.kind].add(r.src_file)
    return files


def update(spark: SparkSession, out: str) -> dict[str, set[str]]:
    """Take up all files loaded since the last update; returns the files whose partitions were written, by kind."""
    fresh = waiting(spark, out)
    if not any(fresh.values()):
        return fresh
    shapes = schemas(spark)
    loaded = ingested_files(spark, out).select("kind", "src_file", "ingested_at")
    is_fresh = spark.createDataFrame([(k, f) for k, files in fresh.items() for f in files], FILE)
    taken = [tuple(r) for r in loaded.join(is_fresh, ["kind", "src_file"], "left_semi").toLocalIterator()]

    # What the old rows of these files claimed, before they go. A try that was cut short has left its note here.
    old = _all_claims(spark, out).join(is_fresh, ["kind", "src_file"], "left_semi")
    old.select("se10", "run_key", "kind", "src_file").write.mode("append").parquet(typed_path(out, "pending"))

    for name, kind in SHREDDED.items():
        if not fresh[kind]:
            continue
        source = _of(_read(spark, out, "records", shapes["records"]) if name == "output_runs" else read_bronze(spark, out, kind), fresh[kind])
        _replace(_shred(source, name), out, name, fresh[kind])
        if name != "output_runs":
            mine = _of(_read(spark, out, name, shapes[name]), fresh[kind])
            _replace(_claims(mine, name), out, f"claims_{kind}", fresh[kind])
        if name == "records":
            first = mine.filter("is_record and size(questions) > 0").groupBy("src_file").agg(F.min_by(F.struct(*[c for c in mine.columns if c != "src_file"]), F.struct(*records.ORDER)).alias("r"))
            _replace(first.select("src_file", "r.*"), out, "seeds", fresh[kind])

    claims = _all_claims(spark, out)
    touched = claims.join(is_fresh, ["kind", "src_file"], "left_semi").unionByName(_read(spark, out, "pending", CLAIM))
    own = [(kind, kind) for kind in STAGE_OF]
    affected = {k: files | fresh[k] for k, files in _sharing(claims, touched, [*own, ("input", "output")]).items()}
    seed, judged_by = _seed(spark, out, shapes["records"]), _read(spark, out, "judged_by", "seed string").first()
    if judged_by is None or judged_by.seed != repr(seed):
        affected["output"] |= {r.src_file for r in loaded.filter("kind = 'output'").select("src_file").toLocalIterator()}
    is_affected = spark.createDataFrame([(k, f) for k, files in affected.items() for f in files], FILE)
    theirs = claims.join(is_affected, ["kind", "src_file"], "left_semi")
    contested = {k: files | affected[k] for k, files in _sharing(claims, theirs, [*own, ("output", "input")]).items()}
    if seed:
        contested["output"].add(seed[0][records.ORDER.index("src_file")])

    parsed = {n: _of(_read(spark, out, n, shapes[n]), (affected if n == "output_runs" else contested)[kind]) for n, kind in SHREDDED.items()}
    tables = _analysed(parsed)
    for name, kind in KIND_OF.items():
        if affected[kind]:
            _replace(_of(tables[name], affected[kind]), out, name, affected[kind])
    for kind, stage in STAGE_OF.items():
        if affected[kind]:
            mine = tables["anomalies"].filter(F.col("stage") == stage).drop("stage")
            _replace(_of(mine, affected[kind]), out, f"anomalies/stage={stage}", affected[kind])

    write_table(spark.createDataFrame([(repr(seed),)], "seed string"), typed_path(out, "judged_by"))
    write_table(spark.createDataFrame(taken, LEDGER), typed_path(out, "files"), ["kind", "src_file"])
    drop_table(spark, typed_path(out, "pending"))
    return affected


def read_tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The analysis tables as the last update left them, under the names of `pipeline.TABLES`."""
    shapes = schemas(spark)
    found = {name: _read(spark, out, name, shapes[name]) for name in KIND_OF}
    found["terms"] = found["terms"].drop("src_file")
    found["questions"] = records.questions(_read(spark, out, "seeds", shapes["records"]))
    found["anomalies"] = _read(spark, out, "anomalies", shapes["anomalies"]).select(*shapes["anomalies"].names)
    return {name: found[name] for name in TABLES}
