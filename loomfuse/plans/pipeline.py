"""From sources to outputs: ``run`` and the steps it is made of."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfuse.operators.identity import clusters
from loomfuse.operators.profiles import merge_clusters
from loomfuse.operators.projection import project, render
from loomfuse.operators.records import normalize_records
from loomfuse.operators.validation import DEFAULT_SCHEMA, config_errors, default_errors
from loomfuse.plans.components import _cut
from loomfuse.plans.config import OutputConfig, ProjectionError, ValidationError
from loomfuse.sources.readers import FILE_READERS, READERS, TEXT_READERS, detect_type
from loomfuse.sources.schemas import RAW


@dataclass
class Source:
    """A path, or pasted text, and its type (found from the path's name if not given)."""

    path: str = ""
    type: str | None = None
    text: str | None = None


@dataclass
class Result:
    """outputs: cluster, json (and output); profiles: all fields; warnings: source or cluster, message. Outputs and profiles share ``cluster``."""

    outputs: DataFrame
    profiles: DataFrame
    warnings: DataFrame


def places(spark: SparkSession, path: str) -> list[str]:
    """The files and folders that a path or pattern stands for, by their full names; none if nothing is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [fs.makeQualified(s.getPath()).toString() for s in fs.globStatus(at) or []]


def read_sources(spark: SparkSession, roots: dict[str, list[tuple[int, str]]]) -> DataFrame:
    """RAW rows with ``file`` and ``error`` of the sources (number, full path) of each type: one scan a type, however many sources."""
    every = spark.createDataFrame([], RAW).withColumns({"file": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    for kind, found in roots.items():
        names = {p for _, p in found}
        tops = sorted(p for p in names if not any(p.startswith(q.rstrip("/") + "/") for q in names))
        encoded = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).toUri().toString()  # noqa: E731  the text source tells names so
        specs = sorted({(i, q) for i, p in found for q in (p, encoded(p))})
        every = every.unionByName(FILE_READERS[kind](spark, tops, spark.createDataFrame(specs, "spec_idx int, root string")))
    return every


def extract_all(spark: SparkSession, sources: list[Source | str]) -> tuple[DataFrame, DataFrame]:
    """(RAW rows, warnings (source, message)). Good and bad rows come out of one plan, which runs once: a file with an error
    contributes nothing but its warning, and the others go on. Sources of types that were added to ``READERS`` are read one by one."""
    notes, roots, parts, told = [], {}, [], []
    for i, s in enumerate(Source(x) if isinstance(x, str) else x for x in sources):
        kind = s.type or detect_type(s.path)
        label, path = s.path or f"pasted {kind}", s.path
        if s.text is not None and (kind not in READERS or not s.text.strip()):
            continue
        if s.text is not None and kind == "recruiter_csv":
            path = f"{_pasted(spark)}/{i}"
            spark.createDataFrame([(s.text,)], "value string").coalesce(1).write.text(path)
        if kind is None:
            notes.append((label, "source type not recognised; skipped"))
        elif kind not in READERS:
            notes.append((label, f"no reader for type {kind!r}; skipped"))
        elif s.text is not None and kind in TEXT_READERS:
            told.append((i, label))
            parts.append(TEXT_READERS[kind](spark.createDataFrame([(i, label, s.text)], "spec_idx int, path string, text string")))
        elif kind in FILE_READERS:
            if found := places(spark, path):
                told.append((i, label))
                roots.setdefault(kind, []).extend((i, p) for p in found)
            else:
                notes.append((label, "contributed no records (not found)"))
        else:
            try:
                parts.append(READERS[kind](spark, path, i))
                told.append((i, label))
            except Exception as e:  # noqa: BLE001  a source that cannot be opened must not end the run
                notes.append((label, f"contributed no records ({type(e).__name__})"))
    every = read_sources(spark, roots)
    for rows in parts:
        every = every.unionByName(rows, allowMissingColumns=True)
    every = _cut(every)
    faults = every.where("error is not null").select("spec_idx", "file", "error").distinct()
    raw = every.where("error is null").join(faults.select("spec_idx", "file"), ["spec_idx", "file"], "left_anti").select(*RAW.names)
    labels = spark.createDataFrame(told, "spec_idx int, source string")
    empty = labels.join(every.select("spec_idx").distinct(), "spec_idx", "left_anti").select("source", F.lit("contributed no records").alias("message"))
    bad = faults.join(labels, "spec_idx").select("source", F.concat(F.lit("contributed no records ("), F.substring_index("file", "/", -1), F.lit(" "), "error", F.lit(")")).alias("message"))
    return raw, spark.createDataFrame(notes, "source string, message string").unionByName(empty).unionByName(bad)


def _pasted(spark: SparkSession) -> str:
    import uuid

    from loomfuse.plans.components import shared_dir

    return f"{shared_dir(spark)}/pasted-{uuid.uuid4().hex}"


def build_profiles(raw: DataFrame, default_region: str = "US") -> DataFrame:
    """Profiles of RAW rows, one a cluster. Records with their clusters are written, as three aggregations read them."""
    return merge_clusters(_cut(clusters(_cut(normalize_records(raw, default_region)))))


def shape(profiles: DataFrame, config: OutputConfig | None = None, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(outputs, warnings) of profiles by a configuration, or in the default form."""
    if config is None:
        names = list(DEFAULT_SCHEMA)
        df = profiles.select("cluster", "candidate_id", F.struct(*names).alias("output"), F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("json"), (default_errors(profiles) if validate else F.array().cast("array<string>")).alias("errors"))
    else:
        df = project(profiles, config)
        ids = profiles.select("cluster", "candidate_id")
        if validate:
            df = df.withColumn("errors", F.concat("errors", config_errors(df, config)))
        df = df.withColumn("json", render(df, [f.path for f in config.fields])).join(ids, "cluster").select("cluster", "candidate_id", "output", "json", "errors")
    good = df.where(F.size("errors") == 0).drop("errors")
    bad = df.where(F.size("errors") > 0).select(F.col("candidate_id").alias("source"), F.concat_ws("; ", "errors").alias("message"))
    return good, bad


def run(spark: SparkSession, sources: list[Source | str], config: OutputConfig | None = None, validate: bool = True, strict: bool = False) -> Result:
    """Read, normalize, resolve, merge, shape and check. ``strict``: the first row that breaks the configuration or a schema raises
    ProjectionError or ValidationError; else such rows become warnings."""
    raw, warnings = extract_all(spark, sources)
    profiles = _cut(build_profiles(raw, config.default_region if config else "US"))
    outputs, bad = shape(profiles, config, validate)
    if strict and (first := bad.orderBy("source").first()) is not None:
        raise (ProjectionError if first["message"].startswith("required value") else ValidationError)(f"{first['source']}: {first['message']}")
    order = ["candidate_id", "cluster"]
    return Result(outputs.orderBy(*order), profiles.orderBy(*order), warnings.unionByName(bad))




def write_outputs(outputs: DataFrame, path: str) -> None:
    """The outputs as JSON lines, by Spark's own writer: nothing passes through the driver."""
    outputs.select("json").write.mode("overwrite").text(path)
