"""Project documents, bundles, job snapshots and manual captures."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsflow.plans import runtime
from obsflow.plans.ordered import Deal, Ordered, dealt, row_number
from obsflow.sources.files import FileVersions, uri

# Document fields, limits and texts.
LINE = ("path:string,time:double,view:int,included:boolean,source_path:string,crop:array<double>,original_path:string,"
        "original_crop:array<double>,height_scale:double,visible_until:double,raw_source_path:string,bar_bounds:array<int>,"
        "bar_numbers:array<int>,bar_staff:array<double>,ai_bar_ids:array<int>,notes:array<string>")
PROJECT = ("version int, title string, source string, region struct<left:double,top:double,right:double,bottom:double>, "
           f"lines array<struct<{LINE}>>, warnings array<string>, notation string, bars_per_line int, bar_overrides map<string,int>, background string")
OLD_WARNINGS = ["Free mode keeps original colors", "Chord mode keeps original colors"]
NEW_WARNING = ("Review chord and lyric rows before printing. Use Background cleanup to choose White, Black, or Original. "
               "Moving or unoutlined text may need Manual mode.")
MAX_BYTES, MAX_ENTRIES = 2_000_000_000, 20_000


def parse_projects(docs: DataFrame, keys: list[str], json: str, version: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers, lines and errors of JSON project documents.

    Another version, malformed text or a missing required field is an error; fields added
    later have defaults.
    """
    p = docs.select(*keys, F.from_json(json, PROJECT).alias("p"))
    d = F.col("p")
    error = (F.when(d.isNull() | d["version"].isNull(), "malformed").when(d["version"] != version, "unsupported version")
             .when(d["title"].isNull() | d["source"].isNull() | d["region"].isNull() | d["lines"].isNull(), "missing field"))
    p = p.withColumn("error", error)
    good = p.filter("error is null")
    old = lambda w: F.startswith(w, F.lit(OLD_WARNINGS[0])) | F.startswith(w, F.lit(OLD_WARNINGS[1]))
    warnings = F.transform(F.coalesce(d["warnings"], F.array().cast("array<string>")), lambda w: F.when(old(w), NEW_WARNING).otherwise(w))
    head = good.select(*keys, d["title"].alias("title"), d["source"].alias("source"), d["region"].alias("region"), warnings.alias("warnings"),
                       F.coalesce(d["notation"], F.lit("staff")).alias("notation"), F.coalesce(d["bars_per_line"], F.lit(0)).alias("bars_per_line"),
                       F.coalesce(d["bar_overrides"], F.create_map().cast("map<string,int>")).alias("bar_overrides"),
                       F.coalesce(d["background"], F.lit("white")).alias("background"))
    lines = good.select(*keys, F.posexplode(d["lines"]).alias("seq", "l")).select(*keys, "seq", "l.*")
    lines = lines.withColumns({"included": F.coalesce("included", F.lit(True)), "height_scale": F.coalesce("height_scale", F.lit(1.0))})
    return head, lines, p.filter("error is not null").select(*keys, "error")


def read_projects(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read one document per file, in ``path`` or any folder below it; the key is the file's path.

    Each file is opened once: its text is kept in the checkpoint folder for the three results.
    """
    docs = _files(spark, path).select(F.col("path").alias("path_key"), F.col("text").alias("value"))
    return parse_projects(runtime.checkpoint(docs), ["path_key"], "value", version)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Path, time of modification and whole text of the files in a folder and below, or of a glob.

    Spark's text source serves file systems that pyarrow does not know.
    """
    try:
        fs.FileSystem.from_uri(re.split(r"[*?\[]", uri(path))[0])
    except (ValueError, OSError):
        raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
        return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("observed_at"), F.col("value").alias("text"))
    spark.dataSource.register(FileVersions)
    return spark.read.format(FileVersions.name()).option("path", path).load()


def project_parts(projects: DataFrame, lines: DataFrame, keys: list[str], order: list[str], per_part: int = 1000,
                  deal: Deal | None = None) -> DataFrame:
    """Text of each project document as consecutive parts.

    A part holds at most ``per_part`` lines, so a large project is never one value; the
    parts in order are the document.  ``projects``: keys and header fields, ``lines``: keys,
    order and line fields; ``deal`` where the lines are already dealt by the keys.
    """
    fields = [c for c in lines.columns if c not in keys]
    lines, deal = dealt(lines, keys, deal)
    o = Ordered(lines, keys, order, chunked=deal.chunked).with_columns(_rn=row_number())
    text = F.concat(F.when(F.col("_rn") == 1, "").otherwise(","), F.to_json(F.struct(*fields)))
    body = o.result.select(*keys, (F.floor((F.col("_rn") - 1) / per_part) + 1).alias("part"), F.struct(F.col("_rn").alias("r"), text.alias("t")).alias("_t"))
    body = body.groupBy(*keys, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_t")), lambda s: s["t"]), "").alias("text"))
    head_fields = [c for c in projects.columns if c not in keys]
    top = F.to_json(F.struct(F.lit(1).alias("version"), *head_fields))
    head = projects.select(*keys, F.lit(0).cast("bigint").alias("part"), F.regexp_replace(top, r"\}$", ',"lines":[').alias("text"))
    tail = projects.select(*keys, F.lit(9223372036854775807).cast("bigint").alias("part"), F.lit("]}").alias("text"))
    return head.unionByName(body.join(deal.of(projects.select(*keys), keys), keys, "left_semi")).unionByName(tail)


def write_projects(projects: DataFrame, lines: DataFrame, path: str, keys: list[str], order: list[str], per_part: int = 1000,
                   deal: Deal | None = None) -> None:
    """Write document parts as text, spread over tasks by project and part.

    Parts in order are the document; a project is not kept together.
    """
    parts = project_parts(projects, lines, keys, order, per_part, deal)
    parts.repartition(*keys, "part").sortWithinPartitions(*keys, "part").write.mode("overwrite").parquet(path)


def bundle_check(manifest: DataFrame, references: DataFrame, keys: list[str], entry: str, size: str, max_bytes: int = MAX_BYTES,
                 max_entries: int = MAX_ENTRIES) -> DataFrame:
    """Problems of archives: too large, entries outside the flat folder, odd files, missing images.

    ``references``: keys and the name of an image some line refers to.
    """
    e = F.col(entry)
    n = manifest.groupBy(*keys).agg(F.sum(size).alias("_b"), F.count(F.lit(1)).alias("_n")).filter((F.col("_b") > max_bytes) | (F.col("_n") > max_entries))
    big = n.select(*keys, F.lit("too large").alias("rule"), F.lit(None).cast("string").alias("entry"))
    bad = e.rlike(r"[/\\:]") | e.isin(".", "..")
    rule = F.when(bad, "invalid path").when((e != "project.json") & ~F.endswith(e, F.lit(".png")), "unexpected file")
    odd = manifest.select(*keys, rule.alias("rule"), e.alias("entry")).filter("rule is not null")
    have = manifest.select(*keys, e.alias("entry"))
    lost = references.select(*keys, F.col(entry).alias("entry")).distinct().join(have, [*keys, "entry"], "left_anti")
    return big.unionByName(odd).unionByName(lost.select(*keys, F.lit("missing image").alias("rule"), "entry"))


CHECKPOINT = "bars array<string>"


def snapshots_of(files: DataFrame, *more: Column) -> DataFrame:
    """State of each job from its files (job, name, text); half-written text counts as absent.

    ``more``: further aggregates of a job's files.
    """
    saved = F.size(F.from_json("text", CHECKPOINT, {"mode": "PERMISSIVE"})["bars"])
    saved = F.when(F.col("name") == "checkpoint.json", F.when(saved >= 0, saved))
    return files.groupBy("job").agg(F.coalesce(F.max(saved), F.lit(0)).alias("saved_bars"), F.bool_or(F.col("name") == "review.json").alias("finished"),
                                    F.bool_or(F.col("name") == "cancelled-draft.aiscore.json").alias("cancelled"), *more)


def usage_snapshots(spark: SparkSession, path: str, streaming: bool = False, pattern: str = r"([^/]+)/([^/]+)$", settle: float = 0) -> DataFrame:
    """Snapshots of a directory of job folders, files of folders below it included; as a stream, one row per new file version.

    ``pattern`` finds the job and the file's name in a path.  As a stream a file comes again
    whenever it is rewritten, so one that was half written (null ``saved_bars``) is retried.
    """
    if streaming:
        spark.dataSource.register(FileVersions)
        raw = spark.readStream.format(FileVersions.name()).option("path", path).option("settle", settle).load()
    else:
        raw = _files(spark, path)
    p, at, text = F.col("path"), F.col("observed_at"), F.col("text")
    files = raw.select(F.regexp_extract(p, pattern, 1).alias("job"), F.regexp_extract(p, pattern, 2).alias("name"), text.alias("text"), at.alias("observed_at"))
    if streaming:
        saved = F.size(F.from_json("text", CHECKPOINT, {"mode": "PERMISSIVE"})["bars"])
        return files.select("job", "name", "observed_at", F.when((F.col("name") == "checkpoint.json") & (saved >= 0), saved).alias("saved_bars"),
                            (F.col("name") == "review.json").alias("finished"), (F.col("name") == "cancelled-draft.aiscore.json").alias("cancelled"))
    return snapshots_of(files, F.max("observed_at").alias("observed_at"))


def append_captures(captures: DataFrame, keys: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Number captures in click order after the existing ones; nothing is detected or dropped."""
    out = Ordered(captures, keys, order).with_columns(seq=row_number()).result
    if existing is not None:
        last = existing.groupBy(*keys).agg(F.max("seq").alias("_last"))
        out = out.join(last, keys, "left").withColumn("seq", F.col("seq") + F.coalesce("_last", F.lit(0))).drop("_last")
    return out.withColumn("view", F.lit(0))
