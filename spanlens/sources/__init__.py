"""Readers and writers of record files, and views of the driver's tables as contracts."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import hashed

#: Names of the wrapper field that a JSON file may have.
WRAPPERS = ("records", "rows", "items", "data", "prompts")
TRACE = "id string, prompt string, trace string, raw_trace string, reasoning string, final string, parse_status string"
JUDGEMENT = "id string, refusal_judge boolean, rationale string, raw string, error string, attempts int"


def read_rows(spark: SparkSession, path: str, schema: str | None = None, tolerant: bool = False) -> DataFrame:
    """Rows of .jsonl, .json (an array or a wrapped one), .csv, .parquet or .orc; another ending is an error. Without a schema JSON is inferred, and a .json file is read whole by one task; `wrapped.records` reads a large one by many."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    if kind == "jsonl":
        return (reader.schema(schema) if schema else reader).json(path)
    if kind == "json":
        df = reader.option("multiLine", True).json(path)
        for w in WRAPPERS:
            if w in df.columns and df.schema[w].dataType.typeName() == "array":
                head = [c for c in df.columns if c != w]
                rows = df.select(*head, F.explode(w).alias("__r"))
                inner = rows.schema["__r"].dataType.fieldNames()
                return rows.select("__r.*", *(c for c in head if c not in inner))
        return df
    if kind == "csv":
        return reader.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "orc":
        return spark.read.orc(path)
    raise ValueError(f"unknown kind of file: {path}")


def traces(rows: DataFrame, text: str = "trace") -> DataFrame:
    """id, text; a null text is empty."""
    return rows.select(F.col("id").cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def judgements(rows: DataFrame, field: str = "refusal_judge", null_policy: str = "drop", errors: bool = False) -> DataFrame:
    """id, label; null labels dropped or made false; with `errors`, rows with an error dropped too."""
    label = F.col(field).cast("boolean")
    out = rows
    if errors and "error" in rows.columns:
        out = out.filter(F.col("error").isNull() | (F.col("error") == ""))
    if null_policy == "drop":
        out = out.filter(label.isNotNull())
    elif null_policy != "zero":
        raise ValueError(f"null_policy is drop or zero, not {null_policy}")
    return out.select(F.col("id").cast("string").alias("id"), F.coalesce(label, F.lit(False)).alias("label"))


def prompts(rows: DataFrame) -> DataFrame:
    """id, prompt, answer (of the two names it may have)."""
    has = rows.columns
    answer = F.coalesce(*(F.col(c) for c in ("answer", "gold_answer") if c in has), F.lit(None).cast("string"))
    return rows.select(F.col("id").cast("string").alias("id"), F.coalesce(F.col("prompt"), F.lit("")).alias("prompt"), answer.alias("answer"))


def first_groups(df: DataFrame, group: str, position: str, most: int) -> DataFrame:
    """Rows of the first `most` groups in order of their least position."""
    firsts = df.groupBy(group).agg(F.min(position).alias("__p")).orderBy("__p").limit(most)
    return df.join(F.broadcast(firsts.select(group)), group, "left_semi")  # at most `most` rows


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows that a hash picks, the same in every run."""
    return df.orderBy(hashed(F.lit(seed), key), key).limit(n)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all machines reach: below spark.checkpoint.dir, or in local mode a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spanlens-")
    return f"{at.rstrip('/')}/spanlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """`df` written once to a new folder that all machines reach, and read back: what follows starts from the table, also after an executor is lost. `options` of the writer."""
    at = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dataset(spark: SparkSession, root: str, split: str | None = None, column: str = "split") -> DataFrame:
    """A dataset folder partitioned by split; one split reads its own files only."""
    df = spark.read.parquet(root)
    return df if split is None else df.filter(F.col(column) == split)


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of the files below `paths`: their names, lengths and times of change. Files are listed by Spark and not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length", "modificationTime")
    h = F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))  # whatever the order
    r = files.agg(F.count("*").alias("n"), F.coalesce(h, F.lit(0)).alias("h")).first()  # one row
    return f"{r.n}:{r.h}"


def publish(df: DataFrame, path: str, mark: str = "") -> DataFrame:
    """`df` as the new version of the table at `path`; its rows.

    A version is written to a folder of its own and becomes the table by a pointer,
    one small row that Spark commits after it. Whatever dies before that leaves the old version
    in place; a reader sees one whole version or another, and one that has begun keeps its files.
    Versions stay until they are deleted by hand.
    """
    spark = df.sparkSession
    last = manifest(spark, path)
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/versions/{name}")
    written = spark.read.schema(df.schema).parquet(f"{path}/versions/{name}")
    row = spark.range(1).select(F.lit(name).alias("version"), F.lit((last.number if last else 0) + 1).cast("long").alias("number"), F.lit(written.count()).cast("long").alias("rows"), F.lit(mark).alias("mark"), F.lit(df.schema.json()).alias("fields"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/pointers")
    return written


def manifest(spark: SparkSession, path: str) -> Row | None:
    """version, number, rows, mark and fields of the table's newest version; None where nothing has been published. Of two with one number, written at the same time, the greater name holds for all readers."""
    try:
        rows = spark.read.schema("version string, number bigint, rows bigint, mark string, fields string").parquet(f"{path}/pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.orderBy(F.desc("number"), F.desc("version")).first()


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path` as it was last published."""
    m = manifest(spark, path)
    return None if m is None else spark.read.schema(StructType.fromJson(json.loads(m.fields))).parquet(f"{path}/versions/{m.version}")


def cached(df: DataFrame, path: str, inputs: Sequence[str], least: int = 1) -> DataFrame:
    """The table kept at `path` if it was made from the files below `inputs` as they are now and still has its rows, `least` or more; else `df`, kept there with their fingerprint."""
    spark = df.sparkSession
    mark = fingerprint(spark, inputs)
    m = manifest(spark, path)
    if m is not None and m.mark == mark and m.rows >= least:
        kept_rows = published(spark, path)
        try:
            if kept_rows.count() == m.rows:  # from the files' footers
                return kept_rows
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return publish(df, path, mark)


def pickled(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of pickled pandas frames, a file a task; write them to Parquet once. Unpickling can run code: only for files of one's own."""
    import pickle

    def frames(batches):
        for batch in batches:
            for content in batch["content"]:
                yield pickle.loads(content)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(frames, schema)


def write_wrapped(df: DataFrame, path: str, name: str, head: dict[str, str] | None = None) -> None:
    """One JSON document {head, name: [rows]}, nulls kept: for reports and small record files, since its rows meet in one task."""
    rows = df.agg(F.collect_list(F.struct(*df.columns)).alias(name))
    out = rows.select(*(F.lit(v).alias(k) for k, v in (head or {}).items()), name)
    out.select(F.to_json(F.struct(*out.columns), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path)


def write_wrapped_parts(df: DataFrame, path: str, name: str, head: dict[str, str] | None = None) -> None:
    """JSON documents {head, name: [rows]}, nulls kept: a file for each partition of `df`, written as its rows come, so no cell, task or group holds the table."""
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).rdd
    opening = json.dumps(head or {})[:-1] + (", " if head else "") + json.dumps(name) + ": ["

    def document(rows: Iterator[Row]) -> Iterator[tuple[str]]:
        yield (opening,)
        comma = ""
        for r in rows:
            yield (comma + r.value,)
            comma = ","
        yield ("]}",)

    df.sparkSession.createDataFrame(lines.mapPartitions(document), "value string").write.text(path)


def write_report(df: DataFrame, path: str, head: dict[str, str] | None = None) -> None:
    """The rows of a report as one indented JSON document."""
    write_wrapped(df, path, "rows", head)


def shown(c: Column | str) -> Column:
    """Three decimals for a number with a fraction, a dash for null."""
    text = F.col(c).cast("string") if isinstance(c, str) else F.when(c.isNotNull(), F.format_string("%.3f", c))
    return F.coalesce(text, F.lit("-"))


def markdown_row(*cells: Column | str) -> Column:
    """A line of a Markdown table: names as text, expressions as numbers of three decimals."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(shown, cells)), F.lit(" |"))


def latex_row(*cells: Column | str) -> Column:
    """A line of a LaTeX table."""
    return F.concat(F.concat_ws(" & ", *map(shown, cells)), F.lit(" \\\\"))


def write_rows(df: DataFrame, path: str, kind: str, fields: list[str] | None = None) -> None:
    """CSV (fields in order, nulls blank), JSON lines or Parquet through Spark's commit protocol, to a new folder: all or nothing. `publish` replaces a table."""
    out = df.select(*fields) if fields else df
    if kind == "csv":
        out.na.fill("").write.option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        out.write.json(path)
    elif kind == "parquet":
        out.write.parquet(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def report(df: DataFrame) -> DataFrame:
    """One row of JSON for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A table of a report's rows, numbers with three decimals, nulls as a dash."""
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    rows = df.limit(most).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows]) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
