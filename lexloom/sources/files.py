"""File sources and sinks: JSON lines, configuration, environment, front-matter Markdown, listings, reports."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.structure import front_matter


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Commit one batch of an append-only log."""
    df.write.mode("append").parquet(path)


def stream_jsonl(spark: SparkSession, folder: str, schema, handle, checkpoint: str, max_files: int = 1) -> None:
    """New JSON-line files below the folder as a stream, `max_files` a batch, through `handle(frame, batch_id)`; ends when all are read."""
    s = spark.readStream.schema(schema).option("mode", "FAILFAST").option("maxFilesPerTrigger", max_files).json(folder)
    s.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def put(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def land(texts: DataFrame, folder: str) -> DataFrame:
    """Raw texts (`path`, `text`, `commit_sha`, `url`) as a table in a landing folder that is emptied before; gives the provenance of each.

    A million small files are no input for a cluster, so the texts land as rows.
    """
    texts.select("path", "text", "commit_sha", "url").write.mode("overwrite").parquet(folder)
    raw = F.col("text").cast("binary")
    return texts.sparkSession.read.parquet(folder).select("path", F.lit("landed").alias("status"), F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).alias("n_bytes"), "commit_sha", "url")


def table_report(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small result as a Markdown table."""
    rows = [df.columns, ["---"] * len(df.columns), *[[str(v) for v in r] for r in df.limit(limit).collect()]]
    return f"# {title}\n\n" + "\n".join("|---" * len(df.columns) + "|" if r[0] == "---" else "| " + " | ".join(r) + " |" for r in rows)


def load_config(path: str | Path) -> dict:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load_env(path: str | Path) -> dict[str, str]:
    """KEY=VALUE lines; a byte order mark is tolerated; a missing file gives {}."""
    p = Path(path)
    out: dict[str, str] = {}
    for line in p.read_text(encoding="utf-8-sig").splitlines() if p.exists() else []:
        key, eq, value = line.partition("=")
        if eq:
            out[key.strip()] = value.strip()
    return out


def whole_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """`path` and `text` of every file below the folder, in any order; filters on the path prune what is read."""
    r = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return r.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """`path`, `length`, `modified` of every file, sorted, without reading contents."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return r.load(folder).select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")


def documents_with_front_matter(files: DataFrame) -> DataFrame:
    """`path`, `meta` (JSON of the YAML block), `body`; a block that is never closed is an error."""
    from lexloom.runtime import ship

    ship(files.sparkSession)

    def run(batches):
        import pandas as pd

        for p in batches:
            parsed = [front_matter(t or "") for t in p["text"]]
            yield pd.DataFrame({"path": p["path"], "meta": [json.dumps(m, ensure_ascii=False, default=str) for m, _ in parsed], "body": [b for _, b in parsed]})

    return files.select("path", "text").mapInPandas(run, "path string, meta string, body string")


def write_report(df: DataFrame, path: str | Path) -> dict:
    """The first row of a small result as pretty JSON."""
    row = df.first()
    out = row.asDict(True) if row else {}
    Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=2, default=str), encoding="utf-8")
    return out


def upsert(store: DataFrame | None, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the store whose keys are not in `new`, and `new`; the read-modify-write of a result table."""
    return new if store is None else store.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def metrics_table(rows: list[dict]) -> str:
    """Markdown table of systems; bounds are added where a row has `<metric>_lo` and `<metric>_hi`."""
    names = [("recall_1", "Recall@1"), ("recall_10", "Recall@10"), ("mrr_10", "MRR@10"), ("ndcg_10", "NDCG@10")]

    def cell(r: dict, k: str) -> str:
        bounds = f" [{r[k + '_lo']:.3f}–{r[k + '_hi']:.3f}]" if r.get(f"{k}_lo") is not None else ""
        return f"{r[k]:.3f}{bounds}"

    lines = ["| System | " + " | ".join(t for _, t in names) + " |", "|---" * (len(names) + 1) + "|"]
    return "\n".join(lines + [f"| {r['system']} | " + " | ".join(cell(r, k) for k, _ in names) + " |" for r in rows])


def sample_report(df: DataFrame, title: str, fields: dict[str, str], limit: int = 20) -> str:
    """Markdown of a few rows; the caller orders them."""
    out = [f"# {title}", ""]
    for r in df.limit(limit).collect():
        out += [f"## {r[0]}", *[f"- {label}: {r[c]}" for c, label in fields.items()], ""]
    return "\n".join(out)


def page(template: str, payload: dict) -> str:
    """A self-contained page: the payload in place of __DATA__."""
    return template.replace("__DATA__", json.dumps(payload, ensure_ascii=False).replace("</", "<\\/"))


def cached(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """A result kept as Parquet under a name made of its content's key, such as an encoded corpus."""
    path = f"{folder}/{key}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
