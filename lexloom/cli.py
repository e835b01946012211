"""Command line over a folder of Parquet tables: python -m lexloom.cli STEP --data DIR [--out DIR] ...

Steps: collect, parse, chunk, samples, split, generate, filter, todo, judge, finalize, calibrate, audit (exit code 1 on FAIL),
evaluate, search.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.text import seeded
from lexloom.operators import asking, audit, bm25, chunking, pairs, providers, structure
from lexloom.operators import ranking as R
from lexloom.plans import corpus as C
from lexloom.plans import lawfiles as L
from lexloom.plans import pairs as P
from lexloom.plans import retrieval as V
from lexloom.runtime import materialize, table
from lexloom.sources import files


def _write(df: DataFrame, out: str | None, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{out}/{name}.parquet") if out else df.show(20, 80)


def parse(s: SparkSession, a) -> int:
    """Markdown files below --data: statutes in <law>/<kind>.md, cases below precedents/."""
    f = files.whole_files(s, a.data)
    kinds = F.create_map(*[F.lit(x) for kv in C.KINDS.items() for x in kv])
    path = F.split("path", "/")
    laws = f.where(~F.col("path").contains("/precedents/")).select(
        "text", F.try_element_at(path, F.lit(-2)).alias("law_name"), F.try_element_at(kinds, F.regexp_replace(F.try_element_at(path, F.lit(-1)), r"\.md$", "")).alias("doc_type")
    )
    docs = structure.parse_statutes(laws.where("doc_type is not null")).unionByName(structure.parse_cases(f.where(F.col("path").contains("/precedents/"))), allowMissingColumns=True)
    docs = materialize(docs, "documents")
    twice = audit.duplicate_ids(docs, "doc_id").limit(10).collect()
    if twice:
        sys.exit(f"ids that occur more than once: {[r[0] for r in twice]}")
    _write(docs, a.out, "documents")
    return 0


def chunk(s, a) -> int:
    c = materialize(L.chunk_documents(s, a.data), "chunks")
    over = chunking.over_budget(c, chunking.ChunkRules().max_tokens).limit(1).collect()
    if over:
        sys.exit(f"over the token budget: {over[0]}")
    _write(c, a.out, "chunks")
    return 0


def split(s, a) -> int:
    _write(P.stratified_group_split(s, a.data), a.out, "splits")
    return 0


def filter_(s, a) -> int:
    q = P.questions(s, a.data).withColumn("drop_reason", pairs.rule_cascade(F.col("question")))
    dup = P.greedy_priority_dedup(s, a.data).withColumnRenamed("drop_reason", "dup_reason")
    x = q.join(dup, "qid", "left").withColumn("drop_reason", F.coalesce("drop_reason", "dup_reason")).drop("dup_reason")
    _write(x, a.out, "queries_scored")
    return 0


def todo(s, a) -> int:
    t = P.resume_antijoin(s, a.data).orderBy("qid")
    _write(t.limit(a.limit) if a.limit else t, a.out, "todo")
    return 0


def finalize(s, a) -> int:
    """Kept pairs; refused while questions are not judged yet, unless --finalize."""
    _write(pairs.finalize(P.judged(s, a.data), ["yes", "partial"], incomplete=a.finalize).select("qid"), a.out, "queries_filtered")
    return 0


def calibrate(s, a) -> int:
    _write(P.calibration_summary(s, a.data), a.out, "judge_calibration")
    return 0


def audit_(s, a) -> int:
    rep = materialize(P.leakage_audit(s, a.data), "audit")
    _write(rep, a.out, "leakage_check")
    return int(audit.verdict(rep).first()["verdict"] == "FAIL")


def evaluate(s, a) -> int:
    """BM25 or vectors on one split's questions, those whose passage leaked left out unless --keep-leaked."""
    q = P.questions(s, a.data).where(F.col("split") == a.split)
    if not a.keep_leaked:
        q = q.join(P.leak_exclusion(s, a.data), "qid", "left_semi") if a.split == "test" else q
    ranks = V.source_ranks(s, a.data, q) if a.model == "bm25" else V.dense_source_ranks(s, a.data, q).withColumnRenamed("dense", "rank")
    ranks = materialize(ranks, "ranks")
    m = R.metrics(ranks).select(F.lit(a.name or a.model).alias("system"), F.lit(a.split).alias("split"), "*")
    _write(m, a.out, "metrics")
    print(files.metrics_table([r.asDict() for r in m.collect()]))
    R.bootstrap(ranks.withColumnRenamed("qid", "query_id")).show()
    return 0


def search(s, a) -> int:
    docs = bm25.tokens(table(s, a.data, "chunks").groupBy("chunk_id").agg(F.any_value("text").alias("text")), "chunk_id", "text")
    q = bm25.tokens(s.createDataFrame([(1, a.question)], "q int, text string"), "q", "text")
    bm25.search(docs, q, "chunk_id", "q", a.limit or 5).show(truncate=False)
    return 0


def collect(s, a) -> int:
    """Raw files below --data into a landing table under --out, with a provenance report."""
    f = files.whole_files(s, a.data).select("path", "text", F.lit(a.name).alias("commit_sha"), F.col("path").alias("url"))
    landed = materialize(files.land(f, f"{a.out}/landing"), "landed")
    report = landed.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes")).orderBy("folder")
    files.put(s, f"{a.out}/SOURCES.md", files.table_report(report, "Sources"))
    return 0


def _chain(a) -> providers.Chain:
    """Providers of --models (provider:model, comma-separated); without a network the offline one, which answers nothing of worth."""
    answer = lambda prompt, seed: {"results": [{"id": i, "questions": ["?"], "verdict": "partial", "reason": "offline"} for i in range(prompt.count("## "))]}
    return providers.Chain({"offline": providers.offline(answer)}, a.models.split(","), policy=providers.Policy(spacing=0.0))


def _log(s, a, name: str, schema: str):
    return lambda rows: files.append_log(s.createDataFrame([tuple(r.values()) for r in rows], schema), f"{a.out}/{name}") if rows else None


def generate(s, a) -> int:
    """Questions for chunks that have none yet, appended to a log under --out."""
    c = table(s, a.data, "chunks").where("text is not null").groupBy("chunk_id").agg(F.any_value("text").alias("text"))
    done = table(s, a.data, "queries_raw").where("chunk_id is not null").select("chunk_id")
    n, lost = asking.generate(c.join(done, "chunk_id", "left_anti").orderBy("chunk_id"), _chain(a), _log(s, a, "generated", "qid string, question string, chunk_id string, model string, seed long"), limit=a.limit or 100)
    print(f"{n} passages answered, {len(lost)} given up")
    return 0


def judge(s, a) -> int:
    """Verdicts on questions that have none yet, appended to a log under --out."""
    q = P.questions(s, a.data).where("question is not null").join(table(s, a.data, "judgments").select("qid"), "qid", "left_anti")
    x = q.join(P.chunks(s, a.data).select("chunk_id", "text"), "chunk_id").select("qid", "question", "text").orderBy("qid")
    n, lost = asking.judge(x, _chain(a), _log(s, a, "judged", "qid string, verdict string, reason string, model string, seed long"), limit=a.limit or 100)
    print(f"{n} pairs judged, {len(lost)} given up")
    return 0


def samples(s, a) -> int:
    """A few chunks of each type as Markdown under --out."""
    c = table(s, a.data, "chunks").select("chunk_id", "doc_type", "text").orderBy(seeded(42, F.col("chunk_id")), "chunk_id")
    files.put(s, f"{a.out}/samples.md", files.sample_report(c, "Samples", {"doc_type": "type", "text": "text"}, a.limit or 20))
    return 0


STEPS = {"collect": collect, "generate": generate, "judge": judge, "samples": samples, "parse": parse, "chunk": chunk, "split": split, "filter": filter_, "todo": todo, "finalize": finalize, "calibrate": calibrate, "audit": audit_, "evaluate": evaluate, "search": search}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("step", choices=STEPS)
    p.add_argument("--data", required=True)
    p.add_argument("--out")
    p.add_argument("--limit", type=int)
    p.add_argument("--split", default="test")
    p.add_argument("--name", default="")
    p.add_argument("--question", default="")
    p.add_argument("--models", default="offline:none")
    p.add_argument("--model", default="bm25", choices=["bm25", "dense"])
    p.add_argument("--keep-leaked", action="store_true")
    p.add_argument("--finalize", action="store_true", help="finalize although questions are not judged yet")
    a = p.parse_args(argv)
    return STEPS[a.step](SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
