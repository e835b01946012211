"""Checks for leakage between splits, and integrity gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.dedup import class_grams, jaccard_pairs, text_classes
from lexloom.runtime import materialize, small


def shared_keys(rows: DataFrame, key: str, a: str = "train", b: str = "test") -> DataFrame:
    """Keys that occur in both splits; one partial aggregation, no join."""
    in_a, in_b = F.max((F.col("split") == a).cast("int")), F.max((F.col("split") == b).cast("int"))
    return rows.where(F.col(key).isNotNull() & F.col("split").isin(a, b)).groupBy(key).agg(in_a.alias("a"), in_b.alias("b")).where("a = 1 and b = 1").select(key)


def leaked_rows(rows: DataFrame, text: str, a: str = "train", b: str = "test") -> DataFrame:
    """Rows of split b whose text also stands in split a. The texts meet by hash and are compared again as a whole."""
    h = F.sha2(F.col(text), 256)
    seen = rows.where(F.col("split") == a).select(h.alias("h")).distinct()
    return rows.where(F.col("split") == b).withColumn("h", h).join(seen, "h", "left_semi").drop("h")


def near_duplicates(rows: DataFrame, key: str, text: str, t: float = 0.8, a: str = "train", b: str = "test") -> DataFrame:
    """Keys of split b with a near duplicate in split a. Only classes of equal texts are compared, and told to their rows of split b."""
    x = text_classes(rows.where(F.col("split").isin(a, b)).select(key, "split", text), key, text)
    x = materialize(x.select(key, "split", "t", "cls"), "members")
    cls = x.groupBy("cls").agg(F.min("t").alias("t"), F.bool_or(F.col("split") == a).alias("in_a"), F.bool_or(F.col("split") == b).alias("in_b"))
    cls = materialize(cls, "classes")
    sets = class_grams(cls.select("cls", "t")).join(cls.select("cls", "in_a", "in_b"), "cls")
    found = jaccard_pairs(sets, "cls", t, F.col("in_b"), F.col("in_a")).select(F.col("a").alias("cls"))
    found = found.unionByName(cls.where("in_a and in_b").select("cls")).distinct()
    return x.where(F.col("split") == b).join(small(materialize(found, "found")), "cls", "left_semi").select(key).distinct()


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number; must be empty for a clean table."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def report(questions: DataFrame, chunks: DataFrame, splits: DataFrame, t: float = 0.8) -> DataFrame:
    """One row per check with the number of findings and whether it passed.

    questions: qid, question, chunk_id, group_id, split (clean, one row per qid); chunks:
    chunk_id, text; splits: group_id, split.
    """
    with_text = questions.select("qid", "chunk_id", "split").join(chunks.select("chunk_id", "text"), "chunk_id")
    wrong = questions.where("split = 'test'").join(splits.withColumnRenamed("split", "given"), "group_id").where("given <> 'test'")
    found = {
        "group_overlap": shared_keys(questions, "group_id"),
        "chunk_overlap": shared_keys(questions, "chunk_id"),
        "identical_text": leaked_rows(with_text, "text"),
        "near_duplicate_questions": near_duplicates(questions, "qid", "question", t),
        "split_mislabel": wrong,
    }
    out = None
    for name, df in found.items():
        row = df.agg(F.count("*").alias("n_found")).select(F.lit(name).alias("check_name"), "n_found", (F.col("n_found") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def verdict(checks: DataFrame) -> DataFrame:
    """PASS if all checks passed, else FAIL."""
    return checks.agg(F.when(F.bool_and("passed"), "PASS").otherwise("FAIL").alias("verdict"), F.count_if(~F.col("passed")).alias("n_failed"))
