"""Construction and judging of (question, passage) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.positions import positions


def split_name(c: Column) -> Column:
    """train, val or test of any usual spelling; null otherwise."""
    s = F.lower(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(s.isin("train", "training"), "train").when(s.isin("val", "valid", "validation", "dev"), "val").when(s == "test", "test")


def rule_cascade(question: Column, min_chars: int = 8, min_ratio: float = 0.7) -> Column:
    """Reason of the first rule a question breaks: too_short, not_korean, chinese_chars, article_number; else null."""
    q = F.coalesce(question, F.lit(""))
    return (
        F.when(F.char_length(X.norm(q)) < min_chars, "too_short")
        .when(X.script_ratio(q) < min_ratio, "not_korean")
        .when(X.has_ideograph(q), "chinese_chars")
        .when(X.has_article_number(q), "article_number")
    )


def latest_rows(df: DataFrame, key: str, newest: list[str]) -> DataFrame:
    """Last delivered row of each key. The struct maximum aggregates before the shuffle; no sort."""
    rest = [c for c in df.columns if c != key and c not in newest]
    return df.groupBy(key).agg(F.max(F.struct(*newest, *rest)).alias("r")).select(key, *[F.col("r")[c].alias(c) for c in [*newest, *rest]])


def judged(questions: DataFrame, judgments: DataFrame, not_applicable: list[str] = ("test",)) -> DataFrame:
    """Questions with their last verdict and `judge_status`: not_applicable, unjudged or judged."""
    j = latest_rows(judgments.select("qid", "created_at", "verdict", "reason", "judge_model"), "qid", ["created_at"])
    x = questions.join(j.drop("created_at"), "qid", "left")
    status = F.when(F.col("split").isin(list(not_applicable)), "not_applicable").when(F.col("verdict").isNull(), "unjudged").otherwise("judged")
    return x.withColumn("judge_status", status)


class Incomplete(Exception):
    """Questions are still to be judged."""


def finalize(pairs: DataFrame, keep: list[str], incomplete: bool = True) -> DataFrame:
    """Kept pairs: not judged at all, or judged with a verdict to keep. Verdicts must be real ones.

    With incomplete=False it is refused while any pair is unjudged.
    """
    if not keep or not set(keep) <= {"yes", "partial", "no"}:
        raise ValueError(f"no such verdicts: {keep!r} (quote yes and no in YAML)")
    if not incomplete and pairs.where("judge_status = 'unjudged'").limit(1).count():
        raise Incomplete("some pairs are not judged yet")
    return pairs.where((F.col("judge_status") != "judged") | F.col("verdict").isin(keep))


def cleaned_questions(q: DataFrame, most: int) -> DataFrame:
    """`qid`, `question` composed and trimmed; empty ones and those beyond the first `most` of a chunk, by their number, are left out."""
    x = q.select("qid", X.nfc(F.trim("question")).alias("question")).where("question <> ''")
    x = x.withColumn("_chunk", F.regexp_extract("qid", r"^(.+)\|q", 1)).withColumn("_k", F.try_to_number(F.nullif(F.regexp_extract("qid", r"\|q(\d+)$", 1), F.lit("")), F.lit("999999999")).cast("int"))
    return positions(x, ["_chunk"], ["_k", "qid"]).where(F.col("position") < most).select("qid", "question")


def wrong_pairs(questions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Negative controls: n questions, each with a chunk of another document.

    questions: `qid`, `chunk_id`, `group_id`. The sample is by hash; its partners are the
    next rows of a second hash order whose document differs, so that no cross join is formed.
    The first chunks of two documents stand by for questions whose document owns all of these rows.
    """
    picked = questions.withColumn("h", X.seeded(seed, F.col("qid"))).orderBy("h", "qid").limit(n)
    pool = questions.select(F.col("chunk_id").alias("wrong_chunk_id"), F.col("group_id").alias("other")).distinct()
    pool = pool.withColumn("h2", X.seeded(seed + 1, F.col("wrong_chunk_id")))
    spare = pool.where("other is not null").groupBy("other").agg(F.min(F.struct("h2", "wrong_chunk_id")).alias("s"))
    spare = spare.select("s.wrong_chunk_id", "other", "s.h2").orderBy("h2", "wrong_chunk_id").limit(2).withColumn("spare", F.lit(True))
    pool = pool.orderBy("h2", "wrong_chunk_id").limit(n + 64).withColumn("spare", F.lit(False)).unionByName(spare)
    x = picked.join(F.broadcast(pool), F.col("group_id") != F.col("other"))  # at most n + 66 rows
    w = Window.partitionBy("qid").orderBy("spare", X.seeded(seed + 2, F.col("qid"), F.col("wrong_chunk_id")), "wrong_chunk_id")
    return x.withColumn("r", F.row_number().over(w)).where("r = 1").select("qid", "chunk_id", "wrong_chunk_id")


def agreement(items: DataFrame, by: list[str]) -> DataFrame:
    """Exact agreement and agreement on the decision to keep, of `expected` and `verdict`."""
    keep = lambda c: F.col(c) == "yes"
    return items.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((F.col("expected") == F.col("verdict")).cast("double")).alias("exact"),
        F.avg((keep("expected") == keep("verdict")).cast("double")).alias("keep_decision"),
    )


def stratified_groups(groups: DataFrame, test: float = 0.1, val: float = 0.1, seed: int = 42) -> DataFrame:
    """groups: `group_id`, `stratum`, `forced` -> split. In each stratum the first by hash are test, the next val.

    Shares are rounded half to even. Forced groups are train and don't count. The order in
    a stratum is found by range: no stratum is sorted in one task, as the place of a hash
    among uniform ones is counted per bucket and only inside a bucket sorted.
    """
    g = groups.withColumn("h", X.seeded(seed, F.col("group_id")))
    free = g.where(~F.coalesce("forced", F.lit(False))).withColumn("bucket", F.shiftright("h", 20))
    sizes = free.groupBy("stratum", "bucket").agg(F.count("*").alias("m"))
    run = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.withColumn("off", F.coalesce(F.sum("m").over(run), F.lit(0))).withColumn("n", F.sum("m").over(Window.partitionBy("stratum")))
    w = Window.partitionBy("stratum", "bucket").orderBy("h", "group_id")
    x = free.withColumn("i", F.row_number().over(w) - 1).join(offs, ["stratum", "bucket"]).withColumn("place", F.col("i") + F.col("off"))
    n_test, n_val = F.bround(F.col("n") * test), F.bround(F.col("n") * val)
    split = F.when(F.col("place") < n_test, "test").when(F.col("place") < n_test + n_val, "val").otherwise("train")
    rest = g.where(F.coalesce("forced", F.lit(False))).select("group_id", "stratum", F.lit("train").alias("split"))
    return x.select("group_id", "stratum", split.alias("split")).unionByName(rest)
