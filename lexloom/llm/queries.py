"""The pN_ queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import containment, simjoin
from lexloom.llm.components import components
from lexloom.llm.contamination import leaked_spans
from lexloom.llm.encode import encode_corpus
from lexloom.llm.forms import transducer
from lexloom.llm.questions import HELD_OUT, TRAIN, document_of, group_splits, split_name
from lexloom.llm.repeats import shared_spans
from lexloom.llm.segment import oversized
from lexloom.llm.stratify import grouped_split
from lexloom.runtime import materialize, ship, spread_join, table

THRESHOLD = 0.8
PROPORTIONS = {"train": 0.8, "val": 0.1, "test": 0.1}


# 2: near-duplicate questions


def _questions(spark, d) -> DataFrame:
    q = table(spark, d, "queries_raw").select(F.col("qid").alias("key"), F.col("question").alias("text"), F.lit(3).alias("side"))
    return simjoin.prepare(q.where("qid is not null"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different questions with a similarity of at least 0.8."""
    prep = _questions(spark, d)
    pairs = simjoin.similar_classes(prep, THRESHOLD)
    return simjoin.member_pairs(prep, pairs).select(F.col("key_a").alias("qid_a"), F.col("key_b").alias("qid_b"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each question once, with its group (connected by links; named by its least qid) and its number of linked questions.

    Questions without any piece have a null group and no link.
    """
    prep = _questions(spark, d)
    pairs = simjoin.similar_classes(prep, THRESHOLD)
    m = materialize(prep.select("key", "cid").distinct(), "members")
    size = m.where("cid is not null").groupBy("cid").agg(F.count("*").alias("size"), F.min("key").alias("least"))
    other = simjoin.both_ways(pairs).join(size.select(F.col("cid").alias("other"), "size"), "other").groupBy("cid").agg(F.sum("size").alias("others"))
    comp = components(pairs.select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))).withColumnRenamed("node", "cid")
    cls = materialize(size.join(other, "cid", "left").join(comp, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "classes")
    name = cls.groupBy("component").agg(F.min("least").alias("group_id"))
    cls = cls.join(name, "component").select("cid", "group_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.col("size").alias("n"))
    out = spread_join(m.where("cid is not null"), materialize(cls, "named-classes"), ["cid"], "n").select(F.col("key").alias("qid"), "group_id", "n_links")
    return out.unionByName(m.where("cid is null").select(F.col("key").alias("qid"), F.lit(None).cast("string").alias("group_id"), F.lit(0).cast("bigint").alias("n_links")))


# 3: oversized values


def _oversized(spark, d, texts: bool) -> DataFrame:
    docs = table(spark, d, "documents")
    out = oversized(table(spark, d, "chunks"), "chunks.text", "chunk_id", "text", texts=texts)
    for c in ("holding", "summary"):
        out = out.unionByName(oversized(docs, f"documents.{c}", "doc_id", c, texts=texts))
    return out


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of at most 1,000 characters of all longer values, in order; values delivered twice count once."""
    return _oversized(spark, d, True).distinct()


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Check of the pieces of each value: in order and within the limit, together the whole text, repeating 1 to 120 characters, and ending where a sentence, line or word does.

    An end inside a word is allowed only where what the piece adds holds no blank at which to end.
    """
    docs = table(spark, d, "documents").select("doc_id", "holding", "summary")
    chunks = table(spark, d, "chunks").where(F.char_length("text") > 1000).select(F.lit("chunks.text").alias("field"), F.col("chunk_id").alias("row_key"), F.col("text").alias("whole"))
    whole = chunks.distinct()
    for c in ("holding", "summary"):
        whole = whole.unionByName(docs.where(F.char_length(c) > 1000).select(F.lit(f"documents.{c}").alias("field"), F.col("doc_id").cast("string").alias("row_key"), F.col(c).alias("whole")))
    p = p3_pieces(spark, d)
    g = p.groupBy("field", "row_key").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "end", "text"))).alias("p"))
    x = whole.join(g, ["field", "row_key"])
    n = F.size("p")
    pairs = F.transform(F.slice("p", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda q, i: F.struct(q["start"].alias("s"), F.col("p")[i]["end"].alias("e"), F.col("p")[i]["start"].alias("s0")))
    text_at = lambda q: F.col("whole").substr(q["start"] + 1, q["end"] - q["start"]) == q["text"]
    # what a piece adds to the one before
    fresh = lambda q, i: F.col("whole").substr(F.when(i > 0, F.col("p")[i - 1]["end"]).otherwise(0) + 1, q["end"] - F.when(i > 0, F.col("p")[i - 1]["end"]).otherwise(0))
    ends_well = lambda q: F.substring(q["text"], -1, 1).rlike(r"[\s.?!。？！…\"'”’」』)\]]") | F.col("whole").substr(q["end"] + 1, F.lit(1)).rlike(r"\s")
    natural = F.transform("p", lambda q, i: (q["piece"] == n) | ends_well(q) | ~fresh(q, i).rlike(r"\S\s+\S"))
    return x.select(
        "field", "row_key",
        (F.forall("p", lambda q: F.char_length(q["text"]) <= 1000) & (F.col("p.piece") == F.sequence(F.lit(1), n))).alias("within"),
        (F.forall("p", text_at) & (F.col("p")[0]["start"] == 0) & (F.col("p")[n - 1]["end"] == F.char_length("whole"))).alias("whole_text"),
        F.forall(pairs, lambda q: (q["e"] - q["s"] >= 1) & (q["e"] - q["s"] <= 120) & (q["s"] > q["s0"])).alias("overlapping"),
        F.forall(natural, lambda ok: ok).alias("natural"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The values that had to be cut."""
    return _oversized(spark, d, False).where("piece = 2").select("field", "row_key").distinct()


# 4: consistent form


def consistent_forms(df: DataFrame, field: str, key: str, value: str, dots: bool) -> DataFrame:
    """`field`, `row_key` string, `value`, `form` of every value that is not null. Narrow."""
    ship(df.sparkSession)

    def run(batches):
        t = transducer(dots)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([field] * b.num_rows, pa.string()), b.column(0), b.column(1), pa.array(t.many(b.column(1).to_pylist()), pa.string())],
                ["field", "row_key", "value", "form"],
            )

    rows = df.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("row_key"), F.col(value).alias("value"))
    return rows.mapInArrow(run, "field string, row_key string, value string, form string")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every law name and question in its consistent form; rows delivered twice count once."""
    laws = consistent_forms(table(spark, d, "documents"), "law_name", "doc_id", "law_name", True)
    asked = consistent_forms(table(spark, d, "queries_raw"), "question", "qid", "question", False)
    return laws.unionByName(asked.distinct())


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Values that differ from their consistent form."""
    laws = consistent_forms(table(spark, d, "documents"), "law_name", "doc_id", "law_name", True)
    asked = consistent_forms(table(spark, d, "queries_raw"), "question", "qid", "question", False)
    return laws.unionByName(asked).where("value <> form").select("field", "row_key").distinct()


# 5: overlaps across splits


def _sides_questions(spark, d) -> DataFrame:
    s = split_name(F.col("split"))
    q = table(spark, d, "queries_raw").where("qid is not null and split is not null")
    side = F.when(s == "train", TRAIN).when(s.isNotNull(), HELD_OUT)
    return q.select(F.col("qid").alias("key"), F.col("question").alias("text"), side.alias("side")).where("side is not null")


def _sides_chunks(spark, d) -> DataFrame:
    c = table(spark, d, "chunks").where("chunk_id is not null").select(F.col("chunk_id").alias("key"), "text", "group_id")
    return c.join(group_splits(spark, d), "group_id").select("key", "text", "side")


def cross_split_pairs(rows: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """`left` (held out), `right` (train), `similarity`, `containment` of pairs of different keys with a similarity of at least t. rows: key, text, side."""
    prep = simjoin.prepare(rows)
    return simjoin.cross_pairs(prep, simjoin.similar_classes(prep, t, two_sided=True))


def _overlap_links(rows: DataFrame) -> list[tuple[str, DataFrame, DataFrame]]:
    """(kind, members, links with `share`) of both kinds of overlap. rows: key, text, side.

    contained: a training text holds at least THRESHOLD of the held-out record's n-grams of
    five words. similar: the similarity of three-character pieces is at least THRESHOLD; this
    also finds texts that differ in their blanks.
    """
    words = containment.prepare(rows)
    contained = containment.contained_classes(words, THRESHOLD).withColumnRenamed("containment", "share")
    prep = simjoin.prepare(rows)
    m = simjoin.sides(prep)
    similar = simjoin.mixed_links(m, simjoin.similar_classes(prep, THRESHOLD, two_sided=True))
    return [("contained", simjoin.sides(words), contained), ("similar", m, similar.select("cid", "other", F.col("similarity").alias("share")))]


def p5_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """All overlaps, of classes of equal texts: the least held-out and train key, how many records each has, and the share.

    Of kind contained, classes have the same words; of kind similar, the same bare form. `p5_members` tells the class of each record.
    """
    out = None
    for field, rows in (("question", _sides_questions(spark, d)), ("chunk_text", _sides_chunks(spark, d))):
        for kind, m, links in _overlap_links(rows):
            x = simjoin.class_links(m, links).select(F.lit(field).alias("field"), F.lit(kind).alias("kind"), "eval_key", "train_key", F.round("share", 6).alias("share"), "n_eval", "n_train")
            out = x if out is None else out.unionByName(x)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The overlapping pairs in key order."""
    out = None
    for field, rows in (("question", _sides_questions(spark, d)), ("chunk_text", _sides_chunks(spark, d))):
        x = cross_split_pairs(rows).select(F.lit(field).alias("field"), F.least("left", "right").alias("key_a"), F.greatest("left", "right").alias("key_b")).distinct()
        out = x if out is None else out.unionByName(x)
    return out


def p5_members(spark: SparkSession, d: str) -> DataFrame:
    """Each held-out record that overlaps with training records: by field and kind, with the number of training records."""
    out = None
    for field, rows in (("question", _sides_questions(spark, d)), ("chunk_text", _sides_chunks(spark, d))):
        for kind, m, links in _overlap_links(rows):
            per = simjoin.class_links(m, links).groupBy("cid").agg(F.sum("n_train").alias("n_train"), F.max("n_eval").alias("n_eval"))
            per = materialize(per, "linked-classes")
            held = m.where(F.col("side").bitwiseAND(F.lit(HELD_OUT)) > 0).select("cid", "key")
            x = spread_join(held, per, ["cid"], "n_eval").select(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.col("key").alias("eval_key"), "n_train")
            out = x if out is None else out.unionByName(x)
    return out


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per field, kind, held-out split and source of the held-out record's document (of several, the least): records with any, and links to training records."""
    p = p5_members(spark, d)
    p = materialize(p.withColumn("doc_key", F.regexp_extract("eval_key", r"^(.+)#\d+(\|q\d+)?$", 1)), "overlaps")
    source = table(spark, d, "documents").select("doc_key", "source").groupBy("doc_key").agg(F.min("source").alias("source"))
    own = table(spark, d, "queries_raw").select(F.col("qid").alias("eval_key"), split_name(F.col("split")).alias("q_split")).groupBy("eval_key").agg(F.min("q_split").alias("q_split"))
    grp = group_splits(spark, d).select(F.col("group_id").alias("doc_key"), F.col("split").alias("g_split"))
    x = p.join(source, "doc_key", "left").join(own, "eval_key", "left").join(grp, "doc_key", "left")
    split = F.when(F.col("field") == "question", F.col("q_split")).otherwise(F.col("g_split"))
    return x.groupBy("field", "kind", split.alias("split"), "source").agg(F.count("*").alias("n_eval"), F.sum("n_train").alias("n_links"))


# 6: splits that keep groups together


SPLIT_NAMES = list(PROPORTIONS)


def assigned(spark: SparkSession, d: str) -> DataFrame:
    """`group_id`, `component`, `label`, `n`, `split` of each group and label: components of tied groups, each in the split it is placed in.

    A group is a document; groups that a question's id, chunk and group tie together form
    one component. A question delivered twice counts once; missing types are a label of
    their own. `delivered` says in which splits the group's questions stand as delivered.
    """
    q = table(spark, d, "queries_raw").select("qid", "chunk_id", "group_id", "doc_type", "qtype", split_name(F.col("split")).alias("given"))
    doc = document_of(F.col("qid"), F.col("chunk_id"), F.col("group_id"))
    by_chunk = document_of(F.lit(None).cast("string"), F.col("chunk_id"), F.lit(None).cast("string"))
    links = q.select(doc.alias("a"), by_chunk.alias("b")).where("a <> b").distinct()
    label = F.concat_ws("/", F.coalesce("doc_type", F.lit("-")), F.coalesce("qtype", F.lit("-")))
    rows = q.select("qid", doc.alias("group_id"), label.alias("label"), "given").where("group_id is not null")
    in_split = [F.coalesce(F.max(F.col("given") == x), F.lit(False)).alias(f"in_{x}") for x in SPLIT_NAMES]
    one = materialize(rows.groupBy("group_id", "label").agg(F.count_distinct("qid").alias("n"), *in_split), "group-labels")
    labels = [r[0] for r in one.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(256).collect()]
    if len(labels) > 255:
        raise ValueError("too many labels to stratify by")
    comp = components(links)
    tied = one.join(comp.withColumnRenamed("node", "group_id"), "group_id", "left").withColumn("component", F.coalesce("component", "group_id"))
    counts = F.array(*[F.coalesce(F.sum(F.when(F.col("label") == x, F.col("n"))), F.lit(0)).cast("bigint") for x in labels])
    placed = grouped_split(tied.groupBy("component").agg(counts.alias("counts")), labels, PROPORTIONS)
    return tied.join(placed, "component")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups that no single placement can leave as delivered: their questions stand in more than one of train, val and test."""
    given = [F.max(f"in_{x}").cast("int") for x in SPLIT_NAMES]
    g = assigned(spark, d).groupBy("group_id").agg(sum(given[1:], given[0]).alias("n"), F.count_distinct("split").alias("n_placed"))
    return g.where("n > n_placed").select("group_id")


def p6_assign(spark: SparkSession, d: str) -> DataFrame:
    """One split for each group, about 80, 10 and 10 percent of the rows, balanced by document and question type."""
    return assigned(spark, d).groupBy("group_id", "split").agg(F.sum("n").alias("n_rows"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """Check of the placement per label: its number of rows, whether no group stands in two splits, and whether each split has its share.

    The share may be missed by the rows that the largest component has of the label, and one more.
    """
    x = materialize(assigned(spark, d), "assigned")
    torn = x.groupBy("component").agg(F.count_distinct("split").alias("k")).where("k > 1").select("component", F.lit(True).alias("torn"))
    per = x.join(torn, "component", "left").groupBy("label", "component", "split").agg(F.sum("n").alias("n"), F.bool_or(F.col("torn").isNotNull()).alias("torn"))
    sums = [F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"n_{s}") for s in SPLIT_NAMES]
    g = per.groupBy("label").agg(F.sum("n").alias("n_rows"), F.max("n").alias("most"), F.bool_or("torn").alias("torn"), *sums)
    fair = [F.abs(F.col(f"n_{s}") - F.col("n_rows") * p) <= F.col("most") + 1 for s, p in PROPORTIONS.items()]
    return g.select("label", "n_rows", (~F.col("torn")).alias("whole"), (fair[0] & fair[1] & fair[2]).alias("in_proportion"))


# 7: encoding


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document's text."""
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


# 8: leaked test passages


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of each document, in its bare form, that stand in a test item, and so should be removed."""
    return leaked_spans(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the test items they contain."""
    return p8_spans(spark, d).select("doc_id", "item_id").distinct()


# 9: shared spans


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    """Shared characters, number of shared spans and the longest, of each document that shares any."""
    return shared_spans(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Shared characters of each document that shares any."""
    return p9_spans(spark, d).select("doc_id", "shared_chars")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_groups, p3_found, p3_pieces, p3_checks, p4_found, p4_forms, p5_found, p5_overlaps, p5_members, p5_report,
        p6_found, p6_assign, p6_shares, p7_ids, p8_found, p8_spans, p9_found, p9_spans,
    )
}
