"""Queries on questions, chunks, splits and judgments: rules, splits, near duplicates, audit, judging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.functions.positions import positions
from lexloom.operators import audit, dedup, pairs
from lexloom.runtime import materialize, table

PRIORITY = {"test": 0, "val": 1, "train": 2}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Clean readings: one row per question and chunk, splits in one spelling.

SPLIT = "case lower(regexp_replace(split, '[^\\p{L}]', '', 'g')) when 'train' then 'train' when 'training' then 'train' when 'val' then 'val' when 'valid' then 'val' when 'validation' then 'val' when 'dev' then 'val' when 'test' then 'test' end"
Q = f"""qs as (select qid, arg_max(question, ingested_at) as question, arg_max(chunk_id, ingested_at) as chunk_id, arg_max(doc_type, ingested_at) as doc_type,
        regexp_extract(qid, '^(.+)#\\d+\\|q\\d+$', 1) as group_id, arg_max({SPLIT}, ingested_at) as split from queries_raw group by qid)"""
C = "cs as (select distinct chunk_id, group_id, doc_type, text from chunks)"
G = "sp as (select distinct group_id, split from splits)"
N = "regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
DROP = f"""case when length({N.format('coalesce(question, chr(32))')}) < 8 then 'too_short'
    when length(regexp_replace(question, '[^가-힣]', '', 'g')) / greatest(1, length(regexp_replace(question, '[^\\p{{L}}]', '', 'g'))) < 0.7 then 'not_korean'
    when regexp_matches(question, '[{X.IDEOGRAPHS}]') then 'chinese_chars'
    when regexp_matches(question, '제[\\s\\v\\x1c-\\x1f\\x{{85}}\\p{{Z}}]*\\p{{Nd}}+[\\s\\v\\x1c-\\x1f\\x{{85}}\\p{{Z}}]*조') then 'article_number' end"""


def questions(s: SparkSession, d: str) -> DataFrame:
    """One row per question: the last delivered, with its document and a clean split."""
    q = table(s, d, "queries_raw").select("qid", "ingested_at", "question", "chunk_id", "doc_type", pairs.split_name(F.col("split")).alias("split"))
    own = [c for c in ("question", "chunk_id", "doc_type", "split")]
    g = q.groupBy("qid").agg(*[F.max_by(c, "ingested_at").alias(c) for c in own])
    return g.withColumn("group_id", F.regexp_extract("qid", r"^(.+)#\d+\|q\d+$", 1))


def chunks(s, d) -> DataFrame:
    return table(s, d, "chunks").select("chunk_id", "group_id", "doc_type", "text").distinct()


def splits(s, d) -> DataFrame:
    return table(s, d, "splits").select("group_id", "split").distinct()


# rules


@query(f"with {Q} select qid, {DROP} as drop_reason from qs")
def rule_cascade(s, d):
    return questions(s, d).select("qid", pairs.rule_cascade(F.col("question")).alias("drop_reason"))


@query(
    f"""with {Q}, r as (select coalesce(split, 'none') as split, {DROP} as reason from qs)
    select split, coalesce(reason, 'candidate') as reason, count(*) as n from r group by all
    union all select 'total', coalesce(reason, 'candidates'), count(*) from r group by all"""
)
def drop_reason_counts(s, d):
    r = questions(s, d).select(F.coalesce("split", F.lit("none")).alias("split"), pairs.rule_cascade(F.col("question")).alias("reason"))
    c = r.groupBy("split", "reason").agg(F.count("*").alias("n"))
    total = c.groupBy("reason").agg(F.sum("n").alias("n")).select(F.lit("total").alias("split"), F.coalesce("reason", F.lit("candidates")).alias("reason"), "n")
    return c.select("split", F.coalesce("reason", F.lit("candidate")).alias("reason"), "n").unionByName(total)


# splits


@query(f"with {C}, {G} select chunk_id, split from cs join sp using (group_id)")
def chunk_splits(s, d):
    return chunks(s, d).select("chunk_id", "group_id").join(splits(s, d), "group_id").select("chunk_id", "split")


@query(
    f"""with {C}, {G}, x as (select group_id, any_value(doc_type) as doc_type, count(*) as n from cs group by group_id)
    select coalesce(doc_type, 'total') as doc_type, split, count(*) as n_groups, cast(sum(n) as bigint) as n_chunks from x join sp using (group_id)
    group by grouping sets ((doc_type, split), (split))"""
)
def split_rollup(s, d):
    x = table(s, d, "chunks").select("chunk_id", "group_id", "doc_type").distinct().groupBy("group_id").agg(F.any_value("doc_type").alias("doc_type"), F.count("*").alias("n"))
    x = x.join(splits(s, d), "group_id")
    x = x.groupingSets([["doc_type", "split"], ["split"]], "doc_type", "split").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_chunks"))
    return x.select(F.coalesce("doc_type", F.lit("total")).alias("doc_type"), "split", "n_groups", "n_chunks")


@query(
    """with g as (select group_id, any_value(c.doc_type) as stratum, bool_or(coalesce(d.has_formula_table, false)) as forced
        from (select distinct group_id, doc_type from chunks) c left join (select doc_key, bool_or(has_formula_table) as has_formula_table from documents group by doc_key) d on d.doc_key = c.group_id
        where c.group_id is not null group by group_id),
    r as (select group_id, stratum, row_number() over (partition by stratum order by ('0x' || substr(md5('42|' || group_id), 1, 8))::bigint, group_id) - 1 as i,
        count(*) over (partition by stratum) as n from g where not forced)
    select group_id, stratum, case when i < round_even(n * 0.1, 0) then 'test' when i < 2 * round_even(n * 0.1, 0) then 'val' else 'train' end as split from r
    union all select group_id, stratum, 'train' from g where forced"""
)
def stratified_group_split(s, d):
    f = table(s, d, "documents").groupBy("doc_key").agg(F.bool_or("has_formula_table").alias("f"))
    g = table(s, d, "chunks").where("group_id is not null").groupBy("group_id").agg(F.any_value("doc_type").alias("stratum"))
    g = g.join(f, g.group_id == f.doc_key, "left").select("group_id", "stratum", F.coalesce("f", F.lit(False)).alias("forced"))
    return pairs.stratified_groups(g)


# near duplicates


GRAMS = f"""{Q}, nt as (select qid, split, {N.format('question')} as t from qs where question is not null),
    gs as (select qid, split, list_distinct(list_transform(range(1, 1 + greatest(1, length(t) - 2)), lambda i: substr(t, i, 3))) as g from nt),
    fl as (select qid, split, len(g) as n, unnest(g) as g from gs),
    pr as (select a.qid as a, b.qid as b, any_value(a.split) as sa, any_value(b.split) as sb, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from fl a join fl b on a.g = b.g and a.qid < b.qid and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9 group by 1, 2),
    ed as (select a, b, sa, sb, c / (na + nb - c) as j from pr where c / (na + nb - c) >= 0.8)"""


CLASSES = f"""{GRAMS[:GRAMS.index("gs as")]}
    cl as (select t, min(qid) as qid, count(*) as copies from nt group by t),
    {GRAMS[GRAMS.index("gs as"):].replace("select qid, split, list", "select qid, '' as split, list").replace("from nt)", "from cl)")}"""


@query(f"with {CLASSES} select a, b, round(j, 6) as jaccard, x.copies as copies_a, y.copies as copies_b from ed join cl x on x.qid = a join cl y on y.qid = b")
def jaccard_pairs(s, d):
    """Near-equal questions: pairs between the least ids of their classes of copies."""
    p = dedup.similar_texts(questions(s, d), "qid", "question", 0.8)
    return p.withColumn("jaccard", F.round("jaccard", 6))


def scanned(q: DataFrame) -> DataFrame:
    """`qid`, `duplicate_of` of the greedy scan test, val, train; questions without a split come last."""
    rank = F.when(F.lit(False), F.lit(None).cast("int"))
    for name, p in PRIORITY.items():
        rank = rank.when(F.col("split") == name, p)
    return dedup.greedy_dedup(q.select("qid", "question", rank.otherwise(len(PRIORITY)).alias("priority")), "qid", "question", 0.8)


@query(
    f"""with recursive {GRAMS.replace("where question is not null", f"where split is not null and question is not null and ({DROP}) is null")},
    od as (select qid, split, row_number() over (order by case split when 'test' then 0 when 'val' then 1 else 2 end, qid) as i from nt),
    ee as (select greatest(x.i, y.i) as i, least(x.i, y.i) as j from ed join od x on x.qid = a join od y on y.qid = b),
    nn as (select i, list(j) as js, row_number() over (order by i) as k from ee group by i),
    st(k, dropped) as (select 0::bigint, []::bigint[] union all
        select st.k + 1, case when len(list_filter(nn.js, lambda j: not list_contains(st.dropped, j))) > 0 then list_append(st.dropped, nn.i) else st.dropped end from st join nn on nn.k = st.k + 1),
    dr as (select unnest(dropped) as i from st where k = (select max(k) from st)),
    hit as (select ee.i, min(ee.j) as j from ee join dr on dr.i = ee.i where ee.j not in (select i from dr) group by ee.i)
    select x.qid, y.qid as duplicate_of, case when x.split = y.split then 'duplicate' else 'duplicate_of_' || y.split end as drop_reason from hit join od x on x.i = hit.i join od y on y.i = hit.j"""
)
def greedy_priority_dedup(s, d):
    """Questions that pass the rules, scanned test, val, train; the dropped ones name the kept one they repeat."""
    q = questions(s, d).where("split is not null").withColumn("drop", pairs.rule_cascade(F.col("question"))).where("drop is null")
    q = materialize(q.select("qid", "question", "split"), "candidates")
    of = q.select(F.col("qid").alias("duplicate_of"), F.col("split").alias("of_split"))
    x = scanned(q).where("duplicate_of is not null").join(of, "duplicate_of").join(q.select("qid", "split"), "qid")
    reason = F.when(F.col("split") == F.col("of_split"), "duplicate").otherwise(F.concat(F.lit("duplicate_of_"), F.col("of_split")))
    return x.select("qid", "duplicate_of", reason.alias("drop_reason"))


def candidates(s, d) -> DataFrame:
    """`qid`, `group_id`, `question`, `split` of the questions of every split that pass the rules and repeat no kept one.

    Scanned as in greedy_priority_dedup; questions without a split come last, so that they change nothing for the others.
    """
    q = questions(s, d).where(pairs.rule_cascade(F.col("question")).isNull())
    q = materialize(q.select("qid", "group_id", "question", "split"), "candidates")
    kept = scanned(q).where("duplicate_of is null").select("qid")
    return materialize(q.join(kept, "qid"), "kept")


@query(f"with {GRAMS} select distinct case when sa = 'test' then a else b end as qid from ed where (sa = 'test' and sb = 'train') or (sa = 'train' and sb = 'test')")
def near_dup_cross_split(s, d):
    return audit.near_duplicates(questions(s, d).where("question is not null"), "qid", "question")


# leakage


T = f"{Q}, {C}, tx as (select qid, q.split, c.chunk_id, c.text from qs q join cs c on q.chunk_id = c.chunk_id)"


def _with_text(s, d) -> DataFrame:
    q = questions(s, d).select("qid", "split", "chunk_id")
    return q.join(chunks(s, d).select("chunk_id", "text"), "chunk_id")


@query(f"with {T} select qid, chunk_id from tx where split = 'test' and text in (select text from tx where split = 'train')")
def text_overlap_leak(s, d):
    return audit.leaked_rows(_with_text(s, d), "text").select("qid", "chunk_id")


@query(f"with {T} select qid from tx where split = 'test' and text not in (select text from tx where split = 'train')")
def leak_exclusion(s, d):
    x = _with_text(s, d)
    leaked = audit.leaked_rows(x, "text").select("qid").distinct()
    return x.where("split = 'test'").join(leaked, "qid", "left_anti").select("qid")


@query(
    f"""with {GRAMS}, {C}, {G}, tx as (select qid, q.split, c.text from qs q join cs c on q.chunk_id = c.chunk_id),
    f as (select 'group_overlap' as check_name, count(*) as n_found from (select group_id from qs where split = 'train' intersect select group_id from qs where split = 'test')
    union all select 'chunk_overlap', count(*) from (select chunk_id from qs where split = 'train' and chunk_id is not null intersect select chunk_id from qs where split = 'test')
    union all select 'identical_text', count(*) from tx where split = 'test' and text in (select text from tx where split = 'train')
    union all select 'near_duplicate_questions', count(distinct case when sa = 'test' then a else b end) from ed where (sa = 'test' and sb = 'train') or (sa = 'train' and sb = 'test')
    union all select 'split_mislabel', count(*) from qs join sp using (group_id) where qs.split = 'test' and sp.split <> 'test')
    select check_name, n_found, n_found = 0 as passed from f"""
)
def leakage_audit(s, d):
    q = materialize(questions(s, d), "questions")
    return audit.report(q.where("question is not null or split is not null"), chunks(s, d), splits(s, d))


@query(f"with {Q}, {G} select qid, sp.split as given from qs join sp using (group_id) where qs.split = 'test' and sp.split <> 'test'")
def split_mislabel(s, d):
    q = questions(s, d).where("split = 'test'").select("qid", "group_id")
    return q.join(splits(s, d).withColumnRenamed("split", "given"), "group_id").where("given <> 'test'").select("qid", "given")


@query(f"with {Q} select group_id from qs where split = 'train' intersect select group_id from qs where split = 'test'")
def group_overlap(s, d):
    return audit.shared_keys(questions(s, d), "group_id")


# pairs for training


@query(
    f"""with {Q}, {C} select qid, md5('query: ' || question) as anchor_md5, md5('passage: ' || text) as positive_md5,
        ('0x' || substr(md5('42|' || qid), 1, 8))::bigint as shuffle_key
    from qs join cs on qs.chunk_id = cs.chunk_id where split = 'train' and question is not null"""
)
def pair_assembly(s, d):
    q = questions(s, d).where("split = 'train' and question is not null").select("qid", "question", "chunk_id")
    x = q.join(chunks(s, d).select("chunk_id", "text"), "chunk_id")
    return x.select("qid", F.md5(F.concat(F.lit("query: "), "question")).alias("anchor_md5"), F.md5(F.concat(F.lit("passage: "), "text")).alias("positive_md5"), X.seeded(42, F.col("qid")).alias("shuffle_key"))


@query("select group_id, count(distinct chunk_id) as n, array_to_string(list_sort(list(distinct chunk_id)), ',') as chunk_ids from chunks where group_id is not null group by group_id")
def group_chunks(s, d):
    c = table(s, d, "chunks").where("group_id is not null").select("group_id", "chunk_id").distinct()
    g = c.groupBy("group_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("chunk_id")).alias("c"))
    return g.select("group_id", "n", F.array_join("c", ",").alias("chunk_ids"))


@query(
    f"""with {Q}, cu as (select qid, nfc_normalize(trim(question)) as question, regexp_extract(qid, '^(.+)\\|q', 1) as c, try_cast(regexp_extract(qid, '\\|q(\\d+)$', 1) as int) as k from qs where trim(question) <> '')
    select qid, question from (select *, row_number() over (partition by c order by k, qid) as r from cu) where r <= 2"""
)
def question_cleanup(s, d):
    """Composed and trimmed questions, without empty ones, and at most two for each chunk."""
    return pairs.cleaned_questions(questions(s, d), 2)


# resuming and batches


@query(f"with {Q} select qid from qs where qid not in (select qid from judgments where qid is not null)")
def resume_antijoin(s, d):
    return questions(s, d).select("qid").join(table(s, d, "judgments").select("qid"), "qid", "left_anti")


@query(
    f"""with {Q} select qid, coalesce(split, 'none') as split, cast(floor((row_number() over (partition by coalesce(split, 'none'), doc_type order by qid) - 1) / 10) as bigint) as batch, doc_type from qs"""
)
def batching(s, d):
    q = questions(s, d).select("qid", F.coalesce("split", F.lit("none")).alias("split"), "doc_type")
    p = positions(q, ["split", "doc_type"], ["qid"])
    return p.select("qid", "split", F.floor(F.col("position") / 10).cast("bigint").alias("batch"), "doc_type")


@query(
    f"""with {Q}, {G} select chunk_id, split from (select distinct chunk_id, group_id from chunks) c join sp using (group_id)
    where chunk_id not in (select chunk_id from queries_raw where chunk_id is not null)
    order by case split when 'test' then 0 when 'val' then 1 else 2 end, chunk_id limit 100"""
)
def todo_limit(s, d):
    """The next 100 chunks without a question, test first."""
    done = table(s, d, "queries_raw").where("chunk_id is not null").select("chunk_id")
    c = table(s, d, "chunks").select("chunk_id", "group_id").distinct().join(done, "chunk_id", "left_anti").join(splits(s, d), "group_id")
    m = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return c.orderBy(F.try_element_at(m, F.col("split")), "chunk_id").limit(100).select("chunk_id", "split")


# judging




def judged(s, d) -> DataFrame:
    return pairs.judged(questions(s, d).select("qid", "split", "doc_type"), table(s, d, "judgments"))


@query(
    f"""with {Q}, js as (select qid, arg_max(verdict, created_at) as verdict from judgments group by qid)
    select qs.qid, case when qs.split = 'test' then 'not_applicable' when verdict is null then 'unjudged' else 'judged' end as judge_status from qs left join js on qs.qid = js.qid"""
)
def verdict_join(s, d):
    return judged(s, d).select("qid", "judge_status")


LAST = f"""{Q}, jr as (select qid, verdict, judge_model, row_number() over (partition by qid order by created_at desc nulls last, verdict desc nulls last, reason desc nulls last, judge_model desc nulls last) as r from judgments),
    jd as (select qs.qid, coalesce(qs.split, 'none') as split, qs.doc_type, verdict, judge_model,
        case when qs.split = 'test' then 'not_applicable' when verdict is null then 'unjudged' else 'judged' end as judge_status
        from qs left join (select * from jr where r = 1) j on qs.qid = j.qid)"""


@query(f"with {LAST} select split, doc_type, judge_status, coalesce(verdict, '-') as verdict, coalesce(judge_model, '-') as judge_model, count(*) as n from jd group by all")
def verdict_counts(s, d):
    x = judged(s, d)
    dash = lambda c, other="-": F.coalesce(c, F.lit(other)).alias(c)
    return x.groupBy(dash("split", "none"), "doc_type", "judge_status", dash("verdict"), dash("judge_model")).agg(F.count("*").alias("n"))


@query(f"with {LAST} select qid from jd where judge_status <> 'judged' or verdict in ('yes', 'partial')")
def finalize_pairs(s, d):
    return pairs.finalize(judged(s, d), ["yes", "partial"]).select("qid")


@query("select * from (values ('all judged', true), ('some open', false), ('some open, allowed', true)) t(state, finished)")
def finalize_guard(s, d):
    """Finalising is refused while questions are not judged, unless it is allowed."""
    x, out = judged(s, d), []
    some = x.where("judge_status <> 'unjudged'"), x, x
    for state, rows, allowed in zip(("all judged", "some open", "some open, allowed"), some, (False, False, True)):
        try:
            pairs.finalize(rows, ["yes"], incomplete=allowed)
            out.append((state, True))
        except pairs.Incomplete:
            out.append((state, False))
    return s.createDataFrame(out, "state string, finished boolean")


@query(
    f"""with {Q} select true as other_document, true as known_question, true as known_chunk, 10 as n"""
)
def wrong_pair_checks(s, d):
    """Negative controls: ten questions, each with a chunk of another document."""
    q = questions(s, d).where("chunk_id is not null").select("qid", "chunk_id", "group_id")
    w = pairs.wrong_pairs(q, 10).alias("w").join(q.alias("q"), "qid", "left")
    other = F.regexp_extract("wrong_chunk_id", r"^(.+)#\d+$", 1) != F.col("q.group_id")
    known = q.select(F.col("chunk_id").alias("wrong_chunk_id"), F.lit(True).alias("known")).distinct()
    return w.join(known, "wrong_chunk_id", "left").agg(
        F.bool_and(other).alias("other_document"), F.bool_and(F.col("q.group_id").isNotNull()).alias("known_question"), F.bool_and(F.coalesce("known", F.lit(False))).alias("known_chunk"), F.count("*").cast("int").alias("n")
    )


@query()
def wrong_pair_controls(s, d):
    q = questions(s, d).where("chunk_id is not null").select("qid", "chunk_id", "group_id")
    return pairs.wrong_pairs(q, 10)


@query(
    """with r as (select *, row_number() over (partition by qid order by created_at, verdict) as i, row_number() over (partition by qid order by created_at desc, verdict desc) as k from judgments),
    p as (select a.qid, a.verdict as expected, b.verdict as verdict, b.judge_model from r a join r b on a.qid = b.qid where a.i = 1 and b.k = 1)
    select judge_model, count(*) as n, round(avg(case when expected = verdict then 1.0 else 0 end), 6) as exact,
        round(avg(case when (expected = 'yes') = (verdict = 'yes') then 1.0 else 0 end), 6) as keep_decision from p group by judge_model"""
)
def calibration_summary(s, d):
    """How far the first verdict on a question agrees with the last, by judge."""
    j = table(s, d, "judgments").groupBy("qid").agg(
        F.min(F.struct("created_at", "verdict")).alias("a"), F.max(F.struct("created_at", "verdict", "judge_model")).alias("b")
    )
    x = j.select(F.col("a.verdict").alias("expected"), F.col("b.verdict").alias("verdict"), F.col("b.judge_model").alias("judge_model"))
    g = pairs.agreement(x, ["judge_model"])
    return g.select("judge_model", "n", F.round("exact", 6).alias("exact"), F.round("keep_decision", 6).alias("keep_decision"))


@query("select coalesce(expected, '-') as expected, coalesce(verdict, '-') as verdict, count(*) as n from (select arg_min(verdict, (created_at, verdict)) as expected, arg_max(verdict, (created_at, verdict)) as verdict from judgments group by qid) group by all")
def calibration_confusion(s, d):
    j = table(s, d, "judgments").groupBy("qid").agg(F.min(F.struct("created_at", "verdict")).alias("a"), F.max(F.struct("created_at", "verdict")).alias("b"))
    return j.groupBy(F.coalesce("a.verdict", F.lit("-")).alias("expected"), F.coalesce("b.verdict", F.lit("-")).alias("verdict")).agg(F.count("*").alias("n"))
