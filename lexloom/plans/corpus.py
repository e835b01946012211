"""Queries on documents, chunks and law files: text functions, extraction, filters, versions and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import versions
from lexloom.runtime import table

SNAPSHOT = "2020-01-01"
PATTERNS = ["작업시간표준법", "일터안전증진법", "교대근무보호법", "임금명세공개법", "징계절차공정법"]
#: Law names whose mention is told in questions: the fixed ones, and kinds of laws in this corpus.
LAW_WORDS = [*X.LAW_NAMES, "법률", "기본법", "보호법"]
KINDS = {"법률": "law", "시행령": "decree", "시행규칙": "rule"}

QUERIES: dict = {}
SQL: dict[str, str] = {}

B = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(s, d):
    return table(s, d, "documents")



def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{B}+|{B}+$', '', 'g')"


# text functions


@query("select doc_id, length(n) as n_chars_norm, md5(n) as norm_md5 from (select doc_id, regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}]+', '', 'g') as n from documents)")
def norm_text(s: SparkSession, d: str) -> DataFrame:
    n = X.norm(F.coalesce("text", F.lit("")))
    return _docs(s, d).select("doc_id", n.alias("n")).select("doc_id", F.char_length("n").cast("bigint").alias("n_chars_norm"), F.md5("n").alias("norm_md5"))


CLEAN = f"""
    with a as (select doc_id, nfc_normalize(coalesce(text, '')) as t from documents),
    b as (select doc_id, regexp_replace(regexp_replace(t, '<img[^>]*>|</img>', ' ', 'g'), '[\\x{{2500}}-\\x{{257F}}]+', ' ', 'g') as t from a),
    c as (select doc_id, replace(regexp_replace(t, '\\\\([\\\\`*_{{}}\\[\\]()#+\\-.!|<>~])', '\\1', 'g'), '**', '') as t from b),
    e as (select doc_id, regexp_replace(t, '{B}*<[^<>]*\\p{{Nd}}{{4}}{B}*\\.{B}*\\p{{Nd}}{{1,2}}{B}*\\.{B}*\\p{{Nd}}{{1,2}}[^<>]*>', '', 'g') as t from c),
    f as (select doc_id, regexp_replace(t, '\\([{X.IDEOGRAPHS}]+\\)', '', 'g') as t from e)
    select doc_id, length(t) as n_chars_clean, md5(t) as clean_md5
    from (select doc_id, trim(regexp_replace(t, '{B}+', ' ', 'g')) as t from f)
"""


@query(CLEAN)
def clean_text(s, d):
    c = _docs(s, d).select("doc_id", X.clean(F.coalesce("text", F.lit(""))).alias("t"))
    return c.select("doc_id", F.char_length("t").cast("bigint").alias("n_chars_clean"), F.md5("t").alias("clean_md5"))


@query("select doc_id, has_formula_table as given, regexp_matches(text, '<img[^>]*>|</img>|[\\x{2500}-\\x{257F}]') as found from documents")
def formula_tables(s, d):
    return _docs(s, d).select("doc_id", F.col("has_formula_table").alias("given"), X.has_formula_table(F.col("text")).alias("found"))


@query(
    """select qid, round(length(regexp_replace(question, '[^가-힣]', '', 'g')) / greatest(1, length(regexp_replace(question, '[^\\p{L}]', '', 'g'))), 6) as ratio
    from (select distinct qid, question from queries_raw)"""
)
def script_ratio(s, d):
    q = table(s, d, "queries_raw").select("qid", "question").distinct()
    return q.select("qid", F.round(X.script_ratio(F.col("question")), 6).alias("ratio"))


@query(
    """with n as (select distinct qid, regexp_replace(question, '[^\\p{L}\\p{N}]+', '', 'g') as t from queries_raw),
    g as (select qid, list_distinct(list_transform(range(1, 1 + greatest(1, length(t) - 2)), lambda i: substr(t, i, 3))) as g from n where t is not null)
    select qid, cast(len(g) as bigint) as n_grams, md5(array_to_string(list_sort(g), '|')) as grams_md5 from g"""
)
def char_ngrams(s, d):
    q = table(s, d, "queries_raw").select("qid", X.norm(F.col("question")).alias("t")).distinct().where("t is not null")
    return q.select("qid", X.ngrams(F.col("t")).alias("g")).select("qid", F.size("g").cast("bigint").alias("n_grams"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("grams_md5"))


@query(
    f"""with p as (select doc_id, string_split(regexp_replace(summary, '([.?!]){B}+', '\\1' || chr(1), 'g'), chr(1)) as p from documents where summary is not null)
    select doc_id, cast(i as bigint) as pos, p[i] as sentence from p, unnest(range(1, len(p) + 1)) as u(i)"""
)
def sentence_split(s, d):
    x = _docs(s, d).where("summary is not null").select("doc_id", F.posexplode(X.sentences(F.col("summary"))).alias("pos", "sentence"))
    return x.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), "sentence")


@query(
    f"""with h as (select doc_id, holding from documents where regexp_matches(holding, '^{B}*\\[\\p{{Nd}}+\\]')),
    m as (select doc_id, regexp_extract_all(holding, '\\[(\\p{{Nd}}+)\\]', 1) as k,
                 string_split(regexp_replace(holding, '\\[\\p{{Nd}}+\\]{B}*', chr(1), 'g'), chr(1))[2:] as v from h)
    select doc_id, cast(i as bigint) as pos, k[i] as number, {_strip('v[i]')} as part from m, unnest(range(1, len(k) + 1)) as u(i)"""
)
def numbered_issues(s, d):
    x = _docs(s, d).select("doc_id", F.posexplode(X.numbered_parts(F.col("holding"))).alias("pos", "p"))
    return x.select("doc_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("p.k").alias("number"), F.col("p.v").alias("part"))


@query(
    """select doc_id, '제' || split_part(article_key, '-', 1) || '조' || case when contains(article_key, '-') then '의' || split_part(article_key, '-', 2) else '' end
        || case when length(article_title) > 0 then '(' || article_title || ')' else '' end as label
    from documents where article_key is not null"""
)
def article_labels(s, d):
    k = F.split("article_key", "-")
    label = X.article_label(k[0], F.coalesce(F.get(k, F.lit(1)), F.lit("")), F.coalesce("article_title", F.lit("")))
    return _docs(s, d).where("article_key is not null").select("doc_id", label.alias("label"))


@query(
    """select doc_id, court || ' ' || year(dt) || '. ' || month(dt) || '. ' || day(dt) || '. 선고 ' || case_number || ' 판결 [' || case_name || ']' as title
    from (select *, try_cast(decision_date as date) as dt from documents where doc_type = 'precedent') where dt is not null"""
)
def case_titles(s, d):
    c = _docs(s, d).where("doc_type = 'precedent'").where(F.try_to_date("decision_date").isNotNull())
    t = F.concat(F.col("court"), F.lit(" "), X.short_date(F.col("decision_date")), F.lit(" 선고 "), F.col("case_number"), F.lit(" 판결 ["), F.col("case_name"), F.lit("]"))
    return c.select("doc_id", t.alias("title"))


@query(
    """select distinct chunk_id, replace(replace(replace(substr(regexp_replace(text, '^[^\\n]*\\n', ''), 1, 260), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as snippet
    from chunks"""
)
def snippets(s, d):
    return table(s, d, "chunks").select("chunk_id", X.escape_html(X.snippet(F.col("text"), 260)).alias("snippet")).distinct()


@query("select doc_id, substr(sha1(coalesce(doc_key, '') || coalesce(text, '')), 1, 16) as content_key from documents")
def content_keys(s, d):
    return _docs(s, d).select("doc_id", X.content_key(F.col("doc_key"), F.col("text")).alias("content_key"))


@query(
    """select doc_id, doc_key,
        case when doc_type = 'precedent' then doc_key else concat_ws(':', doc_type, law_id, article_key) end as built, doc_key || '#0' as first_chunk
    from documents"""
)
def id_builders(s, d):
    built = F.when(F.col("doc_type") == "precedent", F.col("doc_key")).otherwise(F.concat_ws(":", "doc_type", "law_id", "article_key"))
    return _docs(s, d).select("doc_id", "doc_key", built.alias("built"), F.concat("doc_key", F.lit("#0")).alias("first_chunk"))


@query("select distinct chunk_id, cast(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^\\s\\p{L}\\p{N}]')) as bigint) as n from chunks")
def token_counts(s, d):
    return table(s, d, "chunks").select("chunk_id", X.count_tokens(F.col("text")).cast("bigint").alias("n")).distinct()


@query(
    f"""select qid, regexp_matches(question, '제[\\s\\v\\x1c-\\x1f\\x{{85}}\\p{{Z}}]*\\p{{Nd}}+[\\s\\v\\x1c-\\x1f\\x{{85}}\\p{{Z}}]*조') as article_no,
        regexp_matches(question, '{'|'.join(LAW_WORDS).replace(' ', B + '*')}') as law_name
    from (select distinct qid, question from queries_raw)"""
)
def question_flags(s, d):
    q = table(s, d, "queries_raw").select("qid", "question").distinct()
    return q.select("qid", X.has_article_number(F.col("question")).alias("article_no"), X.mentions(F.col("question"), LAW_WORDS).alias("law_name"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, event_type from events")
def json_fields(s, d):
    p = F.from_json("props", "k bigint")
    return table(s, d, "events").select("event_id", p["k"].alias("k"), "event_type")


# aggregates


@query(
    """with l as (select doc_type, length(text) as n from documents where text is not null),
    r as (select doc_type, n, row_number() over (partition by doc_type order by n) - 1 as i, count(*) over (partition by doc_type) as m from l)
    select doc_type, count(*) as n, min(n) as min_len, median(n) as median_len, max(case when i = cast(floor(0.95 * (m - 1)) as bigint) then n end) as p95_len, max(n) as max_len
    from r group by doc_type"""
)
def length_stats(s, d):
    """p95 is the value at the lower index, not interpolated. Lengths are counted before they are gathered, so a type is never one task's list."""
    return _length_stats(_docs(s, d).where("text is not null").select("doc_type", F.char_length("text").cast("bigint").alias("n")), "doc_type", "n").select(
        "doc_type", "n", F.col("lo").alias("min_len"), F.col("median").alias("median_len"), F.col("p95").alias("p95_len"), F.col("hi").alias("max_len")
    )


def _length_stats(df, by, n):
    from pyspark.sql import Window

    c = df.groupBy(by, n).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by).orderBy(n)
    c = c.withColumn("upto", F.sum("c").over(w)).withColumn("all", F.sum("c").over(Window.partitionBy(by)))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col(n)))
    m = F.col("all") - 1
    return c.groupBy(by).agg(
        F.max("all").alias("n"), F.min(n).alias("lo"),
        ((at(F.floor(m / 2)) + at(F.ceil(m / 2))) / 2.0).alias("median"),
        at(F.floor(m * 0.95)).alias("p95"), F.max(n).alias("hi"),
    )


@query(
    """with c as (select distinct chunk_id, doc_id, doc_type, n_parts, n_tokens from chunks),
    r as (select *, row_number() over (partition by doc_type order by n_tokens) - 1 as i, count(*) over (partition by doc_type) as m from c)
    select doc_type, count(distinct doc_id) as documents, count(*) as chunks, count(distinct case when n_parts > 1 then doc_id end) as documents_split,
        cast(min(n_tokens) as bigint) as tokens_min, median(n_tokens) as tokens_median,
        cast(max(case when i = cast(floor(0.95 * (m - 1)) as bigint) then n_tokens end) as bigint) as tokens_p95, cast(max(n_tokens) as bigint) as tokens_max
    from r group by doc_type"""
)
def token_stats(s, d):
    c = table(s, d, "chunks").select("chunk_id", "doc_id", "doc_type", "n_parts", F.col("n_tokens").cast("bigint").alias("n_tokens")).distinct()
    per = c.groupBy("doc_type", "doc_id").agg(F.count("*").alias("k"), F.max((F.col("n_parts") > 1).cast("int")).alias("split"))
    docs = per.groupBy("doc_type").agg(F.count("*").alias("documents"), F.sum("k").alias("chunks"), F.sum("split").cast("bigint").alias("documents_split"))
    t = _length_stats(c, "doc_type", "n_tokens").select("doc_type", F.col("lo").alias("tokens_min"), F.col("median").alias("tokens_median"), F.col("p95").alias("tokens_p95"), F.col("hi").alias("tokens_max"))
    return docs.join(t, "doc_type")


@query(
    """select doc_type, count(*) as n, count(case when text = '' or text is null then 1 end) as empty_text, count(case when has_formula_table then 1 end) as formula_table,
        count(case when doc_type = 'precedent' and coalesce(summary, '') = '' then 1 end) as without_summary from documents group by doc_type"""
)
def doc_counters(s, d):
    return _docs(s, d).groupBy("doc_type").agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty_text"), F.count_if("has_formula_table").alias("formula_table"),
        F.count_if((F.col("doc_type") == "precedent") & (F.coalesce("summary", F.lit("")) == "")).alias("without_summary"),
    )


@query("select doc_key, count(*) as n from documents group by doc_key having count(*) > 1")
def duplicate_ids(s, d):
    from lexloom.operators.audit import duplicate_ids as dup

    return dup(_docs(s, d), "doc_key")


@query(
    """select min(doc_id) as first_doc_id, count(*) as n from (select doc_id, regexp_replace(text, '[^\\p{L}\\p{N}]+', '', 'g') as t from documents)
    where t <> '' group by t having count(*) > 1"""
)
def exact_dedup(s, d):
    """Groups of equal normalised texts; only hashes are shuffled."""
    t = X.norm(F.col("text"))
    g = _docs(s, d).select("doc_id", t.alias("t")).where("t <> ''").select("doc_id", F.sha2("t", 256).alias("h"))
    return g.groupBy("h").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")).where("n > 1").drop("h")


@query("select greatest(0, least(21, cast(floor(n_tokens / 24.0) as bigint) + 1)) as bin, doc_type, count(*) as n from (select distinct chunk_id, doc_type, n_tokens from chunks) group by all")
def token_histogram(s, d):
    c = table(s, d, "chunks").select("chunk_id", "doc_type", "n_tokens").distinct()
    return c.groupBy(F.width_bucket("n_tokens", F.lit(0.0), F.lit(480.0), F.lit(20)).alias("bin"), "doc_type").agg(F.count("*").alias("n"))


# filters


@query(
    "with r as (select regexp_replace(\"참조조문\", '[\\s\\v\\x1c-\\x1f\\x{85}\\p{Z}]', '', 'g') as r from documents where \"참조조문\" is not null), "
    f"p as (select unnest({PATTERNS!r}) as pattern) select pattern, count(*) as n from r, p where contains(r, pattern) group by pattern"
)
def any_pattern_hits(s, d):
    r = F.regexp_replace("참조조문", X.BLANK, "")
    hit = F.filter(F.array(*[F.lit(p) for p in PATTERNS]), lambda p: F.contains(r, p))
    return _docs(s, d).where("`참조조문` is not null").select(F.explode(hit).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


@query("select doc_id from documents where doc_type = 'precedent' and length(coalesce(holding, '')) > 0 and length(coalesce(summary, '')) > 0 and length(coalesce(\"참조조문\", '')) > 0")
def required_sections(s, d):
    need = F.map_from_arrays(F.array(*[F.lit(c) for c in ("holding", "summary", "refs")]), F.array("holding", "summary", "참조조문"))
    full = F.forall(F.map_values(need), lambda v: F.length(F.coalesce(v, F.lit(""))) > 0)
    return _docs(s, d).where(F.col("doc_type") == "precedent").where(full).select("doc_id")


@query(
    """select raw_path, kind, case when len(string_split(raw_path, '/')) <> 5 then 'path' when kind not in ('법률', '시행령') then 'kind'
        when effective > '2025-06-30' then 'not in force' end as reason from law_file"""
)
def path_predicate(s, d):
    parts = F.size(F.split("raw_path", "/"))
    reason = F.when(parts != 5, "path").when(~F.col("kind").isin("법률", "시행령"), "kind").when(F.col("effective") > "2025-06-30", "not in force")
    return table(s, d, "law_file").select("raw_path", "kind", reason.alias("reason"))


@query("select doc_id, decision_date, doc_key from documents where doc_type = 'precedent' order by decision_date desc nulls last, doc_key desc, doc_id desc limit 2000")
def newest_first_cap(s, d):
    c = _docs(s, d).where("doc_type = 'precedent'").select("doc_id", "decision_date", "doc_key")
    return c.orderBy(F.desc_nulls_last("decision_date"), F.desc("doc_key"), F.desc("doc_id")).limit(2000)


@query("select distinct year(try_cast(decision_date as date)) as decision_year from documents where try_cast(decision_date as date) is not null")
def decision_years(s, d):
    y = F.year(F.try_to_date("decision_date")).cast("bigint")
    return _docs(s, d).select(y.alias("decision_year")).where("decision_year is not null").distinct()


@query(
    """with s as (select doc_id, doc_type, effective_date as day, law_name as name from documents where doc_type <> 'precedent'),
    c as (select doc_id, doc_type, decision_date as day, null as name from documents where doc_type = 'precedent')
    select doc_type, count(*) as n, count(name) as with_name, min(day) as first_day, max(day) as last_day from (select * from s union all select * from c) group by doc_type"""
)
def union_corpus(s, d):
    a = _docs(s, d).where("doc_type <> 'precedent'").select("doc_id", "doc_type", F.col("effective_date").alias("day"), F.col("law_name").alias("name"))
    c = _docs(s, d).where("doc_type = 'precedent'").select("doc_id", "doc_type", F.col("decision_date").alias("day"))
    return a.unionByName(c, allowMissingColumns=True).groupBy("doc_type").agg(
        F.count("*").alias("n"), F.count("name").alias("with_name"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


# joins


NORM_LAW = "replace(nfc_normalize(regexp_replace({}, '[\\s\\v\\x1c-\\x1f\\x{{85}}\\p{{Z}}]', '', 'g')), '·', 'ㆍ')"


@query(
    f"""with w as (select {NORM_LAW.format('law_name')} as k, count(*) as n from documents where law_name is not null group by 1),
    f as (select distinct {NORM_LAW.format('law')} as k, true as here from law_file)
    select w.k as law_key, w.n as n, case when here then 'matched' else 'missing' end as status from w left join f on w.k = f.k"""
)
def law_match(s, d):
    w = _docs(s, d).where("law_name is not null").groupBy("law_name").agg(F.count("*").alias("n"))
    w = w.groupBy(X.norm_law(F.col("law_name")).alias("law_key")).agg(F.sum("n").alias("n"))
    f = table(s, d, "law_file").select(X.norm_law(F.col("law")).alias("law_key"), F.lit("matched").alias("status")).distinct()
    return w.join(f, "law_key", "left").select("law_key", "n", F.coalesce("status", F.lit("missing")).alias("status"))


@query("select raw_path, case kind when '법률' then 'law' when '시행령' then 'decree' when '시행규칙' then 'rule' end as doc_type from law_file")
def kind_map(s, d):
    m = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return table(s, d, "law_file").select("raw_path", F.try_element_at(m, F.col("kind")).alias("doc_type"))


def articles(s, d) -> DataFrame:
    f = table(s, d, "law_file").select("law_id", X.norm_law(F.col("title")).alias("law_key"))
    a = _docs(s, d).where("article_key is not null").groupBy("law_id", "article_key").agg(F.max("doc_key").alias("article_id"))
    return a.join(f, "law_id").groupBy("law_key", "article_key").agg(F.max("article_id").alias("article_id"))


# versions and samples


@query(
    f"""with v as (select doc_key, doc_id, ingested_at, try_cast(effective_date as date) as e from documents where article_key is not null),
    b as (select doc_key, max(case when e <= date '{SNAPSHOT}' then (ingested_at, doc_id) end) as best from v group by doc_key)
    select v.doc_key, cast(any_value(best[2]) as varchar) as version, count(case when not coalesce(e <= date '{SNAPSHOT}', false) and (best is null or (ingested_at, doc_id) > best) then 1 end) as n_skipped,
        any_value(best) is null as pin_failed from v join b using (doc_key) group by v.doc_key"""
)
def in_force_version(s, d):
    v = _docs(s, d).where("article_key is not null")
    return versions.in_force(v, "doc_key", F.col("ingested_at"), F.try_to_date("effective_date"), SNAPSHOT, F.col("doc_id")).withColumn("version", F.col("version").cast("string"))


@query(
    f"""select doc_key, cast(arg_max(doc_id, (e, doc_id)) filter (where e <= date '{SNAPSHOT}') as varchar) as version
    from (select doc_key, doc_id, try_cast(effective_date as date) as e from documents where article_key is not null) group by doc_key"""
)
def latest_in_force(s, d):
    v = _docs(s, d).where("article_key is not null")
    return versions.latest_in_force(v, "doc_key", F.try_to_date("effective_date"), SNAPSHOT, F.col("doc_id")).withColumn("version", F.col("version").cast("string"))


@query("select doc_key, doc_id, row_number() over (partition by doc_key order by ingested_at desc nulls last, doc_id) = 1 as is_latest from documents")
def latest_per_key(s, d):
    v = _docs(s, d).select("doc_key", "doc_id", "ingested_at")
    return versions.latest_per_key(v, ["doc_key"], [F.desc_nulls_last("ingested_at"), F.asc("doc_id")]).select("doc_key", "doc_id", "is_latest")


@query(
    """select doc_type, doc_id from (select doc_type, doc_id, row_number() over (partition by doc_type order by ('0x' || substr(md5('42|' || doc_id), 1, 8))::bigint, doc_id) as r
    from documents) where r <= 5"""
)
def seeded_sample(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_type").orderBy(X.seeded(42, F.col("doc_id")), "doc_id")
    return _docs(s, d).select("doc_type", "doc_id", F.row_number().over(w).alias("r")).where("r <= 5").drop("r")


@query("select law, count(*) as n, array_to_string(list_sort(list(kind)), ',') as kinds, max(promulgated) as newest from law_file group by law")
def law_kinds(s, d):
    g = table(s, d, "law_file").groupBy("law").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("kind")).alias("k"), F.max("promulgated").alias("newest"))
    return g.select("law", "n", F.array_join("k", ",").alias("kinds"), "newest")


@query(
    """select path as raw_path, title, row_number() over (partition by law, kind order by promulgated desc, path) = 1 as kept
    from (select raw_path as path, law, kind, title, promulgated from law_file)"""
)
def latest_law_file(s, d):
    """Latest file of each law and kind by promulgation; the others are recorded as left out."""
    v = versions.latest_per_key(table(s, d, "law_file"), ["law", "kind"], [F.desc_nulls_last("promulgated"), F.asc("raw_path")])
    return v.select("raw_path", "title", F.col("is_latest").alias("kept"))
