"""Queries on Markdown law and case files, rendered from the documents, parsed, chunked and linked again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import chunking, structure
from lexloom.plans.corpus import B, articles
from lexloom.runtime import materialize, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def clean_sql(c: str) -> str:
    """The cleaned text of a column without any blanks."""
    t = f"regexp_replace(regexp_replace(nfc_normalize({c}), '<img[^>]*>|</img>', ' ', 'g'), '[\\x{{2500}}-\\x{{257F}}]+', ' ', 'g')"
    t = f"replace(regexp_replace({t}, '\\\\([\\\\`*_{{}}\\[\\]()#+\\-.!|<>~])', '\\1', 'g'), '**', '')"
    t = f"regexp_replace({t}, '{B}*<[^<>]*\\p{{Nd}}{{4}}{B}*\\.{B}*\\p{{Nd}}{{1,2}}{B}*\\.{B}*\\p{{Nd}}{{1,2}}[^<>]*>', '', 'g')"
    return f"regexp_replace(regexp_replace({t}, '\\([{X.IDEOGRAPHS}]+\\)', '', 'g'), '{B}+', '', 'g')"


# statutes


def front(**fields: Column) -> Column:
    """A front-matter block; JSON is YAML."""
    return F.concat(F.lit("---\n"), F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])), F.lit("\n---\n"))


def statute_files(s: SparkSession, d: str) -> DataFrame:
    """One Markdown file for each statute document, with chapter and section, a deleted paragraph, subitems, notes, a deleted article and addenda."""
    x = table(s, d, "documents").where("doc_type <> 'precedent' and text is not null")
    body = F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n"))
    body = F.regexp_replace(body, r"(?md)^([①-⑳])[ ]*(.*)$", "**$1** $2")
    body = F.regexp_replace(body, r"(?md)^([0-9]+)\.[ ]*(.*)$", "  $1\\\\. $2\n    가\\\\. $1호의 목")
    branch = F.regexp_extract("article_key", r"^(\d+)(?:-(\d+))?$", 2)
    head = F.concat(F.lit("##### 제"), F.regexp_extract("article_key", r"^(\d+)", 1), F.lit("조"), F.when(branch != "", F.concat(F.lit("의"), branch)).otherwise(""), F.lit(" ("), F.col("article_title"), F.lit(")\n"))
    text = F.concat(
        front(제목=F.coalesce("law_name", F.lit("-")), 법령ID=F.col("law_id"), 법령MST=F.col("doc_id").cast("string"), 법령구분=F.col("doc_type"), 공포일자=F.lit("2000-01-01"), 시행일자=F.coalesce("effective_date", F.lit("-")), 출처=F.coalesce("source_url", F.lit("-"))),
        F.lit("# 법\n## 제1장 총칙\n### 제1절 통칙\n## 제2장 본칙\n"), head, body,
        F.lit("\n**⑳** 삭제\n[본조신설 2018. 1. 1.]\n[시행일: 2020. 1. 1.]\n그 뒤의 설명\n#### 제1관 남은 것\n##### 제9998조\n**①** 삭제\n## 이상한 제목\n## 부칙\n##### 제9999조 (부칙)\n**①** 나오지 않는다\n"),
    )
    return x.select(text.alias("text"), F.col("law_name"), "doc_type")


def parsed(s, d) -> DataFrame:
    return structure.parse_statutes(statute_files(s, d))


LINES = f"""ln as (select doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) as i
        from documents where doc_type <> 'precedent' and text is not null),
    cl as (select doc_id, i, regexp_matches(line, '^[①-⑳]') as par, regexp_matches(line, '^[0-9]+\\.') as item, {clean_sql('line')} as t, regexp_extract(line, '^([0-9]+)\\.', 1) as no
        from ln where regexp_replace(line, '{B}+', '', 'g') <> ''),
    ag as (select doc_id, count(*) filter (where par) + cast(not arg_min(par, i) as bigint) + 1 as n_paragraphs, count(*) filter (where item) as n_items,
        md5(string_agg(t || case when item then '가.' || no || '호의목' else '' end, '' order by i)) as text_md5 from cl group by doc_id having bool_or(item or t <> '') and not regexp_full_match(string_agg(t, '' order by i), '([①-⑳]?삭제)*'))"""


@query(
    f"""with {LINES} select doc_key || '' as article_id, cast(doc_id as varchar) as law_mst, coalesce(nfc_normalize(law_name), '-') || ' ' || article_no || '(' || article_title || ')' as title, article_no, article_title,
        '제2장 본칙' as chapter, cast(null as varchar) as section, effective_date, n_paragraphs, 1 as n_deleted, n_items, n_items as n_subitems, '[본조신설 2018. 1. 1.]|[시행일: 2020. 1. 1.] 그 뒤의 설명' as notes,
        text_md5, regexp_matches(text, '<img[^>]*>|</img>|[\\x{{2500}}-\\x{{257F}}]') as has_formula_table from documents join ag using (doc_id)"""
)
def statute_articles(s, d):
    """Articles of the statute files with their place, the size of their paragraph tree, notes and text."""
    items = F.flatten("paragraphs.items")
    return parsed(s, d).select(
        F.col("doc_id").alias("article_id"), "law_mst", "title", "article_no", "article_title", "chapter", "section", "effective_date",
        F.size("paragraphs").cast("bigint").alias("n_paragraphs"), F.size(F.filter("paragraphs", lambda p: p["deleted"])).alias("n_deleted"),
        F.size(items).cast("bigint").alias("n_items"), F.size(F.flatten(F.transform(items, lambda i: i["subitems"]))).cast("bigint").alias("n_subitems"),
        F.array_join("notes", "|").alias("notes"), F.md5(F.regexp_replace("text", X.BLANK, "")).alias("text_md5"), "has_formula_table",
    )


@query(
    f"""with {LINES}, nd as (select doc_id, case when par then 1 when item then 2 end as depth, case when par then substr(regexp_extract(t, '^.'), 1, 1) else no || '' end as no, i from cl where par or item),
    al as (select doc_id, depth, no from nd union all select doc_id, 3, '가' from nd where depth = 2 union all select doc_id, 1, '⑳' from ag union all select doc_id, 1, null from cl where doc_id in (select doc_id from ag) group by doc_id having not arg_min(par, i))
    select depth, no, count(*) as n, count(*) filter (where no = '⑳') as n_deleted from al where doc_id in (select doc_id from ag) group by all"""
)
def statute_nodes(s, d):
    """Paragraphs, items and subitems by depth and number, and how many are deleted."""
    p = parsed(s, d).select(F.explode("paragraphs").alias("p"))
    i = p.select(F.explode("p.items").alias("i"))
    node = lambda df, c, depth: df.select(F.lit(depth).alias("depth"), F.col(f"{c}.no").alias("no"), F.col(f"{c}.deleted").alias("deleted"))
    u = node(p, "p", 1).unionByName(node(i, "i", 2)).unionByName(node(i.select(F.explode("i.subitems").alias("x")), "x", 3))
    return u.groupBy("depth", "no").agg(F.count("*").alias("n"), F.count_if("deleted").alias("n_deleted"))


@query(f"with {LINES} select cast(doc_id as varchar) as law_mst, true as complete, true as numbered, true as within from ag")
def statute_chunks(s, d):
    """Chunks of the parsed articles: whether all words come, parts are numbered without gaps, and the budget holds."""
    a = materialize(parsed(s, d).select("law_mst", "doc_type", "title", "source_url", "text", "paragraphs"), "articles")
    rules = chunking.ChunkRules(max_tokens=120, lead_tokens=60)
    x = a.select(F.col("law_mst").alias("doc_id"), "doc_type", "title", "source_url", F.concat(F.lit("["), "title", F.lit("]")).alias("prefix"), "text", *[F.lit(None).cast("string").alias(c) for c in ("holding", "summary")], "paragraphs")
    return chunk_checks(chunking.chunk_documents(x, rules), a.select(F.col("law_mst").alias("doc_id"), "text"), rules.max_tokens).withColumnRenamed("doc_id", "law_mst")


def chunk_checks(chunks: DataFrame, whole: DataFrame, budget: int) -> DataFrame:
    """Per document: whether its chunks hold all its words, are numbered 1 to n, and stay within the budget. whole: doc_id, text."""
    g = chunks.groupBy("doc_id").agg(
        F.concat_ws(" ", F.collect_list("text")).alias("all"), F.array_sort(F.collect_list("part")).alias("parts"), F.max("n_parts").alias("n"), F.max("n_tokens").alias("most")
    )
    missing = F.array_except(X.words(F.coalesce("text", F.lit(""))), X.words(F.col("all")))
    return whole.join(g, "doc_id").select("doc_id", (F.size(missing) == 0).alias("complete"), (F.col("parts") == F.sequence(F.lit(1), F.col("n"))).alias("numbered"), (F.col("most") <= budget).alias("within"))


# cases


def case_files(s, d) -> DataFrame:
    """One Markdown file for each case document."""
    x = table(s, d, "documents").where("doc_type = 'precedent'")
    part = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    some = lambda c: F.coalesce(F.col(c), F.lit("-"))
    meta = front(판례일련번호=F.col("doc_id").cast("string"), 법원명=some("court"), 사건번호=some("case_number"), 사건명=some("case_name"), 사건종류=some("case_type"), 선고일자=F.coalesce("decision_date", F.lit("2000-01-01")), 출처=some("source_url"))
    text = F.concat(meta, F.lit("머리말\n## 판시사항\n버려진다\n## 판시사항\n"), part("holding"), F.lit("\n## 판결요지\n"), part("summary"), F.lit("\n## 참조조문\n"), part("참조조문"), F.lit("\n## 판례내용\n본문\n"))
    return x.select(text.alias("text"))


@query(
    f"""select 'precedent:' || doc_id as record_id, coalesce(court, '-') || ' ' || year(cast(decision_date as date)) || '. ' || month(cast(decision_date as date)) || '. ' || day(cast(decision_date as date)) || '. 선고 ' || coalesce(case_number, '-') || ' 판결 [' || coalesce(case_name, '-') || ']' as title,
        coalesce(case_type, '-') as case_type, md5({clean_sql("coalesce(holding, '')")}) as holding_md5, md5({clean_sql("coalesce(summary, '')")}) as summary_md5 from documents where doc_type = 'precedent'"""
)
def case_records(s, d):
    """Cases as records of their files; the sections are read by heading, the last of a name counts."""
    md5 = lambda c: F.md5(F.regexp_replace(c, X.BLANK, "")).alias(f"{c}_md5")
    return structure.parse_cases(case_files(s, d)).select(F.col("doc_id").alias("record_id"), "title", "case_type", md5("holding"), md5("summary"))


# references


def norm_law_sql(c: str) -> str:
    return f"replace(nfc_normalize(regexp_replace({c}, '{B}', '', 'g')), '·', 'ㆍ')"


def _strip_nested(c: str, times: int = 6) -> str:
    for _ in range(times):
        c = f"regexp_replace({c}, '\\([^()]*\\)', '', 'g')"
    return c


def citations_sql(source: str, key: str) -> str:
    """CTEs up to rf(key, pos, law, article_key, old_version, current_equivalent). source: rows key, raw."""
    return f"""r0 as ({source}),
    bl as (select {key}, 0 as b, {_strip_nested("regexp_replace(raw, '\\(현행\\s*([^()]*?)\\s*참조\\)', '', 'g')")} as t from r0
        union all select {key}, k, {_strip_nested("x")} from (select {key}, unnest(regexp_extract_all(raw, '\\(현행\\s*([^()]*?)\\s*참조\\)', 1)) as x, generate_subscripts(regexp_extract_all(raw, '\\(현행\\s*([^()]*?)\\s*참조\\)', 1), 1) as k from r0)),
    pt as (select {key}, b, unnest(regexp_split_to_array(t, ',|/|\\n|\\[[0-9]+\\]')) as p, generate_subscripts(regexp_split_to_array(t, ',|/|\\n|\\[[0-9]+\\]'), 1) as i from bl),
    tk as (select {key}, b, i, regexp_extract(regexp_replace(p, '^{B}+|{B}+$', '', 'g'), '^(구\\s*)?(.*?)\\s*제([0-9]+)조(?:의\\s*([0-9]+))?', ['old', 'law', 'no', 'br']) as m from pt),
    nm as (select {key}, b, i, m, trim(m.law) as law, replace(trim(m.law), ' ', '') like '같은법%' as same from tk where m.no <> ''),
    ex as (select *, last_value(case when law <> '' and not same then law end ignore nulls) over w as explicit,
        last_value(case when law <> '' then {{'o': m.old <> '', 'x': case when same then substr(replace(law, ' ', ''), 4) end, 's': same}} end ignore nulls) over w as st from nm
        window w as (partition by {key}, b order by i rows unbounded preceding)),
    rs as (select {key}, b, i, case when st.s then trim(regexp_replace(explicit, '\\s*(?:시행령|시행규칙)$', '') || ' ' || st.x) else explicit end as law, m.no || case when m.br <> '' then '-' || m.br else '' end as article_key, st.o as old_version, b > 0 as current_equivalent
        from ex where explicit is not null),
    rf as (select {key}, row_number() over (partition by {key} order by b, i) as pos, law, article_key, old_version, current_equivalent from rs)"""


CASE_RAW = "select doc_id, 참조조문 as raw from documents where doc_type = 'precedent' and 참조조문 is not null"
LINKED = f"""{citations_sql(CASE_RAW, "doc_id")},
    lf as (select law_id, {norm_law_sql('title')} as law_key from law_file),
    aa as (select law_id, article_key, max(doc_key) as article_id from documents where article_key is not null group by 1, 2),
    ar as (select law_key, article_key, max(article_id) as article_id from aa join lf using (law_id) group by 1, 2),
    lk as (select rf.*, case when not old_version then article_id end as linked_id from rf left join ar on ar.law_key = {norm_law_sql('law')} and ar.article_key = rf.article_key)"""


@query(f"with {LINKED} select doc_id, pos, law, article_key, old_version, current_equivalent, linked_id from lk")
def reference_link(s, d):
    """Citations of the cases, linked to the articles of the corpus."""
    return structure.link_references(table(s, d, "documents").where("doc_type = 'precedent'"), "doc_id", "참조조문", articles(s, d)).drop("law_key").withColumn("pos", F.col("pos").cast("bigint"))


@query(f"with {LINKED} select count(*) as n_refs, count(*) filter (where old_version) as n_old, count(linked_id) as n_linked, count(distinct case when linked_id is not null then doc_id end) as n_cases_linked from lk")
def reference_stats(s, d):
    r = reference_link(s, d)
    return r.agg(
        F.count("*").alias("n_refs"), F.count_if("old_version").alias("n_old"), F.count("linked_id").alias("n_linked"),
        F.count_distinct(F.when(F.col("linked_id").isNotNull(), F.col("doc_id"))).alias("n_cases_linked"),
    )


# chunks


@query("select doc_key as doc_id, true as complete, true as numbered, true as within from documents group by doc_key")
def chunk_properties(s, d):
    """Chunks of all documents: whether all words come, parts are numbered without gaps, and the budget holds."""
    x = table(s, d, "documents")
    tree = F.lit(None).cast(structure.PARAGRAPHS).alias("paragraphs")
    case = F.col("doc_type") == "precedent"
    own = [F.when(case, F.col(c)).alias(c) for c in ("holding", "summary")]
    # a text delivered under the same key again is a document of its own here
    x = x.select(F.col("doc_id").cast("string").alias("doc_id"), "doc_key", "doc_type", "title", "source_url", F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit("]")).alias("prefix"), "text", *own, tree)
    whole = x.select("doc_id", F.when(case, F.concat_ws(" ", "holding", "summary")).otherwise(F.col("text")).alias("text"))
    marks = F.regexp_replace("text", r"\[\d+\]", " ")
    c = chunk_checks(chunking.chunk_documents(x.drop("doc_key")), whole.withColumn("text", marks), chunking.ChunkRules().max_tokens)
    own = x.select("doc_id", "doc_key").join(c, "doc_id")
    return own.groupBy(F.col("doc_key").alias("doc_id")).agg(*[F.bool_and(k).alias(k) for k in ("complete", "numbered", "within")])


@query()
def chunk_documents(s, d):
    """Chunks of all documents within the token budget: cases by issue, other texts by line and window."""
    x = table(s, d, "documents").select(
        F.col("doc_key").alias("doc_id"), "doc_type", "title", "source_url", F.concat(F.lit("["), F.coalesce("title", F.lit("")), F.lit("]")).alias("prefix"), "text", "holding", "summary",
        F.lit(None).cast(structure.PARAGRAPHS).alias("paragraphs"),
    )
    return chunking.chunk_documents(x)
