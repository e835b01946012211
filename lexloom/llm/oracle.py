"""DuckDB SQL of this subpackage's queries where SQL can express them."""

# Written apart from the operator's own tables, so that an error in one of them shows.
# Pairs of a Greek or Cyrillic letter, by its code point, and the Latin letter of the same look.
LOOK_ALIKES = {
    chr(int(x[:-1], 16)): x[-1]
    for x in (
        "391A 392B 395E 396Z 397H 399I 39AK 39CM 39DN 39FO 3A1P 3A4T 3A5Y 3A7X 3BFo 3F2c 3F9C 3F3j "
        "410A 412B 415E 405S 406I 408J 41AK 41CM 41DH 41EO 420P 421C 422T 425X 4AEY 430a 435e 43Eo 440p 441c 443y 445x 455s 456i 458j 4BBh 501d 51Bq 51Dw 51AQ 51CW 4CFl"
    ).split()
}
# Hyphens that look like "-", and dots that look like the middle dot of law names.
HYPHENS = "\\x{2010}\\x{2011}\\x{FE63}\\x{FF0D}"
MIDDLE_DOTS = "\\x{B7}\\x{387}\\x{2022}\\x{2027}\\x{2219}\\x{22C5}\\x{30FB}\\x{FF65}\\x{119E}"

# The bare form as far as the documents' texts need it: invisible characters out, composition, full-width forms.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
PLAIN = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
BARE = f"regexp_replace(translate(nfc_normalize(regexp_replace(text, '[\\p{{Cf}}\\x{{34F}}]', '', 'g')), '{WIDE}', '{PLAIN}'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

CASED = "\\p{Latin}\\p{Greek}\\p{Cyrillic}"
LOOK = "".join(LOOK_ALIKES)

# Look-alike letters become Latin everywhere: words that hold other letters stay different from Latin ones all the same.
SPLIT = "case lower(regexp_replace(split, '[^\\p{L}]', '', 'g')) when 'train' then 'train' when 'training' then 'train' when 'test' then 'test' when null then null else 'val' end"
QUESTIONS = f"""q as (select k, translate({BARE}, '{LOOK}', '{''.join(LOOK_ALIKES.values())}') as t, s from
    (select qid as k, any_value(question) as text, any_value(case when split is null then null else {SPLIT} end) as s from queries_raw where question is not null group by qid))"""
GRAMS = """gs as (select k, s, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) as g from {src} where length(t) >= 3),
    fl as (select k, s, len(g) as n, unnest(g) as g from gs),
    pr as (select a.k as k1, b.k as k2, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb from fl a join fl b
        on a.g = b.g and {pair} and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9 group by 1, 2)"""

# Overlaps of classes. {f}: prefix of the CTEs, {src}: rows k, text, s (bits: 1 held out, 2 train).
CONSISTENT = f"translate(nfc_normalize(regexp_replace(text, '[\\p{{Cf}}\\x{{34F}}]', '', 'g')), '{WIDE}', '{PLAIN}')"
OVERLAPS = """{f}w as (select k, s, array_to_string(regexp_extract_all(translate({cons}, '{look}', '{latin}'), '[\\p{{L}}\\p{{N}}]+'), ' ') as t from {src} where text is not null),
    {f}b as (select k, s, replace(t, ' ', '') as t from {f}w),
    {f}wc as (select t, min(k) filter (s & 1 > 0) as ek, count(distinct k) filter (s & 1 > 0) as ne, min(k) filter (s & 2 > 0) as tk, count(distinct k) filter (s & 2 > 0) as nt from {f}w where t <> '' group by t),
    {f}bc as (select t, min(k) filter (s & 1 > 0) as ek, count(distinct k) filter (s & 1 > 0) as ne, min(k) filter (s & 2 > 0) as tk, count(distinct k) filter (s & 2 > 0) as nt from {f}b where length(t) >= 3 group by t),
    {f}wg as (select t, ek, ne, tk, nt, list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) as g from (select *, string_split(t, ' ') as w from {f}wc)),
    {f}bg as (select t, ek, ne, tk, nt, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) as g from {f}bc),
    {f}wf as (select *, len(g) as n, unnest(g) as x from {f}wg), {f}bf as (select *, len(g) as n, unnest(g) as x from {f}bg),
    {f}wp as (select a.t as t1, b.t as t2, any_value(a.ek) as eval_key, any_value(a.ne) as n_eval, any_value(b.tk) as train_key, any_value(b.nt) as n_train, count(*) / any_value(a.n) as share
        from {f}wf a join {f}wf b on a.x = b.x and a.ne > 0 and b.nt > 0 group by 1, 2 having share >= 0.8),
    {f}bp as (select a.t as t1, b.t as t2, any_value(a.ek) as eval_key, any_value(a.ne) as n_eval, any_value(b.tk) as train_key, any_value(b.nt) as n_train, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) as share
        from {f}bf a join {f}bf b on a.x = b.x and a.ne > 0 and b.nt > 0 and least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9 group by 1, 2 having share >= 0.8),
    {f}o as (select '{field}' as field, 'contained' as kind, * from {f}wp union all select '{field}', 'similar', * from {f}bp)"""


def _overlaps(f: str, field: str, src: str) -> str:
    return OVERLAPS.format(f=f, field=field, src=src, cons=CONSISTENT, look=LOOK, latin="".join(LOOK_ALIKES.values()))


BITS = "bit_or(case when sp = 'train' then 2 when sp is not null then 1 else 0 end)"
ROWS = f"""qr as (select qid as k, any_value(question) as text, {BITS} as s from (select *, case when split is null then null else {SPLIT} end as sp from queries_raw) where qid is not null group by qid having s > 0),
    cr as (select chunk_id as k, any_value(text) as text, {BITS} as s from (select chunk_id, text, splits.split as sp from chunks join splits using (group_id)) where chunk_id is not null group by chunk_id having s > 0),
    {_overlaps("q", "question", "qr")}, {_overlaps("c", "chunk_text", "cr")},
    ov as (select * from (select * from qo union all select * from co) where not (t1 = t2 and n_eval = 1 and n_train = 1 and eval_key = train_key))"""

SQL: dict[str, str] = {
    "p3_found": """
        select distinct 'chunks.text' as field, chunk_id as row_key from chunks where length(text) > 1000
        union all
        select distinct 'documents.holding', cast(doc_id as varchar) from documents where length(holding) > 1000
        union all
        select distinct 'documents.summary', cast(doc_id as varchar) from documents where length(summary) > 1000
    """,
    "p6_found": """
        with q as (
            select regexp_extract(qid, '^(.+)#\\d+\\|q\\d+$', 1) as group_id,
                   lower(regexp_replace(split, '[^\\p{L}]', '', 'g')) as s
            from queries_raw where split is not null
        ), n as (
            select group_id, case when s = 'training' then 'train' when s in ('valid', 'validation', 'dev') then 'val' else s end as s from q
        )
        select group_id from n group by group_id having count(distinct s) > 1
    """,
    "p6_shares": """
        select label, cast(sum(n) as bigint) as n_rows, true as whole, true as in_proportion from
        (select coalesce(doc_type, '-') || '/' || coalesce(qtype, '-') as label, count(distinct qid) as n from queries_raw group by 1, regexp_extract(qid, '^(.+)#\\d+\\|q\\d+$', 1)) group by label
    """,
    "p8_found": f"""
        with b as (select doc_id, {BARE} as t from documents where text is not null),
        i as (select item_id, {BARE} as t from benchmark where text is not null),
        w as (select distinct item_id, substr(t, k, 40) as s from i, unnest(range(1, length(t) - 38)) as u(k)),
        x as (select doc_id, substr(t, k, 40) as s from b, unnest(range(1, length(t) - 38)) as u(k))
        select distinct doc_id, item_id from x join w using (s)
    """,
    "p9_found": """
        with w as (select doc_id, k, md5(substr(text, k, 200)) as h from documents, unnest(range(1, length(text) - 198)) as u(k) where text is not null),
        m as (select h from w group by h having min(doc_id) <> max(doc_id)),
        s as (select doc_id, k, lag(k) over (partition by doc_id order by k) as before from (select distinct doc_id, k from w join m using (h)))
        select doc_id, cast(sum(case when before is null then 200 else least(200, k - before) end) as bigint) as shared_chars from s group by doc_id
    """,
    "p4_found": f"""
        with v as (select 'law_name' as field, cast(doc_id as varchar) as row_key, law_name as v, regexp_matches(law_name, '[{MIDDLE_DOTS}]') as dots from documents where law_name is not null
            union select 'question', qid, question, false from queries_raw where question is not null)
        select distinct field, row_key from v where dots or v <> nfc_normalize(v) or regexp_matches(v, '[\\p{{Cf}}\\x{{34F}}\\x{{2F00}}-\\x{{2FDF}}\\x{{FF01}}-\\x{{FF5E}}{HYPHENS}]')
            or regexp_matches(v, '[^\\P{{Zs}} ]') or regexp_matches(v, '(?:^|[^{CASED}])[\\p{{Latin}}{LOOK}]*[{LOOK}][\\p{{Latin}}{LOOK}]*(?:$|[^{CASED}])')
    """,
    "p2_found": f"""
        with {QUESTIONS}, {GRAMS.format(src="q", pair="a.k < b.k")}
        select k1 as qid_a, k2 as qid_b from pr where c / (na + nb - c) >= 0.8
    """,
    "p5_found": f"""
        with {QUESTIONS}, qs as (select k, t, case when s = 'train' then 2 else 1 end as s from q where s is not null), {GRAMS.format(src="qs", pair="a.s = 1 and b.s = 2")},
        c as (select k, {BARE} as t, s from (select chunk_id as k, any_value(text) as text, any_value(case when split = 'train' then 2 else 1 end) as s
            from chunks join (select distinct group_id, split from splits) using (group_id) where text is not null group by chunk_id)),
        {GRAMS.format(src="c", pair="a.s = 1 and b.s = 2").replace("gs as", "gs2 as").replace("from gs", "from gs2").replace("fl as", "fl2 as").replace("fl a join fl b", "fl2 a join fl2 b").replace("pr as", "pr2 as")}
        select 'question' as field, least(k1, k2) as key_a, greatest(k1, k2) as key_b from pr where c / (na + nb - c) >= 0.8
        union all select 'chunk_text', least(k1, k2), greatest(k1, k2) from pr2 where c / (na + nb - c) >= 0.8
    """,
    "p5_overlaps": f"with {ROWS} select field, kind, eval_key, train_key, round(share, 6) as share, n_eval, n_train from ov",
    "p5_members": f"""with {ROWS}, pe as (select field, kind, t1, cast(sum(n_train) as bigint) as n_train from ov group by all),
        me as (select 'question' as field, 'contained' as kind, * from qw union all select 'question', 'similar', * from qb union all select 'chunk_text', 'contained', * from cw union all select 'chunk_text', 'similar', * from cb)
        select distinct field, kind, k as eval_key, n_train from me join pe using (field, kind) where me.t = pe.t1 and s & 1 > 0""",
}
SQL["p5_report"] = f"""with m as ({SQL["p5_members"]}),
    so as (select doc_key, min(source) as source from documents group by doc_key),
    qo2 as (select qid as eval_key, min(case when split is null then null else {SPLIT} end) as qs from queries_raw group by qid),
    gs2 as (select group_id as doc_key, min(split) as gs from splits group by group_id)
    select field, kind, case when field = 'question' then qs else gs end as split, source, count(*) as n_eval, cast(sum(n_train) as bigint) as n_links
    from (select *, regexp_extract(eval_key, '^(.+)#\\d+(\\|q\\d+)?$', 1) as doc_key from m) left join so using (doc_key) left join qo2 using (eval_key) left join gs2 using (doc_key) group by 1, 2, 3, 4"""
SQL["p3_checks"] = f"select field, row_key, true as within, true as whole_text, true as overlapping, true as natural from ({SQL['p3_found']})"
SQL["p2_groups"] = f"""with recursive pairs as ({SQL["p2_found"]}), e as (select qid_a as a, qid_b as b from pairs union select qid_b, qid_a from pairs),
    r as (select qid, qid as g from (select distinct qid from queries_raw where qid is not null) union select e.b, r.g from r join e on e.a = r.qid),
    t as (select qid, any_value(question) as text from queries_raw where qid is not null group by qid),
    n as (select qid, coalesce(length({BARE}), 0) >= 3 as has from t)
    select r.qid, case when any_value(has) then min(g) end as group_id, (select count(*) from e where e.a = r.qid) as n_links from r join n using (qid) group by r.qid"""
SQL["p8_spans"] = SQL["p8_found"].replace("select doc_id, substr(t, k, 40) as s from b", "select doc_id, k, substr(t, k, 40) as s from b").replace(
    "select distinct doc_id, item_id from x join w using (s)",
    """select doc_id, item_id, cast(min(k) - 1 as int) as start, cast(max(k) + 39 as int) as "end" from (select *, sum(new) over (partition by doc_id, item_id order by k) as island from
        (select *, case when k - lag(k) over (partition by doc_id, item_id order by k) <= 40 then 0 else 1 end as new from (select distinct doc_id, item_id, k from x join w using (s)))) group by doc_id, item_id, island""",
)
SQL["p9_spans"] = SQL["p9_found"].replace(
    "select doc_id, cast(sum(case when before is null then 200 else least(200, k - before) end) as bigint) as shared_chars from s group by doc_id",
    """select doc_id, cast(sum(n) as bigint) as shared_chars, count(*) as n_spans, max(n) as longest from (select doc_id, max(k) + 200 - min(k) as n from
        (select *, sum(case when k - before <= 200 then 0 else 1 end) over (partition by doc_id order by k) as island from s) group by doc_id, island) group by doc_id""",
)
