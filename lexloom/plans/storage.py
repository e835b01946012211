"""Queries through sources, sinks, connectors and providers: what is written is read back, and comes out as SQL finds it in the tables.

Files go to the shared folder. What a step brings to the driver is the table of law files (of
fixed size) or a single row.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import asking, pairs, providers
from lexloom.plans.lawfiles import front
from lexloom.plans.pairs import questions
from lexloom.runtime import shared_dir, table
from lexloom.sources import files, remote
from lexloom.streaming import resume

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/lexloom-{name}-{uuid.uuid4().hex[:12]}"


# JSON lines and logs


@query("select qid, verdict, reason, judge_model, seed from judgments")
def jsonl_round_trip(s, d):
    """Judgments written as JSON lines and read with their schema."""
    x = table(s, d, "judgments").select("qid", "verdict", "reason", "judge_model", "seed")
    files.write_jsonl(x, path := folder(s, "jsonl"))
    return files.read_jsonl(s, path, x.schema)


@query("select qid, verdict from judgments")
def jsonl_stream(s, d):
    """JSON lines read as a stream, in micro-batches that are each committed to a log before the next."""
    x = table(s, d, "judgments").select("qid", "verdict")
    files.write_jsonl(x.repartition(4), path := folder(s, "jsonl"))
    log = folder(s, "log")
    files.stream_jsonl(s, path, x.schema, lambda batch, _: files.append_log(batch, log), folder(s, "checkpoint"))
    return s.read.schema(x.schema).parquet(log)


@query("select event_id, event_type from events where event_id % 3 = 0 union all select event_id, event_type from events where event_id % 3 <> 0")
def append_log(s, d):
    """Two batches appended to a log, one after the other."""
    x, log = table(s, d, "events").select("event_id", "event_type"), folder(s, "log")
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 != 0):
        files.append_log(x.where(part), log)
    return s.read.schema(x.schema).parquet(log)


@query("select event_id, event_type, user_id from events")
def stream_batches(s, d):
    """Events in micro-batches through a function with side effects, committed one by one."""
    x, log = table(s, d, "events"), folder(s, "log")
    resume.stream_batches(s, f"{d}/event[s].parquet", x.schema, lambda b, _: files.append_log(b.select("event_id", "event_type", "user_id"), log), folder(s, "checkpoint"))
    return s.read.parquet(log)


# folders of files


def law_folder(s, d) -> str:
    """A folder with a Markdown file for each law file, by kind, and a note that is none."""
    path = folder(s, "laws")
    f = table(s, d, "law_file")
    text = F.concat(front(제목=F.col("title"), 법령ID=F.col("law_id"), 공포일자=F.col("promulgated")), F.lit("# "), F.col("title"), F.lit("\n본문"))
    # one file each: the table has a fixed number of rows
    rows = f.select(F.regexp_replace("raw_path", r"^.*/", "").alias("name"), "kind", "law_id", text.alias("text")).collect()
    for r in rows:
        files.put(s, f"{path}/{r['kind']}/{r['law_id']}/{r['name']}", r["text"])
    files.put(s, f"{path}/README.txt", "nothing")
    return path


NAME = "regexp_replace(raw_path, '^.*/', '')"


@query(f"select kind || '/' || law_id || '/' || {NAME} as path, md5('# ' || title || chr(10) || '본문') as body_md5, title, law_id, promulgated from law_file")
def front_matter_files(s, d):
    """Files found by a pattern, with the fields of their front matter and their body."""
    base = law_folder(s, d)
    x = files.documents_with_front_matter(files.whole_files(s, base, "*.md"))
    at = F.regexp_extract(F.url_decode("path"), r"([^/]+/[^/]+/[^/]+)$", 1)
    field = lambda k: F.get_json_object("meta", f"$.{k}")
    return x.select(at.alias("path"), F.md5("body").alias("body_md5"), field("제목").alias("title"), field("법령ID").alias("law_id"), field("공포일자").alias("promulgated"))


@query(f"select kind, count(*) as n, min({NAME}) as first_name from law_file group by kind union all select 'README.txt', 1, 'README.txt'")
def tree_listing(s, d):
    """Files per first folder, without reading them."""
    base = law_folder(s, d)
    x = files.listing(s, base)
    tail = F.split(F.element_at(F.split(F.url_decode("path"), base.rsplit("/", 1)[1] + "/"), -1), "/")
    return x.groupBy(tail[0].alias("kind")).agg(F.count("*").alias("n"), F.min(F.element_at(tail, -1)).alias("first_name"))


@query(f"select kind || '/' || law_id || '/' || {NAME} as path from law_file where kind = '시행령' and promulgated >= '2015'")
def pruned_files(s, d):
    """Files whose path fulfils a predicate; the others are not opened (the filter is on the path column of the scan)."""
    base = law_folder(s, d)
    kinds = table(s, d, "law_file").where("promulgated >= '2015'").select(F.regexp_replace("raw_path", r"^.*/", "").alias("name"), F.col("law_id").alias("id"))
    x = files.whole_files(s, f"{base}/시행령", "*.md").select(F.regexp_extract(F.url_decode("path"), r"([^/]+/[^/]+/[^/]+)$", 1).alias("path"))
    p = F.split("path", "/")
    return x.join(F.broadcast(kinds), (p[2] == F.col("name")) & (p[1] == F.col("id")), "left_semi")  # law_file has a fixed number of rows


@query(f"select kind || '/' || law_id || '/' || {NAME} as path, 'landed' as status, sha256('x' || title) as sha256, strlen('x' || title) as n_bytes, commit_sha, 'https://example.org/' || {NAME} as url from law_file")
def landing(s, d):
    """Raw texts put into a landing folder that was emptied before, and the provenance of each."""
    path = F.concat_ws("/", "kind", "law_id", F.regexp_replace("raw_path", r"^.*/", ""))
    x = table(s, d, "law_file").select(path.alias("path"), F.concat(F.lit("x"), "title").alias("text"), "commit_sha", F.concat(F.lit("https://example.org/"), F.regexp_replace("raw_path", r"^.*/", "")).alias("url"))
    base = folder(s, "landing")
    for _ in range(2):
        out = files.land(x, base)
    return out


@query(
    f"""select string_agg(line, chr(10) order by k, line) as report from (select 0 as k, '# Sources' || chr(10) as line union all select 1, '| kind | files | bytes | newest |'
        union all select 2, '|---|---|---|---|' union all select 3, '| ' || kind || ' | ' || count(*) || ' | ' || sum(strlen(title)) || ' | ' || max(promulgated) || ' |' from law_file group by kind)"""
)
def provenance_report(s, d):
    """Markdown table of what was landed, by kind."""
    g = table(s, d, "law_file").groupBy("kind").agg(F.count("*").alias("files"), F.sum(F.octet_length("title")).alias("bytes"), F.max("promulgated").alias("newest")).orderBy("kind")
    return s.createDataFrame([(files.table_report(g, "Sources"),)], "report string")


@query(f"select raw_path as path, commit_sha as commit, md5(title) as text_md5 from law_file where commit_sha is not null")
def paged_history(s, d):
    """Versions of files from a paged history; pages and contents are fetched once and kept."""
    rows = table(s, d, "law_file").where("commit_sha is not null").select("raw_path", "commit_sha", "title").collect()  # of fixed size
    of = {}
    for r in rows:
        of.setdefault(r["raw_path"], []).append((r["commit_sha"], r["title"]))
    out = []
    with tempfile.TemporaryDirectory() as tmp:  # a cache of the driver's own; the result is a table
        cache, asked = remote.DiskCache(Path(tmp)), []
        for path, versions in of.items():
            pages = lambda n, v=versions: asked.append(n) or json.dumps([{"sha": c} for c, _ in v[n - 1 : n]])
            for _ in range(2):
                got = list(remote.history(path, pages, dict(versions).__getitem__, cache))
            out += [(v["path"], v["commit"], v["text"]) for v in got]
        if len(asked) != len(rows) + len(of):
            raise AssertionError("a page was fetched twice")
    return s.createDataFrame(out, "path string, commit string, text string").select("path", "commit", F.md5("text").alias("text_md5"))


@query(f"select {NAME} as name from law_file union select 'a/b.txt'")
def git_tree(s, d):
    """Names in the head's tree of a repository."""
    names = [r[0] for r in table(s, d, "law_file").select(F.regexp_replace("raw_path", r"^.*/", "")).distinct().collect()]  # of fixed size
    with tempfile.TemporaryDirectory() as tmp:  # the repository is the driver's
        os.makedirs(f"{tmp}/a")
        for n in [*names, "a/b.txt"]:
            Path(tmp, n).write_text("x", encoding="utf-8")
        remote.git("init", "-q", cwd=tmp)
        remote.git("add", ".", cwd=tmp)
        remote.git("-c", "user.name=x", "-c", "user.email=x@example.org", "commit", "-qm", "x", cwd=tmp)
        found = remote.tracked(tmp, recursive=True)
    return s.createDataFrame([(n,) for n in found], "name string")


@query("select law_id, title from law_file")
def first_records(s, d):
    """The records of a nested JSON answer, found by its outline."""
    answer = table(s, d, "law_file").agg(F.to_json(F.struct(F.lit(1).alias("page"), F.struct(F.collect_list(F.struct("law_id", "title")).alias("rows")).alias("data")))).first()[0]
    got = remote.first_records(json.loads(answer))
    return s.createDataFrame([(r["law_id"], r["title"]) for r in got], "law_id string, title string")


@query("select * from (values (1, 'page: int'), (2, 'data: dict'), (3, '  rows: list'), (4, '    [2]'), (5, '      id: int'), (6, '      law: str')) t(line_no, line)")
def json_outline(s, d):
    """Names and kinds of a nested JSON value."""
    lines = remote.outline({"page": 1, "data": {"rows": [{"id": 1, "law": "x"}, {}]}}, depth=6)
    return s.createDataFrame(list(enumerate(lines, 1)), "line_no int, line string")


@query("select * from (values (1, 'fetched'), (2, 'fetched'), (3, 'refused')) t(page, status)")
def http_backoff(s, d):
    """Pages fetched with waits after failures: at once, after two failures, and never."""
    import io
    import urllib.error

    out = []
    for page, failures in ((1, 0), (2, 2), (3, 99)):
        waits, left = [], [failures]

        def opener(request, timeout, left=left):
            left[0] -= 1
            if left[0] >= 0:
                raise urllib.error.URLError("later")
            return io.BytesIO(b"ok")

        try:
            ok = remote.http_get(f"http://localhost/{page}", sleep=waits.append, opener=opener) == "ok" and waits == list(remote.WAITS[:failures])
            out.append((page, "fetched" if ok else "wrong"))
        except urllib.error.URLError:
            out.append((page, "refused" if waits == list(remote.WAITS) else "wrong"))
    return s.createDataFrame(out, "page int, status string")


# settings


@query("select * from (values ('config', 'judge.keep', '[\"yes\", \"partial\"]'), ('config', 'split.test', '0.1'), ('env', 'KEY', 'a=b'), ('env', 'TOKEN', 'x')) t(source, name, value)")
def settings(s, d):
    """Values of a YAML file and of an environment file."""
    with tempfile.TemporaryDirectory() as tmp:
        Path(tmp, "c.yaml").write_text("judge:\n  keep: ['yes', partial]\nsplit: {test: 0.1}\n", encoding="utf-8")
        Path(tmp, ".env").write_text("﻿KEY=a=b\nnothing\n TOKEN = x \n", encoding="utf-8")
        config, env = files.load_config(f"{tmp}/c.yaml"), files.load_env(f"{tmp}/.env")
    rows = [("config", f"{a}.{b}", json.dumps(v)) for a, x in config.items() for b, v in x.items()] + [("env", k, v) for k, v in env.items()]
    return s.createDataFrame(rows, "source string, name string, value string")


@query("select * from (values ('yes,partial', true), ('yes', true), ('True', false), ('', false)) t(verdicts, accepted)")
def verdict_guard(s, d):
    """Verdicts to keep that are no verdicts, as unquoted YAML gives them, are refused."""
    x, out = questions(s, d).withColumn("verdict", F.lit("yes")).withColumn("judge_status", F.lit("judged")), []
    for keep in (["yes", "partial"], ["yes"], [True], []):
        try:
            pairs.finalize(x, keep)
            out.append((",".join(map(str, keep)), True))
        except ValueError:
            out.append((",".join(map(str, keep)), False))
    return s.createDataFrame(out, "verdicts string, accepted boolean")


# reports


@query("select count(*) as n_docs, count(text) as n_texts, cast(sum(length(text)) as bigint) as n_chars from documents")
def json_report(s, d):
    """A one-row result written as pretty JSON and read back."""
    x = table(s, d, "documents").agg(F.count("*").alias("n_docs"), F.count("text").alias("n_texts"), F.sum(F.char_length("text")).alias("n_chars"))
    with tempfile.TemporaryDirectory() as tmp:
        files.write_report(x, f"{tmp}/r.json")
        r = json.loads(Path(tmp, "r.json").read_text(encoding="utf-8"))
    return s.createDataFrame([(r["n_docs"], r["n_texts"], r["n_chars"])], x.schema)


@query("select group_id, any_value(case when group_id like 'precedent%' then 'case' else split end) as split from splits group by group_id union all select 'new', 'train'")
def upserted(s, d):
    """A result table in which the rows of a later run take the place of those with the same key."""
    old = table(s, d, "splits").select("group_id", "split").distinct()
    new = old.where("group_id like 'precedent%'").select("group_id", F.lit("case").alias("split")).distinct().unionByName(s.createDataFrame([("new", "train")], "group_id string, split string"))
    return files.upsert(old, new, ["group_id"])


MEANS = "avg(case when verdict = 'yes' then 1.0 else 0 end)"


@query(
    f"""select string_agg(line, chr(10) order by k, line) as report from (select 0 as k, '| System | Recall@1 | Recall@10 | MRR@10 | NDCG@10 |' as line union all select 1, '|---|---|---|---|---|'
        union all select 2, '| ' || judge_model || ' | ' || printf('%.3f', a) || ' [' || printf('%.3f', a / 2) || '–' || printf('%.3f', a) || '] | ' || printf('%.3f', a) || ' | ' || printf('%.3f', a) || ' | ' || printf('%.3f', a) || ' |'
        from (select judge_model, round({MEANS}, 6) as a from judgments group by judge_model))"""
)
def metrics_markdown(s, d):
    """Markdown table of systems with bounds where they are known (here of judges, by their share of yes)."""
    a = F.round(F.avg((F.col("verdict") == "yes").cast("double")), 6)
    g = table(s, d, "judgments").groupBy(F.col("judge_model").alias("system")).agg(a.alias("recall_1")).orderBy("system")
    g = g.select("system", "recall_1", (F.col("recall_1") / 2).alias("recall_1_lo"), F.col("recall_1").alias("recall_1_hi"), *[F.col("recall_1").alias(c) for c in ("recall_10", "mrr_10", "ndcg_10")])
    return s.createDataFrame([(files.metrics_table([r.asDict() for r in g.collect()]),)], "report string")  # a row per system


@query(
    """select '# Failures' || chr(10) || chr(10) || string_agg('## ' || qid || chr(10) || '- verdict: ' || verdict || chr(10), chr(10) order by qid, created_at, judge_model) as report
        from (select * from judgments where verdict = 'no' order by qid, created_at, judge_model limit 5)"""
)
def failure_report(s, d):
    """Markdown of a few rejected pairs."""
    x = table(s, d, "judgments").where("verdict = 'no'").orderBy("qid", "created_at", "judge_model").select("qid", "verdict")
    return s.createDataFrame([(files.sample_report(x, "Failures", {"verdict": "verdict"}, 5),)], "report string")


@query("select law_id, replace(replace(title, '<', '('), '>', ')') as title from law_file where kind = '법률'")
def page_payload(s, d):
    """A page with its data in it; the data are read back from the page, and close no script early."""
    rows = table(s, d, "law_file").where("kind = '법률'").select("law_id", F.translate("title", "<>", "()").alias("title"))
    payload = {"rows": [r.asDict() for r in rows.collect()], "end": "</script>"}  # of fixed size
    html = files.page("<html><script>const data = __DATA__;</script></html>", payload)
    inside = html.split("const data = ")[1].split(";</script>")[0]
    got = json.loads(inside)
    if html.count("</script>") != 1 or got["end"] != "</script>":
        raise AssertionError("the page is broken")
    return s.createDataFrame([(r["law_id"], r["title"]) for r in got["rows"]], rows.schema)


@query("select vec_id, label from embeddings")
def cached_vectors(s, d):
    """An encoded corpus kept under a key of its content: made once, then read."""
    base, made = folder(s, "cache"), []
    x = table(s, d, "embeddings").select("vec_id", "label")
    for _ in range(2):
        out = files.cached(s, base, "0123456789abcdef", lambda: made.append(1) or x)
    if len(made) != 1:
        raise AssertionError("the corpus was encoded twice")
    return out


# providers


@query("select place, cast(s as double) as seconds from (values ('details', 19.0), ('minutes', 1266.76), ('header', 31.0), ('default', 600.0)) t(place, s)")
def retry_delays(s, d):
    """Waiting times read from the places where providers state them."""
    read = providers.retry_delay
    rows = [
        ("details", read({"details": [{"@type": "x.RetryInfo", "retryDelay": "18s"}]})),
        ("minutes", read({"message": "Please try again in 21m5.76s."})),
        ("header", read({}, {"retry-after": "30"})),
        ("default", read({"message": "no"}, {}, 600.0)),
    ]
    return s.createDataFrame(rows, "place string, seconds double")


@query("""select '{"type":"object","properties":{"id":{"type":"integer"},"type":{"type":"string"},"list":{"type":"array","items":{"type":"object","properties":{"x":{"type":"number"}},"additionalProperties":false}}},"additionalProperties":false}' as schema""")
def schema_conversion(s, d):
    """Upper-case type names as standard JSON Schema with closed objects."""
    own = {"type": "OBJECT", "properties": {"id": {"type": "INTEGER"}, "type": {"type": "STRING"}, "list": {"type": "ARRAY", "items": {"type": "OBJECT", "properties": {"x": {"type": "NUMBER"}}}}}}
    return s.createDataFrame([(json.dumps(providers.json_schema(own), separators=(",", ":")),)], "schema string")


class Clock:
    """Time that passes only by sleeping."""

    def __init__(self):
        self.now = 0.0

    def __call__(self) -> float:
        return self.now

    def sleep(self, seconds: float) -> None:
        self.now += seconds


@query(
    """select job, model, seed, cast(s as double) as seconds from (values ('first', 'a:x', 42, 0.0), ('unfinished', 'b:y', 42, 6.0), ('all bad once', 'a:x', 7961, 12.0), ('minute limit', 'a:x', 7961, 32.0), ('overload', 'a:x', 7961, 601.0), ('bad request', 'b:y', 42, 6.0),
        ('day limit', 'quota', null, 6.0)) t(job, model, seed, s)"""
)
def provider_chain(s, d):
    """What the chain of providers does with refusals and bad answers, on a clock of its own: the answering model, its seed, and the time it took."""
    ok, bad, cut = providers.Reply("{}"), providers.Reply("no json"), providers.Reply("{}", False)
    day = providers.Refused(429, {"message": "limit per day"})
    jobs = {
        "first": ([ok], [ok]), "unfinished": ([cut], [ok]), "all bad once": ([bad, ok], [bad]), "minute limit": ([providers.Refused(429, {}, {"retry-after": "30"}), ok], None),
        "overload": ([providers.Refused(503), ok], None), "bad request": ([providers.Refused(404)], [ok]), "day limit": ([day], [day]),
    }
    out = []
    for job, (a, b) in jobs.items():
        replies, clock = {"a": list(a), "b": list(b or [])}, Clock()

        def call(name, replies=replies):
            def reply(model, system, prompt, schema, seed):
                r = replies[name].pop(0)
                if isinstance(r, Exception):
                    raise r
                return r

            return reply

        chain = providers.Chain({"a": call("a"), "b": call("b")}, ["a:x", *(["b:y"] if b else [])], clock=clock, sleep=clock.sleep)
        try:
            _, model, _, seed = chain.ask("", "", {}, 42)
            out.append((job, model, seed, clock.now))
        except providers.QuotaGone:
            out.append((job, "quota", None, clock.now))
    return s.createDataFrame(out, "job string, model string, seed int, seconds double")


@query("select 'a:x' as model, cast(3600 as double) as seconds")
def bench_state(s, d):
    """Models whose day is used up stay benched in a later process until their time is over."""
    out = []
    with tempfile.TemporaryDirectory() as tmp:
        state = Path(tmp, "state.json")
        state.write_text(json.dumps({"a:x": 3600.0, "b:y": -1.0}), encoding="utf-8")
        clock = Clock()
        chain = providers.Chain({"a": None, "b": None}, ["a:x", "b:y"], state=state, clock=clock, sleep=clock.sleep)
        out = list(chain.benched.items())
    return s.createDataFrame(out, "model string, seconds double")


@query("select qid, 'yes' as verdict, (k - 1) % 10 as place from (select qid, row_number() over (order by qid) as k from (select distinct qid from queries_raw where question is not null)) where k <= 100 and k % 10 <> 4")
def judged_batches(s, d):
    """A limited run of judging in batches of ten; answers come by ordinal, in any order, and a row without one stays undone."""
    todo = table(s, d, "queries_raw").where("question is not null").select("qid").distinct().orderBy("qid")
    log: list[dict] = []

    def ask(batch, seed):
        results = [{"id": str(i), "verdict": "yes", "place": i} for i in reversed(range(len(batch))) if i != 3] + [{"id": "x", "verdict": "no"}, {"id": 99, "verdict": "no"}]
        return providers.answers_by_ordinal(results, len(batch))

    providers.run_batches(todo, 10, ask, log.extend, 100)  # the limit is the feature: a run of bounded cost
    return s.createDataFrame([(r["qid"], r["verdict"], r["place"]) for r in log], "qid string, verdict string, place long")


def offline_chain(answer) -> providers.Chain:
    """A chain of one provider without a network, on a clock that doesn't wait."""
    clock = Clock()
    return providers.Chain({"x": providers.offline(answer)}, ["x:m"], clock=clock, sleep=clock.sleep)


def _numbers(prompt: str) -> list[int]:
    return [int(line[3:]) for line in prompt.split("\n") if line.startswith("## ") and line[3:].isdecimal()]


@query(
    """with c as (select chunk_id, row_number() over (order by chunk_id) as k from (select distinct chunk_id from chunks where text is not null)),
    q as (select chunk_id, unnest([0, 1]) as i from c where k <= 50)
    select chunk_id || '|q' || i as qid, case i when 0 then '첫째 질문' else '둘째' end as question, chunk_id, 'm-offline' as model from q"""
)
def generated_questions(s, d):
    """Questions for the next fifty passages: requests with numbered items, checked answers, at most two questions each, a log of results."""
    todo = table(s, d, "chunks").where("text is not null").groupBy("chunk_id").agg(F.min("text").alias("text")).orderBy("chunk_id")
    answer = lambda prompt, seed: {"results": [{"id": i, "questions": [" 첫째 질문", "", "둘째 ", "셋째"]} for i in reversed(_numbers(prompt))]}
    log: list[dict] = []
    asking.generate(todo, offline_chain(answer), log.extend, limit=50)  # the limit is the feature: a run of bounded cost
    return s.createDataFrame([(r["qid"], r["question"], r["chunk_id"], r["model"]) for r in log], "qid string, question string, chunk_id string, model string")


@query(
    """with q as (select qid, any_value(question) as question, row_number() over (order by qid) as k from queries_raw where question is not null group by qid)
    select qid, case (k - 1) % 10 when 0 then 'no' else 'yes' end as verdict, 'm-offline' as model from q where k <= 40 and (k - 1) % 10 <> 7"""
)
def judged_pairs(s, d):
    """Verdicts on the next forty pairs; a wrong verdict fails the whole answer, and an item without one stays undone."""
    q = table(s, d, "queries_raw").where("question is not null").groupBy("qid").agg(F.min("question").alias("question"), F.lit("-").alias("text")).orderBy("qid")
    calls: list[int] = []

    def answer(prompt, seed):
        calls.append(1)
        bad = "maybe" if len(calls) == 1 else "yes"
        return {"results": [{"id": i, "verdict": "no" if i == 0 else bad, "reason": ""} for i in _numbers(prompt) if i != 7] + [{"id": 77, "verdict": "no", "reason": ""}]}

    log: list[dict] = []
    asking.judge(q, offline_chain(answer), log.extend, limit=40)
    if len(calls) != 5:
        raise AssertionError("the bad answer was not asked again once")
    return s.createDataFrame([(r["qid"], r["verdict"], r["model"]) for r in log], "qid string, verdict string, model string")
