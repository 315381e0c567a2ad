"""Queries over the sample tables for each operator, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleyproof.functions import text as tx
from galleyproof.functions.language import DIACRITICS, TRIGRAMS, detect_language
from galleyproof.operators import align, classify, dom, images, pairing, rollup, state, tags
from galleyproof.plans import admin_queries, check_queries, rule_queries, source_queries  # noqa: F401  (they register theirs)
from galleyproof.plans.fixtures import fx, with_views
from galleyproof.plans.registry import COMPARE, ORACLES, QUERIES, SCAN, SPACES, TOKENS, on, query, quoted, read
from galleyproof.sources import packages, rtf

# ---- text

_DIRTY = "concat('“', text, '” – ‘x’ ', chr(8203), chr(8207), 'أحمد ـ كتاب؟ a - b')"



def _dirty(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.expr(_DIRTY.replace("chr(8203)", "'​'").replace("chr(8207)", "'‏'")).alias("text"))


def _digest(name, function, oracle):
    @query(name, f"select doc_id, md5({on(oracle, 'text')}) as h from (select doc_id, {_DIRTY} as text from documents)")
    def run(spark, sf):
        return _dirty(spark, sf).select("doc_id", F.md5(function(F.col("text"))).alias("h"))


_digest("text_norm_scan", tx.norm_scan, SCAN)
_digest("text_norm_compare", tx.norm_compare, COMPARE)
_digest("text_norm_text", tx.norm_text, f"regexp_replace({COMPARE}, '\\.+$', '')")


@query("text_tokens", f"select doc_id, len(t) as n, md5(array_to_string(t, '|')) as h from (select doc_id, {on(TOKENS, on(SCAN, 'text'))} as t from documents)")
def text_tokens(spark, sf):
    t = read(spark, sf, "documents").select("doc_id", tx.tokens(tx.norm_scan(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|")).alias("h"))


@query("text_top_tokens", f"select word, count(*) as n from (select unnest({on(TOKENS, on(COMPARE, 'text'))}) as word from documents) group by word order by n desc, word limit 50")
def text_top_tokens(spark, sf):
    words = read(spark, sf, "documents").select(F.explode(tx.tokens(tx.norm_compare(F.col("text")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


@query(
    "text_profile",
    f"""select doc_id, cast(count(*) filter (regexp_full_match(t, '[\\p{{P}}\\p{{S}}]')) as bigint) as marks, cast(count(*) filter (lower(t) <> upper(t)) as bigint) as cased, count(*) as n
        from (select doc_id, unnest({on(TOKENS, on(SCAN, 'text'))}) as t from documents) group by doc_id""",
)
def text_profile(spark, sf):
    """str_is_punct and str_has_case."""
    t = read(spark, sf, "documents").select("doc_id", F.explode(tx.tokens(tx.norm_scan(F.col("text")))).alias("t"))
    return t.groupBy("doc_id").agg(F.count_if(tx.is_punctuation(F.col("t"))).alias("marks"), F.count_if(tx.has_case(F.col("t"))).alias("cased"), F.count("*").alias("n"))


_LINES = "select doc_id, unnest(string_split(concat(text, chr(10), 'Page ', cast(doc_id as varchar), chr(10), '© 2026 Example, Inc. All rights  reserved. Page 7', chr(10), '42', chr(10)), chr(10))) as line from documents"
_STRIP = on(SCAN, "line")
_STOCK = tx.boilerplate_of("Example")
for _p in _STOCK:
    _STRIP = f"regexp_replace({_STRIP}, '(?i){_p}', ' ', 'g')"
_STRIP = f"trim(regexp_replace({_STRIP}, '{SPACES}', ' ', 'g'))"


@query("text_boilerplate", f"select doc_id, cast(count(*) filter (not regexp_matches({_STRIP}, '\\p{{L}}') or regexp_full_match(trim(line), '(?i)page\\s+\\d+')) as bigint) as boilerplate, count(*) as n, md5(string_agg({_STRIP}, '|' order by line)) as h from ({_LINES}) group by doc_id")
def text_boilerplate(spark, sf):
    lines = F.split(F.concat_ws("\n", "text", F.concat(F.lit("Page "), "doc_id"), F.lit("© 2026 Example, Inc. All rights  reserved. Page 7"), F.lit("42"), F.lit("")), "\n")
    judged = F.transform(lines, lambda x: F.struct(x.alias("line"), tx.strip_boilerplate(x, _STOCK).alias("s"), tx.is_boilerplate_line(x, _STOCK).alias("b")))
    kept = read(spark, sf, "documents").select("doc_id", F.sort_array(judged).alias("l"))
    stock = F.size(F.filter("l", lambda x: x["b"]))
    return kept.select("doc_id", stock.cast("long").alias("boilerplate"), F.size("l").cast("long").alias("n"), F.md5(F.array_join(F.transform("l", lambda x: x["s"]), "|")).alias("h"))


_HY = r"([\p{L}\p{M}\p{N}])(?:\s+-\s*|-\s+)([\p{L}\p{M}\p{N}])"


def _canon(x: str) -> str:
    once = f"regexp_replace({on(COMPARE, x)}, '{_HY}', '\\1-\\2', 'g')"
    return f"regexp_replace({once}, '{_HY}', '\\1-\\2', 'g')"


@query("text_hyphen", f"""select item_id, md5({_canon("replace(text, ' the ', ' - ')")}) as h,
    {_canon("replace(text, ' the ', ' - ')")} = {_canon("replace(text, ' the ', '-')")} and replace(text, ' the ', ' - ') <> text as noise from benchmark""")
def text_hyphen(spark, sf):
    """str_hyphen_canon and str_hyphen_noise."""
    spaced, tight = (F.replace(F.col("text"), F.lit(" the "), F.lit(x)) for x in (" - ", "-"))
    return read(spark, sf, "benchmark").select("item_id", F.md5(tx.hyphen_canonical(spaced)).alias("h"), tx.hyphen_noise(spaced, tight).alias("noise"))


@query("text_context", "select item_id, array_to_string(list_slice(w, greatest(i - 8, 0) + 1, i + 9), ' ') as context from (select item_id, string_split(text, ' ') as w, 10 as i from benchmark)")
def text_context(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", tx.context(F.split("text", " "), F.lit(10)).alias("context"))


@query("text_safe_cell", "select p_partkey, case when substr(s, 1, 1) in ('=', '+', '-', '@') then concat('''', s) else s end as cell from (select p_partkey, trim(concat(case p_partkey % 5 when 0 then '=' when 1 then '+' when 2 then '-' when 3 then ' @' else '' end, p_name)) as s from part)")
def text_safe_cell(spark, sf):
    mark = F.expr("case p_partkey % 5 when 0 then '=' when 1 then '+' when 2 then '-' when 3 then ' @' else '' end")
    return read(spark, sf, "part").select("p_partkey", tx.safe_cell(F.concat(mark, "p_name")).alias("cell"))


@query("text_pair_key", with_views("select file_id, regexp_replace(lower(regexp_extract(relpath, '([^/]*)\\.[^.]*$', 1)), '[^\\p{L}\\p{N}]', '', 'g') as pdf_key, regexp_replace(lower(concat(regexp_extract(relpath, '^[^/]*'), case when length(string_split(relpath, '/')[2]) <= 3 then string_split(relpath, '/')[2] else '' end, regexp_extract(relpath, '([^/]*)\\.[^.]*$', 1))), '[^\\p{L}\\p{N}]', '', 'g') as rtf_key from fx_files", "fx_files"))
def text_pair_key(spark, sf):
    (files,) = fx(spark, sf, "fx_files")
    return files.select("file_id", tx.pair_key(F.col("relpath")).alias("pdf_key"), tx.pair_key(F.col("relpath"), "rtf").alias("rtf_key"))


@query("text_sanitise_name", "select p_partkey, substr(trim(regexp_replace(regexp_replace(replace(trim(p_name), ' ', '_'), '[^A-Za-z0-9_-]+', '', 'g'), '_+', '_', 'g'), '_-'), 1, 40) as name from part")
def text_sanitise_name(spark, sf):
    return read(spark, sf, "part").select("p_partkey", tx.sanitise_name(F.concat("p_name", F.lit(".zip"))).alias("name"))


@query("text_css_length", "select page_id, try_cast(nullif(regexp_extract(concat('width: ', cast(page_id as varchar), '.5px'), '(\\d+(?:\\.\\d+)?)', 1), '') as double) as length from pages")
def text_css_length(spark, sf):
    return read(spark, sf, "pages").select("page_id", tx.css_length(F.concat(F.lit("width: "), "page_id", F.lit(".5px"))).alias("length"))


@query("text_inline_style", "select page_id, concat(cast(page_id as varchar), 'pt') as padding, 'b:c' as a, cast(2 as bigint) as n from pages")
def text_inline_style(spark, sf):
    styles = read(spark, sf, "pages").select("page_id", tx.inline_style(F.concat(F.lit("Padding-Left: 1px; x; a:b:c; padding-left:"), "page_id", F.lit("PT"))).alias("m"))
    return styles.select("page_id", F.col("m")["padding-left"].alias("padding"), F.col("m")["a"].alias("a"), F.size("m").cast("long").alias("n"))


_RTL = "concat('abc ', case doc_id % 3 when 0 then 'كتاب قلم' when 1 then 'اب' else '' end, ' ', substr(text, 1, cast(doc_id % 12 as int)))"


@query("rtl_is_text", f"select doc_id, len(regexp_extract_all(s, '\\p{{Arabic}}')) >= greatest(3, 0.4 * len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]'))) as rtl from (select doc_id, {_RTL} as s from documents)")
def rtl_is_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.is_rtl_text(F.expr(_RTL)).alias("rtl"))


_TURN = r"\x{0600}-\x{065F}\x{066A}-\x{06EF}\x{06FA}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
_RUNS = f"[{_TURN}]+(?:\\s+[{_TURN}]+)*|[^{_TURN}]+"


@query("rtl_fix_line", f"select doc_id, case when len(regexp_extract_all(s, '\\p{{Arabic}}')) >= greatest(3, 0.4 * len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]'))) then array_to_string(list_transform(regexp_extract_all(s, '{_RUNS}'), lambda r: case when regexp_matches(r, '^[{_TURN}]') then reverse(r) else r end), '') else s end as line from (select doc_id, {_RTL} as s from documents)")
def rtl_fix_line(spark, sf):
    return read(spark, sf, "documents").select("doc_id", tx.rtl_fix_line(F.expr(_RTL)).alias("line"))


def _language_sql() -> str:
    count = lambda t: f"(length(s) - length(replace(s, '{t}', ''))) / {len(t)}.0"
    scores = {n: " + ".join(count(t) for t in grams) for n, grams in TRIGRAMS.items()}
    scores["English"] = f"({scores['English']}) * case when len(regexp_extract_all(s, '{DIACRITICS}')) < 5 then 1.5 else 1.0 end"
    columns = ", ".join(f"{v} as {k}" for k, v in scores.items())
    best = f"greatest({', '.join(TRIGRAMS)})"
    pick = " ".join(f"when {n} = {best} then '{n}'" for n in TRIGRAMS)
    return f"select doc_id, case {pick} end as language from (select doc_id, {columns} from (select doc_id, lower({on(SCAN, 'substr(text, 1, 3000)')}) as s from documents))"


@query("lang_detect", _language_sql())
def lang_detect(spark, sf):
    return read(spark, sf, "documents").select("doc_id", detect_language(F.col("text")).alias("language"))


@query("lang_confusion", f"select lang, language, count(*) as n from documents join ({_language_sql()}) using (doc_id) group by lang, language")
def lang_confusion(spark, sf):
    return read(spark, sf, "documents").groupBy("lang", detect_language(F.col("text")).alias("language")).agg(F.count("*").alias("n"))


# ---- files and pairs


@query("files_filter", with_views("select file_id, lower(regexp_extract(relpath, '\\.[^.]+$')) as ext from fx_files where lower(regexp_extract(relpath, '\\.[^.]+$')) in ('.pdf', '.rtf', '.html', '.docx', '.png')", "fx_files"))
def files_filter(spark, sf):
    (files,) = fx(spark, sf, "fx_files")
    ext = F.lower(F.regexp_extract("relpath", r"\.[^.]+$", 0))
    return files.select("file_id", ext.alias("ext")).where(F.col("ext").isin(".pdf", ".rtf", ".html", ".docx", ".png"))


@query("pair_inner", with_views("select a.key, a.position, a.file_id as source_id, b.file_id as target_id from (select *, row_number() over (partition by key order by file_id) as position from fx_source) a join (select *, row_number() over (partition by key order by file_id) as position from fx_target) b using (key, position)", "fx_source", "fx_target"))
def pair_inner(spark, sf):
    return pairing.pair_files(*fx(spark, sf, "fx_source", "fx_target"))


@query("pair_unmatched", with_views("select case when a.key is null then 'Target' else 'Source' end as side, coalesce(a.key, b.key) as key, coalesce(a.file_id, b.file_id) as file_id from (select *, row_number() over (partition by key order by file_id) as position from fx_source) a full join (select *, row_number() over (partition by key order by file_id) as position from fx_target) b on a.key = b.key and a.position = b.position where a.key is null or b.key is null", "fx_source", "fx_target"))
def pair_unmatched(spark, sf):
    return pairing.unmatched_files(*fx(spark, sf, "fx_source", "fx_target"))


@query("pair_key_sets", with_views("select coalesce(a.key, b.key) as key, case when b.key is null then 'source only' when a.key is null then 'target only' else 'both' end as \"where\" from (select distinct key from fx_source) a full join (select distinct key from fx_target) b on a.key = b.key", "fx_source", "fx_target"))
def pair_key_sets(spark, sf):
    return pairing.key_sets(*fx(spark, sf, "fx_source", "fx_target"))


# ---- tag structure

_CLEAN = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\\b[^>]*>).*?(</(?:script|style)\\s*>)', '\\1\\2', 'g')"
_EVENTS = f"list_filter(list_transform(list_filter(regexp_extract_all({_CLEAN}, '<(/?[A-Za-z][^\\s/>]*)(?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>'), lambda t: not regexp_matches(t, '/\\s*>$') or starts_with(t, '</')), lambda t: lower(regexp_extract(t, '^<(/?[A-Za-z][^\\s/>]*)', 1))), lambda n: ltrim(n, '/') not in ({quoted(tags.VOID)}))"


@query("tag_events", f"select page_id, position - 1 as position, e[position] as event from (select page_id, e, unnest(generate_series(1, len(e))) as position from (select page_id, {_EVENTS} as e from pages))")
def tag_events(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.posexplode(tags.tag_events(F.col("html"))).alias("position", "event")).withColumn("position", F.col("position").cast("long"))


@query("tag_stack_issues")
def tag_stack_issues(spark, sf):
    return tags.raw_tag_issues(read(spark, sf, "pages"))


@query("tag_conservation", f"select page_id, cast(len(list_filter(e, lambda x: not starts_with(x, '/'))) as bigint) as opened, true as balanced from (select page_id, {_EVENTS} as e from pages)")
def tag_conservation(spark, sf):
    """Every opened element is closed, skipped or unclosed: the law that the stack obeys."""
    events = tags.tag_events(F.col("html"))
    found = tags.stack_issues(events)
    counted = read(spark, sf, "pages").select("page_id", events.alias("e"), found.alias("f"))
    opened = F.size(F.filter("e", lambda x: ~x.startswith("/")))
    ends = F.size("e") - opened
    of = lambda c: F.size(F.filter("f", lambda i: i["category"] == c))
    balanced = opened == (ends - of("Unexpected Closing Tag")) + of("Tag Nesting Mismatch") + of("Unclosed Tag")
    return counted.select("page_id", opened.cast("long").alias("opened"), balanced.alias("balanced"))


@query("page_severity")
def page_severity(spark, sf):
    """The flagship: tag issues, classified, counted and turned into each page's severity."""
    pages = read(spark, sf, "pages")
    counted = classify.count_severities(classify.classify(tags.raw_tag_issues(pages)), "page_id")
    out = pages.select("page_id", "url").join(counted, "page_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("critical", "major", "minor")]
    return out.select("page_id", "url", *zero, F.coalesce("file_severity", F.lit("Passed")).alias("file_severity"))


# ---- issues, files, runs, users

_SEVERITY = f"case when category in ({quoted(classify.CRITICAL)}) then 'Critical' when category in ({quoted(classify.MAJOR)}) then 'Major' when category in ({quoted(classify.MINOR)}) then 'Minor' when engine_severity = 'error' then 'Critical' when engine_severity = 'warning' then 'Major' else 'Minor' end"
_AREA = "case " + " ".join(f"when category in ({quoted(v)}) then '{k}'" for k, v in classify.AREAS.items()) + " else 'Other' end"
_CLASSIFIED = f"(select *, {_SEVERITY} as severity, {_AREA} as area from fx_issues)"
_RANK = "case severity when 'Critical' then 0 when 'Major' then 1 else 2 end"


def _classified(spark, sf):
    (issues,) = fx(spark, sf, "fx_issues")
    return classify.classify(issues)


@query("issue_classify", with_views(f"select run_id, issue_id, category, severity, area from {_CLASSIFIED}", "fx_issues"))
def issue_classify(spark, sf):
    return _classified(spark, sf).select("run_id", "issue_id", "category", "severity", "area")


@query("issue_dedupe", with_views("select distinct run_id, file_no, category, engine_severity, coalesce(line, -1) as line from fx_issues", "fx_issues"))
def issue_dedupe(spark, sf):
    (issues,) = fx(spark, sf, "fx_issues")
    keys = ["run_id", "file_no", "category", "engine_severity", "line"]
    issues = issues.withColumn("line", F.coalesce("line", F.lit(-1)))
    return classify.first_of_each(issues, keys, ["issue_id"]).select(*keys)


@query("issue_sorted", with_views(f"select run_id, issue_id, row_number() over (partition by run_id order by {_RANK}, coalesce(line, 999999), category, issue_id) as position from {_CLASSIFIED}", "fx_issues"))
def issue_sorted(spark, sf):
    return classify.sorted_rank(_classified(spark, sf), "run_id").select("run_id", "issue_id", "position")


@query("file_severity", with_views(f"select *, case when critical >= 1 or major >= 5 then 'Critical' when major >= 1 or minor >= 8 then 'Major' when minor >= 1 then 'Minor' else 'Passed' end as file_severity from (select run_id, file_no, count(*) filter (severity = 'Critical') as critical, count(*) filter (severity = 'Major') as major, count(*) filter (severity = 'Minor') as minor from {_CLASSIFIED} group by run_id, file_no)", "fx_issues"))
def file_severity(spark, sf):
    return classify.count_severities(_classified(spark, sf), "run_id", "file_no")


@query("file_type_counts", with_views("select run_id, file_no, category, count(*) as n from fx_issues group by run_id, file_no, category", "fx_issues"))
def file_type_counts(spark, sf):
    return _classified(spark, sf).groupBy("run_id", "file_no", "category").agg(F.count("*").alias("n"))


@query("file_area_counts", with_views(f"select run_id, file_no, area, count(*) as n from {_CLASSIFIED} group by run_id, file_no, area", "fx_issues"))
def file_area_counts(spark, sf):
    return _classified(spark, sf).groupBy("run_id", "file_no", "area").agg(F.count("*").alias("n"))


@query("batch_category_breakdown", with_views("select category, count(*) as n from fx_issues group by category order by n desc, category", "fx_issues"))
def batch_category_breakdown(spark, sf):
    return _classified(spark, sf).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


@query("batch_file_sev_dist", with_views(f"select v.s as file_severity, count(f.run_id) as n from (values ('Critical'), ('Major'), ('Minor'), ('Passed')) as v(s) left join (select run_id, case when critical >= 1 or major >= 5 then 'Critical' when major >= 1 or minor >= 8 then 'Major' when minor >= 1 then 'Minor' else 'Passed' end as s from (select run_id, file_no, count(*) filter (severity = 'Critical') as critical, count(*) filter (severity = 'Major') as major, count(*) filter (severity = 'Minor') as minor from {_CLASSIFIED} group by run_id, file_no)) f on v.s = f.s group by v.s", "fx_issues"))
def batch_file_sev_dist(spark, sf):
    files = file_severity(spark, sf).groupBy("file_severity").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(s,) for s in classify.SEVERITIES], "file_severity string")
    return names.join(files, "file_severity", "left").select("file_severity", F.coalesce("n", F.lit(0)).alias("n"))


_COUNTS = """select run_id, count(*) as total_files, count(*) filter (status in ('done', 'error', 'interrupted')) as completed_files, count(*) filter (status = 'running') as running_files,
    count(*) filter (status = 'done' and issue_count = 0) as passed_files, count(*) filter (status = 'done' and issue_count > 0) + count(*) filter (status = 'error') as failed_files,
    cast(sum(case when status = 'done' then critical_count else 0 end) as bigint) as critical_count, cast(sum(case when status = 'done' then major_count else 0 end) as bigint) as major_count,
    cast(sum(case when status = 'done' then minor_count else 0 end) as bigint) as minor_count, count(*) filter (status = 'error') as error_files, count(*) filter (status = 'interrupted') as interrupted_files
    from fx_file_pairs group by run_id"""


@query("run_counts", with_views(f"select *, case when completed_files >= total_files then case when interrupted_files > 0 then 'interrupted' when error_files > 0 then 'failed' else 'done' end when running_files > 0 then 'running' else 'prepared' end as status from ({_COUNTS})", "fx_file_pairs"))
def run_counts(spark, sf):
    return rollup.run_counts(*fx(spark, sf, "fx_file_pairs"))


@query("batch_overview", with_views("select count(*) as files, count(*) filter (status = 'done' and issue_count = 0) as passed, count(*) filter (status = 'done' and issue_count > 0) as failed, cast(sum(issue_count) as bigint) as issues, cast(sum(critical_count) as bigint) as critical, cast(sum(major_count) as bigint) as major, cast(sum(minor_count) as bigint) as minor from fx_file_pairs", "fx_file_pairs"))
def batch_overview(spark, sf):
    (pairs,) = fx(spark, sf, "fx_file_pairs")
    done = F.col("status") == "done"
    return pairs.agg(F.count("*").alias("files"), F.count_if(done & (F.col("issue_count") == 0)).alias("passed"), F.count_if(done & (F.col("issue_count") > 0)).alias("failed"), F.sum("issue_count").alias("issues"), F.sum("critical_count").alias("critical"), F.sum("major_count").alias("major"), F.sum("minor_count").alias("minor"))


@query("run_interrupt", with_views("select run_id, case when status in ('running', 'queued') or (status = 'prepared' and run_id in (select run_id from fx_file_pairs where status in ('running', 'queued', 'interrupted'))) then 'interrupted' else status end as status from (select run_id, case when run_id % 3 = 0 then 'prepared' else status end as status from fx_runs)", "fx_runs", "fx_file_pairs"))
def run_interrupt(spark, sf):
    runs, pairs = fx(spark, sf, "fx_runs", "fx_file_pairs")
    return rollup.interrupt(runs.withColumn("status", F.when(F.col("run_id") % 3 == 0, "prepared").otherwise(F.col("status"))), pairs)[0].select("run_id", "status")


@query("user_runs", with_views("select u.id, username, role, count(r.run_id) as total_runs, count(*) filter (r.status = 'done') as completed_runs, count(*) filter (r.status in ('failed', 'error', 'interrupted')) as problem_runs from fx_users u left join fx_runs r on u.id = r.user_id group by u.id, username, role", "fx_users", "fx_runs"))
def user_runs(spark, sf):
    return rollup.user_runs(*fx(spark, sf, "fx_users", "fx_runs"))


@query("runs_recent", with_views("select run_id, username, r.status, created_at from fx_runs r join fx_users u on u.id = r.user_id order by created_at desc, run_id desc limit 250", "fx_runs", "fx_users"))
def runs_recent(spark, sf):
    runs, users = fx(spark, sf, "fx_runs", "fx_users")
    return rollup.newest(rollup.runs_with_users(runs, users), "created_at", "run_id", 250).select("run_id", "username", "status", "created_at")


@query("problem_runs", with_views("select run_id, username, r.status from fx_runs r join fx_users u on u.id = r.user_id where r.status in ('failed', 'error', 'interrupted') order by created_at desc, run_id desc limit 250", "fx_runs", "fx_users"))
def problem_runs(spark, sf):
    runs, users = fx(spark, sf, "fx_runs", "fx_users")
    broken = runs.where(F.col("status").isin("failed", "error", "interrupted"))
    return rollup.newest(rollup.runs_with_users(broken, users), "created_at", "run_id", 250).select("run_id", "username", "status")


@query("runs_for_user", with_views("select run_id, status from fx_runs where user_id = 2 and exists (select 1 from fx_users where id = 2 and status = 'active') order by created_at desc, run_id desc limit 100", "fx_runs", "fx_users"))
def runs_for_user(spark, sf):
    runs, users = fx(spark, sf, "fx_runs", "fx_users")
    return rollup.newest(rollup.visible_to(runs, users, 2), "created_at", "run_id", 100).select("run_id", "status")


@query("pairs_with_user", with_views("select p.run_id, file_no, p.status, username from fx_file_pairs p join fx_runs r on p.run_id = r.run_id join fx_users u on u.id = r.user_id", "fx_file_pairs", "fx_runs", "fx_users"))
def pairs_with_user(spark, sf):
    pairs, runs, users = fx(spark, sf, "fx_file_pairs", "fx_runs", "fx_users")
    return pairs.join(rollup.runs_with_users(runs.select("run_id", "user_id"), users), "run_id").select("run_id", "file_no", "status", "username")


@query("issues_for_run", with_views("select i.run_id, i.file_no, i.issue_id, p.status from fx_issues i join fx_file_pairs p on i.run_id = p.run_id and i.file_no = p.file_no", "fx_issues", "fx_file_pairs"))
def issues_for_run(spark, sf):
    issues, pairs = fx(spark, sf, "fx_issues", "fx_file_pairs")
    return issues.join(pairs.select("run_id", "file_no", "status"), ["run_id", "file_no"]).select("run_id", "file_no", "issue_id", "status")


@query("admin_summary", with_views("select * from (select count(*) as users, count(*) filter (status = 'active') as active_users from fx_users), (select count(*) filter (status = 'pending') as pending_invites from fx_invites), (select count(*) filter (status in ('requested', 'link_generated')) as pending_resets from fx_resets), (select count(*) as runs, count(*) filter (status = 'done') as completed_runs, count(*) filter (status in ('failed', 'error')) as failed_runs, count(*) filter (status = 'interrupted') as interrupted_runs, cast(sum(critical_count) as bigint) as critical_issues from fx_runs)", "fx_users", "fx_invites", "fx_resets", "fx_runs"))
def admin_summary(spark, sf):
    return rollup.admin_summary(*fx(spark, sf, "fx_users", "fx_invites", "fx_resets", "fx_runs"))


@query("audit_recent", with_views("select event_id, user_id, action, cast(json_extract_string(details, '$.k') as bigint) as k from fx_audit order by created_at desc, event_id desc limit 300", "fx_audit"))
def audit_recent(spark, sf):
    (audit,) = fx(spark, sf, "fx_audit")
    return rollup.newest(audit, "created_at", "event_id", 300).select("event_id", "user_id", "action", F.get_json_object("details", "$.k").cast("long").alias("k"))


@query("session_idle", "with e as (select user_id, event_id, cast(floor(epoch(ts)) as bigint) as s from events), f as (select *, case when s - lag(s) over (partition by user_id order by s, event_id) <= 1800 then 0 else 1 end as fresh from e), g as (select *, sum(fresh) over (partition by user_id order by s, event_id) as session from f) select user_id, cast(session as bigint) as session, min(s) as first_second, max(s) as last_second, count(*) as n_events from g group by user_id, session")
def session_idle(spark, sf):
    return rollup.idle_sessions(read(spark, sf, "events"))


# ---- alignment

_CHANGED = "transform(filter(split(text, ' '), (w, i) -> i % 17 <> 16), (w, i) -> if(i % 23 = 22, 'changed', if(i % 31 = 30, concat(w, ' ,'), w)))"


@query("align_issues")
def align_issues(spark, sf):
    pairs = read(spark, sf, "benchmark").select(F.col("item_id").alias("pair_id"), F.col("text").alias("source_text"), F.array_join(F.expr(_CHANGED), " ").alias("target_text"))
    return align.text_issues(pairs)


@query("align_tiling", f"select item_id as pair_id, cast(len({on(TOKENS, on(COMPARE, 'text'))}) as bigint) as n, true as tiles from benchmark")
def align_tiling(spark, sf):
    """The operations tile both sequences, and equal ones have equal tokens."""
    words = lambda c: tx.tokens(tx.norm_compare(c))
    pairs = read(spark, sf, "benchmark").select(F.col("item_id").alias("pair_id"), words(F.col("text")).alias("source"), words(F.array_join(F.expr(_CHANGED), " ")).alias("target"))
    done = align.opcodes(pairs).join(pairs, "pair_id")
    covered = F.aggregate("ops", F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("ok")), lambda a, o: F.struct(o["i2"].alias("i"), o["j2"].alias("j"), (a["ok"] & (a["i"] == o["i1"]) & (a["j"] == o["j1"])).alias("ok")))
    same = F.forall("ops", lambda o: (o["op"] != "equal") | (F.slice("source", o["i1"] + 1, o["i2"] - o["i1"]) == F.slice("target", o["j1"] + 1, o["j2"] - o["j1"])))
    return done.select("pair_id", F.size("source").cast("long").alias("n"), (covered["ok"] & (covered["i"] == F.size("source")) & (covered["j"] == F.size("target")) & same).alias("tiles"))


@query("align_merge_hyphen", "select item_id, 'a-b|-|c|long-term' as merged from benchmark")
def align_merge_hyphen(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.array_join(align.merge_hyphens(F.split(F.lit("a - b - c long - term"), " ")), "|").alias("merged"))


# ---- images

_HASHES = "select vec_id, vec_id % 50 as doc_id, {p} as phash, {c} as chash from embeddings"
_SIGN_SPARK = "aggregate(sequence(0, 63), 0L, (h, i) -> h | if(embedding[i] > 0, shiftleft(1L, i), 0L))"
_SIGN_COLOUR = "aggregate(sequence(0, 13), 0L, (h, i) -> h | if(embedding[i] > 0, shiftleft(1L, i), 0L))"


def _images(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("doc_id"), F.expr(_SIGN_SPARK).alias("phash"), F.expr(_SIGN_COLOUR).alias("chash"))
    sides = [e.where(F.col("vec_id") % 2 == k).withColumn("idx", F.col("vec_id")) for k in (0, 1)]
    sources = sides[0].select("doc_id", "idx", "phash", "chash")
    targets = sides[1].select((F.col("doc_id") - 1).alias("doc_id"), "idx", "phash", "chash")
    return sources, targets


_BITS = "list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end)"
_IMAGES = f"""e as (select vec_id, vec_id % 50 as doc_id, {_BITS} as b from embeddings), s as (select doc_id, vec_id as idx, b from e where vec_id % 2 = 0), t as (select doc_id - 1 as doc_id, vec_id as idx, b from e where vec_id % 2 = 1),
    d as (select t.doc_id, t.idx, s.idx as source_idx, list_sum(list_transform(list_zip(s.b, t.b), lambda z: case when z[1] <> z[2] then 1 else 0 end)) as distance, list_sum(list_transform(list_zip(s.b[1:14], t.b[1:14]), lambda z: case when z[1] <> z[2] then 1 else 0 end)) as colour_distance from t join s using (doc_id)),
    m as (select * from (select *, row_number() over (partition by doc_id, idx order by distance, source_idx) as n from d) where n = 1)"""
_VERDICT = "case when distance <= 18 and colour_distance <= 15 then 'ok' when distance <= 18 then 'Image Possibly Wrong' else 'Image Doesn''t Match Source' end"


@query("image_match", f"with {_IMAGES} select doc_id, idx, source_idx, cast(distance as int) as distance, {_VERDICT} as verdict, greatest(0.0, 1 - distance / 64.0)::double as similarity from m")
def image_match(spark, sf):
    m = images.nearest_sources(*_images(spark, sf))
    return m.select("doc_id", "idx", "source_idx", "distance", images.verdict(F.col("distance"), F.col("colour_distance")).alias("verdict"), images.similarity(F.col("distance")).alias("similarity"))


@query("image_missing", f"with {_IMAGES} select doc_id, idx from s where not exists (select 1 from m where m.doc_id = s.doc_id and m.source_idx = s.idx and distance <= 18)")
def image_missing(spark, sf):
    sources, targets = _images(spark, sf)
    return images.missing(sources, images.nearest_sources(sources, targets))


# ---- trees of pages

_DIRT = "replace(html, '</h1>', case page_id % 4 when 0 then ' TODO</h1>' when 1 then ' donâ€™t</h1>' else '</h1>' end)"


def _tree(spark, sf, html="html"):
    return dom.nodes(read(spark, sf, "pages").select("page_id", F.expr(html).alias("html")))


@query("dom_visible_text")
def dom_visible_text(spark, sf):
    return dom.visible_text(_tree(spark, sf))


@query("rule_links", "select page_id, href from (select page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) as href from pages) where not regexp_matches(href, '^(http|mailto:|#|javascript:)')")
def rule_links(spark, sf):
    existing = spark.createDataFrame([], "path string")
    return dom.broken_links(_tree(spark, sf), existing).select("page_id", F.col("actual").alias("href"))


@query("rule_placeholder", "select page_id, 'TODO' as actual from pages where page_id % 4 = 0")
def rule_placeholder(spark, sf):
    return dom.placeholders(dom.visible_text(_tree(spark, sf, _DIRT))).select("page_id", "actual")


@query("rule_garbled", "select page_id, 'Garbled / Encoding Error' as category from pages where page_id % 4 = 1")
def rule_garbled(spark, sf):
    return dom.garbled(dom.visible_text(_tree(spark, sf, _DIRT))).select("page_id", "category")


@query("rule_title", "select page_id from pages where regexp_extract(html, '<title>([^<]*)', 1) <> concat(case when page_id % 5 = 0 then 'X ' else '' end, regexp_extract(html, '<h1>([^<]*)', 1))")
def rule_title(spark, sf):
    tree = _tree(spark, sf, "if(page_id % 5 = 0, replace(html, '<h1>', '<h1>X '), html)")
    title, heading = (dom.first_text(tree, t) for t in ("title", "h1"))
    both = title.join(heading.withColumnRenamed("text", "heading"), "page_id")
    return both.where(tx.norm_text(F.col("text")) != tx.norm_text(F.col("heading"))).select("page_id")


# ---- rich text, paths, state


@query("rtf_codepage", "select doc_id, case when doc_id % 4 = 0 then 'cp1256' when doc_id % 4 = 1 then 'cp1256' when doc_id % 4 = 2 then 'cp1250' else 'cp1252' end as codepage from documents")
def rtf_codepage(spark, sf):
    raw = F.expr("case doc_id % 4 when 0 then r'{\\rtf1\\ansicpg1252\\lang1065 x}' when 2 then r'{\\rtf1\\ansicpg1250 x}' else r'{\\rtf1 x}' end")
    path = F.expr("if(doc_id % 4 = 1, concat('d', doc_id, '_UR.rtf'), concat('d', doc_id, '.rtf'))")
    return read(spark, sf, "documents").select("doc_id", rtf.codepage(raw, path).alias("codepage"))


@query("rtf_image_refs", "select doc_id, i as position, concat('img', cast(doc_id as varchar), '_', cast(i as varchar), '.png') as ref from documents, (values (0), (1)) v(i)")
def rtf_image_refs(spark, sf):
    raw = F.expr("concat('{INCLUDEPICTURE \"img', doc_id, '_0.png\" x}{ includepicture img', doc_id, '_1.png}')")
    return read(spark, sf, "documents").select("doc_id", F.posexplode(rtf.image_references(raw)).alias("position", "ref"))


@query("files_relpath", "select doc_id, concat('a/', cast(doc_id as varchar), '.pdf') as path from documents")
def files_relpath(spark, sf):
    raw = F.expr("concat('/../', if(doc_id % 2 = 0, '__MACOSX/', './'), 'a/', doc_id, '.pdf')")
    return read(spark, sf, "documents").select("doc_id", packages.safe_relpath(raw).alias("path"))


@query("status_latest", "select user_id, max_by(event_type, row(ts, event_id)) as status from events group by user_id")
def status_latest(spark, sf):
    return state.latest_status(read(spark, sf, "events").withColumnRenamed("event_type", "status"), "user_id")


@query("token_validity", "select event_id, event_id % 4 = 0 and ts + interval 72 hours >= timestamp '2024-01-15 00:00:00' as valid from events where event_type = 'signup'")
def token_validity(spark, sf):
    signups = read(spark, sf, "events").where("event_type = 'signup'")
    status = F.when(F.col("event_id") % 4 == 0, "pending").otherwise("used")
    return signups.select("event_id", state.is_valid(status, F.expr("ts + interval 72 hours"), F.expr("timestamp_ntz '2024-01-15 00:00:00'")).alias("valid"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
