"""Queries for accounts, state, and what reports and other outputs show."""

from __future__ import annotations

from pyspark.sql import functions as F

from galleyproof.functions import accounts
from galleyproof.operators import classify, pairing, rollup, state
from galleyproof.plans.fixtures import fx, with_views
from galleyproof.plans.registry import quoted, query, read
from galleyproof.sinks import report, tables

_AS_OF = "2024-01-15 00:00:00"
_NOW = f"timestamp '{_AS_OF}'"
_SPARK_NOW = f"timestamp_ntz '{_AS_OF}'"

# ---- accounts


@query("account_rules", "select c_custkey, c_custkey % 2 = 0 as email_ok, c_custkey % 3 <> 0 as name_ok, case c_custkey % 5 when 0 then 'Password must be at least 10 characters.' when 1 then 'Password must not contain spaces.' when 2 then 'Password must include at least one number.' when 3 then 'Password must not contain your username.' end as fault from customer")
def account_rules(spark, sf):
    c = read(spark, sf, "customer").selectExpr("c_custkey", "concat('A', c_custkey, if(c_custkey % 2 = 0, '@b.org', '@b')) as email", "concat('u', c_custkey, if(c_custkey % 3 = 0, ' x', '_x')) as name", "case c_custkey % 5 when 0 then 'Short1!' when 1 then 'Long enough 1!' when 2 then 'LongEnough!!' when 3 then concat('Long1!U', c_custkey, if(c_custkey % 3 = 0, ' x', '_x')) else 'LongEnough1!' end as password")
    c = c.withColumn("password", F.when(F.col("c_custkey") % 5 == 3, F.concat(F.lit("Long1!Uname"), F.lit("x"))).otherwise(F.col("password"))).withColumn("user", F.when(F.col("c_custkey") % 5 == 3, "unamex").otherwise("nobody"))
    return c.select("c_custkey", accounts.valid_email(F.col("email")).alias("email_ok"), accounts.valid_username(F.col("name")).alias("name_ok"), accounts.password_fault(F.col("password"), F.col("user")).alias("fault"))


@query("account_token_hash", "select c_custkey, sha256(c_name) as h from customer")
def account_token_hash(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", accounts.token_hash(F.col("c_name")).alias("h"))


@query("user_login", with_views("select id, username from fx_users where (lower(username) = 'customer#000000002' or lower(email) = 'customer#000000002') and status = 'active'", "fx_users"))
def user_login(spark, sf):
    return state.find_login(*fx(spark, sf, "fx_users"), " CUSTOMER#000000002 ").select("id", "username")


@query(
    "admin_sync",
    with_views(
        """select u.id, case when u.id = k.id then 'customer#000000005@example.org' when u.email = 'customer#000000005@example.org' or u.username = 'customer#000000003' then 'disabled_' || cast(u.id as varchar) || '_' || u.email else u.email end as email,
        case when u.id = k.id then 'customer#000000003' when u.email = 'customer#000000005@example.org' or u.username = 'customer#000000003' then 'disabled_' || cast(u.id as varchar) || '_' || u.username else u.username end as username, case when u.id = k.id then 'admin' when role = 'admin' then 'user' else role end as role, case when u.id = k.id then 'active' else status end as status from fx_users u, (select min(id) as id from fx_users where email = 'customer#000000005@example.org' or username = 'customer#000000003') k""",
        "fx_users",
    ),
)
def admin_sync(spark, sf):
    return state.sync_admin(*fx(spark, sf, "fx_users"), "Customer#000000005@example.org", "customer#000000003").select("id", "email", "username", "role", "status")


@query("users_create", with_views("select 'new' || cast(id as varchar) || '@example.org' as email, 'new' || cast(id as varchar) as username, 'user' as role, 'active' as status from fx_users where id % 2 = 1", "fx_users"))
def users_create(spark, sf):
    (users,) = fx(spark, sf, "fx_users")
    return state.create_users(users, users.selectExpr("if(id % 2 = 1, concat('NEW', id, '@example.org'), email) as email", "concat(' new', id) as username"))


@query("invites_list", with_views("select i.id, i.status, u.username as invited_by from fx_invites i left join fx_users u on u.id = i.created_by order by created_at desc, i.id desc limit 200", "fx_invites", "fx_users"))
def invites_list(spark, sf):
    found = state.with_inviter(*fx(spark, sf, "fx_invites", "fx_users"))
    return rollup.newest(found, "created_at", "id", 200).select("id", "status", "invited_by")


@query("resets_list", with_views("select r.id, u.username as current_username, u.status as user_status from fx_resets r left join fx_users u on u.id = r.user_id where r.status = 'requested' order by requested_at desc, r.id desc limit 200", "fx_resets", "fx_users"))
def resets_list(spark, sf):
    resets, users = fx(spark, sf, "fx_resets", "fx_users")
    found = state.with_account(resets.where("status = 'requested'"), users)
    return rollup.newest(found, "requested_at", "id", 200).select("id", "current_username", "user_status")


@query("invite_reason", with_views(f"select id, case when status <> 'pending' then 'Invite has already been used or cancelled.' when expires_at < {_NOW} then 'Invite link has expired.' else '' end as reason from fx_invites", "fx_invites"))
def invite_reason(spark, sf):
    (invites,) = fx(spark, sf, "fx_invites")
    return invites.select("id", state.invalid_reason("invite", F.col("status"), F.col("expires_at"), F.expr(_SPARK_NOW)).alias("reason"))


@query("reset_reason", with_views(f"select id, case when status <> 'link_generated' then 'Reset link has already been used or cancelled.' when expires_at is null or expires_at < {_NOW} then 'Reset link has expired. Ask your administrator for a new one.' else '' end as reason from fx_resets", "fx_resets"))
def reset_reason(spark, sf):
    (resets,) = fx(spark, sf, "fx_resets")
    return resets.select("id", state.invalid_reason("reset", F.col("status"), F.col("expires_at"), F.expr(_SPARK_NOW)).alias("reason"))


@query("reset_cancel", with_views("select id, case when status in ('requested', 'link_generated') then 'cancelled' else status end as status from fx_resets", "fx_resets"))
def reset_cancel(spark, sf):
    (resets,) = fx(spark, sf, "fx_resets")
    return resets.select("id", state.transition(F.col("status"), "cancelled").alias("status"))


_AT = "timestamp_ntz '2024-01-15 00:00:00'"


@query("invites_create", f"select 'c' || cast(c_custkey as varchar) || '@example.org' as email, 'user' as role, sha256(c_name) as token_hash, 'pending' as status, c_custkey as created_by, {_NOW} + interval 72 hours as expires_at from customer")
def invites_create(spark, sf):
    wanted = read(spark, sf, "customer").selectExpr("concat(' C', c_custkey, '@Example.org ') as email", "c_name as token", "c_custkey as created_by", f"{_AT} as at")
    return state.create_invites(wanted).select("email", "role", "token_hash", "status", "created_by", "expires_at")


def _links(table):
    """Links whose token is their id, and two uses of each: the second comes too late."""
    links = table.withColumn("token_hash", F.sha2(F.col("id").cast("string"), 256))
    use = "cast(id as string) as token", "concat(' New', id) as username"
    return links, links.selectExpr(*use, "'first' as password_hash", f"{_AT} as at").unionAll(links.selectExpr(*use, "'second' as password_hash", f"{_AT} + interval 1 hour as at"))


@query("invites_consume", with_views(f"select id, case when status = 'pending' and expires_at >= {_NOW} then 'used' else status end as status, case when status = 'pending' and expires_at >= {_NOW} then 'new' || cast(id as varchar) end as username, case when status = 'pending' and expires_at >= {_NOW} then 'first' end as password_hash from fx_invites", "fx_invites"))
def invites_consume(spark, sf):
    invites, uses = _links(fx(spark, sf, "fx_invites")[0])
    invites = invites.selectExpr("*", "cast(id as string) as email", "'user' as role")
    users, after = state.consume_invites(invites, uses)
    return after.join(users.selectExpr("cast(email as long) as id", "username", "password_hash"), "id", "left").select("id", "status", "username", "password_hash")


@query("resets_request", with_views("select id as user_id, username as username_snapshot, email as email_snapshot, 'requested' as status, '' as request_ip from fx_users where status = 'active'", "fx_users"))
def resets_request(spark, sf):
    (users,) = fx(spark, sf, "fx_users")
    requests = users.selectExpr("if(id % 2 = 0, upper(username), concat(' ', email, ' ')) as login", f"{_AT} as at", "cast(null as string) as ip").unionAll(spark.sql(f"select 'no such account', {_AT}, 'ip'"))
    return state.request_resets(users, requests).drop("requested_at")


@query("resets_links", with_views(f"select id, case when status in ('requested', 'link_generated') and id % 3 > 0 then 'link_generated' else status end as status, case when status in ('requested', 'link_generated') and id % 3 > 0 then {_NOW} + interval 2 hours else expires_at end as expires_at, case when status in ('requested', 'link_generated') and id % 3 > 0 then sha256(cast(id as varchar)) end as token_hash from fx_resets", "fx_resets"))
def resets_links(spark, sf):
    (resets,) = fx(spark, sf, "fx_resets")
    wanted = resets.where("id % 3 > 0").selectExpr("id", "cast(id as string) as token", "1L as admin_id", f"{_AT} as at")
    return state.generate_links(resets, wanted).select("id", "status", "expires_at", "token_hash")


_OPEN = f"status = 'link_generated' and expires_at >= {_NOW}"


@query("resets_consume", with_views(f"select u.id, case when u.id in (select user_id from fx_resets where {_OPEN}) then 'first' else 'old' end as password_hash, coalesce(n, 0) as used from fx_users u left join (select user_id, count(*) as n from fx_resets where {_OPEN} or status = 'used' group by user_id) r on r.user_id = u.id", "fx_users", "fx_resets"))
def resets_consume(spark, sf):
    users, resets = fx(spark, sf, "fx_users", "fx_resets")
    changes, after = state.consume_resets(*_links(resets))
    used = after.where("status = 'used'").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("used"))
    return state.update_users(users.withColumn("password_hash", F.lit("old")), changes).join(used, "id", "left").select("id", "password_hash", F.coalesce("used", F.lit(0)).alias("used"))


@query("users_update", with_views(f"select id, case id % 4 when 0 then 'active' when 1 then 'disabled' else status end as status, case id % 5 when 0 then 'admin' when 1 then 'user' else role end as role, case when id % 2 = 0 then {_NOW} end as last_login_at from fx_users", "fx_users"))
def users_update(spark, sf):
    (users,) = fx(spark, sf, "fx_users")
    changes = users.selectExpr("id", "case id % 4 when 0 then 'active' when 1 then 'gone' end as status", "case id % 5 when 0 then 'admin' when 1 then 'owner' end as role", f"if(id % 2 = 0, {_AT}, null) as last_login_at")
    return state.update_users(users, changes).select("id", "status", "role", "last_login_at")


@query("audit_actor", with_views("select event_id, coalesce(username, '') as actor from fx_audit a left join fx_users u on u.id = a.user_id", "fx_audit", "fx_users"))
def audit_actor(spark, sf):
    return state.with_actor(*fx(spark, sf, "fx_audit", "fx_users")).select("event_id", "actor")


_STEPS = "select user_id as pair_id, event_id, ts, case event_type when 'signup' then 'queued' when 'click' then 'running' when 'view' then 'running' when 'purchase' then 'done' else 'error' end as status from events"


@query("pair_state", f"with e as ({_STEPS}) select pair_id, max_by(status, row(ts, event_id)) as status, min(case when status = 'running' then event_id end) is not null as started, max(case when status in ('done', 'error') then ts end) as finished_at from e group by pair_id")
def pair_state(spark, sf):
    read(spark, sf, "events").createOrReplaceTempView("events")
    return state.pair_state(spark.sql(_STEPS)).select("pair_id", "status", F.col("started_at").isNotNull().alias("started"), "finished_at")


@query("first_admin", with_views("select id, username, role, status from fx_users where role = 'admin' order by id limit 1", "fx_users"))
def first_admin(spark, sf):
    return state.first_admin(*fx(spark, sf, "fx_users"))


# ---- reports

_CLASS = f"case when category in ({quoted(classify.CRITICAL)}) then 'Critical' when category in ({quoted(classify.MAJOR)}) then 'Major' when category in ({quoted(classify.MINOR)}) then 'Minor' when engine_severity = 'error' then 'Critical' when engine_severity = 'warning' then 'Major' else 'Minor' end"


@query(
    "report_plain",
    with_views(
        f"""select run_id as unique_id, case run_id % 4 when 0 then 'PDF ↔ HTML' when 1 then 'RTF ↔ HTML' when 2 then 'PDF ↔ WORD' else 'XML' end as validation_type, category, {_CLASS} as severity, coalesce(cast(nullif(line, 0) as varchar), '—') as location,
        row_number() over (partition by run_id order by case {_CLASS} when 'Critical' then 0 when 'Major' then 1 else 2 end, coalesce(line, 99999), category, cast(issue_id as varchar)) as position from fx_issues""",
        "fx_issues",
    ),
)
def report_plain(spark, sf):
    (issues,) = fx(spark, sf, "fx_issues")
    shown = classify.classify(issues).select(F.col("run_id").alias("unique_id"), "category", "severity", "line", F.lit(None).cast("string").alias("message"), F.col("issue_id").cast("string").alias("expected"), F.lit("").alias("actual"), F.lit("").alias("snippet"))
    files = issues.select(F.col("run_id").alias("unique_id")).distinct().select("unique_id", F.expr("case unique_id % 4 when 0 then 'pdf' when 1 then 'rtf' when 2 then 'pdf_word' else 'xml' end").alias("mode"), F.lit("s").alias("source_name"), F.lit("t").alias("target_name"), F.lit("English").alias("language"))
    return report.plain_report(files, shown).select("unique_id", "validation_type", "category", "severity", "location", "position")


_PAIRS = "select run_id, file_no, 's' as source_name, 't' as target_name, status, issue_count, critical_count, major_count, minor_count, case when file_no % 2 = 0 then 'French' end as language from fx_file_pairs"
_SUMMARY = f"select run_id, file_no, 's' || chr(10) || '→ t' as file_pair, case when status = 'done' and issue_count = 0 then 'Passed' when status = 'done' then 'Failed' else status end as status, case when critical_count >= 1 or major_count >= 5 then 'Critical' when major_count >= 1 or minor_count >= 8 then 'Major' when minor_count >= 1 then 'Minor' else 'Passed' end as file_severity, issue_count, critical_count, major_count, minor_count, coalesce(language, '—') as language from ({_PAIRS})"


def _named_pairs(spark, sf):
    (pairs,) = fx(spark, sf, "fx_file_pairs")
    return pairs.select("run_id", "file_no", F.lit("s").alias("source_name"), F.lit("t").alias("target_name"), "status", "issue_count", "critical_count", "major_count", "minor_count", F.expr("if(file_no % 2 = 0, 'French', null)").alias("language"))


@query("report_files", with_views(_SUMMARY, "fx_file_pairs"))
def report_files(spark, sf):
    return report.file_summary(_named_pairs(spark, sf))


@query(
    "report_overview",
    with_views(
        f"""select run_id, label, cast(value as bigint) as value from (select run_id, count(*) as "Total Files", count(*) filter (issue_count = 0 and status = 'Passed') as "Passed Files", count(*) filter (issue_count > 0 or status = 'Failed') as "Failed Files", cast(sum(issue_count) as bigint) as "Total Errors", cast(sum(critical_count) as bigint) as "Critical Errors", cast(sum(major_count) as bigint) as "Major Errors", cast(sum(minor_count) as bigint) as "Minor Errors",
        count(*) filter (file_severity = 'Critical') as "Critical Files", count(*) filter (file_severity = 'Major') as "Major Files", count(*) filter (file_severity = 'Minor') as "Minor Files", count(*) filter (file_severity = 'Passed') as "Files of Severity Passed" from ({_SUMMARY}) group by run_id) unpivot (value for label in (columns(* exclude run_id)))""",
        "fx_file_pairs",
    ),
)
def report_overview(spark, sf):
    return report.overview(report.file_summary(_named_pairs(spark, sf)))


@query(
    "report_details",
    with_views(
        f"""select run_id, file_no, row_number() over (partition by run_id, file_no order by case severity when 'Critical' then 0 when 'Major' then 1 else 2 end, coalesce(line, 999999), category, issue_id) as position, category, severity, coalesce(cast(line as varchar), '—') as location, '—' as message, 'e' as expected, 'm' as context from (select *, {_CLASS} as severity from fx_issues)""",
        "fx_issues",
    ),
)
def report_details(spark, sf):
    (issues,) = fx(spark, sf, "fx_issues")
    full = classify.classify(issues).withColumns({"message": F.lit(""), "expected": F.lit("e"), "actual": F.lit(None).cast("string"), "snippet": F.lit("m")})
    return report.error_details(full).select("run_id", "file_no", "position", "category", "severity", "location", "message", "expected", "context")


@query("stored_results", with_views("select p.run_id, p.file_no, case when p.status = 'done' and issue_count = 0 then 'Passed' when p.status = 'done' then 'Failed' else p.status end as result, coalesce(n, -1) as n from fx_file_pairs p left join (select run_id, file_no, count(*) as n from fx_issues group by run_id, file_no) i on i.run_id = p.run_id and i.file_no = p.file_no", "fx_file_pairs", "fx_issues"))
def stored_results(spark, sf):
    found = rollup.stored_results(*fx(spark, sf, "fx_file_pairs", "fx_issues"))
    return found.select("run_id", "file_no", "result", F.coalesce(F.size("issues"), F.lit(-1)).cast("long").alias("n"))


@query("qa_ids", with_views("select run_id, file_no, 'QA-' || lpad(cast(row_number() over (partition by run_id order by file_no) as varchar), 4, '0') as qa_id from fx_file_pairs", "fx_file_pairs"))
def qa_ids(spark, sf):
    return rollup.numbered(fx(spark, sf, "fx_file_pairs")[0], "file_no").select("run_id", "file_no", "qa_id")


# ---- other outputs


@query("issues_replace", with_views("select run_id, file_no, issue_id from fx_issues where file_no <> 1 union all select run_id, 1, -run_id from fx_runs where run_id % 2 = 0", "fx_issues", "fx_runs"))
def issues_replace(spark, sf):
    issues, runs = fx(spark, sf, "fx_issues", "fx_runs")
    fresh = runs.where("run_id % 2 = 0").selectExpr("run_id", "1L as file_no", "-run_id as issue_id")
    return tables.replace_issues(issues, fresh, runs.selectExpr("run_id", "1L as file_no")).select("run_id", "file_no", "issue_id")


@query("list_pairs", with_views("select file_no, 'p' || cast(a.file_id as varchar) as pair_id, cast(a.file_id as varchar) as source_file, cast(b.file_id as varchar) as html_file, 'matched' as status from (select *, row_number() over (partition by key order by file_id) as file_no from fx_source) a join (select *, row_number() over (partition by key order by file_id) as file_no from fx_target) b using (key, file_no)", "fx_source", "fx_target"))
def list_pairs(spark, sf):
    pairs = pairing.pair_files(*fx(spark, sf, "fx_source", "fx_target")).selectExpr("position as file_no", "concat('p', source_id) as pair_id", "cast(source_id as string) as source_name", "cast(target_id as string) as target_name")
    return tables.pairs_list(pairs)


@query("list_unmatched", with_views("select 'unmatched' as type, case when a.key is null then 'Target' else 'Source' end as side, cast(coalesce(a.file_id, b.file_id) as varchar) as filename, case when a.key is null then 'No corresponding source file found' else 'No corresponding target file found' end as reason from (select *, row_number() over (partition by key order by file_id) as n from fx_source) a full join (select *, row_number() over (partition by key order by file_id) as n from fx_target) b on a.key = b.key and a.n = b.n where a.key is null or b.key is null", "fx_source", "fx_target"))
def list_unmatched(spark, sf):
    left = pairing.unmatched_files(*fx(spark, sf, "fx_source", "fx_target"))
    return tables.unmatched_list(left.select("side", F.col("file_id").cast("string").alias("filename")))


@query("run_manifest", with_views("select r.run_id, r.status, coalesce(n, 0) as n, first_status from fx_runs r left join (select run_id, count(*) as n, min_by(status, file_no) as first_status from fx_file_pairs group by run_id) p using (run_id)", "fx_runs", "fx_file_pairs"))
def run_manifest(spark, sf):
    runs, pairs = fx(spark, sf, "fx_runs", "fx_file_pairs")
    m = tables.manifests(runs, pairs.select("run_id", "file_no", "status"))
    pair = "array<struct<file_no:bigint,status:string>>"
    parsed = m.select(F.from_json("manifest", f"struct<run:struct<run_id:bigint,status:string>,file_pairs:{pair}>").alias("m"))
    return parsed.select("m.run.run_id", "m.run.status", F.size("m.file_pairs").cast("long").alias("n"), F.get("m.file_pairs", F.lit(0))["status"].alias("first_status"))


@query("batch_next", "select cast(max(p_partkey % 1000) + 1 as bigint) as number from part")
def batch_next(spark, sf):
    return tables.next_batch(read(spark, sf, "part").select(F.concat(F.lit("BATCH_"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.lit("_x")).alias("name")))


@query("batch_names", "select event_id, 'BATCH_' || lpad(cast(event_id % 900 as varchar), 3, '0') || '_' || strftime(ts, '%Y-%m-%d_%H-%M-%S') || '_My_Batch' as name, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] m' as line from events")
def batch_names(spark, sf):
    return read(spark, sf, "events").select("event_id", tables.batch_name(F.col("event_id") % 900, F.col("ts"), F.lit(" My  Batch!.zip")).alias("name"), tables.log_line(F.col("ts"), F.lit("m")).alias("line"))


_UPLOADS = "select s_suppkey as upload_id, k as position, case when k = s_suppkey % 4 then 'my RTF pack.zip' when k = s_suppkey % 3 then 'html_out.ZIP' else 'doc' || cast(k as varchar(3)) || '.rtf' end as name from supplier, (values (0), (1), (2)) v(k)"


@query("upload_packages", f"with u as ({_UPLOADS}) select upload_id, case when upload_id % 4 < 3 then 'my RTF pack.zip' else 'html_out.ZIP' end as source, case when upload_id % 4 = upload_id % 3 then '' else 'html_out.ZIP' end as target from (select distinct upload_id from u)")
def upload_packages(spark, sf):
    read(spark, sf, "supplier").createOrReplaceTempView("supplier")
    files = spark.sql(_UPLOADS)
    return tables.source_package(files, "rtf").withColumnRenamed("name", "source").join(tables.target_package(files).withColumnRenamed("name", "target"), "upload_id")
