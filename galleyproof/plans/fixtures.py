"""Views of the sample tables in the shape of this engine's data model, as SQL for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

CATEGORIES = (
    "Changed Text", "Missing Text", "Extra Text", "Punctuation Mismatch", "Missing Punctuation", "Extra Punctuation", "Title Mismatch", "Missing Title", "Filename Mismatch", "Missing Language Attribute",
    "Missing RTL Direction", "Unexpected Closing Tag", "Tag Nesting Mismatch", "Missing Strong/Bold Tag", "Heading Level Mismatch", "Broken Image", "Image Order Mismatch", "Garbled / Encoding Error", "Leftover Placeholder", "Broken Link",
)
_VALUES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES))

FX = {
    "fx_users": "select c_custkey as id, lower(c_name) as username, concat(lower(c_name), '@example.org') as email, case when c_custkey = 1 then 'admin' else 'user' end as role, case when c_acctbal < 0 then 'disabled' else 'active' end as status from customer",
    "fx_runs": "select o_orderkey as run_id, o_custkey as user_id, case o_orderstatus when 'F' then 'done' when 'O' then 'running' else 'interrupted' end as status, o_orderdate as created_at, cast(floor(o_totalprice) as bigint) % 4 as critical_count from orders",
    "fx_file_pairs": """select l_orderkey as run_id,
        cast(row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as bigint) as file_no,
        case when l_linestatus = 'F' then 'done' when l_returnflag = 'N' then 'running' when l_returnflag = 'A' then 'error' else 'interrupted' end as status,
        cast(floor(l_quantity) as int) % 4 as issue_count, case when l_discount >= 0.08 then 1 else 0 end as critical_count,
        cast(floor(l_tax * 100 + 0.5) as int) % 4 as major_count, cast(floor(l_quantity) as int) % 7 as minor_count from lineitem""",
    "fx_issues": f"""select l_orderkey as run_id, 1 + (l_partkey + l_suppkey) % 3 as file_no, l_orderkey * 1000003 + l_partkey * 1009 + l_suppkey * 7 + l_linenumber as issue_id,
        c.category, case l_suppkey % 3 when 0 then 'error' when 1 then 'warning' else 'info' end as engine_severity, case when l_linenumber % 3 = 0 then null else l_linenumber end as line
        from lineitem join (select * from (values {_VALUES}) as v(k, category)) c on l_partkey % 20 = c.k""",
    "fx_audit": "select event_id, user_id, event_type as action, props as details, ts as created_at from events",
    "fx_invites": "select event_id as id, user_id as created_by, case event_id % 4 when 1 then 'used' when 2 then 'cancelled' else 'pending' end as status, ts as created_at, ts + interval 72 hours as expires_at from events where event_type = 'signup'",
    "fx_resets": "select event_id as id, user_id, case event_id % 4 when 0 then 'requested' when 1 then 'link_generated' when 2 then 'used' else 'cancelled' end as status, ts as requested_at, case when event_id % 4 in (1, 2) then ts + interval 2 hours end as expires_at from events where event_type = 'error'",
    "fx_files": """select doc_id as file_id, concat(case lang when 'en' then 'English' when 'de' then 'German' when 'fr' then 'French' else 'Spanish' end, '/', source, '/doc ', cast(doc_id as varchar(20)), '.',
        case doc_id % 6 when 0 then 'pdf' when 1 then 'RTF' when 2 then 'html' when 3 then 'docx' when 4 then 'png' else 'xml' end) as relpath from documents""",
    "fx_source": "select doc_id as file_id, concat(lang, cast(doc_id % 7 as varchar(2))) as key from documents where doc_id % 2 = 0",
    "fx_target": "select doc_id as file_id, concat(lang, cast(doc_id % 7 as varchar(2))) as key from documents where doc_id % 2 = 1 and doc_id % 3 > 0",
}


def fx(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The views ``names`` over the tables in ``sf_dir``."""
    out = []
    for name in names:
        text = FX[name]
        for table in TABLES:
            if f" {table}" in text:
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        out.append(spark.sql(text))
    return out


def with_views(sql: str, *names: str) -> str:
    """``sql`` with the views as common table expressions."""
    return "with " + ", ".join(f"{n} as ({FX[n]})" for n in names) + " " + sql
