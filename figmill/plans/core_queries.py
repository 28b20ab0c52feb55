"""Queries of the general problems: changed records and dangling references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.operators import changes, references
from figmill.plans.lineage import stage_path
from figmill.sources.tables import table


def _changed(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's second run: the first takes what the last successful run had covered."""
    articles = table(spark, d, "articles")
    limit = changes.last_success(table(spark, d, "run_log"))
    ledger = changes.IntervalLedger(spark, stage_path(spark, "ledger"))
    # one row by construction (a global aggregate), hence a bounded broadcast
    ledger.run(articles.join(F.broadcast(limit), F.col("received_at") <= F.col("limit"), "left_semi"), "row_no", changes.article_changes, states=True)
    return ledger.output(ledger.run(articles, "row_no", changes.article_changes, states=True))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _changed(spark, d).select("pmcid")


def p3_changes(spark: SparkSession, d: str) -> DataFrame:
    return _changed(spark, d)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(table(spark, d, "figures"), table(spark, d, "articles"), table(spark, d, "package_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_field", "row_no")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, d)).withColumn("period", F.date_format("period", "yyyy-MM"))


QUERIES = {"p3_found": p3_found, "p3_changes": p3_changes, "p7_found": p7_found, "p7_report": p7_report}

#: The instant of an articles row in DuckDB: six spellings of an ISO time, UTC where no zone is given.
_INSTANT = """coalesce(try_cast(case
      when regexp_matches(trim(updated_at), '^\\d{8}T\\d{6}Z$') then regexp_replace(trim(updated_at), '^(\\d{4})(\\d{2})(\\d{2})T(\\d{2})(\\d{2})(\\d{2})Z$', '\\1-\\2-\\3 \\4:\\5:\\6+00:00')
      when regexp_matches(trim(updated_at), '(Z|[+-]\\d{2}:\\d{2})$') then replace(trim(updated_at), 'Z', '+00:00')
      else trim(updated_at) || '+00:00' end as timestamptz), (received_at::varchar || '+00:00')::timestamptz)"""

_ROWS = f"""rows as (select row_no, nullif(regexp_replace(pmcid, '[^0-9]', '', 'g'), '') as digits, {_INSTANT} as inst,
      upper(trim(status)) as status, coalesce(attempts, 0)::int as attempts, received_at from articles)"""

_P3 = f"""with lim as (select max(cutoff_at) as l from run_log where lower(trim(outcome)) = 'ok'), {_ROWS},
  marked as (select rows.*, coalesce(received_at <= (select l from lim), false) as covered from rows where digits is not null),
  now as (select *, row_number() over (partition by digits order by inst desc, row_no) as rn from marked),
  was as (select *, row_number() over (partition by digits order by inst desc, row_no) as rn from marked where covered)
  select 'PMC' || n.digits as pmcid, w.digits is null as is_new, w.status as status_before, w.attempts as attempts_before, n.status as status, n.attempts as attempts
  from (select * from now where rn = 1) n left join (select * from was where rn = 1) w on n.digits = w.digits
  where w.digits is null or n.status is distinct from w.status or n.attempts is distinct from w.attempts"""


def _path_sql(col: str) -> str:
    p = f"lower(trim(url_decode({col})))"
    p = f"regexp_replace({p}, '[\\\\/]+', '/', 'g')"
    p = f"regexp_replace({p}, '^(\\.?/)+', '')"
    digits = "regexp_replace(pmcid, '[^0-9]', '', 'g')"
    return f"nullif(trim(case when regexp_extract({p}, '^(?:pmc)?\\s*([0-9]+)/', 1) = {digits} and {digits} <> '' then regexp_replace({p}, '^[^/]*/', '') else {p} end), '')"


_P7 = f"""with {_ROWS},
  live as (select digits from (select digits, status, row_number() over (partition by digits order by inst desc, row_no) as rn from rows where digits is not null) where rn = 1 and status is distinct from 'REMOVED'),
  m as (select distinct a, p, regexp_replace(p, '^.*/', '') as b, regexp_replace(regexp_replace(p, '^.*/', ''), '(.)\\.[^./]+$', '\\1') as s
    from (select nullif(regexp_replace(pmcid, '[^0-9]', '', 'g'), '') as a, {_path_sql('member_path')} as p from package_files where deleted_at is null) where a is not null and p is not null),
  f as (select row_no, received_at, nullif(regexp_replace(pmcid, '[^0-9]', '', 'g'), '') as a, {_path_sql('href')} as h, {_path_sql('file_path')} as p from figures),
  g as (select *, regexp_replace(h, '^.*/', '') as hb from f where a is not null),
  found as (
    select 'pmcid' as ref_field, row_no, received_at from g where a not in (select digits from live)
    union all select 'file_path', row_no, received_at from g where p is not null and not exists (select 1 from m where m.a = g.a and m.p = g.p)
    union all select 'href', row_no, received_at from g where h is not null and not exists (select 1 from m where m.a = g.a and m.b = g.hb)
      and (regexp_matches(hb, '[^/]\\.[^./]+$') or not exists (select 1 from m where m.a = g.a and m.s = g.hb)))"""

ORACLE = {
    "p3_found": f"select pmcid from ({_P3})",
    "p3_changes": _P3,
    "p7_found": f"{_P7} select ref_field, row_no from found",
    "p7_report": f"{_P7} select ref_field, strftime(received_at, '%Y-%m') as period, count(*) as orphans from found group by 1, 2",
}
