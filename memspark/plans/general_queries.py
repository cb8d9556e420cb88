"""The queries of the general problems over the domain tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.functions.text import match_key, strip_ws
from memspark.operators.hierarchy import descendants, resolve_hierarchy
from memspark.operators.intervals import calendar_day, sweep_intervals
from memspark.operators.snapshots import snapshot_series_diff


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def decision_links(spark: SparkSession, d: str) -> DataFrame:
    """node, parent by title key, for links of which both ends have a row of their own."""
    silver, gold = table(spark, d, "silver_decisions"), table(spark, d, "gold_timeline_events")
    titles = silver.select(match_key("title").alias("t")).unionByName(gold.select(match_key("title").alias("t"))).where("t is not null").distinct()
    below = silver.select(match_key("title").alias("parent"), F.explode("supersedes").alias("x")).select(match_key("x").alias("node"), "parent")
    above = gold.select(match_key("title").alias("node"), F.explode("superseded_by").alias("x")).select("node", match_key("x").alias("parent"))
    links = below.unionByName(above).where("node is not null and parent is not null").distinct()
    return links.join(titles.withColumnRenamed("t", "node"), "node", "left_semi").join(titles.withColumnRenamed("t", "parent"), "parent", "left_semi")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return resolve_hierarchy(decision_links(spark, d), paths=False).select(F.col("node").alias("title_key"), F.coalesce("root", F.lit("")).alias("root_key"), "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    nodes = resolve_hierarchy(decision_links(spark, d))
    below = descendants(nodes).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_descendants"))
    return nodes.join(below, "node", "left").select(F.col("node").alias("title_key"), F.coalesce(F.array_join("path", " > "), F.lit("")).alias("path"), "status", F.coalesce("n_descendants", F.lit(0).cast("long")).alias("n_descendants"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(resolve_hierarchy(decision_links(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "gold_timeline_events")
    row = F.struct("project", "valid_from", "valid_to")
    latest = events.where("id is not null").groupBy("id").agg(F.max_by(row, F.struct("recorded_at", row)).alias("r")).select("r.*")
    rows = latest.unionByName(events.where("id is null").select("project", "valid_from", "valid_to"))  # a row without id is its own event
    days = rows.select(
        F.lower(strip_ws("project")).alias("project_key"),
        calendar_day("valid_from").alias("s"),
        F.when(F.coalesce(strip_ws("valid_to"), F.lit("")) == "", F.lit("9999-12-31").cast("date")).otherwise(calendar_day("valid_to")).alias("e"),
    ).where("project_key <> ''")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return sweep_intervals(days, ["project_key"], "s", "e").select("project_key", "kind", day("start").alias("from_date"), day("end").alias("to_date"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_series_diff(table(spark, d, "connector_snapshots"), ["corpus_id", "connector"], "snapshot_no", "source_id", "content_hash", "loaded_at")


QUERIES = {"p1_found": p1_found, "p1_paths": p1_paths, "p1_descendants": p1_descendants, "p2_found": p2_found, "p4_found": p4_found}

_KEY = r"replace(lower(trim(regexp_replace({}, '\s+', ' ', 'g'))), 'ß', 'ss')"
_LINKS = f"""titles as (select {_KEY.format("title")} as t from silver_decisions union select {_KEY.format("title")} from gold_timeline_events),
raw as (select {_KEY.format("title")} as parent, {_KEY.format("u.x")} as node from silver_decisions, unnest(supersedes) as u(x)
  union select {_KEY.format("u.x")}, {_KEY.format("title")} from gold_timeline_events, unnest(superseded_by) as u(x)),
links as (select distinct node, parent from raw where node in (select t from titles where t <> '') and parent in (select t from titles where t <> '')),
down as (select distinct parent as node, parent as root, cast(0 as bigint) as depth, [parent] as path from links where parent not in (select node from links)
  union all select l.node, d.root, d.depth + 1, list_append(d.path, l.node) from links l join down d on l.parent = d.node),
lost as (select node, parent from links where node not in (select node from down)),
up as (select node as start, parent as cur from lost union select u.start, l.parent from up u join lost l on l.node = u.cur),
nodes as (select node, root, depth, path from down
  union all select node, null, case when node in (select start from up where start = cur) then -1 else -2 end, null from lost)"""

ORACLE = {
    "p1_found": f"with recursive {_LINKS} select node as title_key, coalesce(root, '') as root_key, cast(depth as bigint) as depth from nodes",
    "p1_paths": f"""with recursive {_LINKS}, pairs as (select u.a as ancestor, count(*) as n from nodes, unnest(path) as u(a) where u.a <> node group by 1)
select node as title_key, coalesce(array_to_string(path, ' > '), '') as path, case depth when -1 then 'cycle' when -2 then 'below_cycle' else 'tree' end as status,
  cast(coalesce(n, 0) as bigint) as n_descendants from nodes left join pairs on ancestor = node""",
    "p1_descendants": f"""with recursive {_LINKS} select path[i] as ancestor, node, cast(depth + 1 - i as bigint) as distance
from (select node, path, depth, unnest(range(1, depth + 1)) as i from nodes where depth > 0)""",
    "p2_found": r"""with latest as (select * from gold_timeline_events where id is not null qualify row_number() over (partition by id order by recorded_at desc, project desc, valid_from desc, valid_to desc) = 1),
d as (select lower(regexp_replace(project, '^\s+|\s+$', '', 'g')) as p,
  regexp_replace(trim(valid_from), '^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})([T ].*)?$', '\1-\2-\3') as f, regexp_replace(trim(valid_to), '^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})([T ].*)?$', '\1-\2-\3') as t from latest),
i as (select p, try_cast(f as date) as s, case when coalesce(t, '') = '' then date '9999-12-31' else try_cast(t as date) end as e from d where p <> ''),
v as (select distinct p, s, e from i where s < e),
m as (select *, max(e) over (partition by p order by s, e rows between unbounded preceding and 1 preceding) as before from v),
g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by p order by s, e) as n from m),
per as (select p, n, min(s) as s, max(e) as e from g group by 1, 2)
select p as project_key, 'period' as kind, strftime(s, '%Y-%m-%d') as from_date, strftime(e, '%Y-%m-%d') as to_date from per
union all select p, 'gap', strftime(e, '%Y-%m-%d'), strftime(nx, '%Y-%m-%d') from (select *, lead(s) over (partition by p order by n) as nx from per) where nx is not null""",
    "p4_found": r"""with r as (select corpus_id, connector, snapshot_no as no, regexp_replace(source_id, '^\s+|\s+$', '', 'g') as item, regexp_replace(lower(content_hash), '^[a-z0-9]+:', '') as h, loaded_at from connector_snapshots),
o as (select * from r qualify row_number() over (partition by corpus_id, connector, no, item order by loaded_at desc, h desc nulls last) = 1),
l as (select corpus_id, connector, no, row_number() over (partition by corpus_id, connector order by no) as idx, lead(no) over (partition by corpus_id, connector order by no) as nx, count(*) over (partition by corpus_id, connector) as n from (select distinct corpus_id, connector, no from r)),
x as (select o.*, l.idx, l.nx, l.n, lag(idx) over w as pi, lead(idx) over w as ni from o join l using (corpus_id, connector, no) window w as (partition by corpus_id, connector, item order by no)),
y as (select *, sum(case when pi is null or idx - pi > 1 then 1 else 0 end) over (partition by corpus_id, connector, item order by no) as run from x),
z as (select *, last_value(h ignore nulls) over (partition by corpus_id, connector, item, run order by no rows between unbounded preceding and 1 preceding) as ph from y)
select corpus_id, connector, cast(no as bigint) as snapshot_no, item as source_id, 'added' as change from z where idx > 1 and (pi is null or idx - pi > 1)
union all select corpus_id, connector, cast(no as bigint), item, 'changed' from z where idx > 1 and pi is not null and idx - pi = 1 and h <> ph
union all select corpus_id, connector, cast(nx as bigint), item, 'removed' from z where nx is not null and (ni is null or ni - idx > 1)""",
}
