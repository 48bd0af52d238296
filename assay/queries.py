"""Named queries of the engine over the driver's tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as fn
from .operators import evaluators as ev
from .operators import matching as m
from .operators import results as rs
from .plans import tracking as tr
from .sources import domain as d

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

VIEWS = {
    "runs": "select o_orderkey run_id, o_custkey experiment_id, case o_orderstatus when 'F' then 'SUCCESS' when 'O' then 'FAILED' else 'RUNNING' end status, o_orderdate started_at from orders",
    "evals": "select l_orderkey * 100 + l_linenumber item_id, l_orderkey run_id, l_linenumber::bigint item_idx, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 evaluator_idx, l_returnflag evaluator, l_discount * 10 score, l_discount * 10 >= 0.5 success from lineitem",
    "verdicts": "select item_id, run_id, item_idx, bool_and(success) success from evals group by all",
    "counts": "select r.*, coalesce(total, 0) total, coalesce(passed, 0) passed from runs r left join (select run_id, count(*) total, count(*) filter (where success) passed from verdicts group by 1) v using (run_id)",
    "rep": "select (user_id % 5)::int run_index, event_id % 10 item_idx, event_id evaluator_idx, event_type evaluator, value score, case when event_id % 3 = 0 then 50.0 end threshold, value >= 50 success, case when event_id % 4 = 0 then '' else event_type end reason from events",
    "rep_items": "select run_index, item_idx, bool_and(success) success from rep group by all",
    "rep_runs": "select run_index, count(*) total, count(*) filter (where success) passed, floor(count(*) filter (where success)::double / count(*) * 1e6 + 0.5) / 1e6 pass_rate from rep_items group by 1",
    "rep_means": "select run_index, evaluator, floor(avg(score) * 1e6 + 0.5) / 1e6 average_score from rep group by all",
    "pairs": "select * from (select conv_id, turn, role, text input, lead(text) over w actual_output, lead(role) over w nxt from conversations window w as (partition by conv_id order by turn)) where role = 'user' and nxt = 'assistant'",
    "bags": "select c_custkey, list_value(c_mktsegment, c_name, lower(c_mktsegment), c_mktsegment) retrieved, list_value('BUILDING', 'MACHINERY', c_name) relevant from customer",
}


def sql(query: str, *views: str) -> str:
    """A statement over the named views and those that they need."""
    order = list(VIEWS)
    need = set(views)
    for v in reversed(order):
        if v in need:
            need |= {w for w in order if w != v and f" {w} " in f"{VIEWS[v]} "}
    parts = [f"{v} as ({VIEWS[v]})" for v in order if v in need]
    return (f"with {', '.join(parts)} " if parts else "") + query


def query(statement: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = sql(statement, *views)
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Counts as bigint, so that both engines name the same types."""
    return df.select(*(F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


R6 = "floor(({}) * 1e6 + 0.5) / 1e6"


# --- tracking


@query(f"select run_id, total, passed, total - passed failed, {R6.format('passed::double / total')} pass_rate from counts where total > 0", "counts")
def run_summary(spark, sf):
    items = rs.item_results(d.items(spark, sf), d.plain_evals(spark, sf), ["run_id", "item_idx"])
    return rs.run_summary(items, ["run_id"])


@query("select experiment_id, project_id, name, run_id, status, case when status <> 'RUNNING' and total > 0 then passed::double / total end pass_rate from (select c_custkey experiment_id, c_nationkey::bigint project_id, c_name as name from customer) e left join (select * from counts qualify row_number() over (partition by experiment_id order by started_at desc, run_id desc) = 1) using (experiment_id)", "counts")
def experiment_latest_run(spark, sf):
    return tr.list_experiments(d.store(spark, sf)).select("experiment_id", "project_id", "name", "run_id", "status", "pass_rate")


@query("select experiment_id, run_id, started_at, coalesce(passed::double / nullif(total, 0), 0.0) pass_rate from counts where status in ('SUCCESS', 'FAILED') qualify row_number() over (partition by experiment_id order by started_at desc, run_id desc) <= 20", "counts")
def experiment_trends(spark, sf):
    return tr.trends(d.store(spark, sf), 20).select("experiment_id", "run_id", "started_at", "pass_rate")


@query("select n_nationkey::bigint project_id, n_name as name, count(c_custkey) experiment_count from nation left join customer on n_nationkey = c_nationkey group by 1, 2")
def project_experiment_counts(spark, sf):
    return tr.list_projects(d.store(spark, sf)).select("project_id", "name", "experiment_count")


@query("select run_id, experiment_id, status, total, passed, passed::double / nullif(total, 0) pass_rate from counts", "counts")
def experiment_runs(spark, sf):
    return tr.list_runs(d.store(spark, sf)).select("run_id", "experiment_id", "status", "total", "passed", "pass_rate")


@query("select item_id, count(*) n_evals, count(*) filter (where success) n_passed from evals where run_id = (select max(run_id) from evals) group by 1 order by 1 limit 50", "evals")
def run_details_page(spark, sf):
    s = d.store(spark, sf)
    last = s.evals.agg(F.max("run_id")).first()[0]
    s.items = s.items.withColumn("created_at", F.col("item_id"))
    s.evals = s.evals.withColumns({"eval_id": F.col("score"), "threshold": F.lit(0.5), "reason": F.lit(None).cast("string")})
    page = tr.run_page(s, last)
    return page.select("item_id", F.size("evaluations").cast("bigint").alias("n_evals"), F.size(F.filter("evaluations", lambda e: e["success"])).cast("bigint").alias("n_passed"))


@query("select event_id::varchar item_id, value score, 1::bigint n from events where event_type = (select max(event_type) from events) order by ts, event_id::varchar offset 150 limit 50")
def run_page_seek(spark, sf):
    """The fourth page of the events of a type, as a run's items: four pages, each from the key that the one before it ended with, over bucketed tables."""
    import uuid

    from .plans import layout
    from .shared import Scratch

    rows = d.table(spark, sf, "events").select(F.col("event_type").alias("run_id"), F.col("event_id").cast("string").alias("item_id"), F.col("ts").alias("created_at"), F.col("value").alias("score"))
    folder, names = Scratch(spark, "pages").path, [f"assay_{k}_{uuid.uuid4().hex}" for k in ("items", "evals")]
    try:
        items = layout.write_by_run(rows.drop("score"), names[0], 16, f"{folder}/items")
        evals = layout.write_by_run(rows.select("run_id", "item_id", "score"), names[1], 16, f"{folder}/evals")
        s, last, key = tr.Store(None, None, None, items, evals), rows.agg(F.max("run_id")).first()[0], None
        for _ in range(4):
            page, key = layout.page_after(s, last, key)
        page = spark.createDataFrame(page.collect(), page.schema)
    finally:
        layout.drop(spark, *names)
    return page.select("item_id", F.col("evaluations")[0]["score"].alias("score"), F.size("evaluations").cast("long").alias("n"))


@query("select item_id, run_id, item_idx from verdicts where success", "verdicts")
def passed_items_semi_anti(spark, sf):
    return tr.passed_items(d.items(spark, sf), d.plain_evals(spark, sf)).select("item_id", "run_id", "item_idx")


@query("select i.o_orderkey run_id, coalesce(bool_and(success), true) core, coalesce(bool_and(success), false) tracked from orders i left join evals e on e.run_id = i.o_orderkey group by 1", "evals")
def core_vs_server_success(spark, sf):
    """The two meanings of success for something without evaluations."""
    runs, evals = d.runs(spark, sf).select("run_id"), d.plain_evals(spark, sf)
    core = rs.item_results(runs, evals, ["run_id"]).withColumnRenamed("success", "core")
    tracked = tr.passed_items(runs.withColumnRenamed("run_id", "item_id"), evals.select(F.col("run_id").alias("item_id"), "success"))
    return core.join(tracked.select(F.col("item_id").alias("run_id"), F.lit(True).alias("t")), "run_id", "left").select("run_id", "core", F.coalesce("t", F.lit(False)).alias("tracked"))


@query("select experiment_id, run_id, floor(pass_rate * 100 + 0.5)::bigint percent from (select *, coalesce(passed::double / nullif(total, 0), 0.0) pass_rate from counts where status in ('SUCCESS', 'FAILED') qualify row_number() over (partition by experiment_id order by started_at desc, run_id desc) <= 5) qualify count(*) over (partition by experiment_id) >= 2", "counts")
def trend_chart_points(spark, sf):
    return tr.chart_points(tr.trends(d.store(spark, sf), 5)).select("experiment_id", "run_id", F.col("percent").cast("bigint").alias("percent"))


@query("select p.n_name project, c_name experiment, run_id, status from runs r join customer c on c.c_custkey = r.experiment_id join nation p on p.n_nationkey = c.c_nationkey", "runs")
def run_context(spark, sf):
    s = d.store(spark, sf)
    names = s.experiments.select("experiment_id", "project_id", F.col("name").alias("experiment")).join(s.projects.select("project_id", F.col("name").alias("project")), "project_id")
    return s.runs.join(names, "experiment_id").select("project", "experiment", "run_id", "status")


@query("select distinct c_mktsegment as name from customer where c_mktsegment not in (select n_name from nation)")
def get_or_create_anti_join(spark, sf):
    return tr.new_projects(d.projects(spark, sf), d.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("name"))).select("name")


@query("select run_id, evaluator, score, success from (select l_orderkey run_id, l_returnflag evaluator, l_discount * 10 score, l_discount * 10 >= 0.5 success from lineitem where l_orderkey in (select o_orderkey from orders))")
def add_items_explode(spark, sf):
    """Reported batches of items, one per run, flattened to evaluation rows of known runs."""
    items, evals = tr.added_items(_payload(spark, sf), d.runs(spark, sf), call="once")
    return evals.join(items.select("run_id", "item_id"), ["run_id", "item_id"]).select("run_id", "evaluator", "score", "success")


@query("select o_orderkey run_id, 2 * count(l_orderkey) total, 2 * count(*) filter (where l_discount * 10 >= 0.5) passed from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def repeated_requests(spark, sf):
    """Every request is made twice: its items count twice, in runs that hold equal items too, and runs without items stay."""
    payload = _payload(spark, sf)
    runs = d.runs(spark, sf).select("run_id")
    items, evals = tr.added_items(payload.union(payload), runs, call="twice")
    return tr.run_counts(runs, items, evals, every=True).select("run_id", "total", "passed")


def _payload(spark, sf):
    rows = d.lines(spark, sf, "l_partkey", "l_suppkey", "l_discount", "l_returnflag")
    e = F.struct(F.col("l_returnflag").alias("name"), (F.col("l_discount") * 10).alias("score"), F.lit(0.5).alias("threshold"), (F.col("l_discount") * 10 >= 0.5).alias("success"), F.lit("").alias("reason"))
    item = F.struct(F.create_map(F.lit("input"), F.col("l_partkey").cast("string")).alias("inputs"), F.create_map().cast("map<string,string>").alias("expectedOutputs"), F.create_map(F.lit("output"), F.col("l_suppkey").cast("string")).alias("actualOutputs"), F.array(e).alias("evalResults"))
    kind = "struct<inputs:map<string,string>,expectedOutputs:map<string,string>,actualOutputs:map<string,string>,evalResults:array<struct<name:string,score:double,threshold:double,success:boolean,reason:string>>>"
    lists = rows.select(F.col("l_orderkey").alias("run_id"), F.to_json(item).alias("item")).groupBy("run_id").agg(F.sort_array(F.collect_list("item")).alias("items"))  # in an order that holds when they are read again
    return lists.select("run_id", F.transform("items", lambda i: F.from_json(i, kind)).alias("items"))


@query("select item_id, run_id, max(score) filter (where evaluator = 'A' and nth = 1) a_score, max(score) filter (where evaluator = 'N' and nth = 1) n_score, max(score) filter (where evaluator = 'R' and nth = 1) r_score from (select *, row_number() over (partition by item_id, evaluator order by evaluator_idx) nth from evals) group by all", "evals")
def run_table_pivot(spark, sf):
    s = d.store(spark, sf)
    s.evals = d.evals(spark, sf).withColumnRenamed("evaluator_idx", "eval_id")
    s.items = s.items.withColumn("input", F.lit(None).cast("string"))
    return tr.run_table(s, None, ["R", "A", "N"]).select("item_id", "run_id", F.col("A_score").alias("a_score"), F.col("N_score").alias("n_score"), F.col("R_score").alias("r_score"))


# --- aggregates


@query(f"select run_id, evaluator, {R6.format('avg(score)')} average_score from evals group by all", "evals")
def run_average_score(spark, sf):
    evals = d.plain_evals(spark, sf)
    return evals.groupBy("run_id", "evaluator").agg(fn.r6(F.avg("score")).alias("average_score"))


@query("select run_index, evaluator, coalesce(average_score, 0.0) average_score from (select * from (select unnest(range(6))::int run_index) cross join (select distinct evaluator from rep)) left join rep_means using (run_index, evaluator)", "rep_means", "rep")
def run_average_grid(spark, sf):
    """Six runs of which the last has no evaluations: its means are 0."""
    runs = spark.range(6).select(F.col("id").cast("int").alias("run_index"))
    return rs.run_averages(d.repeated(spark, sf), runs, ["run_index"])


@query(f"select evaluator, {R6.format('avg(average_score)')} average_score, {R6.format('coalesce(stddev_samp(average_score), 0)')} std_dev, count(*) runs from rep_means group by 1", "rep_means", "rep")
def experiment_average_score(spark, sf):
    evals = d.repeated(spark, sf)
    return rs.experiment_averages(rs.run_averages(evals, evals.select("run_index").distinct(), ["run_index"]), [])


@query(f"select coalesce(max(total) filter (where run_index = 0), 0) total, {R6.format('avg(passed)')} passed, {R6.format('coalesce(max(total) filter (where run_index = 0), 0) - ' + R6.format('avg(passed)'))} failed, {R6.format('avg(pass_rate)')} pass_rate, count(*) runs from rep_runs", "rep_runs", "rep", "rep_items")
def experiment_pass_rate(spark, sf):
    evals = d.repeated(spark, sf)
    keys = ["run_index", "item_idx"]
    items = rs.item_results(evals.select(*keys).distinct(), evals, keys)
    return rs.experiment_summary(rs.run_summary(items, ["run_index"]), [])


@query(f"select evaluator, {R6.format('avg(success::int::double)')} pass_rate from rep group by 1", "rep")
def evaluator_pass_rate(spark, sf):
    return rs.evaluator_pass_rates(d.repeated(spark, sf), [])


@query(f"select item_idx, evaluator, {R6.format('avg(score)')} average_score, {R6.format('coalesce(stddev_samp(score), 0)')} std_dev, count(*) n, arg_min(threshold, run_index::bigint * 1000000000 + evaluator_idx) filter (where threshold is not null) threshold, coalesce(arg_min(reason, run_index::bigint * 1000000000 + evaluator_idx) filter (where reason <> ''), '') reason, bool_and(success) success from rep group by all", "rep")
def item_cross_run_agg(spark, sf):
    out = rs.item_across_runs(d.repeated(spark, sf), [])
    return out.select("item_idx", "evaluator", "average_score", "std_dev", "n", "threshold", "reason", "success")


@query("select item_idx, bool_and(success) success from rep_items group by 1", "rep_items", "rep")
def item_success_all_runs(spark, sf):
    evals = d.repeated(spark, sf)
    keys = ["run_index", "item_idx"]
    return rs.item_success_across_runs(rs.item_results(evals.select(*keys).distinct(), evals, keys), [])


@query("select item_idx, min(run_index)::bigint run_index from rep_items where not success group by 1", "rep_items", "rep")
def first_failing_run(spark, sf):
    evals = d.repeated(spark, sf)
    keys = ["run_index", "item_idx"]
    return plain(rs.first_failures(rs.item_results(evals.select(*keys).distinct(), evals, keys), []))


@query("select distinct evaluator from rep", "rep")
def evaluator_names(spark, sf):
    return rs.evaluator_names(d.repeated(spark, sf))


@query("select item_id, " + ", ".join(f"arg_max(score, evaluator_idx) filter (where evaluator = '{e}') {e.lower()}_score, arg_max(success, evaluator_idx) filter (where evaluator = '{e}') {e.lower()}_pass" for e in "ANR") + " from evals group by 1", "evals")
def csv_pivot(spark, sf):
    return rs.pivoted(d.evals(spark, sf), ["item_id"], ["A", "N", "R"])


@query("select item_id, arg_min(evaluator, evaluator_idx) evaluator, arg_min(score, evaluator_idx) score from evals where not success group by 1", "evals")
def assert_first_failure(spark, sf):
    evals = d.evals(spark, sf).withColumn("reason", F.lit(""))
    return rs.assert_all(evals, ["item_id"]).select("item_id", "evaluator", "score")


# --- evaluators


@query("select conv_id, turn, case when input = actual_output then 1.0::double else 0.0::double end score, input = actual_output success from pairs", "pairs")
def exact_match(spark, sf):
    return _scored(d.question_pairs(spark, sf), ["conv_id", "turn"], ev.exact_match("input", "actual_output"))


def _scored(df: DataFrame, keys: list[str], result) -> DataFrame:
    return df.select(*keys, result.alias("r")).select(*keys, "r.score", "r.success")


EMAIL = r"[\w.+-]+@[\w-]+\.[a-z]+"


@query(rf"select doc_id, case when regexp_matches(text, '{EMAIL}') then 1.0::double else 0.0::double end score, regexp_matches(text, '{EMAIL}') success from documents")
def regex_email(spark, sf):
    return _scored(d.table(spark, sf, "documents"), ["doc_id"], ev.regex_match("text", EMAIL))


@query("select doc_id, case when regexp_matches(text, '(?i)LICENSED?') then 1.0::double else 0.0::double end score, regexp_matches(text, '(?i)LICENSED?') success from documents")
def regex_ignore_case(spark, sf):
    return _scored(d.table(spark, sf, "documents"), ["doc_id"], ev.regex_match("text", "LICENSED?", ignore_case=True))


WORDS = r"len(regexp_split_to_array(regexp_replace({0}, '\s+$', ''), '\s+'))"


@query(f"select conv_id, turn, case when {WORDS.format('actual_output')} between 10 and 100 then 1.0::double else 0.0::double end score, {WORDS.format('actual_output')} between 10 and 100 success from pairs", "pairs")
def response_length(spark, sf):
    return _scored(d.question_pairs(spark, sf), ["conv_id", "turn"], ev.response_length("actual_output", 10, 100))


@query("select doc_id, (contains(lower(text), 'the')::int + contains(lower(text), 'license')::int + contains(lower(text), 'token')::int) / 3.0::double score, (contains(lower(text), 'the')::int + contains(lower(text), 'license')::int + contains(lower(text), 'token')::int) / 3.0::double >= 0.5 success from documents")
def keyword_coverage(spark, sf):
    return _scored(d.table(spark, sf, "documents"), ["doc_id"], ev.keyword_coverage("text", ["The", "LICENSE", "token"]))


def _bags(spark, sf):
    return d.table(spark, sf, "customer").select("c_custkey", F.array("c_mktsegment", "c_name", F.lower("c_mktsegment"), "c_mktsegment").alias("retrieved"), F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.col("c_name")).alias("relevant"))


def _share_sql(match: str, of: str) -> str:
    return f"select c_custkey, len(list_filter(retrieved, lambda r: {match}))::double / len({of}) score, len(list_filter(retrieved, lambda r: {match}))::double / len({of}) >= 0.5 success from bags"


@query(_share_sql("list_contains(relevant, r)", "retrieved"), "bags")
def precision_equality(spark, sf):
    return _scored(_bags(spark, sf), ["c_custkey"], ev.precision("retrieved", "relevant"))


@query(_share_sql("list_contains(relevant, r)", "relevant"), "bags")
def recall_equality(spark, sf):
    return _scored(_bags(spark, sf), ["c_custkey"], ev.recall("retrieved", "relevant"))


@query(_share_sql("list_contains(list_transform(relevant, lambda e: lower(e)), lower(r))", "retrieved"), "bags")
def precision_case_insensitive(spark, sf):
    return _scored(_bags(spark, sf), ["c_custkey"], ev.precision("retrieved", "relevant", m.case_insensitive()))


CLOSE = "len(list_filter(relevant, lambda e: contains(trim(regexp_replace(lower(r), '\\s+', ' ', 'g')), trim(regexp_replace(lower(e), '\\s+', ' ', 'g'))) or contains(trim(regexp_replace(lower(e), '\\s+', ' ', 'g')), trim(regexp_replace(lower(r), '\\s+', ' ', 'g'))))) > 0"


@query(_share_sql(CLOSE, "retrieved"), "bags")
def match_containment_norm(spark, sf):
    return _scored(_bags(spark, sf), ["c_custkey"], ev.precision("retrieved", "relevant", m.by_containment()))


@query(_share_sql(f"list_contains(relevant, r) or {CLOSE}", "retrieved"), "bags")
def match_any_of(spark, sf):
    return _scored(_bags(spark, sf), ["c_custkey"], ev.precision("retrieved", "relevant", m.any_of(m.by_equality(), m.by_containment())))


@query(_share_sql("list_contains(relevant, r)", "retrieved"), "bags")
def match_all_of(spark, sf):
    return _scored(_bags(spark, sf), ["c_custkey"], ev.precision("retrieved", "relevant", m.all_of(m.by_equality(), m.by_containment())))


def _triples(spark, sf):
    """Two lists of (subject, predicate, object) per order: its lines, and those of the first line number."""
    rows = d.table(spark, sf, "lineitem")
    t = F.struct(F.col("l_linenumber").alias("s"), F.col("l_returnflag").alias("p"), F.col("l_linestatus").alias("o"))
    return rows.groupBy("l_orderkey").agg(F.collect_list(t).alias("retrieved"), F.collect_list(F.when(F.col("l_linenumber") <= 3, t)).alias("relevant"))


TRIPLES = "with t as (select l_orderkey, l_linenumber s, l_returnflag p, l_linestatus o from lineitem), x as (select l_orderkey, count(*) n, count(*) filter (where exists (select 1 from t e where e.l_orderkey = t.l_orderkey and e.s <= 3 and {})) hits from t group by 1) select l_orderkey, hits::double / n score, hits::double / n >= 0.5 success from x"


@query(TRIPLES.format("e.p = t.p"))
def match_by_field(spark, sf):
    return _scored(_triples(spark, sf), ["l_orderkey"], ev.precision("retrieved", "relevant", m.by_field("p")))


@query(TRIPLES.format("e.p = t.p and e.o = t.o"))
def match_by_fields(spark, sf):
    return _scored(_triples(spark, sf), ["l_orderkey"], ev.precision("retrieved", "relevant", m.by_fields("p", "o")))


@query("select l_orderkey, count(*) filter (where l_linenumber <= 2)::double / count(*) score, count(*) filter (where l_linenumber <= 2)::double / count(*) >= 0.5 success from lineitem group by 1")
def match_typed(spark, sf):
    """Line numbers as JSON values, even ones as texts, against a list of both kinds: 1 and "2" match, 3 and "3" do not."""
    from .functions import typed

    number = F.col("l_linenumber").cast("string")
    one = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
    lists = d.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("r"))
    rows = lists.select("l_orderkey", typed.items(typed.parsed("r")).alias("retrieved"), typed.items(F.parse_json(F.lit('[1, 1.0, 2, "2", "3", 4, "5", 6, "7"]'))).alias("relevant"))
    return _scored(rows, ["l_orderkey"], ev.precision("retrieved", "relevant", m.by_typed_equality()))


def _replies(spark, sf):
    """Stub judge replies built from labels of documents: fenced JSON, and one in seven broken."""
    rows = d.table(spark, sf, "labels")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    body = F.concat(F.lit('{"score": '), text("quality"), F.lit(', "reason": "q'), text("toxic"), F.lit('"}'))
    return rows.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("no json")).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("reply"))


@query("select doc_id, case when doc_id % 7 = 0 or quality is null then 0.0::double else quality::double end score, coalesce(doc_id % 7 <> 0 and quality >= 0.5, false) success from labels")
def llm_judge_parse(spark, sf):
    return _scored(_replies(spark, sf), ["doc_id"], ev.llm_judge("reply", "quality"))


def _verdicts(spark, sf):
    """Per order a JSON list of verdicts, one a line: yes, no or idk by its return flag."""
    rows = d.table(spark, sf, "lineitem")
    verdict = F.when(F.col("l_returnflag") == "A", F.lit("Yes")).when(F.col("l_returnflag") == "N", F.lit(" no ")).otherwise(F.lit("idk"))
    lists = rows.groupBy("l_orderkey").agg(F.collect_list(F.struct(verdict.alias("verdict"), F.lit("r").alias("reason"))).alias("v"), F.collect_list("l_linestatus").alias("c"))
    return lists.select("l_orderkey", F.to_json("v").alias("verdicts"), F.to_json("c").alias("claims"))


@query("select l_orderkey, count(*) filter (where l_returnflag = 'A')::double / count(*) score, count(*) filter (where l_returnflag = 'A')::double / count(*) >= 0.8 success from lineitem group by 1")
def faithfulness_ratio(spark, sf):
    return _scored(_verdicts(spark, sf), ["l_orderkey"], ev.faithfulness("claims", "verdicts"))


@query("select l_orderkey, count(*) filter (where l_returnflag = 'N')::double / count(*) score, count(*) filter (where l_returnflag = 'N')::double / count(*) <= 0.5 success from lineitem group by 1")
def hallucination_ratio(spark, sf):
    return _scored(_verdicts(spark, sf), ["l_orderkey"], ev.hallucination("verdicts"))


@query(f"select conv_id, {R6.format('avg(greatest(0, least(1, (length(text) % 40) / 20.0::double - 0.5)))')} score, count(*) n from conversations group by 1")
def contextual_relevance_mean(spark, sf):
    rows = d.table(spark, sf, "conversations")
    reply = F.concat(F.lit('{"score": "'), ((F.length("text") % 40) / 20.0 - 0.5).cast("string"), F.lit('"}'))
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(reply)).alias("replies"))
    return lists.select("conv_id", fn.r6(ev.contextual_relevance("replies")["score"]).alias("score"), F.size("replies").cast("bigint").alias("n"))


@query("select a.vec_id, count(*) filter (where b.label = a.label) relevant, count(*) n from (select x.vec_id, x.label, y.vec_id other, row_number() over (partition by x.vec_id order by list_dot_product(x.embedding::double[], y.embedding::double[]) desc, y.vec_id) nth from embeddings x join embeddings y on x.vec_id <> y.vec_id where x.vec_id % 100 = 0) a join embeddings b on b.vec_id = other where nth <= 10 group by 1")
def topk_precision_embeddings(spark, sf):
    """Ten nearest vectors of every row whose id is divisible by 100, and how many share the label; each task ranks its own rows before the last ranking."""
    from .operators import vectors as vs
    from .shared import spread

    rows = spread(d.table(spark, sf, "embeddings")).select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    near = vs.dot_top(d.table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("v")), rows, 10)
    return near.groupBy(F.col("q").alias("vec_id")).agg(F.count_if("same").alias("relevant"), F.count("*").alias("n"))


@query("select vec_id, least(10, (select count(*) from embeddings) - 1) n, true recalled from embeddings where vec_id % 100 = 0")
def vector_index_topk(spark, sf):
    """Ten near vectors of every row whose id is divisible by 100, from the index, and whether it found nine tenths of the exact ones."""
    from .operators import vectors as vs

    rows = vs.unit(d.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    queries, index = rows.where("id % 100 = 0"), vs.VectorIndex(rows)
    found = index.scratch.save(index.search(queries, 10), "found")
    want = vs.exact(queries, index.vectors, 10).select("q", "id")
    share = want.join(found, ["q", "id"], "left_semi").count() / want.count()
    return found.groupBy(F.col("q").alias("vec_id")).agg(F.count("*").alias("n")).withColumn("recalled", F.lit(share >= 0.9))


@query("select item_id, count(doc_id) n_docs from benchmark b left join documents x on contains(trim(regexp_replace(lower(x.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g'))) or contains(trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(x.text), '\\s+', ' ', 'g'))) group by 1")
def items_in_documents(spark, sf):
    """The documents that hold each benchmark text, or are held by it; an empty text lies in every one."""
    from .operators.containment import either
    from .shared import spread

    b = d.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), fn.normalize_text("text").alias("text"))
    x = spread(d.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", fn.normalize_text("text").alias("text"))
    hits = either(b, x).groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    docs, empty = d.table(spark, sf, "documents").agg(F.count("text"), F.count_if(F.col("text").rlike(r"^\s*$"))).first()
    every = F.when(F.col("text") == "", F.lit(docs)).when(F.col("text").isNotNull(), F.lit(empty)).otherwise(F.lit(0))
    return b.join(hits, "id", "left").select(F.col("id").alias("item_id"), (F.coalesce("n", F.lit(0)) + every).cast("bigint").alias("n_docs"))


# --- functions and formats


@query("select doc_id, md5(case when doc_id % 7 = 0 then 'no json' else '{\"score\": ' || coalesce(quality::varchar, 'null') || ', \"reason\": \"q' || coalesce(toxic::varchar, 'null') || '\"}' end) digest from labels")
def strip_markdown(spark, sf):
    return _replies(spark, sf).select("doc_id", F.md5(fn.strip_markdown("reply").cast("binary")).alias("digest"))


@query("select doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) digest from documents")
def normalize_text(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", F.md5(fn.normalize_text("text").cast("binary")).alias("digest"))


@query("select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) digest from pages")
def escape_html(spark, sf):
    return d.table(spark, sf, "pages").select("page_id", F.md5(fn.escape_html("html").cast("binary")).alias("digest"))


@query("select page_id, md5(case when regexp_matches(html, '[,\n\"]|^[=+@-]') then '\"' || replace(html, '\"', '\"\"') || '\"' else html end) digest from pages")
def escape_csv(spark, sf):
    return d.table(spark, sf, "pages").select("page_id", F.md5(fn.escape_csv("html").cast("binary")).alias("digest"))


@query("select doc_id, replace(case when length(text) > 80 then substr(text, 1, 77) || '...' else text end, '|', '\\|') cell, case when length(text) > 100 then substr(text, 1, 100) || '...' else text end short from documents")
def truncate_report(spark, sf):
    return d.table(spark, sf, "documents").select("doc_id", fn.escape_markdown_cell(fn.truncate("text", 80)).alias("cell"), fn.shorten("text", 100).alias("short"))


@query("select event_id, props->>'$.k' as value from events")
def format_value(spark, sf):
    return d.table(spark, sf, "events").select("event_id", fn.format_value(F.from_json("props", "map<string,string>")).alias("value"))


@query("select event_id, case when s < 60 then s || 's' else s // 60 || 'm ' || s % 60 || 's' end duration from (select event_id, (event_id % 4000) s from events)")
def duration_format(spark, sf):
    rows = d.table(spark, sf, "events").select("event_id", "ts", F.timestamp_add("SECOND", (F.col("event_id") % 4000).cast("int"), F.col("ts")).alias("done"))
    return rows.select("event_id", fn.duration("ts", "done").alias("duration"))


@query("select case when pass_rate < 0.5 then 'low' when pass_rate < 0.8 then 'medium' when pass_rate is not null then 'high' end bucket, count(*) n from (select passed::double / nullif(total, 0) pass_rate from counts) group by 1", "counts")
def pass_rate_bucket(spark, sf):
    return tr.list_runs(d.store(spark, sf)).select(fn.pass_rate_bucket("pass_rate").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("select conv_id, turn, len(regexp_split_to_array(regexp_replace(text, '\\s+$', ''), '\\s+')) words from conversations")
def word_count(spark, sf):
    return d.table(spark, sf, "conversations").select("conv_id", "turn", fn.word_count("text").cast("bigint").alias("words"))


# --- datasets


@query("select conv_id, turn, text as input from conversations")
def json_dataset_parse(spark, sf):
    """Turns of conversations as one JSON dataset per row, parsed again."""
    from .sources.datasets import RAW, normalized

    rows = d.table(spark, sf, "conversations")
    text = F.to_json(F.struct(F.lit("d").alias("name"), F.array(F.struct(F.col("text").alias("input"))).alias("examples")))
    parsed = rows.select("conv_id", "turn", F.explode(F.from_json(text, RAW)["examples"]).alias("e")).select("conv_id", "turn", *normalized(F.col("e")))
    return parsed.select("conv_id", "turn", F.try_element_at("inputs", F.lit("input")).alias("input"))


@query("select p_partkey example_idx, p_name as input, p_brand as output, p_type as type from part")
def csv_dataset_parse(spark, sf):
    """Parts as CSV lines with quoted cells, through the dataset reader."""
    from .sources.datasets import _rows

    rows = d.table(spark, sf, "part").select(F.col("p_partkey").alias("example_idx"), F.concat(F.lit('"'), "p_name", F.lit('", '), "p_brand", F.lit(" ,"), "p_type").alias("value"))
    out = _rows(rows, ["input", "Expected_Output", "type"], ",")
    return out.select("example_idx", F.col("inputs")["input"].alias("input"), F.col("expected_outputs")["output"].alias("output"), F.col("metadata")["type"].alias("type"))


@query("select n_nationkey::bigint example_idx, n_name as input from nation union all select (r_regionkey + 1 + (select max(n_nationkey) from nation))::bigint, r_name from region")
def union_datasets(spark, sf):
    from .sources.datasets import Dataset

    def dataset(table, key, value):
        return Dataset(d.table(spark, sf, table).select(F.col(key).cast("long").alias("example_idx"), F.col(value).alias("input")))

    return dataset("nation", "n_nationkey", "n_name").add(dataset("region", "r_regionkey", "r_name")).frame


@query("select run_id, (nth - 1) // 10 request, count(*) n, min(item_idx) first_item, md5(string_agg(text, '|' order by item_idx)) texts from (select (conv_id // 8)::varchar run_id, conv_id * 1000 + turn item_idx, text, row_number() over (partition by conv_id // 8 order by conv_id * 1000 + turn) nth from conversations) group by 1, 2")
def reporter_requests(spark, sf):
    """Turns of eight conversations as a run's items, in requests of ten."""
    from .streaming.reporter import requests

    rows = d.table(spark, sf, "conversations").select(F.expr("cast(conv_id div 8 as string)").alias("run_id"), (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("item_idx"), F.col("text").alias("input"), F.col("role").alias("actual_output"), F.lit(True).alias("success"), F.lit(1.0).alias("score"))
    return requests(rows).select("run_id", "request", "n", F.col("items")[0]["item_idx"].alias("first_item"), F.md5(F.array_join(F.transform("items", lambda i: i["input"]), "|").cast("binary")).alias("texts"))


STREAMED = "select l_orderkey::varchar run_id, l_linenumber::bigint item_idx, min(l_partkey)::varchar as input, max(l_suppkey)::varchar actual_output, bool_and(l_discount * 10 >= 0.5) success, min(l_discount * 10) score from lineitem group by 1, 2"


@query(STREAMED)
def streaming_reporter(spark, sf):
    """Items written as files, stored through the stream, and read back once each."""
    from .streaming import reporter as rp

    return rp.stored(spark, _stream(spark, sf)).drop("evals")


def _stream(spark, sf, evals: bool = False) -> str:
    """Store all items by the stream, some of them reported twice, with ``evals`` in a later batch; where they are stored."""
    from .shared import Scratch, dealt
    from .streaming import reporter as rp

    base = Scratch(spark, "reporter").path
    score = F.col("l_discount") * 10
    lines = d.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", *(["l_returnflag"] if evals else []))
    rows = dealt(lines, "l_orderkey", each=1 << 20, least=spark.sparkContext.defaultParallelism).groupBy("l_orderkey", "l_linenumber")
    judged = F.collect_list(F.struct(F.col("l_returnflag").alias("name"), score.alias("score"), F.lit(0.5).alias("threshold"), (score >= 0.5).alias("success"), F.lit("").alias("reason")))
    rows = rows.agg(F.min("l_partkey").cast("string").alias("input"), F.max("l_suppkey").cast("string").alias("actual_output"), F.bool_and(score >= 0.5).alias("success"), F.min(score).alias("score"), *([judged.alias("evals")] if evals else []))
    rows = rows.withColumns({"l_orderkey": F.col("l_orderkey").cast("string"), "l_linenumber": F.col("l_linenumber").cast("long")}).withColumnsRenamed({"l_orderkey": "run_id", "l_linenumber": "item_idx"})
    go = lambda: rp.start(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", once=True).awaitTermination()
    rp.hand_over(rows, f"{base}/in")
    if evals:
        go()
    rp.hand_over(rows.where("item_idx = 1"), f"{base}/in")  # these are reported again
    go()
    return f"{base}/out"


@query("select run_id, experiment_id, status, total, passed, passed::double / nullif(total, 0) pass_rate from counts", "counts")
def rollup_runs(spark, sf):
    """Runs with counts that the stream kept up as deltas; items that were reported again count once."""
    return tr.list_runs(_rolled(spark, sf)).select("run_id", "experiment_id", "status", "total", "passed", "pass_rate")


@query("select experiment_id, run_id, started_at, coalesce(passed::double / nullif(total, 0), 0.0) pass_rate from counts where status in ('SUCCESS', 'FAILED') qualify row_number() over (partition by experiment_id order by started_at desc, run_id desc) <= 20", "counts")
def rollup_trends(spark, sf):
    """Trends that read no item and no evaluation."""
    return tr.trends(_rolled(spark, sf), 20).select("experiment_id", "run_id", "started_at", "pass_rate")


def _rolled(spark, sf):
    from .streaming.rollup import Rollup

    s = d.store(spark, sf)
    s.items = s.evals = None
    s.rollup = Rollup(spark, f"{_stream(spark, sf, evals=True)}-rollup").read(key="long")
    return s


def _accept(run: str, body: str, key: str) -> None:
    """A receiver that takes everything."""


@query("select (conv_id // 8)::varchar run_id, count(*) items, true bounded, true sent from conversations group by 1")
def requests_delivered(spark, sf):
    """Turns of eight conversations as a run's items, gathered in the stream's state into requests of ten or of what half a second leaves, and sent once each."""
    import time

    from .shared import Scratch
    from .streaming import delivery, reporter

    base = Scratch(spark, "requests").path
    rows = d.table(spark, sf, "conversations").select(F.expr("cast(conv_id div 8 as string)").alias("run_id"), (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("item_idx"), F.col("text").alias("input"), F.lit(True).alias("success"))
    rows.repartition(3, "item_idx").write.json(f"{base}/in")
    total, box = rows.count(), delivery.Outbox(spark, f"{base}/box", _accept)
    stream = box.start(reporter.reported_items(spark, f"{base}/in", files_per_batch=1), f"{base}/checkpoint")
    try:
        while stream.isActive and (box.ledger().agg(F.sum("n")).first()[0] or 0) < total:
            time.sleep(0.2)
    finally:
        stream.stop()
        stream.awaitTermination(30)
    if stream.exception() is not None and box.ledger().agg(F.sum("n")).first()[0] != total:
        raise stream.exception()
    return box.ledger().groupBy("run_id").agg(F.sum("n").alias("items"), (F.max("n") <= delivery.BATCH).alias("bounded"), F.bool_and(F.col("state") == "sent").alias("sent"))


# --- experiments, reports, tracking writes and judges

CASES = "select conv_id * 1000 + turn item_idx, input, actual_output answer from pairs"
QUIET = f"select item_idx, input, answer, lower(answer) actual_output from ({CASES})"
OUTCOMES = f"select run_index, item_idx, input, answer, actual_output, unnest([{{'evaluator': 'Exact Match', 'k': 0, 'success': answer = actual_output}}, {{'evaluator': 'Length', 'k': 1, 'success': {WORDS.format('actual_output')} between 10 and 30}}], recursive := true) from ({QUIET}) cross join (select unnest(range(2))::int run_index)"


def _outcome(spark, sf):
    """Questions and answers as a dataset, a task that answers in lower case, two runs."""
    from .plans.experiment import Experiment
    from .sources.datasets import Dataset

    pairs = d.question_pairs(spark, sf)
    empty = F.create_map().cast("map<string,string>")
    frame = pairs.select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("example_idx"), F.create_map(F.lit("input"), "input").alias("inputs"), F.create_map(F.lit("output"), "actual_output").alias("expected_outputs"), empty.alias("metadata"))
    task = lambda df: df.withColumn("actual_output", F.lower("expected_output"))
    return Experiment(Dataset(frame), task, [ev.exact_match("expected_output", "actual_output"), ev.response_length("actual_output", 10, 30, "Length")], "quiet", runs=2).run()


@query(f"select run_index::bigint run_index, item_idx, k::bigint evaluator_idx, evaluator, success::int::double score, success from ({OUTCOMES})", "pairs")
def experiment_run(spark, sf):
    return plain(_outcome(spark, sf).evals.select("run_index", "item_idx", "evaluator_idx", "evaluator", "score", "success"))


CELL = "(case when regexp_matches({0}, '[,\n\"]|^[=+@-]') then '\"' || replace({0}, '\"', '\"\"') || '\"' else {0} end)"
LINE = " || ',' || ".join(CELL.format(c) for c in ("input", "answer", "actual_output"))


@query(f"select item_idx, md5({LINE} || ',' || bool_and(success)::varchar || ',' || string_agg(success::int::double || ',' || success, ',' order by k) filter (where run_index = 0)) line from ({OUTCOMES}) group by item_idx, input, answer, actual_output", "pairs")
def report_csv_lines(spark, sf):
    from .plans.reports import csv_lines

    return csv_lines(_outcome(spark, sf)).select("item_idx", F.md5(F.col("line").cast("binary")).alias("line"))


@query(f"select item_idx, 0::bigint run_index, md5(input) as input, string_agg(evaluator, ', ' order by k) failures from ({OUTCOMES}) where run_index = 0 and not success group by item_idx, input", "pairs")
def report_failed_items(spark, sf):
    from .plans.reports import failed_items

    out = failed_items(_outcome(spark, sf))
    return plain(out.select("item_idx", "run_index", F.md5(F.col("input").cast("binary")).alias("input"), F.array_join(F.transform("failures", lambda f: f["evaluator"]), ", ").alias("failures")))


@query(f"select item_idx, input, actual_output, bool_and(success) success, count(*) filter (where run_index = 0) n_evaluations, avg(success::int::double) filter (where k = 1) length_score from ({OUTCOMES}) group by all", "pairs")
def report_item_json(spark, sf):
    """The JSON report's items, read again from their text."""
    from .plans.reports import item_json

    body = F.from_json("body", "input string, expectedOutput string, actualOutput string, success boolean, evaluations array<struct<name:string,averageScore:double,scores:array<double>>>")
    rows = item_json(_outcome(spark, sf)).select("item_idx", body.alias("b"))
    length = F.filter("b.evaluations", lambda e: e["name"] == "Length")[0]["averageScore"]
    return rows.select("item_idx", "b.input", F.col("b.actualOutput").alias("actual_output"), "b.success", F.size("b.evaluations").cast("long").alias("n_evaluations"), length.alias("length_score"))


ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
TD = "'<td>' || " + ESCAPED.format("case when length({0}) > 100 then substr({0}, 1, 97) || '...' else {0} end") + " || '</td>'"
CELLS = " || ".join(TD.format(c) for c in ("input", "answer", "actual_output"))
WHY = f"case when k = 0 then case when success then 'Actual output equals expected output' else 'Actual output differs from expected output' end else {WORDS.format('actual_output')} || ' words' end"
DETAIL = f"'<li>' || evaluator || ': ' || case when success then '1.000 pass ' else '0.000 fail ' end || {WHY} || '</li>'"


@query(f"select item_idx, md5('<tr>' || {CELLS} || case when bool_and(success) then '<td>pass</td>' else '<td>fail</td>' end || '<td><details><summary>evaluations</summary><ul>' || string_agg({DETAIL}, '' order by k) filter (where run_index = 0) || '</ul></details></td></tr>') html from ({OUTCOMES}) group by item_idx, input, answer, actual_output", "pairs")
def report_html_rows(spark, sf):
    from .plans.reports import html_rows

    return html_rows(_outcome(spark, sf)).select("item_idx", F.md5(F.col("row").cast("binary")).alias("html"))


@query(f"select 'quiet' as name, 2::bigint runs, count(distinct item_idx) total, {R6.format('count(*) filter (where ok) / 2.0::double')} passed, {R6.format(R6.format('count(*) filter (where ok) / 2.0::double / count(distinct item_idx)'))} pass_rate, count(distinct item_idx) items from (select run_index, item_idx, bool_and(success) ok from ({OUTCOMES}) group by all)", "pairs")
def report_json_file(spark, sf):
    """The JSON report as one file, written by parts, and read again by ranges."""
    from .plans.reports import read_json, write_report
    from .shared import Scratch

    path = f"{Scratch(spark, 'report').path}/report.json"
    write_report(_outcome(spark, sf), path)
    head, items = read_json(spark, path)
    n = items.agg(F.count(F.from_json("text", "input string", {"mode": "FAILFAST"})).alias("items"))
    value = lambda v, kind, name: F.lit(v).cast(kind).alias(name)
    s = head["summary"]
    return n.select(value(head["experimentName"], "string", "name"), value(head["config"]["runs"], "long", "runs"), value(s["totalExamples"], "long", "total"), value(s["passCount"], "double", "passed"), value(s["passRate"], "double", "pass_rate"), "items")


@query("select input, actual_output, case when turn % 4 = 0 then input || '|' || role end context from pairs", "pairs")
def request_adapter(spark, sf):
    """Requests of a model as cases: documents without a text are left out, and without documents there is no context."""
    from .sources.datasets import test_cases

    document = lambda c: F.struct(c.alias("text"), F.lit(None).cast("map<string,string>").alias("metadata"))
    none = F.lit(None).cast("string")
    rows = d.question_pairs(spark, sf).select(F.col("input").alias("user_text"), F.col("actual_output").alias("response"), F.when(F.col("turn") % 4 == 0, F.array(document(F.col("input")), document(none), document(F.lit("user")))).when(F.col("turn") % 4 == 2, F.array(document(none))).alias("documents"))
    return test_cases(rows).select(F.col("inputs")["input"].alias("input"), "actual_output", F.array_join("context", "|").alias("context"))


@query("select l_discount * 10 >= 0.5 passed, l_returnflag reason, (l_discount * 10)::float score from lineitem")
def evaluation_response(spark, sf):
    """Evaluations as the request adapter's caller gets them: scores as 32-bit numbers among the metadata."""
    from .sources.datasets import evaluation_responses

    score = F.col("l_discount") * 10
    evals = d.table(spark, sf, "lineitem").select((score >= 0.5).alias("success"), F.col("l_returnflag").alias("reason"), score.alias("score"), F.lit('{"k": "v", "score": "old"}').alias("metadata"))
    return evaluation_responses(evals).select(F.col("pass").alias("passed"), "reason", F.col("metadata")["score"].cast("float").alias("score"))


def _retrieving(text: str) -> tuple[str, list[str]]:
    return text.upper(), [text[:3], text]


@query("select c_custkey, upper(c_name) actual_output, substr(c_name, 1, 3) || '|' || c_name context from customer")
def rag_task_answers(spark, sf):
    from .shipping import ship
    from .sources.adapters import rag_task

    ship(spark)
    return rag_task(_retrieving)(d.table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("input"))).select("c_custkey", "actual_output", F.array_join("context", "|").alias("context"))


def _scoring(prompt: str) -> str:
    answer = prompt.rsplit("ACTUAL_OUTPUT:\n", 1)[1].rsplit("\n\nReply with", 1)[0]
    return f'{{"score": {len(answer) % 10 / 10}, "reason": "of {len(answer)}"}}'


@query("select conv_id, turn, (length(actual_output) % 10) / 10.0::double score, (length(actual_output) % 10) / 10.0::double >= 0.5 success, 'of ' || length(actual_output) reason from pairs", "pairs")
def adapter_judge(spark, sf):
    """A model of single prompts as a judge by criteria."""
    from .operators.judges import LlmJudge
    from .sources.adapters import judge_of

    out = _judged(spark, sf, ["conv_id", "turn"], d.question_pairs(spark, sf), LlmJudge(judge_of(_scoring), "Length", "long enough"))
    return out.select("conv_id", "turn", "r.score", "r.success", "r.reason")


@query("select page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') as name from pages")
def base_names(spark, sf):
    return d.table(spark, sf, "pages").select("page_id", fn.base_name("url").alias("name"))


@query("select event_id, case when value / 100 >= 0.7 then 'high' when value / 100 >= 0.3 then 'partial' else 'irrelevant' end bucket from events")
def relevance_buckets(spark, sf):
    return d.table(spark, sf, "events").select("event_id", fn.relevance_bucket(F.col("value") / 100).alias("bucket"))


@query("select c_custkey experiment_id, 'RUNNING' status, true started from customer")
def create_runs(spark, sf):
    return tr.new_run(d.experiments(spark, sf)).select("experiment_id", "status", F.col("started_at").isNotNull().alias("started"))


@query("select run_id, case when run_id = (select min(run_id) from runs) then 'CANCELLED' else status end status, run_id = (select min(run_id) from runs) completed from runs", "runs")
def update_run(spark, sf):
    runs = d.runs(spark, sf).withColumn("completed_at", F.lit(None).cast("timestamp"))
    first = runs.agg(F.min("run_id")).first()[0]
    return tr.set_status(runs, first, "CANCELLED").select("run_id", "status", F.col("completed_at").isNotNull().alias("completed"))


@query("select o_orderkey::varchar run_id, o_custkey::varchar experiment_id, status, case when status <> 'RUNNING' then started_at + interval 1 day end completed_at from orders join runs on run_id = o_orderkey", "runs")
def status_log(spark, sf):
    """All runs as events: begun, then completed a day later by two appends, with a snapshot between; some are told again, late."""
    from .plans.log import Tracker
    from .shared import Scratch

    runs = d.runs(spark, sf)
    log = Tracker(spark, Scratch(spark, "log").path)
    log.begin(runs.select("run_id", "experiment_id", "started_at"))
    day = lambda n: F.timestamp_add("DAY", F.lit(n), F.col("started_at")).alias("at")
    ends = lambda status: runs.where(F.col("status") == status)
    log.set_status(ends("SUCCESS").select("run_id", "status", day(1)))
    log.fold()
    log.set_status(ends("FAILED").select("run_id", "status", day(1)))
    log.set_status(ends("SUCCESS").where("experiment_id % 7 = 0").select("run_id", F.lit("CANCELLED").alias("status"), day(0)))
    return log.runs().select("run_id", "experiment_id", "status", "completed_at")


@query("select item_id, l_returnflag evaluator, '' reason, l_discount * 10 score from (select l_orderkey * 100 + l_linenumber item_id, l_returnflag, l_discount from lineitem)")
def payload_projection(spark, sf):
    """Items as a reporter sends them, read again: a null reason is empty, a null threshold left out."""
    rows = d.table(spark, sf, "lineitem")
    e = F.struct(F.col("l_returnflag").alias("name"), (F.col("l_discount") * 10).alias("score"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("reason"))
    one = lambda c: F.create_map(F.lit("v"), F.col(c).cast("string"))
    items = rows.select(d.item_id().cast("string").alias("run_id"), one("l_partkey").alias("inputs"), one("l_suppkey").alias("expected_outputs"), one("l_suppkey").alias("actual_outputs"), F.lit(True).alias("success"), F.array(e).alias("evals"))
    body = F.from_json("body", "evalResults array<struct<name:string,score:double,threshold:double,reason:string>>")
    return tr.reported(items).select(F.col("run_id").cast("long").alias("item_id"), F.explode(body["evalResults"]).alias("e")).where("e.threshold is null").select("item_id", F.col("e.name").alias("evaluator"), "e.reason", "e.score")


@query("select p_partkey::varchar as input, p_brand as output, p_type as type from part")
def csv_file_dataset(spark, sf):
    from .shared import Scratch
    from .sources.datasets import from_csv

    folder = Scratch(spark, "csv")
    rows = d.table(spark, sf, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(",\""), "p_brand", F.lit("\", "), "p_type").alias("value"))
    header = spark.createDataFrame([("input,output,type",)], "value string")
    header.union(rows).coalesce(1).write.text(f"{folder.path}/parts.csv")
    data = from_csv(spark, f"{folder.path}/parts.csv").frame
    return data.select(F.col("inputs")["input"].alias("input"), F.col("expected_outputs")["output"].alias("output"), F.col("metadata")["type"].alias("type"))


@query("select (row_number() over (order by n_nationkey) - 1) example_idx, n_name as input, n_regionkey::varchar region from nation")
def json_file_dataset(spark, sf):
    """A dataset file of all nations, through the registry of resolvers."""
    from .shared import Scratch
    from .sources.datasets import Registry

    folder = Scratch(spark, "json")
    example = F.struct(F.col("n_name").alias("input"), F.create_map(F.lit("region"), "n_regionkey").alias("metadata"))
    rows = d.table(spark, sf, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.to_json(example).alias("e")))).alias("x"))
    rows.select(F.concat(F.lit('{"examples": ['), F.array_join(F.transform("x", lambda x: x["e"]), ", "), F.lit("]}"))).coalesce(1).write.text(f"{folder.path}/nations")
    data = Registry().resolve(spark, f"{folder.path}/nations").frame
    return data.select("example_idx", F.col("inputs")["input"].alias("input"), F.col("metadata")["region"].alias("region"))


@query("select (row_number() over (order by conv_id, turn) - 1) example_idx, text as input, role from conversations")
def json_ranges_dataset(spark, sf):
    """All turns in one JSON file, written by parts and read again by ranges of the file."""
    from .plans.reports import Report
    from .shared import Scratch
    from .sources.datasets import from_json

    path = f"{Scratch(spark, 'ranges').path}/turns.json"
    rows = d.table(spark, sf, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("item_idx"), F.to_json(F.struct(F.col("text").alias("input"), F.create_map(F.lit("role"), "role").alias("metadata"))).alias("line"))
    first = rows.agg(F.min("item_idx")).first()[0]
    Report('{"name": "turns", "examples": [', rows.withColumn("line", F.when(F.col("item_idx") == first, F.col("line")).otherwise(F.concat(F.lit(","), "line"))), "]}").write(path)
    return from_json(spark, path, whole=0).frame.select("example_idx", F.col("inputs")["input"].alias("input"), F.col("metadata")["role"].alias("role"))


REASON = "case when hits = n then format('All {} retrieved items are relevant (perfect precision).', n) when hits = 0 then format('None of the {} retrieved items are relevant.', n) else format('Retrieved {} items: {} relevant, {} irrelevant. Precision: {}%', n, hits, n - hits, printf('%.1f', 100.0 * hits / n)) end"


@query(f"select c_custkey, {REASON} reason, hits true_positives, n retrieved, size relevant from (select c_custkey, len(retrieved) n, len(relevant) size, len(list_filter(retrieved, lambda r: list_contains(relevant, r))) hits from bags)", "bags")
def precision_reasons(spark, sf):
    """Reasons and metadata of precision over lists kept as JSON texts under their keys."""
    rows = _bags(spark, sf).select("c_custkey", F.create_map(F.lit("retrieved"), F.to_json("retrieved")).alias("actual"), F.create_map(F.lit("relevant"), F.to_json("relevant")).alias("expected"))
    r = ev.precision(ev.collection("actual", "retrieved", "Precision", "actualOutputs"), ev.collection("expected", "relevant", "Precision", "expectedOutputs"))
    out = rows.select("c_custkey", r.alias("r")).select("c_custkey", "r.reason", F.from_json("r.metadata", "retrieved long, relevant long, truePositives long").alias("m"))
    return out.select("c_custkey", "reason", F.col("m.truePositives").alias("true_positives"), "m.retrieved", "m.relevant")


def _stub(prompts: list[str]) -> list[str]:
    """A judge that goes by lengths: an answer of n characters makes n % 4 claims, of which (n // 4) % (n % 4 + 1) are supported."""
    import json
    import re

    out = []
    for p in prompts:
        if p.startswith("Split the answer into its single claims"):
            n = len(p.split("Answer: ", 1)[1])
            out.append(json.dumps([f"c{(n // 4) % (n % 4 + 1)}"] * (n % 4)))
        elif p.startswith("Split the answer"):
            n = len(p.rsplit("\n\nAnswer: ", 1)[1])
            out.append(json.dumps([{"verdict": "no" if k < (n // 4) % (n % 4 + 1) else "Yes", "reason": "r"} for k in range(n % 4)]))
        elif p.startswith("Say for each claim"):
            claims = re.findall(r"c(\d)", p.rsplit("Claims: ", 1)[1])
            out.append("```json\n" + json.dumps([{"verdict": "YES" if k < int(claims[0]) else "idk", "reasoning": "r"} for k in range(len(claims))]) + "\n```")
        elif p.startswith("Say how relevant"):
            out.append(json.dumps({"score": (len(p.split("\n\nContext: ", 1)[1]) % 40) / 20 - 0.5, "reason": "r"}))
        elif p.startswith("Do these two"):
            a, b = re.search(r"Retrieved: (.*)\n\nExpected: (.*)$", p, re.S).groups()
            out.append("Yes, they do" if a.lower() == b.lower() else "no")
        else:
            out.append("[]" if p.startswith("List the facts") else " summed up ")
    return out


CLAIMS = "select conv_id, turn, length(actual_output) % 4 n, (length(actual_output) // 4) % (length(actual_output) % 4 + 1) k from pairs"


def _judged(spark, sf, keys, df, stage):
    from .shipping import ship

    ship(spark)
    df, r = stage.on(df, "_e")
    return df.select(*keys, r.alias("r"))


@query(f"select conv_id, turn, case when n = 0 then 1.0::double else k::double / n end score, case when n = 0 then true else k::double / n >= 0.8 end success, case when n = 0 then 'No claims were found to evaluate.' else 'summed up' end reason from ({CLAIMS})", "pairs")
def faithfulness_judged(spark, sf):
    from .operators.judges import Faithfulness

    out = _judged(spark, sf, ["conv_id", "turn"], d.question_pairs(spark, sf).withColumn("context", F.array("input")), Faithfulness(_stub))
    return out.select("conv_id", "turn", "r.score", "r.success", "r.reason")


@query(f"select conv_id, turn, case when n = 0 then 1.0::double else k::double / n end score from ({CLAIMS})", "pairs")
def faithfulness_replies(spark, sf):
    """The same, from a table of replies in which each different prompt is asked once."""
    from .operators.judges import Faithfulness
    from .operators.replies import Replies
    from .shared import Scratch

    judge = Replies(spark, Scratch(spark, "replies").path, _stub)
    out = _judged(spark, sf, ["conv_id", "turn"], d.question_pairs(spark, sf).withColumn("context", F.array("input")), Faithfulness(judge))
    return out.select("conv_id", "turn", "r.score")


@query(f"select conv_id, turn, case when n = 0 then 0.0::double else k::double / n end score, case when n = 0 then true else k::double / n <= 0.2 end success, case when n = 0 then 'No statements were found to evaluate.' else 'summed up' end reason from ({CLAIMS})", "pairs")
def hallucination_judged(spark, sf):
    from .operators.judges import Hallucination

    out = _judged(spark, sf, ["conv_id", "turn"], d.question_pairs(spark, sf).withColumn("context", F.col("input")), Hallucination(_stub, threshold=0.2))
    return out.select("conv_id", "turn", "r.score", "r.success", "r.reason")


@query(f"select conv_id, {R6.format('avg(greatest(0, least(1, (length(text) % 40) / 20.0::double - 0.5)))')} score, count(*) n, 'summed up' reason from conversations group by 1")
def contextual_relevance_judged(spark, sf):
    from .operators.judges import ContextualRelevance

    rows = d.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("text")).alias("retrievalContext"), F.lit("q").alias("input"))
    out = _judged(spark, sf, ["conv_id"], rows, ContextualRelevance(_stub))
    chunks = F.from_json("r.metadata", "contextScores array<struct<score:double>>")["contextScores"]
    return out.select("conv_id", fn.r6(F.col("r.score")).alias("score"), F.size(chunks).cast("long").alias("n"), "r.reason")


@query(_share_sql("list_contains(list_transform(relevant, lambda e: lower(e)), lower(r))", "retrieved"), "bags")
def match_by_judge(spark, sf):
    from .operators.judges import LlmRetrieval

    out = _judged(spark, sf, ["c_custkey"], _bags(spark, sf), LlmRetrieval(_stub))
    return out.select("c_custkey", "r.score", "r.success")
