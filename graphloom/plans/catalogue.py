"""The query catalogue: each query over the test tables, with the SQL that must return the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.functions import scalars
from graphloom.operators import incremental, ingest, onehop, paths, throws
from graphloom.sources.fixtures import SQL, Fixture
from graphloom.sources.store import Store
from graphloom.sources.tables import shared_folder

QUERIES: dict = {}
ORACLES: dict = {}

SOURCE_USR = "c:@F@p11"


def query(sql: str):
    """Registers a query. SQL that begins with ; or , follows the common table expressions of the fixture (, adds more)."""
    def register(make):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Fixture(spark, sf_dir))
        sql_ = sql.lstrip()
        ORACLES[make.__name__] = f"with recursive {SQL} {sql_.removeprefix(';')}" if sql_[0] in ",;" else sql
        return make

    return register


def _busiest(f: Fixture) -> str:
    """The function name with most call rows (of equals the smallest)."""
    return f.func_calls(ids=False).groupBy("qualified").count().orderBy(F.desc("count"), "qualified").first()["qualified"]


def _source_name(f: Fixture) -> str:
    return f.names().where(F.col("usr") == SOURCE_USR).first()["qualified"]


_BUSIEST = "(select qualified from func_calls group by qualified order by count(*) desc, qualified limit 1)"
_START = f"(select usr from func_definitions where qualified = (select qualified from names where usr = '{SOURCE_USR}'))"
_DIST = f"dist(n, d) as (select usr, 0 from ({_START[1:-1]}) union select e.b, d + 1 from dist join edges e on e.a = n where d < 60), near as (select n, min(d) as d from dist group by n)"


@query(f"; select c.qualified as callee, c.caller_usr, d.qualified as caller from func_calls c join func_definitions d on d.usr = c.caller_usr where c.qualified = {_BUSIEST}")
def callers_of(f):
    return onehop.callers_of(f.func_definitions(), f.func_calls(ids=False), _busiest(f))


@query(f"; select distinct d.qualified as caller from func_calls c join func_definitions d on d.usr = c.caller_usr where c.qualified = {_BUSIEST}")
def callers_of_distinct(f):
    return onehop.callers_of(f.func_definitions(), f.func_calls(ids=False), _busiest(f)).select("caller").distinct()


@query(f"; select d.qualified as caller, c.caller_usr, c.usr as callee_usr, c.qualified as callee from func_calls c join func_definitions d on d.usr = c.caller_usr where d.qualified = {_BUSIEST}")
def callees_of(f):
    return onehop.callees_of(f.func_definitions(), f.func_calls(ids=False), _busiest(f))


@query("; select d.usr, d.qualified, count(*) as n_calls, count(distinct c.usr) as n_callees from func_definitions d join func_calls c on c.caller_usr = d.usr group by d.usr, d.qualified")
def callee_counts(f):
    return onehop.callee_counts(f.func_definitions(), f.func_calls(ids=False))


@query("; select distinct qualified, usr from func_definitions where qualified in (select qualified from func_definitions group by qualified having count(*) > 1)")
def overloads_of(f):
    d = f.func_definitions()
    several = d.groupBy("qualified").agg(F.countDistinct("usr").alias("n")).where("n > 1").select("qualified")
    return d.join(several, "qualified", "left_semi").select("qualified", "usr").distinct()


@query("; select caller_usr, count(*) as n_calls from func_calls where caller_usr not in (select usr from func_definitions) group by caller_usr")
def dangling_callers(f):
    return onehop.dangling_callers(f.func_definitions(), f.func_calls(ids=False))


@query("; select usr, func_def_id, qualified, might_throw::int as might_throw, location_file_id from func_definitions")
def def_first_writer(f):
    return f.func_definitions().select("usr", "func_def_id", "qualified", F.col("might_throw").cast("int").alias("might_throw"), "location_file_id")


@query("; select usr, max_by(qualified, (create_time, qualified)) as qualified from defs_raw group by usr")
def def_latest_name(f):
    return onehop.latest_names(f.defs_raw())


@query("; select case when caller_usr = '' then 'no_caller' when location_file_id < 0 then 'out_of_project' else 'accepted' end as verdict, count(*) as n from calls_raw group by 1")
def calls_ingest_filter(f):
    rows = f.unnumbered_calls()
    return rows.groupBy(F.coalesce(ingest.call_fault(F.col("caller_usr"), F.col("location_file_id")), F.lit("accepted")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("; select case when usr = '' then 'no_usr' when qualified = '' then 'no_name' when location_file_id < 0 then 'out_of_project' else 'accepted' end as verdict, count(*) as n from defs_raw group by 1")
def defs_ingest_filter(f):
    return f.defs_raw().groupBy(F.coalesce(ingest.definition_fault(F.col("usr"), F.col("qualified"), F.col("location_file_id")), F.lit("accepted")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("select 'src/c' || o_custkey || '.cc' as filepath, epoch(max(o_orderdate))::bigint as last_index from orders group by 1")
def file_last_index_time(f):
    return incremental.last_index_times(f.filepaths().withColumn("create_time", F.col("create_time").cast("timestamp")))


@query("""with p as (select o_orderkey as id, 'src/c' || o_custkey || '.cc' as path from orders), k as (select path, min(id) as id from p where id % 2 = 0 group by path),
 n as (select distinct path from p where path not in (select path from k))
select path as filepath, id as filepath_id from k union all select path, (select max(id) from p where id % 2 = 0) + row_number() over (order by path) from n""")
def file_id_assign(f):
    known = f.filepaths().where(F.col("filepath_id") % 2 == 0)
    return ingest.assigned_file_ids(f.filepaths(), known)


@query("select 'src/c' || o_custkey || '.cc' as filepath, max_by(o_orderkey, (o_orderdate, o_orderkey)) as filepath_id, max(o_orderdate) as create_time from orders group by 1")
def file_versions_latest(f):
    return ingest.latest_versions(f.filepaths()).select("filepath", "filepath_id", "create_time")


_UNITS = """with u as (select o_orderkey as tu, o_orderdate as own, case when o_orderstatus = 'P' then null when o_custkey % 10 = 0 then o_orderdate - interval 1 day else o_orderdate + interval 60 day end as last from orders),
i as (select l_orderkey as tu, max(l_shipdate) as inc from lineitem group by 1),
r as (select u.tu, case when own is null then 'missing' when last is null then 'never_indexed' when own > last then 'own_newer' when inc > last then 'include_newer' else 'fresh' end as reason from u left join i using (tu))"""


@query(f"{_UNITS} select reason, count(*) as n from r group by reason")
def stale_files(f):
    return incremental.staleness(f.units(), f.includes()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_UNITS} select tu, reason, (reason not in ('missing', 'fresh'))::int as need_reindex from r")
def need_reindex(f):
    return incremental.staleness(f.units(), f.includes()).select("tu", "reason", F.col("need_reindex").cast("int").alias("need_reindex"))


@query("""; select 'project_id' as name, coalesce(max(r_regionkey + 1), 0)::bigint + 1 as next_id from region union all select 'filepath_id', coalesce(max(o_orderkey), 0) + 1 from orders
 union all select 'func_def_id', coalesce(max(func_def_id), 0) + 1 from func_definitions union all select 'func_call_id', coalesce(max(func_call_id), 0) + 1 from func_calls""")
def next_ids(f):
    out = None
    for name, df in (("project_id", f.projects()), ("filepath_id", f.filepaths()), ("func_def_id", f.func_definitions()), ("func_call_id", f.func_calls())):
        one = df.agg((F.coalesce(F.max(name), F.lit(0)) + 1).cast("long").alias("next_id")).select(F.lit(name).alias("name"), "next_id")
        out = one if out is None else out.unionByName(one)
    return out


def _store(f) -> Store:
    return Store(f.spark, f"{shared_folder(f.spark)}/store-{uuid.uuid4().hex}")


@query("; select caller_usr, usr, count(*) as n, min(func_call_id) as first_id from func_calls group by caller_usr, usr")
def stored_calls(f):
    """Written to a store in two appends beside another project's rows, and read again."""
    store = _store(f)
    rows = f.func_calls().withColumn("project_id", F.lit(1))
    for part in (rows.where("func_call_id % 2 = 0"), rows.where("func_call_id % 2 = 1"), rows.limit(50).withColumn("project_id", F.lit(2))):
        store.append("func_calls", part)
    return store.read("func_calls", 1).groupBy("caller_usr", "usr").agg(F.count(F.lit(1)).alias("n"), F.min("func_call_id").alias("first_id"))


@query("""with p as (select r_regionkey + 1 as id, '/proj/' || lower(r_name) || '/' as root from region), w as (select '/proj/asia/' as root union all select '/proj/new/')
select w.root as project_root, coalesce(p.id, (select max(id) from p) + 1)::bigint as project_id from w left join p using (root)""")
def project_get_or_create(f):
    store = _store(f)
    store.append("projects", f.projects())
    return f.spark.createDataFrame([(root, store.project(root)) for root in ("/proj/asia/", "/proj/new/")], "project_root string, project_id long")


@query("""select s_suppkey, case when s_suppkey % 3 = 0 then '/proj/x/' || s_name when s_suppkey % 3 = 1 then '/proj/xy/' || s_name else '/proj/x' end as file,
 case when s_suppkey % 3 = 0 then s_name when s_suppkey % 3 = 2 then '' end as path from supplier""")
def relative_paths(f):
    k = F.col("s_suppkey") % 3
    rows = f.table("supplier").withColumn("file", F.when(k == 0, F.concat(F.lit("/proj/x/"), "s_name")).when(k == 1, F.concat(F.lit("/proj/xy/"), "s_name")).otherwise("/proj/x"))
    return rows.select("s_suppkey", "file", scalars.clamp_path(scalars.relative_path(F.col("file"), F.lit("/proj/x"))).alias("path"))


@query("""with s as (select p_partkey, case p_partkey % 3 when 0 then '(anonymous namespace)::' || p_name when 1 then '(anonymous class)::' || p_name else p_name end as q from part)
select p_partkey, replace(replace(q, '(anonymous namespace)', '(anon ns)'), '(anonymous ', '(anon ') as qualified from s""")
def anon_simplify(f):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("(anonymous namespace)::"), "p_name")).when(k == 1, F.concat(F.lit("(anonymous class)::"), "p_name")).otherwise(F.col("p_name"))
    return f.table("part").select("p_partkey", scalars.simplify_anonymous(raw).alias("qualified"))


@query("""with s as (select p_partkey, case p_partkey % 5 when 0 then p_name || ';' || p_brand when 1 then p_name || ';' || p_brand || ';' when 2 then ';' || p_brand when 3 then p_name else p_name || ';' || p_name end as r from part)
select p_partkey, case when p_partkey % 5 in (0, 1) then split_part(r, ';', 1) end as source, case when p_partkey % 5 in (0, 1) then split_part(r, ';', 2) end as target from s""")
def path_request_split(f):
    k, a, b = F.col("p_partkey") % 5, F.col("p_name"), F.col("p_brand")
    semi = F.lit(";")
    raw = F.when(k == 0, F.concat(a, semi, b)).when(k == 1, F.concat(a, semi, b, semi)).when(k == 2, F.concat(semi, b)).when(k == 3, a).otherwise(F.concat(a, semi, a))
    return f.table("part").select("p_partkey", scalars.path_request(raw).alias("r")).select("p_partkey", "r.source", "r.target")


@query("""with o as (select *, l_linenumber = 7 as macro from lineitem where l_suppkey % 10 <> 0),
k as (select *, case when l_linestatus = 'F' then 'def' when l_returnflag = 'A' then null else 'call' end as fact from o where (macro and not l_quantity > 45) or (not macro and l_linenumber <= 5))
select fact, case when macro then '@macro@(anonymous namespace)::p' || l_partkey else 'c:@F@p' || l_partkey end as usr,
 case when not macro and l_tax > 0.04 then 'c:@F@p' || l_suppkey else '' end as caller_usr, count(*) as n from k where fact is not null group by all""")
def occurrence_classify(f):
    rows = ingest.classified(ingest.usable_units(f.occurrences()))
    return rows.groupBy("fact", "usr", "caller_usr").agg(F.count(F.lit(1)).alias("n"))


@query(f", {_DIST} select n as usr from near")
def reachable_from(f):
    return paths.reachable(f.func_definitions(), f.func_calls(ids=False), _source_name(f)).select("usr")


@query(f", {_DIST} select n as usr, d::int as hops from near")
def hop_distance(f):
    return paths.reachable(f.func_definitions(), f.func_calls(ids=False), _source_name(f)).select("usr", "hops")


_TARGET = "(select qualified from names where usr = 'c:@F@p7')"
_BACK = "par as (select x.n, x.d, min(e.a) as p from near x join edges e on e.b = x.n join near y on y.n = e.a and y.d = x.d - 1 group by x.n, x.d)"


@query(f""", {_DIST}, {_BACK},
goal as (select c.usr as g, min(y.d) as d from func_calls c join near y on y.n = c.caller_usr where c.qualified = {_TARGET} group by c.usr order by d, g limit 1),
last as (select min(c.caller_usr) as l, any_value(goal.g) as g, any_value(goal.d) as d from goal join func_calls c on c.usr = goal.g and c.qualified = {_TARGET} join near y on y.n = c.caller_usr and y.d = goal.d),
walk(usr, step) as (select l, d from last where l is not null union all select par.p, step - 1 from walk join par on par.n = walk.usr where step > 0)
select step::int as step, usr from walk union all select (d + 1)::int, g from last where g is not null""")
def call_path(f):
    target = f.names().where(F.col("usr") == "c:@F@p7").first()["qualified"]
    return paths.call_path(f.func_definitions(), f.func_calls(ids=False), _source_name(f), target).select("step", "usr")


@query(f""", {_DIST}, {_BACK},
goal as (select n, d from near join func_definitions f on f.usr = n where f.might_throw order by d, n limit 1),
walk(usr, step) as (select n, d from goal union all select par.p, step - 1 from walk join par on par.n = walk.usr where step > 0)
select step::int as step, usr from walk""")
def throw_path(f):
    return paths.throw_path(f.func_definitions(), f.func_calls(ids=False), _source_name(f)).select("step", "usr")


@query(f", {_DIST} select n as usr, d::int as hops from near join func_definitions f on f.usr = n where f.might_throw")
def throw_reachable(f):
    d = f.func_definitions()
    found = paths.reachable(d, f.func_calls(ids=False), _source_name(f))
    return found.join(paths.throwers(d, f.func_calls(ids=False)), "usr", "left_semi").select("usr", "hops")


@query("""with recursive b as (select 'N' || n_nationkey as derived, 'R' || n_regionkey as base from nation union all select 'R' || r_regionkey, 'Root' from region),
c(derived, base) as (select x, x from (select derived as x from b union select base from b) union select c.derived, b.base from c join b on b.derived = c.base) select derived, base from c""")
def class_base_closure(f):
    root = f.table("region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("derived"), F.lit("Root").alias("base"))
    return throws.base_closure(f.class_bases().unionByName(root))


@query("""with t as (select 'N' || n_nationkey as type, 'R' || n_regionkey as base from nation), k as (select 'R' || r_regionkey as catch_type from region union all select 'N3')
select type, catch_type from t, k where type = catch_type or base = catch_type""")
def catch_filter(f):
    types = f.class_bases().select(F.col("derived").alias("type"))
    catches = f.table("region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("catch_type")).unionByName(f.spark.createDataFrame([("N3",)], "catch_type string"))
    asked = types.join(F.broadcast(catches.groupBy().agg(F.collect_set("catch_type").alias("all")))).select("type", F.explode("all").alias("catch_type"))
    return throws.caught(asked, throws.base_closure(f.class_bases()))


_ESCAPE = """thrown as (select distinct 'c:@F@p' || l_partkey as usr, 'N' || s_nationkey as type from lineitem join supplier on l_suppkey = s_suppkey where l_quantity = 4 and l_discount = 0.10),
ways as (select distinct caller_usr, usr, catch_type from func_calls),
held as (select 'N' || n_nationkey as type, 'R' || n_regionkey as catch_type from nation),
escaping(usr, type) as (select usr, type from thrown union select w.caller_usr, e.type from escaping e join ways w on w.usr = e.usr where w.catch_type is null or not exists (select 1 from held h where h.type = e.type and h.catch_type = w.catch_type))"""


def _escaping(f):
    edges = f.func_calls(ids=False).select(F.col("caller_usr").alias("usr"), F.col("usr").alias("callee"), "catch_type")
    return throws.propagate(f.throws(), edges, throws.base_closure(f.class_bases()))


@query(f", {_ESCAPE} select usr, type from escaping")
def escaping_types(f):
    return _escaping(f)


@query(f", {_ESCAPE} select n.usr, (n.usr in (select usr from escaping))::int as might_throw from names n")
def might_throw(f):
    return throws.might_throw(f.names(), _escaping(f)).select("usr", F.col("might_throw").cast("int").alias("might_throw"))


@query("select o_orderkey as filepath_id, case when o_orderkey % 10 = 0 then 'moved/c' else 'src/c' end || o_custkey || '.cc' as filepath from orders")
def file_upsert(f):
    moved = f.filepaths().where(F.col("filepath_id") % 10 == 0).withColumn("filepath", F.regexp_replace("filepath", "^src", "moved"))
    return ingest.upserted(f.filepaths(), moved).select("filepath_id", "filepath")


@query("""select 'tu' || l_suppkey as tu, count(*) as n from lineitem where l_suppkey % 10 <> 0
 and l_suppkey not in (select l_suppkey from lineitem where l_suppkey % 7 = 0 and l_linenumber = 1) group by 1""")
def usable_units(f):
    error = (F.col("l_suppkey") % 7 == 0) & (F.col("l_linenumber") == 1)
    said = f.table("lineitem").select(F.concat(F.lit("tu"), F.col("l_suppkey")).alias("tu"), F.when(error, "error").otherwise("warning").alias("level"))
    return ingest.usable_units(f.occurrences(), said).groupBy("tu").agg(F.count(F.lit(1)).alias("n"))


@query("select count(distinct l_suppkey) as total, count(distinct case when l_suppkey % 10 <> 0 then l_suppkey end) as succeeded from lineitem")
def unit_counters(f):
    return f.occurrences().agg(F.countDistinct("tu").alias("total"), F.countDistinct(F.when(F.col("tu_ok"), F.col("tu"))).alias("succeeded"))


@query(f"; select func_def_id from func_definitions where usr = '{SOURCE_USR}'")
def definition_id(f):
    return onehop.definition_ids(f.func_definitions(), SOURCE_USR)


@query(f"; select usr, qualified, caller_might_throw::int as caller_might_throw from func_calls where caller_usr = '{SOURCE_USR}'")
def calls_with_throw(f):
    return onehop.calls_with_throw(f.func_calls(ids=False), SOURCE_USR).withColumn("caller_might_throw", F.col("caller_might_throw").cast("int"))


_FIRST_THROWERS = "firsts as (select caller_usr as usr from func_calls group by caller_usr having arg_min(caller_might_throw, func_call_id))"


@query(f", {_FIRST_THROWERS} select usr from firsts")
def first_row_throwers(f):
    return paths.throwers(f.func_definitions(), f.func_calls(), compat=True)


@query(f""", {_DIST}, {_BACK}, {_FIRST_THROWERS},
goal as (select n, d from near join firsts on usr = n order by d, n limit 1),
walk(usr, step) as (select n, d from goal union all select par.p, step - 1 from walk join par on par.n = walk.usr where step > 0)
select step::int as step, usr from walk""")
def throw_path_compat(f):
    return paths.throw_path(f.func_definitions(), f.func_calls(), _source_name(f), compat=True).select("step", "usr")


@query(f", {_DIST} select n as usr, repeat('    ', d::int) || n as line from near")
def call_trace(f):
    found = paths.reachable(f.func_definitions(), f.func_calls(ids=False), _source_name(f))
    return found.select("usr", F.concat(scalars.indent(F.col("hops")), F.col("usr")).alias("line"))


@query("""with t as (select n_nationkey as k, case n_nationkey % 4 when 0 then 'std::bad_alloc' when 1 then 'ns::AssertionError' when 2 then 'AssertionErrors' else 'N' || n_nationkey end as type from nation)
select 'c:@F@p' || k as usr, type from t where k % 4 > 1""")
def ignored_exceptions(f):
    k = F.col("n_nationkey") % 4
    kind = F.when(k == 0, "std::bad_alloc").when(k == 1, "ns::AssertionError").when(k == 2, "AssertionErrors").otherwise(F.concat(F.lit("N"), F.col("n_nationkey")))
    return throws.not_ignored(f.table("nation").select(F.concat(F.lit("c:@F@p"), F.col("n_nationkey")).alias("usr"), kind.alias("type")))


@query(f""", {_ESCAPE}, listed as (select usr, string_agg(type, ',' order by type) as types from (select distinct usr, type from escaping) group by usr),
blind as (select 'c:@F@p' || p_partkey as usr from part where p_size > 40)
select n.usr, case when l.usr is not null then 'Throwing' when b.usr is not null then 'Unknown' else 'NotThrowing' end as behaviour, (b.usr is not null)::int as contains_unknown, coalesce(l.types, '') as types
from names n left join listed l on l.usr = n.usr left join blind b on b.usr = n.usr""")
def exception_summary(f):
    blind = f.table("part").where("p_size > 40").select(F.concat(F.lit("c:@F@p"), F.col("p_partkey")).alias("usr"))
    found = throws.summaries(f.names(), _escaping(f), blind)
    return found.select("usr", "behaviour", F.col("contains_unknown").cast("int").alias("contains_unknown"), F.array_join("types", ",").alias("types"))


@query("""select p_partkey, starts_with(p_name, 'a')::int as starts, ends_with(p_name, 'e')::int as ends, replace(p_brand, '#', '|') as parts,
 replace(p_name, 'e', '<e>') as replaced, p_partkey::bigint * 86399 as seconds, (p_partkey % 2 = 0)::int as macro from part""")
def string_functions(f):
    name = F.col("p_name")
    usr = F.when(F.col("p_partkey") % 2 == 0, scalars.macro_key(name)).otherwise(name)
    return f.table("part").select(
        "p_partkey",
        scalars.starts_with(name, "a").cast("int").alias("starts"),
        scalars.ends_with(name, "e").cast("int").alias("ends"),
        F.array_join(scalars.split_parts(F.concat("p_brand", F.lit("#")), "#"), "|").alias("parts"),
        scalars.replace_all(name, "e", "<e>").alias("replaced"),
        scalars.to_epoch(scalars.from_epoch(F.col("p_partkey").cast("long") * 86399)).alias("seconds"),
        scalars.is_macro(usr).cast("int").alias("macro"),
    )


@query(f"{_UNITS} select tu from r where reason not in ('missing', 'fresh')")
def units_to_index(f):
    return incremental.to_index(f.units(), f.includes())


@query(f"{_UNITS} select tu from r where reason not in ('missing', 'fresh') and tu = 7")
def single_unit_to_index(f):
    return incremental.to_index(f.units(), f.includes(), only="7")


_ASKED = (("src/c1.cc", 0), ("src/c1.cc", 4_000_000_000), ("src/c2.cc", 800_000_000), ("src/none.cc", 5))


@query(f"""with q(filepath, seconds) as (values {", ".join(map(str, _ASKED))}), v as (select 'src/c' || o_custkey || '.cc' as filepath, epoch(max(o_orderdate))::bigint as last from orders group by 1)
select filepath, seconds::bigint as seconds, (v.last is not null)::int as known, (seconds > coalesce(v.last, 0))::int as obsolete, coalesce(v.last, 0)::bigint as last_index from q left join v using (filepath)""")
def file_checks(f):
    files = f.filepaths().withColumn("create_time", F.col("create_time").cast("timestamp"))
    rows = [(p, s, int(incremental.file_known(files, p)), int(incremental.file_obsolete(files, p, s)), incremental.last_index_time(files, p)) for p, s in _ASKED]
    return f.spark.createDataFrame(rows, "filepath string, seconds long, known int, obsolete int, last_index long")


@query("""with s as (select s_suppkey, s_nationkey, s_suppkey % 4 as k from supplier),
p as (select s_suppkey, case k when 0 then '/proj/x/./n' || s_nationkey || '.h' when 1 then '/proj/x//a/../n' || s_nationkey || '.h' when 2 then '/proj/xy/n' || s_nationkey || '.h' else '/usr/include/n.h' end as file,
  case when k < 2 then 'n' || s_nationkey || '.h' end as filepath, s_nationkey, k from s)
select s_suppkey, file, filepath, case when k < 2 and s_nationkey % 2 = 0 then s_nationkey + 100 else -1 end::bigint as location_file_id from p""")
def located_files(f):
    k, name = F.col("s_suppkey") % 4, F.concat(F.lit("n"), F.col("s_nationkey"), F.lit(".h"))
    file = F.when(k == 0, F.concat(F.lit("/proj/x/./"), name)).when(k == 1, F.concat(F.lit("/proj/x//a/../"), name)).when(k == 2, F.concat(F.lit("/proj/xy/"), name)).otherwise("/usr/include/n.h")
    files = f.table("nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey"), F.lit(".h")).alias("filepath"), (F.col("n_nationkey") + 100).alias("filepath_id"))
    return ingest.located(f.table("supplier").select("s_suppkey", file.alias("file")), "/proj/x", files).select("s_suppkey", "file", "filepath", "location_file_id")


@query("""select s_suppkey, case s_suppkey % 4 when 0 then '/a/c/x' || s_suppkey when 1 then 'a/x' || s_suppkey when 2 then '../x' || s_suppkey else '/x' || s_suppkey end as path from supplier""")
def normal_paths(f):
    raw = F.concat(F.get(F.array(*(F.lit(p) for p in ("/a/b/../c/./", "./a//", "a/../../", "/../"))), F.col("s_suppkey") % 4), F.lit("x"), F.col("s_suppkey"))
    return f.table("supplier").select("s_suppkey", scalars.normal_path(raw).alias("path"))


@query("select p_partkey, p_brand as short from part")
def short_names(f):
    k, ends = F.col("p_partkey") % 3, F.col("p_brand")
    name = F.when(k == 0, F.concat(F.lit("ns::"), ends)).when(k == 1, F.concat(F.lit("(anonymous namespace)::T<a::b>::"), ends, F.lit("<c::d>"))).otherwise(F.concat(ends, F.lit("(x::y)")))
    return f.table("part").select("p_partkey", scalars.short_name(name).alias("short"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_quantity <= 25 then l_linenumber end::bigint as first_line, case when l_quantity <= 25 then l_linenumber + 10 end::bigint as last_line from lineitem""")
def body_ranges(f):
    begin = scalars.location(F.col("l_orderkey"), F.col("l_linenumber"), F.lit(1))
    end = scalars.location(F.when(F.col("l_quantity") <= 25, F.col("l_orderkey")), F.col("l_linenumber") + 10, F.lit(2))
    rows = f.table("lineitem").withColumn("body", scalars.body_range(begin, end))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("body.begin.line").alias("first_line"), F.col("body.end.line").alias("last_line"))


_SEEN = "(substr(w.usr, 7)::bigint % 4 <> 0)"


@query(f""", {_ESCAPE}, near_by(usr, type, d) as (select usr, type, 0 from thrown union
 select w.caller_usr, e.type, e.d + 1 from near_by e join ways w on w.usr = e.usr where e.d < 4 and {_SEEN} and (w.catch_type is null or not exists (select 1 from held h where h.type = e.type and h.catch_type = w.catch_type)))
select distinct usr, type from near_by""")
def escaping_types_in_units(f):
    """Within four calls, along calls whose callee's body is seen."""
    seen = F.substring("usr", 7, 20).cast("long") % 4 != 0
    edges = f.func_calls(ids=False).select(F.col("caller_usr").alias("usr"), F.col("usr").alias("callee"), "catch_type", seen.alias("callee_has_body"))
    return throws.propagate(f.throws(), throws.visible(edges), throws.base_closure(f.class_bases()), most=4)
