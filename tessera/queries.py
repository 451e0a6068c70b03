"""Registered queries: each operator on the test tables, beside the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import Dataset, Node, Subgraph, Workflow, get_embedding_sizes, ops
from .operators.stat import moments
from .schema import Schema, Tags
from .session import shared_dir
from .tools import CatCol, ContCol, DatasetGen, DatasetInspector, PowerLawDistro

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _fit(node: object, df: DataFrame) -> DataFrame:
    return Workflow(node).fit_transform(Dataset(df)).df


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Floats as doubles of so many digits, integers as bigint, as SQL engines agree on them."""
    return df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) if t in ("float", "double") else F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


KEY = ["l_orderkey", "l_linenumber"]


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with nulls where the quantity is 1 and the discount 0."""
    return _t(spark, d, "lineitem").withColumn("qty", F.expr("nullif(l_quantity, 1)")).withColumn("disc", F.expr("nullif(l_discount, 0)"))


LINES = "(select *, nullif(l_quantity, 1) as qty, nullif(l_discount, 0) as disc from lineitem)"


@query(f"select l_orderkey, l_linenumber::bigint as l_linenumber, coalesce(qty, 0) as qty, coalesce(disc, 0) as disc from {LINES}")
def fill_missing(s, d):
    return _rounded(_fit(KEY + (["qty", "disc"] >> ops.FillMissing()), _lines(s, d)))


@query(f"select l_orderkey, l_linenumber::bigint as l_linenumber, coalesce(qty, 7) as qty, qty is null as qty_filled from {LINES}")
def fill_missing_flags(s, d):
    return _rounded(_fit(KEY + (["qty"] >> ops.FillMissing(7, add_binary_cols=True)), _lines(s, d)))


@query(f"select l_orderkey, l_linenumber::bigint as l_linenumber, coalesce(qty, (select median(qty) from {LINES})) as qty, qty is null as qty_filled from {LINES}")
def fill_median(s, d):
    return _rounded(_fit(KEY + (["qty"] >> ops.FillMedian(add_binary_cols=True)), _lines(s, d)))


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, case when l_quantity < 5 then 5 when l_quantity > 40 then 40 else l_quantity end as l_quantity from lineitem")
def clip(s, d):
    return _rounded(_fit(KEY + (["l_quantity"] >> ops.Clip(5, 40)), _t(s, d, "lineitem")))


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, round(ln(1 + l_extendedprice)::float::double, 4) as l_extendedprice from lineitem")
def log_op(s, d):
    return _rounded(_fit(KEY + (["l_extendedprice"] >> ops.LogOp()), _t(s, d, "lineitem")))


@query(f"select l_orderkey, l_linenumber::bigint as l_linenumber, round(ln(1 + greatest(coalesce(qty, 0), 3))::float::double, 4) as qty from {LINES}")
def clip_log_chain(s, d):
    return _rounded(_fit(KEY + (["qty"] >> ops.FillMissing() >> ops.Clip(min_value=3) >> ops.LogOp()), _lines(s, d)))


@query(f"select l_orderkey, l_linenumber::bigint as l_linenumber, coalesce((qty >= 10)::bigint + (qty >= 20)::bigint + (qty >= 30)::bigint, 3) as qty from {LINES}")
def bucketize(s, d):
    return _rounded(_fit(KEY + (["qty"] >> ops.Bucketize([10, 20, 30])), _lines(s, d)))


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, (l_quantity < 30)::bigint + (l_quantity < 20)::bigint + (l_quantity < 10)::bigint as l_quantity from lineitem")
def bucketize_desc(s, d):
    return _rounded(_fit(KEY + (["l_quantity"] >> ops.Bucketize([30, 20, 10])), _t(s, d, "lineitem")))


@query(f"select l_orderkey, l_linenumber::bigint as l_linenumber, round((qty - avg(qty) over ()) / stddev_samp(qty) over (), 4) as qty from {LINES}")
def normalize(s, d):
    return _rounded(_fit(KEY + (["qty"] >> ops.Normalize()), _lines(s, d)))


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, 0.0::double as ten from lineitem")
def normalize_constant(s, d):
    return _rounded(_fit(KEY + (["ten"] >> ops.Normalize()), _t(s, d, "lineitem").withColumn("ten", F.lit(10.0))))


@query("select o_orderkey, round((o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()), 6) as o_totalprice from orders")
def normalize_minmax(s, d):
    return _rounded(_fit(["o_orderkey"] + (["o_totalprice"] >> ops.NormalizeMinMax()), _t(s, d, "orders")), 6)


@query("""with x as (select vec_id, unnest(embedding)::double as e from embeddings), m as (select avg(e) as a, stddev_samp(e) as v from x)
select vec_id, round(sum((e - a) / v), 3) as total, count(*) as n from x, m group by vec_id""")
def normalize_list(s, d):
    out = _fit(["vec_id"] + (["embedding"] >> ops.Normalize()), _t(s, d, "embeddings"))
    return out.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.size("embedding").cast("bigint").alias("n"))


@query(f"select 'qty' as \"column\", count(qty) as count, round(avg(qty), 4) as mean, round(var_samp(qty), 4) as var, round(stddev_samp(qty), 4) as std from {LINES} union all select 'l_tax', count(l_tax), round(avg(l_tax), 4), round(var_samp(l_tax), 4), round(stddev_samp(l_tax), 4) from lineitem")
def column_moments(s, d):
    return _rounded(moments(_lines(s, d), ["qty", "l_tax"]))


def _vocab(table: str, col: str, extra: str = "") -> str:
    return f"select {col}, row_number() over (order by count(*) desc, {col} asc) + 2 as label from {table} where {col} is not null group by {col} {extra}"


@query(f"select p_partkey, v.label as p_brand, w.label as p_type from part left join ({_vocab('part', 'p_brand')}) v using (p_brand) left join ({_vocab('part', 'p_type')}) w using (p_type)")
def categorify(s, d):
    return _fit(["p_partkey"] + (["p_brand", "p_type"] >> ops.Categorify()), _t(s, d, "part"))


@query(f"select event_id, coalesce(v.label, 2) as user_id from events left join ({_vocab('events', 'user_id', 'having count(*) >= 12')}) v using (user_id)")
def categorify_freq(s, d):
    return _fit(["event_id"] + (["user_id"] >> ops.Categorify(freq_threshold=12)), _t(s, d, "events"))


@query(f"select event_id, coalesce(v.label, 2) as user_id from events left join (select * from ({_vocab('events', 'user_id')}) where label < 100) v using (user_id)")
def categorify_max_size(s, d):
    return _fit(["event_id"] + (["user_id"] >> ops.Categorify(max_size=100)), _t(s, d, "events"))


@query(f"""select event_id, coalesce(v.label + 9, 2 + ('0x' || substr(md5(user_id::varchar), 1, 15))::bigint % 10) as user_id
from events left join ({_vocab('events', 'user_id', 'having count(*) >= 12')}) v using (user_id)""")
def categorify_oov_buckets(s, d):
    return _fit(["event_id"] + (["user_id"] >> ops.Categorify(freq_threshold=12, num_buckets=10, hash_method="md5")), _t(s, d, "events"))


def _pairs(s, d):
    return _t(s, d, "nation").select("n_nationkey", F.col("n_name").alias("a"), F.expr("nullif(substring(n_name, 1, 1), 'A')").alias("b"))


PAIRS = "(select n_nationkey, n_name as a, nullif(substr(n_name, 1, 1), 'A') as b from nation)"


@query(f"""with v as (select x, row_number() over (order by count(*) desc, x) + 2 as label from (select a as x from {PAIRS} union all select b from {PAIRS}) where x is not null group by x)
select n_nationkey::bigint as n_nationkey, coalesce(v.label, 1) as a, coalesce(w.label, 1) as b from {PAIRS} p left join v on p.a = v.x left join v w on p.b = w.x""")
def categorify_joint(s, d):
    return _rounded(_fit(["n_nationkey"] + ([["a", "b"]] >> ops.Categorify()), _pairs(s, d)))


COMBO = "(select l_orderkey, l_linenumber, nullif(l_returnflag, 'R') as f, nullif(l_linestatus, 'F') as g from lineitem)"


@query(f"""with v as (select f, g, row_number() over (order by count(*) desc, f asc nulls first, g asc nulls first) + 2 as label from {COMBO} where f is not null or g is not null group by f, g)
select l_orderkey, l_linenumber::bigint as l_linenumber, coalesce(v.label, 1) as f_g from {COMBO} p left join v on p.f is not distinct from v.f and p.g is not distinct from v.g""")
def categorify_combo(s, d):
    df = _t(s, d, "lineitem").select(*KEY, F.expr("nullif(l_returnflag, 'R')").alias("f"), F.expr("nullif(l_linestatus, 'F')").alias("g"))
    return _rounded(_fit(KEY + ([["f", "g"]] >> ops.Categorify(encode_type="combo")), df))


@query("""with w as (select p_partkey, unnest(string_split(p_name, ' ')) as x, generate_subscripts(string_split(p_name, ' '), 1) as i from part),
v as (select x, row_number() over (order by count(*) desc, x) + 2 as label from w group by x)
select p_partkey, string_agg(label::varchar, ',' order by i) as name from w join v using (x) group by p_partkey""")
def categorify_list(s, d):
    df = _t(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("name"))
    out = _fit(["p_partkey"] + (["name"] >> ops.Categorify()), df)
    return out.select("p_partkey", F.array_join(F.transform("name", lambda x: x.cast("string")), ",").alias("name"))


@query("select c_custkey, case c_mktsegment when 'BUILDING' then 3 when 'MACHINERY' then 4 else 2 end::bigint as c_mktsegment from customer")
def categorify_vocab(s, d):
    return _fit(["c_custkey"] + (["c_mktsegment"] >> ops.Categorify(vocabs={"c_mktsegment": ["BUILDING", "MACHINERY"]})), _t(s, d, "customer"))


@query(f"""select p_partkey, v.label as p_brand, w.label + (select count(distinct p_brand) from part) as p_type
from part left join ({_vocab('part', 'p_brand')}) v using (p_brand) left join ({_vocab('part', 'p_type')}) w using (p_type)""")
def categorify_single_table(s, d):
    return _fit(["p_partkey"] + (["p_brand", "p_type"] >> ops.Categorify(single_table=True)), _t(s, d, "part"))


@query(f"""select 'pad' as kind, 0::bigint as "offset", 1::bigint as num_indices, 0::bigint as num_observed
union all select 'null', 1, 1, count(*) from {LINES} where qty is null
union all select 'oov', 2, 1, 0
union all select 'unique', 3, count(distinct qty), count(qty) from {LINES}""")
def categorify_meta(s, d):
    op = ops.Categorify()
    Workflow(["qty"] >> op).fit(_lines(s, d))
    return op.meta(s, "qty")


@query("""with c as (select 'p_brand' as name, count(distinct p_brand) + 3 as cardinality from part union all select 'p_type', count(distinct p_type) + 3 from part)
select name, cardinality, least(greatest(16, round(1.6 * pow(cardinality, 0.56))), 512)::bigint as dimension from c""")
def embedding_sizes(s, d):
    w = Workflow(["p_brand", "p_type"] >> ops.Categorify()).fit(_t(s, d, "part"))
    return s.createDataFrame([(k, *v) for k, v in get_embedding_sizes(w).items()], "name string, cardinality long, dimension long")


def _h(x: str) -> str:
    return f"('0x' || substr(md5({x}::varchar), 1, 15))::bigint"


@query(f"select p_partkey, {_h('p_brand')} % 10 as p_brand from part")
def hash_bucket(s, d):
    return _rounded(_fit(["p_partkey"] + (["p_brand"] >> ops.HashBucket(10, method="md5")), _t(s, d, "part")))


@query(f"select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: {_h('x')} % 50), ',') as name from part")
def hash_bucket_list(s, d):
    out = _fit(["p_partkey"] + (["name"] >> ops.HashBucket(50, method="md5")), _t(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("name")))
    return out.select("p_partkey", F.array_join(F.transform("name", lambda x: x.cast("string")), ",").alias("name"))


@query(f"select p_partkey, xor({_h('p_brand')}, {_h('p_type')}) % 100 as \"p_brand_X_p_type\" from part")
def hashed_cross(s, d):
    return _rounded(_fit(["p_partkey"] + ([["p_brand", "p_type"]] >> ops.HashedCross(100, method="md5")), _t(s, d, "part")))


@query(f"select l_orderkey, l_linenumber::bigint as l_linenumber, case when qty is not null and disc is not null then xor({_h('l_partkey')}, {_h('l_suppkey')}) % 100 end as \"a_X_b\" from {LINES}")
def hashed_cross_null(s, d):
    df = _lines(s, d).withColumn("a", F.expr("if(qty is null, null, l_partkey)")).withColumn("b", F.expr("if(disc is null, null, l_suppkey)"))
    return _rounded(_fit(KEY + ([["a", "b"]] >> ops.HashedCross(100, method="md5")), df))


@query("select count(*) as n, count(distinct p_brand) as brands, 0::bigint as wrong, true as spread from part")
def hash_bucket_default(s, d):
    """The default hash: in range, the same for equal values, all buckets of a small range used."""
    out = _fit(["p_brand"] + ((["p_brand"] >> ops.HashBucket(5)) >> ops.Rename(postfix="_h")), _t(s, d, "part"))
    one = out.groupBy("p_brand").agg(F.count("*").alias("n"), F.min("p_brand_h").alias("low"), F.max("p_brand_h").alias("high"))
    wrong = F.sum(F.when((F.col("low") != F.col("high")) | (F.col("low") < 0) | (F.col("high") > 4), 1).otherwise(0))
    return one.agg(F.sum("n").alias("n"), F.count("*").alias("brands"), wrong.alias("wrong"), (F.count_distinct("low") > 1).alias("spread"))


SORTED = ["ts", "event_id"]


@query("select user_id, array_to_string(list_sort(list(event_type)), ',') as types, count(*) as n, 0::bigint as wrong from events group by user_id")
def groupby_unsorted(s, d):
    """Without sort_cols, lists follow the input; first and last are the lists' ends."""
    out = _fit(["user_id", "event_type"] >> ops.Groupby("user_id", aggs=["list", "first", "last"]), _t(s, d, "events"))
    ends = (F.element_at("event_type_list", 1) != F.col("event_type_first")) | (F.element_at("event_type_list", -1) != F.col("event_type_last"))
    return out.select("user_id", F.array_join(F.sort_array("event_type_list"), ",").alias("types"), F.size("event_type_list").cast("bigint").alias("n"), ends.cast("bigint").alias("wrong"))


@query("select user_id, string_agg(event_type, ',' order by ts, event_id) as types, count(*) as n from events group by user_id")
def groupby_list(s, d):
    out = _fit(["user_id", "event_type"] >> ops.Groupby("user_id", sort_cols=SORTED, aggs=["list", "count"]), _t(s, d, "events"))
    return out.select("user_id", F.array_join("event_type_list", ",").alias("types"), F.col("event_type_count").cast("bigint").alias("n"))


FIRST = "select user_id, arg_min(event_type, (ts, event_id)) as event_type_first, arg_max(event_type, (ts, event_id)) as event_type_last from events group by user_id"


@query(FIRST)
def groupby_first_last(s, d):
    return _fit(["user_id", "event_type"] >> ops.Groupby("user_id", sort_cols=SORTED, aggs=["first", "last"]), _t(s, d, "events"))


@query(FIRST)
def groupby_first_last_desc(s, d):
    return _fit(["user_id", "event_type"] >> ops.Groupby("user_id", sort_cols=SORTED, aggs=["first", "last"], ascending=False), _t(s, d, "events"))


@query("select o_custkey, round(sum(o_totalprice)::double, 0) as total, round(avg(o_totalprice), 1) as mean, round(stddev_samp(o_totalprice), 1) as std, min(o_totalprice) as low, max(o_totalprice) as high, count(*) as n from orders group by o_custkey")
def groupby_numeric(s, d):
    out = _fit(["o_custkey", "o_totalprice"] >> ops.Groupby("o_custkey", aggs={"o_totalprice": ["sum", "mean", "std", "min", "max", "count"]}), _t(s, d, "orders").withColumn("o_totalprice", F.round("o_totalprice", 0)))
    c = "o_totalprice"
    return out.select("o_custkey", F.col(f"{c}_sum").cast("double").alias("total"), F.round(F.col(f"{c}_mean").cast("double"), 1).alias("mean"), F.round(F.col(f"{c}_std").cast("double"), 1).alias("std"), F.col(f"{c}_min").alias("low"), F.col(f"{c}_max").alias("high"), F.col(f"{c}_count").cast("bigint").alias("n"))


ORACLES["groupby_numeric"] = "with o as (select o_custkey, round(o_totalprice, 0) as p from orders) select o_custkey, sum(p)::float::double as total, round(avg(p)::float::double, 1) as mean, round(stddev_samp(p)::float::double, 1) as std, min(p) as low, max(p) as high, count(*) as n from o group by o_custkey"


@query("select l_suppkey, count(distinct l_partkey) as l_partkey_nunique, median(l_quantity) as l_quantity_median from lineitem group by l_suppkey")
def groupby_nunique_median(s, d):
    return _rounded(_fit(["l_suppkey", "l_partkey", "l_quantity"] >> ops.Groupby("l_suppkey", aggs={"l_partkey": "nunique", "l_quantity": "median"}), _t(s, d, "lineitem")))


@query("select user_id, event_type, count(*) as event_id_count, arg_min(event_id, (ts, event_id)) as event_id_first, arg_max(event_id, (ts, event_id)) as event_id_last from events group by user_id, event_type")
def groupby_sessions(s, d):
    return _rounded(_fit(["user_id", "event_type", "event_id"] >> ops.Groupby(["user_id", "event_type"], sort_cols=SORTED, aggs={"event_id": ["count", "first", "last"]}), _t(s, d, "events")))


@query("select o_orderkey, count(*) over w as o_custkey_count, max(o_totalprice) over w as o_custkey_o_totalprice_max, round(avg(o_totalprice) over w::double, 0) as o_custkey_o_totalprice_mean from orders window w as (partition by o_custkey)")
def join_groupby(s, d):
    out = _fit(["o_orderkey"] + (["o_custkey"] >> ops.JoinGroupby(cont_cols=["o_totalprice"], stats=["count", "max", "mean"])), _t(s, d, "orders"))
    return _rounded(out.withColumn("o_custkey_o_totalprice_mean", F.round(F.col("o_custkey_o_totalprice_mean").cast("double"), 0)))


ORACLES["join_groupby"] = "select o_orderkey, count(*) over w as o_custkey_count, max(o_totalprice) over w as o_custkey_o_totalprice_max, round(cast(avg(o_totalprice) over w as float)::double, 0) as o_custkey_o_totalprice_mean from orders window w as (partition by o_custkey)"


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, count(*) over (partition by l_returnflag, l_linestatus) as l_returnflag_l_linestatus_count, max(l_quantity) over (partition by l_returnflag, l_linestatus) as l_returnflag_l_linestatus_l_quantity_max, count(*) over (partition by l_suppkey) as l_suppkey_count, max(l_quantity) over (partition by l_suppkey) as l_suppkey_l_quantity_max from lineitem")
def join_groupby_multi(s, d):
    return _rounded(_fit(KEY + ([["l_returnflag", "l_linestatus"], "l_suppkey"] >> ops.JoinGroupby(cont_cols=["l_quantity"], stats=["count", "max"])), _t(s, d, "lineitem")))


@query("with n as (select *, (l_quantity - min(l_quantity) over ()) / (max(l_quantity) over () - min(l_quantity) over ()) as q from lineitem) select l_orderkey, l_linenumber::bigint as l_linenumber, round(sum(q) over (partition by l_suppkey), 3) as l_suppkey_l_quantity_sum from n")
def join_groupby_dependency(s, d):
    scaled = ["l_quantity"] >> ops.NormalizeMinMax()
    return _rounded(_fit(KEY + (["l_suppkey"] >> ops.JoinGroupby(cont_cols=scaled, stats=["sum"])), _t(s, d, "lineitem")), 3)


def _te(keys: str, p: int = 20, fold: bool = False) -> str:
    s, n = f"sum(l_quantity) over (partition by {keys})", f"count(*) over (partition by {keys})"
    if fold:
        s += f" - sum(l_quantity) over (partition by {keys}, l_orderkey % 3)"
        n += f" - count(*) over (partition by {keys}, l_orderkey % 3)"
    return f"round((({s} + {p} * avg(l_quantity) over ()) / ({n} + {p}))::float::double, 3)"


TE_KEY = "l_orderkey, l_linenumber::bigint as l_linenumber"


@query(f"select {TE_KEY}, {_te('l_suppkey')} as \"TE_l_suppkey_l_quantity\" from lineitem")
def target_encode(s, d):
    return _rounded(_fit(KEY + (["l_suppkey"] >> ops.TargetEncoding("l_quantity", kfold=1)), _t(s, d, "lineitem")), 3)


@query(f"select {TE_KEY}, {_te('l_suppkey', fold=True)} as \"TE_l_suppkey_l_quantity\" from lineitem")
def target_encode_folds(s, d):
    return _rounded(_fit(KEY + (["l_suppkey"] >> ops.TargetEncoding("l_quantity", kfold=3, fold_seed=None, fold_key="l_orderkey")), _t(s, d, "lineitem")), 3)


@query(f"select {TE_KEY}, {_te('l_returnflag, l_linestatus', fold=True)} as \"TE_l_returnflag_l_linestatus_l_quantity\", {_te('l_partkey', fold=True)} as \"TE_l_partkey_l_quantity\" from lineitem")
def target_encode_multi(s, d):
    return _rounded(_fit(KEY + ([["l_returnflag", "l_linestatus"], "l_partkey"] >> ops.TargetEncoding("l_quantity", fold_seed=None, fold_key="l_orderkey")), _t(s, d, "lineitem")), 3)


@query(f"select {TE_KEY}, {_te('l_suppkey', 100)} as te from lineitem")
def target_encode_smooth(s, d):
    return _rounded(_fit(KEY + (["l_suppkey"] >> ops.TargetEncoding("l_quantity", kfold=1, p_smooth=100, out_col="te")), _t(s, d, "lineitem")), 3)


@query("select o_orderkey, o_custkey, c_name, c_mktsegment from orders left join customer on o_custkey = c_custkey and c_acctbal > 0")
def join_external_left(s, d):
    ext = _t(s, d, "customer").where("c_acctbal > 0")
    return _fit(["o_orderkey", "o_custkey"] >> ops.JoinExternal(ext, "o_custkey", on_ext="c_custkey", columns_ext=["c_name", "c_mktsegment"]), _t(s, d, "orders")).drop("c_custkey")


@query("select o_orderkey, o_custkey, c_name from orders join customer on o_custkey = c_custkey and c_acctbal > 0")
def join_external_inner(s, d):
    ext = _t(s, d, "customer").where("c_acctbal > 0")
    return _fit(["o_orderkey", "o_custkey"] >> ops.JoinExternal(ext, "o_custkey", how="inner", on_ext="c_custkey", columns_ext=["c_name"]), _t(s, d, "orders")).drop("c_custkey")


@query("select s_suppkey, s_nationkey::bigint as s_nationkey, r.k::bigint as r_regionkey from supplier left join (select distinct c_nationkey, n_regionkey as k from customer join nation on c_nationkey = n_nationkey) r on s_nationkey = c_nationkey")
def join_external_dedup(s, d):
    ext = _t(s, d, "customer").join(_t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    return _rounded(_fit(["s_suppkey", "s_nationkey"] >> ops.JoinExternal(ext, "s_nationkey", columns_ext=["r_regionkey"], drop_duplicates_ext=True), _t(s, d, "supplier")))


@query("select event_id, round((value - lag(value) over w)::float::double, 2) as value_difference_lag_1 from events window w as (partition by user_id order by ts, event_id)")
def difference_lag(s, d):
    return _rounded(_fit(["event_id"] + (["value"] >> ops.DifferenceLag("user_id", 1, order_by=SORTED)), _t(s, d, "events")), 2)


@query("select event_id, round((value - lead(value) over w)::float::double, 2) as \"value_difference_lag_-1\" from events window w as (partition by user_id order by ts, event_id)")
def difference_lead(s, d):
    return _rounded(_fit(["event_id"] + (["value"] >> ops.DifferenceLag("user_id", -1, order_by=SORTED)), _t(s, d, "events")), 2)


@query("select event_id, round((value - lag(value) over w)::float::double, 2) as value_difference_lag_1, round((value - lag(value, 2) over w)::float::double, 2) as value_difference_lag_2 from events window w as (partition by user_id, event_type order by ts, event_id)")
def difference_lag_multi_key(s, d):
    return _rounded(_fit(["event_id"] + (["value"] >> ops.DifferenceLag(["user_id", "event_type"], [1, 2], order_by=SORTED)), _t(s, d, "events")), 2)


def _features(s, d):
    return _t(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col")).agg(F.count("*").cast("double").alias("value"))


def _similarity(metric: str) -> Query:
    def run(s, d):
        pairs = _t(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 7).alias("other"))
        return _rounded(_fit(["s_suppkey"] + ([["s_suppkey", "other"]] >> ops.ColumnSimilarity(_features(s, d), metric=metric)), pairs))

    run.__name__ = f"column_similarity_{metric}"
    return run


for _metric, _value, _norm in (("inner", "v", "1.0"), ("cosine", "v", "sqrt(sum(v * v))"), ("tfidf", "v * ln((select max(r) + 1 from f) / n)", "sqrt(sum(v * v))")):
    query(f"""with f as (select l_suppkey as r, l_partkey as c, count(*)::double as v from lineitem group by all), n as (select c, count(*) as n from f group by c),
w as (select r, c, {_value} as v from f join n using (c)), m as (select r, {_norm} as norm from w group by r),
p as (select s_suppkey as a, s_suppkey % 7 as b from supplier)
select a as s_suppkey, round(coalesce(max(x.t / (i.norm * j.norm)), 0), 4) as s_suppkey_other_sim from p
left join (select p.a, p.b, sum(x.v * y.v) as t from p join w x on x.r = p.a join w y on y.r = p.b and y.c = x.c group by all) x using (a, b)
left join m i on i.r = a left join m j on j.r = b group by a""")(_similarity(_metric))


def _slices(s, d):
    return _t(s, d, "part").select("p_partkey", F.expr("split(p_name || ' ' || p_type, ' ')").alias("w"))


def _joined(df: DataFrame) -> DataFrame:
    return df.select("p_partkey", F.array_join("w", ",").alias("w"))


W = "string_split(p_name || ' ' || p_type, ' ')"


@query(f"select p_partkey, array_to_string({W}[1:2], ',') as w from part")
def list_slice(s, d):
    return _joined(_fit(["p_partkey"] + (["w"] >> ops.ListSlice(2)), _slices(s, d)))


@query(f"select p_partkey, array_to_string({W}[-2:], ',') as w from part")
def list_slice_negative(s, d):
    return _joined(_fit(["p_partkey"] + (["w"] >> ops.ListSlice(-2)), _slices(s, d)))


@query("select p_partkey, array_to_string((p || ['0', '0', '0', '0', '0', '0'])[1:6], ',') as w from (select p_partkey, string_split(p_name, ' ')[1:6] as p from part)")
def list_slice_pad(s, d):
    df = _t(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    return _joined(_fit(["p_partkey"] + (["w"] >> ops.ListSlice(6, pad=True, pad_value="0")), df))


@query(f"select min(len(w)) as low, max(len(w)) as high from (select {W} as w from part)")
def value_count(s, d):
    op = ops.ValueCount()
    Workflow(["w"] >> op).fit(_slices(s, d))
    return s.createDataFrame([(op.counts["w"]["min"], op.counts["w"]["max"])], "low long, high long")


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, l_quantity from lineitem where l_quantity > 30")
def filter_rows(s, d):
    return _rounded(_fit([*KEY, "l_quantity"] >> ops.Filter(lambda df: F.col("l_quantity") > 30), _t(s, d, "lineitem")))


@query(f"select l_orderkey, l_linenumber::bigint as l_linenumber, qty from {LINES} where qty > 30")
def filter_expr_null(s, d):
    return _rounded(_fit([*KEY, "qty"] >> ops.Filter("qty > 30"), _lines(s, d)))


@query(f"select l_orderkey, l_linenumber::bigint as l_linenumber, qty, round(disc, 4) as disc from {LINES} where qty is not null and disc is not null")
def dropna(s, d):
    return _rounded(_fit([*KEY, "qty", "disc"] >> ops.Dropna(), _lines(s, d)))


@query("select o_orderkey as o_orderkey_x, o_custkey as o_custkey_x from orders")
def rename(s, d):
    return _fit(["o_orderkey", "o_custkey"] >> ops.Rename(postfix="_x"), _t(s, d, "orders"))


@query("select o_orderkey, o_custkey from orders")
def subset(s, d):
    return _fit((["o_orderkey", "o_custkey", "o_totalprice"] >> ops.Operator())[["o_orderkey", "o_custkey"]], _t(s, d, "orders"))


@query("select o_orderkey, o_custkey from orders")
def subtract(s, d):
    return _fit((["o_orderkey", "o_custkey", "o_totalprice"] >> ops.Operator()) - ["o_totalprice"], _t(s, d, "orders"))


@query("select o_orderkey, o_orderpriority, round(ln(1 + o_totalprice)::float::double, 4) as o_totalprice from orders")
def concat(s, d):
    return _rounded(_fit((["o_totalprice"] >> ops.LogOp()) + ["o_orderkey", "o_orderpriority"], _t(s, d, "orders")))


@query(f"select l_orderkey, l_linenumber::bigint as l_linenumber, v.label as l_returnflag from lineitem left join ({_vocab('lineitem', 'l_returnflag')}) v using (l_returnflag)")
def drop_low_cardinality(s, d):
    df = _t(s, d, "lineitem").withColumn("one", F.lit("x"))
    return _rounded(_fit((KEY + (["l_returnflag", "one"] >> ops.Categorify())) >> ops.DropLowCardinality(), df))


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, round(l_discount::float::double, 4) as l_discount from lineitem")
def reduce_dtype_size(s, d):
    return _rounded(_fit([*KEY, "l_discount"] >> ops.ReduceDtypeSize(), _t(s, d, "lineitem"))).withColumn("l_orderkey", F.col("l_orderkey").cast("bigint"))


@query("""select 'c_acctbal' as "column", min(c_acctbal) as low, max(c_acctbal) as high, round(avg(c_acctbal), 4) as mean, round(stddev_samp(c_acctbal), 4) as std, null::bigint as cardinality from customer
union all select 'c_mktsegment', min(length(c_mktsegment)), max(length(c_mktsegment)), round(avg(length(c_mktsegment)), 4), round(stddev_samp(length(c_mktsegment)), 4), count(distinct c_mktsegment) from customer""")
def data_stats(s, d):
    op = ops.DataStats()
    Workflow(["c_acctbal", "c_mktsegment"] >> op).fit(_t(s, d, "customer"))
    rows = [(n, v["min"], v["max"], v["mean"], v["std"], v.get("cardinality")) for n, v in op.output.items()]
    return _rounded(s.createDataFrame(rows, "`column` string, low double, high double, mean double, std double, cardinality long"))


@query("select p_partkey, substr(p_type, 2, 4) as p_type from part")
def lambda_str(s, d):
    return _fit(["p_partkey"] + (["p_type"] >> ops.LambdaOp(lambda c: F.substring(c, 2, 4))), _t(s, d, "part"))


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, round(l_extendedprice - l_quantity, 6) as l_extendedprice from lineitem")
def lambda_two_arg(s, d):
    return _rounded(_fit(KEY + (["l_extendedprice"] >> ops.LambdaOp(lambda c, df: c - df["l_quantity"], dependency=["l_quantity"])), _t(s, d, "lineitem")), 6)


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, l_quantity * 2 as l_quantity from lineitem")
def lambda_pandas(s, d):
    return _rounded(_fit(KEY + (["l_quantity"] >> ops.LambdaOp(_double, dtype="double", engine="pandas")), _t(s, d, "lineitem")))


def _double(x):
    return x * 2


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def add_metadata(s, d):
    out = _fit((["o_orderkey"] >> ops.TagAsItemID()) + (["o_custkey"] >> ops.TagAsUserID()) + (["o_totalprice"] >> ops.AddTags([Tags.TARGET]) >> ops.AddProperties({"unit": "usd"}) >> ops.AddMetadata(tags=["price"])), _t(s, d, "orders"))
    assert Schema.of(out.schema)["o_totalprice"].tags == ("target", "price")
    return out


@query("select count(*) filter (tags = 'item,id') as items, count(*) filter (tags = 'user') as users, count(*) as n from (values ('o_orderkey', 'item,id'), ('o_custkey', 'user'), ('o_totalprice', 'user')) t(c, tags)")
def add_tags(s, d):
    """Tags travel in the fields' metadata, through a Parquet file too."""
    path = f"{shared_dir(s)}/add_tags"
    out = Workflow((["o_orderkey"] >> ops.TagAsItemID()) + (["o_custkey", "o_totalprice"] >> ops.TagAsUserFeatures())).fit_transform(Dataset(_t(s, d, "orders")))
    out.to_parquet(path)
    tags = [Schema.of(Dataset(path).df.schema)[c].tags for c in ("o_orderkey", "o_custkey", "o_totalprice")]
    return s.createDataFrame([(sum({"item", "id"} <= set(t) for t in tags), sum(set(t) == {"user"} for t in tags), len(tags))], "items long, users long, n long")


@query("select o_orderkey, o_custkey, o_orderstatus from orders")
def csv_without_header(s, d):
    path = f"{shared_dir(s)}/csv_without_header"
    _t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").write.mode("overwrite").csv(path)
    return Dataset(path, engine="csv", names=["o_orderkey", "o_custkey", "o_orderstatus"]).df.select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus")


@query("select o_orderstatus, count(*) as n, sum(o_orderkey)::bigint as keys from orders where o_orderstatus <> 'F' group by 1")
def parquet_partitioned(s, d):
    path = f"{shared_dir(s)}/parquet_partitioned"
    Dataset(_t(s, d, "orders").select("o_orderkey", "o_orderstatus")).to_parquet(path, partition_on=["o_orderstatus"])
    return Dataset(path).df.where("o_orderstatus <> 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("select l_orderkey as \"order.key\", v.label as \"part.key\", n.n as \"part.key_count\" from lineitem join (" + _vocab("lineitem", "l_partkey") + ") v using (l_partkey) join (select l_partkey, count(*) as n from lineitem group by 1) n using (l_partkey)")
def dotted_names(s, d):
    df = _t(s, d, "lineitem").select(F.col("l_orderkey").alias("order.key"), F.col("l_partkey").alias("part.key"))
    out = _fit(["order.key"] + (["part.key"] >> ops.Categorify()) + (["part.key"] >> ops.JoinGroupby()), df)
    return out.select("`order.key`", "`part.key`", F.col("`part.key_count`").cast("bigint").alias("part.key_count"))


CONTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATS = ["l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]


def criteo_node() -> Node:
    """The benchmark's shape: fill, clip and log of continuous columns; frequency encoding of categorical ones; a label."""
    return (CONTS >> ops.FillMissing() >> ops.Clip(min_value=0) >> ops.LogOp()) + (CATS >> ops.Categorify()) + (["l_orderkey"] >> ops.Operator()) + (["l_linenumber"] >> ops.AddTags([Tags.TARGET]))


_CRITEO = f"select {', '.join(f'round(ln(1 + greatest(coalesce({c}, 0), 0))::float::double, 4) as {c}' for c in CONTS)}, {', '.join(f'v_{c}.label as {c}' for c in CATS)}, l_orderkey, l_linenumber::bigint as l_linenumber from lineitem {' '.join(f'left join ({_vocab('lineitem', c)}) v_{c} using ({c})' for c in CATS)}"


@query(_CRITEO)
def workflow_criteo(s, d):
    return _rounded(_fit(criteo_node(), _t(s, d, "lineitem")))


#: The benchmark's full width: 13 continuous and 26 categorical columns, four of them of high cardinality with a frequency threshold.
WIDE_CONTS = {f"i{k}": f"{('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax')[k % 4]} * {k}" for k in range(1, 14)}
WIDE_CATS = {f"c{k}": f"(l_partkey * {k} + l_suppkey) % {(100_000, 20_000, 5_000, 1_000, 300, 50, 10)[k % 7]}" for k in range(1, 27)} | {"c1": "l_orderkey", "c2": "l_partkey", "c3": "l_orderkey * 8 + l_linenumber", "c4": "l_partkey * 1000 + l_suppkey"}
RARE = {"c1": 3, "c2": 5, "c3": 2, "c4": 2}
_WIDE = f"(select l_orderkey, l_linenumber, {', '.join(f'{x} as {n}' for n, x in (WIDE_CONTS | WIDE_CATS).items())} from lineitem)"


def wide_node() -> Node:
    return (list(WIDE_CONTS) >> ops.FillMissing() >> ops.Clip(min_value=0) >> ops.LogOp()) + (list(WIDE_CATS) >> ops.Categorify(freq_threshold=RARE)) + (["l_orderkey"] >> ops.Operator()) + (["l_linenumber"] >> ops.AddTags([Tags.TARGET]))


@query(f"with w as materialized {_WIDE} select {', '.join(f'round(ln(1 + greatest(coalesce({c}, 0), 0))::float::double, 4) as {c}' for c in WIDE_CONTS)}, {', '.join(f'coalesce(v_{c}.label, 2) as {c}' for c in WIDE_CATS)}, l_orderkey, l_linenumber::bigint as l_linenumber from w {' '.join(f'left join ({_vocab("w", c, f"having count(*) >= {RARE.get(c, 0)}")}) v_{c} using ({c})' for c in WIDE_CATS)}")
def workflow_criteo_wide(s, d):
    data = Dataset(_t(s, d, "lineitem"), derived=WIDE_CONTS | WIDE_CATS)
    return _rounded(Workflow(wide_node()).fit_transform(data).df)


@query(_CRITEO)
def workflow_save_load(s, d):
    path = f"{shared_dir(s)}/workflow_save_load"
    df = _t(s, d, "lineitem")
    Workflow(criteo_node()).fit(df).save(path)
    return _rounded(Workflow.load(path).transform(df))


@query(f"select l_orderkey, {', '.join(f'v_{c}.label as {c}' for c in CATS[2:])}, l_linenumber::bigint as l_linenumber from lineitem {' '.join(f'left join ({_vocab('lineitem', c)}) v_{c} using ({c})' for c in CATS[2:])}")
def workflow_subgraph(s, d):
    node = (CONTS >> ops.LogOp()) + Subgraph("cats", KEY + (CATS[2:] >> ops.Categorify()))
    df = _t(s, d, "lineitem")
    return _rounded(Workflow(node).fit(df).get_subworkflow("cats").transform(df))


@query("select l_orderkey, l_linenumber::bigint as l_linenumber, round(ln(1 + l_quantity)::float::double, 4) as l_quantity from lineitem")
def remove_inputs(s, d):
    df = _t(s, d, "lineitem")
    w = Workflow(KEY + (["l_quantity", "l_tax"] >> ops.LogOp())).fit(df).remove_inputs(["l_tax"])
    return _rounded(w.transform(df.drop("l_tax")))


@query("""with x as (select *, row_number() over (order by n desc, event_type) + 2 as label from (select event_type, count(*) as n from events group by 1)),
e as (select user_id, ts, event_id, label from events join x using (event_type))
select user_id, array_to_string(list(label order by ts, event_id)[1:5], ',') as types from e group by user_id""")
def workflow_sessions(s, d):
    node = ["user_id"] + (["event_type"] >> ops.Categorify()) + ["ts", "event_id"]
    grouped = node >> ops.Groupby("user_id", sort_cols=SORTED, aggs={"event_type": "list"})
    out = _fit(grouped["user_id"] + (grouped["event_type_list"] >> ops.ListSlice(5)), _t(s, d, "events"))
    return out.select("user_id", F.array_join(F.transform("event_type_list", lambda x: x.cast("string")), ",").alias("types"))


@query(f"""select l_orderkey, l_linenumber::bigint as l_linenumber, l_tax, l_quantity, (l_quantity >= 10)::bigint + (l_quantity >= 20)::bigint + (l_quantity >= 30)::bigint as l_quantity_buckets,
case l_returnflag when 'R' then 3 when 'A' then 4 else 2 end::bigint as l_returnflag, {_h('l_returnflag')} % 7 as l_returnflag_hashed, xor({_h('l_returnflag')}, {_h('l_linestatus')}) % 20 as "l_returnflag_X_l_linestatus" from lineitem""")
def feature_columns(s, d):
    from .tools.features import Bucketized, Crossed, Hashed, Identity, Numeric, Vocabulary, feature_workflow

    wanted = [Bucketized("l_quantity", (10, 20, 30), embedding=4), Numeric("l_quantity"), Numeric("l_tax"), Vocabulary("l_returnflag", ("R", "A")), Hashed("l_returnflag", 7), Crossed(("l_returnflag", "l_linestatus"), 20), Identity("l_linenumber", 8)]
    workflow, _ = feature_workflow(wanted, label="l_orderkey", method="md5")
    return _rounded(workflow.fit_transform(Dataset(_t(s, d, "lineitem"))).df)


@query("select count(*) as num_rows, min(l_quantity) as low, max(l_quantity) as high, count(distinct l_returnflag) as flags from lineitem")
def inspect(s, d):
    got = DatasetInspector().inspect(Dataset(_t(s, d, "lineitem")), {"conts": ["l_quantity"], "cats": ["l_returnflag"]})
    return s.createDataFrame([(got["num_rows"], got["conts"]["l_quantity"]["min"], got["conts"]["l_quantity"]["max"], got["cats"]["l_returnflag"]["cardinality"])], "num_rows long, low double, high double, flags long")


@query("select o_orderkey, o_custkey from orders")
def parquet_round_trip(s, d):
    path = f"{shared_dir(s)}/parquet_round_trip"
    Dataset(_t(s, d, "orders").select("o_orderkey", "o_custkey")).to_parquet(path, shuffle=True, output_files=4)
    return Dataset(path).df


@query("select o_orderkey, o_custkey, o_orderpriority from orders")
def csv_round_trip(s, d):
    path = f"{shared_dir(s)}/csv_round_trip"
    Dataset(_t(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")).to_csv(path)
    return Dataset(path, engine="csv", schema=None).df.select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderpriority")


@query("select 10000::bigint as n, 50::bigint as c, 0::bigint as outside, true as near_mean, true as near_length")
def datagen_uniform(s, d):
    """Ranges and moments of what is generated: a uniform on [0, 5] has mean 2.5; lists of 1 to 4 have 2.5 entries."""
    df = DatasetGen(seed=1).create_df(s, 10_000, {"conts": [ContCol("x", min_val=0, max_val=5)], "cats": [CatCol("c", cardinality=50, multi_min=1, multi_max=4)]})
    ids = df.select(F.explode("c").alias("c")).agg(F.count_distinct("c").alias("c"), F.sum(F.when((F.col("c") < 0) | (F.col("c") > 49), 1).otherwise(0)).alias("bad"))
    own = df.agg(F.count("*").alias("n"), F.sum(F.when((F.col("x") < 0) | (F.col("x") > 5), 1).otherwise(0)).alias("out"), (F.abs(F.avg("x") - 2.5) < 0.1).alias("near_mean"), (F.abs(F.avg(F.size("c")) - 2.5) < 0.1).alias("near_length"))
    return own.crossJoin(ids).select("n", "c", (F.col("out") + F.col("bad")).alias("outside"), "near_mean", "near_length")  # one row each


@query("select 10000::bigint as n, 0::bigint as outside, true as near_mean, true as falling")
def datagen_powerlaw(s, d):
    """Density x^-1.5 on [1, 100] has mean (100^0.5 - 1) / (1 - 100^-0.5) = 10; the first id is the most frequent one."""
    df = DatasetGen(PowerLawDistro(1.5), seed=1).create_df(s, 10_000, {"conts": [ContCol("x", min_val=1, max_val=100)], "cats": [CatCol("c", cardinality=1000)]})
    bad = F.when((F.col("x") < 1) | (F.col("x") > 100.001) | (F.col("c") < 0) | (F.col("c") > 999), 1).otherwise(0)
    return df.agg(F.count("*").alias("n"), F.sum(bad).cast("bigint").alias("outside"), (F.abs(F.avg("x") - 10) < 1).alias("near_mean"), (F.mode("c") == 0).alias("falling"))
