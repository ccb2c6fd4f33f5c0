"""Registered queries on runs of which one holds half of all rows: numbered, filled, cut and joined chunk by chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranks, segmented
from ..sources.telemetry import table
from .base import query, r

LONG_SQL = """long_ as (select l_returnflag as run_id, row_number() over (partition by l_returnflag order by l_shipdate, l_orderkey, l_linenumber) - 1 as seq, l_quantity as quantity, l_linenumber as line,
  case when l_quantity < 20 then 'road' when l_quantity < 35 then 'pothole' else 'cut' end as context from lineitem)"""
_RUN = ["run_id"]


def long_runs(spark, sf_dir) -> DataFrame:
    """Line items as runs by their return flag, in order of shipping.

    Line items may share flag, date, order and line number, and the SQL leaves
    their order open.  Here the quantity settles it, so that all steps of a plan
    see the same run; rows that are equal in it, too, are the same here.
    """
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run_id"), "l_shipdate", "l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    n = ranks.numbered(li, _RUN, ["l_shipdate", "l_orderkey", "line", "quantity"])
    label = F.when(F.col("quantity") < 20, "road").when(F.col("quantity") < 35, "pothole").otherwise("cut")
    return n.select("run_id", "seq", "quantity", "line", label.alias("context"))


@query(f"with {LONG_SQL} select run_id, seq, quantity from long_")
def long_numbered(spark, sf_dir):
    return long_runs(spark, sf_dir).select("run_id", "seq", "quantity")


@query(f"""with {LONG_SQL}, n as (select run_id, seq, case when line % 3 = 0 then quantity end as v from long_) select run_id, seq, coalesce(last_value(v ignore nulls) over (partition by run_id order by seq rows between unbounded preceding and current row),
  first_value(v ignore nulls) over (partition by run_id order by seq rows between current row and unbounded following)) as v from n""")
def long_fill(spark, sf_dir):
    t = long_runs(spark, sf_dir).select("run_id", "seq", F.when(F.col("line") % 3 == 0, F.col("quantity")).alias("v"))
    return segmented.filled(t, "v", _RUN, ["seq"]).select("run_id", "seq", "v")


@query(f"""with {LONG_SQL}, f as (select *, last_value(case when context <> 'road' then context end ignore nulls) over (partition by run_id order by seq rows between unbounded preceding and current row) as a,
  first_value(case when context <> 'road' then context end ignore nulls) over (partition by run_id order by seq rows between current row and unbounded following) as b from long_)
  select run_id, seq, case when context = 'road' and a = b then a else context end as context from f""")
def long_gap_fill(spark, sf_dir):
    return segmented.gap_filled(long_runs(spark, sf_dir), _RUN, ["seq"]).select("run_id", "seq", "context")


@query(f"""with {LONG_SQL}, b as (select *, seq - row_number() over (partition by run_id, context order by seq) as g from long_) select run_id, context, min(seq) as start, max(seq) + 1 as "end", count(*) as n from b group by run_id, context, g""")
def long_blocks(spark, sf_dir):
    return segmented.blocks(long_runs(spark, sf_dir), _RUN).select("run_id", "context", "start", "end", "n")


@query(f"with {LONG_SQL} select run_id, seq, case when max(case when quantity > 49 then 1 else 0 end) over (partition by run_id order by seq rows between 11 preceding and 10 following) = 1 then 'crash' else context end as context from long_")
def long_crash_dilation(spark, sf_dir):
    near = lambda w: F.max((F.col("quantity") > 49).cast("int")).over(w)
    t = segmented.framed(long_runs(spark, sf_dir), {"_near": near}, 11, 10, _RUN)
    return t.select("run_id", "seq", F.when(F.col("_near") == 1, "crash").otherwise(F.col("context")).alias("context"))


@query(f"with {LONG_SQL} select run_id, seq, m as mean from (select run_id, seq, round(avg(quantity) over w, 4) as m, count(*) over w as n from long_ window w as (partition by run_id order by seq rows between current row and 29 following)) where n = 30")
def long_sliding_windows(spark, sf_dir):
    measures = {"mean": lambda w: F.avg("quantity").over(w), "_n": lambda w: F.count(F.lit(1)).over(w)}
    return segmented.framed(long_runs(spark, sf_dir), measures, 0, 29, _RUN).where("_n = 30").select("run_id", "seq", r(F.col("mean")).alias("mean"))


@query(f"""with {LONG_SQL}, e as (select * from long_ where context = 'pothole'), l as (select run_id, seq from long_ where context = 'cut'), f as (select run_id, arg_min(quantity, seq) as fv from e group by run_id)
  select l.run_id, l.seq, coalesce(e.quantity, f.fv) as ego from l asof left join e on l.run_id = e.run_id and l.seq > e.seq left join f on f.run_id = l.run_id""")
def long_asof(spark, sf_dir):
    t = long_runs(spark, sf_dir)
    ego = t.where("context = 'pothole'").select("run_id", "seq", F.col("quantity").alias("ego"))
    return segmented.asof_before(t.where("context = 'cut'").select("run_id", "seq"), ego, _RUN, ["seq"], "ego")
