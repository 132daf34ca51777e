"""Registered model queries: rows only, as SQL can't fit them."""

from __future__ import annotations

from pyspark.sql import functions as F

from recfeat import views
from recfeat.operators import models as M
from recfeat.plans.catalog import register


@register("R5_ctr_scores")
def r5(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = M.training_rows(views.interactions(spark, sf))
    model = M.ctr_model(rows.filter(F.col("ts") < F.lit("2024-01-25").cast("timestamp")), "fm")
    scored = model.transform(rows.filter(F.col("ts") >= F.lit("2024-01-25").cast("timestamp")))
    return scored.select("event_id", "label", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


@register("R7_factorised_recommendations")
def r7(spark, sf):
    recs = M.factorise(views.interactions(spark, sf)).recommendForAllUsers(10)
    return recs.select("user_id", F.posexplode("recommendations").alias("at", "x")).select("user_id", F.col("x.item_id").alias("item_id"), (F.col("at") + 1).alias("rank"), F.col("x.rating").alias("score"))


@register("P6_feature_importance")
def p6(spark, sf):
    li = views.table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return M.importance(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice")


@register("R10_fm_pairs", """with g as (select label, list(embedding::double[] order by vec_id) e from embeddings group by 1), d as (select label, e, unnest(range(1, len(e[1]) + 1)) i from g),
s as (select label, list_sum(list_transform(e, lambda v: v[i])) a, list_sum(list_transform(e, lambda v: v[i] * v[i])) b from d) select label, round(sum(0.5::double * (a * a - b)), 4) pairs from s group by 1""")
def r10(spark, sf):
    e = views.table(spark, sf, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "e"))
    d = e.groupBy("label", "i").agg(F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("q"))
    return d.groupBy("label").agg(F.round(F.sum(0.5 * (F.col("s") * F.col("s") - F.col("q"))), 4).alias("pairs"))
