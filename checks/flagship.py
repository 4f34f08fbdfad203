"""How good are the rollouts per data source, and what advantage is left after dynamic sampling?"""

from pyspark.sql import functions as F

from checks.base import R, derive_rollouts, query, r6
from rewardloom.operators.evaluate import majority_value
from rewardloom.operators.reduce import group_mean_std


@query("flagship_source_report", f"""
with {R},
kept as (select * from r where uid in
  (select uid from r group by uid having stddev_pop(score) > 0 or count(*) = 1)),
st as (select uid, avg(score) m, stddev_samp(score) s, count(*) n from kept group by uid),
adv as (select k.data_source, k.uid, k.score,
   (k.score - case when n=1 then 0 else m end)/(case when n=1 then 1 else s end + 1e-6) as a from kept k join st using (uid)),
item as (select data_source, uid, avg(score) mean_score, sum(abs(a)) abs_adv, count(*) n from adv group by 1,2),
votes as (select uid, pred, count(*) c, min(rollout_n) f from kept group by 1,2),
win as (select uid, pred, row_number() over (partition by uid order by c desc, f) k from votes),
maj as (select w.uid, k.score as maj from win w join votes v using (uid, pred) join kept k on k.uid=w.uid and k.rollout_n=v.f where w.k=1)
select data_source, count(*) as groups, cast(sum(n) as bigint) as rollouts, round(avg(mean_score),6) as mean_score,
  round(sum(abs_adv)/sum(n),6) as mean_abs_advantage, round(avg(maj),6) as majority_score
from item join maj using (uid) group by data_source""")
def source_report(spark, sf_dir):
    df = derive_rollouts(spark, sf_dir)[0].select("uid", "rollout_n", "data_source", "score", "pred")
    # Dynamic sampling drops whole groups, so it can read the statistics that the advantage needs anyway.
    scored = group_mean_std(df, "uid", "score").where("group_std > 0")
    adv = (F.col("score") - F.col("group_mean")) / (F.col("group_std") + 1e-6)
    items = scored.groupBy("data_source", "uid").agg(
        F.avg("score").alias("mean_score"), F.sum(F.abs(adv)).alias("abs_adv"), F.count(F.lit(1)).alias("n")
    )
    votes = majority_value(df, ["uid"], "pred", "score", "rollout_n")
    return items.join(votes, "uid").groupBy("data_source").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rollouts"), r6(F.avg("mean_score")).alias("mean_score"),
        r6(F.sum("abs_adv") / F.sum("n")).alias("mean_abs_advantage"), r6(F.avg("majority")).alias("majority_score"),
    )
