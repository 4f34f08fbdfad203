"""Scoring jobs against SQL: responses are spelled from rollout columns, so the score is known from them."""

from pyspark.sql import functions as F

from checks.base import R, query, r6, rollouts, rounded
from rewardloom.functions import spatial_text as P
from rewardloom.operators import evaluate as E
from rewardloom.operators import score as S

ROW = ["uid", "rollout_n"]
TRUTH = "cast(l_linenumber as string)"


def rows(spark, sf_dir, **texts):
    return rollouts(spark, sf_dir).withColumns({k: F.expr(v) for k, v in texts.items()})


@query("r01_score_hash_answer", f"""with {R} select uid, rollout_n,
  case when l_linenumber = 7 then 0.0::double when pred = l_linenumber then 1.0 else 0.1 end as strict,
  case when pred = l_linenumber then 1.0::double else 0.1 end as flexible from r""")
def hash_answer(spark, sf_dir):
    text = "concat(repeat('blah ', 80), 'Sum ', l_partkey, if(l_linenumber = 7, ' so ', '. #### '), pred, if(l_linenumber % 2 = 0, ' coins', ''))"
    df = rows(spark, sf_dir, text=text, truth=TRUTH)
    return df.select(*ROW, S.score_hash_answer(F.col("text"), F.col("truth"), "strict", 0.1).alias("strict"),
                     S.score_hash_answer(F.col("text"), F.col("truth"), "flexible", 0.1).alias("flexible"))


@query("r02_score_boxed", f"with {R} select uid, rollout_n, case when pred = l_linenumber then 1.0::double else 0.0 end as score from r")
def boxed(spark, sf_dir):
    text = r"concat('First \\boxed{9}. So \\boxed{\\dfrac', pred, '{', 3, '}^{\\circ}} ok')"
    truth = r"concat('\\frac{', l_linenumber, '}{3}')"
    df = rows(spark, sf_dir, text=text, truth=truth)
    return df.select(*ROW, S.score_boxed(F.col("text"), F.col("truth")).alias("score"))


@query("r03_score_answer_line", f"""with {R} select uid, rollout_n, case when pred = l_linenumber then 1.0::double else -1.0 end as score, pred = l_linenumber as acc, pred || '000' as pred_text from r""")
def answer_line(spark, sf_dir):
    text = "concat('Answer: 5', chr(10), 'We get x. Answer: n = ', pred, ',000 dollars', chr(10), 'end')"
    df = rows(spark, sf_dir, text=text, truth="concat(l_linenumber, '000')").withColumnRenamed("pred", "p")
    out = S.score_answer_line(df, "text", "truth")
    return out.select(*ROW, "score", "acc", F.col("pred").alias("pred_text"))


@query("r03_score_strict_box", f"with {R} select uid, rollout_n, case when pred = l_linenumber then 1.0::double else -1.0 end as score from r")
def strict_box(spark, sf_dir):
    df = rows(spark, sf_dir, text=r"concat('So \\boxed{', pred, '}')", truth=TRUTH).withColumnRenamed("pred", "p")
    return S.score_answer_line(df, "text", "truth", strict_box=True).select(*ROW, "score")


@query("r04_score_em", f"""with {R} select uid, rollout_n, case when pred = l_linenumber then case when pred = 2 then 0.25::double else 1.0 end else 0.0 end as em,
  case when contains('item ' || pred || ' red', 'item ' || l_linenumber) then 1.0::double else 0.0 end as subem from r""")
def em(spark, sf_dir):
    text = "concat('<answer>no</answer> ', if(pred = 2, repeat('<answer>x</answer>', 12), ''), '<answer>The Item, ', pred, ' red!</answer>')"
    df = rows(spark, sf_dir, text=text)
    em_gold = F.array(F.lit("zzz"), F.format_string("an item %d RED", "l_linenumber"))
    sub_gold = F.array(F.format_string("item %d", "l_linenumber"))
    return df.select(*ROW, S.score_em(F.col("text"), em_gold).alias("em"), S.score_em(F.col("text"), sub_gold, True).alias("subem"))


SHAPES = """case l_linenumber when 1 then concat('<think>step 1 add step 2</think><answer>', pred, '</answer>')
  when 2 then concat('<think>no numbering</think><answer>', pred, '</answer>') when 3 then concat('<answer>', pred, '</answer><think>step 1</think>')
  when 4 then concat('<think>step 1</think><answer></answer>') when 5 then concat('<think>Step 1 ((( [</think><answer>', pred, '</answer>')
  when 6 then concat('<think>step 1</think><think>step 2</think><answer>', pred, '</answer>') else concat('<think>step1 step2 step3</think> then <answer>', pred, '</answer>') end"""
GOOD = "(l_linenumber in (1) or l_linenumber >= 7)"


@query("r05_check_format", f"with {R} select uid, rollout_n, case when {GOOD} then 1.0::double else 0.0 end as format_reward from r")
def check_format(spark, sf_dir):
    return rows(spark, sf_dir, text=SHAPES).select(*ROW, S.check_format(F.col("text")).alias("format_reward"))


@query("r06_extract_answer", f"""with {R} select uid, rollout_n, case l_linenumber % 4 when 0 then pred::varchar when 1 then 'v' || pred when 2 then 'code ' || pred else 'last ' || pred end as answer,
  chr(65 + pred) as letter from r""")
def extract(spark, sf_dir):
    text = """case l_linenumber % 4 when 0 then concat('x <answer> ', pred, ' </answer>') when 1 then concat('{"answer": "v', pred, '"}')
      when 2 then concat('```py', chr(10), 'code ', pred, chr(10), '```') else concat('first', chr(10), 'last ', pred) end"""
    df = rows(spark, sf_dir, text=text, mc="concat('reasoning. The correct option ', chr(65 + pred), ' wins')")
    return df.select(*ROW, S.extract_answer(F.col("text")).alias("answer"), S.extract_answer(F.col("mc"), multiple_choice=True).alias("letter"))


@query("r07_infer_choice", f"""with {R} select uid, rollout_n, case l_linenumber % 4 when 0 then case when pred < 3 then chr(65 + pred) end when 1 then 'B' when 2 then 'Z' else null end as choice from r""")
def infer(spark, sf_dir):
    text = """case l_linenumber % 4 when 0 then concat('it must be (', chr(65 + pred), ').') when 1 then 'clearly a green one' when 2 then 'Cannot determine the answer' else 'A or B' end"""
    choices = F.create_map(*[F.lit(x) for x in ("A", "a red one", "B", "a green one", "C", "a blue one")])
    return rows(spark, sf_dir, text=text).select(*ROW, S.infer_choice(F.col("text"), choices).alias("choice"))


ACC_SQL = "case when l_linenumber % 3 = 2 then pred % 3 = l_partkey % 3 else pred = l_linenumber end"
ACC_TEXT = """case l_linenumber % 3 when 0 then concat('<think>step 1</think><answer>', pred, '.0</answer>') when 1 then concat('<think>step 1</think><answer> ', pred, ' units</answer>')
  else concat('<think>step 1</think><answer>The answer is ', chr(65 + pred % 3), '</answer>') end"""
ACC_TRUTH = "case l_linenumber % 3 when 0 then cast(l_linenumber as string) when 1 then concat(l_linenumber, ' units') else chr(cast(65 + l_partkey % 3 as int)) end"


@query("r08_score_accuracy", f"with {R} select uid, rollout_n, ({ACC_SQL})::int::double as accuracy from r")
def accuracy(spark, sf_dir):
    return rows(spark, sf_dir, text=ACC_TEXT, truth=ACC_TRUTH).select(*ROW, S.score_accuracy(F.col("text"), F.col("truth")).alias("accuracy"))


@query("r09_score_format_accuracy", f"""with {R}, x as (select *, {GOOD} as f, pred = l_partkey % 9 as a from r)
  select uid, rollout_n, f::int::double as format_reward, (f and a)::int::double as accuracy_reward, (f and a)::int::double as score from x""")
def format_accuracy(spark, sf_dir):
    df = rows(spark, sf_dir, text=SHAPES, truth="cast(l_partkey % 9 as string)").drop("score")
    return S.score_format_accuracy(df, "text", "truth").select(*ROW, "format_reward", "accuracy_reward", "score")


@query("r09_score_format_accuracy_cycle", f"""with {R} select uid, rollout_n, (l_suppkey % 9 = pred)::int::double as r_temporal_consistency,
  ({GOOD} and pred = l_partkey % 9 and l_suppkey % 9 = pred)::int::double as score from r""")
def format_accuracy_cycle(spark, sf_dir):
    df = rows(spark, sf_dir, text=SHAPES, truth="cast(l_partkey % 9 as string)", inv="concat('<think>step 1</think><answer>', pred, '</answer>')",
              inv_truth="cast(l_suppkey % 9 as string)").drop("score")
    return S.score_format_accuracy_cycle(df, "text", "truth", "inv", "inv_truth").select(*ROW, "r_temporal_consistency", "score")


@query("r10_combine_rewards", f"""with {R}, x as (select *, (pred>2)::int f, score/10 xy, (l_linenumber%2)::double acc from r)
  select uid, rollout_n, round(f * (0.25*(case when f*xy > 0.5 then acc else 0 end) + 0.75*f*xy), 6)+0.0 as combined from x""")
def combine(spark, sf_dir):
    df = rows(spark, sf_dir, f="if(pred > 2, 1.0D, 0.0D)", xy="score/10", acc="cast(l_linenumber % 2 as double)")
    out = S.combine_rewards(df, {"format": "f", "accuracy": "acc", "spatial_xy": "xy"}, {"accuracy": 1.0, "spatial_xy": 3.0}, out="combined")
    return out.select(*ROW, r6(F.col("combined")).alias("combined"))


@query("r11_overlong_penalty", f"""with {R}, x as (select *, least(-(response_len - 30)/20.0::double*0.5, 0) p from r) select uid, rollout_n, round(p,6)+0.0 as overlong_reward, p < 0 as overlong, round(score + p,6)+0.0 as score from x""")
def overlong(spark, sf_dir):
    return rounded(S.with_overlong_penalty(rollouts(spark, sf_dir), "response_len", 50, 20, 0.5).select(*ROW, "overlong_reward", "overlong", "score"))


@query("r12_score_batch", f"with {R} select uid, rollout_n, round(score*2 + length(data_source),6) as custom from r")
def batch(spark, sf_dir):
    import pandas as pd

    @F.pandas_udf("double")
    def custom(source: pd.Series, score: pd.Series) -> pd.Series:
        return score * 2 + source.str.len()

    return S.score_batch(rollouts(spark, sf_dir), custom, "data_source", "score", out="custom").select(*ROW, "custom")


@query("r13_score_with_failure_default", f"with {R} select uid, rollout_n, case when pred = 3 then 0.0::double else pred::double end as score, case when pred = 3 then 'no score' end as score_error from r")
def failure(spark, sf_dir):
    df = rows(spark, sf_dir, text="if(pred = 3, 'n/a', cast(pred as string))")
    return S.score_with_default(df, F.col("text").try_cast("double")).select(*ROW, "score", "score_error")


query("r14_reward_precedence", f"with {R} select uid, rollout_n, case when l_linenumber = 1 then pred::double else score end as reward from r")(
    lambda s, d: rows(s, d, rm="if(l_linenumber = 1, cast(pred as double), null)").select(*ROW, S.reward_precedence(F.col("rm"), F.col("score")).alias("reward")))


@query("r15_score_dense_prefix", f"""with {R}, x as (select *, pred || ',' || (l_linenumber) as resp, (pred % 5) || ',' || (l_linenumber % 4) as expd from r),
  y as (select *, (select coalesce(min(i), length(resp)+1) from range(1, 10) as z(i) where i <= length(resp) and substr(resp, i::integer, 1) <> substr(expd, i::integer, 1)) - 1 m from x)
  select uid, rollout_n, length(resp)::integer as size, round(least(m, length(expd)) / (length(expd)+1),6)+0.0 as total from y""")
def dense_prefix(spark, sf_dir):
    df = rows(spark, sf_dir, resp="concat(pred, ',', l_linenumber)", expd="concat(pred % 5, ',', l_linenumber % 4)")
    out = df.withColumn("d", S.dense_prefix_reward(F.col("resp"), F.col("expd")))
    return out.select(*ROW, F.size("d").alias("size"), r6(F.aggregate("d", F.lit(0.0), lambda a, x: a + x)).alias("total"))


MOVES = "element_at(array('rolling to the left', 'tilts up then tilt up', 'panning right', 'goes down', 'counterclockwise', 'static'), cast({0} % 6 as int) + 1)"
MOVE_DIR = "case {0} % 6 when 0 then 'left' when 1 then 'upwards' when 2 then 'right' when 3 then 'downwards' when 4 then 'left' end"


@query("r16_camera_motion_cycle", f"""with {R}, x as (select *, {MOVE_DIR.format('pred')} as inv, {MOVE_DIR.format('l_linenumber')} as tr, {MOVE_DIR.format('l_suppkey')} as fw from r),
  y as (select *, case coalesce(tr, fw) when 'left' then 'right' when 'right' then 'left' when 'upwards' then 'downwards' when 'downwards' then 'upwards' end as target from x)
  select uid, rollout_n, coalesce(inv = target, false)::int::double as reward from y""")
def camera(spark, sf_dir):
    df = rows(spark, sf_dir, inv=MOVES.format("pred"), tr=MOVES.format("l_linenumber"), fw=MOVES.format("l_suppkey"))
    return df.select(*ROW, S.camera_motion_cycle(F.col("fw"), F.col("inv"), F.col("tr")).alias("reward"))


@query("r17_trajectory_cycle", f"""with {R} select uid, rollout_n, case when l_linenumber = 4 then 0.0::double else round(((pred = l_linenumber)::int + (l_suppkey % 3 = l_partkey % 3)::int)/2.0, 6)::double end as reward from r""")
def trajectory(spark, sf_dir):
    fw = "concat('moves forward ', l_linenumber, ' meters, moves left ', 10 + l_partkey % 3, ' m')"
    bw = "concat('moves right ', 10 + l_suppkey % 3, ' m, moves backward ', pred, ' meters', if(l_linenumber = 4, ' and turns left 5 degrees', ''))"
    df = rows(spark, sf_dir, fw=fw, bw=bw)
    return df.select(*ROW, r6(S.trajectory_cycle(F.col("fw"), F.col("bw"))).alias("reward"))


@query("r18_relation_orientation_cycle", f"""with {R} select uid, rollout_n, case when l_linenumber % 2 = 0 then (pred % 2 = 1)::int::double else case when pred = 0 then 0.0::double else 0.5 end end as relation,
  round(exp(-abs(pred*1.0 - l_linenumber)/5.0::double),6) as orientation from r""")
def relation(spark, sf_dir):
    df = rows(spark, sf_dir, a="if(l_linenumber % 2 = 0, 'left', 'A.')", b="if(l_linenumber % 2 = 0, if(pred % 2 = 1, 'right', 'left'), concat(chr(65 + pred), '.'))",
              x="concat('rotates ', pred, ' degrees')", y="concat('-', l_linenumber, ' degrees')")
    return df.select(*ROW, S.relation_cycle(F.col("a"), F.col("b")).alias("relation"), r6(S.orientation_cycle(F.col("x"), F.col("y"))).alias("orientation"))


# Two gold boxes far apart and two predictions shifted along x: every volume is known.
GOLD = "array(array(0D,0D,2D,2D,2D,2D,0D,0D,0D), array(100D,0D,4D,2D,2D,2D,0D,0D,0D))"
PRED = "array(array(100D + pred/4, 0D, 4D + l_linenumber, 2D,2D,2D,0D,0D,0D), array(score/5, 0D, 2D, 2D,2D,2D,0D,0D,0D))"
BOX = """x as (select *, pred/4.0::double dx, l_linenumber::double dz, score/5 ex from r),
  v as (select *, greatest(2-dx,0)*2*greatest(2-dz,0) i1, (2+dx)*2*(2+dz) e1, greatest(2-ex,0)*4 i2, (2+ex)*4 e2 from x),
  w as (select *, (i1/(16-i1) - (e1-(16-i1))/e1 + 1)/2 o1, (i2/(16-i2) - (e2-(16-i2))/e2 + 1)/2 o2 from v)"""


def boxes(spark, sf_dir):
    df = rows(spark, sf_dir, gold=GOLD, boxes=PRED)
    return S.box_match_eval(df, "boxes", "gold")


@query("r19_box_match_eval", f"""with {R}, {BOX}, t as (select *, (o1>0.25)::int + (o2>0.25)::int tp from w)
  select uid, rollout_n, round((o1+o2)/2,6) as r_3d_iou, tp as tp_count, round(tp/2.0,6)::double as precision, round(tp/2.0,6)::double as r_3d_iou_f1 from t""")
def box_match(spark, sf_dir):
    return rounded(boxes(spark, sf_dir).select(*ROW, "r_3d_iou", "tp_count", "precision", "r_3d_iou_f1"))


@query("r20_depth_order_tau", f"""with {R}, {BOX} select uid, rollout_n, sign((2.0 - (4 + dz)) * (2.0-4.0))::double as tau, case when (o1>0.25)::int + (o2>0.25)::int = 0 then 0.0::double else 1.0 end as ordering_score from w""")
def depth_order(spark, sf_dir):
    return S.depth_order(boxes(spark, sf_dir), "boxes", "gold").select(*ROW, "tau", "ordering_score")


@query("r21_projection_consistency", f"""with {R}, x as (select *, pred/8.0::double as d from r),
  y as (select *, -1/(3+1e-8) ga, 1/(3+1e-8) gb, (d-1)/(3+1e-8) pa, (d+1)/(3+1e-8) pb from x),
  z as (select *, case when least(gb,pb)-greatest(ga,pa) <= 0 then 0 else (least(gb,pb)-greatest(ga,pa))/((gb-ga)+(pb-pa)-(least(gb,pb)-greatest(ga,pa))) end as iou from y)
  select uid, rollout_n, round(iou,6)+0.0 as r_proj, case when iou > 0.2 then 1.0::double else 0.0 end as r_depth_consistency from z""")
def projection(spark, sf_dir):
    camera = "array(named_struct('k', array(100D,0D,50D,0D,100D,50D,0D,0D,1D), 'extrinsic', array(1D,0D,0D,0D,0D,1D,0D,0D,0D,0D,1D,0D,0D,0D,0D,1D), 'width', 100, 'height', 100))"
    df = rows(spark, sf_dir, gold="array(array(0D,0D,4D,2D,2D,2D,0D,0D,0D))", boxes="array(array(pred/8D,0D,4D,2D,2D,2D,0D,0D,0D))", cams=camera)
    out = S.projection_consistency(S.box_match_eval(df, "boxes", "gold"), "boxes", "gold", "cams")
    return rounded(out.select(*ROW, "r_proj", "r_depth_consistency"))


@query("r22_point_reprojection", f"""with {R}, x as (select *, 10.0::double*l_linenumber + 50 - 100*(pred/10.0::double)/2 as u2, 60.0::double as v2, 10.0*l_linenumber + 50 + score as pu from r),
  y as (select *, sqrt(pow((pu - u2)/100, 2) + pow((65 - v2)/100, 2)) as dist from x)
  select uid, rollout_n, case when u2 >= 0 and u2 < 100 and dist <= 0.6 then round(exp(-dist/0.2),6) else 0 end as r_reprojection from y""")
def reprojection(spark, sf_dir):
    k = "array(100D,0D,50D,0D,100D,50D,0D,0D,1D)"
    df = rows(spark, sf_dir, u="10D*l_linenumber + 50", v="60D", z="2D", k=k, p1="array(1D,0D,0D,0D,0D,1D,0D,0D,0D,0D,1D,0D,0D,0D,0D,1D)",
              p2="array(1D,0D,0D,pred/10D,0D,1D,0D,0D,0D,0D,1D,0D,0D,0D,0D,1D)", pu="10D*l_linenumber + 50 + score", pv="65D")
    out = S.point_reprojection(df, "u", "v", "z", "k", "p1", "k", "p2", "pu", "pv", F.lit(100.0), F.lit(100.0))
    return rounded(out.select(*ROW, "r_reprojection"))


# The same boxes as text: three spellings that are right, then prose around one, an object without label, a word among the
# numbers, and a box that is too short.
SPELLED = r"""case l_linenumber
  when 1 then format_string('[{"bbox_3d": [%s, 0, %s, 2, 2, 2, 0, 0, 0], "label": "a}b"}, {"bbox_3d": [%s, 0, 2.0, 2, 2, 2], "label": "it\'s"}]', 100D + pred/4, 4 + l_linenumber, score/5)
  when 2 then format_string("[{'bbox_3d': [%s, 0, %s, 2.0, 2, 2, 0, 0, 0], 'label': 'a'},\n {'label': 'b', 'bbox_3d': [%s, -0.0, 2, 2, 2, 2, 0, 0, 0, 7]}]", 100D + pred/4, 4 + l_linenumber, score/5)
  when 3 then format_string(' [ {"bbox_3d":[%se0,0,%s,2e0,0.2E1,2,0,0,0],"label":"a","more":null} , {"label":"b","bbox_3d":[%s,0,2,2,2,2,0,0]} ] ', 100D + pred/4, 4 + l_linenumber, score/5)
  when 4 then format_string('Here they are: [{"bbox_3d": [%s, 0, %s, 2, 2, 2, 0, 0, 0], "label": "a"}, {"bbox_3d": [%s, 0, 2, 2, 2, 2, 0, 0, 0], "label": "b"}]', 100D + pred/4, 4 + l_linenumber, score/5)
  when 5 then format_string('[{"bbox_3d": [%s, 0, %s, 2, 2, 2, 0, 0, 0]}, {"bbox_3d": [%s, 0, 2, 2, 2, 2, 0, 0, 0], "label": "b"}]', 100D + pred/4, 4 + l_linenumber, score/5)
  when 6 then format_string('[{"bbox_3d": [%s, near, %s, 2, 2, 2, 0, 0, 0], "label": "a"}, {"bbox_3d": [%s, 0, 2, 2, 2, 2, 0, 0, 0], "label": "b"}]', 100D + pred/4, 4 + l_linenumber, score/5)
  else format_string('[{"bbox_3d": [%s, 0, %s, 2, 2], "label": "a"}, {"bbox_3d": [%s, 0, 2, 2, 2, 2, 0, 0, 0], "label": "b"}]', 100D + pred/4, 4 + l_linenumber, score/5) end"""


def spelled(spark, sf_dir, **more):
    return rows(spark, sf_dir, gold=GOLD, text=SPELLED, **more).drop("score")


@query("r19_box_reward_from_text", f"""with {R}, {BOX}, t as (select *, l_linenumber <= 3 as ok, case when l_linenumber <= 3 then (o1>0.25)::int + (o2>0.25)::int else 0 end as tp from w)
  select uid, rollout_n, ok::int::double as r_format, case when ok then round((o1+o2)/2,6) else 0.0 end as r_3d_iou, tp as tp_count, round(tp/2.0,6)::double as precision,
  round(tp/2.0,6)::double as r_3d_iou_f1, case when ok then sign((2.0 - (4 + dz)) * (2.0 - 4.0))::double end as tau, (tp > 0)::int::double as score from t""")
def box_reward(spark, sf_dir):
    out = S.spatial_box_reward(spelled(spark, sf_dir), "text", "gold")
    return rounded(out.select(*ROW, "r_format", "r_3d_iou", "tp_count", "precision", "r_3d_iou_f1", "tau", "score"))


@query("r19_boxes_anywhere_in_text", f"""with {R} select uid, rollout_n, case when l_linenumber in (6, 7) then 1 else 2 end as n_boxes,
  case when l_linenumber in (6, 7) then score/5 else 100 + pred/4.0::double end as first_x, 9 as width from r""")
def boxes_anywhere(spark, sf_dir):
    df = rows(spark, sf_dir, gold=GOLD, text=SPELLED).drop("score")
    out = S.boxes_from_text(df, "text", strict=False)
    return out.select(*ROW, F.size("boxes").alias("n_boxes"), F.get(F.get("boxes", F.lit(0)), F.lit(0)).alias("first_x"), F.size(F.get("boxes", F.lit(0))).alias("width"))


@query("r19_one_box_in_text", f"""with {R} select uid, rollout_n, case when l_linenumber = 6 then null else pred::double end as x, case when l_linenumber = 6 then null else l_linenumber::double end as w,
  case when l_linenumber in (1, 4) then 0.5::double when l_linenumber = 6 then null else 0.0 end as turn from r""")
def one_box(spark, sf_dir):
    text = r"""case l_linenumber when 1 then format_string('so {"center": [%s, 1, 2], "size": [1, 2, 3], "rotation": [0.5, 0, 0]} it is', pred)
      when 2 then format_string("{'x': %s, 'y': 1, 'z': 2, 'width': 2}", pred) when 3 then format_string('the box [%s, 1, 2, 3, 1, 1] fits', pred)
      when 4 then format_string('Center: (%s, 1, 2), size (4, 1, 1) and rotation: (0.5, 0, 0)', pred) when 5 then format_string('center (%s, 1,2); SIZE: (5, 1, 1)', pred)
      when 6 then format_string('at [%s, 1, 2], size unknown', pred) else format_string("{'bbox_3d': [%s, 1, 2, 7, 1, 1]}, not [9, 9, 9, 9, 9, 9]", pred) end"""
    df = rows(spark, sf_dir, text=text).withColumn("b", P.box_in_text(F.col("text")))
    return df.select(*ROW, F.col("b")[0].alias("x"), F.col("b")[3].alias("w"), F.col("b")[6].alias("turn"))


@query("r20_depth_order_from_text", f"""with {R} select uid, rollout_n, case when l_linenumber % 4 = 3 then null else sign((pred - 3.5) * (case when l_linenumber % 4 = 2 then -1 else 1 end))::double end as tau,
  case when l_linenumber % 4 = 3 then 1.0::double when (pred > 3) = (l_linenumber % 4 <> 2) then 1.0 else 0.0 end as score from r""")
def depth_from_text(spark, sf_dir):
    """Two boxes side by side whose order in depth follows pred; one response in four spells one box only."""
    text = """case when l_linenumber % 4 = 3 then '[{"bbox_3d": [0, 0, 3, 9, 9, 9], "label": "a"}]' else format_string('[{"bbox_3d": [0, 0, 3.5, 9, 9, 9], "label": "a"}, {"bbox_3d": [20, 0, %s, 9, 9, 9], "label": "b"}]', pred) end"""
    gold = "case when l_linenumber % 4 = 2 then array(array(0D,0D,5D,9D,9D,9D), array(20D,0D,4D,9D,9D,9D), array(1D)) else array(array(0D,0D,4D,9D,9D,9D), array(20D,0D,5D,9D,9D,9D)) end"
    out = S.spatial_box_reward(rows(spark, sf_dir, text=text, gold=gold).drop("score"), "text", "gold")
    return out.select(*ROW, "tau", "score")


@query("r21_projection_from_text", f"""with {R}, x as (select *, pred/8.0::double as d from r),
  y as (select *, -1/(3+1e-8) ga, 1/(3+1e-8) gb, (d-1)/(3+1e-8) pa, (d+1)/(3+1e-8) pb from x),
  z as (select *, case when least(gb,pb)-greatest(ga,pa) <= 0 then 0 else (least(gb,pb)-greatest(ga,pa))/((gb-ga)+(pb-pa)-(least(gb,pb)-greatest(ga,pa))) end as iou from y)
  select uid, rollout_n, case when l_linenumber = 5 then 0.0::double else round(iou,6)+0.0 end as r_proj, case when iou > 0.2 and l_linenumber <> 5 then 1.0::double else 0.0 end as r_depth_consistency from z""")
def projection_from_text(spark, sf_dir):
    camera = "array(named_struct('k', array(100D,0D,50D,0D,100D,50D,0D,0D,1D), 'extrinsic', array(1D,0D,0D,0D,0D,1D,0D,0D,0D,0D,1D,0D,0D,0D,0D,1D), 'width', 100, 'height', 100))"
    text = """format_string(if(l_linenumber = 5, 'no list: {"bbox_3d": [%s, 0, 4, 2, 2, 2]}', '[{"label": "box", "bbox_3d": [%s, 0, 4, 2, 2, 2]}]'), pred / 8D)"""
    df = rows(spark, sf_dir, gold="array(array(0D,0D,4D,2D,2D,2D,0D,0D,0D))", text=text, cams=camera).drop("score")
    return rounded(S.spatial_box_reward(df, "text", "gold", "cams").select(*ROW, "r_proj", "r_depth_consistency"))


@query("r22_point_from_text", f"""with {R} select uid, rollout_n, case when l_linenumber = 4 then null when l_linenumber = 3 then chr(65 + pred) || 'X' else chr(65 + pred) end as label,
  case when l_linenumber in (4, 5) then null else score end as u, case when l_linenumber in (4, 5) then null else 65.5::double end as v,
  case when pred < 3 and l_linenumber not in (3, 4) then 10.0::double * pred end as chosen_u from r""")
def point_from_text(spark, sf_dir):
    text = r"""case l_linenumber when 1 then format_string('The point is (%s, 65.5). Answer: %s', score, chr(65 + pred)) when 2 then format_string('it lies at [%s, 65.5], so %s.', score, lower(chr(65 + pred)))
      when 3 then format_string('{"answer": "%sx", "point": [%s, 65.5]}', lower(chr(65 + pred)), score) when 4 then '' when 5 then format_string('(%s) it is, not (1..2, 3)', chr(65 + pred))
      else format_string('b or (%s, 65.5)? The last: %s', score, chr(65 + pred)) end"""
    df = rows(spark, sf_dir, text=text).drop("pred_u")
    df = df.withColumn("points", F.create_map(*[x for i, c in enumerate("ABC") for x in (F.lit(c), F.array(F.lit(10.0 * i), F.lit(1.0)))]))
    own = S.point_from_text(df, "text").select(*ROW, "points", "text", F.col("pred_label").alias("label"), F.col("pred_u").alias("u"), F.col("pred_v").alias("v"))
    return S.point_from_text(own, "text", "points").select(*ROW, "label", "u", "v", F.col("pred_u").alias("chosen_u"))


@query("r17_actions_in_json", f"""with {R} select uid, rollout_n, case when l_linenumber = 4 then 0.0::double else round(((pred = l_linenumber)::int + (l_suppkey % 3 = l_partkey % 3)::int)/2.0, 6)::double end as reward from r""")
def trajectory_json(spark, sf_dir):
    fw = """format_string('plan {"actions": [{"type": "move", "direction": "forward", "distance": %s}, {"type": "turn", "direction": "clockwise", "angle": %s}], "n": 2} end', l_linenumber, 10 + 2 * (l_partkey % 3))"""
    bw = r"""format_string(if(l_linenumber = 4, "{'actions': [{'type': 'move'}, %s, %s]}", "{'actions': [{'type': 'turn', 'direction': 'Left', 'angle': %s}, {'type': 'move', 'direction': 'backward', 'distance': %s}]}"), 10 + 2 * (l_suppkey % 3), pred)"""
    return rows(spark, sf_dir, fw=fw, bw=bw).select(*ROW, r6(S.trajectory_cycle(F.col("fw"), F.col("bw"))).alias("reward"))


@query("r23_answer_agreement", f"with {R}, v as (select uid, pred, count(*) c from r group by 1,2) select uid, cast(sum(c) as bigint) as n, count(*) as answers, round(max(c)/sum(c),6) as agreement from v group by 1")
def agreement(spark, sf_dir):
    return rounded(E.answer_agreement(rollouts(spark, sf_dir), "uid", "pred"))


@query("j07_pairs_within_sample", f"""with {R}, {BOX} select uid, rollout_n, 1 as gold_of_first, 0 as gold_of_second, round(o1,6)+0.0 as first_overlap, round(o2,6)+0.0 as second_overlap from w""")
def pairs(spark, sf_dir):
    """Predicted against gold boxes of one sample, matched inside the sample's row."""
    m = lambda p: F.filter("matches", lambda x: x["pred"] == p)[0]
    return boxes(spark, sf_dir).select(*ROW, m(0)["gold"].alias("gold_of_first"), m(1)["gold"].alias("gold_of_second"),
                                       r6(m(0)["overlap"]).alias("first_overlap"), r6(m(1)["overlap"]).alias("second_overlap"))
