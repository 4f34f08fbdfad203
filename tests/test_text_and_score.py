"""Literal cases of preparation, scoring and evaluation."""

import pytest
from pyspark.sql import functions as F

from rewardloom.functions import spatial_text
from rewardloom.functions import text as X
from rewardloom.operators import evaluate as E
from rewardloom.operators import prep as P
from rewardloom.operators import reduce as M
from rewardloom.operators import score as S
from rewardloom.sources import files


def one(spark, expr, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("text,expected", [
    (r"a \boxed{1} b \boxed{\frac{1}{2}}", r"\frac{1}{2}"), (r"\boxed{x", None), ("none", None), (r"\boxed{}", ""),
    (r"\boxed{a{b}c} tail }", "a{b}c"),
])
def test_boxed(spark, text, expected):
    assert one(spark, X.boxed_answer(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text,expected", [
    ("\\dfrac12", "\\frac{1}{2}"), ("0.5", "\\frac{1}{2}"), ("3/4", "\\frac{3}{4}"), ("x = 5", "5"), (".5", "\\frac{1}{2}"),
    ("\\sqrt3", "\\sqrt{3}"), ("5\\text{ cm}", "5"), ("\\left(1, 2\\right)", "(1,2)"), ("10\\%", "10"), ("\\frac1{72}", "\\frac{1}{72}"),
])
def test_latex(spark, text, expected):
    assert one(spark, S.normalize_latex(F.col("t")), t=text) == expected


def test_flexible_number_falls_back_to_the_first_candidate(spark):
    assert one(spark, S.hash_prediction(F.col("t"), "flexible"), t="it is 12 . .") == "12"
    assert one(spark, S.hash_prediction(F.col("t"), "flexible"), t="no digits") is None


def test_format_rules(spark):
    good = "<think>Step 1: look</think><answer>B</answer>"
    assert one(spark, S.check_format(F.col("t")), t=good) == 1.0
    for bad in ("<answer>B</answer>", good + good, "<think>Step 1</think><answer></answer>", "<think></think><answer>B</answer>",
                "<think>Step 1 step 2 step 3 step 4 step 5 step 6 step 7</think><answer>B</answer>"):
        assert one(spark, S.check_format(F.col("t")), t=bad) == 0.0


@pytest.mark.parametrize("answer,truth,score", [
    ("<answer>C. tree</answer>", "C", 1.0), ("<answer>The answer is c</answer>", "C", 1.0), ("<answer>3.0000000001</answer>", "3", 1.0),
    ("<answer>left side</answer>", "left side", 1.0), ("<answer>7</answer>", "seven", 0.0), ("plain\nB", "B", 1.0),
])
def test_accuracy(spark, answer, truth, score):
    assert one(spark, S.score_accuracy(F.col("a"), F.col("t")), a=answer, t=truth) == score


def test_counterclockwise_reads_as_its_first_pattern(spark):
    for text, letter in (("The answer is B.", "B"), ("option A looks wrong; Answer: C", "C"), ("I select d", "D"), ("my choice: B", "B")):
        assert one(spark, S.extract_answer(F.col("t"), multiple_choice=True), t=text) == letter
    for text, letter in (("The answer is C", "C"), ("Option: b", "B"), ("D) text", "D"), ("c", "C")):
        assert one(spark, S.option_letter(F.col("t")), t=text) == letter
    steps = one(spark, S.trajectory_actions(F.col("t")), t="Rotates 30 degrees left, moves forward 2.5 meters and turns clockwise 90degrees.")
    assert [tuple(s) for s in steps] == [("move", "forward", 2.5), ("turn", "right", 90.0), ("turn", "left", 30.0)]
    assert one(spark, S.orientation_cycle(F.col("t"), F.lit('so {"angle": -12.5, "x": 1}')), t="12.5 Degrees") == 1.0
    assert one(spark, S.motion_direction(F.col("t")), t="It rolls counterclockwise") == "left"


def test_dense_prefix_reward_literals(spark):
    assert one(spark, S.dense_prefix_reward(F.col("r"), F.col("e")), r="", e="") == []
    got = one(spark, S.dense_prefix_reward(F.col("r"), F.col("e")), r="11,12,13", e="11,12")
    assert [round(x, 6) for x in got] == [round(1 / 6, 6)] * 5 + [0.0] * 3


def test_rotated_box_keeps_volume_overlap(spark):
    gold = F.array(F.array(*[F.lit(float(x)) for x in (0, 0, 0, 2, 2, 2, 0, 0, 0)]))
    turned = F.array(F.array(*[F.lit(float(x)) for x in (0, 0, 0, 2, 2, 2, 0, 3.141592653589793 / 2, 0)]))
    matches = one(spark, S.box_matches(turned, gold))
    assert len(matches) == 1 and abs(matches[0].overlap - 1.0) < 1e-9


def test_more_predictions_than_gold_match_in_prediction_order(spark):
    box = lambda x: F.array(*[F.lit(float(v)) for v in (x, 0, 0, 2, 2, 2, 0, 0, 0)])
    matches = one(spark, S.box_matches(F.array(box(9), box(0), box(1)), F.array(box(0), box(1))))
    assert [(m.pred, m.gold) for m in matches] == [(0, 1), (1, 0)]


def test_combined_reward_gates(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.4), (1.0, 1.0, 0.6), (0.0, 1.0, 1.0)], "f double, a double, xy double")
    out = S.combine_rewards(df, {"format": "f", "accuracy": "a", "spatial_xy": "xy"}).collect()
    assert [round(r.score, 6) for r in out] == [0.2, 0.8, 0.0]


def test_majority_ties_go_to_the_first_seen(spark):
    rows = [("s", 0, "A", 0.9), ("s", 1, "B", 0.8), ("s", 2, "B", 0.7), ("s", 3, "A", 0.6)]
    df = spark.createDataFrame(rows, "g string, i int, pred string, val double")
    assert E.majority_value(df, ["g"], "pred", "val", "i").first().majority == 0.9


def test_validation_metrics_literal(spark):
    rows = [("s1", "p1", 0, 0.8), ("s1", "p1", 1, 0.9), ("s2", "p2", 0, 0.7)]
    df = spark.createDataFrame(rows, "source string, uid string, i int, score double")
    got = {(r.source, r.metric): r.value for r in E.validation_metrics(df, "source", "uid", ["score"], "i", draws=200).collect()}
    assert abs(got[("s1", "mean@2")] - 0.85) < 1e-9 and got[("s2", "mean@1")] == 0.7 and ("s1", "best@2/mean") in got


def test_bootstrap_is_near_the_closed_form(spark):
    df = spark.createDataFrame([("g", i, float(i + 1), str(i % 2)) for i in range(5)], "g string, i int, v double, pred string")
    exact = E.best_worst_exact(df, ["g"], "v", 3).first()
    assert 3.5 < exact.best_mean < 5
    boot = {r.k: r for r in E.best_worst_bootstrap(df, ["g"], "v", "i", 2000).collect()}
    closed = {r.k: r for r in E.best_worst_exact(df, ["g"], "v").collect()}
    for k, r in boot.items():
        assert abs(r.best_mean - closed[k].best_mean) < 0.1 and abs(r.best_std - closed[k].best_std) < 0.1
        assert abs(r.worst_mean - closed[k].worst_mean) < 0.1


def test_majority_bootstrap_same_for_gathered_and_joined_groups(spark):
    df = spark.createDataFrame([("g", i, float(i), str(i % 3)) for i in range(7)], "g string, i int, v double, pred string")
    a = {r.k: (round(r.maj_mean, 9), round(r.maj_std, 9)) for r in E.majority_bootstrap(df, ["g"], "pred", "v", "i", 40).collect()}
    b = {r.k: (round(r.maj_mean, 9), round(r.maj_std, 9)) for r in E.majority_bootstrap(df, ["g"], "pred", "v", "i", 40, group_limit=2).collect()}
    assert a == b and set(a) == {2, 4, 7}


def test_unknown_role_and_media_mismatch_fail(spark):
    m = F.array(F.struct(F.lit("alien").alias("role"), F.lit("x").alias("content")))
    with pytest.raises(Exception, match="unknown role"):
        one(spark, P.normalize_roles(m))
    media = F.array(F.struct(F.lit("user").alias("role"), F.lit("<image>x").alias("content")))
    with pytest.raises(Exception, match="image count mismatch"):
        one(spark, P.split_content_parts(media, F.lit(2)))


def test_flatten_params_and_formats():
    assert files.flatten_params({"a": {"b": 1, "c": [2, 3]}, "d": 4}) == {"a/b": 1, "a/c/0": 2, "a/c/1": 3, "d": 4}
    assert files.detect_format(["x.tar"]) == "tar" and files.detect_format("y.jsonl") == "json"
    with pytest.raises(ValueError):
        files.detect_format("z.bin")


def test_logprob_difference_literal(spark):
    df = spark.createDataFrame([([-1.0, -2.0], [-1.5, -2.0], [1, 1]), ([-0.5, -9.0], [-0.4, -1.0], [1, 0])],
                               "p array<double>, q array<double>, mask array<int>")
    assert M.logprob_diff_metrics(df, "p", "q").first().valid == 1


@pytest.mark.parametrize(("text", "box"), [
    ("[1, 2, 3, 4, 5, 6]", [1, 2, 3, 4, 5, 6, 0, 0, 0]),
    ("a [1] and [1,2,3,4,5,6,7,8,9]", None),  # the first list decides
    ("[1 2, 2, 3, 4, 5, 6, 7]", None),
    ("\n[ 1 ,2,\t3,4,5,-6.5,7,8,9,10 ]", [1, 2, 3, 4, 5, -6.5, 7, 8, 9]),
    ('{"bbox_3d": [1, 2], "x": 1} {"bbox_3d": [1, 2, 3, 4, 5, 6e1]}', [1, 2, 3, 4, 5, 60, 0, 0, 0]),
    ("{'x': 1, 'y': 2, 'z': 3}", [1, 2, 3, 0, 0, 0, 0, 0, 0]),
    ("{'x': 1, 'y': 2}", None),
    ("CENTER (1, 2, 3) size: (1, 1, x)", None),
    ("", None), (None, None), ("[" * 5000 + "1," * 5000, None), ("[" + "1, " * 20_000 + "2]", [1] * 9),
])
def test_one_box_in_any_spelling(spark, text, box):
    got = spark.createDataFrame([(text,)], "t string").select(spatial_text.box_in_text(F.col("t"))).first()[0]
    assert got == box


@pytest.mark.parametrize(("text", "good"), [
    ('[{"bbox_3d": [1,2,3,4,5,6], "label": "x"}]', True), ("[{'bbox_3d': [1,2,3,4,5,6], 'label': 'it\"s'}]", True),
    ('[{"bbox_3d": [1,2,3,4,5,6], "label": "}, {"}]', True), ('[{"bbox_3d": [1,2,3,4,5,6], "label": "x"}] so', False),
    ('[{"bbox_3d": [1,2,3,4,5], "label": "x"}]', False), ('{"bbox_3d": [1,2,3,4,5,6], "label": "x"}', False), ("[]", False), ("", False), (None, False),
    ('[{"bbox_3d": [1,2,3,4,5,null], "label": "x"}]', False), ('[{"bbox_3d": [1,2,3,4,5,6], "label": "x"} {"bbox_3d": [1,2,3,4,5,6], "label": "y"}]', False),
    ("[" + ", ".join('{"bbox_3d": [1,2,3,4,5,6], "label": "x"}' for _ in range(3000)) + "]", True),
])
def test_form_of_a_list_of_boxes(spark, text, good):
    frame = spark.createDataFrame([(text,)], "t string").select(spatial_text.boxes_well_formed(F.col("t")).alias("ok"), F.size(spatial_text.boxes_in_text(F.col("t"))).alias("n")).first()
    assert frame.ok == good and (frame.n > 0) >= good


def test_actions_need_a_type_and_words_come_first(spark):
    rows = [('{"actions": [{"type": "move", "direction": "up", "distance": 2}, {"direction": "up"}]}',), ('moves up 3 m {"actions": [{"type": "turn"}]}',), ("nothing",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(S.trajectory_actions(F.col("t"))).collect()]
    assert [[tuple(a) for a in g or []] for g in got] == [[("move", "up", 2.0)], [("move", "up", 3.0)], [], []]


def test_overlap_in_the_image_is_found_by_the_batch(spark):
    from rewardloom.functions.projected import projected

    k, e = [100.0, 0.0, 50.0, 0.0, 100.0, 50.0, 0.0, 0.0, 1.0], [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    e = [float(x) for x in e]
    gold = [[0.0, 0.0, 4.0, 2.0, 2.0, 2.0], [3.0, 0.0, 6.0, 1.0, 2.0, 1.0, 0.1, 0.2, 0.3]]
    near = [[0.2, 0.1, 4.4, 2.0, 2.0, 2.0, 0.0, 0.3, 0.0], [3.0, 0.3, 6.0, 1.0, 1.0, 1.0]]
    odd = [[0.2, 0.1, 4.4, 2.0, 2.0, 2.0, None, 0.3, None], [3.0, 0.3, 6.0, 1.0, 1.0, 1.0, None, None, None]]
    cameras = [(k, e, 100, 100), (k, [*e[:3], 0.5, *e[4:]], 100, 80)]
    rows = [(0, near, gold, cameras), (1, odd, gold, cameras), (2, [], gold, cameras), (3, near, gold, []), (4, near, gold, None), (5, [[0.0, 0.0, -9.0, 2.0, 2.0, 2.0]], gold, cameras)]
    kinds = "id int, p array<array<double>>, g array<array<double>>, c array<struct<k:array<double>,extrinsic:array<double>,width:int,height:int>>"
    matched = S.box_match_eval(spark.createDataFrame(rows, kinds), "p", "g")
    matched = spark.createDataFrame(matched.collect(), matched.schema)
    quick = {r.id: r.q for r in matched.select("id", projected(F.col("p"), F.col("g"), F.col("matches"), F.col("c"), 0.2, 0.3).alias("q")).collect()}
    assert [quick[i] is None for i in range(6)] == [False, True, False, False, True, False]
    out = S.projection_consistency(matched, "p", "g", "c")
    assert "ArrowEvalPython" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: (r.r_proj, r.r_depth_consistency) for r in out.collect()}
    assert 0.2 < got[0][0] < 1 and 0 < got[0][1] < 1
    # a null angle is no turn; such a row is left to the expressions
    assert got[0] == tuple(quick[0])
    flat = [[v or 0.0 for v in b] for b in odd]
    same = S.projection_consistency(S.box_match_eval(spark.createDataFrame([(1, flat, gold, cameras)], kinds), "p", "g"), "p", "g", "c").first()
    assert got[1] == pytest.approx((same.r_proj, same.r_depth_consistency))
    assert got[2] == got[3] == got[5] == (0.0, 0.0)
