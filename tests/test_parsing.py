"""Rules for prompts and captions on single cases."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import parsing as P
from tallyframe.functions import text as T
from tallyframe.operators.color import color_scores

THINGS = {"car": "car", "auto": "car", "dog": "dog", "hot dog": "hot dog", "orange": "orange"}
COLORS = {"red": "red", "orange": "orange", "blue": "blue"}


def compiled(spark, prompts):
    t, c = T.mention_spans(THINGS), T.mention_spans(COLORS)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "i int, p string").withColumn("t", t("p")).withColumn("c", c("p"))
    rows = df.select("i", P.compile_prompt(F.col("p"), F.col("t"), F.col("c"), list(COLORS)).alias("x")).orderBy("i").collect()
    return [(r.x.object, r.x.color) for r in rows]


def test_prompt_targets(spark):
    cases = {
        "an orange car": ("car", "orange"),
        "the car IS red": ("car", "red"),
        "a hot dog": ("hot dog", None),
        "a car on a red road": ("car", None),
        "a red car and a dog": (None, None),
        "not a red car": (None, None),
        "a red auto, a blue car": ("car", None),
        "": (None, None),
    }
    assert dict(zip(cases, compiled(spark, cases), strict=True)) == cases
    assert compiled(spark, ["a red, car"]) == [("car", None)]


def test_color_support(spark):
    cases = {"a red car": "supported", "no red car": "negated_color", "no dog, but a red car": "supported", "a car near a red dog": "insufficient_color_evidence", "all red": "supported", "a car": "insufficient_color_evidence"}
    t, c = T.mention_spans(THINGS), T.mention_spans(COLORS)
    df = spark.createDataFrame([(x,) for x in cases], "p string").withColumn("t", t("p")).withColumn("c", c("p"))
    s = P.color_support(F.col("p"), F.lit("red"), F.lit("car"), F.col("t"), F.col("c"))
    assert {r.p: r.reason for r in df.select("p", s["reason"].alias("reason")).collect()} == cases


def test_color_scores(spark):
    frames = spark.createDataFrame([(1, 0, "succeeded"), (1, 1, "succeeded"), (2, 0, "failed"), (3, 0, "succeeded"), (4, 0, "succeeded")], "id long, frame int, status string")
    pairs = spark.createDataFrame([(1, 0, "exact", "auto", "a red car"), (1, 0, "exact", None, None), (3, 0, "exact", "car", "a car")], "id long, frame int, method string, object string, caption string")
    targets = spark.createDataFrame([(1, "car", "red"), (2, "car", "red"), (3, "car", "red"), (4, "yacht", "red"), (5, "car", "red")], "id long, target string, color string")
    run = lambda v: {r.id: (r.status, r.score) for r in color_scores(frames, pairs, targets, THINGS, COLORS, v).collect()}
    assert run("repair") == {1: ("succeeded", 0.5), 2: ("failed", None), 3: ("succeeded", 0.0), 4: ("unsupported", None), 5: ("failed", None)}
    assert run("binding_lexical")[1] == ("succeeded", 1.0) and run("binding_lexical")[3] == ("dropped_by_condition", None)
    assert run("binding")[1] == ("dropped_by_condition", None)  # "auto" is not "car" as written
    with pytest.raises(ValueError):
        run("other")


def test_color_variants_share_one_pass(spark, tmp_path):
    """All three variants equal the single ones, and the query reads its table no more often than one variant does."""
    spark.range(400).selectExpr("id DIV 4 AS l_orderkey", "cast(id % 4 AS int) AS l_linenumber", "id * 7 % 23 AS l_partkey", "id * 5 % 17 AS l_suppkey", "cast(id % 14 AS double) AS l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    from tallyframe.operators.color import VARIANTS, color_variants
    from tallyframe.plans import parsing

    tables = parsing.color_frames(spark, str(tmp_path))
    every = {r.id: r for r in color_variants(*tables, parsing.THINGS, parsing.COLORS).collect()}
    one = {v: color_scores(*tables, parsing.THINGS, parsing.COLORS, v) for v in VARIANTS}
    assert len(every) == 100 and len({r.repair.status for r in every.values()} | {r.binding_lexical.status for r in every.values()}) > 2
    for v, df in one.items():
        assert {r.id: tuple(r)[1:] for r in df.collect()} == {i: tuple(r[v]) for i, r in every.items()}
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert 0 < scans(parsing.color_scores(spark, str(tmp_path))) <= scans(one["repair"])


def test_relations_and_captions(spark):
    row = spark.range(1).select(
        P.relation_target(F.lit("A dog on the left of two cars, at night.")).alias("t"),
        P.relation_target(F.lit("a dog")).alias("none"),
        P.entity_target(F.lit("a dog and ")).alias("blank"),
        P.caption_phrase(F.lit("Close up of a Glass covering  it"), "close up of ").alias("c"),
        P.relation_prompt(F.lit("Dog"), F.lit("above"), F.lit("Car")).alias("p"),
        P.relation_prompt(F.lit("Dog"), F.lit("on"), F.lit("Car")).alias("q"),
    ).first()
    assert tuple(row.t) == ("dog", "left", "car") and row.none is None and row.blank == []
    assert (row.c, row.p, row.q) == ("a glass", "The dog is above the car.", None)


def test_actions(spark):
    v = spark.createDataFrame([(0, "clean and jerk"), (1, "riding mule"), (2, "riding a bike")], "ordinal int, label string")
    a = spark.createDataFrame([("cycling", "riding a bike"), ("jerk", "clean and jerk"), ("jerk", "riding mule")], "alias string, label string")
    cases = [
        ("A person is clean and jerk and cycling.", ["other"], ["clean and jerk", "riding a bike"], "complete_prompt_contract"),
        ("A person is jerk", ["riding a big mule"], ["other"], "scoped_prompt_contract"),  # two classes
        ("A person is dancing", ["riding a big mule", "riding MULE", "flying"], ["riding mule", "other"], "model_output"),
        ("A person is dancing", None, None, "invalid_model_output"),
        ("A person is dancing", [" "], None, "invalid_model_output"),
        ("", ["cycling"], ["riding a bike"], "model_output"),
        ("A person is dancing and singing", [], [], "model_output"),
    ]
    rows = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "id int, prompt string, actions array<string>")
    got = {r.id: (r.target, r.method) for r in P.compile_actions(rows, v, a).collect()}
    assert got == {i: c[2:] for i, c in enumerate(cases)}
    loose = {r.id: (r.target, r.reasons) for r in P.compile_actions(rows, v, a, guard=False).collect()}
    assert loose[5] == (["riding a bike"], []) and loose[6][0] == []


def test_names_are_normalised_once_and_dealt_to_tasks(spark, tmp_path):
    """The plans of names grow with their rules, not with how often a value stands in them."""
    df = spark.createDataFrame([("the Red Boxes",)], "q string")
    for rule, most in ((T.canonical_entity, 1), (T.head_noun, 1), (P.entity_target, 1), (lambda c: T.span_support(c, c), 2)):
        plan = df.select(rule(F.col("q")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"(?U)[\s\x1c-\x1f]+") <= most, rule
    spark.range(50).selectExpr("id AS p_partkey", "concat('small ring ', id) AS p_name").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    from tallyframe.plans.parsing import entity_targets

    assert entity_targets(spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
