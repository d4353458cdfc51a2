"""Frame slots, corrupt boxes and neighbours in the semantic scores."""

from pyspark.sql import functions as F

from tallyframe.operators import semantic as V

DETECTIONS = "array<array<struct<label:string,box:array<double>>>>"
A, B = ("dog", [0.0, 0.0, 10.0, 10.0]), ("cat", [20.0, 0.0, 30.0, 10.0])


def score(spark, column, **rows):
    kinds = ", ".join(f"{k} {t}" for k, (t, _) in rows.items())
    return spark.createDataFrame([tuple(v for _, v in rows.values())], kinds).select(column.alias("s")).first().s


def objects(spark, frames, entities=("dog",)):
    return score(spark, V.objects_score(F.col("e"), F.col("f")), e=("array<string>", list(entities)), f=(DETECTIONS, frames))


def test_objects_need_a_neighbour(spark):
    s = objects(spark, [[A], [A], [B], [A]])
    assert (s.score, s.coverage, s.abstention, s.missing, s.status) == (2 / 16, 4 / 16, 1 / 16, 12 / 16, "partial")
    both = objects(spark, [[A]] + [[]] * 14 + [[A]])  # the first and the last slot are no neighbours
    assert (both.score, both.abstention, both.coverage, both.status) == (0, 2 / 16, 1, "ok")
    full = objects(spark, [[A, B]] * 16, ("dog", "cat"))
    assert (full.score, full.status) == (1, "ok")
    assert objects(spark, [[A]], ()) is None


def test_corrupt_boxes_make_a_slot_missing(spark):
    flat = ("bird", [0.0, 0.0, 0.0, 5.0])
    s = objects(spark, [[A], [A, flat], [A]])
    assert (s.score, s.coverage, s.abstention) == (0, 2 / 16, 2 / 16)
    for bad in (("", A[1]), ("dog", [0.0, 1.0]), ("dog", [0.0, 0.0, float("nan"), 1.0]), ("dog", None), (None, A[1])):
        assert objects(spark, [[bad]]).coverage == 0


def test_spatial_takes_the_best_pair(spark):
    triples = "array<struct<subject:string,relation:string,object:string>>"
    run = lambda frames, t: score(spark, V.spatial_score(F.col("t"), F.col("f")), t=(triples, t), f=(DETECTIONS, frames))
    assert run([[A, B]], [("dog", "left", "cat")]).score == 1 / 16
    assert run([[A, B]], [("cat", "left", "dog")]).score == 0
    assert run([[A, B], None, [B]], [("dog", "left", "cat"), ("cat", "right", "dog")]).score == 1 / 16
    far = ("bird", [0.0, 0.0, 0.0, 0.0])  # corrupt, but no relation names it
    assert run([[A, B, far]], [("dog", "left", "cat")]).coverage == 1 / 16
    s = run([[A, ("cat", [20.0, 0.0, 20.0, 10.0])]], [("dog", "left", "cat")])
    assert (s.score, s.coverage, s.missing) == (0, 0, 1)
    assert run([[A]], [("dog", "left", "dog")]).score == 0  # one detection is no pair


def test_action_threshold_and_abstention(spark):
    run = lambda acts, p: score(spark, V.action_score(F.col("a"), F.col("l"), F.col("p")), a=("array<string>", acts), l=("array<string>", ["run", "jump"]), p=("array<double>", p))
    assert run(["run"], [0.84996, 0.1]).score == 1 and run(["run"], [0.84994, 0.1]).score == 0
    s = run(["run", "other"], [0.9, 0.1])
    assert (s.score, s.abstention, s.known_class_score) == (0.5, 0.5, 1)


def test_scene_and_labels(spark):
    s = score(spark, V.scene_score(V.scene_labels(F.array(F.lit("sea")), F.col("c"))), c=("array<string>", ["the sea", "a road", None]))
    assert (s.score, s.coverage, s.missing, s.status) == (1 / 16, 2 / 16, 14 / 16, "partial")
    s = score(spark, V.scene_score(F.col("x")), x=("array<string>", ["supported", "insufficient", "?"]))
    assert (s.score, s.coverage, s.abstention) == (1 / 16, 2 / 16, 1 / 16)
    s = score(spark, V.labels_score(F.col("e"), F.col("f")), e=("array<string>", ["a", "b"]), f=("array<array<string>>", [["a", "b"], ["a"], None]))
    assert (s.score, s.coverage) == (1 / 16, 2 / 16)
