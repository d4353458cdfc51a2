import math

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import scores as S
from tallyframe.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_text_normalisers(spark):
    r = one(
        spark,
        space=T.normalize_space(F.lit("  a\t b\n c ")),
        phrase=T.normalize_phrase(F.lit(" (The  Dog!) ")),
        tokens=T.phrase_tokens(F.lit("It's 2 Dogs")),
        blank=T.word_count(F.lit(" \n ")),
        words=T.word_count(F.lit("a b  c")),
        relaxed=T.relaxed_key(F.lit("The well-known  A-frame")),
        label=T.filename_label(F.lit("x/Person is playing flute-3.mp4")),
        key=T.token_key(F.lit("Déjà-vu, x")),
    )
    assert (r.space, r.phrase, r.tokens) == ("a b c", "the dog", ["it", "s", "2", "dogs"])
    assert (r.blank, r.words, r.relaxed, r.label, r.key) == (0, 3, "well known frame", "playing flute", "déjà vu x")


@pytest.mark.parametrize("word,stem", [("people", "person"), ("bus", "bus"), ("ponies", "pony"), ("leaves", "leaf"), ("running", "run"), ("walking", "walk"), ("boxes", "box"), ("houses", "house"), ("horses", "horse"), ("adding", "add"), ("seeing", "see"), ("falling", "fal"), ("circus", "circus"), ("knives", "knife"), ("analysis", "analysis"), ("boss", "boss"), ("wings", "wing"), ("string", "str"), ("ring", "ring"), ("eggs", "egg"), ("toes", "to"), ("indices", "index"), ("glass", "glass"), ("cats", "cat")])
def test_stem(spark, word, stem):
    assert one(spark, s=T.stem(F.lit(word))).s == stem


def test_span_support_ladder(spark):
    p = F.lit("two dogs are running near the old red house")
    got = one(spark, a=T.span_support(p, F.lit("red house")), b=T.span_support(p, F.lit("dog")), c=T.span_support(p, F.lit("house dogs")), d=T.span_support(p, F.lit("big red old house")), e=T.span_support(p, F.lit("cat")))
    assert tuple(got) == ("exact", "morph", "tokens", "partial", "none")


@pytest.mark.parametrize("prompt,phrase,support", [("a red-ball", "red ball", "morph"), ("two (dogs)", "(dogs)", "exact"), ("a catalog", "cat", "none"), ("x", " ,. ", "none"), ("a+b is c", "a+b", "exact"), ("été 2", "été", "exact"), ("people run", "a person", "none"), ("two people running", "people run", "morph")])
def test_span_support_of_odd_phrases(spark, prompt, phrase, support):
    assert one(spark, s=T.span_support(F.lit(prompt), F.lit(phrase))).s == support


def test_names_and_heads(spark):
    cases = [("two wooden benches", "wooden bench", "wooden bench"), ("a man in a blue shirt", "man in a blue shirt", "man"), ("the", "the", "the"), ("A pair", "a pair", "a pair"), ("holding hands", "holding hand", "hold"), ("", "", ""), ("a stack of books", "stack of book", "stack")]
    got = spark.createDataFrame([(c[0],) for c in cases], "t string").select("t", T.canonical_entity(F.col("t")).alias("e"), T.head_noun(F.col("t")).alias("h")).collect()
    assert [tuple(r) for r in got] == cases
    kept, gone = T.dedup_in_order(F.array(*map(F.lit, ("The  dog", " the dog.", "", "cat", "!?"))))
    assert tuple(one(spark, k=kept, n=gone)) == (["The dog", "cat"], 3)
    assert one(spark, r=T.normalize_relation(F.lit(" Left "))).r == "on the left of" and one(spark, r=T.normalize_relation(F.lit(None).cast("string"))).r is None
    with pytest.raises(Exception, match="unsupported spatial relationship"):
        one(spark, r=T.normalize_relation(F.lit("over")))


@pytest.mark.parametrize("prompt,target", [("The camera pans as a dog runs", "both"), ("camera", "unknown"), ("slow zoom", "camera"), ("a cat sniffing", "subject"), ("Someone Climbing", "subject"), ("dynamic colours", "generic"), (None, "unknown"), ("a cat\njumps", "unknown")])
def test_motion_targets(spark, prompt, target):
    assert one(spark, m=T.motion_target(F.lit(prompt).cast("string"))).m == target


def test_bucket_edges_and_rates(spark):
    got = spark.createDataFrame([(14,), (15,), (400,), (401,)], "n int").select(T.length_bucket(F.col("n"))).collect()
    assert [r[0] for r in got] == ["1-14", "15-49", "201-400", "401+"]
    r = one(spark, a=T.rate(F.lit("15/2")), b=T.rate(F.lit("24")), c=T.rate(F.lit("1/0")), d=T.rate(F.lit("x")))
    assert tuple(r) == (7.5, 24.0, None, None)


def test_paths_and_targets(spark):
    r = one(spark, a=T.safe_relative(F.lit("a/b")), b=T.safe_relative(F.lit("/a")), c=T.safe_relative(F.lit("a/../b")), d=T.motion_target(F.lit("The camera pans as a man runs")), e=T.rewrite_aliases(F.lit("a motor bike and bike"), [("bike", "bicycle"), ("motor bike", "motorcycle")]))
    assert tuple(r) == ("a/b", None, None, "both", "a motorcycle and bicycle")


def test_unicode_functions(spark):
    df = spark.createDataFrame([("Straße  X",), (None,)], "t string").select(T.casefold_key("t"), T.nfkc_key("t"))
    assert [tuple(r) for r in df.collect()] == [("strasse x", "strasse x"), (None, None)]


def box(*x):
    return F.array(*(F.lit(float(v)) for v in x))


def test_boxes(spark):
    a, b = box(0, 0, 2, 2), box(1, 1, 3, 3)
    r = one(spark, iou=S.box_iou(a, b), none=S.box_iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), left=S.position_score(F.lit("left"), a, box(10, 0, 12, 2), True), right=S.position_score(F.lit("right"), a, box(10, 0, 12, 2), True), free=S.position_score(F.lit("right"), a, box(10, 0, 12, 2), False), tie=S.position_score(F.lit("left"), a, b, True), m=S.mirror(box(1, 0, 3, 2), F.lit(10.0)))
    assert r.iou == pytest.approx(1 / 7) and r.none == 0.0
    assert (r.left, r.right, r.free, r.tie, r.m) == (1.0, 0.0, 1.0, 0.0, [7.0, 0.0, 9.0, 2.0])


def test_scores(spark):
    v = F.array(F.lit(0.2), F.lit(0.8))
    r = one(spark, soft=S.softmin(v, 10.0), blend=S.condition_blend(v, 0.5), cal=S.calibrated(F.lit(0.4), 2.0), dis=S.discontinuity_score(F.lit(1.0)), n=S.needed_frames(F.lit(10)), tie=S.outcome(F.lit(-0.5), 0.5), up=S.outcome(F.lit(0.6), 0.5))
    assert r.soft == pytest.approx(-math.log((math.exp(-2) + math.exp(-8)) / 2) / 10)
    assert (r.blend, r.cal, r.n, r.tie, r.up) == (pytest.approx(0.35), 0.0, 2, 0.5, 1.0)
    assert r.dis == pytest.approx(math.exp(-1))


def test_null_is_not_zero(spark):
    df = spark.createDataFrame([(0.0, "succeeded"), (1.0, "failed"), (float("nan"), "succeeded"), (None, "succeeded")], "s double, st string")
    assert [r[0] for r in df.select(S.finite_score(F.col("s"), F.col("st"))).collect()] == [0.0, None, None, None]


def test_predicates(spark):
    labels, good = F.array(F.lit("run"), F.lit("walk")), F.array(F.lit(0.84994), F.lit(0.84996))
    r = one(spark, a=S.any_of_top(labels, good, F.lit("run")), b=S.any_of_top(labels, good, F.lit("walk")), c=S.enough_moves(F.array(F.lit(1.0)), 0.5, F.lit(0)), d=S.enough_moves(F.array().cast("array<double>"), 0.5, F.lit(0)), e=S.status_fold(F.array(F.lit("verified"), F.lit("failed"), F.lit("blocked"))), f=S.all_substrings(F.array(F.lit("sea"), F.lit("side")), F.lit("by the seaside")))
    assert tuple(r) == (False, True, True, False, "failed", True)


def test_mentions_take_the_longest(spark):
    find = T.mentions_udf({"dog": "dog", "hot dog": "hot dog", "cat": "cat"})
    df = spark.createDataFrame([("A hot dog, a Dog and concat",), (None,)], "t string").select(find("t"))
    assert [r[0] for r in df.collect()] == [["hot dog", "dog"], None]
