"""Queries that read prompts and captions by rule, with their SQL.

Prompts are made from the names of parts, so that every rule finds and misses something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import parsing as P
from tallyframe.functions import text as T
from tallyframe.operators import color as L
from tallyframe.plans.queries import _quoted, stem_sql
from tallyframe.plans.registry import query, read, spread


def _filled(spark: SparkSession, d: str, patterns: tuple[str, ...]) -> DataFrame:
    """(p_partkey, k, q): every pattern with the part's name in it."""
    made = F.array(*(F.replace(F.lit(n), F.lit("%s"), F.col("p_name")) for n in patterns))
    return spread(read(spark, d, "part", "p_partkey", "p_name"), "p_partkey").select("p_partkey", F.posexplode(made).alias("k", "q"))


def _filled_sql(patterns: tuple[str, ...]) -> str:
    return f"q AS (SELECT p_partkey, k, replace([{_quoted(patterns)}][k + 1], '%s', p_name) AS q FROM part, range({len(patterns)}) AS r(k))"


def _entity_sql(x: str) -> str:
    phrase = f"lower(trim(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' .,;:!?()'))"
    ws = f"string_split(regexp_replace({phrase}, '^(?:(?:{'|'.join(T.DETERMINERS)})(?: |$))+', ''), ' ')"
    return f"list_transform([{ws}], lambda ws: CASE WHEN ws = [''] THEN {phrase} ELSE array_to_string(list_append(ws[1:-2], {stem_sql('ws[-1]')}), ' ') END)[1]"


RELATION_PROMPTS = ("The %ss on the left of three boxes, outdoors.", "A bus on the top of THE %ss", "%s on the bottom of a %s on the right of glass.", "%s near a wall", "on the right of,")


@query(f"""WITH {_filled_sql(RELATION_PROMPTS)},
f AS (SELECT *, CASE {' '.join(f"WHEN contains(lower(q), '{w}') THEN '{w}'" for w in P.RELATION_PHRASES.values())} END AS w FROM q),
s AS (SELECT *, left(lower(q), instr(lower(q), w) - 1) AS a, string_split(substr(lower(q), instr(lower(q), w) + length(w)), ',')[1] AS b FROM f)
SELECT p_partkey, k::INT AS k, CASE w {' '.join(f"WHEN '{w}' THEN '{n}'" for n, w in P.RELATION_PHRASES.items())} END AS relation, CASE WHEN w IS NOT NULL THEN {_entity_sql('a')} END AS subject, CASE WHEN w IS NOT NULL THEN {_entity_sql('b')} END AS thing FROM s""")
def relation_targets(spark, d):  # C23
    t = _filled(spark, d, RELATION_PROMPTS).withColumn("t", P.relation_target(F.col("q")))
    return t.select("p_partkey", "k", F.col("t.relation").alias("relation"), F.col("t.subject").alias("subject"), F.col("t.object").alias("thing"))


ENTITY_PROMPTS = ("A %s and two buses, and a dog.", "the %ss", "%s and  and boxes", "Children and %s and the %ss...")


@query(f"""WITH {_filled_sql(ENTITY_PROMPTS)},
e AS (SELECT p_partkey, k, list_transform(string_split(rtrim(string_split(lower(q), ',')[1], '.'), ' and '), lambda x: {_entity_sql('x')}) AS e FROM q)
SELECT p_partkey, k::INT AS k, CASE WHEN len(e) >= 2 AND len(list_filter(e, lambda x: x = '')) = 0 THEN array_to_string(e, '|') ELSE '' END AS entities FROM e""")
def entity_targets(spark, d):  # C23
    return _filled(spark, d, ENTITY_PROMPTS).select("p_partkey", "k", F.array_join(P.entity_target(F.col("q")), "|").alias("entities"))


@query(f"""SELECT p_partkey, CASE p_size % 5 {' '.join(f"WHEN {i} THEN replace(replace('{s}', '{{subject}}', lower(p_type)), '{{object}}', p_name)" for i, s in enumerate(P.RELATION_TEMPLATES.values()))} END AS prompt, regexp_matches(lower(p_name), '^[^ ]*ing( |$)') AS gerund FROM part""")
def relation_prompts(spark, d):  # C28
    relation = F.get(F.array(*(F.lit(x) for x in [*P.RELATION_TEMPLATES, "near"])), F.col("p_size") % 5)
    return read(spark, d, "part").select("p_partkey", P.relation_prompt(F.col("p_type"), relation, F.col("p_name")).alias("prompt"), P.gerund_label(F.col("p_name")).alias("gerund"))


CAPTIONS = ("A close up of a %s covering a wall", "%s surrounded by grass", "a view of the tower contains %s", "the close up of a %s coveringly placed", "  %s ")
VIEWPOINT = r"(?:a |the )?(?:close up|view) of (?:a |the )?"


@query(rf"""WITH {_filled_sql(CAPTIONS)}, p AS (SELECT *, trim(regexp_replace(lower(q), '^{VIEWPOINT}', '')) AS p FROM q)
SELECT p_partkey, k::INT AS k, p AS phrase, rtrim(regexp_replace(p, '\s+(?:covering|covers|containing|contains|covered\s+(?:by|with|in)|surrounded\s+by)\b.*$', '')) AS head FROM p""")
def caption_phrases(spark, d):  # C31
    return _filled(spark, d, CAPTIONS).select("p_partkey", "k", P.caption_phrase(F.col("q"), VIEWPOINT, cut=False).alias("phrase"), P.caption_phrase(F.col("q"), VIEWPOINT).alias("head"))


DIRECTIONS = ("left", "under", "on", "over", "near", "below")


@query(f"""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS n, 'c' || (l_partkey % 2) AS s, [{_quoted(DIRECTIONS)}][l_suppkey % 6 + 1] AS r, 'c' || (l_suppkey % 3) AS o FROM lineitem),
m AS (SELECT *, CASE WHEN r IN ('under', 'below') THEN 'below' WHEN r = 'over' THEN 'above' WHEN r = 'on' AND o = 'c1' THEN 'below' WHEN r = 'on' AND o = 'c2' THEN 'above' ELSE r END AS t FROM r),
f AS (SELECT id, s, t, o, min({{'n': n, 's': s, 'r': r, 'o': o}}) AS n FROM m WHERE t IN ('left', 'above', 'below') GROUP BY ALL)
SELECT i.id, coalesce(a.kept, '') AS kept, coalesce(b.omitted, '') AS omitted FROM (SELECT DISTINCT id FROM r) i LEFT JOIN (SELECT id, string_agg(s || ' ' || t || ' ' || o, '|' ORDER BY n) AS kept FROM f GROUP BY 1) a USING (id)
LEFT JOIN (SELECT id, string_agg(s || ' ' || r || ' ' || o, '|' ORDER BY n, s, r, o) AS omitted FROM m WHERE t NOT IN ('left', 'above', 'below') GROUP BY 1) b USING (id)""")
def direction_relations(spark, d):  # C33: "on" is settled by what the prompt says of c1 and c2
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    word = lambda c, m: F.concat(F.lit("c"), (F.col(c) % m).cast("string"))
    name = F.get(F.array(*(F.lit(x) for x in DIRECTIONS)), (F.col("l_suppkey") % 6).cast("int"))
    one = F.struct("l_linenumber", word("l_partkey", 2).alias("subject"), name.alias("relation"), word("l_suppkey", 3).alias("object"))
    r = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("r"))  # the lines of an order, seven at most
    t = r.withColumn("t", P.four_directions(F.lit("Something on the bottom of c1 and ON TOP of the c2."), F.col("r")))
    line = lambda x: F.concat_ws(" ", x["subject"], x["relation"], x["object"])
    return t.select("id", F.array_join(F.transform("t.relationships", line), "|").alias("kept"), F.array_join(F.transform("t.omitted", line), "|").alias("omitted"))


# ---- colours: the last word of a part's name is a thing, some first words are colours -------

THINGS = {x: x for x in ("ring", "widget", "bolt", "gear", "nut", "orange")} | {"sprocket": "gear"}
COLORS = {x: x for x in ("red", "blue", "green", "orange")} | {"crimson": "red"}
COLOR_PROMPTS = ("a %s", "the %s is crimson", "a %s and a blue ring", "an orange %s", "no %s here", "%s in a green room", "an orange gear")
_thing = "regexp_extract(p_name, '(ring|widget|bolt|gear|nut)$', 1)"
_color = "regexp_extract(p_name, '^(red|blue|green) ', 1)"


@query(f"""WITH p AS (SELECT p_partkey, k, nullif({_thing}, '') AS t, nullif({_color}, '') AS c FROM part, range(7) AS r(k)),
o AS (SELECT *, CASE k WHEN 2 THEN CASE WHEN t IS NULL OR t = 'ring' THEN 'ring' END WHEN 3 THEN CASE WHEN t IS NULL THEN 'orange' END WHEN 4 THEN NULL WHEN 6 THEN 'gear' ELSE t END AS object FROM p)
SELECT p_partkey, k::INT AS k, object, CASE WHEN object IS NULL OR k = 3 THEN NULL WHEN k = 1 THEN CASE WHEN c IS NULL OR c = 'red' THEN 'red' END
       WHEN k = 2 THEN CASE WHEN c IS NULL OR t IS NULL OR c = 'blue' THEN 'blue' END WHEN k = 6 THEN 'orange' ELSE c END AS color FROM o""")
def prompt_targets(spark, d):  # C21
    things, colors = T.mention_spans(THINGS), T.mention_spans(COLORS)
    q = _filled(spark, d, COLOR_PROMPTS).withColumn("things", things("q")).withColumn("colors", colors("q"))
    t = q.select("p_partkey", "k", P.compile_prompt(F.col("q"), F.col("things"), F.col("colors"), list(COLORS.values())).alias("t"))
    return t.select("p_partkey", "k", F.col("t.object").alias("object"), F.col("t.color").alias("color"))


COLOR_CAPTIONS = ("a red gear", "the gear is crimson", "a gear beside a red wall", "no red gear", "a blue gear, but red gear", "a gear")
_STATES = ("supported", "supported", "unbound", "negated", "supported", "none")
_USABLE = (True, True, False, False, True, False)


def color_frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An order is a clip, its lines are frames; a line pairs one caption with one detection."""
    li = read(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    id_, frame = F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("frame")
    status = F.when((F.col("l_quantity") == 13) & (F.col("l_partkey") % 2 == 0), "failed").otherwise("succeeded")
    pick = lambda xs, c: F.get(F.array(*(F.lit(x) for x in xs)), (F.col(c) % len(xs)).cast("int"))
    pairs = li.select(id_, frame, pick(("exact", "ambiguous", "exact"), "l_linenumber").alias("method"), pick(("gear", "sprocket", "bolt"), "l_partkey").alias("object"), pick(COLOR_CAPTIONS, "l_suppkey").alias("caption"))
    frames = li.groupBy(id_, frame).agg(F.max(status == "failed").alias("bad"))
    frames = frames.select("id", "frame", F.when(F.col("bad"), "failed").otherwise("succeeded").alias("status"))
    targets = li.select(id_).distinct().select("id", F.lit("gear").alias("target"), F.lit("red").alias("color"))
    return frames, pairs, targets


@query(f"""WITH l AS (SELECT l_orderkey AS id, l_linenumber AS frame, l_quantity = 13 AND l_partkey % 2 = 0 AS bad, l_linenumber % 3 = 1 AS amb, l_partkey % 3 < 2 AS hit, l_partkey % 3 = 0 AS plain, (l_suppkey % 6)::INT AS s FROM lineitem),
f AS (SELECT id, frame, bool_or(bad) AS bad, bool_or(amb) AS amb, bool_or(hit) AS there, bool_or(hit AND [{_quoted(_STATES)}][s + 1] = 'supported') AS sup, bool_or(hit AND {list(_USABLE)}[s + 1]) AS use,
             bool_or(plain) AS pthere, bool_or(plain AND s NOT IN (1, 5)) AS psup FROM l GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN bad THEN 'runtime_failure' WHEN sup THEN 'supported' WHEN amb THEN 'ambiguous_binding' WHEN there THEN 'insufficient_color_evidence' ELSE 'no_target_detection' END AS reason FROM f),
a AS (SELECT id, count(*) AS frames, count_if(bad) AS failures, count_if(sup AND NOT bad) AS successes, count_if(use AND NOT bad) AS conditional, count_if(psup AND NOT bad) AS plain_successes,
      count_if(reason = 'ambiguous_binding') AS ambiguous, count_if(reason = 'insufficient_color_evidence') AS insufficient, count_if(reason = 'no_target_detection') AS absent FROM g GROUP BY 1)
SELECT id, frames, failures, successes, conditional, ambiguous, insufficient, absent, CASE WHEN failures > 0 THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN failures = 0 THEN round(successes / frames, 6) END AS score,
       CASE WHEN failures > 0 THEN 'failed' WHEN conditional = 0 THEN 'dropped_by_condition' ELSE 'succeeded' END AS lexical_status, CASE WHEN failures = 0 AND conditional > 0 THEN round(successes / conditional, 6) END AS lexical_score,
       CASE WHEN failures = 0 AND plain_successes > 0 THEN 1.0::DOUBLE END AS plain_score FROM a""")
def color_scores(spark, d):  # F08, C22: all three denominators
    frames, pairs, targets = color_frames(spark, d)
    both = L.color_variants(frames, pairs, targets, THINGS, COLORS)
    full = both.select("id", "repair.*", F.col("binding_lexical.status").alias("lexical_status"), F.round("binding_lexical.score", 6).alias("lexical_score"), F.col("binding.score").alias("plain_score"))
    return full.withColumn("score", F.round("score", 6)).drop("conditional_rate", "lower_bound")


# ---- classes of actions -------------------------------------------------------------------

CLASSES = ("climbing tree", "climbing a rope", "clean and jerk", "riding a bike", "riding mule", "petting animal (not cat)", "drumming", "washing dishes")
ALIASES = {"cycling": "riding a bike", "doing the dishes": "washing dishes", "playing drums": "drumming"}
PHRASES = ("climbing a tall tree", "The Climbing Tree", "cycling", "climbing rope", "riding big trees", "dishes", "washing %s dish", "%s tree climbing", "riding a tall %s mule", "a drumming.", "")


def _vocabulary(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame(list(enumerate(CLASSES)), "ordinal int, label string"), spark.createDataFrame(list(ALIASES.items()), "alias string, label string")


_VOCABULARY_SQL = f"""v AS (SELECT k AS o, label, lower(trim(label, ' .,;:!?()')) AS key FROM (SELECT unnest([{_quoted(CLASSES)}]) AS label, unnest(range({len(CLASSES)})) AS k)),
a AS (SELECT unnest([{_quoted(ALIASES)}]) AS key, unnest([{_quoted(ALIASES.values())}]) AS label)"""
_bare_sql = lambda x: f"trim(regexp_replace(regexp_replace({x}, '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
_stems_sql = lambda x: f"list_transform(regexp_extract_all({x}, '[a-z0-9]+'), lambda w: {stem_sql('w')})"


@query(f"""WITH {_filled_sql(PHRASES)}, {_VOCABULARY_SQL}, p AS (SELECT DISTINCT lower(trim(trim(q), ' .,;:!?()')) AS key FROM q),
x AS (SELECT key, {_bare_sql('key')} AS bare, {_stems_sql('key')} AS st FROM p), w AS (SELECT o, label, key, {_bare_sql('key')} AS bare, {_stems_sql('key')} AS st FROM v),
c AS (SELECT p.key, 0 AS r, 0 AS n, -o AS o, label FROM p JOIN v ON v.key = p.key UNION ALL SELECT p.key, 1, 0, 0, label FROM p JOIN a ON a.key = p.key
      UNION ALL SELECT x.key, 2, 0, -o, label FROM x JOIN w ON w.key = x.bare UNION ALL SELECT x.key, 3, 0, -o, label FROM x JOIN w ON w.bare = x.bare
      UNION ALL SELECT x.key, 4, -len(w.st), o, label FROM x JOIN w ON len(x.st) >= 2 AND len(w.st) >= 2 AND x.st[-1] = w.st[-1] AND list_has_all(x.st, w.st))
SELECT key, min({{'r': r, 'n': n, 'o': o, 'label': label}}).label AS class FROM c WHERE key <> '' GROUP BY 1""")
def action_classes(spark, d):  # C25
    return P.resolve_classes(_filled(spark, d, PHRASES), "q", *_vocabulary(spark))


#: Prompts, the model's reading, and what is to come of them; "%s" is a part's name.
ACTION_CASES = (
    ("A person is climbing tree.", "riding mule", "climbing tree", "complete_prompt_contract", ""),
    ("A person is clean and jerk and drumming", "drumming", "clean and jerk|drumming", "complete_prompt_contract", ""),
    ("A person is not drumming", "drumming", "other", "scoped_prompt_contract", ""),
    ("A person is drumming and polishing a %s", "drumming", "drumming|other", "partial_prompt_contract", ""),
    ("A person is polishing a %s", "climbing a tall tree", "climbing tree", "model_output", ""),
    ("A %s lies there. It is drumming", "drumming", "drumming", "model_output", "outside_declared_subject_form|multiple_clauses"),
    ("She is polishing and painting a %s", "cycling", "riding a bike", "model_output", "unresolved_conjunction"),
    ("A man is drumming and a %s", "drumming", "drumming", "model_output", "outside_declared_action_conjunction"),
    ("A person is %s", "not drumming", "other", "model_output", ""),
)


@query(f"""WITH c AS (SELECT unnest(range({len(ACTION_CASES)})) AS k, unnest([{_quoted(x[2] for x in ACTION_CASES)}]) AS target, unnest([{_quoted(x[3] for x in ACTION_CASES)}]) AS method, unnest([{_quoted(x[4] for x in ACTION_CASES)}]) AS reasons)
SELECT p_partkey * {len(ACTION_CASES)} + k AS id, target, method, reasons FROM part, c""")
def action_targets(spark, d):  # C24
    q = _filled(spark, d, tuple(x[0] for x in ACTION_CASES))
    said = F.get(F.array(*(F.array(F.lit(x[1])) for x in ACTION_CASES)), F.col("k"))
    rows = q.select((F.col("p_partkey") * len(ACTION_CASES) + F.col("k")).alias("id"), F.col("q").alias("prompt"), said.alias("actions"))
    t = P.compile_actions(rows, *_vocabulary(spark))
    return t.select("id", F.array_join("target", "|").alias("target"), "method", F.array_join("reasons", "|").alias("reasons"))
