"""What prompts and captions ask for and say, read by rule (survey C21-C25, C28, C31, C33).

Places in a text come from ``text.mention_spans``; all that is concluded from them is
Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text as T

#: Relations a prompt can name, by the words that name them, tried in this order. Fixed values.
RELATION_PHRASES = {"left": "on the left of", "right": "on the right of", "above": "on the top of", "below": "on the bottom of"}
#: Sentences made from a relation. Fixed values.
RELATION_TEMPLATES = {
    "left": "The {subject} is to the left of the {object}.",
    "right": "The {subject} is to the right of the {object}.",
    "above": "The {subject} is above the {object}.",
    "below": "The {subject} is below the {object}.",
}
#: Other words for directions. Fixed values.
DIRECTION_WORDS = {"under": "below", "beneath": "below", "underneath": "below", "over": "above"}
#: Where a caption stops to speak of its head. Fixed value.
RELATION_CLAUSE = r"\s+(?:covering|covers|containing|contains|covered\s+(?:by|with|in)|surrounded\s+by)\b"
#: The subject of an action prompt, and words after which an action is not asserted. Fixed values.
ACTION_SUBJECT = r"^(?:(?:a|an|the) (?:person|man|woman|child|baby)|someone|somebody|he|she|they|people) (?:is|are)\s+"
NOT_ASSERTED = (
    r"\b(?:not|no|never|without|cannot|can't|isn't|aren't|wasn't|weren't|if|may|might|would|could|will|"
    r"watching|observing|imagining|planning|intending|pretending|avoiding|refusing|"
    r"wants? to|hopes? to|used to|going to|about to|thinking about)\b|n't\b"
)
#: Words that negate, that part an adjective from its noun, and that join them. Fixed values.
NEGATION = r"\b(?:no|not|without|neither|nor)\b"
PARTING = r"\b(?:on|in|near|with|by|and|beside|behind|under|above|of)\b|[,.!?;]"
COPULAS = ("is", "are", "looks", "appears")
#: Colours that make a caption one about colour in the plain variant of the score. Fixed values.
PLAIN_COLORS = "white red pink blue silver purple orange green gray yellow black grey".split()

_U = "(?iU)"


def _between(text: Column, start: Column, end: Column) -> Column:
    return text.substr(start + 1, end - start)


# ---- rules over whole prompts -------------------------------------------------------------


def relation_target(prompt: Column) -> Column:
    """(subject, relation, object) around the first relation that the prompt names."""
    low, pick = F.lower(prompt), None
    for name, phrase in RELATION_PHRASES.items():
        here = F.struct(F.lit(name).alias("name"), F.instr(low, phrase).alias("at"), F.lit(len(phrase)).alias("n"))
        pick = F.when(low.contains(phrase), here) if pick is None else pick.when(low.contains(phrase), here)

    def sides(r: Column) -> Column:
        rest = F.element_at(F.split(low.substr(r["at"] + r["n"], F.length(low)), ","), 1)
        both = F.transform(F.array(low.substr(F.lit(1), r["at"] - 1), rest), T.canonical_entity)
        return F.when(r.isNotNull(), F.struct(F.get(both, F.lit(0)).alias("subject"), r["name"].alias("relation"), F.get(both, F.lit(1)).alias("object")))

    return T.let(pick, sides)


def entity_target(prompt: Column) -> Column:
    """The names joined by "and" before the first comma; none if fewer than two or one
    of them is blank."""
    first = F.regexp_replace(F.element_at(F.split(F.lower(prompt), ","), 1), r"\.+$", "")
    all_of = lambda names: F.when((F.size(names) >= 2) & F.forall(names, lambda n: n != ""), names).otherwise(F.lit([]).cast("array<string>"))
    return T.let(F.transform(F.split(first, " and "), T.canonical_entity), all_of)


def gerund_label(label: Column) -> Column:
    """Whether a class begins with a word in -ing."""
    return F.element_at(F.split(T.normalize_phrase(label), " "), 1).endswith("ing")


def relation_prompt(subject: Column, relation: Column, thing: Column) -> Column:
    """The sentence of a relation; null for one that has none."""
    out = None
    for name, sentence in RELATION_TEMPLATES.items():
        made = F.replace(F.replace(F.lit(sentence), F.lit("{subject}"), F.lower(subject)), F.lit("{object}"), F.lower(thing))
        out = F.when(relation == name, made) if out is None else out.when(relation == name, made)
    return out


def caption_phrase(caption: Column, viewpoint: str, cut: bool = True) -> Column:
    """A caption in lower case without its ``viewpoint`` (a pattern for its beginning),
    and, with ``cut``, without the clause that relates its head to something else."""
    phrase = F.btrim(F.regexp_replace(F.lower(caption), f"(?s)^(?:{viewpoint})(.*)$", "$1"), F.lit(" \t\r\n"))
    return F.rtrim(F.regexp_replace(phrase, f"(?s){RELATION_CLAUSE}.*$", "")) if cut else phrase


def four_directions(prompt: Column, relations: Column) -> Column:
    """(relationships, omitted) of an array (subject, relation, object): the four
    directions by any of their names, each once; "on" counts where the prompt says on the
    top or bottom of the object. Others are omitted."""
    words = F.create_map(*(F.lit(x) for kv in DIRECTION_WORDS.items() for x in kv))

    def placed(r: Column, side: str) -> Column:
        thing = F.regexp_replace(r["object"], r"(\p{Punct})", r"\\$1")
        return F.regexp_like(prompt, F.concat(F.lit(_U + rf"\bon (?:the )?{side} of (?:a |an |the )?"), thing, F.lit(r"\b")))

    def direction(r: Column) -> Column:
        name = F.coalesce(words[r["relation"]], r["relation"])
        return F.when(name != "on", name).when(placed(r, "bottom"), "below").when(placed(r, "top"), "above").otherwise(name)

    mapped = F.transform(relations, lambda r: F.struct(r["subject"].alias("subject"), direction(r).alias("relation"), r["object"].alias("object"), r["relation"].alias("was")))
    known = lambda r: r["relation"].isin(*RELATION_TEMPLATES)
    of = lambda keep, name: F.transform(keep, lambda r: F.struct(r["subject"].alias("subject"), r[name].alias("relation"), r["object"].alias("object")))
    return T.let(mapped, lambda m: F.struct(F.array_distinct(of(F.filter(m, known), "relation")).alias("relationships"), of(F.filter(m, lambda r: ~known(r)), "was").alias("omitted")))


# ---- objects and their colours ------------------------------------------------------------


def binds(text: Column, color: Column, thing: Column) -> Column:
    """Whether a colour's place makes it an attribute of a thing's: at most four words and
    nothing that parts them before it, or a copula after it."""
    before = _between(text, color["end"], thing["start"])
    after = F.lower(F.trim(_between(text, thing["end"], color["start"])))
    adjective = (color["end"] <= thing["start"]) & (T.word_count(before) <= 4) & ~before.rlike(_U + PARTING)
    return adjective | ((color["start"] >= thing["end"]) & after.isin(*COPULAS))


def compile_prompt(prompt: Column, things: Column, colors: Column, color_names: list[str]) -> Column:
    """(object, color) that a prompt asks for, from the places of things and colours in
    it. Null where it names several things or negates; colours of other things do not count.
    A colour's name before a thing ("orange car") is no thing."""
    blank = lambda m: F.exists(things, lambda o: (o["start"] > m["end"]) & (F.trim(_between(prompt, m["end"], o["start"])) == ""))
    real = F.filter(things, lambda m: ~(m["label"].isin(color_names) & blank(m)))

    def body(objs: Column) -> Column:
        labels = F.array_distinct(F.transform(objs, lambda m: m["label"]))
        obj = F.when((F.size(labels) == 1) & ~prompt.rlike(_U + NEGATION), F.get(labels, F.lit(0)))
        bound = F.array_distinct(F.flatten(F.transform(objs, lambda o: F.transform(F.filter(colors, lambda c: binds(prompt, c, o)), lambda c: c["label"]))))
        return F.struct(obj.alias("object"), F.when(obj.isNotNull() & (F.size(bound) == 1), F.get(bound, F.lit(0))).alias("color"))

    return T.let(real, body)


def color_support(caption: Column, color: Column, target: Column, things: Column, colors: Column) -> Column:
    """Whether a caption gives a target a colour: (supported, negated, unbound, reason),
    the middle two as numbers of places. A target that the caption does not name leaves
    every place of the colour to it."""
    targets = F.filter(things, lambda m: m["label"] == target)
    clause = lambda m: F.element_at(F.split(caption.substr(F.lit(1), m["start"]), r"(?iU)[,.!?;]|\bbut\b"), -1)
    state = lambda m: F.when(clause(m).rlike(_U + NEGATION), "negated").when((F.size(targets) > 0) & ~F.exists(targets, lambda o: binds(caption, m, o)), "unbound").otherwise("bound")
    states = F.transform(F.filter(colors, lambda m: m["label"] == color), state)

    def body(s: Column) -> Column:
        count = lambda x: F.size(F.filter(s, lambda y: y == x))
        reason = F.when(count("bound") > 0, "supported").when(count("negated") > 0, "negated_color").otherwise("insufficient_color_evidence")
        return F.struct((count("bound") > 0).alias("supported"), count("negated").alias("negated"), count("unbound").alias("unbound"), reason.alias("reason"))

    return T.let(states, body)


# ---- classes of actions -------------------------------------------------------------------


def _keyed(vocabulary: DataFrame) -> DataFrame:
    key = T.normalize_phrase(F.col("label"))
    return vocabulary.select("ordinal", "label", key.alias("key"), _bare(key).alias("bare"), T.stems(key).alias("stems"))


def _bare(key: Column) -> Column:
    return T.normalize_phrase(F.regexp_replace(key, r"(?U)\b(?:a|an|the)\b", " "))


def resolve_classes(phrases: DataFrame, phrase: str, vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, class) for each distinct normalised ``phrase`` that has a class.

    ``vocabulary`` is (ordinal, label), ``aliases`` (alias, label). By rank: the class itself,
    an alias, the phrase without articles, both without articles, and last the class with
    most words whose stems all stand in the phrase and whose last one is the phrase's last.
    Ties go to the later class for names, to the earlier one for stems.
    """
    v = _keyed(vocabulary)
    keys = phrases.select(T.normalize_phrase(F.col(phrase)).alias("key")).filter("key <> ''").distinct()
    p = keys.select("key", _bare(F.col("key")).alias("p_bare"), T.stems(F.col("key")).alias("p_stems"))
    a = aliases.select(T.normalize_phrase(F.col("alias")).alias("key"), T.normalize_phrase(F.col("label")).alias("to"))
    a = a.join(v.select(F.col("key").alias("to"), "label", "ordinal"), "to").select("key", "label", "ordinal")
    name = lambda rows, rank: rows.select("key", F.struct(F.lit(rank).alias("rank"), F.lit(0).alias("words"), (-F.col("ordinal")).cast("long").alias("o"), F.col("label")).alias("c"))
    w = v.select(F.col("key").alias("v_key"), F.col("bare").alias("v_bare"), F.col("stems").alias("v_stems"), "label", "ordinal")
    head = F.try_element_at("p_stems", F.lit(-1)) == F.try_element_at("v_stems", F.lit(-1))
    inside = p.filter(F.size("p_stems") >= 2).join(w.filter(F.size("v_stems") >= 2), head).filter(F.size(F.array_except("v_stems", "p_stems")) == 0)
    found = [
        name(keys.join(v.select("key", "label", "ordinal"), "key"), 0),
        name(keys.join(a, "key"), 1),
        name(p.join(w, F.col("p_bare") == F.col("v_key")), 2),
        name(p.join(w, F.col("p_bare") == F.col("v_bare")), 3),
        inside.select("key", F.struct(F.lit(4).alias("rank"), (-F.size("v_stems")).alias("words"), F.col("ordinal").cast("long").alias("o"), F.col("label")).alias("c")),
    ]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.groupBy("key").agg(F.min("c")["label"].alias("class"))


def lexicon(vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row (exact, relaxed, longest): classes by the normalised and the relaxed form of
    their names and aliases, and the most parts between "and" that one has. As large as the
    vocabulary, which is a fixed list of some hundred classes."""
    v = _keyed(vocabulary)
    a = aliases.select("alias", T.normalize_phrase(F.col("label")).alias("key")).join(v.select("key", "label"), "key").select("alias", "label")
    names = v.select(F.col("label").alias("alias"), "label").unionByName(a).filter(T.normalize_phrase(F.col("alias")) != "")

    def table(form: Column) -> DataFrame:
        one = names.groupBy(form.alias("k")).agg(F.array_sort(F.collect_set("label")).alias("labels"))
        return one.agg(F.map_from_entries(F.collect_list(F.struct("k", "labels"))).alias("m"))

    parts = F.size(F.split(T.normalize_phrase(F.col("alias")), r"\s+and\s+"))
    exact, relaxed = table(T.normalize_phrase(F.col("alias"))), table(T.relaxed_key(F.col("alias")))
    longest = names.agg(F.max(parts).alias("longest"))
    return exact.withColumnRenamed("m", "exact").crossJoin(relaxed.withColumnRenamed("m", "relaxed")).crossJoin(longest)


def _labels(phrase: Column) -> Column:
    """Classes of a phrase: those of its exact form, else of its relaxed one, else null."""
    return T.let(T.normalize_phrase(phrase), lambda p: F.coalesce(F.try_element_at(F.col("exact"), p), F.try_element_at(F.col("relaxed"), T.relaxed(p))))


def _looked_up(phrase: Column, more: dict[str, Column]) -> Column:
    return T.let(phrase, lambda p: F.struct(p.alias("text"), _labels(p).alias("labels"), *(c.alias(n) for n, c in more.items())))


def _slot(x: Column) -> Column:
    """A part that is looked up, as a slot."""
    n = F.coalesce(F.size(x["labels"]), F.lit(0))
    label = F.when(n == 1, F.get(x["labels"], F.lit(0)))
    return F.struct(x["text"].alias("text"), label.alias("label"), (n > 1).alias("ambiguous"), (label.isNull() & x["text"].rlike("(?U)" + NOT_ASSERTED)).alias("blocked"))


def action_slots(prompt: Column) -> Column:
    """What an action prompt asserts, part by part: the longest class between "and"s from
    each place on, or one part alone. Needs the columns of ``lexicon``."""
    phrase = F.regexp_replace(T.normalize_phrase(prompt), ACTION_SUBJECT, "")
    slot = "struct<text:string,label:string,ambiguous:boolean,blocked:boolean>"

    def slots(pieces: Column) -> Column:
        join = lambda i, e: F.array_join(F.slice(pieces, i + 1, e - i), " and ")

        def step(s: Column, i: Column) -> Column:
            ends = F.sequence(F.least(F.size(pieces), i + F.col("longest")), i + 1, F.lit(-1))
            found = F.transform(ends, lambda e: _looked_up(join(i, e), {"end": e.cast("int")}))
            # The last is one part alone.
            best = T.let(found, lambda f: F.coalesce(F.get(F.filter(f, lambda x: x["labels"].isNotNull()), F.lit(0)), F.element_at(f, -1)))
            took = T.let(best, lambda x: F.struct(x["end"].alias("next"), F.array_append(s["slots"], _slot(x)).cast(f"array<{slot}>").alias("slots")))
            return F.when(s["next"] == i, took).otherwise(s)

        start = F.struct(F.lit(0).alias("next"), F.lit([]).cast(f"array<{slot}>").alias("slots"))
        return F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 1), start, step, lambda s: s["slots"])

    none = F.lit([]).cast(f"array<{slot}>")
    whole = lambda x: F.when(x["text"] == "", none).when(x["labels"].isNotNull(), F.array(_slot(x)).cast(f"array<{slot}>")).otherwise(T.let(F.split(x["text"], r"\s+and\s+"), slots))
    return T.let(_looked_up(phrase, {}), whole)


def compile_actions(rows: DataFrame, vocabulary: DataFrame, aliases: DataFrame, guard: bool = True) -> DataFrame:
    """``rows`` (id, prompt, actions), the last what a model read, with the target, the
    way it came about and, with ``guard``, why the model's reading stands all the same.

    Classes that the prompt asserts in full replace the model's; parts that it negates or
    that have several classes are ``other``; else the model's reading stays, its phrases
    replaced by their classes. Null actions, or a blank one, are an
    invalid reading: no target.
    """
    said = rows.select("id", F.posexplode("actions").alias("at", "said")).withColumn("key", T.normalize_phrase(F.col("said")))
    classes = resolve_classes(said, "said", vocabulary, aliases)
    lex = lexicon(vocabulary, aliases)  # one row
    read = said.join(classes, "key", "left").crossJoin(F.broadcast(lex))
    read = read.withColumn("labels", _labels(F.col("said")))
    n = F.coalesce(F.size("labels"), F.lit(0))
    open_text = (n == 0) & ~F.col("key").rlike("(?U)" + NOT_ASSERTED)
    label = F.coalesce(F.when(n == 1, F.get("labels", F.lit(0))).when(open_text, F.col("class")), F.lit("other"))
    read = read.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", label.alias("label")))).alias("r")).select("id", F.array_distinct(F.transform("r", lambda x: x["label"])).alias("read"))
    out = rows.join(read, "id", "left").crossJoin(F.broadcast(lex)).withColumn("slots", action_slots(F.col("prompt")))
    valid = F.col("actions").isNotNull() & F.forall("actions", lambda a: F.coalesce(T.normalize_space(a) != "", F.lit(False)))
    normal = F.when(valid, F.coalesce("read", F.lit([]).cast("array<string>")))
    s, several = F.col("slots"), F.size("slots") > 1
    named = F.exists(s, lambda x: x["label"].isNotNull())
    full = (F.size(s) > 0) & F.forall(s, lambda x: x["label"].isNotNull())
    scoped = F.exists(s, lambda x: x["blocked"] | x["ambiguous"])
    method = F.when(normal.isNull(), "invalid_model_output").when(full, "complete_prompt_contract").when(scoped, "scoped_prompt_contract").when(several & named, "partial_prompt_contract").otherwise("model_output")
    out = out.select("id", "prompt", "slots", normal.alias("normal"), method.alias("method"))
    m = F.col("method")
    asserted = F.array_distinct(F.transform(s, lambda x: F.coalesce(x["label"], F.lit("other"))))
    kept = F.when(several & (F.size("normal") > 0), F.array_distinct(F.array_append("normal", F.lit("other")))).otherwise(F.col("normal"))
    target = F.when(m == "invalid_model_output", F.lit(None)).when(m == "model_output", kept).otherwise(asserted)
    if not guard:
        return out.select("id", target.alias("target"), "method", F.lit([]).cast("array<string>").alias("reasons"))
    odd = lambda x: x["label"].isNull() & ~x["ambiguous"] & ~x["blocked"] & ~x["text"].rlike(r"^[a-z]+ing\b")
    body = F.regexp_replace(F.btrim(F.col("prompt"), F.lit(" \t\r\n")), r"[.!?]+$", "")
    reasons = F.array_compact(
        F.array(
            F.when((F.size("normal") == 0) & ~named, "preserve_model_empty_outside_positive_contract"),
            F.when(~T.normalize_phrase(F.col("prompt")).rlike(ACTION_SUBJECT), "outside_declared_subject_form"),
            F.when(body.rlike(r"[.!?;\n]"), "multiple_clauses"),
            F.when(several & ~named, "unresolved_conjunction"),
            F.when(several & F.exists(s, odd), "outside_declared_action_conjunction"),
        )
    )
    settled = m.isin("invalid_model_output", "complete_prompt_contract")
    out = out.withColumn("reasons", F.when(settled, F.lit([]).cast("array<string>")).otherwise(reasons))
    stands = F.size("reasons") > 0
    return out.select("id", F.when(stands, F.col("normal")).otherwise(target).alias("target"), F.when(stands, "model_output").otherwise(m).alias("method"), "reasons")
