"""Which filters of a corpus overlap, and what each is worth, by inclusion and exclusion.

One aggregation counts, for every set of filters, the documents that fail all of them (sums
of products of flags). All else follows from these counts: Möbius inversion over subsets
gives what survives a set of filters, inversion over supersets what fails exactly a set,
and the counts with alternating signs are the Harsanyi dividends of the game "documents
removed", whose shares are the Shapley values.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import free_name, text_or_empty, written

#: White space of the words.
SPACE = "\\x20\\x09-\\x0D"
#: Most filters: 2^n sums a part and n! orders are made.
MOST_FILTERS = 6


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """The failure conditions A to D of a text and its words."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": F.lit(100) * F.size(F.array_distinct(words)) < F.lit(80) * F.size(words),
        "C": F.lit(100) * capitals > F.lit(10) * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, A to E, good, toxic), a row a document: flags as longs, 1 where a filter fails
    or a label holds.

    Null texts and parts count as empty. E fails where a smaller id has the same text; a null
    id has no smaller one and no labels. Rows with one id are all judged alike; of several
    label rows of an id one that holds is enough. Texts are told apart by SHA-256; only
    digests and flags are shuffled. The copies of one text spread by their ids: a text's first
    id is found by an aggregate that combines before the shuffle, and the join back is on
    digest and id together. Null ids are dealt out by a salt.
    """
    t, words = free_name(docs.columns, "fi_text"), free_name(docs.columns, "fi_words")
    x = docs.withColumn(t, text_or_empty())
    x = x.withColumn(words, F.array_remove(F.split(t, f"[{SPACE}]+"), ""))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(F.lit(0)).cast("int")
    name = F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")
    rows = x.select(F.col("doc_id").alias("id"), salt.alias("salt"), name, F.unhex(F.sha2(t, 256)).alias("digest"), *(f.cast("long").alias(k) for k, f in text_filters(F.col(t), F.col(words)).items()))
    rows = written(rows, "audit-flags")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).filter("id is not null").withColumns({"salt": F.lit(0), "first": F.lit(True)})
    holds = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(c)
    of = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(holds("quality"), holds("toxic")).withColumn("salt", F.lit(0))
    both = rows.join(first, ["digest", "id", "salt"], "left").join(of, ["id", "salt"], "left")
    again = F.col("id").isNotNull() & F.col("first").isNull()
    zero = F.lit(0).cast("long")
    return both.select("part", *"ABCD", again.cast("long").alias("E"), F.coalesce("quality", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))


def _bits(n: int, i: int) -> list[int]:
    return [m for m in range(2**n) if m >> i & 1]


def joint_failures(rows: DataFrame, by: str, filters: list[str], weights: list[str]) -> DataFrame:
    """A row a value of ``by``: for ``n`` (documents) and each of ``weights`` the array of
    the 2^k joint-failure counts, a set's number having bit i for the i-th filter. The empty
    set counts all documents."""
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")

    def product(m: int, weight: str | None) -> Column:
        out = F.col(weight) if weight else F.lit(1).cast("long")
        for i, f in enumerate(filters):
            if m >> i & 1:
                out = out * F.col(f)
        return out

    sums = {w: [F.sum(product(m, None if w == "n" else w)).alias(f"{w}_{m}") for m in range(2 ** len(filters))] for w in ("n", *weights)}
    counted = rows.groupBy(by).agg(*(s for each in sums.values() for s in each))
    return counted.select(by, *(F.array(*(f"{w}_{m}" for m in range(2 ** len(filters)))).alias(w) for w in sums))


def _folded(df: DataFrame, column: str, n: int, with_bit: bool, sign: int) -> DataFrame:
    """Adds (``sign``) to each set's number that of the set without or with one more filter,
    a filter after the other: sums, or differences, over all subsets or supersets."""
    for i in range(n):
        bit = F.lit(1 << i)
        has = lambda m: m.bitwiseAND(bit) > 0  # noqa: B023, E731
        other = lambda m: m.bitwiseXOR(bit)  # noqa: B023, E731
        step = F.transform(column, lambda x, m: F.when(has(m) == F.lit(with_bit), x + F.lit(sign) * F.get(column, other(m))).otherwise(x))  # noqa: B023
        df = df.withColumn(column, step)
    return df


def lattice(joint: DataFrame, n: int, weights: list[str]) -> DataFrame:
    """``joint_failures`` with, for ``n`` and each weight w: ``w_kept`` (what survives each
    set of filters), and for documents ``exact`` (fails this set and no other filter) and
    ``dividend`` (a set's Harsanyi dividend)."""
    even = lambda m: F.bit_count(m) % 2 == 0
    out = joint
    for w in ("n", *weights):
        out = out.withColumn(f"{w}_kept", F.transform(w, lambda x, m: F.when(even(m), x).otherwise(-x)))
        out = _folded(out, f"{w}_kept", n, True, 1)
    out = _folded(out.withColumn("exact", F.col("n")), "exact", n, False, -1)
    return out.withColumn("dividend", F.transform("n", lambda x, m: F.when(m == 0, F.lit(0).cast("long")).when(even(m), -x).otherwise(x)))


def order_report(joint: DataFrame, by: str, filters: list[str], weights: list[str]) -> DataFrame:
    """A row a part, order of the filters and step: kept, removed, redundant, unique_fails,
    ``w_lost`` for each weight w, and shapley times the number of orders (a whole number)."""
    n = len(filters)
    rows = lattice(joint, n, weights)
    bit = F.lit(0)
    for i, f in enumerate(filters):
        bit = F.when(F.col("filter") == f, 1 << i).otherwise(bit)
    share = lambda m: F.lit(factorial(n)) / F.bit_count(m)
    value = F.transform(F.array(*(F.lit(1 << i) for i in range(n))), lambda f: F.aggregate(F.sequence(F.lit(1), F.lit(2**n - 1)), F.lit(0).cast("long"), lambda s, m: s + F.when(m.bitwiseAND(f) > 0, (F.get("dividend", m) * share(m)).cast("long")).otherwise(0)))
    rows = rows.withColumn("values", value)
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = rows.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    steps = steps.withColumn("filter", F.expr("substring(filter_order, step, 1)")).withColumn("bit", bit)
    earlier = F.lit(0)
    for i, f in enumerate(filters):
        earlier = earlier + F.when(F.instr("filter_order", f) < F.col("step"), 1 << i).otherwise(0)
    steps = steps.withColumn("earlier", earlier)
    kept = lambda w, m: F.get(f"{w}_kept", m)
    lost = lambda w: kept(w, F.col("earlier")) - kept(w, F.col("earlier") + F.col("bit"))
    place = F.instr(F.lit("".join(filters)), F.col("filter")) - 1
    return steps.select(
        by, "filter_order", "step", kept("n", F.col("earlier") + F.col("bit")).alias("kept"), lost("n").alias("removed"),
        (F.get("n", F.col("bit")) - lost("n")).alias("redundant"), F.get("exact", F.col("bit")).alias("unique_fails"), *(lost(w).alias(f"{w}_lost") for w in weights), F.get("values", place).alias("shapley"),
    )


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every part of ``documents`` that has rows; none for an empty table."""
    rows = flagged(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality", "toxic"))
    return order_report(joint_failures(rows, "part", list("ABCDE"), ["good", "toxic"]), "part", list("ABCDE"), ["good", "toxic"])


#: DuckDB: each order is walked over the documents' distinct flags, step by step.
QUERY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
g AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM x p, x q, x r, x s, x u WHERE p.x NOT IN (q.x, r.x, s.x, u.x) AND q.x NOT IN (r.x, s.x, u.x) AND r.x NOT IN (s.x, u.x) AND s.x <> u.x),
st AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[:step - 1] AS earlier FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o)),
w AS (SELECT part, filter_order, step, filter, n, good, toxic, fails, contains(fails, filter) AS hit, fails <> '' AND regexp_matches(fails, '[' || earlier || '.]') AS gone FROM g, st),
r AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (fails = filter), 0)::BIGINT AS unique_fails, coalesce(sum(n) FILTER (hit AND NOT gone AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (hit AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost FROM w GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM r"""
