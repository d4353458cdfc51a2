"""Quality rules: a table of thresholds compiled into one Spark projection.

Every ratio is a built-in expression; no user function runs. A rule rejects a
document if its metric lies outside the rule's bounds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import free_name, text_or_empty

#: White space of the words, as a Java and DuckDB character class.
SPACE = "\\x20\\x09-\\x0D"
#: Words that run through any prose of the language, lower case. Fixed values.
STOP_WORDS = {
    "en": "the of and to a in is it that was for on are as with his they at be this have from or by not".split(),
    "de": "der die das und in zu den von mit ist im für auf ein eine dem nicht des sich als auch es an er".split(),
    "fr": "le la les de des du et en un une que qui dans pour par sur au il elle est pas ne se son".split(),
    "es": "el la los las de del y en un una que se por con para su al es lo como más no le".split(),
}


@dataclass(frozen=True)
class Rule:
    """Rejects where ``metric`` is below ``least`` or above ``most`` (None: no bound)."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table. Metrics: see ``METRICS``.
RULES = (
    Rule("length", "n_words", 20, None),
    Rule("word length", "mean_word_chars", 2.0, 20.0),
    Rule("symbols to words", "symbol_ratio", None, 0.25),
    Rule("stop words", "stop_ratio", 0.02, None),
    Rule("repeated lines", "dup_line_ratio", None, 0.5),
    Rule("ellipsis lines", "ellipsis_line_ratio", None, 0.3),
    Rule("bullet lines", "bullet_line_ratio", None, 0.9),
)


def _over(part: str, whole: str) -> Callable[[dict[str, Column]], Column]:
    """0 where the denominator is 0, so no rule rejects for want of words or lines."""
    return lambda c: F.when(c[whole] > 0, c[part] / c[whole]).otherwise(F.lit(0.0))


#: Metric -> expression over the counted columns.
METRICS: dict[str, Callable[[dict[str, Column]], Column]] = {
    "n_words": lambda c: c["n_words"],
    "mean_word_chars": _over("word_chars", "n_words"),
    "symbol_ratio": _over("n_symbols", "n_words"),
    "stop_ratio": _over("n_stop_words", "n_words"),
    "dup_line_ratio": _over("n_dup_lines", "n_lines"),
    "ellipsis_line_ratio": _over("n_ellipsis_lines", "n_lines"),
    "bullet_line_ratio": _over("n_bullet_lines", "n_lines"),
}


def compile_rules(rules: tuple[Rule, ...], counts: dict[str, Column]) -> Column:
    """True where every rule of the table holds."""
    passed = F.lit(True)
    for r in rules:
        metric = METRICS[r.metric](counts)
        if r.least is not None:
            passed = passed & (metric >= F.lit(r.least))
        if r.most is not None:
            passed = passed & (metric <= F.lit(r.most))
    return passed


def _covered(at: str, window: int) -> Column:
    """Words that windows of ``window`` words at the sorted places ``at`` cover."""
    later = F.transform(at, lambda x, k: F.when(k + 1 < F.size(at), F.least(F.get(at, k + 1) - x, F.lit(window))).otherwise(F.lit(window)))
    return F.aggregate(later, F.lit(0), lambda x, y: x + y)


def counted(docs: DataFrame, stop_words: dict[str, list[str]] = STOP_WORDS) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with the counts under names that no column has, and these by metric.

    Eight-word windows are compared by 64-bit hashes of their words. A null text
    counts as empty. Needs no shuffle: a row's work depends on that row only.
    """
    window = 8
    every = sorted({v for ws in stop_words.values() for w in ws for v in (w, w[:1].upper() + w[1:])})
    counts = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_stop_words n_lines n_ellipsis_lines n_bullet_lines".split()
    names = {k: free_name(docs.columns, f"q_{k}") for k in counts}
    t, raw, words, lines, pairs, hs, places, at = (free_name(docs.columns, f"q_{x}") for x in "t raw words lines pairs hs places at".split())
    # One split serves the words and the number of white-space characters.
    a = docs.withColumn(t, text_or_empty())
    a = a.withColumn(raw, F.split(t, f"[{SPACE}]"))
    a = a.withColumns({words: F.array_remove(raw, ""), lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))})
    long = {
        "n_words": F.size(words),
        "word_chars": F.length(t) - (F.size(raw) - 1),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(every))),
        "n_lines": F.size(lines),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: x.rlike(f"(\\.\\.\\.|…)[{SPACE}]*$"))),
        "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(f"^[{SPACE}]*[-*•‣▪]"))),
    }
    # From here on a row holds hashes instead of words.
    a = a.withColumns({names[k]: c.cast("long") for k, c in long.items()} | {pairs: F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1)))})
    a = a.drop(t, raw, words, lines)
    whole = F.slice(pairs, 1, F.greatest(F.size(pairs) - (window - 1), F.lit(0)))
    a = a.withColumn(hs, F.transform(whole, lambda x, i: F.xxhash64(x, F.get(pairs, i + 2), F.get(pairs, i + 4), F.get(pairs, i + 6)))).drop(pairs)
    # Only a text that repeats a window pays for the ordered list of its windows.
    repeats = F.size(F.array_distinct(hs)) < F.size(hs)
    a = a.withColumn(places, F.when(repeats, F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop(hs)
    twin = lambda x, y: F.coalesce(y["h"] == x["h"], F.lit(False))
    twins = F.filter(places, lambda x, k: twin(x, F.get(places, k - 1)) | twin(x, F.get(places, k + 1)))
    a = a.withColumn(at, F.when(F.col(places).isNotNull(), F.sort_array(F.transform(twins, lambda x: x["i"])))).drop(places)
    n_repeat = F.when(F.col(at).isNull(), F.lit(0)).otherwise(_covered(at, window))
    return a.withColumn(names["n_repeat_words"], n_repeat.cast("long")).drop(at), {k: F.col(c) for k, c in names.items()}


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stop_words: dict[str, list[str]] = STOP_WORDS, into: str = "quality") -> DataFrame:
    """``docs`` with the struct ``into``: every count, ``base_failed`` and ``kept``
    (neither the base test nor a rule of the table fails).

    Null, empty and blank texts have no words: they fail the base test. Repeated rows
    are judged alike, texts of any length are judged whole, an empty table gives an empty
    one, and other columns stay untouched whatever their names (one named as ``into`` is
    replaced, as by ``withColumn``).
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() == into.lower()))
    a, c = counted(docs, stop_words)
    failed = (c["n_words"] < 20) | (F.lit(100) * c["n_repeat_words"] > F.lit(30) * c["n_words"])
    verdict = F.struct(*(x.alias(k) for k, x in c.items()), failed.alias("base_failed"), (~failed & compile_rules(rules, c)).alias("kept"))
    return a.select(*(f"`{x}`" for x in docs.columns), verdict.alias(into))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that ``judged`` keeps, with the columns of ``docs``."""
    q, row = free_name(docs.columns, "quality"), free_name(docs.columns, "q_row")
    # A filter moves below projections only where all their fields are deterministic. Here
    # it would take a copy of every count's expression with it, so a row number holds it up.
    verdicts = judged(docs, rules, into=q).withColumn(row, F.monotonically_increasing_id())
    return verdicts.filter(F.col(q)["kept"] & (F.col(row) >= 0)).drop(q, row)


def query(docs: DataFrame) -> DataFrame:
    fields = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return judged(docs.select("doc_id", "text")).select("doc_id", *(F.col("quality")[f].alias(f) for f in fields))


def query_sql(table: str = "documents", rules: tuple[Rule, ...] = RULES, columns: str = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept") -> str:
    """DuckDB SQL for ``query``, from the same table of rules."""
    every = sorted({v for ws in STOP_WORDS.values() for w in ws for v in (w, w[:1].upper() + w[1:])})
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in every)
    metric = {
        "n_words": "n_words",
        "mean_word_chars": "(CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END)",
        "symbol_ratio": "(CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END)",
        "stop_ratio": "(CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0.0 END)",
        "dup_line_ratio": "(CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END)",
        "ellipsis_line_ratio": "(CASE WHEN n_lines > 0 THEN n_ellipsis_lines / n_lines ELSE 0.0 END)",
        "bullet_line_ratio": "(CASE WHEN n_lines > 0 THEN n_bullet_lines / n_lines ELSE 0.0 END)",
    }
    bounds = [f"{metric[r.metric]} {op} {x}" for r in rules for op, x in ((">=", r.least), ("<=", r.most)) if x is not None]
    space = "[\\x20\\x09-\\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {table}),
w AS (SELECT rid, list_filter(string_split_regex(t, '{space}+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS k FROM win) WHERE k > 1),
cov AS (SELECT rid, sum(least(8, coalesce(lead_i - i, 8))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS lead_i FROM twice) GROUP BY rid),
c AS (SELECT d.*, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{space}+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: x IN ({stops}))) AS n_stop_words, len(ls) AS n_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|…){space}*$'))) AS n_ellipsis_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '^{space}*[-*•‣▪]'))) AS n_bullet_lines
      FROM d JOIN w USING (rid) LEFT JOIN cov USING (rid)),
v AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM c),
judged AS (SELECT *, (NOT base_failed AND {" AND ".join(bounds)}) AS kept FROM v)
SELECT {columns} FROM judged"""
