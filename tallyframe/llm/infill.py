"""Fill-in-middle: texts cut into prefix, middle and suffix at unit borders, in Spark
functions alone.

Borders are marked in the text itself. A delimiter character is escaped first, so that
every delimiter left is a mark; ``regexp_replace`` appends one after each unit, their
number is the number of units, and ``substring_index`` takes the units of a part by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import free_name, text_or_empty

#: A line with its end, or the last one without. Units have to cover every text.
LINES = r"[^\n]*\n|[^\n]+"
#: Strings that stand before the parts. A text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter, the escape, and what follows the escape for each of the two.
MARK, ESCAPE, MARK_CODE, ESCAPE_CODE = "\x01", "\x02", "m", "e"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escaped(text: Column) -> Column:
    """``text`` without the delimiter; ``unescaped`` undoes it."""
    return _replace(_replace(text, ESCAPE, ESCAPE + ESCAPE_CODE), MARK, ESCAPE + MARK_CODE)


def unescaped(text: Column) -> Column:
    return _replace(_replace(text, ESCAPE + MARK_CODE, MARK), ESCAPE + ESCAPE_CODE, ESCAPE)


def _first(marked: Column, units: Column) -> Column:
    return F.call_function("substring_index", marked, F.lit(MARK), units)


def _plain(part: Column) -> Column:
    return unescaped(_replace(part, MARK, ""))


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and key; a null key counts as
    the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", seed: int = 7, percent: int = 100, spm_percent: int = 50, units: str = LINES, into: str = "infill") -> DataFrame:
    """``docs`` with the struct ``into``: n (units), form (plain, psm or spm), prefix, middle,
    suffix (null if plain) and output.

    Cuts lie before two units drawn from ``key``: equal keys and texts are cut alike, so
    repeated rows and reruns give the same output. Of the texts about ``percent`` in 100 are
    cut, of these ``spm_percent`` begin with the suffix. Null and empty texts are plain with
    no units and an empty output; a text that holds a marker is plain. Texts are cut whole
    at any length, no row sees another, an empty table gives an empty one, and other columns
    stay whatever their names (one named as ``into`` is replaced). ``units`` has to match
    every character of a text once, and must not look at control characters 1 and 2.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() == into.lower()))
    t, m, n, a, b, h, head, parts, form = (free_name(docs.columns, f"fm_{x}") for x in "t m n a b h head parts form".split())
    c = F.col
    x = docs.withColumn(t, text_or_empty())
    x = x.withColumns({m: F.regexp_replace(escaped(c(t)), F.lit(units), F.lit("$0" + MARK)), h: F.array(*draws(c(key), seed))})
    x = x.withColumn(n, (F.length(m) - F.length(_replace(c(m), MARK, ""))).cast("int"))
    cut = lambda i: (F.get(h, F.lit(i)) % (c(n) + 1)).cast("int")
    x = x.withColumns({a: F.least(cut(0), cut(1)), b: F.greatest(cut(0), cut(1))})
    marker = c(t).contains(PREFIX) | c(t).contains(SUFFIX) | c(t).contains(MIDDLE)
    plain = (c(t) == "") | marker | (F.get(h, F.lit(2)) % 100 >= percent)
    x = x.withColumn(form, F.when(plain, "plain").when(F.get(h, F.lit(3)) % 100 < spm_percent, "spm").otherwise("psm"))
    # The units of prefix and middle with a mark between two; marks end the rest.
    x = x.withColumn(head, F.when(c(form) != "plain", _first(c(m), c(b))))
    three = F.struct(_plain(_first(c(head), c(a))).alias("prefix"), _plain(_first(c(head), c(a) - c(b))).alias("middle"), _plain(_first(c(m), c(b) - c(n) - 1)).alias("suffix"))
    x = x.withColumn(parts, F.when(c(form) != "plain", three))
    p, s, mid = F.concat(F.lit(PREFIX), c(parts)["prefix"]), F.concat(F.lit(SUFFIX), c(parts)["suffix"]), F.concat(F.lit(MIDDLE), c(parts)["middle"])
    output = F.when(c(form) == "psm", F.concat(p, s, mid)).when(c(form) == "spm", F.concat(s, p, mid)).otherwise(c(t))
    whole = F.struct(c(n).cast("long").alias("n"), c(form).alias("form"), *(c(parts)[f].alias(f) for f in ("prefix", "middle", "suffix")), output.alias("output"))
    return x.select(*(f"`{k}`" for k in docs.columns), whole.alias(into))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of. Parts hold no marker, so its first place is the
    place where it was put."""
    end = lambda c, marker: F.call_function("substring_index", c, F.lit(marker), F.lit(-1))
    begin = lambda c, marker: F.call_function("substring_index", c, F.lit(marker), F.lit(1))
    psm = F.concat(end(begin(output, SUFFIX), PREFIX), end(output, MIDDLE), begin(end(output, SUFFIX), MIDDLE))
    spm = F.concat(begin(end(output, PREFIX), MIDDLE), end(output, MIDDLE), end(begin(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(docs: DataFrame) -> DataFrame:
    cut = fill_in_middle(docs.select("doc_id", "text"))
    i = F.col("infill")
    cut = cut.select("doc_id", i["n"].alias("n"), i["form"].alias("form"), F.length(i["prefix"]).cast("long").alias("prefix_chars"), F.length(i["middle"]).cast("long").alias("middle_chars"), i["output"].alias("output"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


#: DuckDB: lines as a list, parts as its slices; the restored text has to be the text.
QUERY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(u[:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p"""
