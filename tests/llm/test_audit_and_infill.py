"""The filter audit against a walk through every order, fill-in-middle against plain slices."""

import hashlib
import re
from collections import defaultdict
from itertools import permutations

import pytest

from tallyframe.llm import infill, interactions

LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    w = [x for x in re.split(r"[ \t-\r]+", text) if x]
    out = {"A"} if len(w) < 100 else set()
    out |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
    return out | ({"D"} if re.search(r"[#$%&*|]", text) else set())


def audit(rows, labels):
    """rows: (id, text, lang). Every order is walked document by document."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    failed = []
    for i, t, lang in rows:
        t = t or ""
        f = fails(t) | ({"E"} if i is not None and i > first[t] else set())
        own = [x for x in labels if x[0] == i and i is not None]
        failed.append((lang or "", f, any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)))
    out, value = {}, defaultdict(int)
    for part in {x[0] for x in failed}:
        for order in permutations("ABCDE"):
            left = [x for x in failed if x[0] == part]
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                every = [x for x in failed if x[0] == part and f in x[1]]
                value[part, f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), len(every) - len(removed), sum(x[1] == {f} for x in every), sum(x[2] for x in removed), sum(x[3] for x in removed)]
    return {k: [*v, value[k[0], k[1][k[2] - 1]]] for k, v in out.items()}


LONG = " ".join(f"w{i}" for i in range(120))
CASES = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (3, LONG, "en"), (1, LONG, "en"), (None, LONG, "en"), (4, None, "en"), (5, "", None), (6, " \t\n ", ""), (7, "#", "en"),
    (8, "word " * 300, "de"), (9, "UP " * 150, "de"), (10, "UP & down", "fr"), (11, LONG + " $", "fr"), (12, LONG + "\x0b* UPPER CASE " * 90, "en"), (0, LONG + " $", "de"), (13, "é" * 20000, "en"), (None, None, None),
]


def test_audit_equals_a_walk_through_every_order(spark):
    labels = [(1, 1, 0), (1, None, 1), (2, 1, 1), (3, 0, 1), (11, 1, None), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(CASES, "doc_id long, text string, lang string").repartition(3).selectExpr("*", "1 AS part", "2 AS digest", "3 AS FI_TEXT", "4 AS first")
    rows = interactions.query(docs, spark.createDataFrame(labels, LABELS).selectExpr("*", "1 AS salt")).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(rows) == len(got) and got == audit(CASES, labels)
    # The shares of all filters add up to what all of them remove, in every order.
    for part in {k[0] for k in got}:
        total = sum(got[part, "ABCDE", s][1] for s in range(1, 6))
        assert sum(got[part, "ABCDE", s][6] for s in range(1, 6)) == 120 * total


def test_audit_without_documents_or_labels(spark):
    none, no_labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], LABELS)
    assert interactions.query(none, no_labels).count() == 0
    got = interactions.query(spark.createDataFrame(CASES, none.schema), no_labels).collect()
    assert {(r.good_lost, r.toxic_lost) for r in got} == {(0, 0)} and len(got) == 120 * 5 * len({c[2] or "" for c in CASES})


def test_lattice_of_other_filters_and_weights(spark):
    """Three filters by name: survivors, exact failures and dividends of every subset."""
    rows = [("p", i >> 0 & 1, i >> 1 & 1, i >> 2 & 1, i) for i in range(8) for _ in range(i + 1)]
    df = spark.createDataFrame(rows, "by string, X long, Y long, Z long, chars long")
    r = interactions.lattice(interactions.joint_failures(df, "by", list("XYZ"), ["chars"]), 3, ["chars"]).first()
    of = lambda m: [x for x in rows if sum(x[1 + i] << i for i in range(3)) & m == m]
    for m in range(8):
        free = [x for x in rows if not any(x[1 + i] and m >> i & 1 for i in range(3))]
        assert r.n[m] == len(of(m)) and r.exact[m] == m + 1
        assert r.n_kept[m] == len(free) and r.chars_kept[m] == sum(x[4] for x in free)
        assert r.dividend[m] == (0 if m == 0 else (-1) ** (m.bit_count() + 1) * len(of(m)))
    with pytest.raises(ValueError):
        interactions.joint_failures(df, "by", list("ABCDEFG"), [])


def plain_infill(i, t, percent=100, spm=50):
    t = t or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, t
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\n", "one\ntwo", "a\r\nb\r\n", "\x01", "\x02", "\x02m\x02e\x01m\n\x01\x02\n\x02e", "<P>", "a\nb <S> c", "<M", "<\n<P\nS>\n<\nM>", "<<\nS>\n<M\n>", "😀\né x\x85y\x0b\x0c\n",
    "$0 \\ $1\n" * 50, "x\n" * 30000, "long " * 100000, "\x01\x02\n" * 400, "same\ntext\nhere\nfour\nfive",
]


def test_infill_equals_plain_slices(documents):
    rows = [(1000 * k + i, t) for k in range(8) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc"), (None, "a\nb\nc"), (5, TEXTS[5]), (5, TEXTS[5])]
    got = infill.query(documents(rows, n=1, form="f", fm_t=2, INFILL=3)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, n, form, p, m, sha(out), sha(t or "")) for i, t in rows for n, form, p, m, out in [plain_infill(i, t)]]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.query(documents([])).count() == 0


def test_infill_keeps_other_columns_and_takes_other_shares(documents):
    rows = [(i, f"l{i}\n" * (i % 7)) for i in range(300)]
    df = infill.fill_in_middle(documents(rows, fm_m="x", INFILL=1), percent=40, spm_percent=25, into="infill")
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "fm_m", "infill"]
    for r in df.collect():
        n, form, _, _, out = plain_infill(r.doc_id, r.text, 40, 25)
        assert (r.infill.n, r.infill.form, r.infill.output) == (n, form, out)
        assert form == "plain" or r.infill.prefix + r.infill.middle + r.infill.suffix == r.text
    words = infill.fill_in_middle(documents([(1, "a b  c")]), units=r" *[^ ]+| +$").first().infill
    assert words.n == 3 and words.prefix + words.middle + words.suffix == "a b  c"
