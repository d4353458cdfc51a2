"""The field against enumeration, its pruning against the whole path, patterns against plain
scans, and what it finds of secrets that it was not shown."""

import hashlib
import itertools
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import crf as C
from tallyframe.llm import secret_tags as S

RNG = random.Random(5)
WORDS = [f"{a}{b}" for a in "ba be bi bo ka ke ki ko ma me mi mo".split() for b in "lan met nor pis rul sat".split()]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def of(chars, n):
    return "".join(RNG.choice(chars) for _ in range(n))


def random_crf(seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return C.Crf({f"f{i}": i for i in range(6)}, {"x": 0}, rng.normal(size=(5, 6, 2)) * scale, rng.normal(size=(1, 2)), rng.normal(size=(3, 3)) * scale)


def test_viterbi_and_posterior_equal_enumeration():
    for seed in range(6):
        crf = random_crf(seed)
        e = np.random.default_rng(seed + 50).normal(size=(5, 2)) * 2
        full = np.concatenate([np.zeros((5, 1)), e], axis=1)

        def score(y):
            path = [0, *y, 0]
            return sum(crf.moves[a, b] for a, b in itertools.pairwise(path)) + sum(full[t, k] for t, k in enumerate(y))  # noqa: B023

        every = {y: score(y) for y in itertools.product(range(3), repeat=5)}
        assert tuple(crf.viterbi(e)) == max(every, key=every.get)
        p, expected, log = C._posterior(np.stack([full, np.zeros((5, 3))]), crf.moves, np.array([5, 2]))
        z = np.log(sum(np.exp(v) for v in every.values()))
        short = np.log(sum(np.exp(crf.moves[0, a] + crf.moves[a, b] + crf.moves[b, 0]) for a in range(3) for b in range(3)))
        assert np.isclose(log, z + short) and np.isclose(expected.sum(), 6 + 3)
        for t in range(5):
            for k in range(3):
                assert np.isclose(p[0, t, k], sum(np.exp(v - z) for y, v in every.items() if y[t] == k))
        assert not p[1, 2:].any()


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_pruned_path_equals_the_whole_path(block):
    runs = 0
    for seed in range(30):
        crf = random_crf(seed, 0.4)
        rng = np.random.default_rng(seed)
        table = rng.normal(size=(5, 40, 2)).astype(np.float32) * 1.5 - 2.5
        ids = rng.integers(0, 40, 200).astype(np.int32)
        file = rng.normal(size=2) * 0.1
        whole = np.array(crf.viterbi(C.weights_at(ids, table, 0, 200).astype(float) + file))
        pruned = np.zeros(200, int)
        for a, b in C.uncertain(ids, table.max(axis=2), float((file + crf.lead).max()), block):
            pruned[a:b] = crf.viterbi(C.weights_at(ids, table, a, b).astype(float) + file)
            runs += b - a < 200
        assert (whole == pruned).all()
    assert runs > 20


def plain_finds(text):
    """The patterns by hand: keyword by keyword and run by run."""
    out, at = [], 0
    key = re.compile(r"(?a:(password|passwd|secret|token|api_?key))", re.I)
    while m := key.search(text, at):
        i = m.end()
        i += text[i : i + 1] in ('"', "'") and bool(text[i : i + 1])
        while text[i : i + 1] == " ":
            i += 1
        if text[i : i + 1] not in (":", "="):
            at = m.start() + 1
            continue
        i += 1
        while text[i : i + 1] == " ":
            i += 1
        i += text[i : i + 1] in ('"', "'") and bool(text[i : i + 1])
        j = i
        while j < len(text) and (text[j] in "+/_.=-" or text[j].isascii() and text[j].isalnum()):
            j += 1
        if j == i:
            at = m.start() + 1
            continue
        if j - i >= 6:
            out.append((m.start(), 0, j))
        at = j
    for kind, chars, least in ((1, string.ascii_uppercase + string.digits, 20), (2, "0123456789abcdef", 24)):
        i = 0
        while i < len(text):
            if text[i] in chars and (kind == 2 or text.startswith("AKIA", i)):
                j = i
                while j < len(text) and text[j] in chars:
                    j += 1
                if j - i >= least:
                    out.append((i, kind, j))
                i = j
            else:
                i += 1
    return sorted(out)


TEXTS = [
    None, "", " ", "=", "token=", "token=abcde", "token=abcdef", 'API_KEY" :  "abc.def=/+', "apikey='x-y_zzz", "PassWord: hunter2hunter passwd = token: abcdefgh", "token=token:abcdefgh", "secretsecret=secret=abcdefg",
    "AKIA" + "Q" * 16, "AKIA" + "Q" * 15, "xAKIAAKIA" + "7" * 20 + " AKIA", "a" * 23, "a" * 24, "A" + "b" * 30 + "g" + "0" * 24, "token = \"" + "f" * 40 + "\"", "ſecret=abcdefgh", "toKen = abcdefgh", "é😀 token: 😀abcdef token: abcdefé",
    "token\n=abcdefgh", "password = " + "9" * 5 + "\x85" + "8" * 9, "1234567890 " * 2000, "word " * 150000, "x" * 300000, "token = " + "a1" * 100000,
]


def test_patterns_equal_plain_scans():
    letters = ["token", "passwd", "SECRET", "api_key", "=", ":", " ", '"', "'", "AKIA", "0a1b2c3d4e5f", "ABCDEF12", "abc", "é", "\n", "z9", "-", "+"]
    for text in [t or "" for t in TEXTS] + ["".join(RNG.choices(letters, k=RNG.randint(1, 40))) for _ in range(3000)]:
        assert [x[:3] for x in S.base_finds(text)] == plain_finds(text), text[:200]


def corpus(n=260):
    rows = []
    for i in range(n):
        words = prose(RNG.randint(5, 90)).split()
        if i % 4 == 0:
            words.insert(RNG.randrange(len(words)), RNG.choice([f'token = "{of("0123456789abcdef", 40)}"', f"password: {of(string.ascii_lowercase, 6)}{of(string.digits, 4)}", "AKIA" + of(string.ascii_uppercase + string.digits, 16)]))
        if i % 5 == 0:
            words.insert(0, RNG.choice(["call +1 (499) 555-6503", "mail a.b@mail.example.com", "https://x.example.com/a/b?c=12", "4785 3805 9239 1139", "ref = 48213"]))
        rows.append((i, " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def fitted(spark):
    return S.fit(spark.createDataFrame(corpus(), "doc_id long, text string"))


def whole_spans(crf, text):
    """The field over every token of a text at once, without cache or pruning."""
    tokens = list(S._tokens(text))
    w = [crf.of_class(S.token_features(text[a:b], g)).astype(np.float32) for a, b, g in tokens]
    e = np.array([sum(w[t + d][k] for k, d in enumerate(C.OFFSETS) if 0 <= t + d < len(w)) for t in range(len(w))]).reshape(-1, 2)
    out, last = [], 0
    for (a, b, _), y in zip(tokens, crf.viterbi(e + crf.of_file(S.file_features(text))) if tokens else [], strict=True):
        if y == C.BEGIN or y == C.INSIDE and last == 0:
            out.append([a, b])
        elif y == C.INSIDE:
            out[-1][1] = b
        last = y
    return [tuple(x) for x in out]


def test_query_equals_patterns_and_the_whole_path(spark, documents):
    rows = corpus() + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[6]), (1006, TEXTS[6]), (1006, TEXTS[6])]
    docs = documents(rows, secrets="s", kind=1)
    crf = S.fit(docs)
    got = S.query(docs).collect()
    want = []
    for i, t in rows:
        base = plain_finds(t or "")
        say = lambda spans: ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        field = [(a, 3, b) for a, b in whole_spans(crf, t or "")]
        want.append((i, *(sum(k == x for _, x, _ in base) for k in range(3)), hashlib.sha256(say(base).encode()).hexdigest(), say(base + field)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = S.secret_spans(documents(rows[:3], SECRETS=1, start=2), crf)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "start", "secrets"] and kept.count() == 3


def test_empty_tables_and_texts(documents):
    assert S.query(documents([])).count() == 0
    got = S.query(documents([(1, None), (2, ""), (None, " ")])).collect()
    assert [(r.n_assign, r.n_access, r.n_hex, r.spans) for r in got] == [(0, 0, 0, "")] * 3


def test_secrets_of_other_spellings_are_found(fitted):
    """Held out: names, values and texts that no window of the sample had."""
    tagger, found, asked = S.Tagger(fitted), 0, 0
    for k in range(300):
        value = [of("0123456789ABCDEF", 40), of(string.ascii_letters + string.digits, 32), of(string.ascii_letters + string.digits, 30) + "==", "ghp_" + of(string.ascii_letters + string.digits, 36)][k % 4]
        before, after = prose(20), prose(20)
        text = f"{before} {RNG.choice(['access_key = ', 'Bearer ', 'client_secret: ', 'export PRIVATE_KEY='])}{value} {after}"
        at = text.index(value)
        asked += 1
        found += any(a < at + len(value) and b > at for a, b in tagger.spans(text))
    assert found >= 0.9 * asked
    plain = [f"{prose(30)} {RNG.choice(['call +44 20 7946 0958', 'write to x.y@mail.example.org', 'the secret garden of', 'version 3.12.1', 'id: 99312', 'HTTPServer(port)', 'see https://docs.example.org/a/b'])} {prose(30)}" for _ in range(300)]
    assert sum(bool(tagger.spans(t)) for t in plain) <= 6


def test_repartitioning_changes_nothing(spark, documents):
    docs = documents(corpus())
    a, b = (sorted(map(tuple, S.query(docs.repartition(n, F.col("text"))).collect())) for n in (1, 5))
    assert a == b
