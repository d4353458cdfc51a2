"""MinHash, repeated strings, quality rules and toxicity against brute force."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from tallyframe.llm import anchors, minhash, quality, suffixes, toxicity
from tallyframe.llm.shingles import words

RNG = random.Random(11)
VOCABULARY = [f"{a}{b}" for a in "ba be bi bo bu da de di do du ka ke ki ko ku".split() for b in "lan met nor pis rul sat".split()]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def corpus():
    base, passage = prose(120), prose(60)
    rows = [(i, prose(RNG.randint(5, 150))) for i in range(40)]
    for i in range(40, 60):  # near copies, each with its own changes
        w = base.split()
        for _ in range(i - 40):
            w[RNG.randrange(len(w))] = prose(1)
        rows.append((i, " ".join(w)))
    rows += [(60, base), (61, base), (62, base.upper()), (63, None), (64, ""), (65, " \n\t "), (66, "two words"), (67, "TWO  words"), (68, "x" * 5000)]
    rows += [(70 + i, prose(30) + " " + passage + " " + prose(30)) for i in range(6)]
    return [*rows, (60, base)]  # a repeated row


def components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,percent,share", [(3, 85, 1), (5, 80, minhash.SHARE)])
def test_near_duplicates_equal_brute_force(documents, monkeypatch, k, percent, share):
    monkeypatch.setattr(minhash, "SHARE", share)
    rows = corpus()
    got = minhash.near_duplicates(documents(rows, root="r", key="k", first=1), k, percent).collect()
    assert len(got) == len(rows)
    want = components(rows, k, percent)
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_of_very_long_texts(documents):
    long = prose(150_000)
    w = long.split()
    for k in range(0, 150_000, 100):
        w[k] = "changed"
    rows = [(5, long), (3, " ".join(w)), (2, prose(150_000)), (8, long + " x")]
    got = minhash.query(documents(rows)).collect()
    want = {i: c for i, (_, c) in components(rows, 3, 85).items()}
    assert {r.doc_id: r.component_id for r in got} == want == {2: 2, 3: 3, 5: 3, 8: 3}


def test_near_duplicates_of_nothing_and_null_ids(documents):
    assert minhash.query(documents([])).count() == 0
    got = minhash.query(documents([(None, "a b c d"), (3, "a b c d"), (None, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 0, None), (-1, 2, None), (3, 2, 3)]
    kept = minhash.dedup_filter(documents([(None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")]))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3]


def repeated(rows, length):
    """kept bytes of each document by looking at every string."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        covered = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                covered[k : k + length] = True
            seen.add(s)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], covered.astype(int)])) == 1))
        left = bytes(np.frombuffer(data, np.uint8)[~covered])
        out[i] = (len(data), int(covered.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def test_repeated_strings_equal_brute_force(documents):
    rows = corpus()[:-1]
    rows += [(100, "ab" * 300), (101, "é" * 200), (102, "ab" * 200), (103, prose(20) + "é" * 150)]
    got = suffixes.query(documents(rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == repeated(rows, 100)


def test_what_a_text_repeats_of_its_own(documents):
    """Short periods, a period over several segments, periods that other texts share, rows of
    one id; a text of two steps of the anchors."""
    passage = prose(40)
    rows = [(1, "a" * 3000), (2, passage * 5), (3, prose(30) + "a" * 400 + prose(30)), (4, passage + "xyz" * 200 + passage), (5, "xyz" * 300), (6, "a" * 3000), (7, passage * 2 + "b" * 99)]
    got = suffixes.query(documents([*rows, (2, passage * 5)])).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == repeated(rows, 100)
    n = (1 << 21) + 5
    long = suffixes.query(documents([(8, "q" * n)])).collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in long] == [(n, n - 1, 1)]


def test_own_repeats_are_few_rows():
    """Of a text of one period a segment a period and one run are left to be shuffled."""
    data = np.frombuffer(b"abcd" * 5000, np.uint8)
    a, s, start, count = anchors.segments(data)
    parts = suffixes._own_repeats(a.view(np.int64), s.view(np.int64), np.full(len(a), 9), start * 256 + count)
    runs = parts[3] < 0
    assert len(a) > 4000 and len(runs) < 12
    strings = {(-1 - p) + k for s, p in zip(parts[1][runs].tolist(), parts[3][runs].tolist(), strict=True) for k in range(s)}
    kept = {p // 256 + k for p in parts[3][~runs].tolist() for k in range(p % 256)}
    assert strings | kept == set(range(20_000 - 99)) and not strings & kept


def test_anchors_of_many_segments_are_dealt_to_shares(documents, monkeypatch):
    monkeypatch.setattr(suffixes, "SHARE", 2)
    monkeypatch.setattr(suffixes, "MERGED", 300)
    passage = prose(30)
    rows = [(i, prose(15) + " " + passage + " " + prose(15)) for i in range(12)]
    got = suffixes.query(documents(rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == repeated(rows, 100)


def test_an_anchor_with_thousands_of_segments(documents):
    """More than two shares of real size: one passage between words of each text's own."""
    rng = random.Random(5)
    passage = prose(16, rng)
    rows = [(i, f"{rng.getrandbits(64):x} {passage} {rng.getrandbits(64):x}") for i in range(5000)]
    rows[4000:4100] = [(i, rows[i - 3000][1] + " x") for i in range(4000, 4100)]
    got = suffixes.query(documents(rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == repeated(rows, 100)


def test_common_prefixes_equal_brute_force():
    rng = np.random.default_rng(8)
    shards = [rng.integers(97, 99, n).astype(np.uint8) for n in (60, 41, 80)]
    turns = [bytes(np.roll(s, -k)) * 3 for s in shards for k in range(len(s))]
    common = lambda a, b: next((i for i in range(20) if a[i] != b[i]), 20)
    want = [max(common(a, b) for j, b in enumerate(turns) if j != i) for i, a in enumerate(turns)]
    assert suffixes.common_prefixes(shards, 20).tolist() == want


@pytest.mark.parametrize("length", [1, 7, 8, 13, 22])
def test_interleave_finds_all_repeated_intervals(length):
    rng = np.random.default_rng(1)
    shards = [rng.integers(97, 99, 400).astype(np.uint8) for _ in range(3)] + [np.array([97, 98], np.uint8)]
    joined = np.concatenate(shards)
    interval, place = suffixes.repeated_intervals(shards, length)
    rotations = {}
    begin = 0
    for s in shards:
        for k in range(len(s)):
            rotations.setdefault(bytes(np.resize(np.roll(s, -k), length)), set()).add(begin + k)
        begin += len(s)
    want = {frozenset(x) for x in rotations.values() if len(x) > 1}
    got = {}
    for i, p in zip(interval.tolist(), place.tolist(), strict=True):
        got.setdefault(i, set()).add(p)
    assert {frozenset(x) for x in got.values()} == want and len(joined) == 1202


def test_texts_without_repeats(documents):
    block = "".join(f"{i}é" for i in range(60))
    rows = [(1, block + " one"), (2, "x" + block + " two"), (3, None), (None, block)]
    out = {r.doc_id: r for r in suffixes.dedup_texts(documents(rows)).collect()}
    assert out[3].text is None and out[None].text == block
    assert out[2].text == "xtwo" and out[2].n_chars == 4  # the space after the block repeats too
    assert suffixes.query(documents([])).count() == 0
    clash = suffixes.without_repeats(documents([(1, "a")], N_SPANS=7, sx_doc=3)).collect()
    assert [(r.n_spans, r.sx_doc) for r in clash] == [(0, 3)] and "N_SPANS" not in clash[0]
    kept = suffixes.dedup_texts(documents(rows, n_spans=7, kept_text="k", sx_kept_text="s"))
    assert {(r.n_spans, r.kept_text, r.sx_kept_text) for r in kept.collect()} == {(7, "k", "s")}


def test_a_very_long_text_without_white_space(documents):
    """Longer than the step of the anchors; a repeat lies over the step's border."""
    rng = np.random.default_rng(4)
    long = bytes(rng.integers(97, 123, (1 << 20) + 5000, dtype=np.uint8)).decode()
    step = (1 << 20) - 200
    rows = [(1, long), (2, "<" + long[step - 300 : step + 300] + ">"), (3, long[: step + 77])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.query(documents(rows)).collect()}
    assert got == {1: (len(long), 0, 0, hashlib.sha256(long.encode()).hexdigest()), 2: (602, 600, 1, hashlib.sha256(b"<>").hexdigest()), 3: (step + 77, step + 77, 1, hashlib.sha256(b"").hexdigest())}


def quality_counts(text):
    import re

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for k in range(len(w) - 7):
        seen.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {j for at in seen.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_counts_equal_brute_force(documents):
    rep = prose(12)
    rows = [*corpus(), (200, "\n".join([rep] * 3)), (201, prose(50) + "\n" + rep + " x " + rep), (202, "a %% b\n\n#c|d　e"), (203, "the of and " * 10), (204, prose(60_000)), (205, "x" * 2_000_000)]
    got = [(r.doc_id, tuple(r)[1:7]) for r in quality.query(documents(rows)).collect()]
    assert sorted(got) == sorted((i, quality_counts(t)) for i, t in rows)


def test_quality_table_decides(documents):
    clean = " ".join(["the", "of"] * 3 + prose(40).split())
    rows = [(1, clean), (2, " ".join(x + "%%%" for x in clean.split())), (3, prose(60).upper()), (4, None)]
    kept = quality.quality_filter(documents(rows, quality=7, q_words="w"))
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns[-2:] == ["quality", "q_words"]
    assert [c for c in quality.judged(documents(rows, Quality=7)).columns if c.lower() == "quality"] == ["quality"]
    assert quality.query(documents([])).count() == 0


def test_toxicity_learns_words_and_beginnings(spark, documents):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = prose(40, rng).split()
        if toxic:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["zarg", "krel" + rng.choice(VOCABULARY)]) if i % 2 else rng.choice(["idiot", "scum"])
        rows.append((i, " ".join(w)))
        marks.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.query(documents(rows), labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert len(held) > 100 and all(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_edge_cases(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, None), (2, ""), (None, "you idiot"), (4, "fine words " * 20000), (4, "you idiot")]
    docs = documents(rows, words=1)
    got = toxicity.query(docs, none).collect()
    assert len(got) == 5
    by = {(r.doc_id, r.predicted) for r in got}
    assert {(1, 0), (2, 0), (None, 1), (4, 0), (4, 1)} == by
    assert toxicity.query(documents([]), none).count() == 0
    model = toxicity.fit(docs, none)
    clash = toxicity.scored(documents(rows, SCORE=9.0, tx_text="t"), model).collect()
    assert max(r.score for r in clash) <= 1 and "SCORE" not in clash[0] and clash[0].tx_text == "t"
    kept = toxicity.toxicity_filter(documents(rows, TX_SCORE=1, tx_text=2), model)
    assert kept.columns[-2:] == ["TX_SCORE", "tx_text"] and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_label_model_finds_accuracies_and_correlations():
    """Votes drawn from known accuracies: the posterior beats any voter, copies of a voter
    join one clique and do not count twice."""
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.25
    hit, false = [0.8, 0.7, 0.6, 0.7], [0.03, 0.05, 0.02, 0.1]
    says = [np.where(rng.random(4000) < np.where(truth, h, f), 1, -1) for h, f in zip(hit, false, strict=True)]
    v = np.column_stack([*says, says[3]]).astype(np.int8)
    start = np.where((v == 1).any(axis=1), 0.9, 0.05)
    model = toxicity.fit_label_model(v, start, 0.3)
    assert [3, 4] in model.cliques and abs(model.prior - 0.25) < 0.03
    for k, (h, f) in enumerate(zip(hit[:3], false[:3], strict=True)):
        clean, toxic = model.table[0][k][0], model.table[1][k][0]
        assert abs(toxic - h) < 0.06 and abs(clean - f) < 0.03
    right = ((model.posterior(v) >= 0.5) == truth).mean()
    assert right > max(((s == 1) == truth).mean() for s in says)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no driver tables")
def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.query(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    toxic = [r for r in out if r.toxic == 1]
    clean = [r for r in out if r.toxic == 0]
    assert len(toxic) > 100 and sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_joined_segments_are_those_of_each_text():
    rng = np.random.default_rng(3)
    texts = [b"a" * n for n in (100, 101, 177, 400)] + [bytes(rng.integers(97, 99, n, dtype=np.uint8)) for n in range(100, 240)]
    text, *joined = anchors.joined_segments(texts)
    for k, t in enumerate(texts):
        each = anchors.segments(np.frombuffer(t, np.uint8))
        assert all(np.array_equal(x[text == k], y) for x, y in zip(joined, each, strict=True))


def test_string_hashes_tell_alternating_texts_apart():
    """Texts that swap two bytes after Thue and Morse, which polynomial hashes confuse, and
    texts whose changes lie 64 bytes apart, which rotations confuse: both hashes together
    tell every string of them apart, and equal strings are equal anywhere."""
    morse = np.array([bin(i).count("1") % 2 for i in range(400)], np.uint8)
    x, y = 97 + morse, 98 - morse
    far = np.full(400, 97, np.uint8)
    far[[100, 164]] = 98
    a, b, c, d = (np.stack(anchors.string_hashes(t.astype(np.uint8)), axis=1) for t in (x, y, np.full(400, 97, np.uint8), far))
    strings = {}
    for text, hashes in ((x, a), (y, b), (np.full(400, 97, np.uint8), c), (far, d)):
        for k, h in enumerate(hashes):
            strings.setdefault(text[k : k + 100].tobytes(), set()).add(tuple(h.tolist()))
    assert all(len(v) == 1 for v in strings.values())
    every = [next(iter(v)) for v in strings.values()]
    assert len(set(every)) == len(every)
    for i in (0, 1):  # each half spreads over its 64 bits
        bits = np.array([h[i] for h in every], np.uint64)
        ones = [int((bits >> np.uint64(k) & np.uint64(1)).sum()) for k in range(64)]
        assert min(ones) > 0.3 * len(every) and max(ones) < 0.7 * len(every)


def test_counts_of_characters_follow_in_any_case(documents):
    rows = [(1, "ab" * 100), (2, "ab" * 100 + "tail"), (3, None)]
    df = documents(rows).withColumnRenamed("n_chars", "N_CHARS")
    out = {r.doc_id: (r.N_CHARS, r.text) for r in suffixes.dedup_texts(df).collect()}
    assert all(n == (None if t is None else len(t)) for n, t in out.values()) and out[2][0] < 204
