"""Toxicity by weak supervision.

Many voters look at a text: words of a lexicon, words and word beginnings found among
labelled texts, and patterns (an insult at someone, in capitals, twice in a sentence,
several or none in the text, many for its length). A generative label model, begun at the
sample's labels, estimates how accurate each voter is and which of them vote together, and
gives each text of a bounded sample a posterior. A linear classifier trained on these
posteriors, not on the labels, scores any text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded_arrow, free_name, text_or_empty
from tallyframe.llm.shingles import shingle_set

#: Insults that vote from the start, whatever the labels say. Fixed values.
LEXICON = "idiot moron stupid loser scum trash worthless pathetic disgusting clown imbecile dumb jerk".split()
#: Patterns around an insult, which stands for ``{}``. Fixed values.
PATTERNS = {
    "at someone": r"\b(?:you|your|youre|you're|du|ihr|tu|vous|toi|eres|usted)\b\W+(?:\w+\W+){{0,3}}?(?:{})",
    "twice": r"\b(?:{})\b[^.!?\n]{{0,200}}\b(?:{})",
    "shouted": r"(?:{})\w*\W*!",
}
#: Most labelled rows that the fit looks at, and most voters found among them.
MAX_LABELLED, MAX_FOUND = 8000, 96
#: Letters of the word beginnings that may become voters.
STEMS = (4, 5, 6)

_WORD = re.compile(r"\w+")


def held_out(column: str = "doc_id") -> Column:
    """Rows that no fit may learn from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Voters:
    words: tuple[str, ...]
    stems: tuple[str, ...]

    def __post_init__(self) -> None:
        self.place = {w: i for i, w in enumerate(self.words)}
        self.stem_place = {s: len(self.words) + i for i, s in enumerate(self.stems)}
        self.terms = len(self.words) + len(self.stems)
        any_of = "|".join(re.escape(t) for t in sorted({*self.words, *self.stems}, key=lambda t: (-len(t), t)))
        self.patterns = [re.compile(p.format(any_of, any_of), re.IGNORECASE) for p in PATTERNS.values()] if any_of else []
        self.capitals = self.terms + len(self.patterns)
        self.n = self.capitals + 1

    def hits(self, text: str) -> tuple[np.ndarray, int]:
        """How often each voter's word or beginning stands in ``text``, whether each pattern
        does, and the number of words."""
        lower = text.lower()
        words = _WORD.findall(lower)
        out = np.zeros(self.n)
        distinct = set(words)
        found = distinct & self.place.keys()
        for w in found:
            out[self.place[w]] += words.count(w)
        for k in {len(s) for s in self.stems}:
            for w in distinct:
                if (i := self.stem_place.get(w[:k])) is not None and len(w) > k:
                    out[i] += words.count(w)
                    found.add(w)
        if found:  # no pattern stands without one
            for k, p in enumerate(self.patterns):
                out[self.terms + k] = p.search(text) is not None
            out[self.capitals] = any(re.search(rf"\b{re.escape(w.upper())}\b", text) is not None for w in found)
        return out, len(words)


def votes(hits: np.ndarray, words: np.ndarray, terms: int) -> np.ndarray:
    """Votes of all voters, 1 toxic, 0 clean, -1 none: each word, beginning or pattern that
    stands in the text says toxic; texts without any of the ``terms`` say clean; texts with
    several of them, or with many for their length, say toxic once more."""
    some = np.where(hits > 0, 1, -1).astype(np.int8)
    total = hits[:, :terms].sum(axis=1)
    none = np.where(total == 0, 0, -1)
    several = np.where(total >= 2, 1, -1)
    dense = np.where(total * 50 >= np.maximum(words, 1), 1, -1)
    return np.column_stack([some, none, several, dense]).astype(np.int8)


@dataclass
class LabelModel:
    """P(toxic | votes) with an accuracy for each clique of voters that vote together."""

    cliques: list[list[int]]
    prior: float
    #: By clique: P(vote = toxic, clean, none | clean text), and given a toxic one.
    table: np.ndarray

    def joint(self, v: np.ndarray) -> np.ndarray:
        """One vote for each clique: toxic if any member says so, else clean, else none."""
        return np.column_stack([np.where((v[:, c] == 1).any(1), 0, np.where((v[:, c] == 0).any(1), 1, 2)) for c in self.cliques])

    def posterior(self, v: np.ndarray) -> np.ndarray:
        j = self.joint(v)
        log = np.log(self.table[:, np.arange(j.shape[1]), j])  # (class, row, clique)
        z = log.sum(axis=2) + np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(z[0] - z[1], -500, 500)))


def fit_label_model(v: np.ndarray, start: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """Expectation-maximisation over the votes ``v`` from the first guess ``start``, twice:
    with all voters on their own, then with voters that correlate within a class (0.5 and
    more) joined to cliques."""
    model = LabelModel([[i] for i in range(v.shape[1])], prior, np.empty(0))
    q = start
    for again in range(2):
        j = model.joint(v)
        for _ in range(rounds):
            model.prior = float(np.clip(q.mean(), 0.005, 0.5))
            counts = np.array([[[(w * (j[:, c] == x)).sum() for x in range(3)] for c in range(j.shape[1])] for w in (1 - q, q)])
            # Pseudo-counts: a voter is assumed better than chance until shown otherwise.
            counts += np.array([[[0.1, 1.0, 1.0]], [[1.0, 0.5, 1.0]]])
            model.table = counts / counts.sum(axis=2, keepdims=True)
            new = model.posterior(v)
            if np.abs(new - q).max() < 1e-6:
                break
            q = new
        if again:
            break
        says = (v == 1).astype(float)
        together = np.zeros((v.shape[1], v.shape[1]))
        for w in (1 - q, q):
            w = w / max(w.sum(), 1e-9)
            mean = w @ says
            cov = (says * w[:, None]).T @ says - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            together = np.maximum(together, cov / np.outer(sd, sd))
        group = list(range(v.shape[1]))
        for a in range(len(group)):
            for b in range(a):
                if together[a, b] >= 0.5 and group[a] != group[b]:
                    old, new_group = group[a], group[b]
                    group = [new_group if g == old else g for g in group]
        model = LabelModel([[i for i, g in enumerate(group) if g == k] for k in sorted(set(group))], model.prior, np.empty(0))
    return model


def features(hits: np.ndarray, words: np.ndarray, terms: int) -> np.ndarray:
    total, kinds = hits[:, :terms].sum(axis=1), (hits[:, :terms] > 0).sum(axis=1)
    share = total / np.maximum(words, 1)
    return np.column_stack([np.ones(len(words)), total > 0, np.log1p(total), np.log1p(kinds), np.minimum(share * 20, 1.0), np.log1p(words) / 10, np.log1p(hits)])


def fit_linear(x: np.ndarray, q: np.ndarray, penalty: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method, ridge-penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - q) + ridge * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    labels: LabelModel

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        hits, words = zip(*(self.voters.hits(t) for t in texts), strict=True)
        return 1 / (1 + np.exp(-np.clip(features(np.array(hits), np.array(words), self.voters.terms) @ self.weights, -30, 30)))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall(text.lower()))
            found = {"w" + w for w in words if 3 <= len(w) <= 24} | {"s" + w[:k] for k in STEMS for w in words if len(w) > k}
            out += [(t, toxic) for t in found]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out]), pa.array([x for _, x in out], pa.int32())], ["token", "toxic"])


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = [int(s.view(np.int64)[0]) if len(s := shingle_set(t, 5)) else 0 for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], ["id", "text", "toxic", "cluster"])


def find_voters(sample: DataFrame, lexicon: list[str]) -> Voters:
    """The lexicon, and words and beginnings that mark the toxic texts of ``sample`` (text,
    toxic): in at least 1 % (and three) of them, nine times in ten or more in toxic ones."""
    pos = sample.filter("toxic = 1").count()
    least = max(3, math.ceil(0.01 * pos))
    counted = sample.select("text", "toxic").mapInArrow(_tokens, "token string, toxic int").groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    good = counted.filter((F.col("k") >= least) & (F.col("k") * 10 >= F.col("n") * 9))
    rows = [(r["token"], r["k"]) for r in good.orderBy(F.desc("k"), F.length("token"), "token").limit(4 * MAX_FOUND).collect()]
    words = {t[1:]: k for t, k in rows if t[0] == "w"}
    stems: dict[str, int] = {}
    for t, k in rows:  # a longer beginning that finds the same texts adds nothing
        s = t[1:]
        if t[0] == "s" and not any(s.startswith(x) and k <= stems[x] for x in stems):
            if not any(w.startswith(s) and words[w] >= 0.9 * k for w in words):
                stems[s] = k
    words = {w: k for w, k in words.items() if not any(len(w) > len(s) and w.startswith(s) for s in stems)}
    best = sorted([*((k, "w", w) for w, k in words.items()), *((k, "s", s) for s, k in stems.items())], reverse=True)[:MAX_FOUND]
    return Voters(tuple(dict.fromkeys([*lexicon, *(w for _, c, w in best if c == "w")])), tuple(s for _, c, s in best if c == "s"))


def fit(docs: DataFrame, labels: DataFrame, lexicon: list[str] = LEXICON, limit: int = MAX_LABELLED) -> Model:
    """Learns from at most ``limit`` labelled rows, none of them held out, taken by a hash
    of the id; of texts that share their least shingle one counts, so copies weigh once.

    Without labelled texts the lexicon alone votes.
    """
    bounded_arrow(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).join(F.broadcast(known), "id").select("id", "text", "toxic")  # at most `limit` rows
    each = texts.mapInArrow(_clusters, "id long, text string, toxic int, cluster long")
    sample = each.groupBy("cluster").agg(F.min(F.struct("id", "text", "toxic")).alias("x")).select("x.*").persist()
    try:
        voters = find_voters(sample, lexicon)
        found = sample.mapInArrow(_hits(voters), "toxic int, words long, hits array<double>").toPandas()
    finally:
        sample.unpersist()
    if len(found):
        toxic, words, hits = found["toxic"].to_numpy(float), found["words"].to_numpy(), np.stack(found["hits"].to_numpy())
    else:
        toxic, words, hits = np.zeros(0), np.zeros(0, int), np.zeros((0, voters.n))
    # Where the sample lacks a class, made-up texts stand for it: each insult alone, or none.
    known = len(lexicon)
    if not (toxic == 1).any():
        toxic, words, hits = np.append(toxic, np.ones(known)), np.append(words, np.full(known, 10)), np.vstack([hits, np.eye(voters.n)[:known]])
    if not (toxic == 0).any():
        toxic, words, hits = np.append(toxic, np.zeros(2 * known)), np.append(words, np.full(2 * known, 100)), np.vstack([hits, np.zeros((2 * known, voters.n))])
    v = votes(hits, words, voters.terms)
    # Begun at the voters' majority instead, it finds fewer of the toxic texts held out.
    model = fit_label_model(v, np.clip(toxic, 0.05, 0.95), float(toxic.mean()))
    return Model(voters, fit_linear(features(hits, words, voters.terms), model.posterior(v)), model)


def _hits(voters: Voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [voters.hits(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([n for _, n in got], pa.int64()), pa.array([h.tolist() for h, _ in got], pa.list_(pa.float64()))], ["toxic", "words", "hits"])

    return run


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``docs`` with ``score``. It depends on the text alone; null texts count as empty,
    texts of any length are read whole, repeated rows score alike, an empty table gives an
    empty one. A column named ``score`` already there is replaced, as by ``withColumn``."""
    bounded_arrow(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() != score.lower()]
    rows = docs.select(*(f"`{c}`" for c in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.scores(texts), pa.float64())], [*names, score])

    with_text = docs.select(*(f"`{c}`" for c in names), text_or_empty().alias(free_name(names, "tx_text")))
    return with_text.mapInArrow(run, rows.withColumn(score, F.lit(0.0)).schema)


def toxicity_filter(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The documents with a score under ``threshold``; all their columns stay."""
    name = free_name(docs.columns, "tx_score")
    return scored(docs, model, name).filter(F.col(f"`{name}`") < threshold).drop(name)


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
