"""Secrets in texts: three fixed patterns, and the spans that a conditional random field tags.

The patterns' own finds are the field's first examples (distant labels): a bounded sample of
rows gives windows around what they find, and windows without a find, hard ones first.
Secrets of other spellings and under other names are planted into such windows, and look-alikes
that are none. The field sees a token's shape, its neighbours' shapes and cue words, and
features of the file; it tags whole texts.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import bounded_arrow, free_name, text_or_empty
from tallyframe.llm.crf import BEGIN, INSIDE, OFFSETS, OUTSIDE, Crf, train, uncertain, weights_at

#: Kinds of spans, in their order at equal places; the last is the field's.
KINDS = ("assign", "access", "hex", "crf")
#: Rows that the training sample takes on average, and most windows of it with and without a
#: find; secrets and look-alikes planted into windows.
SAMPLE_ROWS, MOST_WINDOWS, PLANTED = 20_000, 800, 500

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of 24 and more: no shorter run is a match

#: Names before a planted secret, and words that the field may know by themselves. Fixed values.
KEYS = "password passwd pwd secret token api_key apikey access_key auth bearer credential private_key client_secret".split()
CUES = {"password", "passwd", "pwd", "passphrase", "secret", "token", "api", "key", "apikey", "api_key", "access", "access_key", "auth", "authorization", "bearer", "credential", "credentials", "private", "private_key", "client_secret", "login", "http", "https", "www", "mailto", "id", "version", "name", "akia"}
SEPARATORS = (" = ", "=", ": ", ":", " => ", " ", "\": \"", "' = '")
PREFIXES = ("ghp_", "sk-", "xoxb-", "glpat-", "")
#: Look-alikes: what stands for ``{}`` is drawn. Fixed values.
HARMLESS = ("{word} = {number}", "token = {word}", "password: {word}", "id: {number}", "version = {small}.{small}.{small}", "https://{word}.example.com/{word}/{number}?{word}={number}", "{word}.{word}@mail.example.com", "+{small} ({small}) {number}", "{long}", "the secret {word} of {word}", "key {number}", "{title}{title}{title}({word})", "{upper}_{upper}_{upper}", "{upper}{upper}{upper}{upper}")

#: Characters of a window beside a find, of the longest find, and of the span read at a time.
MARGIN, LONGEST, SPAN = 90, 400, 1 << 20
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_BREAK = re.compile(r"\s")
_SWITCH = re.compile(r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])|[A-Z]{2}(?=[a-z])")
_HARD = re.compile(r"\d{6,}|https?:|@|[=:|]|[A-Z]{8,}|\w{20,}")
_LENGTHS = (1, 2, 3, 5, 8, 12, 15, 19, 23, 31, 39, 63)


def base_finds(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, and the secret's own start and end) of the fixed patterns, each
    kind's matches leftmost and apart from each other, ordered by start and kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _length(n: int) -> int:
    return sum(n > x for x in _LENGTHS)


def token_features(token: str, glued: bool) -> tuple[str, ...]:
    """Shape of a token and whether it stands next to the one before; a cue word's name."""
    g = f"glued {glued}"
    if not (token[0].isalnum() or token[0] == "_"):
        return ("punct " + token[:2] if token.isascii() else "punct", g)
    lower = token.lower()
    n = _length(len(token))
    if token.isalpha():
        case = "lower" if token == lower else "upper" if token == token.upper() else "title" if token[1:] == lower[1:] else "mixed"
        kind = "letters " + case
        switches = len(_SWITCH.findall(token)) if case == "mixed" else 0
    else:
        digits = sum(map(token.count, string.digits))
        if digits == len(token):
            kind = "digits"
        elif not token.isascii():
            kind = "other"
        else:
            hexa = "hex " if not token.strip(string.hexdigits) and not (set(token) - set(string.hexdigits)) else ""
            kind = hexa + ("lower" if token == lower else "upper" if token == token.upper() else "mixed")
        switches = 0 if kind == "digits" else len(_SWITCH.findall(token[:LONGEST]))
    share = f"switches {min(4, switches * 8 // max(len(token[:LONGEST]), 1))}"
    out = (f"kind {kind}", f"length {n}", f"{kind} of {n}", share, g)
    return (*out, f"word {lower}") if lower in CUES else out


def file_features(text: str) -> tuple[str, ...]:
    """Of the whole text: how many assignments, braces and quotes it has for its length, and
    whether a name of a secret stands in it."""
    n = max(len(text), 1)
    rate = lambda chars: min(4, math.ceil(math.log2(1 + 1000 * sum(map(text.count, chars)) / n)))
    return (f"assignments {rate('=:')}", f"code {rate('{};')}", f"quotes {rate(chr(34))}", f"length {min(6, len(str(n)))}")


def _tokens(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, glued to the one before) of each token."""
    last = -1
    for m in _TOKEN.finditer(text):
        yield m.start(), m.end(), m.start() == last
        last = m.end()


def tagged(text: str, finds: list[tuple[int, int]]) -> tuple[list[tuple[str, ...]], list[int]]:
    """Features and tags of the tokens of a window; a token belongs to a find it overlaps."""
    tokens, tags, inside = [], [], None
    for a, b, glued in _tokens(text):
        hit = next((k for k, (x, y) in enumerate(finds) if a < y and b > x), None)
        tokens.append(token_features(text[a:b], glued))
        tags.append(OUTSIDE if hit is None else INSIDE if hit == inside else BEGIN)
        inside = hit
    return tokens, tags


def _windows(text: str, key: int) -> Iterator[tuple[bool, str, list[int], list[int], list[str]]]:
    """Windows of a sampled text: around up to eight finds, up to two hard places without one,
    and one place drawn by ``key``."""
    finds = [(s, e) for _, _, _, s, e in base_finds(text) if e - s <= LONGEST]
    every = [(a, b) for a, _, b, _, _ in base_finds(text)]
    file = list(file_features(text))

    def cut(low: int, high: int) -> tuple[int, int]:
        low, high = max(low, 0), min(high, len(text))
        a = _BREAK.search(text, low, high) if low else None
        return (a.end() if a and a.end() <= low + MARGIN // 2 else low), high

    for s, e in finds[:8]:
        a, b = cut(s - MARGIN, e + MARGIN)
        own = sorted({(max(x, a) - a, min(y, b) - a) for x, y in finds if x < b and y > a})
        yield True, text[a:b], [x for x, _ in own], [y for _, y in own], file
    spots = [m.start() for m, _ in zip(_HARD.finditer(text), range(64), strict=False)]
    spots = [p for p in spots if not any(a <= p < b for a, b in every)][:: max(1, len(spots) // 2)][:2]
    for p in [*spots, key % max(len(text), 1)]:
        a, b = cut(p - MARGIN, p + MARGIN)
        if a < b and not any(x < b and y > a for x, y in every):
            yield False, text[a:b], [], [], file


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["found", "window", "starts", "ends", "file"]
    kinds = [pa.bool_(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
    for batch in batches:
        out = [w for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in _windows(text, key)]
        yield pa.RecordBatch.from_arrays([pa.array([w[i] for w in out], k) for i, k in enumerate(kinds)], names)


def _planted(windows: list[tuple[str, list[str]]], n: int, rng: np.random.Generator) -> list[tuple[str, list[tuple[int, int]], list[str]]]:
    """``n`` secrets and as many look-alikes, each put into a window between two words."""
    pick = lambda x: x[int(rng.integers(len(x)))]
    of = lambda chars, k: "".join(chars[i] for i in rng.integers(0, len(chars), k))
    letters, upper = string.ascii_lowercase, string.ascii_uppercase
    drawn = {"word": lambda: of(letters, int(rng.integers(3, 11))), "number": lambda: of(string.digits, int(rng.integers(2, 9))), "small": lambda: of(string.digits, int(rng.integers(1, 4))), "long": lambda: of(string.digits, int(rng.integers(12, 20))), "title": lambda: of(letters, int(rng.integers(3, 9))).capitalize(), "upper": lambda: of(upper, int(rng.integers(3, 7)))}

    def secret() -> tuple[str, str]:
        """A value and its kind."""
        k = int(rng.integers(7))
        size = int(rng.integers(20, 45))
        if k == 0:
            return of(string.ascii_letters + string.digits, size), "key"
        if k == 1:
            return of(string.ascii_letters + string.digits + "+/", size) + pick(("", "=", "==")), "key"
        if k == 2:
            return of("0123456789ABCDEF", pick((32, 40, 64))), "key"
        if k == 3:
            return of("0123456789abcdef", pick((24, 32, 40, 64))), "key"
        if k == 4:
            return pick(PREFIXES[:-1]) + of(string.ascii_letters + string.digits, size), "key"
        if k == 5:
            return "AKIA" + of(upper + string.digits, 16), "key"
        return of(letters, int(rng.integers(4, 9))) + of(string.digits, int(rng.integers(1, 5))) + of("!_-#" + upper, int(rng.integers(0, 3))), "password"

    out = []
    for i in range(2 * n):
        text, file = pick(windows) if windows else ("", [])
        gaps = [0, *(m.end() for m in re.finditer(r"\s", text)), len(text)]
        at = pick(gaps)
        if i % 2:
            value, kind = secret()
            named = kind == "password" or rng.random() < 0.8
            key = pick(KEYS[:4] if kind == "password" else KEYS)
            key = key.upper() if rng.random() < 0.3 else key
            sep = pick(SEPARATORS[:5] if kind == "password" else SEPARATORS)
            quote = pick(("", "", '"', "'")) if not sep.endswith(('"', "'")) else ""
            before = f"{key}{sep}{quote}" if named else quote
            after = sep[-1] if sep.endswith(('"', "'")) and named else quote
            finds = [(at + len(before), at + len(before) + len(value))]
            put = f"{before}{value}{after}"
        else:
            finds = []
            put = re.sub(r"\{(\w+)\}", lambda m: drawn[m[1]](), pick(HARMLESS))
        out.append((f"{text[:at]}{put} {text[at:]}" if not at or text[at - 1].isspace() else f"{text[:at]} {put} {text[at:]}", finds if not at or text[at - 1].isspace() else [(a + 1, b + 1) for a, b in finds], file))
    return out


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, windows: int = MOST_WINDOWS, planted: int = PLANTED) -> Crf:
    """Learns from about ``rows`` rows, taken by a hash of id and text, of them at most
    ``windows`` windows with a find and as many without, and ``planted`` secrets and
    look-alikes. Equal windows count once. Null and empty texts give no windows; without any
    window the planted ones stand alone."""
    bounded_arrow(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("string").alias("id"), text_or_empty().alias("text"))
    share = min(1.0, rows / max(docs.count(), 1))
    key = F.xxhash64("id", "text")
    some = d.filter(F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else d
    cut = some.select("text", F.pmod(key, F.lit((1 << 61) - 1)).alias("key")).mapInArrow(_sample, "found boolean, window string, starts array<long>, ends array<long>, file array<string>")
    cut = cut.withColumn("order", F.xxhash64("window")).dropDuplicates(["found", "order"])
    cut = cut.persist()  # windows of the sample only
    try:
        taken = [cut.filter(F.col("found") == found).orderBy("order", "window").limit(windows).collect() for found in (True, False)]
    finally:
        cut.unpersist()
    rng = np.random.default_rng(7)
    plain = [(r.window, r.file) for r in taken[1]]
    examples = [(r.window, list(zip(r.starts, r.ends, strict=True)), r.file) for each in taken for r in each]
    examples += _planted(plain, planted, rng)
    return train([(*tagged(text, finds), tuple(file)) for text, finds, file in examples if text.strip()])


class _Words(dict):
    """Word -> bytes of the classes of its tokens; a new word's are made by ``make``."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        out = self.make(word)
        if len(word) <= LONGEST:
            self[word] = out
        return out


class Tagger:
    """Tags whole texts. The classes of a word's tokens are kept; once there are more than
    ``kept`` words they are made anew."""

    def __init__(self, crf: Crf, kept: int = 400_000):
        self.crf, self.kept = crf, kept
        self.words = _Words(self._word)
        self.classes: dict[tuple[str, ...], int] = {}
        self.plain: dict[tuple[int, int], bytes] = {}
        self.ends: dict[str, bytes] = {"": b""}
        #: Weights of a class by offset and tag, and the greater of the two tags'.
        self.table = np.zeros((len(OFFSETS), 1024, 2), np.float32)
        self.most = np.zeros((len(OFFSETS), 1024), np.float32)

    def _class(self, features: tuple[str, ...]) -> int:
        i = self.classes.get(features)
        if i is None:
            i = self.classes[features] = len(self.classes)
            if i == self.table.shape[1]:
                self.table, self.most = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (self.table, self.most))
            self.table[:, i] = self.crf.of_class(features)
            self.most[:, i] = self.table[:, i].max(axis=1)
        return i

    def _bytes(self, token: str, glued: bool) -> bytes:
        return np.int32(self._class(token_features(token, glued))).tobytes()

    def _word(self, word: str) -> bytes:
        bare = word.rstrip(".,;:!?")
        if bare.isalpha() and (lower := bare.lower()) not in CUES:
            # Only length and case tell the features of such a word, unless its case is mixed.
            case = 0 if bare == lower else 1 if bare == bare.upper() else 2 if bare[1:] == lower[1:] else 3
            if case < 3:
                key, end = (len(bare), case), word[len(bare) :]
                if key not in self.plain:
                    self.plain[key] = self._bytes(bare, False)
                if end not in self.ends:
                    if len(end) > 8:
                        return self.plain[key] + self._bytes(end, True)
                    self.ends[end] = self._bytes(end, True)
                return self.plain[key] + self.ends[end]
        return b"".join([self._bytes(word[a:b], glued) for a, b, glued in _tokens(word)])

    def _ids(self, text: str) -> np.ndarray:
        out, at = [], 0
        while at < len(text):
            cut = _BREAK.search(text, at + SPAN)
            end = cut.start() if cut else len(text)
            out.append(b"".join(map(self.words.__getitem__, (text[at:end] if at or cut else text).split())))
            if len(self.words) > self.kept:
                self.words.clear()
            at = end
        return np.frombuffer(b"".join(out), np.int32)

    def spans(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each tagged span, in code points."""
        ids = self._ids(text)
        if not len(ids):
            return []
        file = self.crf.of_file(file_features(text))
        found = []  # (first token, last token)
        for a, b in uncertain(ids, self.most, float((file + self.crf.lead).max())):
            tags = self.crf.viterbi(weights_at(ids, self.table, a, b).astype(float) + file)
            for t, y in enumerate(tags, a):
                if y == BEGIN or y == INSIDE and not (found and found[-1][1] == t - 1):
                    found.append((t, t))
                elif y == INSIDE:
                    found[-1] = found[-1][0], t
        if not found:
            return []
        ends = {t for f in found for t in f}
        place = {t: (a, b) for t, (a, b, _) in enumerate(_tokens(text)) if t in ends}
        return [(place[x][0], place[y][1]) for x, y in found]


def secret_spans(docs: DataFrame, crf: Crf, into: str = "secrets") -> DataFrame:
    """``docs`` with the array ``into`` of structs (kind, start, end), ends exclusive, ordered
    by start and kind: what the patterns find and what the field tags, both over the whole
    text. A span of the field may cover one of a pattern or lie in it.

    Null and empty texts have none, repeated rows have the same, no row sees another, an
    empty table gives an empty one, and other columns stay whatever their names (one named
    as ``into`` is replaced).
    """
    bounded_arrow(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() != into.lower()]
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def found(texts: pa.Array) -> pa.Array:
        tagger = _tagger(crf)
        out = []
        for text in texts.to_pylist():
            spans = sorted([(a, k, b) for a, k, b, _, _ in base_finds(text)] + [(a, 3, b) for a, b in tagger.spans(text)])
            out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
        return pa.array(out, pa.list_(kind))

    run = F.arrow_udf(found, "array<struct<kind:string,start:long,end:long>>")
    return docs.select(*(f"`{c}`" for c in names), run(text_or_empty()).alias(into))


_taggers: dict[str, Tagger] = {}


def _tagger(crf: Crf) -> Tagger:
    """The worker's tagger, kept from task to task; that of another field goes."""
    if crf.name not in _taggers:
        _taggers.clear()
        _taggers[crf.name] = Tagger(crf)
    return _taggers[crf.name]


def joined(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    s, names = free_name(["doc_id"], "secrets"), ("assign", "access", "hex")
    out = secret_spans(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text")), s).select("doc_id", s)
    of = lambda k: F.filter(s, lambda x: x["kind"] == k)
    base = F.filter(s, lambda x: x["kind"] != "crf")
    return out.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in names), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col(s)).alias("spans"))
