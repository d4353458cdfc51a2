"""Tokenising many texts by their distinct chunks, inside a task.

A chunk is a run of ASCII white space (maybe empty), the characters after it that are no
letters or digits (maybe none) and the letters and digits after those. The patterns of the
tokenisers here never match across the place before a run of white space, nor from letters
or digits on to other characters, so a text's ids are those of its chunks in order. Texts
to which that may not apply, with other white space, not in composed form, or with the
string of a special token, are given to the library whole.

The chunks of many texts are cut and told apart as arrays; Python and the library see each
distinct one only.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

#: Distinct chunks whose ids a worker keeps, and the characters of the longest of them. A
#: worker outlives its task, and what it keeps then counts beside whatever runs next.
CACHED_CHUNKS, LONGEST = 600_000, 256
#: Characters of a text that are split at a time, and about those of several short texts.
SPAN, BLOCK = 1 << 20, 1 << 20

_BREAK = re.compile(r"(?<=[^ \t-\r])[ \t-\r]")
#: White space beyond ASCII, separators that only some libraries count as such, the letter
#: that falls apart in lower case, and halves of pairs, which UTF-8 cannot hold.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff\u0130\ud800-\udfff]")


def _spans(text: str):
    at = 0
    while len(text) - at > SPAN:
        cut = _BREAK.search(text, at + SPAN)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 0 white space, 2 a letter or digit, 1 any other. A chunk begins
    where the kind falls."""
    kinds = np.fromiter(map(str.isalnum, map(chr, range(0x110000))), np.uint8, 0x110000) + np.uint8(1)
    kinds[[*b" \t\n\v\f\r"]] = 0
    return kinds


class ChunkEncoder:
    """``encode`` turns a list of strings into lists of ids; the ids of chunks are kept.

    ``whole`` does the same for texts that are not to be split, those that ``apart`` tells
    among them.
    """

    def __init__(self, encode: Callable[[list[str]], list], whole: Callable[[list[str]], list] | None = None, apart: Callable[[str], bool] = lambda text: False, cached: int = CACHED_CHUNKS):
        self.encode_all, self.whole, self.apart, self.cached = encode, whole or encode, apart, cached
        # Once `known` has half of what may be kept it is the older half, whose chunks go unless met again.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks, as bytes."""
        found = list(map(self.known.get, chunks))
        missed = [k for k, ids in enumerate(found) if ids is None]
        for k in missed:
            found[k] = self.older.get(chunks[k])
        new = [k for k in missed if found[k] is None]
        if new:
            for k, ids in zip(new, self.encode_all([chunks[k] for k in new]), strict=True):
                found[k] = array("I", ids).tobytes()
        for k in missed:
            if len(chunks[k]) <= LONGEST:
                if len(self.known) >= self.cached // 2:
                    self.known, self.older = {}, self.known
                self.known[chunks[k]] = found[k]
        return found

    def _split(self, spans: list[str]) -> list[np.ndarray]:
        """The ids of each span."""
        text = "".join(spans)
        ends = np.cumsum([0, *map(len, spans)])
        if not text:
            return [np.empty(0, np.uint32) for _ in spans]
        data = text.encode()
        codes = np.frombuffer(data if text.isascii() else text.encode("utf-32-le"), np.uint8 if text.isascii() else np.uint32)
        kinds = _kinds()[codes]
        begins = np.append(True, kinds[1:] < kinds[:-1])
        begins[ends[ends < len(text)]] = True
        starts = np.flatnonzero(begins)
        at = starts if text.isascii() else np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[starts]
        cuts = pa.py_buffer(np.append(at, len(data)).astype(np.int64))
        chunks = pa.LargeStringArray.from_buffers(len(starts), cuts, pa.py_buffer(data)).dictionary_encode()
        which, ids = chunks.indices.to_numpy(), self._ids(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n = size[which]
        after = np.append(0, np.cumsum(n))
        place = np.repeat((np.cumsum(size) - size)[which] - after[:-1], n) + np.arange(after[-1])
        out = np.frombuffer(b"".join(ids), np.uint32)[place]
        cut = after[np.searchsorted(starts, ends)]
        return [out[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        apart = [self.apart(t) or not t.isascii() and bool(_OTHER_SPACE.search(t) or not is_normalized("NFC", t)) for t in texts]
        split = iter(self._split([t for t, x in zip(texts, apart, strict=True) if not x and len(t) <= SPAN]))
        for text, x in zip(texts, apart, strict=True):
            if x:
                yield np.asarray(self.whole([text])[0], np.uint32)
            else:
                yield next(split) if len(text) <= SPAN else np.concatenate([self._split([s])[0] for s in _spans(text)])

    def encode_many(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each whole text (null: of the empty one) as unsigned 32-bit integers."""
        group, size = [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= BLOCK:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)
        pa.default_memory_pool().release_unused()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text."""
        return next(self.encode_many([text]))


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes
    for themselves, the others for the letters from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return {b: chr(b if b in set(printable) else next(others)) for b in range(256)}


_LETTERS = "".join(_byte_letters()[b] for b in range(256))


def _lettered(words: list[str]) -> list[str]:
    """The letters of the bytes of each word; no word has a line break in it."""
    return codecs.charmap_decode("\n".join(words).encode(), "strict", _LETTERS)[0].split(_LETTERS[10]) if words else []


def _plain_word(tokenizer_file: str) -> Callable[[str], str | None]:
    """The word whose bytes' letters the model itself gets of a chunk that is one plain word,
    as its file says; None for every other chunk or kind of file. Saves the library's walk
    around the model."""
    with open(tokenizer_file, encoding="utf-8") as f:
        j = json.load(f)
    before, normal = j["pre_tokenizer"] or {}, j["normalizer"]

    if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and normal is None:
        return lambda x: x if x.isalpha() or (x[0] == " " and x[1:].isalpha()) else None
    kinds = [n.get("type") for n in (normal or {}).get("normalizers", [])], [p.get("type") for p in before.get("pretokenizers", [])]
    if kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and "|[\\p{L}]+|" in str(before["pretokenizers"][0]["pattern"].get("Regex")):

        def bare(x: str) -> str | None:
            word = x.strip(" \t\n\r\x0b\x0c")
            return word.lower() if word.isalpha() and max(word) < "\u0370" else None

        return bare
    return lambda x: None


_loaded: dict[str, ChunkEncoder] = {}


def library_encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file of the tokenizers library: the ids of
    ``encode`` without special tokens added. A special token's string in a text is that
    token, as in the library."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        plain, model = _plain_word(path), Tokenizer(tokenizer.model)

        def whole(texts: list[str], by: Tokenizer = tokenizer) -> list[list[int]]:
            return [e.ids for e in by.encode_batch_fast(texts, add_special_tokens=False)]

        def encode(chunks: list[str]) -> list[list[int]]:
            words = [plain(c) for c in chunks]
            rest = iter(whole([c for c, w in zip(chunks, words, strict=True) if w is None]))
            own = iter(whole(_lettered([w for w in words if w is not None]), model))
            return [next(rest) if w is None else next(own) for w in words]

        added = tokenizer.get_added_tokens_decoder().values()
        exact = [t.content for t in added if not t.normalized]
        loose = [t.content.lower() for t in added if t.normalized]  # looked for after normalising

        def apart(text: str) -> bool:
            return any(x in text for x in exact) or bool(loose) and any(x in text.lower() for x in loose)

        _loaded[path] = ChunkEncoder(encode, whole, apart)
    return _loaded[path]


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
