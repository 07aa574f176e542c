"""BPE encoding and decoding by speculation and verification.

Greedy longest match proposes tokens for every word not met before.  A token
sequence is the true BPE encoding exactly if each token encodes to itself and
each adjacent pair encodes to that pair, so all adjacent pairs of a batch are
tested together as integer codes against a table of pairs known to hold.  Only
words with a failing pair go through exact merging, which takes n log n steps
for a word of n letters.

A task reads the vocabulary once and frees it at its end; decoding reads the
tokens alone.  What a task remembers of words is bounded in bytes; when that is
full, it forgets what it has met in one batch only.  :func:`encode` followed by
:func:`decode` takes two Python processes a task, :func:`round_trip` takes one.

Cases: null text is the empty text; an empty text has no tokens; texts and words
of any length are taken whole; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow, slices

END = "\ue000"
#: Bytes of chunks and words, and number of pairs, that a task remembers before it starts afresh.
CACHE_BYTES, CACHE_PAIRS = 64 << 20, 300_000
#: Bytes that a remembered string takes beside its letters and ids.
ENTRY = 200
#: Symbols of a word up to which a plain scan finds the best pair faster than a heap.
SCAN = 40
#: Bytes of text that are worked on at once.
SLICE = 1 << 20
NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class Tokens:
    """The tokens of a tokenizers file as they are shown."""

    def __init__(self, spec: dict) -> None:
        found = {**spec["model"]["vocab"], **{x["content"]: x["id"] for x in spec["added_tokens"]}}
        self.shown = [b""] * (max(found.values()) + 1)
        for t, i in found.items():
            self.shown[i] = t.encode()

    def decode(self, ids: bytes) -> bytes:
        """The tokens of the ids joined by spaces, in UTF-8; the file names no decoder of its own."""
        return b" ".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class WordBpe:
    """A word-end BPE vocabulary read from a tokenizers file."""

    def __init__(self, spec: dict) -> None:
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        mark = lambda s: s[: -len(suffix)] + END if s.endswith(suffix) and len(s) > len(suffix) else s
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {mark(t): i for t, i in model["vocab"].items() if t not in self.specials}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left id, right id) as one integer -> (rank, merged id) as one integer
        self.merge = {self.ids[mark(a)] << 16 | self.ids[mark(b)]: r << 16 | self.ids[mark(a) + mark(b)] for r, (a, b) in enumerate(merges)}
        if max([*model["vocab"].values(), *self.specials.values()]) >= 1 << 16:
            raise ValueError("ids of more than 16 bits are not supported")
        self.text_of = {i: t for t, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.trie = ahocorasick.Automaton()
        for t in self.ids:
            self.trie.add_word(t, True)
        self.letters = byte_letters()
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.specials, key=len, reverse=True)) or r"(?!)")
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\s", r"\p{White_Space}"))
        self.known: dict[str, bytes] = {}
        self.ids_of: dict[str, bytes] = {}
        #: what has been met again, in a later batch than the one that taught it
        self.again: set[str] = set()
        self.pairs, self.holds = np.empty(0, np.int64), np.empty(0, bool)
        self.alone: dict[int, bool] = {}
        self.merged, self.held = 0, 0

    def exact(self, symbols: list[str]) -> list[int]:
        """Ids after merging the lowest-ranked pair, leftmost first, until none is left."""
        ids = [self.ids[x] for x in symbols]
        get = self.merge.get
        if len(ids) > SCAN:
            return self.exact_long(ids)
        ranks = [get(a << 16 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != NONE:
            i = ranks.index(best)
            ids[i] = made = best & 0xFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 16 | made, NONE)
            if i < len(ranks):
                ranks[i] = get(made << 16 | ids[i + 1], NONE)
        return ids

    def exact_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of pairs over a linked list; an entry counts if its place still holds that pair."""
        n, get = len(ids), self.merge.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, i) for i in range(n - 1) if (found := get(ids[i] << 16 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j == n or get(ids[i] << 16 | ids[j]) != best:
                continue
            ids[i], ids[j] = best & 0xFFFF, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := get(ids[i] << 16 | ids[k])) is not None:
                    heapq.heappush(heap, (found, i))
            if (h := before[i]) >= 0 and (found := get(ids[h] << 16 | ids[i])) is not None:
                heapq.heappush(heap, (found, h))
        return [x for x in ids if x >= 0]

    @staticmethod
    def split(token: str) -> list[str]:
        return [*token[:-2], token[-2:]] if token.endswith(END) else list(token)

    def greedy(self, word: str) -> list[int]:
        """Longest match from the left; the last letter is never parted from the word end."""
        out, i, n, get, prefix, longest = [], 0, len(word), self.ids.get, self.trie.longest_prefix, self.longest
        while i < n:
            j = i + prefix(word[i : i + longest])
            while j > i and (j == n - 1 or (k := get(word[i:j])) is None):
                j -= 1
            if j == i:
                raise ValueError("the vocabulary does not cover all bytes")
            out.append(k)
            i = j
        return out

    def self_encoding(self, token: int) -> bool:
        if token not in self.alone:
            t = self.text_of[token]
            self.alone[token] = self.exact(self.split(t)) == [token]
        return self.alone[token]

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """Which of the sorted pair codes (left id * 2**32 + right id) encode to themselves."""
        at = np.searchsorted(self.pairs, codes)
        fresh = codes[np.append(self.pairs, -1)[at] != codes]
        if fresh.size:
            left, right = (fresh >> 32).tolist(), (fresh & 0xFFFFFFFF).tolist()
            text = self.text_of
            more = np.fromiter((self.exact(self.split(text[a]) + self.split(text[b])) == [a, b] for a, b in zip(left, right, strict=True)), bool, fresh.size)
            if self.pairs.size > CACHE_PAIRS:
                self.pairs, self.holds = self.pairs[:0], self.holds[:0]
                return self.compatible(codes)
            at = np.searchsorted(self.pairs, fresh)
            self.pairs, self.holds = np.insert(self.pairs, at, fresh), np.insert(self.holds, at, more)
        return self.holds[np.searchsorted(self.pairs, codes)]

    def words_to_ids(self, words: list[str]) -> list[list[int]]:
        """Encode byte-letter words that carry the end mark."""
        if not words:
            return []
        out = [self.greedy(w) for w in words]
        sizes = np.array([len(x) for x in out])
        flat = np.fromiter((t for x in out for t in x), np.int64, int(sizes.sum()))
        word_of = np.repeat(np.arange(len(out)), sizes)
        inside = word_of[1:] == word_of[:-1]
        codes, back = np.unique((flat[:-1][inside] << 32) | flat[1:][inside], return_inverse=True)
        failed = np.zeros(len(out), bool)
        failed[word_of[1:][inside][~self.compatible(codes)[back]]] = True
        for i in np.flatnonzero(sizes == 1).tolist():
            failed[i] = not self.self_encoding(out[i][0])
        for i in np.flatnonzero(failed).tolist():
            out[i] = self.exact(self.split(words[i]))
        self.merged += int(failed.sum())
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks of text without white space and keep their ids."""
        order, parts, ids = list(chunks), [], self.ids_of
        fresh: dict[str, str] = {}
        for chunk in order:
            text = chunk if chunk.isascii() or unicodedata.is_normalized("NFC", chunk) else unicodedata.normalize("NFC", chunk)
            found = self.words.findall(text.replace("Σ", "σ").lower())
            parts.append(found)
            for w in found:
                if w not in ids and w not in fresh:
                    fresh[w] = (w if w.isascii() and w.isprintable() else "".join(map(self.letters.__getitem__, w.encode()))) + END
        fresh_words = list(fresh)
        for start in range(0, len(fresh_words), 20_000):
            some = fresh_words[start : start + 20_000]
            got = self.words_to_ids([fresh[w] for w in some])
            ids.update((w, struct.pack(f"<{len(x)}I", *x)) for w, x in zip(some, got, strict=True))
        made = [ids[found[0]] if len(found) == 1 else b"".join([ids[w] for w in found]) for found in parts]
        self.known.update(zip(order, made, strict=True))
        self.held += sum(map(len, order)) + sum(map(len, made)) + ENTRY * len(order) + sum(len(w) + len(ids[w]) + ENTRY for w in fresh)

    def chunks(self, text: str) -> list[str]:
        """Special strings and the runs between white space, in order."""
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # these are not White_Space
            cut = lambda s: regex.split(r"\p{White_Space}+", s)
        else:
            cut = str.split
        if self.special.search(text) is None:
            return cut(text)
        out: list[str] = []
        for i, piece in enumerate(re.split(f"({self.special.pattern})", text)):
            out += [piece] if i % 2 else cut(piece)
        return out

    def forget(self) -> None:
        """Keep chunks that were met again, and their words, as long as they take half of the bound at most."""
        known = {c: self.known[c] for c in self.again if c in self.known}
        ids_of = {c: self.ids_of[c] for c in known if c in self.ids_of}
        self.again.clear()
        self.held = sum(len(s) + len(x) + ENTRY for kept in (known, ids_of) for s, x in kept.items())
        if self.held > CACHE_BYTES // 2:
            known, ids_of, self.held = {}, {}, 0
        self.known, self.ids_of = known, ids_of

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.held > CACHE_BYTES:
            self.forget()
        split = [self.chunks(t) for t in texts]
        known = self.known
        known.update({s: np.array([i], "<u4").tobytes() for s, i in self.specials.items()})
        met = set().union(*split)
        fresh = met.difference(known)
        self.again |= met - fresh
        self.learn(fresh)
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every whole text: ``key``, ``ids`` binary (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(read_spec(path))
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids = bpe.encode_batch([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], [key, "ids"])

    return docs.select(key, text).mapInArrow(arrow(run), f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary")


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of encoded rows: ``key``, ``ids``, ``decoded`` binary (UTF-8)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = Tokens(read_spec(path))
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                texts = [shown.decode(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.binary())], [key, ids, "decoded"])

    return tokens.select(key, ids).mapInArrow(arrow(run), f"`{key}` {tokens.schema[key].dataType.simpleString()}, `{ids}` binary, decoded binary")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What :func:`decode` gives for the rows of :func:`encode`: ``key``, ``ids``, ``decoded``, by one Python process a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec = read_spec(path)
        bpe, shown = WordBpe(spec), Tokens(spec)
        del spec
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                ids = bpe.encode_batch([t or "" for t in part.column(1).to_pylist()])
                texts = [shown.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())], [key, "ids", "decoded"])

    return docs.select(key, text).mapInArrow(arrow(run), f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary, decoded binary")
