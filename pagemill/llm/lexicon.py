"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The words of a corpus are counted; the frequent ones, with the ids that the merges give them, are compiled into a
minimal acyclic automaton whose words share suffixes. Each arc carries how many words lie before it, so a walk
ends in a word's number, and that in its ids. The automaton is flat arrays in one file that workers map into memory.
Words that it doesn't know are merged exactly.

Encoding is that of a BPE file with word ends: NFC, white space to one space, small letters, words by the file's split
pattern, byte-level signs. Decoding goes from ids to token strings, joined by a space, as the library does for a file
without a decoder. Texts with special tokens' strings, with control characters that only some libraries take for white
space, or with a code point that Python's tables don't know (the library's are newer) go through the library whole.

Defined cases: a null text is empty and has no ids, as has one of white space alone; texts of any length are encoded
whole; equal texts get equal results; an empty table gives no rows and an automaton without words; parts that tie at the
last count that would still fit `MOST_WORDS` are all left out; rows may lack a doc_id; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored, tuned

#: Most frequent parts of the corpus whose words are compiled.
MOST_WORDS = 50_000
#: Parts and words whose results a worker keeps, and distinct parts that one counter holds before it passes them on.
MOST_PARTS, MOST_KEPT_WORDS, MOST_COUNTED = 500_000, 350_000, 200_000
END = "</w>"
ID_BITS = 20
_NONE = 1 << 62
_ODD = ["<|", *map(chr, range(0x1C, 0x20))]


def _unknown() -> re.Pattern:
    """Code points beyond Python's tables, in whose place the library's may hold letters, marks or small forms."""
    unknown = [unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)]
    edges = [i for i in range(0x110000) if unknown[i] != (i > 0 and unknown[i - 1])] + [0x110000]
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(z - 1))}" for a, z in zip(edges[::2], edges[1::2], strict=False)) + "]")


class Merges:
    """The merges of a BPE file with word ends."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.words = regex.compile(next(x for x in model["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]).findall
        self.vocab = model["model"]["vocab"]
        self.names = {i: t for t, i in self.vocab.items()}
        #: Of a decimal id, as texts' ids are kept.
        self.named = {str(i): t for i, t in self.names.items()} | {str(t["id"]): t["content"] for t in model["added_tokens"]}
        self.strange = _unknown()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        #: Of a pair of ids: the merge's rank and, in the low bits, the id it makes.
        self.rank = {(self.vocab[a], self.vocab[b]): i << ID_BITS | self.vocab[a + b] for i, (a, b) in enumerate(pairs)}
        signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in signs]
        char_of = {b: chr(b) for b in signs} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.inner = [self.vocab[char_of[b]] for b in range(256)]
        self.last = [self.vocab[char_of[b] + END] for b in range(256)]

    def normal(self, part: str) -> str:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part)
            if "Σ" in part:
                return "".join([c.lower() for c in part])
        return part.lower()

    def split(self, part: str) -> list[str]:
        """The words of a part without white space."""
        text = self.normal(part)
        if text.isalpha():
            return [text]
        if text[-1] in ".,;:!?" and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.words(text)

    def ids(self, word: bytes) -> list[int]:
        """The word's ids, merged exactly: the pair of the lowest rank, leftmost first, until none is left."""
        s = [self.inner[b] for b in word[:-1]]
        s.append(self.last[word[-1]])
        if len(s) > 64:
            return self._long(s)
        get = self.rank.get
        ranks = [get(p, _NONE) for p in zip(s, s[1:], strict=False)]
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            s[i : i + 2] = [best & ((1 << ID_BITS) - 1)]
            del ranks[i]
            if i:
                ranks[i - 1] = get((s[i - 1], s[i]), _NONE)
            if i < len(ranks):
                ranks[i] = get((s[i], s[i + 1]), _NONE)
        return s

    def _long(self, s: list[int]) -> list[int]:
        """The same with a heap, for long words."""
        before, after = list(range(-1, len(s) - 1)), [*range(1, len(s)), -1]
        heap = [(self.rank[p], i, p) for i, p in enumerate(zip(s, s[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            rank, i, (a, b) = heapq.heappop(heap)
            new, j = rank & ((1 << ID_BITS) - 1), after[i]
            if s[i] != a or j < 0 or s[j] != b:
                continue
            s[i], s[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (p := (s[left], s[right])) in self.rank:
                    heapq.heappush(heap, (self.rank[p], left, p))
        return [x for x in s if x >= 0]


def compiled(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton of the words, with their ids as outputs, as one block of bytes."""
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def settled(final: bool, arcs: list[list[int]]) -> int:
        key = (final, tuple(map(tuple, arcs)))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[tuple[bool, list[list[int]]]] = [(False, [])]  # open states along the last word
    last = b""
    ordered = sorted(words)
    for word in [*ordered, None]:
        common = 0
        if word is not None:
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
        while len(path) - 1 > common:
            final, arcs = path.pop()
            path[-1][1][-1][1] = settled(final, arcs)
        if word is None:
            break
        for b in word[common:]:
            path[-1][1].append([b, -1])
            path.append((False, []))
        path[-1] = (True, path[-1][1])
        last = word
    root = settled(*path[0])
    count = np.zeros(len(states), np.int64)
    key, target, skip = [], [], []
    for i, (final, arcs) in enumerate(states):  # targets come before their sources
        n = int(final)
        for b, t in arcs:
            key.append(i << 8 | b)
            target.append(t)
            skip.append(n)
            n += count[t]
        count[i] = n
    ids = [words[w] for w in ordered]
    arrays = [np.array(key, np.int64), np.array(target, np.int32), np.array(skip, np.int32), np.array([f for f, _ in states], np.int8), np.cumsum([0, *map(len, ids)]).astype(np.int32), np.array([x for y in ids for x in y], np.int32)]
    head = np.array([root, *[len(a) for a in arrays]], np.int64)
    return b"".join(x.tobytes() + bytes(-x.nbytes % 8) for x in [head, *arrays])


class Lexicon:
    """The compiled automaton, mapped from a file."""

    KINDS = (np.int64, np.int32, np.int32, np.int8, np.int32, np.int32)

    def __init__(self, path) -> None:
        data = np.memmap(path, np.uint8, "r")
        head = data[: 8 * (len(self.KINDS) + 1)].view(np.int64)
        self.root, at, parts = int(head[0]), head.nbytes, []
        for n, kind in zip(head[1:].tolist(), self.KINDS, strict=True):
            size = n * np.dtype(kind).itemsize
            parts.append(data[at : at + size].view(kind))
            at += size + (-size % 8)
        self.key, self.target, self.skip, self.final, self.offsets, self.ids = parts

    @classmethod
    def placed(cls, block: bytes) -> Lexicon:
        """Mapped from a file without a name in this worker's temporary folder, which goes when the worker does."""
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            return cls(f)

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, None for those that aren't here; all words walk at once."""
        if not len(self.key):
            return [None] * len(words)
        n = np.array([len(w) for w in words], np.int64)
        able = np.flatnonzero((n > 0) & (n <= 64))
        flat, begins = np.frombuffer(b"".join(words), np.uint8), np.cumsum(n) - n
        state, number, live = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64), able
        for step in range(int(n[able].max(initial=0))):
            live = live[n[live] > step]
            key = state[live] << 8 | flat[begins[live] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = self.key[at] == key
            state[live[~hit]] = -1
            live, at = live[hit], at[hit]
            number[live] += self.skip[at]
            state[live] = self.target[at]
        good = np.zeros(len(words), bool)
        good[able] = (state[able] >= 0) & (self.final[np.maximum(state[able], 0)] == 1)
        return [self.ids[self.offsets[k] : self.offsets[k + 1]].tolist() if ok else None for k, ok in zip(number.tolist(), good.tolist(), strict=True)]


def part_counts(documents: DataFrame) -> DataFrame:
    """part and n: how often each white-space-separated part occurs in all texts."""
    tuned(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update((text or "").split())
            if len(seen) > MOST_COUNTED:
                yield out(seen)
                seen = Counter()
        yield out(seen)

    def out(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["part", "n"])

    return documents.select("text").mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def build_lexicon(documents: DataFrame, tokenizer: str, most: int = MOST_WORDS) -> bytes:
    """The compiled lexicon of the most frequent parts' words."""
    merges = Merges(tokenizer)
    counts = stored(part_counts(documents).where((F.col("n") > 1) & (F.length("part") <= 48)), "counts")
    # the least count that leaves `most` parts at most; the numbers of parts by count are few, as counts repeat
    # and `most` of them, from the highest, hold `most` parts at least
    cut, total = None, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).limit(most + 1).collect():
        total += r["count"]
        if total > most:
            break
        cut = r["n"]
    frequent = counts.where(F.col("n") >= cut).collect() if cut else []
    words = {w.encode() for r in frequent if not merges.strange.search(r["part"]) for w in merges.split(r["part"])}
    return compiled({w: merges.ids(w) for w in words if len(w) <= 64})


class Encoder:
    """Ids of texts, by the lexicon first; results of parts and words are kept up to a bound."""

    _made: dict[tuple[str, str], Encoder] = {}

    def __init__(self, tokenizer: str, block: bytes) -> None:
        self.merges, self.lexicon = Merges(tokenizer), Lexicon.placed(block)
        #: Decimal ids, joined by spaces; None for a part that only the library can encode.
        self.parts: dict[str, str | None] = {}
        self.words: dict[str, str] = {}

    @classmethod
    def of(cls, tokenizer: str, block: bytes) -> Encoder:
        """One encoder to a worker, for all its tasks."""
        key = tokenizer, hashlib.sha256(block).hexdigest()
        if key not in cls._made:
            cls._made.clear()
            cls._made[key] = cls(tokenizer, block)
        return cls._made[key]

    def learn(self, parts: list[str]) -> None:
        merges, known = self.merges, self.words
        strange = [p for p in parts if not p.isascii() and merges.strange.search(p)]
        if strange:
            self.parts.update(dict.fromkeys(strange))
            parts = list(set(parts) - set(strange))
        split = [merges.split(p) for p in parts]
        new = list({w for x in split for w in x if w not in known})
        if len(known) + len(new) > MOST_KEPT_WORDS:
            known.clear()
            new = list({w for x in split for w in x})
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, r, got in zip(new, raw, self.lexicon.find(raw), strict=True):
            known[w] = " ".join(map(str, merges.ids(r) if got is None else got))
        for part, x in zip(parts, split, strict=True):
            self.parts[part] = known[x[0]] if len(x) == 1 else " ".join([known[w] for w in x])

    def encode(self, texts: list[str]) -> list[str]:
        """Per text its decimal ids joined by spaces."""
        split, kept = [t.split() for t in texts], self.parts
        new = {p for x in split for p in x if p not in kept}
        if len(kept) + len(new) > MOST_PARTS:
            kept.clear()
            new = {p for x in split for p in x}
        self.learn(list(new))
        out = []
        for text, parts in zip(texts, split, strict=True):
            found = [kept[p] for p in parts]
            if None in found or any(x in text for x in _ODD):
                out.append(" ".join(map(str, self.merges.library.encode(text, add_special_tokens=False).ids)))
            else:
                out.append(" ".join(found))
        return out


def decode(ids: str, merges: Merges) -> str:
    """The text of decimal ids joined by spaces: token strings joined by a space; an id without a string is left out."""
    if not ids:
        return ""
    try:
        return " ".join(map(merges.named.__getitem__, ids.split(" ")))
    except KeyError:
        return " ".join([merges.named[i] for i in ids.split(" ") if i in merges.named])


def encode_documents(documents: DataFrame, tokenizer: str, block: bytes, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (decimal, joined by spaces) and decoded."""
    spark = tuned(documents.sparkSession)
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, sent.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            got, lo = [], 0
            while lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size < 1 << 19:
                    size += len(texts[hi])
                    hi += 1
                got += encoder.encode(texts[lo:hi])
                lo = hi
            sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
            read = [decode(i, encoder.merges) for i in got]
            out = [b.column(0), pa.array([i.count(" ") + 1 if i else 0 for i in got], pa.int64()), pa.array([sha(i) for i in got], pa.string()), pa.array([sha(d) for d in read], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out, names = [*out, pa.array(got, pa.string()), pa.array(read, pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * with_ids)
