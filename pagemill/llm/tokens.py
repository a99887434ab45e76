"""Token ids of a byte-level BPE file, with the parts of a text kept for the next one.

A part starts at a space or newline after a sign that isn't white space. Byte-level pre-tokens hold no such place
inside, so the ids of a text are those of its parts. Texts with other or doubled white space are split whole, by the
pattern that byte-level files have (fixed value). Texts that hold a special token's string go to the library whole, and
so does every text where the file isn't of that kind: another pre-tokenizer, a normalizer or merges that skip.
"""

from __future__ import annotations

import array
import json
import os

#: Parts whose ids are kept; beyond, the store starts anew.
MOST_PARTS = 400_000
#: What sends a text to the library whole: doubled or other white space, and our own mark.
_ODD = ["  ", " \n", "\n ", "\n\n", "\x00", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]


class ByteBpe:
    _made: dict[str, ByteBpe] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in signs} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in signs)}
        self.special = [t["content"] for t in file["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in self.special}
        #: Whether the parts' way is right: byte-level pre-tokens by the usual pattern, no normalizer, nothing put before.
        split, model = file.get("pre_tokenizer") or {}, file["model"]
        self.plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not file.get("normalizer") and model.get("type", "BPE") == "BPE" and not model.get("ignore_merges") and not model.get("dropout") and not model.get("end_of_word_suffix")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.merge = tiktoken.Encoding("parts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kept: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> ByteBpe:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def id_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.plain or any(s in text for s in self.special):
            return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if any(x in text for x in _ODD):
            return array.array("I", self.merge(text)).tobytes()
        parts = text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")
        kept = self.kept
        try:
            return b"".join([kept[p] for p in parts])
        except KeyError:
            if len(kept) > MOST_PARTS:
                kept.clear()
            for p in parts:
                if p not in kept:
                    kept[p] = array.array("I", self.merge(p)).tobytes()
            return b"".join([kept[p] for p in parts])
