"""Loading public tokenizer files inside tasks.

``path`` names a file that every executor can read (an installed package or a
file shipped with the job).  ``PieceMemo`` gives the ids that the tokenizers
library gives for whole texts, and asks the library only for pieces (what its
pre-tokenizer splits off) that the task has not met before.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
from array import array
from functools import lru_cache
from itertools import chain

#: The split patterns of the two public files, as the files have them.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose class, case and normal form are the same in Python and in
#: the library, one for one; texts with others go to the library whole.
PLAIN_END = 0x024F
NOT_PLAIN = re.compile(r"[^\t-\r\x20-\x7e\xa0-įı-ɏ]")
MEMO_PIECES = 500_000


def public_path(name: str) -> str:
    """Place of a public tokenizer file (a default; any path may be passed)."""
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def version_digest(path: str) -> str:
    """sha256 of the file, and the library's version."""
    import sentencepiece
    import tokenizers
    library = sentencepiece if path.endswith(".model") else tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library.__name__} {library.__version__}".encode()).hexdigest()


def _class(kind: str) -> str:
    """Characters of a Unicode class up to PLAIN_END, for Python's ``re``."""
    return "".join(re.escape(chr(c)) for c in range(PLAIN_END + 1) if unicodedata.category(chr(c))[0] == kind)


class Generations(dict):
    """A bounded memo.  When it holds ``limit`` keys it becomes the older
    generation and starts anew; what is met again comes back from there, so
    frequent keys stay.  ``make`` computes the values of a list of new keys."""

    def __init__(self, limit: int, make):
        super().__init__()
        self.limit, self.make, self.older = limit, make, {}

    def joined(self, texts: list[list]) -> list[bytes]:
        """The values of each list of keys, joined.  The memo is asked once for
        each distinct key; the lists are joined from those alone, a table small
        enough for the CPU's cache."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        here, new = dict.fromkeys(chain.from_iterable(texts)), []
        known, before = self.get, self.older.get
        for k in here:
            v = known(k)
            if v is None:
                v = before(k)
                if v is None:
                    new.append(k)
                    continue
                self[k] = v
            here[k] = v
        for lo in range(0, len(new), 10_000):
            part = new[lo:lo + 10_000]
            made = dict(zip(part, self.make(part), strict=True))
            here.update(made)
            self.update(made)
        return [b"".join(map(here.__getitem__, keys)) for keys in texts]


class PieceMemo:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, pieces: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.memo = Generations(pieces, self._pieces)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.lower, pattern = self._kind(spec)
        mark = spec["model"].get("end_of_word_suffix")
        self.ends = frozenset(i for t, i in self.tokenizer.get_vocab().items() if t.endswith(mark)) if mark else None
        self.split = pattern and re.compile(
            pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}")
            .replace(r"[^\s\p{L}\p{N}]", r"[^\s" + _class("L") + _class("N") + "]")
            .replace(r"\p{L}", "[" + _class("L") + "]").replace(r"\p{N}", "[" + _class("N") + "]"))

    @staticmethod
    def _kind(spec: dict) -> tuple[bool, str | None]:
        """(lower-cases, split pattern) if the file is one whose pieces are
        encoded each for itself, else no pattern."""
        text = json.dumps(spec.get("pre_tokenizer"))
        norm = spec.get("normalizer")
        if norm is None and spec["pre_tokenizer"].get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space"):
            return False, BYTE_PATTERN
        kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        if kinds == ["NFC", "Replace", "Lowercase"] and json.dumps(WORD_PATTERN)[1:-1] in text:
            return True, WORD_PATTERN
        return False, None

    def _library(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of single pieces.  Where the vocabulary marks the ends of
        words, they are encoded as the lines of one text and cut at the marks."""
        if self.ends is None:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        ids = self.tokenizer.encode("\n".join(pieces), add_special_tokens=False).ids
        flat = array("I", ids).tobytes()
        cuts = [4 * i for i, end in enumerate(map(self.ends.__contains__, ids), 1) if end]
        if len(cuts) != len(pieces):
            return self._library(pieces)
        return [flat[a:b] for a, b in zip([0, *cuts], cuts)]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        whole = [self.split is None or NOT_PLAIN.search(t) is not None or any(s[:2] in t for s in self.special) for t in texts]
        found = self.memo.joined([() if by_library else self.split.findall(t.lower() if self.lower else t)
                                  for t, by_library in zip(texts, whole, strict=True)])
        if any(whole):
            at = [i for i, by_library in enumerate(whole) if by_library]
            for i, ids in zip(at, self._library([texts[i] for i in at]), strict=True):
                found[i] = ids
        return found

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def release_memos() -> None:
    """Drop what this worker remembers of tokenizers.  Workers serve one stage
    after the other; tasks that need memory for other things call this first."""
    memo_of.cache_clear()
    transducers = sys.modules.get("trendloom.llm.sp_transducer")
    if transducers is not None:
        transducers.transducer.cache_clear()


def in_slices(texts, rows: int = 256):
    """Lists of up to ``rows`` strings of an Arrow column."""
    for lo in range(0, len(texts), rows):
        yield texts.slice(lo, rows).to_pylist()


@lru_cache(maxsize=2)
def memo_of(path: str, pieces: int = MEMO_PIECES) -> PieceMemo:
    """One memo for each file in a Python worker."""
    return PieceMemo(path, pieces)
