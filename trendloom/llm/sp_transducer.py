"""SentencePiece encoding and decoding by a weighted transducer.

Compiled from a model file are three parts:

* the normaliser: each space becomes U+2581, and one is put in front of a text
  that is not empty (the identity normaliser of the file; others are refused);
* the pieces: an automaton with an arc for each piece of the vocabulary;
* byte fallback: a character that no piece holds becomes the ids of its bytes.

A BPE model's scores order its merges and do not add up along a path.  So the
weights of the tropical semiring lie on pairs of neighbouring pieces: 0 if the
merges leave the pair ``ab`` as ``a`` then ``b``, infinite if they do not.  A
sequence of pieces is the BPE encoding of its text exactly if each
neighbouring pair is (the first merge over a border would also be made in the
pair alone).  Hence each place of the input is reached by one finite path, and
the shortest path of input, pieces and pair weights is the library's encoding.

No piece goes on after a character with U+2581 (checked on compiling), so
the composition runs over each stretch from one U+2581 to the next, and a task
remembers the paths of stretches that it has met, up to a fixed number.

Defined results: null and empty texts have no ids and decode to ''.  U+2581
itself is the normaliser's space, so it comes back as a space; every other text
comes back as it was.  Repeated rows get one row each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.tokenizer_files import Generations, public_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
MEMO_STRETCHES = 200_000
MEMO_PAIRS = 300_000
UNREACHED, UNKNOWN = -2, -1


def _fields(data: bytes) -> dict[int, list]:
    """Field number -> values of one protobuf message."""
    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at
    found, at = {}, 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if tag & 7 == 2 else ((8 if tag & 7 == 1 else 4), at)
            value, at = data[at:at + size], at + size
        found.setdefault(tag >> 3, []).append(value)
    return found


class Transducer:
    """Encodes and decodes single texts; one for each Python worker."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            spec = _fields(f.read())
        trainer, norm = _fields(spec[2][0]), _fields(spec[3][0])
        if trainer.get(3, [1])[0] != 2 or norm.get(2, [b""])[0] or not norm.get(3, [1])[0] \
                or norm.get(4, [1])[0] or trainer.get(24, [0])[0]:
            raise ValueError("needs a BPE model with the identity normaliser and a space in front")
        ids = range(model.get_piece_size())
        self.byte_ids = {int(model.id_to_piece(i)[3:-1], 16): i for i in ids if model.is_byte(i)}
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {i: model.id_to_piece(i) for i in plain}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces.values()):
            raise ValueError("a piece goes on after a character with a space")
        self.scores = {p: model.get_score(i) for i, p in self.pieces.items()}
        self.bytes_of = {i: p.encode() for i, p in self.pieces.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.chars = {p for p in self.pieces.values() if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for i, p in self.pieces.items():
            if self.merged(p) == [p]:  # pieces that merging can reach
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        # characters without a piece that often stand inside lines of text end a stretch
        apart = "".join(re.escape(c) for c in map(chr, range(32)) if c not in self.chars)
        self.stretch = re.compile(f" *[^ {apart}]+| +|[{apart}]")  # with spaces, which the normaliser replaces
        self.pairs: dict[int, bool] = {}
        self.paths = Generations(MEMO_STRETCHES, lambda some: list(map(self.path, some)))

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves: again and again the neighbours whose
        union has the highest score, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = max(((scores.get(a + b, float("-inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == float("-inf"):
                break
            parts[-at:2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def finite(self, a: int, b: int) -> bool:
        """Whether the pair's weight is 0 and not infinite."""
        key = a << 24 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > MEMO_PAIRS:
                self.pairs.clear()
            x, y = self.pieces[a], self.pieces[b]
            found = self.pairs[key] = self.merged(x + y) == [x, y]
        return found

    def path(self, stretch: str) -> bytes:
        """Ids (as C integers) along the path of finite weight through one stretch."""
        stretch = stretch.replace(" ", SPACE)
        n, known, finite = len(stretch), self.pairs.get, self.finite
        piece, length = [UNREACHED] * (n + 1), [1] * (n + 1)  # the arc that ends at each place
        if not self.chars.issuperset(stretch):
            for place, char in enumerate(stretch):
                if char not in self.chars:
                    piece[place + 1] = UNKNOWN
        for end, (arc, size) in self.automaton.iter(stretch):
            end += 1
            if piece[end] != UNREACHED:
                continue
            if start := end - size:
                before = piece[start]
                if before == UNREACHED:
                    continue
                if before != UNKNOWN:
                    weight = known(before << 24 | arc)
                    if not (finite(before, arc) if weight is None else weight):
                        continue
            piece[end], length[end] = arc, size
        ids, at = array("i"), n
        while at:
            if piece[at] == UNKNOWN:
                ids.extend(self.byte_ids[b] for b in reversed(stretch[at - 1].encode()))
            else:
                ids.append(piece[at])
            at -= length[at]
        ids.reverse()
        return ids.tobytes()

    def encode_all(self, texts: list[str | None]) -> list[array]:
        stretches = [self.stretch.findall(" " + t.replace(SPACE, " ")) if t else () for t in texts]
        return [array("i", ids) for ids in self.paths.joined(stretches)]

    def encode(self, text: str | None) -> array:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        """The text of a sequence of ids; ids without text (control) have none."""
        text = b"".join(map(self.bytes_of.get, ids, [b""] * len(ids))).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every document."""
    path = path or public_path(MODEL)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        fst = transducer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):  # long documents: small pieces of output
                part = batch.slice(lo, 256)
                ids = fst.encode_all(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.frombuffer(b"".join(i.tobytes() for i in ids), np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), column], ["doc_id", "ids"])
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (with a column ids) with the columns ``decoded`` and
    ``ids_crc32`` (of the ids as little-endian 32-bit integers)."""
    path = path or public_path(MODEL)
    schema = encoded.select("*", F.lit("").alias("decoded"), F.lit(0).cast("long").alias("ids_crc32")).schema
    at = encoded.columns.index("ids")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        fst = transducer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids = [np.asarray(i.values.to_numpy(zero_copy_only=False), dtype="<i4") if i.is_valid else np.zeros(0, "<i4")
                       for i in part.column(at)]
                texts = pa.array([fst.decode(i.tolist()) for i in ids], pa.string())
                crc = pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, texts, crc], [*part.schema.names, "decoded", "ids_crc32"])
    return encoded.mapInArrow(run, schema)


def encoded_and_checked(docs: DataFrame, path: str | None = None, id_col: str = "doc_id",
                        text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids (unless ``keep_ids`` is off), ids_crc32 and whether
    decoding gives the text back.  Encoding and decoding are one pass, so
    a core needs one Python worker and the ids do not travel between."""
    path = path or public_path(MODEL)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_ids", *["ids"] * keep_ids, "ids_crc32", "round_trip"]
    schema = f"doc_id {kind}, n_ids long, {'ids array<int>, ' * keep_ids}ids_crc32 long, round_trip boolean"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        fst = transducer(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = part.column(1).to_pylist()
                ids = fst.encode_all(texts)
                raw = [i.tobytes() for i in ids]
                back = [fst.decode(i) == (t or "").replace(SPACE, " ") for i, t in zip(ids, texts, strict=True)]
                columns = [part.column(0), pa.array(list(map(len, ids)), pa.int64())]
                if keep_ids:
                    ends = np.cumsum([0, *map(len, ids)])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), "<i4"))))
                columns += [pa.array(list(map(zlib.crc32, raw)), pa.int64()), pa.array(back, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names)
    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 and whether decoding gives the text back."""
    return encoded_and_checked(docs, path, id_col, text_col, keep_ids=False)
