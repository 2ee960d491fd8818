"""SentencePiece encoding by one pass of an Aho-Corasick automaton, and decoding.

The automaton reports, at every position, all pieces that end there (its output links). For a
unigram model each of them relaxes the best score of the position: Viterbi. A BPE model is not a
best-score segmentation: its ids are those of the merge order. There, of the pieces that end at a
position, the one is kept that the merges would leave next to the last piece of the text before it;
a sequence is the merges' result exactly if every two neighbours are, so the same single pass gives
the library's ids.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.recent import Recent

SPACE = "▁"
#: Units of each of two generations, and pairs, that a worker remembers.
CACHED_UNITS = 150_000
CACHED_PAIRS = 400_000
CHUNK_CHARS = 1 << 19
_START, _BYTES = -1, -2
_models: dict[tuple[str, str | None], PieceModel] = {}


class PieceModel:
    """Pieces of a model file; `kind` ("bpe" or "unigram") is the file's own unless given."""

    def __init__(self, path: str, kind: str | None = None):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with identity normalization are read")
        self.kind = kind or {1: "unigram", 2: "bpe"}[model.trainer_spec.model_type]
        self.prefix = SPACE if model.normalizer_spec.add_dummy_prefix else ""
        self.names = [p.piece for p in model.pieces]
        self.scores = [p.score for p in model.pieces]
        kinds = proto.ModelProto.SentencePiece
        self.normal = {p.piece: k for k, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.byte_ids = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.singles = {p for p in self.normal if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, k in self.normal.items():
            self.automaton.add_word(piece, (k, len(piece)))
        self.automaton.make_automaton()
        worst = min((self.scores[k] for k in self.normal.values()), default=0.0)
        self.unknown_score = worst - 10.0
        # A piece has the space sign only in front (or is made of it), and line breaks and tabs are
        # in no piece: texts fall into units that are encoded one by one and repeat a lot.
        local = all(SPACE not in p.lstrip(SPACE) and not re.search(r"[\n\t]", p) for p in self.normal)
        self.unit = re.compile(f"{SPACE}*[^{SPACE}\n\t]+|{SPACE}+|[\n\t]" if local else r"(?s).+")
        self.units = Recent(CACHED_UNITS)
        self.pairs: dict[int, bool] = {}
        texts = [p.replace(SPACE, " ").encode() if k in set(self.normal.values()) else b"" for k, p in enumerate(self.names)]
        for byte, k in self.byte_ids.items():
            texts[k] = bytes([byte])
        texts[self.unknown] = model.trainer_spec.unk_surface.encode()
        self.texts = texts

    @classmethod
    def of(cls, path: str, kind: str | None = None) -> PieceModel:
        if (path, kind) not in _models:
            _models[path, kind] = cls(path, kind)
        return _models[path, kind]

    def merged(self, text: str) -> list[str]:
        """The merges spelled out for a short string: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                at = self.normal.get(parts[k] + parts[k + 1])
                if at is not None and (best is None or self.scores[at] > best[0]):
                    best = (self.scores[at], k)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follows(self, left: int, right: int) -> bool:
        """Whether the merges leave `right` after `left` (a piece, or a start or byte run)."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        before = [self.names[left]] if left >= 0 else []
        whole = [*before, self.names[right]]
        known = self.pairs[left << 20 | right] = self.merged("".join(whole)) == whole
        return known

    def encode_unit(self, unit: str) -> list[int]:
        n = len(unit)
        last: list[int | None] = [None] * (n + 1)
        size = [1] * (n + 1)
        last[0] = _START
        if not self.singles.issuperset(unit):
            for k, c in enumerate(unit):
                if c not in self.singles:
                    last[k + 1] = _BYTES
        if self.kind == "bpe":
            known = self.pairs.get
            for end, (piece, width) in self.automaton.iter(unit):
                end += 1
                if last[end] is None:
                    before = last[end - width]
                    if before is not None:
                        fits = known(before << 20 | piece)
                        if self.follows(before, piece) if fits is None else fits:
                            last[end], size[end] = piece, width
        else:
            best = [-np.inf] * (n + 1)
            best[0] = 0.0
            done = 0

            def advance(upto: int) -> None:
                for k in range(done, upto):
                    if unit[k] not in self.singles:
                        best[k + 1], last[k + 1], size[k + 1] = max(
                            (best[k + 1], last[k + 1], size[k + 1]), (best[k] + self.unknown_score, _BYTES, 1)
                        )

            for end, (piece, width) in self.automaton.iter(unit):
                advance(end)
                done = end
                score = best[end + 1 - width] + self.scores[piece]
                if score > best[end + 1]:
                    best[end + 1], last[end + 1], size[end + 1] = score, piece, width
            advance(n)
        ids: list[int] = []
        at = n
        while at > 0:
            piece = last[at]
            if piece is None:
                raise RuntimeError("a position without a piece")
            if piece == _BYTES:
                raw = unit[at - 1].encode()
                if all(b in self.byte_ids for b in raw):
                    ids.extend(self.byte_ids[b] for b in reversed(raw))
                else:
                    ids.append(self.unknown)
                at -= 1
            else:
                ids.append(piece)
                at -= size[at]
        ids.reverse()
        return ids

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut = [self.unit.findall(self.prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        for u in self.units.missing({u for units in cut for u in units}):
            self.units.young[u] = array("i", self.encode_unit(u)).tobytes()
        ids = self.units.young.__getitem__
        return [b"".join(map(ids, units)) for units in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.texts.__getitem__, ids))
        if self.prefix and raw[:1] == b" " and ids and self.names[ids[0]][:1] == SPACE:
            raw = raw[1:]
        return raw.decode(errors="replace")


def _clash(keep: list[str], names: list[str]) -> None:
    if {c.lower() for c in keep} & set(names):
        raise ValueError(f"the input already has a column of {names}")


def _pieces_of(size: int, column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes of a variable-length column."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield lo, hi
        lo = hi


def encode_pieces(
    docs: DataFrame,
    model: str,
    text: str = "text",
    keep: list[str] | None = None,
    kind: str | None = None,
    check: bool = False,
) -> DataFrame:
    """`docs` (or its columns `keep`) with `piece_ids` (array of int) and `piece_bytes` (the same as
    little-endian 32-bit integers), row by row without a shuffle. With `check` also `exact`: whether
    decoding the ids in the same task gives the text back.

    Whole texts are encoded. Null or empty text: no ids. A column of these names in `keep` raises. The
    automaton is built once in a worker from the model file, which every executor must have.
    """
    keep = list(docs.columns if keep is None else keep)
    _clash(keep, ["piece_ids", "piece_bytes", *["exact"] * check])
    rest = [c for c in keep if c != text]
    source = docs.select(F.col(text).cast("string").alias(text), *[F.col(f"`{c}`") for c in rest])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.of(model, kind)
        for whole in batches:
            for lo, hi in _pieces_of(CHUNK_CHARS, whole.column(0)):
                batch = whole.slice(lo, hi - lo)
                texts = [t or "" for t in batch.column(0).to_pylist()]
                raw = pieces.encode_all(texts)
                exact = []
                if check:
                    back = [pieces.decode(np.frombuffer(r, dtype="<i4").tolist()) == t for r, t in zip(raw, texts, strict=True)]
                    exact = [pa.array(back, pa.bool_())]
                offsets = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], ids, pa.array(raw, pa.binary()), *exact],
                    [*keep, "piece_ids", "piece_bytes", *["exact"] * check],
                )

    shown = source.select(*keep).schema
    added = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("piece_bytes", T.BinaryType())]
    added += [T.StructField("exact", T.BooleanType())] * check
    return source.mapInArrow(encode, T.StructType([*shown, *added]))


def decode_pieces(
    df: DataFrame, model: str, ids: str = "piece_ids", to: str = "decoded", keep: list[str] | None = None
) -> DataFrame:
    """`df` (or its columns `keep`) with the text of the ids. Null ids: null; no ids: empty text."""
    keep = list(df.columns if keep is None else keep)
    _clash(keep, [to.lower()])
    rest = [c for c in keep if c != ids]
    source = df.select(F.col(ids).cast("array<int>").alias(ids), *[F.col(f"`{c}`") for c in rest])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.of(model)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                column = batch.column(0)
                flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
                sizes = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes).tolist()
                texts = [
                    pieces.decode(flat[e - n : e]) if ok else None
                    for e, n, ok in zip(ends, sizes.tolist(), column.is_valid().to_pylist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, to]
                )

    return source.mapInArrow(decode, T.StructType([*source.select(*keep).schema, T.StructField(to, T.StringType())]))
