"""Token ids as compressed blocks with an offset index, written and read by Spark.

A block is one Parquet row: concatenated zstandard frames (one for each document, made with one
shared dictionary), the documents' ids, token counts and frame offsets, and the hash of the
dictionary. Blocks lie in ascending order of document id; a block's id range is in the file
statistics, so one document is found by a pruned scan and one slice of one payload.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.recent import Recent

DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on at most so many documents, and so many bytes of each one's ids.
DICTIONARY_DOCS = 1000
DICTIONARY_DOC_BYTES = 16 << 10
BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 4096
LEVEL = 2
#: Words of each of two generations that a worker remembers.
CACHED_WORDS = 800_000

BLOCKS = (
    "shard int, block int, first_doc long, last_doc long, token_start long, block_tokens long, "
    "docs array<bigint>, counts array<bigint>, offsets array<bigint>, payload binary, dictionary string, width int"
)

#: All that `\s` matches but the space.
_BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(r"(?<=\S)(?= \S)")
_MARKS = ".,;:!?"
_encoders: dict[str, Encoder] = {}


def _irregular(text: str) -> bool:
    """Whether white space and a space are neighbours; a few plain searches take less than one pattern."""
    return "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in _BLANKS)


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once.

    A byte-level tokenizer never joins the two sides of a single space between visible characters:
    the space opens the next token. Texts are cut there, so equal words share their ids. New words
    are encoded together as one text and told apart by the tokens that open with a space. Where
    it does not join a letter and the punctuation mark after it, a word that ends so is its two parts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.opens = np.zeros(size, dtype=bool)
        for token, at in self.tokenizer.get_vocab().items():
            self.opens[at] = token.startswith("Ġ")
        cut = self.tokenizer.pre_tokenizer
        self.marks = frozenset(m for m in _MARKS if cut and cut.pre_tokenize_str("a" + m)[0][1] == (0, 1))
        self.known = Recent(CACHED_WORDS)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [
            np.array(e.ids, dtype=f"<u{self.width}")
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _learn(self, words: list[str]) -> None:
        known = self.known.young
        marked = [w for w in words if len(w) > 2 and w[-1] in self.marks and w[-2].isalpha()]
        parts = {w[:-1] for w in marked} | {w[-1] for w in marked}
        plain, odd = [], []
        for w in parts.difference(known).union(words).difference(marked):
            easy = len(w) > 1 and w[0] == " " and w.count(" ") == 1 and not w[1].isspace() and not w[-1].isspace()
            (plain if easy else odd).append(w)
        for w, ids in zip(odd, self._raw(odd), strict=True):
            known[w] = ids.tobytes()
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = self._raw(["".join(part)])[0]
            cuts = np.append(np.flatnonzero(self.opens[ids]), len(ids))
            if len(cuts) != len(part) + 1:
                raise RuntimeError("the tokenizer does not open words with a space")
            raw, cuts = ids.tobytes(), (cuts * self.width).tolist()
            for w, a, b in zip(part, cuts, cuts[1:], strict=False):
                known[w] = raw[a:b]
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [
            _CUT.split(t) if "\0" in t or _irregular(t) else t.replace(" ", "\0 ").split("\0")
            for t in texts
        ]
        self._learn(self.known.missing({w for words in cut for w in words}))
        ids = self.known.young.__getitem__
        return [b"".join(map(ids, words)) for words in cut]


def _batches(column: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about `limit` characters, null as empty."""
    at, texts, size = 0, [], 0
    for k in range(len(column)):
        texts.append(column[k].as_py() or "")
        size += len(texts[-1])
        if size >= limit:
            yield at, texts
            at, texts, size = k + 1, [], 0
    if texts:
        yield at, texts


def _sampler(path: str):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            ids = [x[:DICTIONARY_DOC_BYTES] for _, texts in _batches(batch.column(0)) for x in encoder.encode(texts)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    return sample


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """A dictionary from the id arrays of at most DICTIONARY_DOCS documents, chosen by hash.

    The ids are chosen first, so texts of other documents are not moved. Too few documents for
    training give their concatenation as a raw dictionary, none an empty one.
    """
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_DOCS)
    # At most DICTIONARY_DOCS rows on either side of this join leave it.
    texts = docs.join(F.broadcast(chosen.distinct()), "doc_id", "left_semi").select("text")
    rows = texts.mapInArrow(_sampler(tokenizer), "ids binary").limit(2 * DICTIONARY_DOCS).collect()
    samples = sorted(bytes(r["ids"]) for r in rows if r["ids"])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def _writer(tokenizer: str, end_id: int | None, sent):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = sent.value
        encoder = Encoder.of(tokenizer)
        code = hashlib.sha256(dictionary).hexdigest()
        packer = zstandard.ZstdCompressor(
            level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        )
        tail = b"" if end_id is None else np.array([end_id], dtype=f"<u{encoder.width}").tobytes()
        shard = TaskContext.get().partitionId()
        state = {"block": 0, "start": 0}
        docs: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []

        def block() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)])
            known = [d for d in docs if d is not None]
            row = {
                "shard": shard,
                "block": state["block"],
                "first_doc": min(known, default=None),
                "last_doc": max(known, default=None),
                "token_start": state["start"],
                "block_tokens": sum(counts),
                "docs": list(docs),
                "counts": list(counts),
                "offsets": offsets.tolist(),
                "payload": b"".join(frames),
                "dictionary": code,
                "width": encoder.width,
            }
            state["block"] += 1
            state["start"] += row["block_tokens"]
            docs.clear(), counts.clear(), frames.clear()
            longs = pa.list_(pa.int64())
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4, longs, longs, longs, pa.binary(), pa.string(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            names = batch.column(0)
            for at, texts in _batches(batch.column(1)):
                for k, ids in enumerate(encoder.encode(texts)):
                    ids += tail
                    docs.append(names[at + k].as_py())
                    counts.append(len(ids) // encoder.width)
                    frames.append(packer.compress(ids))
                    if len(docs) >= BLOCK_DOCS or sum(map(len, frames[-64:])) >= BLOCK_BYTES:
                        yield block()
        if docs:
            yield block()

    return write


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> str:
    """Encode `docs` and write the token files under `path`; returns the dictionary's hash.

    Files lie in ascending order of doc_id (nulls first, equal ids by text); each row is encoded
    whole. Null or empty text: only the end id, if any. No rows: no blocks. Other columns are not
    read, so names cannot clash. The width of an id is 2 bytes for vocabularies up to 65,536.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dictionary = train_dictionary(source, tokenizer)
    spark = docs.sparkSession
    code = hashlib.sha256(dictionary).hexdigest()
    stored = spark.range(1).select(
        F.lit(code).alias("hash"), F.unhex(F.lit(dictionary.hex())).alias("bytes")
    )
    stored.write.parquet(f"{path}/dictionary")
    sent = spark.sparkContext.broadcast(dictionary)
    (
        source.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_writer(tokenizer, end_id, sent), BLOCKS)
        .write.option("compression", "uncompressed")
        .parquet(f"{path}/blocks")
    )
    return code


def _dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["bytes"])
    if hashlib.sha256(dictionary).hexdigest() != row["hash"]:
        raise ValueError("the dictionary does not match its hash")
    return dictionary


def _reader(sent, wanted: list[int] | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = sent.value
        code = hashlib.sha256(dictionary).hexdigest()
        opener = zstandard.ZstdDecompressor(
            dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        )
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != code:
                    raise ValueError("a block was written with another dictionary")
                start, ids = [], []
                at = row["token_start"] + row["before"]
                keep = []
                for k, n in enumerate(row["counts"]):
                    if wanted is None or row["docs"][k] in wanted:
                        frame = row["payload"][row["offsets"][k] : row["offsets"][k + 1]]
                        raw = np.frombuffer(opener.decompress(frame), dtype=f"<u{row['width']}")
                        keep.append(k)
                        start.append(at)
                        ids.append(raw.astype("<u4").tobytes())
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["docs"][k] for k in keep], pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array([row["counts"][k] for k in keep], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return read


def read_tokens(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files alone.

    start counts the ids of all documents before; ids are little-endian unsigned 32-bit integers
    in a binary column. With `only`, blocks are pruned by their id range and nothing but the wanted
    frames is decompressed. A dictionary that does not match its hash raises.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row for each written file, so the running total and the broadcast are that small.
    totals = blocks.groupBy("shard").agg(F.sum("block_tokens").alias("n"))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    if only is not None:
        hit = F.lit(False)
        for d in only:
            hit = hit | ((F.col("first_doc") <= d) & (F.col("last_doc") >= d))
        blocks = blocks.filter(hit)
    sent = spark.sparkContext.broadcast(_dictionary(spark, path))
    return blocks.join(F.broadcast(before), "shard").mapInArrow(
        _reader(sent, only), "doc_id long, start long, n_tokens long, ids binary"
    )
