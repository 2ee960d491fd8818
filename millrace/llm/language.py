"""Language identification: script-narrowed candidates and a Viterbi labelling of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import text as tx

UNKNOWN = "und"
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
SAMPLE_DOCS = 4000
SWITCH_PENALTY = 12.0
#: A script counts for a language from this share of its training letters on.
SCRIPT_SHARE = 0.01
_OUT = -1e6

#: First and last code point of the scripts' main Unicode blocks.
SCRIPTS = {
    "latin": [(0x0000, 0x02AF), (0x1E00, 0x1EFF), (0xFF00, 0xFF5F)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F)],
    "armenian": [(0x0540, 0x058F)],
    "hebrew": [(0x05C0, 0x05FF)],
    "arabic": [(0x0600, 0x077F), (0xFB40, 0xFEFF)],
    "indic": [(0x0900, 0x0DFF)],
    "thai": [(0x0E00, 0x0EFF)],
    "georgian": [(0x10C0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0xF900, 0xFAFF)],
}


def script_table() -> np.ndarray:
    """Bit of the script for each run of 64 code points below U+10000; the last bit: others."""
    table = np.full(1024, 1 << len(SCRIPTS), dtype=np.int64)
    for bit, ranges in enumerate(SCRIPTS.values()):
        for low, high in ranges:
            table[low >> 6 : (high >> 6) + 1] = 1 << bit
    return table


_LETTER_BYTE = np.zeros(256, dtype=bool)
_LETTER_BYTE[np.r_[0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[~_LETTER_BYTE] = 0x20
_HAS_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Words:
    """Words of a chunk of rows: n-gram buckets of every position, and the words' places."""

    buckets: list[np.ndarray]
    start: np.ndarray  # in the padded bytes
    end: np.ndarray
    first: np.ndarray  # first word of each row
    row_start: np.ndarray  # of each row, in the padded bytes
    scripts: np.ndarray  # bit set of each word


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letter bytes; a space is put before and after every row. Bucket 0 means none."""
    n = len(offsets) - 1
    padded = np.full(len(data) + n + 4, 0x20, dtype=np.uint8)
    raw = np.full(len(padded), 0x20, dtype=np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(n) + 1, np.diff(offsets))
    padded[place] = _FOLD[data]
    raw[place] = data
    gap = padded == 0x20
    start = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    end = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    row_start = offsets + np.arange(n + 1) + 1
    first = np.searchsorted(start, row_start)
    buckets = []
    code = padded.astype(np.uint64)
    size = len(padded) - 4
    key = code[:size].copy()
    valid = np.ones(size, dtype=bool)
    for order in range(2, max(ORDERS) + 1):
        key = (key << np.uint64(8)) | code[order - 1 : order - 1 + size]
        if order > 2:
            valid &= ~gap[order - 2 : order - 2 + size]
        if order in ORDERS:
            hashed = ((key + np.uint64(order)) * tx._BASE) >> np.uint64(48)
            buckets.append(np.where(valid, np.maximum(hashed.astype(np.int64), 1), 0))
    lead = raw.astype(np.int64)
    after = np.append(lead[1:], 0x20)
    page = np.where(lead < 0x80, lead >> 6, np.where(lead < 0xE0, lead & 0x1F, ((lead & 0x0F) << 6) | (after & 0x3F)))
    bits = np.where(lead >= 0xF0, 1 << len(SCRIPTS), script_table()[page])
    bits[((lead >= 0x80) & (lead < 0xC0)) | gap] = 0
    scripts = np.bitwise_or.reduceat(bits, start) if len(start) else np.zeros(0, np.int64)
    return Words(buckets, start, end, first, row_start, scripts)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: list[np.ndarray]  # per order: BUCKETS x languages
    scripts: np.ndarray  # allowed script bits per language

    def word_scores(self, words: Words) -> np.ndarray:
        """Log-probability of each word in each language; impossible scripts get _OUT."""
        if len(words.start) == 0:
            return np.zeros((0, len(self.languages)))
        total = np.zeros((len(words.buckets[0]), len(self.languages)), dtype=np.float64)
        for bucket, weight in zip(words.buckets, self.weights, strict=True):
            total += weight[bucket]
        # A word owns the positions from the gap before it to its last letter; of the rest only
        # gaps after gaps remain, whose pairs say nothing.
        own = np.zeros(len(total) + 1, dtype=np.int64)
        np.add.at(own, words.start - 1, 1)
        np.add.at(own, words.end, -1)
        total[np.cumsum(own[:-1]) == 0] = 0
        scores = np.add.reduceat(total, words.start - 1, axis=0)
        fits = (words.scripts[:, None] & self.scripts[None, :]) != 0
        fits[~fits.any(axis=1)] = True
        return np.where(fits, scores, scores + _OUT)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word: the row's path of greatest total score, where each change
    of language costs `penalty`. All rows advance together, longest first."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    steps = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(1, steps + 1), side="right")
    label = np.zeros(len(scores), dtype=np.int64)
    if steps == 0:
        return label
    own = np.arange(scores.shape[1])
    best = scores[begin[: active[0]]].copy()
    came = np.zeros(scores.shape, dtype=np.int16)
    for t in range(1, steps):
        n = active[t]
        now = best[:n]
        top = now.argmax(axis=1)
        moved = now[np.arange(n), top] - penalty
        stay = now >= moved[:, None]
        at = begin[:n] + t
        came[at] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, now, moved[:, None]) + scores[at]
    last = np.flatnonzero(count > 0)
    current = best.argmax(axis=1)
    label[begin[last] + count[last] - 1] = current[last]
    for t in range(steps - 1, 0, -1):
        n = active[t]
        at = begin[:n] + t
        label[at - 1] = came[at, label[at]]
    return label


def train(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    sample_docs: int = SAMPLE_DOCS,
) -> Model:
    """A model of the labelled rows of `docs`.

    About `sample_docs` rows of each language, chosen by a hash of `key`, are counted; all
    languages with a label and a text are learned. N-grams are counted on the executors; the
    driver gets one row for each language and bucket. Rows without text or label are skipped;
    no labelled rows raise.
    """
    rows = docs.select(
        F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")
    ).filter("t is not null and l is not null")
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        raise ValueError("no labelled rows")
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, sample_docs / sizes[x]))])
    unit = F.pmod(F.xxhash64(F.coalesce("k", F.lit(""))), F.lit(1 << 20)) / F.lit(float(1 << 20))
    index = F.create_map(*[F.lit(v) for k, x in enumerate(languages) for v in (x, k)])
    sample = rows.filter(unit < share[F.col("l")]).select(index[F.col("l")].alias("l"), "t")
    n_lang = len(languages)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = [np.zeros((n_lang, BUCKETS), dtype=np.int64) for _ in ORDERS]
        letters = np.zeros((n_lang, len(SCRIPTS) + 1), dtype=np.int64)
        for batch in batches:
            own = batch.column(0).to_numpy()
            for lo, hi, data, offsets in tx.chunks(batch.column(1)):
                words = split_words(data, offsets)
                row = np.searchsorted(words.row_start, np.arange(len(words.buckets[0])), side="right") - 1
                known = own[lo:hi][np.clip(row, 0, hi - lo - 1)]
                for k, bucket in enumerate(words.buckets):
                    grams[k] += np.bincount(known * BUCKETS + bucket, minlength=n_lang * BUCKETS).reshape(n_lang, BUCKETS)
                of_word = own[lo:hi][np.searchsorted(words.first, np.arange(len(words.start)), side="right") - 1]
                for bit in range(len(SCRIPTS) + 1):
                    has = (words.scripts >> bit) & 1
                    letters[:, bit] += np.bincount(of_word, weights=has * (words.end - words.start), minlength=n_lang).astype(np.int64)
        for kind, table in [*enumerate(grams), (-1, letters)]:
            of, at = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(of), kind), pa.int32()), pa.array(of, pa.int32()), pa.array(at, pa.int32()), pa.array(table[of, at], pa.int64())],
                ["kind", "l", "at", "n"],
            )

    counted = sample.mapInArrow(count, "kind int, l int, at int, n long").groupBy("kind", "l", "at").agg(F.sum("n").alias("n"))
    grams = [np.zeros((BUCKETS, n_lang)) for _ in ORDERS]
    letters = np.zeros((n_lang, len(SCRIPTS) + 1))
    for r in counted.collect():
        if r["kind"] < 0:
            letters[r["l"], r["at"]] = r["n"]
        else:
            grams[r["kind"]][r["at"], r["l"]] = r["n"]
    weights = []
    for table in grams:
        table[0] = 0
        rate = (table + 0.5) / (table.sum(axis=0) + 0.5 * BUCKETS)
        weight = np.log(rate) / len(ORDERS)
        weight -= weight.max(axis=1, keepdims=True)  # only differences between languages matter
        weight[0] = 0
        weights.append(weight.astype(np.float32))
    share = letters / np.maximum(letters.sum(axis=1, keepdims=True), 1)
    allowed = ((share >= SCRIPT_SHARE) * (1 << np.arange(letters.shape[1]))).sum(axis=1)
    return Model(languages, weights, allowed)


RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField(
            "lang_spans",
            T.ArrayType(
                T.StructType(
                    [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]
                ),
                False,
            ),
            False,
        ),
    ]
)


def identify(
    docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, penalty: float = SWITCH_PENALTY
) -> DataFrame:
    """`docs` (or its columns `keep`) with lang_pred, score and lang_spans.

    Words are runs of letters; `lang_spans` are maximal runs of words (byte ranges of the UTF-8
    text) of one language. lang_pred is the language with the most word bytes (ties: first by name),
    score its share of all word bytes. Null text, empty text and text without any letter: `und`,
    score 0, no spans. Texts are read whole, rows stay where they are; rows that repeat are
    judged alike. A name in `keep` equal to a result column raises. Without a model, where nothing
    could be learned, every row is `und`.
    """
    keep = list(docs.columns if keep is None else keep)
    if {c.lower() for c in keep} & set(RESULT.names):
        raise ValueError("columns clash with results")
    rest = [c for c in keep if c != text]
    source = docs.select(F.col(text).cast("string").alias(text), *[F.col(f"`{c}`") for c in rest])
    shown = source.select(*keep).schema
    if model is None:
        nothing = [F.lit(UNKNOWN), F.lit(0.0), F.array().cast(RESULT["lang_spans"].dataType)]
        return source.select(*keep, *[c.alias(n) for c, n in zip(nothing, RESULT.names, strict=True)])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets, whatever the input

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        limit = max(1 << 16, (1 << 22) // len(model.languages))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
        for batch in batches:
            for lo, hi, data, offsets in tx.chunks(batch.column(0), min(limit, tx.CHUNK_BYTES)):
                pred, score, spans = [], [], []
                words = split_words(data, offsets)
                best = viterbi(model.word_scores(words), words.first, penalty)
                size = words.end - words.start
                first = words.first
                change = np.ones(len(best), dtype=bool)
                change[1:] = best[1:] != best[:-1]
                change[first[first < len(best)]] = True
                runs = np.flatnonzero(change)
                run_end = np.append(runs[1:], len(best)) - 1
                run_of = np.searchsorted(runs, first)
                for r in range(hi - lo):
                    a, b = int(first[r]), int(first[r + 1])
                    if a == b or not _HAS_LETTER.search(data[offsets[r] : offsets[r + 1]].tobytes().decode()):
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        spans.append([])
                        continue
                    weight = np.bincount(best[a:b], weights=size[a:b], minlength=len(model.languages))
                    top = int(weight.argmax())
                    pred.append(model.languages[top])
                    score.append(float(weight[top] / weight.sum()))
                    base = int(words.row_start[r])
                    spans.append(
                        [
                            {"start": int(words.start[runs[k]]) - base, "end": int(words.end[run_end[k]]) - base, "lang": model.languages[best[runs[k]]]}
                            for k in range(int(run_of[r]), int(run_of[r + 1]))
                        ]
                    )
                # A chunk leaves as soon as it is judged, so neither side holds a whole batch twice.
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in keep],
                        pa.array(pred, pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(spans, pa.list_(span)),
                    ],
                    [*keep, *RESULT.names],
                )

    return source.mapInArrow(label, T.StructType([*shown, *RESULT]))
