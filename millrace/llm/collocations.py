"""Phrase collocations: word ids, n-grams counted in quotient filters, exact scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.order import in_order
from millrace.llm import text as tx
from millrace.llm.quotient import Keys, Merger
from millrace.session import materialized

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[np.frombuffer(b".,;:!?\n\x0b\x0c\r", dtype=np.uint8)] = True
_GAPS = _BREAKS.copy()
_GAPS[[0x20, 0x09]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Text bytes that share one list of distinct words.
CHUNK_BYTES = 4 << 20
#: Distinct n-grams that a task counts before it writes them out as filters.
SEGMENT = 1 << 21
#: Words of the corpus for each bucket of n-grams, and bits of bucket that one exchange resolves.
BUCKET_WORDS = 1 << 20
STEP_BITS = 10
#: Ids are packed in at most this many bits each.
MOST_WIDTH = 32
#: Parts of a language's phrases that are ranked apart before they are ranked together.
RANK_PARTS = 64


@dataclass(frozen=True)
class Phrases:
    """Phrases of 2 or 3 words that occur at least `least` times; those inside a longer one with
    at least `share` percent of their occurrences go; `top` of each language are reported."""

    least: int = 10
    share: int = 50
    top: int = 2000


CODED = "chunk long, lang string, words array<binary>, counts array<long>, n long, seq binary"


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of one language: distinct words with counts, and all words as indexes into them.
    An index is inverted where a piece begins."""
    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        rows = np.argsort(codes, kind="stable")
        first = np.searchsorted(codes[rows], np.arange(len(langs.dictionary) + 1))
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).take(pa.array(rows[first[k] : first[k + 1]]))
            for _, _, data, offsets in tx.chunks(texts, CHUNK_BYTES):
                data = _FOLD[data]
                starts, ends, _ = tx.word_bounds(data, offsets, _GAPS)
                if not len(starts):
                    continue
                breaks = np.cumsum(_BREAKS[data])
                piece = breaks[starts] + np.searchsorted(offsets, starts, side="right")
                opens = np.concatenate([[True], piece[1:] != piece[:-1]])
                bounds = np.zeros(len(starts) + 1, dtype=np.int32)
                np.cumsum(ends - starts, out=bounds[1:])
                held = pa.py_buffer(np.ascontiguousarray(data[~_GAPS[data]]))
                words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), held])
                words = words.dictionary_encode()
                index = words.indices.to_numpy(zero_copy_only=False).astype(np.int32)
                counts = np.bincount(index, minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk], pa.int64()),
                        pa.array([lang], pa.string()),
                        pa.ListArray.from_arrays([0, len(counts)], words.dictionary),
                        pa.ListArray.from_arrays([0, len(counts)], pa.array(counts, pa.int64())),
                        pa.array([len(index)], pa.int64()),
                        pa.array([np.where(opens, ~index, index).tobytes()], pa.binary()),
                    ],
                    names=["chunk", "lang", "words", "counts", "n", "seq"],
                )
                chunk += 1


FILTERS = "n_words int, bucket long, filter binary"


def _filters(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    n_words, bucket, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(n_words, pa.int32()), pa.array(bucket, pa.int64()), pa.array(data, pa.binary())],
        names=["n_words", "bucket", "filter"],
    )


def _emit(keys: Keys, run, bits: int) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for bucket, part in keys.split(run, bits):
        rows.append((keys.words, bucket, keys.encode(part, bits)))
        size += len(rows[-1][2])
        if size > 4 << 20:
            yield _filters(rows)
            rows, size = [], 0
    if rows:
        yield _filters(rows)


def _counted(width: int, bits: int):
    """Counts the n-grams of coded chunks (seq, slots, ids) and writes them as filters."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [Keys(2, width), Keys(3, width)]
        held = [Merger(k) for k in kinds]
        for batch in batches:
            for row in range(batch.num_rows):
                seq = np.frombuffer(batch.column(0)[row].as_buffer(), dtype=np.int32)
                opens = seq < 0
                index = np.where(opens, ~seq, seq)
                known = np.zeros(int(index.max()) + 1, dtype=np.uint64)
                slots = batch.column(1)[row].values.to_numpy(zero_copy_only=False)
                known[slots] = batch.column(2)[row].values.to_numpy(zero_copy_only=False).astype(np.uint64)
                ids = known[index]
                joined = np.zeros(len(ids), dtype=bool)
                joined[1:] = ~opens[1:] & (ids[1:] > 0) & (ids[:-1] > 0)
                two = np.flatnonzero(joined)
                three = two[joined[two - 1]]
                for keys, merger, at in zip(kinds, held, (two, three), strict=True):
                    merger.add(keys.summed(*keys.pack([ids[at - k] for k in reversed(range(keys.words))])))
                    if len(merger) > SEGMENT:
                        yield from _emit(keys, merger.take(), bits)
        for keys, merger in zip(kinds, held, strict=True):
            yield from _emit(keys, merger.take(), bits)

    return task


def _merged(width: int, bits: int, finish):
    """Merges the filters of each (n_words, bucket) of a sorted partition; `finish` takes its run."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, merger = None, None
        for batch in batches:
            n_words, buckets = (batch.column(i).to_numpy() for i in (0, 1))
            for row in range(batch.num_rows):
                key = (int(n_words[row]), int(buckets[row]))
                if key != at:
                    if merger is not None:
                        yield from finish(merger.keys, merger.take())
                    at, merger = key, Merger(Keys(key[0], width))
                merger.add(merger.keys.decode(batch.column(2)[row].as_buffer(), key[1], bits))
        if merger is not None:
            yield from finish(merger.keys, merger.take())

    return task


COUNTED = "n_words int, w1 long, w2 long, w3 long, a long"


def _frequent(least: int):
    def finish(keys: Keys, run) -> Iterator[pa.RecordBatch]:
        often = run[2] >= least
        if not often.any():
            return
        ids = keys.unpack(run[0][often], run[1][often])
        n = len(ids[0])
        ids = [pa.array(x.astype(np.int64)) for x in ids]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, keys.words, dtype=np.int32)),
                *ids,
                *([] if keys.words == 3 else [pa.nulls(n, pa.int64())]),
                pa.array(run[2][often].astype(np.int64)),
            ],
            names=["n_words", "w1", "w2", "w3", "a"],
        )

    return finish


def _ngrams(chunks: DataFrame, width: int, n_words: int, least: int) -> DataFrame:
    """(n_words, w1, w2, w3, a) of the n-grams of at least `least` occurrences.

    Buckets hold about BUCKET_WORDS words of the corpus. One exchange resolves STEP_BITS bits of
    them; where there are more, the filters of a coarser bucket are merged in salted groups first
    and split further, so that a filter keeps many entries at any size.
    """
    bits = min(max(n_words // BUCKET_WORDS, 1).bit_length() - 1, width)
    level = min(bits, STEP_BITS)
    filters = chunks.select("seq", "slots", "ids").mapInArrow(_counted(width, level), FILTERS)
    while level < bits:
        deeper = min(bits, level + STEP_BITS)
        groups = F.pmod(F.xxhash64("filter"), F.lit(1 << (bits - level)))
        filters = (
            filters.repartition("n_words", "bucket", groups)
            .sortWithinPartitions("n_words", "bucket")
            .mapInArrow(_merged(width, level, lambda keys, run, b=deeper: _emit(keys, run, b)), FILTERS)
        )
        level = deeper
    gathered = filters.repartition("n_words", "bucket").sortWithinPartitions("n_words", "bucket")
    return gathered.mapInArrow(_merged(width, level, _frequent(least)), COUNTED)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of up to 38 digits."""
    a, left, right = (x.cast("decimal(19,0)") for x in (a, left, right))
    return F.call_function("div", (a * a * F.lit(1_000_000)).cast("decimal(38,0)"), (left * right).cast("decimal(38,0)"))


def _named(vocabulary: DataFrame, k: int) -> DataFrame:
    return vocabulary.select(
        F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"), F.col("lang").alias(f"lang{k}")
    )


def collocations(docs: DataFrame, rule: Phrases = Phrases()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases in (lang, text).

    Texts are split into pieces at .,;:!? and line breaks and into words at spaces and tabs, A-Z in
    lower case. `a` counts a phrase, `l` and `r` its two parts at the cut with the lowest score
    (the first of equal ones), `n` all words of the language. Order: score, a, phrase.

    Counting is exact. Words are counted first; every part of a phrase with `least` occurrences has
    as many, so rarer words only separate. Chunks of text are coded once, and each chunk's distinct
    words meet the vocabulary by a join on the word itself, so that no vocabulary is broadcast.
    N-grams of ids are counted in quotient filters inside the tasks and merged by bucket.

    A null language counts as `und`, a null text as empty. Repeated rows count. Other columns are
    not looked at. Languages without a phrase, and an empty input, give no row.
    """
    coded = materialized(
        docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text is not null").mapInArrow(_code, CODED),
        "coded",
    )
    totals = coded.groupBy("lang").agg(F.sum("n").alias("n"))
    entries = coded.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("slot", "entry")).select(
        "chunk", "slot", "lang", F.col("entry.words").alias("word"), F.col("entry.counts").alias("count")
    )
    known = entries.groupBy("lang", "word").agg(F.sum("count").alias("f")).filter(F.col("f") >= rule.least)
    vocabulary = in_order(known, [F.col("f").desc(), F.col("lang"), F.col("word")], "id")
    held = vocabulary.agg(F.max("id").alias("ids")).first()["ids"] or 0
    words = coded.agg(F.sum("n").alias("n")).first()["n"] or 0
    width = max(int(held).bit_length(), 8)
    if width > MOST_WIDTH:
        raise ValueError(f"{held} frequent words need more than {MOST_WIDTH} bits each")

    maps = (
        entries.join(vocabulary.select("lang", "word", "id"), ["lang", "word"])
        .groupBy("chunk")
        .agg(F.collect_list(F.struct("slot", "id")).alias("map"))
    )
    chunks = coded.select("chunk", "seq").join(maps, "chunk").select("seq", F.col("map.slot").alias("slots"), F.col("map.id").alias("ids"))
    counted = materialized(_ngrams(chunks, width, int(words), rule.least), "ngrams")
    two = counted.filter("n_words = 2").select("w1", "w2", "a")
    three = counted.filter("n_words = 3").select("w1", "w2", "w3", "a")

    longest = (
        three.select("w1", "w2", "a")
        .unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
        .groupBy("w1", "w2")
        .agg(F.max("a").alias("inside"))
    )
    pairs = (
        two.join(longest, ["w1", "w2"], "left")
        .filter(F.coalesce(100 * F.col("inside") < rule.share * F.col("a"), F.lit(True)))
        .join(_named(vocabulary, 1), "w1")
        .join(_named(vocabulary, 2), "w2")
        .select(
            F.col("lang1").alias("lang"),
            F.concat_ws(" ", F.col("word1").cast("string"), F.col("word2").cast("string")).alias("phrase"),
            "a",
            F.col("f1").alias("l"),
            F.col("f2").alias("r"),
            _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"),
        )
    )
    first = _score(F.col("a"), F.col("f1"), F.col("f23"))
    second = _score(F.col("a"), F.col("f12"), F.col("f3"))
    triples = (
        three.join(two.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"])
        .join(two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
        .join(_named(vocabulary, 1), "w1")
        .join(_named(vocabulary, 2).select("w2", "word2"), "w2")
        .join(_named(vocabulary, 3), "w3")
        .select(
            F.col("lang1").alias("lang"),
            F.concat_ws(" ", *[F.col(f"word{k}").cast("string") for k in (1, 2, 3)]).alias("phrase"),
            "a",
            F.when(second < first, F.col("f12")).otherwise(F.col("f1")).alias("l"),
            F.when(second < first, F.col("f3")).otherwise(F.col("f23")).alias("r"),
            F.least(first, second).alias("score"),
        )
    )
    # Each part of a language keeps its best first, so the last ranking sees a bounded number of rows.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    best = (
        pairs.unionByName(triples)
        .withColumn("part", part)
        .withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order)))
        .filter(F.col("rank") <= rule.top)
        .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
        .filter(F.col("rank") <= rule.top)
    )
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )


#: The phrases of `documents` with the settings of Phrases().
PHRASES_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, p FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)
), listed AS (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
words AS MATERIALIZED (
  SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3
  FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed)
), one AS MATERIALIZED (SELECT lang, w1 AS w, count(*) AS f FROM words GROUP BY ALL),
two AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS f FROM words WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= 10),
three AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS f FROM words WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= 10),
scored AS (
  SELECT t.lang, w1 || ' ' || w2 AS phrase, t.f AS a, x.f AS l, y.f AS r, 1000000::HUGEINT * t.f * t.f // (x.f::HUGEINT * y.f) AS score
  FROM two t JOIN one x ON x.lang = t.lang AND x.w = w1 JOIN one y ON y.lang = t.lang AND y.w = w2
  WHERE NOT EXISTS (FROM three z WHERE z.lang = t.lang AND 100 * z.f >= 50 * t.f
    AND ((z.w1 = t.w1 AND z.w2 = t.w2) OR (z.w2 = t.w1 AND z.w3 = t.w2)))
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN f12 ELSE f1 END, CASE WHEN s2 < s1 THEN f3 ELSE f23 END, least(s1, s2) FROM (
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS f1, y.f AS f23, u.f AS f12, v.f AS f3,
      1000000::HUGEINT * t.f * t.f // (x.f::HUGEINT * y.f) AS s1, 1000000::HUGEINT * t.f * t.f // (u.f::HUGEINT * v.f) AS s2
    FROM three t JOIN one x ON x.lang = t.lang AND x.w = t.w1 JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
    JOIN two u ON u.lang = t.lang AND u.w1 = t.w1 AND u.w2 = t.w2 JOIN one v ON v.lang = t.lang AND v.w = t.w3)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored QUALIFY rank <= 2000
)
SELECT k.lang, rank, phrase, a, l, r, t.n::BIGINT AS n, score::BIGINT AS score
FROM ranked k JOIN (SELECT lang, sum(f) AS n FROM one GROUP BY lang) t ON t.lang = k.lang
"""
