"""Mixing, fill-in-the-middle and collocations against plain versions, and their odd inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import collocations, infill, mixing
from millrace.llm import quotient as qf

SPACE = " \t\n\x0b\x0c\r"
ROWS = "doc_id long, text string, lang string, source string"


def shown(df, *columns):
    got = (df.select(*columns) if columns else df).collect()
    return sorted((tuple(r) for r in got), key=lambda r: tuple((x is None, str(x)) for x in r))


# 11. Mixing


def targets_by_rounds(sizes, weights, share, most):
    """Resharing in rounds: {source: Fraction}; sizes in the sources' order."""
    weigh = {s: weights[k % len(weights)] for k, s in enumerate(sizes)}
    left, free, out = share * sum(sizes.values()), dict(sizes), {}
    while free:
        total = sum(weigh[s] for s in free)
        above = [s for s in free if left * weigh[s] / total >= most * free[s]]
        if not above:
            return out | {s: left * weigh[s] / total for s in free}
        for s in above:
            out[s] = Fraction(most * free.pop(s))
        left = share * sum(sizes.values()) - sum(v for s, v in out.items())
    return out


def mixed_rows(rng):
    rows = []
    for k, (source, n) in enumerate([("b", 40), (None, 30), ("a", 5), ("é", 60), ("", 3), ("B", 300)]):
        rows += [(1000 * k + i, " ".join("w" * int(rng.integers(1, 60))), "en", source) for i in range(n)]
    return rows + [(9, None, "en", "a"), (9, None, "en", "a"), (None, "x y", "en", "b"), (7, "   ", "en", "empty"), (8, None, "en", "empty")]


def test_mix_reaches_its_targets(spark):
    rows = mixed_rows(np.random.default_rng(3))
    docs = spark.createDataFrame(rows, ROWS).repartition(5).withColumn("Position", F.lit(1))
    mixed = mixing.mix_sources(docs).cache()
    assert mixed.columns == [*docs.columns, "size", "source_size", "target", "copies", "taken"]
    size = lambda t: len(re.findall(f"[^{SPACE}]+", t or ""))
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += size(text)
    ordered = {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))}
    wanted = targets_by_rounds(ordered, (3, 1, 2), Fraction(3, 2), 2)
    taken, largest = Counter(), Counter()
    for r in mixed.collect():
        assert r["size"] == size(r.text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(wanted[r.source]), rel=1e-12)
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    assert sum(wanted.values()) == Fraction(3, 2) * sum(sizes.values())
    for source, target in wanted.items():
        assert abs(taken[source] - target) <= largest[source]
    assert mixed.count() == len(rows)
    again = mixing.mix_sources(docs.repartition(2))
    assert shown(again, "doc_id", "source", "text", "taken") == shown(mixed, "doc_id", "source", "text", "taken")
    copies = mixing.emit_copies(mixed)
    assert copies.count() == mixed.agg(F.sum("copies")).first()[0]
    assert copies.agg(F.sum("size")).first()[0] == sum(taken.values())


def test_mix_of_nothing_and_of_clashes(spark):
    none = spark.createDataFrame([], ROWS)
    assert mixing.mix_sources(none).count() == 0
    wordless = spark.createDataFrame([(1, None, "en", "a"), (2, "", "en", None)], ROWS)
    assert shown(mixing.mix_sources(wordless), "size", "source_size", "target", "taken") == [(0, 0, 0.0, 0)] * 2
    with pytest.raises(ValueError):
        mixing.mix_sources(none.withColumn("Taken", F.lit(1)))


def test_mix_with_other_settings(spark):
    rows = [(k, "w " * (k % 7 + 1), "en", f"s{k % 9}") for k in range(400)]
    rule = mixing.Mix(weights=(5, 1), share=Fraction(1, 2), most=1, seed=7)
    mixed = mixing.mix_sources(spark.createDataFrame(rows, ROWS), rule, keep=["source"])
    sizes = Counter()
    for k, t, _, s in rows:
        sizes[s] += len(t.split())
    wanted = targets_by_rounds({s: sizes[s] for s in sorted(sizes)}, (5, 1), Fraction(1, 2), 1)
    got = {r.source: (r.t, r.n) for r in mixed.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()}
    for source, target in wanted.items():
        assert got[source][0] == pytest.approx(float(target))
        assert abs(got[source][1] - target) <= 7


# 12. Fill in the middle

UNITS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def plain_cut(doc_id, text, rule=infill.Infill()):
    text = text or ""
    digest = hashlib.sha256(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNITS.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in (rule.prefix, rule.suffix, rule.middle)) or h[2] % 100 >= rule.rate:
        return n, "plain", text, None, None
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < rule.spm:
        return n, "spm", f"{rule.suffix}{s}{rule.prefix}{p}{rule.middle}{m}", len(p), len(m)
    return n, "psm", f"{rule.prefix}{p}{rule.suffix}{s}{rule.middle}{m}", len(p), len(m)


def odd_texts():
    rng = np.random.default_rng(5)
    alphabet = ["a", "bc", " ", "\n", "\t\t", "<", "<P", "S>", "😀é", "$1", "\\", " ", "\x1c", "M>", "\r\n"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(400)]
    return [None, "", "   ", "x", "a <P> b", "a <S>", "<M>", " lead", "tail \n ", *texts]


@pytest.mark.parametrize("rule", [infill.Infill(), infill.Infill(seed=1, rate=100, spm=50, prefix="«pre»", suffix="«suf»", middle="«mid»")])
def test_cuts_equal_the_plain_ones(spark, rule):
    texts = odd_texts()
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(None, "no id at all", "en", "s"), (3, "x", "en", "s")]
    docs = spark.createDataFrame(rows, ROWS).withColumn("__P", F.lit(1))
    out = infill.fill_in_middle(docs, rule).withColumn("back", infill.restored(rule)).collect()
    assert len(out) == len(rows)
    forms = Counter()
    for r in out:
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == plain_cut(r.doc_id, r.text, rule)
        assert r.back == (r.text or "")
        forms[r.form] += 1
    assert all(forms[f] > 5 for f in ("plain", "psm", "spm"))


def test_cut_of_a_very_long_text(spark):
    texts = ["word  " * 400_000, "x" * 3_000_000, " " * 1_000_000 + "end" + " " * 1_000_000]
    rows = [(k, t, "en", "s") for t in texts for k in range(4)]
    docs = spark.createDataFrame(rows, ROWS)
    rule = infill.Infill(rate=100)
    for r in infill.fill_in_middle(docs, rule).withColumn("back", infill.restored(rule)).collect():
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == plain_cut(r.doc_id, r.text, rule)
        assert r.back == r.text


def test_cuts_of_nothing_and_refusals(spark):
    none = spark.createDataFrame([], ROWS)
    assert infill.fill_in_middle(none).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(none.withColumn("Output", F.lit(1)))
    with pytest.raises(ValueError):
        infill.fill_in_middle(none, infill.Infill(middle="<<M>"))


# 13. Collocations


@pytest.mark.parametrize("words", [2, 3])
@pytest.mark.parametrize("width", [8, 17, 21, 22, 32])
def test_quotient_filters_lose_nothing(words, width):
    rng = np.random.default_rng(width)
    keys = qf.Keys(words, width)
    ids = [(rng.integers(0, 40, 4000) + 2**width - 40).astype(np.uint64) for _ in range(words)]
    high, low = keys.pack(ids)
    assert all((a == b).all() for a, b in zip(ids, keys.unpack(high, low), strict=True))
    whole = Counter(zip(*[x.tolist() for x in ids], strict=True))
    for bits in (0, 3):
        merged = qf.Merger(keys)
        for at in range(0, 4000, 900):
            shard = keys.summed(high[at : at + 900], low[at : at + 900])
            for bucket, part in keys.split(shard, bits):
                merged.add(keys.decode(keys.encode(part, bits), bucket, bits))
        got = merged.take()
        assert dict(zip(zip(*[x.tolist() for x in keys.unpack(*got[:2])], strict=True), got[2].tolist(), strict=True)) == whole


def test_large_counts_are_kept():
    keys = qf.Keys(2, 8)
    run = tuple(np.array(x, dtype=np.uint64) for x in ([1, 1, 9], [2, 3, 0], [254, 255, 10**15]))
    back = keys.decode(keys.encode(run, 2), 0, 2)
    assert all((a == b).all() for a, b in zip(run, back, strict=True))


def plain_phrases(rows, rule):
    counts, words_of = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            words_of[lang] += len(words)
            for n in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        found = [p for p in f if len(p) > 1 and f[p] >= rule.least]
        inside = defaultdict(int)
        for p in found:
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    inside[q] = max(inside[q], f[p])
        scored = []
        for p in found:
            if 100 * inside[p] >= rule.share * f[p] and inside[p]:
                continue
            cuts = [(1_000_000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[: rule.top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, words_of[lang], -score))
    return sorted(out)


def phrase_rows(rng, n):
    vocabulary = ["A", "b", "São", "new", "York", "times", "x:y", "😀", "The", "the", "of"]
    marks = [" ", " ", " ", "  ", "\t", ". ", "\n", "\x0b", " ", ";"]
    rows = []
    for k in range(n):
        size = int(rng.integers(0, 30))
        text = "".join(str(w) + str(m) for w, m in zip(rng.choice(vocabulary, size), rng.choice(marks, size), strict=True))
        rows.append((text + " New York Times" * int(rng.integers(0, 2)), ["en", "de", None, "und"][k % 4]))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_phrases_equal_brute_force(spark, monkeypatch, small):
    if small:  # many chunks, segments, buckets and levels
        for name, value in {"CHUNK_BYTES": 300, "SEGMENT": 40, "BUCKET_WORDS": 8, "STEP_BITS": 3}.items():
            monkeypatch.setattr(collocations, name, value)
    rows = phrase_rows(np.random.default_rng(11), 400) + [(None, "en"), ("", None), ("one two", "fr")]
    rows += rows[:50]
    rule = collocations.Phrases(least=5, top=40)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(6).withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in collocations.collocations(docs, rule).collect())
    assert got == plain_phrases(rows, rule)
    assert {r[0] for r in got} == {"en", "de", "und"}


def test_phrases_of_nothing_and_of_one_long_text(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(none).count() == 0
    rare = spark.createDataFrame([("only once here", "en")], "text string, lang string")
    assert collocations.collocations(rare).count() == 0
    long = [("to be or not to be, " * 60_000, None), ("be not", "en")]
    rule = collocations.Phrases()
    got = sorted(tuple(r) for r in collocations.collocations(spark.createDataFrame(long, "text string, lang string"), rule).collect())
    assert got == plain_phrases(long, rule)
