"""Operators for training data against brute force, and their defined results for odd inputs."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import (
    chat,
    decontaminate,
    language,
    minhash,
    multi_index,
    passages,
    pieces,
    queries,
    sharding,
    suffixes,
    token_files,
)
from millrace.llm import text as tx
from millrace.llm.graph import components
from millrace.session import scratch
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def found(df, *columns):
    return sorted(
        (tuple(r) for r in (df.select(*columns) if columns else df).collect()),
        key=lambda r: tuple((x is None, str(x)) for x in r),
    )


def words(rng, n, vocabulary=4000):
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


# 1. Token files


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    rows = [(5, None), (1, ""), (None, "ab  c\n d\xa0 e "), (5, "x\0y z"), (9, " lead  \t tail \n"), (9, "it's 'll 12 <|endoftext|> é"), (9, "w " * 3000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("shard", F.lit(1)).withColumn("ids", F.lit(2))
    out = scratch(spark, "tokens")
    token_files.write_tokens(docs, out, path, 2)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    at, expected = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((d, at, len(ids), np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    got = [(r[0], r[1], r[2], bytes(r[3])) for r in token_files.read_tokens(spark, out).orderBy("start").collect()]
    assert got == expected
    assert {r.doc_id for r in token_files.read_tokens(spark, out, [9]).collect()} == {9}


def test_token_files_of_nothing(spark):
    out = scratch(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame([], DOCS), out, queries.tokenizer_file("byte_bpe_50k.json"), 2)
    assert token_files.read_tokens(spark, out).count() == 0


def test_token_file_query(spark, documents):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file("byte_bpe_50k.json"))
    at, expected = 0, []
    for d, t in sorted(documents):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    got = queries.op1_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == sorted(expected)


# 2. Sharding


def test_lookup_table_is_fair_and_stable():
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 701)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 701)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.2 * 701
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 700)


def test_placement_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "doc_id long, text string")
    got = sharding.place(df, ["doc_id"]).collect()
    assert len(got) == 4
    assert len({r.shard for r in got if r.doc_id == 1}) == len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.place(df.filter("false"), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        sharding.place(df.withColumn("shard", F.lit(1)), ["doc_id"])


# 3. Near duplicates


def test_near_duplicates_match_brute_force(spark, documents):
    got = minhash.near_duplicates(spark.createDataFrame(documents, DOCS), minhash.NearDup(width=4))
    assert {r[0]: tuple(r) for r in got.collect()} == brute.near_duplicates(documents, 4)


def test_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_BLOCK", 8)
    monkeypatch.setattr(minhash, "GROUP_BLOCK", 4)
    rng = np.random.default_rng(3)
    base, rows = words(rng, 80), []
    for d in range(120):
        own = list(base)
        for at in rng.integers(0, 80, int(rng.integers(0, 4))):
            own[at] = f"x{rng.integers(1 << 30)}"
        rows.append((d, " ".join(own)))
    rows += [(200 + k, " ".join(words(rng, 60))) for k in range(40)] + [(300, rows[0][1].upper())]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(5), minhash.NearDup(width=4))
    assert {r[0]: tuple(r) for r in got.collect()} == brute.near_duplicates(rows, 4)


def test_near_duplicates_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e"), (4, "a b c d e"), (5, "A b c  d e"), (6, "one"), (7, "one"), (7, "one")]
    df = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("x"))
    got = found(minhash.near_duplicates(df))
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 1, None, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (7, 1, 6, False)],
        key=lambda r: tuple((x is None, str(x)) for x in r),
    )
    assert minhash.near_duplicates(df.filter("false")).count() == 0


def test_components_of_long_chain_and_hub(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(50)] + [(5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == brute.least_reachable(set(got), edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4. Near vectors


def vector_links(rows):
    clean = {i: np.array(v, float) for i, v, lab in rows if lab is not None and v and None not in v}
    clean = {i: v / np.linalg.norm(v) for i, v in clean.items() if np.isfinite(v).all() and v.any()}
    label = {i: lab for i, _, lab in rows}
    ids = list(clean)
    return [(a, b) for k, a in enumerate(ids) for b in ids[:k] if label[a] == label[b] and clean[a] @ clean[b] >= 0.98]


def test_near_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "LIST_BLOCK", 16)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 16)
    monkeypatch.setattr(multi_index, "CELL_ROWS", 4)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 8))
    rows = []
    for k in range(400):
        v = centres[k % 30 if k % 3 else 0] + rng.normal(size=8) * 0.12
        rows.append((k, v.astype(float).tolist(), int(k % 2)))
    rows += [(500 + k, rows[0][1], 0) for k in range(20)] + [(600, (3 * np.array(rows[0][1])).tolist(), 0)]
    rows += [(700, None, 1), (701, [0.0] * 8, 1), (702, [1.0, None] * 4, 1), (703, rows[1][1], None), (704, [float("nan")] * 8, 1), (705, [], 1)]
    links = vector_links(rows)
    assert len(links) > 500
    least = brute.least_reachable([r[0] for r in rows], links)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = multi_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r[0]: tuple(r) for r in got.collect()} == {i: (i, count[i], least[i], least[i] == i) for i in count}


def test_near_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert multi_index.near_vectors(empty).count() == 0
    nulls = spark.createDataFrame([(None, [1.0], 1), (None, None, None)], empty.schema)
    assert found(multi_index.near_vectors(nulls)) == [(None, 0, None, True)] * 2


# 5. Chat


def test_chat_round_trip_and_machine(spark):
    ok = "\\### Assistant: </turn> ok"
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "user", ok), (1, 2, "assistant", ok),
        (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, None, "é\n"), (3, 1, "od: d ### ", "\\b\\c"),
        (None, 0, "user", "x"), (4, 0, "user", ""), (4, 0, "user", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(0))
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for conv, r in got.items():
        own = sorted(((t, role or "", x or "") for c, t, role, x in rows if c == conv))
        assert [tuple(x) for x in r.turns] == [x[1:] for x in own]
        assert r.loss_texts == [x for _, role, x in own if role == "assistant"]
        assert sum(s.length for s in r.spans) == len(r.formatted)
    assert (got[1].valid, got[1].bad_turn) == (True, None)
    assert [got[k].bad_turn for k in (2, 3, 4)] == [1, 2, 2]
    assert not got[None].valid and got[None].bad_turn is None
    assert chat.format_chats(df.filter("false")).count() == 0


# 6. Passages


def test_compact_windows_match_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n, t = int(rng.integers(1, 50)), int(rng.integers(1, 12))
        v = rng.integers(0, 30, n).astype(np.uint64)
        expected = {(i + int(np.argmin(v[i : j + 1])), i, j) for i in range(n) for j in range(i + t - 1, n)}
        got = {
            (c, i, j)
            for _, low, c, high in passages.compact_windows(v[None], t)[0]
            for i in range(low, c + 1)
            for j in range(max(c, i + t - 1), high + 1)
        }
        assert got == expected


def test_passages_find_planted_copies_and_leave_others(spark):
    rng = np.random.default_rng(9)
    rows, planted = [(k, " ".join(words(rng, 150))) for k in range(40)], set()
    for k in range(12):
        source = rows[k][1].split()
        part = source[20:90]
        if k % 2:
            part[30] = "changed"
        rows.append((100 + k, " ".join([*words(rng, 40), *part, *words(rng, 30)])))
        planted.add((100 + k, k))
    rows += [(200, None), (201, ""), (202, "short text"), (None, rows[0][1]), (5, rows[5][1])]
    got = passages.near_passages(spark.createDataFrame(rows, DOCS).repartition(4))
    assert {(r.doc_id, r.source_id) for r in got.collect()} == planted
    assert all(r.similarity >= 0.8 and r.end_word - r.start_word >= 50 for r in got.collect())
    assert passages.near_passages(spark.createDataFrame([], DOCS)).count() == 0


def brute_passages(a, b, n, percent):
    """All (from, to) of a, to exclusive, of at least n shingles, similar to n or more in a row of b; distinct shingles."""
    match = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int64)
    match[1:, 1:] = (a[:, None] == b).cumsum(axis=0).cumsum(axis=1)
    i, j = (x.ravel() for x in np.meshgrid(range(len(a) + 1), range(len(a) + 1), indexing="ij"))
    i, j = i[j - i >= n], j[j - i >= n]
    x, y = (z.ravel() for z in np.meshgrid(range(len(b) + 1), range(len(b) + 1), indexing="ij"))
    x, y = x[y - x >= n], y[y - x >= n]
    shared = match[j][:, y] - match[i][:, y] - match[j][:, x] + match[i][:, x]
    near = (100 * shared >= percent * ((j - i)[:, None] + (y - x) - shared)).any(axis=1)
    return set(zip(i[near].tolist(), j[near].tolist(), strict=True))


def test_passages_with_one_edit_match_brute_force():
    from dataclasses import replace

    # Every function's windows count, so that this is a test of the verification alone.
    rule = replace(passages.Rule(), functions=12, enough=1)
    rng, lost, tried = np.random.default_rng(3), [], 0
    for size in range(50, 76):
        for k in range(size):
            source = rng.integers(1, 1 << 62, size).astype(np.uint64)
            copy = source.copy()
            copy[k] += np.uint64(1)
            if k % 3 == 1:
                copy = np.delete(source, k)
            elif k % 3 == 2:
                copy = np.insert(source, k, np.uint64(5))
            a, b = (tx.shingle_hashes(x, rule.width) for x in (copy, source))
            wanted = brute_passages(a, b, rule.shingles, rule.percent)
            got = passages.matching_passages(a, b, rule)
            for s, e, x, y, j in got:
                shared = len(set(a[s : e + 1].tolist()) & set(b[x : y + 1].tolist()))
                assert e - s + 1 >= rule.shingles and j == shared / (e - s + y - x + 2 - shared) >= 0.8
            tried += bool(wanted)
            if bool(wanted) != bool(got):
                lost.append((size, k))
            # Where the whole text is similar and begins and ends alike, it is the passage.
            if (0, len(a)) in wanted and a[0] == b[0] and a[-1] == b[-1]:
                assert [x[:2] for x in got] == [(0, len(a) - 1)] or (size, k) in lost
    assert (lost, tried > 1000) == ([], True)
    assert passages.aligned_passages(a, a + np.uint64(1), (0, len(a) - 1, 0, len(a) - 1), rule) == []


def test_passages_meet_every_holder(spark):
    rng, rows = np.random.default_rng(17), []
    for base in range(0, 200, 10):
        one = words(rng, 50, 1 << 40)
        two = one.copy()
        two[20] = two[25] = "changed"
        for k in range(1, 8):
            text = [*words(rng, 20, 1 << 40), *(two if k in (2, 7) else one), *words(rng, 20, 1 << 40)]
            rows.append((base + k, " ".join(text)))
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    wanted = {(base + 7, base + 2) for base in range(0, 200, 10)}
    got = found(passages.near_passages(docs))
    assert wanted <= {(r[0], r[3]) for r in got}
    # Only copies of one text are similar (36 of 56 shingles otherwise).
    assert all((r[0] % 10 in (2, 7)) == (r[3] % 10 in (2, 7)) and r[0] // 10 == r[3] // 10 for r in got)


def test_pairs_of_blocks_are_all_pairs(monkeypatch):
    rng = np.random.default_rng(2)
    key = (rng.integers(0, 4, 400) * 2 + rng.integers(0, 2, 400)).astype("<u8")
    doc = rng.integers(0, 60, 400).astype("<i8")
    batch = pa.RecordBatch.from_pydict({"bucket": [1], "keys": [key.tobytes()], "docs": [doc.tobytes()]})
    expected = {}
    for k, d in zip(key.tolist(), doc.tolist(), strict=True):
        for other, e in zip(key.tolist(), doc.tolist(), strict=True):
            if k % 2 == 0 and k // 2 == other // 2 and e < d:
                expected[d, e] = expected.get((d, e), 0) | 1 << k // 2
    for pairs, block in ((1 << 17, 1024), (50, 7), (1 << 17, 3)):
        monkeypatch.setattr(passages, "SLAB_PAIRS", pairs)
        monkeypatch.setattr(passages, "BLOCK_DOCS", block)
        got = {}
        for part in passages._expand(passages._meet_all(iter([batch]))):
            for d, e, bits in zip(*(c.to_pylist() for c in part.columns), strict=True):
                got[d, e] = got.get((d, e), 0) | bits
        assert got == expected


def test_passages_just_above_the_limit_are_found(spark):
    from math import comb

    rule, near = passages.Rule(), passages.Rule().percent / 100
    n = rule.functions
    assert sum(comb(n, k) * near**k * (1 - near) ** (n - k) for k in range(rule.enough)) < 1e-4
    rng, rows = np.random.default_rng(23), []
    for k in range(600):
        one = words(rng, 50, 1 << 40)
        two = [*one[:20], "changed", *one[21:]]
        rows += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    got = found(passages.near_passages(spark.createDataFrame(rows, DOCS).repartition(3)), "doc_id", "source_id", "similarity")
    assert sorted(got) == [(2 * k + 1, 2 * k, 41 / 51) for k in range(600)]


# 7. Pieces


def test_pieces_equal_the_library(spark, documents):
    import sentencepiece

    path = queries.tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [*documents[:80], (-1, None), (-2, ""), (-3, "   a\t\n  b "), (-4, "日本語 🙂 é <s>"), (-4, "a" * 300)]
    df = spark.createDataFrame(rows, DOCS).withColumn("decoded_", F.lit(1))
    got = pieces.decode_pieces(pieces.encode_pieces(df, path), path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.piece_ids == library.encode(r.text or "")
        assert r.decoded == (r.text or "")
    assert pieces.encode_pieces(df.filter("false"), path).count() == 0
    with pytest.raises(ValueError):
        pieces.encode_pieces(df.withColumn("piece_ids", F.lit(1)), path)


def test_best_score_mode_matches_brute_force():
    model = pieces.PieceModel(queries.tokenizer_file("piece_bpe_32k.model"), "unigram")
    for unit in ["▁other", "▁there", "▁unbelievable", "▁été", "▁x☃y"]:
        best = {0: 0.0}
        for e in range(1, len(unit) + 1):
            options = [best[e - 1] + model.unknown_score] if unit[e - 1] not in model.singles else []
            for s in range(e):
                k = model.normal.get(unit[s:e])
                if k is not None:
                    options.append(best[s] + model.scores[k])
            best[e] = max(options)
        got = sum(model.scores[k] if k in set(model.normal.values()) else 0 for k in model.encode_unit(unit))
        unknown = sum(c not in model.singles for c in unit)
        assert got + unknown * model.unknown_score == pytest.approx(best[len(unit)])


# 8. Decontamination


def rows_of(marked):
    return {r.doc_id: (r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in marked.collect()}


@pytest.mark.parametrize("slice_words", [1_000_000, 60])
def test_decontamination_matches_brute_force(spark, documents, slice_words):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs = documents[:60]
    items = items[:12] + [(900, "the"), (901, None), (902, "..."), (903, docs[0][1][:400]), (903, docs[1][1][:300])]
    got = decontaminate.mark_contaminated(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), slice_words=slice_words
    )
    assert rows_of(got) == brute.contaminated(docs, items)


def test_decontamination_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a b c")], DOCS).withColumn("item", F.lit(1))
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontaminate.mark_contaminated(docs, nothing).collect()} == {False}
    item = spark.createDataFrame([(None, "A  b")], "item_id long, text string")
    got = decontaminate.mark_contaminated(docs, item).collect()
    assert sorted((r.n_words, r.n_hit) for r in got) == [(0, 0), (0, 0), (2, 2), (2, 2), (3, 2)]
    assert decontaminate.mark_contaminated(docs.filter("false"), item).count() == 0
    with pytest.raises(ValueError):
        decontaminate.mark_contaminated(docs.withColumn("n_hit", F.lit(1)), item)


# 9. Repeated byte strings


def test_suffix_order_sorts_and_finds_equals():
    rng = np.random.default_rng(0)
    for letters in (1, 2, 3):
        data = rng.integers(97, 97 + letters, 1500).astype(np.uint8)
        start, length = rng.integers(0, 1440, 300), rng.integers(8, 60, 300)
        order, equal = suffixes.suffix_order(data, tx.prefix_hashes(data, tx.byte_codes(False)), start, length)
        strings = [bytes(data[start[k] : start[k] + length[k]]) for k in order]
        assert strings == sorted(strings)
        assert equal.tolist() == [k > 0 and strings[k] == strings[k - 1] for k in range(300)]


def kept(df):
    out = df.select("doc_id", "n_bytes", "n_removed", F.size("removed_spans"), F.sha2("kept_bytes", 256))
    return {r[0]: tuple(r) for r in out.collect()}


def test_repeats_match_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(suffixes, "PART_BYTES", 20_000)
    rng = np.random.default_rng(2)
    common = "This line stands in every single one of these texts, byte for byte. "
    rows = documents[:100] + [(1000 + k, " ".join(words(rng, 20)) + common * (k % 3) + "ab" * 60) for k in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "short"), (2003, "é" * 30), (2004, "x" + "é" * 30)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3))
    assert kept(got) == brute.repeats(rows)


def test_repeats_of_odd_rows(spark):
    line = "0123456789" * 6
    rows = [(None, line), (1, line), (1, line), (2, line)]
    df = spark.createDataFrame(rows, DOCS).withColumn("part", F.lit("p")).withColumn("bytes", F.lit(None).cast("string"))
    got = suffixes.remove_repeats(df).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.part) for r in got) == [("1", 0, "p"), ("1", 0, "p"), ("2", 60, "p"), ("None", 0, "p")]
    assert suffixes.remove_repeats(df.filter("false")).count() == 0


# 10. Language


def test_viterbi_matches_brute_force():
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(30):
        counts = rng.integers(0, 6, 5)
        first = np.concatenate([[0], np.cumsum(counts)])
        scores = rng.normal(size=(first[-1], 3)) * 2
        label = language.viterbi(scores, first, 1.0)
        cost = lambda path, own: sum(own[k][p] for k, p in enumerate(path)) - sum(a != b for a, b in zip(path, path[1:], strict=False))
        for a, b in zip(first, first[1:], strict=False):
            own = scores[a:b]
            best = max(cost(p, own) for p in itertools.product(range(3), repeat=b - a))
            assert cost(label[a:b], own) == pytest.approx(best)


def test_language_held_out_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op10_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right > 0.98
    model = language.train(docs)
    french, english = docs.filter("lang = 'fr'").first().text, docs.filter("lang = 'en'").first().text
    rows = [(1, None), (2, ""), (3, "12 — “”"), (4, english[:300] + " " + french[:300]), (5, "Привет"), (5, "Привет")]
    out = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, DOCS), model).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and out[1].score == 0
    assert [s.lang for s in out[4].lang_spans] == ["en", "fr"]
    assert out[5].lang_pred in model.languages
    assert language.identify(docs.filter("false"), model).count() == 0
    with pytest.raises(ValueError):
        language.train(docs.filter("false"))


# Pipeline


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.first().text
    item = " ".join(f"bench{k}" for k in range(20))
    odd = spark.createDataFrame(
        [(-1, None, None, None, None), (-2, "12 34", "en", "s", 5), (9001, text, "en", "s", 1), (9002, item, "en", "s", 1)], docs.schema
    )
    docs.unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    first = docs.first().doc_id
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        if name == "language_id":
            assert not ids & {-1, -2} and 9001 in ids
        if name == "near_dedup":
            assert 9001 not in ids and first in ids and 9002 in ids
        if name == "decontamination":
            assert 9002 not in ids and first in ids
        if name != "piece_ids":
            assert now.columns == docs.columns
            path = str(tmp_path / name)
            now.write.parquet(path)
            now = spark.read.parquet(path)
    assert now.filter("not exact").count() == 0
