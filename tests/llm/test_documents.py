"""Near duplicates, passages, packing, classifier, token counts and mixing against brute force."""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

from protlake.llm import cotrain, minhash, mixing, packing, suffixes, wordpiece
from tests.llm.support import DOC_SCHEMA, near_classes, odd_documents, repeats, sentence, with_clashes

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


@pytest.fixture(scope="module")
def odd(spark):
    return with_clashes(spark.createDataFrame(odd_documents(), DOC_SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def none(spark):
    return with_clashes(spark.createDataFrame([], DOC_SCHEMA))


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_near_duplicates_of_odd_rows(odd, none):
    got = minhash.near_duplicates(odd).collect()
    want = near_classes(texts(odd))
    assert len(got) == len(odd_documents())
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.class_id == r.doc_id) for r in got if r.doc_id is not None)
    assert all(r.kept and r.class_id is None for r in got if r.doc_id is None)
    assert minhash.near_duplicates(none).count() == 0


@given
def test_near_duplicates_of_given_rows(real):
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(real).collect()} == near_classes(texts(real))


def test_deduplicated_keeps_columns_and_one_of_each(odd, none):
    got = minhash.deduplicated(odd)
    assert got.columns == odd.columns
    ids = Counter(r.doc_id for r in got.collect())
    classes = near_classes(texts(odd))
    assert ids == Counter({i: 1 for i in set(classes.values())}) + Counter({None: 3})
    assert minhash.deduplicated(none).count() == 0


def test_signature_agreement_estimates_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(3)
    shared = rng.integers(1, 2**62, 300).astype(np.uint64)
    counts = rng.integers(1, 9, 300)
    a, b = np.repeat(shared, counts), np.repeat(shared, np.maximum(1, counts // 2))
    values = minhash.bag_signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate((a, b)), 2, 2000)
    assert abs((values[0] == values[1]).mean() - len(b) / len(a)) < 0.04


def spans_of(df):
    return {r.doc_id: ([(s.start, s.end) for s in r.spans], set(r.first_docs)) for r in df.collect()}


def test_passages_of_odd_rows(odd, none):
    assert spans_of(suffixes.repeated_passages(odd)) == repeats(texts(odd))
    assert suffixes.repeated_passages(none).count() == 0


def test_passages_whose_first_holder_has_other_surroundings(spark):
    passage = sentence(99, 58)
    longer = sentence(98, 130)
    part = " ".join(longer.split()[:75])  # the copies' own words go on after the part that the earliest document holds
    whole = part + " " + sentence(97, 60)
    rows = [(1, sentence(1, 60) + " " + passage + " " + sentence(2, 60)), *[(i, passage) for i in (2, 3, 4)],
            (5, longer), *[(i, whole) for i in (6, 7, 8)], (8, sentence(90, 30) + " " + passage), (2, sentence(96, 200)), (9, whole + " " + passage + " end")]
    got = spans_of(suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    first = {}
    for doc_id, text in sorted(rows):
        ws = text.split()
        for i in range(len(ws) - 49):
            first.setdefault(tuple(ws[i:i + 50]), doc_id)
    links = {}
    for doc_id, text in rows:
        ws = text.split()
        for i in range(len(ws) - 49):
            if first[tuple(ws[i:i + 50])] < doc_id:
                links.setdefault(doc_id, set()).add(first[tuple(ws[i:i + 50])])
    assert {d: f for d, (_, f) in got.items()} == links
    assert links[3] == links[4] == {1} and links[7] == {5, 6}


@given
def test_passages_of_given_rows(real):
    got, want = spans_of(suffixes.repeated_passages(real)), repeats(texts(real))
    assert want and got == want


def test_cutting_leaves_clean_rows_alone(odd, none):
    got = suffixes.without_repeats(odd)
    assert got.columns == odd.columns
    want = repeats(texts(odd))
    after = Counter((r.doc_id, r.text) for r in got.collect())
    for doc_id, text in texts(odd):
        if doc_id not in want:
            assert after[doc_id, text] > 0
        else:
            ws = re.findall(r"[^\x20\x09-\x0D]+", text)
            left = [w for i, w in enumerate(ws) if not any(a <= i < b for a, b in want[doc_id][0])]
            assert [t.split() for d, t in after if d == doc_id] == ([left] if left else [])
    assert suffixes.without_repeats(none).count() == 0


def check_packing(rows, docs, capacities):
    top = max(capacities)
    sizes = Counter()
    for _, text in docs:
        sizes[len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))] += 1
    assert sum(r.words for r in rows) == sum(n * c for n, c in sizes.items())
    assert len(rows) == sum(max(1, -(-n // top)) * c for n, c in sizes.items())
    bins = defaultdict(list)
    for r in rows:
        assert (r.bin_id is None) == (r.words == 0)
        if r.words:
            bins[r.bin_id].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        load = 0
        for r in held:
            assert r.bin_offset == load
            load += r.words
        assert len({r.capacity for r in held}) == 1
        assert held[0].capacity == min(c for c in capacities if c >= load)


def test_packing_of_odd_rows(odd, none):
    capacities = (16, 64, 256)
    rows = packing.packed(odd, capacities, group=64, with_text=True).collect()
    check_packing(rows, texts(odd), capacities)
    whole = defaultdict(list)
    for r in sorted((r for r in rows if r.doc_id == 11), key=lambda r: r.piece):
        whole[r.doc_id] += (r.text or "").split()
    assert whole[11] == dict(texts(odd))[11].split()
    assert packing.packed(none, capacities).count() == 0


@given
def test_packing_of_given_rows(real):
    check_packing(packing.packed(real).collect(), texts(real), packing.CAPACITIES)


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, limits = packing.best_fit([6, 4, 3, 3], (10, 16))
    assert sorted(sum(n for n, b in zip([6, 4, 3, 3], bins, strict=True) if b == x) for x in set(bins)) in ([6, 10], [16])
    assert all(c in (10, 16) for c in limits) and offsets[0] == 0


@given
def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    scored = cotrain.quality_scores(docs, labels.filter("doc_id % 3 <> 0"))
    assert scored.count() == docs.count()
    held = [(r.keep, r.quality == 1 and r.toxic == 0) for r in scored.join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()]
    assert len(held) > 50
    accuracy = sum(a == b for a, b in held) / len(held)
    print("held-out accuracy", accuracy)
    assert accuracy >= 0.85


def test_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(14)] + [(None, 1, 0, "x"), (3, None, None, "x"), (900, 1, 1, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    got = cotrain.quality_scores(odd, labels).collect()
    assert len(got) == len(odd_documents()) and all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in got)
    kept = cotrain.accepted(odd, labels)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.keep)
    empty = labels.limit(0)
    assert {r.score for r in cotrain.quality_scores(odd, empty).collect()} == {1.0}
    assert cotrain.quality_scores(none, labels).count() == 0


def greedy(word, initial, inner):
    """Pieces by longest match, by trying every length; None if the word can't be spelt."""
    n, at, pieces = 0, 0, initial
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at:at + k] in pieces), 0)
        if not size:
            return None
        n, at, pieces = n + 1, at + size, inner
    return n


def test_word_pieces_by_brute_force():
    from itertools import product

    for initial, inner in (({"a", "ab", "abc"}, {"a", "b", "bca", "c", "cab"}), ({"a", "abcab"}, {"b", "bc", "abc", "c"}), ({"b", "ba"}, {"a", "aaa", "b", "bbb"})):
        automaton = wordpiece.LengthAutomaton(initial, inner)
        for size in range(1, 8):
            for word in map("".join, product("abc", repeat=size)):
                want = greedy(word, initial, inner)
                assert automaton.count(word) == (want if want else 1 + wordpiece.UNKNOWN), word


def test_token_counts_of_odd_rows(odd, none):
    initial, inner = ["w", "w1", "one", "x", "xx"], [*"0123456789", "12", "345", "x", "xxx"]
    got = Counter(map(tuple, wordpiece.token_counts(odd, initial, inner).collect()))
    want = Counter()
    for doc_id, text in texts(odd):
        found = [greedy(w, set(initial), set(inner)) for w in (text or "").split()]
        want[doc_id, len(found), sum(n or 1 for n in found), sum(n is None for n in found)] += 1
    assert got == want
    assert wordpiece.token_counts(none, initial, inner).count() == 0


def test_bare_piece_by_brute_force():
    from itertools import product

    for initial, inner in (({"", "ab", "abca"}, {"a", "b", "bca", "c"}), ({"", "abc"}, {"ab", "abcab", "b", "c"}), ({"", "a", "bbb"}, {"b", "bc", "ca"})):
        automaton = wordpiece.LengthAutomaton(initial, inner)
        marked = {"_" + p for p in initial}
        for size in range(1, 8):
            for word in map("".join, product("abc", repeat=size)):
                want = greedy("_" + word, marked, inner)
                assert automaton.count(word) == (want if want else 1 + wordpiece.UNKNOWN), word


@given
def test_token_counts_with_the_models_bare_piece(spark):
    from protlake.llm.queries import PIECE_MODEL

    initial, inner = wordpiece.pieces_of_model(PIECE_MODEL)
    assert "" in initial
    begins, continues = {"▁" + p for p in initial}, set(inner)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [*texts(docs), (-1, "ñta çouê. êèchouch"), (-2, "a\u4e00b \U0001F9FF")]
    got = Counter(map(tuple, wordpiece.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), initial, inner).collect()))
    longest, known = max(map(len, begins | continues)), {}

    def pieces(word):  # plain longest match over the word with its word-begin mark
        n, at, word, usable = 0, 0, "▁" + word, begins
        while at < len(word):
            size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at:at + k] in usable), 0)
            if not size:
                return None
            n, at, usable = n + 1, at + size, continues
        return n

    want = Counter()
    for doc_id, text in rows:
        found = (text or "").split()
        for w in set(found) - known.keys():
            known[w] = pieces(w)
        want[doc_id, len(found), sum(known[w] or 1 for w in found), sum(known[w] is None for w in found)] += 1
    assert got == want
    assert known["ñta"] > 1


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Reshares the excess over and over until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        part = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if part[s] > cap * sizes[s]]
        if not over:
            return fixed | part
        for s in over:
            fixed[s] = cap * sizes[s]
            left -= fixed[s]


def check_mix(docs):
    first, second = (sorted(map(str, mixing.mixed(docs).drop("payload").collect())) for _ in range(2))
    assert first == second
    rows = mixing.mixed(docs).collect()
    sizes, taken, by_row = Counter(), Counter(), Counter()
    for r in {tuple(r.row): r for r in rows}.values():
        sizes[r.payload.source] += r.size
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", r.payload.text or ""))
    for r in rows:
        taken[r.payload.source] += r.words
        by_row[tuple(r.row)] += r.words
        assert r.source_size == sizes[r.payload.source] and by_row[tuple(r.row)] <= 2 * r.size
    want = targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.payload.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert len(by_row) == docs.count()


def test_mix_of_odd_rows(odd, none):
    check_mix(odd)
    assert mixing.mixture(odd).columns == odd.columns
    assert mixing.mixed(none).count() == 0 and mixing.mixture(none).count() == 0


@given
def test_mix_of_given_rows(real):
    check_mix(real)


def test_splitting_tree_keeps_quotas(spark):
    quotas = [1000, 3, 0, 517]
    leaves = mixing.splitting_tree(spark.createDataFrame([(quotas,)], "quotas array<long>"), 3).collect()
    assert len(leaves) == 8
    assert [sum(r.quotas[i] for r in leaves) for i in range(4)] == quotas
    assert max(sum(r.quotas) for r in leaves) - min(sum(r.quotas) for r in leaves) <= 1
    assert all(q >= 0 for r in leaves for q in r.quotas)


def test_different_texts_under_one_id_are_not_lost(spark):
    passage = sentence(99, 60)
    clean, other = sentence(50, 100), sentence(51, 90)
    rows = [(1, passage + " " + sentence(1, 30), "a"), (2, passage + " " + sentence(2, 30), "a"), (2, clean, "a"), (3, other, "x"), (3, other, "b"), (3, clean, "a"), (4, other, "a"), (None, other, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __t string").repartition(3)
    after = Counter((r.doc_id, r.text.strip()) for r in suffixes.without_repeats(docs).collect())
    # of (2, clean) and (3, clean) one is the earlier, (4, other) is later than (3, other): 60 words of P go from document 2
    assert after[1, rows[0][1]] == 1 and after[2, sentence(2, 30)] == 1 and after[3, other] == 2 and after[None, other] == 1
    assert after[2, clean] + after[3, clean] == 1 and sum(after.values()) == 6
    for _ in range(2):
        got = Counter(tuple(r) for r in minhash.deduplicated(docs).collect())
        assert {t for _, t, _ in got} == {t for _, t, _ in rows} and sum(got.values()) == 5
        assert sum(n for (d, t, _), n in got.items() if t == other and d == 3) == 1 and got == Counter(tuple(r) for r in minhash.deduplicated(docs.repartition(5)).collect())


def test_equal_rows_do_not_meet_in_one_group(spark):
    rows = [(7, sentence(1, 5), "en", "a", 1)] * 8000 + [(i, sentence(i, 5 + i % 7), "en", "b", 1) for i in range(4000)] + [(None, " ", "en", None, 1)] * 3000
    docs = with_clashes(spark.createDataFrame(rows, DOC_SCHEMA).repartition(4))
    packs = packing.packed(docs, (64, 256), group=256, with_text=True)
    held = Counter(r.bin_id >> 32 for r in packs.filter("bin_id is not null").select("bin_id").collect())
    assert max(held.values()) <= 2 * 256 and sum(held.values()) == 12_000
    check_packing(packs.collect(), texts(docs), (64, 256))
    mixed = mixing.mixed(docs)
    rows_out = mixed.select("row", "words", "size", "source_size", "target").distinct().collect()
    held = Counter(tuple(r.row)[:2] for r in mixed.select("row").distinct().collect())
    assert max(held.values()) <= 2 * 4 * 122 and sum(held.values()) == docs.count() and rows_out
    check_mix(docs)


def test_mixture_lies_by_shard_and_place(spark):
    docs = spark.createDataFrame([(i, sentence(i, 20 + i % 30), "en", "ab"[i % 2], 1) for i in range(3000)], DOC_SCHEMA)
    took = mixing.mixed(docs, shards=4).withColumn("source_no", F.col("row.source_no")).filter("shard is not null and words > 0")
    places = {(r.doc_id, n): (r.shard, r.place) for r, n in ((r, r["pass"]) for r in took.select("payload.doc_id", "pass", "shard", "place").collect())}
    of = defaultdict(list)
    for (doc_id, _), place in places.items():
        of[doc_id].append(place)
    for part in mixing.mixture(docs, shards=4).rdd.glom().map(lambda rows: [r.doc_id for r in rows]).collect():
        at = (-1, 0)
        for doc_id in part:  # in ascending (shard, place): each row can take one of its document's places behind the last
            at = min(p for p in of[doc_id] if p > at)
    # the tree's quotas: words of a source in a shard are those of its blocks
    quota = took.groupBy("source_no", "shard").agg(F.sum("words").alias("w")).collect()
    whole = took.groupBy("source_no").agg(F.sum("words").alias("w")).collect()
    for r in whole:
        each = [q.w for q in quota if q.source_no == r.source_no]
        assert len(each) == 4 and max(each) - min(each) < 0.25 * r.w
