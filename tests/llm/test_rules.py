"""Conversation repair, n-gram ratio rules and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from protlake.llm import ngram_ratio, repair, spelling, textkit as tk
from protlake.llm.queries import ORACLES
from tests.llm.support import DOC_SCHEMA, odd_documents, sentence, with_clashes

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
CONV = "conv_id long, turn long, role string, text string"


# --- conversation repair ---

def cheapest(steps, state=repair.START, goals=repair.ENDS):
    """All edits with at most two insertions in a row."""
    best = None

    def go(p, state, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if p == len(steps) and state in goals and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserted < 2:
            go(p, repair.NEEDED[state], cost + 2, audit + "I", inserted + 1)
        if p < len(steps):
            gone, role, cut = steps[p]
            go(p + 1, state, cost + 3 * (gone or 1), audit + "D", 0)
            if not gone:
                go(p + 1, repair.NEEDED[state], cost + 2 + cut, audit + "R", 0)
                if (kept := repair.FOLLOWS.get(role, {}).get(state)) is not None:
                    go(p + 1, kept, cost + cut, audit + "K", 0)

    go(0, state, 0, "", 0)
    return best


def test_search_finds_the_cheapest_edits():
    rnd = random.Random(3)
    for _ in range(800):
        steps = [(rnd.randint(1, 3), "", 0) if rnd.random() < 0.2 else (0, rnd.choice("ssuuaax"), int(rnd.random() < 0.3)) for _ in range(rnd.randint(0, 6))]
        entry, leave = rnd.randrange(4), rnd.choice([repair.ENDS, (0,), (1,), (2,), (3,)])
        assert repair.search(steps, entry, leave) == cheapest(steps, entry, leave)


def odd_conversations():
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."), (None, 2, "assistant", " \t"), (-7, None, "user", "hi"), (-7, None, "system", "x."),
            (-7, 5, "Zed", "é!"), (-7, 5, "assistant", "done?\n"), (-7, 9, "", "q."), (10**9, -3, "user", None), (10**9, 4, "assistant", ""), (5, 1, "user", "long " * 50_000 + ".")]
    return rows + [(77, i, ("user", "assistant", "x", "system")[i * i % 4], f"t{i % 50}" + ("." if i % 3 else "")) for i in range(300)] + [(78, 3, "user", "same.")] * 400


def by_brute_force(rows, every=20):
    text = lambda v: " " if v is None else str(v)
    kept = defaultdict(list)
    for conv, turn, role, words in rows:
        h = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % every
        kept[conv]
        if h:
            words = "" if h == 1 else re.sub("[.!?]", "", text(words)) if h == 2 else text(words)
            kept[conv] += [(turn, "user" if h == 4 else text(role), words)] * (2 if h == 3 else 1)
    out = {}
    for conv, found in kept.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds = set(), []
        for _, role, words in found:
            body = re.findall("[^\x20\x09-\x0D]", words)
            kinds.append("blank" if not body else "duplicate" if (role, words) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, words))
        turns = [t for t, _, _ in found if t is not None]
        # least (cost, audit, text) for each state, row by row
        best = {0: (0, "", [])}

        def insert(best):
            for _ in range(3):
                for s in list(best):
                    c, a, o = best[s]
                    t = repair.NEEDED[s]
                    way = (c + 2, a + "I", [*o, f"{repair.ROLE[t]}:"])
                    if t not in best or way[:2] < best[t][:2]:
                        best[t] = way
            return best

        for (_, role, words), kind in zip(found, kinds, strict=True):
            after = {}

            def offer(s, way):
                if s not in after or way[:2] < after[s][:2]:
                    after[s] = way

            for s, (c, a, o) in insert(best).items():
                offer(s, (c + 3, a + "D", o))
                if kind not in ("blank", "duplicate"):
                    t = repair.NEEDED[s]
                    offer(t, (c + 2 + (kind == "truncated"), a + "R", [*o, f"{repair.ROLE[t]}:{words}"]))
                    t = repair.FOLLOWS.get(role[:1], {}).get(s)
                    if t is not None:
                        offer(t, (c + (kind == "truncated"), a + "K", [*o, f"{role}:{words}"]))
            best = after
        best = insert(best)
        cost, audit, rows_out = min((best[s] for s in repair.ENDS if s in best), key=lambda w: w[:2])
        count = Counter(kinds)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(rows_out).encode()).hexdigest())
    return out


@pytest.mark.parametrize("segment, letters, parts", [(512, 1 << 20, "4"), (3, 1 << 20, "9"), (1, 10, "2")])
def test_repairs_of_odd_rows_whole_and_in_segments(spark, segment, letters, parts):
    rows = odd_conversations()
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair.repairs(with_clashes(spark.createDataFrame(rows, CONV).repartition(3)), segment=segment, segment_letters=letters).collect()
    finally:
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before["spark.sql.execution.arrow.maxRecordsPerBatch"]
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.conv_id: tuple(r)[1:] for r in got} == by_brute_force(rows)
    assert len(got) == len({r[0] for r in rows})


def test_no_conversations(spark):
    assert repair.repairs(spark.createDataFrame([], CONV)).count() == 0


# --- rules ---

def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i:i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def rule_documents():
    rows = odd_documents()
    extra = ["a b c d e x a b c d e y a b c d e", "same line here\nsame line here\n \n \nsame line here\r\nsame", "é#ñ $%&| <> " * 30, "\n".join(["one two three four five six"] * 9),
             "a a a a a a a", sentence(8, 200) + "\n" + sentence(8, 200), "nul\x00 word " * 4]
    return rows + [(100 + i, t, "en", "a", None) for i, t in enumerate(extra)] + [(200 + i, sentence(i, 80 + i), "en", "a", None) for i in range(40)]


def test_rules_and_ratios_against_plain_counts(spark):
    rows = rule_documents()
    labels = [(200 + i, 1, 0) for i in range(30)] + [(230, 1, 1), (231, 0, 0), (200, 1, 0), (201, 0, 0), (0, 1, 0), (None, 1, 0), (232, None, 0)]
    docs = with_clashes(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3))
    marks = with_clashes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = ngram_ratio.judged(docs, marks, held_out=2).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    part = {r.id: r.part for r in ngram_ratio.trusted_ids(marks, 2).collect()}
    assert set(part) == {200 + i for i in range(30)} - {201} | {0} and set(part.values()) == {1, 2}

    # ratios by dictionary, a text at a time
    grams = [[[int(h) for h in ngram_ratio.slots(hashes, ngram_ratio.LEAST_BITS)] for _, hashes in ngram_ratio.ngrams([t])] for _, t, *_ in rows]
    scores = defaultdict(list)
    for order in range(2):
        raw = Counter(h for g in grams for h in g[order])
        target = Counter(h for (d, *_), g in zip(rows, grams, strict=True) if part.get(d) == 1 for h in g[order])
        scale = target.total() / raw.total()
        for n, g in enumerate(grams):
            mine = g[order]
            scores[n].append(sum(math.log((target[h] + 2) / (raw[h] * scale + 2)) for h in mine) / len(mine) if mine else None)
    limits = []
    for order, share in enumerate(ngram_ratio.LOSS):
        held = sorted(math.floor(s[order] / ngram_ratio.STEP) for (d, *_), s in zip(rows, scores.values(), strict=True) if part.get(d) == 2 and s[order] is not None)
        limits.append(held[int(share * len(held))] * ngram_ratio.STEP)
    want = []
    for n, (d, t, *_) in enumerate(rows):
        counts = plain_counts(t)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        near = any(s is not None and abs(s - x) < 1e-5 for s, x in zip(scores[n], limits, strict=True))
        kept = None if near else not failed and all(s is None or s >= x for s, x in zip(scores[n], limits, strict=True))
        want.append((d, *counts, failed, kept))
    mine = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got]
    assert Counter(r[:-1] for r in mine) == Counter(w[:-1] for w in want)
    sure = {w[:-1]: w[-1] for w in want if w[-1] is not None}
    assert all(sure.get(r[:-1], r[-1]) == r[-1] for r in mine)
    assert {r.kept for r in got} == {True, False}


def test_rules_without_labels_or_documents(spark):
    docs, marks = spark.createDataFrame(rule_documents(), DOC_SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept != r.base_failed and not r.score_1 for r in ngram_ratio.judged(docs, marks).collect())
    assert ngram_ratio.judged(docs.limit(0), marks).count() == 0


def test_all_trusted_documents_are_used(spark):
    marks = spark.range(130_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.when(F.col("id") % 13 > 0, 0).otherwise(1).alias("toxic"))
    assert sum(r["count"] for r in ngram_ratio.trusted_ids(marks).groupBy("part").count().collect()) == 120_000


def test_trusted_ids_too_many_to_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame(rule_documents() + [(None, sentence(3, 90), "en", "a", None)] * 3 + [(205, sentence(4, 90), "en", "a", None)], DOC_SCHEMA).repartition(3)
    marks = spark.createDataFrame([(200 + i, 1, 0) for i in range(30)] + [(None, 1, 0), (203, 0, 0)], "doc_id long, quality int, toxic int")
    want = Counter(ngram_ratio.judged(docs, marks, held_out=2).collect())
    monkeypatch.setattr(ngram_ratio, "BROADCAST", 3)
    assert Counter(ngram_ratio.judged(docs, marks, held_out=2).collect()) == want
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    assert ngram_ratio._marked(rows, ngram_ratio.trusted_ids(marks)).count() == docs.count()


def test_ngrams_do_not_cross_texts():
    together = ngram_ratio.ngrams(["a b", "", None, "c !! d"])
    assert [list(map(int, doc)) for doc, _ in together] == [[0, 0, 3, 3, 3], [0, 3]]
    alone = ngram_ratio.ngrams(["c !! d"])
    assert all((a[1][a[0] == 3] == b[1]).all() for a, b in zip(together, alone, strict=True))


@given
def test_ratio_rejects_bad_and_keeps_clean(spark):
    sf = SF.replace("0.001", "0.01")
    got = ngram_ratio.judged(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    kinds = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean").when(F.col("quality") == 0, "bad").alias("kind"))
    share = {r.kind: r.kept for r in got.filter("not base_failed").join(kinds.filter("kind is not null"), "doc_id").groupBy("kind").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share["clean"] >= 0.96 and share["bad"] <= 0.1


# --- spelling variants ---

def variants_by_brute_force(rows, damaged_in=97, least=3):
    low = {c: c + 32 for c in range(65, 91)}
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % damaged_in == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    close = {w: [v for v in words if near(w, v)] for w in words}
    form = {w: best for w, vs in close.items() if vs and words[best := min(vs, key=lambda v: (-words[v], v))] >= 2 * words[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {w: (n, len(close[w]), form.get(w), words.get(form.get(w)), root(w)) for w, n in words.items()}


def word_documents():
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcdéÿ") for _ in range(rnd.randint(5, 8))) for _ in range(40)]
    texts = []
    for i in range(120):
        words = [rnd.choice(base[:1 + i % 40]) for _ in range(30)]
        at = rnd.randrange(30)
        words[at] = words[at][:2] + rnd.choice("abcdéÿ") + words[at][rnd.randint(2, 3):]
        texts.append(" ".join(words).upper() if i % 10 == 0 else ", ".join(words))
    long = "q" * 3000
    texts += [" ".join([long, long, long, long + "q", long + "q", long + "q", long[:-1] + "z"] * 3), "", None, "×÷×÷× " * 4, "éééééé1éééééé", "abcde" * 3, "ÀÉÍÓÚ àéíóú " * 3,
              "chainaa " * 40 + "chainab " * 16 + "chaincb " * 7]
    rows = [(i, t, "en", "a", None) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[3], (None, texts[5], None, None, None)]


@pytest.mark.parametrize("damaged_in", [97, 3])
def test_variants_against_all_pairs(spark, monkeypatch, damaged_in):
    monkeypatch.setattr(spelling, "BLOCK", 16)
    monkeypatch.setattr(spelling, "HELD", 20)
    rows = word_documents()
    got = spelling.variants(with_clashes(spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)), damaged_in=damaged_in).collect()
    want = variants_by_brute_force(rows, damaged_in)
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == want and len(got) == len(want)
    if damaged_in == 97:
        assert any(r.form and r.root != r.form for r in got) and any(r.n_near and not r.form for r in got)


def test_pieces_and_sub_blocks(monkeypatch):
    text = "".join(random.Random(2).choice("abcÉ ,9") for _ in range(3000)) + "x" * 200 + " end"
    whole = spelling.runs(text)
    words = sorted({"".join(random.Random(i).choices("abÿ", k=6)) for i in range(400)})
    pairs = {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if sum(x != y for x, y in zip(words[i], words[j])) == 1}
    monkeypatch.setattr(spelling, "PIECE", 17)
    monkeypatch.setattr(spelling, "SUB", 8)
    assert spelling.runs(text) == whole
    i, j = spelling.near_words([w.encode("latin-1") for w in words], None)
    assert set(zip(i.tolist(), j.tolist())) == pairs and len(i) == len(pairs)


def test_near_words_across_lengths_with_long_runs(monkeypatch):
    rnd = random.Random(4)
    base = sorted({"".join(rnd.choices("abÿ", k=6)) for _ in range(200)}) + ["q" * 6, "qqqqqq"[:-1] + "z"]
    for pad in ("", "q" * 3000):  # the squared norms of the second kind leave float32
        a = [(w + pad).encode("latin-1") for w in base]
        b = sorted({w[:k] + c + w[k:] for w in a[::3] for k in (0, 3, 6) for c in (b"a", b"\xff")})
        near = {(i, j) for i, v in enumerate(a) for j, w in enumerate(b) if any(w[:k] + w[k + 1:] == v for k in range(8))}
        for sub in (7, 256):
            monkeypatch.setattr(spelling, "SUB", sub)
            i, j = spelling.near_words(a, b)
            assert near and set(zip(i.tolist(), j.tolist())) == near and len(i) == len(near)


def test_block_pairs_are_read_as_arrays():
    words, counts = [["abcde", "abcdf"], ["abcde", "zzzéé"], ["yzzzéé"]], [[9, 3], [9, 7], [6]]
    assert spelling._cells(pa.array(words)[1]).tolist() == words[1] and spelling._cells(pa.array(counts)[1]).tolist() == counts[1]
    columns = [[1, 2], [1, 3], words[:2], [words[0], words[2]], counts[:2], [counts[0], counts[2]]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "words_a", "words_b", "counts_a", "counts_b"])
    got = [tuple(r.values()) for part in spelling._met([batch]) for r in part.to_pylist()]
    assert got == [("abcde", 1, 3, "abcdf"), ("abcdf", 1, 9, "abcde"), ("zzzéé", 1, 6, "yzzzéé"), ("yzzzéé", 1, 7, "zzzéé")]


def test_no_words(spark):
    assert spelling.variants(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "a b", None, None, None)], DOC_SCHEMA)).count() == 0


@given
@pytest.mark.parametrize("name, table", [("op11_conversation_repair", "conversations"), ("op13_spelling_variants", "documents")])
def test_given_rows_match_sql(spark, name, table):
    import duckdb

    from protlake.llm.queries import QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert Counter(tuple(r) for r in QUERIES[name](spark, SF).select(names).collect()) == Counter(want.fetchall())


def test_batches_restores_the_setting(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), tk.batches(spark, 7):
        assert spark.conf.get(key) == "7"
        raise ValueError
    assert spark.conf.get(key) == before
