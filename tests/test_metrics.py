import random

import numpy as np

import pytest
from pyspark.sql import functions as F

from protlake.operators import metrics as M, scoring as S

PAIRS = "entry_id string, term string, score float, y boolean"


def f1(p, r):
    return 0.0 if p + r == 0 else 2 * p * r / (p + r)


@pytest.fixture
def worked(spark):
    """Four entries by two labels with saturated scores."""
    cells = [(1, 0, 1, 0), (1, 1, 1, 0), (0, 1, 0, 1), (0, 0, 0, 0)]
    data = []
    for i, (s1, s2, y1, y2) in enumerate(cells):
        data += [(f"E{i}", "A", float(s1), bool(y1)), (f"E{i}", "B", float(s2), bool(y2))]
    return spark.createDataFrame(data, PAIRS)


def test_micro_macro_and_fmax(spark, worked):
    terms = spark.createDataFrame([("A",), ("B",)], "term string")
    row = S.evaluate(worked, terms, 0.5, 0.5, dense=True).first()
    assert (row.micro_precision, row.micro_recall) == (pytest.approx(0.75), 1.0)
    assert row.micro_f1 == pytest.approx(6 / 7)
    assert row.macro_f1 == pytest.approx((1 + 2 / 3) / 2) == row.macro_f1_positive_labels
    assert row.fmax == pytest.approx(6 / 7) and (row.label_count, row.label_count_with_positive) == (2, 2)


def test_labels_without_rows_count_in_macro(spark, worked):
    terms = spark.createDataFrame([("A",), ("B",), ("C",)], "term string")
    row = S.evaluate(worked, terms, 0.5, 0.5, dense=True).first()
    assert row.macro_f1 == pytest.approx((1 + 2 / 3) / 3) and row.macro_f1_positive_labels == pytest.approx((1 + 2 / 3) / 2)


def test_step_grid_values():
    grid = M.step_thresholds(0.01)
    assert len(grid) == 101 and grid[0] == 0.0 and grid[-1] == 1.0 and grid[50] == 0.5000000000000002
    assert M.step_thresholds(0.5) == [0.0, 0.5, 1.0]


@pytest.mark.parametrize("grid", [M.step_thresholds(0.01), M.even_grid(0.01, 0.99, 99), [0.05 + 0.1 * i for i in range(9)], [0.1, 0.5, 0.52], [0.3]])
def test_bucket_equals_direct_count(spark, grid):
    rnd = random.Random(7)
    scores = [rnd.random() for _ in range(500)] + list(grid) + [0.0, 1.0, 0.5, -0.2, 1.3]
    df = spark.createDataFrame([(float(s),) for s in scores], "s float")
    arr = F.array(*[F.lit(t).cast("float") for t in grid])
    bad = df.where(M.bucket_of(F.col("s"), grid) != F.size(F.filter(arr, lambda t: F.col("s") >= t))).count()
    assert bad == 0


def test_score_equal_to_threshold_is_positive(spark):
    df = spark.createDataFrame([("E", "A", 0.5, True)], PAIRS)
    assert M.term_counts_at(df, 0.5).first().tp == 1
    at = {round(r.threshold, 2): r.tp for r in M.sweep(df, M.step_thresholds(0.01)).collect()}
    assert at[0.5] == 1 and at[0.51] == 0


def test_bucket_sweep_equals_direct_sweep_under_any_partitioning(spark):
    rnd = random.Random(3)
    data = [(f"E{rnd.randrange(30)}", f"T{i}", round(rnd.random(), 2), rnd.random() < 0.3) for i in range(400)]
    df = spark.createDataFrame(data, PAIRS)
    grid = M.step_thresholds(0.05)
    expected = []
    for k, t in enumerate(grid):
        t32 = np.float32(t)
        hit = [(np.float32(s) >= t32, y) for _, _, s, y in data]
        expected.append((k, sum(h and y for h, y in hit), sum(h and not y for h, y in hit), sum((not h) and y for h, y in hit)))
    for parts in (1, 7):
        got = [(r.k, r.tp, r.fp, r.fn) for r in M.sweep(df.repartition(parts), grid).orderBy("k").collect()]
        assert got == expected


def test_implicit_cells_complete_the_matrix(spark, worked):
    entries = spark.createDataFrame([(f"E{i}",) for i in range(6)], "entry_id string")
    terms = spark.createDataFrame([("A",), ("B",), ("C",)], "term string")
    grid = M.step_thresholds(0.5)
    zero = M.sweep(worked, grid, implicit=M.implicit_cells(worked, entries, terms, grid)).where("k = 0").first()
    assert zero.tp + zero.fp == 18 and zero.tp == 3


def test_unscored_labels_are_positives_of_score_zero(spark, rows):
    scores = spark.createDataFrame([("E", "A", 0.9)], "entry_id string, term string, score float")
    labels = spark.createDataFrame([("E", "B"), ("E", "B")], "entry_id string, term string")
    got = [(r.term, round(r.score, 3), r.y) for r in M.join_targets(scores, labels).orderBy("term").collect()]
    assert got == [("A", 0.9, False), ("B", 0.0, True)]


def test_weighted_fmax_by_hand(spark):
    df = spark.createDataFrame([("E", "A", 0.9, True), ("E", "B", 0.8, False), ("F", "B", 0.2, True)], PAIRS)
    ia = spark.createDataFrame([("A", 2.0), ("B", 1.0)], "term string, ia double")
    best = M.weighted_fmax(df, ia, [0.1, 0.5, 0.85], dense=True).first()
    assert best.ia_fmax == pytest.approx(6 / 7, abs=1e-6) and best.ia_fmax_threshold == 0.1


def test_samples_f1_counts_entries_without_rows(spark, worked):
    entries = spark.createDataFrame([(f"E{i}",) for i in range(8)], "entry_id string")
    assert M.samples_f1(worked, 0.5, entries).first()[0] == pytest.approx((1 + 2 / 3 + 1 + 0) / 8)


def test_fusion_examples(spark):
    ids = [("P1", "A"), ("P1", "B"), ("P2", "A"), ("P2", "B")]

    def table(values, col="score"):
        return spark.createDataFrame([(*i, float(v)) for i, v in zip(ids, values)], f"entry_id string, term string, {col} float")

    fused = S.fuse(table([.2, .8, .4, .6]), table([.6, .4, .1, .9]).orderBy(F.desc("term")), 0.25, 0.75)
    got = [round(r.score, 4) for r in fused.orderBy("entry_id", "term").collect()]
    assert got == [0.5, 0.5, 0.175, 0.825]
    logits = S.fuse(table([0, 2, 0, 0], "logit"), table([2, 0, 0, 0], "logit"), 1, 1, "logits").where("entry_id = 'P1'").collect()
    assert all(r.logit == 1.0 and r.score == pytest.approx(0.7310586) for r in logits)
    with pytest.raises(ValueError):
        S.fuse(table([0] * 4), table([0] * 4), 0, 0)
    with pytest.raises(ValueError):
        S.fuse(table([0] * 4), table([0] * 4), 1, 1, "logits")
    with pytest.raises(Exception, match="differ"):
        S.fuse(table([0] * 4), table([0] * 4).where("term = 'A'"), 1, 1).collect()


def test_linear_routes_agree(spark, rows):
    x = spark.createDataFrame([(f"E{i}", [float(i), 1.0, -2.0]) for i in range(5)], "entry_id string, embedding array<float>")
    w = spark.createDataFrame([(f"T{j}", [0.5 * j, 1.0, 0.25], 0.1 * j) for j in range(130)], "term string, w array<double>, b double")
    a, b = S.linear_scores(x, w), S.linear_scores(x, w, broadcast_limit=0)
    strip = lambda df: {(r.entry_id, r.term): round(r.logit, 9) for r in df.collect()}
    assert strip(a) == strip(b) and len(strip(a)) == 650
    assert strip(a)[("E2", "T4")] == pytest.approx(2 * 2.0 + 1 - 0.5 + 0.4)


def test_losses_by_hand(spark):
    import math
    df = spark.createDataFrame([("E", "A", 0.8, True), ("E", "B", 0.3, False)], PAIRS).withColumn("w", F.lit(3.0))
    from protlake.functions import scalar as fn
    row = M.losses(df, fn.logit(F.col("score")), pos_weight="w").first()
    assert row.bce == pytest.approx(-(math.log(.8) + math.log(.7)) / 2, abs=1e-6)
    assert row.weighted_bce == pytest.approx(-(3 * math.log(.8) + math.log(.7)) / 2, abs=1e-6)
    assert row.focal_bce == pytest.approx((.25 * .04 * -math.log(.8) + .75 * .09 * -math.log(.7)) / 2, abs=1e-6)


def test_two_layer_routes_agree(spark):
    x = spark.createDataFrame([(f"E{i}", [float(i), 1.0 - i]) for i in range(4)], "entry_id string, embedding array<float>")
    hidden = spark.createDataFrame([(j, [1.0, -1.0 * j], 0.5) for j in range(12)], "unit int, w array<double>, b double")
    out = spark.createDataFrame([("A", [0.1 * j for j in range(12)], 1.0), ("B", [1.0] * 12, 0.0)], "term string, w array<double>, b double")
    strip = lambda df: {(r.entry_id, r.term): round(r.logit, 9) for r in df.collect()}
    got = strip(S.two_layer_scores(x, hidden, out))
    assert got == strip(S.two_layer_scores(x, hidden, out, broadcast_limit=0))
    want = sum(0.1 * j * max(0.0, 3 - j * -2.0 + 0.5) for j in range(12)) + 1.0
    assert got[("E3", "A")] == pytest.approx(want)


def test_unscored_cells_count_in_weighted_macro_and_comparison(spark):
    df = spark.createDataFrame([("E", "A", 0.9, True), ("E", "B", 0.0, False)], PAIRS)
    entries = spark.createDataFrame([("E",), ("F",)], "entry_id string")
    terms = spark.createDataFrame([("A", 2.0), ("B", 1.0), ("C", 4.0)], "term string, ia double")
    for call in (lambda **k: M.weighted_fmax(df, terms, [0.0, 0.5], **k), lambda **k: M.macro_sweep(df, [0.0, 0.5], terms, **({"entries": k["entries"]} if k else {})),
                 lambda **k: M.model_comparison(df, terms, [0.0, 0.5], [], **k) if k else M.model_comparison(df, terms, [0.0, 0.5], [])):
        with pytest.raises(ValueError):
            call()
    weighted = M.with_ratios(M.threshold_counts(M.weigh(M.term_buckets(df, [0.0, 0.5], [], entries, terms, False), terms), [0.0, 0.5]), eps=True).where("k = 0").first()
    assert (weighted.tp, weighted.fp) == (2.0, 2.0 + 2 * 1.0 + 2 * 4.0)
    assert M.weighted_fmax(df, terms, [0.0, 0.5], entries=entries, terms=terms).first().ia_fmax_threshold == 0.5
    macro = {r.k: r.macro_f1 for r in M.macro_sweep(df, [0.0, 0.5], terms, entries=entries).collect()}
    assert macro == {0: pytest.approx((2 / 3) / 3), 1: pytest.approx(1 / 3)}


def test_precision_recall_in_ranges_equals_one_sequence(spark):
    import random

    rnd = random.Random(4)
    data = [(f"E{i}", rnd.choice("AB"), float(np.float32(rnd.choice([0.0, 0.5, 0.9, round(rnd.random(), 2)]))), rnd.random() < 0.3) for i in range(400)]
    rows = [(g, *r) for g in (None, "x") for r in data[:400 if g else 5]] + [("none", "E", "A", 0.5, False)]
    df = spark.createDataFrame(rows, "g string, " + PAIRS).repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = M.precision_recall(df, ["g"], dense=True).collect()
        areas = {r.g: r for r in M.micro_auprc(df, ["g"], dense=True).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    for g in (None, "x", "none"):
        mine, tp, fp, area, step, last = [r for r in rows if r[0] == g], 0, 0, 0.0, 0.0, (1.0, 0.0)
        total = sum(r[4] for r in mine)
        points = {r.score: r for r in got if r.g == g}
        for score in sorted({r[3] for r in mine}, reverse=True):
            tp += sum(r[4] for r in mine if r[3] == score)
            fp += sum(not r[4] for r in mine if r[3] == score)
            p, recall = tp / (tp + fp), tp / total if total else 0.0
            assert (points[score].tp, points[score].fp) == (tp, fp) and points[score].precision == pytest.approx(p) and points[score].recall == pytest.approx(recall)
            area, step, last = area + (recall - last[1]) * (p + last[0]) / 2, step + (recall - last[1]) * p, (p, recall)
        assert areas[g].micro_auprc == pytest.approx(area) and areas[g].average_precision == pytest.approx(step)


def test_no_weights_give_no_scores(spark):
    from protlake.operators import scoring

    features = spark.createDataFrame([("P", [1.0, 2.0])], "entry_id string, embedding array<float>")
    none = spark.createDataFrame([], "term string, w array<double>, b double")
    got = scoring.linear_scores(features, none)
    assert got.columns == ["entry_id", "term", "logit"] and got.count() == 0
    weights = spark.createDataFrame([(f"T{i}", [float(i), 1.0], 0.5) for i in range(700)], "term string, w array<double>, b double")
    both = [{(r.entry_id, r.term): r.logit for r in scoring.linear_scores(features, weights, broadcast_limit=limit).collect()} for limit in (0, 1 << 30)]
    assert both[0] == both[1] and both[0]["P", "T3"] == 5.5 and len(both[0]) == 700


def test_fusion_report_counts_each_table_by_itself(spark, tmp_path, monkeypatch):
    """Brute force with repeated pairs and labels nobody scored; one table at a time, and nothing reads a table of pairs again or leaves it behind."""
    from protlake.plans import reports

    draw = random.Random(7)
    names, vocab = [f"P{i}" for i in range(12)], [f"T{j}" for j in range(6)]
    cells = [(e, t) for e in names for t in vocab]
    scored = draw.sample(cells, 40)
    scored += scored[:5]  # come twice in both tables
    first, second = ([(e, t, draw.randrange(101) / 100) for e, t in scored] for _ in range(2))
    positive = draw.sample(cells, 25)
    kinds = "entry_id string, term string"
    path = lambda n: str(tmp_path / n)
    for n, rows in (("graph", first), ("sequence", second)):
        spark.createDataFrame(rows, f"{kinds}, score float").write.parquet(path(n))
    labels = spark.createDataFrame(positive + positive[:4], kinds)
    calls, evaluate = [], S.evaluate
    monkeypatch.setattr(reports.scoring, "evaluate", lambda pairs, *a, **k: calls.append({r.model for r in pairs.select("model").distinct().collect()}) or evaluate(pairs, *a, **k))
    report = reports.fusion_report(spark.read.parquet(path("graph")), spark.read.parquet(path("sequence")), labels, spark.createDataFrame([(t,) for t in vocab], "term string"),
                                   1.0, 3.0, step=0.1, entries=spark.createDataFrame([(e,) for e in names], "entry_id string"))
    assert sorted(map(sorted, calls)) == [["fused"], ["graph"], ["sequence"]]
    assert not [f for f in report.inputFiles() if str(tmp_path) in f or "fused" in f or "pairs" in f]

    f32 = lambda v: float(np.float32(v))
    tables = {"graph": first, "sequence": second,
              "fused": [(e, t, 0.25 * f32(v) + 0.75 * f32(w)) for e, t, v in first for d, u, w in second if (e, t) == (d, u)]}
    got, best = {r.model: r for r in report.collect()}, {}
    for name, rows in tables.items():
        have = {(e, t) for e, t, _ in rows}
        pairs = [(f32(min(max(f32(v), 1e-7), 1 - 1e-7)), (e, t) in set(positive)) for e, t, v in rows] + [(f32(1e-7), True) for c in positive if c not in have]
        missing = len(cells) - len(pairs)
        at = []
        for k in M.step_thresholds(0.1):
            tp, fp = (sum(v >= f32(k) and y == w for v, y in pairs) for w in (True, False))
            fp += missing if k <= 0 else 0
            p, r = tp / (tp + fp) if tp + fp else 0.0, tp / sum(y for _, y in pairs)
            at.append((2 * p * r / (p + r) if p + r else 0.0, -k))
        best[name] = max(at)
        assert got[name].fmax == pytest.approx(best[name][0]) and got[name].fmax_threshold == pytest.approx(-best[name][1])
        assert got[name].fmax_delta == pytest.approx(best[name][0] - best["graph"][0])
