import json
import math
import random

import pytest
from pyspark.sql import functions as F

from protlake.functions import scalar as fn
from protlake.operators import contacts as K, graphs as G
from protlake.plans import graph_tables as GT, structure_features as SF
from protlake.sources import structures as ST


def atom(serial, name, res, num, x, y, z, b, chain="A"):
    return f"ATOM  {serial:5d} {name:<4} {res:>3} {chain}{num:4d}    {x:8.3f}{y:8.3f}{z:8.3f}{1:6.2f}{b:6.2f}"


PDB = "\n".join([atom(1, " N", "ALA", 1, 9, 9, 9, 91.5), atom(2, " CA", "ALA", 1, 1, 2, 3, 91.5), atom(3, " CA", "GLY", 2, 4, 5, 6, 42), "HETATM", "END"])


def test_pdb_keeps_ca_atoms_only(spark, tmp_path):
    (tmp_path / "a.pdb").write_text(PDB)
    row = ST.parse_structures(ST.read_files(spark, str(tmp_path))).first()
    assert row.pdb_error is None
    assert [(r.residue_index, r.residue_name1, r.plddt, r.x, r.z) for r in row.residues] == [(1, "A", 91.5, 1.0, 3.0), (2, "G", 42.0, 4.0, 6.0)]


def test_error_json_shapes(spark):
    m = [[0.0, 1.0], [2.0, 0.0]]
    texts = [json.dumps({"pae": m}), json.dumps([{"predicted_aligned_error": m}]), json.dumps({"predicted_aligned_error": m}), "{bad json", "[]", json.dumps({"pae": []})]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(ST.error_matrix(F.col("t")).alias("m"))
    assert [r.m for r in df.collect()] == [m, m, m, None, None, None]


def requests(spark, **over):
    coords = [(0, 95), (6, 72), (14, 35)]
    pdb = "\n".join(atom(i + 1, " CA", n, i + 1, 0, 0, z, b) for i, ((z, b), n) in enumerate(zip(coords, ("ALA", "CYS", "ASP"))))
    base = dict(entry_id="P1", taxonomy_id="9606", model_entity_id="M1", sequence="ACD", sequence_start=1, sequence_end=3, pdb_text=pdb,
                pae_text=json.dumps({"pae": [[0, 2, 15], [2, 0, 3], [15, 3, 0]]}))
    base.update(over)
    return spark.createDataFrame([base], "entry_id string, taxonomy_id string, model_entity_id string, sequence string, sequence_start int, sequence_end int, pdb_text string, pae_text string")


def test_feature_tables(spark):
    t = SF.feature_tables(requests(spark), 10.0, 8.0)
    res = t["residues"].orderBy("residue_index").collect()
    assert len(res) == 3 and res[0].seq_position == 1 and res[2].plddt_bin == "very_low"
    assert [r.contact_degree for r in res] == [1, 2, 1]
    edges = t["edges"].orderBy("source_residue_index").collect()
    assert len(edges) == 2 and edges[0].distance_ca == 6.0 and edges[0].is_sequential_neighbor and edges[0].pae_mean_pair == 2.0
    frag = t["fragments"].first()
    assert frag.mean_plddt == pytest.approx((95 + 72 + 35) / 3) and frag.contact_edge_count == 2 and frag.alignment_status == "exact_fragment_match"
    assert len(t["fragments"].columns) == 27 and len(t["residues"].columns) == 26 and len(t["edges"].columns) == 15
    assert t["failures"].count() == 0


@pytest.mark.parametrize("over,status,first", [
    ({}, "exact_fragment_match", 1), ({"sequence_start": 2, "sequence_end": 4}, "exact_full_match", 1),
    ({"sequence": "GGACD", "sequence_start": 1, "sequence_end": 2}, "substring_match", 3),
    ({"sequence": "WWWWWW", "sequence_start": 4, "sequence_end": 6}, "range_length_match", 4),
    ({"sequence": "WWWWWW", "sequence_start": 4, "sequence_end": 9}, "unresolved", None)])
def test_alignment_rules(spark, over, status, first):
    row = SF.residue_rows(SF.parsed_fragments(requests(spark, **over))).orderBy("residue_index").first()
    assert (row.alignment_status, row.seq_position) == (status, first)


@pytest.mark.parametrize("over,message", [({"pae_text": "{bad"}, "missing"), ({"pae_text": '{"pae": [[1.0]]}'}, "residue count"), ({"pdb_text": "END"}, "no CA"),
                                          ({"pae_text": '{"pae": [[1.0],[1.0],[1.0]]}'}, "square")])
def test_failures(spark, over, message):
    row = SF.fragment_failures(SF.parsed_fragments(requests(spark, **over))).first()
    assert row.status == "parse_error" and message in row.error


def test_grid_join_equals_brute_force(spark):
    rnd = random.Random(5)
    pts = [("F", i, rnd.uniform(-3, 3), rnd.uniform(-3, 3), rnd.choice([-1.0, 0.0, 1.0])) for i in range(120)]
    pts += [("G", 0, 0.0, 0.0, 0.0), ("G", 1, 1.0, 0.0, 0.0), ("G", 2, -1.0, 0.0, 0.0), ("G", 3, 0.0, 0.0, 0.0), ("G", 4, 2.0000001, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "g string, i int, x double, y double, z double")
    got = {(r.g, r.source, r.target) for r in K.pairs_within(df, ["g"], "i", 1.0).collect()}
    want = {(a[0], a[1], b[1]) for a in pts for b in pts if a[0] == b[0] and a[1] < b[1] and math.dist(a[2:], b[2:]) <= 1.0}
    assert got == want and len(K.pairs_within(df, ["g"], "i", 1.0).collect()) == len(want)


RES = ("entry_id string, taxonomy_id string, model_entity_id string, seq_position int, residue_index int, residue_number int, residue_name1 string, plddt double, "
       "is_plddt_very_low boolean, is_plddt_low boolean, is_plddt_confident boolean, is_plddt_very_high boolean, pae_row_mean double, pae_row_min double, pae_row_p90 double, "
       "x double, y double, z double, sequence_position_fraction double")
EDGE = ("entry_id string, taxonomy_id string, model_entity_id string, source_residue_index int, target_residue_index int, source_seq_position int, target_seq_position int, "
        "distance_ca double, seq_separation int, pae_mean_pair double, is_sequential_neighbor boolean, is_short_range_sequence boolean, is_strict_contact boolean")


@pytest.fixture
def overlapping(spark):
    def res(m, pos, idx, aa, p, pae, x):
        return ("P", "9606", m, pos, idx, idx, aa, p, False, p < 70, 70 <= p < 90, p >= 90, *pae, x, 0.0, 0.0, 0.5)
    residues = spark.createDataFrame([res("F1", 1, 1, "A", 70.0, (2.0, 0.0, 5.0), 0.0), res("F1", 2, 2, "C", 60.0, (9.0, 1.0, 12.0), 1.0),
                                      res("F2", 2, 1, "C", 95.0, (3.0, 0.0, 4.0), 1.5), res("F2", 3, 2, "D", 88.0, (5.0, 0.0, 6.0), 2.5),
                                      res("F2", 0, 3, "D", 88.0, (5.0, 0.0, 6.0), 2.5), res("F2", None, 4, "D", 88.0, (5.0, 0.0, 6.0), 2.5)], RES)
    edges = spark.createDataFrame([("P", "9606", "F1", 1, 2, 1, 2, 5.0, 1, 9.0, True, True, True), ("P", "9606", "F2", 1, 2, 2, 3, 4.0, 1, 3.0, True, True, True)], EDGE)
    return residues, edges, spark.createDataFrame([("P", 3), ("Q", 7)], "entry_id string, sequence_length int")


def test_graph_from_overlapping_fragments(spark, overlapping, rows):
    g = GT.graph_tables(*overlapping)
    nodes = g["nodes"].orderBy("node").collect()
    assert [n.seq_position for n in nodes] == [1, 2, 3] and nodes[1].model_entity_id == "F2" and [n.fragment for n in nodes] == [0, 1, 1]
    assert rows(g["edges"].select("source", "target")) == [(1, 2), (2, 1)]
    s = g["summary"].first()
    assert len(s.graph_feat) == 13 and s.residue_count == 3 and s.graph_feat[9] == pytest.approx(1 / 3)
    assert [r.entry_id for r in g["errors"].collect()] == ["Q"]
    n = GT.normalised(g)
    assert n["nodes"].orderBy("node").first().base[21] == pytest.approx(0.7)


def test_overlays(spark, overlapping):
    nodes = GT.graph_tables(*overlapping)["nodes"]
    emb = spark.createDataFrame([("P", 1, [1.5] * 4), ("P", 3, [2.5] * 4)], "entry_id string, seq_position int, embedding array<float>")
    st = spark.createDataFrame([("F1", 1, [1.0] * 10, True, False), ("F2", 1, [2.0] * 10, False, True)], "model_entity_id string, residue_index int, features array<float>, dssp_mask boolean, sasa_mask boolean")
    out = GT.overlaid(nodes, st, emb, width=4).orderBy("node").collect()
    assert [r.has_embedding for r in out] == [True, False, True] and out[0].embedding[0] == 1.5
    assert [(r.has_dssp, r.has_sasa) for r in out] == [(True, False), (False, True), (False, False)] and out[1].structure[0] == 2.0
    dense = G.node_features(GT.overlaid(nodes, st, emb, width=4), embedding_width=4).first()
    assert len(dense.x) == 46
    with pytest.raises(Exception, match="width"):
        G.overlay_embedding(nodes, emb, 5).collect()


def dssp_line(num, chain, aa, code, acc, phi, psi):
    return (f"{1:5d}{num:5d} {chain} {aa}  {code}".ljust(34) + f"{acc:4d}").ljust(103) + f"{phi:6.1f}{psi:6.1f}"


def test_dssp(spark):
    text = "\n".join(["junk " * 30, "  #  RESIDUE AA STRUCTURE", dssp_line(42, "A", "L", "H", 123, -60, 135), dssp_line(43, "A", "!", " ", 1, 0, 0), "short", dssp_line(44, " ", "g", "E", 5, 0, 0)])
    df = spark.createDataFrame([("f", text), ("g", "no header")], "model_entity_id string, value string")
    got = ST.parse_dssp(df, ["model_entity_id"]).orderBy("residue_number").collect()
    assert [(r.residue_number, r.chain_id, r.aa, r.code, r.accessibility, r.phi, r.psi) for r in got] == [(42, "A", "L", "H", 123.0, -60.0, 135.0), (44, "A", "G", "E", 5.0, 0.0, 0.0)]


def test_area_json_lists_and_dicts(spark):
    as_dict = {"results": [{"structures": [{"chains": {"A": {"residues": {"42": {"area": {"total": 55.5}}, "43A": {"area": 12.0}}}}}]}]}
    as_list = {"structures": [{"chains": [{"label": "", "residues": [{"number": "7", "area": 1.5}, {"number": "7", "area": {"total": 2.5}}]}]}]}
    df = spark.createDataFrame([("d", json.dumps(as_dict)), ("l", json.dumps(as_list)), ("x", "{oops")], "model_entity_id string, value string")
    got = {(r.model_entity_id, r.chain_id, r.residue_number, r.insertion_code): r.area for r in ST.parse_areas(df, ["model_entity_id"]).collect()}
    assert got == {("d", "A", 42, ""): 55.5, ("d", "A", 43, "A"): 12.0, ("l", "A", 7, ""): 2.5}


def test_ontology_penalty(spark):
    pairs = spark.createDataFrame([(1, 0)], "child int, parent int")
    vec = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 2.0])], "term int, w array<double>")
    assert G.ontology_penalty(pairs, vec, 0.5).first().penalty == 1.25
    assert G.ontology_penalty(pairs.where("false"), vec, 0.5).first().penalty == 0.0


def test_structure_vector_width(spark):
    v = spark.range(1).select(fn.structure_vector(F.lit("L"), F.lit("H"), fn.d(95.5), fn.d(90), fn.d(0), fn.d(7)).alias("v")).first().v
    assert len(v) == 10 and v[:3] == [1, 0, 0] and v[3] == pytest.approx(1) and v[8] == pytest.approx(0.5) and v[9] == 7


def test_row_contacts_equal_brute_force(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    rows = [(g, rnd.uniform(-s, s, (n, 3)).tolist()) for g, (n, s) in enumerate([(0, 1), (1, 1), (2, 0.1), (90, 6), (300, 20), (40, 1e6), (60, 0.0)])]
    grid = [[float(a), float(b), 0.0] for a in range(-4, 5) for b in range(-4, 5)]  # points on cell borders and exactly at the radius
    rows += [(7, grid), (8, None), (9, [[0.0, 0.0, float("nan")], [0.0, 0.0, 0.0], [0.0, 0.0, 0.5], [1e300, 0.0, float("inf")]])]
    df = spark.createDataFrame(rows, "g int, p array<array<double>>").repartition(2).selectExpr("g", *[f"transform(p, q -> q[{i}]) as {c}" for i, c in enumerate("xyz")])
    got = {r.g: r.c for r in df.select("g", K.row_contacts(2.0, 1.0)("x", "y", "z").alias("c")).collect()}
    for g, points in rows:
        points = points or []
        want = [(i + 1, j + 1, math.dist(points[i], points[j])) for i in range(len(points)) for j in range(i + 1, len(points)) if math.dist(points[i], points[j]) <= 2.0]
        c = got[g]
        assert list(zip(c.source, c.target)) == [w[:2] for w in want] and c.distance == pytest.approx([w[2] for w in want])
        for degree, limit in ((c.degree, 2.0), (c.strict_degree, 1.0)):
            assert degree == [sum(w[2] <= limit for w in want if n in w[:2]) for n in range(1, len(points) + 1)]


def test_pairs_of_many_rows_in_pieces(monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(4)
    xyz, group = rnd.uniform(0, 9, (200, 3)), np.repeat(np.arange(10), 20)
    whole = K.cell_pairs(group, xyz, 2.5)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if group[i] == group[j] and math.dist(xyz[i], xyz[j]) <= 2.5}
    assert set(zip(whole[0].tolist(), whole[1].tolist())) == want and len(whole[0]) == len(want)


def test_no_exchange_between_parsing_and_edges(spark):
    searched = SF.with_contacts(SF.parsed_fragments(requests(spark)), 10.0, 8.0)
    for table in (SF.edge_rows(searched, 8.0), SF.residue_table(SF.residue_rows(searched))):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    assert SF.edge_rows(searched, 8.0).count() == 2


def test_one_sort_gives_all_ranks(spark):
    rows = [([3.0, 1.0, 2.0],), ([5.0],), ([],), (None,), ([1.0, 2.0, 3.0, 4.0, 10.0],)]
    got = [r.q for r in spark.createDataFrame(rows, "v array<double>").select(fn.array_quantiles(F.col("v"), [0.0, 0.5, 0.9, 1.0]).alias("q")).collect()]
    assert got[0] == pytest.approx([1, 2, 2.8, 3]) and got[1] == [5, 5, 5, 5] and got[2] is None and got[3] is None and got[4] == pytest.approx([1, 3, 7.6, 10])
