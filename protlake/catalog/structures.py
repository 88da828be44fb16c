"""Structure, contact and graph queries over fragments derived from the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from protlake import constants as C
from protlake.catalog import views as V
from protlake.catalog.registry import query, r6, rounded, table
from protlake.functions import scalar as fn
from protlake.operators import checks, contacts as K, fragments as FR, graphs as G, ranking
from protlake.plans import graph_tables as GT, structure_features as SF
from protlake.sources import structures as ST

# --- points straight from the table: all vectors of one label are one fragment ---------------------------------


def _points(spark, sf):
    return table(spark, sf, "embeddings").select("label", "vec_id", *[
        F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")])


_POINTS = "pt AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"
_CONTACTS = f"""{_POINTS}, ce AS (SELECT * FROM (SELECT a.label, a.vec_id AS source, b.vec_id AS target,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance
  FROM pt a JOIN pt b ON a.label = b.label AND a.vec_id < b.vec_id) WHERE distance <= {{t}}),
cd AS (SELECT label, v, count(*) AS d, count(*) FILTER (WHERE distance <= 0.05) AS s FROM
  (SELECT label, source AS v, distance FROM ce UNION ALL SELECT label, target, distance FROM ce) GROUP BY 1, 2)"""


@query("contact_edges", f"WITH {_CONTACTS.format(t=0.05)} SELECT label, source, target, round(distance, 6) AS distance FROM ce")
def contact_edges(spark, sf):
    return rounded(K.pairs_within(_points(spark, sf), ["label"], "vec_id", 0.05))


@query("contact_degree", f"""WITH {_CONTACTS.format(t=0.1)} SELECT pt.label, pt.vec_id, coalesce(d, 0) AS contact_degree, coalesce(s, 0) AS strict_contact_degree
FROM pt LEFT JOIN cd ON cd.label = pt.label AND cd.v = pt.vec_id""")
def contact_degree(spark, sf):
    p = _points(spark, sf)
    edges = K.edge_flags(K.pairs_within(p, ["label"], "vec_id", 0.1), 0.05)
    return K.with_degrees(p.select("label", "vec_id"), edges, ["label"], "vec_id")


@query("contact_density", f"""WITH {_CONTACTS.format(t=0.1)}, n AS (SELECT label, count(*) AS n FROM pt GROUP BY 1), e AS (SELECT label, count(*) AS e FROM ce GROUP BY 1)
SELECT n.label, n AS nodes, coalesce(e, 0) AS edges, round(coalesce(e, 0) / (n * (n - 1) / 2.0), 6) AS density FROM n LEFT JOIN e ON e.label = n.label""")
def contact_density(spark, sf):
    p = _points(spark, sf)
    edges = K.pairs_within(p, ["label"], "vec_id", 0.1).groupBy("label").agg(F.count("*").alias("edges"))
    nodes = p.groupBy("label").agg(F.count("*").alias("nodes"))
    return nodes.join(edges, "label", "left").fillna(0, ["edges"]).withColumn("density", r6(K.contact_density(F.col("edges"), F.col("nodes"))))


@query("gyration", f"WITH {_POINTS} SELECT label, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS gyration FROM pt GROUP BY 1")
def gyration(spark, sf):
    return rounded(_points(spark, sf).groupBy("label").agg(K.radius_of_gyration().alias("gyration")))


@query("best_residue", """
SELECT l_partkey, l_extendedprice, l_discount, l_orderkey, l_linenumber, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_discount, l_orderkey, l_linenumber, l_suppkey) = 1""")
def best_residue(spark, sf):
    cols = ["l_partkey", "l_extendedprice", "l_discount", "l_orderkey", "l_linenumber", "l_suppkey"]
    return ranking.best_per_group(table(spark, sf, "lineitem").select(*cols), ["l_partkey"],
                                  [F.col("l_extendedprice").desc(), *map(F.col, cols[2:])])


@query("best_edge", """
SELECT least(l_suppkey, l_partkey % 10) AS low, greatest(l_suppkey, l_partkey % 10) AS high, l_discount, l_extendedprice, l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_suppkey <> l_partkey % 10 QUALIFY row_number() OVER (PARTITION BY least(l_suppkey, l_partkey % 10), greatest(l_suppkey, l_partkey % 10)
ORDER BY l_discount, l_extendedprice, l_orderkey, l_linenumber, l_partkey) = 1""")
def best_edge(spark, sf):
    b = F.col("l_partkey") % 10
    rows = table(spark, sf, "lineitem").where(F.col("l_suppkey") != b).select(
        F.least("l_suppkey", b).alias("low"), F.greatest("l_suppkey", b).alias("high"),
        "l_discount", "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    return ranking.best_per_group(rows, ["low", "high"], list(map(F.col, rows.columns[2:])))


# --- full chain from rendered structure and error files ---------------------------------------------------------

def _parsed(spark, sf):
    return SF.parsed_fragments(V.requests(spark, sf))


def _tables(spark, sf):
    return SF.feature_tables(V.requests(spark, sf), 10.0, 8.0)


def _graph(spark, sf):
    t = _tables(spark, sf)
    lengths = V.sequences(spark, sf).select("entry_id", F.length("sequence").alias("sequence_length"))
    return GT.graph_tables(t["residues"], t["edges"], lengths)


def _with(body: str, graph: bool = False) -> str:
    return f"WITH {V.GRAPH_CTE if graph else V.STRUCT_CTE} {body}"


@query("pdb_parse", _with("SELECT model_entity_id, CAST(i AS INTEGER) AS residue_index, 'A' AS chain_id, CAST(i AS INTEGER) AS residue_number, aa AS residue_name1, x, y, z, plddt FROM res"))
def pdb_parse(spark, sf):
    files = V.fragment_source(spark, sf).select("model_entity_id", V.pdb_text(F.col("rs")).alias("value"))
    return ST.parse_structures(files).select("model_entity_id", F.inline("residues")) \
        .select("model_entity_id", "residue_index", "chain_id", "residue_number", "residue_name1", "x", "y", "z", "plddt")


@query("pae_summary", _with("SELECT model_entity_id, round(avg(v), 6) AS pae_mean, round(quantile_cont(v, 0.5), 6) AS pae_median, round(quantile_cont(v, 0.9), 6) AS pae_p90, max(v) AS pae_max FROM pae GROUP BY 1"))
def pae_summary(spark, sf):
    rs = F.col("rs")
    built = fn.once(V.fragment_source(spark, sf), m=V.pae_matrix(rs))
    texts = fn.once(built, t=V.pae_text(F.col("m"), F.col("vec_id")))
    parsed = fn.once(texts, matrix=ST.error_matrix(F.col("t")))
    return rounded(fn.once(parsed, p=FR.matrix_summary(F.col("matrix"))).select("model_entity_id", "p.*"))


@query("alignment_status", _with("""SELECT entry_id, model_entity_id, max(status) AS alignment_status, min(pos) AS coverage_start, max(pos) AS coverage_end, count(*) AS residues FROM res GROUP BY 1, 2"""))
def alignment_status(spark, sf):
    return SF.residue_rows(_parsed(spark, sf)).groupBy("entry_id", "model_entity_id").agg(
        F.max("alignment_status").alias("alignment_status"), F.min("seq_position").alias("coverage_start"),
        F.max("seq_position").alias("coverage_end"), F.count("*").alias("residues"))


@query("residue_features", _with("""SELECT res.entry_id, res.taxonomy_id, res.model_entity_id, CAST(res.i AS INTEGER) AS residue_index, CAST(pos AS INTEGER) AS seq_position, aa AS residue_name1,
  plddt, CASE WHEN plddt < 50 THEN 'very_low' WHEN plddt < 70 THEN 'low' WHEN plddt < 90 THEN 'confident' ELSE 'very_high' END AS plddt_bin,
  round(pm, 6) AS pae_row_mean, pmin AS pae_row_min, round(p90, 6) AS pae_row_p90, coalesce(d, 0) AS contact_degree, coalesce(s, 0) AS strict_contact_degree,
  round(res.i / 21.0, 6) AS sequence_position_fraction, status AS alignment_status
  FROM res JOIN paerow ON paerow.vec_id = res.vec_id AND paerow.i = res.i LEFT JOIN deg ON deg.vec_id = res.vec_id AND deg.i = res.i"""))
def residue_features(spark, sf):
    return rounded(_tables(spark, sf)["residues"].select(
        "entry_id", "taxonomy_id", "model_entity_id", "residue_index", "seq_position", "residue_name1", "plddt", "plddt_bin", "pae_row_mean",
        "pae_row_min", "pae_row_p90", "contact_degree", "strict_contact_degree", "sequence_position_fraction", "alignment_status"))


@query("edge_features", _with("""SELECT entry_id, model_entity_id, CAST(i AS INTEGER) AS source_residue_index, CAST(j AS INTEGER) AS target_residue_index, CAST(pi AS INTEGER) AS source_seq_position,
  CAST(pj AS INTEGER) AS target_seq_position, round(dist, 6) AS distance_ca, CAST(j - i AS INTEGER) AS seq_separation, lr AS pae_lr, rl AS pae_rl, round(pp, 6) AS pae_mean_pair,
  j - i = 1 AS is_sequential_neighbor, j - i <= 5 AS is_short_range_sequence, dist <= 8.0 AS is_strict_contact FROM edgep"""))
def edge_features(spark, sf):
    return rounded(_tables(spark, sf)["edges"].drop("taxonomy_id"))


@query("fragment_features", _with("""
SELECT r.entry_id, r.model_entity_id, count(*) AS residue_count, CAST(min(pos) AS INTEGER) AS coverage_start, CAST(max(pos) AS INTEGER) AS coverage_end, max(status) AS alignment_status,
  round(avg(plddt), 6) AS mean_plddt, round(quantile_cont(plddt, 0.5), 6) AS median_plddt, round(avg((plddt < 50)::INT), 6) AS fraction_plddt_very_low,
  round(avg((plddt >= 90)::INT), 6) AS fraction_plddt_very_high, round(avg(coalesce(d, 0)), 6) AS mean_contact_degree, max(coalesce(d, 0)) AS max_contact_degree,
  CAST(sum(coalesce(d, 0)) / 2 AS BIGINT) AS contact_edge_count, CAST(sum(coalesce(s, 0)) / 2 AS BIGINT) AS strict_contact_edge_count,
  round(sum(coalesce(d, 0)) / 2 / 210.0, 6) AS contact_density, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS radius_of_gyration,
  round(max(pm), 6) AS pae_mean, round(max(p90), 6) AS pae_p90, max(pmax) AS pae_max
FROM res r LEFT JOIN deg ON deg.vec_id = r.vec_id AND deg.i = r.i
JOIN (SELECT vec_id, avg(v) AS pm, quantile_cont(v, 0.9) AS p90, max(v) AS pmax FROM pae GROUP BY 1) p ON p.vec_id = r.vec_id GROUP BY 1, 2"""))
def fragment_features(spark, sf):
    return rounded(_tables(spark, sf)["fragments"].select(
        "entry_id", "model_entity_id", "residue_count", "coverage_start", "coverage_end", "alignment_status", "mean_plddt", "median_plddt",
        "fraction_plddt_very_low", "fraction_plddt_very_high", "mean_contact_degree", "max_contact_degree", "contact_edge_count",
        "strict_contact_edge_count", "contact_density", "radius_of_gyration", "pae_mean", "pae_p90", "pae_max"))


@query("edge_type_counts", _with("""SELECT entry_id, model_entity_id, count(*) FILTER (WHERE dist <= 8.0) AS strict_edges, count(*) FILTER (WHERE j - i = 1) AS sequential_edges,
  count(*) AS all_edges FROM edge GROUP BY 1, 2"""))
def edge_type_counts(spark, sf):
    return K.edge_type_counts(_tables(spark, sf)["edges"], ["entry_id", "model_entity_id"])


@query("strongest_edge_type", _with("""SELECT entry_id, CAST(least(pi, pj) AS INTEGER) AS low, CAST(greatest(pi, pj) AS INTEGER) AS high, CAST(max(CASE WHEN dist <= 8.0 THEN 2 ELSE 1 END) AS INTEGER) AS edge_type
  FROM edge WHERE pi IS NOT NULL AND pj IS NOT NULL GROUP BY 1, 2, 3"""))
def strongest_edge_type(spark, sf):
    edges = _tables(spark, sf)["edges"].where("source_seq_position IS NOT NULL AND target_seq_position IS NOT NULL")
    return K.strongest_edge_type(edges, ["entry_id"], ("source_seq_position", "target_seq_position"))


@query("graph_nodes", _with("""SELECT entry_id, CAST(node AS INTEGER) AS node, CAST(fragment AS INTEGER) AS fragment, model_entity_id, CAST(pos AS INTEGER) AS seq_position, CAST(i AS INTEGER) AS residue_index,
  x, y, z, plddt, d AS contact_degree, s AS strict_contact_degree FROM gnode""", True))
def graph_nodes(spark, sf):
    return _graph(spark, sf)["nodes"].select("entry_id", "node", "fragment", "model_entity_id", "seq_position", "residue_index", "x", "y", "z",
                                             "plddt", "contact_degree", "strict_contact_degree")


@query("graph_edges", _with("""SELECT entry_id, CAST(a AS INTEGER) AS source, CAST(b AS INTEGER) AS target, model_entity_id, round(dist::FLOAT::DOUBLE, 4) AS distance, (j - i)::DOUBLE AS separation, round(pp::FLOAT::DOUBLE, 4) AS pae
  FROM (SELECT *, na AS a, nb AS b FROM best UNION ALL SELECT *, nb, na FROM best)""", True))
def graph_edges(spark, sf):
    e = _graph(spark, sf)["edges"]
    return e.select("entry_id", "source", "target", "model_entity_id", *[
        F.round(F.get("edge_attr", i).cast("double"), 4).alias(n) for i, n in enumerate(("distance", "separation", "pae"))])


_SUMMARY = """sm AS (SELECT g.entry_id, count(*)::DOUBLE AS v0, count(DISTINCT fragment)::DOUBLE AS v1, avg(plddt) AS v2, quantile_cont(plddt, 0.5) AS v3, avg((plddt < 50)::INT) AS v4,
  avg((plddt >= 50 AND plddt < 70)::INT) AS v5, avg((plddt >= 70 AND plddt < 90)::INT) AS v6, avg((plddt >= 90)::INT) AS v7, avg(d) AS v8,
  sum(d) / 2 / (count(*) * (count(*) - 1) / 2.0) AS v9, avg(pm) AS v10, quantile_cont(p90, 0.9) AS v11, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS v12 FROM gnode g GROUP BY 1)"""


@query("graph_summary", f"WITH {V.GRAPH_CTE}, {_SUMMARY} SELECT entry_id, {', '.join(f'round(v{i}, 5) AS v{i}' for i in range(13))} FROM sm")
def graph_summary(spark, sf):
    s = _graph(spark, sf)["summary"]
    return s.select("entry_id", *[F.round(F.get("graph_feat", i), 5).alias(f"v{i}") for i in range(C.SUMMARY_WIDTH)])


@query("graph_summary_normalised", f"WITH {V.GRAPH_CTE}, {_SUMMARY}" + """ SELECT entry_id, round(ln(1 + v0) / ln(1201.0), 4) AS n0, round(ln(1 + v1) / ln(11.0), 4) AS n1, round(least(v2 / 100, 1), 4) AS n2,
  round(v4, 4) AS n4, round(least(ln(1 + v8) / ln(65.0), 5), 4) AS n8, round(v9, 4) AS n9, round(least(v10 / 30, 10), 4) AS n10, round(least(v12 / 100, 10), 4) AS n12 FROM sm""")
def graph_summary_normalised(spark, sf):
    s = GT.normalised(_graph(spark, sf))["summary"]
    return s.select("entry_id", *[F.round(F.get("graph_feat", i).cast("double"), 4).alias(f"n{i}") for i in (0, 1, 2, 4, 8, 9, 10, 12)])


@query("node_vectors", f"WITH {V.GRAPH_CTE}" + f""" SELECT g.entry_id, CAST(node AS INTEGER) AS node, CAST(strpos('{C.RESIDUE_LETTERS}', aa) - 1 AS INTEGER) AS letter_slot, round(plddt::FLOAT::DOUBLE, 4) AS v21,
  (plddt < 50)::INT::DOUBLE AS v22, (plddt >= 90)::INT::DOUBLE AS v25, round(pm::FLOAT::DOUBLE, 4) AS v26, d::DOUBLE AS v29, s::DOUBLE AS v30, round((pos / len.n::DOUBLE)::FLOAT::DOUBLE, 4) AS v31
  FROM gnode g JOIN len ON len.entry_id = g.entry_id""")
def node_vectors(spark, sf):
    n = _graph(spark, sf)["nodes"]
    slot = (F.array_position(F.slice("base", 1, 21), F.lit(1.0).cast("float")) - 1).cast("int")
    return n.select("entry_id", "node", slot.alias("letter_slot"), *[
        F.round(F.get("base", i).cast("double"), 4).alias(f"v{i}") for i in (21, 22, 25, 26, 29, 30, 31)])


@query("node_vectors_normalised", f"WITH {V.GRAPH_CTE}" + """ SELECT entry_id, CAST(node AS INTEGER) AS node, round(plddt / 100, 4) AS v21, round(pm / 30, 4) AS v26,
  round(least(ln(1 + d) / ln(65.0), 5), 4) AS v29 FROM gnode""")
def node_vectors_normalised(spark, sf):
    n = GT.normalised(_graph(spark, sf))["nodes"]
    return n.select("entry_id", "node", *[F.round(F.get("base", i).cast("double"), 4).alias(f"v{i}") for i in (21, 26, 29)])


_UNRESOLVED = _with("SELECT entry_id, 'no resolved residue positions' AS error FROM res GROUP BY entry_id HAVING count(CASE WHEN (vec_id // 2) % 9 <> 0 THEN pos END) = 0")


@query("unresolved_entries", _UNRESOLVED)
@query("unresolved_entries_all", _UNRESOLVED)
def unresolved_entries(spark, sf):
    """Placing all fragments: every ninth entry has structures without atoms and gets no residue."""
    empty = F.floor(F.col("vec_id") / 2) % 9 == 0
    requests = V.requests(spark, sf).withColumn("pdb_text", F.when(empty, "END").otherwise(F.col("pdb_text")))
    return G.unresolved_entries(V.sequences(spark, sf), G.resolved(SF.residue_rows(SF.parsed_fragments(requests))))


@query("shape_failures", """
SELECT 'P' || lpad(CAST(vec_id // 2 AS VARCHAR), 8, '0') AS entry_id, 'P' || lpad(CAST(vec_id // 2 AS VARCHAR), 8, '0') || '-F' || CAST(vec_id % 2 + 1 AS VARCHAR) AS model_entity_id,
  'parse_error' AS status, CASE vec_id % 11 WHEN 0 THEN 'structure-error matrix is missing' WHEN 1 THEN 'structure-error matrix does not match the residue count' ELSE 'no CA atoms' END AS error
FROM embeddings WHERE vec_id % 11 < 3""")
def shape_failures(spark, sf):
    m = F.col("vec_id") % 11
    broken = V.requests(spark, sf).withColumn("pae_text", F.when(m == 0, "{bad json").when(m == 1, '{"pae": [[0.5]]}').otherwise(F.col("pae_text"))) \
        .withColumn("pdb_text", F.when(m == 2, "END").otherwise(F.col("pdb_text")))
    return SF.fragment_failures(SF.parsed_fragments(broken)).select("entry_id", "model_entity_id", "status", "error")


# --- secondary structure, areas and overlays --------------------------------------------------------------------

_CODES = ("H", "E", "T", " ")


def _dssp_text(rs):
    codes = F.array(*map(F.lit, _CODES))

    def line(r):
        aa = F.when(r.i % 6 == 0, "!").otherwise(F.substring(F.lit(V.LETTERS), r.a + 1, F.lit(1)))
        head = F.format_string("%5d%5d A %s  %s", r.i, r.i, aa, F.element_at(codes, (F.abs(r.mz) % 4 + 1).cast("int")))
        with_surface = F.concat(F.rpad(head, 34, " "), F.format_string("%4d", F.abs(r.mx) % 200))
        return F.concat(F.rpad(with_surface, 103, " "), F.format_string("%6.1f%6.1f", r.mx % 1800 / 10.0, r.my % 1800 / 10.0))

    return F.array_join(F.concat(F.array(F.lit("==== header"), F.lit("  #  RESIDUE AA STRUCTURE BP1 BP2  ACC")), F.transform(rs, line)), "\n")


def _area_text(rs, vec_id):
    area = F.transform(rs, lambda r: F.abs(r.my) % 500 / 10.0)
    number = F.transform(rs, lambda r: r.i.cast("string"))
    keyed = F.map_from_arrays(number, F.transform(area, lambda a: F.struct(F.struct(a.alias("total")).alias("area"))))
    listed = F.transform(F.arrays_zip(number.alias("number"), area.alias("area")), lambda z: F.struct(z.number.alias("number"), z.area.alias("area")))
    as_dict = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.create_map(F.lit("A"), F.struct(keyed.alias("residues"))).alias("chains"))).alias("structures"))).alias("results")))
    as_list = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.lit("A").alias("label"), listed.alias("residues"))).alias("chains"))).alias("structures")))
    return F.when(vec_id % 2 == 0, as_dict).otherwise(as_list)


def _dssp(spark, sf):
    files = V.fragment_source(spark, sf).where("vec_id % 4 <> 3").select("model_entity_id", _dssp_text(F.col("rs")).alias("value"))
    return ST.parse_dssp(files, ["model_entity_id"])


def _areas(spark, sf):
    files = V.fragment_source(spark, sf).where("vec_id % 4 <> 2").select("model_entity_id", _area_text(F.col("rs"), F.col("vec_id")).alias("value"))
    return ST.parse_areas(files, ["model_entity_id"])


@query("dssp_parse", _with("""SELECT model_entity_id, 'A' AS chain_id, CAST(i AS INTEGER) AS residue_number, aa, CASE abs(mz) % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'E' WHEN 2 THEN 'T' ELSE '' END AS code,
  (abs(mx) % 200)::DOUBLE AS accessibility, (mx % 1800) / 10.0 AS phi, (my % 1800) / 10.0 AS psi FROM res WHERE i % 6 <> 0 AND vec_id % 4 <> 3"""))
def dssp_parse(spark, sf):
    return _dssp(spark, sf).drop("insertion_code")


@query("area_parse", _with("SELECT model_entity_id, 'A' AS chain_id, CAST(i AS INTEGER) AS residue_number, (abs(my) % 500) / 10.0 AS area FROM res WHERE vec_id % 4 <> 2"))
def area_parse(spark, sf):
    return _areas(spark, sf).drop("insertion_code")


_SURFACE = "CASE aa " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.MAX_SURFACE.items()) + " ELSE 1.0 END"
_STRUCTURE = f"""st AS (SELECT *, i % 6 <> 0 AND vec_id % 4 <> 3 AS dm, vec_id % 4 <> 2 AS am FROM res),
sv AS (SELECT model_entity_id, entry_id, i, dm, am, CASE WHEN dm AND abs(mz) % 4 = 0 THEN 1.0 ELSE 0.0 END AS helix, CASE WHEN dm THEN sin(radians((mx % 1800) / 10.0)) ELSE 0 END AS sphi,
  CASE WHEN dm THEN cos(radians((my % 1800) / 10.0)) ELSE 0 END AS cpsi, CASE WHEN dm THEN (abs(mx) % 200) / {_SURFACE} ELSE 0 END AS rel, CASE WHEN am THEN (abs(my) % 500) / 10.0 ELSE 0 END AS area FROM st)"""


def _structure(spark, sf):
    return SF.structure_features(SF.residue_rows(_parsed(spark, sf)), _dssp(spark, sf), _areas(spark, sf))


@query("structure_features", f"WITH {V.STRUCT_CTE}, {_STRUCTURE}" + """ SELECT model_entity_id, CAST(i AS INTEGER) AS residue_index, dm AS dssp_mask, am AS sasa_mask, round(helix::DOUBLE, 4) AS helix,
  round(sphi, 4) AS sin_phi, round(cpsi, 4) AS cos_psi, round(rel, 4) AS relative, round(area, 4) AS area FROM sv""")
def structure_features(spark, sf):
    at = {"helix": 0, "sin_phi": 3, "cos_psi": 6, "relative": 8, "area": 9}
    return _structure(spark, sf).select("model_entity_id", "residue_index", "dssp_mask", "sasa_mask", *[
        F.round(F.get("features", i).cast("double"), 4).alias(n) for n, i in at.items()])


@query("structure_overlay", f"WITH {V.GRAPH_CTE}, {_STRUCTURE}" + """ SELECT g.entry_id, CAST(node AS INTEGER) AS node, dm AS has_dssp, am AS has_sasa, round(sv.area, 4) AS area
  FROM gnode g JOIN sv ON sv.model_entity_id = g.model_entity_id AND sv.i = g.i""")
def structure_overlay(spark, sf):
    out = G.overlay_structure(_graph(spark, sf)["nodes"], _structure(spark, sf))
    return out.select("entry_id", "node", "has_dssp", "has_sasa", F.round(F.get("structure", 9).cast("double"), 4).alias("area"))


@query("embedding_overlay", f"WITH {V.GRAPH_CTE}" + """ SELECT g.entry_id, CAST(node AS INTEGER) AS node, e.vec_id IS NOT NULL AS has_embedding, round(coalesce(e.embedding[1]::DOUBLE, 0), 6) AS first
  FROM gnode g LEFT JOIN (SELECT 'P' || lpad(CAST(vec_id // 4 AS VARCHAR), 8, '0') AS entry_id, vec_id % 4 + 1 AS pos, vec_id, embedding FROM embeddings) e ON e.entry_id = g.entry_id AND e.pos = g.pos""")
def embedding_overlay(spark, sf):
    emb = table(spark, sf, "embeddings").select(
        F.concat(F.lit("P"), F.lpad(F.floor(F.col("vec_id") / 4).cast("string"), 8, "0")).alias("entry_id"),
        (F.col("vec_id") % 4 + 1).cast("int").alias("seq_position"), F.col("embedding"))
    nodes = _graph(spark, sf)["nodes"]
    out = G.overlay_embedding(nodes, emb, 64)
    return out.select("entry_id", "node", "has_embedding", F.coalesce(r6(F.get("embedding", 0)), fn.d(0)).alias("first"))


@query("graph_pool", f"WITH {V.GRAPH_CTE}, {_SUMMARY}, pm AS (SELECT entry_id, avg(plddt::FLOAT::DOUBLE) AS p, avg(d) AS d FROM gnode GROUP BY 1)" +
       " SELECT pm.entry_id, round(p, 4) AS mean_plddt, round(d, 4) AS mean_degree, round(v0, 4) AS nodes, round(v12, 4) AS gyration, CAST(45 AS INTEGER) AS width FROM pm JOIN sm ON sm.entry_id = pm.entry_id")
def graph_pool(spark, sf):
    g = _graph(spark, sf)
    at = {"mean_plddt": 21, "mean_degree": 29, "nodes": 32, "gyration": 44}
    return G.pooled(g["nodes"], g["summary"]).select("entry_id", *[F.round(F.get("pooled", i), 4).alias(n) for n, i in at.items()], F.size("pooled").alias("width"))


@query("matrix_shapes", "SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0")
def matrix_shapes(spark, sf):
    rs = F.col("rs")
    m = V.pae_matrix(rs)
    rows = V.fragment_source(spark, sf).select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.slice(m, 1, 20)).otherwise(m).alias("m"), F.size(rs).alias("n"))
    return checks.matrix_shapes(rows, "m", "n").select("vec_id")


@query("ontology_penalty", """
WITH p AS (SELECT n_nationkey AS c, n_regionkey AS p FROM nation WHERE n_nationkey <> n_regionkey AND n_nationkey < (SELECT count(DISTINCT label) FROM embeddings)),
m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS w FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2)
SELECT (SELECT count(*) FROM p) AS relation_count, round(0.5 * avg((a.w - b.w) * (a.w - b.w)), 6) AS penalty FROM p JOIN m a ON a.label = p.c JOIN m b ON b.label = p.p AND b.i = a.i""")
def ontology_penalty(spark, sf):
    from protlake.operators.sequences import mean_pool
    vectors = mean_pool(table(spark, sf, "embeddings"), ["label"]).select(F.col("label").alias("term"), F.col("embedding").alias("w"))
    tree = table(spark, sf, "nation").where("n_nationkey <> n_regionkey").select(F.col("n_nationkey").alias("child"), F.col("n_regionkey").alias("parent"))
    return rounded(G.ontology_penalty(tree, vectors, 0.5))
