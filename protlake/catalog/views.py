"""The given tables seen as annotation, score and structure tables: Spark views and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from protlake import constants as C
from protlake.catalog.registry import table
from protlake.functions import scalar as fn

# --- labels: order = entry, brand and size of the part = term, size decides the aspect -----------------------


def aspect_of(number: Column) -> Column:
    return F.when(number % 3 == 0, "BPO").when(number % 3 == 1, "CCO").otherwise("MFO")


ASPECT_SQL = "CASE {0} % 3 WHEN 0 THEN 'BPO' WHEN 1 THEN 'CCO' ELSE 'MFO' END"


def labels(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws("-", "p_brand", "p_size").alias("term"),
                                           aspect_of(F.col("p_size")).alias("aspect"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("entry_id"), "l_partkey") \
        .join(part, F.col("l_partkey") == F.col("p_partkey")).select("entry_id", "term", "aspect")


LAB = f"""lab AS (SELECT CAST(l_orderkey AS VARCHAR) AS entry_id, p_brand || '-' || CAST(p_size AS VARCHAR) AS term,
  {ASPECT_SQL.format('p_size')} AS aspect FROM lineitem JOIN part ON l_partkey = p_partkey)"""
CNT = "cnt AS (SELECT aspect, term, count(*) AS n FROM lab GROUP BY aspect, term)"


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is an entry; its line count is the residue count, its distinct parts the fragments."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_linenumber").cast("int").alias("residue_count"), F.count_distinct("l_suppkey").cast("int").alias("fragment_count"))
    return table(spark, sf, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left") \
        .select(F.col("o_orderkey").cast("string").alias("entry_id"), "residue_count", "fragment_count")


ENT = """ent AS (SELECT CAST(o_orderkey AS VARCHAR) AS entry_id, residue_count, fragment_count FROM orders LEFT JOIN
  (SELECT l_orderkey, CAST(sum(l_linenumber) AS INTEGER) AS residue_count,
          CAST(count(DISTINCT l_suppkey) AS INTEGER) AS fragment_count FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""

# --- scores: order = entry, supplier = term, arithmetic scores, returned lines are positives ------------------


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    first = ((F.col("l_orderkey") * 31 + F.col("l_partkey") * 17) % 1000).cast("double") / 1000.0
    second = ((F.col("l_orderkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber") * 101) % 1000).cast("double") / 1000.0
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        (F.max(first) * 0.6 + F.when(F.bool_or(F.col("l_returnflag") == "R"), 0.35).otherwise(0.0)).cast("float").alias("score"), F.max(second).cast("float").alias("second_score"),
        F.bool_or(F.col("l_returnflag") == "R").alias("y")).select(
        F.col("l_orderkey").cast("string").alias("entry_id"), F.col("l_suppkey").cast("string").alias("term"),
        aspect_of(F.col("l_suppkey")).alias("aspect"), "score", "second_score", "y")


PAIRS = f"""pairs AS (SELECT CAST(l_orderkey AS VARCHAR) AS entry_id, CAST(l_suppkey AS VARCHAR) AS term,
  {ASPECT_SQL.format('l_suppkey')} AS aspect,
  CAST(max(CAST((l_orderkey * 31 + l_partkey * 17) % 1000 AS DOUBLE) / 1000.0) * 0.6::DOUBLE + CASE WHEN bool_or(l_returnflag = 'R') THEN 0.35::DOUBLE ELSE 0.0::DOUBLE END AS FLOAT) AS score,
  CAST(max(CAST((l_orderkey * 7 + l_suppkey * 13 + l_linenumber * 101) % 1000 AS DOUBLE) / 1000.0) AS FLOAT) AS second_score,
  bool_or(l_returnflag = 'R') AS y FROM lineitem GROUP BY l_orderkey, l_suppkey)"""


def terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier is a term, also those without a row; ia weight from its key."""
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("term"), aspect_of(F.col("s_suppkey")).alias("aspect"),
        (F.col("s_suppkey") % 7 / 7.0).cast("double").alias("ia"))


TERMS = f"""terms AS (SELECT CAST(s_suppkey AS VARCHAR) AS term, {ASPECT_SQL.format('s_suppkey')} AS aspect,
  CAST(s_suppkey % 7 AS DOUBLE) / 7.0 AS ia FROM supplier)"""

# --- structures: each embedding becomes one fragment of 21 residues; two fragments overlap in one entry -------

RESIDUES = 21
LETTERS = C.RESIDUE_LETTERS[:20]
NAMES = [next(n for n, a in C.RESIDUE_NAME3.items() if a == letter) for letter in LETTERS]


def _milli(k: Column | int) -> Column:
    """k-th embedding element (from 1) in thousandths of the coordinate unit."""
    return F.round(F.element_at("embedding", k).cast("double") * 30000.0).cast("bigint")


def _residue(i: Column) -> Column:
    k = i * 3
    x, y, z = _milli(k - 2), _milli(k - 1), _milli(k)
    return F.struct(
        i.alias("i"), (F.abs(x) % 20).cast("int").alias("a"), x.alias("mx"), y.alias("my"), z.alias("mz"),
        (x / 1000.0).alias("x"), (y / 1000.0).alias("y"), (z / 1000.0).alias("z"),
        (30.0 + F.abs(y) % 7000 / 100.0).cast("double").alias("plddt"))


def fragment_source(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, entry_id, model_entity_id, taxonomy_id, f, rs ARRAY of residues)."""
    entry = F.concat(F.lit("P"), F.lpad((F.floor(F.col("vec_id") / 2)).cast("string"), 8, "0"))
    # rendering and parsing are heavy per row, so the rows of the one small file are spread first
    base = table(spark, sf, "embeddings").repartition(spark.sparkContext.defaultParallelism, "vec_id").select("vec_id", entry.alias("entry_id"), (F.col("vec_id") % 2 + 1).alias("f"), "embedding", "label")
    return fn.once(base, rs=F.transform(F.sequence(F.lit(1), F.lit(RESIDUES)), _residue)).select(
        "*", F.concat("entry_id", F.lit("-F"), F.col("f").cast("string")).alias("model_entity_id"),
        (F.floor(F.col("vec_id") / 2) % 10).cast("string").alias("taxonomy_id"))


def _letters(rs: Column) -> Column:
    return F.array_join(F.transform(rs, lambda r: F.substring(F.lit(LETTERS), r.a + 1, F.lit(1))), "")


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """(entry_id, taxonomy_id, sequence): first fragment, then the part of the second beyond the overlap."""
    letters = fragment_source(spark, sf).select("entry_id", "taxonomy_id", "f", _letters(F.col("rs")).alias("s"))
    return letters.groupBy("entry_id", "taxonomy_id").agg(
        F.max(F.when(F.col("f") == 1, F.col("s"))).alias("a"), F.max(F.when(F.col("f") == 2, F.col("s"))).alias("b")) \
        .select("entry_id", "taxonomy_id", F.concat(F.coalesce("a", F.lit("")), F.substring(F.coalesce("b", F.lit("")), 12, 10)).alias("sequence"))


def pae_matrix(rs: Column) -> Column:
    return F.transform(rs, lambda p: F.transform(rs, lambda q: F.when(p.i == q.i, F.lit(0.0)).otherwise(
        (F.abs(p.mz - q.mz) % 3000 + F.when(p.i < q.i, 0).otherwise(7)) / 100.0)))


def pae_text(matrix: Column, vec_id: Column) -> Column:
    """JSON under either key, for every third fragment inside a list."""
    plain = F.to_json(F.struct(matrix.alias("predicted_aligned_error")))
    short = F.to_json(F.struct(matrix.alias("pae")))
    return F.when(vec_id % 3 == 0, F.concat(F.lit("["), plain, F.lit("]"))).when(vec_id % 3 == 1, short).otherwise(plain)


def pdb_text(rs: Column) -> Column:
    """Fixed-width ATOM lines: a nitrogen and a C-alpha per residue."""
    names = F.expr("array(" + ", ".join(f"'{n}'" for n in NAMES) + ")")

    def line(r: Column, atom: str, step: int) -> Column:
        return F.format_string(f"ATOM  %5d {atom} %3s A%4d    %8.3f%8.3f%8.3f%6.2f%6.2f", r.i * 2 + step,
                               F.element_at(names, r.a + 1), r.i, r.x, r.y, r.z, F.lit(1.0), r.plddt)

    atoms = F.flatten(F.transform(rs, lambda r: F.array(line(r, " N  ", -1), line(r, " CA ", 0))))
    return F.array_join(F.concat(F.array(F.lit("HEADER")), atoms, F.array(F.lit("TER"), F.lit("END"))), "\n")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """Fragments with their texts and declared ranges, some of them wrong."""
    first, vec = F.col("f") == 1, F.col("vec_id")
    start = F.when(first & (vec % 7 == 0), 3).when(first, 1).otherwise(11)
    end = F.when(first & (vec % 7 == 0), 23).when(first, 21).when(vec % 5 == 0, 30).otherwise(31)
    frags = fn.once(fragment_source(spark, sf), m=pae_matrix(F.col("rs"))).select(
        "vec_id", "entry_id", "model_entity_id", start.alias("sequence_start"), end.alias("sequence_end"),
        pdb_text(F.col("rs")).alias("pdb_text"), pae_text(F.col("m"), vec).alias("pae_text"))
    return frags.join(sequences(spark, sf), "entry_id")


STRUCT_CTE = f"""frag AS (SELECT vec_id, embedding, 'P' || lpad(CAST(vec_id // 2 AS VARCHAR), 8, '0') AS entry_id,
  vec_id % 2 + 1 AS f, CAST((vec_id // 2) % 10 AS VARCHAR) AS taxonomy_id, label FROM embeddings),
raw AS (SELECT vec_id, entry_id, taxonomy_id, entry_id || '-F' || CAST(f AS VARCHAR) AS model_entity_id, f, i,
  CAST(round(CAST(embedding[i * 3 - 2] AS DOUBLE) * 30000.0) AS BIGINT) AS mx,
  CAST(round(CAST(embedding[i * 3 - 1] AS DOUBLE) * 30000.0) AS BIGINT) AS my,
  CAST(round(CAST(embedding[i * 3] AS DOUBLE) * 30000.0) AS BIGINT) AS mz
  FROM frag, (SELECT unnest(generate_series(1, {RESIDUES})) AS i)),
res AS (SELECT *, mx / 1000.0 AS x, my / 1000.0 AS y, mz / 1000.0 AS z, 30.0 + (abs(my) % 7000) / 100.0 AS plddt,
  substr('{LETTERS}', CAST(abs(mx) % 20 + 1 AS INTEGER), 1) AS aa,
  CASE WHEN f = 1 THEN i WHEN vec_id % 5 = 0 THEN NULL ELSE i + 10 END AS pos,
  CASE WHEN f = 1 AND vec_id % 7 = 0 THEN 'substring_match' WHEN f = 1 THEN 'exact_fragment_match'
       WHEN vec_id % 5 = 0 THEN 'unresolved' ELSE 'range_length_match' END AS status FROM raw),
pae AS (SELECT p.vec_id, p.entry_id, p.model_entity_id, p.i, q.i AS j,
  CASE WHEN p.i = q.i THEN 0.0 ELSE (abs(p.mz - q.mz) % 3000 + CASE WHEN p.i < q.i THEN 0 ELSE 7 END) / 100.0 END AS v
  FROM raw p JOIN raw q ON p.vec_id = q.vec_id),
paerow AS (SELECT vec_id, i, avg(v) AS pm, min(v) AS pmin, quantile_cont(v, 0.9) AS p90 FROM pae GROUP BY 1, 2),
edge AS (SELECT * FROM (SELECT a.vec_id, a.entry_id, a.model_entity_id, a.i AS i, b.i AS j, a.pos AS pi, b.pos AS pj,
  sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS dist
  FROM res a JOIN res b ON a.vec_id = b.vec_id AND a.i < b.i) WHERE dist <= 10.0),
edgep AS (SELECT e.*, l.v AS lr, r.v AS rl, (l.v + r.v) / 2.0 AS pp FROM edge e
  JOIN pae l ON l.vec_id = e.vec_id AND l.i = e.i AND l.j = e.j
  JOIN pae r ON r.vec_id = e.vec_id AND r.i = e.j AND r.j = e.i),
deg AS (SELECT vec_id, i, count(*) AS d, count(*) FILTER (WHERE dist <= 8.0) AS s FROM
  (SELECT vec_id, i, dist FROM edge UNION ALL SELECT vec_id, j, dist FROM edge) GROUP BY 1, 2)"""

GRAPH_CTE = STRUCT_CTE + """,
sel AS (SELECT * FROM (SELECT r.*, p.pm, p.pmin, p.p90, row_number() OVER (PARTITION BY entry_id, pos
    ORDER BY plddt DESC, p.pm, model_entity_id, r.i) AS rn FROM res r JOIN paerow p ON p.vec_id = r.vec_id AND p.i = r.i
    WHERE pos > 0) WHERE rn = 1),
node AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY pos) - 1 AS node,
    dense_rank() OVER (PARTITION BY entry_id ORDER BY model_entity_id) - 1 AS fragment FROM sel),
surv AS (SELECT e.*, a.node AS na, b.node AS nb FROM edgep e
    JOIN node a ON a.vec_id = e.vec_id AND a.i = e.i AND a.pos = e.pi
    JOIN node b ON b.vec_id = e.vec_id AND b.i = e.j AND b.pos = e.pj WHERE e.pi <> e.pj),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, least(pi, pj), greatest(pi, pj)
    ORDER BY pp, dist, model_entity_id, i, j) AS rn FROM surv) WHERE rn = 1),
gdeg AS (SELECT entry_id, node, count(*) AS d, count(*) FILTER (WHERE dist <= 8.0) AS s FROM
    (SELECT entry_id, na AS node, dist FROM best UNION ALL SELECT entry_id, nb, dist FROM best) GROUP BY 1, 2),
gnode AS (SELECT n.*, coalesce(g.d, 0) AS d, coalesce(g.s, 0) AS s FROM node n LEFT JOIN gdeg g
    ON g.entry_id = n.entry_id AND g.node = n.node),
len AS (SELECT entry_id, max(CASE f WHEN 1 THEN 21 ELSE 0 END) + max(CASE f WHEN 2 THEN 10 ELSE 0 END) AS n
    FROM frag GROUP BY 1)"""
