"""Structure files: coordinates, structure-error JSON, secondary structure, residue areas, metadata.

One row per file; lines become array elements, so a file never leaves its row while it is parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from protlake import schemas
from protlake.functions import scalar as fn


def read_files(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """(path, value): whole text files; with ``nested`` those in all folders below the path as well."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=nested).select(F.expr("_metadata.file_path").alias("path"), "value")


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def _cut(line: Column, start: int, end: int) -> Column:
    """Fixed-width slice, zero-based and half-open."""
    return F.substring(line, start + 1, end - start)


def _number(line: Column, start: int, end: int, kind: str = "double") -> Column:
    return F.trim(_cut(line, start, end)).try_cast(kind)


def ca_residues(text: Column) -> Column:
    """ARRAY of C-alpha residues in file order with a running index from 1."""
    atoms = F.filter(_lines(text), lambda s: s.startswith("ATOM") & (F.trim(_cut(s, 12, 16)) == "CA"))

    def residue(line: Column, i: Column) -> Column:
        name = F.coalesce(F.nullif(F.upper(F.trim(_cut(line, 17, 20))), F.lit("")), F.lit("UNK"))
        return F.struct(
            (i + 1).alias("residue_index"),
            chain_or_default(_cut(line, 21, 22)).alias("chain_id"),
            _number(line, 22, 26, "int").alias("residue_number"),
            F.trim(_cut(line, 26, 27)).alias("insertion_code"),
            name.alias("residue_name3"), fn.residue_letter(name).alias("residue_name1"),
            _number(line, 30, 38).alias("x"), _number(line, 38, 46).alias("y"), _number(line, 46, 54).alias("z"),
            _number(line, 60, 66).alias("plddt"))

    return F.transform(atoms, residue)


def parse_structures(files: DataFrame, text: str = "value", **more: Column) -> DataFrame:
    """Adds ``residues`` and ``pdb_error``: no C-alpha atom, or a number that cannot be read."""
    out = fn.once(files, residues=ca_residues(F.col(text)), **more)
    broken = F.exists("residues", lambda r: r.residue_number.isNull() | r.x.isNull() | r.y.isNull() | r.z.isNull() | r.plddt.isNull())
    return out.withColumn("pdb_error", F.when(F.col("residues").isNull() | (F.size("residues") == 0), "no CA atoms")
                          .when(broken, "unreadable number in an ATOM line"))


_ERROR_OBJECT = "predicted_aligned_error ARRAY<ARRAY<DOUBLE>>, pae ARRAY<ARRAY<DOUBLE>>"


def error_matrix(text: Column) -> Column:
    """N x N matrix from either key, bare or inside a list; NULL when absent, empty or not JSON."""
    listed = F.from_json(text, f"ARRAY<STRUCT<{_ERROR_OBJECT.replace(' ARRAY', ': ARRAY')}>>")
    single = F.from_json(text, _ERROR_OBJECT)
    obj = F.when(F.ltrim(text).startswith("["), F.try_element_at(listed, F.lit(1))).otherwise(single)
    first = F.when(F.size(obj.predicted_aligned_error) > 0, obj.predicted_aligned_error)
    return F.coalesce(first, F.when(F.size(obj.pae) > 0, obj.pae))


def parse_metadata(files: DataFrame, entry: Column, text: str = "value") -> DataFrame:
    """(entry_id, metadata_path, rec_ord, record): one row per record of the metadata array."""
    records = F.from_json(text, f"ARRAY<{schemas.METADATA_RECORD}>")
    return files.select(entry.alias("entry_id"), F.col("path").alias("metadata_path"), F.posexplode(records).alias("rec_ord", "record"))


def chain_or_default(chain: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(chain), F.lit("")), F.lit("A"))


def parse_dssp(files: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """(keys…, chain_id, residue_number, insertion_code, aa, code, accessibility, phi, psi); last duplicate wins.

    Lines count after the column header; short lines, blanks and chain breaks are skipped.
    """
    lines = F.col("__lines")
    header = F.array_position(F.transform(lines, lambda s: s.startswith("  #  RESIDUE AA STRUCTURE")), True)
    body = F.when(header > 0, F.slice(lines, (header + 1).cast("int"), F.size(lines)))
    flat = files.withColumn("__lines", _lines(F.col(text))).select(*keys, F.posexplode(body).alias("__pos", "line"))
    s = F.col("line")
    aa = F.trim(_cut(s, 13, 14))

    def value(start: int, end: int, kind: str = "double") -> Column:
        return F.coalesce(_number(s, start, end, kind), F.lit(0).cast(kind))

    rows = flat.where((F.length(s) >= 115) & (aa != "") & (aa != "!")).select(
        *keys, "__pos", chain_or_default(_cut(s, 11, 12)).alias("chain_id"), value(5, 10, "int").alias("residue_number"),
        F.trim(_cut(s, 10, 11)).alias("insertion_code"),
        F.struct(F.upper(aa).alias("aa"), F.trim(_cut(s, 16, 17)).alias("code"), value(34, 38).alias("accessibility"),
                 value(103, 109).alias("phi"), value(109, 115).alias("psi")).alias("f"))
    at = [*keys, "chain_id", "residue_number", "insertion_code"]
    return rows.groupBy(*at).agg(F.max_by("f", "__pos").alias("f")).select(*at, "f.*")


def _items(parent: Column, key: str) -> Column:
    """Children of a JSON member that is either a list or a dict: ARRAY<STRUCT<name, item VARIANT>>."""
    listed = F.try_variant_get(parent, f"$.{key}", "array<variant>")
    named = F.try_variant_get(parent, f"$.{key}", "map<string,variant>")
    return F.coalesce(
        F.transform(listed, lambda v: F.struct(F.lit(None).cast("string").alias("name"), v.alias("item"))),
        F.transform(F.map_entries(named), lambda e: F.struct(e.key.alias("name"), e.value.alias("item"))))


def _text(item: Column, key: str) -> Column:
    return F.try_variant_get(item, f"$.{key}", "string")


def parse_areas(files: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """(keys…, chain_id, residue_number, insertion_code, area) from residue-area JSON; last duplicate wins.

    Chains and residues may be lists or dicts; an area is a number or ``{total}``.
    """
    doc = files.withColumn("__v", F.try_parse_json(text))
    results = F.try_variant_get("__v", "$.results", "array<variant>")
    roots = doc.select(*keys, F.explode(F.when(F.size(results) > 0, results).otherwise(F.array("__v"))).alias("__r"))
    structures = roots.select(*keys, F.explode(F.try_variant_get("__r", "$.structures", "array<variant>")).alias("__s"))
    chains = structures.select(*keys, F.posexplode(_items(F.col("__s"), "chains")).alias("__cp", "__c"))
    own = F.coalesce(F.nullif(_text(F.col("__c.item"), "label"), F.lit("")), F.nullif(F.col("__c.name"), F.lit("")), _text(F.col("__c.item"), "chain"))
    residues = chains.select(*keys, "__cp", chain_or_default(own).alias("chain_id"),
                             F.posexplode(_items(F.col("__c.item"), "residues")).alias("__rp", "__r"))
    item = F.col("__r.item")
    number, code = fn.residue_number_parts(F.coalesce(_text(item, "number"), F.col("__r.name")))
    area = F.coalesce(F.try_variant_get(item, "$.area.total", "double"), F.try_variant_get(item, "$.area", "double"), fn.d(0))
    at = [*keys, "chain_id", "residue_number", "insertion_code"]
    flat = residues.select(*keys, "chain_id", number.alias("residue_number"), code.alias("insertion_code"),
                           area.alias("area"), F.struct("__cp", "__rp").alias("__o"))
    return flat.groupBy(*at).agg(F.max_by("area", "__o").alias("area"))


def residue_string(residues: Column) -> Column:
    return F.array_join(F.transform(residues, lambda r: r.residue_name1), "")


def alignment_status(letters: Column, sequence: Column, start: Column, end: Column) -> Column:
    """How a fragment is placed. Tried in order: the declared range spells the residues, the whole sequence does,
    the first occurrence, equal length only."""
    first, last = fn.or_default(start, 1), F.coalesce(end, F.lit(0))
    span = F.greatest(last - first + 1, F.lit(0))
    return (F.when(letters == F.substring(sequence, first, span), "exact_fragment_match")
            .when(letters == sequence, "exact_full_match").when(F.instr(sequence, letters) > 0, "substring_match")
            .when(F.length(letters) == span, "range_length_match").otherwise("unresolved"))


def alignment_offset(status: Column, letters: Column, sequence: Column, start: Column) -> Column:
    """Position of a residue in the full sequence is residue_index + offset; NULL when unresolved."""
    return (F.when(status.isin("exact_fragment_match", "range_length_match"), fn.or_default(start, 1) - 1)
            .when(status == "exact_full_match", F.lit(0))
            .when(status == "substring_match", F.instr(sequence, letters) - 1)).cast("int")
