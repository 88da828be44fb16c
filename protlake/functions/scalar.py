"""Column expressions. All of them stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protlake import constants as C


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The optimizer copies a column's expression into every filter and often into projections that use it, which
    repeats a costly parse. Columns made by a one-element generator are read, never recomputed.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.explode(packed).alias("__once")).select(*df.columns, "__once.*")


def d(value: float) -> Column:
    """DOUBLE literal (a bare Python float would already be one; ints would not)."""
    return F.lit(float(value))


def confidence_bin(plddt: Column) -> Column:
    return (
        F.when(plddt < 50, "very_low")
        .when(plddt < 70, "low")
        .when(plddt < 90, "confident")
        .otherwise("very_high")
    )


def distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def or_default(value: Column, default) -> Column:
    """NULL and zero both become the default."""
    return F.coalesce(F.nullif(value, F.lit(0)), default if isinstance(default, Column) else F.lit(default))


def fragment_length(start: Column, end: Column) -> Column:
    first = or_default(start, 1)
    return F.greatest(or_default(end, first) - first + 1, F.lit(1))


def sigmoid(x: Column) -> Column:
    return d(1) / (d(1) + F.exp(-x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, d(low)), d(high))


def logit(p: Column, eps: float = C.SCORE_CLAMP) -> Column:
    q = clamp(p.cast("double"), eps, 1.0 - eps)
    return F.ln(q / (d(1) - q))


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, d(0)).otherwise(num.cast("double") / den)


def eps_ratio(num: Column, den: Column, eps: float = C.RATIO_EPS) -> Column:
    return num.cast("double") / (den + d(eps))


def f1(precision: Column, recall: Column) -> Column:
    return safe_ratio(d(2) * precision * recall, precision + recall)


def _quoted(value) -> str:
    return f"{value!r}D" if isinstance(value, float) else f"'{value}'"


def literal_map(values: dict[str, object]) -> Column:
    """MAP literal of short plain texts or doubles; one parsed expression instead of a call per entry."""
    return F.expr("map(" + ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in values.items()) + ")")


def double_array(values, kind: str = "double") -> Column:
    return F.expr("cast(array(" + ", ".join(f"{float(v)!r}D" for v in values) + f") AS array<{kind}>)")


def residue_letter(name3: Column) -> Column:
    """Three-letter to one-letter residue name, X when unknown."""
    return F.coalesce(F.try_element_at(literal_map(C.RESIDUE_NAME3), name3), F.lit("X"))


def canonical_residue(letter: Column) -> Column:
    aa = F.upper(F.trim(F.coalesce(letter, F.lit("X"))))
    return F.when(aa.isin(*C.RESIDUE_LETTERS), aa).otherwise("X")


def _one_hot_table() -> str:
    width = len(C.RESIDUE_LETTERS)
    rows = (f"'{a}', array({', '.join('1F' if i == k else '0F' for k in range(width))})" for i, a in enumerate(C.RESIDUE_LETTERS))
    return f"map({', '.join(rows)})"


def residue_one_hot(letter: Column) -> Column:
    """ARRAY<FLOAT> of 21, looked up in a literal table."""
    return F.element_at(F.expr(_one_hot_table()), canonical_residue(letter))


def secondary_one_hot(code: Column) -> Column:
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    helix, sheet = c.isin(*C.HELIX_CODES), c.isin(*C.SHEET_CODES)
    return F.array(
        F.when(helix, d(1)).otherwise(d(0)),
        F.when(sheet, d(1)).otherwise(d(0)),
        F.when(helix | sheet, d(0)).otherwise(d(1)),
    )


def relative_surface(aa: Column, accessibility: Column) -> Column:
    top = F.coalesce(F.try_element_at(literal_map(C.MAX_SURFACE), F.upper(aa)), d(C.DEFAULT_MAX_SURFACE))
    return accessibility / top


def structure_vector(aa: Column, code: Column, accessibility: Column, phi: Column, psi: Column,
                     area: Column) -> Column:
    """Ten structure features: class one-hot, angle sines/cosines, surface, relative surface, area."""
    return F.concat(
        secondary_one_hot(code),
        F.array(F.sin(F.radians(phi)), F.cos(F.radians(phi)), F.sin(F.radians(psi)), F.cos(F.radians(psi)),
                accessibility, relative_surface(aa, accessibility), area),
    )


def residue_number_parts(text: Column) -> tuple[Column, Column]:
    """``123A`` -> (123, 'A'); digits may follow one leading minus; no digits -> 0."""
    s = F.trim(F.coalesce(text, F.lit("")))
    # a minus counts only before the first digit, wherever letters stand
    sign = F.when(F.regexp_like(s, F.lit(r"^[^0-9-]*-[^0-9]*[0-9]")), "-").otherwise("")
    digits = F.regexp_replace(s, "[^0-9]", "")
    number = F.coalesce(F.concat(sign, digits).try_cast("int"), F.lit(0))
    suffix = F.when(sign == "-", F.regexp_replace(F.regexp_replace(s, "^([^0-9-]*)-", "$1"), "[0-9]", "")) \
        .otherwise(F.regexp_replace(s, "[0-9]", ""))
    return number, F.trim(suffix)


def sequence_windows(length: Column, size: int, overlap: int) -> Column:
    """ARRAY<STRUCT<start, end>> of overlapping windows; empty for length <= 0."""
    if size <= 0:
        raise ValueError("window size must be positive")
    if overlap < 0:
        raise ValueError("window overlap must not be negative")
    if overlap >= size:
        raise ValueError("window overlap must be smaller than the window size")
    n = length.cast("int")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    windows = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + size, n).alias("end")))
    return F.when(n > 0, windows).otherwise(F.filter(windows, lambda w: F.lit(False)))


def kmers(sequence: Column, k: int) -> Column:
    """All overlapping k-mers in one linear pass (zero-width look-ahead match)."""
    return F.regexp_extract_all(sequence, F.lit(f"(?s)(?=(.{{{int(k)}}}))"), F.lit(1))


def array_quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile inside one sorted or unsorted array."""
    s = F.array_sort(values)
    pos = d(q) * (F.size(s) - 1)
    low = F.element_at(s, (F.floor(pos) + 1).cast("int"))
    high = F.element_at(s, (F.ceil(pos) + 1).cast("int"))
    return F.when(F.size(values) > 0, low + (high - low) * (pos - F.floor(pos)))


def array_quantiles(values: Column, qs: list[float]) -> Column:
    """ARRAY of linear-interpolated quantiles; the values are sorted once for all of them."""
    def of(s: Column) -> Column:
        at = [(q * (F.size(s) - 1)) for q in map(d, qs)]
        ends = [(F.get(s, F.floor(p).cast("int")), F.get(s, F.ceil(p).cast("int")), p - F.floor(p)) for p in at]
        return F.array(*[low + (high - low) * part for low, high, part in ends])

    return F.when(F.size(values) > 0, F.get(F.transform(F.array(F.array_sort(values)), of), F.lit(0)))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, d(0), lambda acc, v: acc + v)


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, array_sum(values) / F.size(values))


def is_square(matrix: Column, n: Column) -> Column:
    return (F.size(matrix) == n) & F.forall(matrix, lambda r: F.size(r) == n)


def all_finite(vector: Column) -> Column:
    """True when no element is NULL, NaN or infinite."""
    return F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))


def typed_value(text: Column) -> Column:
    """Log value as STRUCT of the three typed readings; at most one of int/number/text is set."""
    whole = F.when(F.regexp_like(text, F.lit(r"^[-+]?[0-9]+$")), text.try_cast("bigint"))
    number = F.when(whole.isNull(), text.try_cast("double"))
    return F.struct(
        whole.alias("int_value"),
        number.alias("double_value"),
        F.when(whole.isNull() & number.isNull(), text).alias("string_value"),
    )


def aspect_order(aspect: Column) -> Column:
    return F.coalesce(F.try_element_at(F.expr("map('BPO', 1, 'CCO', 2, 'MFO', 3)"), aspect), F.lit(99))


def base_node_vector(residue: Column, plddt: Column, very_low: Column, low: Column, confident: Column,
                     very_high: Column, pae_mean: Column, pae_min: Column, pae_p90: Column, degree: Column,
                     strict_degree: Column, position: Column, length: Column, fraction: Column) -> Column:
    """Thirty-two base node features."""
    def flag(c: Column) -> Column:
        return F.when(c, d(1)).otherwise(d(0))

    def num(c: Column) -> Column:
        return F.coalesce(c.cast("double"), d(0))

    relative = F.when(position.isNull() | (length <= 0), num(fraction)).otherwise(position / length)
    return F.concat(
        residue_one_hot(residue),
        F.array(num(plddt), flag(very_low), flag(low), flag(confident), flag(very_high), num(pae_mean),
                num(pae_min), num(pae_p90), num(degree), num(strict_degree), relative).cast("array<float>"),
    )


def edge_vector(dist: Column, separation: Column, pae: Column, sequential: Column, short: Column,
                strict: Column) -> Column:
    def flag(c: Column) -> Column:
        return F.when(c, d(1)).otherwise(d(0))

    def num(c: Column) -> Column:
        return F.coalesce(c.cast("double"), d(0))

    return F.array(num(dist), num(separation), num(pae), flag(sequential), flag(short), flag(strict)) \
        .cast("array<float>")


def _log_scale(x: Column, top: float) -> Column:
    return F.log1p(F.greatest(x, d(0))) / F.log1p(d(top))


def _rescale(vector: Column, rules: dict[int, object], width: int) -> Column:
    slots = []
    for i in range(width):
        v = vector[i].cast("double")
        slots.append(rules[i](v) if i in rules else v)
    return F.array(*slots).cast("array<float>")


def _range(top: float, high: float):
    return lambda v: clamp(v / d(top), 0.0, high)


def _counts(top: float):
    return lambda v: clamp(_log_scale(v, top), 0.0, 5.0)


def normalised_node(vector: Column) -> Column:
    """Base node block scaled to compact ranges; the other blocks are left alone."""
    rules = {21: _range(100, 1), 26: _range(30, 10), 27: _range(30, 10), 28: _range(30, 10),
             29: _counts(64), 30: _counts(64)}
    return _rescale(vector, rules, C.BASE_WIDTH)


def normalised_edge(vector: Column) -> Column:
    return _rescale(vector, {0: _range(30, 10), 1: _counts(1200), 2: _range(30, 10)}, C.EDGE_WIDTH)


def normalised_summary(vector: Column) -> Column:
    rules = {0: lambda v: _log_scale(v, 1200), 1: lambda v: _log_scale(v, 10), 2: _range(100, 1),
             3: _range(100, 1), 8: _counts(64), 10: _range(30, 10), 11: _range(30, 10), 12: _range(100, 10)}
    return _rescale(vector, rules, C.SUMMARY_WIDTH)
