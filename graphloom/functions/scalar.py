"""Column expressions for labels, hashes, features and display. All run inside Spark's generated code or its higher-order functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.canonical import canonical_code

STRUCTURAL, UNKNOWN = "STRUCTURAL", "UNKNOWN"
#: Values that stand for no known label.
UNKNOWN_WORDS = ("unk", "unknown", "none", "null", "nan")
#: Key precedence of the resolvers, fixed by the data model.
EDGE_TYPE_KEYS = ("type_str", "type", "relation", "edge_type", "label", "input_label")
VIEW_NODE_KEYS = ("type", "label", "node_type", "category", "kind", "class")
STABLE_MODULUS = 2147483647


def stable_int(text: Column) -> Column:
    """A number from 0 to 2**31-2 of a text: the first 60 bits of its MD5, reduced. Null for null."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(STABLE_MODULUS))


def cache_key(text: Column) -> Column:
    return F.md5(text)


def hashed_label_id(label: Column) -> Column:
    """Hash + 1, 0 for null: ids without a vocabulary."""
    return F.coalesce(stable_int(label) + 1, F.lit(0).cast("long"))


def node_label(attrs: Column) -> Column:
    """semantic_label where the key is there, even if its value is null; else label."""
    return F.when(F.map_contains_key(attrs, "semantic_label"), attrs["semantic_label"]).otherwise(attrs["label"])


def first_of(attrs: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(attrs[k] for k in keys))


def non_numeric(text: Column) -> Column:
    """The text unless it is blank or reads as a number."""
    return F.when((F.trim(text) != "") & text.try_cast("double").isNull(), F.trim(text))


def safe_label(text: Column) -> Column:
    t = F.trim(text)
    return F.when(text.isNull() | (t == ""), STRUCTURAL).when(F.lower(t).isin(*UNKNOWN_WORDS), UNKNOWN).otherwise(t)


def numeric_attrs(attrs: Column) -> Column:
    """Of a map of texts: keys that aren't blank with values that are numbers or booleans, as doubles."""
    as_number = lambda v: F.when(F.lower(v) == "true", 1.0).when(F.lower(v) == "false", 0.0).otherwise(v.try_cast("double"))
    kept = F.map_filter(attrs, lambda k, v: (F.trim(k) != "") & as_number(v).isNotNull())
    return F.transform_values(kept, lambda k, v: as_number(v))


def weight(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(1.0))


def node_mix(label_id: Column, bucket: Column | None = None) -> Column:
    base = F.shiftleft(label_id.cast("long"), 1)
    return base if bucket is None else base.bitwiseXOR(F.shiftleft(bucket.cast("long"), 3).bitwiseOR(F.shiftright(bucket.cast("long"), 2)))


def edge_mix(type_id: Column, forward: bool) -> Column:
    return (type_id.cast("long") * 1315423911).bitwiseXOR(F.lit(11 if forward else 19).cast("long"))


def pair_hash(src: Column, dst: Column) -> Column:
    """Sum of (position x code) over the text "src->dst"."""
    chars = F.filter(F.split(F.concat(src, F.lit("->"), dst), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, lambda c, i: ((i + 1) * F.ascii(c)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)


def text_signature(vec: Column, k: int) -> Column:
    """Codes (index * 2 + sign) of the k entries of largest magnitude; ties to the lower index."""
    items = F.transform(vec, lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("i"), x.alias("v")))
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda z: F.shiftleft(z["i"], 1).bitwiseOR((z["v"] >= 0).cast("int")))


def text_bucket(signature: Column) -> Column:
    return F.when(F.size(signature) > 0, stable_int(F.concat(F.lit("textsig::"), F.array_join(signature.cast("array<string>"), ",")))).otherwise(0)


def one_hot(index: Column, width: int) -> Column:
    at = F.least(F.greatest(index.cast("int"), F.lit(0)), F.lit(width - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == at).cast("int"))


def label_bucket(label_id: Column, width: int) -> Column:
    return F.when(label_id == 0, 0).otherwise(1 + label_id % (width - 1)).cast("int")


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """The bin of equal width that a value falls in, 0 to bins-1, clamped."""
    step = (high - low) / bins
    return F.least(F.greatest(F.floor((value - low) / step), F.lit(0)), F.lit(bins - 1)).cast("int")


def wave(value: Column, width: int) -> Column:
    """Sine and cosine encoding of a number, as positions are encoded in sequence models."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i % 2 == 0, F.sin(value / F.pow(F.lit(10000.0), i / float(width)))).otherwise(F.cos(value / F.pow(F.lit(10000.0), (i - 1) / float(width)))))


def order_violation(a: Column, b: Column) -> Column:
    """Sum of max(0, b - a) squared: 0 where b lies below a in every entry."""
    parts = F.zip_with(a, b, lambda x, y: F.pow(F.greatest(y.cast("double") - x.cast("double"), F.lit(0.0)), F.lit(2.0)))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def l2_normalize(v: Column) -> Column:
    n = l2_norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def clamp_relation(type_id: Column, relations: int) -> Column:
    return F.least(F.greatest(type_id, F.lit(0)), F.lit(relations - 1))


def density(nodes: Column, edges: Column, directed: bool) -> Column:
    full = nodes * (nodes - 1) / (1 if directed else 2)
    return F.when(nodes > 1, edges / full).otherwise(0.0)


def density_name(value: Column) -> Column:
    """As names of files have it."""
    return F.when(value > 0.5, "very-dense").when(value > 0.3, "dense").otherwise("sparse")


def density_class(value: Column) -> Column:
    """As page templates have it."""
    return F.when(value < 0.1, "sparse").when(value < 0.5, "medium").otherwise("dense")


def clean_filename(text: Column, most: int = 100) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(text, r'[<>:"/\\|?*]', "_"), "_+", "_"), 1, most)


def display_label(attrs: Column, excluded: tuple[str, ...]) -> Column:
    kept = F.map_filter(attrs, lambda k, v: ~k.isin(*excluded) & v.isNotNull())
    return F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")


def short_number(x: Column) -> Column:
    """1600000 as 2M, and so on; halves go to the even number."""
    scaled = lambda unit, letter: F.concat(F.bround(x / unit).cast("long").cast("string"), F.lit(letter))
    return F.when(x >= 1e9, scaled(1e9, "B")).when(x >= 1e6, scaled(1e6, "M")).when(x >= 1e3, scaled(1e3, "K")).when(x >= 1, F.floor(x).cast("string")).otherwise(F.format_string("%.1f", F.bround(x, 1)))


def type_title(t: Column) -> Column:
    return F.initcap(F.replace(t, F.lit("_"), F.lit(" ")))


def any_less(a: Column, b: Column) -> Column:
    """Whether some entry of a is below b's: then b can't lie in a."""
    return F.exists(F.zip_with(a, b, lambda x, y: x < y), lambda z: z)


def register(spark: SparkSession) -> None:
    """SQL functions order_violation, stable_id and safe_label; canon_code is an Arrow function, for patterns of some twenty nodes."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION order_violation(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> pow(greatest(y - x, 0D), 2D)), 0D, (s, x) -> s + x)")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION stable_id(t STRING) RETURNS BIGINT RETURN pmod(CAST(conv(substr(md5(t), 1, 15), 16, 10) AS BIGINT), {STABLE_MODULUS})")
    words = ", ".join(f"'{w}'" for w in UNKNOWN_WORDS)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION safe_label(t STRING) RETURNS STRING RETURN CASE WHEN t IS NULL OR trim(t) = '' THEN '{STRUCTURAL}' WHEN lower(trim(t)) IN ({words}) THEN '{UNKNOWN}' ELSE trim(t) END")

    @F.pandas_udf("string")
    def canon_code(labels, arcs):
        return labels.combine(arcs, lambda ls, es: canonical_code(len(ls), [(int(e["src"]), int(e["dst"]), e["type"]) for e in es], list(ls)))

    spark.udf.register("canon_code", canon_code)
