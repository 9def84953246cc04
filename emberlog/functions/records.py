"""Log records as JSON: strict decoding without Python, and encoding in declared order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LOG_COLUMNS

_TYPES = ("BIGINT", "STRING", "STRING", "STRING")
_HIGH_ALONE = r"(?i)(?<!\\)(?:\\\\)*\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})"
_LOW_ALONE = r"(?i)(?<!\\ud[89ab][0-9a-f]{2})(?<!\\)(?:\\\\)*\\ud[c-f][0-9a-f]{2}"
_MINUS_ZERO = r'("timestamp"\s*:|^\s*\[)\s*-0\s*[,}\]]'


def encoded(*columns: str) -> Column:
    """The record as a JSON object, its fields in declared order."""
    return F.to_json(F.struct(*(columns or LOG_COLUMNS)))


def decoded(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``record`` (a struct of the log columns) and ``reason`` (null if the record is valid).

    The bytes must be UTF-8 and one JSON document: an object that has the four fields, each once
    and of its type, or an array of just their values in order. Other fields are ignored. Fields
    that are missing, null or of another type, numbers with a fraction, an exponent or out of range,
    lone surrogates and anything before or after the document make it invalid. (An object in which
    an unknown field is repeated is invalid too.)
    """
    bytes_ = F.col(value).cast("binary")
    df = df.withColumn("_text", F.when(F.is_valid_utf8(bytes_.cast("string")), bytes_.cast("string")))
    # either wrap alone would let some crafted text after the document through
    one = F.expr("""try_parse_json('{"w":' || _text || '}') IS NOT NULL AND try_parse_json('[' || _text || ']') IS NOT NULL""")
    df = _once(df, "_v", F.when(one, F.try_parse_json("_text")))
    is_array = F.schema_of_variant("_v").startswith("ARRAY")
    field = lambda i, name: F.when(is_array, F.try_variant_get("_v", f"$[{i}]", "variant")).otherwise(F.try_variant_get("_v", f"$.{name}", "variant"))
    # an array of four has a fourth element and no fifth
    fifth = F.coalesce(is_array & F.try_variant_get("_v", "$[4]", "variant").isNotNull(), F.lit(False))
    df = _once(df, "_f", F.struct(fifth.alias("fifth"), *(field(i, n).alias(n) for i, n in enumerate(LOG_COLUMNS))))
    fits = ~F.col("_f.fifth")
    for name, kind in zip(LOG_COLUMNS, _TYPES):
        fits &= F.coalesce(F.schema_of_variant(f"_f.{name}") == kind, F.lit(False))
    odd = F.col("_text").contains("\\ud") | F.col("_text").contains("\\uD") | F.col("_text").contains("-0")
    odd &= F.col("_text").rlike(_HIGH_ALONE) | F.col("_text").rlike(_LOW_ALONE) | F.col("_text").rlike(_MINUS_ZERO)
    reason = (
        F.when(F.col(value).isNull(), "no payload")
        .when(F.col("_text").isNull(), "not UTF-8")
        .when(F.col("_v").isNull(), "not a JSON document")
        .when(~fits | odd, "not a log record")
    )
    df = _once(df, "reason", reason)
    record = F.struct(*(F.try_variant_get(f"_f.{n}", "$", t).alias(n) for n, t in zip(LOG_COLUMNS, ("bigint", "string", "string", "string"))))
    return df.withColumn("record", F.when(F.col("reason").isNull(), record)).drop("_text", "_v", "_f")


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Adds a column as a generator's output: projections above it don't evaluate it again for each use."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def decoded_or_raise(df: DataFrame, value: str = "value") -> DataFrame:
    """The decoded columns beside the others; the job fails at the first invalid record."""
    df = decoded(df, value)
    stop = F.raise_error(F.concat(F.lit("DecodeError: "), F.col("reason")))
    checked = df.withColumn("record", F.when(F.col("reason").isNotNull(), stop.cast(df.schema["record"].dataType)).otherwise(F.col("record")))
    return checked.select("*", "record.*").drop("record", "reason")
