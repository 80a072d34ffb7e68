"""ARFF: attribute lines become a schema, data lines are parsed as delimited text by Spark."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

# Type words of the format; anything in braces is nominal
NUMERIC_WORDS = ("numeric", "real", "integer")

_ATTRIBUTE = re.compile(r"@attribute\s+('(?:[^'\\]|\\.)*'|\"[^\"]*\"|\S+)\s+(.+)", re.IGNORECASE)


def parse_attribute(line: str) -> T.StructField:
    m = _ATTRIBUTE.match(line.strip())
    if not m:
        raise ValueError(f"not an attribute line: {line!r}")
    name, kind = m.group(1), m.group(2).strip().lower()
    if name[0] in "'\"":
        name = name[1:-1].replace("\\'", "'")
    if kind.startswith("{") or kind == "string":
        return T.StructField(name, T.StringType())
    if kind in NUMERIC_WORDS:
        return T.StructField(name, T.DoubleType())
    raise ValueError(f"unsupported attribute type: {line!r}")


def _header(lines: DataFrame) -> list[str]:
    """Attribute lines. Read from the start of the file; only a folder of parts is searched whole."""
    want = 256
    while True:
        head = [r["value"] for r in lines.head(want)]
        marks = [i for i, v in enumerate(head) if v.strip().lower().startswith("@data")]
        if marks:
            found = [v for v in head[:marks[0]] if v.strip().lower().startswith("@attribute")]
            if found:
                return found
            break
        if len(head) < want or not any(v.strip().startswith(("@", "%")) or not v.strip() for v in head[:1]):
            break
        want *= 4
    marked = lines.select(F.monotonically_increasing_id().alias("at"), "value").where(
        F.lower(F.trim("value")).startswith("@attribute"))
    return [r["value"] for r in marked.orderBy("at").collect()]  # one row per attribute


# one field: quoted either way, or anything up to the next comma
_FIELD = r"""(?:^|,)\s*('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|[^,]*?)\s*(?=,|$)"""


def _nominal(line: str) -> list[str] | None:
    """The declared values of a nominal attribute."""
    kind = _ATTRIBUTE.match(line.strip()).group(2).strip()
    if not kind.startswith("{"):
        return None
    found = re.findall(r"""\s*('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|[^,]*?)\s*(?:,|$)""", kind.strip("{} \t"))
    return [re.sub(r"\\(.)", r"\1", v[1:-1]) if v[:1] in ("'", '"') else v for v in found if v]


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """Numbers as double, nominal and string attributes as text, an unquoted '?' as NULL.

    Data are the lines after the first @data line of a file (all lines of a part without one), but for blank lines
    and comments. A row with another number of fields, or a value outside its nominal set, is an error.
    """
    lines = spark.read.text(path)
    header = _header(lines)
    fields = [parse_attribute(v) for v in header]
    if not fields:
        raise ValueError(f"no attributes in {path}")
    # a line's place: the start of its split, then its number there
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("split"),
                          F.monotonically_increasing_id().alias("line")).alias("at"), F.trim("value").alias("text"))
    marks = placed.where(F.lower("text").rlike("^@data\\s*(%.*)?$")).groupBy("file").agg(F.min("at").alias("mark"))  # one row per file
    data = (placed.join(marks, "file", "left").where(F.col("mark").isNull() | (F.col("at") > F.col("mark")))
            .where((F.col("text") != "") & ~F.col("text").startswith("%")))
    cells = data.select("text", F.regexp_extract_all("text", F.lit(_FIELD), 1).alias("cells"))
    right = F.when(F.size("cells") != len(fields), F.raise_error(F.concat(F.lit("wrong number of fields: "), F.col("text")))).otherwise(F.col("cells"))
    cells = cells.select(right.alias("cells"))

    def value(i, field, allowed):
        raw = F.get("cells", i)
        quoted = raw.rlike("^['\"]")
        text = F.when(quoted, F.regexp_replace(F.substring(raw, F.lit(2), F.length(raw) - 2), r"\\(.)", "$1")).when(raw != "?", raw)
        if allowed is not None:
            known = F.array(*[F.lit(v) for v in allowed])
            text = F.when(text.isNull() | F.array_contains(known, text), text).otherwise(
                F.raise_error(F.concat(F.lit(f"{field.name}: undeclared value "), text)))
        return text.cast(field.dataType).alias(field.name)

    return cells.select(*[value(i, f, _nominal(h)) for i, (f, h) in enumerate(zip(fields, header))])
