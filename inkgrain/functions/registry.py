"""The column functions by name, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from inkgrain.functions import align, glyphs, text

#: Functions that SQL can state itself.
PLAIN = {
    "ink_clean(t STRING) RETURNS STRING": r"regexp_replace(t, '\\p{Cf}', '')",
    "ink_edit_distance(ref STRING, hyp STRING) RETURNS INT": "levenshtein(ref, hyp)",
    "ink_words(t STRING) RETURNS ARRAY<STRING>": r"filter(split(t, '(?U)\\s+'), x -> x <> '')",
    "ink_strip(t STRING) RETURNS STRING": "trim(BOTH ' ' FROM t)",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql`` of this session; gives their names.

    ``ink_nfc`` composes, ``ink_nfd`` decomposes, ``ink_trace`` gives the operations of an alignment (three
    characters each), ``ink_decompose`` the base, modifier and tone of a character.
    """
    names = []
    for head, body in PLAIN.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])
    made = {"ink_nfc": text._nfc, "ink_nfd": text._nfd, "ink_trace": align.traced}
    for name, f in made.items():
        spark.udf.register(name, f)
    parts = ", ".join("named_struct('ch', '{}', 'p', named_struct('base', '{}', 'modifier', '{}', 'tone', '{}'))".format(*(x.replace("\\", "\\\\").replace("'", "\\'") for x in r[:4])) for r in glyphs.rows() if r[2] != "none" or r[3] != "ngang")
    known = f"map_from_entries(transform(array({parts}), x -> struct(x.ch, x.p)))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ink_decompose(c STRING) RETURNS STRUCT<base: STRING, modifier: STRING, tone: STRING> RETURN coalesce(element_at({known}, c), named_struct('base', c, 'modifier', 'none', 'tone', 'ngang'))")
    return [*names, *made, "ink_decompose"]
