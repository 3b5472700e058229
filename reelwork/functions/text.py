"""Text and hash functions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normalized(text: Column) -> Column:
    """Upper case letters A to Z and digits only."""
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def safe_token(text: Column) -> Column:
    """Letters, digits and _.:- as they are, all else a hyphen, without hyphens and dots at the ends; 'region' if nothing is left."""
    token = F.btrim(F.regexp_replace(text, "[^A-Za-z0-9_.:-]+", "-"), F.lit("-."))
    return F.when(token == "", "region").otherwise(token)


# all characters of the Unicode property White_Space
_WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(_WHITE))


def contract_id(value: Column, prefix: str) -> Column:
    """The trimmed value if it is an id, else the prefix, a hyphen and 16 hex digits of its hash."""
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed.rlike(r"^[a-zA-Z0-9][a-zA-Z0-9_.:-]*\z"), trimmed).otherwise(F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(trimmed.cast("binary"), 256), 1, 16)))


def _named(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shortest_double(x: Column) -> Column:
    """A double as the shortest digits that give it back, written as Python does: an exponent of two digits at least from 1e16 on and under 1e-4."""

    def written(text: Column) -> Column:
        digits, exponent = F.regexp_replace(F.substring_index(text, "e", 1), "[-.]", ""), F.substring_index(text, "e", -1).cast("int")
        return _named(F.struct(digits.alias("d"), F.length(digits).alias("n"), exponent.alias("e"), F.when(text.startswith("-"), "-").otherwise("").alias("sign")), placed)

    def placed(v: Column) -> Column:
        d, n, e = v["d"], v["n"], v["e"]
        point = lambda at: F.concat(F.substr(d, F.lit(1), at), F.lit("."), F.substr(d, at + 1))
        plain = F.when(e >= n - 1, F.concat(d, F.repeat(F.lit("0"), e - n + 1), F.lit(".0"))).when(e >= 0, point(e + 1)).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d))
        power = F.concat(F.when(n > 1, point(F.lit(1))).otherwise(d), F.when(e < 0, "e-").otherwise("e+"), F.format_string("%02d", F.abs(e)))
        return F.concat(v["sign"], F.when((e >= -4) & (e < 16), plain).otherwise(power))

    # a number that the JVM writes with at most 15 digits has no shorter form: these are tried alone
    said = F.length(F.btrim(F.regexp_replace(F.regexp_replace(x.cast("string"), "E.*", ""), "[-.]", ""), F.lit("0")))
    known = said.between(1, 15) & (F.abs(x) > 1e-290)
    places = F.when(known, F.array(said - 1)).otherwise(F.sequence(F.lit(0), F.lit(16)))
    tries = F.transform(places, lambda k: F.call_function("format_string", F.concat(F.lit("%."), k.cast("string"), F.lit("e")), x))
    shortest = F.get(F.filter(tries, lambda t: t.cast("double") == x), F.lit(0))
    return F.when(F.isnan(x), "NaN").when(x == float("inf"), "Infinity").when(x == float("-inf"), "-Infinity").when(x == 0, x.cast("string")).when(x.isNotNull(), _named(shortest, written))


# a double of to_json that Python writes in the same way: at most 15 digits, no exponent, no zeros to leave out; and the comma or bracket behind it
_SAME_DOUBLE = r"(?!0\.0000)(?=[0-9.]{3,16}[,}\]])[0-9]+\.(?:0|[0-9]*[1-9])[,}\]]"
_DIFFERS = rf"\\u|[:,\[]-?(?=[0-9]+\.[0-9])(?!{_SAME_DOUBLE})"


def python_json(json: Column) -> Column:
    """The text of to_json as Python's json writes it: doubles in shortest form, control characters with lower-case digits.

    Only text that may hold something to write anew is cut into its tokens; without a point or an escape it holds nothing, which is told without the pattern.
    """
    return _named(json, lambda text: F.when((text.contains(".") | text.contains("\\u")) & text.rlike(_DIFFERS), _rewritten(text)).otherwise(text))


def _rewritten(json: Column) -> Column:
    # possessive, so that the stack doesn't grow with the length of a string
    tokens = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*+"|-?[0-9]+\.[0-9]+(?:E-?[0-9]+)?|-?[0-9]+|[^"0-9-]+|-'), F.lit(0))
    # a backslash takes the character behind it along, so that one that stands for itself is no escape
    escapes = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit(r"\\u[0-9A-F]{4}|\\.|[^\\]+"), F.lit(0)), lambda x: F.when(x.rlike(r"^\\u"), F.lower(x)).otherwise(x)), "")
    whole = lambda t: F.when(t.rlike(r"^-?[0-9]+\.[0-9]"), shortest_double(t.cast("double"))).when(t.startswith('"') & t.contains("\\u"), escapes(t)).otherwise(t)
    return F.array_join(F.transform(tokens, whole), "")


def canonical_json(*columns: str) -> Column:
    """Compact JSON of columns with sorted keys; null fields are left out."""
    return python_json(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])))


def canonical_sha256(*columns: str) -> Column:
    """Hash of canonical_json()."""
    return F.sha2(canonical_json(*columns), 256)


def json_sha256(value: Column, nulls: bool = True) -> Column:
    """Hash of a struct as compact JSON, in the order of its fields; null fields are written as null, or left out."""
    return F.sha2(python_json(F.to_json(value, {"ignoreNullFields": str(not nulls).lower()})), 256)


@F.pandas_udf(DoubleType())
def label_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of trimmed, case-folded labels; the order of the arguments matters."""
    return pd.Series([None if a is None or b is None else SequenceMatcher(None, a.strip().casefold(), b.strip().casefold()).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")
