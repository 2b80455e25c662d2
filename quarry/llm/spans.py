"""Positions of regular-expression matches with built-in functions only.

``regexp_extract_all`` gives the matches and ``split`` by the same pattern the text between them, so a
running sum of lengths (code points) gives every match's place. The second pass over a text runs only
where the first found something.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _placed(found: Column, gaps: Column, kind: int, keep: Callable[[Column], Column] | None) -> Column:
    steps = F.zip_with(found, F.transform(gaps, F.char_length), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        start = acc["at"] + x["g"]
        end = start + F.coalesce(F.char_length(x["m"]), F.lit(0))
        one = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("value")))
        good = x["m"].isNotNull() if keep is None else F.coalesce(keep(x["m"]), F.lit(False))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))
    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def with_spans(df: DataFrame, rules: list[tuple[str, int, str, Callable | None, Column | None]], text: str = "text") -> DataFrame:
    """Add a column of spans for each rule (column, kind number, pattern, test of a match, condition).

    Patterns are Java's. Matches are leftmost and do not overlap; those failing the test are dropped
    without another try inside them. Rows where the condition is not true are not searched.
    """
    none = F.array().cast("array<string>")
    for name, _, pattern, _, where in rules:
        found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
        df = df.withColumn(f"{name}__m", found if where is None else F.when(where, found).otherwise(none))
    for name, kind, pattern, keep, _ in rules:
        m = F.col(f"{name}__m")
        df = df.withColumn(name, F.when(F.size(m) > 0, _placed(m, F.split(F.col(text), pattern, -1), kind, keep))
                           .otherwise(F.array().cast(SPAN)))
    return df.drop(*[f"{name}__m" for name, *_ in rules])


def listed(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
