"""The library's text functions for SQL users: ``register`` makes temporary functions.

Each is a SQL-defined function over the very expressions that the DataFrame side uses,
written out as SQL text; Spark inlines it where it is called, so no Python worker runs
and filters and columns are pushed as in any query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corrello.functions import indicators, text

#: Strings, which stay as they are, and operators that an expression calls by name.
_PART = re.compile(r"""('(?:[^'\\]|\\.)*')|(?<![\w`])(and|or|not|!|<=>|<=|>=|<|>|=|\+|-|\*|/|%|in)\(""", re.S)


def text_of(column: Column) -> str:
    """A column's expression as SQL."""
    return _PART.sub(lambda m: m[1] or f"`{m[2]}`(", column._jc.node().sql())


class _Steps:
    """Stands for a row while ``withColumn`` and ``withColumns`` are called on it, and gives
    one expression that does the same.

    Every step is a struct of all columns so far, bound to a variable by a ``transform``
    over an array of one, so each column is computed once."""

    def __init__(self, first: str, source: str) -> None:
        self.names, self.steps = [first], [f"struct({source} AS `{first}`)"]

    def _seen(self, sql: str) -> str:
        """Columns that are known by now become fields of the last step's variable."""
        own = "|".join(map(re.escape, self.names))
        part = re.compile(rf"('(?:[^'\\]|\\.)*')|(?<![\w.`])({own})(?![\w(])", re.S)
        return part.sub(lambda m: m[1] or f"row{len(self.steps)}.`{m[2]}`", sql)

    def withColumns(self, columns: dict[str, Column]) -> _Steps:
        made = {name: self._seen(text_of(c)) for name, c in columns.items()}
        kept = {n: f"row{len(self.steps)}.`{n}`" for n in self.names if n not in made}
        self.steps.append("struct(" + ", ".join(f"{v} AS `{n}`" for n, v in (kept | made).items()) + ")")
        self.names = [*kept, *made]
        return self

    def withColumn(self, name: str, column: Column) -> _Steps:
        return self.withColumns({name: column})

    def drop(self, *names: str) -> _Steps:
        return self

    def result(self, column: Column) -> str:
        out = self._seen(text_of(column))
        for i in range(len(self.steps), 0, -1):
            out = f"get(transform(array({self.steps[i - 1]}), row{i} -> {out}), 0)"
        return out


def _function(name: str, argument: str, kind: str, body: str) -> str:
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({argument} STRING) RETURNS {kind} RETURN {body}"


_PAIRS = "ARRAY<STRUCT<type: STRING, value: STRING>>"


def find_iocs(tlds: list[str] | None = None) -> str:
    found = indicators.with_indicators(_Steps("_txt", "txt"), "_txt", None, tlds)

    def told(kind: str) -> Column:
        return F.transform(F.col(kind), lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value")))

    return _function("find_iocs", "txt", _PAIRS, found.result(F.concat(*[told(t) for t in indicators.TYPES])))


def register(spark: SparkSession, tlds: list[str] | None = None) -> list[str]:
    """Make the functions in the session; returns their names.

    find_iocs(text): an array of (type, value), for ``inline`` of a column of a subquery,
    over tables of any size; extract_iocs(text): the same as a table, for single texts (where it
    is joined laterally, Spark joins on the text).  refang, defang, normal_text, host_of,
    registrable_domain, is_public_ip and text_sentences are scalar.  Null gives null, or no
    rows."""
    arg = F.col("txt")
    spark.sql(find_iocs(tlds))
    spark.sql(_function("extract_iocs", "txt", "TABLE(type STRING, value STRING)", "SELECT inline(found) FROM (SELECT find_iocs(txt) AS found)"))
    scalars = {
        "refang": (text.refang, "STRING"), "defang": (text.defang, "STRING"), "normal_text": (text.normalise, "STRING"), "host_of": (indicators.host_of, "STRING"),
        "registrable_domain": (text.registrable, "STRING"), "is_public_ip": (indicators.is_public_ip, "BOOLEAN"), "text_sentences": (text.sentences, "ARRAY<STRING>"),
    }
    for name, (f, kind) in scalars.items():
        spark.sql(_function(name, "txt", kind, text_of(f(arg))))
    return ["find_iocs", "extract_iocs", *scalars]
