"""Findings' texts in a language, from a table of templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("title", "detail", "fix", "example")
#: What a template is made of: a place for a parameter, a doubled per cent sign, other text; a lone per cent sign is a fault.
PARTS = r"(?s)%\([^)]*\)(?:\.\d)?[sdf]|%%|[^%]+|%"


def filled(template: Column, params: Column) -> Column:
    """A template with its places filled in from ``params`` (a map of strings); null if it and they don't go together.

    ``%(name)s`` takes the parameter as it is, ``%(name)d`` a number cut to a whole one,
    ``%(name)f`` and ``%(name).2f`` a number with six or so many decimals; ``%%`` is a per
    cent sign. A missing parameter, one that is no number where one is due, and a lone per
    cent sign spoil the whole template.
    """

    def one(part: Column) -> Column:
        value = F.try_element_at(params, F.regexp_extract(part, r"^%\(([^)]*)\)", 1))
        kind, digits = F.regexp_extract(part, r"([sdf])$", 1), F.regexp_extract(part, r"\.(\d)[sdf]$", 1)
        number = value.try_cast("double")
        exact = value.try_cast("decimal(38,9)")
        fixed = [F.when(digits == str(d), F.bround(exact, d).cast(f"decimal(38,{d})").cast("string")) for d in range(10)]
        text = F.when(kind == "s", F.when(digits == "", value).otherwise(F.substring(value, F.lit(1), digits.try_cast("int"))))
        whole = F.when(kind == "d", F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("long").cast("string"))
        float_ = F.when(kind == "f", F.coalesce(F.when(digits == "", F.bround(exact, 6).cast("decimal(38,6)").cast("string")), *fixed))
        place = F.coalesce(text, whole, float_)
        return F.when(part == "%%", F.lit("%")).when(part == "%", F.lit(None).cast("string")).when(part.startswith("%("), place).otherwise(part)

    parts = F.transform(F.regexp_extract_all(template, F.lit(PARTS), F.lit(0)), one)
    return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))


def finding_texts(findings: DataFrame, catalogue: DataFrame, lang: str) -> DataFrame:
    """``findings`` with title, detail, fix and example in ``lang``, field by field: where the catalogue has no fitting template the given text stays.

    ``findings``: key, params (a map of strings) and the four texts; ``catalogue``: lang,
    key, field, template, of one field of a key the last by ``template`` if it repeats.
    """
    entry = catalogue.filter(F.col("lang") == lang).groupBy("key").agg(*[F.max(F.when(F.col("field") == f, F.col("template"))).alias(f"_{f}") for f in FIELDS])
    rows = findings.join(entry, "key", "left")
    params = F.coalesce("params", F.create_map().cast("map<string,string>"))
    texts = [F.coalesce(filled(F.col(f"_{f}"), params), F.col(f), F.lit("")).alias(f) for f in FIELDS]
    return rows.select(*[F.col(c) for c in findings.columns if c not in FIELDS], *texts)
