"""Column functions over the answers of judges and editors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings as S


def parse_judge(answer: Column, n: Column | int) -> Column:
    """An array of n structs (region, scale): null where undecided; null as a whole where the answer holds no object.

    An entry is an object with r and s, or a text of the older form such as TR3.
    """
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\{.*\}", 0)
    entries = F.from_json(body, "map<string,string>")

    def one(i: Column) -> Column:
        v = F.trim(entries[i.cast("string")])
        o = F.from_json(v, "r string, s string")
        region = F.upper(F.trim(F.coalesce(o["r"], F.lit(""))))
        number = o["s"].try_cast("double").try_cast("int")
        grade = F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(1)), F.lit(5)))
        old = F.upper(v)
        old_region, old_grade = F.regexp_extract(old, r"^(NO|TR|CA|SC|MIX)\s*([1-5])?$", 1), F.regexp_extract(old, r"^(NO|TR|CA|SC|MIX)\s*([1-5])?$", 2)
        pair = lambda r, s: F.struct(r.alias("region"), s.cast("int").alias("scale"))
        return (
            F.when(v.startswith("{"), F.when(region.isin(*S.REGIONS), pair(region, F.when(region != "NO", grade))))
            .when(old_region != "", pair(old_region, F.when(old_grade != "", old_grade)))
        )

    count = n if isinstance(n, Column) else F.lit(n)
    return F.when((body != "") & entries.isNotNull(), F.transform(F.sequence(F.lit(1), count), one))


def parse_edits(answer: Column, n: Column | int) -> Column:
    """A map from idx to (title, summary) of an editor's JSON array: idx from 1 to n, the last of several holds."""
    body = F.regexp_extract(F.coalesce(answer, F.lit("")), r"(?s)\[.*\]", 0)
    rows = F.from_json(body, "array<struct<idx:int,title:string,summary:string>>")
    count = n if isinstance(n, Column) else F.lit(n)
    good = F.filter(rows, lambda r: r["idx"].isNotNull() & r["idx"].between(1, count))
    last = F.filter(F.transform(good, lambda r, i: F.struct(i.alias("i"), r.alias("r"))), lambda x: ~F.exists(F.slice(good, x["i"] + 2, F.size(good)), lambda y: y["idx"] == x["r"]["idx"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["r"]["idx"].alias("key"), F.struct(x["r"]["title"].alias("title"), x["r"]["summary"].alias("summary")).alias("value"))))


def items_as_json(items: Column) -> Column:
    """Items, an array of structs, as the text an editor gets."""
    return F.to_json(items)
