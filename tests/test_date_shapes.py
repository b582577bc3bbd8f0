"""Dates by the patterns of a culture: what each pattern alone gives, at the cost of one or two."""

import pytest
from pyspark.sql import functions as F

from rowmill.functions import dates
from rowmill.functions.locales import LOCALES, locale
from rowmill.plans.compiler import Compiler, compile_rows
from rowmill.plans.spec import FieldMapping, Pipeline, SourceOptions, Transformation

TEXTS = [
    "4/12/1998", "1998/4/12", "1998-04-12", "12.4.1998 17:05", "0031/4/0011", "0012/4/0011", "0013/4/0011", "1998/4/0012", "4/31/1998", "31/4/1998", "4/12/98", "4/12-1998", "4/12/+11998", "4/12/-1998", "-4/12/1998",
    "May 5, 1998", "5 MAY 1998", "May 1998", "5 May 5 May 1998", "5 May March 1998", "5 ‹05› 1998", "5 May 1998 3:05 PM", "May 5, 1998 3:05 pm", "May 5, 1998 15:05:07.1", "5 May 1998 15:05:07.1234567", "5 May 1998 15:5", "Monday 5 May 1998", "5 May 1998, Monday",
    "5 May, 1998 15:05", "5  May 1998", "4/12/1998 24:00", "4/12/1998 3:05 AM PM", "4/12/1998 3:05 Z", "12", "soon", "", None,
]


def alone(text, formats, where):
    """Each format on its own, as text without a name or with its month's name marked."""
    pattern, marks = dates._names(where)
    low = F.lower(text)
    mark = F.element_at(F.create_map(*(F.lit(x) for pair in marks.items() for x in pair)), F.regexp_extract(low, pattern, 1))
    marked = F.when(low.rlike(pattern), F.regexp_replace(low, F.lit(pattern), mark))
    return [dates._parsed(marked if f.named else text, f) for f in sorted(formats, key=lambda f: f.named)]


@pytest.mark.parametrize("culture", ["en-US", "en-GB"])
def test_a_culture_takes_what_its_formats_take(spark, culture):
    where = locale(culture)
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "n int, v string")
    # weekdays and seventh digits go before any format is tried
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("v", r"^Monday ", ""), ", Monday$", ""), r"(\.\d{6})\d$", "$1")
    want = texts.select("n", F.coalesce(*alone(bare, dates.culture_formats(where), where)).cast("string").alias("d"))
    got = texts.select("n", dates.date_of(F.col("v"), None, where).cast("string").alias("d"))
    pairs = {r["v"]: (r["got"], r["want"]) for r in texts.join(got.withColumnRenamed("d", "got"), "n").join(want.withColumnRenamed("d", "want"), "n").collect()}
    assert all(a == b for a, b in pairs.values()), {t: p for t, p in pairs.items() if p[0] != p[1]}
    assert sum(a is not None for a, _ in pairs.values()) > 12


@pytest.mark.parametrize("culture", sorted(LOCALES))
def test_a_row_is_not_tried_by_all_formats(spark, culture):
    """Each try that fails costs an exception, and a branch for each format makes a method too large to be compiled."""
    source = spark.createDataFrame([(1, "soon")], "n long, v string")
    pipeline = Pipeline("t", (("n", "Integer"), ("v", "String")), (FieldMapping("n", "n"), FieldMapping("v", "v")), "n", (Transformation("ConvertToDate", 1, "v"),), (), SourceOptions(culture, None), 2)
    assert len(dates.culture_formats(locale(culture))) > 50
    compiler = Compiler(source, pipeline, "n")
    compiler.run_steps()
    plan = compiler.rows._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.lower().count("gettimestamp(") <= 2
    assert [r["_status"] for r in compile_rows(source, pipeline, "n").collect()] == ["Invalid"]
