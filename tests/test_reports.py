"""Many report templates in one run equal the reports of their filters run alone."""

import json

from conftest import SMALL
from pyspark.sql import functions as F

from mentionlake.functions.scalars import literal_table
from mentionlake.operators import filters
from mentionlake.plans import report
from mentionlake.plans.queries_rows import _doc
from mentionlake.sources import tables as T


def test_templates_equal_single_reports(spark):
    a = _doc(spark, SMALL).cache()
    stored = {1: {"languages": ["en"]}, 2: {"sentiments": ["positive"]}, 3: {"terms": [{"id": "t", "value": "an", "operator": "AND", "exact": False}]}, 4: {"sources": ["nobody"]}, 5: {}}
    templates = literal_table(spark, "template_id int, filters string", [(i, json.dumps(q)) for i, q in stored.items()])
    got = report.run_reports(a, templates, T.ENTITIES, 30, T.AS_OF).collect()
    for i, q in stored.items():
        alone = report.summary_report(filters.search(a, q, T.AS_OF), T.ENTITIES, 30, T.AS_OF).collect()
        assert sorted((r.section, r["rank"], r.label, r.value) for r in got if r.template_id == i) == sorted(map(tuple, alone))
    nothing = {(r.section, r.label): r.value for r in got if r.template_id == 4}
    assert nothing["summary", "Total mentions"] == "0" and set(nothing) == {("summary", "Total mentions"), ("summary", "Unique sources"), *[("sentiment", v) for v in report.SENTIMENTS], *[("share_of_voice", e) for e in T.ENTITIES]}
    a.unpersist()


def test_thousands_of_templates_are_not_refused(spark):
    a = _doc(spark, SMALL)
    templates = spark.range(3000).select(F.col("id").cast("int").alias("template_id"), F.concat(F.lit('{"terms": [{"value": "zz'), "id", F.lit('", "operator": "AND"}]}')).alias("filters"))
    out = report.run_reports(a, templates, T.ENTITIES, 30, T.AS_OF).filter("section = 'summary'")
    assert out.count() == 6000
