"""Section volumes on small lines."""

from cragspan.operators import survey
from cragspan.plans import surfaces as queries

SF = "/root/testdata/sf0.001"


def test_prismoidal(spark):
    lines = {
        "good": [(2.0 * k, (2.0 * k) ** 2) for k in range(5)],
        "even": [(float(k), 1.0) for k in range(4)],
        "gap": [(0.0, 1.0), (1.0, 1.0), (3.0, 1.0)],
        "twice": [(0.0, 1.0), (0.0, 1.0), (1.0, 1.0)],
        "few": [(0.0, 1.0)],
        "null": [(0.0, 1.0), (1.0, None), (2.0, 1.0)],
        "negative": [(0.0, 1.0), (1.0, -1.0), (2.0, 1.0)],
    }
    df = spark.createDataFrame([(k, *x) for k, v in lines.items() for x in v], "line string, station double, area double")
    got = {r.line: (r.volume, r.sections, r.problem) for r in survey.prismoidal(df).collect()}
    assert abs(got.pop("good")[0] - 8**3 / 3) < 1e-9
    problems = {"even": "even", "gap": "spacing", "twice": "spacing", "few": "few", "null": "value", "negative": "value"}
    assert got == {k: (None, len(lines[k]), p) for k, p in problems.items()}
    assert {r.line: r.problem for r in survey.prismoidal(df, 1.0).collect()}["good"] == "spacing"


def test_prismoidal_uses_every_section(spark):
    used = {r.line: r.sections for r in queries.QUERIES["prismoidal_sections"](spark, SF).collect()}
    assert used == {r.line: r.sections for r in queries.QUERIES["average_end_area"](spark, SF).collect()}
