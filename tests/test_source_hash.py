"""A source's hash is streamed over its rows."""

import hashlib

from lodestone.operators import replicate


def test_no_source_is_gathered(spark):
    rows = [("hot", f"text {i}") for i in range(3000)] + [("b", None), ("b", "x"), ("b", "x"), ("", "y"), (None, "z")]
    found = replicate.source_hashes(spark.createDataFrame(rows, "source string, content string").repartition(3))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    expected = {s: md5("|".join(sorted(md5(c or "") for n, c in rows if n == s))) for s in ("hot", "b")}
    assert {r.source: r.hash for r in found.collect()} == expected
    assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
