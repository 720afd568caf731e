"""Export in pages from ordered files: an offset opens the files that hold it, and nothing is sorted for a page."""

from __future__ import annotations

import json
import re
import uuid
from bisect import bisect_right
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators import replicate
from lodestone.operators.commits import Commits

#: Rows of a file.
EACH = 100_000
MOST = 3000


class Pages:
    """``root/rows/<name>`` in order, with a log that names a version's files and their rows in that order."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.commits = Commits(spark, root)

    def write(self, rows: DataFrame, order: str, each: int = EACH) -> int:
        """A version of ``rows`` in the order of a column that tells rows apart. Readers go on with theirs."""
        name = str(uuid.uuid4())
        ranged = rows.repartitionByRange(order).sortWithinPartitions(order)
        ranged.write.option("maxRecordsPerFile", each).parquet(f"{self.root}/rows/{name}")
        counted = self.spark.read.schema(rows.schema).parquet(f"{self.root}/rows/{name}").groupBy(F.col("_metadata.file_name").alias("name")).count()
        files = sorted(((r[0], r[1]) for r in counted.toLocalIterator()), key=lambda f: [int(x) for x in re.match(r"part-(\d+)-.*-c(\d+)\.", f[0]).groups()])
        return self.commits.commit(self.commits.version() + 1, {"folder": name, "order": order, "schema": rows.schema.json(), "files": files})

    def page(self, offset: int, limit: int, version: int | None = None) -> DataFrame:
        """``limit`` rows from ``offset`` on, each with ``total`` and ``has_more``; the version stays that of the first page if it is given."""
        if not 1 <= limit <= MOST or offset < 0:
            raise ValueError(f"limit must lie in 1..{MOST} and offset must not be negative")
        told = self.commits.read(version or self.commits.version())
        schema, sizes = StructType.fromJson(json.loads(told["schema"])), [n for _, n in told["files"]]
        ends = list(accumulate(sizes))
        total, parts = ends[-1] if ends else 0, []
        for i in range(bisect_right(ends, offset), len(ends)):
            start = ends[i] - sizes[i]
            if start >= offset + limit:
                break
            rows = self.spark.read.schema(schema).parquet(f"{self.root}/rows/{told['folder']}/{told['files'][i][0]}")
            at = F.col("_metadata.row_index") + start
            parts.append(rows.filter((at >= offset) & (at < offset + limit)))
        found = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)
        return found.withColumns({"total": F.lit(total).cast("bigint"), "has_more": F.lit(offset + limit < total)})

    def page_without_repeats(self, offset: int, limit: int, key: str, version: int | None = None) -> DataFrame:
        """``page``, less rows whose ``key`` an earlier row of the page has."""
        told = self.commits.read(version or self.commits.version())
        return replicate.first_of(self.page(offset, limit, version), told["order"], key)
