"""An inverted index that is kept up by segments.

Each ingest adds a segment: postings and lengths of its own documents, written once. A delete adds a list of ids. Segments of like
size are merged when there are enough of them, and what was deleted is left out then. The manifest of a versioned table says which
segments and deletes make up the index, so readers see one state whatever writers do. Statistics add up over segments.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions.text import tokenize
from tarnwick.operators.index import Index, of_vectors
from tarnwick.sources.versions import Version, VersionedTable

#: Segments of one size class that are merged into one; documents of the smallest class.
FAN, SMALLEST = 4, 1000


class SegmentedIndex:
    """Documents are (id, text); an id that is added again replaces what was there. Ids of `kind` (a Spark type)."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "bigint", fan: int = FAN):
        self.spark, self.kind, self.fan = spark, kind, fan
        self.table = VersionedTable(spark, path)
        self.schema = f"doc_id {kind}, dl long, terms array<struct<term:string,tf:long>>"

    def _commit(self, base: Version, segments: list[dict]) -> Version:
        """A segment is a part with its documents' number, and the number of its birth; deletes are parts too."""
        return self.table.commit(base, tuple(s["part"] for s in segments), json.dumps(self.schema), {"segments": segments, "births": base.notes.get("births", 0) + 1})

    def _segments(self, base: Version) -> list[dict]:
        return base.notes.get("segments", [])

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Version:
        """One segment of the documents, which also deletes older ones of the same ids. Null texts are documents without terms, null ids are left out."""
        tokens = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast(self.kind).alias("doc_id"), F.coalesce(tokenize(F.col(text_col)), F.array().cast("array<string>")).alias("tokens")).dropDuplicates(["doc_id"])
        counted = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("term"), F.size(F.filter("tokens", lambda x: x == t)).cast("long").alias("tf")))
        part = self.table.write_part(tokens.select("doc_id", F.size("tokens").cast("long").alias("dl"), counted.alias("terms")))
        n = self.spark.read.parquet(f"{self.table.path}/{part}").count()
        return self.table._retried(lambda base: self._commit(base, [*self._segments(base), {"part": part, "docs": n, "born": base.notes.get("births", 0), "deletes": False}]), 20)

    def delete(self, ids: DataFrame) -> Version:
        """Mark documents as gone; ids: a table whose first column has them."""
        part = self.table.write_part(ids.select(F.col(ids.columns[0]).cast(self.kind).alias("doc_id")).distinct())
        return self.table._retried(lambda base: self._commit(base, [*self._segments(base), {"part": part, "docs": 0, "born": base.notes.get("births", 0), "deletes": True}]), 20)

    def _read(self, segment: dict) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.table.path}/{segment['part']}")

    def _live(self, segments: list[dict], every: list[dict]) -> DataFrame:
        """Rows of `segments` that no later segment or delete of `every` has ended."""
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, (self._read(s).withColumn("_born", F.lit(s["born"])) for s in segments))
        first = min(s["born"] for s in segments)
        ends = [self._read(s).select("doc_id", F.lit(s["born"]).alias("_end")) for s in every if s["born"] > first]
        if not ends:
            return rows.drop("_born")
        last = reduce(DataFrame.unionByName, ends).groupBy("doc_id").agg(F.max("_end").alias("_end"))
        return rows.join(last, "doc_id", "left").filter(F.col("_end").isNull() | (F.col("_end") <= F.col("_born"))).select("doc_id", "dl", "terms")

    def merge(self) -> Version | None:
        """Merge the oldest size class that is full; None if none is. What others add meanwhile stays; a delete that names a
        document of the merged segments came later, so it still counts."""
        base = self.table.version()
        segments = self._segments(base)
        classes: dict[int, list[dict]] = {}
        for s in segments:
            if not s["deletes"]:
                level, size = 0, SMALLEST
                while s["docs"] > size:
                    level, size = level + 1, size * self.fan
                classes.setdefault(level, []).append(s)
        full = next((c for _, c in sorted(classes.items()) if len(c) >= self.fan), None)
        if full is None:
            return None
        part = self.table.write_part(self._live(full, segments))
        n = self.spark.read.parquet(f"{self.table.path}/{part}").count()
        gone = {s["part"] for s in full}
        # born as the youngest of them: what ended any of their rows before has been applied
        made = {"part": part, "docs": n, "born": max(s["born"] for s in full), "deletes": False}

        def once(now: Version) -> Version:
            have = self._segments(now)
            if not gone <= {s["part"] for s in have}:
                raise RuntimeError("another writer has merged these segments")
            rest = [s for s in have if s["part"] not in gone]
            oldest = min([s["born"] for s in rest if not s["deletes"]] + [made["born"]])
            return self._commit(now, [s for s in rest if not s["deletes"] or s["born"] > oldest] + [made])

        return self.table._retried(once, 20)

    def index(self, number: int | None = None) -> Index:
        """The index of a version, else of the latest, as index.build() of the living documents gives it."""
        segments = self._segments(self.table.version(number))
        live = self._live([s for s in segments if not s["deletes"]], segments)
        return of_vectors(live)
