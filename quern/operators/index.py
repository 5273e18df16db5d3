"""Keyword retrieval from a stored inverted index: postings in buckets of (corpus, term), sorted by them, changed by upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schemas
from quern.operators import corpus, retrieval
from quern.sources.snapshots import BUCKETS, Snapshots, bucket

POSTINGS = "corpus_id string, term string, path string, ord long, weight double"
#: Terms up to which they are part of the scan's filter.
PUSHED_TERMS = 500


class Index:
    """Sections and their postings as one snapshot: readers see both of the same version."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.store, self.buckets = spark, Snapshots(spark, folder), buckets

    def _bucket(self, *keys: str):
        return bucket(*keys, buckets=self.buckets)

    def _changed(self, rows: DataFrame, *keys: str) -> set[int]:
        """Buckets that rows fall into: at most as many numbers as there are buckets."""
        return {r.b for r in rows.select(self._bucket(*keys).alias("b")).distinct().collect()}

    def sections(self, tables: dict | None = None, buckets: set[int] | None = None) -> DataFrame:
        return self.store.read(tables if tables is not None else self.store.newest()[1], "sections", schemas.SECTIONS, buckets)

    def postings(self, tables: dict | None = None, buckets: set[int] | None = None) -> DataFrame:
        return self.store.read(tables if tables is not None else self.store.newest()[1], "postings", POSTINGS, buckets)

    def build(self, sections: DataFrame) -> int:
        """The first version: all sections and their postings."""
        found = retrieval.section_terms(sections).select("corpus_id", "term", "path", "ord", "weight")
        names = [x.split()[0] for x in schemas.SECTIONS.split(", ")]
        tables = {
            "sections": self.store.write(sections.select(*names), self._bucket("corpus_id", "path")),
            "postings": self.store.write(found, self._bucket("corpus_id", "term"), ["corpus_id", "term"]),
        }
        return self.store.commit(0, tables)

    def upsert(self, written: DataFrame, now: str) -> int:
        """A new version after rows (corpus_id, path, title, summary, tags, content) were written, as `corpus.upsert` has it. Only buckets
        that hold written sections, or terms of what they were and are, are written anew. `Conflict` if another writer was faster.
        """
        version, tables = self.store.newest()
        at = self._changed(written, "corpus_id", "path")
        old = self.sections(tables, at)
        ends = self.sections(tables).groupBy("corpus_id").agg(F.max("ord").alias("_end"))
        new = self.store.write(corpus.upsert(old, written, now, ends), self._bucket("corpus_id", "path"))
        keys = written.select("corpus_id", "path").distinct()
        after = self.spark.read.schema(schemas.SECTIONS).parquet(*new.values()).join(keys, ["corpus_id", "path"], "left_semi")
        gone = retrieval.section_terms(old.join(keys, ["corpus_id", "path"], "left_semi"))
        come = retrieval.section_terms(after)
        names = [x.split()[0] for x in POSTINGS.split(", ")]
        terms = self._changed(gone.select("corpus_id", "term").union(come.select("corpus_id", "term")), "corpus_id", "term")
        stay = self.postings(tables, terms).join(gone.select("corpus_id", "term", "path"), ["corpus_id", "term", "path"], "left_anti")
        rows = stay.select(*names).unionByName(come.select(*names))
        fresh = self.store.write(rows, self._bucket("corpus_id", "term"), ["corpus_id", "term"])
        # a bucket that lost all its rows is no longer named
        kept = {k: v for k, v in tables.get("postings", {}).items() if int(k) not in terms}
        return self.store.commit(version, {"sections": tables.get("sections", {}) | new, "postings": kept | fresh})

    def score(self, queries: DataFrame, tables: dict | None = None) -> DataFrame:
        """As `retrieval.score`, from the postings of the buckets that hold asked terms, and no text is tokenized but the queries'."""
        tables = tables if tables is not None else self.store.newest()[1]
        asked = retrieval.query_terms(queries)
        terms = asked.select("corpus_id", "term").distinct()
        wanted = self.postings(tables, self._changed(terms, "corpus_id", "term"))
        few = terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()
        if len(few) <= PUSHED_TERMS:
            wanted = wanted.where(F.col("term").isin([r.term for r in few]))  # sorted files: row groups without them are passed over
        wanted = wanted.join(terms, ["corpus_id", "term"], "left_semi")
        return retrieval.ranked(wanted, retrieval.idf(wanted, self.sections(tables).select("corpus_id")), asked)

    def retrieve(self, queries: DataFrame, most: int | None = None) -> DataFrame:
        """As `retrieval.retrieve`, over the newest version."""
        tables = self.store.newest()[1]
        return retrieval.retrieve(self.sections(tables), queries, most, lambda asked: self.score(asked, tables))
