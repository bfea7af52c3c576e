"""A stored index of terms: postings sorted by term, lengths and the number of files, upserted by file.

A query's terms are pushed down to the postings, which are sorted by term in files of disjoint ranges, so a search reads
the row groups of its terms and not the corpus. An update writes a new generation and
then names it in one small file, so a failed update changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import core as C
from quarry.operators import search as S


class Postings:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _head(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/CURRENT")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def generation(self) -> str | None:
        fs, at = self._head()
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0] if fs.exists(at) else None

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.generation()}/{table}")

    def _write(self, rows: DataFrame, lengths: DataFrame) -> None:
        old, name = self.generation(), uuid.uuid4().hex
        rows.repartitionByRange("term", "file_id").sortWithinPartitions("term", "file_id").write.parquet(f"{self.path}/{name}/postings")
        lengths.write.parquet(f"{self.path}/{name}/lengths")
        fs, at = self._head()
        out = fs.create(at, True)
        out.write(bytearray(name.encode()))
        out.close()
        if old:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{old}"), True)

    @staticmethod
    def _of(files: DataFrame) -> tuple[DataFrame, DataFrame]:
        return S.term_frequencies(files), files.select("file_id", F.size(C.tokens(F.col("text"))).cast("long").alias("length"))

    def build(self, files: DataFrame) -> Postings:
        """From (file_id, text), anew."""
        self._write(*self._of(files))
        return self

    def update(self, files: DataFrame, gone: DataFrame | None = None) -> Postings:
        """Files (file_id, text) put in place of what was held of them; files (file_id) ``gone`` taken out."""
        out = files.select("file_id") if gone is None else files.select("file_id").unionByName(gone.select("file_id"))
        rows, lengths = self._of(files)
        keep = lambda table: self._read(table).join(out, "file_id", "left_anti")
        self._write(keep("postings").unionByName(rows), keep("lengths").unionByName(lengths))
        return self

    def lookup(self, terms: list[str]) -> DataFrame:
        """(file_id, term, tf) of some terms."""
        return self._read("postings").filter(F.col("term").isin(*terms)) if terms else self._read("postings").limit(0)

    def search(self, query: str, k: int = 10) -> DataFrame:
        """As ``search.lexical_search``, from the index."""
        words = C.query_tokens(query)
        tf = self.lookup(sorted(set(words)))
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        n = max(1, self._read("lengths").count())
        times = F.create_map(*[F.lit(x) for w in sorted(set(words)) for x in (w, words.count(w))]) if words else F.create_map().cast("map<string,int>")
        weight = F.element_at(times, F.col("term")) * F.col("tf") * (F.ln(F.lit(n) / (1 + F.col("df"))) + 1)
        # df has a row for each of the query's terms
        return S.top(tf.join(F.broadcast(df), "term").groupBy("file_id").agg(F.round(F.sum(weight), 6).alias("score")), k)
