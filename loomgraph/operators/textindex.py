"""A stored inverted index of trigrams and words: searches read the postings of their own terms and no row's text.

Postings lie in `parts` folders by a hash of the term, so that a search opens
only its terms' folders, and in these only the row groups that can hold them.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import fresh_path
from .search import RANK_SUM, RANK_WEIGHTS, terms_of, trigrams, trigrams_of


def _part(term: Column, parts: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(parts)).cast("int")


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def words_of(query: str) -> list[str]:
    return sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})


@dataclass(frozen=True)
class TextIndex:
    """An index at a path of rows with an id of a type; `ranks` names the indexed fields in falling order of weight, `kinds` the postings that it has: trigrams for `alike`, words for `bm25` and `weighted`."""

    path: str
    ranks: dict[str, str]
    parts: int = 64
    id_type: str = "string"
    kinds: tuple[str, ...] = ("trigrams", "words")

    @staticmethod
    def build(rows: DataFrame, ranks: dict[str, str], parts: int = 64, path: str | None = None, kinds: tuple[str, ...] = ("trigrams", "words")) -> TextIndex:
        """Written from rows (id, the fields): trigrams (gram, id, field, of), words (term, id, tf, n, weights) and rows, or such of the postings as are asked for. Null ids are left out, null fields have no words; rows that repeat an id count as texts of one row."""
        index = TextIndex(path or fresh_path(rows.sparkSession, "textindex"), ranks, parts, rows.schema["id"].dataType.simpleString(), kinds)
        own = rows.filter("id is not null").select("id", *ranks)
        # the texts of an id come together before they are taken apart, so that no posting is shuffled to find its like; in as many tasks as are set, as few bytes of repeated texts would come into one
        together = own.repartition(_tasks(own), "id").groupBy("id").agg(F.collect_list(F.struct(*ranks)).alias("texts"))

        def marked(x: Column, field: str) -> Column:
            return F.transform(F.array(trigrams(F.coalesce(x[field], F.lit("")))), lambda g: F.transform(g, lambda t: F.struct(t.alias("gram"), F.lit(field).alias("field"), F.size(g).alias("of"))))[0]

        every = F.flatten(F.transform("texts", lambda x: F.concat(*[marked(x, f) for f in ranks])))
        grams = together.select("id", F.explode(F.when(F.size("texts") == 1, every).otherwise(F.array_distinct(every))).alias("x")).select("x.gram", "id", "x.field", "x.of")
        if "trigrams" in kinds:
            index._write(grams, "gram", "trigrams")

        def weighed(field: str, weight: float) -> Column:
            return F.transform(terms_of(F.coalesce(F.col(field), F.lit(""))), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("w")))

        hits = F.concat(*[weighed(f, RANK_WEIGHTS[r]) for f, r in ranks.items()])
        words = together.select("id", F.explode("texts").alias("x")).select("id", "x.*").select("id", hits.alias("h")).withColumn("n", F.size("h")).select("id", "n", F.posexplode("h").alias("i", "x"))
        words = words.groupBy(F.col("x.term").alias("term"), "id", "n").agg(F.count("*").alias("tf"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x.w"))), lambda x: x["w"]).alias("weights"))  # of one row and word
        if "words" in kinds:
            index._write(words, "term", "words")
        own.withColumn("n", F.size(hits)).write.mode("overwrite").parquet(f"{index.path}/rows")
        return index

    def _write(self, postings: DataFrame, term: str, name: str) -> None:
        parted = postings.withColumn("part", _part(F.col(term), self.parts)).repartition(_tasks(postings), "part", F.pmod(F.xxhash64("id"), F.lit(8)))  # a frequent term takes eight tasks
        parted.sortWithinPartitions("part", term).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{name}")

    def postings(self, spark: SparkSession, name: str, terms: list[str]) -> DataFrame:
        """The stored postings of the terms: a filter on their folders, and one that goes down to the scan."""
        if name not in self.kinds:
            raise ValueError(f"the index was built without {name}")
        parts = sorted({zlib.crc32(t.encode()) % self.parts for t in terms})
        key, schema = {"trigrams": ("gram", f"gram string, id {self.id_type}, field string, of int, part int"), "words": ("term", f"term string, id {self.id_type}, n int, tf long, weights array<double>, part int")}[name]
        return spark.read.schema(schema).parquet(f"{self.path}/{name}").filter(F.col("part").isin(parts) & F.col(key).isin(terms))

    def alike(self, spark: SparkSession, query: str, limit: int = 50, least: float = 0.3) -> DataFrame:
        """(id, similarity): as `search.fuzzy_search` over the indexed fields, rows below `least` (above 0) never being counted: they share too few trigrams."""
        grams = trigrams_of(query)
        found = self.postings(spark, "trigrams", grams).groupBy("id", "field", "of").agg(F.count("*").alias("n")).filter(F.col("n") >= math.ceil(least * len(grams) - 1e-9))
        found = found.groupBy("id").agg(F.max(F.round(F.col("n") / (F.col("of") + len(grams) - F.col("n")), 6)).alias("similarity"))
        return found.filter(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(limit)

    def bm25(self, spark: SparkSession, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score): as `search.bm25` over all indexed fields of a row."""
        whole = spark.read.parquet(f"{self.path}/rows").agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
        hits = self.postings(spark, "words", words_of(query))
        seen = hits.groupBy("term").agg(F.count("*").alias("df"))
        joined = hits.join(F.broadcast(seen), "term").crossJoin(F.broadcast(whole))  # a row for each word of the query, and one row
        idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
        return joined.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))

    def weighted(self, spark: SparkSession, query: str, limit: int = 50) -> DataFrame:
        """(id, rank): as `search.weighted_search`, by the ranks of the index."""
        words = words_of(query)
        part = F.aggregate(F.transform("weights", lambda w, i: w / ((i + 1) * (i + 1))), F.lit(0.0), lambda x, y: x + y)
        found = self.postings(spark, "words", words).groupBy("id").agg(F.count("*").alias("words"), F.sum(part).alias("total")).filter(F.col("words") == len(words))
        return found.select("id", F.round(F.col("total") / RANK_SUM / max(1, len(words)), 6).alias("rank")).orderBy(F.desc("rank"), "id").limit(limit)
