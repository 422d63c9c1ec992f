"""Search over names: trigrams, and BM25 over words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words (letters and digits, lower case), each with two spaces before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigrams_of(text: str) -> list[str]:
    """The same for a text at hand."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)})


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both, 0 if there are none."""
    ratio = lambda p: F.coalesce(F.size(F.array_intersect(p["x"], p["y"])) / F.nullif(F.size(F.array_union(p["x"], p["y"])), F.lit(0)), F.lit(0.0))
    return F.transform(F.array(F.struct(trigrams(a).alias("x"), trigrams(b).alias("y"))), ratio)[0]


def similarity_to(text: Column, grams: list[str]) -> Column:
    """Shared trigrams over all trigrams of the text and of `grams`, 0 if there are none; the text's are made once."""
    query = F.array(*map(F.lit, grams)) if grams else F.array().cast("array<string>")
    shared = lambda own: F.size(F.array_intersect(own, query))
    ratio = lambda own: F.transform(F.array(shared(own)), lambda n: F.coalesce(n / F.nullif(F.size(own) + len(grams) - n, F.lit(0)), F.lit(0.0)))[0]
    return F.transform(F.array(trigrams(text)), ratio)[0]


def fuzzy_search(nodes: DataFrame, query: str, limit: int = 50, least: float = 0.3) -> DataFrame:
    """(id, name, similarity): the `limit` nodes whose name or path is most like the query, ties by id."""
    grams = trigrams_of(query)
    alike = F.greatest(*[similarity_to(F.col(c), grams) for c in ("name", "file_path")])
    best = nodes.select("id", "name", F.round(alike, 6).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(limit)
    return best.filter(F.col("similarity") >= least)  # after the limit, so that no filter works the similarity out again


def contains_search(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose name or path holds the text, whatever the case."""
    return nodes.filter(F.col("name").ilike(f"%{query}%") | F.col("file_path").ilike(f"%{query}%"))


def terms_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25(docs: DataFrame, query: str, key: str = "id", text: str = "name", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of rows that hold a word of the query, by BM25 over all rows."""
    words = sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
    sized = docs.select(key, terms_of(F.col(text)).alias("t")).withColumn("n", F.size("t"))
    whole = sized.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).withColumn("_one", F.lit(1))
    hits = sized.select(key, "n", F.explode(F.filter("t", lambda w: w.isin(words))).alias("term")).groupBy(key, "n", "term").agg(F.count("*").alias("tf"))
    seen = hits.groupBy("term").agg(F.count("*").alias("df"))
    joined = hits.join(F.broadcast(seen), "term").withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one")  # a row for each word of the query, and one row
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    return joined.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))


# Weights of the ranks of fields, and the sum of 1/n^2 over all n.
RANK_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
RANK_SUM = 1.64493406685


def weighted_search(nodes: DataFrame, query: str, ranks: dict[str, str] | None = None, limit: int = 50) -> DataFrame:
    """(id, rank): the `limit` best rows that hold every word of the query in some field, ties by id.

    `ranks` names fields in falling order of weight. Of each word the n-th
    occurrence, in the order of the fields, adds its field's weight over n^2;
    the rank is the mean over the words, so each is 1 at most. Words are not
    stemmed. No word, no rows.
    """
    ranks = ranks or {"name": "A", "file_path": "C"}
    words = sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})
    if not words:
        return nodes.select("id", F.lit(0.0).alias("rank")).limit(0)
    asked = F.array(*map(F.lit, words))

    def hits(field: str, rank: str) -> Column:
        kept = F.filter(terms_of(F.coalesce(F.col(field), F.lit(""))), lambda t: F.array_contains(asked, t))
        return F.transform(kept, lambda t: F.struct(t.alias("t"), F.lit(RANK_WEIGHTS[rank]).alias("w")))

    def part(word: str) -> Column:
        own = F.filter("x", lambda h: h["t"] == word)
        return F.aggregate(F.transform(own, lambda h, i: h["w"] / ((i + 1) * (i + 1))), F.lit(0.0), lambda a, b: a + b)

    found = nodes.select("id", F.concat(*[hits(f, r) for f, r in ranks.items()]).alias("x"))
    found = found.filter(F.size(F.array_distinct("x.t")) == len(words))
    total = sum((part(w) for w in words[1:]), part(words[0]))
    return found.select("id", F.round(total / RANK_SUM / len(words), 6).alias("rank")).orderBy(F.desc("rank"), "id").limit(limit)
