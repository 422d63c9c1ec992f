"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets are measured in words. Blocks of equally many words go to the sources
by highest quotients, and each source's blocks in the same way to its shards.
A shard takes its documents' words as often as its quota allows, and of the
rest a seeded choice of blocks. About sqrt(n) shards of sqrt(n) documents make
a source of n documents, so that neither a shard nor a source's list of shards
gets large.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize, numbered, unused, whole_text
from .words import WORD


#: Primes, one of which is the step from a block to the next in a shard's seeded order.
STEPS = (7919, 6151, 5003, 4001, 3079, 2003, 1543, 1009, 769, 523, 389, 271, 193, 139, 97, 71, 53, 41, 31, 23, 17)


@dataclass(frozen=True)
class Params:
    """The mix has `share` times all words; sources in order weigh `weights`, repeating, and give `most` times their words at most."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    share: float = 1.5
    most: int = 2
    block_words: int = 32
    seed: int = 23


def apportioned(votes: DataFrame, seats: int) -> DataFrame:
    """(key, seats) of (key, votes): seats by the highest quotients votes / (2 * own seats + 1); ties go to the lesser key. No votes, no seats.

    Rounding the shares gives what so many seats would give by quotients; those
    that are missing go by the highest next quotients, those that are too many
    by the lowest last ones, of which each key offers as many as it could win
    or lose.
    """
    whole = votes.agg(F.sum(F.greatest("votes", F.lit(0.0))).alias("v")).first()["v"] or 0.0
    if seats <= 0 or not whole:
        return votes.select("key", F.lit(0).cast("long").alias("seats"))
    share = F.greatest("votes", F.lit(0.0)) / whole
    base = materialize(votes.select("key", F.greatest("votes", F.lit(0.0)).alias("votes"), share.alias("share"), F.floor(share * seats + 0.5).alias("got")), "seats")
    left = seats - base.agg(F.sum("got").alias("n")).first()["n"]
    if not left:
        return base.select("key", F.col("got").alias("seats"))
    offers = base.filter("votes > 0").withColumn("step", F.explode(F.sequence(F.lit(0), (2 * F.ceil(F.lit(abs(left)) * F.col("share")) + 2).cast("int"))))
    last = F.col("got") - F.col("step")
    order = -F.col("votes") / (2 * (F.col("got") + F.col("step")) + 1) if left > 0 else F.when(last > 0, F.col("votes") / (2 * last - 1))
    offers = offers.select("key", "step", order.alias("order")).filter("order is not null")
    placed, _ = numbered(offers, [F.col("order"), F.col("key") if left > 0 else F.desc("key"), F.col("step")], "place")
    moved = placed.filter(F.col("place") < abs(left)).groupBy("key").agg(F.count("*").alias("n"))
    sign = 1 if left > 0 else -1
    return base.join(moved, "key", "left").select("key", (F.col("got") + sign * F.coalesce("n", F.lit(0))).alias("seats"))


def source_quotas(totals: DataFrame, p: Params) -> DataFrame:
    """(source, key, source_size, target, full, blocks, shards) of totals (source, source_size, rows): targets, blocks (none if full: the source gives all that it may) and the number of shards.

    Sources are numbered by code point, null last, and stay distributed. A level
    of words for a weight of one rises until the sources that it would take
    beyond their most are those that it is worked out without; each round is an
    aggregate of the totals.
    """
    placed, _ = numbered(totals, [F.col("source").asc_nulls_last()], "key")
    weights = F.array(*[F.lit(float(w)) for w in p.weights])
    sized = materialize(placed.withColumns({"weight": F.element_at(weights, (F.col("key") % len(p.weights) + 1).cast("int")), "most": F.col("source_size") * p.most}), "sources")
    whole = sized.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w")).first()
    total, level, free, stopped, over = p.share * whole["n"], 0.0, whole["w"], 0, 0
    while free > 0:
        level = (total - stopped) / free
        above = F.col("weight") * level > F.col("most")
        row = sized.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)).alias("stopped"), F.count_if(above).alias("over"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)).alias("free")).first()
        if row["over"] == over:
            break
        stopped, over, free = row["stopped"], row["over"], row["free"]
    goal = F.least(F.col("most").cast("double"), F.col("weight") * level) if free > 0 else F.col("most").cast("double")
    aimed = materialize(sized.withColumn("target", goal).withColumn("full", F.col("target") >= F.col("most")), "targets")
    wanted = (aimed.filter("not full").agg(F.sum("weight").alias("w")).first()["w"] or 0.0) * level
    blocks = apportioned(aimed.filter("not full").select("key", F.col("target").alias("votes")), round(wanted / p.block_words))
    shards = F.ceil(F.sqrt(F.col("rows"))).cast("long")
    return aimed.join(blocks, "key", "left").select("source", "key", "source_size", "target", "full", F.coalesce("seats", F.lit(0)).cast("long").alias("blocks"), shards.alias("shards"))


def _shard_quotas(shards: DataFrame, p: Params) -> DataFrame:
    """(key, shard, shard_size, quota) of (key, shard, shard_size, target, full, blocks of the source): the words a shard has to give.

    Rounding by one divisor gives each shard its blocks; the blocks that the
    source has more go by the highest next quotients, those it has less by the
    lowest last ones. A shard is asked for as many as it could win or lose.
    """
    source = Window.partitionBy("key")
    size, total = F.col("shard_size"), F.sum("shard_size").over(source)
    base = shards.withColumn("votes", F.coalesce(F.try_divide(size, total), F.lit(0.0))).withColumn("got", F.floor(F.col("votes") * F.col("blocks") + 0.5))
    base = base.withColumn("left", F.col("blocks") - F.sum("got").over(source))
    steps = base.filter("left <> 0 and shard_size > 0").withColumn("step", F.explode(F.sequence(F.lit(0), (2 * F.ceil(F.abs("left") * F.col("votes")) + 2).cast("int"))))
    last = F.col("got") - F.col("step")
    steps = steps.withColumn("order", F.when(F.col("left") > 0, -size / (2 * (F.col("got") + F.col("step")) + 1)).when(last > 0, size / (2 * last - 1))).filter("order is not null")
    place = F.row_number().over(Window.partitionBy("key").orderBy("order", "shard", "step"))
    won = steps.withColumn("place", place).filter(F.col("place") <= F.abs("left")).groupBy("key", "shard").agg(F.sum(F.signum("left")).cast("long").alias("more"))
    most = p.most * size
    words = F.when(F.col("full"), most).otherwise(F.least(most, (F.col("got") + F.coalesce("more", F.lit(0))) * p.block_words)).cast("long")
    quotas = base.join(won, ["key", "shard"], "left").select("key", "shard", "shard_size", "target", words.alias("quota"))
    # what the blocks differ from the target, less than one block mostly, goes to the largest shards that have room for it
    rest = F.round("target").cast("long") - F.sum("quota").over(source)
    room = F.when(F.col("rest") > 0, most - F.col("quota")).otherwise(F.col("quota"))
    line = Window.partitionBy("key").orderBy(F.desc("shard_size"), "shard")
    quotas = quotas.withColumn("rest", rest).withColumn("room", room)
    before = F.coalesce(F.sum("room").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.least(F.col("room"), F.greatest(F.lit(0), F.abs("rest") - before)) * F.signum("rest").cast("long")
    return quotas.select("key", "shard", "shard_size", (F.col("quota") + part).alias("quota"))


def plan(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, pieces) for each row of `docs` (doc_id, source, text, ...).

    pieces are the words taken besides `times` whole copies: (from, to) word
    positions, in order, counting from zero. Null and empty texts have no words
    and give none. A null source is a source of its own, the last. The same
    rows give the same mix, in whatever order or partitions they come; rows
    that repeat count each, and their shares may be changed among them.
    """
    p = params or Params()
    spark, words = docs.sparkSession, F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), F.xxhash64("text").alias("mark"))
    rows = materialize(rows, "sizes")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = materialize(source_quotas(totals, p), "sources")
    dealt = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop("source")
    draw = F.xxhash64("doc_id", "mark", F.lit(p.seed))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(p.seed + 1)), F.col("shards"))).withColumn("draw", draw)
    shards = materialize(_shard_quotas(dealt.groupBy("key", "shard", "target", "full", "blocks").agg(F.sum("size").alias("shard_size")), p), "quotas")
    line = Window.partitionBy("key", "shard").orderBy("draw", "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0))).join(shards, ["key", "shard"])
    # Of a shard's words the quota takes `times` all, then `rest` words: a seeded choice of whole blocks and the beginning of one more.
    n = F.col("shard_size")
    placed = placed.withColumn("times", F.when(n > 0, F.floor(F.col("quota") / n)).otherwise(0).cast("long")).withColumn("rest", F.col("quota") - F.col("times") * n)
    placed = placed.withColumn("whole", F.floor(n / p.block_words).cast("long")).withColumn("chosen", F.floor(F.col("rest") / p.block_words).cast("long"))
    # the place of block b in the seeded order is (b * odd + shift) mod whole, odd being prime to it; seeds choose both; the block after the whole ones comes last
    prime = F.filter(F.array(*map(F.lit, STEPS)), lambda q: F.col("whole") % q != 0)
    ratio = F.coalesce(F.try_element_at(prime, (F.pmod(F.xxhash64("key", "shard", F.lit(p.seed + 3)), F.greatest(F.size(prime), F.lit(1))) + 1).cast("int")), F.lit(1))
    placed = placed.withColumn("odd", ratio).withColumn("shift", F.pmod(F.xxhash64("key", "shard", F.lit(p.seed + 2)), F.greatest("whole", F.lit(1))))
    block = F.sequence(F.floor(F.col("start") / p.block_words), F.floor((F.col("start") + F.col("size") - 1) / p.block_words))

    def piece(b: F.Column) -> F.Column:
        place = F.when(b < F.col("whole"), F.pmod(b * F.col("odd") + F.col("shift"), F.greatest("whole", F.lit(1)))).otherwise(F.col("whole"))
        length = F.when(place < F.col("chosen"), p.block_words).when(place == F.col("chosen"), F.col("rest") - F.col("chosen") * p.block_words).otherwise(0)
        begin = b * p.block_words
        return F.struct((F.greatest(begin, F.col("start")) - F.col("start")).alias("from"), (F.least(begin + length, F.col("start") + F.col("size")) - F.col("start")).alias("to"))

    pieces = F.when((F.col("size") > 0) & (F.col("rest") > 0), F.filter(F.transform(block, piece), lambda x: x["from"] < x["to"])).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>"))
    placed = placed.withColumn("pieces", pieces)
    taken = F.col("times") * F.col("size") + F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["to"] - x["from"])
    return placed.select("doc_id", "mark", "size", "source_size", "target", taken.alias("taken"), "times", "pieces")


def mix(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """The mixed documents, with the columns of `docs`: a row for each whole copy, and one with the words of the taken blocks.

    A text of blocks keeps the white space between its words, a line break
    stands between blocks that don't touch, and n_chars, where it is a column,
    is counted anew. Documents of which nothing is taken are left out.
    """
    key, mark, number, times, pieces = (unused(docs, n) for n in ("key", "mark", "number", "times", "pieces"))
    planned = plan(docs, params).filter("taken > 0")
    keyed = docs.withColumns({mark: F.xxhash64("text"), key: F.col("doc_id").cast("long")})
    match = keyed[key].eqNullSafe(planned["doc_id"]) & (keyed[mark] == planned["mark"])
    if not planned.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():  # rows that repeat get one plan each
        planned = planned.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("times", F.xxhash64("pieces"))))
        keyed = keyed.withColumn(number, F.row_number().over(Window.partitionBy(key, mark).orderBy("source")))
        match = keyed[key].eqNullSafe(planned["doc_id"]) & (keyed[mark] == planned["mark"]) & (keyed[number] == planned["number"])
    joined = keyed.join(planned, match).select(*[keyed[c] for c in docs.columns], planned["times"].alias(times), planned["pieces"].alias(pieces))
    text, words = F.col("text"), F.regexp_extract_all("text", F.lit(f"{WORD}[ \\t-\\r]*"), F.lit(0))

    def grown(runs: F.Column, piece: F.Column) -> F.Column:
        """The runs with one more piece, which goes on the last run if it touches it."""
        last = F.element_at(runs, -1)
        joined = F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(F.struct(last["from"].alias("from"), piece["to"].alias("to"))))
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["to"] == piece["from"]), joined).otherwise(F.concat(runs, F.array(piece)))

    runs = F.aggregate(pieces, F.array().cast("array<struct<from:bigint,to:bigint>>"), grown)
    joined_words = lambda w, r: F.regexp_replace(F.array_join(F.slice(w, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")), ""), r"[ \t-\r]+$", "")
    cut = F.transform(F.array(words), lambda w: F.transform(runs, lambda r: joined_words(w, r)))[0]  # so that a text is cut into words once
    part = F.when(F.size(pieces) > 0, F.array(F.array_join(cut, "\n"))).otherwise(F.array().cast("array<string>"))
    copies = F.explode(F.concat(F.array_repeat(text, F.col(times).cast("int")), part))
    out = joined.withColumn("text", copies)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
