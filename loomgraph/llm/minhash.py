"""Near-duplicate documents by MinHash.

Universal hash minima are cut into bands; documents that share a band are
candidates; their signatures and then their full shingle sets confirm a link;
large-star and small-star join the links to components.

Groups of any size stay linear: a bucket links its members to one hub. Where a
bucket still holds several components afterwards, its documents are compared
across components: all of them in buckets of up to `small` documents; beyond
that those that share a shingle of their prefixes (the rarest shingles of a
set, of which any set that is similar enough must share one). Texts move only
for documents that are candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .tables import discard, materialize, tidy, whole_text
from .words import mix, shingle_sets, slices


@dataclass(frozen=True)
class Params:
    """`percent`: a link needs 100 * intersection >= percent * union. `slack`: signatures that agree less than this share are no candidates (over 6 standard deviations below the 0.8 default). A document meets its partners `part` at a time. `filter_bits` bounds the bit map by which texts are preselected."""

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6
    slack: float = 0.62
    seed: int = 11
    small: int = 32
    part: int = 256
    filter_bits: int = 24

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def _minima(sets: list[np.ndarray], p: Params) -> np.ndarray:
    """Signature matrix (non-empty sets x hashes): the top 32 bits of the minima of a*x + b."""
    draw = np.random.default_rng(p.seed).integers(0, 1 << 63, (p.hashes, 2), np.int64).astype(np.uint64)
    sizes = np.array([len(s) for s in sets])
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.empty((len(sets), p.hashes), np.uint32)
    for j, (a, b) in enumerate(draw):
        out[:, j] = np.minimum.reduceat(flat * (a | np.uint64(1)) + b, starts) >> np.uint64(32)
    return out


def _bands(minima: np.ndarray, p: Params) -> np.ndarray:
    """A 64-bit hash of each band of the signatures, the band's number among it."""
    out = np.zeros((len(minima), p.bands), np.uint64)
    for r in range(p.rows):
        out = mix(out ^ mix(minima[:, r :: p.rows].astype(np.uint64) + np.uint64(1)))
    return mix(out + np.arange(p.bands, dtype=np.uint64)[None])


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n_shingles, fp, bands, sig): set size, 128-bit hash of the set, band hashes, and the low byte of each minimum (the last three null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = shingle_sets(batch.column("text"), p.shingle)
                full = [s for s in sets if len(s)]
                minima = _minima(full, p) if full else np.empty((0, p.hashes), np.uint32)
                bands, low = iter(_bands(minima, p).view(np.int64)), iter(minima.astype(np.uint8))
                yield pa.record_batch(
                    [
                        batch.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(bands) if len(s) else None for s in sets], pa.list_(pa.int64())),
                        pa.array([next(low).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "fp", "bands", "sig"],
                )
        tidy()

    return docs.mapInArrow(run, "doc_id long, n_shingles long, fp binary, bands array<long>, sig binary")


def _sized(low: str, high: str, p: Params) -> F.Column:
    """Sets whose sizes differ more than this can't be similar enough."""
    return (F.least(low, high) * 100) >= (F.greatest(low, high) * p.percent)


def _texts_of(texts: DataFrame, ids: DataFrame, p: Params) -> DataFrame:
    """The rows of `texts` whose doc_id is among `ids`; a bit map of 2**filter_bits bits keeps most others from the shuffle."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << p.filter_bits))
    words = ids.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (p.filter_bits - 6), np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            yield batch.filter(pa.array((shared.value[at >> 6] >> (at & 63)) & 1 == 1)).select(["doc_id", "text"])

    likely = texts.withColumn("slot", slot).filter("doc_id is not null").mapInArrow(run, "doc_id long, text string")
    return likely.join(ids, "doc_id", "left_semi")


def _confirm(pairs: DataFrame, texts: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b, n_b) whose signatures and then whole sets are similar enough."""
    sign = lambda side: reps.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
    both = pairs.join(sign("a"), "a").filter(_sized("n_a", "n_b", p)).drop("n_b").join(sign("b"), "b").select("a", "b", "sig_a", "sig_b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, p.hashes) for c in ("sig_a", "sig_b"))
            same = (one == two).mean(1) if batch.num_rows else np.empty(0)
            yield batch.filter(pa.array((same * 256 - 1) / 255 >= p.slack)).select(["a", "b"])  # of unequal minima one in 256 has the same low byte
        tidy()

    likely = materialize(both.mapInArrow(agree, "a long, b long").distinct(), "likely")
    wanted = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).distinct()
    known = materialize(_texts_of(texts, wanted, p), "candidates")
    of = lambda side: known.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.empty(0, np.uint64)
        for whole in batches:
            for batch in slices(whole, "text_b", 1 << 20):
                keep = []
                for i, other in enumerate(shingle_sets(batch.column("text_b"), p.shingle)):
                    first = batch.column("text_a")[i]
                    if first != hub:
                        hub, own = first, shingle_sets(batch.column("text_a").slice(i, 1), p.shingle)[0]
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(common * 100 >= (len(own) + len(other) - common) * p.percent)
                yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
        tidy()

    # a document with many partners meets them in parts, so that no task gets all their texts
    parts = likely.groupBy("a").agg(F.ceil(F.count("*") / p.part).alias("parts"))
    dealt = likely.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    hubs = parts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(of("a"), "a")
    met = dealt.join(of("b"), "b").join(hubs, ["a", "part"]).select("a", "b", "text_a", "text_b")
    found = materialize(met.mapInArrow(compare, "a long, b long").distinct(), "links")
    discard(likely, known)
    return found


def _small_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b, n_b) of the documents of a bucket, from different components, for buckets of bounded size."""
    side = lambda s: members.select("band", F.col("doc_id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("component").alias(f"c_{s}"))
    return side("a").join(side("b"), "band").filter("c_a < c_b").select("a", "b", "n_b").distinct()


def _prefix_pairs(texts: DataFrame, rest: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b, n_b) of documents of `rest` (doc_id, component) in different components that share a shingle of their prefixes.

    All sets are ordered alike: by how many of these documents have a shingle,
    then by the shingle. Two sets of sizes n and m that are similar enough have
    a least overlap, and so a shared shingle among the first n - overlap + 1 of
    the one and as many of the other: each entry bears the largest size of a
    partner that would need it. A shingle that no other document has is in no
    overlap, so it takes a place in the prefix, but no entry.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                sets = shingle_sets(batch.column("text"), p.shingle)
                sizes = [len(s) for s in sets]
                flat = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
                yield pa.record_batch([pa.array(np.repeat(batch.column("doc_id").to_numpy(), sizes), pa.int64()), pa.array(flat), pa.array(np.repeat(np.array(sizes, np.int64), sizes))], ["doc_id", "shingle", "n"])
        tidy()

    every = materialize(materialize(_texts_of(texts, rest.select("doc_id").distinct(), p), "texts").mapInArrow(explode, "doc_id long, shingle long, n long"), "shingles")
    shared = every.groupBy("shingle").agg(F.count("*").alias("rank")).filter("rank > 1")
    sets = every.join(shared, "shingle").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("rank", "shingle"))).alias("x"))
    unique = F.col("n") - F.size("x")
    # entry i (from zero) counts while overlap <= n - i, with overlap = percent * (n + m) / (100 + percent)
    ranked = sets.select("doc_id", "n", unique.alias("unique"), F.posexplode("x.shingle").alias("i", "shingle")).withColumn("i", F.col("i") + F.col("unique"))
    ranked = ranked.withColumn("most", F.floor((F.col("n") - F.col("i")) * (100 + p.percent) / p.percent - F.col("n"))).filter(F.col("most") * 100 >= F.col("n") * p.percent)
    entries = materialize(ranked.join(rest.distinct(), "doc_id").select("doc_id", "n", "shingle", "most", "component"), "prefixes")
    named = lambda s: entries.select("shingle", F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("most").alias(f"most_{s}"), F.col("component").alias(f"c_{s}"))
    met = named("a").join(named("b"), "shingle").filter((F.col("c_a") < F.col("c_b")) & _sized("n_a", "n_b", p) & (F.col("n_a") <= F.col("most_b")) & (F.col("n_b") <= F.col("most_a")))
    return met.select("a", "b", "n_b").distinct()


def _part(parts: F.Column) -> F.Column:
    """Which of so many parts of its band a document is in."""
    return F.pmod(F.xxhash64("doc_id"), parts.cast("long"))


def _in_parts(bands: DataFrame, parts: F.Column) -> DataFrame:
    """A row for each part of a band, so that no task of a join gets all documents of a frequent one."""
    return bands.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))


def near_duplicates(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs` (doc_id, text, ...).

    component_id is the smallest doc_id that links reach, kept tells whether
    it is the row's own. Null, empty and word-less texts have no shingles and
    no links. Rows with one doc_id count as one document with several texts.
    A row whose doc_id is null has no links, a null component and is kept.
    Other columns are ignored; an empty table gives an empty result.
    """
    p = params or Params()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sketch = materialize(sketches(texts, p), "sketches")
    full = sketch.filter("fp is not null and doc_id is not null")
    classes = materialize(full.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), "fp"), ["doc_id", "fp"], "left_semi")
    reps = materialize(reps.select("doc_id", "n_shingles", "bands", "sig"), "reps")

    banded = reps.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    hubs = materialize(banded.groupBy("band").agg(F.min("doc_id").alias("hub"), F.count("*").alias("members")).filter("members > 1"), "hubs")
    # a band is frequent beyond 1/10,000 of the rows, so that at most 10,000 are, whose parts may be broadcast
    usual = max(p.part, (hubs.agg(F.sum("members")).first()[0] or 0) // 10_000 + 1)
    parts = F.ceil(F.col("members") / usual)
    frequent = hubs.filter(F.col("members") > usual).select("band", parts.alias("parts"))
    dealt = banded.join(F.broadcast(frequent), "band", "left").withColumn("part", _part(F.coalesce("parts", F.lit(1)))).drop("parts")
    buckets = materialize(dealt.join(_in_parts(hubs, parts), ["band", "part"]).drop("part"), "buckets")
    pairs = buckets.filter("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b")).distinct()
    links = _confirm(pairs, texts, reps, p)

    # one document may have several texts, each in a class of its own
    own = full.select("doc_id", "fp").join(classes, "fp").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    links = links.union(own.filter("a < b").select("a", "b"))
    found = materialize(connected_components(links, "a", "b"), "components")

    for size, pick in ((F.col("members") <= p.small, _small_pairs), (F.col("members") > p.small, lambda rest: _prefix_pairs(texts, rest.select("doc_id", "component").distinct(), p))):
        labelled = buckets.filter("members > 2").filter(size).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        open_bands = labelled.groupBy("band", "members").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most")
        open_bands = _in_parts(open_bands, parts).select("band", "part")
        rest = materialize(labelled.withColumn("part", _part(parts)).join(open_bands, ["band", "part"], "left_semi").select("band", "doc_id", "n_shingles", "component"), "rest")
        if rest.isEmpty():
            continue
        more = _confirm(pick(rest), texts, reps, p)
        if not more.isEmpty():
            found = materialize(connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "a", "b"), "components")
        discard(rest, more)
    discard(reps, hubs, buckets)

    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("linked"))
    out = sketch.select("doc_id", "n_shingles", "fp").join(named, "fp", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("linked", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, params: Params | None = None) -> DataFrame:
    """`docs` without near duplicates: of each component the rows of its smallest doc_id, and rows without a doc_id."""
    kept = near_duplicates(docs, params).filter("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
