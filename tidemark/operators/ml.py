"""Operators on models, corpora, embeddings, evaluations and experiments."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import gram_hashes, normal_words
from tidemark.operators.components import connected_components
from tidemark.session import materialize, shuffled


def stale_chunks(chunks: DataFrame, index: DataFrame, key: list[str], digest: str) -> DataFrame:
    """Chunks that the index lacks or holds with another digest."""
    had = index.select(*key, F.col(digest).alias("_had"))
    return chunks.join(had, key, "left").where(~F.col(digest).eqNullSafe(F.col("_had"))).withColumn("reason", F.when(F.col("_had").isNull(), "new").otherwise("changed")).drop("_had")


def orphan_vectors(index: DataFrame, chunks: DataFrame, key: list[str]) -> DataFrame:
    return index.join(chunks.select(*key), key, "left_anti")


def centroids(vectors: DataFrame, by: str, embedding: str) -> DataFrame:
    """(by, dim, mean, n): exploded so that dimensions pre-aggregate like any group."""
    return vectors.select(by, F.posexplode(embedding).alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.count("*").alias("n"))


def centroid_shift(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """(by, shift, norm_change) between two `centroids` tables, over the dimensions they share."""
    both = before.select(by, "dim", F.col("mean").alias("b")).join(after.select(by, "dim", F.col("mean").alias("a")), [by, "dim"])
    g = both.groupBy(by).agg(F.sqrt(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))).alias("shift"), F.sqrt(F.sum(F.col("a") * F.col("a"))).alias("na"), F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("nb"))
    return g.select(by, "shift", F.when(F.col("nb") > 0, (F.col("na") - F.col("nb")) / F.col("nb")).alias("norm_change"))


def identifier_overlap(train: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """One row: shared distinct ids, and the share of held-out rows that they make up."""
    marked = held.join(train.select(key).distinct().withColumn("_t", F.lit(1)), key, "left")
    g = marked.agg(F.count_distinct(F.when(F.col("_t") == 1, F.col(key))).alias("n_shared"), F.count("_t").alias("hit"), F.count("*").alias("n"))
    return g.select("n_shared", F.when(F.col("n") > 0, F.col("hit") / F.col("n")).otherwise(0.0).alias("ratio"))


def gram_sets(docs: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, grams): the hashed distinct n-grams of each document that has any, written once."""
    sets = docs.select(F.col(key).alias("key"), gram_hashes(normal_words(F.col(text)), n).alias("grams"))
    return materialize(sets, "gram-sets").where(F.size("grams") > 0)


def gram_containment(items: DataFrame, corpus: DataFrame) -> DataFrame:
    """(item, doc, n_shared, containment): shared grams of items and documents over the item's grams, through a join on the gram; both as `gram_sets`."""
    grams = items.select(F.col("key").alias("item"), F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    pairs = corpus.select(F.col("key").alias("doc"), F.explode("grams").alias("gram")).join(grams, "gram").groupBy("item", "doc", "n").agg(F.count("*").alias("n_shared"))
    return pairs.select("item", "doc", "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


#: Keys up to which tasks are told a list of keys, and rows of keys with their pieces up to which these are broadcast: so many take 32 and some 55 MB.
FEW_KEYS, FEW_ENDS = 4_000_000, 250_000


def _sifted(sets: DataFrame, keys: DataFrame, among: bool) -> DataFrame:
    """The sets whose keys, which are numbers, are or are not among the written ones; only where keys are many are sets shuffled, and then not sorted."""
    if keys.count() > FEW_KEYS:
        return sets.join(shuffled(keys.select("key")), "key", "left_semi" if among else "left_anti")
    told = np.sort(keys.select("key").toArrow()["key"].to_numpy())

    def found(every: pa.Array) -> pa.Array:
        x = every.fill_null(0).to_numpy()  # who has no key has no pairs
        at = np.minimum(np.searchsorted(told, x), len(told) - 1)
        return pa.array((told[at] == x) == among if len(told) else np.full(len(x), not among))

    return sets.where(F.arrow_udf(found, "boolean")("key"))


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of equal gram sets as one: (key, grams) of the least of each class, and (key, first) of the others."""
    marked = materialize(sets.select("key", *[F.xxhash64(F.lit(i), "grams").alias(f"m{i}") for i in (1, 2)]), "marks")
    first = marked.groupBy("m1", "m2").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1")
    members = materialize(marked.join(first, ["m1", "m2"]).where("key <> first").select("key", "first"), "set-classes")
    least = _sifted(sets, members, False)
    return materialize(least, "least-sets") if members.count() > FEW_KEYS else least, members


#: Pairs of a group, and grams of its sets, up to which it is verified in one piece.
PAIRS, GRAMS = 100_000, 1_000_000


def _placed(pairs: DataFrame) -> DataFrame:
    """(w, i, j, a, b): the piece of work in which each of the pairs (a, b, na, nb) is verified.

    Pairs around one set are a group, so that a group of near copies has each of
    its sets once, not once a pair. A large group is cut by its sets, and each
    two of its parts are a piece; small groups share pieces.
    """
    ends = F.inline(F.array(F.struct(F.col("a").alias("key"), F.col("na").alias("n"), F.col("b").alias("other")), F.struct(F.col("b").alias("key"), F.col("nb").alias("n"), F.col("a").alias("other"))))
    least = pairs.select(ends).groupBy("key").agg(F.min(F.least("key", "other")).alias("least"))
    la, lb = (least.select(F.col("key").alias(c), F.col("least").alias(f"l{c}")) for c in ("a", "b"))
    grouped = materialize(pairs.join(la, "a").join(lb, "b").select(F.least("la", "lb").alias("g"), "a", "b", "na", "nb"), "grouped-pairs")
    number = grouped.groupBy("g").agg(F.count("*").alias("pairs"))
    size = grouped.select("g", ends).select("g", "key", "n").distinct().groupBy("g").agg(F.sum("n").alias("size"))
    parts = F.greatest(F.ceil(F.sqrt(F.col("pairs") / PAIRS)), F.ceil(F.col("size") / GRAMS))
    groups = materialize(number.join(size, "g").select("g", "size", parts.alias("parts")), "pair-groups")
    small = groups.where("parts = 1").agg(F.sum("size")).first()[0] or 0
    large = groups.where("parts > 1").select("g", "parts")
    at = [F.pmod(F.xxhash64(c), F.col("parts")) for c in ("a", "b")]
    w = F.coalesce(F.when(F.col("parts") > 1, F.col("g")), F.pmod(F.xxhash64("g"), F.lit(-(-small // GRAMS) or 1)))
    return grouped.join(large, "g", "left").select(w.alias("w"), F.coalesce(F.least(*at), F.lit(-1)).alias("i"), F.coalesce(F.greatest(*at), F.lit(-1)).alias("j"), "a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the written pairs (a, b, na, nb), with their sets' sizes, whose exact similarity reaches the threshold; a set is shuffled once for each piece of work that it has pairs in."""
    placed = materialize(_placed(pairs), "placed-pairs")
    keys = F.explode(F.array("a", "b")).alias("key")
    ends = materialize(placed.select("w", "i", "j", keys).distinct().groupBy("key").agg(F.collect_list(F.struct("w", "i", "j")).alias("at")), "ends")
    met = sets.join(F.broadcast(ends), "key") if ends.count() <= FEW_ENDS else _sifted(sets, ends, True).join(shuffled(ends), "key")
    held = met.select("key", "grams", F.inline("at"))

    def verified(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        keys, grams = sets["key"].to_numpy(), sets["grams"].combine_chunks()
        order = np.argsort(keys)
        a, b = (order[np.searchsorted(keys, pairs[c].to_numpy(), sorter=order)] for c in ("a", "b"))
        sizes = grams.value_lengths().to_numpy().astype(np.int64)
        known, every = np.unique(grams.flatten().to_numpy(), return_inverse=True)
        own, has, shared = np.split(every, np.cumsum(sizes)[:-1]), np.zeros(len(known), bool), np.zeros(len(a), np.int64)
        for at in np.split(by := np.argsort(a, kind="stable"), np.flatnonzero(np.diff(a[by])) + 1):
            has[own[a[at[0]]]] = True
            shared[at] = np.add.reduceat(has[np.concatenate([own[x] for x in b[at]])], np.r_[0, np.cumsum(sizes[b[at]])[:-1]], dtype=np.int64)
            has[own[a[at[0]]]] = False
        jaccard = shared / (sizes[a] + sizes[b] - shared)
        return pa.table({"a": pairs["a"], "b": pairs["b"], "jaccard": jaccard}).filter(pa.array(jaccard >= threshold))

    piece = ["w", "i", "j"]
    return placed.groupBy(*piece).cogroup(held.groupBy(*piece)).applyInArrow(verified, "a long, b long, jaccard double")


#: The commonest grams that are told to every task, at most, the least number of sets that have such a gram, and grams that a task counts at a time.
COMMON, LEAST_COMMON, COUNTED = 200_000, 8, 4_000_000


def _commonest(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The commonest grams, sorted, and about how many sets have each: all from a power of two on, as far as they are few.

    Most grams are in one set. Tasks count all, some millions at a time, and pass
    on those that they saw twice, so rare ones are neither shuffled nor written.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for grams in itertools.chain((b["grams"].flatten().to_numpy() for b in batches), [None]):
            if grams is not None:
                held.append(grams)
            if held and (grams is None or sum(map(len, held)) >= COUNTED):
                gram, df = np.unique(np.concatenate(held), return_counts=True)
                held = []
                yield pa.RecordBatch.from_arrays([pa.array(gram[df > 1]), pa.array(df[df > 1])], names=["gram", "df"])

    seen = sets.select("grams").mapInArrow(counted, "gram long, df long")
    freq = materialize(seen.groupBy("gram").agg(F.sum("df").alias("df")).where(F.col("df") >= LEAST_COMMON), "gram-counts")
    most, cut = 0, 64
    for r in sorted(freq.groupBy(F.floor(F.log2("df")).alias("power")).count().collect(), reverse=True):
        most += r["count"]
        if most > COMMON:
            break
        cut = r["power"]
    rows = freq.where(F.col("df") >= 2.0**cut).orderBy("gram").toArrow()
    return rows["gram"].to_numpy(), rows["df"].to_numpy()


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, n, gram, left): the first grams of each set, and how many it has from there on.

    The order is one for all sets, or prefixes would miss pairs: the commonest
    grams come last, by their number, and others as they are, which are hashes.
    """
    common, number = _commonest(sets)

    def first(grams: pa.Array) -> pa.Array:
        every, sizes = grams.flatten().to_numpy(), grams.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, every), len(common) - 1)
            df = np.where(common[at] == every, number[at], 0)
        else:
            df = np.zeros(len(every), np.int64)
        order = np.lexsort((every, df, np.repeat(np.arange(len(sizes)), sizes)))
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(every))
        length = np.where(sizes > 0, sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1, 0)
        keep = np.repeat(sizes, sizes) - left < np.repeat(length, sizes)
        rows = pa.StructArray.from_arrays([pa.array(every[order][keep]), pa.array(left[keep].astype(np.int32))], names=["gram", "left"])
        return pa.ListArray.from_arrays(np.cumsum(np.r_[0, np.minimum(length, sizes)]).astype(np.int32), rows)

    made = sets.select("key", F.size("grams").alias("n"), F.arrow_udf(first, "array<struct<gram:bigint,left:int>>")("grams").alias("x"))
    return made.select("key", "n", F.inline("x"))


def jaccard_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the different gram sets that reach the threshold, each named by its least document.

    Grams have an order that puts common ones last; two sets of Jaccard t share a
    gram among the first n - ceil(t n) + 1 of each, so only those prefixes are
    shuffled and joined, and only where the sizes and the places of the gram
    still allow t.
    """
    alike, before = F.count("*").over(W.partitionBy("gram")), W.partitionBy("key").orderBy(F.desc("left"))
    kept = _prefixes(sets, threshold).withColumn("alike", alike).where("alike > 1").drop("alike")
    prefix = materialize(kept.withColumns({f"p{i}": F.lag("gram", i).over(before) for i in (1, 2)}), "prefixes")
    a, b = (prefix.select("gram", *[F.col(x).alias(f"{y}{c}") for x, y in (("key", ""), ("n", "n"), ("left", "l"), ("p1", "p"), ("p2", "q"))]) for c in ("a", "b"))
    # What a pair can share from its first common gram on must be enough; at later ones, told by those before them, it would only be made again.
    enough = (1 + threshold) * F.least("la", "lb") >= threshold * (F.col("na") + F.col("nb")) - 1e-9
    later = F.greatest(*[F.coalesce(F.col(x) == F.col(y), F.lit(False)) for x in ("pa", "qa") for y in ("pb", "qb")])
    sized = a.join(b, "gram").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & enough & ~later)
    return _similar(materialize(sized.select("a", "b", "na", "nb").distinct(), "near-pairs"), sets, threshold)


#: Grams that are hashed at a time, so that they stay in a core's cache.
AT_ONCE = 32_768


def minhash(sets: DataFrame, permutations: int = 128) -> DataFrame:
    """(key, n, signature): how many grams, and the least of them, which are hashes, under each of so many multiplications and shifts."""
    draws = np.random.default_rng(42).integers(0, 1 << 64, (2, permutations), np.uint64)
    factors, shifts = draws[0] | np.uint64(1), draws[1]

    def signed(grams: pa.Array) -> pa.Array:
        every, ends = grams.flatten().to_numpy().view(np.uint64), np.cumsum(grams.value_lengths().fill_null(0).to_numpy())
        starts = np.r_[0, ends[:-1]]
        out = np.full((len(grams), permutations), (1 << 64) - 1, np.uint64)
        full = np.flatnonzero(ends > starts)
        for rows in np.split(full, np.flatnonzero(np.diff(starts[full] // AT_ONCE)) + 1):
            if len(rows):
                own = every[starts[rows[0]] : ends[rows[-1]]]
                for p in range(permutations):
                    out[rows, p] = np.minimum.reduceat(own * factors[p] + shifts[p], starts[rows] - starts[rows[0]])
        return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * permutations, out.view(np.int64).ravel())

    return sets.select("key", F.size("grams").alias("n"), F.arrow_udf(signed, "array<bigint>")("grams").alias("signature"))


#: Rounds in which the members of buckets meet one of them, and pairs that are left a row of the buckets at which these end.
STARS, FEW_PAIRS = 4, 2


def _verified(met: DataFrame, signatures: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The links among pairs that met; those whose estimate is over four deviations (of 128 rows) below the threshold are not verified."""
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    sa, sb = (signatures.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("signature").alias(f"s{c}")) for c in ("a", "b"))
    near = met.join(sa, "a").join(sb, "b").where(same >= (threshold - 0.15) * F.size("sa")).select("a", "b", "na", "nb")
    return materialize(_similar(materialize(near, "lsh-pairs"), sets, threshold), "links")


def lsh_links(sets: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """(a, b, jaccard): links enough to connect what all pairs of gram sets do that agree in a band of their signatures and whose exact similarity reaches the threshold.

    First all members of a bucket meet one of them, anew as long as that connects
    more; then whoever is not in a bucket's largest component meets all that are
    in others. A pair within a component would connect nothing, so a group of m
    near copies takes about m pairs, not m squared.
    """
    if threshold < (1 / bands) ** (1 / rows) - 0.15:
        raise ValueError(f"{bands} bands of {rows} rows miss pairs at {threshold}")
    signatures = materialize(minhash(sets, bands * rows), "signatures")
    slices = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice("signature", b * rows + 1, rows)))
    every = signatures.select("key", F.explode(slices).alias("h"))
    buckets = materialize(every.join(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "h"), "buckets")
    size, before, links, now = buckets.count(), math.inf, None, buckets.withColumn("part", F.col("key"))
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    for turn in range(STARS):
        lead = now.groupBy("h").agg(F.min_by(F.struct("key", "part"), F.xxhash64("part", F.lit(turn))).alias("lead"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("h", "lead")
        met = now.join(lead, "h").where("part <> lead.part").select(*pair("key", "lead.key")).distinct()
        found = _verified(met, signatures, sets, threshold)
        grew = found.take(1)
        links = found if links is None else links.unionByName(found)
        parts = connected_components(links, "a", "b").withColumnsRenamed({"node": "key", "component": "part"})
        now = materialize(buckets.join(parts, "key", "left").withColumn("part", F.coalesce("part", "key")), "bucket-parts")
        held = now.groupBy("h", "part").agg(F.count("*").alias("n"))
        most = materialize(held.groupBy("h").agg(F.max_by("part", F.struct("n", "part")).alias("most"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0"), "open-buckets")
        left = most.agg(F.coalesce(F.sum(F.col("all") * F.col("others")), F.lit(0))).first()[0]
        if not grew or left <= FEW_PAIRS * size or left > before / 2:
            break
        before = left
    if not left:
        return links
    apart = now.join(most.select("h", "most"), "h")
    a, b = apart.where("part <> most").select("h", F.col("key").alias("x"), F.col("part").alias("px")), apart.select("h", F.col("key").alias("y"), F.col("part").alias("py"))
    rest = a.join(b, "h").where("px <> py").select(*pair("x", "y")).distinct()
    return links.unionByName(_verified(rest, signatures, sets, threshold))


def clusters(links: DataFrame, members: DataFrame) -> DataFrame:
    """(node, component) of linked documents; links join class representatives (a, b), members have key and first."""
    return connected_components(links.select("a", "b").unionByName(members.select(F.col("first").alias("a"), F.col("key").alias("b"))), "a", "b")


def pareto(trials: DataFrame, key: str, minimize: str, maximize: str) -> DataFrame:
    """Trials that none beats on both: a running best over sorted costs, so no trial is paired with all others."""
    best = trials.groupBy(minimize).agg(F.max(maximize).alias("top"))
    w = W.orderBy(minimize).rowsBetween(W.unboundedPreceding, -1)
    front = best.withColumn("before", F.max("top").over(w)).where("before is null or top > before").select(minimize, F.col("top").alias(maximize))
    return trials.join(front, [minimize, maximize], "left_semi")


def scaling_fit(points: DataFrame, x: str, y: str, irreducible: float = 0.0) -> DataFrame:
    """One row: exponent, coefficient and residual of y = irreducible + a x**-b, by least squares in logarithms."""
    lx, ly = F.ln(F.col(x).cast("double")), F.ln(F.col(y) - F.lit(irreducible))
    g = points.where((F.col(x) > 0) & (F.col(y) > irreducible)).agg(F.regr_slope(ly, lx).alias("s"), F.regr_intercept(ly, lx).alias("i"), F.count("*").alias("n"), F.regr_sxx(ly, lx).alias("sxx"), F.regr_syy(ly, lx).alias("syy"), F.regr_sxy(ly, lx).alias("sxy"))
    left = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    return g.select((-F.col("s")).alias("exponent"), F.exp("i").alias("coefficient"), F.sqrt(left / F.col("n")).alias("rmse"), "n")


def gini(shares: DataFrame, share: str) -> DataFrame:
    """One row: the Gini coefficient and top share; the values are ranked through a range shuffle of their counts."""
    g = shares.groupBy(F.col(share).cast("double").alias("x")).agg(F.count("*").alias("k"))
    w = W.orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    r = g.withColumn("before", F.coalesce(F.sum("k").over(w), F.lit(0)))
    weighted = F.col("x") * (F.col("k") * F.col("before") + F.col("k") * (F.col("k") + 1) / 2)
    t = r.agg(F.sum(weighted).alias("wx"), F.sum(F.col("x") * F.col("k")).alias("s"), F.sum("k").alias("n"), F.max("x").alias("top"))
    return t.select((2 * F.col("wx") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"), (F.col("top") / F.col("s")).alias("top_share"))


def agreement(labels: DataFrame, item: str, by: str, value: str, a: object, b: object) -> DataFrame:
    """One row: items that two annotators share and the share on which they agree."""
    x = labels.where(F.col(by) == a).select(item, F.col(value).alias("_a"))
    y = labels.where(F.col(by) == b).select(item, F.col(value).alias("_b"))
    return x.join(y, item).agg(F.count("*").alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("agreement"))


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """Each fact with the last version not after it: one window over both, so no fact meets all versions."""
    f = facts.select("*", F.lit(1).alias("_fact"), F.lit(None).cast(versions.schema[value].dataType).alias("_v"), F.col(at).alias("_t"))
    v = versions.select(F.col(key), F.lit(0).alias("_fact"), F.col(value).alias("_v"), F.col(since).alias("_t"))
    w = W.partitionBy(key).orderBy("_t", "_fact").rowsBetween(W.unboundedPreceding, W.currentRow)
    return f.unionByName(v, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_fact = 1").drop("_fact", "_v", "_t")


def metric_changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta) of the metrics that both have."""
    return before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key).withColumn("delta", F.col("after") - F.col("before"))


def keep_last(checkpoints: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """Checkpoints that a keep-last-n rule lets go."""
    return checkpoints.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_r") > n).drop("_r")


def epoch_pressure(mixture: DataFrame, available: DataFrame, budget: float) -> DataFrame:
    """(source, required, available, epochs, repeats): how often a mixture runs through each source; no supply is unknown."""
    m = mixture.join(available, "source", "left")
    required = F.col("weight") * F.lit(budget)
    epochs = F.when(F.col("available") > 0, required / F.col("available"))
    return m.select("source", required.alias("required"), "available", epochs.alias("epochs"), F.coalesce(epochs > 1, F.lit(False)).alias("repeats"))
