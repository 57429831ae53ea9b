"""MinHash near-duplicate detection: universal hash minima, banding, signature verification, star components.

Steps, each a Spark job over written tables:

1. one pass over the texts gives each document the size and a 128-bit digest of its shingle set and its MinHash
   signature; documents with equal sets form one class, named by its smallest id (copies are never paired);
2. class signatures are cut into bands; classes meeting in a band bucket are candidates;
3. candidates are compared as stars, not as all pairs: every member with one hub of its bucket, the member that meets
   most others over all its bands (of a group of edited copies, that is the original). Candidates and pairs too rich in
   shingles that no other candidate has are left out, exactly. The others pass a signature check and
   are confirmed on the full shingle sets; confirmed links are merged by alternating large-star/small-star;
4. a further star round with hubs of the largest component looks only at buckets that still hold several components,
   and a last exhaustive round compares, in those buckets, every member outside the largest component with every member
   of another component, by size and by one bit of each signature row inside the join. So no link between two
   components is lost, a bucket of one component costs nothing more, and unlike members of a bucket are never paired.

The bands are chosen so that a pair at the threshold is missed with probability below ``MISS``.
Defined cases: a null, empty or word-less text has the empty set and is linked with nothing; a text with fewer words
than a shingle has its whole word sequence as the one shingle; a row without a ``doc_id`` cannot be named by a link,
so it stays alone (its component is null, it is kept); rows repeating a ``doc_id`` are one document;
very long texts are read whole; ties between hubs go to the smaller id; an empty table gives an empty result; further columns
of the input, whatever their names, are not read, and ``one_of_each`` passes them through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, blocks, fresh, global_rank

ROWS = 5                 # signature rows of a band
MISS = 1e-8              # probability that a pair at the threshold shares no band
SIGMAS = 6               # signature check: so many standard errors below the threshold still go to the full check
STAR_ROUNDS = 2
RARE = 64                # rarest shingles of a member that the last round compares
SKETCH_BITS = 60         # signature rows whose last bits share a number of the sketch
SEED = 20240817
WORD_CACHE = 200_000     # distinct words whose hashes a task remembers
MULT = np.uint64(0x9E3779B97F4A7C15)
COLUMNS = 4096           # shingles hashed at once, so that a very long text needs little memory


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text (A-Z lower-cased)."""

    def __init__(self, size: int):
        self.size = size
        self.words: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.words) > WORD_CACHE:
            self.words.clear()
        known, new = self.words, xxhash.xxh3_64_intdigest
        ids = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = new(w)
            ids[i] = h
        k = min(self.size, len(words))
        with np.errstate(over="ignore"):
            h = np.full(len(words) - k + 1, k, np.uint64)
            for i in range(k):
                h = _mix(h * MULT + ids[i:len(words) - k + 1 + i])
        return np.unique(h)


def universal(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift family: ``((a x + b) mod 2^64) >> 32`` over 32-bit ``x`` is strongly universal."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(0, 2**63, n, np.uint64)[:, None]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    x = shingles >> np.uint64(32)
    for i in range(0, len(x), COLUMNS):
        np.minimum(low, (a * x[None, i:i + COLUMNS] + b).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _profile(size: int, hashes: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.string()),
                        ("sig", pa.list_(pa.int32()))])

    def run(batches):
        shingler, (a, b) = Shingler(size), universal(hashes)
        for part in blocks(batches):
            n, digest, sig = [], [], []
            for text in part.column("text").to_pylist():
                s = shingler(text)
                n.append(len(s))
                digest.append(f"{len(s):x}-{xxhash.xxh3_128_hexdigest(s.tobytes())}" if len(s) else None)
                sig.append(signature(s, a, b) if len(s) else None)
            yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string()),
                                   pa.array(sig, pa.list_(pa.int32()))], schema=schema)

    return run


def _sets(size: int):
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        shingler = Shingler(size)
        for part in blocks(batches):
            sets = [shingler(t).view(np.int64) for t in part.column("text").to_pylist()]
            yield pa.record_batch([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return run


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller centre and no centre has one: then the stars are the components."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, component)`` of every end of ``edges(u, v)`` that is not itself the smallest of its component, by
    alternating large-star and small-star until every component is a star.

    Each star joins the edges of a node with its smallest neighbour; both sides are read from written tables, so a hub
    with very many edges is split by the skew-join rule instead of meeting in one task.
    """
    least = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                         .where("u <> v").distinct(), "edges", narrow=True)
    while not _is_star_forest(least):
        both = least.unionByName(least.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m"))
                           .select("u", F.least("u", "m").alias("m")), "large", narrow=True)
        large = (both.join(low, "u").where("v > u and v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = scratch.save(large, "large-star", narrow=True)
        low2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "small", narrow=True)
        small = (large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        small = scratch.save(small, "small-star", narrow=True)
        scratch.drop(low, large, low2, least)
        least = small
    return least.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, bands: int) -> DataFrame:
    """Pairs ``(u, v)`` whose full sets have ``100 * intersection >= percent * union``."""
    hashes = ROWS * bands
    t = percent / 100
    need = max(0, math.floor(hashes * (t - SIGMAS * math.sqrt(t * (1 - t) / hashes))))

    def ends(df: DataFrame, right: DataFrame, value: str) -> DataFrame:
        for end in ("v", "u"):
            df = df.join(right.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in value.split()]),
                         end)
        return df

    agree = F.aggregate(F.zip_with("sig_u", "sig_v", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = (ends(pairs, reps, "n sig")
            .where(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent).where(agree >= need)
            .select("u", "v"))
    both = F.size(F.array_intersect("shingles_u", "shingles_v"))
    return (ends(near, sets, "shingles")
            .where(both * 100 >= (F.size("shingles_u") + F.size("shingles_v") - both) * percent).select("u", "v"))


def _common(sets: DataFrame, percent: int) -> DataFrame:
    """``id, size, common``: shingles of a candidate and how many of them any other candidate has.

    A link needs an intersection of at least ``percent`` of either set, and shingles of one candidate alone are in
    none; candidates with too few common shingles have no link and go. ``_possible`` is the same bound for a pair.
    """
    alone = (sets.select("id", F.explode("shingles").alias("s")).groupBy("s")
             .agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
             .groupBy("id").agg(F.count("*").alias("alone")))
    sizes = sets.groupBy("id").agg(F.max(F.size("shingles")).alias("size"))
    common = F.col("size") - F.coalesce("alone", F.lit(0))
    return (sizes.join(alone, "id", "left").select("id", "size", common.alias("common"))
            .where(F.col("common") * 100 >= F.col("size") * percent))


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether two sets may be linked: no intersection exceeds the smaller count of common shingles, or set."""
    most = F.least(*[F.col(f"{c}{e}") for c in ("size", "common") for e in (a, b)])
    return most * 100 >= (F.col(f"size{a}") + F.col(f"size{b}") - most) * percent


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("component", F.col("id"))
    return (members.join(labels, "id", "left")
            .withColumn("component", F.coalesce("component", "id")))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked when ``100 * intersection >= percent * union`` of their distinct ``shingle``-word sets;
    ``component_id`` is the smallest id reachable over links, ``kept`` marks that document.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    bands = bands_for(percent / 100)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = scratch.save(texts.mapInArrow(_profile(shingle, ROWS * bands),
                                            "doc_id long, n_shingles long, digest string, sig array<int>"), "profile")
    classes = scratch.save(profile.where("digest is not null and doc_id is not null").groupBy("digest")
                           .agg(F.min("doc_id").alias("rep")), "classes", narrow=True)
    reps = scratch.save(profile.withColumnRenamed("doc_id", "rep").join(classes, ["rep", "digest"])
                        .select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "sig"), "reps")
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                       lambda i: F.xxhash64(i, F.slice("sig", i * ROWS + 1, ROWS)))
    keyed = reps.select("id", F.explode(band).alias("key"))
    shared = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared", narrow=True)
    met = scratch.save(keyed.join(shared, "key").select("key", "id", "n"), "met", narrow=True)
    score = scratch.save(met.groupBy("id").agg(F.sum("n").alias("score")), "score", narrow=True)
    sets = scratch.save(texts.join(score, texts["doc_id"] == score["id"], "left_semi")
                        .mapInArrow(_sets(shingle), "id long, shingles array<long>"), "sets")
    common = scratch.save(_common(sets, percent).join(score, "id"), "common", narrow=True)
    members = scratch.save(met.select("key", "id").join(common, "id"), "members", narrow=True)

    links = labels = None
    for turn in range(STAR_ROUNDS + 1):
        at = _labelled(members, labels)
        if turn:
            mixed = at.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
            open_keys = scratch.save(mixed.where("lo <> hi").select("key"), "open-keys", narrow=True)
            at = scratch.save(at.join(open_keys, "key"), "open", narrow=True)
            if at.isEmpty():
                break
        pairs = (_star_pairs(at, turn, percent, scratch) if turn < STAR_ROUNDS
                 else _rest_pairs(at, sets, _sketches(reps, bands), percent, bands, scratch))
        new = scratch.save(_confirmed(scratch.save(pairs, "pairs", narrow=True), reps, sets, percent, bands), "links", narrow=True)
        if new.isEmpty():
            continue
        links = new if links is None else links.unionByName(new)
        labels = connected_components(links, scratch)

    of_class = scratch.save(_labelled(classes.withColumnRenamed("rep", "id"), labels).select("digest", "component"),
                            "of-class", narrow=True)
    alone = F.concat(F.lit("alone-"), F.coalesce(F.col("doc_id").cast("string"),
                                                  F.monotonically_increasing_id().cast("string")))
    narrow = profile.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), alone)
                            .otherwise(F.coalesce("digest", alone)).alias("digest"))
    out = narrow.join(of_class, "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def _central() -> Column:
    """The member of a group that meets most others over all its bands; the smallest id of equals."""
    return F.max(F.struct(F.col("score").alias("score"), (-F.col("id")).alias("low"), F.col("size").alias("size"),
                          F.col("common").alias("common"))).alias("c")


def _star_pairs(at: DataFrame, turn: int, percent: int, scratch: Scratch) -> DataFrame:
    """Each member of a bucket with the bucket's hub; in the first round only with the hub met in most bands.

    The hubs are written before the join, so that a bucket holding very many members can be split by the skew rule.
    """
    if turn == 0:
        hubs = at.groupBy("key").agg(_central()).withColumn("hub_component", F.lit(None).cast("long"))
    else:
        most = at.groupBy("key", "component").agg(F.count("*").alias("n"), _central())
        largest = most.groupBy("key").agg(F.max_by(F.struct("c", "component"), F.struct("n", "component")).alias("b"))
        hubs = largest.select("key", "b.c", F.col("b.component").alias("hub_component"))
    hubs = hubs.select("key", (-F.col("c.low")).alias("hub"), F.col("c.size").alias("size_h"),
                       F.col("c.common").alias("common_h"), "hub_component")
    other = F.col("id") != F.col("hub") if turn == 0 else F.col("component") != F.col("hub_component")
    star = at.join(scratch.save(hubs, "hubs", narrow=True), "key").where(other & _possible("", "_h", percent))
    met = star.groupBy("id", "hub").agg(F.count("*").alias("n"))
    if turn == 0:
        met = met.groupBy("id").agg(F.max_by("hub", F.struct(F.col("n"), -F.col("hub"))).alias("hub"))
    return met.select(F.col("hub").alias("u"), F.col("id").alias("v"))


def _sketches(reps: DataFrame, bands: int) -> DataFrame:
    """``id, w0, w1, ...``: the last bit of every signature row, ``SKETCH_BITS`` to a number."""
    starts = range(1, ROWS * bands + 1, SKETCH_BITS)
    word = lambda at: F.aggregate(F.slice("sig", at, SKETCH_BITS), F.lit(0).cast("bigint"),
                                  lambda s, x: s * 2 + x.bitwiseAND(F.lit(1)))
    return reps.select("id", *[word(at).alias(f"w{i}") for i, at in enumerate(starts)])


def _across(at: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """``at`` with ``common`` counting only shingles found in several components, without members that thereby cannot
    be linked to another component, and with ``rare``: the ``RARE`` shingles of a member found in fewest others."""
    where = at.select("id", "component").distinct()
    tokens = sets.join(where, "id").select("id", "component", F.explode("shingles").alias("s"))
    spread = scratch.save(tokens.groupBy("s").agg(F.count("*").alias("df"), F.min("component").alias("lo"),
                                                  F.max("component").alias("hi")), "spread")
    own = tokens.join(spread, "s").groupBy("id").agg(
        F.count_if(F.col("lo") < F.col("hi")).alias("common"),
        F.slice(F.sort_array(F.collect_list(F.struct("df", "s"))), 1, RARE)["s"].alias("rare"))
    own = scratch.save(own, "rare", narrow=True)
    return at.drop("common").join(own, "id").where(F.col("common") * 100 >= F.col("size") * percent)


def _share_rare(a: str, b: str, percent: int) -> Column:
    """Whether two sets may be linked, by their rarest shingles in one order for all: linked sets have at least
    ``o = percent (m + n) / (100 + percent)`` shingles in common, so at most ``max(m, n) - o`` of the first ``RARE`` of
    either are missing from the first ``RARE`` of the other."""
    longest = F.greatest(F.col(f"size{a}"), F.col(f"size{b}"))
    least = F.ceil((F.col(f"size{a}") + F.col(f"size{b}")) * percent / (100 + percent))
    return F.size(F.array_intersect(f"rare{a}", f"rare{b}")) >= F.least(F.lit(RARE), longest) - longest + least


def _rest_pairs(at: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int, bands: int, scratch: Scratch) -> DataFrame:
    """In buckets of several components: members outside the largest one, with all members of other components.

    A signature bit agrees with probability ``(1 + J) / 2``; pairs more than ``SIGMAS`` standard errors below the
    threshold's share, or that ``_possible`` or ``_share_rare`` exclude, are refused by the join condition itself.
    """
    hashes, q = ROWS * bands, (1 + percent / 100) / 2
    differ = hashes - math.floor(hashes * (q - SIGMAS * math.sqrt(q * (1 - q) / hashes)))
    at = _across(at.drop("score"), sets, percent, scratch)
    at = scratch.save(at.join(sketches, "id"), "sketched", narrow=True)
    counts = at.groupBy("key", "component").agg(F.count("*").alias("c"))
    largest = counts.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("largest"))
    words = [c for c in at.columns if c.startswith("w")]
    few = scratch.save(at.join(largest, "key").where("component <> largest")
                       .select("key", F.col("id").alias("x"), F.col("component").alias("cx"), F.col("size").alias("size_x"),
                               F.col("common").alias("common_x"), F.col("rare").alias("rare_x"), *[F.col(w).alias(f"x{w}") for w in words]),
                       "few", narrow=True)
    unlike = sum(F.bit_count(F.col(w).bitwiseXOR(F.col(f"x{w}"))) for w in words)
    alike = (F.col("cx") != F.col("component")) & _possible("", "_x", percent) & (unlike <= differ) \
        & _share_rare("", "_x", percent)
    met = few.join(at, (few["key"] == at["key"]) & alike)
    return met.select(F.greatest("id", "x").alias("u"), F.least("id", "x").alias("v")).distinct()


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component its smallest id, once; rows without an id stay.

    Where ids repeat, each distinct text of an id counts as a document of its own, in the order of id and text hash.
    """
    named = docs.where("doc_id is not null")
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        scratch = Scratch(docs.sparkSession, "one-of-each")
        words = F.coalesce(F.col("text").cast("string"), F.lit(""))
        rows = named.select("doc_id", F.sha2(words, 256).alias("hash"), words.alias("text"), F.struct("*").alias("row"))
        same = Window.partitionBy("doc_id", "hash").orderBy(F.xxhash64("row"))
        once = rows.withColumn("same", F.row_number().over(same)).where("same = 1").drop("same")
        ranked = scratch.save(global_rank(once, ["doc_id", "hash"], scratch, "rank"), "ranked")
        kept = near_duplicates(ranked.select(F.col("rank").alias("doc_id"), "text"), shingle, percent).where("kept")
        return (ranked.join(kept.select(F.col("doc_id").alias("rank")), "rank", "left_semi").select("row.*")
                .unionByName(docs.where("doc_id is null")))
    marks = near_duplicates(docs, shingle, percent)
    (dropped,) = fresh(docs, "_dropped")
    gone = marks.where(~F.col("kept")).select(F.col("doc_id").alias(dropped))
    return docs.join(gone, F.col("doc_id") == F.col(dropped), "left_anti")


def op8_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return near_duplicates(documents(spark, sf_dir), shingle=3, percent=85)
