"""MinHash near-dedup by tensored banding.

A document's set is its distinct k-word shingles. Instead of ``tables * rows`` MinHash functions
two small collections A and B of ``bands`` functions each (a function: ``rows`` MinHashes) are
computed; the table keys are all pairs (a_i, b_j), so ``bands ** 2`` tables cost
``2 * bands * rows`` MinHashes, about a square root of the plain number. A pair of similarity s
is missed with probability below ``2 * (1 - s ** rows) ** bands``: under 2.2e-5 at s = 0.85, where
most pairs also have other paths to each other, and under 1e-9 at s = 0.95.

Only documents that share a half key with another on both sides get table keys at all, so most
texts leave before the tables; a sieve of bounded size keeps the texts of the others from being
shuffled. Equal sets are one class before any of this. In each bucket all members are compared
with one pivot, the member that shares most buckets with others, which is linear in the bucket;
what lies in one component after that needs no further comparison. Texts joined by candidate
pairs form clusters; where a cluster still holds several components, every text outside its main
component is compared with all others of the cluster whose size allows a link, by counting common
shingles over an inverted list, in blocks of bounded size; no pair is written, and it is exact at
any size.

Words and sets are named by content: 128 bits of a keyed BLAKE2b in two halves (see words.py). Sets
are equal when both halves of all shingles are, and a link needs the wanted similarity in both
halves, so a pair is misjudged only if both collide within it: for two texts of n shingles with
probability under n**4 / 2**128, about 3e-27 at n = 1,000. MinHashes use one half, as a collision
there proposes a candidate at most. Links are confirmed on the full sets.

Defined results: a text of fewer than k words is one shingle, of none (or null) has an empty set
and is linked with nothing; a row with null doc_id links like any other but never names a
component (one of such rows only has component_id null); rows that repeat a doc_id are judged each
by its own text; kept says that doc_id equals component_id (null equals null).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import drop_staged, freed, give_back, hot_join, list_array, raw_bytes, sieve, sieved, slices, staged, table
from .graph import components
from .words import Names, content_name, distinct, mix, shingles

BANDS = 12
ROWS = 3
SEED = 7
#: Bounds of a block of texts that one task compares with another.
BLOCK_TEXTS = 1_024
BLOCK_SHINGLES = 1 << 20
#: Bytes of a pair of blocks after which a worker hands its memory back.
LARGE_BLOCK = 4 << 20
_SIG = "doc_id long, row_key binary, n_shingles long, digest binary, a array<long>, b array<long>"
_SET = "id long, high array<long>, low array<long>"


def row_sets(batch_text, k: int, names: Names, most: int = 1 << 20):
    """Yields (row, high, low): the halves of the distinct shingles of each of a column of texts, sorted."""
    data, offsets = raw_bytes(batch_text)
    for i, j in slices(offsets, most):
        raw = data[offsets[i] : offsets[j]].tobytes().lower()
        off = (offsets[i : j + 1] - offsets[i]).tolist()
        high, low, first = names.of([raw[a:b].split() for a, b in zip(off, off[1:], strict=False)])
        one, at = shingles(high, first, k)
        two, _ = shingles(low, first, k)
        at = at.tolist()
        for r in range(j - i):
            yield i + r, *distinct(one[at[r] : at[r + 1]], two[at[r] : at[r + 1]])


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(x: np.ndarray, mul: np.ndarray, add: np.ndarray, block: int = 2048) -> np.ndarray:
    out = np.full(len(mul), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), block):
        h = np.multiply.outer(mul, x[i : i + block])
        h += add[:, None]
        np.minimum(out, h.min(axis=1), out=out)
    return out


def _signatures(k: int, bands: int, rows: int, seed: int):
    mul, add = _functions(2 * bands * rows, seed)
    salt = mix(np.arange(1, 2 * bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches):
        names = Names()
        for batch in batches:
            n = batch.num_rows
            size, digest = np.zeros(n, np.int64), [b""] * n
            half = np.zeros((n, 2 * bands), np.uint64)
            known: dict[bytes, np.ndarray] = {}
            for r, s, low in row_sets(batch.column("text"), k, names):
                size[r] = len(s)
                if not len(s):
                    continue
                digest[r] = content_name(s.tobytes() + low.tobytes())
                if digest[r] not in known:
                    m = minima(s, mul, add).reshape(2 * bands, rows)
                    h = salt.copy()
                    for c in range(rows):
                        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + m[:, c])
                    known[digest[r]] = h
                half[r] = known[digest[r]]
            full = size > 0
            per = np.where(full, bands, 0)
            both = half[full].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(size), pa.array(digest, pa.binary()), list_array(both[:, :bands].ravel(), per, pa.int64()), list_array(both[:, bands:].ravel(), per, pa.int64())],
                names=["doc_id", "row_key", "n_shingles", "digest", "a", "b"],
            )

    return run


def _sets(k: int):
    def run(batches):
        names = Names()
        for batch in batches:
            got = [(high, low) for _, high, low in row_sets(batch.column("text"), k, names)]
            n = np.array([len(high) for high, _ in got], np.int64)
            half = [list_array(np.concatenate([g[c] for g in got]).view(np.int64) if got else np.zeros(0, np.int64), n, pa.int64()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *half], names=["id", "high", "low"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (u, v) of ``pairs`` whose full sets have Jaccard similarity of at least percent/100.

    Pairs whose sizes rule that out leave before any set is moved.
    """
    size = sets.select("id", F.size("high").alias("n"))
    sized = pairs.join(size.select(F.col("id").alias("i1"), F.col("n").alias("n1")), F.col("u") == F.col("i1")).join(size.select(F.col("id").alias("i2"), F.col("n").alias("n2")), F.col("v") == F.col("i2"))
    pairs = sized.where(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent).select("u", "v")
    s = sets.select(F.col("id").alias("i1"), F.col("high").alias("h1"), F.col("low").alias("l1"))
    t = sets.select(F.col("id").alias("i2"), F.col("high").alias("h2"), F.col("low").alias("l2"))
    one, two = F.size("h1"), F.size("h2")
    joined = pairs.join(s, F.col("u") == F.col("i1")).join(t, F.col("v") == F.col("i2"))
    near = joined
    for a, b in (("h1", "h2"), ("l1", "l2")):
        near = near.withColumn("i", F.size(F.array_intersect(a, b))).where(F.col("i") * 100 >= (one + two - F.col("i")) * percent)
    return near.select("u", "v")


def row_key(doc_id="doc_id", text="text"):
    """SHA-256 of a row's doc_id and text: equal rows share it, whatever other columns say."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))), 256))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, row_key, n_shingles, component (a
    number; null for a text without words) and component_id, its smallest doc_id."""
    two = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row_key", row_key())
    sigs = staged(two.mapInArrow(freed(_signatures(k, bands, rows, seed)), _SIG), "minhash")
    full = sigs.where("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"), F.any_value("a").alias("a"), F.any_value("b").alias("b"), F.count("*").alias("copies"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("id"), "digest", "first.doc_id", "first.row_key", "a", "b", "copies"), "classes")

    half = classes.select("id", F.explode("a").alias("h"), F.lit(0).alias("side")).unionByName(classes.select("id", F.explode("b").alias("h"), F.lit(1).alias("side")))
    shared = half.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("g"))
    alive = half.join(shared, F.col("h") == F.col("g"))
    sides = alive.groupBy("id").agg(F.collect_list(F.when(F.col("side") == 0, F.col("h"))).alias("a"), F.collect_list(F.when(F.col("side") == 1, F.col("h"))).alias("b"))
    keys = sides.select("id", F.explode("a").alias("x"), "b").select("id", "x", F.explode("b").alias("y")).select("id", F.xxhash64("x", "y").alias("key"))
    keys = staged(keys, "keys")
    size = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").withColumnRenamed("key", "q")
    keys2 = staged(keys.join(size, F.col("key") == F.col("q")).select("key", "id", "c"), "keys")
    drop_staged(keys)

    degree = staged(keys2.groupBy("id").agg(F.sum("c").alias("degree")).withColumnRenamed("id", "i"), "degree")
    asked = staged(classes.join(degree, F.col("id") == F.col("i")).select("id", F.col("row_key").alias("asked")), "asked")
    texts = sieved(two.select("row_key", "text"), "row_key", sieve(asked, "asked")).where("__may").select("row_key", "text")
    texts = texts.dropDuplicates(["row_key"]).join(asked.hint("shuffle_hash"), F.col("row_key") == F.col("asked")).select("id", "text")
    sets = staged(texts.mapInArrow(freed(_sets(k)), _SET), "sets")
    drop_staged(asked)

    ranked = keys2.join(degree, F.col("id") == F.col("i"))
    pivot = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("neg"))).alias("p")).select(F.col("key").alias("q"), (-F.col("p.neg")).alias("pivot"))
    pairs = keys2.join(pivot, F.col("key") == F.col("q")).where("id <> pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v"))
    pairs = staged(pairs.distinct(), "pairs")
    links = staged(verified(pairs, sets, percent), "links")
    labels = staged(components(links), "labels")
    more = staged(_cross_links(pairs, labels, sets, percent), "links")
    final = staged(components(links.unionByName(more)), "labels")
    drop_staged(keys2, pairs, sets, degree, labels, links, more)

    linked = staged(final.join(classes.select(F.col("id").alias("i"), F.col("doc_id").alias("first_id")), F.col("id") == F.col("i")).select("id", "component", "first_id"), "linked")
    named = staged(linked.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), "named")
    of = hot_join(linked, named, ["component"], "n", linked.count()).select(F.col("id").alias("i"), "component", "component_id")
    byclass = classes.join(of, F.col("id") == F.col("i"), "left")
    byclass = byclass.select("digest", "copies", F.coalesce("component", "id").alias("component"), F.when(F.col("i").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    byclass = staged(byclass, "byclass")
    drop_staged(final, linked, named, classes)
    out = hot_join(full.select("doc_id", "row_key", "n_shingles", "digest"), byclass, ["digest"], "copies", full.count()).select("doc_id", "row_key", "n_shingles", "component", "component_id")
    alone = sigs.where("n_shingles = 0").select("doc_id", "row_key", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    out = near_groups(docs, k, percent, bands, rows, seed)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one of each group of near-duplicates: the smallest doc_id (null last),
    then the smallest row key. Rows without words are no one's copy and stay.

    Only rows of groups of two or more meet the join; a sieve lets the others pass where they are.
    """
    rows = staged(near_groups(docs, k, percent).where("component is not null").select("component", "doc_id", "row_key"), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("best")
    many = staged(rows.groupBy("component").agg(best, F.count("*").alias("n")).where("n > 1").select("component", "n", F.col("best.row_key").alias("best")), "groups")
    fate = hot_join(rows, many, ["component"], "n", rows.count()).select(F.col("row_key").alias("__near_row"), (F.col("row_key") == F.col("best")).alias("__near_keep")).distinct()
    fate = staged(fate, "fate")
    drop_staged(rows, many)
    seen = sieved(docs.withColumn("__near_key", row_key()), "__near_key", sieve(fate, "__near_row"))
    pass_ = seen.where(~F.col("__may")).select(*docs.columns)
    met = seen.where("__may").join(fate.hint("shuffle_hash"), F.col("__near_key") == F.col("__near_row"), "left")
    other = met.where("__near_row is null").select(*docs.columns)
    first = met.where("__near_keep").dropDuplicates(["__near_key"]).select(*docs.columns)
    return pass_.unionByName(other).unionByName(first)


def _cross_links(pairs: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join the components of each cluster which belong together."""
    clusters = components(pairs).withColumnRenamed("component", "cluster")
    lab = labels.withColumnRenamed("id", "n")
    size = sets.select(F.col("id").alias("s"), F.size("high").cast("long").alias("weight"))
    of = clusters.join(lab, F.col("id") == F.col("n"), "left").join(size, F.col("id") == F.col("s"))
    # sizes of linked texts are in one band or in bands side by side, so that they meet in the higher band's group
    band = F.floor(F.ln("weight") / F.lit(math.log(100 / percent) * (1 + 1e-6)))
    of = of.select("id", "cluster", F.explode(F.array(band, band + 1)).alias("band"), F.coalesce("component", "id").alias("comp"), "weight")
    of = staged(of, "clusters")
    drop_staged(clusters)
    parts = of.groupBy("cluster", "band", "comp").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    whole = parts.groupBy("cluster", "band").agg(F.max(F.struct("n", "comp", "w")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(w / BLOCK_SHINGLES)).cast("int")
    whole = whole.select(
        "cluster",
        "band",
        F.col("main.comp").alias("main"),
        blocks(F.col("n") - F.col("main.n"), F.col("w") - F.col("main.w")).alias("b"),
        blocks(F.col("main.n"), F.col("main.w")).alias("m"),
    )
    whole = staged(whole, "clusters")

    rows = of.join(whole, ["cluster", "band"]).withColumn("h", F.xxhash64("id"))
    block = F.when(F.col("comp") != F.col("main"), F.pmod("h", "b")).otherwise(F.col("b") + F.pmod("h", "m")).cast("int")
    rows = rows.withColumn("block", block)
    others = F.when(F.col("block") < F.col("b"), F.col("b") + F.col("m")).otherwise(F.col("b"))
    unit = rows.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    full = unit.select("cluster", "band", "i", "j", "block", "id", "comp").join(sets.select(F.col("id").alias("s"), "high", "low"), F.col("id") == F.col("s")).drop("s")
    return full.groupBy("cluster", "band", "i", "j").applyInArrow(_block_links(percent), "u long, v long")


def _block_links(percent: int):
    """For two blocks of a cluster, links that join different components: no more than joins need."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        block, ids, comp = (t.column(c).to_numpy() for c in ("block", "id", "comp"))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        lists = t.column("high").combine_chunks()
        flat, low = lists.flatten().to_numpy(zero_copy_only=False), t.column("low").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        at = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        n = np.diff(at)
        doc = np.repeat(np.arange(len(ids)), n)
        order = np.lexsort((low, flat))
        new = np.append(True, (flat[order][1:] != flat[order][:-1]) | (low[order][1:] != low[order][:-1]))
        begin = np.flatnonzero(new)
        many = np.diff(np.append(begin, len(flat)))
        name = np.empty(len(flat), np.int64)
        name[order] = np.cumsum(new) - 1
        listed = doc[order]
        group = {int(c): int(c) for c in np.unique(comp)}

        def root(c: int) -> int:
            while group[c] != c:
                group[c] = group[group[c]]
                c = group[c]
            return c

        right = block == j
        u_out, v_out = [], []
        for u in np.flatnonzero(block == i):
            s = name[at[u] : at[u + 1]]
            s = s[many[s] > 1]
            if not len(s):
                continue
            k = many[s]
            where = np.repeat(begin[s] - np.cumsum(k) + k, k) + np.arange(k.sum())
            common = np.bincount(listed[where], minlength=len(ids))
            near = right & (comp != comp[u]) & (common * 100 >= (n + n[u] - common) * percent)
            for v in np.flatnonzero(near):
                a, b = root(int(comp[u])), root(int(comp[v]))
                if a != b:
                    group[max(a, b)] = min(a, b)
                    u_out.append(ids[u])
                    v_out.append(ids[v])
        return pa.table({"u": pa.array(u_out, pa.int64()), "v": pa.array(v_out, pa.int64())})

    def lean(t: pa.Table) -> pa.Table:
        out, large = run(t), t.nbytes > LARGE_BLOCK
        del t
        if large:
            give_back()
        return out

    return lean


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM p WHERE 100 * c >= 85 * (n + m - c)
), reach AS (
  SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT links.v, reach.root FROM reach JOIN links ON links.u = reach.id
), roots AS (
  SELECT id, min(root) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN roots ON id = doc_id
"""
