"""Near-duplicate join on word shingles by chosen paths.

Every text is the set of its five-word shingles (all its words, if fewer). Each run splits the sets
recursively: on every level a set follows those of its shingles that a hash of the path so far
samples, with about ``spread / size`` as the chance, so two sets of similarity ``threshold`` or more
share more than one branch on average and unlike sets part quickly. Sets that end in one bucket are
compared by brute force. ``spread`` is so set that two sets at the threshold share ``LEVEL`` branches
on average even if one lies inside the other. Then ``RUNS`` runs miss such a pair with a chance of
at most 5.9e-4, at any threshold. The sketches of step 3 are the same in all runs and miss it with a
chance of at most ``SKETCH_LOSS`` (1e-7) more, so jointly a pair at the threshold is missed less than
once in a thousand; more similar pairs are safer still.

Steps: (1) texts with equal sets are one node. (2) Paths that only one set takes are dropped by a
fixed-width aggregate. (3) In every bucket left, pairs are compared by small minimum-hash sketches;
what is clearly unlike goes. The pairs kept are not written: only the component of each member
within its bucket is. (4) Components over all buckets are clusters, so a set is in one cluster
however many buckets it was in. (5) Within a cluster all pairs are compared exactly on their whole
shingle sets, and links are counted. Large buckets and clusters are cut into blocks, and pairs of
blocks are compared in separate tasks. (6) Classes are the components over the exact links.

Texts are identified by their 64-bit hash, sets by that of all their shingles' 64-bit hashes. A text without words
(null, empty or blank) has no shingles and is similar to none. Rows are judged one by one: repeated
rows are copies of each other. Null keys are kept; the class id is the smallest key of a class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import complete_groups, forget_others, fresh, give_back, group_bounds, small, table, with_rows, written
from tidemark.llm.components import Joined, components
from tidemark.llm.shingles import mix, shingles, word_hashes, words_of

WORDS, THRESHOLD = 5, 0.8
# Branches that two sets at the threshold share on average on each level of a run, at least.
RUNS, DEPTH, LEVEL = 12, 3, 1.144
# Minimum hashes in a sketch (8 bits each), and the chance that a pair at the threshold fails by it.
SKETCH, SKETCH_LOSS = 64, 1e-7
# Members of a block; larger buckets and clusters are compared in pairs of blocks.
BLOCK = 1024

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def spread_of(threshold: float) -> float:
    """Branches of a set on each level: of one inside another, ``threshold`` times these are shared."""
    return LEVEL / threshold


def alike_of(threshold: float) -> int:
    """Sketch values that must agree for an exact look: the most that loses at most ``SKETCH_LOSS``.

    Each value agrees with the similarity as its chance (chance agreement of 8 bits comes on top).
    """
    loss = 0.0
    for k in range(SKETCH + 1):
        loss += math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k)
        if loss > SKETCH_LOSS:
            return k
    return SKETCH


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    return np.unique(shingles(word_hashes(words_of(text)), words))


def set_id(members: np.ndarray) -> int:
    return int(mix(np.array([np.sum(mix(members), dtype=np.uint64) ^ np.uint64(len(members))]))[0].view(np.int64))


def paths_of(members: np.ndarray, runs: int, depth: int, spread: float) -> np.ndarray:
    """Hashes of the paths a set takes in all runs."""
    limit = np.uint64(min(2**64 - 1, int(spread / len(members) * 2.0**64)))
    path = _SEEDS[:runs]
    for _ in range(depth):
        sampled = (path[:, None] ^ members[None, :]) * _ODD <= limit
        run, token = np.nonzero(sampled)
        path = mix(path[run] * np.uint64(3) + members[token])
    return path


def sketch_of(members: np.ndarray) -> bytes:
    seeds = _SEEDS[-SKETCH:]
    size = max(1, (1 << 20) // SKETCH)
    least = np.full(SKETCH, 2**64 - 1, np.uint64)
    for start in range(0, len(members), size):
        part = members[start : start + size]
        least = np.minimum(least, ((part[None, :] ^ seeds[:, None]) * _ODD).min(axis=1))
    return (mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def described(docs: DataFrame, text: str, words: int, runs: int, depth: int, spread: float) -> DataFrame:
    """(thash, sid, sketch, paths) of every text: the one pass over all texts in Python.

    ``sid`` is null for a text without words.
    """

    def make(columns: list[pa.Array]) -> list:
        ids, sketches, paths = [], [], []
        for value in columns[0]:
            members = shingle_set(value.as_py(), words)
            if len(members):
                ids.append(set_id(members))
                sketches.append(sketch_of(members))
                paths.append(np.unique(paths_of(members, runs, depth, spread)).view(np.int64))
            else:
                ids.append(None)
                sketches.append(None)
                paths.append(None)
        return [ids, sketches, paths]

    made = {"sid": T.LongType(), "sketch": T.BinaryType(), "paths": T.ArrayType(T.LongType())}
    rows = docs.select(F.xxhash64(text).alias("thash"), F.col(text).alias("text"))
    return with_rows(rows, made, make, "text").drop("text")


def blocked(rows: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """``rows`` with (left, right): the pairs of blocks of its key that a member takes part in.

    A key with up to ``block`` members has the one pair (0, 0). ``part`` is the member's own block.
    """
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    return (
        rows.join(sizes.where("blocks > 1"), key, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("part", F.pmod(F.xxhash64(member), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"left": F.least("part", "other"), "right": F.greatest("part", "other")})
        .drop("blocks", "other")
    )


def pairs_within(bounds: np.ndarray, part: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Row pairs to compare: all of a group on the diagonal, else those of different blocks.

    Yields chunks of bounded size.
    """
    held, count = [], 0
    for start, end in zip(bounds[:-1], bounds[1:]):
        if left[start] == right[start]:
            i, j = np.triu_indices(end - start, 1)
        else:
            side = part[start:end] == left[start]
            a, b = np.flatnonzero(side), np.flatnonzero(~side)
            i, j = np.repeat(a, len(b)), np.tile(b, len(a))
        held.append((i + start, j + start))
        count += len(i)
        if count >= 1 << 18:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held, count = [], 0
    if count:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def bucket_edges(buckets: DataFrame, block: int, least: int) -> DataFrame:
    """(a, b) edges that join the members of each bucket with ``least`` equal sketch values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("")  # comparing needs no words
        for rows in complete_groups(batches, ["path", "left", "right"]):
            sid = rows["sid"].to_numpy()
            left, right, part = (rows[c].to_numpy() for c in ("left", "right", "part"))
            bounds = group_bounds(rows["path"].to_numpy(), left, right)
            sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(sid), SKETCH)
            joined = Joined(len(sid))
            for i, j in pairs_within(bounds, part, left, right):
                alike = np.zeros(len(i), bool)
                for at in range(0, len(i), 1 << 14):
                    x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                    alike[at : at + (1 << 14)] = (sketch[x] == sketch[y]).sum(axis=1) >= least
                joined.link(i[alike], j[alike])
            moved = joined.moved()
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid[joined.label[moved]]), pa.array(sid[moved])], names=["a", "b"]
            )
        give_back()

    return (
        blocked(buckets, "path", "sid", block)
        .repartition("path", "left", "right")
        .sortWithinPartitions("path", "left", "right")
        .select("path", "left", "right", "part", "sid", "sketch")
        .mapInArrow(run, "a long, b long")
    )


def overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered ``rows`` with those numbered ``columns``.

    Sets are sorted hashes; ranges of about half a million of them are counted at a time.
    """
    ranges = 1 + (sum(map(len, sets)) >> 19)
    edges = np.array([2**64 * k // ranges for k in range(1, ranges)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(s, edges), [len(s)]]).astype(np.int64) for s in sets]
    count = np.zeros((len(rows), len(columns)), np.float32)
    for k in range(ranges):
        count += range_overlaps([s[c[k] : c[k + 1]] for s, c in zip(sets, cuts)], rows, columns)
    return count


def range_overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    sizes = np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(token)[token] > 1
    token, owner = token[shared], owner[shared]
    _, token = np.unique(token, return_inverse=True)
    count = np.zeros((len(rows), len(columns)), np.float32)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    width = max(1, (1 << 21) // max(1, len(sets)))
    for first in range(0, int(token.max(initial=-1)) + 1, width):
        a, b = np.searchsorted(token, [first, first + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], token[a:b] - first] = 1
        count += has[rows] @ has[columns].T
    return count


def exact_links(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(sid, texts, docs, label) per set and pair of blocks.

    ``texts`` and ``docs`` count the sets and rows linked with it there, ``label`` is the smallest
    set it hangs together with there. ``members``: cluster, sid, weight, shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others("")
        for rows in complete_groups(batches, ["cluster", "left", "right"], 1 << 9):
            sid, weight = rows["sid"].to_numpy(), rows["weight"].to_numpy()
            left, right, part = (rows[c].to_numpy() for c in ("left", "right", "part"))
            sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"].to_pylist()]
            texts, docs = np.zeros(len(sid), np.int64), np.zeros(len(sid), np.int64)
            joined = Joined(len(sid))
            bounds = group_bounds(rows["cluster"].to_numpy(), left, right)
            for start, end in zip(bounds[:-1], bounds[1:]):
                own = np.arange(start, end)
                diagonal = left[start] == right[start]
                a, b = (own, own) if diagonal else (own[part[own] == left[start]], own[part[own] != left[start]])
                if not len(a) or not len(b):
                    continue
                common = overlaps(sets[start:end], a - start, b - start)
                size = np.array([len(s) for s in sets[start:end]], np.float32)
                union = size[a - start][:, None] + size[b - start][None, :] - common
                linked = common >= threshold * union - 1e-4
                if diagonal:
                    np.fill_diagonal(linked, False)
                else:
                    texts[b] += linked.sum(axis=0)
                    docs[b] += weight[a] @ linked
                texts[a] += linked.sum(axis=1)
                docs[a] += linked @ weight[b]
                i, j = np.nonzero(linked)
                if len(i):
                    joined.link(a[i], b[j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(sid), pa.array(texts), pa.array(docs), pa.array(sid[joined.label])],
                names=["sid", "texts", "docs", "label"],
            )
        give_back()

    return (
        blocked(members, "cluster", "sid", block)
        .repartition("cluster", "left", "right")
        .sortWithinPartitions("cluster", "left", "right")
        .select("cluster", "left", "right", "part", "sid", "weight", "shingles")
        .mapInArrow(run, "sid long, texts long, docs long, label long")
    )


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    runs: int = RUNS,
    depth: int = DEPTH,
    spread: float | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` with ``class_id``, ``n_links`` (other rows at the threshold or above) and
    ``n_linked_texts`` (different shingle sets among them)."""
    (thash,) = fresh(docs, "thash")
    spread = spread_of(threshold) if spread is None else spread
    # Equal texts are described once each time they occur; all further steps have one row per set.
    keys = docs.groupBy(F.xxhash64(text).alias("thash")).agg(
        F.min(key).alias("first"), F.count("*").alias("weight")
    )
    about = written(described(docs, text, words, runs, depth, spread).where("sid is not null"), "texts")
    texts = about.groupBy("thash").agg(F.min("sid").alias("sid"))
    texts = written(texts.join(keys, "thash"), "keys")
    weights = texts.groupBy("sid").agg(F.sum("weight").alias("weight"), F.min("first").alias("first"))

    steps = about.select("sid", F.explode("paths").alias("path"))
    live = (
        steps.groupBy("path")
        .agg(F.min("sid").alias("low"), F.max("sid").alias("high"))
        .where("low <> high")
        .select("path")
    )
    buckets = steps.join(small(written(live, "paths")), "path", "left_semi").distinct()
    sketches = about.select("sid", "sketch").groupBy("sid").agg(F.first("sketch").alias("sketch"))
    buckets = written(buckets.join(sketches, "sid"), "buckets")
    clusters = components(bucket_edges(buckets, block, alike_of(threshold)))
    clusters = written(
        clusters.select(F.col("node").alias("sid"), F.col("label").alias("cluster")), "clusters"
    )

    def whole(columns: list[pa.Array]) -> list:
        return [[shingle_set(x.as_py(), words).tobytes() for x in columns[0]]]

    # Only texts in a cluster are read in full again.
    wanted = texts.join(small(clusters), "sid").groupBy("sid", "cluster").agg(F.min("thash").alias("thash"))
    wanted = small(written(wanted, "wanted"))
    shown = (
        docs.select(F.xxhash64(text).alias("thash"), F.col(text).alias("text"))
        .join(wanted, "thash")
        .dropDuplicates(["thash"])
    )
    payload = (
        with_rows(shown, {"shingles": T.BinaryType()}, whole, "text")
        .join(weights, "sid")
        .select("cluster", "sid", "weight", "shingles")
    )
    links = written(exact_links(written(payload, "payload"), threshold, block), "links")
    classes = components(links.select(F.col("label").alias("a"), F.col("sid").alias("b")))
    counts = links.groupBy("sid").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    per_set = (
        weights.join(classes, weights["sid"] == classes["node"], "left")
        .select("sid", "weight", "first", F.coalesce("label", "sid").alias("label"))
    )
    names = per_set.groupBy("label").agg(F.min("first").alias("class_id"))
    per_set = (
        per_set.join(names, "label")
        .join(counts, "sid", "left")
        .select(
            "sid",
            "class_id",
            (F.coalesce("docs", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("texts", F.lit(0)).cast("long").alias("n_linked_texts"),
        )
    )
    per_text = texts.join(per_set, "sid").select(
        F.col("thash").alias(thash), "class_id", "n_links", "n_linked_texts"
    )
    # Texts without a link or copy need no row.
    per_text = written(per_text.where("n_links > 0"), "classes")
    new = {"class_id", "n_links", "n_linked_texts"}
    rest = [c for c in docs.columns if c.lower() not in new]
    return (
        docs.select(*dict.fromkeys([*rest, key, text]))
        .withColumn(thash, F.xxhash64(text))
        .join(small(per_text, 500_000), thash, "left")
        .select(
            *rest,
            F.when(F.col("n_links").isNull(), F.col(key)).otherwise(F.col("class_id")).alias("class_id"),
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("n_linked_texts", F.lit(0).cast("long")).alias("n_linked_texts"),
        )
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "n_links", "n_linked_texts")


def brute_force(rows: list[tuple[int, str | None]], words: int = WORDS, threshold: float = THRESHOLD):
    """doc_id -> (class_id, n_links), by comparing all pairs; for tests."""
    sets = {}
    for key, text in rows:
        w = words_of(text)
        sets[key] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    keys = sorted(sets)
    label = {k: k for k in keys}
    links = dict.fromkeys(keys, 0)

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    holders: dict = {}
    for k in keys:
        for s in sets[k]:
            holders.setdefault(s, []).append(k)
    near = {(a, b) for h in holders.values() for i, b in enumerate(h) for a in h[:i]}
    for a, b in near:
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((top(a), top(b)))
            label[y] = x
    return {k: (top(k), links[k]) for k in keys}
