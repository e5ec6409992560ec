"""N-gram Jaccard join: near duplicates by token-combination prefixes, then exact verification.

A document is the set of its distinct word 5-grams; two link when 9 * overlap >= 4 * (sizes), that
is at a Jaccard similarity of 0.8.  All tokens are 64-bit hashes in one global order.

1. ``sets``: size and signature of every set; equal sets are one entity from here on.
2. ``survivors``: of each set only the first p + e tokens (p the classic prefix length, e a tenth
   of the size) are counted.  A linked pair shares more than min(e) tokens of these extended
   prefixes, so an entity with fewer tokens that occur elsewhere can have no partner.  Tokens are
   counted within a task first; only a token seen once there is sent with its entity, so a token
   that a third of all documents hold is one row per task.
3. ``members``: the whole sets of the survivors, tokens that occur nowhere else removed.  Tokens
   are ordered by frequency.  A member whose prefix ends among the rare tokens is indexed by
   these.  One whose prefix reaches the frequent ones is indexed by all its rare tokens and by
   combinations of two frequent tokens that are neighbours in the order, over a prefix extended to
   0.4 times its size.  With D tokens not shared, D + 2 shared ones have a neighbouring pair that
   both sets see as neighbours, and D + 2 shared ones lie within that prefix: no link is lost.
4. ``clusters``: each key's most complete member is its centre and is compared with the others, so
   a group of thousands costs one comparison a member.  For centres whose members are then still
   in different components, ``cross_pairs`` bounds the overlap of each pair of different components
   from what both share with the centre and what they have besides, by parts of the hash range,
   in blocks of bounded size; only pairs the bound allows go on.
5. Every pair is verified on the whole sets (tokens that occur once cannot overlap), and
   ``components`` joins links by alternating large-star and small-star rounds.

Nothing is capped: all entities, keys and pairs that could link are covered.  Equality of sets and
of shingles is equality of 64-bit hashes.

Defined results: null and empty texts and texts without words have size 0, link with nothing and
are their own component; a text of fewer than five words is one token; a null id is grouped like
others and takes the smallest known id of its component (null if there is none); repeated rows are
copies; very long texts are used whole; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crossrank.llm.common import ship
from crossrank.staging import stage

ship(__name__)

WIDTH = 5
RARE = 16  # tokens in more members than this are combined
BLOCK = 256  # members of one centre bounded in one task
PARTS = 32  # parts of the hash range in the bound
FLUSH = 2_000_000  # tokens counted together within a task
CACHE = 500_000
BROADCAST_ROWS = 1_000_000  # 16 bytes each
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# ---- tokens --------------------------------------------------------------------------------

def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    """Word -> 64-bit hash, computed once per task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def _tokens(text: str | None, known: _Words) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    folded = np.full(n, width, np.uint64)
    for k in range(width):
        folded = folded * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return np.unique(_mix(folded).view(np.int64))


def _signature(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _prefix(n: int) -> int:
    """Any set of n tokens shares one of any p of them with each set it links to."""
    return n - (4 * n + 4) // 5 + 1


def _linked(overlap: Column, n: Column, m: Column) -> Column:
    return 9 * overlap >= 4 * (n + m)


# ---- steps ---------------------------------------------------------------------------------

def sets(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n, sig: size and signature of every document's set (sig null if empty)."""

    def measure(batches):
        known = _Words()
        for batch in batches:
            found = [_tokens(t, known) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"), "key": batch["key"], "n": [len(x) for x in found],
                "sig": pd.array([_signature(x) if len(x) else None for x in found], dtype="Int64"),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    return rows.mapInPandas(measure, "doc_id long, key long, n long, sig long")


def survivors(docs: DataFrame) -> DataFrame:
    """sig, n of the entities that may have a partner (see step 2)."""

    def count(batches):
        known, parts, sigs, sizes, seen, held = _Words(), [], [], [], set(), 0

        def flush():
            owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            tokens = np.concatenate(parts)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            times = np.diff(np.r_[first, len(tokens)])
            local = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(parts))
            ids = np.array(sigs, np.int64)
            once, more = first[times == 1], first[times > 1]
            none = np.zeros(0, np.int64)
            for token, sig, n, live in (
                (ids, ids, np.array(sizes, np.int64), local.astype(np.int64)),
                (tokens[once], ids[owner[once]], none, none),
                (tokens[more], none, none, none),
            ):
                for at in range(0, len(token), 100_000):
                    cut = slice(at, at + 100_000)
                    k = len(token[cut])
                    yield pd.DataFrame({
                        "token": token[cut],
                        "sig": pd.array(sig[cut] if len(sig) else [None] * k, dtype="Int64"),
                        "n": pd.array(n[cut] if len(n) else [None] * k, dtype="Int64"),
                        "live": pd.array(live[cut] if len(live) else [None] * k, dtype="Int64"),
                    })

        for batch in batches:
            for text in batch["text"]:
                found = _tokens(text, known)
                if not len(found) or (sig := _signature(found)) in seen:
                    continue
                seen.add(sig)
                part = found[: _prefix(len(found)) + len(found) // 10]
                parts.append(part)
                sigs.append(sig)
                sizes.append(len(found))
                held += len(part)
                if held > FLUSH:
                    yield from flush()
                    parts, sigs, sizes, seen, held = [], [], [], set(), 0
        if parts:
            yield from flush()

    rows = docs.select("text").mapInPandas(count, "token long, sig long, n long, live long")
    counted = rows.withColumn("times", F.count("*").over(Window.partitionBy("token")))
    entity = F.col("n").isNotNull()
    least = F.floor(F.floor((4 * F.col("size") + 4) / 5) / 10) + 1
    return (
        counted.where(entity | (F.col("sig").isNotNull() & (F.col("times") > 1)))
        .groupBy("sig")
        .agg(F.max("n").alias("size"), F.max("live").alias("live"), F.count_if(~entity).alias("elsewhere"))
        .where(F.col("live") + F.col("elsewhere") >= least)
        .select("sig", F.col("size").alias("n"))
    )


def whole_sets(docs: DataFrame, measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """sig, n, tokens: the set of each chosen entity, from its first document's text."""
    first = stage(
        measured.join(chosen.select("sig"), "sig").groupBy("sig").agg(F.min("doc_id").alias("first_id")), "first_copies"
    )
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    rows = docs.select("doc_id", "text").join(first, F.col("doc_id").eqNullSafe(F.col("first_id")))

    def expand(batches):
        known = _Words()
        for batch in batches:
            for text, sig in zip(batch["text"], batch["sig"]):
                found = _tokens(text, known)
                if len(found) and _signature(found) == sig:  # another row may share the id
                    yield pd.DataFrame({"sig": [sig], "n": [len(found)], "tokens": [found]})

    return rows.select("text", "sig").mapInPandas(expand, "sig long, n long, tokens array<long>")


def members(whole: DataFrame) -> DataFrame:
    """sig, n, live, tokens (those in other entities too) and index keys of each entity left."""
    rows = whole.select("sig", "n", F.explode("tokens").alias("token"))
    shared = stage(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared_tokens")
    lists = rows.join(shared, "token").groupBy("sig").agg(
        F.max("n").alias("n"), F.collect_set(F.struct("df", "token")).alias("t")
    )
    lists = lists.select("sig", "n", F.col("t.df").alias("df"), F.col("t.token").alias("token"))

    def index(batches):
        for batch in batches:
            out = []
            for sig, n, df, token in zip(batch["sig"], batch["n"], batch["df"], batch["token"]):
                df, token = np.asarray(df, np.int64), np.asarray(token, np.int64)
                left = _prefix(n) - (n - len(token))  # of the prefix, after tokens of no one else
                if left <= 0:
                    continue
                order = np.lexsort((token, df))
                rare = int((df <= RARE).sum())
                if left <= rare:
                    keys = token[order[:left]]
                else:
                    common = token[order[rare : rare + 2 * n // 5 + 2]].view(np.uint64)
                    pairs = _mix(common[:-1] * np.uint64(0x9E3779B97F4A7C15) + _mix(common[1:]))
                    keys = np.concatenate([token[order[:rare]], pairs.view(np.int64)])
                out.append((sig, n, len(token), np.sort(token), np.unique(keys)))
            yield pd.DataFrame(out, columns=["sig", "n", "live", "tokens", "keys"])

    return lists.mapInPandas(index, "sig long, n long, live long, tokens array<long>, keys array<long>")


def clusters(entries: DataFrame) -> DataFrame:
    """sig, centre: every member with the most complete member of each of its keys, itself too."""
    share = F.col("live") / F.col("n")
    centres = stage(
        entries.groupBy(F.col("key").alias("k")).agg(
            F.max(F.struct(share.alias("share"), "sig"))["sig"].alias("centre"), F.count("*").alias("times")
        ).where("times > 1").select("k", "centre"),
        "centres",
    )
    return entries.join(centres, F.col("key") == F.col("k")).select("sig", "centre").distinct()


def compared(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """sig, centre, n, live, linked, inside, outside for every row of ``clusters``.

    ``inside`` counts the member's tokens that its centre has too, by ``PARTS`` parts of the hash
    range, ``outside`` the others; two members share at most the sum of the smaller counts.
    """
    side = index.select("sig", "n", "tokens")
    a = side.withColumnsRenamed({"sig": "sa", "tokens": "ta"})
    b = side.withColumnsRenamed({"sig": "sb", "n": "nb", "tokens": "tb"})
    joined = pairs.join(a, F.col("sig") == F.col("sa")).join(b, F.col("centre") == F.col("sb"))

    def profile(batches):
        for batch in batches:
            out = []
            for sig, centre, n, m, x, y in batch.itertuples(index=False, name=None):
                x = np.asarray(x, np.int64)
                common = np.isin(x, y, assume_unique=True)
                part = x & (PARTS - 1)
                shared = int(common.sum())
                out.append((
                    sig, centre, n, len(x), sig != centre and 9 * shared >= 4 * (n + m),
                    np.bincount(part[common], minlength=PARTS).astype(np.int32).tobytes(),
                    np.bincount(part[~common], minlength=PARTS).astype(np.int32).tobytes(),
                ))
            yield pd.DataFrame(out, columns=["sig", "centre", "n", "live", "linked", "inside", "outside"])

    return joined.select("sig", "centre", "n", "nb", "ta", "tb").mapInPandas(
        profile, "sig long, centre long, n long, live long, linked boolean, inside binary, outside binary"
    )


def cross_pairs(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """a, b: pairs with a centre in common that may link and are in different components so far."""
    named = rows.join(labels.withColumnsRenamed({"u": "lu", "v": "lv"}), F.col("sig") == F.col("lu"), "left").select(
        "centre", "sig", "n", "live", "inside", "outside", F.coalesce("lv", "sig").alias("comp")
    )
    open_clusters = stage(
        named.groupBy(F.col("centre").alias("k"))
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("times"))
        .where("lo < hi")
        .select("k", F.ceil(F.col("times") / BLOCK).cast("int").alias("blocks")),
        "open_clusters",
    )
    own = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    spread = named.join(open_clusters, F.col("centre") == F.col("k")).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    )
    lists = spread.groupBy("centre", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(
        F.collect_list(F.struct("sig", "n", "live", "comp", "inside", "outside")).alias("rows")
    )
    lists = lists.select(*[F.col(f"rows.{c}").alias(c) for c in ("sig", "n", "live", "comp", "inside", "outside")])

    def pairs(batches):
        for batch in batches:
            for sig, n, live, comp, inside, outside in batch.itertuples(index=False, name=None):
                sig, n, live, comp = (np.asarray(x, np.int64) for x in (sig, n, live, comp))
                needed = 4 * (n[:, None] + n[None, :])
                can = (9 * np.minimum.outer(live, live) >= needed) & (
                    5 * np.minimum.outer(n, n) >= 4 * np.maximum.outer(n, n)
                ) & (comp[:, None] != comp[None, :]) & (sig[:, None] < sig[None, :])
                a, b = np.nonzero(can)
                if not len(a):
                    continue
                counts = [np.frombuffer(b"".join(x), np.int32).reshape(-1, PARTS) for x in (inside, outside)]
                most = sum(np.minimum.outer(c[:, k], c[:, k]) for c in counts for k in range(PARTS))
                keep = 9 * most[a, b] >= needed[a, b]
                yield pd.DataFrame({"a": sig[a[keep]], "b": sig[b[keep]]})

    return lists.mapInPandas(pairs, "a long, b long").distinct()


def verify(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """The pairs that link, checked on the whole sets."""
    side = index.select("sig", "n", "tokens")
    a = side.withColumnsRenamed({"sig": "sa", "n": "na", "tokens": "ta"})
    b = side.withColumnsRenamed({"sig": "sb", "n": "nb", "tokens": "tb"})
    joined = pairs.join(a, F.col("a") == F.col("sa")).join(b, F.col("b") == F.col("sb"))
    return joined.where(_linked(F.size(F.array_intersect("ta", "tb")), F.col("na"), F.col("nb"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """a, b -> u, v: every node but the smallest of its component, with that smallest node.

    Large-star hangs larger neighbours on the smallest node near, small-star the smaller ones;
    both only move edges inside a component, and they end in stars.  The smallest neighbour is an
    aggregate with map-side combine, so a node with very many links is no single task's work.
    """
    def state(edges):
        row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        return row[0], row[1]

    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("lo"))
        large = (
            both.where("v > u").join(lowest, F.col("u") == F.col("c"))
            .select(F.col("v").alias("u"), F.least("lo", "u").alias("v")).distinct()
        )
        large = stage(large, "large_star")
        lowest = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("lo"))
        moved = large.join(lowest, F.col("u") == F.col("c")).where("v <> lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
        edges = stage(moved.unionByName(lowest.select(F.col("c").alias("u"), F.col("lo").alias("v"))).distinct(), "small_star")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges


def links(docs: DataFrame, measured: DataFrame) -> DataFrame:
    """Pairs of signatures (a, b) whose components are those of all links."""
    chosen = stage(survivors(docs), "survivors")
    index = stage(members(stage(whole_sets(docs, measured, chosen), "whole_sets")), "members")
    entries = index.select("sig", "n", "live", F.explode("keys").alias("key"))
    rows = stage(compared(clusters(entries), index), "clusters")
    star = rows.where("linked").select(F.col("sig").alias("a"), F.col("centre").alias("b"))
    crossing = stage(cross_pairs(rows, components(star)), "cross_pairs")
    return star.unionByName(verify(crossing, index))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n, comp: the component of every document, null without words."""
    measured = stage(sets(docs), "sets")
    roots = components(links(docs, measured))
    return measured.join(roots, F.col("sig") == F.col("u"), "left").select(
        "doc_id", "key", "n", F.coalesce("v", "sig").alias("comp")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    named = labelled(docs)
    lowest = stage(
        named.where("comp is not null").groupBy(F.col("comp").alias("c")).agg(F.min("doc_id").alias("lowest")), "lowest_ids"
    )
    return named.join(lowest, F.col("comp") == F.col("c"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("lowest")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without those that link, directly or not, to one of a smaller id.

    Of texts with one id in one component that with the smallest hash stays, and of repeated rows
    (same id and text) the one whose other columns hash lowest.  All columns pass through.
    """
    named = stage(labelled(docs), "labelled")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")).alias("first")
    kept = named.where("comp is not null").groupBy("comp").agg(first).select("first.doc_id", "first.key").unionByName(
        named.where("comp is null").select("doc_id", "key").distinct()
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"),
        F.xxhash64(*docs.columns).alias("order"), F.struct(*docs.columns).alias("row"),
    )
    chosen = rows.join(
        kept, rows["id"].eqNullSafe(kept["doc_id"]) & (rows["text_key"] == kept["key"]), "left_semi"
    )
    return chosen.groupBy("id", "text_key").agg(F.min_by("row", "order").alias("row")).select("row.*")
