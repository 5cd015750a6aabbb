"""N-gram Jaccard join by prefix filtering under several global token orders, and the classes its links form.

Two sets link when 100 * intersection >= percent * union. A set of n tokens has a prefix of n - ceil(percent * n / 100) + 1 tokens
under any global order of all tokens, and two sets that link share a prefix token under every order. Three orders filter:

1. "early": a fixed share of all tokens, chosen by hash, comes first, rarest first within it. Only these tokens cross the first
   shuffle. A set whose early prefix holds no token of another set links with nothing and is done.
2. rarest first, by document frequency among the sets that are left.
3. by the magnitude of that frequency, then by another hash.

Candidates share a prefix token under order 2, must share one under order 3, and must pass the bounds on size and on overlap
before their sets are intersected; the prefixes are compared first, with narrow rows, and only pairs that pass meet their sets. Sets that are equal count once.

Links within a class that is already connected change nothing, so groups of near copies are not expanded into pairs: in each bucket of
order 2 all sets are first compared with one pivot, the set with the fewest tokens of its own, then with others; only pairs
of sets that are still in different classes are compared afterwards, all of them. The classes are exact. jaccard_links and jaccard_pairs
compare all candidate pairs instead and lose no link, within classes neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .caches import claim
from .common import BROADCAST_KEYS, drop_tables, numbered, quoted, read_table, release, row_key, stored, text_of, without_rows
from .components import connected_components
from .shingles import mix, shingle_set


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _signature(s: np.ndarray) -> tuple[int, int]:
    raw = s.tobytes()
    return tuple(int.from_bytes(xxhash.xxh64_digest(raw, seed), "little", signed=True) for seed in (1, 2))


def _early(s: np.ndarray, percent: int, share: float) -> np.ndarray:
    """The early tokens, and if they don't fill the prefix, as many of the others in hash order."""
    h = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    first = h < np.uint64(int(share * 2.0**64))
    out, want = s[first], _prefix(len(s), percent)
    if len(out) < want:
        rest = ~first
        out = np.concatenate([out, s[rest][np.argsort(h[rest], kind="stable")[: want - len(out)]]])
    return out


def _long_lists(parts: list[np.ndarray]) -> pa.Array:
    stops = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(flat))


def _scan(rows: DataFrame, size: int, percent: int, share: float) -> DataFrame:
    """Of rows (text, and others that are carried): the others, s1, s2 (the set's signature), n, early."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = [shingle_set(t, size) for t in part.column(0).to_pylist()]
                s1, s2 = zip(*map(_signature, sets), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.array(s1), pa.array(s2), pa.array([len(s) for s in sets], pa.int64()), _long_lists([_early(s, percent, share) if len(s) else s for s in sets])],
                    names=[*others, "s1", "s2", "n", "early"],
                )

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in others)
    return rows.select("text", *others).mapInArrow(run, f"{kinds}s1 long, s2 long, n long, early array<long>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """s1, s2, n, tokens, of rows (text, s1, s2) whose text has the signature it is taken for; a signature once, however often its rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles")
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = [shingle_set(t, size) for t in part.column(0).to_pylist()]
                kept = [k for k, (s, a, c) in enumerate(zip(sets, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)) if _signature(s) == (a, c)]
                at = pa.array(kept, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in (1, 2)), pa.array([len(sets[k]) for k in kept], pa.int64()), _long_lists([sets[k] for k in kept])], names=["s1", "s2", "n", "tokens"])

    return rows.select("text", "s1", "s2").mapInArrow(run, "s1 long, s2 long, n long, tokens array<long>").dropDuplicates(["s1", "s2"])


def _bounds(percent: int) -> Column:
    """Whether sets of n and m tokens whose first common token has as many as d1 and e1 tokens before it can link; a pair that links passes at that token."""
    need = F.col("n") + F.col("m")
    most = F.least(F.col("n") - F.col("d1"), F.col("m") - F.col("e1"))
    return (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & ((100 + percent) * most >= percent * need)


def _prefixes(rows: DataFrame, at: str, size: int, percent: int, early_share: float | None) -> tuple[DataFrame, str, DataFrame]:
    """Of rows (text, and others, of which at finds a row again): s1, n, d1, tokens, p2, p3 of the sets that may link, and the table's path; and the others, s1, s2, n of all rows."""
    if not 1 <= percent <= 100:
        raise ValueError("percent: 1 to 100")
    spark = rows.sparkSession
    share = min(1.0, 1.5 * (100 - percent) / 100 + 0.01) if early_share is None else early_share
    scan, scan_path = stored(_scan(rows, size, percent, share), "shingle-scan")
    real = scan.filter(_counts(at))
    prefix = F.expr(f"n - ({percent} * n + 99) DIV 100 + 1")

    # order 1: how many early tokens no other set has; a token of one set has the same least and greatest s1, however many copies
    alone = real.select("s1", F.explode("early").alias("token")).groupBy("token").agg(F.min("s1").alias("s1"), F.max("s1").alias("hi")).filter("s1 = hi").groupBy("s1").agg(F.count(F.lit(1)).alias("d1"))
    reps = real.groupBy("s1", "s2").agg(F.min(at).alias(at), F.min("n").alias("n"))
    left, left_path = stored(reps.join(alone, "s1", "left").filter(F.coalesce("d1", F.lit(0)) < prefix).select(at, "s1", "s2"), "order-1")
    members, _ = stored(scan.drop("early"), "members")
    drop_tables(spark, [scan_path])
    release(spark)
    few = left.count() <= BROADCAST_KEYS
    sets, sets_path = stored(_sets(rows.select(at, "text").join(F.broadcast(left) if few else left, at), size), "sets")

    # order 2: document frequencies among these sets; tokens of one set only are counted for it at once
    both = sets.select("s1", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("s1").alias("s1"), F.max("s1").alias("hi"), F.count(F.lit(1)).alias("df"))
    own, one = F.col("s1") == F.col("hi"), F.lit(1).cast("long")
    both = both.groupBy(own.alias("own"), F.when(own, F.col("s1")).otherwise(F.col("token")).alias("key")).agg(F.sum(F.when(own, one).otherwise(F.col("df"))).alias("n"))
    both, both_path = stored(both, "frequencies")
    kept = sets.join(both.filter("own").select(F.col("key").alias("s1"), F.col("n").alias("d1")), "s1", "left").withColumn("d1", F.coalesce("d1", F.lit(0))).filter(F.col("d1") < prefix)
    kept, kept_path = stored(kept, "order-2")
    shared = kept.select("s1", F.explode("tokens").alias("token")).join(both.filter("NOT own").select(F.col("key").alias("token"), F.col("n").alias("df")), "token")
    ranked = shared.groupBy("s1").agg(
        F.array_sort(F.collect_list(F.struct("df", "token"))).alias("by_df"),
        F.array_sort(F.collect_list(F.struct(F.floor(F.log2("df")).alias("size"), F.xxhash64("token").alias("hash")))).alias("by_size"),
    )
    take = F.greatest(prefix - F.col("d1"), F.lit(0)).cast("int")
    final, final_path = stored(
        kept.join(ranked, "s1").select("s1", "n", "d1", "tokens", F.slice("by_df.token", F.lit(1), take).alias("p2"), F.slice("by_size.hash", F.lit(1), take).alias("p3")),
        "prefixes",
    )
    drop_tables(spark, [left_path, sets_path, both_path, kept_path])
    release(spark)
    return final, final_path, members


def _counts(at: str) -> Column:
    return (F.col("n") > 0) & F.col(at).isNotNull()


def _postings(final: DataFrame) -> DataFrame:
    """s1, n, d1 (the number of tokens before it), token."""
    return final.select("s1", "n", "d1", F.posexplode("p2").alias("at", "token")).select("s1", "n", (F.col("d1") + F.col("at")).alias("d1"), "token")


def _verified(final: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """u, v, common of pairs x, y that share an order-3 prefix token and link."""
    side = lambda k, *cols: final.select(F.col("s1").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in cols))
    near = pairs.distinct().join(side("x", "p3"), "x").join(side("y", "p3"), "y").filter(F.arrays_overlap("p3_x", "p3_y")).select("x", "y")
    both = near.join(side("x", "n", "tokens"), "x").join(side("y", "n", "tokens"), "y").withColumn("common", F.size(F.array_intersect("tokens_x", "tokens_y")))
    return both.filter((100 + percent) * F.col("common") >= percent * (F.col("n_x") + F.col("n_y"))).select(F.col("x").alias("u"), F.col("y").alias("v"), "common")


def _one_id(members: DataFrame) -> DataFrame:
    """u, v: sets that stand under one doc_id."""
    many = members.groupBy("doc_id").agg(F.min("s1").alias("v"), F.max("s1").alias("hi")).filter("v <> hi").select("doc_id", "v")
    return members.join(many, "doc_id").select(F.col("s1").alias("u"), "v").filter("u <> v").distinct()


def _connected(final: DataFrame, final_path: str, percent: int, more: DataFrame | None = None) -> DataFrame | None:
    """node, component (sets by s1) of all sets that links, or the edges u, v in more, connect; None if nothing does."""
    spark, postings = final.sparkSession, _postings(final)
    edges, paths, classes, class_path, quiet = None, [], None, None, False
    if more is not None:
        more, path = stored(more, "same-id")
        paths.append(path)
        if not more.isEmpty():
            edges = more
            classes, class_path = connected_components(edges)
    for k in range(8):
        now = postings if classes is None else postings.join(classes.withColumnRenamed("node", "s1"), "s1", "left")
        now = now.withColumn("label", F.col("s1") if classes is None else F.coalesce("component", "s1")).select("s1", "n", "d1", "token", "label")
        rank = F.col("d1") if k == 0 else F.xxhash64("s1", F.lit(k))
        pivots = now.groupBy("token").agg(
            F.min(F.struct(rank.alias("rank"), "s1", F.col("n").alias("m"), F.col("d1").alias("e1"), "label")).alias("pivot"), F.min("label").alias("lo"), F.max("label").alias("hi")
        )
        # written first, so that a bucket's rows come straight from an exchange and adaptive execution can split those of a hot token
        pivots, path = stored(pivots.filter("lo < hi").select("token", F.col("pivot.s1").alias("y"), "pivot.m", "pivot.e1", F.col("pivot.label").alias("other")), "pivots")
        paths.append(path)
        joined = now.withColumnRenamed("s1", "x").join(pivots, "token").filter(F.col("label") != F.col("other"))
        if k:  # compare all that is still apart once pivots find nothing new, or once that is no more than a few comparisons for each posting
            apart, size_of = joined.groupBy("token").agg(F.count(F.lit(1)).alias("r")), now.groupBy("token").agg(F.count(F.lit(1)).alias("s"))
            work = apart.join(size_of, "token").agg(F.sum(F.col("r") * F.col("s"))).first()[0] or 0
            if quiet or work <= 4 * postings.count() or k == 7:
                rest, path = stored(joined.drop("y", "m", "e1", "other"), "apart")
                paths.append(path)
                others = now.select("token", F.col("s1").alias("y"), F.col("n").alias("m"), F.col("d1").alias("e1"), F.col("label").alias("other"))
                pairs = rest.join(others, "token").filter((F.col("label") != F.col("other")) & _bounds(percent))
                pairs = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
                k = -1
            else:
                pairs = joined.filter(_bounds(percent)).select("x", "y")
        else:
            pairs = joined.filter(_bounds(percent)).select("x", "y")
        found, path = stored(_verified(final, pairs, percent).select("u", "v"), "links")
        paths.append(path)
        edges = found if edges is None else edges.union(found)
        quiet = found.isEmpty()
        if not quiet:
            old = class_path
            classes, class_path = connected_components(edges)
            drop_tables(spark, [old] if old else [])
        if k == -1:
            break
    drop_tables(spark, [*paths, final_path])
    return classes


def _best(members: DataFrame, classes: DataFrame | None, first: Column) -> DataFrame:
    """s1, s2, rows, best: the least first of the rows of the set's class, and in how many rows the set stands."""
    sets, _ = stored(members.groupBy("s1", "s2").agg(F.min(first).alias("own"), F.count(F.lit(1)).alias("rows")), "representatives")
    if classes is None:
        return sets.select("s1", "s2", "rows", F.col("own").alias("best"), F.lit(False).alias("linked"))
    # written first, so that the sets of a large class can be split in the join
    linked, linked_path = stored(sets.select("s1", "own").join(classes.withColumnRenamed("node", "s1"), "s1"), "linked")
    least, least_path = stored(linked.groupBy("component").agg(F.min("own").alias("best")), "least")
    of_set, _ = stored(linked.select("s1", "component").join(least, "component").groupBy("s1").agg(F.min("best").alias("best")), "best")
    drop_tables(members.sparkSession, [linked_path, least_path])
    return sets.join(of_set, "s1", "left").select("s1", "s2", "rows", F.coalesce("best", "own").alias("best"), F.col("best").isNotNull().alias("linked"))


def jaccard_classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", early_share: float | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, the least doc_id that links lead to, its own included.

    Words are runs of non-blank characters after lower-casing A-Z; a text's tokens are its distinct shingles of size words, or all its
    words as one if there are fewer. Texts without words, and null texts, have no token and link with nothing: their component_id is their own id.
    A document is an id: rows that repeat it are one node, which links with whatever any of its texts links with. Rows with a null id link with nothing and get a null
    component_id. Ids may be of any type that has an order. Other columns are ignored, whatever their names. Texts may be as long as memory for one row allows.
    An empty table gives no rows. Shingles, and sets, are compared by 64-bit hashes.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), text_of(quoted(text_col)).alias("text"))
    final, final_path, members = _prefixes(rows, "doc_id", size, percent, early_share)
    real = members.filter(_counts("doc_id"))
    # written first, so that the copies of one set can be split in the join
    chosen, _ = stored(_best(real, _connected(final, final_path, percent, _one_id(real)), F.col("doc_id")).select("s1", "s2", "best"), "classes")
    out = members.join(chosen, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("best")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _links(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, early_share: float | None) -> tuple[DataFrame, DataFrame]:
    """u, v (two sets' s1, u < v), common of all links between different sets; and doc_id, s1, s2, n of all rows."""
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("doc_id"), text_of(quoted(text_col)).alias("text"))
    final, final_path, members = _prefixes(rows, "doc_id", size, percent, early_share)
    # written first, as are the pairs, so that adaptive execution can split a hot token's or a hot set's rows
    postings, postings_path = stored(_postings(final), "postings")
    others = postings.select("token", F.col("s1").alias("y"), F.col("n").alias("m"), F.col("d1").alias("e1"))
    pairs = postings.withColumnRenamed("s1", "x").join(others, "token").filter((F.col("x") < F.col("y")) & _bounds(percent)).select("x", "y")
    pairs, pairs_path = stored(pairs.distinct(), "pairs")
    drop_tables(spark, [postings_path])
    found, _ = stored(_verified(final, pairs, percent), "links")
    drop_tables(spark, [pairs_path, final_path])
    release(spark)
    return found, members


def jaccard_pairs(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", early_share: float | None = None) -> DataFrame:
    """One row per link between two different sets: x, y (the least doc_id of each set), n_x, n_y, common (their numbers of tokens, and of those of both). Rows, sets and ids are as in jaccard_classes."""
    found, members = _links(docs, size, percent, id_col, text_col, early_share)
    chosen, _ = stored(members.filter(_counts("doc_id")).groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "representatives")
    side = lambda s, k: chosen.select(F.col("s1").alias(s), F.col("rep").alias(k), F.col("n").alias(f"n_{k}"))
    return found.join(side("u", "x"), "u").join(side("v", "y"), "v").select("x", "y", "n_x", "n_y", "common")


def jaccard_links(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", early_share: float | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, rep_id (the least doc_id with an equal set), n_links, the number of other documents that its set links with.

    A document is an id with a set: rows that repeat both count once. Equal sets link; each is verified once and counted with its documents. Every link
    between different sets is verified, also within a class, so the work grows with the number of links. Rows without words or without an id have no link.
    Sets, rows and ids are as in jaccard_classes.
    """
    found, members = _links(docs, size, percent, id_col, text_col, early_share)
    real = members.filter(_counts("doc_id")).groupBy("s1", "s2", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    copies, _ = stored(real.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep_id"), F.count(F.lit(1)).alias("copies")), "copies")
    both = found.select("u", "v").union(found.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(copies.select(F.col("s1").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("more"))
    chosen = copies.join(linked, copies.s1 == linked.u, "left").select("s1", "s2", "rep_id", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    chosen, _ = stored(chosen, "representatives")
    ok = _counts("doc_id")
    return members.join(chosen, ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(ok, F.col("rep_id")).otherwise(F.col("doc_id")).alias("rep_id"), F.when(ok, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links")
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of linked texts, that of the least id (of one id's texts, the first by hash); all columns stay, whatever their names.

    Rows are judged one by one, not by id: of an id's several texts each stands for itself, and rows without an id link like others, and go before rows with one. Of rows that
    repeat an id and a text, the first stays by its other columns as JSON. Rows without words, null texts among them, link with nothing and all stay. An empty table stays empty.
    """
    plain, (own, text) = numbered(docs, id_col, text_col)
    key = row_key(own, text)
    final, final_path, members = _prefixes(plain.select(own.alias("doc_id"), text_of(text).alias("text"), key.alias("key")), "key", size, percent, None)
    real = members.filter(_counts("key"))
    sets = _best(real, _connected(final, final_path, percent), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    chosen, _ = stored(sets.filter("linked OR rows > 1").select("s1", "s2", F.col("best.key").alias("best")), "classes")
    few = chosen.count() <= BROADCAST_KEYS
    found = real.join(F.broadcast(chosen) if few else chosen, ["s1", "s2"]).groupBy("key").agg(F.first(F.col("key") != F.col("best")).alias("gone"), F.count(F.lit(1)).alias("n"))
    return without_rows(plain, key, found.filter("gone OR n > 1"), docs.columns)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents"), size=3, percent=90)


def op4_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(read_table(spark, sf_dir, "documents"), size=3, percent=90)
