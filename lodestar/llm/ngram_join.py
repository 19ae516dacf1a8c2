"""Groups of documents whose sets of word shingles are alike, by an exact Jaccard join."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import claim, others, small_batches, staged, unstaged
from lodestar.llm.components import components
from lodestar.llm.tiles import groups
from lodestar.llm.words import in_parts, shingle_sets

#: Bits of a set's signature: the power of two that holds its size, between these.
NARROW, WIDE = 64, 8192
#: Rows and bytes of sets of one tile, and the rows that every block of a larger one meets first.
TILE, TILE_BYTES, LEADERS = 2048, 8 << 20, 16
#: Shingles counted at a time when looking for frequent ones, and how many a task and the job report at most.
COUNTED, TASK_FREQUENT, FREQUENT = 2_000_000, 20_000, 200_000
#: Digests that a task remembers, to pass over what it has seen. Forgetting costs time only.
REMEMBERED = 100_000


def _width(n: int) -> int:
    return min(WIDE, max(NARROW, 1 << max(0, n - 1).bit_length()))


def _signature(own: np.ndarray, width: int) -> np.ndarray:
    """Bit i: whether an odd number of the set's hashes fall on it. Two signatures differ in no more bits than the sets in elements."""
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64)


def _prefix(own: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """So many hashes, frequent ones last, that two sets alike enough share one of theirs."""
    n = len(own)
    need = -(-num * n // den)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
        often = frequent[at] == own
        own = np.concatenate([own[~often], own[often]])
    return own[: n - need + 1]


class _Sets:
    """Signatures, by width, of the members of a tile in order of size, and their links."""

    def __init__(self, sizes: np.ndarray, signatures: list[np.ndarray], num: int, den: int):
        self.n, self.num, self.den = sizes, num, den
        self.labels = np.arange(len(sizes))
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.words = np.array([len(s) for s in signatures])
        for w in np.unique(self.words):
            rows = np.flatnonzero((self.words == w) | (self.words == 2 * w))
            self.at[int(w)] = rows, np.stack([s if len(s) == w else s[:w] ^ s[w:] for s in (signatures[r] for r in rows)])

    def link(self, exact: Callable[[int, int], bool] | None = None, left: np.ndarray | None = None) -> np.ndarray:
        """Labels of the groups that the links make; left: only links with one of these rows are looked for.

        The differing bits bound the overlap from above; pairs within the bound are tested exactly, if exact is given.
        Rows that are in one group already aren't compared.
        """
        num, den = self.num, self.den
        for w, (rows, bits) in self.at.items():
            n = self.n[rows]
            for k in np.flatnonzero(self.words[rows] == w):
                i = rows[k]
                stop = np.searchsorted(n, self.n[i] * den // num, side="right")
                if left is None or left[i]:
                    others_ = np.arange(k + 1, stop)
                else:
                    others_ = k + 1 + np.flatnonzero(left[rows[k + 1 : stop]])
                others_ = others_[self.labels[rows[others_]] != self.labels[i]]
                if not len(others_):
                    continue
                both = self.n[i] + n[others_]
                overlap = (both - np.bitwise_count(bits[others_] ^ bits[k]).sum(axis=1)) // 2
                for j in rows[others_[(num + den) * overlap >= num * both]]:
                    if self.labels[j] != self.labels[i] and (exact is None or exact(i, j)):
                        a, b = sorted((self.labels[i], self.labels[j]))
                        self.labels[self.labels == b] = a
        return self.labels


class _Seen(set):
    """Whether a key came before, as far as remembered."""

    def new(self, key) -> bool:
        if key in self:
            return False
        if len(self) >= REMEMBERED:
            self.clear()
        self.add(key)
        return True


def _digest(own: np.ndarray, size: int = 16) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=size).digest()


def _edges(ids: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
    away = labels != np.arange(len(labels))
    return pa.RecordBatch.from_arrays([pa.array(ids[away]), pa.array(ids[labels][away])], names=["a", "b"])


def frequent_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Hashes of shingles that many documents hold, FREQUENT at most. They only order the prefixes, so any choice keeps the result.

    Every task counts all its documents and reports what it met four times or more in COUNTED shingles.
    """

    def run(batches):
        claim("ngram_join")
        own: list[np.ndarray] = []
        size = 0

        def counted():
            h, n = np.unique(np.concatenate(own), return_counts=True)
            often = np.flatnonzero(n >= 4)
            often = often[np.argsort(-n[often], kind="stable")[:TASK_FREQUENT]]
            return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["h", "n"])

        for b in in_parts(batches, "x"):
            for one in shingle_sets(b.column("x"), width):
                own.append(one)
                size += len(one)
                if size >= COUNTED:
                    yield counted()
                    own, size = [], 0
        if size:
            yield counted()

    top = texts.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow()
    return np.sort(top.column("h").to_numpy().view(np.uint64))


def group_similar(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of df: documents link when den * intersection >= num * union.

    1. Each text gives the size of its set, a digest, a bit signature, and a prefix: the first hashes in an order with frequent ones last,
       so many that two alike sets share one. Equal sets are one from here on, under their smallest id.
    2. Sets that share a prefix hash make a tile; tiles with the same members count once, and rows stand in order of size.
       Within a tile's size bands, differing signature bits bound the overlap from above; what stays linked makes clusters.
    3. Only documents in clusters are read again. Within a cluster the bound comes first, then the exact intersection of sorted arrays.
    4. Components of the links, by stars; copies get that of their set.

    A tile or cluster of more than TILE rows or TILE_BYTES is dealt in blocks that all meet the same few leaders; what then isn't yet in its
    largest group meets every block. So no pair is lost: a group of near copies takes time in proportion to its size, and r rows of n
    that aren't like any leader take r * n / TILE block pairs. No task holds more than two such blocks, or two sets that are larger.

    doc_id must be a whole number. Rows with null, empty or blank texts have 0 shingles and link with nothing; rows
    with a null id link with nothing and have component_id null. Rows with one id are one node. Ties and repeated rows: equal sets link. An empty df
    gives an empty result. Extra columns are ignored. Texts are read whole, of any length.
    """
    rows = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("x"))
    spark = df.sparkSession

    def described(batches):
        claim("ngram_join")
        seen = _Seen()
        for b in in_parts(batches, "x"):
            n, digest, prefix, bits = [], [], [], []
            for own, known in zip(shingle_sets(b.column("x"), width), b.column("id").is_valid().to_pylist()):
                n.append(len(own))
                d = _digest(own) if len(own) and known else None
                digest.append(d)
                first = d is not None and seen.new(d)
                prefix.append(_prefix(own, frequent.value, num, den).view(np.int64) if first else None)
                bits.append(_signature(own, _width(len(own))).tobytes() if first else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["id", "n", "digest", "prefix", "bits"])

    with small_batches(spark):
        frequent = spark.sparkContext.broadcast(frequent_shingles(rows.select("x"), width))
        docs = staged(rows.mapInArrow(described, "id bigint, n bigint, digest binary, prefix array<bigint>, bits binary"), "shingle-sets")
    known = docs.where("digest IS NOT NULL")
    unique = staged(known.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("prefix", True).alias("prefix"), F.first("bits", True).alias("bits")), "unique-sets")

    def tiles(batches):
        """Tiles of two or more members, under the name of their members. One of more than 2 TILE is passed on as it comes, under its hash."""
        claim("ngram_join")
        done = _Seen()
        held: list[np.ndarray] = []
        hash_, large = None, False

        def closed():
            members = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            if len(members) < 2:
                return None
            name = int.from_bytes(_digest(members, 8), "little", signed=True)
            return (np.full(len(members), name), members, False) if done.new(name) else None

        def batch(found):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([t for t, _, _ in found])), pa.array(np.concatenate([m for _, m, _ in found])), pa.array(np.concatenate([np.full(len(m), b) for _, m, b in found]))], names=["tile", "id", "large"])

        for b in batches:
            if not b.num_rows:
                continue
            h, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            out: list[tuple[np.ndarray, np.ndarray, bool]] = []
            # Groups that begin and end in this batch with one member are passed over at once.
            sizes = np.diff(cuts)
            for g in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)):
                own = ids[cuts[g] : cuts[g + 1]]
                if hash_ != h[cuts[g]]:
                    if not large and (t := closed()):
                        out.append(t)
                    hash_, held, large = h[cuts[g]], [], False
                held.append(own)
                if not large and sum(map(len, held)) > 2 * TILE:
                    large = True
                if large:
                    own = np.concatenate(held)
                    out.append((np.full(len(own), hash_), own, True))
                    held = []
            if out:
                yield batch(out)
        if not large and (t := closed()):
            yield batch([t])

    postings = unique.select(F.explode("prefix").alias("h"), "id")
    tiled = staged(postings.repartition("h").sortWithinPartitions("h", "id").mapInArrow(tiles, "tile bigint, id bigint, large boolean").distinct(), "tiles")

    def bounded(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray], None]:
        return t.column("n").to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in t.column("bits").to_pylist()], None

    signed = unique.select("id", "n", "bits")
    with small_batches(spark, 10_000):
        sizes = _blocks(tiled.where("large"), F.lit(0))
        near = _linked(tiled.where("NOT large").join(signed, "id"), tiled.where("large").join(sizes, "tile").join(signed, "id"), sizes, ["n", "bits"], bounded, num, den)
        clusters = staged(components(near).select(F.col("node").alias("id"), F.col("component").alias("tile")), "clusters")
    unstaged(near, tiled)

    def sets(batches):
        claim("ngram_join")
        seen = _Seen()
        for b in in_parts(batches, "x"):
            own = [x.tobytes() for x in shingle_sets(b.column("x"), width)]
            keep = [seen.new((c, i, hashlib.blake2b(o, digest_size=16).digest())) for c, i, o in zip(b.column("tile").to_pylist(), b.column("id").to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([b.column("tile"), b.column("id"), pa.array(own, pa.binary())], names=["tile", "id", "own"]).filter(pa.array(keep, pa.bool_()))

    def verified(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray], Callable[[int, int], bool]]:
        own = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("own")]

        def exact(i, j):
            a, b = sorted((own[i], own[j]), key=len)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            common = int((b[at] == a).sum())
            return den * common >= num * (len(a) + len(b) - common)

        return np.array([len(x) for x in own]), [_signature(x, _width(len(x))) for x in own], exact

    with small_batches(spark):
        # Merged at every size, so that the plan is the same for a few clusters as for many.
        full = staged(rows.join(clusters.hint("merge"), "id").select("tile", "id", "x").mapInArrow(sets, "tile bigint, id bigint, own binary"), "cluster-sets")
        sizes = _blocks(full, F.octet_length("own"))
        links = _linked(full.join(sizes, "tile", "left_anti"), full.join(sizes, "tile"), sizes, ["own"], verified, num, den)
        # Rows with one id are one node, also where their texts differ.
        several = known.groupBy("id").agg((F.min("digest") != F.max("digest")).alias("more")).where("more").select("id")
        several = known.join(several, "id").join(unique.select("digest", F.col("id").alias("b")), "digest").select(F.col("id").alias("a"), "b")
        linked = components(links.unionByName(several)).withColumnsRenamed({"node": "id"})
    unstaged(full, links)
    named = unique.select("digest", "id").join(linked, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = docs.select("id", "n", "digest").where("digest IS NOT NULL").join(named, "digest").select("id", "n", "component")
    out = out.unionByName(docs.where("digest IS NULL").select("id", "n", F.col("id").alias("component")))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _blocks(members: DataFrame, size: Column) -> DataFrame:
    """(tile, k): the number of blocks of each tile of members that is larger than one, by rows and by bytes (the sum of size)."""
    own = F.ceil(F.greatest(F.count("*") / TILE, F.sum(size) / TILE_BYTES)).cast("int")
    return staged(members.groupBy("tile").agg(own.alias("k")).where("k > 1"), "tile-blocks")


def _linked(small: DataFrame, large: DataFrame, sizes: DataFrame, payload: list[str], described: Callable, num: int, den: int) -> DataFrame:
    """(a, b): links that join the same members as all links within a tile do.

    small: (tile, id, payload), of tiles that a task can hold. large: the same with k, the number of blocks, for the tiles of sizes, which no task
    holds whole. described gives the sizes, the signatures and the exact test of a table's rows.
    """

    def linked(batches):
        claim("ngram_join")
        for t in groups(batches, "tile"):
            n, bits, exact = described(t)
            order = np.argsort(n, kind="stable")
            outside = np.array(t.column("outside").to_pylist(), dtype=bool)[order]
            s = _Sets(n[order], [bits[i] for i in order], num, den)
            found = _edges(t.column("id").to_numpy()[order], s.link(exact and (lambda i, j: exact(order[i], order[j])), None if outside.all() else outside))
            if found.num_rows:
                yield found

    def run(tiles: DataFrame) -> DataFrame:
        return tiles.select("tile", "id", *payload, "outside").repartition("tile").sortWithinPartitions("tile").mapInArrow(linked, "a bigint, b bigint")

    yes, no, upto = F.lit(True), F.lit(False), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    links = run(small.withColumn("outside", yes))
    if sizes.isEmpty():
        return staged(links, "links")
    many = staged(large.withColumn("mine", F.pmod(F.xxhash64("id"), F.col("k")).cast("int")), "blocks")
    # The rows with the smallest of some random numbers lead: LEADERS about, and one at least.
    place = F.xxhash64("id", F.lit(7))
    lead = staged(many.groupBy("tile").agg(F.min(place).alias("least"), (LEADERS / F.count("*")).alias("share")), "leaders")
    leaders = many.join(lead, "tile").where((place == F.col("least")) | (place / 2.0**64 + 0.5 < F.col("share")))
    leaders = leaders.select("tile", "id", *payload, F.explode(F.filter(upto("k"), lambda i: i != F.col("mine"))).alias("mine"))
    met = many.select("tile", "id", *payload, "mine").unionByName(leaders)
    first = staged(run(met.select(F.xxhash64("tile", "mine").alias("tile"), "id", *payload, yes.alias("outside"))), "leader-links")
    group = many.select("tile", "id").join(components(first).withColumnsRenamed({"node": "id"}), "id", "left")
    group = staged(group.select("tile", "id", F.coalesce("component", "id").alias("part")), "leader-groups")
    main = staged(group.groupBy("tile", "part").count().groupBy("tile").agg(F.max_by("part", F.struct("count", "part")).alias("main")), "main-groups")
    out = staged(group.join(main, "tile").where("part <> main").select("tile", "id"), "outside")
    if out.isEmpty():
        return staged(links.unionByName(first), "links")
    outside = staged(many.join(out, ["tile", "id"], "left_semi"), "outside-rows")
    counts = staged(outside.groupBy("tile").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum(F.octet_length(payload[-1])) / TILE_BYTES)).cast("int").alias("j")), "outside-blocks")
    a = outside.join(counts, "tile").select("tile", "id", *payload, yes.alias("outside"), F.explode(upto("k")).alias("mine"), F.pmod(F.xxhash64("id", F.lit(3)), F.col("j")).cast("int").alias("of"))
    b = many.join(counts, "tile").select("tile", "id", *payload, no.alias("outside"), "mine", F.explode(upto("j")).alias("of"))
    second = run(a.unionByName(b).select(F.xxhash64("tile", "mine", "of").alias("tile"), "id", *payload, "outside"))
    out = staged(links.unionByName(first).unionByName(second), "links")
    unstaged(many, first, group, outside)
    return out


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df without the documents that link, also by way of others, to a smaller id. Rows with a null id stay; rows with the kept id all stay."""
    found = group_similar(df, doc_id, text, **options).where(F.col("component_id") != F.col(doc_id)).select(F.col(doc_id).alias("__gone")).distinct()
    return df.join(found, F.col(f"`{doc_id}`") == F.col("__gone"), "left_anti").select(*(F.col(f"`{c}`") for c in others(df)))


#: The contract's query for DuckDB: links by counting the common shingles of all pairs that have any, groups by handing smaller ids on.
SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM worded),
sized AS MATERIALIZED (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
postings AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM postings a JOIN postings b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT c.a, c.b FROM common c JOIN sized x ON c.a = x.doc_id JOIN sized y ON c.b = y.doc_id WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(id, c) AS (SELECT doc_id, doc_id FROM sized UNION SELECT e.b, r.c FROM reached r JOIN edges e ON e.a = r.id WHERE r.c < e.b)
SELECT s.doc_id, s.n AS n_shingles, min(r.c) AS component_id FROM sized s JOIN reached r ON s.doc_id = r.id GROUP BY s.doc_id, s.n
"""
