"""Near-duplicate texts by a chosen-path set similarity join.

Texts become sets of hashed word shingles.  Texts of one set are one class.  Shingles that no other class
holds bound what a class can share: one with too many of them links with nothing and needs no search.
Most such classes show by every eighth shingle (by hash), the others by all.
The others get short minwise signatures.  Each tree has hash functions of its own, a stretch of the signature; a node branches its
classes by one or two places of it, chosen by the node; classes with the same minwise token there
share a child.  So many trees are taken as a target recall needs for a pair just at the threshold.
Nodes whose classes are already linked end; small nodes are compared exhaustively; the others
branch again.  Links are confirmed on full sets.

Nothing grows with the square of a group: every node first compares its members with its smallest
one, and after that only members of different components meet.  Where two members meet, one bit of each
of their sketches' places is compared first, so that what leaves a node are pairs near the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, free_name, slices, written

#: Places of each tree's stretch of the signature.
PLACES, DEPTH = 24, 12
#: Share of the pairs at the threshold that some tree must bring together even in nodes that stay large.
RECALL = 0.99
#: A second place is chosen by this share of nodes: branching of 1 / similarity on average.
SECOND = 0.25
#: Pairs whose sketches (the first places of their signatures) agree less than this below the threshold
#: are not read in full: more than five standard deviations.
SKETCH, SLACK = 256, 0.15
#: Bits of sketches may differ by so many standard deviations more than is expected at the threshold.
DEVIATIONS = 4
#: One shingle in so many is drawn to find classes that hold far too many of their own: by five standard
#: deviations more than a class at the threshold.
DRAWN, SURE = 8, 5
#: A node with at most so many members outside its commonest component compares them with all its members,
#: which costs less than branching all of them once more.
SMALL = 128
FILTER_WORDS = 1 << 21
CACHED = 100_000
MASK = (1 << 64) - 1
#: The lowest bits of a node are its tree.
TREE = np.uint64(0xFF)
BITS = [f"bits{k}" for k in range(SKETCH // 64)]
CARRIED = ["node", "doc_id", "n_shingles", "n_shared", *BITS]
ROOTS = ", ".join(f"{c} long" for c in CARRIED)
MEMBERS = f"{ROOTS}, stretch binary"
HELD = "shingle long, short_key long"
SIGNED = f"set_key binary, sketch binary, signature binary, {', '.join(f'{c} long' for c in BITS)}"


class Shingles:
    """Hashed shingle sets of texts; words are cached within a bound."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's word shingles; ASCII letters lower-cased."""
        split = (text or "").encode().lower().split()
        if not split:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            hashes = [known[w] for w in split]
        except KeyError:
            if len(known) > CACHED:
                known.clear()
            for w in split:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = [known[w] for w in split]
        h = np.array(hashes, np.uint64)
        n = min(self.words, len(h))
        mixed = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k]
            mixed ^= mixed >> np.uint64(29)
        return np.unique(_mixed(mixed))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def trees_for(percent: int, recall: float = RECALL) -> int:
    """Trees until a pair of this similarity meets at every level of one of them with this chance.

    A pair meets below a node by its one or two places there, each with the chance of its similarity.
    """
    similarity, meets = percent / 100, 1.0
    for _ in range(DEPTH + 1):
        one = similarity * meets
        meets = (1 - SECOND) * one + SECOND * (1 - (1 - one) ** 2)
    trees = 1 if meets >= 1 else max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - meets))))
    if trees > int(TREE) + 1:
        raise ValueError(f"{trees} trees are needed for a recall of {recall} at {percent} percent; {int(TREE) + 1} are possible")
    return max(trees, -(-SKETCH // PLACES))


class Signatures:
    """Minwise tokens of 16 bits: ``PLACES`` for each tree, none shared."""

    def __init__(self, trees: int):
        seeds = np.random.default_rng(20_24).integers(0, 1 << 63, (2, trees * PLACES)).astype(np.uint64)
        self.xor, self.odd = seeds[0], seeds[1] * np.uint64(2) + np.uint64(1)

    def __call__(self, found: np.ndarray) -> bytes:
        least = np.full(len(self.xor), MASK, np.uint64)
        for at in range(0, len(found), 512):
            np.minimum(least, ((found[at:at + 512, None] ^ self.xor) * self.odd).min(axis=0), out=least)
        return (least >> np.uint64(24)).astype("<u2").tobytes()


def _key(found: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def _short(key: bytes | None) -> int | None:
    return key and int.from_bytes(key[:8], "little", signed=True)


def _drawn(found: np.ndarray) -> np.ndarray:
    return found[found % np.uint64(DRAWN) == 0]


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """Set size, set key, the key's first half and the drawn shingles of every whole text; null keys where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in slices(batches):
            found = [shingles(text) for text in batch.column(1).to_pylist()]
            keys = [_key(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(map(_short, keys), pa.int64()), pa.array([_drawn(f).tobytes() for f in found], pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "short_key", "drawn"])

    return _narrow(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, short_key long, drawn binary")


def own_shingles(docs: DataFrame, words: int) -> DataFrame:
    """(short_key, n_own): of each set the number of shingles that no other set holds, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in slices(batches, 64):
            found = [shingles(t) for t in batch.column(1).to_pylist()]
            yield _held(found, [_short(_key(f)) for f in found])

    return _counted_own(_narrow(docs).where("doc_id IS NOT NULL").mapInArrow(run, HELD))


def own_drawn(sets: DataFrame) -> DataFrame:
    """(short_key, n_own) of the drawn shingles of ``shingle_sets``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield _held([np.frombuffer(d, np.uint64) for d in batch.column(1).to_pylist()], batch.column(0).to_pylist())

    return _counted_own(sets.where("set_key IS NOT NULL").select("short_key", "drawn").mapInArrow(run, HELD))


def _held(found: list[np.ndarray], keys: list[int | None]) -> pa.RecordBatch:
    full = [(f, k) for f, k in zip(found, keys, strict=True) if len(f)]
    columns = (np.concatenate([f for f, _ in full]).view(np.int64), np.repeat(np.array([k for _, k in full], np.int64), [len(f) for f, _ in full])) if full else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shingle", "short_key"])


def _counted_own(held: DataFrame) -> DataFrame:
    alone = held.groupBy("shingle").agg(F.min("short_key").alias("short_key"), F.max("short_key").alias("most")).where("short_key = most")
    return alone.groupBy("short_key").agg(F.count("*").alias("n_own"))


def signed(docs: DataFrame, classes: DataFrame, words: int, trees: int) -> DataFrame:
    """``classes`` (set_key, doc_id and more) with sketch, signature and the sketch's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, signature = Shingles(words), Signatures(trees)
        for batch in slices(batches):
            found = [f for f in map(shingles, batch.column(1).to_pylist()) if len(f)]
            if found:
                signatures = [signature(f) for f in found]
                sketches = [s[:2 * SKETCH] for s in signatures]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.binary()) for c in ([_key(f) for f in found], sketches, signatures)), *(pa.array(b) for b in _bits(sketches).T)],
                    names=["set_key", "sketch", "signature", *BITS])

    found = _with_ids_of(_narrow(docs), classes.select(F.col("doc_id").alias("id"))).mapInArrow(run, SIGNED)
    once = found.groupBy("set_key").agg(*(F.min(c).alias(c) for c in ("sketch", "signature", *BITS)))
    return classes.join(once, "set_key")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _chosen(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two places of each node in its tree's stretch, and whether the second is taken."""
    draw, base = _mixed(nodes), (nodes & TREE).astype(np.int64) * PLACES
    first = (draw % np.uint64(PLACES)).astype(np.int64)
    second = (first + 1 + ((draw >> np.uint64(16)) % np.uint64(PLACES - 1)).astype(np.int64)) % PLACES
    return base + first, base + second, (draw >> np.uint64(40)) % np.uint64(1 << 20) < np.uint64(SECOND * (1 << 20))


def _children(nodes: np.ndarray, signatures: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``nodes`` and node of every child; ``signatures`` are whole or the nodes' own trees' stretches."""
    first, second, taken = _chosen(nodes)
    at = np.concatenate([np.arange(len(nodes)), np.flatnonzero(taken)])
    place = np.concatenate([first, second[taken]])
    token = signatures[rows[at], place % signatures.shape[1]].astype(np.uint64) | (place.astype(np.uint64) << np.uint64(32))
    return at, _mixed(_mixed(nodes[at]) + token) & ~TREE | nodes[at] & TREE


def _bits(sketches: list[bytes]) -> np.ndarray:
    """The lowest bit of each place of sketches, 64 to a number."""
    places = np.frombuffer(b"".join(sketches), "<u2").reshape(-1, SKETCH)
    return np.ascontiguousarray(np.packbits((places & 1).astype(bool), axis=1)).view("<i8")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def _roots(trees: int) -> np.ndarray:
    return _mixed(np.arange(1, trees + 1, dtype=np.uint64)) & ~TREE | np.arange(trees, dtype=np.uint64)


def branch_roots(classes: DataFrame, trees: int) -> DataFrame:
    """``CARRIED`` for every class and tree: the children of the roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = _roots(trees)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.repeat(np.arange(batch.num_rows), trees)
            at, nodes = _children(np.tile(roots, batch.num_rows), _matrix(batch.column(len(CARRIED) - 1)), rows)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), *(batch.column(k).take(pa.array(rows[at])) for k in range(len(CARRIED) - 1))],
                                             names=CARRIED)

    return classes.select(*CARRIED[1:], "signature").mapInArrow(run, ROOTS)


def with_stretches(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members (``CARRIED``) with the stretch of the signature that their own tree reads, for all further levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) & TREE).astype(int).tolist()
            own = [s[2 * PLACES * t:2 * PLACES * (t + 1)] for t, s in zip(tree, batch.column(len(CARRIED)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.binary())], names=[*CARRIED, "stretch"])

    joined = members.select(*CARRIED).join(classes.select("doc_id", "signature"), "doc_id")
    return joined.select(*CARRIED, "signature").mapInArrow(run, MEMBERS)


def branch(members: DataFrame) -> DataFrame:
    """The next level: children of nodes for each of their members (``CARRIED`` and stretch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, children = _children(nodes, _matrix(batch.column(len(CARRIED))), np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(children.view(np.int64)), *(batch.column(k).take(pa.array(at)) for k in range(1, len(CARRIED) + 1))],
                                             names=[*CARRIED, "stretch"])

    return members.select(*CARRIED, "stretch").mapInArrow(run, MEMBERS)


def _alike(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches do not speak clearly against a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                share = (_matrix(batch.column(2)) == _matrix(batch.column(3))).mean(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(share >= percent / 100 - SLACK))

    sign = classes.select("doc_id", "sketch")
    joined = pairs.join(sign.toDF("a", "sign_a"), "a").join(sign.toDF("b", "sign_b"), "b")
    return joined.select("a", "b", "sign_a", "sign_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Only texts that occur in a pair are read again; of rows that share an id all texts are compared.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())],
                names=["doc_id", "found"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    full = _with_ids_of(_narrow(docs), ids).mapInArrow(sets, "doc_id long, found binary")
    joined = pairs.join(full.toDF("a", "found_a"), "a").join(full.toDF("b", "found_b"), "b")
    return joined.select("a", "b", "found_a", "found_b").mapInArrow(check, "a long, b long")


def _with_ids_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose id may occur in ``ids`` (id): a bit for each hashed id, so that texts need no shuffle.

    The table of bits has at most ``FILTER_WORDS`` rows whatever the input, which bounds its broadcast.
    Other ids that share a bit pass as well.
    """
    def hashed(name: str) -> tuple[Column, Column]:
        return (F.expr(f"pmod(shiftright(xxhash64({name}), 6), {FILTER_WORDS}) AS word"),
                F.expr(f"shiftleft(1L, CAST(pmod(xxhash64({name}), 64) AS INT)) AS bit"))

    bits = ids.select(*hashed("id")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    word, bit = hashed("doc_id")
    marked = docs.where("doc_id IS NOT NULL").select("*", word, bit).join(F.broadcast(bits), "word")
    return marked.where("bits & bit <> 0").select("doc_id", "text")


def _labelled(members: DataFrame, components: DataFrame) -> DataFrame:
    """Members with their component, in nodes that still hold more than one."""
    named = members.join(components.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        *members.columns, F.coalesce("component", "doc_id").alias("component")).repartition("node")
    counted = named.groupBy("node", "component").agg(F.count("*").alias("n"))
    mixed = counted.groupBy("node").agg(
        F.sum("n").alias("size"), F.count("*").alias("kinds"), F.max(F.struct("n", "component")).alias("common"))
    mixed = mixed.where("kinds > 1").selectExpr("node", f"size - common.n <= {SMALL} AS small", "common.component AS common")
    return named.join(mixed, "node")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = RECALL) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id and kept.

    Texts without words have an empty set and link with nothing; a null text is one of them.  Rows
    that share an id are one node of the link graph.  A row without an id links with nothing, has no
    component and is kept.  Other columns are not read.  ``recall`` is what the trees are counted for.
    """
    trees = trees_for(percent, recall)
    sets = written(shingle_sets(docs, words), "sets")
    usable = sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    all_classes = written(usable.groupBy("set_key").agg(
        *(F.min(c).alias(c) for c in ("doc_id", "n_shingles", "short_key")), F.min(F.expr("length(drawn) div 8")).alias("n_drawn")), "classes")
    counted = all_classes.join(own_drawn(sets), "short_key", "left")
    most, spread = (100 - percent) / 100, SURE * (percent * (100 - percent)) ** 0.5 / 100
    likely = written(counted.where(f"coalesce(n_own, 0) <= {most}D * n_drawn + {spread}D * sqrt(n_drawn)").drop("n_own", "n_drawn"), "likely")
    read = _with_ids_of(_narrow(docs), likely.select(F.col("doc_id").alias("id")))
    counted = likely.join(own_shingles(read, words), "short_key", "left").withColumn("n_shared", F.expr("n_shingles - coalesce(n_own, 0)"))
    linkable = written(counted.where(f"100 * n_shared >= {percent} * n_shingles").drop("short_key", "n_own"), "linkable")
    first = written(signed(docs, linkable, words, trees), "classes")

    roots = branch_roots(first, trees).repartition("node")
    nodes = roots.groupBy("node").agg(F.count("*").alias("size"), F.min(F.struct(*CARRIED[1:])).alias("leader")).where("size > 1")
    members = written(roots.join(nodes, "node"), "members")
    stars = members.where("doc_id <> leader.doc_id").where(_near("", "leader.", percent)).select(
        F.col("leader.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
    alike = written(_alike(stars, first, percent), "pairs")
    links = written(confirmed(alike, docs, words, percent), "links")
    discard(alike)
    components = written(connected_components(links), "components")

    open_nodes = written(_labelled(members.select(*CARRIED), components), "open")
    discard(members)
    large, found = written(with_stretches(open_nodes.where("NOT small"), first), "members"), []
    for level in range(DEPTH + 1):
        if open_nodes.isEmpty():
            break
        last = level == DEPTH
        found.append(written(_across(open_nodes if last else open_nodes.where("small"), percent).distinct(), "pairs"))
        discard(open_nodes)
        if last:
            break
        grown = written(branch(large), "members")
        discard(large)
        open_nodes = written(_labelled(grown, components), "open")
        discard(grown)
        large = written(open_nodes.where("NOT small").select(*CARRIED, "stretch"), "members")
    if found:
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.union(more)
        alike = written(_alike(pairs.distinct(), first, percent), "pairs")
        second = written(confirmed(alike, docs, words, percent), "links")
        components = written(connected_components(links.union(second)), "components")
        for table in (*found, alike):
            discard(table)

    classes = all_classes.select("set_key", F.col("doc_id").alias("first_id"))
    placed = (sets.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
              .join(components.withColumnRenamed("node", "first_id"), "first_id", "left"))
    smallest = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first_id", "doc_id"))
    return placed.select("doc_id", "n_shingles", smallest.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _near(one: str, other: str, percent: int) -> str:
    """Whether sets with these sizes and bits (columns behind the prefixes ``one`` and ``other``) can be as alike.

    They share no more than either shares with any set at all.  Bits of a place agree where the sets' tokens do, and else by half.
    """
    differ = (1 - percent / 100) / 2
    most = int(SKETCH * differ + DEVIATIONS * (SKETCH * differ * (1 - differ)) ** 0.5)
    apart = " + ".join(f"bit_count({one}{c} ^ {other}{c})" for c in BITS)
    both = f"least({one}n_shared, {other}n_shared)"
    return (f"100 * {both} >= {percent} * ({one}n_shingles + {other}n_shingles - {both}) AND "
            f"{apart} <= {most}")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one node whose components differ and whose sets are near enough in size and bits.

    One side leaves out the node's commonest component, so a node that is one large component and a
    few others costs its size times the others.
    """
    side = members.select("node", F.struct("doc_id", "component", *CARRIED[2:]).alias("x"), "common")
    left, right = side.withColumnRenamed("x", "a"), side.where("x.component <> common").select("node", F.col("x").alias("b"))
    met = left.join(right, "node").where(
        f"a.component <> b.component AND (a.component = common OR a.component < b.component) AND {_near('a.', 'b.', percent)}")
    return met.select(F.least("a.doc_id", "b.doc_id").alias("a"), F.greatest("a.doc_id", "b.doc_id").alias("b"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that are not the smallest id of their near-duplicate group.

    Rows without an id stay.  Of rows that repeat a kept id all stay, as they share it.  Further columns
    may have any names.
    """
    gone = free_name(docs, "gone_id")
    judged = near_duplicates(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(judged, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
