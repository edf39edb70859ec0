"""SimHash near-duplicates with vantage-point trees.

Fingerprints are 64 majority bits over word shingles.  Equal fingerprints are
one point.  Points are dealt to shards such that every pair within ``radius``
differing bits meets in one: of a number of bit blocks all but ``radius`` agree,
and a shard is a choice of that many blocks with their bits.  The blocks follow
from the number of points, so that a shard holds about ``SHARD`` of them at any
size.  (A ball around a vantage point alone cannot deal random 64-bit points: the
distances crowd at 32 and the boundary shell of width ``radius`` would take most
points.)  In a shard, points are partitioned by Hamming distance to vantage
points; queries go down both sides only where the triangle bound allows it, so
points in the overlap of a boundary are compared on both sides and no pair is
lost.  The bound works the other way too: a point so near a vantage point that
all of its side must lie within ``radius`` is linked with that side at once, so a
dense group costs no comparison per pair.  A shard emits a star per local
component, never all pairs of a group.

Components come from alternating large-star and small-star steps in Spark, each
written to the shared folder; no link, component or fingerprint reaches the
driver.

Null or empty text has fingerprint zero and is linked like any other.  Rows
with null ``doc_id`` take part but do not name a component unless nothing else
can; repeated rows fall in one component, as do rows of any ids with equal texts.
An empty table gives an empty one.  Very long texts are read whole, a batch of
shingles at a time.  Only the id and the text are read, so other columns of any
name do not matter; ``deduplicate`` keeps them.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialize, shuffle_partitions, text_or_empty

SEED = 42
#: Points that a shard holds on average, and points that a leaf of its tree holds at most.
SHARD, LEAF = 2048, 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, k: int) -> int:
    """Majority bits of XXH64 over the k-word shingles of an ASCII-lower-cased text."""
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    buf = b" ".join(words)
    if len(words) <= k:
        return int.from_bytes(digest(buf, SEED), "big")
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    end = np.cumsum(size) - 1
    start = end - size + 1
    made = b"".join([digest(buf[s:e], SEED) for s, e in zip(start[: len(words) - k + 1].tolist(), end[k - 1:].tolist())])
    octets = np.frombuffer(made, dtype=np.uint8).reshape(-1, 8)
    seen = np.bincount((octets + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    return int.from_bytes(np.packbits((seen @ _BITS).ravel() * 2 > len(octets)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], k: int = 4, text_col: str = "text") -> DataFrame:
    """``keep`` and ``fp``, the fingerprint as a signed long."""
    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", fp long"

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_buffer().to_pybytes(), k) for t in b.column(len(keep))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, text_or_empty(text_col).cast("binary").alias("_text")).mapInArrow(run, schema)


def shard_masks(radius: int, points: int) -> list[int]:
    """Bit masks of the block choices that a pair within ``radius`` must share one of, for so many points."""
    need = max(0, int(np.ceil(np.log2(max(1, points / SHARD)))))
    if not need:
        return [0]
    for blocks in range(radius + 1, 65):
        width = -(-need // (blocks - radius))
        if blocks * width <= 64:
            break
    masks = [((1 << width) - 1) << i * width for i in range(blocks)]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Forest:
    """Union-find labels over the points of one shard."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray):
        la, lb = self.label[a], self.label[b]
        new = la != lb
        if not new.any():
            return
        root: dict[int, int] = {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for x, y in np.unique(np.stack([la[new], lb[new]], 1), axis=0).tolist():
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        table = np.arange(len(self.label))
        for x in list(root):
            table[x] = find(x)
        self.label = table[self.label]


class Tree:
    """A vantage-point tree over points given by number."""

    def __init__(self, points: np.ndarray, own: np.ndarray, radius: int):
        self.own, self.points, self.radius = own, points, radius
        self.vantage, d = points[own[0]], distance(points[own], points[own[0]]).astype(np.int64)
        self.reach = int(d.max())
        self.sides = ()
        if len(own) <= LEAF or self.reach <= radius:
            return
        self.cut = int(np.median(d))
        if self.cut == self.reach:
            self.cut -= 1
        inside = d <= self.cut
        self.sides = Tree(points, own[inside], radius), Tree(points, own[~inside], radius)

    def nodes(self) -> int:
        """Vantage points that part the tree's points."""
        return sum(1 + side.nodes() for side in self.sides[:1]) + sum(side.nodes() for side in self.sides[1:])

    def query(self, asking: np.ndarray, forest: Forest):
        """Links every asking point with the tree's points within the radius."""
        label = forest.label[self.own]
        if (label == label[0]).all():  # what is linked with all of the side already need not ask
            asking = asking[forest.label[asking] != label[0]]
        if not len(asking):
            return
        d = distance(self.points[asking], self.vantage).astype(np.int64)
        if self.reach <= self.radius:  # the side hangs together, and so does what is near enough to reach over it
            forest.link(self.own, np.full(len(self.own), self.own[0]))
            over = d + self.reach <= self.radius
            forest.link(asking[over], np.full(int(over.sum()), self.own[0]))
            asking, d = asking[~over], d[~over]
        if self.sides:
            inside, outside = self.sides
            inside.query(asking[d - self.radius <= self.cut], forest)
            outside.query(asking[d + self.radius > self.cut], forest)
            return
        asking = asking[d - self.radius <= self.reach]
        for at in range(0, len(self.own), 256):
            some = self.own[at:at + 256]
            for k in range(0, len(asking), 4096):
                a, b = np.nonzero(distance(self.points[asking[k:k + 4096], None], self.points[None, some]) <= self.radius)
                forest.link(asking[k:k + 4096][a], some[b])


def shard_links(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A star (point, smallest number linked) per component of one shard's distinct points."""
    everything = np.arange(len(points))
    forest = Forest(len(points))
    Tree(points, everything, radius).query(everything, forest)
    other = np.flatnonzero(forest.label != everything)
    return points[other], points[forest.label[other]]


def whole_shards(batches, wanted: list[str]):
    """Tables of the ``wanted`` columns that hold whole shards; rows come in order of their key, the first of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        b = b.select(wanted)
        if not b.num_rows:
            continue
        keys = b.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        cut = int(np.searchsorted(keys, keys[-1]))  # the last shard may go on
        if cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _spans(keys: np.ndarray, least: int):
    """Start and size of the runs of at least so many equal keys."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.r_[start, len(keys)])
    return list(zip(start[size >= least].tolist(), size[size >= least].tolist()))


def _edges(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(points: DataFrame, radius: int = 4) -> DataFrame:
    """Edges (a, b) that connect all distinct ``fp`` within ``radius`` of one another."""
    masks = shard_masks(radius, points.count())
    shards = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)])
    dealt = points.select("fp", F.explode(shards).alias("key")).repartition(shuffle_partitions(points.sparkSession), "key").sortWithinPartitions("key")

    def run(batches):
        for t in whole_shards(batches, ["key", "fp"]):
            fps, found = t.column(1).to_numpy().view(np.uint64), [np.empty((2, 0), np.uint64)]
            for s, m in _spans(t.column(0).to_numpy(), 2):
                found.append(np.stack(shard_links(np.unique(fps[s:s + m]), radius)))
            yield _edges(*np.concatenate(found, axis=1).view(np.int64))

    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node with an edge.

    Alternating large-star and small-star: rounds grow with the logarithm of the
    longest chain.  A round's edges are written to the shared folder."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = materialize(small, "cc-edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def classes(rows: DataFrame, radius: int = 4, id_col: str = "doc_id") -> DataFrame:
    """(fp, component_id) for the distinct fingerprints of ``rows`` (id, fp):
    component_id is the smallest id whose fingerprint is reachable."""
    points = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("_first")), "simhash-points")
    roots = components(links(points, radius))
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "_first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    return rooted.join(named, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id") -> DataFrame:
    """One row per document row: id, fp, component_id."""
    rows = materialize(fingerprints(docs, [id_col], k), "simhash-fp")
    return rows.join(classes(rows, radius, id_col), "fp").select(id_col, "fp", "component_id")


# --- near duplicates by similarity -------------------------------------------
#
# A link at a Jaccard similarity of 0.8 differs in about 15 % of the bits, which
# is far outside the radius that 64 bits can be searched at exactly.  So the
# similarity form takes WIDE words of 64 bits.  Samples of the bits deal the points
# to shards; how many bits and samples follows from the number of points, so that
# shards stay small and a pair of the similarity misses all of them with
# probability MISS.  In a shard the first words nominate pairs: two rounds name
# one partner a point and shard, which links most groups, and of what they leave
# open all pairs are looked at, by signatures of LONG words (``open_pairs``).  What
# these do not reject is compared group by group (``block_links``), not row by row.
# So every pair that meets in a shard is linked, rejected or implied.
#
# Only the shingle sets of a pair accept it.  Bits reject a pair where they differ
# by DEVIATIONS standard deviations more than pairs of the similarity do; first
# the wide fingerprint's, then those of the long signature, which is made for the
# points of nominated or open pairs only.  Majority bits
# of few shingles are too coarse for the angle: texts under SMALL shingles are
# compared exactly, by a prefix of their sorted shingle sets.

WIDE, LONG, NEAR = 8, 64, 3
DEVIATIONS, MISS = 5, 0.001
#: Points of a shard that meet by chance; the fewest bits of a sample where first words and where long signatures are compared; the most.
CHANCE, FEWEST, FEWEST_LONG, MOST = 256, 10, 6, 40
#: Hash slots a wanted row by which others are passed over before a join, and the most slots; 64 of them are a row of the broadcast.
SPREAD, SLOTS = 16, 1 << 26
#: Share of the samples that the first round takes: what it has linked need not be nominated again.
FIRST = 0.25
#: Texts of fewer shingles are compared by their shingle sets.
SMALL = 16
#: Points, and bytes of their shingle sets, of a block of an open group; a task compares two blocks.
BLOCK, BLOCK_BYTES = 2048, 1 << 25


def differing(similarity: float) -> float:
    """The share of bits that differ: equal-sized sets of Jaccard similarity s have cosine
    2s / (1 + s), and a bit differs with probability angle / pi."""
    return float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)


def most_bits(similarity: float, words: int) -> int:
    """Bits of so many words that a pair of the similarity may differ in."""
    p, n = differing(similarity), 64 * words
    return int(np.ceil(n * p + DEVIATIONS * np.sqrt(n * p * (1 - p))))


def sampling(points: int, similarity: float, fewest: int = FEWEST) -> tuple[int, int]:
    """Bits of a sample, and samples, for so many points."""
    bits = int(np.clip(np.ceil(np.log2(max(1.0, points / CHANCE))), fewest, MOST))
    return bits, int(np.ceil(np.log(MISS) / np.log1p(-((1 - differing(similarity)) ** bits))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_digests(text: bytes, k: int) -> np.ndarray:
    """128 bits for each of the set of k-word shingles, in no order."""
    words = text.lower().split()
    digest = xxhash.xxh3_128_digest
    if not words:
        return np.empty((0, 2), dtype=np.uint64)
    buf = b" ".join(words)
    if len(words) <= k:
        made = digest(buf, SEED)
    else:
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        end = np.cumsum(size) - 1
        start = end - size + 1
        made = b"".join({digest(buf[s:e], SEED) for s, e in zip(start[: len(words) - k + 1].tolist(), end[k - 1:].tolist())})
    return np.frombuffer(made, dtype=np.uint64).reshape(-1, 2)


def signature(pair: np.ndarray, words: int) -> np.ndarray:
    """Words of majority bits over a set of shingle digests; the first ones are those of any shorter signature."""
    seen = np.zeros(words * 8 * 256, dtype=np.int64)
    place = np.arange(words * 8) * 256
    with np.errstate(over="ignore"):
        for at in range(0, len(pair), 4096):
            some = pair[at:at + 4096]
            octets = _mix(some[:, :1] + some[:, 1:] * np.arange(1, words + 1, dtype=np.uint64)).view(np.uint8).reshape(len(some), -1)
            seen += np.bincount((octets + place).ravel(), minlength=len(seen))
    ones = seen.reshape(-1, 256) @ _BITS
    return np.packbits(ones.ravel() * 2 > len(pair)).view(np.uint64)


@lru_cache(4)
def _samples(bits: int, tables: int) -> np.ndarray:
    return np.stack([np.random.default_rng(j).choice(WIDE * 64, bits, replace=False) for j in range(tables)])


def sampled_keys(fps: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """A row of keys for every wide fingerprint: the sample's bits and its number.  The samples are fixed."""
    ones = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1)
    places, power = _samples(bits, tables), 1 << np.arange(bits, dtype=np.int64)
    out = np.empty((len(fps), tables), dtype=np.int64)
    for at in range(0, len(fps), 512):
        out[at:at + 512] = ones[at:at + 512][:, places] @ power
    return out | np.arange(tables, dtype=np.int64) << 44


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of points of several words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def nominated(keys: np.ndarray, nodes: np.ndarray, points: np.ndarray, labels: np.ndarray, most: int):
    """At most one partner for every point of a shard: the first vantage point within ``most`` bits.
    Equal keys stand together.  Dense groups have few vantage points, and the work is
    a distance per point and vantage point, never a pair per two members.  Points of
    one label are linked already, and their pair would change nothing.

    Third comes what this leaves open: the points with a near one of another label
    that they are not paired with."""
    out_a, out_b, left = [nodes[:0]], [nodes[:0]], [nodes[:0]]
    for s, m in _spans(keys, 2):
        order = np.argsort(nodes[s:s + m], kind="stable")
        own, at, of = (x[s:s + m][order] for x in (nodes, points, labels))
        if (of == of[0]).all():
            continue
        todo, number, everyone = near_others(at, of, most), np.arange(m), own
        busy = todo > 0  # the others are near to no point of another label
        own, at, of, number = own[busy], at[busy], of[busy], number[busy]
        while len(own) > 1:
            close = differ(at[1:], at[0]) <= most
            new = close & (of[1:] != of[0])
            out_a.append(own[1:][new])
            out_b.append(np.full(int(new.sum()), own[0]))
            todo[number[1:][new]] -= 1
            todo[number[0]] -= int(new.sum())
            own, at, of, number = own[1:][~close], at[1:][~close], of[1:][~close], number[1:][~close]
        left.append(everyone[todo > 0])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return a[a != b], b[a != b], np.unique(np.concatenate(left))


def _across(at: np.ndarray, of: np.ndarray, most: int):
    """Blocks (numbers, nearness to every point) of the near pairs of two labels.  Points of
    the most frequent label are never rows: each of their pairs has its other point as row."""
    kinds, which, count = np.unique(of, return_inverse=True, return_counts=True)
    big = which == np.argmax(count)
    rows = np.flatnonzero(~big)
    step = max(1, (1 << 21) // max(1, at.size))
    for k in range(0, len(rows), step):
        some = rows[k:k + step]
        yield some, (differ(at[some, None], at[None, :]) <= most) & (of[some, None] != of[None, :]), big


def near_others(at: np.ndarray, of: np.ndarray, most: int) -> np.ndarray:
    """For every point of a shard the number of near points of other labels."""
    out = np.zeros(len(at), dtype=np.int64)
    for some, near, big in _across(at, of, most):
        out[some] += near.sum(1)
        out[big] += near[:, big].sum(0)
    return out


def open_pairs(keys: np.ndarray, nodes: np.ndarray, labels: np.ndarray, points: np.ndarray, most: int) -> np.ndarray:
    """All pairs (larger, smaller node) of two labels in a shard that differ in at most ``most`` bits."""
    out = [np.empty((0, 2), np.int64)]
    for s, m in _spans(keys, 2):
        own, of, at = nodes[s:s + m], labels[s:s + m], points[s:s + m]
        for some, near, _ in _across(at, of, most):
            a, b = np.nonzero(near)
            a = some[a]
            out.append(np.stack([np.maximum(own[a], own[b]), np.minimum(own[a], own[b])], 1))
    return np.unique(np.concatenate(out), axis=0)


def stars(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star (node, smallest node) per component of the pairs."""
    nodes, place = np.unique(pairs, return_inverse=True)
    place, forest = place.reshape(-1, 2), Forest(len(nodes))
    for at in range(0, len(place), 4096):
        forest.link(place[at:at + 4096, 0], place[at:at + 4096, 1])
    other = np.flatnonzero(forest.label != np.arange(len(nodes)))
    return nodes[other], nodes[forest.label[other]]


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted hashes of the set of k-word shingles."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    made = {xxhash.xxh64_digest(b" ".join(words[i:i + k]), SEED) for i in range(max(1, len(words) - k + 1))}
    return np.sort(np.frombuffer(b"".join(made), dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0


def prefix_size(n: int, similarity: float) -> int:
    """Of two sets of the similarity, in one order, the first so many members of each share one."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def set_links(keys: np.ndarray, nodes: np.ndarray, sets: list[bytes], similarity: float):
    """A star per local component of the sets of each shard; equal keys stand together."""
    out_a, out_b = [nodes[:0]], [nodes[:0]]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.r_[start, len(keys)])
    for s, m in zip(start[size > 1].tolist(), size[size > 1].tolist()):
        own = nodes[s:s + m]
        n = np.array([len(x) // 8 for x in sets[s:s + m]])
        _, codes = np.unique(np.frombuffer(b"".join(sets[s:s + m]), dtype=np.uint64), return_inverse=True)
        held = np.zeros((m, int(codes.max()) + 1), dtype=bool) if m <= 64 else None
        owner = np.repeat(np.arange(m), n)
        if held is not None:
            held[owner, codes] = True
        else:  # members by code, for counts by lookup
            by = np.argsort(codes, kind="stable")
            edge = np.searchsorted(codes[by], np.arange(int(codes.max()) + 2))
        first = np.r_[0, np.cumsum(n)]
        forest = Forest(m)
        for i in range(m - 1):
            if held is not None:
                common = (held[i + 1:] & held[i]).sum(1)
            else:
                common = np.bincount(np.concatenate([owner[by[edge[c]:edge[c + 1]]] for c in codes[first[i]:first[i + 1]].tolist()]), minlength=m)[i + 1:]
            like = i + 1 + np.flatnonzero(common / (n[i] + n[i + 1:] - common) >= similarity)
            like = like[forest.label[like] != forest.label[i]]
            if len(like):
                forest.link(np.full(len(like), i), like)
        other = np.flatnonzero(forest.label != np.arange(m))
        out_a.append(own[other])
        out_b.append(own[forest.label[other]])
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return a[a != b], b[a != b]


def block_links(keys: np.ndarray, nodes: np.ndarray, labels: np.ndarray, sides: np.ndarray, alone: np.ndarray, points: np.ndarray, sets: list[np.ndarray], most: int, similarity: float):
    """Links (node, smallest node linked) of what the labels leave apart in each shard: every pair of two labels
    whose points differ in at most ``most`` bits is compared by its shingle sets, until it is linked.  In a shard
    of two sides only pairs across them are looked at, where ``alone`` all.  Equal keys stand together."""
    out_a, out_b = [nodes[:0]], [nodes[:0]]
    for s, m in _spans(keys, 2):
        order = s + np.argsort(nodes[s:s + m], kind="stable")
        own, of, at, side, every = (x[order] for x in (nodes, labels, points, sides, alone))
        held = [sets[i] for i in order]
        n, number = np.array([len(x) for x in held]), np.arange(m)
        _, first, which = np.unique(of, return_index=True, return_inverse=True)
        forest = Forest(m)
        forest.label = first[which]
        for some, near, big in _across(at, of, most):
            for i, row in zip(some.tolist(), near):
                ahead = row & (big | (number > i)) & (every | (side != side[i])) & (forest.label != forest.label[i])
                like = np.flatnonzero(ahead & (n >= similarity * n[i]) & (n[i] >= similarity * n) & (n > 0))
                if not len(like):
                    continue
                values, mine = np.concatenate([held[j] for j in like]), held[i]
                found = mine[np.minimum(np.searchsorted(mine, values), len(mine) - 1)] == values
                common = np.add.reduceat(found, np.r_[0, np.cumsum(n[like])[:-1]], dtype=np.int64)
                like = like[common / (n[i] + n[like] - common) >= similarity]
                forest.link(np.full(len(like), i), like)
        moved = first[forest.label[first] != first]
        out_a.append(own[moved])
        out_b.append(own[forest.label[moved]])
    return np.concatenate(out_a), np.concatenate(out_b)


def small_links(small: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect all of ``small`` (fp, shingles) of the similarity."""
    def heads(batches):
        for b in batches:
            sets = b.column(1).to_pylist()
            lead = [np.frombuffer(x, dtype=np.int64)[:prefix_size(len(x) // 8, similarity)] for x in sets]
            times = np.array([len(x) for x in lead], dtype=np.int64)
            at = pa.array(np.repeat(np.arange(len(sets)), times))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lead) if lead else np.empty(0, np.int64)), b.column(0).take(at), b.column(1).take(at)], names=["key", "fp", "shingles"])

    def run(batches):
        for t in whole_shards(batches, ["key", "fp", "shingles"]):
            yield _edges(*set_links(t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_pylist(), similarity))

    dealt = small.mapInArrow(heads, "key long, fp long, shingles binary").repartition(shuffle_partitions(small.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def text_key(text_col: str):
    """64 bits that stand for a text beside its id."""
    return F.xxhash64(text_or_empty(text_col))


def slotted(rows: DataFrame, wanted: DataFrame, *cols: str) -> DataFrame:
    """``rows`` and ``_taken``: false only where no row of ``wanted`` has the same ``cols``.

    So what a join would not meet need not move for it.  The taken hash slots are
    broadcast as a bitmap, of SLOTS / 64 rows at most and never more than ``wanted``
    has.  True says nothing: about one in SPREAD of the others shares a taken slot,
    more where SLOTS are too few."""
    slots = 1 << int(np.clip(np.ceil(np.log2(max(1, SPREAD * wanted.count()))), 10, np.log2(SLOTS)))
    slot = F.pmod(F.xxhash64(*cols), F.lit(slots))
    place = {"_word": F.shiftright(slot, 6), "_bit": F.pmod(slot, F.lit(64)).cast("int")}
    bits = wanted.select(*[c.alias(name) for name, c in place.items()]).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    marked = rows.withColumns(place).join(F.broadcast(bits), "_word", "left")
    return marked.withColumn("_taken", F.coalesce(F.getbit("_bits", F.col("_bit")) == 1, F.lit(False))).drop("_word", "_bit", "_bits")


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of the pairs, repeats included."""
    return pairs.select(F.col("a").alias("fp")).union(pairs.select("b"))


class _Search:
    """The state of one search: documents, points, and what is known of them."""

    def __init__(self, docs: DataFrame, points: DataFrame, k: int, similarity: float, id_col: str, text_col: str):
        self.docs, self.points, self.k, self.similarity, self.id_col, self.text_col = docs, points, k, similarity, id_col, text_col
        self.sampled = sampling(points.count(), similarity)
        self.names = [f"w{i}" for i in range(WIDE)]

    def described(self, nodes: DataFrame) -> DataFrame:
        """fp, shingles, size (bytes of them) and long (the long signature) of the nodes' texts, written.

        Few texts are wanted.  Those whose hash slot is free are passed over where they
        stand, so that the join moves little more than the wanted ones."""
        # a written table: broadcast only if its true size is under the session's threshold
        wanted = materialize(self.points.join(nodes.select("fp").distinct(), "fp", "left_semi").select("fp", F.coalesce("_first.id", "_first.key").alias("_id"), F.col("_first.key").alias("_key")), "simhash-wanted")
        k = self.k

        def run(batches):
            for b in batches:
                texts = [t.as_buffer().to_pybytes() for t in b.column(1)]
                longs = [signature(shingle_digests(t, k), LONG).tobytes() for t in texts]
                sets = [shingle_set(t, k).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(longs, pa.binary())], names=["fp", "shingles", "size", "long"])

        key = text_key(self.text_col)
        keyed = self.docs.select(text_or_empty(self.text_col).cast("binary").alias("_text"), F.coalesce(F.col(self.id_col).cast("long"), key).alias("_id"), key.alias("_key"))
        one = slotted(keyed, wanted, "_id", "_key").where("_taken").join(wanted, ["_id", "_key"]).select("fp", "_text").mapInArrow(run, "fp long, shingles binary, size long, long binary")
        made = materialize(one, "simhash-described")
        if made.groupBy("fp").count().where("count > 1").isEmpty():
            return made
        return materialize(made.dropDuplicates(["fp"]), "simhash-described")  # a document stood there in several rows

    def joined(self, pairs: DataFrame, described: DataFrame, column: str) -> DataFrame:
        """The pairs, a written table, with the column of a as x and of b as y."""
        some = slotted(described.select("fp", column), _ends(pairs), "fp").where("_taken")
        side = lambda node, name: some.select(F.col("fp").alias(node), F.col(column).alias(name))
        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")

    def verified(self, pairs: DataFrame, described: DataFrame) -> DataFrame:
        """The pairs whose shingle sets really have the similarity."""
        most, similarity = most_bits(self.similarity, LONG), self.similarity
        load = lambda x: np.frombuffer(x.as_buffer(), dtype=np.uint64)

        def keep(test):
            def run(batches):
                for b in batches:
                    kept = [test(load(x), load(y)) for x, y in zip(b.column(2), b.column(3))]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

            return run

        pairs = materialize(self.joined(pairs, described, "long").mapInArrow(keep(lambda x, y: differ(x, y) <= most), "a long, b long"), "simhash-alike")
        return self.joined(pairs, described, "shingles").mapInArrow(keep(lambda x, y: jaccard(x, y) >= similarity), "a long, b long")

    def near_pairs(self, pairs: DataFrame) -> DataFrame:
        """The nominated pairs that neither the wide fingerprints nor the sizes of the sets reject."""
        points = slotted(self.points, _ends(pairs), "fp").where("_taken")
        side = lambda x, y: points.select(F.col("fp").alias(x), F.array(*self.names).alias(y), F.col("n").alias(f"{y}n"), F.col("most").alias(f"{y}m"))
        s = self.similarity
        sizes = (F.col("xm") >= s * F.col("yn") - 1e-6) & (F.col("ym") >= s * F.col("xn") - 1e-6)  # no set is similar to one so much larger
        bits = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
        return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(sizes & (bits <= most_bits(s, WIDE))).select("a", "b")

    def dealt(self, rows: DataFrame, bits: int, tables: int, keep: str, kinds: str) -> DataFrame:
        """``rows`` (columns of ``keep`` and the words) to the shards of so many samples: key and keep, in order of the key."""
        n = len(keep.split())

        def run(batches):
            for b in batches:
                fps = np.stack([b.column(n + i).to_numpy() for i in range(WIDE)], 1).view(np.uint64) if b.num_rows else np.empty((0, WIDE), np.uint64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fps) * tables + 1, tables, dtype=np.int32)), pa.array(sampled_keys(fps, bits, tables).ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], keys], names=[*keep.split(), "keys"])

        keyed = rows.select(*keep.split(), *[F.col(w).alias(f"_{w}") for w in self.names]).mapInArrow(run, f"{kinds}, keys array<long>")
        return keyed.select(F.explode("keys").alias("key"), *keep.split()).repartition(shuffle_partitions(self.docs.sparkSession), "key").sortWithinPartitions("key")

    def nominate(self, rooted: DataFrame, tables: int) -> DataFrame:
        """Pairs of nodes; a node with itself where pairs are left open."""
        most, near = most_bits(self.similarity, NEAR), self.names[:NEAR]

        def run(batches):
            for t in whole_shards(batches, ["key", "fp", "root", *near]):
                keys, nodes, labels = (t.column(i).to_numpy() for i in range(3))
                a, b, left = nominated(keys, nodes, np.stack([t.column(w).to_numpy() for w in near], 1).view(np.uint64), labels, most)
                yield _edges(np.r_[a, left], np.r_[b, left])

        rows = self.dealt(rooted, self.sampled[0], tables, " ".join(["fp", "root", *near]), "fp long, root long, " + ", ".join(f"{w} long" for w in near))
        return materialize(rows.mapInArrow(run, "a long, b long").distinct(), "simhash-found")

    def left_open(self, remaining: DataFrame, described: DataFrame) -> DataFrame:
        """Links of the remaining points: all pairs that meet in a shard and that their long signatures do not
        reject are compared by their shingle sets.

        Such pairs grow with the square of a group, so none is a row.  A shard names the groups
        that hang together by them; a group comes to one task, or to one for any two of its blocks, and is
        compared there."""
        most, similarity = most_bits(self.similarity, LONG), self.similarity
        load = lambda column, n: np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, n)

        def shards(batches):
            for t in whole_shards(batches, ["key", "fp", "root", "long"]):
                yield _edges(*stars(open_pairs(*(t.column(i).to_numpy() for i in range(3)), load(t.column("long"), LONG), most)))

        def compare(batches):
            for t in whole_shards(batches, ["key", "fp", "root", "side", "alone", "long", "shingles"]):
                sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
                yield _edges(*block_links(*(t.column(i).to_numpy() for i in range(5)), load(t.column("long"), LONG), sets, most, similarity))

        bits, tables = sampling(remaining.count(), similarity, FEWEST_LONG)
        long = slotted(described.select("fp", "long"), remaining, "fp").where("_taken").select("fp", "long")
        rows = self.dealt(remaining.join(long, "fp"), bits, tables, "fp root long", "fp long, root long, long binary")
        groups = components(rows.mapInArrow(shards, "a long, b long").distinct())
        groups = groups.union(groups.select("root", "root").distinct()).toDF("fp", "group")
        members = materialize(remaining.select("fp", "root").join(groups, "fp").join(described.select("fp", "size"), "fp"), "simhash-open")
        parts = members.groupBy("group").agg(F.greatest(F.ceil(F.count("size") / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES), F.lit(1)).alias("_parts"))
        sided = members.join(parts, "group").withColumn("side", F.pmod(F.xxhash64("fp"), "_parts"))
        other = sided.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_other"))
        keyed = other.select(F.xxhash64("group", F.least("side", "_other"), F.greatest("side", "_other")).alias("key"), "fp", "root", "side", (F.col("side") == F.col("_other")).alias("alone"))
        texts = slotted(described.select("fp", "long", "shingles"), members, "fp").where("_taken")
        whole = keyed.join(texts, "fp").select("key", "fp", "root", "side", "alone", "long", "shingles")
        return whole.repartition(shuffle_partitions(self.docs.sparkSession), "key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long").distinct()

    def roots(self, linked: DataFrame) -> DataFrame:
        roots = components(linked)
        return self.points.join(roots, self.points["fp"] == roots["node"], "left").select("fp", "_first", *self.names, F.coalesce("root", "fp").alias("root"))


def similar(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: ``id_col``, ``text_key``, and component_id and component_key, the
    smallest id (null last) and text key reachable, where documents link whose sets of k-word
    shingles have the similarity.  Rows without words link with one another."""
    names = [f"w{i}" for i in range(WIDE)]
    most = int((SMALL - 1) / max(similarity, 0.1) + 1e-9)  # shingles of what a small text can be similar to

    def small_set(text, n):
        return shingle_set(text, k).tobytes() if 0 < n <= most else None

    def run(batches):
        for b in batches:
            texts = [t.as_buffer().to_pybytes() for t in b.column(2)]
            made = [shingle_digests(t, k) for t in texts]
            fps = np.array([signature(d, WIDE) for d in made], dtype=np.uint64).reshape(-1, WIDE).view(np.int64)
            sets = pa.array([small_set(t, len(d)) for t, d in zip(texts, made)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(fps[:, i].copy()) for i in range(WIDE)], pa.array([len(d) for d in made], pa.int32()), sets],
                names=["id", "key", *names, "n", "shingles"])

    schema = "id long, key long, " + ", ".join(f"{n} long" for n in names) + ", n int, shingles binary"
    read = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), text_or_empty(text_col).cast("binary").alias("_text"))
    rows = materialize(read.mapInArrow(run, schema).withColumn("fp", F.xxhash64(*names)), "simhash-wide")
    name = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    points = materialize(rows.groupBy("fp", *names).agg(F.min(name).alias("_first"), F.min("n").alias("n"), F.max("n").alias("most")), "simhash-points")
    search = _Search(docs, points, k, similarity, id_col, text_col)

    linked = materialize(small_links(rows.where("shingles is not null").select("fp", "shingles").distinct(), similarity), "simhash-linked")
    rooted, seen = points.select("fp", "_first", *names, F.col("fp").alias("root")), None
    known = None
    for tables in (max(1, int(search.sampled[1] * FIRST)), search.sampled[1]):
        found = search.nominate(rooted, tables)
        near = search.near_pairs(found.where("a <> b"))
        near = materialize(near if seen is None else near.join(seen, ["a", "b"], "left_anti"), "simhash-near")
        nodes = _ends(near)
        described = search.described(nodes if known is None else nodes.join(known, "fp", "left_anti"))
        known = described if known is None else known.unionByName(described)
        linked = materialize(linked.unionByName(search.verified(near, known)), "simhash-linked")
        rooted = search.roots(linked)
        seen = near if seen is None else seen.unionByName(near)

    # what the last round, over all samples, left open
    opened = found.where("a = b").select(F.col("a").alias("fp"))
    remaining = materialize(rooted.join(opened, "fp", "left_semi").select("fp", "root", *names), "simhash-left")
    described = known.unionByName(search.described(remaining.join(known, "fp", "left_anti")))
    rooted = search.roots(linked.unionByName(search.left_open(remaining, described)))
    named = rooted.groupBy("root").agg(F.min("_first").alias("_name"))
    found = rows.select("id", "key", "fp").join(rooted.join(named, "root").select("fp", "_name"), "fp")
    return found.select(F.col("id").alias(id_col), F.col("key").alias("text_key"), F.col("_name.id").alias("component_id"), F.col("_name.key").alias("component_key"))


def deduplicate(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, one of each group of near duplicates: that with the smallest id.

    Rows of equal id and text are one document and stay or go together.  Rows without an id
    go where their group has a document with one; else one row of the group's smallest text
    key stays."""
    found = materialize(similar(docs, k, similarity, id_col, text_col), "simhash-found")
    # written tables: broadcast only if their true size is under the session's threshold
    gone = materialize(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).cast("long").alias("_id"), F.col("text_key").alias("_key")).distinct(), "simhash-gone")
    names = [f"_d{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    keyed = plain.withColumns({"_id": F.col(own).cast("long"), "_key": text_key(text)})
    # most rows stay where they are: only those whose hash slot one that goes has taken move for the join
    marked = slotted(keyed.where(F.col("_id").isNotNull()), gone, "_id", "_key")
    kept = marked.where("not _taken").select(*names).unionByName(marked.where("_taken").join(gone, ["_id", "_key"], "left_anti").select(*names))
    named = materialize(found.where(f"`{id_col}` is null and component_id is null and text_key = component_key").select(F.col("text_key").alias("_key")).distinct(), "simhash-nameless")
    nameless = keyed.where(F.col("_id").isNull()).join(named, "_key", "left_semi").dropDuplicates(["_key"]).select(*names)
    return kept.unionByName(nameless).toDF(*docs.columns)
