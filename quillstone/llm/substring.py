"""Substring deduplication over a compacted de Bruijn graph of tokens.

Edges are k-mers of tokens (k = ``WINDOW``), nodes the (k - 1)-mers that they
lead from and to.  An edge is repeated when it starts in more than one document;
its source is the place where it starts in the smallest doc_id.  Over the graph
of the repeated edges a join on the node brings together the edges that enter
and leave it: a node with one of each is passed through, any other ends a path.
So the repeated edges of a document compact to pieces of nonbranching paths
(start, length, source place), cut where the source changes.  Each piece is
verified against the source's own words, by a join on the source's coordinates,
before its words go.

How it is kept small:

* documents are dealt into chunks by a hash, and everything that moves between
  chunks is keyed by chunk or by hash bucket, packed in binary blobs: a chunk
  sends each distinct edge or node once, so an edge that a third of all documents
  hold costs one entry a chunk, and no task ever gathers an edge's documents;
* only windows around repeated minimizers (of ``SPAN``-token mers) are candidate
  edges: equal windows have equal minimizers, so none is missed, and windows
  that occur once, nearly all, are never sent;
* the numbers of chunks and of buckets grow with the bytes, so that what one task
  holds does not.

Texts are shuffled once; the chunk stages reuse that exchange.  Hashes are
polynomial prefix sums over whole batches in numpy.  An edge is known by 96 bits
of two such sums.  Should two different windows share them (expected less than
once in a thousand corpora of 100 TB), the verification of a piece fails; that
is an error, never a silently incomplete result.

Null text has no words.  Words of a window in a document with a smaller doc_id
go; rows of equal doc_id count as one document (neither removes the other's
words); a null doc_id is larger than all others.  The result has one row per
input row; an empty table gives an empty one.  A very long text makes its chunk
longer.  Only the id and the text are read, so other columns of any name do not
matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import shuffle_partitions, text_or_empty

WINDOW, SPAN = 13, 7
#: Bytes of text of a chunk; above ``MANY_CHUNKS`` of them chunks grow to at most ``MOST_BYTES``.
CHUNK_BYTES, MOST_BYTES, MANY_CHUNKS = 6_000_000, 32_000_000, 50_000
#: Bytes of text whose entries one bucket holds.
BUCKET_BYTES = 32_000_000
NULL_ID = np.iinfo(np.int64).max
_U = np.uint64
_P, _Q, _R = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1, 0xC2B2AE3D27D4EB4F | 1
#: No, and several, edges at a side of a node.
NONE, SEVERAL = np.uint32(0), np.uint32(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i below at least n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        grow = lambda b: np.multiply.accumulate(np.r_[_U(1), np.full(size - 1, b, dtype=_U)])
        have = _powers[base] = (grow(_U(base)), grow(_U(pow(base, -1, 1 << 64))))
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer, so that every bit depends on all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Tokens:
    """Words of a chunk's texts: byte bounds, document numbers and hashes."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        words, docs, at = [], [], 0
        self.count = np.zeros(len(texts), dtype=np.int64)
        hashes = []
        group: list[int] = []
        size = 0
        for i, t in enumerate(texts):
            group.append(i)
            size += len(t) + 1
            if size > 1 << 20 or i + 1 == len(texts):
                h, n = self._hash([texts[j] for j in group])
                hashes.append(h)
                self.count[group] = n
                group, size = [], 0
        self.word = np.concatenate(hashes) if hashes else np.empty(0, _U)
        self.first = np.r_[0, np.cumsum(self.count)]
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        up, down = powers(_Q, len(self.word) + 1)
        self.prefix = np.r_[_U(0), np.cumsum(self.word * up[:len(self.word)])]
        self.down = down

    def mer(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k words from each position."""
        return mixed((self.prefix[at + k] - self.prefix[at]) * self.down[at])

    def checks(self, at: np.ndarray, k: int) -> np.ndarray:
        """32 bits of a second hash of the k words from each position."""
        up, down = powers(_R, len(self.word) + 1)
        prefix = np.r_[_U(0), np.cumsum(self.word * up[:len(self.word)])]
        return (mixed((prefix[at + k] - prefix[at]) * down[at]) >> _U(32)).astype(np.uint32)

    @staticmethod
    def _hash(texts: list[bytes]) -> tuple[np.ndarray, list[int]]:
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        gap = _SPACE[data]
        start = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
        end = np.flatnonzero(gap & np.r_[False, ~gap[:-1]])
        up, down = powers(_P, len(data))
        total = np.r_[_U(0), np.cumsum((data.astype(_U) + _U(1)) * up[:len(data)])]
        hashes = mixed((total[end] - total[start]) * down[start])
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        return hashes, np.diff(np.searchsorted(start, bounds)).tolist()

    def mers(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word sequences within one document, and their first words."""
        n = len(self.word) - k + 1
        if n <= 0:
            return np.empty(0, _U), np.empty(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return self.mer(at, k), at

    def digest(self, start: int, length: int) -> bytes:
        """Digest of the words from a position in one document, as they stand."""
        doc = int(self.doc[start])
        at = start - int(self.first[doc])
        return hashlib.blake2b(b" ".join(self.split(doc)[at:at + length]), digest_size=16).digest()

    def split(self, doc: int) -> list[bytes]:
        if getattr(self, "_at", None) != doc:
            self._at, self._words = doc, self.texts[doc].split()
        return self._words

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window: the hash of its smallest ``SPAN``-mer, and the window's first word."""
        small, at = self.mers(SPAN)
        n = len(self.word) - WINDOW + 1
        if n <= 0:
            return np.empty(0, _U), np.empty(0, np.int64)
        full = np.full(len(self.word), np.iinfo(np.uint64).max, dtype=_U)
        full[at] = small
        window = np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1:])
        least = full[:len(full) - (WINDOW - SPAN)].copy()
        for step in range(1, WINDOW - SPAN + 1):
            np.minimum(least, full[step:len(least) + step], out=least)
        return least[window], window


def chunk_of(docs: DataFrame, chunks: int, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    chunk = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(chunks)).cast("int")
    return docs.select(chunk.alias("chunk"), F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text"))


def _load(table: pa.Table) -> tuple[np.ndarray, Tokens]:
    """Ids (null as the largest) and tokens of a chunk, sorted by id and text."""
    ids, order = _order(table)
    return ids, Tokens([table["text"][i].as_py() for i in order])


def _order(table: pa.Table) -> tuple[np.ndarray, list[int]]:
    """The chunk's own order of its rows, the same in every stage: by id, then text."""
    ids = [NULL_ID if x is None else x for x in table["id"].to_pylist()]
    texts = table["text"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
    return np.array(ids, dtype=np.int64)[order], order


def _bounds(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the end."""
    n = len(sorted_values)
    return np.r_[np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]), n] if n else np.zeros(1, np.int64)


class Codec:
    """How a column of numbers stands in a blob: as it is, or as differences, in byte planes, compressed."""

    def __init__(self, kind, packed: bool = True, differences: bool = False):
        self.kind, self.packed, self.differences = np.dtype(kind), packed, differences

    def pack(self, values: np.ndarray) -> bytes:
        if self.kind == np.bool_:
            return len(values).to_bytes(4, "little") + np.packbits(values).tobytes()
        if not self.packed:
            return values.astype(self.kind).tobytes()
        if self.differences:
            values = np.diff(values.astype(self.kind), prepend=self.kind.type(0))
        planes = np.ascontiguousarray(values.astype(self.kind).view(np.uint8).reshape(-1, self.kind.itemsize).T)
        return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)

    def size(self, blob: memoryview) -> int:
        return int.from_bytes(blob[:4], "little") if self.packed or self.kind == np.bool_ else len(blob) // self.kind.itemsize

    def unpack(self, blob: memoryview) -> np.ndarray:
        if self.kind == np.bool_:
            return np.unpackbits(np.frombuffer(blob[4:], np.uint8), count=int.from_bytes(blob[:4], "little")).astype(bool)
        if not self.packed:
            return np.frombuffer(blob, self.kind)
        n = int.from_bytes(blob[:4], "little")
        planes = np.frombuffer(pa.decompress(pa.py_buffer(blob[4:]), n * self.kind.itemsize, "zstd"), np.uint8)
        values = np.ascontiguousarray(planes.reshape(self.kind.itemsize, n).T).view(self.kind).ravel()
        return np.cumsum(values, dtype=self.kind) if self.differences else values


#: By column: random bits as they are, sorted or slowly changing numbers as differences.
CODECS = {
    "low": Codec(np.uint32, differences=True), "hash": Codec(np.uint64, packed=False), "check": Codec(np.uint32, packed=False),
    "doc": Codec(np.int64, differences=True), "own": Codec(np.int32, differences=True), "home": Codec(np.int32, differences=True),
    "ahead": Codec(np.int32, differences=True), "many": Codec(np.bool_), "every": Codec(np.bool_),
    "enters": Codec(np.uint32, packed=False), "leaves": Codec(np.uint32, packed=False),
    "there": Codec(np.int32, differences=True), "length": Codec(np.int32), "digest": Codec("V16", packed=False),
    "times": Codec(np.int32), "places": Codec(np.int32, differences=True),
}


def _bounds(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the end."""
    n = len(sorted_values)
    return np.r_[np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]), n] if n else np.zeros(1, np.int64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes // _U((1 << 64) // buckets + 1)).astype(np.int64)


def _blobs(groups: np.ndarray, **columns: np.ndarray):
    """The columns cut by runs of equal group numbers: (group, blob...)."""
    cut = _bounds(groups)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(groups[a]), *[CODECS[name].pack(c[a:b]) for name, c in columns.items()]


def _by_row(row: np.ndarray, use: np.ndarray, **columns: np.ndarray):
    """The used entries of each row, which stand in row order: (row, blob...)."""
    at = np.flatnonzero(use)
    return _blobs(row[at], **{name: c[at] for name, c in columns.items()})


def short(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of a hash: enough to nominate candidates, as a clash only adds one."""
    return (hashes // _U((1 << 64) // buckets + 1)) << _U(32) | hashes & _U(0xFFFFFFFF)


def low(hashes: np.ndarray) -> np.ndarray:
    return (hashes & _U(0xFFFFFFFF)).astype(np.uint32)


def _read(table: pa.Table, *names: str) -> list[np.ndarray]:
    """All entries of the named columns of blobs; rows without a blob have none."""
    out = []
    for name in names:
        parts = [CODECS[name].unpack(memoryview(x.as_buffer())) for x in table[name] if x.is_valid]
        out.append(np.concatenate(parts) if parts else np.empty(0, CODECS[name].kind))
    return out


def _rows(table: pa.Table, name: str) -> np.ndarray:
    """The row of each entry."""
    return np.repeat(np.arange(len(table)), [CODECS[name].size(memoryview(x.as_buffer())) if x.is_valid else 0 for x in table[name]])


def _short(table: pa.Table) -> np.ndarray:
    """Sorted short hashes of rows of bucket and low bits."""
    parts = [CODECS["low"].unpack(memoryview(x.as_buffer())).astype(_U) | _U(b << 32) for b, x in zip(table["bucket"].to_pylist(), table["low"]) if x.is_valid]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, _U)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values stand among the sorted ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


_INT, _LONG, _BLOB, _TEXT = pa.int32(), pa.int64(), pa.binary(), pa.string()
_SENT = _schema(bucket=_INT, chunk=_INT, low=_BLOB, many=_BLOB)
_HOT = _schema(bucket=_INT, chunk=_INT, low=_BLOB)
_EDGES = _schema(bucket=_INT, chunk=_INT, hash=_BLOB, check=_BLOB, doc=_BLOB, own=_BLOB, many=_BLOB)
_SOURCES = _schema(chunk=_INT, own=_BLOB, home=_BLOB, ahead=_BLOB, every=_BLOB)
_NODES = _schema(bucket=_INT, chunk=_INT, low=_BLOB, enters=_BLOB, leaves=_BLOB)
_ASKED = _schema(home=_INT, chunk=_INT, there=_BLOB, length=_BLOB, digest=_BLOB, times=_BLOB, places=_BLOB)
_VERIFIED = _schema(chunk=_INT, length=_BLOB, times=_BLOB, places=_BLOB)
_DONE = _schema(id=_LONG, n_words=_LONG, n_removed=_LONG, n_segments=_LONG, kept=_TEXT, kept_sha256=_TEXT)


def _ddl(schema: pa.Schema) -> str:
    kinds = {_INT: "int", _LONG: "long", _BLOB: "binary", _TEXT: "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def send_minimizers(table: pa.Table, chunk: int, buckets: int) -> pa.Table:
    ids, tokens = _load(table)
    least, at = tokens.minimizers()
    ids = ids[tokens.doc[at]]
    order = np.lexsort((ids, least))
    least, ids = least[order], ids[order]
    cut = _bounds(least)
    first, last = cut[:-1], cut[1:] - 1
    least = least[first]
    order = np.argsort(short(least, buckets), kind="stable")
    first, last, least = first[order], last[order], least[order]
    return _table([(b, chunk, *x) for b, *x in _blobs(_bucket(least, buckets), low=low(least), many=ids[first] != ids[last])], _SENT)


def hot_minimizers(table: pa.Table) -> pa.Table:
    """Per chunk, which of its minimizers occur in more than one document (or chunk)."""
    (hashes, many), row = _read(table, "low", "many"), _rows(table, "low")
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = np.r_[False, h[1:] == h[:-1]] if len(h) else np.empty(0, bool)
    hot = np.empty(len(h), dtype=bool)
    hot[order] = same | np.r_[same[1:], False] if len(h) else same
    chunks, bucket = table["chunk"].to_numpy(), table["bucket"][0].as_py()
    return _table([(bucket, int(chunks[r]), x) for r, x in _by_row(row, hot | many, low=hashes)], _HOT)


def send_edges(table: pa.Table, hot: pa.Table, chunk: int, buckets: int) -> pa.Table:
    """A chunk's distinct edges around hot minimizers, each with its first place and
    document, and whether the chunk has it in a later one."""
    known = _short(hot)
    if not len(known):
        return _table([], _EDGES)
    ids, tokens = _load(table)
    least, at = tokens.minimizers()
    at = at[_among(short(least, buckets), known)]
    edges, check = tokens.mer(at, WINDOW), tokens.checks(at, WINDOW)
    order = np.lexsort((at, check, edges))  # places stand in order of doc_id
    edges, check, at = edges[order], check[order], at[order]
    doc = ids[tokens.doc[at]]
    new = np.r_[True, (edges[1:] != edges[:-1]) | (check[1:] != check[:-1])] if len(edges) else np.empty(0, bool)
    first = np.flatnonzero(new)
    many = doc[np.r_[first[1:], len(edges)] - 1] != doc[first] if len(first) else np.empty(0, bool)
    bucket = _bucket(edges[first], buckets)
    order = np.lexsort((at[first], bucket))
    first, many = first[order], many[order]
    return _table([(b, chunk, *x) for b, *x in _blobs(bucket[order], hash=edges[first], check=check[first], doc=doc[first], own=at[first], many=many)], _EDGES)


def edge_sources(table: pa.Table) -> pa.Table:
    """Per chunk, its repeated edges with their sources, and whether the source stands
    before every document of the chunk that has the edge (else before the later ones)."""
    table = table.sort_by("chunk")
    (hashes, check, doc, own, many), row = _read(table, "hash", "check", "doc", "own", "many"), _rows(table, "own")
    chunks = table["chunk"].to_numpy().astype(np.int32)
    if not len(hashes):
        return _table([], _SOURCES)
    order = np.lexsort((row, doc, check, hashes))
    new = np.r_[True, (hashes[order][1:] != hashes[order][:-1]) | (check[order][1:] != check[order][:-1])]
    group = np.cumsum(new) - 1
    source = np.empty(len(hashes), dtype=np.int64)
    source[order] = order[new][group]
    every = doc > doc[source]
    use = np.empty(len(hashes), dtype=bool)
    use[order] = np.logical_or.reduceat((every | many)[order], np.flatnonzero(new))[group]
    found = _by_row(row, use, own=own, home=chunks[row[source]], ahead=own[source] - own, every=every)
    return _table([(int(chunks[r]), *x) for r, *x in found], _SOURCES)


def _repeated(sources: pa.Table) -> tuple[np.ndarray, ...]:
    """A chunk's repeated edges: first place, chunk and place of the source, whether it stands before all."""
    own, home, ahead, every = _read(sources, "own", "home", "ahead", "every")
    return own, home, own + ahead, every


def _side(nodes: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes, and the edge at one side of each: its word, or ``SEVERAL``."""
    order = np.lexsort((words, nodes))
    nodes, words = nodes[order], words[order]
    cut = _bounds(nodes)
    first, last = cut[:-1], cut[1:] - 1
    return nodes[first], np.where(words[first] == words[last], words[first], SEVERAL)


def node_edges(tokens: Tokens, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of the edges at the places, with the edges that enter and leave them.
    At a node an edge is known by the word that it adds."""
    at = own.astype(np.int64)
    word = lambda i: (tokens.word[i] >> _U(32)).astype(np.uint32) | np.uint32(2)
    tails, leaving = _side(tokens.mer(at, WINDOW - 1), word(at + WINDOW - 1))
    heads, entering = _side(tokens.mer(at + 1, WINDOW - 1), word(at))
    nodes = np.union1d(tails, heads)
    enters, leaves = np.full(len(nodes), NONE), np.full(len(nodes), NONE)
    leaves[np.searchsorted(nodes, tails)] = leaving
    enters[np.searchsorted(nodes, heads)] = entering
    return nodes, enters, leaves


def send_nodes(table: pa.Table, sources: pa.Table, chunk: int, buckets: int) -> pa.Table:
    """The nodes of a chunk's repeated edges with their edges."""
    own = _repeated(sources)[0]
    if not len(own):
        return _table([], _NODES)
    nodes, enters, leaves = node_edges(_load(table)[1], own)
    order = np.argsort(short(nodes, buckets), kind="stable")
    nodes = nodes[order]
    return _table([(b, chunk, *x) for b, *x in _blobs(_bucket(nodes, buckets), low=low(nodes), enters=enters[order], leaves=leaves[order])], _NODES)


def path_ends(table: pa.Table) -> pa.Table:
    """Per chunk, its nodes that several edges enter or leave: the join of each node's
    edges with their successors.  (A clash of short hashes only ends a path early.)"""
    (nodes, enters, leaves), row = _read(table, "low", "enters", "leaves"), _rows(table, "low")
    order = np.argsort(nodes, kind="stable")
    start = _bounds(nodes[order])[:-1]
    several = np.zeros(len(start), dtype=bool)
    for side in (enters, leaves):
        own = side[order]
        most = np.maximum.reduceat(own, start) if len(start) else own
        known = np.where(own == NONE, np.iinfo(np.uint32).max, own)
        least = np.minimum.reduceat(known, start) if len(start) else known
        several |= (least == SEVERAL) | ((most != NONE) & (least != most))
    branching = np.empty(len(nodes), dtype=bool)
    branching[order] = np.repeat(several, np.diff(np.r_[start, len(nodes)]))
    chunks, bucket = table["chunk"].to_numpy(), table["bucket"][0].as_py()
    return _table([(bucket, int(chunks[r]), x) for r, x in _by_row(row, branching, low=nodes)], _HOT)


def repeated_paths(ids: np.ndarray, tokens: Tokens, repeated: tuple[np.ndarray, ...], ends: np.ndarray, buckets: int):
    """A chunk's pieces of nonbranching paths that some smaller document has: first word,
    number of edges, chunk and place of the source.  ``ends`` are the sorted short hashes of the nodes that end paths."""
    own, home, there, every = repeated
    n = len(tokens.word) - WINDOW + 1
    if not len(own) or n <= 0:
        return [np.empty(0, np.int64)] * 4
    at = np.flatnonzero(tokens.doc[:n] == tokens.doc[WINDOW - 1:])
    edges, known = tokens.mer(at, WINDOW), tokens.mer(own.astype(np.int64), WINDOW)
    rank = np.argsort(known, kind="stable")
    known = known[rank]
    place = np.minimum(np.searchsorted(known, edges), len(known) - 1)
    use = known[place] == edges
    at, edges, place = at[use], edges[use], place[use]
    check, known_check = tokens.checks(at, WINDOW), tokens.checks(own[rank].astype(np.int64), WINDOW)
    while True:  # on to the next edge of the same 64 bits
        other = (known[place] == edges) & (known_check[place] != check) & (place + 1 < len(known))
        if not other.any():
            break
        place[other] += 1
    found = rank[place]
    use = (known[place] == edges) & (known_check[place] == check) & (every[found] | (ids[tokens.doc[at]] > ids[tokens.doc[own[found]]]))
    at, found = at[use], found[use]
    if not len(at):
        return [np.empty(0, np.int64)] * 4
    home, there = home[found], there[found].astype(np.int64)
    ending = _among(short(tokens.mer(at, WINDOW - 1), buckets), ends)
    runs_on = (at[1:] == at[:-1] + 1) & (tokens.doc[at[1:]] == tokens.doc[at[:-1]]) & (home[1:] == home[:-1]) & (there[1:] == there[:-1] + 1) & ~ending[1:]
    first = np.flatnonzero(np.r_[True, ~runs_on])
    return [at[first], np.diff(np.r_[first, len(at)]), home[first], there[first]]


def ask_sources(table: pa.Table, told: pa.Table, chunk: int, buckets: int) -> pa.Table:
    """The distinct pieces of a chunk with all places of theirs, addressed to the chunks of their sources."""
    repeated = _repeated(told)
    if not len(repeated[0]):
        return _table([], _ASKED)
    ids, tokens = _load(table)
    asked: dict[int, dict[tuple, list[int]]] = {}
    for at, edges, home, there in zip(*[p.tolist() for p in repeated_paths(ids, tokens, repeated, _short(told), buckets)]):
        length = edges + WINDOW - 1
        asked.setdefault(home, {}).setdefault((there, length, tokens.digest(at, length)), []).append(at)
    out = []
    for home, pieces in sorted(asked.items()):
        keys = sorted(pieces)
        columns = {
            "there": np.array([k[0] for k in keys]), "length": np.array([k[1] for k in keys]), "digest": np.frombuffer(b"".join(k[2] for k in keys), "V16"),
            "times": np.array([len(pieces[k]) for k in keys]), "places": np.concatenate([pieces[k] for k in keys])}
        out.append((home, chunk, *[CODECS[name].pack(c) for name, c in columns.items()]))
    return _table(out, _ASKED)


def answer(table: pa.Table, asked: pa.Table) -> pa.Table:
    """The asked pieces, whose words must stand at their places in this chunk."""
    if not len(asked):
        return _table([], _VERIFIED)
    tokens = _load(table)[1]
    pieces = sorted({x for r in asked.to_batches() for x in zip(*[v.tolist() for v in _read(pa.Table.from_batches([r]), "there", "length", "digest")])})
    for there, length, digest in pieces:
        if tokens.digest(there, length) != digest:
            raise ValueError("two different windows share a 96-bit hash: change the multipliers in substring.py and run again")
    return asked.select(_VERIFIED.names).cast(_VERIFIED)


def finish(table: pa.Table, verified: pa.Table, with_text: bool) -> pa.Table:
    """Removes the words of the verified segments."""
    ids, order = _order(table)
    texts = [table["text"][i].as_py() for i in order]
    words = [t.split() for t in texts]
    first = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
    length, times, at = _read(verified, "length", "times", "places")
    edge = np.bincount(at, minlength=first[-1] + 1) - np.bincount(at + np.repeat(length, times), minlength=first[-1] + 1)
    used = np.bincount(np.searchsorted(first, at, side="right") - 1, minlength=len(ids))
    keep = np.cumsum(edge)[:-1] == 0
    out = []
    for d, w in enumerate(words):
        kept = keep[first[d]:first[d + 1]]
        n = int(kept.sum())
        text = b" ".join(w if n == len(w) else [x for x, k in zip(w, kept.tolist()) if k])
        out.append((None if ids[d] == NULL_ID else int(ids[d]), len(w), len(w) - n, int(used[d]), text.decode() if with_text else None, hashlib.sha256(text).hexdigest()))
    return _table(out, _DONE)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document row: id, n_words, n_removed, n_segments, kept (the words
    left, one space between; null without ``with_text``) and kept_sha256.

    One plan: the exchange that deals the texts by chunk is written once and read
    by every chunk stage."""
    size = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)).cast("long"))).first()[0] or 0
    tasks = max(4, shuffle_partitions(docs.sparkSession))
    buckets = max(tasks, -(-size // BUCKET_BYTES))
    chunks = max(tasks, -(-size // max(CHUNK_BYTES, min(MOST_BYTES, size // MANY_CHUNKS))))
    dealt = chunk_of(docs, chunks, id_col, text_col).groupBy("chunk")
    one = lambda key: int(key[0].as_py())

    sent = dealt.applyInArrow(lambda key, t: send_minimizers(t, one(key), buckets), _ddl(_SENT))
    hot = sent.groupBy("bucket").applyInArrow(hot_minimizers, _ddl(_HOT))
    edges = dealt.cogroup(hot.groupBy("chunk")).applyInArrow(lambda key, t, h: send_edges(t, h, one(key), buckets), _ddl(_EDGES))
    sources = edges.groupBy("bucket").applyInArrow(edge_sources, _ddl(_SOURCES))
    nodes = dealt.cogroup(sources.groupBy("chunk")).applyInArrow(lambda key, t, s: send_nodes(t, s, one(key), buckets), _ddl(_NODES))
    ends = nodes.groupBy("bucket").applyInArrow(path_ends, _ddl(_HOT))
    told = sources.unionByName(ends, allowMissingColumns=True)
    asked = dealt.cogroup(told.groupBy("chunk")).applyInArrow(lambda key, t, s: ask_sources(t, s, one(key), buckets), _ddl(_ASKED))
    verified = dealt.cogroup(asked.groupBy("home")).applyInArrow(answer, _ddl(_VERIFIED))
    done = dealt.cogroup(verified.groupBy("chunk")).applyInArrow(lambda t, v: finish(t, v, with_text), _ddl(_DONE))
    return done.withColumnRenamed("id", id_col)
