"""Exact n-gram Jaccard join: size-banded tiles, parity bitmaps, sorted-array intersection.

Plan (no cross join, no text shuffle):

1. Every slice of documents turns its texts into distinct shingle hashes and sends them, packed per
   hash bucket, to the bucket that counts them.  A shingle that a slice holds in ``HOT`` sets or more is
   sent once, without its documents.
2. Buckets tell the slices how many shingles of each set are found in two sets or more, and which slice
   owns a set that several hold.  A set can only reach the threshold if that share of its shingles is
   repeated elsewhere, so most documents end here.  Slices answer with one bit for each repeated shingle,
   and buckets return those of the sets that remain with their capped count; they read the same exchange.
3. The rest post a prefix of their rarest shingles; sets that share a prefix shingle and whose sizes are
   compatible meet in a tile.  The shingles behind the first common one bound the overlap from above, so
   late meetings end here, and a pair whose preceding shingles are equal too has met there already.
   Tiles of frequent shingles also compare parity signatures: the bits in which two differ bound the
   symmetric difference from below, hence the overlap from above.  Tiles of more than ``TILE`` sets are
   cut into blocks, one task for each pair of blocks.
4. Pairs pass the signature bound, then the exact intersection of sorted arrays.
5. Linked classes of equal sets are contracted to components.

Equal shingle sets are one class throughout, so thousands of copies cost one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import textbuf as tb
from factloom.llm.common import arrow_map, attach, binary, discard, filesystem, longs, materialize, partitions, release, scratch_path, trim
from factloom.llm.components import components
from factloom.llm.sift import without_keys

#: Document counts of shingles are exact below this and equal above it; it only orders shingles.
HOT = 32
#: Sets that meet in one tile before the tile is cut into blocks.
TILE = 4096
#: Bytes of text of one slice.
SLICE = 4 << 20
LOW48 = np.uint64((1 << 48) - 1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles, and the row bounds.

    A-Z are lower-cased and words are ``[^\\x20\\x09-\\x0D]+``.  A text with fewer words has its whole
    sequence as one shingle; one without words has none.
    """
    low = tb.LOWER[data]
    starts, ends = tb.runs(tb.NOT_SPACE[low], bounds)
    words = tb.span_hashes(low, starts, ends)
    first = tb.rows_of(starts, bounds)
    hashes, inner = tb.window_hashes(words, first, width)
    n_words = np.diff(first)
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for k, r in enumerate(short.tolist()):
            value = 0x5851F42D4C957F2D + int(n_words[r])
            for w in words[first[r] : first[r + 1]].tolist():
                value = (value * 0x9E3779B97F4A7C15 + w) & 0xFFFFFFFFFFFFFFFF
            whole[k] = value
        counts = np.diff(inner)
        counts[short] = 1
        outer = np.concatenate(([0], np.cumsum(counts)))
        joined = np.empty(outer[-1], np.uint64)
        rows = tb.row_ids(inner)
        joined[outer[rows] + np.arange(len(hashes)) - inner[rows]] = hashes
        joined[outer[short]] = tb.mix(whole)
        hashes, inner = joined, outer
    return tb.distinct_by_row(hashes, inner)


def _pack48(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _pack_owners(owner: np.ndarray, classes: int) -> bytes:
    """Ascending class numbers of items: counts by class or steps between items, whichever takes less."""
    counts = np.bincount(owner, minlength=classes)
    by_class = np.uint8 if counts.max(initial=0) < 256 else np.uint32
    steps = np.diff(owner, prepend=0)
    top = int(steps.max(initial=0))
    by_item = np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32
    if classes * by_class().itemsize <= len(owner) * by_item().itemsize:
        return bytes([by_class().itemsize]) + counts.astype(by_class).tobytes()
    return bytes([16 + by_item().itemsize]) + steps.astype(by_item).tobytes()


def _unpack_owners(raw: bytes) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32}[raw[0] & 15]
    values = np.frombuffer(raw, kind, offset=1).astype(np.int64)
    return np.cumsum(values) if raw[0] >= 16 else np.repeat(np.arange(len(values)), values)


#: Rows of an exchange: bucket rows go to ``at`` >= 0, a slice's own rows to ``-1 - slice``.
_SENT = "at long, slice long, a binary, b binary, c binary, d binary"
_NAMES = ["at", "slice", "a", "b", "c", "d"]


def _sent(rows: list[tuple]) -> tuple[list[pa.Array], list[str]]:
    at, number, *parts = zip(*rows) if rows else ([],) * 6
    return [pa.array(at, pa.int64()), pa.array(number, pa.int64()), *(pa.array(p, pa.binary()) for p in parts)], _NAMES


def _send(width: int, buckets: int):
    """Step 1: packed shingles and class keys by bucket, and the slice's own row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            for part, data, bounds in tb.slices(batch, "text", SLICE):
                yield _send_slice(part, data, bounds, number, width, buckets)
                number += 1
                trim()

    return run


def set_keys(tokens: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each shingle set, 0 for the empty one."""
    sizes = np.diff(inner)
    total = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tb.mix(tokens), out=total[1:])
    keys = tb.mix((total[inner[1:]] - total[inner[:-1]]) ^ (sizes.astype(np.uint64) << np.uint64(48)))
    keys[sizes == 0] = 0
    return keys


def _send_slice(part: pa.RecordBatch, data: np.ndarray, bounds: np.ndarray, number: int, width: int, buckets: int) -> pa.RecordBatch:
    tokens, inner = shingle_sets(data, bounds, width)
    sizes = np.diff(inner)
    unique, first, klass = np.unique(set_keys(tokens, inner), return_index=True, return_inverse=True)
    chosen = np.zeros(part.num_rows, bool)
    chosen[first] = True
    held = chosen[tb.row_ids(inner)]
    tokens, owner = tokens[held], klass[tb.row_ids(inner)[held]]
    # shingles of HOT sets of this slice are counted once and known to be hot
    order = np.argsort(tokens)
    ranked = tokens[order]
    edge = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1], [True]))) if len(ranked) else np.zeros(1, np.int64)
    often = np.repeat(np.diff(edge) >= HOT, np.diff(edge)) if len(ranked) else np.zeros(0, bool)
    hot = np.zeros(len(tokens), bool)
    hot[order[often]] = True
    hot_tokens = np.unique(tokens[hot])
    own = _own(unique, sizes[first], _folded(tokens[hot], buckets), owner[hot])
    rows = [(-1 - number, number, _rows(part, sizes, klass), own, b"", b"")]
    tokens, owner = tokens[~hot], owner[~hot]
    bucket = _bucket(tokens, buckets)
    order = np.lexsort((owner, bucket)) if len(owner) and (np.diff(owner) < 0).any() else np.argsort(bucket, kind="stable")
    tokens, owner, bucket = tokens[order], owner[order], bucket[order]
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    hot_tokens, hot_cut = _cut(hot_tokens, _bucket(hot_tokens, buckets), buckets)
    named = np.flatnonzero(unique)
    named, key_cut = _cut(named, _bucket(tb.mix(unique[named]), buckets), buckets)
    for b in range(buckets):
        x, y, hx, hy, kx, ky = cut[b], cut[b + 1], hot_cut[b], hot_cut[b + 1], key_cut[b], key_cut[b + 1]
        if x < y or hx < hy or kx < ky:
            keys = unique[named[kx:ky]].tobytes() + named[kx:ky].astype(np.uint32).tobytes()
            rows.append((b, number, _pack_owners(owner[x:y], len(unique)), _pack48(tokens[x:y]), _pack48(hot_tokens[hx:hy]), keys))
    return pa.RecordBatch.from_arrays(*_sent(rows))


def _cut(items: np.ndarray, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Items in the order of their buckets, and where each bucket's begin."""
    order = np.argsort(bucket, kind="stable")
    return items[order], np.searchsorted(bucket[order], np.arange(buckets + 1))


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return (((tokens >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16)).astype(np.uint16 if buckets < 65536 else np.int64)


def _folded(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """What is left of a hash behind its bucket: the bucket number above the low 48 bits."""
    return (_bucket(tokens, buckets).astype(np.uint64) << np.uint64(48)) | (tokens & LOW48)


def _rows(part: pa.RecordBatch, sizes: np.ndarray, klass: np.ndarray) -> bytes:
    """The slice's documents as an Arrow stream."""
    ids = part.column(part.schema.get_field_index("doc_id"))
    table = pa.RecordBatch.from_arrays([ids, pa.array(sizes), pa.array(klass.astype(np.int64))], ["doc_id", "n", "klass"])
    return _ipc(table)


def _own(keys: np.ndarray, sizes: np.ndarray, hot: np.ndarray, owner: np.ndarray) -> bytes:
    """The slice's classes with the shingles that are already known to be hot."""
    counts = np.bincount(owner, minlength=len(keys))
    order = np.argsort(owner, kind="stable")
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), longs(hot[order]))
    return _ipc(pa.RecordBatch.from_arrays([longs(keys), pa.array(sizes), lists], ["key", "n", "hot"]))


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _codes(group: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For the rows of a bucket, the shingles that are in two sets or more as a mask, and the capped counts of these."""
    parts = [_unpack48(t) for t in group.column("b").to_pylist()]
    cut = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    order = np.argsort(every)
    ranked = every[order]
    edge = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    code = np.minimum(np.diff(np.append(edge, len(ranked))), HOT)
    hot = np.unique(_unpack48(b"".join(group.column("c").to_pylist())))
    if len(hot) and len(edge):
        at = np.searchsorted(hot, ranked[edge])
        code[hot[np.minimum(at, len(hot) - 1)] == ranked[edge]] = HOT
    codes = np.empty(len(every), np.uint8)
    codes[order] = np.repeat(code, np.diff(np.append(edge, len(ranked)))).astype(np.uint8)
    return parts, [codes[x:y] for x, y in zip(cut[:-1], cut[1:])]


def _count(key: tuple, group: pa.Table) -> pa.Table:
    """Step 2a: a bucket tells each slice the classes of its repeated shingles and the classes that it owns."""
    bucket = key[0].as_py()
    slices = group.column("slice").to_pylist()
    if bucket < 0:
        rows = []
        for number, own in zip(slices, group.column("b").to_pylist()):
            classes = pa.ipc.open_stream(own).read_all().combine_chunks()
            hot = np.diff(classes.column("hot").combine_chunks().offsets.to_numpy()) if len(classes) else np.zeros(0, np.int64)
            rows.append((-1, number, classes.column("n").to_numpy().astype(np.int64).tobytes(), hot.astype(np.int64).tobytes(), b"", b""))
        return pa.table(*_sent(rows))
    _, codes = _codes(group)
    raw = group.column("d").to_pylist()
    keys = [np.frombuffer(r, np.uint64, count=len(r) // 12) for r in raw]
    local = [np.frombuffer(r, np.uint32, offset=len(r) // 12 * 8) for r in raw]
    row = np.repeat(np.arange(len(raw)), [len(k) for k in keys])
    every, numbers = np.concatenate(keys), np.asarray(slices)[row]
    order = np.lexsort((numbers, every))
    first = np.ones(len(every), bool)
    first[1:] = every[order][1:] != every[order][:-1]
    owns = np.zeros(len(every), bool)
    owns[order[first]] = True
    at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
    rows = []
    for k, (number, packed) in enumerate(zip(slices, group.column("a").to_pylist())):
        owner = _unpack_owners(packed)[codes[k] >= 2]
        owned = local[k][owns[at[k] : at[k + 1]]]
        if len(owner) or len(owned):
            rows.append((bucket, number, _pack_owners(owner, int(owner.max(initial=-1)) + 1), owned.tobytes(), b"", b""))
    trim()
    return pa.table(*_sent(rows))


def _choose(threshold: int):
    """Step 2b: a slice's classes that it owns and that could reach the threshold, as bits for each repeated shingle."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        number = key[0].as_py()
        at, a, b = (group.column(c).to_pylist() for c in ("at", "a", "b"))
        own = at.index(-1)
        sizes, repeated = np.frombuffer(a[own], np.int64), np.frombuffer(b[own], np.int64).copy()
        owned = np.zeros(len(sizes), bool)
        owners = {}
        for bucket, packed, mine in zip(at, a, b):
            if bucket >= 0:
                owners[bucket] = _unpack_owners(packed)
                repeated += np.bincount(owners[bucket], minlength=len(sizes))
                owned[np.frombuffer(mine, np.uint32)] = True
        live = owned & (100 * repeated >= threshold * sizes) & (sizes > 0)
        rows = [(-1 - number, number, np.packbits(live).tobytes(), b"", b"", b"")]
        for bucket, owner in owners.items():
            bits = live[owner]
            if bits.any():
                rows.append((bucket, number, np.packbits(bits).tobytes(), b"", b"", b""))
        return pa.table(*_sent(rows))

    return run


def _answer(key: tuple, sent: pa.Table, answers: pa.Table) -> pa.Table:
    """Step 2c: a bucket returns the repeated shingles of the chosen classes; a slice's own row goes with its choice."""
    bucket = key[0].as_py()
    chosen = dict(zip(answers.column("slice").to_pylist(), answers.column("a").to_pylist()))
    if bucket < 0:
        rows = [(-1, n, a, b, chosen[n], b"") for n, a, b in zip(sent.column("slice").to_pylist(), sent.column("a").to_pylist(), sent.column("b").to_pylist())]
        return pa.table(*_sent(rows))
    rows = []
    if chosen:
        parts, codes = _codes(sent)
        for k, (number, packed) in enumerate(zip(sent.column("slice").to_pylist(), sent.column("a").to_pylist())):
            if number in chosen:
                repeated = np.flatnonzero(codes[k] >= 2)
                keep = repeated[np.unpackbits(np.frombuffer(chosen[number], np.uint8), count=len(repeated)).view(bool)]
                owner = _unpack_owners(packed)[keep]
                rows.append((bucket, number, _pack_owners(owner, int(owner.max(initial=-1)) + 1), _pack48(parts[k][keep]), codes[k][keep].tobytes(), b""))
    trim()
    return pa.table(*_sent(rows))


_FOUND = "is_class boolean, doc_id long, n long, key long, prefix int, cold int, tokens binary, part long"


def _gather(threshold: int):
    """Step 3a: the documents of some slices, and their chosen classes with their repeated shingles, rarest first."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        by_slice: dict[int, list[dict]] = {}
        for row in group.to_pylist():
            by_slice.setdefault(row["slice"], []).append(row)
        found = pa.concat_tables([one(rows) for rows in by_slice.values()])
        return found.append_column("part", pa.array(np.full(len(found), key[0].as_py())))

    def one(rows: list[dict]) -> pa.Table:
        own = next(r for r in rows if r["at"] < 0)
        docs = pa.ipc.open_stream(own["a"]).read_all()
        classes = pa.ipc.open_stream(own["b"]).read_all().combine_chunks()
        keys = classes.column("key").to_numpy()
        sizes = classes.column("n").to_numpy()
        live = np.unpackbits(np.frombuffer(own["c"], np.uint8), count=len(keys)).view(bool)
        hot = classes.column("hot").combine_chunks()
        tokens = [hot.values.to_numpy().view(np.uint64)]
        owner = [np.repeat(np.arange(len(keys)), np.diff(hot.offsets.to_numpy()))]
        codes = [np.full(len(tokens[0]), HOT, np.uint8)]
        for r in rows:
            if r["at"] >= 0:
                owner.append(_unpack_owners(r["a"]))
                tokens.append(_unpack48(r["b"]) | np.uint64(r["at"] << 48))
                codes.append(np.frombuffer(r["c"], np.uint8))
        tokens, owner, codes = np.concatenate(tokens), np.concatenate(owner), np.concatenate(codes)
        held = live[owner]
        tokens, owner, codes = tokens[held], owner[held], codes[held]
        repeated = np.bincount(owner, minlength=len(keys))
        cold = np.bincount(owner[codes < HOT], minlength=len(keys))
        least = -(-threshold * sizes // 100)
        order = np.lexsort((tokens, codes, owner))
        tokens, owner = tokens[order], owner[order]
        cut = np.searchsorted(owner, np.arange(len(keys) + 1))
        picked = np.flatnonzero(live)
        prefix = (repeated - least + 1)[picked]
        klass = docs.column("klass").to_numpy()
        none = lambda kind: pa.nulls(len(klass), kind)
        members = pa.table({"is_class": pa.array([False] * len(klass), pa.bool_()), "doc_id": docs.column("doc_id"), "n": docs.column("n"), "key": pa.array(keys[klass]), "prefix": none(pa.int32()), "cold": none(pa.int32()), "tokens": none(pa.binary())})
        found = pa.table({"is_class": pa.array([True] * len(picked), pa.bool_()), "doc_id": pa.nulls(len(picked), pa.int64()), "n": pa.array(sizes[picked], pa.int64()), "key": pa.array(keys[picked], pa.int64()), "prefix": pa.array(prefix, pa.int32()), "cold": pa.array(np.minimum(cold[picked], prefix), pa.int32()), "tokens": binary([tokens[cut[k] : cut[k + 1]].tobytes() for k in picked])})
        return pa.concat_tables([members, found])

    return run


def _signature(tokens: np.ndarray, bits: int) -> bytes:
    """Parity bitmap: bit i tells whether an odd number of hashes fall on it."""
    at = (tb.mix(tokens) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _bits(n: int) -> int:
    """Bits of the signature of a set of n shingles; it grows with n, so it never saturates."""
    return 1 << min(max(6, (n - 1).bit_length() - 1), 13)


#: A count of shingles behind a prefix shingle that stands for itself and all greater ones.
_FAR = 65_535
#: Prefix shingles of one row of postings.
_PIECE = 1 << 18


def _prefixes(batch: pa.RecordBatch, threshold: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces of a batch: first row and end, and for each prefix shingle its row, token, place, shingles behind it and predecessor (0: none)."""
    sizes, prefixes = (batch.column(c).to_numpy() for c in ("n", "prefix"))
    sets = [np.frombuffer(t, np.uint64) for t in batch.column("tokens").to_pylist()]
    total = np.concatenate(([0], np.cumsum(prefixes)))
    start = 0
    while start < len(sets):
        end = max(start + 1, int(np.searchsorted(total, total[start] + _PIECE, side="right")) - 1)
        counts = prefixes[start:end]
        row = np.repeat(np.arange(start, end), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        tokens = tb.mix(np.concatenate([sets[k][: prefixes[k]] for k in range(start, end)]))
        before = np.where(place > 0, np.append(np.uint64(0), tokens[:-1]), np.uint64(0)) if len(row) else tokens
        rest = (prefixes - 2 - (-threshold * sizes // 100))[row] - place
        yield start, end, row, tokens, place, np.minimum(rest, _FAR), before, sets
        start = end


_COLD = "t long, heads binary, counts binary, tiles binary, rests binary, befores binary"


def _post_cold(threshold: int, tasks: int):
    """Step 3b: prefix postings of the shingles below ``HOT``, packed by the task that holds their tile."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, sizes, cold = (batch.column(c).to_numpy() for c in ("key", "n", "cold"))
        for _, _, row, tokens, place, rest, before, _ in _prefixes(batch, threshold):
            held = place < cold[row]
            row, tokens, rest, before = row[held], tokens[held], rest[held], before[held]
            t = _bucket(tokens, tasks)
            order = np.argsort(t, kind="stable")
            row, tokens, rest, before = row[order], tokens[order], rest[order], before[order]
            cut = np.searchsorted(t[order], np.arange(tasks + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cut)).tolist():
                x, y = cut[k], cut[k + 1]
                classes, counts = np.unique(row[x:y], return_counts=True)
                heads = np.stack([keys[classes], sizes[classes]], axis=1).tobytes()
                rows.append((k, heads, counts.astype(np.uint32).tobytes(), _pack48(tokens[x:y]), rest[x:y].astype(np.uint16).tobytes(), _pack48(before[x:y])))
            if rows:
                k, *parts = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), *(pa.array(p, pa.binary()) for p in parts)], [f.split()[0] for f in _COLD.split(", ")])

    return each


def _overlap_fits(small: np.ndarray, large: np.ndarray, most: np.ndarray, threshold: int) -> np.ndarray:
    """Whether sets of these sizes could be similar if they share at most ``most`` shingles."""
    return (100 * np.minimum(small, large) >= threshold * np.maximum(small, large)) & ((100 + threshold) * most >= threshold * (small + large))


def _behind(rest: np.ndarray) -> np.ndarray:
    return np.where(rest >= _FAR, np.int64(1 << 40), rest.astype(np.int64))


def _meet(threshold: int, step: int = 1 << 20):
    """Candidate pairs of one task's tiles of cold shingles, tiles of one size at a time.

    If the shingle of a tile is the first that two sets share, they share at most the lesser number of
    shingles behind it beside it.  A similar pair always passes at its first common shingle.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        heads = np.concatenate([np.frombuffer(h, np.int64).reshape(-1, 2) for h in group.column("heads").to_pylist()])
        head = np.repeat(np.arange(len(heads)), np.concatenate([np.frombuffer(c, np.uint32) for c in group.column("counts").to_pylist()]))
        tiles = np.concatenate([_unpack48(x) for x in group.column("tiles").to_pylist()])
        rest = _behind(np.concatenate([np.frombuffer(x, np.uint16) for x in group.column("rests").to_pylist()]))
        before = np.concatenate([_unpack48(x) for x in group.column("befores").to_pylist()])
        order = np.argsort(tiles, kind="stable")
        head, tiles, rest, before = head[order], tiles[order], rest[order], before[order]
        keys, sizes = heads[:, 0], heads[:, 1]
        edge = np.flatnonzero(np.concatenate(([True], tiles[1:] != tiles[:-1], [True])))
        count = np.diff(edge)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in np.unique(count[count > 1]).tolist():
            starts = edge[:-1][count == m]
            i, j = np.triu_indices(m, 1)
            for at in range(0, len(starts), max(1, step // len(i))):
                some = starts[at : at + max(1, step // len(i)), None]
                a, b = (some + i).ravel(), (some + j).ravel()
                new = (before[a] != before[b]) | (before[a] == 0)
                a, b = a[new], b[new]
                good = _overlap_fits(sizes[head[a]], sizes[head[b]], 1 + np.minimum(rest[a], rest[b]), threshold)
                left.append(keys[head[a[good]]])
                right.append(keys[head[b[good]]])
        left, right = np.concatenate(left), np.concatenate(right)
        return _pair_table(left, right)

    return run


def _pair_table(left: np.ndarray, right: np.ndarray) -> pa.Table:
    """Distinct unordered pairs of different keys."""
    a, b = np.minimum(left, right), np.maximum(left, right)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = a != b
    keep[1:] &= (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.table({"a": pa.array(a[keep], pa.int64()), "b": pa.array(b[keep], pa.int64())})


def _post_hot(threshold: int):
    """Step 3b: prefix postings of the frequent shingles, with their set's size and signature."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, sizes, cold = (batch.column(c).to_numpy() for c in ("key", "n", "cold"))
        for start, end, row, tokens, place, rest, before, sets in _prefixes(batch, threshold):
            held = place >= cold[row]
            if held.any():
                row, tokens, rest, before = row[held], tokens[held], rest[held], before[held]
                some = np.unique(row)
                marks = binary([_signature(sets[k], _bits(int(sizes[k]))) for k in some.tolist()])
                yield pa.RecordBatch.from_arrays([longs(tokens), longs(before), pa.array(rest.astype(np.int32)), pa.array(keys[row]), pa.array(sizes[row]), marks.take(pa.array(np.searchsorted(some, row)))], ["token", "before", "rest", "key", "n", "mark"])

    return each


_POSTING = "token long, before long, rest int, key long, n long, mark binary"
_PAIR = "a long, b long"


def _folds(marks: list[bytes], bits: int) -> np.ndarray:
    """Signatures as rows of 64-bit words, longer ones folded to ``bits`` by exclusive or."""
    out = np.zeros((len(marks), bits // 64), np.uint64)
    for k, mark in enumerate(marks):
        words = np.frombuffer(mark, np.uint64)
        out[k] = np.bitwise_xor.reduce(words.reshape(-1, bits // 64), axis=0)
    return out


def _tile(keys: np.ndarray, sizes: np.ndarray, marks: list[bytes], rest: np.ndarray, before: np.ndarray, side: np.ndarray | None, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that sizes, places and signatures allow, compared in size order, a block of rows at a time."""
    order = np.argsort(sizes, kind="stable")
    keys, sizes, rest, before = keys[order], sizes[order], rest[order], before[order]
    side = None if side is None else side[order]
    bits = _bits(int(sizes[0]))
    words = _folds([marks[k] for k in order.tolist()], bits)
    left, right = [], []
    for start in range(0, len(keys), 64):
        end = min(start + 64, len(keys))
        # sizes from here on; the last that is compatible with the largest of this block
        stop = int(np.searchsorted(sizes, sizes[end - 1] * 100 // threshold, side="right"))
        stop = max(stop, end)
        small, large = sizes[start:end, None], sizes[None, start:stop]
        good = _overlap_fits(small, large, 1 + np.minimum(rest[start:end, None], rest[None, start:stop]), threshold)
        good &= np.arange(start, stop)[None, :] > np.arange(start, end)[:, None]
        good &= keys[start:end, None] != keys[None, start:stop]
        good &= (before[start:end, None] != before[None, start:stop]) | (before[start:end, None] == 0)
        if side is not None:
            good &= side[start:end, None] != side[None, start:stop]
        i, j = np.nonzero(good)
        fits = np.ones(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            x, y = start + i[at : at + (1 << 16)], start + j[at : at + (1 << 16)]
            apart = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64)
            fits[at : at + (1 << 16)] = _overlap_fits(sizes[x], sizes[y], (sizes[x] + sizes[y] - apart) // 2, threshold)
        left.append(keys[start + i[fits]])
        right.append(keys[start + j[fits]])
    return np.concatenate(left), np.concatenate(right)


def _tiles(threshold: int):
    """Candidate pairs of token-sorted postings; a tile may cross batches but its sets are bounded by ``TILE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            tiles = table.column("tile").to_numpy()
            if len(tiles) == 0:
                continue
            last = int(np.searchsorted(tiles, tiles[-1], side="left"))
            held = table.slice(last)
            if last:
                yield _pairs_of(table.slice(0, last), threshold)
        if held is not None and held.num_rows:
            yield _pairs_of(held, threshold)

    return run


def _pairs_of(table: pa.Table, threshold: int) -> pa.RecordBatch:
    table = table.combine_chunks()
    tiles = table.column("tile").to_numpy()
    edge = np.flatnonzero(np.concatenate(([True], tiles[1:] != tiles[:-1], [True])))
    many = np.flatnonzero(np.diff(edge) > 1)
    keys, sizes, sides, before = (table.column(c).to_numpy() for c in ("key", "n", "side", "before"))
    rest = _behind(table.column("rest").to_numpy())
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for k in many.tolist():
        a, b = int(edge[k]), int(edge[k + 1])
        side = sides[a:b] if (sides[a:b] >= 0).all() else None
        left, right = _tile(keys[a:b], sizes[a:b], table.column("mark").slice(a, b - a).to_pylist(), rest[a:b], before[a:b], side, threshold)
        if len(left):
            out.append((left, right))
    left = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in out)])
    right = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in out)])
    return pa.RecordBatch.from_arrays([c.combine_chunks() for c in _pair_table(left, right).columns], ["a", "b"])


def _verify(threshold: int):
    """Step 4: signature bound, then exact intersection of the sorted arrays of each pair; one task has all sets of its pairs."""

    def run(key: tuple, pairs: pa.Table, sets: pa.Table) -> pa.Table:
        keys = sets.column("key").to_numpy()
        order = np.argsort(keys)
        sizes = sets.column("n").to_numpy()
        arrays = [np.sort(np.frombuffer(t, np.uint64)) for t in sets.column("tokens").to_pylist()]
        a, b = (pairs.column(c).to_numpy() for c in ("a", "b"))
        if not len(a):
            return _pair_table(a, b)
        x, y = (order[np.searchsorted(keys[order], k)] for k in (a, b))
        fits = _signatures_fit(arrays, sizes, x, y, threshold)
        a, b, x, y = a[fits], b[fits], x[fits], y[fits]
        by_left = np.argsort(x, kind="stable")
        a, b, x, y = a[by_left], b[by_left], x[by_left], y[by_left]
        both = np.zeros(len(x), np.int64)
        lengths = np.array([len(s) for s in arrays])
        edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)
        for start, end in zip(edge[:-1].tolist(), edge[1:].tolist()):
            one = arrays[x[start]]
            # a run of partners of about a million shingles at a time
            steps = np.cumsum(lengths[y[start:end]]) >> 20
            for at in np.split(np.arange(start, end), np.flatnonzero(np.diff(steps)) + 1):
                others = np.concatenate([arrays[k] for k in y[at].tolist()])
                if not len(one) or not len(others):
                    continue
                place = np.minimum(np.searchsorted(one, others), len(one) - 1)
                same = np.concatenate(([0], np.cumsum(one[place] == others)))
                cut = np.concatenate(([0], np.cumsum(lengths[y[at]])))
                both[at] = same[cut[1:]] - same[cut[:-1]]
        good = 100 * both >= threshold * (sizes[x] + sizes[y] - both)
        return _pair_table(a[good], b[good])

    return run


def _signatures_fit(arrays: list[np.ndarray], sizes: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    """Whether the signatures of the sets x and y leave room for the overlap that the threshold asks for.

    Arrays hold the repeated shingles; those of one set only are apart in any case and count as such.
    """
    bits = np.array([_bits(int(n)) for n in sizes])
    extra = sizes - np.array([len(s) for s in arrays])
    common = np.minimum(bits[x], bits[y])
    fits = np.ones(len(x), bool)
    for size in np.unique(common).tolist():
        mine = np.flatnonzero(common == size)
        used = np.unique(np.concatenate([x[mine], y[mine]]))
        words = np.stack([np.frombuffer(_signature(arrays[k], size), np.uint64) for k in used.tolist()])
        for at in range(0, len(mine), 1 << 14):
            some = mine[at : at + (1 << 14)]
            p, q = x[some], y[some]
            apart = np.bitwise_count(words[np.searchsorted(used, p)] ^ words[np.searchsorted(used, q)]).sum(axis=1, dtype=np.int64) + extra[p] + extra[q]
            fits[some] = _overlap_fits(sizes[p], sizes[q], (sizes[p] + sizes[q] - apart) // 2, threshold)
    return fits


def _blocks(postings: DataFrame, tile: int) -> DataFrame:
    """Give each posting its tile; tiles of more than ``tile`` sets become one tile for each pair of blocks."""
    plain = postings.withColumn("tile", F.col("token")).withColumn("side", F.lit(-1))
    big = materialize(postings.groupBy("token").agg(F.count("*").alias("sets")).filter(F.col("sets") > tile), "big")
    if big.limit(1).count() == 0:
        return plain
    # a token is big in at most postings / tile cases; it is looked up, not broadcast
    joined = postings.join(big, "token", "left")
    small = joined.filter("sets is null").drop("sets").withColumn("tile", F.col("token")).withColumn("side", F.lit(-1))
    cut = joined.filter("sets is not null").withColumn("blocks", F.ceil(F.col("sets") / (tile / 2)).cast("int")).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    spread = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("tile", F.xxhash64("token", F.least("block", "other"), F.greatest("block", "other")))
    spread = spread.withColumn("side", F.when(F.col("block") == F.col("other"), F.lit(-1)).when(F.col("block") < F.col("other"), F.lit(0)).otherwise(F.lit(1)))
    return small.unionByName(spread.select(*small.columns))


def similar(docs: DataFrame, threshold: int = 70, width: int = 3, buckets: int | None = None, tile: int = TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of documents ``(doc_id, n, key)``, links ``(a, b)`` of class keys, and classes ``(key, rows, least)``.

    ``threshold`` is the least Jaccard similarity in percent.  Shingles are compared by 48 bits of hash and
    their bucket, classes by 64 bits of hash.  ``docs`` must give the same partitions and row order when a task
    is repeated, as tables do: slices are numbered by partition.  Buckets grow with
    ``spark.sql.shuffle.partitions``, which must grow with the input.
    """
    spark = docs.sparkSession
    buckets = buckets or min(4 * partitions(spark), 65_536)
    tasks = min(4 * partitions(spark), 65_536)
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_send(width, buckets), _SENT)
    counted = sent.groupBy("at").applyInArrow(_count, _SENT)
    chosen = counted.groupBy("slice").applyInArrow(_choose(threshold), _SENT)
    answered = sent.groupBy("at").cogroup(chosen.groupBy("at")).applyInArrow(_answer, _SENT)
    part = F.pmod(F.xxhash64("slice"), F.lit(tasks)).alias("part")
    found = materialize(answered.groupBy(part).applyInArrow(_gather(threshold), _FOUND), "sets")
    release(spark)
    members = materialize(found.filter("not is_class").select("doc_id", "n", "key"), "rows")
    classes = materialize(members.filter("n > 0").groupBy("key").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")), "classes")
    sets = found.filter("is_class").select("key", "n", "prefix", "cold", "tokens")
    cold = arrow_map(sets, _post_cold(threshold, tasks), _COLD).groupBy("t").applyInArrow(_meet(threshold), _PAIR)
    hot = _blocks(materialize(arrow_map(sets.filter("prefix > cold"), _post_hot(threshold), _POSTING), "postings"), tile)
    met = hot.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles(threshold), _PAIR)
    pairs = materialize(cold.unionByName(met).distinct(), "pairs")
    grouped = _grouped(pairs, 4 * partitions(spark), max(2, tile // 4))
    needed = _needed(found.filter("is_class").select("part", "key", "n", "tokens"), grouped)
    links = materialize(grouped.groupBy("g").cogroup(needed.groupBy("h")).applyInArrow(_verify(threshold), _PAIR), "links")
    discard(found, pairs, grouped, needed)
    release(spark)
    return members, links, classes


def _needed(sets: DataFrame, grouped: DataFrame) -> DataFrame:
    """The sets ``(h, key, n, tokens)`` that each verifying task ``h`` needs; sets cross one shuffle only, the one behind this.

    What is wanted is a small table in the shared folder, one file for each part of the sets; the sets are read where
    they stand, with the files of their parts beside them.
    """
    wanted = grouped.select(F.col("g").alias("h"), F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = wanted.join(sets.select("key", "part"), "key")
    path = scratch_path(sets.sparkSession, "wanted")
    wanted.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(path)

    def of_part(part: int) -> pa.Table:
        fs, base = filesystem(path)
        files = fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/part={part}", allow_not_found=True))
        tables = [pq.ParquetFile(fs.open_input_file(f.path)).read(["h", "key"]) for f in files if f.base_name.endswith(".parquet")]
        return pa.concat_tables(tables) if tables else pa.table({"h": pa.array([], pa.int64()), "key": pa.array([], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, asked = -1, None
        for batch in batches:
            parts = batch.column("part").to_numpy()
            edge = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1], [True])))
            for start, end in zip(edge[:-1].tolist(), edge[1:].tolist()) if len(parts) else ():
                if parts[start] != part:
                    part, asked = int(parts[start]), of_part(int(parts[start]))
                keys = batch.column("key").to_numpy()[start:end]
                order = np.argsort(keys)
                mine = asked.column("key").to_numpy()
                at = np.minimum(np.searchsorted(keys[order], mine), end - start - 1)
                hit = np.flatnonzero(keys[order][at] == mine)
                row = pa.array(start + order[at[hit]])
                for k in range(0, len(hit), 1000):
                    some = batch.select(["key", "n", "tokens"]).take(row[k : k + 1000])
                    yield pa.RecordBatch.from_arrays([pa.array(asked.column("h").to_numpy()[hit[k : k + 1000]]), *some.columns], ["h", "key", "n", "tokens"])

    out = sets.mapInArrow(run, "h long, key long, n long, tokens binary")
    out._factloom_path = path
    return out


def _grouped(pairs: DataFrame, groups: int, tile: int) -> DataFrame:
    """Give each pair the task ``g`` that verifies it, so that a set is sent to few tasks.

    A set's mark is its least neighbour or itself; the members of a group of near copies share one, and a
    pair goes where the lesser of its two marks goes.  Marks of more than ``tile`` sets are cut into
    blocks of sets, with one task for each pair of blocks.
    """
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    marks = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("mark")), "marks")
    side = lambda c: marks.select(F.col("node").alias(c), F.col("mark").alias(f"mark_{c}"))
    marked = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("mark", F.least("mark_a", "mark_b"))
    blocks = marks.groupBy("mark").agg(F.ceil(F.count("*") / (tile / 2)).cast("int").alias("blocks")).filter("blocks > 2")
    cut = marked.join(blocks, "mark", "left")
    block = lambda c: F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64(c), "blocks")).otherwise(F.lit(0))
    place = F.xxhash64("mark", F.least(block("a"), block("b")), F.greatest(block("a"), block("b")))
    out = materialize(cut.select("a", "b", F.pmod(place, F.lit(groups)).alias("g")), "tasks")
    discard(marks)
    return out


def _classed(docs: DataFrame, threshold: int, width: int, **options: int) -> tuple[DataFrame, DataFrame]:
    """Documents ``(doc_id, n, key)`` and facts ``(key, copies, near, root, component)`` of their classes."""
    members, links, classes = similar(docs, threshold, width, **options)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(classes.select(F.col("key").alias("b"), "rows"), "b").groupBy("a").agg(F.sum("rows").alias("near"))
    roots = components(links)
    named = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    facts = named.join(least, "root").join(near.withColumnRenamed("a", "key"), "key", "left")
    return members, materialize(facts.select("key", F.col("rows").alias("copies"), F.coalesce("near", F.lit(0)).alias("near"), "root", "component"), "facts")


def jaccard_components(docs: DataFrame, threshold: int = 70, width: int = 3, **options: int) -> DataFrame:
    """One row for each document: ``doc_id, n_shingles, n_similar, component_id``.

    ``n_similar`` counts the other rows linked directly, ``component_id`` is the least doc_id reachable.
    Null and empty texts have no shingle and no link.  Equal texts link.  Repeated rows (also with equal
    doc_id) are documents of their own; a null doc_id stays null and never names a component unless it is
    alone.  Columns other than ``doc_id`` and ``text`` are ignored.  An empty table gives an empty result.
    """
    members, facts = _classed(docs, threshold, width, **options)
    joined = attach(members, facts, ["key"], "copies")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce(F.col("copies") - 1 + F.col("near"), F.lit(0)).alias("n_similar"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, threshold: int = 70, width: int = 3) -> DataFrame:
    """One row of each component stays, with all its columns.

    It is the row of the smallest doc_id; of several rows with that doc_id in the component, the one with the
    smallest text.  Rows are judged by their own texts, so unrelated texts under one doc_id both stay.  A null
    doc_id counts as the greatest.  Texts without words are alone and stay, with their repetitions.
    Texts of rows that stay take part in no shuffle, unless their doc_id is null or repeated.
    """
    members, facts = _classed(docs.select("doc_id", "text"), threshold, width)
    known = attach(members, facts, ["key"], "copies").select("doc_id", "n", "component")
    per = materialize(known.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count_if((F.col("n") > 0) & (F.col("doc_id") != F.col("component"))).alias("late")), "ids")
    gone = materialize(per.filter("rows > 1 or late > 0").select("doc_id"), "dropped")
    out = without_keys(docs, gone, "doc_id").filter("doc_id is not null")
    several = materialize(per.filter("rows > 1").select("doc_id"), "several")
    if several.limit(1).count() or members.filter("doc_id is null").limit(1).count():
        out = out.unionByName(_judged(docs, several, facts, width))
    return out


def _judged(docs: DataFrame, several: DataFrame, facts: DataFrame, width: int) -> DataFrame:
    """Of rows whose doc_id is null or in the table ``several``, those that stay, by their own shingle sets."""
    taken = {c.lower() for c in docs.columns}
    key, root, component = (next(n for n in (k + "_" * i for i in range(1, 99)) if n not in taken) for k in ("key", "root", "component"))

    def keyed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in tb.slices(batch, "text", SLICE):
            yield pa.RecordBatch.from_arrays([*part.columns, longs(set_keys(*shingle_sets(data, bounds, width)))], [*part.schema.names, key])

    rows = docs.join(several, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))
    rows = materialize(arrow_map(rows, keyed, T.StructType([*docs.schema.fields, T.StructField(key, T.LongType())])), "judged")
    alone = rows.filter(F.col(key) == 0).select(*docs.columns)
    named = attach(rows.filter(F.col(key) != 0), facts.select(F.col("key").alias(key), "copies", F.col("root").alias(root), F.col("component").alias(component)).withColumnRenamed("copies", f"{key}_n"), [key], f"{key}_n")
    first = named.filter(F.col("doc_id").eqNullSafe(F.col(component)))
    once = first.groupBy(root).agg(F.min_by(F.struct(*docs.columns), F.struct("text", key)).alias("row")).select("row.*")
    return alone.unionByName(once)
