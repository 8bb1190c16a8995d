"""N-gram Jaccard join by set-relation skipping, and the components of its links.

Two documents link when the Jaccard similarity of their sets of distinct word n-grams reaches
a threshold: 3-grams and 90 % unless the caller names another ``Rule``. The join is exact and works on relations between sets instead of single pairs:

1. Equal sets are one set: documents are grouped by a digest of their set, and only the
   distinct sets are joined.
2. All sets' elements are put in one global order (frequent elements last, otherwise by
   hash). Linked sets share an element among their first n - ceil(0.9 n) + 1 (at 90 %). An index list
   per element holds (size, position, sketch) of the sets that have it there. Inside a list
   blocks are skipped by size, then by position: as a pair's first shared element, a position
   bounds the overlap that is still possible. A 16-byte count sketch bounds the symmetric difference from below; groups are
   then compared by sketches of 256 bytes before any text moves.
3. A list names a group by its smallest member: every candidate pair meets in a group, and
   rows stay linear in the lists. In a group sets are answered in order of size; a set's
   overlaps with all others are derived from those of a highly similar set by the few elements
   in which the two differ.
   No task holds a list or group of any size: lists beyond LIST_BLOCK rows are parted by size
   class and dealt out in tiles of hash blocks before their rows come together, and groups
   beyond GROUP_BLOCK sets or GROUP_ELEMENTS elements likewise. Every pair meets in a tile.
4. A group returns a spanning forest of its links (never all pairs); components of the
   forests are found by alternating star contractions on written tables.

Words are runs of anything but space and \\t..\\r; A-Z are lower-cased. Texts of fewer words
than an n-gram has hold the whole sequence; texts without words link with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixtext.llm.common import per_worker, raw_texts
from mixtext.session import materialize

HOT_CHUNK = 2_000_000  # elements counted together when looking for frequent ones
HOT_IN_CHUNK = 4  # documents of a chunk that make an element a candidate
HOT_MOST = 200_000  # most frequent elements ordered last; the order never changes results
WIDE = 1024  # longer lists are cut into size classes instead of compared pair by pair
PAIRS = 1 << 16  # compared at once
LIST_BLOCK = 1 << 16  # rows of an index list in one hash block
GROUP_BLOCK = 2048  # sets of a group in one hash block
GROUP_ELEMENTS = 2_000_000  # elements of a group in one hash block
PLACES = 1 << 17  # hash places by which long lists and large groups are told from the rest
FILTER_BITS = 1 << 23  # of the bit set that keeps other documents' texts out of the shuffle
WIDE_SKETCH = 8  # bits of the sketch that groups are compared with: 256 bytes
CACHE_WORDS = 250_000  # some 30 MB
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Rule:
    """Documents link when ``den * overlap >= num * union`` of their word n-grams."""

    shingle: int = 3
    num: int = 90
    den: int = 100

    def needed(self, total: np.ndarray) -> np.ndarray:
        """Least overlap with which two sets of ``total`` elements together link."""
        return -(-self.num * total // (self.num + self.den))

    def prefix(self, n: int) -> int:
        """Elements of a set of n among which it shares one with every set it links with."""
        return n + self.num * -n // self.den + 1

    def linked(self, overlap, total):
        return (self.den * overlap >= self.num * (total - overlap)) & (overlap > 0)

    def size_class(self, n: np.ndarray) -> np.ndarray:
        """Sizes that link are at most one class apart."""
        return np.floor(np.log(n) / (np.log(self.den / self.num) * 1.0001)).astype(np.int64)

    def shingler(self) -> Shingler:
        return per_worker(f"shingler:{self.shingle}", lambda: Shingler(self.shingle))


CONTRACT = Rule()  # of the op10 query


class Shingler:
    """Texts to sorted arrays of 64-bit element hashes. (Two different elements of a pair of
    documents share a hash with probability below 1e-12.)"""

    def __init__(self, shingle: int = CONTRACT.shingle):
        self.shingle = shingle
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes.lower: A-Z only; bytes.split: space and \t..\r
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.shingle:
            return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=len(words))], np.uint64)
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        with np.errstate(over="ignore"):
            last = len(h) - self.shingle + 1
            s = h[:last]
            for i in range(1, self.shingle):
                by, shift = ((P1, 29), (P2, 32))[(i - 1) % 2]
                s = s * by
                s = (s ^ (s >> np.uint64(shift))) + h[i:last + i]
            s = s * P3
            s ^= s >> np.uint64(31)
        return np.unique(s)


def sketch(s: np.ndarray, bits: int = 4) -> bytes:
    """How many elements fall in each of 2**bits hash ranges, modulo 256. The counts of two
    sets differ by at most the elements in which the sets differ."""
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8).tobytes()


def digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def may_link(n1, p1, s1, n2, p2, s2, rule: Rule = CONTRACT) -> np.ndarray:
    """Whether sets (size, position of a shared element, sketch) can reach the overlap with that
    element as the first that they share: sets that link also meet in that element's list, so
    no other list need keep them together."""
    low, high = np.minimum(n1, n2), np.maximum(n1, n2)
    need = rule.needed(n1 + n2)
    most = np.minimum(n1 - p1, n2 - p2)  # nothing shared before it
    gap = (s1 - s2).astype(np.int64)
    apart = np.minimum(gap, 256 - gap).sum(axis=-1)
    return (rule.den * low >= rule.num * high) & (most >= need) & (apart <= n1 + n2 - 2 * need)


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.parts = n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.parts -= 1
        return True


def links(sets: list[np.ndarray], rule: Rule = CONTRACT) -> list[tuple[int, int]]:
    """A spanning forest of the links among a group's sets.

    Sets are answered in order of size. The overlaps of a set with all sets of the group come
    from those of the most similar set answered lately: elements that only one of the two has
    are added or taken off, list by list. Answers stop once all sets hang together.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    out = []
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if rule.linked(both, int(sizes.sum())) else []
    forest = Forest(n)
    element, local = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(local, kind="stable")
    lists, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(local, minlength=len(element)))])
    own = np.split(local, np.cumsum(sizes)[:-1])

    def tally(elements: np.ndarray) -> np.ndarray:
        """In how many of the elements' lists each set is."""
        if not len(elements):
            return np.zeros(n, np.int64)
        lens = begin[elements + 1] - begin[elements]
        at = np.repeat(begin[elements] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))
        return np.bincount(lists[at], minlength=n)

    recent: list[tuple[int, np.ndarray]] = []
    for y in np.argsort(sizes, kind="stable").tolist():
        near = max(recent, key=lambda r: r[1][y], default=None)
        if near is not None and 2 * near[1][y] > sizes[y]:
            x = near[0]
            overlap = near[1] + tally(np.setdiff1d(own[y], own[x], assume_unique=True)) - tally(np.setdiff1d(own[x], own[y], assume_unique=True))
        else:
            overlap = tally(own[y])
        recent = [*recent[-3:], (y, overlap)]
        linked = np.flatnonzero(rule.linked(overlap, sizes + sizes[y]))
        for z in linked.tolist():
            if z != y and forest.join(y, z):
                out.append((y, z))
        if forest.parts == 1:
            break
    return out


def _first_pass(docs: DataFrame, rule: Rule) -> DataFrame:
    """kind 0: (id, n, d, sk, wide) of each document; kind 1: (d = element, n = count) of elements
    that are frequent in a part of the table."""
    schema = "kind int, id long, n int, d long, sk binary, wide binary"

    def hot(parts: list[np.ndarray]) -> pa.RecordBatch | None:
        element, count = np.unique(np.concatenate(parts), return_counts=True)
        keep = count >= HOT_IN_CHUNK
        k = int(keep.sum())
        return pa.RecordBatch.from_pydict({
            "kind": pa.array(np.ones(k, np.int32)), "id": pa.nulls(k, pa.int64()), "n": pa.array(count[keep].astype(np.int32)),
            "d": pa.array(element[keep].view(np.int64)), "sk": pa.nulls(k, pa.binary()), "wide": pa.nulls(k, pa.binary())}) if k else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = rule.shingler()
        seen: set[int] = set()
        held, size = [], 0
        for b in batches:
            n, d, sk, wide = [], [], [], []
            for t in raw_texts(b.column(1)):
                s = shingler.of(t)
                n.append(len(s))
                d.append(digest(s))
                sk.append(sketch(s))
                wide.append(sketch(s, WIDE_SKETCH))
                if d[-1] not in seen:  # copies say nothing about an element's spread
                    seen.add(d[-1])
                    held.append(s)
                    size += len(s)
                    if size > HOT_CHUNK:
                        if (out := hot(held)) is not None:
                            yield out
                        held, size = [], 0
            yield pa.RecordBatch.from_pydict({
                "kind": pa.array(np.zeros(len(n), np.int32)), "id": b.column(0), "n": pa.array(n, pa.int32()),
                "d": pa.array(d, pa.int64()), "sk": pa.array(sk, pa.binary()), "wide": pa.array(wide, pa.binary())})
        if held and (out := hot(held)) is not None:
            yield out

    return docs.mapInArrow(run, schema)


def _entries(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray], rule: Rule) -> DataFrame:
    """(e, d, sk, n, p): each distinct set's first elements in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    kind = pa.schema([("e", pa.int64()), ("d", pa.int64()), ("sk", pa.binary()), ("n", pa.int32()), ("p", pa.int32())])

    def prefix(s: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
        keep = rule.prefix(len(s))
        if len(often):
            at = np.minimum(np.searchsorted(often, s), len(often) - 1)
            late = often[at] == s
            if late.any():
                s = np.concatenate([s[~late], s[late][np.argsort(rank[at[late]], kind="stable")]])
        return s[:keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = rule.shingler()
        often, rank = shared.value
        seen: set[tuple[int, bytes]] = set()
        for b in batches:
            e, d, sk, n, size = [], [], [], [], []
            for t in raw_texts(b.column(0)):
                s = shingler.of(t)
                if not len(s):
                    continue
                key = (digest(s), sketch(s))
                if key in seen:  # a copy within the task; others meet in the lists
                    continue
                seen.add(key)
                first = prefix(s, often, rank)
                e.append(first)
                d.append(key[0])
                sk.append(key[1])
                n.append(len(s))
                size.append(len(first))
            if not e:
                continue
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(e).view(np.int64)), pa.array(np.repeat(np.array(d, np.int64), size)),
                pa.array([x for x, k in zip(sk, size, strict=True) for _ in range(k)], pa.binary()),
                pa.array(np.repeat(np.array(n, np.int32), size)),
                pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in size]))], schema=kind)

    return docs.mapInArrow(run, "e long, d long, sk binary, n int, p int")


def _clusters(ok: np.ndarray) -> list[np.ndarray]:
    """Sets that may link, directly or not, as arrays of row numbers; lone sets are left out."""
    np.fill_diagonal(ok, False)
    left = np.flatnonzero(ok.any(axis=1))
    if not len(left):
        return []
    ok, label = ok[np.ix_(left, left)], np.arange(len(left))
    while True:
        new = np.minimum(label, np.where(ok, label[None, :], len(left)).min(axis=1))
        if (new == label).all():
            return [left[label == g] for g in np.unique(label).tolist()]
        label = new


def _meetings(e: np.ndarray, d: np.ndarray, sk: np.ndarray, n: np.ndarray, p: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(group, member) as row numbers, from index lists laid end to end (sorted by element,
    size, position). The smallest digest of a group names it."""
    if len(e) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    again = np.concatenate([[False], (e[1:] == e[:-1]) & (d[1:] == d[:-1]) & (sk[1:] == sk[:-1]).all(axis=1)])
    rows = np.flatnonzero(~again)
    cut = np.concatenate([[0], np.flatnonzero(np.diff(e[rows])) + 1, [len(rows)]])
    size = np.diff(cut)
    group, member = [], []

    def meet(x: np.ndarray) -> None:
        group.append(np.full(len(x), x[np.argmin(d[x])]))
        member.append(x)

    twos = cut[:-1][size == 2]
    a, b = rows[twos], rows[twos + 1]
    ok = may_link(n[a], p[a], sk[a], n[b], p[b], sk[b], rule)
    a, b = a[ok], b[ok]
    least = np.where(d[a] <= d[b], a, b)
    group += [least, least]
    member += [a, b]
    for k in np.flatnonzero(size > 2).tolist():
        x = rows[cut[k]:cut[k + 1]]
        if len(x) <= WIDE:
            step = max(1, PAIRS // len(x))
            ok = [may_link(n[y][:, None], p[y][:, None], sk[y][:, None, :], n[x][None, :], p[x][None, :], sk[x][None, :, :], rule)
                  for y in np.split(x, range(step, len(x), step))]
            for some in _clusters(np.concatenate(ok)):
                meet(x[some])
        else:  # sets of adjacent size classes; sizes that link are at most one class apart
            klass = rule.size_class(n[x])
            for c in np.unique(klass).tolist():
                some = x[(klass == c) | (klass == c + 1)]
                if len(some) > 1:
                    meet(some)
    return np.concatenate(group).astype(np.int64), np.concatenate(member).astype(np.int64)


def _place(*cols: str):
    return F.pmod(F.xxhash64(*cols), F.lit(PLACES))


def _parted(rows: DataFrame, keys: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among ``keys``, and the rest. At most PLACES places are broadcast
    however many keys there are; a key that shares a place with one of them counts as one."""
    places = F.broadcast(keys.select(_place(*cols).alias("__place")).distinct())
    same = _place(*cols) == F.col("__place")
    return rows.join(places, same, "left_semi"), rows.join(places, same, "left_anti")


def _blocks(rows: DataFrame, nb: Column, by: str) -> DataFrame:
    """Rows in the tiles (t1, t2) of ``nb`` hash blocks: any two rows meet in a tile."""
    return rows.withColumn("__b", F.pmod(F.xxhash64(by), nb).cast("int")) \
        .withColumn("__o", F.explode(F.sequence(F.lit(0), nb - 1))) \
        .withColumn("t1", F.least("__b", "__o")).withColumn("t2", F.greatest("__b", "__o")).drop("__b", "__o")


def _tiled(entries: DataFrame, rule: Rule) -> DataFrame:
    """``entries`` plus ``tile``: 0, or for lists beyond LIST_BLOCK rows the pair of adjacent size
    classes and of hash blocks. ``e`` then names the tile of the list."""
    # sums over places bound the lists' sizes; only lists in heavy places are counted one by one
    heavy = entries.groupBy(_place("e").alias("__at")).count().where(F.col("count") > LIST_BLOCK).select("__at")
    heavy = materialize(heavy, "jaccard-places")
    if heavy.isEmpty():
        return entries.withColumn("tile", F.lit(0).cast("long"))
    long = entries.join(F.broadcast(heavy), _place("e") == F.col("__at"), "left_semi") \
        .groupBy("e").count().where(F.col("count") > LIST_BLOCK).select("e")
    some, rest = _parted(entries, materialize(long, "jaccard-lists"), ["e"])
    klass = F.floor(F.log("n") / F.lit(math.log(rule.den / rule.num) * 1.0001))
    some = some.withColumn("k", F.explode(F.array(klass - 1, klass)))  # with the class above and the one below
    sized = some.groupBy("e", "k").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("nb")).where("nb > 1")
    some = some.join(sized, ["e", "k"], "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    some = _blocks(some, F.col("nb"), "d").withColumn("tile", F.xxhash64("k", "nb", "t1", "t2")) \
        .withColumn("e", F.xxhash64("e", "tile")).select(*entries.columns, "tile")
    return rest.withColumn("tile", F.lit(0).cast("long")).unionByName(some)


def _groups(entries: DataFrame, partitions: int, rule: Rule) -> DataFrame:
    """Distinct (g, gs, d, sk): members of candidate groups, named by a member's digest and sketch
    (and the tile of a long list)."""
    dealt = _tiled(entries, rule).repartition(partitions, "e", "tile").sortWithinPartitions("e", "tile", "n", "p", "d")
    kind = pa.schema([("g", pa.int64()), ("gs", pa.binary()), ("d", pa.int64()), ("sk", pa.binary())])

    def columns(b: pa.RecordBatch) -> list[np.ndarray]:
        sk = b.column(2)
        flat = np.frombuffer(b"".join(sk.to_pylist()), np.uint8).reshape(-1, 16)
        return [b.column(0).to_numpy(), b.column(1).to_numpy(), flat, b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy().astype(np.int64),
                b.column(5).to_numpy()]

    def emit(part: list[np.ndarray], seen: set) -> pa.RecordBatch | None:
        *part, tile = part
        group, member = _meetings(*part, rule)
        d, sk = part[1], part[2]
        new = []
        for g, m in dict.fromkeys(zip(group.tolist(), member.tolist(), strict=True)):
            label = tile[g].tobytes() if tile[g] else b""
            key = (int(d[g]), sk[g].tobytes() + label, int(d[m]), sk[m].tobytes())
            if key not in seen:
                seen.add(key)
                new.append(key)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in new], f.type) for i, f in enumerate(kind)], schema=kind) if new else None

    def joined(held: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held: list[list[np.ndarray]] = []  # parts of the last list, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            now = columns(b)
            if held and now[0][-1] == held[0][0][0]:
                held.append(now)
                continue
            now = joined([*held, now])
            last = int(np.searchsorted(now[0], now[0][-1]))
            if last and (out := emit([x[:last] for x in now], seen)) is not None:
                yield out
            held = [[x[last:] for x in now]]
            if len(seen) > 200_000:
                seen = set()
        if held and (out := emit(joined(held), seen)) is not None:
            yield out

    return dealt.mapInArrow(run, "g long, gs binary, d long, sk binary").distinct()


def _narrowed(groups: DataFrame, candidates: DataFrame, partitions: int, rule: Rule) -> DataFrame:
    """(g, gs, d, sk, n): groups without the members whose wide sketch rules out every other
    member, parted where no sketch allows a link. Groups beyond GROUP_BLOCK members stay as they
    are and never come together here."""
    large = materialize(groups.groupBy("g", "gs").count().where(F.col("count") > GROUP_BLOCK).select("g", "gs"), "jaccard-large")
    asis, small = _parted(groups, large, ["g", "gs"])
    asis = asis.join(candidates.select("d", "sk", "n"), ["d", "sk"]).select("g", "gs", "d", "sk", "n")
    members = small.join(candidates.select("d", "sk", "n", "wide"), ["d", "sk"])
    dealt = members.repartition(partitions, "g", "gs").sortWithinPartitions("g", "gs", "d", "sk").select("g", "gs", "d", "sk", "n", "wide")
    kind = pa.schema([("g", pa.int64()), ("gs", pa.binary()), ("d", pa.int64()), ("sk", pa.binary()), ("n", pa.int32())])

    def part(rows: list[tuple]) -> list[tuple]:
        if len(rows) < 2:
            return []
        n = np.array([r[4] for r in rows], np.int64)
        wide = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1)
        ok = np.array([may_link(n, 0, wide, n[i], 0, wide[i], rule) for i in range(len(rows))])
        return [(rows[c[0]][2], rows[c[0]][3], *rows[i][2:5]) for c in _clusters(ok) for i in c.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if row[:2] != now:
                    out += part(held)
                    now, held = row[:2], []
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kind)], schema=kind)
        if out := part(held):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kind)], schema=kind)

    return dealt.mapInArrow(run, "g long, gs binary, d long, sk binary, n int").distinct().unionByName(asis)


def _filtered(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id may be among ``ids`` (a hash of it is): the bit set is a table of at most
    FILTER_BITS / 64 words however many ids there are, so it can always be broadcast. More ids
    only let more rows through; the join that follows decides."""
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) % 64 as int))")
    words = ids.select(F.floor(place / 64).alias("__w"), bit.alias("b")).groupBy("__w").agg(F.bit_or("b").alias("__bits"))
    return rows.join(F.broadcast(words), F.floor(place / 64) == F.col("__w")) \
        .where(F.col("__bits").bitwiseAND(bit) != 0).select(*rows.columns)


def _verified(groups: DataFrame, candidates: DataFrame, rows: DataFrame, partitions: int, rule: Rule) -> DataFrame:
    """Distinct (a, b): a spanning forest of the links of each group, as document ids.

    ``candidates``: (d, sk, id) of the sets in groups; ``rows``: (id, t) of all documents."""
    tiles = F.greatest(F.ceil(F.count("*") / GROUP_BLOCK), F.ceil(F.sum("n") / GROUP_ELEMENTS)).cast("int")
    sized = groups.groupBy("g", "gs").agg(tiles.alias("nb")).where("nb > 1")
    members = groups.join(sized, ["g", "gs"], "left").withColumn("nb", F.coalesce("nb", F.lit(1))).join(candidates, ["d", "sk"])
    members = _blocks(members, F.col("nb"), "d").select("id", "d", "g", "gs", "t1", "t2")
    with_text = _filtered(rows, candidates.select("id")).join(members, "id")
    key = ["g", "gs", "t1", "t2"]
    dealt = with_text.repartition(partitions, *key).sortWithinPartitions(*key, "id")
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def answer(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch | None:
        found = links(sets, rule) if len(sets) > 1 else []
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array([ids[x] for x, _ in found], pa.int64()), pa.array([ids[y] for _, y in found], pa.int64())], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = rule.shingler()
        now, ids, sets = None, [], []
        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in key), strict=True)
            for k, i, d, t in zip(keys, b.column("id").to_pylist(), b.column("d").to_pylist(), raw_texts(b.column("t")), strict=True):
                if k != now:
                    if (out := answer(ids, sets)) is not None:
                        yield out
                    now, ids, sets = k, [], []
                s = shingler.of(t)
                if digest(s) == d:  # another text under a repeated id is not meant
                    ids.append(i)
                    sets.append(s)
        if (out := answer(ids, sets)) is not None:
            yield out

    return dealt.select("id", "d", "t", *key).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex reachable from each vertex of the edges (a, b).

    Alternating star contractions: every vertex is linked to the least vertex around it, first
    from the side of its larger neighbours, then of its smaller ones, until nothing changes.
    Each round is a written table; a vertex of any degree is aggregated, never gathered.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        # large star: larger neighbours and the vertex itself point to the least neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and the vertex point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                                F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")) \
            .select("x.u", "x.v").where("u <> v").distinct()
        new = materialize(small, "links")
        same = new.join(now, ["u", "v"], "left_semi").count()
        if same == new.count() == now.count():
            break
        now = new
    return now.select(F.col("u").alias("v"), F.col("v").alias("c")).unionByName(now.select("v", F.col("v").alias("c"))).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = CONTRACT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) per document.

    Null and empty texts have no set and are their own component. Rows with a null id link
    with nothing and have a null component. Repeated rows keep their rows and share one
    component; a doc_id that stands for several texts joins their components. An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    first = materialize(_first_pass(rows, rule), "jaccard-sets")
    sets = first.where("kind = 0").select("id", "n", "d", "sk")
    often = first.where("kind = 1").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(HOT_MOST).toPandas()
    element = often["d"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(element)
    hot = (element[order], often["n"].to_numpy()[order])
    named = first.where("kind = 0 AND n > 0 AND id IS NOT NULL")
    reps = named.groupBy("d", "sk").agg(F.min("id").alias("id"))
    entries = materialize(_entries(rows.select("t"), hot, rule), "jaccard-entries")
    groups = materialize(_groups(entries, partitions, rule), "jaccard-groups")
    candidates = materialize(named.join(groups.select("d", "sk").distinct(), ["d", "sk"], "left_semi").groupBy("d", "sk")
                             .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("wide").alias("wide")), "jaccard-candidates")
    groups = materialize(_narrowed(groups, candidates, partitions, rule), "jaccard-narrowed")
    candidates = materialize(candidates.select("d", "sk", "id").join(groups.select("d", "sk").distinct(), ["d", "sk"], "left_semi"), "jaccard-members")
    found = _verified(groups, candidates, rows.where("id IS NOT NULL"), partitions, rule)
    # documents with equal sets hang together through the representative
    same = sets.where("n > 0 AND id IS NOT NULL").select("id", "d", "sk")
    repeated = same.groupBy("id").agg(F.count_distinct("d", "sk").alias("k")).where("k > 1").select("id")
    bridges = same.join(repeated, "id").join(reps.withColumnRenamed("id", "r"), ["d", "sk"]).select(F.col("id").alias("a"), F.col("r").alias("b"))
    comp = materialize(components(found.unionByName(bridges)), "jaccard-components")
    classes = reps.join(comp, reps["id"] == comp["v"], "left").select("d", "sk", F.coalesce("c", "id").alias("c"))
    grouped = sets.where("n > 0").join(classes, ["d", "sk"], "left") \
        .select("id", "n", F.when(F.col("id").isNotNull(), F.col("c")).alias("c"))
    alone = sets.where("n = 0").select("id", "n", F.col("id").alias("c"))
    return grouped.unionByName(alone).select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"),
                                             F.col("c").alias("component_id"))
