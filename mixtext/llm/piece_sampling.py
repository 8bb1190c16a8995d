"""SentencePiece encoding and decoding, and segmentations sampled without replacement.

Encoding gives the model's own pieces; decoding gives the text back. Beside the one encoding,
``k`` distinct segmentations of the whole text are drawn by Gumbel top-k:

* The lattice of a text has a node before every character and an edge for every piece. An
  edge's weight falls with the piece's rank (a Zipf law); a path has probability
  proportional to the product of its weights. Backward sums turn weights into the
  probability of each edge at its node, so a walk along edges draws a path.
* A* search over perturbed scores: the set of all paths gets a Gumbel value, the walk gives
  the path that attains it. The other paths part from it at some edge; these parts (one for
  each edge) have known masses, and each gets a Gumbel value that may not exceed its
  parent's. The part with the largest value holds the next path, and so on: paths come out
  in falling order of their perturbed score, which is a sample without replacement.
* With kappa the best value left after k paths, a path of log-probability p had probability
  1 - exp(-exp(p - kappa)) to be included; its logarithm is the inclusion score.

No piece spans a line end, has a space after a character or a closing mark after a letter,
so a text's lattice is a row of small lattices, one per word with its spaces; those are built
once per word and kept, up to a bound: then the words used in most cuts stay. All
random numbers are hashes of (row key, sample, word, step): results do not depend on how
rows are dealt to tasks.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from functools import partial
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixtext.llm.common import Growing, per_worker, portions, release, strings

SPACE = "▁"
LETTER, MARK = "[A-Za-z\u00c0-\u024f]", "[.,!?;:#*$%&|]"
CHUNK = re.compile(f"\n|{SPACE}*{LETTER}+(?={MARK})|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
TWO_WORDS = f"^{SPACE}*{LETTER}+{MARK}"  # a cut at spaces and line ends that is not one word
CACHE_EDGES = 3_000_000  # edges (17 bytes each) of the word lattices a worker keeps; beyond, it drops the third used least
LEARN_WORDS = 2000  # new words whose lattices are built together
BUCKET_BITS = 18  # of a hash, by which the beginnings of pieces are found
SPREAD = np.uint64(0xD6E8FEB86659FD93)  # texts that differ in the last character only get other first bits
JOIN_WORDS = 64  # new words encoded as one text
CUT_BYTES = 1_000_000  # of texts cut into words together
GROUP_BYTES = 125_000  # of texts sampled together
SPARE_EDGES, SPARE_CUT = 1_000_000, 250_000  # CACHE_EDGES and CUT_BYTES beside executors that earlier stages have filled
RANK_OFFSET = 50.0  # a piece of rank r weighs 1 / (r + RANK_OFFSET)
MANY = 1 << 16  # from here on an edge's code is MANY + a code point that is spelt in several byte pieces
MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: uncorrelated 64-bit hashes of counters."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _key(*parts) -> np.ndarray:
    """One hash of several integers or arrays of them."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            out = _mix((np.asarray(p).astype(np.uint64) + out) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return out


def _uniform(keys: np.ndarray, step=0) -> np.ndarray:
    """Numbers in (0, 1), one for each key and step (a number or an array)."""
    with np.errstate(over="ignore"):
        h = _mix(keys + np.asarray(step).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def _utf8_bytes(points: np.ndarray) -> np.ndarray:
    """How many bytes UTF-8 takes for each code point."""
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


class Lattices:
    """The model's pieces and the lattices of the words met so far."""

    def __init__(self, path: str, temperature: float = 1.0, cache: int = CACHE_EDGES):
        import sentencepiece

        self.cache = cache
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
        plain = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.ids = {m.id_to_piece(i): i for i in plain}
        if any(re.search(f"[^{SPACE}]{SPACE}|\n|{LETTER}{MARK}", p) for p in self.ids):
            raise ValueError("a piece spans words, lines or closing marks: word lattices would lose paths")
        if m.get_piece_size() > MANY:
            raise ValueError("ids are packed in 16 bits")
        self.logs = {p: -math.log(r + RANK_OFFSET) / temperature for r, p in enumerate(self.ids)}
        self.byte_log = -math.log(len(self.ids) + RANK_OFFSET) / temperature
        self.longest = max(map(len, self.ids))
        self.surface = [b""] * m.get_piece_size()
        for p, i in self.ids.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.surface[i] = bytes([b])
        self.width = np.array([len(x) for x in self.surface], np.int64)
        if self.longest > 255:
            raise ValueError("pieces' lengths are kept in 8 bits")
        self._index()
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        # room for a full cache and the words of one more cut; memory is only taken as it is filled
        nodes, edges = self.cache // 2, self.cache * 3 // 2
        self.uses = Growing(np.int32)  # in how many cuts of texts a word was met, halved by trim()
        self.pieces = Growing("<u2", nodes)  # encodings of the words, one after another
        self.stop = Growing(np.int32)  # where they end
        self.stop.extend([0])
        self.fits = Growing(bool)  # whether a word's encoding decodes to the word
        self.first = Growing(np.int32)  # word -> its first node
        self.edges = Growing(np.int32, nodes)  # node -> its first edge
        self.log = Growing(np.float64, edges)  # edge -> log of its probability at the node it leaves
        self.upto = Growing(np.float32, edges)  # the probability summed over the node's edges so far
        self.size = Growing(np.uint8, edges)  # edge -> how many nodes on the one it enters is, 0 at the word's end
        self.code = Growing(np.int32, edges)  # edge -> piece id, or MANY + code point

    def trim(self, most: int) -> None:
        """Keep only the words used in most cuts (of these the latest), up to ``most`` edges."""
        n = len(self.number)
        node = np.append(self.first.data[:n], self.edges.n)
        edge = np.append(self.edges.data[:self.edges.n], self.log.n)[node]
        order = np.lexsort((-np.arange(n), -self.uses.data[:n]))
        stay = np.zeros(n, bool)
        stay[order[np.cumsum(np.diff(edge)[order]) <= most]] = True
        self.number = {w: k for k, w in enumerate(compress(self.number, stay.tolist()))}
        nodes, edges, ids = np.diff(node), np.diff(edge), np.diff(self.stop.data[:n + 1])
        self.pieces.keep(np.repeat(stay, ids))
        self.stop.n = 1
        self.stop.extend(np.cumsum(ids[stay]))
        self.edges.keep(np.repeat(stay, nodes))
        self.edges.data[:self.edges.n] += np.repeat(np.cumsum(edges[stay]) - edges[stay] - edge[:-1][stay], nodes[stay]).astype(np.int32)
        each = np.repeat(stay, edges)
        for column in (self.log, self.upto, self.size, self.code):
            column.keep(each)
        for column in (self.uses, self.fits, self.first):
            column.keep(stay)
        self.first.data[:self.first.n] = np.cumsum(nodes[stay]) - nodes[stay]
        self.uses.data[:self.uses.n] //= 2

    def _index(self) -> None:
        """Hashes of all beginnings of pieces, sorted, with the piece that each one is (or -1)."""
        beginnings: dict[str, int] = {}
        for p, i in self.ids.items():
            beginnings[p] = i
            for k in range(1, len(p)):
                beginnings.setdefault(p[:k], -1)
        hashes = np.array([self._hash(p) for p in beginnings], np.uint64)
        order = np.argsort(hashes)
        self.starts = hashes[order]
        if (self.starts[1:] == self.starts[:-1]).any():
            raise ValueError("hashes of piece beginnings collide")
        # above all others, so that every search ends at a place
        self.starts = np.append(self.starts, np.uint64(MASK))
        self.start_piece = np.append(np.array(list(beginnings.values()), np.int64)[order], -1)
        # first bits of a hash -> the first place that may hold it
        self.bucket = np.searchsorted(self.starts, np.arange(1 << BUCKET_BITS).astype(np.uint64) << np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        # code point -> place of the beginning that is this character alone, or -1
        self.alone = np.full(sys.maxunicode + 1, -1, np.int32)
        lone = [p for p in beginnings if len(p) == 1]
        self.byte_id = np.array([self.byte[b] for b in range(256)])
        self.alone[[ord(p) for p in lone]] = np.searchsorted(self.starts, np.array([self._hash(p) for p in lone], np.uint64))
        self.weight = np.zeros(self.model.get_piece_size())
        for p, i in self.ids.items():
            self.weight[i] = self.logs[p]

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * 0x9E3779B97F4A7C15 + ord(c) + 1) & MASK
        return h * int(SPREAD) & MASK

    def _edges(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, code, log weight) of all pieces found in words laid end to end, longer
        and longer beginnings at all places at once. A character that is no piece is spelt in
        bytes."""
        at, h = np.arange(len(points)), np.zeros(len(points), np.uint64)
        found, single = [], np.zeros(len(points), bool)
        for size in range(1, self.longest + 1):
            with np.errstate(over="ignore"):
                h = h * np.uint64(0x9E3779B97F4A7C15) + points[at + size - 1].astype(np.uint64) + np.uint64(1)
            if size == 1:
                place = self.alone[points]
                known = place >= 0
            else:
                with np.errstate(over="ignore"):
                    spread = h * SPREAD
                place = self.bucket[spread >> np.uint64(64 - BUCKET_BITS)]
                there = self.starts[place]
                known = there == spread
                over = np.flatnonzero(there < spread)
                while len(over):
                    place[over] += 1
                    there, want = self.starts[place[over]], spread[over]
                    known[over] = there == want
                    over = over[there < want]
            piece = np.where(known, self.start_piece[place], -1)
            hit = piece >= 0
            found.append((at[hit], at[hit] + size, piece[hit], self.weight[piece[hit]]))
            if size == 1:
                single[at[hit]] = True
            on = known & (at + size < ends[at])
            at, h = at[on], h[on]
            if not len(at):
                break
        spelt = np.flatnonzero(~single)
        codes = points[spelt].astype(np.int64)
        logs = self.byte_log * _utf8_bytes(codes)
        codes = np.where(codes < 0x80, self.byte_id[codes & 0x7F], MANY + codes)
        found.append((spelt, spelt + 1, codes, logs))
        # edges of a node together, long pieces (mostly the likely ones) first
        src, dst, code, log = (np.concatenate(x) for x in zip(*found[::-1], strict=True))
        order = np.argsort(src.astype(np.uint16) if len(points) < 1 << 16 else src, kind="stable")  # 16 bits: radix sort
        return src[order], dst[order], code[order], log[order]

    def learn(self, chunks: list[str]) -> None:
        """Build the lattices and encodings of new words, all at once."""
        self.number.update(zip(chunks, range(len(self.number), len(self.number) + len(chunks)), strict=True))
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        stops = np.cumsum(sizes)
        ends = np.repeat(stops, sizes)
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        self._encode(chunks, points, stops - sizes)
        self.uses.extend(np.zeros(len(chunks), np.int32))
        src, dst, code, log = self._edges(points, ends)
        # backward sums, all nodes at the same distance from their word's end together
        inner, distance = dst < ends[src], ends[src] - src
        order = np.argsort(distance.astype(np.uint16) if sizes.max() < 1 << 16 else distance, kind="stable")
        beta = np.zeros(len(points) + 1)
        near, node_of, into, weight = inner[order], src[order], dst[order], log[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(distance[order])) + 1, [len(src)]]).tolist()
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            score = weight[a:z] + np.where(near[a:z], beta[into[a:z]], 0.0)
            node = node_of[a:z]
            heads = np.concatenate([[0], np.flatnonzero(np.diff(node)) + 1])
            top = np.maximum.reduceat(score, heads)
            each = np.repeat(top, np.diff(np.append(heads, z - a)))
            beta[node[heads]] = top + np.log(np.add.reduceat(np.exp(score - each), heads))
        prob = np.exp(log + np.where(inner, beta[dst], 0.0) - beta[src])
        per_node = np.bincount(src, minlength=len(points))
        begin = np.cumsum(per_node) - per_node
        upto = np.cumsum(prob)
        upto -= np.repeat(upto[begin] - prob[begin], per_node)
        upto[begin + per_node - 1] = 1.0
        nodes, edges = self.edges.n, self.log.n
        self.first.extend(nodes + stops - sizes)
        self.edges.extend(edges + begin)
        self.upto.extend(upto)
        self.size.extend(np.where(inner, dst - src, 0))
        self.code.extend(code)
        single = per_node[src] == 1
        with np.errstate(divide="ignore"):
            self.log.extend(np.where(single, 0.0, np.log(prob)))

    def origin(self, edge: int) -> int:
        """The node an edge leaves."""
        return int(np.searchsorted(self.edges.data[:self.edges.n], np.int32(edge), "right")) - 1

    def _encode(self, chunks: list[str], points: np.ndarray, begin: np.ndarray) -> None:
        """The model's encodings of new words (laid end to end as ``points``, each from its
        ``begin`` on), and whether they decode to the words."""
        # the model would put a space before a word; behind a line end it does not. No piece
        # spans a line end, so words with one between them are encoded together
        shown = [c.replace(SPACE, " ") for c in chunks] if "\n" in chunks else "\n".join(chunks).replace(SPACE, " ").split("\n")
        got = self.model.encode(["\n" + "\n".join(shown[a:a + JOIN_WORDS]) for a in range(0, len(shown), JOIN_WORDS)] if "\n" not in chunks else ["\n" + c for c in shown], num_threads=1)
        lens = np.fromiter(map(len, got), np.int64, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.int64, int(lens.sum()))
        keep = np.ones(len(ids), bool)
        keep[np.cumsum(lens) - lens] = False  # the space before the first line end
        ids = ids[keep]
        if "\n" in chunks:
            heads = np.cumsum(lens - 1) - (lens - 1)
        else:
            heads = np.flatnonzero(ids == self.byte[10])
        lens = np.diff(np.append(heads, len(ids))) - 1
        ids = np.delete(ids, heads)
        self.pieces.extend(ids)
        self.stop.extend(self.stop.data[self.stop.n - 1] + np.cumsum(lens))
        # equal bytes word by word: equal lengths, and equal when laid end to end
        want = np.add.reduceat(np.where(points == ord(SPACE), 1, _utf8_bytes(points)), begin)
        sizes = np.concatenate([[0], np.cumsum(self.width[ids])])
        stops = np.cumsum(lens)
        fits = sizes[stops] - sizes[stops - lens] == want
        if not fits.all() or b"".join(map(self.surface.__getitem__, ids.tolist())) != "".join(shown).encode():
            each = np.split(ids, stops[:-1])
            fits = [b"".join([self.surface[i] for i in x.tolist()]) == w.encode() for x, w in zip(each, shown, strict=True)]
        self.fits.extend(fits)

    def encoded(self, numbers: np.ndarray) -> np.ndarray:
        """The encodings of words, one after another."""
        last = self.stop.data[numbers + 1]
        first = self.stop.data[numbers]
        lens = (last - first).astype(np.int64)
        offset = np.cumsum(lens) - lens
        return self.pieces.data[np.repeat(first - offset, lens) + np.arange(int(lens.sum()))]

    def numbers(self, texts: pa.Array) -> list[np.ndarray]:
        """The word numbers of each text. Texts are cut at spaces and line ends and their cuts
        encoded as a dictionary in Arrow, so that Python sees each distinct cut once."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        mark = next(c for c in map(chr, range(0xD800)) if c not in (" ", "\n", SPACE) and not pc.any(pc.match_substring(texts, c)).as_py())
        none, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        shown = pc.if_else(pc.equal(pc.binary_length(texts), 0), none, pc.binary_join_element_wise(space, texts, none))
        shown = pc.replace_substring(pc.replace_substring(shown, " ", SPACE), "\n", f"{mark}\n{mark}")
        shown = pc.replace_substring(shown, SPACE, mark + SPACE)
        while pc.any(pc.match_substring(shown, SPACE + mark + SPACE)).as_py():  # runs of spaces stay together
            shown = pc.replace_substring(shown, SPACE + mark + SPACE, SPACE + SPACE)
        cuts = pc.split_pattern(shown, mark)
        flat = pc.cast(cuts.flatten(), pa.large_string()).dictionary_encode()
        index = flat.indices.to_numpy(zero_copy_only=False)
        distinct = strings(flat.dictionary, mark)
        # the words of each distinct cut: most are one word, the empty one none. ``words`` holds
        # the first words of all cuts, then the further ones
        two = np.flatnonzero(pc.match_substring_regex(flat.dictionary, TWO_WORDS).to_numpy(zero_copy_only=False))
        split = [CHUNK.findall(distinct[i]) for i in two.tolist()]
        each = (pc.binary_length(flat.dictionary).to_numpy(zero_copy_only=False) > 0).astype(np.int64)
        each[two] = np.fromiter(map(len, split), np.int64, len(split))
        words = distinct
        for i, x in zip(two.tolist(), split, strict=True):
            words[i] = x[0]
        words = list(filter(None, words))
        heads = len(words)
        words.extend(chain.from_iterable([x[1:] for x in split]))
        some = list(set(words).difference(self.number))
        for a in range(0, len(some), LEARN_WORDS):  # a slice's working arrays take some 8 MB
            self.learn(some[a:a + LEARN_WORDS])
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.uses.data[found] += 1  # once a cut: a repeated index counts once
        first = np.cumsum(each) - each
        known = np.empty(len(words), np.int64)
        head = np.zeros(len(words), bool)
        head[first[each > 0]] = True
        known[head], known[~head] = found[:heads], found[heads:]
        sizes = each[index]
        upto = np.cumsum(sizes)
        out = known[np.repeat(first[index] - upto + sizes, sizes) + np.arange(int(sizes.sum()))]
        ends = np.concatenate([[0], upto])[cuts.offsets.to_numpy()[1:] - cuts.offsets[0].as_py()]
        return np.split(out, ends[:-1]) if len(ends) else []

    def walk(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path from each node to its word's end: (edges per path, all edges in order)."""
        size, upto, start = self.size.data, self.upto.data, self.edges.data
        counts = np.zeros(len(nodes), np.int64)
        active, at, steps = np.arange(len(nodes)), nodes, []
        while len(active):
            u = _uniform(keys[active], len(steps))
            e = start[at]
            over = np.flatnonzero(u > upto[e])
            while len(over):
                e[over] += 1
                over = over[u[over] > upto[e[over]]]
            steps.append((active, e))
            counts[active] += 1
            on = size[e]
            at = at + on
            on = on > 0
            active, at = active[on], at[on]
        offset = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(offset[-1], np.int64)
        for k, (who, e) in enumerate(steps):
            out[offset[who] + k] = e
        return counts, out

    def pack(self, edges: np.ndarray) -> bytes:
        codes = self.code.data[edges]
        if len(codes) and codes.max() >= MANY:
            return np.array([i for c in codes.tolist() for i in ([self.byte[b] for b in chr(c - MANY).encode()] if c >= MANY else (c,))], "<u2").tobytes()
        return codes.astype("<u2").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of piece ids (as the model decodes it)."""
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return (data[1:] if data.startswith(b" ") else data).decode("utf-8", "replace")


class Path:
    """One drawn segmentation of a text and the parts of the path space that hang on it."""

    __slots__ = ("edges", "words", "log_prob", "value", "arrivals", "used")

    def __init__(self, edges, words, log_prob, value, arrivals, used):
        self.edges, self.words, self.log_prob, self.value = edges, words, log_prob, value
        self.arrivals = arrivals  # per edge: of the paths that part there, see _parts
        self.used = used  # {edge position: edges already taken there}


def _parts(lat: Lattices, edges: np.ndarray, offsets: np.ndarray, keys: np.ndarray,
           begin: np.ndarray, taken: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-probability of each path, -log of each part's unbounded Gumbel arrival) for paths
    laid end to end. The Gumbel value of a part with arrival t under a parent of value v is
    -logaddexp(-v, t), so within a path the least arrival is the largest value.

    Parts before ``begin`` belong to an earlier path. At ``begin``, ``taken`` is the
    probability of the edges already used and ``left`` tells whether any other is left.
    """
    n = np.diff(offsets)
    logs = lat.log.data[edges]
    with np.errstate(divide="ignore"):
        mass = np.log1p(-np.minimum(np.exp(logs), 1.0))  # of the node's other edges
    # text by text, so that rounding does not depend on what a text is sampled with
    sums = [np.cumsum(logs[a:z]) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
    before = np.concatenate(sums) - logs if sums else logs
    total = np.array([x[-1] if len(x) else 0.0 for x in sums])
    place = np.arange(len(edges)) - np.repeat(offsets[:-1], n)
    mass += before
    for d in np.flatnonzero((taken > 0) & (n > 0)).tolist():
        x = offsets[d] + begin[d]
        mass[offsets[d]:x] = -np.inf
        mass[x] = before[x] + np.log1p(-min(taken[d], 1.0)) if left[d] else -np.inf
    arrival = np.log(-np.log(_uniform(np.repeat(_key(keys), n), place))) - mass
    return total, arrival


def _best(path: Path) -> tuple[float, int]:
    """The largest Gumbel value among a path's parts, and where it parts."""
    if not len(path.arrivals):
        return -math.inf, -1
    at = int(np.argmin(path.arrivals))
    return -float(np.logaddexp(-path.value, path.arrivals[at])), at


def sample(lat: Lattices, numbers: list[np.ndarray], seeds: np.ndarray, k: int) -> list[tuple[list[Path], float]]:
    """Per text (its word numbers): up to ``k`` paths by falling perturbed score, and kappa
    (-inf if no path is left)."""
    first = lat.first.data
    heads = [first[x] for x in numbers]

    def lay(chosen: list[int], starts: list[np.ndarray], at: list[np.ndarray], j: int):
        """Walk from the given nodes; word numbers ``at`` key the draws."""
        sizes = np.array([len(s) for s in starts])
        keys = _key(np.repeat(seeds[chosen], sizes), j, np.concatenate(at) if at else np.zeros(0, np.int64))
        counts, edges = lat.walk(np.concatenate(starts) if starts else np.zeros(0, np.int64), keys)
        words = np.repeat(np.concatenate(at) if at else np.zeros(0, np.int64), counts)
        cut = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
        return edges, words, cut

    everyone = list(range(len(numbers)))
    edges, words, cut = lay(everyone, heads, [np.arange(len(h)) for h in heads], 0)
    root = -np.log(-np.log(_uniform(_key(seeds, 0, -1 & MASK))))
    none = np.zeros(len(numbers), np.int64)
    total, arrival = _parts(lat, edges, cut, _key(seeds, 0, -2 & MASK), none, none.astype(float), none.astype(bool))
    paths = [[Path(edges[a:z], words[a:z], float(total[d]), float(root[d]), arrival[a:z], {})]
             for d, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
    tops = [[_best(p[0])] for p in paths]
    for j in range(1, k):
        chosen, fronts, starts, at, plans = [], [], [], [], []
        for d in everyone:
            best = max(range(len(tops[d])), key=lambda x: tops[d][x][0])
            value, t = tops[d][best]
            if value == -math.inf:
                continue
            parent = paths[d][best]
            used = parent.used.get(t, ()) + (int(parent.edges[t]),) if int(parent.edges[t]) not in parent.used.get(t, ()) else parent.used[t]
            parent.arrivals[t] = np.inf
            tops[d][best] = _best(parent)
            node = lat.origin(int(parent.edges[t]))
            end = int(lat.edges.data[node + 1]) if node + 1 < lat.edges.n else lat.log.n
            others = [e for e in range(int(lat.edges.data[node]), end) if e not in used]
            weights = np.exp(lat.log.data[others])
            u = float(_uniform(_key(seeds[d], j, -3 & MASK))) * float(weights.sum())
            pick = others[min(int(np.searchsorted(np.cumsum(weights), u)), len(others) - 1)]
            w = int(parent.words[t])
            rest = node + int(lat.size.data[pick]) if lat.size.data[pick] else -1
            chosen.append(d)
            fronts.append((np.append(parent.edges[:t], pick), np.append(parent.words[:t], w)))
            starts.append(np.concatenate([[rest], heads[d][w + 1:]]) if rest >= 0 else heads[d][w + 1:])
            at.append(np.arange(w if rest >= 0 else w + 1, len(heads[d])))
            plans.append((value, t, used + (pick,), len(others) > 1))
        if not chosen:
            break
        edges, words, cut = lay(chosen, starts, at, j)
        whole = [(np.concatenate([f[0], edges[a:z]]), np.concatenate([f[1], words[a:z]]))
                 for f, a, z in zip(fronts, cut[:-1], cut[1:], strict=True)]
        offsets = np.concatenate([[0], np.cumsum([len(e) for e, _ in whole])])
        taken = np.array([np.exp(lat.log.data[list(p[2])]).sum() for p in plans])
        total, arrival = _parts(lat, np.concatenate([e for e, _ in whole]), offsets, _key(seeds[chosen], j, -2 & MASK),
                              np.array([p[1] for p in plans]), taken, np.array([p[3] for p in plans]))
        for x, d in enumerate(chosen):
            value, t, used, _ = plans[x]
            path = Path(whole[x][0], whole[x][1], float(total[x]), value, arrival[offsets[x]:offsets[x + 1]].copy(), {t: used})
            paths[d].append(path)
            tops[d].append(_best(path))
    return [(paths[d], max(t[0] for t in tops[d])) for d in everyone]


def inclusion(log_prob: float, kappa: float) -> float:
    """log(1 - exp(-exp(log_prob - kappa))); 0 when every path is in the sample."""
    x = log_prob - kappa
    if x > 30:
        return 0.0
    return x if x < -30 else math.log(-math.expm1(-math.exp(x)))


SAMPLED = ("struct<ids:binary,n_ids:int,round_trip:boolean,"
           "samples:array<struct<ids:binary,n_ids:int,log_prob:double,perturbed:double,log_inclusion:double>>>")
_SAMPLE = pa.struct([("ids", pa.binary()), ("n_ids", pa.int32()), ("log_prob", pa.float64()), ("perturbed", pa.float64()),
                     ("log_inclusion", pa.float64())])
_ROW = pa.struct([("ids", pa.binary()), ("n_ids", pa.int32()), ("round_trip", pa.bool_()), ("samples", pa.list_(_SAMPLE))])


def encode_group(lat: Lattices, texts: list[str], seeds: np.ndarray, k: int, numbers: list[np.ndarray] | None = None) -> list[dict]:
    """The rows of texts, sampled together; ``numbers``: their word numbers, where known."""
    out = []
    numbers = lat.numbers(pa.array(texts, pa.string())) if numbers is None else numbers
    for text, number, (paths, kappa) in zip(texts, numbers, sample(lat, numbers, seeds, k), strict=True):
        ids = lat.encoded(number).tobytes()
        samples = []
        for p in paths:
            packed = lat.pack(p.edges)
            samples.append({"ids": packed, "n_ids": len(packed) // 2, "log_prob": p.log_prob, "perturbed": p.value,
                            "log_inclusion": inclusion(p.log_prob, kappa)})
        out.append({"ids": ids, "n_ids": len(ids) // 2, "round_trip": SPACE not in text and bool(lat.fits.data[number].all()), "samples": samples})
    return out


def pieces(docs: DataFrame, model: str, k: int = 2, id_col: str = "doc_id", text_col: str = "text",
           spare: bool = False) -> DataFrame:
    """``docs`` plus ``pieces``: the encoding (ids packed as little-endian uint16), whether it
    decodes to the text, and up to ``k`` sampled segmentations.

    Null text counts as empty: no ids and one empty segmentation, surely included. A text
    with fewer than ``k`` segmentations gives them all, each with log_inclusion 0. Rows with
    the same id and text give the same samples; null ids share one key. A text that holds the
    space mark U+2581 itself decodes to spaces, so its round_trip is false. A column of
    ``docs`` named ``pieces`` is replaced. ``spare``: workers hold less, for more time; the
    rows are the same.
    """
    cache, cut = (SPARE_EDGES, SPARE_CUT) if spare else (CACHE_EDGES, CUT_BYTES)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, key in batches:
            lat = per_worker(f"lattices:{model}:{cache}", partial(Lattices, model, cache=cache))
            seeds = key.to_numpy(zero_copy_only=False).astype(np.uint64)
            sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            for a, z in portions(sizes, cut):
                if lat.log.n > cache:
                    lat.trim(cache * 2 // 3)
                numbers = lat.numbers(text[a:z])
                if spare:
                    release()
                for b, y in portions(sizes[a:z], GROUP_BYTES):
                    group = [t or "" for t in text[a + b:a + y].to_pylist()]
                    # handed on at once: a batch's samples outweigh its texts
                    yield pa.array(encode_group(lat, group, seeds[a + b:a + y], k, numbers[b:y]), _ROW)
            text = key = numbers = group = None  # not held while the next batch is read

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, SAMPLED).asNondeterministic()
    return docs.withColumn("pieces", udf(F.col(text_col), F.xxhash64(F.col(id_col))))


def decoded(ids: Column, model: str) -> Column:
    """The text of packed piece ids; null stays null."""
    def run(column: pa.Array) -> pa.Array:
        lat = per_worker(f"lattices:{model}:{CACHE_EDGES}", partial(Lattices, model))
        return pa.array([None if x is None else lat.decode(np.frombuffer(x, "<u2")) for x in column.to_pylist()], pa.string())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(ids)
