"""N-gram Jaccard join by set relations.

Documents become sets of hashed word shingles. Equal sets are one class from the start; the join is
over classes.

1. Sets of like size have at most d shingles that only one of two linked sets has. So a set is cut, by
   hash, into d + r parts (r = d / 4 + 6): two linked sets have r parts or more that are equal as a whole.
   A class posts the hash of each part that isn't empty (and, if r or more are, that it has so many).
2. With e empty parts r - e are shared and posted, so a class may drop the r - e - 1 of its posts with the
   longest lists, and linked sets still share one. Parts made of common lines or passages alone leave
   the lists so.
3. Classes that post the same part are paired if they are ``FEW`` at most, else tied to the first of them (the
   lists of common parts are dealt to pieces, whose firsts are tied to the first of all). A pair stays if the two sets' sketches allow a link: a sketch has a bit for the parity of
   each of 64, 128, ... hash buckets, so that sketches never differ more than sets do. What stays makes
   candidate blocks (components over pairs and ties). Whole texts are fetched for candidates only, each
   to its block; a block over ``BLOCK`` shingles is cut by size and every pair of cuts whose sizes allow a
   link is compared.
4. In a block an index over rare shingles is read in order of size: list entries whose size or
   position rules a link out are skipped as blocks of the list. What a similar set's comparisons have
   shown bounds the next set's overlaps: links are found or ruled out so, and only pairs between the
   bounds are compared. ``counted`` and ``pairs`` find every link; a task counts the links of each of its
   sets and hands on a forest of them. ``join`` and ``one_of_each`` give components alone, and don't compare
   sets already connected.

Links are exact: 100 * intersection >= percent * union, on 64-bit shingle hashes.

Defined cases: null, empty and blank texts have no shingle, size 0, no link, and are their own
component; a text with fewer words than a shingle has its whole sequence as the only one; ids are whole
numbers; rows that share an id are told apart by their texts, so each has the component of its own
text, and a component's id is its smallest id; a very long text is one set, compared whole; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.llm.bpe import groups
from brindle.llm.common import bounded_batches, remove, scratch, settle, whole
from brindle.llm.components import components

#: Shingles, and sets, that are compared together, on either side.
BLOCK, SETS = 1_000_000, 1_000
#: Posts of a common part that a task holds, about; the share of texts that shows which parts are common, as
#: one in so many; parts that are treated so, at most.
LIST, SAMPLE, MOST_COMMON = 256, 16, 50_000
#: Classes with the same part that are paired; more are tied to the first.
FEW = 6
#: Sets of a block whose overlaps with all others are kept, to bound those of similar sets.
LEADERS = 8

_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes (int64) of each text."""
    out: list[np.ndarray] = []
    for part in groups(texts):
        raw = [t.encode() + b" " for t in part]
        c = _LOWER[np.frombuffer(b" " + b"".join(raw), np.uint8)]
        gap = _GAP[c]
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(len(c), _BASE, np.uint64))
            down = np.cumprod(np.full(len(c), _BACK, np.uint64))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * up)])
            edge = np.diff(gap.astype(np.int8))
            begin, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
            word = _mix((total[end] - total[begin]) * down[begin])
            ends = np.cumsum([1] + [len(r) for r in raw])[1:]
            last = np.searchsorted(begin, ends)
            m = max(0, len(word) - words + 1)
            run = np.zeros(m, np.uint64)
            for k in range(words):
                run = run * np.uint64(0x100000001B3) + word[k : k + m]
            run = _mix(run + np.uint64(words)).view(np.int64)
            at = 0
            for stop in last:
                n = stop - at
                if n >= words:
                    out.append(np.unique(run[at : stop - words + 1]))
                elif n:
                    h = np.uint64(0)
                    for w in word[at:stop]:
                        h = h * np.uint64(0x100000001B3) + w
                    out.append(_mix(np.array([h + np.uint64(n)])).view(np.int64))
                else:
                    out.append(np.zeros(0, np.int64))
                at = stop
    return out


def lacking(n: int, percent: int) -> int:
    """How many of ``n`` shingles a linked set may lack."""
    return n - -(-percent * n // 100)


def size_class(n: int) -> tuple[int, int]:
    """First size of the class of ``n``, and of the class after it; classes grow by half."""
    low = 1
    while (high := max(low + 1, -(-3 * low // 2))) <= n:
        low = high
    return low, high


def shared_parts(unlike: int) -> int:
    """How many parts linked sets have in common, at least: a quarter of what may be unlike, and a few."""
    return unlike // 4 + 6


def parts(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """For the set's own class of sizes, and for each later one in which it has partners: how many posts
    may be dropped, and the hashes of the parts."""
    n, found = len(s), []
    if not n:
        return found
    u = s.view(np.uint64)
    first, after = size_class(n)
    firsts = [first]
    while after * percent <= 100 * n:
        firsts.append(after)
        after = size_class(after)[1]
    with np.errstate(over="ignore"):
        spread = _mix(u)
        for first in firsts:
            most = size_class(first)[1] - 1
            unlike = 2 * most * (100 - percent) // (100 + percent)
            if not unlike:
                continue  # linked sets are equal, and one class already
            shared = shared_parts(unlike)
            k = unlike + shared
            at = ((u >> np.uint64(17)) % np.uint64(k)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            filled, begin = np.unique(at[order], return_index=True)
            hashes = _mix(np.add.reduceat(spread[order], begin) + _mix(filled.astype(np.uint64) + np.uint64(first << 20)))
            empty = k - len(filled)
            if empty >= shared:
                hashes = np.append(hashes, _mix(np.array([first << 20 | 0xFFFFF], np.uint64)))
            found.append((max(0, shared - 1 - empty), hashes.view(np.int64)))
    return found


def sketch(s: np.ndarray) -> bytes:
    """Parities of hash buckets, as many (a power of two, 64 at least) as the set has shingles, or more."""
    bits = max(64, 1 << max(0, len(s) - 1).bit_length())
    at = (_mix_of(s) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1).tobytes()


def _mix_of(s: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(s.view(np.uint64))


def apart(a: bytes, b: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded: at most as the sets do."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    folded = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(folded ^ x).sum())


class Block:
    """Compares the sets of a block; ``every`` gives all links, ``links`` a forest over its components."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int, side: list[int] | None = None):
        order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
        self.ids, self.sets = [ids[i] for i in order], [sets[i] for i in order]
        self.side = np.array([side[i] if side else 0 for i in order])
        self.across = side is not None
        self.percent = percent
        self.size = np.array([len(s) for s in self.sets])
        self.compared = self.derived = 0
        self.leaders: dict[int, np.ndarray] = {}

    def _prefixes(self) -> list[np.ndarray]:
        """Each set's prefix in order of the block's own frequencies, as ranks."""
        every = np.concatenate(self.sets)
        names, at, count = np.unique(every, return_inverse=True, return_counts=True)
        rank = np.empty(len(names), np.int64)
        rank[np.lexsort((names, count))] = np.arange(len(names))
        self.single = int((count == 1).sum())
        ranks, out, begin = rank[at], [], 0
        self.ranks, self.begin = ranks, np.concatenate([np.zeros(1, np.int64), np.cumsum(self.size)])
        for n in self.size:
            r = ranks[begin : begin + n]
            out.append(np.sort(r)[: lacking(n, self.percent) + 1])
            begin += n
        return out

    def needed(self, i: int, j: np.ndarray) -> np.ndarray:
        """Smallest overlap of a link: 100 o >= p (n + m - o)."""
        return -(-self.percent * (self.size[i] + self.size[j]) // (100 + self.percent))

    def overlaps(self, i: int, j: np.ndarray) -> np.ndarray:
        """Overlaps of set ``i`` with each of ``j``."""
        if not len(j):
            return np.zeros(0, np.int64)
        self.compared += len(j)
        self.mark[self.ranks[self.begin[i] : self.begin[i + 1]]] = True
        ends = np.cumsum(self.size[j])
        starts = ends - self.size[j]
        at = np.repeat(self.begin[j] - starts, self.size[j]) + np.arange(ends[-1])
        found = np.add.reduceat(self.mark[self.ranks[at]], starts, dtype=np.int64)
        self.mark[self.ranks[self.begin[i] : self.begin[i + 1]]] = False
        return found

    def probes(self) -> Iterator[tuple[int, np.ndarray]]:
        """A set and those before it, in order of size, that share a token of their prefixes at places and in
        sizes that allow a link. Lists of a token are runs of one array; entries that rule a link out are skipped."""
        prefixes = self._prefixes()
        self.mark = np.zeros(int(self.ranks.max()) + 1 if len(self.ranks) else 0, bool)
        length = np.array([len(p) for p in prefixes], np.int64)
        token, owner = np.concatenate(prefixes), np.repeat(np.arange(len(prefixes)), length)
        place = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
        order = np.lexsort((owner, token))
        spot = np.empty(len(order), np.int64)  # of a post, in the lists
        spot[order] = np.arange(len(order))
        top = np.searchsorted(token[order], token)  # where its list begins
        shared, owners, places = token >= self.single, owner[order], place[order]
        last = np.cumsum(length)
        for i, n in enumerate(self.size):
            mine = slice(last[i] - length[i], last[i])
            use = shared[mine] & (spot[mine] > top[mine])
            low, many = top[mine][use], (spot[mine] - top[mine])[use]
            if not len(many):
                continue
            ends = np.cumsum(many)
            at = np.repeat(low - ends + many, many) + np.arange(ends[-1])
            j, p = owners[at], np.repeat(place[mine][use], many)
            first = np.searchsorted(self.size, -(-self.percent * n // 100))
            room = 1 + np.minimum(n - p - 1, self.size[j] - places[at] - 1)
            j = np.unique(j[(j >= first) & (room >= self.needed(i, j))])
            if self.across:
                j = j[self.side[j] != self.side[i]]
            if len(j):
                yield i, j

    def linked(self, i: int, j: np.ndarray) -> np.ndarray:
        """Which of the sets ``j`` are linked to ``i``. What the leaders' overlaps with both say of two sets gives the
        answer where its bounds meet; the rest is compared."""
        n, leaders = self.size[i], self.leaders
        need, low, high = self.needed(i, j), np.zeros(len(j), np.int64), np.minimum(self.size[i], self.size[j])
        led = j[np.isin(j, list(leaders))]
        for k, o in zip(led.tolist(), self.overlaps(i, led).tolist()):
            with_k = leaders[k]
            with_k[i] = o
            known = with_k[j] >= 0
            low = np.where(known, np.maximum(low, with_k[j] - (self.size[k] - o)), low)
            high = np.where(known, np.minimum(high, with_k[j] + (n - o)), high)
            low[j == k] = high[j == k] = o
        open_ = (low < need) & (high >= need)
        self.derived += int((~open_).sum()) - len(led)
        low[open_] = high[open_] = self.overlaps(i, j[open_])
        if 2 * open_.sum() > len(j):
            if i not in leaders:
                if len(leaders) == LEADERS:
                    del leaders[next(iter(leaders))]
                leaders[i] = np.full(len(self.size), -1, np.int64)
                leaders[i][i] = n
            exact = low == high
            leaders[i][j[exact]] = low[exact]
        return low >= need

    def every(self) -> Iterator[tuple[int, np.ndarray]]:
        """Every link, once: places of a set and of those before it, in order of size, that it is linked to."""
        for i, j in self.probes():
            if len(found := j[self.linked(i, j)]):
                yield i, found

    def links(self) -> list[tuple[int, int]]:
        """A forest over the block's components: sets already connected aren't compared, and of each component
        one at a time, the nearest in size first."""
        parts_, out = Groups(len(self.ids)), []
        for i, j in self.probes():
            j = j[::-1]
            while len(j := j[parts_.of(j) != parts_.find(i)]):
                at = np.unique(parts_.of(j), return_index=True)[1]
                for k in j[at][self.linked(i, j[at])].tolist():
                    if parts_.join(k, i):
                        out.append((self.ids[k], self.ids[i]))
                j = np.delete(j, at)
        return out

    def counts(self, copies: dict[int, int]) -> tuple[list[int], list[tuple[int, int]]]:
        """For each set how many rows every link of it leads to, with ``copies`` of each id's set; and a forest."""
        weight = np.array([copies[x] for x in self.ids], np.int64)
        found, parts_, forest = np.zeros(len(self.ids), np.int64), Groups(len(self.ids)), []
        for i, j in self.every():
            found[i] += weight[j].sum()
            found[j] += weight[i]
            for k in j[np.unique(parts_.of(j), return_index=True)[1]].tolist():
                if parts_.join(k, i):
                    forest.append((self.ids[k], self.ids[i]))
        return found.tolist(), forest


class Groups:
    """Union-find over places 0 to n - 1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def of(self, places: np.ndarray) -> np.ndarray:
        """Roots of many places; their paths get shorter by it."""
        root = self.up[places]
        while (self.up[root] != root).any():
            root = self.up[root]
        self.up[places] = root
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, tag (hash of the text), n, class (64 bits of the set's hash) and sketch of every row; one pass."""
    slim = docs.select("doc_id", F.xxhash64(whole("text")).alias("tag"), whole("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_class(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()),
            ], ["doc_id", "tag", "n", "class", "sketch"])

    return slim.mapInArrow(run, "doc_id bigint, tag bigint, n bigint, class bigint, sketch binary")


def _class(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _posts(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``part, class, drop, scheme``; a batch posts equal sets once."""
    slim = docs.select(whole("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            once = {_class(s): s for s in shingle_sets(batch.column(0).to_pylist(), words)}
            rows = [(h, c, drop, i) for c, s in once.items() for i, (drop, h) in enumerate(parts(s, percent))]
            if rows:
                size = [len(r[0]) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[0] for r in rows])), *[pa.array(np.repeat([r[k] for r in rows], size), t) for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()))]], ["part", "class", "drop", "scheme"])

    return slim.mapInArrow(run, "part bigint, class bigint, drop int, scheme int")


def _alike(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, and their n and sketch) whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            keep = [apart(p, q) * (100 + percent) <= (i + j) * (100 - percent) for i, j, p, q in zip(n, m, x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, keep) if k], pa.int64()) for c in (a, b)], ["a", "b"])

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _common(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``part, seen``: parts that many of a sample of texts post. Which parts are found changes how lists are dealt
    to tasks, and no result; as each has a share of the sample's posts, there are ``MOST_COMMON`` at most."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    seen = _posts(sample, words, percent).groupBy("part").agg(F.approx_count_distinct("class").alias("seen"))
    return settle(seen.where(F.col("seen") >= LIST // SAMPLE).orderBy(F.desc("seen"), "part").limit(MOST_COMMON))


def candidates(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """``class, block``: classes that post a part that another posts, and may be linked.

    The list of a common part is dealt to a task for each ``LIST`` of its classes. Its size, which decides what
    may be dropped, is then what the sample says, the same for all of the list; and its pieces are tied by
    their first classes."""
    common = F.broadcast(_common(docs, words, percent))  # MOST_COMMON rows at most
    pieces = F.coalesce(F.ceil(F.col("seen") * SAMPLE / LIST), F.lit(1))
    dealt = _posts(docs, words, percent).join(common, "part", "left").withColumn("piece", F.pmod(F.xxhash64("class"), pieces).cast("int"))
    posted = dealt.repartition("part", "piece").groupBy("part", "piece", "class").agg(F.min("drop").alias("drop"), F.min("scheme").alias("scheme"), F.first("seen").alias("seen"))
    among = Window.partitionBy("part", "piece")
    listed = posted.withColumn("here", F.count(F.lit(1)).over(among)).withColumn("size", F.coalesce(F.col("seen") * SAMPLE, "here")).where("size > 1")
    longest = F.row_number().over(Window.partitionBy("class", "scheme").orderBy(F.desc("size"), "part"))
    kept = listed.withColumn("nth", longest).where("nth > drop")
    order = among.orderBy("class")
    lags = F.array(*[F.lag("class", k).over(order) for k in range(1, FEW)])
    first = F.min("class").over(among)
    many = (F.count(F.lit(1)).over(among) > FEW) | F.col("seen").isNotNull()
    before = F.array_compact(F.when(many, F.array(F.when(F.col("class") != first, first))).otherwise(lags))
    head = F.when(F.col("seen").isNotNull() & (F.col("class") == first), F.col("part"))
    path = scratch(docs.sparkSession, "posts")
    kept.select("class", before.alias("before"), many.alias("many"), head.alias("head")).where("size(before) > 0 or head is not null").write.parquet(path)
    near = docs.sparkSession.read.parquet(path)
    heads = near.where("head is not null").select(F.col("class").alias("a"), F.lit(True).alias("many"), F.min("class").over(Window.partitionBy("head")).alias("b")).where("a <> b")  # a row for each piece of a list
    tied = near.select(F.col("class").alias("a"), "many", F.explode("before").alias("b")).unionByName(heads)
    edges = settle(tied.distinct())
    remove(docs.sparkSession, path)
    side = classes.select("class", "n", "sketch")
    pairs = edges.where(~F.col("many")).select("a", "b").join(side.toDF("a", "n", "x"), "a").join(side.toDF("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
    linked = _alike(pairs, percent).unionByName(edges.where("many").select("a", "b"))
    return components(linked).select(F.col("node").alias("class"), F.col("component").alias("block"))


def _cuts(members: DataFrame) -> DataFrame:
    """``members`` with ``cut``: blocks cut by size into pieces of about BLOCK shingles and SETS sets. Offsets are
    added up over a block's distinct sizes, not over its sets; sets of one size are dealt to its pieces by hash."""
    weight = F.greatest(F.col("n"), F.lit(-(-BLOCK // SETS)))
    sizes = members.groupBy("block", "n").agg(F.sum(weight).alias("weight"))
    run = Window.partitionBy("block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ends = sizes.withColumn("end", F.sum("weight").over(run))
    first, last = F.floor((F.col("end") - F.col("weight")) / BLOCK), F.floor((F.col("end") - 1) / BLOCK)
    spans = ends.select("block", "n", first.alias("first"), (last - first + 1).alias("pieces"))
    return settle(members.join(spans, ["block", "n"]).withColumn("cut", (F.col("first") + F.pmod(F.xxhash64("class"), F.col("pieces"))).cast("int")).drop("first", "pieces"))


def links(docs: DataFrame, classes: DataFrame, words: int, percent: int, what: str = "forest") -> DataFrame:
    """``a, b, n``: links between classes. ``forest``: some, that span all of their components; ``pairs``: all;
    ``counts``: such a forest of all, and rows without b, to how many rows (n) links of a lead in a task."""
    members = candidates(docs, classes, words, percent).join(classes.select("class", "rep", "tag", "n", "copies"), "class")
    cut = _cuts(members)
    edges = cut.groupBy("block", "cut").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    other = edges.select(F.col("block"), F.col("cut").alias("cut2"), F.col("least").alias("least2"))
    pairs = edges.join(other, "block").where((F.col("cut") <= F.col("cut2")) & (F.col("least2") * percent <= F.col("most") * 100))
    ends = pairs.select("block", F.explode(F.array_distinct(F.array("cut", "cut2"))).alias("cut"), F.struct(F.col("cut").alias("x"), F.col("cut2").alias("y")).alias("pair"))
    plan = cut.join(ends, ["block", "cut"]).groupBy("class", "rep", "tag", "block", "cut", "copies").agg(F.collect_list("pair").alias("pairs"))
    # only now whole texts, of candidates alone; a text is shorter than its set of hashes
    texts = docs.select(F.col("doc_id").alias("rep"), F.xxhash64(whole("text")).alias("tag"), whole("text").alias("text")).join(plan, ["rep", "tag"]).dropDuplicates(["rep", "tag"])
    spread = texts.select("class", "block", "cut", "copies", "text", F.explode("pairs").alias("pair")).select("class", "block", "cut", "copies", "text", "pair.x", "pair.y")
    types = [pa.int64()] * 3

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
            side = [r[1] for r in rows] if key[1] != key[2] else None
            block = Block([r[0] for r in rows], shingle_sets([r[2] for r in rows], words), percent, side)
            if what == "pairs":
                found = [(block.ids[k], block.ids[i], None) for i, j in block.every() for k in j.tolist()]
            elif what == "counts":
                many, forest = block.counts({r[0]: r[3] for r in rows})
                found = [(a, None, n) for a, n in zip(block.ids, many) if n] + [(a, b, None) for a, b in forest]
            else:
                found = [(a, b, None) for a, b in block.links()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(types)], ["a", "b", "n"])

        key, rows = None, []
        for batch in batches:
            for name, block, cut, copies, text, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                if key != (block, x, y):
                    if rows:
                        yield ended(key, rows)
                    key, rows = (block, x, y), []
                rows.append((name, cut, text, copies))
        if rows:
            yield ended(key, rows)

    return spread.repartition("block", "x", "y").sortWithinPartitions("block", "x", "y").mapInArrow(compare, "a bigint, b bigint, n bigint")


def _checked(percent: int) -> None:
    if not 1 <= percent <= 100:
        raise ValueError("percent must be from 1 to 100")


def _classes(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """The sets of all rows; the classes of those with an id, each with its smallest id (and that text's tag)."""
    sets = settle(_sets(docs, words))
    filled = sets.where("n > 0 and doc_id is not null").groupBy("class")
    found = filled.agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    return sets, settle(found.select("class", F.col("first.doc_id").alias("rep"), F.col("first.tag").alias("tag"), "n", "sketch", "copies"))


def _labelled(sets: DataFrame, classes: DataFrame, edges: DataFrame, *more: str) -> DataFrame:
    """``doc_id, tag, n_shingles, component_id`` of every row, and ``more`` columns of its class."""
    label = classes.select("class", "rep", *more).join(components(edges).withColumnRenamed("node", "class"), "class", "left")
    label = settle(label.withColumn("component", F.coalesce("component", "class")))
    least = label.groupBy("component").agg(F.min("rep").alias("least"))
    named = label.join(least, "component").select("class", "least", *more)
    return sets.select("doc_id", "tag", "n", "class").join(named, "class", "left").select("doc_id", "tag", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), *more)


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: components alone, from links that span them."""
    return _joined(docs, words, percent).drop("tag")


def _joined(docs: DataFrame, words: int, percent: int) -> DataFrame:
    _checked(percent)
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets, classes = _classes(docs, words)
    return _labelled(sets, classes, links(docs.where("doc_id is not null"), classes, words, percent).select("a", "b"))


def counted(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``join``'s columns and ``n_links``: how many other rows with an id are linked to the row, copies too."""
    _checked(percent)
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sets, classes = _classes(docs, words)
    found = settle(links(docs.where("doc_id is not null"), classes, words, percent, "counts"))
    many = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("linked"))
    classes = classes.join(many, "class", "left").withColumn("reached", F.col("copies") + F.coalesce("linked", F.lit(0)))
    rows = _labelled(sets, classes, found.where("b is not null").select("a", "b"), "reached")
    itself = F.col("doc_id").isNotNull().cast("bigint")
    return rows.select("doc_id", "n_shingles", "component_id", F.when(F.col("n_shingles") > 0, F.coalesce(F.col("reached") - itself, F.lit(0))).otherwise(0).cast("bigint").alias("n_links"))


def pairs(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``a, b``: every link between unlike sets, by the smallest ids of their classes, a <= b (equal only where
    one id has unlike texts)."""
    _checked(percent)
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    classes = _classes(docs, words)[1]
    name = lambda side: classes.select(F.col("class").alias(side), F.col("rep").alias(f"{side}_rep"))
    found = links(docs, classes, words, percent, "pairs").join(name("a"), "a").join(name("b"), "b")
    return found.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is their component's: one document of each group stays, with its columns.
    Of rows that share such an id one stays (of unlike texts that with the least hash); rows without an id stay."""
    named = docs.where("doc_id is not null")
    heads = _joined(named.select("doc_id", "text"), words, percent).where("component_id = doc_id").groupBy("doc_id").agg(F.min("tag").alias("tag"))
    rows = named.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(whole("text")).alias("tag"))
    kept = rows.join(heads, ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"]).select("row.*")
    return kept.unionByName(docs.where("doc_id is null"))


#: What op10 returns: 3 words, 90 %. Words hold no space, so shingles joined by spaces are told apart.
ORACLE = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 shingles AS (SELECT DISTINCT doc_id, unnest(CASE
   WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM texts),
 sets AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS n FROM shingles),
 pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
   AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 reached(x, y) AS (SELECT x, y FROM pairs UNION SELECT r.x, p.y FROM reached r JOIN pairs p ON r.y = p.x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least_id, doc_id)) AS component_id,
 coalesce(many, 0)::BIGINT AS n_links
FROM texts LEFT JOIN (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id) USING (doc_id)
 LEFT JOIN (SELECT x AS doc_id, min(y) AS least_id FROM reached GROUP BY x) USING (doc_id)
 LEFT JOIN (SELECT x AS doc_id, count(*) AS many FROM pairs GROUP BY x) USING (doc_id)"""
