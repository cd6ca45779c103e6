"""N-gram Jaccard join by vertical partitioning: documents linked by shared word 5-grams.

1. Equal sets fall into one class; only one document of a class goes on.
2. A global order of the n-grams puts frequent ones last, the others by hash. Two sets
   of the wanted similarity share one of their first n-grams (prefix filter). The
   prefixes are dealt to fragments of the hash range, as many as the corpus needs, in
   packed form: a few bytes for an n-gram and its class.
3. A fragment lists the classes of each n-gram. Classes of a list may link only if their
   parity sketches (a bit per n-gram or more) differ no more than sets of that similarity
   can; the classes that still may link are connected, and the groups are the families.
   Lists that outgrow a task tie their classes to one of them unseen, never pair by pair.
4. In a family the order is cut into fragments. The overlaps of all its classes are
   counted per fragment and summed, as products of small incidence matrices, and
   compared with the exact threshold. Large families are cut into blocks that meet
   two by two. A task hands on no pairs, only which classes became connected.

All links count; none is dropped for the size of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentria.llm.common import staged, tasks
from sentria.llm.components import components

SHINGLE = 5
#: Leading bits of a hash that name an n-gram in a list. n-grams that agree in them cost time only.
PLACE_BITS = 40
#: n-grams of prefixes in a fragment, about.
FRAGMENT_ROWS = 2_000_000
#: Classes in a list whose pairs are handed on one by one; longer lists are compared in one piece.
SHORT = 8
#: Frequent n-grams that get a rank of their own. The order stays valid, and the result
#: the same, whichever they are; more of them only keep families small.
MAX_FREQUENT = 1 << 16
#: Sightings (repeats inside tasks) from which an n-gram counts as frequent.
MIN_SIGHTINGS = 8
#: Sets of more n-grams go to a list with a sketch folded to so many bits, and are compared once more in their group.
WIDE = 1024
#: Classes in a block, n-grams in a fragment.
BLOCK = 512
FRAGMENT = 2048
#: n-grams, and classes, that a task holds before it hands on.
FLUSH = 2_000_000
OWNERS = 1 << 20
CACHE_WORDS = 300_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _WordHashes()


def _mix(h: np.ndarray, factor: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(factor)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word runs, or of the whole sequence if it is shorter."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    out = np.zeros(len(words) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = (out + h[k : len(words) - SHINGLE + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(_mix(out, 0xFF51AFD7ED558CCD))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a = int(_mix(s, 0x87C37B91114253D5).sum(dtype=np.uint64))
    b = int(_mix(s, 0x2545F4914F6CDD1D).sum(dtype=np.uint64))
    return tuple(int(np.uint64(x).astype(np.int64)) for x in (a, b))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


PROFILE = "kind int, doc_id long, n long, k1 long, k2 long"


def profiles(docs: DataFrame) -> DataFrame:
    """One row per document (kind 0: doc_id, n, k1, k2), and what tasks saw of n-grams.

    Kind 1 (n, k1): an n-gram that n different sets of the task have.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in PROFILE.split(", ")]
        held, size, seen = [], 0, set()

        def summary() -> pd.DataFrame:
            h, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            # Equal sets of one task count once.
            rows = [(1, None, int(c), int(x), 0) for x, c in zip(_signed(h[n > 2]), n[n > 2])]
            return pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                s = shingle_set(text)
                key = set_key(s)
                rows.append((0, doc_id, len(s), *key))
                if key not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64"})
            if size > FLUSH:
                yield summary()
                held, size, seen = [], 0, set()
        if held:
            yield summary()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(read, PROFILE)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, so that leading zeros take no room."""
    planes = x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def prefix(s: np.ndarray, ordered: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """The first n-grams of a set in the global order. ``ordered``: the frequent n-grams by hash; ``rank``: their places, at the end."""
    length = len(s) - -(-percent * len(s) // 100) + 1
    if not len(ordered):
        return s[:length]
    at = np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)
    late = ordered[at] == s
    rare = s[~late][:length]
    last = np.argsort(rank[at[late]])[: length - len(rare)]
    return np.concatenate([rare, s[late][last]])


def sketch(s: np.ndarray) -> np.ndarray:
    """Packed parities of the n-grams per bucket. Two sets differ in as many n-grams as their sketches in bits, or more."""
    width = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1)


def folded(bits: np.ndarray) -> np.ndarray:
    """Sketches (rows) at half their width."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


POSTINGS = "kind int, node long, k1 long, k2 long, n long, bits binary, part long, places binary, owners binary"


def postings(docs: DataFrame, frequent: np.ndarray, percent: int, fragments: int) -> DataFrame:
    """The sets of each task under numbers of their own, and the n-grams of their prefixes.

    Kind 0 (node, k1, k2, n, bits): a set and its sketch. Kind 1 (part, places, owners,
    node): n-grams of a fragment and the sets with them, which count from ``node``.
    Numbers follow the tasks, so the rows are to be written once and read from there.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late = sent.value  # the least frequent first
        columns = [c.split()[0] for c in POSTINGS.split(", ")]
        whole = {c: "Int64" for c in ("node", "k1", "k2", "n", "part")}
        base = TaskContext.get().partitionId() << 38  # 18 bits for the flushes, 20 for their sets
        rank = np.argsort(late)
        ordered = late[rank]
        held, sets, seen, size = [], [], set(), 0

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype(whole)

        def flush() -> Iterator[pd.DataFrame]:
            place = np.concatenate(held)
            owner = np.repeat(np.arange(len(held)), [len(x) for x in held])
            order = np.argsort(place, kind="stable")
            place, owner = place[order], owner[order]
            parts, first = np.unique((place * np.uint64(fragments)) >> np.uint64(PLACE_BITS), return_index=True)
            yield frame([(0, base + k, *x, None, None, None) for k, x in enumerate(sets)])
            rows = []
            for part, p, o in zip(parts, np.split(place, first[1:]), np.split(owner, first[1:])):
                steps = np.diff(p, prepend=np.uint64(0))
                rows.append((1, base, None, None, None, None, int(part), _pack(steps), _pack(o)))
            yield frame(rows)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                s = shingle_set(text)
                if not len(s) or pd.isna(doc_id) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                held.append(prefix(s, ordered, rank, percent) >> np.uint64(64 - PLACE_BITS))
                sets.append((*key, len(s), sketch(s).tobytes()))
                size += len(held[-1])
                if size > FLUSH or len(sets) == OWNERS:
                    yield from flush()
                    held, sets, seen, size = [], [], set(), 0
                    base += OWNERS
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInPandas(emit, POSTINGS)


def _lists(frame: pd.DataFrame, longest: int) -> pd.DataFrame:
    """What the n-grams of a fragment list: pairs (a, b) of short lists, members (g, a) of long ones.

    Equal lists are one, g is a hash of the members. A list over ``longest`` gives (g null,
    a, b null, lead): each member and the one that it is tied to.
    """
    place = [np.cumsum(_unpack(x), dtype=np.uint64) for x in frame["places"]]
    node = [_unpack(x).astype(np.int64) + base for x, base in zip(frame["owners"], frame["node"])]
    place, node = np.concatenate(place), np.concatenate(node)
    order = np.argsort(place, kind="stable")
    place, node = place[order], node[order]
    same = place[1:] == place[:-1]
    shared = np.zeros(len(place), bool)
    shared[1:] |= same
    shared[:-1] |= same
    place, node = place[shared], node[shared]
    order = np.lexsort((node, place))
    place, node = place[order], node[order]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (node[1:] != node[:-1])
    place, node = place[new], node[new]
    _, first, size = np.unique(place, return_index=True, return_counts=True)
    if len(first):
        g = np.add.reduceat(_mix(node.view(np.uint64), 0x87C37B91114253D5), first)
        _, kept = np.unique(g, return_index=True)
        kept = kept[size[kept] > 1]
    else:
        g, kept = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = []
    for n in range(2, SHORT + 1):
        rows = node[first[kept[size[kept] == n]][:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        out.append(np.stack([rows[:, i].ravel(), rows[:, j].ravel()], axis=1))
    pairs = np.unique(np.concatenate(out), axis=0)
    frames = [pd.DataFrame({"g": pd.NA, "a": pairs[:, 0], "b": pairs[:, 1], "lead": pd.NA})]
    for k in kept[size[kept] > SHORT]:
        a = node[first[k] : first[k] + size[k]]
        if size[k] <= longest:
            frames.append(pd.DataFrame({"g": g[k : k + 1].view(np.int64)[0], "a": a, "b": pd.NA, "lead": pd.NA}))
        else:
            frames.append(pd.DataFrame({"g": pd.NA, "a": a[1:], "b": pd.NA, "lead": a[0]}))
    return pd.concat([f.astype("Int64") for f in frames])


def _may_link(left: list[bytes], n_left: np.ndarray, right: list[bytes], n_right: np.ndarray, percent: int) -> np.ndarray:
    """Which sets (rows, columns) their sizes and sketches leave in question."""
    out = np.zeros((len(left), len(right)), bool)

    def by_width(sketches: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        width = np.array([len(x) for x in sketches])
        at = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
        return {w: (i, np.frombuffer(b"".join(sketches[k] for k in i), np.uint8).reshape(-1, w)) for w, i in at.items()}

    a, b = by_width(left), by_width(right)
    for w in a:
        for v in b:
            # Sets of the wanted similarity differ in width by one step at most.
            if max(w, v) > 2 * min(w, v):
                continue
            (i, x), (j, y) = a[w], b[v]
            x = np.ascontiguousarray(folded(x) if w > v else x).view(np.uint64)
            y = np.ascontiguousarray(folded(y) if v > w else y).view(np.uint64)
            for low in range(0, len(i), 256):
                at = i[low : low + 256]
                apart = np.zeros((len(at), len(j)), np.int64)
                for k in range(x.shape[1]):
                    apart += np.bitwise_count(x[low : low + 256, k][:, None] ^ y[:, k][None, :])
                m, n = n_left[at][:, None], n_right[j][None, :]
                fits = (100 + percent) * apart <= (100 - percent) * (m + n)
                out[np.ix_(at, j)] = fits & (100 * np.minimum(m, n) >= percent * np.maximum(m, n))
    return out


def _compare(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b, wide): each class of a list that may link with another of it, and the first class that it reaches.

    Large sets, whose sketches are folded, are tied to one another apart (wide).
    """
    frame = frame.drop_duplicates("class_id").sort_values("class_id")
    n, bits, ids = frame["n"].to_numpy(np.int64), list(frame["bits"]), frame["class_id"].to_numpy()
    linked = _may_link(bits, n, bits, n, percent)
    wide = (n > WIDE)[:, None] & (n > WIDE)[None, :]
    return pd.concat([_ties(linked & ~wide, ids, 0).assign(wide=False), _ties(linked & wide, ids, 0).assign(wide=True)])


def _compare_blocks(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """``_compare`` for the large sets of two blocks, or of one, by their whole sketches."""
    frame = frame.drop_duplicates(["class_id", "side"]).sort_values("class_id")
    one, two = frame[frame["side"] == 0], frame[frame["side"] == 1]
    diagonal = frame["one"].iloc[0] == frame["two"].iloc[0]
    other = one if diagonal else two
    if not len(one) or not len(other):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    sizes = lambda f: f["n"].to_numpy(np.int64)
    linked = _may_link(list(one["bits"]), sizes(one), list(other["bits"]), sizes(other), percent)
    ids = one["class_id"].to_numpy() if diagonal else np.concatenate([one["class_id"], two["class_id"]])
    return _ties(linked, ids, 0 if diagonal else len(one))


def _wide_edges(rough: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b): what whole sketches leave of the groups of large sets that ``rough`` (a, b) connects.

    ``known``: class_id, n, bits of all classes. Each sketch goes to its group once, not to every list.
    """
    groups = components(rough).select(F.col("node").alias("class_id"), "label")
    sets = staged(groups.join(known.where(F.col("n") > WIDE), "class_id").dropDuplicates(["class_id"]), "wide-groups")
    cells = _late_cells(sets.select("class_id", "label", "n", F.col("class_id").alias("found")), percent, 4 * BLOCK)
    met = sets.join(cells, "class_id").select("label", F.explode("cells").alias("c"), "class_id", "n", "bits")
    return met.select("label", "c.*", "class_id", "n", "bits").groupBy("label", "one", "two").applyInPandas(
        lambda frame: _compare_blocks(frame, percent), "a long, b long"
    )


def candidate_edges(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes (a, b) that connect all classes that share a prefix n-gram and may link.

    ``rows``: the stored ``postings``.
    """
    longest = 4 * BLOCK
    lists = staged(
        rows.where("kind = 1").select("part", "node", "places", "owners").groupBy("part").applyInPandas(
            lambda frame: _lists(frame, longest), "g long, a long, b long, lead long"
        ),
        "lists",
    )
    nodes = staged(
        rows.where("kind = 0").select("node", "k1", "k2", "n", "bits")
        .join(classes.select("k1", "k2", "class_id"), ["k1", "k2"]).select("node", "class_id", "n", "bits"),
        "nodes",
    )

    @F.pandas_udf("boolean")
    def may_link(n1: pd.Series, s1: pd.Series, n2: pd.Series, s2: pd.Series) -> pd.Series:
        def one(m: int, x: bytes, n: int, y: bytes) -> bool:
            while len(x) > len(y):
                x = folded(np.frombuffer(x, np.uint8)).tobytes()
            while len(y) > len(x):
                y = folded(np.frombuffer(y, np.uint8)).tobytes()
            apart = (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count()
            return (100 + percent) * apart <= (100 - percent) * (m + n)

        return pd.Series([one(*x) for x in zip(n1, s1, n2, s2)], dtype=bool)

    @F.pandas_udf("binary")
    def short(bits: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> bytes:
            while 8 * len(x) > WIDE:
                x = folded(x)
            return x.tobytes()

        return pd.Series([one(np.frombuffer(x, np.uint8)) for x in bits], dtype=object)

    side = lambda key, p: nodes.select(F.col("node").alias(key), F.col("class_id").alias(p), F.col("n").alias(f"n_{p}"), F.col("bits").alias(f"bits_{p}"))
    pairs = lists.where("b is not null").select("a", "b").distinct()
    met = pairs.join(side("a", "x").hint("merge"), "a").join(side("b", "y").hint("merge"), "b").where(
        f"x <> y and 100 * least(n_x, n_y) >= {percent} * greatest(n_x, n_y)"
    )
    near = met.where(may_link("n_x", "bits_x", "n_y", "bits_y")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    members = lists.where("g is not null").select("g", F.col("a").alias("node")).distinct()
    brief = nodes.select("node", "class_id", "n", short("bits").alias("bits"))
    compared = staged(
        members.join(brief.hint("merge"), "node").select("g", "class_id", "n", "bits").groupBy("g").applyInPandas(
            lambda frame: _compare(frame, percent), "a long, b long, wide boolean"
        ).distinct(),
        "compared",
    )
    small, rough = (compared.where(c).select("a", "b") for c in ("not wide", "wide"))
    if not rough.isEmpty():
        small = small.unionByName(_wide_edges(rough, nodes.select("class_id", "n", "bits"), percent))
    ties = lists.where("lead is not null").select("a", F.col("lead").alias("b")).distinct()
    name = lambda key, p: nodes.select(F.col("node").alias(key), F.col("class_id").alias(p))
    tied = ties.join(name("a", "x"), "a").join(name("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return near.unionByName(small).unionByName(tied).where("a <> b").distinct()


def _banded(members: DataFrame, percent: int) -> DataFrame:
    """With band: sets whose bands are not the same or neighbours never reach the similarity."""
    step = np.log(100 / percent)
    return members.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int"))


def _block(band: Column, kind: Column, k: Column) -> Column:
    return F.struct(band.alias("band"), kind.alias("kind"), k.alias("k"))


def _meetings(mine: Column, others: Column) -> Column:
    """The cells of a set in the block ``mine`` that meets the blocks ``others``."""
    return F.transform(
        others,
        lambda o: F.struct(
            F.least(mine, o).alias("one"),
            F.greatest(mine, o).alias("two"),
            (mine > o).cast("int").alias("side"),
        ),
    )


def _cells(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (class_id, rep, label, n) with cells: the first meetings of blocks in which the set takes part.

    A family within one block is one cell. Others have blocks of about ``BLOCK`` sets of
    similar size, which meet themselves and the first block of their own and the next
    bands; what may link beyond that is left to ``_late_cells``.
    """
    banded = _banded(members, percent)
    bands = banded.groupBy("label", "band").agg(F.count("*").alias("size"), F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    per_family = staged(
        bands.groupBy("label").agg(
            F.sum("size").alias("size"), F.map_from_entries(F.collect_list(F.struct("band", "k"))).alias("blocks")
        ),
        "family-sizes",
    )
    own = F.pmod(F.xxhash64("class_id"), F.try_element_at("blocks", F.col("band"))).cast("int")
    put = banded.join(per_family, "label").withColumn("own", own)
    kind = F.lit(-1).cast("long")
    mine = _block(F.col("band"), kind, F.col("own"))

    def first(shift: int):
        band = F.col("band") + shift
        n = F.coalesce(F.try_element_at("blocks", band), F.lit(0))
        # The first block meets all, so that either side names the cell.
        last = F.when(F.col("own") == 0, n - 1).otherwise(F.lit(0))
        ks = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(ks, lambda k: _block(band, kind, k))

    meet = F.array_distinct(F.flatten(F.array(F.array(mine), first(-1), first(0), first(1))))
    nowhere = _block(F.lit(0), kind, F.lit(0))
    alone = F.array(F.struct(nowhere.alias("one"), nowhere.alias("two"), F.lit(0).alias("side")))
    large = F.col("size") > BLOCK
    cells = F.when(large, _meetings(mine, meet)).otherwise(alone)
    return put.select("class_id", "rep", "label", "k1", "k2", "n", large.alias("large"), cells.alias("cells"))


def _late_cells(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(class_id, cells): the meetings of blocks of families that are still in question.

    ``members`` (class_id, label, n, found): found is the component that the first
    meetings gave. A component of more than ``block`` sets of a band has blocks of its
    own, and those never meet one another, so a group of near copies that has been
    found whole is not compared again.
    """
    banded = _banded(members, percent)
    own = banded.groupBy("label", "band", "found").agg(F.when(F.count("*") > block, F.col("found")).otherwise(-1).alias("kind"))
    kinded = banded.join(own, ["label", "band", "found"])
    sizes = staged(
        kinded.groupBy("label", "band", "kind").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "block-counts"
    )
    per_family = sizes.groupBy("label").agg(F.collect_list(F.struct("band", "kind", "blocks")).alias("all"))
    put = kinded.join(sizes, ["label", "band", "kind"]).join(per_family, "label")
    mine = _block(F.col("band"), F.col("kind"), F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    asked = F.filter(
        "all",
        lambda x: (F.abs(x["band"] - F.col("band")) <= 1) & ((x["kind"] == -1) | (x["kind"] != F.col("kind"))),
    )
    meet = F.flatten(
        F.transform(
            asked,
            lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda k: _block(x["band"], x["kind"], k)),
        )
    )
    return put.select("class_id", _meetings(mine, meet).alias("cells")).where(F.size("cells") > 0)


def _sets_of(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """(class_id, label, large, cells, hashes): the members' sets."""

    @F.pandas_udf("binary")
    def hashes(texts: pd.Series, k1: pd.Series, k2: pd.Series) -> pd.Series:
        found = map(shingle_set, texts)
        # Another row may have the same doc_id: its set is not the member's.
        return pd.Series([s.tobytes() if set_key(s) == k else None for s, k in zip(found, zip(k1, k2))], dtype=object)

    # Always by shuffle: members grow with the corpus, so a broadcast would only suit small ones.
    texts = docs.select("doc_id", "text").join(placed.hint("merge"), F.col("doc_id") == F.col("rep"))
    return texts.select("class_id", "label", "large", "cells", hashes("text", "k1", "k2").alias("hashes")).where("hashes is not null")


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): what links inside the cells of ``sets`` connect."""
    met = sets.select("label", F.explode("cells").alias("c"), "class_id", "hashes").select("label", "c.*", "class_id", "hashes")
    return met.groupBy("label", "one", "two").applyInPandas(lambda frame: _connect(frame, percent), "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, counted fragment by fragment of the n-gram order and summed."""
    out = np.zeros((len(left), len(right)), np.float32)
    both = left if left is right else left + right
    tokens, n = np.unique(np.concatenate(both), return_counts=True)
    tokens = tokens[n > 1]

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(tokens, h), len(tokens) - 1)
        keep = tokens[at] == h
        at, owner = at[keep], owner[keep]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    if not len(tokens):
        return out
    a_at, a_owner = places(left)
    b_at, b_owner = (a_at, a_owner) if left is right else places(right)
    for low in range(0, len(tokens), FRAGMENT):
        width = min(FRAGMENT, len(tokens) - low)

        def matrix(at: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
            i, j = np.searchsorted(at, [low, low + width])
            m = np.zeros((rows, width), np.float32)
            m[owner[i:j], at[i:j] - low] = 1
            return m

        a = matrix(a_at, a_owner, len(left))
        out += a @ (a if left is right else matrix(b_at, b_owner, len(right))).T
    return out


def _ties(linked: np.ndarray, ids: np.ndarray, shift: int) -> pd.DataFrame:
    """(a, b): each of ``ids`` that links connect with another, and the first it reaches; columns are the ids from ``shift``."""
    rows_n, cols_n = linked.shape
    label = np.arange(len(ids))
    while True:
        rows, cols = label[:rows_n], label[shift : shift + cols_n]
        new = label.copy()
        low = np.where(linked, cols[None, :], len(ids)).min(axis=1)
        new[:rows_n] = np.minimum(rows, low)
        back = np.where(linked, new[:rows_n][:, None], len(ids)).min(axis=0)
        new[shift : shift + cols_n] = np.minimum(new[shift : shift + cols_n], back)
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return pd.DataFrame({"a": ids[moved].astype(np.int64), "b": ids[label[moved]].astype(np.int64)})


def _connect(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b): each set that a link inside the cell connects with another, and the first set it reaches."""
    frame = frame.drop_duplicates(["class_id", "side"]).sort_values("class_id")
    one, two = frame[frame["side"] == 0], frame[frame["side"] == 1]
    sets = lambda f: [np.frombuffer(x, np.uint64) for x in f["hashes"]]
    diagonal = frame["one"].iloc[0] == frame["two"].iloc[0]
    left = sets(one)
    right = left if diagonal else sets(two)
    ids = one["class_id"].to_numpy() if diagonal else np.concatenate([one["class_id"], two["class_id"]])
    if not len(left) or not len(right):
        return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    common = overlaps(left, right).astype(np.int64)
    size = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    linked = 100 * common >= percent * (size - common)
    return _ties(linked, ids, 0 if diagonal else len(left))


def jaccard_components(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Two documents link if 100 * intersection >= ``percent`` * union of their n-gram
    sets; component_id is the smallest doc_id reachable over links, its own included.
    Documents without words are linked with nothing. Rows without doc_id link with
    nothing and have a null component_id; rows that share a doc_id are nodes of
    their own, with one result each. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = staged(profiles(docs), "profiles")
    own = rows.where("kind = 0")
    classes = staged(
        # Classes have a number of their own: rows with one doc_id and different sets are several.
        own.where("doc_id is not null and n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
        .withColumn("class_id", F.monotonically_increasing_id()),
        "classes",
    )
    # At most MAX_FREQUENT rows.
    often = (
        rows.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("c")).where(F.col("c") >= MIN_SIGHTINGS)
        .orderBy(F.col("c").desc(), "k1").limit(MAX_FREQUENT).select("k1").toPandas()
    )
    frequent = often["k1"].to_numpy(np.int64)[::-1].copy().view(np.uint64)
    prefixed = own.agg(F.sum("n")).first()[0] or 0
    fragments = max(tasks(spark), -(-prefixed * (100 - percent) // (100 * FRAGMENT_ROWS)))
    listed = staged(postings(docs, frequent, percent, fragments), "postings")
    edges = staged(candidate_edges(listed, classes, percent), "candidates")
    families = staged(components(edges), "families")
    members = families.join(classes, F.col("node") == F.col("class_id")).select("class_id", "rep", "k1", "k2", "n", "label")
    placed = staged(_cells(members, percent), "placed")
    sets = staged(_sets_of(docs, placed), "sets")
    links = staged(_links(sets, percent), "links")
    labels = staged(components(links), "labels")
    large = placed.where("large")
    if not large.isEmpty():
        found = large.join(labels, F.col("class_id") == F.col("node"), "left").select(
            "class_id", large["label"], "n", F.coalesce(labels["label"], "class_id").alias("found")
        )
        late = staged(_late_cells(found, percent, BLOCK), "late-cells")
        again = sets.where("large").select("class_id", "label", "hashes").join(late.hint("merge"), "class_id")
        labels = staged(components(links.union(_links(again, percent))), "labels")
    tied = staged(
        classes.join(labels, F.col("class_id") == F.col("node"), "left").select(
            "k1", "k2", "rep", F.coalesce("label", "class_id").alias("label")
        ),
        "tied",
    )
    # Written, so that the join with it can split a large component's rows.
    lowest = staged(tied.groupBy("label").agg(F.min("rep").alias("component")), "lowest")
    known = staged(tied.join(lowest, "label").select("k1", "k2", "component"), "components")
    joined = own.join(known, ["k1", "k2"], "left")
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(
            F.col("component")
        ).alias("component_id"),
    )


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
