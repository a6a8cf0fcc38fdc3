"""N-gram Jaccard self-join by signature trees.

A document's set is its distinct word n-grams. Two sets link when their Jaccard similarity
reaches a rational threshold; links are exact, and components of links are returned.

1. Documents with equal sets form one class (hash of the sorted set); classes carry on.
2. Prefix tokens: two linked sets share one of their |x| - ceil(t|x|) + 1 first n-grams in any
   common order, so the classes that share such an n-gram form the groups in which links can
   lie. Common n-grams come last, so that passages that many texts share make no groups.
   Groups with equal members are kept once.
3. In groups beyond `block` members every class is compared with the group's first member,
   bitmap by bitmap; what may link is joined.
4. Within each group a signature tree (nodes: OR-combined bitmaps and size ranges) is
   traversed against itself; node pairs whose largest possible overlap is too small are
   pruned. What survives joins classes into families, supersets of the true components.
5. Within each family the same again with the sets themselves at the leaves: exact Jaccard
   decides. Only links between not yet joined classes are emitted.

Groups and families beyond `block` members are dealt out as pairs of blocks; those members that
the comparison with the first one made one component have blocks of their own, which meet all
other blocks but not each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import emptied_id, filled_id, map_texts, matching, mix64, parts, runs, stored, unstore
from .components import connected_components

LEAF = 16
FANOUT = 8


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams (A-Z lower-cased, words split at
    ASCII white space); with fewer words the whole sequence is one; none: empty."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(n, len(h))
    total = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(total)


def _prefix_length(size: int, num: int, den: int) -> int:
    return size - (num * size + den - 1) // den + 1


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bitmap of 2 to 4 bits per member, in 64-bit words: the hash's high bits choose the
    bit, so that folding a wider bitmap to half joins neighbouring bits."""
    words = 1 << max(0, int(np.ceil(np.log2(max(1, len(hashes)) * 2 / 64))))
    at = (hashes >> np.uint64(64 - 6 - int(np.log2(words)))).astype(np.int64)
    bits = np.zeros(words * 64, dtype=bool)
    bits[at] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


#: n-grams that are ordered last in the prefixes, and how often one must occur among so many of a
#: task to be a candidate.
FREQUENT, LEAST, AMONG = 50_000, 4, 1_000_000


def frequent_ngrams(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of at most FREQUENT n-grams that occur in most texts, and their weights
    (log2 of their numbers). All texts are counted; what is rare within every task is left out.
    This only orders prefixes, and links do not depend on the order."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for frame in frames:
            held += [shingle_hashes(t, n) for t in frame["text"]]
            size = sum(map(len, held))
            if size > AMONG:
                yield table(held)
                held = []
        yield table(held)

    def table(held: list[np.ndarray]) -> pd.DataFrame:
        found, times = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *held]), return_counts=True)
        return pd.DataFrame({"token": found[times >= LEAST].view(np.int64), "k": times[times >= LEAST]})

    totals = map_texts(texts, "text", count, "token long, k long").groupBy("token").agg(F.sum("k").alias("k"))
    rows = totals.orderBy(F.desc("k"), "token").limit(FREQUENT).toPandas()
    tokens = rows["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.log2(rows["k"].to_numpy(dtype=np.float64))[order].astype(np.int8)


def _rare_first(h: np.ndarray, frequent: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The hashes by rising weight, then hash; all that are not frequent weigh nothing."""
    if not len(frequent):
        return h
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    weight = np.where(frequent[at] == h, weights[at], 0)
    return h[np.argsort(weight, kind="stable")] if weight.any() else h


def _profiles(n: int, num: int, den: int, frequent: np.ndarray, weights: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, key, text in zip(frame["doc_id"], frame["text_key"], frame["text"], strict=True):
                h = shingle_hashes(text, n)
                if len(h):
                    prefix = _rare_first(h, frequent, weights)[: _prefix_length(len(h), num, den)]
                    rows.append((doc, key, len(h), xxhash.xxh3_128_digest(h.tobytes()), prefix.view(np.int64), _bitmap(h).tobytes()))
                else:
                    rows.append((doc, key, 0, None, None, None))
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n_shingles", "set_key", "prefix", "bitmap"])

    return run


class SignatureTree:
    """Rows of bitmaps under a tree: level 0 are leaves of LEAF rows, each level above joins
    FANOUT nodes. A node holds the OR of its rows' bitmaps, their size range, and the most
    members that any of its rows has beyond its set bits."""

    def __init__(self, sizes: np.ndarray, maps: np.ndarray) -> None:
        spare = sizes - np.bitwise_count(maps).sum(axis=1)
        self.rows = (maps, sizes, sizes, spare)
        self.levels = [self._join(self.rows, LEAF)]
        while len(self.levels[-1][1]) > 1:
            self.levels.append(self._join(self.levels[-1], FANOUT))

    @staticmethod
    def _join(level: tuple, by: int) -> tuple:
        maps, low, high, spare = level
        at = np.arange(0, len(low), by)
        return np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(spare, at)


def _possible(x: tuple, i: np.ndarray, y: tuple, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs can hold a link. A common bit stands for one common member and at most the
    members beyond the set bits more; a link needs an overlap of t/(1+t) of both sizes."""
    keep = den * x[2][i] >= num * y[1][j]
    keep &= den * y[2][j] >= num * x[1][i]
    at = np.flatnonzero(keep)
    for cut in np.array_split(at, max(1, len(at) * x[0].shape[1] // 1_000_000)):
        a, b = i[cut], j[cut]
        most = np.bitwise_count(x[0][a] & y[0][b]).sum(axis=1).astype(np.int64) + np.minimum(x[3][a], y[3][b])
        most = np.minimum(most, np.minimum(x[2][a], y[2][b]))
        keep[cut] = (num + den) * most >= num * (x[1][a] + y[1][b])
    return keep


def dual_traversal(tree: SignatureTree, left: np.ndarray, right: np.ndarray, num: int, den: int, joined=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (a < b, one of each side) that may link, a few leaf pairs at a time. left and
    right mark the rows of the two blocks; joined(a, b) tells leaves whose rows are already one
    component, which are skipped."""
    top = len(tree.levels) - 1
    stack = [(top, np.array([0]), np.array([0]))]
    total = len(left)
    while stack:
        level, i, j = stack.pop()
        nodes = tree.levels[level]
        keep = _possible(nodes, i, nodes, j, num, den)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        below, by = (len(tree.levels[level - 1][1]), FANOUT) if level else (total, LEAF)
        for cut in np.array_split(np.arange(len(i)), max(1, len(i) // 256)):
            a = (i[cut, None, None] * by + np.arange(by)[None, :, None]) + np.zeros((1, 1, by), dtype=np.int64)
            b = (j[cut, None, None] * by + np.arange(by)[None, None, :]) + np.zeros((1, by, 1), dtype=np.int64)
            a, b = a.ravel(), b.ravel()
            ok = (a < below) & (b < below) & ((a <= b) if level else (a < b))
            a, b = a[ok], b[ok]
            if level:
                stack.append((level - 1, a, b))
                continue
            ok = (left[a] & right[b]) | (right[a] & left[b])
            a, b = a[ok], b[ok]
            if joined is not None and len(a):
                ok = ~joined(a, b)
                a, b = a[ok], b[ok]
            ok = _possible(tree.rows, a, tree.rows, b, num, den)
            if ok.any():
                yield a[ok], b[ok]


class _Union:
    """Union-find over the few hundred rows of one task's block pair, from what is joined already."""

    def __init__(self, roots: np.ndarray) -> None:
        _, first, number = np.unique(roots, return_index=True, return_inverse=True)
        self.root = first[number]

    def same(self, a, b):
        return self.root[a] == self.root[b]

    def join(self, a: int, b: int) -> bool:
        x, y = self.root[a], self.root[b]
        if x == y:
            return False
        self.root[self.root == max(x, y)] = min(x, y)
        return True


def _folded(bitmap: np.ndarray) -> np.ndarray:
    """Half as many bits, each the OR of two neighbours."""
    bits = np.unpackbits(bitmap.view(np.uint8), bitorder="little").reshape(-1, 2).any(axis=1)
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _ordered(group: pd.DataFrame) -> pd.DataFrame:
    """By size, then bitmap: alike rows come to lie in the same leaves."""
    if "members" in group:
        group = group.assign(bitmap=[_bitmap(np.frombuffer(m, dtype=np.uint64)).tobytes() for m in group["members"]])
    return group.sort_values(["n", "bitmap", "id"], kind="stable", ignore_index=True)


def _group_links(num: int, den: int, exact: bool):
    """For each run of rows of one block pair: the links that join its rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for group in runs(frames, ["g1", "g2", "p", "q"]):
            if len(group) > 1:
                out += _links(_ordered(group), num, den, exact)
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["src", "dst"])
                out = []
        yield pd.DataFrame(out, columns=["src", "dst"])

    return run


def _links(group: pd.DataFrame, num: int, den: int, exact: bool) -> list[tuple]:
    """Links of one block pair. Bitmaps come in powers of two, and sizes that may link differ by
    less than a doubling: each width is compared with itself and with the next, folded."""
    ids, sizes = group["id"].to_numpy(), group["n"].to_numpy().astype(np.int64)
    p, q, block, low = group["p"].iat[0], group["q"].iat[0], group["b"].to_numpy(), group["low"].to_numpy()
    maps = [np.frombuffer(m, dtype=np.uint64) for m in group["bitmap"]]
    sets = [np.frombuffer(m, dtype=np.uint64) for m in group["members"]] if exact else None
    widths, union, out = np.array([len(m) for m in maps]), _Union(group["root"].to_numpy()), []
    for width in np.unique(widths):
        at = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(at) < 2:
            continue
        wide = low[at].astype(np.int8) + 2 * (widths[at] > width)
        tree = SignatureTree(sizes[at], np.stack([maps[i] if len(maps[i]) == width else _folded(maps[i]) for i in at]))

        def skip(a, b, at=at, wide=wide):
            return union.same(at[a], at[b]) | ((wide[a] & wide[b]) > 0)

        for a, b in dual_traversal(tree, block[at] == p, block[at] == q, num, den, skip):
            for x, y in zip(at[a], at[b], strict=True):
                if union.root[x] == union.root[y]:
                    continue
                if exact:
                    common = _overlap(sets[x], sets[y])
                    if den * common < num * (sizes[x] + sizes[y] - common):
                        continue
                union.join(x, y)
                out.append((ids[x], ids[y]))
    return out


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _large(members: DataFrame, block: int) -> DataFrame:
    """The groups g1 of more than `block` members: few, at most members / block."""
    return stored(members.groupBy("g1").agg(F.count("*").alias("size")).where(F.col("size") > block).select("g1"))


def _dealt(members: DataFrame, large: DataFrame, roots: DataFrame, block: int, num: int, den: int) -> DataFrame:
    """Say which tasks compare the members (g1, id, n) of each group g1. Members of the large
    groups that have one of the roots (id, root) are joined already.

    A group of up to `block` members is one task. A larger one is split by size class: key g2
    gets the classes g2 and g2 - 1, whose sizes may link; `low` marks rows of the smaller class,
    whose pairs with each other belong to another key. What is still larger is dealt out as
    pairs of blocks: p and q number the pair, b the member's own block. Rows of a key's most
    frequent root have blocks of their own, which do not meet each other: a group of n rows of
    which m are not of that root is sent about n * m / block times, and not at all if m is 0. The
    large groups are few and are joined by broadcast, so that a large group's rows need not meet. Keys without a row of their own class, and rows whose neighbours by size
    are too small or too large to link are dropped.
    """
    zero = F.lit(0)
    small = matching(members, large, "g1", "left_anti").select("g1", zero.alias("g2"), zero.alias("p"), zero.alias("q"), zero.alias("b"), F.lit(False).alias("low"), "id", "n", F.col("id").alias("root"))
    rooted = matching(members, large, "g1").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    classed = rooted.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num))) + F.lit(1e-9)).cast("int"))
    split = F.array(F.struct(F.col("c").alias("g2"), F.lit(False).alias("low")), F.struct((F.col("c") + 1).alias("g2"), F.lit(True).alias("low")))
    keyed = classed.withColumn("key", F.explode(split)).select("g1", "key.g2", "key.low", "id", "n", "root")
    counted = keyed.groupBy("g1", "g2", "root").agg(F.count("*").alias("k"), F.min("low").alias("only_low"))
    sized = counted.groupBy("g1", "g2").agg(F.sum("k").alias("size"), F.max(F.struct("k", "root")).alias("top"), F.min("only_low").alias("only_low"))
    sized = stored(sized.where("size > top.k and not only_low").select("g1", "g2", F.col("top.root").alias("major"), F.ceil(F.col("top.k") / block).cast("int").alias("own"), F.ceil((F.col("size") - F.col("top.k")) / block).cast("int").alias("rest")))
    hashed, joined = F.xxhash64("id"), F.col("root") == F.col("major")
    dealt = matching(keyed, sized, ["g1", "g2"]).withColumn("b", F.when(joined, F.pmod(hashed, F.col("own"))).otherwise(F.col("own") + F.pmod(hashed, F.col("rest"))).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.when(joined, F.col("own")).otherwise(zero), F.col("own") + F.col("rest") - 1)))
    pairs = small.unionByName(other.select("g1", "g2", F.least("b", "other").alias("p"), F.greatest("b", "other").alias("q"), "b", "low", "id", "n", "root"))
    by_size = Window.partitionBy("g1", "g2", "p", "q").orderBy("n", "id")
    near = (F.lead("n").over(by_size) * num <= F.col("n") * den) | (F.col("n") * num <= F.lag("n").over(by_size) * den)
    found = stored(pairs.withColumn("near", near).where("near").drop("near", "n"))
    unstore(sized)
    return found


def _firsts(members: DataFrame) -> DataFrame:
    """Pairs (id, first) of each member and the first one of its group, each once."""
    first = members.groupBy("g1").agg(F.min("id").alias("first"))
    return matching(members.select("g1", "id"), first, "g1").where("id != first").select("id", "first").distinct()


def _paired(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs with these columns of both: of the id, and of the first one, with a 0 appended."""
    firsts = rows.select(F.col("id").alias("first"), *(F.col(c).alias(f"{c}0") for c in columns))
    return pairs.join(rows.select("id", *columns), "id").join(firsts, "first")


def _first_links(num: int, den: int, exact: bool):
    """Of the pairs: those that may link by their bitmaps, or that do by their sets."""

    def by_bitmap(frame: pd.DataFrame) -> np.ndarray:
        keep = np.zeros(len(frame), dtype=bool)
        maps = [[np.frombuffer(m, dtype=np.uint64) for m in frame[c]] for c in ("bitmap", "bitmap0")]
        widths = np.array([[len(m) for m in side] for side in maps]).reshape(2, -1)
        sizes = frame[["n", "n0"]].to_numpy(dtype=np.int64).T
        for width in np.unique(widths.min(axis=0)):
            # A link needs sizes within a doubling, and so widths within one.
            at = np.flatnonzero((widths.min(axis=0) == width) & (widths.max(axis=0) <= 2 * width))
            if len(at):
                x, y = ((np.stack([side[i] if len(side[i]) == width else _folded(side[i]) for i in at]), n[at]) for side, n in zip(maps, sizes, strict=True))
                x, y = ((m, n, n, n - np.bitwise_count(m).sum(axis=1)) for m, n in (x, y))
                own = np.arange(len(at))
                keep[at] = _possible(x, own, y, own, num, den)
        return keep

    def by_set(frame: pd.DataFrame) -> np.ndarray:
        common = np.array([_overlap(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)) for x, y in zip(frame["members"], frame["members0"], strict=True)], dtype=np.int64)
        return den * common >= num * (frame["n"].to_numpy(dtype=np.int64) + frame["n0"].to_numpy(dtype=np.int64) - common)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = frame[["id", "first"]][(by_set if exact else by_bitmap)(frame)]
            yield found.set_axis(["src", "dst"], axis=1)

    return run


def ngram_jaccard_join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, block: int = 400) -> DataFrame:
    """Exact components of word n-gram Jaccard similarity >= num/den over docs (doc_id, text).

    Returns doc_id, n_shingles (size of the set), component_id (smallest doc_id reachable by
    links, its own included). Null, empty or white-space texts have an empty set and link with
    nothing; equal texts always link (if they have a word); rows that repeat a doc_id are each
    returned, by their own text. Further columns are ignored. An empty table gives an empty
    result. A row of null doc_id is kept, its text links like any other, and it gets the smallest
    doc_id of its component, null if there is none.
    """
    base = docs.select(filled_id("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    frequent = frequent_ngrams(base.select("text"), n)
    profile = stored(map_texts(base, "text", _profiles(n, num, den, *frequent), "doc_id long, text_key long, n_shingles int, set_key binary, prefix array<long>, bitmap binary"))
    # A class is one set; its texts are read again by one of its rows, the source.
    source = F.min(F.struct("doc_id", "text_key")).alias("source")
    sets = profile.where("set_key is not null").groupBy("set_key").agg(source, F.min(emptied_id("doc_id")).alias("least"), F.first("n_shingles").alias("n"))
    classes = stored(sets.select(F.monotonically_increasing_id().alias("id"), "set_key", "least", "n", "source.*"))
    keyed = stored(profile.select(emptied_id("doc_id"), "n_shingles", "set_key"))
    sources = classes.select("id", "n", "doc_id", "text_key")
    marked = stored(matching(profile.select("doc_id", "text_key", "prefix", "bitmap"), sources, ["doc_id", "text_key"]).select("id", "n", "prefix", "bitmap"))
    unstore(profile)
    if marked.count() != classes.count():  # rows that repeat a source are as one
        repeated, marked = marked, stored(marked.dropDuplicates(["id"]))
        unstore(repeated)

    tokens = marked.select(F.explode("prefix").alias("token"), "id").repartition(parts(docs), "token")
    shared = tokens.groupBy("token").agg(F.count("*").alias("k"), F.expr("bit_xor(xxhash64(id))").alias("h1"), F.expr("bit_xor(xxhash64(7L, id))").alias("h2")).where("k > 1")
    chosen = shared.groupBy("k", "h1", "h2").agg(F.min("token").alias("token")).select("token")
    members = stored(matching(tokens, chosen, "token").withColumnRenamed("token", "g1").join(classes.select("id", "n"), "id"))
    signed = marked.select("id", "n", "bitmap")
    large = _large(members, block)
    first = stored(map_pairs(_paired(_firsts(matching(members, large, "g1")), signed, ["n", "bitmap"]), num, den, False))
    joined = connected_components(first)
    near = _dealt(members, large, joined, block, num, den)
    for df in (members, large, joined):
        unstore(df)
    families = connected_components(first.union(_linked(near.join(signed, "id"), num, den, False)))
    for df in (first, near, marked):
        unstore(df)

    named = stored(sources.drop("n").join(families.select("id"), "id", "left_semi"))
    wanted = matching(base, named, ["doc_id", "text_key"]).select("id", "text")
    texts = stored(map_texts(wanted, "text", _member_sets(n), "id long, n int, members binary"))
    if texts.count() != named.count():
        repeated, texts = texts, stored(texts.dropDuplicates(["id"]))
        unstore(repeated)
    inside = families.join(texts.select("id", "n"), "id").withColumnRenamed("root", "g1")
    large = _large(inside, block)
    first = stored(map_pairs(_paired(_firsts(matching(inside, large, "g1")), texts, ["n", "members"]), num, den, True))
    near = _dealt(inside, large, first.toDF("id", "root"), block, num, den)
    links = connected_components(first.union(_linked(near.join(texts, "id"), num, den, True)))
    for df in (large, first, near, texts, families, named):
        unstore(df)

    rooted = classes.join(links, "id", "left").select("set_key", "least", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    found = rooted.join(least, "root").select("set_key", "component")
    return keyed.join(found, "set_key", "left").select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def map_pairs(pairs: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    return pairs.mapInPandas(_first_links(num, den, exact), "src long, dst long")


def _member_sets(n: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["id"], frame["text"], strict=True):
                h = shingle_hashes(text, n)
                rows.append((doc, len(h), h.tobytes()))
            yield pd.DataFrame(rows, columns=["id", "n", "members"])

    return run


def _linked(dealt: DataFrame, num: int, den: int, exact: bool) -> DataFrame:
    keys = ["g1", "g2", "p", "q"]
    return dealt.repartition(parts(dealt), *keys).sortWithinPartitions(*keys).mapInPandas(_group_links(num, den, exact), "src long, dst long").distinct()
