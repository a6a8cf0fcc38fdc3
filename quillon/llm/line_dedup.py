"""Fuzzy line de-duplication by MinHash, with DataFrame functions only.

Every line's character shingles are hashed; HASHES minima per line form its signature. Lines
whose signatures agree in a band fall into one bucket, and every pair of a bucket is a candidate.
A pair is compared exactly unless its ends are one component by then, or parities of the shingles
prove that it can't be alike. First each line meets that line of its buckets that is in most and
largest buckets, then those of its other buckets that this has not joined, which joins most of a
family without looking at all of its pairs; then come the pairs that are still open, in salted
blocks. Linked lines are joined by distributed union-find, and of each component, equal
lines included, the first line of the corpus stays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, free_name, matching, stored, unstore
from .components import connected_components

SHINGLE = 8
HASHES = 13
#: Bands of four minima, the lines of the projective plane of order 3: any two bands share one
#: minimum. A pair of similarity 0.8 shares a band with probability 0.976 (0.9: 0.999).
BANDS = [tuple(sorted((start + step) % HASHES for step in (0, 1, 3, 9))) for start in range(HASHES)]
NUM, DEN = 8, 10
#: 64-bit words of a line's parities.
WORDS = 16
#: Shingles that one row holds on the way to the minima, as measured on check_s: 6, 8 and 10 took
#: 25, 27 and 33 CPU seconds.
STEP = 6
#: Members of a set that one row holds on the way to its parities.
TOGETHER = 4
#: Lines of a bucket that meet in one task: those outside its largest component by all of them.
MINOR_ROWS, ALL_ROWS = 1024, 2048


def _masks() -> list[int]:
    """HASHES well-spread signed 32-bit numbers: multiples of the golden ratio."""
    return [((k + 1) * 0x9E3779B1 & 0xFFFFFFFF) - (1 << 31) for k in range(HASHES)]


def _stored(df: DataFrame) -> DataFrame:
    """stored() for hashes and texts, which hardly repeat."""
    return stored(df, dictionary=False)


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, further columns, pos and line of every line that is not blank."""
    return docs.select("doc_id", *more, F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) <> ''")


def _code() -> Column:
    return F.encode("line", "UTF-16BE")


def _coded(docs: DataFrame) -> DataFrame:
    """id (a 64-bit hash) and code (UTF-16) of every line."""
    return _lines(docs).select(F.xxhash64("line").alias("id"), _code().alias("code"))


def _last(code: str | Column) -> Column:
    """Number of the last shingle of a line in UTF-16."""
    return F.greatest(F.lit(0), (F.length(code) / 2).cast("int") - SHINGLE)


def signatures(docs: DataFrame) -> DataFrame:
    """id and the minima m0, m1, ... of every distinct line of docs (doc_id, text). A shingle is
    SHINGLE UTF-16 code units (the whole line if shorter), cut at a fixed cost, with a 32-bit hash.
    Xor with a mask permutes the hashes, so that each minimum is an independent choice from the
    shingles. A row takes STEP shingles at once (the last one again where there are fewer), so
    that a line is looked up less often."""
    starts = _coded(docs).withColumn("last", _last("code")).select("id", "code", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(STEP))).alias("i"))
    hashes = starts.select("id", *(F.expr(f"hash(substring(code, 2 * if(i + {k} < last, i + {k}, last) + 1, {2 * SHINGLE}))").alias(f"h{k}") for k in range(STEP)))
    least = hashes.select("id", *(F.least(*(F.col(f"h{k}").bitwiseXOR(F.lit(m)) for k in range(STEP))).alias(f"m{j}") for j, m in enumerate(_masks())))
    return least.groupBy("id").agg(*(F.min(f"m{j}").alias(f"m{j}") for j in range(HASHES)))


def _buckets(sig: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (src, dst) of the band buckets of two lines, and (bucket, id, k) of those of k > 2
    lines; of buckets with the same lines one stays. A bucket of two is told by its least and
    largest id, so only the bands of larger ones are made again with their lines."""
    keys = F.array(*(F.xxhash64(F.lit(b), *(f"m{j}" for j in band)) for b, band in enumerate(BANDS)))
    every = sig.select("id", F.explode(keys).alias("bucket"))
    shared = _stored(every.groupBy("bucket").agg(F.count("*").alias("k"), F.max("id").alias("src"), F.min("id").alias("dst")).where("k > 1"))
    couples = _stored(shared.where("k = 2").select("src", "dst").distinct())
    rows = _stored(matching(every, shared.where("k > 2").select("bucket"), "bucket"))
    alike = rows.groupBy("bucket").agg(F.count("*").alias("k"), F.expr("bit_xor(id)").alias("x"), F.expr("bit_xor(xxhash64(id))").alias("y"))
    chosen = alike.groupBy("k", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "k")
    out = _stored(rows.join(chosen, "bucket"))
    for df in (shared, rows):
        unstore(df)
    return couples, out


def _members(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows with what pairs are judged by: n (the size of the line's set), its parities b0, b1,
    ... (each bit tells whether an odd number of shingles falls on it), and order: lines that are
    in larger buckets come later (ties by hash)."""
    sets = texts.select("id", _shingle_set("code").alias("hashes")).select("id", "hashes", F.size("hashes").alias("n"))
    some = sets.select("id", "n", "hashes", F.explode(F.expr(f"sequence(0, n - 1, {TOGETHER})")).alias("i"))
    each = range(TOGETHER)
    bits = some.select("id", "n", *(F.expr(f"get(hashes, i + {k})").alias(f"h{k}") for k in each)).select(
        "id", "n", *(F.expr(f"h{k} & {WORDS - 1}").alias(f"w{k}") for k in each), *(F.expr(f"shiftleft(1L, int(shiftright(h{k}, 8) & 63))").alias(f"x{k}") for k in each)
    )
    word = (F.expr(f"bit_xor({' ^ '.join(f'if(w{k} = {j}, x{k}, 0L)' for k in each)})").alias(f"b{j}") for j in range(WORDS))
    maps = bits.groupBy("id").agg(F.max("n").alias("n"), *word)
    weight = F.least(F.sum("k"), F.lit(1 << 42)) * F.lit(1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    return rows.drop("k").join(maps, "id").join(rows.groupBy("id").agg(weight.alias("order")), "id")


def _may_link(a: str, b: str) -> Column:
    """Whether two rows can be alike. Sets of a Jaccard similarity of t or more differ in at most
    (1 - t) / (1 + t) of their members together. Common members cancel out of the parities, so
    each bit in which those differ stands for a member that only one of the sets has."""
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"{a}.b{j}").bitwiseXOR(F.col(f"{b}.b{j}"))) for j in range(WORDS)))
    return differ * (DEN + NUM) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (DEN - NUM)


def _counted(named: DataFrame) -> DataFrame:
    """Of each bucket with lines of several components: n lines, n and root of the largest one."""
    roots = named.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    return roots.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("major"), F.sum("n").alias("n")).where("n > major.n").select("bucket", "n", F.col("major.n").alias("major_n"), F.col("major.root").alias("major"))


def _led_pairs(members: DataFrame) -> DataFrame:
    """Pairs (id, leader, order) of each line with the last line (by order) of its bucket."""
    best = members.groupBy("bucket").agg(F.max("order").alias("order"))
    leaders = members.join(best, ["bucket", "order"]).select("bucket", "id", "n", "order", *(f"b{j}" for j in range(WORDS)))
    on = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.id") != F.col("b.id")) & _may_link("a", "b")
    met = members.alias("a").join(leaders.alias("b"), on)
    return met.select(F.col("a.id").alias("id"), F.col("b.id").alias("leader"), F.col("b.order").alias("order")).distinct()


def _ends(led: DataFrame) -> DataFrame:
    return led.select(F.greatest("id", "leader").alias("src"), F.least("id", "leader").alias("dst"))


def _led_by(led: DataFrame, links: DataFrame) -> DataFrame:
    """id and root: the last leader (by order) of led that a line is linked with. Lines of one
    root are of one component, since each is linked with that leader or is it."""
    both = led.withColumns({"src": F.greatest("id", "leader"), "dst": F.least("id", "leader")})
    best = both.join(links, ["src", "dst"]).groupBy("id").agg(F.max(F.struct("order", "leader")).alias("best"))
    return best.select("id", F.col("best.leader").alias("root"))


def _other_roots(led: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs of led whose ends have different roots (a line without one is its own)."""
    own = led.join(roots.withColumnRenamed("root", "r1"), "id", "left")
    both = own.join(roots.select(F.col("id").alias("leader"), F.col("root").alias("r2")), "leader", "left")
    return both.where(F.coalesce("r1", "id") != F.coalesce("r2", "leader")).select("id", "leader", "order")


def _open_pairs(named: DataFrame) -> DataFrame:
    """Every pair of a bucket whose ends are of different components and may be alike, once. The
    lines outside a bucket's largest component meet all of its lines, in salted blocks of both,
    so that no task grows with the bucket; a pair of several buckets counts in the least one."""
    blocks = _stored(_counted(named).select("bucket", "major", F.ceil((F.col("n") - F.col("major_n")) / MINOR_ROWS).cast("int").alias("nl"), F.ceil(F.col("n") / ALL_ROWS).cast("int").alias("nr")))
    mixed = named.drop("order").join(blocks, "bucket")
    dealt = _stored(mixed.join(mixed.groupBy("id").agg(F.collect_set("bucket").alias("buckets")), "id"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    minor = dealt.where("root <> major").withColumn("l", F.pmod(F.xxhash64("id"), F.col("nl")).cast("int")).withColumn("r", spread("nr")).alias("a")
    every = dealt.withColumn("r", F.pmod(F.xxhash64("id"), F.col("nr")).cast("int")).withColumn("l", spread("nl")).alias("b")
    once = (F.col("b.root") == F.col("b.major")) | (F.col("a.id") > F.col("b.id"))
    on = reduce(Column.__and__, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("bucket", "l", "r")))
    first = F.array_min(F.array_intersect("a.buckets", "b.buckets")) == F.col("a.bucket")
    met = minor.join(every, on & (F.col("a.root") != F.col("b.root")) & once & _may_link("a", "b") & first)
    # One end may be outside of the largest component here and the other one there.
    found = _stored(met.select(F.greatest("a.id", "b.id").alias("src"), F.least("a.id", "b.id").alias("dst")).distinct())
    for df in (blocks, dealt):
        unstore(df)
    return found


def _shingle_set(code: str) -> Column:
    """Distinct 64-bit shingle hashes of an encoded line. The bytes are a lambda's variable: as a
    column they would be copied for every shingle. The sequence is that of the bytes, since sums
    in a lambda cost as much as the hash."""
    hashes = lambda c: F.transform(F.sequence(F.lit(1), 2 * _last(c) + 1, F.lit(2)), lambda at: F.xxhash64(F.substring(c, at, F.lit(2 * SHINGLE))))
    return F.array_distinct(F.element_at(F.transform(F.array(F.col(code)), hashes), 1))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (src, dst) of an exact Jaccard similarity of at least NUM / DEN."""
    joined = pairs
    for end in ("src", "dst"):
        joined = joined.join(texts.select(F.col("id").alias(end), F.col("code").alias(f"{end}_code")), end)
    # A filter would be pushed below the sets and make each of them twice; explode() is not.
    sets = joined.select("src", "dst", _shingle_set("src_code").alias("a"), _shingle_set("dst_code").alias("b"))
    alike = F.size(F.array_intersect("a", "b")) * (DEN + NUM) >= (F.size("a") + F.size("b")) * NUM
    return sets.select("src", "dst", F.explode(F.when(alike, F.array(F.lit(True)))).alias("alike")).select("src", "dst")


def similar_lines(docs: DataFrame) -> DataFrame:
    """Components (id, root) of the hashes of lines under verified links of different lines."""
    sig = _stored(signatures(docs))
    couples, large = _buckets(sig)
    unstore(sig)
    wanted = _stored(couples.select(F.col("src").alias("id")).union(couples.select("dst")).union(large.select("id")).distinct())
    named = _lines(docs).select(F.xxhash64("line").alias("id"), "line")
    texts = _stored(matching(named, wanted, "id", "left_semi").groupBy("id").agg(F.min("line").alias("line")).select("id", _code().alias("code")))
    unstore(wanted)
    members = _stored(_members(large, matching(texts, large.select("id").distinct(), "id", "left_semi")))
    led = _stored(_led_pairs(members))
    # First each line meets its last leader only: in a family that is the same line for most.
    best = led.groupBy("id").agg(F.max(F.struct("order", "leader")).alias("best"))
    first = best.select("id", F.col("best.leader").alias("leader"), F.col("best.order").alias("order"))
    # Most buckets hold two lines: their pair is compared without further ado.
    met = _stored(couples.union(_ends(first)).distinct())
    joined = _stored(_verified(met, texts))
    roots = _stored(_led_by(first, joined))
    rest = _stored(_other_roots(led, roots).join(first.select("id", "leader"), ["id", "leader"], "left_anti"))
    again = _stored(_ends(rest).distinct().join(met, ["src", "dst"], "left_anti"))
    added = _stored(_verified(again, texts))
    late = _led_by(rest, added).withColumnRenamed("root", "late")
    labels = roots.join(late, "id", "full").select("id", F.coalesce("root", "late").alias("root"))
    tried, links = met.union(again), joined.union(added)
    named = _stored(members.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id")))
    for df in (couples, large, members, led, roots, rest):
        unstore(df)
    pairs = _open_pairs(named)
    more = _stored(_verified(pairs.join(tried, ["src", "dst"], "left_anti"), texts))
    found = connected_components(links.union(more))
    for df in (named, texts, met, again, joined, added, pairs, more):
        unstore(df)
    return found


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Remove from docs (doc_id, text, ...) every line that an earlier line makes superfluous.

    Lines are alike if equal, or linked by a Jaccard similarity of 0.8 or more of their sets of
    8-character shingles; of each component of alike lines the first stays (least doc_id, nulls
    last, then a hash of the text, then position). Blank lines always stay and are compared with
    nothing. Every row is returned with its other columns; text loses its removed lines, and
    n_lines_removed (replaced if present) counts them. Null and empty texts stay as they are; a
    text may become empty. Rows that repeat a doc_id (null ones too) with other texts are each
    judged by their own lines; of rows that repeat both, the equal places stay or go together. An
    n_chars column is set to the new length. An empty table gives an empty result.
    """
    base = docs.select("doc_id", "text")
    roots = similar_lines(base)
    row = F.xxhash64("doc_id", "text").alias("row")
    places = _lines(base.select("doc_id", "text", row), "row").select("doc_id", "row", "pos", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(7), F.col("line")).alias("k2"))
    named = _stored(matching(places, roots, "id", "left").select("doc_id", "row", "pos", F.coalesce("root", "id").alias("g1"), F.when(F.col("root").isNull(), F.col("k2")).otherwise(F.lit(0)).alias("g2")))
    unstore(roots)
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "pos")
    firsts = _stored(named.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n"))
    gone = matching(named, firsts, ["g1", "g2"]).where((F.col("row") != F.col("first.row")) | (F.col("pos") != F.col("first.pos")))
    at, removed = free_name(docs, "_row"), free_name(docs, "_removed")
    drops = _stored(gone.groupBy(F.col("row").alias(at)).agg(F.sort_array(F.collect_set("pos")).alias(removed)))
    for df in (named, firsts):
        unstore(df)
    kept = docs.drop("n_lines_removed")
    joined = kept.withColumn(at, row).join(F.broadcast(drops) if fits_broadcast(drops) else drops, at, "left")
    lines = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(removed, i))
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    out = joined.withColumn("text", text).withColumn("n_lines_removed", F.coalesce(F.size(removed), F.lit(0)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*kept.columns, "n_lines_removed")
