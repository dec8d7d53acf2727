"""Jaccard self-join of word shingles by partitions of the universe, and its connected components.

Sets whose Jaccard similarity is at least ``percent`` differ in a bounded number of shingles. Sizes are cut into bands,
each by the square of that ratio; sets that can link lie in one band or in neighbouring ones. A set signs in its own
band (at home) and, if it is large enough, in the next one (as a guest; two guests are not compared there). For a band,
H is the most shingles in which two linked sets can differ. Hashing parts the universe into segments, and by the
pigeonhole principle linked sets agree on segments. Each band is allotted one of two schemes:

* ``exact``: H + 1 + E segments. Two linked sets that can differ in at most M <= H shingles agree on all but M, so a set
  with fewer signatures that another set has is out, and of the others it keeps the rarest: as many as leave too few
  for a link. Both sets rank an agreed signature alike, so at least one that they share is left.
* ``deletion``: H // 2 + 1 segments, so one at least differs in at most one shingle. A set signs every segment, and
  every segment without one of its shingles; a whole segment meets whole ones and shortened ones.

The allotment compares costs: rows signed a set, and which of them are signatures that a share of all sets have, both
measured on a sample of about ``SAMPLE`` sets (all sets of a smaller table, whose shares are rougher). Larger sets sign
exactly, since a deletion for each shingle is always more. The sample also names the hot signatures, which are spread
over salts when signatures are brought together.

Copies collapse first: sets are vertices by 64-bit identity. The sets that share a signature are strung in an order that
differs from round to round, in blocks of bounded size, and each set is compared with the nearest of its neighbours. What
is left are sets of different components that still share signatures. There shingles that only one component has are
counted: a set's partner in another component has none of them, which bounds the partner's size and rules most sets out
altogether. What still can link is compared block by block. No link between components is missed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.byte_grams import buffer, slices
from cartulary.llm.shared import Scratch, table, with_columns

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_BYTES = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z made small) of texts that lie end to end, and each word's text."""
    b = _LOWER[raw]
    letter = ~_SPACE[b]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = starts[:-1][np.diff(starts) > 0]
    first[inner] = letter[inner]
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lengths = np.diff(np.append(at, len(b)))
    place = np.arange(at[0], len(b)) - np.repeat(at, lengths)
    powers = np.cumprod(np.full(int(place.max()) + 1, _A, np.uint64))
    values = np.where(letter[at[0] :], _BYTES[b[at[0] :]] * powers[place], _U(0))
    return mixed(np.add.reduceat(values, at - at[0])), np.searchsorted(starts, at, side="right") - 1


def shingle_sets(raw: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words; a shorter text is one shingle."""
    with np.errstate(over="ignore"):
        h, text = word_hashes(raw, starts)
        n_texts = len(starts) - 1
        ends = np.searchsorted(text, np.arange(n_texts + 1))
        rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
        for i in range(width):
            rolled = rolled * _A + h[i : i + len(rolled)]
        rolled = mixed(rolled)
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            else:
                whole = _U(0)
                for x in h[a:b]:
                    whole = whole * _A + x
                out.append(mixed(np.array([whole + _U(b - a)], np.uint64))[: b - a])
        return out


def differ_at_most(total: int, percent: int) -> int:
    """The most shingles in which two linked sets of ``total`` shingles together can differ."""
    common = -(-percent * total // (100 + percent))
    return total - 2 * common


def most_apart(total: int, percent: int) -> int:
    """The most shingles in which two linked sets of at most ``total`` shingles together can differ."""
    return max(differ_at_most(t, percent) for t in range(max(total - 3, 0), total + 1))


@dataclass(frozen=True)
class Band:
    """Sizes from ``low`` to ``high``; ``most`` is H, ``bits`` the size of the parity bitmaps."""

    index: int
    low: int
    high: int
    most: int
    deletion: bool
    segments: int
    bits: int


MOST_BANDS = 200
#: Allotment and hot signatures are measured on about so many sets, or on all where there are fewer; a signature is hot if
#: more than this share of them have it (and two at least).
SAMPLE, HOT_SHARE = 10_000, 0.001
#: What a hot row costs, in rows that meet few others; and the largest sets that may sign deletions: a set signs one for
#: each of its shingles.
HOT_COST, SHORT = 16, 64
SALTS = 1024


def band(index: int, low: int, high: int, percent: int, deletion: bool) -> Band:
    most = most_apart(2 * high, percent)
    exact = most + 1 + -(-(most + 1) // 4)
    return Band(index, low, high, most, deletion, most // 2 + 1 if deletion else exact, 64 * max(2, -(-12 * most // 64)))


def allotted(exact: tuple[int, int], deletion: tuple[int, int]) -> bool:
    """Whether deletion is the cheaper scheme, by (rows, hot rows) of the same sampled sets under either.

    Only shares and ratios count: a larger table of the same kind of texts is allotted alike.
    """
    cost = lambda rows, hot: rows + HOT_COST * hot
    return 0 < deletion[0] and cost(*deletion) < cost(*exact)


def band_limits(percent: int) -> list[int]:
    """The largest size of each band; no two different sets within the first can link."""
    high = 1
    while 100 * high < percent * (high + 1):
        high += 1
    limits = [high]
    while len(limits) < MOST_BANDS and limits[-1] < 2**40:
        limits.append(max(-(-10_000 * limits[-1] // (percent * percent)), limits[-1] + 1))
    return limits


def signatures(x: np.ndarray, band: Band, home: bool) -> list[np.ndarray]:
    """Keys of the segments a set signs in a band; the lowest two bits say whole (2) and at home (1)."""
    with np.errstate(over="ignore"):
        g = mixed(x + _C)
        segment = (((x >> _U(32)) * _U(band.segments)) >> _U(32)).astype(np.int64)
        counts = np.bincount(segment, minlength=band.segments)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(g)])
        ends = np.cumsum(counts)
        sums = upto[ends] - upto[ends - counts]
        own = mixed(np.arange(band.segments, dtype=np.uint64) * _B + _U(band.index * 2 + band.deletion + 1) * _A)
        keys = mixed(sums + own)
        low = _U(home)
        if not band.deletion:
            return [(keys & ~_U(3)) | _U(2) | low]
        less = mixed(sums[segment] - g + own[segment])
        return [(keys & ~_U(3)) | _U(2) | low, (less & ~_U(3)) | low]


def parity(x: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap with a bit for each shingle, bits that meet cancelling out."""
    with np.errstate(over="ignore"):
        place = (mixed(x + _A) % _U(bits)).astype(np.int64)
    odd = np.bincount(place, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def identity(x: np.ndarray) -> int:
    """64 bits of a whole set; of ten billion different sets, two pairs are expected to share one."""
    with np.errstate(over="ignore"):
        one, two = np.sum(mixed(x + _B)), np.sum(mixed(x ^ _A))
        return int(mixed(np.array([one * _A + two + _U(len(x))], np.uint64)).view(np.int64)[0])


@lru_cache(maxsize=8)
def _limits(percent: int) -> np.ndarray:
    return np.array(band_limits(percent), np.int64)


def bands_of(percent: int, deletion: frozenset[int] = frozenset()) -> list[Band]:
    """All bands; those whose index is in ``deletion`` sign deletions."""
    limits = _limits(percent)
    return [band(i, int(limits[i - 1]) + 1, int(limits[i]), percent, i in deletion) for i in range(1, len(limits))]


def _own_bands(n: int, percent: int, bands: list[Band]) -> tuple[Band | None, Band | None]:
    """Where a set of ``n`` shingles signs: at home and as a guest."""
    limits = _limits(percent)
    at = int(np.searchsorted(limits, n))
    return bands[at - 1] if at > 0 else None, bands[at] if 100 * n >= percent * (int(limits[at]) + 1) else None


def agreed(n: int, own: Band | None, percent: int) -> int:
    """On how many signatures of a band a set of ``n`` shingles agrees with any set it links with there."""
    if own is None:
        return 0
    return 1 if own.deletion else own.segments - most_apart(n + min(own.high, 100 * n // percent), percent)


def described(docs: DataFrame, width: int, percent: int, bands: list[Band]) -> DataFrame:
    """doc_id, text_hash, n_shingles, uid (the 64-bit identity of the set; equal sets have equal ones), and how many
    signatures it needs at home and as a guest."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            sets = shingle_sets(*buffer(batch.column("text")), width)
            out = {"n_shingles": [len(x) for x in sets], "uid": [identity(x) for x in sets], "need_home": [], "need_guest": []}
            for x in sets:
                home, guest = _own_bands(len(x), percent, bands) if len(x) else (None, None)
                out["need_home"].append(agreed(len(x), home, percent))
                out["need_guest"].append(agreed(len(x), guest, percent))
            yield with_columns(batch, ["doc_id", "text_hash"], out)

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return hashed.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, uid long, need_home long, need_guest long")


def measured(docs: DataFrame, width: int, percent: int, n_docs: int, scratch: Scratch) -> tuple[list[Band], np.ndarray]:
    """The allotted bands and the sorted hot signatures, from a sample of the texts by hash.

    The driver gets a row a band and scheme, and the hot signatures: of the at most ``SAMPLE`` sets each signs a bounded
    number, and at least two share a hot one.
    """
    share = min(1.0, SAMPLE / max(n_docs, 1))
    sample = docs.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_003)) < share * 1_000_003).select("text")
    exact = bands_of(percent)
    other = [band(b.index, b.low, b.high, percent, True) for b in exact]

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            out = [np.empty((0, 4), np.int64)]
            for x in shingle_sets(*buffer(batch.column("text")), width):
                for own, choice, home in zip(_own_bands(len(x), percent, exact), _own_bands(len(x), percent, other), (True, False), strict=True):
                    if not len(x) or own is None:
                        continue
                    for b in (own, choice) if choice.high <= SHORT else (own,):
                        for signs in signatures(x, b, home):
                            rows = np.empty((len(signs), 4), np.int64)
                            rows[:] = b.index, b.deletion, 0, identity(x)
                            rows[:, 2] = signs.view(np.int64) >> 2
                            out.append(rows)
            rows = np.concatenate(out)
            yield with_columns(batch, [], dict(zip(("band", "deletion", "sign", "uid"), rows.T.copy(), strict=True)))

    rows = scratch.write(sample.mapInArrow(run, "band long, deletion long, sign long, uid long").distinct())
    least = max(2, 1 + int(HOT_SHARE * rows.select("uid").distinct().count()))
    met = scratch.write(rows.groupBy("band", "deletion", "sign").count())
    scratch.drop(rows)
    hot = F.when(F.col("count") >= least, F.col("count")).otherwise(0)
    seen = {(r["band"], r["deletion"]): (r["n"], r["hot"]) for r in met.groupBy("band", "deletion").agg(F.sum("count").alias("n"), F.sum(hot).alias("hot")).collect()}
    bands = bands_of(percent, frozenset(b for b, scheme in seen if scheme and allotted(seen[b, 0], seen[b, 1])))
    chosen = [b.index for b in bands if b.deletion]
    wanted = (F.col("count") >= least) & ((F.col("deletion") == 1) == F.col("band").isin(chosen) if chosen else F.col("deletion") == 0)
    signs = np.array(sorted(r["sign"] for r in met.where(wanted).select("sign").distinct().collect()), np.int64)
    scratch.drop(met)
    return bands, signs


#: A task signs for a set once, as far as it remembers; copies that other tasks signed meet again behind the shuffle.
REMEMBERED = 500_000


def signed(docs: DataFrame, width: int, percent: int, bands: list[Band], hot: np.ndarray) -> DataFrame:
    """(sign, salt, uid, flags) of every set: flags has 4 for a hot signature, 2 for a whole segment and 1 for a set at
    home; the salt is 0 where the signature is not hot."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # bounded by the sample

    def run(batches):
        seen: set[int] = set()
        hot = shared.value
        for batch in (part for whole in batches for part in slices(whole, "text")):
            signs, uids, sizes = [], [], []
            for x in shingle_sets(*buffer(batch.column("text")), width):
                uid = identity(x)
                if not len(x) or uid in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(uid)
                home, guest = _own_bands(len(x), percent, bands)
                own = [*(signatures(x, home, True) if home else []), *(signatures(x, guest, False) if guest else [])]
                signs += own
                uids.append(uid)
                sizes.append(sum(map(len, own)))
            flagged = np.concatenate(signs).view(np.int64) if signs else np.empty(0, np.int64)
            keys, owners = flagged >> 2, np.repeat(np.array(uids, np.int64), np.array(sizes, np.int64))
            at = np.minimum(np.searchsorted(hot, keys), max(len(hot) - 1, 0))
            is_hot = hot[at] == keys if len(hot) else np.zeros(len(keys), bool)
            out = {
                "sign": keys,
                "salt": np.where(is_hot, owners & (SALTS - 1), 0).astype(np.int16),
                "uid": owners,
                "flags": ((flagged & 3) + 4 * is_hot).astype(np.int8),
            }
            yield with_columns(batch, [], out)

    return docs.select("text").mapInArrow(run, "sign long, salt short, uid long, flags byte")


SKETCH = ("k0", "k1", "k2", "k3")


def _most(n_a: Column, n_b: Column, percent: int) -> Column:
    return n_a + n_b - 2 * F.ceil(F.lit(percent) * (n_a + n_b) / F.lit(100 + percent))


def _apart() -> Column:
    """In how many of 256 bits two sets differ."""
    return sum((F.bit_count(F.col(f"{k}_a").bitwiseXOR(F.col(f"{k}_b"))) for k in SKETCH), F.lit(0))


def may_link(percent: int) -> Column:
    """Whether sizes and 256-bit bitmaps (n, k0 to k3; _a and _b) leave room for a link: bitmaps never differ in more
    bits than sets in shingles."""
    n_a, n_b = F.col("n_a"), F.col("n_b")
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (_apart() <= _most(n_a, n_b, percent))


def closer(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, home_a, home_b) those (a, b) that the bitmaps of their band leave room for."""
    out = pairs
    for side in "ab":
        own = sets.select(F.col("uid").alias(side), F.col("n").alias(f"n_{side}"), F.col("at_home").alias(f"h_{side}"), F.col("as_guest").alias(f"g_{side}"))
        out = out.join(own, side).withColumn(f"bits_{side}", F.when(F.col(f"home_{side}"), F.col(f"h_{side}")).otherwise(F.col(f"g_{side}"))).drop(f"h_{side}", f"g_{side}")
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return out.where(apart <= _most(F.col("n_a"), F.col("n_b"), percent)).select("a", "b").distinct()


def fetched(docs: DataFrame, vertices: DataFrame, wanted: DataFrame, width: int, percent: int, bands: list[Band]) -> DataFrame:
    """(uid, n, k0 to k3, at_home, as_guest, members) of the wanted sets, made again from one document of each; k is a
    parity bitmap of 256 bits, the other bitmaps have the sizes of their bands.

    The texts are shuffled once, whatever the number of rounds that compare sets afterwards.
    """
    concerned = vertices.join(wanted, "uid")
    own = concerned.select(F.col("first").alias("_own")).distinct().hint("merge")
    some = docs.select(F.col("doc_id").alias("_id"), "text").join(own, F.col("_id").eqNullSafe(F.col("_own")), "left_semi")

    def make(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            out = {k: [] for k in ("uid", "n", *SKETCH, "at_home", "as_guest", "members")}
            for x in shingle_sets(*buffer(batch.column("text")), width):
                home, guest = _own_bands(len(x), percent, bands) if len(x) else (None, None)
                bitmaps = home and parity(x, home.bits), guest and parity(x, guest.bits)
                row = identity(x), len(x), *parity(x, 256).tolist(), *bitmaps, x.tobytes()
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
            yield with_columns(batch, [], out, {"at_home": pa.list_(pa.int64()), "as_guest": pa.list_(pa.int64()), "members": pa.binary()})

    sketch = ", ".join(f"{k} long" for k in SKETCH)
    made = some.select("text").mapInArrow(make, f"uid long, n long, {sketch}, at_home array<long>, as_guest array<long>, members binary")
    return made.join(concerned.select("uid"), "uid", "left_semi").dropDuplicates(["uid"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of uids that link, by their full sets."""
    side = lambda name: sets.select(F.col("uid").alias(name), F.col("members").alias(f"of_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def hold(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("of_a"), batch.column("of_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return scratch.write(both.select("a", "b", "of_a", "of_b").mapInArrow(hold, "a long, b long"))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, root) for every end of a link (a, b): the smallest uid that links reach.

    Each round a vertex takes the smallest root among its own and its neighbours', then the root of that root, until
    nothing changes; rounds are about the logarithm of the longest chain.
    """
    edges = scratch.write(links.select("a", "b").union(links.select("b", "a")).distinct())
    roots = scratch.write(edges.groupBy(F.col("a").alias("uid")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = edges.join(roots.select(F.col("uid").alias("b"), "root"), "b").groupBy(F.col("a").alias("uid")).agg(F.min("root").alias("_near"))
        less = roots.join(near, "uid").select("uid", F.col("root").alias("_old"), F.least("root", "_near").alias("_mid"))
        jump = roots.select(F.col("uid").alias("_mid"), F.col("root").alias("_far"))
        new = less.join(jump, "_mid", "left").select("uid", "_old", F.least("_mid", F.coalesce("_far", "_mid")).alias("root"))
        new = scratch.write(new)
        changed = new.where("root < _old").limit(1).count()
        scratch.drop(roots)
        roots = new.select("uid", "root")
        if not changed:
            scratch.drop(edges)
            return roots


def joined_up(links: DataFrame, roots: DataFrame | None, scratch: Scratch) -> DataFrame:
    """The components that ``roots`` holds, joined by further links.

    Links are moved to the roots of their ends first, so a call costs what its own links join and not all that earlier
    ones did. A root is the smallest uid of its component, and stays so.
    """
    if roots is None:
        return components(links, scratch)
    for side in "ab":
        links = links.join(roots.select(F.col("uid").alias(side), "root"), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    over = components(scratch.write(links.where("a != b").distinct()), scratch)
    moved = roots.join(over.select(F.col("uid").alias("root"), F.col("root").alias("_new")), "root", "left").select("uid", F.coalesce("_new", "root").alias("root"))
    added = over.join(roots.select("uid"), "uid", "left_anti").select("uid", "root")
    return scratch.write(moved.union(added))


#: What a candidate side carries beside its signature, and how often neighbours are tried before the rest is compared.
PARTS = ("root", "uid", "home", "n", *SKETCH)
CHAIN_ROUNDS = 3
#: The sets of one signature are handled in blocks of about so many.
BLOCK = 512


def _rooted(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("uid"))
    return rows.join(roots, "uid", "left").withColumn("root", F.coalesce("root", "uid"))


def useful(rows: DataFrame, needs: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(sign, uid, whole, home, root, df, have, need): the signatures that several components have, of the sets that
    have as many of them as a link to another component needs. df counts the sets of a signature."""
    rooted = _rooted(rows.select("sign", "uid", "whole", "home"), roots)
    spans = rooted.groupBy("sign").agg(
        F.min("root").alias("_low"), F.max("root").alias("_high"), F.max("whole").alias("_whole"), F.max("home").alias("_home"), F.count("*").alias("df")
    )
    spans = spans.where((F.col("_low") < F.col("_high")) & F.col("_whole") & F.col("_home")).select("sign", "df")
    need = F.when(F.col("home"), F.col("need_home")).otherwise(F.col("need_guest"))
    kept = rooted.join(spans, "sign").join(needs, "uid").withColumn("need", need).drop("need_home", "need_guest")
    return kept.withColumn("have", F.count("*").over(Window.partitionBy("uid", "home"))).where("have >= need")


def rarest(rows: DataFrame) -> DataFrame:
    """Of each set's useful signatures the rarest, as many as leave too few for a link."""
    w = Window.partitionBy("uid", "home").orderBy("df", "sign", F.col("whole").desc())
    return rows.withColumn("_at", F.row_number().over(w)).where("_at <= have - need + 1").drop("_at", "have", "need")


def largest_partner(hard: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(uid, root, upto) of those ``hard`` sets (uid, root) that can link with one of another component, and the size
    that such a partner has at most.

    A set of n shingles, of which f are found in other components of ``hard`` too, has at most f in common with a
    partner of m, and a link takes percent * (n + m) / (100 + percent).
    """
    held = scratch.write(hard.join(sets.select("uid", "n", "members"), "uid").select("uid", "root", "n", "members"))

    def split(batches):
        most = 1 << 19
        for batch in batches:
            each = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("members")]
            row = np.repeat(np.arange(len(each)), [len(x) for x in each])
            tokens = np.concatenate(each) if each else np.empty(0, np.int64)
            for a in range(0, len(tokens), most):
                of = pa.array(row[a : a + most])
                yield with_columns(batch.select(["uid", "root"]).take(of), ["uid", "root"], {"token": tokens[a : a + most]})

    tokens = held.select("uid", "root", "members").mapInArrow(split, "uid long, root long, token long")
    spread = tokens.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high").select("token")
    foreign = tokens.join(spread, "token").groupBy("uid").count()
    upto = F.floor(F.col("count") * F.lit(100 + percent) / F.lit(percent)) - F.col("n")
    found = held.select("uid", "root", "n").join(foreign, "uid").select("uid", "root", "n", upto.alias("upto"))
    out = scratch.write(found.where(100 * F.col("upto") >= percent * F.col("n")).select("uid", "root", "upto"))
    scratch.drop(held)
    return out


def compared(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, home_a, home_b) of useful rows (with n, sketches, upto) of one signature and different components
    that sizes and sketches leave room for.

    The largest component of a signature is never compared with itself, and its sets are dealt over blocks.
    """
    by_root = rows.groupBy("sign", "root").count()
    largest = by_root.groupBy("sign").agg(F.max(F.struct("count", "root"))["root"].alias("_most"), F.sum("count").alias("_size"))
    placed = rows.join(largest, "sign").withColumn("_blocks", F.ceil(F.col("_size") / F.lit(BLOCK)).cast("int"))
    side = lambda df, name, *more: df.select("sign", *[F.col(c).alias(f"{c}_{name}") for c in (*PARTS, "whole", "upto")], *more)
    block = F.pmod(F.xxhash64("uid"), F.col("_blocks")).cast("int").alias("block")
    a = side(placed.where("root != _most"), "a", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))
    b = side(placed, "b", block, (F.col("root") == F.col("_most")).alias("most_b"))
    met = a.join(b, ["sign", "block"]).where(
        (F.col("root_a") != F.col("root_b"))
        & (F.col("most_b") | (F.col("uid_a") < F.col("uid_b")))
        & (F.col("whole_a") | F.col("whole_b"))
        & (F.col("home_a") | F.col("home_b"))
        & (F.col("n_a") <= F.col("upto_b"))
        & (F.col("n_b") <= F.col("upto_a"))
        & may_link(percent)
    )
    return met.select(F.col("uid_a").alias("a"), F.col("uid_b").alias("b"), "home_a", "home_b").distinct()


def joined(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_hash, n_shingles, root (the identity of the component; null for
    a text without words)."""
    docs = docs.select("doc_id", "text")
    bands, hot = measured(docs, width, percent, docs.count(), scratch)
    plain = scratch.write(described(docs, width, percent, bands))
    vertices = scratch.write(
        plain.where("n_shingles > 0").groupBy("uid").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("need_home", "need_guest")])
    )
    needs = vertices.select("uid", "need_home", "need_guest")

    # Whole rows first, those at home first of them: a signature that only one set has joins nothing.
    flag = lambda bit: F.col("flags").bitwiseAND(F.lit(bit).cast("byte")) > 0
    w = Window.partitionBy("sign", "salt").orderBy(F.col("flags").desc(), "uid")
    ends = {"_first": F.first("uid").over(w), "_next": F.lead("uid").over(w)}
    placed = signed(docs, width, percent, bands, hot).withColumns(ends)
    alone = (F.col("uid") == F.col("_first")) & (F.col("_next").isNull() | (F.col("_next") == F.col("uid")))
    shared = placed.where(flag(4) | ~alone).dropDuplicates(["sign", "salt", "uid", "flags"])
    shared = scratch.write(shared.select("sign", "uid", flag(2).alias("whole"), flag(1).alias("home")))
    base = scratch.write(useful(shared, needs))
    scratch.drop(shared)
    sets = scratch.write(fetched(docs, vertices, base.select("uid").distinct(), width, percent, bands))
    sketches = sets.select("uid", "n", *SKETCH)
    members = scratch.write(rarest(useful(base, needs)).drop("root").join(sketches, "uid"))

    possible = may_link(percent)
    home = F.col("home_a") | F.col("home_b")
    roots = None
    for turn in range(CHAIN_ROUNDS):
        rooted = _rooted(members, roots)
        if roots is not None:
            spans = rooted.groupBy("sign").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high")
            rooted = rooted.join(spans.select("sign"), "sign", "left_semi")
        block = F.pmod(F.xxhash64("uid", F.lit(turn)), F.ceil(F.col("df") / F.lit(BLOCK)))
        w = Window.partitionBy("sign", "_block").orderBy(F.xxhash64("uid", "sign", F.lit(turn)))
        a = [F.col(c).alias(f"{c}_b") for c in (*PARTS, "whole")]
        b = [F.col("_next")[c].alias(f"{c}_a") for c in (*PARTS, "whole")]
        chained = rooted.withColumn("_block", block).withColumn("_next", F.lead(F.struct(*PARTS, "whole")).over(w)).where("_next is not null").select(*a, *b)
        met = chained.where((F.col("root_a") != F.col("root_b")) & (F.col("whole_a") | F.col("whole_b")) & home & possible)
        # Each set with the neighbour that is nearest by size and bitmap.
        nearness = (_apart() / (F.col("n_a") + F.col("n_b"))).alias("far")
        best = met.groupBy(F.col("uid_b").alias("b")).agg(F.min(F.struct(nearness, F.col("uid_a").alias("a"), "home_a", "home_b")).alias("best"))
        near = scratch.write(closer(best.select("b", "best.a", "best.home_a", "best.home_b"), sets, percent))
        roots = joined_up(verified(near, sets, percent, scratch), roots, scratch)
    scratch.drop(members)

    # The sets of different components that still share signatures; what they hold alone rules most of them out.
    rest = base.select("sign", "uid", "whole", "home")
    rest = scratch.write(useful(rest, needs, roots))
    for _ in range(2):
        partners = largest_partner(rest.select("uid", "root").distinct(), sets, percent, scratch)
        left = rest.select("sign", "uid", "whole", "home").join(partners.select("uid"), "uid", "left_semi")
        rest = scratch.write(useful(left, needs, roots))
    last = rarest(rest).join(partners.select("uid", "upto"), "uid").join(sketches, "uid")
    pairs = scratch.write(closer(scratch.write(compared(scratch.write(last), percent)), sets, percent))
    final = joined_up(verified(pairs, sets, percent, scratch), roots, scratch)
    named = scratch.write(vertices.select("uid", "first").join(final, "uid", "left").select("uid", "first", F.coalesce("root", "uid").alias("root")))
    scratch.drop(sets, base)
    return plain.join(named.select("uid", "root"), "uid", "left").select("doc_id", "text_hash", "n_shingles", "root")


def linked(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id. Other columns are not carried.

    A component is what links reach; its id is the smallest doc_id in it. Sets link when 100 * intersection >= percent
    * union. A null text is empty; a text without words has no shingles and links with nothing, its component is its
    own doc_id. Repeated rows are copies of each other. A null doc_id takes part but is never a component's id unless
    all in it are null. An empty table gives no rows. Ties (equal sizes, equal distances) never change a component.
    """
    found = scratch.write(joined(docs, scratch, width, percent))
    smallest = found.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = found.join(smallest, "root", "left")
    # Sets without shingles are in no component but their own.
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def distinct_documents(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80) -> DataFrame:
    """Of ``docs`` (doc_id, text, ...) one row of each component: that of the smallest doc_id (null last; then the
    smallest hash of the text). Of rows with equal doc_id and text one stays; a text without words is a component of
    its own."""
    found = scratch.write(joined(docs, scratch, width, percent))
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    best = found.where("root is not null").groupBy("root").agg(F.min(row).alias("row")).select("row.doc_id", "row.text_hash")
    empty = found.where("root is null").select("doc_id", "text_hash")
    stays = best.union(empty).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct().hint("merge")
    hashed = docs.withColumn("_text", F.xxhash64("text"))
    kept = hashed.join(stays, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_text"]).drop("_text")


def op6_shingle_join(spark, sf_dir: str) -> DataFrame:
    found = linked(table(spark, sf_dir, "documents"), Scratch(spark, "op6"), width=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")
