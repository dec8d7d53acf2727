"""Packing documents into windows of tokens by non-negative least squares.

A document's ids, ended by one separator, are cut into whole windows and a tail shorter than a window. The histogram of
tail lengths (at most ``window - 1`` counts, whatever the corpus) goes to the driver, which enumerates the combinations
of up to ``depth`` lengths that fill a window exactly, solves for their repeat counts by non-negative least squares,
and rounds them within what the histogram holds. The residue is packed greedily: the longest tail with what fits best
behind it, as often as the histogram allows, wherever that fills a window exactly. Only what no window takes whole is
laid end to end, cutting the tail that crosses the end of a window. The stream's last, partial window is cut at powers
of two, so nothing is padded.

The plan is a table of intervals: the tails of one length are numbered, and each interval of numbers has its sequences
and offset. Numbering is distributed: tails are dealt by (length, salt), numbered within, and shifted by the counts of
the salts before; a length that a third of all documents share is dealt over all salts.
"""

from __future__ import annotations

import os
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartulary.llm.byte_grams import buffer, slices
from cartulary.llm.shared import Scratch, table, with_columns

#: Tails of one length are numbered in so many independent parts.
SALTS = 1024


#: The letters, numbers and white space among tab, line ends, ASCII, Latin letters and signs up to U+024F,
#: dashes, quotation marks and the euro sign. Every version of Unicode's tables sorts these alike, so the words below
#: are those that the vocabulary's own pattern cuts. A text with any other character is encoded in one go.
_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACES = r"\t\n\r \xa0"
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa0-\u024f\u2010-\u2027\u20ac]")
#: What may follow an apostrophe and is a word with it.
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
#: A long text may be cut here without changing its words.
_CUT = re.compile(rf"(?<=[^{_SPACES}])[{_SPACES}]")
#: The kind of each character: NUL, letter, number, white space, other sign; all from U+0250 on are signs.
_NUL, _SPACE, _SIGN = 0, 3, 4
_KIND = np.full(0x251, _SIGN, np.uint8)
for _kind, _class in enumerate((_LETTERS, _NUMBERS, _SPACES), 1):
    _KIND[[c for c in range(0x250) if re.match(f"[{_class}]", chr(c))]] = _kind
_KIND[0] = _NUL
#: A worker remembers the ids of so many bytes of words; when full, it starts again with those of the last stretch.
REMEMBERED = 8 << 20
#: Words are cut and looked up for about so many characters at a time.
STRETCH = 1 << 20
#: So many new words are encoded as one text.
CHAIN = 200


def word_starts(points: np.ndarray) -> np.ndarray:
    """Where words start in texts that lie end to end, given by code points; a NUL ends each and is a word of its own.

    Words are runs of letters, numbers, signs or white space. The blank before a run belongs to it; of white space
    before anything else the last character stands apart. An apostrophe that starts a word takes its ending along.
    """
    kind = _KIND[points if points.dtype == np.uint8 else np.minimum(points, len(_KIND) - 1)]
    space, solid = kind == _SPACE, (kind != _SPACE) & (kind != _NUL)
    start = kind == _NUL
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    start[1:] &= ~((points[:-1] == ord(" ")) & solid[1:])
    start[1:-1] |= space[1:-1] & space[:-2] & solid[2:]
    marks = np.flatnonzero(start & (points == ord("'")))
    for ending in _ENDINGS:
        at = marks
        for k, letter in enumerate(ending, 1):
            at = at[points[at + k] == ord(letter)]  # a NUL stops this before the end
        start[at + 1] = False
        start[at + 1 + len(ending)] = True
    return np.flatnonzero(start)


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that start at ``first`` and are ``size`` long, one behind the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """texts -> ids of a vocabulary for tokenizers, as little-endian unsigned 32-bit arrays.

    Merges never cross the words that the vocabulary's pattern cuts, so a word's ids are asked for once. The words of
    many texts are cut and numbered at once, and only different ones are looked up. ``known`` are the words
    remembered; the ids of the i-th start at ``first[i]`` of ``flat``. Strings of added tokens part a text first, as the
    library does it, and are their own ids.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that take blanks along, stand alone or are normalised are not supported")
        self.added = {t.content: i for i, t in added.items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.n_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]  # a character stands for a byte
        self.known, self.flat = pa.array([], pa.large_binary()), np.empty(0, "<u4")
        self.first, self.size = np.empty(0, np.int64), np.empty(0, np.int64)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _several(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words, where those of each start, and how many they are.

        Words that start with a blank are encoded one behind the other, since the blank parts them again; where one
        ends is told by the bytes that the tokens stand for."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        chained = pc.match_substring_regex(words, rb"^ ([^\t\n\r \xc2]|\xc2[^\xa0])").to_numpy(zero_copy_only=False)
        order = np.argsort(~chained, kind="stable")
        raw, starts = buffer(words.take(order).cast(pa.large_string()))
        n = int(chained.sum())
        parts = np.concatenate([starts[:n:CHAIN], starts[n:]]).tolist()
        data = raw.tobytes()
        made = self.tokenizer.encode_batch_fast([data[a:b].decode() for a, b in pairwise(parts)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in made), "<u4")
        token_ends = np.cumsum(self.n_bytes[ids])
        ends = np.searchsorted(token_ends, starts[1:]) + 1
        if not np.array_equal(token_ends[ends - 1], starts[1:]):
            raise ValueError("the vocabulary joins what this pattern cuts")
        first, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        size[order] = each = np.diff(ends, prepend=0)
        first[order] = ends - each
        return ids, first, size

    def _looked_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_several``, for different words, by what is remembered; then these words are, too."""
        at = pc.index_in(words, value_set=self.known)
        new, old = at.is_null().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy()
        fresh = words.filter(pa.array(new))
        ids, first, size = self._several(fresh)
        first = np.append(self.first, first + len(self.flat))
        size, flat = np.append(self.size, size), np.append(self.flat, ids)
        here = np.where(new, len(self.known) + np.cumsum(new) - 1, old)
        if self.known.nbytes + fresh.nbytes > REMEMBERED:
            self.known, self.size = words, size[here]
            self.flat, self.first = gathered(flat, first[here], self.size), np.cumsum(self.size) - self.size
        else:
            self.known, self.flat, self.first, self.size = pa.concat_arrays([self.known, fresh]), flat, first, size
        return flat, first[here], size[here]

    def _together(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts without other characters."""
        if not texts:
            return []
        text = "".join(t + "\0" for t in texts)
        raw = text.encode()
        if len(raw) == len(text):
            ends = np.append(word_starts(np.frombuffer(raw, np.uint8)), len(raw))
        else:
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            width = 1 + (points > 0x7F).view(np.int8) + (points > 0x7FF).view(np.int8)
            at = word_starts(points)
            ends = np.append(np.cumsum(width, dtype=np.int64)[at] - width[at], len(raw))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        flat, first, size = self._looked_up(coded.dictionary)
        size[codes[-1]] = 0  # the NUL
        each = size[codes]
        return np.split(gathered(flat, first[codes], each), np.cumsum(each)[codes == codes[-1]][:-1])

    def _stretched(self, text: str) -> np.ndarray:
        """The ids of a long text without other characters, a stretch at a time."""
        out, a = [], 0
        while a < len(text):
            cut = _CUT.search(text, a + STRETCH)
            b = cut.start() if cut else len(text)
            out += self._together([text[a:b]])
            a = b
        return np.concatenate(out)

    def __call__(self, texts: list[str]):
        """Yields the ids of each text."""
        parts, sizes = [], []
        for text in texts:
            own = self.marks.split(text) if self.marks is not None else [text]
            parts += own
            sizes.append(len(own))
        made = self._parted(parts)
        for n in sizes:
            own = [next(made) for _ in range(n)]
            yield own[0] if n == 1 else np.concatenate(own)

    def _parted(self, texts: list[str]):
        """Yields the ids of each of texts that are an added token or have none."""
        out: list[np.ndarray | None] = []
        cut: list[str] = []
        size = 0
        for text in texts:
            if text in self.added:
                out.append(np.array([self.added[text]], "<u4"))
            elif _OTHER.search(text):
                out.append(np.array(self.whole(text), "<u4"))
            elif len(text) > STRETCH:
                out.append(self._stretched(text))
            else:
                out.append(None)
                cut.append(text)
                size += len(text)
            if size > STRETCH:
                yield from self._filled(out, cut)
                out, cut, size = [], [], 0
        yield from self._filled(out, cut)

    def _filled(self, out: list[np.ndarray | None], cut: list[str]):
        made = iter(self._together(cut))
        for ids in out:
            yield next(made) if ids is None else ids


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenized(docs: DataFrame, path: str, window: int, separator: int = 0) -> DataFrame:
    """Per row: uid (unique), doc_id, doc_tokens, the CRCs of its whole windows, and its tail."""

    def encode(batches):
        ids_of = encoder(path)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            out = {"doc_tokens": [], "crcs": [], "tail": [], "tail_crc": [], "tail_ids": []}
            for own in ids_of([text or "" for text in batch.column("text").to_pylist()]):
                ids = np.append(own, np.uint32(separator)).astype("<u4")
                whole = len(ids) // window
                tail = ids[whole * window :].tobytes()
                crcs = [zlib.crc32(ids[i * window : (i + 1) * window].tobytes()) for i in range(whole)]
                for column, value in zip(out.values(), (len(ids), crcs, len(tail) // 4, zlib.crc32(tail), tail), strict=True):
                    column.append(value)
            yield with_columns(batch, ["uid", "doc_id"], out, {"crcs": pa.list_(pa.int64()), "tail_ids": pa.binary()})

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    return keyed.mapInArrow(encode, f"uid long, doc_id {kind}, doc_tokens long, crcs array<long>, tail long, tail_crc long, tail_ids binary")


def combinations(lengths: np.ndarray, window: int, depth: int) -> list[np.ndarray]:
    """The ascending combinations of 1 to ``depth`` (at most 3) lengths that add up to ``window``, by their size."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    found = []
    if depth >= 2:
        a = lengths[lengths * 2 <= window]
        found.append(np.stack([a, window - a], 1)[have[window - a]])
    if depth >= 3:
        a, b = np.meshgrid(lengths, lengths, indexing="ij")
        c = window - a - b
        fits = (a <= b) & (b <= c)
        fits[fits] = have[c[fits]]
        found.append(np.stack([a[fits], b[fits], c[fits]], 1))
    return [x for x in found if len(x)]


def solve(combos: list[np.ndarray], counts: np.ndarray, steps: int = 300) -> list[np.ndarray]:
    """Non-negative repeat counts x minimising |A x - counts|^2, by accelerated projected gradient.

    A holds how often a combination uses a length; it is only ever applied, never built.
    """
    n = len(counts)
    scale = max(counts.max(initial=0.0), 1.0)
    b = counts / scale
    use = lambda xs: sum(np.bincount(c.ravel(), np.repeat(x, c.shape[1]), n) for c, x in zip(combos, xs, strict=True))
    back = lambda r: [r[c].sum(1) for c in combos]
    v = [np.ones(len(c)) for c in combos]  # power iteration for the step size
    for _ in range(12):
        v = back(use(v))
        norm = np.sqrt(sum((x * x).sum() for x in v))
        v = [x / norm for x in v]
    xs = [np.zeros(len(c)) for c in combos]
    ys, t = xs, 1.0
    for _ in range(steps):
        g = back(use(ys) - b)
        new = [np.maximum(y - d / norm, 0) for y, d in zip(ys, g, strict=True)]
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ys = [x + (t - 1) / t2 * (x - o) for x, o in zip(new, xs, strict=True)]
        xs, t = new, t2
    return [x * scale for x in xs]


@dataclass
class Plan:
    """slots: (length, first number, sequence of that number, offset), one row for an interval of numbers.
    rest: (length, first number, its position in the stream of the tails that are left). stream: its first sequence
    and its tokens."""

    slots: np.ndarray
    rest: np.ndarray
    stream: tuple[int, int]
    sequences: int
    window: int

    def boundaries(self) -> np.ndarray:
        """Where the sequences of the stream's last, partial window end: at powers of two."""
        whole, part = divmod(self.stream[1], self.window)
        at, out = whole * self.window, []
        for k in reversed(range(part.bit_length())):
            if part >> k & 1:
                at += 1 << k
                out.append(at)
        return np.array(out, dtype=np.int64)


def greedy(left: np.ndarray, window: int):
    """Yields (lengths, times) of combinations that fill a window exactly: behind the longest tail the one that fills
    the rest, else the two that do, else the longest that fits. ``left`` is brought down to what no window took."""
    counts = left.copy()
    for longest in np.flatnonzero(counts)[::-1].tolist():
        while counts[longest]:
            have, combo, room = counts.copy(), [longest], window - longest
            have[longest] -= 1
            while room:
                low = np.arange(1, room // 2 + 1)
                two = np.where(low * 2 == room, have[low] // 2, np.minimum(have[low], have[room - low]))
                if have[room]:
                    add = [room]
                elif two.any():
                    k = int(np.argmax(two)) + 1
                    add = [room - k, k]
                else:
                    add = np.flatnonzero(have[: room + 1])[-1:].tolist()
                if not add:
                    break
                for x in add:
                    have[x] -= 1
                combo += add
                room -= sum(add)
            if room:  # no exact fill: these go to the stream
                counts[longest] = 0
                break
            sizes, each = np.unique(combo, return_counts=True)
            times = int((counts[sizes] // each).min())
            counts[sizes] -= each * times
            left[sizes] -= each * times
            yield combo, times


def plan(histogram: dict[int, int], window: int, depth: int = 3) -> Plan:
    """Packs a histogram of lengths below ``window``. Its size depends on the window only."""
    counts = np.zeros(window, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    left, used = counts.copy(), np.zeros(window, np.int64)
    combos = combinations(np.flatnonzero(counts), window, depth)
    slots, sequence = [], 0

    def take(combo: list[int], n: int) -> None:
        nonlocal sequence
        offset = 0
        for length in combo:
            slots.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n

    if combos:
        xs = solve(combos, counts.astype(float))
        order = sorted(((x, i, j) for i, each in enumerate(xs) for j, x in enumerate(each) if x > 1e-6), reverse=True)
        for x, i, j in order:
            sizes, times = np.unique(combos[i][j], return_counts=True)
            n = int(min(np.ceil(x), (left[sizes] // times).min()))
            if n > 0:
                left[sizes] -= n * times
                take(combos[i][j][::-1].tolist(), n)
    for combo, n in greedy(left, window):
        take(combo, n)
    rest, at = [], 0
    for length in np.flatnonzero(left)[::-1]:
        rest.append((length, used[length], at))
        at += int(length * left[length])
    whole, part = divmod(at, window)
    as_rows = lambda rows, k: np.array(rows, dtype=np.int64).reshape(-1, k)
    return Plan(as_rows(slots, 4), as_rows(rest, 3), (sequence, at), sequence + whole + part.bit_count(), window)


def numbered(tails: DataFrame, salts: int = SALTS) -> DataFrame:
    """Adds ``number``: 0, 1, ... among the rows of one tail length."""
    salted = tails.withColumn("_salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    within = Window.partitionBy("tail", "_salt").orderBy("uid")
    before = Window.partitionBy("tail").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        salted.groupBy("tail", "_salt")
        .count()
        .select("tail", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    )
    local = salted.withColumn("_n", F.row_number().over(within) - 1)
    return local.join(shift, ["tail", "_salt"]).withColumn("number", F.col("_n") + F.col("_shift")).drop("_n", "_shift", "_salt")


def placed(tails: DataFrame, p: Plan) -> DataFrame:
    """Adds sequence_id and offset to numbered tails; for those in the stream also ``position``, else null."""
    spark = tails.sparkSession
    both = np.concatenate([np.insert(p.slots, 4, -1, axis=1), np.stack([p.rest[:, 0], p.rest[:, 1], p.rest[:, 2] * 0, p.rest[:, 2] * 0, p.rest[:, 2]], 1)])
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    shared = spark.sparkContext.broadcast(both)  # at most 3 rows a combination; the window bounds their number

    def place(batches):
        rows = shared.value
        key = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            tail, number = batch.column("tail").to_numpy(), batch.column("number").to_numpy()
            at = np.searchsorted(key, tail << 48 | number, side="right") - 1
            ahead = number - rows[at, 1]
            streams = rows[at, 4] >= 0
            out = {
                "sequence_id": np.where(streams, -1, rows[at, 2] + ahead),
                "offset": np.where(streams, -1, rows[at, 3]),
                "position": np.where(streams, rows[at, 4] + ahead * tail, -1),
            }
            yield with_columns(batch, ["uid", "doc_id", "doc_tokens", "tail", "tail_crc"], out)

    kind = tails.schema["doc_id"].dataType.simpleString()
    return tails.select("uid", "doc_id", "doc_tokens", "tail", "tail_crc", "number").mapInArrow(
        place, f"uid long, doc_id {kind}, doc_tokens long, tail long, tail_crc long, sequence_id long, offset long, position long"
    )


def pack(docs: DataFrame, path: str, scratch: Scratch, window: int = 1024, separator: int = 0, depth: int = 3) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``docs`` needs doc_id and text; a null text is packed as an empty one, so as the separator alone. Repeated rows and
    repeated or null doc_ids are packed row by row. Other columns are not carried. An empty table gives no pieces.
    A text is encoded whole, whatever its length. Ties between combinations go to the first in order of their lengths.
    Sequence ids are unique; those of packed tails come first and have no gaps, those of whole windows may have.
    """
    tokens = scratch.write(tokenized(docs, path, window, separator))
    tails = tokens.where("tail > 0")
    p = plan({r["tail"]: r["count"] for r in tails.groupBy("tail").count().collect()}, window, depth)
    spots = scratch.write(placed(numbered(tails.select("uid", "doc_id", "doc_tokens", "tail", "tail_crc")), p))
    start = F.col("doc_tokens") - F.col("tail")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = tokens.select("doc_id", "doc_tokens", F.posexplode("crcs").alias("_i", "ids_crc32")).select(
        "doc_id",
        (F.col("_i") * F.lit(window).cast("long")).alias("start"),
        F.lit(window).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.lit(p.sequences).cast("long") + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    uncut = spots.where("position < 0").select(
        "doc_id", start.alias("start"), F.col("tail").alias("length"), F.col("tail_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
    return whole.unionByName(uncut.select(columns)).unionByName(_cut(tokens, spots, p).select(columns))


def _cut(tokens: DataFrame, spots: DataFrame, p: Plan) -> DataFrame:
    """The tails of the stream, cut where its sequences end."""
    lengths = [int(x) for x in p.rest[:, 0]]
    ids = tokens.where(F.col("tail").isin(lengths) if lengths else F.lit(False)).select("uid", "tail_ids")
    rows = spots.where("position >= 0").select("uid", "doc_id", "doc_tokens", "tail", "position").join(ids, "uid")
    ends, (first, total), window = p.boundaries(), p.stream, p.window
    whole = total // window * window

    def cut(batches):
        for batch in batches:
            out = {k: [] for k in ("start", "length", "ids_crc32", "sequence_id", "offset")}
            row = []
            columns = (batch.column(k).to_pylist() for k in ("doc_tokens", "tail", "position", "tail_ids"))
            for i, (n, tail, at, raw) in enumerate(zip(*columns, strict=True)):
                inner = ends[(ends > at) & (ends < at + tail)].tolist()
                marks = [*range(at // window * window + window, min(at + tail, whole + 1), window), *inner]
                for a, b in zip([at, *marks], [*marks, at + tail], strict=True):
                    if a == b:
                        continue
                    if a < whole:
                        sequence, offset = a // window, a % window
                    else:
                        k = int(np.searchsorted(ends, a, side="right"))
                        sequence, offset = whole // window + k, a - (int(ends[k - 1]) if k else whole)
                    crc = zlib.crc32(raw[4 * (a - at) : 4 * (b - at)])
                    row.append(i)
                    for column, value in zip(out.values(), (n - tail + a - at, b - a, crc, first + sequence, offset), strict=True):
                        column.append(value)
            taken = batch.take(pa.array(row, pa.int64()))
            yield with_columns(taken, ["doc_id", "doc_tokens"], out)

    kind = spots.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"doc_id {kind}, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op1_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, path or public_tokenizers.path("byte_bpe_50k.json"), Scratch(spark, "op1"))
