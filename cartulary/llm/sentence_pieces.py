"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation is done here: at each place of a text the longest prefix that the model's compiled character map knows
is replaced (else one character is kept), blanks become the word mark, and for every byte of the result the byte of
the source that it came from is recorded. Pieces are consecutive runs of the normalised bytes, so their lengths and
this alignment project each of them onto a span of the source's bytes.

Segmentation is the sentencepiece library's. Where no piece of the vocabulary has a word mark behind another
character, no merge crosses into a word's mark; then words can be segmented alone, and each worker remembers a bounded
number of them. Otherwise whole texts are segmented.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from cartulary.llm.shared import table, with_columns

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Words remembered by a worker.
MOST_WORDS = 300_000


def fields(message: bytes) -> list[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol buffer message."""
    found, i = [], 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = message[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(message):
        key = number()
        if key & 7 == 0:
            found.append((key >> 3, number()))
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        found.append((key >> 3, message[i : i + size]))
        i += size
    return found


class CharacterMap:
    """A compiled character map: the size of a double-array trie, the trie, and the replacements it points at."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest known prefix of source[at:], and that prefix's length."""
        if not self.units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node, found = step(self.units[0]), None
        for i in range(at, len(source)):
            node ^= source[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != source[i]:
                break
            unit = self.units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        start, length = found
        return self.texts[start : self.texts.index(0, start)], length


class Model:
    """What a model file says about normalisation and pieces."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            message = fields(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [dict(fields(v)) for k, v in message if k == 1]
        texts = [p[1] for p in pieces]
        kinds = [p.get(3, 1) for p in pieces]
        self.lengths = np.array([1 if k == 6 else len(t) for t, k in zip(texts, kinds, strict=True)], np.int64)
        self.byte_fallback = 6 in kinds
        rules = dict(fields(next(v for k, v in message if k == 3)))
        trainer = dict(fields(next(v for k, v in message if k == 2)))
        self.map = CharacterMap(rules.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))
        #: One normalised mark for each blank of the source, everything else as it is.
        self.plain = not self.map.units and self.prefix and not self.squeeze and self.escape and not self.suffix
        inner = any(MARK in t.decode().lstrip(MARK) for t, k in zip(texts, kinds, strict=True) if k in (1, 4, 5))
        self.by_word = self.plain and self.byte_fallback and not inner
        self.words: dict[str, tuple[bytes, str, str]] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes (and its end) the byte of the source it came from.

        Where the map is empty no prefix is ever known, so all bytes but blanks stay and are aligned at once.
        """
        source = text.encode()
        if self.plain:
            raw = np.frombuffer(source, np.uint8)
            first = np.zeros(len(MARK_BYTES) if source else 0, np.int64)
            each = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(MARK_BYTES), 1))
            return (MARK if source else "") + text.replace(" ", MARK), np.concatenate([first, each, [len(raw)]])
        out, align = bytearray(), []
        blank = MARK_BYTES if self.escape else b" "

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            align.extend([at] * len(piece))

        at, trimmed = 0, self.squeeze
        if source and self.prefix and not self.suffix:
            put(blank, 0)
        while at < len(source):
            found = self.map.longest(source, at)
            if found is None:
                lead = source[at]
                found = source[at : at + (1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4)], None
            piece, length = found
            length = length or len(piece)
            for i, part in enumerate(re.split(rb"( )", piece)):
                if i % 2 == 0:
                    put(part, at)
                    trimmed = trimmed and not part
                elif not trimmed:
                    put(blank, at)
                    trimmed = self.squeeze
            at += length
        end = len(source)
        if self.squeeze:  # blanks at the end
            while out.endswith(blank) and len(out) >= len(blank):
                del out[-len(blank) :]
                end = align[-len(blank)]
                del align[-len(blank) :]
        if self.suffix and self.prefix and source:
            put(blank, end)
        return out.decode(), np.array([*align, end], np.int64)

    def learn(self, words: set[str]) -> None:
        if len(self.words) + len(words) > MOST_WORDS:
            self.words.clear()
        new = sorted(words)
        lone = [self.library.piece_to_id(MARK)]  # of a lone mark; the library adds none to an empty text
        ids = [x or lone for x in self.library.encode([w[1:] for w in new], num_threads=1)]
        for word, own, text in zip(new, ids, self.library.decode(ids, num_threads=1), strict=True):
            self.words[word] = array("I", own).tobytes(), " ".join(map(str, own)), " " + text

    def encode(self, text: str) -> tuple[np.ndarray, str, str, np.ndarray]:
        """The ids of a text without an end id, the same as decimal numbers, what they decode to, and the alignment of
        the normalised text that they cover."""
        normal, align = self.normalise(text)
        if not text:
            return np.empty(0, "<u4"), "", "", align
        if not (self.by_word and text[0] != MARK):
            ids = self.library.encode(text)
            return np.array(ids, "<u4"), " ".join(map(str, ids)), self.library.decode(ids), align
        parts = re.findall(f"{MARK}+[^{MARK}]*", normal)
        known = self.words
        try:
            found = [known[p] for p in parts]
        except KeyError:
            missing = {p for p in parts if p not in known}
            if len(known) + len(missing) > MOST_WORDS:
                missing = set(parts)
            self.learn(missing)
            found = [known[p] for p in parts]
        return np.frombuffer(b"".join([x[0] for x in found]), "<u4"), " ".join([x[1] for x in found]), "".join([x[2] for x in found])[1:], align

    def spans(self, text: str, ids: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) byte of the source behind each piece."""
        if not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.cumsum(self.lengths[ids])
        if not self.byte_fallback:  # an unknown piece has the length of what it stands for
            sizes = [len(p.encode()) for p in self.library.encode(text, out_type=str)]
            ends = np.cumsum(sizes)
        return align[np.concatenate([[0], ends[:-1]])], align[ends]


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode(docs: DataFrame, path: str, text: str = "text", end_id: int | None = 2) -> DataFrame:
    """Adds ids, begins and ends (arrays; the spans are bytes of the text, the end id's is empty at its end).

    A null text counts as empty. Repeated rows are encoded each. Columns named as added ones are replaced.
    """
    kept = docs.drop("ids", "begins", "ends")
    names = kept.columns

    def run(batches):
        m = model(path)
        for batch in batches:
            out = {"ids": [], "begins": [], "ends": []}
            for value in batch.column(text):
                source = value.as_py() or ""
                ids, _, _, align = m.encode(source)
                begins, ends = m.spans(source, ids, align)
                size = len(source.encode())
                tail = [] if end_id is None else [size]
                out["ids"].append([*ids.tolist(), *([] if end_id is None else [end_id])])
                out["begins"].append([*begins.tolist(), *tail])
                out["ends"].append([*ends.tolist(), *tail])
            yield with_columns(batch, names, out, dict.fromkeys(out, pa.list_(pa.int64())))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "ids array<long>, begins array<long>, ends array<long>"])
    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of an array of ids; null for null."""
    kept = df.drop("decoded")
    names = kept.columns

    def run(batches):
        m = model(path)
        for batch in batches:
            texts = [None if x is None else m.library.decode(x) for x in batch.column(ids).to_pylist()]
            yield with_columns(batch, names, {"decoded": pa.array(texts, pa.string())})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "decoded string"])
    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Per row what ``encode`` and ``decode`` give, as counts and hashes: arrays of ids would outweigh the texts.

    spans_crc32: of the begins, then the ends, as little-endian signed 64-bit numbers, without the end id's.
    """

    def run(batches):
        m = model(path)
        for batch in batches:
            out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "spans_crc32": []}
            for value in batch.column("text"):
                source = value.as_py() or ""
                ids, numbers, decoded, align = m.encode(source)
                begins, ends = m.spans(source, ids, align)
                out["n_tokens"].append(len(ids) + 1)
                out["ids_sha256"].append(hashlib.sha256(f"{numbers} {end_id}".lstrip().encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                out["spans_crc32"].append(zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(begins.astype("<i8").tobytes())))
            yield with_columns(batch, ["doc_id"], out, {"ids_sha256": pa.string(), "decoded_sha256": pa.string()})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
    )


def op3_sentence_pieces(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), path or public_tokenizers.path("piece_bpe_32k.model"))
