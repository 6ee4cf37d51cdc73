"""SentencePiece encoding and decoding by batched Viterbi in numpy.

The pieces and scores come from a model file (its path is a parameter; the file is read on the driver and the table of
pieces, 32,000 rows for the default model, is broadcast). A text gets a space in front, spaces become the piece mark, and the
segmentation with the greatest sum of piece scores is taken; of equal ones the one whose last piece is longest. Since no
piece has the mark behind another character, texts are cut before marks into units; each distinct unit of a batch is solved
once. Units of equal length advance together: for each end, hashes of all substrings that end there probe the sorted piece
keys, and a vectorised maximum stores the back pointer. A character that no piece covers becomes its bytes.

The default model was made for merges, not for sums of scores: its scores are the negative merge ranks. Viterbi over them is
the method asked for; its ids decode exactly, but are not those that merging in rank order would give.

Defined cases: a null text is empty and has no ids; the piece mark U+2581 in a text is encoded by bytes, so decoding gives
the same text, always; repeated rows are encoded each; an empty table gives none; further columns are not read. A text of any
length is encoded whole; memory follows the longest text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import batches_of, chunks, mix, powers, read, text_bytes

MODEL = os.environ.get("GRAPHLOOM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK, CHUNK, UNKNOWN_PENALTY = 0x2581, 4 << 20, 10.0


@dataclass
class Pieces:
    """keys: sorted hashes of the pieces; ids and scores in that order; raw and at: each id's bytes, one behind the other."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    unknown: float
    byte_ids: np.ndarray
    raw: np.ndarray
    at: np.ndarray
    cut: bool


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


class Hashes:
    """Hashes of any substrings of an array of code points."""

    def __init__(self, points: np.ndarray):
        p, self.inv = powers(len(points) + 1)
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * p[: len(points)], out=self.sums[1:])

    def of(self, start, end):
        return mix((self.sums[end] - self.sums[start]) * self.inv[start])


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    is_byte = [sp.is_byte(i) for i in range(n)]
    plain = [i for i in range(n) if not (is_byte[i] or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    raw = [bytes([int(names[i][3:5], 16)]) if is_byte[i] else b"" if sp.is_control(i) or sp.is_unknown(i) else names[i].replace(chr(MARK), " ").encode() for i in range(n)]
    points = code_points([names[i] for i in plain])
    ends = np.cumsum([len(names[i]) for i in plain])
    keys = Hashes(points).of(np.concatenate(([0], ends[:-1])), ends)
    order = np.argsort(keys)
    scores = np.array([sp.get_score(i) for i in plain])
    cut = not any(chr(MARK) in names[i].lstrip(chr(MARK)) for i in plain)
    return Pieces(keys[order], np.array(plain, np.int32)[order], scores[order], max(len(names[i]) for i in plain), scores.min() - UNKNOWN_PENALTY, byte_ids, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), cut)


def viterbi(p: Pieces, h: Hashes, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of units of one length: for each end the best piece's id (-1: unknown character) and its begin."""
    n = len(start)
    best = np.zeros((length + 1, n))
    back, piece = np.zeros((length + 1, n), np.int32), np.zeros((length + 1, n), np.int32)
    for j in range(1, length + 1):
        begins = np.arange(max(0, j - p.longest), j)
        key = h.of(start[None, :] + begins[:, None], (start + j)[None, :])
        at = np.minimum(np.searchsorted(p.keys, key), len(p.keys) - 1)
        known = p.keys[at] == key
        value = np.where(known, p.scores[at], -np.inf)
        value[-1] = np.where(known[-1], value[-1], p.unknown)
        value += best[begins]
        top = value.argmax(axis=0)
        column = np.arange(n)
        best[j], back[j] = value[top, column], begins[top]
        piece[j] = np.where(known[top, column], p.ids[at[top, column]], -1)
    return piece, back


def encode(p: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one behind the other, and where each text's begin (and the last ends)."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts])
    points = code_points([" " + t if t else "" for t in texts]).copy()
    own_mark = points == MARK
    points[points == 32] = MARK
    points[own_mark] = 0x110000  # no piece has it
    begins = np.concatenate(([0], np.cumsum(sizes)))
    if not len(points):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    is_begin = np.zeros(len(points), bool)
    is_begin[begins[:-1][sizes > 0]] = True
    if p.cut:
        is_begin[1:] |= (points[1:] == MARK) & (points[:-1] != MARK)
    start = np.flatnonzero(is_begin)
    length = np.diff(np.append(start, len(points)))
    h = Hashes(points)
    _, one, unit = np.unique(h.of(start, start + length) ^ mix(length.astype(np.uint64)), return_index=True, return_inverse=True)
    of_length = np.argsort(length[one], kind="stable")
    edges = np.flatnonzero(np.diff(length[one][of_length], prepend=-1))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo, hi in zip(edges, np.append(edges[1:], len(one)), strict=True):
        size = int(length[one[of_length[lo]]])
        step = max(1, (1 << 22) // (size * min(size, p.longest)))
        for c in range(lo, hi, step):
            which = of_length[c : min(c + step, hi)]
            begin = start[one[which]]
            piece, back = viterbi(p, h, begin, size)
            place, column = np.full(len(which), size), np.arange(len(which))
            while len(column):
                got = piece[place, column]
                place_before = back[place, column]
                found.append((which[column], place_before.astype(np.int64), np.where(got >= 0, got, -1 - points[begin[column] + place_before].astype(np.int64))))
                keep = place_before > 0
                place, column = place_before[keep], column[keep]
    who, at, ids = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.lexsort((at, who))
    who, ids = who[order], ids[order]
    ids, who = spread_bytes(p, ids, who)
    count = np.bincount(who, minlength=len(one))
    first = np.concatenate(([0], np.cumsum(count)))
    many = count[unit]
    stop = np.cumsum(many)
    gather = np.arange(int(stop[-1])) - np.repeat(stop - many, many) + np.repeat(first[unit], many)
    text_of = np.searchsorted(begins, start, "right") - 1
    per_text = np.bincount(text_of, weights=many, minlength=len(texts)).astype(np.int64)
    return ids[gather].astype(np.int32), np.concatenate(([0], np.cumsum(per_text)))


def spread_bytes(p: Pieces, ids: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece (-1 - code point) become the ids of their bytes."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, who
    point = -1 - ids[odd]
    point[point == 0x110000] = MARK
    n = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
    many = np.ones(len(ids), np.int64)
    many[odd] = n
    out, first = np.repeat(ids, many), np.cumsum(many) - many
    for k in range(4):
        own = n > k
        c, m = point[own], n[own]
        tail = 0x80 | (c >> (6 * (m - 1 - k))) & 0x3F
        head = np.where(m == 1, c, (0xF00 >> m) & 0xFF | c >> (6 * (m - 1)))
        out[first[odd[own]] + k] = p.byte_ids[head if k == 0 else tail]
    return out, np.repeat(who, many)


def decode(p: Pieces, ids: np.ndarray, at: np.ndarray) -> list[str]:
    """The texts of ids that stand one behind the other; at: where each text's begin (and the last ends)."""
    size = (p.at[1:] - p.at[:-1])[ids]
    stop = np.concatenate(([0], np.cumsum(size)))
    data = p.raw[np.arange(int(stop[-1])) - np.repeat(stop[:-1], size) + np.repeat(p.at[:-1][ids], size)].tobytes()
    cut = stop[at].tolist()
    return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(cut, cut[1:], strict=False)]


def encode_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (whether decoding gives the text again) for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            _, starts = text_bytes(batch.column(1))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in chunks(starts, CHUNK):
                part = texts[i:j]
                ids, at = encode(p, part)
                same = [a == b for a, b in zip(decode(p, ids, at), part, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    batches_of(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
