"""Splitting texts above a token limit at natural boundaries, with an overlap.

Every boundary of a text gets its farthest legal successor: the next piece starts `overlap` tokens before the boundary
and ends at most `max_tokens` later, at the best break in that window.  Squaring the successor table (pointer doubling)
then marks all greedy cuts in a number of steps logarithmic in the number of pieces, for all texts of a batch at once.
A text is one row, so its table stays in one task; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sift.llm.bpe import load, tokenizer_path
from sift.llm.encode import _texts
from sift.session import spread

#: From best to last: after an empty line, a line, a sentence, a word or clause, a piece of the pattern, a character.
BREAKS = ("paragraph", "line", "sentence", "word", "piece", "character")


def break_classes(raw: np.ndarray, ends: np.ndarray, piece_end: np.ndarray) -> np.ndarray:
    """For token ends at byte offsets `ends` of a text's bytes: the index in BREAKS, or 9 inside a character.
    piece_end: whether the pattern ends a piece there."""
    n = len(raw)
    padded = np.concatenate([np.zeros(4, np.uint8), raw, np.full(1, 32, np.uint8)])
    b1, b2, b3, nxt = padded[ends + 3], padded[ends + 2], padded[ends + 1], padded[ends + 4]
    b4 = padded[ends]
    blank = lambda b: (b == 32) | ((b >= 9) & (b <= 13))
    stop = lambda b: (b == 46) | (b == 33) | (b == 63)
    wide_stop = ((b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x82)) | ((b3 == 0xEF) & (b2 == 0xBC) & ((b1 == 0x81) | (b1 == 0x9F)))
    clause = (b3 == 0xEF) & (b2 == 0xBC) & ((b1 == 0x8C) | (b1 == 0x9B)) | (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x81)
    out = np.full(len(ends), 5, np.int8)
    out[piece_end] = 4
    out[piece_end & (blank(nxt) | blank(b1))] = 3
    out[clause] = 3
    out[(stop(b1) & blank(nxt) & piece_end) | wide_stop | (blank(b1) & stop(b2) & piece_end)] = 2
    out[(b1 == 10)] = 1
    out[(b1 == 10) & ((b2 == 10) | ((b2 == 13) & (b3 == 10) & (b4 != 0)))] = 0
    inside = (ends < n) & ((nxt & 0xC0) == 0x80)
    out[inside] = 9
    return out


def successors(classes: np.ndarray, max_tokens: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(successor, start): for each token position 0..n as the end of a piece, the end and the start of the next one.
    classes has position 0..n; positions inside a character (9) are no cuts but still get values."""
    n = len(classes) - 1
    legal = np.flatnonzero(classes < 9)
    at = np.arange(n + 1)
    start = np.maximum(at - overlap, 0)
    start = legal[np.searchsorted(legal, start, "right") - 1]  # a whole character more rather than less overlap
    start[0] = 0
    limit = np.minimum(start + max_tokens, n)
    chosen = np.full(n + 1, -1)
    half = np.maximum(at, start + max_tokens // 2)
    # Natural breaks in the second half, then in the first where the next piece still starts later, then any other.
    natural = range(BREAKS.index("piece"))
    for kind, floor in [*((k, half) for k in natural), *((k, np.maximum(at, start + overlap)) for k in natural), (BREAKS.index("piece"), half), (BREAKS.index("character"), at)]:
        of = np.flatnonzero(classes <= kind)
        k = np.searchsorted(of, limit, "right") - 1
        far = np.where(k >= 0, of[np.maximum(k, 0)], -1)
        ok = (chosen < 0) & (far > floor)
        chosen[ok] = far[ok]
    chosen[limit == n] = n
    return np.where(chosen > at, chosen, n if n else 0), start


def cuts(successor: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """All positions reached from the roots by following successors, ends of texts being their own successors."""
    reached = np.zeros(len(successor), bool)
    reached[roots] = True
    jump, front = successor, roots
    while True:
        more = jump[np.flatnonzero(reached)]
        if reached[more].all():
            return reached
        reached[more] = True
        jump = jump[jump]


def split_documents(
    df: DataFrame, max_tokens: int, overlap_tokens: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_text: bool = True
) -> DataFrame:
    """Pieces (id_col, piece_no, n_pieces, start_token, end_token, n_tokens, break_kind, piece) of every text.

    Texts within the limit are one piece; null and empty texts have none.  A piece has at most max_tokens tokens and,
    from the second on, repeats the last overlap_tokens tokens of the one before (up to 3 more where the overlap would
    begin inside a character).  Of the breaks in the second half of the window the best kind wins, then the farthest; where
    there are only pieces and characters, the best natural break of the first half comes before them.  n_tokens counts the document's tokens in the piece; slices of a valid encoding are valid encodings, so
    the piece alone has as many, or a few less where white space at its end merges.
    Repeated ids are split row by row; max_tokens must exceed overlap_tokens by 8 or more."""
    if max_tokens < overlap_tokens + 8 or overlap_tokens < 0:
        raise ValueError("max_tokens must exceed overlap_tokens by at least 8")
    file = tokenizer_path(df.sparkSession, path)
    names = [id_col, "piece_no", "n_pieces", "start_token", "end_token", "n_tokens", "break_kind", *(["piece"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file)
        size = np.zeros(max(bpe.token_bytes) + 1, np.int64)
        for tid, raw in bpe.token_bytes.items():
            size[tid] = len(raw)
        for batch in batches:
            rows: list[tuple] = []  # position in batch, piece number, pieces, start, end, kind, text
            long: list[tuple] = []
            for at, text in enumerate(_texts(batch.column(1))):
                if not text:
                    continue
                parts = list(map(bpe.piece_raw, bpe.pieces(text)))
                n = sum(map(len, parts)) // 4
                if n <= max_tokens:
                    rows.append((at, 1, 1, 0, n, "end", text if with_text else None))
                    continue
                ids = np.frombuffer(b"".join(parts), np.int32)
                raw = text.encode("utf-8", "replace")
                ends = np.cumsum(size[ids])
                piece_end = np.zeros(n, bool)
                piece_end[np.cumsum([len(p) // 4 for p in parts if p]) - 1] = True
                classes = np.concatenate([[0], break_classes(np.frombuffer(raw, np.uint8), ends, piece_end)])
                long.append((at, raw, np.concatenate([[0], ends]), classes, *successors(classes, max_tokens, overlap_tokens)))
            if long:
                offsets = np.concatenate([[0], np.cumsum([len(x[3]) for x in long])])
                reached = cuts(np.concatenate([x[4] + o for x, o in zip(long, offsets)]), offsets[:-1])
                for (at, raw, ends, classes, _, start), o in zip(long, offsets):
                    mine = np.flatnonzero(reached[o : o + len(classes)])
                    for k in range(len(mine) - 1):
                        a, b = int(start[mine[k]]), int(mine[k + 1])
                        kind = "end" if b == len(classes) - 1 else BREAKS[classes[b]]
                        rows.append((at, k + 1, len(mine) - 1, a, b, kind, raw[ends[a] : ends[b]].decode("utf-8", "replace") if with_text else None))
            where = pa.array([r[0] for r in rows], pa.int64())
            arrays = [
                batch.column(0).take(where), *(pa.array([r[i] for r in rows], pa.int32()) for i in (1, 2, 3, 4)),
                pa.array([r[4] - r[3] for r in rows], pa.int32()), pa.array([r[5] for r in rows], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array([r[6] for r in rows], pa.string())] if with_text else []), names=names)
            bpe.trim()

    ints = [T.StructField(c, T.IntegerType()) for c in names[1:6]]
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *ints, T.StructField("break_kind", T.StringType()), *([T.StructField("piece", T.StringType())] if with_text else [])])
    rows = spread(df.select(F.col(id_col), F.col(text_col).cast("binary").alias("_raw")))
    return rows.mapInArrow(run, schema)
