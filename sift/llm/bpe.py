"""Byte-pair encoding by dynamic programming over byte prefixes.

For a merge-ordered vocabulary every byte prefix of a text has exactly one valid *last token*: the token its own
encoding ends with.  A token sequence is a valid encoding iff every adjacent pair is stable, so the last token of
``text[:i]`` is the unique vocabulary suffix ``t`` of ``text[:i]`` that is stable beside the last token of
``text[:i - len(t)]``.  One table of last tokens therefore encodes the text, extends by appending (earlier entries
never change) and repairs edits locally.

Texts are first cut by the tokenizer's own pattern, then at byte pairs which no vocabulary token spans; both cuts
are exact, so the tables stay short and each distinct segment is solved once per worker.
"""

from __future__ import annotations

import base64
import os
from array import array

DEFAULT_DIR = "/opt/tokenizers"
DEFAULT_FILE = "byte_bpe_50k.tiktoken"
# Fixed value: the split pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NEVER = 1 << 40


class _Memo(dict):
    """dict whose misses are computed and, for short keys, kept."""

    __slots__ = ("solve", "keep")

    def __init__(self, solve, keep):
        super().__init__()
        self.solve, self.keep = solve, keep

    def __missing__(self, key):
        value = self.solve(key)
        if len(key) <= self.keep:
            self[key] = value
        return value


class PrefixBPE:
    """Encoder over ranks {token bytes: id}; ids must be in merge order, as in rank files."""

    #: Entries a worker keeps per memo; memory only, results don't depend on it.
    MEMO_SIZE = 300_000

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.pattern = regex.compile(pattern)
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self._tables: dict[bytes, array] = {}
        self._merged: dict[int, int] = {}
        self._span = bytearray(65536)
        order = sorted(ranks.items(), key=lambda x: x[1])
        halves: dict[int, tuple[int, int]] = {}
        usable: list[tuple[bytes, int]] = []
        for raw, tid in order:
            if len(raw) > 1:
                two = self._two_halves(raw, tid, ranks)
                if two is None:  # no merge order produces it, so it never occurs in an encoding
                    continue
                halves[tid] = two
                self._merged[two[0] << 20 | two[1]] = tid
                for x, y in zip(raw, raw[1:]):
                    self._span[x << 8 | y] = 1
            usable.append((raw, tid))
        # Spines: the nodes met from the outermost byte up to the token, each with the rank at which it is consumed.
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        for raw, tid in usable:
            if tid in halves:
                l, r = halves[tid]
                self._right[tid] = [*self._right[r][:-1], (r, tid), (tid, _NEVER)]
                self._left[tid] = [*self._left[l][:-1], (l, tid), (tid, _NEVER)]
            else:
                self._right[tid] = self._left[tid] = [(tid, _NEVER)]
        self._stable: dict[int, bool] = {}
        self._suffixes = ahocorasick.Automaton()
        for raw, tid in usable:
            self._suffixes.add_word(raw.decode("latin-1"), (tid, len(raw)))
        self._suffixes.make_automaton()
        self._segments = _Memo(self._solve_segment, 64)
        self._pieces = _Memo(self._solve_piece, 24)

    @staticmethod
    def _two_halves(raw: bytes, tid: int, ranks: dict[bytes, int]) -> tuple[int, int] | None:
        """The last merge that forms the token, or None if merging its bytes ends elsewhere."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 2:
            best, at = tid, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1], tid)
                if rank < best:
                    best, at = rank, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a and b may stand side by side: no merge across their seam precedes the merges inside them."""
        key = a << 20 | b
        known = self._stable.get(key)
        if known is not None:
            return known
        left, right, i, j, ok = self._right[a], self._left[b], 0, 0, True
        while True:
            x, x_until = left[i]
            y, y_until = right[j]
            across = self._merged.get(x << 20 | y, _NEVER)
            # Equal ranks merge leftmost first: x's own merge lies left of the seam, y's to its right.
            if across < x_until and across <= y_until and across != _NEVER:
                ok = False
                break
            if x_until == _NEVER and y_until == _NEVER:
                break
            if x_until <= y_until:
                i += 1
            else:
                j += 1
        if len(self._stable) > 4 * self.MEMO_SIZE:
            self._stable.clear()
        self._stable[key] = ok
        return ok

    def last_tokens(self, raw: bytes, table: array | None = None) -> array:
        """Last token of every byte prefix of raw (index 0 unused, -1 where a prefix has none). With the table of
        a proper prefix of raw, only the entries beyond it are computed."""
        done = 0 if table is None else len(table) - 1
        last = array("i", [-1]) if table is None else array("i", table)
        last.extend([-1] * (len(raw) - done))
        back = min(done, self.longest)
        base = done - back
        for end, (tid, n) in self._suffixes.iter(raw[base:].decode("latin-1")):
            end += base + 1
            if end <= done or last[end] >= 0:
                continue
            start = end - n
            if start == 0 or (last[start] >= 0 and self.stable(last[start], tid)):
                last[end] = tid
        return last

    def table_of(self, raw: bytes) -> array:
        """last_tokens of a whole piece, kept for the next time; not to be changed."""
        table = self._tables.get(raw)
        if table is None:
            table = self._tables[raw] = self.last_tokens(raw)
        return table

    def ids_from_table(self, last: array) -> list[int]:
        out, i = [], len(last) - 1
        while i > 0:
            tid = last[i]
            out.append(tid)
            i -= len(self.token_bytes[tid])
        out.reverse()
        return out

    def _solve_segment(self, raw: bytes) -> bytes:
        return array("i", self.ids_from_table(self.last_tokens(raw))).tobytes()

    def segments(self, raw: bytes) -> list[bytes]:
        """raw cut at the byte pairs which no token spans."""
        span, out, at = self._span, [], 0
        for i in range(1, len(raw)):
            if not span[raw[i - 1] << 8 | raw[i]]:
                out.append(raw[at:i])
                at = i
        out.append(raw[at:])
        return out

    def _solve_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8", "replace")
        get = self._segments.__getitem__
        return b"".join(map(get, self.segments(raw))) if len(raw) > 1 else get(raw)

    def trim(self) -> None:
        for memo in (self._pieces, self._segments, self._tables):
            if len(memo) > self.MEMO_SIZE:
                memo.clear()

    def encode_raw(self, text: str) -> bytes:
        """The ids as packed int32; 4 bytes per token."""
        return b"".join(map(self._pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        """Ids; [] for None and "". No special tokens: their spellings are ordinary text."""
        return array("i", self.encode_raw(text)).tolist() if text else []

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def piece_raw(self, piece: str) -> bytes:
        return self._pieces[piece]

    def decode(self, ids) -> str:
        return b"".join(self.token_bytes[i] for i in ids).decode("utf-8", "replace")


class EncodedText:
    """An encoded text that can be appended to and edited without encoding it again.

    Holds the pattern's pieces and, for each, its table of last tokens.  ``append`` and ``replace`` return the number
    of bytes whose table entries had to be computed."""

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe, self.text = bpe, text
        self._cut(0, [])

    def _cut(self, at: int, kept: list) -> int:
        work = 0
        for piece in self.bpe.pieces(self.text[at:]):
            raw = piece.encode("utf-8", "replace")
            kept.append((piece, raw, self.bpe.table_of(raw)))
            work += len(raw)
        self._pieces = kept
        return work

    @classmethod
    def restored(cls, bpe: PrefixBPE, text: str, pieces: list[int], last: array) -> EncodedText:
        """From what stored() gave for the text."""
        out, at, done = cls(bpe), 0, 0
        for n in pieces:
            raw = text[at : at + n].encode("utf-8", "replace")
            out._pieces.append((text[at : at + n], raw, array("i", [-1]) + last[done : done + len(raw)]))
            at, done = at + n, done + len(raw)
        out.text = text
        return out

    def stored(self) -> tuple[list[int], array]:
        """(characters of each piece, last token of each byte prefix of its piece)."""
        last = array("i")
        for _, _, table in self._pieces:
            last.extend(table[1:])
        return [len(p) for p, _, _ in self._pieces], last

    def ids(self) -> list[int]:
        return [t for _, _, table in self._pieces for t in self.bpe.ids_from_table(table)]

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end]; only pieces near the edit are cut and solved again. The two pieces before it are
        cut again, as one may grow into the edit and white space looks one character ahead."""
        before, keep = 0, 0
        while keep < len(self._pieces) and before + len(self._pieces[keep][0]) < start:
            before += len(self._pieces[keep][0])
            keep += 1
        for _ in range(2):
            if keep:
                keep -= 1
                before -= len(self._pieces[keep][0])
        shift = len(new) - (end - start)
        ends, at = {}, before  # old piece starts beyond the edit, in new coordinates
        for k in range(keep, len(self._pieces)):
            if at > end:
                ends[at + shift] = k
            at += len(self._pieces[k][0])
        old, self.text = self._pieces, self.text[:start] + new + self.text[end:]
        kept, work, pos = old[:keep], 0, before
        stale = {p: (r, t) for p, r, t in old[keep : keep + 4]}
        for match in self.bpe.pattern.finditer(self.text, before):
            if match.start() in ends and match.start() > start + len(new):
                kept.extend(old[ends[match.start()] :])
                break
            piece = match.group()
            raw = piece.encode("utf-8", "replace")
            grown = next((t for p, (r, t) in stale.items() if raw.startswith(r)), None)
            if grown is not None:
                work += len(raw) - (len(grown) - 1)
            else:
                work += len(raw)
            kept.append((piece, raw, self.bpe.table_of(raw) if grown is None else self.bpe.last_tokens(raw, grown)))
            pos = match.end()
        self._pieces = kept
        return work


_LOADED: dict[str, PrefixBPE] = {}


def tokenizer_path(spark=None, path: str | None = None) -> str:
    """The rank file: the argument, else the session's sift.tokenizers.dir, else the default folder."""
    if path:
        return path
    folder = spark.conf.get("sift.tokenizers.dir", DEFAULT_DIR) if spark is not None else DEFAULT_DIR
    return os.path.join(folder, DEFAULT_FILE)


def load(path: str) -> PrefixBPE:
    """The encoder of a rank file, built once per process."""
    if path not in _LOADED:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = PrefixBPE(ranks)
    return _LOADED[path]
