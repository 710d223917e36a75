"""Token ids of whole columns of text with a public byte-level BPE.

Merges never cross a pre-token, and a corpus has far fewer distinct pre-tokens
than pre-tokens. So a block of texts is cut into pre-tokens with numpy, distinct
ones are looked up by hash, those not seen before by this worker go through the
tokenizers library once, and ids are laid out by array operations. Texts with
special-token strings or with characters outside the tabulated planes are handed
to the library whole. The ids equal ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import regex

from evq.llm.words import span_hashes, text_buffer

#: Pre-tokens a worker remembers (about 50 bytes each); beyond it starts again with an empty table.
MEMORY_ENTRIES = 600_000
#: Code points below this are classified by table; texts with others go to the library whole.
TABLE_END = 0x3000
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3
_APOSTROPHE, _BLANK = 0x27, 0x20
#: The suffixes that the public pre-tokenizer pattern splits off after an apostrophe.
_SHORT = "stmd"
_LONG = ("re", "ve", "ll")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if visible, else the next free one from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def _classes() -> np.ndarray:
    table = np.full(TABLE_END, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        test = regex.compile(pattern)
        for point in range(TABLE_END):
            if test.match(chr(point)):
                table[point] = kind
    return table


class BatchEncoder:
    """Encodes columns of text; one per Python worker (``BatchEncoder.get``)."""

    _made: dict[str, BatchEncoder] = {}

    @classmethod
    def get(cls, path: str) -> BatchEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one worker has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.table = _classes()
        self.letters = str.maketrans({chr(byte): letter for byte, letter in enumerate(byte_letters())})
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes, with the entry of each beside it
        self.entries = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.offsets = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of a column, and the offsets of its rows in them."""
        data, offsets = text_buffer(column)
        rows = len(offsets) - 1
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        bounds = lead[offsets]
        plain = self._plain(column, points, bounds)
        if plain.all():
            return self._encode_plain(points, bounds)
        parts = []
        for flag, start, to in _stretches(plain):
            if flag:
                base = bounds[start]
                ids, offs = self._encode_plain(points[base : bounds[to]], bounds[start : to + 1] - base)
                parts.append((ids, np.diff(offs)))
            else:
                texts = ["" if t is None else t for t in column.slice(start, to - start).to_pylist()]
                found = [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]
                parts.append((np.concatenate(found), np.array([len(f) for f in found])))
        ids = np.concatenate([p[0] for p in parts]) if rows else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))])

    def _plain(self, column: pa.Array, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        import pyarrow.compute as pc

        far = np.concatenate([[0], np.cumsum(points >= TABLE_END)])
        plain = far[bounds[1:]] == far[bounds[:-1]]
        for special in self.specials:
            plain &= ~np.asarray(pc.fill_null(pc.match_substring(column, special), False))
        return plain

    def _encode_plain(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self._pre_token_starts(points, bounds)
        if len(starts) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        ends = np.append(starts[1:], len(points))
        hashes = span_hashes(points, starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > MEMORY_ENTRIES:
            self._forget()
        at = np.searchsorted(self.known, distinct)
        seen = np.zeros(len(distinct), dtype=bool)
        inner = at < len(self.known)
        seen[inner] = self.known[at[inner]] == distinct[inner]
        index = np.empty(len(distinct), np.int64)
        index[seen] = self.entries[at[seen]]
        new = np.flatnonzero(~seen)
        if len(new):
            index[new] = self._learn(points, starts[first[new]], ends[first[new]])
            self.known = np.insert(self.known, at[new], distinct[new])
            self.entries = np.insert(self.entries, at[new], index[new])
        entry = index[inverse]
        lengths = self.lengths[entry]
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.offsets[entry] - total[:-1], lengths) + np.arange(total[-1])
        return self.ids[at], total[np.searchsorted(starts, bounds)]

    def _learn(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode pre-tokens with the library's model and store their ids; the numbers of the new entries."""
        tokenize, letters = self.library.model.tokenize, self.letters
        lengths = ends - starts
        joined = points[np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
        text, at, found = joined.tobytes().decode("utf-32-le"), 0, []
        for length in lengths.tolist():
            word = text[at : at + length].encode().decode("latin-1").translate(letters)
            found.append([t.id for t in tokenize(word)])
            at += length
        counts = np.fromiter(map(len, found), np.int64, len(found))
        made = len(self.lengths)
        self.offsets = np.concatenate([self.offsets, len(self.ids) + np.cumsum(counts) - counts])
        self.lengths = np.concatenate([self.lengths, counts])
        self.ids = np.concatenate([self.ids, np.fromiter((i for f in found for i in f), np.uint32, int(counts.sum()))])
        return np.arange(made, made + len(found))

    def _pre_token_starts(self, points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where pre-tokens start: runs of letters, numbers or other signs with at most one blank before, or white space."""
        n = len(points)
        if n == 0:
            return np.zeros(0, np.int64)
        kind = self.table[points]
        text_start = np.zeros(n + 1, dtype=bool)
        text_start[bounds] = True
        new_run = text_start[:n].copy()
        new_run[1:] |= kind[1:] != kind[:-1]
        new_run[0] = True
        runs = np.flatnonzero(new_run)
        run_kind = kind[runs]
        start = np.zeros(n + 1, dtype=bool)
        start[runs] = True
        # A run that follows white space inside its text: the last white space character is a token start of its own,
        # and a blank takes the run in.
        after_space = np.flatnonzero((run_kind != _SPACE) & ~text_start[runs] & (np.append(_OTHER, run_kind[:-1]) == _SPACE))
        at = runs[after_space]
        start[at - 1] = True
        blank = points[at - 1] == _BLANK
        start[at[blank]] = False
        # Contractions: a lone apostrophe that starts a token, followed by certain letters.
        lone = runs[(points[runs] == _APOSTROPHE) & start[runs]]
        lone = lone[lone + 1 < n]
        lone = lone[~text_start[lone + 1]]
        if len(lone):
            one = np.isin(points[lone + 1], [ord(c) for c in _SHORT])
            second = np.where(lone + 2 < n, points[np.minimum(lone + 2, n - 1)], 0)
            second[text_start[np.minimum(lone + 2, n)]] = 0
            two = np.zeros(len(lone), dtype=bool)
            for pair in _LONG:
                two |= (points[lone + 1] == ord(pair[0])) & (second == ord(pair[1]))
            start[lone[one | two] + 1] = False
            start[lone[one] + 2] = True
            start[lone[two] + 3] = True
        return np.flatnonzero(start[:n])


def _stretches(flags: np.ndarray):
    edges = np.flatnonzero(np.diff(flags)) + 1
    cuts = [0, *edges.tolist(), len(flags)]
    for start, to in zip(cuts[:-1], cuts[1:], strict=True):
        if start < to:
            yield bool(flags[start]), start, to
