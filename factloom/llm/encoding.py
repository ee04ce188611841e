"""Tokenizers behind a memo of space-separated chunks; each worker process keeps one memo of bounded size."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from factloom.llm.words import span_hashes

_open: dict[str, ChunkMemo] = {}


class ChunkMemo:
    """Neither vocabulary joins text across a space that follows a non-space, so chunks encode on their own."""

    #: Chunks in each of the two generations that a worker remembers: a full one becomes the old one, and what is still used moves on.
    REMEMBERED = 180_000

    def __init__(self) -> None:
        self.known: dict = {}
        self.old: dict = {}

    def values(self, chunks: list) -> list:
        """What encode() gives for each chunk."""
        if len(self.known) > self.REMEMBERED:
            self.known, self.old = {}, self.known
        out = list(map(self.known.get, chunks))
        if None in out:
            missing = {c for c, v in zip(chunks, out, strict=True) if v is None}
            found = {c: v for c in missing if (v := self.old.get(c)) is not None}
            self.known.update(found)
            if new := list(missing.difference(found)):
                self.known.update(zip(new, self.encode(new), strict=True))
            out = [self.known[c] if v is None else v for c, v in zip(chunks, out, strict=True)]
        return out

    def encode(self, chunks: list) -> list:
        raise NotImplementedError


class PieceCounts(ChunkMemo):
    """Token counts of all prefixes of a text, by a sentencepiece model of merged pairs. A chunk is a run of spaces and a word.

    A chunk's value is the steps of its counts, as packed 16-bit integers: how many tokens more (or fewer) the text has after each of
    its characters, the space before it included.
    """

    REMEMBERED = 450_000
    #: Longer chunks are counted by the dynamic program below, in time that follows their length.
    SHORT = 24

    def __init__(self, path: str) -> None:
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(self.model.get_piece_size()) if not (self.model.is_unknown(i) or self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.score = {self.model.id_to_piece(i): self.model.get_score(i) for i in ids}
        self.longest = max(map(len, self.score))
        self.pairs: dict[tuple[str, str], bool] = {}

    def encode(self, chunks: list[str]) -> list[bytes]:
        short = [c for c in chunks if len(c) <= self.SHORT]
        known = self.model.encode([c[:k] for c in short for k in range(1, len(c) + 1)], num_threads=1) if short else []
        size = np.fromiter(map(len, short), np.int64, len(short))
        heads = np.cumsum(size) - size + np.arange(len(short))  # where each chunk's own space stands among all steps
        counts = np.ones(len(known) + len(short), np.int64)
        inside = np.ones(len(counts), bool)
        inside[heads] = False
        counts[inside] = np.fromiter(map(len, known), np.int64, len(known))
        steps = np.diff(counts, prepend=0)
        steps[heads] = 1
        data, at = steps.astype("<i2").tobytes(), dict(zip(short, zip((2 * heads).tolist(), (2 * (heads + size + 1)).tolist(), strict=True), strict=True))
        return [data[slice(*at[c])] if c in at else self._steps(self.prefixes("▁" + c.replace(" ", "▁"))) for c in chunks]

    @staticmethod
    def _steps(counts: list[int]) -> bytes:
        return np.diff(np.array(counts, np.int64), prepend=0).astype("<i2").tobytes()

    def _merged(self, symbols: list[str]) -> list[str]:
        """The model's own merging: the pair of the best score first, the leftmost of equal ones."""
        while len(symbols) > 1:
            score, at = max((self.score.get(a + b, -np.inf), -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if score == -np.inf:
                break
            symbols[-at : 2 - at] = ["".join(symbols[-at : 2 - at])]
        return symbols

    def prefixes(self, symbols: str) -> list[int]:
        """Tokens of each prefix: the last token of a prefix is the one that stays apart from the last token of what is before it."""
        counts, last = [0], [""]
        for end in range(1, len(symbols) + 1):
            for size in range(min(self.longest, end), 0, -1):
                token, before = symbols[end - size : end], last[end - size]
                if size > 1 and token not in self.score:
                    continue
                if before and (apart := self.pairs.get((before, token))) is None:
                    apart = self.pairs[before, token] = self._merged(list(before + token)) == [before, token]
                if not before or apart:
                    break
            counts.append(counts[end - size] + (1 if token in self.score else len(token.encode())))
            last.append(token)
        if len(self.pairs) > self.REMEMBERED:
            self.pairs.clear()
        return counts[1:]

    @staticmethod
    def chunks(text: str) -> tuple[list[str], int]:
        """The chunks, each without the one space before it (the first one's is the model's own), and the spaces that end the text. The
        model's mark for a space counts as one."""
        parts = text.replace("▁", " ").split(" ")
        if "" not in parts:
            return parts, 0
        out, spaces = [], 0
        for p in parts:
            if p:
                out.append(" " * spaces + p)
                spaces = 0
            else:
                spaces += 1
        return out, spaces if text else 0

    def steps(self, texts: list[str]) -> list[np.ndarray]:
        """Steps of the counts of all prefixes of each text, one for each code point."""
        split = [self.chunks(t) for t in texts]
        values = iter(self.values([c for chunks, _ in split for c in chunks]))
        out = []
        for chunks, spaces in split:
            parts = [next(values) for _ in chunks]
            if spaces:
                parts.append(self._steps(self.prefixes("▁" * spaces)))
            row = np.frombuffer(b"".join(parts), "<i2")
            if len(row):  # the first space is the model's own, not the text's
                row = np.concatenate([row[:1] + row[1:2], row[2:]])
            out.append(row)
        return out


class WordIds(ChunkMemo):
    """Ids of a tokenizers file, as packed little-endian integers.

    Most texts use Latin letters and ASCII marks alone. There a file with the rules of KNOWN does no more than lower-case, drop white
    space, and split into runs of letters, single digits and runs of marks. Those are found with numpy and encoded once for each
    distinct one. Any other text, and any with a contraction or the mark of a special token, goes chunk by chunk; with other rules in
    the file, texts are encoded whole.
    """

    #: Normalizers and pre-tokenizers, in order, of the files for which the above holds. Fixed values.
    KNOWN = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    OTHER = re.compile("[^\t\n\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e]|<\\||'[a-zA-Z]")
    #: 0 white space, 1 letters, 2 digits, 3 marks.
    KIND = np.full(256, 3, np.uint8)
    KIND[[9, 10, 13, 32]] = 0
    KIND[97:123] = KIND[128:] = 1
    KIND[48:58] = 2

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_file(path)
        rules = json.loads(self.model.to_str())
        steps = [(rules.get(x) or {}).get(f"{y}s", []) for x, y in (("normalizer", "normalizer"), ("pre_tokenizer", "pretokenizer"))]
        pattern = next((x["pattern"].get("Regex") for x in steps[1] if x["type"] == "Split"), None)
        self.known_rules = (*([x["type"] for x in y] for y in steps), pattern) == self.KNOWN
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")

    def encode(self, chunks: list[bytes]) -> list[bytes]:
        found = self.model.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.known_rules:
            return self.encode([t.encode() for t in texts])
        other = [bool(self.OTHER.search(t)) for t in texts]
        plain = iter(self._plain([t for t, x in zip(texts, other, strict=True) if not x]))
        return [b"".join(self.values(t.encode().split(b" "))) if x else next(plain) for t, x in zip(texts, other, strict=True)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        data = "\n".join(texts).lower().encode() + b"\n"
        raw = np.frombuffer(data, np.uint8)
        kind = self.KIND[raw]
        edge = np.ones(len(raw), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        s = np.flatnonzero(edge & (kind > 0))
        if not len(s):
            return [b""] * len(texts)
        ends = np.flatnonzero(edge)
        e = ends[np.searchsorted(ends, s, "right")]
        _, first, at = np.unique(span_hashes(raw, s, e), return_index=True, return_inverse=True)
        ids = self.values([data[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(ids), self.dtype)
        begin, n = (np.cumsum(size) - size)[at], size[at]
        total = np.cumsum(n)
        out = flat[np.repeat(begin - (total - n), n) + np.arange(total[-1])]
        sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)) + 1
        words = np.searchsorted(s, np.concatenate([[0], np.cumsum(sizes)]))
        cuts = np.concatenate([[0], total])[words]
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def opened(kind: type, path: str) -> ChunkMemo:
    key = f"{kind.__name__}:{path}"
    if key not in _open:
        _open[key] = kind(path)
    return _open[key]
