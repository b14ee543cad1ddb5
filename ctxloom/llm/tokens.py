"""Exact whole-text tokenization at column speed.

Byte-pair tokenizers of the supported kinds never merge across a space that has a
non-space on both sides, nor across a newline that has one. A batch is therefore cut there
by Arrow kernels, dictionary-encoded, and only pieces not seen before go through the
tokenizer; texts where a cut would not be safe, and those that spell out a special token, go
through it whole.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from unicodedata import category, is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ctxloom.llm.words import FOLD, raw

#: Texts where a space or newline touches other white space, an end, or the cut mark.
UNSAFE = r"[\s\pZ\x{85}\x{1c}-\x{1f}] | [\s\pZ\x{85}\x{1c}-\x{1f}]|^ | $|\x01|\n[\s\pZ\x{85}\x{1c}-\x{1f}]|[\s\pZ\x{85}\x{1c}-\x{1f}]\n"
#: Bytes of text per step, entries and ids that a worker keeps.
STEP_BYTES, MAX_ENTRIES, MAX_IDS = 4 << 20, 400_000, 4_000_000
#: ASCII marks: none is a letter, a digit, white space or changed by what stands before it.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Before a piece that has no space before it.
MARK = "\x01"
#: A-Z as a-z, a newline as a space.
FLAT = FOLD.copy()
FLAT[10] = 32


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTES = _byte_letters()


class PieceTokenizer:
    """Encodes Arrow string arrays; keeps a bounded cache of pieces between batches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shape = json.loads(self.tokenizer.to_str())
        #: A text that spells out a token such as the one that ends a document has that token's id.
        self.unsafe = "|".join([UNSAFE, *("(?i:" + re.escape(x["content"]) + ")" for x in shape["added_tokens"])])
        #: Of the two kinds known here, one lower-cases and drops spaces, the other keeps both.
        self.lower = "Lowercase" in json.dumps(shape["normalizer"])
        self.lead = "" if self.lower else BYTES[ord(" ")]
        self.firm: dict[str, bool] = {}
        self._clear()

    def _loose(self, stems: pa.Array) -> np.ndarray:
        """Places of stems whose last letter or digit no longer ends them when normalised.

        Some letters come apart into a letter and a combining mark there, and an ASCII mark behind them
        then joins that mark instead of standing alone. ASCII ones never do.
        """
        data, bounds = raw(stems)
        wide = np.flatnonzero((bounds[1:] > bounds[:-1]) & (data[np.maximum(bounds[1:] - 1, 0)] >= 0x80)) if len(data) else np.zeros(0, np.int64)
        if self.tokenizer.normalizer is None or not len(wide):
            return np.zeros(0, np.int64)
        letters = pc.utf8_slice_codeunits(stems.take(pa.array(wide)), -1, None).to_pylist()
        for c in set(letters) - self.firm.keys():
            normal = self.tokenizer.normalizer.normalize_str(c)
            self.firm[c] = bool(normal) and category(normal[-1])[0] in "LN"
        return wide[[not self.firm[c] for c in letters]]

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int64)
        self.lens = np.zeros(1 << 14, np.int64)
        self.steps = np.zeros(1 << 14, np.int32)

    def _make_room(self) -> None:
        """Forget pieces that a single step has used; all, where that isn't enough."""
        keep = np.flatnonzero(self.steps[: len(self.known)] > 1)
        if len(keep) > MAX_ENTRIES // 2:
            return self._clear()
        names, starts, lens = list(self.known), self.starts[keep], self.lens[keep]
        flat = self.flat[np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))]
        self._clear()
        self._store([names[i] for i in keep], flat, lens)

    def _store(self, pieces: list[str], flat: np.ndarray, lens: np.ndarray) -> None:
        n, total = len(self.known), len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(pieces) > len(self.starts):
            self.starts, self.lens, self.steps = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens, self.steps))
        self.flat[self.used : self.used + total] = flat
        self.starts[n : n + len(pieces)] = self.used + np.cumsum(lens) - lens
        self.lens[n : n + len(pieces)] = lens
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.used += total

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, piece: str) -> bool:
        """Whether a piece of letters reaches the model as it is, as one token's bytes."""
        return piece.isalpha() and (not self.lower or piece.isascii() or (piece == piece.lower() and is_normalized("NFC", piece)))

    def _learn(self, pieces: list[str]) -> None:
        """Add pieces in their order. One that begins with the mark has no space before it."""
        tokenize, lead, ids, others = self.tokenizer.model.tokenize, self.lead, [], []
        for i, p in enumerate(pieces):
            word, before = (p[1:], "") if p[:1] == MARK else (p, lead)
            if self._plain(word):
                ids.append([t.id for t in tokenize(before + word if word.isascii() else before + word.encode().decode("latin-1").translate(BYTES))])
            else:
                ids.append(None)
                others.append(i)
        texts = (pieces[i] for i in others)
        for i, found in zip(others, self._whole([p[1:] if p[:1] == MARK else p if p == "\n" else " " + p for p in texts]), strict=True):
            ids[i] = found
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self._store(pieces, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lens.sum())), lens)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths by text, for texts that are safe to cut."""
        if self.lower:  # a newline is a space there, and a word has the same ids wherever it stands
            data, bounds = raw(texts)
            texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(FLAT[data])])
        else:
            mark, none = pa.scalar(MARK, pa.large_string()), pa.scalar("", pa.large_string())
            texts = pc.binary_join_element_wise(mark, pc.replace_substring(texts, "\n", f" \n {MARK}"), none)
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        # Marks behind a letter or digit are cut off before the model sees them: "word" and "word," share their ids.
        bare = pc.utf8_rtrim(words, MARKS)
        ended = pc.and_(pc.match_substring_regex(bare, r"[\pL\pN]$"), pc.less(pc.binary_length(bare), pc.binary_length(words)))
        if len(loose := self._loose(bare)):
            firm = np.ones(len(bare), bool)
            firm[loose] = False
            ended = pc.and_(ended, pa.array(firm))
        stems = pc.if_else(ended, bare, words).dictionary_encode()
        with_tail = np.flatnonzero(ended.to_numpy(zero_copy_only=False))
        tails = pc.struct_field(pc.extract_regex(words.take(pa.array(with_tail)), f"(?s)(?P<tail>[{re.escape(MARKS)}]+)$"), "tail").dictionary_encode()
        names = stems.dictionary.to_pylist()
        n_stems = len(names)
        names += [MARK + x for x in tails.dictionary.to_pylist()]
        names, twice = (names, None) if len(set(names)) == len(names) else (list(dict.fromkeys(names)), names)
        if len(self.known) + len(names) > MAX_ENTRIES or self.used > MAX_IDS:
            self._make_room()
        stem = np.fromiter(map(self.known.get, names, itertools.repeat(-1)), np.int64, len(names))
        if len(new := np.flatnonzero(stem < 0)):
            stem[new] = len(self.known) + np.arange(len(new))
            self._learn([names[i] for i in new.tolist()])
        self.steps[stem] += 1
        if twice:  # marks that stand alone at the head of a line too
            place = dict(zip(names, stem.tolist(), strict=True))
            stem = np.array([place[x] for x in twice], np.int64)
        tail = np.full(len(words), -1, np.int64)
        tail[with_tail] = stem[n_stems:][tails.indices.to_numpy()]
        codes = coded.indices.to_numpy()
        at, tail = stem[:n_stems][stems.indices.to_numpy()][codes], tail[codes]
        ended = np.flatnonzero(tail >= 0)
        tail = tail[ended]
        extra = self.lens[tail]
        all_lens = self.lens[at]
        all_lens[ended] += extra
        ends = np.cumsum(all_lens)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.minimum(np.repeat(self.starts[at] - (ends - all_lens), all_lens) + np.arange(total), len(self.flat) - 1)]
        run = np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra)
        flat[np.repeat(ends[ended] - extra, extra) + run] = self.flat[np.repeat(self.starts[tail], extra) + run]
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return flat, np.diff(bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each; a null text is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        unsafe = pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False)
        if not unsafe.any():
            return self._cut(texts)
        lens = np.zeros(len(texts), np.int64)
        safe_ids, lens[~unsafe] = self._cut(texts.filter(pa.array(~unsafe)))
        whole = [np.array(x, np.uint32) for x in self._whole(texts.filter(pa.array(unsafe)).to_pylist())]
        lens[unsafe] = [len(x) for x in whole]
        flat = np.empty(int(lens.sum()), np.uint32)
        from_safe = np.repeat(~unsafe, lens)
        flat[from_safe] = safe_ids
        flat[~from_safe] = np.concatenate(whole)
        return flat, lens


_KEPT: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    """One per Python worker and vocabulary file, reused by later tasks."""
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = PieceTokenizer(path)
    return _KEPT[path]


def steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES):
    """Slices of ``batch`` with about ``limit`` bytes of text each, a single text at least."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to
