"""Token counts of whole texts, without running the tokenizer on every text.

Texts are cut into pre-tokens (a run of word-boundary marks and what follows up to the next), which
no piece of the vocabulary crosses. Distinct pre-tokens are merged together by ``ranked_merge``; a
worker remembers their counts, so that a frequent word is merged once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .ranked_merge import PairTable, merge

MARK = "▁"  # stands for a space in the vocabulary
RUN = re.compile(f"{MARK}+[^{MARK}]*")
#: Pre-tokens a worker remembers, the longest of them, and characters merged at once.
REMEMBER, LONGEST, AT_ONCE = 400_000, 256, 1 << 18


class PieceCounter:
    """Counts the pieces of a unigram-scored BPE model with byte fallback and a leading word mark."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        pieces = {model.id_to_piece(i): i for i in range(size) if not special[i]}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece crosses a word boundary; this vocabulary can't be cut into pre-tokens")
        if any(model.is_unused(i) for i in pieces.values()) or sum(map(model.is_byte, range(size))) != 256:
            raise ValueError("only vocabularies with byte fallback and no unused pieces are handled")
        symbols = dict(pieces)
        for p in pieces:
            for c in p:
                symbols.setdefault(c, len(symbols) + size)
        scores = sorted({model.get_score(i) for i in pieces.values()}, reverse=True)
        rank_of = {s: k for k, s in enumerate(scores)}
        rows = [(symbols[p[:k]], symbols[p[k:]], rank_of[model.get_score(i)], i)
                for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        self.table = PairTable(*np.array(rows, np.int64).T)
        code = np.arange(0x110000)
        other = max(symbols.values()) + 1  # characters outside the vocabulary stay alone, as bytes
        self.symbol = (other + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int32)
        self.weight = np.ones(other + 4, np.int64)
        self.weight[other:] = [1, 2, 3, 4]
        for s, k in symbols.items():
            if len(s) == 1:
                self.symbol[ord(s)] = k
                if s not in pieces:
                    self.weight[k] = len(s.encode())
        self.known: dict[str, int] = {}

    def _learn(self, words: list[str]) -> dict[str, int]:
        """Tokens of the words that are too long to be remembered; the others' are put down in ``known``."""
        begin, held, once = 0, 0, {}
        for i in range(len(words) + 1):
            if i == len(words) or held > AT_ONCE:
                part = words[begin:i]
                if part:
                    lengths = np.fromiter(map(len, part), np.int64, len(part))
                    code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
                    left, counts = merge(self.symbol[code], lengths, self.table)
                    owner = np.repeat(np.arange(len(part)), counts)
                    totals = np.bincount(owner, weights=self.weight[left], minlength=len(part)).astype(np.int64)
                    for word, n in zip(part, totals.tolist(), strict=True):
                        (self.known if len(word) <= LONGEST else once)[word] = n
                begin, held = i, 0
            if i < len(words):
                held += len(words[i])
        return once

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the empty text has none."""
        if len(self.known) > REMEMBER:
            self.known = {}
        cut = [RUN.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        once = self._learn(list(new)) if new else {}
        get, known = once.get, self.known
        return [sum(known[w] if w in known else get(w) for w in words) for words in cut] if once else [sum(map(known.__getitem__, words)) for words in cut]


_counters: dict[str, PieceCounter] = {}


def _model_path(model: str) -> str:
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def counter(model: str) -> PieceCounter:
    """The worker's counter for ``model`` (a path, or a name of the installed vocabularies)."""
    if model not in _counters:
        _counters[model] = PieceCounter(_model_path(model))
    return _counters[model]


def token_counts(documents: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """Tokens of every whole text: (doc_id, n_bytes, n_tokens, over_limit). A word without blanks of any length is
    merged in time that goes with its length.

    Null or empty text: 0 bytes, 0 tokens. A null doc_id stays null; repeated rows give repeated
    results; other columns are not read. No shuffle: one pass over the two columns of the scan.
    """
    out = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches):
        tally = counter(model)
        for batch in common.steps(batches):
            words = common.texts(batch)
            tokens = tally.count(words)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.int64()),
                pa.array([len(t.encode()) for t in words], pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents.select("doc_id", "text").mapInArrow(run, out)
