"""Quality rules: base counts of a text, and the fertility of a public tokenizer on it.

Fertility measures, over the whole text's tokens of a sentencepiece vocabulary with byte fallback: characters per token,
the share of byte-fallback tokens, and the entropy of the token distribution in bits. A text is judged by the band of
its main script (most letters). Text that the vocabulary's languages don't look like (random strings, wrong
encodings, shouting) has few characters a token or many fallback bytes; repetition has a low entropy.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import slices, tidy
from tarn.llm.words import Words, mix
from tarn.sources.spread import spread

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Band:
    """Accepted measures of a very long text; ``fits`` widens them for shorter ones."""

    chars_per_token: tuple[float, float]
    fallback: float
    entropy: float


#: Bands by main script; a text without letters is "none". Latin is set by labelled prose (see the README), the others
#: by the share of the vocabulary that their letters have.
BANDS = {
    "latin": Band((1.85, 7.0), 0.10, 6.4),
    "cyrillic": Band((1.2, 7.0), 0.15, 6.0),
    "greek": Band((0.6, 6.0), 0.60, 5.7),
    "arabic": Band((0.5, 6.0), 0.60, 5.7),
    "hebrew": Band((0.5, 6.0), 0.60, 5.7),
    "indic": Band((0.3, 6.0), 0.95, 5.2),
    "cjk": Band((0.3, 4.0), 0.95, 5.2),
    "other": Band((0.2, 8.0), 1.0, 4.7),
    "none": Band((0.5, 8.0), 0.50, 4.7),
}
#: How much a sample of n tokens may differ: the bounds of means by SPREAD / sqrt(n), the entropy (which a short sample
#: can't reach) by ROOT / sqrt(n) + ONE / n bits.
SPREAD, ROOT, ONE = 2.0, 8.0, 34.0
# First code points of Unicode ranges and their scripts ("" for no letter).
_RANGES = [
    (0x0, ""), (0x41, "latin"), (0x5B, ""), (0x61, "latin"), (0x7B, ""), (0xAA, "latin"), (0xAB, ""), (0xB5, "latin"), (0xB6, ""), (0xC0, "latin"), (0xD7, ""), (0xD8, "latin"), (0xF7, ""), (0xF8, "latin"),
    (0x2B0, ""), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x591, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "indic"), (0xE00, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""),
    (0x2E80, "cjk"), (0xA000, "other"), (0xAC00, "cjk"), (0xD7B0, "other"), (0xE000, ""), (0xF900, "cjk"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFF00, ""), (0xFF21, "latin"), (0xFF3B, ""),
    (0xFF41, "latin"), (0xFF5B, ""), (0xFF66, "cjk"), (0xFFE0, ""), (0x10000, "other"), (0x1F000, ""), (0x20000, "cjk"), (0xE0000, ""),
]
_STARTS = np.array([a for a, _ in _RANGES], dtype=np.uint32)
_SCRIPTS = sorted({s for _, s in _RANGES if s})
_CODES = np.array([_SCRIPTS.index(s) if s else len(_SCRIPTS) for _, s in _RANGES])


def main_script(text: str) -> str:
    """The script of most letters; of equal ones the first by name."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = np.bincount(_CODES[np.searchsorted(_STARTS, points, side="right") - 1], minlength=len(_SCRIPTS) + 1)[:-1]
    return _SCRIPTS[int(n.argmax())] if n.any() else "none"


def fits(script: str, n_tokens: int, chars_per_token: float, fallback: float, entropy: float) -> bool:
    """The verdict of the bands, by one rule that is continuous in the length; a text without tokens doesn't fit."""
    if not n_tokens:
        return False
    band, spread = BANDS[script], SPREAD / math.sqrt(n_tokens)
    least, most = band.chars_per_token
    floor = band.entropy - ROOT / math.sqrt(n_tokens) - ONE / n_tokens
    return bool(least * (1 - spread) <= chars_per_token <= most * (1 + spread) and fallback <= band.fallback + spread and entropy >= floor)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    words = Words(texts)
    n = len(words.raw)
    first = words.first

    def per_doc(marks: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))
        return total[cuts[1:]] - total[cuts[:-1]]

    starts_char = (words.raw & 0xC0) != 0x80
    total = np.concatenate(([0], np.cumsum(starts_char, dtype=np.int64)))
    chars = per_doc(total[words.ends] - total[words.starts], first) if len(words) else np.zeros(words.docs, np.int64)
    symbols = per_doc(_SYMBOL[words.raw], words.offsets) if n else np.zeros(words.docs, np.int64)
    repeat = np.zeros(words.docs, dtype=np.int64)
    ok = words.whole(3)
    at = np.flatnonzero(ok)
    if len(at):
        h = words.windows(words.hashes(), 3)[at]
        h = mix(h ^ mix(words.doc_of(at).astype(np.uint64) + np.uint64(1)))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(words), dtype=bool)
        for k in range(3):
            covered[at[twice] + k] = True
        repeat = per_doc(covered, first)
    duplicates = []
    for text in texts.to_pylist():
        seen, found = set(), 0
        if text and "\n" in text:
            for line in text.split("\n"):
                if line.strip("\x20\x09\x0a\x0b\x0c\x0d"):
                    found += line in seen
                    seen.add(line)
        duplicates.append(found)
    return {"n_words": words.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": np.array(duplicates, dtype=np.int64), "n_repeat_words": repeat}


_models: dict[str, tuple[sentencepiece.SentencePieceProcessor, np.ndarray]] = {}


def _model(model_file: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    """One model for each file and worker, and which of its tokens are bytes."""
    if model_file not in _models:
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        _models[model_file] = model, np.array([model.is_byte(i) for i in range(model.vocab_size())])
    return _models[model_file]


def fertility(texts: list[str], model_file: str) -> list[tuple[int, float, float, float]]:
    """Tokens, characters per token, byte-fallback share and entropy of each text; zeros without tokens."""
    model, is_byte = _model(model_file)
    out = []
    for text, ids in zip(texts, model.encode(texts, num_threads=1), strict=True):
        ids = np.array(ids, dtype=np.int64)
        if not len(ids):
            out.append((0, 0.0, 0.0, 0.0))
            continue
        ids.sort()
        edges = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1], [True])))
        share = np.diff(edges) / len(ids)
        out.append((len(ids), len(text) / len(ids), float(is_byte[ids].mean()), float(-(share * np.log2(share)).sum())))
    return out


_RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, n_tokens long, chars_per_token double, fallback_share double, token_entropy double, kept boolean"


def quality(docs: DataFrame, model_file: str) -> DataFrame:
    """Base counts, fertility measures and verdicts of every row's whole text; reads doc_id and text alone.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated 3-word windows. ``kept``: the base
    didn't fail and the measures fit the band. Null and empty texts have zeros and fail. Repeated rows each give
    a row; an empty table gives none.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, 2 << 20):
                texts = part.column("text").fill_null("")
                base = base_counts(texts)
                failed = (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])
                strings = texts.to_pylist()
                measures = fertility(strings, model_file)
                scripts = [main_script(t) for t in strings]
                kept = [not f and fits(s, *m) for f, s, m in zip(failed.tolist(), scripts, measures, strict=True)]
                columns = [part.column("doc_id"), *(pa.array(v, pa.int64()) for v in base.values()), pa.array(failed), pa.array(scripts, pa.string()), *(pa.array(list(v), t) for v, t in zip(zip(*measures, strict=True), (pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)), pa.array(kept, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RESULT.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(tidy(run), _RESULT)
