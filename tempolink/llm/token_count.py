"""Token counts with a whole-token shortcut.

Offline, once: every vocabulary string is encoded alone, and those that come back as their own
single id are proven whole tokens. A pre-token that is one of them counts 1 without merging;
only the rest goes through the library's merges. No merge crosses pre-tokens, so the counts add.

Cases: a null text is empty (0 bytes, 0 tokens); repeated rows give repeated results, and
an empty table no rows; a very long text is counted whole; columns other than the id and the text
are ignored; the added token's string inside a text is that one
token, as the library has it by default.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, texts_of

#: Pre-tokens kept with their counts beyond the vocabulary, a worker, and the longest one kept.
CACHE_WORDS = 1 << 18
CACHE_CHARS = 64
#: The split of byte-level BPE, and its printable stand-ins for bytes.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """A character for each byte: printable Latin-1 stands for itself, others follow from 256."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def plain_bpe(path: str) -> dict:
    """The contents of a byte-level BPE file whose settings leave only the split and the merges;
    ValueError for any other, which the library itself has to read."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("post_processor") or {}
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and not spec.get("normalizer")
        and after.get("type", "ByteLevel") == "ByteLevel"
        and not any(x.get(k) for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not plain:
        raise ValueError(f"{path}: not a plain byte-level BPE")
    return spec


class WholeTokens:
    """Counts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = plain_bpe(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.added = [x["content"] for x in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.symbols = byte_symbols()
        self.split = regex.compile(SPLIT)
        self.whole = self._prove(spec["model"]["vocab"])
        self.counts = dict.fromkeys(self.whole, 1)

    def _prove(self, vocab: dict[str, int]) -> frozenset[str]:
        byte = {s: b for b, s in enumerate(self.symbols)}
        strings: list[tuple[str, int]] = []
        for s, i in vocab.items():
            try:
                strings.append((bytes(byte[c] for c in s).decode("utf-8"), i))
            except (KeyError, UnicodeDecodeError):
                continue  # a part of a character, or an added token
        encoded = self.tokenizer.encode_batch([s for s, _ in strings], add_special_tokens=False)
        return frozenset(s for (s, i), e in zip(strings, encoded, strict=True) if e.ids == [i] and self.split.findall(s) == [s])

    def _merged(self, word: str) -> int:
        n = self.counts.get(word)
        if n is None:
            if len(word) > CACHE_CHARS:
                return self._tokens(word)
            if len(self.counts) >= CACHE_WORDS + len(self.whole):
                self.counts = dict.fromkeys(self.whole, 1)
            n = self.counts[word] = self._tokens(word)
        return n

    def _tokens(self, word: str) -> int:
        return len(self.tokenizer.model.tokenize("".join(map(self.symbols.__getitem__, word.encode("utf-8")))))

    def count(self, text: str) -> int:
        parts = self.cut.split(text) if self.cut else [text]
        return len(parts) - 1 + sum(sum(map(self._merged, self.split.findall(p))) for p in parts if p)


class Library:
    """Counts by the library itself, for kinds of file to which the shortcut doesn't apply."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.count = lambda text: len(model.encode(text))
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self.count = lambda text: len(model.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def counter_for(path: str) -> WholeTokens | Library:
    if path.endswith(".json"):
        try:
            return WholeTokens(path)
        except ValueError:
            pass
    return Library(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_for(path).count
        for b in batches:
            texts = texts_of(b.column("text"))
            n = [count(t) for t in texts]
            size = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
