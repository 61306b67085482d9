"""Byte-level BPE tokenizer with character offsets, for models whose vocabulary file is at hand."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The published pre-tokenisation pattern of this family of vocabularies.
PATTERN = "|".join(
    (
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?",
        r"\p{N}{1,3}",
        r" ?[^\s\p{L}\p{N}]+[\r\n/]*",
        r"\s*[\r\n]+",
        r"\s+(?!\S)",
        r"\s+",
    )
)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = {b: chr(b) for r in (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100)) for b in r}
    spare = iter(range(0x100, 0x200))
    return [shown[b] if b in shown else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """``encode`` gives ids and n + 1 offsets (code points); ``decode`` turns ids back into text."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int] | None = None, pattern: str = PATTERN) -> None:
        self.vocab, self.special = vocab, special or {}
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.chars = byte_chars()
        self.byte_of = {c: b for b, c in enumerate(self.chars)}
        self.by_id = {i: t for t, i in vocab.items()}
        self.special_by_id = {i: t for t, i in self.special.items()}
        self.pattern = regex.compile(pattern)
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self._memo: dict[str, list[str]] = {}

    @classmethod
    def from_file(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in d["model"]["merges"]]
        pre = d.get("pre_tokenizer") or {}
        found = [p["pattern"]["Regex"] for p in pre.get("pretokenizers", []) if p.get("type") == "Split" and "Regex" in p.get("pattern", {})]
        return cls(d["model"]["vocab"], merges, {t["content"]: t["id"] for t in d.get("added_tokens", [])}, found[0] if found else PATTERN)

    @property
    def size(self) -> int:
        return len(self.vocab) + len(set(self.special) - set(self.vocab))

    def pretokens(self, text: str) -> Iterator[str]:
        """Pieces that cover the text: matches of the pattern, and what lies between them."""
        at = 0
        for m in self.pattern.finditer(text):
            if m.start() > at:
                yield text[at : m.start()]
            if m.end() > m.start():
                yield m.group()
            at = m.end()
        if at < len(text):
            yield text[at:]

    def _pieces(self, word: str) -> list[str]:
        """Merges the pair of lowest rank, wherever it stands in the word, until none is known."""
        if word not in self._memo:
            parts = list(word)
            while len(parts) > 1:
                best = min(zip(parts, parts[1:], strict=False), key=lambda p: self.rank.get(p, 1 << 60))
                if best not in self.rank:
                    break
                joined, i = [], 0
                while i < len(parts):
                    if i + 1 < len(parts) and (parts[i], parts[i + 1]) == best:
                        joined.append(parts[i] + parts[i + 1])
                        i += 2
                    else:
                        joined.append(parts[i])
                        i += 1
                parts = joined
            if len(self._memo) > 100_000:
                self._memo.clear()
            self._memo[word] = parts
        return self._memo[word]

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        ids: list[int] = []
        offsets: list[int] = []
        at = 0
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                ids.append(self.special[part])
                offsets.append(at)
                at += len(part)
                continue
            for word in self.pretokens(part):
                raw = word.encode("utf-8", "surrogatepass")
                # The character that each byte begins or, inside a character, the one after it.
                starts = np.concatenate(([0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word])))
                pos = 0
                for piece in self._pieces("".join(self.chars[b] for b in raw)):
                    if piece not in self.vocab:
                        raise KeyError(f"no id for {piece!r}")
                    ids.append(self.vocab[piece])
                    offsets.append(at + int(np.searchsorted(starts, pos)))
                    pos += len(piece)
                at += len(word)
        return ids, [*offsets, len(text)]

    def decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.special_by_id:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
                out.append(self.special_by_id[i])
            else:
                raw += bytes(self.byte_of[c] for c in self.by_id[i])
        return "".join(out) + raw.decode("utf-8", "replace")


def with_tokens(df: DataFrame, tokenizer: Tokenizer, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """``df`` with ``out_col``: struct of ids, attention mask and offsets."""
    sent = df.sparkSession.sparkContext.broadcast(tokenizer)  # a vocabulary: of fixed size

    @F.pandas_udf("ids array<int>, mask array<tinyint>, offsets array<int>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [sent.value.encode(t or "") for t in texts]
        return pd.DataFrame({"ids": [r[0] for r in rows], "mask": [[1] * len(r[0]) for r in rows], "offsets": [r[1] for r in rows]})

    return df.withColumn(out_col, run(text_col))
