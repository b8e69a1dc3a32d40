"""Exact tokenisation of whole texts with the vocabularies of tokenizers files.

Two shapes of vocabulary are recognised in the file, and their merges are run by
tiktoken, which is several times as fast as the library that the file belongs to.  Both
give the same ids: a trained vocabulary makes each token in one way only, so the rank of
a merge and the rank of its result are the same order.  The few texts on which
the two might differ, and files of any other shape, go to the library itself:

* strings of special tokens, which the library turns into their ids;
* characters that one side's Unicode tables have and the other's lack;
* runs of white space too long for tiktoken's pattern matcher.

*Byte level*: no normaliser, one pattern, ids in the order of the merges.

*Word ends*: the last byte of a piece carries an end mark.  The text is normalised and
every piece is set apart by a space, which then stands for the mark: a byte and the
space after it merge before anything else.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe_transducer import PATTERN

#: Blocks with letters that some Unicode tables lack, and how special tokens begin.
_UNSURE = re.compile("[ᲀ-᲏Ꟁ-ꟿ\U00010000-\U0001efff]")
_SPECIAL = "<|"
#: The pattern of word-end files (fixed value), and what it means to RE2.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_APART = r"'(?:s|t|re|ve|m|ll|d)|[^ \p{L}\p{N}]+|\p{N}"
_WHITE = r"[\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_END = "</w>"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes as themselves, the others from U+0100 on."""
    plain = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Library:
    """The library itself, loaded when first needed."""

    def __init__(self, path: str):
        self.path, self.model = path, None

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.model is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(self.path)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Encoder:
    """Packed little-endian unsigned 32-bit ids of whole texts; this one leaves all to the library."""

    def __init__(self, path: str):
        self.library = Library(path)

    def batch(self, texts: list[str]) -> list[bytes]:
        return self.library.encode(texts)


class FastEncoder(Encoder):
    """Encodes by ranks, and by the library where the two might differ."""

    def __init__(self, path: str, pattern: str, ranks: dict[bytes, int], ids: np.ndarray | None):
        import tiktoken

        super().__init__(path)
        self.ids = ids
        self.machine = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def prepared(self, texts: list[str]) -> list[str]:
        return texts

    def unsure(self, text: str) -> bool:
        return _SPECIAL in text

    def batch(self, texts: list[str]) -> list[bytes]:
        sure = [not self.unsure(t) for t in texts]
        ready = iter(self.prepared([t for t, yes in zip(texts, sure) if yes]))
        out: list[bytes | None] = []
        for yes in sure:
            try:
                x = self.machine.encode_to_numpy(next(ready), disallowed_special=()) if yes else None
            except ValueError:  # the pattern matcher gave up
                x = None
            out.append(None if x is None else (x if self.ids is None else self.ids[x]).astype("<u4", copy=False).tobytes())
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            for i, x in zip(rest, self.library.encode([texts[i] for i in rest]), strict=True):
                out[i] = x
        return out


class WordEndEncoder(FastEncoder):
    def unsure(self, text: str) -> bool:
        return _SPECIAL in text or not text.isascii() and _UNSURE.search(text) is not None

    def prepared(self, texts: list[str]) -> list[str]:
        lower = [t.lower() if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ").lower() for t in texts]
        spaced = pc.replace_substring_regex(pa.array(lower, pa.large_string()), pattern=_WHITE, replacement=" ")
        apart = pc.replace_substring_regex(spaced, pattern=_APART, replacement=r" \0 ")
        return [t + " " for t in apart.to_pylist()]


def _byte_level(path: str, spec: dict) -> Encoder | None:
    before, vocab = spec["pre_tokenizer"] or {}, spec["model"]["vocab"]
    if spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    to_byte = byte_alphabet()
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
    made = [vocab.get(t) for t in merged]
    if None in made or made != sorted(made) or len(vocab) != 256 + len(merged):
        return None
    return FastEncoder(path, PATTERN, {bytes(to_byte[c] for c in t): i for t, i in vocab.items()}, None)


def _word_ends(path: str, spec: dict) -> Encoder | None:
    kinds = [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])]
    parts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    if spec["model"].get("end_of_word_suffix") != _END or kinds != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in parts] != ["Split", "ByteLevel"]:
        return None
    if parts[0]["pattern"] != {"Regex": WORD_PATTERN} or not parts[0]["invert"] or parts[1].get("use_regex") or parts[1].get("add_prefix_space"):
        return None
    to_byte, vocab = byte_alphabet(), spec["model"]["vocab"]

    def surface(token: str) -> bytes:
        ends = token.endswith(_END)
        return bytes(to_byte[c] for c in token.removesuffix(_END)) + b" " * ends

    first = {surface(t): i for t, i in vocab.items() if len(t.removesuffix(_END)) == 1}
    ends, singles = [bytes([b, 32]) for b in range(256)], [bytes([b]) for b in range(256)]
    if any(x not in first for x in (*ends, *singles)):
        return None
    rows = [(x, first[x]) for x in (*ends, *singles)]
    for m in spec["model"]["merges"]:
        token = "".join(m if isinstance(m, list) else m.split(" "))
        rows.append((surface(token), vocab[token]))
    if len({x for x, _ in rows}) != len(rows):
        return None
    pattern = f"(?:{WORD_PATTERN}) "
    return WordEndEncoder(path, pattern, {x: rank for rank, (x, _) in enumerate(rows)}, np.array([i for _, i in rows], dtype="<u4"))


_MADE: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a tokenizers file; one for each Python worker."""
    if path not in _MADE:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        plain = spec["model"].get("type") == "BPE" and not any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        plain = plain and all(t["content"].startswith(_SPECIAL) and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
        _MADE[path] = (plain and (_byte_level(path, spec) or _word_ends(path, spec))) or Encoder(path)
    return _MADE[path]
