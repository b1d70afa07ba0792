"""Token ids of texts under a public tokenizer file, and pieces of text that a byte-level tokenizer's merges never cross."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache, cached_property

import numpy as np

#: How byte-level BPE cuts a text into pre-tokens (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A run of white space of so many signs is merged apart from the pattern above.
LONG_RUN = 100_000


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def units(text: str) -> list[str]:
    """text cut before every space; all but the first unit stand for ' ' + unit.

    The pre-tokenizer starts a new pre-token at a space that follows a character other than white space, so a unit can
    be encoded by itself if it and the one before hold something. An empty unit, or one that ends in white space, is a
    run of white space, which the pre-tokenizer cuts by what comes next: such units are joined with the next one.
    """
    out = text.split(" ")
    if "" not in out and not any(map(str.isspace, [u[-1] for u in out])):
        return out
    joined: list[str] = []
    parts: list[str] = []  # of the unit that is still open
    for u in out:
        parts.append(u)
        if u and not u[-1].isspace():
            joined.append(" ".join(parts))
            parts = []
    return joined + ([" ".join(parts)] if parts else [])


@cache
def cutter(path: str) -> Callable[[str], list[str]] | None:
    """How a unit is cut into pre-tokens under a byte-level BPE file; None for any other file.

    A unit that holds a special string isn't cut: the library takes the string out before it looks for pre-tokens.
    """
    import regex

    if path.endswith(".model"):
        return None
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = [t["content"] for t in file.get("added_tokens", [])]
    if not _byte_level(file) or any(" " in s for s in special):
        return None
    find = regex.compile(PRE_TOKEN).findall
    marks = regex.compile("|".join(map(regex.escape, special))).search if special else lambda unit: None
    return lambda unit: [unit] if marks(unit) else find(unit)


def piece_counts(texts: list[str], path: str) -> list[int]:
    """How many tokens each text has by itself, as the file's library counts them."""
    if not texts:
        return []
    if path.endswith(".model"):
        return [len(ids) for ids in sentence_pieces(path).encode(texts)]
    return [len(e.ids) for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]


@cache
def sentence_pieces(path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=path)


def _bytes_by_sign() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(others)}


def _byte_level(file: dict) -> bool:
    """Whether a tokenizers file is a byte-level BPE with the usual pre-tokens and nothing that crosses them."""
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    return plain and usual and not file.get("normalizer") and not any(t.get(k) for t in file.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip"))


class Ranked:
    """A byte-level BPE file run by tiktoken, which gives the same ids as the tokenizers library and is faster.

    Merging the pair of least rank first is what the file's merges say only if ids grow in the order of the merges; `of`
    gives None for a file of which that is not so, or of another kind.
    """

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int]) -> None:
        import regex
        import tiktoken

        self._cut = tiktoken.Encoding("file", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
        self._ranks = ranks
        self._special = special
        self._marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._runs = regex.compile(rf"\p{{White_Space}}{{{LONG_RUN},}}")

    @classmethod
    def of(cls, file: dict) -> Ranked | None:
        if not _byte_level(file):
            return None
        model = file["model"]
        special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        vocabulary = model["vocab"]
        joined = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(joined, joined[1:])):
            return None
        sign = _bytes_by_sign()
        return cls({bytes(sign[c] for c in token): rank for token, rank in vocabulary.items() if token not in special}, special)

    @cached_property
    def _whole(self):
        """What takes a text for one pre-token."""
        import tiktoken

        return tiktoken.Encoding("pre-token", pat_str=r"(?s:.+)", mergeable_ranks=self._ranks, special_tokens={})

    def plain(self, text: str) -> list[int]:
        """Ids of a text in which special strings are plain text.

        A long run of white space is a pre-token, but for its last sign if something follows: it is cut out and merged by
        itself, as the pre-tokens' pattern keeps a place on a bounded stack for each of its signs.
        """
        if len(text) < LONG_RUN:
            return self._cut.encode_ordinary(text)
        out, at = [], 0
        for run in self._runs.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self._cut.encode_ordinary(text[at : run.start()])
            out += self._whole.encode_ordinary(text[run.start() : end])
            at = end
        return out + self._cut.encode_ordinary(text[at:])

    def ids(self, text: str) -> list[int]:
        """Ids of a text in which special strings become their tokens."""
        out, at = [], 0
        for mark in self._marks.finditer(text) if self._marks else ():
            out += [*self.plain(text[at : mark.start()]), self._special[mark.group()]]
            at = mark.end()
        return out + self.plain(text[at:])


def _file(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


@cache
def _ranked(path: str) -> Ranked | None:
    return Ranked.of(_file(path))


@cache
def id_encoder(path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit integers, as the tokenizers library gives them for the file.

    Special strings in a text become their special tokens, as is the library's default. A byte-level BPE file is run by
    the faster of the two public libraries that give its ids; every other .json file by the tokenizers library, and a
    .model file by sentencepiece.
    """
    if path.endswith(".model"):
        return lambda text: np.asarray(sentence_pieces(path).encode(text), "<u4").tobytes()
    if (ranked := _ranked(path)) is not None:
        return lambda text: np.asarray(ranked.ids(text), "<u4").tobytes()
    return lambda text: np.asarray(tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@cache
def plain_encoder(path: str) -> Callable[[str], list[int]]:
    """text -> its ids under a tokenizers file, special strings as plain text."""
    if (ranked := _ranked(path)) is not None:
        return ranked.plain
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids


@cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level BPE file stands for; none for ids that the file leaves out."""
    sign = _bytes_by_sign()
    vocabulary = _file(path)["model"]["vocab"]
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(sign[c] for c in token) if all(c in sign for c in token) else token.encode()
    return out


@cache
def piece_bytes(path: str) -> list[bytes]:
    """The bytes that each id of a sentencepiece model stands for: its piece with U+2581 as space, <0xHH> as a byte."""
    model = sentence_pieces(path)
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.vocab_size())))]


@cache
def _pieces_end_before_spaces(path: str) -> bool:
    model = sentence_pieces(path)
    return not any("\u2581" in p.lstrip("\u2581") for p in map(model.id_to_piece, range(model.vocab_size())))


def spaced_piece_ids(units: list[str], path: str) -> list[list[int]]:
    """Ids of units that each begin with a space, under a sentencepiece model that puts a space before a text.

    A text's ids are those of its units if no piece has a space after another sign; a model of which that isn't so is
    refused.
    """
    if not _pieces_end_before_spaces(path):
        raise ValueError(f"{path} has pieces that go on after a space")
    model = sentence_pieces(path)
    out = model.encode([u[1:] for u in units], num_threads=1) if units else []
    space = [model.piece_to_id("\u2581")]
    return [ids if len(u) > 1 else space for u, ids in zip(units, out)]
