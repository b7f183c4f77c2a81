"""Public tokenizer vocabularies, read where they are installed and loaded once in each Python worker."""

from __future__ import annotations

import base64
import os
from functools import cache
from typing import Any

import numpy as np

#: Folder of the vocabulary files; each operator that uses one takes it as a parameter.
VOCAB_DIR = "/opt/tokenizers"

#: The special token of the 50k vocabulary and its id.
END_OF_TEXT = {"<|endoftext|>": 50256}


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@cache
def ranks(name: str, vocab_dir: str = VOCAB_DIR) -> dict[bytes, int]:
    with open(os.path.join(vocab_dir, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@cache
def encoder(name: str, vocab_dir: str = VOCAB_DIR) -> Any:
    """The rank file's encoder. With ``byte_bpe_50k`` its ids are those of the JSON file of that name, special token included."""
    import tiktoken

    special = END_OF_TEXT if name == "byte_bpe_50k" else {}
    return tiktoken.Encoding(name, pat_str=_pattern(), mergeable_ranks=ranks(name, vocab_dir), special_tokens=special)


@cache
def json_encoder(name: str, vocab_dir: str = VOCAB_DIR) -> Any:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(os.path.join(vocab_dir, f"{name}.json"))


def ids(text: str, name: str = "byte_bpe_50k", vocab_dir: str = VOCAB_DIR) -> np.ndarray:
    """Token ids of a whole text; the special token's string counts as that token in the 50k vocabulary, as in its JSON file."""
    special: Any = "all" if name == "byte_bpe_50k" else set()
    try:
        return encoder(name, vocab_dir).encode_to_numpy(text, allowed_special=special, disallowed_special=())
    except ValueError:  # the native library's regular expressions run out of stack on very long runs of white space
        return by_pieces(text, name, vocab_dir)
    except BaseException as problem:  # and it panics on some very long runs of one character
        if type(problem).__name__ != "PanicException":
            raise
        return by_pieces(text, name, vocab_dir)


@cache
def _pieces() -> Any:
    import regex

    return regex.compile(_pattern())


def by_pieces(text: str, name: str, vocab_dir: str = VOCAB_DIR) -> np.ndarray:
    """The same ids, for texts of any kind: the text is cut where the vocabulary's pattern cuts it, then each piece is merged."""
    own = encoder(name, vocab_dir)
    special = END_OF_TEXT if name == "byte_bpe_50k" else {}
    out: list[int] = []
    parts = [text]
    for token in special:
        parts = [x for part in parts for x in _between(part.split(token), token)]
    for part in parts:
        if part in special:
            out.append(special[part])
            continue
        for piece in _pieces().finditer(part):
            out += own._encode_single_piece(piece.group().encode("utf-8", "replace"))
    return np.array(out, np.uint32)


def _between(parts: list[str], token: str) -> list[str]:
    return [x for part in parts for x in (part, token)][:-1]


@cache
def fragments(name: str, vocab_dir: str = VOCAB_DIR) -> np.ndarray:
    """By id: whether the token's bytes are no text by themselves, so that a character fell back to bytes."""
    found = np.zeros(1 << 16, bool)
    for token, rank in ranks(name, vocab_dir).items():
        try:
            token.decode("utf-8")
        except UnicodeDecodeError:
            found[rank] = True
    return found
