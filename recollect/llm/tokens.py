"""Public tokenizers inside tasks: ids, and the bytes of each id. Vocabulary files are read where the task runs."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np


def vocabulary(name: str) -> str:
    """A vocabulary file: a path, or the name of an installed one."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBPE:
    """A byte-level BPE by its ``.json`` file.

    Where the same vocabulary lies beside it as ranks, the regular-expression encoder over ranks does the work, at about
    four times the speed and with the same ids. Texts that its engine refuses (white space by the hundred thousand) go
    to the other library.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary(name)
        self.plain, self.special = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        added = {t.content: i for i, t in self.special.get_added_tokens_decoder().items()}
        self.size = self.special.get_vocab_size()
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=added)

    def ids(self, text: str, special: bool = True) -> list[int]:
        """Ids of a text; with ``special`` the strings of special tokens stand for those tokens, else they are plain text."""
        if self.fast is not None:
            try:
                return self.fast.encode(text, allowed_special="all") if special else self.fast.encode_ordinary(text)
            except ValueError:
                pass
        return (self.special if special else self.plain).encode(text, add_special_tokens=False).ids

    def bytes_of(self) -> list[bytes]:
        """The bytes of every id: byte-level characters stand for one byte each, special tokens for their text."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        added = {i: t.content.encode() for i, t in self.special.get_added_tokens_decoder().items()}
        return [added[i] if i in added else bytes(byte[c] for c in self.special.id_to_token(i) or "") for i in range(self.size)]


class Pieces:
    """A sentence-piece model with byte fallback."""

    def __init__(self, name: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        self.size = self.model.get_piece_size()

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)

    def bytes_of(self) -> list[bytes]:
        """The bytes of every id: U+2581 is a space, ``<0xHH>`` a byte."""
        piece = self.model.id_to_piece
        return [bytes([int(piece(i)[3:5], 16)]) if self.model.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.size)]


@lru_cache(maxsize=4)
def byte_bpe(name: str) -> ByteBPE:
    return ByteBPE(name)


@lru_cache(maxsize=4)
def pieces(name: str) -> Pieces:
    return Pieces(name)


@lru_cache(maxsize=8)
def byte_table(kind, name: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes of every id of a tokenizer, and their lengths; ``kind`` is one of the two loaders above."""
    table = kind(name).bytes_of()
    return table, np.array([len(b) for b in table], dtype=np.int64)
