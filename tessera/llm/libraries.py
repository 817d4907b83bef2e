"""Public tokenizers' libraries on chunks of texts (see :func:`tessera.llm.bpe.chunks`)."""

from __future__ import annotations

import json
import os

import numpy as np

#: Chunks in a call of the tokenizers library.
GROUP = 512


def letters_of_bytes() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def byte_level(path: str) -> bool:
    """Whether a tokenizers file gives the same ids to a text and to its chunks: bytes cut by
    the usual pattern, nothing normalised or cut off, and added tokens that take no white space with them."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    cut = found.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"])) for t in found.get("added_tokens") or [])
    return bool(plain and added and not found.get("normalizer") and not found.get("truncation") and not found.get("padding"))


def library_tokenizer(path: str, plain: bool):
    """The library's tokenizer of a file, without truncation and padding; plain: strings of special tokens are text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = plain
    return tokenizer


class ByteLevelChunks:
    """The tokenizers library on a byte-level vocabulary, called with many chunks as one text:
    tokens never cross the space that starts a chunk, so their bytes say which chunk each is of."""

    def __init__(self, path: str, plain: bool):
        self.tokenizer = library_tokenizer(path, plain)
        letters, added = letters_of_bytes(), {k: t.content for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for token, k in self.tokenizer.get_vocab().items():
            self.bytes[k] = added[k].encode() if k in added else bytes(letters[c] for c in token)
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)

    def encode_text(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<i4")

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks, each with a space before it, one after the other, and how many each has."""
        flat, many = [np.empty(0, "<i4")], [np.empty(0, np.int64)]
        for lo in range(0, len(chunks), GROUP):
            own = chunks[lo : lo + GROUP]
            if not any(not c or c[0].isspace() or c[-1].isspace() for c in own):
                ids = self.encode_text(" " + " ".join(own))
                ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum([len(c.encode()) + 1 for c in own])
                upto = np.searchsorted(ends, wanted) + 1
                if len(ids) and (ends[np.minimum(upto, len(ids)) - 1] == wanted).all():
                    flat.append(ids)
                    many.append(np.diff(upto, prepend=0))
                    continue
            each = [self.encode_text(" " + c) for c in own]
            flat += each
            many.append(np.array([len(x) for x in each], np.int64))
        return np.concatenate(flat), np.concatenate(many)


def pieces_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
