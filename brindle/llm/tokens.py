"""Token ids of whole texts, by the tokenizers library.

Byte-level BPE with the usual split pattern never merges across the place before a space
that is followed by a non-space, nor across a single line feed between non-spaces. A text
without other white-space runs is therefore cut there at C speed, and any other text by the
split pattern itself. Each distinct piece goes through the library's BPE model once per
worker, and the ids are joined. Texts that may hold a special token's name are encoded by
the library as a whole. All ways give the ids that the library gives for the whole text,
which the tests compare.
"""

from __future__ import annotations

from brindle.llm import shared

END_ID = 0
#: Pieces that a worker remembers; when there are more it starts anew. Only speed depends on it.
CACHE_PIECES = 500_000
LONGEST_PIECE = 48
#: What the quick cuts don't cover: white-space runs, and any white space but spaces and line feeds.
_UNEVEN = ("  ", " \n", "\n ", "\n\n", "\x01", *map(chr, [*range(0x09, 0x0A), *range(0x0B, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words = regex.compile(PATTERN).findall
        self.alphabet = _alphabet()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        """A piece's ids; what is short enough is remembered, and so are its words."""
        words, known = self.words(piece), self.known
        if len(words) == 1:
            ids = self._word(piece)
        else:
            found = []
            for word in words:
                if (one := known.get(word)) is None:
                    one = self._word(word)
                    if len(word) <= LONGEST_PIECE:
                        known[word] = one
                found.append(one)
            ids = b"".join(found)
        if len(piece) <= LONGEST_PIECE:
            known[piece] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        known, out = self.known, []
        for text in texts:
            if len(known) > CACHE_PIECES:
                known.clear()
            if any(s in text for s in self.specials):
                out += self.whole([text])
                continue
            if any(u in text for u in _UNEVEN) or text[:1].isspace() or text[-1:].isspace():
                pieces = self.words(text)
            else:
                pieces = text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")
            out.append(b"".join([known.get(p) or self._piece(p) for p in pieces]))
        return out


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file; pieces it knows stay known between tasks."""
    return shared.remembered(("encoder", path), lambda: Encoder(path))


def batches(texts: list[str], most: int = 1 << 21):
    """(first, texts) groups of at most ``most`` characters, or a single longer text."""
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
