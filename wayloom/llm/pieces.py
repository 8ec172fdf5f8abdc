"""A SentencePiece file's pieces, and texts cut where no piece can cross.

A space stands as U+2581 and one is put before the text. No piece has U+2581 after another character, so every segmentation of a text is that of its chunks: runs of U+2581 with the characters up to the next one.
"""

from __future__ import annotations

import re
from functools import cached_property

SPACE = "▁"
#: Stands for a U+2581 that is in the text itself; a lone surrogate is in no valid text.
LITERAL = "\ud800"
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


class PieceTable:
    """normal: piece to id; byte_id: id of each byte's piece; raw: bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.normal: dict[str, int] = {}
        self.byte_id: list[int] = [sp.unk_id()] * 256
        self.raw: list[bytes] = [b""] * self.size
        self.stored_score = [sp.get_score(i) for i in range(self.size)]
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.normal[piece] = i
                self.raw[i] = piece.replace(SPACE, " ").encode()
        if any(SPACE in p.lstrip(SPACE) for p in self.normal):
            raise ValueError("a piece crosses a word's beginning")

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.normal))


def chunks_of(text: str) -> list[str]:
    """The chunks of a text that has neither U+2581 nor is empty; a plain chunk comes without its leading U+2581."""
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return [c if c.startswith(SPACE * 2) or c == SPACE else c[1:] for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE))]


def whole(chunk: str) -> str:
    """A chunk of chunks_of with its leading U+2581."""
    return chunk if chunk.startswith(SPACE) else SPACE + chunk
