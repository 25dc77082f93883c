"""Reading of sentence-piece model files: the protobuf fields that encoding depends on."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

# Numbers of the published model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_TYPE, WHITESPACE_AS_SUFFIX, BYTE_FALLBACK = 3, 24, 35
UNIGRAM, BPE = 1, 2
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
# End of fixed values.


@dataclass
class PieceModel:
    """Pieces in id order with score and type, and the settings of trainer and normaliser."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    whitespace_as_suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: numbers of varints, else raw bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise ValueError(f"not a piece model: wire type {wire}")
            value, at = data[at : at + size], at + size
        yield number, value


def parse(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in _fields(data):
        if number == PIECES:
            piece = dict(_fields(value))
            model.pieces.append(piece.get(PIECE_TEXT, b"").decode())
            model.scores.append(struct.unpack("<f", piece.get(PIECE_SCORE, b"\0\0\0\0"))[0])
            model.types.append(piece.get(PIECE_TYPE, NORMAL))
        elif number == TRAINER:
            trainer = dict(_fields(value))
            model.model_type = trainer.get(MODEL_TYPE, UNIGRAM)
            model.byte_fallback = bool(trainer.get(BYTE_FALLBACK, 0))
            model.whitespace_as_suffix = bool(trainer.get(WHITESPACE_AS_SUFFIX, 0))
        elif number == NORMALIZER:
            settings = dict(_fields(value))
            model.charsmap = settings.get(CHARSMAP, b"")
            model.dummy_prefix = bool(settings.get(DUMMY_PREFIX, 1))
            model.remove_extra_spaces = bool(settings.get(REMOVE_EXTRA_SPACES, 1))
            model.escape_spaces = bool(settings.get(ESCAPE_SPACES, 1))
    return model


def load(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return parse(file.read())
