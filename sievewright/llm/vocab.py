"""Reading public vocabulary files on the driver; their pieces travel to the executors, the files do not.

A vocabulary's size is fixed by its file (some 32,000 pieces here, under 1 MB), so it may be broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    model_type: int
    dummy_prefix: bool
    byte_fallback: bool


def default_path() -> str:
    """Where the installed package of public tokenizers keeps its SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=4)
def load(path: str | None = None) -> Vocabulary:
    """The pieces of a SentencePiece model whose normalizer changes nothing but blanks."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path or default_path(), "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only models with the identity normalizer and blanks as prefixes are supported")
    if model.trainer_spec.model_type not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return Vocabulary(
        tuple(p.piece for p in model.pieces),
        tuple(p.score for p in model.pieces),
        tuple(p.type for p in model.pieces),
        model.trainer_spec.model_type,
        norm.add_dummy_prefix,
        model.trainer_spec.byte_fallback,
    )
