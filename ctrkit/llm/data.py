"""What the queries and the pipeline fix: the tokenizer file and the held-out rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctrkit.llm.common import crc_residue

TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
#: Rows whose id's crc32 has this remainder are held out: (modulus, remainder).
TOXIC_HELD_OUT = 5, 0
LANGUAGE_HELD_OUT = 4, 2
#: The ids that end a document in token files and in packed sequences.
FILE_END, SEQUENCE_END = 2, 1


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def held_out(mod: int, remainder: int):
    """Column: a row whose id hashes to the remainder; a row without an id is never held out."""
    return F.coalesce(crc_residue("doc_id", mod) == remainder, F.lit(False))
