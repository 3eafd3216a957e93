"""Column functions: text cleaning, layout keys and the BM25 expression."""

from termspire.functions.keys import crange, hash_bucket, shift_bucket
from termspire.functions.scoring import inverse_document_frequency, term_score
from termspire.functions.text import split_words, strip_accents, tokenize

__all__ = [
    "crange",
    "hash_bucket",
    "inverse_document_frequency",
    "shift_bucket",
    "split_words",
    "strip_accents",
    "term_score",
    "tokenize",
]
