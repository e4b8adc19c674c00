"""Operator 8: token counts by dynamic programming on a trie of the distinct pre-tokens.

A pre-token is a word with the word-begin mark of the vocabulary. The distinct pre-tokens of a batch go into a trie; the
unigram forward score (all segmentations) and the best segmentation's length are computed once per shared prefix, and
the terminal nodes' counts of pieces are added up over each document.
"""

import numpy as np
import pandas as pd

from . import _shared as S
from . import _trie

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
BEGIN = "▁".encode()


def unigram_scores(pieces, byte_share=1e-6):
    """Log probabilities by rank, as 1 / (rank + 2.7); bytes without a piece share ``byte_share``."""
    p = np.r_[1 / (np.arange(pieces.n_given) + 2.7), np.zeros(pieces.size - pieces.n_given)]
    p[: pieces.n_given] *= (1 - byte_share) / p.sum()
    p[pieces.n_given :] = byte_share / max(1, pieces.size - pieces.n_given)
    return np.log(p)


def count_texts(texts, pieces, logp):
    """(pre-tokens, pieces of the best segmentation, log forward score) of each text."""
    split = [t.encode().split() if t else [] for t in texts]
    distinct = sorted(set().union(*split), key=lambda w: (len(w) > _trie.LONG, w)) if split else []
    long = [BEGIN + w for w in distinct if len(w) > _trie.LONG]
    trie = _trie.Trie([BEGIN + w for w in distinct[: len(distinct) - len(long)]], pieces)
    pieces_of = np.r_[trie.at_ends(trie.best(logp)[1], np.int64), np.array([_trie.best_long(w, pieces, logp) for w in long], np.int64)]
    score_of = trie.at_ends(trie.forward(logp[:, None]))[:, 0] if trie.n_words else np.zeros(0)
    score_of = np.r_[score_of, [_trie.forward_long(w, pieces, logp[:, None])[0] for w in long]]
    at = {w: i for i, w in enumerate(distinct)}
    out = np.zeros((len(split), 2), np.int64), np.zeros(len(split))
    for i, ws in enumerate(split):
        if ws:
            ids = np.fromiter(map(at.__getitem__, ws), np.int64, len(ws))
            out[0][i] = len(ws), pieces_of[ids].sum()
            out[1][i] = score_of[ids].sum()
    return out


def token_counts(docs, vocabulary=VOCABULARY, batch_chars=4_000_000):
    """doc_id, n_pretokens, n_tokens and forward_score of every row of ``docs(doc_id, text)``.

    Tries hold the words of about ``batch_chars`` characters of text, which bounds memory; a word of over LONG bytes is worked on alone, in time
    proportional to its length. Null, empty and blank texts
    have 0 pre-tokens, 0 tokens and score 0. Repeated rows are counted each; other columns aren't read; an empty table gives an empty result.
    """
    given = docs.sparkSession.sparkContext.broadcast(_trie.vocabulary(vocabulary))

    def counted(batches):
        pieces = _trie.Pieces(given.value)
        logp = unigram_scores(pieces)
        for pdf in batches:
            size = pdf["text"].str.len().fillna(0).cumsum() // batch_chars
            for _, part in pdf.groupby(size.to_numpy()):
                n, score = count_texts(part["text"], pieces, logp)
                yield pd.DataFrame({"doc_id": part["doc_id"], "n_pretokens": n[:, 0], "n_tokens": n[:, 1], "forward_score": score})

    return docs.select("doc_id", "text").mapInPandas(counted, "doc_id long, n_pretokens long, n_tokens long, forward_score double")


def op8_token_counts(spark, sf_dir):
    return token_counts(S.table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_counts": op8_token_counts}
