"""Operator 6: language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's likelihood is the sum over all
its segmentations (forward algorithm); a text's is the product over its words. The probabilities are learned by
expectation maximisation, again over all segmentations.
"""

import re
from array import array
from collections import defaultdict
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import _shared as S
from . import _trie

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LETTERS = re.compile(r"[^\W\d_]+")
BEGIN = "▁"
#: ASCII letters in lower case, blanks for all else.
ASCII = bytes(ord(c.lower()) if c.isascii() and c.isalpha() else 32 for c in map(chr, range(256)))
#: Bytes of words and their values, about, that are held from one batch to the next.
HELD = 1 << 26


def runs(text):
    """Lower-cased runs of word characters other than digits and underscores."""
    return text.encode().translate(ASCII).decode().split() if text.isascii() else LETTERS.findall(text.lower())


def word(run):
    """A run with the word-begin mark; empty if it has no letter."""
    return BEGIN + run if run.isalpha() or any(map(str.isalpha, run)) else ""


def words(text):
    """Lower-cased runs of letters, with the word-begin mark."""
    return [w for w in map(word, runs(text or "")) if w]


class Words:
    """Distinct words by number, in order of their first occurrence, and their log likelihoods (languages, words)."""

    def __init__(self, n_languages=0):
        self.n_languages = n_languages
        self.clear()

    def clear(self):
        self.ids = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.value, self.is_word, self.held = np.zeros((self.n_languages, 0)), np.zeros(0, bool), 0

    def tokens(self, texts):
        """The numbers of the runs of all texts, and how many each text has."""
        token, ends = array("q"), []
        for t in texts:
            token.extend(map(self.ids.__getitem__, runs(t or "")))
            ends.append(len(token))
        return np.frombuffer(token, np.int64), np.diff(np.array(ends, np.int64), prepend=0)

    def since(self, first):
        """Words from a number on, as bytes (empty: no word); the places of those of at most LONG bytes in order of words, and of the longer ones."""
        found = [word(r).encode() for r in islice(self.ids, first, None)]
        order = sorted((i for i, w in enumerate(found) if w), key=found.__getitem__)
        return found, [i for i in order if len(found[i]) <= _trie.LONG], [i for i in order if len(found[i]) > _trie.LONG]


class Languages:
    """Language names, log priors and log probabilities (pieces, languages)."""

    def __init__(self, names, prior, logp):
        self.names, self.prior, self.logp = list(names), np.asarray(prior), logp

    def _value(self, known, first, pieces):
        """Works out the words from number ``first`` on."""
        found, short, long = known.since(first)
        value = np.zeros((len(self.names), len(found)))
        if short:
            trie = _trie.Trie([found[i] for i in short], pieces)
            value[:, short] = trie.at_ends(trie.forward(self.logp)).T
        for i in long:
            value[:, i] = _trie.forward_long(found[i], pieces, self.logp)
        known.value, known.is_word = np.concatenate([known.value, value], axis=1), np.r_[known.is_word, np.array([w != b"" for w in found], bool)]
        known.held += sum(map(len, found)) + len(found) * (200 + 8 * len(self.names))

    def predict(self, texts, pieces, known=None):
        """(language or 'und', posterior) of each text. ``known``: Words of texts before, whose values hold; gets those of these texts."""
        known = Words(len(self.names)) if known is None else known
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts))
        if known.held > HELD:
            known.clear()
        first = len(known.ids)
        token, n = known.tokens(texts)
        self._value(known, first, pieces)
        text = np.repeat(np.arange(len(n)), n)
        total = self.prior + np.stack([np.bincount(text, v[token], len(n)) for v in known.value], axis=1)
        some, best = np.bincount(text, known.is_word[token], len(n)) > 0, total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [self.names[k] if x else "und" for k, x in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0)


def fit(docs, vocabulary=VOCABULARY, max_rows=8_000, max_bytes=12, rounds=3, smoothing=0.05):
    """Languages learned from ``docs(doc_id, text, lang)``; rows with null id, text or lang don't count.

    At most ``max_rows`` documents, those of least hash of the id, with their whole texts; words of over LONG bytes are scored, but not learned from. Expected uses of
    pieces are summed on the executors in millionths as integers, so reruns agree; the driver reads a row
    for each piece used and language. Pieces are those of the vocabulary up to ``max_bytes`` and single bytes.
    """
    spark = docs.sparkSession
    S.ensure_checkpoint_dir(spark)
    given = _trie.vocabulary(vocabulary, max_bytes)
    size = _trie.Pieces(given).size
    texts = docs.where("doc_id is not null and text is not null and lang is not null").select("doc_id", "text", "lang")
    ids = texts.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).distinct()
    texts = texts.join(F.broadcast(ids), "doc_id").checkpoint()
    seen = texts.groupBy("lang").count().orderBy("lang").collect()  # a row per language
    names = [r[0] for r in seen]
    if not names:
        return Languages([], [], np.zeros((size, 0)))
    prior = np.log([r[1] / sum(r[1] for r in seen) for r in seen])
    logp = np.full((size, len(names)), -np.log(size))

    def step(shared):
        def expect(batches):
            pieces = _trie.Pieces(given)
            column = {n: i for i, n in enumerate(names)}
            for pdf in batches:
                known = Words()
                token, n = known.tokens(pdf["text"])
                found, short, _ = known.since(0)
                if short:
                    lang = np.repeat(np.array([column[x] for x in pdf["lang"]]), n)
                    weight = np.bincount(token * len(names) + lang, minlength=len(found) * len(names)).reshape(-1, len(names)).astype(float)
                    uses = _trie.Trie([found[i] for i in short], pieces).expected(shared.value, weight[short])
                    piece, lang = np.nonzero(uses)
                    yield pd.DataFrame({"piece": piece, "lang": lang, "uses": np.rint(uses[piece, lang] * 1e6).astype(np.int64)})

        return expect

    for _ in range(rounds):
        made = texts.select("text", "lang").mapInPandas(step(spark.sparkContext.broadcast(logp)), "piece long, lang long, uses long")
        uses = np.zeros(logp.shape)
        for r in made.groupBy("piece", "lang").agg(F.sum("uses")).toLocalIterator():
            uses[r[0], r[1]] = r[2] / 1e6
        everywhere = (uses.sum(1, keepdims=True) + 1e-3) / (uses.sum() + 1e-3 * size)
        logp = np.log((uses + smoothing * size * everywhere) / (uses.sum(0) + smoothing * size))
    return Languages(names, prior, logp)


def identify(docs, model, vocabulary=VOCABULARY, max_bytes=12, batch_chars=4_000_000):
    """doc_id, lang_pred and score (posterior probability) of every row of ``docs(doc_id, text)``.

    Null texts and texts without a letter give 'und' and 0. Only the text is read. Repeated rows give
    repeated results; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, _trie.vocabulary(vocabulary, max_bytes)))

    def identified(batches):
        languages, given = shared.value
        pieces, known = _trie.Pieces(given), Words(len(languages.names))
        for pdf in batches:
            size = pdf["text"].str.len().fillna(0).cumsum() // batch_chars
            for _, part in pdf.groupby(size.to_numpy()):
                lang, score = languages.predict(part["text"], pieces, known)
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": lang, "score": score})

    return docs.select("doc_id", "text").mapInPandas(identified, "doc_id long, lang_pred string, score double")


def op6_language_id(spark, sf_dir):
    docs = S.table(spark, sf_dir, "documents")
    held_out = S.crc_mod(F.col("doc_id"), 3) == 1
    found = identify(docs, fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_id": op6_language_id}
