"""Dynamic programming over the prefixes of many words at once.

Words go into a trie; a node is a distinct prefix. All nodes of a depth are worked on together, and a prefix that
many words share is worked on once. Pieces that end at a node are found by rolling hashes.
"""

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Words of more bytes are worked on by themselves, from one end to the other, with the same results.
LONG = 256
STRETCH = 1 << 18


class Pieces:
    """A vocabulary of byte strings; the 256 single bytes that are missing come after it, so any word can be cut."""

    def __init__(self, pieces):
        known = {p: i for i, p in enumerate(pieces)}
        self.n_given = len(pieces)
        pieces = [*pieces, *(bytes([b]) for b in range(256) if bytes([b]) not in known)]
        self.size, self.max_len = len(pieces), max(map(len, pieces))
        by_len = {}
        for i, p in enumerate(pieces):
            by_len.setdefault(len(p), []).append(i)
        self.tables, self.marks = {}, {}
        for n, ids in by_len.items():
            if n:
                hashes = self.hash(np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(-1, n))
                order = np.argsort(hashes, kind="stable")
                self.tables[n], self.marks[n] = (hashes[order], np.array(ids, np.int64)[order]), np.zeros(1 << 16, bool)
                self.marks[n][self.mark(hashes)] = True
        self.powers = [np.uint64(pow(int(BASE), n, 2**64)) for n in range(self.max_len + 1)]

    @staticmethod
    def hash(pieces):
        """Of strings of equal length, the rows of a matrix of bytes."""
        h = np.zeros(len(pieces), np.uint64)
        for b in pieces.T:
            h = h * BASE + b.astype(np.uint64) + np.uint64(1)
        return h

    @staticmethod
    def mark(hashes):
        """16 bits of each hash; the search passes over strings without a piece of the same ones."""
        return (hashes * BASE) >> np.uint64(48)

    def find(self, n, hashes):
        """(positions, ids) of those hashes of strings of ``n`` bytes that are pieces."""
        table, ids = self.tables[n]
        maybe = np.flatnonzero(self.marks[n][self.mark(hashes)])
        at = np.searchsorted(table, hashes[maybe])
        at[at == len(table)] = 0
        hit = np.flatnonzero(table[at] == hashes[maybe])
        return maybe[hit], ids[at[hit]]


class Trie:
    """``words``: sorted, distinct, not empty. steps[d]: transitions (piece length, node, earlier node, piece id) into depth d + 1."""

    def __init__(self, words, pieces):
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        buf = np.frombuffer(b"".join(words), np.uint8)
        off = np.r_[0, np.cumsum(length)[:-1]] if n else length
        self.n_words, self.counts, self.steps, self.ends = n, [1], [], []
        active, node_of, change = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
        if n:
            change[0] = True
        hashes, back = [np.zeros(1, np.uint64)], []  # by depth; back[k]: ancestor k + 1 levels up
        depth = 0
        while len(active):
            byte = buf[off[active] + depth]
            fresh = change.copy()
            fresh[1:] |= (byte[1:] != byte[:-1]) | (np.diff(active) != 1)
            fresh[0] = True
            start = np.flatnonzero(fresh)
            parent = node_of[start]
            back = [parent, *(b[parent] for b in back[: pieces.max_len - 1])]
            h = hashes[-1][parent] * BASE + byte[start].astype(np.uint64) + np.uint64(1)
            hashes.append(h)
            depth += 1
            into = []
            for k in pieces.tables:
                if k <= depth:
                    earlier = back[k - 1]
                    hit, ids = pieces.find(k, h - hashes[depth - k][earlier] * pieces.powers[k])
                    if len(hit):
                        into.append((k, hit, earlier[hit], ids))
            self.steps.append(into)
            self.counts.append(len(start))
            node_of = np.cumsum(fresh) - 1
            done = length[active] == depth
            self.ends.append((active[done], node_of[done]))
            active, node_of, change = active[~done], node_of[~done], fresh[~done]
            if depth > pieces.max_len:
                hashes[depth - pieces.max_len - 1] = None

    def forward(self, logp):
        """Log of the sum over all segmentations, for every node; ``logp``: (pieces, models)."""
        alpha = [np.zeros((1, logp.shape[1]))]
        for d, into in enumerate(self.steps):
            now = np.full((self.counts[d + 1], logp.shape[1]), -np.inf)
            for k, node, earlier, ids in into:
                now[node] = np.logaddexp(now[node], alpha[d + 1 - k][earlier] + logp[ids])
            alpha.append(now)
        return alpha

    def at_ends(self, levels, dtype=float):
        """Values of the words' own nodes."""
        out = np.zeros((self.n_words, *levels[0].shape[1:]), dtype)
        for (word, node), level in zip(self.ends, levels[1:], strict=True):
            out[word] = level[node]
        return out

    def best(self, logp):
        """Pieces in each node's best segmentation; ties take fewer pieces."""
        score, count = [np.zeros(1)], [np.zeros(1, np.int64)]
        for d, into in enumerate(self.steps):
            s, c = np.full(self.counts[d + 1], -np.inf), np.zeros(self.counts[d + 1], np.int64)
            for k, node, earlier, ids in into:
                new_s, new_c = score[d + 1 - k][earlier] + logp[ids], count[d + 1 - k][earlier] + 1
                better = (new_s > s[node]) | ((new_s == s[node]) & (new_c < c[node]))
                s[node], c[node] = np.where(better, new_s, s[node]), np.where(better, new_c, c[node])
            score.append(s)
            count.append(c)
        return score, count

    def expected(self, logp, weight):
        """Expected uses of each piece over all segmentations of the words, ``weight``: (words, models)."""
        alpha = self.forward(logp)
        out = np.zeros(logp.shape)
        flow = [np.zeros(a.shape) for a in alpha]
        for (word, node), f in zip(self.ends, flow[1:], strict=True):
            f[node] += weight[word]  # a node ends one word at most
        for d in range(len(self.steps) - 1, -1, -1):
            for k, node, earlier, ids in self.steps[d]:
                share = flow[d + 1][node] * np.exp(alpha[d + 1 - k][earlier] + logp[ids] - alpha[d + 1][node])
                np.add.at(out, ids, share)
                np.add.at(flow[d + 1 - k], earlier, share)
        return out


def _ends(word, pieces):
    """(end, length, id) of the pieces found in a long word, as arrays in order of ends, for one stretch of the word after another."""
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    for lo in range(0, len(word), STRETCH):
        begin = max(0, lo - pieces.max_len)
        b = np.frombuffer(word[begin : lo + STRETCH], np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(b)
        power, back = np.cumprod(np.full(n, BASE)), np.cumprod(np.full(n, inverse))
        hashes = np.r_[np.uint64(0), power * np.cumsum(b * back)]  # of all beginnings
        ends, lengths, ids = [], [], []
        for k in pieces.tables:
            if k <= n:
                hit, found = pieces.find(k, hashes[k:] - hashes[:-k] * pieces.powers[k])
                new = hit + k + begin > lo
                ends.append(hit[new] + k + begin)
                lengths.append(np.full(int(new.sum()), k))
                ids.append(found[new])
        ends, lengths, ids = (np.concatenate(x) for x in (ends, lengths, ids))
        order = np.argsort(ends, kind="stable")
        yield ends[order], lengths[order], ids[order]


def forward_long(word, pieces, logp):
    """Log of the sum over all segmentations of one long word, for each model; only the last places are held."""
    n, at = pieces.max_len + 1, 0
    ring = [np.zeros(logp.shape[1])] * n
    for ends, lengths, ids in _ends(word, pieces):
        for end, k, chance in zip(ends.tolist(), lengths.tolist(), logp[ids], strict=True):
            new = ring[(end - k) % n] + chance
            ring[end % n] = np.logaddexp(ring[end % n], new) if end == at else new  # each place is the end of a byte at least
            at = end
    return ring[at % n]


def best_long(word, pieces, logp):
    """Pieces in one long word's best segmentation; ties take fewer pieces."""
    n, at = pieces.max_len + 1, 0
    score, count = [0.0] * n, [0] * n
    for ends, lengths, ids in _ends(word, pieces):
        for end, k, s in zip(ends.tolist(), lengths.tolist(), logp[ids].tolist(), strict=True):
            new = (score[(end - k) % n] + s, -count[(end - k) % n] - 1)
            if end != at or new > (score[end % n], -count[end % n]):
                score[end % n], count[end % n] = new[0], -new[1]
            at = end
    return count[at % n]


def vocabulary(path, max_bytes=None):
    """Pieces of a public sentencepiece model in rank order, as bytes, without controls and byte placeholders."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p for p in pieces if max_bytes is None or len(p) <= max_bytes]
