"""Operator 1: near-duplicate documents by an LSH forest over MinHash signatures.

A document's shingle set gets a sketch of 64 MinHash values of one byte. Tree t of the forest sorts all
sketches rotated to begin at value 4 t: documents whose rotated sketches share a long prefix stand next to
each other. Candidates of a document are its neighbours in each order that share at least ``min_depth``
values; how deep the shared prefix goes follows the region (in dense regions neighbours share more). Sorting is a range
partitioning over all trees at once, so a hot region is split like any other, and the ends of neighbouring partitions are
compared in a step of their own. A second pass goes back to depth ``min_depth`` where a region held more neighbours than the
first looked at: it compares the whole region, in tiles, and leaves out what is linked already. Candidates are confirmed on the full shingle sets.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import functions as F

from . import _shared as S

VALUES = 64
SHINGLE = 5
#: Tiles of at most so many rows are compared many at a time.
SMALL = 48
#: Odd multipliers of the 64 hash functions and of the word places in a shingle, from a seeded generator.
_random = np.random.default_rng(20)
_MULTIPLIERS = _random.integers(1, 2**31, VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLACES = _random.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    """64-bit hashes of words, kept."""

    def __missing__(self, word):
        return self.setdefault(word, xxhash.xxh64_intdigest(word))


def shingle_hashes(text, cache):
    """Sorted distinct 64-bit hashes of a text's shingles; empty without words. ``cache``: WordHashes; anything else keeps nothing."""
    known = cache if isinstance(cache, WordHashes) else WordHashes()
    words = text.encode().lower().split()  # bytes: lowers A-Z only, and splits at the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        total = _mix(total + hashes[k : len(words) - n + 1 + k] * _PLACES[k])
    total.sort()
    return total[np.r_[True, total[1:] != total[:-1]]]


def sketch(hashes):
    """64 one-byte MinHash values of a non-empty set, by products with the hashes' upper halves."""
    upper, least = (hashes >> np.uint64(32)).astype(np.uint32), np.full(VALUES, 2**32 - 1, np.uint32)
    for at in range(0, len(upper), 1024):
        part = upper[at : at + 1024]
        least = np.minimum(least, (part[None, :] * _MULTIPLIERS[:, None]).min(1))
    return _mix(least.astype(np.uint64)).astype(np.uint8).tobytes()  # the low byte of the mixed minimum


def _signed(batches):
    cache = WordHashes()
    for pdf in batches:
        if len(cache) > 400_000:
            cache.clear()
        n, digest, sign = [], [], []
        for text in pdf["text"]:
            h = shingle_hashes(text, cache) if text else ()
            n.append(len(h))
            digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            sign.append(sketch(h) if len(h) else None)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "digest": digest, "sketch": sign})


def signed(docs):
    """doc_id, n_shingles, digest (128 bits of the sorted set) and sketch of every row; null where the set is empty."""
    return docs.select("doc_id", "text").mapInPandas(_signed, "doc_id long, n_shingles long, digest binary, sketch binary")


def _depth(a, b):
    """Length of the common prefix of rows."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def _neighbours(tree, rows, ids, group, width, min_depth, least, side=None):
    """Candidate pairs among sorted rows: each row and up to ``width`` following runs of other groups.

    Returns (a, b, agreeing values) and the rows whose last look still shared ``min_depth`` values.
    ``side``: if given, only pairs from different sides count.
    """
    n = len(ids)
    starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (tree[1:] != tree[:-1])])
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, n]))
    a_all, b_all, same_all, more = [], [], [], []
    ends = np.r_[starts[1:], n] - 1
    live_up, live_down = np.arange(n), np.arange(n)
    for k in range(1, width + 1):
        # towards the next runs: their first row; towards the former runs: their last
        i = live_up[run[live_up] + k < len(starts)]
        j = starts[run[i] + k]
        ok = (tree[i] == tree[j]) & (_depth(rows[i], rows[j]) >= min_depth)
        live_up = i[ok]
        p = live_down[run[live_down] - k >= 0]
        q = ends[run[p] - k]
        ok2 = (tree[p] == tree[q]) & (_depth(rows[p], rows[q]) >= min_depth)
        live_down = p[ok2]
        x, y = np.r_[live_up, live_down], np.r_[j[ok], q[ok2]]
        if side is not None:
            cross = side[x] != side[y]
            x, y = x[cross], y[cross]
        keep = (ids[x] != ids[y]) & (group[x] != group[y])
        x, y = x[keep], y[keep]
        same = (rows[x] == rows[y]).sum(1)
        good = same >= least
        a_all.append(np.minimum(ids[x], ids[y])[good])
        b_all.append(np.maximum(ids[x], ids[y])[good])
        same_all.append(same[good])
    more = np.unique(ids[np.r_[live_up, live_down]])
    return np.concatenate(a_all), np.concatenate(b_all), np.concatenate(same_all), more


def _within(rows, group, block, least, best):
    """Candidates in a tile of a region: among its rows, or between its two blocks. Places (i, j), and those of a stretch handed on as (places, whether they ask).

    Rows of the largest group don't ask within a block, nor do those of the larger block between two, as the other side does. A row with at
    most ``best`` candidates of other groups proposes them all; the others are handed on, to be compared on full sets.
    """
    n = len(rows)
    if block[0] != block[-1]:
        here = block == (block[0] if 2 * (block == block[0]).sum() <= n else block[-1])
        asks, others = np.flatnonzero(here), np.flatnonzero(~here)
    else:
        kinds, size = np.unique(group, return_counts=True)
        asks, others = np.flatnonzero(group != kinds[size.argmax()]), np.arange(n)
    i_all, j_all, involved, asking = [], [], np.zeros(n, bool), np.zeros(n, bool)
    for k in range(0, len(asks), 256):
        q = asks[k : k + 256]
        same = np.zeros((len(q), len(others)), np.int16)
        for v in range(VALUES):
            same += rows[q, v][:, None] == rows[others, v][None, :]
        fit = (same >= least) & (group[q][:, None] != group[others][None, :])
        many = fit.sum(1) > best
        involved[others] |= fit[many].any(0)
        asking[q[many]] = True
        i, j = np.nonzero(fit & ~many[:, None])
        i_all.append(q[i])
        j_all.append(others[j])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *i_all]), np.concatenate([none, *j_all]), np.flatnonzero(involved | asking), asking


def _tiles(least, best):
    """Over rows sorted by tile: candidate pairs (kind 0) and rows of tiles to be compared on full sets (kind 1: id, whether it asks, group, tile)."""

    def one(pdf):
        ids, group = pdf["id"].to_numpy(), pdf["comp"].to_numpy()
        rows = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), VALUES)
        i, j, heavy, asking = _within(rows, group, pdf["block"].to_numpy(), least, best)
        x, y = ids[i], ids[j]
        pairs = pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()
        yield pairs.assign(kind=0, comp=0, tile=None)
        if asking.any():
            yield pd.DataFrame({"kind": 1, "a": ids[heavy], "b": asking[heavy].astype(np.int64), "comp": group[heavy], "tile": pdf["tile"].iloc[0]})

    def several(pdf):
        """Tiles of whole rows: small ones of one block together, the others by ``one``."""
        tile, ids, group, block = (pdf[c].to_numpy() for c in ("tile", "id", "comp", "block"))
        starts = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        size = np.diff(np.r_[starts, len(pdf)])
        little = (size <= SMALL) & (np.minimum.reduceat(block, starts) == np.maximum.reduceat(block, starts))
        of = np.repeat(np.arange(len(starts)), size)
        at = np.flatnonzero(little[of])
        rows = np.frombuffer(b"".join(pdf["sketch"].to_numpy()[at]), np.uint8).reshape(len(at), VALUES)
        left, x, y = (starts + size)[of[at]] - at, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(1, SMALL):
            i = np.flatnonzero(left > k)
            i = i[group[at[i]] != group[at[i + k]]]
            i = i[np.count_nonzero(rows[i] == rows[i + k], axis=1) >= least]
            x.append(at[i])
            y.append(at[i + k])
        x, y = np.concatenate(x), np.concatenate(y)
        crowded = np.zeros(len(starts), bool)
        crowded[of[np.bincount(np.r_[x, y], minlength=len(pdf)) > best]] = True
        x, y = (z[~crowded[of[x]]] for z in (x, y))
        pairs = pd.DataFrame({"kind": 0, "a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "comp": 0, "tile": None}).drop_duplicates(["a", "b"])
        yield pairs
        for k in np.flatnonzero(~little | crowded):
            yield from one(pdf.iloc[starts[k] : starts[k] + size[k]].sort_values("block", kind="stable"))

    def tiles(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf["tile"] == pdf["tile"].iloc[-1]).to_numpy()  # may go on in the next batch
            held = pdf[last]
            if not last.all():
                yield from several(pdf[~last])
        if held is not None and len(held):
            yield from several(held)

    return tiles


def _regions(rows, trees, min_depth, least, block_rows, block_shingles, best):
    """Compares all pairs of ``rows(id, comp, sketch, n_shingles)`` of different groups that share ``min_depth`` values in some order.

    Such rows form a region, known by tree and prefix. A region is dealt into blocks by rows and by shingles, and each
    pair of its blocks is a tile, compared by itself; so no pair of a region goes uncompared, whatever its size, and memory is bounded.
    Returns pairs and rows to be compared on full sets (tile, id, asks, comp).
    """
    step = VALUES // trees
    forest = rows.select("id", "comp", "sketch", "n_shingles", F.explode(F.array(*[F.concat(F.lit(bytes([t])), F.substring(F.concat("sketch", "sketch"), 1 + t * step, min_depth)) for t in range(trees)])).alias("region"))
    sizes = forest.groupBy("region").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    sizes = sizes.select("region", F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("s") / block_shingles)).cast("int").alias("blocks")).checkpoint()
    dealt = forest.join(sizes, "region").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.concat("region", F.encode(F.format_string(",%d,%d", F.least("block", "other"), F.greatest("block", "other")), "utf-8"))
    dealt = dealt.select("id", "comp", "sketch", "block", tile.alias("tile"))
    # a stated number: tiles are small in bytes but dear to compare, so they aren't to be merged into few tasks
    dealt = dealt.repartition(S.partitions(rows.sparkSession), "tile").sortWithinPartitions("tile")
    found = dealt.mapInPandas(_tiles(least, best), "kind int, a long, b long, comp long, tile binary").checkpoint()
    return found.where("kind = 0").select("a", "b").distinct(), found.where("kind = 1").selectExpr("tile", "a as id", "b as asks", "comp")


def _frame(kind, **columns):
    n = len(next(iter(columns.values())))
    return pd.DataFrame({"kind": np.full(n, kind, np.int32), **{c: columns.get(c, np.zeros(n, np.int64)) for c in ("a", "b", "same", "tree", "part", "place")}, "row": columns.get("row", [None] * n)})


def _arrays(pdf):
    rows = np.frombuffer(b"".join(pdf["row"]), np.uint8).reshape(len(pdf), VALUES)
    return pdf["tree"].to_numpy(), rows, pdf["id"].to_numpy(), pdf["comp"].to_numpy()


def _scan(width, min_depth, least):
    """Over a sorted partition: pairs (kind 0), rows to look at again (1), the partition's first and last rows (2)."""

    def scan(batches):
        part, held, place = TaskContext.get().partitionId(), None, 0
        overlap = 4 * width
        for pdf in batches:
            if not len(pdf):
                continue
            first = held is None
            pdf = pdf if first else pd.concat([held, pdf], ignore_index=True)
            tree, rows, ids, comp = _arrays(pdf)
            a, b, same, more = _neighbours(tree, rows, ids, comp, width, min_depth, least)
            pairs = pd.DataFrame({"a": a, "b": b, "same": same}).drop_duplicates(["a", "b"])
            yield _frame(0, a=pairs["a"].to_numpy(), b=pairs["b"].to_numpy(), same=pairs["same"].to_numpy().astype(np.int64))
            yield _frame(1, a=more)
            if first:
                head = pdf.head(overlap)
                yield _frame(2, a=head["id"].to_numpy(), b=head["comp"].to_numpy(), tree=head["tree"].to_numpy().astype(np.int64), part=np.full(len(head), part), place=np.arange(len(head)), row=head["row"].tolist())
            held, place = pdf.tail(overlap), place + len(pdf)
        if held is not None:
            yield _frame(2, a=held["id"].to_numpy(), b=held["comp"].to_numpy(), tree=held["tree"].to_numpy().astype(np.int64), part=np.full(len(held), part), place=place + np.arange(len(held)), row=held["row"].tolist())

    return scan


def _seams(width, min_depth, least):
    def seams(pdf):
        pdf = pdf.sort_values(["tree", "row", "a", "part"], kind="stable").reset_index(drop=True)
        rows = np.frombuffer(b"".join(pdf["row"]), np.uint8).reshape(len(pdf), VALUES)
        a, b, same, _ = _neighbours(pdf["tree"].to_numpy(), rows, pdf["a"].to_numpy(), pdf["b"].to_numpy(), width, min_depth, least, pdf["part"].to_numpy())
        return pd.DataFrame({"a": a, "b": b, "same": same.astype(np.int64)})

    return seams


def _candidates(sketches, trees, width, min_depth, least):
    """The first pass of the forest over ``sketches(id, comp, sketch)``: (pairs, rows to look at again, that is with more than ``width`` neighbours or at a partition's end)."""
    spark = sketches.sparkSession
    step = VALUES // trees
    forest = sketches.select("id", "comp", F.posexplode(F.array(*[F.concat(F.substring("sketch", 1 + t * step, VALUES), F.substring("sketch", 1, t * step)) for t in range(trees)])).alias("tree", "row"))
    n = S.partitions(spark)
    sorted_rows = forest.repartitionByRange(n, "tree", "row", "id").sortWithinPartitions("tree", "row", "id")
    found = sorted_rows.mapInPandas(_scan(width, min_depth, least), "kind int, a long, b long, same long, tree long, part long, place long, row binary").checkpoint()
    # a fixed number of rows for each partition, whatever the input
    seams = found.where("kind = 2").groupBy("kind").applyInPandas(_seams(width, min_depth, least), "a long, b long, same long")
    pairs = found.where("kind = 0").select("a", "b").union(seams.select("a", "b"))
    again = found.where("kind > 0").select(F.col("a").alias("id"))  # also those at the partitions' ends
    return pairs.distinct(), again.distinct()


def _hashed(batches):
    cache = WordHashes()
    for pdf in batches:
        if len(cache) > 400_000:
            cache.clear()
        yield pd.DataFrame({"id": pdf["id"], "shingles": [shingle_hashes(t, cache).tobytes() for t in pdf["text"]]})


def _verify(share):
    def verify(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["xa"], pdf["xb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(x), len(y)) < share * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= share * (len(x) + len(y) - common))
            yield pdf.loc[keep, ["a", "b"]]

    return verify


def confirmed(pairs, texts, share):
    """Pairs whose full shingle sets have 100 * intersection >= share * union. ``texts``: id, text of all representatives."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = texts.join(ends, "id").dropDuplicates(["id"]).mapInPandas(_hashed, "id long, shingles binary")
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a")
    x = x.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b")
    return x.select("a", "b", "xa", "xb").mapInPandas(_verify(share), "a long, b long")


def _compare(share):
    """Links between asking rows and the others of a stretch, on full sets; only those that join what isn't yet joined."""

    def compare(pdf):
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        n, asks = len(sets), np.flatnonzero(pdf["asks"].to_numpy() > 0)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), [len(x) for x in sets])
        order = np.flatnonzero(count[column] > 1)
        order = order[np.argsort(column[order], kind="stable")]
        _, column = np.unique(column[order], return_inverse=True)
        row, both = row[order], np.zeros((len(asks), n), np.float32)
        for lo in range(0, column.max(initial=-1) + 1, 4096):
            z = slice(*np.searchsorted(column, [lo, lo + 4096]))
            m = np.zeros((n, min(4096, column[-1] + 1 - lo)), np.float32)
            m[row[z], column[z] - lo] = 1
            both += m[asks] @ m.T
        size, ids = np.array([len(x) for x in sets], np.int64), pdf["id"].to_numpy()
        names, group = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
        label, links = np.arange(len(names)), []  # of each group, the set that it has joined
        for lo in range(0, len(asks), 256):
            common = np.rint(both[lo : lo + 256]).astype(np.int64)
            hit = 100 * common >= share * (size[asks[lo : lo + 256]][:, None] + size[None, :] - common)
            for a, row in zip(asks[lo : lo + 256], hit, strict=True):
                near = np.flatnonzero(row)
                own = label[group[a]]
                other, first = np.unique(label[group[near]], return_index=True)
                new = other != own
                if new.any():  # one link for each set that joins
                    links += [(min(ids[a], ids[k]), max(ids[a], ids[k])) for k in near[first[new]]]
                    label[np.isin(label, other[new])] = own
        return pd.DataFrame(links, columns=["a", "b"])

    return compare


def near_duplicates(docs, share=85, trees=16, width=1, again=8, block_rows=4096, block_shingles=4_000_000, min_depth=4):
    """doc_id, n_shingles, component_id, kept of every row of ``docs(doc_id, text)``.

    Words are lower-cased A-Z and split at ASCII blanks; a set holds the distinct five-word shingles, or the
    whole sequence where words are fewer. Rows of equal sets (by a 128-bit digest) are one node, named by
    its smallest doc_id, so copies cost nothing further. ``share`` is the least percentage
    intersection / union of a link. Candidates come from ``trees`` orders; a pair at 85 % shares
    ``min_depth`` = 4 values in a given order with probability 0.52, in any of 16 with 1 - 8e-6.
    ``width`` neighbours on each side, however deep the prefix they share, are compared in the first pass. Documents whose region went on
    beyond them are compared anew with all of their region outside their component: a region of more than ``block_rows`` rows or
    ``block_shingles`` shingles is dealt into blocks, and every pair of blocks is compared by itself. A document with at most ``again``
    candidates in a tile proposes them; the others' full sets are compared in the tile, which writes only links that join something.
    So no pair of a region goes untested, memory is bounded and rows written don't grow with the
    square of a group. A sketch agreeing in fewer values than 5 standard deviations below ``share`` is no candidate (one in a
    million at ``share``).

    Null, empty or blank texts have no shingles and link with nothing (component_id = doc_id). Null ids link
    with nothing: component_id null, kept false. Rows that share a doc_id are one node. Repeated rows
    give repeated results. Other columns aren't read. An empty table gives an empty result.
    """
    S.ensure_checkpoint_dir(docs.sparkSession)
    p = share / 100
    least = max(1, int(VALUES * (p - 5 * (p * (1 - p) / VALUES) ** 0.5)))
    sign = signed(docs).checkpoint()
    nodes = sign.where("digest is not null and doc_id is not null")
    reps = nodes.groupBy("digest").agg(F.min("doc_id").alias("id"))
    # of a set, the row of the smallest id stands for all; equal sets have equal sketches
    only = nodes.select(F.col("doc_id").alias("id"), "digest", "sketch", "n_shingles").join(reps, ["id", "digest"]).dropDuplicates(["id"]).select("id", "sketch", "n_shingles").checkpoint()
    pairs, region = _candidates(only.withColumn("comp", F.col("id")), trees, width, min_depth, least)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("id"), "text")
    pairs = pairs.checkpoint()
    links = confirmed(pairs, texts, share).checkpoint()
    comp = S.components(links)

    region = only.join(region, "id").join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("comp"), "sketch", "n_shingles").checkpoint()
    more, heavy = _regions(region, trees, min_depth, least, block_rows, block_shingles, again)
    new = confirmed(more.join(pairs, ["a", "b"], "left_anti"), texts, share)
    sets = texts.join(heavy.select("id").distinct(), "id").dropDuplicates(["id"]).mapInPandas(_hashed, "id long, shingles binary")
    joined = heavy.join(sets, "id").repartition(S.partitions(docs.sparkSession), "tile").groupBy("tile").applyInPandas(_compare(share), "a long, b long")
    comp = S.components(links.union(new).union(joined))
    named = reps.join(comp, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = sign.join(named, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def keep_one(docs, **kw):
    """The documents that are first of their component; documents with null ids stay. Repeated rows of a kept id both stay."""
    kept = near_duplicates(docs.select("doc_id", "text"), **kw).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))


def op1_lsh_forest(spark, sf_dir):
    return near_duplicates(S.table(spark, sf_dir, "documents"))


QUERIES = {"op1_lsh_forest": op1_lsh_forest}

ORACLES = {
    "op1_lsh_forest": """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
      s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
      n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1),
      p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
      l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
      r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
      SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) ON a = doc_id"""
}
