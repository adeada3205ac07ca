"""N-gram Jaccard join by universe partition and pigeonhole.

A document's set holds its distinct shingles' hashes. By the hash's leading bits the universe is cut into segments, whose number
grows with the size band, and a document has in each segment a subset of its shingles. Two sets of Jaccard
similarity t or more differ in at most h = (1 - t) / t * size shingles, and so in at most h segments: in any common order of
segment subsets, one of the first h + 1 non-empty subsets of each is equal in both. These are indexed. A document of n
shingles serves partners from t * n up, so it takes the bands of those sizes.

The allocation is cost-based: subsets come in classes by how many documents hold them, so that a document spends its h + 1 places
on the rarest ones. One-deletion neighbourhoods are not part of the index: one for a subset of k shingles is worth two places
and takes k + 1 rows, and as either side of a pair may lack the shingle, every document would have to index all of them.
A document whose shingles crowd into h non-empty subsets or fewer would not be covered (more than 6 standard deviations off). Such documents are counted; where one exists, all documents are also
indexed in the finest band, where each shingle is a segment and h + 1 subsets always exist.

Where each shingle is a segment of its own, only a set's own shingles can be missing in the other: the larger set needs its first
(1 - t) * size + 1 places. Every indexed subset tells its place: what stands before the first common subset of a pair is missing in the
other set, so a pair counts under a subset only if the rest can still be similar enough.
A pair is listed under its first common subset only: members tell the subsets before that others hold too, and those that share one of
these have met there. Bitmaps of all such subsets show early that too many are missing.

A group of documents under one subset is a star around one of them (for common subsets, the one with the largest share of
common subsets, which is nearest to all copies); the pairs of the stars are verified exactly, and the components of the links
found are formed. Members of a group that are still apart meet further such members, then each other, so no link between
components is lost. Only the number of links, where asked for, needs the pairs inside components: their distinct sets are verified all against all, a
large component's in pairs of blocks.

Results in odd cases: a null or empty text, or one without words, has an empty set, n_shingles 0 and itself as component; with
fewer words than n the whole sequence is one shingle; repeated rows and copies share a component; a null doc_id counts as
smaller than all others (a component that holds it has a null component_id); other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_CODE, LOWER, blocks, byte_offsets, discard, ids_repeat, keep_rows, key_to_id, materialize, mix64, ngram_hash, prefix_hash, rows_of, signed, span_hash, word_spans
from tessera.llm.components import components

#: Sets of up to so many shingles have each shingle as a segment of its own; larger ones this many a segment at most.
SINGLES, PER_SEGMENT = 4096, 1.5
#: A subset is common if it is seen so often in lots of LOT subsets that hold it more than once; the most common ones of these.
COMMON_LEAST, COMMON_MOST, LOT = 8, 1 << 20, 1_000_000
#: Rounds of further pivots at most; pairs per member of a group that are simply listed.
MOST_TURNS, PAIRS_PER_ROW = 1, 8
#: A pair meets under its first common subset; so many subsets before are compared to find that it isn't the first. Sets that a task remembers.
LAST, REMEMBERED = 8, 1 << 18
#: Places of sets that a task deals out at once, and buckets for each partition of a shuffle.
DEALT, PER_PARTITION = 1 << 19, 8
#: Longs of the bitmap of a set's keys.
BITMAP = 8
#: Distinct sets of a component that are verified at once; shingles of a slice of their product.
BLOCK, COLUMNS = 256, 4096
#: Shingles per cell of a sketch.
PER_CELL = 4
HASH_BITS = 54  # of a shingle; the other 10 number the documents of a block
BLOCK_DOCS = 1 << (64 - HASH_BITS)
KEY_BITS, CLASS_BITS = 50, 4  # of a subset, and of the class of its count: the order of subsets
#: Layout of a member's `info`: share of common subsets (6 bits), size (26), place (25), band (6).
SHARE_AT, SIZE_AT, PLACE_AT = 57, 31, 6
MOST_SIZE, MOST_PLACE = (1 << 26) - 1, (1 << 25) - 1
U = np.uint64
IS_WORD = np.ones(256, bool)
IS_WORD[32] = IS_WORD[9:14] = False


def token_sets(column: pa.Array, n: int):
    """For each block of documents: first, last, tokens (sorted, distinct; the document's place in the block in the top bits)."""
    buf, at = byte_offsets(column)
    for start, stop in blocks(buf, at):
        for first in range(start, stop, BLOCK_DOCS):
            last = min(stop, first + BLOCK_DOCS)
            low = LOWER[buf[at[first] : at[last]]]
            own = at[first : last + 1] - at[first]
            starts, ends, doc = word_spans(IS_WORD[low], own)
            words = span_hash(prefix_hash(BYTE_CODE[low]), starts, ends)
            grams = ngram_hash(words, n)
            inside = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
            tokens, owner = grams[inside], doc[: len(grams)][inside]
            counts = np.bincount(doc, minlength=last - first)
            for k in np.flatnonzero((counts > 0) & (counts < n)):  # the whole sequence as one
                a = int(np.searchsorted(doc, k))
                tokens = np.append(tokens, ngram_hash(words[a : a + counts[k]], int(counts[k])) ^ U(counts[k]))
                owner = np.append(owner, k)
            tokens = np.sort((owner.astype(U) << U(HASH_BITS)) | (mix64(tokens) >> U(64 - HASH_BITS)))
            if len(tokens):
                tokens = tokens[np.append(True, tokens[1:] != tokens[:-1])]
            yield first, last, tokens


def level_of(sizes: np.ndarray) -> np.ndarray:
    """Bits that number the segments for sets of these sizes (as the smaller of a pair); 0: a segment each."""
    level = np.ceil(np.log2(np.maximum(sizes, 1) / PER_SEGMENT)).astype(np.int64)
    return np.where(sizes <= SINGLES, 0, level)


def sketches(tokens: np.ndarray, docs: int) -> list[bytes]:
    """Each set's counts by range of the hash, in a power of two of cells; 255 also stands for more."""
    owner = (tokens >> U(HASH_BITS)).astype(np.int64)
    sizes = np.bincount(owner, minlength=docs)
    bits = np.ceil(np.log2(np.maximum(sizes / PER_CELL, 1))).astype(np.int64)
    ends = np.cumsum(1 << bits)
    body = tokens & U((1 << HASH_BITS) - 1)
    cell = (body >> (U(HASH_BITS) - bits[owner].astype(U))).astype(np.int64) + (ends - (1 << bits))[owner]
    counts = np.minimum(np.bincount(cell, minlength=int(ends[-1]) if docs else 0), 255).astype(np.uint8)
    return [counts[e - (1 << b) : e].tobytes() for e, b in zip(ends.tolist(), bits.tolist())]


def may_link(a: bytes, b: bytes, size_a: int, size_b: int, t: float) -> bool:
    """Whether sets with these sketches can be similar: cell by cell they share at most the lesser count."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if x.max() == 255 or y.max() == 255:
        return True
    if len(x) > len(y):
        x, y = y, x
    y = y.reshape(len(x), -1).sum(axis=1, dtype=np.int64)
    most = int(np.minimum(x, y).sum())
    return 100 * most >= round(100 * t) * (size_a + size_b - most)


def subsets(tokens: np.ndarray, docs: int, t: float, finest: bool = False):
    """Every document's non-empty segment subsets in the bands that it needs: (document, key, places that it may use, band)."""
    owner = (tokens >> U(HASH_BITS)).astype(np.int64)
    sizes = np.bincount(owner, minlength=docs)
    low, own = level_of(np.ceil(t * sizes - 1e-9)), level_of(sizes)
    places = lambda share: np.floor(share * sizes + 1e-9).astype(np.int64) + 1
    body = tokens & U((1 << HASH_BITS) - 1)
    summed = np.zeros(len(tokens) + 1, U)
    np.cumsum(mix64(body), out=summed[1:])
    bands = ((np.zeros(docs, np.int64), np.ones(docs, bool)),) if finest else ((own, np.ones(docs, bool)), (low, low != own))
    for levels, used in bands:
        mine = levels[owner]
        segment = np.where(mine == 0, body, body >> (U(HASH_BITS) - np.maximum(mine, 1).astype(U)))
        take = used[owner]
        starts = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (owner[1:] != owner[:-1])) if len(tokens) else np.zeros(0, bool))
        ends = np.append(starts[1:], len(tokens))
        keep = take[starts]
        starts, ends = starts[keep], ends[keep]
        key = mix64(summed[ends] - summed[starts] + mine[starts].astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - KEY_BITS)
        single = levels == 0
        yield owner[starts], key, np.where(single, places(1 - t), places((1 - t) / t)), levels


def info_of(share: np.ndarray, size: np.ndarray, place: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Greater sizes and places count as the greatest: bounds get weaker, no pair is lost."""
    return (share << SHARE_AT) | (np.minimum(size, MOST_SIZE) << SIZE_AT) | (np.minimum(place, MOST_PLACE) << PLACE_AT) | band


def chosen(owner: np.ndarray, key: np.ndarray, need: np.ndarray, band: np.ndarray, sizes: np.ndarray, common: np.ndarray, classes: np.ndarray, docs: int):
    """Each document's first subsets, rare ones first: (document, key, common, info)."""
    at = np.minimum(np.searchsorted(common, key), max(len(common) - 1, 0))
    rank = np.where(common[at] == key, classes[at], 0).astype(U) if len(common) else np.zeros(len(key), U)
    held = np.maximum(np.bincount(owner, minlength=docs), 1)
    share = (63 * np.bincount(owner, weights=rank > 0, minlength=docs) / held).astype(np.int64)
    order = np.sort((owner.astype(U) << U(HASH_BITS)) | (rank << U(KEY_BITS)) | key)
    owner = (order >> U(HASH_BITS)).astype(np.int64)
    place = np.arange(len(order)) - np.searchsorted(owner, np.arange(docs))[owner]
    take = place < need[owner]
    owner, order = owner[take], order[take]
    key = order & U((1 << HASH_BITS) - 1)  # with its class: keys are in the order of places
    return owner, key, key >> U(KEY_BITS) > 0, info_of(share[owner], sizes[owner], place[take], band[owner])


def can_link(x: str, y: str, t: float) -> str:
    """SQL: whether two members of a group, told by their `info` (0: not told; band 0: the finest), can link if this
    is their first common subset."""
    size, place = (lambda c: f"(({c} >> {SIZE_AT}) & {MOST_SIZE})"), (lambda c: f"(({c} >> {PLACE_AT}) & {MOST_PLACE})")
    twice = f"CASE WHEN {x} & 63 = 0 THEN 2 * least({size(x)} - {place(x)}, {size(y)} - {place(y)}) ELSE {size(x)} + {size(y)} - greatest({place(x)}, {place(y)}) END"
    whole = round(100 * t)
    return f"(least({size(x)}, {size(y)}) * 100 >= greatest({size(x)}, {size(y)}) * {whole} AND 100 * ({twice}) >= {whole} * (2 * ({size(x)} + {size(y)}) - ({twice})))"


def most_size(x: str, t: float) -> str:
    """SQL: the size that a partner of a member may have at most, by what can_link() asks of this member alone."""
    size, place, whole = f"(({x} >> {SIZE_AT}) & {MOST_SIZE})", f"(({x} >> {PLACE_AT}) & {MOST_PLACE})", round(100 * t)
    return f"CASE WHEN {x} & 63 = 0 THEN {100 + whole} * ({size} - {place}) DIV {whole} - {size} ELSE 100 * {size} DIV {whole} END"


def set_hashes(tokens: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and a 128-bit hash of each document's set."""
    owner = (tokens >> U(HASH_BITS)).astype(np.int64)
    body = tokens & U((1 << HASH_BITS) - 1)
    bounds = np.searchsorted(owner, np.arange(docs + 1))
    out = []
    for salt in (1, 2):
        total = np.zeros(len(tokens) + 1, U)
        np.cumsum(mix64(body + U(salt << 56)), out=total[1:])
        out.append(mix64(total[bounds[1:]] - total[bounds[:-1]] + U(salt)))
    return np.diff(bounds), out[0], out[1]


class _Seen:
    """Which sets a task has met before; forgets all when full."""

    def __init__(self):
        self.known: set = set()

    def new(self, node: np.ndarray, check: np.ndarray) -> np.ndarray:
        out = np.zeros(len(node), bool)
        for k, pair in enumerate(zip(node.tolist(), check.tolist())):
            if pair not in self.known:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known.add(pair)
                out[k] = True
        return out


def _survey(n: int, t: float):
    """Rows (0, doc, row, size, node, check) for documents; (1, subset, count, 0, 0, 0) for subsets that several sets of a lot hold;
    (2, ...) where a document has too few subsets."""

    def recurring(keys):
        value, count = np.unique(np.concatenate(keys), return_counts=True)
        return signed(value[count > 1]), count[count > 1], np.zeros(int(np.sum(count > 1)))

    def rows(kind, a, b, c, d=None, e=None, sketch=None):
        cols = [np.full(len(a), kind, np.int64), *(np.zeros(len(a), np.int64) if x is None else x.astype(np.int64) for x in (a, b, c, d, e))]
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(sketch or [None] * len(a), pa.binary())], names=["k", "a", "b", "c", "d", "e", "sketch"])

    def run(batches):
        keys, held, few, seen = [], 0, 0, _Seen()
        for batch in batches:
            doc, row = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for first, last, tokens in token_sets(batch.column(2), n):
                size, node, check = set_hashes(tokens, last - first)
                yield rows(0, doc[first:last], row[first:last], size, signed(node), signed(check), sketches(tokens, last - first))
                new = seen.new(node, check)
                for owner, key, need, _ in subsets(tokens, last - first, t):
                    present = np.bincount(owner, minlength=last - first)
                    few += int(np.sum((present > 0) & (present < need)))
                    keys.append(key[new[owner]])
                    held += len(keys[-1])
                if held > LOT:
                    yield rows(1, *recurring(keys))
                    keys, held = [], 0
        if held:
            yield rows(1, *recurring(keys))
        if few:
            yield rows(2, np.array([few]), np.zeros(1), np.zeros(1))

    return run


def dealt(key: np.ndarray, node: np.ndarray, info: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row of INDEX for each bucket. Holders of a common subset are known to be several: they are spread evenly."""
    bucket = (mix64(np.where(key >> U(KEY_BITS) > 0, key ^ mix64(node.view(U)), key)) % U(buckets)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    held, starts = np.unique(bucket[order], return_index=True)
    offsets = pa.array(np.append(starts, len(order)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (signed(key), node, info)]
    return pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), *lists], names=["bucket", "key", "node", "info"])


def _index(n: int, t: float, shared, buckets: int, finest: bool = False):
    """(key, node, info) of each set's places, many in a row; a set once a task."""

    def run(batches):
        common, classes, alike = (np.frombuffer(x, np.int64) for x in shared.value)
        seen, found, held = _Seen(), [], 0
        for batch in batches:
            for first, last, tokens in token_sets(batch.column(2), n):
                size, node, check = set_hashes(tokens, last - first)
                new = seen.new(node, check)
                node = np.where(np.isin(signed(node), alike), signed(check), signed(node))
                for owner, key, need, band in subsets(tokens, last - first, t, finest):
                    own = new[owner]
                    owner, key, _, info = chosen(owner[own], key[own], need, band, size, common.view(U), classes, last - first)
                    found.append((key, node[owner], info))
                    held += len(key)
                if held >= DEALT:
                    yield dealt(*map(np.concatenate, zip(*found)), buckets)
                    found, held = [], 0
        if held:
            yield dealt(*map(np.concatenate, zip(*found)), buckets)

    return run


INDEX = "bucket int, key array<long>, node array<long>, info array<long>"
GROUPS = "key long, node long, info long"


def several_hold(parts: list) -> pa.RecordBatch:
    """A bucket's (key, node, info) -> each pair of key and node once, without the keys that are not common and only one node holds."""
    key, node, info = map(np.concatenate, zip(*parts))
    for pairs in (False, True):  # most keys are left out before pairs are sorted
        order = np.lexsort((node, key)) if pairs else np.argsort(key)
        key, node, info = key[order], node[order], info[order]
        new_key = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        new = new_key | np.append(True, node[1:] != node[:-1]) if pairs and len(key) else np.ones(len(key), bool)
        group = np.cumsum(new_key) - 1
        take = new & ((np.bincount(group, weights=new)[group] > 1) | (key >> KEY_BITS > 0)) if len(key) else new
        key, node, info = key[take], node[take], info[take]
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(info)], names=["key", "node", "info"])


def _shared(batches):
    """Rows of INDEX sorted by bucket -> what several_hold() leaves of each bucket."""
    own, parts = None, []
    for batch in batches:
        bucket = np.asarray(batch.column(0))
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
        for a, b in zip(starts, np.append(starts[1:], len(bucket))):
            if parts and bucket[a] != own:
                yield several_hold(parts)
                parts = []
            own = bucket[a]
            parts.append([np.asarray(batch.column(k).slice(a, b - a).flatten()) for k in (1, 2, 3)])
    if parts:
        yield several_hold(parts)


def _tokens(n: int):
    def run(batches):
        for batch in batches:
            out = []
            for first, last, tokens in token_sets(batch.column(1), n):
                bounds = np.searchsorted(tokens >> U(HASH_BITS), np.arange(last - first + 1, dtype=U))
                body = tokens & U((1 << HASH_BITS) - 1)
                out += [body[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["node", "tokens"])

    return run


def linked(a: np.ndarray, b: np.ndarray, t: float) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int(np.count_nonzero(large[at] == small))
    return 100 * common >= round(100 * t) * (len(a) + len(b) - common)


def _verify(t: float):
    def run(batches):
        for batch in batches:
            sets = [[np.frombuffer(x, U) for x in batch.column(k).to_pylist()] for k in (2, 3)]
            good = np.array([linked(x, y, t) for x, y in zip(*sets)], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    return run


def _prune(t: float):
    def run(batches):
        for batch in batches:
            good = np.array([may_link(a, b, m, n, t) for m, n, a, b in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))], bool)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    return run


class _Checker:
    """Verifies pairs of nodes; loads only the texts that pairs need."""

    def __init__(self, rows: DataFrame, nodes: DataFrame, n: int, t: float):
        self.rows, self.nodes, self.n, self.t = rows, nodes, n, t

    def __call__(self, pairs: DataFrame, label: str) -> DataFrame:
        """Distinct pairs (a < b) -> those that link."""
        a, b = (self.nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        pairs = pairs.join(a, "a").join(b, "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(_prune(self.t), "a long, b long")
        pairs = materialize(pairs, f"{label}-pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = materialize(ends.join(self.nodes, "node").select("node", "at.doc", "at.row"), f"{label}-nodes")
        texts = self.rows.join(wanted, ["doc", "row"]).select("node", "text")
        tokens = materialize(texts.mapInArrow(_tokens(self.n), "node long, tokens binary"), f"{label}-sets")
        a, b = (tokens.select(F.col("node").alias(x), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
        found = pairs.join(a, "a").join(b, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(_verify(self.t), "a long, b long")
        links = materialize(found, f"{label}-links")
        for x in (pairs, wanted, tokens):
            discard(x)
        return links


def _ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _reach(t: float) -> list:
    """The least size of a group's members, and the greatest that a partner of one may have."""
    return [F.min(F.expr(f"(info >> {SIZE_AT}) & {MOST_SIZE}")).alias("least_size"), F.max(F.expr(most_size("info", t))).alias("most_size")]


def _reached(t: float):
    """Whether some size of the group, as in _reach(), is one that a partner of this member may have, and the member's size one that some member asks for."""
    return F.expr(f"{most_size('info', t)} >= least_size AND ((info >> {SIZE_AT}) & {MOST_SIZE}) <= most_size")


def _placed(members: DataFrame, t: float) -> DataFrame:
    """Members of groups (key, node, info) -> with `before`: the node's last LAST keys before this one that others hold too; `own`: how many of its places
    nobody else holds (in the finest band), its last key that others hold, and a bitmap of these keys. In `info` the place also counts the later places that
    nobody else holds, as what these stand for is missing in every other set; rows that so can't link with any set, or with none of their group's sizes, are
    left out, and so are keys whose members all have the same key before (their pairs meet there). Lists and bitmaps are kept by node and join only what is left."""
    place, size, band = (lambda c: (F.shiftright(c, PLACE_AT).bitwiseAND(MOST_PLACE))), F.expr(f"(info >> {SIZE_AT}) & {MOST_SIZE}"), F.expr("info & 63")
    one = F.struct("key", "info")
    by_node = members.groupBy("node", band.alias("band")).agg(F.sort_array(F.collect_list(one)).alias("held"), F.max(size).alias("size"))  # a set's own places
    by_node = materialize(by_node.withColumn("keys", F.transform("held", lambda h: h["key"])), "by-node")
    held, need = F.size("keys"), F.floor(F.lit(1 - t) * F.col("size") + 1e-9) + 1  # places of a set in the finest band
    bit = lambda key: F.pmod(F.xxhash64(key), F.lit(64 * BITMAP)).cast("int")
    part = lambda k: F.aggregate(F.filter("keys", lambda key: F.floor(bit(key) / 64) == k), F.lit(0).cast("long"), lambda a, key: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(key) % 64)))
    alone = F.when(F.col("band") == 0, F.greatest(F.lit(0), need - held)).otherwise(0).cast("long")
    lists = by_node.select("node", "band", "keys", F.struct(alone.alias("alone"), F.element_at("keys", -1).alias("end"), F.array(*[part(k) for k in range(BITMAP)]).alias("bits")).alias("own"))

    rows = by_node.select("node", "band", "size", need.alias("need"), held.alias("n"), "keys", F.posexplode("held").alias("at", "h"))
    rows = rows.withColumn("place", place("h.info")).withColumn("later", F.col("n") - 1 - F.col("at"))
    missing = F.col("place") + F.when(F.col("band") == 0, F.greatest(F.lit(0), F.col("need") - 1 - F.col("place") - F.col("later"))).otherwise(0)
    rows = rows.withColumn("missing", missing.cast("long")).where(f"band <> 0 OR 100 * (size - missing) >= {round(100 * t)} * size")
    info = F.col("h.info") + F.shiftleft(F.least("missing", F.lit(MOST_PLACE)) - F.col("place"), PLACE_AT)
    # who has no key before is apart from all others
    last = F.when(F.col("at") > 0, F.get("keys", F.col("at") - 1)).otherwise(F.xxhash64("node"))
    rows = materialize(rows.select(F.col("h.key").alias("key"), "node", "band", "at", info.alias("info"), last.alias("last")), "places")
    several = rows.groupBy("key").agg(F.min("last").alias("low"), F.max("last").alias("high"), *_reach(t)).where("low <> high").drop("low", "high")
    kept = rows.drop("last").join(several, "key").where(_reached(t)).drop("least_size", "most_size").join(lists, ["node", "band"])
    before = F.slice("keys", F.greatest(F.lit(1), F.col("at") + 1 - LAST), F.least("at", F.lit(LAST)))
    out = materialize(kept.select("key", "node", "info", before.alias("before"), "own"), "groups")
    discard(rows)
    discard(by_node)
    return out


def _enough_keys(t: float) -> str:
    """SQL: whether two members can link by all the keys that they have. Of the one whose keys end first, each key that the other lacks is missing in the
    other set: a bit that only the one has stands for one at least, and what nobody else holds for one each."""
    size, whole = (lambda c: f"(({c} >> {SIZE_AT}) & {MOST_SIZE})"), round(100 * t)

    def holds(x: str, y: str, x_info: str, y_info: str) -> str:
        lacks = " + ".join(f"bit_count({x}.bits[{k}] & ~{y}.bits[{k}])" for k in range(BITMAP))
        both = f"({size(x_info)} + {size(y_info)})"
        most = f"CASE WHEN info & 63 = 0 THEN 2 * ({size(x_info)} - {x}.alone - ({lacks})) ELSE {both} - ({lacks}) END"  # twice what they can share
        return f"({most}) * {100 + whole} >= {2 * whole} * {both}"

    return f"CASE WHEN own.end <= y_own.end THEN {holds('own', 'y_own', 'info', 'y_info')} ELSE {holds('y_own', 'own', 'y_info', 'info')} END"


def _grouped(docs: DataFrame, n: int, threshold: float, id_col: str, text_col: str, repeat: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc, row, size, node, root) of each row, and the verified links."""
    spark = docs.sparkSession
    rows = rows_of(docs, id_col, text_col, repeat)
    seen = materialize(rows.mapInArrow(_survey(n, threshold), "k long, a long, b long, c long, d long, e long, sketch binary"), "survey")
    sets = seen.where("k = 0").selectExpr("a AS doc", "b AS row", "c AS size", "d AS node", "e AS check", "sketch")
    common = seen.where("k = 1").groupBy("a").agg(F.sum("b").alias("n")).where(F.col("n") >= COMMON_LEAST)
    common = common.orderBy(F.desc("n"), "a").limit(COMMON_MOST).orderBy("a").toPandas()  # at most 16 MB
    classes = np.minimum(np.log2(np.maximum(common["n"].to_numpy(np.float64), COMMON_LEAST) / COMMON_LEAST).astype(np.int64) + 1, (1 << CLASS_BITS) - 1)
    # sets are told apart by 128 bits: where two share the first 64, both take the other 64 as their node
    same = sets.groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high"), F.min("size").alias("size"), F.min(F.struct("doc", "row")).alias("at"), F.first("sketch").alias("sketch"))
    nodes = materialize(same, "nodes")
    alike = nodes.where("low <> high").select("node").toPandas()["node"].to_numpy(np.int64)  # about one pair in 10**10 sets
    if len(alike):
        sets = sets.withColumn("node", F.when(F.col("node").isin([int(x) for x in alike]), F.col("check")).otherwise(F.col("node")))
        discard(nodes)
        nodes = materialize(sets.groupBy("node").agg(F.min("size").alias("size"), F.min(F.struct("doc", "row")).alias("at"), F.first("sketch").alias("sketch")), "nodes")
    shared = spark.sparkContext.broadcast(tuple(x.astype(np.int64).tobytes() for x in (common["a"].to_numpy(), classes, alike)))
    buckets = min(PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), 1 << 16)
    index = rows.mapInArrow(_index(n, threshold, shared, buckets), INDEX)
    if seen.where("k = 2").agg(F.sum("a")).first()[0]:
        index = index.union(rows.mapInArrow(_index(n, threshold, shared, buckets, True), INDEX))
    members = materialize(index.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_shared, GROUPS), "members")
    groups = _placed(members, threshold)
    discard(members)

    check = _Checker(rows, nodes, n, threshold)
    link = can_link("info", "y_info", threshold)
    # cheap tests first: most pairs of a group fail by sizes and places
    apart = F.expr(f"{link} AND NOT arrays_overlap(before, y_before) AND {_enough_keys(threshold)}")
    # stars around the member with the largest share of common subsets
    central = F.max(F.struct(F.expr(f"info >> {SHARE_AT}").alias("share"), F.xxhash64("node").alias("mix"), "node", "info", "before", "own")).alias("y")
    heads = groups.groupBy("key").agg(central).select("key", F.col("y.node").alias("y"), F.col("y.info").alias("y_info"), F.col("y.before").alias("y_before"), F.col("y.own").alias("y_own"))
    checked = []
    tested = materialize(groups.join(heads, "key").where((F.col("node") != F.col("y")) & apart).select(*_ordered("node", "y")).distinct(), "star-tested")
    links = check(tested, "star")
    checked.append(tested)
    root = materialize(components(links), "roots")

    # members that are still in several components meet each other, where one subset is their first common one
    turn = 0
    while True:
        placed = groups.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        held = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.xxhash64("node", F.lit(turn)).alias("mix"), "node", "info", "before", "own")).alias("y"), *_reach(threshold))
        several = held.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"), F.max(F.struct("n", F.xxhash64("root").alias("mix"), "root", "y")).alias("most"), F.min("least_size").alias("least_size"), F.max("most_size").alias("most_size")).where("roots > 1")
        several = materialize(several, f"apart-{turn}")
        cross, rows_held = several.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if turn == MOST_TURNS or cross <= PAIRS_PER_ROW * rows_held:
            break
        # first with a further member of the group's largest component
        pivot = several.select("key", F.col("most.root").alias("y_root"), F.col("most.y.node").alias("y"), F.col("most.y.info").alias("y_info"), F.col("most.y.before").alias("y_before"), F.col("most.y.own").alias("y_own"))
        pairs = placed.join(pivot, "key").where((F.col("root") != F.col("y_root")) & apart).select(*_ordered("node", "y")).distinct().join(tested, ["a", "b"], "left_anti")
        pairs = materialize(pairs, f"pivot-{turn}")
        checked.append(pairs)
        tested = tested.union(pairs)
        found = check(pairs, f"pivot-{turn}")
        links = links.union(found)
        before, root = root, materialize(components(links), "roots")
        discard(before)
        discard(several)
        turn += 1
    # what fits no size of its group goes, and then groups that one component is left of
    members = placed.join(several.select("key", "least_size", "most_size"), "key").where(_reached(threshold)).drop("least_size", "most_size")
    met = materialize(members, "members-met")
    several_left = met.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), *_reach(threshold)).where("low <> high").drop("low", "high")
    members = materialize(met.join(several_left, "key").where(_reached(threshold)).drop("least_size", "most_size"), "members-apart")
    discard(met)
    others = members.select("key", F.col("node").alias("y"), F.col("root").alias("y_root"), F.col("info").alias("y_info"), F.col("before").alias("y_before"), F.col("own").alias("y_own"))
    more = members.join(others, "key").where((F.col("node") < F.col("y")) & (F.col("root") != F.col("y_root")) & apart).select(F.col("node").alias("a"), F.col("y").alias("b")).distinct()
    links = links.union(check(more.join(tested, ["a", "b"], "left_anti"), "apart"))
    for x in (groups, several, members, root):
        discard(x)
    root = materialize(components(links), "last-roots")
    for x in (nodes, *checked):
        discard(x)
    placed = sets.join(root, "node", "left").select("doc", "row", "size", "node", F.coalesce("root", "node").alias("root"))
    return placed, links


def common_counts(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Common tokens of each of the first `first` sets with each of all sets."""
    value, at, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = holders[at] > 1
    column = (np.cumsum(holders > 1) - 1)[at[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((first, len(sets)), np.int64)
    ends = np.append(np.arange(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS), int(column[-1]) + 1 if len(column) else 0)
    bounds = np.searchsorted(column, ends)
    for low, a, b in zip(ends, bounds[:-1], bounds[1:]):
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        out += (held[:first] @ held.T).astype(np.int64)
    for k in range(first):
        out[k, k] = len(sets[k])
    return out


def _count_links(t: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """The members of one or two blocks of a component (or of several small components): links of each to others."""
        nodes, counts = [], []
        for _, own in pdf.groupby("root"):
            one, two = int(own["i"].iloc[0]), int(own["j"].iloc[0])
            own = own.sort_values("block", kind="stable")
            first = int((own["block"] == one).sum()) if one != two else len(own)
            sets = [np.frombuffer(x, U) for x in own["tokens"]]
            copies, sizes = own["copies"].to_numpy(np.int64), np.array([len(x) for x in sets])
            common = common_counts(sets, first)
            good = 100 * common >= round(100 * t) * (sizes[:first, None] + sizes[None, :] - common)
            if one == two:
                np.fill_diagonal(good, False)
                here = good @ copies
            else:
                good = good[:, first:]
                here = np.append(good @ copies[first:], good.T @ copies[:first])
            nodes.append(own["node"].to_numpy(np.int64)), counts.append(here)
        return pd.DataFrame({"node": np.concatenate(nodes), "n": np.concatenate(counts)})

    return run


def link_counts(rows: DataFrame, placed: DataFrame, n: int, t: float) -> DataFrame:
    """node, n_links: how many other rows have a set as similar as the threshold, copies included. Links lie inside components, so
    all pairs of a component's distinct sets are verified, a large component's in pairs of blocks."""
    nodes = placed.where("size > 0").groupBy("node", "root").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "row")).alias("at"))
    groups = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.sum("copies").alias("all"))
    nodes = materialize(nodes.join(groups, "root"), "link-nodes")
    wanted = nodes.where("k > 2").select("node", "at.doc", "at.row")
    tokens = rows.join(wanted, ["doc", "row"]).select("node", "text").mapInArrow(_tokens(n), "node long, tokens binary")
    few = nodes.where(f"k BETWEEN 3 AND {BLOCK}").count()
    member = nodes.where("k > 2").select("node", "root", "copies", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")).withColumn("block", F.pmod("node", "blocks").cast("int"))
    member = member.join(materialize(tokens, "link-sets"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.when(F.col("blocks") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(max(1, 2 * few // BLOCK)))).alias("key")
    member = member.select(key, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "blocks", "block", "root", "node", "copies", "tokens")
    counted = member.groupBy("key", "i", "j", "blocks").applyInPandas(_count_links(t), "node long, n long")
    counted = materialize(counted.groupBy("node").agg(F.sum("n").alias("n")), "link-counts")
    # two sets of a component always link
    return nodes.join(counted, "node", "left").select("node", F.when(F.col("k") > 2, F.col("n") + F.col("copies") - 1).otherwise(F.col("all") - 1).alias("n_links"))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.75, count_links: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs. count_links: also n_links, the other rows whose sets are
    at least as similar as the threshold, copies included; its work grows with the square of the largest component."""
    placed, _ = _grouped(docs, n, threshold, id_col, text_col)
    least = placed.groupBy("root").agg(F.min("doc").alias("least"))
    out = placed.join(least, "root")
    more = []
    if count_links:
        out = out.join(link_counts(rows_of(docs, id_col, text_col), placed, n, threshold), "node", "left")
        more = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    out = out.select(key_to_id("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("size") == 0, F.col("doc")).otherwise(F.col("least")).alias("doc"), *more)
    return out.select("doc_id", "n_shingles", key_to_id("doc").alias("component_id"), *(["n_links"] if more else []))


def keep_one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that have the smallest doc_id of their component; those without words stay."""
    repeat = ids_repeat(docs, id_col)
    placed, _ = _grouped(docs, n, threshold, id_col, text_col, repeat)
    group = F.when(F.col("size") == 0, F.concat_ws(":", "doc", "row")).otherwise(F.col("root").cast("string"))
    first = placed.groupBy(group.alias("group")).agg(F.min(F.struct("doc", "row")).alias("at")).select("at.doc", "at.row")
    return keep_rows(docs, materialize(first, "kept"), True, id_col, text_col, repeat)
